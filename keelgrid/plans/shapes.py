"""Queries over polygons and rasters, and the SQL that says the same: polygons stand round `nation`'s keys, a raster holds `lineitem`'s prices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keelgrid.functions.scalar import SPHERE_M
from keelgrid.operators import polygons
from keelgrid.sources import adapters as a
from keelgrid.sources import raster, vector
from keelgrid.sources.files import shared_folder

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return keep


#: A hexagon that overlaps its neighbours, with a square hole, and a second, far part, round each nation's centre.
RINGS = (((-9.5, 0.0), (-3.0, -28.5), (4.0, -30.25), (9.5, 1.0), (3.5, 27.0), (-4.0, 24.5)), ((-1.5, -2.0), (2.25, -2.0), (2.25, 3.0), (-1.5, 3.0)), ((-2.0, 33.0), (2.0, 33.0), (0.5, 39.75)))


def nation_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    x, y = k * 12 - 144, (k * 17) % 80 - 40
    ring = lambda points: F.array(*(F.struct((x + p).cast("double").alias("x"), (y + q).cast("double").alias("y")) for p, q in points))
    return a.table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.array(*(ring(r) for r in RINGS)).alias("rings"))


_STEPS = ", ".join(f"({p[0]}e0, {p[1]}e0, {q[0]}e0, {q[1]}e0)" for r in RINGS for p, q in zip(r, r[1:] + r[:1], strict=True))
_EDGES = f"edges AS (SELECT n_name AS name, n_nationkey * 12 - 144 + t.a AS a, (n_nationkey * 17) % 80 - 40 + t.b AS b, n_nationkey * 12 - 144 + t.c AS c, (n_nationkey * 17) % 80 - 40 + t.d AS d FROM nation, (VALUES {_STEPS}) AS t(a, b, c, d))"
_INSIDE = "inside AS (SELECT ping_id, name FROM pings, edges WHERE (b > lat) <> (d > lat) AND lon < (c - a) * (lat - b) / (d - b) + a GROUP BY ping_id, name HAVING count(*) % 2 = 1)"


@query(f"WITH {a.PINGS_SQL}, {_EDGES}, {_INSIDE} SELECT p.ping_id, i.name AS province FROM pings p LEFT JOIN inside i ON i.ping_id = p.ping_id")
def province_polygons(spark, d):
    """The layer goes through a geometry column, as a GeoPackage's would."""
    layer = vector.decode_geometry(vector.encode_geometry(nation_shapes(spark, d)), "geometry")
    return polygons.located(a.pings(spark, d), polygons.index_of(layer, cell=4.0), cell=4.0).select("ping_id", "province")


#: A box in which the layer is cropped: west, south, east, north.
BOX = (-100.0, -33.5, 60.0, 41.25)


@query(f"WITH {a.PINGS_SQL}, {_EDGES}, {_INSIDE} SELECT p.ping_id, i.name FROM inside i JOIN pings p ON p.ping_id = i.ping_id WHERE lon > {BOX[0]} AND lat > {BOX[1]} AND lon < {BOX[2]} AND lat < {BOX[3]}")
def cropped_polygons(spark, d):
    """Pings inside the cropped layer: none outside the box is, though the join is with all."""
    index = polygons.index_of(polygons.cropped(nation_shapes(spark, d), *BOX), cell=4.0)
    return polygons.located(a.pings(spark, d), index, cell=4.0, out="name").where("name IS NOT NULL").select("ping_id", "name")


_WAYS = "ways AS (SELECT ping_id, lon, lat, lag(lon) OVER w AS lon0, lag(lat) OVER w AS lat0 FROM pings WINDOW w AS (PARTITION BY ssvid ORDER BY ts, ping_id))"
_SIDE = lambda p, q, r: f"sign(({q[0]} - {p[0]}) * ({r[1]} - {p[1]}) - ({q[1]} - {p[1]}) * ({r[0]} - {p[0]}))"
_A, _B, _P, _Q = ("lon0", "lat0"), ("lon", "lat"), ("a", "b"), ("c", "d")
_CUT = f"cut AS (SELECT DISTINCT ping_id FROM ways, edges WHERE {_SIDE(_A, _B, _P)} <> {_SIDE(_A, _B, _Q)} AND {_SIDE(_P, _Q, _A)} <> {_SIDE(_P, _Q, _B)})"


@query(f"WITH {a.PINGS_SQL}, {_EDGES}, {_INSIDE}, {_WAYS}, {_CUT} SELECT ping_id, ping_id IN (SELECT ping_id FROM inside) AS on_land, ping_id IN (SELECT ping_id FROM cut) AS crosses_land FROM pings")
def land_steps(spark, d):
    w = Window.partitionBy("ssvid").orderBy("ts", "ping_id")
    steps = a.pings(spark, d).select("ping_id", "lon", "lat", F.lag("lon").over(w).alias("lon0"), F.lag("lat").over(w).alias("lat0"))
    return polygons.land_flags(steps, polygons.index_of(nation_shapes(spark, d), cell=4.0), cell=4.0).select("ping_id", "on_land", "crosses_land")


#: Metres within which a place is near land.
NEAR = 150_000.0
_XYZ = lambda n, lon, lat: f"cos(radians({lat})) * cos(radians({lon})) AS {n}x, cos(radians({lat})) * sin(radians({lon})) AS {n}y, sin(radians({lat})) AS {n}z"
_DOT = lambda u, v: f"({u}x * {v}x + {u}y * {v}y + {u}z * {v}z)"
_TURN = lambda u, v, n: f"{u}y * {v}z - {u}z * {v}y AS {n}x, {u}z * {v}x - {u}x * {v}z AS {n}y, {u}x * {v}y - {u}y * {v}x AS {n}z"
_TO = lambda u: f"2 * asin(least(sqrt(power(px - {u}x, 2) + power(py - {u}y, 2) + power(pz - {u}z, 2)) / 2, 1))"


@query(f"""WITH {a.PINGS_SQL}, {_EDGES}, e1 AS (SELECT {_XYZ("u", "a", "b")}, {_XYZ("v", "c", "d")} FROM edges), e2 AS (SELECT *, {_TURN("u", "v", "n")} FROM e1),
e3 AS (SELECT *, sqrt({_DOT("n", "n")}) AS size, {_TURN("n", "u", "s")}, {_TURN("v", "n", "t")} FROM e2), q AS (SELECT ping_id, {_XYZ("p", "lon", "lat")} FROM pings),
m AS (SELECT ping_id, min(CASE WHEN {_DOT("p", "s")} >= 0 AND {_DOT("p", "t")} >= 0 THEN abs(asin(greatest(least({_DOT("p", "n")} / size, 1), -1))) ELSE least({_TO("u")}, {_TO("v")}) END) * {SPHERE_M!r} AS m FROM q, e3 GROUP BY ping_id)
SELECT ping_id, CASE WHEN m <= {NEAR} THEN round(m, 2) END AS land_m FROM m""")
def land_distance(spark, d):
    found = polygons.distance_to_edges(a.pings(spark, d), nation_shapes(spark, d), NEAR)
    return found.select("ping_id", F.round("land_m", 2).alias("land_m"))


#: Rows and columns of the raster.
HIGH, WIDE = 720, 1440


@query(f"""WITH {a.PINGS_SQL}, r AS (SELECT l_orderkey % {HIGH} AS row, l_partkey % {WIDE} AS col, CAST(max(l_extendedprice) AS FLOAT) AS value FROM lineitem GROUP BY 1, 2)
SELECT ping_id, CAST(value AS DOUBLE) AS value FROM pings LEFT JOIN r ON row = CAST(floor((90 - lat) * 4) AS BIGINT) AND col = CAST(floor((lon + 180) * 4) AS BIGINT)""")
def geotiff_sample(spark, d):
    """The raster is written as one GeoTIFF and read back where pings are."""
    cells = a.table(spark, d, "lineitem").groupBy((F.col("l_orderkey") % HIGH).alias("row"), (F.col("l_partkey") % WIDE).alias("col")).agg(F.max("l_extendedprice").cast("double").alias("value"))
    path = f"{shared_folder(spark, 'raster')}/prices.tif"
    raster.write_raster(cells, path, WIDE, HIGH, tile=128, frame=(-180.0, 90.0, 0.25, 0.25), epsg=4326)
    west, north, x, y = raster.Raster.of(path).frame
    pings = a.pings(spark, d).select("ping_id", F.floor((north - F.col("lat")) / y).alias("row"), F.floor((F.col("lon") - west) / x).alias("col"))
    return raster.sample_raster(pings, path).select("ping_id", "value")
