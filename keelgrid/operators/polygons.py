"""Points, steps and distances against polygons of any number of vertices: an index of cells, met in equi joins.

Polygons are rows of a name and its rings (arrays of x, y, in degrees); rows of one name are one polygon. Inside is told
by the even-odd rule over all rings, so holes are rings like others; points on a lower or left edge are inside. Rings of fewer
than three points, null rings and null polygons have no area. Rings need not be closed. Null or non-finite points are in no polygon.

The index (`index_of`) cuts the plane into cells of `cell` degrees. A cell that an edge meets keeps those edges and whether its lower
right corner is inside; a cell without edges that lies inside is told as a whole; others are not kept. From a point to its cell's
corner, along the point's own height and then along the cell's right border, only the cell's own edges can be crossed, so
the corner's side and these crossings give the point's side. Cells begin at odd places, so that no round coordinate lies on a
border. Edges are dealt to cells by explode, corners are summed in windows over one polygon's one row of cells, and nothing
is collected: the index is a table. Choose `cell` so that a cell holds some hundred edges at most.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keelgrid.functions.scalar import SPHERE_M

CELL, SHIFT_X, SHIFT_Y = 1.0, math.pi / 1000, math.e / 1000
#: Longest and shortest step, in degrees, into which edges are cut for distances.
LONGEST, SHORTEST = 2.0, 0.02


def edges_of(polygons: DataFrame, name: str = "name", rings: str = "rings") -> DataFrame:
    """(name, a, b, c, d): the edges from (a, b) to (c, d), the last point's back to the first included."""
    ring = polygons.where(F.col(name).isNotNull()).select(F.col(name).alias("name"), F.explode(rings).alias("kg_ring")).where(F.size("kg_ring") >= 3)
    after = F.concat(F.slice("kg_ring", F.lit(2), F.size("kg_ring") - 1), F.slice("kg_ring", F.lit(1), F.lit(1)))
    edge = ring.select("name", F.explode(F.arrays_zip(F.col("kg_ring").alias("p"), after.alias("q"))).alias("e"))
    edge = edge.select("name", *(F.col(f"e.{p}.{x}").cast("double").alias(n) for p, x, n in (("p", "x", "a"), ("p", "y", "b"), ("q", "x", "c"), ("q", "y", "d"))))
    return edge.where("a <> c OR b <> d")


def _at(x: Column, shift: float, cell: float) -> Column:
    return F.floor((x - F.lit(shift)) / F.lit(cell)).cast("long")


def _crossing(a: Column, b: Column, c: Column, d: Column, y: Column) -> Column:
    """Where the line through (a, b) and (c, d) has this y."""
    return (c - a) * (y - b) / (d - b) + a


def cells_of(lines: DataFrame, cell: float = CELL) -> DataFrame:
    """Adds the cells (i, j) that each segment (a, b)-(c, d) meets, one row a cell; a cell too many does no harm."""
    low, high = F.least("b", "d"), F.greatest("b", "d")
    rows = lines.withColumn("j", F.explode(F.sequence(_at(low, SHIFT_Y, cell), _at(high, SHIFT_Y, cell))))
    bottom = F.greatest(low, F.col("j") * F.lit(cell) + F.lit(SHIFT_Y))
    top = F.least(high, (F.col("j") + 1) * F.lit(cell) + F.lit(SHIFT_Y))
    x = lambda y: F.when(F.col("b") == F.col("d"), F.col("a")).otherwise(_crossing(*map(F.col, "abcd"), y))
    within = lambda v: F.least(F.greatest(v, F.least("a", "c")), F.greatest("a", "c"))
    flat = F.col("b") == F.col("d")
    left = F.when(flat, F.least("a", "c")).otherwise(within(F.least(x(bottom), x(top))))
    right = F.when(flat, F.greatest("a", "c")).otherwise(within(F.greatest(x(bottom), x(top))))
    room = F.lit(1e-9 * max(1.0, cell)) + F.lit(1e-12) * F.greatest(F.abs("a"), F.abs("c"))
    return rows.withColumn("i", F.explode(F.sequence(_at(left - room, SHIFT_X, cell), _at(right + room, SHIFT_X, cell))))


def index_of(polygons: DataFrame, name: str = "name", rings: str = "rings", cell: float = CELL) -> DataFrame:
    """(i, j, shapes): for each cell that a polygon meets or fills, an array of (name, inside, edges)."""
    edges = edges_of(polygons, name, rings)
    held = cells_of(edges, cell).groupBy("name", "i", "j").agg(F.collect_list(F.struct("a", "b", "c", "d")).alias("edges"))
    # Where an edge crosses a row's lower border it counts for all corners to its left.
    low, high = F.least("b", "d"), F.greatest("b", "d")
    lines = F.sequence(_at(low, SHIFT_Y, cell), _at(high, SHIFT_Y, cell))
    marks = edges.withColumn("j", F.explode(lines)).withColumn("y", F.col("j") * F.lit(cell) + F.lit(SHIFT_Y)).where((F.col("b") > F.col("y")) != (F.col("d") > F.col("y")))
    marks = marks.select("name", "j", (F.ceil((_crossing(*map(F.col, "abcd"), F.col("y")) - F.lit(SHIFT_X)) / F.lit(cell)).cast("long") - 2).alias("i")).groupBy("name", "j", "i").agg(F.count("*").alias("n"))
    both = marks.select("name", "j", "i", "n", F.lit(False).alias("is_cell")).unionByName(held.select("name", "j", "i", F.lit(0).cast("long").alias("n"), F.lit(True).alias("is_cell")))
    from_right = Window.partitionBy("name", "j").orderBy(F.desc("i"), "is_cell")
    before = from_right.rowsBetween(Window.unboundedPreceding, -1)
    both = both.select("name", "j", "i", "is_cell", (F.sum("n").over(from_right) % 2 == 1).alias("inside"), F.last(F.when(F.col("is_cell"), F.col("i")), ignorenulls=True).over(before).alias("next"))
    corners = both.where("is_cell").drop("is_cell")
    partly = held.join(corners.select("name", "i", "j", "inside"), ["name", "i", "j"])
    gaps = corners.where("inside AND next > i + 1").select("name", F.explode(F.sequence(F.col("i") + 1, F.col("next") - 1)).alias("i"), "j", F.lit(True).alias("inside"))
    whole = gaps.withColumn("edges", F.array().cast(partly.schema["edges"].dataType))
    return partly.unionByName(whole).groupBy("i", "j").agg(F.collect_list(F.struct("name", "inside", "edges")).alias("shapes"))


def _side(shape: Column, x: Column, y: Column, i: Column, j: Column, cell: float) -> Column:
    """Whether (x, y), which lies in cell (i, j), is inside the shape."""
    right, bottom = (i + 1) * F.lit(cell) + F.lit(SHIFT_X), j * F.lit(cell) + F.lit(SHIFT_Y)

    def crossed(e: Column) -> Column:
        a, b, c, d = (e[k] for k in "abcd")
        at = _crossing(a, b, c, d, y)
        along = ((b > y) != (d > y)) & ((x < at) != (right < at))
        up = _crossing(b, a, d, c, right)
        border = ((a > right) != (c > right)) & ((up > bottom) != (up > y))
        return along.cast("int") + border.cast("int")

    return (F.aggregate(shape["edges"], shape["inside"].cast("int"), lambda n, e: n + crossed(e)) % 2) == 1


def names_at(points: DataFrame, index: DataFrame, x: str = "lon", y: str = "lat", cell: float = CELL, out: str = "names") -> DataFrame:
    """Adds an array, in order, of the names of all polygons that hold the point."""
    px, py = F.col(x).cast("double"), F.col(y).cast("double")
    known = px.isNotNull() & py.isNotNull() & ~F.isnan(px) & ~F.isnan(py) & (F.abs(px) < 1e6) & (F.abs(py) < 1e6)
    place = points.withColumn("kg_i", F.when(known, _at(px, SHIFT_X, cell))).withColumn("kg_j", F.when(known, _at(py, SHIFT_Y, cell)))
    met = place.join(index.withColumnsRenamed({"i": "kg_ci", "j": "kg_cj", "shapes": "kg_shapes"}), (F.col("kg_i") == F.col("kg_ci")) & (F.col("kg_j") == F.col("kg_cj")), "left")
    hits = F.transform(F.filter("kg_shapes", lambda s: _side(s, px, py, F.col("kg_i"), F.col("kg_j"), cell)), lambda s: s["name"])
    return met.withColumn(out, F.array_sort(F.coalesce(hits, F.array().cast("array<string>")))).drop("kg_i", "kg_j", "kg_ci", "kg_cj", "kg_shapes")


def located(points: DataFrame, index: DataFrame, x: str = "lon", y: str = "lat", cell: float = CELL, out: str = "province") -> DataFrame:
    """Left join of points with the polygons that hold them: one row for each, one with null where there is none."""
    return names_at(points, index, x, y, cell, "kg_names").withColumn(out, F.explode_outer("kg_names")).drop("kg_names")


def _crosses(e: Column, a: Column, b: Column, c: Column, d: Column) -> Column:
    """Whether the segments e and (a, b)-(c, d) cross."""
    side = lambda px, py, qx, qy, rx, ry: F.signum((qx - px) * (ry - py) - (qy - py) * (rx - px))
    return (side(a, b, c, d, e["a"], e["b"]) != side(a, b, c, d, e["c"], e["d"])) & (side(e["a"], e["b"], e["c"], e["d"], a, b) != side(e["a"], e["b"], e["c"], e["d"], c, d))


def land_flags(steps: DataFrame, index: DataFrame, cell: float = CELL) -> DataFrame:
    """From rows with lon, lat and the ping before's lon0, lat0 (null: none): on_land and crosses_land. Each different step is looked up once."""
    out = names_at(steps, index, cell=cell, out="kg_on").withColumn("on_land", F.size("kg_on") > 0).drop("kg_on")
    ways = steps.select(*(F.col(c).cast("double").alias(n) for c, n in (("lon0", "a"), ("lat0", "b"), ("lon", "c"), ("lat", "d")))).where("abs(a) < 1e6 AND abs(b) < 1e6 AND abs(c) < 1e6 AND abs(d) < 1e6").distinct()
    met = cells_of(ways, cell).join(index, ["i", "j"])
    meets = F.exists("shapes", lambda s: F.exists(s["edges"], lambda e: _crosses(e, *map(F.col, "abcd"))))
    crossing = met.where(meets).select("a", "b", "c", "d").distinct().withColumn("kg_crosses", F.lit(True))
    same = lambda p, q: F.col(p).cast("double") == F.col(q)
    joined = out.join(crossing, same("lon0", "a") & same("lat0", "b") & same("lon", "c") & same("lat", "d"), "left")
    return joined.withColumn("crosses_land", F.coalesce("kg_crosses", F.lit(False))).drop("a", "b", "c", "d", "kg_crosses")


def _vector(lon: Column, lat: Column) -> Column:
    return F.struct((F.cos(F.radians(lat)) * F.cos(F.radians(lon))).alias("x"), (F.cos(F.radians(lat)) * F.sin(F.radians(lon))).alias("y"), F.sin(F.radians(lat)).alias("z"))


def _dot(u: Column, v: Column) -> Column:
    return u["x"] * v["x"] + u["y"] * v["y"] + u["z"] * v["z"]


def _cross(u: Column, v: Column) -> Column:
    return F.struct((u["y"] * v["z"] - u["z"] * v["y"]).alias("x"), (u["z"] * v["x"] - u["x"] * v["z"]).alias("y"), (u["x"] * v["y"] - u["y"] * v["x"]).alias("z"))


def _angle(u: Column, v: Column) -> Column:
    """Between unit vectors, exact also for small ones."""
    chord = F.sqrt(F.pow(u["x"] - v["x"], 2) + F.pow(u["y"] - v["y"], 2) + F.pow(u["z"] - v["z"], 2))
    return 2 * F.asin(F.least(chord / 2, F.lit(1.0)))


def arc_distance(p: Column, u: Column, v: Column) -> Column:
    """Angle between the point p and the great-circle arc from u to v (columns of unit vectors, shorter than half a circle)."""
    n = _cross(u, v)
    size = F.sqrt(_dot(n, n))
    beside = (size > 0) & (_dot(p, _cross(n, u)) >= 0) & (_dot(p, _cross(v, n)) >= 0)
    foot = F.abs(F.asin(F.greatest(F.least(_dot(p, n) / F.when(size > 0, size), F.lit(1.0)), F.lit(-1.0))))
    return F.when(beside, foot).otherwise(F.least(_angle(p, u), _angle(p, v)))


def _bands(lat: Column, side: float) -> Column:
    return F.floor((lat + 90) / F.lit(side)).cast("long")


def _around(j: Column, side: float) -> Column:
    """How many cells go round the band: about `side` wide where the band is widest, one at least."""
    nearest = F.greatest(F.lit(0.0), F.least(F.abs(j * F.lit(side) - 90), F.abs((j + 1) * F.lit(side) - 90)))
    wide = F.when((j * F.lit(side) <= 90) & ((j + 1) * F.lit(side) >= 90), F.lit(0.0)).otherwise(nearest)
    return F.greatest(F.floor(360 * F.cos(F.radians(F.least(wide, F.lit(90.0)))) / F.lit(side)).cast("long"), F.lit(1).cast("long"))


def _cap_cells(lon: Column, lat: Column, radius: float, side: float) -> Column:
    """Cells of the sphere that may meet the cap of `radius` degrees round the point: (j, i), i within the band, round the antimeridian."""
    half = F.when(F.abs(lat) + F.lit(radius) >= 90, F.lit(180.0)).otherwise(F.degrees(F.asin(F.least(F.lit(math.sin(math.radians(min(radius, 90.0)))) / F.cos(F.radians(lat)), F.lit(1.0)))))

    def in_band(j: Column) -> Column:
        n = _around(j, side)
        first, last = F.floor((lon - half + 180) / 360 * n).cast("long"), F.floor((lon + half + 180) / 360 * n).cast("long")
        all_ = last - first + 1 >= n
        return F.transform(F.sequence(F.when(all_, F.lit(0).cast("long")).otherwise(first), F.when(all_, n - 1).otherwise(last)), lambda i: F.struct(j.alias("j"), F.pmod(i, n).alias("i")))

    bands = F.sequence(_bands(F.greatest(lat - F.lit(radius), F.lit(-90.0)), side), _bands(F.least(lat + F.lit(radius), F.lit(90.0)), side))
    return F.flatten(F.transform(bands, in_band))


def distance_to_edges(points: DataFrame, polygons: DataFrame, metres: float, x: str = "lon", y: str = "lat", name: str = "name", rings: str = "rings", out: str = "land_m") -> DataFrame:
    """Adds the distance in metres from each point to the nearest edge, as a great-circle arc, where it is at most `metres`; else null.

    Edges are cut into steps of some `metres`, told by the cell of the step's middle; a point asks the cells that the cap of `metres` and
    half a step meets. Each different place asks once."""
    reach = math.degrees(metres / SPHERE_M)
    step = min(max(reach, SHORTEST), LONGEST)
    radius = reach + step / 2 + 1e-9
    side = 2 * radius
    ends = edges_of(polygons, name, rings).select(_vector(F.col("a"), F.col("b")).alias("u"), _vector(F.col("c"), F.col("d")).alias("v")).distinct()
    whole = ends.withColumn("kg_angle", _angle(F.col("u"), F.col("v"))).withColumn("kg_n", F.greatest(F.ceil(F.degrees("kg_angle") / F.lit(step)), F.lit(1)))

    def part(k: Column) -> Column:
        """The arc's point at this share of the way."""
        s, w = F.sin(F.col("kg_angle")), F.col("kg_angle")
        near = lambda axis: F.when(s < 1e-12, F.col("u")[axis] + (F.col("v")[axis] - F.col("u")[axis]) * k).otherwise((F.sin((1 - k) * w) * F.col("u")[axis] + F.sin(k * w) * F.col("v")[axis]) / s)
        return F.struct(*(near(axis).alias(axis) for axis in "xyz"))

    cut = whole.withColumn("kg_k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("kg_n") - 1)))
    share = lambda more: (F.col("kg_k") + more) / F.col("kg_n")
    cut = cut.select(part(share(0.0)).alias("u"), part(share(1.0)).alias("v"), part(share(0.5)).alias("m"))
    lat, lon = F.degrees(F.asin(F.greatest(F.least(F.col("m.z"), F.lit(1.0)), F.lit(-1.0)))), F.degrees(F.atan2(F.col("m.y"), F.col("m.x")))
    cut = cut.withColumn("kg_bj", _bands(lat, side)).withColumn("kg_bi", F.pmod(F.floor((lon + 180) / 360 * _around(F.col("kg_bj"), side)).cast("long"), _around(F.col("kg_bj"), side))).drop("m")
    px, py = F.col(x).cast("double"), F.col(y).cast("double")
    places = points.select(px.alias("kg_x"), py.alias("kg_y")).where("abs(kg_y) <= 90 AND abs(kg_x) < 1e6").distinct()
    asked = places.withColumn("kg_c", F.explode(_cap_cells(F.col("kg_x"), F.col("kg_y"), radius, side))).select("kg_x", "kg_y", F.col("kg_c.j").alias("kg_pj"), F.col("kg_c.i").alias("kg_pi"), _vector(F.col("kg_x"), F.col("kg_y")).alias("p"))
    met = asked.join(cut, (F.col("kg_pj") == F.col("kg_bj")) & (F.col("kg_pi") == F.col("kg_bi")))
    least = met.groupBy("kg_x", "kg_y").agg((F.min(arc_distance(F.col("p"), F.col("u"), F.col("v"))) * F.lit(SPHERE_M)).alias(out)).where(F.col(out) <= metres)
    return points.join(least, (px == F.col("kg_x")) & (py == F.col("kg_y")), "left").drop("kg_x", "kg_y")


def near_land(points: DataFrame, polygons: DataFrame, metres: float, x: str = "lon", y: str = "lat", cell: float = CELL, out: str = "near_land") -> DataFrame:
    """Adds whether the point is on land or at most `metres` from it."""
    seen = distance_to_edges(points, polygons, metres, x, y, out="kg_m")
    return names_at(seen, index_of(polygons, cell=cell), x, y, cell, "kg_on").withColumn(out, (F.size("kg_on") > 0) | F.col("kg_m").isNotNull()).drop("kg_m", "kg_on")


def cropped(polygons: DataFrame, west: float, south: float, east: float, north: float, rings: str = "rings") -> DataFrame:
    """The polygons inside a box. Each ring is cut by the box's four sides in turn; what is left of a ring runs along the box where it was
    cut, so inside the box the even-odd rule says what it said before, whatever the rings' crossings. Rings without a part inside
    go, and polygons without rings."""
    ring = rings
    for axis, limit, above in (("x", west, True), ("x", east, False), ("y", south, True), ("y", north, False)):
        polygons = polygons.withColumn(ring, _cut(F.col(ring), axis, float(limit), above))
    kept = F.filter(ring, lambda r: F.size(r) >= 3)
    return polygons.withColumn(ring, kept).where(F.size(ring) > 0)


def _cut(rings: Column, axis: str, limit: float, above: bool) -> Column:
    """Each ring's part on one side of a line (Sutherland and Hodgman's rule for one side)."""
    other = "y" if axis == "x" else "x"
    inside = lambda p: p[axis] >= limit if above else p[axis] <= limit

    def meeting(p: Column, q: Column) -> Column:
        at = p[other] + (q[other] - p[other]) * ((F.lit(limit) - p[axis]) / (q[axis] - p[axis]))
        parts = {axis: F.lit(limit), other: at}
        return F.struct(parts["x"].alias("x"), parts["y"].alias("y"))

    point = lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y"))

    def kept(e: Column) -> Column:
        p, q = e["p"], e["q"]
        none = F.array().cast("array<struct<x:double,y:double>>")
        return F.when(inside(p) & inside(q), F.array(point(q))).when(inside(p), F.array(meeting(p, q))).when(inside(q), F.array(meeting(p, q), point(q))).otherwise(none)

    def one(ring: Column) -> Column:
        after = F.concat(F.slice(ring, F.lit(2), F.size(ring) - 1), F.slice(ring, F.lit(1), F.lit(1)))
        return F.flatten(F.transform(F.arrays_zip(ring.alias("p"), after.alias("q")), lambda e: kept(F.struct(e["p"].alias("p"), e["q"].alias("q")))))

    return F.transform(F.filter(rings, lambda r: F.size(r) >= 3), one)


def buffered(polygons: DataFrame, distance: float, name: str = "name", rings: str = "rings", steps: int = 8) -> DataFrame:
    """(name, piece, rings): simple polygons whose union is the polygon and all within `distance` of it, in the coordinates' own (planar) unit.

    Piece 0 is the polygon itself; each edge gives the strip beside it with round caps at both ends, half circles of `steps` straight
    parts drawn round the circle, so that nothing within the distance is lost (up to 1 / cos(pi / 2 steps) of it is added). A
    point is in the buffer if any piece holds it (`in_buffer`); overlaps stay, since the union decides."""
    wide = distance / math.cos(math.pi / (2 * steps))
    e = edges_of(polygons, name, rings)
    e = e.withColumn("kg_l", F.hypot(F.col("c") - F.col("a"), F.col("d") - F.col("b")))
    ux, uy = (F.col("c") - F.col("a")) / F.col("kg_l"), (F.col("d") - F.col("b")) / F.col("kg_l")

    def cap(x: str, y: str, sign: int) -> list[Column]:
        turns = [math.pi * k / steps - math.pi / 2 for k in range(steps + 1)]
        at = lambda t: (math.cos(t) * sign * wide, math.sin(t) * sign * wide)
        return [F.struct((F.col(x) + ux * c - uy * s).alias("x"), (F.col(y) + uy * c + ux * s).alias("y")) for c, s in map(at, turns)]

    strips = e.select("name", (F.abs(F.xxhash64("a", "b", "c", "d") % (1 << 62)) + 1).alias("piece"), F.array(F.array(*cap("c", "d", 1), *cap("a", "b", -1))).alias("rings"))
    plain = F.transform(rings, lambda r: F.transform(r, lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y"))))
    whole = polygons.where(F.col(name).isNotNull() & F.col(rings).isNotNull()).select(F.col(name).alias("name"), F.lit(0).cast("long").alias("piece"), plain.alias("rings"))
    return whole.unionByName(strips)


def in_buffer(points: DataFrame, pieces: DataFrame, x: str = "lon", y: str = "lat", cell: float = CELL, out: str = "names") -> DataFrame:
    """Adds an array, in order, of the names whose buffer (`buffered`) holds the point."""
    keyed = pieces.select(F.concat(F.col("piece").cast("string"), F.lit(":"), F.col("name")).alias("name"), "rings")
    found = names_at(points, index_of(keyed, cell=cell), x, y, cell, "kg_pieces")
    return found.withColumn(out, F.array_sort(F.array_distinct(F.transform("kg_pieces", lambda n: F.regexp_replace(n, r"^\d+:", ""))))).drop("kg_pieces")
