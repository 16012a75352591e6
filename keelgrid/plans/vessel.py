"""Queries over vessel data and the SQL that says the same. Doubles are rounded in both."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelgrid.functions import grid as g
from keelgrid.functions.scalar import sanitise, tile_of
from keelgrid.operators import behaviour, coverage, fleet, grid, iforest, impact, kinematics, provinces, quality, score, seabed, stops
from keelgrid.sources import adapters as a

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
#: Times of the driver's events are about a hundred times as far apart as pings are.
SCALE = 100.0


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def rounded(df: DataFrame, digits: int = 6, nudge: float = 0.0, **more: int) -> DataFrame:
    """Doubles rounded; the nudge, added in the SQL too, keeps values that lie halfway from going two ways."""
    return df.select(*((F.round(F.col(c) + F.lit(nudge), more.get(c, digits)) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


COVER_SQL = f"""WITH {a.SHIP_DAYS_SQL}, d AS (SELECT DISTINCT ship, day FROM ship_days),
act AS (SELECT ship, year(day) AS year, count(*) AS active_days FROM d GROUP BY ship, year(day)),
tot AS (SELECT *, date_diff('day', make_date(year, 1, 1), make_date(year + 1, 1, 1)) AS total_days FROM act),
cover AS (SELECT *, active_days / CAST(total_days AS DOUBLE) AS coverage FROM tot),
grid AS (SELECT s.ship, y.year, coalesce(c.coverage, 0) AS coverage FROM (SELECT DISTINCT ship FROM cover) s CROSS JOIN (SELECT DISTINCT year FROM cover) y LEFT JOIN cover c ON c.ship = s.ship AND c.year = y.year),
mids AS (SELECT year, median(coverage) AS mid FROM grid GROUP BY year),
ends AS (SELECT x.year AS start_year, y.year AS end_year FROM mids x, mids y WHERE y.year >= x.year + 4),
stats AS (SELECT start_year, end_year, count(*) AS length, median(mid) AS median_coverage, min(mid) AS min_coverage, stddev_samp(mid) AS sd FROM ends JOIN mids ON year BETWEEN start_year AND end_year GROUP BY ALL),
fleet AS (SELECT start_year, end_year, count(DISTINCT CASE WHEN coverage > 0 THEN ship END) AS active_ships, avg(coverage) AS total_coverage FROM ends JOIN grid ON year BETWEEN start_year AND end_year GROUP BY ALL),
cand AS (SELECT s.*, CASE WHEN median_coverage = 0 THEN 1e9 ELSE sd / median_coverage END AS cv_coverage, active_ships, total_coverage FROM stats s JOIN fleet f USING (start_year, end_year)),
scored AS (SELECT *, length * median_coverage * min_coverage * min_coverage / (1 + cv_coverage) AS score FROM cand)"""


def _cover(spark: SparkSession, d: str) -> DataFrame:
    return coverage.coverage(a.ship_days(spark, d))


@query(COVER_SQL + " SELECT ship, year, active_days, total_days, round(coverage, 6) AS coverage FROM cover")
def coverage_by_ship_year(spark, d):
    return rounded(_cover(spark, d).withColumn("year", F.col("year").cast("long")))


@query(COVER_SQL + " SELECT ship, year, round(coverage, 6) AS coverage, round(mid, 6) AS mid FROM grid JOIN mids USING (year)")
def coverage_matrix_dense(spark, d):
    cells = coverage.dense(_cover(spark, d))
    return rounded(cells.join(F.broadcast(cells.groupBy("year").agg(F.median("coverage").alias("mid"))), "year").select("ship", F.col("year").cast("long").alias("year"), "coverage", "mid"))


@query(COVER_SQL + " SELECT start_year, end_year, length, round(median_coverage, 6) AS median_coverage, round(min_coverage, 6) AS min_coverage, round(cv_coverage, 6) AS cv_coverage, round(score, 6) AS score, active_ships, round(total_coverage, 6) AS total_coverage FROM scored")
def core_window_candidates(spark, d):
    w = coverage.windows(_cover(spark, d))
    return rounded(w.select(F.col("start_year").cast("long").alias("start_year"), F.col("end_year").cast("long").alias("end_year"), "length", "median_coverage", "min_coverage", "cv_coverage", "score", "active_ships", "total_coverage"))


@query(COVER_SQL + """, top AS (SELECT * FROM scored ORDER BY score DESC, start_year, end_year LIMIT 20),
r AS (SELECT row_number() OVER o AS rank, *, score - lead(score) OVER o AS margin FROM top WINDOW o AS (ORDER BY score DESC, start_year, end_year))
SELECT rank, start_year, end_year, round(score, 6) AS score, round(margin, 6) AS margin, round(margin / score, 6) AS margin_share, end_year - start_year + 1 AS n_years FROM r""")
def core_window_ranked(spark, d):
    r = coverage.ranked(coverage.windows(_cover(spark, d)))
    return rounded(r.select("rank", F.col("start_year").cast("long").alias("start_year"), F.col("end_year").cast("long").alias("end_year"), "score", "margin", "margin_share", F.size("years").cast("long").alias("n_years")))


@query(COVER_SQL + """, cells AS (SELECT start_year, end_year, ship, coverage FROM ends JOIN cover ON year BETWEEN start_year AND end_year),
ships AS (SELECT start_year, end_year, median(m) AS c_med, count(*) AS ships FROM (SELECT start_year, end_year, ship, median(coverage) AS m FROM cells GROUP BY ALL) GROUP BY ALL),
al AS (SELECT start_year, end_year, min(coverage) AS c_min, stddev_samp(coverage) / (avg(coverage) + 1e-9) AS cv FROM cells GROUP BY ALL)
SELECT start_year, end_year, ships, round(c_med, 6) AS c_med, round(c_min, 6) AS c_min, round(cv, 6) AS cv, round((end_year - start_year + 1) * c_med * c_min / (1 + cv), 6) AS score FROM ships JOIN al USING (start_year, end_year)""")
def core_window_v1(spark, d):
    w = coverage.windows_by_ship(_cover(spark, d))
    return rounded(w.withColumn("start_year", F.col("start_year").cast("long")).withColumn("end_year", F.col("end_year").cast("long")))


@query(COVER_SQL + ", best AS (SELECT start_year, end_year FROM scored ORDER BY score DESC, start_year, end_year LIMIT 1) SELECT DISTINCT ship FROM cover, best WHERE year BETWEEN start_year AND end_year AND coverage > 0")
def core_ships(spark, d):
    cover = _cover(spark, d)
    best = coverage.windows(cover).orderBy(F.desc("score"), "start_year", "end_year").limit(1).select("start_year", "end_year")
    return cover.join(F.broadcast(best), F.col("year").between(F.col("start_year"), F.col("end_year"))).where("coverage > 0").select("ship").distinct()


@query(f"WITH {a.SHIP_DAYS_SQL} SELECT DISTINCT c_custkey AS ship FROM customer WHERE c_custkey NOT IN (SELECT ship FROM ship_days)")
def missing_ships(spark, d):
    return coverage.missing(a.specs(spark, d).select(F.col("ssvid").alias("ship")), a.ship_days(spark, d), "ship")


def _values(rows) -> str:
    return ", ".join("(" + ", ".join("'" + x + "'" for x in r) + ")" for r in rows)


_MMSI_SQL = f"v(mmsi, vessel, ref) AS (VALUES {_values(fleet.VESSELS)}), al(spelling, canonical) AS (VALUES {_values(fleet.ALIASES)})"
_KEYS = [v[0] for v in fleet.VESSELS] + ["999000111", "999000222"]
_KEYS_SQL = "[" + ", ".join(f"'{k}'" for k in _KEYS) + "]"
_SPELL = [x[0] for x in fleet.ALIASES] + ["Congo River", "Fairway", "Some Other"]
_SPELL_SQL = "[" + ", ".join(f"'{k}'" for k in _SPELL) + "]"


def _pick(names: list[str], by: str):
    return F.element_at(F.array(*(F.lit(x) for x in names)), (F.col(by) % len(names) + 1).cast("int"))


@query(f"WITH {_MMSI_SQL}, p AS (SELECT event_id, {_KEYS_SQL}[user_id % {len(_KEYS)} + 1] AS mmsi FROM events) SELECT event_id, p.mmsi, coalesce(vessel, 'unknown_' || p.mmsi) AS name, coalesce(ref, p.mmsi) AS ref_id FROM p LEFT JOIN v ON v.mmsi = p.mmsi")
def mmsi_name_join(spark, d):
    return fleet.name_vessels(a.table(spark, d, "events").select("event_id", _pick(_KEYS, "user_id").alias("mmsi")))


@query(f"WITH {_MMSI_SQL}, p AS (SELECT event_id, {_SPELL_SQL}[event_id % {len(_SPELL)} + 1] AS name FROM events) SELECT event_id, coalesce(canonical, name) AS name, regexp_replace(coalesce(canonical, name), '[^A-Za-z0-9_-]', '_', 'g') AS safe FROM p LEFT JOIN al ON spelling = name")
def alias_normalise(spark, d):
    return fleet.normalise_names(a.table(spark, d, "events").select("event_id", _pick(_SPELL, "event_id").alias("name"))).withColumn("safe", sanitise(F.col("name")))


@query("SELECT event_id, CASE WHEN user_id = 7 THEN 8 ELSE user_id END AS ssvid FROM events")
def mmsi_remap(spark, d):
    return fleet.remap(a.table(spark, d, "events").select("event_id", F.col("user_id").alias("ssvid")), "ssvid", 7, 8)


_BASE = f"WITH {a.PINGS_SQL}, {a.SPECS_SQL}, spec1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ssvid ORDER BY service_speed_kn, dredge_width_m, dredging_depth_m) AS n FROM specs) WHERE n = 1)"


def _spec_pings(spark, d):
    return fleet.with_specs(a.pings(spark, d), a.specs(spark, d))


@query(_BASE + " SELECT ping_id, p.ssvid, service_speed_kn, round(dredge_width_m, 6) AS dredge_width_m, round(dredging_depth_m, 6) AS dredging_depth_m FROM pings p LEFT JOIN spec1 s ON s.ssvid = p.ssvid")
def ship_specs_join(spark, d):
    return rounded(_spec_pings(spark, d).select("ping_id", "ssvid", "service_speed_kn", "dredge_width_m", "dredging_depth_m"))


@query(_BASE + " SELECT ping_id, round(speed, 6) AS speed FROM pings p LEFT JOIN spec1 s ON s.ssvid = p.ssvid WHERE service_speed_kn IS NULL OR speed IS NULL OR speed <= 1.15e0 * service_speed_kn")
def speed_cap(spark, d):
    return rounded(fleet.speed_capped(_spec_pings(spark, d)).select("ping_id", "speed"))


@query(f"WITH {a.SHIP_DAYS_SQL} SELECT ship, CAST(day AS VARCHAR) AS day FROM ship_days WHERE year(day) BETWEEN 1996 AND 1999 AND ship IN (1, 3, 5)")
def core_filter(spark, d):
    ships = spark.sql("SELECT * FROM VALUES (1L), (3L), (5L) AS t(ship)")
    return fleet.core(a.ship_days(spark, d), ships, 1996, 1999).withColumn("day", F.col("day").cast("string"))


@query("SELECT ssvid, rows, row_number() OVER (ORDER BY rows DESC, ssvid) AS ordinal, 'vessel_' || CASE WHEN row_number() OVER (ORDER BY rows DESC, ssvid) < 10 THEN '0' ELSE '' END || row_number() OVER (ORDER BY rows DESC, ssvid) || '_' || ssvid AS folder FROM (SELECT user_id AS ssvid, count(*) AS rows FROM events GROUP BY 1)")
def split_metadata(spark, d):
    return fleet.split_plan(a.pings(spark, d), "ssvid")


@query(f"WITH {a.PINGS_SQL} SELECT seg_id, ping_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY seg_id ORDER BY ts, ping_id) AS n FROM pings) WHERE n = 1")
def dedupe_first(spark, d):
    return fleet.first_per_key(a.pings(spark, d), ["seg_id"], ["ts", "ping_id"]).select("seg_id", "ping_id", "ts")


_KIN = f"""WITH {a.PINGS_SQL}, {a.SPECS_SQL}, lagged AS (SELECT *, (epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 1e6 AS dt_s, abs(course - lag(course) OVER w) AS dc, speed - lag(speed) OVER w AS dv FROM pings WINDOW w AS (PARTITION BY ssvid ORDER BY ts, ping_id)),
kin AS (SELECT ping_id, ssvid, ts, seg_id, speed, course, lon, lat, dt_s, coalesce(CASE WHEN dc > 180 THEN 360 - dc ELSE dc END, 0) AS turn_deg, coalesce(dv * 0.514444e0 / greatest(dt_s, 1e0), 0) AS accel_ms2 FROM lagged)"""


def _kin(spark, d, by_vessel=False):
    """The driver's events are too sparse for segments of a day: here a vessel is a segment. by_vessel: as dealt by the adapter."""
    return kinematics.kinematics(a.pings(spark, d, by_vessel).withColumn("seg_id", F.col("ssvid").cast("string")), "ssvid" if by_vessel else "seg_id")


@query(_KIN + " SELECT ping_id, round(dt_s + 1e-9, 6) AS dt_s, round(turn_deg + 1e-9, 6) AS turn_deg, round(accel_ms2 + 1e-9, 6) + 0e0 AS accel_ms2 FROM kin")
def kinematics_steps(spark, d):
    return rounded(_kin(spark, d).select("ping_id", "dt_s", "turn_deg", "accel_ms2"), nudge=1e-9)


_HAV = "(2 * 6371000e0 * atan2(sqrt({0}), sqrt(1 - ({0}))) / 1852e0)"


def _hav(a1, o1, a2, o2):
    return _HAV.format(f"(pow(sin(radians({a2} - {a1}) / 2), 2) + cos(radians({a1})) * cos(radians({a2})) * pow(sin(radians({o2} - {o1}) / 2), 2))")


_STEPS = _KIN + f""", pos AS (SELECT *, lag(lat) OVER w AS pa, lag(lon) OVER w AS po, lead(lat) OVER w AS na, lead(lon) OVER w AS no FROM kin WINDOW w AS (PARTITION BY ssvid ORDER BY ts, ping_id)),
steps AS (SELECT *, {_hav('pa', 'po', 'lat', 'lon')} AS d_prev_nm, {_hav('lat', 'lon', 'na', 'no')} AS d_next_nm, {_hav('pa', 'po', 'na', 'no')} AS d_bridge_nm FROM pos)"""


def _steps(spark, d):
    return kinematics.steps(_kin(spark, d))


@query(_STEPS + " SELECT ping_id, round(d_prev_nm, 4) AS d_prev_nm, round(d_next_nm, 4) AS d_next_nm, round(d_bridge_nm, 4) AS d_bridge_nm FROM steps")
def haversine_steps(spark, d):
    return rounded(_steps(spark, d).select("ping_id", "d_prev_nm", "d_next_nm", "d_bridge_nm"), 4)


@query(_STEPS + " SELECT ping_id, coalesce(CASE WHEN dt_s > 0 THEN d_prev_nm / dt_s * 3600e0 END > coalesce(service_speed_kn * 1.5e0 / 1000, 30e0), false) OR coalesce(d_prev_nm > 10 AND dt_s <= 3600, false) AS geo_jump FROM steps s LEFT JOIN specs USING (ssvid)")
def geo_jump_flags(spark, d):
    rows = _steps(spark, d).join(a.specs(spark, d), "ssvid", "left")
    return rows.select("ping_id", kinematics.jump(F.col("dt_s"), F.col("service_speed_kn"), 1.5 / 1000, 30.0, 10.0, 3600.0).alias("geo_jump"))


@query(_STEPS + " SELECT ping_id, coalesce(d_prev_nm > 1 AND d_next_nm > 1 AND d_bridge_nm < 3, false) AS geo_spike FROM steps")
def geo_spike_flags(spark, d):
    return _steps(spark, d).select("ping_id", kinematics.spike(1.0, 3.0).alias("geo_spike"))


@query(_KIN + " SELECT ping_id, coalesce(speed < 1 OR dt_s > 30000, false) AS is_stop FROM kin")
def stop_flag(spark, d):
    return _kin(spark, d).select("ping_id", kinematics.stop_flag(F.col("speed"), F.col("dt_s"), 1.0, 300.0 * SCALE).alias("is_stop"))


@query(_KIN + " SELECT ping_id FROM kin WHERE abs(accel_ms2) <= 1e-4")
def accel_filter(spark, d):
    return quality.plausible_acceleration(_kin(spark, d), 1e-4, "accel_ms2").select("ping_id")


@query(f"WITH {a.PINGS_SQL} SELECT ssvid, round(q, 6) AS q05, n AS n_obs, round(least(greatest(q, 0.15e0), 0.8e0), 6) AS threshold FROM (SELECT ssvid, quantile_cont(speed, 0.05) AS q, count(*) AS n FROM pings WHERE speed > 0 GROUP BY 1)")
def adaptive_stop_threshold(spark, d):
    return rounded(quality.slow_threshold(a.pings(spark, d)))


_ROLL = _KIN + """, roll AS (SELECT *, CASE WHEN count(speed) OVER f = 5 THEN quantile_cont(speed, 0.25) OVER f END AS q1, CASE WHEN count(speed) OVER f = 5 THEN quantile_cont(speed, 0.5) OVER f END AS q2, CASE WHEN count(speed) OVER f = 5 THEN quantile_cont(speed, 0.75) OVER f END AS q3, list(speed) OVER f AS near
 FROM kin WINDOW f AS (PARTITION BY ssvid ORDER BY ts, ping_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)), r5 AS (SELECT *, q2 AS median5, 1.4826e0 * (q3 - q1) AS spread5 FROM roll)"""


@query(_ROLL + " SELECT ping_id, round(median5 + 1e-9, 6) AS median5, round(spread5 + 1e-9, 6) AS spread5 FROM r5")
def rolling_iqr(spark, d):
    return rounded(quality.rolling(_kin(spark, d)).select("ping_id", "median5", "spread5"), nudge=1e-9)


@query(_ROLL + " SELECT ping_id, coalesce(spread5 > 0 AND abs(speed - median5) > 1.5e0 * spread5 AND len(list_filter(near, lambda x: abs(x - speed) < spread5)) <= 2, false) AS speed_spike FROM r5")
def speed_spikes(spark, d):
    return quality.speed_spikes(_kin(spark, d), 1.5).select("ping_id", "speed_spike")


_RHYTHM = """, q AS (SELECT ssvid, least(quantile_cont(dt_s, 0.5), 60000e0) AS p50_s, quantile_cont(dt_s, 0.95) AS p95_s, count(*) AS n_obs, avg(CASE WHEN dt_s >= 30000 THEN 1e0 ELSE 0e0 END) AS long_share FROM kin WHERE dt_s IS NOT NULL GROUP BY 1),
cad AS (SELECT *, CASE WHEN long_share > 0.5 THEN least(120000e0, 5 * p50_s) ELSE least(90000e0, greatest(18000e0, 3 * p50_s)) END AS threshold_s, least(8e0, greatest(3e0, ceil(3000e0 / p50_s))) AS n_min FROM q)"""
_CAD = _KIN + _RHYTHM


@query(_CAD + " SELECT ssvid, round(p50_s + 1e-5, 3) AS p50_s, round(p95_s + 1e-5, 3) AS p95_s, n_obs, round(long_share + 1e-5, 3) AS long_share, round(threshold_s + 1e-5, 3) AS threshold_s, n_min FROM cad")
def cadence_stats(spark, d):
    return rounded(quality.cadence(_kin(spark, d), scale=SCALE), 3, 1e-5)


@query(_CAD + """, kept AS (SELECT k.*, n_min FROM kin k LEFT JOIN cad USING (ssvid) WHERE dt_s IS NULL OR (dt_s > 0 AND dt_s < threshold_s)),
again AS (SELECT ping_id, n_min, (epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 1e6 AS dt_s, abs(course - lag(course) OVER w) AS dc FROM kept WINDOW w AS (PARTITION BY ssvid ORDER BY ts, ping_id))
SELECT ping_id, n_min, round(dt_s, 6) AS dt_s, round(coalesce(CASE WHEN dc > 180 THEN 360 - dc ELSE dc END, 0), 6) AS turn_deg FROM again""")
def cadence_filter_recompute(spark, d):
    return rounded(quality.cadence_filtered(_kin(spark, d), scale=SCALE).select("ping_id", "n_min", "dt_s", "turn_deg"))


@query(f"WITH {a.PINGS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY ssvid ORDER BY (ping_id * 7919 + 104729) % 1000003, ping_id) AS k, count(*) OVER (PARTITION BY ssvid) AS n, count(*) OVER () AS total FROM pings) SELECT ping_id, ssvid FROM r WHERE k <= least(n, ceil(500 * n::DOUBLE / total))")
def stratified_sample(spark, d):
    return quality.stratified(a.pings(spark, d), "ssvid", 500).select("ping_id", "ssvid")


_NORM = _KIN + """, sc AS (SELECT quantile_cont(abs(accel_ms2), 0.95) AS qa, quantile_cont(turn_deg, 0.95) AS qt FROM kin),
norm AS (SELECT k.*, least(greatest(abs(accel_ms2) / qa, 0), 1) AS norm_acc, least(greatest(turn_deg / qt, 0), 1) AS norm_turn, least(greatest(1 - turn_deg / qt, 0), 1) AS norm_course, CASE WHEN speed BETWEEN 1 AND 3.5e0 THEN 1 ELSE 0 END AS in_range, exp(-pow(speed - 2.25e0, 2) / 2) AS kernel FROM kin k, sc)"""


def _norm(spark, d, by_vessel=False):
    rows = _kin(spark, d, by_vessel)
    return behaviour.normed(rows, *behaviour.scales(rows))


@query(_NORM + " SELECT ping_id, round(norm_acc, 6) AS norm_acc, round(norm_turn, 6) AS norm_turn, round(norm_course, 6) AS norm_course, in_range, round(kernel, 6) AS kernel FROM norm")
def norm_features(spark, d):
    return rounded(_norm(spark, d).select("ping_id", "norm_acc", "norm_turn", "norm_course", "in_range", "kernel"))


@query(_CAD + ", j AS (SELECT * FROM kin LEFT JOIN cad USING (ssvid)) SELECT count(*) AS n_all, count(*) FILTER (WHERE speed <= 20) AS n_speed, count(*) FILTER (WHERE speed <= 20 AND (dt_s IS NULL OR (dt_s > 0 AND dt_s < threshold_s))) AS n_cadence FROM j")
def filter_budget(spark, d):
    rows = _kin(spark, d)
    stats = quality.cadence(rows, scale=SCALE).select("ssvid", "threshold_s")
    fast = F.col("speed") <= 20
    steady = F.col("dt_s").isNull() | ((F.col("dt_s") > 0) & (F.col("dt_s") < F.col("threshold_s")))
    return rows.join(stats, "ssvid", "left").agg(F.count("*").alias("n_all"), F.count(F.when(fast, 1)).alias("n_speed"), F.count(F.when(fast & steady, 1)).alias("n_cadence"))


#: Fixed mixture of the queries that need no fit: weights, means and covariances over speed, acceleration, turning.
MIXTURE = behaviour.Mixture(4, [0.3, 0.3, 0.25, 0.15], [[2.0, 0.3, 0.4], [5.0, 0.4, 0.5], [10.0, 0.5, 0.5], [15.0, 0.5, 0.6]], [[[v, 0.0, 0.0], [0.0, 0.05, 0.0], [0.0, 0.0, 0.08]] for v in (1.5, 2.5, 4.0, 6.0)], 0.0)
_STOPPED = "coalesce(speed < 1 OR dt_s > 30000, false)"


def _dens(i: int) -> str:
    w, m, c = MIXTURE.weights[i], MIXTURE.means[i], [MIXTURE.covariances[i][k][k] for k in range(3)]
    x = ("speed", "norm_acc", "norm_turn")
    square = " + ".join(f"pow({x[k]} - {m[k]}e0, 2) / {c[k]}e0" for k in range(3))
    return f"{w}e0 * exp(-0.5e0 * ({square})) / sqrt(pow(2 * pi(), 3) * {c[0]}e0 * {c[1]}e0 * {c[2]}e0)"


_POST = _NORM + f""", dens AS (SELECT *, {_STOPPED} AS st, {', '.join(f'{_dens(i)} AS d{i}' for i in range(4))} FROM norm),
post AS (SELECT *, CASE WHEN st THEN 1e0 ELSE 0e0 END AS p1, {', '.join(f'CASE WHEN NOT st AND speed BETWEEN 0.5e0 AND 20e0 AND d0 + d1 + d2 + d3 > 0 THEN d{i} / (d0 + d1 + d2 + d3) ELSE 0e0 END AS p{i + 2}' for i in range(4))} FROM dens),
lab AS (SELECT *, CASE WHEN p1 >= greatest(p2, p3, p4, p5) THEN 'stops' WHEN p2 >= greatest(p3, p4, p5) THEN 'dredging' WHEN p3 >= greatest(p4, p5) THEN 'slow_maneuvers' WHEN p4 >= p5 THEN 'loaded_transit' ELSE 'unloaded_transit' END AS behaviour FROM post)"""


def _scorable(spark, d, by_vessel=False):
    rows = _norm(spark, d, by_vessel).withColumn("is_stop_spatial", kinematics.stop_flag(F.col("speed"), F.col("dt_s"), 1.0, 300.0 * SCALE))
    return behaviour.posterior(rows, MIXTURE)


def _labelled(spark, d):
    return behaviour.labelled(_scorable(spark, d), behaviour.name_components([m[0] for m in MIXTURE.means]))


@query(_POST + " SELECT ping_id, round(p1, 6) AS p1, round(p2, 6) AS p2, round(p3, 6) AS p3, round(p4, 6) AS p4, round(p5, 6) AS p5, behaviour FROM lab")
def gmm_posterior_fixed(spark, d):
    return rounded(_labelled(spark, d).select("ping_id", *(F.col("p")[i].alias(f"p{i + 1}") for i in range(5)), "behaviour"))


_ONE = [f"{w}e0 * exp(-0.5e0 * pow((speed - {m[0]}e0) / sqrt({c[0][0]}e0), 2)) / sqrt({c[0][0]}e0)" for w, m, c in zip(MIXTURE.weights, MIXTURE.means, MIXTURE.covariances, strict=True)]


@query(f"WITH {a.PINGS_SQL}, d AS (SELECT speed, [{', '.join(_ONE)}] AS d FROM pings WHERE speed IS NOT NULL), o AS (SELECT speed, list_position(d, list_max(d)) AS component FROM d) SELECT CAST(component AS BIGINT) AS component, count(*) AS n, round(avg(speed) + 1e-9, 6) AS mean, round(stddev_samp(speed) + 1e-9, 6) AS sd, round(min(speed) + 1e-9, 6) AS least, round(max(speed) + 1e-9, 6) AS most, round(count(*) / sum(count(*)) OVER () + 1e-9, 6) AS share FROM o GROUP BY component")
def speed_components(spark, d):
    one = behaviour.Mixture(MIXTURE.k, MIXTURE.weights, [m[:1] for m in MIXTURE.means], [[c[0][:1]] for c in MIXTURE.covariances], 0.0)
    return rounded(behaviour.component_summary(a.pings(spark, d), one), nudge=1e-9)


_NUMBERED = _POST + """, st AS (SELECT *, CASE WHEN behaviour IS DISTINCT FROM lag(behaviour) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS s FROM lab WINDOW w AS (PARTITION BY ssvid ORDER BY ts, ping_id)),
nu AS (SELECT *, sum(s) OVER (PARTITION BY ssvid ORDER BY ts, ping_id) AS run FROM st)"""


@query(_NUMBERED + """
SELECT CAST(ssvid AS VARCHAR) AS seg_id, CAST(run AS BIGINT) AS run, any_value(behaviour) AS label, count(*) AS length, round(avg(speed), 6) AS mean_speed, arg_min(ping_id, ts) AS first_ping, arg_max(ping_id, ts) AS last_ping FROM nu GROUP BY ssvid, run""")
def runs_gaps_islands(spark, d):
    return rounded(behaviour.runs(_labelled(spark, d)))


@query(_CAD + " SELECT quantile_cont(n_min, 0.75) AS least_length FROM kin LEFT JOIN cad USING (ssvid)")
def least_run_length(spark, d):
    rows = _kin(spark, d)
    return rows.join(quality.cadence(rows, scale=SCALE).select("ssvid", "n_min"), "ssvid", "left").agg(F.percentile("n_min", F.lit(0.75)).alias("least_length"))


def _cost(a: str, b: str) -> str:
    return f"CASE WHEN {a} = {b} THEN 0 WHEN 'dredging' IN ({a}, {b}) THEN {behaviour.DREDGE_COST} WHEN 'stops' IN ({a}, {b}) THEN {behaviour.STOP_COST} ELSE {behaviour.OTHER_COST} END"


@query(_NUMBERED.replace("WITH ", "WITH RECURSIVE ", 1) + _RHYTHM + f""", lim AS (SELECT quantile_cont(n_min, 0.75) AS least FROM kin LEFT JOIN cad USING (ssvid) WHERE dt_s IS NULL OR (dt_s > 0 AND dt_s < threshold_s)),
ru AS (SELECT ssvid, run, any_value(behaviour) AS label, count(*) AS length, avg(speed) AS v FROM nu GROUP BY 1, 2),
nx AS (SELECT *, lead(label) OVER (PARTITION BY ssvid ORDER BY run) AS nxt, length >= least OR NOT v <= 3.5e0 AS stays FROM ru, lim),
sm AS (SELECT ssvid, run, CASE WHEN stays THEN label ELSE nxt END AS name FROM nx WHERE run = 1 UNION ALL
 SELECT n.ssvid, n.run, CASE WHEN stays THEN n.label WHEN s.name IS NOT NULL AND (n.nxt IS NULL OR {_cost('s.name', 'n.label')} < {_cost('n.nxt', 'n.label')}) THEN s.name ELSE n.nxt END FROM sm s JOIN nx n ON n.ssvid = s.ssvid AND n.run = s.run + 1)
SELECT ping_id, CAST(ssvid AS VARCHAR) AS seg_id, behaviour, coalesce(name, 'unknown') AS behaviour_smooth, CAST(name IS NOT DISTINCT FROM 'dredging' AS INTEGER) AS is_dredging FROM nu JOIN sm USING (ssvid, run)""")
def smoothed_labels(spark, d):
    least = behaviour.least_length(quality.cadence_filtered(_kin(spark, d), scale=SCALE))
    return behaviour.smoothed(_labelled(spark, d).select("ping_id", "seg_id", "ts", "speed", "behaviour"), least).drop("ts", "speed")


@query(f"WITH {a.SHIP_DAYS_SQL} SELECT DISTINCT year(day) AS year, dense_rank() OVER (ORDER BY year(day)) AS fold FROM ship_days")
def fold_ids(spark, d):
    return score.year_folds(a.ship_days(spark, d).select(F.year("day").cast("long").alias("year"))).distinct()


@query(_POST + ", f AS (SELECT *, (ping_id % 5) + 1 AS fold FROM lab) SELECT fold, count(*) FILTER (WHERE behaviour = 'dredging') AS dredging, count(*) FILTER (WHERE behaviour <> 'dredging') AS other FROM f GROUP BY fold")
def class_by_fold(spark, d):
    rows = _labelled(spark, d).select((F.col("ping_id") % 5 + 1).alias("fold"), F.when(F.col("behaviour") == "dredging", "dredging").otherwise("other").alias("c"))
    return rows.groupBy("fold").pivot("c", ["dredging", "other"]).agg(F.count(F.lit(1))).na.fill(0)


@query()
def gmm_fit_bic(spark, d):
    rows = _norm(spark, d).where(behaviour.trainable())
    m = behaviour.fit_mixture(rows, rows=None)
    names = behaviour.name_components([x[0] for x in m.means])
    return spark.createDataFrame([(m.k, i + 1, names[i], float(m.weights[i]), float(m.means[i][0]), float(m.bic)) for i in range(m.k)], "k int, component int, name string, weight double, mean_speed double, bic double")


@query()
def isolation_forest(spark, d):
    return iforest.outliers(_kin(spark, d)).select("ping_id", "ssvid", "is_outlier")


#: Radius by the vessel-year's own distances, pairs within it, core points, their components, border points.
_DENSITY = _KIN.replace("WITH ", "WITH RECURSIVE ", 1) + f""", pt AS (SELECT *, coalesce(speed < 1 OR dt_s > 30000, false) AS is_stop, year(ts) AS yr FROM kin),
st AS (SELECT ssvid, yr, ping_id, lon, lat FROM pt WHERE is_stop AND lon IS NOT NULL AND lat IS NOT NULL),
fit AS (SELECT ssvid, yr, count(*) AS n FROM st GROUP BY 1, 2 HAVING count(*) >= {stops.MIN_POINTS} AND var_samp(lon) >= 1e-8 AND var_samp(lat) >= 1e-8),
pr AS (SELECT a.ssvid, a.yr, n, a.ping_id AS i, b.ping_id AS j, pow(a.lon - b.lon, 2) + pow(a.lat - b.lat, 2) AS sq,
 pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2) AS h FROM st a JOIN fit USING (ssvid, yr) JOIN st b USING (ssvid, yr)),
kth AS (SELECT ssvid, yr, i, list_sort(list({2 * stops.EQUATOR_M}e0 * asin(sqrt(least(h, 1e0)))))[least({stops.MIN_POINTS}, any_value(n) - 1) + 1] AS d FROM pr GROUP BY 1, 2, 3),
ep AS (SELECT ssvid, yr, greatest(200e0, 0.01e0 * median(d)) / 111000e0 AS eps FROM kth GROUP BY 1, 2),
dn AS (SELECT ssvid, yr, i, eps, count(*) FILTER (WHERE sq <= eps * eps) AS n1 FROM pr JOIN ep USING (ssvid, yr) GROUP BY 1, 2, 3, 4),
ef AS (SELECT ssvid, yr, CASE WHEN max(n1) >= {stops.MIN_POINTS} THEN 1e0 ELSE 1.5e0 END * any_value(eps) AS e FROM dn GROUP BY 1, 2),
ln AS (SELECT ssvid, yr, i, j FROM pr JOIN ef USING (ssvid, yr) WHERE sq <= e * e),
co AS (SELECT ssvid, yr, i FROM ln GROUP BY 1, 2, 3 HAVING count(*) >= {stops.MIN_POINTS}),
rc AS (SELECT ssvid, yr, i AS r, i AS k FROM co UNION SELECT rc.ssvid, rc.yr, r, j FROM rc JOIN ln ON ln.i = rc.k JOIN co ON co.i = ln.j),
ow AS (SELECT ssvid, yr, k, min(r) AS r FROM rc GROUP BY 1, 2, 3),
cl AS (SELECT k, dense_rank() OVER (PARTITION BY ssvid, yr ORDER BY r) AS c FROM ow),
lb AS (SELECT i, min(c) AS c FROM ln JOIN cl ON cl.k = ln.j WHERE i = j OR i NOT IN (SELECT i FROM co) GROUP BY 1),
res AS (SELECT ping_id, ssvid, is_stop, CASE WHEN st.ping_id IS NOT NULL THEN coalesce(c, 0) END AS stop_cluster FROM pt LEFT JOIN (SELECT ping_id FROM st) st USING (ping_id) LEFT JOIN lb ON lb.i = pt.ping_id)"""


@query(_DENSITY + " SELECT *, coalesce(stop_cluster > 0, false) AS is_stop_spatial FROM res")
def dbscan_stops(spark, d):
    rows = _kin(spark, d).withColumn("is_stop", kinematics.stop_flag(F.col("speed"), F.col("dt_s"), 1.0, 300.0 * SCALE))
    return stops.spatial_stops(rows).select("ping_id", "ssvid", "is_stop", "stop_cluster", "is_stop_spatial")


@query()
def ridge_loyo(spark, d):
    """The driver's events are of one month: six days stand for a year, as times are SCALE times as far apart."""
    rows = score.year_folds(_labelled(spark, d).withColumn("year", F.floor((F.dayofmonth("ts") - 1) / 6))).withColumn("p_dredge", F.col("p")[1]).withColumn("is_dredging", (F.col("behaviour") == "dredging").cast("int"))
    m = score.fit_ridge(rows, positives=10, negatives=50)
    return spark.createDataFrame([(int(f), v, m.mean) for f, v in m.folds.items()], "fold int, auc double, mean_auc double")


RIDGE = score.Ridge([2.0, 0.5, -0.5, 1.0, 1.5], -2.0)


@query(_POST + " SELECT ping_id, round(1 / (1 + exp(2e0 - 2e0 * p2 - 0.5e0 * norm_course + 0.5e0 * norm_acc - 1e0 * in_range - 1.5e0 * kernel)), 6) AS drag_score FROM lab")
def ridge_score_fixed(spark, d):
    return rounded(_labelled(spark, d).withColumn("p_dredge", F.col("p")[1]).select("ping_id", score.score(RIDGE).alias("drag_score")))


@query("""WITH s AS (SELECT (doc_id * 7919 % 997) / 997e0 AS threshold, CAST(quality AS BIGINT) AS y FROM labels WHERE quality IS NOT NULL),
b AS (SELECT threshold, sum(y) AS pos, count(*) - sum(y) AS neg FROM s GROUP BY 1),
r AS (SELECT threshold, sum(pos) OVER w / (sum(pos) OVER ())::DOUBLE AS tpr, sum(neg) OVER w / (sum(neg) OVER ())::DOUBLE AS fpr FROM b WINDOW w AS (ORDER BY threshold DESC))
SELECT round(threshold, 6) AS threshold, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr, round(tpr - fpr, 6) AS youden FROM r""")
def roc_youden(spark, d):
    rows = a.table(spark, d, "labels").where("quality is not null").select((F.col("doc_id") * 7919 % 997 / F.lit(997.0)).alias("s"), F.col("quality").cast("long").alias("y"))
    return rounded(score.roc(rows, "s", "y"))


#: Every ping with every sample: no cut by distance.
_NEAR = f"""WITH {a.PINGS_SQL}, {a.SEABED_SQL},
m AS (SELECT ping_id, min({{'d2': (p.lon - s.lon) * (p.lon - s.lon) + (p.lat - s.lat) * (p.lat - s.lat), 'seabed_id': seabed_id}}) AS k FROM pings p, seabed s GROUP BY ping_id),
b AS (SELECT ping_id, s.lon AS s_lon, s.lat AS s_lat, s.seabed_id, lithology, pl_base FROM m JOIN seabed s ON s.seabed_id = k.seabed_id),
near AS (SELECT p.ping_id, p.lon, p.lat, p.ts, seabed_id, lithology, pl_base, CASE WHEN seabed_id IS NOT NULL THEN {_hav('p.lat', 'p.lon', 's_lat', 's_lon')} * 1852e0 / 6371000e0 * 6378137e0 / 1000 END AS dist_km FROM pings p LEFT JOIN b ON b.ping_id = p.ping_id)"""


def _near(spark, d):
    return seabed.nearest(a.pings(spark, d), a.seabed(spark, d))


@query(_NEAR + " SELECT ping_id, seabed_id, lithology, round(dist_km, 4) AS dist_km FROM near")
def nearest_seabed(spark, d):
    return rounded(_near(spark, d).select("ping_id", "seabed_id", "lithology", "dist_km"), 4)


@query(_NEAR + " SELECT ping_id FROM near WHERE NOT coalesce(dist_km <= 10, false)")
def seabed_rejects(spark, d):
    return seabed.split(_near(spark, d))[1].select("ping_id")


@query(_NEAR + " SELECT lithology, count(*) AS n FROM near WHERE dist_km <= 10 GROUP BY 1")
def lithology_counts(spark, d):
    return seabed.split(_near(spark, d))[0].groupBy("lithology").agg(F.count("*").alias("n"))


@query(_NEAR + " SELECT p.ping_id, p.ssvid, n.lithology, n.pl_base FROM pings p LEFT JOIN (SELECT * FROM near WHERE dist_km <= 10) n ON n.ping_id = p.ping_id")
def pings_with_lithology(spark, d):
    pings = a.pings(spark, d)
    repeated = seabed.repeated_ids(pings)
    near = seabed.nearest(pings, a.seabed(spark, d), repeated=repeated)
    if not repeated:
        return near.select("ping_id", "ssvid", *(F.when(seabed.near_enough(), F.col(c)).alias(c) for c in ("lithology", "pl_base")))
    kept = seabed.split(near)[0].select("ping_id", "lithology", "pl_base")
    return pings.select("ping_id", "ssvid").join(kept, "ping_id", "left")


@query(f"SELECT n_nationkey, CASE n_nationkey % 8 WHEN 0 THEN 0.275e0 WHEN 1 THEN 16.8e0 WHEN 2 THEN 4.76e0 WHEN 3 THEN 12.3e0 WHEN 4 THEN 1.67e0 ELSE 1e0 END AS k_fast, CASE WHEN n_nationkey % 2 = 0 THEN CAST(n_nationkey AS INT) END AS tile FROM nation")
def basin_rates(spark, d):
    k = F.col("n_nationkey")
    basin = F.element_at(F.array(*map(F.lit, ("Arctic", "Gulf", "Indian", "Mediterranean", "Pacific", "Atlantic", "Southern", "Baltic"))), (k % 8 + 1).cast("int"))
    path = F.when(k % 2 == 0, F.concat(F.lit("out/tile_"), F.lpad(k.cast("string"), 4, "0"), F.lit(".parquet"))).otherwise("out/tile_x.parquet")
    return a.table(spark, d, "nation").select("n_nationkey", impact.basin_rate(basin).alias("k_fast"), tile_of(path).alias("tile"))


_PROJ_X = f"({g.SEMI_MAJOR * g.K0!r}e0 * radians(lon))"
_SIN = "sin(radians(lat))"
_PROJ_Y = f"({g.SEMI_MAJOR / (2 * g.K0)!r}e0 * {1 - g.E2!r}e0 * ({_SIN} / (1 - {g.E2!r}e0 * {_SIN} * {_SIN}) - {1 / (2 * g.ECC)!r}e0 * ln((1 - {g.ECC!r}e0 * {_SIN}) / (1 + {g.ECC!r}e0 * {_SIN}))))"
_XY = f"xy AS (SELECT *, {_PROJ_X} AS x, {_PROJ_Y} AS y FROM pings), cell AS (SELECT *, CAST(floor((x - ({g.XMIN!r}e0)) / 1000e0) AS BIGINT) AS col, CAST(floor((y - ({g.YMIN!r}e0)) / 1000e0) AS BIGINT) AS row FROM xy), snap AS (SELECT *, CASE WHEN row BETWEEN 0 AND {g.ROWS - 1} AND col BETWEEN 0 AND {g.COLS - 1} THEN row * {g.COLS} + col + 1 END AS grid_id FROM cell)"
_GRID = f"WITH {a.PINGS_SQL}, {a.SPECS_SQL}, {a.SEABED_SQL}, {a.PROVINCES_SQL}, {_XY}"


def _snapped(spark, d):
    return grid.snapped(grid.projected(a.pings(spark, d)))


@query(_GRID + " SELECT ping_id, round(x, 3) AS x, round(y, 3) AS y, col, row, grid_id FROM snap")
def snap_grid(spark, d):
    return rounded(_snapped(spark, d).select("ping_id", "x", "y", "col", "row", "grid_id"), 3)


@query(_GRID + f" SELECT DISTINCT grid_id, (grid_id - 1) % {g.COLS} AS col, (grid_id - 1) // {g.COLS} AS row, round({g.XMIN!r}e0 + ((grid_id - 1) % {g.COLS} + 0.5e0) * 1000e0, 3) AS x, round({g.YMIN!r}e0 + ((grid_id - 1) // {g.COLS} + 0.5e0) * 1000e0, 3) AS y FROM snap")
def decode_grid(spark, d):
    return rounded(grid.decoded(_snapped(spark, d).select("grid_id").distinct()), 3)


_SEG = _GRID + """, sp AS (SELECT s.*, dredge_width_m, dredging_depth_m FROM snap s LEFT JOIN specs USING (ssvid)),
seg AS (SELECT ssvid, strftime(ts, '%Y%m%d') AS day, first_value(dredge_width_m) OVER w AS width_m, first_value(dredging_depth_m) OVER w AS depth_m, lag(x) OVER w AS x0, lag(y) OVER w AS y0, x AS x1, y AS y1 FROM sp WINDOW w AS (PARTITION BY ssvid, strftime(ts, '%Y%m%d') ORDER BY ts, ping_id)),
segs AS (SELECT *, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) AS length_m FROM seg WHERE x0 IS NOT NULL)"""


def _segments(spark, d):
    return grid.daily_segments(grid.projected(fleet.with_specs(a.pings(spark, d, by_vessel=True), a.specs(spark, d))))


@query(_SEG + " SELECT ssvid, day, count(*) AS segments, round(sum(length_m), 3) AS length_m, round(any_value(width_m), 6) AS width_m FROM segs GROUP BY ssvid, day")
def daily_tracks(spark, d):
    return rounded(grid.daily_tracks(_segments(spark, d)), length_m=3)


_SAR = _SEG + f""", uv AS (SELECT *, (x0 - ({g.XMIN!r}e0)) / 1000e0 AS u0, (x1 - ({g.XMIN!r}e0)) / 1000e0 AS u1, (y0 - ({g.YMIN!r}e0)) / 1000e0 AS v0, (y1 - ({g.YMIN!r}e0)) / 1000e0 AS v1, row_number() OVER () AS k FROM segs WHERE length_m > 0),
ts AS (SELECT DISTINCT k, t FROM (SELECT k, 0e0 AS t FROM uv UNION ALL SELECT k, 1e0 FROM uv
 UNION ALL SELECT k, (c - u0) / (u1 - u0) FROM (SELECT *, unnest(range(CAST(floor(least(u0, u1)) AS BIGINT) + 1, CAST(ceil(greatest(u0, u1)) AS BIGINT))) AS c FROM uv)
 UNION ALL SELECT k, (c - v0) / (v1 - v0) FROM (SELECT *, unnest(range(CAST(floor(least(v0, v1)) AS BIGINT) + 1, CAST(ceil(greatest(v0, v1)) AS BIGINT))) AS c FROM uv))),
pr AS (SELECT k, t AS ta, lead(t) OVER (PARTITION BY k ORDER BY t) AS tb FROM ts),
piece AS (SELECT CAST(floor(v0 + (ta + tb) / 2 * (v1 - v0)) AS BIGINT) * {g.COLS} + CAST(floor(u0 + (ta + tb) / 2 * (u1 - u0)) AS BIGINT) + 1 AS grid_id, (tb - ta) * length_m AS len, width_m, depth_m FROM pr JOIN uv USING (k) WHERE tb IS NOT NULL),
agg AS (SELECT grid_id, sum(len * width_m) AS sum_dw, sum(len * width_m * depth_m) AS sum_dw_pd, sum(len) AS sum_d FROM piece GROUP BY 1),
sar AS (SELECT *, sum_dw / 1e6 AS sar, CASE WHEN sum_dw = 0 THEN 0 ELSE sum_dw_pd / sum_dw END AS p_d, sum_dw / 1e6 * CASE WHEN sum_dw = 0 THEN 0 ELSE sum_dw_pd / sum_dw END AS svr FROM agg)"""


def _swept(spark, d):
    return grid.swept_ratio(grid.swept(_segments(spark, d)))


@query(_SAR + " SELECT grid_id, round(sum_dw, 2) AS sum_dw, round(sum_d, 2) AS sum_d, round(sar, 6) AS sar, round(p_d, 6) AS p_d, round(svr, 6) AS svr FROM sar")
def sar_grid(spark, d):
    return rounded(_swept(spark, d).select("grid_id", "sum_dw", "sum_d", "sar", "p_d", "svr"), sum_dw=2, sum_d=2)


_PL = _NEAR.replace("WITH ", "WITH ", 1) + f", {_XY}, pl AS (SELECT s.grid_id, n.dist_km, n.pl_base * 0.65e0 AS pl_eff FROM snap s JOIN near n ON n.ping_id = s.ping_id)"


def _ping_pl(spark, d):
    return grid.snapped(grid.projected(_near(spark, d))).withColumn("pl_eff", F.col("pl_base") * 0.65)


@query(_PL + ", u AS (SELECT grid_id, count(*) FILTER (WHERE pl_eff IS NOT NULL AND (dist_km IS NULL OR dist_km <= 10)) AS n_with_pl, sum(pl_eff) FILTER (WHERE dist_km IS NULL OR dist_km <= 10) AS pl_sum FROM pl WHERE grid_id IS NOT NULL GROUP BY 1) SELECT grid_id, n_with_pl, round(pl_sum, 6) AS pl_sum, round(CASE WHEN n_with_pl > 0 THEN pl_sum / n_with_pl END, 6) AS p_l FROM u")
def pl_cell_mean(spark, d):
    return rounded(grid.lability(_ping_pl(spark, d)))


@query(_GRID + " SELECT grid_id, count(DISTINCT year(ts)) AS years_trawled FROM snap WHERE grid_id IS NOT NULL GROUP BY 1")
def duration_years(spark, d):
    return grid.duration_years(_snapped(spark, d))


@query(_GRID + " SELECT ping_id, province FROM pings p LEFT JOIN provinces r ON p.lon >= r.lon0 AND p.lon < r.lon1 AND p.lat >= r.lat0 AND p.lat < r.lat1")
def province_join(spark, d):
    return provinces.in_rectangles(a.pings(spark, d), a.provinces(spark, d)).select("ping_id", "province")


_LON = f"degrees((({g.XMIN!r}e0) + ((grid_id - 1) % {g.COLS} + 0.5e0) * 1000e0) / {g.SEMI_MAJOR * g.K0!r}e0)"
_BETA = f"asin((({g.YMIN!r}e0) + ((grid_id - 1) // {g.COLS} + 0.5e0) * 1000e0) * {2 * g.K0 / g.SEMI_MAJOR / g.Q_POLE!r})"
_CENTRES = f"""ctr AS (SELECT *, {_LON} AS lon, degrees(beta + {g.AUTHALIC[0]!r} * sin(2 * beta) + {g.AUTHALIC[1]!r} * sin(4 * beta) + {g.AUTHALIC[2]!r} * sin(6 * beta)) AS lat FROM (SELECT *, {_BETA} AS beta FROM sar))"""
#: Swept cells with their pings' lability, their periods with pings (two days stand for a year) and their province's rates.
_CELLS = _SAR + ", " + _NEAR[_NEAR.index("m AS (SELECT ping_id") :] + f""", {_CENTRES},
usable AS (SELECT s.grid_id, avg(n.pl_base * 0.65e0) FILTER (WHERE n.dist_km IS NULL OR n.dist_km <= 10) AS p_l FROM snap s JOIN near n ON n.ping_id = s.ping_id WHERE s.grid_id IS NOT NULL GROUP BY 1),
dur AS (SELECT grid_id, count(DISTINCT dayofyear(ts) // 2) AS years_trawled FROM snap WHERE grid_id IS NOT NULL GROUP BY 1),
ce AS (SELECT c.*, p_l, years_trawled, province, k_fast, fresh_fact FROM ctr c LEFT JOIN usable u ON u.grid_id = c.grid_id LEFT JOIN dur y ON y.grid_id = c.grid_id LEFT JOIN provinces r ON c.lon >= r.lon0 AND c.lon < r.lon1 AND c.lat >= r.lat0 AND c.lat < r.lat1)"""


def _cells(spark, d):
    """The chain up to the index: swept area, joined with lability, history and the centre's province."""
    lability = grid.lability(_ping_pl(spark, d)).select("grid_id", "p_l")
    history = grid.duration_years(_snapped(spark, d), F.floor(F.dayofyear("ts") / 2))
    cells = grid.located(_swept(spark, d).join(lability, "grid_id", "left").join(history, "grid_id", "left"))
    return provinces.in_rectangles(cells, a.provinces(spark, d))


@query(_CELLS + " SELECT grid_id, round(lon, 6) AS lon, round(lat, 6) AS lat, province, round(p_l, 6) AS p_l, years_trawled, k_fast FROM ce")
def cell_facts(spark, d):
    return rounded(_cells(spark, d).select("grid_id", "lon", "lat", "province", "p_l", "years_trawled", "k_fast"))


def _fi_sql(name: str) -> str:
    s = impact.resolve(name)
    f = lambda k, slow, pl: f"CASE WHEN p_l_corr IS NOT NULL AND svr IS NOT NULL THEN least(greatest(svr * {pl} * {s.preservation_factor}e0 * ({s.fast_fraction}e0 * (1 - exp(-k_used * {k}e0)) + {1 - s.fast_fraction}e0 * (1 - exp({-slow}e0))), 0), 1) END"
    return _CELLS + f""", e1 AS (SELECT *, CASE WHEN p_d > 0 THEN (least(p_d, 0.05e0) * p_l + greatest(p_d - 0.05e0, 0) * {s.alpha_dep}e0 * p_l) / p_d END AS p_l_eff, k_fast IS NULL AS k_fallback, coalesce(k_fast, 1.67e0) AS k_used FROM ce),
e2 AS (SELECT *, CASE WHEN p_l_eff IS NOT NULL THEN least(greatest(p_l_eff * coalesce(fresh_fact, 1), 0), 1) END AS p_l_corr FROM e1),
fi AS (SELECT *, {f(s.k_fast_multiplier, s.slow_k, 'p_l_corr')} AS f_i_full, {f(s.k_fast_multiplier / 2, s.slow_k / 2, '(p_l_corr / 2)')} AS f_i_conservative FROM e2)"""


def _fi(spark, d, name):
    return impact.indexed(_cells(spark, d), impact.resolve(name), 1.67)


_FI_OUT = " SELECT grid_id, round(p_l_eff + 2e-9, 6) AS p_l_eff, round(p_l_corr + 2e-9, 6) AS p_l_corr, k_used, round(f_i_full + 2e-9, 6) AS f_i_full, round(f_i_conservative + 2e-9, 6) AS f_i_conservative FROM fi"


def _fi_out(df):
    return rounded(df.select("grid_id", "p_l_eff", "p_l_corr", "k_used", "f_i_full", "f_i_conservative"), 6, 2e-9)


@query(_fi_sql("default") + _FI_OUT)
def fi_default(spark, d):
    return _fi_out(_fi(spark, d, "default"))


@query(_fi_sql("conservative") + _FI_OUT)
def fi_conservative(spark, d):
    return _fi_out(_fi(spark, d, "conservative"))


@query(_fi_sql("upper_bound") + _FI_OUT)
def fi_upper_bound(spark, d):
    return _fi_out(_fi(spark, d, "upper_bound"))


@query(_CELLS + " SELECT grid_id, CASE WHEN p_l IS NOT NULL AND svr IS NOT NULL THEN round(least(svr * p_l * 0.87e0 * (0.3e0 * (1 - exp(-4.76e0)) + 0.7e0 * (1 - exp(-0.05e0))), 1), 6) END AS f_i, CASE WHEN p_l IS NOT NULL AND svr IS NOT NULL THEN round(least(svr * p_l * 0.87e0 * (0.3e0 * (1 - exp(-0.952e0)) + 0.7e0 * (1 - exp(-0.05e0))), 1), 6) END AS f_i_reduced FROM ce")
def fi_reduced(spark, d):
    return rounded(impact.reduced(_cells(spark, d)).select("grid_id", "f_i", "f_i_reduced"))


@query(_fi_sql("default") + " SELECT count(*) AS cells, round(avg(CASE WHEN k_fallback THEN 1e0 ELSE 0e0 END), 6) AS k_fallback, round(avg(CASE WHEN svr = 0 THEN 1e0 ELSE 0e0 END), 6) AS svr_zero, round(avg(CASE WHEN p_l_eff = 0 THEN 1e0 ELSE 0e0 END), 6) AS p_l_zero, round(avg(CASE WHEN f_i_full IS NULL THEN 1e0 ELSE 0e0 END), 6) AS f_i_null FROM fi")
def fallback_stats(spark, d):
    return rounded(impact.fallback_stats(_fi(spark, d, "default")))


@query(_fi_sql("default") + ", every AS (SELECT grid_id FROM sar UNION SELECT grid_id FROM snap WHERE grid_id IS NOT NULL) SELECT e.grid_id, round(coalesce(f_i_full, 0), 6) AS f_i_full, round(coalesce(svr, 0), 6) AS svr FROM every e LEFT JOIN fi ON fi.grid_id = e.grid_id")
def cells_completed(spark, d):
    """The swept cells are the index's own; only those with pings are looked up beside it."""
    every = _snapped(spark, d).where("grid_id is not null").select("grid_id")
    return rounded(grid.completed(_fi(spark, d, "default"), every, ["f_i_full", "svr"]))


@query(_fi_sql("default") + " SELECT floor(lon / 5e0) * 5e0 AS lon_bin, floor(lat / 5e0) * 5e0 AS lat_bin, count(*) AS cells, round(sum(f_i_full), 5) AS total, round(avg(f_i_full), 5) AS mean FROM fi GROUP BY ALL")
def map_bins(spark, d):
    return rounded(grid.binned(_fi(spark, d, "default"), "f_i_full", 5.0), 5)


_CARBON = f""", de AS (SELECT *, (grid_id - 1) % {g.COLS} AS col, (grid_id - 1) // {g.COLS} AS row FROM fi),
ra AS (SELECT p_partkey % {g.ROWS} AS row, max(p_retailprice) AS c0 FROM part GROUP BY 1),
sa AS (SELECT d.*, coalesce(c0, 0) AS c0, coalesce(c0, 0) * 0.8e0 AS c0_lower, coalesce(c0, 0) * 1.2e0 AS c0_upper, CASE WHEN years_trawled > 1 THEN 0.272e0 ELSE 1e0 END AS di FROM de d LEFT JOIN ra ON ra.row = d.row)"""


def _stock(spark, d):
    cells = _fi(spark, d, "default")
    raster = a.table(spark, d, "part").groupBy((F.col("p_partkey") % g.ROWS).alias("row")).agg(F.max("p_retailprice").alias("c0"))
    out = impact.sampled(cells, raster, ["c0"], on=("row",))
    return out.withColumns({"c0_lower": F.col("c0") * 0.8, "c0_upper": F.col("c0") * 1.2, "di": impact.depletion(F.col("years_trawled"), after=1)})


@query(_fi_sql("default") + _CARBON + " SELECT grid_id, round(c0, 4) AS c0 FROM sa")
def raster_sample(spark, d):
    return rounded(_stock(spark, d).select("grid_id", "c0"), 4)


@query(_fi_sql("default") + _CARBON + " SELECT grid_id, di FROM sa")
def depletion(spark, d):
    return _stock(spark, d).select("grid_id", "di")


@query(_fi_sql("default") + _CARBON + " SELECT grid_id, round(least(c0, c0 * coalesce(f_i_full, 0) * di), 4) AS c_ri, round(least(c0_lower, c0_lower * coalesce(f_i_full, 0) * di), 4) AS c_ri_lower, round(least(c0_upper, c0_upper * coalesce(f_i_full, 0) * di), 4) AS c_ri_upper, round(least(c0, c0 * coalesce(f_i_conservative, 0) * di), 4) AS c_ri_conservative FROM sa")
def cri(spark, d):
    return rounded(impact.carbon(_stock(spark, d)).select("grid_id", "c_ri", "c_ri_lower", "c_ri_upper", "c_ri_conservative"), 4)


@query("SELECT event_id, user_id, '' AS event_type FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, -1, event_type FROM events WHERE event_id % 2 = 1")
def schema_union(spark, d):
    e = a.table(spark, d, "events")
    return e.where("event_id % 2 = 0").select("event_id", "user_id").unionByName(e.where("event_id % 2 = 1").select("event_id", "event_type"), allowMissingColumns=True).na.fill({"user_id": -1, "event_type": ""})
