"""From swept area to remineralised carbon: lability at depth, disturbance index, depletion, carbon at risk."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelgrid.functions.scalar import clamp, null_least

SURFACE_M = 0.05


@dataclass(frozen=True)
class Scenario:
    """Fixed values of the default scenario."""

    alpha_dep: float = 0.25
    fast_fraction: float = 0.3
    slow_k: float = 0.05
    preservation_factor: float = 0.87
    k_fast_multiplier: float = 1.0


SCENARIOS = {
    "default": {},
    "conservative": {"inherit": "default", "k_fast_multiplier": 0.5, "slow_k": 0.025},
    "upper_bound": {"inherit": "default", "alpha_dep": 1.0, "fast_fraction": 1.0, "slow_k": 0.0, "k_fast_multiplier": 1.0},
}


def merge(base: dict, over: dict) -> dict:
    """over on top of base, nested dictionaries too."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def resolve(name: str, scenarios: dict[str, dict] = SCENARIOS) -> Scenario:
    """The named scenario with what it inherits. An unknown name, an unknown key and a circle are errors."""
    chain, seen = [], set()
    while name:
        if name in seen or name not in scenarios:
            raise ValueError(f"scenario {name!r} is unknown or inherits from itself")
        seen.add(name)
        chain.append(scenarios[name])
        name = scenarios[name].get("inherit")
    merged: dict = {}
    for s in reversed(chain):
        merged = merge(merged, {k: v for k, v in s.items() if k != "inherit"})
    return Scenario(**merged)


def at_depth(p_l: Column, p_d: Column, alpha: float) -> Column:
    """Mean lability over the depth: whole in the upper 5 cm, `alpha` of it below; null where the depth is 0."""
    upper, lower = null_least(p_d, F.lit(SURFACE_M)), F.when(p_d > SURFACE_M, p_d - SURFACE_M).when(p_d.isNotNull(), 0.0)
    return F.when(p_d > 0, (upper * p_l + lower * F.lit(alpha) * p_l) / p_d)


def disturbance(svr: Column, p_l: Column, k: Column, s: Scenario, years: float = 1.0) -> Column:
    k = k * F.lit(s.k_fast_multiplier)
    share = F.lit(s.fast_fraction) * (1 - F.exp(-k * years)) + F.lit(1 - s.fast_fraction) * (1 - F.exp(F.lit(-s.slow_k * years)))
    return clamp(svr * p_l * F.lit(s.preservation_factor) * share)


def indexed(cells: DataFrame, s: Scenario, fallback_k: float, weigh: str = "cell", deep: float = 0.3) -> DataFrame:
    """From svr, p_l, p_d, k_fast and fresh_fact: p_l_eff, p_l_corr, k_used, k_fallback, f_i_full and f_i_conservative
    (half the lability and both rates). `weigh` says where depth lowers lability: at the `ping` (already in p_l), at the
    `cell`, or at `both`; the cell weighs by the scenario's alpha_dep."""
    if weigh not in ("ping", "cell", "both"):
        raise ValueError(weigh)
    out = cells.withColumn("p_l_eff", F.col("p_l") if weigh == "ping" else at_depth(F.col("p_l"), F.col("p_d"), s.alpha_dep))
    out = out.withColumn("p_l_corr", clamp(F.col("p_l_eff") * F.coalesce("fresh_fact", F.lit(1.0))))
    out = out.withColumn("k_fallback", F.col("k_fast").isNull()).withColumn("k_used", F.coalesce("k_fast", F.lit(fallback_k)))
    half = Scenario(s.alpha_dep, s.fast_fraction, s.slow_k / 2, s.preservation_factor, s.k_fast_multiplier / 2)
    return out.withColumn("f_i_full", disturbance(F.col("svr"), F.col("p_l_corr"), F.col("k_used"), s)).withColumn("f_i_conservative", disturbance(F.col("svr"), F.col("p_l_corr") / 2, F.col("k_used"), half))


def reduced(cells: DataFrame, k: float = 4.76) -> DataFrame:
    """The early variant: one k everywhere, and a fifth of it as the reduced case."""
    d = Scenario()
    return cells.withColumn("f_i", disturbance(F.col("svr"), F.col("p_l"), F.lit(k), d)).withColumn("f_i_reduced", disturbance(F.col("svr"), F.col("p_l"), F.lit(k / 5), d))


def fallback_stats(cells: DataFrame) -> DataFrame:
    share = lambda c: F.avg(F.coalesce(c.cast("int"), F.lit(0)))
    return cells.agg(F.count("*").alias("cells"), share(F.col("k_fallback")).alias("k_fallback"), share(F.col("svr") == 0).alias("svr_zero"), share(F.col("p_l_eff") == 0).alias("p_l_zero"), share(F.col("f_i_full").isNull()).alias("f_i_null"))


#: The fast rate of each ocean basin, and that of any other.
BASIN_RATES, OTHER_RATE = {"Arctic": 0.275, "Gulf": 16.8, "Indian": 4.76, "Mediterranean": 12.3, "Pacific": 1.67, "Atlantic": 1.0}, 1.0


def basin_rate(basin: Column) -> Column:
    out = F.lit(OTHER_RATE)
    for name, rate in BASIN_RATES.items():
        out = F.when(basin == name, F.lit(rate)).otherwise(out)
    return out


def sampled(cells: DataFrame, raster: DataFrame, columns: list[str], on: tuple[str, ...] = ("row", "col")) -> DataFrame:
    """A raster's values at the cells, by row and col (or fewer, where it varies along one alone); 0 where it has none."""
    return cells.join(raster, list(on), "left").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in columns})


def depletion(years: Column, after: int = 10, left: float = 0.272) -> Column:
    return F.when(years > after, F.lit(left)).otherwise(F.lit(1.0))


def carbon(cells: DataFrame) -> DataFrame:
    """From c0, c0_lower, c0_upper, f_i_full, f_i_conservative and di: the carbon at risk, never more than the stock."""
    lost = lambda stock, f: F.least(F.col(stock), F.col(stock) * F.coalesce(f, F.lit(0.0)) * F.col("di"))
    return cells.withColumns({"c_ri": lost("c0", "f_i_full"), "c_ri_lower": lost("c0_lower", "f_i_full"), "c_ri_upper": lost("c0_upper", "f_i_full"), "c_ri_conservative": lost("c0", "f_i_conservative")})
