"""Lengths of geodesics on an ellipsoid, as a column expression: Vincenty's inverse iteration, stopped when it stands still."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from keelgrid.functions import grid as g

#: Steps at most; between all but nearly opposite points six are enough.
STEPS = 40


def geodesic_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column, semi_major: float = g.SEMI_MAJOR, flattening: float = g.FLATTENING) -> Column:
    """Metres, to a fraction of a millimetre; null where a coordinate is null, or where the points are nearly opposite and the
    iteration does not end. Give columns, not expressions: they are used often."""
    f = flattening
    b = semi_major * (1 - f)
    rad = F.radians
    turn = rad(lon2 - lon1)
    turn = turn - F.lit(2) * F.pi() * F.floor((turn + F.pi()) / (F.lit(2) * F.pi()))
    u1, u2 = F.atan((1 - f) * F.tan(rad(lat1))), F.atan((1 - f) * F.tan(rad(lat2)))
    known = F.struct(F.sin(u1).alias("s1"), F.cos(u1).alias("c1"), F.sin(u2).alias("s2"), F.cos(u2).alias("c2"), turn.alias("turn"))

    def angles(k: Column, way: Column) -> Column:
        """On the auxiliary sphere: the arc and its sine and cosine, cos^2 of the azimuth, cos of twice the middle, sine of the azimuth."""
        across, along = k["c2"] * F.sin(way), k["c1"] * k["s2"] - k["s1"] * k["c2"] * F.cos(way)
        first = F.struct(F.sqrt(across * across + along * along).alias("sin"), (k["s1"] * k["s2"] + k["c1"] * k["c2"] * F.cos(way)).alias("cos"))

        def second(x: Column) -> Column:
            azimuth = F.when(x["sin"] > 0, k["c1"] * k["c2"] * F.sin(way) / F.when(x["sin"] > 0, x["sin"])).otherwise(0.0)
            return F.struct(x["sin"].alias("sin"), x["cos"].alias("cos"), F.atan2(x["sin"], x["cos"]).alias("arc"), azimuth.alias("azimuth"), (1 - azimuth * azimuth).alias("square"))

        def third(x: Column) -> Column:
            middle = F.when(x["square"] > 1e-15, x["cos"] - 2 * k["s1"] * k["s2"] / F.when(x["square"] > 1e-15, x["square"])).otherwise(0.0)
            return F.struct(*(x[n].alias(n) for n in ("sin", "cos", "arc", "azimuth", "square")), middle.alias("middle"))

        return _let(_let(first, second), third)

    def step(k: Column, state: Column) -> Column:
        def next_way(x: Column) -> Column:
            c = f / 16 * x["square"] * (4 + f * (4 - 3 * x["square"]))
            return k["turn"] + (1 - c) * f * x["azimuth"] * (x["arc"] + c * x["sin"] * (x["middle"] + c * x["cos"] * (2 * x["middle"] * x["middle"] - 1)))

        moved = F.struct(_let(angles(k, state["way"]), next_way).alias("way"), state["way"].alias("before"))
        return F.when(F.abs(state["way"] - state["before"]) < 1e-13, state).otherwise(moved)

    def length(k: Column, state: Column) -> Column:
        def of(x: Column) -> Column:
            u = x["square"] * ((semi_major**2 - b**2) / b**2)
            a_ = 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u)))
            b_ = u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))
            m = x["middle"]
            less = b_ * x["sin"] * (m + b_ / 4 * (x["cos"] * (2 * m * m - 1) - b_ / 6 * m * (4 * x["sin"] * x["sin"] - 3) * (4 * m * m - 3)))
            return F.lit(b) * a_ * (x["arc"] - less)

        return F.when(F.abs(state["way"] - state["before"]) < 1e-11, _let(angles(k, state["way"]), of))

    def solved(k: Column) -> Column:
        start = F.struct(k["turn"].alias("way"), F.lit(1e9).alias("before"))
        return _let(F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, lambda s, _: step(k, s)), lambda s: length(k, s))

    return _let(known, solved)


def _let(value: Column, body) -> Column:
    """body(value), with value evaluated once however often body uses it."""
    return F.transform(F.array(value), body)[0]
