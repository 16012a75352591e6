"""Exact quantiles of whole columns in bounded memory: a sketch says about where the value lies, a count says between which rows it is, and so on inward.

Every round is one aggregate over the table for all columns and quantiles together: approximate percentiles round the wanted
rank among the values still open, then the exact numbers of values below and between. Wherever the rank turns out to lie,
some values are left out, so the rounds end; a range is left when it holds at most `collect` values (these are fetched), or
one value only. Each round usually leaves about a thousandth, so rounds grow with the logarithm of the table's size, and no
buffer grows with the rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACCURACY, COLLECT = 10_000, 20_000


@dataclass
class _Wanted:
    """One rank (from 0) of one column: the range that holds it, its ends left out where open (None: no end), and the
    values below the range and in it."""

    column: str
    rank: int
    inside: int
    below: int = 0
    low: float | None = None
    high: float | None = None
    open_low: bool = False
    open_high: bool = False
    room: float = 3 / ACCURACY
    value: float | None = None

    def within(self) -> Column:
        c, out = F.col(self.column), F.lit(True)
        if self.low is not None:
            out = out & (c > F.lit(self.low) if self.open_low else c >= F.lit(self.low))
        if self.high is not None:
            out = out & (c < F.lit(self.high) if self.open_high else c <= F.lit(self.high))
        return out

    def here(self) -> Column:
        return F.when(self.within(), F.col(self.column))


def quantiles(df: DataFrame, columns: dict[str, Column], probabilities: list[float], collect: int = COLLECT, accuracy: int = ACCURACY) -> dict[str, list[float | None]]:
    """For each named column expression its quantiles, interpolated between neighbours as `percentile` does; None where there is no value.
    Nulls are passed over; not-a-number counts as larger than all."""
    values = df.select(*(c.cast("double").alias(n) for n, c in columns.items())).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        counts = values.agg(*(F.count(n).alias(n) for n in columns)).first()
        wanted: dict[tuple[str, int], _Wanted] = {}
        for n in columns:
            for p in probabilities if counts[n] else ():
                at = p * (counts[n] - 1)
                wanted |= {(n, r): _Wanted(n, r, counts[n]) for r in (math.floor(at), math.ceil(at))}
        while open_ := [w for w in wanted.values() if w.value is None]:
            _fetch(values, [w for w in open_ if w.inside <= collect])
            _narrow(values, [w for w in open_ if w.inside > collect], accuracy)
    finally:
        values.unpersist()

    def found(n: str, p: float) -> float | None:
        if not counts[n]:
            return None
        at = p * (counts[n] - 1)
        low, high = math.floor(at), math.ceil(at)
        a, b = wanted[n, low].value, wanted[n, high].value
        return a if low == high or a == b else (high - at) * a + (at - low) * b

    return {n: [found(n, p) for p in probabilities] for n in columns}


def _fetch(values: DataFrame, few: list[_Wanted]) -> None:
    """The ranges of few values, each once: ranks often share one."""
    ranges = {_range(w): w for w in few}
    if ranges:
        row = values.agg(*(F.sort_array(F.collect_list(w.here())).alias(f"r{k}") for k, w in enumerate(ranges.values()))).first()
        own = dict(zip(ranges, row, strict=True))
        for w in few:
            w.value = own[_range(w)][w.rank - w.below]


def _range(w: _Wanted) -> tuple:
    return w.column, repr(w.low), repr(w.high), w.open_low, w.open_high


def _narrow(values: DataFrame, many: list[_Wanted], accuracy: int) -> None:
    if not many:
        return
    # Ranks of one range share its sketch: sketches are large, and all of a column's meet in one task.
    shared: dict[tuple, list[_Wanted]] = {}
    for w in many:
        shared.setdefault(_range(w), []).append(w)
    sketched = []
    for k, own in enumerate(shared.values()):
        at = [(w, (w.rank - w.below) / max(1, w.inside - 1)) for w in own]
        sketched.append(F.percentile_approx(own[0].here(), [x for w, q in at for x in (max(0.0, q - w.room), min(1.0, q + w.room))], accuracy).alias(f"r{k}"))
    row = values.agg(*sketched).first()
    many = [w for own in shared.values() for w in own]
    cuts = [(found[2 * k], found[2 * k + 1]) for own, found in zip(shared.values(), row, strict=True) for k in range(len(own))]
    counted = []
    for k, (w, (low, high)) in enumerate(zip(many, cuts, strict=True)):
        c = F.col(w.column)
        counted += [F.count_if(w.within() & (c < F.lit(low))).alias(f"b{k}"), F.count_if(w.within() & (c >= F.lit(low)) & (c <= F.lit(high))).alias(f"i{k}")]
    row = values.agg(*counted).first()
    for k, (w, (low, high)) in enumerate(zip(many, cuts, strict=True)):
        below, inside = w.below + row[f"b{k}"], row[f"i{k}"]
        room = 3 / accuracy
        if w.rank < below:  # the sketch was off: the value lies below both cuts
            w.high, w.open_high, w.inside = low, True, below - w.below
        elif w.rank >= below + inside:
            w.low, w.open_low, w.inside, w.below = high, True, w.inside - (below - w.below) - inside, below + inside
        elif low == high or (math.isnan(low) and math.isnan(high)):
            w.value = low
        elif inside == w.inside:
            room = 0.0  # nothing was left out: cut at one value, which always leaves something out or ends
        else:
            w.low, w.high, w.open_low, w.open_high, w.below, w.inside = low, high, False, False, below, inside
        w.room = room
