"""A bounded sample of labelled rows for fitting a classifier, by a 64-bit hash of the rows' own content.

What is drawn are different keys: rows that share the columns hashed (an id and its text, say) are one, however often they
stand, so repeated rows cannot fill the sample, and rows without an id, or of one id, are told apart by the rest. Shares
compare with the whole hash, so they can be as small as a table is large. A null value hashes as a value of its own. An
empty table gives no shares.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LEAST, _ALL = -(1 << 63), 1 << 64


def key_of(*columns: Column, salt: str = "sample") -> Column:
    """The hash by which rows are drawn. Nulls are marked, as the hash passes them over."""
    return F.xxhash64(*(x for c in columns for x in (c.isNull(), c)), F.lit(salt))


def chosen(key: Column, label: str, by: dict) -> Column:
    """Whether the key is among the first of its label's share of all hashes."""
    out = F.lit(False)
    for value, share in by.items():
        here = F.lit(True) if share >= 1 else key < F.lit(_LEAST + int(share * _ALL)).cast("long")
        out = F.when(F.col(label) == F.lit(value), here).otherwise(out)
    return out


def shares(df: DataFrame, label: str, key: Column, size: Column, rows: int, chars: int) -> dict:
    """For each label the share of its different keys to take, so that about `rows` keys and `chars` characters come in all,
    as many of each label. The numbers of keys are estimates within a few hundredths, from sketches that are merged where
    they lie. One row a label reaches the driver; a column with more than 1000 values is no label, and an error rather
    than a classifier of that many classes."""
    counts = df.groupBy(label).agg(F.approx_count_distinct(key, 0.02).alias("kg_keys"), F.avg(size).alias("kg_chars")).limit(1001).collect()
    if len(counts) > 1000:
        raise ValueError(f"{label} has more than 1000 values")
    n = max(1, len(counts))
    return {r[0]: min(1.0, rows / n / r["kg_keys"], chars / n / max(1.0, (r["kg_chars"] or 0) * r["kg_keys"])) for r in counts}
