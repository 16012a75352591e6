"""Quality score of a text: a factorisation machine over hashed words and statistics of the text's structure.

Inputs are the shares of hashed lower-cased words (BUCKETS, square roots of counts, scaled to length 1) and the text's
structure statistics (features.STATISTICS, standardised and cut to [-4, 4]); numeric columns of the table can be given as
metadata (op3: n_chars), whose logarithm, with the sign kept, is treated as the statistics are. The score is sigma(w0 + sum w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2]): all pairwise
interactions in time linear in the inputs. It is fitted by Adam on a bounded sample of labelled rows (SAMPLE_ROWS,
SAMPLE_CHARS), the same number of each label where there are enough, each row weighted back to its label's share.

Null and empty texts get the score of an empty text. Rows without a label, or with one other than 0 and 1, are not
learned from; with no labelled row every score is 0.5. Null metadata count as 0. A null id hashes as the empty text and
has no label. Repeated rows get equal scores and are learned from once; a document of both labels is learned from with each. Other
columns are ignored. An empty table gives no rows. Only the sample is joined (its ids, SAMPLE_ROWS at most, are
broadcast); scoring reads each text where it lies.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelgrid.llm.features import STATISTICS, joined, structure, word_counts
from keelgrid.llm.langid import hash_of
from keelgrid.llm.sampling import chosen, key_of, shares
from keelgrid.llm.shared import fold, named, portions

BUCKETS, FACTORS, SAMPLE_ROWS, SAMPLE_CHARS, CHARS_A_ROW = 1 << 12, 8, 6000, 20_000_000, 4000


@dataclass
class FactorisationMachine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    buckets: int = BUCKETS

    def raw_inputs(self, texts: list[str], metadata: np.ndarray) -> np.ndarray:
        return raw_inputs(texts, metadata, self.buckets)

    def standardised(self, x: np.ndarray) -> np.ndarray:
        x = x.copy()
        x[:, self.buckets :] = np.clip((x[:, self.buckets :] - self.mean) / self.scale, -4, 4)
        return x

    def margin(self, x: np.ndarray) -> np.ndarray:
        s = x @ self.factors
        return self.bias + x @ self.linear + 0.5 * ((s * s).sum(axis=1) - (x * x) @ (self.factors**2).sum(axis=1))

    def score(self, texts: list[str], metadata: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(self.standardised(self.raw_inputs(texts, metadata))).astype(float), -30, 30)))


def raw_inputs(texts: list[str], metadata: np.ndarray, buckets: int) -> np.ndarray:
    raw, begins = joined(texts)
    counts, hashes, starts = word_counts(raw, begins, buckets)
    stats = structure(raw, begins, hashes, starts, counts)
    words = np.sqrt(counts)
    words /= np.maximum(np.sqrt(counts.sum(axis=1)), 1)[:, None]
    return np.concatenate([words, stats, metadata.astype(np.float32)], axis=1)


def _metadata(column: str) -> Column:
    value = F.coalesce(named(column).cast("double"), F.lit(0.0))
    return F.signum(value) * F.log1p(F.abs(value))


def fit_machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, buckets: int, factors: int = FACTORS, epochs: int = 12, rate: float = 0.02, l2: float = 1e-5, seed: int = 7) -> FactorisationMachine:
    """x: unstandardised inputs. Adam over minibatches in an order fixed by the seed."""
    random = np.random.default_rng(seed)
    tail = x[:, buckets:]
    m = FactorisationMachine(0.0, np.zeros(x.shape[1], np.float32), (random.normal(size=(x.shape[1], factors)) * 0.01).astype(np.float32), tail.mean(axis=0), np.maximum(tail.std(axis=0), 1e-6), buckets)
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (m.linear, m.factors)]
    bias_state, step = [0.0, 0.0], 0
    for _ in range(epochs):
        order = random.permutation(len(y))
        for at in range(0, len(order), 128):
            rows, step = order[at : at + 128], step + 1
            b = m.standardised(x[rows])
            e = (weight[rows] * (1 / (1 + np.exp(-np.clip(m.margin(b), -30, 30))) - y[rows]) / len(rows)).astype(np.float32)
            s = b @ m.factors
            grads = (b.T @ e + l2 * m.linear, b.T @ (e[:, None] * s) - m.factors * ((b * b).T @ e)[:, None] + l2 * m.factors)
            for p, g, (first, second) in zip((m.linear, m.factors), grads, state, strict=True):
                first *= 0.9
                first += 0.1 * g
                second *= 0.999
                second += 0.001 * g * g
                p -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
            g = float(e.sum())
            bias_state = [0.9 * bias_state[0] + 0.1 * g, 0.999 * bias_state[1] + 0.001 * g * g]
            m.bias -= rate * (bias_state[0] / (1 - 0.9**step)) / (np.sqrt(bias_state[1] / (1 - 0.999**step)) + 1e-8)
    return m


def learn(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, metadata: tuple[str, ...] = (), rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS, buckets: int = BUCKETS) -> FactorisationMachine | None:
    """The machine from df's rows that `labels` marks 0 or 1; None without any. The sample holds about as many ids as
    `rows` and as `chars` allows at CHARS_A_ROW; where their texts are more than twice `rows` or `chars`, fewer texts, by their hash."""
    marked = labels.where(named(label_col).isin(0, 1) & named(id_col).isNotNull()).select(named(id_col).alias("kg_id"), named(label_col).cast("int").alias("kg_label"))
    drawn = key_of(F.col("kg_id").cast("string"))
    by = shares(marked, "kg_label", drawn, F.lit(CHARS_A_ROW), rows, chars)
    if not by:
        return None
    sample = marked.where(chosen(drawn, "kg_label", by)).distinct()
    joined_ = df.select(named(id_col).alias("kg_own"), named(text_col).alias("kg_text"), *(_metadata(c).alias(f"kg_m{k}") for k, c in enumerate(metadata))).join(F.broadcast(sample), F.col("kg_own") == F.col("kg_id"))
    joined_ = joined_.withColumn("kg_key", key_of(F.col("kg_own").cast("string"), F.col("kg_text"), salt="text"))
    keys, size = joined_.agg(F.approx_count_distinct("kg_key", 0.02), F.avg(F.length(F.coalesce("kg_text", F.lit(""))))).first()
    # Far longer texts, or far more of an id, than planned for: fewer of them.
    less = min(1.0, *(most / now for most, now in ((rows, keys), (chars, keys * (size or 0))) if now > 2 * most), 1.0)
    columns = ["kg_text", "kg_label", *(f"kg_m{k}" for k in range(len(metadata)))]
    table = joined_.where(chosen(F.col("kg_key"), "kg_label", dict.fromkeys(by, less))).dropDuplicates(["kg_key", "kg_label"]).select(*columns).toArrow()
    if not table.num_rows:
        return None
    texts, y = [t or "" for t in table.column(0).to_pylist()], np.array(table.column(1).to_pylist(), float)
    extra = np.array([table.column(2 + k).to_pylist() for k in range(len(metadata))], float).reshape(len(metadata), len(texts)).T
    order = sorted(range(len(texts)), key=lambda i: (hash_of(texts[i]), y[i]))
    x = np.concatenate([raw_inputs([texts[i] for i in order[at : at + 256]], extra[order[at : at + 256]], buckets) for at in range(0, len(order), 256)])
    y = y[order]
    weight = np.array([1 / by.get(int(k), 1.0) for k in y])
    return fit_machine(x, y, weight / weight.mean(), buckets)


def score(df: DataFrame, machine: FactorisationMachine | None, id_col: str = "doc_id", text_col: str = "text", metadata: tuple[str, ...] = ()) -> DataFrame:
    """id and score of every row."""
    schema = T.StructType([df.schema[id_col], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in portions(batches, "kg_text", 1_000_000):
            scores = np.full(len(texts), 0.5)
            if machine:
                extra = np.array([part.column(2 + k).to_numpy(zero_copy_only=False) for k in range(len(metadata))], float).reshape(len(metadata), len(texts)).T
                for at in range(0, len(texts), 512):
                    scores[at : at + 512] = machine.score(texts[at : at + 512], extra[at : at + 512])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores)], names=schema.names)

    source = df.select(named(id_col).alias("kg_id"), named(text_col).alias("kg_text"), *(_metadata(c).alias(f"kg_m{k}") for k, c in enumerate(metadata)))
    return source.mapInArrow(run, schema)


def judge(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", parts: int = 5, held: int = 0, threshold: float = 0.3, metadata: tuple[str, ...] = ()) -> DataFrame:
    """Learns from labelled rows whose fold (crc32 of the id as text, modulo parts) is not `held`; scores every row."""
    machine = learn(df, labels.where(fold(id_col, parts) != held), id_col, text_col, label_col, metadata)
    scored = score(df, machine, id_col, text_col, metadata)
    return scored.select(named(id_col), (fold(id_col, parts) == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
