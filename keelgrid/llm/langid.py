"""Language of a text: sparse multinomial logistic regression on TF-IDF weighted character n-grams.

Counts of hashed 1- to 3-grams of the whole lower-cased text, times the inverse document frequency, scaled to length 1,
are the inputs. Document frequencies are counted over all learning rows. The weights are fitted by follow-the-regularised-
leader (FTRL-proximal) with L1 and L2 penalties on a bounded sample of the learning rows (SAMPLE_ROWS, SAMPLE_CHARS, as
many of each language where there are enough; rows of one id and text count once); a fifth of it fits the temperature by which the scores are calibrated,
each row weighted back to its language's share of the learning rows.

A null text, or one without a letter, is `und` with score 0. Rows with a null label are not learned from. Without any
learning row every text is `und`; with one language all are of it. A null id hashes as the empty text in the fold, and rows
without ids, or of one id, are drawn by their texts. Repeated rows get equal results. Other columns are ignored. An empty table gives no rows. The model (two tables of BUCKETS rows) goes to
the executors with the function; texts are read where they lie and nothing but frequencies is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelgrid.llm.features import gram_counts
from keelgrid.llm.sampling import chosen, key_of, shares
from keelgrid.llm.shared import fold, give_back, named, portions

BUCKETS, SAMPLE_ROWS, SAMPLE_CHARS = 1 << 13, 6000, 20_000_000
UNDETERMINED = "und"


@dataclass
class LanguageModel:
    labels: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def inputs(self, texts: list[str]) -> np.ndarray:
        x = gram_counts(texts, len(self.idf))
        x *= self.idf
        norm = np.sqrt(np.einsum("ij,ij->i", x, x, dtype=np.float64))
        x /= np.maximum(norm, 1e-12)[:, None].astype(np.float32)
        return x

    def probabilities(self, texts: list[str]) -> np.ndarray:
        out = np.empty((len(texts), len(self.labels)))
        for at in range(0, len(texts), 256):
            out[at : at + 256] = softmax((self.inputs(texts[at : at + 256]) @ self.weights + self.bias) / self.temperature)
        return out


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class Ftrl:
    """FTRL-proximal for multinomial logistic regression; the last input is the bias, free of penalties."""

    def __init__(self, inputs: int, labels: int, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02):
        self.z, self.n = np.zeros((inputs + 1, labels)), np.zeros((inputs + 1, labels))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.full((len(z), 1), self.l1)
        if isinstance(at, slice) or at[-1] == len(self.z) - 1:
            l1[-1] = 0
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        """One example: the places of its inputs in ascending order, their values, its label."""
        at, x = np.append(at, len(self.z) - 1), np.append(x, 1.0)
        w = self.weights(at)
        p = softmax((x @ w)[None])[0]
        p[label] -= 1
        g = x[:, None] * p[None]
        old = self.n[at]
        new = old + g * g
        self.z[at] += g - (np.sqrt(new) - np.sqrt(old)) / self.alpha * w
        self.n[at] = new


def document_frequencies(df: DataFrame, text_col: str, buckets: int = BUCKETS) -> tuple[np.ndarray, int]:
    """How many rows have each bucket, over all rows, and how many rows there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(buckets, np.int64), 0
        for _, texts in portions(batches, text_col, 500_000):
            for at in range(0, len(texts), 256):
                total += (gram_counts(texts[at : at + 256], buckets) > 0).sum(axis=0)
            rows += len(texts)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(buckets + 1, dtype=np.int32)), pa.array(np.append(total, rows))], names=["bucket", "rows"])

    found = df.select(text_col).mapInArrow(run, "bucket int, rows long").groupBy("bucket").agg(F.sum("rows").alias("rows")).toArrow()
    out = np.zeros(buckets + 1, np.int64)
    out[found.column("bucket").to_numpy()] = found.column("rows").to_numpy()
    return out[:-1], int(out[-1])


def fit(learn: DataFrame, text_col: str, label_col: str, id_col: str, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS, buckets: int = BUCKETS, epochs: int = 3) -> LanguageModel | None:
    """The model from rows with a label and a text; None where there are none."""
    learn = learn.where(named(label_col).isNotNull() & named(text_col).isNotNull()).select(named(id_col).alias("kg_id"), named(text_col).alias("kg_text"), named(label_col).alias("kg_label"))
    learn = learn.withColumn("kg_key", key_of(F.col("kg_id").cast("string"), F.col("kg_text")))
    text_col, label_col = "kg_text", "kg_label"
    by = shares(learn, label_col, F.col("kg_key"), F.length(text_col), rows, chars)
    if not by:
        return None
    frequency, count = document_frequencies(learn, text_col, buckets)
    drawn = learn.where(chosen(F.col("kg_key"), label_col, by)).select(text_col, label_col, "kg_key").dropDuplicates([label_col, "kg_key"]).toArrow()
    texts, names = drawn.column(text_col).to_pylist(), drawn.column(label_col).to_pylist()
    for label in by.keys() - set(names):  # a label of which chance drew nothing: its first keys
        few = learn.where(F.col(label_col) == F.lit(label)).select(text_col, "kg_key").dropDuplicates(["kg_key"]).orderBy("kg_key").limit(max(1, rows // len(by) // 10)).collect()
        texts, names, by[label] = [*texts, *(r[0] for r in few)], [*names, *[label] * len(few)], min(1.0, 2 * by[label])
    labels = sorted(by)
    model = LanguageModel(labels, np.log((1 + count) / (1 + frequency)).astype(np.float32), np.zeros((buckets, len(labels)), np.float32), np.zeros(len(labels), np.float32))
    order = sorted(range(len(texts)), key=lambda i: (hash_of(texts[i]), names[i]))
    train, tune = [i for k, i in enumerate(order) if k % 5], [i for k, i in enumerate(order) if not k % 5]
    ftrl = Ftrl(buckets, len(labels))
    sparse = []
    for at in range(0, len(train), 256):
        x = model.inputs([texts[i] for i in train[at : at + 256]])
        for k, i in enumerate(train[at : at + 256]):
            places = np.flatnonzero(x[k])
            sparse.append((places, x[k, places].astype(float), labels.index(names[i])))
    for _ in range(epochs):
        for example in sparse:
            ftrl.learn(*example)
    w = ftrl.weights()
    model.weights, model.bias = w[:-1].astype(np.float32), w[-1].astype(np.float32)
    if tune:
        logits = np.concatenate([model.inputs([texts[i] for i in tune[at : at + 256]]) @ model.weights + model.bias for at in range(0, len(tune), 256)])
        truth = np.array([labels.index(names[i]) for i in tune])
        weight = np.array([1 / by[names[i]] for i in tune])
        loss = lambda t: -(weight * np.log(softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12)).sum()
        model.temperature = min(np.geomspace(0.02, 5, 60), key=loss)
    return model


def hash_of(text: str) -> int:
    import zlib

    return zlib.crc32(text.encode("utf-8", "replace"))


def predict(df: DataFrame, model: LanguageModel | None, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns `keep`, which can be all of a document's, then the language and its score under `names`."""
    letter = F.coalesce(named(text_col).rlike(r"\p{L}"), F.lit(False))
    # The text goes to the workers once, also where it is kept.
    text = f"kg_{keep.index(text_col)}" if text_col in keep else "kg_text"
    source = df.select(*(named(c).alias(f"kg_{k}") for k, c in enumerate(keep)), letter.alias("kg_letter"), *(named(c).alias("kg_text") for c in [text_col] if c not in keep))
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in portions(batches, text, 500_000):
            there = part.column("kg_letter").to_pylist()
            said, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
            at = [i for i, x in enumerate(there) if x and model]
            if at:
                p = model.probabilities([texts[i] for i in at])
                for i, best, score in zip(at, p.argmax(axis=1), p.max(axis=1), strict=True):
                    said[i], scores[i] = model.labels[best], float(score)
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(keep))), pa.array(said), pa.array(scores, pa.float64())], names=schema.names)

    return source.mapInArrow(run, schema)


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", parts: int = 4, held: int = 2, keep: tuple[str, ...] | None = None, names: tuple[str, str, str] = ("lang_pred", "score", "held_out")) -> DataFrame:
    """Learns from the rows whose fold (crc32 of the id as text, modulo parts) is not `held`, predicts every row. Adds
    columns of these names, which must not be among those kept."""
    out = fold(id_col, parts) == held
    model = fit(df.where(~out), text_col, label_col, id_col)
    give_back()  # the driver too lives on, and the fit's examples are a hundred MB in small pieces
    return predict(df, model, text_col, keep or (id_col,), names[:2]).withColumn(names[2], fold(id_col, parts) == held)
