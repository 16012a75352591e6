"""From raw documents to packed training sequences: five stages, each written as Parquet and read by the next.

Each stage takes (spark, docs, sf_dir), works on every row of docs, and but for the last returns the columns of docs.
Nulls, empty texts, repeated rows and empty tables are treated as the operators' docstrings say. Further columns of docs,
whatever their names, pass through every stage but the last as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelgrid.llm import decontam, langid, linededup, packing, simhash
from keelgrid.llm.shared import fresh, named, shared_folder
from keelgrid.workers import with_workers

#: A document whose language is undetermined, or less likely than this, is rejected.
LEAST_SCORE = 0.5
#: The Jaccard index of 5-word shingles from which documents are near-duplicates.
LEAST_LIKENESS = 0.8


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is recognised. Learns as the operator does, from docs' own lang."""
    names = tuple(fresh(docs, x) for x in ("kg_language", "kg_score", "kg_held"))
    told = langid.identify(docs, keep=tuple(docs.columns), names=names)
    return told.where((F.col(names[0]) != langid.UNDETERMINED) & (F.col(names[1]) >= LEAST_SCORE)).select(*map(named, docs.columns))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated passages, and repeated texts of one or two lines, from the texts; a document of which nothing but white space is left goes."""
    names = (fresh(docs, "kg_lines"), fresh(docs, "kg_removed"))
    done = linededup.dedup_lines(docs, short=True, counts=names)
    kept = done.where((F.col(names[1]) == 0) | F.col("text").rlike(r"\S"))
    size = F.when(F.col(names[1]) > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return kept.withColumn("n_chars", size).select(*map(named, docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each class of near-duplicates: 5-word shingles, likeness LEAST_LIKENESS.

    SimHash fingerprints, BK-trees and components, as op6, with min-hash bands for the candidates beyond the trees' radius;
    every link is confirmed by the exact likeness."""
    return simhash.keep_one(docs, least=LEAST_LIKENESS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes documents that hold a benchmark's passages. Rows are told apart by id and text hash, so null ids are too."""
    key, name = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.xxhash64("text").cast("string")), fresh(docs, "kg_key")
    judged = decontam.contamination(docs.select(key.alias(name), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), name)
    bad = judged.where("contaminated").select(name).distinct()
    return docs.withColumn(name, key).join(bad, name, "left_anti").select(*map(named, docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences of 1024 tokens."""
    return packing.pack_documents(docs)


STAGES = [(name, with_workers(stage)) for name, stage in (("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("packing", pack))]

#: SQL can express neither the trained language model nor the tokenizer; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the last stage's rows."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), shared_folder(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
