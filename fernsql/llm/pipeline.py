"""The corpus pipeline's stages: toxicity, near-dedup, suffix-array dedup, decontamination, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs. A stage's
result is written as Parquet and read again as the next one's docs. Decisions are applied row by row, so null and
repeated ids are judged like all others, and no distinct text is lost under a repeated id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, simhash, suffixes, toxicity
from .common import Scratch, fresh, read
from .queries import BYTE_BPE, PATTERN


def with_rows(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a unique number for each row, and its column: the id where ids are unique and not null, else written down."""
    name = fresh(docs, "row")
    ids = docs.groupBy(F.col("doc_id").cast("long").alias("doc_id")).count()
    if not ids.filter("doc_id is null or count > 1").limit(1).count():
        return docs.withColumn(name, F.col("doc_id").cast("long")), name
    return Scratch(spark, "rows").save(docs.withColumn(name, F.monotonically_increasing_id()), "rows"), name


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the toxicity field predicts to be toxic."""
    model = toxicity.fit(spark, docs, read(spark, sf_dir, "labels"))
    name = fresh(docs, "predicted")
    return toxicity.attach(docs, model, name).filter(F.col(name) == 0).drop(name)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies: the smallest doc_id's, nulls last.

    Fingerprints of five-word shingles propose the pairs, a Jaccard similarity of 0.8 or more confirms them.
    """
    rows, name = with_rows(spark, docs)
    found = simhash.near_copies(spark, rows.select(F.col(name).alias("row"), "text"))
    ids = rows.select(F.col(name).alias("row"), F.col("doc_id").isNull().alias("none"), "doc_id")
    best = found.join(ids, "row").groupBy("root").agg(F.min(F.struct("none", "doc_id", "row")).alias("best"))
    return rows.join(best.select(F.col("best.row").alias(name)), name, "left_semi").select(docs.columns)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated 100-byte strings out of the texts; n_chars follows. Split characters at a cut go whole."""
    return suffixes.cut(spark, docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows that hold a benchmark window."""
    rows, name = with_rows(spark, docs)
    found = decontam.find(spark, rows.select(F.col(name).alias("doc_id"), "text"), read(spark, sf_dir, "benchmark"))
    bad = Scratch(spark, "contaminated").save(found.filter(F.size("hits") > 0).select(F.col("doc_id").alias(name)), "rows")
    return rows.join(bad, name, "left_anti").select(docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(docs, BYTE_BPE, PATTERN)


STAGES = [("toxicity", keep_clean), ("simhash", one_of_each_group), ("suffixes", without_repeats), ("decontamination", without_benchmark), ("byte_bpe", encoded)]

#: No stage before the last can be written in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs
