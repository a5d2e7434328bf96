"""A training-corpus pipeline: five stages over ``documents``.

Every stage works on all rows its predecessor kept.  All but the last return
the columns of their input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, jaccard, packing, quality, queries, secrets
from tessera.llm.common import cut, small_batches

#: Stages follow one another in the same executors, whose memory is then fuller than a single operator finds it.
BATCH_ROWS = 256


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the quality classifier, fitted on the labelled ones, rejects."""
    small_batches(spark, BATCH_ROWS)
    stats = cut(quality.with_statistics(docs), "statistics")
    return quality.keep(docs, queries.fit_quality(spark, sf_dir, stats))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates, keep the document with the least id; rows that repeat its id stay with it."""
    small_batches(spark, BATCH_ROWS)
    classes = jaccard.jaccard_components(docs)
    others = cut(classes.where("id <> component_id").select(F.col("id").alias("doc_id")).distinct(), "others")
    return docs.join(others, "doc_id", "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold passages of the benchmark."""
    small_batches(spark, BATCH_ROWS)
    return decontaminate.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in the texts; ``n_chars``, where there is one, follows."""
    small_batches(spark, BATCH_ROWS)
    out = secrets.redact(docs, secrets.train(secrets.default_samples(spark)))
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), length).otherwise(F.col("n_chars")))
    return out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 4096 tokens."""
    small_batches(spark, BATCH_ROWS)
    return packing.pack_pieces(packing.pieces(docs, queries.tokenizer_path())).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", keep_one_of_each),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("packing", pack),
]

#: The stages hold a fitted model, a tokenizer and a search, which SQL can't express; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
