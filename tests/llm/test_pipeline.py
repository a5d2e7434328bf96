import corpus_pipeline
from pyspark.sql import functions as F

from tessera.llm.common import cut


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(cut(stage(spark, seen[-1], sf), name))
    sizes = [d.count() for d in seen[:5]]
    assert all(a.columns == docs.columns for a in seen[:5])
    assert sizes[0] > sizes[1] > sizes[2] > sizes[3] == sizes[4]
    kept = {r["doc_id"] for r in seen[4].select("doc_id").collect()}
    packed = seen[5]
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == kept
    fill = packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n"), F.sum("n"), F.count("*")).first()
    assert fill[0] <= 4096 and fill[2] <= -(-fill[1] // 4096) + 1
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("quality = 0").join(seen[1], "doc_id", "left_semi").count()
    assert labels <= 0.2 * spark.read.parquet(f"{sf}/labels.parquet").where("quality = 0").count()


def test_stages_keep_clashing_and_null_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    odd = docs.withColumns({"score": F.lit("x"), "component_id": F.lit(None).cast("int"), "text": F.when(F.col("doc_id") % 9 > 0, F.col("text"))})
    now = odd
    for name, stage in corpus_pipeline.STAGES[:4]:
        now = cut(stage(spark, now, sf), name)
        assert now.columns == odd.columns
    assert corpus_pipeline.STAGES[4][1](spark, now, sf).count() >= now.count()


def test_empty(spark, sf):
    now = spark.read.parquet(f"{sf}/documents.parquet").where("false")
    for name, stage in corpus_pipeline.STAGES:
        now = cut(stage(spark, now, sf), name)
    assert now.count() == 0
