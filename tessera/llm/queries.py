"""Queries that bind this subpackage's operators to the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, fim, hardneg, jaccard, mixing, neardup, packing, quality, secrets, suffixes, tokenfile, toxicity, warc
from tessera.llm.common import cut, scratch_dir, small_batches


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _remainder(id_col: str, mod: int):
    """crc32 of the id as text, modulo ``mod``: the folds of the labelled rows."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % mod


def _labels(spark: SparkSession, sf_dir: str, name: str, mod: int, held_out: int) -> DataFrame:
    """``(id, y)``: one label for each id outside the held-out fold; of several the larger."""
    labels = _read(spark, sf_dir, "labels").where(_remainder("doc_id", mod) != held_out)
    return labels.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(name).cast("int").alias("y")).where("y is not null")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in all documents."""
    model = secrets.train(secrets.default_samples(spark))
    found = secrets.scan(_read(spark, sf_dir, "documents").select("doc_id", "text"), model, "text", "s")
    count = lambda kind: F.size(F.filter("s", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        count("assign"),
        count("access"),
        count("hex"),
        F.sha2(secrets.listed(F.col("s"), base_only=True), 256).alias("base_sha256"),
        secrets.listed(F.col("s")).alias("spans"),
        count("markov"),
    )


def op1_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors at a cosine of 0.93, within labels."""
    return neardup.near_duplicates(_read(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that all documents hold parts of."""
    found = decontaminate.matches(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return found.withColumnRenamed("id", "doc_id")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents."""
    docs = _read(spark, sf_dir, "documents")
    net = toxicity.train(docs, _labels(spark, sf_dir, "toxic", 5, 0))
    return toxicity.score(docs, net).select(
        F.col("id").alias("doc_id"),
        (_remainder("id", 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op7_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that all documents share."""
    return suffixes.repeated_passages(_read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def tokenizer_path() -> str:
    """The tokenizer file of the packing and token-file queries."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode all documents into token files, read the files back and report every document."""
    out = scratch_dir(spark, "tokens")
    manifest = tokenfile.write_tokens(_read(spark, sf_dir, "documents"), out, tokenizer_path()).orderBy("file").collect()
    names = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not manifest:
        return spark.createDataFrame([], names)
    starts, total = {}, 0
    for r in manifest:  # a row for each file
        starts[r["file"]] = total
        total += r["tokens"]
    return tokenfile.read_tokens(spark, out, starts, with_tokens=False).drop("tokens")


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents linked by 80 per cent of their five-word shingles."""
    return jaccard.jaccard_components(_read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of at most 4096 tokens."""
    return packing.pack_pieces(packing.pieces(_read(spark, sf_dir, "documents"), tokenizer_path())).withColumnRenamed("id", "doc_id")


def fit_quality(spark: SparkSession, sf_dir: str, stats: DataFrame):
    """The quality model, from labelled rows outside the held-out fold."""
    return quality.fit(cut(stats.join(_labels(spark, sf_dir, "quality", 3, 1), "id"), "labelled"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    stats = cut(quality.with_statistics(_read(spark, sf_dir, "documents")), "statistics")
    scored = quality.score(stats, fit_quality(spark, sf_dir, stats))
    return scored.select(
        F.col("id").alias("doc_id"),
        (_remainder("id", 3) == 1).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive all pages, read the archives back and report every record."""
    out = scratch_dir(spark, "warc")
    pages = _read(spark, sf_dir, "pages")
    manifest = warc.write_archives(pages, out)
    if not manifest.take(1):
        return spark.createDataFrame(
            [], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
        )
    return warc.read_archives(spark, out, with_payload=False).select(
        warc.page_id_of("record_id").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        warc.page_id_of("refers_to_id").alias("refers_to"),
    )


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fill-in-the-middle forms of all documents, and the texts rebuilt from them."""
    made = fim.fill_in_middle(_read(spark, sf_dir, "documents"))
    return made.select(
        F.col("id").alias("doc_id"),
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fim.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document a mix of all sources takes."""
    mixed = mixing.mix(_read(spark, sf_dir, "documents"))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "source", "copies")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector, against all vectors."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.hard_negatives(_read(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embedding_neardup": op1_embedding_neardup,
    "op2_secrets": op2_secrets,
    "op3_decontamination": op3_decontamination,
    "op4_tokens": op4_tokens,
    "op5_toxicity": op5_toxicity,
    "op6_jaccard": op6_jaccard,
    "op7_repeated_passages": op7_repeated_passages,
    "op8_quality": op8_quality,
    "op9_packing": op9_packing,
    "op10_warc": op10_warc,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_mixing": op12_mixing,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLE_SQL: dict[str, str] = {
    "op10_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        h AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS hex,
                     min(page_id) OVER (PARTITION BY html) AS first_id FROM p)
        SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
               list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   (((('0x' || substr(hex, ((i // 4) * 5 + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1)::INT,
                   1)), 'string_agg', '') AS payload_digest,
               CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first_id THEN first_id END AS refers_to
        FROM h""",
    "op11_fill_in_middle": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h,
                     regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units FROM documents),
        k AS (SELECT *, len(units) AS n, list_transform(range(4), lambda i: ('0x' || substr(h, (8 * i + 1)::INT, 8))::BIGINT) AS draw FROM d),
        c AS (SELECT *, least(draw[1] % (n + 1), draw[2] % (n + 1)) AS a, greatest(draw[1] % (n + 1), draw[2] % (n + 1)) AS b,
                CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR draw[3] % 100 >= 50 THEN 'plain'
                     WHEN draw[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM k),
        p AS (SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:], '') AS suffix FROM c)
        SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars,
               CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                      ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
               sha256(text) AS restored_sha256
        FROM p""",
    "op13_hard_negatives": """
        WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                     list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS c FROM embeddings
                   WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
                     AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id AS other_id, b.label AS label,
                list_sum(list_transform(range(1, len(a.c) + 1), lambda i: a.c[i] * b.c[i]))::BIGINT AS score
              FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
        p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE own = label
              QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
        SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id))::INT AS rank,
               other_id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s USING (anchor_id) WHERE own <> label AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
        QUALIFY rank <= 10""",
}
