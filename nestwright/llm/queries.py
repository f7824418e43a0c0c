"""One query per operator, with production parameters over its whole table, and DuckDB SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nestwright.llm import ann, licenses, mixing, near_dup, packing, quality, suffix_dedup, topk, url_rules, warc

#: Rules of the URL filter: verdict, host and path.
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
#: Least quality score that keeps a document.
LEAST_QUALITY = 0.3


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), keep=("doc_id", "source"))


def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicate_classes(table(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = licenses.train(spark, licenses.sample_paragraphs(docs))
    return licenses.scan(docs, model)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.capture_digests(table(spark, sf_dir, "pages"))


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.exact_top_k(vectors, vectors.where("vec_id % 50 = 0"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= LEAST_QUALITY).cast("int").alias("predicted"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_rules.judge(pages, URL_RULES, url_rules.mine(url_rules.labelled_by_rules(pages, URL_RULES), "url", "bad"))


def op8_additive_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.additive_search(vectors, vectors.where("vec_id % 100 = 0"))


def op9_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_lpf_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.repeated_spans(table(spark, sf_dir, "documents"))
    return out.select(F.col("doc").alias("doc_id"), "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.col("kept").alias("kept_sha256"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_pfair_mixing, op2_order_minhash, op3_license_scan, op4_warc, op5_exact_topk, op6_quality, op7_url_filter, op8_additive_ann, op9_harmonic_packing, op10_lpf_dedup)}


def oracle_sql() -> dict[str, str]:
    return {
        "op4_warc": """
            WITH p AS (
              SELECT page_id, encode(coalesce(html, '')) AS body FROM pages
            ), d AS (
              SELECT page_id, octet_length(body) AS n, sha256(body) AS digest FROM p
            ), f AS (
              SELECT digest, min(page_id) AS first_id FROM d WHERE n >= 100 GROUP BY digest
            )
            SELECT d.page_id, CAST(d.n AS BIGINT) AS payload_bytes, d.digest AS payload_digest,
                   CASE WHEN f.first_id <> d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
                   CASE WHEN f.first_id <> d.page_id THEN f.first_id END AS refers_to,
                   1 AS n_requests, 1 AS n_metadata
            FROM d LEFT JOIN f ON d.digest = f.digest AND d.n >= 100
        """,
        "op5_exact_topk": """
            WITH v AS (
              SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
              FROM embeddings
              WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0
                AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
            ), s AS (
              SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
              FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
              WHERE q.vec_id % 50 = 0
            ), r AS (
              SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s
            )
            SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= 5
        """,
        "op10_lpf_dedup": """
            WITH d AS (
              SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
            ), w AS (
              SELECT doc_id, i, substr(h, CAST(2 * i + 1 AS BIGINT), 100) AS s
              FROM (SELECT doc_id, h, unnest(range(0, greatest(0, length(h) // 2 - 49))) AS i FROM d)
            ), f AS (
              SELECT s, min(doc_id) AS first_id FROM w GROUP BY s
            ), r AS (
              SELECT doc_id, i FROM w JOIN f USING (s) WHERE first_id < doc_id
            ), g AS (
              SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS opens FROM r
            ), n AS (
              SELECT doc_id, i, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM g
            ), s AS (
              SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM n GROUP BY doc_id, span
            ), p AS (
              SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS z FROM s
            ), k AS (
              SELECT doc_id, string_agg(substr(h, CAST(2 * z + 1 AS BIGINT), CAST(2 * (a - z) AS BIGINT)), '' ORDER BY a) AS head,
                     max(b) AS last, sum(b - a) AS gone, count(*) AS spans
              FROM p JOIN d USING (doc_id) GROUP BY doc_id
            )
            SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed,
                   CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
                   sha256(unhex(coalesce(head, '') || substr(h, CAST(2 * coalesce(last, 0) + 1 AS BIGINT)))) AS kept_sha256
            FROM d LEFT JOIN k USING (doc_id)
        """,
    }
