"""The registered queries of the text operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillboard.llm import exact_dedup, langid, minhash, mixing, quality_crf, sharding, topk_norm, toxicity, unigram, url_rules
from quillboard.llm.common import crc_fold
from quillboard.llm.fitting import labelled


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; fold 2 of 4 (by crc32 of the id) is never learned from."""
    docs = table(spark, sf_dir, "documents")
    held_out = crc_fold(F.col("doc_id"), 4) == 2
    model = langid.fit(docs.where(~held_out))
    return langid.predict(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; fold 1 of 3 is never learned from."""
    docs = table(spark, sf_dir, "documents")
    sample = labelled(docs, table(spark, sf_dir, "labels"), "quality", 3000, crc_fold(F.col("__qb_id"), 3) != 1)
    scored = quality_crf.predict(docs.select("doc_id", "text"), quality_crf.fit(sample))
    held_out = crc_fold(F.col("doc_id"), 3) == 1
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "good_lines", "lines")


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.ToxicityModel:
    """Learned from folds 0 and 2 of 3."""
    return toxicity.fit(labelled(docs, labels, "toxic", 4000, crc_fold(F.col("__qb_id"), 3) != 1))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best rows for every 50th vector, against all rows."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk_norm.top_k(vectors, F.col("vec_id") % 50 == 0, k=5, scale=256.0)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampling probability and decision of every document: 60 % of the tokens, shares to the power 0.85."""
    return mixing.decisions(table(spark, sf_dir, "documents"), budget_share=0.6, alpha=0.85)


#: A public model file; a parameter of the operator.
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every document, and whether they decode to it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return unigram.encode_column(docs, unigram.build(MODEL_PATH)).select("doc_id", "n_tokens", "n_byte_tokens", "round_trip", "ids")


#: Score from which a text counts as toxic.
TOXIC = 0.7


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; fold 1 of 3 is never learned from."""
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.predict(docs.select("doc_id", "text"), toxicity_model(docs, table(spark, sf_dir, "labels")))
    held_out = crc_fold(F.col("doc_id"), 3) == 1
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into shards 0 to 39 under the law `rows`."""
    text = F.col("text").cast("binary")
    narrow = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.length(text), F.lit(0)) + 16).cast("bigint").alias("size"),
        F.crc32(F.coalesce(text, F.lit("").cast("binary"))).alias("text_crc32"),
    )
    out = sharding.hypergeometric_shards(narrow, shards=40, seed=20_240_601)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents: 4-word shingles, similarity 0.8 or more."""
    return minhash.components(table(spark, sf_dir, "documents").select("doc_id", "text"), size=4, percent=80)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"), keep="largest").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


#: The production rules, in the order of the contract.
URL_RULES = ("allow org/", "block example.org/es/", "block example.org/en/1", "allow com/fr/", "block com/de/")


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [url_rules.parse_rule(line) for line in URL_RULES]
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_rules.judge(pages, rules, default="allow").select("page_id", "host", "path", "rule", "verdict")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_quality": op2_quality,
    "op3_sharding": op3_sharding,
    "op4_topk": op4_topk,
    "op5_mixing": op5_mixing,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_toxicity": op7_toxicity,
    "op8_minhash": op8_minhash,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_url_filters": op10_url_filters,
}

SQL: dict[str, str] = {
    "op4_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
        FROM s QUALIFY rank <= 5""",
    "op8_minhash": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w
            FROM documents),
        s AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')))) END AS g
            FROM w),
        k AS (SELECT doc_id, CAST(len(g) AS BIGINT) AS n, g, md5(array_to_string(g, chr(10))) AS key FROM s),
        c AS (SELECT key, min(doc_id) AS rep, any_value(n) AS n, any_value(g) AS g FROM k WHERE n > 0 GROUP BY key),
        e AS (SELECT rep, n, unnest(g) AS x FROM c),
        l AS (
            SELECT a.rep AS a, b.rep AS b FROM e a JOIN e b ON a.x = b.x AND a.rep < b.rep
            GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
        t AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r AS (SELECT DISTINCT a AS node, a AS reached FROM t UNION SELECT t.b, r.reached FROM r JOIN t ON t.a = r.node),
        m AS (SELECT node, min(reached) AS least FROM r GROUP BY node)
        SELECT k.doc_id, k.n AS n_shingles, coalesce(m.least, c.rep, k.doc_id) AS component_id,
            k.doc_id = coalesce(m.least, c.rep, k.doc_id) AS kept
        FROM k LEFT JOIN c ON k.n > 0 AND c.key = k.key LEFT JOIN m ON m.node = c.rep""",
    "op9_exact_dedup": """
        WITH g AS (
            SELECT coalesce(text, '') AS t, max(doc_id) AS keep_id, count(*) AS group_size
            FROM documents GROUP BY 1)
        SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(g.t) AS text_sha256
        FROM documents d JOIN g ON coalesce(d.text, '') = g.t""",
    "op10_url_filters": r"""
        WITH r(verdict, host, path) AS (VALUES
            ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
            ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
        u AS (
            SELECT page_id,
                CASE WHEN contains(url, '://') THEN translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
                CASE WHEN contains(url, '://') THEN regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1) ELSE '' END AS path
            FROM pages),
        f AS (
            SELECT u.page_id, arg_max(r.host || r.path, length(r.host || r.path)) AS rule,
                arg_max(r.verdict, length(r.host || r.path)) AS verdict
            FROM u JOIN r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path)
            GROUP BY 1)
        SELECT u.page_id, u.host, u.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
        FROM u LEFT JOIN f ON u.page_id = f.page_id""",
}
