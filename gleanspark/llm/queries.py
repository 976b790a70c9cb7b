"""The queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanspark.llm import centroids, pieces
from gleanspark.llm.common import documents
from gleanspark.llm.decontamination import contaminated
from gleanspark.llm.exact_dedup import exact_dedup
from gleanspark.llm.language_id import held_out, language_id
from gleanspark.llm.line_dedup import kept_text, line_dedup
from gleanspark.llm.near_vectors import near_vectors
from gleanspark.llm.ngram_join import near_duplicates
from gleanspark.llm.pii import personal_data, span_text
from gleanspark.llm.sharding import shards
from gleanspark.llm.token_counts import token_counts, vocabulary
from gleanspark.llm.url_filter import url_filter
from gleanspark.llm.whitening import whitening

#: A public tokenizer's file; it is only read by the driver.
PIECES_FILE = "/opt/tokenizers/piece_bpe_32k.model"

#: The URL rules (host, path, verdict).
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark item is found, with the item."""
    found = contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "item_id", "n_windows", "start", "similarity")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), *vocabulary(PIECES_FILE))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded: the number of pieces, a digest of their ids, and whether the text came back."""
    decoded = pieces.encode_and_decode(documents(spark, sf_dir), pieces.load(PIECES_FILE), keep=["doc_id", "text"])
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_pieces"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("same_text"),
    )


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return kept_text(docs, line_dedup(docs)).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_text(personal_data(documents(spark, sf_dir)))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language_id(documents(spark, sf_dir))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir), keep="max")


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in URL_RULES]
    rules = spark.range(1).select(F.inline(F.array(*rows)))
    return url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards(documents(spark, sf_dir), 8)


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.centroid_clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _k_means_sql() -> str:
    """All rounds one after the other: cN are centroids, aN the nearest one of every vector."""
    parts = [
        f"""v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda c: CAST(floor({centroids.FACTOR} * CAST(c AS DOUBLE)) AS BIGINT)) AS x
            FROM embeddings WHERE len(embedding) = {centroids.SIZE} AND list_bool_and(list_transform(embedding, lambda c: coalesce(isfinite(c), FALSE))))""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS k, x AS c FROM (SELECT x, sha256('{centroids.SALT}' || vec_id) AS h FROM v ORDER BY h LIMIT {centroids.CENTROIDS}))",
    ]
    for i in range(centroids.ROUNDS + 1):
        away = "list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
        parts.append(f"a{i} AS MATERIALIZED (SELECT vec_id, any_value(x) AS x, arg_min(k, d * {centroids.CENTROIDS} + k) AS k, CAST(min(d) AS BIGINT) AS d FROM (SELECT vec_id, x, k, {away} AS d FROM v, c{i}) GROUP BY vec_id)")
        if i < centroids.ROUNDS:
            means = f"SELECT k, j, (s - (s % n + n) % n) // n AS m FROM (SELECT k, j, CAST(sum(x[j]) AS BIGINT) AS s, count(*) AS n FROM a{i}, range(1, {centroids.SIZE + 1}) t(j) GROUP BY k, j)"
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT k, list(m ORDER BY j) AS c FROM ({means}) GROUP BY k UNION ALL SELECT k, c FROM c{i} WHERE k NOT IN (SELECT k FROM a{i}))")
    last = centroids.ROUNDS
    return f"""WITH {", ".join(parts)}
        SELECT vec_id, CAST(k AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
        FROM a{last} JOIN c{last} USING (k)"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_token_counts": op2_token_counts,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_line_dedup": op4_line_dedup,
    "op5_pii": op5_pii,
    "op6_language_id": op6_language_id,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_url_filters": op8_url_filters,
    "op9_sharding": op9_sharding,
    "op10_ngram_join": op10_ngram_join,
    "op11_whitening": op11_whitening,
    "op12_centroid_clustering": op12_centroid_clustering,
    "op13_embedding_near_dedup": op13_embedding_near_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op4_line_dedup": """
        WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
        l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
        k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
        f AS (SELECT key, min(doc_id) AS first_id FROM k WHERE length(key) >= 10 GROUP BY key),
        m AS (SELECT k.*, coalesce(k.doc_id > f.first_id, FALSE) AS dropped FROM k LEFT JOIN f ON k.key = f.key)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
        FROM m GROUP BY doc_id
    """,
    "op7_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
        SELECT DISTINCT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(d.t) AS text_sha256
        FROM d JOIN g ON d.t = g.t
    """,
    "op8_url_filters": """
        WITH u AS (SELECT page_id,
            translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
            regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*(/[^?#]*)', 1, 's') AS path FROM pages),
        r(r_host, r_path, r_verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block'))
        SELECT page_id, host, path,
            (SELECT max_by(r_host || r_path, length(r_host || r_path)) FROM r WHERE (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)) AS rule,
            coalesce((SELECT max_by(r_verdict, length(r_host || r_path)) FROM r WHERE (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)), 'allow') AS verdict
        FROM u
    """,
    "op10_ngram_join": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_have FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        e AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * both_have >= 75 * (x.n + y.n - both_have)),
        r(doc_id, comp) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.comp FROM r JOIN e ON r.doc_id = e.a WHERE r.comp < e.b)
        SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(comp) AS component_id FROM r LEFT JOIN n ON r.doc_id = n.doc_id GROUP BY r.doc_id
    """,
    "op12_centroid_clustering": _k_means_sql(),
    "op13_embedding_near_dedup": """
        WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE list_bool_and(list_transform(embedding, lambda c: coalesce(isfinite(c), FALSE))) AND list_bool_or(list_transform(embedding, lambda c: c <> 0))),
        p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
        r(vec_id, comp) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT p.b, r.comp FROM r JOIN p ON r.vec_id = p.a WHERE r.comp < p.b),
        n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
        SELECT r.vec_id, coalesce(any_value(n.n), 0) AS n_links, min(comp) AS component_id, r.vec_id = min(comp) AS kept FROM r LEFT JOIN n ON r.vec_id = n.a GROUP BY r.vec_id
    """,
}
