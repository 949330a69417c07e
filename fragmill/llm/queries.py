"""The registered queries of the training-data operators, over whole tables and with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=2, capacity=1024)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .shared import new_path
    from .token_file import digest_token_files, write_token_files

    path = new_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path, tokenizer_path("word_bpe_49k.json"), end_id=2)
    return digest_token_files(spark, path)


URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_trie import RULE_SCHEMA, filter_urls

    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = filter_urls(pages, spark.createDataFrame(URL_RULES, RULE_SCHEMA))
    return judged.select("page_id", "host", "path", "rule", "verdict")


OP5_SQL = """
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM u
), r(action, rule_host, rule_path) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
         ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), m AS (
  SELECT DISTINCT p.host, p.path, rule_host || rule_path AS rule, action,
         length(rule_host) + length(rule_path) AS n
  FROM p JOIN r ON (p.host = rule_host OR ends_with(p.host, '.' || rule_host)) AND starts_with(p.path, rule_path)
), b AS (
  SELECT host, path, arg_max(rule, n) AS rule, arg_max(action, n) AS action FROM m GROUP BY host, path
)
SELECT p.page_id, p.host, p.path, b.rule, coalesce(b.action, 'allow') AS verdict
FROM p LEFT JOIN b ON p.host = b.host AND p.path = b.path
"""


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import encode_and_decode

    return encode_and_decode(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract

    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .language_id import held_out, identify

    found = identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chosen_path import similarity_join

    return similarity_join(table(spark, sf_dir, "documents")).select("doc_id", "n_links", "class_id", "kept")


OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_split_to_array(trim(regexp_replace(lower(coalesce(text, '')), '\s+', ' ', 'g')), ' ') AS words FROM documents
), g AS (
  SELECT doc_id, unnest(list_distinct(list_transform(range(1, greatest(len(words) - 4, 1) + 1), lambda i: array_to_string(words[i:i + 4], ' ')))) AS gram
  FROM w WHERE words[1] <> ''
), n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
both_have AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (
  SELECT a, b FROM both_have JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 5 * k >= 4 * (x.n + y.n - k)
), r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.doc_id),
c AS (SELECT doc_id, min(root) AS class_id FROM r GROUP BY doc_id),
k AS (SELECT a AS doc_id, count(*) AS n_links FROM l GROUP BY a)
SELECT doc_id, coalesce(n_links, 0)::BIGINT AS n_links, class_id, doc_id = class_id AS kept FROM c LEFT JOIN k USING (doc_id)
"""


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_lines

    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .threshold_topk import exact_top_k

    return exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


OP4_SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM e q JOIN e c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
WHERE rank <= 5
"""


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .projection_forest import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


OP9_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS x, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS norm
  FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND a.norm > 0 AND b.norm > 0
  WHERE list_inner_product(a.x, b.x) / (a.norm * b.norm) >= 0.95
), r(vec_id, root) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.vec_id),
c AS (SELECT vec_id, min(root) AS component_id FROM r GROUP BY vec_id),
k AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN k USING (vec_id)
"""


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import dedup_substrings

    return dedup_substrings(table(spark, sf_dir, "documents"), length=50)


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .kd_clustering import cluster

    return cluster(table(spark, sf_dir, "embeddings"), clusters=8, rounds=10, seed=3, scale=1024, size=64)


def _op12_sql(clusters: int = 8, rounds: int = 10) -> str:
    """The rounds one after the other: every round's centroids are a table of (cluster, place, value)."""
    near = "SELECT x.row, arg_min(s.cluster, (s.distance, s.cluster)) AS cluster, min(s.distance) AS distance FROM (SELECT v.row, c.cluster, sum((v.x - c.x) * (v.x - c.x))::BIGINT AS distance FROM v JOIN c{r} c USING (place) GROUP BY ALL) s JOIN ids x USING (row) GROUP BY x.row"
    parts = [
        """kept AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda e: floor(1024 * e::DOUBLE)::BIGINT) AS xs
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
)""",
        "ids AS MATERIALIZED (SELECT row, vec_id FROM kept)",
        "v AS MATERIALIZED (SELECT row, unnest(range(64)) AS place, unnest(xs) AS x FROM kept)",
        f"starts AS (SELECT row, row_number() OVER (ORDER BY sha256('3:' || vec_id), xs) - 1 AS cluster FROM kept QUALIFY cluster < {clusters})",
        "c0 AS MATERIALIZED (SELECT cluster, place, x FROM starts JOIN v USING (row))",
    ]
    for r in range(rounds):
        parts.append(f"n{r} AS MATERIALIZED ({near.format(r=r)})")
        parts.append(
            f"c{r + 1} AS MATERIALIZED (SELECT cluster, place, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN"
            f" (SELECT cluster, place, (sum(v.x) - (((sum(v.x) % count(*)) + count(*)) % count(*))) // count(*) AS x FROM n{r} JOIN v USING (row) GROUP BY ALL) m USING (cluster, place))"
        )
    parts.append(f"last AS MATERIALIZED ({near.format(r=rounds)})")
    parts.append(f"names AS (SELECT cluster, sha256(string_agg(x::BIGINT::VARCHAR, ',' ORDER BY place)) AS centroid_sha256 FROM c{rounds} GROUP BY cluster)")
    return f"""
WITH {", ".join(parts)}
SELECT vec_id, cluster::INTEGER AS cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia,
       (sum(distance) OVER ())::BIGINT AS inertia, centroid_sha256
FROM last JOIN ids USING (row) JOIN names USING (cluster)
"""


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .resampling import resample

    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), longest=1, buckets=10_000, least_words=20, percent=10, seed=2024)


OP13_SQL = r"""
WITH crc_table AS MATERIALIZED (
  SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i) ORDER BY i) AS entries
  FROM (SELECT unnest(range(256)) AS i)
), d AS MATERIALIZED (
  SELECT row_number() OVER () AS row, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents
), dw AS MATERIALIZED (SELECT row, unnest(words) AS word FROM d),
bw AS MATERIALIZED (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word
  FROM benchmark
), spelled AS (
  SELECT word, hex(encode(word)) AS digits FROM (SELECT word FROM dw UNION SELECT word FROM bw)
), hashed AS MATERIALIZED (
  SELECT word, xor(4294967295, list_reduce(
    list_transform(range(1, len(digits), 2), lambda p: 16 * (strpos('0123456789ABCDEF', digits[p]) - 1) + strpos('0123456789ABCDEF', digits[p + 1]) - 1),
    lambda c, b: xor(c // 256, entries[xor(c % 256, b) + 1]), 4294967295)) % 10000 AS bucket
  FROM spelled, crc_table
), s AS (SELECT bucket, count(*) AS s FROM dw JOIN hashed USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM bw JOIN hashed USING (word) GROUP BY bucket),
g AS MATERIALIZED (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM dw) + 10000)::DOUBLE
                                 / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM bw) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM (SELECT unnest(range(10000)) AS bucket) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)
), f AS (
  SELECT row, count(*) AS n, sum(gain)::BIGINT AS total FROM dw JOIN hashed USING (word) JOIN g USING (bucket) GROUP BY row
), w AS (
  SELECT row, doc_id, coalesce(n, 0) AS n_features, CASE WHEN n IS NULL THEN 0 ELSE (total - (((total % n) + n) % n)) // n END AS weight,
         list_reduce(list_transform(range(1, 9), lambda p: strpos('0123456789abcdef', sha256('2024:' || doc_id)[p]) - 1), lambda a, b: 16 * a + b) AS h
  FROM d LEFT JOIN f USING (row)
), z AS (
  SELECT row, doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM w
), r AS (SELECT row, row_number() OVER (ORDER BY score DESC, doc_id, row) AS place FROM z WHERE n_features >= 20)
SELECT doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, score::BIGINT AS score,
       CASE WHEN place <= (SELECT 10 * count(*) // 100 FROM r) THEN place END AS rank
FROM z LEFT JOIN r USING (row)
"""


QUERIES = {f.__name__: f for f in (op1_best_fit_packing, op2_token_files, op3_ngram_join, op4_exact_top_k, op5_url_filters, op6_bpe, op7_line_dedup, op8_html_text, op9_embedding_dedup, op10_language_id, op11_substring_dedup, op12_centroid_clustering, op13_importance_resampling)}
ORACLES = {"op3_ngram_join": OP3_SQL, "op4_exact_top_k": OP4_SQL, "op5_url_filters": OP5_SQL, "op9_embedding_dedup": OP9_SQL, "op12_centroid_clustering": _op12_sql(), "op13_importance_resampling": OP13_SQL}
