"""The registered queries of the corpus operators, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from cashlens.llm import bpe, centroids, decontaminate, fingerprints, html_text, jaccard_join, pii, quality, secrets_scan, substring_dedup, toxicity, url_filter, vector_codes
from cashlens.llm.common import held_out, table, vocabulary
from cashlens.llm.vectors import FLOOR_DIV

PLANS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        PLANS[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return register


# ---------------------------------------------------------------- 2


@query("op2_quality")
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = quality.train(documents, table(spark, sf_dir, "labels"), "quality", max_rows=4000)
    graded = quality.grade(documents, model)
    return graded.withColumn("held_out", held_out(F.col("doc_id")))


# ---------------------------------------------------------------- 7


@query("op7_toxicity")
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    field = toxicity.train(documents, table(spark, sf_dir, "labels"), max_rows=3000)
    return toxicity.score(documents, field).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "toxic_spans",
    )


# ---------------------------------------------------------------- 8

URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]

OP8_SQL = r"""
WITH parts AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
found AS (
  SELECT page_id, host, path, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
    END AS rule
  FROM parts)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict
FROM found
"""


@query("op8_url_filter", OP8_SQL)
def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


# ---------------------------------------------------------------- 9

OP9_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item_words AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, w[i : i + least(10, len(w)) - 1] AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM item_words WHERE len(w) > 0)),
grams AS (
  SELECT doc_id, i, k, w[i : i + k - 1] AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i
        FROM words, (SELECT DISTINCT len(g) AS k FROM windows) WHERE len(w) >= k)),
found AS (SELECT doc_id, i, k, item_id FROM grams JOIN windows USING (g)),
hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM found)) GROUP BY doc_id),
items AS (SELECT doc_id, list_sort(list(DISTINCT item_id)) AS ids FROM found GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(len(ids), 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query("op9_decontaminate", OP9_SQL)
def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), unnamed=True)
    return found.select(
        "doc_id",
        "n_words",
        decontaminate.hit_words().alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


# ---------------------------------------------------------------- 10


@query("op10_bpe")
def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), vocabulary())


# ---------------------------------------------------------------- 3


@query("op3_secrets")
def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    ratios = secrets_scan.log_ratios(secrets_scan.training_samples(documents, max_rows=2000))
    found = secrets_scan.scan(documents, ratios)
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        count("assign"),
        count("access"),
        count("hex"),
        F.sha2(secrets_scan.as_text("base"), 256).alias("base_sha256"),
        secrets_scan.as_text("spans").alias("spans"),
    )


# ---------------------------------------------------------------- 1


@query("op1_main_text")
def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    model = html_text.train(pages, max_pages=150)
    return html_text.extract(pages, model).withColumn("n_chars", F.length("text").cast("bigint"))


# ---------------------------------------------------------------- 5


@query("op5_pii")
def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.extract(table(spark, sf_dir, "documents"))
    count = lambda i, kind: F.size(F.filter("base", lambda x: x["kind"] == i)).cast("bigint").alias(f"n_{kind}")
    # all spans by start; at one start the fixed kinds come first
    everything = f"""array_join(transform(array_sort(concat(
        transform(base, x -> struct(x.start as start, x.kind as rank, {pii.as_text("array(x)")}[0] as t)),
        transform(extra, x -> struct(x.start as start, x.kind + 4 as rank, {pii.as_text("array(x)", "context_")}[0] as t)))), x -> x.t), ',')"""
    return found.select(
        "doc_id",
        *[count(i, kind) for i, kind in enumerate(pii.KINDS)],
        F.sha2(F.expr(f"array_join({pii.as_text('base')}, ',')"), 256).alias("base_sha256"),
        F.expr(everything).alias("spans"),
    )


# ---------------------------------------------------------------- 6


@query("op6_fingerprints")
def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare(table(spark, sf_dir, "documents"))


# ---------------------------------------------------------------- 4


@query("op4_jaccard_join")
def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.groups(table(spark, sf_dir, "documents"))


# ---------------------------------------------------------------- 11


def lloyd_sql(rounds: int) -> str:
    """Lloyd's rounds over ``x`` (row, part, v) from ``c0`` (part, entry, c): one statement per round, ending in ``final``."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""d{r} AS MATERIALIZED (
  SELECT x.row, x.part, c.entry, list_sum(list_transform(list_zip(x.v, c.c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d
  FROM x JOIN c{r} c USING (part)),
a{r} AS MATERIALIZED (
  SELECT row, part, arg_min(entry, d * 256 + entry) AS entry, CAST(min(d) AS BIGINT) AS d FROM d{r} GROUP BY row, part)""")
        if r < rounds:
            mean = FLOOR_DIV.format(a="sum(u.v)", b="count(*)")
            steps.append(f"""m{r} AS MATERIALIZED (
  SELECT part, entry, list(m ORDER BY i) AS c FROM (
    SELECT u.part, u.entry, u.i, {mean} AS m FROM (
      SELECT a.part, a.entry, unnest(x.v) AS v, unnest(range(len(x.v))) AS i FROM a{r} a JOIN x USING (row, part)) u
    GROUP BY u.part, u.entry, u.i) GROUP BY part, entry),
c{r + 1} AS MATERIALIZED (
  SELECT part, entry, coalesce(m.c, c.c) AS c FROM c{r} c LEFT JOIN m{r} m USING (part, entry))""")
    return ",\n".join(steps) + f",\nfinal AS (SELECT * FROM a{rounds}), books AS (SELECT * FROM c{rounds})"


OP11_SQL = f"""
WITH x AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS row, vec_id, 0 AS part,
    list_transform(embedding, lambda e: CAST(floor(64 * CAST(e AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64),
c0 AS MATERIALIZED (
  SELECT 0 AS part, row_number() OVER (ORDER BY sha256('1:' || vec_id), row) - 1 AS entry, v AS c
  FROM x QUALIFY entry < 16),
{lloyd_sql(3)},
digests AS (SELECT entry, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM books)
SELECT vec_id, CAST(entry AS INTEGER) AS cluster, d AS distance,
  CAST(sum(d) OVER (PARTITION BY entry) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM final JOIN x USING (row) JOIN digests USING (entry)
"""


@query("op11_centroids", OP11_SQL)
def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


# ---------------------------------------------------------------- 12

OP12_SQL = r"""
WITH w AS (SELECT row_number() OVER () AS row, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
grams AS MATERIALIZED (
  SELECT row, doc_id, i, sha256(array_to_string(w[i : i + 12], ' ')) AS g FROM (
    SELECT row, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM w WHERE len(w) >= 13)),
first AS (SELECT g, min(doc_id) AS least FROM grams GROUP BY g),
gone AS (
  SELECT row, list(DISTINCT p) AS gone FROM (
    SELECT row, unnest(range(i, i + 13)) AS p FROM grams JOIN first USING (g) WHERE least < doc_id) GROUP BY row),
kept AS (
  SELECT row, string_agg(word, ' ' ORDER BY p) AS t FROM (
    SELECT row, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM w) LEFT JOIN gone USING (row)
  WHERE NOT coalesce(list_contains(gone, p), false) GROUP BY row)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN gone USING (row) LEFT JOIN kept USING (row)
"""


@query("op12_substring_dedup", OP12_SQL)
def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.dedup(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


# ---------------------------------------------------------------- 13

OP13_SQL = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS row, vec_id, label,
    list_transform(embedding, lambda e: CAST(floor(4096 * CAST(e AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = len(embedding)),
x AS MATERIALIZED (
  SELECT row, part, v[part * len(v) // 8 + 1 : (part + 1) * len(v) // 8] AS v FROM (SELECT row, v, unnest(range(8)) AS part FROM kept)),
c0 AS MATERIALIZED (SELECT part, row - 1 AS entry, v AS c FROM x WHERE row <= 16),
{lloyd_sql(6)},
codes AS (
  SELECT row, string_agg(printf('%02x', CAST(entry AS INTEGER)), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error
  FROM final GROUP BY row)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) FROM books) AS codebooks_sha256
FROM codes JOIN kept USING (row)
"""


@query("op13_vector_codes", OP13_SQL)
def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


# ---------------------------------------------------------------- all together


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)
