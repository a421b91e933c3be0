"""The registered queries of the operators, each over its whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hard_negatives, hnsw, html_text, jaccard_join, packing, quality, sentence_pieces, token_counts, token_files, topk, toxicity, url_filter, vector_codes
from .graph import shared_folder

URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(docs, quality.grades(labels), 3)
    rated = quality.rate(docs.select("doc_id", "text"), model)
    return rated.select("doc_id", "rated.expected_grade", F.col("rated.tails")[0].alias("p_good"), F.col("rated.tails")[1].alias("p_clean"), (F.col("rated.tails")[0] >= 0.5).alias("kept"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled URLs are the pages whose page_id is a labelled doc_id; label 1 is toxic or of low quality."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    bad = F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1).when(F.col("toxic").isNotNull() & F.col("quality").isNotNull(), 0)
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), bad.alias("label"))
    url = F.col("url")
    labelled = pages.join(labels, "page_id").select(url_filter.tokens(url_filter.host_of(url), url_filter.path_of(url)).alias("tokens"), "label")
    return url_filter.judge(pages, URL_RULES, url_filter.mine(labelled)).drop("url")


OP2_SQL = """
WITH parsed AS (
  SELECT page_id, url, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
hp AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parsed),
fit AS (
  SELECT hp.*, CASE
    WHEN (host = 'example.net' OR suffix(host, '.example.net')) AND prefix(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND prefix(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR suffix(host, '.org')) AND prefix(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR suffix(host, '.net')) AND prefix(path, '/') THEN 'net/' END AS rule FROM hp),
tok AS (
  SELECT DISTINCT page_id, host, path, unnest(list_concat(list_transform(string_split(host, '.'), lambda x: 'h:' || x),
    list_transform(string_split(path, '/'), lambda x: 'p:' || regexp_replace(x, '[0-9]+', '#', 'g')))) AS t FROM hp),
tokens AS (SELECT * FROM tok WHERE length(t) > 2),
urls AS (SELECT page_id, list(t ORDER BY t) AS ts FROM tokens GROUP BY page_id),
labelled AS (
  SELECT page_id, ts, CASE WHEN toxic = 1 OR quality = 0 THEN 1 WHEN toxic IS NOT NULL AND quality IS NOT NULL THEN 0 END AS label FROM labels JOIN urls ON doc_id = page_id),
good AS (SELECT unnest(ts) AS t FROM labelled WHERE label = 1 GROUP BY t HAVING count(*) >= 20),
frequent AS (SELECT list(t) AS f FROM good),
parts AS (SELECT list_filter(ts, lambda x: list_contains(f, x)) AS p FROM labelled, frequent WHERE label = 1),
sets AS (SELECT list_filter(p, lambda x, i: (m >> (i - 1)) & 1 = 1) AS s FROM (SELECT p, unnest(range(1, (1 << len(p))::BIGINT)) AS m FROM parts)),
candidates AS (SELECT s, count(*) AS n1 FROM sets GROUP BY s HAVING count(*) >= 20),
rules AS (SELECT s FROM candidates LEFT JOIN labelled ON label = 0 AND list_has_all(ts, s) GROUP BY s, n1 HAVING n1 >= 0.6 * (n1 + count(label))),
hit AS (SELECT DISTINCT page_id FROM urls JOIN rules ON list_has_all(ts, s))
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
       WHEN page_id IN (SELECT page_id FROM hit) THEN 'block' ELSE 'allow' END AS verdict
FROM fit"""


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return hnsw.nearest(vectors, vectors.where("vec_id % 100 = 0"), 10)


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op6_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.digest(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path("piece_bpe_32k.model"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top(vectors, vectors.where("vec_id % 50 = 0"), 5)


OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON len(q.v) = len(c.v) AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s)
SELECT query_id, k::INTEGER AS rank, vec_id, score FROM r WHERE k <= 5"""


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = toxicity.score(docs.select("doc_id", "text"), toxicity.fit(docs, labels))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    counted = token_counts.count_tokens(docs, tokenizer_path("byte_bpe_50k.json"))
    return counted.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    token_files.write(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), folder, 2)
    return token_files.digest(token_files.read(spark, folder))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"))


OP12_SQL = """
WITH e AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.v, c.v)::BIGINT AS score
  FROM e a JOIN e c ON len(a.v) = len(c.v) AND a.vec_id <> c.vec_id WHERE a.vec_id % 50 = 0),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS k
  FROM p JOIN s USING (anchor_id) WHERE NOT s.same AND 100 * s.score BETWEEN 50 * positive_score AND 95 * positive_score)
SELECT anchor_id, positive_id, k::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE k <= 3"""


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


def queries() -> dict:
    first = (op1_quality, op2_url_filter, op3_nearest_neighbours, op4_html_text, op5_packing, op6_sentence_pieces, op7_jaccard_join)
    return {f.__name__: f for f in (*first, op8_exact_top_k, op9_toxicity, op10_token_counts, op11_token_files, op12_hard_negatives, op13_vector_codes)}


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filter": OP2_SQL, "op8_exact_top_k": OP8_SQL, "op12_hard_negatives": OP12_SQL, "op13_vector_codes": vector_codes.SQL}
