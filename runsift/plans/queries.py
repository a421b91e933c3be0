"""Registered queries of the library on the driver's tables, each with the SQL that gives the same rows.

documents stand for retrieval hits (source: instance, doc_id: position), labels for evaluation
results (quality, toxic: the two runs), conversations for transcripts, events for a run log and its
status, pages for paths, and customers by nation for groups of work.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import json_values, paths, pyast, rules, text
from ..operators import joins, metrics, ranking, schedule
from ..sources import records
from ..streaming import snapshot

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def outcome_of_labels():
    """Outcome of a labelled document: quality 0 is a failure before, toxic 1 one after."""
    return rules.pair_outcome(F.col("quality") == 0, F.col("toxic") == 1)


OUTCOME_SQL = "CASE WHEN quality = 0 AND NOT toxic = 1 THEN 'F2P_SUCCESS' WHEN NOT quality = 0 THEN 'BUGGY_PASS' WHEN toxic = 1 THEN 'FIXED_FAIL' ELSE 'UNKNOWN' END"


# -- metrics


@query(
    f"""WITH r AS (SELECT d.source, CASE WHEN l.doc_id IS NULL THEN 'NOT_EVALUATED' ELSE {OUTCOME_SQL} END AS status FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT status, count(*) AS n, count(*) FILTER (source = 'src0') AS n_first, count(*) * 1.0::DOUBLE / sum(count(*)) OVER () AS share FROM r GROUP BY status"""
)
def export_record_status(spark, sf):
    """Left join, outcome rule, status counts and share of all requested rows."""
    evaluated = table(spark, sf, "labels").select("doc_id", outcome_of_labels().alias("outcome"))
    rows = table(spark, sf, "documents").select("doc_id", "source").join(evaluated, "doc_id", "left")
    counts = rows.groupBy(rules.status_or(F.col("outcome"), "NOT_EVALUATED").alias("status")).agg(F.count("*").alias("n"), F.count_if(F.col("source") == "src0").alias("n_first"))
    # A window over the few statuses, not a second pass over the rows.
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))
    return counts.select("status", "n", "n_first", metrics.rate(F.col("n").cast("double"), total).alias("share"))


@query(
    f"""WITH r AS (SELECT {OUTCOME_SQL} AS status FROM labels)
SELECT count(*) AS total_instances, count(*) FILTER (status = 'F2P_SUCCESS') AS f2p_success, count(*) FILTER (status <> 'F2P_SUCCESS') AS f2p_fail,
  count(*) FILTER (status = 'F2P_SUCCESS')::DOUBLE / count(*) AS f2p_at_1, round(100.0::DOUBLE * (count(*) FILTER (status = 'F2P_SUCCESS')::DOUBLE / count(*)), 4) AS f2p_at_1_percent FROM r"""
)
def evaluation_metrics(spark, sf):
    return metrics.evaluation_metrics(table(spark, sf, "labels").select(outcome_of_labels().alias("status")))


@query(
    """WITH d AS (SELECT count(*) FILTER (quality = 1) AS ok, count(*) FILTER (quality = 0) AS error FROM labels),
s AS (SELECT count(*) AS skip FROM documents WHERE lang = 'en') SELECT (SELECT count(*) FROM documents) AS total, ok, error, skip FROM d, s"""
)
def run_summary(spark, sf):
    """Parts over two bases: what is on disk, and what this run skipped."""
    disk = table(spark, sf, "labels").select(F.when(F.col("quality") == 1, "PASS").otherwise("ERROR").alias("status"))
    docs = table(spark, sf, "documents")
    return metrics.run_summary(disk, docs.where("lang = 'en'"), docs)


@query("SELECT event_type AS value, count(*) AS n, min(event_id) AS first FROM events GROUP BY event_type")
def status_by_frequency(spark, sf):
    return metrics.by_frequency(table(spark, sf, "events"), "event_type", "event_id").withColumnRenamed("event_type", "value")


# -- ranking


@query(
    """WITH f AS (SELECT source, doc_id, text, row_number() OVER (PARTITION BY source, text ORDER BY doc_id) AS k FROM documents),
t AS (SELECT source, doc_id, md5(text) AS text_md5, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM f WHERE k = 1)
SELECT source, doc_id, text_md5 FROM t WHERE r <= 6"""
)
def hit_dedup_topk(spark, sf):
    """First hit of each text in a source, then the first six of the source."""
    docs = table(spark, sf, "documents").select("source", "doc_id", F.md5("text").alias("text_md5"))
    return ranking.dedup_top_k(docs, ["source"], [F.col("text_md5")], "doc_id", 6)


@query("SELECT source, min(doc_id) AS doc_id FROM documents GROUP BY source")
def topk_zero_keeps_one(spark, sf):
    """k = 0 still keeps one row."""
    docs = table(spark, sf, "documents").select("source", "doc_id")
    return ranking.dedup_top_k(docs, ["source"], [F.col("doc_id")], "doc_id", 0)


@query("SELECT user_id, min(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def last_wins_upsert(spark, sf):
    events = table(spark, sf, "events").select("user_id", "event_id", "event_type", "value")
    return ranking.last_wins(events, ["user_id"], "event_id")


def _relevance(spark, sf):
    docs = table(spark, sf, "documents").select("source", "doc_id", "lang", "text")
    files, names = F.array(*map(F.lit, ["src3", "src1", "src3"])), F.array(*map(F.lit, ["de", "en"]))
    apis = F.array(*map(F.lit, ["pkg.the", "pkg.mod.tion", "the", "zzqx"]))
    score = ranking.relevance(F.col("source"), F.col("lang"), F.col("text"), files, names, apis)
    return docs.select("source", "doc_id", score.cast("int").alias("score"))


RELEVANCE_SQL = """s AS (SELECT source, doc_id, (CASE source WHEN 'src3' THEN 98 WHEN 'src1' THEN 99 ELSE 0 END + CASE lang WHEN 'de' THEN 80 WHEN 'en' THEN 79 ELSE 0 END
  + 8 * (contains(text, 'the')::INT + contains(text, 'tion')::INT + contains(text, 'zzqx')::INT) + CASE WHEN text <> '' THEN 2 ELSE 0 END)::INT AS score FROM documents)"""


@query(f"WITH {RELEVANCE_SQL} SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id)::INT AS rank FROM s")
def relevance_rank(spark, sf):
    """Preferred files and names (the last index of a repeated one), API names in the text, completeness."""
    return ranking.ranked(_relevance(spark, sf), ["source"], "score", "doc_id")


@query(f"WITH {RELEVANCE_SQL} SELECT source, arg_max(doc_id, struct_pack(a := score, b := -doc_id)) AS doc_id, max(score) AS score FROM s GROUP BY source")
def relevance_select(spark, sf):
    return ranking.best_by(_relevance(spark, sf), ["source"], F.col("score"), "doc_id")


@query(
    """WITH s AS (SELECT user_id, event_id, CASE event_type WHEN 'purchase' THEN 300 WHEN 'click' THEN 200 WHEN 'view' THEN 100 ELSE 10 END AS score FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, event_id) AS n FROM s) SELECT user_id, event_id, score FROM r WHERE n = 1"""
)
def best_attempt(spark, sf):
    """The best score, of equal ones the earliest attempt."""
    kind = F.col("event_type")
    score = rules.first_match([(kind == "purchase", 300), (kind == "click", 200), (kind == "view", 100)], 10)
    return ranking.best_by(table(spark, sf, "events").select("user_id", "event_id", score.alias("score")), ["user_id"], F.col("score"), "event_id")


@query(
    """WITH t AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events), f AS (SELECT * FROM t WHERE n <= 3),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN value > 50 THEN n ELSE 100 - n END) AS k FROM f)
SELECT user_id, event_id, value > 50 AS ok, value > 50 AND n > 1 AS fallback FROM r WHERE k = 1"""
)
def seed_fallback(spark, sf):
    """The first good one of three tries, else the last."""
    events = table(spark, sf, "events").select("user_id", "event_id", (F.col("value") > 50).alias("ok"))
    return ranking.first_ok_or_last(events, ["user_id"], "ok", "event_id")


@query(
    """WITH m AS (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS n FROM documents)
SELECT doc_id, CASE WHEN n > 1 THEN 'DUPLICATE' ELSE 'NEW' END AS status FROM m"""
)
def signature_dedup(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", "lang", F.lit("NEW").alias("status"))
    return ranking.first_of_signature(docs, ["source"], F.to_json(F.struct("lang")), "doc_id").select("doc_id", "status")


@query(
    """WITH b AS (SELECT ts, user_id, event_type, replace(CASE WHEN props <> '' THEN props ELSE event_type END, chr(10), ' ')[1:240] AS reason FROM events WHERE event_type NOT IN ('purchase', 'view'))
SELECT epoch_us(ts) AS mtime, user_id::VARCHAR AS instance_id, event_type AS status, reason FROM b ORDER BY ts DESC, user_id::VARCHAR DESC, event_type DESC, reason DESC LIMIT 10"""
)
def recent_failures_topk(spark, sf):
    events = table(spark, sf, "events")
    rows = events.select(F.unix_micros(F.col("ts").cast("timestamp")).alias("mtime"), F.col("user_id").cast("string").alias("instance_id"), F.col("event_type").alias("status"), F.col("props").alias("final_reason"), F.lit(None).cast("string").alias("notes"), F.col("event_type").alias("error"))
    return snapshot.recent_failures(rows, 10, ("purchase", "view"))


# -- plans of work


@query(
    """WITH t AS (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS turn, min(doc_id) OVER (PARTITION BY source) AS first FROM documents)
SELECT doc_id, turn::INT AS turn, first FROM t"""
)
def round_robin_interleave(spark, sf):
    """Turn and first place of each row; ordered by both, the sources take turns."""
    return schedule.interleaved(table(spark, sf, "documents").select("doc_id", "source"), "source", "doc_id").drop("source")


@query(
    """WITH RECURSIVE g AS (SELECT c_nationkey AS grp, count(*) AS n, min(c_custkey) AS first FROM customer GROUP BY 1),
o AS (SELECT *, row_number() OVER (ORDER BY n DESC, first) AS i FROM g),
p(i, grp, n, worker, loads) AS (
  SELECT 0::BIGINT, NULL::INTEGER, NULL::BIGINT, NULL::INTEGER, [0, 0, 0, 0]::BIGINT[]
  UNION ALL
  SELECT o.i, o.grp, o.n, (list_position(p.loads, list_min(p.loads)) - 1)::INTEGER,
    list_transform(p.loads, lambda v, k: CASE WHEN k = list_position(p.loads, list_min(p.loads)) THEN v + o.n ELSE v END)
  FROM p JOIN o ON o.i = p.i + 1)
SELECT grp, n, worker FROM p WHERE i > 0"""
)
def pack_groups(spark, sf):
    """Largest group first, each to the least loaded of four workers."""
    sizes = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("grp")).agg(F.count("*").alias("n"), F.min("c_custkey").alias("first"))
    return schedule.packed_groups(sizes, 4)


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def resume_pending(spark, sf):
    """Documents without a finished record."""
    return joins.pending(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), "doc_id", F.col("quality") == 1)


@query("SELECT doc_id, doc_id IN (SELECT doc_id FROM labels) AS completed FROM documents")
def completed_missing(spark, sf):
    return joins.with_presence(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), "doc_id", "completed")


# -- assembly


@query(
    """SELECT d.doc_id, coalesce(nullif(CASE WHEN d.lang = 'en' THEN '' ELSE d.lang END, ''), l.q, '') AS lang, d.source FROM documents d
LEFT JOIN (SELECT doc_id, 'q' || quality AS q FROM labels) l USING (doc_id)"""
)
def patch_fill(spark, sf):
    """Empty values filled from another table; null and '' are empty."""
    docs = table(spark, sf, "documents").select("doc_id", F.when(F.col("lang") == "en", "").otherwise(F.col("lang")).alias("lang"), "source")
    other = table(spark, sf, "labels").select("doc_id", F.concat(F.lit("q"), F.col("quality").cast("string")).alias("lang"))
    return joins.filled(docs, other, "doc_id", ["lang"])


@query(
    """WITH c AS (SELECT conv_id, list({'turn': turn, 'role': role} ORDER BY turn, role) AS turns FROM (SELECT DISTINCT conv_id, turn, role FROM conversations) GROUP BY conv_id),
h AS (SELECT doc_id % 1000 AS conv_id, count(*) AS hits, string_agg(lang, ',' ORDER BY doc_id, lang) AS langs FROM documents GROUP BY 1)
SELECT d.conv_id, coalesce(array_to_string(list_transform(c.turns, lambda x: x.role), ','), '') AS roles, coalesce(h.hits, 0) AS hits, coalesce(h.langs, '') AS langs
FROM (SELECT DISTINCT conv_id FROM conversations) d LEFT JOIN c USING (conv_id) LEFT JOIN h USING (conv_id)"""
)
def context_assembly(spark, sf):
    """Both sides collected in order before they are joined, so rows do not multiply."""
    talk = table(spark, sf, "conversations").select("conv_id", "turn", "role").distinct()
    hits = table(spark, sf, "documents").select((F.col("doc_id") % 1000).alias("conv_id"), "doc_id", "lang")
    turns, found = joins.collected(talk, "conv_id", "turn", ["role"], "turns"), joins.collected(hits, "conv_id", "doc_id", ["lang"], "hits")
    both = joins.with_context(talk.select("conv_id").distinct(), [(turns, "turns"), (found, "hits")], "conv_id")
    joined = lambda c, f: F.array_join(F.transform(c, lambda x: x[f]), ",")
    return both.select("conv_id", joined("turns", "role").alias("roles"), F.size("hits").cast("long").alias("hits"), joined("hits", "lang").alias("langs"))


@query("SELECT doc_id, lang FROM documents")
def leak_guard(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", F.col("text").alias("issue_text"), F.col("source").alias("patch"))
    return joins.without_answers(docs)


@query(
    f"""SELECT d.doc_id AS instance_id, d.text <> '' AS generated, l.doc_id IS NOT NULL AS evaluated, CASE WHEN l.doc_id IS NOT NULL THEN {OUTCOME_SQL} END AS formal_status,
  coalesce(l.doc_id IS NOT NULL AND {OUTCOME_SQL} = 'F2P_SUCCESS', false) AS is_f2p_success,
  CASE WHEN l.doc_id IS NULL THEN NULL WHEN {OUTCOME_SQL} = 'F2P_SUCCESS' THEN NULL ELSE {OUTCOME_SQL} END AS failure_category FROM documents d LEFT JOIN labels l USING (doc_id)"""
)
def export_records(spark, sf):
    """The nested record of every id, flattened for comparison."""
    docs = table(spark, sf, "documents").withColumnRenamed("doc_id", "instance_id")
    text_of = lambda n: F.lit(None).cast("string").alias(n)
    summaries = docs.where("instance_id % 2 = 0").select("instance_id", text_of("status"), F.lit(0).alias("rounds_used"), F.lit(0).alias("returncode"), text_of("stdout"), text_of("stderr"), text_of("strict_failure_class"), text_of("error"))
    evaluations = table(spark, sf, "labels").select(F.col("doc_id").alias("instance_id"), outcome_of_labels().alias("status"), text_of("buggy_status"), text_of("fixed_status"))
    rankings = docs.where("instance_id % 3 = 0").select("instance_id", F.lit(0).alias("selected_attempt"), F.lit(0).alias("candidates"))
    tests = docs.select("instance_id", F.lit("t.py").alias("path"), F.col("text").alias("content"))
    record = joins.export_record(docs, summaries, evaluations, rankings, tests)
    return record.select("instance_id", F.coalesce("generated", F.lit(False)).alias("generated"), "evaluated", F.col("formal_evaluation.status").alias("formal_status"), "formal_evaluation.is_f2p_success", "formal_evaluation.failure_category")


# -- text


@query(
    """SELECT doc_id, md5(CASE WHEN length(text) <= 500 THEN text ELSE substr(text, 1, 250) || chr(10) || '...[TRUNCATED]...' || chr(10) || right(text, 250) END) AS short_md5,
  md5(CASE WHEN length(text) <= 5 THEN text ELSE substr(text, 1, 2) || chr(10) || '...[TRUNCATED]...' || chr(10) || right(text, 3) END) AS tiny_md5 FROM documents"""
)
def truncate_middle(spark, sf):
    short = lambda n: F.md5(text.shorten_middle(F.col("text"), n))
    return table(spark, sf, "documents").select("doc_id", short(500).alias("short_md5"), short(5).alias("tiny_md5"))


@query(r"SELECT doc_id, md5(right(regexp_replace(text || chr(10) || source || chr(10), '^\s+|\s+$', '', 'g'), 400)) AS excerpt_md5 FROM documents")
def tail_excerpt(spark, sf):
    got = text.tail_excerpt(F.col("text"), F.col("source"), F.lit(None).cast("string"), limit=400)
    return table(spark, sf, "documents").select("doc_id", F.md5(got).alias("excerpt_md5"))


@query(
    """WITH l AS (SELECT doc_id, CASE WHEN text = '' THEN []::VARCHAR[] WHEN suffix(text, chr(10)) THEN string_split(left(text, -1), chr(10)) ELSE string_split(text, chr(10)) END AS lines FROM documents)
SELECT doc_id, md5(coalesce(array_to_string(list_slice(lines, -3, -1), chr(10)), CASE WHEN lines IS NOT NULL THEN '' END)) AS last_md5, len(lines) AS n FROM l"""
)
def last_lines(spark, sf):
    """Every document; a final line feed begins no line."""
    return table(spark, sf, "documents").select("doc_id", F.md5(text.last_lines(F.col("text"), 3)).alias("last_md5"), F.size(text.lines_of(F.col("text"))).cast("long").alias("n"))


@query("SELECT page_id, regexp_replace(url, '[^0-9A-Za-z_]+', '_', 'g') AS name FROM pages")
def sanitize_ids(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.sanitized(F.col("url")).alias("name"))


@query("SELECT p_partkey, 'setup_' || replace(p_brand, '#', '_') || '_' || p_type || '__' || p_size AS name, 'python -m pip install --ignore-installed --no-deps -e .' AS setup FROM part")
def env_name(spark, sf):
    repo = F.concat(F.replace("p_brand", F.lit("#"), F.lit("_")), F.lit("/"), F.col("p_type"))
    return table(spark, sf, "part").select("p_partkey", text.environment_name(repo, F.col("p_size").cast("string")).alias("name"), rules.setup_command(repo, F.lit("1")).alias("setup"))


@query(
    """WITH r AS (SELECT c_custkey, ['django/django', 'mwaskom/seaborn', 'a/requests', 'x/other'][1 + (c_custkey % 4)::INT] AS repo, 'tests/a/test_' || c_custkey || '.py' AS f FROM customer)
SELECT c_custkey, CASE repo WHEN 'django/django' THEN './tests/runtests.py --settings=test_sqlite a.test_' || c_custkey || '.T.test_x'
  WHEN 'mwaskom/seaborn' THEN 'pytest --no-header --show-capture=no --disable-warnings ' || f || '::T::test_x'
  WHEN 'a/requests' THEN 'python -m pytest --no-header --tb=short --show-capture=no --disable-warnings -p no:cacheprovider ' || f || '::T::test_x' END AS command FROM r"""
)
def command_label(spark, sf):
    names = F.array(*map(F.lit, ["django/django", "mwaskom/seaborn", "a/requests", "x/other"]))
    repo = F.element_at(names, (F.col("c_custkey") % 4 + 1).cast("int"))
    file = F.concat(F.lit("tests/a/test_"), F.col("c_custkey").cast("string"), F.lit(".py"))
    return table(spark, sf, "customer").select("c_custkey", rules.test_command(repo, file, F.lit("T::test_x")).alias("command"))


@query(
    """SELECT event_id, CASE WHEN w IN ('1', 'true', 'yes', 'on') THEN true WHEN w IN ('0', 'false', 'no', 'off') THEN false END AS run, CASE WHEN w IN ('yes', 'true', 't', 'y', '1') THEN true WHEN w IN ('no', 'false', 'f', 'n', '0') THEN false END AS shell
FROM (SELECT event_id, ['yes', 'off', 'T', '0', 'maybe'][1 + (event_id % 5)::INT] AS raw, lower(raw) AS w FROM events)"""
)
def parsed_words(spark, sf):
    word = F.element_at(F.array(*map(F.lit, ["yes", "off", "T", "0", "maybe"])), (F.col("event_id") % 5 + 1).cast("int"))
    return table(spark, sf, "events").select("event_id", text.parsed_bool(word, "run").alias("run"), text.parsed_bool(word, "shell").alias("shell"))


# -- rules


@query(
    """WITH e AS (SELECT event_id, event_id % 3 AS code, event_id % 7 = 0 AS late, ['SyntaxError: x', 'NameError: y', 'fixture a', 'collected 0 items', 'AssertionError', 'frobnicate failed', 'other'][1 + (event_id % 7)::INT] AS out FROM events)
SELECT event_id, CASE WHEN late THEN 'TIMEOUT' WHEN code = 0 THEN 'PASS' WHEN out LIKE 'Syntax%' THEN 'SYNTAX_ERROR' WHEN out LIKE 'Name%' OR out LIKE 'fixture%' THEN 'SETUP_ERROR' WHEN out LIKE 'coll%' THEN 'COLLECT_ERROR'
  WHEN out LIKE 'frob%' THEN 'ISSUE_ALIGNED_FAIL' WHEN out LIKE 'Assert%' THEN 'ASSERTION_FAIL' ELSE 'UNRELATED_FAIL' END AS status FROM e"""
)
def classify_log(spark, sf):
    logs = F.array(*map(F.lit, ["SyntaxError: x", "NameError: y", "fixture a", "collected 0 items", "AssertionError", "frobnicate failed", "other"]))
    out = F.element_at(logs, (F.col("event_id") % 7 + 1).cast("int"))
    terms = rules.issue_terms(F.array(F.lit("pkg.frobnicate")), F.lit("wrong sum"))
    status = rules.execution_status(F.col("event_id") % 3, rules.lowered(out, F.lit("")), F.col("event_id") % 7 == 0, F.lit("wrong sum"), terms)
    return table(spark, sf, "events").select("event_id", status.alias("status"))


@query(
    """WITH e AS (SELECT event_id, event_id % 3 AS code, ['IndentationError', 'ImportError', 'page not found', 'boom'][1 + (event_id % 4)::INT] AS err FROM events),
s AS (SELECT event_id, err, CASE WHEN code = 0 THEN 'PASS' WHEN err LIKE 'Ind%' THEN 'SYNTAX_ERROR' WHEN err LIKE 'Imp%' THEN 'SETUP_ERROR' WHEN err LIKE '%not found' THEN 'COLLECT_ERROR' ELSE 'FAIL' END AS status FROM e)
SELECT event_id, status, status <> 'PASS' AS failed, 'out' || chr(10) || err AS error_excerpt FROM s"""
)
def classify_run(spark, sf):
    err = F.element_at(F.array(*map(F.lit, ["IndentationError", "ImportError", "page not found", "boom"])), (F.col("event_id") % 4 + 1).cast("int"))
    got = rules.run_result(F.col("event_id") % 3, F.lit("out"), err, F.lit(False))
    return table(spark, sf, "events").select("event_id", got.alias("r")).select("event_id", "r.*")


STATUSES = ["F2P_SUCCESS", "BUGGY_PASS", "FIXED_FAIL", "PATCHED_FAIL", "PATCH_APPLY_ERROR", "BUGGY_SETUP_ERROR", "COLLECT_ERROR", "TIMEOUT", "ERROR", "WEIRD", ""]
STATUS_SQL = "['" + "', '".join(STATUSES) + f"'][1 + (event_id % {len(STATUSES)})::INT]"


def _status():
    return F.element_at(F.array(*map(F.lit, STATUSES)), (F.col("event_id") % len(STATUSES) + 1).cast("int"))


@query(
    f"""SELECT event_id, s, CASE WHEN s IN ('', 'F2P_SUCCESS') THEN NULL WHEN s = 'PATCHED_FAIL' THEN 'FIXED_FAIL' WHEN s = 'BUGGY_SETUP_ERROR' THEN 'SETUP_ERROR' WHEN s = 'WEIRD' THEN 'UNRELATED_FAIL' ELSE s END AS category
FROM (SELECT event_id, {STATUS_SQL} AS s FROM events)"""
)
def failure_category(spark, sf):
    return table(spark, sf, "events").select("event_id", _status().alias("s")).withColumn("category", rules.failure_category(F.col("s")))


@query(
    f"""SELECT CASE WHEN s = '' THEN 'UNKNOWN' WHEN s IN ('BUGGY_SETUP_ERROR', 'COLLECT_ERROR', 'TIMEOUT') THEN 'ENV_OR_COLLECT' ELSE s END AS category, count(*) AS n
FROM (SELECT event_id, {STATUS_SQL} AS s FROM events) GROUP BY 1"""
)
def formal_category(spark, sf):
    return table(spark, sf, "events").groupBy(rules.formal_category(_status()).alias("category")).agg(F.count("*").alias("n"))


@query(
    """SELECT doc_id, CASE WHEN quality = 1 AND toxic = 1 THEN 300 WHEN quality = 0 AND doc_id % 2 = 0 THEN 200 WHEN quality = 0 THEN 100 ELSE 10 END AS score,
  CASE WHEN quality = 1 AND toxic = 1 THEN 'F2P_SUCCESS' WHEN doc_id % 2 = 0 THEN 'ISSUE_ALIGNED_FAIL' WHEN quality = 0 THEN 'UNRELATED_FAIL' ELSE 'PASS' END AS final FROM labels"""
)
def final_status(spark, sf):
    code, decision = F.when(F.col("quality") == 0, 1).otherwise(0), F.when(F.col("doc_id") % 2 == 0, "accept").otherwise("reject")
    dual = F.when((F.col("quality") == 1) & (F.col("toxic") == 1), "F2P_SUCCESS")
    status = F.when(code == 0, "PASS").otherwise("ASSERTION_FAIL")
    score = rules.checkpoint_score(code, status, decision, dual)
    return table(spark, sf, "labels").select("doc_id", score["score"].alias("score"), rules.final_status(code, status, decision, dual).alias("final"))


@query(
    """SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'repair_trigger' WHEN toxic = 1 THEN 'repair_trigger' WHEN quality = 0 THEN 'repair_oracle' WHEN doc_id % 3 = 0 THEN 'repair_oracle' ELSE 'accept' END AS decision,
  CASE WHEN doc_id % 5 = 0 THEN 'issue_aligned' WHEN toxic = 1 THEN 'target_not_hit' WHEN quality = 0 THEN 'oracle_wrong' WHEN doc_id % 3 = 0 THEN 'oracle_too_strong' ELSE 'issue_aligned' END AS failure_class FROM labels"""
)
def strict_gate(spark, sf):
    decision = F.when(F.col("doc_id") % 5 == 0, "nonsense").otherwise("accept")
    got = rules.strict_gate(decision, F.lit("issue_aligned"), F.col("toxic") == 0, F.col("quality") == 1, F.col("doc_id") % 3 != 0, F.lit(1), F.lit("ASSERTION_FAIL"))
    return table(spark, sf, "labels").select("doc_id", got.alias("g")).select("doc_id", "g.*")


@query(
    """SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'repair_setup' WHEN 1 THEN 'repair_setup' WHEN 2 THEN 'repair_setup' WHEN 3 THEN 'reject' WHEN 4 THEN 'repair_trigger' END AS decision,
  CASE doc_id % 6 WHEN 0 THEN 'setup' WHEN 1 THEN 'syntax' WHEN 2 THEN 'collect' WHEN 3 THEN 'timeout' WHEN 4 THEN 'buggy_pass' END AS failure_class FROM labels"""
)
def forced_decision(spark, sf):
    status = F.element_at(F.array(*map(F.lit, [*rules.FORCED, "OTHER"])), (F.col("doc_id") % 6 + 1).cast("int"))
    got = rules.forced_decision(status)
    return table(spark, sf, "labels").select("doc_id", got["decision"].alias("decision"), got["failure_class"].alias("failure_class"))


# -- paths


PATH_SQL = "regexp_extract(url, '^[a-z]+://[^/]*/(.*)$', 1)"


@query(
    f"""WITH p AS (SELECT page_id, {PATH_SQL} AS path FROM pages)
SELECT page_id, path, CASE WHEN path = '' OR path LIKE '/%' THEN 'unsafe' WHEN path LIKE 'de/%' AND page_id % 4 = 0 THEN 'no_op' END AS refusal FROM p"""
)
def safe_path_filter(spark, sf):
    path = F.regexp_extract("url", "^[a-z]+://[^/]*/(.*)$", 1)
    replace = F.when(path.startswith("de/") & (F.col("page_id") % 4 == 0), "a").otherwise("b")
    refusal = paths.patch_refusal(path, F.lit("a"), replace, F.lit("x.py"), F.array().cast("array<string>"))
    return table(spark, sf, "pages").select("page_id", path.alias("path"), refusal.alias("refusal"))


@query(
    f"""WITH h AS (SELECT page_id, 'old/' || page_id || '.py b/' || {PATH_SQL} AS head FROM pages),
p AS (SELECT page_id, regexp_extract(head, '(.*) b/(.*)', 1) AS old, regexp_extract(head, '(.*) b/(.*)', 2) AS new FROM h)
SELECT page_id, list_sort(list_distinct([old, new])) AS files, [x FOR x IN [new] IF NOT regexp_matches(x, '(\\.json|\\.png|csv|\\.txt|\\.md)$')] AS directives, page_id % 2 = 0 AS rebuild FROM p"""
)
def changed_files(spark, sf):
    """Every page; a header is cut at its last ' b/'."""
    path = F.regexp_extract("url", "^[a-z]+://[^/]*/(.*)$", 1)
    patch = F.concat(F.lit("diff --git a/old/"), F.col("page_id").cast("string"), F.lit(".py b/"), path, F.lit("\n+++ b/src/x."), F.when(F.col("page_id") % 2 == 0, "pyx").otherwise("py"), F.lit("\n"))
    return table(spark, sf, "pages").select("page_id", paths.changed_files(patch).alias("files"), paths.directives(patch, F.lit("a/b")).alias("directives"), paths.needs_rebuild(patch).alias("rebuild"))


@query("SELECT page_id, 'tests/test_brt_' || regexp_replace(url, '[^0-9A-Za-z_]+', '_', 'g') || '.py' AS plain, 'a/b/test_brt_' || regexp_replace(url, '[^0-9A-Za-z_]+', '_', 'g') || '.py' AS beside FROM pages")
def generated_paths(spark, sf):
    made = lambda host: paths.generated_test_path(F.col("url"), F.lit(host))
    return table(spark, sf, "pages").select("page_id", made("").alias("plain"), made("a/b/host.py").alias("beside"))


@query("SELECT doc_id, ((length(text) - length(replace(text, 'th', ''))) / 2)::INT AS n FROM documents")
def literal_occurrences(spark, sf):
    return table(spark, sf, "documents").select("doc_id", paths.occurrences(F.col("text"), F.lit("th")).alias("n"))


# -- snapshots and transcripts


@query("SELECT event_type, count(*) AS n, epoch_us(max(ts)) AS newest FROM events GROUP BY event_type")
def status_snapshot(spark, sf):
    got = snapshot.status_totals(table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return got.withColumn("newest", F.unix_micros("newest"))


@query("SELECT event_type, count(*) AS n, epoch_us(max(ts)) AS newest FROM events GROUP BY event_type")
def stream_snapshot(spark, sf):
    """The same by a stream over the files that are there, from its final state."""
    import uuid

    folder = f"{records.shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    totals = snapshot.status_totals(snapshot.event_stream(spark, f"{sf}/events[.]parquet"))
    return snapshot.drained(totals, f"{folder}/out", f"{folder}/state").withColumn("newest", F.unix_micros("newest"))


@query("SELECT count(*) FILTER (event_type = 'click') AS running, count(*) FILTER (value > 50) AS tests, count(*) FILTER (user_id % 2 = 0) AS summaries, epoch_us(max(ts)) AS newest FROM events")
def monitor_counters(spark, sf):
    folders = table(spark, sf, "events").select((F.col("event_type") == "click").alias("running"), (F.col("value") > 50).alias("has_test"), (F.col("user_id") % 2 == 0).alias("has_summary"), F.col("ts").cast("timestamp").alias("mtime"))
    return snapshot.counters(folders).withColumn("newest", F.unix_micros("newest"))


@query(
    """SELECT user_id AS run_id, CASE WHEN bool_or(event_type = 'purchase') THEN '完成' WHEN bool_or(event_type = 'click') THEN '导出' WHEN bool_or(event_type = 'view') THEN '正式评测' ELSE 'BRT 生成' END AS phase FROM events GROUP BY user_id"""
)
def phase(spark, sf):
    kind = F.col("event_type")
    marker = F.when(kind == "purchase", "export.done").when(kind == "click", "evaluation.done").when(kind == "view", "generation.done").otherwise(".running")
    return snapshot.phases(table(spark, sf, "events").select(F.col("user_id").alias("run_id"), marker.alias("marker")))


@query("SELECT role, count(*) AS n, count(DISTINCT conv_id) AS conversations, max(turn) AS last_turn FROM conversations GROUP BY role")
def transcript_profile(spark, sf):
    return table(spark, sf, "conversations").groupBy("role").agg(F.count("*").alias("n"), F.countDistinct("conv_id").alias("conversations"), F.max("turn").alias("last_turn"))


@query(
    """WITH u AS (SELECT conv_id, turn, min(role) AS role FROM conversations GROUP BY 1, 2)
SELECT conv_id, turn, array_to_string(list_concat(coalesce(list(role) OVER (w ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), []), coalesce(list(role) OVER (w ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), [])), ',') AS around
FROM u WINDOW w AS (PARTITION BY conv_id ORDER BY turn)"""
)
def adjacent_turns(spark, sf):
    turns = table(spark, sf, "conversations").groupBy("conv_id", "turn").agg(F.min("role").alias("role"))
    return ranking.neighbours(turns, ["conv_id"], "turn", "role").select("conv_id", "turn", F.array_join("around", ",").alias("around"))


@query(
    """SELECT DISTINCT a.conv_id AS id, a.turn AS turn, 'f' || a.turn AS argument, md5(b.text) AS result_md5 FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant'"""
)
def call_result_pairing(spark, sf):
    """Calls in one message and results in another, paired by id."""
    rows = table(spark, sf, "conversations").select(F.col("conv_id").alias("id"), "turn", "role", "text")
    call = F.struct((F.col("turn") + 1).cast("string").alias("id"), F.lit("function").alias("type"), F.struct(F.lit("read").alias("name"), F.to_json(F.struct(F.concat(F.lit("f"), F.col("turn").cast("string")).alias("file_path"))).alias("arguments")).alias("function"))
    messages = rows.select("id", F.when(F.col("role") == "assistant", "tool").otherwise(F.col("role")).alias("role"), F.col("text").alias("content"), F.col("turn").cast("string").alias("tool_call_id"), F.when(F.col("role") == "user", F.array(call)).alias("tool_calls"))
    got = joins.paired_calls(messages)
    return got.select("id", (F.col("call_id").cast("long") - 1).alias("turn"), "argument", F.md5("result").alias("result_md5")).distinct()


# -- JSON


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_bag_extract(spark, sf):
    return table(spark, sf, "events").select("event_id", F.try_variant_get(json_values.json_object(F.concat(F.lit("noise "), F.col("props"), F.lit(" tail"))), "$.k", "long").alias("k"))


@query("SELECT event_id, event_id::VARCHAR AS last_b, NULL::VARCHAR AS last_a, '1' AS merged_a, event_id::VARCHAR AS merged_b FROM events")
def observation_blocks(spark, sf):
    """Of two blocks the last alone, and both merged."""
    log = F.concat(F.lit('BRT_OBS_START {"a": 1, "b": 0} BRT_OBS_END\nBRT_OBS_START {"b": '), F.col("event_id").cast("string"), F.lit("} BRT_OBS_END"))
    last, merged = json_values.last_observation(log, F.lit("")), json_values.merged_observations(log)
    # Both maps are made once, in a projection of their own.
    read = table(spark, sf, "events").select("event_id", last.alias("last"), merged.alias("merged"))
    return read.select("event_id", F.col("last.b").alias("last_b"), F.col("last.a").alias("last_a"), F.col("merged.a").alias("merged_a"), F.col("merged.b").alias("merged_b"))


@query(
    """SELECT doc_id, CASE WHEN lang = 'en' THEN ['OPERATOR_FLIP'] ELSE ['CALL_CHAIN_EXTEND'] END AS mutation_ops, CASE WHEN source IN ('src0', 'src1') THEN 'low' ELSE 'medium' END AS risk FROM documents"""
)
def plan_normalize(spark, sf):
    ops = F.array(F.lit("X"), F.when(F.col("lang") == "en", "OPERATOR_FLIP").otherwise("Y"))
    got = json_values.normalized_plan(ops, F.when(F.col("source").isin("src0", "src1"), "LOW").otherwise(F.col("source")))
    return table(spark, sf, "documents").select("doc_id", got.alias("p")).select("doc_id", "p.*")


@query("SELECT doc_id, CASE WHEN lang = 'en' THEN ['en', source] ELSE [lang, 'en', source] END AS names FROM documents")
def ordered_union(spark, sf):
    return table(spark, sf, "documents").select("doc_id", joins.ordered_union(F.array("lang", F.lit("en")), F.array(F.lit("en"), "source")).alias("names"))


@query(
    """SELECT c_custkey, CASE WHEN c_nationkey % 3 = 0 THEN 'direct_b_setup_x' WHEN c_nationkey % 3 = 1 THEN 'zz_setup_y' ELSE 'setup_none' END AS environment FROM customer"""
)
def environment_match(spark, sf):
    names = F.array(*map(F.lit, ["zz_setup_x", "direct_b_setup_x", "a_setup_y", "zz_setup_y"]))
    wanted = F.element_at(F.array(*map(F.lit, ["setup_x", "setup_y", "setup_none"])), F.col("c_nationkey") % 3 + 1)
    got = joins.environment_match(table(spark, sf, "customer").select("c_custkey", wanted.alias("name")), names, ("direct_a_", "direct_b_"))
    return got.select("c_custkey", "environment")


# -- Python source; the tables hold none, so code is made of their values


@query(
    """SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'syntax' WHEN 1 THEN 'assert_true' WHEN 2 THEN 'tautology' WHEN 3 THEN 'not_one_test' ELSE '' END AS problem,
  CASE event_id % 5 WHEN 0 THEN '' ELSE 'test_' || event_id END AS selector, CASE WHEN event_id % 5 = 0 THEN 'pytest' ELSE 'pytest' END AS framework FROM events"""
)
def ast_audit(spark, sf):
    bodies = F.array(*map(F.lit, ["(:", "assert True", "assert a or not a", "pass\ndef test_b(): pass", "assert a == 1"]))
    code = F.concat(F.lit("def test_"), F.col("event_id").cast("string"), F.lit("():\n    "), F.element_at(bodies, (F.col("event_id") % 5 + 1).cast("int")), F.lit("\n"))
    rows = table(spark, sf, "events").select("event_id", code.alias("code"))
    read = rows.select("event_id", pyast.audited_with_selector(F.col("code"), F.lit("")).alias("a"), rules.framework(F.col("code"), F.lit("")).alias("framework"))
    return read.select("event_id", "a.problem", "a.selector", "framework")


@query("SELECT event_id, 'x = ' || event_id || chr(10) AS new_text, '' AS problem FROM events")
def exact_once_replace(spark, sf):
    rows = table(spark, sf, "events").select("event_id", F.col("event_id").cast("string").alias("v"))
    got = pyast.replaced(F.lit("x = OLD\n"), F.lit("OLD"), F.col("v"), F.lit("a.py"))
    return rows.select("event_id", got.alias("r")).select("event_id", F.col("r.new").alias("new_text"), F.col("r.problem").alias("problem"))


@query(
    """SELECT event_id, '{"a":1}' AS known, 'not json ' || event_id AS raw, CASE WHEN event_id % 3 = 0 THEN '[' || event_id || ']' END AS value FROM events"""
)
def observation_raw(spark, sf):
    """Of blocks that are no JSON the last is kept under 'raw', of values that are no objects the last under 'value'."""
    n = F.col("event_id").cast("string")
    block = lambda c: F.concat(F.lit("BRT_OBS_START "), c, F.lit(" BRT_OBS_END\n"))
    log = F.concat(block(F.lit("broken")), block(F.lit('{"known": {"a": 1}}')), F.when(F.col("event_id") % 3 == 0, block(F.concat(F.lit("["), n, F.lit("]")))).otherwise(""), block(F.concat(F.lit("not json "), n)))
    read = table(spark, sf, "events").select("event_id", json_values.merged_observations(log).alias("m"))
    return read.select("event_id", "m.known", "m.raw", "m.value")


@query(
    r"""WITH r AS (SELECT c_custkey, ['astropy/astropy', 'matplotlib/matplotlib', 'django/django', 'matplotlib/matplotlib', 'a/new'][1 + (c_custkey % 5)::INT] AS repo, ['3.1', '3.5', '1'][1 + (c_custkey % 3)::INT] AS version FROM customer)
SELECT c_custkey, CASE WHEN repo LIKE 'astropy%' THEN 'if [ -f pyproject.toml ]; then sed -i ''s/requires = \["setuptools",/requires = ["setuptools==68.0.0",/'' pyproject.toml; fi && python -m pip install --ignore-installed --no-deps -e ."[test]" --verbose'
  WHEN repo LIKE 'matplotlib%' AND version = '3.1' THEN 'python setup.py build_ext --inplace' ELSE 'python -m pip install --ignore-installed --no-deps -e .' END AS setup FROM r"""
)
def setup_commands(spark, sf):
    repos, versions = (F.array(*map(F.lit, x)) for x in (["astropy/astropy", "matplotlib/matplotlib", "django/django", "matplotlib/matplotlib", "a/new"], ["3.1", "3.5", "1"]))
    pick = lambda a, n: F.element_at(a, (F.col("c_custkey") % n + 1).cast("int"))
    return table(spark, sf, "customer").select("c_custkey", rules.setup_command(pick(repos, 5), pick(versions, 3)).alias("setup"))


MODES = ["buggy_only", "patched_repo", "patch_file", "patch_text", "surrogate"]


@query(
    f"""WITH e AS (SELECT event_id, {MODES}[1 + (event_id % 5)::INT] AS mode, event_id % 2 AS b, event_id // 2 % 2 AS p, event_id % 7 <> 0 AS has, event_id % 11 <> 0 AS applied FROM events),
s AS (SELECT *, CASE WHEN mode = 'buggy_only' THEN 'BUGGY_ONLY' WHEN mode = 'surrogate' THEN 'NOT_IMPLEMENTED' WHEN NOT has THEN 'SETUP_ERROR' WHEN mode = 'patch_text' AND NOT applied THEN 'PATCH_APPLY_ERROR'
  WHEN b = 0 THEN 'BUGGY_PASS' WHEN p = 0 THEN 'F2P_SUCCESS' ELSE 'PATCHED_FAIL' END AS status FROM e)
SELECT event_id, status, CASE WHEN status <> 'SETUP_ERROR' THEN '' WHEN mode = 'patched_repo' THEN 'missing patched_repo_base' ELSE 'missing ' || mode END AS note FROM s"""
)
def pair_status(spark, sf):
    n = F.col("event_id")
    mode = F.element_at(F.array(*map(F.lit, MODES)), (n % 5 + 1).cast("int"))
    got = rules.pair_status(mode, n % 2, F.floor(n / 2) % 2, n % 7 != 0, n % 11 != 0)
    return table(spark, sf, "events").select("event_id", got.alias("s")).select("event_id", "s.*")


@query(
    f"""WITH p AS (SELECT page_id, {PATH_SQL} AS path, page_id % 3 = 0 AS second FROM pages),
r AS (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'empty' WHEN path = '' OR path LIKE '/%' THEN 'unsafe' WHEN second THEN 'test_file' ELSE '' END AS problem FROM p)
SELECT page_id, problem, CASE WHEN problem = '' THEN 2 ELSE 0 END::INTEGER AS kept FROM r"""
)
def patch_list(spark, sf):
    """One bad item refuses the whole list."""
    path = F.regexp_extract("url", "^[a-z]+://[^/]*/(.*)$", 1)
    item = lambda p: F.struct(p.alias("path"), F.lit("a").alias("search"), F.lit("b").alias("replace"))
    items = F.array(item(path), item(F.when(F.col("page_id") % 3 == 0, "x/tests/y.py").otherwise("x/y.py")))
    got = paths.patch_list(F.when(F.col("page_id") % 5 == 0, F.slice(items, 1, 0)).otherwise(items), F.lit("t.py"), F.array().cast("array<string>"))
    return table(spark, sf, "pages").select("page_id", got.alias("g")).select("page_id", "g.problem", F.size("g.items").alias("kept"))


@query(
    """WITH r AS (SELECT c_custkey, ['a/seaborn', 'pytest-dev/pytest', '', 'x/none'][1 + (c_custkey % 4)::INT] AS repo, ['mwaskom__seaborn-1', 'pytest-dev__pytest-2', 'psf__requests-3', 'q__none-4'][1 + (c_custkey // 4 % 4)::INT] AS id FROM customer)
SELECT c_custkey, CASE repo WHEN 'a/seaborn' THEN 'seaborn' WHEN 'pytest-dev/pytest' THEN 'pytest-dev__pytest'
  WHEN '' THEN split_part(id, '__', 1).replace('mwaskom', 'seaborn').replace('pytest-dev', 'pytest').replace('psf', 'requests')
  ELSE CASE WHEN id LIKE 'mwaskom%' THEN 'seaborn' ELSE 'none' END END AS folder FROM r"""
)
def repository_folder(spark, sf):
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (n % 4 + 1).cast("int"))
    n = F.col("c_custkey")
    repo, instance = pick(["a/seaborn", "pytest-dev/pytest", "", "x/none"], n), pick(["mwaskom__seaborn-1", "pytest-dev__pytest-2", "psf__requests-3", "q__none-4"], F.floor(n / 4))
    return table(spark, sf, "customer").select("c_custkey", paths.repository_folder(repo, instance, F.array(F.lit("seaborn"), F.lit("pytest-dev__pytest"))).alias("folder"))


@query("SELECT DISTINCT source AS instance_id FROM documents WHERE source <> 'src1' UNION SELECT 'q' || quality FROM labels WHERE quality IS NOT NULL")
def requested_ids(spark, sf):
    """No id is given, so all that are on disk or evaluated."""
    docs = table(spark, sf, "documents").select(F.when(F.col("source") == "src1", "formal_eval").otherwise(F.col("source")).alias("instance_id"))
    evaluated = table(spark, sf, "labels").select(F.concat(F.lit("q"), F.col("quality").cast("string")).alias("instance_id"))
    return joins.requested_ids(docs.where("false"), docs, evaluated)


@query(
    """SELECT doc_id, coalesce(nullif(CASE WHEN doc_id % 2 = 0 THEN '' ELSE source END, ''), lang) AS name, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'p' || doc_id END AS path, md5(text) AS content_md5 FROM documents"""
)
def code_hits(spark, sf):
    """Fields of hits under any of their names; an empty one gives way to the next."""
    docs = table(spark, sf, "documents")
    row = F.struct(
        F.when(F.col("doc_id") % 2 == 0, "").otherwise(F.col("source")).alias("obj_name"), F.col("lang").alias("name"), F.when(F.col("doc_id") % 3 == 0, F.lit(0)).alias("node_type"),
        F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("p"), F.col("doc_id").cast("string"))).alias("path"), F.lit(None).cast("string").alias("code_content"), F.col("text").alias("code"),
    )
    hits = docs.select(F.col("doc_id").cast("string").alias("instance_id"), F.parse_json(F.to_json(row)).alias("row"), F.col("doc_id").alias("_pos"))
    return records.code_hits(hits).select(F.col("_pos").alias("doc_id"), "name", "path", F.md5("content").alias("content_md5"))


CUT_SQL = "CASE WHEN length({0}) <= {1} THEN {0} ELSE substr({0}, 1, {1} // 2) || chr(10) || '...[TRUNCATED]...' || chr(10) || right({0}, {1} - {1} // 2) END"


@query(
    f"""WITH s AS (SELECT doc_id, '【源码片段 1】' || chr(10) || '文件路径：' || source || chr(10) || '对象名称：' || lang || chr(10) || '节点类型：' || chr(10) || '父节点：' || chr(10) || '行号范围：1-2' || chr(10) || '代码：' || chr(10) || text || chr(10) AS code,
  '【相关测试 1】' || chr(10) || '测试文件：' || source || chr(10) || '测试名称：' || lang || chr(10) || '测试代码：' || chr(10) || text || chr(10) AS test FROM documents)
SELECT doc_id, md5({CUT_SQL.format('code', 900)}) AS code_md5, md5({CUT_SQL.format('test', 18000)}) AS test_md5 FROM s"""
)
def hit_sections(spark, sf):
    """Hits as numbered sections, shortened in the middle."""
    items = F.array(F.struct(F.col("source").alias("path"), F.col("source").alias("file"), F.col("lang").alias("name"), F.lit("").alias("node_type"), F.lit("").alias("parent"), F.lit("1").alias("start"), F.lit("2").alias("end"), F.col("text").alias("content")))
    return table(spark, sf, "documents").select("doc_id", F.md5(text.source_sections(items, 900)).alias("code_md5"), F.md5(text.test_sections(items)).alias("test_md5"))


@query(
    f"""WITH l AS (SELECT doc_id, text, CASE WHEN suffix(text, chr(10)) THEN string_split(left(text, -1), chr(10)) ELSE string_split(text, chr(10)) END AS lines FROM documents),
p AS (SELECT doc_id, CASE WHEN length(text) <= 2000 THEN text WHEN doc_id % 5 = 0 THEN text ELSE array_to_string(list_slice(lines, greatest(doc_id % 40 - 3, 1), least(doc_id % 40 + 3 + 2, len(lines))), chr(10)) END AS part, length(text) <= 2000 AS whole FROM l)
SELECT doc_id, md5(CASE WHEN whole THEN part ELSE {CUT_SQL.format("coalesce(part, '')", 900)} END) AS excerpt_md5 FROM p"""
)
def source_excerpt(spark, sf):
    """The lines around a hit of a long source; the whole of a short one."""
    start = F.when(F.col("doc_id") % 5 == 0, "none").otherwise((F.col("doc_id") % 40).cast("string"))
    end = (F.col("doc_id") % 40 + 2).cast("string")
    got = text.source_excerpt(F.col("text"), F.lit("own"), start, end, whole=2000, around=3, limit=900)
    return table(spark, sf, "documents").select("doc_id", F.md5(got).alias("excerpt_md5"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS moment FROM events")
def time_text(spark, sf):
    return table(spark, sf, "events").select("event_id", text.time_text(F.col("ts")).alias("moment"))


@query("SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN [] ELSE ['cython==' || p_size, 'wheel'] END AS requirements FROM part")
def build_requirements(spark, sf):
    """Requirements of a build system, without those that an environment brings itself; none for text that does not parse."""
    size = F.col("p_size").cast("string")
    toml = F.concat(F.lit('[build-system]\nrequires = ["setuptools>=40", "cython=='), size, F.lit('", "Oldest_Supported_NumPy", "wheel"]'), F.when(F.col("p_size") % 4 == 0, " broken").otherwise(""))
    return table(spark, sf, "part").select("p_partkey", pyast.build_requirements_of(toml).alias("requirements"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export_record_status(spark, sf_dir)


from . import record_queries, rule_queries  # noqa: E402, F401  (they register more queries with what is defined above)
