"""Registered queries of the ordered rules on texts that hold many markers at once, so that the order of the rules decides."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules, text
from .queries import query, table


def bit(n: int, column: str = "event_id"):
    """Whether bit n of a scrambled id is set."""
    return F.shiftright(F.col(column).cast("long") * 40503, n).bitwiseAND(F.lit(1)) == 1


def bit_sql(n: int, column: str = "event_id") -> str:
    return f"((({column}::BIGINT * 40503) >> {n}) & 1 = 1)"


def marked(words: list[str], first: int = 0):
    """The words whose bits are set, joined by line feeds."""
    return F.array_join(F.filter(F.array(*[F.when(bit(first + k), w) for k, w in enumerate(words)]), lambda x: x.isNotNull()), "\n")


LOG = ["SyntaxError: x", "NameError: y", "django.core.exceptions.AppRegistryNotReady", "fixture 'a' not found", "ImportError: z", "collected 0 items", "Frobnicate failed", "AssertionError"]


@query(
    f"""WITH b AS (SELECT event_id, event_id % 9 = 0 AS late, event_id % 5 AS code, event_id % 3 AS kind, {', '.join(f'{bit_sql(k)} AS m{k}' for k in range(8))} FROM events)
SELECT event_id, CASE WHEN late THEN 'TIMEOUT' WHEN code = 0 THEN 'PASS' WHEN m0 THEN 'SYNTAX_ERROR' WHEN m1 AND kind <> 1 THEN 'SETUP_ERROR' WHEN m2 THEN 'SETUP_ERROR'
  WHEN (m3 OR m4) AND kind = 2 AND (m6 OR m4) THEN 'ISSUE_ALIGNED_FAIL' WHEN m3 OR m4 THEN 'SETUP_ERROR' WHEN m5 THEN 'COLLECT_ERROR' WHEN m6 OR (kind = 1 AND m1) THEN 'ISSUE_ALIGNED_FAIL' WHEN m7 THEN 'ASSERTION_FAIL' ELSE 'UNRELATED_FAIL' END AS status FROM b"""
)
def marked_logs(spark, sf):
    """Eight markers in any combination, and a symptom that expects an unknown name, a failed import, or neither."""
    symptom = F.element_at(F.array(F.lit(""), F.lit("nameerror: q"), F.lit("importerror of q")), (F.col("event_id") % 3 + 1).cast("int"))
    terms = rules.issue_terms(F.array(F.lit("pkg.Frobnicate"), F.lit("")), symptom)
    status = rules.execution_status(F.col("event_id") % 5, rules.lowered(marked(LOG), F.lit("")), F.col("event_id") % 9 == 0, symptom, terms)
    return table(spark, sf, "events").select("event_id", status.alias("status"))


RUN = ["IndentationError", "ModuleNotFoundError", "no tests ran", "settings are not configured", "boom"]


@query(
    f"""WITH b AS (SELECT event_id, event_id % 11 = 0 AS late, event_id % 4 AS code, {', '.join(f'{bit_sql(k)} AS m{k}' for k in range(5))} FROM events),
s AS (SELECT *, CASE WHEN late THEN 'TIMEOUT' WHEN code = 0 THEN 'PASS' WHEN m0 THEN 'SYNTAX_ERROR' WHEN m1 OR m3 THEN 'SETUP_ERROR' WHEN m2 THEN 'COLLECT_ERROR' ELSE 'FAIL' END AS status FROM b)
SELECT event_id, status, status <> 'PASS' AS failed FROM s"""
)
def marked_runs(spark, sf):
    got = rules.run_result(F.col("event_id") % 4, F.lit("out"), marked(RUN), F.col("event_id") % 11 == 0)
    return table(spark, sf, "events").select("event_id", got["status"].alias("status"), got["failed"].alias("failed"))


SOURCE = ["from django.test import X", "import unittest", "import pytest", "def test_x(): pass"]
BASES = ["Base", "TestCase", "MyTestCase", "SimpleTestCase"]


@query(
    f"""WITH b AS (SELECT event_id, {BASES}[1 + (event_id % 4)::INT] AS base, {', '.join(f'{bit_sql(k)} AS m{k}' for k in range(4))} FROM events)
SELECT event_id, CASE WHEN m0 OR base IN ('TestCase', 'SimpleTestCase') THEN 'django' WHEN m1 OR base = 'MyTestCase' THEN 'unittest' WHEN m2 OR m3 THEN 'pytest' ELSE 'unknown' END AS framework FROM b"""
)
def frameworks(spark, sf):
    """Sources that speak for several frameworks, under bases that do."""
    base = F.element_at(F.array(*map(F.lit, BASES)), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, sf, "events").select("event_id", rules.framework(marked(SOURCE), base).alias("framework"))


REASON = ["环境问题", "未能正确地触发", "wrong oracle", "fine"]
TROUBLE = ["an Attribute", "an import", "an error", "it did fail"]


@query(
    f"""WITH b AS (SELECT event_id, event_id % 4 AS k, {', '.join(f'{bit_sql(k)} AS m{k}' for k in range(8))} FROM events)
SELECT event_id, CASE WHEN k = 0 THEN 'reject' WHEN m0 THEN 'repair_setup' WHEN m1 THEN 'repair_trigger' WHEN m2 THEN 'repair_oracle' ELSE 'accept' END AS decision,
  CASE WHEN k < 2 THEN (m4 OR m5) AND (m6 OR m7) ELSE false END AS trouble FROM b"""
)
def downgrades(spark, sf):
    """Accepts taken back by their reasons, the setup first; and logs in which one line names the trouble, or several lines do."""
    decision = F.when(F.col("event_id") % 4 == 0, "reject").otherwise("accept")
    line = F.replace(marked(TROUBLE, 4), F.lit("\n"), F.lit(" "))
    log = F.when(F.col("event_id") % 4 < 2, line).otherwise(marked(TROUBLE, 4))
    return table(spark, sf, "events").select("event_id", rules.accept_downgrade(decision, marked(REASON)).alias("decision"), rules.import_trouble(log).alias("trouble"))


STATUS = ["SETUP_ERROR", "PASS", "ASSERTION_FAIL", "ISSUE_ALIGNED_FAIL", "UNRELATED_FAIL", "TIMEOUT"]
CODE = ["x.check()", "assertRaises", "caplog"]


@query(
    f"""WITH b AS (SELECT event_id, {STATUS}[1 + (event_id % 6)::INT] AS s, ['', 'assert_true', 'skip_call'][1 + (event_id // 6 % 3)::INT] AS a, {', '.join(f'{bit_sql(k)} AS m{k}' for k in range(5))} FROM events),
d AS (SELECT *, m3 AS wants_check, m4 AS wants_log, s = 'ASSERTION_FAIL' AS f FROM b)
SELECT event_id, CASE WHEN s = 'SETUP_ERROR' THEN 'repair_setup' WHEN a = 'assert_true' THEN 'repair_oracle' WHEN a <> '' THEN 'repair_trigger' WHEN s = 'PASS' THEN 'repair_trigger' WHEN f AND (wants_check AND m0 AND NOT m1 OR wants_log AND m2) THEN 'accept' WHEN f THEN 'repair_oracle' WHEN s = 'TIMEOUT' THEN 'reject' ELSE 'repair_trigger' END AS decision,
  CASE WHEN s = 'SETUP_ERROR' THEN 'setup' WHEN a = 'assert_true' THEN 'oracle' WHEN a <> '' THEN 'trigger' WHEN s = 'PASS' THEN CASE WHEN wants_check THEN 'trigger,oracle' ELSE 'trigger' END WHEN f AND (wants_check AND m0 AND NOT m1 OR wants_log AND m2) THEN 'trigger,oracle' WHEN f THEN 'oracle' WHEN s = 'TIMEOUT' THEN 'setup' ELSE 'trigger,oracle' END AS focus,
  CASE WHEN s = 'SETUP_ERROR' THEN CASE WHEN wants_check AND m0 THEN 128 ELSE 33 END WHEN a <> '' THEN length(a) + 6 END AS action_length FROM d""".replace("CASE WHEN wants_check AND m0 THEN 128 ELSE 33 END", f"CASE WHEN wants_check AND m0 THEN {len(rules.CHECK_SETUP_ACTION)} ELSE {len(rules.SETUP_ACTION)} END").replace("WHEN s = 'TIMEOUT' THEN 'setup' ELSE 'trigger,oracle' END AS focus", "WHEN s = 'ISSUE_ALIGNED_FAIL' THEN 'trigger' WHEN s = 'TIMEOUT' THEN 'setup' ELSE 'trigger,oracle' END AS focus")
)
def buggy_only_decisions(spark, sf):
    """Decisions on a run of the buggy version, where audits, wanted checks and logs and the code's own words meet."""
    pick = lambda words, n: F.element_at(F.array(*map(F.lit, words)), (n + 1).cast("int"))
    status, audit = pick(STATUS, F.col("event_id") % 6), pick(["", "assert_true", "skip_call"], F.floor(F.col("event_id") / 6) % 3)
    got = rules.buggy_only_verdict(status, audit, F.concat(F.lit("found "), audit), bit(3), bit(4), marked(CODE))
    shown = F.when((status == "SETUP_ERROR") | (audit != ""), F.length(F.col("g.next_action")).cast("long"))
    rows = table(spark, sf, "events").select("event_id", got.alias("g"))
    return rows.select("event_id", F.col("g.decision").alias("decision"), F.array_join("g.focus", ",").alias("focus"), shown.alias("action_length"))


@query(
    "SELECT event_id, CASE WHEN event_id % 8 >= 5 THEN NULL WHEN event_id % 3 = 0 THEN greatest(CASE WHEN event_id % 4 = 0 THEN 0 ELSE value END, least(30.0 * pow(2, event_id % 8), 300)) ELSE least(15.0 * pow(2, event_id % 8), 180) END::DOUBLE AS wait FROM events"
)
def waits(spark, sf):
    """Seconds behind a failed attempt; an answer that limits the rate may say how long."""
    n = F.col("event_id")
    said = F.when(n % 4 == 0, "soon").otherwise(F.col("value").cast("string"))
    return table(spark, sf, "events").select("event_id", text.wait_seconds(F.when(n % 3 == 0, 429).otherwise(500), n % 8, F.lit(6), said).alias("wait"))


@query("SELECT count(*) AS total, count(*) FILTER (quality = 1) AS ok, count(*) FILTER (quality IS NULL) AS skip, count(*) FILTER (quality = 0) AS error FROM labels")
def rewrite_summary(spark, sf):
    from ..operators import metrics

    status = F.when(F.col("quality") == 1, "OK").when(F.col("quality") == 0, "ERROR").otherwise("SKIP")
    return metrics.rewrite_summary(table(spark, sf, "labels").select(F.col("doc_id").alias("instance_id"), status.alias("status")))
