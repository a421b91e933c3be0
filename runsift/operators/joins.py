"""Assembly of records from several sources, resume joins and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.text import tail_excerpt, truthy

#: Fields that would give the answer away, and issue texts under their other names.
ANSWER_FIELDS = ("patch", "test_patch", "gold_patch", "golden_patch", "golden_test", "model_patch", "FAIL_TO_PASS", "PASS_TO_PASS")
TEXT_FIELDS = ("issue_text", "problem_statement", "issue", "description")


def collected(df: DataFrame, key: str, position: str, fields: list[str], name: str) -> DataFrame:
    """One row a key with its rows as an array in order; sums up before the join, so joins never fan out."""
    items = F.transform(F.array_sort(F.collect_list(F.struct(position, *fields))), lambda x: F.struct(*[x[f].alias(f) for f in fields]))
    return df.groupBy(key).agg(items.alias(name))


def with_context(issues: DataFrame, hits: list[tuple[DataFrame, str]], key: str) -> DataFrame:
    """issues with the collected hits of each source; [] where there are none."""
    for found, name in hits:
        kind = found.schema[name].dataType.simpleString()
        issues = issues.join(found, key, "left").withColumn(name, F.coalesce(name, F.array().cast(kind)))
    return issues


def without_answers(df: DataFrame) -> DataFrame:
    """Drops the answer fields and the raw texts; a guard, whatever else is selected later."""
    return df.drop(*[c for c in df.columns if c in ANSWER_FIELDS + TEXT_FIELDS])


def filled(df: DataFrame, other: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """df with its empty columns filled from other; a key occurs in other once."""
    side = other.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    joined = df.join(side, key, "left")
    return joined.select(*[F.coalesce(F.nullif(c, F.lit("")), f"_{c}", c).alias(c) if c in columns else c for c in df.columns])


def in_list_order(ids: DataFrame, rows: DataFrame, key: str = "instance_id") -> DataFrame:
    """Rows of the listed ids, as often as listed; _pos is the list's."""
    return ids.join(rows.drop("_pos"), key)


def pending(ids: DataFrame, done: DataFrame, key: str, is_done: Column | None = None) -> DataFrame:
    """ids without a finished record.  ``is_done`` says what finishes; without it any record does."""
    return ids.join(done.where(is_done) if is_done is not None else done, key, "left_anti")


#: Statuses that are run again; a record without status counts as finished.
RERUN = ("ERROR", "SETUP_ERROR", "ENV_UNRESOLVED")


def resumable(status: Column) -> Column:
    return ~F.coalesce(status.isin(*RERUN), F.lit(False))


def with_presence(ids: DataFrame, rows: DataFrame, key: str, name: str) -> DataFrame:
    """ids with whether rows has their key: one join, with the distinct keys."""
    there = rows.select(key).where(F.col(key).isNotNull()).distinct().withColumn(name, F.lit(True))
    return ids.join(there, key, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def present(ids: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    return ids.join(rows, key, "left_semi")


def requested_ids(given: DataFrame, on_disk: DataFrame, evaluated: DataFrame) -> DataFrame:
    """(instance_id): those that are given; if none is, every id on disk or evaluated, once, sorted, the folder formal_eval left out."""
    found = on_disk.select("instance_id").where("instance_id <> 'formal_eval'").union(evaluated.select("instance_id")).where("instance_id is not null").distinct()
    listed = given.select("instance_id").where("coalesce(instance_id, '') <> ''")
    # The other side of this join is one row at most.
    return listed.union(found.join(listed.limit(1).select(F.lit(1)), how="left_anti", on=F.lit(True)).sort("instance_id"))


def paired_calls(messages: DataFrame, group: str = "id") -> DataFrame:
    """(group, call_id, name, argument, result): tool calls with their results; the argument's name varies."""
    calls = messages.select(group, F.explode("tool_calls").alias("c")).select(group, F.col("c.id").alias("call_id"), F.col("c.function.name").alias("name"), F.col("c.function.arguments").alias("arguments"))
    results = messages.where("role = 'tool'").select(group, F.col("tool_call_id").alias("call_id"), F.col("content").alias("result"))
    argument = F.coalesce(F.get_json_object("arguments", "$.file"), F.get_json_object("arguments", "$.file_path"))
    return calls.join(results, [group, "call_id"]).select(group, "call_id", "name", argument.alias("argument"), "result")


def environment_match(wanted: DataFrame, names: Column, prefixes: tuple[str, ...]) -> DataFrame:
    """wanted(name) with ``environment``: the exact name, else by preferred prefix, else the last by name that ends with it, else itself.

    names is one array of all environments, so nothing is joined.
    """
    ending = F.array_sort(F.filter(names, lambda x: x.endswith(F.col("name"))))
    first_with = lambda p: F.try_element_at(F.filter(ending, lambda x: x.startswith(p)), F.lit(1))
    by_prefix = [first_with(p) for p in prefixes]
    exact = F.when(F.array_contains(names, F.col("name")), F.col("name"))
    return wanted.withColumn("environment", F.when(F.col("name") == "", "").otherwise(F.coalesce(exact, *by_prefix, F.try_element_at(ending, F.lit(-1)), "name")))


def uncovered_locations(suspected: DataFrame, code: DataFrame, by_object: bool) -> DataFrame:
    """suspected(instance_id, path, object) that no code(instance_id, path, name, content) covers: by path, or by path and object or content."""
    c = code.select(F.col("instance_id").alias("_i"), F.col("path").alias("_p"), F.col("name").alias("_n"), F.col("content").alias("_c"))
    on = (F.col("instance_id") == F.col("_i")) & (F.col("path") == F.col("_p"))
    if by_object:
        on = on & (F.col("object") == F.col("_n")) & F.contains(F.col("_c"), F.col("object"))
    return suspected.join(c, on, "left_anti")


def ancestors(path: Column) -> Column:
    """The folders above a path, nearest first; '' is the root."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.size(parts) - 1, F.lit(0), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def fixtures_in_reach(tests: DataFrame, definitions: DataFrame) -> DataFrame:
    """tests(file, fixture) whose fixture is defined in a conftest.py of a folder above: definitions(folder, fixture)."""
    up = tests.withColumn("folder", F.explode(ancestors(F.col("file"))))
    return up.join(definitions, ["folder", "fixture"], "left_semi").select("file", "fixture").distinct()


def ordered_union(a: Column, b: Column) -> Column:
    return F.array_distinct(F.concat(a, b))


def by_repository(rows: DataFrame, specs: DataFrame) -> DataFrame:
    """rows with the install and test entries of (repo, version) and an ``known`` flag."""
    return rows.join(specs.withColumn("known", F.lit(True)), ["repo", "version"], "left").withColumn("known", F.coalesce("known", F.lit(False)))


#: Columns of the inputs of a record beside instance_id.
RECORD_FIELDS = {
    "s": "status string, rounds_used int, strict_verifier_decision string, buggy_status string, returncode int, stdout string, stderr string, error_reason string, strict_failure_class string, surrogate_status string, error string",
    "e": "status string, buggy_status string, fixed_status string, buggy_returncode int, fixed_returncode int, direct_test_repo_path string, selector string, error string, record_path string",
    "r": "selected_attempt int, candidates int",
    "t": "path string, content string",
}


def held(df: DataFrame, name: str) -> DataFrame:
    """(instance_id, ``name``): the columns of RECORD_FIELDS as one struct, null where df lacks them."""
    fields = [f.split() for f in RECORD_FIELDS[name].split(", ")]
    return df.select("instance_id", F.struct(*[(F.col(f) if f in df.columns else F.lit(None)).cast(kind).alias(f) for f, kind in fields]).alias(name))


def read_summaries(raw: DataFrame) -> DataFrame:
    """The columns of a record's summaries from raw(instance_id, value variant); a part of a wrong type counts as empty."""
    v = lambda path, kind="string": F.try_variant_get("value", f"$.{path}", kind)
    same = ("status", "strict_verifier_decision", "strict_failure_class", "error")
    run = {"buggy_status": "status", "stdout": "stdout", "stderr": "stderr", "error_reason": "error_reason"}
    return raw.select(
        "instance_id", *[v(f).alias(f) for f in same], v("rounds_used", "int").alias("rounds_used"), v("buggy_execution.returncode", "int").alias("returncode"),
        *[v(f"buggy_execution.{f}").alias(c) for c, f in run.items()], v("dual_version_result.status").alias("surrogate_status"),
    )


def read_evaluations(raw: DataFrame, record_path: Column | None = None) -> DataFrame:
    """The columns of a record's evaluations from raw(instance_id, value variant)."""
    v = lambda path, kind="string": F.try_variant_get("value", f"$.{path}", kind)
    return raw.select(
        "instance_id", v("status").alias("status"), v("buggy.status").alias("buggy_status"), v("fixed.status").alias("fixed_status"), v("buggy_run.returncode", "int").alias("buggy_returncode"),
        v("fixed_run.returncode", "int").alias("fixed_returncode"), *[v(f).alias(f) for f in ("direct_test_repo_path", "selector", "error")], (F.lit(None) if record_path is None else record_path).cast("string").alias("record_path"),
    )


def read_rankings(raw: DataFrame) -> DataFrame:
    """The columns of a record's rankings from raw(instance_id, value variant): the attempt that is named, else the first that is marked, and how many there are."""
    from .ranking import selected_attempt

    listed = F.try_variant_get("value", "$.checkpoints", "array<struct<selected boolean, round_id int>>")
    named = F.try_variant_get("value", "$.selected_attempt", "int")
    return raw.select("instance_id", selected_attempt(named, listed).alias("selected_attempt"), F.coalesce(F.size(listed), F.lit(0)).alias("candidates"))


def export_record(ids: DataFrame, summaries: DataFrame, evaluations: DataFrame, rankings: DataFrame, tests: DataFrame, logs: DataFrame | None = None) -> DataFrame:
    """One nested record an id: selected test, generation, formal evaluation, paths and error.

    Inputs have instance_id, once each, and any of the columns in RECORD_FIELDS; what an input lacks is null.
    logs(instance_id, attempt, path) has the execution logs that there are.  Texts are joined last, so that they
    are moved once.
    """
    s, e, r, t = (held(df, name) for name, df in zip("sert", (summaries, evaluations, rankings, tests)))
    joined = ids.select("instance_id").join(r, "instance_id", "left").join(e, "instance_id", "left")
    if logs is not None:
        log = logs.select(F.col("instance_id").alias("_log_of"), F.col("attempt").alias("_attempt"), F.col("path").alias("_log"))
        same = (F.col("instance_id") == F.col("_log_of")) & (F.col("r.selected_attempt") == F.col("_attempt"))
        joined = joined.join(log, same, "left")
    else:
        joined = joined.withColumn("_log", F.lit(None).cast("string"))
    joined = joined.join(s, "instance_id", "left").join(t, "instance_id", "left")
    strict = truthy("s.strict_failure_class")
    content = F.nullif("t.content", F.lit(""))
    under = lambda name: F.concat(F.lit("generation/"), F.col("instance_id"), F.lit(f"/{name}"))
    return joined.select(
        "instance_id",
        content.isNotNull().alias("generated"),
        F.col("e").isNotNull().alias("evaluated"),
        F.struct(
            F.coalesce(F.nullif("e.direct_test_repo_path", F.lit("")), "t.path", under("final_test.py")).alias("test_file_path"),
            F.col("e.selector").alias("test_nodeid"),
            content.alias("test_content"),
            F.lit(None).cast("string").alias("patch_content"),
        ).alias("selected_test"),
        F.struct(
            F.col("s.status").alias("status"),
            F.coalesce("r.selected_attempt", "s.rounds_used").alias("final_round"),
            F.coalesce(F.nullif("r.candidates", F.lit(0)), content.isNotNull().cast("int")).alias("candidate_count"),
            F.col("r.selected_attempt").alias("selected_candidate_index"),
            F.col("s.strict_verifier_decision").alias("verifier_decision"),
            F.col("s.buggy_status").alias("buggy_execution_status"),
            F.col("s.returncode").alias("buggy_returncode"),
            F.when(F.col("s").isNotNull(), tail_excerpt(F.col("s.stdout"), F.col("s.stderr"), F.col("s.error_reason"))).alias("buggy_log_excerpt"),
            F.when(strict != "", strict == "issue_aligned").alias("issue_aligned"),
            F.col("s.surrogate_status").alias("surrogate_status"),
        ).alias("generation"),
        F.struct(
            F.col("e.status").alias("status"),
            F.col("e.buggy_status").alias("buggy_status"),
            F.col("e.fixed_status").alias("patched_status"),
            F.col("e.buggy_returncode").alias("buggy_returncode"),
            F.col("e.fixed_returncode").alias("patched_returncode"),
            F.coalesce(F.col("e.status") == "F2P_SUCCESS", F.lit(False)).alias("is_f2p_success"),
            rules.failure_category(F.col("e.status")).alias("failure_category"),
        ).alias("formal_evaluation"),
        F.struct(
            F.when(F.col("s").isNotNull(), under("summary.json")).alias("generation_record"),
            F.col("e.record_path").alias("evaluation_record"),
            F.when(content.isNotNull(), under("final_test.py")).alias("test_file"),
            F.col("_log").alias("buggy_log"),
            F.lit(None).cast("string").alias("patched_log"),
        ).alias("paths"),
        F.nullif(truthy("s.error", "e.error"), F.lit("")).alias("error"),
    )


def tests_only(record: DataFrame) -> DataFrame:
    return record.select("instance_id", "selected_test.test_file_path", "selected_test.test_content", F.col("formal_evaluation.status").alias("formal_status"), "formal_evaluation.is_f2p_success")


def checkpoint_index(record: DataFrame) -> DataFrame:
    return record.where("generation.selected_candidate_index is not null").select("instance_id", F.col("generation.selected_candidate_index").alias("round_id"))
