"""Sources, ranking, joins, metrics, schedules, sinks and streams on small inputs."""

import random

import pytest
from pyspark.sql import functions as F

from runsift.operators import joins, metrics, ranking, schedule
from runsift.sources import records, sinks
from runsift.streaming import snapshot


def write(path, content):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(content, encoding="utf-8")
    return str(path)


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


# -- sources


def test_issues_last_value_first_place(spark, tmp_path):
    p = write(tmp_path / "i.json", '[{"instance_id": "a", "v": 1}, {"instance_id": "b"}, 5, {"v": 3}, {"instance_id": ""}, {"instance_id": "a", "v": 2}]')
    got = records.load_issues(spark, p).select("instance_id", records.field(F.col("row"), "v", "int").alias("v"), F.col("_pos.n"))
    assert rows(got, "n") == [("a", 2, 0), ("b", None, 1)]
    p = write(tmp_path / "d.json", '{"x": {"v": 1}, "y": {"instance_id": "z"}, "w": 3}')
    assert rows(records.load_issues(spark, p).select("instance_id"), "instance_id") == [("x",), ("z",)]


def test_strict_and_tolerant_lines(spark, tmp_path):
    p = write(tmp_path / "i.jsonl", '{"instance_id": "a"}\n\n  {"instance_id": "b"}  \n')
    assert [r.instance_id for r in records.load_issues(spark, p).orderBy("_pos").collect()] == ["a", "b"]
    bad = write(tmp_path / "b.jsonl", '{"instance_id": "a"}\nraw-id\n[1]\n')
    with pytest.raises(Exception, match="not JSON"):
        records.load_issues(spark, bad).collect()
    assert [r.instance_id for r in records.load_rows(spark, bad).orderBy("_pos").collect()] == ["a", "raw-id"]
    assert records.load_rows(spark, str(tmp_path / "none.txt")).count() == 0
    assert records.load_rows(spark, str(tmp_path / "none.json")).count() == 0


def test_three_shapes_of_hits(spark, tmp_path):
    a = write(tmp_path / "a.json", '{"i": [{"name": "n", "path": "p"}, 7]}')
    b = write(tmp_path / "b.json", '{"i": {"k": {"name": "other", "path": "p"}}}')
    c = write(tmp_path / "c.json", '[{"instance_id": "i", "name": "n"}]')
    assert [rows(records.load_hits(spark, p).select("instance_id", "name"), "name") for p in (a, b, c)] == [[("i", "n")], [("i", "k")], [("i", "n")]]


def test_run_folder(spark, tmp_path):
    for name, content in (("x", '{"status": "PASS"}'), ("y", "broken"), ("formal_eval", "{}")):
        write(tmp_path / name / "summary.json", content)
    got = records.summaries(spark, str(tmp_path)).select("instance_id", records.field(F.col("value"), "status").alias("s"))
    assert rows(got, "instance_id") == [("x", "PASS"), ("y", None)]
    assert records.summaries(spark, str(tmp_path), True).count() == 3
    for w, v in (("worker_10", 1), ("worker_2", 2)):
        write(tmp_path / "e" / w / "results.json", f'{{"q": {{"v": {v}}}}}')
    got = records.shard_results(spark, str(tmp_path / "e")).select("instance_id", records.field(F.col("value"), "v", "int"))
    assert rows(got, "instance_id") == [("q", 2)]
    ids = spark.createDataFrame([("a",), ("b",), ("c",)], "instance_id string")
    disk, memory = spark.createDataFrame([("a", "PASS")], "instance_id string, status string"), spark.createDataFrame([("a", "X"), ("b", "SKIP")], "instance_id string, status string")
    assert rows(records.summary_with_fallback(ids, disk, memory), "instance_id") == [("a", "PASS"), ("b", "SKIP"), ("c", "MISSING_SUMMARY")]
    assert records.newest_file(spark, str(tmp_path / "x")).first().path.endswith("summary.json")


def test_transcripts_and_calls(spark, tmp_path):
    p = write(tmp_path / "m" / "t1.json", '[{"role":"user","content":"q"},{"role":"assistant","content":null,"tool_calls":[{"id":"c1","type":"function","function":{"name":"read","arguments":"{\\"file_path\\":\\"f\\"}"}}]},{"role":"tool","tool_call_id":"c1","content":"r"}]')
    talk = records.transcripts(spark, p)
    assert talk.count() == 3 and rows(joins.paired_calls(talk), "call_id") == [("t1", "c1", "read", "f", "r")]


def test_requirements(spark):
    df = spark.createDataFrame([("-r more.txt\nnumpy\n# c\n-e .", "scipy\n")], "a string, b string")
    assert df.select(records.requirement_lines(F.col("a"), F.col("b")).alias("r")).first().r == ["scipy", "numpy"]


# -- ranking


def test_dedup_top_k(spark):
    data = [("i", k, p) for p, k in enumerate(["a", None, "a", "", "b", None, "c"])]
    df = spark.createDataFrame(data, "g string, k string, _pos int")
    kept = lambda key, n: [r._pos for r in ranking.dedup_top_k(df, ["g"], [key], "_pos", n).orderBy("_pos").collect()]
    assert kept(F.col("k"), 9) == [0, 1, 3, 4, 6] and kept(F.coalesce("k", F.lit("")), 9) == [0, 1, 4, 6]
    assert kept(F.col("k"), 2) == [0, 1] and kept(F.col("k"), 0) == [0]
    once = ranking.dedup_top_k(df, ["g"], [F.col("k")], "_pos", 3)
    assert rows(ranking.dedup_top_k(once, ["g"], [F.col("k")], "_pos", 3), "_pos") == rows(once, "_pos")


def test_last_wins_and_ties(spark):
    df = spark.createDataFrame([("a", 0, "x"), ("b", 1, "y"), ("a", 2, None)], "k string, _pos int, v string")
    assert rows(ranking.last_wins(df, ["k"], "_pos").select("k", "_pos", "v"), "k") == [("a", 0, None), ("b", 1, "y")]
    scores = spark.createDataFrame([("i", 0, 100), ("i", 2, 100), ("i", 1, 10)], "k string, r int, s int")
    assert ranking.best_by(scores, ["k"], F.col("s"), "r").first().r == 0


def test_relevance_uses_the_last_preference(spark):
    df = spark.createDataFrame([("f", "n", "uses foo and foo", ["f", "g", "f"], ["n"], ["a.foo", "foo", "b.bar"])], "f string, n string, c string, fs array<string>, ns array<string>, apis array<string>")
    assert df.select(ranking.relevance(*map(F.col, ("f", "n", "c", "fs", "ns", "apis"))).alias("s")).first().s == 98 + 80 + 8 + 2


def test_seed_fallback(spark):
    df = spark.createDataFrame([("a", 0, False), ("a", 1, True), ("b", 0, False), ("b", 1, False), ("b", 2, False), ("b", 3, True), ("c", 0, True)], "k string, p int, ok boolean")
    assert rows(ranking.first_ok_or_last(df, ["k"], "ok", "p"), "k") == [("a", 1, True, True), ("b", 2, False, False), ("c", 0, True, False)]


def test_neighbours_signatures_attempts(spark):
    df = spark.createDataFrame([("g", i, f"t{i}") for i in range(5)], "g string, i int, v string")
    assert {r.i: r.around for r in ranking.neighbours(df, ["g"], "i", "v").collect()}[1] == ["t0", "t2", "t3"]
    marked = ranking.first_of_signature(df.withColumn("status", F.lit("NEW")), ["g"], F.col("i") % 2, "i")
    assert [r.status for r in marked.orderBy("i").collect()] == ["NEW", "NEW", "DUPLICATE", "DUPLICATE", "DUPLICATE"]
    checkpoints = F.array(F.struct(F.lit(3).alias("round_id"), F.lit(False).alias("selected")), F.struct(F.lit(4).alias("round_id"), F.lit(True).alias("selected")))
    assert spark.range(1).select(ranking.selected_attempt(F.lit(None).cast("int"), checkpoints).alias("a")).first().a == 4


# -- schedules


def test_interleave_is_a_permutation_in_turns(spark):
    df = spark.createDataFrame([(f"{g}{i}", g, n) for n, (g, i) in enumerate([("a", 1), ("a", 2), ("a", 3), ("b", 1), ("c", 1)])], "id string, g string, p int")
    assert [r.id for r in schedule.interleaved(df, "g", "p").orderBy("turn", "first").collect()] == ["a1", "b1", "c1", "a2", "a3"]


@pytest.mark.parametrize("sizes, workers", [([5, 3, 3, 2], 2), ([random.Random(1).randint(1, 9) for _ in range(20)], 4)])
def test_packing_of_groups(spark, sizes, workers):
    loads, want = [0] * workers, {}
    for g in sorted(range(len(sizes)), key=lambda g: (-sizes[g], g)):
        w = loads.index(min(loads))
        want[g], loads[w] = w, loads[w] + sizes[g]
    df = spark.createDataFrame([(g, n, g) for g, n in enumerate(sizes)], "grp int, n long, first long")
    got = schedule.packed_groups(df, workers).collect()
    assert {r.grp: r.worker for r in got} == want and sum(r.n for r in got) == sum(sizes)


def test_modes():
    assert schedule.steps_of("full", True, True, {"generation"}) == ["evaluation", "export"]
    with pytest.raises(FileExistsError):
        schedule.steps_of("generation", False, True, set())


# -- joins and metrics


def test_resume_and_sets(spark):
    ids = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("a",)], "instance_id string")
    done = spark.createDataFrame([("a", "ERROR"), ("b", None), ("c", "PASS")], "instance_id string, status string")
    assert rows(joins.pending(ids, done, "instance_id", joins.resumable(F.col("status"))), "instance_id") == [("a",), ("a",), ("d",)]
    assert rows(joins.present(ids, done, "instance_id"), "instance_id") == [("a",), ("a",), ("b",), ("c",)]
    listed = spark.createDataFrame([("b", 0), ("a", 1), ("b", 2), ("z", 3)], "instance_id string, _pos int")
    assert [r.instance_id for r in joins.in_list_order(listed, done).orderBy("_pos").collect()] == ["b", "a", "b"]


def test_fill_locations_fixtures(spark):
    l = spark.createDataFrame([("i", "", "x"), ("j", None, "y"), ("k", "own", "z")], "id string, c string, d string")
    r = spark.createDataFrame([("i", "new"), ("k", "no")], "id string, c string")
    assert rows(joins.filled(l, r, "id", ["c"]), "id") == [("i", "new", "x"), ("j", None, "y"), ("k", "own", "z")]
    s = spark.createDataFrame([("i", "p", "o"), ("i", "p", "q"), ("i", "r", "o")], "instance_id string, path string, object string")
    c = spark.createDataFrame([("i", "p", "o", "def o")], "instance_id string, path string, name string, content string")
    assert rows(joins.uncovered_locations(s, c, True), "path", "object") == [("i", "p", "q"), ("i", "r", "o")]
    assert rows(joins.uncovered_locations(s, c, False), "path") == [("i", "r", "o")]
    t = spark.createDataFrame([("a/b/t.py", "db"), ("a/b/t.py", "no"), ("c/t.py", "db")], "file string, fixture string")
    d = spark.createDataFrame([("a", "db"), ("", "root")], "folder string, fixture string")
    assert rows(joins.fixtures_in_reach(t, d), "file") == [("a/b/t.py", "db")]


def make_record(spark):
    ids = spark.createDataFrame([("a",), ("b",), ("c",)], "instance_id string")
    s = spark.createDataFrame([("a", "ISSUE_ALIGNED_FAIL", 2, 1, "out", "", "issue_aligned", ""), ("b", "ERROR", 0, None, "", "", "side_path", "boom")], "instance_id string, status string, rounds_used int, returncode int, stdout string, stderr string, strict_failure_class string, error string")
    e = spark.createDataFrame([("a", "F2P_SUCCESS", "FAIL", "PASS")], "instance_id string, status string, buggy_status string, fixed_status string")
    r = spark.createDataFrame([("a", 2, 3)], "instance_id string, selected_attempt int, candidates int")
    t = spark.createDataFrame([("a", "t.py", "code"), ("b", "t.py", "")], "instance_id string, path string, content string")
    return joins.export_record(ids, s, e, r, t)


def test_export_record_summary_and_sinks(spark, tmp_path):
    record = make_record(spark)
    a, b, c = record.orderBy("instance_id").collect()
    assert a.generated and a.evaluated and a.generation.issue_aligned is True and a.generation.candidate_count == 3 and a.formal_evaluation.failure_category is None
    assert not b.generated and b.generation.issue_aligned is False and b.generation.candidate_count == 0 and b.error == "boom"
    assert not c.evaluated and c.generation.issue_aligned is None and c.generation.buggy_log_excerpt is None
    summary = metrics.final_summary(record)
    s = summary.first()
    assert (s.total_instances, s.generated_count, s.evaluated_count, s.f2p_success_count) == (3, 1, 1, 1) and s.f2p_success_rate == 1 / 3
    assert s.status_counts == {"F2P_SUCCESS": 1, "NOT_EVALUATED": 2} and s.failure_category_counts == {}
    sinks.export_run(record, summary, str(tmp_path))
    assert spark.read.json(str(tmp_path / "all_outputs")).count() == 3 and spark.read.json(str(tmp_path / "checkpoint_index")).first().round_id == 2
    sinks.append_shard(record.select("instance_id"), str(tmp_path / "p"), "w1")
    sinks.append_shard(record.select("instance_id"), str(tmp_path / "p"), "w1")
    assert spark.read.parquet(str(tmp_path / "p")).count() == 3
    now = spark.createDataFrame([("r", "new")], "run_id string, created_at string")
    assert sinks.run_config(now.withColumn("created_at", F.lit("old")), now).first().created_at == "old" and sinks.run_config(now.where("false"), now).first().created_at == "new"
    sinks.write_text(now, str(tmp_path / "t"), "run_id")
    assert spark.read.text(str(tmp_path / "t")).first().value == "r" and sinks.spec_json(now).first().spec.endswith('"test_cmd":""}')


def test_zero_rows_give_rate_zero(spark):
    m = metrics.evaluation_metrics(spark.createDataFrame([], "status string")).first()
    assert (m.total_instances, m.f2p_at_1, m.f2p_at_1_percent) == (0, 0.0, 0.0)


def test_context_does_not_multiply(spark):
    issues = spark.createDataFrame([("a",), ("b",)], "id string")
    hits = spark.createDataFrame([("a", 1, "x"), ("a", 0, "y")], "id string, p int, v string")
    both = joins.with_context(issues, [(joins.collected(hits, "id", "p", ["v"], "one"), "one"), (joins.collected(hits, "id", "p", ["v"], "two"), "two")], "id")
    got = {r.id: ([x.v for x in r.one], [x.v for x in r.two]) for r in both.collect()}
    assert got == {"a": (["y", "x"], ["y", "x"]), "b": ([], [])}


# -- snapshots


def test_snapshots(spark):
    rows_ = [(i, i, s, r, None, "err") for i, (s, r) in enumerate([("GENERATED", "g"), (None, ""), ("ERROR", "a\nb"), ("ERROR", None)])]
    df = spark.createDataFrame(rows_, "instance_id int, mtime int, status string, final_reason string, notes string, error string")
    got = [(r.instance_id, r.status, r.reason) for r in snapshot.recent_failures(df, 2).collect()]
    assert got == [(3, "ERROR", "err"), (2, "ERROR", "a b")]
    folders = spark.createDataFrame([(True, True, True, 1), (True, False, False, 2)], "running boolean, has_test boolean, has_summary boolean, mtime int")
    assert tuple(snapshot.counters(folders).first()) == (2, 1, 1, 2) and tuple(snapshot.exclusive_counters(folders).first()) == (1, 1)


def test_stream_equals_batch(spark, tmp_path):
    events = spark.sql("select id as event_id, timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, int(id)) as ts, cast(id % 3 as string) as event_type from range(300)")
    events.repartition(5).write.parquet(str(tmp_path / "e"))
    stream = snapshot.event_stream(spark, str(tmp_path / "e"), 2)
    got = snapshot.drained(snapshot.status_totals(stream), str(tmp_path / "o"), str(tmp_path / "c"))
    want = snapshot.status_totals(events.withColumn("ts", F.col("ts").cast("timestamp")))
    assert rows(got, "event_type") == rows(want, "event_type")
    assert snapshot.windowed_totals(events.withColumn("ts", F.col("ts").cast("timestamp"))).agg(F.sum("n")).first()[0] == 300


def test_lines_are_ordered_by_file_and_place(spark, tmp_path):
    for name in ("b", "a", "c"):
        write(tmp_path / f"{name}.jsonl", "".join(f'{{"instance_id": "x", "v": "{name}{i}"}}\n' for i in range(300 if name == "a" else 2)))
    got = records.lines(spark, f"{tmp_path}/*.jsonl").orderBy("_pos").collect()
    assert [r.line[-5:-2].strip('"') for r in got][-4:] == ["b0", "b1", "c0", "c1"] and len(got) == 304
    rows_ = records.lines(spark, f"{tmp_path}/*.jsonl").select(records.parsed(F.col("line")).alias("row"), "_pos")
    last = ranking.last_wins(rows_.select(records.field(F.col("row"), "instance_id").alias("k"), records.field(F.col("row"), "v").alias("v"), "_pos"), ["k"], "_pos").first()
    assert last.v == "c1" and last._pos.file.endswith("a.jsonl")


def test_hits_under_other_names(spark, tmp_path):
    p = write(tmp_path / "h.json", '{"i": [{"file": "", "path": "t.py", "test_name": "n", "code": "c"}, {"file": "u.py", "name": 0, "content": [], "code": "d"}]}')
    assert rows(records.test_hits(records.load_hits(spark, p)).select("file", "name", "content"), "file") == [("t.py", "n", "c"), ("u.py", "", "d")]
    given = spark.createDataFrame([("z",), ("a",), ("z",)], "instance_id string")
    none = given.where("false")
    found = spark.createDataFrame([("formal_eval",), ("b",), ("a",)], "instance_id string")
    assert [r[0] for r in joins.requested_ids(given, found, none).collect()] == ["z", "a", "z"]
    assert [r[0] for r in joins.requested_ids(none, found, found.where("instance_id = 'b'")).collect()] == ["a", "b"]
