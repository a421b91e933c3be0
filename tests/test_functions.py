"""Column functions on literal rows against plain Python."""

import json

import pytest
from pyspark.sql import functions as F

from runsift.functions import json_values, paths, pyast, rules, text


def values(spark, rows, schema, *columns):
    df = spark.createDataFrame(rows, schema)
    return [tuple(r) for r in df.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).collect()]


def one(spark, column):
    return spark.range(1).select(column.alias("c")).first().c


TEXTS = ["", "a", "0123456789", "x\ny\n", "a\r\nb\x0bc\x0cd\x1ce\x85f\u2028g\u2029h", " \t pad \n", "é🙂日" * 9, "no end\r"]


@pytest.mark.parametrize("n", [-1, 0, 1, 5, 10, 100])
def test_shorten_middle(spark, n):
    def plain(t):
        return t if n <= 0 or len(t) <= n else t[: n // 2] + "\n...[TRUNCATED]...\n" + t[len(t) - (n - n // 2) :]

    got = values(spark, [(t,) for t in TEXTS], "t string", F.col("t"), text.shorten_middle(F.col("t"), n))
    assert all(out == plain(t) and (n <= 0 or len(out) <= n + 19) for t, out in got)


def test_lines_like_splitlines(spark):
    got = values(spark, [(t,) for t in TEXTS], "t string", F.col("t"), text.lines_of(F.col("t")), text.last_lines(F.col("t"), 2), text.strip(F.col("t")))
    for t, lines, last, stripped in got:
        assert lines == t.splitlines() and last == "\n".join(t.splitlines()[-2:]) and stripped == t.strip()


def test_tail_excerpt(spark):
    rows = [("out\n", None, "why"), ("", "", ""), (None, None, None), ("x" * 5000, "end ", "")]
    got = values(spark, rows, "a string, b string, c string", text.tail_excerpt(*map(F.col, "abc")))
    plain = ["\n".join(x or "" for x in r).strip()[-4000:] or None for r in rows]
    assert [g[0] for g in got] == plain


def test_truthy_and_issue_text(spark):
    rows = [("p", "i", "t", "d"), ("", "i", "t", "d"), (None, "", " t", "d "), (None, None, None, None)]
    got = values(spark, rows, "p string, i string, t string, d string", text.issue_text(F.col("p"), F.col("i"), F.lit(""), F.col("t"), F.col("d")))
    assert [g[0] for g in got] == ["p", "i", "t\n\nd", ""]


def test_code_block(spark):
    rows = ["```python\na = 1\n```\ntext ```\nlonger = 22\n```", "Sure.\ndefault x\nimport os", "plain", "", None, "words\n  from x import y\nz"]
    got = values(spark, [(r,) for r in rows], "t string", text.code_block(F.col("t")))
    assert [g[0] for g in got] == ["longer = 22", "default x\nimport os", "plain", "", "", "from x import y\nz"]


def test_names_and_words(spark):
    assert one(spark, text.sanitized(F.lit("a/b--c.d"))) == "a_b_c_d"
    assert one(spark, text.environment_name(F.lit("o/n"), F.lit("1.2"))) == "setup_o_n__1.2"
    assert one(spark, text.environment_name(F.lit("on"), F.lit("1"))) == "" == one(spark, text.environment_name(F.lit("o/n"), F.lit("")))
    assert one(spark, text.words_of_symptom(F.lit("Bad sum: of_x 12345 abc"))) == ["of_x", "12345"]
    assert [one(spark, text.parsed_bool(F.lit(w), r)) for w, r in ((" ON ", "run"), (" on", "wrapper"), ("on", "shell"), ("T", "shell"), ("no", "run"))] == [True, None, None, True, False]
    assert one(spark, text.backoff_seconds(F.lit(4))) == 180 and one(spark, text.percent(F.lit(75), F.lit(276))) == 27.1739
    assert one(spark, text.percent(F.lit(0), F.lit(0))) == 0 and one(spark, text.guessed_test_name(F.lit("x\ndef test_ab (self): pass"))) == "test_ab"
    items = F.array(F.struct(F.lit("p").alias("path"), F.lit("n").alias("name"), F.lit("c").alias("content")))
    assert one(spark, text.code_context(items)) == "[1] p::n\nc"
    assert one(spark, text.one_line(F.lit("a\nb"), 2)) == "a "


def test_source_window(spark):
    code = "\n".join(["x = 1"] * 40 + ["def f():"] + ["    y = 2"] * 1500)
    got = one(spark, text.source_window(F.lit(code))).split("\n")
    assert got[25] == "def f():" and len(got) <= 176 and one(spark, text.source_window(F.lit("short"))) == "short"


def status_of(spark, log, code=1, timeout=False, symptom="", apis=()):
    terms = rules.issue_terms(F.array(*map(F.lit, apis)).cast("array<string>"), F.lit(symptom))
    return one(spark, rules.execution_status(F.lit(code), rules.lowered(F.lit(log), F.lit("")), F.lit(timeout), F.lower(F.lit(symptom)), terms))


@pytest.mark.parametrize(
    "log, kw, want",
    [
        ("NameError: x", {}, "SETUP_ERROR"),
        ("NameError: x", {"symptom": "a NameError"}, "ISSUE_ALIGNED_FAIL"),
        ("", {"code": 0}, "PASS"),
        ("SyntaxError", {"timeout": True}, "TIMEOUT"),
        ("SyntaxError", {}, "SYNTAX_ERROR"),
        ("AttributeError: 'TestX' object has no attribute 'y'", {}, "SETUP_ERROR"),
        ("AppRegistryNotReady", {}, "SETUP_ERROR"),
        ('sqlite3.OperationalError: near "[]": syntax error', {}, "SETUP_ERROR"),
        ("ImportError: foo", {"symptom": "ImportError of bar", "apis": ["m.foo"]}, "ISSUE_ALIGNED_FAIL"),
        ("ImportError: foo", {"apis": ["m.foo"]}, "SETUP_ERROR"),
        ("cannot import name foo", {"symptom": "cannot import", "apis": ["m.foo"]}, "SETUP_ERROR"),
        ("collected 0 items", {}, "COLLECT_ERROR"),
        ("frob broke", {"apis": ["pkg.frob"]}, "ISSUE_ALIGNED_FAIL"),
        ("E assert 1 == 2", {}, "ASSERTION_FAIL"),
        ("asserting", {}, "UNRELATED_FAIL"),
    ],
)
def test_execution_status(spark, log, kw, want):
    assert status_of(spark, log, **kw) == want


def test_outcomes_are_total(spark):
    rows = [(a, b) for a in (True, False) for b in (True, False)]
    got = values(spark, rows, "b boolean, f boolean", F.col("b"), F.col("f"), rules.pair_outcome(F.col("b"), F.col("f")))
    assert {g[:2]: g[2] for g in got} == {(True, True): "FIXED_FAIL", (True, False): "F2P_SUCCESS", (False, True): "BUGGY_PASS", (False, False): "BUGGY_PASS"}
    assert one(spark, rules.pair_outcome(F.lit(True), F.lit(False), patch_failed=F.lit(True))) == "PATCH_APPLY_ERROR"
    assert one(spark, rules.strict_pair_outcome(F.lit("SETUP_ERROR"), F.lit("PASS"))) == "BUGGY_SETUP_ERROR"
    assert one(spark, rules.dual_outcome(F.lit(1), F.lit(1))) == "PATCHED_FAIL"


def test_setup_errors_count_as_failed(spark):
    r = one(spark, rules.run_result(F.lit(1), F.lit("ImportError"), F.lit(None).cast("string"), F.lit(False)))
    assert (r.status, r.failed, r.error_excerpt) == ("SETUP_ERROR", True, "ImportError")


def test_categories_disagree_as_documented(spark):
    cases = {"BUGGY_SETUP_ERROR": ("SETUP_ERROR", "ENV_OR_COLLECT"), "PATCH_APPLY_ERROR": ("PATCH_APPLY_ERROR", "PATCH_APPLY_ERROR"), "": (None, "UNKNOWN"), "ERROR": ("ERROR", "ERROR"), "ODD": ("UNRELATED_FAIL", "ODD")}
    got = values(spark, [(s,) for s in cases], "s string", F.col("s"), rules.failure_category(F.col("s")), rules.formal_category(F.col("s")))
    assert {s: (a, b) for s, a, b in got} == cases


def test_decisions(spark):
    gate = lambda *a: tuple(one(spark, rules.strict_gate(*map(F.lit, a))))
    assert gate("accept", "issue_aligned", True, True, True, 1, "ASSERTION_FAIL") == ("accept", "issue_aligned")
    assert gate("accept", "issue_aligned", False, True, True, 1, "X") == ("repair_trigger", "target_not_hit")
    assert gate("accept", "odd", True, True, True, 1, "X") == ("repair_oracle", "oracle_too_strong")
    assert gate("odd", "odd", True, True, True, 1, "X") == ("repair_trigger", "side_path")
    down = lambda reason: one(spark, rules.accept_downgrade(F.lit("accept"), F.lit(reason)))
    assert [down(r) for r in ("Setup Error", "did not trigger", "wrong oracle", "fine", "未能正确地触发")] == ["repair_setup", "repair_trigger", "repair_oracle", "accept", "repair_trigger"]
    assert tuple(one(spark, rules.forced_decision(F.lit("TIMEOUT")))) == ("reject", "timeout") and one(spark, rules.forced_decision(F.lit("X"))) is None
    assert one(spark, rules.phase(F.array(F.lit("generation.done")))) == "正式评测"
    assert one(spark, rules.missing_logging_target(F.lit("Logger is missing"))) and not one(spark, rules.missing_check_target(F.lit("check"), F.lit("")))
    assert one(spark, rules.import_trouble(F.lit("import x\nfailed"))) is False and one(spark, rules.import_trouble(F.lit("ImportError y"))) is True


def test_paths(spark):
    none = F.array().cast("array<string>")
    why = lambda p, s="a", r="b", allowed=none: one(spark, paths.patch_refusal(F.lit(p), F.lit(s), F.lit(r), F.lit("t.py"), allowed))
    assert [why(p) for p in ("", "/x", "a/../b", "t.py", "a/Tests/b.py", "conftest.py", "src\\a.py")] == ["unsafe"] * 3 + ["test_file"] * 3 + [None]
    assert why("a.py", "x", "x") == "no_op" and why("a.py", allowed=F.array(F.lit("b.py"))) == "not_allowed"
    patch = "diff --git a/x.py b/y.py\n+++ b/y.py\ndiff --git a/d.json b/d.json\ndiff --git a/tests/a/t.py b/tests/a/t.py\n"
    assert one(spark, paths.changed_files(F.lit(patch))) == ["d.json", "tests/a/t.py", "x.py", "y.py"]
    assert one(spark, paths.directives(F.lit(patch), F.lit("django/django"))) == ["y", "a.t"]
    assert one(spark, paths.needs_rebuild(F.lit(patch))) is False and one(spark, paths.needs_rebuild(F.lit("+++ b/q/A.PYX\n"))) is True
    assert one(spark, paths.relative(F.lit("/a/b/c"), F.lit("/a/"))) == "b/c" and one(spark, paths.relative(F.lit("/x"), F.lit("/a"))) == "/x"
    assert one(spark, paths.generated_test_path(F.lit("a-b"), F.lit("x.py"))) == "./test_brt_a_b.py"
    assert one(spark, paths.occurrences(F.lit("aaaa"), F.lit("aa"))) == 2


def test_json(spark):
    pick = lambda t: one(spark, F.to_json(json_values.json_object(F.lit(t))))
    assert [pick(t) for t in ('{"a":1}', 'x {"a":1} y', '```json\n{"b":2}\n``` {"a":1}', "[1]", "")] == ['{"a":1}', '{"a":1}', '{"b":2}', None, None]
    df = spark.createDataFrame([('{"a": NaN, "a": 2}',), ("x",), (None,)], "t string")
    assert [r.o for r in df.select(json_values.json_object_lenient(F.col("t")).alias("o")).collect()] == ['{"a": 2}', None, None]
    log = 'BRT_OBS_START {"a":1} BRT_OBS_END BRT_OBS_START [2] BRT_OBS_END BRT_OBS_START bad BRT_OBS_END'
    assert one(spark, json_values.last_observation(F.lit(log), F.lit(""))) == {"value": "[2]"}
    assert one(spark, json_values.merged_observations(F.lit(log))) == {"a": "1", "value": "[2]", "raw": "bad"}
    assert one(spark, json_values.last_observation(F.lit(""), F.lit(""))) == {}
    plan = one(spark, json_values.normalized_plan(F.array(*map(F.lit, ["X", "OPERATOR_FLIP", "OPERATOR_FLIP"])), F.lit("HIGH")))
    assert (plan.mutation_ops, plan.risk) == (["OPERATOR_FLIP", "OPERATOR_FLIP"], "high")
    fixed = one(spark, json_values.repaired_behaviour(F.parse_json(F.lit('{"target_apis": 5, "error_symptom": {"text": "t"}}'))))
    assert fixed.target_apis == "[]" and json.loads(fixed.error_symptom) == {"text": "t"} and fixed.expected_behavior == "{}"
    focus = lambda t: one(spark, json_values.focus(F.parse_json(F.lit(t)), ["d"]))
    assert [focus(t) for t in ('["a", "b"]', '"a"', '" "', "5")] == [["a", "b"], ["a"], ["d"], ["d"]]
    assert json_values.shown({"k": [1] * 12}) == {"k": [1] * 10 + [{"__truncated_items__": 2}]}


AUDITS = {
    "def f(": "syntax",
    "x = 1": "not_one_test",
    "def test_a():\n  pytest.skip('x')": "skip_call",
    "def test_a():\n  with pytest.raises(Exception): f()": "broad_raises",
    "@pytest.mark.skip\ndef test_a(): pass": "skip_decorator",
    "def test_a():\n  assert True": "assert_true",
    "def test_a():\n  assert x == 1 or x != 1": "tautology",
    "def test_a():\n  try: f()\n  except: pass": "swallowed_exception",
    "def test_a():\n  assert f() == 1": "",
    "def test_a():\n  assert a < b or a >= b": "tautology",
}


def test_python_source(spark):
    df = spark.createDataFrame([(c,) for c in AUDITS], "code string")
    got = df.select("code", pyast.audited(F.col("code"), F.lit("")).alias("a")).collect()
    assert {r.code: r.a for r in got} == AUDITS
    assert pyast.audit("def test_a():\n  with pytest.raises(ValueError): f()", "it should not raise") == "raises_against_expected"
    assert pyast.audit("def test_a():\n  assert not hasattr(x, 'y')", "should provide y") == "hasattr_against_expected"
    assert pyast.selector("class A:\n  def test_x(self): pass\ndef test_y(): pass") == "A::test_x" and pyast.selector("(") == ""
    assert pyast.brittle("assert a._b == 1") == "private" and pyast.brittle("assert a == 1") == ""
    assert pyast.replaced_once("a b", "a", "c", "f.py")[0] == "c b" and pyast.replaced_once("a a", "a", "c", "f")[2].endswith("found 2")
    assert pyast.wrapped("def test_a(self): pass").startswith("class TestGenerated:\n    def") and "placeholder" in pyast.wrapped("")
    assert pyast.find_test("class A:\n  def setUp(self): pass\n  def test_x(self): pass", "A::test_x")[1] == "A"
    assert pyast.protocol("def helper(): pass\ndef test_x(db): helper()", "test_x")[:2] == (["db"], ["helper"])
    row = df.limit(1).select(pyast.definitions_of(F.lit("@pytest.fixture\ndef db(): pass")).alias("d")).first().d
    assert row.fixtures == ["db"] and pyast.imports("import os\nx=1\nfrom a import b") == "import os\nfrom a import b"


def test_requirements_and_oracles(spark):
    assert one(spark, text.missing_dependency(F.lit("x No module named 'a.b' y"))) == "a" and one(spark, text.missing_dependency(F.lit("Requires the PyX python package"))) == "PyX"
    lines = F.array(*map(F.lit, ["# yaml", "-r yaml", " PyYAML>=5 ", "yaml_x"]))
    assert one(spark, text.declared_requirement(lines, F.lit("yaml2"))) == "PyYAML>=5" and one(spark, text.declared_requirement(lines, F.lit(""))) == ""
    assert one(spark, text.oracle_kind(F.lit("# BRT_ORACLE_TYPE: LOGGING"))) == "LOGGING" and one(spark, text.oracle_kind(F.lit("BRT_ORACLE_TYPE: X"))) == ""


@pytest.mark.parametrize(
    "status, audit, check, log, code, want",
    [
        ("SETUP_ERROR", "tautology", False, False, "", ("repair_setup", ["setup"])),
        ("PASS", "tautology", False, False, "", ("repair_oracle", ["oracle"])),
        ("PASS", "not_one_test", False, False, "", ("repair_trigger", ["trigger"])),
        ("PASS", "", True, False, "", ("repair_trigger", ["trigger", "oracle"])),
        ("ASSERTION_FAIL", "", True, False, "x.check()", ("accept", ["trigger", "oracle"])),
        ("ASSERTION_FAIL", "", True, False, "assertRaises x.check()", ("repair_oracle", ["oracle"])),
        ("ASSERTION_FAIL", "", False, True, "caplog", ("accept", ["trigger", "oracle"])),
        ("TIMEOUT", "", False, False, "", ("reject", ["setup"])),
        ("UNRELATED_FAIL", "", False, False, "", ("repair_trigger", ["trigger", "oracle"])),
    ],
)
def test_buggy_only(spark, status, audit, check, log, code, want):
    assert tuple(one(spark, rules.buggy_only_decision(*map(F.lit, (status, audit, check, log, code))))) == want


def test_paths_of_candidates(spark):
    why = lambda t, e, s, c: one(spark, rules.semantic_path_problem(F.lit(""), *map(F.lit, (t, e, s, c))))
    assert why("add check", "", "def check(self)", "x") == "check_not_called" and why("add check", "", "def check(self)", "pytest.raises a.check()") == "check_in_raises"
    assert why("logger missing", "", "", "patch('m.logger')") == "logger_patched" and why("logger missing", "", "", "x") == "log_not_observed" and why("other", "", "", "x") == ""
    fail = lambda c, l, n=False: one(spark, rules.persistent_setup_failure(F.lit(c), F.lit(l), F.lit(n)))
    assert fail("from a import foo, bar", "ImportError: cannot import name 'bar'") == "import_of_missing_name" and fail("import a", "ImportError: cannot import name 'bar'") == ""
    assert fail("x = 'ghost'", "ModuleNotFoundError: No module named 'ghost'") == "use_of_missing_module" and fail("", "<locals>", True) == "local_definitions"
    assert fail("ArrayField", 'near "[]": syntax error') == "array_field_table" and fail("call.run_manage()", "fetch_command KeyError:") == "command_not_registered"
    assert pyast.nested("def f():\n  class A: pass\n  def b(): pass") == "A, b"


def test_bounded_report_and_build_requirements(spark):
    short = one(spark, json_values.bounded_report(F.lit('{"a": 1}')))
    assert short == '{"a": 1}' and one(spark, json_values.bounded_report(F.lit(None).cast("string"))) == "{}"
    long = one(spark, json_values.bounded_report(F.lit("[" + ",".join(['"' + "x" * 3900 + '"'] * 9) + "]")))
    assert long.startswith('{"truncated_json":') and len(long) < 21_000
    assert pyast.build_requirements('[build-system]\nrequires = ["setuptools", "numpy==1", "Cython[x]>=3"]') == ["Cython[x]>=3"]
    assert pyast.build_requirements("x = [") == pyast.build_requirements(None) == pyast.build_requirements("build-system = 1") == []


def test_edit_sections_leave_out_items_without_a_path(spark):
    items = F.array(*[F.struct(F.lit(p).alias("path"), F.lit("n").alias("name"), F.lit("1").alias("start"), F.lit("2").alias("end"), F.lit("c").alias("content")) for p in ("", "a.py")])
    assert one(spark, text.edit_sections(items)) == "【允许修改源码 2】\npath: a.py\nobject: n\nlines: 1-2\ncode:\nc"
