"""Ordered first-match rules, each table one CASE expression over columns lowered once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import last_lines, truthy, words_of_symptom

NOT_EXECUTABLE = ("SETUP_ERROR", "SYNTAX_ERROR", "COLLECT_ERROR", "TIMEOUT")
SUCCESS = ("F2P_SUCCESS", "SURROGATE_F2P_SUCCESS")

# Marker words of logs, all in small letters.
SYNTAX_WORDS = ("syntaxerror", "indentationerror")
DEPENDENCY_WORDS = (
    "module 'numpy' has no attribute 'int'",
    "module 'numpy' has no attribute 'float'",
    "module 'numpy' has no attribute 'complex'",
    "failed to import the compiled extension",
    "cannot import name",
)
SETUP_WORDS = ("importerror", "modulenotfounderror", "fixture", "settings are not configured", "improperlyconfigured")
APP_WORDS = ("doesn't declare an explicit app_label", "isn't in an application in installed_apps", "apps aren't loaded yet", "appregistrynotready")
COLLECT_WORDS = ("collection error", "error collecting", "collected 0 items", "no tests ran", "not found:")
RUN_COLLECT_WORDS = ("no tests ran", "not found", "collected 0 items")
SELF_ATTRIBUTE = r"attributeerror:\s+['\"](?:test|test_)[^'\"]*['\"]\s+object has no attribute"
ACCEPT_DOWNGRADES = {
    "repair_setup": ("测试设置问题", "setup error", "setup问题", "环境问题", "环境配置问题", "测试自身异常", "未注册", "不存在的 fixture", "collection error"),
    "repair_trigger": ("未触发", "没有触发", "未执行到", "没有执行到", "触发条件不满足", "路径无关", "与issue无关", "unrelated failure", "did not trigger"),
    "repair_oracle": ("断言方向错误", "断言对象错误", "断言过于", "oracle错误", "期望行为不符", "把buggy行为", "assertion direction", "wrong oracle"),
}
NOT_TRIGGERED = "未(?:能|能正确|正确)?[^。；，,]{0,12}触发"
CHECK_WORDS, CHECK_MISSING = ("check", "检查", "验证"), ("add check", "missing", "no check", "缺少", "没有", "新增", "添加")
LOG_WORDS, LOG_MISSING = ("logger", "logging", "log message", "日志", "记录异常"), ("missing", "doesn't have", "没有", "缺少", "未记录")
STRICT_DECISIONS = ("accept", "repair_setup", "repair_trigger", "repair_oracle", "reject")
STRICT_CLASSES = ("setup", "syntax", "collect", "timeout", "buggy_pass", "target_not_hit", "side_path", "oracle_wrong", "oracle_too_strong", "issue_aligned")
FORCED = {
    "SETUP_ERROR": ("repair_setup", "setup"),
    "SYNTAX_ERROR": ("repair_setup", "syntax"),
    "COLLECT_ERROR": ("repair_setup", "collect"),
    "TIMEOUT": ("reject", "timeout"),
    "PASS": ("repair_trigger", "buggy_pass"),
}
PHASES = (("export.done", "完成"), ("evaluation.done", "导出"), ("generation.done", "正式评测"))
PHASE_START = "BRT 生成"


def first_match(rules: list[tuple[Column, object]], otherwise) -> Column:
    """CASE WHEN of (condition, label) pairs; a null condition does not match."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return reduce(lambda rest, rule: F.when(rule[0], lit(rule[1])).otherwise(rest), reversed(rules), lit(otherwise))


def has_any(text: Column, words) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def lowered(*texts: Column) -> Column:
    return F.lower(F.concat_ws("\n", *[F.coalesce(t, F.lit("")) for t in texts]))


def execution_status(code: Column, low: Column, timeout: Column, symptom: Column, terms: Column) -> Column:
    """One of eight labels for a finished command.

    low: lowered(stdout, stderr); symptom: the expected error text, lower case, '' if none; terms:
    issue_terms(...).  A log that matches no context rule is judged by its marker words.
    """
    has = lambda w: F.contains(low, F.lit(w))
    expects = lambda *ws: has_any(symptom, ws)
    aligned = F.exists(F.slice(terms, 1, 20), lambda t: F.contains(low, F.lower(t)))
    context = [
        has("nameerror:") & ~expects("nameerror"),
        F.regexp_like(low, F.lit(SELF_ATTRIBUTE)) & ~expects("attributeerror"),
        has_any(low, APP_WORDS),
        has("django/core/management/__init__.py") & has("fetch_command") & has_any(low, ("keyerror:", "unknown command:")),
        has("noreversematch") & ~expects("noreversematch"),
        has_any(low, ("sqlite3.operationalerror", "django.db.utils.operationalerror")) & has('near "[]": syntax error') & ~expects("sqlite", "syntax error", "operationalerror"),
        has("systemcheckerror") & has("system check identified") & ~expects("system check", "systemcheckerror", "fields.e", "models.e"),
        has_any(low, DEPENDENCY_WORDS),
    ]
    setup = has_any(low, SETUP_WORDS)
    return first_match(
        [
            (timeout, "TIMEOUT"),
            (code == 0, "PASS"),
            (has_any(low, SYNTAX_WORDS), "SYNTAX_ERROR"),
            *[(c, "SETUP_ERROR") for c in context],
            (setup & expects("importerror", "module not found", "cannot import") & aligned, "ISSUE_ALIGNED_FAIL"),
            (setup, "SETUP_ERROR"),
            (has_any(low, COLLECT_WORDS), "COLLECT_ERROR"),
            (aligned, "ISSUE_ALIGNED_FAIL"),
            (has("assertionerror") | F.regexp_like(low, F.lit(r"\bassert\b")), "ASSERTION_FAIL"),
        ],
        "UNRELATED_FAIL",
    )


def issue_terms(api_names: Column, symptom: Column) -> Column:
    """Last dotted part of each API name that is not empty, then the symptom's words of four characters or more."""
    names = F.filter(api_names, lambda x: F.coalesce(x, F.lit("")) != "")
    return F.concat(F.transform(names, lambda x: F.substring_index(x, ".", -1)), words_of_symptom(symptom))


def run_result(code: Column, stdout: Column, stderr: Column, timeout: Column) -> Column:
    """struct(status, failed, error_excerpt); everything but PASS counts as failed."""
    text = F.concat(F.coalesce(stdout, F.lit("")), F.lit("\n"), F.coalesce(stderr, F.lit("")))
    low = F.lower(text)
    status = first_match(
        [
            (timeout, "TIMEOUT"),
            (code == 0, "PASS"),
            (has_any(low, SYNTAX_WORDS), "SYNTAX_ERROR"),
            (has_any(low, SETUP_WORDS), "SETUP_ERROR"),
            (has_any(low, RUN_COLLECT_WORDS), "COLLECT_ERROR"),
        ],
        "FAIL",
    )
    return F.struct(status.alias("status"), (status != "PASS").alias("failed"), last_lines(text, 80).alias("error_excerpt"))


def pair_outcome(buggy_failed: Column, fixed_failed: Column, buggy_setup=None, patch_failed=None, fixed_setup=None, error=None) -> Column:
    """Outcome of a test on the buggy and the fixed version; the flags short-circuit in order and may be left out."""
    flag = lambda c: F.coalesce(c, F.lit(False)) if c is not None else F.lit(False)
    return first_match(
        [
            (flag(error), "ERROR"),
            (flag(buggy_setup), "BUGGY_SETUP_ERROR"),
            (flag(patch_failed), "PATCH_APPLY_ERROR"),
            (flag(fixed_setup), "FIXED_SETUP_ERROR"),
            (buggy_failed & ~fixed_failed, "F2P_SUCCESS"),
            (~buggy_failed, "BUGGY_PASS"),
            (fixed_failed, "FIXED_FAIL"),
        ],
        "UNKNOWN",
    )


def strict_pair_outcome(buggy_status: Column, fixed_status: Column) -> Column:
    """An extra: as pair_outcome, but a run that could not be executed is no failure of the test."""
    return first_match(
        [
            (buggy_status.isin(*NOT_EXECUTABLE), "BUGGY_SETUP_ERROR"),
            (fixed_status.isin(*NOT_EXECUTABLE), "FIXED_SETUP_ERROR"),
            (buggy_status == "PASS", "BUGGY_PASS"),
            (fixed_status == "PASS", "F2P_SUCCESS"),
        ],
        "FIXED_FAIL",
    )


def dual_outcome(buggy_code: Column, patched_code: Column) -> Column:
    return first_match([((buggy_code != 0) & (patched_code == 0), "F2P_SUCCESS"), (buggy_code == 0, "BUGGY_PASS"), (patched_code != 0, "PATCHED_FAIL")], "SETUP_ERROR")


def pair_status(mode: Column, buggy_code: Column, patched_code: Column, has_input: Column, applied: Column) -> Column:
    """struct(status, note) of one comparison of two versions.

    mode: buggy_only, patched_repo, patch_file or patch_text; has_input: whether the patched version or the
    patch is there; applied: whether the patch text could be applied.
    """
    lacks = F.when(mode == "patched_repo", "missing patched_repo_base").otherwise(F.concat(F.lit("missing "), mode))
    known = mode.isin("patched_repo", "patch_file", "patch_text")
    status = first_match(
        [
            (mode == "buggy_only", "BUGGY_ONLY"),
            (~known, "NOT_IMPLEMENTED"),
            (~has_input, "SETUP_ERROR"),
            ((mode == "patch_text") & ~applied, "PATCH_APPLY_ERROR"),
            ((buggy_code != 0) & (patched_code == 0), "F2P_SUCCESS"),
            (buggy_code == 0, "BUGGY_PASS"),
        ],
        "PATCHED_FAIL",
    )
    return F.struct(status.alias("status"), F.when(known & ~has_input, lacks).otherwise("").alias("note"))


def failure_category(status: Column) -> Column:
    """Reporting category; null for success and for no status."""
    status = F.coalesce(status, F.lit(""))
    return first_match(
        [
            (status.isin("", "F2P_SUCCESS"), F.lit(None).cast("string")),
            (status == "BUGGY_PASS", "BUGGY_PASS"),
            (status.isin("FIXED_FAIL", "PATCHED_FAIL"), "FIXED_FAIL"),
            (F.contains(status, F.lit("PATCH_APPLY")), "PATCH_APPLY_ERROR"),
            *[(F.contains(status, F.lit(c.replace("_ERROR", ""))), c) for c in NOT_EXECUTABLE],
            (status.isin("ERROR", "UNKNOWN", "MISSING_GENERATED_TEST"), status),
        ],
        "UNRELATED_FAIL",
    )


def formal_category(status: Column) -> Column:
    status = F.when(F.coalesce(status, F.lit("")) == "", "UNKNOWN").otherwise(status)
    return first_match([(status.isin("F2P_SUCCESS", "BUGGY_PASS", "FIXED_FAIL"), status), (has_any(status, ("SETUP", "COLLECT", "SYNTAX", "TIMEOUT")), "ENV_OR_COLLECT")], status)


def checkpoint_score(code: Column, status: Column, decision: Column, dual: Column) -> Column:
    """struct(score, reason) of an attempt."""
    label = lambda score, reason: F.struct(F.lit(score).alias("score"), (reason if isinstance(reason, Column) else F.lit(reason)).alias("reason"))
    return first_match(
        [
            (dual.isin(*SUCCESS), label(300, "buggy fail and independently generated surrogate patch pass")),
            ((decision == "accept") & (code != 0), label(200, "buggy fail accepted by semantic verifier")),
            ((code != 0) & ~status.isin(*NOT_EXECUTABLE), label(100, "executable buggy failure not accepted as issue-aligned")),
            (code == 0, label(10, "test passes on buggy source")),
        ],
        label(0, F.concat(F.lit("non-executable candidate: "), status)),
    )


def final_status(code: Column, status: Column, decision: Column, dual: Column) -> Column:
    return first_match(
        [(dual.isin(*SUCCESS), dual), (decision == "accept", "ISSUE_ALIGNED_FAIL"), (status.isin(*NOT_EXECUTABLE), status), (code != 0, "UNRELATED_FAIL")],
        status,
    )


def forced_decision(status: Column) -> Column:
    """struct(decision, failure_class) that an execution status forces; null if none."""
    pair = lambda d, c: F.struct(F.lit(d).alias("decision"), F.lit(c).alias("failure_class"))
    return first_match([(status == s, pair(*v)) for s, v in FORCED.items()], F.lit(None).cast("struct<decision:string,failure_class:string>"))


def strict_gate(decision: Column, failure: Column, hit: Column, grounded: Column, public: Column, code: Column, status: Column) -> Column:
    """struct(decision, failure_class) after clamping to the known words and demanding all conditions of an accept."""
    decision = F.when(decision.isin(*STRICT_DECISIONS), decision).otherwise("repair_trigger")
    failure = F.when(failure.isin(*STRICT_CLASSES), failure).otherwise("side_path")
    hit, grounded, public = (F.coalesce(c, F.lit(False)) for c in (hit, grounded, public))
    sound = (code != 0) & ~status.isin(*NOT_EXECUTABLE) & (failure == "issue_aligned") & hit & grounded & public
    pair = lambda d, c: F.struct(F.lit(d).alias("decision"), F.lit(c).alias("failure_class"))
    refused = first_match([(~hit, pair("repair_trigger", "target_not_hit")), (~grounded, pair("repair_oracle", "oracle_wrong"))], pair("repair_oracle", "oracle_too_strong"))
    return F.when((decision == "accept") & ~F.coalesce(sound, F.lit(False)), refused).otherwise(F.struct(decision.alias("decision"), failure.alias("failure_class")))


def accept_downgrade(decision: Column, reason: Column) -> Column:
    """The decision, where an accept's reason text speaks against it the repair that it calls for."""
    low = F.lower(F.coalesce(reason, F.lit("")))
    setup, trigger, oracle = (has_any(low, ACCEPT_DOWNGRADES[k]) for k in ("repair_setup", "repair_trigger", "repair_oracle"))
    lower = first_match([(setup, "repair_setup"), (trigger | F.regexp_like(low, F.lit(NOT_TRIGGERED)), "repair_trigger"), (oracle, "repair_oracle")], decision)
    return F.when(decision == "accept", lower).otherwise(decision)


def missing_check_target(text: Column, source: Column) -> Column:
    return has_any(F.lower(text), CHECK_WORDS) & has_any(F.lower(text), CHECK_MISSING) & F.contains(source, F.lit("def check("))


def missing_logging_target(text: Column) -> Column:
    return has_any(F.lower(text), LOG_WORDS) & has_any(F.lower(text), LOG_MISSING)


def framework(source: Column, bases: Column) -> Column:
    source, bases = F.coalesce(source, F.lit("")), F.coalesce(bases, F.lit(""))
    has = lambda w: F.contains(source, F.lit(w))
    return first_match(
        [
            (has("django.test") | F.regexp_like(bases, F.lit(r"\b(?:TestCase|TransactionTestCase|SimpleTestCase)\b")), "django"),
            (has("unittest") | F.contains(bases, F.lit("TestCase")), "unittest"),
            (has("pytest"), "pytest"),
            (has("def test"), "pytest"),
        ],
        "unknown",
    )


def import_trouble(text: Column) -> Column:
    """Whether a line with "attribute" or "import" also has "error" or "fail"."""
    lines = F.split(F.lower(F.coalesce(text, F.lit(""))), "\n")
    return F.exists(lines, lambda x: has_any(x, ("attribute", "import")) & has_any(x, ("error", "fail")))


def phase(markers: Column) -> Column:
    """Phase of a run from the names of its marker files."""
    return first_match([(F.array_contains(markers, name), label) for name, label in PHASES], PHASE_START)


PYTEST_PROJECTS = ("astropy", "matplotlib", "flask", "xarray", "pylint", "scikit-learn", "sphinx", "requests")
OLD_MATPLOTLIB = ("3.0", "3.1", "3.2", "3.3", "3.4")
# Commands that prepare a project.
EDITABLE = "python -m pip install --ignore-installed --no-deps -e ."
IN_PLACE = "python setup.py build_ext --inplace"
ASTROPY_SETUP = (
    r"""if [ -f pyproject.toml ]; then sed -i 's/requires = \["setuptools",/requires = ["setuptools==68.0.0",/' pyproject.toml; fi"""
    r""" && python -m pip install --ignore-installed --no-deps -e ."[test]" --verbose"""
)


def test_command(repo: Column, file: Column, selector: Column) -> Column:
    """Shell command that runs one test; null for a project that is not known."""
    project, selector = F.substring_index(repo, "/", -1), F.coalesce(selector, F.lit(""))
    node = F.when(selector == "", file).otherwise(F.concat(file, F.lit("::"), selector))
    label = F.replace(F.replace(F.replace(node, F.lit(".py"), F.lit("")), F.lit("/"), F.lit(".")), F.lit("::"), F.lit("."))
    label = F.regexp_replace(label, r"^tests\.", "")
    with_name = F.when(selector == "", "").otherwise(F.concat(F.lit(" -k "), F.substring_index(selector, "::", -1)))
    return first_match(
        [
            (project.isin(*PYTEST_PROJECTS), F.concat(F.lit("python -m pytest --no-header --tb=short --show-capture=no --disable-warnings -p no:cacheprovider "), node)),
            (project == "seaborn", F.concat(F.lit("pytest --no-header --show-capture=no --disable-warnings "), node)),
            (project == "pytest", F.concat(F.lit("pytest --disable-warnings --show-capture=no "), node, F.lit(" -v"))),
            (project == "django", F.concat(F.lit("./tests/runtests.py --settings=test_sqlite "), label)),
            (project == "sympy", F.concat(F.lit("PYTHONWARNINGS='ignore::UserWarning,ignore::SyntaxWarning' bin/test -C "), file, with_name)),
        ],
        F.lit(None).cast("string"),
    )


def setup_command(repo: Column, version: Column) -> Column:
    project = F.substring_index(repo, "/", -1)
    return first_match([(project == "astropy", ASTROPY_SETUP), ((project == "matplotlib") & version.isin(*OLD_MATPLOTLIB), IN_PLACE)], EDITABLE)


def status_or(status: Column, word: str) -> Column:
    """The status, or a word for a null or empty one."""
    return F.when(truthy(status) == "", word).otherwise(status)


ORACLE_AUDITS = ("broad_raises", "assert_true", "tautology", "raises_against_expected", "hasattr_against_expected")


def buggy_only_decision(status: Column, audit: Column, check_missing: Column, log_missing: Column, code: Column) -> Column:
    """struct(decision, focus) from a run on the buggy version alone, by rules.

    audit: label of the candidate's audit, '' if sound; check_missing and log_missing: whether the issue
    wants a check or a log that is not there yet.  A failure whose alignment no rule decides is to be repaired.
    """
    has = lambda *ws: has_any(F.coalesce(code, F.lit("")), ws)
    says = lambda d, *f: F.struct(F.lit(d).alias("decision"), F.array(*map(F.lit, f)).alias("focus"))
    failed = status == "ASSERTION_FAIL"
    return first_match(
        [
            (status.isin("SETUP_ERROR", "SYNTAX_ERROR", "COLLECT_ERROR"), says("repair_setup", "setup")),
            (audit.isin(*ORACLE_AUDITS), says("repair_oracle", "oracle")),
            (audit != "", says("repair_trigger", "trigger")),
            ((status == "PASS") & check_missing, says("repair_trigger", "trigger", "oracle")),
            (status == "PASS", says("repair_trigger", "trigger")),
            (failed & check_missing & has(".check(") & ~has("assertRaises", "pytest.raises"), says("accept", "trigger", "oracle")),
            (failed & log_missing & has("assertLogs", "caplog"), says("accept", "trigger", "oracle")),
            (failed, says("repair_oracle", "oracle")),
            (status == "ISSUE_ALIGNED_FAIL", says("repair_trigger", "trigger")),
            (status == "TIMEOUT", says("reject", "setup")),
        ],
        says("repair_trigger", "trigger", "oracle"),
    )


# Reasons and next actions of a decision on the buggy version.
SETUP_ACTION = "修复 import、fixture、class、setup 或语法。"
CHECK_SETUP_ACTION = (
    "保留真实 check() 调用，只修复字段/对象缺少模型绑定、name、app_label "
    "或其他元数据的问题。优先复用 HostContext 模型并通过 _meta.get_field() "
    "取得字段；standalone Field 可调用 set_attributes_from_name()。"
)
CHECK_PASS = (
    "这是缺失系统检查类 Issue；buggy 版本通过说明当前测试没有用 check() 观察修复后应新增的检查证据。",
    "必须调用源码真实 check() 生命周期，并断言 expected_behavior 要求新增的稳定检查结果存在；不得改用 clean()、save()、构造器异常或普通值长度验证替代系统检查。",
)
PLAIN_PASS = ("buggy 版本通过，说明缺陷路径未触发。", "加强输入、状态或调用链变异。")
CHECK_ACCEPT = (
    "测试调用了源码中的 check() 生命周期，并因修复后应出现的检查证据在 buggy 版本中缺失而断言失败；这与缺少检查类 Issue 对齐。",
    "接受当前 BRT。",
)
LOG_ACCEPT = ("测试调用了目标行为并捕获修复后应出现的日志；buggy 版本因没有日志证据而断言失败，与缺失日志类 Issue 对齐。", "接受当前 BRT。")
UNSURE_ASSERT = ("断言失败但是否对齐不确定。", "插桩观测后重写 assert。")
UNSURE_WORDS = ("关键词规则认为相关，但未完成语义验证。", "重新核对目标 API、输入和失败语义。")
TIMED_OUT = ("执行超时。", "放弃或缩小测试。")
NOT_ALIGNED_ACTION = "重新对齐触发路径。"


def buggy_only_verdict(status: Column, audit: Column, audit_text: Column, check_missing: Column, log_missing: Column, code: Column) -> Column:
    """struct(decision, reason, focus, next_action): buggy_only_decision with the texts that go with it.

    audit_text: the audit's own words, which are reason and action of what it finds.
    """
    has = lambda *ws: has_any(F.coalesce(code, F.lit("")), ws)
    choice = buggy_only_decision(status, audit, check_missing, log_missing, code)
    pair = lambda reason, action: F.struct(*[(x if isinstance(x, Column) else F.lit(x)).alias(n) for x, n in ((reason, "reason"), (action, "next_action"))])
    failed = status == "ASSERTION_FAIL"
    texts = first_match(
        [
            (status.isin("SETUP_ERROR", "SYNTAX_ERROR", "COLLECT_ERROR"), pair(status, F.when(check_missing & has(".check("), CHECK_SETUP_ACTION).otherwise(SETUP_ACTION))),
            (audit != "", pair(audit_text, audit_text)),
            ((status == "PASS") & check_missing, pair(*CHECK_PASS)),
            (status == "PASS", pair(*PLAIN_PASS)),
            (failed & (choice["decision"] == "accept") & check_missing & has(".check(") & ~has("assertRaises", "pytest.raises"), pair(*CHECK_ACCEPT)),
            (failed & (choice["decision"] == "accept"), pair(*LOG_ACCEPT)),
            (failed, pair(*UNSURE_ASSERT)),
            (status == "ISSUE_ALIGNED_FAIL", pair(*UNSURE_WORDS)),
            (status == "TIMEOUT", pair(*TIMED_OUT)),
        ],
        pair(F.concat(F.lit("失败类型 "), status, F.lit("，和 issue 对齐不足。")), NOT_ALIGNED_ACTION),
    )
    return F.struct(choice["decision"].alias("decision"), texts["reason"].alias("reason"), choice["focus"].alias("focus"), texts["next_action"].alias("next_action"))


#: Words of an expected behaviour that is an exception.
EXCEPTION_WORDS = ("抛出", "异常", "raise", "exception")


def semantic_path_problem(audit: Column, text: Column, expected: Column, source: Column, code: Column) -> Column:
    """Label of what keeps a candidate from the issue's path; '' if nothing does."""
    low = F.lower(text)
    like = lambda c, p: F.regexp_like(c, F.lit(p))
    check = has_any(low, CHECK_WORDS) & has_any(low, CHECK_MISSING) & like(source, r"\bdef\s+check\s*\(")
    log = missing_logging_target(text)
    return first_match(
        [
            (audit != "", audit),
            (check & ~like(code, r"\.\s*check\s*\("), "check_not_called"),
            (check & ~has_any(F.lower(expected), EXCEPTION_WORDS) & like(code, r"(?:assertRaises|pytest\.raises)"), "check_in_raises"),
            (log & like(code, r"(?:patch|patch\.object)\s*\([^)]*logger"), "logger_patched"),
            (log & ~has_any(code, ("assertLogs", "caplog")), "log_not_observed"),
        ],
        "",
    )


def persistent_setup_failure(code: Column, log: Column, nested: Column) -> Column:
    """Label of a setup failure that the code still brings about; '' if none is known.

    nested: whether the code defines classes or functions inside functions (pyast.has_nested).
    """
    has = lambda c, w: F.contains(c, F.lit(w))
    like = lambda c, p: F.regexp_like(c, F.lit(p))
    symbol = F.regexp_extract(log, r"(?i)ImportError:\s+cannot import name\s+['\"]?([A-Za-z_][A-Za-z0-9_]*)", 1)
    module = F.regexp_extract(log, r"(?i)ModuleNotFoundError:\s+No module named\s+['\"]([^'\"]+)", 1)
    imported = F.regexp_like(code, F.concat(F.lit(r"(?m)^\s*from\s+\S+\s+import\s+[^\n]*\b"), symbol, F.lit(r"\b")))
    return first_match(
        [
            (has(log, 'near "[]": syntax error') & has(code, "ArrayField") & ~like(code, r"\bmanaged\s*=\s*False\b"), "array_field_table"),
            (has(log, "fetch_command") & has(log, "KeyError:") & like(code, r"execute_from_command_line|\.\s*run_manage\s*\("), "command_not_registered"),
            (has(log, "<locals>") & nested, "local_definitions"),
            ((symbol != "") & imported, "import_of_missing_name"),
            ((module != "") & F.contains(code, module), "use_of_missing_module"),
        ],
        "",
    )
