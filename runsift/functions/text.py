"""Text scalars as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: what stands between head and tail of a shortened text.
CUT_MARK = "\n...[TRUNCATED]...\n"
#: Fixed value: line borders of Python's str.splitlines, for Java's regular expressions.
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
#: Fixed value: beginnings of a Python statement line.
PYTHON_START = r"^\s*(import|from|def|class|@|pytestmark\s*=|try:|with\s+)"


def truthy(*columns: Column | str) -> Column:
    """The first column that is neither null nor empty; '' if there is none."""
    made = [F.col(c) if isinstance(c, str) else c for c in columns]
    return F.coalesce(*[F.nullif(c.cast("string"), F.lit("")) for c in made], F.lit(""))


def strip(text: Column) -> Column:
    """The text without white space at both ends (not only blanks)."""
    return F.regexp_replace(text, r"^[\s\x1c-\x1f\x85]+|[\s\x1c-\x1f\x85]+$", "")


def shorten_middle(text: Column, limit: int) -> Column:
    """Head, mark and tail of a text longer than limit; the mark is extra; limit <= 0 leaves the text."""
    if limit <= 0:
        return text
    head, tail = limit // 2, limit - limit // 2
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.substring(text, 1, head), F.lit(CUT_MARK), F.right(text, F.lit(tail))))


def tail_excerpt(*parts: Column, limit: int = 4000) -> Column:
    """The last characters of the parts joined by newlines and stripped; null if nothing is left."""
    joined = strip(F.concat_ws("\n", *[F.coalesce(p, F.lit("")) for p in parts]))
    return F.nullif(F.right(joined, F.lit(limit)), F.lit(""))


def lines_of(text: Column) -> Column:
    """The lines as str.splitlines gives them: no empty line after a final break."""
    cut = F.split(text, LINE_BREAK)
    return F.when(text == "", F.array().cast("array<string>")).when(F.element_at(cut, -1) == "", F.slice(cut, 1, F.size(cut) - 1)).otherwise(cut)


def last_lines(text: Column, n: int) -> Column:
    lines = lines_of(text)
    return F.array_join(F.slice(lines, F.greatest(F.size(lines) - n + 1, F.lit(1)), n), "\n")


def head(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def one_line(text: Column, n: int) -> Column:
    return head(F.replace(text, F.lit("\n"), F.lit(" ")), n)


def code_block(text: Column) -> Column:
    """The longest fenced block (the first of equals), else the text from its first Python line on, else the text."""
    raw = strip(F.coalesce(text, F.lit("")))
    blocks = F.transform(F.regexp_extract_all(raw, F.lit(r"(?is)```(?:python|py)?\s*(.*?)```"), F.lit(1)), strip)
    longest = F.aggregate(blocks, F.lit(""), lambda best, b: F.when(F.length(b) > F.length(best), b).otherwise(best))
    lines = lines_of(raw)
    first = F.array_position(F.transform(lines, lambda x: F.regexp_like(x, F.lit(PYTHON_START))), True).cast("int")
    from_code = strip(F.array_join(F.slice(lines, first, F.size(lines)), "\n"))
    return F.when(F.size(blocks) > 0, longest).when(first > 0, from_code).otherwise(raw)


def issue_text(problem: Column, issue: Column, other: Column, title: Column, description: Column) -> Column:
    both = strip(F.concat(F.coalesce(title, F.lit("")), F.lit("\n\n"), F.coalesce(description, F.lit(""))))
    return truthy(problem, issue, other, both)


def sanitized(name: Column) -> Column:
    return F.regexp_replace(name, "[^0-9A-Za-z_]+", "_")


def environment_name(repo: Column, version: Column) -> Column:
    """setup_<owner>_<name>__<version>; '' if the version is missing or the repository has no slash."""
    named = F.contains(F.coalesce(repo, F.lit("")), F.lit("/")) & (truthy(version) != "")
    return F.when(named, F.concat(F.lit("setup_"), F.regexp_replace(repo, "^([^/]*)/", "$1_"), F.lit("__"), version)).otherwise("")


#: Words for true and false of three readers, and whether a reader trims.
TRUE_WORDS = {"run": ("1", "true", "yes", "on"), "wrapper": ("1", "true", "yes", "on"), "shell": ("true", "t", "yes", "y", "1")}
FALSE_WORDS = {"run": ("0", "false", "no", "off"), "wrapper": ("0", "false", "no", "off"), "shell": ("false", "f", "no", "n", "0")}


def parsed_bool(text: Column, reader: str = "run") -> Column:
    """true, false, or null for a word that the reader refuses."""
    low = F.lower(strip(text) if reader == "run" else text)
    return F.when(low.isin(*TRUE_WORDS[reader]), True).when(low.isin(*FALSE_WORDS[reader]), False)


def words_of_symptom(text: Column, least: int = 4) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "[^A-Za-z0-9_]+"), lambda x: F.length(x) >= least)


def last_dotted(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def guessed_test_name(code: Column) -> Column:
    return F.regexp_extract(code, r"def\s+(test_[A-Za-z0-9_]+)\s*\(", 1)


def code_context(items: Column, limit: int = 18_000) -> Column:
    """Numbered sections of array<struct<path, name, content>>, shortened in the middle."""
    numbered = F.transform(items, lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x["path"], F.lit("::"), x["name"], F.lit("\n"), x["content"]))
    return shorten_middle(F.array_join(numbered, "\n\n"), limit)


# Labels of the sections that a reader is shown.
SOURCE_SECTION = (("【源码片段 ", "】\n文件路径："), "\n对象名称：", "\n节点类型：", "\n父节点：", "\n行号范围：", "-", "\n代码：\n")
TEST_SECTION = (("【相关测试 ", "】\n测试文件："), "\n测试名称：", "\n测试代码：\n")
EDIT_SECTION = (("【允许修改源码 ", "】\npath: "), "\nobject: ", "\nlines: ", "-", "\ncode:\n")


def _sections(items: Column, labels, fields: list[str], end: str, between: str, limit: int) -> Column:
    (first, second), *others = labels

    def section(x, i):
        parts = [F.lit(first), (i + 1).cast("string"), F.lit(second), x[fields[0]]]
        for label, name in zip(others, fields[1:]):
            parts += [F.lit(label), x[name]]
        return F.concat(*[F.coalesce(p, F.lit("")) for p in parts], F.lit(end))

    return shorten_middle(F.array_join(F.transform(items, section), between), limit)


def source_sections(items: Column, limit: int = 18_000) -> Column:
    """Numbered sections of array<struct<path, name, node_type, parent, start, end, content>>."""
    return _sections(items, SOURCE_SECTION, ["path", "name", "node_type", "parent", "start", "end", "content"], "\n", "\n", limit)


def test_sections(items: Column, limit: int = 18_000) -> Column:
    """Numbered sections of array<struct<file, name, content>>."""
    return _sections(items, TEST_SECTION, ["file", "name", "content"], "\n", "\n", limit)


def edit_sections(items: Column, limit: int = 30_000) -> Column:
    """Numbered sections of array<struct<path, name, start, end, content>>; an item without a path is left out, its number with it."""
    numbered = F.transform(items, lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    kept = F.filter(numbered, lambda y: F.coalesce(y["x"]["path"], F.lit("")) != "")
    (first, second), *others = EDIT_SECTION

    def section(y):
        x, parts = y["x"], [F.lit(first), (y["i"] + 1).cast("string"), F.lit(second), y["x"]["path"]]
        for label, name in zip(others, ["name", "start", "end", "content"]):
            parts += [F.lit(label), x[name]]
        return F.concat(*[F.coalesce(p, F.lit("")) for p in parts])

    return shorten_middle(F.array_join(F.transform(kept, section), "\n\n"), limit)


def source_excerpt(source: Column, content: Column, start: Column, end: Column, whole: int = 20_000, around: int = 120, limit: int = 9_000) -> Column:
    """A short source whole; of a long one the lines from ``around`` before start to ``around`` after end, or all if these are no numbers; without a source the hit's own content."""
    lines = lines_of(source)
    from_line, to_line = start.try_cast("int"), end.try_cast("int")
    first = F.greatest(from_line - around, F.lit(1))
    last = F.least(to_line + around, F.size(lines))
    part = F.when(from_line.isNotNull() & to_line.isNotNull(), F.array_join(F.slice(lines, first, F.greatest(last - first + 1, F.lit(0))), "\n"))
    return F.when(source.isNull(), content).when(F.length(source) <= whole, source).otherwise(shorten_middle(F.coalesce(part, source), limit))


def time_text(moment: Column | None = None) -> Column:
    """A time, or now, as text to the second."""
    return F.date_format(F.current_timestamp() if moment is None else moment, "yyyy-MM-dd HH:mm:ss")


def source_window(code: Column, before: int = 25, after: int = 150, whole: int = 10_000) -> Column:
    """A short source whole; of a long one the lines around its first def or class."""
    lines = F.split(code, "\n")
    at = F.array_position(F.transform(lines, lambda x: F.regexp_like(x, F.lit(r"^\s*(def|class)\s"))), True).cast("int")
    start = F.greatest(at - before, F.lit(1))
    part = F.array_join(F.slice(lines, start, at + after - start + 1), "\n")
    return F.when(F.length(code) <= whole, code).otherwise(head(F.when(at > 0, part).otherwise(code), whole))


def enhanced_issue(text: Column, sections: dict[str, Column]) -> Column:
    """The issue followed by its sections as JSON; sections that are null are left out."""
    parts = [F.when(c.isNotNull(), F.concat(F.lit(f"## {name}\n"), F.to_json(c))) for name, c in sections.items()]
    return F.concat_ws("\n\n", text, *parts)


def percent(part: Column, whole: Column) -> Column:
    return F.round(100.0 * F.coalesce(F.try_divide(part, whole), F.lit(0.0)), 4)


def backoff_seconds(attempt: Column, base: float = 15, cap: float = 180) -> Column:
    return F.least(F.lit(base) * F.pow(F.lit(2.0), attempt), F.lit(cap))


def wait_seconds(code: Column, attempt: Column, attempts: Column, retry_after: Column) -> Column:
    """Seconds to wait behind a failed attempt; null behind the last.

    An answer of 429 waits as long as it says, if it says a number, and at least 30 seconds doubled with each attempt up to 300.
    """
    said = F.coalesce(retry_after.try_cast("double"), F.lit(0.0))
    limited = F.greatest(said, backoff_seconds(attempt, 30, 300))
    return F.when(attempt < attempts - 1, F.when(F.coalesce(code == 429, F.lit(False)), limited).otherwise(backoff_seconds(attempt)))


#: Kinds of oracle that generated code may name.
ORACLE_KINDS = ("NO_EXCEPTION", "EXCEPTION_TYPE", "WARNING", "LOGGING", "EXACT_VALUE", "TYPE_OR_SHAPE", "STATE_CHANGE", "SQL_VALIDITY", "SERIALIZATION", "RENDER_OUTPUT", "ORDERING")


def oracle_kind(code: Column) -> Column:
    """The kind that the first mark in the code names; '' if there is none or it is not known."""
    named = F.regexp_extract(code, r"BRT_ORACLE_TYPE:\s*([A-Z_]+)", 1)
    return F.when(named.isin(*ORACLE_KINDS), named).otherwise("")


def missing_dependency(log: Column) -> Column:
    """Top-level name of the module that a log misses; '' if it misses none."""
    module = F.regexp_extract(log, r"(?i)No module named ['\"]([^'\"]+)['\"]", 1)
    package = F.regexp_extract(log, r"(?i)requires the ([A-Za-z0-9_.-]+) python package", 1)
    return F.substring_index(truthy(module, package), ".", 1)


def declared_requirement(lines: Column, hint: Column) -> Column:
    """The first requirement line that has the hint's name in it, without digits at its end; '' if none has.

    lines: the lines of all requirement files, in the order of the files.
    """
    same = lambda x: F.replace(F.lower(x), F.lit("_"), F.lit("-"))
    token = F.regexp_replace(same(hint), r"\d+$", "")
    usable = F.filter(F.transform(lines, strip), lambda x: (x != "") & ~F.regexp_like(x, F.lit(r"^(#|-|git\+|https?://)")))
    found = F.filter(usable, lambda x: F.contains(same(x), token))
    return F.when(token == "", "").otherwise(F.coalesce(F.try_element_at(found, F.lit(1)), F.lit("")))
