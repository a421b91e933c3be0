"""Functions on Python source, as Arrow UDFs: what needs a syntax tree has no column expression.

The tree, and so a result in rare cases, depends on the workers' Python version.
"""

from __future__ import annotations

import ast
import difflib
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

BROAD = {"Exception", "BaseException"}
# Phrases of an expected behaviour.
NO_RAISE = ("不应抛", "不再抛", "不应该抛", "不报错", "正常执行", "正常工作", "should not raise", "without raising", "without error", "must not raise")
CAPABILITY = (
    "应该支持", "应支持", "应该提供", "应提供", "应该存在", "应存在", "应该包含", "应包含", "应该显示", "应显示", "应该保留", "应保留",
    "should support", "should provide", "should exist", "should include", "should contain", "should display", "should preserve",
)
OPPOSITE = {ast.Eq: ast.NotEq, ast.Is: ast.IsNot, ast.In: ast.NotIn, ast.Lt: ast.GtE, ast.Gt: ast.LtE}
OPPOSITE |= {b: a for a, b in OPPOSITE.items()}
FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)


def tree_of(code: str | None) -> ast.Module | None:
    try:
        return ast.parse(code or "")
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def dotted(node: ast.AST) -> str:
    parts: list[str] = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    if isinstance(node, ast.Name):
        parts.append(node.id)
    return ".".join(reversed(parts))


def negates(a: ast.expr, b: ast.expr) -> bool:
    """Whether one expression is by its form the opposite of the other."""
    for x, y in ((a, b), (b, a)):
        if isinstance(x, ast.UnaryOp) and isinstance(x.op, ast.Not) and ast.dump(x.operand) == ast.dump(y):
            return True
    if not (isinstance(a, ast.Compare) and isinstance(b, ast.Compare) and len(a.ops) == len(b.ops) == 1):
        return False
    same = ast.dump(a.left) == ast.dump(b.left) and ast.dump(a.comparators[0]) == ast.dump(b.comparators[0])
    return same and OPPOSITE.get(type(a.ops[0])) is type(b.ops[0])


def _call_rule(node):
    name = dotted(node.func)
    if name.endswith(".skip"):
        return "skip_call"
    if name in ("pytest.raises", "raises") and node.args and dotted(node.args[0]) in BROAD:
        return "broad_raises"


def _function_rule(node):
    for d in node.decorator_list:
        name = dotted(d.func if isinstance(d, ast.Call) else d).lower()
        if name == "skip" or name.endswith(".skip"):
            return "skip_decorator"


def _assert_rule(node):
    if isinstance(node.test, ast.Constant) and node.test.value is True:
        return "assert_true"
    if isinstance(node.test, ast.BoolOp) and isinstance(node.test.op, ast.Or):
        values = node.test.values
        if any(negates(values[i], values[j]) for i in range(len(values)) for j in range(i + 1, len(values))):
            return "tautology"


def _try_rule(node):
    for h in node.handlers:
        if (h.type is None or dotted(h.type) in BROAD) and all(isinstance(s, (ast.Pass, ast.Return, ast.Continue)) for s in h.body):
            return "swallowed_exception"


NODE_RULES = {ast.Call: _call_rule, ast.FunctionDef: _function_rule, ast.AsyncFunctionDef: _function_rule, ast.Assert: _assert_rule, ast.Try: _try_rule}
# Code that wants an exception, and code that denies an attribute.
WANTS_RAISE = re.compile(r"(?:pytest\.raises|assertRaises|\braises\s*\()")
DENIES_ATTRIBUTE = re.compile(r"(?:assert\s+not\s+hasattr\s*\(|assertFalse\s*\(\s*hasattr\s*\()")


def audit(code: str | None, expected: str | None) -> str:
    """Label of the first rule that a candidate test breaks; '' if it is sound."""
    return audit_tree(tree_of(code), code, expected)


def audit_tree(tree: ast.Module | None, code: str | None, expected: str | None) -> str:
    if tree is None:
        return "syntax"
    ruled = [n for n in ast.walk(tree) if type(n) in NODE_RULES]
    if sum(isinstance(n, FUNCTIONS) and n.name.startswith("test") for n in ruled) != 1:
        return "not_one_test"
    for n in ruled:
        if found := NODE_RULES[type(n)](n):
            return found
    low = (expected or "").lower()
    if any(w in low for w in NO_RAISE) and WANTS_RAISE.search(code):
        return "raises_against_expected"
    if any(w in low for w in CAPABILITY) and DENIES_ATTRIBUTE.search(code):
        return "hasattr_against_expected"
    return ""


def audit_and_selector(code: str | None, expected: str | None) -> tuple[str, str]:
    tree = tree_of(code)
    return audit_tree(tree, code, expected), selector_in(tree)


def brittle(code: str | None) -> str:
    """'private' or 'exact_text' for an assert that leans on internals, 'syntax' for no Python, else ''."""
    tree = tree_of(code)
    if tree is None:
        return "syntax"
    for n in ast.walk(tree):
        if isinstance(n, ast.Assert):
            text = ast.get_source_segment(code, n.test) or ""
            if re.search(r"\._[A-Za-z_]", text):
                return "private"
            if len(text) > 120 and "==" in text and ("repr(" in text or "str(" in text or "query" in text.lower()):
                return "exact_text"
    return ""


def selector(code: str | None) -> str:
    """Class::test or test of the first test at the top level, in the order of the source; '' if there is none."""
    return selector_in(tree_of(code))


def selector_in(tree: ast.Module | None) -> str:
    for n in getattr(tree, "body", []):
        inner = n.body if isinstance(n, ast.ClassDef) else [n]
        for f in inner:
            if isinstance(f, FUNCTIONS) and f.name.startswith("test"):
                return f"{n.name}::{f.name}" if isinstance(n, ast.ClassDef) else f.name
    return ""


def imports(code: str | None) -> str:
    """Source of all import statements, a line each; by regular expression if the code does not parse."""
    tree = tree_of(code)
    if tree is None:
        return "\n".join(re.findall(r"(?m)^\s*(?:import\s.+|from\s.+\simport\s.+)$", code or ""))
    return "\n".join(ast.get_source_segment(code, n) or "" for n in tree.body if isinstance(n, (ast.Import, ast.ImportFrom)))


def find_test(code: str | None, name: str | None) -> tuple[str, str, str]:
    """(source, class, setup source) of a test by its name; its class's setup methods come with it."""
    for n in getattr(tree_of(code), "body", []):
        for f in n.body if isinstance(n, ast.ClassDef) else [n]:
            if isinstance(f, FUNCTIONS) and f.name == (name or "").split("::")[-1]:
                segment = lambda x: ast.get_source_segment(code, x) or ""
                setup = [s for s in n.body if isinstance(s, FUNCTIONS) and s.name in ("setUp", "setup_method", "setUpClass", "setup_class")] if isinstance(n, ast.ClassDef) else []
                return segment(f), n.name if isinstance(n, ast.ClassDef) else "", "\n".join(map(segment, setup))
    return "", "", ""


def definitions(code: str | None) -> tuple[list[str], list[str], list[str]]:
    """(fixtures, functions and classes, decorators) of the top level, by name."""
    fixtures, names, marks = [], [], []
    for n in getattr(tree_of(code), "body", []):
        if isinstance(n, (*FUNCTIONS, ast.ClassDef)):
            names.append(n.name)
            own = [dotted(d.func if isinstance(d, ast.Call) else d) for d in n.decorator_list]
            marks += own
            if any(d.split(".")[-1] == "fixture" for d in own):
                fixtures.append(n.name)
    return fixtures, names, marks


#: What outline() tells of a source, with its items in the order of the source.
ITEM = "kind:string,owner:string,name:string,line:int,code:string,bases:string,decorators:array<string>,arguments:array<string>,refers:array<string>"
OUTLINE = f"parsed boolean, header array<struct<kind:string,text:string>>, imported array<struct<level:int,module:string,names:array<string>>>, items array<struct<{ITEM}>>"


def outline(code: str | None) -> tuple[bool, list[dict], list[dict], list[dict]]:
    """(parsed, header, imported, items) of a source.

    header: import statements, and assignments that name pytestmark ('mark' of that target, 'marks' of any other);
    imported: relative imports; items: classes, functions, the methods and assignments of classes, and functions inside others ('inner').
    """
    tree = tree_of(code)
    if tree is None:
        lines = [x for x in (code or "").splitlines() if x.startswith(("import ", "from ", "pytestmark"))]
        return False, [{"kind": "line", "text": x} for x in lines], [], []
    text = lambda n: ast.get_source_segment(code, n) or ""

    def item(kind: str, n: ast.AST, owner: str = "") -> dict:
        marks = [t for t in (text(d).strip() for d in getattr(n, "decorator_list", [])) if t]
        own = [a.arg for a in n.args.args] if isinstance(n, FUNCTIONS) else []
        used = sorted({x.id for x in ast.walk(n) if isinstance(x, ast.Name)}) if isinstance(n, FUNCTIONS) else []
        bases = ", ".join(map(text, n.bases)) if isinstance(n, ast.ClassDef) else ""
        return {"kind": kind, "owner": owner, "name": getattr(n, "name", ""), "line": n.lineno, "code": text(n), "bases": bases, "decorators": marks, "arguments": own, "refers": used}

    header, imported, items, seen = [], [], [], set()
    for n in tree.body:
        if isinstance(n, (ast.Import, ast.ImportFrom)):
            header.append({"kind": "import", "text": text(n)})
            if isinstance(n, ast.ImportFrom) and n.level:
                imported.append({"level": n.level, "module": n.module or "", "names": [a.name for a in n.names if a.name != "*"]})
        elif isinstance(n, (ast.Assign, ast.AnnAssign)) and "pytestmark" in text(n):
            named = isinstance(n, ast.Assign) and any(getattr(t, "id", "") == "pytestmark" for t in n.targets)
            header.append({"kind": "mark" if named else "marks", "text": text(n)})
        elif isinstance(n, ast.ClassDef):
            items.append(item("class", n))
            for child in n.body:
                if isinstance(child, FUNCTIONS):
                    items.append(item("method", child, n.name))
                    seen.add(child)
                elif isinstance(child, (ast.Assign, ast.AnnAssign)):
                    items.append(item("assign", child, n.name))
        elif isinstance(n, FUNCTIONS):
            items.append(item("function", n))
            seen.add(n)
    items += [item("inner", n) for n in ast.walk(tree) if isinstance(n, FUNCTIONS) and n not in seen]
    return True, header, imported, items


def outline_of(code: Column) -> Column:
    """struct(OUTLINE) of a source, which is parsed once."""
    return arrow_udf(outline, OUTLINE, 1)(code)


def protocol(code: str | None, name: str | None) -> tuple[list[str], list[str], list[str]]:
    """(wanted fixtures, local helpers, decorators) of a test: its arguments, and the top-level names that it refers to."""
    _, names, _ = definitions(code)
    for n in ast.walk(tree_of(code) or ast.Module([], [])):
        if isinstance(n, FUNCTIONS) and n.name == (name or "").split("::")[-1]:
            wanted = [a.arg for a in n.args.args if a.arg not in ("self", "cls")]
            used = {x.id for x in ast.walk(n) if isinstance(x, ast.Name)}
            return wanted, [x for x in names if x in used], [dotted(d.func if isinstance(d, ast.Call) else d) for d in n.decorator_list]
    return [], [], []


def nested(code: str | None) -> str:
    """Names, sorted, of the classes and functions that are defined inside functions."""
    names: set[str] = set()
    for f in ast.walk(tree_of(code) or ast.Module([], [])):
        if isinstance(f, FUNCTIONS):
            names |= {n.name for n in ast.walk(f) if n is not f and isinstance(n, (*FUNCTIONS, ast.ClassDef))}
    return ", ".join(sorted(names))


def wrapped(code: str | None) -> str:
    """A test that takes self gets a class around it; empty code a placeholder."""
    text = (code or "").strip()
    if not text:
        return "def test_placeholder():\n    raise AssertionError('no test')\n"
    tree = tree_of(text)
    top = [n for n in getattr(tree, "body", []) if isinstance(n, FUNCTIONS) and n.args.args and n.args.args[0].arg == "self"]
    if not top:
        return text
    lines = text.split("\n")
    first = min([top[0].lineno, *[d.lineno for d in top[0].decorator_list]]) - 1
    return "\n".join([*lines[:first], "class TestGenerated:", *["    " + x if x else x for x in lines[first:]]])


def replaced_once(original: str | None, search: str | None, replace: str | None, path: str | None) -> tuple[str | None, str | None, str]:
    """(new text, unified diff, problem): the search text must occur exactly once."""
    n = (original or "").count(search) if search else 0
    if n != 1:
        return None, None, f"search text must occur exactly once, found {n}"
    new = original.replace(search, replace or "")
    diff = difflib.unified_diff(original.splitlines(keepends=True), new.splitlines(keepends=True), f"a/{path}", f"b/{path}")
    return new, "".join(diff), ""


def arrow_udf(f, schema: str, n: int):
    """An Arrow UDF that maps f over n text columns; a schema of several fields gives a struct.  Needs a session."""
    single = " " not in schema

    def build(columns):
        made = [f(*r) for r in zip(*columns)]
        return pd.Series(made, dtype=object) if single else pd.DataFrame(made, columns=[c.split()[0] for c in schema.split(", ")])

    if n == 1:

        def run(a):
            return build([a])
    elif n == 2:

        def run(a, b):
            return build([a, b])
    else:

        def run(a, b, c, d):
            return build([a, b, c, d])

    run.__annotations__ = dict.fromkeys("abcd"[:n], pd.Series) | {"return": pd.Series if single else pd.DataFrame}
    return F.pandas_udf(run, schema)


def text_udf(f):
    return arrow_udf(f, "string", 1)


def audited(code: Column, expected: Column) -> Column:
    return arrow_udf(audit, "string", 2)(code, expected)


def audited_with_selector(code: Column, expected: Column) -> Column:
    """struct(problem, selector); the code is parsed once."""
    return arrow_udf(audit_and_selector, "problem string, selector string", 2)(code, expected)


# Build requirements that an environment brings itself.
BROUGHT = {"setuptools", "oldest-supported-numpy", "numpy"}


def build_requirements(text: str | None) -> list[str]:
    """Requirements of a pyproject.toml's build system, without those that an environment brings itself; none for a text that does not parse."""
    import tomllib

    try:
        wanted = tomllib.loads(text or "").get("build-system", {}).get("requires", [])
    except (ValueError, AttributeError, TypeError):
        return []
    return [str(w) for w in wanted if re.split(r"[<>=!~;\[]", str(w), maxsplit=1)[0].strip().lower().replace("_", "-") not in BROUGHT]


def build_requirements_of(text: Column) -> Column:
    return arrow_udf(build_requirements, "array<string>", 1)(text)


def brittle_of(code: Column) -> Column:
    return text_udf(brittle)(code)


def selector_of(code: Column) -> Column:
    return text_udf(selector)(code)


def has_nested(code: Column) -> Column:
    return text_udf(nested)(code) != ""


def imports_of(code: Column) -> Column:
    return text_udf(imports)(code)


def wrapped_of(code: Column) -> Column:
    return text_udf(wrapped)(code)


def test_source(code: Column, name: Column) -> Column:
    return arrow_udf(find_test, "source string, class_name string, setup string", 2)(code, name)


def definitions_of(code: Column) -> Column:
    return arrow_udf(definitions, "fixtures array<string>, names array<string>, decorators array<string>", 1)(code)


def protocol_of(code: Column, name: Column) -> Column:
    return arrow_udf(protocol, "fixtures array<string>, helpers array<string>, decorators array<string>", 2)(code, name)


def replaced(original: Column, search: Column, replace: Column, path: Column) -> Column:
    return arrow_udf(replaced_once, "new string, diff string, problem string", 4)(original, search, replace, path)
