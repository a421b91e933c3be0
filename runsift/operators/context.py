"""What surrounds a test in its checkout: the class it is in, its neighbours, the fixtures and helpers that it can reach.

Every source is parsed once, into a table of its items; what a test takes from other files are joins of that table
by path, whatever the number of tests and files.  Running the test is left to others: its status is SKIPPED.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pyast, rules
from ..functions.paths import directory
from ..functions.text import guessed_test_name, shorten_middle
from ..sources.tables import written
from .joins import ancestors

# Names of methods and files, and of warnings.
SETUP_CONTEXT = ("setUp", "tearDown", "setup_method", "teardown_method", "setUpClass", "tearDownClass")
SETUP_NAMES = ("setUp", "setUpClass", "setup_method", "setup_class")
TEARDOWN_NAMES = ("tearDown", "tearDownClass", "teardown_method", "teardown_class")
LOCAL_FILES = ("models.py", "helpers.py", "utils.py")
NOT_IN_CHECKOUT = "full related test file not found; using retrieved code_content"
NOT_IN_FILE = "seed test function not found in full file"
NO_FILE = "完整测试文件不存在，协议恢复仅使用检索片段。"
NO_TREE = "相关测试源码无法通过 AST 解析。"
NO_TARGET = "无法在完整文件中定位目标测试入口。"
NO_FIXTURE = "测试使用 fixture，但父目录 conftest 中未定位到对应定义；fixture 可能来自插件。"


def of_kind(items: Column, *kinds: str) -> Column:
    return F.filter(items, lambda x: x["kind"].isin(*kinds))


def target(items: Column, name: Column) -> Column:
    """The item of a test by its name, Class.test or test: the first in the order of the source; null if there is none."""
    owner = F.regexp_extract(name, r"^(.*)\.[^.]*$", 1)
    own = F.substring_index(name, ".", -1)
    named = F.filter(of_kind(items, "method", "function"), lambda x: (x["name"] == own) & (~F.contains(name, F.lit(".")) | ((x["kind"] == "method") & (x["owner"] == owner))))
    return F.try_element_at(named, F.lit(1))


def with_sources(tests: DataFrame, files: DataFrame) -> DataFrame:
    """tests(instance_id, checkout, file, name, content, ..) with ``in_checkout``, ``source``, its outline ``o`` and the item ``t`` of the test."""
    there = files.select("checkout", F.col("path").alias("file"), F.col("text").alias("_text"))
    rows = tests.join(there, ["checkout", "file"], "left").withColumn("in_checkout", F.coalesce(F.col("_text") != "", F.lit(False)))
    rows = rows.withColumn("source", F.when(F.col("in_checkout"), F.col("_text")).otherwise(F.coalesce("content", F.lit("")))).drop("_text")
    return written(rows.withColumn("o", pyast.outline_of(F.col("source")))).withColumn("t", target(F.col("o.items"), F.col("name")))


def declared(files: DataFrame) -> DataFrame:
    """(checkout, path, at, item) of the top-level items of the files that tests take from: conftest.py, models, helpers and utilities."""
    base = F.substring_index("path", "/", -1)
    parsed = written(files.where(base.isin("conftest.py", *LOCAL_FILES)).select("checkout", "path", pyast.outline_of(F.col("text")).alias("o")))
    return parsed.select("checkout", "path", F.posexplode(of_kind(F.col("o.items"), "class", "function")).alias("at", "item"))


def in_order(rows: DataFrame, order: list[str], value: Column, name: str) -> DataFrame:
    """(instance_id, ``name``): the values of an instance as an array in an order."""
    items = F.array_sort(F.collect_list(F.struct(*order, value.alias("_v"))))
    return rows.groupBy("instance_id").agg(F.transform(items, lambda x: x["_v"]).alias(name))


def model_context(rows: DataFrame, items: DataFrame, limit: int = 12_000) -> DataFrame:
    """(instance_id, model_context): the classes that a test's file imports from a module of models beside or above it, with their paths."""
    folder = F.split(directory(F.col("file")), "/")
    parts = F.filter(folder, lambda x: x != "")
    found = rows.select("instance_id", "checkout", parts.alias("parts"), F.posexplode("o.imported").alias("i", "m"))
    found = found.where((F.col("m.module") == "models") | F.col("m.module").endswith(".models"))
    above = F.slice("parts", F.lit(1), F.greatest(F.size("parts") - F.col("m.level") + 1, F.lit(0)))
    path = F.concat(F.array_join(F.concat(above, F.split("m.module", r"\.")), "/"), F.lit(".py"))
    wanted = found.select("instance_id", "checkout", "i", path.alias("path"), F.col("m.names").alias("names"))
    classes = items.where("item.kind = 'class' and item.code <> ''")
    taken = wanted.join(classes, ["checkout", "path"]).where((F.size("names") == 0) | F.array_contains("names", F.col("item.name")))
    listed = in_order(taken, ["i", "at"], F.concat(F.lit("# "), "path", F.lit("\n"), "item.code"), "chunks")
    return listed.select("instance_id", shorten_middle(F.array_join("chunks", "\n\n"), limit).alias("model_context"))


def header_lines(o: Column, *kinds: str) -> Column:
    return F.filter(F.transform(F.filter(o["header"], lambda x: x["kind"].isin(*kinds)), lambda x: x["text"]), lambda x: x != "")


def test_command(selector: Column) -> Column:
    known = rules.test_command(F.col("repo"), F.col("file"), selector)
    return F.when(F.coalesce("repo", F.lit("")) == "", F.concat(F.lit("python -m pytest "), F.col("file"), F.lit(" -q"))).otherwise(known)


def neighbours_of(items: Column, name: Column, reach: int = 2) -> Column:
    """The sources of up to ``reach`` tests before and after the first of that name, wherever they are defined, by line."""
    tests = F.filter(of_kind(items, "method", "function", "inner"), lambda x: F.startswith(x["name"], F.lit("test")))
    # The names of equal lines stay in the order they came in.
    sorted_ = F.transform(F.array_sort(F.transform(tests, lambda x, i: F.struct(x["line"].alias("line"), i.alias("i"), x["name"].alias("name"), x["code"].alias("code")))), lambda x: x)
    at = F.array_position(F.transform(sorted_, lambda x: x["name"]), name).cast("int")
    near = F.concat(F.slice(sorted_, F.greatest(at - reach, F.lit(1)), F.least(F.lit(reach), at - 1)), F.slice(sorted_, at + 1, F.lit(reach)))
    codes = F.filter(F.transform(near, lambda x: x["code"]), lambda x: x != "")
    return F.when(at > 0, codes).otherwise(F.array().cast("array<string>"))


def host_contexts(tests: DataFrame, files: DataFrame) -> DataFrame:
    """The host context of each of tests(instance_id, checkout, file, name, content, repo, version), one an instance.

    files(checkout, path, text) has the sources of the checkouts.  A test whose file is not there, or is empty, is read from its retrieved content.
    """
    named = tests.withColumn("name", F.coalesce(F.nullif("name", F.lit("")), guessed_test_name(F.coalesce("content", F.lit("")))))
    rows = with_sources(named, files)
    models = model_context(rows, declared(files))
    t, o = F.col("t"), F.col("o")
    seed = F.substring_index("name", ".", -1)
    found = F.coalesce(t["code"] != "", F.lit(False))
    host = F.coalesce(t["owner"], F.lit(""))
    cls = F.try_element_at(F.filter(o["items"], lambda x: (x["kind"] == "class") & (x["name"] == host)), F.lit(1))
    inside = F.filter(o["items"], lambda x: (x["owner"] == host) & (x["code"] != "") & ((x["kind"] == "assign") | ((x["kind"] == "method") & x["name"].isin(*SETUP_CONTEXT))))
    setup = F.array_join(F.concat(F.array(F.concat(F.lit("class "), host, F.lit("("), cls["bases"], F.lit("):"))), F.transform(inside, lambda x: x["code"])), "\n\n")
    selector = F.when((host != "") & (seed != ""), F.concat(host, F.lit("::"), seed)).otherwise(seed)
    imports = F.array_join(header_lines(o, "import", "mark", "line"), "\n")
    lacks = F.filter(F.array(F.when(~F.col("in_checkout"), NOT_IN_CHECKOUT), F.when(~found, NOT_IN_FILE)), lambda x: x.isNotNull())
    empty = F.array().cast("array<string>")
    return rows.join(models, "instance_id", "left").select(
        "instance_id",
        F.col("file").alias("host_file"),
        F.when(found, host).otherwise("").alias("host_class"),
        seed.alias("seed_test_name"),
        F.when(found, t["code"]).otherwise(F.coalesce("content", F.lit(""))).alias("seed_test_code"),
        imports.alias("imports"),
        F.when(found & (host != ""), shorten_middle(setup, 8000)).otherwise("").alias("setup_context"),
        F.coalesce("model_context", F.lit("")).alias("model_context"),
        F.when(found, F.filter(t["arguments"], lambda x: x != "self")).otherwise(empty).alias("fixtures"),
        F.when(found, t["decorators"]).otherwise(empty).alias("decorators"),
        F.array_join(F.filter(F.split(imports, "\n"), lambda x: F.startswith(x, F.lit("pytestmark"))), "\n").alias("pytestmark"),
        test_command(F.when(found, selector).otherwise(seed)).alias("test_command"),
        F.lit("SKIPPED").alias("seed_execution_status"),
        F.lit("same_dir_new_file").alias("insert_strategy"),
        neighbours_of(o["items"], seed).alias("adjacent_tests"),
        lacks.alias("warnings"),
    )


def reached_fixtures(rows: DataFrame, items: DataFrame) -> DataFrame:
    """(instance_id, conftest_context): per conftest.py of the folders above a test, the nearest first, the fixtures it defines that the test asks for, or all if it asks for none."""
    up = rows.select("instance_id", "checkout", "fixtures", F.posexplode(ancestors(F.col("file"))).alias("up", "folder"))
    up = up.withColumn("path", F.concat(F.when(F.col("folder") == "", "").otherwise(F.concat("folder", F.lit("/"))), F.lit("conftest.py"))).drop("folder")
    defined = items.where("item.kind = 'function'").where(F.exists("item.decorators", lambda d: F.contains(d, F.lit("fixture"))))
    found = up.join(defined, ["checkout", "path"]).where((F.size("fixtures") == 0) | F.array_contains("fixtures", F.col("item.name")))
    one = F.struct(F.col("item.name").alias("name"), F.col("path").alias("file"), shorten_middle(F.col("item.code"), 5000).alias("code"))
    files = found.groupBy("instance_id", "up", "path").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", one.alias("f")))), lambda x: x["f"]).alias("fixtures"))
    return in_order(files, ["up"], F.struct(F.col("path").alias("file"), "fixtures"), "conftest_context")


def local_symbols(rows: DataFrame, items: DataFrame) -> DataFrame:
    """(instance_id, local_helpers, local_models): what a test refers to of the models, helpers and utilities beside it; models are the classes of models.py."""
    folder = directory(F.col("file"))
    beside = F.array(*[F.concat(F.when(folder == "", "").otherwise(F.concat(folder, F.lit("/"))), F.lit(f)) for f in LOCAL_FILES])
    wanted = rows.select("instance_id", "checkout", F.col("t.refers").alias("refers"), F.posexplode(beside).alias("k", "path")).where("refers is not null")
    found = wanted.join(items, ["checkout", "path"]).where(F.array_contains("refers", F.col("item.name")))
    is_model = F.col("path").endswith("models.py") & (F.col("item.kind") == "class")
    one = F.struct(F.col("item.name").alias("name"), F.col("path").alias("file"), shorten_middle(F.col("item.code"), 6000).alias("code"))
    part = lambda keep, name: F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("k", "at", one.alias("s"))))), lambda x: x["s"]).alias(name)
    return found.groupBy("instance_id").agg(part(~is_model, "local_helpers"), part(is_model, "local_models"))


def protocols(tests: DataFrame, files: DataFrame) -> DataFrame:
    """The protocol of each of tests(instance_id, checkout, file, name, content, repo, version), one an instance: how it is set up, and what it takes from where."""
    empty = F.array().cast("array<string>")
    rows = with_sources(tests, files)
    t, o = F.col("t"), F.col("o")
    rows = rows.withColumn("fixtures", F.coalesce(F.filter(t["arguments"], lambda x: ~x.isin("self", "cls")), empty))
    items = declared(files)
    host = F.coalesce(t["owner"], F.lit(""))
    cls = F.try_element_at(F.filter(o["items"], lambda x: (x["kind"] == "class") & (x["name"] == host)), F.lit(1))
    of_class = lambda *names: F.transform(F.filter(o["items"], lambda x: (host != "") & (x["owner"] == host) & (x["kind"] == "method") & x["name"].isin(*names)), lambda x: shorten_middle(x["code"], 6000))
    assigned = F.transform(F.filter(o["items"], lambda x: (x["owner"] == host) & (x["kind"] == "assign")), lambda x: F.concat(F.lit("\n"), x["code"]))
    class_context = F.concat(F.lit("class "), host, F.lit("("), cls["bases"], F.lit("):"), F.array_join(assigned, ""))
    command = rules.test_command(F.col("repo"), F.col("file"), F.replace("name", F.lit("."), F.lit("::")))
    framework = rules.framework(F.col("source"), F.when(host != "", cls["bases"]))
    joined = rows.join(reached_fixtures(rows, items), "instance_id", "left").join(local_symbols(rows, items), "instance_id", "left")
    unknown = (F.size("fixtures") > 0) & F.col("conftest_context").isNull() & (framework == "pytest")
    risks = [(~F.col("in_checkout"), NO_FILE), (~o["parsed"], NO_TREE), (t.isNull(), NO_TARGET), (unknown, NO_FIXTURE)]
    none = lambda name, kind: F.coalesce(name, F.array().cast(kind)).alias(name)
    symbol = "array<struct<name:string,file:string,code:string>>"
    return joined.select(
        "instance_id",
        F.col("file").alias("test_file"),
        framework.alias("test_framework"),
        command.alias("test_command"),
        header_lines(o, "import").alias("imports"),
        "fixtures",
        header_lines(o, "mark", "marks").alias("pytest_marks"),
        F.coalesce(t["decorators"], empty).alias("decorators"),
        F.when(host != "", shorten_middle(class_context, 6000)).otherwise("").alias("class_context"),
        of_class(*SETUP_NAMES).alias("setup_methods"),
        of_class(*TEARDOWN_NAMES).alias("teardown_methods"),
        none("local_helpers", symbol),
        none("local_models", symbol),
        none("conftest_context", f"array<struct<file:string,fixtures:{symbol}>>"),
        F.filter(F.array(*[F.when(c, text) for c, text in risks]), lambda x: x.isNotNull()).alias("protocol_risks"),
        F.col("name").alias("selected_seed_name"),
        F.when(directory(F.col("file")) == "", ".").otherwise(directory(F.col("file"))).alias("placement_dir"),
    )
