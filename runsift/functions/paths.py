"""Paths and patches as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import first_match

# Fixed values.
BUILD_ENDINGS = (".c", ".cc", ".cpp", ".cxx", ".h", ".hpp", ".pyx", ".pxd", ".pxi")
BUILD_FILES = ("setup.py", "pyproject.toml", "meson.build", "CMakeLists.txt")
NOT_TESTS = (".json", ".png", "csv", ".txt", ".md", ".jpg", ".jpeg", ".pkl", ".yml", ".yaml", ".toml")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def directory(path: Column, none: str = "") -> Column:
    """What stands before the last slash; ``none`` for a path without one."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_extract(path, r"^(.*)/[^/]*$", 1)).otherwise(none)


def forward(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def is_unsafe(path: Column) -> Column:
    """Empty, absolute, or with a part that is '..'."""
    return (path == "") | path.startswith("/") | F.array_contains(F.split(path, "/"), "..")


def patch_refusal(path: Column, search: Column, replace: Column, test_path: Column, allowed: Column) -> Column:
    """Why a search-and-replace patch is refused: unsafe, test_file, not_allowed, no_op; null if it may be applied."""
    path = forward(F.trim(F.coalesce(path, F.lit(""))))
    name = base_name(path)
    of_tests = (path == test_path) | F.contains(F.concat(F.lit("/"), F.lower(path)), F.lit("/tests/")) | name.startswith("test_") | (name == "conftest.py")
    return first_match(
        [
            (is_unsafe(path), "unsafe"),
            (of_tests, "test_file"),
            ((F.size(allowed) > 0) & ~F.array_contains(allowed, path), "not_allowed"),
            ((F.coalesce(search, F.lit("")) == "") | (search == F.coalesce(replace, F.lit(""))), "no_op"),
        ],
        F.lit(None).cast("string"),
    )


def patch_list(items: Column, test_path: Column, allowed: Column) -> Column:
    """struct(items, problem) of array<struct<path, search, replace, ..>>: all items with their paths trimmed and with forward slashes, or none and the first refusal; 'empty' for no items."""
    refusals = F.filter(F.transform(items, lambda x: patch_refusal(x["path"], x["search"], x["replace"], test_path, allowed)), lambda x: x.isNotNull())
    problem = F.when(F.coalesce(F.size(items), F.lit(0)) <= 0, "empty").otherwise(F.coalesce(F.try_element_at(refusals, F.lit(1)), F.lit("")))
    clean = F.transform(items, lambda x: x.withField("path", forward(F.trim(x["path"]))))
    return F.struct(F.when(problem == "", clean).otherwise(F.slice(clean, 1, 0)).alias("items"), problem.alias("problem"))


def edited(files: Column, items: Column) -> Column:
    """struct(files, steps, problem) after all of array<struct<path, search, replace, ..>> on map<path, text>, one after the other.

    Each search text must occur just once in its file as the edits before have left it; steps has the text of each
    edit's file before and after.  If one edit fails, none is made: the problem tells of the first that did.
    """
    step = "array<struct<path:string,before:string,after:string>>"
    start = F.struct(files.alias("files"), F.array().cast(step).alias("steps"), F.lit("").alias("problem"))

    def apply(state, x):
        before = F.try_element_at(state["files"], x["path"])
        n = occurrences(before, x["search"])
        problem = (
            F.when(state["problem"] != "", state["problem"])
            .when(before.isNull(), F.concat(F.lit("source file does not exist: "), x["path"]))
            .when(n != 1, F.concat(F.lit("search text must occur exactly once in "), x["path"], F.lit(", found "), n.cast("string")))
            .otherwise("")
        )
        after = F.replace(before, x["search"], x["replace"])
        others = F.map_filter(state["files"], lambda k, _: k != x["path"])
        made = F.map_concat(others, F.map_from_arrays(F.array(x["path"]), F.array(after)))
        taken = F.array(F.struct(x["path"].alias("path"), before.alias("before"), after.alias("after")))
        return F.struct(F.when(problem == "", made).otherwise(state["files"]).alias("files"), F.when(problem == "", F.concat(state["steps"], taken)).otherwise(state["steps"]).alias("steps"), problem.alias("problem"))

    done = F.aggregate(items, start, apply)
    fine = done["problem"] == ""
    return F.struct(F.when(fine, done["files"]).otherwise(files).alias("files"), F.when(fine, done["steps"]).otherwise(F.array().cast(step)).alias("steps"), done["problem"].alias("problem"))


#: Short names of projects by the owner that an id begins with.
OWNERS = {"pytest-dev": "pytest", "sphinx-doc": "sphinx", "pylint-dev": "pylint", "pallets": "flask", "psf": "requests", "pydata": "xarray", "mwaskom": "seaborn"}


def repository_folder(repo: Column, instance_id: Column, folders: Column) -> Column:
    """The folder of a checkout among the names in ``folders``: the project's name, owner__project, or the short name of the id's owner; the first of them if none is there."""
    owner = F.substring_index(instance_id, "__", 1)
    short = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in OWNERS.items() for x in pair]), owner), owner)
    given = F.coalesce(repo, F.lit("")) != ""
    names = F.when(given, F.array(F.substring_index(repo, "/", -1), F.replace(repo, F.lit("/"), F.lit("__")), short)).otherwise(F.array(short))
    return F.coalesce(F.try_element_at(F.filter(names, lambda x: F.array_contains(folders, x)), F.lit(1)), names[0])


def needs_rebuild(patch: Column) -> Column:
    """Whether a patch writes a file of a compiled language or of the build."""
    paths = F.transform(F.filter(F.split(patch, r"\r?\n"), lambda x: x.startswith("+++ b/")), lambda x: base_name(F.trim(F.substr(x, F.lit(7)))))
    return F.exists(paths, lambda p: F.lower(F.regexp_extract(p, r"[^.](\.[^.]*)$", 1)).isin(*BUILD_ENDINGS) | p.isin(*BUILD_FILES))


def changed_files(patch: Column) -> Column:
    """Old and new names of all files of a patch, sorted."""
    found = [F.regexp_extract_all(patch, F.lit(r"diff --git a/(.*) b/(.*)"), F.lit(i)) for i in (1, 2)]
    return F.array_sort(F.array_distinct(F.concat(*found)))


def directives(test_patch: Column, repo: Column) -> Column:
    """Test files that a patch touches; for one project as dotted labels."""
    files = F.regexp_extract_all(test_patch, F.lit(r"diff --git a/.* b/(.*)"), F.lit(1))
    files = F.filter(files, lambda x: ~F.regexp_like(x, F.lit("(" + "|".join(e.replace(".", r"\.") for e in NOT_TESTS) + ")$")))
    dotted = F.transform(files, lambda x: F.replace(F.regexp_replace(F.regexp_replace(x, r"\.py$", ""), "^tests/", ""), F.lit("/"), F.lit(".")))
    return F.when(repo == "django/django", dotted).otherwise(files)


def relative(path: Column, base: Column) -> Column:
    """The path below base; outside of it the path itself."""
    prefix = F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/"))
    return F.when(F.startswith(path, prefix), F.substr(path, F.length(prefix) + 1)).otherwise(path)


def generated_test_path(name: Column, host_file: Column) -> Column:
    """tests/test_brt_<name>.py, or beside the host file if there is one."""
    folder = F.when(F.coalesce(host_file, F.lit("")) == "", "tests").otherwise(directory(host_file, "."))
    return F.concat(folder, F.lit("/test_brt_"), F.regexp_replace(name, "[^0-9A-Za-z_]+", "_"), F.lit(".py"))


def occurrences(text: Column, literal: Column) -> Column:
    """How often a literal occurs, without overlap; 0 for an empty literal."""
    shorter = F.length(F.replace(text, literal, F.lit("")))
    return F.when(literal == "", 0).otherwise(((F.length(text) - shorter) / F.length(literal)).cast("int"))
