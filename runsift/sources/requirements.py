"""Requirement files with the files that they refer to, as joins of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Beginnings of lines that are left out.
LEFT_OUT = ("-e .", "#", ".[test")
REFERENCE = "-r"


def resolved(folder: Column, name: Column) -> Column:
    """The path of a file that is named from a folder; '.' and '..' are followed, and an absolute name stands for itself."""
    joined = F.when(F.startswith(name, F.lit("/")) | (folder == ""), name).otherwise(F.concat(folder, F.lit("/"), name))
    parts = F.filter(F.split(joined, "/"), lambda x: ~x.isin("", "."))
    up = F.aggregate(parts, F.array().cast("array<string>"), lambda done, x: F.when((x == "..") & (F.size(done) > 0), F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(x))))
    return F.concat(F.when(F.startswith(joined, F.lit("/")), "/").otherwise(""), F.array_join(up, "/"))


def chosen_files(files: DataFrame, candidates: DataFrame) -> DataFrame:
    """(repo, commit, path, text): of files(repo, commit, path, text) the one whose path comes first among candidates(repo, position, path).

    A repository and commit without any of them has no row: see missing_files.
    """
    held = files.join(candidates.select("repo", "path", "position"), ["repo", "path"]).groupBy("repo", "commit")
    first = held.agg(F.min(F.struct("position", "path")).alias("f")).select("repo", "commit", "f.path")
    return files.join(first, ["repo", "commit", "path"]).select("repo", "commit", "path", "text")


def missing_files(wanted: DataFrame, chosen: DataFrame) -> DataFrame:
    """wanted(repo, commit) that have none of their candidates."""
    return wanted.join(chosen, ["repo", "commit"], "left_anti")


def expanded(files: DataFrame, candidates: DataFrame) -> DataFrame:
    """(repo, commit, path, text): the chosen file of each repository and commit with the lines of the files it refers to, one level deep.

    Lines of those files come first, in the order of the references, then the file's own; lines that install
    the project itself, comments and the project's own test extras are left out.  References in a file that is referred to
    stay as they are, and those to files that are not there give nothing.
    """
    chosen = chosen_files(files, candidates)
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    split = chosen.select("repo", "commit", "path", folder.alias("folder"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("at", "line"))
    split = split.withColumn("bare", F.regexp_replace("line", r"^\s+|\s+$", ""))
    keep = lambda line: ~F.regexp_like(line, F.lit(r"^\s*(-e \.|#|\.\[test)"))
    refers = F.startswith("bare", F.lit(REFERENCE))
    own = split.where(~refers & keep(F.col("line"))).groupBy("repo", "commit").agg(F.array_sort(F.collect_list(F.struct("at", "line"))).alias("own"))
    # The name is what follows the first two signs of the whole line, so a line that is set in names no file.
    name = F.regexp_replace(F.substring("line", F.lit(3), F.length("line")), r"^\s+|\s+$", "")
    named = split.where(refers).select("repo", "commit", "at", resolved(F.col("folder"), name).alias("path"))
    found = named.join(files, ["repo", "commit", "path"]).select("repo", "commit", "at", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("n", "line")).where(keep(F.col("line")))
    more = found.groupBy("repo", "commit").agg(F.array_sort(F.collect_list(F.struct("at", "n", "line"))).alias("more"))
    both = chosen.select("repo", "commit", "path").join(own, ["repo", "commit"], "left").join(more, ["repo", "commit"], "left")
    lines = lambda c: F.transform(F.coalesce(c, F.array()), lambda x: x["line"])
    text = F.array_join(F.concat(lines(F.col("more")), F.array(F.array_join(lines(F.col("own")), "\n"))), "\n")
    return both.select("repo", "commit", "path", text.alias("text"))
