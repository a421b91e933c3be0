"""Joins on parts of texts - endings and contained texts - as equality joins on an index, never row by row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import BROADCAST_ROWS, small_side, written

#: Pieces of a text: runs of letters, digits and '_', and runs of other characters that are no white space.
PIECE = r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]+"
GRAM = 3
#: Preferred beginnings of environment names, for runs and for evaluations.
RUN_PREFIXES = ("direct_brt_ecg_we1_", "direct_brt_ecg_we0_")
EVALUATION_PREFIXES = (*RUN_PREFIXES, "direct_brt_we1_", "direct_brt_we0_")


def endings(names: DataFrame, wanted: DataFrame, name: str, asked: str) -> DataFrame:
    """(asked, name) for each distinct name that ends with a distinct asked text.

    A name is filed under its ending of each length that is asked for, so that the rest is an equality join; there
    are no more lengths than the longest asked text has characters.
    """
    texts = wanted.select(F.col(asked).alias("_a")).where("_a is not null").distinct()
    lengths = F.broadcast(texts.agg(F.collect_set(F.length("_a")).alias("_lengths")))
    distinct = names.select(F.col(name).alias("_n")).where("_n is not null").distinct()
    # The other side of this join is one row.
    filed = distinct.join(lengths).withColumn("_l", F.explode(F.filter("_lengths", lambda n: n <= F.length("_n"))))
    filed = filed.select("_n", F.when(F.col("_l") == 0, "").otherwise(F.expr("right(_n, _l)")).alias("_ending"))
    return texts.join(filed, texts["_a"] == filed["_ending"]).select(F.col("_a").alias(asked), F.col("_n").alias(name))


def matched_environments(wanted: DataFrame, names: DataFrame, prefixes: tuple[str, ...] = RUN_PREFIXES) -> DataFrame:
    """wanted(name, ..) with ``environment`` from names(environment): the name itself if it is there, else of the names that end
    with it the first by name with the first prefix that any has, else the last by name, else the name itself; '' and null stay.
    """
    found = endings(names, wanted.where("name <> ''"), "environment", "name")
    exact = F.max(F.when(F.col("environment") == F.col("name"), F.col("environment")))
    by_prefix = [F.min(F.when(F.startswith("environment", F.lit(p)), F.col("environment"))) for p in prefixes]
    best = found.groupBy(F.col("name").alias("_name")).agg(F.coalesce(exact, *by_prefix, F.max("environment")).alias("_best"))
    joined = wanted.join(best, F.col("name") == F.col("_name"), "left")
    return joined.select(*[wanted[c] for c in wanted.columns], F.coalesce("_best", "name").alias("environment"))


def pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({PIECE})"), 1)


def grams(text: Column, sizes: Column) -> Column:
    """Distinct parts of a text of each of the sizes."""
    of_size = lambda n: F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substr(text, i, n))
    return F.array_distinct(F.flatten(F.transform(F.filter(sizes, lambda n: n <= F.length(text)), of_size)))


def keys(text: Column, sizes: list[int]) -> Column:
    """The distinct pieces of a text and its parts of the sizes without white space."""
    parts = [F.regexp_extract_all(text, F.lit(rf"(?=(\S{{{n}}}))"), 1) for n in sizes]
    return F.array_distinct(F.concat(pieces(text), *parts))


def anchors(patterns: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(pattern, token): for each pattern with a piece one of the keys() that any text which contains the pattern has.

    A piece inside a pattern is a whole piece of such a text, and GRAM characters of any piece (all of it, if it is
    shorter) are a part of the text.  Taken is the rarest piece inside or the rarest part of the longest piece, whichever
    fewer texts have by vocabulary(token, n), where a part counts with all tokens that hold it.
    """
    cut = patterns.select("pattern", pieces(F.col("pattern")).alias("p")).where("size(p) > 0")
    # A piece at an end is inside if white space follows it within the pattern.
    first, last = F.regexp_like("pattern", F.lit(r"^\s")).cast("int"), F.regexp_like("pattern", F.lit(r"\s$")).cast("int")
    inner = F.slice("p", 2 - first, F.greatest(F.size("p") - 2 + first + last, F.lit(0)))
    longest = F.array_max(F.transform("p", lambda x: F.struct(F.length(x).alias("l"), x.alias("x"))))["x"]
    cut = cut.select("pattern", inner.alias("inner"), longest.alias("piece"))
    rarest = lambda x: F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), x))
    within = cut.select("pattern", F.explode(F.array_distinct("inner")).alias("token"))
    inside = within.join(vocabulary, "token", "left").groupBy("pattern").agg(rarest("token").alias("inside"))

    parts = cut.select("piece").distinct()
    sizes = F.broadcast(parts.agg(F.collect_set(F.least(F.length("piece"), F.lit(GRAM))).alias("sizes")))
    # The other side of this join is one row of up to GRAM numbers.
    filed = vocabulary.join(sizes).select("n", F.explode(grams(F.col("token"), F.col("sizes"))).alias("gram"))
    of_piece = parts.select("piece", F.explode(grams(F.col("piece"), F.array(F.least(F.length("piece"), F.lit(GRAM))))).alias("gram"))
    rare = of_piece.join(filed.groupBy("gram").agg(F.sum("n").alias("n")), "gram", "left").groupBy("piece").agg(rarest("gram").alias("part"))
    best = F.when(F.col("inside.n") <= F.col("part.n"), F.col("inside.token")).otherwise(F.col("part.gram"))
    return cut.join(rare, "piece").join(inside, "pattern", "left").select("pattern", best.alias("token"))


def sets_of_patterns(texts: DataFrame, wanted: DataFrame, id: str, text: str, most: int) -> DataFrame:
    """(_id, _set): the numbers of wanted(pattern, _p) that the texts of an id contain, for ids with any.

    Each pattern calls for one key.  Up to ``most`` patterns are sent to the texts: a text is compared where it is read,
    and only numbers are shuffled, in one set an id.  More are joined with the texts' keys by a shuffle, and each text
    then moves once, to the set of patterns that it is to be compared with.
    """
    rows = texts.select(F.col(id).alias("_id"), F.col(text).alias("_text")).where("_id is not null and _text is not null")
    cut = pieces(F.col("pattern"))
    sizes = [r.n for r in wanted.select(F.least(F.array_max(F.transform(cut, F.length)), F.lit(GRAM)).alias("n")).where("n > 0").distinct().sort("n").collect()]
    token = F.explode(keys(F.col("_text"), sizes)).alias("token")
    # Written, since it is used several times and each use would read all texts again.
    vocabulary = written(rows.select(F.explode(F.array_distinct(pieces(F.col("_text")))).alias("token")).groupBy("token").agg(F.count("*").alias("n")))
    called = written(anchors(wanted.select("pattern"), vocabulary).join(wanted, "pattern"))
    if called.limit(most + 1).count() <= most:
        found = rows.select("_id", "_text", token).join(F.broadcast(called), "token").where(F.contains("_text", "pattern")).select("_id", "_p")
    else:
        asked = rows.select("_id", token).join(called, "token").groupBy("_id").agg(F.collect_set(F.struct("_p", "pattern")).alias("_asked"))
        found = rows.join(asked, "_id").select("_id", F.explode(F.filter("_asked", lambda x: F.contains("_text", x["pattern"]))).alias("x")).select("_id", "x._p")
    return found.groupBy("_id").agg(F.collect_set("_p").alias("_set"))


def numbered(patterns: DataFrame) -> DataFrame:
    """(pattern, _p): the distinct patterns with numbers, in a table that fixes them."""
    return written(patterns.select("pattern").where("pattern is not null").distinct().withColumn("_p", F.monotonically_increasing_id()))


def containing(texts: DataFrame, patterns: DataFrame, id: str = "id", text: str = "text", most: int = BROADCAST_ROWS) -> DataFrame:
    """(id, pattern): the distinct patterns(pattern) that the text of an id contains, character for character.

    Only texts with a token that a pattern calls for are compared with it.  Nulls, empty patterns and those of
    white space alone are in no text.  Ids that occur more than once have what any of their texts contains.
    """
    wanted = numbered(patterns)
    found = sets_of_patterns(texts, wanted, id, text, most).select("_id", F.explode("_set").alias("_p"))
    return found.join(small_side(wanted), "_p").select(F.col("_id").alias(id), "pattern")


def mentions(texts: DataFrame, patterns: DataFrame, id: str = "id", text: str = "text", most: int = BROADCAST_ROWS) -> DataFrame:
    """texts' ids with ``mentioned``: how many of the distinct patterns their text contains; 0 for none."""
    counted = sets_of_patterns(texts, numbered(patterns), id, text, most).select(F.col("_id").alias(id), F.size("_set").cast("long").alias("_m"))
    return texts.select(id).join(counted, id, "left").select(id, F.coalesce("_m", F.lit(0)).alias("mentioned"))


def appended(code: DataFrame, windows: DataFrame, position: str = "_pos") -> DataFrame:
    """code(instance_id, path, name, content, _pos, ..) followed by the windows(instance_id, path, object, content, start, end, order) that none of it covers.

    A window is covered by a hit of its path and object that contains all of its text, and by an earlier window
    of the same; one without text is never covered.  Windows of empty, absolute or rising paths are left out.
    They continue the numbers of their instance in their own order; columns of code that windows lack are null.
    """
    from ..functions.paths import forward, is_unsafe
    from .numbering import numbered_rows

    stripped = F.regexp_replace("content", r"^\s+|\s+$", "")
    w = windows.withColumn("path", forward(F.trim(F.coalesce("path", F.lit(""))))).where(~is_unsafe(F.col("path")))
    w = w.select("instance_id", "path", F.trim(F.coalesce("object", F.lit(""))).alias("name"), "content", F.col("start").cast("string").alias("start"), F.col("end").cast("string").alias("end"), "order", F.coalesce(stripped, F.lit("")).alias("_bare"))
    same = ["instance_id", "path", "name", "_bare"]
    # A window's text is that of its path and object, so a repeated one is the same text.
    first = w.where("_bare <> ''").groupBy(*same).agg(F.min("order").alias("order"))
    kept = w.where("_bare <> ''").join(first, [*same, "order"]).dropDuplicates([*same, "order"]).unionByName(w.where("_bare = ''"))
    hits = code.select(F.col("instance_id").alias("_i"), F.col("path").alias("_p"), F.col("name").alias("_n"), F.col("content").alias("_c"))
    covers = [F.col("instance_id") == F.col("_i"), F.col("path") == F.col("_p"), F.col("name") == F.col("_n"), F.col("_bare") != "", F.contains("_c", "_bare")]
    extra = numbered_rows(kept.join(hits, reduce(lambda a, b: a & b, covers), "left_anti").drop("_bare"), ["instance_id"], ["order"], "_turn")
    last = code.groupBy("instance_id").agg(F.max(position).alias("_last"))
    placed = extra.join(last, "instance_id", "left").withColumn(position, F.coalesce("_last", F.lit(-1)) + F.col("_turn")).withColumn("node_type", F.lit("inferred_source_location"))
    return code.unionByName(placed.drop("_turn", "_last", "order"), allowMissingColumns=True).select(code.columns)


def fixtures_in_reach(tests: DataFrame, definitions: DataFrame) -> DataFrame:
    """(file, fixture, folder) of tests(file, fixture) with each folder above the file, at any height, that defines the fixture: definitions(folder, fixture)."""
    from .joins import ancestors

    up = tests.select("file", "fixture").distinct().withColumn("folder", F.explode(ancestors(F.col("file"))))
    return up.join(small_side(definitions.select("folder", "fixture").distinct()), ["folder", "fixture"], "left_semi")
