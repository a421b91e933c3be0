"""URL filter: association rules over URL tokens, and a list of host and path rules.

A mined rule is a set of tokens of which label 1 follows with enough support and confidence, whatever its size; a
set with a part that is a rule by itself says nothing more and is left out.  Single tokens are counted.  Larger
sets come from Spark's FP-growth over the URLs of label 1, without the tokens that are rules themselves; tokens
that stand in just the same labelled URLs are one item there, so a path that recurs as a whole is not
mined in all its parts, and any of an item's tokens will do for it.  The URLs of label 0 that have all of a set are
counted through an inverted index by the set's rarest item, and so are the URLs to be judged matched.  A URL
that a listed rule fits is judged by the longest of them; all others by the mined rules.
Only DataFrame functions run on the main path.

FP-growth keeps its frequent items on the driver.  A set of several tokens needs MIN_SHARE of the rows of label 1, so
there are at most 1 / MIN_SHARE times the tokens of a URL, at any size.

Defined results: a null URL, or one without "://", has an empty host and path, no tokens, and
is allowed; labels or URLs that are null teach nothing; fewer than MIN_ROWS labelled URLs of label 1 give no mined rules;
repeated rows count and are judged each; columns other than the URL's are kept by judge, a null page_id too; an
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import written

#: A rule needs this many labelled URLs of label 1, however large the table is, and this confidence.
MIN_ROWS, MIN_CONFIDENCE = 20, 0.6
#: A rule of several tokens needs this share of the labelled URLs of label 1, too.
MIN_SHARE = 1e-5
RULES = "rule_tokens array<string>, choices array<array<string>>, anchor string, confidence double, support double"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rest(url: Column) -> Column:
    """What follows the first "://"; empty if there is none."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(rest(url), r"(?s)\A([^/?#]*)", 1), CAPITALS, SMALL)


def path_of(url: Column) -> Column:
    return F.regexp_extract(rest(url), r"(?s)\A[^/?#]*([^?#]*)", 1)


def tokens(host: Column, path: Column) -> Column:
    """Distinct tokens: the labels of the host, and the parts of the path with runs of digits as '#'."""
    hosts = F.transform(F.split(host, r"[.]"), lambda x: F.concat(F.lit("h:"), x))
    paths = F.transform(F.split(path, "/"), lambda x: F.concat(F.lit("p:"), F.regexp_replace(x, "[0-9]+", "#")))
    return F.array_distinct(F.filter(F.concat(hosts, paths), lambda x: F.length(x) > 2))


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest fitting rule of (host, path, verdict); null if none fits."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule_host, rule_path, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        out = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def classes(rows: DataFrame) -> DataFrame:
    """(item, tokens, n, n1) of rows(row, tokens, label): tokens that are in the same rows together, the rows and those of label 1; item is the first of them."""
    single = rows.select("row", "label", F.explode(F.array_distinct("tokens")).alias("token"))
    # Two hashes of the whole set of rows tell equal sets.
    whole = [F.bit_xor(F.xxhash64("row", F.lit(seed))).alias(f"x{seed}") for seed in (1, 2)]
    counted = single.groupBy("token").agg(F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("n1"), *whole)
    # Tokens of one class share their rows, so a class has no more than a URL's tokens.
    return counted.groupBy("n", "n1", "x1", "x2").agg(F.min("token").alias("item"), F.sort_array(F.collect_list("token")).alias("tokens")).select("item", "tokens", "n", "n1")


def with_all(baskets: DataFrame, sets: DataFrame) -> DataFrame:
    """(set, row) for each basket(row, items) that has all of a set(set, anchor), found by the set's anchor."""
    found = baskets.withColumn("anchor", F.explode("items")).join(sets.select("set", "anchor"), "anchor")
    return found.where(F.size(F.array_except("set", "items")) == 0).select("set", "row")


def mine(labelled: DataFrame, min_rows=MIN_ROWS, min_confidence=MIN_CONFIDENCE, min_share=MIN_SHARE) -> DataFrame:
    """Rules (RULES) from labelled(tokens, label), a row for each token of a rule's rarest item, the anchor.

    rule_tokens has the items of the smallest token sets of which label 1 follows, choices the tokens that may stand for each; support is a share of all labelled URLs.
    """
    spark = labelled.sparkSession
    rows = labelled.where("tokens is not null and label is not null and size(tokens) > 0")
    rows = written(rows.select(F.monotonically_increasing_id().alias("row"), "tokens", F.when(F.col("label") == 1, 1).otherwise(0).alias("label")))
    count = rows.agg(F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("n1")).first()
    if count.n1 < min_rows:
        return spark.createDataFrame([], RULES)
    items = written(classes(rows).where(F.col("n1") >= min_rows).withColumn("passes", F.col("n1") >= min_confidence * F.col("n")))
    least = max(min_rows, min_share * count.n1)
    open_ = items.where(~F.col("passes") & (F.col("n1") >= least)).select("item", F.col("n").alias("item_n"), F.explode("tokens").alias("token"))

    tokens = rows.select("row", "label", F.explode("tokens").alias("token")).join(open_, "token")
    baskets = written(tokens.groupBy("row", "label").agg(F.collect_set("item").alias("items")))
    good = baskets.where("label = 1 and size(items) > 1").select("items")
    many = good.count()
    single = items.where("passes").select(F.array("item").alias("rule_tokens"), F.array("tokens").alias("choices"), F.explode("tokens").alias("anchor"), F.col("n"), F.col("n1"))
    rules = single if many < least else single.union(combined(good, (least - 0.5) / many, baskets, items, min_confidence))
    return rules.select("rule_tokens", "choices", "anchor", (F.col("n1") / F.col("n")).alias("confidence"), (F.col("n1") / count.n).alias("support"))


def combined(good: DataFrame, min_support: float, baskets: DataFrame, items: DataFrame, min_confidence: float) -> DataFrame:
    """(rule_tokens, choices, anchor, n, n1) of the smallest sets of several items of which label 1 follows."""
    frequent = FPGrowth(minSupport=min_support, minConfidence=1.0).fit(good).freqItemsets
    sets = frequent.where(F.size("items") > 1).select(F.sort_array("items").alias("set"), F.col("freq").alias("n1"))
    rarest = sets.select("set", "n1", F.explode("set").alias("item")).join(items.select("item", "n"), "item")
    sets = rarest.groupBy("set", "n1").agg(F.min(F.struct("n", "item"))["item"].alias("anchor"))
    others = with_all(baskets.where("label = 0"), sets).groupBy("set").agg(F.count("*").alias("n0"))
    passing = sets.join(others, "set", "left").withColumn("n", F.col("n1") + F.coalesce("n0", F.lit(0))).where(F.col("n1") >= min_confidence * F.col("n"))
    passing = written(passing.select("set", "anchor", "n", "n1"))
    parts = with_all(passing.select(F.col("set").alias("row"), F.col("set").alias("items")), passing).where(F.col("set") != F.col("row"))
    least = passing.join(parts.select(F.col("row").alias("set")), "set", "left_anti")
    each = least.select("set", "anchor", "n", "n1", F.explode("set").alias("item")).join(items.select("item", "tokens"), "item")
    pairs = F.array_sort(F.collect_list(F.struct("item", "tokens")))
    ruled = each.groupBy("set", "anchor", "n", "n1").agg(pairs.alias("p"))
    rarest_tokens = F.filter("p", lambda x: x["item"] == F.col("anchor"))[0]["tokens"]
    return ruled.select(F.col("set").alias("rule_tokens"), F.transform("p", lambda x: x["tokens"]).alias("choices"), F.explode(rarest_tokens).alias("anchor"), "n", "n1")


def judge(urls: DataFrame, rules: list[tuple[str, str, str]], mined: DataFrame, url: str = "url") -> DataFrame:
    """urls with host, path, rule and verdict ('allow' or 'block'); columns of these names are replaced."""
    kept = [c for c in urls.columns if c not in ("host", "path", "rule", "verdict")]
    parsed = urls.select(F.struct(*kept).alias("row"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    parsed = parsed.withColumn("listed", longest_rule(F.col("host"), F.col("path"), rules))
    open_ = parsed.where("listed is null").select("host", "path").distinct().withColumn("tokens", tokens(F.col("host"), F.col("path")))
    looked_up = open_.withColumn("anchor", F.explode("tokens")).join(mined, "anchor")
    hit = looked_up.where(F.forall("choices", lambda c: F.arrays_overlap(c, F.col("tokens")))).select("host", "path").distinct()
    out = parsed.join(hit.withColumn("hit", F.lit(True)), ["host", "path"], "left")
    verdict = F.coalesce("listed.verdict", F.when(F.col("hit"), "block").otherwise("allow"))
    return out.select("row.*", "host", "path", F.col("listed.rule").alias("rule"), verdict.alias("verdict"))
