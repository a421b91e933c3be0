"""Registered queries of readers, sinks, joins on parts of texts, specifications and bounded values on the driver's tables.

Files are written from a given table and read back by the library's own readers, so the rows that come out are
judged, not only the expressions.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import json_values, paths
from ..operators import joins, matching, numbering, ranking, specs
from ..sources import quarantine, records, requirements, sinks
from ..sources.tables import shared_folder
from .queries import OUTCOME_SQL, PATH_SQL, outcome_of_labels, query, table


def new_folder(spark) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


def url_path():
    return F.regexp_extract("url", "^[a-z]+://[^/]*/(.*)$", 1)


def as_text(column: str):
    return F.col(column).cast("string")


# -- numbers


@query(
    """WITH l AS (SELECT event_id, user_id, row_number() OVER (ORDER BY ts DESC, event_id) AS nr FROM events WHERE event_type = 'click'), f AS (SELECT * FROM l WHERE nr <= 1000)
SELECT f.event_id, d.doc_id, row_number() OVER (ORDER BY f.nr) AS place FROM f JOIN documents d ON d.doc_id = f.user_id"""
)
def listed_rows(spark, sf):
    """The first thousand ids of a list with their rows, in its order and as often as it names them."""
    clicks = table(spark, sf, "events").where("event_type = 'click'").select("event_id", F.col("user_id").alias("doc_id"), F.struct((-F.unix_micros(F.col("ts").cast("timestamp"))).alias("t"), "event_id").alias("at"))
    asked = numbering.first_rows(clicks, ["at"], 1000)
    found = asked.join(table(spark, sf, "documents").select("doc_id"), "doc_id")
    return numbering.numbered_rows(found, [], ["at"], "place").select("event_id", "doc_id", "place")


# -- joins on parts of texts


ENVIRONMENTS_SQL = "SELECT DISTINCT ['direct_brt_ecg_we0_', 'old_', 'direct_brt_ecg_we1_', ''][1 + (p_partkey % 4)::INT] || 'setup_' || p_brand || '__' || p_size % 3 AS n FROM part WHERE p_size % 5 > 0"


@query(
    f"""WITH e AS ({ENVIRONMENTS_SQL}), c AS (SELECT c_custkey, 'setup_Brand#' || c_custkey % 60 || '__' || c_nationkey % 4 AS name FROM customer)
SELECT c_custkey, coalesce(max(n) FILTER (n = name), min(n) FILTER (prefix(n, 'direct_brt_ecg_we1_')), min(n) FILTER (prefix(n, 'direct_brt_ecg_we0_')), max(n), name) AS environment
FROM c LEFT JOIN e ON suffix(n, name) GROUP BY c_custkey, name"""
)
def environment_table(spark, sf):
    """Names matched by their endings with those of a table."""
    beginnings = F.element_at(F.array(*map(F.lit, ["direct_brt_ecg_we0_", "old_", "direct_brt_ecg_we1_", ""])), (F.col("p_partkey") % 4 + 1).cast("int"))
    names = table(spark, sf, "part").where("p_size % 5 > 0").select(F.concat(beginnings, F.lit("setup_"), "p_brand", F.lit("__"), (F.col("p_size") % 3).cast("string")).alias("environment"))
    wanted = table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("setup_Brand#"), (F.col("c_custkey") % 60).cast("string"), F.lit("__"), (F.col("c_nationkey") % 4).cast("string")).alias("name"))
    return matching.matched_environments(wanted, names).select("c_custkey", "environment")


@query("SELECT DISTINCT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text) WHERE trim(b.text) <> ''")
def benchmark_mentions(spark, sf):
    """Documents that hold a benchmark passage to the letter."""
    items = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("pattern"))
    found = matching.containing(table(spark, sf, "documents").select("doc_id", "text"), items, "doc_id")
    return found.join(items, "pattern").select("doc_id", "item_id").distinct()


@query(
    """WITH p AS (SELECT DISTINCT unnest([split_part(text, ' ', 2), left(split_part(text, ' ', 3), 2), split_part(text, ' ', 4) || ' ' || split_part(text, ' ', 5)]) AS p FROM benchmark)
SELECT d.doc_id, count(p.p) AS mentioned FROM documents d LEFT JOIN p ON contains(d.text, p.p) AND trim(p.p) <> '' GROUP BY d.doc_id"""
)
def name_mentions(spark, sf):
    """How many of the names in a table each text contains: words, beginnings of words and pairs of words."""
    word = lambda n: F.split_part("text", F.lit(" "), F.lit(n))
    names = table(spark, sf, "benchmark").select(F.explode(F.array(word(2), F.substring(word(3), 1, 2), F.concat(word(4), F.lit(" "), word(5)))).alias("pattern"))
    return matching.mentions(table(spark, sf, "documents").select("doc_id", "text"), names, "doc_id")


@query(
    f"""WITH p AS (SELECT page_id, {PATH_SQL} AS path, 'f' || page_id % 7 AS fixture FROM pages),
d AS (SELECT DISTINCT CASE WHEN contains(path, '/') THEN regexp_extract(path, '^(.*)/[^/]*$', 1) ELSE '' END AS folder, fixture FROM p WHERE page_id % 3 = 0)
SELECT DISTINCT p.path AS file, p.fixture, d.folder FROM p JOIN d ON p.fixture = d.fixture AND (d.folder = '' OR prefix(p.path, d.folder || '/'))"""
)
def fixture_reach(spark, sf):
    """Fixtures that are defined in a folder above a path, at any height."""
    pages = table(spark, sf, "pages").select("page_id", url_path().alias("file"), F.concat(F.lit("f"), (F.col("page_id") % 7).cast("string")).alias("fixture"))
    defined = pages.where("page_id % 3 = 0").select(paths.directory(F.col("file")).alias("folder"), "fixture")
    return matching.fixtures_in_reach(pages, defined)


@query(
    """WITH code AS (SELECT source AS i, lang AS path, 'n' || doc_id % 3 AS name, text AS content, doc_id AS pos FROM documents WHERE doc_id % 4 > 0),
w AS (SELECT source AS i, CASE WHEN doc_id % 9 = 0 THEN '../' || lang ELSE lang END AS path, 'n' || doc_id % 3 AS name, trim(left(text, 24)) AS bare, doc_id AS o FROM documents WHERE doc_id % 2 = 0),
u AS (SELECT * FROM w WHERE NOT contains(path, '..') QUALIFY bare = '' OR row_number() OVER (PARTITION BY i, path, name, bare ORDER BY o) = 1),
x AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY o) AS t FROM u WHERE bare = '' OR NOT EXISTS (SELECT 1 FROM code c WHERE c.i = u.i AND c.path = u.path AND c.name = u.name AND contains(c.content, u.bare))),
m AS (SELECT i, max(pos) AS last FROM code GROUP BY i)
SELECT i AS instance_id, path, name, pos AS _pos, 'hit' AS kind FROM code UNION ALL SELECT i, path, name, coalesce(last, -1) + t, 'extra' FROM x LEFT JOIN m USING (i)"""
)
def appended_context(spark, sf):
    """Hits, and after them the windows that none of them covers, numbered on."""
    docs = table(spark, sf, "documents")
    name = F.concat(F.lit("n"), (F.col("doc_id") % 3).cast("string")).alias("name")
    code = docs.where("doc_id % 4 > 0").select(F.col("source").alias("instance_id"), F.col("lang").alias("path"), name, F.col("text").alias("content"), F.col("doc_id").alias("_pos"), F.lit("hit").alias("kind"))
    path = F.when(F.col("doc_id") % 9 == 0, F.concat(F.lit("../"), "lang")).otherwise(F.col("lang")).alias("path")
    window = F.trim(F.substring("text", 1, 24)).alias("content")
    windows = docs.where("doc_id % 2 = 0").select(F.col("source").alias("instance_id"), path, name.alias("object"), window, F.lit(1).alias("start"), F.lit(2).alias("end"), F.col("doc_id").alias("order"))
    return matching.appended(code, windows).select("instance_id", "path", "name", "_pos", F.coalesce("kind", F.lit("extra")).alias("kind"))


# -- specifications


KEYS_SQL = "'o/' || lower(p_brand) AS repo, '1.' || p_size % 6 AS version, 'c' || p_size % 4 AS commit"


@query(
    f"""WITH i AS (SELECT p_partkey, p_size, {KEYS_SQL}, 'b' || p_partkey % 5 AS base FROM part),
k AS (SELECT DISTINCT repo, version FROM i), n AS (SELECT *, right(version, 1)::INT AS v FROM k),
inst AS (SELECT *, '3.' || v + 6 AS python, CASE v % 3 WHEN 0 THEN 'requirements.txt' WHEN 1 THEN 'environment.yml' ELSE 'numpy scipy' END AS packages, v % 2 = 0 AS no_env FROM n WHERE v <> 5),
fw AS (SELECT repo, version, CASE v % 4 WHEN 0 THEN 'pytest -rA --tb=no' WHEN 1 THEN 'python3 -m pytest' WHEN 2 THEN './run --quiet' ELSE 'PYTHONWARNINGS=''ignore::UserWarning,ignore::SyntaxWarning'' bin/test -C' END AS command FROM n WHERE v <> 4),
j AS (SELECT i.*, 'setup_' || replace(i.repo, '/', '_') || '__' || i.version AS env, CASE WHEN p_size % 4 = 0 THEN base ELSE commit END AS own_commit, inst.python, inst.packages, inst.no_env, fw.command,
    'src/a' || p_partkey || '.py' AS file FROM i LEFT JOIN inst USING (repo, version) LEFT JOIN fw USING (repo, version)),
t AS (SELECT *, '-m t' || p_partkey || ' --k9' AS directive, 'python3 /root/trace.py --count -C coverage.cover --include-pattern ''/testbed/(src/a' || p_partkey || '\\.py)''' AS tracer FROM j),
r AS (SELECT *, command || ' ' || directive AS plain, 'name: x' || chr(10) || 'for: ' || own_commit AS yml, 'req ' || own_commit AS req FROM t),
q AS (SELECT *, CASE WHEN p_size % 2 = 0 THEN plain WHEN command LIKE 'pytest%' THEN tracer || ' -m ' || replace(plain, '--tb=no', '') WHEN command LIKE 'python3%' THEN tracer || ' -m' || substr(plain, 11)
      WHEN command LIKE 'PYTHON%' THEN 'PYTHONWARNINGS=''ignore::UserWarning,ignore::SyntaxWarning'' ' || tracer || ' ' || substr(plain, 60) ELSE tracer || ' ' || plain END AS test_command,
  CASE WHEN packages = 'requirements.txt' THEN ['conda create -n ' || env || ' python=' || python || ' -y', 'cat <<''EOF_59812759871'' > $HOME/requirements.txt' || chr(10) || req || chr(10) || 'EOF_59812759871', 'conda activate ' || env || ' && python -m pip install -r $HOME/requirements.txt', 'rm $HOME/requirements.txt']
    WHEN packages = 'environment.yml' THEN list_concat(['cat <<''EOF_59812759871'' > environment.yml' || chr(10) || 'name: ' || env || substr(yml, 8) || chr(10) || 'EOF_59812759871'],
      CASE WHEN no_env THEN ['conda create -c conda-forge -n ' || env || ' python=' || python || ' -y', 'conda env update -f environment.yml'] ELSE ['conda env create --file environment.yml', 'conda activate ' || env || ' && conda install python=' || python || ' -y'] END, ['rm environment.yml'])
    WHEN packages IS NOT NULL THEN ['conda create -n ' || env || ' python=' || python || ' ' || packages || ' -y'] END AS commands FROM r)
SELECT p_partkey, env AS env_name, own_commit AS environment_setup_commit, packages IS NOT NULL AS known_install, command IS NOT NULL AS known_tests, test_command, array_to_string(commands, chr(10)) AS commands,
  CASE WHEN packages IS NOT NULL THEN '#!/bin/bash' || chr(10) || 'set -euxo pipefail' || chr(10) || 'source ~/miniconda3/bin/activate' || chr(10) || array_to_string(commands, chr(10)) || chr(10) || 'conda activate ' || env || chr(10) || CASE WHEN python <> '3.8' THEN 'python -m pip install a b==1' || chr(10) ELSE '' END END AS env_script,
  CASE WHEN packages IS NOT NULL THEN 'apt x && ' || CASE WHEN no_env THEN 'python -m pip install ''cython>=3'' wheel && pip install --no-build-isolation -e .' ELSE 'pip install -e .' END || ' && export A=1' END AS setup_command FROM q"""
)
def exec_specs(spark, sf):
    """Specifications from tables of installs and test commands; some pairs are known to one of them only, some to none."""
    part = table(spark, sf, "part")
    size = F.col("p_size")
    repo, version = F.concat(F.lit("o/"), F.lower("p_brand")), F.concat(F.lit("1."), (size % 6).cast("string"))
    keyed = part.select("p_partkey", "p_size", repo.alias("repo"), version.alias("version"))
    number = F.concat(F.lit("src/a"), as_text("p_partkey"), F.lit(".py"))
    patch = F.concat(F.lit("diff --git a/"), number, F.lit(" b/"), number, F.lit("\n"))
    directives = F.array(F.concat(F.lit("-m t"), as_text("p_partkey")), F.lit("--k9"))
    instances = keyed.select(
        as_text("p_partkey").alias("instance_id"), "repo", "version", F.concat(F.lit("b"), (F.col("p_partkey") % 5).cast("string")).alias("base_commit"),
        F.when(size % 4 != 0, F.concat(F.lit("c"), (size % 4).cast("string"))).alias("environment_setup_commit"), patch.alias("test_patch"), directives.alias("directives"),
        (size % 2 != 0).alias("traced"), F.array(F.lit("cython>=3"), F.lit("wheel")).alias("build_requirements"),
    )
    v = F.right("version", F.lit(1)).cast("int")
    pairs = keyed.select("repo", "version").distinct()
    free = v % 2 == 0
    installs = pairs.where(v != 5).select(
        "repo", "version", F.concat(F.lit("3."), (v + 6).cast("string")).alias("python"), F.when(v % 3 == 0, "requirements.txt").when(v % 3 == 1, "environment.yml").otherwise("numpy scipy").alias("packages"),
        F.when(free, "pip install --no-build-isolation --no-use-pep517 -e .").otherwise("pip install -e .").alias("install"), F.when(v != 2, F.array(F.lit("a"), F.lit("b==1"))).alias("pip_packages"),
        F.array(F.lit("apt x")).alias("pre_install"), F.array(F.lit("export A=1")).alias("eval_commands"), free.alias("no_use_env"),
    )
    command = F.when(v % 4 == 0, "pytest -rA --tb=no").when(v % 4 == 1, "python3 -m pytest").when(v % 4 == 2, "./run --quiet").otherwise(specs.QUIET_WARNINGS + " bin/test -C")
    frameworks = pairs.where(v != 4).select("repo", "version", command.alias("command"))
    at = instances.select("repo", F.coalesce("environment_setup_commit", "base_commit").alias("commit")).distinct()
    texts = at.select("repo", "commit", F.concat(F.lit("req "), "commit").alias("requirements"), F.concat(F.lit("name: x\nfor: "), "commit").alias("environment_yml"))
    got = specs.exec_specs(instances, installs, frameworks, texts)
    commands = F.array_join("req_install_commands", "\n").alias("commands")
    return got.select(F.col("instance_id").cast(part.schema["p_partkey"].dataType).alias("p_partkey"), "env_name", "environment_setup_commit", "known_install", "known_tests", "test_command", commands, "env_script", "setup_command")


@query(
    r"""WITH f AS (SELECT doc_id, doc_id % 2 = 0 AS top, string_split(text, chr(10)) AS l FROM documents),
own AS (SELECT doc_id, top, array_to_string(list_filter(list_concat([' # note', 'x==' || doc_id], l), lambda x: NOT regexp_matches(x, '^\s*(-e \.|#|\.\[test|-r)')), chr(10)) AS own FROM f),
more AS (SELECT o.doc_id, list_filter(list_concat(['-r other.txt', '-e .'], f.l), lambda x: NOT regexp_matches(x, '^\s*(-e \.|#|\.\[test)')) AS more FROM own o JOIN f ON f.doc_id = o.doc_id + 1)
SELECT doc_id, CASE WHEN top THEN 'requirements.txt' ELSE 'req/dev.txt' END AS path, md5(array_to_string(list_concat(coalesce(more, []), [own]), chr(10))) AS text_md5 FROM own LEFT JOIN more USING (doc_id)"""
)
def requirement_files(spark, sf):
    """A file at the first candidate path that there is, with the lines of the file that it refers to before its own."""
    docs = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    top = F.col("doc_id") % 2 == 0
    reference = F.when(top, "-r req/base.txt").otherwise("-r ../req/./base.txt")
    own = F.concat(F.lit(" # note\nx=="), as_text("doc_id"), F.lit("\n"), reference, F.lit("\n-r missing.txt\n"), "text")
    main = docs.select(F.lit("r").alias("repo"), F.col("doc_id").alias("commit"), F.when(top, "requirements.txt").otherwise("req/dev.txt").alias("path"), own.alias("text"))
    base = docs.select(F.lit("r").alias("repo"), (F.col("doc_id") - 1).alias("commit"), F.lit("req/base.txt").alias("path"), F.concat(F.lit("-r other.txt\n-e .\n"), "text").alias("text"))
    candidates = spark.createDataFrame([("r", 0, "requirements.txt"), ("r", 1, "req/dev.txt")], "repo string, position int, path string")
    got = requirements.expanded(main.union(base), candidates)
    return got.select(F.col("commit").alias("doc_id"), "path", F.md5("text").alias("text_md5"))


@query(
    """WITH d AS (SELECT doc_id, text || ' ' || source AS t, source AS s, lang AS l FROM documents),
a AS (SELECT *, (length(t) - length(replace(t, s, ''))) // length(s) AS n1, replace(t, s, l || '!') AS t1 FROM d), b AS (SELECT *, (length(t1) - length(replace(t1, l || '!', ''))) // (length(l) + 1) AS n2 FROM a)
SELECT doc_id, CASE WHEN n1 <> 1 THEN 'search text must occur exactly once in a.py, found ' || n1 WHEN doc_id % 5 = 0 THEN 'source file does not exist: b.py' WHEN n2 <> 1 THEN 'search text must occur exactly once in a.py, found ' || n2 ELSE '' END AS problem,
  md5(CASE WHEN n1 = 1 AND n2 = 1 AND doc_id % 5 > 0 THEN replace(t1, l || '!', '<end>') ELSE t END) AS text_md5, (CASE WHEN n1 = 1 AND n2 = 1 AND doc_id % 5 > 0 THEN 2 ELSE 0 END)::INT AS steps FROM b"""
)
def sequential_edits(spark, sf):
    """Two edits of a text, the second of what the first has made; all or none."""
    docs = table(spark, sf, "documents").where("text is not null and source is not null and lang is not null")
    item = lambda path, search, replace: F.struct(path.alias("path"), search.alias("search"), replace.alias("replace"))
    mark = F.concat("lang", F.lit("!"))
    second = F.when(F.col("doc_id") % 5 == 0, "b.py").otherwise("a.py")
    got = paths.edited(F.create_map(F.lit("a.py"), F.concat("text", F.lit(" "), "source")), F.array(item(F.lit("a.py"), F.col("source"), mark), item(second, mark, F.lit("<end>"))))
    return docs.select("doc_id", got.alias("g")).select("doc_id", "g.problem", F.md5(F.col("g.files")["a.py"]).alias("text_md5"), F.size("g.steps").alias("steps"))


# -- bounded values


@query(
    """WITH c AS (SELECT conv_id, list(coalesce(text, '') ORDER BY turn, role, text) AS t FROM conversations GROUP BY conv_id)
SELECT conv_id, least(len(t), 10) AS kept, nullif(greatest(len(t) - 10, 0), 0) AS left_out, md5(CASE WHEN length(t[1] || repeat('z', 4100)) <= 4000 THEN '' ELSE left(t[1] || repeat('z', 4100), 2000) || chr(10) || '...[TRUNCATED]...' || chr(10) || right(t[1] || repeat('z', 4100), 2000) END) AS first_md5,
  CASE WHEN conv_id % 45 > 40 THEN 40 ELSE conv_id % 45 END AS keys, CASE WHEN conv_id % 45 > 40 THEN conv_id % 45 - 40 END AS keys_left, '[[[[["None"]]]]]' AS deep, '{"returncode": 1, "stdout": "' || conv_id || '"}' AS execution FROM c"""
)
def bounded_values(spark, sf):
    """A nested report bounded in depth, keys, items and characters."""
    talk = table(spark, sf, "conversations").select("conv_id", F.struct("turn", "role", F.col("text").alias("x"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    texts = talk.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list("t")), lambda x: F.concat(x["text"], F.lit("z" * 4100))).alias("turns"))
    many = F.map_from_entries(F.transform(F.sequence(F.lit(0).cast("long"), F.col("conv_id") % 45), lambda n: F.struct(F.concat(F.lit("k"), n.cast("string")).alias("k"), n.alias("v"))))
    bag = F.map_filter(many, lambda k, v: v > 0)
    run = F.struct(F.lit("x").alias("other"), F.lit(1).alias("returncode"), as_text("conv_id").alias("stdout"))
    report = F.struct(F.struct(bag.alias("bag"), F.from_json(F.lit("[[[[[null]]]]]"), "array<array<array<array<array<string>>>>>").alias("deep")).alias("observations"), run.alias("execution"))
    talk_report = F.struct(F.struct(F.col("turns").alias("turns")).alias("observations"))
    both = texts.select("conv_id", json_values.shown_report(F.parse_json(F.to_json(report, {"ignoreNullFields": "false"}))).alias("r"), json_values.shown_json(F.to_json(talk_report)).alias("t"))
    items = F.from_json(F.get_json_object("t", "$.observations.turns"), "array<string>")
    keys = F.map_keys(F.from_json(F.get_json_object("r.observations", "$.bag"), "map<string,string>"))
    read = both.select("conv_id", items.alias("items"), keys.alias("keys"), F.col("r.observations").alias("o"), F.col("r.execution").alias("execution"))
    left = F.get_json_object(F.element_at("items", -1), "$.__truncated_items__").cast("long")
    cut = F.exists("keys", lambda k: k == "__truncated_keys__")
    return read.select(
        "conv_id",
        (F.size("items") - F.when(left.isNull(), 0).otherwise(1)).cast("long").alias("kept"),
        left.alias("left_out"),
        F.md5(F.element_at("items", 1)).alias("first_md5"),
        (F.size("keys") - cut.cast("int")).cast("long").alias("keys"),
        F.get_json_object("o", "$.bag.__truncated_keys__").cast("long").alias("keys_left"),
        F.get_json_object("o", "$.deep").alias("deep"),
        "execution",
    )


# -- files written and read back


@query("SELECT source AS instance_id, min(doc_id) AS first, max(doc_id) AS doc_id, arg_max(lang, doc_id) AS lang FROM documents WHERE source IS NOT NULL AND source <> '' GROUP BY source")
def issue_files(spark, sf):
    """Rows as JSONL, loaded again: of an id in several rows the last, at the place of the first."""
    docs = table(spark, sf, "documents").select(F.col("source").alias("instance_id"), "doc_id", "lang", "text")
    path = f"{new_folder(spark)}/issues.jsonl"
    sinks.write_json(docs.repartitionByRange(4, "doc_id").sortWithinPartitions("doc_id"), path)
    rows = records.identified(records.load_any(spark, path))
    # The files' own order is that of doc_id; the first of an id is looked up by its place.
    place = rows.select(records.POSITION, records.field(F.col("row"), "doc_id", "long").alias("first"))
    got = ranking.last_wins(rows, ["instance_id"], records.POSITION).join(place, records.POSITION)
    return got.select("instance_id", "first", records.field(F.col("row"), "doc_id", "long").alias("doc_id"), records.field(F.col("row"), "lang").alias("lang"))


@query(
    """WITH h AS (SELECT source, doc_id, lang AS path, 'n' || doc_id % 5 AS name, doc_id % 3 AS a, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE 7 END AS b FROM documents),
f AS (SELECT *, row_number() OVER (PARTITION BY source, path, name, a, b ORDER BY doc_id) AS k FROM h), t AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM f WHERE k = 1)
SELECT source AS instance_id, doc_id, path, name, doc_id = min(doc_id) FILTER (a = 2) OVER (PARTITION BY source) AS best FROM t WHERE r <= 6"""
)
def hit_files(spark, sf):
    """Hits as JSONL, loaded, told apart by their raw keys, cut to six an instance, and the best of them by score."""
    docs = table(spark, sf, "documents")
    row = docs.select(
        F.col("source").alias("instance_id"), "doc_id", F.col("lang").alias("path"), F.concat(F.lit("n"), (F.col("doc_id") % 5).cast("string")).alias("obj_name"),
        (F.col("doc_id") % 3).alias("code_start_line"), F.when(F.col("doc_id") % 4 != 0, 7).alias("code_end_line"), F.col("text").alias("code"),
    )
    path = f"{new_folder(spark)}/hits.jsonl"
    sinks.write_json(row.repartitionByRange(4, "doc_id").sortWithinPartitions("doc_id"), path)
    hits = records.load_hits(spark, path)
    typed = records.code_hits(hits).join(hits.select(records.POSITION, records.field(F.col("row"), "doc_id", "long").alias("doc_id")), records.POSITION)
    kept = ranking.dedup_top_k(typed, ["instance_id"], [F.col("key")], records.POSITION, 6)
    best = ranking.best_by(kept.select("instance_id", "doc_id", "start", records.POSITION), ["instance_id"], F.col("start").cast("int"), records.POSITION)
    top = best.where("start = '2'").select("instance_id", F.col("doc_id").alias("of_best"))
    return kept.join(top, "instance_id", "left").select("instance_id", "doc_id", "path", "name", (F.col("doc_id") == F.col("of_best")).alias("best"))


BROKEN_SQL = "CASE event_id % 7 WHEN 0 THEN left(props, 3) WHEN 1 THEN '[' || props || ']' WHEN 2 THEN props ELSE '{\"instance_id\": \"e' || event_id || '\", \"p\": ' || props || '}' END"


@query(f"SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'not JSON' WHEN 1 THEN 'not an object' WHEN 2 THEN 'no instance_id' END AS reason, CASE WHEN event_id % 7 > 2 THEN 'e' || event_id END AS instance_id, CASE WHEN event_id % 7 <= 2 THEN {BROKEN_SQL} END AS text FROM events WHERE length(props) > 3")
def quarantined_lines(spark, sf):
    """Every line, as a record or set aside with its reason and its text as it was."""
    events = table(spark, sf, "events").where("length(props) > 3")
    kind = F.col("event_id") % 7
    record = F.concat(F.lit('{"instance_id": "e'), as_text("event_id"), F.lit('", "p": '), "props", F.lit("}"))
    line = F.when(kind == 0, F.substring("props", 1, 3)).when(kind == 1, F.concat(F.lit("["), "props", F.lit("]"))).when(kind == 2, F.col("props")).otherwise(record)
    texts = events.select(line.alias("line"), F.struct(F.lit("f").alias("file"), F.lit(0).cast("long").alias("block"), F.col("event_id").cast("long").alias("n")).alias(records.POSITION))
    good, bad = quarantine.parted(quarantine.judged_lines(texts))
    at = F.col(records.POSITION)["n"].alias("event_id")
    both = good.select(at, F.lit(None).cast("string").alias("reason"), "instance_id", F.lit(None).cast("string").alias("text"))
    return both.unionByName(bad.select(at, "reason", F.lit(None).cast("string").alias("instance_id"), "text"))


@query(
    f"""WITH r AS (SELECT doc_id, {OUTCOME_SQL} AS status FROM labels WHERE doc_id IS NOT NULL)
SELECT count(*) AS total_instances, count(*) FILTER (status = 'F2P_SUCCESS') AS f2p_success, count(*) FILTER (status <> 'F2P_SUCCESS') AS f2p_fail, count(*) FILTER (status = 'BUGGY_PASS') AS buggy_pass FROM r"""
)
def merged_shards(spark, sf):
    """Results written as shards of many instances, the shards merged, and the merged table's metrics."""
    results = table(spark, sf, "labels").where("doc_id is not null").select("doc_id", outcome_of_labels().alias("status"))
    value = F.to_json(F.struct("status", (F.col("status") == "F2P_SUCCESS").alias("success")))
    pair = F.concat(F.lit('"'), as_text("doc_id"), F.lit('": '), value)
    # A shard is one JSON object; each has some hundred instances, however many there are in all.
    shards = results.groupBy(F.floor(F.col("doc_id") / 256).alias("worker")).agg(F.concat(F.lit("{"), F.array_join(F.collect_list(pair), ", "), F.lit("}")).alias("value"))
    root = new_folder(spark)
    shards.write.partitionBy("worker").text(root)
    metrics = sinks.write_merged(spark, root, "worker=*")
    return metrics.select("total_instances", "f2p_success", "f2p_fail", F.coalesce(F.col("by_status")["BUGGY_PASS"], F.lit(0)).alias("buggy_pass"))


@query(
    f"""WITH d AS (SELECT doc_id AS i, doc_id % 2 = 0 AS s, doc_id % 3 = 0 AS r, text, lang FROM documents), l AS (SELECT doc_id AS i, {OUTCOME_SQL} AS status FROM labels)
SELECT d.i AS instance_id, text <> '' AS generated, l.i IS NOT NULL AS evaluated, CASE WHEN l.i % 5 = 0 THEN 'direct/' || d.i || '.py' ELSE 'generation/' || d.i || '/final_test.py' END AS test_file_path,
  CASE WHEN l.i IS NOT NULL THEN 'T::t' || d.i END AS test_nodeid, CASE WHEN s THEN upper(lang) END AS status, CASE WHEN r AND d.i % 4 = 0 THEN 9 WHEN r AND d.i % 4 = 1 THEN 2 WHEN s THEN d.i % 7 END AS final_round,
  CASE WHEN r AND d.i % 4 < 3 THEN 2 WHEN text <> '' THEN 1 ELSE 0 END AS candidate_count, CASE WHEN r AND d.i % 4 = 0 THEN 9 WHEN r AND d.i % 4 = 1 THEN 2 END AS selected, CASE WHEN s AND d.i % 4 = 0 THEN NULL WHEN s THEN d.i % 3 END AS returncode,
  CASE WHEN s AND d.i % 4 <> 0 THEN 'out' || d.i || chr(10) || chr(10) || 'why' END AS excerpt, CASE WHEN s AND d.i % 6 <> 0 THEN d.i % 6 = 2 END AS issue_aligned, CASE WHEN s THEN 'DUAL' END AS surrogate,
  l.status AS formal_status, coalesce(l.status = 'F2P_SUCCESS', false) AS is_f2p_success, CASE WHEN l.i IS NOT NULL THEN d.i % 2 END AS patched_returncode, CASE WHEN s THEN 'generation/' || d.i || '/summary.json' END AS generation_record,
  CASE WHEN l.i IS NOT NULL THEN 'evaluation/merged_results.json' END AS evaluation_record, CASE WHEN r AND d.i % 4 = 0 THEN 'log/' || d.i END AS buggy_log, CASE WHEN s AND d.i % 10 = 0 THEN 'boom' WHEN l.i IS NOT NULL AND d.i % 5 = 0 THEN 'late' END AS error FROM d LEFT JOIN l USING (i)"""
)
def full_records(spark, sf):
    """Every field of the record, from JSON summaries, rankings and evaluations of which some lack what others have."""
    docs = table(spark, sf, "documents").withColumnRenamed("doc_id", "instance_id")
    n = F.col("instance_id")
    text = n.cast("string")
    run = F.struct(F.lit("FAIL").alias("status"), (n % 3).alias("returncode"), F.concat(F.lit("out"), text).alias("stdout"), F.lit("").alias("stderr"), F.lit("why").alias("error_reason"))
    aligned = F.when(n % 6 == 0, "").when(n % 6 == 2, "issue_aligned").otherwise("side_path")
    value = lambda *c: F.parse_json(F.to_json(F.struct(*c))).alias("value")
    summaries = docs.where("instance_id % 2 = 0").select(
        "instance_id",
        value(
            F.upper("lang").alias("status"), (n % 7).alias("rounds_used"), F.when(n % 4 != 0, run).alias("buggy_execution"), aligned.alias("strict_failure_class"),
            F.struct(F.lit("DUAL").alias("status")).alias("dual_version_result"), F.when(n % 10 == 0, "boom").otherwise("").alias("error"),
        ),
    )
    attempt = lambda selected, k: F.struct(selected.alias("selected"), F.lit(k).alias("round_id"))
    rounds = F.when(n % 4 < 3, F.array(attempt(F.lit(False), 1), attempt(n % 4 == 1, 2)))
    rankings = docs.where("instance_id % 3 = 0").select("instance_id", value(F.when(n % 4 == 0, 9).alias("selected_attempt"), rounds.alias("checkpoints")))
    judged = table(spark, sf, "labels").withColumnRenamed("doc_id", "instance_id")
    evaluations = judged.select(
        "instance_id",
        value(
            outcome_of_labels().alias("status"), F.struct((n % 2).alias("returncode")).alias("fixed_run"), F.when(n % 5 == 0, F.concat(F.lit("direct/"), text, F.lit(".py"))).alias("direct_test_repo_path"),
            F.concat(F.lit("T::t"), text).alias("selector"), F.when(n % 5 == 0, "late").alias("error"),
        ),
    )
    logs = docs.select("instance_id", F.lit(9).alias("attempt"), F.concat(F.lit("log/"), text).alias("path"))
    made = joins.export_record(docs, joins.read_summaries(summaries), joins.read_evaluations(evaluations, F.lit("evaluation/merged_results.json")), joins.read_rankings(rankings), docs.select("instance_id", F.col("text").alias("content")), logs)
    return made.select(
        "instance_id", "generated", "evaluated", "selected_test.test_file_path", "selected_test.test_nodeid", "generation.status", F.col("generation.final_round").cast("long").alias("final_round"), F.col("generation.candidate_count").alias("candidate_count"),
        F.col("generation.selected_candidate_index").alias("selected"), F.col("generation.buggy_returncode").cast("long").alias("returncode"), F.col("generation.buggy_log_excerpt").alias("excerpt"), "generation.issue_aligned",
        F.col("generation.surrogate_status").alias("surrogate"), F.col("formal_evaluation.status").alias("formal_status"), "formal_evaluation.is_f2p_success", F.col("formal_evaluation.patched_returncode").cast("long").alias("patched_returncode"),
        "paths.generation_record", "paths.evaluation_record", "paths.buggy_log", "error",
    )
