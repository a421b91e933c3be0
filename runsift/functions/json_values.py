"""JSON and nested values: native where VARIANT can, an Arrow UDF where Python's leniency is asked for."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .pyast import text_udf

#: Operations that a plan may name, the one it gets if it names none, and its risks.
MUTATIONS = (
    "ARG_VALUE_REPLACE",
    "ARG_BOUNDARY_EXPAND",
    "OPERATOR_FLIP",
    "CALL_CHAIN_EXTEND",
    "STATE_MUTATION",
    "FIXTURE_DATA_MUTATION",
    "CONFIG_MUTATION",
    "MOCK_BEHAVIOR_MUTATION",
    "LIFECYCLE_TRIGGER",
    "SERIALIZATION_TRIGGER",
    "WARNING_LOG_TRIGGER",
)
DEFAULT_MUTATION, RISKS = "CALL_CHAIN_EXTEND", ("low", "medium", "high")
#: Fixed value: marks of an observation block.
OBSERVATION = r"(?s)BRT_OBS_START\s*(.*?)\s*BRT_OBS_END"
#: Bounds of values that are shown to a reader: depth, characters, keys, items, characters of a whole report.
SHOWN_DEPTH, SHOWN_CHARS, SHOWN_KEYS, SHOWN_ITEMS, SHOWN_REPORT = 6, 4000, 40, 10, 20_000


def object_or_null(text: Column) -> Column:
    value = F.try_parse_json(text)
    return F.when(F.startswith(F.schema_of_variant(value), F.lit("OBJECT")), value)


def json_object(text: Column) -> Column:
    """The object in a text as VARIANT: of its first fenced block, of the whole, or between the outermost braces."""
    raw = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    fenced = F.regexp_extract(raw, r"(?is)```(?:json)?\s*(.*?)```", 1)
    braces = F.regexp_extract(raw, r"(?s)(\{.*\})", 1)
    return F.coalesce(object_or_null(fenced), object_or_null(raw), object_or_null(braces))


def _lenient(text: str | None) -> str | None:
    raw = (text or "").strip()
    fence = re.search(r"```(?:json)?\s*(.*?)```", raw, re.S | re.I)
    tries = ([fence[1].strip()] if fence else []) + [raw]
    first, last = raw.find("{"), raw.rfind("}")
    if 0 <= first < last:
        tries.append(raw[first : last + 1])
    for one in tries:
        try:
            value = json.loads(one, strict=False)
        except ValueError:
            continue
        if isinstance(value, dict):
            return json.dumps(value, ensure_ascii=False)
    return None


def json_object_lenient(text: Column) -> Column:
    """As json_object, as JSON text, with what Python accepts besides: NaN, equal keys (the last wins), control characters in strings."""
    return text_udf(_lenient)(text)


def observations(text: Column) -> Column:
    """array<map<string, string>> of the marked observation blocks; a value that is no object becomes {'value': text}; null for bad JSON."""
    blocks = F.regexp_extract_all(text, F.lit(OBSERVATION), F.lit(1))

    return F.transform(blocks, _block)


def _block(b: Column) -> Column:
    # from_json gives null for other values than objects, and for bad JSON.
    return F.coalesce(F.from_json(b, "map<string,string>"), F.when(F.try_parse_json(b).isNotNull(), F.create_map(F.lit("value"), b)))


def last_observation(stdout: Column, stderr: Column) -> Column:
    """The last valid block of both streams; an empty map if there is none."""
    found = F.filter(observations(F.concat_ws("\n", stdout, stderr)), lambda m: m.isNotNull())
    return F.coalesce(F.try_element_at(found, F.lit(-1)), F.create_map().cast("map<string,string>"))


def merged_observations(stdout: Column) -> Column:
    """All blocks of one stream in one map; a later value of a key wins, and the last block that is not JSON is kept under 'raw'."""
    blocks = F.regexp_extract_all(F.coalesce(stdout, F.lit("")), F.lit(OBSERVATION), F.lit(1))

    def merged(read: Column) -> Column:
        broken = F.filter(read, lambda r: r["good"].isNull())
        raw = F.transform(F.slice(F.reverse(broken), 1, 1), lambda r: F.struct(F.lit("raw").alias("key"), r["text"].alias("value")))
        entries = F.flatten(F.transform(F.filter(read, lambda r: r["good"].isNotNull()), lambda r: F.map_entries(r["good"])))
        return bound(F.concat(entries, raw), last_of_each)

    def last_of_each(entries: Column) -> Column:
        keys = F.reverse(F.transform(entries, lambda e: e["key"]))
        last = lambda e, i: F.array_position(keys, e["key"]) == F.size(entries) - i
        return F.map_from_entries(F.filter(entries, last))

    # Each block is read once.
    return bound(F.transform(blocks, lambda b: F.struct(_block(b).alias("good"), b.alias("text"))), merged)


def normalized_plan(ops: Column, risk: Column) -> Column:
    """struct(mutation_ops, risk): at most three known operations, in order, repeats kept; an unknown risk is medium."""
    known = F.slice(F.filter(F.coalesce(ops, F.array().cast("array<string>")), lambda x: x.isin(*MUTATIONS)), 1, 3)
    low = F.lower(risk)
    return F.struct(
        F.when(F.size(known) == 0, F.array(F.lit(DEFAULT_MUTATION))).otherwise(known).alias("mutation_ops"),
        F.when(low.isin(*RISKS), low).otherwise("medium").alias("risk"),
    )


#: Fields of a behaviour description that are lists and objects.
BEHAVIOUR_LISTS = ("target_apis", "suspected_bug_locations", "related_test_seeds", "mutation_hints", "observation_points", "assertion_hints", "setup_hints", "uncertainties")
BEHAVIOUR_OBJECTS = ("trigger_condition", "error_symptom", "expected_behavior")


def repaired_behaviour(row: Column) -> Column:
    """struct of JSON texts: a list field that holds no list becomes [], an object field that holds no object {}; raw keeps the input."""
    text = lambda name: F.to_json(F.try_variant_get(row, f"$.{name}", "variant"))
    shaped = lambda name, sign, empty: F.when(F.startswith(text(name), F.lit(sign)), text(name)).otherwise(empty).alias(name)
    return F.struct(*[shaped(n, "[", "[]") for n in BEHAVIOUR_LISTS], *[shaped(n, "{", "{}") for n in BEHAVIOUR_OBJECTS], F.to_json(row).alias("raw"))


def focus(value: Column, default: list[str]) -> Column:
    """A VARIANT as a list of texts: a list's items, a text alone, else the default."""
    items = F.try_variant_get(value, "$", "array<string>")
    one = F.try_variant_get(value, "$", "string")
    kind = F.schema_of_variant(value)
    return F.when(F.startswith(kind, F.lit("ARRAY")), items).when((kind == "STRING") & (F.trim(one) != ""), F.array(one)).otherwise(F.array(*map(F.lit, default)))


def compact_attempts(attempts: Column, limit: int = 3000) -> Column:
    """array<struct<round_id, status, log>> with logs cut in the middle."""
    from .text import shorten_middle

    return F.transform(attempts, lambda a: F.struct(a["round_id"].alias("round_id"), a["status"].alias("status"), shorten_middle(a["log"], limit).alias("log")))


def shown(value, depth: int = 0):
    """A JSON value bounded in depth, text length, keys and items; what was left out is counted."""
    if depth >= SHOWN_DEPTH:
        return str(value)[:SHOWN_CHARS]
    if isinstance(value, str):
        half = SHOWN_CHARS // 2
        return value if len(value) <= SHOWN_CHARS else f"{value[:half]}\n...[TRUNCATED]...\n{value[half - SHOWN_CHARS:]}"
    if isinstance(value, dict):
        kept = {k: shown(v, depth + 1) for k, v in list(value.items())[:SHOWN_KEYS]}
        return kept | ({"__truncated_keys__": len(value) - SHOWN_KEYS} if len(value) > SHOWN_KEYS else {})
    if isinstance(value, list):
        kept = [shown(v, depth + 1) for v in value[:SHOWN_ITEMS]]
        return kept + ([{"__truncated_items__": len(value) - SHOWN_ITEMS}] if len(value) > SHOWN_ITEMS else [])
    return value


def bounded_report(observations: Column, limit: int = SHOWN_REPORT) -> Column:
    """Bounded form of a report's observations as JSON; what is still too long becomes one shortened text."""
    from .text import shorten_middle

    short = F.coalesce(shown_json(observations), F.lit("{}"))
    return F.when(F.length(short) <= limit, short).otherwise(F.concat(F.lit('{"truncated_json": '), quoted(shorten_middle(short, limit)), F.lit("}")))


def quoted(text: Column) -> Column:
    """A text as a JSON string."""
    whole = F.to_json(F.struct(text.alias("v")))
    return F.substring(whole, F.lit(6), F.length(whole) - 6)


def bound(value: Column, body) -> Column:
    """body(value) with the value computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def shown_value(text: Column, depth: int = 0) -> Column:
    """Bounded form of a JSON value's text: as shown(), with the value's parts as JSON texts and one level a step."""
    from .text import shorten_middle

    def a_text(t: Column) -> Column:
        return bound(F.try_variant_get(F.try_parse_json(t), "$", "string"), lambda plain: quoted(shorten_middle(plain, SHOWN_CHARS)))

    def below(t: Column) -> Column:
        word = F.when(t == "null", "None").when(t == "true", "True").when(t == "false", "False").otherwise(t)
        return F.when(F.startswith(t, F.lit('"')), a_text(t)).otherwise(quoted(shorten_middle(word, SHOWN_CHARS)))

    def with_parts(t: Column) -> Column:
        named = F.transform(F.map_entries(F.from_json(t, "map<string,variant>")), lambda e: F.struct(F.concat(quoted(e["key"]), F.lit(": ")).alias("name"), F.to_json(e["value"]).alias("value")))
        listed = F.transform(F.from_json(t, "array<variant>"), lambda x: F.struct(F.lit("").alias("name"), F.to_json(x).alias("value")))
        is_object = F.startswith(t, F.lit("{"))
        limit = F.when(is_object, SHOWN_KEYS).otherwise(SHOWN_ITEMS)

        def joined(parts: Column) -> Column:
            kept = F.transform(F.slice(parts, F.lit(1), limit), lambda p: F.concat(p["name"], shown_value(F.coalesce(p["value"], F.lit("null")), depth + 1)))
            left = (F.size(parts) - limit).cast("string")
            more = F.when(is_object, F.concat(F.lit('"__truncated_keys__": '), left)).otherwise(F.concat(F.lit('{"__truncated_items__": '), left, F.lit("}")))
            every = F.concat(kept, F.when(F.size(parts) > limit, F.array(more)).otherwise(F.array().cast("array<string>")))
            return F.concat(F.when(is_object, "{").otherwise("["), F.array_join(every, ", "), F.when(is_object, "}").otherwise("]"))

        return bound(F.when(is_object, named).otherwise(listed), joined)

    def whole(t: Column) -> Column:
        return F.when(F.regexp_like(t, F.lit(r"^[{\[]")), with_parts(t)).when(F.startswith(t, F.lit('"')), a_text(t)).otherwise(t)

    return bound(text, below if depth >= SHOWN_DEPTH else whole)


def shown_json(text: Column) -> Column:
    """Bounded form of a JSON text; null for null and for a text that is not JSON.

    Parts are bounded one level after the other as expressions.  A value below the last level is shown as text; one with
    parts as its JSON.
    """
    return shown_value(F.to_json(F.try_parse_json(text)))


#: Fields of an execution that a report shows.
EXECUTION_FIELDS = ("command", "returncode", "duration", "timeout", "status", "error_reason", "stdout", "stderr")
SHOWN_OUTPUT = 24_000


def shown_report(report: Column) -> Column:
    """struct(instance_id, status, observations, execution, raw_output) of a report as VARIANT: observations and execution bounded, as JSON texts, the raw output shortened.

    Of the execution only the named fields are shown, and those it has; one that is no object has none.
    """
    from .text import shorten_middle

    part = lambda name: F.to_json(F.try_variant_get(report, f"$.{name}", "variant"))
    text = lambda name: F.try_variant_get(report, f"$.{name}", "string")
    observations = F.when(part("observations").isin("null", '""', "0", "false", "[]"), "{}").otherwise(part("observations"))
    fields = F.array(*[F.struct(F.lit(f'"{f}": ').alias("name"), part(f"execution.{f}").alias("value")) for f in EXECUTION_FIELDS])
    there = F.filter(fields, lambda x: x["value"].isNotNull())
    execution = F.concat(F.lit("{"), F.array_join(F.transform(there, lambda x: F.concat(x["name"], shown_value(x["value"]))), ", "), F.lit("}"))
    return F.struct(
        text("instance_id").alias("instance_id"),
        text("status").alias("status"),
        bounded_report(observations).alias("observations"),
        execution.alias("execution"),
        shorten_middle(F.coalesce(text("raw_output"), F.lit("")), SHOWN_OUTPUT).alias("raw_output"),
    )
