"""JSON lines: strict object check and first-usable-key lookups on a variant.

Lookups take the name of the document column and return an expression over it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions.staging import once

# Key spellings, in lookup order.
LEVEL_KEYS = ["level", "severity", "lvl", "LEVEL"]
TIME_KEYS = ["time", "timestamp", "ts", "@timestamp"]
MESSAGE_KEYS = ["msg", "message", "MESSAGE"]
RESERVED = LEVEL_KEYS + TIME_KEYS + MESSAGE_KEYS

# JSON texts that count as absent (null, false, empty, any zero).
ABSENT = r'^(?:null|false|""|\[\]|\{\}|-?0(?:[.]0+)?(?:[eE][+-]?[0-9]+)?)$'


def with_document(df: DataFrame, raw: str, into: str, where: str = "true") -> DataFrame:
    """Add the line as a variant array whose first element is the object.

    NULL unless the line is exactly one JSON object. The parser accepts text
    after a complete value. A hash of the line is therefore appended as a second
    element: it can only come out at position 1 when everything before it was a
    single value.
    """
    text = f"'[' || {raw} || ',' || xxhash64({raw}) || ']'"
    opens = f"startswith(trim(LEADING ' \\t\\r\\n' FROM {raw}), '{{')"
    closed = "try_variant_get(_parsed, '$[1]', 'bigint')"
    parsed = once(df, "_parsed", F.expr(f"CASE WHEN {where} AND {opens} THEN try_parse_json({text}) END"))
    return once(parsed, into, F.expr(f"CASE WHEN {closed} = xxhash64({raw}) THEN _parsed END")).drop("_parsed")


_RESPELT = "schema_of_variant(v) RLIKE '^(?:DECIMAL|DOUBLE|OBJECT|ARRAY)'"


def _respelt(value: str) -> str:
    """Whether a variant may spell the value in another way than the line: numbers with a fraction or an exponent,
    very long ones, objects and lists."""
    return _RESPELT.replace("(v)", f"({value})")


def _spellings(raw: str) -> str:
    """Key and text of all fields of a line; the last field of a key comes last."""
    return f"map_entries(from_json({raw}, 'map<string,string>'))"


def _text(key: str, value: str, spellings: str) -> str:
    """A field's text; ``key`` and ``value`` (a variant) are SQL expressions. Only respelt values look at the spellings."""
    own = f"try_element_at(filter({spellings}, e -> e.key = {key}), -1).value"
    return f"CASE WHEN {_respelt(value)} THEN coalesce({own}, CAST({value} AS STRING)) ELSE CAST({value} AS STRING) END"


def _field(doc: str, key: str, kind: str = "variant") -> str:
    return f"try_variant_get({doc}, '$[0][\"{key}\"]', '{kind}')"


def _first_usable(doc: str, raw: str, keys: list[str]) -> str:
    """Text of the first key that is present and neither null, false, zero nor empty."""
    texts = (
        f"CASE WHEN NOT to_json({_field(doc, k)}) RLIKE r'{ABSENT}' THEN {_text(f"'{k}'", _field(doc, k), _spellings(raw))} END"
        for k in keys
    )
    return f"coalesce({', '.join(texts)})"


def level(doc: str, raw: str) -> Column:
    return F.expr(f"upper({_first_usable(doc, raw, LEVEL_KEYS)})")


def stamp(doc: str, raw: str) -> Column:
    return F.expr(_first_usable(doc, raw, TIME_KEYS))


def message(doc: str, raw: str) -> Column:
    """First usable message key; a present but unusable last key keeps its text; else ''.

    NULL only for lines that are not JSON objects.
    """
    last = _text(f"'{MESSAGE_KEYS[-1]}'", _field(doc, MESSAGE_KEYS[-1]), _spellings(raw))
    usable = _first_usable(doc, raw, MESSAGE_KEYS)
    return F.expr(f"CASE WHEN {doc} IS NOT NULL THEN coalesce({usable}, {last}, '') END")


def extras(doc: str, raw: str) -> Column:
    """All other keys as text; nested values stay JSON text; an unparsed line gives an empty map.

    The line is read again at most once, and only if one of its fields is respelt.
    """
    fields = f"try_variant_get({doc}, '$[0]', 'map<string,variant>')"
    reserved = ", ".join(f"'{k}'" for k in RESERVED)
    kept = f"map_filter({fields}, (k, v) -> k NOT IN ({reserved}))"
    spellings = f"CASE WHEN exists(map_values(kept), v -> {_respelt('v')}) THEN {_spellings(raw)} END"
    texts = f"transform_values(kept, (k, v) -> {_text('k', 'v', 'spelt')})"
    # one-element arrays name what the inner expressions use several times
    spelt = f"transform(array({spellings}), spelt -> {texts})[0]"
    return F.expr(f"coalesce(transform(array({kept}), kept -> {spelt})[0], CAST(map() AS MAP<STRING, STRING>))")
