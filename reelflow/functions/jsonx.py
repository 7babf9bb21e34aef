"""Model-response and payload JSON helpers (JSN-1 … JSN-8). All ``Column -> Column``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reelflow import fixed_values as FV
from reelflow.functions.bind import let
from reelflow.functions.text import py_strip
from reelflow.schemas import SECTION_DDL


STRICT = {"allowSingleQuotes": "false"}
NOT_AN_OBJECT = "item is not an object"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _between_fences(c: Column, opener: str) -> Column:
    """Text after the first ``opener`` up to the next fence, stripped.

    With no closing fence the slice ends one character before the end of the
    text (a ``find`` result of -1 used as a slice end).
    """
    def body(start: Column) -> Column:
        end = F.position(F.lit("```"), c, start)
        return let(end, lambda e: py_strip(
            F.when(e > 0, F.substr(c, start, e - start))
             .otherwise(F.substr(c, start, F.greatest(F.length(c) - start, F.lit(0))))))
    return let(F.instr(c, opener) + len(opener), body)


def fenced_json(content) -> Column:
    """JSN-1: a ```` ```json ```` fence first, else a plain fence, else unchanged."""
    c = _c(content)
    return (F.when(F.instr(c, "```json") > 0, _between_fences(c, "```json"))
             .when(F.instr(c, "```") > 0, _between_fences(c, "```"))
             .otherwise(c))


def outer_object(content) -> Column:
    """JSN-2: greedy outer ``{ … }`` (dot matches newline); unchanged if none."""
    c = _c(content)
    return F.coalesce(F.nullif(F.regexp_extract(c, r"(?s)\{.*\}", 0), F.lit("")), c)


def extract_for_backend(backend, content) -> Column:
    """Per-backend pre-processing before the strict parse."""
    b, c = _c(backend), _c(content)
    return (F.when(b == "anthropic", fenced_json(c))
             .when(b == "ollama", outer_object(c))
             .otherwise(c))


def strict_json_ok(text) -> Column:
    """JSN-3: true only when the whole text is exactly one JSON value (as ``json.loads`` decides).

    Spark's parsers accept trailing text after a value, so the text is wrapped
    twice: ``[t]`` must be a one-element array and ``{"x":t}`` an object with the
    single key ``x``. No text can close both wrappers early, so trailing junk is
    rejected. Single quotes are refused like Python does (Spark allows them by
    default); NaN, leading zeros and raw control characters behave as in
    Python. NULL counts as rejected.
    """
    t = _c(text)
    one = F.size(F.from_json(F.concat(F.lit("["), t, F.lit("]")), "array<string>", STRICT)) == 1
    keys = F.map_keys(F.from_json(F.concat(F.lit('{"x":'), t, F.lit("}")), "map<string,string>", STRICT))
    return F.coalesce(one & (F.size(keys) == 1) & (F.element_at(keys, 1) == "x"), F.lit(False))


def json_kind(text) -> Column:
    """JSN-4: ``object`` / ``array`` / ``scalar`` by the first non-blank character."""
    first = F.substring(py_strip(_c(text)), 1, 1)
    return F.when(first == "{", "object").when(first == "[", "array").otherwise("scalar")


def has_key(text, key: str) -> Column:
    return F.coalesce(F.array_contains(F.json_object_keys(_c(text)), key), F.lit(False))


def sections_kind(text) -> Column:
    """Kind of the ``sections`` value of an object: ``array`` / ``null`` / ``other``.

    Decided on the JSON itself: a string that holds a list in text is ``other``.
    """
    t = _c(text)
    listed = F.from_json(t, "sections ARRAY<STRING>", STRICT).getField("sections")
    return (F.when(listed.isNotNull(), "array")
             .when(F.get_json_object(t, "$.sections").isNull(), "null")
             .otherwise("other"))


def _items(text, kind, item: str) -> Column:
    t = _c(text)
    return F.when(kind == "object", F.from_json(t, f"sections ARRAY<{item}>", STRICT).getField("sections")).otherwise(
        F.from_json(t, f"ARRAY<{item}>", STRICT))


def raw_sections(text, kind) -> Column:
    """Each item of the list as its original JSON text (strings unquoted); NULL for a JSON null."""
    return _items(text, kind, "STRING")


def typed_sections(text, kind) -> Column:
    """JSN-5: the list item by item: the typed fields and ``reason``, which says why an item has none.

    Every item is typed alone, so an item that is no object costs no other item its fields.
    """
    def typed(raw: Column, value: Column) -> Column:
        is_object = F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))
        fields = F.from_json(F.when(is_object, raw), f"STRUCT<{SECTION_DDL}>")
        return F.struct(*[fields.getField(f).alias(f) for f in FV.SECTION_FIELDS],
                        F.when(~is_object, F.lit(NOT_AN_OBJECT)).alias("reason"))

    return F.zip_with(_items(text, kind, "STRING"), _items(text, kind, "VARIANT"), typed)


def decode_base64(b64) -> Column:
    """JSN-7: decoded bytes of a base64 field; invalid input → NULL."""
    return F.try_to_binary(_c(b64), F.lit("base64"))
