"""Loosely typed JSON: values that may be numbers, texts, booleans, null or absent.

JSON text is parsed to VARIANT, so that one malformed element does not lose its whole array and the source
type of a value stays known.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F

from rankeval.functions.text import let

# fixed pattern: what a float literal in text may look like (inner underscores, inf and nan included)
FLOAT_TEXT = r"(?i)^\s*[+-]?(\d+(_\d+)*(\.(\d+(_\d+)*)?)?|\.\d+(_\d+)*)(e[+-]?\d+(_\d+)*)?\s*$"
SPECIAL_FLOAT_TEXT = r"(?i)^\s*[+-]?(inf|infinity|nan)\s*$"
# fixed values: keys of a feature bag that are identifiers
ID_KEYS = ["ParentId", "SpanId", "contentId"]


def parse(c: Column) -> Column:
    """JSON text to VARIANT, null when it does not parse."""
    return F.try_parse_json(c)


def get(v: Column, path: str, target: str = "variant") -> Column:
    return F.try_variant_get(v, path, target)


def kind(v: Column) -> Column:
    """Source type of a VARIANT: OBJECT..., ARRAY..., STRING, BOOLEAN, VOID, or a number type."""
    return F.schema_of_variant(v)


def is_object(v: Column) -> Column:
    return F.coalesce(kind(v).startswith("OBJECT"), F.lit(False))


def json_objects(c: Column) -> Column:
    """the object elements of a JSON array text; empty for null, bad text or anything but an array."""
    elements = get(parse(c), "$", "array<variant>")
    return F.filter(F.coalesce(elements, F.expr("cast(array() as array<variant>)")), is_object)


def json_array(c: Column, fields: Mapping[str, str]) -> Column:
    """JSON array text to an array of structs with the given field types; other elements are skipped."""
    return F.transform(
        json_objects(c), lambda v: F.struct(*[get(v, f"$.{n}", t).alias(n) for n, t in fields.items()])
    )


def text_of(v: Column, path: str = "$") -> Column:
    return get(v, path, "string")


def truthy(v: Column, strict: bool = False) -> Column:
    """truth of a loose value.

    By default any non-empty text ("false" and "0" included), non-zero number, true, or non-empty container
    counts; ``strict`` accepts only true and 1.
    """
    def judged(t: Column) -> Column:
        if strict:
            number = F.when(~t.isin("STRING", "VOID", "BOOLEAN"), get(v, "$", "double") == 1)
            return F.when(t == "BOOLEAN", get(v, "$", "boolean")).otherwise(number)
        return (
            F.when(t == "BOOLEAN", get(v, "$", "boolean"))
            .when(t == "STRING", text_of(v) != "")
            .when(t == "VOID", False)
            .when(t.startswith("OBJECT"), F.size(get(v, "$", "map<string,variant>")) > 0)
            .when(t.startswith("ARRAY"), F.size(get(v, "$", "array<variant>")) > 0)
            .otherwise(get(v, "$", "double") != 0)
        )

    return F.coalesce(let(kind(v), judged), F.lit(False))


def loose_int(v: Column) -> Column:
    """whole number of a loose value: numbers lose their fraction, texts must be plain integers."""
    plain = lambda t: F.replace(F.regexp_replace(t, r"\s", ""), F.lit("_"), F.lit("")).try_cast("bigint")
    as_text = let(text_of(v), lambda t: F.when(t.rlike(r"^\s*[+-]?\d+(_\d+)*\s*$"), plain(t)))
    return let(kind(v), lambda k: F.when(k == "STRING", as_text).when(k != "VOID", get(v, "$", "bigint")))


def text_number(c: Column) -> Column:
    """Float literal in a text, null if it is none ("1d" is not, "1_000" and " 1e3 " are)."""
    plain = F.replace(F.regexp_replace(c, r"\s", ""), F.lit("_"), F.lit(""))
    return F.when(c.rlike(FLOAT_TEXT) | c.rlike(SPECIAL_FLOAT_TEXT), plain.try_cast("double"))


def loose_number(v: Column) -> Column:
    """Double of a loose value: numbers, booleans (1/0) and float literals; null for everything else."""
    return let(
        kind(v),
        lambda t: F.when(t == "STRING", let(text_of(v), text_number))
        .when(t == "BOOLEAN", get(v, "$", "boolean").cast("double"))
        .when(~(t.startswith("OBJECT") | t.startswith("ARRAY") | (t == "VOID")), get(v, "$", "double")),
    )


def numeric_features(c: Column) -> Column:
    """JSON object text to map<string,double>; id keys and non-numeric values are dropped, bad text
    gives an empty map."""
    bag = get(parse(c), "$", "map<string,variant>")
    numbers = F.transform_values(bag, lambda k, v: loose_number(v))
    kept = F.map_filter(numbers, lambda k, x: x.isNotNull() & ~k.isin(ID_KEYS))
    return F.coalesce(kept, F.expr("cast(map() as map<string,double>)"))


def numeric_map(c: Column) -> Column:
    """map<string,variant> to map<string,double> without the entries that are no numbers."""
    return F.map_filter(F.transform_values(c, lambda k, v: loose_number(v)), lambda k, x: x.isNotNull())
