"""Q1: where two datasets of nested rows differ.

Each row gets a tree of hashes that follows its structs.  Rows are matched by key with the trees alone; where roots differ the
trees are compared from the top and only branches that differ are opened: their values are fetched for those keys and the first
differing entry is looked up, through arrays, maps and structs, and named by its path.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from rankeval.functions.text import let
from rankeval.operators.quality import _full_outer
from rankeval.operators.ranges import join_on
from rankeval.sources.staging import stage

_JSON = {"ignoreNullFields": "false"}


def _canonical(c: Column, kind: T.DataType) -> Column:
    """The value with its maps as lists of entries in the order of their keys."""
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _canonical(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform(F.array_sort(F.map_keys(c)), lambda k: F.struct(k.alias("k"), _canonical(F.element_at(c, k), kind.valueType).alias("v")))
    if isinstance(kind, T.StructType) and len(kind):
        return F.when(c.isNotNull(), F.struct(*[_canonical(c.getField(f.name), f.dataType).alias(f.name) for f in kind]))
    return c


def _text(c: Column, kind: T.DataType) -> Column:
    return F.to_json(F.struct(_canonical(c, kind).alias("v")), _JSON)


def _hash(c: Column, kind: T.DataType) -> Column:
    """A hash that tells null from empty and a missing element from a null one."""
    return F.xxhash64(_text(c, kind))


def _tree(c: Column, kind: T.DataType) -> Column:
    """Struct of ``h`` and, for a struct, the trees of its fields; lists and maps with ``size`` and the hash of their keys."""
    if isinstance(kind, T.StructType) and len(kind):
        fields = F.struct(*[_tree(c.getField(f.name), f.dataType).alias(f.name) for f in kind])
        return let(fields, lambda t: F.struct(
            F.xxhash64(c.isNull(), *[t.getField(f.name).getField("h") for f in kind]).alias("h"), c.isNull().alias("none"),
            *[t.getField(f.name).alias(f"f_{f.name}") for f in kind]))
    size, keys = F.lit(None).cast("int"), F.lit(None).cast("long")
    if isinstance(kind, T.ArrayType):
        size = F.array_size(c)
    if isinstance(kind, T.MapType):
        size, keys = F.size(F.map_keys(c)), _hash(F.array_sort(F.map_keys(c)), T.ArrayType(kind.keyType))
    return F.struct(_hash(c, kind).alias("h"), c.isNull().alias("none"), size.alias("size"), keys.alias("keys"))


_BRANCH = "array<struct<branch:string,kind:string>>"


def _branches(l: Column, r: Column, kind: T.DataType, path: str) -> Column:
    """The branches below a node that differ, and how; none where the hashes agree."""
    one = lambda how: F.array(F.struct(F.lit(path).alias("branch"), how.alias("kind"))).cast(_BRANCH)
    missing = F.when(l.getField("none") != r.getField("none"), "missing")
    if isinstance(kind, T.StructType) and len(kind):
        below = F.concat(*[_branches(l.getField(f"f_{f.name}"), r.getField(f"f_{f.name}"), f.dataType, f"{path}.{f.name}".lstrip(".")) for f in kind])
        found = F.when(l.getField("none") != r.getField("none"), one(F.lit("missing"))).otherwise(below)
    else:
        differ = lambda name, how: F.when(~l.getField(name).eqNullSafe(r.getField(name)), how)
        found = one(F.coalesce(missing, differ("keys", "keys"), differ("size", "size"), F.lit("value")))
    return F.when(l.getField("h") != r.getField("h"), found).otherwise(F.expr(f"cast(array() as {_BRANCH})"))


_ENTRY = "struct<path:string,left_value:string,right_value:string>"


def _first(l: Column, r: Column, kind: T.DataType) -> Column:
    """Path below a value that differs, and both values there as JSON text."""
    here = F.struct(F.lit("").alias("path"), _text(l, kind).alias("left_value"), _text(r, kind).alias("right_value")).cast(_ENTRY)

    def below(step: Column, x: Column, y: Column, inner: T.DataType) -> Column:
        return let(_first(x, y, inner), lambda e: F.struct(F.concat(step, e.getField("path")).alias("path"), e.getField("left_value"), e.getField("right_value")).cast(_ENTRY))

    def within(candidates: Column, at: Callable[[Column, Column], Column], name: Callable[[Column], Column], inner: T.DataType) -> Column:
        wrong = F.filter(candidates, lambda k: ~_hash(at(l, k), inner).eqNullSafe(_hash(at(r, k), inner)))
        return let(F.get(wrong, F.lit(0)), lambda k: F.when(k.isNotNull(), below(name(k), at(l, k), at(r, k), inner)))

    found = None
    if isinstance(kind, T.StructType) and len(kind):
        fields = [(f, l.getField(f.name), r.getField(f.name)) for f in kind]
        found = F.coalesce(*[F.when(_hash(x, f.dataType) != _hash(y, f.dataType), below(F.lit(f".{f.name}"), x, y, f.dataType)) for f, x, y in fields])
    elif isinstance(kind, T.ArrayType):
        places = F.sequence(F.lit(0), F.greatest(F.size(l), F.size(r), F.lit(1)) - 1)
        found = within(places, F.get, lambda i: F.concat(F.lit("["), i.cast("string"), F.lit("]")), kind.elementType)
        # a null at the end of the longer list
        longer = F.least(F.size(l), F.size(r)).cast("string")
        found = F.coalesce(found, F.when(F.size(l) != F.size(r), F.struct(F.concat(F.lit("["), longer, F.lit("]")), F.lit(None), F.lit(None)).cast(_ENTRY)))
    elif isinstance(kind, T.MapType):
        keys = F.array_sort(F.array_union(F.map_keys(l), F.map_keys(r)))
        found = within(keys, F.try_element_at, lambda k: F.concat(F.lit("{"), k.cast("string"), F.lit("}")), kind.valueType)
        alone = F.array_sort(F.concat(F.array_except(F.map_keys(l), F.map_keys(r)), F.array_except(F.map_keys(r), F.map_keys(l))))
        found = F.coalesce(found, F.when(F.size(alone) > 0, F.struct(F.concat(F.lit("{"), F.get(alone, F.lit(0)).cast("string"), F.lit("}")), F.lit(None), F.lit(None)).cast(_ENTRY)))
    if found is None:
        return here
    return F.when(l.isNull() | r.isNull(), here).otherwise(F.coalesce(found, here))


def _leaves(kind: T.DataType, path: str = "") -> list[tuple[str, T.DataType]]:
    """All branches that :func:`_branches` can name."""
    if not isinstance(kind, T.StructType) or not len(kind):
        return [(path, kind)]
    below = [x for f in kind for x in _leaves(f.dataType, f"{path}.{f.name}".lstrip("."))]
    return ([(path, kind)] if path else []) + below


def differences(left: DataFrame, right: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row per key of one side alone and per differing branch of a key of both: keys, ``side``, ``branch``, ``kind``, ``path``,
    ``left_value``, ``right_value``.

    ``branch`` is a column or a field of its structs; ``kind``: value, size (of a list), keys (of a map) or missing (null on one
    side); ``path`` leads from the branch to the first entry that differs.  Both sides must be unique by key (see
    :func:`~rankeval.operators.quality.last_by_key`) and have the same types; a null key matches a null key.
    """
    ks = list(keys)
    shape = T.StructType([left.schema[c] for c in columns])
    value = F.struct(*[F.col(f"`{c}`").alias(c) for c in columns])
    trees = lambda df, name: df.select(*ks, value.alias("_v")).select(*ks, _tree(F.col("_v"), shape).alias(name))
    joined = _full_outer(trees(left, "_l"), trees(right, "_r"), ks)
    l, r = F.col("_l"), F.col("_r")
    side = F.when(r.isNull(), "only_left").when(l.isNull(), "only_right").otherwise("both")
    unequal = joined.where(l.isNull() | r.isNull() | (l.getField("h") != r.getField("h"))).withColumn("side", side)
    found = F.when(F.col("side") == "both", _branches(l, r, shape, ""))
    rows = stage(unequal.select(*ks, "side", F.inline_outer(found)))
    both = rows.where("side = 'both'")
    need = both.select(*ks).distinct()
    # values of the keys that differ, and of no others
    for df, name in ((left, "_l"), (right, "_r")):
        both = join_on(both, join_on(df.select(*ks, value.alias(name)), need, ks, "left_semi"), ks)

    def at(root: str, path: str) -> Column:
        c = F.col(root)
        for step in path.split("."):
            c = c.getField(step)
        return c

    entry = F.lit(None).cast(_ENTRY)
    for path, kind in reversed(_leaves(shape)):
        entry = F.when(F.col("branch") == path, _first(at("_l", path), at("_r", path), kind)).otherwise(entry)
    opened = both.withColumn("_e", entry).select(*ks, "side", "branch", "kind", F.concat("branch", "_e.path").alias("path"), "_e.left_value", "_e.right_value")
    none = F.lit(None).cast("string")
    alone = rows.where("side <> 'both'").select(*ks, "side", "branch", "kind", none.alias("path"), none.alias("left_value"), none.alias("right_value"))
    return alone.unionByName(opened)


def difference_summary(found: DataFrame) -> DataFrame:
    """Q1: rows per side, branch and kind, with the smallest path."""
    return found.groupBy("side", "branch", "kind").agg(F.count("*").alias("rows"), F.min("path").alias("first_path"))
