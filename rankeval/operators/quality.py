"""Coverage, reconciliation of two datasets, fixture selection and golden checks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from rankeval.functions.loose import kind, text_of
from rankeval.functions.text import let
from rankeval.operators.ranges import exact_percentiles
from rankeval.sources.staging import small, stage


def feature_coverage(df: DataFrame, features: Sequence[str], digits: int | None = None) -> DataFrame:
    """Totals, non-null and non-zero counts, rates, mean, sample deviation, min, max and median."""
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])
    long = df.select(F.inline(pairs))
    v = F.col("value")
    stats = long.groupBy("feature").agg(
        F.count("*").alias("total"),
        F.count("value").alias("non_null"),
        # a null is not zero
        F.count_if(v.isNull() | (v != 0)).alias("non_zero"),
        F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("std"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
    )
    medians = exact_percentiles(long, "value", [0.5], ["feature"]).select("feature", F.get("percentiles", F.lit(0)).alias("median"))
    out = stats.join(medians, "feature", "left").withColumns(
        {
            "null_rate": 1 - F.col("non_null") / F.col("total"),
            "zero_rate": 1 - F.col("non_zero") / F.col("total"),
            "coverage_rate": F.col("non_zero") / F.col("total"),
        }
    )
    if digits is not None:
        doubles = [f.name for f in out.schema if isinstance(f.dataType, T.DoubleType)]
        out = out.withColumns({c: F.round(c, digits) for c in doubles})
    return out


def _present(c: Column) -> Column:
    """Entries (name, whether it holds anything) of a map<string,variant>; zero counts as something."""
    def filled(v: Column) -> Column:
        t = kind(v)
        empty = (t == "VOID") | ((t == "STRING") & (text_of(v) == "")) | text_of(v).isin("[]", "{}")
        return ~F.coalesce(empty, F.lit(True))

    return F.transform(F.map_entries(c), lambda e: F.struct(e.getField("key").alias("name"), filled(e.getField("value")).alias("filled")))


def _feature_entries(c: Column) -> Column:
    """As :func:`_present`, but 0, false and "0" count as empty too."""
    def filled(v: Column) -> Column:
        t = kind(v)
        zero = F.when(~t.isin("STRING", "VOID", "BOOLEAN") & ~t.startswith("OBJECT") & ~t.startswith("ARRAY"), F.try_variant_get(v, "$", "double") == 0)
        empty = (
            (t == "VOID") | ((t == "STRING") & text_of(v).isin("", "0")) | ((t == "BOOLEAN") & (text_of(v) == "false"))
            | text_of(v).isin("[]", "{}") | F.coalesce(zero, F.lit(False))
        )
        return ~F.coalesce(empty, F.lit(True))

    return F.transform(F.map_entries(c), lambda e: F.struct(e.getField("key").alias("name"), filled(e.getField("value")).alias("filled")))


def field_coverage(records: DataFrame, c: str = "json", group_features: str = "features", group_interests: str = "interests") -> DataFrame:
    """Per field of JSON records how many records have it and how many have something in it.

    Levels: ``record`` (top-level keys), ``features`` and ``interests`` (keys of those objects).  The share is
    over all records that parse.
    """
    bag = lambda v, path: F.try_variant_get(v, path, "map<string,variant>")
    parsed = records.select(F.try_parse_json(c).alias("v")).where(F.col("v").isNotNull())
    bags = parsed.select(
        bag(F.col("v"), "$").alias("r"), bag(F.col("v"), f"$.{group_features}").alias("f"), bag(F.col("v"), f"$.{group_interests}").alias("i")
    ).where(F.col("r").isNotNull())
    leveled = lambda name, entries: F.transform(
        entries, lambda e: F.struct(F.lit(name).alias("level"), e.getField("name").alias("field"), e.getField("filled").alias("filled"))
    )
    none = F.expr("cast(array() as array<struct<level:string,field:string,filled:boolean>>)")
    interest_keys = F.transform(F.map_keys("i"), lambda k: F.struct(k.alias("name"), F.lit(True).alias("filled")))
    # one extra entry per record carries the record count, so the records are read once
    everything = F.concat(
        F.array(F.struct(F.lit("all").alias("level"), F.lit("").alias("field"), F.lit(True).alias("filled"))),
        F.coalesce(leveled("record", _present(F.col("r"))), none),
        F.coalesce(leveled("features", _feature_entries(F.col("f"))), none),
        F.coalesce(leveled("interests", interest_keys), none),
    )
    counts = stage(
        bags.select(F.inline(everything)).groupBy("level", "field").agg(
            F.count("*").alias("present"), F.count_if("filled").alias("non_empty")
        )
    )
    total = counts.where("level = 'all'").select("present").scalar()
    return counts.where("level <> 'all'").withColumn("coverage_pct", F.col("non_empty") * 100.0 / total)


def last_by_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the last in the given order; combined on the map side."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)) if rest else F.count("*")
    return df.groupBy(*keys).agg(best.alias("_row")).select(*keys, *( ["_row.*"] if rest else []))


def key_match(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full outer match of two keyed datasets with ``side``: both, only_left, only_right."""
    ks = list(keys)
    l = left.select(*ks, F.lit(True).alias("_l"))
    r = right.select(*ks, F.lit(True).alias("_r"))
    side = F.when(F.col("_l") & F.col("_r"), "both").when(F.col("_l"), "only_left").otherwise("only_right")
    return _full_outer(l, r, ks).select(*ks, side.alias("side"))


def _full_outer(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full outer join in which a null key matches a null key."""
    named = right.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    joined = left.join(named, same, "full_outer")
    return joined.withColumns({k: F.coalesce(k, f"_k{i}") for i, k in enumerate(keys)}).drop(
        *[f"_k{i}" for i in range(len(keys))]
    )


def comparable(df: DataFrame, c: str) -> Column:
    """A value that can be tested for equality: maps and variants as JSON text, maps with their keys in order."""
    kind = df.schema[c].dataType
    if isinstance(kind, T.MapType):
        entries = F.transform(F.array_sort(F.map_keys(c)), lambda k: F.struct(k.alias("k"), F.element_at(c, k).alias("v")))
        return F.when(F.col(c).isNotNull(), F.to_json(F.struct(entries.alias("m"))))
    if "map<" in kind.simpleString() or "variant" in kind.simpleString():
        return F.when(F.col(c).isNotNull(), F.to_json(F.struct(F.col(c).alias("m"))))
    return F.col(c)


_PLAIN = (T.StringType, T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_RAW = 64  # characters of a text that is compared as it is


def _equal_as_text(kind: T.DataType) -> bool:
    """Values of the type are equal just where their JSON texts are."""
    if isinstance(kind, T.StructType):
        return all(_equal_as_text(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _equal_as_text(kind.elementType)
    return isinstance(kind, _PLAIN) and (not isinstance(kind, T.StringType) or kind == T.StringType())  # no collation


def fingerprint(df: DataFrame, c: str) -> Column:
    """:func:`comparable`, with texts above ``_RAW`` characters, and nested values of (valid) texts, whole numbers and truth values, as the
    SHA-256 of all their content: what is staged or shuffled does not grow with the values.  No text that is left as it is has the
    length of a fingerprint.  Values of other types stay whole."""
    value, of = comparable(df, c), df.schema[c].dataType
    if isinstance(of, (T.StructType, T.ArrayType)) and _equal_as_text(of):
        value = F.when(F.col(c).isNotNull(), F.to_json(F.struct(F.col(c).alias("m")), {"ignoreNullFields": "false"}))
    elif df.select(value.alias("v")).schema["v"].dataType != T.StringType():
        return value
    return let(value, lambda t: F.when(F.length(t) > _RAW, F.concat(F.lit("#"), F.sha2(t, 256))).otherwise(t))


def fingerprinted(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """``df`` with the values of ``fields`` replaced by what :func:`reconcile` compares of them, for rows that are costly to make and
    large to keep."""
    return df.withColumns({f: fingerprint(df, f) for f in fields})


def reconcile(left: DataFrame, right: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Full outer match with a null-safe equality flag per field (null where a side is missing).

    Both sides must be unique by key (see :func:`last_by_key`).
    """
    ks = list(keys)
    stored = lambda df, f: df.schema[f].dataType.simpleString()
    of = {f: fingerprint if stored(left, f) == stored(right, f) else comparable for f in fields}
    l = left.select(*ks, F.struct(*fields).alias("_l"), F.struct(*[of[f](left, f).alias(f) for f in fields]).alias("_cl"))
    r = right.select(*ks, F.struct(*fields).alias("_r"), F.struct(*[of[f](right, f).alias(f) for f in fields]).alias("_cr"))
    both = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    side = F.when(both, "both").when(F.col("_r").isNull(), "only_left").otherwise("only_right")
    joined = _full_outer(l, r, ks).withColumn("side", side)
    return joined.select(
        *ks, "side",
        *[F.when(both, F.col(f"_cl.{f}").eqNullSafe(F.col(f"_cr.{f}"))).alias(f"same_{f}") for f in fields],
        *[F.col(f"_l.{f}").alias(f"left_{f}") for f in fields],
        *[F.col(f"_r.{f}").alias(f"right_{f}") for f in fields],
    )


def reconcile_summary(matched: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Q1: keys per side and mismatches per field."""
    return matched.agg(
        F.count_if(F.col("side") == "both").alias("both"),
        F.count_if(F.col("side") == "only_left").alias("only_left"),
        F.count_if(F.col("side") == "only_right").alias("only_right"),
        *[F.count_if(~F.col(f"same_{f}")).alias(f"diff_{f}") for f in fields],
    )


def mismatch_examples(matched: DataFrame, fields: Sequence[str], keys: Sequence[str], n: int = 3) -> DataFrame:
    """Q1: the first ``n`` differing keys per field with both values as text."""
    cells = F.array(
        *[
            F.struct(
                F.lit(f).alias("field"), F.col(f"same_{f}").alias("same"),
                F.to_json(F.struct(F.col(f"left_{f}").alias("v"))).alias("left_value"),
                F.to_json(F.struct(F.col(f"right_{f}").alias("v"))).alias("right_value"),
            )
            for f in fields
        ]
    )
    long = matched.where("side = 'both'").select(*keys, F.inline(cells)).where("not same").drop("same")
    w = W.partitionBy("field").orderBy(*keys)
    return long.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def key_sets(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sizes of the union, intersection and both differences of two key sets."""
    ks = list(keys)
    sides = key_match(left.select(*ks).distinct(), right.select(*ks).distinct(), ks)
    counts = sides.agg(
        F.count("*").alias("union"), F.count_if(F.col("side") == "both").alias("intersection"),
        F.count_if(F.col("side") == "only_left").alias("only_left"), F.count_if(F.col("side") == "only_right").alias("only_right"),
    )
    names = ("union", "intersection", "only_left", "only_right")
    return counts.select(F.inline(F.array(*[F.struct(F.lit(n).alias("set"), F.col(n).alias("keys")) for n in names])))


def user_counts(left: DataFrame, right: DataFrame, user: str = "user_id") -> DataFrame:
    """Users on both sides by how their row counts compare, and users on one side only."""
    l = left.groupBy(user).agg(F.count("*").alias("_l"))
    r = right.groupBy(user).agg(F.count("*").alias("_r"))
    a, b = F.col("_l"), F.col("_r")
    kind_ = (
        F.when(b.isNull(), "only_left").when(a.isNull(), "only_right").when(a == b, "equal").when(a > b, "left_more").otherwise("right_more")
    )
    return _full_outer(l, r, [user]).groupBy(kind_.alias("outcome")).agg(F.count("*").alias("users"))


def empty_share(df: DataFrame, empty: Column) -> DataFrame:
    """Q2: rows for which ``empty`` holds and their percentage."""
    return df.agg(
        F.count("*").alias("rows"), F.count_if(empty).alias("empty"),
        (F.count_if(empty) * 100.0 / F.greatest(F.lit(1), F.count("*"))).alias("empty_pct"),
    )


def user_profile(df: DataFrame, has_history: Column, has_features: Column, has_conversations: Column, user: str = "user_id") -> DataFrame:
    """Q4: rows per user and whether any of them has history, features, conversations."""
    return df.groupBy(user).agg(
        F.count("*").alias("samples"), F.bool_or(has_history).alias("has_history"),
        F.bool_or(has_features).alias("has_features"), F.bool_or(has_conversations).alias("has_conversations"),
    )


def pick_users(profiles: DataFrame, user: str = "user_id") -> DataFrame:
    """One user per profile: with history and features, without history, with the most samples.

    Within a profile the user with most samples wins, then the smallest id.
    """
    profile = F.array_compact(
        F.array(
            F.when(F.col("has_history") & F.col("has_features"), "history_and_features"),
            F.when(~F.col("has_history"), "no_history"),
            F.lit("most_samples"),
        )
    )
    w = W.partitionBy("profile").orderBy(F.desc("samples"), user)
    ranked = profiles.withColumn("profile", F.explode(profile)).withColumn("_r", F.row_number().over(w))
    return ranked.where("_r <= 1").select("profile", user, "samples")


def preview(df: DataFrame, order: Sequence[str], label: str = "label") -> DataFrame:
    """The first row and the first positive row in a given order."""
    first = df.orderBy(*order).limit(1).withColumn("which", F.lit("first"))
    positive = df.where(F.col(label) == 1).orderBy(*order).limit(1).withColumn("which", F.lit("first_positive"))
    return first.unionByName(positive)


def first_per_label(df: DataFrame, n: int, order: Sequence[str], label: str = "label") -> DataFrame:
    """The first n rows of each label; trimmed per input partition before the shuffle."""
    w = W.partitionBy(label).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def pick_fixture_pair(
    df: DataFrame, rich: Column, order: Sequence[str], user: str = "user_id", label: str = "label",
    pinned_user: str | None = None,
) -> DataFrame:
    """Two rich rows of one user, a positive and a negative one if some user has both.

    The pinned user is taken if eligible; else the first user with both labels; else the first with two rows
    (its first two rows).
    """
    rows = stage(df.where(rich))  # read for the users and again for the fallback
    y = F.col(label) == 1
    key = F.struct(*order)
    packed = F.struct(*df.columns)
    per_user = rows.groupBy(user).agg(
        F.count("*").alias("_n"),
        F.min_by(packed, F.when(y, key)).alias("_pos"),
        F.min_by(packed, F.when(~y, key)).alias("_neg"),
        F.count_if(y).alias("_p"),
        F.min(key).alias("_first_key"),
    ).where("_n >= 2")
    split = (F.col("_p") > 0) & (F.col("_p") < F.col("_n"))
    pinned = F.coalesce(F.col(user) == F.lit(pinned_user), F.lit(False)) & split if pinned_user is not None else F.lit(False)
    best = stage(per_user.orderBy(F.desc(pinned), F.desc(split), "_first_key").limit(1))
    both = best.where(split).select(F.inline(F.array("_pos", "_neg")))
    only = best.where(~split).select(F.col(user).alias("_u"))
    fallback = rows.join(F.broadcast(only), F.col(user).eqNullSafe(F.col("_u"))).drop("_u").orderBy(*order).limit(2)
    return both.unionByName(fallback)


def calibrate(calls: DataFrame, case: str = "case", score: str = "score", min_tolerance: float = 5e-3, slack: float = 2e-2) -> DataFrame:
    """Observed range, mean, distinct scores and the tolerance max(min_tolerance, range + slack) per case.

    Scores are probabilities, so a case has at most a million distinct scores at six decimals.
    """
    s = F.col(score)
    return calls.groupBy(case).agg(
        F.count("*").alias("n"), F.min(s).alias("score_min"), F.max(s).alias("score_max"), F.avg(s).alias("score_mean"),
        F.sort_array(F.collect_set(F.round(s, 6))).alias("unique_scores"),
        F.greatest(F.lit(min_tolerance), F.max(s) - F.min(s) + slack).alias("tolerance"),
    )


def verify(calls: DataFrame, calibration: DataFrame, case: str = "case", score: str = "score") -> DataFrame:
    """Per case how far new scores lie from the calibrated mean and whether all are within tolerance."""
    joined = calls.join(small(calibration.select(case, "score_mean", "tolerance")), case)
    diff = F.abs(F.col(score) - F.col("score_mean"))
    return joined.groupBy(case).agg(
        F.count("*").alias("n"), F.max(diff).alias("max_diff"), F.max("tolerance").alias("tolerance"),
        F.bool_and(diff <= F.col("tolerance")).alias("ok"),
    )


def output_summary(spark: SparkSession, path: str, by: str = "output", fmt: str = "parquet") -> DataFrame:
    """Q5: rows, files and bytes per written split."""
    rows = spark.read.format(fmt).load(path).select(by, "_metadata.file_path", "_metadata.file_size")
    files = rows.groupBy(by, "file_path").agg(F.count("*").alias("rows"), F.max("file_size").alias("bytes"))
    return files.groupBy(by).agg(F.sum("rows").alias("rows"), F.count("*").alias("files"), F.sum("bytes").alias("bytes"))


def build_test_set(df: DataFrame, order: Sequence[str], title: str = "title", body: str = "body", min_words: int = 3, n: int = 10_000) -> DataFrame:
    """Q8: titles of at least ``min_words`` words, the first row of each title, the first ``n`` of those."""
    words = F.regexp_count(F.col(title), F.lit(r"\S+"))
    kept = df.where(words >= min_words)
    key = F.struct(*order)
    first = kept.groupBy(title).agg(F.min_by(body, key).alias(body), F.min(key).alias("_k"))
    return first.orderBy("_k").limit(n).select(title, body)

