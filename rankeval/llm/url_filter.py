"""Exact URL rules through a cascade of Bloom filters (operator 8).  DataFrame functions only.

The first level encodes the listed keys.  Every key that can be asked - all host suffixes and path prefixes of the corpus
that have the length of a listed one - is run against it; the false positives among them are encoded in the second level,
the listed keys that pass the second in the third, and so on until a level lets no wrong key pass.  A key's answer is the
parity of the levels it passes: exact for all keys of the corpus and the list, with no join.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

MAX_BITS = 1 << 24  # of a level; the levels are literals of the plan

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or for null."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _split(rule: str) -> tuple[str, str]:
    at = rule.index("/")
    return rule[:at], rule[at:]


def keys(host_col: Column, path_col: Column, rules: Sequence[str]) -> Column:
    """The keys that a page asks for: its host suffixes with as many labels as a rule has, each with its path prefixes as
    long as a rule's.  A few per page, however long host and path are."""
    shapes = sorted({(h.count(".") + 1, len(p)) for h, p in map(_split, rules)})
    labels = F.length(host_col) - F.length(F.translate(host_col, ".", "")) + 1
    asked = [
        F.when((labels >= n) & (F.length(path_col) >= k), F.concat(F.substring_index(host_col, ".", -n), F.substring(path_col, 1, k)))
        for n, k in shapes
    ]
    return F.array_compact(F.array(*asked)) if asked else F.array().cast("array<string>")


class Level:
    """A Bloom filter as 63-bit words in an array literal."""

    def __init__(self, listed: DataFrame, column: str, n: int, rate: float, seed: int):
        self.m = max(63, math.ceil(-n * math.log(rate) / math.log(2) ** 2))
        if self.m > MAX_BITS:
            raise ValueError(f"a level of {self.m} bits; split the list")
        self.k, self.seed = max(1, round(self.m / n * math.log(2))), seed
        at = listed.select(F.explode(F.array(*self._places(F.col(column)))).alias("at"))
        words = at.groupBy(F.expr("at div 63").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 63 as int))")).alias("bits"))
        bits = [0] * (self.m // 63 + 1)
        for r in words.collect():  # at most MAX_BITS / 63
            bits[r["w"]] = r["bits"]
        self.words = ",".join(map(str, bits))

    def _places(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(key, F.lit(self.seed * 64 + i)), F.lit(self.m)) for i in range(self.k)]

    def passes(self, key: Column) -> Column:
        words = F.split(F.lit(self.words), ",").cast("array<bigint>")  # folded once
        tests = [F.getbit(F.get(words, (p / 63).cast("int")), (p % 63).cast("int")) == 1 for p in self._places(key)]
        return reduce(Column.__and__, tests)


class Cascade:
    """Exact membership in ``listed`` for every key of ``universe`` (DataFrames with one column ``key``)."""

    def __init__(self, listed: DataFrame, universe: DataFrame, rate: float = 1 / 1024, next_rate: float = 0.5):
        inside, outside = listed.where("key is not null").distinct(), universe.where("key is not null")
        self.levels: list[Level] = []
        n = inside.count()
        while n:
            level = Level(inside, "key", n, rate if not self.levels else next_rate, len(self.levels))
            self.levels.append(level)
            wrong = outside.where(level.passes(F.col("key"))).distinct()
            if len(self.levels) == 1:
                wrong = wrong.join(inside, "key", "left_anti")  # of what passed; the build's only join
            # few keys: written down once, so that later levels do not read the corpus again
            wrong = wrong.checkpoint() if wrong.sparkSession.sparkContext.getCheckpointDir() else wrong.cache()
            inside, outside = wrong, inside
            n = inside.count()

    def contains(self, key: Column) -> Column:
        member = F.lit(False)
        for depth in range(len(self.levels), 0, -1):
            member = F.when(self.levels[depth - 1].passes(key), F.lit(True) if depth == len(self.levels) else ~member).otherwise(False)
        return F.coalesce(member, F.lit(False))


def _table(spark: SparkSession, values: Sequence[str]) -> DataFrame:
    schema = T.StructType([T.StructField("key", T.StringType())])
    return spark.createDataFrame([(v,) for v in values], schema)


def judge(pages: DataFrame, allow: Sequence[str], block: Sequence[str], default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule`` and ``verdict`` of every row.

    Rules are ``host/path``; one fits its host and all subdomains where the path starts with its path, and the longest
    decides (of equally long ones, that with the longer host; a rule in both lists blocks).  A page that no rule fits is
    on no list and gets ``default``.  A null url, one without ``://`` or with an empty path fits none; repeated rows are
    judged alike.
    """
    spark, rules = pages.sparkSession, [*allow, *block]
    parsed = pages.select(F.col(id_col).alias("page_id"), host(F.col(url_col)).alias("host"), path(F.col(url_col)).alias("path"))
    parsed = parsed.withColumn("asked", keys(F.col("host"), F.col("path"), rules))
    universe = parsed.select(F.explode("asked").alias("key")).unionByName(_table(spark, rules))
    blocked = Cascade(_table(spark, block), universe)
    allowed = Cascade(_table(spark, allow), universe)
    verdict = lambda k: F.when(blocked.contains(k), F.lit("block")).when(allowed.contains(k), F.lit("allow"))
    fits = F.transform("asked", lambda k: F.struct(F.length(k).alias("n"), F.instr(k, "/").alias("h"), k.alias("rule"), verdict(k).alias("verdict")))
    best = F.array_max(F.filter(fits, lambda x: x["verdict"].isNotNull()))
    judged = parsed.withColumn("best", best)
    return judged.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
