"""Deterministic sampling, splits and negative mining.

Every choice is a function of an md5 hash of the seed and the row keys, so it does not depend on
partitioning, on retries or on the engine that runs it.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from rankeval.operators.ranges import ordered_index, table_index
from rankeval.operators.selection import first_by_content
from rankeval.sources.staging import discard, release, stage, written

_SLOT_ROWS = 100_000  # rows that are ordered to find a cut
_POOL_ROWS = 250_000  # rows of a pool that a task holds to look them up
_TILE_PAIRS = 1 << 19  # pairs that a tile of the ring makes, about
_TILE_ROWS = 1 << 20  # rows that a task sorts by their tiles


def hash_hex(seed: int, *keys: Column | str) -> Column:
    """md5 of ``seed|key|key...`` as 32 hex digits."""
    parts = [F.lit(str(seed))]
    parts += [F.coalesce((F.col(k) if isinstance(k, str) else k).cast("string"), F.lit("")) for k in keys]
    return F.md5(F.concat_ws("|", *parts))


def stable_hash(seed: int, *keys: Column | str) -> Column:
    """60-bit non-negative number from :func:`hash_hex`."""
    return F.conv(F.substring(hash_hex(seed, *keys), 1, 15), 16, 10).cast("bigint")


def percent_of(seed: int, *keys: Column | str) -> Column:
    """Number 0..99 from the first eight hex digits of the hash."""
    return F.conv(F.substring(hash_hex(seed, *keys), 1, 8), 16, 10).cast("bigint") % 100


def split_by(df: DataFrame, key: str, test_pct: int = 20, seed: int = 42, name: str = "split") -> DataFrame:
    """All rows of a key fall on the same side; no join, no shuffle."""
    return df.withColumn(name, F.when(percent_of(seed, key) < test_pct, "test").otherwise("train"))


def holdout(df: DataFrame, keys: Sequence[str], pct: int = 10, seed: int = 0, name: str = "is_holdout") -> DataFrame:
    """Hash flag for an early-stopping hold-out."""
    return df.withColumn(name, percent_of(seed, *keys) < pct)


def _smallest_by_hash(df: DataFrame, keys: Sequence[str], seed: int, keep: int) -> DataFrame:
    """The ``keep`` rows with the smallest hash of their keys; rows that share the last key are taken by their content.

    The last hash is found by counting rows per slot of the hash, then per slot of the slot that holds the cut, until that
    one has at most ``_SLOT_ROWS`` rows or a single hash; only those are ordered.
    """
    if keep <= 0:
        return df.limit(0)
    rows = stage(df.select(hash_hex(seed, *keys).alias("_h")))
    left, width = keep, 0
    while True:
        width += 3
        counts = rows.groupBy(F.substring("_h", 1, width).alias("s")).count().orderBy("s").collect()  # at most 4096
        for r in counts:
            if left <= r["count"]:
                break
            left -= r["count"]
        else:
            return df  # all fit
        rows = rows.where(F.col("_h").startswith(r["s"]))
        if r["count"] <= _SLOT_ROWS or width >= 32:
            break
    cut = rows.orderBy("_h").limit(left).agg(F.max("_h")).first()[0]
    before, alike = rows.agg(F.count_if(F.col("_h") < cut), F.count_if(F.col("_h") == cut)).first()
    hashed = df.withColumn("_h", hash_hex(seed, *keys))
    if before + alike == left:
        return hashed.where(F.col("_h") <= cut).drop("_h")
    some = first_by_content(hashed.where(F.col("_h") == cut).drop("_h"), left - before)
    return hashed.where(F.col("_h") < cut).drop("_h").unionByName(some)


def sample_n(df: DataFrame, n: int, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """``n`` rows chosen by hash order."""
    return _smallest_by_hash(df, keys, seed, n)


def downsample_negatives(
    df: DataFrame, keys: Sequence[str], ratio: float = 0.0, frac: float = 0.0, seed: int = 42, label: str = "label"
) -> DataFrame:
    """All positives with ``round(ratio * positives)`` negatives, then the fraction of those left.

    Rounding is half to even.  0 (or a fraction outside (0, 1)) leaves a step out.
    """
    pos, neg = df.where(F.col(label) == 1), df.where(F.col(label) == 0)
    if ratio and ratio > 0:
        keep = pos.agg(F.bround(F.count("*") * F.lit(float(ratio)), 0).cast("bigint")).first()[0]
        neg = _smallest_by_hash(neg, keys, seed + 1, keep)
    if frac and 0 < frac < 1:
        neg = stage(neg)  # read by three passes
        keep = neg.agg(F.bround(F.count("*") * F.lit(float(frac)), 0).cast("bigint")).first()[0]
        neg = _smallest_by_hash(neg, keys, seed + 2, keep)
    return pos.unionByName(neg)


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Weight of each class, ``total / (2 * class size)``, both 1 when a class is absent; and neg/pos."""
    pos, neg = F.col("pos"), F.col("neg")
    counts = df.agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
    )
    both = (pos > 0) & (neg > 0)
    return counts.select(
        "pos",
        "neg",
        F.when(both, (pos + neg) / (2.0 * pos)).otherwise(1.0).alias("weight_pos"),
        F.when(both, (pos + neg) / (2.0 * neg)).otherwise(1.0).alias("weight_neg"),
        (F.greatest(F.lit(1), neg) / F.greatest(F.lit(1), pos)).alias("scale_pos_weight"),
    )


def random_scores(row_key: Sequence[str], seeds: int = 5) -> list[Column]:
    """Hash scores of a row, one per seed."""
    return [stable_hash(42, F.lit(i), *row_key).cast("double") for i in range(seeds)]


def random_score(df: DataFrame, row_key: Sequence[str], seeds: int = 5) -> DataFrame:
    """Every row once per seed with a hash score."""
    scores = F.array(*random_scores(row_key, seeds))
    return df.select("*", F.posexplode(scores).alias("seed", "random_score"))


def _fetched(wanted: DataFrame, pool: DataFrame, total: int) -> DataFrame:
    """``wanted`` with the pool's row of its ``_idx``, a number that the pool has once.

    Both sides are dealt by the number to as many tasks as keep a task's part of the pool at ``_POOL_ROWS`` rows, so that part is
    looked up in memory and the far larger side is never sorted.
    """
    default = int(wanted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(default, -(-total // _POOL_ROWS))
    return wanted.repartition(parts, "_idx").join(pool.repartition(parts, "_idx").hint("shuffle_hash"), "_idx")


def _tile(need: Column | int, at: Column, total: int, width: int) -> Column:
    """The tile of a place on a ring of ``total``: the ring is cut into ``need`` equal stretches, and the places that lie ``width`` by
    ``width`` behind their beginnings make a tile together."""
    n = F.lit(need).cast("bigint") if isinstance(need, int) else need
    stretch = F.floor(F.lit(total) / n)
    behind = at - F.least(F.floor(at / stretch), n - 1) * stretch
    tiles = F.greatest(F.lit(1), F.floor(stretch / width))
    return (n * F.lit(1 << 40) + F.least(F.floor(behind / width), tiles - 1)).cast("bigint")


def _fetched_by_tiles(placed: DataFrame, ring: DataFrame, feed: str, items: Sequence[str], total: int, needs: Sequence[int], width: int) -> DataFrame:
    """The cross-feed pairs of anchors that want ``needs`` rows each.  Those lie nearly evenly on the ring: anchors with the same number
    whose first wanted rows are near want rows near each other all the way round.  Anchors and the ring's rows are dealt to tiles, an
    anchor once, a row once (at an edge twice) for each number wanted, so pairs are made where they meet and never travel.

    The j-th wanted place of an anchor is off its first place plus j stretches by less than the feed's clicks and twice the wanted
    number; rows are dealt that far (``width // 16``) beyond the edges of their tile.
    """
    names = [feed, *items]
    first = F.pmod(F.col("_base") + F.col("_t0"), F.lit(total))
    anchors = placed.select(_tile(F.col("_need"), first, total, width).alias("_tile"), "_base", "_t0", "_others", *names)
    edge = width // 16
    near = lambda n: F.array_distinct(F.array(*[_tile(n, F.pmod(F.col("_idx") + d, F.lit(total)), total, width) for d in (-edge, 0, edge)]))
    rows = ring.select(F.explode(F.flatten(F.array(*[near(n) for n in needs]))).alias("_tile"), "_idx", *names)
    default = int(ring.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(default, -(-total * (len(needs) + 1) // _TILE_ROWS))
    kinds = {c: ring.schema[c].dataType.simpleString() for c in names}
    named = [("anchor_feed", feed), *[(f"anchor_{c}", c) for c in items]]
    found = [("neg_feed", feed), *[(f"neg_{c}", c) for c in items]]
    schema = ", ".join([*[f"`{to}` {kinds[c]}" for to, c in named], "source string", *[f"`{to}` {kinds[c]}" for to, c in found]])

    def pairs(a: pa.Table, b: pa.Table) -> pa.Table:
        base, t0, others, tile = (a.column(c).to_numpy() for c in ("_base", "_t0", "_others", "_tile"))
        need = int(tile[0] >> 40) if len(tile) else 0
        step = others // max(need, 1)
        wanted = (base[:, None] + (t0[:, None] + np.arange(need) * step[:, None]) % others[:, None]) % total
        held = b.column("_idx").to_numpy()
        order = np.argsort(held)
        at = order[np.minimum(np.searchsorted(held, wanted.ravel(), sorter=order), len(held) - 1)] if len(held) else np.zeros(0, int)
        if wanted.size and not (len(held) and (held[at] == wanted.ravel()).all()):
            raise AssertionError("a wanted row lies outside its tile")
        mine, theirs = pa.array(np.repeat(np.arange(len(tile)), need)), pa.array(at[: wanted.size])
        left = [a.column(c).combine_chunks().take(mine) for _, c in named]
        right = [b.column(c).combine_chunks().take(theirs) for _, c in found]
        source = pa.array(["cross_feed"], pa.string()).take(pa.array(np.zeros(wanted.size, np.int64)))
        return pa.Table.from_arrays([*left, source, *right], [*[to for to, _ in named], "source", *[to for to, _ in found]])

    dealt = lambda df: df.repartition(parts, "_tile").groupBy("_tile")
    return dealt(anchors).cogroup(dealt(rows)).applyInArrow(pairs, schema)


def mine_negatives(
    df: DataFrame, feed: str, item_cols: Sequence[str], label: str = "label", k: int = 20, seed: int = 42,
    cross_feed: bool = True,
) -> DataFrame:
    """Per clicked row up to ``k`` negatives: first non-clicked rows of the same feed, then clicked
    rows of other feeds.

    Both steps walk a ring.  Candidates are numbered once (in their feed by hash; globally by feed hash, so
    that a feed's clicks form one block), each anchor computes at most ``k`` numbers spread evenly from a
    hashed start, and an equi-join on the number fetches them: work is linear in ``anchors * k`` whatever the
    feed sizes, and exactly ``min(k, available)`` distinct negatives come back.

    ``item_cols`` identify a row inside its feed.  Output: anchor_feed, anchor_<item>..., source
    ('in_session' or 'cross_feed'), neg_feed, neg_<item>...
    """
    items = list(item_cols)
    rows = written(df.select(feed, *items, label), "rows")
    release(df.sparkSession)  # what making the rows has shuffled
    anchors = rows.where(F.col(label) == 1).drop(label)
    anchors = anchors.withColumn("_start", stable_hash(seed, feed, *items))
    others = rows.where(F.col(label) == 0).drop(label).withColumn("_h", stable_hash(seed + 1, feed, *items))
    # numbered once; the numbers tell the sizes
    numbered = written(ordered_index(others, [feed], ["_h", *items], "_idx").select(feed, *items, "_idx"), "numbered")
    sizes = numbered.groupBy(feed).agg((F.max("_idx") + 1).alias("_m"))

    def spread(m: Column, need: Column) -> Column:
        """``least(need, m)`` distinct numbers below ``m``: start + j * floor(m / need), modulo m."""
        step = F.greatest(F.lit(1), F.floor(m / need)).cast("bigint")
        count = F.least(need, m).cast("int")
        return F.when(count > 0, F.transform(
            F.sequence(F.lit(0), count - 1), lambda j: F.pmod(F.col("_start") + j * step, m)
        ))

    sized = written(anchors.join(sizes, feed, "left").withColumn("_m", F.coalesce("_m", F.lit(0))), "anchors")
    got = numbered.select(feed, "_idx", *[F.col(c).alias(f"neg_{c}") for c in items])
    named = [F.col(feed).alias("anchor_feed"), *[F.col(c).alias(f"anchor_{c}") for c in items]]
    negs = [f"neg_{c}" for c in items]
    own = [*named, F.lit("in_session").alias("source"), F.col(feed).alias("neg_feed"), *negs]
    # a feed with at most k others gives an anchor all of them: no numbers are needed
    session = sized.where((F.col("_m") > 0) & (F.col("_m") <= k)).join(got, feed).select(*own)
    large = numbered.where(F.col("_idx") == k).select(feed)  # feeds with more, each once
    if not large.isEmpty():
        in_feed = sized.where(F.col("_m") > k).withColumn("_idx", F.explode(spread(F.col("_m"), F.lit(k))))
        session = session.unionByName(in_feed.join(got.join(large, feed, "left_semi"), [feed, "_idx"]).select(*own))
    if not cross_feed:
        return session

    ring = anchors.select(feed, *items).withColumn("_fh", F.unhex(hash_hex(seed, feed))).withColumn(
        "_h", stable_hash(seed + 2, feed, *items)
    )
    ring = table_index(ring, ["_fh", feed, "_h", *items], "_idx", [feed, *items])
    blocks = ring.groupBy(feed).agg(F.min("_idx").alias("_from"), F.count("*").alias("_size"))
    total = anchors.count()
    short = sized.where(F.col("_m") < k).withColumn("_need", (F.lit(k) - F.col("_m")).cast("bigint"))
    placed = short.join(blocks, feed).withColumn("_total", F.lit(total))
    placed = placed.withColumn("_others", F.col("_total") - F.col("_size")).where("_others > 0")
    discard(rows)
    width = max(512, _TILE_PAIRS // (k * k))
    if total > max(_POOL_ROWS, 4 * k * width):
        placed = placed.withColumn("_base", F.pmod(F.col("_from") + F.col("_size"), "_total"))
        placed = written(placed.withColumn("_t0", F.pmod("_start", "_others")).drop("_m"), "placed")
        release(df.sparkSession)
        # anchors go by tiles where that deals fewer rows; those of feeds with many clicks, whose wanted rows are spaced otherwise, by number
        few = F.col("_size") + 2 * k <= width // 16
        counts = placed.where(few).groupBy("_need").count().collect()  # at most k
        needs = [r["_need"] for r in counts if r["count"] * r["_need"] > 1.25 * total]
        by_tiles = few & F.col("_need").isin(needs)
        if needs:
            tiled = _fetched_by_tiles(placed.where(by_tiles), ring, feed, items, total, needs, width)
            session = session.unionByName(tiled.select(*[c.name for c in session.schema]))
        placed = placed.where(~by_tiles)
        if placed.isEmpty():
            return session
    wanted = placed.withColumn("_t", F.explode(spread(F.col("_others"), F.col("_need"))))
    wanted = wanted.withColumn("_idx", F.pmod(F.col("_from") + F.col("_size") + F.col("_t"), F.col("_total")))
    wanted = wanted.select("_idx", *named, F.lit("cross_feed").alias("source"))
    pool = ring.select("_idx", F.col(feed).alias("neg_feed"), *[F.col(c).alias(f"neg_{c}") for c in items])
    cross = _fetched(wanted, pool, total)
    return session.unionByName(cross.select(*[c.name for c in session.schema]))


def mining_stats(pairs: DataFrame, anchor_cols: Sequence[str]) -> DataFrame:
    """Anchors with a negative, negatives per anchor, totals by source."""
    per_anchor = pairs.groupBy(*anchor_cols).agg(
        F.count("*").alias("_n"),
        F.count_if(F.col("source") == "in_session").alias("_in"),
        F.count_if(F.col("source") == "cross_feed").alias("_cross"),
    )
    return per_anchor.agg(
        F.count("*").alias("anchors"),
        F.avg("_n").alias("avg_negatives"),
        F.coalesce(F.sum("_in"), F.lit(0)).alias("in_session"),
        F.coalesce(F.sum("_cross"), F.lit(0)).alias("cross_feed"),
    )
