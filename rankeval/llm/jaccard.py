"""Exact n-gram Jaccard join in size-banded tiles with bitmap signatures (operator 3).

1. Equal shingle sets become one node.  A node's key list is its prefix: sets that overlap enough share a key of their
   prefixes, whatever the order of keys, so the order takes frequent shingles last.
2. Nodes that share a key are sorted by how common their shingles are; each is compared with the first, which is the least
   altered of a group of copies, and with its predecessor.  Bitmaps (parity of hashed bits, at least twice as many bits as
   the set has elements) bound an overlap from above; pairs that pass are verified on the sorted arrays.  Groups of near
   copies fall into one component here, in linear work.
3. Keys whose nodes still lie in different components are compared in full: in tiles of one key and size band, the
   minority's nodes visit all tiles whose sizes can match.  Bitmaps come first again, then the arrays.

No pair that could be a link is left out: two linked sets share a key and are either in one component or meet in a tile.
Equality of shingles is equality of 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from rankeval.llm.arrow_rows import fresh, mapped, slices
from rankeval.llm.components import labels
from rankeval.llm.shingles import Shingles, mix, shingles
from rankeval.sources.staging import release, stage, written

FREQUENT = 8  # a shingle in so many documents is taken last
LOW = np.uint64(1 << 62)  # shingles are counted below this hash, a quarter: longer than a prefix at similarity 0.8
LISTED = 1 << 20  # frequent shingles that are told apart; others rank by their hash
TILE = 1024  # nodes of a key and band in one tile
SALT_BITS = 16
FILTER_BITS = 1 << 23
PIECE = 1 << 18  # shingles verified in one tile, about
PIECE_BYTES = 1 << 19  # of texts whose shingles are taken together, about

I64, BYTES = pa.int64(), pa.binary()


def _batch(schema: str, columns: list) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    fields = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], names=[f[0] for f in fields])


def _pieces(texts: pa.Array) -> Iterator[tuple[int, int, list[str | None]]]:
    """``(start, stop)`` of consecutive texts of about ``PIECE_BYTES`` and the texts; no more than those are held as Python texts."""
    for a, b in slices(texts, PIECE_BYTES):
        yield a, b, texts.slice(a, b - a).to_pylist()


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


# --- the order of keys ---


def frequent(docs: DataFrame, text_col: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The frequent shingles of all documents among those with a hash below ``LOW``, ascending, and their counts.

    Prefixes take shingles in the order of their hash, so those beyond are seldom keys.  The counts only order keys; at most
    ``LISTED`` are kept, those with the highest counts.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, texts in _pieces(batch.column(0)):
                found = shingles(texts, k).hashes
                keys, n = np.unique(found[found < LOW], return_counts=True)
                yield _batch("key long, n long", [_signed(keys), n])

    counts = stage(docs.select(text_col).mapInArrow(task, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT))
    levels = counts.groupBy(F.floor(F.log2("n")).cast("int").alias("b")).count().collect()  # one row per power of two
    total, least = 0, 63
    for r in sorted(levels, key=lambda r: -r["b"]):
        total += r["count"]
        if total > LISTED:
            break
        least = r["b"]
    found = counts.where(F.col("n") >= 2.0**least).toArrow()  # at most LISTED rows
    keys, n = found.column("key").to_numpy().view(np.uint64), found.column("n").to_numpy()
    order = np.argsort(keys)
    return keys[order], n[order]


# --- sets, bitmaps, keys ---


def needed(sizes: np.ndarray, num: int, den: int) -> np.ndarray:
    """The least overlap of a set of this size with any set that is similar enough."""
    return -(-num * sizes // den)


def bitmaps(s: Shingles) -> list[bytes]:
    """Per document the parity of its hashes' bits, 64 or a larger power of two, at least twice its size."""
    bits = np.maximum(64, 2 << np.ceil(np.log2(np.maximum(s.sizes, 1))).astype(np.int64))
    start = np.concatenate([[0], np.cumsum(bits)])
    owner = np.repeat(np.arange(len(bits)), s.sizes)
    at = start[owner] + (mix(s.hashes, 9) & (bits[owner] - 1).astype(np.uint64)).astype(np.int64)
    packed = np.packbits((np.bincount(at, minlength=int(start[-1])) & 1).astype(np.uint8), bitorder="little").tobytes()
    return [packed[a // 8 : b // 8] for a, b in zip(start, start[1:])]


def set_hashes(s: Shingles) -> tuple[np.ndarray, np.ndarray]:
    """128 bits per set, as two sums of mixed hashes."""
    out = []
    for seed in (3, 5):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(s.hashes, seed), dtype=np.uint64)])
        out.append(_signed(mix(total[s.start[1:]] - total[s.start[:-1]], seed)))
    return out[0], out[1]


def prefix_keys(s: Shingles, row: np.ndarray, hot: tuple[np.ndarray, np.ndarray], num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of all documents one after the other, where each begins, and per document how many of a thousand counted shingles are
    not frequent.  The low ``SALT_BITS`` deal a frequent key's nodes over tiles, from 1, and are 0 for a key of one tile; keys are
    equal where the other bits are."""
    keys, counts = hot
    owner = np.repeat(np.arange(len(s.sizes)), s.sizes)
    rank = np.zeros(len(s.hashes), np.int64)
    if len(keys):
        at = np.minimum(np.searchsorted(keys, s.hashes), len(keys) - 1)
        rank = np.where(keys[at] == s.hashes, counts[at], 0)
    counted = s.hashes < LOW
    rare = 1000 * np.bincount(owner[counted & (rank == 0)], minlength=len(s.sizes)) // np.maximum(1, np.bincount(owner[counted], minlength=len(s.sizes)))
    order = np.lexsort((s.hashes, rank, owner))
    place = np.arange(len(order)) - s.start[owner]
    length = np.where(s.sizes > 0, s.sizes - needed(s.sizes, num, den) + 1, 0)
    order = order[place < length[owner]]
    owner = owner[place < length[owner]]
    low = np.uint64((1 << SALT_BITS) - 1)
    tiles = np.minimum(-(-rank[order] // (4 * TILE)), (1 << SALT_BITS) - 1)
    salt = np.where(tiles > 1, 1 + mix(row.astype(np.uint64), 7)[owner] % np.maximum(tiles, 1).astype(np.uint64), np.uint64(0))
    return _signed((s.hashes[order] & ~low) | salt), np.concatenate([[0], np.cumsum(length)]), rare


SKETCH = "row long, doc_id long, n long, h1 long, h2 long, rare long, bits binary, keys array<long>"


def sketches(docs: DataFrame, id_col: str, text_col: str, k: int, num: int, den: int) -> DataFrame:
    """One row per document (``SKETCH``), kept in the checkpoint folder; ``row`` numbers them."""
    hot = docs.sparkSession.sparkContext.broadcast(frequent(docs, text_col, k))  # at most LISTED keys, 16 MB

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column(0).to_numpy()
            for a, b, texts in _pieces(batch.column(2)):
                s = shingles(texts, k)
                keys, start, rare = prefix_keys(s, row[a:b], hot.value, num, den)
                lists = pa.ListArray.from_arrays(pa.array(start, pa.int32()), pa.array(keys))
                yield _batch(SKETCH, [row[a:b], batch.column(1).slice(a, b - a), s.sizes, *set_hashes(s), rare, bitmaps(s), lists])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col))
    return stage(rows.mapInArrow(task, SKETCH))


# --- candidates ---

NEIGHBOURS = "tile long, node long, n long, before long, hub long, leader long"


def neighbours(keyed: DataFrame, num: int, den: int) -> DataFrame:
    """Of ``tile``, ``node``, ``n``, ``rare`` the rows of tiles with more than one node, with the node before (``before``) and the
    first (``hub``) in the order of ``rare``, null where there is none or their sizes are too far apart; ``leader`` is the first.
    A node alone in a salted tile is kept as well: others may hold its key under another salt."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, alone, first = None, False, None  # the last row so far, whether it still waits for company, its tile's first row
        for batch in batches:
            tile, node, n = (batch.column(i).to_numpy() for i in range(3))
            if not len(tile):
                continue
            if held is not None:  # go on behind the last row
                tile, node, n = (np.concatenate([[x], y]) for x, y in zip(held, (tile, node, n)))
            new = np.ones(len(tile), bool)
            new[1:] = tile[1:] != tile[:-1]
            start = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
            hub, hub_n = node[start], n[start]
            if held is not None:
                hub[start == 0], hub_n[start == 0] = first
            before, before_n = np.roll(node, 1), np.roll(n, 1)
            near = lambda m: np.minimum(m, n) * den >= np.maximum(m, n) * num  # noqa: B023, E731
            later = ~new
            company = later.copy()
            company[:-1] |= later[1:]
            company |= (tile & ((1 << SALT_BITS) - 1)) != 0
            if held is not None:
                if not alone:
                    company[0] = False  # written with its batch
                later[0] = False
            which = np.flatnonzero(company)
            out_before = pa.array(before[which], mask=~(later & near(before_n))[which])
            out_hub = pa.array(hub[which], mask=~(later & near(hub_n) & (hub != node))[which])
            yield _batch(NEIGHBOURS, [tile[which], node[which], n[which], out_before, out_hub, hub[which]])
            alone = not company[-1]
            held, first = (int(tile[-1]), int(node[-1]), int(n[-1])), (int(hub[-1]), int(hub_n[-1]))

    rows = keyed.select("tile", "node", "n", "rare").repartition("tile").sortWithinPartitions("tile", "rare", "n", "node")
    return written(rows.mapInArrow(task, NEIGHBOURS), "neighbours")


def could_link(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether bitmaps of equal width (rows of 64-bit words) leave room for the overlap: elements in one set only change a
    parity each, so as many as bits differ are not shared."""
    differ = np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)
    return (num + den) * ((na + nb - differ) // 2) >= num * (na + nb)


def fold(bits: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps of the rows reduced to ``words`` 64-bit words by joining halves."""
    while bits.shape[1] > words:
        half = bits.shape[1] // 2
        bits = bits[:, :half] ^ bits[:, half:]
    return bits


def _screen(pairs: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """``a``, ``b``, ``leader`` of the pairs that their bitmaps allow, with ``size`` shingles of both."""
    sides = [nodes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"bits{x}")) for x in "ab"]
    joined = pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "leader", "na", "nb", "bitsa", "bitsb")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, leader, na, nb = (batch.column(i).to_numpy() for i in range(5))
            xs, ys = (batch.column(i).to_pylist() for i in (5, 6))
            keep = np.zeros(len(a), bool)
            for i, (x, y) in enumerate(zip(xs, ys)):
                x, y = np.frombuffer(x, "<u8")[None], np.frombuffer(y, "<u8")[None]
                w = min(x.shape[1], y.shape[1])
                keep[i] = could_link(fold(x, w), fold(y, w), na[i], nb[i], num, den)[0]
            yield _batch("a long, b long, leader long, size long", [a[keep], b[keep], leader[keep], (na + nb)[keep]])

    return joined.mapInArrow(task, "a long, b long, leader long, size long")


TILES = "a long, b long, leader long"


def _compare(tiles: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of different components that bitmaps allow, of rows sorted by tile with those at home (``visits`` 0) first."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, home, stacked = None, [], None
        for batch in batches:
            found = []
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(3))))
            visits, node, n, comp, bits = (batch.column(i).to_pylist() for i in range(3, 8))
            for i, here in enumerate(keys):
                if here != key:
                    key, home, stacked = here, [], None
                if not visits[i]:
                    home.append((node[i], n[i], comp[i], np.frombuffer(bits[i], "<u8")))
                    continue
                if stacked is None:
                    widths = sorted({len(h[3]) for h in home})
                    stacked = [tuple(np.array(c) for c in zip(*(h for h in home if len(h[3]) == w))) for w in widths]
                mine = np.frombuffer(bits[i], "<u8")[None]
                for nodes, sizes, comps, theirs in stacked:
                    w = min(mine.shape[1], theirs.shape[1])
                    fit = (comps != comp[i]) & (np.minimum(sizes, n[i]) * den >= np.maximum(sizes, n[i]) * num)
                    which = np.flatnonzero(fit)
                    if len(which):
                        which = which[could_link(fold(theirs[which], w), fold(mine, w), sizes[which], n[i], num, den)]
                        found += [(min(node[i], x), max(node[i], x), min(comp[i], c)) for x, c in zip(nodes[which].tolist(), comps[which].tolist())]
            if found:
                yield _batch(TILES, list(zip(*found)))

    order = ["key", "band", "salt", "visits", "node", "n", "comp", "bits"]
    return tiles.repartition("key", "band", "salt").sortWithinPartitions("key", "band", "salt", "visits").select(order).mapInArrow(task, TILES)


def remaining(members: DataFrame, comp: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """``a``, ``b``, ``leader`` of all pairs of nodes that share a key, lie in different components and pass size and bitmaps.

    What a node must know of its key (the component of most nodes, the number of tiles of each band) comes in one row per key.
    """
    # a node has each key under one salt
    rows = members.select(F.shiftright("tile", SALT_BITS).alias("key"), "node", "n")
    rows = written(rows.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node")), "keyed")
    mixed = rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    ratio = 1.1
    reach = math.ceil(math.log(den / num) / math.log(ratio))  # bands that sizes close enough can be apart
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(ratio)).cast("int")
    rows = written(rows.join(mixed, "key").withColumn("band", band), "mixed")
    counts = stage(rows.groupBy("key", "band", "comp").agg(F.count(F.lit(1)).alias("c")))
    major = counts.groupBy("key", "comp").agg(F.sum("c").alias("c")).groupBy("key").agg(F.max(F.struct("c", "comp"))["comp"].alias("major"))
    tiles = counts.groupBy("key", "band").agg(F.ceil(F.sum("c") / TILE).cast("int").alias("tiles"))
    # sizes have at most some hundred bands
    tiles = tiles.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("band", "tiles"))).alias("tiles"))
    place = lambda b, salt, visits: F.struct(b.alias("band"), salt.alias("salt"), F.lit(visits).alias("visits"))
    own = F.pmod(F.xxhash64("node"), F.element_at("tiles", F.col("band"))).cast("int")
    near = F.filter(F.map_keys("tiles"), lambda b: F.abs(b - F.col("band")) <= reach)
    there = F.flatten(F.transform(near, lambda b: F.transform(F.sequence(F.lit(0), F.element_at("tiles", b) - 1), lambda i: place(b, i, 1))))
    places = F.concat(F.array(place(F.col("band"), own, 0)), F.when(F.col("comp") != F.col("major"), there).otherwise(F.expr("cast(array() as array<struct<band:int,salt:int,visits:int>>)")))
    placed = rows.join(major.join(tiles, "key"), "key").select("key", "node", "n", "comp", F.inline(places))
    return _compare(placed.join(nodes.select("node", "bits"), "node"), num, den).groupBy("a", "b").agg(F.min("leader").alias("leader"))


# --- verification ---

LINKS = "u long, v long, links long"


def _wanted(ids: DataFrame) -> np.ndarray:
    """A fixed number of bits, set at the hashes of ``doc_id``: a text whose bit is not set is not wanted."""
    at = ids.select(F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS)).alias("at"))
    words = at.groupBy(F.expr("at div 32").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 32 as int))")).alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 32, np.int64)
    out[words.column("w").to_numpy()] = words.column("bits").to_numpy()
    return out


def verify(docs: DataFrame, pairs: DataFrame, nodes: DataFrame, id_col: str, text_col: str, k: int, num: int, den: int) -> DataFrame:
    """True links among the pairs, as ``u``, ``v`` edges that join the same nodes, kept in the checkpoint folder.

    Shingles are taken anew from the texts of the nodes in question.  Pairs are dealt to tiles by their leader, a large
    leader's over several by ``b``; a tile gets each set once, and a pair whose ends it has joined needs no look.
    """
    ids = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    ids = stage(ids.join(nodes.select("node", "doc_id", "h1", "h2"), "node"))
    wanted = docs.sparkSession.sparkContext.broadcast(_wanted(ids))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = "d long, g1 long, g2 long, shingles binary"
        for batch in batches:
            at = batch.column(0).to_numpy()
            batch = batch.filter(pa.array((wanted.value[at >> 5] >> (at & 31)) & 1 == 1))
            for a, b, texts in _pieces(batch.column(2)):
                s = shingles(texts, k)
                yield _batch(schema, [batch.column(1).slice(a, b - a), *set_hashes(s), [s.of(i).tobytes() for i in range(b - a)]])

    doc = F.col(id_col).cast("long")
    texts = docs.select(F.pmod(F.xxhash64(doc), F.lit(FILTER_BITS)).alias("at"), doc.alias("doc_id"), F.col(text_col))
    found = texts.mapInArrow(task, "d long, g1 long, g2 long, shingles binary")
    per = pairs.groupBy("leader").agg(F.ceil(F.sum("size") / PIECE).cast("int").alias("pieces"))
    placed = stage(pairs.join(per, "leader").withColumn("piece", F.pmod(F.xxhash64("b"), F.col("pieces")).cast("int")).select("leader", "piece", "a", "b"))
    ends = placed.select("leader", "piece", F.col("a").alias("node")).union(placed.select("leader", "piece", "b")).distinct()
    none = F.lit(None).cast("binary")
    # ids are laid on the ends first: the sets, which are large, are dealt by what they are known by and then to their tiles, no more
    known = (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")) & F.col("doc_id").eqNullSafe(F.col("d"))
    held = ends.join(ids, "node").join(found, known).select("leader", "piece", F.lit(0).alias("kind"), F.col("node").alias("a"), F.lit(0).cast("long").alias("b"), "shingles")
    tiles = held.unionByName(placed.select("leader", "piece", F.lit(1).alias("kind"), "a", "b", none.alias("shingles")))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, have, root = None, {}, {}

        def top(x):
            while root.get(x, x) != x:
                root[x] = root.get(root[x], root[x])
                x = root[x]
            return x

        def joined():
            out = [(top(x), x) for x in root if top(x) != x]
            if out:
                yield _batch("u long, v long", list(zip(*out)))

        for batch in batches:
            sets = batch.column(5)
            for i, (leader, piece, kind, a, b) in enumerate(zip(*(c.to_pylist() for c in batch.columns[:5]))):
                if key != (leader, piece):
                    yield from joined()
                    key, have, root = (leader, piece), {}, {}
                if kind == 0:
                    have[a] = np.frombuffer(sets[i].as_py(), "<u8")  # a copy: the batch is not held
                    continue
                u, v = sorted((top(a), top(b)))
                if u != v:
                    x, y = have[a], have[b]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if den * both >= num * (len(x) + len(y) - both):
                        root[v] = u
                        root.setdefault(u, u)
        yield from joined()

    order = ["leader", "piece", "kind", "a", "b", "shingles"]
    rows = tiles.repartition("leader", "piece").sortWithinPartitions("leader", "piece", "kind").select(order)
    return stage(rows.mapInArrow(check, "u long, v long"))


def _grouped(docs: DataFrame, k: int, num: int, den: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The sketches, and of each distinct set ``node``, ``n``, ``h1``, ``h2``, its smallest ``first_id`` and its component ``comp``."""
    spark = docs.sparkSession
    sketch = sketches(docs, id_col, text_col, k, num, den)
    release(spark)
    whole, sketch = sketch, stage(sketch.select("doc_id", "n", "h1", "h2", "row"))
    some = sketch.where("n > 0")
    equal = some.groupBy("n", "h1", "h2").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first"))
    equal = stage(equal.select("n", "h1", "h2", F.col("first.row").alias("node"), F.col("first.doc_id").alias("first_id")))
    nodes = stage(whole.join(equal.select("node"), F.col("row") == F.col("node")).select("node", "doc_id", "n", "h1", "h2", "rare", "bits", "keys"))
    del whole  # bitmaps and keys are the nodes' from here on; the checkpoint that holds them for every document can go
    release(spark)
    members = neighbours(nodes.select(F.explode("keys").alias("tile"), "node", "n", "rare"), num, den)
    release(spark)
    near = members.select("node", "leader", F.explode(F.array_distinct(F.array("before", "hub"))).alias("other")).where("other is not null")
    pairs = near.groupBy(F.least("other", "node").alias("a"), F.greatest("other", "node").alias("b")).agg(F.min("leader").alias("leader"))
    links = verify(docs, stage(_screen(pairs, nodes, num, den)), nodes, id_col, text_col, k, num, den)
    comp = labels(links)
    release(spark)
    rest = stage(_screen(remaining(members, comp, nodes, num, den), nodes, num, den))
    release(spark)
    if not rest.isEmpty():
        comp = labels(links.unionByName(verify(docs, rest, nodes, id_col, text_col, k, num, den)))
    return sketch, equal.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))


def join(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs`` its ``doc_id``, ``n_shingles`` and ``component_id``: the smallest id that links lead to.

    Two documents link where den x intersection >= num x union of their distinct ``k``-word shingles.  Null and empty texts and
    those without words have no shingles and link with nothing.  Rows that repeat an id are told apart; a null id is no
    component's name unless all its rows have none.
    """
    sketch, grouped = _grouped(docs, k, num, den, id_col, text_col)
    names = grouped.groupBy("comp").agg(F.min("first_id").alias("component_id"))
    named = grouped.join(names, "comp").select("n", "h1", "h2", "component_id")
    rows = sketch.select("doc_id", "n", "h1", "h2")
    same: Column = (F.col("s.n") == F.col("e.n")) & (F.col("s.h1") == F.col("e.h1")) & (F.col("s.h2") == F.col("e.h2"))
    linked = rows.where("n > 0").alias("s").join(named.alias("e"), same).select("s.doc_id", F.col("s.n").alias("n_shingles"), "component_id")
    return linked.unionByName(rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def _marked(batches: Iterator[pa.RecordBatch], at: int, k: int) -> Iterator[pa.RecordBatch]:
    """The rows with size and hashes of their sets behind them; column ``at`` holds the texts, shingled a piece at a time."""
    for batch in batches:
        for a, b, texts in _pieces(batch.column(at)):
            s = shingles(texts, k)
            columns = [*batch.slice(a, b - a).columns, *(pa.array(x, I64) for x in (s.sizes, *set_hashes(s)))]
            yield pa.RecordBatch.from_arrays(columns, names=[f"c{i}" for i in range(len(columns))])


def one_of_each(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each component the document with the smallest id (null last) stays, and
    of rows alike in id and shingles one; documents without words all stay."""
    _, grouped = _grouped(docs, k, num, den, id_col, text_col)
    first = grouped.groupBy("comp").agg(F.min(F.struct(F.col("first_id").isNull(), "first_id", "n", "h1", "h2")).alias("f"))
    own = [fresh(c, docs.columns) for c in ("set_n", "set_h1", "set_h2")]
    number, none = fresh("id_number", docs.columns), fresh("id_is_null", docs.columns)
    known = lambda c: [F.coalesce(c, F.lit(0)).alias(number), c.isNull().alias(none)]
    kept_rows = stage(first.select(*known(F.col("f.first_id")), *[F.col(f"f.{c}").alias(x) for c, x in zip(("n", "h1", "h2"), own)]))
    del grouped, first
    release(docs.sparkSession)  # of what was kept on the way only these rows are needed
    at = docs.columns.index(text_col)
    marked = mapped(docs, lambda batches: _marked(batches, at, k), {c: T.LongType() for c in own})
    plain = [F.col(f"`{c}`") for c in docs.columns]
    wordless = marked.where(F.col(own[0]) == 0).select(plain)
    # by id as well, so that a large group of copies is spread; rows alike meet by the same columns, so whole rows are dealt once
    keys = [number, none, *own]
    stays = marked.select("*", *known(F.col(f"`{id_col}`").cast("long"))).join(kept_rows, keys, "left_semi")
    return stays.dropDuplicates([id_col, *keys]).select(plain).unionByName(wordless)
