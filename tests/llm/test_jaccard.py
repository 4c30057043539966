import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from rankeval.llm import components, jaccard
from rankeval.llm.queries import ORACLES, QUERIES
from rankeval.llm.shingles import shingles
from tests.compare import compare, connect

SF = "/root/testdata/sf0.001"


def plain_set(text, k=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def plain_components(rows):
    sets = [plain_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                root[top(i)] = top(j)
    name = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            name[top(i)] = min(d, name.get(top(i), d))
    return sorted((-1 if d is None else d, len(sets[i]), -1 if name.get(top(i)) is None else name[top(i)]) for i, (d, _) in enumerate(rows))


def got(spark, rows, **more):
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n int, `row` string")
    return sorted((-1 if r[0] is None else r[0], r[1], -1 if r[2] is None else r[2]) for r in jaccard.join(docs, **more).collect())


def corpus(seed):
    """Near copies around the limit, chains, a passage in many texts, copies, short texts."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + str(rng.randrange(400))
    passage = [word() for _ in range(60)]
    rows = []
    for _ in range(12):
        base = [word() for _ in range(rng.choice([6, 20, 80, 200]))]
        for _ in range(rng.randrange(1, 9)):
            copy = base.copy()
            for _ in range(rng.randrange(0, 1 + len(base) // 25)):
                copy[rng.randrange(len(copy))] = word()
            if rng.random() < 0.3:
                copy = copy[: len(copy) - rng.randrange(len(copy) // 6 + 1)]
            rows.append(" ".join(copy))
            base = copy if rng.random() < 0.5 else base
    rows += [" ".join([word() for _ in range(rng.randrange(10, 60))] + passage + [word() for _ in range(rng.randrange(10, 60))]) for _ in range(40)]
    rows += [" ".join(passage[: rng.randrange(40, 60)]) for _ in range(10)] + ["a b", "A\tb", "a  b c", "", None, " \n", "é È", "É È"] * 2
    rng.shuffle(rows)
    return [(rng.randrange(10**9) if i % 17 else None, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_against_all_pairs(spark, seed):
    rows = corpus(seed)
    assert got(spark, rows) == plain_components(rows)


def test_components_when_every_key_is_frequent_and_tiles_are_small(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "FREQUENT", 2)
    monkeypatch.setattr(jaccard, "TILE", 2)
    monkeypatch.setattr(jaccard, "PIECE", 50)
    rows = corpus(3)
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(batch, "3")
    try:
        assert got(spark, rows) == plain_components(rows)
    finally:
        spark.conf.unset(batch)


def test_the_order_of_keys_does_not_matter(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "LISTED", 3)
    monkeypatch.setattr(jaccard, "FREQUENT", 2)
    rows = corpus(4)
    assert got(spark, rows) == plain_components(rows)


def short_families(count):
    """Pairs of texts with 4 and 5 shingles that share 4, all of these counted, so that every key they share is salted where there
    are more copies than a tile takes."""
    rng = random.Random(6)
    found = []
    while len(found) < count:
        texts = [" ".join(f"{rng.choice('abcdefgh')}{rng.randrange(400)}" for _ in range(9)) for _ in range(2000)]
        s = shingles([t.rsplit(" ", 1)[0] for t in texts], 5)
        found += [t for i, t in enumerate(texts) if (s.of(i) < jaccard.LOW).all()]
    return [(t.rsplit(" ", 1)[0], t) for t in found[:count]]


def test_variants_of_a_text_with_many_copies_meet_under_different_salts(spark):
    texts = [t for pair in short_families(6) for t in pair]
    docs = spark.range(3000 * len(texts)).select(F.col("id").alias("doc_id"), F.element_at(F.array(*map(F.lit, texts)), (F.col("id") % len(texts) + 1).cast("int")).alias("text"))
    found = jaccard.join(docs).groupBy(F.col("doc_id") % len(texts), "component_id").count().collect()
    assert sorted(tuple(r) for r in found) == [(i, i // 2 * 2, 3000) for i in range(len(texts))]


@pytest.mark.parametrize("batch", [1, 2, 3, 100])
def test_a_node_alone_in_a_salted_tile_is_kept(spark, batch):
    tiles = {1 << 16: 1, 2 << 16: 3, (3 << 16) + 1: 1, (3 << 16) + 2: 1, (3 << 16) + 3: 4, 4 << 16: 1, (5 << 16) + 7: 1}
    rows = [(t, 100 * i + j, 10, j) for i, (t, n) in enumerate(tiles.items()) for j in range(n)]
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(name, str(batch))
    try:
        got = jaccard.neighbours(spark.createDataFrame(rows, "tile long, node long, n long, rare long").coalesce(1), 4, 5).collect()
    finally:
        spark.conf.unset(name)
    want = [(t, x, 10, x - 1 if j else None, x - j if j else None, x - j) for t, x, _, j in rows if tiles[t] > 1 or t % (1 << 16)]
    assert sorted((tuple(r) for r in got), key=repr) == sorted(want, key=repr)


def test_query_against_sql(spark):
    assert compare(spark, connect(SF), QUERIES["op3_jaccard_join"], ORACLES["op3_jaccard_join"], SF) is None


def test_empty_tables_and_equal_rows(spark):
    assert got(spark, []) == []
    assert got(spark, [(1, None), (2, "")]) == [(1, 0, 1), (2, 0, 2)]
    long = "w " + "x y z " * 40_000
    rows = [(5, long), (5, long), (4, long + "q"), (None, "only one"), (None, "only one")]
    assert got(spark, rows) == plain_components(rows)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("abA \n\té\xa0")), max_size=30), max_size=6), st.integers(1, 5))
def test_shingles_of_many_texts(texts, k):
    s = shingles(texts, k)
    sets = [plain_set(t, k) for t in texts]
    assert s.sizes.tolist() == [len(x) for x in sets]
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            assert len(np.intersect1d(s.of(i), s.of(j))) == len(a & b)


def test_components_of_paths_stars_and_loops(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(100)] + [(200, 200 + i) for i in range(1, 50)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)] + [(7, 7)]
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in edges:
        a, b = sorted((top(u), top(v)))
        root[b] = a
    rng.shuffle(edges)
    got = {r["node"]: r["comp"] for r in components.labels(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: top(x) for x in root if any(x in e and e[0] != e[1] for e in edges)}
    assert components.labels(spark.createDataFrame([], "u long, v long")).count() == 0
