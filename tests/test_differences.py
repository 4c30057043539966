"""Differing branches and their first entries against a plain walk."""

import json
import random

import pytest

from rankeval.operators.differences import difference_summary, differences

KINDS = "k int, a int, s struct<x:string,y:struct<z:array<int>,w:double>>, l array<struct<t:string,m:array<string>>>, m map<string,array<int>>"
COLUMNS = ["a", "s", "l", "m"]


def row(k, rnd):
    texts = lambda n: [rnd.choice(["p", "q", None]) for _ in range(n)]
    return (
        k, rnd.choice([1, 2, None]), rnd.choice([None, (rnd.choice(["x", None]), rnd.choice([None, (rnd.choice([None, [], [1], [1, 2], [None]]), 0.5)]))]),
        rnd.choice([None, [(rnd.choice("tu"), rnd.choice([None, texts(rnd.randrange(3))])) for _ in range(rnd.randrange(3))]]),
        rnd.choice([None, {x: rnd.choice([None, [1], [1, 2]]) for x in rnd.sample("uvw", rnd.randrange(4))}]),
    )


def walk(x, y, names):
    """Branches (through structs) of two values that differ: path, kind, path of the first entry."""
    def first(x, y, names):
        if x is None or y is None or not isinstance(x, (list, dict, tuple)):
            return ""
        if isinstance(x, tuple):
            return next(f".{n}" + first(p, q, sub) for (n, sub), p, q in zip(names, x, y) if p != q)
        if isinstance(x, dict):
            k = next(iter([k for k in sorted(x.keys() | y.keys()) if x.get(k) != y.get(k)] or sorted(x.keys() ^ y.keys())))
            return f"{{{k}}}" + first(x.get(k), y.get(k), names)
        for i in range(max(len(x), len(y))):
            p, q = (v[i] if i < len(v) else None for v in (x, y))
            if p != q:
                return f"[{i}]" + first(p, q, names)
        return f"[{min(len(x), len(y))}]"

    def branches(x, y, names, path):
        if x == y:
            return
        if x is None or y is None:
            yield path, "missing", path
        elif isinstance(x, tuple):
            for (n, sub), p, q in zip(names, x, y):
                yield from branches(p, q, sub, f"{path}.{n}".lstrip("."))
        else:
            kind = "value"
            if isinstance(x, dict):
                kind = "keys" if x.keys() != y.keys() else "value"
            elif isinstance(x, list):
                kind = "size" if len(x) != len(y) else "value"
            yield path, kind, path + first(x, y, names)

    return list(branches(x, y, names, ""))


NAMES = [("a", None), ("s", [("x", None), ("y", [("z", None), ("w", None)])]), ("l", [("t", None), ("m", None)]), ("m", None)]


def test_against_a_plain_walk(spark):
    rnd = random.Random(12)
    left = [row(k, rnd) for k in range(120)] + [row(None, rnd)]
    right = [row(k, random.Random(k)) if k % 3 else r for k, r in enumerate(left[:100])] + [row(None, rnd), row(500, rnd)]
    l, r = ({x[0]: x[1:] for x in side} for side in (left, right))
    want = [(k, "both", *d) for k in l.keys() & r.keys() for d in walk(l[k], r[k], NAMES)]
    want += [(k, "only_left", None, None, None) for k in l.keys() - r.keys()] + [(k, "only_right", None, None, None) for k in r.keys() - l.keys()]
    found = differences(spark.createDataFrame(left, KINDS).repartition(3), spark.createDataFrame(right, KINDS), ["k"], COLUMNS)
    got = found.collect()
    assert sorted(((x["k"], x["side"], x["branch"], x["kind"], x["path"]) for x in got), key=str) == sorted(want, key=str)
    for x in got:
        if x["branch"] == "a":
            assert [json.loads(x[v])["v"] for v in ("left_value", "right_value")] == [l[x["k"]][0], r[x["k"]][0]]
    summary = {(x["side"], x["branch"], x["kind"]): x["rows"] for x in difference_summary(found).collect()}
    assert sum(summary.values()) == len(want) and summary["only_right", None, None] == 1


def test_equal_sides_open_nothing(spark):
    df = spark.createDataFrame([row(k, random.Random(k)) for k in range(30)], KINDS)
    assert differences(df, df.repartition(4), ["k"], COLUMNS).count() == 0
    with pytest.raises(Exception):
        differences(df, df.drop("m"), ["k"], COLUMNS).count()
