"""Re-dealing one column against another: the permutation law of a contingency table.

Shuffling a column keeps both margins, so a shuffled table is drawn from them and no row is moved.  The values of the
long margin are the leaves of a binary tree; each node shares its part of the short margin out to its two sides by the exact
multivariate hypergeometric law.  The draws of a node depend on its place, the replicate and the seed only, so a task draws the path
from the root to its own leaves and then those leaves, and tasks agree on what they share without a word between them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from rankeval.functions.draws import share_out, stream
from rankeval.operators.ranges import join_on, ordered_index
from rankeval.sources.staging import stage

LEAVES = 1024  # values of the long margin in one task's part of the tree
REPLICATES = 16  # drawn together
_TOP, _INNER = 0, 1
WORK = ["_chunk", "_leaves", "_path", "_kinds", "_margin", "_stream", "_first"]


def _down(pool: np.ndarray, sizes: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The tables (replicate, leaf, kind) below a node that holds ``pool`` (replicate, kind), for leaves of these sizes."""
    width = 1 << max(0, (len(sizes) - 1).bit_length())
    level = [np.zeros(width, np.int64)]
    level[0][: len(sizes)] = sizes
    while len(level[-1]) > 1:
        level.append(level[-1].reshape(-1, 2).sum(1))
    held = pool[:, None, :]
    for depth, below in enumerate(reversed(level[:-1])):
        node = np.arange(held.shape[1])
        left = share_out(held, np.broadcast_to(below[::2], held.shape[:2]), stream(key.view(np.int64)[:, None], _INNER, depth, node))
        held = np.stack([left, held - left], 2).reshape(len(pool), -1, pool.shape[1])
    return held[:, : len(sizes)]


def _part(row: dict, replicates: np.ndarray, seed: int) -> np.ndarray:
    """The tables of one part's leaves."""
    key = stream(seed, int(row["_stream"]), replicates)
    pool = np.broadcast_to(np.array(row["_margin"], np.int64), (len(replicates), len(row["_margin"])))
    for step in row["_path"] if row["_path"] is not None else []:  # from the root down
        level, size = int(step["level"]), int(step["size"])
        left = share_out(pool, np.full(len(replicates), size), stream(key.view(np.int64), _TOP, level, int(row["_chunk"]) >> (level + 1)))
        pool = left if not (int(row["_chunk"]) >> level) & 1 else pool - left
    return _down(pool, np.array([leaf["size"] for leaf in row["_leaves"]], np.int64), key)


def _parts(cells: DataFrame, a: str, b: str, by: Sequence[str], n: int) -> DataFrame:
    """The work: per group, part of the tree and block of replicates the part's leaves, the short margin and the sizes of the left
    sides along the path from the root."""
    leaves = cells.groupBy(*by, a).agg(F.sum("_c").alias("_size"))
    leaves = ordered_index(stage(leaves), by, [a], "_leaf").withColumn("_chunk", F.expr(f"_leaf div {LEAVES}"))
    parts = stage(leaves.groupBy(*by, "_chunk").agg(
        F.sort_array(F.collect_list(F.struct(F.col("_leaf").alias("leaf"), F.col("_size").alias("size"), F.col(a).alias("value")))).alias("_leaves"),
        F.sum("_size").alias("_size"),
    ))
    depth = parts.groupBy(*by).agg(F.ceil(F.log2(F.max("_chunk") + 1)).cast("int").alias("_depth"))
    deep = join_on(parts.select(*by, "_chunk", "_size"), depth, by).where("_depth > 0")
    deep = deep.withColumn("level", F.explode(F.sequence(F.lit(0), F.col("_depth") - 1)))
    node = F.expr("shiftright(_chunk, level)")
    nodes = deep.groupBy(*by, "level", node.alias("_node")).agg(F.sum("_size").alias("size"))
    left = deep.select(*by, "_chunk", "level", F.expr("shiftright(_chunk, level + 1) * 2").alias("_node"))
    path = join_on(left, nodes, [*by, "level", "_node"]).groupBy(*by, "_chunk").agg(
        F.sort_array(F.collect_list(F.struct("level", "size")), asc=False).alias("_path"))
    margin = cells.groupBy(*by, b).agg(F.sum("_c").alias("_size")).groupBy(*by).agg(
        F.sort_array(F.collect_list(F.struct(F.col(b).alias("value"), F.col("_size").alias("size")))).alias("_kinds"))
    work = join_on(join_on(parts.drop("_size"), path, [*by, "_chunk"], "left"), margin, by)
    work = work.withColumn("_margin", F.transform("_kinds", lambda k: k.getField("size")))
    work = work.withColumn("_stream", F.xxhash64(F.to_json(F.struct(*by), {"ignoreNullFields": "false"})))
    blocks = F.sequence(F.lit(0), F.lit(n - 1), F.lit(REPLICATES))
    # a stated number of tasks: the rows are few and small, and would be joined to one task, but each is much work
    tasks = max(cells.sparkSession.sparkContext.defaultParallelism, int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return work.withColumn("_first", F.explode(blocks)).repartition(tasks, *by, "_chunk", "_first")


def _counted(df: DataFrame, a: str, b: str, by: Sequence[str], rows: str | None) -> DataFrame:
    return stage(df.groupBy(*by, a, b).agg((F.count(F.lit(1)) if rows is None else F.sum(rows)).alias("_c")))


def _types(df: DataFrame, names: Sequence[str]) -> list[str]:
    kinds = dict(df.dtypes)
    return [f"`{c}` {kinds[c]}" for c in names]


def deal_tables(
    df: DataFrame, a: str, b: str, n: int = 80, seed: int = 0, by: Sequence[str] = (), rows: str | None = None
) -> DataFrame:
    """The cells of ``n`` random re-dealings of ``b`` against ``a``: keys, ``replicate``, both values and their count ``n``.

    ``b`` is the short dimension (positions).  ``rows``: how many rows a row of ``df`` stands for.  A null is a value, and a group,
    like any other; cells that hold nothing are left out.
    """
    keys = list(by) or ["_all"]
    cells = _counted(df if by else df.withColumn("_all", F.lit(0)), a, b, keys, rows)
    schema = ", ".join([*_types(cells, keys), "replicate int", *_types(cells, [a, b]), "n bigint"])

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i, row in enumerate(pdf[WORK].to_dict("records")):
                replicates = np.arange(row["_first"], min(n, row["_first"] + REPLICATES))
                table = _part(row, replicates, seed)
                r, leaf, kind = np.nonzero(table)
                left, right = ([part[j]["value"] for j in at] for part, at in ((row["_leaves"], leaf), (row["_kinds"], kind)))
                out = {"replicate": replicates[r], a: pd.Series(left, dtype=object), b: pd.Series(right, dtype=object), "n": table[r, leaf, kind]}
                yield pd.DataFrame({**{k: pdf[k].iloc[[i] * len(r)].reset_index(drop=True) for k in keys}, **out})

    out = _parts(cells, a, b, keys, n).mapInPandas(deal, schema)
    return out if by else out.drop("_all")


def null_information(
    df: DataFrame, a: str, b: str, n: int = 80, seed: int = 0, by: Sequence[str] = (), rows: str | None = None
) -> DataFrame:
    """Mutual information of every re-dealing: keys, ``replicate`` and ``mi`` in nats."""
    keys = list(by) or ["_all"]
    cells = _counted(df if by else df.withColumn("_all", F.lit(0)), a, b, keys, rows)
    schema = ", ".join([*_types(cells, keys), "replicate int", "_cell_log double"])

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i, row in enumerate(pdf[WORK].to_dict("records")):
                replicates = np.arange(row["_first"], min(n, row["_first"] + REPLICATES))
                table = _part(row, replicates, seed).astype(float)
                logs = (table * np.log(np.maximum(table, 1))).sum((1, 2))
                yield pd.DataFrame({**{k: pdf[k].iloc[[i] * len(logs)].reset_index(drop=True) for k in keys}, "replicate": replicates, "_cell_log": logs})

    dealt = _parts(cells, a, b, keys, n).mapInPandas(deal, schema).groupBy(*keys, "replicate").agg(F.sum("_cell_log").alias("_cell_log"))
    logs = lambda c: cells.groupBy(*keys, c).agg(F.sum("_c").cast("double").alias("m")).groupBy(*keys)
    sides = join_on(
        logs(a).agg(F.sum(F.expr("m * ln(m)")).alias("_a_log"), F.sum("m").alias("_n")), logs(b).agg(F.sum(F.expr("m * ln(m)")).alias("_b_log")), keys)
    out = join_on(dealt, sides, keys)
    return out.select(*by, "replicate", F.expr("(_cell_log - _a_log - _b_log) / _n + ln(_n)").alias("mi"))
