"""S12 over files: a keyed store whose writes cost what they touch.

Rows lie in buckets by the hash of their key.  A write reads and rewrites the buckets it has rows for, into a new folder, and then
writes a manifest that names the folder of every bucket: the old one for those it did not touch.  A version exists when
Spark has committed its manifest, so a write that fails half-way, or is run twice, changes nothing that a reader sees, and
files are never altered.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rankeval.operators.ranges import join_on
from rankeval.sources.folders import committed, names
from rankeval.sources.staging import stage

BUCKET = "bucket_no"


def versions(spark: SparkSession, root: str) -> list[int]:
    """The committed versions of a store, ascending."""
    numbers = [int(n.removeprefix("version=")) for n in names(spark, f"{root}/manifest") if n.startswith("version=")]
    return [n for n in sorted(numbers) if committed(spark, f"{root}/manifest/version={n}")]


def manifest(spark: SparkSession, root: str, version: int | None = None) -> dict[int, str]:
    """The folder of each bucket that has rows, by default of the last version; empty for a store without any."""
    known = versions(spark, root)
    if not known:
        return {}
    rows = spark.read.json(f"{root}/manifest/version={known[-1] if version is None else version}").collect()  # one row per bucket
    return {r["bucket"]: r["folder"] for r in rows if r["bucket"] is not None}


def _read(spark: SparkSession, root: str, folders: Sequence[str]) -> DataFrame:
    return spark.read.option("mergeSchema", "true").parquet(*[f"{root}/{f}" for f in sorted(folders)])


def read(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """All rows of a version, by default of the last."""
    folders = manifest(spark, root, version)
    if not folders:
        raise FileNotFoundError(f"no rows in the store at {root}")
    return _read(spark, root, list(folders.values()))


def _bucket(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in keys]), F.lit(buckets)).cast("int")


def upsert(df: DataFrame, root: str, keys: Sequence[str] = ("id",), buckets: int = 256, rows_per_file: int = 1_000_000) -> int:
    """Rows of ``df``, one per key, replace the store's rows with the same key or are added; the new version's number.

    ``buckets`` is fixed with the first write.  Of two writers of one version the second fails.  Columns that only some writes
    have are null elsewhere; a null in a key is a value.
    """
    spark, keys = df.sparkSession, list(keys)
    known = versions(spark, root)
    if known:
        buckets = spark.read.json(f"{root}/manifest/version={known[-1]}").agg(F.max("buckets")).first()[0]
    current = manifest(spark, root)
    rows = stage(df.withColumn(BUCKET, _bucket(keys, buckets)))
    counts = {r[BUCKET]: r["count"] for r in rows.groupBy(BUCKET).count().collect()}  # at most ``buckets`` rows
    version = 1 + max([0, *(int(n.removeprefix("version=")) for n in names(spark, f"{root}/manifest") if n.startswith("version="))])
    folder = f"data/{uuid.uuid4().hex}"
    if counts:
        merged, size = rows, max(counts.values())
        if old := [current[b] for b in counts if b in current]:
            kept = join_on(_read(spark, root, old), rows.select(*keys), keys, "left_anti")
            merged = kept.withColumn(BUCKET, _bucket(keys, buckets)).unionByName(rows, allowMissingColumns=True)
            merged = stage(merged)
            size = merged.groupBy(BUCKET).count().agg(F.max("count")).first()[0]
        files = max(1, -(-size // rows_per_file))
        spread = F.pmod(F.xxhash64(F.lit("file"), *[F.col(k).cast("string") for k in keys]), F.lit(files))
        merged.repartition(F.col(BUCKET), spread).write.option("maxRecordsPerFile", rows_per_file).partitionBy(BUCKET).parquet(f"{root}/{folder}")
    entries = current | {b: f"{folder}/{BUCKET}={b}" for b in counts}
    lines = [(b, buckets, f) for b, f in sorted(entries.items())] or [(None, buckets, None)]
    table = spark.createDataFrame(lines, "bucket int, buckets int, folder string")
    table.coalesce(1).write.mode("errorifexists").json(f"{root}/manifest/version={version}")
    return version
