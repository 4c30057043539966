"""Writing samples, scores, days, benchmark rows and keyed documents."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from rankeval.operators.flatten import flatten_impressions
from rankeval.operators.ranges import table_index
from rankeval.operators.sampling import hash_hex
from rankeval.sources.folders import committed, exists, names

DAY_LOG = "_ingested"
ALIKE = 100_000  # rows alike that one task makes


def write_samples(df: DataFrame, path: str, fmt: str = "json", by: Sequence[str] = ()) -> DataFrame:
    """Write rows (JSON lines keep non-ASCII text as it is), one folder per ``by`` value.

    Returns the written rows' summary: n, pos, neg, ctr, tagged.
    """
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).format(fmt).save(path)
    back = df.sparkSession.read.schema(df.schema).format(fmt).load(path)
    return sample_summary(back, by)


def sample_summary(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    out = df.groupBy(*by).agg(
        F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("pos"),
        F.coalesce(F.sum("is_tagged"), F.lit(0)).alias("tagged"),
    )
    return out.withColumn("neg", F.col("n") - F.col("pos")).withColumn("ctr", F.col("pos") / F.greatest(F.lit(1), F.col("n")))


def write_days(df: DataFrame, path: str, column: str = "bizdate", fmt: str = "parquet") -> None:
    """Write day folders; days in ``df`` replace their folder, other days stay.

    Rows are written by the tasks that hold them: no shuffle, and a big day is written by many tasks.
    """
    (
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).format(fmt).save(path)
    )


def ingested(spark: SparkSession, path: str) -> DataFrame:
    """The day log: ``day``, ``rows`` and ``run`` of every day that a run has written and closed, the last run of a day.

    A target from before the log is known by the names of its day folders.  The target's rows are not read.
    """
    log = f"{path}/{DAY_LOG}"
    runs = [n for n in names(spark, log) if committed(spark, f"{log}/{n}")]
    schema = "day string, rows long, run string, at timestamp"
    if runs:
        rows = spark.read.schema(schema).json([f"{log}/{n}" for n in runs])
        return rows.groupBy("day").agg(F.max_by(F.struct("rows", "run"), F.struct("at", "run")).alias("_l")).select("day", "_l.*")
    days = [(n.partition("=")[2], None, "") for n in names(spark, path) if "=" in n]
    return spark.createDataFrame(days, "day string, rows long, run string")


def ingest_days(source: DataFrame, path: str, wanted: DataFrame, column: str = "bizdate") -> DataFrame:
    """Add the wanted days that the target's log does not hold yet; the log's new entries.

    The days' folders are replaced as a whole, then the run's log file is committed: a run that ends between the two is
    repeated and writes the same folders again, so no day is doubled or left half.  Days without rows are not logged and are looked
    for again.  The list of days is short, so it is read to the driver and becomes a partition filter on the source.
    """
    spark, run = source.sparkSession, uuid.uuid4().hex
    missing = wanted.select(F.col(column).cast("string").alias("day")).distinct().join(ingested(spark, path), "day", "left_anti")
    days = [r["day"] for r in missing.collect()]
    if days:
        write_days(source.where(F.col(column).cast("string").isin(days)), path, column)
    written = [d for d in days if exists(spark, f"{path}/{column}={d}")]
    entries = spark.createDataFrame([], "day string, rows long, run string, at timestamp")
    if written:
        # the new folders' footers tell the rows
        counted = spark.read.option("basePath", path).parquet(*[f"{path}/{column}={d}" for d in written])
        entries = counted.groupBy(F.col(column).cast("string").alias("day")).agg(F.count("*").alias("rows"))
        entries = entries.withColumn("run", F.lit(run)).withColumn("at", F.current_timestamp())
        entries.coalesce(1).write.json(f"{path}/{DAY_LOG}/run={run}")
    return ingested(spark, path).where(F.col("run") == run)


def prepare_days(feeds: DataFrame, path: str, wanted: DataFrame, tag: str, require_features: bool = True) -> DataFrame:
    """Flattened rows of one tag, day by day into the target, as :func:`ingest_days` does; the log's new entries.

    Blank dates belong to no day.
    """
    samples = flatten_impressions(feeds.where(F.col("bizdate") != ""), "", "", tag, require_features)
    rows = samples.withColumn("features", F.to_json("features"))  # a bag of loose values is kept as text
    return ingest_days(rows, path, wanted)


def score_rows(df: DataFrame, score: str, keys: Sequence[str]) -> DataFrame:
    """The per-row score table; ``idx`` is the place in key order."""
    kept = ["label", "bizdate", "is_tagged", "feed_id", "user_id"]
    rows = df.select(*dict.fromkeys([*keys, *kept]), F.col(score).cast("double").alias("_score"))
    numbered = table_index(rows, list(keys), "idx", [*kept, "_score"])
    return numbered.select("idx", "label", F.col("_score").alias("score"), "bizdate", "is_tagged", "feed_id", "user_id")


def write_bench_csv(df: DataFrame, path: str, append: bool = False) -> None:
    """Benchmark rows with a header; an appended run is a further file of the same folder."""
    df.write.mode("append" if append else "overwrite").csv(path, header=True, quote='"', escape='"')


def prepare_upsert(
    df: DataFrame, partition_key: str, id_candidates: Sequence[str] = ("id", "conversation_id"), latest: Sequence[str] = (),
) -> DataFrame:
    """One row per text ``id`` with a text partition key.

    The id is the first of ``id_candidates`` the table has; without any, a hash of the whole row and its number
    among rows alike stands in for a random id, so that a repeated write overwrites instead of adding.  Of several rows with one id and key the
    last by ``latest`` (else by content) is kept.
    """
    if partition_key not in df.columns:
        raise ValueError(f"partition key column {partition_key!r} is missing")
    have = [c for c in id_candidates if c in df.columns]
    content = F.to_json(F.struct(*sorted(df.columns)))
    ids = [F.nullif(F.col(c).cast("string"), F.lit("")) for c in have]
    out = df.withColumn("_content", content)
    if not have:  # rows alike are rows of their own: as they are interchangeable, they are made from their number
        alike = out.groupBy("_content").agg(F.count("*").alias("_times"), F.any_value(F.struct(*df.columns)).alias("_row"))
        blocks = alike.withColumn("_from", F.explode(F.sequence(F.lit(0), F.col("_times") - 1, F.lit(ALIKE))))
        number = F.explode(F.sequence(F.col("_from") + 1, F.least(F.col("_from") + ALIKE, F.col("_times"))))
        out = blocks.repartition("_content", "_from").withColumn("_n", number).select("_row.*", "_content", "_n")
    out = out.withColumn("id", F.coalesce(*ids, hash_hex(0, F.col("_content"), *([] if have else ["_n"]))))
    out = out.withColumn(partition_key, F.col(partition_key).cast("string"))
    rest = [c for c in out.columns if c not in ("id", partition_key, "_content", "_n")]
    last = F.max_by(F.struct(*rest), F.struct(*latest, "_content"))
    return out.groupBy("id", partition_key).agg(last.alias("_row")).select("id", partition_key, "_row.*")


def upsert(df: DataFrame, fmt: str, options: Mapping[str, str] | None = None, path: str | None = None) -> None:
    """Hand prepared rows to a keyed store; the store's connector is named by its format and options."""
    writer = df.write.format(fmt).mode("append").options(**(options or {}))
    writer.save(path) if path else writer.save()
