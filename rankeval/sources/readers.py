"""Reading tables, JSON lines, CSV, TSV, metric files and logs."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce
from urllib.parse import quote

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from rankeval.functions.text import strip
from rankeval.operators.flatten import flatten_impressions, with_missing_columns


def read_parquet(
    spark: SparkSession, path: str | Sequence[str], columns: Mapping[str, str] | None = None, partitioned: bool = False
) -> DataFrame:
    """A file, a directory (at any depth) or a glob; only the wanted columns, absent ones as nulls.

    Files may store a wanted column in different types: files are grouped by what their footers say, each group is scanned with
    its own types and cast to the wanted ones, nested values to text as JSON.  ``partitioned`` reads ``column=value`` folders
    with their partition column (set ``spark.sql.sources.partitionColumnTypeInference.enabled`` to false to keep yyyyMMdd a
    text) instead of searching the tree for files.  A path without any file is an error.
    """
    paths = [path] if isinstance(path, str) else list(path)
    if not paths:
        raise FileNotFoundError("no parquet path given")
    reader = lambda: spark.read if partitioned else spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
    if not columns:
        return reader().option("mergeSchema", "true").parquet(*paths)
    groups = _file_groups(spark, paths, list(columns))
    if not groups:  # folders without files
        typed = ", ".join(f"`{c}` {t}" for c, t in columns.items())
        return with_missing_columns(reader().schema(typed).parquet(*paths), dict(columns))
    if len(groups) == 1:
        scans = [reader().parquet(*paths)]
    else:
        base = {"basePath": paths[0]} if partitioned and len(paths) == 1 else {}
        scans = [spark.read.options(**base).parquet(*files) for files in groups]
    return reduce(DataFrame.unionByName, [_as_wanted(df, columns) for df in scans])


def _as_wanted(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """The wanted columns in the wanted types; a column that is stored as wanted stays bare, so that filters reach the scan."""
    wanted = df.sparkSession.createDataFrame([], ", ".join(f"`{c}` {t}" for c, t in columns.items())).schema
    nested = (T.ArrayType, T.MapType, T.StructType)

    def one(name: str) -> Column:
        to = wanted[name].dataType
        if name not in df.columns:
            return F.lit(None).cast(to).alias(name)
        c, stored = F.col(f"`{name}`"), df.schema[name].dataType
        if stored == to:
            return c
        if isinstance(stored, nested) and isinstance(to, T.StringType):
            return F.to_json(c).alias(name)
        if isinstance(stored, T.StringType) and isinstance(to, nested):
            return F.from_json(c, to).alias(name)
        return c.cast(to).alias(name)

    return df.select([one(name) for name in columns])


def _stored_types(path: str, columns: Sequence[str]) -> str | None:
    """The types that a file's footer gives for the columns, as text; None where this file system is only Spark's."""
    scheme, _, rest = path.partition(":")
    try:
        fs, at = (pafs.LocalFileSystem(), "/" + rest.lstrip("/")) if scheme == "file" else pafs.FileSystem.from_uri(quote(path, safe=":/"))
        schema = pq.read_schema(at, filesystem=fs)
    except (pa.ArrowException, OSError):
        return None
    return "; ".join(f"{c}: {schema.field(c).type if c in schema.names else None}" for c in columns)


def _file_groups(spark: SparkSession, paths: Sequence[str], columns: Sequence[str]) -> list[list[str]]:
    """The files below the paths, grouped by the stored types of the columns; one group is not split further.

    Footers are read in tasks.  Files that only Spark can open are asked for one by one.  The list of files is the driver's, as
    with every scan.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(list(paths)).select("path")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_stored_types(p, columns) for p in names], pa.string())], names=["path", "kinds"])

    found = files.mapInArrow(task, "path string, kinds string").groupBy("kinds").agg(F.collect_list("path").alias("files")).collect()
    groups: dict[str, list[str]] = {}
    for r in found:
        if r["kinds"] is not None:
            groups.setdefault(r["kinds"], []).extend(r["files"])
            continue
        for p in r["files"]:
            schema = spark.read.parquet(p).schema
            key = "; ".join(f"{c}: {schema[c].dataType.simpleString() if c in schema.names else None}" for c in columns)
            groups.setdefault(key, []).append(p)
    return [sorted(g) for _, g in sorted(groups.items())]


def scan_day(spark: SparkSession, table_or_path: str | DataFrame, day: str, column: str = "bizdate") -> DataFrame:
    """One day of a table; the equality prunes partitions."""
    if isinstance(table_or_path, DataFrame):
        df = table_or_path
    else:
        df = spark.read.parquet(table_or_path) if "/" in table_or_path else spark.table(table_or_path)
    return df.where(F.col(column) == F.lit(day))


def date_range(spark: SparkSession, start: str, end: str) -> DataFrame:
    """One yyyyMMdd per day, both ends included."""
    day = lambda s: F.to_date(F.lit(s), "yyyyMMdd")
    days = F.sequence(day(start), day(end), F.expr("interval 1 day"))
    return spark.range(1).select(F.explode(days).alias("_d")).select(F.date_format("_d", "yyyyMMdd").alias("bizdate"))


def missing_days(wanted: DataFrame, existing: DataFrame, column: str = "bizdate") -> DataFrame:
    """Wanted days that are not there yet."""
    return wanted.join(existing.select(column).distinct(), column, "left_anti")


def prepare_day(feeds: DataFrame, day: str, tag: str, require_features: bool = True) -> DataFrame:
    """Flattened rows of one day and tag; a blank date belongs to no day."""
    return flatten_impressions(feeds.where(F.col("bizdate") == day), "", "", tag, require_features)


SAMPLE_DEFAULTS = {"feed_id": "", "user_id": "", "bizdate": "", "flight_ids": "", "is_tagged": 0}


def read_jsonl(
    spark: SparkSession, path: str, schema: str | T.StructType, defaults: Mapping[str, object] | None = None,
    on_error: str = "fail", limit: int | None = None,
) -> DataFrame:
    """JSON lines with typed columns; blank lines are skipped, absent fields get their default.

    ``on_error="fail"`` stops at the first bad line, "skip" leaves bad lines out (count them with
    :func:`bad_lines`).
    """
    struct = spark.createDataFrame([], schema).schema if isinstance(schema, str) else schema
    if on_error == "fail":
        df = spark.read.schema(struct).option("mode", "FAILFAST").json(path)
    else:
        df = spark.read.schema(struct).option("mode", "DROPMALFORMED").json(path)
    given = SAMPLE_DEFAULTS if defaults is None else defaults
    df = df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in given.items() if c in df.columns})
    if "history" in df.columns and (defaults is None):
        empty = F.expr(f"cast(array() as {df.schema['history'].dataType.simpleString()})")
        df = df.withColumn("history", F.coalesce("history", empty))
    if not limit:
        return df
    # the first rows by file and place in it
    order = ["_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id()]
    return df.orderBy(*order).limit(limit)


def bad_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines and unparsable lines per file; blank lines are no lines."""
    lines = spark.read.text(path).select("value", "_metadata.file_name").where(strip(F.col("value")) != "")
    bad = F.try_parse_json("value").isNull()
    return lines.groupBy("file_name").agg(F.count("*").alias("lines"), F.count_if(bad).alias("bad"))


def read_bench_csv(spark: SparkSession, path: str, columns: Sequence[str], text: Sequence[str] = ("status_counts",)) -> DataFrame:
    """Benchmark rows with a header; every column a double but the text ones."""
    fields = [T.StructField(c, T.StringType() if c in text else T.DoubleType()) for c in columns]
    return spark.read.schema(T.StructType(fields)).csv(path, header=True, quote='"', escape='"', enforceSchema=False)


def read_tsv_titles(spark: SparkSession, path: str, min_fields: int = 6) -> DataFrame:
    """Title (field 5) and body (field 6) of tab-separated lines with enough fields, with their place.

    ``file`` and ``line`` keep the order of the input: lines are numbered by their offset inside the file.
    """
    lines = spark.read.text(path).select(strip(F.col("value")).alias("value"), "_metadata.file_path", "_metadata.file_block_start",
                                         F.monotonically_increasing_id().alias("_id"))
    parts = F.split("value", "\t", -1)
    kept = lines.withColumn("_p", parts).where(F.size("_p") >= min_fields)
    return kept.select(
        strip(F.get("_p", F.lit(4))).alias("title"), strip(F.get("_p", F.lit(5))).alias("body"),
        F.col("file_path").alias("file"), F.col("file_block_start").alias("block"), F.col("_id").alias("line"),
    )


def collect_metric_files(spark: SparkSession, glob: str, prefix: str = "eval_") -> DataFrame:
    """Metric rows of many JSON array files, run and checkpoint read from the file names, sorted.

    ``eval_<run>_<checkpoint>.json``; a name without the second part gets "?".  Unreadable files are skipped.
    """
    schema = "split string, n bigint, pos bigint, neg bigint, ctr double, auc double, _corrupt string"
    rows = (
        spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt").json(glob).select("*", "_metadata.file_name")
    )
    name = F.regexp_replace(F.regexp_replace("file_name", r"\.json$", ""), f"^{prefix}", "")
    kept = rows.where(F.col("_corrupt").isNull() & F.col("split").isNotNull())
    rest = F.regexp_extract(name, r"^[^_]*_(.*)$", 1)
    return kept.select(
        F.substring_index(name, "_", 1).alias("run"),
        F.when(F.contains(name, F.lit("_")), rest).otherwise("?").alias("checkpoint"),
        "split", "n", "pos", "ctr", "auc",
    ).orderBy("run", "checkpoint", "split")


def extract_report_lines(spark: SparkSession, path: str, prefixes: Sequence[str] = ("ALL ", "tagged ", "untagged ")) -> DataFrame:
    """Trimmed log lines that start with one of the prefixes, split at white space."""
    lines = spark.read.text(path).select(strip(F.col("value")).alias("line"), F.col("_metadata.file_name").alias("file"))
    cond = F.lit(False)
    for p in prefixes:
        cond = cond | F.col("line").startswith(p)
    return lines.where(cond).withColumn("fields", F.split("line", r"\s+"))


def last_match(line: Column, pattern: str, group: int, place: Column) -> Column:
    """Value of the last line (by place) that matches."""
    found = F.regexp_extract(line, pattern, group)
    hit = line.rlike(pattern)
    return F.max_by(F.when(hit, found), F.when(hit, place))


def extract_run_log(spark: SparkSession, path: str, exit_codes: DataFrame | None = None) -> DataFrame:
    """Per log file the last throughput and peak-memory figures and a status.

    OOM wins over a non-zero exit code (``exit_codes``: file, exit_code), anything else is OK.
    """
    logs = spark.read.text(path).select(
        "value", F.col("_metadata.file_name").alias("file"), F.struct("_metadata.file_block_start", F.monotonically_increasing_id().alias("i")).alias("place")
    )
    v, at = F.col("value"), F.col("place")
    # fixed patterns
    per = logs.groupBy("file").agg(
        last_match(v, r"train_samples_per_second['\":= ]+([0-9.]+)", 1, at).alias("samples_per_second"),
        last_match(v, r"train_steps_per_second['\":= ]+([0-9.]+)", 1, at).alias("steps_per_second"),
        last_match(v, r"max memory:?\s*([0-9.]+)\s*(GiB|GB)", 1, at).alias("peak_memory"),
        F.bool_or(v.rlike("OutOfMemoryError|CUDA out of memory")).alias("_oom"),
    )
    if exit_codes is None:
        code = F.lit(0)
    else:
        per = per.join(exit_codes, "file", "left")
        code = F.coalesce("exit_code", F.lit(0))
    status = F.when(F.col("_oom"), "OOM").when(code != 0, F.concat(F.lit("FAIL("), code.cast("string"), F.lit(")"))).otherwise("OK")
    return per.withColumn("status", status).select("file", "samples_per_second", "steps_per_second", "peak_memory", "status")


def profile_table(df: DataFrame, width: int = 200) -> DataFrame:
    """Name, type and a preview of the first row's value per column."""
    cells = F.array(
        *[
            F.struct(
                F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"),
                F.substring(F.col(f.name).cast("string") if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) else F.to_json(f.name), 1, width).alias("preview"),
            )
            for f in df.schema
        ]
    )
    return df.limit(1).select(F.inline(cells))


def file_profile(df: DataFrame) -> DataFrame:
    """Files of a file-backed table with their size and rows."""
    return df.select("_metadata.file_path", "_metadata.file_size").groupBy("file_path").agg(
        F.max("file_size").alias("bytes"), F.count("*").alias("rows")
    )

