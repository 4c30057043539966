"""Mixing sources to target weights by a low-discrepancy schedule of equal blocks (operator 2).  DataFrame functions only.

Slot i takes the point frac(i x golden ratio), here (i x 2654435769) mod 2^32, and belongs to the source in whose
share of the cumulative weights the point falls.  The r-th slot of a source takes the r-th block of its documents, laid
end to end in the order of a hash and repeated as often as the target asks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, Window

from rankeval.llm.arrow_rows import fresh
from rankeval.sources.staging import small, stage

WORD = r"[^\x20\x09-\x0D]+"
GOLDEN = 2654435769  # 2^32 / golden ratio
RANGE = 1 << 32
CELLS = 4096
HASH_BITS = 60


def words(text: Column) -> Column:
    """Number of runs of characters that are no ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def order_hash(id_col: str | Column) -> Column:
    """60 bits of the MD5 of the id as text: the order inside a source."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string") if isinstance(id_col, str) else id_col, F.lit(""))), 1, 15), 16, 10).cast("long")


def targets(sources: DataFrame, weights: Sequence[float], share: float, repeat: int) -> DataFrame:
    """``sources`` (``source``, ``source_size``, ``n_docs``) with ``idx``, ``weight`` and ``target``.

    Sources by code point, null last, take the weights in turn.  Targets are in proportion to the weights, none above
    ``repeat`` times its source, their sum ``share`` times all sizes: in the order of cap / weight, a source is capped
    as long as the level that the rest would get reaches its cap.  One row per source, so one window holds them all.
    """
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", "idx")
    listed = sources.withColumn("idx", F.row_number().over(by_name).cast("long") - 1)
    which = (F.col("idx") % len(weights) + 1).cast("int")
    listed = listed.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), which))
    listed = listed.withColumn("cap", F.col("source_size") * repeat).withColumn("ratio", F.col("cap") / F.col("weight"))
    earlier, later = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything) * F.lit(float(share))
    level = (total - F.coalesce(F.sum("cap").over(earlier), F.lit(0))) / F.sum("weight").over(later)
    listed = listed.withColumn("level", level).withColumn("free", F.col("ratio") > F.col("level"))
    final = F.min(F.when(F.col("free"), F.struct("ratio", "idx", "level"))).over(everything)["level"]
    listed = listed.withColumn("final", final)
    capped = F.col("final").isNull() | (F.col("cap") <= F.col("weight") * F.col("final"))
    target = F.when(capped, F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("final"))
    return listed.select("source", "source_size", "n_docs", "idx", "weight", target.alias("target"))


def schedule(sources: DataFrame, n_slots: int, block: int) -> DataFrame:
    """Slots (``slot``, ``idx``, ``rank``) for sources with ``idx`` and ``target``: as many for each source as its
    target has blocks.  Slots beyond that are left out; where the schedule ends before a source has its share, the
    missing ones follow at the end."""
    spark = sources.sparkSession
    need = F.ceil(F.floor("target") / F.lit(block)).cast("long")
    upto = Window.orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("target").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    edge = F.floor(F.try_divide(F.sum("target").over(upto), total) * RANGE).cast("long")
    edges = sources.withColumn("need", need).withColumn("hi", edge).withColumn("lo", F.coalesce(F.lag("hi").over(Window.orderBy("idx")), F.lit(0)))
    edges = edges.where("hi > lo").select("idx", "need", "lo", "hi")
    cells = edges.withColumn("cell", F.explode(F.sequence(F.expr(f"lo div {RANGE // CELLS}"), F.expr(f"(hi - 1) div {RANGE // CELLS}"))))
    points = spark.range(n_slots).select(F.col("id").alias("slot"), (F.col("id") % RANGE * GOLDEN % RANGE).alias("point") if n_slots < 1 << 31 else F.expr(f"((id % {RANGE}) * ({GOLDEN} div 65536) % {RANGE} * 65536 + (id % {RANGE}) * ({GOLDEN} % 65536)) % {RANGE}").alias("point"))
    points = points.withColumn("cell", F.expr(f"point div {RANGE // CELLS}"))
    taken = points.join(cells, "cell").where("point >= lo and point < hi").select("slot", "idx", "need")
    taken = taken.withColumn("chunk", F.expr("slot div 65536"))
    sums = taken.groupBy("idx", "chunk").count()
    before = Window.partitionBy("idx").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = stage(sums.withColumn("base", F.coalesce(F.sum("count").over(before), F.lit(0))))
    inside = F.row_number().over(Window.partitionBy("idx", "chunk").orderBy("slot")).cast("long") - 1
    ranked = taken.withColumn("at", inside).join(sums.select("idx", "chunk", "base"), ["idx", "chunk"])
    ranked = ranked.withColumn("rank", F.col("base") + F.col("at")).where("rank < need").select("slot", "idx", "rank")
    got = sums.groupBy("idx").agg(F.sum("count").alias("got"))
    short = sources.withColumn("need", need).join(got, "idx", "left").withColumn("got", F.coalesce("got", F.lit(0))).where("need > got")
    short = short.withColumn("rank", F.explode(F.sequence(F.col("got"), F.col("need") - 1)))
    n = sources.agg(F.max("idx") + 1).first()[0] or 1
    closing = short.select((F.lit(n_slots) + (F.col("rank") - F.col("got")) * n + F.col("idx")).alias("slot"), "idx", "rank")
    return ranked.unionByName(closing)


def lines(sized: DataFrame, rows_per_bucket: int = 8192) -> DataFrame:
    """``sized`` (``row``, ``idx``, ``h``, ``size``, ``n_docs``, ...) with ``at``: words before the document in its source,
    in the order of ``h``.  Sources are cut into buckets of the hash; a bucket's sum comes before its rows, so a source
    that holds most rows is spread like the others."""
    buckets = F.greatest(F.ceil(F.col("n_docs") / rows_per_bucket), F.lit(1))
    cut = sized.withColumn("bucket", F.floor(F.col("h") / F.lit(float(1 << HASH_BITS)) * buckets).cast("long"))
    sums = cut.groupBy("idx", "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("idx").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("idx", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("idx", "bucket").orderBy("h", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    cut = cut.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return cut.join(sums, ["idx", "bucket"]).withColumn("at", F.col("base") + F.col("inside")).drop("base", "inside", "bucket")


def mix(
    docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, repeat: int = 2, block: int = 1024,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> tuple[DataFrame, DataFrame]:
    """``(pieces, documents)`` of a mix whose sources take their targets' words, cut to whole words.

    ``pieces``: ``slot`` (their order), ``row``, ``doc_id``, ``source``, ``pass_no`` (0 for the first use), ``start``
    and ``length`` in words of the document.  ``documents``: one row per input row with ``row``, ``doc_id``, ``size``,
    ``fingerprint`` (of its text), ``source_size``, ``target`` and ``taken``.  Repeated ids are told apart by ``row``; a null text has no words, a null
    source is a source and the last; an empty table or one without words gives no piece.
    """
    sized = stage(docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
        words(F.col(text_col)).alias("size"), order_hash(id_col).alias("h"), F.xxhash64(text_col).alias("fingerprint"),
    ))
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    sources = small(targets(per_source, weights, share, repeat))
    wanted = sources.agg(F.sum("target")).first()[0] or 0.0
    rows = sized.alias("d").join(sources.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rows = stage(lines(rows))
    slots = schedule(sources, -(-int(wanted) // block), block)
    passes = rows.where("size > 0").withColumn("pass_no", F.explode(F.sequence(F.lit(0), F.lit(repeat - 1))))
    passes = passes.withColumn("lo", F.col("at") + F.col("pass_no") * F.col("source_size"))
    passes = passes.withColumn("hi", F.least(F.col("lo") + F.col("size"), F.floor("target").cast("long"))).where("hi > lo")
    cut = passes.withColumn("rank", F.explode(F.sequence(F.expr(f"lo div {block}"), F.expr(f"(hi - 1) div {block}"))))
    pieces = cut.join(slots, ["idx", "rank"])
    first = F.greatest(F.col("lo"), F.col("rank") * block)
    pieces = pieces.select(
        "slot", "row", "doc_id", "source", "pass_no", (first - F.col("lo")).alias("start"),
        (F.least(F.col("hi"), (F.col("rank") + 1) * block) - first).alias("length"),
    )
    taken = pieces.groupBy("row").agg(F.sum("length").alias("taken"))
    documents = rows.join(taken, "row", "left").select(
        "row", "doc_id", "fingerprint", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    return pieces, documents


def mixed(
    docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, repeat: int = 2, block: int = 1024,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """The documents of the mix with the columns of ``docs``: a row for each use of a document, its text cut to the words taken
    (then joined by single blanks), in the order of its first slot.  Rows alike in id and text are interchangeable."""
    pieces, documents = mix(docs, weights, share, repeat, block, id_col, text_col, source_col)
    name = {c: fresh(f"use_{c}", docs.columns) for c in ("id", "text", "size", "n", "pass_no", "slot", "hash", "mark", "cut")}
    uses = pieces.groupBy("row", "pass_no").agg(F.sum("length").alias("n"), F.min("slot").alias("slot"))
    uses = uses.join(documents, "row").select(F.col("doc_id").alias(name["id"]), F.col("fingerprint").alias(name["text"]), *[F.col(c).alias(name[c]) for c in ("size", "n", "pass_no", "slot")])
    uses = stage(uses)
    text_in, id_in = F.col(f"`{text_col}`"), F.col(f"`{id_col}`")
    marked = docs.withColumn(name["mark"], F.xxhash64(text_in))
    alike = documents.groupBy("doc_id", "fingerprint").count().where("count > 1")
    if not alike.isEmpty():  # each use of alike rows then takes the one that is left
        marked = marked.dropDuplicates([id_col, name["mark"]])
    found = marked.join(uses, id_in.eqNullSafe(F.col(name["id"])) & (F.col(name["mark"]) == F.col(name["text"])))
    cut = F.array_join(F.slice(F.regexp_extract_all(text_in, F.lit(WORD), F.lit(0)), F.lit(1), F.col(name["n"]).cast("int")), " ")
    text = F.when(F.col(name["n"]) < F.col(name["size"]), cut).otherwise(text_in)
    # inside a slot the documents follow as they lie in their source
    order = [name[c] for c in ("slot", "pass_no", "hash", "id", "size")]
    found = found.withColumn(name["hash"], order_hash(name["id"])).repartitionByRange(*order).sortWithinPartitions(*order)
    return found.withColumn(name["cut"], text).select(*[F.col(name["cut"]).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
