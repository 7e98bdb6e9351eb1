"""Run logs: parsing, pairing of starts and stops, merging, overlap and packing of intervals."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tomolake.operators.scans import runs

#: Seconds of a bucket of time.
WIDTH = 3600.0


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """t, level, pid, msg, kind (start or stop) of lines `t:level:pid:file:function:line: message (start)`; others go.

    A message is what stands after the last colon.
    """
    part = F.split("value", ":")
    text = F.trim(F.element_at(part, -1))
    kind = F.regexp_extract(text, r"\((start|stop)\)$", 1)
    rows = spark.read.text(path).where(F.size(part) >= 3)
    rows = rows.select(F.try_to_number(F.trim(part[0]), F.lit("99999999999999.99999999")).cast("double").alias("t"), F.trim(part[1]).alias("level"), F.trim(part[2]).alias("pid"), F.trim(F.regexp_replace(text, r"\((start|stop)\)$", "")).alias("msg"), kind.alias("kind"))
    return rows.where((F.col("kind") != "") & F.col("t").isNotNull())


def paired(marks: DataFrame) -> DataFrame:
    """pid, msg, number, start, stop, fault of marks(pid, msg, t, kind): each start with the last stop before the next.

    An unfinished start has no stop; a stop before any start is a row with a fault; a start while one is open marks
    the open one's fault.
    """
    key = Window.partitionBy("pid", "msg").orderBy("t", F.col("kind").desc())
    rows = marks.withColumn("number", F.sum((F.col("kind") == "start").cast("int")).over(key.rowsBetween(Window.unboundedPreceding, 0)))
    runs = rows.groupBy("pid", "msg", "number").agg(F.min(F.when(F.col("kind") == "start", F.col("t"))).alias("start"), F.max(F.when(F.col("kind") == "stop", F.col("t"))).alias("stop"))
    last = F.lead("number").over(Window.partitionBy("pid", "msg").orderBy("number")).isNull()
    fault = F.when(F.col("number") == 0, "stop without start").when(F.col("stop").isNull() & ~last, "start while open")
    return runs.select("pid", "msg", "number", "start", "stop", fault.alias("fault"))


def _by_time(spans: DataFrame, by: str, width: float, time: str = "start") -> DataFrame:
    return spans.withColumn("_bucket", F.floor(F.col(time) / width))


def numbered_islands(spans: DataFrame, by: str = "msg", width: float = WIDTH) -> DataFrame:
    """spans(by, start, stop) with island: the number, in its group, of the run of overlapping spans that it is in.

    Touching spans do not overlap. Spans are ordered within buckets of time; how far earlier buckets reach and how many
    islands they begin is carried by a row for each bucket, so no task sorts a whole group.
    """
    own = Window.partitionBy(by, "_bucket").orderBy("start", "stop")
    over = Window.partitionBy(by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    rows = _by_time(spans.select(by, "start", "stop"), by, width)
    ends = rows.groupBy(by, "_bucket").agg(F.max("stop").alias("_end"))
    ends = ends.withColumn("_carried", F.max("_end").over(over)).select(F.col(by).alias("_by"), F.col("_bucket").alias("_b"), "_carried")
    met = rows.join(ends, rows[by].eqNullSafe(ends["_by"]) & (rows["_bucket"] == ends["_b"]))
    reach = F.greatest(F.max("stop").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.col("_carried"))
    met = met.withColumn("_new", F.when(reach.isNull() | (F.col("start") >= reach), 1).otherwise(0))
    met = met.withColumn("_n", F.sum("_new").over(own.rowsBetween(Window.unboundedPreceding, 0))).drop("_by", "_b")
    begun = met.groupBy(by, "_bucket").agg(F.sum("_new").alias("_begun"))
    begun = begun.select(F.col(by).alias("_by"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_begun").over(over), F.lit(0)).alias("_before"))
    out = met.join(begun, met[by].eqNullSafe(begun["_by"]) & (met["_bucket"] == begun["_b"]))
    return out.select(by, "start", "stop", (F.col("_n") + F.col("_before")).alias("island"))


def islands(spans: DataFrame, by: str = "msg", width: float = WIDTH) -> DataFrame:
    """by, start, stop, n: overlapping spans(by, start, stop) of a group merged; touching ones are not overlapping."""
    rows = numbered_islands(spans, by, width)
    return rows.groupBy(by, "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.count("*").alias("n")).drop("island")


def overlap_counts(spans: DataFrame, by: str = "msg", width: float = WIDTH) -> DataFrame:
    """by, pairs: how many pairs of a group's spans overlap, without forming them.

    Spans sorted by start overlap with those before that have not stopped: a running count over starts and stops tells
    how many are open. It runs within buckets of time, on top of what a row for each bucket carries over.
    """
    marks = spans.select(by, F.col("start").alias("t"), F.lit(1).alias("kind")).union(spans.select(by, F.col("stop").alias("t"), F.lit(0).alias("kind")))
    marks = _by_time(marks, by, width, "t").withColumn("_step", F.when(F.col("kind") == 1, 1).otherwise(-1))
    own = Window.partitionBy(by, "_bucket").orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy(by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    marks = marks.withColumn("_open", F.coalesce(F.sum("_step").over(own), F.lit(0)))
    each = marks.groupBy(by, "_bucket").agg(F.sum("_step").alias("_step"), F.sum("kind").alias("_starts"), F.sum(F.col("kind") * F.col("_open")).alias("_pairs"))
    each = each.withColumn("_before", F.coalesce(F.sum("_step").over(over), F.lit(0)))
    return each.groupBy(by).agg(F.sum(F.col("_pairs") + F.col("_starts") * F.col("_before")).alias("pairs"))


def longest_messages(spans: DataFrame, discard: float) -> DataFrame:
    """msg, total of the messages whose durations are at least that part of the whole timeline's length."""
    span = spans.agg((F.max("stop") - F.min("start")).alias("whole"))
    totals = spans.groupBy("msg").agg(F.sum(F.col("stop") - F.col("start")).alias("total"))
    return totals.crossJoin(F.broadcast(span)).where(F.col("total") >= discard * F.col("whole")).select("msg", "total")


def packed(spans: DataFrame, by: str = "msg", width: float = WIDTH) -> DataFrame:
    """by, start, stop, line: each span on the lowest line that is free at its start.

    Where an island of overlapping spans begins, all lines are free; so islands are dealt over tasks, however many
    spans the group has. A task reads its islands' spans in order and holds the open lines only.
    """
    kinds = {f.name: f.dataType.simpleString() for f in spans.schema}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        island, busy, free, top = None, [], [], 0
        for batch in batches:
            lines = []
            for own in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if own[:2] != island:
                    island, busy, free, top = own[:2], [], [], 0
                while busy and busy[0][0] <= own[2]:
                    heapq.heappush(free, heapq.heappop(busy)[1])
                if free:
                    line = heapq.heappop(free)
                else:
                    line, top = top, top + 1
                heapq.heappush(busy, (own[3], line))
                lines.append(line)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in (0, 2, 3)), pa.array(lines, pa.int32())], [by, "start", "stop", "line"])

    rows = numbered_islands(spans, by, width).select(by, "island", "start", "stop")
    dealt = rows.repartition(by, "island").sortWithinPartitions(by, "island", "start", "stop")
    return dealt.mapInArrow(place, f"{by} {kinds[by]}, start {kinds['start']}, stop {kinds['stop']}, line int")


def change_ranges(rows: DataFrame, key: str, value: str, parts: int | None = None) -> DataFrame:
    """first, last, value of the runs of equal values in order of key, whatever the keys' distribution."""
    return runs(rows, key, value, parts)


def completed(spans: DataFrame) -> DataFrame:
    """spans that have a stop."""
    return spans.where("stop is not null and start is not null")


def first_messages(spans: DataFrame, most: int) -> DataFrame:
    """Spans of the first `most` (process, message, number), in order of their starts."""
    return spans.orderBy("start", "pid", "msg", "number").limit(most)


def view(marks: DataFrame, collapse_overlap: bool = False, collapse_pid: bool = False, discard: float = 0.0, most: int | None = None) -> DataFrame:
    """pid, msg, line, start, stop: the timeline of marks(pid, msg, t, kind), a line for each bar row.

    Unfinished spans are left out, of the first `most` spans if asked. Collapsed by process, the spans of a message
    share lines where they do not overlap (pid is null then); overlapping spans of a message may first be merged to
    one. Messages of less than the part discard of the log's length go.
    """
    spans = paired(marks).where("number > 0")
    spans = completed(first_messages(spans, most) if most else spans).select("pid", "msg", "start", "stop")
    whole = marks.agg((F.max("t") - F.min("t")).alias("whole"))
    if collapse_overlap:
        spans = islands(spans, "msg").select(F.lit(None).cast(spans.schema["pid"].dataType).alias("pid"), "msg", "start", "stop")
    if collapse_pid or collapse_overlap:
        spans = packed(spans, "msg").select(F.lit(None).cast(spans.schema["pid"].dataType).alias("pid"), "msg", "line", "start", "stop")
    else:
        spans = spans.withColumn("line", (F.row_number().over(Window.partitionBy("pid", "msg").orderBy("start", "stop")) - 1).cast("int"))
    if discard:
        totals = spans.groupBy("msg").agg(F.sum(F.col("stop") - F.col("start")).alias("total"))
        kept = totals.crossJoin(F.broadcast(whole)).where(F.col("total") >= discard * F.col("whole")).select("msg")
        spans = spans.join(kept, "msg", "left_semi")
    return spans.select("pid", "msg", "line", "start", "stop")


def processes(spans: DataFrame, by: str = "pid") -> DataFrame:
    """by, first, last, busy, n of each process; by order of the first start."""
    return spans.groupBy(by).agg(F.min("start").alias("first"), F.max("stop").alias("last"), F.sum(F.col("stop") - F.col("start")).alias("busy"), F.count("*").alias("n"))


def numbered(spans: DataFrame) -> DataFrame:
    """spans with number: how many of the same process and message came before."""
    return spans.withColumn("number", F.row_number().over(Window.partitionBy("pid", "msg").orderBy("start", "stop")) - 1)
