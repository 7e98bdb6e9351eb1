"""Prefix scans over keys of any distribution: ranges of the key in order, and one carried row for each range."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tomolake.sources.tables import cut


def ranged(rows: DataFrame, keys: list[str], parts: int | None = None) -> DataFrame:
    """rows with part: cut into ranges of the keys by their own distribution, sorted in each, and written once, so that
    what follows reads each range in order and meets the same ranges again after a lost executor. Equal keys share a
    range."""
    dealt = rows.repartitionByRange(parts, *keys) if parts else rows.repartitionByRange(*keys)
    return cut(dealt.sortWithinPartitions(*keys).withColumn("part", F.spark_partition_id()))


def _before() -> Window:
    return Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)


def running_sum(rows: DataFrame, keys: list[str], size: str, name: str = "start", parts: int | None = None) -> DataFrame:
    """rows with name: the sum of the sizes (whole numbers) before each row in order of the keys; nulls count as zero.

    A range adds up on its own; the sums of whole ranges, one row each, are carried to the later ones.
    """
    dealt = ranged(rows.withColumn(size, F.coalesce(F.col(size).cast("long"), F.lit(0))), keys, parts)
    heads = dealt.groupBy("part").agg(F.sum(size).alias("t")).select("part", F.coalesce(F.sum("t").over(_before()), F.lit(0)).alias("head"))
    at = dealt.columns.index(size)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            ends = np.cumsum(batch.column(at).to_numpy()) + total
            yield batch.append_column("inner", pa.array(ends - batch.column(at).to_numpy(), pa.int64()))
            total = int(ends[-1]) if len(ends) else total

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema)
    found = dealt.mapInArrow(add, f"{kinds}, inner long").join(F.broadcast(heads), "part")
    return found.select(*rows.columns, (F.col("head") + F.col("inner")).alias(name))


def runs(rows: DataFrame, key: str, value: str, parts: int | None = None) -> DataFrame:
    """first, last, value of the runs of equal values (null is a value) in order of the key.

    A range yields its own runs; where it begins with the value that the range before ended with, the two runs are one.
    That is told by one row for each range: its first and last value, and how many runs it has.
    """
    kinds = rows.schema
    dealt = ranged(rows.select(F.col(key).alias("k"), F.col(value).alias("v")), ["k"], parts)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, held, schema = -1, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            k, v, part = batch.column(0), batch.column(1), batch.column(2)[0].as_py()
            schema = pa.schema([("part", pa.int32()), ("run", pa.int64()), ("first", k.type), ("last", k.type), ("v", v.type)])
            a, b = v.slice(1), v.slice(0, len(v) - 1)
            new = pc.if_else(pc.and_(pc.is_valid(a), pc.is_valid(b)), pc.not_equal(a, b), pc.xor(pc.is_valid(a), pc.is_valid(b))).to_numpy(zero_copy_only=False)
            starts = np.concatenate(([0], np.flatnonzero(new) + 1))
            ends = np.append(starts[1:], len(v)) - 1
            go_on = held is not None and held["v"] == v[0].as_py()
            first, last, values = k.take(pa.array(starts)).to_pylist(), k.take(pa.array(ends)).to_pylist(), v.take(pa.array(starts)).to_pylist()
            if go_on:
                first[0] = held["first"]
            elif held is not None:
                run += 1
                yield pa.RecordBatch.from_pylist([{"part": part, "run": run, **held}], schema)
            held = {"first": first[-1], "last": last[-1], "v": values[-1]}
            done = len(first) - 1
            if done:
                columns = [pa.array([part] * done, pa.int32()), pa.array(range(run + 1, run + 1 + done), pa.int64()), *(pa.array(x[:-1], t) for x, t in ((first, k.type), (last, k.type), (values, v.type)))]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)
                run += done
        if held is not None:
            yield pa.RecordBatch.from_pylist([{"part": part, "run": run + 1, **held}], schema)

    k_kind, v_kind = kinds[key].dataType, kinds[value].dataType
    found = cut(dealt.mapInArrow(own, f"part int, run long, first {k_kind.simpleString()}, last {k_kind.simpleString()}, v {v_kind.simpleString()}"))
    edges = found.groupBy("part").agg(F.min_by(F.struct("v"), "run").alias("head"), F.max_by(F.struct("v"), "run").alias("tail"), F.count("*").alias("n"))
    line = Window.orderBy("part")
    go_on = F.coalesce(F.col("head")["v"].eqNullSafe(F.lag("tail").over(line)["v"]) & F.lag("tail").over(line).isNotNull(), F.lit(False)).cast("long")
    edges = edges.withColumn("joined", go_on).select("part", (F.coalesce(F.sum("n").over(_before()), F.lit(0)) - F.sum("joined").over(line.rowsBetween(Window.unboundedPreceding, 0))).alias("so_far"))
    whole = found.join(F.broadcast(edges), "part").groupBy((F.col("run") + F.col("so_far")).alias("_r"))
    return whole.agg(F.min("first").alias("first"), F.max("last").alias("last"), F.first("v").alias("value")).drop("_r")
