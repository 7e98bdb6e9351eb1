"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomolake.llm.common import cut

#: Links that one task settles at most, some 16 bytes each.
FEW = 100_000
#: Tasks over which a round's join spreads the links of one node.
SALTS = 8


def _with_least(rows: DataFrame, least: DataFrame) -> DataFrame:
    """rows(u, v) with m of least(u, m); a node's many rows meet its least in SALTS tasks."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt")
    return salted.join(least.select("u", "m", every), ["u", "salt"]).select("u", "v", "m")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return _with_least(both, least).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = _with_least(edges, least).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return least.select("u", F.col("m").alias("v")).union(moved).distinct()


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node and its component's smallest, of all links of the task."""
    held = [(x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches]
    nodes, ends = np.unique(np.concatenate([np.zeros(0, np.int64), *(e for pair in zip(*held, strict=True) for e in pair)]), return_inverse=True)
    half = len(ends) // 2
    labels = local_labels(len(nodes), ends[:half], ends[half:])
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[labels])], ["node", "label"])


def connected_components(edges: DataFrame, most_rounds: int = 100, few: int = FEW) -> DataFrame:
    """node, label for every node of edges(u long, v long), label being the smallest node reachable.

    Rows with a null end or with u = v link nothing. At most `few` different links are settled by one task. More go
    through rounds of a few joins and pre-aggregated minima, each cut with a checkpoint; only one row (a count and a
    hash) reaches the driver per round. No edges give no rows.
    """
    now = cut(
        edges.where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    mark = _mark(now)
    if mark[0] <= few:
        return now.coalesce(1).mapInArrow(_solved, "node long, label long")
    for _ in range(most_rounds):
        now = cut(_small_star(_large_star(now)))
        before, mark = mark, _mark(now)
        if mark == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return stars.union(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def local_labels(n: int, a: np.ndarray, b: np.ndarray, labels: np.ndarray | None = None) -> np.ndarray:
    """Smallest index reachable for each of n nodes by links a-b, on top of what labels already joins."""
    labels = np.arange(n) if labels is None else labels
    while len(a):
        la, lb = labels[a], labels[b]
        apart = la != lb
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        if not len(a):
            break
        low = np.minimum(la, lb)
        np.minimum.at(labels, np.maximum(la, lb), low)
        while True:
            up = labels[labels]
            if np.array_equal(up, labels):
                break
            labels = up
    return labels
