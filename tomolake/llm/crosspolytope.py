"""Nearest neighbours by cross-polytope hashing: multiprobe tables of pseudo-random rotations, exact reranking.

Fast rotations (signs and Hadamard transforms, three times) send a unit vector near one signed axis. A table's bucket
is the axes of several rotations together, so that there are many buckets; their number follows from the rows'. A
query probes the buckets whose axes' coordinates have the largest sums. How many is read off an audit: sample queries
are held against every row, and each true neighbour says at which probe some table would have met it.

Rows go once per table to the part that holds their cell (a bucket less its last axis); a query goes once to each part
that holds a cell it may probe, with the sum at which its probing ends.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tomolake.llm.common import cut, tasks
from tomolake.llm.vectors import lists, matrix, products, usable

TABLES, NEAREST, SEED = 3, 20, 11
#: Queries that are audited, and the recall at which probing stops widening.
AUDIT, RECALL = 200, 0.96
#: Rows of a cell that one part holds; larger cells are dealt over several, which their queries all visit.
GROUP_ROWS = 20_000
#: Bytes of vectors that one part holds, about, and rows of a bucket, on the average, below which no axis is added.
PART_BYTES, BUCKET_ROWS = 64 << 20, 64
#: Rotations of a table at most, and probes that an audit tells apart.
MOST_AXES, MOST_PROBES = 3, 16_384
#: Sums that are formed at a time.
SUMS = 4_000_000
QUERY_BLOCK = 256

_FOUND = "query long, ids array<long>, scores array<double>"


def hadamard(x: np.ndarray) -> np.ndarray:
    """Orthonormal Walsh-Hadamard transform of each row; the width is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


@dataclass
class Tables:
    """The tables' rotations, `axes` for each. reach: the largest norm, if norms differ, so that the largest inner
    product is the smallest angle: each row gets one more coordinate that brings its norm to reach, queries a zero."""

    width: int
    rows: int
    tables: int = TABLES
    seed: int = SEED
    reach: float | None = None

    def __post_init__(self):
        self.padded = 1 << max(0, (self.width + (self.reach is not None) - 1)).bit_length()
        self.sides = 2 * self.padded
        self.axes = 2
        while self.axes < MOST_AXES and self.rows > BUCKET_ROWS * self.sides**self.axes:
            self.axes += 1
        self.cells = self.sides ** (self.axes - 1)
        self.signs = np.random.RandomState(self.seed).choice([-1.0, 1.0], (self.tables * self.axes, 3, self.padded))

    def turned(self, x: np.ndarray, rotation: int, query: bool) -> np.ndarray:
        """Coordinates along all signed axes: axis 0, its opposite, axis 1, ..."""
        y = np.zeros((len(x), self.padded))
        y[:, : self.width] = x
        if self.reach is not None and not query:
            y[:, self.width] = np.sqrt(np.maximum(self.reach**2 - (x * x).sum(1), 0))
        for k in range(3):
            y = hadamard(y * self.signs[rotation, k])
        return np.stack((y, -y), axis=2).reshape(len(y), -1)

    def buckets(self, x: np.ndarray, table: int) -> np.ndarray:
        """A row's bucket: its nearest signed axes, the last one the lowest digit. bucket // sides is its cell."""
        out = np.zeros(len(x), np.int64)
        for k in range(self.axes):
            out = out * self.sides + self.turned(x, table * self.axes + k, False).argmax(1)
        return out

    def axes_of(self, x: np.ndarray, table: int) -> np.ndarray:
        """Queries' coordinates: query, rotation, signed axis."""
        return np.stack([self.turned(x, table * self.axes + k, True) for k in range(self.axes)], axis=1)

    def sums(self, axes: np.ndarray, buckets: np.ndarray) -> np.ndarray:
        """query, bucket: how near each bucket is to each query."""
        out, place = np.zeros((len(axes), len(buckets))), self.sides ** np.arange(self.axes)[::-1]
        for k in range(self.axes):
            out += axes[:, k, buckets // place[k] % self.sides]
        return out

    def nearest_sums(self, axes: np.ndarray, most: int) -> np.ndarray:
        """The largest sums over all buckets, in falling order, at most `most` for each query.

        Any of the best sums begins with one of the best sums over the rotations before, so only those go on.
        """
        size, done = max(1, SUMS // (min(most, self.cells) * self.sides)), []
        for a in range(0, len(axes), size):
            some = axes[a : a + size]
            out = np.zeros((len(some), 1))
            for k in range(self.axes):
                out = (out[:, :, None] + some[:, k, None, :]).reshape(len(some), -1)
                out = -np.sort(-out, axis=1)[:, :most]
            done.append(out)
        return np.concatenate(done)


def best(ids: np.ndarray, rows: np.ndarray, rough: np.ndarray, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k ids of largest inner product, ties to the smaller id, chosen by rough products and settled exactly.

    An id that occurs more than once counts once, with its largest product.
    """
    most = min(len(rough), 4 * k)
    while True:
        near = np.argpartition(-rough, most - 1)[:most] if most < len(rough) else np.arange(len(rough))
        near = near[np.isfinite(rough[near])]
        if most == len(rough) or len(np.unique(ids[near])) >= k:
            break
        most = min(len(rough), 4 * most)
    if len(near) and most < len(rough):  # all that may tie with the last of the first k ids
        first = near[np.lexsort((ids[near], -rough[near]))]
        kept = first[np.sort(np.unique(ids[first], return_index=True)[1])[k - 1]]
        near = np.flatnonzero(rough >= rough[kept] - 1e-9 * max(1.0, abs(rough[kept])))
    score = products(rows[near], query)
    order = np.lexsort((ids[near], -score))
    order = order[np.sort(np.unique(ids[near][order], return_index=True)[1])[:k]]
    return ids[near][order], score[order]


def _audit(rows: DataFrame, queries: np.ndarray, ids: np.ndarray, turns: Tables, k: int) -> int:
    """Fewest probes at which the share of the sample queries' true nearest that a table meets is RECALL."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        axes = [turns.axes_of(queries, t) for t in range(turns.tables)]
        for batch in batches:
            own, x = batch.column(0).to_numpy(), matrix(batch.column(1))
            rough = queries @ x.T if len(own) else np.zeros((len(queries), 0))
            out: list[tuple] = []
            for q in range(len(queries) if len(own) else 0):
                rough[q][own == ids[q]] = -np.inf
                found, score = best(own, x, rough[q], queries[q], k)
                at = np.flatnonzero(np.isin(own, found))
                at = at[np.lexsort((own[at], -rough[q][at]))]
                at = at[np.unique(own[at], return_index=True)[1]]  # the best row of each id, by id
                sums = np.column_stack([turns.sums(axes[t][q : q + 1], turns.buckets(x[at], t))[0] for t in range(turns.tables)])
                place = np.searchsorted(own[at], found)
                out += zip([q] * len(found), found.tolist(), score.tolist(), sums[place].tolist(), strict=True)
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.float64()))
            columns = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["q", "id", "score", "sums"])

    found = rows.mapInArrow(scan, "q long, id long, score double, sums array<double>")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))
    met = found.withColumn("r", rank).where(F.col("r") <= k).select("q", "sums").collect()
    if not met:
        return 1
    which, sums = np.array([r["q"] for r in met]), np.array([r["sums"] for r in met])
    probes = np.full(len(met), MOST_PROBES)
    for t in range(turns.tables):
        tops = turns.nearest_sums(turns.axes_of(queries, t), MOST_PROBES)
        for q in range(len(queries)):
            own = np.flatnonzero(which == q)
            probes[own] = np.minimum(probes[own], np.searchsorted(-tops[q], -sums[own, t] - 1e-9))
    return int(np.sort(probes)[int(np.ceil(RECALL * len(probes))) - 1]) + 1


class Part:
    """Rows of a part in order of their buckets, (table, bucket) being one number."""

    def __init__(self, turns: Tables, buckets: np.ndarray, ids: np.ndarray, rows: np.ndarray):
        order = np.argsort(buckets, kind="stable")
        self.turns, self.ids, self.rows = turns, ids[order], rows[order]
        keys, self.starts = np.unique(buckets[order], return_index=True)
        self.ends = np.append(self.starts[1:], len(order))
        size = turns.cells * turns.sides
        self.keys = [(t, np.flatnonzero(keys // size == t), keys[keys // size == t] % size) for t in range(turns.tables)]

    def candidates(self, queries: np.ndarray, cuts: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(query, places of the rows in the buckets that it probes)."""
        chosen: list[list[np.ndarray]] = [[] for _ in queries]
        for t, at, buckets in self.keys:
            if len(at):
                near = self.turns.sums(self.turns.axes_of(queries, t), buckets) >= cuts[:, t, None] - 1e-9
                for q in np.flatnonzero(near.any(1)):
                    chosen[q].append(at[near[q]])
        for q, own in enumerate(chosen):
            if own:
                runs = np.concatenate(own)
                n = self.ends[runs] - self.starts[runs]
                yield q, np.repeat(self.starts[runs] - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _meet(turns: Tables, k: int):
    """Reads parts (part, role, cell, id, v, cuts), rows before queries, and gives each query's best k of its candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        number, part = None, None
        for batch in batches:
            numbers, roles = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(numbers) | np.diff(roles)) + 1, [len(numbers)]))
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if numbers[a] != number:
                    number, held, part = numbers[a], [], None
                own = batch.slice(a, b - a)
                ids, x = own.column(3).to_numpy(), matrix(own.column(4))
                if roles[a] == 0:
                    held.append((own.column(2).to_numpy(), ids, own.column(4)))
                    continue
                if part is None and held:
                    part = Part(turns, *(np.concatenate([h[c] for h in held]) for c in (0, 1)), np.concatenate([matrix(h[2]) for h in held]))
                    held = []
                if part is None:
                    continue
                limits = matrix(own.column(5))
                for at in range(0, len(ids), QUERY_BLOCK):
                    some, names, found = x[at : at + QUERY_BLOCK], ids[at : at + QUERY_BLOCK], []
                    for q, places in part.candidates(some, limits[at : at + QUERY_BLOCK]):
                        rough = part.rows[places] @ some[q]
                        rough[part.ids[places] == names[q]] = -np.inf
                        found.append((names[q], *best(part.ids[places], part.rows[places], rough, some[q], k)))
                    yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.list_(pa.int64())), pa.array([f[2] for f in found], pa.list_(pa.float64()))], ["query", "ids", "scores"])

    return run


def _merge(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query, held = None, {}

        def out() -> pa.RecordBatch:
            top = sorted(held.items(), key=lambda x: (-x[1], x[0]))[:k]
            n = len(top)
            return pa.RecordBatch.from_arrays([pa.array([query] * n, pa.int64()), pa.array(range(1, n + 1), pa.int32()), pa.array([i for i, _ in top], pa.int64()), pa.array([s for _, s in top], pa.float64())], ["query_id", "rank", "vec_id", "score"])

        for batch in batches:
            made = []
            for q, ids, scores in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if q != query:
                    if held:
                        made.append(out())
                    query, held = q, {}
                for i, s in zip(ids, scores, strict=True):
                    held[i] = max(s, held.get(i, s))
                if len(held) > 50 * k:
                    held = dict(sorted(held.items(), key=lambda x: (-x[1], x[0]))[:k])
            if made:
                yield pa.Table.from_batches(made).combine_chunks().to_batches()[0]
        if held:
            yield out()

    return run


def _search(rows: DataFrame, queries: DataFrame, turns: Tables, probes: int | None, groups: dict[int, int], parts: int, k: int) -> DataFrame:
    """query_id, rank, vec_id, score from the first `probes` buckets of each table; None: from all rows, by one table."""
    used, kind = turns.tables if probes else 1, rows.schema["v"].dataType.simpleString()
    names = ["part", "role", "cell", "id", "v", "cuts"]

    def of(cell: np.ndarray, piece: np.ndarray) -> np.ndarray:
        return ((cell + piece) % parts).astype(np.int32)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, x = batch.column(0).to_numpy(), matrix(batch.column(1))
            for t in range(used if len(own) else 0):
                bucket = t * turns.cells * turns.sides + turns.buckets(x, t)
                cell = bucket // turns.sides
                spread = np.array([groups.get(c, 1) for c in cell.tolist()], np.int64)
                none = pa.nulls(len(own), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array(of(cell, own % spread)), pa.array(np.zeros(len(own), np.int32)), pa.array(bucket), pa.array(own), batch.column(1), none], names)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        large = list(groups.items())
        for whole in batches:
            for a in range(0, whole.num_rows, QUERY_BLOCK):
                batch = whole.slice(a, QUERY_BLOCK)
                own, x = batch.column(0).to_numpy(), matrix(batch.column(1))
                limits, asked = np.full((len(own), turns.tables), np.inf), np.zeros((len(own), parts), bool)
                for t in range(used):
                    axes = turns.axes_of(x, t)
                    limits[:, t] = turns.nearest_sums(axes, probes)[:, -1] if probes else -np.inf
                    # A cell may be probed if its sum and the best last axis reach the limit.
                    first = np.zeros((len(own), 1))
                    for r in range(turns.axes - 1):
                        first = (first[:, :, None] + axes[:, r, None, :]).reshape(len(own), -1)
                    near = first + axes[:, -1].max(1)[:, None] >= limits[:, t, None] - 1e-9
                    q, cell = np.nonzero(near)
                    cell += t * turns.cells
                    asked[q, of(cell, 0)] = True
                    for c, pieces in large:
                        hit = q[cell == c]
                        for p in range(pieces):
                            asked[hit, of(np.int64(c), p)] = True
                q, part = np.nonzero(asked)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part.astype(np.int32)), pa.array(np.ones(len(q), np.int32)), pa.array(np.zeros(len(q), np.int64)), pa.array(own[q]), batch.column(1).take(pa.array(q)), lists(limits[q])], names,
                )

    n, schema = tasks(rows.sparkSession), f"part int, role int, cell long, id long, v {kind}, cuts array<double>"
    met = rows.mapInArrow(place, schema).unionByName(queries.mapInArrow(probe, schema)).repartitionById(parts, "part").sortWithinPartitions("part", "role")
    return met.mapInArrow(_meet(turns, k), _FOUND).repartition(n, "query").sortWithinPartitions("query").mapInArrow(_merge(k), "query_id long, rank int, vec_id long, score double")


def nearest(table: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = 20, k: int = NEAREST, tables: int = TABLES, group_rows: int = GROUP_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of each row whose id is divisible by `every`.

    Nearness is the inner product in double precision, ties to the smaller id; all rows but those of the query's own
    id are candidates. Queries that too few rows were found for are held against all rows, so each gets k, or all
    candidates if there are fewer; so are all queries, where probing would cost as much. Vectors that `usable` leaves
    out take no part; of rows that repeat an id each is a candidate, and the best counts; a query's vector is then the
    smallest; other columns are ignored; an empty table gives no rows.
    """
    spark = table.sparkSession
    kept = usable(table, key, vector)
    if table.schema[vector].dataType.simpleString() == "array<float>":  # the doubles are those floats
        kept = kept.withColumn("v", F.col("v").cast("array<float>"))
    rows = cut(kept)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x.cast("double")))
    facts = rows.agg(F.count("*").alias("n"), F.first(F.size("v")).alias("width"), F.min(norm).alias("low"), F.max(norm).alias("high")).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if not facts["n"]:
        return spark.createDataFrame([], schema)
    turns = Tables(facts["width"], facts["n"], tables, reach=facts["high"] if facts["high"] - facts["low"] > 1e-3 * facts["high"] else None)
    queries = cut(rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v")))
    sample = queries.orderBy(F.xxhash64("id"), "id").limit(AUDIT).collect()
    if not sample:
        return spark.createDataFrame([], schema)
    probes: int | None = _audit(rows, np.array([r["v"] for r in sample], np.float64), np.array([r["id"] for r in sample]), turns, k)
    if probes >= MOST_PROBES or tables * probes >= turns.cells * turns.sides:
        probes = None
    size = 8 if rows.schema["v"].dataType.simpleString() == "array<double>" else 4
    parts = max(tasks(spark), -(-facts["n"] * tables * facts["width"] * size // PART_BYTES))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1))
            cells = [t * turns.cells + turns.buckets(x, t) // turns.sides for t in range(turns.tables if len(x) else 0)]
            cell, n = np.unique(np.concatenate([np.zeros(0, np.int64), *cells]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(n)], ["cell", "n"])

    sizes = rows.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).where(F.col("n") > group_rows).collect()
    groups = {r["cell"]: min(parts, -(-r["n"] // group_rows)) for r in sizes}
    found = cut(_search(rows, queries, turns, probes, groups, parts, k))
    if probes is None:
        return found
    full = found.where(F.col("rank") == k).select(F.col("query_id").alias("id"))
    rest = cut(queries.join(full, "id", "left_anti"))
    if rest.isEmpty():
        return found
    again = _search(rows, rest, turns, None, groups, parts, k)
    return found.join(full.withColumnRenamed("id", "query_id"), "query_id", "left_semi").unionByName(again)
