"""Embedding near-duplicates: a hierarchical navigable small-world graph per shard, searched by every vector.

Graphs are built and searched for many vectors at once with numpy: each step expands the best open candidates of all
queries of a batch. Candidates are verified by cosine in double precision; counts and a spanning part of the links
leave a task, never all pairs of a group.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomolake.llm.common import cut, read_file, shared_dir, tasks, write_file
from tomolake.llm.components import connected_components, local_labels
from tomolake.llm.vectors import matrix, usable

THRESHOLD = 0.9
#: Shards at least, and vectors of a shard at most, about.
SHARDS, SHARD_ROWS = 6, 50_000
#: Bytes of a shard's vectors, and of the vectors that search shards in one task, at most, about.
SHARD_BYTES, BLOCK_BYTES = 128 << 20, 64 << 20
#: Vectors that are worth a task, and shards that one task visits at most.
LEAST_ROWS, GROUP = 2000, 8
#: Neighbours of a node when it is added and at most, and the beam then and of a first search.
LINKS, MOST_LINKS, BUILD_BEAM, BEAM = 12, 24, 48, 32
#: Vectors of a shard, and of the whole table, that an audit compares with a shard, and the part of its own links that
#: each of them must find.
AUDIT, RECALL = 512, 0.998
#: Members that have links which an audit looks for, among at most so many times AUDIT.
LINKED, ROUNDS = 128, 8
#: Part of a shard's vectors beyond which no beam is widened: the shard is compared in full instead.
WIDEST = 1 / 16
#: Candidates expanded per step, queries searched together, and compared together with a whole shard.
STEP, BATCH, DENSE = 4, 256, 64
#: Pairs that are verified at a time.
PAIRS = 1_000_000


def _diverse(sims: np.ndarray, between: np.ndarray, most: int) -> np.ndarray:
    """Which candidates (columns, best first; -inf for none) each row keeps: those nearer to it than to any kept
    before, then the nearest of the others, most in all."""
    rows, n = sims.shape
    kept = np.zeros((rows, n), bool)
    closest = np.full((rows, n), -np.inf)
    for j in range(n):
        take = (sims[:, j] > closest[:, j]) & (kept.sum(1) < most) & np.isfinite(sims[:, j])
        kept[:, j] = take
        closest = np.where(take[:, None], np.maximum(closest, between[:, j]), closest)
    rest = np.isfinite(sims) & ~kept
    free = most - kept.sum(1)
    return kept | (rest & (np.cumsum(rest, axis=1) <= free[:, None]))


class Layer:
    def __init__(self, n: int):
        self.links = np.full((n, MOST_LINKS), -1, np.int32)


class Graph:
    """Layers over unit vectors, the sparsest first; a node of a layer is in all below it."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, copies: np.ndarray, seed: int = 5):
        self.vectors, self.ids, self.copies, self.beam, self.exact = vectors, ids, copies, BEAM, False
        self.near = vectors.astype(np.float32)
        n = len(ids)
        rank = np.random.RandomState(seed).permutation(n)
        sizes = [n]
        while sizes[-1] > 4 * LINKS:
            sizes.append(sizes[-1] // LINKS)
        self.layers: list[Layer] = []
        self.entry = rank[: sizes[-1]]
        for size in reversed(sizes):
            self._add_layer(rank[:size])

    def _add_layer(self, nodes: np.ndarray) -> None:
        upper, layer = list(self.layers), Layer(len(self.ids))
        self.layers.append(layer)
        done = min(len(nodes), 2 * LINKS)
        self._connect(layer, nodes[:done], np.zeros((done, 0), np.int64), nodes[:done])
        while done < len(nodes):
            new = nodes[done : done + min(BATCH, done)]
            start = self._descend(self.near[new], upper)
            found, _ = self._beam(self.near[new], layer, start, BUILD_BEAM)
            self._connect(layer, new, found, new)
            done += len(new)

    def _connect(self, layer: Layer, new: np.ndarray, found: np.ndarray, others: np.ndarray) -> None:
        """Links new nodes with the best of those found and of the others of their batch, both ways."""
        own = self.near[new] @ self.near[others].T
        own[new[:, None] == others[None, :]] = -np.inf
        few = min(LINKS, len(others))
        at = np.argpartition(-own, few - 1, axis=1)[:, :few]
        beside = np.where(np.isfinite(np.take_along_axis(own, at, 1)), others[at], -1)
        chosen = self._best(new, np.concatenate((found, beside), axis=1), LINKS)
        layer.links[new, : chosen.shape[1]] = chosen
        source, target = np.repeat(new, chosen.shape[1]), chosen.ravel()
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        nodes, first, count = np.unique(target, return_index=True, return_counts=True)
        wide = np.full((len(nodes), int(count.max(initial=0))), -1)
        wide[np.repeat(np.arange(len(nodes)), count), np.arange(len(target)) - np.repeat(first, count)] = source
        for a in range(0, len(nodes), BATCH):
            some = nodes[a : a + BATCH]
            back = self._best(some, np.concatenate((layer.links[some], wide[a : a + BATCH]), axis=1), MOST_LINKS)
            layer.links[some] = -1
            layer.links[some, : back.shape[1]] = back

    def _best(self, nodes: np.ndarray, candidates: np.ndarray, most: int) -> np.ndarray:
        """At most `most` diverse ones of each row's candidates (-1: none), repeats dropped."""
        ordered = np.sort(candidates, axis=1)
        ordered[:, 1:][ordered[:, 1:] == ordered[:, :-1]] = -1
        ordered[ordered == nodes[:, None]] = -1
        sims = np.where(ordered >= 0, np.einsum("rd,rcd->rc", self.near[nodes], self.near[ordered]), -np.inf)
        width = min(ordered.shape[1], 3 * most)
        at = np.argsort(-sims, axis=1, kind="stable")[:, :width]
        ordered, sims = np.take_along_axis(ordered, at, 1), np.take_along_axis(sims, at, 1)
        if width > most:
            x = self.near[ordered]
            keep = _diverse(sims, x @ x.transpose(0, 2, 1), most)
        else:
            keep = np.isfinite(sims)
        out = np.where(keep, ordered, -1)
        at = np.argsort(~keep, axis=1, kind="stable")[:, :most]
        return np.take_along_axis(out, at, 1)

    def _descend(self, queries: np.ndarray, layers: list[Layer]) -> np.ndarray:
        entry = self.entry[: 4 * LINKS]
        sims = queries @ self.near[entry].T
        at = entry[np.argsort(-sims, axis=1)[:, :2]]
        for layer in layers:
            at, _ = self._beam(queries, layer, at, 4)
        return at

    def _beam(self, queries: np.ndarray, layer: Layer, start: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The nodes (-1: none) and similarities that each query's beam ends with, best first."""
        n, rows = len(queries), np.arange(len(queries))
        seen = np.zeros((n, len(self.ids) + 1), bool)  # the last column stands for none
        seen[:, -1] = True
        ids = np.full((n, beam), -1)
        sims = np.full((n, beam), -np.inf, np.float32)
        open_ = np.zeros((n, beam), bool)

        def take(active: np.ndarray, new: np.ndarray) -> None:
            new = np.sort(new, axis=1)
            new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
            new[seen[active[:, None], new]] = -1
            seen[active[:, None], new] = True
            own = np.where(new >= 0, np.einsum("rd,rcd->rc", queries[active], self.near[new]), -np.inf)
            all_ids, all_sims = np.concatenate((ids[active], new), axis=1), np.concatenate((sims[active], own), axis=1)
            all_open = np.concatenate((open_[active], new >= 0), axis=1)
            at = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
            ids[active], sims[active] = np.take_along_axis(all_ids, at, 1), np.take_along_axis(all_sims, at, 1)
            open_[active] = np.take_along_axis(all_open, at, 1)

        take(rows, start.astype(np.int64))
        while True:
            active = np.flatnonzero(open_.any(1))
            if not len(active):
                return ids, sims
            best = np.argsort(~open_[active], axis=1, kind="stable")[:, :STEP]
            chosen = np.where(np.take_along_axis(open_[active], best, 1), np.take_along_axis(ids[active], best, 1), -1)
            mark = open_[active]
            np.put_along_axis(mark, best, False, 1)
            open_[active] = mark
            near = np.where(chosen[:, :, None] >= 0, layer.links[chosen], -1)
            take(active, near.reshape(len(active), -1).astype(np.int64))

    def links(self, queries: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, node) of the nodes found with cosine >= threshold, verified in double precision; BATCH queries at a time.

        A beam that ends full of such nodes may have left some out; those queries, of dense groups, are compared with
        the whole shard at once.
        """
        low = np.float32(threshold - 1e-4)
        for a in range(0, len(queries), BATCH):
            q = queries[a : a + BATCH]
            full = np.ones(len(q), bool)
            if not self.exact:
                some, beam = q.astype(np.float32), min(self.beam, len(self.ids))
                ids, sims = self._beam(some, self.layers[-1], self._descend(some, self.layers[:-1]), beam)
                full = (sims[:, -1] >= low) & (beam < len(self.ids))
                r, c = np.nonzero((sims >= low) & ~full[:, None])
                yield self._sure(q, r, ids[r, c], threshold, a)
            dense = np.flatnonzero(full)
            for b in range(0, len(dense), DENSE):
                rows = dense[b : b + DENSE]
                r, node = np.nonzero(q[rows].astype(np.float32) @ self.near.T >= low)
                yield self._sure(q, rows[r], node, threshold, a)

    def _sure(self, q: np.ndarray, rows: np.ndarray, nodes: np.ndarray, threshold: float, first: int) -> tuple[np.ndarray, np.ndarray]:
        keep = np.concatenate([np.zeros(0, bool), *(
            np.einsum("rd,rd->r", q[rows[c : c + PAIRS]], self.vectors[nodes[c : c + PAIRS]]) >= threshold for c in range(0, len(rows), PAIRS)
        )])
        return rows[keep] + first, nodes[keep]

    def within(self, queries: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """All of `links` at once, for audits and tests."""
        found = [(np.zeros(0, np.int64),) * 2, *self.links(queries, threshold)]
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def _compared(self, queries: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All (query, node) with cosine >= threshold, by a full comparison."""
        low = np.float32(threshold - 1e-4)
        for a in range(0, len(queries), DENSE):
            q = queries[a : a + DENSE]
            r, node = np.nonzero(q.astype(np.float32) @ self.near.T >= low)
            yield self._sure(q, r, node, threshold, a)

    def _sampled(self, threshold: float, others: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Vectors that have links here, their ids, and how many: of the sample others(ids, vectors) and of members."""
        order, most = np.random.RandomState(9).permutation(len(self.ids))[: ROUNDS * AUDIT], 0
        taken: tuple[list, list, list] = ([], [], [])
        foreign = [(others[0][a : a + BATCH], others[1][a : a + BATCH]) for a in range(0, len(others[0]), BATCH)]
        own = [(self.ids[order[a : a + BATCH]], self.vectors[order[a : a + BATCH]]) for a in range(0, len(order), BATCH)]
        for k, (ids, x) in enumerate(foreign + own):
            if k >= len(foreign) + AUDIT // BATCH and most >= LINKED:
                break
            links = self._counted(ids, self._compared(x, threshold))
            most += int((links > 0).sum()) if k >= len(foreign) else 0
            for part, value in zip(taken, (ids, x, links), strict=True):
                part.append(value[links > 0])
        ids, x, links = (np.concatenate(part) for part in taken)
        return x, ids, links

    def _counted(self, ids: np.ndarray, found: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Links of each of ids, itself not counted."""
        return sum((np.bincount(q[ids[q] != self.ids[node]], minlength=len(ids)) for q, node in found), np.zeros(len(ids), np.int64))

    def audited(self, threshold: float, others: tuple[np.ndarray, np.ndarray] | None = None) -> Graph:
        """Widens the beam until each sampled vector finds the part RECALL of its own links, itself not counted.

        Sampled are members and others (ids, vectors of the whole table). Where beams would have to grow beyond the
        part WIDEST of the shard, searches compare with all of it.
        """
        x, ids, links = self._sampled(threshold, others or (self.ids[:0], self.vectors[:0]))
        while len(ids) and not self.exact:
            found = self._counted(ids, self.links(x, threshold))
            if (found >= RECALL * links).all():
                break
            self.beam *= 2
            self.exact = self.beam > max(BEAM, WIDEST * len(self.ids))
        return self


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """(value, rows) of each run of equal values in the first column."""
    value, held = None, []
    for batch in batches:
        own = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(own)) + 1), len(own)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a < b and own[a] != value:
                if held:
                    yield value, held
                value, held = int(own[a]), []
            if a < b:
                held.append(batch.slice(a, b - a))
    if held:
        yield value, held


def _build(threshold: float, others: Broadcast, folder: str):
    """Writes a graph for each shard of rows (shard, id, copies, v); others: a sample (ids, vectors) of all shards.

    A file bears its task attempt in its name, and only those of finished attempts are returned.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        for shard, rows in _grouped(batches):
            ids, copies = (np.concatenate([b.column(k).to_numpy() for b in rows]) for k in (1, 2))
            graph = Graph(np.concatenate([matrix(b.column(3)) for b in rows]), ids, copies).audited(threshold, others.value)
            name = f"{folder}/graph-{shard}-{task.taskAttemptId()}"
            write_file(name, pickle.dumps(graph, protocol=5))
            yield pa.RecordBatch.from_pydict({"shard": [shard], "file": [name]})

    return run


def _visit(threshold: float, files: list[list[str]]):
    """Rows (cell, id, v), a cell being a block of vectors and a group of shards: per vector how many others link with
    it, and links that span what the cell found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, rows in _grouped(batches):
            ids, x = np.concatenate([b.column(1).to_numpy() for b in rows]), np.concatenate([matrix(b.column(2)) for b in rows])
            for file in files[cell % len(files)]:
                graph = pickle.loads(read_file(file))
                count, anchor, labels = np.zeros(len(ids), np.int64), np.full(len(ids), -1), np.arange(len(graph.ids))
                for q, node in graph.links(x, threshold):
                    other = ids[q] != graph.ids[node]
                    q, node = q[other], node[other]
                    if len(q):
                        count += np.bincount(q, graph.copies[node], len(ids)).astype(np.int64)
                        anchor[q[::-1]] = node[::-1]
                        labels = local_labels(len(labels), anchor[q], node, labels)
                linked, moved = np.flatnonzero(count), np.flatnonzero(labels != np.arange(len(labels)))
                first = np.concatenate((ids[linked], graph.ids[moved]))
                second = np.concatenate((graph.ids[anchor[linked]], graph.ids[labels[moved]]))
                n = np.concatenate((count[linked], np.zeros(len(moved), np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(first), pa.array(n), pa.array(second)], ["id", "n", "other"])

    return run


def near_duplicates(table: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of table.

    Vectors with cosine >= threshold link; exact copies stand for one node with a count, and each links with the
    others. Vectors that `usable` leaves out link with nothing; a row without an id is kept and its component is
    null; rows that repeat an id are told apart by their vectors only and share the id's component. Other columns
    are ignored; an empty table gives no rows.
    """
    spark = table.sparkSession
    # Two hashes stand for a vector wherever rows are grouped or joined by it.
    rows = usable(table, key, vector).withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit(1), "v"))
    nodes = cut(rows.groupBy("h1", "h2").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("v").alias("v")))
    facts = nodes.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    total, width = facts["n"], max(facts["width"] or 1, 1)
    shards = max(SHARDS, -(-total // max(1, min(shard_rows, SHARD_BYTES // (12 * width)))))
    groups = -(-shards // GROUP)
    blocks = max(1, -(-total // max(1, BLOCK_BYTES // (8 * width))), min(tasks(spark), -(-total // LEAST_ROWS)))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    # Scaled by the largest component first, so that no square overflows or vanishes.
    most = F.array_max(F.transform("v", lambda x: F.abs(x)))
    unit = nodes.withColumn("m", most).withColumn("v", F.transform("v", lambda x: x / F.col("m")))
    unit = unit.withColumn("m", norm).select("id", "copies", F.transform("v", lambda x: x / F.col("m")).alias("v"))
    unit = unit.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    unit = cut(unit.withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int")))

    some = unit.select("id", "v").orderBy(F.xxhash64("id", F.lit(2)), "id").limit(AUDIT).collect()
    ids = np.array([r["id"] for r in some], np.int64)
    others = spark.sparkContext.broadcast((ids, np.array([r["v"] for r in some], np.float64).reshape(len(ids), width)))
    folder = f"{shared_dir(spark)}/graphs-{uuid.uuid4().hex}"
    dealt = unit.select("shard", "id", "copies", "v").repartitionById(shards, "shard").sortWithinPartitions("shard", "id")
    built = sorted((r["shard"], r["file"]) for r in dealt.mapInArrow(_build(threshold, others, folder), "shard long, file string").collect())
    files = [[file for _, file in built[g::groups]] for g in range(groups)]
    every = F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g")
    cells = unit.select("block", every, "id", "v").select((F.col("block") * groups + F.col("g")).alias("cell"), "id", "v")
    met = cells.repartitionById(blocks * groups, "cell").sortWithinPartitions("cell", "id")
    found = cut(met.mapInArrow(_visit(threshold, files), "id long, n long, other long"))

    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    labels = connected_components(found.select(F.col("id").alias("u"), F.col("other").alias("v")))
    known = nodes.join(counts, "id", "left").join(labels.withColumnRenamed("node", "id"), "id", "left")
    known = known.select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("label", "id").alias("component_id"))
    linked = rows.select("id", "h1", "h2").join(known, ["h1", "h2"]).groupBy("id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    out = table.select(F.col(key).cast("long").alias("vec_id")).join(linked, F.col("vec_id") == F.col("id"), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
