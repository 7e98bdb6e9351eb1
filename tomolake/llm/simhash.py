"""SimHash near-duplicates: fingerprints, BK-trees over shards of them, and components of their links.

Fingerprints of 64 bits link within a few bits. Texts of a given shingle similarity are found by longer fingerprints,
whose distance tells the angle between shingle sets, and so their similarity, to within a few hundredths.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomolake.llm.common import cut, map_batches, pieces, raw_texts, released, tasks, words_of
from tomolake.llm.components import connected_components, local_labels

#: Differing bits up to which two fingerprints link.
RADIUS = 3
#: Words in a shingle.
SHINGLE = 3
#: A shard of more fingerprints than this is dealt once more by its other bits.
SHARD_LIMIT = 20_000
#: Queries that search a forest at once; bounds the frontier's memory.
SEARCH_BLOCK = 4096

#: A group of more codes than this is first searched from so many of its codes for components that fill it.
CROWD, LEADERS = 512, 16
#: Words in a shingle, and shingle similarity, of texts that are near copies.
SIMILAR_SHINGLE, SIMILARITY = 5, 0.8
#: 64-bit words of a long fingerprint, and bits of a band of it.
LONG_WORDS, BAND_BITS = 8, 16
#: Standard deviations of the distance at a similarity: pairs so many under its mean link without a look at their texts,
#: pairs up to so many over it are looked at.
SURE, WIDER = 3.0, 2.0
#: Neighbours in a shard that a code is held against as pairs of rows, of those to be looked at; the rest follow inside tasks.
NEIGHBOURS = 16
#: Bands that are searched before the others, and neighbours of a code there: crowds of near copies are one component after.
FIRST_BANDS, FIRST_NEIGHBOURS = 4, 4
#: Bits of the filters that tell most texts that need not be looked at, or sent; and bits of a piece of Spark's bitmaps.
FILTER_BITS, PIECE_BITS = 1 << 24, 32_768

_SPREAD = np.uint64(0x0101010101010101)


def shingle_hashes(text: bytes, width: int = SHINGLE) -> list[int]:
    """XXH64 (seed 42) of each shingle: width words joined by one space; fewer words make one shingle."""
    words = words_of(text)
    if not words:
        return []
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(b" ".join(words), 42)]
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[: -width] + 1))
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], 42) for a, b in zip(starts.tolist(), ends[width - 1 :].tolist(), strict=True)]


def majority_bits(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Per run of sizes hashes, the 64-bit code whose bits are set in over half of the run; empty runs give zero.

    Bits are counted in parallel, eight to a word: shifted words masked to one bit in each byte add up without
    overflow over blocks of up to 255 hashes, and the blocks' byte sums are then added per run.
    """
    out = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    sizes = sizes[full]
    blocks = (sizes + 254) // 255
    first_block = np.cumsum(blocks) - blocks
    run_start = np.cumsum(sizes) - sizes
    within = np.arange(blocks.sum()) - np.repeat(first_block, blocks)
    starts = np.repeat(run_start, blocks) + 255 * within
    for shift in range(8):
        per_block = np.add.reduceat((hashes >> np.uint64(shift)) & _SPREAD, starts)
        per_byte = per_block.view(np.uint8).reshape(-1, 8).astype(np.int64)
        counts = np.add.reduceat(per_byte, first_block, axis=0)
        bits = (2 * counts > sizes[:, None]).astype(np.uint8)
        out[full] |= np.ascontiguousarray(bits).view(np.uint64).ravel() << np.uint64(shift)
    return out


def fingerprint_batch(texts: list[bytes], width: int = SHINGLE) -> np.ndarray:
    """Fingerprints, taking up to about a million shingles at a time."""
    done, held, sizes, total = [], [], [], 0
    for text in texts:
        own = shingle_hashes(text, width)
        held.append(np.array(own, np.uint64))
        sizes.append(len(own))
        total += len(own)
        if total > 1_000_000:
            done.append(majority_bits(np.concatenate(held), np.array(sizes)))
            held, sizes, total = [], [], 0
    if sizes:
        done.append(majority_bits(np.concatenate(held), np.array(sizes)))
    return np.concatenate(done) if done else np.zeros(0, np.uint64)


def fingerprints(docs: DataFrame, key: str | Column = "doc_id", text: str | Column = "text", width: int = SHINGLE) -> DataFrame:
    """doc_id, fp (long) of each row; null and wordless texts have fingerprint zero."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        codes = fingerprint_batch(raw_texts(batch.column(1)), width).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes)], ["doc_id", "fp"])

    pick = [F.col(c) if isinstance(c, str) else c for c in (key, text)]
    source = docs.select(pick[0].alias("doc_id"), pick[1].cast("string").alias("text"))
    return map_batches(source, run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, fp long")


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of codes, row by row."""
    bits = np.bitwise_count(a ^ b)
    return (bits.sum(axis=1) if bits.ndim > 1 else bits).astype(np.int64)


class BKForest:
    """A BK-tree for each group of distinct codes, built and searched level by level for all groups at once.

    The first code of a group is its root. A child hangs under its parent at the edge that is their Hamming
    distance, so every code below an edge e is exactly e bits from the parent; a search that is d bits from a node
    need only follow edges d - radius to d + radius.
    """

    def __init__(self, group: np.ndarray, codes: np.ndarray):
        """group: dense ids from 0, one per code; a code is a number, or a row of several."""
        self.codes, self.span = codes, 64 * (codes.shape[1] if codes.ndim > 1 else 1) + 1
        self.roots = np.full(int(group.max()) + 1 if len(group) else 0, -1)
        waiting, slot = np.arange(len(codes)), group.astype(np.int64)
        keys, nodes, at_root = [], [], True
        while len(waiting):
            order = np.argsort(slot, kind="stable")
            waiting, slot = waiting[order], slot[order]
            new = np.concatenate(([True], slot[1:] != slot[:-1]))
            placed = waiting[new]
            if at_root:
                self.roots[slot[new]] = placed
                at_root = False
            else:
                keys.append(slot[new])
                nodes.append(placed)
            parent = placed[np.cumsum(new) - 1][~new]
            waiting = waiting[~new]
            slot = parent * self.span + distances(codes[waiting], codes[parent])
        key = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        order = np.argsort(key)
        self.edges, self.children = key[order], (np.concatenate(nodes)[order] if nodes else key)

    def search(self, queries: np.ndarray, groups: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) of all codes within radius of each query in its own group's tree."""
        q, node, found = np.arange(len(queries)), self.roots[groups], ([], [])
        while len(q):
            d = distances(queries[q], self.codes[node])
            near = d <= radius
            found[0].append(q[near])
            found[1].append(node[near])
            low = np.searchsorted(self.edges, node * self.span + np.maximum(d - radius, 0), "left")
            high = np.searchsorted(self.edges, node * self.span + np.minimum(d + radius, self.span - 1), "right")
            fan = high - low
            q = np.repeat(q, fan)
            first = np.cumsum(fan) - fan
            node = self.children[np.repeat(low - first, fan) + np.arange(len(q))]
        return (np.concatenate(found[0]), np.concatenate(found[1])) if found[0] else (q, node)


def spanning_links(group: np.ndarray, codes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within radius inside each group, reduced to fewer than one per code: the places of a code and of its
    component's first. Groups lie together."""
    labels = np.arange(len(codes))
    waiting = np.ones(len(codes), bool)
    bounds = np.flatnonzero(np.diff(group, prepend=-1, append=-1))
    for a, b in zip(bounds, bounds[1:], strict=False):
        if b - a > CROWD:
            _peel(codes[a:b], labels[a:b], waiting[a:b], a, radius)
    rest = np.flatnonzero(waiting)
    forest = BKForest(np.unique(group[rest], return_inverse=True)[1], codes[rest])
    own = np.unique(group[rest], return_inverse=True)[1]
    for at in range(0, len(rest), SEARCH_BLOCK):
        q, node = forest.search(codes[rest[at : at + SEARCH_BLOCK]], own[at : at + SEARCH_BLOCK], radius)
        labels = local_labels(len(codes), rest[q + at], rest[node], labels)
    moved = np.flatnonzero(labels != np.arange(len(codes)))
    return moved, labels[moved]


def _peel(codes: np.ndarray, labels: np.ndarray, waiting: np.ndarray, first: int, radius: int) -> None:
    """Takes whole components out of a large group, so that one of many near copies does not meet itself pair by pair.

    From a few spread codes on, all that is within reach is gathered step by step, each code being held only against
    those not yet gathered. What is gathered gets its component's label and waits no more.
    """
    for start in np.linspace(0, len(codes) - 1, LEADERS).astype(np.int64):
        front, inside = np.array([start]) if waiting[start] else np.zeros(0, np.int64), [start]
        waiting[front] = False
        while len(front):
            out = np.flatnonzero(waiting)
            hit = np.zeros(len(out), bool)
            for at in range(0, len(front), max(1, 200_000 // max(len(out), 1))):
                some, open_ = front[at : at + max(1, 200_000 // max(len(out), 1))], np.flatnonzero(~hit)
                a, b = np.repeat(some, len(open_)), np.tile(open_, len(some))
                near = distances(codes[a], codes[out[b]]) <= radius
                hit[b[near]] = True
            front = out[hit]
            waiting[front] = False
            inside.extend(front.tolist())
        if len(inside) > 1:
            labels[inside] = first + min(inside)




def _shard_links(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = (np.zeros(0, np.int64), np.zeros(0, np.uint64))

        def links(shard: np.ndarray, codes: np.ndarray) -> pa.RecordBatch:
            group = np.cumsum(np.concatenate(([0], shard[1:] != shard[:-1]))) if len(shard) else shard
            a, b = spanning_links(group, codes, radius)
            return pa.RecordBatch.from_arrays([pa.array(codes[a].view(np.int64)), pa.array(codes[b].view(np.int64))], ["u", "v"])

        for batch in batches:
            shard = np.concatenate((rest[0], batch.column(0).to_numpy()))
            codes = np.concatenate((rest[1], batch.column(1).to_numpy().view(np.uint64)))
            whole = np.searchsorted(shard, shard[-1]) if len(shard) else 0  # the last shard may go on
            rest = shard[whole:], codes[whole:]
            if whole:
                yield links(shard[:whole], codes[:whole])
        if len(rest[0]):
            yield links(*rest)

    return run


def _bands(radius: int) -> list[tuple[int, int]]:
    """(shift, width) of radius + 1 bands that share out the 64 bits."""
    cuts = [64 * k // (radius + 1) for k in range(radius + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _turned(code: Column, shift: int) -> Column:
    return code if not shift else F.shiftrightunsigned(code, shift).bitwiseOR(F.shiftleft(code, 64 - shift))


def shards(codes: DataFrame, radius: int = RADIUS, limit: int = SHARD_LIMIT) -> DataFrame:
    """shard, fp: each distinct fp once per band of its bits.

    Two codes at most radius bits apart agree in one of radius + 1 bands, so every link lies inside some shard. A
    shard of over limit codes is dealt again by radius + 1 bands of the other bits, for the same reason without loss.
    """
    bands = _bands(radius)
    fp = F.col("fp")
    rows = F.array(*[
        F.struct(
            F.lit(k).cast("long").alias("band"),
            _turned(fp, s).bitwiseAND(F.lit((1 << w) - 1)).alias("value"),
            F.shiftrightunsigned(_turned(fp, s), w).alias("other"),
        )
        for k, (s, w) in enumerate(bands)
    ])
    dealt = codes.select("fp", F.explode(rows).alias("x")).select("fp", "x.*")
    dealt = dealt.withColumn("shard", F.shiftleft("band", 32).bitwiseOR(F.col("value")))
    large = dealt.groupBy("shard").count().where(F.col("count") > limit).select("shard", F.lit(True).alias("large"))
    dealt = dealt.join(large, "shard", "left")
    inner = min(48, 64 - max(w for _, w in bands))
    again = F.array(*[
        F.xxhash64(
            "shard",
            F.lit(k),
            F.shiftrightunsigned("other", inner * k // (radius + 1)).bitwiseAND(
                F.lit((1 << (inner * (k + 1) // (radius + 1) - inner * k // (radius + 1))) - 1)
                if k < radius
                else F.lit(-1).cast("long")
            ),
        )
        for k in range(radius + 1)
    ])
    return dealt.select(F.explode(F.when(F.col("large"), again).otherwise(F.array("shard"))).alias("shard"), "fp")


def links(codes: DataFrame, radius: int = RADIUS, limit: int = SHARD_LIMIT) -> DataFrame:
    """u, v: links that join all distinct fp of codes within radius bits, fewer than one per fp and shard."""
    dealt = shards(codes, radius, limit).repartition(tasks(codes.sparkSession), "shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(released(_shard_links(radius)), "u long, v long")


def classes(prints: DataFrame, radius: int = RADIUS, limit: int = SHARD_LIMIT) -> DataFrame:
    """fp, label, component_id for each distinct fp of prints(doc_id, fp): its class and the smallest doc_id in it.

    Null ids take part in links but never name a component unless it has no other id (then the result is null).
    """
    codes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    labels = connected_components(links(codes.select("fp"), radius, limit)).withColumnRenamed("node", "fp")
    known = codes.join(labels, "fp", "left").select("fp", "first_id", F.coalesce("label", "fp").alias("label"))
    known = cut(known)
    return known.join(known.groupBy("label").agg(F.min("first_id").alias("component_id")), "label")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, width: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row of docs(doc_id, text).

    Null, empty and wordless texts share fingerprint zero and so one class; rows that repeat an id each give a row;
    other columns are ignored; an empty table gives an empty result.
    """
    prints = cut(fingerprints(docs, width=width))
    found = prints.join(classes(prints, radius), "fp")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def long_fingerprints(texts: list[bytes], width: int = SIMILAR_SHINGLE, words: int = LONG_WORDS) -> np.ndarray:
    """A row of words for each text: the majority bits of its different shingles, hashed anew for each word."""
    out, held, total = [], [], 0
    steps = np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)

    def closed() -> np.ndarray:
        hashes, sizes = np.concatenate([np.zeros(0, np.uint64), *held]), np.array([len(h) for h in held])
        codes = np.zeros((len(held), words), np.uint64)
        for k in range(words):  # the finishing steps of a 64-bit mixer
            x = hashes + steps[k]
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            codes[:, k] = majority_bits(x ^ (x >> np.uint64(31)), sizes)
        return codes

    for text in texts:
        held.append(np.unique(np.array(shingle_hashes(text, width), np.uint64)))
        total += len(held[-1])
        if total > 250_000:
            out.append(closed())
            held, total = [], 0
    if held:
        out.append(closed())
    return np.concatenate(out) if out else np.zeros((0, words), np.uint64)


def radius_of(similarity: float, deviations: float, bits: int = 64 * LONG_WORDS) -> int:
    """Differing bits of two sets of a Jaccard similarity: the mean for their angle, and so many deviations more."""
    share = np.arccos(min(1.0, 2 * similarity / (1 + similarity))) / np.pi
    return int(max(0, bits * share + deviations * np.sqrt(bits * share * (1 - share))))


def _codes(column: pa.Array, kind: type) -> np.ndarray:
    """Long fingerprints as rows of numbers."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _long_shards(first: int | None = None):
    """Rows (node, code, ..) once for each band of the code, or each of the first ones: shard, node, code, .."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 8192):
            bands = _codes(batch.column(1), np.uint16).astype(np.int64)
            for band in range(first or bands.shape[1]):
                yield pa.RecordBatch.from_arrays([pa.array(bands[:, band] + (band << 16)), *batch.columns], ["shard", *batch.schema.names])

    return run


def _again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (shard, node, code, ..) of large shards once for each of 16 bytes of the code outside the shard's band."""
    for batch in pieces(batches, 8192):
        shard, values = batch.column(0).to_numpy(), _codes(batch.column(2), np.uint8).astype(np.int64)
        for byte in range(0, values.shape[1], 4):
            at = np.where(shard >> 16 == byte // 2, byte + 2, byte)
            new = (1 << 48) + (shard << 16) + (at << 8) + values[np.arange(len(shard)), at]
            yield pa.RecordBatch.from_arrays([pa.array(new), *batch.columns[1:]], batch.schema.names)


def _nearest(group: np.ndarray, codes: np.ndarray, labels: np.ndarray, wide: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(a, b, distance) of codes of one group with different labels, within wide bits; all of an a's among small components
    in one piece, and all of those in a crowd. Groups lie together, and a label stands in one group only."""
    crowded = np.bincount(labels, minlength=len(labels))[labels] > CROWD
    first = np.concatenate(([True], group[1:] != group[:-1]))
    start = np.flatnonzero(first)[np.cumsum(first) - 1]
    mixed = np.add.reduceat((labels != labels[start]).astype(np.int64), np.flatnonzero(first))[np.cumsum(first) - 1] > 0
    rest = np.flatnonzero(mixed & ~crowded)
    if len(rest):
        own = np.unique(group[rest], return_inverse=True)[1]
        forest = BKForest(own, codes[rest])
        for at in range(0, len(rest), SEARCH_BLOCK):
            q, node = forest.search(codes[rest[at : at + SEARCH_BLOCK]], own[at : at + SEARCH_BLOCK], wide)
            a, b = rest[q + at], rest[node]
            other = labels[a] != labels[b]
            yield a[other], b[other], distances(codes[a[other]], codes[b[other]])
    for crowd in np.unique(labels[mixed & crowded]):
        members = np.flatnonzero(labels == crowd)
        others = np.flatnonzero((group == group[members[0]]) & (labels != crowd))
        step = max(1, 200_000 // len(members))
        for at in range(0, len(others), step):
            some = others[at : at + step]
            d = distances(np.repeat(codes[some], len(members), 0), np.tile(codes[members], (len(some), 1))).reshape(len(some), -1)
            a, b = np.nonzero(d <= wide)
            yield some[a], members[b], d[a, b]


def _shard_pairs(sure: int, wide: int, most: int):
    """Rows (shard, node, code, known), together by shard: links u, v within sure bits, as spanning stars, and pairs to be
    looked at, of each code those with up to `most` of other components; of a code with more, only its FIRST_NEIGHBOURS nearest.
    Such a code comes as u and v with its shard as `cut`, once a shard, and so do its partners, but with v null.
    known is a label that codes are linked by already, or zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        schema = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("linked", pa.bool_()), ("cut", pa.int64())])

        def rows(u: np.ndarray, v: np.ndarray, linked: bool) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(np.full(len(u), linked)), pa.nulls(len(u), pa.int64())], schema=schema)

        def found() -> Iterator[pa.RecordBatch]:
            shard, nodes, codes, known = (np.concatenate(c) for c in zip(*held, strict=True))
            group = np.cumsum(np.diff(shard, prepend=shard[:1]) != 0)
            a, b = spanning_links(group, codes, sure)
            new = (known[a] != known[b]) | (known[a] == 0)
            yield rows(nodes[a[new]], nodes[b[new]], True)
            labels = np.arange(len(codes))
            labels[a] = b
            # Codes of one known label, too, are one component of the shard.
            order = np.lexsort((known, group))
            same = (np.diff(group[order]) == 0) & (np.diff(known[order]) == 0) & (known[order][1:] != 0)
            labels = local_labels(len(codes), order[1:][same], order[:-1][same], labels)
            over, met = np.zeros(len(codes), bool), np.zeros(len(codes), bool)
            for a, b, d in _nearest(group, codes, labels, wide):
                order = np.lexsort((b, d, a))
                a, b = a[order], b[order]
                start = np.flatnonzero(np.diff(a, prepend=-1))
                partners = np.diff(np.append(start, len(a)))
                rank, many = np.arange(len(a)) - np.repeat(start, partners), np.repeat(partners > most, partners)
                stay = rank < np.where(many, min(FIRST_NEIGHBOURS, most), most)
                both = np.unique(np.minimum(a, b)[stay] * len(codes) + np.maximum(a, b)[stay])  # a pair may be ranked from either end
                yield rows(nodes[both // len(codes)], nodes[both % len(codes)], False)
                over[a[many]] = True
                met[b[many]] = True
            at = np.flatnonzero(over | met)
            yield pa.RecordBatch.from_arrays([pa.array(nodes[at]), pa.array(nodes[at], mask=~over[at]), pa.array(np.zeros(len(at), bool)), pa.array(shard[at])], schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            shard, nodes, codes, known = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _codes(batch.column(2), np.uint64), batch.column(3).to_numpy()
            whole = np.searchsorted(shard, shard[-1])  # the last shard may go on
            if whole:
                held.append((shard[:whole], nodes[:whole], codes[:whole], known[:whole]))
            if held and (whole or held[-1][0][-1] != shard[-1]):
                yield from found()
                held = []
            held.append((shard[whole:], nodes[whole:], codes[whole:], known[whole:]))
        if held:
            yield from found()

    return run


def _shard_tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each shard, which lie together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        shard = batch.column(0).to_numpy()
        bounds = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
        for a, b in zip(bounds, bounds[1:], strict=False):
            if held and a < b and held[-1].column(0)[0].as_py() != shard[a]:
                yield pa.Table.from_batches(held)
                held = []
            if a < b:
                held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _open_nodes(wide: int):
    """Rows (shard, node, code, label, over), together by shard: shard, node and over of the codes marked over that have
    others of another label within wide bits, and of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _shard_tables(batches):
            rows = rows.combine_chunks()
            codes, labels, over = _codes(rows.column("code"), np.uint64), rows.column("label").to_numpy(), rows.column("over").to_numpy()
            met, own = np.zeros(len(codes), bool), np.zeros(len(codes), bool)
            for a in np.flatnonzero(over):
                near = (distances(codes, codes[a : a + 1]) <= wide) & (labels != labels[a])
                met |= near
                own[a] = near.any()
            at = np.flatnonzero(met | own)
            yield pa.RecordBatch.from_arrays([pa.array(rows.column(0).to_numpy()[at]), pa.array(rows.column(1).to_numpy()[at]), pa.array(own[at])], ["shard", "node", "over"])

    return run


def _compared(wide: int, similarity: float):
    """Rows (shard, node, code, label, over, set), together by shard: links u, v that join all components between which a
    code marked over has one within wide bits whose set reaches the similarity; fewer than one for each code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _shard_tables(batches):
            rows = rows.combine_chunks()
            nodes, codes, labels = rows.column("node").to_numpy(), _codes(rows.column("code"), np.uint64), np.unique(rows.column("label").to_numpy(), return_inverse=True)[1]
            sets = rows.column("set").combine_chunks()
            sets = sets.chunk(0) if isinstance(sets, pa.ChunkedArray) else sets
            sizes = np.asarray(sets.value_lengths()).astype(np.int64)
            distinct, ids = np.unique(sets.flatten().to_numpy(), return_inverse=True)
            ends, mark, found = np.cumsum(sizes), np.zeros(len(distinct), bool), ([], [])
            for a in np.flatnonzero(rows.column("over").to_numpy()):
                own = ids[ends[a] - sizes[a] : ends[a]]
                mark[own] = True
                others = np.flatnonzero((distances(codes, codes[a : a + 1]) <= wide) & (labels != labels[a]))
                for at in range(0, len(others), 256):
                    some = others[at : at + 256]
                    some = some[(labels[some] != labels[a]) & (sizes[some] > 0)]
                    if not len(some):
                        continue
                    first = np.cumsum(sizes[some]) - sizes[some]
                    inside = mark[ids[np.repeat(ends[some] - sizes[some] - first, sizes[some]) + np.arange(sizes[some].sum())]]
                    common = np.add.reduceat(inside.astype(np.int64), first)
                    near = some[common >= similarity * (sizes[a] + sizes[some] - common)]
                    met, which = np.unique(labels[near], return_index=True)
                    found[0].extend([nodes[a]] * len(met))
                    found[1].extend(nodes[near[which]].tolist())
                    labels[np.isin(labels, met)] = labels[a]
                mark[own] = False
            yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64())], ["u", "v"])

    return run


def _place(*columns: str) -> Column:
    """The bit of a filter that stands for the columns."""
    return F.pmod(F.xxhash64(*columns), F.lit(FILTER_BITS)).cast("long")


def _bitmap(rows: DataFrame, *columns: str) -> DataFrame:
    """k, bits: a filter's pieces, numbered from zero, in which the places of all rows are set."""
    return (
        rows.select((_place(*columns) + 1).alias("x"))  # values are numbered from one, and so are buckets
        .groupBy((F.bitmap_bucket_number("x") - 1).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("bits"))
    )


def _sets(source: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """node, set: the different shingle hashes of the texts of source(doc_id, text) named by wanted(doc_id, node).

    A bitmap of FILTER_BITS, built by Spark and sent to all tasks, tells nearly all texts that are not wanted; so no
    text is sent anywhere, and only the sets of the others are.
    """
    held = np.zeros((FILTER_BITS // PIECE_BITS, PIECE_BITS // 8), np.uint8)
    for r in _bitmap(wanted, "doc_id").collect():
        held[r["k"]] = np.frombuffer(r["bits"], np.uint8)
    held = held.ravel()
    shared = source.sparkSession.sparkContext.broadcast(held)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        at, bits = batch.column(2).to_numpy(), shared.value
        keep = np.flatnonzero(bits[at >> 3] >> (at & 7).astype(np.uint8) & 1)
        if not len(keep):
            return None
        some = batch.take(pa.array(keep))
        sets = [np.unique(np.array(shingle_hashes(t, width), np.uint64)).view(np.int64) for t in raw_texts(some.column(1))]
        return pa.RecordBatch.from_arrays([some.column(0), pa.array(sets, pa.list_(pa.int64()))], ["doc_id", "set"])

    kind = source.schema["doc_id"].dataType.simpleString()
    found = map_batches(source.select("doc_id", "text", _place("doc_id").alias("place")), run, f"doc_id {kind}, set array<long>", 256)
    return found.join(wanted, "doc_id").groupBy("node").agg(F.first("set").alias("set"))


def similar_classes(docs: DataFrame, key: str | Column = "doc_id", similarity: float = SIMILARITY, width: int = SIMILAR_SHINGLE, limit: int = SHARD_LIMIT, neighbours: int = NEIGHBOURS) -> DataFrame:
    """doc_id, label: rows of docs(doc_id, text) whose shingle sets reach the similarity share a label, by chains.

    Pairs are found by LONG_WORDS * 64 / BAND_BITS bands of bits, of which one must agree: nineteen in twenty pairs of
    similarity 0.8, nearly all of 0.85 and more. Pairs whose fingerprints are SURE deviations nearer than the similarity
    asks for link; those up to WIDER deviations farther link if their shingle sets, compared in full, reach it. In each
    shard a code brings up to `neighbours` of other components as pairs, from a few bands first, so that crowds are
    one component when all bands follow. Where a code has more, those pairs never become rows: its set and theirs go to
    the shard's task, which compares them all and gives links that span what they join. A shard of over limit codes is
    dealt again by 16 of its codes' other bytes, of which one in a hundred pairs of the similarity shares none.
    """
    pick = F.col(key) if isinstance(key, str) else key
    sure, wide = radius_of(similarity, -SURE), radius_of(similarity, WIDER)
    source = docs.select(pick.alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        codes = [c.tobytes() for c in long_fingerprints(raw_texts(batch.column(1)), width)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes, pa.binary())], ["doc_id", "code"])

    prints = cut(map_batches(source, run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, code binary").withColumn("node", F.xxhash64("code")))
    codes = cut(prints.groupBy("node").agg(F.first("code").alias("code"), F.first("doc_id").alias("doc_id")))
    sizes = codes.select("node", "code").mapInArrow(released(_long_shards()), "shard long, node long, code binary").groupBy("shard").count()
    sizes = cut(sizes.where(F.col("count") > limit)).select("shard")
    some_large = not sizes.isEmpty()

    def dealt(labels: DataFrame | None, bands: int | None) -> DataFrame:
        """shard, node, code, known for each band, or the first ones, where large shards are left out. The codes, which take a
        row each, get their labels before they are dealt; the rows of all bands are shuffled once, by shard."""
        known = codes.withColumn("label", F.lit(None).cast("long")) if labels is None else codes.join(labels, "node", "left")
        schema = "shard long, node long, code binary, known long"
        rows = known.select("node", "code", F.coalesce("label", F.lit(0).cast("long")).alias("known")).mapInArrow(released(_long_shards(bands)), schema)
        if not some_large:
            return rows
        few = F.broadcast(sizes)  # a row for over limit rows of all bands
        small = rows.join(few, "shard", "left_anti")
        return small if bands else small.unionByName(rows.join(few, "shard", "left_semi").select(*rows.columns).mapInArrow(released(_again), schema))

    def by_shard(rows: DataFrame) -> DataFrame:
        return rows.repartition(tasks(docs.sparkSession), "shard").sortWithinPartitions("shard")

    def pairs_of(rows: DataFrame, most: int) -> DataFrame:
        return cut(by_shard(rows).mapInArrow(released(_shard_pairs(sure, wide, most)), "u long, v long, linked boolean, cut long").distinct())

    def sets_of(nodes: DataFrame) -> DataFrame:
        return cut(_sets(source, cut(codes.join(nodes.distinct(), "node", "left_semi").select("doc_id", "node")), width))

    def near_of(found: DataFrame, labels: DataFrame) -> DataFrame:
        """The pairs of different components that reach the similarity."""
        ends = [F.coalesce(c, F.col(n)) for c, n in ((F.col("label_u"), "u"), (F.col("label_v"), "v"))]
        open_ = found.where("not linked and u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
        open_ = open_.join(labels.select(F.col("node").alias("u"), F.col("label").alias("label_u")), "u", "left").join(labels.select(F.col("node").alias("v"), F.col("label").alias("label_v")), "v", "left")
        open_ = cut(open_.where(ends[0] != ends[1]).select("u", "v"))
        if open_.isEmpty():
            return open_
        sets = sets_of(open_.select(F.col("u").alias("node")).union(open_.select(F.col("v").alias("node"))))
        both = open_.join(sets.toDF("u", "a"), "u").join(sets.toDF("v", "b"), "v")
        common = F.size(F.array_intersect("a", "b"))
        return cut(both.where(common >= similarity * (F.size("a") + F.size("b") - common)).select("u", "v"))

    links, labels = None, None
    for bands, most in ((FIRST_BANDS, min(FIRST_NEIGHBOURS, neighbours)), (None, neighbours)):
        found = pairs_of(dealt(labels, bands), most)
        sure_links = found.where("linked").select("u", "v")
        links = sure_links if links is None else links.unionByName(sure_links)
        links = links.unionByName(near_of(found, cut(connected_components(links))))
        labels = cut(connected_components(links))
    over = found.where("cut is not null").select(F.col("cut").alias("shard"), F.col("u").alias("node"), F.col("v").isNotNull().alias("over"))
    if not over.isEmpty():
        marked = over.join(codes, "node").join(labels, "node", "left").select("shard", "node", "code", F.coalesce("label", "node").alias("label"), "over")
        placed = marked.drop("over")
        open_ = cut(by_shard(marked).mapInArrow(released(_open_nodes(wide)), "shard long, node long, over boolean"))
        if not open_.isEmpty():
            rows = placed.join(open_, ["shard", "node"]).join(sets_of(open_.select("node")), "node").select("shard", "node", "code", "label", "over", "set")
            links = links.unionByName(cut(by_shard(rows).mapInArrow(released(_compared(wide, similarity)), "u long, v long").distinct()))
            labels = cut(connected_components(links))
    return prints.join(labels, "node", "left").select("doc_id", F.coalesce("label", "node").alias("label"))


def _first_of_each(docs: DataFrame, classes_of) -> DataFrame:
    """Of each class the row of the smallest doc_id (nulls last); of fully equal rows one.

    classes_of gives doc_id (id, row) and label for rows told apart by a hash of all their columns. A bitmap of FILTER_BITS of
    the rows that go or are repeated, built by Spark and sent to all tasks, tells most rows that stay; only the others, with
    their texts, are sent to meet the rows that stay.
    """
    name = "_simhash_row"
    marked = docs.withColumn(name, F.xxhash64(*docs.columns))
    found = cut(classes_of(marked, F.struct(F.col("doc_id").alias("id"), F.col(name).alias("row"))).select("doc_id.id", "doc_id.row", "label"))
    order = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    stay = cut(found.groupBy("label").agg(F.min(order).alias("k")).select("k.id", "k.row"))
    counted = found.groupBy("id", "row").count()
    gone = counted.join(stay, (counted["row"] == stay["row"]) & counted["id"].eqNullSafe(stay["id"]), "left_anti")
    marks = F.broadcast(cut(_bitmap(gone.unionByName(counted.where("count > 1")), "id", "row")))
    place = _place("doc_id", name)
    byte = F.conv(F.hex(F.substring("bits", F.floor(place % PIECE_BITS / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    told = marked.join(marks, F.floor(place / PIECE_BITS) == F.col("k"), "left")
    told = told.select(*marked.columns, F.coalesce(F.getbit(byte, (place % 8).cast("int")) == 1, F.lit(False)).alias("doubtful"))
    open_ = told.where("doubtful").drop("doubtful")
    open_ = open_.join(stay, (F.col(name) == stay["row"]) & F.col("doc_id").eqNullSafe(stay["id"]), "left_semi").dropDuplicates(["doc_id", name])
    return told.where("not doubtful").drop("doubtful").unionByName(open_).drop(name)


def drop_near_duplicates(docs: DataFrame, radius: int = RADIUS, width: int = SHINGLE) -> DataFrame:
    """The rows of docs less copies within radius bits: of each class the row of the smallest doc_id (nulls last) stays.

    Of fully equal rows one stays; rows without words are copies of each other.
    """

    def classes_of(marked: DataFrame, key: Column) -> DataFrame:
        prints = cut(fingerprints(marked, key=key, width=width))
        known = classes(prints.select(F.col("doc_id.id").alias("doc_id"), "fp"), radius)
        return prints.join(known.select("fp", "label"), "fp")

    return _first_of_each(docs, classes_of)


def drop_similar(docs: DataFrame, similarity: float = SIMILARITY, width: int = SIMILAR_SHINGLE) -> DataFrame:
    """The rows of docs less near copies, by `similar_classes`: of each class the row of the smallest doc_id stays.

    Of fully equal rows one stays; rows without words are copies of each other; nulls and other columns stay as they are.
    """
    return _first_of_each(docs, lambda marked, key: similar_classes(marked, key, similarity, width))
