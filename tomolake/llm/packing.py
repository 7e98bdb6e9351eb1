"""Best-fit packing of documents into token sequences by a grouping genetic algorithm on islands.

Documents are cut into pieces that fit a sequence; pieces are dealt to shards of a few thousand. A shard's first
packing is best fit in falling order. Where that is more than a lower bound allows, islands breed packings: a child
takes whole well-filled sequences of one parent, gives up the other parent's sequences that hold any of their pieces,
and the pieces displaced by that go back by best fit. After each epoch an island's best packing goes to its neighbour.
The least filled sequences of every shard are opened again and packed together with those of other shards, level by
level, until one shard is left; so shards leave no loose ends behind.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tomolake.llm.common import cut, pieces

CAPACITY = 4096
END_ID = 1
#: Pieces of a shard, about; shards that meet at the next level, and sequences that each opens for it.
SHARD_PIECES, MEET, OPENED = 4096, 64, 16
#: Islands of a shard, packings on each, epochs, and children of an epoch.
ISLANDS, POPULATION, EPOCHS, CHILDREN = 4, 8, 3, 150
#: Bytes of the texts that are encoded together, about.
TOGETHER = 1 << 23

# Fixed values of the word-end vocabulary: the end mark, and the pattern that words follow after lower-casing.
WORD_END = "</w>"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Texts of Latin letters and marks only, where Arrow's classes are the library's but for spaces beyond ASCII.
PLAIN = re.compile("[\x00-įı-ſ‐-‧‰-⁞€]*")
#: A byte that no lower-cased text holds: it ends every word for the rank encoder.
END_BYTE = "Z"


class WordEncoder:
    """ids of whole texts as the tokenizers library gives them for a tokenizer file.

    Where the file is BPE with word ends, lower case and the known word pattern, and its merges stand in the order of
    their ids, words are merged by the rank encoder of tiktoken: a byte that ends the word makes its last symbol, by
    merges that rank before all others. No word reaches over a space: what stands between spaces is split into words and
    merged once for texts encoded together. Texts with letters beyond Latin ones, texts that hold an added token, and
    files of any other kind go to the tokenizers library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.added = [x["content"] for x in spec.get("added_tokens", [])]
        normal = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        split = [x.get("pattern", {}).get("Regex") for x in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model.get("merges", [])]
        plain = (
            normal == ["NFC", "Replace", "Lowercase"] and split == [WORD_PATTERN, None] and not spec.get("post_processor") and model.get("type") == "BPE"
            and model.get("end_of_word_suffix") == WORD_END and not any(model.get(k) for k in ("dropout", "byte_fallback", "ignore_merges", "continuing_subword_prefix"))
            and all(model["vocab"].get(a + b) == 512 + k for k, (a, b) in enumerate(merges))
        )
        self.words = None
        if plain:
            import tiktoken

            own = [*range(33, 127), *range(161, 173), *range(174, 256)]
            of = {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(own))}
            ranks, self.ends = {}, np.zeros(max(model["vocab"].values()) + 1, bool)
            for token, i in model["vocab"].items():
                if token not in self.added:
                    ends = token.endswith(WORD_END) and len(token) > len(WORD_END)
                    ranks[bytes(map(of.__getitem__, token.removesuffix(WORD_END) if ends else token)) + END_BYTE.encode() * ends] = i
                    self.ends[i] = ends
            self.words = tiktoken.Encoding("words", pat_str=f"[^{END_BYTE}]+{END_BYTE}", mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The same for each text. Texts are few enough to be held at once."""
        out, plain = [b""] * len(texts), []
        for k, text in enumerate(texts):
            if self.words is None or not PLAIN.fullmatch(text) or any(a in text for a in self.added):
                out[k] = np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
            else:
                plain.append(k)
        for k, ids in zip(plain, self._ranked([texts[k] for k in plain]) if plain else [], strict=True):
            out[k] = ids
        return out

    def _ranked(self, texts: list[str]) -> list[bytes]:
        """The ids of each plain text, put together from those of the distinct chunks between spaces."""
        rows = pc.ascii_split_whitespace(pa.array([t.lower().replace("\x85", " ").replace("\xa0", " ") for t in texts], pa.large_string()))
        chunks = rows.flatten().dictionary_encode()
        words = pc.replace_substring_regex(chunks.dictionary, WORD_PATTERN, rf"\0{END_BYTE}")
        ids = self.words.encode_to_numpy("".join(words.to_numpy(zero_copy_only=False)), disallowed_special=())
        # A word's last id ends it, so the ids of a chunk end with its last word.
        word_ends = np.append(0, np.flatnonzero(self.ends[ids]) + 1)
        ends = word_ends[np.append(0, np.cumsum(pc.count_substring(words, END_BYTE).to_numpy()))]
        at = chunks.indices.to_numpy()
        n = np.diff(ends)[at]
        till = np.append(0, np.cumsum(n))
        ids = ids[np.repeat(ends[at] - till[:-1], n) + np.arange(till[-1])].astype("<u4", copy=False)
        return [ids[a:b].tobytes() for a, b in pairwise(till[rows.offsets.to_numpy()].tolist())]


@lru_cache(1)
def encoder_of(path: str) -> WordEncoder:
    return WordEncoder(path)


def pieces_of(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """row, doc_id, piece, start, length, ids_crc32: the pieces of docs(doc_id, text) with the end id, none longer than
    capacity. row is a number of the document's own. Null texts count as empty: they have only the end id."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def encoded(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoder, end, width = encoder_of(tokenizer), np.array([end_id], "<u4").tobytes(), 4 * capacity
        at, piece, length, crc = [], [], [], []
        for k, own in enumerate(encoder.encode_all([text or "" for text in batch.column(2).to_pylist()])):
            ids = own + end
            for p, a in enumerate(range(0, len(ids), width)):
                part = ids[a : a + width]
                at.append(k)
                piece.append(p)
                length.append(len(part) // 4)
                crc.append(zlib.crc32(part))
        take = pa.array(at, pa.int32())
        start = pa.array(np.array(piece, np.int64) * capacity)
        columns = [batch.column(0).take(take), batch.column(1).take(take), pa.array(piece, pa.int32()), start, pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "piece", "start", "length", "ids_crc32"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            till = np.cumsum(pc.binary_length(batch.column(2)).fill_null(0).to_numpy(), dtype=np.int64) // TOGETHER
            for a, b in pairwise([0, *(np.flatnonzero(np.diff(till)) + 1).tolist(), batch.num_rows]):
                if b > a:
                    yield encoded(batch.slice(a, b - a))

    return rows.mapInArrow(run, "row long, doc_id long, piece int, start long, length long, ids_crc32 long")


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Sequences that sizes need at least. For each a up to half the capacity: sizes over capacity - a stand alone among
    those of a or more, those over half meet no other such, and the rest fills what these leave, and more."""
    if not len(sizes):
        return 0
    s = np.sort(sizes).astype(np.int64)
    sums = np.concatenate(([0], np.cumsum(s)))
    a = np.unique(np.append(s[s <= capacity // 2], 0))
    alone, half, low = (np.searchsorted(s, x, side) for x, side in ((capacity - a, "right"), (capacity // 2, "right"), (a, "left")))
    big = len(s) - half
    room = (alone - half) * capacity - (sums[alone] - sums[half])
    rest = sums[half] - sums[low] - room
    return int((big + np.maximum(0, -(-rest // capacity))).max())


def best_fit(sizes: list[int], capacity: int, free: list[int]) -> list[int]:
    """The bin of each size, in order: of those with room the one with least. free, the room of each bin, is changed and
    grows by new bins. Rooms in use are bits of one number, so the least that is enough is its lowest bit from there."""
    holders: dict[int, list[int]] = {}
    rooms = 0
    for b, f in enumerate(free):
        if f:
            holders.setdefault(f, []).append(b)
    for f in holders:
        rooms |= 1 << f
    out = []
    for s in sizes:
        above = rooms >> s
        if above:
            f = s + (above & -above).bit_length() - 1
            b = holders[f].pop()
            if not holders[f]:
                rooms ^= 1 << f
        else:
            f, b = capacity, len(free)
            free.append(capacity)
        f -= s
        free[b] = f
        if f:
            same = holders.setdefault(f, [])
            if not same:
                rooms |= 1 << f
            same.append(b)
        out.append(b)
    return out


def first_packing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Best fit in the order of sizes, which fall."""
    return np.array(best_fit(sizes.tolist(), capacity, []), np.int64)


def fitness(packing: np.ndarray, sizes: np.ndarray) -> tuple[int, float]:
    """Bins, then how little the filling is drawn together; less is better."""
    fill = np.bincount(packing, sizes)
    return len(fill), -float((fill * fill).sum())


def _refilled(packing: np.ndarray, out: np.ndarray, sizes: np.ndarray, capacity: int, order: np.ndarray) -> np.ndarray:
    """packing with the pieces marked in out taken away and put back by best fit in the given order."""
    child = np.full(len(packing), -1, np.int64)
    names, child[~out] = np.unique(packing[~out], return_inverse=True)
    free = (capacity - np.bincount(child[~out], sizes[~out], len(names)).astype(np.int64)).tolist()
    child[order] = best_fit(sizes[order].tolist(), capacity, free)
    return child


def crossed(a: np.ndarray, b: np.ndarray, sizes: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """a with whole bins of b, chosen among the better filled half, in place of its bins that hold any of their pieces;
    what these held besides goes back by best fit, large pieces first."""
    order = np.argsort(-np.bincount(b, sizes), kind="stable")
    half = order[: max(1, len(order) // 2)]
    chosen = rng.choice(half, rng.integers(1, len(half) + 1), replace=False)
    injected = np.isin(b, chosen)
    broken = np.isin(a, a[injected]) & ~injected
    both = np.where(injected, b + a.max() + 1, a)
    return _refilled(both, broken, sizes, capacity, np.flatnonzero(broken))


def mutated(a: np.ndarray, sizes: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """a with its least filled bins and a few others emptied and their pieces put back in a random order."""
    fill = np.bincount(a, sizes)
    n = max(2, len(fill) // 20)
    empty = np.union1d(np.argsort(fill, kind="stable")[:n], rng.choice(len(fill), n))
    out = np.isin(a, empty)
    return _refilled(a, out, sizes, capacity, rng.permutation(np.flatnonzero(out)))


def evolved(sizes: np.ndarray, population: list[np.ndarray], capacity: int, bound: int, children: int, rng: np.random.Generator) -> list[np.ndarray]:
    """The population after so many children, the fittest first; it ends early at the bound.

    A parent is the fitter of two. A child takes the place of the least fit if it is fitter and unlike all others.
    """
    scored = sorted(((fitness(p, sizes), p) for p in population), key=lambda x: x[0])
    while len(scored) < POPULATION:  # so that islands differ: pieces in falling order but for some noise
        order = np.argsort(-sizes * rng.uniform(0.7, 1.0, len(sizes)), kind="stable")
        p = np.empty(len(sizes), np.int64)
        p[order] = best_fit(sizes[order].tolist(), capacity, [])
        scored.append((fitness(p, sizes), p))
    scored.sort(key=lambda x: x[0])
    for _ in range(children):
        if scored[0][0][0] <= bound:
            break
        a, b = (scored[min(rng.integers(len(scored), size=2))][1] for _ in range(2))
        child = crossed(a, b, sizes, capacity, rng)
        if rng.random() < 0.5:
            child = mutated(child, sizes, capacity, rng)
        f = fitness(child, sizes)
        if f < scored[-1][0] and all(f != x[0] for x in scored):
            scored[-1] = (f, child)
            scored.sort(key=lambda x: x[0])
    return [p for _, p in scored]


def _first(items: DataFrame, capacity: int) -> DataFrame:
    """items(shard, row, piece, length, ..) with bin, and settled: whether the shard's first packing meets the bound."""
    names = items.columns
    dealt = items.repartition("shard").sortWithinPartitions("shard", F.desc("length"), "row", "piece")

    def packed(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not parts:
            return
        table = pa.Table.from_batches(parts).combine_chunks()
        sizes = table.column("length").to_numpy()
        bins = first_packing(sizes, capacity)
        settled = bool(bins.max() + 1 == lower_bound(sizes, capacity))
        yield from table.append_column("bin", pa.array(bins)).append_column("settled", pa.array([settled] * len(bins))).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, parts = None, []
        for batch in batches:
            shards = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(shards)) + 1), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b > a:
                    if shards[a] != shard:
                        yield from packed(parts)
                        shard, parts = shards[a], []
                    parts.append(batch.slice(a, b - a))
        yield from packed(parts)

    kinds = ", ".join(f"{n} {items.schema[n].dataType.simpleString()}" for n in names)
    return dealt.select(*names).mapInArrow(run, f"{kinds}, bin long, settled boolean")


ISLAND = "shard long, island int, sizes array<int>, population array<array<int>>, bins int, bound int"


def _epoch(islands: DataFrame, epoch: int, capacity: int, children: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in pieces([batch], 1):
                x = row.to_pylist()[0]
                sizes = np.array(x["sizes"], np.int64)
                bound = lower_bound(sizes, capacity)
                rng = np.random.default_rng([x["shard"], x["island"], epoch])
                found = evolved(sizes, [np.array(p, np.int64) for p in x["population"]], capacity, bound, children, rng)[:POPULATION]
                out = {"shard": [x["shard"]], "island": [x["island"]], "sizes": [x["sizes"]], "population": [[p.tolist() for p in found]], "bins": [fitness(found[0], sizes)[0]], "bound": [bound]}
                yield pa.RecordBatch.from_pydict(out, pa.schema([
                    ("shard", pa.int64()), ("island", pa.int32()), ("sizes", pa.list_(pa.int32())), ("population", pa.list_(pa.list_(pa.int32()))), ("bins", pa.int32()), ("bound", pa.int32()),
                ]))

    return islands.select("shard", "island", "sizes", "population").repartition("shard", "island").mapInArrow(run, ISLAND)


def _evolved_shards(placed: DataFrame, capacity: int, islands: int, epochs: int, children: int) -> DataFrame:
    """placed with the bins of its unsettled shards bred anew."""
    open_ = placed.where("not settled")
    others = [c for c in placed.columns if c not in ("shard", "length", "bin", "settled")]
    item = F.struct((-F.col("length")).alias("order"), "row", "piece", *[c for c in others if c not in ("row", "piece")], "length", "bin")
    shards = cut(open_.groupBy("shard").agg(F.sort_array(F.collect_list(item)).alias("items")))  # a shard is bounded
    if shards.isEmpty():
        return placed.drop("settled")
    sizes, first = F.transform("items", lambda x: x["length"].cast("int")), F.transform("items", lambda x: x["bin"].cast("int"))
    state = shards.select("shard", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), sizes.alias("sizes"), F.array(first).alias("population"))
    done: list[DataFrame] = []
    for epoch in range(epochs):
        state = cut(_epoch(state, epoch, capacity, children))
        best = state.groupBy("shard").agg(F.min_by(F.struct(F.element_at("population", 1).alias("bins"), F.lit(epoch).alias("epoch")), F.struct("bins", "island")).alias("best"), F.min("bins").alias("least"), F.first("bound").alias("bound"))
        best = cut(best)
        last = epoch == epochs - 1
        done.append(best.where(F.lit(last) | (F.col("least") <= F.col("bound"))).select("shard", F.col("best.bins").alias("bins")))
        open_shards = best.where(F.col("least") > F.col("bound")).select("shard")
        if last or open_shards.isEmpty():
            break
        elite = state.select("shard", ((F.col("island") + 1) % islands).alias("island"), F.element_at("population", 1).alias("elite"))
        state = state.join(elite, ["shard", "island"]).join(open_shards, "shard", "left_semi")
        state = state.select("shard", "island", "sizes", F.concat(F.array("elite"), "population").alias("population"))
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    again = shards.join(found, "shard").select("shard", F.explode(F.arrays_zip("items", "bins")).alias("x"))
    again = again.select("shard", *[F.col(f"x.items.{c}").alias(c) for c in placed.columns if c not in ("shard", "bin", "settled")], F.col("x.bins").cast("long").alias("bin"))
    return placed.where("settled").drop("settled").unionByName(again)


def place_pieces(
    rows: DataFrame, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES, meet: int = MEET, opened: int = OPENED,
    islands: int = ISLANDS, epochs: int = EPOCHS, children: int = CHILDREN,
) -> DataFrame:
    """rows(row, piece, length, ..) with sequence_id and offset; (row, piece) tell rows apart, lengths are 1 to capacity."""
    shards = max(1, -(-rows.count() // shard_pieces))
    names = [c for c in rows.columns if c not in ("row", "piece", "length")]
    items = rows.select(F.pmod(F.xxhash64("row", "piece"), F.lit(shards)).alias("shard"), "row", "piece", "length", *names)
    out, level = None, 0
    while True:
        placed = cut(_first(items, capacity))
        placed = _evolved_shards(placed, capacity, islands, epochs, children)
        shard, bin_ = Window.partitionBy("shard"), Window.partitionBy("shard", "bin")
        ranked = placed.withColumn("fill", F.sum("length").over(bin_))
        # Bins by filling; one number for all rows of a bin.
        ranked = ranked.withColumn("place", F.dense_rank().over(shard.orderBy("fill", "bin")))
        within = bin_.orderBy(F.desc("length"), "row", "piece").rowsBetween(Window.unboundedPreceding, -1)
        ranked = cut(ranked.withColumn("offset", F.coalesce(F.sum("length").over(within), F.lit(0))))
        again = (F.col("place") <= opened) & (F.col("fill") < capacity) if shards > 1 else F.lit(False)
        number = F.lit(level << 58) + F.col("shard") * (1 << 20) + F.col("bin")
        kept = ranked.where(~again).select("row", "piece", "length", *names, number.alias("sequence_id"), F.col("offset").cast("long").alias("offset"))
        out = kept if out is None else out.unionByName(kept)
        if shards == 1:
            return out
        items = ranked.where(again).select(F.floor(F.col("shard") / meet).cast("long").alias("shard"), "row", "piece", "length", *names)
        shards, level = -(-shards // meet), level + 1


def pack(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: a row for each piece of docs(doc_id, text).

    A document's ids with the end id are cut only if they are more than a sequence holds. start: its ids before the
    piece; offset: the place in the sequence, without gaps. Null texts count as empty; null and repeated ids are
    documents of their own; other columns are ignored; an empty table gives no rows. Equal lengths are placed in the
    order of the rows as read.
    """
    rows = cut(pieces_of(docs, tokenizer, options.get("capacity", CAPACITY)))
    return place_pieces(rows, **options).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
