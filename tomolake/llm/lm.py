"""Deleted interpolation: a bigram model whose weights depend on how often the context was seen.

Counts are gathered over all documents. Documents are written once as blocks; every later pass reads those, so a
task that runs again meets the same block. Tasks send each block's distinct n-gram hashes, sorted and packed into one
row per range of hashes; one task per range adds them up and sends the totals back in the same order, so a block meets
the counts of its own n-grams only. Nothing of the vocabulary passes the driver: it sees the number of tokens and
types, and a histogram of bounded size from which the weights are learnt.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomolake.llm.common import cut, fold, fold_of, pieces, raw_texts, tasks, words_of

#: Train on documents whose id hash modulo FOLDS is not HELD; those of DELETED (a part of them) train the weights.
FOLDS, HELD, DELETED = 7, 2, 3
#: Documents and bytes of words after which a block is closed.
BLOCK_DOCS, BLOCK_BYTES = 4096, 8 << 20
#: Ranges of hashes, as a power of two, for each shuffle partition.
RANGE_BITS = 2
#: Width, in nats, of the cells that probabilities fall into when weights are learnt; and their number.
CELL, CELLS = 0.2, 160
#: Classes of context frequency: 0, 1, 2-3, 4-7, ...
CLASSES = 48

_END, _BEGIN = b"\n", b"\n\n"
_DOCS, _WORDS, _PAIRS, _TOTALS = 0, 1, 2, 3
_SCHEMA = "block long, kind int, part int, a binary, b binary, ids array<long>, n long, types long"


def _pack(x: np.ndarray) -> bytes:
    """Whole numbers as their byte planes, of which the highest are nearly all zero."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T
    return zstandard.compress(planes.tobytes(), 1)


def _unpack(x: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(x), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _pack_sorted(x: np.ndarray) -> bytes:
    return _pack(np.diff(x, prepend=np.uint64(0)))


def _unpack_sorted(x: bytes) -> np.ndarray:
    return np.cumsum(_unpack(x, np.uint64), dtype=np.uint64)


class Block:
    """Tokens of some documents, their distinct words and pairs in order of hashes, and where each occurs."""

    def __init__(self, docs: list[list[bytes]]):
        known = {_END: 0, _BEGIN: 1}
        flat: list[int] = []
        for words in docs:
            flat.append(1)
            flat += [known.setdefault(w, len(known)) for w in words]
            flat.append(0)
        hashes = np.array([xxhash.xxh64_intdigest(w) for w in known], np.uint64)
        order = np.argsort(hashes)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.words = hashes[order]
        tokens = rank[np.array(flat, np.int64)]
        sizes = np.array([len(w) + 2 for w in docs], np.int64)
        self.lengths = sizes - 1
        self.predicted = np.ones(len(tokens), bool)
        self.predicted[np.cumsum(sizes) - sizes] = False
        at = np.flatnonzero(self.predicted)
        self.doc = np.repeat(np.arange(len(docs)), self.lengths)
        self.word, self.before = tokens[at], tokens[at - 1]
        self.begin = int(rank[1])
        mixed = self.words[self.before] * np.uint64(0x9E3779B97F4A7C15)
        pair = (mixed ^ (mixed >> np.uint64(31))) + self.words[self.word] * np.uint64(0xC2B2AE3D27D4EB4F)
        self.pairs, self.pair = np.unique(pair ^ (pair >> np.uint64(29)), return_inverse=True)

    def counts(self, kind: int, docs: np.ndarray) -> np.ndarray:
        """Occurrences of each distinct word or pair in documents where docs is true; begins count as words."""
        use = docs[self.doc]
        if kind == _PAIRS:
            return np.bincount(self.pair[use], minlength=len(self.pairs))
        out = np.bincount(self.word[use], minlength=len(self.words))
        out[self.begin] += docs.sum()
        return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each block of this partition: its words, packed, and its ids. Deleted documents make blocks of their
    own, of odd numbers."""
    base = TaskContext.get().partitionId() << 24
    held: list[tuple[list, list, int]] = [([], [], 0), ([], [], 0)]
    made = [0, 0]

    def closed(g: int) -> pa.RecordBatch:
        ids, docs, _ = held[g]
        number = (base + made[g]) * 2 + g
        held[g], made[g] = ([], [], 0), made[g] + 1
        return _rows([(number, _DOCS, 0, zstandard.compress(b"\n".join(docs), 3), None, ids, len(ids), 0)])

    for batch in pieces(batches, 1024):
        for doc_id, text in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1)), strict=True):
            g = int(fold_of(doc_id, FOLDS) == DELETED)
            ids, docs, size = held[g]
            ids.append(doc_id)
            docs.append(b" ".join(words_of(text)))
            held[g] = ids, docs, size + len(text) + 8
            if len(ids) >= BLOCK_DOCS or held[g][2] >= BLOCK_BYTES:
                yield closed(g)
    for g in (0, 1):
        if held[g][0]:
            yield closed(g)


def _block_of(packed: bytes) -> Block:
    return Block([d.split(b" ") if d else [] for d in zstandard.decompress(packed).split(b"\n")])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.int64(), pa.int64()]
    names = [x.split()[0] for x in _SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _key_rows(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            row = batch.to_pylist()[0]
            block, folds = _block_of(row["a"]), np.array([fold_of(i, FOLDS) for i in row["ids"]])
            for kind, keys in ((_WORDS, block.words), (_PAIRS, block.pairs)):
                counts = np.stack([block.counts(kind, folds != HELD), block.counts(kind, folds == DELETED)]).astype(np.uint32)
                ends = np.searchsorted(keys >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
                yield _rows([
                    (row["block"], kind, k, _pack_sorted(keys[a:b]), _pack(counts[:, a:b]), None, b - a, 0)
                    for k, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)) if b > a
                ])

    return run


def _add_up(rows: list[dict]) -> Iterator[pa.RecordBatch]:
    """Totals over all blocks of the keys of one range and kind, sent back to each block in the order it sent them."""
    sizes = np.array([r["n"] for r in rows])
    keys, where = np.unique(np.concatenate([_unpack_sorted(r["a"]) for r in rows]), return_inverse=True)
    counts = np.concatenate([_unpack(r["b"], np.uint32).reshape(2, -1) for r in rows], axis=1)
    total = np.stack([np.bincount(where, c, len(keys)) for c in counts]).astype(np.uint64)
    kind, part = rows[0]["kind"], rows[0]["part"]
    if kind == _WORDS:
        real = keys != np.uint64(xxhash.xxh64_intdigest(_BEGIN))
        yield _rows([(-1, _TOTALS, part, None, None, [int(total[0][real].sum()), int(total[1][real].sum())], 0, int((total[0][real] > 0).sum()))])
    ends = np.cumsum(sizes)
    for r, a, b in zip(rows, ends - sizes, ends, strict=True):
        yield _rows([(r["block"], kind, part, _pack(total[:, where[a:b]].astype(np.uint64)), None, None, int(b - a), 0)])


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and (row["part"], row["kind"]) != (held[0]["part"], held[0]["kind"]):
                yield from _add_up(held)
                held = []
            held.append(row)
    if held:
        yield from _add_up(held)


def _with_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, Block, np.ndarray, np.ndarray]]:
    """Blocks with the totals (all training, deleted) of their words and of their pairs."""
    held: list[dict] = []

    def whole() -> tuple[list, Block, np.ndarray, np.ndarray]:
        if held[0]["kind"] != _DOCS:
            raise RuntimeError("counts without their block")
        block = _block_of(held[0]["a"])
        found = [[_unpack(r["a"], np.uint64).reshape(2, -1) for r in held if r["kind"] == k] for k in (_WORDS, _PAIRS)]
        words, pairs = (np.concatenate(x, axis=1).astype(np.float64) for x in found)
        if words.shape[1] != len(block.words) or pairs.shape[1] != len(block.pairs):
            raise RuntimeError("a block's n-grams and counts differ")
        return held[0]["ids"], block, words, pairs

    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            if held and row["block"] != held[0]["block"]:
                yield whole()
                held = []
            held.append(row)
    if held:
        yield whole()


def _class_of(count: np.ndarray) -> np.ndarray:
    return np.where(count > 0, np.floor(np.log2(np.maximum(count, 1))) + 1, 0).astype(np.int64)


@dataclass
class Totals:
    tokens: int
    deleted: int
    types: int


def _parts(block: Block, words: np.ndarray, pairs: np.ndarray, tokens: int, types: int) -> tuple[np.ndarray, ...]:
    """Class of the context, and the maximum-likelihood pair, word and uniform probabilities of each token."""
    context, joint = words[block.before], pairs[block.pair]
    pair = np.divide(joint, context, out=np.zeros(len(joint)), where=context > 0)
    return _class_of(context), pair, words[block.word] / max(tokens, 1), 1 / (types + 1)


def learn_weights(cells: np.ndarray, counts: np.ndarray, types: int, rounds: int = 200) -> np.ndarray:
    """Weights (pair, word, uniform) of each context class by expectation-maximisation over the cells' counts.

    cells: class, cell of the pair's and of the word's log probability (0: zero probability). Classes without counts
    take the weights of the nearest class below that has some, else above; with no counts at all, equal ones.
    """
    def value(cell: np.ndarray) -> np.ndarray:
        return np.where(cell > 0, np.exp(-(cell - 1 + 0.5) * CELL), 0.0)

    p = np.column_stack((value(cells[:, 1]), value(cells[:, 2]), np.full(len(cells), 1 / (types + 1))))
    weights = np.full((CLASSES, 3), 1 / 3)
    seen = np.bincount(cells[:, 0], counts, CLASSES)
    for _ in range(rounds):
        part = weights[cells[:, 0]] * p
        part *= (counts / part.sum(1))[:, None]
        new = np.stack([np.bincount(cells[:, 0], part[:, k], CLASSES) for k in range(3)], axis=1)
        new = np.where(seen[:, None] > 0, new / np.maximum(seen, 1)[:, None], weights)
        moved, weights = np.abs(new - weights).max(), new
        if moved < 1e-7:
            break
    full = np.flatnonzero(seen)
    for c in range(CLASSES):
        if len(full) and not seen[c]:
            weights[c] = weights[full[max(np.searchsorted(full, c) - 1, 0)]]
    return np.maximum(weights, 1e-9) / np.maximum(weights, 1e-9).sum(1, keepdims=True)


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs(doc_id, text).

    Null and wordless texts have one token, the end. A null id hashes as the empty text. Repeated rows count, and
    are scored, each; other columns are ignored; an empty table gives no rows. If nothing is trained on, every token
    has probability 1 / 1. A block that closes at BLOCK_BYTES holds one text at least, however long.
    """
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n = tasks(spark)
    bits = max(1, (n - 1).bit_length() + RANGE_BITS)
    blocks = cut(source.mapInArrow(_blocks, _SCHEMA))
    sent = blocks.mapInArrow(_key_rows(bits), _SCHEMA).repartition(n, "part").sortWithinPartitions("part", "kind")
    counts = cut(sent.mapInArrow(_count_rows, _SCHEMA))
    totals = counts.where(F.col("kind") == _TOTALS).agg(F.sum(F.col("ids")[0]), F.sum(F.col("ids")[1]), F.sum("types")).first()
    total = Totals(*(int(x or 0) for x in totals))

    def met(which: Column) -> DataFrame:
        return blocks.where(which).unionByName(counts.where(which)).repartition(n, "block").sortWithinPartitions("block", "kind", "part")

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, block, words, pairs in _with_counts(batches):
            group, pair, word, _ = _parts(block, words[0] - words[1], pairs[0] - pairs[1], total.tokens - total.deleted, total.types)
            place = [np.where(x > 0, np.minimum(-np.log(np.maximum(x, 1e-300)) / CELL, CELLS - 2).astype(np.int64) + 1, 0) for x in (pair, word)]
            key, count = np.unique((group * CELLS + place[0]) * CELLS + place[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(count)], ["cell", "n"])

    deleted = met((F.col("block") >= 0) & (F.col("block") % 2 == 1))
    found = deleted.mapInArrow(cells, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).orderBy("cell").collect()
    cell = np.array([r["cell"] for r in found], np.int64)
    weights = learn_weights(np.column_stack((cell // CELLS**2, cell // CELLS % CELLS, cell % CELLS)), np.array([r["n"] for r in found], np.float64), total.types)
    if not total.tokens:
        weights[:] = 0, 0, 1

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, block, words, pairs in _with_counts(batches):
            group, pair, word, uniform = _parts(block, words[0], pairs[0], total.tokens, total.types)
            w = weights[group]
            logs = np.log10(w[:, 0] * pair + w[:, 1] * word + w[:, 2] * uniform)
            seen = words[0][block.word]
            base = np.log10((seen + 1) / (total.tokens + total.types + 1))
            m = len(ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(block.lengths), pa.array(np.bincount(block.doc, seen > 0, m).astype(np.int64)), pa.array(np.bincount(block.doc, base, m)), pa.array(np.bincount(block.doc, logs, m))],
                ["doc_id", "n_tokens", "n_known", "base_score", "score"],
            )

    schema = "doc_id long, n_tokens long, n_known long, base_score double, score double"
    scored = met(F.col("block") >= 0).mapInArrow(scores, schema)
    return scored.select("doc_id", (fold("doc_id", FOLDS) == HELD).alias("held_out"), "n_tokens", "n_known", F.lit(total.tokens).cast("long").alias("train_tokens"), "base_score", "score")
