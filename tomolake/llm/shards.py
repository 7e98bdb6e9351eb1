"""Token ids in files of independent zstandard frames with a trailing seek table.

Layout of a file: one frame per document (its ids, little-endian, unsigned, 16 or 32 bits), one frame with the
document ids, and a skippable frame, the seek table of the public zstandard seekable format: for every frame its
compressed size, its size and the low 32 bits of its content's XXH64, then the number of frames, a flag byte and a
magic number. A reader of some documents reads the table and the id frame, and then only those documents' frames.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomolake.llm.common import pieces, place, shared_dir, tasks

# Fixed values of the seekable format and of the byte-level pre-tokenizer.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC, WITH_CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80
PRETOKENS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

END_ID = 2
#: Frames that one task of a full read takes.
FRAMES = 20_000


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the rest in order from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteEncoder:
    """ids of whole texts as the tokenizers library gives them for a tokenizer file.

    Where the file is plain byte-level BPE whose merges stand in the order of their ids, the same merges are run by
    the rank encoder of tiktoken, which gives the same ids in a quarter of the time. Texts that hold the string of
    an added token, texts that it refuses, and files of any other kind go to the tokenizers library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        self.added = [x["content"] for x in spec.get("added_tokens", [])]
        self.vocabulary = self.library.get_vocab_size()
        plain = (
            not spec.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex", True)
            and not pre.get("add_prefix_space") and (spec.get("post_processor") or {}).get("type", "ByteLevel") == "ByteLevel"
            and model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "byte_fallback", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix"))
        )
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model.get("merges", [])]
        plain = plain and all(model["vocab"].get(a + b) == 256 + k for k, (a, b) in enumerate(merges))
        self.fast = None
        if plain:
            import tiktoken

            of = _byte_of()
            ranks = {bytes(map(of.__getitem__, t)): i for t, i in model["vocab"].items() if t not in self.added}
            self.fast = tiktoken.Encoding("file", pat_str=PRETOKENS, mergeable_ranks=ranks, special_tokens={})

    def _ask(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _one(self, text: str) -> bytes:
        if self.fast is None or any(a in text for a in self.added):
            return self._ask(text)
        try:
            return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()
        except ValueError:  # the pattern engine gives up on some very long runs
            return self._ask(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        return [self._one(t) for t in texts]


@lru_cache(1)
def encoder_of(path: str) -> ByteEncoder:
    return ByteEncoder(path)


class ShardWriter:
    def __init__(self, sink, level: int = 3):
        self.sink, self.table, self.ids = sink, [], []
        self.compressor = zstandard.ZstdCompressor(level=level, write_content_size=True)

    def _frame(self, data: bytes) -> None:
        packed = self.compressor.compress(data)
        self.sink.write(packed)
        self.table.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.ids.append(doc_id)
        self._frame(ids.tobytes())

    def finish(self, width: int) -> int:
        """Writes ids and table; the file's size."""
        none = np.array([x is None for x in self.ids], np.uint8)
        self._frame(bytes([width]) + np.array([x or 0 for x in self.ids], "<i8").tobytes() + none.tobytes())
        rows = np.array(self.table, "<u4").tobytes()
        foot = len(self.table).to_bytes(4, "little") + bytes([WITH_CHECKSUMS]) + SEEKABLE_MAGIC.to_bytes(4, "little")
        self.sink.write(SKIPPABLE_MAGIC.to_bytes(4, "little") + (len(rows) + len(foot)).to_bytes(4, "little") + rows + foot)
        return sum(x[0] for x in self.table) + 8 + len(rows) + len(foot)


class ShardReader:
    """Random access to a file; every frame read is held against its checksum."""

    def __init__(self, source):
        self.source, size = source, source.size()
        foot = self._at(size - 9, 9)
        if int.from_bytes(foot[5:], "little") != SEEKABLE_MAGIC or foot[4] != WITH_CHECKSUMS:
            raise ValueError("no seek table")
        n = int.from_bytes(foot[:4], "little")
        self.table = np.frombuffer(self._at(size - 9 - 12 * n, 12 * n), "<u4").reshape(n, 3)
        self.starts = np.concatenate(([0], np.cumsum(self.table[:, 0].astype(np.int64))))
        self.unpack = zstandard.ZstdDecompressor()
        ids = self.frame(n - 1)
        self.docs, self.width = n - 1, ids[0]
        self.doc_ids = np.frombuffer(ids, "<i8", n - 1, 1)
        self.no_id = np.frombuffer(ids, np.uint8, n - 1, 1 + 8 * (n - 1)).astype(bool)

    def _at(self, start: int, size: int) -> bytes:
        self.source.seek(int(start))
        return self.source.read(int(size))

    def frame(self, k: int) -> bytes:
        data = self.unpack.decompress(self._at(self.starts[k], self.table[k, 0]), max_output_size=int(self.table[k, 1]))
        if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.table[k, 2] or len(data) != self.table[k, 1]:
            raise ValueError(f"frame {k} is damaged")
        return data

    def document(self, k: int) -> np.ndarray:
        return np.frombuffer(self.frame(k), f"<u{self.width}").astype("<u4")

    def lengths(self) -> np.ndarray:
        """Number of ids of each document, from the table alone."""
        return self.table[: self.docs, 1].astype(np.int64) // self.width


def open_shard(path: str) -> ShardReader:
    fs, own = place(path)
    return ShardReader(fs.open_input_file(own))


def write_shards(docs: DataFrame, tokenizer: str, folder: str, files: int | None = None, end_id: int | None = END_ID) -> list[dict]:
    """Writes docs(doc_id, text) in ascending doc_id order (nulls first, ties by a hash of the text) to files in folder.

    Returns the manifest, a row for each file in order: file, docs, tokens, start (tokens of all files before it).
    A file bears its task attempt in its name and only finished attempts are in the manifest, so that a lost executor
    or a repeated task leaves nothing wrong to read. Null texts count as empty: they have only the end id.
    """
    spark = docs.sparkSession
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, encoder, writer = TaskContext.get(), encoder_of(tokenizer), None
        width = 2 if max(encoder.vocabulary, (end_id or 0) + 1) <= 1 << 16 else 4
        name = f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}-{task.attemptNumber()}.tokens.zst"
        tokens = 0
        for batch in pieces(batches):
            if writer is None:
                fs, own = place(name)
                fs.create_dir(own.rpartition("/")[0], recursive=True)
                sink = fs.open_output_stream(own, compression=None)
                writer = ShardWriter(sink)
            encoded = encoder.encode([x or "" for x in batch.column(1).to_pylist()])
            for doc_id, data in zip(batch.column(0).to_pylist(), encoded, strict=True):
                ids = np.frombuffer(data, "<u4")
                ids = ids if end_id is None else np.append(ids, end_id)
                writer.add(doc_id, ids.astype(f"<u{width}"))
                tokens += len(ids)
        if writer is not None:
            writer.finish(width)
            sink.close()
            yield pa.RecordBatch.from_pydict({"part": [task.partitionId()], "file": [name], "docs": [len(writer.ids)], "tokens": [tokens]})

    hashed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = ["doc_id", F.xxhash64("text"), "text"]
    dealt = hashed.repartitionByRange(files or tasks(spark), *order[:2]).sortWithinPartitions(*order)
    rows = sorted((r.asDict() for r in dealt.mapInArrow(write, "part long, file string, docs long, tokens long").collect()), key=lambda r: r["part"])
    start = 0
    for r in rows:
        r["start"] = start
        start += r["tokens"]
    return rows


def read_shards(spark: SparkSession, manifest: list[dict], with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of every document in the files of a manifest."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    runs = [(r["file"], at, min(FRAMES, r["docs"] - at), r["start"]) for r in manifest for at in range(0, r["docs"], FRAMES)]
    if not runs:
        return spark.createDataFrame([], schema)

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in batch.to_pylist():
                reader = open_shard(run["file"])
                sizes = reader.lengths()
                starts = run["start"] + np.cumsum(sizes) - sizes
                for first in range(run["first"], run["first"] + run["n"], 1024):
                    ks = range(first, min(first + 1024, run["first"] + run["n"]))
                    own = [reader.document(k) for k in ks]
                    at = slice(ks.start, ks.stop)
                    cols = [
                        pa.array(reader.doc_ids[at], mask=reader.no_id[at]), pa.array(starts[at]),
                        pa.array([len(x) for x in own], pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in own], pa.int64()),
                    ]
                    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                    if with_ids:
                        cols, names = [*cols, pa.array([x.astype(np.int64) for x in own], pa.list_(pa.int64()))], [*names, "ids"]
                    yield pa.RecordBatch.from_arrays(cols, names)

    jobs = spark.createDataFrame(runs, "file string, first long, n long, start long").repartition(min(len(runs), 10_000))
    return jobs.mapInArrow(read, schema)


def token_files(docs: DataFrame, tokenizer: str, folder: str | None = None) -> DataFrame:
    """Writes docs and reads them back: doc_id, start, n_tokens, ids_crc32, a row for each row of docs.

    Repeated ids are documents of their own; an empty table writes no file and gives no rows; other columns are
    ignored. folder: a shared one, by default a new one under spark.checkpoint.dir.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/token-shards-{uuid.uuid4().hex}"
    return read_shards(spark, write_shards(docs, tokenizer, folder), with_ids=False)
