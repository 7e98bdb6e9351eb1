"""Count frames as plain arrays on disk, and a data source that reads ranges of them.

A file of frames holds, one behind the other, the public .npy images of four arrays of little-endian numbers: frame ids
(ascending), where each frame's photons begin and the last end, pixels, and counts. An index lists every file with its
first and last frame, its photons and the place of each array's numbers; so a reader of a range opens only the files
that have some of it, and of these reads the ids, two offsets and the photons between them.
"""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "d bigint, i int, k int"
KINDS = {"d": "<i8", "at": "<i8", "i": "<i4", "k": "<i4"}
#: Photons of a file, and of a partition of a read, about.
FILE_PHOTONS, READ_PHOTONS = 4_000_000, 1_000_000


def _place(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _image(values: np.ndarray) -> tuple[bytes, int]:
    """The .npy image of an array and the length of its header."""
    out = io.BytesIO()
    np.save(out, values)
    data = out.getvalue()
    return data, len(data) - values.nbytes


def _write_file(folder: str, name: str, photons: pa.Table) -> dict:
    """Writes photons sorted by frame; the file's row of the index."""
    d, i, k = (photons.column(c).to_numpy() for c in "dik")
    ids, starts = np.unique(d, return_index=True)
    arrays = {"d": ids, "at": np.append(starts, len(d)), "i": i, "k": k}
    places, at, images = {}, 0, []
    for c, values in arrays.items():
        data, head = _image(values.astype(KINDS[c]))
        places[c] = at + head
        at += len(data)
        images.append(data)
    fs, own = _place(folder)
    fs.create_dir(own, recursive=True)
    with fs.open_output_stream(f"{own}/{name}", compression=None) as sink:
        for data in images:
            sink.write(data)
    return {"file": name, "first": int(ids[0]), "last": int(ids[-1]), "frames": len(ids), "photons": len(d), "places": places}


def write_frames(photons: DataFrame, path: str, file_photons: int = FILE_PHOTONS) -> list[dict]:
    """Writes photons(d, i, k) as files of whole frames, ranges of d each, with an index; returns the index.

    A file bears a name of its own, and the index lists those of finished tasks, so a repeated task leaves nothing that
    is read. A frame is never split, so a file may be larger than asked for by one frame.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(rows: pa.Table) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"row": [json.dumps(_write_file(path, f"{uuid.uuid4().hex}.frames", rows))]})

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= file_photons:
                rows = pa.Table.from_batches(held)
                d, start = rows.column("d").to_numpy(), 0
                while len(d) - start >= file_photons:
                    end = int(np.searchsorted(d, d[start + file_photons - 1], "right"))
                    if end == len(d):  # the last frame may go on
                        break
                    yield done(rows.slice(start, end - start))
                    start = end
                held = rows.slice(start).to_batches()
        if sum(b.num_rows for b in held):
            yield done(pa.Table.from_batches(held))

    dealt = photons.selectExpr("CAST(d AS BIGINT) AS d", "CAST(i AS INT) AS i", "CAST(k AS INT) AS k").where("k > 0")
    dealt = dealt.repartitionByRange("d").sortWithinPartitions("d", "i")
    index = sorted((json.loads(r["row"]) for r in dealt.mapInArrow(write, "row string").collect()), key=lambda x: x["first"])
    fs, own = _place(path)
    fs.create_dir(own, recursive=True)
    with fs.open_output_stream(f"{own}/index-{uuid.uuid4().hex}.json", compression=None) as sink:
        sink.write(json.dumps(index).encode())
    return index


def index_of(path: str) -> list[dict]:
    """Rows of all indices in a folder, in the order in which they were written; a folder may be added to."""
    fs, own = _place(path)
    found = [f for f in fs.get_file_info(pafs.FileSelector(own)) if f.base_name.startswith("index-")]
    out = []
    for f in sorted(found, key=lambda f: (f.mtime_ns or 0, f.base_name)):
        with fs.open_input_file(f.path) as source:
            out += json.loads(source.read())
    return out


class Slice(InputPartition):
    """Frames first to last of one file."""

    def __init__(self, file: dict, first: int, last: int):
        super().__init__(None)
        self.file, self.first, self.last = file, first, last


def read_slice(path: str, part: Slice) -> tuple[list[np.ndarray], int]:
    """d, i and k of the photons of a slice, and the bytes that were read for them."""
    fs, own = _place(path)
    places, total = part.file["places"], 0
    with fs.open_input_file(f"{own}/{part.file['file']}") as source:

        def some(c: str, first: int, n: int) -> np.ndarray:
            nonlocal total
            kind = np.dtype(KINDS[c])
            source.seek(places[c] + first * kind.itemsize)
            total += n * kind.itemsize
            return np.frombuffer(source.read(n * kind.itemsize), kind)

        ids = some("d", 0, part.file["frames"])
        a, b = np.searchsorted(ids, part.first, "left"), np.searchsorted(ids, part.last, "right")
        if a >= b:
            return [np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)], total
        at = some("at", int(a), int(b - a) + 1)
        n = int(at[-1] - at[0])
        d = np.repeat(ids[a:b], np.diff(at))
        return [d, some("i", int(at[0]), n), some("k", int(at[0]), n)], total


def slices(index: list[dict], first: int | None, last: int | None, most: int = READ_PHOTONS) -> list[Slice]:
    """The files that have frames from first to last, large ones in shares of about so many photons by frame number."""
    out = []
    for file in index:
        a, b = max(file["first"], file["first"] if first is None else first), min(file["last"], file["last"] if last is None else last)
        if a <= b:
            shares = max(1, min(-(-file["photons"] // most), b - a + 1))
            cuts = [a + (b - a + 1) * s // shares for s in range(shares + 1)]
            out += [Slice(file, x, y - 1) for x, y in zip(cuts, cuts[1:], strict=False) if x < y]
    return out


def _batches(path: str, part: Slice) -> Iterator[pa.RecordBatch]:
    (d, i, k), _ = read_slice(path, part)
    yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(i, pa.int32()), pa.array(k, pa.int32())], ["d", "i", "k"])


class FrameReader(DataSourceReader):
    """The bounds come as options and not as pushed filters: Spark keeps the filters that a Python source has taken with
    the DataFrame, so that its next read, under other filters, would miss rows."""

    def __init__(self, path: str, first: int | None, last: int | None):
        self.path, self.first, self.last = path, first, last

    def partitions(self) -> list[Slice]:
        return slices(index_of(self.path), self.first, self.last) or [Slice({}, 0, -1)]

    def read(self, part: Slice) -> Iterator[pa.RecordBatch]:
        return _batches(self.path, part) if part.file else iter(())


class FrameStream(DataSourceStreamReader):
    """Files in the order of the index; an offset is a number of files."""

    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:  # noqa: N802
        return {"files": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"files": len(index_of(self.path))}

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        return slices(index_of(self.path)[start["files"] : end["files"]], None, None)

    def read(self, part: Slice) -> Iterator[pa.RecordBatch]:
        return _batches(self.path, part)


class Frames(DataSource):
    """Format "frames", options path, first and last: photons (d, i, k) of a folder of frame files, those of the frames from
    first to last if given, as a table or as a stream."""

    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FrameReader:
        return FrameReader(self.options["path"], *(int(x) if (x := self.options.get(c)) else None for c in ("first", "last")))

    def streamReader(self, schema) -> FrameStream:  # noqa: N802
        return FrameStream(self.options["path"])


def read_frames(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """Photons of the frames from first to last; files without any are not opened."""
    spark.dataSource.register(Frames)
    bounds = {c: str(x) for c, x in (("first", first), ("last", last)) if x is not None}
    return spark.read.format("frames").options(path=path, **bounds).load()


def stream_frames(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(Frames)
    return spark.readStream.format("frames").option("path", path).load()
