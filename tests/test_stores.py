"""Versioned tables, artefacts, the frame source, the log as a stream, and scans over any keys."""

import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from tomolake import queries
from tomolake.operators import scans, timeline
from tomolake.plans import artefacts
from tomolake.plans.store import Store, put
from tomolake.sources import arrays, tables
from tomolake.sources.versions import Part, Versioned
from tomolake.streaming import logs, photons


def numbers(spark, first, last, value):
    return spark.range(first, last).select(F.col("id").alias("n"), F.lit(value).alias("v"))


def values(df):
    return {r["n"]: r["v"] for r in df.collect()}


# ---- versions


def test_a_writer_that_dies_leaves_the_last_version(spark, tmp_path):
    """Half of the files are there when the write fails; no reader ever meets them, and the next writer is not disturbed."""
    store = Versioned(spark, str(tmp_path / "t"))
    assert store.read() is None and store.put(numbers(spark, 0, 10, "old")) == 1
    broken = numbers(spark, 0, 10, "new").repartition(5).withColumn("v", F.when(F.col("n") == 7, F.raise_error(F.lit("killed"))).otherwise(F.col("v")))
    with pytest.raises(Exception, match="killed"):
        store.put(broken)
    assert len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("rows-")]) == 2
    assert store.versions() == [1] and set(values(store.read()).values()) == {"old"}
    assert store.put(numbers(spark, 0, 3, "new")) == 2 and values(store.read()) == {n: "new" for n in range(3)}
    assert set(values(store.read(1)).values()) == {"old"}


def test_a_pinned_reader_keeps_its_rows(spark, tmp_path):
    store = Versioned(spark, str(tmp_path / "t"))
    store.upsert(numbers(spark, 0, 100, "a"), "n", 0, 100)
    pinned = store.read()
    store.upsert(numbers(spark, 20, 30, "b"), "n", 20, 30)
    store.upsert(numbers(spark, 25, 25, "c"), "n", 25, 60)  # a slice that has become empty
    assert set(values(pinned).values()) == {"a"} and pinned.count() == 100
    want = {n: "b" if 20 <= n < 25 else "a" for n in range(100) if not 25 <= n < 60}
    assert values(store.read()) == want
    before = store.read().count()
    store.compact()
    assert values(store.read()) == want and len(store.manifest()[1]) == 1 and before == len(want)
    store.vacuum()
    assert values(store.read()) == want and len(store.versions()) == 1 and len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("rows-")]) == 1


def test_rows_outside_the_range_are_an_error(spark, tmp_path):
    store = Versioned(spark, str(tmp_path / "t"))
    with pytest.raises(Exception, match="outside the range"):
        store.upsert(numbers(spark, 0, 11, "a"), "n", 0, 10)
    assert store.versions() == []
    store.put(numbers(spark, 0, 5, "x"))
    with pytest.raises(ValueError):
        store.upsert(numbers(spark, 0, 5, "a"), "n", 0, 10)


def test_writers_of_other_ranges_do_not_lose_each_other(spark, tmp_path):
    store = Versioned(spark, str(tmp_path / "t"))
    store.upsert(numbers(spark, 0, 80, "a"), "n", 0, 80)
    failed = []

    def write(k):
        try:
            Versioned(spark, str(tmp_path / "t")).upsert(numbers(spark, 10 * k, 10 * k + 10, f"w{k}"), "n", 10 * k, 10 * k + 10)
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed and store.versions() == list(range(1, 8))
    assert values(store.read()) == {n: f"w{n // 10}" if n < 60 else "a" for n in range(80)}


def test_a_second_claim_of_a_number_fails(spark, tmp_path):
    store = Versioned(spark, str(tmp_path / "t"))
    store.put(numbers(spark, 0, 1, "a"))
    assert not store._claim(1, [], {}) and store._claim(2, [], {})


def test_parts_less_ranges():
    p = Part("f", {}, "n", ((0, 10), (20, 30)))
    assert p.without(5, 25).ranges == ((0, 5), (25, 30)) and p.without(0, 30) is None and p.without(12, 15) == p


def test_partitions_replace_themselves(spark, tmp_path):
    path = str(tmp_path / "t")
    for label, v in (("x", 1), ("y", 2), ("x", 3)):
        put(spark.range(2).withColumn("v", F.lit(v)), path, label=label)
    found = Versioned(spark, path)
    assert sorted((r["label"], r["v"]) for r in found.read().collect()) == [("x", 3)] * 2 + [("y", 2)] * 2
    assert {r["v"] for r in found.read(label="y").collect()} == {2} and found.read(label="z") is None
    found.put_each(spark.createDataFrame([("y", 5), ("z", 6)], "label string, v int").withColumn("id", F.lit(0).cast("long")), "label")
    assert {(r["label"], r["v"]) for r in found.read().select("label", "v").collect()} == {("x", 3), ("y", 5), ("z", 6)}
    with pytest.raises(LookupError):
        Store(spark, str(tmp_path / "none")).read("frames", 0)


def test_slices_of_a_stream_come_once(spark, tmp_path):
    """Messages replace ranges of rows; a batch that is repeated after a failure changes nothing."""
    store = Versioned(spark, str(tmp_path / "t"))
    store.upsert(numbers(spark, 0, 40, "a"), "n", 0, 40)
    for k in range(3):
        numbers(spark, 10 * k, 10 * k + 10, f"s{k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = photons.photon_stream(spark, str(tmp_path / "in"), "n long, v string", 1)
    for _ in range(2):
        photons.keep_slices(stream, store, "n", "slices", str(tmp_path / "check")).awaitTermination()
    assert values(store.read()) == {n: f"s{n // 10}" if n < 30 else "a" for n in range(40)}
    number = store.manifest()[0]
    assert store.upsert(numbers(spark, 0, 10, "again"), "n", 0, 10, ("slices", 0)) == number and values(store.read())[0] == "s0"


# ---- artefacts


def test_a_changed_setting_makes_what_depends_on_it(spark, tmp_path):
    made = artefacts.Artefacts(spark, str(tmp_path / "a"))
    calls = []

    def recipe(name, after=(), settings=()):
        def make(parts, s):
            calls.append(name)
            assert set(parts) == set(after) and set(s) == set(settings)
            return spark.range(sum(p.count() for p in parts.values()) + sum(s.values()) + 1)

        return artefacts.Recipe(name, make, after, settings)

    recipes = [recipe("both", ("mapping", "data")), recipe("mapping", ("geometry",), ("order",)), recipe("geometry", (), ("size",)), recipe("data")]
    inputs, settings = {"data": spark.range(5)}, {"order": 1, "size": 2}

    def build(**options):
        calls.clear()
        stale = made.stale(recipes, settings, inputs)
        rows = {n: d.count() for n, d in made.build(recipes, settings, inputs, **options).items()}
        return sorted(stale), sorted(calls), rows["both"]

    every = ["both", "data", "geometry", "mapping"]
    assert build() == (every, every, 7) and build() == ([], [], 7)
    settings["order"] = 3
    assert build() == (["both", "mapping"], ["both", "mapping"], 9)
    settings["size"] = 4
    assert build()[1] == ["both", "geometry", "mapping"]
    inputs["data"] = spark.range(5).withColumn("id", F.col("id") * 2)
    assert build()[1] == ["both", "data"]
    settings["order"] = 9
    assert build(keep=("mapping",))[1] == ["both"] and made.version("geometry") == 2
    with pytest.raises(ValueError):
        artefacts.in_order([recipe("x", ("y",)), recipe("y", ("x",))])
    with pytest.raises(ValueError):
        artefacts.in_order([recipe("x", ("nothing",))])
    rows = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    assert artefacts.contents(rows.repartition(3)) == artefacts.contents(rows) != artefacts.contents(rows.withColumn("v", F.lit("a")))


# ---- frames


def frames(spark, rows=400, seed=0):
    rng = np.random.default_rng(seed)
    found = [(int(d), int(i), int(rng.integers(1, 9))) for d in rng.choice(10**9, rows, replace=False) for i in rng.choice(64, 5, replace=False)]
    return spark.createDataFrame(found, "d long, i int, k int"), sorted({r[0] for r in found})


def test_frames_come_back_from_the_files_of_their_range(spark, tmp_path, monkeypatch):
    rows, ids = frames(spark)
    path = str(tmp_path / "f")
    index = arrays.write_frames(rows, path, file_photons=100)
    assert sum(x["photons"] for x in index) == 2000 and len(index) > 10 and all(a["last"] < b["first"] for a, b in zip(index, index[1:], strict=False))
    assert tables.same_rows(arrays.read_frames(spark, path), rows)
    low, high = ids[100], ids[140]
    want = rows.where(f"d >= {low} AND d < {high} AND k > 2")
    assert tables.same_rows(arrays.read_frames(spark, path, low, high - 1).where("k > 2"), want)
    assert tables.same_rows(arrays.read_frames(spark, path, ids[7], ids[7]), rows.where(f"d = {ids[7]}"))
    assert arrays.read_frames(spark, path, 2_000_000_000).count() == 0 and arrays.read_frames(spark, path, last=ids[0] - 1).count() == 0

    parts = arrays.slices(index, low, high - 1)
    read = [arrays.read_slice(path, p)[1] for p in parts]
    whole = sum(arrays.read_slice(path, p)[1] for p in arrays.slices(index, None, None))
    touched = [x for x in index if x["last"] >= low and x["first"] < high]
    assert len(parts) == len(touched) < len(index) / 2 and sum(read) < whole / 5
    # Ids of the files that are touched, an offset a frame and one more, and eight bytes a photon.
    assert sum(read) == 8 * sum(x["frames"] for x in touched) + 8 * (40 + len(parts)) + 8 * 40 * 5
    assert len(arrays.slices(index, None, None, most=30)) > 2 * len(index)


def test_reads_of_one_table_do_not_share_filters(spark, tmp_path):
    rows, ids = frames(spark, 60)
    path = str(tmp_path / "f")
    arrays.write_frames(rows, path, file_photons=20)
    all_, some = arrays.read_frames(spark, path), arrays.read_frames(spark, path, ids[10], ids[12])
    assert some.rdd.getNumPartitions() < all_.rdd.getNumPartitions() and some.count() == 15
    assert all_.where(f"d = {ids[3]}").count() == 5 and all_.count() == 300


def test_frames_as_a_stream(spark, tmp_path):
    """Files that arrive later are a later batch; none comes twice."""
    path, out, check = (str(tmp_path / x) for x in ("f", "out", "check"))
    first, _ = frames(spark, 30, 1)
    second, _ = frames(spark, 20, 2)
    for rows in (first, second):
        arrays.write_frames(rows, path, file_photons=40)
        stream = arrays.stream_frames(spark, path).writeStream.format("parquet").option("path", out).option("checkpointLocation", check)
        query = stream.trigger(processingTime="1 second").start()
        query.processAllAvailable()
        query.stop()
    assert tables.same_rows(spark.read.parquet(out), first.union(second))


def test_a_damaged_or_empty_folder(spark, tmp_path):
    path = str(tmp_path / "f")
    assert arrays.write_frames(frames(spark, 3)[0].limit(0), path) == [] and arrays.read_frames(spark, path).count() == 0


# ---- the log


def test_log_over_any_cut_into_files(spark, tmp_path):
    """Intervals that batches cut, several stops, starts while open and stops without a start; a run that is stopped goes on."""
    rng = np.random.default_rng(6)
    marks = spark.createDataFrame([(int(rng.integers(4)), f"m{rng.integers(2)}", float(t), "start" if rng.random() < 0.5 else "stop") for t in rng.permutation(120)], "pid int, msg string, t double, kind string")
    want = timeline.paired(marks)
    logs.in_order(marks, str(tmp_path / "in"), 7)
    schema = "pid int, msg string, t double, kind string"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    logs.keep_intervals(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert tables.same_rows(logs.intervals(spark, str(tmp_path / "out")), want.select("pid", "msg", "number", "start", "stop", "fault"))
    more = spark.createDataFrame([(0, "m0", 500.0, "start"), (9, "m0", 501.0, "stop"), (0, "m0", 502.0, "stop")], schema)
    more.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    logs.keep_intervals(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert tables.same_rows(logs.intervals(spark, str(tmp_path / "out")), timeline.paired(marks.union(more)).select("pid", "msg", "number", "start", "stop", "fault"))


# ---- scans


@pytest.mark.parametrize("parts", [1, 7, 50])
def test_scans_of_random_keys(spark, parts):
    """Keys spread over all 64 bits: one carried row for each range, whatever the keys."""
    rng = np.random.default_rng(parts)
    keys = rng.choice(2**62, 500, replace=False) - 2**61
    sizes = rng.integers(0, 9, 500)
    rows = spark.createDataFrame([(int(k), int(s)) for k, s in zip(keys, sizes, strict=True)], "k long, s long")
    order = np.argsort(keys)
    starts = dict(zip(keys[order].tolist(), (np.cumsum(sizes[order]) - sizes[order]).tolist(), strict=True))
    found = scans.running_sum(rows, ["k"], "s", parts=parts)
    assert {r["k"]: r["start"] for r in found.collect()} == starts
    assert scans.ranged(rows, ["k"], parts).select("part").distinct().count() <= parts
    value = {int(k): None if s == 0 else int(s > 3) for k, s in zip(keys, sizes, strict=True)}
    runs = sorted((r["first"], r["last"], r["value"]) for r in scans.runs(spark.createDataFrame(list(value.items()), "k long, v int"), "k", "v", parts).collect())
    want = []
    for k in sorted(value):
        if want and want[-1][2] == value[k]:
            want[-1][1] = k
        else:
            want.append([k, k, value[k]])
    assert runs == [tuple(w) for w in want] or sorted(map(str, runs)) == sorted(str(tuple(w)) for w in want)


def test_scans_of_nothing_and_of_one_value(spark):
    none = spark.createDataFrame([], "k long, v int")
    assert scans.runs(none, "k", "v").count() == 0 and scans.running_sum(none, ["k"], "v").count() == 0
    one = spark.range(1000).withColumn("v", F.lit("x"))
    assert [tuple(r) for r in scans.runs(one, "id", "v", 9).collect()] == [(0, 999, "x")]


def test_every_query_reads_a_table(spark, sf):
    """No plan of a registered query is without a scan of a file."""
    from pathlib import Path

    text = Path(queries.__file__).read_text()
    assert "spark.range(400)" not in text
    for name in ("rotations_3d", "sample_linear_3d", "symmetry_partners", "gaussian_blob", "mapping_rows", "voxel_index", "chunk_ranges", "rotation_operators"):
        assert queries.QUERIES[name](spark, sf).inputFiles(), name
