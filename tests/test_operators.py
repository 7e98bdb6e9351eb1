"""Invariants, edge cases and independent formulations of the operators."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tomolake.operators import estep, geometry, mstep, report, symmetry, timeline
from tomolake.plans import em, initial
from tomolake.sources import tables
from tomolake.streaming import photons as streaming


def test_posterior_sums_to_one(spark):
    logr = spark.createDataFrame([(d, r, float((d * 7 + r * 3) % 5)) for d in range(20) for r in range(6)], "d long, r int, logr double")
    post = estep.posterior(logr, 1.0, 0.1)
    assert all(abs(x["s"] - 1) < 1e-12 for x in post.groupBy("d").agg(F.sum("p").alias("s")).collect())
    assert post.count() < 120 and estep.posterior(logr, 1.0, 0.1, keep_zero=True).count() == 120


def test_first_of_equal_posteriors_wins(spark):
    post = spark.createDataFrame([(1, 3, 0.5), (1, 2, 0.5), (2, 0, 1.0)], "d long, r int, p double")
    assert {(x["d"], x["r"]) for x in estep.most_likely(post).collect()} == {(1, 2), (2, 0)}


def test_background_likelihood_without_background(spark, sf):
    """With no background and unit fluence it is the plain one and the logarithms of the corrections."""
    photons, templates, weights = tables.lineitem_photons(spark, sf), tables.lineitem_templates(spark, sf), tables.pixel_weights(16, spark)
    sums, frames = estep.template_sums(templates, weights), estep.frame_sums(photons)
    none = spark.createDataFrame([(0, i, 0.0) for i in range(16)], "b int, i int, v double")
    full = frames.select("d", "ksum", F.lit(1.0).alias("fluence"), F.lit(0).alias("bg_id"), F.lit(1.0).alias("bg_weight"))
    a = estep.log_likelihood_background(photons, templates, weights, full, none, sums)
    corrections = photons.join(weights, "i").groupBy("d").agg(F.sum(F.col("k") * F.ln("c")).alias("extra"))
    b = estep.log_likelihood(estep.k_dot_log_w(photons, templates), frames, sums).join(corrections, "d").select("d", "r", (F.col("logr") + F.col("extra")).alias("other"))
    assert a.join(b, ["d", "r"]).agg(F.max(F.abs(F.col("logr") - F.col("other")))).first()[0] < 1e-8


def test_unknown_likelihood(spark):
    with pytest.raises(ValueError):
        estep.log_likelihood(None, None, None, "Poisson_fluence_free", "fluence")
    with pytest.raises(ValueError):
        em.Config.of({"no_such": 1})


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.floats(0, 100), st.one_of(st.just(0.0), st.floats(1e-3, 50))), max_size=12), st.one_of(st.floats(-1, 0), st.floats(1e-3, 50)))
def test_root_solves_its_equation(terms, c):
    a, b = np.array([t[0] for t in terms]), np.array([t[1] for t in terms])
    a = np.where(a < 1e-3, 0, a)
    for halley in (True, False):
        x = mstep.solve_root(a, b, c, fill=-7.0, xtol=1e-10, ftol=1e-10, halley=halley)
        b_, a_ = b[a > 0], a[a > 0]
        if not len(a_) or c <= 0:
            assert x == -7.0
        elif x == 0:
            assert (b_ > 0).all() and (a_ / b_).sum() <= c * (1 + 1e-9)
        else:
            assert abs((a_ / (x + b_)).sum() - c) < 1e-4 * c


@pytest.mark.parametrize("size", [4, 5])
def test_symmetry(spark, size):
    grid = symmetry.voxels(spark, size, 3)
    model = report.random_model(grid)
    same = symmetry.symmetrised(model, ["value"], size, 3, "P1").join(model.withColumnRenamed("value", "v"), "n")
    assert same.where("value <> v").isEmpty() and same.count() == size**3
    whole = symmetry.expanded(model.join(symmetry.asymmetric_unit(grid, size, 3, "D6"), "n"), size, 3, "D6")
    assert whole.count() == size**3
    pairs = symmetry.partners(grid, size, 3, "D6")
    values = pairs.join(whole.withColumnRenamed("value", "a"), "n").join(whole.select(F.col("n").alias("partner"), F.col("value").alias("b")), "partner")
    assert values.where("abs(a - b) > 1e-12").isEmpty()
    with pytest.raises(ValueError):
        symmetry.partners(grid, size, 3, "C7")


def test_rotations_are_rotations(spark):
    rows = np.array([[r[f"a{i}{j}"] for i in range(3) for j in range(3)] for r in geometry.rotations_3d(spark, 3).collect()]).reshape(-1, 3, 3)
    assert np.allclose(rows @ rows.transpose(0, 2, 1), np.eye(3), atol=1e-12) and np.allclose(np.linalg.det(rows), 1)
    assert [math.prod(geometry.rotation_counts(m)) for m in (1, 2, 4, 8)] == [20, 91, 663, 5454]


def test_sampling_outside_is_zero(spark):
    model = spark.createDataFrame([(0, 2.0)], "n long, value double")
    at = spark.createDataFrame([(0, 0.0, 0.0), (1, -0.5, 0.0), (2, 9.0, 9.0), (3, 0.5, 0.5)], "i int, u0 double, u1 double")
    assert {r["i"]: r["w"] for r in geometry.sampled(at, model, 4, 2, keys=("i",)).collect()} == {0: 2.0, 1: 1.0, 2: 0.0, 3: 0.5}
    assert {r["i"]: r["w"] for r in geometry.sampled(at, model, 4, 2, "nearest", ("i",)).collect()} == {0: 2.0, 1: 2.0, 2: 0.0, 3: 0.0}


def test_likelihood_does_not_fall(spark):
    """With every voxel one pixel and no thresholds, an iteration is exact, and Q plus the posteriors' entropy rises."""
    rng = np.random.RandomState(3)
    truth = rng.rand(2, 8) * 5 + 0.2
    rows = [(d, i, int(k)) for d in range(60) for i, k in enumerate(rng.poisson(truth[d % 2])) if k]
    photons, weights = spark.createDataFrame(rows, "d long, i int, k int"), spark.createDataFrame([(i, 1.0) for i in range(8)], "i int, c double")
    voxels = spark.createDataFrame([(r, i, r * 8 + i) for r in range(2) for i in range(8)], "r int, i int, n long")
    model = spark.createDataFrame([(n, 1.0 + float(rng.rand())) for n in range(16)], "n long, value double")
    state, seen = em.State(estep.frame_sums(photons).withColumn("fluence", F.lit(1.0)), voxels, model), []
    for _ in range(4):
        state, post = em.step(state, photons, weights, em.Config(threshold=0.0), 1.0)
        seen.append(post.agg(F.sum(F.col("p") * (F.col("logr") - F.ln("p")))).first()[0])
    assert all(b >= a - 1e-9 for a, b in zip(seen, seen[1:], strict=False))
    again, metrics = em.run(state, photons, weights, em.Config(iterations=2), first=1)
    assert metrics.count() == 1


def test_stale_parts():
    assert em.stale({"scale": 1}, {"scale": 2}) == {"mapping"}
    assert em.stale({"model_length": 8}, {"model_length": 16}, keep_model=True) == {"geometry", "mapping", "data"}
    assert em.stale({"threshold": 1}, {"threshold": 1}) == set()


def test_cache(spark, tmp_path):
    rows = spark.createDataFrame([(d, i, 1 + d % 3) for d in range(50) for i in range(d % 4)], "d long, i int, k int")
    tables.write_cache(rows, str(tmp_path / "cache"), 4)
    assert tables.same_rows(rows, tables.read_cache(spark, str(tmp_path / "cache")))
    assert tables.read_cache(spark, str(tmp_path / "cache"), 10, 19).select("d").distinct().count() == 8
    assert tables.cache_key(spark.range(3).toDF("i")) != tables.cache_key(spark.range(1, 4).toDF("i"))
    assert tables.densify(rows, 4, spark.range(50).toDF("d")).count() == 200
    assert tables.select_frames(rows, None) is rows


def test_log_file(spark, tmp_path):
    path = tmp_path / "run.log"
    path.write_text("1.5:INFO:7:a.py:f:3: load (start)\n2.5:INFO:7:a.py:f:9: load (stop)\nnonsense\n3.0:INFO:7:a.py:f:3: load (start)\n0.5:INFO:8:a.py:f:9: save (stop)\n")
    found = {(r["pid"], r["msg"], r["start"], r["stop"], r["fault"]) for r in timeline.paired(timeline.read_log(spark, str(path))).collect()}
    assert found == {("7", "load", 1.5, 2.5, None), ("7", "load", 3.0, None, None), ("8", "save", None, 0.5, "stop without start")}


def test_packed_lines_do_not_overlap(spark):
    rng = np.random.RandomState(1)
    spans = spark.createDataFrame([("m", float(s), float(s + w)) for s, w in zip(rng.randint(0, 100, 60), rng.randint(1, 20, 60), strict=True)], "msg string, start double, stop double")
    lines = {}
    for r in sorted(timeline.packed(spans).collect(), key=lambda r: r["start"]):
        assert lines.get(r["line"], -1) <= r["start"]
        lines[r["line"]] = r["stop"]


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(f"2024-01-0{d} 00:10:00", k % 3, k) for d in (1, 2, 3) for k in range(6)], "t string, key int, k int").select(F.to_timestamp("t").alias("ts"), "key", "k")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = streaming.keep_current(stream.select("key", "k"), str(tmp_path / "out"), ["key"], str(tmp_path / "mark"))
    q.awaitTermination()
    assert streaming.latest(spark.read.parquet(str(tmp_path / "out")), ["key"]).count() == 3
    q = streaming.running_sums(stream).writeStream.outputMode("complete").format("memory").queryName("sums").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("sums").agg(F.sum("ksum")).first()[0] == 45


def test_abandoned_template_keeps_its_model(spark):
    """Frames that fit one template leave the other without mass: it keeps its model and wins no frame later."""
    shapes = {0: [9.0, 4.0, 1.0], 1: [1.0, 1.0, 1.0]}
    photons = spark.createDataFrame([(d, i, 10 * int(k)) for d in range(3) for i, k in enumerate(shapes[0])], "d long, i int, k int")
    weights = spark.createDataFrame([(i, 1.0) for i in range(3)], "i int, c double")
    voxels = spark.createDataFrame([(r, i, 3 * r + i) for r in shapes for i in range(3)], "r int, i int, n long")
    model = spark.createDataFrame([(3 * r + i, w) for r, ws in shapes.items() for i, w in enumerate(ws)], "n long, value double")
    frames = estep.frame_sums(photons).select("d", "ksum", F.lit(1.0).alias("fluence"))
    config = em.Config(iterations=4, beta_start=1.0, likelihood="Poisson_fluence_free")
    state, metrics = em.run(em.State(frames, voxels, model), photons, weights, config)
    value = {r["n"]: r["value"] for r in state.model.collect()}
    assert [value[n] for n in (3, 4, 5)] == shapes[1] and {r["r"] for r in estep.most_likely(state.post).collect()} == {0}
    assert [r["changed"] for r in metrics.orderBy("iteration").collect()] == [3, 0, 0, 0]


def test_template_without_intensity_explains_nothing(spark):
    photons = spark.createDataFrame([(0, 0, 3), (0, 1, 1)], "d long, i int, k int")
    weights = spark.createDataFrame([(0, 1.0), (1, 1.0)], "i int, c double")
    voxels = spark.createDataFrame([(0, 0, 0), (0, 1, 1), (1, 0, 2), (1, 1, 3)], "r int, i int, n long")
    model = spark.createDataFrame([(0, 0.0), (1, 0.0), (2, 0.5), (3, 0.5)], "n long, value double")
    frames = estep.frame_sums(photons).select("d", "ksum", F.lit(1.0).alias("fluence"))
    post = em.expectation(em.State(frames, voxels, model), photons, weights, em.Config(likelihood="Poisson_fluence_free"), 1.0)[3]
    assert [(r["r"], r["p"]) for r in post.collect()] == [(1, 1.0)]


def test_closed_gates(spark, sf):
    """Without an update of likelihoods, or of probabilities, those of the last iteration stay in use."""
    photons, templates, weights = tables.lineitem_photons(spark, sf), tables.lineitem_templates(spark, sf), tables.pixel_weights(16, spark)
    n = (F.col("r") * 16 + F.col("i")).cast("long").alias("n")
    frames = estep.frame_sums(photons).select("d", "ksum", F.lit(1.0).alias("fluence"))
    state = em.State(frames, templates.select("r", "i", n), templates.select(n, F.col("w").alias("value")))
    state, post = em.step(state, photons, weights, em.Config(), 0.2)
    again = em.expectation(state, photons, weights, em.Config(update_probability=False), 1.0)[3]
    assert tables.same_rows(again, post)
    kept = em.expectation(state, photons, weights, em.Config(update_logr=False), 0.2)[3]
    both = kept.join(post.withColumnRenamed("p", "q"), ["d", "r"])
    assert both.count() == kept.count() == post.count() and both.where("abs(p - q) > 1e-12").isEmpty()


@pytest.mark.parametrize("parts", [1, 2, 3, 5, 16, 17, 40])
def test_split_frames_evenly(spark, parts):
    """Photons are kept, and each part gets its share, whatever the number of parts; also of pixels of one photon."""
    rows = [(0, i, 1) for i in range(4000)] + [(1, i, 40) for i in range(100)]
    found = mstep.split_frames(spark.createDataFrame(rows, "d long, i int, k int"), 4000 // parts)
    sums = {(r["d"], r["part"]): r["n"] for r in found.groupBy("d", "part").agg(F.sum("k").alias("n")).collect()}
    assert sorted(sums) == [(d, p) for d in (0, 1) for p in range(parts)]
    assert all(abs(n - 4000 / parts) < 6 * (4000 / parts) ** 0.5 + 1e-9 or parts == 1 for n in sums.values()) and sum(sums.values()) == 8000
    back = found.groupBy("d", "i").agg(F.sum("k").alias("k")).select("d", "i", F.col("k").cast("int").alias("k"))
    assert tables.same_rows(back, spark.createDataFrame(rows, "d long, i int, k int"))


def test_roots_with_zero_backgrounds(spark):
    """Poles, groups without terms, constants of zero, and sums under the constant."""
    rng = np.random.RandomState(1)
    rows = [(n, float(a), float(b)) for n in range(40) for a, b in zip(rng.rand(12) * 10 ** rng.randint(-3, 4), rng.rand(12) * (rng.rand(12) < 0.8) * 5, strict=True)]
    terms, c = spark.createDataFrame([*rows, (50, 1.0, 2.0), (51, 1e-9, 3.0)], "n long, a double, b double"), spark.createDataFrame([(n, float(10 ** rng.randint(-2, 3))) for n in range(40)] + [(50, 0.0), (51, 5.0), (52, 1.0)], "n long, c double")
    constants = {r["n"]: r["c"] for r in c.collect()}
    for r in mstep.solve_groups(terms, c).collect():
        own = [(a, b) for n, a, b in [*rows, (50, 1.0, 2.0), (51, 1e-9, 3.0)] if n == r["n"]]
        want = mstep.solve_root(np.array([a for a, _ in own]), np.array([b for _, b in own]), constants[r["n"]], xtol=1e-13, ftol=1e-13)
        assert abs(r["x"] - want) <= 1e-6 * max(want, 1e-9), r


def test_background_model_on_orbits(spark):
    """With symmetry every voxel of an orbit has the root of the orbit's terms together."""
    photons = spark.createDataFrame([(0, 0, 5), (0, 1, 3), (1, 0, 2)], "d long, i int, k int")
    frames = spark.createDataFrame([(0, 8, 1.0, 0, 1.0), (1, 2, 0.5, 0, 1.0)], "d long, ksum long, fluence double, bg_id int, bg_weight double")
    background = spark.createDataFrame([(0, 0, 0.5), (0, 1, 0.25)], "b int, i int, v double")
    weights = spark.createDataFrame([(0, 1.0), (1, 0.8)], "i int, c double")
    post = spark.createDataFrame([(0, 0, 1.0), (1, 0, 1.0)], "d long, r int, p double")
    voxels = spark.createDataFrame([(0, 0, 6), (0, 1, 18)], "r int, i int, n long")  # (1, 1) and its image (3, 3) of a side of 5
    previous = spark.createDataFrame([(n, 7.0) for n in range(25)], "n long, value double")
    found = {r["n"]: r["value"] for r in mstep.background_model(post, photons, frames, background, weights, voxels, previous, [symmetry.Grid(5, 2, "inversion")]).collect()}
    a, b = np.array([5.0, 3.0, 2.0]), np.array([0.5, 0.25 / 0.8, 0.5 / 0.5])
    want = mstep.solve_root(a, b, 1.5 * 1.0 + 1.5 * 0.8, xtol=1e-13, ftol=1e-13)
    assert abs(found[6] - want) < 1e-9 and abs(found[18] - want) < 1e-9 and all(v == 7.0 for n, v in found.items() if n not in (6, 18))


def test_cache_reads_the_folders_of_its_range(spark, sf, tmp_path):
    photons = tables.lineitem_photons(spark, sf)
    path = str(tmp_path / "cache")
    tables.write_cache(photons, path, 4)
    some = tables.read_cache(spark, path, 3, 6)
    assert tables.same_rows(some, photons.where("d between 3 and 6").select("d", "i", "k")) and tables.same_rows(tables.read_cache(spark, path), photons.select("d", "i", "k"))
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0] and "GreaterThanOrEqual(d,3)" in plan
    assert tables.find_cache(spark, [f"{path}/nothing*", path]).count() == photons.count() and tables.find_cache(spark, [f"{path}/nothing"]) is None
    with pytest.raises(ValueError):
        tables.find_cache(spark, [path, path])
    tables.write_transposed(photons, str(tmp_path / "by-pixel"))
    assert tables.same_rows(spark.read.parquet(str(tmp_path / "by-pixel")).select("d", "i", "k"), photons.select("d", "i", "k"))
    assert sum(tables.ranked(photons, k, 3).count() for k in range(3)) == photons.count()


@pytest.mark.parametrize("width", [10.0, 1000.0])
def test_timelines_by_buckets(spark, width):
    """Islands, overlaps and lines do not depend on the buckets of time; spans may be far longer than one."""
    rng = np.random.RandomState(4)
    rows = [(m, float(a), float(a + w)) for m in ("x", "y", None) for a, w in zip(rng.randint(0, 3000, 120), rng.choice([3, 8, 40, 200], 120), strict=True)]
    spans = spark.createDataFrame(rows, "msg string, start double, stop double")
    lines = timeline.packed(spans, width=width).collect()
    islands = {(r["msg"], r["start"], r["stop"], r["n"]) for r in timeline.islands(spans, width=width).collect()}
    pairs = {r["msg"]: r["pairs"] for r in timeline.overlap_counts(spans, width=width).collect()}
    for m in ("x", "y", None):
        own = sorted((a, b) for k, a, b in rows if k == m)
        want, high = [], None
        for a, b in own:
            if high is None or a >= high:
                want.append([a, b, 0])
            high = max(high or b, b)
            want[-1][1], want[-1][2] = max(want[-1][1], b), want[-1][2] + 1
        assert {(m, a, b, n) for a, b, n in want} == {i for i in islands if i[0] == m}
        assert pairs[m] == sum(a < d and c < b for k, (a, b) in enumerate(own) for c, d in own[:k])
        placed = sorted((r["line"], r["start"], r["stop"]) for r in lines if r["msg"] == m)
        assert sorted((a, b) for _, a, b in placed) == own and all(p[0] != q[0] or p[2] <= q[1] for p, q in zip(placed, placed[1:], strict=False))
        assert max(p[0] for p in placed) + 1 == max(sum(a <= t < b for a, b in own) for t, _ in own)


def test_runs_over_ranges_of_keys(spark):
    values = [1, 1, None, None, 2, 2, 2, 1, 1, None, 3]
    rows = spark.createDataFrame([(3 * k, v) for k, v in enumerate(values)], "k long, v int")
    for parts in (1, 3, 11, 40):
        found = sorted((r["first"], r["last"], r["value"]) for r in timeline.change_ranges(rows, "k", "v", parts).collect())
        assert found == [(0, 3, 1), (6, 9, None), (12, 18, 2), (21, 24, 1), (27, 27, None), (30, 30, 3)]


def test_view_of_a_log(spark):
    marks = spark.createDataFrame([(1, "a", 0.0, "start"), (1, "a", 5.0, "stop"), (2, "a", 3.0, "start"), (2, "a", 9.0, "stop"), (1, "b", 1.0, "start"), (1, "b", 1.5, "stop"), (2, "b", 4.0, "start")], "pid int, msg string, t double, kind string")
    rows = lambda **o: sorted((r["pid"] or 0, r["msg"], r["line"], r["start"], r["stop"]) for r in timeline.view(marks, **o).collect())
    assert rows() == [(1, "a", 0, 0.0, 5.0), (1, "b", 0, 1.0, 1.5), (2, "a", 0, 3.0, 9.0)]
    assert rows(collapse_pid=True) == [(0, "a", 0, 0.0, 5.0), (0, "a", 1, 3.0, 9.0), (0, "b", 0, 1.0, 1.5)]
    assert rows(collapse_overlap=True) == [(0, "a", 0, 0.0, 9.0), (0, "b", 0, 1.0, 1.5)]
    assert rows(discard=0.5) == [(1, "a", 0, 0.0, 5.0), (2, "a", 0, 3.0, 9.0)] and rows(most=1) == [(1, "a", 0, 0.0, 5.0)]


def test_initial_state(spark, sf):
    pixels = spark.range(64).select(F.col("id").cast("int").alias("i"), ((F.col("id") % 8 - 3.5) * 0.02).alias("x"), ((F.floor(F.col("id") / 8) - 3.5) * 0.02).alias("y"), F.lit(0.2).alias("z"), F.lit(True).alias("good"))
    frames = estep.frame_sums(tables.lineitem_photons(spark, sf)).select("d", "ksum")
    for g in (initial.Geometry(2.0, 1e-4, 9, 1, 3, "D6", radius=0.1, scales=(1.0, 1.05)), initial.Geometry(2.0, 1e-4, 9, 0, 2, res_max=7.0)):
        state, weights = initial.initialise(pixels, frames, g, 0.2, (2.0,) * g.dimensions)
        assert state.voxels.agg(F.max("n")).first()[0] < 9**g.dimensions and state.model.count() == 9**g.dimensions
        assert state.voxels.select("r").distinct().count() == (40 if g.dimensions == 3 else 1) and weights.where("c > 1 or c <= 0").isEmpty()
        assert state.frames.where("fluence <> 1").isEmpty()
    with pytest.raises(ValueError):
        geometry.rotations(spark, 0, 3)
    with pytest.raises(ValueError):
        geometry.q_limit(1.0, 1.0)


def test_stream_of_bounded_batches(spark, sf, tmp_path):
    rows = tables.lineitem_photons(spark, sf).withColumn("ts", F.timestamp_seconds(F.col("d") * 600)).withColumnRenamed("d", "key")
    rows.repartition(6).write.parquet(str(tmp_path / "in"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in spark.read.parquet(str(tmp_path / "in")).schema)
    stream = streaming.photon_stream(spark, str(tmp_path / "in"), schema, 2)
    q = streaming.keep_current(stream, str(tmp_path / "out"), ["key", "i"], str(tmp_path / "check"))
    q.awaitTermination()
    assert len([p for p in q.recentProgress if p["numInputRows"]]) >= 3
    assert streaming.latest(spark.read.parquet(str(tmp_path / "out")), ["key", "i"]).count() == rows.count()
    sums = streaming.running_sums(rows).groupBy("key").agg(F.sum("ksum").alias("k"))
    assert tables.same_rows(sums, rows.groupBy("key").agg(F.sum("k").alias("k")))
