"""The EM plan and what it is made of: first states, pixel domains, orbits, pairs that do not meet, blocks and roots."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tomolake import queries
from tomolake.operators import estep, geometry, mstep, report, symmetry
from tomolake.plans import em, initial, project
from tomolake.sources import tables


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("size,axes,side", [(8, 2, 3), (9, 3, 4), (8, 3, 16), (16, 3, 16), (7, 2, 64)])
def test_sampling_by_tiles(spark, size, axes, side):
    """Corners inside a tile, on borders and outside the grid, of a model with holes and negative values."""
    model = report.random_model(symmetry.voxels(spark, size, axes)).where("n % 7 <> 3").withColumn("value", F.col("value") - 0.5)
    grid = np.zeros(size**axes)
    for r in model.collect():
        grid[r["n"]] = r["value"]
    grid = np.pad(grid.reshape((size,) * axes), 4)
    points = np.random.default_rng(0).uniform(-2.5, size + 1.5, (300, axes))
    points[:40] = np.round(points[:40])
    rows = spark.createDataFrame([(k, 0, *map(float, p)) for k, p in enumerate(points)], "r int, i int, " + ", ".join(f"u{k} double" for k in range(axes)))

    def at(p):
        low = np.floor(p).astype(int)
        return sum(np.prod([p[k] - low[k] if c[k] else 1 - p[k] + low[k] for k in range(axes)]) * grid[tuple(low + np.array(c) + 4)] for c in np.ndindex(*(2,) * axes))

    found = {r["r"]: r["w"] for r in geometry.sampled(rows, model, size, axes, side=side).collect()}
    assert len(found) == 300 and all(abs(found[k] - at(p)) < 1e-12 for k, p in enumerate(points))


def test_sampling_shuffles_coordinates_once_at_most(spark, monkeypatch):
    points = spark.range(1000).selectExpr("id AS r", "id AS i", "id % 9 * 0.9 AS u0", "id % 7 * 0.9 AS u1", "id % 8 * 0.9 AS u2")
    model = report.random_model(symmetry.voxels(spark, 9, 3))
    assert "BroadcastHashJoin" in plan_of(geometry.sampled(points, model, 9))
    monkeypatch.setattr(geometry, "BROADCAST_BYTES", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(geometry.sampled(points, model, 9))
        # One exchange of the coordinates and one of the voxels, both by tile; no row for each corner.
        assert plan.count("Exchange hashpartitioning(tile") == 2 and plan.count("Exchange") == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def scene(spark, g, dark=2):
    """Pixels, photons and frames of a small detector."""
    rng = np.random.default_rng(7)
    pixels = [(i, (i % 6 - 2.5) * 0.03 + 1e-4 * rng.random(), (i // 6 - 2.5) * 0.03, 0.2, i != 9) for i in range(36)]
    photons = [(d, i, int(k)) for d in range(12) for i, k in enumerate(rng.poisson(0.7, 36)) if k]
    pixels = spark.createDataFrame(pixels, "i int, x double, y double, z double, good boolean")
    photons = spark.createDataFrame(photons, "d long, i int, k int")
    frames = spark.createDataFrame([(d,) for d in range(12 + dark)], "d long")
    state, weights = initial.initialise(pixels, frames, g, 0.2, photons=photons)
    return state, weights, photons


GEOMETRY = initial.Geometry(2.0, 1e-4, 7, 1, 3, "D6", q_max=0.14, p_inner=0, p_outer=1)


def test_first_state_of_d6_has_one_row_a_pixel(spark):
    state, weights, _ = scene(spark, GEOMETRY)
    templates = em.templates_of(state)
    assert templates.groupBy("r", "i").count().where("count > 1").isEmpty()
    assert templates.count() == 20 * weights.count()
    most = state.voxels.groupBy("r", "i").count().agg(F.max("count")).first()[0]
    assert most == 3  # merged under each of the three operators
    assert {r["i"] for r in state.p_weights.collect()} < {r["i"] for r in weights.collect()}
    assert {r["d"] for r in state.frames.where("ksum = 0").collect()} == {12, 13}


@pytest.mark.parametrize("likelihood,model", [("Poisson", "basic"), ("Poisson", "fluence"), ("Poisson_fluence_free", "basic")])
def test_iteration_by_arrays(spark, likelihood, model):
    """A whole iteration from a first state, two pixel domains, D6, against dense arrays."""
    state, weights, photons = scene(spark, GEOMETRY)
    beta, threshold = 0.4, 1e-3
    config = em.Config(iterations=1, beta_start=beta, beta_stop=beta, threshold=threshold, likelihood=likelihood, frame_model=model)
    done, post = em.step(state, photons, weights, config, beta)

    size, frames = 7, 14
    c, cp, k = np.zeros(36), np.zeros(36), np.zeros((frames, 36))
    for r in weights.collect():
        c[r["i"]] = r["c"]
    for r in state.p_weights.collect():
        cp[r["i"]] = r["c"]
    for r in photons.collect():
        k[r["d"], r["i"]] = r["k"]
    w = np.zeros((20, 36))
    for r in em.templates_of(state).collect():
        w[r["r"], r["i"]] = r["w"]
    old = np.zeros(size**3)
    for r in state.model.collect():
        old[r["n"]] = r["value"]
    sums, sums_p = w @ c, w @ cp
    logs = np.where((w > 0) & (cp > 0), np.log(np.where(w > 0, w, 1)), 0)
    ksum, ksum_p = (k * (c > 0)).sum(1), (k * (cp > 0)).sum(1)
    logr = k @ logs.T - (ksum_p[:, None] * np.log(sums_p) if likelihood != "Poisson" else sums_p)
    p = np.exp(beta * (logr - logr.max(1, keepdims=True)))
    p[p < threshold] = 0
    p /= p.sum(1, keepdims=True)
    found = np.zeros((frames, 20))
    for r in post.collect():
        found[r["d"], r["r"]] = r["p"]
    assert np.abs(found - p).max() < 1e-9

    fluence = np.ones(frames)
    if model == "fluence":
        new = ksum / (p @ sums)
        fluence = np.where(new > 0, new, fluence)
        assert all(abs(r["fluence"] - fluence[r["d"]]) < 1e-9 for r in done.frames.collect())
    mass = p.T @ (ksum if likelihood != "Poisson" else fluence if model == "fluence" else np.ones(frames))
    num, den = np.zeros(size**3), np.zeros(size**3)
    share = p.T @ k * (sums[:, None] if likelihood != "Poisson" else 1)
    for r in state.voxels.collect():
        num[r["n"]] += share[r["r"], r["i"]]
        den[r["n"]] += c[r["i"]] * mass[r["r"]]
    num, den = num.reshape((size,) * 3), den.reshape((size,) * 3)
    for axis in range(3):  # the sum over all eight reflections
        num, den = num + np.flip(num, axis), den + np.flip(den, axis)
    num, den = num.ravel(), den.ravel()
    want = np.where(den > 0, num / np.where(den > 0, den, 1), old)
    got = {r["n"]: r["value"] for r in done.model.collect()}
    assert len(got) == size**3 and all(abs(got[n] - want[n]) < 1e-9 for n in got)


def test_interpolation_is_a_setting(spark):
    state, weights, photons = scene(spark, GEOMETRY)
    near = em.templates_of(state, "nearest").join(em.templates_of(state).withColumnRenamed("w", "v"), ["r", "i"])
    assert near.count() > 0 and near.agg(F.avg(F.abs(F.col("w") - F.col("v")))).first()[0] > 0.01
    with pytest.raises(ValueError):
        em.Config(interpolation="cubic")


def test_classes_of_different_grids(spark):
    """Two classes of other dimensions and symmetry: each model stays on its own orbits, all frames share posteriors."""
    solid, weights, photons = scene(spark, GEOMETRY)
    flat, _, _ = scene(spark, initial.Geometry(2.0, 1e-4, 5, 6, 2, "inversion", q_max=0.14, p_outer=1))
    state = em.joined([(solid, 20), (flat, 6)])
    assert em.templates_of(state).select("r").distinct().count() == 26
    done, metrics = em.run(state, photons, weights, em.Config(iterations=2, beta_start=0.2, beta_stop=0.4))
    assert metrics.count() == 2 and done.post.agg(F.sum("p")).first()[0] == pytest.approx(14)
    value = {r["n"]: r["value"] for r in done.model.collect()}
    assert len(value) == 343 + 25
    moved = [n for n in range(343, 368) if value[n] != pytest.approx(((n - 343) * 1103515245 + 12345) % 2147483648 / 2147483648)]
    assert moved and all(value[343 + 24 - (n - 343)] == pytest.approx(value[n]) for n in moved)


@pytest.mark.parametrize("kind,size,axes", [("inversion", 5, 2), ("inversion", 4, 3), ("D6", 4, 3), ("D6", 5, 3), ("P1", 4, 2)])
def test_orbits_are_the_symmetrised_ratio(spark, kind, size, axes):
    """Sums at the least voxel of an orbit give what summing over all operations gives, edges of even grids included."""
    g = symmetry.Grid(size, axes, kind, 100)
    grid = symmetry.voxels(spark, size, axes)
    rows = report.random_model(grid).select((F.col("n") + 100).alias("n"), "value", (F.col("n") % 5 + 1.0).alias("den"))
    rep = F.array_min(symmetry.orbit(F.col("n"), [g]))
    sums = rows.groupBy(rep.alias("n")).agg(F.sum("value").alias("value"), F.sum("den").alias("den"))
    mine = sums.select(F.explode(symmetry.orbit(F.col("n"), [g])).alias("n"), (F.col("value") / F.col("den")).alias("x"))
    plain = symmetry.symmetrised(rows.withColumn("n", F.col("n") - 100), ["value", "den"], size, axes, kind)
    both = mine.join(plain.select((F.col("n") + 100).alias("n"), (F.col("value") / F.col("den")).alias("y")), "n")
    assert both.count() == size**axes == mine.count() and both.where("abs(x - y) > 1e-12").isEmpty()


@pytest.mark.parametrize("threshold", [0.0, 1e-3, 0.3])
@pytest.mark.parametrize("free,count", [(False, 5), (False, 300), (True, 40)])
def test_pairs_that_do_not_meet(spark, threshold, free, count):
    """Posteriors equal those over all pairs, whichever of them meet; frames without photons have theirs."""
    rng = np.random.default_rng(count)
    beta, frames = 0.7, 25
    sums = np.round(rng.uniform(0.5, 60, count), 3)
    sums[:3] = sums[0]
    ksum = rng.integers(0, 6, frames)
    met = [(d, r, float(rng.normal(-sums[r], 4))) for d in range(frames - 5) for r in range(count) if rng.random() < (1.0 if d == 3 else 0.2)]
    logr = -np.outer(ksum, np.log(sums)) if free else np.tile(-sums, (frames, 1))
    for d, r, x in met:
        logr[d, r] = x
    p = np.exp(beta * (logr - logr.max(1, keepdims=True)))
    p[p < threshold] = 0
    p /= p.sum(1, keepdims=True)
    rows = spark.createDataFrame(met, "d long, r int, logr double")
    known = spark.createDataFrame([(d, int(k)) for d, k in enumerate(ksum)], "d long, ksum long")
    floor = math.log(threshold) / beta if threshold else -math.inf
    kind = "Poisson_fluence_free" if free else "Poisson"
    all_ = estep.with_unmet(rows, known, spark.createDataFrame([(r, float(w)) for r, w in enumerate(sums)], "r int, wsum double"), lambda w: -estep.offset_of(kind, "basic", w), floor)
    found = np.zeros((frames, count))
    for r in estep.posterior(all_, beta, threshold).collect():
        found[r["d"], r["r"]] = r["p"]
    assert np.abs(found - p).max() < 1e-12
    if threshold == 0.3 and not free:
        assert all_.count() < frames * count / 2 + len(met)


def test_background_likelihood_of_all_pairs(spark):
    """Pixels that a template lacks count with their background; pairs that meet nowhere too."""
    photons = spark.createDataFrame([(0, 0, 2), (0, 1, 3), (1, 2, 1)], "d long, i int, k int")
    templates = spark.createDataFrame([(0, 0, 0.5), (0, 1, 0.0), (1, 1, 0.7), (2, 3, 0.4)], "r int, i int, w double")
    weights = spark.createDataFrame([(i, 1 - i / 10) for i in range(4)], "i int, c double")
    frames = spark.createDataFrame([(0, 5, 2.0, 0, 1.5), (1, 1, 0.5, 0, 1.0), (2, 0, 1.0, 1, 1.0)], "d long, ksum long, fluence double, bg_id int, bg_weight double")
    v = {0: [0.3, 0.0, 0.2, 0.1], 1: [0.1] * 4}
    background = spark.createDataFrame([(b, i, x) for b, xs in v.items() for i, x in enumerate(xs)], "b int, i int, v double")
    state = em.State(frames, templates.selectExpr("r", "i", "CAST(4 * r + i AS BIGINT) AS n"), templates.selectExpr("CAST(4 * r + i AS BIGINT) AS n", "w AS value"))
    config = em.Config(iterations=1, beta_start=1.0, threshold=0.0, frame_model="background")
    found = {(r["d"], r["r"]): r["logr"] for r in em.expectation(state, photons, weights, config, 1.0, background)[2].collect()}
    assert len(found) == 9
    for (d, r), logr in found.items():
        fr = {0: (2.0, 0, 1.5), 1: (0.5, 0, 1.0), 2: (1.0, 1, 1.0)}[d]
        w = {0: [0.5, 0, 0, 0], 1: [0, 0.7, 0, 0], 2: [0, 0, 0, 0.4]}[r]
        want = 0.0
        for i, k in {0: [(0, 2), (1, 3)], 1: [(2, 1)], 2: []}[d]:
            c = 1 - i / 10
            f = w[i] + fr[2] * v[fr[1]][i] / (fr[0] * c)
            want += k * (math.log(f) + math.log(c)) if f > 0 else 0
        want += {0: 5, 1: 1, 2: 0}[d] * math.log(fr[0]) - fr[0] * sum(w[i] * (1 - i / 10) for i in range(4)) - fr[2] * sum(v[fr[1]])
        assert logr == pytest.approx(want)


@pytest.mark.parametrize("elements", [(4_000_000, 2_000_000), (40, 30)])
def test_blocks_of_any_size(spark, monkeypatch, elements):
    """Many blocks give what one gives and what the join gives; a floor leaves out only what is under it."""
    monkeypatch.setattr(estep, "BLOCK_ELEMENTS", elements[0])
    monkeypatch.setattr(estep, "FRAME_ELEMENTS", elements[1])
    rng = np.random.default_rng(5)
    photons = spark.createDataFrame([(d, int(i), int(rng.integers(1, 4))) for d in range(15) for i in rng.choice(1000, 6, replace=False)], "d long, i int, k int")
    templates = spark.createDataFrame([(r, int(i), float(rng.random() + 0.1)) for r in range(9) for i in rng.choice(1000, 400, replace=False)], "r int, i int, w double")
    weights = spark.range(1000).selectExpr("CAST(id AS INT) AS i", "1.0 AS c")
    frames, sums = estep.frame_sums(photons), estep.template_sums(templates, weights)
    want = estep.k_dot_log_w(photons, templates).withColumnRenamed("kw", "y")
    both = estep.k_dot_log_w_blocks(photons, templates).join(want, ["d", "r"], "left")
    assert both.count() == 15 * 9 and both.where("abs(kw - coalesce(y, 0)) > 1e-9").isEmpty()
    dense = {(r["d"], r["r"]): r["y"] for r in both.select("d", "r", F.coalesce("y", F.lit(0.0)).alias("y")).collect()}
    wsum = {r["r"]: r["wsum"] for r in sums.collect()}
    floor = -5.0
    logr = {k: y - wsum[k[1]] for k, y in dense.items()}
    best = {d: max(x for (e, _), x in logr.items() if e == d) for d in range(15)}
    found = {(r["d"], r["r"]): r["logr"] for r in estep.likelihood_blocks(photons, templates, frames, sums, floor=floor).collect()}
    assert all(abs(found[k] - logr[k]) < 1e-9 for k in found) and {k for k, x in logr.items() if x >= best[k[0]] + floor} <= set(found)
    if elements[0] > 1000:
        assert len(found) < len(logr)


def test_expectation_has_no_row_for_a_pixel_of_a_pair(spark, sf):
    e = queries.Embeddings(spark, sf)
    plan = plan_of(estep.likelihood_blocks(e.photons, e.templates, e.frames, e.sums))
    assert "MapInArrow" in plan and "keys=[d" in plan and "keys=[d#" in plan and "sum((cast(k" not in plan


def roots(rows, constants):
    return {n: mstep.solve_root(np.array([a for m, a, _ in rows if m == n]), np.array([b for m, _, b in rows if m == n]), c, xtol=1e-13, ftol=1e-13) for n, c in constants.items()}


@pytest.mark.parametrize("salted,largest", [(4096, 10_000), (10, 10_000), (10, 1)])
def test_roots_of_a_hot_group(spark, salted, largest):
    """Nine tenths of the terms are one group's; parts of it give the root of the whole."""
    rng = np.random.default_rng(3)
    rows = [(0, float(a), float(b)) for a, b in zip(rng.random(900) * 4, rng.random(900) + 0.01, strict=True)]
    rows += [(int(n), float(rng.random() * 4), float(rng.random() * (rng.random() < 0.7))) for n in rng.integers(1, 20, 100)]
    constants = {n: float(10.0 ** rng.integers(-1, 3)) for n in range(20)}
    terms, c = spark.createDataFrame(rows, "n long, a double, b double"), spark.createDataFrame(list(constants.items()), "n long, c double")
    want = roots(rows, constants)
    found = {r["n"]: r["x"] for r in mstep.solve_groups(terms, c, salted=salted, largest=largest).collect()}
    assert found.keys() == want.keys() and all(abs(found[n] - want[n]) <= 1e-6 * max(want[n], 1e-9) for n in want)


def test_parts_of_a_hot_group_are_even(spark):
    """With 90 of 100 terms in one group no part holds over twice the mean of all parts of that group."""
    terms = spark.range(20_000).selectExpr("CASE WHEN id % 10 = 0 THEN id ELSE -1 END AS n", "1.0 AS a", "CAST(id AS DOUBLE) AS b")
    parts = 18_000 // 500
    sizes = terms.where("n = -1").groupBy(F.pmod(F.xxhash64("b"), F.lit(parts))).count()
    assert sizes.agg(F.max("count")).first()[0] < 2 * 500


def test_unsettled_roots_are_an_error(spark):
    terms = spark.createDataFrame([(0, 1.0, 0.5), (0, 2.0, 3.0), (0, 5.0, 100.0)], "n long, a double, b double")
    with pytest.raises(ArithmeticError):
        mstep.solve_groups(terms, spark.createDataFrame([(0, 0.01)], "n long, c double"), rounds=1)


def test_project_goes_on_and_rebuilds_what_is_stale(spark, tmp_path):
    """Classes of other dimensions and symmetries from plain dictionaries; a run in two calls is a run in one; a changed
    rotation order makes points and voxels anew, and leaves models, weights and frames."""
    rng = np.random.default_rng(7)
    pixels = spark.createDataFrame([(i, (i % 6 - 2.5) * 0.03, (i // 6 - 2.5) * 0.03, 0.2, i != 9) for i in range(36)], "i int, x double, y double, z double, good boolean")
    photons = spark.createDataFrame([(d, i, int(k)) for d in range(8) for i, k in enumerate(rng.poisson(0.7, 36)) if k], "d long, i int, k int")
    frames = spark.range(9).withColumnRenamed("id", "d")
    solid = {"wavelength": 2.0, "area": 1e-4, "size": 5, "rotation_order": 1, "symmetry": "D6", "q_max": 0.14}
    flat = {"wavelength": 2.0, "area": 1e-4, "size": 5, "rotation_order": 4, "dimensions": 2, "symmetry": "inversion", "q_max": 0.14}
    options = {"classes": [solid, flat], "z": 0.2, "em": {"iterations": 2, "beta_start": 0.2, "beta_stop": 0.4}}

    def run(where, restart=False, **changed):
        made = project.Project(spark, str(tmp_path / where), options | changed)
        state, metrics = made.run(pixels, frames, photons, restart=restart)
        return made, {r["n"]: r["value"] for r in state.model.collect()}, [tuple(r) for r in metrics.orderBy("iteration").collect()]

    _, whole, told = run("one")
    made, _, first = run("two", em=options["em"] | {"iterations": 1})
    _, model, both = run("two")
    # One iteration alone runs at the first temperature; the second goes on from it.
    assert len(first) == 1 and len(both) == len(told) == 2 and both[0] == pytest.approx(told[0]) and model == pytest.approx(whole)
    names = {"points", "voxels", "weights", "model", "expected", "frames"}
    assert {n: made.artefacts.version(f"{n}1") for n in names} == dict.fromkeys(names, 1)
    made, _, again = run("two", restart=True, classes=[solid, flat | {"rotation_order": 6}])
    assert {n for n in names if made.artefacts.version(f"{n}0") > 1} == set() and made.artefacts.version("points1") == made.artefacts.version("voxels1") == 2
    assert made.artefacts.version("model1") == 1 and len(again) == 2
    with pytest.raises(ValueError):
        project.Project(spark, str(tmp_path / "x"), options | {"exec": "1"})
    with pytest.raises(ValueError):
        project.geometry_of({"no_such": 1})
