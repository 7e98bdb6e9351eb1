"""The iterative driver: expectation, metrics, maximisation, and what a changed configuration makes stale."""

from __future__ import annotations

import math
from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomolake.operators import estep, geometry, mstep
from tomolake.operators.symmetry import Grid
from tomolake.plans.store import Store
from tomolake.sources.tables import cut


@dataclass(frozen=True)
class Config:
    iterations: int = 3
    beta_start: float = 0.5
    beta_stop: float = 1.0
    beta_strategy: str = "exponential"
    threshold: float = 1e-4
    likelihood: str = "Poisson"
    frame_model: str = "basic"
    maximise: str = "I"
    update_logr: bool = True
    update_probability: bool = True
    update_model: bool = True
    update_fluence: bool = True
    #: Classes whose model stays as it is.
    fixed_classes: tuple[int, ...] = ()
    #: With background: model and fluence updates in an iteration.
    inner: int = 2
    #: How templates are read off the model at their points: linear or nearest.
    interpolation: str = "linear"

    def __post_init__(self):
        if self.likelihood not in ("Poisson", "Poisson_fluence_free") or self.frame_model not in ("basic", "fluence", "background") or self.maximise not in ("I", "W"):
            raise ValueError("unknown likelihood, frame model or way to maximise")
        if self.interpolation not in ("linear", "nearest"):
            raise ValueError(f"no interpolation {self.interpolation}")
        if self.likelihood == "Poisson_fluence_free" and self.frame_model == "fluence":
            raise ValueError("a fluence-free likelihood has no fluence")

    @classmethod
    def of(cls, options: dict) -> Config:
        """From a plain dictionary; keys that are not options are an error, nothing is executed."""
        unknown = set(options) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown options {sorted(unknown)}")
        return cls(**options)


# What each setting makes stale, as a relation; geometry also makes mapping and data stale.
DEPENDENCIES = {
    "pixels_per_voxel": ("geometry", "mapping"), "model_length": ("geometry", "mapping", "model"), "p_mask_padding": ("geometry",),
    "xyz_offset": ("geometry", "mapping"), "zero_padding": ("geometry",), "polarisation": ("geometry",), "symmetry": ("mapping",),
    "rotation_order": ("mapping",), "dimensions": ("mapping", "model"), "scale": ("mapping",), "frame_selection": ("data", "fluence"),
    "frame_model": ("data", "parameters"), "threshold": ("parameters",), "maximise": ("parameters",), "likelihood": ("parameters",),
    "interpolation_forward": ("parameters",), "update_model": ("parameters",), "update_fluence": ("parameters",),
}


def stale(old: dict, new: dict, keep_model: bool = False) -> set[str]:
    """Parts to rebuild when the configuration goes from old to new."""
    out = {p for k in old.keys() | new.keys() if old.get(k) != new.get(k) for p in DEPENDENCIES.get(k, ())}
    if "geometry" in out:
        out |= {"data"}
    return out - {"model"} if keep_model else out


@dataclass
class State:
    """Frames (d, ksum, fluence[, bg_id, bg_weight]), the voxels that templates' pixels are merged to (r, i, n), and the
    model (n, value).

    points (r, i, u0 ..), one table a class, are where templates are read off the model of its grid, one row a pixel;
    without them a pixel is its voxel. p_weights (i, c) are the pixels of the expectation where they are others than
    those of the maximisation; ksum is of the latter. Several classes stand one after another in r and in n; ends are
    the first n beyond each. logr and post are those of the last iteration, which closed gates keep in use.
    """

    frames: DataFrame
    voxels: DataFrame
    model: DataFrame
    classes: DataFrame | None = None
    ends: tuple[int, ...] = ()
    logr: DataFrame | None = None
    post: DataFrame | None = None
    points: tuple[DataFrame, ...] = ()
    grids: tuple[Grid, ...] = ()
    p_weights: DataFrame | None = None

    def __post_init__(self):
        if self.points and len(self.points) != len(self.grids):
            raise ValueError("points need a grid for each class")


def _all(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def class_major(frames: DataFrame, parts: list[tuple[DataFrame, DataFrame, int, int]]) -> State:
    """The state of several classes: (voxels, model, templates, voxels of the grid) of each, numbered from 0 in each."""
    voxels, models, classes, ends, r0, n0 = [], [], [], [], 0, 0
    for c, (own, model, templates, cells) in enumerate(parts):
        voxels.append(own.select((F.col("r") + r0).cast("long").alias("r"), "i", (F.col("n") + n0).cast("long").alias("n")))
        models.append(model.select((F.col("n") + n0).cast("long").alias("n"), "value"))
        classes.append(frames.sparkSession.range(r0, r0 + templates).select(F.col("id").alias("r"), F.lit(c).alias("c")))
        r0, n0 = r0 + templates, n0 + cells
        ends.append(n0)
    return State(frames, _all(voxels), _all(models), _all(classes), tuple(ends))


def joined(states: list[tuple[State, int]]) -> State:
    """One state of several classes' own first states, each with its number of templates; grids may differ in size,
    axes and symmetry. Frames and the expectation's pixels are the first's."""
    first = states[0][0]
    parts = [(x.voxels, x.model, n, x.grids[0].size ** x.grids[0].axes) for x, n in states]
    out = class_major(first.frames, parts)
    points, grids, r0, n0 = [], [], 0, 0
    for x, n in states:
        at = x.points[0]
        points.append(at.select((F.col("r") + r0).cast("long").alias("r"), *[c for c in at.columns if c != "r"]))
        grids.append(replace(x.grids[0], first=n0))
        r0, n0 = r0 + n, grids[-1].end
    return replace(out, points=tuple(points), grids=tuple(grids), p_weights=first.p_weights)


def _class_of(ends: tuple[int, ...]) -> Column:
    """The class of voxel n."""
    return sum((F.when(F.col("n") >= e, 1).otherwise(0) for e in ends), F.lit(0))


def templates_of(state: State, interpolation: str = "linear") -> DataFrame:
    """r, i, w of the state's model."""
    if not state.points:
        return cut(state.voxels.join(state.model, "n", "left").select("r", "i", F.coalesce("value", F.lit(0.0)).alias("w")))
    read = []
    for points, g in zip(state.points, state.grids, strict=True):
        own = state.model.where((F.col("n") >= g.first) & (F.col("n") < g.end)).select((F.col("n") - g.first).alias("n"), "value")
        read.append(geometry.sampled(points, own, g.size, g.axes, interpolation))
    return cut(_all(read))


def _expected_pixels(state: State, photons: DataFrame, weights: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Photons, frames with their ksum, and weights, of the expectation's pixels."""
    if state.p_weights is None:
        return photons, state.frames, weights
    seen = photons.join(state.p_weights.select("i"), "i", "left_semi")
    sums = seen.groupBy("d").agg(F.sum("k").alias("_k"))
    others = [c for c in state.frames.columns if c != "ksum"]
    return seen, state.frames.join(sums, "d", "left").select(*others, F.coalesce("_k", F.lit(0)).cast("long").alias("ksum")), state.p_weights


def expectation(state: State, photons: DataFrame, weights: DataFrame, config: Config, beta: float, background: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """templates, their sums over weights' pixels, logr and posterior. A template without intensity (sum <= 0) explains
    no frame and gets no likelihood; a closed gate keeps the last logr or posterior, where there is one.

    logr holds every pair that can reach the threshold at the lowest beta of the schedule, pairs that meet in no lit
    pixel and frames without photons among them.
    """
    templates = templates_of(state, config.interpolation)
    sums = estep.template_sums(templates, weights).where("wsum > 0")
    if not config.update_probability and state.post is not None:
        return templates, sums, state.logr, state.post
    if not config.update_logr and state.logr is not None:
        logr = state.logr
    else:
        seen, frames, own = _expected_pixels(state, photons, weights)
        p_sums = cut(estep.template_sums(templates, own).where("wsum > 0") if state.p_weights is not None else sums)
        floor = math.log(config.threshold) / min(beta, config.beta_start, config.beta_stop) if config.threshold > 0 else -math.inf
        if config.frame_model == "background":
            free = config.likelihood == "Poisson_fluence_free"
            seen_background = background.join(own.select("i"), "i", "left_semi")
            lit, known = estep.background_parts(seen, own, frames, seen_background)
            met = cut(estep._background_likelihood(lit, known, templates, p_sums, free))
            logr = cut(estep.with_unmet(met, known, p_sums, lambda wsum: estep.background_value(F.lit(0.0), wsum, free), floor))
        else:
            met = cut(estep.likelihood_blocks(seen, templates, frames, p_sums, config.likelihood, config.frame_model, floor))
            dark = frames.join(seen.select("d").distinct(), "d", "left_anti")  # a frame with photons has met all templates
            logr = cut(estep.with_unmet(met, dark, p_sums, lambda wsum: -estep.offset_of(config.likelihood, config.frame_model, wsum), floor))
    return templates, sums, logr, cut(estep.posterior(logr, beta, config.threshold))


def _refreshed(frames: DataFrame, new: DataFrame) -> DataFrame:
    """frames with the fluence of new(d, f) where that is positive."""
    others = [c for c in frames.columns if c != "fluence"]
    return cut(frames.join(new.where("f > 0"), "d", "left").select(*others, F.coalesce("f", "fluence").alias("fluence")))


def step(state: State, photons: DataFrame, weights: DataFrame, config: Config, beta: float, background: DataFrame | None = None) -> tuple[State, DataFrame]:
    """One iteration: the next state and its posterior. Each result is written once and read by all that follows.

    Without background the fluence is updated first, then the model. With background(b, i, v) the model comes first,
    then the fluence under it, and that `inner` times; the templates' sums are those of the iteration's start.
    """
    templates, sums, logr, post = expectation(state, photons, weights, config, beta, background)
    frames, model = state.frames, state.model

    def allowed(new: DataFrame) -> DataFrame:
        if not config.fixed_classes:
            return cut(new)
        fixed = _class_of(state.ends).isin(*config.fixed_classes)
        return cut(new.where(~fixed).unionByName(state.model.where(fixed).select("n", "value")))

    if config.frame_model == "background":
        for _ in range(config.inner):
            if config.update_model:
                model = allowed(mstep.background_model(post, photons, frames, background, weights, state.voxels, model, state.grids))
            if config.update_fluence:
                new = mstep.background_fluence(post, photons, frames, background, weights, templates_of(replace(state, model=model), config.interpolation), sums)
                frames = _refreshed(frames, new.withColumnRenamed("x", "f"))
    else:
        if config.update_fluence and config.frame_model == "fluence":
            frames = _refreshed(frames, mstep.fluence(post, frames, sums).withColumnRenamed("fluence", "f"))
        if config.update_model:
            model = allowed(mstep.merged_model(post, photons, frames, sums, weights, state.voxels, config.likelihood, config.frame_model, config.maximise, state.grids, previous=model))
    return replace(state, frames=frames, model=model, logr=logr, post=post), post


def _assigned(state: State, post: DataFrame) -> DataFrame:
    """d, r, c, p: each frame's most likely template and its class."""
    best = estep.most_likely(post)
    found = best.join(state.classes, "r", "left") if state.classes is not None else best.withColumn("c", F.lit(0))
    return cut(found.select("d", F.col("r").cast("long").alias("r"), F.col("c").cast("int").alias("c"), "p"))


METRICS = "iteration int, beta double, q double, p_max double, changed long, class_changes long"


def run(state: State, photons: DataFrame, weights: DataFrame, config: Config, first: int = 0, background: DataFrame | None = None, store: Store | None = None) -> tuple[State, DataFrame]:
    """The state after all iterations from `first`, and a row of metrics for each.

    iteration, beta, q (mean expected log likelihood), p_max (mean of the largest posteriors), changed and
    class_changes (frames whose most likely template, or class, is another than before; all, in the first).

    With a store each iteration's results are written as it ends, its metrics last, and a run begins after the last
    iteration that the store holds; so a run that was stopped goes on as if it had not been.
    """
    spark = photons.sparkSession
    metrics, before = None, None
    if store is not None and store.last() is not None:
        done = store.last()
        state, before = store.state(done, state), store.assigned(done)
        first, metrics = done + 1, store.metrics().select(*[c.split()[0] for c in METRICS.split(", ")])
    for i, beta in list(enumerate(estep.beta_schedule(config.iterations, config.beta_start, config.beta_stop, config.beta_strategy)))[first:]:
        state, post = step(state, photons, weights, config, beta, background)
        best = _assigned(state, post)
        if before is None:
            moved = best.agg(F.count("*").alias("changed"), F.count("*").alias("class_changes"))
        else:
            both = best.join(before.select("d", F.col("r").alias("r0"), F.col("c").alias("c0")), "d")
            moved = both.agg(*[F.coalesce(F.sum((~F.col(a).eqNullSafe(F.col(b))).cast("long")), F.lit(0)).alias(n) for a, b, n in (("r", "r0", "changed"), ("c", "c0", "class_changes"))])
        row = estep.expected_loglik(post).agg(F.avg("q").alias("q")).crossJoin(best.agg(F.avg("p").alias("p_max"))).crossJoin(moved)
        row = cut(row.select(F.lit(i).alias("iteration"), F.lit(beta).alias("beta"), "q", "p_max", F.col("changed").cast("long").alias("changed"), F.col("class_changes").cast("long").alias("class_changes")))
        if store is not None:
            store.save(i, state, best, row)
        metrics, before = row if metrics is None else metrics.unionByName(row), best
    return state, metrics if metrics is not None else spark.createDataFrame([], METRICS)
