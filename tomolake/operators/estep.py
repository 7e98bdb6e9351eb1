"""Expectation: likelihoods of frames under templates, and tempered, thresholded posteriors."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tomolake.functions.expressions import positive_log
from tomolake.sources.tables import cut

#: Elements of a block of templates that one task holds, and lit pixels of a block of frames.
BLOCK_ELEMENTS, FRAME_ELEMENTS = 4_000_000, 2_000_000


def frame_sums(photons: DataFrame) -> DataFrame:
    """d, ksum, lit."""
    return photons.groupBy("d").agg(F.sum("k").alias("ksum"), F.count("*").alias("lit"))


def template_sums(templates: DataFrame, weights: DataFrame) -> DataFrame:
    """r, wsum = sum of c * w over the pixels."""
    return templates.join(weights, "i").groupBy("r").agg(F.sum(F.col("c") * F.col("w")).alias("wsum"))


def k_dot_log_w(photons: DataFrame, templates: DataFrame) -> DataFrame:
    """d, r, kw = sum over lit pixels of k * ln w (0 where w <= 0), for every pair that meets in a pixel.

    One equi-join on the pixel; templates are few and may be broadcast by size, and sums are combined before the
    shuffle on (d, r).
    """
    logs = templates.select("r", "i", positive_log(F.col("w")).alias("lw"))
    return photons.join(logs, "i").groupBy("d", "r").agg(F.sum(F.col("k") * F.col("lw")).alias("kw"))


def _block_products(logs: DataFrame, frames: DataFrame, more: tuple[str, ...], finish: Callable[[np.ndarray, list[np.ndarray], np.ndarray], np.ndarray], value: str) -> DataFrame:
    """d, r, value from the products of frames(d, i, v) with logs(r, i, v, w), as blocks of two matrices.

    Frames and templates are packed to a row each and dealt to blocks; every pair of blocks meets in one task, which
    holds the block of templates (BLOCK_ELEMENTS at most, about, by the number of templates and their pixels) while its
    frames (FRAME_ELEMENTS a block, about, by their lit pixels) stream by. Of a batch of frames only the pixels that are
    lit in it are multiplied. So no product of a frame's and a template's pixel leaves a task, and nothing passes the
    driver but three counts. Pairs of blocks are partitions by number.

    frames has further columns `more`, one number a frame; w is one number a template. finish gets the products, those
    of the frames and those of the templates, and gives values, not a number for pairs that are left out.
    """
    count, across = logs.agg(F.count_distinct("r"), F.count_distinct("i")).first()
    t_blocks = max(1, -(-count * across // BLOCK_ELEMENTS))
    f_blocks = max(1, -(-frames.count() // FRAME_ELEMENTS))

    def packed(rows: DataFrame, key: str, numbers: tuple[str, ...], own: int, others: int, role: int, across) -> DataFrame:
        one = rows.groupBy(key).agg(F.collect_list(F.struct("i", "v")).alias("x"), F.array(*[F.first(c).cast("double") for c in numbers]).cast("array<double>").alias("more"))
        one = one.withColumn("own", F.pmod(F.xxhash64(key), F.lit(own)))
        one = one.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(others - 1).cast("long"))).alias("other"))
        return one.select(across(F.col("own"), F.col("other")).cast("int").alias("cell"), F.lit(role).alias("role"), F.col(key).cast("long").alias("id"), F.col("x.i").cast("array<int>").alias("i"), F.col("x.v").cast("array<double>").alias("v"), "more")

    rows = packed(logs, "r", ("w",), t_blocks, f_blocks, 0, lambda t, f: t * f_blocks + f)
    lit = packed(frames, "d", more, f_blocks, t_blocks, 1, lambda f, t: t * f_blocks + f)
    met = rows.unionByName(lit).repartitionById(t_blocks * f_blocks, "cell").sortWithinPartitions("cell", "role")

    def sparse(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        i = batch.column(3)
        return np.repeat(np.arange(batch.num_rows), np.diff(i.offsets.to_numpy())), i.flatten().to_numpy(), batch.column(4).flatten().to_numpy()

    def numbers(batch: pa.RecordBatch) -> np.ndarray:
        return batch.column(5).flatten().to_numpy().reshape(batch.num_rows, -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, block = None, [], None
        for batch in batches:
            cells, roles = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(cells) | np.diff(roles)) + 1), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                part = batch.slice(a, b - a)
                if b > a and cells[a] != cell:
                    cell, held, block = cells[a], [], None
                if b > a and roles[a] == 0:
                    held.append(part)
                elif b > a and held:
                    if block is None:  # the templates of a block come before its frames
                        names, w = np.concatenate([x.column(2).to_numpy() for x in held]), np.concatenate([numbers(x) for x in held])
                        parts = [sparse(x) for x in held]
                        starts = np.cumsum([0, *[x.num_rows for x in held]])
                        pixels = np.unique(np.concatenate([x[1] for x in parts]))
                        block = np.zeros((len(pixels), len(names)))
                        for (row, i, v), start in zip(parts, starts, strict=False):
                            block[np.searchsorted(pixels, i), row + start] = v
                    for at in range(0, part.num_rows, 256):
                        some = part.slice(at, 256)
                        row, i, v = sparse(some)
                        place = np.minimum(np.searchsorted(pixels, i), len(pixels) - 1)
                        row, place, v = (x[pixels[place] == i] for x in (row, place, v))
                        lit_pixels, place = np.unique(place, return_inverse=True)
                        dense = np.zeros((some.num_rows, len(lit_pixels)))
                        dense[row, place] = v
                        found = finish(dense @ block[lit_pixels], list(numbers(some).T[:, :, None]), w[:, 0])
                        at_d, at_r = np.nonzero(~np.isnan(found))
                        yield pa.RecordBatch.from_arrays([pa.array(some.column(2).to_numpy()[at_d]), pa.array(names[at_r]), pa.array(found[at_d, at_r])], ["d", "r", value])

    out = met.mapInArrow(run, f"d long, r long, {value} double")
    return out.select(*[F.col(c).cast(t.schema[c].dataType) for c, t in (("d", frames), ("r", logs))], value)


def k_dot_log_w_blocks(photons: DataFrame, templates: DataFrame) -> DataFrame:
    """d, r, kw as k_dot_log_w gives it, for every frame with photons and every template, by products of blocks."""
    logs = templates.select("r", "i", positive_log(F.col("w")).alias("v"), F.lit(0.0).alias("w"))
    return _block_products(logs, photons.select("d", "i", F.col("k").alias("v")), (), lambda kw, _, __: kw, "kw")


def likelihood_blocks(photons: DataFrame, templates: DataFrame, frames: DataFrame, sums: DataFrame, likelihood: str = "Poisson", frame_model: str = "basic", floor: float = -math.inf) -> DataFrame:
    """d, r, logr of frames with photons and templates in sums, by products of blocks; as log_likelihood of their sums.

    A task leaves out pairs that are more than -floor under the best of the frame in its own block of templates: they
    are as far under the frame's best of all.
    """
    offset = _offset(likelihood, frame_model)
    logs = templates.join(sums, "r").select("r", "i", positive_log(F.col("w")).alias("v"), F.col("wsum").alias("w"))
    names = ("ksum", "fluence") if frame_model == "fluence" else ("ksum",)
    lit = photons.join(frames.select("d", *names), "d").select("d", "i", F.col("k").alias("v"), *names)

    def finish(kw: np.ndarray, numbers: list[np.ndarray], wsum: np.ndarray) -> np.ndarray:
        logr = kw - {"free": lambda: numbers[0] * np.log(wsum), "basic": lambda: wsum, "fluence": lambda: numbers[1] * wsum}[offset]()
        return np.where(logr >= logr.max(1, keepdims=True) + floor, logr, np.nan)

    return _block_products(logs, lit, names, finish, "logr")


def _offset(likelihood: str, frame_model: str) -> str:
    free = likelihood == "Poisson_fluence_free"
    if free and frame_model == "fluence" or likelihood not in ("Poisson", "Poisson_fluence_free") or frame_model not in ("basic", "fluence"):
        raise ValueError(f"no likelihood {likelihood} for frames of kind {frame_model}")
    return "free" if free else frame_model


def offset_of(likelihood: str, frame_model: str, wsum: Column) -> Column:
    """What a template of that sum takes from kw; it grows with the sum."""
    kinds = {"free": lambda: F.col("ksum") * positive_log(wsum), "basic": lambda: wsum, "fluence": lambda: F.col("fluence") * wsum}
    return kinds[_offset(likelihood, frame_model)]()


def log_likelihood(kw: DataFrame, frames: DataFrame, sums: DataFrame, likelihood: str = "Poisson", frame_model: str = "basic") -> DataFrame:
    """d, r, logr from kw(d, r, kw), frames(d, ksum[, fluence]) and sums(r, wsum).

    basic and fluence-free: kw - ksum ln wsum; basic: kw - wsum; fluence: kw - fluence * wsum.
    """
    offset = offset_of(likelihood, frame_model, F.col("wsum"))
    return kw.join(frames, "d").join(sums, "r").select("d", "r", (F.col("kw") - offset).alias("logr"))


def with_unmet(met: DataFrame, frames: DataFrame, sums: DataFrame, value: Callable[[Column], Column], floor: float = -math.inf) -> DataFrame:
    """met(d, r, logr) and the pairs of frames and templates that it lacks, as far as they can matter.

    A pair that meets in no lit pixel has the likelihood value(wsum) of the frame's row in frames, which falls as the
    template's sum grows. Only the templates of least sums, down to floor under the frame's best pair, are looked at:
    templates stand in blocks of rising sums, a frame takes the blocks whose least sum is within its bound, and pairs
    that are met go. A frame that met has every template of costs nothing. floor is the logarithm of the posterior's
    threshold over beta; without a threshold every pair is a result.

    The templates' sums, a row each, are ranked in one window; their blocks' bounds, one row, go to all frames.
    """
    ranked = sums.select("r", "wsum", (F.row_number().over(Window.orderBy("wsum", "r")) - 1).alias("k"))
    ranked = cut(ranked)
    count = ranked.count()
    if not count:
        return met
    wide = max(16, math.isqrt(count))
    ranked = ranked.withColumn("block", F.floor(F.col("k") / wide).cast("long"))
    bounds = ranked.groupBy("block").agg(F.min("wsum").alias("low")).agg(F.sort_array(F.collect_list(F.struct("block", "low"))).alias("bounds"))
    known = met.groupBy("d").agg(F.max("logr").alias("best"), F.count("*").alias("n"))
    rows = frames.join(known, "d", "left").where(F.coalesce("n", F.lit(0)) < count).crossJoin(F.broadcast(bounds))
    # Without a met pair the frame's best is that of the least sum.
    rows = rows.withColumn("limit", F.coalesce("best", value(F.get("bounds", F.lit(0))["low"])) + F.lit(floor))
    near = rows.withColumn("block", F.explode(F.transform(F.filter("bounds", lambda b: value(b["low"]) >= F.col("limit")), lambda b: b["block"]))).drop("bounds")
    found = near.join(ranked.drop("k"), "block").withColumn("logr", value(F.col("wsum"))).where(F.col("logr") >= F.col("limit"))
    unmet = found.join(met.select("d", "r"), ["d", "r"], "left_anti").select(*[F.col(c).cast(met.schema[c].dataType) for c in ("d", "r")], "logr")
    return met.unionByName(unmet)


def background_parts(photons: DataFrame, weights: DataFrame, frames: DataFrame, background: DataFrame) -> tuple[DataFrame, DataFrame]:
    """lit(d, i, k, c, extra), extra = B / (fluence c), and frames with base and bsum.

    base is what the lit pixels give under background alone, with ksum ln fluence: the sum of k (ln extra + ln c) where
    extra > 0. Frames without photons have it too.
    """
    totals = background.groupBy("b").agg(F.sum("v").alias("vsum"))
    lit = photons.join(frames.select("d", "fluence", "bg_id", "bg_weight"), "d").join(background, (F.col("bg_id") == F.col("b")) & (photons["i"] == background["i"])).drop(background["i"])
    lit = lit.join(weights, "i").select("d", "i", "k", "c", (F.col("bg_weight") * F.col("v") / (F.col("fluence") * F.col("c"))).alias("extra"))
    base = lit.where("extra > 0").groupBy("d").agg(F.sum(F.col("k") * (F.ln("extra") + F.ln("c"))).alias("_base"))
    known = frames.join(totals, F.col("bg_id") == F.col("b")).join(base, "d", "left")
    base = F.coalesce("_base", F.lit(0.0)) + F.col("ksum") * F.ln("fluence")
    return lit, known.select("d", "ksum", "fluence", (F.col("bg_weight") * F.col("vsum")).alias("bsum"), base.alias("base"))


def background_value(gain: Column, wsum: Column, fluence_free: bool = False) -> Column:
    """base + gain - G for a row of background_parts' frames, G = fluence wsum + bsum; or less ksum ln G."""
    g = F.col("fluence") * wsum + F.col("bsum")
    return F.col("base") + gain - (F.col("ksum") * positive_log(g) if fluence_free else g)


def log_likelihood_background(photons: DataFrame, templates: DataFrame, weights: DataFrame, frames: DataFrame, background: DataFrame, sums: DataFrame, fluence_free: bool = False) -> DataFrame:
    """d, r, logr where frames(d, ksum, fluence, bg_id, bg_weight) have a background(b, i, v).

    With F = w + B / (fluence c) and B = bg_weight v: the sum of k (ln F + ln c) over lit pixels plus ksum ln
    fluence, less G = fluence wsum + sum of B; or less ksum ln G. Pixels that the template lacks have w = 0; pairs
    that meet in no lit pixel are those of with_unmet, with background_value without gain.
    """
    return _background_likelihood(*background_parts(photons, weights, frames, background), templates, sums, fluence_free)


def _background_likelihood(lit: DataFrame, known: DataFrame, templates: DataFrame, sums: DataFrame, fluence_free: bool) -> DataFrame:
    f = F.ln(F.col("w") + F.col("extra"))
    gain = F.when(F.col("w") <= 0, 0.0).when(F.col("extra") > 0, f - F.ln("extra")).otherwise(f + F.ln("c"))
    dot = lit.join(templates, "i").groupBy("d", "r").agg(F.sum(F.col("k") * gain).alias("gain"))
    return dot.join(known, "d").join(sums, "r").select("d", "r", background_value(F.col("gain"), F.col("wsum"), fluence_free).alias("logr"))


def posterior(logr: DataFrame, beta: float = 1.0, threshold: float = 0.0, keep_zero: bool = False) -> DataFrame:
    """d, r (and c), logr, p: softmax of beta * logr over all templates of all classes of a frame.

    Entries under threshold times the frame's largest become zero before the rest is made to sum to one; only
    positive ones are kept unless keep_zero. One shuffle, on d.
    """
    frame = Window.partitionBy("d")
    rows = logr.withColumn("p", F.exp(beta * (F.col("logr") - F.max("logr").over(frame))))
    rows = rows.withColumn("p", F.when(F.col("p") < threshold, 0.0).otherwise(F.col("p")))
    rows = rows.withColumn("p", F.col("p") / F.sum("p").over(frame))
    return rows if keep_zero else rows.where("p > 0")


def most_likely(post: DataFrame) -> DataFrame:
    """d, r, p of each frame's largest posterior; of equal ones the first r."""
    best = F.max(F.struct("p", (-F.col("r")).alias("r"))).alias("x")
    return post.groupBy("d").agg(best).select("d", (-F.col("x.r")).alias("r"), F.col("x.p").alias("p"))


def class_occupancy(post: DataFrame, classes: DataFrame) -> DataFrame:
    """d, c, p: posterior mass of a frame in each class; classes(r, c)."""
    return post.join(classes, "r").groupBy("d", "c").agg(F.sum("p").alias("p"))


def template_occupancy(post: DataFrame) -> DataFrame:
    return post.groupBy("r").agg(F.sum("p").alias("p"))


def expected_loglik(post: DataFrame) -> DataFrame:
    """d, q = sum of p * logr."""
    return post.groupBy("d").agg(F.sum(F.col("p") * F.col("logr")).alias("q"))


def beta_schedule(iterations: int, start: float, stop: float, strategy: str = "exponential") -> list[float]:
    """The inverse temperature of each iteration; a single iteration has the start."""
    last = max(iterations - 1, 1)
    if strategy == "exponential":
        return [start * (stop / start) ** (min(i, last) / last) for i in range(iterations)]
    if strategy == "linear":
        return [start + (stop - start) * min(i, last) / last for i in range(iterations)]
    raise ValueError(f"no strategy {strategy}")


def predicted_frames(frames: DataFrame, templates: DataFrame, weights: DataFrame, background: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """d, r, i, f = fluence * c * w + bg_weight * v: what a frame would hold under each template, or under those that
    pairs(d, r) names for it, so that no more is made than is asked for."""
    known = frames.join(pairs.select("d", "r"), "d") if pairs is not None else frames
    pixels = known.join(background, F.col("bg_id") == F.col("b")).join(weights, "i")
    return pixels.join(templates, ["r", "i"] if pairs is not None else "i").select("d", "r", "i", (F.col("fluence") * F.col("c") * F.col("w") + F.col("bg_weight") * F.col("v")).alias("f"))


def k_log_f(photons: DataFrame, frames: DataFrame, templates: DataFrame, weights: DataFrame, background: DataFrame) -> DataFrame:
    """d, r, kf = sum over lit pixels of k * ln f (0 where f <= 0): only pixels with photons are predicted."""
    lit = photons.join(frames.select("d", "fluence", "bg_id", "bg_weight"), "d").join(background, (F.col("bg_id") == F.col("b")) & (photons["i"] == background["i"])).drop(background["i"])
    f = F.col("fluence") * F.col("c") * F.col("w") + F.col("bg_weight") * F.col("v")
    return lit.join(weights, "i").join(templates, "i").groupBy("d", "r").agg(F.sum(F.col("k") * positive_log(f)).alias("kf"))


def posterior_statistics(post: DataFrame) -> DataFrame:
    """least, most, mean: how many templates are left to a frame."""
    return post.groupBy("d").agg(F.count("*").alias("n")).agg(F.min("n").alias("least"), F.max("n").alias("most"), F.avg("n").alias("mean"))
