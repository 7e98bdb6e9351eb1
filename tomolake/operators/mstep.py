"""Maximisation: fluence, voxel models by merge ratios, and the per-voxel root problem with background."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomolake.functions.expressions import clipped, ratio
from tomolake.operators.symmetry import Grid, orbit
from tomolake.sources.tables import cut

#: Terms of a part of a large group, about, and groups that have more parts than one.
SALTED, LARGEST = 4096, 10_000


def fluence(post: DataFrame, frames: DataFrame, sums: DataFrame) -> DataFrame:
    """d, fluence = ksum / sum over templates of p * wsum; null where that is zero."""
    den = post.join(sums, "r").groupBy("d").agg(F.sum(F.col("p") * F.col("wsum")).alias("den"))
    return frames.join(den, "d").select("d", F.try_divide(F.col("ksum").cast("double"), F.col("den")).alias("fluence"))


def weighted_sums(post: DataFrame, photons: DataFrame) -> DataFrame:
    """r, i, num = sum over frames of p * k: aggregated over frames before anything is sent to voxels."""
    return post.where("p > 0").select("d", "r", "p").join(photons, "d").groupBy("r", "i").agg(F.sum(F.col("p") * F.col("k")).alias("num"))


def merged_model(post: DataFrame, photons: DataFrame, frames: DataFrame, sums: DataFrame, weights: DataFrame, voxels: DataFrame, likelihood: str = "Poisson", frame_model: str = "basic", maximise: str = "I", grids: Sequence[Grid] = (), previous: DataFrame | None = None) -> DataFrame:
    """n, value: numerators over denominators of all (r, i) that map to voxel n by voxels(r, i, n).

    previous(n, value) is the model before: a voxel keeps its value where no template that holds any frame's mass
    reaches it. Without it only voxels of templates with mass are returned.

    Denominators are c times the sum of p (basic), of fluence * p, or of ksum * p with numerators times wsum
    (fluence-free). maximise='W' averages each pixel's own ratio. grids, one a class: sums are taken over orbits of
    its symmetry, gathered at their least voxel and given to all, by expressions and no further join. How often a
    voxel is its own image does not matter, as it counts above and below the line.
    """
    free = likelihood == "Poisson_fluence_free"
    mass = F.col("p") * (F.col("ksum") if free else F.col("fluence") if frame_model == "fluence" else F.lit(1.0))
    den = post.join(frames, "d").groupBy("r").agg(F.sum(mass).alias("mass"))
    cells = voxels.join(den, "r").join(weights, "i").join(weighted_sums(post, photons), ["r", "i"], "left").join(sums, "r")
    num = F.coalesce("num", F.lit(0.0)) * (F.col("wsum") if free else F.lit(1.0))
    cells = cells.select("n", num.alias("num"), (F.col("c") * F.col("mass")).alias("den"))
    if maximise == "W":
        cells = cells.select("n", ratio(F.col("num"), F.col("den")).alias("num"), F.lit(1.0).alias("den"))
    total = cells.groupBy(F.array_min(orbit(F.col("n"), grids)).alias("n")).agg(F.sum("num").alias("num"), F.sum("den").alias("den"))
    new = total.select(F.explode(orbit(F.col("n"), grids)).alias("n"), ratio(F.col("num"), F.col("den")).alias("value"), "den")
    return kept_where_unseen(previous, new) if previous is not None else new.drop("den")


def kept_where_unseen(previous: DataFrame, new: DataFrame) -> DataFrame:
    """n, value of previous, replaced by new(n, value, den) where den > 0."""
    new = new.where("den > 0").select("n", F.col("value").alias("new_value"))
    return previous.join(new, "n", "left").select("n", F.coalesce("new_value", "value").alias("value"))


def background_terms(post: DataFrame, photons: DataFrame, frames: DataFrame, background: DataFrame, weights: DataFrame, voxels: DataFrame) -> DataFrame:
    """n, a, b: a = p * k and b = B / (fluence * c) for every lit pixel of a frame and template that meet in n."""
    lit = photons.join(frames.select("d", "fluence", "bg_id", "bg_weight"), "d").join(background, (F.col("bg_id") == F.col("b")) & (photons["i"] == background["i"])).drop(background["i"])
    lit = lit.join(weights, "i").select("d", "i", "k", (F.col("bg_weight") * F.col("v") / (F.col("fluence") * F.col("c"))).alias("b"))
    return lit.join(post.where("p > 0").select("d", "r", "p"), "d").join(voxels, ["r", "i"]).select("n", (F.col("p") * F.col("k")).alias("a"), "b")


def background_constants(post: DataFrame, frames: DataFrame, weights: DataFrame, voxels: DataFrame) -> DataFrame:
    """n, c = sum of c_i * (sum over frames of fluence * p)."""
    mass = post.join(frames.select("d", "fluence"), "d").groupBy("r").agg(F.sum(F.col("fluence") * F.col("p")).alias("mass"))
    return voxels.join(mass, "r").join(weights, "i").groupBy("n").agg(F.sum(F.col("c") * F.col("mass")).alias("c"))


def solve_root(a: np.ndarray, b: np.ndarray, c: float, fill: float = 0.0, ftol: float = 1e-2, xtol: float = 1e-3, rounds: int = 1000, halley: bool = True) -> float:
    """x >= 0 with sum of a / (x + b) = c; where the sum stays under c already at 0, that is 0.

    No terms, or c <= 0: fill. The left side falls in x, so the root lies between the poles' side bound and sum(a) /
    c; steps are Newton's or Halley's, held inside those bounds, until both step and residual are small.
    """
    if (a < 0).any() or (b < 0).any():
        raise ValueError("terms must not be negative")
    b, a = b[a > 0], a[a > 0]
    if not len(a) or c <= 0:
        return fill
    high = float(a.sum() / c)
    poles = b == 0
    if len(a) == 1:
        return max(0.0, high - float(b[0]))
    if poles.all():
        return high
    low = float(a[poles].max() / c) if poles.any() else 0.0
    if not poles.any() and float((a / b).sum()) <= c:
        return 0.0
    if len(a) == 2:
        s, m = float(b.sum()) - high, float(b.prod()) - float(a @ b[::-1]) / c
        return max(0.0, (-s + float(np.sqrt(max(s * s - 4 * m, 0.0)))) / 2)

    def value(x: float) -> float:
        return float((a / (x + b)).sum()) - c

    ends = value(low) if low + b.min() > 0 else float((a[~poles] / b[~poles]).sum()) if low else value(high / 2)
    scale, x = max(ends - value(high), 1e-300), high / 2
    for _ in range(rounds):
        t = a / (x + b)
        f, d1 = float(t.sum()) - c, -float((t / (x + b)).sum())
        if d1 == 0:  # terms too small for their derivative to be told from zero
            return x
        step = -f / d1
        if halley:
            d2 = float((t / (x + b) ** 2).sum())
            bent = 2 * d1 * d1 - f * d2
            step = -2 * f * d1 / bent if bent > 0 else step
        new = min(max(x + step, low), high)
        if abs(new - x) < xtol * new and abs(f) < ftol * scale:
            return new
        x = new
    return x


def solve_groups(terms: DataFrame, constants: DataFrame, key: str = "n", rounds: int = 60, tol: float = 1e-12, salted: int = SALTED, largest: int = LARGEST) -> DataFrame:
    """key, x of every group of terms(key, a, b) and its constants(key, c): the roots of solve_root, of all groups at once.

    With S(x) the sum of a / (x + b), Newton's rule is applied to 1 / S, which rises and bends down: from any start
    left of the root its steps stay left of it and never turn back, and one term is solved in one step. Terms are
    added up for each (key, b) first, and what is left of a group stays where it is, salted by b into parts of about
    `salted` terms. A round sends x to the parts of each group that is not settled, adds up in the parts, then over
    them. The `largest` groups' numbers of parts are broadcast; every other group is one part, and holds less than a
    `largest`-th of all terms. Groups without terms or with c <= 0 have 0; a root that has not settled after so many
    rounds is an error.
    """
    small = cut(terms.where("a > 0").groupBy(key, "b").agg(F.sum("a").alias("a")))
    sizes = small.groupBy(key).count().where(F.col("count") > salted).orderBy(F.desc("count"), key).limit(largest)
    parts = cut(sizes.select(key, F.ceil(F.col("count") / salted).cast("long").alias("parts")))
    salt = F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1)))
    small = cut(small.join(F.broadcast(parts), key, "left").select(key, salt.alias("salt"), "a", "b").repartition(key, "salt"))
    at_zero = F.sum(F.when(F.col("b") > 0, F.col("a") / F.col("b")))
    start = small.groupBy(key, "salt").agg(F.max(F.when(F.col("b") == 0, F.col("a"))).alias("pole"), at_zero.alias("s0"))
    start = start.groupBy(key).agg(F.max("pole").alias("pole"), F.sum("s0").alias("s0")).join(constants.where("c > 0"), key)
    pole = F.col("pole").isNotNull()
    state = cut(start.select(key, "c", F.when(pole, F.col("pole") / F.col("c")).otherwise(0.0).alias("x"), (pole | (F.col("s0") > F.col("c"))).alias("open")))
    open_ = state.where("open").drop("open")
    done = [state.where("not open").select(key, "x")]
    for _ in range(rounds):
        spread = open_.join(F.broadcast(parts), key, "left").select(key, "x", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1)).alias("salt"))
        term = F.col("a") / (F.col("x") + F.col("b"))
        sums = small.join(spread, [key, "salt"]).groupBy(key, "salt").agg(F.sum(term).alias("_s"), F.sum(term / (F.col("x") + F.col("b"))).alias("_d"))
        sums = open_.join(sums.groupBy(key).agg(F.sum("_s").alias("_s"), F.sum("_d").alias("_d")), key)
        step = F.greatest((F.col("_s") / F.col("c") - 1) * F.col("_s") / F.col("_d"), F.lit(0.0))
        moved = cut(sums.select(key, "c", (F.col("x") + step).alias("x"), (step > tol * F.col("x")).alias("moved")))
        done.append(moved.where("not moved").select(key, "x"))
        open_ = moved.where("moved").drop("moved")
        if open_.isEmpty():
            break
    else:
        raise ArithmeticError(f"{open_.count()} roots have not settled after {rounds} rounds")
    solved = done[0]
    for more in done[1:]:
        solved = solved.unionByName(more)
    return constants.select(key).join(solved.withColumnRenamed("x", "found"), key, "left").select(key, F.coalesce("found", F.lit(0.0)).alias("x"))


def background_model(post: DataFrame, photons: DataFrame, frames: DataFrame, background: DataFrame, weights: DataFrame, voxels: DataFrame, previous: DataFrame, grids: Sequence[Grid] = ()) -> DataFrame:
    """n, value of a model under frames with background: per voxel, or orbit of voxels, the root of its equation.

    Terms and constants of an orbit meet at its least voxel, and all of it gets the root. Voxels that no template with
    mass reaches keep their previous value.
    """
    rep = F.array_min(orbit(F.col("n"), grids))
    terms = background_terms(post, photons, frames, background, weights, voxels).select(rep.alias("n"), "a", "b")
    constants = cut(background_constants(post, frames, weights, voxels).groupBy(rep.alias("n")).agg(F.sum("c").alias("c")))
    solved = solve_groups(terms, constants).join(constants, "n")
    new = solved.select(F.explode(orbit(F.col("n"), grids)).alias("n"), F.col("x").alias("value"), F.col("c").alias("den"))
    return kept_where_unseen(previous, new)


def background_fluence(post: DataFrame, photons: DataFrame, frames: DataFrame, background: DataFrame, weights: DataFrame, templates: DataFrame, sums: DataFrame) -> DataFrame:
    """d, x: the fluence of frames with background, the root with b = B / (c max(w, 1e-10)) and c = sum of p * wsum."""
    lit = photons.join(frames.select("d", "bg_id", "bg_weight"), "d").join(background, (F.col("bg_id") == F.col("b")) & (photons["i"] == background["i"])).drop(background["i"])
    lit = lit.join(weights, "i").select("d", "i", "k", (F.col("bg_weight") * F.col("v") / F.col("c")).alias("extra"))
    met = lit.join(post.where("p > 0").select("d", "r", "p"), "d").join(templates, ["r", "i"])
    terms = met.select("d", (F.col("p") * F.col("k")).alias("a"), (F.col("extra") / clipped(F.col("w"), 1e-10)).alias("b"))
    constants = post.join(sums, "r").groupBy("d").agg(F.sum(F.col("p") * F.col("wsum")).alias("c"))
    return solve_groups(terms, constants, "d")


def split_frames(photons: DataFrame, target: int, seed: int = 0) -> DataFrame:
    """d, part, i, k: each photon of a frame dealt to one of max(1, floor(ksum / target)) parts, evenly, by a hash of
    its frame, pixel and number in the pixel."""
    parts = photons.groupBy("d").agg(F.greatest(F.lit(1), F.floor(F.sum("k") / target)).cast("long").alias("parts"))
    each = photons.join(parts, "d").select("d", "i", "parts", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("j"))
    name = F.concat_ws(":", F.lit(str(seed)), F.col("d").cast("string"), F.col("i").cast("string"), F.col("j").cast("string"))
    part = F.conv(F.substring(F.md5(name.cast("binary")), 1, 8), 16, 10).cast("long") % F.col("parts")
    return each.select("d", part.cast("long").alias("part"), "i").groupBy("d", "part", "i").agg(F.count("*").alias("k"))
