"""Reports on posteriors, classes and models."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tomolake.functions.expressions import unravelled
from tomolake.operators.scans import running_sum


def running_offsets(sizes: DataFrame, key: str, size: str, parts: int | None = None) -> DataFrame:
    """key, size, start: sum of the sizes before each key, whatever the keys' distribution."""
    return running_sum(sizes.select(key, size), [key], size, parts=parts).select(key, size, "start")


def saturated(photons: DataFrame, level: int = 20, pixels: int = 10) -> DataFrame:
    """d, saturated: whether that many pixels reach the level."""
    return photons.groupBy("d").agg((F.sum((F.col("k") >= level).cast("int")) >= pixels).alias("saturated"))


def assignment_changes(assigned: DataFrame) -> DataFrame:
    """iteration, class_changes, orientation_changes of assigned(iteration, d, c, r); all frames change in a frame's first."""
    line = Window.partitionBy("d").orderBy("iteration")
    rows = assigned.withColumn("c0", F.lag("c").over(line)).withColumn("r0", F.lag("r").over(line))
    changed = lambda a, b: F.sum((~F.col(a).eqNullSafe(F.col(b))).cast("int"))
    return rows.groupBy("iteration").agg(changed("c", "c0").alias("class_changes"), changed("r", "r0").alias("orientation_changes"))


def class_flows(assigned: DataFrame) -> DataFrame:
    """iteration, c0, c, n: how many frames of assigned(iteration, d, c) were of class c0 the time before and are of c."""
    line = Window.partitionBy("d").orderBy("iteration")
    return assigned.withColumn("c0", F.lag("c").over(line)).where("c0 IS NOT NULL").groupBy("iteration", "c0", "c").agg(F.count("*").alias("n"))


def class_histogram(assigned: DataFrame, labels: DataFrame) -> DataFrame:
    """label, c, n for every label and class, zeros included."""
    grid = labels.select("label").distinct().crossJoin(assigned.select("c").distinct())
    counts = assigned.join(labels, "d").groupBy("label", "c").agg(F.count("*").alias("n"))
    return grid.join(counts, ["label", "c"], "left").select("label", "c", F.coalesce("n", F.lit(0)).alias("n"))


def degree_of_separation(histogram: DataFrame, first, second) -> DataFrame:
    """dos = 1 - a.b / sqrt(a.a b.b) of two labels' class histograms."""
    both = histogram.groupBy("c").agg(*[F.sum(F.when(F.col("label") == x, F.col("n")).otherwise(0)).cast("double").alias(n) for x, n in ((first, "a"), (second, "b"))])
    dot = lambda x, y: F.sum(F.col(x) * F.col(y))
    return both.agg((1 - F.try_divide(dot("a", "b"), F.sqrt(dot("a", "a") * dot("b", "b")))).alias("dos"))


def gini(rows: DataFrame, by: list[str], value: str, weight: str | None = None) -> DataFrame:
    """by, gini: inequality of value (weighted, if asked), as 1 less twice the area under the Lorenz curve."""
    w = F.col(weight) if weight else F.lit(1.0)
    line = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    all_ = Window.partitionBy(*by)
    v = F.col(value) * w
    held = rows.withColumn("_w", w).withColumn("_part", F.sum(v).over(line) - v / 2).withColumn("_sum", F.sum(v).over(all_)).withColumn("_weight", F.sum(w).over(all_))
    return held.groupBy(*by).agg((1 - 2 * F.try_divide(F.sum(F.col("_w") * F.col("_part")), F.max("_sum") * F.max("_weight"))).alias("gini"))


def rms_change(new: DataFrame, old: DataFrame, key: str, value: str = "value") -> DataFrame:
    both = new.select(key, F.col(value).alias("x")).join(old.select(key, F.col(value).alias("y")), key)
    return both.agg(F.sqrt(F.avg((F.col("x") - F.col("y")) * (F.col("x") - F.col("y")))).alias("rms"))


def central_slices(model: DataFrame, size: int) -> DataFrame:
    """axis, u, v, value: the three planes through the middle of model(n, value)."""
    index = unravelled(F.col("n"), size, 3)
    others = [(1, 2), (0, 2), (0, 1)]
    planes = F.array(*[F.when(index[a] == size // 2, F.struct(F.lit(a).alias("axis"), index[p].alias("u"), index[q].alias("v"))) for a, (p, q) in enumerate(others)])
    return model.select(F.explode(F.filter(planes, lambda x: x.isNotNull())).alias("s"), "value").select("s.*", "value")


def mosaic(slices: DataFrame, size: int, tiles: int) -> DataFrame:
    """row, col, value: slices(tile, u, v, value) side by side on a square of ceil(sqrt(tiles)) tiles a side."""
    side = math.ceil(math.sqrt(tiles))
    return slices.select((F.floor(F.col("tile") / side) * size + F.col("u")).cast("long").alias("row"), (F.col("tile") % side * size + F.col("v")).cast("long").alias("col"), "value")


def occupancy_scatter(occupancy: DataFrame, classes: int) -> DataFrame:
    """d, x, y: a frame's occupancies as weights of points at the angles 2 pi c / classes."""
    angle = 2 * math.pi * F.col("c") / classes
    return occupancy.groupBy("d").agg(F.sum(F.col("p") * F.cos(angle)).alias("x"), F.sum(F.col("p") * F.sin(angle)).alias("y"))


def brightest(frames: DataFrame, assigned: DataFrame, cls: int, most: int = 500) -> DataFrame:
    """The frames of a class with most photons, ties to the smaller d."""
    return assigned.where(F.col("c") == cls).join(frames, "d").orderBy(F.desc("ksum"), "d").limit(most).select("d", "ksum")


def random_model(grid: DataFrame) -> DataFrame:
    """n, value in [0, 1) by a congruential rule of the voxel's number."""
    return grid.select("n", ((F.col("n") * 1103515245 + 12345) % 2147483648 / 2147483648.0).alias("value"))


def blob(grid: DataFrame, size: int, widths: tuple[float, ...]) -> DataFrame:
    """n, value: a Gaussian about the middle with a width for each axis."""
    index = unravelled(F.col("n"), size, len(widths))
    return grid.select("n", F.exp(-sum(((i - size // 2) / w) ** 2 / 2 for i, w in zip(index, widths, strict=True))).alias("value"))


def background_counts(frames: DataFrame, background: DataFrame) -> DataFrame:
    """d, total: the background integrated over all pixels, aggregated per dictionary entry before the join."""
    sums = background.groupBy("b").agg(F.sum("v").alias("vsum"))
    return frames.join(sums, F.col("bg_id") == F.col("b")).select("d", (F.col("bg_weight") * F.col("vsum")).alias("total"))


def selected_count(occupancy: DataFrame, chosen: DataFrame) -> DataFrame:
    """n: posterior mass of the classes that occur among chosen(c)."""
    return occupancy.join(chosen.select("c").distinct(), "c", "left_semi").agg(F.coalesce(F.sum("p"), F.lit(0.0)).alias("n"))


def label_frames(assigned: DataFrame, good: DataFrame, label: str) -> DataFrame:
    """d, label, value: whether each frame's class is among good(c)."""
    marks = good.select("c").distinct().withColumn("value", F.lit(True))
    return assigned.join(marks, "c", "left").select("d", F.lit(label).alias("label"), F.coalesce("value", F.lit(False)).alias("value"))


def pixel_quantiles(templates: DataFrame, draws: DataFrame) -> DataFrame:
    """draw, r, i: the pixel at which template r's running sum first exceeds draw * its total; draws(draw, r, u)."""
    line = Window.partitionBy("r").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    curve = templates.withColumn("high", F.sum("w").over(line)).withColumn("low", F.col("high") - F.col("w")).withColumn("total", F.sum("w").over(Window.partitionBy("r")))
    hit = curve.join(draws, "r").where((F.col("u") * F.col("total") >= F.col("low")) & (F.col("u") * F.col("total") < F.col("high")))
    return hit.select("draw", "r", "i")


def separation_series(assigned: DataFrame, labels: DataFrame, first, second) -> DataFrame:
    """iteration, dos: the degree of separation of two labels after each iteration of assigned(iteration, d, c)."""
    counts = assigned.join(labels.where(F.col("label").isin(first, second)), "d").groupBy("iteration", "c")
    both = counts.agg(*[F.sum((F.col("label") == x).cast("double")).alias(n) for x, n in ((first, "a"), (second, "b"))])
    dot = lambda x, y: F.sum(F.col(x) * F.col(y))
    return both.groupBy("iteration").agg((1 - F.try_divide(dot("a", "b"), F.sqrt(dot("a", "a") * dot("b", "b")))).alias("dos"))


def tile_centres(size: int, tiles: int) -> list[tuple[int, float, float]]:
    """tile, row, col of the middle of each tile of a mosaic."""
    side = math.ceil(math.sqrt(tiles))
    return [(t, t // side * size + size // 2, t % side * size + size // 2) for t in range(tiles)]


def positive_voxels(model: DataFrame) -> DataFrame:
    """The voxels of a model that are worth storing."""
    return model.where("value > 0")


def chunks(rows: DataFrame, key: str, of: int, inner: int | None = None) -> DataFrame:
    """rows with chunk: near-equal ranges of places in order of a dense key from 0; with inner also part, the number of
    the run of inner rows in the chunk."""
    total = rows.agg(F.count("*").alias("_n"))
    out = rows.crossJoin(F.broadcast(total)).withColumn("chunk", (F.ceil((F.col(key) + 1) * of / F.col("_n")) - 1).cast("int"))
    if inner:
        start = F.floor(F.col("chunk") * F.col("_n") / of)
        out = out.withColumn("part", F.floor((F.col(key) - start) / inner).cast("int"))
    return out.drop("_n")


def fixed_chunks(rows: DataFrame, key: str, size: int, offset: int = 0) -> DataFrame:
    """rows with chunk: runs of size keys from offset on; keys below it go."""
    return rows.where(F.col(key) >= offset).withColumn("chunk", F.floor((F.col(key) - offset) / size).cast("int"))
