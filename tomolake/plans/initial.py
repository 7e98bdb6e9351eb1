"""What an EM run starts from: pixels with masks, orientations, where pixels fall in the model, model and fluence."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomolake.operators import geometry, report, symmetry
from tomolake.plans.em import State
from tomolake.sources.tables import cut


@dataclass(frozen=True)
class Geometry:
    """Of one class: the model's side, its dimensions and symmetry, the rotations' order, and what limits q."""

    wavelength: float
    area: float
    size: int
    rotation_order: int
    dimensions: int = 3
    symmetry: str = "P1"
    q_max: float | None = None
    res_max: float | None = None
    radius: float | None = None
    polarisation: str | None = None
    inner: int = 0
    outer: int = 0
    #: Voxels that the expectation's pixels leave out at either end besides.
    p_inner: int = 0
    p_outer: int = 0
    scales: tuple[float, ...] = (1.0,)
    offsets: tuple[tuple[float, float, float], ...] = ((0.0, 0.0, 0.0),)


def pixels_of(pixels: DataFrame, g: Geometry, z: float) -> tuple[DataFrame, float]:
    """pixels(i, x, y, z, good) that the mask leaves, with q, c and in_p_mask, and the size of a voxel in q."""
    q_max = geometry.q_limit(g.wavelength, z, g.q_max, g.res_max, g.radius)
    dq = geometry.voxel_step(q_max, g.size)
    rows = geometry.masked(geometry.scattering(pixels, g.wavelength, g.area, polarisation=g.polarisation), q_max, dq, g.inner, g.outer, g.p_inner, g.p_outer)
    return rows.where("in_mask"), dq


def mapping_of(spark: SparkSession, g: Geometry, dq: float) -> DataFrame:
    """Mapping rows of all scales, offsets, orientations and operators that do not act on voxels."""
    scales = spark.createDataFrame(list(enumerate(g.scales)), "scale_id int, scale double")
    offsets = spark.createDataFrame([(k, *o) for k, o in enumerate(g.offsets)], "offset_id int, dx double, dy double, dz double")
    operators = symmetry.rotation_operators(spark, g.symmetry if g.dimensions == 3 else "P1")
    return geometry.mapping(geometry.rotations(spark, g.rotation_order, g.dimensions), operators, scales, offsets, g.wavelength, dq, g.size)


def initialise(pixels: DataFrame, frames: DataFrame, g: Geometry, z: float, widths: tuple[float, ...] | None = None, photons: DataFrame | None = None, model: DataFrame | None = None) -> tuple[State, DataFrame]:
    """The first state of one class and the pixels' weights (i, c) in the maximisation.

    pixels(i, x, y, z, good), frames(d[, ksum]). Templates are read at points of the first operator's mapping alone, a
    row for each pixel; merging sends a pixel to the voxels of all operators. The model(n, value) is random if none is
    given, times a Gaussian about the middle if widths are given; every fluence is one. With photons, ksum is counted
    over the mask, and frames without photons have none. z is the first pixel's, for limits of q that are given as a
    distance. With padding of the mask the expectation has pixels of its own.
    """
    spark = pixels.sparkSession
    kept, dq = pixels_of(pixels, g, z)
    kept = cut(kept)
    rows = mapping_of(spark, g, dq)
    at = geometry.voxel_coordinates(kept, rows, g.dimensions)
    points = at.where("s = 0").drop("s")
    voxels = geometry.voxel_index(at, g.size, g.dimensions).select("r", "i", "n")
    if model is None:
        model = report.random_model(symmetry.voxels(spark, g.size, g.dimensions))
    if widths:
        shape = report.blob(model.select("n"), g.size, widths).withColumnRenamed("value", "shape")
        model = model.join(shape, "n").select("n", (F.col("value") * F.col("shape")).alias("value"))
    if photons is not None:
        seen = photons.join(kept.select("i"), "i", "left_semi").groupBy("d").agg(F.sum("k").alias("k_"))
        others = [c for c in frames.columns if c != "ksum"]
        frames = frames.join(seen, "d", "left").select(*others, F.coalesce("k_", F.lit(0)).cast("long").alias("ksum"))
    p_weights = kept.where("in_p_mask").select("i", "c") if g.p_inner or g.p_outer else None
    grid = symmetry.Grid(g.size, g.dimensions, g.symmetry)
    return State(frames.withColumn("fluence", F.lit(1.0)), voxels, model, points=(points,), grids=(grid,), p_weights=p_weights), kept.select("i", "c")
