"""Point-group symmetry of voxel models: P1, inversion and D6 (its reflections; its rotations act on orientations)."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tomolake.functions.expressions import inside, ravelled, unravelled


def voxels(spark: SparkSession, size: int, axes: int) -> DataFrame:
    return spark.range(size**axes).select(F.col("id").alias("n"))


def _flips(symmetry: str, axes: int) -> list[tuple[bool, ...]]:
    """Which axes each operation reflects; the first is the identity."""
    none, all_ = (False,) * axes, (True,) * axes
    if symmetry == "P1":
        return [none]
    if symmetry == "inversion" or symmetry == "D6" and axes == 2:
        return [none, all_]
    if symmetry == "D6":
        return [tuple(bool(k >> a & 1) for a in range(axes)) for k in range(1 << axes)]
    raise ValueError(f"no symmetry {symmetry}")


def asymmetric_unit(grid: DataFrame, size: int, axes: int, symmetry: str) -> DataFrame:
    """n of the voxels that stand for all others: first index up to the middle (inversion), or all of them (D6)."""
    index, middle = unravelled(F.col("n"), size, axes), size // 2
    if symmetry == "P1":
        return grid.select("n")
    tested = index if symmetry == "D6" and axes == 3 else index[:1]
    keep = F.lit(True)
    for i in tested:
        keep = keep & (i <= middle)
    return grid.where(keep).select("n")


def _images(size: int, axes: int, symmetry: str, n: Column | None = None) -> list[Column]:
    """n under each operation; null where a reflection about the middle leaves the grid."""
    index, middle = unravelled(F.col("n") if n is None else n, size, axes), size // 2
    out = []
    for flips in _flips(symmetry, axes):
        at = [F.lit(2 * middle) - i if f else i for i, f in zip(index, flips, strict=True)]
        out.append(F.when(inside(size, *at), ravelled(*at, size=size)))
    return out


@dataclass(frozen=True)
class Grid:
    """The voxels of one class: a cube (or square) of a symmetry, numbered from first on."""

    size: int
    axes: int = 3
    symmetry: str = "P1"
    first: int = 0

    @property
    def end(self) -> int:
        return self.first + self.size**self.axes


def orbit(n: Column, grids: Sequence[Grid]) -> Column:
    """The distinct voxels in its own class's grid that symmetry takes n to, n itself included; only n without grids.

    The orbit of any of its voxels is the same set: an index whose reflection leaves the grid stays where it is in all.
    """
    found = F.array(n)
    for g in grids:
        if g.symmetry != "P1":
            own = [image + g.first for image in _images(g.size, g.axes, g.symmetry, n - g.first)]
            found = F.when((n >= g.first) & (n < g.end), F.array_distinct(F.filter(F.array(*own), lambda x: x.isNotNull()))).otherwise(found)
    return found


def partners(grid: DataFrame, size: int, axes: int, symmetry: str) -> DataFrame:
    """n, partner: the distinct voxels in the grid that symmetry takes n to, itself included."""
    every = F.array_distinct(F.filter(F.array(*_images(size, axes, symmetry)), lambda x: x.isNotNull()))
    return grid.select("n", F.explode(every).alias("partner"))


def orbit_representative(rows: DataFrame, size: int, axes: int, symmetry: str) -> DataFrame:
    """rows with rep, the smallest voxel that n goes to: grouping by it gathers an orbit's terms without a join."""
    return rows.withColumn("rep", F.array_min(F.array(*_images(size, axes, symmetry))))


def symmetrised(model: DataFrame, columns: list[str], size: int, axes: int, symmetry: str) -> DataFrame:
    """n and columns: sums over all operations whose image is in the grid; a voxel that is its own image counts as often."""
    every = F.filter(F.array(*_images(size, axes, symmetry)), lambda x: x.isNotNull())
    spread = model.select(F.explode(every).alias("n_"), *columns).withColumnRenamed("n_", "n")
    return spread.groupBy("n").agg(*[F.sum(c).alias(c) for c in columns])


def multiplicity(grid: DataFrame, size: int, axes: int, symmetry: str) -> DataFrame:
    """n, times: how many operations contribute to a voxel."""
    return symmetrised(grid.select("n", F.lit(1).alias("times")), ["times"], size, axes, symmetry)


def expanded(solved: DataFrame, size: int, axes: int, symmetry: str) -> DataFrame:
    """n, value on the whole grid from values on an asymmetric unit: what symmetry sends to a voxel, averaged."""
    summed = symmetrised(solved.select("n", "value", F.lit(1.0).alias("times")), ["value", "times"], size, axes, symmetry)
    return summed.select("n", (F.col("value") / F.col("times")).alias("value"))


def rotation_operators(spark: SparkSession, symmetry: str) -> DataFrame:
    """s, s00 .. s22: operations that do not act on voxels: rotations by 60, 120 and 180 degrees about z for D6."""
    turns = [math.pi / 3, 2 * math.pi / 3, math.pi] if symmetry == "D6" else [0.0]
    rows = [(s, math.cos(t), -math.sin(t), 0.0, math.sin(t), math.cos(t), 0.0, 0.0, 0.0, 1.0) for s, t in enumerate(turns)]
    return spark.createDataFrame(rows, "s int, " + ", ".join(f"s{i}{j} double" for i in range(3) for j in range(3)))
