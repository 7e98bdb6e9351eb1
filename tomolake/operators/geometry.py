"""Detector pixels, orientations, and where pixels fall in a model. Expressions over generated grids only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tomolake.functions.expressions import inside, norm, ravelled, unravelled

# The angles of the rotation that every orientation is turned by, and of the first in-plane rotation.
FIXED_PHI, FIXED_PHI2, FIXED_THETA = 1.2 * math.pi / 4, 1.3660358560403127 * math.pi, 1.4316602255033495 * math.pi
FIRST_ANGLE = 0.37576737726076753
GOLDEN = (1 + math.sqrt(5)) / 2


def scattering(pixels: DataFrame, wavelength: float, area: float, offset: tuple[float, float, float] = (0.0, 0.0, 0.0), polarisation: str | None = None) -> DataFrame:
    """pixels(i, x, y, z, good) with q vector (qx, qy, qz), qr and the correction c.

    Positions are taken relative to the offset; c is solid angle times polarisation over its largest good value.
    """
    x, y, z = (F.col(a) - o for a, o in zip("xyz", offset, strict=True))
    r = norm(x, y, z)
    bent = {"x": 1 - (x / r) * (x / r), "y": 1 - (y / r) * (y / r), None: F.lit(1.0)}[polarisation]
    q = [(x / r) / wavelength, (y / r) / wavelength, (z / r - 1) / wavelength]
    rows = pixels.select("*", *[e.alias(n) for e, n in zip(q, ("qx", "qy", "qz"), strict=True)], (area * z / (r * r * r) * bent).alias("c"))
    rows = rows.withColumn("qr", norm(F.col("qx"), F.col("qy"), F.col("qz")))
    most = rows.where("good").agg(F.max("c").alias("most"))
    return rows.crossJoin(F.broadcast(most)).withColumn("c", F.col("c") / F.col("most")).drop("most")


def largest_q(wavelength: float, radius: float, z: float) -> float:
    """q at a distance from the axis on a flat detector."""
    rho = math.hypot(radius, z)
    return math.sqrt(radius**2 + (z - rho) ** 2) / wavelength / rho


def voxel_step(q_max: float, size: int) -> float:
    return q_max / (size / 2 - 1) if size % 2 == 0 else 2 * q_max / (size - 1)


def masked(pixels: DataFrame, q_max: float, dq: float | None = None, inner: int = 0, outer: int = 0, p_inner: int = 0, p_outer: int = 0) -> DataFrame:
    """pixels with in_mask and in_p_mask: good, qr up to q_max, and inside the annuli that cut voxels at either end."""
    kept = F.col("good") & (F.col("qr") <= q_max)
    if dq is None:
        return pixels.withColumn("in_mask", kept).withColumn("in_p_mask", kept)
    low = pixels.where(kept).agg(F.min("qr").alias("_low"))

    def annulus(n: int, m: int) -> Column:
        return F.coalesce(kept & (F.col("qr") >= F.col("_low") + n * dq) & (F.col("qr") <= q_max - m * dq), F.lit(False))

    rows = pixels.crossJoin(F.broadcast(low)).withColumn("in_mask", annulus(inner, outer))
    return rows.withColumn("in_p_mask", annulus(inner + p_inner, outer + p_outer)).drop("_low")


def q_limit(wavelength: float, z: float, q_max: float | None = None, res_max: float | None = None, radius: float | None = None) -> float:
    """The largest q by the first of these that is given: itself, a resolution, a distance from the axis."""
    if q_max:
        return q_max
    if res_max:
        return 1 / res_max
    if radius:
        return largest_q(wavelength, radius, z)
    raise ValueError("one of q_max, res_max and radius is needed")


def rotations(spark: SparkSession, order: int, dimensions: int) -> DataFrame:
    """r, a00 .. a22: in-plane rotations (2, embedded with unit z; order 0: the identity) or near-uniform ones (3)."""
    if dimensions == 3:
        if order < 1:
            raise ValueError("three dimensions need a rotation order of one at least")
        return rotations_3d(spark, order)
    if dimensions != 2:
        raise ValueError(f"no rotations in {dimensions} dimensions")
    plane = rotations_2d(spark, order) if order else spark.range(1).select(F.col("id").alias("r"), *[F.lit(float(a == b)).alias(f"a{a}{b}") for a in range(2) for b in range(2)])
    rest = [F.lit(1.0 if a == b == 2 else 0.0).alias(f"a{a}{b}") for a in range(3) for b in range(3) if 2 in (a, b)]
    found = plane.select("*", *rest)
    return found.select("r", *[f"a{a}{b}" for a in range(3) for b in range(3)])


def orientation_sample(rotations: DataFrame, n: int = 20, seed: int = 0) -> DataFrame:
    """n rotations, those of the smallest seeded hashes of r."""
    return rotations.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("r").cast("string")).cast("binary")), "r").limit(n)


def rotations_2d(spark: SparkSession, order: int) -> DataFrame:
    """r, a00 .. a11: in-plane rotations by 2 pi r / order from a fixed first angle."""
    angle = 2 * math.pi * F.col("id") / order + FIRST_ANGLE
    c, s = F.cos(angle), F.sin(angle)
    return spark.range(order).select(F.col("id").alias("r"), c.alias("a00"), (-s).alias("a01"), s.alias("a10"), c.alias("a11"))


def rotation_counts(order: int) -> tuple[int, int]:
    """In-plane rotations (odd) and directions on the sphere."""
    return math.ceil(math.pi * order) // 2 * 2 + 1, int(math.pi * order**2) + 1


def _product(a: list[list], b: list[list]) -> list[list]:
    return [[sum((a[i][k] * b[k][j] for k in range(1, 3)), a[i][0] * b[0][j]) for j in range(3)] for i in range(3)]


def _about_z(c, s) -> list[list]:
    return [[c, -s, 0.0], [s, c, 0.0], [0.0, 0.0, 1.0]]


def _about_y(c, s) -> list[list]:
    return [[c, 0.0, s], [0.0, 1.0, 0.0], [-s, 0.0, c]]


def rotations_3d(spark: SparkSession, order: int) -> DataFrame:
    """r, a00 .. a22: near-uniform rotations, a spherical Fibonacci lattice of directions times in-plane rotations."""
    plane, sphere = rotation_counts(order)
    i, j = F.floor(F.col("id") / plane) + 0.5, F.col("id") % plane + 0.5
    phi, turn, theta = F.acos(1 - 2 * i / sphere), 2 * math.pi * j / plane, 2 * math.pi * i / GOLDEN
    own = _product(_product(_about_z(F.cos(theta), F.sin(theta)), _about_y(F.cos(phi), F.sin(phi))), _about_z(F.cos(turn), F.sin(turn)))
    fixed = _product(_product(_about_z(math.cos(FIXED_THETA), math.sin(FIXED_THETA)), _about_y(math.cos(FIXED_PHI), math.sin(FIXED_PHI))), _about_z(math.cos(FIXED_PHI2), math.sin(FIXED_PHI2)))
    all_ = _product(own, fixed)
    return spark.range(plane * sphere).select(F.col("id").alias("r"), *[F.lit(all_[a][b]).cast("double").alias(f"a{a}{b}") for a in range(3) for b in range(3)])


def mapping(rotations: DataFrame, operators: DataFrame, scales: DataFrame, offsets: DataFrame, wavelength: float, dq: float, size: int) -> DataFrame:
    """s, r, dx, dy, dz, b0 .. b2, m00 .. m22: A = scale * S * R / (wavelength dq), b = size // 2 - A's last column.

    r runs over scales first, then offsets, then orientations. operators(s, s00 .. s22), scales(scale_id, scale) and
    offsets(offset_id, dx, dy, dz) are small; the product has a row for each combination.
    """
    n, m = rotations.count(), offsets.count()
    rows = rotations.crossJoin(F.broadcast(operators)).crossJoin(F.broadcast(scales)).crossJoin(F.broadcast(offsets))
    factor = F.col("scale") / (wavelength * dq)
    a = [[sum((F.col(f"s{i}{k}") * F.col(f"a{k}{j}") for k in range(1, 3)), F.col(f"s{i}0") * F.col(f"a0{j}")) * factor for j in range(3)] for i in range(3)]
    r = (F.col("scale_id") * m + F.col("offset_id")) * n + F.col("r")
    return rows.select("s", r.alias("r"), "scale_id", "dx", "dy", "dz", *[(size // 2 - a[i][2]).alias(f"b{i}") for i in range(3)], *[a[i][j].alias(f"m{i}{j}") for i in range(3) for j in range(3)])


def voxel_coordinates(pixels: DataFrame, rows: DataFrame, axes: int = 3) -> DataFrame:
    """s, r, i, u0 ..: model coordinates of every pixel under every mapping row. The rows stay where they are; the
    pixels, few, go to each."""
    x, y, z = F.col("x") - F.col("dx"), F.col("y") - F.col("dy"), F.col("z") - F.col("dz")
    r = norm(x, y, z)
    u = [(F.col(f"m{k}0") * x + F.col(f"m{k}1") * y + F.col(f"m{k}2") * z) / r + F.col(f"b{k}") for k in range(axes)]
    return rows.crossJoin(pixels.select("i", "x", "y", "z")).select("s", "r", "i", *[e.alias(f"u{k}") for k, e in enumerate(u)])


def voxel_index(coordinates: DataFrame, size: int, axes: int = 3) -> DataFrame:
    """s, r, i, n: the nearest voxel, halves to even; pixels that fall outside the grid have none and go."""
    near = [F.rint(f"u{k}").cast("long") for k in range(axes)]
    return coordinates.where(inside(size, *near)).select("s", "r", "i", ravelled(*near, size=size).alias("n"))


def tiled(model: DataFrame, size: int, axes: int, side: int) -> DataFrame:
    """tile, values: model(n, value) in tiles of side voxels and a border of one, a row each; values are in the order of
    the index, zero where the model has no voxel and outside the grid.

    Voxels are counted from one, so that the voxel before the first is index 0 of its tile. A voxel whose index is a
    multiple of side is the first of one tile and the border of the tile before it.
    """
    across, wide = size // side + 1, side + 1
    index = unravelled(F.col("n"), size, axes)
    rows = model.select("value", *[(i + 1).alias(f"p{k}") for k, i in enumerate(index)])
    for k in range(axes):
        p = F.col(f"p{k}")
        own = F.struct(F.floor(p / side).alias("t"), (p % side).alias("l"))
        before = F.struct((F.floor(p / side) - 1).alias("t"), F.lit(side).alias("l"))
        rows = rows.withColumn(f"x{k}", F.explode(F.when(p % side == 0, F.array(own, before)).otherwise(F.array(own)))).drop(f"p{k}")
    tile, local = ravelled(*[F.col(f"x{k}.t") for k in range(axes)], size=across), ravelled(*[F.col(f"x{k}.l") for k in range(axes)], size=wide)
    cells = rows.select(tile.alias("tile"), local.cast("int").alias("cell"), F.lit(1).alias("own"), F.col("value").cast("double").alias("value"))
    blank = cells.sparkSession.range(across**axes).select(F.col("id").alias("tile"), F.explode(F.sequence(F.lit(0), F.lit(wide**axes - 1))).alias("cell"), F.lit(0).alias("own"), F.lit(0.0).alias("value"))
    full = cells.unionByName(blank).groupBy("tile").agg(F.sort_array(F.collect_list(F.struct("cell", "own", "value"))).alias("x"))
    last = F.filter("x", lambda c, k: F.coalesce(F.get("x", k + 1)["cell"] != c["cell"], F.lit(True)))
    return full.select("tile", F.transform(last, lambda c: c["value"]).alias("values"))


#: Voxels along a tile's side, by axes; bytes of tiles that are broadcast at most.
TILE_SIDE = {2: 64, 3: 16}
BROADCAST_BYTES = 16_000_000


def sampled(coordinates: DataFrame, model: DataFrame, size: int, axes: int = 3, kind: str = "linear", keys: tuple[str, ...] = ("r", "i"), side: int | None = None) -> DataFrame:
    """keys, w: model(n, value) at coordinates u0 .., zero outside: bi- or trilinear, or the nearest, halves up.

    A coordinate meets its 4 or 8 corners in one tile of the model, by one row and one join on the tile; what a grid's
    tiles take is known from its size, and up to BROADCAST_BYTES they go to the coordinates, which then stay in place.
    """
    if kind == "nearest":
        near = [F.floor(F.col(f"u{k}") + 0.5).cast("long") for k in range(axes)]
        at = coordinates.select(*keys, F.when(inside(size, *near), ravelled(*near, size=size)).alias("n"))
        return at.join(model, "n", "left").select(*keys, F.coalesce("value", F.lit(0.0)).alias("w"))
    if kind != "linear":
        raise ValueError(f"no interpolation {kind}")
    side = min(side or TILE_SIDE[axes], size + 1)
    across, wide = size // side + 1, side + 1
    tiles = tiled(model, size, axes, side)
    if 8 * across**axes * wide**axes <= BROADCAST_BYTES:
        tiles = F.broadcast(tiles)
    low = [F.floor(f"u{k}").cast("long") + 1 for k in range(axes)]
    rows = coordinates.select(
        *keys, F.when(inside(size + 1, *low), ravelled(*[F.floor(p / side).cast("long") for p in low], size=across)).alias("tile"),
        ravelled(*[p % side for p in low], size=wide).cast("int").alias("cell"), *[(F.col(f"u{k}") - F.floor(f"u{k}")).alias(f"f{k}") for k in range(axes)],
    )
    w = F.lit(0.0)
    for corner in range(1 << axes):
        up = [corner >> (axes - 1 - k) & 1 for k in range(axes)]
        share, step = F.lit(1.0), sum(b * wide ** (axes - 1 - k) for k, b in enumerate(up))
        for k in range(axes):
            share = share * (F.col(f"f{k}") if up[k] else 1 - F.col(f"f{k}"))
        w = w + share * F.get("values", F.col("cell") + step)
    return rows.join(tiles, "tile", "left").select(*keys, F.coalesce(w, F.lit(0.0)).alias("w"))
