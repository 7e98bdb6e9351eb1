"""Column expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def positive_log(x: Column) -> Column:
    """ln x for x > 0, else 0: an empty template pixel adds nothing to a likelihood."""
    return F.when(x > 0, F.ln(x)).otherwise(F.lit(0.0))


def ratio(num: Column, den: Column) -> Column:
    """num / den with 0 counted as 1 below the line."""
    return num / F.when(den == 0, F.lit(1.0)).otherwise(den)


def clipped(x: Column, low: float | None = None, high: float | None = None) -> Column:
    x = F.greatest(x, F.lit(low)) if low is not None else x
    return F.least(x, F.lit(high)) if high is not None else x


def ravelled(*index: Column, size: int) -> Column:
    """One number for a grid index, first axis slowest."""
    out = F.lit(0).cast("long")
    for i in index:
        out = out * size + i
    return out.cast("long")


def unravelled(n: Column, size: int, axes: int) -> list[Column]:
    return [(F.floor(n / size ** (axes - 1 - k)) % size).cast("int") for k in range(axes)]


def inside(size: int, *index: Column) -> Column:
    keep = F.lit(True)
    for i in index:
        keep = keep & (i >= 0) & (i < size)
    return keep


def norm(x: Column, y: Column, z: Column) -> Column:
    return F.sqrt(x * x + y * y + z * z)


def close(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    return F.abs(a - b) <= atol + rtol * F.abs(b)
