"""A working folder of iterations: what each leaves, and the reports that read them."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomolake.sources.versions import Versioned


def put(df: DataFrame, path: str, **partition) -> None:
    """Writes df as one partition of the versioned table at path, in place of what the partition held. Readers meet
    the rows before or after, never none."""
    Versioned(df.sparkSession, path).put(df, **partition)


class Store:
    """Versioned tables under path, each in partitions by iteration. An iteration counts once its metrics are there;
    they are written last, and writing an iteration again replaces it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def metrics(self) -> DataFrame | None:
        return Versioned(self.spark, f"{self.path}/metrics").read()

    def iterations(self) -> list[int]:
        return sorted({p.partition["iteration"] for p in Versioned(self.spark, f"{self.path}/metrics").manifest()[1]})

    def last(self) -> int | None:
        return max(self.iterations(), default=None)

    def save(self, iteration: int, state, assigned: DataFrame, metrics: DataFrame) -> None:
        tables = {"frames": state.frames, "model": state.model, "assigned": assigned, "logr": state.logr, "posterior": state.post}
        for name, table in tables.items():
            put(table, f"{self.path}/{name}", iteration=iteration)
        put(metrics.drop("iteration"), f"{self.path}/metrics", iteration=iteration)

    def read(self, name: str, iteration: int) -> DataFrame:
        found = Versioned(self.spark, f"{self.path}/{name}").read(iteration=iteration)
        if found is None:
            raise LookupError(f"no {name} of iteration {iteration}")
        return found.drop("iteration")

    def state(self, iteration: int, given):
        """The state that an iteration left; what iterations do not change is taken from the given one."""
        names = {"frames": "frames", "model": "model", "logr": "logr", "post": "posterior"}
        return replace(given, **{k: self.read(name, iteration) for k, name in names.items()})

    def assigned(self, iteration: int) -> DataFrame:
        return self.read("assigned", iteration)

    def history(self, d: int) -> DataFrame:
        """iteration, r, c, p of one frame."""
        return Versioned(self.spark, f"{self.path}/assigned").read().where(F.col("d") == d).select("iteration", "r", "c", "p")
