"""One call from a configuration to a model: classes of any geometry are set up, iterated, and gone on with later."""

from __future__ import annotations

from dataclasses import asdict, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomolake.operators.symmetry import Grid
from tomolake.plans import em
from tomolake.plans.artefacts import Artefacts, Recipe
from tomolake.plans.initial import Geometry, initialise
from tomolake.plans.store import Store
from tomolake.sources.versions import Versioned

OPTIONS = {"classes", "z", "widths", "em"}


def geometry_of(options: dict) -> Geometry:
    """A class's geometry from a plain dictionary; keys that are no settings are an error, nothing is executed."""
    unknown = set(options) - {f.name for f in fields(Geometry)}
    if unknown:
        raise ValueError(f"unknown settings {sorted(unknown)}")
    return Geometry(**{k: tuple(map(tuple, v)) if k == "offsets" else tuple(v) if k == "scales" else v for k, v in options.items()})


class Project:
    """A folder with the artefacts of each class and the iterations of all.

    options: classes (a dictionary of settings each), z (of the first pixel), widths of the first models' Gaussians, and
    em, the options of the iterations. pixels(i, x, y, z, good), photons(d, i, k), frames(d, ..) are the data.
    """

    def __init__(self, spark: SparkSession, path: str, options: dict):
        unknown = set(options) - OPTIONS
        if unknown or not options.get("classes"):
            raise ValueError(f"unknown options {sorted(unknown)}" if unknown else "no classes")
        self.spark, self.path = spark, path
        self.geometries = [geometry_of(c) for c in options["classes"]]
        self.config, self.z, self.widths = em.Config.of(options.get("em", {})), options["z"], options.get("widths")
        self.artefacts = Artefacts(spark, f"{path}/artefacts")

    def _recipes(self, pixels: DataFrame, frames: DataFrame, photons: DataFrame, models: dict[int, DataFrame]) -> tuple[list[Recipe], dict, dict]:
        recipes, settings = [], {}
        for c, g in enumerate(self.geometries):
            settings[f"geometry{c}"], settings["z"], settings["widths"] = asdict(g), self.z, self.widths
            settings[f"grid{c}"] = (g.size, g.dimensions)
            first: dict = {}

            def state(g=g, first=first) -> tuple[em.State, DataFrame]:  # one set-up for all artefacts of a class
                if not first:
                    first["x"] = initialise(pixels, frames, g, self.z, self.widths, photons)
                return first["x"]

            uses, model = (f"geometry{c}", "z"), (f"grid{c}", "widths")
            recipes += [
                Recipe(f"points{c}", lambda _, s, state=state: state()[0].points[0], (), uses), Recipe(f"voxels{c}", lambda _, s, state=state: state()[0].voxels, (), uses),
                Recipe(f"weights{c}", lambda _, s, state=state: state()[1], (), uses), Recipe(f"model{c}", lambda _, s, state=state, c=c: models[c] if c in models else state()[0].model, (), model),
                Recipe(f"expected{c}", lambda _, s, state=state: state()[1] if state()[0].p_weights is None else state()[0].p_weights, (), uses),
                Recipe(f"frames{c}", lambda _, s, state=state: state()[0].frames, (f"weights{c}",)),
            ]
        inputs = {f"{n}{c}": pixels for c in range(len(self.geometries)) for n in ("points", "voxels", "weights", "expected")}
        inputs |= {f"frames{c}": photons for c in range(len(self.geometries))} | {f"model{c}": m for c, m in models.items()}
        return recipes, settings, inputs

    def first_state(self, pixels: DataFrame, frames: DataFrame, photons: DataFrame, models: dict[int, DataFrame] | None = None) -> tuple[em.State, DataFrame]:
        """The state before the first iteration and the maximisation's weights; what settings or data have not made stale is
        read, not made. models has the first models of some classes; others are random, and stay unless their grid changes."""
        recipes, settings, inputs = self._recipes(pixels, frames, photons, models or {})
        made = self.artefacts.build(recipes, settings, inputs)
        states = []
        for c, g in enumerate(self.geometries):
            grid = Grid(g.size, g.dimensions, g.symmetry)
            expected = made[f"expected{c}"] if g.p_inner or g.p_outer else None
            one = em.State(made[f"frames{c}"], made[f"voxels{c}"], made[f"model{c}"], points=(made[f"points{c}"],), grids=(grid,), p_weights=expected)
            states.append((one, made[f"points{c}"].agg(F.max("r")).first()[0] + 1))
        return (states[0][0] if len(states) == 1 else em.joined(states)), made["weights0"]

    def run(self, pixels: DataFrame, frames: DataFrame, photons: DataFrame, background: DataFrame | None = None, restart: bool = False, models: dict[int, DataFrame] | None = None) -> tuple[em.State, DataFrame]:
        """State and metrics after all iterations of the configuration. Iterations that the folder holds are not run again;
        restart begins anew, beside them."""
        state, weights = self.first_state(pixels, frames, photons, models)
        runs = Versioned(self.spark, f"{self.path}/runs")
        if restart or runs.manifest()[0] == 0:
            runs.put(self.spark.range(1))
        store = Store(self.spark, f"{self.path}/iterations-{runs.manifest()[0]}")
        return em.run(state, photons, weights, self.config, background=background, store=store)
