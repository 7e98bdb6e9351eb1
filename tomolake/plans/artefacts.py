"""Artefacts made from inputs and settings, made again only where something that they depend on has changed."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomolake.sources.versions import Versioned


@dataclass(frozen=True)
class Recipe:
    """make(parts, settings) gives the artefact's rows; of the parts it may read those in after, of the settings those named."""

    name: str
    make: Callable[[dict[str, DataFrame], dict], DataFrame]
    after: tuple[str, ...] = ()
    settings: tuple[str, ...] = ()


def contents(rows: DataFrame) -> str:
    """A name for a table's rows, in whatever order: their number and the sum of their hashes, added up where they are."""
    found = rows.select(F.xxhash64(*rows.columns).cast("decimal(38,0)").alias("h")).agg(F.count("*").alias("n"), F.coalesce(F.sum("h"), F.lit(0)).alias("h")).first()
    names = ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in rows.schema)
    return f"{names}:{found['n']}:{found['h']}"


def in_order(recipes: list[Recipe]) -> list[Recipe]:
    """Recipes with those that each depends on before it."""
    known = {r.name: r for r in recipes}
    if len(known) < len(recipes):
        raise ValueError("two recipes of one name")
    out: list[Recipe] = []

    def add(name: str, above: tuple[str, ...]) -> None:
        if name not in known or name in above:
            raise ValueError(f"no recipe for {name}" if name not in known else f"{name} depends on itself")
        if known[name] not in out:
            for n in known[name].after:
                add(n, (*above, name))
            out.append(known[name])

    for r in recipes:
        add(r.name, ())
    return out


class Artefacts:
    """Versioned tables under path, one for each artefact. Its manifest notes the fingerprint that it was made from: the
    settings that it reads, the contents of its input and the fingerprints of what it depends on."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _table(self, name: str) -> Versioned:
        return Versioned(self.spark, f"{self.path}/{name}")

    def version(self, name: str) -> int:
        return self._table(name).manifest()[0]

    def fingerprints(self, recipes: list[Recipe], settings: dict, inputs: dict[str, DataFrame]) -> dict[str, str]:
        out: dict[str, str] = {}
        for r in in_order(recipes):
            told = {"settings": {k: settings[k] for k in r.settings}, "after": {n: out[n] for n in r.after}, "input": contents(inputs[r.name]) if r.name in inputs else None}
            out[r.name] = hashlib.sha256(json.dumps(told, sort_keys=True, default=repr).encode()).hexdigest()
        return out

    def stale(self, recipes: list[Recipe], settings: dict, inputs: dict[str, DataFrame]) -> list[str]:
        """Artefacts that are not there or were made from something else, in the order in which they would be made."""
        prints = self.fingerprints(recipes, settings, inputs)
        return [r.name for r in in_order(recipes) if self._table(r.name).manifest()[2].get("fingerprint") != prints[r.name]]

    def build(self, recipes: list[Recipe], settings: dict, inputs: dict[str, DataFrame], keep: tuple[str, ...] = ()) -> dict[str, DataFrame]:
        """All artefacts by name; the stale ones, but those to keep that exist, are made and written first.

        An artefact is there with its fingerprint or not at all; a build that was stopped goes on where it was.
        """
        prints = self.fingerprints(recipes, settings, inputs)
        made: dict[str, DataFrame] = {}
        for r in in_order(recipes):
            table = self._table(r.name)
            number, _, notes = table.manifest()
            if notes.get("fingerprint") != prints[r.name] and not (number and r.name in keep):
                table.put(r.make({n: made[n] for n in r.after}, {k: settings[k] for k in r.settings}), notes={"fingerprint": prints[r.name]})
            made[r.name] = table.read()
        return made
