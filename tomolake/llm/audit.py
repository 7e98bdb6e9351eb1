"""Filter interaction audit by permutation-trie execution.

The orders in which k filters can be applied form a trie. It is walked depth-first: the survivors of a prefix are a
persisted DataFrame, the next filter is applied to it, and what the filter removes there is counted. Prefixes that are
equal as sets leave the same survivors, so each set is a state that is made and counted once: 2 ** k states and
k * 2 ** (k - 1) edges stand for k! orders.
"""

from __future__ import annotations

import uuid
from itertools import permutations
from math import factorial

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomolake.llm.common import cut, shared_dir

#: Groups of equal texts, the largest, whose first ids go to the rows by a broadcast; no other group can hold more than
#: this part of all rows.
LARGEST = 10_000

SPACES = r"[\x20\x09-\x0D]+"


def failing_conditions(docs: DataFrame) -> DataFrame:
    """doc_id, part, A to D (whether a filter's condition fails) and h (sha256 of the text) for each row of docs."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.withColumn("words", F.array_remove(F.split("text", SPACES), ""))
    rows = rows.withColumns({"n": F.size("words").cast("long"), "distinct": F.size(F.array_distinct("words")).cast("long")})
    return rows.select(
        "doc_id", "part",
        (F.col("n") < 100).alias("A"), (100 * F.col("distinct") < 80 * F.col("n")).alias("B"),
        (100 * F.regexp_count("text", F.lit("[A-Z]")).cast("long") > 10 * F.length("text").cast("long")).alias("C"),
        F.col("text").rlike(r"[#$%&*|]").alias("D"), F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("h"),
    )


def with_repeats(rows: DataFrame, name: str, largest: int = LARGEST) -> DataFrame:
    """rows(doc_id, h, ..) without h, with a column: whether a smaller doc_id has the same h.

    Ids are combined before they are sent. The largest groups' first ids are broadcast, `largest` rows at most, and the
    groups' rows stay where they are; so a group of copies, however large, is no task of its own, and what is left to
    the join on h has no group of more than a `largest`-th part of all rows. Equal and null ids are not smaller.
    """
    firsts = rows.groupBy("h").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    firsts = cut(firsts)
    top = cut(firsts.orderBy(F.desc("n"), "h").limit(largest))
    repeat = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).alias(name)
    kept = [c for c in rows.columns if c != "h"]
    large = rows.join(F.broadcast(top.select("h", "first")), "h").select(*kept, repeat)
    rest = rows.join(F.broadcast(top.select("h")), "h", "left_anti").join(firsts.join(F.broadcast(top.select("h")), "h", "left_anti"), "h", "left")
    return large.unionByName(rest.select(*kept, repeat))


def edges(rows: DataFrame, filters: list[str], losses: list[str], part: str = "part") -> DataFrame:
    """part, state (bits of the filters applied), own (the next filter's number), left (survivors of the state), removed
    and, for each name in losses, removed rows with that mark: what each filter removes from each state.

    rows has a boolean column for each filter, true where it fails, and for each loss. A state's counts are written to
    a folder of their own under spark.checkpoint.dir, and its survivors leave memory when all that follow from it have
    been made; a lost part is made again from the rows. States without survivors in a part have no rows.
    """
    folder = f"{shared_dir(rows.sparkSession)}/filter-audit-{uuid.uuid4().hex}"
    made: set[int] = set()
    each = F.array(*[F.struct(F.lit(k).alias("own"), F.count_if(F.col(f)).alias("removed"), *[F.count_if(F.col(f) & F.col(x)).alias(x) for x in losses]) for k, f in enumerate(filters)])

    def visit(state: int, survivors: DataFrame) -> None:
        made.add(state)
        open_ = [k for k in range(len(filters)) if not state >> k & 1]
        if not open_:
            return
        survivors = survivors.persist(StorageLevel.MEMORY_AND_DISK)
        survivors.groupBy(part).agg(F.count("*").alias("left"), each.alias("each")).write.parquet(f"{folder}/state={state}")
        for k in open_:
            if state | 1 << k not in made:
                visit(state | 1 << k, survivors.where(~F.col(filters[k])))
        survivors.unpersist()

    visit(0, rows)
    found = rows.sparkSession.read.parquet(folder).select(part, "state", "left", F.explode("each").alias("x")).select(part, "state", "left", "x.*")
    return found.where(F.col("state").bitwiseAND(F.call_function("shiftleft", F.lit(1), F.col("own"))) == 0)


def by_order(found: DataFrame, filters: list[str], losses: list[str], part: str = "part") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, a column for each loss, and shapley.

    A row, zeros included, for each part, order of filters and step. redundant: rows that fail the step's filter and
    are gone before it; unique_fails: rows that fail no other filter; shapley: the filter's removals over all orders.
    """
    spark, k = found.sparkSession, len(filters)
    bit = F.call_function("shiftleft", F.lit(1), F.col("own"))
    all_ = found.where("state = 0").select(part).distinct().select(part, F.explode(F.sequence(F.lit(0), F.lit((1 << k) - 1))).alias("state"))
    all_ = all_.select("*", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("own")).where(F.col("state").bitwiseAND(bit) == 0)
    sums = ["left", "removed", *losses]
    full = all_.join(found, [part, "state", "own"], "left").select(part, "state", "own", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in sums])

    # An edge lies on as many orders as there are ways to arrange what comes before it and what comes after.
    ways = F.element_at(F.array(*[F.lit(factorial(n) * factorial(k - 1 - n)) for n in range(k)]), F.bit_count("state") + 1)
    alone = F.col("state") == F.lit((1 << k) - 1) - bit
    totals = full.groupBy(part, "own").agg(
        F.sum(F.when(F.col("state") == 0, F.col("removed"))).alias("fails"), F.sum(F.when(alone, F.col("removed"))).alias("unique_fails"), F.sum(F.col("removed") * ways).alias("shapley"),
    )
    steps = [("".join(filters[i] for i in p), s + 1, p[s], sum(1 << i for i in p[:s])) for p in permutations(range(k)) for s in range(k)]
    steps = spark.createDataFrame(steps, "filter_order string, step int, own int, state int")
    rows = full.join(totals, [part, "own"]).join(steps, ["state", "own"])
    return rows.select(
        part, "filter_order", "step", (F.col("left") - F.col("removed")).alias("kept"), "removed", (F.col("fails") - F.col("removed")).alias("redundant"),
        "unique_fails", *losses, "shapley",
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The five filters over docs(doc_id, text, lang): a row for each lang, order and step; see by_order.

    good_lost and toxic_lost count removed rows whose doc_id has a label (doc_id, quality, toxic) with quality 1, or
    toxic 1, once however often the id is labelled; a null id has none. Null texts are empty ones, a null lang is the
    part of the empty string; rows that repeat an id are rows of their own; other columns are ignored; an empty table
    gives no rows.
    """
    rows = cut(failing_conditions(docs))
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*[F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(n) for c, n in (("quality", "good_lost"), ("toxic", "toxic_lost"))])
    marks = marks.where("good_lost or toxic_lost")
    losses = ["good_lost", "toxic_lost"]
    labelled = rows.join(marks, "doc_id", "left").select(*rows.columns, *[F.coalesce(c, F.lit(False)).alias(c) for c in losses])
    ready = cut(with_repeats(labelled, "E").drop("doc_id"))
    return by_order(edges(ready, list("ABCDE"), losses), list("ABCDE"), losses)
