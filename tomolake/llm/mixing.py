"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Targets are filled up by weight under a cap, seats (blocks) go to sources and then to their shards by highest
quotients, and each shard takes its quota of blocks at a seeded, evenly spaced choice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tomolake.llm.common import cut

#: Words in a block.
BLOCK = 16
#: Words that a shard of one source holds at most, about; sources of more are dealt over several shards.
SHARD_WORDS = 1_000_000
#: Part of all words that the mix takes.
SHARE = 1.5
#: Times that a word may be taken.
CAP = 2
WEIGHTS = (5, 2, 1)
SEED = "mix-1"


def word_count(text: str | Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+`; null has none."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(c, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def apportion(cells: DataFrame, by: list[str], weight: str, seats: str, order: list[Column]) -> DataFrame:
    """cells with a column quota: the integer share of `seats` (one number in each group `by`) by Sainte-Laguë.

    The seats go to the highest quotients weight / (2k - 1), ties to the earlier cell in `order`. Rounding
    weight * seats / total gives the right quotas but for a few seats; only those near the line are ranked: with n
    cells at most n / 2 seats are left over or too many, and a cell gets its proportional part of 1.5 n, and one
    more. Cells of no weight get none.
    """
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    total, n = F.sum(weight).over(group), F.count("*").over(group)
    base = cells.withColumn("_t", total).withColumn("_n", n)
    base = base.withColumn("_q", F.when(F.col("_t") > 0, F.floor(F.col(weight) * F.col(seats) / F.col("_t") + 0.5)).otherwise(0).cast("long"))
    base = base.withColumn("_gap", F.when(F.col("_t") > 0, F.col(seats) - F.sum("_q").over(group)).otherwise(0))
    base = base.withColumn("_cell", F.row_number().over(group.orderBy(*order)))
    reach = F.when(F.col("_t") > 0, F.ceil(1.5 * F.col("_n") * F.col(weight) / F.col("_t")) + 1).otherwise(0).cast("int")
    keys = [F.col(b).alias(f"_by{i}") for i, b in enumerate(by)]
    names = [f"_by{i}" for i in range(len(by))]
    near = base.where((F.col("_gap") != 0) & (F.col(weight) > 0)).select(
        *keys, "_cell", "_q", "_gap", F.col(weight).alias("_w"), F.explode(F.sequence(F.lit(1), reach)).alias("_step")
    )
    more = F.col("_gap") > 0
    seat = F.when(more, F.col("_q") + F.col("_step")).otherwise(F.col("_q") - F.col("_step") + 1)
    near = near.withColumn("_seat", seat).where("_seat >= 1").withColumn("_quotient", F.col("_w") / (2 * F.col("_seat") - 1))
    line = Window.partitionBy(*names) if names else Window.partitionBy(F.lit(0))
    sign = F.when(more, F.lit(1)).otherwise(-1)
    near = near.withColumn("_rank", F.row_number().over(line.orderBy(-sign * F.col("_quotient"), sign * F.col("_cell"), sign * F.col("_seat"))))
    moved = near.where(F.col("_rank") <= F.abs("_gap")).groupBy(*names, "_cell").agg(F.sum(sign).alias("_moved"))
    match = [base[b].eqNullSafe(moved[k]) for b, k in zip(by, names, strict=True)] + [base["_cell"] == moved["_cell"]]
    joined = base.join(moved, match, "left")
    return joined.select(*[base[c] for c in cells.columns], (F.col("_q") + F.coalesce("_moved", F.lit(0))).cast("long").alias("quota"))


def targets(sources: DataFrame, share: float = SHARE, cap: float = CAP, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """sources(source, source_size) with target (double): share of all words by weight, none over cap times its size.

    Weights repeat over the sources by code point, null last. What a capped source leaves goes to the others by
    weight: the level per weight at which all of it is placed, found among the sources sorted by cap / weight.
    """
    line = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(line) - 1) % len(weights) + 1).cast("int"))
    s = sources.withColumn("weight", weight.cast("double")).withColumn("most", F.col("source_size") * float(cap))
    every = Window.partitionBy(F.lit(0))
    ordered = every.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("want", F.sum("source_size").over(every) * float(share))
    left = F.col("want") - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    others = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    s = s.withColumn("level", left / others)
    open_ = F.when(F.col("level") * F.col("weight") <= F.col("most"), F.col("level"))
    s = s.withColumn("level", F.max(open_).over(every))
    return s.select("source", "source_size", F.least("most", F.coalesce(F.col("level") * F.col("weight"), F.col("most"))).alias("target"))


def _number(text: Column) -> Column:
    """A number below 2 ** 32 that hashes the text."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def _taken_before(x: Column, block: int) -> Column:
    """Words taken of the first x of a line of n blocks with the quota and phase in the row."""
    b, extra, n, phase = F.floor(x / block).cast("long"), F.col("quota") % F.col("n"), F.col("n"), F.col("phase")

    def chosen(k: Column) -> Column:
        return F.floor((k + phase) * extra / n).cast("long") - F.floor(phase * extra / n).cast("long")

    whole = F.floor(F.col("quota") / n).cast("long") * x
    return whole + block * chosen(b) + (x - b * block) * (chosen(b + 1) - chosen(b))


def _placed(
    docs: DataFrame,
    block: int = BLOCK,
    shard_words: int = SHARD_WORDS,
    share: float = SHARE,
    cap: int = CAP,
    weights: tuple[int, ...] = WEIGHTS,
    seed: str = SEED,
    tie: list[str] | None = None,
) -> DataFrame:
    """The rows of mix, with their source, shard and stop (the place on the shard's line where they end)."""
    extra = tie or []
    sized = cut(docs.select("doc_id", "source", word_count("text").alias("size"), *[F.col(c).alias(f"_tie{i}") for i, c in enumerate(extra)]))
    ties = [f"_tie{i}" for i in range(len(extra))]
    goals = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), share, cap, weights)
    all_words = Window.partitionBy(F.lit(0))
    goals = apportion(
        goals.withColumn("seats", F.round(F.sum("target").over(all_words) / block).cast("long")),
        [], "target", "seats", [F.col("source").asc_nulls_last()],
    ).withColumnRenamed("quota", "source_quota")
    goals = cut(goals.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)).cast("long")).withColumnRenamed("source", "of"))

    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    placed = sized.withColumn("h", F.md5(named.cast("binary"))).join(goals, F.col("source").eqNullSafe(F.col("of")))
    placed = placed.withColumn("shard", _number(named) % F.col("parts"))
    line = Window.partitionBy("source", "shard").orderBy("h", "doc_id", "size", *ties)
    placed = placed.withColumn("stop", F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, 0)))

    cells = placed.groupBy("source", "shard").agg(F.sum("size").alias("length"), F.first("source_quota").alias("source_quota"))
    # One row a shard: a source of 10 ** 12 words has a million of them in its window.
    cells = apportion(cells, ["source"], "length", "source_quota", [F.col("shard")])
    blocks = F.ceil(F.col("length") / block).cast("long")
    # A short last block can make a quota exceed what the cap allows.
    cells = cells.select(
        F.col("source").alias("of_"), F.col("shard").alias("shard_"), blocks.alias("n"), F.least(F.col("quota"), blocks * cap).alias("quota"),
    )
    cells = cells.withColumn("phase", F.when(F.col("n") > 0, _number(F.concat(F.lit(f"{seed}#"), F.col("shard_").cast("string"))) % F.col("n")).otherwise(0))
    placed = placed.join(cells, F.col("source").eqNullSafe(F.col("of_")) & (F.col("shard") == F.col("shard_")))
    taken = _taken_before(F.col("stop"), block) - _taken_before(F.col("stop") - F.col("size"), block)
    taken = F.when(F.col("n") > 0, taken).otherwise(0).cast("long")
    names = [F.col(t).alias(c) for t, c in zip(ties, extra, strict=True)]
    return placed.select("doc_id", "size", "source_size", "target", taken.alias("taken"), "source", "shard", "stop", *names)


def mix(
    docs: DataFrame,
    block: int = BLOCK,
    shard_words: int = SHARD_WORDS,
    share: float = SHARE,
    cap: int = CAP,
    weights: tuple[int, ...] = WEIGHTS,
    seed: str = SEED,
    tie: list[str] | None = None,
) -> DataFrame:
    """doc_id, size, source_size, target, taken (and the columns of tie) for each row of docs(doc_id, text, source).

    In each shard of a source the documents lie on a line of words in the order of a seeded hash of doc_id, cut into
    blocks. A quota of q of n blocks takes every block q // n times and q % n of them once more, evenly spaced from
    a seeded start. taken counts a document's words in those blocks, so it is at most cap times its size.

    Null texts have size 0 and are never taken; a null source is a source, the last; a null id hashes as the empty
    text; rows repeating an id are rows of their own, side by side; no rows give no rows. Reruns agree.
    """
    found = _placed(docs, block, shard_words, share, cap, weights, seed, tie)
    return found.select("doc_id", "size", "source_size", "target", "taken", *(tie or []))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents, in the columns of docs: what a shard takes goes to whole documents along its line.

    Every document appears as often as the shard's words are all taken. The words left over go to the first documents
    of the line, whose order is a seeded hash, up to the one whose middle lies beyond them; so none is cut, and a
    shard's words differ from its quota by half a document at most. Rows of which nothing is taken go.

    Rows are told apart by a hash of all columns; what equal rows take is given out together. Null and wordless texts
    have no words to take and go.
    """
    name, names = "_mix_row", docs.columns
    marked = docs.withColumn(name, F.xxhash64(*names))
    placed = cut(_placed(marked, tie=[name], **options))
    shards = placed.groupBy("source", "shard").agg(F.sum("taken").alias("all"), F.sum("size").alias("length"))
    shards = shards.where("length > 0").select(F.col("source").alias("of_"), F.col("shard").alias("shard_"), "all", "length")
    lined = placed.where("size > 0").join(shards, F.col("source").eqNullSafe(F.col("of_")) & (F.col("shard") == F.col("shard_")))
    over = F.col("stop") - F.col("size") / 2 <= F.col("all") % F.col("length")
    times = F.floor(F.col("all") / F.col("length")) + over.cast("int")
    taken = cut(lined.groupBy(name).agg(F.sum(times).cast("int").alias("_times"), F.count("*").alias("_n")))
    if not taken.where("_n > 1").isEmpty():
        marked = marked.dropDuplicates([name])
    rows = marked.join(taken.where("_times > 0").drop("_n"), name)
    return rows.select(*names, F.explode(F.sequence(F.lit(1), F.col("_times"))).alias("_time")).drop("_time")
