"""Adapters that read count frames, templates and backgrounds from tables, and the sparse frame cache.

Photons are (d, i, k): frame, pixel, positive count. Templates are (r, i, w). Every reader is a lazy DataFrame, so
filters on frames and pixels and the choice of columns reach the scan.
"""

from __future__ import annotations

import tempfile

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; local sessions without it get a temporary
    one, clusters without it an error."""
    context = spark.sparkContext
    known = spark.conf.get("spark.checkpoint.dir", None) or context._jsc.sc().getCheckpointDir().getOrElse(None)
    if not known:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        known = tempfile.mkdtemp(prefix="spark-checkpoints-")
        context.setCheckpointDir(known)
    return known


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder, so that a lost executor costs no more than what follows."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sparsify(frames: DataFrame, key: str, counts: str, scale: float | None = None) -> DataFrame:
    """Photons of dense frames (key, array of numbers); scale: counts are floor(|value| * scale)."""
    rows = frames.select(F.col(key).alias("d"), F.posexplode(counts).alias("i", "v"))
    k = F.floor(F.abs(F.col("v").cast("double")) * scale) if scale else F.col("v")
    return rows.select("d", "i", k.cast("int").alias("k")).where("k > 0")


def densify(photons: DataFrame, pixels: int, frames: DataFrame | None = None) -> DataFrame:
    """A row for every frame and pixel below pixels, k = 0 where no photon is; frames: also those without photons."""
    frames = (frames or photons).select("d").distinct()
    grid = frames.select("d", F.explode(F.sequence(F.lit(0), F.lit(pixels - 1))).alias("i"))
    return grid.join(photons.select("d", "i", "k"), ["d", "i"], "left").select("d", "i", F.coalesce("k", F.lit(0)).alias("k"))


def select_frames(frames: DataFrame, chosen: Column | DataFrame | None) -> DataFrame:
    """frames that a predicate or a table of ids d keeps; None keeps all."""
    if chosen is None:
        return frames
    return frames.join(chosen.select("d"), "d", "left_semi") if isinstance(chosen, DataFrame) else frames.where(chosen)


def write_cache(photons: DataFrame, path: str, width: int = 65_536) -> None:
    """Photons as Parquet in folders of width frames each, sorted by frame and pixel, so that a range of frames opens
    the folders that it meets. Folders are written by ranges of frames: as many tasks as the data need share them."""
    rows = photons.select("d", "i", "k", F.floor(F.col("d") / width).alias("bucket"))
    rows.repartitionByRange("d", "i").sortWithinPartitions("d", "i").write.mode("overwrite").partitionBy("bucket").parquet(path)
    photons.sparkSession.range(1).select(F.lit(width).alias("width")).write.mode("overwrite").parquet(f"{path}_width")


def read_cache(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """Photons of a cache; first and last bound the frames, and so the folders and row groups that are read."""
    width = spark.read.parquet(f"{path}_width").first()[0]
    rows = spark.read.parquet(path)
    if first is not None:
        rows = rows.where((F.col("bucket") >= first // width) & (F.col("d") >= first))
    if last is not None:
        rows = rows.where((F.col("bucket") <= last // width) & (F.col("d") <= last))
    return rows.select("d", "i", "k")


def find_cache(spark: SparkSession, paths: list[str]) -> DataFrame | None:
    """The photons of the one cache among paths (globs are allowed); none gives None, several are an error."""
    found = []
    for path in paths:
        try:
            found.append(spark.read.parquet(path))
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    if len(found) > 1:
        raise ValueError(f"{len(found)} caches where one was expected")
    return found[0].select("d", "i", "k") if found else None


def write_transposed(photons: DataFrame, path: str) -> None:
    """Photons by pixel: ranges of pixels to a file, sorted by pixel and frame."""
    photons.select("i", "d", "k").repartitionByRange("i", "d").sortWithinPartitions("i", "d").write.mode("overwrite").parquet(path)


def ranked(frames: DataFrame, rank: int, of: int) -> DataFrame:
    """The frames that worker `rank` of `of` loads: an even share of ids by their place in order, in two levels."""
    from tomolake.operators.report import running_offsets

    placed = running_offsets(frames.select("d").distinct().withColumn("one", F.lit(1)), "d", "one")
    total = placed.agg(F.coalesce(F.sum("one"), F.lit(0)).alias("total"))
    share = F.floor(F.col("start") * of / F.col("total"))
    mine = placed.crossJoin(F.broadcast(total)).where(share == rank).select("d")
    return frames.join(mine, "d", "left_semi")


def cache_keys(masks: DataFrame, by: list[str]) -> DataFrame:
    """by, n, name of each mask in masks(by, i): its number of pixels, and a name from its pixels, not only their number."""
    sums = masks.groupBy(*by).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("i").cast("decimal(38,0)")), F.lit(0)).alias("h"))
    low = "pmod(h, 18446744073709551616BD)"
    halves = [F.expr(f"lpad(hex(cast({x} as long)), 8, '0')") for x in (f"floor({low} / 4294967296BD)", f"pmod({low}, 4294967296BD)")]
    return sums.select(*by, "n", F.concat_ws("-", F.col("n").cast("string"), F.lower(F.concat(*halves))).alias("name"))


def cache_key(mask: DataFrame) -> str:
    """A name for a mask's cache from its pixels, not only their number."""
    return cache_keys(mask, []).first()["name"]


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows as often."""
    names = a.columns
    return a.exceptAll(b.select(names)).isEmpty() and b.select(names).exceptAll(a).isEmpty()


def embedding_photons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sparsify(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", 20)


def embedding_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select(F.col("label").alias("r"), F.posexplode("embedding").alias("i", "v"))
    return rows.groupBy("r", "i").agg(F.avg(F.abs(F.col("v").cast("double"))).alias("w"))


def lineitem_photons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("d"), (F.col("l_partkey") % 16).cast("int").alias("i"))
    return rows.groupBy("d", "i").agg(F.count("*").cast("int").alias("k"))


def lineitem_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("r"), (F.col("l_partkey") % 16).cast("int").alias("i"), "l_quantity")
    return rows.groupBy("r", "i").agg(F.avg("l_quantity").alias("w"))


def pixel_weights(pixels: int, spark: SparkSession) -> DataFrame:
    """(i, c): a correction that falls from 1 by 1/128 a pixel."""
    return spark.range(pixels).select(F.col("id").cast("int").alias("i"), (1 - F.col("id") / 128.0).alias("c"))


def background_dictionary(spark: SparkSession, sf_dir: str, pixels: int = 16) -> DataFrame:
    """(b, i, v): a background per nation."""
    nations = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("b"))
    return nations.select("b", F.explode(F.sequence(F.lit(0), F.lit(pixels - 1))).alias("i")).select("b", "i", ((F.col("b") * 7 + F.col("i") * 3) % 11 / 10.0).alias("v"))


def supplier_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(d, bg_id, bg_weight): the background of each supplier's frame and its weight."""
    rows = read(spark, sf_dir, "supplier")
    return rows.select(F.col("s_suppkey").alias("d"), F.col("s_nationkey").alias("bg_id"), (0.5 + F.abs("s_acctbal") / 10000.0).alias("bg_weight"))
