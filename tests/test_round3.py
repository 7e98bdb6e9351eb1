"""Cases of the third round's findings."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tomolake import queries
from tomolake.sources import tables
from tomolake.sources.versions import Versioned
from tomolake.streaming import logs


def test_many_partitions_are_one_scan(spark, tmp_path):
    """Partitions put together are read together, and replaced one by one."""
    store = Versioned(spark, str(tmp_path / "t"))
    store.put_each(spark.range(4000).selectExpr("nullif(cast(id % 1000 as int), 999) AS iteration", "id AS v"), "iteration")
    assert len(store.manifest()[1]) == 1 and store.read().count() == 4000
    assert store.read()._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert sorted(r["v"] for r in store.read(iteration=7).collect()) == [7, 1007, 2007, 3007]
    assert store.read(iteration=2000) is None and store.read(iteration=None).count() == 4
    store.put(spark.range(1).selectExpr("id AS v"), iteration=7)
    store.put_each(spark.range(2).selectExpr("nullif(cast(id as int), 1) AS iteration", "-id - 1 AS v"), "iteration")
    found = {(r["iteration"], r["v"]) for r in store.read().collect()}
    assert len(found) == 4000 - 3 * 4 + 3 and {(7, 0), (0, -1), (None, -2)} <= found and not {(7, 1007), (0, 1000), (None, 999)} & found
    assert store.read(iteration=7).count() == 1 and store.read(1, iteration=7).count() == 4
    whole = spark.range(3).selectExpr("cast(id as int) AS iteration", "id AS v")
    other = Versioned(spark, str(tmp_path / "u"))
    other.put_each(whole, "iteration")
    other.put_each(whole, "iteration")
    assert len(other.manifest()[1]) == 1 and other.read().count() == 3


def as_sql_says(spark, sf: str, name: str) -> None:
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{sf}/part.parquet'")
    other = con.sql(queries.SQL[name])
    mine = queries.QUERIES[name](spark, sf).select(*other.columns).collect()
    assert sorted(map(repr, map(tuple, mine))) == sorted(map(repr, other.fetchall()))


@pytest.mark.parametrize("sizes", ["id % 3", "nullif(id % 8 - 4, 0)"])
def test_equal_masks_share_a_name(spark, tmp_path, sizes):
    """Masks of the same pixels, and of other remainders or none, have names of their own all the same."""
    rows = spark.range(3 * 256).selectExpr(f"cast({sizes} as int) AS p_size", "cast(floor(id / 3) as long) AS p_partkey")
    rows.unionByName(spark.sql("SELECT 5 AS p_size, CAST(NULL AS bigint) AS p_partkey")).toPandas().astype({"p_size": "Int32", "p_partkey": "Int64"}).to_parquet(tmp_path / "part.parquet")
    as_sql_says(spark, str(tmp_path), "cache_names")


def test_names_of_caches_stay(spark):
    """The name of one mask, as the caches written so far have it."""
    for mask in (spark.range(3), spark.range(1000), spark.range(0)):
        mask = mask.toDF("i")
        total = sum(int(r[0]) for r in mask.selectExpr("xxhash64(i)").collect())
        assert tables.cache_key(mask) == f"{mask.count()}-{total & (1 << 64) - 1:016x}"


def test_all_frames_under_all_templates(spark, sf):
    """predicted_frames_all has a row for each frame, template and pixel; the likely ones are a part of them."""
    every, likely = (queries.QUERIES[n](spark, sf).select("d", "r", "i") for n in ("predicted_frames_all", "predicted_frames_likely"))
    b = queries.Lineitems(spark, sf)
    assert every.count() == b.frames.select("d").distinct().count() * b.templates.select("r", "i").distinct().count() > likely.count()
    assert likely.exceptAll(every).isEmpty()


def test_all_photons_by_pixel(spark, sf):
    """transposed_all has every photon, not only sums of them."""
    photons = queries.Embeddings(spark, sf).photons.select("i", "d", "k")
    assert tables.same_rows(queries.QUERIES["transposed_all"](spark, sf).select("i", "d", "k"), photons)


def test_a_log_is_dealt_once(spark, tmp_path):
    """Its marks are not gone through again for every file."""
    gone = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            gone.add(b.num_rows)
            yield b

    marks = spark.range(3000).selectExpr("id % 7 AS pid", "'work' AS msg", "cast(id as double) AS t", "if(id % 2 = 0, 'start', 'stop') AS kind")
    logs.in_order(marks.mapInArrow(count, marks.schema), str(tmp_path / "in"), 12)
    assert gone.value <= 4 * 3000
    spans = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "in")).groupBy(F.input_file_name()).agg(F.min("t"), F.max("t"), F.count("*")).drop("input_file_name()").collect())
    assert len(spans) == 12 and sum(n for _, _, n in spans) == 3000 and all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))
