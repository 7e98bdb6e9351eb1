"""Every query against the SQL that says the same."""

import duckdb
import pytest

from tomolake import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_sql(spark, sf, duck, name):
    mine, other = queries.QUERIES[name](spark, sf).toPandas(), duck.execute(queries.SQL[name]).df()
    names = sorted(mine.columns)
    assert names == sorted(other.columns)
    mine, other = (x[names].sort_values(names).reset_index(drop=True) for x in (mine, other))
    assert len(mine) == len(other) > 0
    for c in names:
        assert ((mine[c] == other[c]) | (mine[c].isna() & other[c].isna())).all(), c


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_has_rows(spark, sf, name):
    assert queries.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_whole_tables(spark, sf):
    """These queries leave out no frame, pixel or order."""
    q = queries.QUERIES
    last = spark.read.parquet(f"{sf}/orders.parquet").agg({"o_orderkey": "max"}).first()[0]
    assert q["class_changes"](spark, sf).agg({"iteration": "max"}).first()[0] == last // 500
    frames = queries.Lineitems(spark, sf).frames.select("d").distinct().count()
    assert q["predicted_frames"](spark, sf).select("d").distinct().count() == frames > 5
    photons = queries.Embeddings(spark, sf).photons
    assert q["transposed"](spark, sf).count() == photons.count() > photons.where("i < 8").count()
