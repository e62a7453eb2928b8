import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if hasattr(v, "asDict"):
        v = tuple(v)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql())))
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    own = sorted(repr(plain(r)) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    sql = entry.oracle_sql()[name]
    other = duck.sql(f"SELECT {', '.join(cols)} FROM ({sql})").fetchall()
    assert own == sorted(repr(plain(r)) for r in other)


def test_entry(spark):
    assert entry.entry(spark).count() == 3


def test_positional_ids_follow_the_key_and_equal_sql_beyond_five_digits(spark, tmp_path):
    import duckdb

    path = str(tmp_path / "customer.parquet")
    rows = spark.range(100_020).selectExpr("id * 7 + 3 AS c_custkey", "concat('c', id) AS c_name")
    rows.orderBy(F.desc("c_custkey")).repartition(3).write.parquet(path)  # files out of the key's order
    own = entry.queries()["a11_positional_ids"](spark, str(tmp_path)).collect()
    other = duckdb.sql(entry.oracle_sql()["a11_positional_ids"].replace("FROM customer", f"FROM '{path}/*.parquet'")).fetchall()
    assert sorted(map(tuple, own)) == sorted(other)
