"""Each mesh query that SQL can express, against DuckDB on the driver's smallest tables."""

import duckdb
import pandas as pd
import pytest

from meshlake.plans.queries import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list[str]:
    df = df[sorted(df.columns)]

    def plain(v):
        if v is None or v is pd.NaT or isinstance(v, float) and v != v:
            return None
        if isinstance(v, float):
            return float(f"{v:.9g}")
        return int(v) if hasattr(v, "__index__") and not isinstance(v, bool) else str(v)

    return sorted(repr([plain(v) for v in r]) for r in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, duck, name):
    assert rows(QUERIES[name](spark, DATA).toPandas()) == rows(duck.execute(ORACLE[name]).df())


@pytest.mark.parametrize("name", ["g4_cap_areas", "g6_multi_clip", "e5_flat_planes", "e10_weld", "l4_smooth_variants"])
def test_others_give_rows(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_partitioning_changes_nothing(spark):
    found = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        found.append(rows(QUERIES["g6_multi_clip"](spark, DATA).toPandas()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert found[0] == found[1]
