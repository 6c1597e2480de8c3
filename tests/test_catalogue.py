"""Each registered query against its SQL, over the smallest tables."""

import os

import duckdb
import pytest

from glyphlake.plans.catalogue import ORACLE, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows_of(frame):
    frame = frame[sorted(frame.columns)]
    frame = frame.map(lambda v: round(v, 6) if isinstance(v, float) else v)
    return list(frame.columns), sorted(map(str, frame.astype(str).values.tolist()))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    out = QUERIES[name](spark, sf_dir).toPandas()
    assert len(out)
    if name in ORACLE:
        assert rows_of(out) == rows_of(duck.execute(ORACLE[name]).fetchdf())


def test_names():
    assert set(ORACLE) <= set(QUERIES) and len(QUERIES) >= 45 and os.path.exists("__spark_entry__.py")
