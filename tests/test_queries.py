"""Every registered query with a SQL twin agrees with it on the smallest tables."""

import glob

import duckdb
import pytest

from tests.conftest import SF
from webgrain import queries, queries_entities, queries_made, queries_recorded, queries_report  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        if glob.glob(f"{SF}/{t}.parquet"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def canon(df):
    df = df.reindex(sorted(df.columns), axis=1)
    for c in df.columns:
        df[c] = df[c].map(lambda v: "null" if v is None or v != v else str(round(float(v), 4)) if isinstance(v, float) else str(list(v)) if hasattr(v, "tolist") and getattr(v, "ndim", 0) else str(v)) if df[c].dtype == object or df[c].dtype.kind == "f" else df[c].astype(str)
    return sorted(map(tuple, df.astype(str).values.tolist()))


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_twin(name, spark, sql):
    ours, theirs = queries.QUERIES[name](spark, SF).toPandas(), sql.sql(queries.SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert len(ours) == len(theirs)
    integral = [c for c in ours.columns if ours[c].dtype.kind in "if" and theirs[c].dtype.kind in "if"]
    for c in integral:
        ours[c], theirs[c] = ours[c].astype(float), theirs[c].astype(float)
    assert canon(ours) == canon(theirs)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
