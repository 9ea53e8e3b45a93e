"""One small session for all tests."""

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ.setdefault("OMP_NUM_THREADS", "1")

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    connection = duckdb.connect()
    for p in sorted(Path(SMALL).glob("*.parquet")):
        connection.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return connection


def same_rows(df, relation) -> None:
    """Equal columns and rows, in any order."""
    a, b = df.toPandas(), relation.df()
    # whole numbers with nulls: pandas' own kind in one engine, floats in the other
    b = b.astype({c: "float64" for c in b.columns if str(b[c].dtype).startswith("Int") and b[c].isna().any()})
    assert sorted(a.columns) == sorted(b.columns)
    columns = sorted(a.columns)
    rows = lambda x: sorted(repr(tuple(str(v) if hasattr(v, "isoformat") else v for v in r)) for r in x[columns].itertuples(index=False, name=None))
    ra, rb = rows(a), rows(b)
    assert len(ra) == len(rb)
    assert not [(x, y) for x, y in zip(ra, rb, strict=True) if x != y][:3]
