"""Every registered query of the library against its SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from tidemark.plans.registry import load

ALL = load()


def norm(v):
    if v is None or str(v) in ("NaT", "<NA>") or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "isoformat"):
        return str(v).replace(" 00:00:00", "")
    if hasattr(v, "tolist"):
        v = v.tolist()
    return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted((tuple(map(norm, r)) for r in frame.itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(ALL))
def test_query(name, spark, sf_dir, duck):
    run, sql = ALL[name]
    got = run(spark, sf_dir).toPandas()
    assert len(got.columns)
    if sql:
        assert rows(got) == rows(duck.execute(sql).df())
