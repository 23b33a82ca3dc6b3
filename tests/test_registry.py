"""Every registered SQL-checkable query agrees with its DuckDB twin (sf0.001), and the driver
entry point runs."""

import hashlib
import inspect
import math

import duckdb
import pytest

import __spark_entry__ as E
from pertinax.sources.tables import DRIVER_TABLES

SF = "/root/testdata/sf0.001"
ORACLES = E.oracle_sql()
# training-heavy queries are exercised by test_ml; keep a few rows-only ones here
ROWS_ONLY = ["m2_assemble", "s5_write_predictions", "s6_write_errors", "s8_convert_files",
             "d6_score_file", "d7_score_stream"]


#: Small sizes: the trainer has its own tests, the driver runs the registered sizes.
SIZES = {"forest": dict(numTrees=20, maxDepth=6), "gbt": dict(maxIter=15, maxDepth=4, stepSize=0.3),
         "boosted": {"maxIter": 15, "maxDepth": 4, "stepSize": 0.3, "columnShare": 0.8, "lambda": 1.0}}


def small(fn):
    """A model query at small sizes, any other as it is."""
    known = inspect.signature(fn).parameters
    if "sizes" in known:
        return lambda spark, sf: fn(spark, sf, sizes=SIZES)
    if "configurations" in known:
        return lambda spark, sf: fn(spark, sf, configurations=[shrunk(c) for c in known["configurations"].default])
    return fn


def shrunk(spec):
    from dataclasses import replace
    size = {"forest": {"numTrees": 8, "maxDepth": 5}, "boost": {"maxIter": 6, "maxDepth": 3}}.get(spec.kind, {})
    return replace(spec, params={**spec.params, **size}, members=[shrunk(m) for m in spec.members])


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def _digest(rows):
    return hashlib.sha1("\n".join(sorted(repr(r) for r in rows)).encode()).hexdigest()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in DRIVER_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(E.queries())
    assert len(E.queries()) >= 100


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, duck, name):
    sdf = small(E.queries()[name])(spark, SF)
    cols = sorted(sdf.columns)
    srows = [tuple(_norm(r[c]) for c in cols) for r in sdf.collect()]
    res = duck.execute(ORACLES[name])
    dcols = [d[0] for d in res.description]
    order = sorted(range(len(dcols)), key=lambda i: dcols[i])
    drows = [tuple(_norm(r[i]) for i in order) for r in res.fetchall()]
    assert cols == sorted(dcols)
    assert len(srows) == len(drows)
    assert _digest(srows) == _digest(drows)


def test_only_optional_queries_lack_an_oracle():
    lacking = set(E.queries()) - set(ORACLES)
    assert all(q == "pipeline" or (q.startswith("op") and q[2].isdigit()) for q in lacking)


def test_entry(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 4 and sorted(df.columns) == ["n", "pred", "real"]
