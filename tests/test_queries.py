"""Every registered query of the feeds against its SQL, at the smallest scale."""

import math

import pytest

from tests.conftest import DATA
from tidemark.operators import asof
from tidemark.plans import audits, catalog, reports  # noqa: F401


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return str(v) if type(v).__name__ in ("date", "datetime") else v


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    cur = duck.execute(catalog.ORACLE_SQL[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    want = sorted((tuple(norm(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=repr)
    assert got == want


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and catalog.FLAGSHIP in e.queries()


@pytest.mark.parametrize("name", ["glft_constants", "glft_matrix", "poisson_intensity", "glft_quotes"])
def test_parameter_queries_run_over_all_of_part(spark, name):
    assert catalog.QUERIES[name](spark, DATA).select("id").distinct().count() == spark.read.parquet(f"{DATA}/part.parquet").count() > 40


def test_forward_lookup_is_linear_in_a_block(spark):
    """100,000 rows of one day: a frame that reads the rest of the block for every row would take hours."""
    import time

    rows = spark.range(100_000).selectExpr("'S' as symbol", "id * 800 as ts_ms", "id as sequence", "cast(id as double) as mid")
    began = time.time()
    got = asof.asof_forward(rows.where("sequence % 2 = 1").select("symbol", "ts_ms"), rows.where("sequence % 2 = 0"), ["mid"])
    assert got.where("mid = ts_ms / 800 + 1").count() == 49_999 and got.where("mid is null").count() == 1
    assert time.time() - began < 60


def test_simulation_runs_over_all_of_part(spark):
    assert catalog.QUERIES["poisson_simulation"](spark, DATA).select("seed").distinct().count() == spark.read.parquet(f"{DATA}/part.parquet").count()


def test_replay_stream_has_both_feeds(spark):
    rows = catalog.QUERIES["replay_stream"](spark, DATA).collect()
    n = {k: sum(r.kind == k for r in rows) for k in ("book", "trade")}
    assert n == {"book": catalog.feeds.books(spark, DATA).count(), "trade": catalog.feeds.trades(spark, DATA).count()} and min(n.values()) > 0
    by = {}
    for r in sorted(rows, key=lambda r: (r.symbol, r.ts_ms, r.ms_seq)):
        by.setdefault((r.symbol, r.ts_ms), []).append(r)
    assert all([r.ms_seq for r in x] == list(range(len(x))) and [r.kind for r in x] == sorted((r.kind for r in x), reverse=True) for x in by.values())
