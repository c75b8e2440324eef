"""Every relational query against its SQL in DuckDB."""

import math
import os
from decimal import Decimal

import duckdb
import pytest

from almanac.plans import queries as plans

SF = os.environ.get("ALMANAC_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def _plain(v):
    if isinstance(v, (float, Decimal)):
        return None if math.isnan(v) else round(float(v), 6)
    return v


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    df = plans.queries()[name](spark, SF)
    names = sorted(df.columns)
    got = sorted(repr([_plain(r[c]) for c in names]) for r in df.collect())
    found = con.execute(plans.oracle_sql()[name])
    order = [d[0] for d in found.description]
    assert sorted(order) == names
    want = sorted(repr([_plain(dict(zip(order, r))[c]) for c in names]) for r in found.fetchall())
    assert got == want


def test_greedy_merge_equals_the_loop(spark):
    import random

    from almanac.operators.resolution import greedy_merge

    r = random.Random(3)
    pairs = list({(a, b): (a, b, r.choice((0.8, 0.9, 1.0))) for a, b in (sorted(r.sample(range(30), 2)) for _ in range(60))}.values())
    gone, want = set(), set()
    for a, b, _ in sorted(pairs, key=lambda x: (-x[2], x[0], x[1])):
        if a not in gone and b not in gone:
            gone.add(b)
            want.add((a, b))
    assert {tuple(x) for x in greedy_merge(spark.createDataFrame(pairs, "a long, b long, score double")).collect()} == want
    assert greedy_merge(spark.createDataFrame([], "a long, b long, score double")).count() == 0
