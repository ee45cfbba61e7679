"""Every registered query against its SQL; queries without SQL against a plain computation."""

import math

import pytest
from conftest import DATA

from quarry.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_oracle(name, same):
    same(catalog.queries()[name], catalog.oracle_sql()[name])


def test_npms_scores(spark):
    rows = {r.p_partkey: r.npms for r in catalog.queries()["rk_npms"](spark, DATA).collect()}
    prices = {r.p_partkey: r.p_retailprice for r in spark.read.parquet(f"{DATA}/part.parquet").collect()}
    lo, hi, mean = min(prices.values()), max(prices.values()), sum(prices.values()) / len(prices)
    m = (mean - lo) / (hi - lo)
    for k, v in prices.items():
        x, a, b = (v - lo) / (hi - lo), 0.0, 1.0
        for _ in range(64):
            mid = (a + b) / 2
            a, b = (mid, b) if 3 * m * mid * (1 - mid) + mid**3 < x else (a, mid)
        t = (a + b) / 2
        assert math.isclose(rows[k], 2.25 * t * (1 - t) + t**3, abs_tol=2e-6)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns[:2] == ["repo", "path"]
    assert set(e.oracle_sql()) <= set(e.queries())
