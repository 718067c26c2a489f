import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from spanlode.operators.hot_keys import exact_quantiles, key_figures
from tests.conftest import rows

PROBABILITIES = {"low": 0.0, "mid": 0.5, "high": 0.9}


def brute(values, p):
    ordered = sorted(values)
    return ordered[max(1, math.ceil(p * len(ordered))) - 1]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.integers(-70_000, 70_000)), min_size=1, max_size=60))
def test_quantiles_equal_brute_force(spark, pairs):
    counted = spark.createDataFrame([(k, v, 1) for k, v in pairs], "k string, v long, n long").groupBy("k", "v").sum("n").withColumnRenamed("sum(n)", "n")
    got = {(r.k, r.p): r.q for r in exact_quantiles(counted, [0.0, 0.3, 0.5, 1.0]).collect()}
    for key in {k for k, _ in pairs}:
        held = [v for k, v in pairs if k == key]
        for p in (0.0, 0.3, 0.5, 1.0):
            assert got[key, p] == brute(held, p)


def figures(spark, data, schema="name string, usage_id long, file_id long, lang string, start_line int, k string, v long, n int"):
    return key_figures(spark.createDataFrame(data, schema), "name", "usage_id", "start_line", {"file_id": "n_files", "lang": "n_langs"}, PROBABILITIES)


def test_hot_key_copies_nulls_and_clashing_columns(spark):
    data = [("hot", i, i % 50, "go", i % 997, "x", 1, 1) for i in range(3000)]
    data += data[:500]  # redelivered
    data += [("cold", 5000, 1, None, 7, "x", 1, 1), (None, 5001, None, "go", 3, "x", 1, 1), ("cold", None, 1, "go", 1, "x", 1, 1), ("bare", 5002, 2, "go", None, "x", 1, 1)]
    got = {r.name: r for r in figures(spark, data).collect()}
    hot = [i % 997 for i in range(3000)]
    assert (got["hot"].n_rows, got["hot"].n_files, got["hot"].n_langs) == (3000, 50, 1)
    assert [got["hot"][c] for c in PROBABILITIES] == [brute(hot, p) for p in PROBABILITIES.values()]
    assert (got["cold"].n_rows, got["cold"].n_langs, got["cold"].mid) == (1, 0, 7)
    assert (got[None].n_rows, got[None].n_files, got[None].high) == (1, 0, 3)
    assert (got["bare"].n_rows, got["bare"].mid) == (1, None)


def test_empty_table(spark):
    assert figures(spark, []).collect() == []


@pytest.mark.parametrize("far", [2**40, -(2**40)])
def test_wide_range(spark, far):
    counted = spark.createDataFrame([("a", far, 1), ("a", 0, 2)], "k string, v long, n long")
    assert rows(exact_quantiles(counted, [0.0, 1.0]), "p", "q") == [(0.0, min(far, 0)), (1.0, max(far, 0))]
