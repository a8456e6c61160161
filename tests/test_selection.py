"""Exact selection against sorting: skewed groups, ties, one group of all rows, odd values."""

import math
import random

import pytest
from pyspark.sql import functions as F

from nightloom.operators import selection
from nightloom.operators.selection import GATHERED, select_mad, select_median, select_rank


def by_key(rows):
    out = {}
    for k, v in rows:
        if v is not None:
            out.setdefault(k, []).append(v)
    return out


def upper(v):
    return sorted(v, key=lambda x: (math.isnan(x), x))[len(v) // 2]


def skewed(n=60_000):
    rnd = random.Random(7)
    rows = [("hot", rnd.gauss(0, 1)) for _ in range(n)] + [("tied", rnd.choice([1.0, 2.0])) for _ in range(n // 3)]
    rows += [("steep", math.exp(rnd.gauss(0, 9))) for _ in range(n // 4)] + [("few", float(i)) for i in range(4)] + [("one", -3.0)]
    rows += [("mostly", rnd.choice([5.0] * 9 + [rnd.random()])) for _ in range(n // 4)]
    return rows + [(None, float(i % 3)) for i in range(10)] + [("nulls", None), ("hot", None)]


def test_medians_equal_the_sorted_element(spark):
    rows = skewed()
    got = {r["k"]: r for r in select_rank(spark.createDataFrame(rows, "k string, v double").repartition(7), ["k"], "v", "m", gathered=500).collect()}
    want = by_key(rows)
    assert set(got) == set(want)
    for k, values in want.items():
        assert got[k]["m"] == upper(values) and got[k]["n"] == len(values), k
    assert got["hot"]["rounds"] >= 1 and got["few"]["rounds"] == 0


@pytest.mark.parametrize("share", [0.0, 0.013, 0.5, 0.999, 1.0])
def test_any_rank(spark, share):
    rnd = random.Random(3)
    values = [rnd.choice([rnd.randrange(50), rnd.randrange(10**12)]) for _ in range(30_000)]
    df = spark.createDataFrame([(v,) for v in values], "v long").repartition(5)
    k = max(1, round(share * len(values)))
    got = select_rank(df, [], "v", "m", rank=lambda n: F.greatest(F.lit(1), F.round(n * share)), gathered=100).collect()
    assert [r["m"] for r in got] == [sorted(values)[k - 1]]


def test_nan_is_the_largest(spark):
    values = [float("nan")] * 4000 + [float("inf")] * 300 + [float(i) for i in range(3000)] + [-float("inf")] * 100
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(3)
    for share in (0.3, 0.44, 0.9):
        k = int(share * len(values))
        got = select_rank(df, [], "v", "m", rank=lambda n, k=k: F.lit(k), gathered=64).collect()[0]["m"]
        want = sorted(values, key=lambda x: (math.isnan(x), x))[k - 1]
        assert got == want or (math.isnan(got) and math.isnan(want))


@pytest.mark.parametrize("rows", [[], [("a", None)], [("a", 1.0)], [("a", 2.0)] * 9])
def test_few_rows(spark, rows):
    got = select_median(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", "v").collect()
    assert {r["k"]: r["v"] for r in got} == {k: upper(v) for k, v in by_key(rows).items()}


def test_mad(spark):
    rows = [r for r in skewed(9000) if r[0] is not None]
    got = {r["k"]: r for r in select_mad(spark.createDataFrame(rows, "k string, v double").repartition(4), ["k"], "v", "m", "s").collect()}
    for k, values in by_key(rows).items():
        m = upper(values)
        assert got[k]["m"] == m and math.isclose(got[k]["s"], 1.4826 * upper([abs(v - m) for v in values]), rel_tol=1e-12)


def test_a_sketch_that_misses_does_no_harm(spark, monkeypatch):
    """Quantiles of a far lower part of the values: counting finds the rank all the same."""
    monkeypatch.setattr(selection, "_sketch", lambda v: F.percentile_approx(v, [i / selection.GRID / 3 for i in range(selection.GRID + 1)], 4000))
    values = [((i * 7919) % 20_011) / 7 for i in range(20_011)]
    got = select_rank(spark.createDataFrame([(v,) for v in values], "v double").repartition(3), [], "v", "m", gathered=3000).collect()
    assert got[0]["m"] == upper(values)


def test_a_hot_group_is_dealt_to_many_tasks(spark):
    """Rows of one group meet its facts by a share, too; nothing sorts or gathers more than GATHERED values of a group."""
    df = spark.range(400_000).select(F.lit("all").alias("k"), ((F.col("id") * 48271) % 400_009).cast("double").alias("v"))
    out = select_rank(df, ["k"], "v", "m")
    assert out.collect()[0]["m"] == sorted((i * 48271) % 400_009 for i in range(400_000))[200_000]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan
    assert GATHERED < 400_000 / 50
