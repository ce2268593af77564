"""Percentiles by refined histograms against Spark's own."""

import math

import pytest
from pyspark.sql import functions as F

from wayfold.operators import percentiles
from wayfold.operators.percentiles import exact_percentiles

SHARES = {"p0": ("v", 0.0), "p10": ("v", 0.1), "p50": ("v", 0.5), "p95": ("v", 0.95), "p100": ("v", 1.0), "w50": ("w", 0.5)}


@pytest.mark.parametrize("buckets", [4096, 2, 7])
def test_equal_to_percentile(spark, monkeypatch, buckets):
    monkeypatch.setattr(percentiles, "BUCKETS", buckets)
    n = 400 if buckets < 10 else 6000
    h = F.pmod(F.xxhash64("id"), F.lit(10_000_019)).cast("double")
    v = F.when(F.col("id") % 4 == 0, F.lit(7.5)).when(F.col("id") % 4 == 1, h / 1e6).when(F.col("id") % 4 == 2, F.exp(h / 1e5) - 1e20).otherwise(-h)
    rows = spark.range(n).select((F.col("id") % 3).cast("int").alias("k"), F.when(F.col("id") % 5 == 0, F.lit(None)).otherwise(F.lit("x")).alias("j"), v.alias("v"), F.when(F.col("id") % 2 == 0, F.lit(None)).otherwise(h).alias("w"))
    extra = [(9, None, 1.0, None), (9, None, 1.0, None), (8, "one", -0.0, 2.0), (7, "inf", 1e308, 5e-324), (7, "inf", -1e308, 1e308), (7, "inf", 3.0, 0.0), (6, "none", None, None)]
    rows = rows.unionByName(spark.createDataFrame(extra, "k int, j string, v double, w double"))
    want = rows.groupBy("k", "j").agg(*[F.percentile(c, F.lit(q)).alias(name) for name, (c, q) in SHARES.items()])
    a, b = (sorted(map(tuple, x.select("k", "j", *SHARES).collect()), key=repr) for x in (exact_percentiles(rows, ["k", "j"], SHARES), want))
    assert len(a) == len(b) == 10
    for x, y in zip(a, b):
        assert x[:2] == y[:2] and all((p is None and q is None) or math.isclose(p, q, rel_tol=1e-12, abs_tol=1e-300) for p, q in zip(x[2:], y[2:]))
    nan = spark.createDataFrame([(1.0,), (float("nan"),), (3.0,), (None,)], "v double")
    assert exact_percentiles(nan, [], {"m": ("v", 0.5)}).collect() == [(2.0,)]
    assert exact_percentiles(nan.where("false"), [], {"m": ("v", 0.5)}).count() == 0
    monkeypatch.setattr(percentiles, "MAX_KEYS", 2)
    with pytest.raises(ValueError):
        exact_percentiles(rows, ["k"], {"m": ("v", 0.5)})


def test_no_task_gathers_a_key(spark):
    """With all rows in one key, a reducer reads buckets, not values."""
    rows = spark.range(0, 200_000, 1, 8).select(F.lit(1).alias("k"), F.rand(3).alias("v"))
    before = percentiles.BUCKETS
    counted = rows.groupBy("k", percentiles._bucket(F.col("v"), F.lit(0.0), F.lit(1.0)).alias("b")).count()
    assert counted.count() <= before
    got = exact_percentiles(rows, ["k"], {"m": ("v", 0.5)}).first()
    assert got.m == rows.agg(F.percentile("v", F.lit(0.5))).first()[0]
