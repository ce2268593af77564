"""Means whose last digits decide a rounded result: rows are added up in their order, however they are dealt to tasks."""

import duckdb
import pytest
from pyspark.sql import functions as F

from wayfold.operators import metrics
from wayfold.plans import registry


@pytest.fixture(scope="module")
def split(tmp_path_factory):
    """Six copies of ``events`` with the same users, in row groups that Spark reads in several tasks."""
    d = tmp_path_factory.mktemp("split")
    duckdb.sql(f"COPY (SELECT event_id + r * 10000 AS event_id, ts, user_id, event_type, value, props FROM range(6) t(r), '/root/testdata/sf0.01/events.parquet' ORDER BY r, event_id) TO '{d}/events.parquet' (FORMAT parquet, ROW_GROUP_SIZE 4096)")
    return str(d)


@pytest.mark.parametrize("name", ["e17_latency", "e24_ranked_deltas"])
def test_rows_dealt_to_many_tasks(spark, split, name):
    con = duckdb.connect()
    con.execute(f"SET threads = 1; CREATE VIEW events AS SELECT * FROM '{split}/events.parquet'")  # with more threads DuckDB's own sums differ from run to run
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in (20_000, 100_000, 128 << 20):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", 1000)
            got = registry.QUERIES[name](spark, split)
            want = con.execute(registry.ORACLES[name]).df()[got.columns]
            assert sorted(map(tuple, got.collect())) == sorted(want.itertuples(index=False, name=None))
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_nulls_and_keys_without_values(spark):
    rows = spark.createDataFrame([("a", 2, 0.1), ("a", 1, None), ("a", 3, 0.2), ("b", 1, None), (None, 1, 4.0)], "k string, o int, v double")
    got = {r.k: r["mean"] for r in metrics.ordered_means(rows, ["k"], {"mean": F.col("v")}, ["o"]).collect()}
    assert got == {"a": (0.1 + 0.2) / 2, "b": None, None: 4.0}
    stats = metrics.latency_stats(rows, "v", ("k",), ["o"])
    assert stats.columns == metrics.latency_stats(rows, "v", ("k",)).columns
