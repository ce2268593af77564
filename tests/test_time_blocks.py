"""Synchronized errors by time blocks, file ids, and the order of first appearance."""

import random

import pytest

from wayfold.operators import metrics
from wayfold.sources import points as sources

POINTS = "obj_id string, seq long, lat double, lon double, t double, road_id string"


@pytest.mark.parametrize("block_s", [1.0, 7.0, 60.0, 1e6])
def test_blocks_equal_one_window(spark, block_s):
    rng = random.Random(3)
    rows, kept = [], []
    for obj in ("long", "short", "bare"):
        t = 0.0
        for k in range(300 if obj == "long" else 9):
            t += rng.choice([0.0, 0.5, 1.0, 40.0 if rng.random() < 0.1 else 1.0])  # equal times and gaps of many blocks
            row = (obj, k, rng.random(), rng.random(), t, None)
            rows.append(row)
            if obj != "bare" and 3 < k and rng.random() < 0.15 and not (kept and kept[-1][0] == obj and kept[-1][4] == t):
                kept.append(row)
    p, c = spark.createDataFrame(rows, POINTS), spark.createDataFrame(kept, POINTS)
    want = {(r.obj_id, r.seq): r.sed for r in metrics.synchronized_errors(p, c).collect()}
    got = {(r.obj_id, r.seq): r.sed for r in metrics.synchronized_errors(p, c, block_s=block_s).collect()}
    assert got == want and len(want) >= 300 and not any(k[0] == "bare" for k in want)


def test_file_ids(spark, tmp_path):
    for name in ("7.csv", "12.csv", "x1.csv", "3.txt", "٣.csv"):
        (tmp_path / name).write_text("latitude,longitude\n1,2\n")
    assert sorted((int(r.file_id), r.bytes) for r in sources.list_file_ids(spark, str(tmp_path)).collect()) == [(7, 23), (12, 23)]


def test_order_of_first_appearance(spark):
    rows = spark.createDataFrame([("b", "cr", 1.0, 5), ("a", "cr", float("nan"), 2), ("a", "x", 4.0, 9), ("b", "cr", 3.0, 1), (None, "cr", 2.0, 3)], "pipeline string, metric string, value double, n int")
    got = {(r.pipeline, r.metric): (r.place, r.mean) for r in metrics.contract_aggregate(rows, "n").collect()}
    assert got == {("b", "cr"): (0, 2.0), ("a", "cr"): (1, None), ("a", "x"): (1, 4.0), (None, "cr"): (2, 2.0)}
