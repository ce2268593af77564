"""Sinks of a stream: nothing twice, nothing lost, also when a micro-batch is run again."""

import json

from wayfold.sources import sinks
from wayfold.streaming.online_stream import OUT

RECORDS = "obj_id string, cr double"


def test_a_repeated_batch_is_written_once(spark, tmp_path):
    path, here = str(tmp_path / "out"), str(tmp_path / "in")
    frame = lambda a, b: spark.createDataFrame([(f"o{k}", float("nan") if k == 3 else k / 2) for k in range(a, b)], RECORDS)

    def run():
        stream = spark.readStream.schema(RECORDS).parquet(here)
        sinks.stream_metrics_json(stream, path, str(tmp_path / "c"), available_now=True).awaitTermination(120)
        return sorted(json.loads(r.value)["obj_id"] for r in spark.read.text(path).collect())

    frame(0, 5).write.parquet(here)
    assert run() == [f"o{k}" for k in range(5)]
    sinks.put_batch(frame(0, 5), 0, path)  # the first one again, as after a failure between writing and committing
    frame(5, 9).write.mode("append").parquet(here)
    assert run() == [f"o{k}" for k in range(9)]
    assert {"obj_id": "o3"} in [json.loads(r.value) for r in spark.read.text(path).collect()]


def test_bundle_of_a_stream(spark, tmp_path):
    rows = [(o, k, "stop" if k % 2 else "move", 0.0, 1.0, 3 + k, [(0.0, 1.0, 2.0)] * (1 + k), 24 * (1 + k)) for o in "ab" for k in range(4)]
    for half in (0, 1):
        spark.createDataFrame(rows[half::2], OUT).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(OUT).parquet(str(tmp_path / "in"))
        sinks.stream_bundle(stream, str(tmp_path / "out"), str(tmp_path / "c"), {"eps": 15}, available_now=True).awaitTermination(120)
    got = spark.read.schema("part string, value string, batch int").json(str(tmp_path / "out")).collect()
    heads = [json.loads(r.value) for r in got if r.part == "header"]
    assert heads == [{"schema": sinks.BUNDLE_SCHEMA, "run_config": {"eps": "15"}}] * 2 and {r.batch for r in got} == {0, 1}
    total = {o: [sum(json.loads(r.value)[c] for r in got if r.part == "per_file" and json.loads(r.value)["obj_id"] == o) for c in ("segments", "n_raw_points", "stored_points", "encoded_bytes")] for o in "ab"}
    assert total == dict.fromkeys("ab", [4, 18, 10, 240])
