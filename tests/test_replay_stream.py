"""Replay as a stream: what it brings, in which order, and a restart."""

import time

from wayfold.sources import points as sources


def test_stream_equals_replay_over_a_restart(spark, tmp_path):
    for name in ("1", "2"):
        rows = "\n".join(f"{k}.5,{'x' if k % 7 == 3 else k}" for k in range(27 if name == "1" else 9))  # some rows are bad, the clock beats on
        (tmp_path / f"{name}.csv").write_text(f"latitude,longitude\n{rows}\n")
    df = spark.read.option("header", True).option("pathGlobFilter", "*.csv").csv(str(tmp_path))
    want = sorted(map(tuple, sources.replay(df, "2020-01-01", 2.0).collect()))
    sources.stage_replay(df, str(tmp_path / "staged"), "2020-01-01", 2.0, rows_per_batch=4)
    assert sorted(r.batch for r in spark.read.parquet(str(tmp_path / "staged")).select("batch").distinct().collect()) == list(range(7))

    seen = []

    def keep(frame, number):
        seen.append((number, sorted(map(tuple, frame.collect()))))

    def run(until):
        q = sources.replay_stream(spark, str(tmp_path / "staged")).writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "c")).start()
        try:
            began = time.time()
            while not (seen and seen[-1][0] >= until) and time.time() - began < 120 and q.isActive:
                time.sleep(0.1)
        finally:
            q.stop()

    run(2)
    first = len(seen)
    run(8)
    once = dict(seen)  # a batch that was under way when the query stopped comes again, the same
    assert len(seen) > first and all(rows == once[number] for number, rows in seen)
    assert sorted(r for rows in once.values() for r in rows) == want
    times = [[r[4] for r in once[k]] for k in sorted(once) if once[k]]
    assert all(max(a) < min(b) for a, b in zip(times, times[1:])) and len(times) == 7
