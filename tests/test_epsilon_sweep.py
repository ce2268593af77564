"""The sweep of epsilons: its errors against the window over both sides, and the work it does."""

import random

from wayfold.operators import experiments, metrics, moves
from wayfold.plans import registry


def test_errors_equal_those_of_the_timeline(spark):
    rng, rows = random.Random(6), []
    for obj, n in (("a", 90), ("b", 1), ("c", 2), (None, 5)):
        y, x = 48.0, 2.0
        for k in range(n):
            y, x = y + rng.gauss(0, 2e-4), x + rng.gauss(0, 2e-4)
            rows.append((obj, k, y, x, 5.0 * k + (1000.0 * (k == 7) - 200.0 * (k == 40)), None))  # times that do not follow the order
    p = spark.createDataFrame(rows, "obj_id string, seq long, lat double, lon double, t double, road_id string")
    p = p.fillna("nobody", ["obj_id"])
    got = {r.eps: r for r in experiments.epsilon_sweep(p, (5, 40)).collect()}
    assert sorted(got) == [5.0, 40.0]
    for eps, r in got.items():
        kept = moves.line_simplify(p, eps=eps)
        sed = sorted(e.sed for e in metrics.synchronized_errors(p, kept).collect())
        at = 0.95 * (len(sed) - 1)
        p95 = sed[int(at)] + (at - int(at)) * (sed[min(len(sed) - 1, int(at) + 1)] - sed[int(at)])
        assert (r.n_points, r.kept, r.cr) == (len(sed), kept.count(), len(sed) / kept.count())
        assert abs(r.max_sed - sed[-1]) < 1e-6 and abs(r.mean_sed - sum(sed) / len(sed)) < 1e-6 and abs(r.p95_sed - p95) < 1e-6
    assert experiments.epsilon_sweep(p.where("false"), (5, 40)).collect() == []


def test_objects_are_gone_over_once_for_all_epsilons(spark):
    """The result is made: neither reading it nor choosing from it runs the kernels again."""
    sweep = experiments.epsilon_sweep(registry.from_events(spark, "/root/testdata/sf0.001"), registry.SWEEP)
    best = experiments.select_epsilon_against(sweep, registry.BASELINE_EPS)
    for df in (sweep, best):
        plan = df._jdf.queryExecution().toString()
        assert "FlatMapGroupsInArrow" not in plan and "Window" not in plan
