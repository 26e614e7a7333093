"""The search finds what a full one finds, in the passes that its rungs take."""

from __future__ import annotations

import numpy as np

from modalis.operators import training as T
from modalis.operators import tuning


def table_of(spark, n, seed):
    rng = np.random.default_rng(seed)
    x = rng.uniform(-1, 1, (n, 2))
    y = np.sin(3 * x[:, 0]) * x[:, 1]
    df = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y, strict=True)], "a double, b double, y double").repartition(4)
    return T.samples(df, ["a", "b"], ["y"])


def make(s):
    return T.Dense((2, s["hidden"], 1)), s["rate"]


def jobs(spark, f):
    """Stages that read all rows, counted by what an accumulator of the pass sees."""
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("counted", "counted")
    try:
        out = f()
        return out, len(tracker.getJobIdsForGroup("counted"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_a_rung_trains_all_its_trials_in_one_pass_a_step(spark):
    rows, valid = table_of(spark, 300, 1), table_of(spark, 100, 2)
    s = tuning.Search({"hidden": [1, 8], "rate": tuning.Real(1e-3, 0.5, log=True)}, make, trials=8, rounds=1, rungs=2, steps=3)
    best, n = jobs(spark, lambda: s.run(rows, valid))
    assert s.passes == 3 + 1 + 6 + 1 and s.passes <= n <= 3 * s.passes + 2  # a pass is a job, and its stages ahead
    assert sorted(t.steps for t in s.done) == [3] * 4 + [9] * 4
    alone = T.adam(rows, best.network, 9, T.Adam(best.settings["rate"]), seed=0)
    assert np.allclose(alone.theta, best.theta, atol=1e-9)  # side by side is as alone


def test_the_search_finds_what_a_full_search_finds(spark):
    rows, valid = table_of(spark, 300, 3), table_of(spark, 100, 4)
    space = {"hidden": [1, 8], "rate": [0.0001, 0.001, 0.05]}
    s = tuning.Search(space, make, trials=8, rounds=2, rungs=2, steps=8, seed=1)
    best = s.run(rows, valid)
    full = {}
    for h in space["hidden"]:
        for rate in space["rate"]:
            net, _ = make({"hidden": h, "rate": rate})
            t = T.adam(rows, net, best.steps, T.Adam(rate), seed=1)
            full[h, rate] = T.evaluated(valid, [(net, t.theta)])[0][0]
    assert (best.settings["hidden"], best.settings["rate"]) == min(full, key=full.get)
    again = tuning.Search(space, make, trials=8, rounds=2, rungs=2, steps=8, seed=1).run(rows, valid)
    assert again.settings == best.settings and np.allclose(again.theta, best.theta)


def test_proposals_gather_where_trials_are_good():
    s = tuning.Search({"rate": tuning.Real(0.0, 1.0), "kind": ["a", "b", "c"]}, make)
    rng = np.random.default_rng(5)
    for _ in range(60):
        x = {"rate": float(rng.uniform()), "kind": str(rng.choice(["a", "b", "c"]))}
        s.done.append(tuning.Trial(x, None, None, None, abs(x["rate"] - 0.8) + (x["kind"] != "b"), 1))
    got = [s.propose(rng) for _ in range(50)]
    assert abs(np.mean([g["rate"] for g in got]) - 0.8) < 0.12 and sum(g["kind"] == "b" for g in got) > 40
    assert all(0 <= g["rate"] <= 1 for g in got)
