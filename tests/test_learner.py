"""Scheduling rules case by case, and invariants of the operators without SQL."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from lernspur.functions import scheduler as S
from lernspur.operators import evaluation, learner, matching, trajectory
from lernspur.operators.ranking import running_sums
from lernspur.plans import trajectory as plans

NOW = datetime.datetime(2026, 5, 19, 12)


def state(spark, status="untouched", ease=1.3, interval=0.0, due=None, streak=0, tries=0, passes=0):
    row = [(status, ease, interval, due, streak, tries, passes, None)]
    return spark.createDataFrame(row, S.STATE[7:-1].replace(":", " ")).select(F.struct("*").alias("s"))


def after(df, passed, **kw):
    return df.select((S.apply_pass(F.col("s"), F.lit(NOW), **kw) if passed else S.apply_fail(F.col("s"), F.lit(NOW))).alias("s")).select("s.*").first()


def test_first_pass_starts_learning(spark):
    r = after(state(spark), True)
    assert (r.status, r.consecutive_passes, r.interval_days, r.next_review_at, r.total_attempts, r.total_passes) == ("learning", 1, 0.0, NOW, 1, 1)


def test_second_pass_in_session_goes_to_review(spark):
    r = after(state(spark, "learning", streak=1), True)
    assert (r.status, r.interval_days, r.next_review_at) == ("reviewing", 1.0, NOW + datetime.timedelta(days=1))
    r = after(state(spark, "learning", streak=1), True, in_session=False)
    assert (r.status, r.consecutive_passes) == ("learning", 2)


@pytest.mark.parametrize(("interval", "streak", "want"), [(1.0, 2, "reviewing"), (5.5, 2, "mastered"), (5.5, 1, "reviewing")])
def test_review_pass_grows_interval_with_the_new_ease(spark, interval, streak, want):
    r = after(state(spark, "reviewing", 1.3, interval, NOW, streak), True)
    assert r.status == want and r.ease == pytest.approx(1.4) and r.interval_days == pytest.approx(max(1.0, interval * 1.4))


def test_fails(spark):
    assert after(state(spark), False).status == "untouched"
    r = after(state(spark, "mastered", 2.0, 10.0, NOW, 4), False)
    assert (r.status, r.consecutive_passes, r.next_review_at) == ("reviewing", 0, NOW + datetime.timedelta(days=3)) and r.ease == pytest.approx(1.8)
    assert after(state(spark, "reviewing", 1.3, 1.0, NOW), False).status == "learning"
    assert after(state(spark, "mastered", 2.0, 0.0, NOW), False).next_review_at == NOW + datetime.timedelta(days=1)


def test_ease_stays_in_bounds(spark):
    assert after(state(spark, "reviewing", 2.5, 1.0), True).ease == 2.5
    assert after(state(spark, "learning", 0.2), False).ease == pytest.approx(0.13)


def test_fold_does_not_depend_on_row_order(spark):
    rows = [(i, i % 3, i % 4, NOW + datetime.timedelta(hours=i), i % 5 != 0) for i in range(300)]
    schema = "event_id long, user_id long, vocab_id long, submitted_at timestamp, passed boolean"
    a = learner.mastery_fold(spark.createDataFrame(rows, schema)).collect()
    b = learner.mastery_fold(spark.createDataFrame(rows[::-1], schema).repartition(7)).collect()
    assert sorted(map(str, a)) == sorted(map(str, b))


def test_mirror_twice_is_identity(spark):
    order, signs = trajectory.body_mirror()
    df = spark.createDataFrame([(1, [[float(i) for i in range(100)]])], "clip long, traj array<array<double>>")
    once = trajectory.mirror(F.col("traj"), order, signs)
    assert df.select(once.alias("traj")).select(trajectory.mirror(F.col("traj"), order, signs).alias("t")).first().t[0] == [float(i) for i in range(100)]
    with pytest.raises(ValueError):
        trajectory.body_mirror(7)


def test_dtw_against_plain_recursion(spark, sf_dir):
    x = plans.trajs(spark, sf_dir).limit(6).collect()
    t = plans.templates(spark, sf_dir).collect()
    got = {(r.clip, r.sign): r.score for r in matching.dtw_scores(plans.trajs(spark, sf_dir), plans.templates(spark, sf_dir)).collect()}
    for c in x:
        for m in t[:3]:
            a, mean, var = (np.array([[np.nan if v is None else v for v in row] for row in y], dtype=float) for y in (c.traj, m["mean"], m["var"]))
            cost = np.nanmean((a[:, None] - mean[None]) ** 2 / var[None], axis=2)
            best = np.full((9, 9), np.inf)
            best[0, 0] = 0
            for i in range(1, 9):
                for j in range(1, 9):
                    best[i, j] = cost[i - 1, j - 1] + min(best[i - 1, j], best[i, j - 1], best[i - 1, j - 1])
            assert got[c.clip, m.sign] == pytest.approx(best[8, 8] / 16)


def test_ema_of_a_key_beyond_a_million_rows(spark):
    n = 1_000_050
    df = spark.range(n).select(F.lit(1).alias("k"), F.col("id").alias("t"), F.when(F.col("id") % 3 > 0, F.col("id") % 7).alias("v"))
    got = trajectory.ema(df, "k", ["t"], "v").where(f"t >= {n - 60}").orderBy("t").collect()
    s, want = None, []
    for t in range(n - 400, n):
        v = t % 7 if t % 3 > 0 else None
        s = s if v is None else v if s is None else s + (v - s) * 0.4
        want.append(s)
    assert [r.smooth for r in got] == pytest.approx(want[-60:])


def test_ema_resets_after_misses_and_between_keys(spark):
    values = [1.0, *[None] * 8, 2.0, *[None] * 9, 3.0, 4.0]
    rows = [(k, t, v) for k in ("a", "b", None) for t, v in enumerate(values)]
    got = trajectory.ema(spark.createDataFrame(rows, "k string, t long, v double"), "k", ["t"], "v").collect()
    want = [*[1.0] * 9, *[1.4] * 9, None, 3.0, 3.4]
    assert {(r.k, r.t): r.smooth and round(r.smooth, 9) for r in got} == {(k, t): w for k in ("a", "b", None) for t, w in enumerate(want)}


def test_refined_temperature_is_the_bounded_minimum(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(400, 4))
    p = np.exp(x / 0.25) / np.exp(x / 0.25).sum(axis=1, keepdims=True)
    y = [int(r.choice(4, p=q)) for q in p]
    rows = [(i, y[i], c, float(x[i, c])) for i in range(400) for c in range(4)]
    got = evaluation.refine_temperature(spark.createDataFrame(rows, "item long, label long, class long, logit double")).first().temperature
    loss = lambda t: -np.mean(np.log(np.exp(x / t)[range(400), y] / np.exp(x / t).sum(axis=1) + 1e-12))
    grid = np.arange(0.1, 1.0, 1e-4)
    assert abs(got - grid[np.argmin([loss(t) for t in grid])]) < 1e-3


def test_running_sums_in_slices(spark):
    import random

    r = random.Random(3)
    rows = [("hot" if i % 3 else f"g{i % 5}", r.choice([0.5, None, r.random(), r.random()]), i, r.randint(0, 9)) for i in range(3000)] + [(None, 0.1, 9000 + i, 1) for i in range(5)]
    df = spark.createDataFrame(rows, "g string, v double, id int, x int")
    for down in (False, True):
        got = {x.id: (x.n, x.total) for x in running_sums(df.withColumn("one", F.lit(1)), "g", "v", {"n": "one", "total": "x"}, down, ["id"], rows_per_slice=100).collect()}
        assert len(got) == len(rows)
        for g in {x[0] for x in rows}:
            own = sorted((x for x in rows if x[0] == g), key=lambda x: (x[1] is None, 0 if x[1] is None else -x[1] if down else x[1], x[2]))
            total = 0
            for n, x in enumerate(own, 1):
                total += x[3]
                assert got[x[2]] == (n, total)
    assert running_sums(df.limit(0), "g", "v", {"n": "x"}).count() == 0


def test_exact_quantiles(spark):
    import random

    from lernspur.operators.ranking import exact_quantiles

    r = random.Random(4)
    rows = [(g, None if r.random() < 0.1 else round(r.random(), 2)) for g in ("a", "b", None) for _ in range(500)] + [("one", 3.0), ("none", None)]
    shares = {"least": 0.0, "low": 0.1, "middle": 0.5, "high": 0.95, "most": 1.0}
    got = {x.g: tuple(x)[1:] for x in exact_quantiles(spark.createDataFrame(rows, "g string, v double"), "g", "v", shares).collect()}
    for g in {x[0] for x in rows} - {"none"}:
        assert got[g] == pytest.approx(np.percentile([v for k, v in rows if k == g and v is not None], [100 * q for q in shares.values()]))
    assert "none" not in got
    assert evaluation.latency_p95(spark.createDataFrame([(None,)], "ms double"), "ms").collect()[0].p95_ms is None


def test_history_streams_and_large_catalogues(spark, monkeypatch):
    base = datetime.datetime(2024, 1, 1)
    log = [(1, 1, i, base + datetime.timedelta(hours=i), i % 4 > 0) for i in range(3000)] + [(2, 1, 5000, base, True)]
    df = spark.createDataFrame(log, "user_id long, vocab_id long, event_id long, submitted_at timestamp, passed boolean")
    history = learner.mastery_history(df)
    last = {(r.user_id, r.vocab_id): tuple(r)[2:] for r in learner.mastery_fold(df).collect()}
    ends = {(r.user_id, r.vocab_id): tuple(r)[4:] for r in history.where("event_id in (2999, 5000)").collect()}
    assert history.count() == 3001 and ends == last
    items = spark.createDataFrame([(i, i) for i in range(5)], "vocab_id long, rank long")
    want = sorted(learner.catalog_with_state(df, items, learner.mastery_fold(df)).collect())
    monkeypatch.setattr(learner, "MOST_ITEMS", 3)
    assert sorted(learner.catalog_with_state(df, items, learner.mastery_fold(df)).collect()) == want and len(want) == 10
