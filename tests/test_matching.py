"""Frame features, templates, match scores, clusters and live matching against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lernspur.operators import frames, matching, trajectory
from lernspur.streaming import matcher

NAN = float("nan")


# ---- frame features


def plain_features(frame, layout):
    """(features with NaN where missing, whether the second slot is filled), point by point."""
    slot, width = frames.LAYOUTS[layout]
    out, pose = [NAN] * width, frame["pose"]
    seen = lambda p: p is not None and (p[0] != 0 or p[1] != 0)
    if not pose or len(pose) < 4:
        return out, False
    nose, neck, right, left = pose[:4]
    both = seen(right) and seen(left)
    if seen(neck):
        ax, ay = neck[:2]
    elif both:
        ax, ay = (right[0] + left[0]) / 2, (right[1] + left[1]) / 2
    elif seen(nose):
        ax, ay = nose[:2]
    else:
        return out, False
    scale = max(1.0, math.dist(right[:2], left[:2]) if both else 1.5 * math.dist(nose[:2], neck[:2]) if seen(nose) and seen(neck) else 0.0)
    body = lambda p: ((p[0] - ax) / scale, (p[1] - ay) / scale)
    filled = {}
    for hand in (frame["hands"] or [])[:2]:
        k = hand["keypoints"]
        if not k or len(k) < 21:
            continue
        side, away = int(not k[0][0] < ax), abs(k[0][0] - ax)
        if side in filled and away >= filled[side]:
            continue
        filled[side], base = away, side * slot
        if layout == "hand":
            palm = math.dist(k[9][:2], k[0][:2])
            out[base + 42 : base + 44] = body(k[0])
            if palm >= 1e-6:
                out[base : base + 42] = [(p[c] - k[0][c]) / palm for p in k[:21] for c in (0, 1)]
                out[base + 44 : base + 46] = [(k[9][c] - k[0][c]) / palm for c in (0, 1)]
        else:
            out[base : base + 42] = [v for p in k[:21] for v in body(p)]
            if layout == "embedded" and hand["embedding"] and len(hand["embedding"]) == 128:
                out[base + 42 : base + 170] = hand["embedding"]
    for i, p in enumerate(pose[:8]):
        if p is not None:
            out[2 * slot + 2 * i : 2 * slot + 2 * i + 2] = body(p)
    return out, 1 in filled


def some_frames():
    r = random.Random(4)
    point = lambda x=0, y=0: [x + r.uniform(-20, 20), y + r.uniform(-20, 20)]
    hand = lambda x, e=None, n=21: {"keypoints": [point(x, 100) for _ in range(n)], "embedding": e and [r.random() for _ in range(e)]}
    pose = [[100.0, 80.0], [100.0, 100.0], [50.0, 100.0], [150.0, 100.0], [50.0, 130.0], [150.0, 130.0], [50.0, 160.0], [150.0, 160.0]]
    flat = {"keypoints": [[60.0, 60.0]] * 21, "embedding": None}
    without = lambda *gone: [[0.0, 0.0] if i in gone else p for i, p in enumerate(pose)]
    hands = [None, [], [hand(60)], [hand(140)], [hand(60), hand(140)], [hand(140, 128), hand(60, 128)], [hand(40, 128), hand(70)], [hand(70), hand(40, 128)], [hand(10, 128), hand(90, 5)], [hand(130), hand(131), hand(60)], [hand(60, n=20), hand(140)], [hand(60, n=0)], [hand(20), flat], [flat, hand(95)], [hand(70), {"keypoints": None, "embedding": None}]]
    poses = [pose, without(1), without(2), without(1, 2), without(0, 2), without(0, 1, 2, 3), without(2, 3), pose[:3], pose[:4], [pose[0], pose[1], None, pose[3]], [*pose[:5], None], None, [[100.0, 80.0], [100.0, 80.1], [100.0, 80.0], [100.2, 80.0]]]
    return [{"hands": h, "pose": p} for h in hands for p in poses]


@pytest.mark.parametrize("layout", list(frames.LAYOUTS))
def test_frame_features_equal_plain(spark, layout):
    made = some_frames()
    df = spark.createDataFrame([(i, f) for i, f in enumerate(made)], f"i int, frame {frames.FRAME}")
    got = df.select("i", frames.frame_features(F.col("frame"), layout).alias("x"), frames.uses_second_hand(F.col("frame")).alias("second")).collect()
    float32 = lambda f: {"hands": [{**h, "embedding": h["embedding"] and [float(np.float32(v)) for v in h["embedding"]]} for h in f["hands"] or []], "pose": f["pose"]}
    for r in got:
        want, second = plain_features(float32(made[r.i]), layout)
        assert len(r.x) == frames.LAYOUTS[layout][1] and r.second == second
        np.testing.assert_allclose([NAN if v is None else v for v in r.x], want, atol=1e-9)


def test_frame_trajectories(spark):
    made = some_frames()
    held = [f for f in made if f["hands"]]
    clips = {1: made[:40], 2: [f for f in made if not f["hands"]][:5], 3: [*made[:13], held[0]], 4: [], 5: held[52:60]}
    df = spark.createDataFrame([(c, "s", f) for c, f in clips.items()], f"clip int, sign string, frames array<{frames.FRAME}>")
    got = {r.clip: r for r in frames.frame_trajectories(df, 6).collect()}
    for c, own in clips.items():
        kept = [f for f in own if f["hands"]]
        kept = kept if len(kept) >= 2 else own
        layout = "embedded" if any(h["embedding"] and len(h["embedding"]) == 128 for f in kept for h in f["hands"] or []) else "body"
        if not own:
            assert got[c].traj == [] and got[c].second_share is None
        else:
            x = np.array([plain_features(f, layout)[0] for f in kept])
            assert np.array(got[c].traj, dtype=float).shape == (6, frames.LAYOUTS[layout][1])
            np.testing.assert_allclose(np.array(got[c].traj, dtype=float), plain_resample(x, 6), atol=1e-6)
            assert got[c].second_share == pytest.approx(sum(plain_features(f, "body")[1] for f in own) / len(own))


def plain_resample(x, steps):
    if len(x) == steps:
        return x
    if len(x) == 1:
        return np.repeat(x, steps, axis=0)
    out = np.full((steps, x.shape[1]), NAN)
    for f in range(x.shape[1]):
        there = np.flatnonzero(~np.isnan(x[:, f]))
        if len(there):
            out[:, f] = np.interp(np.linspace(0, len(x) - 1, steps), there, x[there, f])
    return out


@pytest.mark.parametrize(("n", "steps"), [(1, 4), (2, 7), (9, 4), (48, 32), (5, 5)])
def test_resampled_equals_interp(n, steps):
    r = np.random.default_rng(n)
    x = r.normal(size=(6, n, 5))
    x[r.random(x.shape) < 0.4] = NAN
    x[0, :, 2] = NAN
    if n != steps:
        for got, own in zip(trajectory.resampled(x, steps), x, strict=True):
            np.testing.assert_allclose(got, plain_resample(own, steps), atol=1e-12)


# ---- templates and scores


def plain_warp(x, m, s, radius=8):
    n = len(x)
    d = np.full((n + 1, n + 1), 1e18)
    d[0, 0] = 0
    for i in range(1, n + 1):
        for j in range(max(1, i - radius), min(n, i + radius) + 1):
            cells = [(a - b) ** 2 / v for a, b, v in zip(x[i - 1], m[j - 1], s[j - 1], strict=True) if not (math.isnan(a) or math.isnan(b))]
            d[i, j] = (sum(cells) / len(cells) if cells else 1e9) + min(d[i - 1, j], d[i, j - 1], d[i - 1, j - 1])
    return d[n, n] / (2 * n)


def plain_straight(x, m, s):
    cells = [(a - b) ** 2 / v for a, b, v in zip(x.ravel(), m.ravel(), s.ravel(), strict=True) if not (math.isnan(a) or math.isnan(b))]
    return sum(cells) / len(cells) if cells else math.inf


def plain_score(x, t, mirror, second, warped=True):
    x2 = x[:, mirror[0]] * np.array(mirror[1])
    hide = lambda m: np.where(np.isin(np.arange(m.shape[1]), range(second[0], second[1] + 1)), NAN, m) if t["one_handed"] else m
    if t["clips"] and t["n_clips"] < 8:
        return "nearest", min(plain_straight(v, hide(c), np.full(c.shape, 0.05)) for v in (x, x2) for c in t["clips"])
    parts = t["clusters"] if len(t["clusters"]) > 1 else [(t["mean"], t["var"])]
    return "clusters" if len(t["clusters"]) > 1 else "whole", min((plain_warp if warped else plain_straight)(v, hide(m), s) for v in (x, x2) for m, s in parts)


def listed(x):
    return [[None if math.isnan(v) else float(v) for v in row] for row in x]


def made_clips(seed=1, steps=12, width=6):
    r = np.random.default_rng(seed)
    rows, sizes = [], {"few": 5, "two": 24, "one": 9, "thin": 3}
    for k, (sign, n) in enumerate(sizes.items()):
        base = r.normal(size=(2, steps, width)).cumsum(axis=1) * 0.3
        for i in range(n):
            x = base[i % 2 if sign == "two" else 0] + r.normal(size=(steps, width)) * 0.1
            x[r.random(x.shape) < 0.1] = NAN
            rows.append((100 * k + i, sign, x))
    blank = np.full((steps, width), NAN)
    return [*rows, (900, "one", blank)]


CLIP = "clip long, sign string, traj array<array<double>>"
MIRROR = ([3, 4, 5, 0, 1, 2], [-1.0, 1.0, 1.0] * 2)


def test_match_scores_by_every_route(spark):
    made = made_clips()
    df = spark.createDataFrame([(c, s, listed(x)) for c, s, x in made], CLIP)
    fitted = matching.fit_templates(df, half=3, until=6, clusters=2, one_handed=["one"]).cache()
    templates = {r.sign: r for r in fitted.collect()}
    assert {s: t.status for s, t in templates.items()} == {"few": "ok", "two": "ok", "one": "ok", "thin": "too_few_clips"}
    assert {s: len(t.clusters or []) for s, t in templates.items()} == {"few": 0, "two": 2, "one": 0, "thin": 0} and templates["one"].one_handed and len(templates["few"].clips) == 5
    known = fitted.where("status = 'ok'")
    array = lambda x: np.array(x, dtype=float)
    for warped, block in ((True, 64 << 20), (False, 10)):
        got = matching.match_scores(df, known, MIRROR, (3, 5), warped, most_bytes=block).collect()
        assert len(got) == 3 * len(made)
        by = {c: x for c, _, x in made}
        for r in got:
            t = templates[r.sign]
            plain = {"one_handed": t.one_handed, "n_clips": t.n_clips, "mean": array(t.mean), "var": array(t.var), "clips": [array(c) for c in t.clips or []], "clusters": [(array(c.mean), array(c.var)) for c in t.clusters or []]}
            way, want = plain_score(by[r.clip], plain, MIRROR, (3, 5), warped)
            assert r.route == way and r.score == pytest.approx(want, rel=1e-9), (r.clip, r.sign)
    best = {r.clip: r.best for r in trajectory.predict(matching.in_slice(matching.match_scores(df, known), ["few", "two"])).where("label in ('few', 'two')").collect()}
    assert all(best[c] == s for c, s, _ in made if s in ("few", "two"))
    assert matching.match_scores(df, known.limit(0)).count() == 0 and matching.match_scores(df.limit(0), known).count() == 0
    odd = spark.createDataFrame([(1, "x", []), (2, "x", None), (3, "x", [[1.0], [1.0, 2.0]]), (4, None, listed(made[0][2]))], CLIP)
    assert {r.clip for r in matching.match_scores(odd, known).where("score < 1e300").collect()} == {4}
    limits = spark.createDataFrame([("few", 1.0), ("two", float("nan")), ("one", None)], "sign string, threshold double")
    assert all(r.passed == (r.sign != "few" or r.score <= 1.0) for r in matching.passing(matching.match_scores(df, known), limits).collect())


def test_ratio_leaves_other_features_out(spark):
    made = [(i, "s", [[float(t * i), float(t) * 0.01, 100.0 * t] for t in range(4)]) for i in range(1, 4)] + [(9, "gap", [[1.0, None, 1.0], [2.0, None, 5.0]]), (10, "part", [[1.0, None, 1.0], [2.0, 4.0, 5.0]])]
    df = spark.createDataFrame(made, CLIP)
    got = {r.sign: (r.ratio, r.one_handed) for r in trajectory.motion_ratio(df, 1, until=2).collect()}
    assert got["s"] == (pytest.approx(0.01 / 2), True) and got["gap"] == (1.0, False) and got["part"] == (0.0, True)


# ---- clusters


def plain_medoids(d, k, key):
    """The same draws and rules, with plain loops."""
    n = len(d)
    chosen = [matching.draw(f"{key}|0", np.ones(n))]
    while len(chosen) < k:
        far = np.array([0.0 if i in chosen else min(d[i][c] for c in chosen) ** 2 for i in range(n)])
        chosen.append(matching.draw(f"{key}|{len(chosen)}", far) if far.sum() > 0 else min(set(range(n)) - set(chosen)))
    for _ in range(25):
        near = [min(range(k), key=lambda c: (d[i][chosen[c]], c)) for i in range(n)]
        moved = []
        for c in range(k):
            members = [i for i in range(n) if near[i] == c]
            moved.append(min(members, key=lambda i: (sum(d[i][j] for j in members), i)) if members else chosen[c])
        if moved == chosen:
            break
        chosen = moved
    return chosen, [min(range(k), key=lambda c: (d[i][chosen[c]], c)) for i in range(n)]


@pytest.mark.parametrize("k", [1, 2, 3, 5])
def test_kmedoids_equal_brute_force(spark, k):
    made = made_clips(7)
    by = {}
    for c, s, x in made[:-1]:
        by.setdefault(s, []).append((c, x))
    df = spark.createDataFrame([(c, s, listed(x)) for c, s, x in made[:-1]], CLIP)
    got = {r.clip: (r.cluster, r.is_medoid) for r in matching.kmedoids(df, k).collect()}
    assert len(got) == len(made) - 1
    for sign, own in by.items():
        if k == 1 or len(own) <= k:
            assert {got[c][0] for c, _ in own} == {0}
            continue
        d = [[0.0 if a is b else plain_straight(a, b, np.ones(a.shape)) for _, b in own] for _, a in own]
        chosen, near = plain_medoids(d, k, f"42|{sign}")
        assert [got[c][0] for c, _ in own] == near and [i for i, (c, _) in enumerate(own) if got[c][1]] == sorted(chosen)


def test_kmedoids_of_large_and_odd_signs(spark):
    r = np.random.default_rng(0)
    two = [(i, "hot", listed(np.full((2, 2), float(i % 2) * 9) + r.normal(size=(2, 2)) * 0.1)) for i in range(300)]
    same = [(1000 + i, "same", [[1.0, 2.0]]) for i in range(10)]
    df = spark.createDataFrame([*two, *same, (2000, None, [[1.0, 1.0]])], CLIP)
    got = {c.clip: c for c in matching.kmedoids(df, 2, most=20).collect()}
    assert {(c % 2, got[c].cluster) for c in range(300)} in ({(0, 0), (1, 1)}, {(0, 1), (1, 0)}) and sum(got[c].is_medoid for c in range(300)) == 2
    assert {got[1000 + i].cluster for i in range(10)} == {0}  # copies of both medoids go to the first
    rows = {r.sign: len(r.clusters) for r in matching.cluster_templates(df, 2).collect()}
    assert rows == {"hot": 2}  # "same" has an empty second cluster
    uneven = spark.createDataFrame([(i, "u", [[0.0 if i < 13 else 50.0 + i]]) for i in range(16)] + [(50 + i, "small", [[float(i % 2)]]) for i in range(7)], CLIP)
    assert matching.cluster_templates(uneven, 2).count() == 0  # three clips in the second cluster; fewer than 2 x 4 clips
    assert matching.kmedoids(df.limit(0), 3).count() == 0


@pytest.mark.parametrize(("k", "odd"), [(2, False), (3, True)])
def test_medoids_of_many_clips_are_sought_among_all(spark, k, odd):
    """Signs of more clips than a matrix takes have the very medoids the matrix has, over blocks, gaps, copies and clips without values."""
    r = np.random.default_rng(k)
    made = []
    for sign, n in (("a", 150), ("b", 90), ("few", 12)):
        base = r.normal(size=(3, 2, 3)) * 2 + 50
        for i in range(n):
            x = base[i % 3] + r.normal(size=(2, 3)) * 0.5
            x[r.random(x.shape) < (0.2 if sign == "a" else 0.0)] = NAN
            made.append((f"{sign}{(i * 37) % n:03}", sign, listed(x)))
        made += [(f"{sign}-{i}", sign, made[-1 - i][2]) for i in range(8)]
    made += [("z1", "b", None), ("z0", "b", [[None] * 3] * 2)] if odd else []
    made += [("same%d" % i, "same", [[1.0, 2.0]]) for i in range(30)]
    df = spark.createDataFrame(made, "clip string, sign string, traj array<array<double>>")
    want, got = ({x.clip: (x.sign, x.cluster, x.is_medoid) for x in matching.kmedoids(df, k, most=most, per_block=32).collect()} for most in (1000, 20))
    assert got == want and len(got) == len(made)


def test_templates_of_many_clips_follow_all_of_them(spark):
    """A second kind of clip that five of a large sign are, none of them among the first 512 by seeded hash, has its own cluster."""
    made = [(i, "s", [[float(i % 5), 0.0]]) for i in range(1500)] + [(9045 + i, "s", [[1e6 + i, 1.0]]) for i in range(5)]
    clusters = matching.fit_templates(spark.createDataFrame(made, CLIP), half=1, until=2, clusters=2).first().clusters
    assert sorted(round(c.mean[0][0]) for c in clusters) == [2, 1_000_002]


# ---- live matching


def plain_steps(rows, templates, limits, config):
    """The rules frame by frame: hold frames with features, score the window, count passes in a row."""
    held, streaks, out = [], {}, []
    for target, x, some in rows:
        if x is not None and not all(math.isnan(v) for v in x):
            held = [*held, x][-max(config.window, config.steps) :]
        if len(held) < config.steps:
            out.append((False, {}, False, streaks.get(target, 0), False, None))
            continue
        window = plain_resample(np.array(held), config.steps)
        scores = {s: plain_score(window, templates[s], config.mirror, config.second)[1] for s in some if s in templates}
        for s, v in scores.items():
            streaks[s] = streaks.get(s, 0) + 1 if v <= limits.get(s, math.inf) else 0
        streak = streaks.get(target, 0)
        out.append((True, scores, scores.get(target, math.inf) <= limits.get(target, math.inf), streak, streak >= config.required, min(scores, key=scores.get) if scores else None))
    return out


def live(spark):
    made = made_clips(3)
    df = spark.createDataFrame([(c, s, listed(x)) for c, s, x in made], CLIP)
    fitted = matching.fit_templates(df, half=3, until=6, clusters=2)
    limits = {"few": 12.0, "two": 8.0, "one": float("inf")}
    thresholds = spark.createDataFrame(list(limits.items()), "sign string, threshold double")
    r, log = random.Random(2), []
    for session, own in ((1, made[:4]), (2, made[5:9]), (None, made[30:33])):
        t = 0
        for c, s, x in own:
            for row in x:
                gone = r.random() < 0.15
                log.append((session, t, s if t % 7 else "none", None if gone and r.random() < 0.5 else [None] * 6 if gone else [None if math.isnan(v) else float(v) for v in row], ["one", s, "few", s, "none"]))
                t += 1
    config = matcher.MatchConfig(steps=12, window=18, mirror=MIRROR, second=(3, 5), columns=("session", "t", "target", "features", "signs"))
    return log, fitted, thresholds, limits, config


LOG = "session long, t long, target string, features array<double>, signs array<string>"


def check_steps(got, log, fitted, limits, config):
    array = lambda x: np.array(x, dtype=float)
    templates = {t.sign: {"one_handed": t.one_handed, "n_clips": t.n_clips, "mean": array(t.mean), "var": array(t.var), "clips": [array(c) for c in t.clips or []], "clusters": [(array(c.mean), array(c.var)) for c in t.clusters or []]} for t in fitted.where("mean is not null").collect()}
    assert len(got) == len(log)
    unlocked = 0
    for session in {x[0] for x in log}:
        own = [x for x in log if x[0] == session]
        rows = [(x[2], None if x[3] is None else [NAN if v is None else v for v in x[3]], x[4]) for x in own]
        for x, want in zip(own, plain_steps(rows, templates, limits, config), strict=True):
            r = got[x[0], x[1]]
            assert (r.ready, r.passed, r.streak, r.unlocked, r.top1) == (want[0], *want[2:]) and r.target == x[2]
            assert r.scores == pytest.approx(want[1]) and (r.top1_score == (pytest.approx(want[1][r.top1]) if r.top1 else None))
            unlocked += r.unlocked
    assert 0 < unlocked < len(log)


def test_match_steps_equal_plain_replay(spark):
    log, fitted, thresholds, limits, config = live(spark)
    df = spark.createDataFrame(log, LOG)
    check_steps({(r.session, r.t): r for r in matcher.match_steps(df, fitted, thresholds, config).collect()}, log, fitted, limits, config)
    none = matcher.MatchConfig(steps=12, columns=("session", "t", "target", "features", None))
    assert {len(r.scores) for r in matcher.match_steps(df, fitted, thresholds, none).where("ready and target <> 'none'").collect()} == {1}
    assert matcher.match_steps(df.limit(0), fitted, thresholds, config).count() == 0


def test_match_stream_equals_replay_over_restarts(spark, tmp_path):
    log, fitted, thresholds, limits, config = live(spark)
    log = [x for x in log if x[0] is not None]
    provider = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        got = []
        for part in range(3):  # each part is a run of its own that goes on from the checkpoint
            some = sorted(log, key=lambda x: x[1])[part * len(log) // 3 : (part + 1) * len(log) // 3]
            spark.createDataFrame(some, LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            source = spark.readStream.schema(LOG).parquet(str(tmp_path / "in"))
            steps = matcher.match_stream(source, fitted, thresholds, config)
            steps.writeStream.outputMode("append").foreachBatch(lambda b, _: got.extend(b.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(provider)
    check_steps({(r.session, r.t): r for r in got}, log, fitted, limits, config)


def test_hand_features_skip_frames_without_hands(spark):
    made = some_frames()[:40]
    df = spark.createDataFrame([(i, f) for i, f in enumerate(made)], f"i int, frame {frames.FRAME}")
    for r in df.select("i", matcher.hand_features(F.col("frame")).alias("x")).collect():
        assert (r.x is not None) == bool(made[r.i]["hands"])


def test_windows_meet_the_signs_of_their_slices_alone(monkeypatch):
    """Sessions are scored together, each window against its own signs, with the steps of one session after the other."""
    import pandas as pd

    r, met = np.random.default_rng(1), []
    known = {s: {"clips": [], "n_clips": 9, "clusters": [], "whole": (r.normal(size=(3, 2)), np.ones((3, 2)))} for s in range(6)}
    config = matcher.MatchConfig(steps=3, window=4)
    log = [pd.DataFrame({"target": [i] * 8, "features": list(r.normal(size=(8, 2))), "slice": [[i, i + 3]] * 8}) for i in range(3)]
    want = [matcher.advance(matcher.Session(), rows, known, {}, config) for rows in log]
    plain = matcher.score
    monkeypatch.setattr(matcher, "score", lambda x, *rest: met.append(len(x)) or plain(x, *rest))
    assert matcher.advance_all([(matcher.Session(), rows) for rows in log], known, {}, config) == want
    assert sum(met) == 3 * 6 * 2 and len(met) <= 12  # six windows a session, two signs each, by shape
