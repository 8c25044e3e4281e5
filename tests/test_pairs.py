"""Operators on pairs of clips, against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lernspur.operators import trajectory

CLIP = "clip string, sign string, traj array<array<double>>"


def some_clips(n, signs="abc", copies=0):
    r = random.Random(n)
    made = [(f"c{i:03}", signs[i % len(signs)], [[None if r.random() < 0.2 else 1000 + r.gauss(0, 1) for _ in range(3)] for _ in range(r.choice([2, 2, 2, 4]))]) for i in range(n)]
    made += [(f"x{i:03}", *made[i][1:]) for i in range(copies)]
    return [*made, ("none", "a", [[None] * 3]), ("null", "b", None), ("lone", "z", [[1000.0, None, 1000.5]])]


def apart(a, b):
    pairs = [(x, y) for x, y in zip(*([v for row in t or [] for v in row] for t in (a, b)), strict=False) if x is not None and y is not None]
    return sum((x - y) ** 2 for x, y in pairs) / len(pairs) if pairs else math.inf


@pytest.mark.parametrize(("odd", "per_block"), [(False, 7), (False, 1000), (True, 7)])
def test_nearest_in_blocks_of_any_ids(spark, odd, per_block):
    made = some_clips(60, copies=5) + ([("far", "a", [[math.inf, 1000.0, 999.0]])] if odd else [])
    df = spark.createDataFrame(made, CLIP)
    want = {}
    for c, s, x in made:
        for d, ref, y in made:
            if c != d:
                want[c, s, ref] = min(want.get((c, s, ref), math.inf), apart(x, y) / 0.05)
    got = {(r.clip, r.sign, r.ref_sign): r.score for r in trajectory.nearest_in_blocks(df, df, per_block=per_block).collect()}
    assert got.keys() == want.keys() and len(got) == len(made) * 4 - 1
    assert got == pytest.approx(want, rel=1e-12)
    assert trajectory.nearest_in_blocks(df.limit(0), df).count() == trajectory.nearest_in_blocks(df, df.limit(0)).count() == 0


def test_nearest_pairs_are_measured_not_multiplied_out():
    """Clips far from 0 and close to each other: products of matrices alone would give noise."""
    r = np.random.default_rng(3)
    x = 1e6 + r.normal(size=(40, 6)) * 1e-3
    there = np.ones_like(x, dtype=bool)
    got = trajectory._least(x, there, x, there, np.eye(40, dtype=bool), np.array([0, 15]))
    d = ((x[:, None] - x[None]) ** 2).mean(axis=2)
    np.fill_diagonal(d, np.inf)
    np.testing.assert_allclose(got, np.stack([d[:, :15].min(axis=1), d[:, 15:].min(axis=1)], axis=1), rtol=1e-12)


@pytest.mark.parametrize("factor", [1e-25, 1.0, 1e140])
def test_nearest_of_unlike_sizes_are_measured(factor):
    """Clips of very unlike sizes, far beyond single precision, and copies."""
    r = np.random.default_rng(4)
    x = r.normal(size=(60, 5)) * 10.0 ** r.integers(-12, 12, size=(60, 1)) * factor
    there = r.random(x.shape) < 0.7
    x[~there] = 0.0
    x[30:40], there[30:40] = x[:10], there[:10]
    got = trajectory._least(x, there, x, there, (np.arange(60), np.arange(60)), np.array([0, 25]))
    d = np.stack([trajectory.mean_squares(a[None], b[None], x, there) for a, b in zip(x, there, strict=True)])
    np.fill_diagonal(d, np.inf)
    np.testing.assert_array_equal(got, np.stack([d[:, :25].min(axis=1), d[:, 25:].min(axis=1)], axis=1))


def test_nearest_in_blocks_copies_no_clips(spark):
    """Blocks meet without being written once for every block they meet."""
    df = spark.createDataFrame(some_clips(60), CLIP)
    plan = trajectory.nearest_in_blocks(df, df, per_block=7)._jdf.queryExecution().toString()
    assert "CartesianProduct" in plan and "Generate" not in plan and "explode" not in plan


@pytest.mark.parametrize("per_block", [4, 1024])
def test_pairwise_in_blocks(spark, per_block):
    made = [*some_clips(50, copies=4), ("q", None, [[1.0]]), (None, "a", [[1.0]]), ("nan", "c", [[math.nan, None, None]])]
    df = spark.createDataFrame(made, CLIP)
    known = [m for m in made if m[0] is not None and m[1] is not None]
    want = {(s, c, d): apart(x, y) for c, s, x in known for d, t, y in known if s == t and c < d}
    rows = trajectory.pairwise(df, per_block=per_block).collect()
    got = {(r.sign, r.a, r.b): r.distance for r in rows}
    assert len(rows) == len(got) and got.keys() == want.keys()
    assert got == pytest.approx(want, rel=1e-12, nan_ok=True)
    assert trajectory.pairwise(df.limit(0)).count() == 0


def test_pairwise_copies_no_clips(spark):
    """Blocks meet without being written once for every block they meet, and a pair of blocks leaves in batches."""
    df = spark.createDataFrame(some_clips(60), CLIP)
    plan = trajectory.pairwise(df, per_block=7)._jdf.queryExecution().toString()
    assert "CartesianProduct" in plan and "Generate" not in plan and "explode" not in plan
    one = spark.range(500).selectExpr("id AS clip", "'s' AS sign", "array(array(CAST(id AS DOUBLE))) AS traj")
    batches = trajectory.pairwise(one).mapInArrow(lambda it: (b.slice(0, 1) for b in it), "sign string, a long, b long, distance double")
    assert trajectory.pairwise(one).count() == 500 * 499 // 2 and batches.count() > 1


def test_sizes_round_half_up_as_in_sql(spark):
    from lernspur.plans.views import rounded, rounded_size

    made = [(2.0**-10,), (3 * 2.0**-10,), (0.0,), (1.0249365,), (0.1234567895,), (math.inf,), (1e300,), (None,)]
    rows = spark.createDataFrame(made, "v double").select(rounded(F.col("v"), 9), rounded_size(F.col("v"), 9)).collect()
    assert [r[0] for r in rows[:5]] == [r[1] for r in rows[:5]] == [0.000976563, 0.002929688, 0.0, 1.0249365, rows[4][0]] and rows[5][1] == math.inf and rows[7][1] is None


def test_medoid_of_copies_and_gaps(spark):
    """All clips of a sign share some value; the copy of the lowest id wins."""
    r = random.Random(5)
    made = []
    for s, n in (("a", 40), ("b", 9), ("c", 1)):
        own = [[[1e4 + r.gauss(0, 1), *(None if r.random() < 0.3 else r.gauss(0, 1) for _ in range(2))] for _ in range(2)] for _ in range(n)]
        made += [(f"{s}{i:02}", s, x) for i, x in enumerate(own)] + [(f"{s}-{i:02}", s, x) for i, x in enumerate(own)]
    made += [("bare", "d", None), ("q", None, [[1.0]]), ("p", None, [[2.0]]), ("e1", "e", [[None, 1.0]]), ("e2", "e", [[1.0, None]]), ("e3", "e", None)]
    totals = {}
    for c, s, x in made:
        totals.setdefault(s, []).append((sum(apart(x, y) for d, t, y in made if s == t and c != d) if s else 0.0, c))
    got = {x.sign: (x.total, x.clip) for x in trajectory.medoid(spark.createDataFrame(made, CLIP)).collect()}
    assert got.keys() == totals.keys()
    for s, own in totals.items():
        least = min(own)[0]
        assert got[s][0] == pytest.approx(least, rel=1e-9) or got[s][0] == least
        assert got[s][1] == min(c for total, c in own if total == least or total == pytest.approx(least, rel=1e-12))


def test_medoid_meets_no_pairs(spark):
    """Ten thousand clips of one sign: all pairs would take minutes."""
    df = spark.range(10_000).selectExpr("cast(id as string) AS clip", "'a' AS sign", "array(array(cast(id % 101 as double), if(id % 3 = 0, null, 1.0d))) AS traj")
    assert trajectory.medoid(df).first().clip in {str(i) for i in range(10_000) if i % 101 == 50}
    d = spark.createDataFrame([(str(i), "a", [[float(i % 101)]]) for i in range(1010)], CLIP)
    assert trajectory.medoid(d).first().clip == "151"  # the copy of 50 of the lowest id, as text
