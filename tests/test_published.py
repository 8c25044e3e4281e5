"""Versioned manifests under failing and running writes, templates as files, and row policies."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lernspur.operators import policy
from lernspur.sources import published as P

RECORDS = "clip_id string, sign_id string, split string"


def test_manifest_versions(spark, tmp_path):
    path = str(tmp_path / "m")
    with pytest.raises(LookupError):
        P.read_published(spark, path)
    first = spark.createDataFrame([("a", "dog", "train"), ("b", "cat", "val"), ("c", "dog", "train"), ("d", None, None)], RECORDS)
    skipped = spark.createDataFrame([("too_short",), ("too_short",), ("no_file",), (None,)], "reason string")
    P.publish_manifest(first, path, "v1", skipped, first.limit(2), {"fps": "30"})
    records, summary = P.read_published(spark, path)
    assert sorted(r.clip_id for r in records.collect()) == ["a", "b", "c", "d"]
    (s,) = summary.collect()
    assert (s.version, s.n_records, s.num_classes, s.classes, s.dropped) == ("v1", 4, 2, ["cat", "dog"], 2)
    assert s.split_counts == {"": 1, "train": 2, "val": 1} and s.skipped == {"": 1, "no_file": 1, "too_short": 2} and s.settings == {"fps": "30"}
    # a write that fails half-way, and one that is still running, change nothing for readers
    broken = first.withColumn("clip_id", F.when(F.col("split") == "val", F.raise_error(F.lit("lost"))).otherwise(F.col("clip_id")))
    with pytest.raises(Exception, match="lost"):
        P.publish_manifest(broken, path, "v2")
    first.limit(1).write.partitionBy("split").parquet(f"{path}/versions/v2-running/records")
    assert P.read_published(spark, path)[1].first().version == "v1"
    with pytest.raises(LookupError):
        P.read_published(spark, path, "v2")
    P.publish_manifest(first.where("split = 'train'"), path, "v2")
    P.publish_manifest(first.limit(0), path, "v3")
    assert P.read_published(spark, path, "v1")[0].count() == 4 and P.read_published(spark, path, "v2")[0].count() == 2
    records, summary = P.read_published(spark, path, "v3")
    assert summary.first().classes == [] and summary.first().n_records == 0 and summary.first().split_counts == {}
    P.publish_manifest(first, path, "v1", settings={"again": "yes"})
    assert P.read_published(spark, path)[1].first().settings == {"again": "yes"}


def plain_export(series):
    x = np.array(series, dtype=float)
    spans = [s for s in np.hypot(x[:, 88] - x[:, 90], x[:, 89] - x[:, 91]) if s > 1e-3]
    x = x / (float(np.median(spans)) if spans else 1.0)
    pairs = lambda row: [None if math.isnan(a) or math.isnan(b) else [round(a, 4), round(b, 4)] for a, b in row.reshape(-1, 2)]
    return [{"hand0": pairs(r[:42]), "hand1": pairs(r[42:84]), "pose": pairs(r[84:])} for r in x]


def test_templates_as_files(spark, tmp_path):
    r = np.random.default_rng(1)
    listed = lambda x: [[None if math.isnan(v) else float(v) for v in row] for row in x]
    made = {s: r.normal(size=(4, 100)) for s in ("a", "b", "c", "d")}
    made["a"][1, 5], made["a"][:, 90] = np.nan, np.nan
    made["b"][2, 88:92] = 0.0
    rows = [(s, 9, s == "a", listed(x)) for s, x in made.items()] + [("narrow", 5, False, [[1.0, 2.0]]), ("none", 5, None, None)]
    templates = spark.createDataFrame(rows, "sign string, n_clips long, one_handed boolean, mean array<array<double>>")
    clips = spark.createDataFrame([("d", listed(made["a"]))], "sign string, traj array<array<double>>")
    P.export_templates(templates, str(tmp_path / "out"), clips)
    want = {**{s: plain_export(x) for s, x in made.items()}, "d": plain_export(made["a"])}
    got = {x.sign: x for x in P.read_templates(spark, str(tmp_path / "out")).collect()}
    assert got.keys() == want.keys()
    for s, frames in want.items():
        assert [f.asDict() for f in got[s].frames] == frames and (got[s].T, got[s].n_clips, got[s].one_handed) == (4, 9, s == "a")
    text = [json.loads(line) for f in (tmp_path / "out").glob("*.json") for line in f.read_text().splitlines()]
    assert {t["sign"]: t["frames"] for t in text} == want and text[0]["schema"]["pose_order"][0] == "nose" and text[0]["schema"]["coord_space"] == P.SPACE


def test_row_policies(spark, tmp_path):
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    make([(1, "a"), (2, "b"), (None, "c")], "id long, email string").write.parquet(str(tmp_path / "users"))
    tables = {
        "users": spark.read.parquet(str(tmp_path / "users")),
        "attempts": make([(1, 1), (2, 2), (3, 1), (4, None)], "event long, user_id long"),
        "mastery_state": make([(1, "x"), (2, "y")], "user_id long, status string"),
        "vocabulary_items": make([("dog",), ("cat",)], "id string"),
        "confusion_pair_hints": make([("h",)], "hint string"),
        "model_versions": make([("v1", False), ("v2", True), ("v3", None)], "id string, is_active boolean"),
        "secrets": make([("s",)], "value string"),
    }
    seen = policy.visible(tables, F.lit(1))
    assert {n: df.count() for n, df in seen.items()} == {"users": 1, "attempts": 2, "mastery_state": 1, "vocabulary_items": 2, "confusion_pair_hints": 1, "model_versions": 1}
    assert policy.visible(tables, F.lit(1), "anon") == {} and {n: df.count() for n, df in policy.visible(tables, F.lit(9)).items()}["users"] == 0
    assert "EqualTo(id,1)" in seen["users"]._jdf.queryExecution().executedPlan().toString()
    assert policy.open_views(tables, F.lit(2), prefix="mine_") and spark.sql("SELECT email FROM mine_users").collect()[0].email == "b"
    new = make([(5, 1), (6, 2)], "event long, user_id long")
    assert [r.event for r in policy.denied(new, "attempts", "insert", F.lit(1)).collect()] == [6]
    assert policy.denied(new, "attempts", "update", F.lit(1)).count() == 2 and policy.denied(new, "attempts", "insert", F.lit(1), "anon").count() == 2
    theft = make([(1, "new"), (2, "stolen")], "user_id long, status string")
    assert [r.user_id for r in policy.denied(theft, "mastery_state", "update", F.lit(1)).collect()] == [2]
    moved = make([("k2", 1)], "key string, user_id long")  # a row of another account, given the own id
    assert policy.denied(moved, "mastery_state", "update", F.lit(1), old=make([("k1", 1), ("k2", 2)], "key string, user_id long"), key="key").count() == 1
    with pytest.raises(PermissionError):
        policy.checked(new, "attempts", "insert", F.lit(1))
    assert policy.checked(new.limit(0), "attempts", "insert", F.lit(1)).count() == 0
