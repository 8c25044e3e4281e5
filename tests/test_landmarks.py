"""Readers of annotations and operators that have no query of their own, on small files and frames."""

import json
import math

import pytest
from pyspark.sql import functions as F

from lernspur.operators import boxes, corpus, evaluation, landmarks, trajectory
from lernspur.sources import annotations, manifests


def write(path, value):
    path.write_text(json.dumps(value))
    return str(path)


def test_manifests_in_every_envelope(spark, tmp_path):
    record = lambda i: {"clip_id": i, "sign_id": "s", "path": None}
    paths = [write(tmp_path / f"{k}.json", {k: [record(k)]}) for k in ("records", "clips", "items")] + [write(tmp_path / "bare.json", [record("bare"), record("more")]), write(tmp_path / "none.json", {"other": []})]
    assert sorted(r.clip_id for r in manifests.read_manifest(spark, paths).collect()) == ["bare", "clips", "items", "more", "records"]


def test_timed_clips(spark, tmp_path):
    paths = [write(tmp_path / f"X_{s}.json", [{"clean_text": "Hello", "url": "u", "end_time": 2, "label": 3}, {"clean_text": "no url"}]) for s in ("train", "val")]
    got = annotations.read_timed_clips(spark, paths).collect()
    assert sorted((r.split, r.gloss, r.start_time, r.end_time, r.label) for r in got) == [("train", "hello", 0.0, 2.0, 3), ("val", "hello", 0.0, 2.0, 3)]


def test_body_poses(spark, tmp_path):
    flat = lambda seen: [x for i in range(17) for x in (i, 10 * i, 2 if i in seen else 0)]
    doc = {
        "images": [{"id": 1, "file_name": "a.jpg", "width": 64, "height": 48}],
        "annotations": [
            {"image_id": 1, "category_id": 1, "keypoints": flat({0, 5, 6}), "bbox": [1, 2, 3, 4]}, {"image_id": 1, "category_id": 1, "keypoints": flat({0}), "bbox": [0, 0, 1, 1]},
            {"image_id": 1, "category_id": 2, "keypoints": flat({5}), "bbox": [0, 0, 1, 1]}, {"image_id": 9, "category_id": 1, "keypoints": flat({5}), "bbox": [0, 0, 1, 1]}, {"image_id": 1, "category_id": 1, "keypoints": flat({10}), "bbox": [5, 5, 1, 1]},
        ],
    }
    (row,) = annotations.read_body_poses(spark, write(tmp_path / "p.json", doc)).collect()
    assert (row.file_name, len(row.persons)) == ("a.jpg", 2)
    first = row.persons[0]
    assert first.bbox == [1, 2, 4, 6] and tuple(first.keypoints[1]) == (5.5, 55.0, 2.0) and [p.x for p in first.keypoints] == [0, 5.5, 6, 5, 8, 7, 10, 9]
    assert tuple(row.persons[1].keypoints[1]) == (0.0, 0.0, 0.0)


def test_hand_points(spark, tmp_path):
    flat = [x for i in range(21) for x in (i, 2 * i, 1 if i < 7 else 0)]
    notes = [
        {"image_id": 1, "lefthand_valid": True, "lefthand_kpts": flat, "lefthand_box": [1, 1, 10, 10], "righthand_valid": True, "righthand_kpts": flat, "righthand_box": [0, 0, 1, 1]},
        {"image_id": 1, "lefthand_valid": False, "lefthand_kpts": flat, "righthand_valid": True, "righthand_kpts": flat[:60]}, {"image_id": 1, "righthand_valid": True, "righthand_kpts": [0.0] * 63},
    ]
    (row,) = annotations.read_hand_points(spark, write(tmp_path / "h.json", {"images": [{"id": 1, "file_name": "a", "width": 9, "height": 9}], "annotations": notes})).collect()
    assert sorted((h.side, h.bbox) for h in row.hands) == [("left", [1, 1, 11, 11]), ("right", [0, 0, 6, 12])]


def test_box_maps(spark, tmp_path):
    write(tmp_path / "call.json", {"x": {"bboxes": [[0.5, 0.5, 0.1, 0.1], [0, 0, 0.001, 0.5], [0.1]], "hand_landmarks": [[1]]}, "y": {"bboxes": []}, "z": {}})
    (row,) = annotations.read_box_maps(spark, str(tmp_path)).collect()
    assert (row.label, row.image) == ("call", "x") and [round(v, 6) for v in row.bboxes[0]] == [960, 540, 1152, 648] and set(row.asDict()) == {"label", "image", "width", "height", "bboxes"}


def test_parallel_points(spark, tmp_path):
    points = [[float(i), 2.0 * i, 10.0 + i] for i in range(21)]
    k = [[100, 0, 50], [0, 200, 60], [0, 0, 1]]
    rows = annotations.read_parallel_points(spark, write(tmp_path / "a.json", [points, points]), write(tmp_path / "k.json", [k, k]), unique=1).collect()
    assert len(rows) == 1
    for i, (x, y, z) in enumerate(points):
        assert math.isclose(rows[0].keypoints[i].x, 100 * x / z + 50) and math.isclose(rows[0].keypoints[i].y, 200 * y / z + 60)
        assert math.isclose(rows[0].depth[i], i / (9 * math.sqrt(6)))


def test_sidecars_poses_and_views(spark, tmp_path):
    write(tmp_path / "one.json", {"hand_pts": [[1, 2, 1]] * 21, "is_left": 1})
    write(tmp_path / "two.json", {"hand_pts": [[1, 2, 1]] * 3})
    assert [(r.image, r.is_left, len(r.keypoints)) for r in annotations.read_sidecar_points(spark, str(tmp_path)).collect()] == [("one", True, 21)]
    points = spark.createDataFrame([("a", i, float(i), 1.0, 2.0) for i in (7, 9, 12)] + [("b", 8, 5.0, 5.0, 2.0)], "image string, id int, x double, y double, v double")
    posed = {r.image: [(p.x, p.v) for p in r.keypoints] for r in annotations.points_to_pose(points).collect()}
    assert posed["a"][:4] == [(9.0, 1.0), (7.0, 2.0), (12.0, 2.0), (0.0, 0.0)] and posed["b"][:2] == [(0.0, 0.0), (5.0, 2.0)]
    joints = spark.createDataFrame([(1, [[float(i), 1.0, 2.0] for i in range(21)]), (2, [[1.0, 1.0, 1.0]])], "frame int, xyz array<array<double>>")
    cams = spark.createDataFrame([("c", [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]], [0.0, 0.0, 2.0], 10.0, 20.0, 1.0, 2.0), ("d", None, None, 1.0, 1.0, 0.0, 0.0)], "camera string, r array<array<double>>, t array<double>, fx double, fy double, cx double, cy double")
    (row,) = annotations.project_views(joints, cams).collect()
    assert row.frame == 1 and [(p.x, p.y) for p in row.keypoints] == [(i / 4 * 10 + 1, 1 / 4 * 20 + 2) for i in range(21)]


def test_synonyms(spark):
    groups = [(0, ["big", "large"]), (1, ["huge", "large"]), (2, ["tiny"]), (3, ["small", "little", "big"])]
    got = landmarks.expand_synonyms({"large": "large", "little": "little"}, spark.createDataFrame(groups, "position int, members array<string>")).collect()
    assert dict((r.member, r.owner) for r in got) == {"large": "large", "little": "little", "big": "large", "huge": "large", "small": "little"}
    assert landmarks.expand_synonyms({}, spark.createDataFrame(groups, "position int, members array<string>")).count() == 0


@pytest.mark.parametrize("width", (100, 108, 356))
def test_mirror_twice_is_nothing(spark, width):
    order, signs = trajectory.body_mirror(width)
    assert sorted(order) == list(range(width))
    row = [float(i + 1) for i in range(width)]
    df = spark.createDataFrame([([row],)], "traj array<array<double>>")
    once = df.withColumn("traj", trajectory.mirror(F.col("traj"), order, signs))
    assert once.first().traj[0][0] == -row[width // 2 - 8] and once.withColumn("traj", trajectory.mirror(F.col("traj"), order, signs)).first().traj == [row]
    if width == 356:
        assert once.first().traj[0][42:170] == row[212:340]
    with pytest.raises(ValueError):
        trajectory.body_mirror(99)


def test_rows_without_signer_are_signers_of_their_own(spark):
    rows = [(i, "s", None) for i in range(40)] + [(100 + i, "s", "a") for i in range(5)]
    df = spark.createDataFrame(rows, "clip_id long, sign string, signer string")
    split = corpus.split_signers_per_sign(df, "sign", "signer", "clip_id").collect()
    assert len(split) == 41 and {r.n for r in split} == {1, 5} and len({r.split for r in split}) == 3
    assert corpus.split_signers(df, "signer", "clip_id").count() == 41


def test_accounts_are_deleted_with_a_hashed_log(spark):
    users = spark.createDataFrame([(1,), (2,), (None,)], "id long")
    left, log = landmarks.delete_account({"users": (users, "id")}, F.lit(2), F.current_timestamp())
    assert {r.id for r in left["users"].collect()} == {1, None} and log.columns == ["deleted_at", "user_hash"] and len(log.first().user_hash) == 64


def test_odd_trajectories(spark):
    df = spark.createDataFrame([(1, []), (2, [[1.0]]), (3, [[0.0], [0.0], [6.0]])], "id int, traj array<array<double>>")
    got = {r.id: r for r in df.select("id", landmarks.gaussian_smooth(F.col("traj")).alias("g"), landmarks.loop_close(F.col("traj"), 2).alias("l"), landmarks.unit_rows(F.col("traj")).alias("u")).collect()}
    assert got[1].g == [] and got[2].g == [[1.0]] and got[3].l == [[0.0], [0.0], [0.0]] and got[3].u == [[0.0], [0.0], [1.0]]
    assert sum(v for (v,) in got[3].g) > 0


def test_embeds_are_found(spark, sf_dir):
    import __spark_entry__ as entry

    assert entry.queries()["embed_ids"](spark, sf_dir).where("ids <> ''").count() > 0


def test_zero_depths_and_missing_values_are_null(spark):
    df = spark.createDataFrame([([[1.0, 2.0, 4.0], [1.0, 1.0, 0.0], [3.0], []],)], "xyz array<array<double>>")
    (row,) = df.select(landmarks.project(F.col("xyz"), 4.0, 8.0, 1.0, 2.0).alias("p"), landmarks.relative_depth(F.col("xyz"), 0, 3).alias("d"), landmarks.body_space(F.col("xyz"), 0, 1, 2).alias("b")).collect()
    assert row.p == [[2.0, 6.0], [None, None], [None, None], [None, None]] and row.d is None
    pairs = spark.createDataFrame([("a", 1, 5.0, 0), ("a", 2, 5.0, 0), ("b", 1, 4.0, 1)], "source string, keypoint int, err double, vis int")
    assert {r.source: r.pooled for r in landmarks.keypoint_error(pairs).collect()} == {"a": None, "b": 4.0}


def test_ids_without_a_duration_stay(spark):
    rows = spark.createDataFrame([("s", "a", 1, None), ("s", "b", 2, 61.0), ("s", "c", 3, 60.0), ("s", "a", 4, 99.0)], "sign string, id string, n int, d double")
    assert [(r.id, r.place) for r in landmarks.first_seen_ids(rows, "sign", "id", ["n"], "d", 60, 5).orderBy("place").collect()] == [("a", 1), ("c", 2)]


def test_gate_fails_on_absent_facts(spark):
    schema = "top1 double, worst_recall double, gap double, max_threshold double, p95_ms double, previous_top1 double, ece double, uncovered long, architecture string"
    verdicts = lambda *x: {r.rule: (r.verdict, r.detail) for r in evaluation.eval_gate(spark.createDataFrame([x], schema)).collect()}
    none = verdicts(*[None] * 9)
    assert {k: v for k, (v, _) in none.items()} == {"top1": "FAIL", "per_sign": "PASS", "demographic_gap": "SKIP", "thresholds": "FAIL", "latency": "SKIP", "regression": "SKIP", "calibration": "SKIP", "hint_coverage": "SKIP", "architecture": "PASS", "overall": "FAIL"}
    assert none["overall"][1] == "top1, thresholds"
    good = verdicts(0.9, 0.7, 0.05, 0.9, 500.0, 0.92, 0.01, 0, "tcn")
    assert {v for v, _ in good.values()} == {"PASS"} and good["overall"][1] == ""
    assert verdicts(0.9, 0.7, 0.05, 0.9, 500.0, 0.95, 0.01, 0, "other")["overall"] == ("FAIL", "regression, architecture")


def plain_body_box(boxes, width, height):
    x0, y0, x1, y1 = min(b[0] for b in boxes), min(b[1] for b in boxes), max(b[0] + b[2] for b in boxes), max(b[1] + b[3] for b in boxes)
    hw, hh = max(b[2] for b in boxes), max(b[3] for b in boxes)
    x0, x1, y0, y1 = x0 - 1.5 * hw, x1 + 1.5 * hw, y0 - 3.5 * hh, y1 + 0.5 * hh
    m, least = 0.2 * max(x1 - x0, y1 - y0), 0.4 * min(width, height)
    (x0, x1), (y0, y1) = (((a + z) / 2 - least / 2, (a + z) / 2 + least / 2) if z - a < least else (a, z) for a, z in ((x0 - m, x1 + m), (y0 - m, y1 + m)))
    x0, y0, x1, y1 = max(0, math.floor(x0)), max(0, math.floor(y0)), min(width, math.floor(x1)), min(height, math.floor(y1))
    if x1 <= x0 or y1 <= y0:
        return None
    w, h = x1 - x0, y1 - y0
    if w > h * 1.6:
        need = math.floor(w / 1.6) - h
        down = min(need, height - y1)
        y0, y1 = y0 - min(need - down, y0), y1 + down
    elif h > w * 1.6:
        need = math.floor(h / 1.6) - w
        left = min(need // 2, x0)
        x0, x1 = x0 - left, x1 + min(need - left, width - x1)
    return x0, y0, x1, y1


def test_body_box_takes_each_axis_for_itself(spark):
    frames = {1: [(100, 100, 10, 40)], 2: [(100, 100, 60, 8), (10, 150, 5, 5)], 3: [(0, 0, 3, 3)], 4: [(630, 300, 9, 50), (600, 10, 4, 90)], 5: [(900, 900, 5, 5)], 6: [(200, 350, 200, 5)]}
    rows = [(f, i, *map(float, b)) for f, some in frames.items() for i, b in enumerate(some)]
    got = {r[0]: tuple(r)[1:] for r in boxes.body_box_from_hands(spark.createDataFrame(rows, "frame int, box int, x0 double, y0 double, w double, h double"), 640, 480).collect()}
    assert got == {f: b for f, some in frames.items() if (b := plain_body_box(some, 640, 480))}


def test_signs_are_usable_as_a_whole(spark):
    rows = [("a", 0.5, 0.1, 0.9), ("b", 0.3, 0.3, 0.7), ("c", None, None, 0.1), ("d", 1e-7, None, 0.9)]
    (r,) = landmarks.signal_verdict(spark.createDataFrame(rows, "sign string, spread double, ratio double, valid double")).collect()
    assert (r.signs, r.mean_spread, r.mean_ratio, r.mean_valid, r.usable) == (3, 0.267, 0.2, 0.833, True)
    none = landmarks.signal_verdict(spark.createDataFrame(rows[2:3], "sign string, spread double, ratio double, valid double")).first()
    assert (none.signs, none.usable) == (0, False)


def test_crops_and_items_on_odd_input(spark):
    frame = "struct<frame_idx: int, hands: array<struct<bbox: array<double>>>>"
    frames = [(0, [([10.0, 10.0, 30.0, 30.0],), (None,), ([1.0],), ([0.0, 0.0, 2.0, 2.0],)]), (1, None), (2, [])]
    rows = [("a", 10.0, 30.0, [100.0, 100.0], frames), ("b", 10.0, None, None, frames), ("c", 0.0, 30.0, None, frames), ("d", 10.0, 30.0, None, None)]
    df = spark.createDataFrame([(*r[:4], 200, 100, r[4]) for r in rows], f"clip string, fps double, source_fps double, frame_size array<double>, source_width int, source_height int, frames array<{frame}>")
    got = sorted(tuple(r) for r in boxes.crop_records(df).collect())
    assert got == [("a", 0, 0, 14, 4, 66, 36), ("b", 0, 0, 7, 7, 33, 33)]
    items = spark.createDataFrame([(1, 50, 50, [[-5.0, 0.0, 20.0, 80.0], [60.0, 0.0, 70.0, 9.0]]), (2, 50, 50, [[60.0, 0.0, 70.0, 9.0]]), (3, 50, 50, []), (4, None, 50, [[60.0, 0.0, 70.0, 9.0]]), (5, 50, 50, None), (6, 50, 50, [None, [1.0]])], "i int, width int, height int, bboxes array<array<double>>")
    assert {r.i: r.bboxes for r in boxes.clip_items(items).collect()} == {1: [[0.0, 0.0, 20.0, 50.0]], 3: [], 4: [[60.0, 0.0, 70.0, 9.0]], 5: []}
