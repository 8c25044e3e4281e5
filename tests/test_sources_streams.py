"""Readers on small files, and streams against their batch twins."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from lernspur.operators import learner
from lernspur.sources import manifests as M
from lernspur.streaming.mastery import mastery_stream
from lernspur.streaming.smoothing import ema_stream


def test_manifests(spark, tmp_path):
    rec = {"clip_id": "c1", "sign_id": "s1", "source": "a", "split": "train"}
    (tmp_path / "a.json").write_text(json.dumps({"records": [rec, {**rec, "clip_id": "c2"}]}))
    (tmp_path / "b.json").write_text(json.dumps({"items": [{**rec, "clip_id": "c3", "split": "val"}]}))
    df = M.read_manifest(spark, [str(tmp_path / "a.json"), str(tmp_path / "b.json")])
    assert sorted(r.clip_id for r in df.collect()) == ["c1", "c2", "c3"]
    M.write_manifest(df, str(tmp_path / "out"))
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "out/summary")).collect()} == {("train", 2, 1), ("val", 1, 1)}
    with pytest.raises(ValueError):
        M.check_allowed_fields(df, {"clip_id"}, {"name"})


def test_csv_json_and_text_readers(spark, tmp_path):
    (tmp_path / "train.csv").write_text("Video,GLOSS\nv1,dog\n")
    (tmp_path / "val.csv").write_text("video_id,gloss\nv2,cat\n")
    got = M.read_split_csvs(spark, [str(tmp_path / "train.csv"), str(tmp_path / "val.csv")], {"id": ["video_id", "Video"], "gloss": ["gloss"]}).collect()
    assert {tuple(r) for r in got} == {("v1", "dog", "train"), ("v2", "cat", "val")}
    (tmp_path / "g.json").write_text(json.dumps([{"gloss": "dog", "instances": [{"video_id": "1", "url": "u"}, {"video_id": "", "url": "u"}]}]))
    assert M.read_gloss_instances(spark, str(tmp_path / "g.json")).count() == 1
    (tmp_path / "v.md").write_text("| # | Gloss |\n|--|--|\n| 1 | THANK-YOU | x |\n")
    assert M.read_markdown_vocab(spark, str(tmp_path / "v.md")).first().slug == "thank_you"
    (tmp_path / "w.txt").write_text("a/b.jpg\n2\n1 2 3 4 0 0 0 0\n1 2 0 4 0 0 0 0\nc.jpg\n0\n0 0 0 0 0 0 0 0\nd.jpg\n1\n5 6 7 8 0 0 0 1\n")
    assert [tuple(r) for r in M.read_block_text_boxes(spark, str(tmp_path / "w.txt")).collect()] == [("a/b.jpg", 0, 1.0, 2.0, 3.0, 4.0)]
    (tmp_path / "l.txt").write_text(" ".join(str(i) for i in range(206)) + " img.png\nshort line\n")
    assert M.read_landmark_lines(spark, str(tmp_path / "l.txt")).first().rect == [196.0, 197.0, 198.0, 199.0]
    seeds = spark.createDataFrame([("('a','b','c'), ('d', 'e', 'f')",)], "t string").select(F.inline(M.parse_seed_values(F.col("t"))))
    assert [tuple(r) for r in seeds.collect()] == [("a", "b", "c"), ("d", "e", "f")]
    folder = tmp_path / "files"
    folder.mkdir()
    (folder / "x.bin").write_bytes(b"hello")
    want = spark.createDataFrame([("x.bin", hashlib.sha256(b"hello").hexdigest().upper())], "file string, sha256 string")
    assert M.verify_checksums(spark, str(folder), want).first().ok
    tree = tmp_path / "tree" / "dog"
    tree.mkdir(parents=True)
    (tree / "1.json").write_text(json.dumps({"clip_path": "p", "fps": 25.0, "frames": [{"frame_idx": 0}, {"frame_idx": 1}]}))
    (tree / "2.json").write_text(json.dumps({"clip_path": "q", "frames": [{"frame_idx": 0}]}))
    assert [r.sign for r in M.read_trajectories(spark, str(tmp_path / "tree")).collect()] == ["dog"]


def test_mastery_stream_equals_fold(spark, sf_dir, tmp_path):
    from lernspur.plans.views import attempts

    log = attempts(spark, sf_dir).orderBy("submitted_at", "event_id")
    rows = log.select("event_id", "user_id", "vocab_id", "submitted_at", "passed").collect()
    schema = "event_id long, user_id long, vocab_id long, submitted_at timestamp, passed boolean"
    half = len(rows) // 2
    for i, part in enumerate((rows[:half], rows[half:])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / f"in/part{i}"))
    got = {}

    def keep(batch, _):
        for r in batch.collect():
            got[r.user_id, r.vocab_id] = r

    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).option("latestFirst", False).parquet(str(tmp_path / "in"))
    query = mastery_stream(source).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    want = learner.mastery_fold(log).collect()
    assert len(got) == len(want) and sum(r.rejected for r in got.values()) == 0
    for r in want:
        s = got[r.user_id, r.vocab_id]
        assert (s.status, s.consecutive_passes, s.total_attempts, s.total_passes, s.next_review_at) == (r.status, r.consecutive_passes, r.total_attempts, r.total_passes, r.next_review_at)
        assert s.ease == pytest.approx(r.ease) and s.interval_days == pytest.approx(r.interval_days)


def test_ema_stream(spark, tmp_path):
    rows = [(1, t, None if t in (3, 4) else float(t)) for t in range(8)]
    spark.createDataFrame(rows, "g long, t long, v double").coalesce(1).write.parquet(str(tmp_path / "in"))
    got = []
    source = spark.readStream.schema("g long, t long, v double").parquet(str(tmp_path / "in"))
    query = ema_stream(source, "g", "t", "v").writeStream.outputMode("append").foreachBatch(lambda b, _: got.extend(b.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    s, want = None, []
    for _, _, v in rows:
        s = s if v is None else v if s is None else s + (v - s) * 0.4
        want.append(s)
    assert [r.smooth for r in sorted(got, key=lambda r: r.t)] == pytest.approx(want)


def test_lexicon_and_vocabulary(spark, tmp_path):
    (tmp_path / "lex.csv").write_bytes("Code,EntryID,Handshape.2.0\nA_1,dog,é\nA_2,dog,5\n ,cat,b\nA_1,wolf,c\n".encode("latin-1"))
    lexicon = M.read_lexicon_csv(spark, str(tmp_path / "lex.csv"))
    by_entry = {r.lexicon_key: (r["Handshape.2.0"], r.variants) for r in M.lexicon_by(lexicon, "EntryID").collect()}
    assert by_entry == {"dog": ("é", 2), "cat": ("b", 1), "wolf": ("c", 1)}
    assert {r.lexicon_key: r["Handshape.2.0"] for r in M.lexicon_by(lexicon, "Code", last=True).collect()} == {"A_1": "c", "A_2": "5"}
    (tmp_path / "v.md").write_text("| 1 | DOG |\n| 2 | CAT |\n")
    assert M.read_markdown_vocab(spark, str(tmp_path / "v.md"), 2).count() == 2
    with pytest.raises(ValueError, match="2 rows"):
        M.read_markdown_vocab(spark, str(tmp_path / "v.md"), 96)
    (tmp_path / "label.csv").write_text("label,label_type,id\ndog,gloss,1\n,gloss,2\nx.y,gloss,3\ncat,freetext,4\n")
    assert [r.id for r in M.read_label_csv(spark, str(tmp_path / "label.csv")).collect()] == ["1"]


def test_points_of_subsets_by_tag(spark, tmp_path):
    from lernspur.operators import landmarks
    from lernspur.sources import annotations

    points = [[float(i), 2.0, 1.0] for i in range(21)]
    for folder in ("manual", "multi", "other"):
        (tmp_path / folder).mkdir()
    (tmp_path / "manual/one.json").write_text(json.dumps({"hand_pts": points, "is_left": 0}))
    root = [{"img_paths": "a.jpg", "img_width": 9, "img_height": 8, "joint_self": points}, {"img_paths": "b.jpg", "joint_self": points}, {"img_paths": "c.jpg", "joint_self": points[:5]}, {"joint_self": points}, {"img_paths": "", "joint_self": points}]
    (tmp_path / "multi/hands_v1.json").write_text(json.dumps({"root": root}))
    (tmp_path / "other/two.json").write_text(json.dumps({"hand_pts": points}))
    subsets = {"manual": "manual", "multiview": "multi", "synth": "absent", "other": "other"}
    got = annotations.read_point_subsets(spark, str(tmp_path), subsets, ["manual", "multiview", "synth", "unknown"]).collect()
    assert sorted((r.tag, r.image, r.width, r.height, r.keypoints[3].x) for r in got) == [("manual", "one", 0, 0, 3.0), ("multiview", "a.jpg", 9, 8, 3.0), ("multiview", "b.jpg", 0, 0, 3.0)]
    names = spark.createDataFrame([("x/dog__c1_f003.jpg",), ("cat-7.mp4",)], "p string")
    found = [tuple(r) for r in names.select(F.inline(F.array(landmarks.parts_by_pattern(F.col("p"), r"^([a-z]+)__(.*)_f(\d+)$", {"sign": 1, "frame": 3, "clip": "clip"})))).collect()]
    assert found == [("dog", "003", "dog__c1"), (None, None, "cat-7")]


def test_a_lone_clip_is_its_medoid(spark):
    from lernspur.operators import trajectory

    df = spark.createDataFrame([(1, "a", [[1.0]]), (2, "b", [[1.0]]), (3, "b", [[2.0]]), (4, "b", [[1.4]])], "clip int, sign string, traj array<array<double>>")
    assert {r.sign: r.clip for r in trajectory.medoid(df).collect()} == {"a": 1, "b": 4}
