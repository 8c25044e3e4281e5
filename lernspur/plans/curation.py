"""Splits with caps, drop counts, thin signs over manifests, lesson orders, paired runs, releases and image items, over stand-ins."""

from __future__ import annotations

from pyspark.sql import functions as F

from lernspur.operators import boxes as B
from lernspur.operators import corpus as C
from lernspur.operators import evaluation as E
from lernspur.operators import landmarks as L
from lernspur.operators import learner as R
from lernspur.plans.boxes import DETS_SQL, dets
from lernspur.plans.corpus import H
from lernspur.plans.evaluation import PER, _logits, _preds, slices
from lernspur.plans.landmarks import QUERIES as SIGNALS
from lernspur.plans.landmarks import noise
from lernspur.plans.learner import history
from lernspur.plans.views import ATTEMPTS, BOXES, CLIPS, SCORES, STATES, attempts, boxes, clips, scores, table


def capped(s, d):
    c = clips(s, d).select("clip_id", "sign", "signer")
    return C.split_groups_capped(c, "sign", "signer", "clip_id", 0.15, 60)


def with_extra(s, d):
    c = clips(s, d).select("clip_id")
    return C.split_modulo_with(c.where("clip_id % 3 > 0"), "clip_id", c.where("clip_id % 3 = 0"))


def cohort():
    return F.coalesce("signer", F.concat(F.lit("_anon_"), F.col("clip_id").cast("string")))


def attached(s, d):
    return C.attach_counts(table(s, d, "labels").select(F.col("doc_id").alias("clip_id")), clips(s, d).where("clip_id % 7 > 0"), "clip_id")


def thin(s, d):
    c = clips(s, d).withColumn("pair", F.concat_ws(":", "sign", "signer"))
    part = lambda r: c.where(F.col("clip_id") % 4 == r).groupBy("pair").agg(F.count("*").alias("n"))
    vocab = c.select("pair").distinct().union(s.createDataFrame([("xx:none",)], "pair string"))
    return C.still_thin([part(0), part(1)], [part(2)], vocab, "pair", 9)


def signs(s, d):
    return clips(s, d).groupBy("signer").agg(F.avg("n_chars").alias("accuracy"), F.min("sign").alias("category"), (F.count("*") % 2 == 0).alias("flag"))


def runs(s, d):
    """The run as it is, one that favours class 3, and one that favours class 5; the true score is the distance."""

    def run(favoured):
        x = _logits(s, d).withColumn("logit", F.when(F.col("class") == favoured, F.col("logit") + 1).otherwise(F.col("logit")))
        return x.groupBy("item", "label").agg(F.max_by("class", F.struct("logit", -F.col("class"))).alias("pred"), (-F.max(F.when(F.col("class") == F.col("label"), F.col("logit")))).alias("true_score"))

    return {"base": run(-1), "three": run(3), "five": run(5)}


def ablation(s, d):
    limits = table(s, d, "embeddings").select(F.col("label").cast("long").alias("class")).distinct().withColumn("threshold", 0.9 + F.col("class") / 200)
    return E.ablation_report(runs(s, d), "base", limits)


def changes(s, d):
    r = runs(s, d)
    return E.ablation_items(r["base"], r["three"])


def soft(s, d):
    p = _preds(s, d)
    a = attempts(s, d)
    hints = lambda keep: R.hint_efficacy(a.where(keep)).select(F.col("vocab_id").alias("label"), F.col("predicted").alias("pred"), "efficacy")
    facts = s.range(1).select(F.lit(300.0).alias("before"), F.lit(501.0).alias("after"))
    return E.soft_report((F.col("before"), F.col("after")), facts, (hints(F.col("event_id") % 2 == 0), hints(F.col("event_id") % 2 == 1)), E.confusion_matrix(p), (E.per_class(p), E.per_class(p.where("item % 3 <> 0")))).withColumns({c: F.round(c, 9) for c in ("before", "after")})


def mastery_times(s, d):
    users = attempts(s, d).select("user_id").distinct().select("user_id", F.when(F.col("user_id") % 5 > 0, F.col("user_id") % 5).alias("bucket"))
    return R.time_to_mastery_by(history(s, d), users, "bucket")


def released(s, d):
    models = table(s, d, "supplier").select(F.col("s_suppkey").alias("model_id"), F.col("s_name").alias("url"), (F.col("s_suppkey") == 1).alias("is_active"), F.lit(None).cast("timestamp").alias("promoted_at"))
    new = s.range(1).select(F.lit(7).cast("long").alias("model_id"), F.lit(None).cast("string").alias("url"))
    return R.release(models, new, F.lit("2024-01-01 00:00:00").cast("timestamp"))


def ranges(s, d):
    l = table(s, d, "lineitem")  # noqa: E741
    return R.check_ranges(l, {"l_linenumber": (1, 6), "l_tax": (0.0, 0.05)}, {"active": F.col("l_orderkey") == 1})


def signals(s, d):
    return R.rollback_report(attempts(s, d).withColumn("disagreed", F.when(F.col("event_id") % 6 > 0, F.col("event_id") % 11 == 0)))


def image_items(s, d):
    b = boxes(s, d).groupBy("frame").agg(F.array_sort(F.collect_list(F.struct("box", F.array(F.col("x0"), F.col("y0"), F.col("x0") + F.col("w"), F.col("y0") + F.col("h")).alias("b")))).alias("all"))
    made = b.select("frame", F.when(F.col("frame") % 11 == 0, 0).otherwise(30).alias("width"), F.lit(30).alias("height"), F.when(F.col("frame") % 13 == 0, F.array().cast("array<array<double>>")).otherwise(F.transform("all", lambda x: x["b"])).alias("bboxes"))
    return B.clip_items(made).select("frame", F.size("bboxes").alias("n"), F.round(F.aggregate(F.flatten("bboxes"), F.lit(0.0), lambda s, v: s + v), 6).alias("total"))


def crop_rows(s, d):
    """Orders are clips of one tracked frame a line, at 10 frames a second of 160 x 120; the source has 25 of 320 x 240."""
    l = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax", "l_discount").repartition("l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(*[F.min(c).alias(c) for c in ("l_quantity", "l_tax", "l_discount")])  # noqa: E741
    x, y = F.col("l_quantity").cast("double"), F.col("l_linenumber") * 10.0
    box = F.array(x, y, x + F.round(F.col("l_tax") * 1000, 0), y + F.round(F.col("l_discount") * 1000, 0))
    frames = l.groupBy(F.col("l_orderkey").alias("clip")).agg(F.collect_list(F.struct(F.col("l_linenumber").cast("int").alias("frame_idx"), F.array(F.struct(box.alias("bbox"))).alias("hands"))).alias("frames"))
    return B.crop_records(frames.select("clip", F.lit(10.0).alias("fps"), F.when(F.col("clip") % 5 > 0, 25.0).alias("source_fps"), F.array(F.lit(160.0), F.lit(120.0)).alias("frame_size"), F.lit(320).alias("source_width"), F.lit(240).alias("source_height"), "frames"))


def forward(s, d):
    p = table(s, d, "embeddings").select("vec_id", (F.col("vec_id") / 5).cast("long").alias("clip"), F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: F.transform(F.slice("embedding", i * 3 + 1, F.lit(3)), lambda v: v.cast("double"))).alias("points"))
    return L.face_forward(p, "clip", (4, 9)).select("vec_id", F.posexplode("points").alias("i", "p")).select("vec_id", "i", F.round(F.col("p")[2], 9).alias("z"))


_RUNS = f"""{SCORES}, l AS (SELECT item, label, class, -distance AS logit FROM scores), runs AS (
    SELECT run, item, label, first(class ORDER BY logit + CASE WHEN class = fav THEN 1 ELSE 0 END DESC, class) AS pred, -max(logit + CASE WHEN class = fav THEN 1 ELSE 0 END) FILTER (WHERE class = label) AS score
    FROM l, (VALUES ('base', -1), ('three', 3), ('five', 5)) v(run, fav) GROUP BY 1, 2, 3),
    m AS (SELECT run, item, CAST(pred = label AS BIGINT) AS hit, CAST(score < 0.9::DOUBLE + label / 200 AS BIGINT) AS pass FROM runs)"""
_SIGNS = f"WITH {CLIPS}, g AS (SELECT signer, avg(n_chars) AS accuracy, min(sign) AS category, count(*) % 2 = 0 AS flag FROM clips GROUP BY 1)"
QUERIES = {
    "split_groups_capped": (capped, f"""WITH {CLIPS}, g AS (SELECT sign, signer, row_number() OVER (PARTITION BY sign ORDER BY {H.format('signer')}, signer) <= greatest(1, floor(count(*) OVER (PARTITION BY sign) * 0.15::DOUBLE)) AS val FROM (SELECT DISTINCT sign, signer FROM clips)),
        p AS (SELECT clip_id, sign, signer, CASE WHEN val THEN 'val' ELSE 'train' END AS split FROM clips JOIN g USING (sign, signer))
        SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY sign, split ORDER BY md5('42-rows|' || clip_id), clip_id) <= CASE WHEN split = 'val' THEN 12 ELSE 60 END"""),
    "split_modulo_extra": (with_extra, f"WITH {CLIPS} SELECT clip_id, CASE WHEN clip_id % 3 > 0 AND clip_id % 20 = 0 THEN 'val' ELSE 'train' END AS split, clip_id % 3 = 0 AS extra FROM clips"),
    "dedup_counts": (lambda s, d: C.dedup_counts(clips(s, d), cohort(), "hash"), f"WITH {CLIPS} SELECT count(*) AS kept, sum(n - 1)::BIGINT AS dropped FROM (SELECT count(*) AS n FROM clips GROUP BY coalesce(signer, '_anon_' || clip_id), hash)"),
    "attach_counts": (attached, "SELECT count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM documents WHERE doc_id % 7 > 0)) AS matched, count(*) FILTER (WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 7 > 0)) AS unmatched FROM labels"),
    "still_thin": (thin, f"""WITH {CLIPS}, c AS (SELECT sign || ':' || signer AS pair, count(*) FILTER (WHERE clip_id % 4 < 2) AS n, count(*) FILTER (WHERE clip_id % 4 < 3) AS n_after FROM clips GROUP BY 1 UNION ALL SELECT 'xx:none', 0, 0)
        SELECT pair, n, n_after, 9 - n_after AS need, CAST(row_number() OVER (ORDER BY 9 - n_after DESC, pair) AS INTEGER) AS place FROM c WHERE n < 9 AND n_after < 9"""),
    "lesson_groups_last": (lambda s, d: C.lesson_groups_last(signs(s, d), "accuracy", F.col("flag"), "signer", 6), f"{_SIGNS} SELECT *, CAST((row_number() OVER (ORDER BY CAST(flag AS INTEGER), accuracy DESC, signer) - 1) // 6 + 1 AS INTEGER) AS lesson FROM g"),
    "lesson_groups_by_category": (lambda s, d: C.lesson_groups_by_category(signs(s, d), "accuracy", "category", F.col("flag"), "signer", 6), f"{_SIGNS} SELECT signer, accuracy, category, flag, CAST((row_number() OVER (ORDER BY m DESC, category NULLS FIRST, CAST(NOT flag AS INTEGER), accuracy DESC, signer) - 1) // 6 + 1 AS INTEGER) AS lesson FROM (SELECT *, avg(accuracy) OVER (PARTITION BY category) AS m FROM g)"),
    "ablation_report": (ablation, f"""WITH {_RUNS} SELECT v.run AS variant, count(*) AS n, sum(b.hit)::BIGINT AS base_correct, sum(b.pass)::BIGINT AS base_passed, sum(v.hit)::BIGINT AS variant_correct, sum(v.pass)::BIGINT AS variant_passed, count(*) FILTER (WHERE v.hit > b.hit) AS won, count(*) FILTER (WHERE v.hit < b.hit) AS lost,
        sum(v.hit - b.hit)::BIGINT AS lift, sum(v.pass - b.pass)::BIGINT AS pass_lift FROM m b JOIN m v USING (item) WHERE b.run = 'base' AND v.run <> 'base' GROUP BY 1"""),
    "ablation_items": (changes, f"WITH {_RUNS} SELECT item, b.label, b.pred AS base_pred, v.pred AS variant_pred, CASE WHEN v.pred = b.label AND b.pred <> b.label THEN 'lift' WHEN b.pred = b.label AND v.pred <> b.label THEN 'regress' END AS change FROM runs b JOIN runs v USING (item) WHERE b.run = 'base' AND v.run = 'three'"),
    "slice_summary": (lambda s, d: E.slice_summary(slices(s, d), scores(s, d)).withColumns({c: F.round(c, 9) for c in ("mean", "best", "worst", "global_top1")}), f"""WITH {SCORES}, sl AS (SELECT DISTINCT i // 4 AS slice, (i * 7 + i // 4) % 10 AS class FROM (SELECT unnest(range(40)) AS i)),
        b AS (SELECT a.slice, item, label, first(a.class ORDER BY distance, a.class) AS pred FROM scores s JOIN sl a ON a.class = s.class JOIN sl b ON b.slice = a.slice AND b.class = s.label GROUP BY 1, 2, 3), t AS (SELECT slice, avg(CAST(label = pred AS INTEGER)) AS top1 FROM b GROUP BY 1), w AS (SELECT item, label, first(class ORDER BY distance, class) AS pred FROM scores GROUP BY 1, 2)
        SELECT count(*) AS slices, round(avg(top1), 9) AS mean, round(max(top1), 9) AS best, round(min(top1), 9) AS worst, (SELECT round(avg(CAST(label = pred AS INTEGER)), 9) FROM w) AS global_top1 FROM t"""),
    "soft_report": (soft, f"""WITH {PER}, {ATTEMPTS}, x AS (SELECT vocab_id, predicted, event_id % 2 AS half, passed, lead(passed) OVER (PARTITION BY event_id % 2, user_id, vocab_id ORDER BY submitted_at, event_id) AS nx FROM attempts),
        h AS (SELECT vocab_id AS label, predicted AS pred, half, avg(CAST(nx AS INTEGER)) AS e FROM x WHERE NOT passed AND nx IS NOT NULL GROUP BY 1, 2, 3), t AS (SELECT label, pred FROM conf WHERE label <> pred ORDER BY n DESC, label, pred LIMIT 10),
        r AS (SELECT label AS class, avg(CAST(label = pred AS INTEGER)) AS r FROM preds WHERE item % 3 <> 0 GROUP BY 1)
        SELECT 'latency' AS rule, '' AS key, 300.0::DOUBLE AS before, 501.0::DOUBLE AS after UNION ALL SELECT 'hint_efficacy', t.label || '>' || t.pred, round(a.e, 9), round(b.e, 9) FROM t JOIN h a ON a.label = t.label AND a.pred = t.pred AND a.half = 0 JOIN h b ON b.label = t.label AND b.pred = t.pred AND b.half = 1 WHERE a.e - b.e > 0.05::DOUBLE
        UNION ALL SELECT 'recall', CAST(class AS VARCHAR), round(recall, 9), round(r, 9) FROM percl JOIN r USING (class) WHERE recall - r > 0.05::DOUBLE"""),
    "time_to_mastery_by": (mastery_times, f"WITH RECURSIVE {STATES}, m AS (SELECT user_id, epoch_us(min(last_attempt_at) FILTER (WHERE status = 'mastered')) - epoch_us(min(last_attempt_at)) AS micros FROM fold WHERE n > 0 GROUP BY user_id, vocab_id HAVING micros IS NOT NULL) SELECT CASE WHEN user_id % 5 > 0 THEN user_id % 5 END AS bucket, count(*) AS n, avg(micros) AS micros FROM m GROUP BY 1"),
    "release_model": (released, "SELECT s_suppkey AS model_id, s_name AS url, s_suppkey = 7 AS is_active, CASE WHEN s_suppkey = 7 THEN TIMESTAMP '2024-01-01 00:00:00' END AS promoted_at FROM supplier"),
    "range_checks": (ranges, "SELECT 'range l_linenumber' AS rule, count(*) FILTER (WHERE l_linenumber NOT BETWEEN 1 AND 6) AS violations FROM lineitem UNION ALL SELECT 'range l_tax', count(*) FILTER (WHERE l_tax NOT BETWEEN 0 AND 0.05::DOUBLE) FROM lineitem UNION ALL SELECT 'one active', greatest(count(*) FILTER (WHERE l_orderkey = 1) - 1, 0) FROM lineitem"),
    "rollback_report": (signals, f"""WITH {ATTEMPTS}, t AS (SELECT model_id, CAST(submitted_at AS DATE) AS day, count(*) AS n, avg(CAST(passed AS INTEGER)) AS pass_rate, avg(CAST(coalesce(CASE WHEN event_id % 6 > 0 THEN event_id % 11 = 0 END, false) AS INTEGER)) AS disagreed FROM attempts GROUP BY 1, 2)
        SELECT *, pass_rate - lag(pass_rate) OVER w AS pass_rate_change, disagreed - lag(disagreed) OVER w AS disagreed_change FROM t WINDOW w AS (PARTITION BY model_id ORDER BY day)"""),
    "clip_items": (image_items, f"""WITH {BOXES}, i AS (SELECT frame, frame % 11 = 0 AS unknown, x0, y0, x0 + w AS x1, y0 + h AS y1 FROM boxes WHERE frame % 13 > 0),
        c AS (SELECT frame, unknown, CASE WHEN unknown THEN x0 ELSE greatest(0, least(x0, 30)) END AS x0, CASE WHEN unknown THEN y0 ELSE greatest(0, least(y0, 30)) END AS y0, CASE WHEN unknown THEN x1 ELSE greatest(0, least(x1, 30)) END AS x1, CASE WHEN unknown THEN y1 ELSE greatest(0, least(y1, 30)) END AS y1 FROM i)
        SELECT frame, CAST(count(*) AS INTEGER) AS n, round(sum(x0 + y0 + x1 + y1), 6) AS total FROM c WHERE unknown OR (x1 - x0 >= 1 AND y1 - y0 >= 1) GROUP BY 1 UNION ALL SELECT DISTINCT frame, 0, 0.0::DOUBLE FROM boxes WHERE frame % 13 = 0"""),
    "temporal_filter_least": (lambda s, d: B.temporal_filter_least(dets(s, d), 12.0, 40).select("clip", "t"), f"WITH {DETS_SQL}, w AS (SELECT *, count(*) OVER (PARTITION BY clip) AS n, coalesce(abs(x - lag(x) OVER o) <= 12 AND abs(y - lag(y) OVER o) <= 12, false) OR coalesce(abs(x - lead(x) OVER o) <= 12 AND abs(y - lead(y) OVER o) <= 12, false) AS near FROM dets WINDOW o AS (PARTITION BY clip ORDER BY t)) SELECT clip, t FROM w WHERE near OR n = 1 QUALIFY count(*) OVER (PARTITION BY clip) >= 40"),
    "crop_records": (crop_rows, """WITH b AS (SELECT l_orderkey AS clip, l_linenumber AS i, l_quantity AS x0, l_linenumber * 10.0::DOUBLE AS y0, l_quantity + round(l_tax * 1000) AS x1, l_linenumber * 10.0::DOUBLE + round(l_discount * 1000) AS y1, CAST(round_even(l_linenumber * CASE WHEN l_orderkey % 5 > 0 THEN 25.0::DOUBLE ELSE 30.0::DOUBLE END / 10, 0) AS BIGINT) AS source_frame FROM (SELECT l_orderkey, l_linenumber, min(l_quantity) AS l_quantity, min(l_tax) AS l_tax, min(l_discount) AS l_discount FROM lineitem GROUP BY 1, 2)),
        k AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY clip, source_frame ORDER BY i DESC) = 1), m AS (SELECT *, 0.15::DOUBLE * greatest((x1 - x0) * 2, (y1 - y0) * 2) AS m FROM k),
        c AS (SELECT clip, source_frame, greatest(0, round_even(x0 * 2 - m, 0))::INTEGER AS cx0, greatest(0, round_even(y0 * 2 - m, 0))::INTEGER AS cy0, least(320, round_even(x1 * 2 + m, 0))::INTEGER AS cx1, least(240, round_even(y1 * 2 + m, 0))::INTEGER AS cy1 FROM m)
        SELECT clip, source_frame, 0 AS hand, cx0, cy0, cx1, cy1 FROM c WHERE cx1 - cx0 >= 8 AND cy1 - cy0 >= 8"""),
    "signal_verdict": (lambda s, d: L.signal_verdict(noise(s, d)), f"SELECT *, coalesce(mean_spread > 0.2::DOUBLE AND mean_ratio < 0.6::DOUBLE AND mean_valid > 0.6::DOUBLE, false) AS usable FROM (SELECT count(*) AS signs, round(sum(round(spread * 1000)::BIGINT) / count(spread)) / 1000 AS mean_spread, round(sum(round(ratio * 1000)::BIGINT) / count(ratio)) / 1000 AS mean_ratio, round(sum(round(valid * 1000)::BIGINT) / count(valid)) / 1000 AS mean_valid FROM ({SIGNALS['signal_noise'][1]}) WHERE spread IS NOT NULL)"),
    "face_forward": (forward, "WITH z AS (SELECT vec_id, vec_id // 5 AS clip, i, embedding[i * 3 + 3]::DOUBLE AS z FROM embeddings, range(21) r(i)), m AS (SELECT clip, avg(z) FILTER (WHERE i = 4) + avg(z) FILTER (WHERE i = 9) AS s FROM z GROUP BY 1) SELECT vec_id, CAST(i AS INTEGER) AS i, round(z * CASE WHEN s < 0 THEN -0.35::DOUBLE ELSE 0.35::DOUBLE END, 9) AS z FROM z JOIN m USING (clip)"),
}
