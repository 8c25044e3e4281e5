"""Trajectory and matching queries over embeddings (8 steps of 8 features) and event series."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from lernspur.operators import frames as Fr
from lernspur.operators import matching as M
from lernspur.operators import trajectory as T
from lernspur.plans.views import rounded_size, table
from lernspur.streaming import matcher


def trajs(s, d):
    e = table(s, d, "embeddings")
    masked = F.transform("embedding", lambda v, i: F.when(i % 13 != F.col("vec_id") % 13, v.cast("double")))
    rows = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda t: F.slice(masked, t * 8 + 1, 8))
    return e.select(F.col("vec_id").alias("clip"), F.col("label").cast("long").alias("sign"), rows.alias("traj"))


def series(s, d):
    return table(s, d, "events").select("user_id", "ts", "event_id", F.when(F.col("event_type") != "error", F.col("value")).alias("v"))


def _long(df, *cols):
    return T.long_form(df).select("clip", "t", "f", F.round("v", 9).alias("v"))


def mirrored(s, d):
    return _long(trajs(s, d).withColumn("traj", T.mirror(F.col("traj"), [4, 5, 6, 7, 0, 1, 2, 3], [-1.0, 1.0] * 4)))


def templates(s, d):
    return T.template_arrays(T.fit_gaussian(trajs(s, d)))


def one_handed_scores(s, d):
    flags = T.motion_ratio(trajs(s, d).withColumn("traj", T.to_dense(F.col("traj"))), 4, 1.0)
    return T.gaussian_scores(trajs(s, d), T.mask_other_hand(templates(s, d), flags, 4, 7)).withColumn("score", F.round("score", 7))


def keyed(s, d):
    c = table(s, d, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 3 == 0, F.length("text").cast("double")).alias("v"))
    return T.interpolate_keys(c, "conv_id", "turn", "v").select("conv_id", "turn", F.round("filled", 9).alias("filled"))


def framed(s, d):
    """Frames of two hands and a pose, made of a vector's 64 values: hand h has point i at values 17 h + 2 i and the next, the pose point p at 40 + 2 p; every fifth vector has one hand, every seventh no neck."""
    e = table(s, d, "embeddings")
    value = lambda i: F.get("embedding", F.pmod(i, F.lit(64))).cast("double") * 100
    points = lambda at, n: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.array(value(i * 2 + at), value(i * 2 + at + 1)))
    hand = lambda h: F.struct(points(17 * h, 21).alias("keypoints"), F.lit(None).cast("array<float>").alias("embedding"))
    hands = F.when(F.col("vec_id") % 5 == 0, F.array(hand(0))).otherwise(F.array(hand(0), hand(1)))
    pose = F.transform(points(40, 8), lambda p, i: F.when((F.col("vec_id") % 7 == 0) & (i == 1), F.array(F.lit(0.0), F.lit(0.0))).otherwise(p))
    return e.select("vec_id", F.struct(hands.alias("hands"), pose.alias("pose")).alias("frame"))


def frame_rows(s, d, layout):
    x = framed(s, d).select("vec_id", Fr.frame_features(F.col("frame"), layout).alias("x"), Fr.uses_second_hand(F.col("frame")).alias("second"))
    return x.select("vec_id", "second", F.posexplode("x").alias("f", "v")).withColumn("v", F.round("v", 7))


HALVES = ([4, 5, 6, 7, 0, 1, 2, 3], [-1.0, 1.0] * 4)


def fitted(s, d):
    return M.fit_templates(trajs(s, d), half=4, until=8, clusters=2)


def matched(s, d):
    return M.match_scores(trajs(s, d), fitted(s, d), HALVES, (4, 7)).withColumn("score", F.round("score", 7))


def stepped(s, d):
    """Every vector is eight frames of a session of ten vectors; the target is the vector's label, the slice three signs."""
    t = trajs(s, d).select((F.col("clip") / 10).cast("long").alias("session"), "clip", "sign", F.posexplode("traj").alias("at", "features"))
    slices = F.transform(F.array(F.lit(0), F.lit(3), F.lit(7)), lambda i: (F.col("sign") + i) % 10)
    rows = t.withColumn("t", F.col("clip") * 8 + F.col("at")).select("session", "t", F.col("sign").alias("target"), F.when(F.col("t") % 11 > 0, F.col("features")).alias("features"), slices.alias("slice"))
    limits = table(s, d, "embeddings").select(F.col("label").cast("long").alias("sign")).distinct().withColumn("threshold", 0.9 + F.col("sign") / 50)
    steps = matcher.match_steps(rows, fitted(s, d), limits, matcher.MatchConfig(8, 12, 3, HALVES, (4, 7), columns=("session", "t", "target", "features", "slice")))
    return steps.select("session", "t", "target", "ready", F.size("scores").alias("scored"), "passed", "streak", "unlocked", "top1", F.round("top1_score", 7).alias("top1_score"))


def medoid_sums(s, d):
    return M.kmedoids(trajs(s, d), 3).select("clip", "sign", "cluster", "is_medoid")


FLAT = "flat AS (SELECT vec_id AS clip, CAST(label AS BIGINT) AS sign, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), lng AS (SELECT clip, sign, CAST(i // 8 AS INTEGER) AS t, CAST(i % 8 AS INTEGER) AS f, CASE WHEN i % 13 <> clip % 13 THEN x END AS v FROM flat)"
GAUSS = f"{FLAT}, gauss AS (SELECT sign, t, f, avg(v) AS mean, greatest(var_pop(v), 0.001) AS var FROM lng GROUP BY 1, 2, 3)"
PAIRS = f"{FLAT}, pairs AS (SELECT a.sign, a.clip AS a, b.clip AS b, avg((a.v - b.v) * (a.v - b.v)) AS distance FROM lng a JOIN lng b ON a.sign = b.sign AND a.t = b.t AND a.f = b.f AND a.clip < b.clip GROUP BY 1, 2, 3)"
#: Costs of all steps of ``views`` against all steps of ``gauss``, and the warping path's sums cell by cell, row by row (a band of 8 is all of 8 steps).
WARP = """cost AS (SELECT x.clip, x.sign AS label, g.sign, image, x.t AS i, g.t AS j, coalesce(avg((x.v - g.mean) * (x.v - g.mean) / g.var), 1e9) AS c FROM views x JOIN gauss g USING (f) GROUP BY 1, 2, 3, 4, 5, 6),
    k AS (SELECT clip, label, sign, image, list(c ORDER BY i, j) AS c FROM cost GROUP BY 1, 2, 3, 4),
    d AS (SELECT *, 0 AS s, []::DOUBLE[] AS w FROM k UNION ALL
          SELECT clip, label, sign, image, c, s + 1, list_append(w, c[s + 1] + CASE WHEN s = 0 THEN 0 ELSE least(CASE WHEN s >= 8 THEN w[s - 7] ELSE 'inf'::DOUBLE END, CASE WHEN s % 8 > 0 THEN w[s] ELSE 'inf'::DOUBLE END, CASE WHEN s >= 8 AND s % 8 > 0 THEN w[s - 8] ELSE 'inf'::DOUBLE END) END) FROM d WHERE s < 64)"""
SER = "ser AS (SELECT user_id, ts, event_id, CASE WHEN event_type <> 'error' THEN value END AS v FROM events)"
QUERIES = {
    "valid_trajectory": (lambda s, d: T.valid_trajectory(trajs(s, d)).select("clip"), f"WITH {FLAT} SELECT DISTINCT clip FROM lng WHERE v IS NOT NULL"),
    "to_dense": (lambda s, d: _long(trajs(s, d).withColumn("traj", T.to_dense(F.col("traj")))), f"WITH {FLAT} SELECT clip, t, f, round(coalesce(v, 0), 9) AS v FROM lng"),
    "strip_features": (lambda s, d: _long(trajs(s, d).withColumn("traj", T.strip_features(F.col("traj"), 2, 5))), f"WITH {FLAT} SELECT clip, t, f, round(CASE WHEN f BETWEEN 2 AND 5 THEN 0 ELSE v END, 9) AS v FROM lng"),
    "mirror": (mirrored, f"WITH {FLAT} SELECT clip, t, (f + 4) % 8 AS f, round(CASE WHEN f % 2 = 0 THEN -v ELSE v END, 9) AS v FROM lng"),
    "resample": (lambda s, d: _long(T.resample(trajs(s, d), 15)), f"""WITH {FLAT}, g AS (SELECT unnest(range(15)) AS k), p AS (SELECT clip, f, k, k * 7.0::DOUBLE / 14 AS x FROM (SELECT DISTINCT clip, f FROM lng), g),
        b AS (SELECT p.clip, p.f, p.k, p.x, max(t) FILTER (WHERE t <= x) AS lo, min(t) FILTER (WHERE t >= x) AS hi FROM p JOIN lng l ON l.clip = p.clip AND l.f = p.f AND v IS NOT NULL GROUP BY 1, 2, 3, 4)
        SELECT b.clip, CAST(b.k AS INTEGER) AS t, b.f, round(CASE WHEN lo IS NULL THEN h.v WHEN hi IS NULL OR hi = lo THEN l.v ELSE l.v + (h.v - l.v) * (x - lo) / (hi - lo) END, 9) AS v
        FROM b LEFT JOIN lng l ON l.clip = b.clip AND l.f = b.f AND l.t = lo LEFT JOIN lng h ON h.clip = b.clip AND h.f = b.f AND h.t = hi"""),
    "fit_gaussian": (lambda s, d: T.fit_gaussian(trajs(s, d)).select("sign", "t", "f", F.round("mean", 9).alias("mean"), F.round("var", 9).alias("var")), f"WITH {GAUSS} SELECT sign, t, f, round(mean, 9) AS mean, round(var, 9) AS var FROM gauss"),
    "motion_ratio": (lambda s, d: T.motion_ratio(trajs(s, d).withColumn("traj", T.to_dense(F.col("traj"))), 4).withColumn("ratio", F.round("ratio", 9)), f"WITH {FLAT}, d AS (SELECT sign, clip, f, stddev_pop(coalesce(v, 0)) AS s FROM lng GROUP BY 1, 2, 3), r AS (SELECT sign, avg(s) FILTER (WHERE f >= 4) / greatest(avg(s) FILTER (WHERE f < 4), 1e-6) AS ratio FROM d GROUP BY 1) SELECT sign, round(ratio, 9) AS ratio, ratio < 0.3::DOUBLE AS one_handed FROM r"),
    "clip_pairs": (lambda s, d: T.pairwise(trajs(s, d)).withColumn("distance", rounded_size(F.col("distance"), 9)), f"WITH {PAIRS} SELECT sign, a, b, round(distance, 9) AS distance FROM pairs"),
    "medoid": (lambda s, d: T.medoid(trajs(s, d)).withColumn("total", F.round("total", 7)), f"WITH {PAIRS}, u AS (SELECT sign, a AS clip, distance FROM pairs UNION ALL SELECT sign, b, distance FROM pairs), t AS (SELECT sign, clip, sum(distance) AS total FROM u GROUP BY 1, 2) SELECT sign, first(clip ORDER BY total, clip) AS clip, round(min(total), 7) AS total FROM t GROUP BY 1"),
    "gaussian_scores": (lambda s, d: T.gaussian_scores(trajs(s, d), templates(s, d)).withColumn("score", F.round("score", 7)), f"WITH {GAUSS} SELECT l.clip, l.sign AS label, g.sign, round(avg((v - mean) * (v - mean) / var), 7) AS score FROM lng l JOIN gauss g USING (t, f) WHERE v IS NOT NULL GROUP BY 1, 2, 3"),
    "gaussian_predictions": (lambda s, d: T.predict(T.gaussian_scores(trajs(s, d), templates(s, d))).withColumn("confidence", F.round("confidence", 7)), f"WITH {GAUSS}, sc AS (SELECT l.clip, l.sign AS label, g.sign, avg((v - mean) * (v - mean) / var) AS score FROM lng l JOIN gauss g USING (t, f) WHERE v IS NOT NULL GROUP BY 1, 2, 3) SELECT clip, label, first(sign ORDER BY score, sign) AS best, round(max(exp(-score)) / sum(exp(-score)), 7) AS confidence FROM sc GROUP BY 1, 2"),
    "dtw_scores": (lambda s, d: M.dtw_scores(trajs(s, d), templates(s, d)).withColumn("score", F.round("score", 7)), f"WITH RECURSIVE {GAUSS}, views AS (SELECT clip, sign, 0 AS image, t, f, v FROM lng), {WARP} SELECT clip, label, sign, round(w[64] / 16, 7) AS score FROM d WHERE s = 64"),
    "forward_fill": (lambda s, d: T.forward_fill(series(s, d), "user_id", ["ts", "event_id"], "v").select("event_id", "filled"), f"WITH {SER} SELECT event_id, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id), first_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS filled FROM ser"),
    "interpolate_keys": (keyed, """WITH c AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN length(text)::DOUBLE END AS v FROM conversations), b AS (SELECT c.conv_id, c.turn, max(k.turn) FILTER (WHERE k.turn <= c.turn) AS lo, min(k.turn) FILTER (WHERE k.turn >= c.turn) AS hi FROM c JOIN c k ON k.conv_id = c.conv_id AND k.v IS NOT NULL GROUP BY 1, 2)
        SELECT b.conv_id, b.turn, round(CASE WHEN lo IS NULL THEN h.v WHEN hi IS NULL OR hi = lo THEN l.v ELSE l.v + (h.v - l.v) * (b.turn - lo) / (hi - lo) END, 9) AS filled FROM b LEFT JOIN c l ON l.conv_id = b.conv_id AND l.turn = lo LEFT JOIN c h ON h.conv_id = b.conv_id AND h.turn = hi"""),
    "median3": (lambda s, d: T.median3(series(s, d).where("v IS NOT NULL"), "user_id", ["ts", "event_id"], "v").select("event_id", "smooth"), f"WITH {SER}, n AS (SELECT event_id, v, lag(v) OVER w AS p, lead(v) OVER w AS n FROM ser WHERE v IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT event_id, CASE WHEN p IS NULL OR n IS NULL THEN v ELSE list_sort([p, v, n])[2] END AS smooth FROM n"),
    "ema": (lambda s, d: T.ema(series(s, d), "user_id", ["ts", "event_id"], "v").select("event_id", F.round("smooth", 9).alias("smooth")), f"""WITH RECURSIVE {SER}, o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM ser),
        e AS (SELECT user_id, event_id, n, v AS s, CASE WHEN v IS NULL THEN 1 ELSE 0 END AS m FROM o WHERE n = 1 UNION ALL SELECT o.user_id, o.event_id, o.n, CASE WHEN o.v IS NULL THEN CASE WHEN e.m + 1 > 8 THEN NULL ELSE e.s END WHEN e.s IS NULL THEN o.v ELSE e.s + (o.v - e.s) * 0.4::DOUBLE END, CASE WHEN o.v IS NULL THEN e.m + 1 ELSE 0 END FROM e JOIN o ON o.user_id = e.user_id AND o.n = e.n + 1) SELECT event_id, round(s, 9) AS smooth FROM e"""),
    "active_window": (lambda s, d: T.active_window(series(s, d), "user_id", ["ts", "event_id"], F.col("v") > 20).select("event_id"), f"WITH {SER}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM ser), w AS (SELECT *, min(n) FILTER (WHERE v > 20) OVER (PARTITION BY user_id) AS lo, max(n) FILTER (WHERE v > 20) OVER (PARTITION BY user_id) AS hi FROM n) SELECT event_id FROM w WHERE n BETWEEN lo AND hi"),
    "match_streaks": (lambda s, d: T.streaks(series(s, d), "user_id", ["ts", "event_id"], F.coalesce(F.col("v") <= 10, F.lit(False))).select("event_id", "streak", "unlocked"), f"WITH {SER}, h AS (SELECT *, coalesce(v <= 10, false) AS hit FROM ser), i AS (SELECT *, sum(CAST(NOT hit AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS isl FROM h), k AS (SELECT *, CAST(sum(CAST(hit AS INTEGER)) OVER (PARTITION BY user_id, isl ORDER BY ts, event_id) AS BIGINT) AS streak FROM i) SELECT event_id, streak, max(streak) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= 3 AS unlocked FROM k"),
    "drop_empty_steps": (lambda s, d: T.drop_empty_steps(series(s, d).withColumn("slot", F.col("event_id") % 700), "slot", F.col("v") > 60).select("event_id"), f"WITH {SER}, n AS (SELECT event_id, v, sum(CAST(v > 60 AS INTEGER)) OVER (PARTITION BY event_id % 700) AS n FROM ser) SELECT event_id FROM n WHERE v > 60 OR n < 2"),
    "trim_fraction": (lambda s, d: _long(trajs(s, d).withColumn("traj", T.trim_fraction(F.col("traj"), 0.2, 0.8))), f"WITH {FLAT} SELECT clip, CAST(t - 2 AS INTEGER) AS t, f, round(v, 9) AS v FROM lng WHERE t >= 2 AND t < 6"),
    "nearest_clip_scores": (lambda s, d: T.nearest_in_blocks(trajs(s, d), trajs(s, d)).withColumn("score", F.round("score", 7)), f"WITH {FLAT}, p AS (SELECT a.clip, a.sign, b.sign AS ref_sign, b.clip AS ref, avg((a.v - b.v) * (a.v - b.v)) / 0.05::DOUBLE AS s FROM lng a JOIN lng b ON a.t = b.t AND a.f = b.f AND a.clip <> b.clip GROUP BY 1, 2, 3, 4) SELECT clip, sign, ref_sign, round(min(s), 7) AS score FROM p GROUP BY 1, 2, 3"),
}

#: Second names of queries over whole tables, from when the first names read a part of them.
QUERIES |= {f"{name}_all": QUERIES[name] for name in ("forward_fill", "median3", "ema", "active_window", "match_streaks", "drop_empty_steps", "nearest_clip_scores")}
QUERIES["one_handed_scores"] = (one_handed_scores, f"""WITH {GAUSS}, d AS (SELECT sign, clip, f, stddev_pop(coalesce(v, 0)) AS s FROM lng GROUP BY 1, 2, 3), r AS (SELECT sign, avg(s) FILTER (WHERE f >= 4) / greatest(avg(s) FILTER (WHERE f < 4), 1e-6) < 1 AS one FROM d GROUP BY 1)
    SELECT l.clip, l.sign AS label, g.sign, round(avg((v - mean) * (v - mean) / var), 7) AS score FROM lng l JOIN gauss g USING (t, f) JOIN r ON r.sign = g.sign WHERE v IS NOT NULL AND (f < 4 OR NOT one) GROUP BY 1, 2, 3""")


def _at(sql):
    """``at(i)`` stands for value i of the vector, counted around, times 100."""
    return re.sub(r"\bat\(([^()]+)\)", r"(100 * e[(\1) % 64 + 1]::DOUBLE)", sql)


#: The features of the frames of ``framed`` by layout, one row a value: hands by slot, the nearer one where two meet.
FRAMED = _at("""e AS (SELECT vec_id, embedding AS e FROM embeddings),
    p AS (SELECT vec_id, e, CASE WHEN vec_id % 7 = 0 THEN (at(44) + at(46)) / 2 ELSE at(42) END AS ax, CASE WHEN vec_id % 7 = 0 THEN (at(45) + at(47)) / 2 ELSE at(43) END AS ay,
                 greatest(1, sqrt((at(44) - at(46)) ** 2 + (at(45) - at(47)) ** 2)) AS scale FROM e),
    h AS (SELECT *, CASE WHEN at(0) < ax THEN 0 ELSE 1 END AS s0, CASE WHEN vec_id % 5 = 0 THEN NULL WHEN at(17) < ax THEN 0 ELSE 1 END AS s1, abs(at(0) - ax) AS d0, abs(at(17) - ax) AS d1 FROM p),
    w AS (SELECT *, unnest([0, 1]) AS slot FROM h),
    o AS (SELECT *, CASE WHEN s0 = slot AND (s1 IS NULL OR s1 <> slot OR d1 >= d0) THEN 0 WHEN s1 = slot THEN 17 END AS base FROM w)""")
BODY = _at("""x AS (SELECT vec_id, slot * 42 + i AS f, CASE WHEN i % 2 = 0 THEN (at(base + i) - ax) / scale ELSE (at(base + i) - ay) / scale END AS v FROM (SELECT *, unnest(range(42)) AS i FROM o)),
    q AS (SELECT vec_id, 84 + i AS f, CASE WHEN vec_id % 7 = 0 AND i = 2 THEN -ax / scale WHEN vec_id % 7 = 0 AND i = 3 THEN -ay / scale WHEN i % 2 = 0 THEN (at(40 + i) - ax) / scale ELSE (at(40 + i) - ay) / scale END AS v FROM (SELECT *, unnest(range(16)) AS i FROM p))""")
HAND = _at("""k AS (SELECT *, sqrt((at(base + 18) - at(base)) ** 2 + (at(base + 19) - at(base + 1)) ** 2) AS palm FROM o),
    x AS (SELECT vec_id, slot * 46 + i AS f, CASE WHEN i < 42 THEN (at(base + i) - at(base + i % 2)) / palm WHEN i = 42 THEN (at(base) - ax) / scale WHEN i = 43 THEN (at(base + 1) - ay) / scale ELSE (at(base + i - 26) - at(base + i - 44)) / palm END AS v FROM (SELECT *, unnest(range(46)) AS i FROM k)),
    q AS (SELECT vec_id, 92 + i AS f, CASE WHEN vec_id % 7 = 0 AND i = 2 THEN -ax / scale WHEN vec_id % 7 = 0 AND i = 3 THEN -ay / scale WHEN i % 2 = 0 THEN (at(40 + i) - ax) / scale ELSE (at(40 + i) - ay) / scale END AS v FROM (SELECT *, unnest(range(16)) AS i FROM p))""")
SECOND = "z AS (SELECT vec_id, bool_or(base IS NOT NULL AND slot = 1) AS second FROM o GROUP BY 1) SELECT a.vec_id, second, CAST(f AS INTEGER) AS f, round(v, 7) AS v FROM (SELECT * FROM x UNION ALL SELECT * FROM q) a JOIN z USING (vec_id)"
QUERIES |= {
    "frame_features": (lambda s, d: frame_rows(s, d, "body"), f"WITH {FRAMED}, {BODY}, {SECOND}"),
    "frame_features_hand": (lambda s, d: frame_rows(s, d, "hand"), f"WITH {FRAMED}, {HAND}, {SECOND}"),
    "match_scores": (matched, None),
    "match_scores_whole": (lambda s, d: M.match_scores(trajs(s, d), M.fit_templates(trajs(s, d), half=4, until=8), HALVES, (4, 7)).withColumn("score", F.round("score", 7)), f"""WITH RECURSIVE {GAUSS.replace('gauss AS', 'plain AS')}, dev AS (SELECT sign, clip, f, stddev_pop(v) AS s FROM lng GROUP BY 1, 2, 3),
        one AS (SELECT sign, count(*) FILTER (WHERE s IS NULL) = 0 AND avg(s) FILTER (WHERE f >= 4) / greatest(avg(s) FILTER (WHERE f < 4), 1e-6) < 0.3::DOUBLE AS one FROM dev GROUP BY 1),
        gauss AS (SELECT sign, t, f, CASE WHEN NOT (one AND f >= 4) THEN mean END AS mean, var FROM plain JOIN one USING (sign)),
        views AS (SELECT clip, sign, 0 AS image, t, f, v FROM lng UNION ALL SELECT clip, sign, 1, t, (f + 4) % 8, CASE WHEN f % 2 = 0 THEN -v ELSE v END FROM lng), {WARP}
        SELECT clip, label, sign, round(min(w[64] / 16), 7) AS score, 'whole' AS route FROM d WHERE s = 64 GROUP BY 1, 2, 3"""),
    "match_steps": (stepped, None),
    "kmedoids": (medoid_sums, None),
}
