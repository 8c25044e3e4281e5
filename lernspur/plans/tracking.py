"""Tracking, smoothing, augmentation and expressive clips over stand-ins: order lines as hands, vectors as poses."""

from __future__ import annotations

from pyspark.sql import functions as F

from lernspur.operators import tracking as K
from lernspur.plans.trajectory import FLAT, HALVES, trajs
from lernspur.plans.views import table


def hands(s, d):
    """Orders are frames, 32 a clip; the lines of an order are hands of one keypoint."""
    l = table(s, d, "lineitem")  # noqa: E741
    x, y, w, h = F.col("l_quantity").cast("double"), F.col("l_linenumber") * 10.0, F.round(F.col("l_tax") * 1000, 0), F.round(F.col("l_discount") * 1000, 0)
    one = F.struct("l_linenumber", F.array(x, y, x + w, y + h).alias("bbox"), F.array(F.array(x, y)).alias("keypoints"))
    frames = l.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(one)).alias("all"))
    return frames.select((F.col("l_orderkey") / 32).cast("long").alias("clip"), F.col("l_orderkey").alias("t"), F.lit(160.0).alias("width"), F.lit(120.0).alias("height"), F.transform("all", lambda x: F.struct(x["bbox"].alias("bbox"), x["keypoints"].alias("keypoints"))).alias("hands"))


def tracked(s, d):
    seen = K.track_hands(hands(s, d)).select("clip", "t", F.explode("hands").alias("h"))
    return seen.select("clip", "t", "h.slot", F.get("h.bbox", F.lit(0)).alias("x0"), F.round(F.col("h.keypoints")[0][0], 7).alias("x"), F.round(F.col("h.keypoints")[0][1], 7).alias("y"))


def poses(s, d):
    """Four poses of 8 points a vector, two vectors a clip; the right wrist of every ninth vector is not seen."""
    e = table(s, d, "embeddings")
    value = lambda t, i: F.get("embedding", t * 16 + i).cast("double")
    point = lambda t, p: F.when((F.col("vec_id") % 9 == 0) & (p == 6), F.array(F.lit(0.0), F.lit(0.0))).otherwise(F.array(value(t, p * 2), value(t, p * 2 + 1)))
    steps = e.select("vec_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("at"), "embedding")
    return steps.select((F.col("vec_id") / 2).cast("long").alias("clip"), (F.col("vec_id") * 4 + F.col("at")).alias("t"), F.transform(F.sequence(F.lit(0), F.lit(7)), lambda p: point(F.col("at"), p)).alias("pose"))


def expressive(s, d):
    clips = poses(s, d).groupBy("clip").agg(F.array_sort(F.collect_list(F.struct("t", "pose"))).alias("p"))
    return K.expressive_pick(clips.select("clip", (F.col("clip") % 10).alias("sign"), F.transform("p", lambda x: x["pose"]).alias("poses")))


def smoothed(s, d):
    p = K.pose_ema(poses(s, d)).select("clip", "t", F.posexplode("pose").alias("point", "v"))
    return p.select("clip", "t", "point", F.round(F.col("v")[0], 9).alias("x"), F.round(F.col("v")[1], 9).alias("y"))


def augmented(s, d, config):
    a = K.augment(trajs(s, d), HALVES, config)
    return a.select("clip", "copy", F.posexplode("traj").alias("t", "row")).select("clip", "copy", "t", F.posexplode("row").alias("f", "v")).withColumn("v", F.round("v", 7))


POSES = """raw AS (SELECT vec_id // 2 AS clip, vec_id * 4 + t AS t, vec_id, p, embedding[t * 16 + p * 2 + 1]::DOUBLE AS x, embedding[t * 16 + p * 2 + 2]::DOUBLE AS y FROM embeddings, range(4) a(t), range(8) b(p)),
    pts AS (SELECT clip, t, p, CASE WHEN vec_id % 9 = 0 AND p = 6 THEN 0 ELSE x END AS x, CASE WHEN vec_id % 9 = 0 AND p = 6 THEN 0 ELSE y END AS y FROM raw)"""


def _u(what, *more):
    key = " || '|' || ".join(["'42'", "clip", "copy", f"'{what}'", *more])
    return f"('0x' || substr(md5({key}), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE"


QUERIES = {
    "track_hands": (tracked, None),
    "pose_ema": (smoothed, f"""WITH RECURSIVE {POSES}, o AS (SELECT *, row_number() OVER (PARTITION BY clip, p ORDER BY t) AS n FROM pts),
        e AS (SELECT clip, p, t, n, x AS sx, y AS sy FROM o WHERE n = 1 UNION ALL SELECT o.clip, o.p, o.t, o.n, CASE WHEN o.x = 0 AND o.y = 0 THEN sx ELSE 0.25::DOUBLE * o.x + 0.75::DOUBLE * sx END, CASE WHEN o.x = 0 AND o.y = 0 THEN sy ELSE 0.25::DOUBLE * o.y + 0.75::DOUBLE * sy END FROM e JOIN o ON o.clip = e.clip AND o.p = e.p AND o.n = e.n + 1)
        SELECT clip, t, CAST(p AS INTEGER) AS point, round(sx, 9) AS x, round(sy, 9) AS y FROM e"""),
    "expressive_pick": (expressive, f"""WITH {POSES}, w AS (SELECT clip, t, max(x) FILTER (WHERE p = 1) AS nx, max(y) FILTER (WHERE p = 1) AS ny, max(x) FILTER (WHERE p = 2) AS rx, max(y) FILTER (WHERE p = 2) AS ry, max(x) FILTER (WHERE p = 3) AS lx, max(y) FILTER (WHERE p = 3) AS ly FROM pts GROUP BY 1, 2),
        c AS (SELECT clip, count(*) AS n, median(sqrt((rx - lx) ** 2 + (ry - ly) ** 2)) FILTER (WHERE sqrt((rx - lx) ** 2 + (ry - ly) ** 2) > 1e-3) AS span FROM w GROUP BY 1 HAVING count(*) >= 8),
        v AS (SELECT clip, t, pts.p - 6 AS side, n, (pts.x - nx) / span AS x, (pts.y - ny) / span AS y FROM pts JOIN w USING (clip, t) JOIN c USING (clip) WHERE p IN (6, 7) AND (pts.x <> 0 OR pts.y <> 0)),
        m AS (SELECT *, lag(x) OVER o AS px, lead(x) OVER o AS qx, lag(y) OVER o AS py, lead(y) OVER o AS qy, count(*) OVER (PARTITION BY clip, side) AS k FROM v WINDOW o AS (PARTITION BY clip, side ORDER BY t)),
        z AS (SELECT clip, side, t, n, k, CASE WHEN px IS NULL OR qx IS NULL THEN x ELSE list_sort([px, x, qx])[2] END AS x, CASE WHEN py IS NULL OR qy IS NULL THEN y ELSE list_sort([py, y, qy])[2] END AS y FROM m WHERE k >= 5 AND k >= 0.6::DOUBLE * n),
        g AS (SELECT clip, side, -quantile_cont(y, 0.1) AS reach, sum(coalesce(d, 0)) AS path FROM (SELECT *, sqrt((x - lag(x) OVER o) ** 2 + (y - lag(y) OVER o) ** 2) AS d FROM z WINDOW o AS (PARTITION BY clip, side ORDER BY t)) GROUP BY 1, 2),
        b AS (SELECT clip, clip % 10 AS sign, round(reach, 3) AS reach, round(path, 2) AS path, 1.0::DOUBLE AS det FROM g WHERE reach <= 1.3::DOUBLE AND path <= 30 QUALIFY row_number() OVER (PARTITION BY clip ORDER BY g.reach DESC, g.path DESC, side) = 1)
        SELECT sign, clip, reach, path, det, count(*) OVER (PARTITION BY sign) AS n_scored FROM b QUALIFY row_number() OVER (PARTITION BY sign ORDER BY reach + 0.05::DOUBLE * least(path, 10) DESC, clip) = 1"""),
    "augment": (lambda s, d: augmented(s, d, K.AugmentConfig()), None),
    "augment_values": (lambda s, d: augmented(s, d, K.AugmentConfig(warped=0.0)), f"""WITH {FLAT}, c AS (SELECT clip, t, f, v, copy FROM lng, range(1, 5) r(copy)),
        n AS (SELECT clip, copy, t, f, v * ({_u('scale')} * (1.1::DOUBLE - 0.9::DOUBLE) + 0.9::DOUBLE) + sqrt(-2 * ln(1 - {_u('radius', 'f')})) * cos(2 * pi() * {_u('angle', 'f')}) * 0.02::DOUBLE AS v, {_u('mirror')} < 0.5::DOUBLE AS turned FROM c)
        SELECT clip, CAST(copy AS INTEGER) AS copy, t, CASE WHEN turned THEN (f + 4) % 8 ELSE f END AS f, round(CASE WHEN turned AND f % 2 = 0 THEN -v ELSE v END, 7) AS v FROM n"""),
}
