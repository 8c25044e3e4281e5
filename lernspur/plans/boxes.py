"""Box queries over lineitem rows that stand in for detections."""

from __future__ import annotations

from pyspark.sql import functions as F

from lernspur.operators import boxes as B
from lernspur.plans.views import BOXES, boxes

DETS_SQL = f"{BOXES}, dets AS (SELECT clip, frame AS t, min(box) AS box, first(x0 ORDER BY box, x0, score) AS x, first(y0 ORDER BY box, x0, score) AS y, first(score ORDER BY box, x0, score) AS score FROM boxes GROUP BY 1, 2)"


def dets(s, d):
    return boxes(s, d).groupBy("clip", F.col("frame").alias("t")).agg(F.min(F.struct("box", "x0", "score", "y0")).alias("m")).select("clip", "t", "m.box", F.col("m.x0").alias("x"), F.col("m.y0").alias("y"), "m.score")


def guarded(s, d):
    b = boxes(s, d)
    faces = b.where("box = 1").select("frame", "x0", "y0", "w", "h")
    return B.face_guard(b.where("box > 1").select("frame", "box", "x0", "y0", "w", "h"), faces).select("frame", "box")


def points(s, d):
    return B.bbox_from_points(boxes(s, d).select("frame", F.col("x0").alias("x"), F.col("y0").alias("y"), F.when(F.col("w") > 20, 1).otherwise(0).alias("v")), ["frame"], least=2)


QUERIES = {
    "xywh_to_xyxy": (lambda s, d: B.xywh_to_xyxy(boxes(s, d)).select("frame", "box", "x1", "y1"), f"WITH {BOXES} SELECT frame, box, x0 + w AS x1, y0 + h AS y1 FROM boxes"),
    "normalized_to_px": (lambda s, d: B.normalized_to_px(boxes(s, d).select("frame", "box", (F.col("x0") / 128).alias("x0"), (F.col("y0") / 128).alias("y0"), (F.col("w") / 1024).alias("w"), (F.col("h") / 1024).alias("h")), 1920.0, 1080.0).select("frame", "box", *[F.round(c, 6).alias(c) for c in ("px0", "py0", "px1", "py1")]),
        f"WITH {BOXES}, p AS (SELECT frame, box, x0 / 128 * 1920 AS px0, y0 / 128 * 1080 AS py0, (x0 / 128 + w / 1024) * 1920 AS px1, (y0 / 128 + h / 1024) * 1080 AS py1 FROM boxes) SELECT frame, box, round(px0, 6) AS px0, round(py0, 6) AS py0, round(px1, 6) AS px1, round(py1, 6) AS py1 FROM p WHERE px1 - px0 >= 4 AND py1 - py0 >= 4"),
    "clip_boxes": (lambda s, d: B.clip_boxes(boxes(s, d), F.when(F.col("frame") % 11 == 0, 0).otherwise(60), F.lit(70)), f"WITH {BOXES}, s AS (SELECT *, CASE WHEN frame % 11 = 0 THEN 0 ELSE 60 END AS iw FROM boxes), c AS (SELECT frame, box, iw, CASE WHEN iw = 0 THEN x0 ELSE greatest(0, least(x0, 60)) END AS x0, CASE WHEN iw = 0 THEN y0 ELSE greatest(0, least(y0, 70)) END AS y0, CASE WHEN iw = 0 THEN x0 + w ELSE greatest(0, least(x0 + w, 60)) END AS x1, CASE WHEN iw = 0 THEN y0 + h ELSE greatest(0, least(y0 + h, 70)) END AS y1 FROM s) SELECT * EXCLUDE (iw) FROM c WHERE iw = 0 OR x1 - x0 >= 1 AND y1 - y0 >= 1"),
    "audit_boxes": (lambda s, d: B.audit_boxes(boxes(s, d), F.col("clip"), 100.0, 120.0), f"WITH {BOXES}, o AS (SELECT *, x0 < -0.5 OR y0 < -0.5 OR x0 + w > 100.5::DOUBLE OR y0 + h > 120.5::DOUBLE AS bad FROM boxes) SELECT clip AS source, count(DISTINCT frame) AS frames, count(*) AS boxes, count(*) FILTER (WHERE w <= 0 OR h <= 0) AS no_area, count(*) FILTER (WHERE bad) AS out_of_bounds, count(DISTINCT frame) FILTER (WHERE bad) AS bad_frames FROM o GROUP BY 1"),
    "filter_detections": (lambda s, d: B.filter_detections(boxes(s, d)).select("frame", "box", "place"), f"WITH {BOXES}, r AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY score DESC, box) AS p FROM boxes), k AS (SELECT * FROM r WHERE p = 1 OR p <= 2 AND least(w, h) >= 8 AND greatest(w, h) <= least(w, h) * 3.5::DOUBLE AND score >= 0.15::DOUBLE) SELECT frame, box, row_number() OVER (PARTITION BY frame ORDER BY score DESC, box) AS place FROM k"),
    "face_guard": (guarded, f"""WITH {BOXES}, f AS (SELECT frame, x0 - w * 0.35::DOUBLE AS fx0, y0 - h * 0.25::DOUBLE AS fy0, x0 + w + w * 0.35::DOUBLE AS fx1, y0 + h + h * 0.25::DOUBLE AS fy1, w * h AS fa FROM boxes WHERE box = 1),
        j AS (SELECT b.*, fa, greatest(0, least(x0 + w, fx1) - greatest(x0, fx0)) * greatest(0, least(y0 + h, fy1) - greatest(y0, fy0)) AS i FROM boxes b LEFT JOIN f USING (frame) WHERE box > 1)
        SELECT frame, box FROM j WHERE NOT coalesce(CASE WHEN w * h > 0 THEN i / (w * h) ELSE 0 END > 0.6::DOUBLE AND w * h < fa * 0.22::DOUBLE, false)"""),
    "largest_box": (lambda s, d: B.largest_box(boxes(s, d)), f"WITH {BOXES}, t AS (SELECT * FROM boxes WHERE score >= 0.3::DOUBLE QUALIFY row_number() OVER (PARTITION BY frame ORDER BY score DESC, box) <= 5) SELECT frame, first(box ORDER BY w * h DESC, box) AS box, max(w * h) AS area FROM t GROUP BY 1"),
    "pad_box": (lambda s, d: B.pad_box(boxes(s, d), 0.15, 100.0, 120.0), f"WITH {BOXES} SELECT frame, box, greatest(0, x0 - w * 0.15::DOUBLE) AS x0, greatest(0, y0 - h * 0.15::DOUBLE) AS y0, least(100, x0 + w + w * 0.15::DOUBLE) AS x1, least(120, y0 + h + h * 0.15::DOUBLE) AS y1 FROM boxes"),
    "bbox_from_points": (points, f"WITH {BOXES}, p AS (SELECT frame, count(*) AS n, min(x0) AS a, min(y0) AS b, max(x0) AS c, max(y0) AS d FROM boxes WHERE w > 20 GROUP BY 1 HAVING count(*) >= 2), r AS (SELECT *, greatest(c - a, d - b) * 0.15::DOUBLE AS room FROM p) SELECT frame, a - room AS x0, b - room AS y0, c + room AS x1, d + room AS y1 FROM r"),
    "body_box_from_hands": (lambda s, d: B.body_box_from_hands(boxes(s, d), 320, 200), f"""WITH {BOXES}, u AS (SELECT frame, min(x0) - max(w) * 1.5::DOUBLE AS x0, min(y0) - max(h) * 3.5::DOUBLE AS y0, max(x0 + w) + max(w) * 1.5::DOUBLE AS x1, max(y0 + h) + max(h) * 0.5::DOUBLE AS y1 FROM boxes GROUP BY 1),
        p AS (SELECT frame, x0 - m AS x0, y0 - m AS y0, x1 + m AS x1, y1 + m AS y1 FROM (SELECT *, greatest(x1 - x0, y1 - y0) * 0.2::DOUBLE AS m FROM u)),
        l AS (SELECT frame, CASE WHEN x1 - x0 < 80 THEN (x0 + x1) / 2 - 40 ELSE x0 END AS x0, CASE WHEN x1 - x0 < 80 THEN (x0 + x1) / 2 + 40 ELSE x1 END AS x1, CASE WHEN y1 - y0 < 80 THEN (y0 + y1) / 2 - 40 ELSE y0 END AS y0, CASE WHEN y1 - y0 < 80 THEN (y0 + y1) / 2 + 40 ELSE y1 END AS y1 FROM p),
        c AS (SELECT frame, greatest(0, floor(x0))::BIGINT AS x0, greatest(0, floor(y0))::BIGINT AS y0, least(320, floor(x1))::BIGINT AS x1, least(200, floor(y1))::BIGINT AS y1 FROM l),
        n AS (SELECT *, CASE WHEN (x1 - x0) > (y1 - y0) * 1.6::DOUBLE THEN floor((x1 - x0) / 1.6::DOUBLE)::BIGINT - (y1 - y0) ELSE 0 END AS hi, CASE WHEN (y1 - y0) > (x1 - x0) * 1.6::DOUBLE THEN floor((y1 - y0) / 1.6::DOUBLE)::BIGINT - (x1 - x0) ELSE 0 END AS wi FROM c WHERE x1 > x0 AND y1 > y0)
        SELECT frame, x0 - least(wi // 2, x0) AS x0, y0 - least(hi - least(hi, 200 - y1), y0) AS y0, x1 + least(wi - least(wi // 2, x0), 320 - x1) AS x1, y1 + least(hi, 200 - y1) AS y1 FROM n"""),
    "temporal_consistent": (lambda s, d: B.temporal_consistent(dets(s, d), 30.0, 2).select("clip", "t"), f"WITH {DETS_SQL}, k AS (SELECT DISTINCT a.clip, a.t FROM dets a JOIN dets b ON a.clip = b.clip AND (b.t = a.t - 1 OR b.t = a.t + 1) WHERE pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 900) SELECT * FROM k WHERE clip IN (SELECT clip FROM k GROUP BY 1 HAVING count(DISTINCT t) >= 2)"),
    "temporal_filter_top": (lambda s, d: B.temporal_filter_top(dets(s, d), 12.0).select("clip", "t"), f"WITH {DETS_SQL}, w AS (SELECT *, count(*) OVER (PARTITION BY clip) AS n, coalesce(abs(x - lag(x) OVER o) <= 12 AND abs(y - lag(y) OVER o) <= 12, false) OR coalesce(abs(x - lead(x) OVER o) <= 12 AND abs(y - lead(y) OVER o) <= 12, false) AS near FROM dets WINDOW o AS (PARTITION BY clip ORDER BY t)) SELECT clip, t FROM w WHERE near OR n = 1"),
}
