"""Bounding boxes and detections: clipping, audits, filters, tracking inputs.

Rows are one box each: frame, box, corner x0, y0, size w, h and a score, inside
an image of ``width`` x ``height``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def xywh_to_xyxy(df: DataFrame) -> DataFrame:
    return df.withColumn("x1", F.col("x0") + F.col("w")).withColumn("y1", F.col("y0") + F.col("h"))


def normalized_to_px(df: DataFrame, width: float, height: float, least: float = 4.0) -> DataFrame:
    """Corners in pixels of boxes given as shares of the image; boxes under ``least`` pixels a side go."""
    px = df.select("*", (F.col("x0") * width).alias("px0"), (F.col("y0") * height).alias("py0"), ((F.col("x0") + F.col("w")) * width).alias("px1"), ((F.col("y0") + F.col("h")) * height).alias("py1"))
    return px.where((F.col("px1") - F.col("px0") >= least) & (F.col("py1") - F.col("py0") >= least))


def clip_boxes(df: DataFrame, width: Column, height: Column) -> DataFrame:
    """Boxes cut to the image. Those under 1 px after the cut go, unless the image size is unknown (0)."""
    unknown = (width <= 0) | (height <= 0)
    cut = lambda c, high: F.when(unknown, c).otherwise(F.greatest(F.lit(0.0), F.least(c, high.cast("double"))))
    out = xywh_to_xyxy(df).select("frame", "box", cut(F.col("x0"), width).alias("x0"), cut(F.col("y0"), height).alias("y0"), cut(F.col("x1"), width).alias("x1"), cut(F.col("y1"), height).alias("y1"), unknown.alias("unknown"))
    return out.where(F.col("unknown") | ((F.col("x1") - F.col("x0") >= 1) & (F.col("y1") - F.col("y0") >= 1))).drop("unknown")


def audit_boxes(df: DataFrame, source: Column, width: float, height: float, slack: float = 0.5) -> DataFrame:
    """Per source: frames, boxes, boxes without area, boxes out of bounds by more than ``slack``, and their frames."""
    out = (F.col("x0") < -slack) | (F.col("y0") < -slack) | (F.col("x0") + F.col("w") > width + slack) | (F.col("y0") + F.col("h") > height + slack)
    return df.groupBy(source.alias("source")).agg(
        F.countDistinct("frame").alias("frames"), F.count("*").alias("boxes"), F.count_if((F.col("w") <= 0) | (F.col("h") <= 0)).alias("no_area"),
        F.count_if(out).alias("out_of_bounds"), F.countDistinct(F.when(out, F.col("frame"))).alias("bad_frames"),
    )


def filter_detections(df: DataFrame, keep: int = 2, least_side: float = 8.0, most_aspect: float = 3.5, second_score: float = 0.15) -> DataFrame:
    """Best detections of each frame: the best always; others if large enough, not too thin and of enough score. Boxes of one score and number follow by size and corner, so that reruns agree."""
    top = W.partitionBy("frame").orderBy(F.desc("score"), "box", "w", "h", "x0", "y0")
    ranked = df.withColumn("place", F.row_number().over(top)).where(F.col("place") <= keep)
    short, long_ = F.least("w", "h"), F.greatest("w", "h")
    fit = (short >= least_side) & (long_ <= short * most_aspect) & (F.col("score") >= second_score)
    return ranked.where((F.col("place") == 1) | fit).withColumn("place", F.row_number().over(top))


def frac_inside(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Share of box a's own area that lies in box b."""
    wide = F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
    high = F.greatest(F.lit(0.0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))
    area = (a["x1"] - a["x0"]) * (a["y1"] - a["y0"])
    return F.when(area > 0, wide * high / area).otherwise(0.0)


def face_guard(hands: DataFrame, faces: DataFrame, wide: float = 0.35, high: float = 0.25, inside: float = 0.6, small: float = 0.22) -> DataFrame:
    """Hands without those that lie mostly in the inflated face of their frame and are small beside it."""
    f = xywh_to_xyxy(faces).select("frame", (F.col("x0") - F.col("w") * wide).alias("fx0"), (F.col("y0") - F.col("h") * high).alias("fy0"), (F.col("x1") + F.col("w") * wide).alias("fx1"), (F.col("y1") + F.col("h") * high).alias("fy1"), (F.col("w") * F.col("h")).alias("farea"))
    h = xywh_to_xyxy(hands).join(f, "frame", "left")
    corners = lambda p: {k: F.col(p + k) for k in ("x0", "y0", "x1", "y1")}
    bad = (frac_inside(corners(""), corners("f")) > inside) & (F.col("w") * F.col("h") < F.col("farea") * small)
    return h.where(~F.coalesce(bad, F.lit(False))).select(*hands.columns)


def largest_box(df: DataFrame, among: int = 5, least_score: float = 0.3) -> DataFrame:
    """Per frame the largest of the ``among`` best boxes that have enough score."""
    top = df.where(F.col("score") >= least_score).withColumn("__p", F.row_number().over(W.partitionBy("frame").orderBy(F.desc("score"), "box"))).where(F.col("__p") <= among)
    return top.groupBy("frame").agg(F.max_by("box", F.struct(F.col("w") * F.col("h"), -F.col("box"))).alias("box"), F.max(F.col("w") * F.col("h")).alias("area"))


def pad_box(df: DataFrame, share: float, width: float, height: float) -> DataFrame:
    """Corners padded by a share of each side and cut to the frame."""
    b = xywh_to_xyxy(df)
    low = lambda c, s: F.greatest(F.lit(0.0), F.col(c) - F.col(s) * share)
    high = lambda c, s, m: F.least(F.lit(m), F.col(c) + F.col(s) * share)
    return b.select("frame", "box", low("x0", "w").alias("x0"), low("y0", "h").alias("y0"), high("x1", "w", width).alias("x1"), high("y1", "h", height).alias("y1"))


def bbox_from_points(points: DataFrame, key: list[str], pad: float = 0.15, least: int = 4) -> DataFrame:
    """Box around the visible points (x, y, v > 0) of each key, padded by a share of the longer side; keys with too few go."""
    seen = points.where("v > 0").groupBy(*key).agg(F.count("*").alias("n"), F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1")).where(F.col("n") >= least)
    room = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) * pad
    return seen.select(*key, (F.col("x0") - room).alias("x0"), (F.col("y0") - room).alias("y0"), (F.col("x1") + room).alias("x1"), (F.col("y1") + room).alias("y1"))


def body_box_from_hands(df: DataFrame, width: int, height: int, pad: float = 0.2, least: float = 0.4, aspect: float = 1.6) -> DataFrame:
    """Upper-body box of each frame from its hand boxes.

    The union grows by 1.5 times the widest hand to either side, 3.5 times the highest one up and 0.5 down, then by
    ``pad`` of its longer side all around; sides under ``least`` of the frame's shorter side grow about their middle.
    Cut to the frame in whole pixels; a side more than ``aspect`` times the other has the other one grown, downwards
    first, or to the left first, as far as the frame goes. Frames without a box left go.
    """
    b = xywh_to_xyxy(df).groupBy("frame").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.max("w").alias("hw"), F.max("h").alias("hh"))
    grown = b.select("frame", (F.col("x0") - F.col("hw") * 1.5).alias("x0"), (F.col("y0") - F.col("hh") * 3.5).alias("y0"), (F.col("x1") + F.col("hw") * 1.5).alias("x1"), (F.col("y1") + F.col("hh") * 0.5).alias("y1"))
    room = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) * pad
    grown = grown.withColumn("room", room).select("frame", *[(F.col(c) - F.col("room")).alias(c) for c in ("x0", "y0")], *[(F.col(c) + F.col("room")).alias(c) for c in ("x1", "y1")])
    short = F.lit(least * min(width, height))
    for a, z in (("x0", "x1"), ("y0", "y1")):
        middle, side = (F.col(a) + F.col(z)) / 2, F.greatest(F.col(z) - F.col(a), short)
        thin = F.col(z) - F.col(a) < short
        grown = grown.withColumns({a: F.when(thin, middle - side / 2).otherwise(F.col(a)), z: F.when(thin, middle + side / 2).otherwise(F.col(z))})
    cut = grown.select("frame", *[F.greatest(F.lit(0), F.floor(c)).cast("long").alias(c) for c in ("x0", "y0")], F.least(F.lit(width), F.floor("x1")).cast("long").alias("x1"), F.least(F.lit(height), F.floor("y1")).cast("long").alias("y1"))
    kept = cut.where("x1 > x0 AND y1 > y0").withColumn("w", F.col("x1") - F.col("x0")).withColumn("h", F.col("y1") - F.col("y0"))
    higher = F.when(F.col("w") > F.col("h") * aspect, F.floor(F.col("w") / aspect) - F.col("h")).otherwise(F.lit(0))
    wider = F.when(F.col("h") > F.col("w") * aspect, F.floor(F.col("h") / aspect) - F.col("w")).otherwise(F.lit(0))
    sized = kept.withColumn("down", F.least(higher, height - F.col("y1"))).withColumn("up", F.least(higher - F.col("down"), F.col("y0")))
    sized = sized.withColumn("left", F.least(F.floor(wider / 2), F.col("x0"))).withColumn("right", F.least(wider - F.col("left"), width - F.col("x1")))
    return sized.select("frame", (F.col("x0") - F.col("left")).alias("x0"), (F.col("y0") - F.col("up")).alias("y0"), (F.col("x1") + F.col("right")).alias("x1"), (F.col("y1") + F.col("down")).alias("y1"))


def temporal_consistent(df: DataFrame, tolerance: float, least: int) -> DataFrame:
    """Detections of a clip with another within ``tolerance`` one frame before or after; clips with fewer than ``least`` such frames go.

    ``df`` has clip, t, box, x and y.
    """
    near = df.select("clip", F.col("x").alias("nx"), F.col("y").alias("ny"), F.explode(F.array(F.col("t") - 1, F.col("t") + 1)).alias("t"))
    close = (F.pow(F.col("x") - F.col("nx"), 2) + F.pow(F.col("y") - F.col("ny"), 2)) <= tolerance * tolerance
    kept = df.join(near, ["clip", "t"]).where(close).select(*df.columns).distinct()
    enough = kept.groupBy("clip").agg(F.countDistinct("t").alias("n")).where(F.col("n") >= least).select("clip")
    return kept.join(enough, "clip", "left_semi")


def temporal_filter_top(df: DataFrame, tolerance: float) -> DataFrame:
    """Top peak of each frame kept if the peak before or after lies within ``tolerance`` on both axes; a lone one is kept."""
    top = df.withColumn("__p", F.row_number().over(W.partitionBy("clip", "t").orderBy(F.desc("score"), "box"))).where("__p = 1").drop("__p")
    order = W.partitionBy("clip").orderBy("t")
    near = F.lit(False)
    for f in (F.lag, F.lead):
        near = near | F.coalesce((F.abs(F.col("x") - f("x").over(order)) <= tolerance) & (F.abs(F.col("y") - f("y").over(order)) <= tolerance), F.lit(False))
    return top.withColumn("near", near | (F.count("*").over(W.partitionBy("clip")) == 1)).where("near").drop("near")


def clip_items(items: DataFrame, least: float = 1.0) -> DataFrame:
    """Images (width, height, bboxes as arrays of corners) with their boxes cut to the image.

    Boxes under ``least`` pixels a side after the cut go, and an image all of whose boxes went goes with them; an image
    that had none is kept, as a negative. Images of unknown size (0 or null) pass as they are.
    """
    known = F.coalesce((F.col("width") > 0) & (F.col("height") > 0), F.lit(False))
    at = lambda b, i: F.get(b, F.lit(i)).cast("double")
    cut = lambda v, high: F.greatest(F.lit(0.0), F.least(v, F.col(high).cast("double")))
    corners = F.transform("bboxes", lambda b: F.array(cut(at(b, 0), "width"), cut(at(b, 1), "height"), cut(at(b, 2), "width"), cut(at(b, 3), "height")))
    alive = F.filter(corners, lambda b: (at(b, 2) - at(b, 0) >= least) & (at(b, 3) - at(b, 1) >= least))
    boxes = F.when(known, alive).otherwise(F.transform("bboxes", lambda b: F.transform(b, lambda v: v.cast("double"))))
    out = items.withColumn("__n", F.coalesce(F.size("bboxes"), F.lit(0))).withColumn("bboxes", F.coalesce(boxes, F.array().cast("array<array<double>>")))
    return out.where((F.col("__n") == 0) | (F.size("bboxes") > 0)).drop("__n")


def temporal_filter_least(df: DataFrame, tolerance: float, least: int) -> DataFrame:
    """``temporal_filter_top`` for clips that keep at least ``least`` frames."""
    kept = temporal_filter_top(df, tolerance)
    enough = kept.groupBy("clip").agg(F.count("*").alias("__n")).where(F.col("__n") >= least).select("clip")
    return kept.join(enough, "clip", "left_semi")


def crop_records(trajectories: DataFrame, pad: float = 0.15, least: int = 8) -> DataFrame:
    """One row per (clip, source frame, hand) of trajectories: where its crop lies in the source video.

    ``trajectories`` has clip, fps and frame_size ([width, height]) of what was tracked, frames (structs of frame_idx and
    hands with a bbox), and source_fps (30 where missing), source_width and source_height. A frame's number is scaled by
    the frame rates, half to even; of frames that fall on one source frame the last one with a box counts. Boxes are
    scaled by the sizes (not at all without a frame_size), padded by a share of the longer side, rounded and cut to the
    source, and dropped under ``least`` pixels a side.
    """
    from lernspur.operators.landmarks import crop_box, scale_box

    boxed = F.filter(F.transform("f.hands", lambda h, i: F.struct(i.alias("hand"), h["bbox"].alias("bbox"))), lambda x: F.size(x["bbox"]) == 4)
    steps = trajectories.select("clip", "fps", "source_fps", "frame_size", "source_width", "source_height", F.explode("frames").alias("f"))
    steps = steps.select("*", boxed.alias("hands")).where((F.size("hands") > 0) & (F.col("fps") > 0))
    at = F.bround(F.col("f.frame_idx") * F.coalesce(F.when(F.col("source_fps") > 0, F.col("source_fps")), F.lit(30.0)) / F.col("fps")).cast("long")
    sized = ("frame_size", "source_width", "source_height")
    # a clip's rows meet first, in one exchange by clip; which frame counts is then found inside the clip's own task
    dealt = steps.select("clip", at.alias("source_frame"), F.struct(F.col("f.frame_idx").alias("frame_idx"), "hands").alias("k"), *sized)
    order = W.partitionBy("clip", "source_frame").orderBy(F.desc("k"))
    last = dealt.withColumn("__n", F.row_number().over(order)).where("__n = 1")
    hands = last.select("clip", "source_frame", *sized, F.inline("k.hands"))
    size = lambda i, c: F.when(F.get("frame_size", F.lit(i)).isNull(), 1.0).otherwise(F.col(c) / F.greatest(F.get("frame_size", F.lit(i)), F.lit(1)))
    scaled = scale_box([F.get("bbox", F.lit(i)) for i in range(4)], size(0, "source_width"), size(1, "source_height"))
    crop = crop_box(scaled, F.col("source_width"), F.col("source_height"), pad, least)
    return hands.select("clip", "source_frame", "hand", crop.alias("c")).where("c IS NOT NULL").select("clip", "source_frame", "hand", "c.*")
