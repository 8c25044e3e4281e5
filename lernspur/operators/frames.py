"""From tracked frames to trajectories: features of hands and pose, as column expressions over nested frames.

A frame is a struct of ``hands`` (structs of ``keypoints``, an array of [x, y]
or more values, and ``embedding``) and ``pose`` (an array of [x, y]; nose, neck,
right and left shoulder first). Missing features are null.

Layouts of a frame's features, with two hand slots and 8 pose points at the end:

* ``body`` (100): 21 points a hand, from the body's anchor, in body scales;
* ``embedded`` (356): the same with 128 embedding values after each hand's points;
* ``hand`` (108): a hand's points from its wrist in hand scales (42), the wrist from the anchor in body scales (2) and
  the direction of the palm (2).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lernspur.operators.trajectory import resample

FRAME = "struct<hands: array<struct<keypoints: array<array<double>>, embedding: array<float>>>, pose: array<array<double>>>"
HAND_POINTS, POSE_POINTS, EMBEDDING = 21, 8, 128
#: Values of one hand slot and of a whole frame in each layout.
LAYOUTS = {"body": (42, 100), "embedded": (170, 356), "hand": (46, 108)}
LEAST_SCALE, LEAST_PALM = 1.0, 1e-6


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _at(p: Column, i: int) -> Column:
    return F.get(p, F.lit(i))


def _nulls(n: int) -> Column:
    return F.array_repeat(F.lit(None).cast("double"), n)


def _span(a: Column, b: Column) -> Column:
    return F.hypot(_at(a, 0) - _at(b, 0), _at(a, 1) - _at(b, 1))


def body_anchor(pose: Column) -> Column:
    """Struct x, y, scale; null without four pose points or any of them to stand on.

    The origin is the neck, else the middle of the shoulders, else the nose; the scale the span of the shoulders, else
    1.5 times that of nose and neck, and at least 1. A point at (0, 0) or with a missing value is not seen.
    """
    nose, neck, right, left = (_at(pose, i) for i in range(4))
    seen = lambda p: F.coalesce((_at(p, 0) != 0) | (_at(p, 1) != 0), F.lit(False)) & _at(p, 0).isNotNull() & _at(p, 1).isNotNull()
    shoulders = seen(right) & seen(left)
    scale = F.greatest(F.when(shoulders, _span(right, left)).when(seen(nose) & seen(neck), 1.5 * _span(nose, neck)).otherwise(F.lit(0.0)), F.lit(LEAST_SCALE))
    origin = lambda x, y: F.struct(x.alias("x"), y.alias("y"), scale.alias("scale"))
    middle = [(_at(right, i) + _at(left, i)) / 2 for i in (0, 1)]
    found = F.when(seen(neck), origin(_at(neck, 0), _at(neck, 1))).when(shoulders, origin(*middle)).when(seen(nose), origin(_at(nose, 0), _at(nose, 1)))
    return F.when(F.size(pose) >= 4, found)


def _slots(hands: Column, anchor: Column) -> Column:
    """The first two hands that have all points, each with its slot (0 left of the anchor, else 1), its wrist's distance from it and a whole embedding, if it has one."""
    usable = F.filter(F.slice(F.coalesce(hands, F.array().cast("array<struct<keypoints:array<array<double>>,embedding:array<float>>>")), 1, 2), lambda h: F.size(h["keypoints"]) >= HAND_POINTS)

    def placed(h: Column) -> Column:
        away = _at(_at(h["keypoints"], 0), 0) - anchor["x"]
        whole = F.when(F.size(h["embedding"]) == EMBEDDING, h["embedding"].cast("array<double>"))
        return F.struct(F.when(away < 0, 0).otherwise(1).alias("slot"), F.abs(away).alias("away"), F.slice(h["keypoints"], 1, HAND_POINTS).alias("points"), whole.alias("embedding"))

    return F.transform(usable, placed)


def _slot_features(slots: Column, slot: int, anchor: Column, layout: str) -> Column:
    """Of two hands in one slot the one nearer to the anchor counts, the first on a tie; what it lacks may come from the other."""
    own = F.filter(slots, lambda h: h["slot"] == slot)
    kept = lambda own: F.when(_at(own, 1)["away"] < _at(own, 0)["away"], F.struct(_at(own, 1).alias("a"), _at(own, 0).alias("b"))).otherwise(F.struct(_at(own, 0).alias("a"), F.lit(None).cast("struct<slot:int,away:double,points:array<array<double>>,embedding:array<double>>").alias("b")))
    body = lambda p: F.array((_at(p, 0) - anchor["x"]) / anchor["scale"], (_at(p, 1) - anchor["y"]) / anchor["scale"])

    def relative(h: Column) -> Column:
        """Shape and direction of a hand whose palm is long enough."""
        wrist, palm = _at(h["points"], 0), _at(h["points"], 9)
        unit = lambda p: F.array((_at(p, 0) - _at(wrist, 0)) / _span(palm, wrist), (_at(p, 1) - _at(wrist, 1)) / _span(palm, wrist))
        return F.when(_span(palm, wrist) >= LEAST_PALM, F.struct(F.flatten(F.transform(h["points"], unit)).alias("shape"), unit(palm).alias("turn")))

    def features(x: Column) -> Column:
        if layout == "hand":
            both = lambda r: F.concat(F.coalesce(r["shape"], _nulls(42)), body(_at(x["a"]["points"], 0)), F.coalesce(r["turn"], _nulls(2)))
            return let(F.coalesce(relative(x["a"]), relative(x["b"])), both)
        points = F.flatten(F.transform(x["a"]["points"], body))
        return points if layout == "body" else F.concat(points, F.coalesce(x["a"]["embedding"], x["b"]["embedding"], _nulls(EMBEDDING)))

    return let(own, lambda own: F.when(F.size(own) == 0, _nulls(LAYOUTS[layout][0])).otherwise(let(kept(own), features)))


def frame_features(frame: Column, layout: str = "body") -> Column:
    """The features of a frame (array<double>), all null where its pose gives no anchor."""
    width = LAYOUTS[layout][1]

    def whole(anchor: Column) -> Column:
        body = lambda p: F.when(p.isNull(), _nulls(2)).otherwise(F.array((_at(p, 0) - anchor["x"]) / anchor["scale"], (_at(p, 1) - anchor["y"]) / anchor["scale"]))
        pose = F.flatten(F.array(*[body(_at(frame["pose"], i)) for i in range(POSE_POINTS)]))
        hands = let(_slots(frame["hands"], anchor), lambda s: F.concat(*[_slot_features(s, i, anchor, layout) for i in (0, 1)]))
        return F.when(anchor.isNull(), _nulls(width)).otherwise(F.concat(hands, pose))

    return let(body_anchor(frame["pose"]), whole)


def uses_second_hand(frame: Column) -> Column:
    """Whether a hand fills the second slot."""
    return let(body_anchor(frame["pose"]), lambda a: F.coalesce(F.exists(_slots(frame["hands"], a), lambda h: h["slot"] == 1) & a.isNotNull(), F.lit(False)))


def frames_with_hands(frames: Column) -> Column:
    """Frames with a hand, or all of them where fewer than two have one."""
    held = F.filter(frames, lambda f: F.size(f["hands"]) > 0)
    return F.when(F.size(held) >= 2, held).otherwise(frames)


def has_embedding(frames: Column) -> Column:
    return F.exists(frames, lambda f: F.coalesce(F.exists(f["hands"], lambda h: F.size(h["embedding"]) == EMBEDDING), F.lit(False)))


def frame_trajectories(clips: DataFrame, steps: int = 32, layout: str | None = None) -> DataFrame:
    """``traj`` in place of ``frames``: the features of the frames with hands on ``steps`` even times.

    Without a layout, clips with a whole embedding in any such frame are ``embedded`` and others ``body``. A clip
    without frames keeps an empty trajectory. Also ``second_share``, the share of all frames that fill the second slot.
    """
    kept = clips.withColumn("second_share", F.try_divide(F.aggregate(F.transform("frames", lambda f: uses_second_hand(f).cast("int")), F.lit(0), lambda s, x: s + x), F.size("frames")))
    kept = kept.withColumn("frames", frames_with_hands(F.col("frames")))
    each = lambda name: F.transform("frames", lambda f: frame_features(f, name))
    traj = each(layout) if layout else F.when(has_embedding(F.col("frames")), each("embedded")).otherwise(each("body"))
    return resample(kept.withColumn("traj", traj).drop("frames"), steps)
