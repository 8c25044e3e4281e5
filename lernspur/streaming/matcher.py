"""Live matching of signs: frames in, one step a frame out, with several kinds of state a session.

State of a session: the last frames with hands (a list of at most ``window``)
and a streak for every sign (a map). A step resamples the frames it holds,
scores them against the signs of its slice, and lengthens the streak of each
sign at or under its threshold or ends it. The same rules run over a whole
table (``match_steps``) and over a stream (``match_stream``).
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lernspur.operators.frames import frame_features
from lernspur.operators.matching import in_blocks, mirror_image, score
from lernspur.operators.trajectory import resampled


@dataclass
class MatchConfig:
    #: Steps of a template, and frames needed before anything is scored.
    steps: int = 32
    #: Frames held at most (at least ``steps``).
    window: int = 48
    #: Passes in a row that unlock a sign.
    required: int = 3
    mirror: tuple[list[int], list[float]] | None = None
    #: First and last feature of the second hand.
    second: tuple[int, int] = (42, 83)
    warped: bool = True
    radius: int = 8
    #: Templates and thresholds are sent to every executor; more than this stops the job.
    most_bytes: int = 256 << 20
    #: Names of the columns session, order, target, features and, if there is one, slice.
    columns: tuple[str, str, str, str, str | None] = ("session", "t", "target", "features", None)


def hand_features(frame, layout: str = "body"):
    """Features of a frame with hands; null for one without, which steps skip."""
    return F.when(F.size(frame["hands"]) > 0, frame_features(frame, layout))


@dataclass
class Session:
    frames: list[np.ndarray] = field(default_factory=list)
    streaks: dict = field(default_factory=dict)


def windows(held: Session, rows: pd.DataFrame, config: MatchConfig) -> tuple[list[np.ndarray], list[int]]:
    """The views to be scored for a session's next rows, and each row's view (-1: not ready); ``held.frames`` is brought up to date."""
    window, views, at, fresh = max(config.window, config.steps), [], [], True
    for features in rows["features"]:
        x = None if features is None else np.asarray(features, dtype=np.float64)  # None becomes NaN
        if x is not None and np.isfinite(x).any():
            held.frames, fresh = [*held.frames, x][-window:], True
        full = len(held.frames) >= config.steps
        if full and fresh:
            views.append(np.stack(held.frames))
            fresh = False
        at.append(len(views) - 1 if full else -1)
    return views, at


def scored(views: list[np.ndarray], wanted: list[set], templates: dict, config: MatchConfig) -> list[dict]:
    """For every view its scores by sign, for the signs wanted of it. Views of one shape are scored together, one template at a time."""
    out: list[dict] = [{} for _ in views]
    shapes: dict[tuple, list[int]] = {}
    for i, v in enumerate(views):
        shapes.setdefault(v.shape, []).append(i)
    for (n, _), own in shapes.items():
        for some in (own[i : i + 4096] for i in range(0, len(own), 4096)):
            x = np.stack([views[i] for i in some])
            x = x if n == config.steps else resampled(x, config.steps)
            y = mirror_image(x, config.mirror)
            signs: dict = {}
            for place, i in enumerate(some):
                for s in wanted[i]:
                    signs.setdefault(s, []).append(place)
            for sign, places in signs.items():
                if sign in templates:
                    for place, v in zip(places, score(x[places], templates[sign], None if y is None else y[places], config.warped, config.radius).tolist(), strict=True):
                        out[some[place]][sign] = v
    return out


def advance_all(sessions: list[tuple[Session, pd.DataFrame]], templates: dict, thresholds: dict, config: MatchConfig) -> list[list[tuple]]:
    """The steps of the next rows (target, features, slice) of some sessions, in order; each session is brought up to date.

    What is held at each row is known before any score, so the windows of all sessions are scored together.
    """
    views, wanted, plans = [], [], []
    for held, rows in sessions:
        own, at = windows(held, rows, config)
        slices = [list(dict.fromkeys(s)) if s is not None else [t] for s, t in zip(rows["slice"], rows["target"], strict=True)]
        first = len(views)
        views += own
        wanted += [set() for _ in own]
        at = [first + i if i >= 0 else -1 for i in at]
        for some, i in zip(slices, at, strict=True):
            if i >= 0:
                wanted[i].update(some)
        plans.append((slices, at))
    found = scored(views, wanted, templates, config)
    limit = lambda s: t if (t := thresholds.get(s)) is not None and np.isfinite(t) else np.inf
    steps = []
    for (held, rows), (slices, at) in zip(sessions, plans, strict=True):
        out: list[tuple] = []
        for target, some, i in zip(rows["target"], slices, at, strict=True):
            if i < 0:
                out.append((False, {}, False, held.streaks.get(target, 0), False, None, None))
                continue
            scores = {s: found[i][s] for s in some if s in found[i]}
            for s, v in scores.items():
                held.streaks[s] = held.streaks.get(s, 0) + 1 if v <= limit(s) else 0
            best = min(scores, key=scores.get, default=None)
            streak = held.streaks.get(target, 0)
            out.append((True, scores, scores.get(target, np.inf) <= limit(target), streak, streak >= max(1, config.required), best, scores.get(best)))
        steps.append(out)
    return steps


def advance(held: Session, rows: pd.DataFrame, templates: dict, thresholds: dict, config: MatchConfig) -> list[tuple]:
    """``advance_all`` of one session."""
    return advance_all([(held, rows)], templates, thresholds, config)[0]


def _known(templates: DataFrame, thresholds: DataFrame, config: MatchConfig) -> tuple[dict, dict]:
    """Templates and thresholds by sign, collected up to the stated size."""
    blocks = list(in_blocks(templates.where("mean IS NOT NULL"), config.second, config.most_bytes))
    if len(blocks) > 1:
        raise ValueError(f"the templates are larger than {config.most_bytes} bytes: match slices of them")
    return {t["sign"]: t for block in blocks for t in block}, {r["sign"]: r["threshold"] for r in thresholds.select("sign", "threshold").toLocalIterator()}


def _shape(frames: DataFrame, templates: DataFrame, config: MatchConfig) -> tuple[DataFrame, T.StructType]:
    session, order, target, features, some = config.columns
    sign = templates.schema["sign"].dataType
    wanted = frames.select(F.col(session).alias("session"), F.col(order).alias("t"), F.col(target).cast(sign).alias("target"), F.col(features).cast("array<double>").alias("features"), (F.col(some) if some else F.lit(None)).cast(T.ArrayType(sign)).alias("slice"))
    out = T.StructType([wanted.schema["session"], wanted.schema["t"], wanted.schema["target"]])
    for name, kind in (("ready", T.BooleanType()), ("scores", T.MapType(sign, T.DoubleType())), ("passed", T.BooleanType()), ("streak", T.IntegerType()), ("unlocked", T.BooleanType()), ("top1", sign), ("top1_score", T.DoubleType())):
        out = out.add(name, kind)
    return wanted, out


def _frame(key, rows: pd.DataFrame, steps: list[tuple], out: T.StructType) -> pd.DataFrame:
    done = pd.DataFrame(steps, columns=out.names[3:], index=rows.index)
    done.insert(0, "session", key)
    done.insert(1, "t", rows["t"])
    done.insert(2, "target", rows["target"])
    return done


def match_steps(frames: DataFrame, templates: DataFrame, thresholds: DataFrame, config: MatchConfig | None = None) -> DataFrame:
    """Every frame with session, t, target, ready, scores (map by sign), passed (the target now), streak (of the target), unlocked, top1 and top1_score.

    Frames without features, or with none present, change nothing that is held, but their step still counts. Signs of
    a slice without a template have no score, those without a finite threshold always pass; without a slice the target
    is scored alone. Sessions stream through their tasks in order: no session is held whole. Rows of one session and t
    keep the order they are found in; a null session is one too.
    """
    config = config or MatchConfig()
    wanted, out = _shape(frames, templates, config)
    shared = wanted.sparkSession.sparkContext.broadcast(_known(templates, thresholds, config))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, limits = shared.value
        key, held = object(), Session()
        for batch in batches:
            for first in range(0, len(batch), 4096):
                some = batch.iloc[first : first + 4096]
                marks = some["session"].ne(some["session"].shift()) & ~(some["session"].isna() & some["session"].shift().isna())
                begins = [*np.flatnonzero(marks.to_numpy(dtype=bool)), len(some)]
                begins = begins if begins[0] == 0 else [0, *begins]
                parts = []
                for a, b in zip(begins[:-1], begins[1:], strict=True):
                    rows = some.iloc[a:b]
                    own = rows["session"].iloc[0]
                    if not (own == key or (pd.isna(own) and key is None)):
                        key, held = None if pd.isna(own) else own, Session()
                    parts.append((held, rows))
                steps = advance_all(parts, known, limits, config)
                yield _frame(some["session"], some, [step for own in steps for step in own], out)

    return wanted.repartition("session").sortWithinPartitions("session", "t").mapInPandas(run, out)


class Matcher(StatefulProcessor):
    """One session of the stream: a list state of frames and a map state of streaks."""

    def __init__(self, known: tuple[dict, dict], config: MatchConfig, sign: T.DataType, out: T.StructType) -> None:
        self.known, self.config, self.sign, self.out = known, config, sign, out

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.frames = handle.getListState("frames", T.StructType([T.StructField("features", T.ArrayType(T.DoubleType()))]))
        self.streaks = handle.getMapState("streaks", T.StructType([T.StructField("sign", self.sign)]), T.StructType([T.StructField("streak", T.IntegerType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        known, limits = self.known
        empty = lambda x: np.array([np.nan if v is None else v for v in x], dtype=np.float64)
        held = Session([empty(f[0]) for f in self.frames.get()] if self.frames.exists() else [], {k[0]: v[0] for k, v in self.streaks.iterator()} if self.streaks.exists() else {})
        log = pd.concat(list(rows)).sort_values("t", kind="stable")
        for first in range(0, len(log), 512):
            some = log.iloc[first : first + 512]
            yield _frame(key[0], some, advance(held, some, known, limits, self.config), self.out)
        if held.frames:
            self.frames.put([([None if np.isnan(v) else float(v) for v in f],) for f in held.frames])
        for sign, streak in held.streaks.items():
            self.streaks.updateValue((sign,), (int(streak),))

    def close(self) -> None:
        pass


def match_stream(frames: DataFrame, templates: DataFrame, thresholds: DataFrame, config: MatchConfig | None = None) -> DataFrame:
    """The steps of ``match_steps`` as a stream (append). Rows of a micro-batch are taken in the order of t.

    Needs spark.sql.streaming.stateStore.providerClass set to Spark's RocksDB provider. State is kept in the query's
    checkpoint, so a restarted query goes on where it stopped. Templates and thresholds travel in the processor: they
    may be as large as spark.broadcast.UDFCompressionThreshold (a number of bytes, 1 MB if unset), since Spark makes a
    broadcast of more, which a processor cannot read; larger ones are refused.
    """
    config = config or MatchConfig()
    wanted, out = _shape(frames, templates, config)
    known = _known(templates, thresholds, config)
    size, most = len(pickle.dumps(known)), int(wanted.sparkSession.sparkContext.getConf().get("spark.broadcast.UDFCompressionThreshold", str(1 << 20)))
    if size + (64 << 10) > most:
        raise ValueError(f"templates of {size} bytes: set spark.broadcast.UDFCompressionThreshold above that, or match a slice of the signs")
    processor = Matcher(known, config, templates.schema["sign"].dataType, out)
    return wanted.groupBy("session").transformWithStateInPandas(processor, out, "append", "none")
