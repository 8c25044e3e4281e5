"""Hands followed through live clips: the rules of ``operators.tracking.track_hands`` with the slots as list state."""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lernspur.operators.tracking import TRACKED, TrackConfig, _plain, follow

NUMBERS = ("x", "y", "vx", "vy")


def packed(slot: int, hand: dict) -> tuple:
    """A slot as an entry of state; hands without keypoints have the one size -1."""
    points = hand["keypoints"]
    return slot, *(float(hand[n]) for n in NUMBERS), hand["missed"], [float(v) for p in points or [] for v in p], [-1] if points is None else [len(p) for p in points]


def unpacked(entry: tuple) -> dict:
    values, sizes = [float(v) for v in entry[6]], [int(n) for n in entry[7]]
    ends = list(accumulate(sizes))
    points = None if sizes == [-1] else [values[e - n : e] for e, n in zip(ends, sizes, strict=True)]
    return {**dict(zip(NUMBERS, entry[1:5], strict=True)), "missed": entry[5], "keypoints": points}


class Tracker(StatefulProcessor):
    """One clip of the stream. Each slot held is an entry of a list state: position, velocity, missed frames, and the keypoints as one row of values and how many each has."""

    def __init__(self, config: TrackConfig, out: T.StructType) -> None:
        self.config, self.out = config, out

    def init(self, handle: StatefulProcessorHandle) -> None:
        held = T.StructType([T.StructField("slot", T.IntegerType()), *[T.StructField(n, T.DoubleType()) for n in NUMBERS], T.StructField("missed", T.IntegerType())])
        self.slots = handle.getListState("slots", held.add("values", T.ArrayType(T.DoubleType())).add("sizes", T.ArrayType(T.IntegerType())))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        held = dict(sorted((s[0], unpacked(s)) for s in (self.slots.get() if self.slots.exists() else ())))
        log, out = pd.concat(list(rows)).sort_values("t", kind="stable"), []
        for t, hands, width, height in zip(log["t"], log["hands"], log["width"], log["height"], strict=True):
            given = [h and {"bbox": h.get("bbox"), "keypoints": h.get("keypoints")} for h in json.loads(hands or "[]")]
            held, seen = follow(held, _plain(given), width, height, self.config)
            out.append((key[0], t, json.dumps([{"slot": s, "bbox": b, "keypoints": k} for s, b, k in seen])))
        self.slots.clear()
        if held:
            self.slots.put([packed(s, h) for s, h in held.items()])
        yield pd.DataFrame(out, columns=self.out.names)

    def close(self) -> None:
        pass


def track_stream(detections: DataFrame, config: TrackConfig | None = None) -> DataFrame:
    """The rows of ``track_hands`` as a stream (append); rows of a micro-batch are taken in the order of t. Needs Spark's RocksDB state store."""
    # hands go to Python and back as JSON: workers with state crash on lists of structs of lists
    wanted = detections.select("clip", "t", F.to_json("hands").alias("hands"), F.col("width").cast("double").alias("width"), F.col("height").cast("double").alias("height"))
    out = T.StructType([detections.schema["clip"], detections.schema["t"], T.StructField("hands", T.StringType())])
    found = wanted.groupBy("clip").transformWithStateInPandas(Tracker(config or TrackConfig(), out), out, "append", "none")
    return found.withColumn("hands", F.from_json("hands", TRACKED))
