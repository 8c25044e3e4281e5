"""The scheduling fold as a stream: attempts in, changed states out."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lernspur.functions import scheduler as S

STATE_FIELDS = "status string, ease double, interval_days double, next_review_at timestamp, consecutive_passes int, total_attempts int, total_passes int, last_attempt_at timestamp"
STATE_NAMES = [c.strip().split(" ")[0] for c in STATE_FIELDS.split(",")]
#: The state before the first attempt, in the order of STATE_NAMES.
START = ("untouched", S.EASE_START, 0.0, None, 0, 0, 0, None)
OUT = f"user_id long, vocab_id long, {STATE_FIELDS}, reached_mastery boolean, rejected int"


def advance(s: tuple, now: pd.Timestamp, passed: bool) -> tuple:
    """One attempt under the rules of ``functions.scheduler``, on a plain tuple."""
    status, ease, interval, due, streak, tries, passes, _ = s
    days = lambda x: now + pd.Timedelta(days=math.floor(x + 0.5))
    if not passed:
        ease, interval = min(S.EASE_MOST, max(S.EASE_LEAST, ease - S.EASE_DOWN)), interval * S.FAIL_DECAY
        if status == "mastered":
            status, due = "reviewing", days(interval or 1.0)
        elif status != "untouched":
            status, due = "learning", now
        return status, ease, interval, due, 0, tries + 1, passes, now
    streak += 1
    if status == "untouched":
        status, streak, interval, due = "learning", 1, 0.0, now
    elif status == "learning":
        if streak >= S.PASSES_TO_REVIEW:
            status, interval, due = "reviewing", 1.0, days(1.0)
    else:
        ease = min(S.EASE_MOST, max(S.EASE_LEAST, ease + S.EASE_UP))
        interval = max(1.0, interval * ease)
        due = days(interval)
        if status == "reviewing" and interval >= S.MASTERY_DAYS and streak >= S.MASTERY_PASSES:
            status = "mastered"
    return status, ease, interval, due, streak, tries + 1, passes + 1, now


def mastery_stream(attempts: DataFrame, delay: str = "1 day") -> DataFrame:
    """Latest state of every (user, item) that a micro-batch touches.

    Attempts of a batch are folded in time order; those older than the last
    folded one are counted in ``rejected`` and change nothing.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        s = tuple(held.get) if held.exists else START
        was, rejected = s[0], 0
        log = pd.concat(list(batches)).sort_values(["submitted_at", "event_id"])
        for now, passed in zip(log["submitted_at"], log["passed"], strict=True):
            if s[7] is not None and now < s[7]:
                rejected += 1
            else:
                s = advance(s, now, bool(passed))
        held.update(s)
        yield pd.DataFrame([(*key, *s, s[0] == "mastered" and was != "mastered", rejected)], columns=[c.strip().split(" ")[0] for c in OUT.split(",")])

    watched = attempts.withWatermark("submitted_at", delay)
    return watched.groupBy("user_id", "vocab_id").applyInPandasWithState(fold, OUT, STATE_FIELDS, "update", GroupStateTimeout.NoTimeout)
