"""Spaced-repetition rules as column expressions over a state struct.

A state has status, ease, interval_days, next_review_at, consecutive_passes,
total_attempts, total_passes and last_attempt_at.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the scheduling rules.
EASE_START, EASE_LEAST, EASE_MOST = 1.3, 0.13, 2.5
EASE_UP, EASE_DOWN, FAIL_DECAY = 0.1, 0.2, 0.3
PASSES_TO_REVIEW, MASTERY_DAYS, MASTERY_PASSES = 2, 7.0, 3
PASS_RATE_FLOOR, RATE_WINDOW = 0.7, 10
STATE = "struct<status:string,ease:double,interval_days:double,next_review_at:timestamp,consecutive_passes:int,total_attempts:int,total_passes:int,last_attempt_at:timestamp>"


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(x, F.lit(high)))


def add_days(ts: Column, days: Column) -> Column:
    """``ts`` plus ``days`` rounded half up to whole days."""
    return ts + F.make_dt_interval(F.floor(days + 0.5).cast("int"))


def default_state() -> Column:
    null_time = F.lit(None).cast("timestamp")
    zero = F.lit(0).cast("int")
    return F.struct(
        F.lit("untouched").alias("status"), F.lit(EASE_START).alias("ease"), F.lit(0.0).alias("interval_days"), null_time.alias("next_review_at"),
        zero.alias("consecutive_passes"), zero.alias("total_attempts"), zero.alias("total_passes"), null_time.alias("last_attempt_at"),
    ).cast(STATE)


def apply_pass(s: Column, now: Column, in_session: bool = True) -> Column:
    """The state after a passed attempt."""
    status, streak = s["status"], s["consecutive_passes"] + 1
    ease_up = clamp(s["ease"] + EASE_UP, EASE_LEAST, EASE_MOST)
    grown = F.greatest(F.lit(1.0), s["interval_days"] * ease_up)
    fresh, learning = status == "untouched", status == "learning"
    ready = learning & (streak >= PASSES_TO_REVIEW) & F.lit(in_session)
    reviewed = status.isin("reviewing", "mastered")
    mastered = (status == "reviewing") & (grown >= MASTERY_DAYS) & (streak >= MASTERY_PASSES)
    return F.struct(
        F.when(fresh, "learning").when(ready, "reviewing").when(mastered, "mastered").otherwise(status).alias("status"),
        F.when(reviewed, ease_up).otherwise(s["ease"]).alias("ease"),
        F.when(fresh, 0.0).when(ready, 1.0).when(reviewed, grown).otherwise(s["interval_days"]).alias("interval_days"),
        F.when(fresh, now).when(ready, add_days(now, F.lit(1.0))).when(reviewed, add_days(now, grown)).otherwise(s["next_review_at"]).alias("next_review_at"),
        F.when(fresh, 1).otherwise(streak).alias("consecutive_passes"),
        (s["total_attempts"] + 1).alias("total_attempts"), (s["total_passes"] + 1).alias("total_passes"), now.alias("last_attempt_at"),
    ).cast(STATE)


def apply_fail(s: Column, now: Column) -> Column:
    """The state after a failed attempt."""
    status, shrunk = s["status"], s["interval_days"] * FAIL_DECAY
    days = F.when(shrunk == 0.0, 1.0).otherwise(shrunk)
    return F.struct(
        F.when(status == "mastered", "reviewing").when(status == "reviewing", "learning").otherwise(status).alias("status"),
        clamp(s["ease"] - EASE_DOWN, EASE_LEAST, EASE_MOST).alias("ease"), shrunk.alias("interval_days"),
        F.when(status == "untouched", s["next_review_at"]).when(status == "mastered", add_days(now, days)).otherwise(now).alias("next_review_at"),
        F.lit(0).alias("consecutive_passes"), (s["total_attempts"] + 1).alias("total_attempts"), s["total_passes"].alias("total_passes"), now.alias("last_attempt_at"),
    ).cast(STATE)


def retention_curve(interval: Column, status: Column, n: int = 16, horizon: float = 30.0) -> Column:
    """exp(-t / S) at n even times of the horizon, S the interval but at least 1; null for untouched items."""
    strength = F.greatest(F.coalesce(F.nullif(interval, F.lit(0.0)), F.lit(1.0)), F.lit(1.0))
    return F.when(status != "untouched", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.exp(-(i * (horizon / (n - 1))) / strength)))
