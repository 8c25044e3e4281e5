"""Learner analytics: an append-only attempts log into schedules, progress and outcomes.

``attempts`` has event_id, user_id, vocab_id, submitted_at and passed;
``items`` has vocab_id and rank; ``states`` has user_id, vocab_id and the state
columns of ``functions.scheduler``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from lernspur.functions import scheduler as S
from lernspur.streaming.mastery import START, STATE_NAMES, advance

KEY = ["user_id", "vocab_id"]
#: Rows of a catalogue that are sent to the tasks.
MOST_ITEMS = 100_000


def in_order():
    """Attempts of a (user, item) in time order."""
    return W.partitionBy(*KEY).orderBy("submitted_at", "event_id")


def mastery_fold(attempts: DataFrame) -> DataFrame:
    """State of each (user, vocab) after all its attempts in time order."""
    ordered = F.array_sort(F.collect_list(F.struct("submitted_at", "event_id", "passed")))
    step = lambda s, a: F.when(a["passed"], S.apply_pass(s, a["submitted_at"])).otherwise(S.apply_fail(s, a["submitted_at"]))
    folded = attempts.groupBy(*KEY).agg(ordered.alias("log")).select(*KEY, F.aggregate("log", S.default_state(), step).alias("s"))
    return folded.select(*KEY, "s.*")


def catalog_with_state(users: DataFrame, items: DataFrame, states: DataFrame) -> DataFrame:
    """Every user x item with its state, defaults where there is none.

    The result has a row for each user and item by its meaning. ``items`` is a catalogue: up to ``MOST_ITEMS`` rows of it
    are sent to the tasks that hold the users; a larger one is crossed by Spark without being sent whole.
    """
    default = S.default_state()
    small = items.limit(MOST_ITEMS + 1).count() <= MOST_ITEMS
    every = users.select("user_id").distinct().crossJoin(F.broadcast(items) if small else items)
    names = [f.split(":")[0] for f in S.STATE[7:-1].split(",")]
    return every.join(states, KEY, "left").select("user_id", *items.columns, *[F.coalesce(F.col(n), default[n]).alias(n) for n in names])


def rolling_pass_rate(attempts: DataFrame, n: int = S.RATE_WINDOW) -> DataFrame:
    """Mean of the user's last n passes at every attempt."""
    last = W.partitionBy("user_id").orderBy("submitted_at", "event_id").rowsBetween(1 - n, 0)
    return attempts.withColumn("pass_rate", F.avg(F.col("passed").cast("int")).over(last))


def latest_pass_rate(attempts: DataFrame, n: int = S.RATE_WINDOW) -> DataFrame:
    """Pass rate of each user's last n attempts."""
    recent = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("submitted_at"), F.desc("event_id")))
    return attempts.withColumn("__n", recent).where(F.col("__n") <= n).groupBy("user_id").agg(F.avg(F.col("passed").cast("int")).alias("pass_rate"))


def pick_next(candidates: DataFrame, rates: DataFrame, now: Column) -> DataFrame:
    """One item for each user: most overdue; else, below the pass-rate floor, first learning; else first untouched; else first learning."""
    rate = F.coalesce(F.col("pass_rate"), F.lit(1.0))
    due = (F.col("status") != "untouched") & (F.col("next_review_at") <= now)
    low = rate < S.PASS_RATE_FLOOR
    order = (
        F.when(due, 0)
        .when(low & (F.col("status") == "learning"), 1)
        .when(F.col("status") == "untouched", 2)
        .when(F.col("status") == "learning", 3)
    )
    ranked = candidates.join(rates, "user_id", "left").withColumn("reason", order).where("reason IS NOT NULL")
    first = W.partitionBy("user_id").orderBy("reason", F.when(due, F.col("next_review_at")).asc_nulls_last(), F.col("rank").asc_nulls_last(), "vocab_id")
    return ranked.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")


def progression(catalog: DataFrame) -> DataFrame:
    """mastered, unlocked (reviewing), current (first other by rank) or locked, and whether the item is open."""
    open_item = (~F.col("status").isin("mastered", "reviewing")).cast("int")
    by_rank = W.partitionBy("user_id").orderBy(F.col("rank").asc_nulls_last(), "vocab_id").rowsBetween(W.unboundedPreceding, 0)
    counted = catalog.withColumn("__open", F.sum(open_item).over(by_rank))
    stage = F.when(F.col("status") == "mastered", "mastered").when(F.col("status") == "reviewing", "unlocked").when(F.col("__open") == 1, "current").otherwise("locked")
    return counted.withColumn("stage", stage).withColumn("is_open", F.col("stage") != "locked").drop("__open")


def status_counts(states: DataFrame) -> DataFrame:
    """Items by status and in all, one row for each user."""
    names = ("untouched", "learning", "reviewing", "mastered")
    return states.groupBy("user_id").agg(*[F.count_if(F.col("status") == s).alias(s) for s in names], F.count("*").alias("total"))


def dashboard_order(catalog: DataFrame) -> DataFrame:
    """Position of every item on the user's board: learning, reviewing, untouched, mastered, then by name."""
    place = F.when(F.col("status") == "learning", 0).when(F.col("status") == "reviewing", 1).when(F.col("status") == "untouched", 2).otherwise(3)
    return catalog.withColumn("position", F.row_number().over(W.partitionBy("user_id").orderBy(place, "vocab_id")))


def hint_efficacy(attempts: DataFrame) -> DataFrame:
    """Share of passes on the next attempt after a failed one, for each (vocab, predicted)."""
    after = attempts.withColumn("next_passed", F.lead("passed").over(in_order())).where(~F.col("passed") & F.col("next_passed").isNotNull())
    return after.groupBy("vocab_id", "predicted").agg(F.count("*").alias("n"), F.avg(F.col("next_passed").cast("int")).alias("efficacy"))


def next_in_rank(items: DataFrame) -> DataFrame:
    """The item that follows by rank inside its category."""
    return items.withColumn("next_vocab", F.lead("vocab_id").over(W.partitionBy("category").orderBy(F.col("rank").asc_nulls_last(), "vocab_id")))


def consecutive_fails(attempts: DataFrame, offer_at: int = 3) -> DataFrame:
    """Fails since the last pass on the item, and whether skipping is offered."""
    island = F.sum(F.col("passed").cast("int")).over(in_order().rowsBetween(W.unboundedPreceding, 0))
    marked = attempts.withColumn("__i", island)
    inside = W.partitionBy(*KEY, "__i").orderBy("submitted_at", "event_id").rowsBetween(W.unboundedPreceding, 0)
    counted = marked.withColumn("fails", F.sum((~F.col("passed")).cast("int")).over(inside))
    return counted.withColumn("skip_offered", F.col("fails") >= offer_at).drop("__i")


def forgetting_rate(attempts: DataFrame, days: tuple[int, ...] = (1, 3, 7)) -> DataFrame:
    """Pass rate by days since the previous attempt on the item."""
    gap = F.datediff("submitted_at", F.lag("submitted_at").over(in_order()))
    bucket = F.lit(len(days))
    for i, d in reversed(list(enumerate(days))):
        bucket = F.when(F.col("gap") < d, i).otherwise(bucket)
    return attempts.withColumn("gap", gap).where("gap IS NOT NULL").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.avg(F.col("passed").cast("int")).alias("pass_rate"))


def time_to_mastery(history: DataFrame) -> DataFrame:
    """Seconds from the first attempt on an item to the first with status mastered."""
    first = F.min(F.when(F.col("status") == "mastered", F.col("submitted_at")))
    return history.groupBy(*KEY).agg((F.unix_micros(first) - F.unix_micros(F.min("submitted_at"))).alias("micros")).where("micros IS NOT NULL")


def mastery_history(attempts: DataFrame) -> DataFrame:
    """The state after every attempt. Attempts of a user on an item stream through one task in order, which holds the last state only."""
    names = STATE_NAMES
    kinds = {**{f.name: f.dataType for f in attempts.schema.fields}, **{f.name: f.dataType for f in attempts.select(S.default_state().alias("s")).select("s.*").schema.fields}}
    out = T.StructType([T.StructField(n, kinds[n]) for n in (*KEY, "event_id", "submitted_at", *names)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, START
        for batch in batches:
            rows = []
            for user, item, event, now, passed in zip(*(batch[c] for c in (*KEY, "event_id", "submitted_at", "passed")), strict=True):
                if (user, item) != key:
                    key, state = (user, item), START
                state = advance(state, now, bool(passed))
                rows.append((user, item, event, now, *state))
            yield pd.DataFrame(rows, columns=out.names)

    wanted = attempts.select(*KEY, "event_id", "submitted_at", "passed")
    return wanted.repartition(*KEY).sortWithinPartitions(*KEY, "submitted_at", "event_id").mapInPandas(run, out)


def inactive_accounts(users: DataFrame, attempts: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Users whose last attempt, or else creation, is more than ``days`` days before ``now``."""
    last = attempts.groupBy("user_id").agg(F.max("submitted_at").alias("last_at"))
    seen = users.join(last, "user_id", "left").withColumn("seen_at", F.coalesce("last_at", "created_at"))
    return seen.where(F.col("seen_at") < now - F.make_dt_interval(F.lit(days)))


def check_update_guard(old: DataFrame, new: DataFrame, key: str, may_change: str) -> DataFrame:
    """Keys whose update changes anything but ``may_change``, or sets that back from true to false."""
    fixed = [c for c in old.columns if c not in (key, may_change)]
    both = old.alias("o").join(new.alias("n"), key)
    changed = F.lit(False)
    for c in fixed:
        changed = changed | ~F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}"))
    back = F.col(f"o.{may_change}") & ~F.col(f"n.{may_change}")
    return both.where(changed | back).select(key)


def check_constraints(df: DataFrame, key: list[str], domains: dict[str, list], parents: dict[str, DataFrame]) -> DataFrame:
    """(rule, violations): repeated keys, values outside a domain, and orphans of ``parents`` (column -> its keys)."""
    out = [df.groupBy(*key).count().where("count > 1").agg(F.lit("unique").alias("rule"), F.count("*").alias("violations"))]
    out += [df.agg(F.lit(f"domain {c}").alias("rule"), F.count_if(~F.col(c).isin(*v)).alias("violations")) for c, v in domains.items()]
    out += [df.where(F.col(c).isNotNull()).join(p.select(F.col(p.columns[0]).alias(c)), c, "left_anti").agg(F.lit(f"orphan {c}").alias("rule"), F.count("*").alias("violations")) for c, p in parents.items()]
    found = out[0]
    for x in out[1:]:
        found = found.union(x)
    return found


def upsert(target: DataFrame, updates: DataFrame, keys: list[str], keep_target: bool = False) -> DataFrame:
    """Rows of both by key; on a clash the update wins, or with ``keep_target`` the row that was there."""
    base, more = (updates, target) if not keep_target else (target, updates)
    return more.join(base.select(*keys), keys, "left_anti").unionByName(base, allowMissingColumns=True)


def promote(models: DataFrame, model_id: Column) -> DataFrame:
    """Makes one model the only active one."""
    return models.withColumn("is_active", F.col("model_id") == model_id)


def rollback_signals(attempts: DataFrame) -> DataFrame:
    """Pass rate per model version and day, with the change from the day before."""
    daily = attempts.groupBy("model_id", F.to_date("submitted_at").alias("day")).agg(F.count("*").alias("n"), F.avg(F.col("passed").cast("int")).alias("pass_rate"))
    return daily.withColumn("change", F.col("pass_rate") - F.lag("pass_rate").over(W.partitionBy("model_id").orderBy("day")))


def time_to_mastery_by(history: DataFrame, users: DataFrame, bucket: str) -> DataFrame:
    """Items mastered and their mean time to mastery (microseconds) for each bucket of users; users without one are null."""
    per = time_to_mastery(history).join(users.select("user_id", bucket), "user_id", "left")
    return per.groupBy(bucket).agg(F.count("*").alias("n"), F.avg("micros").alias("micros"))


def release(models: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """The table of models with one new or known version (a row with model_id and other columns) as its only active one, promoted ``now``; a known version keeps what the row does not say."""
    others = models.join(new.select("model_id"), "model_id", "left_anti").withColumn("is_active", F.lit(False))
    given = [c for c in new.columns if c not in ("model_id", "is_active", "promoted_at")]
    known = models.select("model_id", *[F.col(c).alias(f"__{c}") for c in models.columns if c != "model_id"])
    row = new.select("model_id", *given).join(known, "model_id", "left")
    value = lambda c: F.coalesce(F.col(c), F.col(f"__{c}")) if c in given else F.col(f"__{c}")
    made = {"model_id": F.col("model_id"), "is_active": F.lit(True), "promoted_at": now}
    return others.unionByName(row.select(*[made.get(c, value(c) if c not in made else None).alias(c) for c in models.columns]))


def check_ranges(df: DataFrame, ranges: dict[str, tuple[float, float]], one_of: dict[str, Column] | None = None) -> DataFrame:
    """(rule, violations): values outside low to high, and rows beyond the one that a condition may hold for."""
    out = [df.agg(F.lit(f"range {c}").alias("rule"), F.count_if(~F.col(c).between(a, b)).alias("violations")) for c, (a, b) in ranges.items()]
    out += [df.agg(F.lit(f"one {n}").alias("rule"), F.greatest(F.count_if(c) - 1, F.lit(0)).alias("violations")) for n, c in (one_of or {}).items()]
    found = out[0]
    for x in out[1:]:
        found = found.union(x)
    return found


def rollback_report(attempts: DataFrame) -> DataFrame:
    """Pass rate and share of disagreeing learners per model version and day, with the changes from the version's day before."""
    rate = lambda c: F.avg(F.coalesce(F.col(c), F.lit(False)).cast("int"))
    daily = attempts.groupBy("model_id", F.to_date("submitted_at").alias("day")).agg(F.count("*").alias("n"), rate("passed").alias("pass_rate"), rate("disagreed").alias("disagreed"))
    order = W.partitionBy("model_id").orderBy("day")
    return daily.withColumns({f"{c}_change": F.col(c) - F.lag(c).over(order) for c in ("pass_rate", "disagreed")})
