"""Ranks and prefix sums inside groups of any size.

A group may hold most rows, so it is never ordered in one task: rows are dealt
into slices of the order, each slice is ranked on its own and shifted by the
slices before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def seeded(key: Column, seed: str) -> Column:
    """md5 of seed and key: the order that stands in for a seeded shuffle."""
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")).cast("binary"))


def hash_rank(df: DataFrame, groups: list[str], key: str, seed: str, into: str = "rank", size: str = "group_size") -> DataFrame:
    """1-based rank of each row in its group by seeded hash, and the size of its group."""
    hashed = df.withColumn("__h", seeded(F.col(key), seed)).withColumn("__s", F.substring("__h", 1, 3))
    counts = hashed.groupBy(*groups, "__s").agg(F.count("*").alias("__n"))
    by = W.partitionBy(*groups) if groups else W.partitionBy(F.lit(0))
    shifts = counts.select(*groups, "__s", F.coalesce(F.sum("__n").over(by.orderBy("__s").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__shift"), F.sum("__n").over(by).alias(size))
    inside = F.row_number().over(W.partitionBy(*groups, "__s").orderBy("__h", key))
    ranked = hashed.withColumn("__r", inside).join(shifts, [*groups, "__s"])
    return ranked.withColumn(into, F.col("__r") + F.col("__shift")).drop("__h", "__s", "__r", "__shift")


def running_sums(df: DataFrame, group: str, value: str, sums: dict[str, str], descending: bool = False, ties: list[str] | None = None, rows_per_slice: int = 100_000) -> DataFrame:
    """Adds to every row the sums of columns (name -> column) over its group up to and with it, in the order of ``value`` and then ``ties``.

    A group's values are cut at about even quantiles into slices of about ``rows_per_slice`` rows, each slice is summed
    on its own and shifted by the slices before it, so no task holds more of a group than a slice. Rows of one value
    stay together. Groups and slices, not rows, are what the shifts hold; rows without a value come last. Nulls of ``value`` are not counted when slices are sized.
    """
    sizes = df.groupBy(group).agg(F.count(value).alias("n"))
    most = sizes.agg(F.max("n")).first()[0] or 0
    parts = max(1, min(10_000, -(-most // rows_per_slice)))
    order = F.col(value).desc_nulls_last() if descending else F.col(value).asc_nulls_last()
    if parts == 1:  # every group is a slice
        whole = W.partitionBy(group).orderBy(order, *(ties or [])).rowsBetween(W.unboundedPreceding, 0)
        return df.withColumns({n: F.sum(c).over(whole) for n, c in sums.items()})
    at = df.groupBy(group).agg(F.percentile_approx(value, [i / parts for i in range(1, parts)], max(10_000, 4 * parts)).alias("__cuts"))
    cut = at.select(F.col(group).alias("__g"), F.array_distinct("__cuts").alias("__cuts"))
    placed = df.join(cut, F.col(group).eqNullSafe(F.col("__g")), "left")
    # the number of cuts below a value, by halving
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(parts.bit_length()))])
    below = F.aggregate(steps, F.lit(0), lambda s, x: s + F.when(F.get("__cuts", s + x - 1) < F.col(value), x).otherwise(0))
    sliced = placed.withColumn("__slice", F.when(F.col(value).isNull(), 1 << 30).otherwise(-below if descending else below)).drop("__g", "__cuts")
    inside = W.partitionBy(group, "__slice").orderBy(order, *(ties or [])).rowsBetween(W.unboundedPreceding, 0)
    per = sliced.groupBy(group, "__slice").agg(*[F.sum(c).alias(f"__{n}") for n, c in sums.items()])
    before = W.partitionBy(group).orderBy("__slice").rowsBetween(W.unboundedPreceding, -1)
    shift = per.select(F.col(group).alias("__g"), F.col("__slice").alias("__s"), *[F.coalesce(F.sum(f"__{n}").over(before), F.lit(0)).alias(f"__{n}") for n in sums])
    summed = sliced.withColumns({n: F.sum(c).over(inside) for n, c in sums.items()})
    both = summed.join(shift, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__slice") == F.col("__s")))
    return both.withColumns({n: F.col(n) + F.col(f"__{n}") for n in sums}).drop("__g", "__s", "__slice", *[f"__{n}" for n in sums])


def exact_quantiles(df: DataFrame, group: str, value: str, shares: dict[str, float]) -> DataFrame:
    """Linear quantiles of each group by name; values are counted and then summed in slices, so no task holds those of a whole group. Missing values do not count."""
    per = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("__rows"))
    counted = running_sums(per, group, value, {"__upto": "__rows"})
    size = per.groupBy(F.col(group).alias("__of")).agg(F.sum("__rows").alias("__size"))
    met = counted.join(size, F.col(group).eqNullSafe(F.col("__of")))
    place = lambda q: (F.col("__size") - 1) * F.lit(float(q))
    first = lambda at: F.min(F.when(F.col("__upto") > at, F.col(value)))
    ends = [e for i, q in enumerate(shares.values()) for e in (first(F.floor(place(q))).alias(f"__a{i}"), first(F.ceil(place(q))).alias(f"__b{i}"))]
    found = met.groupBy(group).agg(F.max("__size").alias("__size"), *ends)
    between = lambda i, q: F.col(f"__a{i}") + (F.col(f"__b{i}") - F.col(f"__a{i}")) * (place(q) - F.floor(place(q)))
    return found.select(group, *[between(i, q).alias(name) for i, (name, q) in enumerate(shares.items())])
