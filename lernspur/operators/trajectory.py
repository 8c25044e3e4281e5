"""Feature trajectories: rows (clip, sign, traj) with traj an array over time of arrays of features, null where missing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T


def long_form(df: DataFrame) -> DataFrame:
    """(clip, sign, t, f, v), missing values included."""
    steps = df.select("clip", "sign", F.posexplode("traj").alias("t", "row"))
    return steps.select("clip", "sign", "t", F.posexplode("row").alias("f", "v"))


def valid_trajectory(df: DataFrame) -> DataFrame:
    """Trajectories with at least one value."""
    return df.where(F.exists(F.flatten("traj"), lambda v: v.isNotNull()))


def to_dense(traj: Column) -> Column:
    """Missing values as 0."""
    return F.transform(traj, lambda row: F.transform(row, lambda v: F.coalesce(v, F.lit(0.0))))


def strip_features(traj: Column, first: int, last: int) -> Column:
    """Features ``first`` to ``last`` as 0."""
    return F.transform(traj, lambda row: F.transform(row, lambda v, i: F.when(i.between(first, last), 0.0).otherwise(v)))


def mirror(traj: Column, permutation: list[int], signs: list[float]) -> Column:
    """Feature i of every step becomes signs[i] x feature permutation[i]."""
    places = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(s).alias("s")) for p, s in zip(permutation, signs, strict=True)])
    return F.transform(traj, lambda row: F.transform(places, lambda x: F.get(row, x["p"]) * x["s"]))


def body_mirror(width: int = 100) -> tuple[list[int], list[float]]:
    """Permutation and signs that swap the two hands and negate x, for hands of 21 points and a pose of 8 points.

    Width 100 has the points alone, 108 four more values a hand (location and orientation, x and y), 356 an embedding
    of 128 values a hand, which changes place but not sign.
    """
    extra = {100: 0, 108: 4, 356: 128}
    if width not in extra:
        raise ValueError(f"no mirror for width {width}")
    slot = 42 + extra[width]
    hand = [-1.0 if i % 2 == 0 and i < (46 if width == 108 else 42) else 1.0 for i in range(slot)]
    pose = [0, 1, 3, 2, 5, 4, 7, 6]  # left and right change places
    order = [*range(slot, 2 * slot), *range(slot), *(2 * slot + 2 * p + c for p in pose for c in (0, 1))]
    return order, [*hand, *hand, *[-1.0, 1.0] * 8]


def dense(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, values with NaN where missing) of a list<list<double>> column, for each shape that occurs; rows that are empty or of unlike widths are left out."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    rows = column.flatten()
    values = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    steps, widths = (np.nan_to_num(c.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64) for c in (column, rows))
    first, start = np.concatenate([[0], np.cumsum(steps)]), np.concatenate([[0], np.cumsum(widths)])
    shapes: dict[tuple[int, int], list[int]] = {}
    for i, n in enumerate(steps.tolist()):
        own = widths[first[i] : first[i + 1]]
        if n and own[0] and (own == own[0]).all():
            shapes.setdefault((n, int(own[0])), []).append(i)
    return [(np.array(at), np.stack([values[start[first[i]] : start[first[i + 1]]].reshape(shape) for i in at])) for shape, at in shapes.items()]


def nested(x: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Values (B, n, F) as a list<list<double>> column, NaN as null."""
    size, n, width = x.shape
    values = pa.array(x.ravel(), from_pandas=True)
    rows = pa.ListArray.from_arrays(np.arange(size * n + 1, dtype=np.int32) * width, values)
    return pa.ListArray.from_arrays(np.arange(size + 1, dtype=np.int32) * n, rows).cast(kind)


def resampled(x: np.ndarray, steps: int) -> np.ndarray:
    """Trajectories (B, n, F) on ``steps`` even times: linear between present values, end values beyond them, missing where a feature has none."""
    size, n, width = x.shape
    if n == 1:
        return np.repeat(x, steps, axis=1)
    there, at = ~np.isnan(x), np.arange(n)[None, :, None]
    before = np.maximum.accumulate(np.where(there, at, -1), axis=1)
    after = np.minimum.accumulate(np.where(there, at, n)[:, ::-1], axis=1)[:, ::-1]
    grid = np.linspace(0, n - 1, steps)
    lo, hi = before[:, np.floor(grid).astype(int)], after[:, np.ceil(grid).astype(int)]
    lo, hi = np.where(lo < 0, hi, lo), np.where(hi >= n, lo, hi)
    none = (lo < 0) | (lo >= n)
    lo, hi = np.where(none, 0, lo), np.where(none, 0, hi)
    a, b = np.take_along_axis(x, lo, axis=1), np.take_along_axis(x, hi, axis=1)
    share = np.where(hi > lo, (grid[None, :, None] - lo) / np.maximum(hi - lo, 1), 0.0)
    return np.where(none, np.nan, a + (b - a) * np.clip(share, 0.0, 1.0))


def resample(df: DataFrame, steps: int) -> DataFrame:
    """``traj`` on ``steps`` even times: linear between present values, end values beyond them, null where a feature has none.

    A trajectory of the right length stays as it is; one of a single step repeats it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 256):
                batch = whole.slice(first, 256)
                old = batch.column("traj")
                done: list = [None] * batch.num_rows
                for rows, x in dense(old):
                    if x.shape[1] != steps:
                        for i, y in zip(rows.tolist(), resampled(x, steps), strict=True):
                            done[i] = y
                # what is of the right length, empty, null or of unlike widths stays
                parts = [nested(y[None], old.type) if y is not None else old.slice(i, 1) for i, y in enumerate(done)]
                traj = pa.concat_arrays(parts) if parts else old
                yield pa.RecordBatch.from_arrays([traj if c == "traj" else batch.column(c) for c in batch.schema.names], names=batch.schema.names)

    return df.mapInArrow(run, df.schema)


def fit_gaussian(df: DataFrame, least_clips: int = 5, least_var: float = 0.001) -> DataFrame:
    """Mean and variance per (sign, t, f) over present values, variance at least ``least_var``; signs with too few clips go."""
    enough = df.groupBy("sign").agg(F.countDistinct("clip").alias("clips")).where(F.col("clips") >= least_clips)
    fitted = long_form(df).groupBy("sign", "t", "f").agg(F.avg("v").alias("mean"), F.var_pop("v").alias("var"))
    return fitted.join(enough, "sign").withColumn("var", F.greatest(F.col("var"), F.lit(least_var)))


def motion_ratio(df: DataFrame, half: int, threshold: float = 0.30, until: int | None = None) -> DataFrame:
    """Mean deviation over time of the features from ``half`` on (before ``until``) over that of those before; one-handed under the threshold.

    Where a feature of a clip has no value at all, the ratio is 1, as it is where a side has no feature.
    """
    spread = long_form(df).groupBy("sign", "clip", "f").agg(F.stddev_pop("v").alias("s"))
    side = F.when(F.col("f") < half, "a").when(F.lit(until is None) | (F.col("f") < (until or 0)), "b")
    per = spread.groupBy("sign").agg(*[F.avg(F.when(side == x, F.col("s"))).alias(x) for x in ("a", "b")], F.count_if(side.isNotNull() & F.col("s").isNull()).alias("gaps"))
    ratio = F.when(F.col("gaps") > 0, 1.0).otherwise(F.coalesce(F.col("b") / F.greatest(F.col("a"), F.lit(1e-6)), F.lit(1.0)))
    return per.select("sign", ratio.alias("ratio")).withColumn("one_handed", F.col("ratio") < threshold)


def clip_distance(a: Column, b: Column) -> Column:
    """Mean squared difference over values present in both; infinity if there are none."""
    d = F.zip_with(F.flatten(a), F.flatten(b), lambda x, y: (x - y) * (x - y))
    seen = F.filter(d, lambda v: v.isNotNull())
    return F.when(F.size(seen) > 0, F.aggregate(seen, F.lit(0.0), lambda s, v: s + v) / F.size(seen)).otherwise(F.lit(float("inf")))


def pairwise(df: DataFrame, per_block: int = 1024) -> DataFrame:
    """Distances of all clip pairs of a sign, first id lower.

    Clips are dealt to blocks of about ``per_block`` by sign, and every two blocks that share one meet; no block is
    written more than once, and pairs leave a task in batches.
    """
    known = df.where(F.col("sign").isNotNull() & F.col("clip").isNotNull())
    schema = T.StructType([df.schema["sign"], T.StructField("a", df.schema["clip"].dataType), T.StructField("b", df.schema["clip"].dataType), T.StructField("distance", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell in range(batch.num_rows):
                clip, sign, x, in_x = block_of(batch, cell, "a")
                other, other_sign, y, in_y = block_of(batch, cell, "b")
                x, in_x, y, in_y = evened(x, in_x, y, in_y)
                own, codes = codes_of(sign, other_sign)
                place = pc.rank(pa.concat_arrays([clip, other]), sort_keys="ascending", tiebreaker="dense").to_numpy()
                after = np.lexsort((place[len(x) :], codes))  # the other block's clips by sign and id
                ids, (begins, ends) = place[len(x) :][after], (np.searchsorted(codes[after], own, side=s) for s in ("left", "right"))
                found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
                size = 0
                for i in range(len(x)):
                    begin = begins[i] + np.searchsorted(ids[begins[i] : ends[i]], place[i], side="right")
                    j = after[begin : ends[i]]
                    if len(j):
                        found.append((np.full(len(j), i), j, mean_squares(x[i][None], in_x[i][None], y[j], in_y[j])))
                        size += len(j)
                    if found and (size >= 65_536 or i == len(x) - 1):
                        a, b, away = (np.concatenate(c) for c in zip(*found, strict=True))
                        a, found, size = pa.array(a), [], 0
                        yield pa.RecordBatch.from_arrays([sign.take(a), clip.take(a), other.take(pa.array(b)), pa.array(away)], names=schema.names)

    a, b = cells(known, known, per_block)
    return a.join(b, (F.col("a_first") <= F.col("b_last")) & (F.col("b_first") <= F.col("a_last"))).mapInArrow(run, schema)


def medoid(df: DataFrame) -> DataFrame:
    """Per sign the clip with the least sum of distances to the others, lowest id on ties; a lone clip is its sign's.

    Clips that miss the same values are summed up together: over such a group, squared differences to a clip sum up to the
    group's size times its variance plus the squared distance from its mean. So every clip meets the groups of its sign,
    not its clips, and copies have the very same sum.
    """
    flat = df.select("sign", "clip", F.coalesce(F.flatten("traj"), F.array().cast("array<double>")).alias("x"))
    there = F.filter(F.transform("x", lambda v, i: F.when(v.isNotNull(), i)), lambda i: i.isNotNull())
    clips = flat.withColumn("seen", there)
    values = clips.select("sign", "seen", F.posexplode("x").alias("i", "v")).where("v IS NOT NULL")
    per = values.groupBy("sign", "seen", "i").agg(F.avg("v").alias("mean"), F.var_pop("v").alias("var"))
    found = per.groupBy("sign", "seen").agg(F.array_sort(F.collect_list(F.struct("i", "mean", "var"))).alias("of"))
    sizes = clips.groupBy("sign", "seen").agg(F.count("*").alias("n"))
    placed = F.transform(F.sequence(F.lit(0), F.array_max("seen")), lambda i: F.get("of", F.array_position("seen", i).cast("int") - 1))
    groups = sizes.join(found, ["sign", "seen"], "left").select("sign", F.size("seen").alias("values"), "n", F.coalesce(F.when(F.size("seen") > 0, placed), F.array()).alias("of"))
    met = flat.groupBy("sign", "x").agg(F.min("clip").alias("clip")).join(groups, "sign", "left")
    d = F.filter(F.zip_with("x", "of", lambda v, o: (v - o["mean"]) * (v - o["mean"]) + o["var"]), lambda v: v.isNotNull())
    apart = F.col("n") * F.aggregate(d, F.lit(0.0), lambda s, v: s + v) / F.size(d)
    alone = (F.col("values") == 0) & (F.col("n") == 1) & ~F.exists("x", lambda v: v.isNotNull())  # a clip without values, met by no other
    distance = F.when(F.col("n").isNull() | alone, 0.0).when(F.size(d) > 0, apart).otherwise(float("inf"))
    sums = met.groupBy("sign", "x").agg(F.min("clip").alias("clip"), F.sum(distance).alias("total"))
    return sums.groupBy("sign").agg(F.min_by("clip", F.struct("total", "clip")).alias("clip"), F.min("total").alias("total"))


def template_arrays(templates: DataFrame) -> DataFrame:
    """One row per sign, with mean and var as arrays over time of arrays of features, from one row per (sign, t, f)."""
    rows = templates.groupBy("sign", "t").agg(F.array_sort(F.collect_list(F.struct("f", "mean", "var"))).alias("r"))
    steps = rows.groupBy("sign").agg(F.array_sort(F.collect_list(F.struct("t", "r"))).alias("s"))
    return steps.select("sign", F.transform("s", lambda x: F.transform(x["r"], lambda y: y["mean"])).alias("mean"), F.transform("s", lambda x: F.transform(x["r"], lambda y: y["var"])).alias("var"))


def mask_other_hand(templates: DataFrame, flags: DataFrame, first: int = 42, last: int = 83) -> DataFrame:
    """Templates of one-handed signs without the features of the second hand, which then do not count in scores. ``flags`` has sign and one_handed."""
    known = templates.join(flags.select("sign", "one_handed"), "sign", "left")
    masked = F.transform("mean", lambda row: F.transform(row, lambda v, f: F.when(~f.between(first, last), v)))
    return known.withColumn("mean", F.when(F.col("one_handed"), masked).otherwise(F.col("mean"))).drop("one_handed")


def gaussian_scores(df: DataFrame, templates: DataFrame) -> DataFrame:
    """Mean of squared deviation over variance of every clip against every template, in the clip's own row; ``templates`` is one row per sign (template_arrays)."""
    each = templates.select("sign", F.flatten("mean").alias("m"), F.flatten("var").alias("s"))
    met = df.select("clip", F.col("sign").alias("label"), F.flatten("traj").alias("x")).crossJoin(each)
    z = F.zip_with(F.zip_with("x", "m", lambda x, m: (x - m) * (x - m)), "s", lambda d, v: d / v)
    seen = met.select("clip", "label", "sign", F.explode(F.array(F.filter(z, lambda v: v.isNotNull()))).alias("z")).where(F.size("z") > 0)
    return seen.select("clip", "label", "sign", (F.aggregate("z", F.lit(0.0), lambda s, v: s + v) / F.size("z")).alias("score"))


def predict(scores: DataFrame) -> DataFrame:
    """Best sign of each clip, least score first, with its softmax confidence over negative scores."""
    of = W.partitionBy("clip")
    e = F.exp(F.min("score").over(of) - F.col("score"))
    p = scores.withColumn("confidence", e / F.sum(e).over(of))
    return p.groupBy("clip", "label").agg(F.min_by("sign", F.struct("score", "sign")).alias("best"), F.max("confidence").alias("confidence"))


def forward_fill(df: DataFrame, group: str, order: list[str], value: str) -> DataFrame:
    """Last present value, before the first present one that; 0 where there is none at all."""
    w = W.partitionBy(group).orderBy(*order)
    back = F.last(value, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    ahead = F.first(value, ignorenulls=True).over(w.rowsBetween(0, W.unboundedFollowing))
    return df.withColumn("filled", F.coalesce(back, ahead, F.lit(0.0)))


def interpolate_keys(df: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """Missing values linear between the present ones around them, the nearest beyond the ends."""
    w = W.partitionBy(group).orderBy(order)
    key = F.when(F.col(value).isNotNull(), F.struct(F.col(order).alias("t"), F.col(value).alias("v")))
    both = df.withColumn("__a", F.last(key, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("__b", F.first(key, ignorenulls=True).over(w.rowsBetween(0, W.unboundedFollowing)))
    a, b = F.col("__a"), F.col("__b")
    share = F.when(b["t"] > a["t"], (F.col(order) - a["t"]) / (b["t"] - a["t"])).otherwise(0.0)
    return both.withColumn("filled", F.when(a.isNull(), b["v"]).when(b.isNull(), a["v"]).otherwise(a["v"] + (b["v"] - a["v"]) * share)).drop("__a", "__b")


def median3(df: DataFrame, group: str, order: list[str], value: str) -> DataFrame:
    """Median of a value and its two neighbours; the ends stay."""
    w = W.partitionBy(group).orderBy(*order)
    p, n = F.lag(value).over(w), F.lead(value).over(w)
    middle = F.greatest(F.least(p, F.col(value)), F.least(F.greatest(p, F.col(value)), n))
    return df.withColumn("smooth", F.when(p.isNull() | n.isNull(), F.col(value)).otherwise(middle))


def ema(df: DataFrame, group: str, order: list[str], value: str, alpha: float = 0.4, most_missed: int = 8) -> DataFrame:
    """Exponential smoothing in order; a missing value holds the last up to ``most_missed`` times in a row, then resets."""
    rows = df.select(group, *order, F.col(value).cast("double").alias("smooth"))
    schema = rows.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, s, missed = object(), None, 0
        for batch in batches:
            out = []
            for k, v in zip(batch.column(0).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                if k != key:
                    key, s, missed = k, None, 0
                if v is None:
                    missed += 1
                    s = None if missed > most_missed else s
                else:
                    s, missed = v if s is None else s + (v - s) * alpha, 0
                out.append(s)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.float64())], names=batch.schema.names)

    # a key's rows stream through one task in order, which holds the last state alone
    return rows.repartition(group).sortWithinPartitions(group, *order, "smooth").mapInArrow(run, schema)


def active_window(df: DataFrame, group: str, order: list[str], active: Column) -> DataFrame:
    """Rows from the first to the last active one of each group."""
    numbered = df.withColumn("__n", F.row_number().over(W.partitionBy(group).orderBy(*order)))
    of = W.partitionBy(group)
    marked = numbered.withColumn("__lo", F.min(F.when(active, F.col("__n"))).over(of)).withColumn("__hi", F.max(F.when(active, F.col("__n"))).over(of))
    return marked.where((F.col("__n") >= F.col("__lo")) & (F.col("__n") <= F.col("__hi"))).drop("__n", "__lo", "__hi")


def streaks(df: DataFrame, group: str, order: list[str], hit: Column, required: int = 3) -> DataFrame:
    """Length of the run of hits that ends at each row, and whether the group is unlocked by then."""
    w = W.partitionBy(group).orderBy(*order)
    marked = df.withColumn("__hit", hit).withColumn("__i", F.sum((~hit).cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    run = F.sum(F.col("__hit").cast("int")).over(W.partitionBy(group, "__i").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    counted = marked.withColumn("streak", run)
    return counted.withColumn("unlocked", F.max("streak").over(w.rowsBetween(W.unboundedPreceding, 0)) >= required).drop("__hit", "__i")


def drop_empty_steps(df: DataFrame, group: str, active: Column, least: int = 2) -> DataFrame:
    """The active rows of each group, or all its rows where fewer than ``least`` are active."""
    n = F.sum(active.cast("int")).over(W.partitionBy(group))
    return df.withColumn("__n", n).where(active | (F.col("__n") < least)).drop("__n")


def trim_fraction(traj: Column, start: float, stop: float, least: int = 3) -> Column:
    """The steps from share ``start`` to share ``stop``, rounded half to even, if ``least`` or more remain."""
    a, b = F.bround(F.size(traj) * start).cast("int"), F.bround(F.size(traj) * stop).cast("int")
    return F.when(b - a >= least, F.slice(traj, a + 1, F.greatest(b - a, F.lit(0)))).otherwise(traj)


def nearest_clip_scores(df: DataFrame, references: DataFrame, variance: float = 0.05) -> DataFrame:
    """Least mean squared distance over a fixed variance of every clip to the reference clips of each sign. For few references; nearest_in_blocks takes any number."""
    refs = references.select(F.col("sign").alias("ref_sign"), F.col("clip").alias("ref"), F.col("traj").alias("ref_traj"))
    pairs = df.join(refs, F.col("clip") != F.col("ref"))
    return pairs.groupBy("clip", "sign", "ref_sign").agg(F.min(clip_distance(F.col("traj"), F.col("ref_traj")) / variance).alias("score"))


def flat_values(column: pa.ChunkedArray | pa.Array, width: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """A list<double> column as (rows, width) values, 0 where missing, and whether each is there; shorter rows end in missing values."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    values = column.flatten()
    width = max(width, 1, int(sizes.max(initial=0)))
    at = np.repeat(np.arange(len(sizes)) * width - np.cumsum(sizes) + sizes, sizes) + np.arange(len(values))
    x, there = np.zeros(len(sizes) * width), np.zeros(len(sizes) * width, dtype=bool)
    there[at] = values.is_valid().to_numpy(zero_copy_only=False)
    x[at] = values.fill_null(0.0).to_numpy(zero_copy_only=False)
    return x.reshape(-1, width), there.reshape(-1, width)


def evened(*sides: np.ndarray) -> list[np.ndarray]:
    """Arrays of one width, shorter rows end in missing values."""
    width = max(v.shape[1] for v in sides)
    return [np.pad(v, ((0, 0), (0, width - v.shape[1]))) for v in sides]


def mean_squares(x: np.ndarray, in_x: np.ndarray, y: np.ndarray, in_y: np.ndarray) -> np.ndarray:
    """Row by row (either side may be one row) the mean squared difference over values that both have; infinity if there are none."""
    both = in_x & in_y
    d = np.where(both, x - y, 0.0)
    n = both.sum(axis=-1)
    return np.where(n > 0, np.einsum("ij,ij->i", d, d) / np.maximum(n, 1), np.inf)


def in_blocks(df: DataFrame, parts: int, per_block: int, into: str, by: list) -> DataFrame:
    """Clips with sign and values as rows of at most ``per_block`` clips, arrays ``into``_clip, ``into``_sign and ``into``_x, in ``parts`` partitions by ranges of sign and ``by``; ``into``_first and ``into``_last are the first and last sign."""
    flat = df.select("clip", "sign", F.coalesce(F.flatten("traj"), F.array().cast("array<double>")).alias("x"), *by)
    kinds = {c: flat.schema[c].dataType for c in ("clip", "sign", "x")}
    schema = T.StructType([T.StructField(f"{into}_{c}", T.ArrayType(k)) for c, k in kinds.items()] + [T.StructField(f"{into}_{c}", kinds["sign"]) for c in ("first", "last")])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            columns = [pa.concat_arrays([b.column(c) for b in held]) for c in kinds]
            lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns]
            return pa.RecordBatch.from_arrays([*lists, columns[1].slice(0, 1), columns[1].slice(len(columns[1]) - 1)], names=schema.names)

        held, size = [], 0
        for batch in batches:
            while batch.num_rows:
                some = batch.slice(0, per_block - size)
                held, size, batch = [*held, some], size + some.num_rows, batch.slice(some.num_rows)
                if size == per_block:
                    yield row(held)
                    held, size = [], 0
        if held:
            yield row(held)

    # the number of partitions is that of the tasks that meet
    order = ["sign", *flat.columns[3:]]
    return flat.repartitionByRange(parts, *order).coalesce(parts).sortWithinPartitions(*order).mapInArrow(pack, schema)


def sized(df: DataFrame, per_block: int) -> tuple[int, int, int]:
    """(clips, values of a clip at most, clips of a block): of wide clips a block holds fewer."""
    n, width = df.agg(F.count("*"), F.max(F.size(F.flatten("traj")))).first()
    width = max(1, width or 1)
    return n, width, max(1, min(per_block, (1 << 21) // width))


def cells(df: DataFrame, references: DataFrame, per_block: int) -> tuple[DataFrame, DataFrame]:
    """Both sides in blocks, to be met by ``shuffle_replicate_nl``: every task takes one block of clips, reads a partition of the references, and no block is written more than once."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    (n, _, per), (m, width, per_other) = sized(df, per_block), sized(references, per_block)
    by = [F.xxhash64("clip").alias("h")]
    a = in_blocks(df, max(1, -(-n // per), min(3 * cores, n // 256)), per, "a", by)
    return a.hint("shuffle_replicate_nl"), in_blocks(references, max(1, -(-m * width // (1 << 23))), per_other, "b", by)


def block_of(batch: pa.RecordBatch, i: int, side: str) -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray]:
    """Clips, signs, values and whether each is there, of one side of a cell."""
    clip, sign, x = (batch.column(f"{side}_{c}").slice(i, 1).flatten() for c in ("clip", "sign", "x"))
    return clip, sign, *flat_values(x)


def codes_of(a: pa.Array, b: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers for the values of two arrays, -1 for null."""
    codes = pa.concat_arrays([a, b]).dictionary_encode().indices.fill_null(-1).to_numpy()
    return codes[: len(a)], codes[len(a) :]


def equal_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of equal whole numbers."""
    order = np.argsort(b, kind="stable")
    lo, hi = (np.searchsorted(b[order], a, side=s) for s in ("left", "right"))
    n = hi - lo
    return np.repeat(np.arange(len(a)), n), order[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]


def _factors(y: np.ndarray, in_y: np.ndarray) -> tuple[np.ndarray, float, np.ndarray, np.ndarray, float]:
    """What ``_least`` multiplies clips with: references about their mean, in a unit in which none exceeds 1, as single precision."""
    middle = y.sum(axis=0) / np.maximum(in_y.sum(axis=0), 1)
    z = np.where(in_y, y - middle, 0.0)
    unit = float(np.abs(z).max(initial=0.0)) or 1.0
    z /= unit
    right = np.ascontiguousarray(np.hstack([in_y, z * z, -2.0 * z]).T, dtype=np.float32)
    return middle, unit, right, np.ascontiguousarray(in_y.T, dtype=np.float32), float((z * z).sum(axis=1).max(initial=0.0))


def _least(x: np.ndarray, in_x: np.ndarray, y: np.ndarray, in_y: np.ndarray, same: np.ndarray | tuple, begins: np.ndarray, factors: tuple | None = None) -> np.ndarray:
    """The least mean squared difference of every row of x to each segment of y (from ``begins`` on), pairs in ``same`` left out.

    Products of matrices in single precision tell how far pairs are apart up to a stated error; every pair that could be
    the least is then measured.
    """
    middle, unit, right, right_there, most_y = factors or _factors(y, in_y)
    width, sizes = x.shape[1], np.diff([*begins, len(y)])
    segment = np.repeat(np.arange(len(begins)), sizes)
    z = np.where(in_x, (x - middle) / unit, 0.0)
    norm = (z * z).sum(axis=1) + most_y
    far = norm > 1e30  # no squares in single precision
    z[far], norm[far] = 0.0, 1.0
    away = np.hstack([z * z, in_x, z]).astype(np.float32) @ right
    n = in_x.astype(np.float32) @ right_there
    with np.errstate(invalid="ignore"):
        np.divide(away, n, out=away)
    least_n = n.min(initial=width)
    if least_n == 0:
        away[n == 0], least_n = np.inf, 1.0
    away[same] = np.inf
    parts = list(zip(begins.tolist(), [*begins[1:].tolist(), len(y)], strict=True))
    nearest = np.stack([away[:, a:b].min(axis=1) for a, b in parts], axis=1) if len(parts) <= 64 else np.minimum.reduceat(away, begins, axis=1)
    # twice the error of a sum of 3 x width products, each off by a few units of single precision, and of what falls below it
    error = (4 * (3 * width + 16) * 2.0**-24 * norm + width * 2.0**-118) / least_n
    most = np.where(np.isinf(nearest), -1.0, nearest + error[:, None]).astype(np.float32)
    most[far] = -1.0
    out = np.full((len(x), len(begins)), np.inf)
    found = np.flatnonzero((away <= (most if len(parts) == 1 else np.repeat(most, sizes, axis=1))).ravel())
    for at in range(0, len(found), 4096):
        i, j = np.divmod(found[at : at + 4096], len(y))
        np.minimum.at(out, (i, segment[j]), mean_squares(x[i], in_x[i], y[j], in_y[j]))
    for i in np.flatnonzero(far):
        d = mean_squares(x[i][None], in_x[i][None], y, in_y)
        d[np.isinf(away[i])] = np.inf
        out[i] = np.minimum.reduceat(d, begins)
    return out


def nearest_in_blocks(df: DataFrame, references: DataFrame, variance: float = 0.05, per_block: int = 4096) -> DataFrame:
    """As ``nearest_clip_scores`` with any number of references: every block of clips meets every block of references, and the least score of each is kept.

    The work is that of all pairs, dealt to tasks that hold a block of about ``per_block`` clips and a part of the
    references; each side is shuffled once. Values that are not numbers count as missing.
    """
    schema = T.StructType([df.schema["clip"], df.schema["sign"], T.StructField("ref_sign", references.schema["sign"].dataType), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell in range(batch.num_rows):
                clip, sign, x, in_x = block_of(batch, cell, "a")
                ref, ref_sign, y, in_y = block_of(batch, cell, "b")
                x, in_x, y, in_y = evened(x, in_x, y, in_y)
                for v, there in ((x, in_x), (y, in_y)):
                    there &= ~np.isnan(v)
                    v[~there] = 0.0
                _, codes = codes_of(sign.slice(0, 0), ref_sign)
                begins = np.flatnonzero(np.diff(codes, prepend=-2))  # references are ordered by sign
                sizes = np.diff([*begins, len(y)])
                segment = np.repeat(np.arange(len(begins)), sizes)
                own, other = equal_pairs(*codes_of(clip, ref))
                plain = max(np.abs(x).max(initial=0.0), np.abs(y).max(initial=0.0)) < 1e150
                factors = _factors(y, in_y) if plain else None
                for at in range(0, len(x), 512):
                    some, in_some = x[at : at + 512], in_x[at : at + 512]
                    here = slice(*np.searchsorted(own, [at, at + len(some)]))
                    same = own[here] - at, other[here]
                    if plain:
                        least = _least(some, in_some, y, in_y, same, begins, factors)
                    else:
                        with np.errstate(invalid="ignore"):
                            away = np.stack([mean_squares(v[None], there[None], y, in_y) for v, there in zip(some, in_some, strict=True)])
                        away[same] = np.inf
                        least = np.fmin.reduceat(away, begins, axis=1)
                    met = np.zeros(least.shape, dtype=np.int64)
                    np.add.at(met, (same[0], segment[same[1]]), 1)
                    i, g = np.nonzero(met < sizes)
                    row, begin = pa.array(i + at), pa.array(begins[g])
                    yield pa.RecordBatch.from_arrays([clip.take(row), sign.take(row), ref_sign.take(begin), pa.array(least[i, g] / variance)], names=schema.names)

    a, b = cells(df.where(F.col("clip").isNotNull()), references.where(F.col("clip").isNotNull()), per_block)
    return a.crossJoin(b).mapInArrow(run, schema).groupBy("clip", "sign", "ref_sign").agg(F.min("score").alias("score"))
