"""Templates of signs and how well clips match them: clusters, banded warping, nearest clips.

``clips`` has clip, sign and traj (array over time of arrays of features, null
where missing). A template is one row a sign: sign, n_clips, one_handed, mean
and var, ``clusters`` (array of mean and var) and, for signs of few clips, the
clips themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lernspur.operators.medoids import away, medoids_of_many, share
from lernspur.operators.trajectory import clip_distance, dense, fit_gaussian, long_form, motion_ratio, template_arrays

#: Signs of fewer clips are matched by their nearest clip, in this variance.
FEW_CLIPS, CLIP_VARIANCE = 8, 0.05
#: Cost of two steps that share no value.
NO_VALUE = 1e9


# ---- scores


def warp(x: np.ndarray, mean: np.ndarray, var: np.ndarray, radius: int) -> np.ndarray:
    """Banded warping of clips (B, n, F) onto a template (c, F), over 2 c: cells are filled diagonal by diagonal, over all clips at once."""
    size, n, _ = x.shape
    c = len(mean)
    cost = np.full((n, c, size), np.inf)
    for o in range(-radius, radius + 1):
        a, z = max(0, -o), min(n, c - o)
        if z <= a:
            continue
        d = x[:, a:z] - mean[a + o : z + o]
        d *= d
        d /= var[a + o : z + o]
        there = ~np.isnan(d)
        count = there.sum(axis=2)
        at = np.arange(a, z)
        cost[at, at + o] = np.where(count > 0, np.where(there, d, 0.0).sum(axis=2) / np.maximum(count, 1), NO_VALUE).T
    total = np.full((n + 1, c + 1, size), np.inf)
    total[0, 0] = 0.0
    for k in range(2, n + c + 1):
        i = np.arange(max(1, k - c, -((radius - k) // 2)), min(n, k - 1, (k + radius) // 2) + 1)
        if len(i):
            j = k - i
            total[i, j] = cost[i - 1, j - 1] + np.minimum(np.minimum(total[i - 1, j], total[i, j - 1]), total[i - 1, j - 1])
    return total[n, c] / (2 * c)


def straight(x: np.ndarray, mean: np.ndarray, var: np.ndarray | float) -> np.ndarray:
    """Mean of squared deviation over variance over the values that both have; infinity if there are none."""
    d = (x - mean) ** 2 / var
    there = ~np.isnan(d)
    count = there.sum(axis=(1, 2))
    return np.where(count > 0, np.where(there, d, 0.0).sum(axis=(1, 2)) / np.maximum(count, 1), np.inf)


def route(template: dict) -> str:
    """``nearest`` for signs of few clips that are there, ``clusters`` where there are two or more, else ``whole``."""
    if template["clips"] and 0 < template["n_clips"] < FEW_CLIPS:
        return "nearest"
    return "clusters" if len(template["clusters"]) > 1 else "whole"


def score(x: np.ndarray, template: dict, mirrored: np.ndarray | None = None, warped: bool = True, radius: int = 8) -> np.ndarray:
    """Scores of clips (B, n, F) against one template, the least over its parts and over the mirror image; infinity where nothing fits in shape."""
    way = route(template)
    parts = [(m, CLIP_VARIANCE) for m in template["clips"]] if way == "nearest" else template["clusters"] if way == "clusters" else [template["whole"]]
    best = np.full(len(x), np.inf)
    for view in (x, mirrored):
        for mean, var in parts if view is not None else ():
            if mean.shape[1] != view.shape[2] or (mean.shape[0] != view.shape[1] and (way == "nearest" or not warped)):
                continue
            best = np.minimum(best, warp(view, mean, var, radius) if warped and way != "nearest" else straight(view, mean, var))
    return best


def mirror_image(x: np.ndarray, mirror: tuple[list[int], list[float]] | None) -> np.ndarray | None:
    return x[:, :, mirror[0]] * np.array(mirror[1]) if mirror and len(mirror[0]) == x.shape[2] else None


def _matrix(rows: list | None) -> np.ndarray:
    return np.array([[np.nan if v is None else v for v in row] for row in rows or []], dtype=np.float64).reshape(len(rows or []), -1)


def plain_template(row: T.Row, second: tuple[int, int]) -> dict:
    """A template's row as arrays; the second hand of a one-handed sign counts as missing."""

    def masked(rows: list) -> np.ndarray:
        x = _matrix(rows)
        if row["one_handed"]:
            x[:, second[0] : second[1] + 1] = np.nan
        return x

    return {
        "sign": row["sign"],
        "n_clips": row["n_clips"] or 0,
        "whole": (masked(row["mean"]), _matrix(row["var"])),
        "clusters": [(masked(c["mean"]), _matrix(c["var"])) for c in row["clusters"] or []],
        "clips": [masked(c) for c in row["clips"] or []],
    }


def in_blocks(templates: DataFrame, second: tuple[int, int], most_bytes: int) -> Iterator[list[dict]]:
    """Templates as arrays, in blocks of at most ``most_bytes`` (or one template)."""
    block, held = [], 0
    for row in templates.select("sign", "n_clips", "one_handed", "mean", "var", "clusters", "clips").toLocalIterator():
        t = plain_template(row, second)
        size = sum(a.nbytes for pair in (t["whole"], *t["clusters"]) for a in pair) + sum(a.nbytes for a in t["clips"])
        if block and held + size > most_bytes:
            yield block
            block, held = [], 0
        block.append(t)
        held += size
    if block:
        yield block


def match_scores(clips: DataFrame, templates: DataFrame, mirror: tuple[list[int], list[float]] | None = None, second: tuple[int, int] = (42, 83), warped: bool = True, radius: int = 8, most_bytes: int = 64 << 20) -> DataFrame:
    """(clip, label, sign, score, route) of every clip against every template, lower for likelier.

    By the template's own data: the nearest of its clips (fewer than 8 of them), the nearest of its clusters by
    warping, or the whole template by warping (by plain distance with ``warped`` off); each with the clip and with its
    ``mirror`` image (a permutation and signs), whichever is nearer. ``second`` are the first and last feature of the
    second hand, which do not count for one-handed signs. Every clip is read once for a block of templates; a block is
    sent to the executors and holds at most ``most_bytes``. Clips without steps or with steps of unlike width score
    infinity.
    """
    spark = clips.sparkSession
    kinds = {n: templates.schema[n].dataType for n in ("sign",)} | {"clip": clips.schema["clip"].dataType, "label": clips.schema["sign"].dataType}
    schema = T.StructType([T.StructField("clip", kinds["clip"]), T.StructField("label", kinds["label"]), T.StructField("sign", kinds["sign"]), T.StructField("score", T.DoubleType()), T.StructField("route", T.StringType())])
    wanted, out = clips.select("clip", F.col("sign").alias("label"), "traj"), None
    for block in in_blocks(templates, second, most_bytes):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            known = shared.value
            signs, routes = [t["sign"] for t in known], pa.array([route(t) for t in known])
            for whole in batches:
                for at in range(0, whole.num_rows, 64):
                    batch = whole.slice(at, 64)
                    found = np.full((batch.num_rows, len(known)), np.inf)
                    for rows, x in dense(batch.column(2)):
                        y = mirror_image(x, mirror)
                        for i, t in enumerate(known):
                            found[rows, i] = score(x, t, y, warped, radius)
                    each = pa.array(np.repeat(np.arange(batch.num_rows), len(known)))
                    kind = pa.array(np.tile(np.arange(len(known)), batch.num_rows))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(each), batch.column(1).take(each), pa.array(signs).take(kind), pa.array(found.ravel()), routes.take(kind)], names=schema.names)

        part = wanted.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)


def dtw_scores(clips: DataFrame, templates: DataFrame, radius: int = 8, most_bytes: int = 64 << 20) -> DataFrame:
    """(clip, label, sign, score) of every clip against every whole template (sign, mean, var) by banded warping, without mirror images.

    A cell is the mean squared deviation over the template step's variance; one without values costs 1e9.
    """
    nested = "array<array<double>>"
    plain = templates.select("sign", F.lit(0).alias("n_clips"), F.lit(False).alias("one_handed"), "mean", "var", F.lit(None).cast(f"array<struct<mean:{nested},var:{nested}>>").alias("clusters"), F.lit(None).cast(f"array<{nested}>").alias("clips"))
    return match_scores(clips, plain, radius=radius, most_bytes=most_bytes).drop("route")


# ---- clusters


def draw(key: str, weights: np.ndarray) -> int:
    """An index with probability in proportion to its weight, by the md5 of a key; uniform where all weights are 0."""
    u = share(key)
    total = np.cumsum(weights if weights.sum() > 0 else np.ones(len(weights)))
    return int(min(np.searchsorted(total, u * total[-1], side="right"), len(weights) - 1))


def distances(x: np.ndarray) -> np.ndarray:
    """Mean squared differences of all clips over values that both have; infinity if there are none."""
    out = np.zeros((len(x), len(x)))
    for i in range(len(x)):
        out[i] = away(x, x[i])
    np.fill_diagonal(out, 0.0)
    return out


def medoids(d: np.ndarray, k: int, key: str, rounds: int = 25) -> list[int]:
    """k medoids on a distance matrix: drawn by squared distance from those before, then rounds of assignment and of the member with the least sum of distances."""
    n = len(d)
    if k <= 1 or n <= k:
        return list(range(min(k, n)))
    chosen = [draw(f"{key}|0", np.ones(n))]
    while len(chosen) < k:
        far = np.minimum(d[:, chosen].min(axis=1), 1e150) ** 2
        far[chosen] = 0.0
        if far.sum() > 0:
            chosen.append(draw(f"{key}|{len(chosen)}", far))
        else:  # only copies of medoids are left
            chosen.append(next(i for i in range(n) if i not in chosen))
    for _ in range(rounds):
        nearest = d[:, chosen].argmin(axis=1)
        moved = []
        for c, was in enumerate(chosen):
            members = np.flatnonzero(nearest == c)
            moved.append(int(members[d[np.ix_(members, members)].sum(axis=1).argmin()]) if len(members) else was)
        if moved == chosen:
            break
        chosen = moved
    return chosen


def kmedoids(clips: DataFrame, k: int, seed: str = "42", rounds: int = 25, most: int = 512, per_block: int = 4096) -> DataFrame:
    """(sign, clip, cluster, is_medoid) of every clip: clusters of each sign around k of its clips.

    Medoids are sought among all clips of a sign: on a matrix of distances where it has at most ``most``, in blocks of
    ``per_block`` clips (operators/medoids.py) where it has more. All clips then join the nearest medoid, the first on a
    tie. Signs of k clips or fewer are one cluster. Clips of one sign must agree in shape; others are padded with missing
    values.
    """
    sought = clips.select("sign", "clip", "traj").where(F.col("sign").isNotNull() & F.col("clip").isNotNull())
    sizes = sought.groupBy("sign").agg(F.count("*").alias("n")).where(F.col("n") > max(most, k))
    many = {r["sign"]: r["n"] for r in sizes.collect()} if k > 1 else {}
    # at most one sign in ``most`` clips
    large = F.broadcast(clips.sparkSession.createDataFrame([(s,) for s in many], T.StructType([clips.schema["sign"]]))) if many else None
    some = sought.join(large, "sign", "left_anti") if many else sought
    if k <= 1:  # one cluster, around the first clip
        some = sought.join(sought.groupBy("sign").agg(F.min("clip").alias("clip")), ["sign", "clip"])
    sign, clip = (clips.schema[c].dataType for c in ("sign", "clip"))
    found_type = T.StructType([T.StructField("sign", sign), T.StructField("cluster", T.IntegerType()), T.StructField("medoid", clip), T.StructField("traj", clips.schema["traj"].dataType)])

    def find(table: pa.Table) -> pa.Table:
        order = pc.sort_indices(table, sort_keys=[("clip", "ascending")])
        table = table.take(order)
        shapes = dense(table.column("traj"))
        width = max((x.shape[1] * x.shape[2] for _, x in shapes), default=1)
        flat = np.full((table.num_rows, width), np.nan)
        for rows, x in shapes:
            flat[rows, : x.shape[1] * x.shape[2]] = x.reshape(len(rows), -1)
        key = f"{seed}|{table.column('sign')[0].as_py()}"
        if k <= 1 or table.num_rows <= k:
            chosen = [0]
        else:
            chosen = medoids(distances(flat), k, key, rounds)
        own = table.take(pa.array(chosen))
        return pa.table([own.column("sign"), pa.array(range(len(chosen)), pa.int32()), own.column("clip"), own.column("traj")], names=["sign", "cluster", "medoid", "traj"])

    found = some.groupBy("sign").applyInArrow(find, found_type)
    if many:
        chosen = [(s, c, m) for s, of in medoids_of_many(sought.join(large, "sign", "left_semi"), many, k, seed, rounds, per_block).items() for c, m in enumerate(of)]
        known = clips.sparkSession.createDataFrame(chosen, T.StructType([*found_type.fields[:2], T.StructField("clip", clip)]))
        found = found.unionByName(known.join(sought, ["sign", "clip"]).select("sign", "cluster", F.col("clip").alias("medoid"), "traj"))
    known = found.groupBy("sign").agg(F.array_sort(F.collect_list(F.struct("cluster", "medoid", F.col("traj").alias("at")))).alias("medoids"))
    met = clips.select("sign", "clip", "traj").join(known, "sign")
    away = F.transform("medoids", lambda m: F.when(m["medoid"] == F.col("clip"), F.lit(-1.0)).otherwise(clip_distance(F.col("traj"), m["at"])))
    placed = met.withColumn("away", away).withColumn("cluster", (F.array_position("away", F.array_min("away")) - 1).cast("int"))
    return placed.select("sign", "clip", "cluster", F.exists("medoids", lambda m: m["medoid"] == F.col("clip")).alias("is_medoid"))


def cluster_templates(clips: DataFrame, k: int, least_each: int = 4, least_var: float = 0.001, seed: str = "42", most: int = 512) -> DataFrame:
    """(sign, clusters): mean and var of each of k clusters, for signs of at least k x ``least_each`` clips all of whose clusters have ``least_each``."""
    many = clips.groupBy("sign").agg(F.count("*").alias("n")).where(F.col("n") >= k * least_each).select("sign")
    enough = clips.join(many, "sign", "left_semi")
    placed = kmedoids(enough, k, seed, most=most)
    sizes = placed.groupBy("sign", "cluster").agg(F.count("*").alias("n"))
    good = sizes.groupBy("sign").agg(F.min("n").alias("least"), F.count("*").alias("clusters")).where((F.col("least") >= least_each) & (F.col("clusters") == k)).select("sign")
    steps = long_form(enough).join(placed.join(good, "sign", "left_semi").select("sign", "clip", "cluster"), ["sign", "clip"])
    fitted = steps.groupBy("sign", "cluster", "t", "f").agg(F.avg("v").alias("mean"), F.greatest(F.var_pop("v"), F.lit(least_var)).alias("var"))
    fitted = fitted.withColumn("var", F.when(F.col("mean").isNotNull(), F.col("var")))
    rows = fitted.groupBy("sign", "cluster", "t").agg(F.array_sort(F.collect_list(F.struct("f", "mean", "var"))).alias("r"))
    part = lambda n: F.transform("s", lambda x: F.transform(x["r"], lambda y: y[n]))
    each = rows.groupBy("sign", "cluster").agg(F.array_sort(F.collect_list(F.struct("t", "r"))).alias("s")).select("sign", "cluster", part("mean").alias("mean"), part("var").alias("var"))
    return each.groupBy("sign").agg(F.array_sort(F.collect_list(F.struct("cluster", "mean", "var"))).alias("c")).select("sign", F.transform("c", lambda c: F.struct(c["mean"].alias("mean"), c["var"].alias("var"))).alias("clusters"))


def fit_templates(clips: DataFrame, half: int = 42, until: int | None = 84, clusters: int = 1, least_clips: int = 5, one_handed: list | None = None, threshold: float = 0.30, seed: str = "42") -> DataFrame:
    """One row a sign: sign, status, n_clips, ratio, one_handed, mean, var, clusters and clips (of signs of few clips).

    Signs under ``least_clips`` are ``too_few_clips`` and have no template. A sign is one-handed if it is listed, or if
    the features from ``half`` on, before ``until``, move less than ``threshold`` of those before.
    """
    sizes = clips.groupBy("sign").agg(F.count_distinct("clip").alias("n_clips"))
    whole = template_arrays(fit_gaussian(clips, least_clips))
    moves = motion_ratio(clips, half, threshold, until).withColumn("one_handed", F.col("one_handed") | F.col("sign").isin(one_handed or []))
    few = clips.join(sizes.where((F.col("n_clips") < FEW_CLIPS) & (F.col("n_clips") >= least_clips)).select("sign"), "sign", "left_semi")
    raw = few.groupBy("sign").agg(F.array_sort(F.collect_list(F.struct("clip", "traj"))).alias("c")).select("sign", F.transform("c", lambda c: c["traj"]).alias("clips"))
    out = sizes.join(whole, "sign", "left").join(moves, "sign", "left").join(raw, "sign", "left")
    if clusters > 1:
        out = out.join(cluster_templates(clips, clusters, seed=seed), "sign", "left")
    else:
        out = out.withColumn("clusters", F.lit(None).cast("array<struct<mean:array<array<double>>,var:array<array<double>>>>"))
    status = F.when(F.col("n_clips") < least_clips, "too_few_clips").when(F.col("mean").isNull(), "too_few_usable").otherwise("ok")
    return out.select("sign", status.alias("status"), "n_clips", "ratio", "one_handed", "mean", "var", "clusters", "clips")


def in_slice(scores: DataFrame, signs: list) -> DataFrame:
    """Scores of a closed set of signs."""
    return scores.where(F.col("sign").isin(signs))


def passing(scores: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Scores with ``passed``: at or under the sign's threshold; signs without a finite one always pass."""
    own = thresholds.select("sign", "threshold")
    known = F.col("threshold").isNotNull() & (F.col("threshold") < float("inf")) & ~F.isnan("threshold")
    return scores.join(own, "sign", "left").withColumn("passed", F.coalesce(~known | (F.col("score") <= F.col("threshold")), F.lit(True))).drop("threshold")
