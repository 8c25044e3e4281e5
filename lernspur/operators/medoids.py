"""Medoids of signs of many clips, sought among all of them.

The rules are those of ``matching.medoids`` on a distance matrix, without the
matrix: clips lie in blocks in the order of sign and id, draws go by the weights
of blocks and then of the clips of one, and sums of distances follow from the
mean and spread of the clips that miss the same values. What comes to the driver
are the weights of blocks and k medoids of a sign.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lernspur.operators.trajectory import block_of, flat_values, in_blocks


def share(key: str) -> float:
    """A number from 0 to 1 by the md5 of a key."""
    return int(hashlib.md5(key.encode()).hexdigest()[:13], 16) / float(1 << 52)


def away(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row (either side may be one row) the mean squared difference over values that both have, NaN where missing; infinity if there are none."""
    d = (x - y) ** 2
    there = ~np.isnan(d)
    count = there.sum(axis=-1)
    return np.where(count > 0, np.where(there, d, 0.0).sum(axis=-1) / np.maximum(count, 1), np.inf)


def kept(df: DataFrame) -> DataFrame:
    """Written to the folder in spark.checkpoint.dir, since it is read many times; kept on local disks where that is unset."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.persist(StorageLevel.DISK_ONLY)


def signs_of(batch: pa.RecordBatch, i: int, wanted: dict) -> Iterator[tuple]:
    """(sign, clips, values with NaN where missing) of each wanted sign of a block."""
    clip, sign, x, there = block_of(batch, i, "a")
    x[~there] = np.nan
    codes = sign.dictionary_encode()
    begins = np.flatnonzero(np.diff(codes.indices.to_numpy(), prepend=-1))
    for a, z in zip(begins, [*begins[1:], len(x)], strict=True):
        if (name := sign[int(a)].as_py()) in wanted:
            yield name, clip.slice(a, z - a), x[a:z]


def is_in(clips: pa.Array, ids: list) -> np.ndarray:
    return pc.is_in(clips, pa.array(ids, clips.type)).to_numpy(zero_copy_only=False)


def widened(*sides: np.ndarray) -> list[np.ndarray]:
    """Arrays of one width, NaN where there was none."""
    width = max(v.shape[1] for v in sides)
    return [np.pad(v, ((0, 0), (0, width - v.shape[1])), constant_values=np.nan) for v in sides]


def to_medoids(clips: pa.Array, x: np.ndarray, medoids: list[tuple]) -> np.ndarray:
    """Distances (clips, medoids); a medoid is its own nearest."""
    out = np.empty((len(x), len(medoids)))
    for c, (own, at) in enumerate(medoids):
        out[:, c] = away(*widened(x, np.array(at)[None]))
        out[is_in(clips, [own]), c] = 0.0
    return out


def weights(clips: pa.Array, x: np.ndarray, medoids: list[tuple]) -> np.ndarray:
    """What the next medoid is drawn by: the squared distance from those before."""
    if not medoids:
        return np.ones(len(x))
    far = np.minimum(to_medoids(clips, x, medoids).min(axis=1), 1e150) ** 2
    far[is_in(clips, [m[0] for m in medoids])] = 0.0
    return far


def medoids_of_many(clips: DataFrame, sizes: dict, k: int, seed: str, rounds: int, per_block: int = 4096) -> dict:
    """The k medoids of each sign in ``sizes`` (clips by sign), as ids in the order they were drawn in."""
    spark = clips.sparkSession
    even = F.size(F.array_distinct(F.transform("traj", lambda row: F.size(row)))) == 1
    usable = clips.select("sign", "clip", F.when(even, F.col("traj")).alias("traj"))
    parts = max(-(-sum(sizes.values()) // per_block), min(spark.sparkContext.defaultParallelism, sum(sizes.values()) // 256), 1)
    blocks = kept(in_blocks(usable, parts, per_block, "a", [F.col("clip").alias("h")]))
    sign_kind, clip_kind = (clips.schema[c].dataType for c in ("sign", "clip"))
    point = T.StructType([T.StructField("sign", sign_kind), T.StructField("first", clip_kind), T.StructField("weight", T.DoubleType()), T.StructField("clip", clip_kind), T.StructField("x", T.ArrayType(T.DoubleType()))])

    def points(state: dict, pick: Callable) -> list[Row]:
        """Rows (sign, first clip of the block, weight, clip, values), one for each (weight, place of a clip or None) that ``pick`` gives of the state, clips and values of a sign in a block."""
        shared = spark.sparkContext.broadcast(state)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    for sign, ids, x in signs_of(batch, i, shared.value):
                        for weight, at in pick(shared.value[sign], ids, x):
                            values = None if at is None else [None if np.isnan(v) else float(v) for v in x[at]]
                            row = {"sign": sign, "first": ids[0].as_py(), "weight": weight, "clip": None if at is None else ids[int(at)].as_py(), "x": values}
                            yield pa.RecordBatch.from_pylist([row], schema=kind)

        kind = to_arrow_schema(point)
        return blocks.mapInArrow(run, point).collect()

    def named(row: Row) -> tuple:
        return row["clip"], [np.nan if v is None else v for v in row["x"]]

    medoids: dict = {sign: [] for sign in sizes}
    for c in range(k):
        # the weight of every block, with its first clip that is no medoid
        def weigh(known: list, ids: pa.Array, x: np.ndarray) -> list[tuple]:
            free = np.flatnonzero(~is_in(ids, [m[0] for m in known]))
            return [(float(weights(ids, x, known).sum()), int(free[0]) if len(free) else None)]

        found: dict = {}
        for row in points(medoids, weigh):
            found.setdefault(row["sign"], []).append(row)
        drawn, chosen = {}, {}
        for sign, rows in found.items():
            rows.sort(key=lambda r: r["first"])
            total = np.cumsum([r["weight"] for r in rows])
            if total[-1] > 0:
                target = share(f"{seed}|{sign}|{c}") * total[-1]
                at = int(min(np.searchsorted(total, target, side="right"), np.flatnonzero([r["weight"] for r in rows])[-1]))
                drawn[sign] = (medoids[sign], rows[at]["first"], target - (total[at - 1] if at else 0.0))
            else:  # only copies of medoids are left
                chosen[sign] = named(next(r for r in rows if r["clip"] is not None))

        def draw(state: tuple, ids: pa.Array, x: np.ndarray) -> list[tuple]:
            known, first, target = state
            if ids[0].as_py() != first:
                return []
            total = np.cumsum(own := weights(ids, x, known))
            return [(0.0, int(min(np.searchsorted(total, target, side="right"), np.flatnonzero(own)[-1])))]

        chosen |= {row["sign"]: named(row) for row in points(drawn, draw)} if drawn else {}
        for sign, at in chosen.items():
            medoids[sign].append(at)

    buckets = pattern_buckets(blocks, set(medoids), sign_kind, k)
    active = set(medoids)
    for _ in range(rounds):
        moved = least_sums(blocks, {s: (medoids[s], buckets[s]) for s in active}, sign_kind, clip_kind)
        wanted = {s: {moved.get((s, c), medoids[s][c][0]) for c in range(k)} - {m[0] for m in medoids[s]} for s in active}
        wanted = {s: ids for s, ids in wanted.items() if ids}
        active = {s for s in active if any(moved.get((s, c), m[0]) != m[0] for c, m in enumerate(medoids[s]))}
        if not active:
            break
        values = {(r["sign"], r["clip"]): named(r)[1] for r in points(wanted, lambda some, ids, x: [(0.0, at) for at in np.flatnonzero(is_in(ids, list(some)))])}
        known = {(s, m[0]): m[1] for s in active for m in medoids[s]} | values
        for s in active:
            medoids[s] = [(i, known[s, i]) for i in (moved.get((s, c), m[0]) for c, m in enumerate(medoids[s]))]
    if blocks.is_cached:
        blocks.unpersist()
    return {sign: [m[0] for m in of] for sign, of in medoids.items()}


def patterns(x: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Which values are there, as bytes, each once, and the place of every row's among them."""
    keys, places = np.unique(np.packbits(~np.isnan(x), axis=1), axis=0, return_inverse=True)
    return [key.tobytes().rstrip(b"\0") for key in keys], places.ravel()


def pattern_buckets(blocks: DataFrame, signs: set, sign_kind: T.DataType, k: int, most: int = 4096) -> dict:
    """How many parts the sums of a sign's clusters are dealt to, so that one has about ``most``."""
    seen = T.StructType([T.StructField("sign", sign_kind), T.StructField("seen", T.BinaryType())])
    wanted = blocks.sparkSession.sparkContext.broadcast(signs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = to_arrow_schema(seen)
        for batch in batches:
            for i in range(batch.num_rows):
                for sign, _, x in signs_of(batch, i, wanted.value):
                    keys = patterns(x)[0]
                    yield pa.RecordBatch.from_arrays([pa.array([sign] * len(keys), kind[0].type), pa.array(keys, kind[1].type)], schema=kind)

    found = blocks.mapInArrow(run, seen).distinct().groupBy("sign").count().collect()
    return {r["sign"]: -(-r["count"] * k // most) for r in found}


def least_sums(blocks: DataFrame, state: dict, sign_kind: T.DataType, clip_kind: T.DataType) -> dict:
    """(sign, cluster) -> the clip with the least sum of distances to those of its cluster, the first on a tie; a clip's cluster is that of its nearest medoid.

    Over clips that miss the same values, squared differences to a clip sum up to their number times spread plus squared
    distance from their mean. So every clip meets these sums, not the other clips, and copies have the very same total.
    """
    shared = blocks.sparkSession.sparkContext.broadcast(state)
    numbers = T.ArrayType(T.DoubleType())
    group = T.StructType([T.StructField("sign", sign_kind), T.StructField("bucket", T.IntegerType()), T.StructField("cluster", T.IntegerType()), T.StructField("seen", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("s", numbers), T.StructField("q", numbers)])
    of_bucket = T.StructType([T.StructField("b_sign", sign_kind), T.StructField("bucket", T.IntegerType()), T.StructField("cluster", T.ArrayType(T.IntegerType())), T.StructField("n", T.ArrayType(T.LongType())), T.StructField("mean", T.ArrayType(numbers)), T.StructField("spread", T.ArrayType(numbers))])
    part = T.StructType([T.StructField("sign", sign_kind), T.StructField("bucket", T.IntegerType()), T.StructField("cluster", T.IntegerType()), T.StructField("clip", clip_kind), T.StructField("part", T.DoubleType())])

    def clusters(batch: pa.RecordBatch, i: int, wanted: dict) -> Iterator[tuple]:
        """(sign, cluster, clips, differences from the medoid) of a block."""
        for sign, ids, x in signs_of(batch, i, wanted):
            medoids = wanted[sign][0]
            near = to_medoids(ids, x, medoids).argmin(axis=1)
            for c in np.unique(near).tolist():
                rows, middle = widened(x[near == c], np.array(medoids[c][1])[None])
                yield sign, c, ids.take(pa.array(np.flatnonzero(near == c))), rows - np.nan_to_num(middle)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = to_arrow_schema(group)
        for batch in batches:
            for i in range(batch.num_rows):
                for sign, c, _, d in clusters(batch, i, shared.value):
                    keys, places = patterns(d)
                    order = np.argsort(places, kind="stable")
                    n = np.bincount(places, minlength=len(keys))
                    d = np.nan_to_num(d)[order]
                    s, q = (np.add.reduceat(v, np.cumsum(n) - n, axis=0) for v in (d, d * d))
                    bucket = [zlib.crc32(key) % shared.value[sign][1] for key in keys]
                    yield pa.RecordBatch.from_arrays([pa.array([sign] * len(keys), kind[0].type), pa.array(bucket, pa.int32()), pa.array([c] * len(keys), pa.int32()), pa.array(keys, kind[3].type), pa.array(n), *(pa.array(list(v), kind[5].type) for v in (s, q))], schema=kind)

    def combined(table: pa.Table) -> pa.Table:
        kind = to_arrow_schema(of_bucket)
        keys = list(zip(table.column("cluster").to_pylist(), table.column("seen").to_pylist(), strict=True))
        place = {key: i for i, key in enumerate(sorted(set(keys)))}
        (s, _), (q, _) = flat_values(table.column("s")), flat_values(table.column("q"))
        n, mean, spread = np.zeros(len(place)), np.zeros((len(place), s.shape[1])), np.zeros((len(place), s.shape[1]))
        at = np.array([place[key] for key in keys])
        for total, v in ((n, table.column("n").to_numpy()), (mean, s), (spread, q)):
            np.add.at(total, at, v)
        mean /= n[:, None]
        spread = np.maximum(spread / n[:, None] - mean * mean, 0.0)
        for i, (_, seen) in enumerate(place):
            there = np.unpackbits(np.frombuffer(seen, dtype=np.uint8), count=s.shape[1])
            mean[i, there == 0] = np.nan
        row = [table.column("sign").slice(0, 1).combine_chunks(), table.column("bucket").slice(0, 1).combine_chunks(), pa.array([[c for c, _ in place]], kind[2].type), pa.array([n.astype(np.int64).tolist()], kind[3].type)]
        nested = [pa.array([list(v)], kind[4].type) for v in (mean, spread)]
        return pa.Table.from_arrays([*row, *nested], schema=kind)

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = to_arrow_schema(part)
        for batch in batches:
            for i in range(batch.num_rows):
                name, bucket = batch.column("b_sign")[i].as_py(), batch.column("bucket")[i].as_py()
                of, n = (batch.column(c).slice(i, 1).flatten().to_numpy() for c in ("cluster", "n"))
                (mean, there), (spread, _) = (flat_values(batch.column(c).slice(i, 1).flatten()) for c in ("mean", "spread"))
                mean[~there] = np.nan
                for sign, c, ids, d in clusters(batch, i, {name: shared.value[name]}):
                    total, bare = np.zeros(len(d)), np.isnan(d).all(axis=1)
                    for g in np.flatnonzero(of == c):
                        rows, middle, more = widened(d, mean[g][None], spread[g][None])
                        squares = (rows - middle) ** 2 + np.nan_to_num(more)
                        there = ~np.isnan(squares)
                        count = there.sum(axis=1)
                        apart = np.where(count > 0, np.where(there, squares, 0.0).sum(axis=1) / np.maximum(count, 1), np.inf) * n[g]
                        # a clip without values is its own nearest
                        total += np.where(bare & (n[g] == 1) & np.isnan(mean[g]).all(), 0.0, apart)
                    size = len(total)
                    yield pa.RecordBatch.from_arrays([pa.array([sign] * size, kind[0].type), pa.array([bucket] * size, pa.int32()), pa.array([c] * size, pa.int32()), ids, pa.array(total)], schema=kind)

    per = blocks.mapInArrow(sums, group).groupBy("sign", "bucket").applyInArrow(combined, of_bucket).coalesce(max(1, -(-sum(b for _, b in state.values()) // 8)))
    met = blocks.hint("shuffle_replicate_nl").join(per, (F.col("a_first") <= F.col("b_sign")) & (F.col("b_sign") <= F.col("a_last")))
    of = F.aggregate(F.array_sort(F.collect_list(F.struct("bucket", "part"))), F.lit(0.0), lambda s, v: s + v["part"])
    summed = met.mapInArrow(totals, part).groupBy("sign", "cluster", "clip").agg(of.alias("total"))
    best = summed.groupBy("sign", "cluster").agg(F.min_by("clip", F.struct("total", "clip")).alias("clip"))
    return {(r["sign"], r["cluster"]): r["clip"] for r in best.collect()}
