"""Packing documents into fixed windows: non-negative least squares on the length histogram.

A document (its ids and an end id) longer than the window is cut into full
windows and a rest. Full windows are sequences of their own. For the rests, all
pairs and triples of lengths that fill a window are enumerated; the repeats of
each are the non-negative least-squares fit to the histogram of rest lengths,
by an active set that stays small, so repeats are large and round well. The fit
is repeated on what rounding leaves. What no combination fits is packed greedily,
still on the histogram: the longest length takes the longest that fit beside it,
as many times over as all of them last. The plan is a table of patterns (lengths
and repeats) whose size depends on the window alone, never on the corpus.

Every piece then finds its place by arithmetic: the k-th piece of a length goes
to the slot of that length which covers k. Ranks within a length are split like
any prefix sum, since one length may hold a third of all pieces: pieces are
dealt into slices by a hash, ranked inside the slice and shifted by the sizes of
the slices before it.

Defined results: a null or empty text is its end id alone; repeated rows are
packed each; null ids are packed like others; an empty table gives an empty
result. Sequences are padded to the window unless their length is a power of
two.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lernspur.llm import tokens
from lernspur.llm.common import materialize


@dataclass(frozen=True)
class PackConfig:
    window: int = 1024
    end_id: int = 0
    tokenizer: str | None = None
    #: most conjugate-gradient steps of a least-squares solution, and combinations that join the fit at a time
    steps: int = 300
    block: int = 64
    #: tokens that a combination may leave open in the last fits
    slack: int = 16
    #: how much more a token of a long piece counts in the fit: long ones are the hardest to place later
    lean: float = 0.5
    pieces_per_slice: int = 500


def tokenized_pieces(docs: DataFrame, config: PackConfig = PackConfig()) -> DataFrame:
    """doc_id, start, length, ids_crc32 and doc_tokens of every piece, in cuts at multiples of the window."""
    path, window, end = config.tokenizer or tokens.default_tokenizer(), config.window, config.end_id

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(path).encode
        for batch in batches:
            texts = batch.column("text")
            for a, b in tokens.text_groups(texts):
                ids = encode(texts.slice(a, b - a), end)
                rows = np.repeat(np.arange(b - a), [-(-len(x) // window) for x in ids])
                starts = np.concatenate([np.arange(0, len(x), window) for x in ids])
                totals = np.array([len(x) for x in ids])[rows]
                crcs = [zlib.crc32(x[s : s + window].tobytes()) for x in ids for s in range(0, len(x), window)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a).take(pa.array(rows)), pa.array(starts), pa.array(np.minimum(window, totals - starts)), pa.array(crcs, pa.int64()), pa.array(totals)],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(cut, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def filling_combinations(window: int) -> np.ndarray:
    """All pairs and triples of lengths below the window that fill it, as rows of three lengths (0: no third)."""
    x = np.arange(1, window // 2 + 1)
    pairs = np.stack([np.zeros_like(x), x, window - x], axis=1)
    a, b = np.meshgrid(np.arange(1, window // 3 + 1), np.arange(1, window // 2 + 1), indexing="ij")
    c = window - a - b
    kept = (a <= b) & (b <= c)
    return np.concatenate([pairs, np.stack([a[kept], b[kept], c[kept]], axis=1)])


def _available(combos: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The combinations that can be laid at least once with the lengths that are left."""
    a, b, c = combos.T
    times = 1 + ((combos == b[:, None]).sum(axis=1) - 1)
    here = (left[a] > 0) | (a == 0)
    return combos[here & (left[c] > 0) & (left[b] >= times) & (left[c] >= (combos == c[:, None]).sum(axis=1))]


def fit_repeats(histogram: np.ndarray, combos: np.ndarray, config: PackConfig) -> np.ndarray:
    """Repeats x >= 0 that minimise |A x - histogram|^2, A counting each length in each combination.

    An active set of combinations grows by those that promise most, as many at a time as share no length, and loses
    those that the least-squares solution makes negative: few combinations with high repeats come out, which round well.
    """
    size = len(histogram)
    target = histogram.astype(np.float64).copy()
    target[0] = 0.0
    weight = (np.arange(size) / (size - 1)) ** config.lean

    def used(which: np.ndarray, x: np.ndarray) -> np.ndarray:
        out = np.bincount(combos[which].ravel(), np.repeat(x, 3), size)
        out[0] = 0.0
        return out

    def solve(which: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Least squares over the chosen combinations, by conjugate gradients from ``x``."""
        rows = combos[which]
        gap = target - used(which, x)
        g = (weight * gap)[rows].sum(axis=1)
        d, gg = g, g @ g
        for _ in range(config.steps):
            if gg < 1e-6:
                break
            q = used(which, d)
            step = gg / max(q @ (weight * q), 1e-300)
            x, gap = x + step * d, gap - step * q
            g = (weight * gap)[rows].sum(axis=1)
            after = g @ g
            d, gg = g + after / gg * d, after
        return x

    which, x = np.zeros(0, dtype=np.int64), np.zeros(0)
    best, width = float(weight @ target**2), config.block
    while width:
        gap = target - used(which, x)
        gain = (weight * gap)[combos].sum(axis=1)
        gain[which] = 0.0
        likely = np.argsort(-gain, kind="stable")[: 16 * width]
        taken, new = np.zeros(size, dtype=bool), []
        for i in likely[gain[likely] > 0.05]:
            own = combos[i][combos[i] > 0]
            if not taken[own].any():
                taken[own] = True
                new.append(i)
                if len(new) == width:
                    break
        if not new:
            break
        more, y = np.concatenate([which, new]), np.concatenate([x, np.zeros(len(new))])
        while True:
            y = solve(more, y)
            good = y > 1e-9
            if good.all():
                break
            more, y = more[good], y[good]
        rest = target - used(more, y)
        if weight @ rest**2 < best * (1 - 1e-4):
            best, which, x = float(weight @ rest**2), more, y
        else:
            width //= 4
    out = np.zeros(len(combos))
    out[which] = x
    return out


def _fitted(left: np.ndarray, config: PackConfig) -> list[tuple[tuple[int, ...], int]]:
    """Patterns by repeated fits, until no combination can be laid any more; takes their lengths from ``left``."""
    window, plan = config.window, []
    for slack in (0, config.slack):
        every = [filling_combinations(total) for total in range(window, max(1, window - slack) - 1, -1)]
        while left.any():
            combos = np.concatenate([_available(c, left) for c in every])
            if not len(combos):
                break
            repeats = fit_repeats(left, combos, config)
            if not repeats.any():
                break
            order = np.argsort(-repeats, kind="stable")
            # whole repeats, and where there are none the larger half of the fractions
            floor = 0.5 if repeats[order[0]] >= 0.5 else repeats[order[0]] / 2
            for i in order[repeats[order] >= floor]:
                lengths = tuple(int(n) for n in combos[i][::-1] if n)
                n = int(min(max(1, int(repeats[i] + 0.5)), *(left[m] // lengths.count(m) for m in set(lengths))))
                if n > 0:
                    plan.append((lengths, n))
                    for m in lengths:
                        left[m] -= n
    return plan


def _greedy(left: np.ndarray, window: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of the longest length and the longest that fit beside it, as many times over as all of them last."""
    left, plan = left.copy(), []
    while left.any():
        present = np.flatnonzero(left)
        room, lengths, after = window, [], left.copy()
        while len(present) and room >= present[0]:
            m = int(present[np.searchsorted(present, room, side="right") - 1])
            lengths.append(m)
            after[m] -= 1
            room -= m
            if not after[m]:
                present = present[present != m]
        n = int(min(left[m] // lengths.count(m) for m in set(lengths)))
        plan.append((tuple(lengths), n))
        for m in lengths:
            left[m] -= n
    return plan


def plan_patterns(histogram: np.ndarray, config: PackConfig = PackConfig()) -> tuple[list[tuple[tuple[int, ...], int]], int]:
    """(lengths, repeats) patterns that together use every length exactly as often as ``histogram[length]`` says.

    First the full windows and the fitted patterns, whose number is returned as well, then the greedy ones. The fit is
    repeated on what rounding leaves, at first with combinations that fill the window, then with those that fill it but
    for a few tokens. Of the patterns fitted last, as many are given back to the greedy part as make the fewest sequences.
    """
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    full = [((config.window,), int(left[config.window]))] if left[config.window] else []
    left[config.window] = 0
    fitted = _fitted(left, config)
    best: tuple[int, list, list] | None = None
    for share in (0.0, 0.02, 0.05, 0.1, 0.2):
        keep = len(fitted) - int(share * len(fitted))
        again = left.copy()
        for lengths, n in fitted[keep:]:
            np.add.at(again, list(lengths), n)
        rest = _greedy(again, config.window)
        sequences = sum(n for _, n in fitted[:keep]) + sum(n for _, n in rest)
        if best is None or sequences < best[0]:
            best = sequences, fitted[:keep], rest
    _, kept, rest = best
    return [*full, *kept, *rest], len(full) + len(kept)


def slots(plan: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: the first rank, the first sequence and the offset of its slots, by rank."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for lengths, n in plan:
        offset = 0
        for m in lengths:
            out.setdefault(m, []).append((taken.get(m, 0), sequence, offset))
            taken[m] = taken.get(m, 0) + n
            offset += m
        sequence += n
    return {m: tuple(np.array(x, dtype=np.int64) for x in zip(*rows, strict=True)) for m, rows in out.items()}


def pack(docs: DataFrame, config: PackConfig = PackConfig()) -> DataFrame:
    """Every piece with its sequence_id, its offset there, the padded length of that sequence, and whether it is a full window or a fitted pattern."""
    pieces = materialize(tokenized_pieces(docs, config), "pieces")
    counted = pieces.groupBy("length").agg(F.count("*").alias("n"))
    histogram = np.zeros(config.window + 1, dtype=np.int64)
    for length, n in counted.collect():  # at most ``window`` rows
        histogram[length] = n
    plan, fitted = plan_patterns(histogram, config)
    placed = pieces.sparkSession.sparkContext.broadcast(slots(plan))
    used = [sum(lengths) for lengths, _ in plan]
    firsts = np.concatenate([[0], np.cumsum([n for _, n in plan])]).astype(np.int64)
    sizes = pieces.sparkSession.sparkContext.broadcast((firsts, np.array([u if u & (u - 1) == 0 else config.window for u in used] or [0], dtype=np.int64)))

    # ranks within a length: hash slices, ranked apart and then shifted
    many = counted.select("length", F.ceil(F.col("n") / config.pieces_per_slice).cast("int").alias("slices"))
    keyed = pieces.join(many, "length").withColumn("slice", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.col("slices")).cast("int"))
    shift = keyed.groupBy("length", "slice").agg(F.count("*").alias("here"))
    earlier = W.partitionBy("length").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    shift = shift.select("length", "slice", F.coalesce(F.sum("here").over(earlier), F.lit(0)).alias("shift"))
    inside = W.partitionBy("length", "slice").orderBy(F.col("doc_id").asc_nulls_first(), "start", "ids_crc32")
    ranked = keyed.withColumn("rank", F.row_number().over(inside) - 1).join(shift, ["length", "slice"])
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    ranked = ranked.select(*columns, (F.col("rank") + F.col("shift")).cast("long").alias("rank"))
    schema = ranked.select(*columns).schema.add("sequence_id", "long").add("offset", "long").add("padded", "long").add("fitted", "boolean")
    last_fitted = int(firsts[fitted])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, (begins, padded) = placed.value, sizes.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for m in np.unique(length):
                own = np.flatnonzero(length == m)
                first, base, off = at[int(m)]
                slot = np.searchsorted(first, rank[own], side="right") - 1
                sequence[own], offset[own] = base[slot] + rank[own] - first[slot], off[slot]
            size = padded[np.searchsorted(begins, sequence, side="right") - 1]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(sequence), pa.array(offset), pa.array(size), pa.array(sequence < last_fitted)], names=schema.fieldNames())

    return ranked.mapInArrow(place, schema)
