"""Near-duplicate classes by DartMinHash signatures and banded joining.

A text is a weighted set: its five-word shingles, each weighing 1 + ln(count).
DartMinHash throws darts at the region of each element, an area of weight x
rank. The number of darts in a cell of that area, and the place, rank and
coordinate of each dart, are hashes of the element and the cell, so texts that
share an element share its darts. A dart counts if its place lies below the
element's weight; each of the signature's coordinates keeps the dart of least
rank. Two signatures agree at a coordinate with the probability of their
weighted Jaccard similarity. Rank cells double in width and each text looks at
as many as its weight calls for, so the work is about one dart an element plus
k log k a text.

Links go by plain Jaccard similarity, which repeats inside a text do not change
but weights do: a text written twice is nearly the same set with other weights.
So a text that repeats shingles is signed a second time with all weights 1, and
stands in the bands of both signatures. Without repeats the two are the same.

Equal texts collapse first. Signatures are cut into bands; texts that share a
band are candidates, and a link is kept when the plain Jaccard similarity of
their shingle sets is at least the threshold, computed exactly. Classes are the
connected components of the links.

A band that very many texts share is not expanded into pairs. Its members are
compared with one leader each, which is linear; once components are known, a
band needs more work only where it still holds members of several components.
There every member outside the band's largest component is compared with all
members it may still be linked to. Two exact bounds rule the others out: by the
triangle inequality of the Jaccard distance, distances to the leader may differ
by no more than the allowed distance; and a pair's common shingles are either
the leader's too or others that some second text has, so their number is bounded
by what each of the two has of either kind. No link between components is lost,
and links inside a component cannot change the classes.

Defined results: a null text equals an empty one; texts without words form one
class; texts of one to four words have one shingle, the whole text; class_id
is the least doc_id of the class, null ids last; an empty table gives an empty
result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lernspur.llm.common import WORD, materialize, words


@dataclass(frozen=True)
class NearDupConfig:
    shingle: int = 5
    threshold: float = 0.8
    bands: int = 25
    rows: int = 5
    seed: int = 42
    #: pairs with one text that are compared in one place
    pairs_per_slice: int = 1000

    @property
    def size(self) -> int:
        return self.bands * self.rows


#: Rank cells: bounds double from 1/16 to 256 and then go on by 256, so that no cell holds many darts of one element.
RANKS = np.array([0.0, *(2.0**i for i in range(-4, 9)), *(256.0 * i for i in range(2, 64))])


def mix64(x: np.ndarray) -> np.ndarray:
    """A well-known 64-bit finaliser (splitmix), elementwise."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def _poisson_steps(area: float) -> np.ndarray:
    """Cumulative Poisson probabilities up to 1 - 1e-15."""
    p, total, out = math.exp(-area), 0.0, []
    for n in range(1000):
        total += p
        out.append(total)
        if 1 - total < 1e-15 and n > area:
            break
        p *= area / (n + 1)
    return np.array(out)


def shingle_sets(hashes: np.ndarray, bounds: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles and the number of the text each belongs to."""
    counts = np.diff(bounds)
    docs = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(len(hashes)) - np.repeat(bounds[:-1], counts)
    rolling = np.zeros(len(hashes), dtype=np.uint64)
    for j in range(shingle):
        nxt = np.zeros_like(rolling)
        nxt[: max(0, len(hashes) - j)] = hashes[j:]
        inside = at + j < np.repeat(counts, counts)
        rolling = np.where(inside, mix64(rolling * np.uint64(0x9E3779B97F4A7C15) + nxt), rolling)
    lengths = np.repeat(counts, counts)
    used = (at == 0) | (at + shingle <= lengths)
    return rolling[used], docs[used]


def dart_signatures(elements: np.ndarray, weights: np.ndarray, docs: np.ndarray, n_docs: int, config: NearDupConfig) -> np.ndarray:
    """(n_docs, k) uint64 signatures of weighted sets given as parallel arrays sorted by ``docs``; 0 rows where a set is empty."""
    k = config.size
    best_rank = np.full(n_docs * k, np.inf)
    best_dart = np.zeros(n_docs * k, dtype=np.uint64)
    total = np.bincount(docs, weights, n_docs)
    filled = total <= 0
    # a text needs about k ln k + 2k darts: its rank cells up to that many come before it is looked at
    enough = np.searchsorted(RANKS[1:], (k * math.log(k) + 2 * k) / np.where(total > 0, total, 1.0))
    for rank, (low, high) in enumerate(zip(RANKS[:-1], RANKS[1:], strict=True)):
        open_docs = ~filled
        if not open_docs.any():
            break
        live = open_docs[docs]
        e, w, d = elements[live], weights[live], docs[live]
        level = 0
        while len(e):
            base = mix64(e + np.uint64((config.seed * 0x632BE59BD9B4E019 + (rank + 1) * 0xD6E8FEB86659FD93 + level * 0xA0761D6478BD642F) & (2**64 - 1)))
            n = np.searchsorted(_poisson_steps(high - low), _unit(base))
            hit = np.flatnonzero(n)
            times = n[hit]
            src = np.repeat(hit, times)
            within = np.arange(len(src)) - np.repeat(np.cumsum(times) - times, times)
            dart = mix64(base[src] + (within + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            place = level + _unit(mix64(dart ^ np.uint64(0x5851F42D4C957F2D)))
            held = place < w[src]
            dart, src = dart[held], src[held]
            place_rank = low + (high - low) * _unit(mix64(dart ^ np.uint64(0x14057B7EF767814F)))
            slot = d[src] * k + (mix64(dart ^ np.uint64(0x2545F4914F6CDD1D)) % np.uint64(k)).astype(np.int64)
            order = np.lexsort((place_rank, slot))
            slot, place_rank, dart = slot[order], place_rank[order], dart[order]
            first = np.concatenate([[True], slot[1:] != slot[:-1]]) if len(slot) else np.zeros(0, bool)
            slot, place_rank, dart = slot[first], place_rank[first], dart[first]
            better = place_rank < best_rank[slot]
            best_rank[slot[better]], best_dart[slot[better]] = place_rank[better], dart[better]
            level += 1
            more = w > level
            e, w, d = e[more], w[more], d[more]
        tried = (rank >= enough) & open_docs
        if tried.any():
            full = np.isfinite(best_rank.reshape(n_docs, k)[tried]).all(axis=1)
            filled[np.flatnonzero(tried)[full]] = True
    return best_dart.reshape(n_docs, k)


def _weighted_sets(batch: pa.RecordBatch, config: NearDupConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    hashes = batch.column("h")
    bounds = np.asarray(hashes.offsets).astype(np.int64)
    flat = np.asarray(hashes.values)[bounds[0] : bounds[-1]].view(np.uint64)
    shingles, docs = shingle_sets(flat, bounds - bounds[0], config.shingle)
    order = np.lexsort((shingles, docs))
    shingles, docs = shingles[order], docs[order]
    first = np.flatnonzero(np.concatenate([[True], (shingles[1:] != shingles[:-1]) | (docs[1:] != docs[:-1])])) if len(docs) else np.zeros(0, np.int64)
    counts = np.diff(np.append(first, len(docs)))
    return shingles[first], docs[first], 1.0 + np.log(np.maximum(counts, 1))


def _parts(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` words each."""
    ends = np.asarray(batch.column("h").offsets).astype(np.int64)
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def signed_texts(docs: DataFrame, config: NearDupConfig = NearDupConfig()) -> DataFrame:
    """node and its band hashes, signed where the texts are read; texts without words have no bands.

    Texts that repeat shingles have the bands of unit weights after those of their weights, null where both are equal.
    """

    def band_hashes(signature: np.ndarray) -> np.ndarray:
        cut = signature.reshape(-1, config.bands, config.rows)
        band = np.zeros(cut.shape[:2], dtype=np.uint64)
        for j in range(config.rows):
            band = mix64(band * np.uint64(0x9E3779B97F4A7C15) + cut[:, :, j])
        return band

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _parts(whole, 500_000):
                elements, owner, weights = _weighted_sets(batch, config)
                n = batch.num_rows
                band = band_hashes(dart_signatures(elements, weights, owner, n, config))
                some, twice = np.bincount(owner, minlength=n) > 0, np.bincount(owner, weights > 1, n) > 0
                again = twice[owner]
                unit = np.zeros_like(band)
                place = np.cumsum(twice) - 1
                unit[twice] = band_hashes(dart_signatures(elements[again], np.ones(int(again.sum())), place[owner[again]], int(twice.sum()), config))
                both = np.concatenate([band, unit], axis=1)
                held = np.repeat(np.stack([some, twice], axis=1), config.bands, axis=1)
                null = np.concatenate([np.zeros_like(band, bool), unit == band], axis=1)
                ends = np.concatenate([[0], np.cumsum(held.sum(axis=1))]).astype(np.int32)
                bands = pa.ListArray.from_arrays(pa.array(ends), pa.array(both[held].view(np.int64), mask=null[held]))
                yield pa.RecordBatch.from_arrays([batch.column("node"), bands], names=["node", "bands"])

    return docs.select("node", F.transform(words(F.col("text")), lambda x: F.xxhash64(x)).alias("h")).mapInArrow(sign, "node binary, bands array<bigint>")


def _sets(column: pa.ListArray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each row's word hashes, with the row of each."""
    bounds = np.asarray(column.offsets).astype(np.int64)
    flat = np.asarray(column.values)[bounds[0] : bounds[-1]].astype(np.int64).view(np.uint64)
    elements, owner = shingle_sets(flat, bounds - bounds[0], shingle)
    order = np.lexsort((elements, owner))
    elements, owner = elements[order], owner[order]
    new = np.ones(len(owner), bool)
    new[1:] = (elements[1:] != elements[:-1]) | (owner[1:] != owner[:-1])
    return elements[new], owner[new]


def big(df: DataFrame) -> DataFrame:
    """A join side that grows with the corpus: joined by sorting, never broadcast."""
    return df.hint("merge")


def word_hashes(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """node and the hashes of its words, in order, for each of ``nodes``; ``texts`` may repeat nodes."""
    wanted = texts.join(big(nodes.distinct()), "node", "left_semi").groupBy("node").agg(F.first("text").alias("text"))
    return materialize(wanted.select("node", F.transform(words(F.col("text")), lambda x: F.hash(x)).alias("w")), "words")


def verify(pairs: DataFrame, hashed: DataFrame, config: NearDupConfig) -> DataFrame:
    """Adds the exact Jaccard distance of the shingle sets of each pair (a, b); ``n`` is about how many pairs have the same a."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                (ea, oa), (eb, ob) = _sets(batch.column("wa"), config.shingle), _sets(batch.column("wb"), config.shingle)
                e, o = np.concatenate([ea, eb]), np.concatenate([oa, ob])
                order = np.lexsort((e, o))
                e, o = e[order], o[order]
                shared = np.bincount(o[1:][(e[1:] == e[:-1]) & (o[1:] == o[:-1])], minlength=batch.num_rows)
                union = np.bincount(o, minlength=batch.num_rows) - shared
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(1.0 - shared / np.maximum(union, 1))], names=["a", "b", "distance"])

    # a text that very many meet is sent once to each slice of them, and theirs once each
    slices = F.greatest(F.lit(1), F.ceil(F.col("n") / config.pairs_per_slice)).cast("int")
    met = pairs.groupBy("a").agg(F.max("n").alias("n"))
    left = hashed.join(big(met), hashed["node"] == met["a"]).select("a", F.col("w").alias("wa"), F.explode(F.sequence(F.lit(0), slices - 1)).alias("slice"))
    right = hashed.select(F.col("node").alias("b"), F.col("w").alias("wb"))
    dealt = pairs.select("a", "b", F.pmod(F.xxhash64("b"), slices).cast("int").alias("slice"))
    return dealt.join(big(right), "b").join(big(left), ["a", "slice"]).select("a", "b", "wa", "wb").mapInArrow(measure, "a binary, b binary, distance double")


def shared_shingles(hashed: DataFrame, nodes: DataFrame, config: NearDupConfig) -> DataFrame:
    """node, n (its distinct shingles) and shared (those that another of ``nodes`` has too)."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                elements, owner = _sets(batch.column("w"), config.shingle)
                yield pa.RecordBatch.from_arrays([batch.column("node").take(pa.array(owner)), pa.array(elements.view(np.int64))], names=["node", "shingle"])

    each = hashed.join(nodes, "node", "left_semi").mapInArrow(spread, "node binary, shingle bigint")
    owned = each.groupBy("shingle").agg(F.min("node").alias("node"), F.count("*").alias("owners")).where("owners = 1").groupBy("node").agg(F.count("*").alias("alone"))
    totals = each.groupBy("node").agg(F.count("*").alias("n"))
    return totals.join(owned, "node", "left").select("node", "n", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("shared"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b): root is the least node of its component."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = materialize(both, "edges")
    labels = materialize(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).withColumnRenamed("a", "node"), "labels")
    while True:
        # every node offers its root to its neighbours, and to the root it had before
        offered = both.join(labels, both["a"] == labels["node"]).select(F.col("b").alias("node"), "root")
        best = offered.union(labels).groupBy("node").agg(F.min("root").alias("best"))
        hooked = best.join(labels, "node")
        onto = hooked.select(F.col("root").alias("node"), "best").union(hooked.select("node", "best"))
        lower = onto.groupBy("node").agg(F.min("best").alias("root"))
        jump = lower.select(F.col("node").alias("root"), F.col("root").alias("up"))
        after = lower.join(jump, "root", "left").select("node", F.least("root", F.coalesce("up", "root")).alias("root"))
        after = materialize(after, "labels")
        changed = after.join(labels.withColumnRenamed("root", "was"), "node").where("root <> was").limit(1).count()
        labels = after
        if not changed:
            return labels


def near_duplicate_classes(docs: DataFrame, config: NearDupConfig = NearDupConfig()) -> DataFrame:
    """(node, root) of the texts that are linked to other texts; ``docs`` has node and text, repeats allowed."""
    place = ["band", "key"]
    signed = materialize(signed_texts(docs, config).dropDuplicates(["node"]), "signed")
    banded = signed.select("node", F.posexplode("bands").alias(*place)).where("key IS NOT NULL").withColumn("band", F.col("band") % config.bands)
    counts = banded.groupBy(*place).agg(F.count("*").alias("n")).where("n > 1")
    seats = materialize(banded.join(big(counts), place), "seats")
    # the member that meets the most others leads: the text that copies were made from, where it is there
    known = seats.groupBy("node").agg(F.sum("n").alias("met"))
    leaders = seats.join(big(known), "node").groupBy(*place).agg(F.max(F.struct("met", "node"))["node"].alias("leader"))
    seats = materialize(seats.select(*place, "node", "n").join(big(leaders), place), "seats")
    hashed = word_hashes(docs, seats.select("node"))
    stars = materialize(seats.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b"), "n").groupBy("a", "b").agg(F.max("n").alias("n")), "candidates")
    stars = materialize(verify(stars, hashed, config), "stars")
    allowed = 1.0 - config.threshold + 1e-12
    edges = stars.where(F.col("distance") <= allowed).select("a", "b")
    roots = components(edges)

    # bands that still hold several components
    rooted = seats.join(big(roots), "node", "left").withColumn("root", F.coalesce("root", "node"))
    parts = rooted.groupBy(*place, "root").agg(F.count("*").alias("n"))
    mixed = parts.groupBy(*place).agg(F.max(F.struct("n", "root"))["root"].alias("main"), F.count("*").alias("parts")).where("parts > 1")
    afar = stars.select(F.col("a").alias("leader"), F.col("b").alias("node"), "distance")
    open_seats = rooted.join(mixed, place).join(afar, ["leader", "node"], "left")
    open_seats = open_seats.select(*place, "main", "leader", "node", "root", F.when(F.col("node") == F.col("leader"), 0.0).otherwise(F.col("distance")).alias("d"))
    open_seats = materialize(open_seats, "open")
    # a pair shares at most the lesser number of shingles that each has in common with the leader, and at most the lesser
    # number that each shares with some text but not with the leader; with t the threshold it must share t / (1 + t) of both
    sizes = materialize(shared_shingles(hashed, open_seats.select("node").distinct(), config), "sizes")
    able = open_seats.join(sizes.where(F.col("shared") >= F.col("n") * (config.threshold - 1e-9)), "node")
    able = able.join(sizes.select(F.col("node").alias("leader"), F.col("n").alias("n_leader")), "leader")
    able = able.withColumn("common", F.round((1 - F.col("d")) * (F.col("n") + F.col("n_leader")) / (2 - F.col("d"))).cast("long"))
    able = able.withColumn("other", F.col("shared") - F.col("common")).withColumn("seat", F.xxhash64(*place))
    # a pair that meets in several bands is made in the first of them alone
    own = able.groupBy("node").agg(F.collect_set("seat").alias("own"))
    able = materialize(able.join(own, "node"), "able")
    fields = ["node", "root", "d", "n", "common", "other", "own"]
    outer = able.where("root <> main AND d > 0").select(*place, "seat", *[F.col(c).alias(f"{c}_a") for c in fields])
    inner = able.where("d > 0").select(*place, "main", *[F.col(c).alias(f"{c}_b") for c in fields])
    close = F.abs(F.col("d_a") - F.col("d_b")) <= allowed
    enough = (F.least("common_a", "common_b") + F.least("other_a", "other_b")) * (1 + config.threshold) >= (F.col("n_a") + F.col("n_b")) * (config.threshold - 1e-9)
    once = (F.col("root_b") == F.col("main")) | (F.col("node_a") < F.col("node_b"))
    first = F.array_min(F.array_intersect("own_a", "own_b")) == F.col("seat")
    pairs = outer.join(inner, place).where((F.col("root_a") != F.col("root_b")) & close & enough & once & first)
    pairs = pairs.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    pairs = materialize(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "candidates")
    if pairs.isEmpty():
        return roots
    met = pairs.groupBy("a").agg(F.count("*").alias("n"))
    late = materialize(verify(pairs.join(big(met), "a"), hashed, config), "late").where(F.col("distance") <= allowed).select("a", "b")
    if late.isEmpty():
        return roots
    return components(edges.union(late))


def node_of(text: Column) -> Column:
    """md5 of a text in 16 bytes; one empty node for all texts without words."""
    t = F.coalesce(text, F.lit(""))
    return F.unhex(F.when(t.rlike(WORD), F.md5(t.cast("binary"))).otherwise(F.lit("")))


def named_nodes(docs: DataFrame, config: NearDupConfig) -> DataFrame:
    """node, first_id (its least doc_id), root, class_id, class_docs and class_texts of every distinct text."""
    roots = near_duplicate_classes(docs.select(node_of(F.col("text")).alias("node"), F.coalesce("text", F.lit("")).alias("text")), config)
    ids = docs.select(node_of(F.col("text")).alias("node"), F.col("doc_id").alias("id"))
    counted = ids.groupBy("node").agg(F.min("id").alias("first_id"), F.count("*").alias("copies"))
    texts = materialize(counted.join(big(roots), "node", "left").withColumn("root", F.coalesce("root", "node")), "texts")
    classes = texts.groupBy("root").agg(F.min("first_id").alias("class_id"), F.sum("copies").alias("class_docs"), F.count("*").alias("class_texts"))
    return texts.join(big(classes), "root").select("node", "first_id", "root", "class_id", "class_docs", "class_texts")


def near_duplicates(docs: DataFrame, config: NearDupConfig = NearDupConfig(), with_text: bool = True) -> DataFrame:
    """``row`` (all input columns, or all but the text), node, class_id, class_docs and class_texts of every document."""
    named = named_nodes(docs, config).drop("first_id")
    row = F.struct("*") if with_text else F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    held = docs.select(row.alias("row"), node_of(F.col("text")).alias("node"))
    return held.join(big(named), "node").select("row", "node", "root", "class_id", "class_docs", "class_texts")


def keep_one(docs: DataFrame, config: NearDupConfig = NearDupConfig()) -> DataFrame:
    """One document of each class, the one of least id, with its own columns.

    The kept texts are known by node and id before any text moves. Of repeated rows one stays.
    """
    named = named_nodes(docs, config)
    best = named.where(F.col("first_id").eqNullSafe(F.col("class_id"))).groupBy("root").agg(F.min(F.struct("node", "class_id")).alias("b"))
    best = best.select("b.node", F.coalesce(F.col("b.class_id").cast("string"), F.lit("")).alias("id"))
    held = docs.select(F.struct("*").alias("row"), node_of(F.col("text")).alias("node"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"))
    return held.join(big(best), ["node", "id"], "left_semi").groupBy("node", "id").agg(F.first("row").alias("row")).select("row.*")
