"""A Merkle manifest of documents: a root over all of them and a proof for each.

Every document is a leaf, the digest of its fields. The leaves of a language
stand in the order of doc_id; eight neighbours at a time become the digest of
their digests, level by level, until one is left, the language's subroot; the
subroots, in the order of languages, become the root the same way.

A leaf's rank in its language, written in base 8, is its way through the tree.
Ranks are cut into blocks of ``8 ** levels`` leaves. Inside a block the digits
are grouped away one after the other, lowest first, each time nesting the eight
children in their parent; a block is one row at the end, and a transform over
the nested children with one explode emits the proofs of its leaves, without a
join. The heads of the blocks (one row for 512 leaves) are leaves of the same
job one storey higher, so no task ever holds more than a block; what they find
comes back to the blocks, whose number and language are a unique key.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lernspur.llm.common import materialize, shuffle_partitions

FANOUT_BITS = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


@dataclass(frozen=True)
class MerkleConfig:
    #: Levels of the tree inside one block.
    levels: int = 3
    #: Rows of one slice of the order.
    rows_per_slice: int = 50_000


def leaf_digest(*values: Column) -> Column:
    """SHA-256 of the values' decimal or text forms, each led by its UTF-8 byte count, or ``-`` for null."""

    def coded(v: Column) -> Column:
        text = v.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*[coded(v) for v in values]), 256)


def ranked(rows: DataFrame, group: list[str], order: list[str], config: MerkleConfig) -> DataFrame:
    """Adds ``rank`` (from 0) and ``n``, the size of the group. No group is ordered in one task, and equal rows are dealt out too.

    ``rows`` must be a written table, so that its row numbers stay the same.
    """
    by = [*group, *order, "__tie"]
    slices = max(shuffle_partitions(rows.sparkSession), rows.count() // config.rows_per_slice + 1)
    dealt = rows.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(slices, *by).withColumn("__slice", F.spark_partition_id())
    dealt = materialize(dealt, "merkle-order")
    sizes = dealt.groupBy(*group, "__slice").agg(F.count("*").alias("__m"))
    of = W.partitionBy(*group) if group else W.partitionBy(F.lit(0))
    shift = F.coalesce(F.sum("__m").over(of.orderBy("__slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    shifts = sizes.select(*[F.col(g).alias(f"__{g}") for g in group], F.col("__slice").alias("__s"), shift.alias("__shift"), F.sum("__m").over(of).alias("n"))
    here = F.row_number().over(W.partitionBy(*group, "__slice").orderBy(*order, "__tie"))
    same = F.col("__slice") == F.col("__s")
    for g in group:
        same &= F.col(g).eqNullSafe(F.col(f"__{g}"))
    placed = dealt.withColumn("__here", here).join(shifts, same)
    return placed.withColumn("rank", F.col("__here") - 1 + F.col("__shift")).drop("__tie", "__slice", "__here", "__s", "__shift", "__m", *[f"__{g}" for g in group])


def _blocks(nodes: DataFrame, group: list[str], levels: int) -> DataFrame:
    """(group, block, n, tree) from (group, rank, n, digest, item): the digits of the rank are grouped away in turn, the children nested in their parents."""
    digits = [F.shiftright("rank", FANOUT_BITS * i).bitwiseAND((1 << FANOUT_BITS) - 1).cast("int").alias(f"d{i}") for i in range(levels)]
    block = F.shiftright("rank", FANOUT_BITS * levels).alias("block")
    level = nodes.select(*group, block, "n", *digits, F.struct("digest", "item").alias("tree")).repartition(*group, "block")
    for i in range(levels):
        above = [f"d{j}" for j in range(i + 1, levels)]
        met = level.groupBy(*group, "block", "n", *above).agg(F.sort_array(F.collect_list(F.struct(f"d{i}", "tree"))).alias("met"))
        children = F.transform("met", lambda m: m["tree"])
        joined = F.sha2(F.array_join(F.transform("met", lambda m: m["tree"]["digest"]), ""), 256)
        digest = F.when(F.col("n") > (1 << FANOUT_BITS * i), joined).otherwise(F.get("met", 0)["tree"]["digest"])
        level = met.select(*group, "block", "n", *above, F.struct(digest.alias("digest"), children.alias("children")).alias("tree"))
    return level


def _step(children: Column, at: Column) -> Column:
    """The digests to the left and to the right of a child."""
    text = lambda some: F.array_join(F.transform(some, lambda c: c["digest"]), "")
    return F.struct(text(F.slice(children, 1, at)).alias("before"), text(F.slice(children, at + 2, F.lit(1 << FANOUT_BITS))).alias("after"))


def _leaves(levels: int) -> Column:
    """All (item, digest, path) of the nested ``tree``, where a path runs from the leaf upwards through the levels that the group has."""
    none = F.array().cast("array<struct<before:string,after:string>>")
    found = F.array(F.struct(F.col("tree").alias("node"), none.alias("path")))
    def opened(i: int) -> Callable[[Column], Column]:
        step = lambda kids, at: F.when(F.col("n") > (1 << FANOUT_BITS * i), F.array(_step(kids, at))).otherwise(none)
        return lambda x: F.transform(x["node"]["children"], lambda kid, at: F.struct(kid.alias("node"), F.concat(step(x["node"]["children"], at), x["path"]).alias("path")))

    for i in reversed(range(levels)):
        found = F.flatten(F.transform(found, opened(i)))
    return F.transform(found, lambda x: F.struct(x["node"]["item"].alias("item"), x["node"]["digest"].alias("digest"), x["path"].alias("path")))


def tree(nodes: DataFrame, group: list[str], config: MerkleConfig) -> tuple[DataFrame, DataFrame]:
    """Roots (group, top) and proofs (group, item, digest, path, top) of nodes (group, rank, n, digest, item)."""
    blocks = materialize(_blocks(nodes, group, config.levels), "merkle-blocks")
    size = 1 << FANOUT_BITS * config.levels
    heads = blocks.select(*group, F.col("block").alias("rank"), F.ceil(F.col("n") / size).cast("long").alias("n"), F.col("tree.digest").alias("digest"), F.col("block").alias("item"))
    most = heads.agg(F.max("n")).first()[0]
    if (most or 0) <= 1:
        tops = heads.select(*group, F.col("digest").alias("top"))
        own = blocks.withColumn("top", F.col("tree.digest")).withColumn("up", F.array().cast("array<struct<before:string,after:string>>"))
    else:
        tops, upper = tree(heads, group, config)
        found = upper.select(*[F.col(g).alias(f"__{g}") for g in group], F.col("item").alias("__block"), F.col("path").alias("up"), "top")
        same = F.col("block") == F.col("__block")
        for g in group:
            same &= F.col(g).eqNullSafe(F.col(f"__{g}"))
        own = blocks.join(found, same)
    each = own.select(*group, "top", "up", F.explode(_leaves(config.levels)).alias("leaf"))
    return tops, each.select(*group, "leaf.item", "leaf.digest", F.concat("leaf.path", "up").alias("path"), "top")


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf leads to along a path."""
    return F.aggregate(path, leaf, lambda h, s: F.sha2(F.concat(s["before"], h, s["after"]), 256))


def proof_digest(path: Column) -> Column:
    """SHA-256 of all siblings on a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def manifest(docs: DataFrame, carry: dict[str, Column] | None = None, config: MerkleConfig = MerkleConfig()) -> DataFrame:
    """doc_id, lang, the ``carry`` columns, leaf, subroot, root and path (array of before, after) of every document.

    Needs the columns doc_id, source, lang, n_chars and text; any may be null, and a null differs from an empty text.
    Null doc_ids come first; rows with one doc_id stand in the order of their leaves, equal rows are leaves of their
    own. A language of one document has its leaf as subroot, a manifest of one language its subroot as root and so no
    path beyond it. An empty table gives an empty manifest. Other columns, whatever their names, are not read. The
    whole text goes into the leaf and is read once; it never leaves the task that reads it. ``carry`` holds further
    columns computed there, of types that can be compared.
    """
    more = {"lang": F.col("lang"), "doc_id": F.col("doc_id"), **(carry or {})}
    own = docs.select("lang", "doc_id", leaf_digest(*[F.col(c) for c in FIELDS]).alias("digest"), F.struct(*[c.alias(name) for name, c in more.items()]).alias("item"))
    placed = ranked(materialize(own, "merkle-leaves"), ["lang"], ["doc_id", "digest"], config)
    subroots, proofs = tree(placed.select("lang", "rank", "n", "digest", "item"), ["lang"], config)
    by_lang = ranked(materialize(subroots, "merkle-subroots"), [], ["lang"], config)
    _, tops = tree(by_lang.select("rank", "n", F.col("top").alias("digest"), F.struct("lang").alias("item")), [], config)
    up = tops.select(F.col("item.lang").alias("__lang"), F.col("path").alias("__up"), F.col("top").alias("root"))
    whole = proofs.join(up, F.col("lang").eqNullSafe(F.col("__lang")))
    return whole.select("item.*", F.col("digest").alias("leaf"), F.col("top").alias("subroot"), "root", F.concat("path", "__up").alias("path"))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tampered_leaf() -> Column:
    """The leaf after tampering, which makes the text's A-Z lower case where 3 divides the crc32 of doc_id; null where nothing is done, as for a null doc_id."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return F.when(hit, leaf_digest(*[F.col(c) for c in FIELDS[:-1]], lower_ascii(F.col("text"))))
