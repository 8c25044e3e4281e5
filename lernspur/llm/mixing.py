"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source gets a word target: its weight's share of all words, held at
``max_epochs`` times its own size, with the excess shared again by weight
among the rest. A target is met by complete epochs of the source plus a
fraction of one more. For the fraction every document draws an exponential key
-ln(u) / quality, where u comes from a hash of its id; documents enter in key
order until the prefix sum of their sizes reaches the rest of the target. The
document on the border gives the words that still fit, so every source meets
its target to the word, however long that document is.

A source may hold most rows, so its prefix sums are split: keys are dealt into
slices of some thousand documents, each slice is summed on its own and then
shifted by the sum of the slices before it.

Defined results: null texts have size 0 and are taken 0 words; a null source
is a source of its own, last in order; repeated ids draw the same u and are
ordered by their size, and repeated rows are told apart only by a running
number; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lernspur.llm.common import WHITE, WORD, materialize

SYMBOLS = r"[#*$%&|<>]"


@dataclass(frozen=True)
class MixConfig:
    #: source weights by code point order of the source, repeating
    weights: tuple[int, ...] = (5, 2, 1)
    max_epochs: int = 3
    seed: int = 42
    docs_per_slice: int = 2000


def sampling_key(doc_id: Column, quality: Column, seed: int) -> Column:
    """Exponential key: the smaller, the earlier. u takes 52 bits of an md5, in (0, 1)."""
    digits = F.substring(F.md5(F.concat_ws("-", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary")), 1, 13)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)
    return -F.log(u) / quality


def quality_weight(size: Column, n_symbols: Column) -> Column:
    """1 for plain words, falling to 1/5 with one symbol a word; never 0."""
    return F.when(size > 0, size.cast("double") / (size + n_symbols * 4).cast("double")).otherwise(F.lit(1.0))


def source_targets(sizes: DataFrame, config: MixConfig = MixConfig()) -> DataFrame:
    """One row per source: source_size, n_docs, weight and target. ``sizes`` has source and size."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    # one row per source from here on
    place = F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())) - 1
    weights = F.array(*[F.lit(w) for w in config.weights])
    weighed = per.withColumn("weight", F.get(weights, F.pmod(place, F.lit(len(config.weights)))))
    full = F.col("source_size") * config.max_epochs
    # sources reach their limit in the order of limit / weight: the level fits those still below it
    order = W.partitionBy(F.lit(0)).orderBy(F.col("full") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    everything = W.partitionBy(F.lit(0))
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("full").over(before), F.lit(0))) / F.sum("weight").over(after)
    tried = weighed.withColumn("full", full).withColumn("level", level).withColumn("at", F.row_number().over(order))
    fits = F.col("full") > F.col("level") * F.col("weight")
    fair = F.min(F.when(fits, F.struct("at", "level"))).over(everything)["level"]
    target = F.coalesce(F.least(F.col("full").cast("double"), fair * F.col("weight")), F.col("full").cast("double"))
    return tried.select("source", "source_size", "n_docs", "weight", target.alias("target"))


def mix(docs: DataFrame, config: MixConfig = MixConfig(), with_text: bool = True) -> DataFrame:
    """``row`` (all input columns, or all but the text), size, source_size, target, epochs, part and taken of every document.

    The mix takes the document ``epochs`` times whole and ``part`` words of it once more: ``taken`` words in all.
    """
    text = F.col("row.text")
    counted = docs.select(F.struct("*").alias("row")).select(
        "row",
        F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long").alias("size"),
        F.regexp_count(F.coalesce(text, F.lit("")), F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
    )
    if not with_text:
        counted = counted.withColumn("row", F.col("row").dropFields("text"))
    key = sampling_key(F.col("row.doc_id"), quality_weight(F.col("size"), F.col("n_symbols")), config.seed)
    counted = materialize(counted.select("row", F.col("row.source").alias("source"), "size", key.alias("key")), "mix")
    targets = source_targets(counted.select("source", "size"), config).withColumnRenamed("source", "t_source")
    joined = counted.join(targets, F.col("source").eqNullSafe(F.col("t_source"))).drop("t_source")
    slices = F.ceil(F.col("n_docs") / config.docs_per_slice)
    sliced = joined.withColumn("slice", F.least(F.floor((1 - F.exp(-F.col("key"))) * slices), slices - 1).cast("int"))
    sums = sliced.groupBy("source", "slice").agg(F.sum("size").alias("in_slice"))
    earlier = W.partitionBy("source").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    shift = sums.select(F.col("source").alias("s_source"), F.col("slice").alias("s_slice"), F.coalesce(F.sum("in_slice").over(earlier), F.lit(0)).alias("shift"))
    inside = W.partitionBy("source", "slice").orderBy("key", F.col("row.doc_id").asc_nulls_first(), "size").rowsBetween(W.unboundedPreceding, 0)
    placed = sliced.withColumn("upto", F.sum("size").over(inside))
    placed = placed.join(shift, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("slice") == F.col("s_slice")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    rest = F.col("target") - epochs * F.col("source_size")
    before = F.col("shift") + F.col("upto") - F.col("size")
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.floor(rest) - before))
    return placed.select("row", "size", "source_size", "target", epochs.cast("int").alias("epochs"), part.alias("part"), (epochs * F.col("size") + part).cast("long").alias("taken"))


def first_words(text: Column, n: Column) -> Column:
    """A text up to the end of its n-th word, unchanged; it must have more than n words."""
    led = F.regexp_like(text, F.lit(f"^{WHITE}")).cast("int")
    rest = F.element_at(F.split(text, WHITE, n + 1 + led), -1)
    return F.regexp_replace(F.substr(text, F.lit(1), F.char_length(text) - F.char_length(rest)), f"{WHITE}$", "")


def take_mix(docs: DataFrame, config: MixConfig = MixConfig()) -> DataFrame:
    """The mixed documents with their own columns, once for every time the mix takes them.

    The last copy of a border document is its text up to its ``part``-th word, with its white space as it is.
    """
    taken = mix(docs, config).where("taken > 0")
    whole = F.col("epochs") + (F.col("part") == F.col("size")).cast("int")
    cut = (F.col("part") > 0) & (F.col("part") < F.col("size"))
    copies = F.sequence(F.lit(1), whole + cut.cast("int"))
    each = taken.select("row", "part", whole.alias("whole"), F.explode(copies).alias("copy"))
    text = F.when(F.col("copy") > F.col("whole"), first_words(F.col("row.text"), F.col("part").cast("int"))).otherwise(F.col("row.text"))
    return each.select(F.col("row").withField("text", text).alias("row")).select("row.*")
