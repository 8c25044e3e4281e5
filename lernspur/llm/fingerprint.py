"""Document fingerprints: one-permutation MinHash with optimal densification (built-in functions only).

The five-word shingles of a text are hashed once. The top bits of a hash name
its bin, the rest is its rank, so one sort of the hashes lines up the minimum
of every bin. An empty bin copies the bin that its own probe sequence reaches
first (optimal densification: the sequence depends on the bin alone, so two
texts that lack the same bins borrow alike). The fingerprint is the low-order
bits of each bin, packed as hexadecimal digits. The likeness of two
fingerprints is their share of equal bins, corrected for equal bits by chance.

Defined results: texts of one to four words have one shingle, the whole text;
null, empty and blank texts have the empty fingerprint, which is like itself
(1.0) and unlike any other (0.0); equal texts have equal fingerprints. Repeated
ids are ordered by their text, and null ids come first. A lone document is its
own next document. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lernspur.llm.common import shuffle_partitions, words


@dataclass(frozen=True)
class FingerprintConfig:
    shingle: int = 5
    #: log2 of the number of bins
    bin_bits: int = 7
    #: low-order bits kept for each bin: 4, 8, 12 or 16
    keep_bits: int = 8
    seed: int = 42

    @property
    def bins(self) -> int:
        return 1 << self.bin_bits


def _probe(i: int, config: FingerprintConfig) -> tuple[int, int]:
    """Start and odd step of bin i's probe sequence, which visits every bin once."""
    x = ((i + 1) * 0x9E3779B97F4A7C15 + config.seed * 0xBF58476D1CE4E5B9) & (2**64 - 1)
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & (2**64 - 1)
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & (2**64 - 1)
    x ^= x >> 31
    return (x >> 8) % config.bins, ((x >> 40) % config.bins) | 1


def with_fingerprint(df: DataFrame, text: Column, into: str, config: FingerprintConfig = FingerprintConfig()) -> DataFrame:
    """Adds the packed fingerprint of ``text`` as the string column ``into``."""
    kept = [F.col(f"`{c}`") for c in df.columns]
    k, shift = config.shingle, 63 - config.bin_bits
    ends = F.array(*[F.lit(((i + 1) << shift) - 1) for i in range(config.bins)])
    hashed = df.select(*kept, F.transform(words(text), lambda x: F.xxhash64(x)).alias("__h"))
    whole = F.when(F.size("__h") > 0, F.array(F.xxhash64("__h"))).otherwise(F.array().cast("array<bigint>"))
    windows = F.transform(F.slice("__h", 1, F.greatest(F.size("__h") - (k - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get("__h", i + j) for j in range(1, k)]))
    shingles = F.when(F.size("__h") >= k, windows).otherwise(whole)
    # a bin's own last value stands in each bin, so that every bin has a first value in the sorted hashes
    lined = hashed.select(*kept, F.sort_array(F.concat(F.transform(shingles, lambda x: F.shiftrightunsigned(x, 1)), ends)).alias("__s"))
    first = lambda x, i: (i == 0) | (F.shiftright(x, shift) != F.shiftright(F.get("__s", i - 1), shift))
    mins = lined.select(*kept, F.filter("__s", first).alias("__m"))
    held = mins.select(*kept, F.transform("__m", lambda x, i: F.when(x != F.shiftleft(i.cast("long"), shift).bitwiseOR((1 << shift) - 1), x.bitwiseAND((1 << config.keep_bits) - 1))).alias("__v"))
    probes = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(s).alias("s")) for a, s in (_probe(i, config) for i in range(config.bins))])
    at = lambda p, t: F.get("__v", (p["a"] + p["s"] * t).bitwiseAND(config.bins - 1))
    late = lambda p: F.get(F.filter(F.transform(F.sequence(F.lit(4), F.lit(config.bins - 1)), lambda t: at(p, t)), lambda x: x.isNotNull()), F.lit(0))
    filled = F.zip_with("__v", probes, lambda x, p: F.coalesce(x, at(p, F.lit(0)), at(p, F.lit(1)), at(p, F.lit(2)), at(p, F.lit(3)), late(p)))
    digits = config.keep_bits // 4
    packed = F.array_join(F.transform(filled, lambda x: F.lpad(F.hex(x), digits, "0")), "")
    some = F.exists("__v", lambda x: x.isNotNull())
    return held.select(*kept, F.when(some, packed).otherwise(F.lit("")).alias(into))


def likeness(a: Column, b: Column, config: FingerprintConfig = FingerprintConfig()) -> Column:
    """Estimated share of common shingles, 0 to 1, from two packed fingerprints."""
    digits, n = config.keep_bits // 4, config.bins
    same = F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), F.lit(0), lambda s, i: s + F.when(F.substr(a, i * digits + 1, F.lit(digits)) == F.substr(b, i * digits + 1, F.lit(digits)), 1).otherwise(0))
    chance = 1.0 / (1 << config.keep_bits)
    fair = F.greatest(F.lit(0.0), (same / F.lit(float(n)) - chance) / (1.0 - chance))
    return F.when((a == "") | (b == ""), (a == b).cast("double")).when(a == b, F.lit(1.0)).otherwise(fair)


#: Rows of a key range: ranges grow in number with the rows, up to a plan's reasonable length, and in size beyond it.
ROWS_PER_RANGE = 20_000


def with_next(docs: DataFrame, key: str, carry: list[str], blocks: int | None = None) -> DataFrame:
    """Adds struct ``next`` with the ``carry`` columns of the next row by ``key``, the first row after the last.

    Rows are dealt into key ranges of about equal size; the first rows of a
    range are also sent to the range before it, so that no range needs another
    and no task holds more than one range.
    """
    n = blocks or max(2 * shuffle_partitions(docs.sparkSession), min(20_000, docs.count() // ROWS_PER_RANGE + 1))
    at = docs.agg(F.percentile_approx(key, [i / n for i in range(n)], max(10_000, 4 * n)).alias("q")).first()["q"]
    bounds = sorted(set(at or []))
    kept = [F.col(f"`{c}`") for c in docs.columns]
    inner = F.array(*[F.lit(b) for b in bounds[1:]]) if len(bounds) > 1 else F.array().cast("array<bigint>")
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(max(1, len(bounds)).bit_length()))])
    block = F.aggregate(steps, F.lit(0), lambda s, x: s + F.when(F.get(inner, s + x - 1) <= F.col(key), x).otherwise(0))
    last = max(0, len(bounds) - 1)
    own = docs.select(*kept, block.alias("__b"))
    leads = F.col(key).isNull() | F.array_contains(F.array(*[F.lit(b) for b in bounds]) if bounds else F.array().cast("array<bigint>"), F.col(key))
    before = F.when(F.col("__b") > 0, F.col("__b") - 1).otherwise(F.lit(last))
    here = F.struct(F.col("__b").alias("b"), F.lit(0).alias("copy"))
    sent = own.select(*kept, F.explode(F.when(leads, F.array(here, F.struct(before.alias("b"), F.lit(1).alias("copy")))).otherwise(F.array(here))).alias("__at"))
    order = W.partitionBy("__at.b").orderBy("__at.copy", F.col(key).asc_nulls_first(), *[F.col(c) for c in carry])
    return sent.withColumn("next", F.lead(F.struct(*carry)).over(order)).where("__at.copy = 0").drop("__at")


def edited_text(text: Column, following: Column) -> Column:
    """The last half of the code points replaced by the first as many of the following text."""
    mine, other = F.coalesce(text, F.lit("")), F.coalesce(following, F.lit(""))
    half = F.floor(F.char_length(mine) / 2).cast("int")
    return F.concat(F.substr(mine, F.lit(1), F.char_length(mine) - half), F.substr(other, F.lit(1), half))


def fingerprint_pairs(docs: DataFrame, config: FingerprintConfig = FingerprintConfig()) -> DataFrame:
    """Each document with its own, its edited text's and its next document's fingerprint."""
    own = with_fingerprint(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), F.col("text"), "fingerprint", config)
    chained = with_next(own, "doc_id", ["text", "fingerprint"])
    edited = chained.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), "fingerprint", F.col("next.fingerprint").alias("next_fingerprint"), edited_text(F.col("text"), F.col("next.text")).alias("edited"))
    return with_fingerprint(edited, F.col("edited"), "edited_fingerprint", config)
