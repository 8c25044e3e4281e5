"""Quality rules with adaptive cutoffs (built-in functions only).

Every document gets counts of words, symbols, repeated lines and repeated
three-word windows. For each (lang, source) group four ratios (in thousandths)
are summarised by a histogram sketch with logarithmic cells: a cell count can be
added across tasks, groups and runs, and a quantile read from it is within 1/64
of the true value. No cutoff is fixed. The fence of a ratio is

    q3 + reach * (q3 - q1)

over the documents of the group that pass the base rule, where each quartile of
a group of n documents is drawn towards that of its language, and that of the
language towards that of all, by ``prior`` documents: (n q + prior parent) /
(n + prior). Small groups so lean on their language at every size, without a
switch. A document is rejected when its count lies above its fence by more than
``spare`` events (as many happen in any text, and a share of a short text says
little), when its mean word length lies above its fence, or below the lower
fence q1 - reach * (q3 - q1).

Defined results: null, empty and blank texts have zero counts and fail the
base rule; null lang and null source are groups of their own; repeated rows
are judged alike; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lernspur.llm.common import WORD, materialize, words

SYMBOLS = r"[#*$%&|<>]"
#: ratios, in thousandths; all but the first are counts per word or line
METRICS = ("word_len", "symbols", "dup_lines", "repeat_words")
#: ratio: its count, what it is counted in, and the events that any text may hold
COUNTED = {"symbols": ("n_symbols", "n_words", 10), "dup_lines": ("n_dup_lines", "n_lines", 10), "repeat_words": ("n_repeat_words", "n_words", 90)}


@dataclass(frozen=True)
class QualityConfig:
    min_words: int = 50
    max_repeat_percent: int = 50
    reach: int = 6
    #: documents that a language weighs in its groups' quartiles, and all documents in the language's
    prior: int = 50


def _counts(docs: DataFrame) -> DataFrame:
    """Adds the contract's counts to rows packed as ``row``; arrays stay inside the task."""
    zero = F.lit(0).cast("long")
    text = F.coalesce(F.col("row.text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    a = docs.select("row", words(F.col("row.text")).alias("w"), lines.alias("l"), F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"))
    b = a.select(
        "row",
        "n_symbols",
        F.size("w").cast("long").alias("n_words"),
        F.aggregate("w", zero, lambda s, x: s + F.length(x)).alias("word_chars"),
        F.size("l").cast("long").alias("n_lines"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("h"),
    )
    c = b.withColumn(
        "s",
        F.sort_array(
            F.transform(
                F.slice("h", 1, F.greatest(F.size("h") - 2, F.lit(0))),
                lambda x, i: F.struct(F.xxhash64(x, F.get("h", i + 1), F.get("h", i + 2)).alias("k"), i.alias("p")),
            )
        ),
    ).drop("h")
    twice = lambda x, i: (F.get("s", i - 1)["k"] == x["k"]) | (F.get("s", i + 1)["k"] == x["k"])
    d = c.withColumn("p", F.sort_array(F.transform(F.filter("s", twice), lambda x: x["p"]))).drop("s")
    gaps = F.zip_with("p", F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(0))), lambda x, y: F.least(F.lit(3), F.coalesce(y - x, F.lit(3))))
    return d.withColumn("n_repeat_words", F.aggregate(gaps, zero, lambda s, x: s + x)).drop("p")


def _thousandths() -> dict[str, Column]:
    per = lambda a, b: F.when(F.col(b) > 0, F.expr(f"{a} * 1000 div {b}")).otherwise(F.lit(0)).cast("long")
    return {"word_len": per("word_chars", "n_words"), "symbols": per("n_symbols", "n_words"), "dup_lines": per("n_dup_lines", "n_lines"), "repeat_words": per("n_repeat_words", "n_words")}


def sketch_cell(v: Column) -> Column:
    """Cell of a whole number >= 0: exact below 128, then 64 cells to each power of two."""
    drop = F.greatest(F.length(F.bin(v)) - 7, F.lit(0))
    return (drop * 256 + F.call_function("shiftright", v, drop).cast("int")).cast("int")


def cell_bounds(cell: Column) -> tuple[Column, Column]:
    """Least and greatest value of a cell."""
    drop = F.floor(cell / 256).cast("int")
    low = (cell - drop * 256).cast("long")
    return F.call_function("shiftleft", low, drop), F.call_function("shiftleft", low + 1, drop) - 1


def quantile_sketches(scored: DataFrame) -> DataFrame:
    """(lang, source, metric, cell, n): the mergeable sketches, one row for each non-empty cell."""
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), sketch_cell(F.col(m)).alias("cell")) for m in METRICS])).alias("x")
    return scored.select("lang", "source", pairs).groupBy("lang", "source", "x.metric", "x.cell").agg(F.count("*").alias("n"))


def _quartiles(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Docs and quartiles of each (keys, metric) from merged cell counts."""
    merged = cells.groupBy(*keys, "metric", "cell").agg(F.sum("n").alias("n"))
    by = W.partitionBy(*keys, "metric")
    run = F.sum("n").over(by.orderBy("cell").rowsBetween(W.unboundedPreceding, 0))
    counted = merged.select(*keys, "metric", "cell", run.alias("run"), F.sum("n").over(by).alias("docs"))
    at = lambda q: F.min(F.when(F.col("run") * 4 >= F.col("docs") * q, F.col("cell")))
    return counted.groupBy(*keys, "metric").agg(F.max("docs").alias("docs"), cell_bounds(at(1))[0].alias("q1"), cell_bounds(at(3))[1].alias("q3"))


def adaptive_fences(scored: DataFrame, config: QualityConfig = QualityConfig()) -> DataFrame:
    """One row per (lang, source) with an upper fence per metric and a lower fence of the word length."""
    cells = quantile_sketches(scored)
    named = lambda df, p: df.withColumnsRenamed({c: f"{p}_{c}" for c in df.columns})
    groups = _quartiles(cells, ["lang", "source"])
    langs = named(_quartiles(cells, ["lang"]), "l")
    every = named(_quartiles(cells.withColumn("all", F.lit(1)), ["all"]), "e")
    joined = groups.join(langs, F.col("lang").eqNullSafe(F.col("l_lang")) & (F.col("metric") == F.col("l_metric"))).join(every, F.col("metric") == F.col("e_metric"))
    drawn = lambda n, q, parent: F.expr(f"({n} * {q} + {config.prior} * {parent}) div ({n} + {config.prior})")
    for q in ("q1", "q3"):
        joined = joined.withColumn(f"l_{q}", drawn("l_docs", f"l_{q}", f"e_{q}")).withColumn(q, drawn("docs", q, f"l_{q}"))
    spread = (F.col("q3") - F.col("q1")) * config.reach
    tops = [F.max(F.when(F.col("metric") == name, F.col("q3") + spread)).alias(f"max_{name}") for name in METRICS]
    return joined.groupBy("lang", "source").agg(*tops, F.max(F.when(F.col("metric") == "word_len", F.col("q1") - spread)).alias("min_word_len"))


def score_quality(docs: DataFrame, config: QualityConfig = QualityConfig(), with_text: bool = True) -> DataFrame:
    """``row`` (all input columns, or all but the text), the counts, ``base_failed`` and ``kept`` for every document.

    The counted rows are written once: fences and verdicts both read them, so no text is counted twice.
    """
    counted = _counts(docs.select(F.struct("*").alias("row")))
    if not with_text:
        counted = counted.withColumn("row", F.col("row").dropFields("text"))
    counted = materialize(counted, "quality")
    base = (F.col("n_words") < config.min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * config.max_repeat_percent)
    scored = counted.select("*", F.col("row.lang").alias("lang"), F.col("row.source").alias("source"), base.alias("base_failed")).withColumns(_thousandths())
    fences = adaptive_fences(scored.where(~F.col("base_failed")).select("lang", "source", *METRICS), config)
    fences = fences.withColumnsRenamed({"lang": "f_lang", "source": "f_source"})
    held = scored.join(fences, F.col("lang").eqNullSafe(F.col("f_lang")) & F.col("source").eqNullSafe(F.col("f_source")), "left")
    over = (F.col("word_len") > F.col("max_word_len")) | (F.col("word_len") < F.col("min_word_len"))
    for name, (count, of, spare) in COUNTED.items():
        over = over | (F.col(count) * 1000 > F.col(f"max_{name}") * F.col(of) + spare * 1000)
    return held.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(over, F.lit(False)))


def keep_good(docs: DataFrame, config: QualityConfig = QualityConfig()) -> DataFrame:
    """The documents that pass, with their own columns."""
    return score_quality(docs, config).where("kept").select("row.*")
