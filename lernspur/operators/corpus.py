"""Corpus curation: counts, floors, dedup, leak-free splits, sampling and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lernspur.operators.ranking import hash_rank, seeded


def counts_by(df: DataFrame, key: str, ok: Column, source: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n"), F.count_if(ok).alias("n_ok"), F.countDistinct(source).alias("n_sources"))


def vocab_floor(counts: DataFrame, vocab: DataFrame, key: str, floor: int, least_vocab: int) -> DataFrame:
    """Each vocabulary entry with its clips and whether it is kept: the floor sinks until ``least_vocab`` entries stay, never under 1."""
    summed = vocab.select(key).join(counts.groupBy(key).agg(F.sum("n").alias("n")), key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))
    nth = summed.orderBy(F.desc("n")).limit(least_vocab).agg(F.min("n").alias("nth"), F.count("*").alias("found"))
    sunk = F.greatest(F.lit(1), F.least(F.lit(floor), F.when(F.col("found") < least_vocab, 1).otherwise(F.col("nth"))))
    used = nth.select((F.lit(floor) if floor <= 1 else sunk).cast("long").alias("floor"))
    return summed.join(F.broadcast(used)).select(key, "n", "floor", (F.col("n") >= F.col("floor")).alias("kept"))


def allow_list(df: DataFrame, vocab: DataFrame, key: str) -> DataFrame:
    return df.join(vocab.select(key).distinct(), key, "left_semi")


def skip_reasons(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows by the first rule they meet; rows that meet none are kept and not counted."""
    reason = None
    for name, rule in rules.items():
        reason = F.when(rule, name) if reason is None else reason.when(rule, name)
    return df.select(reason.alias("reason")).where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"))


def dedup_within(df: DataFrame, cohort: Column, hash_col: str, order: str) -> DataFrame:
    """The first row, by ``order``, of each (cohort, hash). Cohorts split by hash, so no group gathers."""
    first = df.groupBy(cohort.alias("__c"), F.col(hash_col)).agg(F.min_by(F.struct(*df.columns), order).alias("__r"))
    return first.select("__r.*")


def dedup_prefer(df: DataFrame, key: str, final: Column, order: str) -> DataFrame:
    """One row per key: the first ``final`` row if there is one, else the last row."""
    row = F.struct(*df.columns)
    best = df.groupBy(key).agg(F.min_by(row, F.when(final, F.col(order))).alias("__a"), F.max_by(row, order).alias("__b"), F.max(final).alias("__f"))
    return best.select(F.when(F.col("__f"), F.col("__a")).otherwise(F.col("__b")).alias("__r")).select("__r.*")


def named_signers(df: DataFrame, signer: str, key: str) -> DataFrame:
    """Rows without a signer as signers of their own, named after the row."""
    return df.withColumn(signer, F.coalesce(F.col(signer), F.concat(F.lit("_anon_"), F.col(key).cast("string"))))


def split_signers_per_sign(df: DataFrame, sign: str, signer: str, key: str, train: float = 0.70, val: float = 0.15, seed: str = "42") -> DataFrame:
    """Signers of each sign, whole, into train, val or test by greedy fill in seeded order; a row without a signer is one of its own."""
    signers = named_signers(df, signer, key).groupBy(sign, signer).agg(F.count("*").alias("n"))
    order = W.partitionBy(sign).orderBy(seeded(F.col(signer), seed), signer)
    before = F.coalesce(F.sum("n").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("n").over(W.partitionBy(sign))
    first = signers.withColumn("before", before).withColumn("total", total)
    first = first.withColumn("is_train", F.col("before") < F.greatest(F.lit(1), F.floor(F.col("total") * train)))
    in_train = F.sum(F.when(F.col("is_train"), F.col("n")).otherwise(0)).over(W.partitionBy(sign))
    is_val = ~F.col("is_train") & (F.col("before") - in_train < F.greatest(F.lit(1), F.floor(F.col("total") * val)))
    return first.withColumn("split", F.when(F.col("is_train"), "train").when(is_val, "val").otherwise("test")).select(sign, signer, "n", "split")


def split_signers(df: DataFrame, signer: str, key: str, fraction: float = 0.2, seed: str = "42") -> DataFrame:
    """Whole signers: val is the first max(1, round(n * fraction)) in seeded order; a row without a signer is one of its own."""
    ranked = hash_rank(named_signers(df, signer, key).select(signer).distinct(), [], signer, seed)
    n_val = F.greatest(F.lit(1), F.bround(F.col("group_size") * fraction))
    return ranked.select(signer, F.when(F.col("rank") <= n_val, "val").otherwise("train").alias("split"))


def split_clips_per_sign(df: DataFrame, sign: str, key: str, fraction: float = 0.2, seed: str = "42") -> DataFrame:
    """Per sign max(1, int(n * fraction)) rows to val if it has two or more."""
    n_val = F.when(F.col("group_size") >= 2, F.greatest(F.lit(1), F.floor(F.col("group_size") * fraction))).otherwise(0)
    return hash_rank(df, [sign], key, seed).withColumn("split", F.when(F.col("rank") <= n_val, "val").otherwise("train")).drop("rank", "group_size")


def split_items(df: DataFrame, key: str, fraction: float = 0.05, least: int = 1, seed: str = "42", groups: list[str] | None = None) -> DataFrame:
    """max(least, int(n * fraction)) rows to val, over all rows or in each of ``groups``."""
    n_val = F.greatest(F.lit(least), F.floor(F.col("group_size") * fraction))
    return hash_rank(df, groups or [], key, seed).withColumn("split", F.when(F.col("rank") <= n_val, "val").otherwise("train")).drop("rank", "group_size")


def split_modulo(df: DataFrame, index: str, n: int = 20) -> DataFrame:
    return df.withColumn("split", F.when(F.pmod(F.col(index), F.lit(n)) == 0, "val").otherwise("train"))


def balance_to(df: DataFrame, group: str, key: str, n: int, seed: str = "42") -> DataFrame:
    """Exactly n rows a group: the first n in seeded order, or all and then again from the first."""
    ranked = hash_rank(df, [group], key, seed)
    copies = F.when(F.col("rank") <= F.lit(n), F.ceil((F.lit(n) - F.col("rank") + 1) / F.col("group_size"))).otherwise(0).cast("int")
    return ranked.withColumn("__c", copies).where("__c > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), "__c"))).drop("rank", "group_size", "__c")


def class_weights(df: DataFrame, group: str, root: bool = False) -> DataFrame:
    """Every group's weight 1 / n, or 1 / sqrt(n)."""
    return df.groupBy(group).agg(F.count("*").alias("n")).withColumn("weight", 1 / (F.sqrt("n") if root else F.col("n")))


def stratified_sample(df: DataFrame, group: str, key: str, n: int, seed: str = "42") -> DataFrame:
    """max(1, round(n * size / total)) rows of each group, or all if there are no more than n."""
    total = df.agg(F.count("*").alias("total"))
    ranked = hash_rank(df, [group], key, seed).join(F.broadcast(total))
    quota = F.greatest(F.lit(1), F.bround(n * F.col("group_size") / F.col("total")))
    return ranked.where((F.col("total") <= n) | (F.col("rank") <= quota)).drop("rank", "group_size", "total")


def mix_negatives(positive: DataFrame, negative: DataFrame, key: str, fraction: float = 0.2, seed: str = "42") -> DataFrame:
    """Positives with min(all, round(positives * fraction)) negatives."""
    n = positive.agg(F.bround(F.count("*") * fraction).alias("__want"))
    some = hash_rank(negative, [], key, seed).join(F.broadcast(n)).where(F.col("rank") <= F.col("__want")).drop("rank", "group_size", "__want")
    return positive.withColumn("negative", F.lit(False)).unionByName(some.withColumn("negative", F.lit(True)))


def quota_select(df: DataFrame, group: str, key: str, target: int, have: DataFrame) -> DataFrame:
    """First rows by key of each group until it has ``target`` with those it has already."""
    need = F.greatest(F.lit(0), F.lit(target) - F.coalesce("have", F.lit(0)))
    ranked = df.withColumn("__r", F.row_number().over(W.partitionBy(group).orderBy(key))).where(F.col("__r") <= target)
    return ranked.join(have.select(group, "have"), group, "left").where(F.col("__r") <= need).drop("__r", "have")


def thin_groups(counts: DataFrame, vocab: DataFrame, key: str, target: int) -> DataFrame:
    """Vocabulary entries below target, neediest first; entries without rows count 0."""
    all_ = vocab.select(key).join(counts, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))
    return all_.where(F.col("n") < target).withColumn("need", F.lit(target) - F.col("n"))


def missing(vocab: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    return vocab.select(key).distinct().join(seen.select(key), key, "left_anti")


def present_classes(train: DataFrame, val: DataFrame, vocab: DataFrame, key: str) -> DataFrame:
    """Labels of either split that the vocabulary has, numbered by name."""
    found = train.select(key).union(val.select(key)).distinct().join(vocab.select(key).distinct(), key, "left_semi")
    return found.withColumn("index", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(key)) - 1)


def split_leaks(df: DataFrame, key: str) -> DataFrame:
    """Keys that stand in more than one split."""
    return df.groupBy(key).agg(F.countDistinct("split").alias("splits")).where("splits > 1")


def signer_counts(df: DataFrame, signer: str) -> DataFrame:
    return df.groupBy("split").agg(F.countDistinct(signer).alias("signers"), F.count("*").alias("clips"))


def class_range(df: DataFrame, key: str) -> DataFrame:
    """Least, upper median and greatest class size."""
    n = df.groupBy(key).agg(F.count("*").alias("n"))
    return n.agg(F.min("n").alias("least"), F.sort_array(F.collect_list("n"))[(F.count("*") / 2).cast("int")].alias("middle"), F.max("n").alias("most"))


def lesson_groups(df: DataFrame, accuracy: str, key: str, size: int = 16) -> DataFrame:
    """Lessons of ``size`` by accuracy, best first."""
    place = F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.desc(accuracy), key))
    return df.withColumn("lesson", (F.floor((place - 1) / size) + 1).cast("int"))


def resume_anti(todo: DataFrame, done: DataFrame, key: str, final: list[str]) -> DataFrame:
    """Work that is left, and the rows that need none again, told apart by ``reused``."""
    kept = done.where(F.col("status").isin(final))
    left = todo.join(kept.select(key), key, "left_anti").select(key, F.lit("todo").alias("status"), F.lit(False).alias("reused"))
    return left.unionByName(todo.select(key).join(kept.select(key, "status"), key).withColumn("reused", F.lit(True)))


def diff_versions(a: DataFrame, b: DataFrame, key: str, metric: str) -> DataFrame:
    """Both versions' metric, 0 where absent, and the change."""
    both = a.select(key, F.col(metric).alias("before")).join(b.select(key, F.col(metric).alias("after")), key, "full_outer")
    filled = both.select(key, F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after"))
    return filled.withColumn("change", F.col("after") - F.col("before"))


def resolve_gloss(df: DataFrame, column: str, vocab: DataFrame, aliases: DataFrame) -> DataFrame:
    """vocab entry of each gloss: its slug, or else its alias. ``vocab`` has slug; ``aliases`` has alias and slug."""
    from lernspur.functions.text import slug_direct

    d = df.withColumn("__g", slug_direct(F.col(column)))
    direct = vocab.select(F.col("slug").alias("__d")).distinct()
    named = aliases.select(F.col("alias").alias("__a"), F.col("slug").alias("__s"))
    return d.join(direct, F.col("__g") == F.col("__d"), "left").join(named, F.col("__g") == F.col("__a"), "left").withColumn("resolved", F.coalesce("__d", "__s")).drop("__g", "__d", "__a", "__s")


def attach_signer(rows: DataFrame, manifest: DataFrame, key: str, signer: str, source: str) -> DataFrame:
    """Rows with the signer key source:signer, or source:clip:key where the signer is unknown."""
    known = manifest.select(key, signer, source)
    name = F.when(F.col(signer).isNotNull(), F.concat_ws(":", source, signer)).otherwise(F.concat(F.col(source), F.lit(":clip:"), F.col(key).cast("string")))
    return rows.join(known, key).withColumn("signer_key", name)


def weighted_sample(df: DataFrame, key: str, weight: Column, n: int, seed: str = "42") -> DataFrame:
    """n draws with replacement by weight: draw i takes the row whose share of the total weight covers its uniform number.

    Rows stand in slices by hash and by key inside them. Draws are put among the rows of their slice at their place in
    the running weight, and each takes the row before it; rows without weight are never drawn.
    """
    runs = df.select(key, weight.cast("double").alias("__w")).where("__w > 0").withColumn("__s", F.substring(seeded(F.col(key), seed), 1, 2))
    per = runs.groupBy("__s").agg(F.sum("__w").alias("__n"))
    everything = W.partitionBy(F.lit(0))
    per = per.select("__s", F.coalesce(F.sum("__n").over(everything.orderBy("__s").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)).alias("__shift"), "__n", F.sum("__n").over(everything).alias("__total"))
    digits = F.conv(F.substring(seeded(F.col("draw"), seed), 1, 12), 16, 10).cast("double") / float(1 << 48)
    draws = df.sparkSession.range(n).select(F.col("id").alias("draw")).withColumn("__u", digits)
    # at most 256 slices, so a list of their bounds finds each draw's
    bounds = per.agg(F.array_sort(F.collect_list(F.struct("__shift", "__n", "__total", "__s"))).alias("__b"))
    placed = draws.crossJoin(bounds).withColumn("__at", F.col("__u") * F.get("__b", F.lit(0))["__total"])
    mine = F.element_at(F.filter("__b", lambda b: b["__shift"] <= F.col("__at")), -1)
    asked = placed.where(F.size("__b") > 0).select(F.lit(None).cast(df.schema[key].dataType).alias(key), "draw", mine["__s"].alias("__s"), (F.col("__at") - mine["__shift"]).alias("__p"))
    start = F.sum("__w").over(W.partitionBy("__s").orderBy(key).rowsBetween(W.unboundedPreceding, 0)) - F.col("__w")
    rows = runs.select(key, F.lit(None).cast("long").alias("draw"), "__s", start.alias("__p"))
    order = W.partitionBy("__s").orderBy("__p", F.col("draw").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0)
    return rows.unionByName(asked).withColumn("__k", F.last(key, ignorenulls=True).over(order)).where("draw IS NOT NULL").select("draw", F.col("__k").alias(key))


def category_order(items: DataFrame, category: str, rank: str, last: str | None = None) -> DataFrame:
    """Categories by mean rank, those without ranks after them, and ``last`` after all."""
    per = items.groupBy(category).agg(F.avg(rank).alias("mean_rank"), F.count("*").alias("n"))
    order = W.partitionBy(F.lit(0)).orderBy((F.col(category) == F.lit(last)).cast("int"), F.col("mean_rank").asc_nulls_last(), category)
    return per.withColumn("position", F.row_number().over(order))


def top_groups(df: DataFrame, key: str, n: int, order: str) -> DataFrame:
    """Rows of the n largest groups; of equal ones the first seen by ``order``."""
    best = df.groupBy(key).agg(F.count("*").alias("__n"), F.min(order).alias("__o")).orderBy(F.desc("__n"), "__o").limit(n)
    return df.join(best.select(key), key, "left_semi")


def split_groups(df: DataFrame, group: str, fraction: float, seed: str = "42") -> DataFrame:
    """Whole groups to one side: max(1, int(groups * fraction)) of them to val."""
    ranked = hash_rank(df.select(group).distinct(), [], group, seed)
    side = F.when(F.col("rank") <= F.greatest(F.lit(1), F.floor(F.col("group_size") * fraction)), "val").otherwise("train")
    return df.join(ranked.select(group, side.alias("split")), group)


def activate(items: DataFrame, key: str, keep: DataFrame) -> DataFrame:
    """Items with is_active true for the keys of ``keep`` alone."""
    flags = keep.select(key).distinct().withColumn("__on", F.lit(True))
    return items.join(flags, key, "left").withColumn("is_active", F.coalesce("__on", F.lit(False))).drop("__on")


def own_rows(df: DataFrame, column: str, user: Column) -> DataFrame:
    """Rows of one account."""
    return df.where(F.col(column) == user)


def best_by(df: DataFrame, group: str, key: str, measure: str) -> DataFrame:
    """The key of least measure in each group, the lower key on ties."""
    return df.groupBy(group).agg(F.min_by(key, F.struct(measure, key)).alias(key), F.min(measure).alias(measure))


def split_groups_capped(df: DataFrame, sign: str, group: str, key: str, fraction: float = 0.15, per_sign: int = 100, seed: str = "42") -> DataFrame:
    """Whole groups of each sign to one side, max(1, int(groups * fraction)) of them to val; then at most ``per_sign`` rows of a sign in train and max(5, per_sign // 5) in val, in seeded order.

    Neither groups nor rows of a sign are ordered in one task. Rows need a ``key`` of their own.
    """
    groups = hash_rank(df.select(sign, group).distinct(), [sign], group, seed)
    side = F.when(F.col("rank") <= F.greatest(F.lit(1), F.floor(F.col("group_size") * fraction)), "val").otherwise("train")
    placed = df.join(groups.select(sign, group, side.alias("split")), [sign, group])
    most = F.when(F.col("split") == "val", max(5, per_sign // 5)).otherwise(per_sign)
    return hash_rank(placed, [sign, "split"], key, f"{seed}-rows").where(F.col("rank") <= most).select(*df.columns, "split")


def split_modulo_with(df: DataFrame, key: str, extra: DataFrame, every: int = 20) -> DataFrame:
    """``df`` by every n-th key to val and the rest to train, and all of ``extra`` to train alone, told apart by ``extra``."""
    own = df.withColumn("split", F.when(F.pmod(F.col(key), F.lit(every)) == 0, "val").otherwise("train")).withColumn("extra", F.lit(False))
    return own.unionByName(extra.withColumn("split", F.lit("train")).withColumn("extra", F.lit(True)), allowMissingColumns=True)


def dedup_counts(df: DataFrame, cohort: Column, hash_col: str) -> DataFrame:
    """One row: how many rows ``dedup_within`` keeps and drops. Counted by (cohort, hash), so no copies gather."""
    per = df.groupBy(cohort.alias("__c"), F.col(hash_col)).agg(F.count("*").alias("n"))
    return per.agg(F.count("*").alias("kept"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("dropped"))


def attach_counts(rows: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    """One row: how many rows find their clip in the manifest, and how many do not."""
    known = manifest.select(key).distinct().withColumn("__k", F.lit(1))
    return rows.select(key).join(known, key, "left").agg(F.count("__k").alias("matched"), F.count_if(F.col("__k").isNull()).alias("unmatched"))


def still_thin(counts: list[DataFrame], newer: list[DataFrame], vocab: DataFrame, key: str, target: int) -> DataFrame:
    """Vocabulary entries below target by counts summed over manifests, and still below it with the newer ones: n, n_after, need and ``place`` by need, the neediest first.

    Each table has the key and n; entries without rows count 0. Places are found over the vocabulary.
    """

    def total(tables: list[DataFrame], name: str) -> DataFrame:
        out = tables[0].select(key, "n")
        for t in tables[1:]:
            out = out.unionByName(t.select(key, "n"))
        return out.groupBy(key).agg(F.sum("n").alias(name))

    both = vocab.select(key).distinct().join(total(counts, "n"), key, "left").join(total([*counts, *newer], "n_after"), key, "left").fillna(0, ["n", "n_after"])
    thin = both.where((F.col("n") < target) & (F.col("n_after") < target)).withColumn("need", F.lit(target) - F.col("n_after"))
    return thin.withColumn("place", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.desc("need"), key)))


def lesson_groups_last(df: DataFrame, accuracy: str, last: Column, key: str, size: int = 16) -> DataFrame:
    """Lessons of ``size`` by accuracy, best first, flagged signs after all others."""
    place = F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.coalesce(last, F.lit(False)).cast("int"), F.desc(accuracy), key))
    return df.withColumn("lesson", (F.floor((place - 1) / size) + 1).cast("int"))


def lesson_groups_by_category(df: DataFrame, accuracy: str, category: str, one_handed: Column, key: str, size: int = 16) -> DataFrame:
    """Lessons of ``size``: categories by their mean accuracy, best first; in each one-handed signs first, then by accuracy."""
    mean = df.groupBy(F.col(category).alias("__c")).agg(F.avg(accuracy).alias("__m"))
    met = df.join(mean, F.col(category).eqNullSafe(F.col("__c")))
    place = F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.desc("__m"), F.col(category).asc_nulls_first(), (~F.coalesce(one_handed, F.lit(False))).cast("int"), F.desc(accuracy), key))
    return met.withColumn("lesson", (F.floor((place - 1) / size) + 1).cast("int")).drop("__c", "__m")
