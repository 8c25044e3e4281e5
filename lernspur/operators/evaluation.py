"""Evaluation of class scores: ranks, confusion, calibration, thresholds and the promotion gate.

``scores`` is long: item, label (true class), class and logit. ``preds`` has one
row per item: label, pred, rank of the true class, and the top probability.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lernspur.operators.ranking import exact_quantiles, running_sums

#: Fixed value: the two-sided 95 % point of the normal distribution.
Z95 = 1.959963984540054

#: The names of architectures trained from scratch.
ARCHITECTURES = ("tcn", "small_r2plus1d", "bilstm", "transformer")


def with_probability(scores: DataFrame, temperature: float = 1.0) -> DataFrame:
    """Softmax over the classes of each item; temperatures of 0 and below count as 1."""
    t = temperature if temperature > 0 else 1.0
    of_item = W.partitionBy("item")
    e = F.exp((F.col("logit") - F.max("logit").over(of_item)) / t)
    return scores.withColumn("__e", e).withColumn("prob", F.col("__e") / F.sum("__e").over(of_item)).drop("__e")


def rank_classes(scores: DataFrame) -> DataFrame:
    """1-based rank of every class of an item by logit, ties by class."""
    return scores.withColumn("rank", F.row_number().over(W.partitionBy("item").orderBy(F.desc("logit"), "class")))


def predictions(scores: DataFrame) -> DataFrame:
    """item, label, pred, true_rank, top_prob, true_prob."""
    ranked = rank_classes(with_probability(scores))
    return ranked.groupBy("item", "label").agg(
        F.min_by("class", "rank").alias("pred"),
        F.max(F.when(F.col("class") == F.col("label"), F.col("rank"))).alias("true_rank"),
        F.max("prob").alias("top_prob"),
        F.max(F.when(F.col("class") == F.col("label"), F.col("prob"))).alias("true_prob"),
    )


def confusion_matrix(preds: DataFrame) -> DataFrame:
    return preds.groupBy("label", "pred").agg(F.count("*").alias("n"))


def confusion_sub(preds: DataFrame, labels: list) -> DataFrame:
    """Matrix of the listed labels; other predictions are one class, -1."""
    kept = preds.where(F.col("label").isin(labels))
    return kept.groupBy("label", F.when(F.col("pred").isin(labels), F.col("pred")).otherwise(F.lit(-1)).alias("pred")).agg(F.count("*").alias("n"))


def topk_accuracy(preds: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    return preds.agg(F.count("*").alias("n"), F.countDistinct("pred").alias("predicted_classes"), *[F.avg((F.col("true_rank") <= k).cast("int")).alias(f"top{k}") for k in ks])


def per_class(preds: DataFrame) -> DataFrame:
    """n, correct, recall, n_predicted and magnet ratio (predicted / actual) of each class."""
    actual = preds.groupBy(F.col("label").alias("class")).agg(F.count("*").alias("n"), F.count_if(F.col("label") == F.col("pred")).alias("correct"))
    made = preds.groupBy(F.col("pred").alias("class")).agg(F.count("*").alias("n_predicted"))
    both = actual.join(made, "class", "full_outer").select("class", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "correct", "n_predicted")])
    recall = F.when(F.col("n") > 0, F.col("correct") / F.col("n")).otherwise(0.0)
    magnet = F.when(F.col("n") > 0, F.col("n_predicted") / F.col("n")).when(F.col("n_predicted") > 0, F.lit(float("inf"))).otherwise(0.0)
    return both.withColumn("recall", recall).withColumn("magnet", magnet)


def per_source(preds: DataFrame, source: Column) -> DataFrame:
    return preds.groupBy(source.alias("source")).agg(F.count("*").alias("n"), F.avg((F.col("label") == F.col("pred")).cast("int")).alias("accuracy"))


def top_confusions(confusion: DataFrame, k: int) -> DataFrame:
    """The k largest off-diagonal counts of each label; ties by predicted class, last first."""
    place = F.row_number().over(W.partitionBy("label").orderBy(F.desc("n"), F.desc("pred")))
    return confusion.where("label <> pred").withColumn("place", place).where(F.col("place") <= k)


def best_worst(per: DataFrame, n: int) -> DataFrame:
    """The n lowest and n highest recalls, ties by class."""
    low = per.orderBy("recall", "class").limit(n).withColumn("end", F.lit("worst"))
    return low.unionByName(per.orderBy(F.desc("recall"), "class").limit(n).withColumn("end", F.lit("best"))).select("end", "class", "recall")


def collapsed(per: DataFrame, least: float = 2.5, n: int = 10) -> DataFrame:
    return per.where(F.col("magnet") > least).orderBy(F.desc("magnet"), "class").limit(n)


def wilson(k: Column, n: Column) -> Column:
    """Struct low, high: the 95 % Wilson interval of k of n; (0, 0) for n = 0."""
    p, z2 = k / n, Z95 * Z95
    middle = (p + z2 / (2 * n)) / (1 + z2 / n)
    half = Z95 * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    return F.when(n > 0, F.struct(F.greatest(F.lit(0.0), middle - half).alias("low"), F.least(F.lit(1.0), middle + half).alias("high"))).otherwise(F.struct(F.lit(0.0).alias("low"), F.lit(0.0).alias("high")))


def report_summary(per: DataFrame, floor: float = 0.6) -> DataFrame:
    """Mean, upper median and number below the floor of the per-class recalls."""
    seen = per.where("n > 0")
    return seen.agg(F.avg("recall").alias("mean"), F.sort_array(F.collect_list("recall"))[(F.count("*") / 2).cast("int")].alias("median"), F.count_if(F.col("recall") < floor).alias("below"))


def confusion_share(confusion: DataFrame, per: DataFrame, k: int = 15) -> DataFrame:
    """The k largest confusions with their share of the label's errors."""
    errors = per.select(F.col("class").alias("label"), F.bround(F.col("n") * (1 - F.col("recall"))).alias("errors"))
    named = confusion.where("label <> pred").join(errors, "label").withColumn("share", F.when(F.col("errors") > 0, F.col("n") / F.col("errors")).otherwise(0.0))
    return named.orderBy(F.desc("n"), F.desc("label"), F.desc("pred")).limit(k)


def nll(scores: DataFrame, temperature: float = 1.0) -> DataFrame:
    """Mean of -log(p + 1e-12) of the true class."""
    return with_probability(scores, temperature).where(F.col("class") == F.col("label")).agg(F.avg(-F.log(F.col("prob") + 1e-12)).alias("nll"))


def fit_temperature(scores: DataFrame, low: float = 0.1, high: float = 10.0, steps: int = 41) -> DataFrame:
    """The temperature of least nll on a grid of ``steps`` between the bounds; one pass over the scores."""
    grid = F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: i * ((high - low) / (steps - 1)) + low)
    of_item = W.partitionBy("item")
    shifted = scores.withColumn("__x", F.col("logit") - F.max("logit").over(of_item)).withColumn("t", F.explode(grid))
    items = shifted.groupBy("item", "t").agg(F.log(F.sum(F.exp(F.col("__x") / F.col("t")))).alias("lse"), F.max(F.when(F.col("class") == F.col("label"), F.col("__x"))).alias("x"))
    loss = items.groupBy("t").agg(F.avg(-F.log(F.exp(F.col("x") / F.col("t") - F.col("lse")) + 1e-12)).alias("nll"))
    return loss.agg(F.min_by("t", F.struct("nll", "t")).alias("temperature"), F.min("nll").alias("nll"))


def refine_temperature(scores: DataFrame, low: float = 0.1, high: float = 10.0, steps: int = 41, tolerance: float = 1e-3) -> DataFrame:
    """``fit_temperature`` again between the neighbours of the best point, until the grid's step is below ``tolerance``."""
    a, b = low, high
    while True:
        fitted, step = fit_temperature(scores, a, b, steps), (b - a) / (steps - 1)
        if step < tolerance:
            return fitted
        best = fitted.first()["temperature"]
        if best is None:
            return fitted
        a, b = max(low, best - step), min(high, best + step)


def expected_calibration_error(preds: DataFrame, bins: int = 10) -> DataFrame:
    """Sum over equal confidence bins of share x |accuracy - confidence|."""
    cell = F.least(F.floor(F.col("top_prob") * bins), F.lit(bins - 1))
    per = preds.groupBy(cell.alias("bin")).agg(F.count("*").alias("n"), F.avg((F.col("label") == F.col("pred")).cast("int")).alias("accuracy"), F.avg("top_prob").alias("confidence"))
    return per.agg((F.sum(F.col("n") * F.abs(F.col("accuracy") - F.col("confidence"))) / F.sum("n")).alias("ece"))


def demographic_gap(preds: DataFrame, bucket: Column, least: int = 10) -> DataFrame:
    """Largest difference of accuracy between buckets of at least ``least`` items; null with fewer than two."""
    per = preds.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.avg((F.col("label") == F.col("pred")).cast("int")).alias("accuracy")).where(F.col("n") >= least)
    return per.agg(F.count("*").alias("buckets"), F.when(F.count("*") >= 2, F.max("accuracy") - F.min("accuracy")).alias("gap"))


def precision_threshold(scores: DataFrame, precision: float = 0.9) -> DataFrame:
    """Per class the lowest probability at which cumulative precision, walking down, reaches ``precision``; 1 if never. A class is walked in slices of its probabilities."""
    p = with_probability(scores).withColumn("hit", (F.col("class") == F.col("label")).cast("int")).withColumn("one", F.lit(1))
    counted = running_sums(p.select("class", "prob", "item", "hit", "one"), "class", "prob", {"tp": "hit", "k": "one"}, descending=True, ties=["item"])
    ok = (F.col("tp") >= 1) & (F.col("tp") / F.col("k") >= precision)
    return counted.groupBy("class").agg(F.coalesce(F.min(F.when(ok, F.col("prob"))), F.lit(1.0)).alias("threshold"))


def distance_threshold(scores: DataFrame, precision: float = 0.95, per_negative: int = 5) -> DataFrame:
    """Per class the first distance, going up, at which precision holds; else the first of best precision; infinity without positives.

    Negatives are the first ``per_negative`` items of every other label; equal distances count together, and a class is
    walked in slices of its distances.
    """
    own = F.col("class") == F.col("label")
    first = W.partitionBy("class", "label").orderBy("item")
    few = scores.where(~own).withColumn("__p", F.row_number().over(first)).where(F.col("__p") <= per_negative).drop("__p")
    used = scores.where(own).unionByName(few).withColumn("hit", F.coalesce(own, F.lit(False)).cast("int"))
    per = used.groupBy("class", "distance").agg(F.sum("hit").alias("hits"), F.count("*").alias("rows"))
    counted = running_sums(per, "class", "distance", {"tp": "hits", "k": "rows"})
    at = counted.where("hits > 0").withColumn("precision", F.col("tp") / F.col("k"))
    first = F.min(F.when(F.col("precision") >= precision, F.col("distance")))
    best = F.min_by("distance", F.struct(-F.col("precision"), F.col("distance")))
    return at.groupBy("class").agg(F.coalesce(first, best, F.lit(float("inf"))).alias("threshold"), F.sum("hits").alias("positives"))


def score_quantiles(scores: DataFrame) -> DataFrame:
    """Linear quantiles of the true-class distances of each class."""
    q = (0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0)
    own = scores.where(F.col("class") == F.col("label"))
    return exact_quantiles(own, "class", "distance", {f"q{round(100 * x):02d}": x for x in q})


def pass_rule(preds: DataFrame, least_ratio: float = 0.5) -> DataFrame:
    """Passed if the target ranks first, or second with at least ``least_ratio`` of the top probability; match = target / top."""
    match = F.when(F.col("top_prob") > 0, F.col("true_prob") / F.col("top_prob")).otherwise(0.0)
    return preds.withColumn("match", match).withColumn("passed", (F.col("true_rank") == 1) | ((F.col("true_rank") == 2) & (F.col("match") >= least_ratio)))


def uncovered_confusions(confusion: DataFrame, hints: DataFrame, least: int = 2) -> DataFrame:
    """Confusions of at least ``least`` items without a hint for (label, pred)."""
    return confusion.where((F.col("label") != F.col("pred")) & (F.col("n") >= least)).join(hints.select("label", "pred"), ["label", "pred"], "left_anti")


def slice_eval(scores: DataFrame, slices: DataFrame) -> DataFrame:
    """Top-1 inside each slice of classes. ``slices`` has slice and class; rows count where label and class are both in it."""
    candidates = scores.join(slices, "class")
    inside = candidates.join(slices.withColumnRenamed("class", "label"), ["slice", "label"])
    best = inside.groupBy("slice", "item", "label").agg(F.min_by("class", F.struct("distance", "class")).alias("pred"))
    return best.groupBy("slice").agg(F.count("*").alias("n"), F.avg((F.col("label") == F.col("pred")).cast("int")).alias("top1"))


def ablation_lift(base: DataFrame, variant: DataFrame) -> DataFrame:
    """Paired top-1 of two runs over the same items: both rates, lift, and items won and lost."""
    hit = lambda d, n: d.select("item", (F.col("label") == F.col("pred")).cast("int").alias(n))
    both = hit(base, "b").join(hit(variant, "v"), "item")
    return both.agg(F.avg("b").alias("base"), F.avg("v").alias("variant"), (F.avg("v") - F.avg("b")).alias("lift"), F.count_if(F.col("v") > F.col("b")).alias("won"), F.count_if(F.col("v") < F.col("b")).alias("lost"))


def eval_gate(facts: DataFrame) -> DataFrame:
    """One row per rule with the figure, PASS, FAIL or SKIP and what was asked for, and the overall verdict, whose detail names the rules that failed.

    ``facts`` is one row: top1, worst_recall, gap, max_threshold, p95_ms, previous_top1, ece, uncovered and, if known,
    architecture. A report without top-1 counts as 0 and one without thresholds fails; one without classes has no weak
    class, and one that names no architecture no foreign one. The other rules are skipped where their fact is absent.
    """
    top1 = F.coalesce(F.col("top1").cast("double"), F.lit(0.0))
    architecture = F.col("architecture") if "architecture" in facts.columns else F.lit(None).cast("string")
    lost = F.col("previous_top1") - top1
    rules = (
        ("top1", top1, top1 >= 0.85, "at least 0.85"),
        ("per_sign", F.col("worst_recall"), F.coalesce(F.col("worst_recall") >= 0.60, F.lit(True)), "at least 0.60 for every class"),
        ("demographic_gap", F.col("gap"), F.col("gap") <= 0.10, "at most 0.10"),
        ("thresholds", F.col("max_threshold"), F.coalesce(F.col("max_threshold") < 1.0, F.lit(False)), "all below 1"),
        ("latency", F.col("p95_ms"), F.col("p95_ms") <= 600, "at most 600 ms"),
        ("regression", lost, lost <= 0.03, "at most 0.03 below the model before"),
        ("calibration", F.col("ece"), F.col("ece") <= 0.05, "at most 0.05"),
        ("hint_coverage", F.col("uncovered"), F.col("uncovered") == 0, "no repeated confusion without a hint"),
        ("architecture", F.lit(None), F.coalesce(architecture.isin(*ARCHITECTURES), F.lit(True)), "trained from scratch"),
    )
    row = lambda rule, actual, verdict, detail: F.struct(rule.alias("rule"), actual.cast("double").alias("actual"), verdict.alias("verdict"), detail.alias("detail"))
    each = F.array(*[row(F.lit(n), a, F.when(ok.isNull(), "SKIP").when(ok, "PASS").otherwise("FAIL"), F.lit(d)) for n, a, ok, d in rules])
    failed = F.transform(F.filter("rules", lambda r: r["verdict"] == "FAIL"), lambda r: r["rule"])
    overall = row(F.lit("overall"), F.lit(None), F.when(F.size(failed) > 0, "FAIL").otherwise("PASS"), F.array_join(failed, ", "))
    return facts.select(each.alias("rules")).select(F.explode(F.concat("rules", F.array(overall))).alias("r")).select("r.*")


def pass_threshold(preds: DataFrame, thresholds: DataFrame, default: float = 0.5) -> DataFrame:
    """Passed if the top class is the target and its probability reaches the class's threshold, or the default where there is none."""
    t = thresholds.select(F.col("class").alias("label"), "threshold")
    joined = preds.join(t, "label", "left")
    return joined.withColumn("passed", (F.col("pred") == F.col("label")) & (F.col("top_prob") >= F.coalesce("threshold", F.lit(default)))).drop("threshold")


def latency_p95(df: DataFrame, latency: str) -> DataFrame:
    """One row: the 95th percentile, null without a latency."""
    return exact_quantiles(df.select(F.lit(0).alias("all"), latency), "all", latency, {"p95_ms": 0.95}).agg(F.max("p95_ms").alias("p95_ms"))


def soft_gate(before: DataFrame, after: DataFrame, most_drop: float = 0.05) -> DataFrame:
    """Classes whose recall fell by more than ``most_drop`` between two per-class tables."""
    both = before.select("class", F.col("recall").alias("before")).join(after.select("class", F.col("recall").alias("after")), "class")
    return both.where(F.col("before") - F.col("after") > most_drop)


def ablation_report(runs: dict[str, DataFrame], base: str, thresholds: DataFrame) -> DataFrame:
    """One row for every run but the base, over the items that both have: n, correct and passed of each, their lifts, and how many items were won and lost.

    A run has item, label, pred and true_score. An item passes if its true score is under its label's threshold, not at
    it; without score or threshold it does not.
    """
    limit = thresholds.select(F.col("class").alias("label"), "threshold")

    def marked(df: DataFrame, n: str) -> DataFrame:
        met = df.join(limit, "label", "left")
        return met.select("item", F.coalesce(F.col("pred") == F.col("label"), F.lit(False)).cast("int").alias(f"{n}_hit"), F.coalesce(F.col("true_score") < F.col("threshold"), F.lit(False)).cast("int").alias(f"{n}_pass"))

    first, out = marked(runs[base], "b"), None
    for name, run in runs.items():
        if name == base:
            continue
        both = first.join(marked(run, "v"), "item")
        row = both.agg(
            F.count("*").alias("n"), *[F.coalesce(F.sum(f"{s}_{k}"), F.lit(0)).alias(f"{m}_{w}") for s, m in (("b", "base"), ("v", "variant")) for k, w in (("hit", "correct"), ("pass", "passed"))],
            F.count_if(F.col("v_hit") > F.col("b_hit")).alias("won"), F.count_if(F.col("v_hit") < F.col("b_hit")).alias("lost"),
        )
        row = row.select(F.lit(name).alias("variant"), "*", (F.col("variant_correct") - F.col("base_correct")).alias("lift"), (F.col("variant_passed") - F.col("base_passed")).alias("pass_lift"))
        out = row if out is None else out.unionByName(row)
    return out


def ablation_items(base: DataFrame, variant: DataFrame) -> DataFrame:
    """Every item of both runs with ``change``: lift where only the variant is right, regress where only the base is, else null."""
    right = lambda df, n: df.select("item", "label", F.col("pred").alias(n))
    both = right(base, "base_pred").join(right(variant, "variant_pred").drop("label"), "item")
    b, v = (F.coalesce(F.col(c) == F.col("label"), F.lit(False)) for c in ("base_pred", "variant_pred"))
    return both.withColumn("change", F.when(v & ~b, "lift").when(b & ~v, "regress"))


def slice_summary(slices: DataFrame, scores: DataFrame) -> DataFrame:
    """One row over the slices of ``slice_eval``: how many, mean, best and worst top-1, and the top-1 over all classes."""
    best = scores.groupBy("item", "label").agg(F.min_by("class", F.struct("distance", "class")).alias("pred"))
    whole = best.agg(F.avg((F.col("label") == F.col("pred")).cast("int")).alias("global_top1"))
    return slices.agg(F.count("*").alias("slices"), F.avg("top1").alias("mean"), F.max("top1").alias("best"), F.min("top1").alias("worst")).join(whole)


def soft_report(latency: tuple[Column, Column], facts: DataFrame, hints: tuple[DataFrame, DataFrame], confusion: DataFrame, recalls: tuple[DataFrame, DataFrame], slower: float = 200.0, drop: float = 0.05, pairs: int = 10) -> DataFrame:
    """What a reviewer should look at, one row each (rule, key, before, after): a p95 more than ``slower`` ms above the model before, a hint efficacy that fell by more than ``drop`` on one of the most frequent confusions, a recall that fell by more than ``drop``.

    ``latency`` are the columns of ``facts`` (one row) before and after; hint tables have label, pred and efficacy,
    recall tables class and recall. What one side lacks is not compared.
    """
    text = lambda *c: F.concat_ws(">", *[F.col(x).cast("string") for x in c])
    row = lambda rule, key: (F.lit(rule).alias("rule"), key.alias("key"), F.col("before").cast("double").alias("before"), F.col("after").cast("double").alias("after"))
    slow = facts.select(latency[0].alias("before"), latency[1].alias("after")).where(F.col("after") - F.col("before") > slower)
    top = confusion.where("label <> pred").orderBy(F.desc("n"), "label", "pred").limit(pairs).select("label", "pred")
    on = lambda df, n: df.select("label", "pred", F.col("efficacy").alias(n))
    helped = top.join(on(hints[0], "before"), ["label", "pred"]).join(on(hints[1], "after"), ["label", "pred"]).where(F.col("before") - F.col("after") > drop)
    fell = soft_gate(recalls[0], recalls[1], drop)
    return slow.select(*row("latency", F.lit(""))).unionByName(helped.select(*row("hint_efficacy", text("label", "pred")))).unionByName(fell.select(*row("recall", text("class"))))
