"""Evaluation queries over the class scores that embeddings stand in for."""

from __future__ import annotations

from pyspark.sql import functions as F

from lernspur.operators import evaluation as E
from lernspur.plans.views import SCORES, scores


def _logits(s, d):
    return scores(s, d).withColumn("logit", -F.col("distance"))


def _preds(s, d):
    return E.predictions(_logits(s, d))


def _rounded(df, *cols, n=9):
    return df.withColumns({c: F.round(c, n) for c in cols})


def _bucket():
    return F.col("item") % 7


def gate(s, d):
    p = _preds(s, d)
    per = E.per_class(p)
    hints = E.confusion_matrix(p).where("label < pred")
    facts = E.topk_accuracy(p).select("top1", (F.col("top1") + 0.01).alias("previous_top1"))
    facts = facts.join(per.where("n > 0").agg(F.min("recall").alias("worst_recall"))).join(E.demographic_gap(p, _bucket()).select("gap"))
    facts = facts.join(E.precision_threshold(_logits(s, d)).agg(F.max("threshold").alias("max_threshold"))).join(E.expected_calibration_error(p))
    facts = facts.join(E.uncovered_confusions(E.confusion_matrix(p), hints).agg(F.count("*").alias("uncovered"))).withColumn("p95_ms", F.lit(None).cast("double")).withColumn("architecture", F.lit("tcn"))
    return _rounded(E.eval_gate(facts), "actual")


def thresholds(s, d):
    return E.distance_threshold(scores(s, d))


def slices(s, d):
    pairs = s.range(40).select((F.col("id") / 4).cast("long").alias("slice"), ((F.col("id") * 7 + F.floor(F.col("id") / 4)) % 10).alias("class")).distinct()
    return E.slice_eval(scores(s, d), pairs)


def lift(s, d):
    base, variant = _preds(s, d), E.predictions(_logits(s, d).withColumn("logit", F.when(F.col("class") == 3, F.col("logit") + 1).otherwise(F.col("logit"))))
    return E.ablation_lift(base, variant)


L = f"{SCORES}, logits AS (SELECT *, -distance AS logit, row_number() OVER (PARTITION BY item ORDER BY -distance DESC, class) AS rank FROM scores)"
P = f"{L}, ex AS (SELECT *, exp(logit - max(logit) OVER (PARTITION BY item)) AS e FROM logits), pr AS (SELECT *, e / sum(e) OVER (PARTITION BY item) AS prob FROM ex), preds AS (SELECT item, label, arg_min(class, rank) AS pred, max(rank) FILTER (WHERE class = label) AS true_rank, max(prob) AS top_prob, max(prob) FILTER (WHERE class = label) AS true_prob FROM pr GROUP BY 1, 2)"
PER = f"{P}, per AS (SELECT coalesce(a.c, b.c) AS class, coalesce(n, 0) AS n, coalesce(correct, 0) AS correct, coalesce(n_predicted, 0) AS n_predicted FROM (SELECT label AS c, count(*) AS n, count(*) FILTER (WHERE label = pred) AS correct FROM preds GROUP BY 1) a FULL JOIN (SELECT pred AS c, count(*) AS n_predicted FROM preds GROUP BY 1) b ON a.c = b.c), percl AS (SELECT *, CASE WHEN n > 0 THEN correct / n ELSE 0 END AS recall, CASE WHEN n > 0 THEN n_predicted / n WHEN n_predicted > 0 THEN 'inf'::DOUBLE ELSE 0 END AS magnet FROM per), conf AS (SELECT label, pred, count(*) AS n FROM preds GROUP BY 1, 2)"
ECE = "ece AS (SELECT sum(n * abs(a - c)) / sum(n) AS ece FROM (SELECT least(floor(top_prob * 10), 9) AS bin, count(*) AS n, avg(CAST(label = pred AS INTEGER)) AS a, avg(top_prob) AS c FROM preds GROUP BY 1))"
PT = "walk AS (SELECT class, prob, sum(CAST(class = label AS INTEGER)) OVER w AS tp, count(*) OVER w AS k FROM pr WINDOW w AS (PARTITION BY class ORDER BY prob DESC, item ROWS UNBOUNDED PRECEDING)), pt AS (SELECT class, coalesce(min(prob) FILTER (WHERE tp >= 1 AND tp / k >= 0.9::DOUBLE), 1) AS threshold FROM walk GROUP BY 1)"
GAP = "gap AS (SELECT count(*) AS buckets, CASE WHEN count(*) >= 2 THEN max(a) - min(a) END AS gap FROM (SELECT item % 7 AS b, count(*) AS n, avg(CAST(label = pred AS INTEGER)) AS a FROM preds GROUP BY 1) WHERE n >= 10)"
QUERIES = {
    "class_probabilities": (lambda s, d: _rounded(E.with_probability(_logits(s, d), 2.0).select("item", "class", "prob"), "prob"), f"WITH {L}, e AS (SELECT *, exp((logit - max(logit) OVER (PARTITION BY item)) / 2) AS e FROM logits) SELECT item, class, round(e / sum(e) OVER (PARTITION BY item), 9) AS prob FROM e"),
    "rank_classes": (lambda s, d: E.rank_classes(_logits(s, d)).select("item", "class", "rank"), f"WITH {L} SELECT item, class, rank FROM logits"),
    "predictions": (lambda s, d: _rounded(_preds(s, d), "top_prob", "true_prob"), f"WITH {P} SELECT item, label, pred, true_rank, round(top_prob, 9) AS top_prob, round(true_prob, 9) AS true_prob FROM preds"),
    "confusion_matrix": (lambda s, d: E.confusion_matrix(_preds(s, d)), f"WITH {PER} SELECT * FROM conf"),
    "confusion_sub": (lambda s, d: E.confusion_sub(_preds(s, d), [1, 3, 5]), f"WITH {P} SELECT label, CASE WHEN pred IN (1, 3, 5) THEN pred ELSE -1 END AS pred, count(*) AS n FROM preds WHERE label IN (1, 3, 5) GROUP BY 1, 2"),
    "topk_accuracy": (lambda s, d: E.topk_accuracy(_preds(s, d)), f"WITH {P} SELECT count(*) AS n, count(DISTINCT pred) AS predicted_classes, avg(CAST(true_rank <= 1 AS INTEGER)) AS top1, avg(CAST(true_rank <= 3 AS INTEGER)) AS top3, avg(CAST(true_rank <= 5 AS INTEGER)) AS top5 FROM preds"),
    "per_class": (lambda s, d: E.per_class(_preds(s, d)), f"WITH {PER} SELECT * FROM percl"),
    "per_source": (lambda s, d: E.per_source(_preds(s, d), F.col("item") % 5), f"WITH {P} SELECT item % 5 AS source, count(*) AS n, avg(CAST(label = pred AS INTEGER)) AS accuracy FROM preds GROUP BY 1"),
    "top_confusions": (lambda s, d: E.top_confusions(E.confusion_matrix(_preds(s, d)), 3), f"WITH {PER} SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, pred DESC) AS place FROM conf WHERE label <> pred QUALIFY place <= 3"),
    "best_worst": (lambda s, d: E.best_worst(E.per_class(_preds(s, d)), 3), f"WITH {PER} (SELECT 'worst' AS \"end\", class, recall FROM percl ORDER BY recall, class LIMIT 3) UNION ALL (SELECT 'best', class, recall FROM percl ORDER BY recall DESC, class LIMIT 3)"),
    "collapsed_classes": (lambda s, d: E.collapsed(E.per_class(_preds(s, d)), 1.0).select("class", "magnet"), f"WITH {PER} SELECT class, magnet FROM percl WHERE magnet > 1 ORDER BY magnet DESC, class LIMIT 10"),
    "wilson_intervals": (lambda s, d: _rounded(E.per_class(_preds(s, d)).withColumn("w", E.wilson(F.bround(F.col("recall") * F.col("n")), F.col("n"))).select("class", "w.low", "w.high"), "low", "high"), f"WITH {PER}, z AS (SELECT class, n::DOUBLE AS n, correct / n AS p, 1.959963984540054 ::DOUBLE AS z FROM percl WHERE n > 0) SELECT class, round(greatest(0, ((p + z * z / (2 * n)) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)), 9) AS low, round(least(1, ((p + z * z / (2 * n)) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)), 9) AS high FROM z"),
    "report_summary": (lambda s, d: E.report_summary(E.per_class(_preds(s, d))), f"WITH {PER} SELECT avg(recall) AS mean, list_sort(list(recall))[count(*) // 2 + 1] AS median, count(*) FILTER (WHERE recall < 0.6::DOUBLE) AS below FROM percl WHERE n > 0"),
    "confusion_share": (lambda s, d: E.confusion_share(E.confusion_matrix(_preds(s, d)), E.per_class(_preds(s, d))), f"WITH {PER} SELECT label, pred, conf.n, round_even(percl.n * (1 - recall), 0) AS errors, CASE WHEN errors > 0 THEN conf.n / errors ELSE 0 END AS share FROM conf JOIN percl ON label = class WHERE label <> pred ORDER BY conf.n DESC, label DESC, pred DESC LIMIT 15"),
    "nll": (lambda s, d: _rounded(E.nll(_logits(s, d)), "nll"), f"WITH {P} SELECT round(avg(-ln(prob + 1e-12)), 9) AS nll FROM pr WHERE class = label"),
    "fit_temperature_refined": (lambda s, d: _rounded(E.refine_temperature(_logits(s, d)), "temperature", "nll", n=7), None),
    "fit_temperature": (lambda s, d: _rounded(E.fit_temperature(_logits(s, d)), "temperature", "nll", n=7), f"WITH {L}, g AS (SELECT unnest(range(41)) * (9.9::DOUBLE / 40) + 0.1::DOUBLE AS t), x AS (SELECT item, label, class, logit - max(logit) OVER (PARTITION BY item) AS x FROM logits), i AS (SELECT item, t, ln(sum(exp(x / t))) AS lse, max(x) FILTER (WHERE class = label) AS x FROM x, g GROUP BY 1, 2), n AS (SELECT t, avg(-ln(exp(x / t - lse) + 1e-12)) AS nll FROM i GROUP BY 1) SELECT round(arg_min(t, nll), 7) AS temperature, round(min(nll), 7) AS nll FROM n"),
    "calibration_error": (lambda s, d: _rounded(E.expected_calibration_error(_preds(s, d)), "ece"), f"WITH {P}, {ECE} SELECT round(ece, 9) AS ece FROM ece"),
    "demographic_gap": (lambda s, d: E.demographic_gap(_preds(s, d), _bucket()), f"WITH {P}, {GAP} SELECT * FROM gap"),
    "precision_threshold": (lambda s, d: _rounded(E.precision_threshold(_logits(s, d)), "threshold"), f"WITH {P}, {PT} SELECT class, round(threshold, 9) AS threshold FROM pt"),
    "distance_threshold": (thresholds, f"WITH {SCORES}, u AS (SELECT *, CAST(class = label AS INTEGER) AS hit FROM (SELECT *, row_number() OVER (PARTITION BY class, label ORDER BY item) AS p FROM scores) WHERE class = label OR p <= 5), c AS (SELECT *, (sum(hit) OVER w) / (count(*) OVER w) AS pre FROM u WINDOW w AS (PARTITION BY class ORDER BY distance RANGE UNBOUNDED PRECEDING)), a AS (SELECT class, distance, pre FROM c WHERE hit = 1) SELECT class, coalesce(min(distance) FILTER (WHERE pre >= 0.95::DOUBLE), first(distance ORDER BY pre DESC, distance)) AS threshold, count(*) AS positives FROM a GROUP BY 1"),
    "score_quantiles": (lambda s, d: _rounded(E.score_quantiles(scores(s, d)), "q00", "q10", "q25", "q50", "q75", "q90", "q100", n=7), f"WITH {SCORES} SELECT class, " + ", ".join(f"round(quantile_cont(distance, {q}), 7) AS q{round(100 * q):02d}" for q in (0, 0.1, 0.25, 0.5, 0.75, 0.9, 1)) + " FROM scores WHERE class = label GROUP BY 1"),
    "pass_rule": (lambda s, d: _rounded(E.pass_rule(_preds(s, d)).select("item", "match", "passed"), "match"), f"WITH {P} SELECT item, round(true_prob / top_prob, 9) AS match, true_rank = 1 OR true_rank = 2 AND true_prob / top_prob >= 0.5::DOUBLE AS passed FROM preds"),
    "uncovered_confusions": (lambda s, d: E.uncovered_confusions(E.confusion_matrix(_preds(s, d)), E.confusion_matrix(_preds(s, d)).where("label < pred")), f"WITH {PER} SELECT * FROM conf WHERE label > pred AND n >= 2"),
    "slice_eval": (slices, f"WITH {SCORES}, sl AS (SELECT DISTINCT i // 4 AS slice, (i * 7 + i // 4) % 10 AS class FROM (SELECT unnest(range(40)) AS i)), b AS (SELECT a.slice, item, label, first(a.class ORDER BY distance, a.class) AS pred FROM scores s JOIN sl a ON a.class = s.class JOIN sl b ON b.slice = a.slice AND b.class = s.label GROUP BY 1, 2, 3) SELECT slice, count(*) AS n, avg(CAST(label = pred AS INTEGER)) AS top1 FROM b GROUP BY 1"),
    "ablation_lift": (lift, f"WITH {L}, v AS (SELECT item, label, first(class ORDER BY logit + CAST(class = 3 AS INTEGER) DESC, class) AS pred, first(class ORDER BY logit DESC, class) AS base FROM logits GROUP BY 1, 2), h AS (SELECT CAST(label = base AS INTEGER) AS b, CAST(label = pred AS INTEGER) AS v FROM v) SELECT avg(b) AS base, avg(v) AS variant, avg(v) - avg(b) AS lift, count(*) FILTER (WHERE v > b) AS won, count(*) FILTER (WHERE v < b) AS lost FROM h"),
    "eval_gate": (gate, f"""WITH {PER}, {ECE}, {PT}, {GAP}, f AS (SELECT (SELECT avg(CAST(label = pred AS INTEGER)) FROM preds) AS top1, (SELECT min(recall) FROM percl WHERE n > 0) AS worst, (SELECT gap FROM gap) AS gap, (SELECT max(threshold) FROM pt) AS thr, (SELECT ece FROM ece) AS ece, (SELECT count(*) FROM conf WHERE label > pred AND n >= 2) AS unc),
        r AS (SELECT 1 AS i, 'top1' AS rule, coalesce(top1, 0) AS actual, coalesce(top1, 0) >= 0.85::DOUBLE AS ok, 'at least 0.85' AS detail FROM f UNION ALL SELECT 2, 'per_sign', worst, worst IS NULL OR worst >= 0.6::DOUBLE, 'at least 0.60 for every class' FROM f UNION ALL SELECT 3, 'demographic_gap', gap, gap <= 0.1::DOUBLE, 'at most 0.10' FROM f
              UNION ALL SELECT 4, 'thresholds', thr, thr IS NOT NULL AND thr < 1, 'all below 1' FROM f UNION ALL SELECT 5, 'latency', NULL, NULL, 'at most 600 ms' UNION ALL SELECT 6, 'regression', top1 + 0.01::DOUBLE - coalesce(top1, 0), true, 'at most 0.03 below the model before' FROM f UNION ALL SELECT 7, 'calibration', ece, ece <= 0.05::DOUBLE, 'at most 0.05' FROM f
              UNION ALL SELECT 8, 'hint_coverage', unc, unc = 0, 'no repeated confusion without a hint' FROM f UNION ALL SELECT 9, 'architecture', NULL, true, 'trained from scratch')
        SELECT rule, round(actual, 9) AS actual, CASE WHEN ok IS NULL THEN 'SKIP' WHEN ok THEN 'PASS' ELSE 'FAIL' END AS verdict, detail FROM r UNION ALL SELECT 'overall', NULL, CASE WHEN bool_or(NOT ok) THEN 'FAIL' ELSE 'PASS' END, coalesce(string_agg(rule, ', ' ORDER BY i) FILTER (WHERE NOT ok), '') FROM r"""),
    "pass_threshold": (lambda s, d: E.pass_threshold(_preds(s, d), E.precision_threshold(_logits(s, d)).where("class <> 4")).select("item", "passed"), f"WITH {P}, {PT} SELECT item, pred = label AND top_prob >= coalesce(threshold, 0.5) AS passed FROM preds LEFT JOIN (SELECT * FROM pt WHERE class <> 4) q ON q.class = label"),
    "latency_p95": (lambda s, d: E.latency_p95(scores(s, d), "distance").withColumn("p95_ms", F.round("p95_ms", 7)), f"WITH {SCORES} SELECT round(quantile_cont(distance, 0.95), 7) AS p95_ms FROM scores"),
    "soft_gate": (lambda s, d: E.soft_gate(E.per_class(_preds(s, d)), E.per_class(_preds(s, d).where("item % 3 <> 0"))), f"WITH {PER}, b AS (SELECT label AS class, avg(CAST(label = pred AS INTEGER)) AS r FROM preds WHERE item % 3 <> 0 GROUP BY 1) SELECT class, recall AS before, r AS after FROM percl JOIN b USING (class) WHERE recall - r > 0.05::DOUBLE"),
}
