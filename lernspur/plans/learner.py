"""Learner queries over the attempts that events stand in for."""

from __future__ import annotations

from pyspark.sql import functions as F

from lernspur.functions import scheduler as S
from lernspur.operators import learner as L
from lernspur.plans.views import ATTEMPTS, CATALOG, ITEMS, STATES, attempts, items, table

NOW_SQL = "TIMESTAMP '2024-02-01 00:00:00'"


def now():
    return F.lit("2024-02-01 00:00:00").cast("timestamp")


def _catalog(spark, d):
    a = attempts(spark, d)
    return L.catalog_with_state(a, items(spark, d), L.mastery_fold(a))


def next_item(spark, d):
    a = attempts(spark, d)
    return L.pick_next(_catalog(spark, d), L.latest_pass_rate(a), now()).select("user_id", "vocab_id", "status", "pass_rate", "reason")


def inactive(spark, d):
    users = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.lit("2023-12-20 00:00:00").cast("timestamp").alias("created_at"))
    return L.inactive_accounts(users, attempts(spark, d), now()).select("user_id", "seen_at")


def update_guard(spark, d):
    old = attempts(spark, d).select("event_id", "predicted", "passed")
    new = old.select("event_id", F.when(F.col("event_id") % 97 == 0, None).otherwise(F.col("predicted")).alias("predicted"), F.when(F.col("event_id") % 89 == 0, False).otherwise(F.col("passed")).alias("passed"))
    return L.check_update_guard(old, new, "event_id", "passed")


def constraints(spark, d):
    o = table(spark, d, "orders")
    parents = {"o_custkey": table(spark, d, "customer").select("c_custkey")}
    return L.check_constraints(o, ["o_custkey", "o_orderdate"], {"o_orderstatus": ["O", "F"]}, parents)


def upserted(spark, d, keep):
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    target = c.where("c_custkey % 2 = 0")
    updates = c.where("c_custkey % 3 = 0").withColumn("c_acctbal", F.lit(0.0))
    return L.upsert(target, updates, ["c_custkey"], keep)


def history(spark, d):
    return L.mastery_history(attempts(spark, d))


def curves(spark, d):
    s = L.mastery_fold(attempts(spark, d))
    c = s.withColumn("curve", S.retention_curve(F.col("interval_days"), F.col("status")))
    return c.select("user_id", "vocab_id", F.posexplode("curve").alias("i", "retention")).withColumn("retention", F.round("retention", 9))


RATE = "rate AS (SELECT user_id, avg(CAST(passed AS INTEGER)) AS pass_rate FROM (SELECT * FROM attempts QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY submitted_at DESC, event_id DESC) <= 10) GROUP BY user_id)"
QUERIES = {
    "mastery_fold": (lambda s, d: L.mastery_fold(attempts(s, d)), f"WITH RECURSIVE {STATES} SELECT * FROM states"),
    "catalog_with_state": (_catalog, f"WITH RECURSIVE {CATALOG} SELECT * FROM catalog"),
    "next_item": (next_item, f"""WITH RECURSIVE {CATALOG}, {RATE},
        r AS (SELECT user_id, vocab_id, status, pass_rate, rank, next_review_at,
            CASE WHEN status <> 'untouched' AND next_review_at <= {NOW_SQL} THEN 0 WHEN coalesce(pass_rate, 1) < 0.7 AND status = 'learning' THEN 1 WHEN status = 'untouched' THEN 2 WHEN status = 'learning' THEN 3 END AS reason
            FROM catalog LEFT JOIN rate USING (user_id))
        SELECT user_id, vocab_id, status, pass_rate, reason FROM r WHERE reason IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY reason, CASE WHEN reason = 0 THEN next_review_at END NULLS LAST, rank NULLS LAST, vocab_id) = 1"""),
    "rolling_pass_rate": (lambda s, d: L.rolling_pass_rate(attempts(s, d)).select("event_id", "pass_rate"), f"WITH {ATTEMPTS} SELECT event_id, avg(CAST(passed AS INTEGER)) OVER (PARTITION BY user_id ORDER BY submitted_at, event_id ROWS 9 PRECEDING) AS pass_rate FROM attempts"),
    "progression": (lambda s, d: L.progression(_catalog(s, d)).select("user_id", "vocab_id", "stage", "is_open"), f"""WITH RECURSIVE {CATALOG},
        o AS (SELECT *, sum(CAST(status NOT IN ('mastered', 'reviewing') AS INTEGER)) OVER (PARTITION BY user_id ORDER BY rank NULLS LAST, vocab_id) AS open FROM catalog),
        t AS (SELECT user_id, vocab_id, CASE WHEN status = 'mastered' THEN 'mastered' WHEN status = 'reviewing' THEN 'unlocked' WHEN open = 1 THEN 'current' ELSE 'locked' END AS stage FROM o)
        SELECT *, stage <> 'locked' AS is_open FROM t"""),
    "status_counts": (lambda s, d: L.status_counts(_catalog(s, d)), f"WITH RECURSIVE {CATALOG} SELECT user_id, {', '.join(f'''count(*) FILTER (WHERE status = '{x}') AS {x}''' for x in ('untouched', 'learning', 'reviewing', 'mastered'))}, count(*) AS total FROM catalog GROUP BY user_id"),
    "dashboard_order": (lambda s, d: L.dashboard_order(_catalog(s, d)).select("user_id", "vocab_id", "position"), f"WITH RECURSIVE {CATALOG} SELECT user_id, vocab_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE status WHEN 'learning' THEN 0 WHEN 'reviewing' THEN 1 WHEN 'untouched' THEN 2 ELSE 3 END, vocab_id) AS position FROM catalog"),
    "retention_curve": (curves, f"WITH RECURSIVE {STATES}, n AS (SELECT CAST(unnest(range(16)) AS INTEGER) AS i) SELECT user_id, vocab_id, i, round(exp(-(i * 2.0::DOUBLE) / greatest(1, CASE WHEN interval_days = 0 THEN 1 ELSE interval_days END)), 9) AS retention FROM states, n WHERE status <> 'untouched'"),
    "mastery_history": (history, f"WITH RECURSIVE {STATES} SELECT user_id, vocab_id, event_id, last_attempt_at AS submitted_at, status, ease, interval_days, next_review_at, consecutive_passes, total_attempts, total_passes, last_attempt_at FROM fold WHERE n > 0"),
    "time_to_mastery": (lambda s, d: L.time_to_mastery(history(s, d)), f"WITH RECURSIVE {STATES} SELECT user_id, vocab_id, epoch_us(min(last_attempt_at) FILTER (WHERE status = 'mastered')) - epoch_us(min(last_attempt_at)) AS micros FROM fold WHERE n > 0 GROUP BY user_id, vocab_id HAVING micros IS NOT NULL"),
    "hint_efficacy": (lambda s, d: L.hint_efficacy(attempts(s, d)), f"WITH {ATTEMPTS}, n AS (SELECT *, lead(passed) OVER (PARTITION BY user_id, vocab_id ORDER BY submitted_at, event_id) AS nx FROM attempts) SELECT vocab_id, predicted, count(*) AS n, avg(CAST(nx AS INTEGER)) AS efficacy FROM n WHERE NOT passed AND nx IS NOT NULL GROUP BY 1, 2"),
    "next_in_rank": (lambda s, d: L.next_in_rank(items(s, d)), f"WITH {ATTEMPTS}, {ITEMS} SELECT *, lead(vocab_id) OVER (PARTITION BY category ORDER BY rank NULLS LAST, vocab_id) AS next_vocab FROM items"),
    "consecutive_fails": (lambda s, d: L.consecutive_fails(attempts(s, d)).select("event_id", "fails", "skip_offered"), f"""WITH {ATTEMPTS}, i AS (SELECT *, sum(CAST(passed AS INTEGER)) OVER (PARTITION BY user_id, vocab_id ORDER BY submitted_at, event_id) AS island FROM attempts)
        SELECT event_id, CAST(sum(CAST(NOT passed AS INTEGER)) OVER (PARTITION BY user_id, vocab_id, island ORDER BY submitted_at, event_id) AS BIGINT) AS fails, sum(CAST(NOT passed AS INTEGER)) OVER (PARTITION BY user_id, vocab_id, island ORDER BY submitted_at, event_id) >= 3 AS skip_offered FROM i"""),
    "forgetting_rate": (lambda s, d: L.forgetting_rate(attempts(s, d)), f"WITH {ATTEMPTS}, g AS (SELECT passed, date_diff('day', lag(submitted_at) OVER (PARTITION BY user_id, vocab_id ORDER BY submitted_at, event_id), submitted_at) AS gap FROM attempts) SELECT CASE WHEN gap < 1 THEN 0 WHEN gap < 3 THEN 1 WHEN gap < 7 THEN 2 ELSE 3 END AS bucket, count(*) AS n, avg(CAST(passed AS INTEGER)) AS pass_rate FROM g WHERE gap IS NOT NULL GROUP BY 1"),
    "inactive_accounts": (inactive, f"WITH {ATTEMPTS}, l AS (SELECT user_id, max(submitted_at) AS last_at FROM attempts GROUP BY 1) SELECT c_custkey AS user_id, coalesce(last_at, TIMESTAMP '2023-12-20') AS seen_at FROM customer LEFT JOIN l ON user_id = c_custkey WHERE coalesce(last_at, TIMESTAMP '2023-12-20') < {NOW_SQL} - INTERVAL 30 DAY"),
    "update_guard": (update_guard, f"WITH {ATTEMPTS} SELECT event_id FROM attempts WHERE event_id % 97 = 0 AND predicted IS NOT NULL OR event_id % 89 = 0 AND passed"),
    "constraint_checks": (constraints, "SELECT 'unique' AS rule, count(*) AS violations FROM (SELECT 1 FROM orders GROUP BY o_custkey, o_orderdate HAVING count(*) > 1) UNION ALL SELECT 'domain o_orderstatus', count(*) FROM orders WHERE o_orderstatus NOT IN ('O', 'F') UNION ALL SELECT 'orphan o_custkey', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)"),
    "upsert_replace": (lambda s, d: upserted(s, d, False), "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0"),
    "upsert_keep": (lambda s, d: upserted(s, d, True), "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal ELSE 0 END AS c_acctbal FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0"),
    "promote_model": (lambda s, d: L.promote(table(s, d, "supplier").select(F.col("s_suppkey").alias("model_id"), (F.col("s_suppkey") == 1).alias("is_active")), F.lit(7)), "SELECT s_suppkey AS model_id, s_suppkey = 7 AS is_active FROM supplier"),
    "rollback_signals": (lambda s, d: L.rollback_signals(attempts(s, d)), f"WITH {ATTEMPTS}, t AS (SELECT model_id, CAST(submitted_at AS DATE) AS day, count(*) AS n, avg(CAST(passed AS INTEGER)) AS pass_rate FROM attempts GROUP BY 1, 2) SELECT *, pass_rate - lag(pass_rate) OVER (PARTITION BY model_id ORDER BY day) AS change FROM t"),
}
