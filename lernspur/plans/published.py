"""What is published and who sees it: manifest summaries, nested templates and row policies over stand-ins."""

from __future__ import annotations

from pyspark.sql import functions as F

from lernspur.operators import policy
from lernspur.plans.views import ATTEMPTS, ITEMS, attempts, clips, items, table
from lernspur.sources import published as P


def manifest_summary(s, d):
    c = clips(s, d).select("clip_id", F.col("sign").alias("sign_id"), F.when(F.col("clip_id") % 5 == 0, "val").otherwise("train").alias("split"), "n_chars")
    skipped = c.where("n_chars < 300").select(F.when(F.col("n_chars") < 100, "very short").otherwise("short").alias("reason"))
    one = P.summarize(c.where("n_chars >= 300"), "v1", skipped, c.where("n_chars > 5000"))
    listed = lambda m: F.array_join(F.transform(F.map_entries(m), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return one.select("version", "n_records", "num_classes", F.array_join("classes", ",").alias("classes"), listed("split_counts").alias("split_counts"), listed("skipped").alias("skipped"), "dropped")


def shown(s, d):
    """Each vector is a template of four steps of 100 values, taken from its 64 in turn, every 13th missing."""
    value = lambda t, i: F.when(F.pmod(i, F.lit(13)) != F.col("vec_id") % 13, F.get("embedding", F.pmod(t * 7 + i, F.lit(64))).cast("double"))
    series = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda t: F.transform(F.sequence(F.lit(0), F.lit(99)), lambda i: value(t, i)))
    made = table(s, d, "embeddings").select(F.col("vec_id").alias("sign"), F.lit(9).alias("n_clips"), (F.col("label") == 3).alias("one_handed"), series.alias("mean"))
    steps = P.nested_templates(made).select("sign", "one_handed", F.posexplode("frames").alias("t", "f"))
    part = lambda name: steps.select("sign", "one_handed", "t", F.lit(name).alias("part"), F.posexplode(f"f.{name}").alias("point", "p"))
    points = part("hand0").unionByName(part("hand1")).unionByName(part("pose"))
    return points.select("sign", "one_handed", "t", "part", "point", F.get("p", F.lit(0)).alias("x"), F.get("p", F.lit(1)).alias("y"))


def seen_rows(s, d):
    a = attempts(s, d)
    tables = {"attempts": a, "mastery_state": a.select("user_id", "vocab_id").distinct(), "vocabulary_items": items(s, d), "model_versions": a.select("model_id").distinct().withColumn("is_active", F.col("model_id") == 1), "users": a.select(F.col("user_id").alias("id")).distinct(), "audit_log": a}
    keys = {"attempts": "event_id", "mastery_state": "vocab_id", "vocabulary_items": "vocab_id", "model_versions": "model_id", "users": "id"}
    out = None
    for name, df in policy.visible(tables, F.lit(7)).items():
        part = df.select(F.lit(name).alias("table_name"), F.col(keys[name]).alias("key"))
        out = part if out is None else out.unionByName(part)
    return out


QUERIES = {
    "manifest_summary": (manifest_summary, """WITH c AS (SELECT doc_id, lang, n_chars, CASE WHEN doc_id % 5 = 0 THEN 'val' ELSE 'train' END AS split FROM documents), r AS (SELECT * FROM c WHERE n_chars >= 300)
        SELECT 'v1' AS version, (SELECT count(*) FROM r) AS n_records, (SELECT count(DISTINCT lang) FROM r) AS num_classes, (SELECT string_agg(lang, ',' ORDER BY lang) FROM (SELECT DISTINCT lang FROM r WHERE lang IS NOT NULL)) AS classes,
               (SELECT string_agg(split || '=' || n, ',' ORDER BY split) FROM (SELECT split, count(*) AS n FROM r GROUP BY 1)) AS split_counts,
               (SELECT coalesce(string_agg(reason || '=' || n, ',' ORDER BY reason), '') FROM (SELECT CASE WHEN n_chars < 100 THEN 'very short' ELSE 'short' END AS reason, count(*) AS n FROM c WHERE n_chars < 300 GROUP BY 1)) AS skipped,
               (SELECT count(*) FROM c WHERE n_chars > 5000) AS dropped"""),
    "nested_templates": (shown, """WITH v AS (SELECT vec_id, label, t, i, CASE WHEN i % 13 <> vec_id % 13 THEN embedding[(t * 7 + i) % 64 + 1]::DOUBLE END AS v FROM embeddings, range(4) a(t), range(100) b(i)),
        s AS (SELECT vec_id, t, sqrt((max(v) FILTER (WHERE i = 88) - max(v) FILTER (WHERE i = 90)) ** 2 + (max(v) FILTER (WHERE i = 89) - max(v) FILTER (WHERE i = 91)) ** 2) AS s FROM v GROUP BY 1, 2),
        n AS (SELECT vec_id, coalesce(median(s) FILTER (WHERE s > 1e-3), 1) AS norm FROM s GROUP BY 1),
        p AS (SELECT vec_id, label, t, i // 2 AS k, max(v) FILTER (WHERE i % 2 = 0) AS x, max(v) FILTER (WHERE i % 2 = 1) AS y FROM v GROUP BY 1, 2, 3, 4)
        SELECT p.vec_id AS sign, label = 3 AS one_handed, CAST(t AS INTEGER) AS t, CASE WHEN k < 21 THEN 'hand0' WHEN k < 42 THEN 'hand1' ELSE 'pose' END AS part, CAST(CASE WHEN k < 21 THEN k WHEN k < 42 THEN k - 21 ELSE k - 42 END AS INTEGER) AS point,
               CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN round_even(x / norm, 4) END AS x, CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN round_even(y / norm, 4) END AS y FROM p JOIN n USING (vec_id)"""),
    "row_policy": (seen_rows, f"""WITH {ATTEMPTS}, {ITEMS} SELECT 'attempts' AS table_name, event_id AS key FROM attempts WHERE user_id = 7 UNION ALL SELECT 'mastery_state', vocab_id FROM (SELECT DISTINCT user_id, vocab_id FROM attempts WHERE user_id = 7)
        UNION ALL SELECT 'vocabulary_items', vocab_id FROM items UNION ALL SELECT 'model_versions', 1 FROM (SELECT 1 WHERE 1 IN (SELECT model_id FROM attempts)) UNION ALL SELECT DISTINCT 'users', user_id FROM attempts WHERE user_id = 7"""),
}
