"""How the given tables stand in for attempts, catalogue, clips, boxes, trajectories and scores; the SQL views say the same for DuckDB."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(value: Column, digits: int) -> Column:
    """As DuckDB rounds a double: the scaled value to a whole number, half away from zero. Spark rounds the shortest decimal text of the unscaled value, which differs where that ends in a 5 and is not exact."""
    return F.round(value * float(10**digits)) / float(10**digits)


def rounded_size(value: Column, digits: int) -> Column:
    """``rounded`` of values that are not negative, without decimal texts: for very many rows."""
    scaled = value * float(10**digits)
    whole = F.rint(scaled)  # half to even
    return F.when(scaled - whole == 0.5, whole + 1.0).otherwise(whole) / float(10**digits)


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    return e.select("event_id", "user_id", (k % 20).alias("vocab_id"), F.col("ts").cast("timestamp").alias("submitted_at"), (F.col("event_type") != "error").alias("passed"), (F.floor("value").cast("long") % 20).alias("predicted"), (F.col("event_id") % 3).alias("model_id"))


ATTEMPTS = """attempts AS (
    SELECT event_id, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) % 20 AS vocab_id, ts AS submitted_at,
           event_type <> 'error' AS passed, CAST(floor(value) AS BIGINT) % 20 AS predicted, event_id % 3 AS model_id
    FROM events)"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue of the vocabulary that occurs in attempts: rank and category."""
    v = attempts(spark, sf_dir).select("vocab_id").distinct()
    return v.select("vocab_id", F.when(F.col("vocab_id") != 19, (F.col("vocab_id") * 7) % 20).alias("rank"), (F.col("vocab_id") % 4).alias("category"))


ITEMS = "items AS (SELECT vocab_id, CASE WHEN vocab_id <> 19 THEN vocab_id * 7 % 20 END AS rank, vocab_id % 4 AS category FROM (SELECT DISTINCT vocab_id FROM attempts))"

#: The fold of the attempts log, one step an attempt: the SQL twin of the scheduler's rules.
FOLD = """ordered AS (SELECT *, row_number() OVER (PARTITION BY user_id, vocab_id ORDER BY submitted_at, event_id) AS n FROM attempts),
fold AS (
    SELECT DISTINCT user_id, vocab_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS event_id, 'untouched' AS status, CAST(1.3 AS DOUBLE) AS ease, CAST(0 AS DOUBLE) AS interval_days,
           CAST(NULL AS TIMESTAMP) AS next_review_at, 0 AS consecutive_passes, 0 AS total_attempts, 0 AS total_passes, CAST(NULL AS TIMESTAMP) AS last_attempt_at
    FROM attempts
    UNION ALL
    SELECT user_id, vocab_id, n, event_id,
           CASE WHEN passed AND status = 'untouched' THEN 'learning' WHEN passed AND status = 'learning' AND streak >= 2 THEN 'reviewing'
                WHEN passed AND status = 'reviewing' AND grown >= 7 AND streak >= 3 THEN 'mastered'
                WHEN NOT passed AND status = 'mastered' THEN 'reviewing' WHEN NOT passed AND status = 'reviewing' THEN 'learning' ELSE status END,
           CASE WHEN NOT passed THEN ease_down WHEN status IN ('reviewing', 'mastered') THEN ease_up ELSE ease END,
           CASE WHEN NOT passed THEN interval_days * 0.3::DOUBLE WHEN status = 'untouched' THEN 0 WHEN status = 'learning' AND streak >= 2 THEN 1
                WHEN status IN ('reviewing', 'mastered') THEN grown ELSE interval_days END,
           CASE WHEN NOT passed AND status = 'untouched' THEN next_review_at
                WHEN NOT passed AND status = 'mastered' THEN moment + to_days(CAST(floor(CASE WHEN interval_days * 0.3::DOUBLE = 0 THEN 1 ELSE interval_days * 0.3::DOUBLE END + 0.5) AS INTEGER))
                WHEN NOT passed OR status = 'untouched' THEN moment WHEN status = 'learning' AND streak >= 2 THEN moment + to_days(1)
                WHEN status IN ('reviewing', 'mastered') THEN moment + to_days(CAST(floor(grown + 0.5) AS INTEGER)) ELSE next_review_at END,
           CASE WHEN NOT passed THEN 0 WHEN status = 'untouched' THEN 1 ELSE streak END,
           total_attempts + 1, total_passes + CAST(passed AS INTEGER), moment
    FROM (SELECT f.* EXCLUDE (n, event_id), o.n, o.event_id, o.passed, o.submitted_at AS moment, f.consecutive_passes + 1 AS streak,
                 least(2.5::DOUBLE, greatest(0.13::DOUBLE, f.ease + 0.1::DOUBLE)) AS ease_up, least(2.5::DOUBLE, greatest(0.13::DOUBLE, f.ease - 0.2::DOUBLE)) AS ease_down,
                 greatest(1::DOUBLE, f.interval_days * least(2.5::DOUBLE, greatest(0.13::DOUBLE, f.ease + 0.1::DOUBLE))) AS grown
          FROM fold f JOIN ordered o ON f.user_id = o.user_id AND f.vocab_id = o.vocab_id AND o.n = f.n + 1)),
states AS (SELECT * EXCLUDE (n, event_id) FROM fold QUALIFY row_number() OVER (PARTITION BY user_id, vocab_id ORDER BY n DESC) = 1)"""
STATES = f"{ATTEMPTS},\n{FOLD}"
CATALOG = f"""{STATES},
{ITEMS},
catalog AS (
    SELECT u.user_id, i.vocab_id, i.rank, i.category, coalesce(s.status, 'untouched') AS status, coalesce(s.ease, 1.3::DOUBLE) AS ease, coalesce(s.interval_days, 0::DOUBLE) AS interval_days,
           s.next_review_at, coalesce(s.consecutive_passes, 0) AS consecutive_passes, coalesce(s.total_attempts, 0) AS total_attempts, coalesce(s.total_passes, 0) AS total_passes, s.last_attempt_at
    FROM (SELECT DISTINCT user_id FROM attempts) u CROSS JOIN items i LEFT JOIN states s ON s.user_id = u.user_id AND s.vocab_id = i.vocab_id)"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per box: frame, a stable box number, corner, size, score and the frame's extent."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    return l.select(F.col("l_orderkey").alias("frame"), F.col("l_linenumber").cast("long").alias("box"), F.col("l_suppkey").alias("clip"), F.col("l_quantity").alias("x0"), (F.col("l_linenumber") * 10.0).alias("y0"), F.round(F.col("l_tax") * 1000, 0).alias("w"), F.round(F.col("l_discount") * 1000, 0).alias("h"), rounded(F.col("l_extendedprice") / 100000, 6).alias("score"))


BOXES = "boxes AS (SELECT l_orderkey AS frame, CAST(l_linenumber AS BIGINT) AS box, l_suppkey AS clip, l_quantity AS x0, l_linenumber * 10.0::DOUBLE AS y0, round(l_tax * 1000, 0) AS w, round(l_discount * 1000, 0) AS h, round(l_extendedprice / 100000, 6) AS score FROM lineitem)"


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clip manifest: clip_id, sign, signer, hash and position."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("clip_id"), F.col("lang").alias("sign"), F.col("source").alias("signer"), F.md5(F.col("text").cast("binary")).alias("hash"), "n_chars")


CLIPS = "clips AS (SELECT doc_id AS clip_id, lang AS sign, source AS signer, md5(text) AS hash, n_chars FROM documents)"


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item, label, class, distance): distance of each vector to each label's mean vector."""
    e = table(spark, sf_dir, "embeddings")
    mean = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    means = mean.groupBy(F.col("label").alias("class")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("mean"))
    d2 = F.aggregate(F.zip_with("embedding", "mean", lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, x: s + x)
    return e.crossJoin(means).select(F.col("vec_id").alias("item"), F.col("label").cast("long").alias("label"), F.col("class").cast("long").alias("class"), F.round(F.sqrt(d2), 6).alias("distance"))


SCORES = """flat AS (SELECT vec_id, label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
means AS (SELECT label AS class, i, avg(x) AS m FROM flat GROUP BY label, i),
scores AS (SELECT vec_id AS item, CAST(label AS BIGINT) AS label, CAST(class AS BIGINT) AS class, round(sqrt(sum((x - m) * (x - m))), 6) AS distance
           FROM flat JOIN means USING (i) GROUP BY vec_id, label, class)"""
