"""Queries of landmark reports, geometry and curation helpers over the star tables, embeddings and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from lernspur.operators import landmarks as L
from lernspur.operators import trajectory as T
from lernspur.plans.trajectory import FLAT, _long, trajs
from lernspur.plans.views import table


def frames(s, d):
    """Frames of clips by source: an order is a frame, a supplier a clip; hands are its lines with some discount."""
    l = table(s, d, "lineitem")  # noqa: E741
    return l.groupBy(F.col("l_returnflag").alias("source"), F.col("l_suppkey").alias("clip"), F.col("l_orderkey").alias("frame")).agg(F.count_if(F.col("l_discount") > 0.05).alias("hands"), F.max(F.col("l_tax") > 0.02).alias("has_pose"))


FRAMES = "frames AS (SELECT l_returnflag AS source, l_suppkey AS clip, l_orderkey AS frame, count(*) FILTER (WHERE l_discount > 0.05) AS hands, bool_or(l_tax > 0.02) AS has_pose FROM lineitem GROUP BY 1, 2, 3)"


def dense(s, d):
    return L.settled(trajs(s, d).withColumn("traj", T.to_dense(F.col("traj"))), "traj")


def misses(s, d):
    l = table(s, d, "lineitem")  # noqa: E741
    return L.fail_histogram(l.select((F.col("l_quantity") / 50).alias("position"), (F.col("l_discount") * 2).alias("confidence"), (F.col("l_tax") < 0.04).alias("missed")))


def errors(s, d):
    l = table(s, d, "lineitem")  # noqa: E741
    return L.keypoint_error(l.select(F.col("l_returnflag").alias("source"), F.col("l_linenumber").alias("keypoint"), F.floor(F.col("l_extendedprice")).alias("err"), (F.col("l_tax") > 0.03).cast("int").alias("vis"))).select("source", F.round("pooled", 6).alias("pooled"), F.round("by_keypoint", 6).alias("by_keypoint"))


def depths(s, d):
    return trajs(s, d).select("sign", "clip", F.posexplode("traj").alias("t", "values"))


def noise(s, d):
    return L.signal_noise(depths(s, d)).select("sign", *[F.round(c, 7).alias(c) for c in ("valid", "spread", "step", "ratio")], "usable")


def hits(s, d):
    l = table(s, d, "lineitem")  # noqa: E741
    known = F.when(F.col("l_orderkey") % 7 > 0, F.col("l_quantity")).alias("l_quantity")
    return L.first_seen_ids(l.select("l_suppkey", "l_partkey", "l_linenumber", "l_orderkey", known), "l_suppkey", "l_partkey", ["l_linenumber", "l_orderkey"], "l_quantity", 30, 5)


def mixed(s, d):
    o = table(s, d, "orders")
    return L.subsample_mix(o.where("o_orderpriority = '1-URGENT'").select("o_orderkey"), o.where("o_orderpriority = '5-LOW'").select("o_orderkey"), "o_orderkey", 300)


def variants(s, d):
    p = table(s, d, "part")
    vocab = p.where("p_size < 15").select(F.lower("p_type").alias("slug")).distinct()
    return L.resolve_gloss_variant(p.select("p_partkey", F.when(F.col("p_partkey") % 7 == 0, F.concat("p_type", F.lit(". 1"))).otherwise(F.concat(F.upper("p_type"), F.lit("2"))).alias("gloss")), "gloss", vocab)


def files(s, d):
    pages = table(s, d, "pages")
    path = F.split_part("url", F.lit("?"), F.lit(1))
    wanted = pages.select("page_id", F.upper(F.when(F.col("page_id") % 3 != 0, F.substring_index(path, "/", -1)).otherwise(F.lit("none.mp4"))).alias("file"))
    return L.attach_files(wanted, "file", pages.select(path.alias("path")))


def lexicon(s, d):
    p = table(s, d, "part").select(F.col("p_partkey").alias("k"), "p_brand", "p_type", "p_size", "p_name")
    codes = lambda m: p.where(F.col("k") % m == 0)
    entries = table(s, d, "lineitem").where("l_partkey % 4 <> 1").select(F.col("l_partkey").alias("entry"), F.concat(F.lit("L"), F.col("l_suppkey")).alias("code"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("position"))
    return L.resolve_lexicon(p.select("k"), "k", codes(5).select("k", F.col("p_brand").alias("code")), codes(3).select("k", F.col("p_name").alias("code")), entries)


def unlike(s, d):
    p = table(s, d, "part")
    pairs = p.select(F.col("p_partkey").alias("target"), (F.col("p_partkey") + 1).alias("predicted"))
    return L.feature_lexicon_diff(pairs, p, "p_partkey", ["p_type", "p_brand", "p_name", "p_size"])


def shown(s, d):
    e = table(s, d, "events")
    return e.select("event_id", L.choose_hint(F.col("event_type") != "error", F.when(F.col("event_id") % 3 > 0, F.concat(F.lit("hint "), F.col("event_id") % 20)), "Look at the reference again.").alias("h")).select("event_id", "h.*")


def windows(s, d):
    l = table(s, d, "lineitem")  # noqa: E741
    w = L.lead_window(F.when(F.col("l_linenumber") > 1, F.col("l_quantity").cast("int") - 20), F.when(F.col("l_orderkey") % 3 > 0, F.col("l_quantity").cast("int")))
    return l.select("l_orderkey", "l_linenumber", w.alias("w")).select("l_orderkey", "l_linenumber", "w.*")


def indices(s, d):
    return table(s, d, "part").select("p_partkey", F.array_join(L.even_indices(F.col("p_size"), 16), ",").alias("picked"))


def sampled(s, d):
    return L.frame_index(table(s, d, "part").select("p_partkey", "p_size"), "p_size", 8.0, 12)


def faces(s, d):
    l = table(s, d, "lineitem")  # noqa: E741
    box = L.body_box_from_face(F.col("l_quantity") * 5, F.col("l_linenumber") * 20.0, F.col("l_quantity") * 5 + F.round(F.col("l_discount") * 400), F.col("l_linenumber") * 20.0 + F.round(F.col("l_tax") * 500), F.lit(320), F.lit(240))
    return l.select("l_orderkey", "l_linenumber", box.alias("b")).where("b IS NOT NULL").select("l_orderkey", "l_linenumber", "b.*")


def crops(s, d):
    l = table(s, d, "lineitem")  # noqa: E741
    box = [F.col("l_quantity"), F.col("l_linenumber") * 10.0, F.col("l_quantity") + F.round(F.col("l_tax") * 1000), F.col("l_linenumber") * 10.0 + F.round(F.col("l_discount") * 1000)]
    return l.select("l_orderkey", "l_linenumber", L.crop_box(L.scale_box(box, F.lit(2.0), F.lit(1.5)), F.lit(200), F.lit(150)).alias("c")).where("c IS NOT NULL").select("l_orderkey", "l_linenumber", "c.*")


def points(s, d):
    """21 points of three values from each embedding, pushed away from the camera."""
    e = F.transform("embedding", lambda v: v.cast("double"))
    return table(s, d, "embeddings").select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: F.array(F.get(e, i * 3), F.get(e, i * 3 + 1), F.get(e, i * 3 + 2) + 4)).alias("xyz")).transform(L.settled, "xyz")


POINTS = "pts AS (SELECT vec_id, i, embedding[i * 3 + 1]::DOUBLE AS x, embedding[i * 3 + 2]::DOUBLE AS y, embedding[i * 3 + 3]::DOUBLE + 4 AS z FROM embeddings, (SELECT unnest(range(21)) AS i))"


def projected(s, d):
    return points(s, d).select("vec_id", F.posexplode(L.project(F.col("xyz"), 480.0, 480.0, 112.0, 112.0)).alias("i", "p")).select("vec_id", "i", F.round(F.col("p")[0], 6).alias("u"), F.round(F.col("p")[1], 6).alias("v"))


def relative(s, d):
    return points(s, d).select("vec_id", F.posexplode(L.relative_depth(F.col("xyz"))).alias("i", "z")).select("vec_id", "i", F.round("z", 7).alias("z"))


def bodies(s, d):
    return points(s, d).select("vec_id", F.posexplode(L.body_space(F.col("xyz"), 0, 5, 17)).alias("i", "p")).select("vec_id", "i", *[F.round(F.col("p")[k], 6).alias(n) for k, n in enumerate(("x", "y", "z"))])


def hashes(s, d):
    pixels = table(s, d, "embeddings").select("vec_id", F.transform("embedding", lambda v: F.floor(v.cast("double") * 1000).cast("double")).alias("pixels"))
    return L.average_hash(pixels, "pixels").select("vec_id", "hash")


def widened(s, d):
    """Steps of 8 features as two hands of three and a pose of two, each hand followed by two zeros."""
    return _long(trajs(s, d).withColumn("traj", L.widen(F.col("traj"), [(0, 3), 2, (3, 3), 2, (6, 2)])))


def instances(s, d):
    l = table(s, d, "lineitem")  # noqa: E741
    one = F.struct(F.when(F.col("l_tax") > 0.02, F.array(F.col("l_quantity"), F.col("l_quantity"), F.col("l_discount"), F.col("l_tax"))).alias("bbox"), F.array_repeat(F.col("l_quantity"), F.col("l_linenumber").cast("int")).alias("keypoints"), F.array_repeat(F.col("l_tax"), F.pmod(F.col("l_suppkey"), F.lit(5)).cast("int")).alias("depth"))
    labels = l.groupBy("l_orderkey").agg(F.collect_list(one).alias("hands"))
    return L.valid_instances(labels, "hands", 3).select("l_orderkey", F.element_at("keypoints", 1).alias("x"), F.coalesce(F.size("depth"), F.lit(-1)).alias("depths"))


def passing(s, d):
    l = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")
    t = table(s, d, "supplier").where("s_suppkey % 3 > 0").select(F.col("s_suppkey").alias("l_suppkey"), F.when(F.col("s_suppkey") % 5 > 0, F.pmod(F.col("s_suppkey"), F.lit(50)).cast("double")).otherwise(F.lit(float("nan"))).alias("threshold"))
    return L.threshold_lookup(l, t, "l_suppkey").select("l_orderkey", "l_linenumber", (F.col("l_quantity") <= F.col("threshold")).alias("passed"))


def profiles(s, d):
    u = table(s, d, "customer").select("c_custkey", F.when(F.col("c_nationkey") % 2 == 0, "right").otherwise("left").alias("handedness"), F.lit(None).cast("int").alias("skin_type"), F.lit(None).cast("timestamp").alias("onboarded_at"))
    return L.update_profile(u, "c_custkey", F.lit(7), "left", 3, F.lit("2026-01-01 00:00:00").cast("timestamp"))


def exported(s, d):
    tables = {"users": (table(s, d, "customer").select("c_custkey", "c_nationkey"), "c_custkey"), "attempts": (table(s, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey")}
    return L.export_account(tables, F.lit(7))


def deleted(s, d):
    tables = {"users": (table(s, d, "customer").select("c_custkey"), "c_custkey"), "attempts": (table(s, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey")}
    left, _ = L.delete_account(tables, F.lit(7), F.lit("2026-01-01 00:00:00").cast("timestamp"))
    return left["attempts"].groupBy().agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys")).withColumn("table", F.lit("attempts")).unionByName(left["users"].groupBy().agg(F.count("*").alias("n"), F.sum("c_custkey").alias("keys")).withColumn("table", F.lit("users")))


def urls(s, d):
    p = table(s, d, "part")
    slug = F.regexp_replace(F.lower("p_type"), " ", "_")
    aliases = p.where("p_size = 1").select(slug.alias("slug"), F.lower("p_brand").alias("alias"))
    return L.candidate_urls(p.select(slug.alias("s")).distinct(), "s", aliases, "https://example.org/sign/")


def named(s, d):
    name = F.concat(F.lit("/data/"), F.col("o_orderstatus"), F.lit("_x__"), F.col("o_custkey"), F.lit("_fa_f"), F.col("o_orderkey"), F.lit(".jpg"))
    return table(s, d, "orders").select("o_orderkey", L.name_parts(name).alias("p")).select("o_orderkey", "p.*")


def ranked(s, d):
    p = table(s, d, "part").select("p_partkey", "p_size", "p_brand", "p_type", "p_retailprice", "p_name", F.when(F.col("p_size") % 4 > 0, F.col("p_size")).alias("lesson"))
    return L.difficulty_rank(p.withColumn("gloss", F.concat_ws(" ", "p_name", "p_partkey")), "lesson", "p_brand", "p_retailprice", "p_type", "gloss").select("p_partkey", "difficulty_rank")


def fields(s, d):
    from pyspark.sql.types import LongType, StructField, StructType

    k = F.from_json("props", StructType([StructField("k", LongType())]))["k"]
    return table(s, d, "events").select("event_id", k.alias("k"), F.get_json_object("props", "$.none").alias("missing"))


def downloaded(s, d):
    o = table(s, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "O", "ok").otherwise("failed").alias("status"), F.when(F.col("o_orderkey") % 4 > 0, F.lit("x.mp4")).alias("path"))
    return L.status_filter(o).select("o_orderkey")


_BASE = "regexp_extract(split_part(url, '?', 1), '[^/]*$')"
_K = 9
_KERNEL = f"kern AS (SELECT k, exp(-0.5 * (k / 2.2::DOUBLE) * (k / 2.2::DOUBLE)) / (SELECT sum(exp(-0.5 * (j / 2.2::DOUBLE) * (j / 2.2::DOUBLE))) FROM range(-{_K}, {_K + 1}) r(j)) AS w FROM range(-{_K}, {_K + 1}) r(k))"
QUERIES = {
    "landmark_coverage": (lambda s, d: L.landmark_coverage(frames(s, d)), f"""WITH {FRAMES}, per AS (SELECT source, clip, count(*) AS frames, sum(hands) AS hands, count(*) FILTER (WHERE hands = 0) AS n0, count(*) FILTER (WHERE hands = 1) AS n1, count(*) FILTER (WHERE hands >= 2) AS n2, bool_or(has_pose) AS pose FROM frames GROUP BY 1, 2)
        SELECT source, count(*) AS clips, sum(frames)::BIGINT AS frames, round(sum(hands) / sum(frames), 4) AS hands_per_frame, round(100.0::DOUBLE * sum(n0) / sum(frames), 2) AS pct_0, round(100.0::DOUBLE * sum(n1) / sum(frames), 2) AS pct_1, round(100.0::DOUBLE * sum(n2) / sum(frames), 2) AS pct_2,
               round(100.0::DOUBLE * count(*) FILTER (WHERE n0 > 0) / count(*), 2) AS pct_any_empty, round(100.0::DOUBLE * count(*) FILTER (WHERE n0 = frames) / count(*), 2) AS pct_all_empty, round(100.0::DOUBLE * count(*) FILTER (WHERE NOT pose) / count(*), 2) AS pct_no_pose FROM per GROUP BY 1"""),
    "fail_histogram": (misses, "SELECT CASE WHEN l_quantity / 50 < 0.33 THEN 'start' WHEN l_quantity / 50 > 0.67 THEN 'end' ELSE 'middle' END AS third, CASE WHEN l_discount * 2 < 0.05 THEN '<0.05' WHEN l_discount * 2 < 0.10 THEN '<0.10' WHEN l_discount * 2 < 0.15 THEN '<0.15' ELSE '>=0.15' END AS confidence, count(*) AS n FROM lineitem WHERE l_tax < 0.04 GROUP BY 1, 2"),
    "recall_by_source": (lambda s, d: L.recall_by_source(frames(s, d)), f"""WITH {FRAMES}, a AS (SELECT *, coalesce(frame BETWEEN min(frame) FILTER (WHERE hands > 0) OVER (PARTITION BY clip) AND max(frame) FILTER (WHERE hands > 0) OVER (PARTITION BY clip), false) AS inside FROM frames)
        SELECT source, round(sum(hands) / count(*), 4) AS hands_per_frame, round(100.0::DOUBLE * count(*) FILTER (WHERE hands = 0) / count(*), 2) AS pct_zero, round(coalesce(sum(hands) FILTER (WHERE inside), 0) / greatest(count(*) FILTER (WHERE inside), 1), 4) AS hands_inside, round(100.0::DOUBLE * count(*) FILTER (WHERE inside AND hands = 0) / greatest(count(*) FILTER (WHERE inside), 1), 2) AS pct_zero_inside FROM a GROUP BY 1"""),
    "keypoint_error": (errors, "WITH p AS (SELECT l_returnflag AS source, l_linenumber AS k, sum(CASE WHEN l_tax > 0.03 THEN floor(l_extendedprice) ELSE 0 END) AS e, count(*) FILTER (WHERE l_tax > 0.03) AS n FROM lineitem GROUP BY 1, 2) SELECT source, round(sum(e) / sum(n), 6) AS pooled, round(avg(e / greatest(n, 1)), 6) AS by_keypoint FROM p GROUP BY 1"),
    "signal_noise": (noise, f"""WITH {FLAT}, st AS (SELECT clip, sign, t, count(v) = 8 AS whole, stddev_pop(v) AS spread FROM lng GROUP BY 1, 2, 3), pr AS (SELECT clip, t, lag(t) OVER (PARTITION BY clip ORDER BY t) AS was FROM st WHERE whole),
        sp AS (SELECT a.clip, a.t, avg(abs(a.v - b.v)) AS step FROM pr JOIN lng a ON a.clip = pr.clip AND a.t = pr.t JOIN lng b ON b.clip = pr.clip AND b.t = pr.was AND b.f = a.f GROUP BY 1, 2),
        c AS (SELECT sign, st.clip, avg(spread) AS spread, avg(step) AS step FROM st LEFT JOIN sp ON sp.clip = st.clip AND sp.t = st.t WHERE whole GROUP BY 1, 2 HAVING count(*) >= 2), per AS (SELECT sign, avg(spread) AS spread, avg(step) AS step FROM c GROUP BY 1), va AS (SELECT sign, avg(CAST(whole AS INTEGER)) AS valid FROM st GROUP BY 1)
        SELECT sign, round(valid, 7) AS valid, round(spread, 7) AS spread, round(step, 7) AS step, round(step / spread, 7) AS ratio, coalesce(spread > 0.2 AND step / spread < 0.6 AND valid > 0.6, false) AS usable FROM va LEFT JOIN per USING (sign)"""),
    "difficulty_rank": (ranked, "SELECT p_partkey, row_number() OVER (ORDER BY CASE WHEN p_size % 4 > 0 THEN p_size END NULLS LAST, p_brand, p_retailprice, p_type, p_name || ' ' || p_partkey) AS difficulty_rank FROM part"),
    "gaussian_smooth": (lambda s, d: _long(dense(s, d).withColumn("traj", L.gaussian_smooth(F.col("traj")))), f"WITH {FLAT}, {_KERNEL} SELECT l.clip, l.t, l.f, round(sum(coalesce(x.v, 0) * w), 9) AS v FROM lng l, kern JOIN lng x ON x.clip = l.clip AND x.f = l.f AND x.t = greatest(0, least(7, l.t + k)) GROUP BY 1, 2, 3"),
    "loop_close": (lambda s, d: _long(dense(s, d).withColumn("traj", L.loop_close(F.col("traj")))), f"WITH {FLAT} SELECT l.clip, l.t, l.f, round(CASE WHEN l.t >= 2 THEN (1 - (l.t - 1) / 6.0::DOUBLE) * coalesce(l.v, 0) + (l.t - 1) / 6.0::DOUBLE * coalesce(o.v, 0) ELSE coalesce(l.v, 0) END, 9) AS v FROM lng l JOIN lng o ON o.clip = l.clip AND o.f = l.f AND o.t = 0"),
    "unit_rows": (lambda s, d: _long(dense(s, d).withColumn("traj", L.unit_rows(F.col("traj")))), f"WITH {FLAT}, n AS (SELECT clip, t, sqrt(sum(coalesce(v, 0) * coalesce(v, 0))) AS n FROM lng GROUP BY 1, 2) SELECT l.clip, l.t, l.f, round(CASE WHEN n > 1e-6 THEN coalesce(v, 0) / n ELSE 0 END, 9) AS v FROM lng l JOIN n USING (clip, t)"),
    "average_hash": (hashes, "WITH q AS (SELECT vec_id, list_transform(embedding, lambda v: floor(v::DOUBLE * 1000)) AS p FROM embeddings), b AS (SELECT vec_id, list_transform(p, lambda v: CASE WHEN v > list_sum(p) / len(p) THEN 1 ELSE 0 END) AS b FROM q) SELECT vec_id, array_to_string(list_transform(range(16), lambda i: substr('0123456789abcdef', (1 + b[i * 4 + 1] * 8 + b[i * 4 + 2] * 4 + b[i * 4 + 3] * 2 + b[i * 4 + 4])::BIGINT, 1)), '') AS hash FROM b"),
    "first_seen_ids": (hits, "WITH o AS (SELECT l_suppkey, l_partkey, l_linenumber, l_orderkey, CASE WHEN l_orderkey % 7 > 0 THEN l_quantity END AS l_quantity FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_linenumber, l_orderkey, l_quantity) = 1) SELECT l_suppkey, l_partkey, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_linenumber, l_orderkey, l_partkey) AS INTEGER) AS place FROM o WHERE coalesce(l_quantity <= 30, true) QUALIFY place <= 5"),
    "subsample_mix": (mixed, "SELECT o_orderkey, false AS extra FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL (SELECT o_orderkey, true FROM orders WHERE o_orderpriority = '5-LOW' QUALIFY row_number() OVER (ORDER BY md5('42|' || o_orderkey), o_orderkey) <= 300)"),
    "resolve_gloss_variant": (variants, "WITH v AS (SELECT regexp_replace(lower(p_type), '[^a-z]', '', 'g') AS n, min(lower(p_type)) AS resolved FROM part WHERE p_size < 15 GROUP BY 1), g AS (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN p_type || '. 1' ELSE upper(p_type) || '2' END AS gloss FROM part) SELECT p_partkey, gloss, resolved FROM g LEFT JOIN v ON NOT contains(gloss, '.') AND n = regexp_replace(lower(gloss), '[^a-z]', '', 'g')"),
    "attach_files": (files, f"WITH l AS (SELECT lower({_BASE}) AS base, split_part(url, '?', 1) AS path FROM pages), b AS (SELECT base, first(path ORDER BY length(path), path) AS path FROM l GROUP BY 1), w AS (SELECT page_id, upper(CASE WHEN page_id % 3 <> 0 THEN {_BASE} ELSE 'none.mp4' END) AS file FROM pages) SELECT page_id, file, path, CASE WHEN path IS NULL THEN 'missing' ELSE 'ok' END AS status FROM w LEFT JOIN b ON base = lower(file)"),
    "resolve_lexicon": (lexicon, """WITH e AS (SELECT l_partkey AS k, first('L' || l_suppkey ORDER BY l_orderkey * 10 + l_linenumber) AS code, count(*) AS n FROM lineitem WHERE l_partkey % 4 <> 1 GROUP BY 1)
        SELECT p_partkey AS k, CASE WHEN p_partkey % 5 = 0 THEN p_brand WHEN p_partkey % 3 = 0 THEN p_name ELSE e.code END AS code, CASE WHEN p_partkey % 5 = 0 THEN 'seed' WHEN p_partkey % 3 = 0 THEN 'override' WHEN n = 1 THEN 'entry' WHEN n > 1 THEN 'entry-first' END AS provenance FROM part LEFT JOIN e ON e.k = p_partkey"""),
    "feature_lexicon_diff": (unlike, "SELECT a.p_partkey AS target, b.p_partkey AS predicted, array_to_string(list_filter([" + ", ".join(f"CASE WHEN a.{f} IS DISTINCT FROM b.{f} THEN '{f}: ' || a.{f} || ' not ' || b.{f} END" for f in ("p_type", "p_brand", "p_name", "p_size")) + "], lambda x: x IS NOT NULL)[1:2], '; ') AS difference FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1"),
    "choose_hint": (shown, "SELECT event_id, CASE WHEN event_type = 'error' THEN CASE WHEN event_id % 3 > 0 THEN 'hint ' || event_id % 20 ELSE 'Look at the reference again.' END END AS hint_shown, CASE WHEN event_type = 'error' THEN 'generic_failure' ELSE 'none' END AS hint_source FROM events"),
    "lead_window": (windows, """WITH w AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber > 1 THEN CAST(l_quantity AS INTEGER) - 20 END AS a, CASE WHEN l_orderkey % 3 > 0 THEN CAST(l_quantity AS INTEGER) END AS b FROM lineitem)
        SELECT l_orderkey, l_linenumber, CASE WHEN a > 1 THEN a - 1 END AS first, CASE WHEN a > 1 AND b > 0 THEN b - 1 END AS last, coalesce(a > 1, false) AS cut, coalesce(a > 1, false) OR coalesce(b > 0, false) AS trimmed FROM w"""),
    "even_indices": (indices, "SELECT p_partkey, array_to_string(list_transform(range(16), lambda i: CASE WHEN p_size >= 16 THEN CAST(round_even(i * (p_size - 1) / 15.0::DOUBLE, 0) AS INTEGER) ELSE least(i, p_size - 1)::INTEGER END), ',') AS picked FROM part"),
    "frame_index": (sampled, """WITH p AS (SELECT p_partkey, p_size, CASE WHEN p_size > 12 THEN list_distinct(list_transform(range(12), lambda i: CAST(round_even(i * (p_size - 1) / 11.0::DOUBLE, 0) AS INTEGER) + 1)) ELSE list_transform(range(1, p_size + 1), lambda i: i::INTEGER) END AS l FROM part), e AS (SELECT p_partkey, p_size, unnest(l) AS i FROM p)
        SELECT *, (i - 1) / 8.0::DOUBLE AS ts FROM e"""),
    "body_box_from_face": (faces, """WITH f AS (SELECT l_orderkey, l_linenumber, l_quantity * 5 AS x0, l_linenumber * 20.0::DOUBLE AS y0, round(l_discount * 400) AS w, round(l_tax * 500) AS h FROM lineitem), m AS (SELECT *, x0 + w / 2 AS cx, 0.12::DOUBLE * greatest(3.8::DOUBLE * w, 5.7::DOUBLE * h) AS m FROM f WHERE w > 0 AND h > 0),
        b AS (SELECT l_orderkey, l_linenumber, greatest(0, floor(cx - 1.9::DOUBLE * w - m))::BIGINT AS bx0, greatest(0, floor(y0 - 0.5::DOUBLE * h - m))::BIGINT AS by0, least(320, floor(cx + 1.9::DOUBLE * w + m))::BIGINT AS bx1, least(240, floor(y0 + h + 4.2::DOUBLE * h + m))::BIGINT AS by1 FROM m) SELECT * FROM b WHERE bx1 > bx0 AND by1 > by0"""),
    "crop_index": (crops, """WITH b AS (SELECT l_orderkey, l_linenumber, l_quantity * 2 AS x0, l_linenumber * 15.0::DOUBLE AS y0, (l_quantity + round(l_tax * 1000)) * 2 AS x1, (l_linenumber * 10.0::DOUBLE + round(l_discount * 1000)) * 1.5::DOUBLE AS y1 FROM lineitem), m AS (SELECT *, 0.15::DOUBLE * greatest(x1 - x0, y1 - y0) AS m FROM b),
        c AS (SELECT l_orderkey, l_linenumber, greatest(0, round_even(x0 - m, 0))::INTEGER AS cx0, greatest(0, round_even(y0 - m, 0))::INTEGER AS cy0, least(200, round_even(x1 + m, 0))::INTEGER AS cx1, least(150, round_even(y1 + m, 0))::INTEGER AS cy1 FROM m) SELECT * FROM c WHERE cx1 - cx0 >= 8 AND cy1 - cy0 >= 8"""),
    "project": (projected, f"WITH {POINTS} SELECT vec_id, CAST(i AS INTEGER) AS i, round(x / z * 480 + 112, 6) AS u, round(y / z * 480 + 112, 6) AS v FROM pts"),
    "relative_depth": (relative, f"WITH {POINTS} SELECT p.vec_id, CAST(p.i AS INTEGER) AS i, round((p.z - a.z) / sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2 + (b.z - a.z) ** 2), 7) AS z FROM pts p JOIN pts a ON a.vec_id = p.vec_id AND a.i = 0 JOIN pts b ON b.vec_id = p.vec_id AND b.i = 9 WHERE (b.x - a.x) ** 2 + (b.y - a.y) ** 2 + (b.z - a.z) ** 2 >= 1e-6"),
    "body_space": (bodies, f"WITH {POINTS}, s AS (SELECT a.vec_id, greatest(sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2 + (b.z - a.z) ** 2), 1e-6) AS s FROM pts a JOIN pts b ON b.vec_id = a.vec_id AND a.i = 5 AND b.i = 17) SELECT p.vec_id, CAST(p.i AS INTEGER) AS i, round((p.x - o.x) / s, 6) AS x, round((p.y - o.y) / s, 6) AS y, round((p.z - o.z) / s, 6) AS z FROM pts p JOIN pts o ON o.vec_id = p.vec_id AND o.i = 0 JOIN s ON s.vec_id = p.vec_id"),
    "widen_features": (widened, f"WITH {FLAT}, w AS (SELECT clip, t, CASE WHEN f < 3 THEN f WHEN f < 6 THEN f + 2 ELSE f + 4 END AS f, v FROM lng UNION ALL SELECT clip, t, z, 0 FROM (SELECT DISTINCT clip, t FROM lng), (VALUES (3), (4), (8), (9)) g(z)) SELECT clip, t, CAST(f AS INTEGER) AS f, round(v, 9) AS v FROM w"),
    "valid_instances": (instances, "SELECT l_orderkey, l_quantity AS x, CASE WHEN l_suppkey % 5 = 3 THEN 3 ELSE -1 END AS depths FROM lineitem WHERE l_linenumber = 3 AND l_tax > 0.02"),
    "threshold_lookup": (passing, "SELECT l_orderkey, l_linenumber, NOT (l_suppkey % 3 > 0 AND l_suppkey % 5 > 0) OR l_quantity <= l_suppkey % 50 AS passed FROM lineitem"),
    "update_profile": (profiles, "SELECT c_custkey, CASE WHEN c_custkey = 7 THEN 'left' WHEN c_nationkey % 2 = 0 THEN 'right' ELSE 'left' END AS handedness, CASE WHEN c_custkey = 7 THEN 3 END AS skin_type, CASE WHEN c_custkey = 7 THEN TIMESTAMP '2026-01-01 00:00:00' END AS onboarded_at FROM customer"),
    "export_account": (exported, """SELECT 'users' AS "table", '{"c_custkey":' || c_custkey || ',"c_nationkey":' || c_nationkey || '}' AS row FROM customer WHERE c_custkey = 7 UNION ALL SELECT 'attempts', '{"o_orderkey":' || o_orderkey || ',"o_custkey":' || o_custkey || '}' FROM orders WHERE o_custkey = 7"""),
    "delete_account": (deleted, """SELECT 'attempts' AS "table", count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM orders WHERE o_custkey <> 7 UNION ALL SELECT 'users', count(*), sum(c_custkey)::BIGINT FROM customer WHERE c_custkey <> 7"""),
    "candidate_urls": (urls, "WITH v AS (SELECT DISTINCT replace(lower(p_type), ' ', '_') AS slug FROM part), n AS (SELECT slug, slug AS name FROM v UNION SELECT slug, replace(slug, '_', '-') FROM v UNION SELECT slug, replace(slug, '_', '') FROM v UNION SELECT replace(lower(p_type), ' ', '_'), lower(p_brand) FROM part WHERE p_size = 1) SELECT slug, 'https://example.org/sign/' || name AS url FROM n"),
    "name_parts": (named, "SELECT o_orderkey, o_orderstatus || '_x' AS sign, o_orderstatus || '_x__' || o_custkey || '_fa' AS clip FROM orders"),
    "json_fields": (fields, "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.none') AS missing FROM events"),
    "status_filter": (downloaded, "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 4 > 0"),
}
