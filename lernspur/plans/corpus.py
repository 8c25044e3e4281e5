"""Corpus-curation queries over clips (documents) and star tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lernspur.functions import text as T
from lernspur.operators import corpus as C
from lernspur.plans.views import CLIPS, clips, table


def _counts(s, d):
    return C.counts_by(clips(s, d).withColumn("pair", F.concat_ws(":", "sign", "signer")), "pair", F.col("n_chars") > 500, "signer")


def _pairs(s, d):
    return clips(s, d).withColumn("pair", F.concat_ws(":", "sign", "signer"))


def _vocab(s, d):
    return _pairs(s, d).select("pair").distinct().union(s.createDataFrame([("xx:none",)], "pair string"))


def repeated_ids(s, d):
    l = table(s, d, "lineitem").select("l_partkey", "l_returnflag", "l_orderkey", "l_linenumber", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"))  # noqa: E741
    return C.dedup_prefer(l, "l_partkey", F.col("l_returnflag") == "A", "pos")


def balanced(s, d):
    return C.balance_to(clips(s, d).select("clip_id", "sign"), "sign", "clip_id", 200)


def quota(s, d):
    have = clips(s, d).where("clip_id % 10 = 0").groupBy("signer").agg(F.count("*").alias("have"))
    return C.quota_select(clips(s, d).select("clip_id", "signer"), "signer", "clip_id", 20, have)


def present(s, d):
    c = C.split_clips_per_sign(clips(s, d).select("clip_id", "sign", "signer"), "sign", "clip_id")
    return C.present_classes(c.where("split = 'train'"), c.where("split = 'val'"), clips(s, d).where("signer <> 'src3'"), "signer")


def leaks(s, d):
    c = C.split_clips_per_sign(clips(s, d).select("clip_id", "sign", "signer"), "sign", "clip_id")
    return C.split_leaks(c, "signer")


def signers_by_split(s, d):
    c = clips(s, d).select("clip_id", "signer")
    return C.signer_counts(c.join(C.split_signers(c, "signer", "clip_id"), "signer"), "signer")


def lessons(s, d):
    per = clips(s, d).groupBy("signer").agg(F.avg("n_chars").alias("accuracy"))
    return C.lesson_groups(per, "accuracy", "signer", 6)


def resumed(s, d):
    o = table(s, d, "orders")
    done = o.where("o_orderkey % 3 = 0").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    return C.resume_anti(o.select("o_orderkey"), done, "o_orderkey", ["F"])


def version_diff(s, d):
    c = clips(s, d)
    a = c.where("clip_id % 2 = 0").groupBy("signer").agg(F.count("*").alias("n"))
    b = c.where("clip_id % 3 = 0").groupBy("signer").agg(F.count("*").alias("n"))
    return C.diff_versions(a, b, "signer", "n")


def glosses(s, d):
    p = table(s, d, "part").select("p_partkey", F.concat_ws(" ", "p_type", F.upper("p_name")).alias("gloss"))
    vocab = table(s, d, "part").where("p_size < 10").select(T.slug_direct(F.concat_ws(" ", "p_type", "p_name")).alias("slug")).distinct()
    aliases = s.createDataFrame([("economy_small_ring", "ring"), ("large_bolt", "bolt")], "alias string, slug string")
    return C.resolve_gloss(p, "gloss", vocab, aliases)


def text_parts(s, d):
    path = F.split_part("url", F.lit("?"), F.lit(1))
    return table(s, d, "pages").select("page_id", T.basename(path).alias("base"), T.extension(path).alias("ext"), T.swap_prefix(F.col("url"), "https://", "s://").alias("swapped"), T.slug(F.col("url")).alias("slug"), T.norm(F.col("url")).alias("norm"), T.slug_direct(F.col("url")).alias("direct"), T.null_if_empty(T.extension(path)).alias("ext_or_null"))


def embeds(s, d):
    """The words of a page stand in for embeds: those of 11 letters or more give an id."""
    return table(s, d, "pages").select("page_id", F.array_join(T.embed_ids(F.replace("html", F.lit(" "), F.lit(" embed/"))), ",").alias("ids"))


def drawn(s, d):
    return C.weighted_sample(clips(s, d).select("clip_id", "n_chars"), "clip_id", F.col("n_chars"), 500)


H = "md5('42|' || CAST({0} AS VARCHAR))"
PAIRS = f"{CLIPS}, pairs AS (SELECT *, sign || ':' || signer AS pair FROM clips)"
SPLIT_CLIPS = f"split AS (SELECT clip_id, sign, signer, CASE WHEN row_number() OVER (PARTITION BY sign ORDER BY {H.format('clip_id')}) <= CASE WHEN count(*) OVER (PARTITION BY sign) >= 2 THEN greatest(1, floor(count(*) OVER (PARTITION BY sign) * 0.2::DOUBLE)) ELSE 0 END THEN 'val' ELSE 'train' END AS split FROM clips)"
QUERIES = {
    "counts_by": (_counts, f"WITH {PAIRS} SELECT pair, count(*) AS n, count(*) FILTER (WHERE n_chars > 500) AS n_ok, count(DISTINCT signer) AS n_sources FROM pairs GROUP BY pair"),
    "vocab_floor": (lambda s, d: C.vocab_floor(_counts(s, d), _vocab(s, d), "pair", 15, 60), f"""WITH {PAIRS}, v AS (SELECT pair, count(*) AS n FROM pairs GROUP BY 1 UNION ALL SELECT 'xx:none', 0),
        t AS (SELECT min(n) AS nth, count(*) AS found FROM (SELECT n FROM v ORDER BY n DESC LIMIT 60))
        SELECT pair, n, floor, n >= floor AS kept FROM v, (SELECT greatest(1, least(15, CASE WHEN found < 60 THEN 1 ELSE nth END)) AS floor FROM t)"""),
    "allow_list": (lambda s, d: C.allow_list(clips(s, d), clips(s, d).where("clip_id % 50 = 7").select("signer"), "signer").select("clip_id", "signer"), f"WITH {CLIPS} SELECT clip_id, signer FROM clips WHERE signer IN (SELECT signer FROM clips WHERE clip_id % 50 = 7)"),
    "skip_reasons": (lambda s, d: C.skip_reasons(clips(s, d), {"short": F.col("n_chars") < 300, "one-signer": F.col("signer") == "src1", "long": F.col("n_chars") > 9000}), f"WITH {CLIPS} SELECT CASE WHEN n_chars < 300 THEN 'short' WHEN signer = 'src1' THEN 'one-signer' WHEN n_chars > 9000 THEN 'long' END AS reason, count(*) AS n FROM clips GROUP BY 1 HAVING reason IS NOT NULL"),
    "dedup_within": (lambda s, d: C.dedup_within(clips(s, d), F.coalesce("signer", F.concat(F.lit("_anon_"), F.col("clip_id").cast("string"))), "hash", "clip_id"), f"WITH {CLIPS} SELECT * FROM clips QUALIFY row_number() OVER (PARTITION BY coalesce(signer, '_anon_' || clip_id), hash ORDER BY clip_id) = 1"),
    "dedup_prefer": (repeated_ids, "SELECT l_partkey, l_returnflag, l_orderkey, l_linenumber, l_orderkey * 10 + l_linenumber AS pos FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY CASE WHEN l_returnflag = 'A' THEN 0 ELSE 1 END, CASE WHEN l_returnflag = 'A' THEN l_orderkey * 10 + l_linenumber ELSE -(l_orderkey * 10 + l_linenumber) END) = 1"),
    "split_signers_per_sign": (lambda s, d: C.split_signers_per_sign(clips(s, d), "sign", "signer", "clip_id"), f"""WITH {CLIPS}, g AS (SELECT sign, signer, count(*) AS n FROM clips GROUP BY 1, 2),
        b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY sign ORDER BY {H.format('signer')}, signer ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(n) OVER (PARTITION BY sign) AS total FROM g),
        t AS (SELECT *, before < greatest(1, floor(total * 0.7::DOUBLE)) AS tr FROM b),
        u AS (SELECT *, sum(CASE WHEN tr THEN n ELSE 0 END) OVER (PARTITION BY sign) AS in_train FROM t)
        SELECT sign, signer, n, CASE WHEN tr THEN 'train' WHEN before - in_train < greatest(1, floor(total * 0.15::DOUBLE)) THEN 'val' ELSE 'test' END AS split FROM u"""),
    "split_signers": (lambda s, d: C.split_signers(clips(s, d), "signer", "clip_id"), f"WITH {CLIPS} SELECT signer, CASE WHEN row_number() OVER (ORDER BY {H.format('signer')}) <= greatest(1, round_even(count(*) OVER () * 0.2::DOUBLE, 0)) THEN 'val' ELSE 'train' END AS split FROM (SELECT DISTINCT signer FROM clips)"),
    "split_clips_per_sign": (lambda s, d: C.split_clips_per_sign(clips(s, d).select("clip_id", "sign", "signer"), "sign", "clip_id"), f"WITH {CLIPS}, {SPLIT_CLIPS} SELECT * FROM split"),
    "split_items": (lambda s, d: C.split_items(table(s, d, "orders").select("o_orderkey"), "o_orderkey"), f"SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY {H.format('o_orderkey')}) <= greatest(1, floor(count(*) OVER () * 0.05::DOUBLE)) THEN 'val' ELSE 'train' END AS split FROM orders"),
    "split_per_source": (lambda s, d: C.split_items(clips(s, d).select("clip_id", "signer"), "clip_id", 0.03, 8, groups=["signer"]), f"WITH {CLIPS} SELECT clip_id, signer, CASE WHEN row_number() OVER (PARTITION BY signer ORDER BY {H.format('clip_id')}) <= greatest(8, floor(count(*) OVER (PARTITION BY signer) * 0.03::DOUBLE)) THEN 'val' ELSE 'train' END AS split FROM clips"),
    "split_modulo": (lambda s, d: C.split_modulo(clips(s, d).select("clip_id"), "clip_id"), f"WITH {CLIPS} SELECT clip_id, CASE WHEN clip_id % 20 = 0 THEN 'val' ELSE 'train' END AS split FROM clips"),
    "balance_to": (balanced, f"""WITH {CLIPS}, r AS (SELECT clip_id, sign, row_number() OVER (PARTITION BY sign ORDER BY {H.format('clip_id')}) AS rank, count(*) OVER (PARTITION BY sign) AS size FROM clips),
        c AS (SELECT *, CASE WHEN rank <= 200 THEN ceil((200 - rank + 1)::DOUBLE / size)::INTEGER ELSE 0 END AS k FROM r) SELECT clip_id, sign, CAST(unnest(range(1, k + 1)) AS INTEGER) AS copy FROM c WHERE k > 0"""),
    "class_weights": (lambda s, d: C.class_weights(clips(s, d), "signer", True), f"WITH {CLIPS} SELECT signer, count(*) AS n, 1 / sqrt(count(*)) AS weight FROM clips GROUP BY 1"),
    "stratified_sample": (lambda s, d: C.stratified_sample(table(s, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "l_returnflag"), "l_returnflag", "id", 1000), f"WITH l AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_returnflag FROM lineitem) SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY {H.format('id')}, id) <= greatest(1, round_even(1000 * count(*) OVER (PARTITION BY l_returnflag)::DOUBLE / (SELECT count(*) FROM l), 0))"),
    "mix_negatives": (lambda s, d: C.mix_negatives(clips(s, d).where("sign = 'en'").select("clip_id"), clips(s, d).where("sign <> 'en'").select("clip_id"), "clip_id"), f"WITH {CLIPS} SELECT clip_id, false AS negative FROM clips WHERE sign = 'en' UNION ALL (SELECT clip_id, true FROM clips WHERE sign <> 'en' QUALIFY row_number() OVER (ORDER BY {H.format('clip_id')}) <= round_even((SELECT count(*) FROM clips WHERE sign = 'en') * 0.2::DOUBLE, 0))"),
    "quota_select": (quota, f"WITH {CLIPS}, h AS (SELECT signer, count(*) AS have FROM clips WHERE clip_id % 10 = 0 GROUP BY 1) SELECT clip_id, signer FROM clips LEFT JOIN h USING (signer) QUALIFY row_number() OVER (PARTITION BY signer ORDER BY clip_id) <= greatest(0, 20 - coalesce(have, 0))"),
    "thin_signs": (lambda s, d: C.thin_groups(_counts(s, d).select("pair", "n"), _vocab(s, d), "pair", 15), f"WITH {PAIRS}, v AS (SELECT pair, count(*) AS n FROM pairs GROUP BY 1 UNION ALL SELECT 'xx:none', 0) SELECT pair, n, 15 - n AS need FROM v WHERE n < 15"),
    "missing_signs": (lambda s, d: C.missing(_vocab(s, d), _pairs(s, d).where("n_chars > 2000"), "pair"), f"WITH {PAIRS}, v AS (SELECT DISTINCT pair FROM pairs UNION ALL SELECT 'xx:none') SELECT pair FROM v WHERE pair NOT IN (SELECT pair FROM pairs WHERE n_chars > 2000)"),
    "present_classes": (present, f"WITH {CLIPS}, {SPLIT_CLIPS} SELECT signer, row_number() OVER (ORDER BY signer) - 1 AS index FROM (SELECT DISTINCT signer FROM split WHERE signer <> 'src3')"),
    "present_classes_all": (present, f"WITH {CLIPS}, {SPLIT_CLIPS} SELECT signer, row_number() OVER (ORDER BY signer) - 1 AS index FROM (SELECT DISTINCT signer FROM split WHERE signer <> 'src3')"),
    "split_leaks": (leaks, f"WITH {CLIPS}, {SPLIT_CLIPS} SELECT signer, count(DISTINCT split) AS splits FROM split GROUP BY 1 HAVING splits > 1"),
    "signer_counts": (signers_by_split, f"WITH {CLIPS}, v AS (SELECT signer, CASE WHEN row_number() OVER (ORDER BY {H.format('signer')}) <= greatest(1, round_even(count(*) OVER () * 0.2::DOUBLE, 0)) THEN 'val' ELSE 'train' END AS split FROM (SELECT DISTINCT signer FROM clips)) SELECT split, count(DISTINCT signer) AS signers, count(*) AS clips FROM clips JOIN v USING (signer) GROUP BY 1"),
    "class_range": (lambda s, d: C.class_range(_pairs(s, d), "pair"), f"WITH {PAIRS}, n AS (SELECT count(*) AS n FROM pairs GROUP BY pair) SELECT min(n) AS least, list_sort(list(n))[count(*) // 2 + 1] AS middle, max(n) AS most FROM n"),
    "lesson_groups": (lessons, f"WITH {CLIPS}, p AS (SELECT signer, avg(n_chars) AS accuracy FROM clips GROUP BY 1) SELECT signer, accuracy, CAST((row_number() OVER (ORDER BY accuracy DESC, signer) - 1) // 6 + 1 AS INTEGER) AS lesson FROM p"),
    "resume_anti": (resumed, "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 AND o_orderstatus = 'F' THEN 'F' ELSE 'todo' END AS status, o_orderkey % 3 = 0 AND o_orderstatus = 'F' AS reused FROM orders"),
    "diff_versions": (version_diff, f"WITH {CLIPS}, a AS (SELECT signer, count(*) AS n FROM clips WHERE clip_id % 2 = 0 GROUP BY 1), b AS (SELECT signer, count(*) AS n FROM clips WHERE clip_id % 3 = 0 GROUP BY 1) SELECT signer, coalesce(a.n, 0) AS before, coalesce(b.n, 0) AS after, coalesce(b.n, 0) - coalesce(a.n, 0) AS change FROM a FULL JOIN b USING (signer)"),
    "resolve_gloss": (glosses, "WITH p AS (SELECT p_partkey, p_type || ' ' || upper(p_name) AS gloss, trim(regexp_replace(lower(p_type || ' ' || p_name), '[^a-z0-9]+', '_', 'g'), '_') AS g, p_size FROM part), v AS (SELECT DISTINCT g AS slug FROM p WHERE p_size < 10), a AS (SELECT * FROM (VALUES ('economy_small_ring', 'ring'), ('large_bolt', 'bolt')) t(alias, s)) SELECT p_partkey, gloss, coalesce(slug, s) AS resolved FROM p LEFT JOIN v ON g = slug LEFT JOIN a ON g = alias"),
    "text_parts": (text_parts, r"""WITH p AS (SELECT page_id, url, split_part(url, '?', 1) AS path FROM pages), b AS (SELECT *, regexp_extract(path, '[^/]*$') AS base FROM p)
        SELECT page_id, base, lower(regexp_extract(base, '\.([^.]+)$', 1)) AS ext, CASE WHEN starts_with(url, 'https://') THEN 's://' || substr(url, 9) ELSE url END AS swapped, replace(lower(url), '-', '_') AS slug, regexp_replace(lower(url), '[^a-z]', '', 'g') AS norm, trim(regexp_replace(lower(url), '[^a-z0-9]+', '_', 'g'), '_') AS direct, nullif(lower(regexp_extract(base, '\.([^.]+)$', 1)), '') AS ext_or_null FROM b"""),
    "embed_ids": (embeds, r"""WITH p AS (SELECT page_id, replace(html, ' ', ' embed/') AS html FROM pages), f AS (SELECT page_id, regexp_extract_all(html, '(?:embed/|watch\?v=|youtu\.be/)([A-Za-z0-9_-]{11})', 1) AS l FROM p)
        SELECT page_id, array_to_string(list_transform(list_sort(list_transform(list_distinct(l), lambda x: list_position(l, x)))[1:3], lambda i: l[i]), ',') AS ids FROM f"""),
    "weighted_sample": (drawn, f"""WITH {CLIPS}, r AS (SELECT clip_id, n_chars::DOUBLE AS w, substr({H.format('clip_id')}, 1, 2) AS s FROM clips WHERE n_chars > 0), p AS (SELECT clip_id, sum(w) OVER (ORDER BY s, clip_id) AS hi, w, sum(w) OVER () AS total FROM r),
        d AS (SELECT draw, CAST('0x' || substr({H.format('draw')}, 1, 12) AS BIGINT)::DOUBLE / 281474976710656.0::DOUBLE AS u FROM range(500) g(draw)) SELECT draw, clip_id FROM d JOIN p ON u * total >= hi - w AND u * total < hi"""),
    "category_order": (lambda s, d: C.category_order(table(s, d, "part").select("p_type", "p_size"), "p_type", "p_size", "ECONOMY"), "WITH p AS (SELECT p_type, avg(p_size) AS mean_rank, count(*) AS n FROM part GROUP BY 1) SELECT *, row_number() OVER (ORDER BY CAST(p_type = 'ECONOMY' AS INTEGER), mean_rank NULLS LAST, p_type) AS position FROM p"),
    "top_groups": (lambda s, d: C.top_groups(_pairs(s, d), "pair", 10, "clip_id").select("clip_id", "pair"), f"WITH {PAIRS} SELECT clip_id, pair FROM pairs WHERE pair IN (SELECT pair FROM pairs GROUP BY 1 ORDER BY count(*) DESC, min(clip_id) LIMIT 10)"),
    "split_groups": (lambda s, d: C.split_groups(clips(s, d).select("clip_id", "signer"), "signer", 0.3), f"WITH {CLIPS}, v AS (SELECT signer, CASE WHEN row_number() OVER (ORDER BY {H.format('signer')}) <= greatest(1, floor(count(*) OVER () * 0.3::DOUBLE)) THEN 'val' ELSE 'train' END AS split FROM (SELECT DISTINCT signer FROM clips)) SELECT clip_id, signer, split FROM clips JOIN v USING (signer)"),
    "activate_vocab": (lambda s, d: C.activate(table(s, d, "part").select("p_partkey", "p_brand"), "p_brand", table(s, d, "part").where("p_size > 48").select("p_brand")), "SELECT p_partkey, p_brand, p_brand IN (SELECT p_brand FROM part WHERE p_size > 48) AS is_active FROM part"),
    "own_rows": (lambda s, d: C.own_rows(table(s, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", F.lit(7)), "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = 7"),
    "cleanest_clip": (lambda s, d: C.best_by(clips(s, d), "signer", "clip_id", "n_chars"), f"WITH {CLIPS} SELECT signer, first(clip_id ORDER BY n_chars, clip_id) AS clip_id, min(n_chars) AS n_chars FROM clips GROUP BY 1"),
    "attach_signer": (lambda s, d: C.attach_signer(table(s, d, "labels").select(F.col("doc_id").alias("clip_id"), "quality"), clips(s, d).select("clip_id", F.when(F.col("clip_id") % 4 != 0, F.col("signer")).alias("signer"), F.col("sign").alias("source")), "clip_id", "signer", "source").select("clip_id", "quality", "signer_key"), "SELECT doc_id AS clip_id, quality, CASE WHEN doc_id % 4 <> 0 THEN lang || ':' || source ELSE lang || ':clip:' || doc_id END AS signer_key FROM labels JOIN documents USING (doc_id)"),
}
#: Every draw finds exactly one row.
QUERIES["weighted_sample_misses"] = (lambda s, d: drawn(s, d).groupBy("draw").agg(F.count("*").alias("rows")), f"SELECT draw, count(*) AS rows FROM ({QUERIES['weighted_sample'][1]}) GROUP BY 1")
