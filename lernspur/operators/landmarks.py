"""Landmarks, frames and their reports: coverage, recall, errors, geometry of points and boxes, and hints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def _percent(part: Column, of: Column) -> Column:
    return F.round(100.0 * part / F.greatest(of, F.lit(1)), 2)


def settled(df: DataFrame, *columns: str) -> DataFrame:
    """The same rows, with the columns computed once here: lambdas that read them many times would otherwise repeat their expressions."""
    return df.select(*[c for c in df.columns if c not in columns], F.inline(F.array(F.struct(*columns))))


def status_filter(df: DataFrame) -> DataFrame:
    """Rows that were fetched and have a path."""
    return df.where((F.col("status") == "ok") & F.col("path").isNotNull())


def landmark_coverage(frames: DataFrame) -> DataFrame:
    """Per source: clips, frames, hands a frame, shares of frames by hands and of clips by empty frames and missing pose. ``frames`` has source, clip, frame, hands, has_pose."""
    none = F.count_if(F.col("hands") == 0)
    per = frames.groupBy("source", "clip").agg(
        F.count("*").alias("frames"), F.sum("hands").alias("hands"), none.alias("n0"), F.count_if(F.col("hands") == 1).alias("n1"), F.count_if(F.col("hands") >= 2).alias("n2"), F.max("has_pose").alias("pose")
    )
    share = lambda rule: _percent(F.count_if(rule), F.count("*"))
    of_frames = lambda c: _percent(F.sum(c), F.sum("frames"))
    return per.groupBy("source").agg(
        F.count("*").alias("clips"), F.sum("frames").alias("frames"), F.round(F.sum("hands") / F.sum("frames"), 4).alias("hands_per_frame"),
        of_frames("n0").alias("pct_0"), of_frames("n1").alias("pct_1"), of_frames("n2").alias("pct_2"),
        share(F.col("n0") > 0).alias("pct_any_empty"), share(F.col("n0") == F.col("frames")).alias("pct_all_empty"), share(~F.col("pose")).alias("pct_no_pose"),
    )


def fail_histogram(frames: DataFrame) -> DataFrame:
    """Misses by third of the clip and by confidence. ``frames`` has position (0 to 1), confidence and missed."""
    third = F.when(F.col("position") < 0.33, "start").when(F.col("position") > 0.67, "end").otherwise("middle")
    bin_ = F.when(F.col("confidence") < 0.05, "<0.05").when(F.col("confidence") < 0.10, "<0.10").when(F.col("confidence") < 0.15, "<0.15").otherwise(">=0.15")
    return frames.where("missed").groupBy(third.alias("third"), bin_.alias("confidence")).agg(F.count("*").alias("n"))


def recall_by_source(frames: DataFrame) -> DataFrame:
    """Hands a frame and share of frames without, over all frames and from the first to the last frame of a clip that has hands."""
    of = W.partitionBy("clip")
    held = F.when(F.col("hands") > 0, F.col("frame"))
    active = frames.withColumn("inside", F.coalesce(F.col("frame").between(F.min(held).over(of), F.max(held).over(of)), F.lit(False)))
    n, inside = F.count("*"), F.count_if("inside")
    return active.groupBy("source").agg(
        F.round(F.sum("hands") / n, 4).alias("hands_per_frame"), _percent(F.count_if(F.col("hands") == 0), n).alias("pct_zero"),
        F.round(F.sum(F.when(F.col("inside"), F.col("hands")).otherwise(0)) / F.greatest(inside, F.lit(1)), 4).alias("hands_inside"), _percent(F.count_if(F.col("inside") & (F.col("hands") == 0)), inside).alias("pct_zero_inside"),
    )


def keypoint_error(pairs: DataFrame, by: str = "source") -> DataFrame:
    """Error over visible points, all together (null where none is visible), and per keypoint first and then averaged. ``pairs`` has keypoint, err and vis (0 or 1)."""
    per = pairs.groupBy(by, "keypoint").agg(F.sum(F.col("err") * F.col("vis")).alias("e"), F.sum("vis").alias("n"))
    return per.groupBy(by).agg(F.try_divide(F.sum("e"), F.sum("n")).alias("pooled"), F.avg(F.col("e") / F.greatest(F.col("n"), F.lit(1))).alias("by_keypoint"))


def signal_noise(z: DataFrame) -> DataFrame:
    """Per sign: share of whole frames, spread inside a frame, step between whole frames, their ratio, and whether the signal is usable. ``z`` has sign, clip, t and values (array)."""
    whole = F.forall("values", lambda v: v.isNotNull())
    steps = z.withColumn("whole", whole)
    mean = F.aggregate("values", F.lit(0.0), lambda s, v: s + v) / F.size("values")
    spread = F.sqrt(F.aggregate(F.transform("values", lambda v: (v - F.col("m")) * (v - F.col("m"))), F.lit(0.0), lambda s, v: s + v) / F.size("values"))
    before = F.lag("values").over(W.partitionBy("clip").orderBy("t"))
    held = steps.where("whole").withColumn("m", mean).withColumn("spread", spread).withColumn("was", before)
    step = F.aggregate(F.zip_with("values", "was", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, v: s + v) / F.size("values")
    clips = held.withColumn("step", F.when(F.col("was").isNotNull(), step)).groupBy("sign", "clip").agg(F.avg("spread").alias("spread"), F.avg("step").alias("step"), F.count("*").alias("n")).where("n >= 2")
    per = clips.groupBy("sign").agg(F.avg("spread").alias("spread"), F.avg("step").alias("step"))
    valid = steps.groupBy("sign").agg(F.avg(F.col("whole").cast("int")).alias("valid"))
    ratio = F.when(F.col("spread") > 1e-6, F.col("step") / F.col("spread"))
    rated = valid.join(per, "sign", "left").withColumn("ratio", ratio)
    return rated.withColumn("usable", F.coalesce((F.col("spread") > 0.2) & (F.col("ratio") < 0.6) & (F.col("valid") > 0.6), F.lit(False)))


def difficulty_rank(items: DataFrame, lesson: str, complexity: str, movement: str, two_handed: str, gloss: str) -> DataFrame:
    """Rank by lesson, complexity, static before movement, one hand before two, gloss; a table of the vocabulary's size."""
    order = W.partitionBy(F.lit(0)).orderBy(F.col(lesson).asc_nulls_last(), complexity, movement, two_handed, gloss)
    return items.withColumn("difficulty_rank", F.row_number().over(order))


def gaussian_smooth(traj: Column, sigma: float = 2.2) -> Column:
    """Gaussian filter over time of every feature, edges repeating their value; trajectories of fewer than three steps stay."""
    half = int(4 * sigma + 0.5)
    raw = [2.718281828459045 ** (-0.5 * (k / sigma) ** 2) for k in range(-half, half + 1)]
    kernel = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(w / sum(raw)).alias("w")) for k, w in zip(range(-half, half + 1), raw, strict=True)])
    last = F.size(traj) - 1
    at = lambda t, k: F.get(traj, F.greatest(F.lit(0), F.least(last, t + k)))
    smooth = F.transform(traj, lambda row, t: F.transform(row, lambda _, f: F.aggregate(kernel, F.lit(0.0), lambda s, x: s + F.get(at(t, x["k"]), f) * x["w"])))
    return F.when(F.size(traj) >= 3, smooth).otherwise(traj)


def loop_close(traj: Column, n: int = 6) -> Column:
    """The last n steps fade into the first one, whole on the last."""
    length = F.least(F.lit(n), F.size(traj) - 1)
    share = lambda t: (t - (F.size(traj) - length) + 1) / length
    return F.transform(traj, lambda row, t: F.when(t >= F.size(traj) - length, F.zip_with(row, F.get(traj, F.lit(0)), lambda a, b: (1 - share(t)) * a + share(t) * b)).otherwise(row))


def unit_rows(traj: Column) -> Column:
    """Every row scaled to unit length; rows shorter than 1e-6 become 0."""

    def unit(row: Column) -> Column:
        length = F.sqrt(F.aggregate(row, F.lit(0.0), lambda s, v: s + v * v))
        return F.transform(row, lambda v: F.when(length > 1e-6, v / F.greatest(length, F.lit(1e-9))).otherwise(F.lit(0.0)))

    return F.transform(traj, unit)


def average_hash(df: DataFrame, pixels: str, into: str = "hash") -> DataFrame:
    """Hexadecimal digits of which pixels lie above the mean; without pixels the first 16 digits of a SHA-256 of nothing."""
    mean = F.aggregate(pixels, F.lit(0.0), lambda s, v: s + v) / F.size(pixels)
    d = settled(df.withColumn("__m", mean), pixels, "__m")
    d = settled(d.withColumn("__b", F.array_join(F.transform(pixels, lambda v: F.when(v > F.col("__m"), "1").otherwise("0")), "")), "__b")
    nibbles = F.transform(F.sequence(F.lit(0), F.floor(F.size(pixels) / 4).cast("int") - 1), lambda i: F.lower(F.conv(F.substr(F.col("__b"), i * 4 + 1, F.lit(4)), 2, 16)))
    return d.withColumn(into, F.when(F.size(pixels) >= 4, F.array_join(nibbles, "")).otherwise(F.substring(F.sha2(F.lit(""), 256), 1, 16))).drop("__m", "__b")


def first_seen_ids(rows: DataFrame, sign: str, key: str, order: list[str], duration: str, most_seconds: float, n: int) -> DataFrame:
    """The first n distinct ids of each sign over its ordered searches that are short enough; a missing duration is no reason to drop one."""
    once = rows.groupBy(sign, key).agg(F.min(F.struct(*order, duration)).alias("__first"))
    short = once.where(F.coalesce(F.col(f"__first.{duration}") <= most_seconds, F.lit(True)))
    place = F.row_number().over(W.partitionBy(sign).orderBy(*[f"__first.{c}" for c in order], key))
    return short.withColumn("place", place).where(F.col("place") <= n).select(sign, key, "place")


def subsample_mix(base: DataFrame, extra: DataFrame, key: str, n: int, seed: str = "42") -> DataFrame:
    """All of ``base`` and n rows of ``extra`` in seeded order."""
    from lernspur.operators.ranking import hash_rank

    some = hash_rank(extra, [], key, seed).where(F.col("rank") <= n).drop("rank", "group_size")
    return base.withColumn("extra", F.lit(False)).unionByName(some.withColumn("extra", F.lit(True)))


def resolve_gloss_variant(df: DataFrame, column: str, vocab: DataFrame) -> DataFrame:
    """Vocabulary entry of each gloss by its letters alone; glosses with dots are spelled by fingers and resolve to none. ``vocab`` has slug."""
    from lernspur.functions.text import norm

    known = vocab.groupBy(norm(F.col("slug")).alias("__n")).agg(F.min("slug").alias("resolved"))
    d = df.withColumn("__k", F.when(~F.col(column).contains("."), norm(F.col(column))))
    return d.join(known, F.col("__k") == F.col("__n"), "left").drop("__k", "__n")


def attach_files(rows: DataFrame, name: str, listing: DataFrame) -> DataFrame:
    """Each row's file in a listing (``path``) by base name without regard to case, the shortest path of several, and ok or missing."""
    from lernspur.functions.text import basename

    best = listing.groupBy(F.lower(basename(F.col("path"))).alias("__base")).agg(F.min(F.struct(F.length("path").alias("n"), "path"))["path"].alias("path"))
    d = rows.withColumn("__want", F.lower(F.col(name)))
    return d.join(best, F.col("__want") == F.col("__base"), "left").withColumn("status", F.when(F.col("path").isNull(), "missing").otherwise("ok")).drop("__want", "__base")


def resolve_lexicon(active: DataFrame, key: str, seed: DataFrame, overrides: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Code of each entry: its seed code, else a manual override, else the lexicon's entry of that id, single or the first of several; and where it came from.

    ``seed`` and ``overrides`` have key and code; ``lexicon`` has entry, code and position.
    """
    first = lexicon.groupBy("entry").agg(F.min_by("code", "position").alias("__l"), F.count("*").alias("__n"))
    d = active.join(seed.select(key, F.col("code").alias("__s")), key, "left").join(overrides.select(key, F.col("code").alias("__o")), key, "left")
    d = d.join(first, F.col(key) == F.col("entry"), "left").drop("entry")
    found = F.when(F.col("__s").isNotNull(), "seed").when(F.col("__o").isNotNull(), "override").when(F.col("__n") == 1, "entry").when(F.col("__n") > 1, "entry-first")
    return d.withColumn("code", F.coalesce("__s", "__o", "__l")).withColumn("provenance", found).drop("__s", "__o", "__l", "__n")


def expand_synonyms(seeds: dict[str, str], groups: DataFrame) -> DataFrame:
    """(member, owner): a group belongs to the owner of its first member that has one, members without one join it, and later groups see earlier results.

    ``groups`` has position and members, and is folded in order: a list of the vocabulary's size.
    """
    start = F.from_json(F.lit("{}"), "map<string,string>")
    if seeds:
        start = F.create_map(*[F.lit(x) for pair in seeds.items() for x in pair])

    def step(known: Column, group: Column) -> Column:
        owner = F.get(F.filter(F.transform(group["members"], lambda m: known[m]), lambda o: o.isNotNull()), F.lit(0))
        new = F.filter(F.array_distinct(group["members"]), lambda m: known[m].isNull())
        return F.when(owner.isNull(), known).otherwise(F.map_concat(known, F.map_from_entries(F.transform(new, lambda m: F.struct(m.alias("key"), owner.alias("value"))))))

    ordered = groups.agg(F.array_sort(F.collect_list(F.struct("position", "members"))).alias("g"))
    return ordered.select(F.explode(F.aggregate("g", start, step)).alias("member", "owner"))


def feature_lexicon_diff(pairs: DataFrame, lexicon: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """In text the first two lexicon fields in which a confused pair (target, predicted) differs."""
    side = lambda p: lexicon.select(F.col(key).alias(p), *[F.col(f).cast("string").alias(f"{p}_{f}") for f in fields])
    both = pairs.join(side("target"), "target").join(side("predicted"), "predicted")
    unlike = [F.when(~F.col(f"target_{f}").eqNullSafe(F.col(f"predicted_{f}")), F.concat(F.lit(f"{f}: "), F.coalesce(f"target_{f}", F.lit("none")), F.lit(" not "), F.coalesce(f"predicted_{f}", F.lit("none")))) for f in fields]
    return both.select("target", "predicted", F.array_join(F.slice(F.array_compact(F.array(*unlike)), 1, 2), "; ").alias("difference"))


def choose_hint(passed: Column, hint: Column, fallback: str) -> Column:
    """No hint after a pass, else the item's own or the fallback; and its kind."""
    return F.struct(F.when(passed, None).otherwise(F.coalesce(hint, F.lit(fallback))).alias("hint_shown"), F.when(passed, "none").otherwise("generic_failure").alias("hint_source"))


def lead_window(start: Column, end: Column) -> Column:
    """Zero-based inclusive range of a one-based one; from the first frame on nothing is cut, but an end alone counts as trimmed."""
    cut = start > 1
    return F.struct(
        F.when(cut, start - 1).alias("first"), F.when(cut & (end > 0), end - 1).alias("last"), F.coalesce(cut, F.lit(False)).alias("cut"), (F.coalesce(cut, F.lit(False)) | F.coalesce(end > 0, F.lit(False))).alias("trimmed")
    )


def even_indices(n: Column, m: int) -> Column:
    """m indices spread evenly over n, rounded half to even; fewer than m are all taken and the last repeated."""
    spread = F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda i: F.bround(i * (n - 1) / max(1, m - 1)).cast("int"))
    all_ = F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda i: F.least(i, n - 1).cast("int"))
    return F.when(n >= m, spread).when(n > 0, all_).otherwise(F.array().cast("array<int>"))


def frame_index(clips: DataFrame, frames: str, fps: float, most: int) -> DataFrame:
    """(columns, i, ts) of the frames to sample: all, or ``most`` spread evenly; frame i (from 1) stands at (i - 1) / fps."""
    n = F.col(frames)
    picked = F.when(n > most, F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.bround(i * (n - 1) / max(1, most - 1)).cast("int") + 1))).otherwise(F.sequence(F.lit(1), n.cast("int")))
    return clips.where(n > 0).withColumn("i", F.explode(picked)).withColumn("ts", (F.col("i") - 1) / fps)


def body_box_from_face(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column, side: float = 1.9, up: float = 0.5, down: float = 4.2, pad: float = 0.12) -> Column:
    """Upper-body box below a face, padded and cut to the image; null where either has no extent."""
    w, h, cx = x1 - x0, y1 - y0, (x0 + x1) / 2
    margin = pad * F.greatest(2 * side * w, (up + down + 1) * h)
    a, b = F.greatest(F.lit(0), F.floor(cx - side * w - margin)), F.greatest(F.lit(0), F.floor(y0 - up * h - margin))
    c, d = F.least(width.cast("long"), F.floor(cx + side * w + margin)), F.least(height.cast("long"), F.floor(y1 + down * h + margin))
    return F.when((w > 0) & (h > 0) & (c > a) & (d > b), F.struct(a.alias("bx0"), b.alias("by0"), c.alias("bx1"), d.alias("by1")))


def scale_box(box: list[Column], sx: Column, sy: Column) -> list[Column]:
    return [box[0] * sx, box[1] * sy, box[2] * sx, box[3] * sy]


def crop_box(box: list[Column], width: Column, height: Column, pad: float = 0.15, least: int = 8) -> Column:
    """A box padded by a share of its longer side, rounded and cut to the image; null under ``least`` pixels."""
    x0, y0, x1, y1 = box
    m = pad * F.greatest(x1 - x0, y1 - y0)
    a, b = F.greatest(F.lit(0), F.bround(x0 - m).cast("int")), F.greatest(F.lit(0), F.bround(y0 - m).cast("int"))
    c, d = F.least(width.cast("int"), F.bround(x1 + m).cast("int")), F.least(height.cast("int"), F.bround(y1 + m).cast("int"))
    return F.when((c - a >= least) & (d - b >= least), F.struct(a.alias("cx0"), b.alias("cy0"), c.alias("cx1"), d.alias("cy1")))


def project(xyz: Column, fx: float, fy: float, cx: float, cy: float) -> Column:
    """Pinhole projection of points [x, y, z] to [u, v]; both null for a point without depth or of fewer values."""
    ratio = lambda p, i: F.try_divide(F.get(p, F.lit(i)), F.get(p, F.lit(2)))
    return F.transform(xyz, lambda p: F.array(ratio(p, 0) * fx + cx, ratio(p, 1) * fy + cy))


def relative_depth(xyz: Column, root: int = 0, tip: int = 9, least: float = 1e-3) -> Column:
    """Depth of every point from the root over the palm's length; null where the palm is shorter than ``least`` or has a point of fewer than three values."""
    a, b = F.get(xyz, F.lit(root)), F.get(xyz, F.lit(tip))
    at = lambda p, i: F.get(p, F.lit(i))
    palm = F.sqrt(sum((at(b, i) - at(a, i)) * (at(b, i) - at(a, i)) for i in range(3)))
    return F.when(palm >= least, F.transform(xyz, lambda p: (at(p, 2) - at(a, 2)) / palm))


def body_space(points: Column, neck: int, left: int, right: int) -> Column:
    """Points from the neck, in shoulder spans of at least 1e-6."""
    a, b, o = F.get(points, F.lit(left)), F.get(points, F.lit(right)), F.get(points, F.lit(neck))
    at = lambda p, i: F.get(p, F.lit(i))
    span = F.greatest(F.sqrt(sum((at(b, i) - at(a, i)) * (at(b, i) - at(a, i)) for i in range(3))), F.lit(1e-6))
    return F.transform(points, lambda p: F.zip_with(p, o, lambda x, y: (x - y) / span))


def widen(features: Column, blocks: list[tuple[int, int] | int]) -> Column:
    """Feature rows with zeros put in: (first, count) copies features, a number stands for that many zeros."""
    parts = lambda row: [F.array_repeat(F.lit(0.0), b) if isinstance(b, int) else F.slice(row, b[0] + 1, b[1]) for b in blocks]
    return F.transform(features, lambda row: F.concat(*parts(row)))


#: From two hands of 42 and a pose of 16 to hands with 128 embedding values each.
EMBEDDED = [(0, 42), 128, (42, 42), 128, (84, 16)]


def valid_instances(labels: DataFrame, column: str, n: int) -> DataFrame:
    """One row per instance with a box and exactly n keypoints; depth stays only where it has n values."""
    each = labels.withColumn("instance", F.explode(column)).drop(column)
    good = each.where((F.size("instance.bbox") == 4) & (F.size("instance.keypoints") == n))
    depth = F.when(F.size("instance.depth") == n, F.col("instance.depth"))
    return good.select(*[c for c in good.columns if c != "instance"], "instance.bbox", "instance.keypoints", depth.alias("depth"))


def threshold_lookup(rows: DataFrame, thresholds: DataFrame, key: str) -> DataFrame:
    """Each row's threshold; where it is missing or no number, infinity, which lets everything pass."""
    found = rows.join(thresholds.select(key, F.col("threshold").alias("__t")), key, "left")
    finite = F.col("__t").isNotNull() & ~F.isnan("__t") & (F.abs("__t") != float("inf"))
    return found.withColumn("threshold", F.when(finite, F.col("__t")).otherwise(F.lit(float("inf")))).drop("__t")


def update_profile(users: DataFrame, key: str, user: Column, handedness: str, skin_type: int | None, onboarded: Column) -> DataFrame:
    """Sets handedness, skin type (1 to 6 or none) and onboarding time of one account."""
    if skin_type is not None and not 1 <= skin_type <= 6:
        raise ValueError(f"skin type {skin_type} is not 1 to 6")
    own = F.col(key) == user
    return users.withColumns({"handedness": F.when(own, F.lit(handedness)).otherwise(F.col("handedness")), "skin_type": F.when(own, F.lit(skin_type)).otherwise(F.col("skin_type")), "onboarded_at": F.when(own, onboarded).otherwise(F.col("onboarded_at"))})


def export_account(tables: dict[str, tuple[DataFrame, str]], user: Column) -> DataFrame:
    """(table, row as JSON) of all rows of one account; ``tables`` maps names to a table and its account column."""
    parts = [df.where(F.col(column) == user).select(F.lit(name).alias("table"), F.to_json(F.struct("*")).alias("row")) for name, (df, column) in tables.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def delete_account(tables: dict[str, tuple[DataFrame, str]], user: Column, at: Column) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables without one account's rows, and a log row with the time and the hashed id alone."""
    left = {name: df.where(~F.col(column).eqNullSafe(user)) for name, (df, column) in tables.items()}
    spark = next(iter(tables.values()))[0].sparkSession
    return left, spark.range(1).select(at.alias("deleted_at"), F.sha2(user.cast("string"), 256).alias("user_hash"))


def candidate_urls(vocab: DataFrame, slug: str, aliases: DataFrame, base: str) -> DataFrame:
    """(slug, url) of every spelling of a sign: its slug with underscores, dashes or neither, and its aliases. ``aliases`` has slug and alias."""
    names = vocab.select(F.col(slug).alias("slug")).join(aliases.groupBy("slug").agg(F.collect_set("alias").alias("__a")), "slug", "left")
    forms = F.array(F.col("slug"), F.replace("slug", F.lit("_"), F.lit("-")), F.replace("slug", F.lit("_"), F.lit("")))
    every = F.array_union(forms, F.coalesce("__a", F.array().cast("array<string>")))
    return names.select("slug", F.explode(F.array_distinct(every)).alias("__n")).select("slug", F.concat(F.lit(base), F.col("__n")).alias("url"))


def name_parts(path: Column) -> Column:
    """Sign (the stem before "__") and clip (the stem before its last "_f") of a file name."""
    stem = F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")
    return F.struct(F.substring_index(stem, "__", 1).alias("sign"), F.regexp_replace(stem, "^(.*)_f.*$", "$1").alias("clip"))


def signal_verdict(per_sign: DataFrame) -> DataFrame:
    """One row over the signs of ``signal_noise``: mean spread, ratio and valid share, each of figures rounded to three decimals, and whether they are usable as a whole. Signs without a spread do not count."""
    # whole thousandths, so that the sums do not depend on their order
    rated = per_sign.where("spread IS NOT NULL").select(*[F.round(F.col(c) * 1000).cast("long").alias(c) for c in ("spread", "ratio", "valid")])
    mean = rated.agg(F.count("*").alias("signs"), *[(F.round(F.try_divide(F.sum(c), F.count(c))) / 1000).alias(f"mean_{c}") for c in ("spread", "ratio", "valid")])
    return mean.withColumn("usable", F.coalesce((F.col("mean_spread") > 0.2) & (F.col("mean_ratio") < 0.6) & (F.col("mean_valid") > 0.6), F.lit(False)))


def face_forward(points: DataFrame, group: str, wrists: tuple[int, int], damp: float = 0.35) -> DataFrame:
    """Points in body space whose hands have positive depth: z is turned over in groups (clips) whose wrists lie below 0 on average, the two taken together, and damped in all."""
    depth = lambda w: F.avg(F.get(F.get("points", F.lit(w)), F.lit(2)))
    mean = points.groupBy(F.col(group).alias("__g")).agg((depth(wrists[0]) + depth(wrists[1])).alias("__z"))
    met = points.join(mean, F.col(group).eqNullSafe(F.col("__g")))
    sign = F.when(F.col("__z") < 0, -damp).otherwise(damp)
    turned = F.transform("points", lambda p: F.transform(p, lambda v, i: F.when(i == 2, v * sign).otherwise(v)))
    return met.withColumn("points", turned).drop("__g", "__z")


def parts_by_pattern(path: Column, pattern: str, groups: dict[str, int | str]) -> Column:
    """Struct of the groups, by number, of a regular expression found in a file's stem; null where it is not found. A text in place of a number names a part of ``name_parts`` to fall back on."""
    stem = F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")
    there = F.regexp_like(stem, F.lit(pattern))
    part = lambda g: F.when(there, F.regexp_extract(stem, pattern, g)) if isinstance(g, int) else name_parts(path)[g]
    return F.struct(*[part(g).alias(n) for n, g in groups.items()])
