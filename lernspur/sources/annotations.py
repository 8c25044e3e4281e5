"""Readers of keypoint and box annotations: JSON files as tables of images with their people, hands or boxes.

An annotation file of one JSON document is read by one task, as Spark reads such files; everything after that is rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_IMAGES = "images array<struct<id: long, file_name: string, width: int, height: int>>"
POINT = "struct<x: double, y: double, v: double>"


def images_to_annotations(doc: DataFrame) -> DataFrame:
    """One row per annotation with its image's name and extent; annotations of unknown images go."""
    images = doc.select(F.inline("images")).withColumnRenamed("id", "image_id")
    return doc.select(F.inline("annotations")).join(images, "image_id")


def triples(flat: Column) -> Column:
    """A flat list x, y, v, x, y, v as points."""
    n = F.floor(F.size(flat) / 3).cast("int")
    at = lambda i: F.struct(*[F.get(flat, i * 3 + k).alias(c) for k, c in enumerate(("x", "y", "v"))])
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), at))


def box_corners(xywh: Column, least: float = 0.0) -> Column:
    """[x, y, w, h] as [x0, y0, x1, y1]; null where it has not four values or no extent above ``least``."""
    x, y, w, h = (F.get(xywh, F.lit(i)) for i in range(4))
    return F.when((F.size(xywh) == 4) & (w > least) & (h > least), F.array(x, y, x + w, y + h))


def upper_body(points: Column) -> Column:
    """Nose, neck, right and left shoulder, elbow and wrist of 17 body points; the neck stands between the visible shoulders."""
    at = lambda i: F.get(points, F.lit(i))
    left, right = at(5), at(6)
    neck = lambda x, y, v: F.struct(x.alias("x"), y.alias("y"), F.lit(v).alias("v"))
    both = neck((left["x"] + right["x"]) / 2, (left["y"] + right["y"]) / 2, 2.0)
    middle = F.when((left["v"] > 0) & (right["v"] > 0), both).when(left["v"] > 0, neck(left["x"], left["y"], 1.0)).when(right["v"] > 0, neck(right["x"], right["y"], 1.0)).otherwise(neck(F.lit(0.0), F.lit(0.0), 0.0))
    return F.array(at(0), middle, right, left, at(8), at(7), at(10), at(9))


def read_body_poses(spark: SparkSession, path: str, category: int = 1) -> DataFrame:
    """Images with their persons (bbox, 8 keypoints); persons need a visible point of shoulder, elbow or wrist."""
    note = "struct<image_id: long, category_id: int, keypoints: array<double>, bbox: array<double>>"
    doc = spark.read.schema(f"{_IMAGES}, annotations array<{note}>").option("multiLine", True).json(path)
    each = images_to_annotations(doc).where((F.col("category_id") == category) & (F.size("keypoints") >= 51))
    posed = each.withColumn("p", upper_body(triples(F.col("keypoints")))).where(F.exists(F.slice("p", 3, 6), lambda q: q["v"] > 0))
    x, y, w, h = (F.get("bbox", F.lit(i)) for i in range(4))
    person = F.struct(F.array(x, y, x + w, y + h).alias("bbox"), F.col("p").alias("keypoints"))
    return posed.groupBy("image_id", "file_name", "width", "height").agg(F.sort_array(F.collect_list(person)).alias("persons"))


def read_hand_points(spark: SparkSession, path: str, least_visible: int = 6) -> DataFrame:
    """Images with their hands (bbox, 21 keypoints): valid hands with 63 values and enough visible points; a hand without a box gets that of its visible points."""
    sides = ", ".join(f"{s}hand_valid: boolean, {s}hand_kpts: array<double>, {s}hand_box: array<double>" for s in ("left", "right"))
    doc = spark.read.schema(f"{_IMAGES}, annotations array<struct<image_id: long, {sides}>>").option("multiLine", True).json(path)
    side = lambda s: F.struct(F.lit(s).alias("side"), F.col(f"{s}hand_valid").alias("valid"), F.col(f"{s}hand_kpts").alias("flat"), F.col(f"{s}hand_box").alias("box"))
    each = images_to_annotations(doc).select("image_id", "file_name", "width", "height", F.inline(F.array(side("left"), side("right"))))
    good = each.where(F.col("valid") & (F.size("flat") == 63)).withColumn("keypoints", triples(F.col("flat")))
    seen = good.withColumn("seen", F.filter("keypoints", lambda p: p["v"] > 0)).where(F.size("seen") >= least_visible)
    edge = lambda f, c: f(F.transform("seen", lambda p: p[c]))
    own = F.array(edge(F.array_min, "x"), edge(F.array_min, "y"), edge(F.array_max, "x"), edge(F.array_max, "y"))
    boxed = seen.withColumn("bbox", F.coalesce(box_corners(F.col("box"), 1.0), own))
    return boxed.groupBy("image_id", "file_name", "width", "height").agg(F.sort_array(F.collect_list(F.struct("bbox", "keypoints", "side"))).alias("hands"))


def read_box_maps(spark: SparkSession, root: str, width: int = 1920, height: int = 1080, least: float = 4.0) -> DataFrame:
    """Images of maps {id: {bboxes}} with boxes in pixels: nothing but the boxes is read; small and empty ones go, and images without any. The class is the file's name."""
    raw = spark.read.option("wholetext", True).text(root).select(F.regexp_extract("_metadata.file_name", r"^(.*)\.[^.]*$", 1).alias("label"), F.from_json("value", "map<string, struct<bboxes: array<array<double>>>>").alias("m"))
    each = raw.select("label", F.explode("m").alias("image", "entry"))
    good = F.filter("entry.bboxes", lambda b: (F.size(b) >= 4) & (F.get(b, F.lit(2)) * width >= least) & (F.get(b, F.lit(3)) * height >= least))
    pixels = F.transform(good, lambda b: F.array(b[0] * width, b[1] * height, (b[0] + b[2]) * width, (b[1] + b[3]) * height))
    return each.select("label", "image", F.lit(width).alias("width"), F.lit(height).alias("height"), pixels.alias("bboxes")).where(F.size("bboxes") > 0)


def read_parallel_points(spark: SparkSession, xyz_path: str, k_path: str, unique: int = 32560) -> DataFrame:
    """Row i of two parallel JSON arrays, points [x, y, z] and camera matrices, joined by place: points in pixels (null for a point without depth) and their depth from the wrist."""
    from lernspur.operators.landmarks import relative_depth

    def rows(path: str, kind: str, name: str) -> DataFrame:
        whole = spark.read.option("wholetext", True).text(path).select(F.from_json("value", f"array<{kind}>").alias("a"))
        return whole.select(F.posexplode("a").alias("i", name))

    both = rows(xyz_path, "array<array<double>>", "xyz").where(F.col("i") < unique).join(rows(k_path, "array<array<double>>", "k"), "i")
    dot = lambda row, p: sum(F.get(row, F.lit(j)) * F.get(p, F.lit(j)) for j in range(3))
    flat = F.transform("xyz", lambda p: F.struct(*[F.try_divide(dot(F.get("k", F.lit(i)), p), dot(F.get("k", F.lit(2)), p)).alias(c) for i, c in enumerate("xy")]))
    return both.select("i", flat.alias("keypoints"), relative_depth(F.col("xyz")).alias("depth"))


def read_sidecar_points(spark: SparkSession, root: str, n: int = 21) -> DataFrame:
    """Images with a JSON file beside them that lists their points; files with another number of points go."""
    raw = spark.read.schema("hand_pts array<array<double>>, is_left double").option("multiLine", True).option("recursiveFileLookup", True).json(root)
    named = raw.select(F.regexp_extract("_metadata.file_name", r"^(.*)\.[^.]*$", 1).alias("image"), F.col("is_left").cast("boolean").alias("is_left"), F.transform("hand_pts", lambda p: F.struct(p[0].alias("x"), p[1].alias("y"), F.get(p, F.lit(2)).alias("v"))).alias("keypoints"))
    return named.where(F.size("keypoints") == n)


def read_combined_points(spark: SparkSession, path: str, n: int = 21) -> DataFrame:
    """Images of one file {root: [{img_paths, img_width, img_height, joint_self}]}; records of another number of points or without an image go. A missing size is 0."""
    record = "struct<img_paths: string, img_width: int, img_height: int, joint_self: array<array<double>>>"
    raw = spark.read.option("wholetext", True).text(path).select(F.from_json("value", f"struct<root: array<{record}>>").alias("d")).select(F.inline("d.root"))
    points = F.transform("joint_self", lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"), F.get(p, F.lit(2)).alias("v")))
    named = raw.where((F.size("joint_self") == n) & (F.col("img_paths") != ""))
    return named.select(F.col("img_paths").alias("image"), *[F.coalesce(c, F.lit(0)).alias(a) for c, a in (("img_width", "width"), ("img_height", "height"))], points.alias("keypoints"))


def read_point_subsets(spark: SparkSession, root: str, subsets: dict[str, str], tags: list[str], n: int = 21) -> DataFrame:
    """Images of the subsets chosen by tag (tag -> folder under ``root``), each with its ``tag``: of a combined file ``hands_v*.json`` where the folder has one, else of the sidecar files. Unknown tags and missing folders give nothing."""
    out = spark.createDataFrame([], "tag string, image string, width int, height int, keypoints array<struct<x: double, y: double, v: double>>")
    for tag in tags:
        if tag not in subsets:
            continue
        folder = f"{root}/{subsets[tag]}"
        found = None
        for read in (lambda: read_combined_points(spark, f"{folder}/hands_v*.json", n), lambda: read_sidecar_points(spark, folder, n).select("image", F.lit(0).alias("width"), F.lit(0).alias("height"), "keypoints")):
            try:
                found = read()
                break
            except Exception as missing:
                if "PATH_NOT_FOUND" not in str(missing):
                    raise
        if found is not None:
            out = out.unionByName(found.select(F.lit(tag).alias("tag"), "image", "width", "height", "keypoints"))
    return out


def read_timed_clips(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Clips of split files (a JSON array each) with start and end seconds; the split is in the file's name, a missing start is 0."""
    kind = "clean_text: string, label: long, url: string, start_time: double, end_time: double, signer_id: long, box: array<double>, fps: double, width: double, height: double"
    raw = spark.read.option("wholetext", True).text(paths).select(F.regexp_extract(F.lower("_metadata.file_name"), r"(train|val|test)", 1).alias("split"), F.from_json("value", f"array<struct<{kind}>>").alias("a"))
    rows = raw.select("split", F.inline("a")).withColumn("gloss", F.lower("clean_text")).withColumn("start_time", F.coalesce("start_time", F.lit(0.0)))
    return rows.where("url IS NOT NULL").drop("clean_text")


def points_to_pose(points: DataFrame) -> DataFrame:
    """8 keypoints per image from point ids 0 to 15 (0-5 legs, 6 pelvis, 7 thorax, 8 neck, 9 head top, 10-12 right wrist to shoulder, 13-15 left shoulder to wrist); the neck falls back on the thorax, the head top stands for the nose with low visibility. ``points`` has image, id, x, y, v."""
    held = points.groupBy("image").agg(F.map_from_entries(F.collect_list(F.struct("id", F.struct("x", "y", "v")))).alias("m"))
    none = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("v"))
    at = lambda i: F.coalesce(F.try_element_at("m", F.lit(i)), none)
    top = F.try_element_at("m", F.lit(9))
    nose = F.when(top.isNotNull(), F.struct(top["x"].alias("x"), top["y"].alias("y"), F.lit(1.0).alias("v"))).otherwise(none)
    neck = F.coalesce(F.try_element_at("m", F.lit(8)), F.try_element_at("m", F.lit(7)), none)
    return held.select("image", F.array(nose, neck, at(12), at(13), at(11), at(14), at(10), at(15)).alias("keypoints"))


def project_views(joints: DataFrame, cameras: DataFrame) -> DataFrame:
    """Every 3-D frame in every camera: rotation rows r, translation t and focal lengths and centre of a few cameras. Frames need 21 points of three values, cameras all of theirs."""
    whole = joints.where((F.size("xyz") == 21) & F.forall("xyz", lambda p: F.size(p) == 3))
    usable = cameras.where((F.size("r") == 3) & (F.size("t") == 3) & F.col("fx").isNotNull() & F.col("fy").isNotNull())
    met = whole.crossJoin(usable)
    moved = F.transform("xyz", lambda p: F.array(*[sum(F.col("r")[i][j] * p[j] for j in range(3)) + F.col("t")[i] for i in range(3)]))
    flat = F.transform("moved", lambda p: F.struct((F.try_divide(p[0], p[2]) * F.col("fx") + F.col("cx")).alias("x"), (F.try_divide(p[1], p[2]) * F.col("fy") + F.col("cy")).alias("y")))
    return met.withColumn("moved", moved).withColumn("keypoints", flat).select(*[c for c in joints.columns if c != "xyz"], "camera", "keypoints")
