"""Readers and writers of clip manifests, gloss lists, split tables and trajectories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "clip_id string, sign_id string, source string, signer_id string, split string, path string, status string"


def read_manifest(spark: SparkSession, paths: list[str], record: str = RECORD) -> DataFrame:
    """Records of JSON files that are a bare list, or an envelope whose list is ``records``, ``clips`` or ``items``."""
    item = f"array<struct<{', '.join(f'{n}: {t}' for n, t in (f.strip().split(' ') for f in record.split(',')))}>>"
    raw = spark.read.option("wholetext", True).text(paths)
    envelope = F.from_json("value", f"struct<records: {item}, clips: {item}, items: {item}>")
    bare = F.when(F.ltrim("value").startswith("["), F.from_json("value", item))
    return raw.select(bare.alias("bare"), envelope.alias("e")).select(F.inline(F.coalesce("bare", "e.records", "e.clips", "e.items")))


def write_manifest(df: DataFrame, path: str) -> None:
    """Records by split, and beside them a summary: clips and classes of every split."""
    df.write.partitionBy("split").parquet(f"{path}/records")
    df.groupBy("split").agg(F.count("*").alias("clips"), F.countDistinct("sign_id").alias("signs")).write.parquet(f"{path}/summary")


def read_gloss_instances(spark: SparkSession, path: str) -> DataFrame:
    """One row per instance of nested gloss JSON; rows without an id or URL go."""
    schema = "gloss string, instances array<struct<video_id: string, url: string, signer_id: long, split: string, frame_start: int, frame_end: int>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select("gloss", F.inline("instances"))
    return rows.where("video_id <> '' AND url <> ''")


def read_split_csvs(spark: SparkSession, paths: list[str], aliases: dict[str, list[str]]) -> DataFrame:
    """CSVs named after their split, columns found by any of their aliases, exactly or else without regard to case."""
    out = None
    for path in paths:
        raw = spark.read.option("header", True).csv(path)
        lower = {c.lower(): c for c in raw.columns}
        pick = lambda names: next((n for n in names if n in raw.columns), None) or next((lower[n.lower()] for n in names if n.lower() in lower), None)
        columns = [(F.col(f"`{c}`") if (c := pick(names)) else F.lit(None).cast("string")).alias(name) for name, names in aliases.items()]
        part = raw.select(*columns, F.regexp_extract(F.col("_metadata.file_name"), r"(train|val|test)", 1).alias("split"))
        out = part if out is None else out.unionByName(part)
    return out


def read_label_csv(spark: SparkSession, path: str) -> DataFrame:
    """Metadata rows with a usable label: not empty, not freetext, no dots."""
    rows = spark.read.option("header", True).csv(path)
    return rows.where((F.col("label") != "") & (F.col("label_type") != "freetext") & ~F.col("label").contains("."))


def read_trajectories(spark: SparkSession, root: str) -> DataFrame:
    """Clips of a tree <sign>/<clip>.json; bad files and clips of fewer than two frames go; the sign is the folder's name."""
    schema = "clip_path string, fps double, frames array<struct<frame_idx: int, hands: array<struct<bbox: array<double>, keypoints: array<array<double>>>>, pose: array<array<double>>>>"
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").option("multiLine", True).option("recursiveFileLookup", True).json(root)
    named = rows.select("*", F.element_at(F.split("_metadata.file_path", "/"), -2).alias("sign"))
    return named.where(F.size("frames") >= 2)


def read_markdown_vocab(spark: SparkSession, path: str, expected: int | None = None) -> DataFrame:
    """(number, gloss, slug) of the rows of a Markdown table | n | gloss | ... |; raises ValueError if there are not as many as ``expected``."""
    from lernspur.functions.text import slug

    cells = spark.read.text(path).select(F.regexp_extract("value", r"^\|\s*(\d+)\s*\|\s*([^|]+?)\s*\|", 1).alias("n"), F.regexp_extract("value", r"^\|\s*(\d+)\s*\|\s*([^|]+?)\s*\|", 2).alias("gloss"))
    rows = cells.where("n <> ''").select(F.col("n").cast("int").alias("number"), "gloss", slug(F.col("gloss")).alias("slug"))
    if expected is not None and (found := rows.count()) != expected:
        raise ValueError(f"{found} rows in {path}, {expected} expected")
    return rows


def read_lexicon_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a Latin-1 CSV with a header; ``__line`` is their order. Names of columns may hold dots."""
    return spark.read.option("header", True).option("encoding", "ISO-8859-1").csv(path).withColumn("__line", F.monotonically_increasing_id())


def lexicon_by(lexicon: DataFrame, key: str, last: bool = False) -> DataFrame:
    """One row for every value of a column (without white space around it, empty ones left out): the first of its rows, or the last, and ``variants``, how many it has."""
    row, k = F.struct(*[F.col(f"`{c}`") for c in lexicon.columns if c != "__line"]), F.trim(F.col(f"`{key}`"))
    pick = F.max_by if last else F.min_by
    best = lexicon.where(k != "").groupBy(k.alias("__k")).agg(pick(row, "__line").alias("__r"), F.count("*").alias("variants"))
    return best.select("__k", "__r.*", "variants").withColumnRenamed("__k", "lexicon_key")


def read_landmark_lines(spark: SparkSession, path: str) -> DataFrame:
    """207-token lines: 98 points, a box, attributes and the image name; shorter lines go."""
    t = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("t")).where(F.size("t") >= 207)
    numbers = lambda a, n: F.transform(F.slice("t", a, n), lambda x: x.cast("double"))
    return t.select(F.element_at("t", 207).alias("image"), numbers(1, 196).alias("coords"), numbers(197, 4).alias("rect"), F.transform(F.slice("t", 201, 6), lambda x: x.cast("int")).alias("attributes"))


def read_block_text_boxes(spark: SparkSession, path: str) -> DataFrame:
    """Boxes of block text: an image line, a count, and a line x y w h ... invalid per box; empty and invalid boxes go."""
    blocks = F.explode(F.regexp_extract_all("value", F.lit(r"([^\n]+\.jpg)\n(\d+)\n((?:[\d .-]+(?:\n|$))*)"), F.lit(0)))
    lines = spark.read.text(path, wholetext=True).select(blocks.alias("b")).select(F.split("b", "\n").alias("l"))
    boxes = lines.select(F.element_at("l", 1).alias("image"), F.posexplode(F.slice("l", 3, F.element_at("l", 2).cast("int"))).alias("box", "line"))
    b = boxes.select("image", "box", F.transform(F.split(F.trim("line"), r"\s+"), lambda x: x.try_cast("double")).alias("v"))
    named = b.select("image", "box", *[F.get("v", F.lit(i)).alias(n) for i, n in enumerate(("x", "y", "w", "h"))], F.coalesce(F.get("v", F.lit(7)), F.lit(0.0)).alias("invalid"))
    return named.where("w > 0 AND h > 0 AND invalid = 0").drop("invalid")


def parse_seed_values(text: Column) -> Column:
    """(id, code, match) of every tuple ('id', 'code', 'match') in SQL text."""
    found = F.regexp_extract_all(text, F.lit(r"\(\s*'([^']*)'\s*,\s*'([^']*)'\s*,\s*'([^']*)'"), F.lit(0))
    part = lambda x, i: F.regexp_extract(x, r"\(\s*'([^']*)'\s*,\s*'([^']*)'\s*,\s*'([^']*)'", i)
    return F.transform(found, lambda x: F.struct(part(x, 1).alias("id"), part(x, 2).alias("code"), part(x, 3).alias("match")))


def verify_checksums(spark: SparkSession, path: str, expected: DataFrame) -> DataFrame:
    """Every file's SHA-256 and whether it is as expected (null where nothing is). ``expected`` has file and sha256."""
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("found"))
    return files.join(expected, "file", "left").select("file", "found", (F.col("found") == F.lower("sha256")).alias("ok"))


def check_allowed_fields(df: DataFrame, allowed: set[str], forbidden: set[str]) -> None:
    """Raises if the schema has other columns than the allowed ones, or names with a forbidden part."""
    extra = sorted(c for c in df.columns if c not in allowed)
    named = sorted(c for c in df.columns if any(f in c.lower() for f in forbidden))
    if extra or named:
        raise ValueError(f"columns not allowed: {extra}; forbidden names: {named}")
