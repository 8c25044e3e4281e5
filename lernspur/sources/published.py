"""Sinks that others read while they are written: versioned manifests, and templates as nested JSON.

A manifest is written to a folder of its own, records and summary together,
and becomes visible by one small file appended to ``<path>/published``. Until
then, and if anything fails before, readers see the version before.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lernspur.operators.landmarks import settled

POINTER = "seq long, version string, folder string, published_at timestamp"
SUMMARY = "version string, n_records long, num_classes long, classes array<string>, split_counts map<string, long>, skipped map<string, long>, dropped long, settings map<string, string>, record_schema string"


def _versions(spark: SparkSession, path: str) -> DataFrame:
    """The pointers of a manifest; none where nothing was published."""
    try:
        return spark.read.schema(POINTER).json(f"{path}/published")
    except Exception as missing:
        if "PATH_NOT_FOUND" in str(missing):
            return spark.createDataFrame([], POINTER)
        raise


def summarize(records: DataFrame, version: str, skipped: DataFrame | None = None, dropped: DataFrame | None = None, settings: dict[str, str] | None = None) -> DataFrame:
    """One row (SUMMARY): classes in order, records of every split, skipped rows by reason, and how many were dropped as copies.

    ``skipped`` has a column reason, a row each; of ``dropped`` only the rows are counted. Classes and splits are as
    many as the vocabulary and the names of splits, reasons as many as there are rules.
    """
    spark = records.sparkSession
    counted = lambda df, key: df.groupBy(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("k")).agg(F.count("*").alias("n"))
    as_map = lambda df, name: df.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias(name))
    nothing = spark.createDataFrame([], "k string, n long")
    classes = records.where("sign_id IS NOT NULL").select("sign_id").distinct().agg(F.array_sort(F.collect_list(F.col("sign_id").cast("string"))).alias("classes"))
    one = records.agg(F.count("*").alias("n_records")).join(classes).join(as_map(counted(records, "split"), "split_counts"))
    one = one.join(as_map(counted(skipped, "reason") if skipped is not None else nothing, "skipped"))
    one = one.join(dropped.agg(F.count("*").alias("dropped")) if dropped is not None else spark.range(1).select(F.lit(0).cast("long").alias("dropped")))
    given = F.create_map(*[F.lit(x) for pair in sorted((settings or {}).items()) for x in pair]).cast("map<string,string>")
    return one.select(F.lit(version).alias("version"), "n_records", F.size("classes").cast("long").alias("num_classes"), "classes", "split_counts", "skipped", "dropped", given.alias("settings"), F.lit(records.schema.json()).alias("record_schema"))


def publish_manifest(records: DataFrame, path: str, version: str, skipped: DataFrame | None = None, dropped: DataFrame | None = None, settings: dict[str, str] | None = None) -> str:
    """Writes records (by split) and their summary, then publishes both at once; returns the folder.

    A version may be published again: readers take the latest. What a failed run left in its folder is never read.
    """
    spark = records.sparkSession
    folder = f"versions/{version}-{uuid.uuid4().hex}"
    records.write.partitionBy("split").parquet(f"{path}/{folder}/records")
    # the summary is of what was written, not of a second run of the plan
    written = spark.read.schema(records.schema).parquet(f"{path}/{folder}/records")
    summarize(written, version, skipped, dropped, settings).coalesce(1).write.parquet(f"{path}/{folder}/summary")
    last = _versions(spark, path).agg(F.max("seq")).first()[0]
    pointer = spark.range(1).select(F.lit((last or 0) + 1).cast("long").alias("seq"), F.lit(version).alias("version"), F.lit(folder).alias("folder"), F.current_timestamp().alias("published_at"))
    pointer.coalesce(1).write.mode("append").json(f"{path}/published")
    return folder


def read_published(spark: SparkSession, path: str, version: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Records and summary of the latest published manifest, or of the latest of one version; raises LookupError where there is none."""
    found = _versions(spark, path)
    found = found if version is None else found.where(F.col("version") == version)
    latest = found.orderBy(F.desc("seq"), F.desc("folder")).first()
    if latest is None:
        raise LookupError(f"nothing published at {path}" + (f" as {version}" if version else ""))
    folder = f"{path}/{latest['folder']}"
    summary = spark.read.schema(SUMMARY).parquet(f"{folder}/summary")
    schema = T.StructType.fromJson(json.loads(summary.first()["record_schema"]))
    return spark.read.schema(schema).parquet(f"{folder}/records"), summary


# ---- templates

#: The order of pose points and the space of coordinates that readers of the files expect.
POSE_ORDER = ("nose", "neck", "r_sh", "l_sh", "r_el", "l_el", "r_wr", "l_wr")
SPACE = "pose_anchor_subtracted_shoulder_scaled"


def _points(row: Column, first: int, n: int, norm: Column) -> Column:
    """n points from value ``first`` on, in units of ``norm`` and to four decimals; a point that lacks a value is null."""

    def point(i: Column) -> Column:
        x, y = (F.get(row, i * 2 + first + c) / norm for c in (0, 1))
        return F.when(x.isNotNull() & y.isNotNull(), F.array(F.bround(x, 4), F.bround(y, 4)))

    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), point)


def nested_templates(templates: DataFrame, clips: DataFrame | None = None) -> DataFrame:
    """One row a sign for display: sign, frames (hand0, hand1 and pose as point pairs), n_clips, T, one_handed and schema.

    The series is the sign's representative clip, where ``clips`` (sign, traj) has one, else the template's mean. It is
    laid on shoulders one unit apart: the median span over its steps of spans over 1e-3, or 1 without any. Only series
    of 100 features a step are exported.
    """
    shown = templates.select("sign", "n_clips", "one_handed", F.col("mean").alias("series"))
    if clips is not None:
        own = clips.groupBy("sign").agg(F.first("traj").alias("traj"))
        shown = shown.join(own, "sign", "left").withColumn("series", F.coalesce("traj", "series")).drop("traj")
    whole = shown.where((F.size("series") > 0) & F.forall("series", lambda r: F.size(r) == 100))
    spans = F.filter(F.transform("series", lambda r: F.hypot(F.get(r, F.lit(88)) - F.get(r, F.lit(90)), F.get(r, F.lit(89)) - F.get(r, F.lit(91)))), lambda s: s > 1e-3)
    ordered = settled(settled(whole, "series").withColumn("spans", F.array_sort(spans)), "spans")
    middle = (F.get("spans", F.floor((F.size("spans") - 1) / 2).cast("int")) + F.get("spans", F.floor(F.size("spans") / 2).cast("int"))) / 2
    scaled = settled(ordered.withColumn("norm", F.when(F.size("spans") > 0, middle).otherwise(1.0)), "norm")
    frames = F.transform("series", lambda r: F.struct(_points(r, 0, 21, F.col("norm")).alias("hand0"), _points(r, 42, 21, F.col("norm")).alias("hand1"), _points(r, 84, 8, F.col("norm")).alias("pose")))
    schema = F.struct(F.array(*[F.lit(p) for p in POSE_ORDER]).alias("pose_order"), F.lit(SPACE).alias("coord_space"))
    return scaled.select("sign", frames.alias("frames"), "n_clips", F.size("series").alias("T"), F.coalesce("one_handed", F.lit(False)).alias("one_handed"), schema.alias("schema"))


def export_templates(templates: DataFrame, path: str, clips: DataFrame | None = None) -> None:
    """``nested_templates`` as JSON, a line a sign, missing points as null."""
    nested_templates(templates, clips).write.option("ignoreNullFields", False).json(path)


NESTED = "sign string, frames array<struct<hand0: array<array<double>>, hand1: array<array<double>>, pose: array<array<double>>>>, n_clips long, T int, one_handed boolean, schema struct<pose_order: array<string>, coord_space: string>"


def read_templates(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(NESTED).json(path)
