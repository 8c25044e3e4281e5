"""Text helpers: slugs, labels and path parts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def slug(gloss: Column) -> Column:
    """Lower case, dashes as underscores."""
    return F.replace(F.lower(gloss), F.lit("-"), F.lit("_"))


def norm(gloss: Column) -> Column:
    """Letters only, lower case."""
    return F.regexp_replace(F.lower(gloss), "[^a-z]", "")


def slug_direct(gloss: Column) -> Column:
    """Lower case, other characters than letters and digits as single underscores, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(gloss), "[^a-z0-9]+", "_"), F.lit("_"))


def pretty_category(category: Column, labels: dict[str, str]) -> Column:
    """Given label, else the slug in title case."""
    known = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair]) if labels else F.lit(None).cast("map<string,string>")
    return F.coalesce(known[category], F.initcap(F.replace(category, F.lit("_"), F.lit(" "))))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Part after the last dot of the base name, lower case; empty if there is none."""
    return F.lower(F.regexp_extract(basename(path), r"\.([^.]+)$", 1))


def swap_prefix(path: Column, old: str, new: str) -> Column:
    return F.when(path.startswith(old), F.concat(F.lit(new), F.substring(path, len(old) + 1, 1_000_000))).otherwise(path)


def embed_ids(page: Column, most: int = 3) -> Column:
    """11-character video ids of embeds in a page, first seen first, at most ``most``."""
    return F.slice(F.array_distinct(F.regexp_extract_all(page, F.lit(r"(?:embed/|watch\?v=|youtu\.be/)([A-Za-z0-9_-]{11})"), F.lit(1))), 1, most)


def null_if_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def month_day(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "MMM d"), F.lit("—"))
