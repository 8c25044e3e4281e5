"""Allow and block lists over addresses: one trie of reversed host labels and path segments, sent to every executor."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VERDICTS = ("allow", "block")

#: The rules of the registered query: verdict, host, path.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

JUDGED = "struct<rule:string,verdict:string>"


@dataclass(frozen=True)
class UrlConfig:
    #: Verdict where no rule fits.
    default: str = "allow"
    #: Characters of all rules up to which they become one broadcast trie; longer lists are joined instead, with the same result.
    most_chars: int = 32_000_000


def host_of(url: Column) -> Column:
    """From the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty for null or no ``://``."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """From the host's end to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _node() -> dict:
    """A host label or a path segment. ``tails``: what a path must go on with, and the rule and verdict of each; ``lengths``: theirs, falling. Plain data, so that executors need no class."""
    return {"below": {}, "paths": None, "tails": {}, "lengths": []}


def build_trie(rules: Iterable[tuple[str, str, str]]) -> tuple[dict, int, int]:
    """The root of a trie of (verdict, host, path), its most host labels and its most path pieces. Of two rules for one host and path that disagree, block holds."""
    root, most_labels, most_pieces = _node(), 0, 0
    for verdict, host, path in rules:
        node, labels = root, host.split(".")[::-1] if host else []
        for label in labels:
            node = node["below"].setdefault(label, _node())
        node["paths"] = node["paths"] or _node()
        node, pieces = node["paths"], path.split("/")
        for piece in pieces[:-1]:
            node = node["below"].setdefault(piece, _node())
        most_labels, most_pieces = max(most_labels, len(labels)), max(most_pieces, len(pieces))
        if node["tails"].get(pieces[-1], ("", ""))[1] != "block":
            node["tails"][pieces[-1]] = (host + path, verdict)
            if len(pieces[-1]) not in node["lengths"]:
                node["lengths"] = sorted([*node["lengths"], len(pieces[-1])], reverse=True)
    return root, most_labels, most_pieces


def find(trie: tuple[dict, int, int], host: str, path: str) -> tuple[str, str] | None:
    """Rule and verdict of the longest match: most host labels first, then the longest path."""
    root, most_labels, most_pieces = trie
    node, hosts, pieces = root, [root], None
    for label in reversed(host.rsplit(".", most_labels)) if host else ():
        node = node["below"].get(label)
        if node is None:
            break
        hosts.append(node)
    for at in reversed(hosts):
        if at["paths"] is None:
            continue
        if pieces is None:
            pieces = path.split("/", most_pieces)
        way = [at["paths"]]
        for piece in pieces[:-1]:
            below = way[-1]["below"].get(piece)
            if below is None:
                break
            way.append(below)
        for node, piece in zip(reversed(way), reversed(pieces[: len(way)]), strict=True):
            for n in node["lengths"]:
                if n <= len(piece) and (found := node["tails"].get(piece[:n])):
                    return found
    return None


def rule_table(spark: SparkSession, rules: Iterable[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


def _usable(rules: DataFrame) -> DataFrame:
    """Rules with a verdict and a host; a null path is an empty one, hosts become lower case. Paths that start otherwise than with ``/`` fit nothing and go."""
    host = F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    kept = rules.select("verdict", host.alias("host"), F.coalesce("path", F.lit("")).alias("path"))
    return kept.where(F.col("verdict").isin(*VERDICTS) & F.col("host").isNotNull() & ((F.col("path") == "") | F.startswith("path", F.lit("/"))))


def judge(pages: DataFrame, rules: DataFrame, config: UrlConfig = UrlConfig()) -> DataFrame:
    """``row`` (all input columns), host, path, rule and verdict of every page by its column ``url``.

    A rule (verdict, host, path) fits its host and all hosts under it where the url's path starts with the rule's, an
    empty rule path fits all. Of the rules that fit, the one with most host labels wins, then the one with the longest
    path, then block. Rules without verdict or host are left out. Where none fits, as for a null url or one without
    ``://``, rule is null and the verdict is the default. Ports and user names count as parts of the host, as they
    stand. Rules are collected only if all of them together are short enough (``most_chars``); longer lists are
    joined on (host, path) prefixes. Repeated rows are judged each; an empty table gives an empty result.
    """
    if config.default not in VERDICTS:
        raise ValueError(f"no verdict: {config.default}")
    placed = pages.select(F.struct("*").alias("row")).select("row", host_of(F.col("row.url")).alias("host"), path_of(F.col("row.url")).alias("path"))
    usable = _usable(rules)
    chars = usable.agg(F.sum(F.char_length("host") + F.char_length("path") + 16)).first()[0]
    judged = _by_join(placed, usable, config) if (chars or 0) > config.most_chars else _by_trie(placed, usable, config)
    return judged.select("row", "host", "path", "judged.rule", "judged.verdict")


def _by_trie(placed: DataFrame, rules: DataFrame, config: UrlConfig) -> DataFrame:
    trie = build_trie(tuple(r) for r in rules.select("verdict", "host", "path").collect())
    shared = placed.sparkSession.sparkContext.broadcast(trie)
    none = (None, config.default)

    @F.arrow_udf(JUDGED)
    def look_up(hosts: pa.Array, paths: pa.Array) -> pa.Array:
        found = [find(shared.value, h, p) or none for h, p in zip(hosts.to_pylist(), paths.to_pylist(), strict=True)]
        return pa.StructArray.from_arrays([pa.array([x[i] for x in found], pa.string()) for i in (0, 1)], names=["rule", "verdict"])

    return placed.withColumn("judged", look_up("host", "path"))


def _by_join(placed: DataFrame, rules: DataFrame, config: UrlConfig) -> DataFrame:
    """The same verdicts for any number of rules: each distinct address meets the rules on all its (host, path) prefixes of the lengths that rules have."""
    one = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # "block" is after "allow"
    lengths = [r[0] for r in one.select(F.char_length("path")).distinct().collect()]
    distinct = placed.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    suffixes = F.array_distinct(F.concat(ends, F.array(F.lit(""))))
    met = distinct.select("host", "path", F.explode(suffixes).alias("__host")).select("*", F.explode(F.array(*[F.lit(n) for n in lengths])).alias("__n"))
    met = met.where(F.char_length("path") >= F.col("__n")).withColumn("__path", F.substr("path", F.lit(1), F.col("__n")))
    fits = met.join(one.select(F.col("host").alias("__host"), F.col("path").alias("__path"), "verdict"), ["__host", "__path"])
    depth = F.when(F.col("__host") == "", 0).otherwise(F.size(F.split("__host", r"\.")))
    best = fits.groupBy("host", "path").agg(F.max(F.struct(depth.alias("labels"), "__n", F.concat("__host", "__path").alias("rule"), "verdict")).alias("best"))
    known = best.select(F.col("host").alias("__h"), F.col("path").alias("__p"), F.struct("best.rule", "best.verdict").alias("known"))
    joined = placed.join(known, (F.col("host") == F.col("__h")) & (F.col("path") == F.col("__p")), "left")
    return joined.withColumn("judged", F.coalesce("known", F.struct(F.lit(None).cast("string").alias("rule"), F.lit(config.default).alias("verdict"))))


def keep_allowed(pages: DataFrame, rules: DataFrame, config: UrlConfig = UrlConfig()) -> DataFrame:
    """The pages whose address is allowed, with their own columns."""
    return judge(pages, rules, config).where("verdict = 'allow'").select("row.*")
