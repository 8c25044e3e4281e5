"""All registered queries of the library and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lernspur.plans import boxes, corpus, curation, evaluation, hints, landmarks, learner, published, tracking, trajectory

PLANS = (learner, corpus, evaluation, boxes, trajectory, landmarks, tracking, hints, published, curation)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for plan in PLANS for name, (query, _) in plan.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for plan in PLANS for name, (_, sql) in plan.QUERIES.items() if sql}
