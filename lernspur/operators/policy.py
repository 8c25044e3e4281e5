"""Who may see and write which rows: views of the tables for one account."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rule = Callable[[Column], Column]


def own(column: str) -> Rule:
    return lambda user: F.col(column) == user


def everyone(user: Column) -> Column:
    return F.lit(True)


def active(user: Column) -> Column:
    return F.col("is_active")


#: What an account that has signed in may do, by table and verb; all else is denied.
SIGNED_IN: dict[str, dict[str, Rule]] = {
    "users": {"select": own("id"), "update": own("id")},
    "attempts": {"select": own("user_id"), "insert": own("user_id")},
    "mastery_state": {"select": own("user_id"), "insert": own("user_id"), "update": own("user_id")},
    "vocabulary_items": {"select": everyone},
    "confusion_pair_hints": {"select": everyone},
    "model_versions": {"select": active},
}
#: Others see nothing.
ROLES: dict[str, dict[str, dict[str, Rule]]] = {"authenticated": SIGNED_IN, "anon": {}}


def visible(tables: dict[str, DataFrame], user: Column, role: str = "authenticated") -> dict[str, DataFrame]:
    """The tables that a role may read, each with its visible rows only; tables without a rule are left out. The rules are plain conditions, which Spark pushes down to the scan."""
    return {name: df.where(ROLES[role][name]["select"](user)) for name, df in tables.items() if "select" in ROLES[role].get(name, {})}


def open_views(tables: dict[str, DataFrame], user: Column, role: str = "authenticated", prefix: str = "") -> list[str]:
    """Temporary views of the visible tables, for SQL; returns their names."""
    names = []
    for name, df in visible(tables, user, role).items():
        df.createOrReplaceTempView(f"{prefix}{name}")
        names.append(f"{prefix}{name}")
    return names


def denied(rows: DataFrame, table: str, verb: str, user: Column, role: str = "authenticated", old: DataFrame | None = None, key: str | None = None) -> DataFrame:
    """The rows that a role may not insert or update in a table; none means that the write is allowed.

    An update is denied for rows that are not visible to it before or would not be after: give the table as ``old``
    and its ``key``. A verb without a rule denies all rows.
    """
    rule = ROLES[role].get(table, {}).get(verb)
    if rule is None:
        return rows
    may = F.coalesce(rule(user), F.lit(False))
    bad = rows.where(~may)
    if verb == "update" and old is not None and key is not None:
        hidden = old.where(~may).select(key)
        bad = bad.unionByName(rows.where(may).join(hidden, key, "left_semi"))
    return bad


def checked(rows: DataFrame, table: str, verb: str, user: Column, role: str = "authenticated", old: DataFrame | None = None, key: str | None = None) -> DataFrame:
    """``rows`` if all of them may be written, else raises PermissionError."""
    if not denied(rows, table, verb, user, role, old, key).isEmpty():
        raise PermissionError(f"{role} may not {verb} these rows of {table}")
    return rows
