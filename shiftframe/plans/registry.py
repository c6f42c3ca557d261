"""Registered queries and, where there is one, the same question in SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shiftframe.plans.sql_views import VIEWS
from shiftframe.plans.views import Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def with_views(sql: str, extra: dict[str, str] | None = None) -> str:
    """Put the views that ``sql`` uses, directly or through others, in front of it."""
    known = {**VIEWS, **(extra or {})}
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in known:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(known[name])

    visit(sql)
    parts = [f"{name} AS ({known[name].strip()})" for name in known if name in needed]
    body = sql.strip()
    if not parts:
        return body
    head = ", ".join(parts)
    if re.match(r"WITH\s+RECURSIVE\b", body, re.I):
        return "WITH RECURSIVE " + head + ", " + re.sub(r"^WITH\s+RECURSIVE\s+", "", body, flags=re.I)
    if re.match(r"WITH\b", body, re.I):
        return "WITH " + head + ", " + re.sub(r"^WITH\s+", "", body, flags=re.I)
    return "WITH " + head + " " + body


def query(key: str, sql: str | None = None):
    """Register ``function(views) -> DataFrame`` under ``key``."""

    def register(function: Callable[[Views], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return function(Views(spark, folder))

        run.__name__ = key
        run.__doc__ = function.__doc__
        QUERIES[key] = run
        if sql is not None:
            ORACLE[key] = with_views(sql)
        return function

    return register
