"""Where queries and their SQL are listed by name."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import session

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return add


def shown(c, sep: str = "|"):
    """An array as text."""
    return F.array_join(c, sep)


def fresh_folder(spark: SparkSession, label: str) -> str:
    """The path of a new folder in the shared one."""
    return f"{session.shared_folder(spark)}/idiomill-{label}-{uuid.uuid4().hex}"
