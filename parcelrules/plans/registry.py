"""Named queries over a folder of tables, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from parcelrules.session import prepare
from parcelrules.sources import bindings

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECK_SQL: dict[str, str] = {}


class Tables:
    """The domain tables of one folder, bound when asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = prepare(spark), folder

    def __getattr__(self, name: str) -> DataFrame:
        make = bindings.bind if name in bindings.BINDINGS else bindings.load
        table = make(self.spark, self.folder, name)
        setattr(self, name, table)
        return table


def query(name: str, sql: str | None = None, uses: tuple[str, ...] = (), types: dict[str, str] | None = None):
    """Register ``fn(tables)``; ``sql`` may name the bindings listed in ``uses``.

    ``types`` casts result columns of the SQL to the types of the query, where
    the SQL's literals would give them narrower ones.
    """

    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            casts = ", ".join(f"CAST({c} AS {t}) AS {c}" for c, t in (types or {}).items())
            body = with_bindings(sql, uses)
            CHECK_SQL[name] = f"SELECT * REPLACE ({casts}) FROM ({body})" if casts else body
        return fn

    return register


def with_bindings(sql: str, uses: tuple[str, ...], extra: dict[str, str] | None = None) -> str:
    parts = [f"{n} AS ({bindings.ansi(n)})" for n in uses]
    parts += [f"{n} AS ({q})" for n, q in (extra or {}).items()]
    if not parts:
        return sql
    body = sql.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {', '.join(parts)}, {body[5:]}"
    return f"WITH {', '.join(parts)} {body}"


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    """Doubles rounded, so that the order of summation does not show."""
    doubles = {n for n, t in df.dtypes if t == "double"}
    return df.select(*[F.round(F.col(f"`{c}`"), digits).alias(c) if c in doubles else F.col(f"`{c}`")
                       for c in df.columns])
