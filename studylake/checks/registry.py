"""Named queries with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from hashlib import md5
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from studylake.checks.fixtures import BASE, FIXTURES, STORED, needed
from studylake.functions.stage import shared_folder


class Check(NamedTuple):
    run: Callable[[Tables], DataFrame]
    sql: str | None


_WRITTEN: dict[tuple[str, str, str], str] = {}


class Tables:
    """Base and derived tables of one data folder, as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE:
            return self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        if name in STORED:
            return self._stored(name)
        return self._derived(name)

    def _derived(self, name: str) -> DataFrame:
        sql = with_tables(f"select * from {name}", name)
        for base in BASE:
            if base in sql:
                getattr(self, base).createOrReplaceTempView(base)
        return self.spark.sql(sql)

    def _stored(self, name: str) -> DataFrame:
        app = self.spark.sparkContext.applicationId
        if (app, self.dir, name) not in _WRITTEN:
            path = f"{shared_folder(self.spark)}/{md5(self.dir.encode()).hexdigest()[:8]}/{name}"
            self._derived(name).write.mode("overwrite").parquet(path)
            _WRITTEN[app, self.dir, name] = path
        return self.spark.read.parquet(_WRITTEN[app, self.dir, name])


REGISTRY: dict[str, Check] = {}


def with_tables(body: str, *names: str) -> str:
    """Puts the SQL of the derived tables in front of ``body``; ``body`` may start with ``with``."""
    ctes = ",\n".join(f"{n} as (\n{FIXTURES[n].strip()}\n)" for n in needed(names))
    body = body.strip()
    if not ctes:
        return body
    if body.lower().startswith("with recursive "):
        return f"with recursive {ctes},\n{body[15:]}"
    if body.lower().startswith("with "):
        return f"with {ctes},\n{body[5:]}"
    return f"with {ctes}\n{body}"


def check(name: str, sql: str | None = None, *tables: str):
    """Registers a query; ``tables`` are the derived tables its SQL uses."""

    def register(fn: Callable[[Tables], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"{name} registered twice")
        REGISTRY[name] = Check(fn, with_tables(sql, *tables) if sql else None)
        return fn

    return register
