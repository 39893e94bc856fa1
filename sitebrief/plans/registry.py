"""The query registry and the per-run view of the input tables."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sitebrief.plans.standins import STANDINS
from sitebrief.session import TABLE_SCHEMAS, read_table, ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_FROM = re.compile(r"\b(FROM|JOIN)\s+(" + "|".join(TABLE_SCHEMAS) + r"|v_\w+)\b")


class Tables:
    """Input tables and the stand-in views derived from them, for one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._tag = f"sb{abs(hash(sf_dir)) % 10**8}_"

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLE_SCHEMAS:
            return read_table(self.spark, self.sf_dir, name)
        if name in STANDINS:
            return self.sql(STANDINS[name])
        raise AttributeError(name)

    def sql(self, text: str) -> DataFrame:
        """Run shared SQL over the tables; each name it reads becomes a private view."""
        text = spark_dialect(text)
        for name in {m.group(2) for m in _FROM.finditer(text)}:
            getattr(self, name).createOrReplaceTempView(self._tag + name)
        return self.spark.sql(_FROM.sub(lambda m: f"{m.group(1)} {self._tag}{m.group(2)}", text))


def spark_dialect(text: str) -> str:
    return text.replace("TS_SEC(", "timestamp_seconds(")


def duck_dialect(text: str) -> str:
    return text.replace("TS_SEC(", "make_timestamp(1000000::BIGINT*")


def _used(text: str, seen: list[str]) -> list[str]:
    for m in _FROM.finditer(text):
        name = m.group(2)
        if name.startswith("v_") and name in STANDINS and name not in seen:
            _used(STANDINS[name], seen)
            seen.append(name)
    return seen


def oracle_text(body: str) -> str:
    """Put the stand-in views the check reads in front of it as CTEs."""
    body = body.strip()
    names = _used(body, [])
    recursive = ""
    head = re.match(r"WITH\s+(RECURSIVE\s+)?", body)
    if head:
        recursive = "RECURSIVE " if head.group(1) else ""
        rest = body[head.end():]
    if not names:
        return duck_dialect(body)
    ctes = ",\n".join(f"{n} AS ({STANDINS[n].strip()})" for n in names)
    text = f"WITH {recursive}{ctes}" + (f",\n{rest}" if head else f"\n{body}")
    return duck_dialect(text)


def query(name: str, oracle: str | None = None):
    """Register a plan ``fn(tables) -> DataFrame`` under a name, with its check."""

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            # Times are compared in UTC; the zone is fixed when the plan is analysed.
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            ship_package(spark)
            return fn(Tables(spark, sf_dir))

        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = run
        if oracle:
            ORACLES[name] = oracle_text(oracle)
        return fn

    return register
