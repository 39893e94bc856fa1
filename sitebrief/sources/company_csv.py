"""Company lists in CSV: company_name, website_url and, optionally, industry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REQUIRED = ["company_name", "website_url"]


class CsvHeaderError(ValueError):
    """The file has no header, or lacks a required column."""


def read_companies(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, empty instead of null. A byte order mark before the header is ignored.

    Quoted fields may hold line breaks, so a file is one split; many files are read in parallel.
    """
    raw = (
        spark.read.option("header", True).option("inferSchema", False).option("multiLine", True)
        .option("escape", '"').option("mode", "PERMISSIVE").option("encoding", "UTF-8").csv(path)
    )
    df = raw.toDF(*[c.lstrip("\ufeff").strip('"') for c in raw.columns]) if raw.columns else raw
    if not [c for c in df.columns if c.strip()] or all(c.startswith("_c") for c in df.columns):
        raise CsvHeaderError("CSV file is empty or has no headers")
    missing = [c for c in REQUIRED if c not in df.columns]
    if missing:
        raise CsvHeaderError(f"Missing required columns: {', '.join(missing)}")
    if "industry" not in df.columns:
        df = df.withColumn("industry", F.lit(""))
    return df.fillna("", [*REQUIRED, "industry"])
