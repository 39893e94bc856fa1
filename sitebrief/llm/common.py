"""Shared helpers: row-wise Arrow maps that keep one text in work at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from sitebrief.session import read_table, scratch_path, ship_package

# What separates words in the operators' contracts.
SPACE = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return read_table(spark, sf_dir, "documents")


def schema_of(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)


def map_texts(df: DataFrame, make: Callable[[], Callable[[str], tuple]], ddl: str, key: str = "doc_id",
              text: str = "text") -> DataFrame:
    """One output row per input row: the key, then what ``make()(text)`` returns. A null text counts as empty.

    ``make`` runs once per task, so that tables of a scan are built once and not shipped.
    """
    columns = df.select(df[key].alias(key), df[text].alias(text))
    out = schema_of(ddl)
    types = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            values = [f(t or "") for t in batch.column(1).to_pylist()]
            columns = list(zip(*values)) or [()] * (len(types) - 1)
            arrays = [batch.column(0).cast(types.field(0).type)]
            arrays += [pa.array(c, types.field(i + 1).type) for i, c in enumerate(columns)]
            yield pa.RecordBatch.from_arrays(arrays, schema=types)

    return columns.mapInArrow(run, out)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the cluster's shared folder; each call gives another one."""
    return scratch_path(spark, name)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage through a Parquet table in the shared folder; its size is then known to the optimizer."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
