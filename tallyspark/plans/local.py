"""Small driver-side tables with a known schema and size."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def columns_of(ddl: str) -> list[str]:
    return StructType.fromDDL(ddl).names


def local_table(spark: SparkSession, rows: Iterable[tuple], ddl: str) -> DataFrame:
    """A configuration-sized table; the optimizer knows its size, so joins broadcast it."""
    schema = StructType.fromDDL(ddl)
    records = [dict(zip(schema.names, row, strict=True)) for row in rows]
    arrow = pa.Table.from_pylist(records, schema=to_arrow_schema(schema))
    return spark.createDataFrame(arrow, schema)
