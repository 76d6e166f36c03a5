"""The same SQL functions over streams: a stream of rows in, the stream with one more column out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxweave.functions.dialect import SPARK


def with_reading(stream: DataFrame, function: Callable, column: str, out: str) -> DataFrame:
    """function: one of functions.numerals, scripts or text that takes (dialect, column)."""
    return stream.withColumn(out, F.expr(function(SPARK, column)))
