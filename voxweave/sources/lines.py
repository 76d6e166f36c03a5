"""Lines of text as a table or a stream: blank lines go, and a line exit or quit is not read as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STOP = ("exit", "quit")


def lines(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """(value) of every line with text in the files at path. Files have no common order, so no line ends the others."""
    read = (spark.readStream if stream else spark.read).text(path)
    return read.where((F.trim("value") != "") & ~F.trim("value").isin(*STOP))
