"""What several operators share: tables that cut lineage, prefix sums, connected components."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_ROOTS: dict[str, tuple[SparkSession, str]] = {}
#: Buckets of a prefix sum whose totals are summed together.
UPPER = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir); a temporary one only for local masters."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return "file://" + tempfile.mkdtemp(prefix="voxweave-")


def _drop_all() -> None:
    for spark, root in _ROOTS.values():
        try:
            path = spark._jvm.org.apache.hadoop.fs.Path(root)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # the JVM may be gone at exit; the folder is the application's own
            return


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path under this application's own folder, which goes when the application ends."""
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        if not _ROOTS:
            atexit.register(_drop_all)
        _ROOTS[app] = (spark, f"{shared_dir(spark).rstrip('/')}/voxweave-{app}-{uuid.uuid4().hex[:8]}")
    return f"{_ROOTS[app][1]}/{name}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """df, written as a table in the shared folder and read back: later stages survive the loss of executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    made._written_at = path
    return made


def release(*tables: DataFrame) -> None:
    """Deletes tables that cut() wrote, once their last reader has written its own result, and lets Spark drop the shuffles behind them."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._written_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    spark._jvm.System.gc()  # shuffle files go when the driver no longer holds their plans; else that takes half an hour


def _before(df: DataFrame, group: list[str], order: str | list[str], value: str) -> Column:
    """The sum of value over the rows before this one in its group."""
    by = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    return F.coalesce(F.sum(value).over(by.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def prefix_sum(df: DataFrame, group: list[str], bucket: str, order: list[str], value: str, out: str) -> DataFrame:
    """Adds out: the sum of value over the rows before this one in its group, by (bucket, order).

    No task sees more than one bucket of a group, or the totals of more than UPPER buckets: rows are summed in their
    buckets, the buckets' totals in runs of UPPER, and only the runs' totals (a row for some 20 million rows) in
    one task a group. df is read twice, so it should be a written table.
    """
    total = df.groupBy(*group, bucket).agg(F.sum(value).alias("_total")).withColumn("_run", F.floor(F.col(bucket) / UPPER))
    runs = total.groupBy(*group, "_run").agg(F.sum("_total").alias("_all"))
    runs = runs.withColumn("_first", _before(runs, group, "_run", "_all")).drop("_all")
    base = total.withColumn("_base", _before(total, [*group, "_run"], bucket, "_total")).join(runs, [*group, "_run"])
    base = base.select(*group, bucket, (F.col("_base") + F.col("_first")).alias("_base"))
    own = df.withColumn("_own", _before(df, [*group, bucket], order, value))
    return own.join(base, [*group, bucket]).withColumn(out, (F.col("_base") + F.col("_own")).cast("long")).drop("_base", "_own")


def spread_join(rows: DataFrame, groups: DataFrame, key: str, count: str) -> DataFrame:
    """rows with the columns of their group; groups (a written table) has a row a key and its number of rows.

    Groups with over a 1000th of all rows, of which there are fewer than 1000, are joined by broadcast, so that the
    rows of a hot group stay where they are; the others are joined by a shuffle.
    """
    most = (groups.agg(F.sum(count)).first()[0] or 0) // 1000 + 1
    hot = F.broadcast(groups.where(F.col(count) > most))
    rest = rows.join(hot.select(key), key, "left_anti").join(groups.where(F.col(count) <= most), key)
    return rows.join(hot, key).unionByName(rest)


def buckets(n: int, rows: int = 20_000) -> int:
    return max(1, -(-n // rows))


def _mark(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, u: str, v: str) -> DataFrame:
    """(node, component) for every node of edges; component: the smallest node it reaches.

    Alternates large-star and small-star steps until the edges no longer change. Each round is two
    minima (combined before the shuffle) and two joins, and its edges are written to the shared folder.
    """
    e = edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u > v").distinct()
    e = cut(e, "edges")
    mark = _mark(e)
    while mark[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        seen = large.join(low, "u")
        small = seen.select("u", F.col("m").alias("v")).union(seen.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        old, e = e, cut(small.distinct(), "edges")
        release(old)
        if (now := _mark(e)) == mark:
            break
        mark = now
    top = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(top)
