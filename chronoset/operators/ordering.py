"""Global row numbers without a global window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoset.sources.scratch import settle


def numbered(df: DataFrame, *order: str | Column, name: str = "place", partitions: int | None = None) -> DataFrame:
    """``df`` with the place of each row, from 0, in the given order; rows that tie in all of it follow each other in any order.

    Rows are range-partitioned by the order, sorted and written once with their place within the partition. What the
    partitions before hold is a running sum over one row for each partition, which is broadcast.
    """
    columns = [F.col(c) if isinstance(c, str) else c for c in order]
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sort = df.repartitionByRange(n, *columns).sortWithinPartitions(*columns)
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    held = settle(sort.select("*", F.spark_partition_id().alias("__part"), inside.alias("__inside")), "numbered")
    counts = held.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    return held.join(F.broadcast(offsets), "__part").withColumn(name, F.col("__before") + F.col("__inside")).drop("__part", "__inside", "__before")


def running_sum(df: DataFrame, value: Column, by: tuple[str, ...], *order: str | Column, name: str = "upto", place: str | None = None) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows of its group (``by``) up to and including each row, in order.

    Rows are range-partitioned by group and order. Sums run within the parts of groups that lie in one partition, and
    start from the total of the group's parts before. With ``place`` rows also get their place in the whole order.
    """
    rows = numbered(df.withColumn("__value", value), *by, *order, name="__place")
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = max(1, -(-rows.count() // n))
    rows = rows.withColumn("__part", F.floor(F.col("__place") / size))
    inside = Window.partitionBy("__part", *by).orderBy("__place").rowsBetween(Window.unboundedPreceding, 0)
    parts = rows.groupBy("__part", *by).agg(F.sum("__value").alias("__sum"))
    before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("__part", *by, F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"))
    out = rows.withColumn(name, F.sum("__value").over(inside)).join(parts, ["__part", *by]).withColumn(name, F.col(name) + F.col("__before"))
    out = out.withColumn(place, F.col("__place")) if place else out
    return out.drop("__value", "__place", "__part", "__before")
