"""Row numbers and neighbours in a global order without a single-task window: rows are range-partitioned
once, numbered within partitions, and one small row for each partition carries what the next one needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dokuma.session import stage


def ordered(df: DataFrame, *order: str, partitions: int | None = None) -> DataFrame:
    """df range-partitioned by `order` and written, with _part (rising with the order)."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stage(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "ordered")


def numbered(df: DataFrame, order: list[str], name: str = "line_no", within: list[str] | None = None) -> DataFrame:
    """Adds the rows' numbers from 0 in the given order; within: numbers start anew for each such group.
    The order must tell all rows apart."""
    rows = ordered(df, *(within or []), *order)
    local = Window.partitionBy("_part").orderBy(*(within or []), *order)
    counts = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    # one row for each partition: the window over them is small whatever the table
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    out = rows.join(F.broadcast(offsets), "_part").withColumn(name, F.row_number().over(local) - 1 + F.col("_from"))
    if within:
        firsts = out.groupBy(*within).agg(F.min(name).alias("_first"))
        out = out.join(firsts, within).withColumn(name, F.col(name) - F.col("_first")).drop("_first")
    return out.drop("_part", "_from")


def running(df: DataFrame, order: list[str], size: str, name: str, within: str) -> DataFrame:
    """Adds the sum of `size` over all earlier rows of the same group `within` (a column of few values, or of many), in
    the given order, from one range partitioning; what the rows carry moves once. The order must tell rows apart."""
    rows = ordered(df, within, *order)
    local = Window.partitionBy("_part", within).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("_part", within).agg(F.sum(size).alias("_n"))
    # a row for each partition and the groups that it holds: groups are ranges, so nearly one row for each of either
    before = Window.partitionBy(within).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_part", within, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    out = rows.withColumn(name, F.coalesce(F.sum(size).over(local), F.lit(0))).join(offsets, ["_part", within])
    return out.withColumn(name, F.col(name) + F.col("_from")).drop("_part", "_from")


def with_neighbour(df: DataFrame, order: list[str], value: str, name: str, ahead: bool = False) -> DataFrame:
    """Adds `value` of the row before (or after) in the global order; null at the end."""
    rows = ordered(df, *order)
    window = Window.partitionBy("_part").orderBy(*order)
    step, edge = (F.lead, F.min_by) if ahead else (F.lag, F.max_by)
    inner = rows.withColumns({name: step(value).over(window), "_edge": step(F.lit(True)).over(window).isNull()})
    edges = rows.groupBy("_part").agg(edge(F.struct(F.col(value)), F.struct(*order)).alias("_v"))
    across = Window.orderBy(F.desc("_part") if ahead else F.asc("_part"))
    given = edges.select("_part", F.lag("_v").over(across)[value].alias("_given"))
    out = inner.join(F.broadcast(given), "_part")
    return out.withColumn(name, F.when(F.col("_edge"), F.col("_given")).otherwise(F.col(name))).drop("_part", "_edge", "_given")


def top(df: DataFrame, k: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(k)
