"""Sharding by sampled splitters: size-weighted key samples give quantile boundaries, records are
range-partitioned by them, and ranges that turn out overfull are subdivided."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dokuma.session import Rows, free_name, stage

LEAST = -(2**63)
#: Bytes of a range, at most about: what one task sorts.
RANGE = 256 << 20


def _quantiles(sample: list[tuple[int, int, float]], pieces: int) -> list[tuple[int, int]]:
    """Boundaries (key, tie) that cut the weighted sample into about equal pieces. A key that holds
    one cut alone is cut before its first record; a key that holds several is cut by its tie."""
    sample = sorted(sample)
    if not sample or pieces < 2:
        return []
    weight = np.cumsum([w for _, _, w in sample])
    at = np.searchsorted(weight, weight[-1] * np.arange(1, pieces) / pieces)
    picked = [sample[min(i, len(sample) - 1)][:2] for i in at]
    times = {}
    for k, _ in picked:
        times[k] = times.get(k, 0) + 1
    return [(k, LEAST if times[k] == 1 else t) for k, t in picked]


def _range_of(bounds: list[tuple[int, int]]):
    keys = np.array([k for k, _ in bounds], np.int64)
    ties = np.array([t for _, t in bounds], np.int64)

    @F.pandas_udf("int")
    def range_of(key: pd.Series, tie: pd.Series) -> pd.Series:
        k, t = key.to_numpy(np.int64), tie.to_numpy(np.int64)
        lo, hi = np.searchsorted(keys, k, "left"), np.searchsorted(keys, k, "right")
        out = lo.copy()
        for i in np.flatnonzero(hi > lo):
            out[i] = lo[i] + np.searchsorted(ties[lo[i] : hi[i]], t[i], "right")
        return pd.Series(out.astype(np.int32))

    return range_of


def _draw(df: DataFrame, wanted: float, total: int) -> list[tuple[int, int, float]]:
    """A Poisson sample of about `wanted` keys, each record drawn with a chance in proportion to its size."""
    chance = F.least(F.lit(1.0), F.col("size") * F.lit(float(wanted) / max(total, 1)))
    coin = F.pmod(F.xxhash64(F.lit("splitters"), "key", "tie"), F.lit(2**53)) / F.lit(float(2**53))
    rows = df.where(coin < chance).select("key", "tie", (F.col("size") / chance).alias("w")).collect()
    return [(r[0], r[1], r[2]) for r in rows]


def shard(df: DataFrame, key: Column, tie: Column, size: Column, n_shards: int, range_bytes: int = RANGE, samples_per_range: int = 16, whole_share: float = 0.01) -> DataFrame:
    """Adds shard (0 to n_shards - 1) and slot (gapless from 0 in each shard) so that the shards' sizes
    are near equal: consecutive records in the order of (key, tie), cut where the running size passes a
    shard's share. Records of equal key stay together where they weigh up to `whole_share` of a shard.

    key and tie are 64-bit integers; a null counts as the least. Equal (key, tie) repeat freely. df's columns may
    have any names but shard and slot; an empty table gives an empty table. There are four ranges a shard at least,
    and as many as it takes for one to hold no more than `range_bytes`: a range is a task. What reaches the driver is
    about samples_per_range sampled keys and one row for each range.
    """
    own = F.struct(*(F.col(c) for c in df.columns)).alias("own")
    rows = stage(df.select(own, F.coalesce(key, F.lit(LEAST)).alias("key"), F.coalesce(tie, F.lit(LEAST)).alias("tie"), size.cast("long").alias("size")), "shard")
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    pieces = max(4 * n_shards, -(-total // range_bytes))
    bounds = sorted(set(_quantiles(_draw(rows, pieces * samples_per_range, total), pieces)))
    share = max(total, 1) / pieces
    for _ in range(5):
        ranged = rows.withColumn("range", _range_of(bounds)("key", "tie"))
        seen = {r[0]: (r[1], r[2]) for r in ranged.groupBy("range").agg(F.sum("size"), F.count("*")).collect()}
        over = [k for k, (b, _) in seen.items() if b > 2 * share]
        more: set[tuple[int, int]] = set()
        if over:
            weight = sum(seen[k][0] for k in over)
            drawn = _draw(ranged.where(F.col("range").isin(over)), 4 * samples_per_range * weight / share, weight)
            for k in over:
                lo = bounds[k - 1] if k else (LEAST, LEAST)
                inside = [s for s in drawn if s[:2] >= lo and (k == len(bounds) or s[:2] < bounds[k])]
                more.update(_quantiles(inside, int(-(-seen[k][0] // share))))
        if not more - set(bounds):
            break
        bounds = sorted(set(bounds) | more)
    at_bytes, at_rows, offsets = 0, 0, []
    for k in sorted(seen):
        offsets.append((k, at_bytes, at_rows))
        at_bytes, at_rows = at_bytes + seen[k][0], at_rows + seen[k][1]
    spark = df.sparkSession
    places = spark.createDataFrame(offsets, "range int, bytes_before long, rows_before long")
    order = Window.partitionBy("range").orderBy("key", "tie", "size")
    group = Window.partitionBy("range", "key")
    run = ranged.withColumns({"run": F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)), "no": F.row_number().over(order)})
    run = run.withColumns({"group": F.sum("size").over(group), "first": F.min(F.col("run") - F.col("size")).over(group)})
    # a row for each range: broadcast
    run = run.join(F.broadcast(places), "range")
    whole = F.col("group") <= F.lit(whole_share * max(total, 1) / n_shards)
    middle = F.col("bytes_before") + F.when(whole, F.col("first") + F.col("group") / 2).otherwise(F.col("run") - F.col("size") / 2)
    run = run.withColumns({"shard": F.least(F.lit(n_shards - 1), F.floor(middle * n_shards / F.lit(max(total, 1)))).cast("int"), "row": F.col("rows_before") + F.col("no") - 1})
    run = stage(run.select("own", "shard", "row"), "shards")
    firsts = run.groupBy("shard").agg(F.min("row").alias("from"))
    return run.join(F.broadcast(firsts), "shard").select("own.*", "shard", (F.col("row") - F.col("from")).alias("slot"))


def write_shards(docs: DataFrame, path: str, n_shards: int = 40, rows_per_file: int = 100_000) -> None:
    """Write the documents as one folder for each shard, in files of consecutive slots, `rows_per_file` slots each: no task holds a
    whole shard. All columns are kept; a column called shard or slot is refused. Null and repeated doc_ids and
    repeated rows are records like others: each is written once."""
    if taken := {"shard", "slot"} & {c.lower() for c in docs.columns}:
        raise ValueError(f"the documents have a column {min(taken)}")
    rows = Rows(docs, "texts")
    text = F.coalesce(F.col("text"), F.lit(""))
    base = rows.df.select(F.col(rows.id).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.xxhash64(text).alias("hash"))
    placed = shard(base, F.col("hash"), F.col("doc_id"), F.col("size"), n_shards).select(F.col("row").alias(rows.id), "shard", "slot")
    file = free_name("_file", *rows.df.columns)
    both = rows.df.join(placed, rows.id).withColumn(file, F.floor(F.col("slot") / rows_per_file))
    # a range is a file's slots, or part of them
    out = both.repartitionByRange("shard", file, "slot").sortWithinPartitions("shard", "slot")
    out.select(*docs.columns, "shard", "slot").write.option("maxRecordsPerFile", rows_per_file).partitionBy("shard").parquet(path)


def shard_documents(docs: DataFrame, n_shards: int = 40) -> DataFrame:
    """Documents to shards under the law `bytes`: a document weighs its UTF-8 bytes plus 16 (a null text: 16).
    Equal texts are neighbours in the key order, so a group of copies shares a shard unless it outweighs
    one percent of a shard. Null doc_ids are the least ties; repeated ids and rows are records of their own; an empty
    table gives an empty table; other columns are not looked at."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("_hash"))
    out = shard(base, F.col("_hash"), F.col("doc_id"), F.col("size"), n_shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
