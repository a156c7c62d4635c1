"""Arriving corpus shards: stateless cleaning, incremental block de-duplication, event-time counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from dokuma.functions import markup
from dokuma.operators import corpus
from dokuma.session import forget, stage


def clean_lines(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of clean subtitle lines of the text files that arrive in a folder."""
    lines = spark.readStream.text(folder).where(F.octet_length("value") <= corpus.LINE)
    return lines.select(markup.subtitle_col("value").alias("text")).where("text <> ''")


#: Files at most in which a batch writes the lines that it adds; the next batch lists them.
BUCKETS = 1024
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def dedup_shards(blocks: DataFrame, seen: str, out: str, checkpoint: str) -> StreamingQuery:
    """De-duplicate arriving blocks (block_id, text) by the exact rule, with the lines kept so far as keyed state. Writes the
    kept blocks' rows to `out`; returns the running query: processAllAvailable() waits until all that has arrived is
    judged, stop() ends it, and a new call with the same folders goes on where it ended.

    A batch must hold whole blocks, after those of the batches before it. The state is an aggregate: for the digest of each
    long line, whether a kept block holds it. A batch is the rows that arrive and, beside them, those of the digests it touches
    that are kept ones, so no text is grouped or goes through the state. The blocks of a batch are judged together
    (corpus.dedup_blocks), and the digests of the lines that they add are written to `seen`, which the same query reads as a
    stream: they are in the state before the next batch's lines are looked up, as its files are listed only after this batch
    has ended. So a batch costs what it holds and what the one before has added, not all that came before. A batch that is run
    again after a failure writes the same folders again. Do not run it with availableNow, which lists all files at the start.
    State is kept in RocksDB, which is set for the session."""
    spark = blocks.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != _ROCKS:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(seen)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(place)
    digest = F.unhex(F.md5(F.col("text").cast("binary")))
    line = F.when(F.octet_length("text") >= corpus.LONG, digest)
    arrived = blocks.select("block_id", "text", line.alias("line"), F.lit(False).alias("seen"))
    decided = spark.readStream.schema("line binary, batch bigint").parquet(seen).select("line", F.lit(True).alias("seen"))
    told = arrived.where("line is not null").select("line", "seen").unionByName(decided).groupBy("line").agg(F.max("seen").alias("seen"))
    looked_up = arrived.unionByName(told.where("seen"), allowMissingColumns=True)

    def judge(batch: DataFrame, number: int) -> None:
        rows = stage(batch, "batch")
        own = rows.where("not seen")
        if own.isEmpty():  # it only took lines in; a file, even an empty one, would call for another batch
            return forget(rows)
        lines = own.where("line is not null").select("block_id", "line").join(rows.where("seen").select("line", "seen"), "line", "left")
        gone = stage(corpus.dedup_blocks(lines).where("not kept").select("block_id"), "gone")
        own.join(gone, "block_id", "left_anti").select("block_id", "text").write.mode("overwrite").parquet(f"{out.rstrip('/')}/part={number}")
        new = stage(lines.where("seen is null").join(gone, "block_id", "left_anti").select("line").distinct().coalesce(BUCKETS), "new")
        if not new.isEmpty():
            new.write.mode("overwrite").parquet(f"{seen.rstrip('/')}/batch={number}")
        return forget(rows, gone, new)

    return looked_up.writeStream.foreachBatch(judge).outputMode("update").option("checkpointLocation", checkpoint).start()


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by type and event-time window; rows later than the watermark are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
