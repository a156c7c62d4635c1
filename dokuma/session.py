"""Session factory and the shared folder in which intermediate tables are kept."""

from __future__ import annotations

import gc
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build(app: str = "dokuma", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings this engine expects: UTC, AQE, Arrow."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    return builder.config(map=settings).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only where it is unset (as in tests), one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        made = spark.sparkContext._jsc.sc().getCheckpointDir()
        if made.isDefined():
            return made.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="dokuma-checkpoint-")
        spark.sparkContext.setCheckpointDir(f"file://{found}")
        return f"file://{found}"
    return found


def stage(df: DataFrame, name: str = "stage", by: str | None = None) -> DataFrame:
    """Write df as Parquet to the shared folder, one folder for each value of `by` if given, and read it back:
    lineage ends there, and a lost executor costs no recomputation. The files go when the JVM's file system is
    closed."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/dokuma-{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path, partitionBy=by)
    forget_at_exit(spark, path)
    out = spark.read.schema(schema).parquet(path)
    out._staged_at = path
    return out


def forget_at_exit(spark: SparkSession, path: str) -> None:
    """Delete a file or folder when the JVM's file system is closed."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)


def forget(*staged: DataFrame, part: str = "", sweep: bool = True) -> None:
    """Delete tables that stage() wrote, or only their folder `part`, once all that was read from them has been
    written elsewhere, and, if `sweep`, let the cleaner drop the shuffle files of plans that are gone."""
    for df in staged:
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(f"{df._staged_at}/{part}" if part else df._staged_at)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    if sweep:
        gc.collect()
        spark.sparkContext._jvm.System.gc()


#: Rows that one bitmap stands for, and bytes of the bitmaps that are broadcast at a time.
BITS, BITMAPS = 32768, 64 << 20


def free_name(wish: str, *taken: str) -> str:
    """wish, or wish with underscores before it until no column in `taken` has that name."""
    used = {c.lower() for c in taken}
    while wish.lower() in used:
        wish = f"_{wish}"
    return wish


class Rows:
    """A table written to the shared folder, whose rows have a number each (column `id`), and from which
    subsets are read back without a shuffle of its rows.

    A row's number holds its file and its place in it. A subset is a bitmap over the places: 4 kB for 32768
    rows of a file. Bitmaps are broadcast BITMAPS bytes at a time, each time for the files that they are
    about, so the plan is the same for a table of any size and what is broadcast stays bounded.
    """

    def __init__(self, df: DataFrame, name: str = "rows"):
        self.columns, self.id = df.columns, free_name("_row", *df.columns)
        self.df = stage(df.withColumn(self.id, F.monotonically_increasing_id()), name)
        spark, path = df.sparkSession, self.df._staged_at
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(place)
        self._files: dict[int, list[str]] = {}
        for f in files:
            named = re.match(r"part-(\d+)-", f.getPath().getName())
            if named:
                self._files.setdefault(int(named[1]), []).append(f.getPath().toString())

    def where(self, marked: DataFrame, keep: bool = True) -> DataFrame:
        """The rows whose numbers are (or, if not `keep`, are not) in `marked`, a table of one column."""
        number = F.col(marked.columns[0])
        bucket, bits = free_name("_bucket", *self.df.columns), free_name("_bits", *self.df.columns)
        maps = marked.select(F.floor(number / BITS).alias(bucket), (number % BITS).alias("at"))
        maps = stage(maps.groupBy(bucket).agg(F.bitmap_construct_agg("at").alias(bits)), "bitmaps")
        # a count for each file
        sizes = {r[0]: r[1] for r in maps.groupBy(F.shiftright(bucket, 18).alias("file")).count().collect()}
        blocks, held = [[]], 0
        for file in sorted(self._files):
            if held and held + sizes.get(file, 0) > BITMAPS // (BITS // 8):
                blocks, held = [*blocks, []], 0
            blocks[-1].append(file)
            held += sizes.get(file, 0)
        out = None
        for block in blocks:
            rows = self.df if len(blocks) == 1 else self.df.sparkSession.read.schema(self.df.schema).parquet(*(f for k in block for f in self._files[k]))
            own = maps if len(blocks) == 1 else maps.where(F.col(bucket).between(block[0] << 18, (block[-1] + 1 << 18) - 1))
            at = F.col(self.id) % BITS
            byte = F.conv(F.hex(F.substring(F.col(bits), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
            hit = F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))
            joined = rows.withColumn(bucket, F.floor(F.col(self.id) / BITS)).join(F.broadcast(own), bucket, "left")
            some = joined.where(hit if keep else ~hit).select(*self.df.columns)
            out = some if out is None else out.unionByName(some)
        return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table of the data folder, by a path that only Spark's readers need to open."""
    # rows hold whole texts: batches to Python workers are bounded by bytes, not by rows alone
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
