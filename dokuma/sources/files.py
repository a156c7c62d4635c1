"""Sources and sinks: XML dumps, lines, TSV counts, word lists, merge lists, checkpoints. Token files: tokenfiles.py."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from dokuma.operators.order import numbered

PAGE = "title STRING, ns INT, redirect STRUCT<_title: STRING>, revision STRUCT<text: STRUCT<_VALUE: STRING>>"


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages of an XML dump: title, ns, redirect (null if none), text. Entities are decoded once; white space
    is kept, as sizes count."""
    raw = spark.read.format("xml").option("rowTag", "page").option("ignoreSurroundingSpaces", "false").schema(PAGE).load(path)
    return raw.select("title", "ns", F.col("redirect._title").alias("redirect"), F.col("revision.text._VALUE").alias("text"))


def read_lines(spark: SparkSession, path: str, longest: int = 65536) -> DataFrame:
    """One row for each line; overlong lines are left out."""
    return spark.read.text(path).select(F.col("value").alias("text")).where(F.octet_length("text") <= longest)


def read_numbered_lines(spark: SparkSession, path: str, longest: int = 65536) -> DataFrame:
    """text and line_no, from 0 in the order of the files' names and of the lines in them; overlong lines are
    counted, but left out."""
    place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")]
    # a task reads its blocks in order, each from start to end
    rows = spark.read.text(path).select(F.col("value").alias("text"), *place, F.monotonically_increasing_id().alias("_at"))
    out = numbered(rows, ["_file", "_block", "_at"], "line_no")
    return out.where(F.octet_length("text") <= longest).select("line_no", "text")


def progress(df: DataFrame, name: str, **counted: Column) -> tuple[DataFrame, Observation]:
    """df, and what is counted as it is written: rows, and the rows for which each given condition holds. Read the
    observation after an action."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *(F.count_if(c).alias(n) for n, c in counted.items())), seen


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """word, cnt of a tab-separated file; carriage returns go, lines without a tab are left out."""
    parts = F.split(F.regexp_replace("value", "\r$", ""), "\t")
    return spark.read.text(path).where(F.size(parts) >= 2).select(parts[0].alias("word"), F.expr("try_cast(split(regexp_replace(value, '\r$', ''), '\t')[1] as bigint)").alias("cnt"))


def write_counts(counts: DataFrame, path: str) -> None:
    counts.select(F.concat_ws("\t", "word", F.col("cnt").cast("string"))).write.text(path)


def read_words(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.regexp_replace("value", "\r$", "").alias("word")).where("word <> ''").distinct()


def write_words(words: DataFrame, path: str) -> None:
    words.select("word").write.text(path)


def save_best(spark: SparkSession, value: float, path: str) -> None:
    """The best metric so far, beside a checkpoint."""
    spark.createDataFrame([(float(value),)], "best float").coalesce(1).write.mode("overwrite").parquet(path)


def load_best(spark: SparkSession, path: str, worst: float = 3.0e38) -> float:
    """The best metric so far; `worst` where there is none, or not exactly one value."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return worst
    rows = spark.read.parquet(path).take(2)
    return rows[0][0] if len(rows) == 1 and rows[0][0] is not None else worst


def write_merges(merges: list[tuple[int, int, int]], spark: SparkSession, path: str) -> None:
    rows = [(i, *m) for i, m in enumerate(merges)]
    spark.createDataFrame(rows, "rank int, left int, right int, new_id int").coalesce(1).write.parquet(path)


def read_merges(spark: SparkSession, path: str) -> list[tuple[int, int, int]]:
    return [tuple(r) for r in spark.read.parquet(path).orderBy("rank").select("left", "right", "new_id").collect()]


def save_checkpoint(params: DataFrame, step: int, path: str) -> str:
    """Write a parameter table (param_idx, i, j, v, ...) under a new name; a reader finds it only complete."""
    target = f"{path.rstrip('/')}/step={step:09d}-{uuid.uuid4().hex[:8]}"
    params.withColumn("step", F.lit(step)).write.parquet(target)
    return target


def load_checkpoint(spark: SparkSession, target: str, shapes: DataFrame) -> DataFrame:
    """The parameter table, if its shapes are exactly the expected ones (param_idx, rows, cols)."""
    params = spark.read.parquet(target)
    found = params.groupBy("param_idx").agg((F.max("i") + 1).alias("rows"), (F.max("j") + 1).alias("cols"), F.count("*").alias("n"))
    whole = found.join(shapes, ["param_idx", "rows", "cols"], "inner").where("n = rows * cols").count()
    if not whole == shapes.count() == found.count():
        raise ValueError("the checkpoint's shapes are not the model's")
    return params


def probe_write(spark: SparkSession, path: str) -> None:
    """Fail at once if the target cannot be written."""
    target = f"{path.rstrip('/')}/.probe-{uuid.uuid4().hex}"
    spark.range(1).write.parquet(target)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
