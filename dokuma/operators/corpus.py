"""Corpus operators: word counts, lines, article gates, blocks of lines, and their exact de-duplication."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dokuma.functions import hashing, markup, turkish
from dokuma.operators.order import numbered, ordered, with_neighbour
from dokuma.session import stage

#: Lines of a block, bytes from which a line counts for duplication, bytes that an article must exceed,
#: bytes that a raw article must stay below, and bytes of the longest line.
BLOCK, LONG, ARTICLE, RAW, LINE = 200, 24, 200, 8 << 20, 65536
#: Chance (in 1000) that a block is kept, and the generator that decides.
KEPT, SEED, SEQUENCE = 290, 2027, 4


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Occurrences of each word (letter run, Turkish lower case)."""
    return docs.select(F.explode(turkish.words(F.col(text))).alias("w")).groupBy(turkish.lower_col(F.col("w")).alias("word")).agg(F.count("*").alias("cnt"))


def articles(pages: DataFrame, strict: bool = False) -> DataFrame:
    """Clean text of the main-namespace pages that are no redirects: title, text. strict keeps the literal
    &nbsp; of doubly escaped dumps."""
    raw = F.col("text")
    rows = pages.where((F.col("ns") == 0) & F.col("redirect").isNull() & (F.octet_length(raw) > 0) & (F.octet_length(raw) < RAW))
    if not strict:
        raw = F.replace(raw, F.lit("&nbsp;"), F.lit(" "))
    return rows.select("title", markup.wikitext_col(raw).alias("text")).where(F.octet_length("text") > ARTICLE)


def root_candidates(pages: DataFrame) -> DataFrame:
    """Titles that can be roots, of pages with a Turkish section."""
    title = F.col("title")
    fits = F.octet_length(title).between(1, 63) & ~title.contains(" ") & ~title.contains(":")
    return pages.where(F.col("text").rlike("== ?Türkçe ?==") & fits & (F.col("ns") == 0)).select(title.alias("word")).distinct()


def lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, pos, text of every line."""
    return docs.select(id_col, F.posexplode(F.split(text, "\n")).alias("pos", "text"))


def numbered_lines(docs: DataFrame) -> DataFrame:
    """Lines with their number in the whole corpus."""
    return numbered(lines(docs), ["doc_id", "pos"], "line_no")


def consecutive_distinct(rows: DataFrame, order: list[str], text: str = "text") -> DataFrame:
    """Rows without the empty ones and those that equal the non-empty row before."""
    full = rows.where(F.col(text) != "")
    return with_neighbour(full, order, text, "_before").where(F.col("_before").isNull() | (F.col("_before") != F.col(text))).drop("_before")


def block_of(line_no: Column) -> Column:
    return F.floor(line_no / BLOCK).cast("long")


def long_lines(rows: DataFrame) -> DataFrame:
    """block_id, text of the lines that count for duplication."""
    return rows.select(block_of(F.col("line_no")).alias("block_id"), "text").where(F.octet_length("text") >= LONG)


def block_stats(rows: DataFrame) -> DataFrame:
    n = F.octet_length("text")
    return rows.groupBy(block_of(F.col("line_no")).alias("block_id")).agg(F.count("*").alias("n_lines"), F.sum(F.when(n >= LONG, 1).otherwise(0)).alias("n_long"), F.sum(n).alias("n_bytes"))


def majority(long: DataFrame, seen: DataFrame) -> DataFrame:
    """block_id, n_long, n_dup: lines of a block of which an earlier block of `seen` holds a copy."""
    first = seen.groupBy("text").agg(F.min("block_id").alias("first"))
    dup = F.coalesce(F.col("first") < F.col("block_id"), F.lit(False))
    return long.join(first, "text", "left").groupBy("block_id").agg(F.count("*").alias("n_long"), F.sum(dup.cast("long")).alias("n_dup"))


def _settle(part: pa.Table) -> pa.Table:
    """block_id and kept of the blocks of one part that can be settled, block after block in their order. A line is seen if an
    earlier kept block holds it, open if none does yet, but an earlier open one might."""
    column = lambda name: part.column(name).to_numpy()
    line = part.column("line").combine_chunks().dictionary_encode().indices.to_numpy()
    block, times, n_long, seen, open_before = (column(c) for c in ("block_id", "times", "n_long", "seen", "open_before"))
    order = np.argsort(block, kind="stable")
    edges = np.flatnonzero(np.concatenate([[True], block[order][1:] != block[order][:-1], [True]])) if len(order) else np.zeros(1, int)
    kept_here, open_here = (np.zeros(line.max(initial=-1) + 1, bool) for _ in range(2))
    blocks, kept = [], []
    for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        at = order[lo:hi]
        own = line[at]
        sure = seen[at] | kept_here[own]
        maybe = ~sure & (open_before[at] | open_here[own])
        n_sure, n_maybe, n = int(times[at][sure].sum()), int(times[at][maybe].sum()), int(n_long[at[0]])
        if 2 * n_sure > n or 2 * (n_sure + n_maybe) <= n:
            blocks.append(int(block[at[0]]))
            kept.append(2 * n_sure <= n)
            kept_here[own] |= kept[-1]
        else:
            open_here[own] = True
    return pa.table({"block_id": pa.array(blocks, pa.int64()), "kept": pa.array(kept, pa.bool_())})


def dedup_blocks(long: DataFrame, rows_a_part: int = 500_000) -> DataFrame:
    """block_id, n_long, n_dup, kept. A block goes if most of its long lines occur in earlier kept blocks. long: block_id, text
    (or line, its MD5 digest) and, if lines from elsewhere count as earlier kept ones, seen (boolean).

    A block is settled as soon as the settled ones among its predecessors decide it: dropped if most of its lines are seen,
    kept if the seen and the open ones together are no majority. Only lines that several blocks hold matter. Blocks that the
    first sums settle go no further; the rest is cut into ranges of blocks of about `rows_a_part` lines, in each of which
    blocks are settled in order, so a chain within a range costs one pass. A chain over ranges takes a round for each;
    rounds touch only open blocks, and only the ranges in which a line's state has changed. The first open block can always
    be settled. Lines stand by their 128-bit digests."""
    given = F.coalesce("seen", F.lit(False)) if "seen" in long.columns else F.lit(False)
    line = F.col("line") if "line" in long.columns else F.unhex(F.md5(F.col("text").cast("binary")))
    marked = long.select("block_id", line.alias("line"), given.alias("seen")).where("line is not null")
    held = stage(marked.groupBy("block_id", "line").agg(F.count("*").alias("times"), F.max("seen").alias("seen")), "held")
    sizes = held.groupBy("block_id").agg(F.sum("times").alias("n_long"))
    lines_ = held.groupBy("line").agg(F.min("block_id").alias("first"), F.count("*").alias("holders"), F.max("seen").alias("known"))
    shared = held.drop("seen").join(lines_.where("holders > 1 or known"), "line").withColumnRenamed("known", "seen")
    maybe = F.sum(F.when(F.col("seen") | (F.col("first") < F.col("block_id")), F.col("times")).otherwise(0))
    sums = shared.groupBy("block_id").agg(maybe.alias("maybe"))
    # without a majority even if every open line counted
    tight = sizes.join(sums, "block_id").where("2 * maybe > n_long").select("block_id", "n_long")
    rows = shared.join(tight, "block_id", "left")
    free = rows.where(F.col("n_long").isNull()).groupBy("line").agg(F.min("block_id").alias("kept_at"))
    rest = rows.where(F.col("n_long").isNotNull()).join(free, "line", "left")
    rest = stage(rest.select("block_id", "line", "times", "n_long", (F.col("seen") | F.coalesce(F.col("kept_at") < F.col("block_id"), F.lit(False))).alias("seen")), "open")
    n_parts = max(-(-rest.count() // rows_a_part), 1)
    rest = ordered(rest, "block_id", partitions=n_parts) if n_parts > 1 else rest.withColumn("_part", F.lit(0))
    settled, due = [], None
    while not rest.isEmpty():
        firsts = rest.groupBy("line").agg(F.min("block_id").alias("first"), F.min("_part").alias("first_part"))
        now = rest.join(firsts, "line").withColumn("open_before", (F.col("first") < F.col("block_id")) & (F.col("first_part") < F.col("_part")))
        if due is not None:
            now = now.join(due, "_part", "left_semi")
        done = stage(now.drop("first", "first_part").groupBy("_part").applyInArrow(_settle, "block_id long, kept boolean"), "settled")
        settled.append(done)
        told = rest.join(done, "block_id").groupBy("line").agg(F.min(F.when(F.col("kept"), F.col("block_id"))).alias("kept_at"))
        now_seen = F.col("seen") | F.coalesce(F.col("kept_at") < F.col("block_id"), F.lit(False))
        rest = rest.join(done, "block_id", "left_anti").join(told.withColumn("told", F.lit(True)), "line", "left").withColumn("seen", now_seen)
        rest = stage(rest.select("block_id", "line", "times", "n_long", "seen", "_part", F.coalesce("told", F.lit(False)).alias("told")), "open")
        due = rest.where("told").select("_part").distinct()
        rest = rest.drop("told")
    kept = sizes.select("block_id", F.lit(True).alias("kept"))
    if settled:
        gone = reduce(DataFrame.unionByName, settled).where("not kept").select("block_id")
        kept = kept.join(gone, "block_id", "left_anti")
    first_kept = held.join(kept, "block_id").groupBy("line").agg(F.min("block_id").alias("kept_at"))
    known = held.groupBy("line").agg(F.max("seen").alias("known"))
    dup = F.col("known") | F.coalesce(F.col("kept_at") < F.col("block_id"), F.lit(False))
    out = held.join(known, "line").join(first_kept, "line", "left").groupBy("block_id").agg(F.sum("times").alias("n_long"), F.sum(F.when(dup, F.col("times")).otherwise(0)).alias("n_dup"))
    return out.withColumn("kept", F.col("n_dup") * 2 <= F.col("n_long"))


def sample_blocks(kept: DataFrame) -> DataFrame:
    """Kept blocks with their rank, and whether the seeded generator draws them."""

    @F.pandas_udf("long")
    def draw(rank: pd.Series) -> pd.Series:
        return pd.Series(hashing.pcg_range(SEED, SEQUENCE, rank.to_numpy(np.int64), 1000))

    ranked = numbered(kept.select("block_id"), ["block_id"], "rank")
    return ranked.withColumn("draw", draw("rank")).withColumn("sampled", F.col("draw") < KEPT)


def subtitle_corpus(docs: DataFrame) -> DataFrame:
    """The whole chain: clean lines, drop repeats, de-duplicate blocks, sample; block_id, line_no, text."""
    raw = numbered_lines(docs).where(F.octet_length("text") <= LINE)
    clean = stage(raw.select("line_no", markup.subtitle_col("text").alias("text")).where("text <> ''"), "clean")
    rows = stage(consecutive_distinct(clean, ["line_no"]), "distinct")
    blocks = rows.select(block_of(F.col("line_no")).alias("block_id")).distinct()
    judged = dedup_blocks(long_lines(rows))
    kept = blocks.join(judged.where("not kept"), "block_id", "left_anti")
    sampled = sample_blocks(kept).where("sampled").select("block_id")
    return rows.withColumn("block_id", block_of(F.col("line_no"))).join(sampled, "block_id", "left_semi")


def corpus_stats(docs: DataFrame, *by: str) -> DataFrame:
    n = F.octet_length("text")
    tokens = F.size(F.expr("filter(split(text, '[ \\n]+'), x -> x <> '')"))
    out = docs.groupBy(*by).agg(F.count("*").alias("n_docs"), F.sum(n).alias("n_bytes"), F.sum(tokens).alias("n_tokens"))
    return out.withColumn("bytes_per_token", F.floor(F.col("n_bytes") / F.greatest("n_tokens", F.lit(1))).cast("long"))
