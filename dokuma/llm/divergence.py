"""Source divergence audit by a baseline-correction inverted index. A pair of sources starts at what it would have if
neither held any term; the terms' postings add what they change, and terms are ranked by windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dokuma.llm.common import LOWER, ramp, texts, trimmed
from dokuma.session import stage

#: Documents of a language that must hold a term, parts that a whole is counted in, and terms that a group lists.
LEAST_DOCS, WHOLE, LISTED = 10, 1_000_000_000, 10
#: Pairs of postings that are looked at together, and sums of pairs that a task holds before it sends them on.
PAIRS, HELD = 1_000_000, 200_000

_LETTER = np.zeros(256, bool)
_LETTER[128:] = True
_LETTER[65:91] = _LETTER[97:123] = True


def _edges(offsets: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """The first of each run of set flags, where runs end at the offsets, too."""
    first = flags.copy()
    first[1:] &= ~flags[:-1]
    cut = offsets[offsets < len(flags)]
    first[cut] = flags[cut]
    return np.flatnonzero(first)


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, cnt, n_docs: how often and in how many documents each group has each term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = texts(batch.column(2))
            letters = _LETTER[data]
            starts = _edges(offsets, letters)
            if not len(starts):
                continue
            # terms have no byte between them, once all others are gone
            body = LOWER[data[letters]]
            at = np.concatenate([[0], np.cumsum(letters)])
            bounds = np.append(at[starts], len(body)).astype(np.int64)
            column = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(body))
            coded = column.dictionary_encode()
            n = len(coded.dictionary)
            doc = np.searchsorted(offsets, starts, "right") - 1
            pair, times = np.unique(doc * n + coded.indices.to_numpy(), return_counts=True)
            lang, source = (batch.column(i).dictionary_encode() for i in (0, 1))
            group = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
            key = group[pair // n] * n + pair % n
            by = np.argsort(key, kind="stable")
            key, times = key[by], times[by]
            head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            key, cnt, n_docs = key[head], np.add.reduceat(times, head), np.diff(np.append(head, len(by)))
            g, term = key // n, pa.array(key % n)
            made = [lang.dictionary.take(pa.array(g // len(source.dictionary))), source.dictionary.take(pa.array(g % len(source.dictionary))), coded.dictionary.take(term).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*made, pa.array(cnt.astype(np.int64)), pa.array(n_docs.astype(np.int64))], names=["lang", "source", "term", "cnt", "n_docs"])

    found = docs.select("lang", "source", "text").mapInArrow(trimmed(run), "lang string, source string, term string, cnt long, n_docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("cnt").alias("cnt"), F.sum("n_docs").alias("n_docs"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """p of a count: 1 + floor(WHOLE * (count + 2) / (total + 2 * terms)), exact at any size."""
    top = (count + 2).cast("decimal(20,0)") * F.lit(WHOLE).cast("decimal(10,0)")
    return F.when(terms > 0, F.call_function("div", top, (total + 2 * terms).cast("decimal(20,0)")).cast("long") + 1)


def gap(p: Column, q: Column) -> Column:
    """f(p, q) = floor((p - q)^2 / (p + q)); shares are at most WHOLE + 1, so nothing leaves a long."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def corrections(postings: DataFrame) -> DataFrame:
    """lang, a, b, value: what the terms that both of two sources have (a < b) change in their divergence, beyond what each of
    the two changes alone. postings: lang, posts (an array of source, p, p0 in the order of sources) for each term.

    A task adds up each pair of sources over its terms, and looks at PAIRS pairs of postings at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str, str], int] = {}

        def send() -> Iterator[pa.RecordBatch]:
            rows = [(*k, v) for k, v in held.items() if v]
            held.clear()
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string() if i < 3 else pa.int64()) for i in range(4)], names=["lang", "a", "b", "value"])

        for batch in batches:
            posts = batch.column(1)
            ends = posts.offsets.to_numpy()[1:] - posts.offsets[0].as_py()
            flat = posts.flatten()
            source, (p, p0) = flat.field("source").dictionary_encode(), (flat.field(c).to_numpy() for c in ("p", "p0"))
            lang = batch.column(0).dictionary_encode()
            sources, langs = source.dictionary.to_pylist(), lang.dictionary.to_pylist()
            place, ids = np.searchsorted(ends, np.arange(len(p)), "right"), source.indices.to_numpy().astype(np.int64)
            partners = ends[place] - np.arange(len(p)) - 1
            done = np.concatenate([[0], np.cumsum(partners)])
            lo = 0
            while lo < len(p):
                hi = max(lo + 1, int(np.searchsorted(done, done[lo] + PAIRS, "right")) - 1)
                i = np.repeat(np.arange(lo, hi), partners[lo:hi])
                j = i + 1 + ramp(partners[lo:hi])
                lo = hi
                value = _gap(p[i], p[j]) - _gap(p[i], p0[j]) - _gap(p0[i], p[j]) + _gap(p0[i], p0[j])
                i, j, value = i[value != 0], j[value != 0], value[value != 0]
                if not len(i):
                    continue
                key = (lang.indices.to_numpy()[place[i]].astype(np.int64) * len(sources) + ids[i]) * len(sources) + ids[j]
                by = np.argsort(key, kind="stable")
                key, value = key[by], value[by]
                head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                for k, v in zip(key[head].tolist(), np.add.reduceat(value, head).tolist(), strict=True):
                    name = (langs[k // len(sources) ** 2], sources[k // len(sources) % len(sources)], sources[k % len(sources)])
                    held[name] = held.get(name, 0) + v
                if len(held) > HELD:
                    yield from send()
        yield from send()

    return postings.select("lang", "posts").mapInArrow(trimmed(run), "lang string, a string, b string, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, listed: int = LISTED) -> DataFrame:
    """lang, source, part, item, value, rank. part `pair`: the divergence of a source from each other source of its language;
    part `term`: the `listed` terms that a source has beyond its language's share, with their part in the divergence from it.

    Terms are runs of letters A-Z, lower-cased, and of characters beyond ASCII; a language keeps those that occur in
    `least_docs` of its documents or more. With V kept terms, N their occurrences in a group and c those of one term,
    p = 1 + floor(10^9 (c + 2) / (N + 2 V)), and two groups differ by the sum over all kept terms of
    f(p, q) = floor((p - q)^2 / (p + q)). Ranks go by falling value, then by the item's bytes.

    A pair starts at V f(p0, q0), p0 and q0 being the shares of a count of zero. What a source's own terms change against
    another's q0 depends on their counts alone and is summed once for each count; what terms of both change beyond that comes
    from the postings. So a term costs work for the sources that hold it, whatever their number in all. Counts are summed in
    the tasks that read the texts, so neither a hot source nor a hot term moves more than a row for each of them and batch.

    A null text, lang or source is an empty one. A group without terms has pairs, but lists none; without a kept term all
    values are 0. Repeated rows are documents of their own; an empty table gives an empty one; other columns are not read."""
    docs = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))
    own = ["lang", "source"]
    by_term = Window.partitionBy("lang", "term")
    counts = term_counts(docs).withColumns({"all_docs": F.sum("n_docs").over(by_term), "total": F.sum("cnt").over(by_term), "first": F.row_number().over(by_term.orderBy("source")) == 1})
    kept = stage(counts.where(F.col("all_docs") >= least_docs).select(*own, "term", "cnt", "total", "first"), "terms")
    langs = kept.groupBy("lang").agg(F.count_if("first").alias("v"), F.sum("cnt").alias("n_lang"))
    groups = docs.select(*own).distinct().join(kept.groupBy(*own).agg(F.sum("cnt").alias("n")), own, "left").join(langs, "lang", "left")
    zero = F.lit(0).cast("long")
    groups = groups.select(*own, F.coalesce("n", zero).alias("n"), F.coalesce("v", zero).alias("v"), F.coalesce("n_lang", zero).alias("n_lang"))
    groups = stage(groups.withColumn("p0", share(zero, F.col("n"), F.col("v"))), "groups")

    scored = kept.join(groups, own).withColumns({"p": share(F.col("cnt"), F.col("n"), F.col("v")), "q": share(F.col("total"), F.col("n_lang"), F.col("v"))})
    ranks = Window.partitionBy(*own).orderBy(F.desc("value"), "item")
    terms = scored.where((F.col("cnt") > 0) & (F.col("p") > F.col("q"))).select(*own, F.lit("term").alias("part"), F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= listed)

    posts = scored.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("source", "p", "p0"))).alias("posts")).where(F.size("posts") > 1)
    both = corrections(posts)
    both = both.unionByName(both.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    # a row for each count that a group has: their number grows with the root of the text's length
    levels = scored.groupBy(*own, "p").agg(F.count("*").alias("terms"))
    base = groups.select("lang", F.col("source").alias("a"), "v", F.col("p0").alias("a0")).join(groups.select("lang", F.col("source").alias("b"), F.col("p0").alias("b0")), "lang").where(F.col("a") != F.col("b"))
    start = base.select("lang", "a", "b", F.coalesce(F.col("v") * gap(F.col("a0"), F.col("b0")), zero).alias("value"))
    alone = levels.withColumnRenamed("source", "a").join(base, ["lang", "a"]).select("lang", "a", "b", (F.col("terms") * (gap(F.col("p"), F.col("b0")) - gap(F.col("a0"), F.col("b0")))).alias("value")).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    alone = alone.unionByName(alone.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    pairs = start.unionByName(alone).unionByName(both).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    pairs = pairs.select("lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"), "value")
    return pairs.withColumn("rank", F.row_number().over(ranks)).unionByName(terms).select(*own, "part", "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))
