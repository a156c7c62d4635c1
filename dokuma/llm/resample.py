"""Quality classifier by importance resampling: hashed n-gram generative models of target and raw text give
every document a log importance weight; Gumbel noise and a top-k draw the documents that stay.

Target text is that of the labelled rows of quality 1 that are not toxic. Raw text is modelled as a
mixture: target text, text of low quality and toxic text, each a hashed n-gram model. Both are models of
passages of some 32 words, so that no length of good text makes up for a bad passage: a passage's weight is the
ratio of the target model to the mixture, and a document has the weight of its least passage. k is the number
of rows whose weight passes the cut that sets labelled target rows and others apart best.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dokuma.llm.common import LOWER, U64, mix, parts, span_hash, texts, trimmed, words
from dokuma.llm.forest import shingles
from dokuma.session import Rows, stage

#: Buckets of hashed n-grams, and slices in which their counts are summed. Each n-gram has a bucket in
#: either half, by independent hashes, and the lesser evidence of the two counts: two that share one bucket
#: seldom share the other.
BUCKETS, SLICES = 1 << 20, 64
#: Labelled rows that the models are fitted on, at most: the documented bound of the fit; and the tasks that
#: count their n-grams, so that what is summed does not grow with the input either.
LABELLED, COUNTERS = 500_000, 16
#: Words of a passage; a rest of less than half joins the passage before.
PASSAGE = 32
#: A count that is added to both sides, shared out as the classes are, and the prior chance that the rates of an n-gram differ at
#: all. An n-gram's log ratio is weighted by the posterior chance that they do (a spike and a slab): thousands
#: of rare n-grams, each of slight and doubtful weight, would else add up against any text.
SMOOTH, DIFFERS = 1.0, 1e-7
ENDING = np.isin(np.arange(256), np.frombuffer(b".,;:!?", np.uint8)).astype(np.int64)
TARGET, LOW, TOXIC = 0, 1, 2


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of passages of PASSAGE words, which cover all texts, and the first passage of each text."""
    w0, _, first = words(data, offsets)
    n = np.diff(first)
    number = np.maximum((n + PASSAGE // 2) // PASSAGE, 1)
    text = np.repeat(np.arange(len(n)), number)
    begin = np.cumsum(number) - number
    inner = np.arange(len(text)) - begin[text]
    starts = offsets[:-1][text]
    later = np.flatnonzero(inner)
    starts[later] = w0[first[text[later]] + PASSAGE * inner[later]]
    return np.append(starts, offsets[-1:]), np.append(begin, len(text))


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two buckets of each distinct n-gram of each text, (2, n), and the text of each: words as written, words in
    lower case, their first four and last two bytes, word pairs, and a word that comes two or five to eight times in a row.
    An n-gram counts once a text, as one text may repeat it at will."""
    w0, w1, first = words(data, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    low = LOWER[data]
    # punctuation at the end of a word is not part of its lower-case form
    bare = np.maximum(w1 - ENDING[low[w1 - 1]], w0 + 1)
    own, plain = span_hash(data, w0, w1), span_hash(low, w0, bare)
    stem = span_hash(low, w0, np.minimum(bare, w0 + 4)) ^ U64(0xC2B2AE3D27D4EB4F)
    tail = span_hash(data, np.maximum(w0, w1 - 2), w1) ^ U64(0x165667B19E3779F9)
    joined = doc[1:] == doc[:-1]
    again = joined & (own[1:] == own[:-1])
    pair = mix(plain[:-1] * U64(3) + plain[1:])
    pair[again] = U64(0x5851F42D4C957F2D)
    runs = np.cumsum(np.concatenate([[0], again]))
    rows = [(n, np.flatnonzero(runs[n - 1 :] - runs[: 1 - n] == n - 1)) for n in range(5, 9)]
    hashes = np.concatenate([own, plain ^ U64(0x94D049BB133111EB), stem, tail, pair[joined], *(np.full(len(at), U64(0x14057B7EF767814F * n % 2**64)) for n, at in rows)])
    docs = np.concatenate([doc, doc, doc, doc, doc[1:][joined], *(doc[at] for _, at in rows)])
    keys = np.sort((docs << 38) | (mix(hashes) >> U64(26)).astype(np.int64))
    if len(keys):
        keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
    half = BUCKETS // 2
    return np.stack([keys & (half - 1), half + ((keys >> 19) & (half - 1))]), keys >> 38


def _counts(labelled: DataFrame) -> np.ndarray:
    """Weight of the labelled passages with each n-gram by class: (3, BUCKETS). labelled: text, kind, weight."""
    width = BUCKETS // SLICES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(3 * BUCKETS)
        for batch in batches:
            offsets, data = texts(batch.column(0))
            kind, weight = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            for lo, hi in parts(offsets, 1_000_000):
                cuts, first = passages(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                bucket, at = features(data[offsets[lo] : offsets[hi]], cuts)
                doc = lo + np.searchsorted(first, at, "right") - 1
                for half in bucket:
                    own, inverse = np.unique(kind[doc].astype(np.int64) * BUCKETS + half, return_inverse=True)
                    total[own] += np.bincount(inverse, weights=weight[doc])
        rows = total.reshape(3, SLICES, width)
        keep = [(k, s) for k in range(3) for s in range(SLICES) if rows[k, s].any()]
        yield pa.RecordBatch.from_arrays([pa.array([k * SLICES + s for k, s in keep], pa.int32()), pa.array([rows[k, s].astype(np.float32).tobytes() for k, s in keep], pa.binary())], names=["slice", "blob"])

    def join(table: pa.Table) -> pa.Table:
        total = np.zeros(width)
        for blob in table.column("blob").to_pylist():
            total += np.frombuffer(blob, np.float32)
        return pa.table({"slice": table.column("slice")[:1], "blob": pa.array([total.tobytes()], pa.binary())})

    out = np.zeros((3 * SLICES, width))
    # COUNTERS blobs a slice, and 3 * SLICES rows at the driver, 24 MB at most, whatever the input
    dealt = labelled.select("text", "kind", "weight").coalesce(COUNTERS)
    for row in dealt.mapInArrow(trimmed(run), "slice int, blob binary").groupBy("slice").applyInArrow(join, "slice int, blob binary").collect():
        out[row[0]] = np.frombuffer(row[1], np.float64)
    return out.reshape(3, BUCKETS)


def log_ratios(counts: np.ndarray) -> np.ndarray:
    """log of the target model's probability over that of the class's, for low quality and toxic text: both signs, each
    weighted by the posterior chance that the two differ."""
    size = np.maximum(counts.sum(1) / 2, 1e-9)
    out = np.zeros((2, BUCKETS), np.float32)
    for i, k in enumerate((LOW, TOXIC)):
        share = size[TARGET] / (size[TARGET] + size[k])
        t, c = counts[TARGET] + SMOOTH * share, counts[k] + SMOOTH * (1 - share)
        ratio = np.log(t / size[TARGET]) - np.log(c / size[k])
        evidence = ratio**2 / (1 / t + 1 / c) / 2
        out[i] = ratio / (1 + np.exp(np.clip(-np.log(DIFFERS) - evidence, -50, 50)))
    return out


def log_weights(data: np.ndarray, offsets: np.ndarray, ratios: np.ndarray, prior: list[float]) -> np.ndarray:
    """The log importance weight of each text: that of its least passage. prior: the classes' shares of raw text."""
    cuts, first = passages(data, offsets)
    bucket, at = features(data, cuts)
    mixture = np.full(len(cuts) - 1, prior[TARGET])
    for i, p in enumerate(prior[1:]):
        a, b = ratios[i, bucket[0]], ratios[i, bucket[1]]
        agreed = np.where(np.sign(a) == np.sign(b), np.where(np.abs(a) < np.abs(b), a, b), 0)
        mixture += p * np.exp(np.clip(-np.bincount(at, weights=agreed, minlength=len(mixture)), -600, 600))
    own = -np.log(mixture)
    return (np.minimum.reduceat(own, first[:-1]) if len(first) > 1 else own) + 0.0  # never -0.0: Parquet's row-group filters tell it from 0.0


def _weighted(base: DataFrame, classes: DataFrame) -> DataFrame:
    """text, kind and weight of the labelled rows. Copies and near copies, known by two minima over their
    shingles, share one row's weight: a text that was copied a thousand times is evidence once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = texts(batch.column(2))
            low = [np.zeros(0, U64), np.zeros(0, U64)]
            for lo, hi in parts(offsets):
                hashes, at = shingles(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                full = np.flatnonzero(np.diff(at))
                for i, seed in enumerate((U64(0x243F6A8885A308D3), U64(0x13198A2E03707344))):
                    least = np.zeros(hi - lo, U64)
                    if len(full):
                        least[full] = np.minimum.reduceat(mix(hashes ^ seed), at[full])
                    low[i] = np.concatenate([low[i], least])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x.astype(np.int64)) for x in low)], names=["row", "kind", "m0", "m1"])

    labelled = base.join(F.broadcast(classes), "doc_id")
    rows = stage(labelled.select("row", "kind", "text").mapInArrow(trimmed(run), "row long, kind int, m0 long, m1 long"), "minima")
    out = rows
    for m in ("m0", "m1"):
        times = rows.groupBy(m, "kind").agg(F.count("*").alias(f"n{m}")).where(f"n{m} > 1")
        out = out.join(times, [m, "kind"], "left")
    one = F.lit(1).cast("long")
    weights = out.select("row", (1 / F.greatest(F.coalesce("nm0", one), F.coalesce("nm1", one))).alias("weight"))
    return labelled.select("row", "kind", "text").join(weights, "row").select("text", "kind", "weight")


def _kth(rows: DataFrame, column: str, k: int) -> float:
    """The k-th largest value, by histograms of ever narrower ranges: no sort of all rows."""
    lo, hi = rows.agg(F.min(column), F.max(column)).first()
    above = 0
    for _ in range(8):
        if lo == hi:
            return lo
        width = (hi - lo) / 4096
        inside = rows.where(F.col(column).between(lo, hi))
        bins = inside.groupBy(F.least(F.lit(4095), F.floor((F.col(column) - F.lit(lo)) / F.lit(width))).alias("b")).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).orderBy(F.desc("b")).collect()
        for r in bins:
            if above + r["n"] >= k:
                lo, hi = r["lo"], r["hi"]
                break
            above += r["n"]
    return lo


def _draws(base: DataFrame, labels: DataFrame) -> DataFrame:
    """base (row, which tells rows apart, doc_id, text_hash, text) without the text, and with log_weight, draw and kept."""
    per_doc = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))
    kind = F.when(F.col("t") == 1, TOXIC).when(F.col("q") == 0, LOW).otherwise(TARGET)
    classes = per_doc.select(F.col("doc_id").cast("long").alias("doc_id"), kind.cast("int").alias("kind"))
    n = classes.count()
    if n > LABELLED:
        classes = classes.where(F.pmod(F.xxhash64("doc_id"), F.lit(2**40)) < F.lit(2**40 * LABELLED // n))
    classes = stage(classes, "classes")
    share = {r[0]: r[1] for r in classes.groupBy("kind").count().collect()}
    total = max(sum(share.values()), 1)
    ratios, prior = np.zeros((2, BUCKETS), np.float32), [1.0, 1e-9, 1e-9]
    if share.get(TARGET):
        ratios = log_ratios(_counts(_weighted(base, classes)))
        prior = [max(share.get(k, 0), 1e-9) / total for k in (TARGET, LOW, TOXIC)]
        ratios[[k not in share for k in (LOW, TOXIC)]] = 0
    # two arrays of BUCKETS floats, 8 MB whatever the input
    shared = base.sparkSession.sparkContext.broadcast(ratios)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = texts(batch.column(3))
            out = [log_weights(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], shared.value, prior) for lo, hi in parts(offsets, 1_000_000)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())], names=["row", "doc_id", "text_hash", "log_weight"])

    weighted = base.select("row", "doc_id", "text_hash", "text").mapInArrow(trimmed(run), "row long, doc_id long, text_hash long, log_weight double")
    uniform = (F.pmod(F.xxhash64(F.lit("gumbel"), F.coalesce("doc_id", F.lit(0))), F.lit(2**53)) + 0.5) / F.lit(float(2**53))
    drawn = stage(weighted.withColumn("draw", F.col("log_weight") - F.log(-F.log(uniform))), "draws")
    k = drawn.where(F.col("log_weight") >= F.lit(_cut(drawn, classes))).count()
    if k <= 0:
        return drawn.withColumn("kept", F.lit(False))
    return drawn.withColumn("kept", F.col("draw") >= F.lit(_kth(drawn, "draw", k)))


def _base(rows: Rows) -> DataFrame:
    return rows.df.select(F.col(rows.id).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")


def resample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text_hash (xxhash64), log_weight, draw (weight plus Gumbel noise) and kept of every row.

    A null or empty text has no evidence for or against it. Labels of unknown documents and null labels are
    left out; a document labelled twice takes its lowest quality and highest toxicity. Without labels of a
    class, that class plays no part; without target labels all rows stay. Rows that repeat a doc_id
    share its noise and, if labelled, each count. Ties in draw stay together. An empty table gives an empty
    table; columns other than doc_id and text are not looked at.
    """
    return _draws(_base(Rows(docs.select("doc_id", "text"), "texts")), labels).drop("row")


def _cut(drawn: DataFrame, classes: DataFrame) -> float:
    """The log weight that sets target rows and others apart with the least sum of both error rates, by a
    histogram of the labelled rows in steps of a quarter."""
    level = F.greatest(F.lit(-400), F.floor(F.col("log_weight") * 4))
    rows = drawn.join(F.broadcast(classes), "doc_id").groupBy(level.alias("b"), (F.col("kind") == TARGET).alias("good")).count().collect()
    good, bad = ({r["b"]: r["count"] for r in rows if r["good"] == g} for g in (True, False))
    if not good or not bad:
        return float("-inf")
    error = lambda c: sum(n for b, n in good.items() if b < c) / sum(good.values()) + sum(n for b, n in bad.items() if b >= c) / sum(bad.values())
    return min(sorted(good.keys() | bad.keys()), key=error) / 4


def keep_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that resampling keeps, with all their columns, whatever their names; nulls, repeated rows and empty tables
    are treated as in resample."""
    rows = Rows(docs, "texts")
    drawn = _draws(_base(rows), labels)
    return rows.where(drawn.where("not kept").select("row"), keep=False).select(*docs.columns)
