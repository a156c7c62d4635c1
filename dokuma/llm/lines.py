"""Line hashing: lines, cut further at the ends of sentences, are normalised, their digests grouped globally and
the earliest occurrence kept. Later ones go where enough of them adjoin, with their places in the original
text retained."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dokuma.llm.common import KEY, LOWER, batch_of, by_bucket, by_key, keyed_blob, parts, run_hash, sequence_sums, span_hash, split_blob, texts, trimmed, unpack, words
from dokuma.llm.suffix import BUCKET, FLUSH, with_spans

#: Words in a row that must occur earlier, too, unit by unit, for them to go: about a paragraph.
LEAST_RUN = 30
#: Bytes of a word that count as one word: scripts without spaces have no shorter ones.
WORD_BYTES = 12

UNIT = np.dtype([("a", "<u8"), ("b", "<u8"), *KEY, ("at", "<u4"), ("size", "<u4"), ("words", "<u4")])
RUN = np.dtype([("at", "<u4"), ("size", "<u4"), ("words", "<u4")])

ENDS = np.isin(np.arange(256), np.frombuffer(b".!?", np.uint8))
CLOSES = np.isin(np.arange(256), np.frombuffer(b"\"')]}", np.uint8))
# The UTF-8 bytes of the ideographic full stop and of the wide exclamation and question marks.
WIDE_ENDS = (b"\xe3\x80\x82", b"\xef\xbc\x81", b"\xef\xbc\x9f")


def _after_wide(data: np.ndarray) -> np.ndarray:
    """Places after a wide mark that ends a sentence."""
    found = [np.flatnonzero((data[:-2] == e[0]) & (data[1:-1] == e[1]) & (data[2:] == e[2])) + 3 for e in WIDE_ENDS] if len(data) > 2 else []
    return np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)


def units(data: np.ndarray, offsets: np.ndarray, sentences: bool = True) -> tuple[np.ndarray, ...]:
    """Of each unit: two digests, its start, its end (the next unit's start or the text's end) and its words.

    A unit begins with a text's first word, the first word of a line and, if `sentences`, the word after
    one that ends in a mark (closing quotes and brackets aside). Normal form: A-Z in lower case, any white
    space alike. A word counts once for each WORD_BYTES bytes that it begins."""
    low = LOWER[data]
    w0, w1, _ = words(low, offsets)
    wide = _after_wide(data) if sentences else np.zeros(0, np.int64)
    if len(wide) and len(w0):
        # a wide mark ends its word even without white space
        word = np.searchsorted(w0, wide, "right") - 1
        inside = wide[(word >= 0) & (wide > w0[word]) & (wide < w1[word])]
        w0, w1 = np.sort(np.concatenate([w0, inside])), np.sort(np.concatenate([w1, inside]))
    n = len(w0)
    if not n:
        e = np.zeros(0, np.int64)
        return e.astype(np.uint64), e.astype(np.uint64), e, e, e
    doc = np.searchsorted(offsets, w0, "right") - 1
    feeds = np.concatenate([[0], np.cumsum(data == 10)])
    new = np.ones(n, bool)
    new[1:] = (doc[1:] != doc[:-1]) | (feeds[w0[1:]] != feeds[w1[:-1]])
    if sentences:
        last = w1 - 1
        for _ in range(2):
            last = np.where(CLOSES[data[last]] & (last > w0), last - 1, last)
        ended = ENDS[data[last]] | np.isin(w1, wide)
        new[1:] |= ended[:-1]
    first = np.flatnonzero(new)
    stop = np.append(first[1:], n)
    a, b = (run_hash(sequence_sums(span_hash(low, w0, w1), seed), first, stop) for seed in (0, 0x5BD1E995))
    weight = np.concatenate([[0], np.cumsum(-(-(w1 - w0) // WORD_BYTES))])
    start = w0[first].copy()
    opens = np.ones(len(first), bool)
    opens[1:] = doc[first[1:]] != doc[first[:-1]]
    start[opens] = offsets[doc[first[opens]]]
    end = np.append(start[1:], offsets[-1])
    closes = np.append(opens[1:], True)
    end[closes] = offsets[doc[first[closes]] + 1]
    return a, b, start, end, weight[stop] - weight[first]


def _settle(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Units by digest and place, each place once, and which are not their digest's first."""
    found = found[np.lexsort((found["at"], found["tie"], found["key"], found["b"], found["a"]))]
    same = lambda f: f[1:] == f[:-1]
    if len(found):
        again = same(found["a"]) & same(found["b"]) & same(found["key"]) & same(found["tie"]) & same(found["at"])
        found = found[np.concatenate([[True], ~again])]
    return found, np.concatenate([np.zeros(min(len(found), 1), bool), same(found["a"]) & same(found["b"])])


def _runs(rest: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    out = np.empty(len(rest), RUN)
    for f in RUN.names:
        out[f] = rest[f]
    return by_key(out, rest["key"], rest["tie"])


def removed_runs(found: np.ndarray, least_run: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of adjoining repeated units that have at least `least_run` words."""
    found = found[np.argsort(found["at"], kind="stable")]
    if not len(found):
        e = np.zeros(0, np.int64)
        return e, e
    at, end = found["at"].astype(np.int64), found["at"].astype(np.int64) + found["size"]
    head = np.flatnonzero(np.concatenate([[True], at[1:] != end[:-1]]))
    total = np.add.reduceat(found["words"].astype(np.int64), head)
    last = np.append(head[1:], len(found)) - 1
    keep = total >= least_run
    return at[head[keep]], end[last[keep]]


def repeated_units(keyed: DataFrame, _fetched: Callable, sentences: bool) -> DataFrame:
    """key, tie and spans (packed units) of the rows that hold units which occur earlier, too."""
    total = keyed.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(4 * keyed.sparkSession.sparkContext.defaultParallelism, -(-total // BUCKET))
    kinds = [pa.int64(), pa.int32(), pa.binary()]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def send() -> Iterator[pa.RecordBatch]:
            found, later = _settle(np.concatenate(held))
            rows = [(b, 0, blob) for b, blob in by_bucket(found[~later], (found["a"][~later] >> np.uint64(8)).astype(np.int64) % buckets)]
            # what repeats in this task is settled here: a unit's copies do not meet in one bucket
            rows += [((k ^ t) % buckets, 1, keyed_blob(k, t, blob)) for k, t, blob in _runs(found[later])]
            for lo in range(0, len(rows), 2000):
                yield batch_of(rows[lo : lo + 2000], ["bucket", "kind", "blob"], kinds)

        for batch in batches:
            offsets, data = texts(batch.column(2))
            keys, ties = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for lo, hi in parts(offsets):
                own = offsets[lo : hi + 1] - offsets[lo]
                if not own[-1]:
                    continue
                a, b, starts, ends, weight = units(data[offsets[lo] : offsets[hi]], own, sentences)
                # an empty text begins where the next one does: the last text that begins there is the unit's
                doc = np.searchsorted(own, starts, "right") - 1
                table = np.empty(len(a), UNIT)
                table["a"], table["b"], table["key"], table["tie"] = a, b, keys[lo + doc], ties[lo + doc]
                table["at"], table["size"], table["words"] = starts - own[doc], ends - starts, weight
                held.append(table)
                size += int(own[-1])
                if size > FLUSH:
                    yield from send()
                    held, size = [], 0
        if held:
            yield from send()

    def group(table: pa.Table) -> pa.Table:
        blobs, kind = table.column("blob").to_pylist(), table.column("kind").to_pylist()
        rows = [split_blob(b) for b, k in zip(blobs, kind, strict=True) if k]
        found, later = _settle(unpack([b for b, k in zip(blobs, kind, strict=True) if not k], UNIT))
        rows += list(_runs(found[later]))
        return pa.Table.from_batches([batch_of(rows, ["key", "tie", "blob"], [pa.int64(), pa.int64(), pa.binary()])])

    sent = keyed.select("key", "tie", "text").mapInArrow(trimmed(digest), "bucket long, kind int, blob binary")
    return sent.groupBy("bucket").applyInArrow(group, "key long, tie long, blob binary").groupBy("key", "tie").agg(F.collect_list("blob").alias("spans"))


def line_dedup(docs: DataFrame, least_run: int = LEAST_RUN, sentences: bool = True) -> DataFrame:
    """One row for each document: doc_id, n_bytes, n_removed (bytes), n_spans, kept_sha256, n_lines,
    removed: the removed runs as [start, end) in the bytes of the original text, and repeated and n_repeated: likewise
    all runs of repeated units, whatever their length, and their bytes.

    Every unit with a word is hashed; of units with one normal form the earliest (smaller doc_id, then earlier
    start) is the original. Adjoining units that are not originals go if together they have `least_run`
    words or more, with the white space that follows them: stock phrases stay, copied paragraphs go. With
    sentences=False and least_run=1 the units are whole lines, and every repeated one goes.

    A null or empty text loses nothing; an empty table gives an empty table. A null doc_id is the least. Rows
    that repeat doc_id and text are one place and share a result; of different texts with one doc_id the
    order of their hashes decides. Columns other than doc_id and text are not looked at.
    """
    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "n_lines", "n_repeated"]
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = texts(batch.column(1))
            rows, removed, repeated = [], [], []
            for i, blobs in enumerate(batch.column(2).to_pylist()):
                text = data[offsets[i] : offsets[i + 1]].tobytes()
                found = unpack(blobs or [], RUN)
                a, b = (v.tolist() for v in removed_runs(found, least_run))
                every = [v.tolist() for v in removed_runs(found, 0)]
                kept, at = hashlib.sha256(), 0
                for x, y in zip(a, b, strict=True):
                    kept.update(text[at:x])
                    at = y
                kept.update(text[at:])
                rows.append((len(text), sum(b) - sum(a), len(a), kept.hexdigest(), text.count(b"\n") + (not text.endswith(b"\n")) if text else 0, sum(every[1]) - sum(every[0])))
                removed.append([{"start": x, "end": y} for x, y in zip(a, b, strict=True)])
                repeated.append([{"start": x, "end": y} for x, y in zip(*every, strict=True)])
            made = batch_of(rows, names, [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()])
            yield pa.RecordBatch.from_arrays([batch.column(0), *made.columns, pa.array(removed, span), pa.array(repeated, span)], names=["doc_id", *names, "removed", "repeated"])

    rows, spans = with_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), lambda keyed, fetched: repeated_units(keyed, fetched, sentences))
    return rows.select("doc_id", "text", spans).mapInArrow(trimmed(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_lines long, n_repeated long, removed array<struct<start:bigint,end:bigint>>, repeated array<struct<start:bigint,end:bigint>>")
