"""Quality rules by compression bands: zstandard ratios of whole documents and of fixed chunks, held against limits
that depend on the length of what was compressed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dokuma.llm.common import SPACE, U64, parts, run_hash, sequence_sums, span_hash, texts, trimmed, words

#: Compression level; bytes of a chunk; share of a text's bytes (in 1000) that may lie in chunks outside their band.
LEVEL, CHUNK, SHARE = 3, 4096, 250
#: Bands: up to so many bytes, the least and the greatest ratio (in 1000) of bytes to compressed bytes. What is shorter than the first
#: has no limits: a frame's own bytes outweigh the text. Prose in any language lies near the middle; random bytes and base64
#: reach 1.0 to 1.35, repeated phrases 5 and more.
BANDS = ((64, 0, 2**40), (256, 600, 2500), (512, 1100, 3000), (1024, 1300, 3250), (4096, 1400, 3500), (16384, 1400, 4000), (65536, 1400, 4500), (2**62, 1400, 5000))
#: Words of a window, least words of a text, and share (in 100) of words that may stand in windows found twice.
WINDOW, LEAST_WORDS, REPEATED = 5, 10, 20

_UPTO = np.array([b[0] for b in BANDS])
_LEAST, _MOST = (np.array([b[i] for b in BANDS]) for i in (1, 2))
_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))


def outside(size: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """Whether texts of `size` bytes that compress to `packed` lie outside the band of their length."""
    band = np.searchsorted(_UPTO, size, "right").clip(max=len(BANDS) - 1)
    ratio = size * 1000 // np.maximum(packed, 1)
    return (ratio < _LEAST[band]) | (ratio > _MOST[band])


def base_counts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each text: its words, their code points, its symbols, its repeated lines, and its words in windows found twice."""
    n = len(offsets) - 1
    total = lambda flags: (lambda sums: sums[offsets[1:]] - sums[offsets[:-1]])(np.concatenate([[0], np.cumsum(flags)]))
    w0, w1, first = words(data, offsets)
    n_words = np.diff(first)
    chars, symbols = total(((data & 0xC0) != 0x80) & ~SPACE[data]), total(_SYMBOL[data])

    # lines: what lies between line feeds and the texts' ends
    cuts = np.unique(np.concatenate([offsets, np.flatnonzero(data == 10) + 1]))
    l0, l1 = cuts[:-1], cuts[1:].copy()
    l1[data[l1 - 1] == 10] -= 1
    full = np.searchsorted(w0, l0) < np.searchsorted(w0, l1)
    l0, l1 = l0[full], l1[full]
    doc = np.searchsorted(offsets, l0, "right") - 1
    order = np.lexsort((h := span_hash(data, l0, l1), doc))
    again = (h[order][1:] == h[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    dup_lines = np.bincount(doc[order][1:][again], minlength=n)

    # windows: those whose last word is in the same text
    word_doc = np.repeat(np.arange(n), n_words)
    at = np.arange(max(len(w0) - WINDOW + 1, 0))
    at = at[word_doc[at] == word_doc[at + WINDOW - 1]]
    h = run_hash(sequence_sums(span_hash(data, w0, w1)), at, at + WINDOW) if len(at) else np.zeros(0, U64)
    doc = word_doc[at]
    order = np.lexsort((h, doc))
    same = np.zeros(len(at) + 1, bool)
    same[1:-1] = (h[order][1:] == h[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    twice = at[order][same[1:] | same[:-1]]
    cover = np.bincount(twice, minlength=len(w0) + 1) - np.bincount(twice + WINDOW, minlength=len(w0) + 1)[: len(w0) + 1]
    covered = np.concatenate([[0], np.cumsum(np.cumsum(cover)[: len(w0)] > 0)])
    return n_words, chars, symbols, dup_lines, covered[first[1:]] - covered[first[:-1]]


def compression_bands(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, and
    what the verdict rests on: n_bytes, packed_bytes, n_chunks, n_bad_chunks, whole_outside, chunks_outside.

    Words are maximal runs without white space; a repeated line has a word and equals an earlier one; n_repeat_words are the
    words in windows of WINDOW words that occur twice or more in the text. base_failed: fewer than LEAST_WORDS words, or more
    than REPEATED in 100 of them in such windows. Of the other texts, those go whose ratio of bytes to zstandard bytes lies
    outside the band of their length (BANDS), or of whose bytes more than SHARE in 1000 lie in chunks of CHUNK bytes that, each
    compressed alone, lie outside theirs (the last chunk may be shorter and has the band of its own length).

    One pass over whole texts without a shuffle; a text of any length is one row. A null or empty text has no words and is not
    kept. Null ids, repeated rows and further columns play no part: each row is judged alone, and an empty table gives an
    empty one. Windows and lines are compared by 64-bit hashes within a text."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_bytes", "packed_bytes", "n_chunks", "n_bad_chunks", "whole_outside", "chunks_outside"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=LEVEL)
        size_of = lambda raw: len(packer.compress(raw))
        for batch in batches:
            offsets, data = texts(batch.column(1))
            for lo, hi in parts(offsets):
                own, body = offsets[lo : hi + 1] - offsets[lo], data[offsets[lo] : offsets[hi]]
                counts = base_counts(body, own)
                failed = (counts[0] < LEAST_WORDS) | (100 * counts[4] > REPEATED * counts[0])
                size, raw = np.diff(own), memoryview(np.ascontiguousarray(body))
                packed = np.array([size_of(raw[a:b]) for a, b in zip(own[:-1].tolist(), own[1:].tolist(), strict=True)], np.int64)
                n_chunks = -(-size // CHUNK)
                doc = np.repeat(np.arange(hi - lo), n_chunks)
                from_ = own[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(n_chunks) - n_chunks, n_chunks)) * CHUNK
                to = np.minimum(from_ + CHUNK, own[doc + 1])
                bad = outside(to - from_, np.array([size_of(raw[a:b]) for a, b in zip(from_.tolist(), to.tolist(), strict=True)], np.int64))
                n_bad = np.bincount(doc[bad], minlength=hi - lo)
                bad_bytes = np.bincount(doc[bad], weights=(to - from_)[bad], minlength=hi - lo)
                whole, chunks = outside(size, packed), bad_bytes * 1000 > SHARE * size
                made = [*counts, failed, ~failed & ~whole & ~chunks, size, packed, n_chunks, n_bad, whole, chunks]
                made = [pa.array(c) if c.dtype == bool else pa.array(c.astype(np.int64)) for c in made]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *made], names=["doc_id", *names])

    kinds = ", ".join(f"{c} {'boolean' if c in ('base_failed', 'kept') or c.endswith('_outside') else 'long'}" for c in names)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(trimmed(run), f"doc_id long, {kinds}")
