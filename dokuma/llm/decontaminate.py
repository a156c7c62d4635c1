"""Benchmark decontamination: rare n-gram seeds join passages of training text to test items, and
Smith-Waterman alignment scores them, so that edited copies are found as well as verbatim ones."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dokuma.llm.common import LOWER, U64, batch_of, mix, parts, span_hash, texts, trimmed
from dokuma.session import Rows, stage

#: Words of a seed; of this many seeds in a row of an item, the rarest in the corpus is looked for, and so
#: is every seed that occurs up to COMMON times: of an edited copy the rarest ones may be gone.
SEED, RARE, COMMON = 3, 4, 1000
#: Items are taken so many words at a time: what is broadcast stays bounded, however many items there are.
BLOCK_WORDS = 1_000_000
#: Score of an alignment (1 for a word in common, -1 for a change or a gap) over the item's words, and
#: words in common, from which on a passage counts as a copy. Shorter items must match as a whole.
SHARE, LEAST_WORDS = 0.5, 8
#: Or, whatever the item's length: words in common, and their share of the aligned span (words in common,
#: changes and gaps), from which on a passage counts as an excerpt.
EXCERPT, IDENTITY = 13, 0.55

WORD = np.zeros(256, bool)
WORD[128:] = True
for _lo, _hi in ((48, 58), (65, 91), (97, 123)):
    WORD[_lo:_hi] = True


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of words (letters, digits and bytes over 127, A-Z in lower case; punctuation
    only parts them), and each text's first word."""
    n = len(data)
    if not n:
        e = np.zeros(0, np.int64)
        return e.astype(U64), e, e, np.zeros(len(offsets), np.int64)
    solid = WORD[data]
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = solid[:-1], solid[1:]
    cut = offsets[(offsets > 0) & (offsets < n)]
    before[cut], after[cut - 1] = False, False
    starts, ends = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
    return span_hash(LOWER[data], starts, ends), starts, ends, np.searchsorted(starts, offsets)


def seeds(words: np.ndarray) -> np.ndarray:
    """Hash of the SEED words from each word on."""
    if len(words) < SEED:
        return np.zeros(0, U64)
    h = words[: len(words) - SEED + 1].copy()
    for i in range(1, SEED):
        h = mix(h * U64(0xA0761D6478BD642F) + words[i : len(words) - SEED + 1 + i])
    return h


def align(items: list[np.ndarray], passages: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Smith-Waterman over all pairs at once, a row of every matrix at a time: best score, words in common
    on the way there, and the passage words where the best alignment starts and ends."""
    n, m = len(items), max(map(len, items))
    w = max(map(len, passages))
    a, b = np.zeros((n, m), U64), np.full((n, w), 1, U64)  # 0 and 1 match nothing, as hashes are odds and ends
    for i, (x, y) in enumerate(zip(items, passages, strict=True)):
        a[i, : len(x)], b[i, : len(y)] = x, y
    score = np.zeros((n, w + 1), np.int32)
    hits, begin = np.zeros((n, w + 1), np.int32), np.tile(np.arange(w + 1, dtype=np.int32), (n, 1))
    best = np.zeros(n, np.int32)
    found = [np.zeros(n, np.int32) for _ in range(3)]
    ramp = np.arange(w + 1, dtype=np.int64)
    rows = np.arange(n)
    for i in range(m):
        same = (b == a[:, i : i + 1]) & (a[:, i : i + 1] != 0)
        diagonal = score[:, :-1] + np.where(same, 1, -1)
        up = score[:, 1:] - 1
        take = diagonal >= up
        new = np.zeros((n, w + 1), np.int32)
        new[:, 1:] = np.maximum(np.where(take, diagonal, up), 0)
        h, s = np.zeros_like(hits), np.tile(np.arange(w + 1, dtype=np.int32), (n, 1))
        h[:, 1:] = np.where(take, hits[:, :-1] + same, hits[:, 1:])
        s[:, 1:] = np.where(take, begin[:, :-1], begin[:, 1:])
        fresh = new == 0
        h[fresh] = 0
        s[fresh] = np.broadcast_to(ramp.astype(np.int32), (n, w + 1))[fresh]
        # gaps along the passage: the best cell to the left, less its distance
        packed = (new.astype(np.int64) + ramp) * (w + 2) + (w + 1 - ramp)
        reach = np.maximum.accumulate(packed, 1)
        source = (w + 1 - reach % (w + 2)).astype(np.int64)
        gapped = (reach // (w + 2) - ramp).astype(np.int32)
        move = gapped > new
        new = np.where(move, gapped, new)
        h = np.where(move, np.take_along_axis(h, source, 1), h)
        s = np.where(move, np.take_along_axis(s, source, 1), s)
        score, hits, begin = new, h, s
        top = score.argmax(1)
        better = score[rows, top] > best
        best[better] = score[rows, top][better]
        for out, value in zip(found, (hits[rows, top], begin[rows, top], top), strict=True):
            out[better] = value[better]
    return best, *found


def _corpus_counts(docs: DataFrame, wanted: np.ndarray) -> np.ndarray:
    """How often each wanted seed occurs in all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)  # BLOCK_WORDS seeds at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        know = shared.value
        filter_ = np.zeros(1 << 22, bool)
        filter_[(know >> U64(42)).astype(np.int64)] = True
        total = np.zeros(len(know), np.int64)
        for batch in batches:
            offsets, data = texts(batch.column(0))
            for lo, hi in parts(offsets):
                w, _, _, first = tokens(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                s = seeds(w)
                s = s[filter_[(s >> U64(42)).astype(np.int64)]]
                at = np.searchsorted(know, s)
                at[at == len(know)] = 0
                at = at[know[at] == s]
                total += np.bincount(at, minlength=len(know))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "n"])

    out = np.zeros(len(wanted), np.int64)
    if len(wanted):
        for r in docs.select("text").mapInArrow(trimmed(run), "at long, n long").groupBy("at").agg(F.sum("n")).collect():  # a row for each wanted seed at most
            out[r[0]] = r[1]
    return out


def _rarest(items: dict[int, np.ndarray], counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Seeds to look for: hash, item and place. Of every RARE seeds in a row the rarest is one, as are all of
    up to COMMON occurrences."""
    out = []
    for item, words in items.items():
        own = seeds(words)
        n = np.array([counts[h] for h in own.tolist()])
        picked = set(np.flatnonzero((n > 0) & (n <= COMMON)).tolist())
        for lo in range(max(len(own) - RARE + 1, 1) if len(own) else 0):
            picked.add(lo + int(np.argmin(n[lo : lo + RARE])))
        out += [(int(own[p]), item, p) for p in sorted(picked)]
    out.sort()
    h, i, p = zip(*out, strict=True) if out else ((), (), ())
    return np.array(h, U64), np.array(i, np.int64), np.array(p, np.int64)


def _leaks(docs: DataFrame, items: dict[int, np.ndarray]) -> DataFrame:
    every = np.unique(np.concatenate([seeds(w) for w in items.values()] or [np.zeros(0, U64)]))
    counts = dict(zip(every.tolist(), _corpus_counts(docs, every).tolist(), strict=True))
    shared = docs.sparkSession.sparkContext.broadcast((_rarest(items, counts), items))
    names = ["doc_id", "item_id", "score", "matched_words", "item_words", "start", "end"]
    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (known, of_item, place), words_of = shared.value
        filter_ = np.zeros(1 << 22, bool)
        filter_[(known >> U64(42)).astype(np.int64)] = True

        def candidates(w: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
            """(text, item, from word, to word): around each run of seeds on nearby diagonals."""
            s = seeds(w)
            at = np.flatnonzero(filter_[(s >> U64(42)).astype(np.int64)]) if len(s) else np.zeros(0, np.int64)
            lo, hi = np.searchsorted(known, s[at], "left"), np.searchsorted(known, s[at], "right")
            times = hi - lo
            at = np.repeat(at, times)
            seed = np.repeat(lo, times) + np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
            doc = np.searchsorted(first, at, "right") - 1
            keep = at + SEED <= first[doc + 1]
            at, seed, doc = at[keep], seed[keep], doc[keep]
            item, diagonal = of_item[seed], at - place[seed]
            order = np.lexsort((diagonal, item, doc))
            doc, item, diagonal = doc[order], item[order], diagonal[order]
            i = 0
            while i < len(doc):
                size = len(words_of[int(item[i])])
                slack, j = size // 4 + 4, i + 1
                while j < len(doc) and doc[j] == doc[i] and item[j] == item[i] and diagonal[j] <= diagonal[j - 1] + slack and diagonal[j] - diagonal[i] <= size:
                    j += 1
                yield int(doc[i]), int(item[i]), max(int(first[doc[i]]), int(diagonal[i]) - slack), min(int(first[doc[i] + 1]), int(diagonal[j - 1]) + size + slack)
                i = j

        for batch in batches:
            offsets, data = texts(batch.column(1))
            ids = batch.column(0).to_pylist()
            for lo, hi in parts(offsets):
                own = offsets[lo : hi + 1] - offsets[lo]
                w, starts, ends, first = tokens(data[offsets[lo] : offsets[hi]], own)
                found = sorted(candidates(w, first), key=lambda c: (len(words_of[c[1]]), c[3] - c[2]))
                rows = []
                for k in range(0, len(found), 64):
                    some = found[k : k + 64]
                    score, hits, begin, stop = align([words_of[i] for _, i, _, _ in some], [w[a:b] for _, _, a, b in some])
                    for (doc, item, a, _), sc, n, x, y in zip(some, score.tolist(), hits.tolist(), begin.tolist(), stop.tolist(), strict=True):
                        size = len(words_of[item])
                        # n - sc changes and gaps
                        if sc >= SHARE * size and n >= min(LEAST_WORDS, size) or n >= EXCERPT and n >= IDENTITY * (2 * n - sc):
                            rows.append((ids[lo + doc], item, sc / size, n, size, int(starts[a + x] - own[doc]), int(ends[a + y - 1] - own[doc])))
                if rows:
                    yield batch_of(rows, names, kinds)

    return docs.select("doc_id", "text").mapInArrow(trimmed(run), "doc_id long, item_id long, score double, matched_words long, item_words long, start long, end long")


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each (document, item) of which some passage is a copy: doc_id, item_id, score (alignment
    score over the item's words), matched_words, item_words, start and end (bytes of the passage in the text).
    A copy has a score of SHARE, or is an excerpt: EXCERPT words in common at IDENTITY within the passage.

    Null or empty texts and items take no part, nor do items of fewer than SEED words. Of several passages
    the best counts, ties to the earlier one. Items with one id are each looked for, and the best counts.
    Rows that repeat a document give one row. All documents are read once for each BLOCK_WORDS words
    of items, first to count the items' seeds and again to find them.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text"))
    words = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] // 4
    blocks = max(1, -(-words // BLOCK_WORDS))
    found = None
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()  # a bounded block
        known: dict[int, np.ndarray] = {}
        names: dict[int, int] = {}
        for r in sorted(rows, key=lambda r: (r[0], r[1])):
            raw = np.frombuffer(r[1].encode("utf-8"), np.uint8)
            w = tokens(raw, np.array([0, len(raw)]))[0]
            if len(w) >= SEED:
                names[len(known)] = r[0]
                known[len(known)] = w
        own = _leaks(base, known)
        mapping = docs.sparkSession.createDataFrame(list(names.items()) or [(-1, -1)], "no long, item long")
        own = own.join(F.broadcast(mapping), own["item_id"] == mapping["no"]).select("doc_id", F.col("item").alias("item_id"), "score", "matched_words", "item_words", "start", "end")
        found = own if found is None else found.unionByName(own)
    best = Window.partitionBy("doc_id", "item_id").orderBy(F.desc("score"), "start", "end")
    return stage(found.withColumn("_no", F.row_number().over(best)).where("_no = 1").drop("_no"), "leaks")


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a copy of any item, with all their columns, whatever their names. Each row is judged
    by its own text, so null and repeated ids are allowed; null and empty texts stay; repeated rows share
    their fate; an empty table gives an empty table, and without items all rows stay."""
    rows = Rows(docs, "texts")
    found = leaks(rows.df.select(F.col(rows.id).alias("doc_id"), "text"), benchmark)
    return rows.where(found.select("doc_id"), keep=False).select(*docs.columns)
