"""Training of byte-pair merges on a word list of any size: words and pair weights stay in partitions, and each round
applies as many merges as the next steps of the sequential rule are known to be."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dokuma.session import forget, stage

#: Words of one packed row, and heaviest pairs that each bucket of weights reports.
WORDS_A_ROW, CANDIDATES = 20_000, 256
_END = -1


def _sums(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, with the sum of its weights, without zeros."""
    found, at = np.unique(keys, return_inverse=True)
    total = np.zeros(len(found), np.int64)
    np.add.at(total, at, weights)
    return found[total != 0], total[total != 0]


def _pairs(syms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys (left << 32 | right) of the neighbouring symbols of all words, and the words' counts."""
    word = np.cumsum(syms == _END) - (syms == _END)
    left, right = syms[:-1].astype(np.int64), syms[1:].astype(np.int64)
    inside = (left != _END) & (right != _END)
    return (left << 32 | right)[inside], counts[word[:-1][inside]]


def _merged(syms: np.ndarray, keys: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols with the pairs `keys` (sorted) replaced by `new`, and where pairs were merged. No pair's right symbol is
    another's left one; in a run of one symbol every second place merges."""
    pair = np.full(len(syms), -1, np.int64)
    left, right = syms[:-1].astype(np.int64), syms[1:].astype(np.int64)
    pair[:-1] = np.where((left == _END) | (right == _END), -1, left << 32 | right)
    at = np.searchsorted(keys, pair).clip(max=len(keys) - 1)
    hit = np.flatnonzero(keys[at] == pair)
    if not len(hit):
        return syms, hit
    heads = np.concatenate([[True], np.diff(hit) != 1])
    start = hit[heads][np.cumsum(heads) - 1]
    hit = hit[(hit - start) % 2 == 0]
    out = syms.copy()
    out[hit] = new[at[hit]]
    keep = np.ones(len(syms), bool)
    keep[hit + 1] = False
    return out[keep], hit


def _apply(syms: np.ndarray, counts: np.ndarray, keys: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words after the merges, and what the merges change in the weights of pairs."""
    out, hit = _merged(syms, keys, new)
    if not len(hit):
        return syms, np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = np.cumsum(syms == _END) - (syms == _END)
    touched = np.zeros(len(counts), bool)
    touched[word[hit]] = True
    word_out = np.cumsum(out == _END) - (out == _END)
    before = _pairs(syms[touched[word]], counts[touched])
    after = _pairs(out[touched[word_out]], counts[touched])
    return out, *_sums(np.concatenate([before[0], after[0]]), np.concatenate([-before[1], after[1]]))


def _batch(heaviest: list[tuple[int, int]], most: int) -> list[tuple[int, int]]:
    """The merges that come next for certain, of the heaviest pairs (weight, key) in their order.

    A merge of (a, b) changes only pairs that end in a or begin with b. A pair that it makes weighs no more than one that it
    takes from, which is at most what the last pair taken here weighs, and on equal weights its new symbol comes last. So the
    pairs up to the first that ends or begins with what another one loses are merged in just this order. A pair of equal
    symbols also makes pairs from itself, so nothing is taken after it."""
    out, lefts, rights = [], set(), set()
    for weight, key in heaviest[:most]:
        a, b = key >> 32, key & 0xFFFFFFFF
        if weight <= 0 or a in rights or b in lefts:
            break
        out.append((a, b))
        if a == b:
            break
        lefts.add(a)
        rights.add(b)
    return out


def train(words: DataFrame, merges: int, candidates: int = CANDIDATES) -> list[tuple[int, int, int]]:
    """(left, right, new) of each merge over all words (word, cnt): the heaviest pair first, ties by left, then right.

    Words lie packed in rows of WORDS_A_ROW; weights of pairs lie in buckets by key. A round sends the next certain merges
    (_batch) to the words' tasks, which rewrite only words that hold them and send what changes in the weights, summed by pair, to
    the buckets; these report their heaviest pairs. The driver sees `candidates` pairs of each bucket and the merges made,
    never words or weights. Every round's tables are written, so a lost executor costs a part of one round.

    Words that are null, empty or of no count are passed over; a word that comes twice counts twice."""
    spark = words.sparkSession
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    kinds = "kind int, bucket int, a binary, b binary"
    fields = [("kind", pa.int32()), ("bucket", pa.int32()), ("a", pa.binary()), ("b", pa.binary())]

    def rows(made: list[tuple[int, int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        columns = [[r[0] for r in made], [r[1] for r in made], [r[2].tobytes() for r in made], [r[3].tobytes() for r in made]]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])

    def sent(keys: np.ndarray, weights: np.ndarray) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        own = ((keys * np.int64(0x9E3779B97F4A7C15 - 2**64)) >> np.int64(40)) % buckets
        order = np.argsort(own, kind="stable")
        edges = np.searchsorted(own[order], np.arange(buckets + 1))
        return [(1, b, keys[order[lo:hi]], weights[order[lo:hi]]) for b, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if hi > lo]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, WORDS_A_ROW):
                part = batch.slice(lo, WORDS_A_ROW)
                texts = [np.frombuffer(w, np.uint8).astype(np.int32) for w in part.column(0).cast(pa.binary()).to_pylist()]
                syms = np.concatenate([x for t in texts for x in (t, np.array([_END], np.int32))]).astype("<i4")
                counts = part.column(1).to_numpy().astype("<i8")
                yield rows([(0, 0, syms, counts), *sent(*_sums(*_pairs(syms, counts)))])

    def step(keys: np.ndarray, new: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                    counts = np.frombuffer(b, "<i8")
                    syms, changed, by = _apply(np.frombuffer(a, "<i4"), counts, keys, new)
                    yield rows([(0, 0, syms, counts), *sent(changed, by)])

        return run

    def gather(table: pa.Table) -> pa.Table:
        keys, weights = (np.concatenate([np.frombuffer(v, "<i8") for v in table.column(c).to_pylist()]) for c in ("a", "b"))
        keys, weights = _sums(keys, weights)
        few = np.argpartition(-weights, candidates - 1)[:candidates] if len(keys) > candidates else np.arange(len(keys))
        # all that weigh as much as the last one: ties are decided by key
        few = np.flatnonzero(weights >= weights[few].min()) if len(few) else few
        few = few[np.lexsort((keys[few], -weights[few]))][:candidates]
        bucket = table.column("bucket")[0].as_py()
        return pa.Table.from_batches([rows([(1, bucket, keys, weights), (2, bucket, keys[few], weights[few])])])

    listed = words.where("word is not null and word <> '' and cnt > 0").select("word", F.col("cnt").cast("long").alias("cnt"))
    state = stage(listed.mapInArrow(pack, kinds), "merge_words", by="kind")
    weights = None
    made: list[tuple[int, int, int]] = []
    while True:
        sums = state.where("kind = 1") if weights is None else state.where("kind = 1").unionByName(weights.where("kind = 1"))
        now = stage(sums.groupBy("bucket").applyInArrow(gather, kinds), "merge_weights", by="kind")
        if weights is not None:
            forget(weights, sweep=False)
        weights = now
        tops = [(w, k) for r in weights.where("kind = 2").select("a", "b").collect() for k, w in zip(np.frombuffer(r["a"], "<i8").tolist(), np.frombuffer(r["b"], "<i8").tolist(), strict=True)]
        heaviest = sorted(tops, key=lambda t: (-t[0], t[1]))[:candidates]
        chosen = _batch(heaviest, merges - len(made))
        if not chosen:
            break
        own = [(a, b, 256 + len(made) + i) for i, (a, b) in enumerate(chosen)]
        made += own
        if len(made) == merges:
            break
        order = sorted((a << 32 | b, z) for a, b, z in own)
        after = stage(state.where("kind = 0").mapInArrow(step(np.array([k for k, _ in order]), np.array([z for _, z in order], np.int32)), kinds), "merge_words", by="kind")
        forget(state, sweep=False)
        state = after
    forget(state, weights)
    return made
