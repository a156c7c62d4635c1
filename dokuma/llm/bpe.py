"""Byte-level BPE encoding and decoding by a two-tier lookup.

Tier one: a minimal perfect hash resolves whole pre-tokens that are tokens themselves. Tier two: other
pre-tokens are merged with a heap over linked bytes, once for each distinct one.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dokuma.llm.common import U64, mix, parts, ramp, span_hash, texts, trimmed
from dokuma.llm.pretoken import class_table, code_points, pre_tokens, safe_cuts

#: Distinct missed pre-tokens that a worker remembers before it starts afresh.
REMEMBERED = 200_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class PerfectHash:
    """A minimal perfect hash: n distinct 64-bit keys to slots 0 to n - 1, by one displacement a bucket."""

    def __init__(self, keys: np.ndarray):
        self.n, self.buckets, self.seed = len(keys), max(1, len(keys) // 2), 0
        while not self._build(keys):
            self.seed += 1
            if self.seed > 200:
                raise ValueError("no perfect hash found: are the keys distinct?")

    def _build(self, keys: np.ndarray) -> bool:
        bucket, base = self._places(keys)
        order = np.argsort(bucket, kind="stable")
        ends = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        free = np.ones(self.n, bool)
        self.shift = np.zeros(self.buckets, np.int64)
        rng = np.random.Generator(np.random.PCG64(7))
        singles = []
        for b in np.argsort(-np.diff(ends), kind="stable"):
            own = base[order[ends[b] : ends[b + 1]]]
            if len(own) == 1:
                singles.append((b, own[0]))
            elif len(own):
                if len(np.unique(own)) < len(own):
                    return False  # two keys share bucket and place: other hashes
                for tries in (*rng.integers(0, self.n, (40, 64)), np.arange(self.n)):  # at random, then all
                    good = free[(own[:, None] + tries) % self.n].all(0)
                    if good.any():
                        self.shift[b] = tries[np.argmax(good)]
                        free[(own + self.shift[b]) % self.n] = False
                        break
                else:
                    return False
        for (b, place), slot in zip(singles, np.flatnonzero(free), strict=True):
            self.shift[b] = (slot - place) % self.n
        return True

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mixed = mix(keys + U64(self.seed))
        return ((mixed >> U64(40)) % U64(self.buckets)).astype(np.int64), (mixed % U64(self.n)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        bucket, base = self._places(keys)
        return (base + self.shift[bucket]) % self.n


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of a pre-token: the adjacent pair of least rank, leftmost first, merges until none is known.
    A heap holds the pairs; the pieces are linked by the bytes at which they begin."""
    n = len(word)
    if n == 1:
        return [ranks[word]]
    after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i]
        if end[i] == 0 or j >= n or end[j] != stop:  # one of the two pieces has merged since
            continue
        end[i], end[j] = stop, 0
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (r := ranks.get(word[i : end[k]])) is not None:
                heapq.heappush(heap, (r, i, end[k]))
        if (h := before[i]) >= 0 and (r := ranks.get(word[h:stop])) is not None:
            heapq.heappush(heap, (r, h, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = after[i]
    return out


class Codec:
    def __init__(self, path: str):
        import tiktoken

        self.ranks = read_ranks(path)
        single = {bytes([b]): b for b in range(256)}
        found = lambda pattern, text: bytes(tiktoken.Encoding("classes", pat_str=pattern, mergeable_ranks=single, special_tokens={}).encode_ordinary(text))
        self.kind = class_table(found)
        tokens = sorted(self.ranks, key=self.ranks.get)
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.at = np.cumsum(self.length) - self.length
        self.id = np.array([self.ranks[t] for t in tokens], np.uint32)
        self.token_of = np.full(int(self.id.max(initial=0)) + 1, -1, np.int64)
        self.token_of[self.id] = np.arange(len(tokens))
        keys = span_hash(self.bytes, self.at, self.at + self.length)
        self.hash = PerfectHash(keys)
        self.slot = np.empty(len(tokens), np.int64)
        self.slot[self.hash(keys)] = np.arange(len(tokens))
        self.missed: dict[bytes, bytes] = {}

    def _same(self, data: np.ndarray, starts: np.ndarray, other: np.ndarray, at: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Whether data and other hold the same bytes at starts and at, 8 bytes at a time."""
        good = np.ones(len(starts), bool)
        pads = [np.concatenate([x, np.zeros(8, np.uint8)]) for x in (data, other)]
        a, b = (np.ndarray(len(x) - 7, "<u8", x, strides=(1,)) for x in pads)
        live = np.arange(len(starts))
        for k in range(0, int(lengths.max(initial=0)), 8):
            live = live[lengths[live] > k]
            wide = np.minimum(lengths[live] - k, 8).astype(U64)
            mask = U64(0xFFFFFFFFFFFFFFFF) >> (U64(64) - U64(8) * wide)
            good[live] &= ((a[starts[live] + k] ^ b[at[live] + k]) & mask) == 0
        return good

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and each text's first place among them."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        cp, at = code_points(data)
        first = np.zeros(len(cp), bool)
        inside = offsets[:-1][offsets[:-1] < len(data)]
        first[np.searchsorted(at, inside)] = True
        starts = at[pre_tokens(cp, self.kind[cp], first)]
        ends = np.append(starts[1:], len(data))
        lengths, keys = ends - starts, span_hash(data, starts, ends)
        token = self.slot[self.hash(keys)]
        hit = self.length[token] == lengths
        hit[hit] = self._same(data, starts[hit], self.bytes, self.at[token[hit]], lengths[hit])
        counts = np.ones(len(starts), np.int64)
        miss = np.flatnonzero(~hit)
        _, rep, inverse = np.unique(keys[miss], return_index=True, return_inverse=True)
        own = miss[rep][inverse]
        if not (lengths[own] == lengths[miss]).all() or not self._same(data, starts[miss], data, starts[own], lengths[miss]).all():
            rep, inverse = np.arange(len(miss)), np.arange(len(miss))  # two words share a hash: each for itself
        body, packed = data.tobytes(), []
        for i in miss[rep]:
            word = body[starts[i] : ends[i]]
            ids = self.missed.get(word)
            if ids is None:
                if len(self.missed) >= REMEMBERED:
                    self.missed.clear()
                ids = np.array(merge(word, self.ranks), "<u4").tobytes()
                if len(word) < 200:
                    self.missed[word] = ids
            packed.append(ids)
        sizes = np.array([len(x) // 4 for x in packed], np.int64)
        pool, pool_at = np.frombuffer(b"".join(packed), "<u4"), np.cumsum(sizes) - sizes
        counts[miss] = sizes[inverse]
        places = np.concatenate([[0], np.cumsum(counts)])
        ids = np.empty(places[-1], np.uint32)
        ids[places[:-1][hit]] = self.id[token[hit]]
        step = ramp(counts[miss])
        ids[np.repeat(places[miss], counts[miss]) + step] = pool[np.repeat(pool_at[inverse], counts[miss]) + step]
        return ids, places[np.searchsorted(starts, offsets)]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of the ids, and where each id's bytes begin (with one more entry, the end)."""
        token = self.token_of[ids]
        if len(token) and token.min() < 0:
            raise ValueError("an id that the vocabulary does not have")
        sizes = self.length[token]
        return self.bytes[np.repeat(self.at[token], sizes) + ramp(sizes)], np.concatenate([[0], np.cumsum(sizes)])


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def _long(c: Codec, text: bytes, limit: int) -> Iterator[np.ndarray]:
    cuts = safe_cuts(text, limit)
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield c.encode(np.frombuffer(text, np.uint8)[a:b], np.array([0, b - a]))[0]


def encode_column(docs: DataFrame, path: str, keep: list[str] | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text, the columns in keep, and the ids if asked for.

    A null text is empty and gives 0 tokens. A text of over 4 MB is encoded piece by piece, cut where no
    pre-token is cut. Texts are taken by 1 MB at a time, so memory does not depend on the batch. Each row is
    encoded by itself: null and repeated ids and repeated rows stay as they are, an empty table gives an
    empty table, and columns other than doc_id, text and those in keep are not looked at.
    """
    keep = keep or []
    limit = 1_000_000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            offsets, data = texts(batch.column(0))
            for lo, hi in parts(offsets, limit):
                own = offsets[lo : hi + 1] - offsets[lo]
                body = data[offsets[lo] : offsets[hi]]
                count, ids_hash, text_hash = [], [], []
                if len(body) > 4 * limit:  # one very long text
                    total, a, b, all_ids = 0, hashlib.sha256(), hashlib.sha256(), []
                    for ids in _long(c, body.tobytes(), limit):
                        total += len(ids)
                        all_ids += [ids] if with_ids else []
                        a.update(ids.astype("<u4"))
                        b.update(c.decode(ids)[0])
                    ids, at = np.concatenate([*all_ids, np.zeros(0, np.uint32)]), np.array([0, total])
                    count, ids_hash, text_hash = [total], [a.hexdigest()], [b.hexdigest()]
                else:
                    ids, at = c.encode(body, own)
                    raw, byte_at = c.decode(ids)
                    ids = ids.astype("<u4")
                    for a, b in zip(at[:-1], at[1:], strict=True):
                        count.append(b - a)
                        ids_hash.append(hashlib.sha256(ids[a:b]).hexdigest())
                        text_hash.append(hashlib.sha256(raw[byte_at[a] : byte_at[b]]).hexdigest())
                kept = [batch.column(i).slice(lo, hi - lo) for i in range(1, batch.num_columns)]
                lists = [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))] if with_ids else []
                yield pa.RecordBatch.from_arrays([*kept, pa.array(count, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string()), *lists], names=[*names, "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids])

    chosen = docs.select(F.col("text"), F.col("doc_id").cast("long").alias("doc_id"), *[F.col(k) for k in keep])
    names = chosen.columns[1:]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[1:]) + ", n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return chosen.mapInArrow(trimmed(run), schema)


def encode_ids(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and the ids themselves, array<int>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            offsets, data = texts(batch.column(1))
            for lo, hi in parts(offsets, 1_000_000):
                ids, at = c.encode(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), lists], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(trimmed(run), "doc_id long, ids array<int>")


def decode_ids(ids: DataFrame, path: str) -> DataFrame:
    """doc_id and the decoded bytes (binary: ids need not end where a character ends)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            out = [c.decode(np.asarray(x or [], np.int64))[0].tobytes() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["doc_id", "bytes"])

    return ids.select("doc_id", "ids").mapInArrow(trimmed(run), "doc_id long, bytes binary")
