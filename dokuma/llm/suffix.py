"""Removal of repeated byte strings by threshold-bounded interval expansion.

Every string of `least` bytes is known by its minimizer, the 32-byte piece of least hash in it, so equal
strings meet in the bucket of their minimizer. Consecutive strings with one minimizer form a segment.
Segments whose text recurs unchanged are settled by their first occurrence. Where different segments
share a minimizer, their texts form one text; its Burrows-Wheeler transform is expanded breadth first,
which yields the common prefixes by increasing value, and stops at `least`: suffixes that no smaller
value has set apart begin with the same string.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dokuma.llm.common import BYTE_CODE, KEY, MULT, U64, batch_of, by_bucket, by_key, key_columns, keyed_blob, mix, pack, parts, ramp, release, split_blob, texts, trimmed, unpack
from dokuma.session import Rows, free_name, stage

LEAST = 100
PIECE = 32
#: Beyond so many different segments of one minimizer, its strings are grouped by their own digests.
CROWD = 2000
#: Text that a map task digests before it sends what it has found, and text of a bucket.
FLUSH, BUCKET = 24_000_000, 16_000_000
#: Text that is transformed at once, and text that a task fetches for others before it sends it.
TRANSFORM, FETCHED = 300_000, 4_000_000

# the whole hash of a minimizer: of 32 bits, least ones of 69 at that, ever more different ones are equal as the input grows
SEGMENT = np.dtype([("piece", "<u8"), ("text", "<u8"), *KEY, ("at", "<u4"), ("wins", "u1")])
SPAN = np.dtype([("at", "<u4"), ("size", "<u4")])
ASK = np.dtype([("at", "<u4"), ("wins", "u1"), ("group", "<u8"), ("crowd", "u1")])
PART = np.dtype([*KEY, ("at", "<u4"), ("size", "<u4"), ("group", "<u8"), ("body", "<u4")])
WINDOW = np.dtype([("a", "<u8"), ("b", "<u8"), *KEY, ("at", "<u4")])


def _doubled(h: np.ndarray, by: int) -> np.ndarray:
    """Hashes of pieces of twice the length, from those of length `by`."""
    out = h[:-by] * MULT
    out += h[by:]
    out *= U64(0xA0761D6478BD642F)
    out ^= out >> U64(31)
    return out


def _hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the 32 and of the 64 bytes from each place."""
    h, by = BYTE_CODE[data], 1
    while by < 32:
        h = _doubled(h, by)
        by *= 2
    return h, _doubled(h, 32)


def segments(data: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """Of each segment: where it starts, how many strings start in it, the hash of its minimizer, and
    the hash of its text; and the hashes by 64 bytes."""
    e = np.zeros(0, np.int64)
    if len(data) < least:
        return e, e, e.astype(U64), e.astype(U64), e.astype(U64)
    h32, h64 = _hashes(data)
    mask = U64((1 << int(len(data)).bit_length()) - 1)
    low = (h32 & ~mask) | np.arange(len(h32), dtype=U64)
    span, width = least - PIECE + 1, 1
    while width * 2 <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if span > width:
        low = np.minimum(low[: -(span - width)], low[span - width :])
    where = (low & mask).astype(np.int64)
    step = np.zeros(len(where) + 1, np.int32)
    long = np.flatnonzero(np.diff(offsets) >= least)
    step[offsets[long]] += 1
    step[offsets[long + 1] - least + 1] -= 1
    inside = np.cumsum(step[:-1]) > 0
    new = inside.copy()
    new[1:] &= ~inside[:-1] | (where[1:] != where[:-1])
    starts = np.flatnonzero(new)
    last = inside.copy()
    last[:-1] &= ~inside[1:] | (where[1:] != where[:-1])
    wins = np.flatnonzero(last) + 1 - starts
    size = wins + least - 1
    # blocks of 64 bytes that overlap, as many as the longest segment needs
    text, blocks = size.astype(U64) * MULT, -(-(2 * least - PIECE) // 64)
    for i in range(blocks):
        at = starts + (size - 64) * i // max(blocks - 1, 1)
        text = mix(text * U64(0x9FB21C651E98DF25) + h64[at])
    return starts, wins, h32[where[starts]], text, h64


def _settle(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Occurrences by segment, and which of them come after their segment's first one."""
    if not len(found):
        return found, np.zeros(0, bool)
    found = found[np.argsort(found["piece"])]
    near = found["piece"][1:] == found["piece"][:-1]
    several = np.zeros(len(found), bool)
    several[1:] |= near
    several[:-1] |= near
    at = np.flatnonzero(several)
    some = found[at]
    found[at] = some[np.lexsort((some["at"], some["tie"], some["key"], some["text"], some["piece"]))]
    same = (found["piece"][1:] == found["piece"][:-1]) & (found["text"][1:] == found["text"][:-1])
    # a repeated row is the same place again
    again = same & (found["key"][1:] == found["key"][:-1]) & (found["tie"][1:] == found["tie"][:-1]) & (found["at"][1:] == found["at"][:-1])
    found = found[np.concatenate([[True], ~again])]
    same = (found["piece"][1:] == found["piece"][:-1]) & (found["text"][1:] == found["text"][:-1])
    return found, np.concatenate([[False], same])


def _later(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Strings by digest and place, each place once, and which of them are not their digest's first."""
    w = w[np.lexsort((w["at"], w["tie"], w["key"], w["b"], w["a"]))]
    same = (w["a"][1:] == w["a"][:-1]) & (w["b"][1:] == w["b"][:-1])
    again = same & (w["key"][1:] == w["key"][:-1]) & (w["tie"][1:] == w["tie"][:-1]) & (w["at"][1:] == w["at"][:-1])
    keep = np.concatenate([[True], ~again])
    return w[keep], np.concatenate([[False], same])[keep]


def unite(at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs that the spans cover: starts and ends."""
    if not len(at):
        e = np.zeros(0, np.int64)
        return e, e
    order = np.argsort(at, kind="stable")
    a, b = at[order].astype(np.int64), (at.astype(np.int64) + size)[order]
    reach = np.maximum.accumulate(b)
    new = np.concatenate([[True], a[1:] > reach[:-1]])
    return a[new], reach[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(a) - 1]])]


def expand(text: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of text (numbers below 512, the last one its unique least) in the order of their first
    `least` symbols, and whether each one's common prefix with the one before is shorter than that."""
    n = len(text)
    # order by doubling from 7 symbols until `least` are compared
    depth = 7
    padded = np.concatenate([text.astype(U64), np.zeros(depth, U64)])
    code = np.zeros(n, U64)
    for j in range(depth):
        code = (code << U64(9)) | padded[j : j + n]
    while True:
        order = np.argsort(code)
        ranked = code[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], ranked[1:] != ranked[:-1]]))
        if depth > least or rank[order[-1]] == n - 1:
            break
        later = np.zeros(n, np.int64)
        later[: max(n - depth, 0)] = rank[depth:] + 1
        code = (rank * (n + 1) + later).astype(U64)
        depth *= 2
    bwt = text[order - 1]
    by_symbol = np.argsort(bwt, kind="stable")
    back = np.empty(n, np.int64)  # the place of each row's extended suffix
    back[by_symbol] = np.arange(n)
    sorted_bwt = bwt[by_symbol]
    joint = sorted_bwt[1:] == sorted_bwt[:-1]
    before, after = np.full(n, -1, np.int64), np.full(n, n, np.int64)
    before[by_symbol[1:][joint]] = by_symbol[:-1][joint]
    after[by_symbol[:-1][joint]] = by_symbol[1:][joint]
    apart = np.zeros(n + 1, bool)
    apart[0] = apart[n] = True
    lo, hi = np.zeros(1, np.int64), np.full(1, n - 1, np.int64)
    for _ in range(least):  # common prefixes of 0, 1, ... least - 1
        sizes = hi - lo + 1
        rows = np.repeat(lo, sizes) + ramp(sizes)
        # intervals of one length are disjoint, so sorted firsts and lasts belong together
        lo, hi = np.sort(back[rows[before[rows] < np.repeat(lo, sizes)]]), np.sort(back[rows[after[rows] > np.repeat(hi, sizes)]])
        new = ~apart[hi + 1]
        lo, hi = lo[new], hi[new]
        apart[hi + 1] = True
        if not len(lo):
            break
    return order, apart[:n]


def repeats_among(body: list[np.ndarray], key: np.ndarray, tie: np.ndarray, at: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Which strings of `least` bytes of the segments start earlier, too: (segment, offset)."""
    sizes = np.array([len(b) for b in body], np.int64)
    ends = np.cumsum(sizes + 1)
    text = np.ones(int(ends[-1]) + 1, np.uint16)
    owner, inner = np.repeat(np.arange(len(body)), sizes), ramp(sizes)
    place = (ends - sizes - 1)[owner] + inner
    text[place] = np.concatenate(body).astype(np.uint16) + 2
    text[-1] = 0
    order, apart = expand(text, least)
    whole = np.zeros(len(text), bool)
    whole[place[inner + least <= sizes[owner]]] = True
    segment = np.full(len(text), -1, np.int64)
    segment[place] = owner
    group = np.cumsum(apart)
    rows = np.flatnonzero(whole[order])
    pos, group = order[rows], group[rows]
    seg = segment[pos]
    off = pos - (ends - sizes - 1)[seg]
    k, t, p = key[seg], tie[seg], at[seg] + off
    by = np.lexsort((p, t, k, group))
    seg, off, k, t, p, group = seg[by], off[by], k[by], t[by], p[by], group[by]
    head = np.concatenate([[True], group[1:] != group[:-1]]) if len(group) else np.zeros(0, bool)
    first = np.flatnonzero(head)[np.cumsum(head) - 1] if len(group) else np.zeros(0, np.int64)
    later = (k != k[first]) | (t != t[first]) | (p != p[first])
    return seg[later], off[later]


def _spans(key: np.ndarray, tie: np.ndarray, at: np.ndarray, least: int) -> Iterator[tuple[int, int, bytes]]:
    """Strings that start at (key, tie, at), as united spans by key and tie."""
    order = np.lexsort((at, tie, key))
    key, tie, at = key[order], tie[order], at[order].astype(np.int64)
    if not len(key):
        return
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (tie[1:] != tie[:-1]) | (at[1:] > at[:-1] + least)])
    a = np.flatnonzero(new)
    b = np.append(a[1:], len(key)) - 1
    out = np.empty(len(a), SPAN)
    out["at"], out["size"] = at[a], at[b] + least - at[a]
    yield from by_key(out, key[a], tie[a])


def _whole(rest: np.ndarray, least: int) -> Iterator[tuple[int, int, bytes]]:
    """Segments as spans, by key and tie."""
    out = np.empty(len(rest), SPAN)
    out["at"], out["size"] = rest["at"], rest["wins"].astype(np.uint32) + least - 1
    return by_key(out, rest["key"], rest["tie"])


def repeated_spans(keyed: DataFrame, fetched: Callable[[DataFrame], DataFrame], least: int = LEAST, crowd: int = CROWD) -> DataFrame:
    """key, tie and spans (a list of packed span arrays) of every row some of whose bytes are covered by a
    string of `least` bytes that also starts earlier. keyed: key, tie and text; fetched adds the text to
    rows of key, tie and others, each once."""
    if not 64 <= least <= 255 - PIECE:
        raise ValueError("least must be from 64 to 223 bytes")
    total = keyed.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    workers = keyed.sparkSession.sparkContext.defaultParallelism
    buckets = max(4 * workers, -(-total // BUCKET))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def send() -> Iterator[pa.RecordBatch]:
            found = np.concatenate(held)
            found, later = _settle(found)
            rows = [(b, 0, blob) for b, blob in by_bucket(found[~later], (found["piece"][~later] >> U64(8)).astype(np.int64) % buckets)]
            # later occurrences in this task need no bucket: all their strings start earlier, too
            rows += [((k ^ t) % buckets, 1, keyed_blob(k, t, blob)) for k, t, blob in _whole(found[later], least)]
            for lo in range(0, len(rows), 2000):
                yield batch_of(rows[lo : lo + 2000], ["bucket", "kind", "blob"], [pa.int64(), pa.int32(), pa.binary()])

        for batch in batches:
            offsets, data = texts(batch.column(2))
            keys, ties = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for lo, hi in parts(offsets):
                own = offsets[lo : hi + 1] - offsets[lo]
                starts, wins, piece, text, _ = segments(data[offsets[lo] : offsets[hi]], own, least)
                doc = np.searchsorted(own, starts, "right") - 1
                table = np.empty(len(starts), SEGMENT)
                table["piece"], table["text"], table["wins"] = piece, text, wins
                table["key"], table["tie"], table["at"] = keys[lo + doc], ties[lo + doc], starts - own[doc]
                held.append(table)
                size += int(own[-1])
                if size > FLUSH:
                    yield from send()
                    held, size = [], 0
        if held:
            yield from send()

    names, types = ["kind", "key", "tie", "blob"], [pa.int32(), pa.int64(), pa.int64(), pa.binary()]
    answer = "kind int, key long, tie long, blob binary"

    def group(table: pa.Table) -> pa.Table:
        blobs, kinds = table.column("blob").to_pylist(), table.column("kind").to_numpy()
        rows = [(1, *split_blob(b)) for b, k in zip(blobs, kinds, strict=True) if k == 1]
        found, later = _settle(unpack([b for b, k in zip(blobs, kinds, strict=True) if k == 0], SEGMENT))
        rows += [(1, *r) for r in _whole(found[later], least)]
        first = found[~later]
        if len(first):
            new = np.concatenate([[True], first["piece"][1:] != first["piece"][:-1]])
            number = np.cumsum(new) - 1
            many = np.bincount(number)[number]
            ask = first[many > 1]
            out = np.empty(len(ask), ASK)
            out["at"], out["wins"], out["group"], out["crowd"] = ask["at"], ask["wins"], ask["piece"], many[many > 1] > crowd
            rows += [(2, *r) for r in by_key(out, ask["key"], ask["tie"])]
        release()
        return pa.Table.from_batches([batch_of(rows, names, types)])

    sent = keyed.select("key", "tie", "text").mapInArrow(trimmed(digest), "bucket long, kind int, blob binary")
    known = stage(sent.groupBy("bucket").applyInArrow(group, answer), "segments")
    asked = known.where("kind = 2").groupBy("key", "tie").agg(F.collect_list("blob").alias("blobs"), F.sum(F.octet_length("blob")).alias("n")).where("n > 0")
    asked = stage(asked, "asked")
    wanted = asked.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    # about 14 bytes of request for 135 bytes of text
    second = max(4 * workers, -(-wanted[0] * 10 // 4_000_000))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, held, asked_, bodies, fetched = [], 0, [], [], 0

        def crowded() -> Iterator[tuple]:
            w, later = _later(np.concatenate(windows))
            for k, t, blob in _spans(w["key"][later], w["tie"][later], w["at"][later], least):
                yield (k ^ t) % second, 1, keyed_blob(k, t, blob), b""
            for b, blob in by_bucket(w[~later], (w["a"][~later] >> U64(8)).astype(np.int64) % second):
                yield b, 3, blob, b""

        def plain() -> Iterator[tuple]:
            """Segments by bucket: packed descriptions and their texts, in the same order."""
            table, raw = np.concatenate(asked_), np.concatenate(bodies)
            bucket = (mix(table["group"]) >> U64(8)).astype(np.int64) % second
            order = np.argsort(bucket, kind="stable")
            table, bucket = table[order], bucket[order]
            edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            for a, b in zip(edges, [*edges[1:], len(bucket)], strict=True):
                own = table[a:b]
                size = own["size"].astype(np.int64)
                yield int(bucket[a]), 2, pack(own), raw[np.repeat(own["body"].astype(np.int64), size) + ramp(size)].tobytes()

        def send(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
            yield batch_of(list(rows), ["bucket", "kind", "blob", "body"], [pa.int64(), pa.int32(), pa.binary(), pa.binary()])

        for batch in batches:
            offsets, data = texts(batch.column(2))
            for i, (key, tie, own) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                text, ask = data[offsets[i] : offsets[i + 1]], unpack(own, ASK)
                crowd = ask["crowd"] == 1
                if not crowd.all():
                    few_ = ask[~crowd]
                    size = few_["wins"].astype(np.int64) + least - 1
                    part = np.empty(len(few_), PART)
                    part["key"], part["tie"], part["at"], part["size"], part["group"] = key, tie, few_["at"], size, few_["group"]
                    part["body"] = fetched + np.cumsum(size) - size
                    asked_.append(part)
                    bodies.append(text[np.repeat(few_["at"].astype(np.int64), size) + ramp(size)])
                    fetched += int(size.sum())
                if crowd.any():
                    many = ask[crowd]
                    h64 = _hashes(text)[1]
                    at = np.repeat(many["at"].astype(np.int64), many["wins"]) + ramp(many["wins"].astype(np.int64))
                    w = np.empty(len(at), WINDOW)
                    mid, end = h64[at + (least - 64) // 2], h64[at + least - 64]
                    w["a"], w["b"] = mix(h64[at] * MULT + end + (mid << U64(1))), mix((h64[at] ^ mix(end)) * U64(0xA0761D6478BD642F) + mid)
                    w["key"], w["tie"], w["at"] = key, tie, at
                    windows.append(w)
                    held += len(w)
                if fetched > FETCHED:
                    yield from send(plain())
                    asked_, bodies, fetched = [], [], 0
                if held > 500_000:
                    yield from send(crowded())
                    windows, held = [], 0
        if asked_:
            yield from send(plain())
        if windows:
            yield from send(crowded())

    def resolve(table: pa.Table) -> pa.Table:
        kinds, blobs, bodies = table.column("kind").to_numpy(), table.column("blob").to_pylist(), table.column("body").to_pylist()
        rows = [(1, *split_blob(b)) for b, k in zip(blobs, kinds, strict=True) if k == 1]
        part = unpack([b for b, k in zip(blobs, kinds, strict=True) if k == 2], PART)
        if len(part):
            raw = np.frombuffer(b"".join(b for b, k in zip(bodies, kinds, strict=True) if k == 2), np.uint8)
            size = part["size"].astype(np.int64)
            begin = np.cumsum(size) - size
            order = np.argsort(part["group"], kind="stable")
            # whole groups, a bounded text at a time
            group_ = part["group"][order]
            reach = np.cumsum(size[order])
            heads = np.flatnonzero(np.concatenate([[True], group_[1:] != group_[:-1]]))
            begin_at = reach[heads] - size[order][heads]
            cut = [0]
            while cut[-1] < len(order):
                base = reach[cut[-1] - 1] if cut[-1] else 0
                far = heads[np.searchsorted(begin_at, base + TRANSFORM) :]
                cut.append(int(far[0]) if len(far) and far[0] > cut[-1] else len(order))
            for lo, hi in zip(cut, cut[1:], strict=False):
                at = order[lo:hi]
                body = [raw[begin[i] : begin[i] + size[i]] for i in at]
                seg, off = repeats_among(body, part["key"][at], part["tie"][at], part["at"][at].astype(np.int64), least)
                rows += [(1, *r) for r in _spans(part["key"][at][seg], part["tie"][at][seg], part["at"][at][seg].astype(np.int64) + off, least)]
        w = unpack([b for b, k in zip(blobs, kinds, strict=True) if k == 3], WINDOW)
        if len(w):
            w, later = _later(w)
            rows += [(1, *r) for r in _spans(w["key"][later], w["tie"][later], w["at"][later], least)]
        release()
        return pa.Table.from_batches([batch_of(rows, names, types)])

    parts_ = fetched(asked).select("key", "tie", "text", "blobs").mapInArrow(trimmed(fetch), "bucket long, kind int, blob binary, body binary")
    solved = parts_.groupBy("bucket").applyInArrow(resolve, answer)
    every = known.where("kind = 1").unionByName(solved)
    return every.groupBy("key", "tie").agg(F.collect_list("blob").alias("spans"))


def with_spans(docs: DataFrame, find: Callable[[DataFrame, Callable[[DataFrame], DataFrame]], DataFrame]) -> tuple[DataFrame, str]:
    """docs with the spans that `find` gives by key and tie (null: none), and that column's name.

    docs are written once, with a number for each row; only the texts of rows that have spans, or are asked
    for, are shuffled, by that number, which no two rows share."""
    rows = Rows(docs, "texts")
    named = {c: free_name(c, *rows.df.columns) for c in ("key", "tie", "spans")}
    key, tie = key_columns()
    keyed = rows.df.withColumns({named["key"]: key, named["tie"]: tie})
    places = stage(keyed.select(F.col(named["key"]).alias("key"), F.col(named["tie"]).alias("tie"), F.col(rows.id).alias("row")), "places")

    def fetched(asked: DataFrame) -> DataFrame:
        once = places.groupBy("key", "tie").agg(F.min("row").alias("row"))
        wanted = stage(asked.join(once, ["key", "tie"]), "wanted")
        return rows.where(wanted.select("row")).select(F.col(rows.id).alias("row"), "text").join(wanted, "row")

    plain = keyed.select(F.col(named["key"]).alias("key"), F.col(named["tie"]).alias("tie"), "text")
    found = stage(places.join(find(plain, fetched), ["key", "tie"]).select(F.col("row").alias(rows.id), F.col("spans").alias(named["spans"])), "spans")
    marked = found.select(rows.id)
    out = rows.where(marked).join(found, rows.id).unionByName(rows.where(marked, keep=False).withColumn(named["spans"], F.lit(None).cast("array<binary>")))
    return out.select(*docs.columns, named["spans"]), named["spans"]


def removal_digests(docs: DataFrame, least: int = LEAST, crowd: int = CROWD) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row.

    A null, empty or short text loses nothing; an empty table gives an empty table. Any ids are allowed, a null
    doc_id is the least. Rows that repeat doc_id and text are one place and share a result. Of rows with
    one doc_id and different texts, the order of their hashes decides. Other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = texts(batch.column(1))
            rows = []
            for i, blobs in enumerate(batch.column(2).to_pylist()):
                text = data[offsets[i] : offsets[i + 1]].tobytes()
                span = unpack(blobs or [], SPAN)
                a, b = unite(span["at"], span["size"])
                kept, at = hashlib.sha256(), 0
                for x, y in zip(a.tolist(), b.tolist(), strict=True):
                    kept.update(text[at:x])
                    at = y
                kept.update(text[at:])
                rows.append((len(text), int((b - a).sum()), len(a), kept.hexdigest()))
            made = batch_of(rows, ["n_bytes", "n_removed", "n_spans", "kept_sha256"], [pa.int64(), pa.int64(), pa.int64(), pa.string()])
            yield pa.RecordBatch.from_arrays([batch.column(0), *made.columns], names=["doc_id", *made.schema.names])

    rows, spans = with_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), partial(repeated_spans, least=least, crowd=crowd))
    return rows.select("doc_id", "text", spans).mapInArrow(trimmed(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """The rows with the repeated bytes gone from text, whole characters only: a character of which a
    part would stay is kept. All other columns, whatever their names, stay as they are, and so does a null
    text; repeated rows lose the same bytes; an empty table gives an empty table."""

    @F.pandas_udf("string")
    def cut(text, spans):
        out = []
        for t, blobs in zip(text, spans, strict=True):
            if t is None or blobs is None or not len(blobs):
                out.append(t)
                continue
            raw, span = t.encode("utf-8"), unpack(list(blobs), SPAN)
            kept, at = [], 0
            for x, y in zip(*(v.tolist() for v in unite(span["at"], span["size"])), strict=True):
                while x < y and raw[x] & 0xC0 == 0x80:
                    x += 1
                while x < y < len(raw) and raw[y] & 0xC0 == 0x80:
                    y -= 1
                kept.append(raw[at:x])
                at = max(at, y)
            out.append(b"".join([*kept, raw[at:]]).decode("utf-8"))
        import pandas as pd

        return pd.Series(out, dtype=object)

    rows, spans = with_spans(docs, partial(repeated_spans, least=least))
    return rows.withColumn("text", cut("text", spans)).select(*docs.columns)
