"""Periodic runs of words by partition refinement: positions are classed by equal factors, for one length after the
other, and neighbours in a class whose distance is the length are squares; squares in a row are a run."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dokuma.llm.common import parts, ramp, texts, trimmed, words

#: Least words of a run, and how often it must hold its period.
LEAST, TIMES = 6, 4
#: Members that a class must keep. A run of four periods or more has at least three words of each kind that begin equal
#: factors of up to a period, so smaller classes hold no squares of such runs; their members count as unlike any other.
ALIVE = 3
#: Bytes of texts refined together: each length costs a few array operations, whatever the number of texts.
TOGETHER = 8_000_000


def squares(symbols: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and periods of the squares in the runs of TIMES periods or more; texts are symbols[offsets[d]:offsets[d + 1]].
    The period of each is the smallest. Places count a mark after each text: place = index + text number. Shorter runs may give
    some of their squares or none.

    Classes by factors of one length are refined to the next length by those classes alone that were split off last, all
    children of a split but its largest, so each position is moved a logarithmic number of times at most. A class is a range
    of `order`; prv and nxt link its members by place; a link that lives while the length is its distance is a square."""
    sizes = np.diff(offsets)
    n_docs, n = len(sizes), len(symbols) + len(sizes)
    doc = np.repeat(np.arange(n_docs), sizes + 1)
    mark = np.cumsum(sizes + 1) - 1
    limit = (sizes // TIMES)[doc]
    limit[(sizes < LEAST)[doc]] = 0
    # marks are unlike any word and each other
    kind = np.empty(n, np.int64)
    inner = np.ones(n, bool)
    inner[mark] = False
    kind[inner] = symbols
    kinds = int(symbols.max()) + 1 if len(symbols) else 0
    kind[mark] = kinds
    key = doc * (kinds + 1) + kind
    order = np.argsort(key, kind="stable")
    new = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    head = np.flatnonzero(new)
    start, size = np.zeros(n, np.int64), np.zeros(n, np.int64)
    start[: len(head)], size[: len(head)] = head, np.diff(np.append(head, n))
    used = len(head)
    cls, where = np.empty(n, np.int64), np.empty(n, np.int64)
    cls[order], where[order] = np.cumsum(new) - 1, np.arange(n)
    prv, nxt, since = np.full(n, -1), np.full(n, -1), np.ones(n, np.int64)
    linked = ~new[1:]
    nxt[order[:-1][linked]], prv[order[1:][linked]] = order[1:][linked], order[:-1][linked]
    touched_mark = np.zeros(n, bool)
    places, periods = [], []

    def relink(at: np.ndarray, to: np.ndarray, length: int) -> None:
        """Links from `at` go to `to` from this length on; what lived through its own distance is a square."""
        old = nxt[at]
        moved = old != to
        at, to, old = at[moved], to[moved], old[moved]
        far = old - at
        lived = (old >= 0) & (since[at] <= far) & (far < length)
        places.append(at[lived])
        periods.append(far[lived])
        nxt[at], since[at] = to, length

    small, length = np.arange(n), 1
    while len(small):
        length += 1
        before = small - 1
        c = cls[small]
        fine = (before >= 0) & (limit[before] >= length) & (size[cls[before]] >= ALIVE)
        before, c, small = before[fine], c[fine], small[fine]
        if not len(before):
            break
        # a member of a class that is too small counts as a class of its own
        c = np.where(size[c] >= ALIVE, c, n + small)
        d = cls[before]
        by = np.lexsort((before, c, d))
        x, c, d = before[by], c[by], d[by]
        sub_new = np.concatenate([[True], (d[1:] != d[:-1]) | (c[1:] != c[:-1])])
        parent_new = np.concatenate([[True], d[1:] != d[:-1]])
        # classes whose members all go the same way stay as they are
        parent_no = np.cumsum(parent_new) - 1
        count, subs = np.bincount(parent_no), np.bincount(parent_no, weights=sub_new).astype(np.int64)
        parent = d[parent_new]
        splits = (subs > 1) | (count < size[parent])
        keep = splits[parent_no]
        x, c, d, sub_new, parent_new = x[keep], c[keep], d[keep], sub_new[keep], parent_new[keep]
        if not len(x):
            break
        parent, count = parent[splits], count[splits]
        base, rest = start[parent], size[parent] - count
        parent_no, sub_no = np.cumsum(parent_new) - 1, np.cumsum(sub_new) - 1
        sub_head = np.flatnonzero(sub_new)
        sub_size = np.diff(np.append(sub_head, len(x)))
        sub_parent = parent_no[sub_head]

        # links: the rest of a class closes over those that leave, which are linked anew among themselves
        touched_mark[x] = True
        by = np.lexsort((x, d))
        inside = x[by]
        p, q = prv[inside], nxt[inside]
        opens, closes = (p < 0) | ~touched_mark[p], (q < 0) | ~touched_mark[q]
        p, q = p[opens], q[closes]
        relink(p[p >= 0], q[p >= 0], length)
        prv[q[q >= 0]] = p[q >= 0]
        after = np.append(x[1:], -1)
        after[np.append(sub_new[1:], True) | (sub_size < ALIVE)[sub_no]] = -1
        relink(x, after, length)
        back = np.concatenate([[-1], x[:-1]])
        back[sub_new] = -1
        prv[x] = back

        # places in `order`: those that leave go to the end of their class's range
        tail = (base + rest)[parent_no] + ramp(count)
        held = order[tail]
        stay = held[~touched_mark[held]]
        holes = where[x]
        holes = holes[holes < (base + rest)[parent_no]]
        order[holes], where[stay] = stay, holes
        order[tail], where[x] = x, tail
        touched_mark[x] = False

        # ids: the largest child keeps its parent's
        best = np.zeros(len(parent), np.int64)
        np.maximum.at(best, sub_parent, sub_size)
        rest_stays = rest >= best
        largest = (sub_size == best[sub_parent]) & ~rest_stays[sub_parent]
        first = np.unique(sub_parent[largest], return_index=True)[1]
        heir = np.flatnonzero(largest)[first]
        ids = np.empty(len(sub_head), np.int64)
        others = np.ones(len(sub_head), bool)
        others[heir] = False
        ids[others] = used + np.arange(others.sum())
        used += int(others.sum())
        ids[heir] = parent[sub_parent[heir]]
        moves = ~rest_stays & (rest > 0)
        rest_ids = used + np.arange(moves.sum())
        used += int(moves.sum())
        rest_at = np.repeat(base[moves], rest[moves]) + ramp(rest[moves])
        cls[order[rest_at]] = np.repeat(rest_ids, rest[moves])
        start[rest_ids], size[rest_ids] = base[moves], rest[moves]
        size[parent[rest_stays]] = rest[rest_stays]
        start[ids], size[ids] = tail[sub_head], sub_size
        cls[x] = ids[sub_no]
        # what is too small now falls apart, whoever's heir it is: its links end, and those before it must know
        few = (rest < ALIVE) & (rest > 0)
        gone = order[np.repeat(base[few], rest[few]) + ramp(rest[few])]
        relink(gone, np.full(len(gone), -1), length)
        alone = order[np.repeat(base[few & ~moves], rest[few & ~moves]) + ramp(rest[few & ~moves])]
        small = np.concatenate([x[(others | (sub_size < ALIVE))[sub_no]], order[rest_at], alone])

    at = np.flatnonzero((nxt >= 0) & (size[cls] >= ALIVE))
    far = nxt[at] - at
    lived = (since[at] <= far) & (far <= limit[at])
    return np.concatenate([*places, at[lived]]), np.concatenate([*periods, far[lived]])


def runs(symbols: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, start, length and period of every run, by text, start and period."""
    place, period = squares(symbols, offsets)
    by = np.lexsort((place, period))
    place, period = place[by], period[by]
    head = np.flatnonzero(np.concatenate([[True], (period[1:] != period[:-1]) | (place[1:] != place[:-1] + 1)])) if len(place) else np.zeros(0, np.int64)
    start, period = place[head], period[head]
    length = np.diff(np.append(head, len(place))) + 2 * period - 1
    fits = length >= np.maximum(LEAST, TIMES * period)
    start, period, length = start[fits], period[fits], length[fits]
    begins = offsets[:-1] + np.arange(len(offsets) - 1)
    doc = np.searchsorted(begins, start, "right") - 1
    by = np.lexsort((period, start, doc))
    return doc[by], (start - begins[doc])[by], length[by], period[by]


def word_ids(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each distinct word; the words are all bytes of data that are no white space."""
    lengths = ends - starts
    from_ = np.repeat(starts, lengths) + ramp(lengths)
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[from_])])
    return column.dictionary_encode().indices.to_numpy().astype(np.int64)


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """The words that take the places of a text's n words where the contract makes the text periodic, or None."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate([np.arange(a), a + np.arange(n - a) % p])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text: str = "text", plant: bool = False) -> DataFrame:
    """One row for each document: doc_id, n_runs, start, length, period and exponent_milli of its longest run (ties: the smallest
    start, then period; nulls without a run), runs_sha256, collapsed_sha256, n_words, n_dropped, and runs: every run's start, length
    and period, in words.

    A run is a maximal stretch of words with smallest period q and length >= max(LEAST, TIMES * q). A word is dropped if a run
    holds it after its first q words. collapsed_sha256 is of the words left, joined by one space. plant: a tenth of the texts
    are made periodic first, by their ids, as the registered query asks for.

    One pass over whole texts without a shuffle. A null or empty text has no words and no runs; a null doc_id is kept, and its
    text is not made periodic. Repeated rows and further columns play no part, and an empty table gives an empty one."""
    names = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "n_words", "n_dropped"]
    kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.int64()] * 2
    triple = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = texts(batch.column(1))
            keys = batch.column(0).to_pylist()
            for lo, hi in parts(offsets, TOGETHER):
                own, body = offsets[lo : hi + 1] - offsets[lo], data[offsets[lo] : offsets[hi]]
                w0, w1, first = words(body, own)
                new = {}
                symbols = word_ids(body, w0, w1) if len(w0) else np.zeros(0, np.int64)
                for i, n in enumerate(np.diff(first).tolist() if plant else []):
                    taken = planted(keys[lo + i], n)
                    if taken is not None:
                        new[i] = taken
                        symbols[first[i] : first[i + 1]] = symbols[first[i] + taken]
                doc, start, length, period = runs(symbols, first)
                edges = np.searchsorted(doc, np.arange(hi - lo + 1))
                cover = np.zeros(len(symbols) + 1, np.int64)
                np.add.at(cover, first[doc] + start + period, 1)
                np.add.at(cover, first[doc] + start + length, -1)
                stays = np.cumsum(cover[:-1]) == 0
                rows, every = [], []
                for i in range(hi - lo):
                    found = [v[edges[i] : edges[i + 1]].tolist() for v in (start, length, period)]
                    own_runs = list(zip(*found, strict=True))
                    best = max(own_runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
                    listed = "".join(f"{s},{n},{q}\n" for s, n, q in own_runs)
                    text_words = body[own[i] : own[i + 1]].tobytes().split()
                    n_words = len(text_words)
                    if i in new:
                        text_words = [text_words[j] for j in new[i].tolist()]
                    if own_runs:
                        text_words = [w for w, s in zip(text_words, stays[first[i] : first[i + 1]].tolist(), strict=True) if s]
                    digests = (hashlib.sha256(v).hexdigest() for v in (listed.encode(), b" ".join(text_words)))
                    rows.append((len(own_runs), *best, 1000 * best[1] // best[2] if own_runs else None, *digests, n_words, n_words - len(text_words)))
                    every.append([{"start": s, "length": n, "period": q} for s, n, q in own_runs])
                made = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *made, pa.array(every, triple)], names=["doc_id", *names, "runs"])

    schema = ", ".join(f"{c} {'string' if k == pa.string() else 'long'}" for c, k in zip(names, kinds, strict=True))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(trimmed(run), f"doc_id long, {schema}, runs array<struct<start:bigint,length:bigint,period:bigint>>")
