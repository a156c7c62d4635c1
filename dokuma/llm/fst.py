"""Token counts by finite-state transducers.

Two transducers are compiled from a tokenizer's own files. The segmenter reads character classes and
marks where pre-tokens start. The counter reads the bytes of a pre-token; each of its transitions is
annotated with the change in the number of emitted tokens. A text is cut into chunks of fixed length;
each chunk's segmenter map (entry state to exit state) is computed without knowing its entry state,
the maps are composed by a parallel prefix scan, and then all chunks run at once from known states.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dokuma.llm.common import parts, span_hash, texts, trimmed
from dokuma.llm.pretoken import LETTER, NUMBER, OTHER, WHITE, class_table, safe_cuts

# symbols of the segmenter: the space, other white space, letters (those of contractions apart),
# numbers, others, the apostrophe, and the end of a text
SP, WS, LT, NU, OT, AP, C1, CR, CV, CL, CE, END = range(12)
# its states: at a start; after a contraction; in letters, numbers, others; after an apostrophe that a
# match started with, and then r, v, l; in white space of one or of more characters, by the last one
START, CD, IL, IN, IO, IA, AR, AV, AL, S1, O1, S2, O2 = range(13)
#: Output codes: a pre-token starts at this character; at the one before.
HERE, BEFORE = 1, 2
CHUNK = 256


def _segmenter() -> tuple[np.ndarray, np.ndarray]:
    to, out = np.zeros((13, 12), np.int8), np.zeros((13, 12), np.int8)
    letters = (LT, C1, CR, CV, CL, CE)
    fresh = {SP: S1, WS: O1, NU: IN, OT: IO, AP: IA} | dict.fromkeys(letters, IL)

    def rule(state: int, symbol: int, target: int, code: int) -> None:
        to[state, symbol], out[state, symbol] = target, code

    for state in range(13):
        for symbol, target in fresh.items():
            rule(state, symbol, target, HERE)
        rule(state, END, START, 0)
    for c in letters:
        rule(IL, c, IL, 0)
    rule(IN, NU, IN, 0)
    for state in (IO, IA):
        for c in (OT, AP):
            rule(state, c, IO, 0)
    rule(IA, C1, CD, 0)
    for state, opened, closing in ((AR, CR, CE), (AV, CV, CE), (AL, CL, CL)):
        rule(IA, opened, state, 0)
        for symbol, target in fresh.items():  # no contraction after all: the letter had started a pre-token
            rule(state, symbol, target, BEFORE | HERE)
        for c in letters:
            rule(state, c, IL, BEFORE)
        rule(state, closing, CD, 0)
        rule(state, END, START, BEFORE)
    joined = {NU: IN, OT: IO, AP: IO} | dict.fromkeys(letters, IL)
    for symbol, target in joined.items():
        rule(S1, symbol, target, 0)
        rule(S2, symbol, target, BEFORE)
    for symbol in (NU, OT, AP, *letters):
        rule(O2, symbol, fresh[symbol], BEFORE | HERE)
    for state in (S1, O1, S2, O2):
        rule(state, SP, S2, 0)
        rule(state, WS, O2, 0)
    return to, out


TO, OUT = _segmenter()
_TO, _OUT = TO.ravel().copy(), OUT.ravel().copy()


def run_segmenter(symbols: np.ndarray) -> np.ndarray:
    """Output codes of all symbols. Chunks run side by side; their entry states come from the prefix
    scan over the chunks' state maps."""
    lanes = max(1, -(-len(symbols) // CHUNK))
    grid = np.full(lanes * CHUNK, END, np.int8)
    grid[: len(symbols)] = symbols
    grid = np.ascontiguousarray(grid.reshape(lanes, CHUNK).T)
    maps = np.repeat(np.arange(13, dtype=np.int8)[:, None], lanes, 1)
    wide = np.arange(lanes)
    met_lanes = np.zeros(0, np.int64)
    state = np.zeros(lanes, np.int8)
    merged = np.zeros(lanes, bool)
    for t in range(CHUNK):  # all entry states of a chunk until they have met, then the one that is left
        if len(wide):
            maps[:, wide] = np.take(_TO, maps[:, wide].astype(np.int16) * 12 + grid[t, wide])
        if len(met_lanes):
            state[met_lanes] = np.take(_TO, state[met_lanes].astype(np.int16) * 12 + grid[t, met_lanes])
        if len(wide) and (t % 4 == 3 or t == CHUNK - 1):
            met = (maps[:, wide] == maps[0, wide]).all(0)
            if met.any():
                got = wide[met]
                state[got], merged[got] = maps[0, got], True
                wide = wide[~met]
                met_lanes = np.flatnonzero(merged)
    maps[:, merged] = state[merged]
    step = 1
    while step < lanes:  # parallel prefix scan: compose each map after the one `step` before
        maps[:, step:] = np.take_along_axis(maps[:, step:], maps[:, :-step].astype(np.intp), 0)
        step *= 2
    state = np.zeros(lanes, np.int16)
    state[1:] = maps[START, :-1]
    codes = np.empty((CHUNK, lanes), np.int8)
    for t in range(CHUNK):
        place = state * 12 + grid[t]
        codes[t] = np.take(_OUT, place)
        state = np.take(_TO, place).astype(np.int16)
    return codes.T.ravel()[: len(symbols)]


class Counter:
    """The transducer over a pre-token's bytes. A state is what the future can depend on: for each place
    at which a token may still be open, the vocabulary's trie node, the last token before that place and
    the difference in tokens so far. States and transitions are compiled as texts ask for them."""

    #: States that are kept; beyond, compilation starts afresh.
    LIMIT = 150_000

    def __init__(self, tokens: list[bytes], pairs: dict[tuple[bytes, bytes], int]):
        self.pairs, self.child, self.token_at = pairs, {}, [-1]
        self.tokens = tokens
        for i, t in enumerate(tokens):
            node = 0
            for b in t:
                key = node * 256 + b
                nxt = self.child.get(key)
                if nxt is None:
                    nxt = self.child[key] = len(self.token_at)
                    self.token_at.append(-1)
                node = nxt
            self.token_at[node] = i
        self.adjacent: dict[tuple[int, int], bool] = {}
        self.clear()

    def clear(self) -> None:
        self.states: dict[tuple, int] = {((0, -1, 0),): 0}
        self.members: list[tuple] = [((0, -1, 0),)]
        #: Bytes get columns as they occur: most texts use fewer than half of them.
        self.column, self.bytes = np.full(256, -1, np.int16), []
        self.next = np.full((1024, 128), -1, np.int32)
        self.emit = np.zeros((1024, 128), np.int8)

    def merge(self, word: bytes) -> list[bytes]:
        """Pieces of a word by the merge list, least rank first, leftmost first: heap over linked pieces."""
        piece = [word[i : i + 1] for i in range(len(word))]
        after, before = list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))
        heap = [(r, i, piece[i], piece[i + 1]) for i in range(len(word) - 1) if (r := self.pairs.get((piece[i], piece[i + 1]))) is not None]
        heapq.heapify(heap)
        n = len(word)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if piece[i] != a or j >= n or piece[j] != b:
                continue
            piece[i], piece[j] = a + b, b""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := self.pairs.get((piece[i], piece[k]))) is not None:
                    heapq.heappush(heap, (r, i, piece[i], piece[k]))
            if (h := before[i]) >= 0 and (r := self.pairs.get((piece[h], piece[i]))) is not None:
                heapq.heappush(heap, (r, h, piece[h], piece[i]))
        return [p for p in piece if p]

    def may_follow(self, left: int, right: int) -> bool:
        key = (left, right)
        known = self.adjacent.get(key)
        if known is None:
            if len(self.adjacent) > 400_000:
                self.adjacent.clear()
            a, b = self.tokens[left], self.tokens[right]
            known = self.adjacent[key] = self.merge(a + b) == [a, b]
        return known

    def compile(self, state: int, byte: int) -> None:
        """Add the transition: the one token that can end here gives the new last token and count."""
        last, count, opened = -1, 0, []
        for node, before, rise in self.members[state]:
            node = self.child.get(node * 256 + byte, -1)
            if node < 0:
                continue
            opened.append((node, before, rise))
            token = self.token_at[node]
            if last < 0 and token >= 0 and (before < 0 or self.may_follow(before, token)):
                last, count = token, rise + 1
        if last < 0:
            raise ValueError("a byte that no token covers")
        members = (*((n, b, r - count) for n, b, r in opened), (0, last, 0))
        target = self.states.get(members)
        if target is None:
            target = self.states[members] = len(self.members)
            self.members.append(members)
            if target >= len(self.next):
                self.next = np.concatenate([self.next, np.full_like(self.next, -1)])
                self.emit = np.concatenate([self.emit, np.zeros_like(self.emit)])
        if not -128 < count < 128:
            raise OverflowError("a transition emits too many tokens")
        self.next[state, self.column[byte]], self.emit[state, self.column[byte]] = target, count

    def count(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Tokens of each byte string: all run side by side, longest first."""
        if len(self.members) > self.LIMIT:
            self.clear()
        for byte in np.flatnonzero(np.bincount(data, minlength=256)):
            if self.column[byte] < 0:
                self.column[byte] = len(self.bytes)
                self.bytes.append(int(byte))
        if len(self.bytes) > self.next.shape[1]:
            self.next = np.pad(self.next, ((0, 0), (0, 128)), constant_values=-1)
            self.emit = np.pad(self.emit, ((0, 0), (0, 128)))
        order = np.argsort(-lengths, kind="stable")
        live = np.searchsorted(-lengths[order], -np.arange(int(lengths.max(initial=0))), "left")
        at, state, total = starts[order], np.zeros(len(order), np.int32), np.zeros(len(order), np.int64)
        for t, n in enumerate(live):
            now, byte = state[:n], self.column[data[at[:n] + t]]
            target = self.next[now, byte]
            unknown = np.flatnonzero(target < 0)
            if len(unknown):
                for key in np.unique(now[unknown].astype(np.int64) * 256 + byte[unknown]).tolist():
                    self.compile(key >> 8, self.bytes[key & 255])
                target = self.next[now, byte]
            total[:n] += self.emit[now, byte]
            state[:n] = target
        out = np.empty(len(order), np.int64)
        out[order] = total
        return out


def _byte_of_char() -> dict[str, int]:
    """The public byte alphabet of byte-level BPE files: printable Latin-1 stands for itself, and the
    other bytes, in order, for the characters from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizer:
    """A compiled byte-level BPE tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Regex, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = spec["pre_tokenizer"]
        if spec["model"]["type"] != "BPE" or split["type"] != "ByteLevel" or split["add_prefix_space"] or spec["normalizer"]:
            raise ValueError("only plain byte-level BPE files are compiled")
        alphabet = _byte_of_char()
        raw = lambda s: bytes(alphabet[c] for c in s)
        pairs = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            pairs[raw(a), raw(b)] = rank
        special = {t["content"] for t in spec["added_tokens"]}
        self.special = sorted((s.encode() for s in special), key=len, reverse=True)
        self.counter = Counter([raw(t) for t in spec["model"]["vocab"] if t not in special], pairs)

        def found(pattern: str, text: str) -> bytes:
            runs = pre_tokenizers.Split(Regex(pattern), behavior="removed", invert=True).pre_tokenize_str(text)
            return "".join(s for s, _ in runs).encode()

        symbol = np.array([WS, LT, NU, OT], np.int8)[class_table(found)]
        assert (WHITE, LETTER, NUMBER, OTHER) == (0, 1, 2, 3)
        symbol[32], symbol[39] = SP, AP
        for letter, c in zip("stmdrvle", (C1, C1, C1, C1, CR, CV, CL, CE), strict=True):
            symbol[ord(letter)] = c
        self.symbol = symbol
        self.keys, self.values = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def _distinct(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Counts by pre-token, each distinct one run once; what was counted lately is looked up."""
        unique, rep, inverse = np.unique(keys, return_index=True, return_inverse=True)
        place = np.searchsorted(self.keys, unique)
        place[place == len(self.keys)] = 0
        seen = self.keys[place] == unique if len(self.keys) else np.zeros(len(unique), bool)
        counts = np.zeros(len(unique), np.int64)
        counts[seen] = self.values[place[seen]]
        new = np.flatnonzero(~seen)
        counts[new] = self.counter.count(data, starts[rep[new]], lengths[rep[new]])
        if len(self.keys) > 400_000:
            self.keys, self.values = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.keys, self.values = np.concatenate([self.keys, unique[new]]), np.concatenate([self.values, counts[new]])
        order = np.argsort(self.keys, kind="stable")
        self.keys, self.values = self.keys[order], self.values[order]
        return counts[inverse]

    def _segments(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte ranges between special strings and texts' ends, and which of them are special strings."""
        body, hits = data.tobytes(), []
        at = 0
        while self.special:
            found = [(p, -len(s), s) for s in self.special if (p := body.find(s, at)) >= 0]
            if not found:
                break
            p, _, s = min(found)
            text = np.searchsorted(offsets, p, "right")
            if p + len(s) <= offsets[text]:
                hits.append((p, p + len(s)))
                at = p + len(s)
            else:  # it runs over the end of a text
                at = p + 1
        edges = np.unique(np.concatenate([offsets, np.array(hits, np.int64).ravel()]))
        return edges, np.searchsorted(edges, np.array([a for a, _ in hits], np.int64))

    def count(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each text."""
        per_text = np.zeros(len(offsets) - 1, np.int64)
        if not len(data):
            return per_text
        edges, special = self._segments(data, offsets)
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        symbols = self.symbol[np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)]
        ends = np.searchsorted(lead, edges[1:])
        with_ends = np.insert(symbols, ends, END)
        codes = run_segmenter(with_ends)
        here = np.flatnonzero(codes & HERE)
        early = np.flatnonzero(codes & BEFORE) - 1
        marks = np.zeros(len(with_ends), bool)
        marks[here] = True
        marks[early] = True
        real = np.ones(len(with_ends), bool)
        real[ends + np.arange(len(ends))] = False
        starts = lead[np.flatnonzero(marks[real])]
        stops = np.append(starts[1:], len(data))
        counts = np.ones(len(starts), np.int64)
        inside = np.ones(len(starts), bool)
        for i in special:  # a special string is one token, whatever it would be as text
            lo, hi = np.searchsorted(starts, edges[i]), np.searchsorted(starts, edges[i + 1])
            inside[lo:hi] = False
            counts[lo:hi] = 0
            counts[lo] = 1
        keys = span_hash(data, starts[inside], stops[inside])
        counts[inside] = self._distinct(keys, data, starts[inside], (stops - starts)[inside])
        sums = np.concatenate([[0], np.cumsum(counts)])
        return np.diff(sums[np.searchsorted(starts, offsets)])


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


def count_tokens(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every text, as the library for the file counts by default:
    no added special tokens, while a special string inside a text is one token.

    A null text is empty: 0 tokens. Texts are taken 2 MB at a time; a text of over 8 MB is counted piece by
    piece, cut where no pre-token is cut, so memory does not depend on the longest text. Each row is counted by
    itself: null and repeated ids and repeated rows stay as they are, an empty table gives an empty table, and
    columns other than doc_id and text are not looked at. Pre-tokens that were counted lately are known again
    by 64-bit hashes.
    """
    size = 2_000_000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for batch in batches:
            offsets, data = texts(batch.column(1))
            counts = []
            for lo, hi in parts(offsets, size):
                body = data[offsets[lo] : offsets[hi]]
                if len(body) > 4 * size:
                    cuts = np.array(safe_cuts(body.tobytes(), size))
                    counts.append(np.array([sum(int(t.count(body[a:b], np.array([0, b - a]))[0]) for a, b in zip(cuts, cuts[1:], strict=False))]))
                else:
                    counts.append(t.count(body, offsets[lo : hi + 1] - offsets[lo]))
            n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets), pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(trimmed(run), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
