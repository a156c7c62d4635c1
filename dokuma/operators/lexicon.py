"""The lexicon as a minimal automaton, and the suffix grammar walked over a whole batch of words at once."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dokuma.functions.turkish import DERIVED, HARDENS, NOUN, SOFTENS, SUFFIXES, VOICELESS, VOWELS, lower, resolve
from dokuma.operators.morphology import DEPTH, PARSES, ROOT_BYTES, STEPS, analyze

#: Bits of a step of a path: suffix number + 1, letters of its surface, and whether the stem was hardened. Paths sort as the
#: depth-first search meets them.
STEP_BITS, SIZE_BITS = 9, 3
#: What a last letter is to a suffix: a vowel, a voiceless consonant that softens, another voiceless one, any other sign.
VOWEL, SOFT, HARD, OTHER = range(4)
_SAMPLE = {SOFT: "p", HARD: "s", OTHER: "n"}


class Automaton:
    """A minimal automaton of words: states by the code points read, final ones among them. State 0 is the start, -1 none."""

    def __init__(self, words: Iterable[str]):
        known: dict[tuple, int] = {}
        edges: list[tuple[int, int, int]] = []
        finals: list[bool] = []
        # words in order: what lies behind the last common prefix is complete, and equal ends are one state
        path: list[tuple[int, dict[int, int], bool]] = [(0, {}, False)]

        def close(depth: int) -> None:
            while len(path) > depth:
                code, out, final = path.pop()
                key = (final, tuple(sorted(out.items())))
                if key not in known:
                    known[key] = len(finals)
                    finals.append(final)
                    edges.extend((known[key], c, to) for c, to in out.items())
                if path:
                    path[-1][1][code] = known[key]

        last = ""
        for word in sorted(set(words)):
            common = next((i for i, (x, y) in enumerate(zip(last, word, strict=False)) if x != y), min(len(last), len(word)))
            close(common + 1)
            path += [(ord(c), {}, False) for c in word[common:]]
            path[-1] = (*path[-1][:2], True)
            last = word
        close(1)
        code, out, final = path.pop()
        start = len(finals)
        edges.extend((start, c, to) for c, to in out.items())
        finals.append(final)
        # the start comes first
        number = np.arange(len(finals)) + 1
        number[start] = 0
        self.final = np.zeros(len(finals), bool)
        self.final[number] = finals
        table = np.array(edges, np.int64).reshape(-1, 3)
        keys = number[table[:, 0]] << 21 | table[:, 1]
        order = np.argsort(keys)
        self.keys, self.to = keys[order], number[table[:, 2]][order]

    def step(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The states after reading a sign each; -1 stays -1."""
        if not len(self.keys):
            return np.full(len(state), -1)
        key = np.maximum(state, 0) << 21 | code
        at = np.searchsorted(self.keys, key).clip(max=len(self.keys) - 1)
        return np.where((state >= 0) & (self.keys[at] == key), self.to[at], -1)

    def accepts(self, state: np.ndarray) -> np.ndarray:
        return (state >= 0) & self.final[np.maximum(state, 0)]


def _surfaces() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Surface number by suffix, last vowel and kind of last letter (-1 where the stem itself would change), and each surface's
    code points and length."""
    table = np.full((len(SUFFIXES), len(VOWELS) + 1, 4), -1)
    found: dict[str, int] = {}
    for number, suffix in enumerate(SUFFIXES):
        for v, vowel in enumerate(("", *VOWELS)):
            for kind in range(4):
                stem = vowel if kind == VOWEL else vowel + _SAMPLE[kind]
                if not stem:
                    continue
                changed, surface = resolve(stem, suffix)
                if changed == stem:
                    table[number, v, kind] = found.setdefault(surface, len(found))
    sizes = np.array([len(s) for s in found])
    letters = np.zeros((len(found), sizes.max()), np.int64)
    for surface, n in found.items():
        letters[n, : len(surface)] = [ord(c) for c in surface]
    return table, letters, sizes


_TABLE, _LETTERS, _SIZES = _surfaces()
_HARDER = {ord(soft): ord(hard) for soft, hard in HARDENS.items()}


def _letter_kind(code: int) -> int:
    c = lower(chr(code))
    return VOWEL if c in VOWELS else SOFT if c in SOFTENS else HARD if c in VOICELESS else OTHER


def parses(words: list[str], automaton: Automaton, known: frozenset[str] | set[str] | None = None) -> list[list[tuple[str, tuple[int, ...]]]]:
    """For each word what morphology.analyze() finds, in its order: all stems and suffixes of one depth are tried at once, for
    all words. Words that would take over STEPS steps go to analyze() itself, for which `known` is needed (without it, they
    keep what they have)."""
    out: list[list[tuple[str, tuple[int, ...]]]] = [[] for _ in words]
    size = np.array([len(w) if len(w.encode("utf-8", "surrogateescape")) < ROOT_BYTES else 0 for w in words])
    if not size.any():
        return out
    width = int(size.max())
    text = np.zeros((len(words), width + 1), np.int64)
    for n, w in enumerate(words):
        if size[n]:
            text[n, : size[n]] = np.frombuffer(w.encode("utf-32-le", "surrogatepass"), "<u4")
    codes, inverse = np.unique(text, return_inverse=True)
    inverse = inverse.reshape(text.shape)
    kind_of = np.array([_letter_kind(int(c)) if c else OTHER for c in codes])
    vowel_of = np.array([VOWELS.find(lower(chr(int(c)))) + 1 if k == VOWEL else 0 for c, k in zip(codes, kind_of, strict=True)])
    harder = np.array([_HARDER.get(int(c), 0) for c in codes])[inverse]
    wide = np.array([len(chr(int(c)).encode("utf-8", "surrogatepass")) for c in codes])[inverse]
    # of each prefix: last vowel, kind of last letter, and the automaton's state
    vowel = np.zeros((len(words), width + 1), np.int64)
    kind = np.full((len(words), width + 1), OTHER)
    state = np.zeros((len(words), width + 1), np.int64)
    for p in range(1, width + 1):
        own = vowel_of[inverse[:, p - 1]]
        vowel[:, p] = np.where(own > 0, own, vowel[:, p - 1])
        kind[:, p] = kind_of[inverse[:, p - 1]]
        state[:, p] = automaton.step(state[:, p - 1], text[:, p - 1])
    inside = np.arange(width + 1)[None] <= size[:, None]
    hardened = np.full(state.shape, -1)
    hardened[:, 1:] = np.where(harder[:, :-1] > 0, automaton.step(state[:, :-1].ravel(), harder[:, :-1].ravel()).reshape(len(words), width), -1)
    rooted = ((automaton.accepts(state) | automaton.accepts(hardened)) & inside & (np.arange(width + 1) > 0)).any(1)

    w = np.flatnonzero(rooted & (size > 0))
    e, h, cat, slot, path = size[w], np.zeros(len(w), np.int64), np.zeros(len(w), np.int64), np.full(len(w), 4), np.zeros(len(w), np.int64)
    steps = np.bincount(w, minlength=len(words))
    found: list[tuple[np.ndarray, ...]] = []
    for depth in range(DEPTH + 1):
        here = np.where(h > 0, automaton.step(state[w, np.maximum(e - 1, 0)], h), state[w, e])
        hit = automaton.accepts(here)
        found.append((w[hit], path[hit], e[hit], h[hit]))
        # a form of two bytes or more: a single sign of two bytes has no shorter stem anyway
        on = (e > 1) & (steps[w] <= STEPS) if depth < DEPTH else np.zeros(len(w), bool)
        w, e, h, cat, slot, path = w[on], e[on], h[on], cat[on], slot[on], path[on]
        if not len(w):
            break
        grown = []
        for number, suffix in enumerate(SUFFIXES):
            own = 0 if suffix.kind == DERIVED else 1 if suffix.kind == NOUN else 2
            free = np.ones(len(w), bool) if own == 0 else (cat == 0) | (cat == own)
            if suffix.slot:
                free &= suffix.slot < slot
            for k in range(1, _LETTERS.shape[1] + 1):
                at = np.flatnonzero(free & (e > k))
                p = e[at] - k
                surface = _TABLE[number, vowel[w[at], p], kind[w[at], p]]
                fits = (surface >= 0) & (_SIZES[surface] == k)
                at, p, surface = at[fits], p[fits], surface[fits]
                for q in range(k):
                    sign = text[w[at], p + q]
                    if q == k - 1:
                        sign = np.where(h[at] > 0, h[at], sign)
                    same = sign == _LETTERS[surface, q]
                    at, p, surface = at[same], p[same], surface[same]
                if not len(at):
                    continue
                code = np.int64((number + 1) << (SIZE_BITS + 1) | k << 1) << np.int64(STEP_BITS * (DEPTH - 1 - depth))
                twin = np.zeros(len(at), bool) if not suffix.softening else (kind[w[at], p] != VOWEL) & (harder[w[at], p - 1] > 0)
                for soft, some in ((0, np.ones(len(at), bool)), (1, twin)):
                    a = at[some]
                    grown.append((w[a], p[some], harder[w[a], p[some] - 1] if soft else np.zeros(len(a), np.int64), cat[a] if own == 0 else np.full(len(a), own), np.full(len(a), suffix.slot) if suffix.slot else slot[a], path[a] | code | np.int64(soft) << np.int64(STEP_BITS * (DEPTH - 1 - depth))))
        if not grown:
            break
        w, e, h, cat, slot, path = (np.concatenate(x) for x in zip(*grown, strict=True))
        steps += np.bincount(w, minlength=len(words))

    w, path, e, h = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((path, w))
    for n, way, end, hard in zip(w[order].tolist(), path[order].tolist(), e[order].tolist(), h[order].tolist(), strict=True):
        if len(out[n]) < PARSES:
            digits = [way >> STEP_BITS * (DEPTH - 1 - d) + SIZE_BITS + 1 & 31 for d in range(DEPTH)]
            root = words[n][: end - 1] + chr(hard) if hard else words[n][:end]
            out[n].append((root, tuple(d - 1 for d in reversed(digits) if d)))
    for n in np.flatnonzero(steps > STEPS).tolist() if known is not None else []:
        out[n] = analyze(words[n], known)[0]
    return out


def analyze_words(words: DataFrame, known: DataFrame, limit: int = 2_000_000) -> DataFrame:
    """word, parse_no, root, suffixes of each distinct word. The lexicon goes to every worker as an automaton; it is a
    dictionary of a language, of checked size, and larger ones are refused."""
    n = known.count()
    if n > limit:
        raise ValueError(f"a lexicon of {n} words is over the limit of {limit}")
    roots = frozenset(r[0] for r in known.where("word is not null").select("word").toLocalIterator())
    shared = words.sparkSession.sparkContext.broadcast((Automaton(roots), roots))

    @F.pandas_udf("array<struct<root:string,suffixes:array<int>>>")
    def parse(column: pd.Series) -> pd.Series:
        found = parses(column.tolist(), *shared.value)
        return pd.Series([[{"root": r, "suffixes": list(s)} for r, s in own] for own in found], dtype=object)

    rows = words.where("word is not null").select("word").distinct().select("word", F.posexplode(parse("word")).alias("parse_no", "p"))
    return rows.select("word", "parse_no", F.col("p.root").alias("root"), F.col("p.suffixes").alias("suffixes"))
