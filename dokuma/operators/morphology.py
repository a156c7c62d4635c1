"""Morphological analysis of Turkish words against a lexicon, choice among parses, and tokens of words."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dokuma.functions import turkish
from dokuma.functions.turkish import DERIVED, HARDENS, SUFFIXES, VOWELS, lower, resolve

# The analyser's bounds.
STEPS, PARSES, DEPTH, ROOT_BYTES = 5000, 16, 6, 64


def lexicon(words: DataFrame, column: str = "word") -> DataFrame:
    """Words and the bare roots of infinitives, each once."""
    word = F.col(column)
    return words.select(word.alias("word")).unionByName(words.select(turkish.bare_verb(word).alias("word")).where("word is not null")).distinct()


@lru_cache(maxsize=None)
def _surfaces(number: int) -> tuple[str, ...]:
    """All strings in which a suffix can appear: one for each kind of stem ending."""
    stems = [v + c for v in ("", *VOWELS) for c in ("", "n", "p")]
    return tuple({resolve(stem or "n", SUFFIXES[number])[1] for stem in stems})


def _splits(word: str, number: int) -> Iterator[str]:
    """Stems, longest first, that make up the word with the suffix."""
    sizes = sorted({len(s) for s in _surfaces(number) if len(s) < len(word) and word.endswith(s)})
    for size in sizes:
        stem = word[: len(word) - size]
        if resolve(stem, SUFFIXES[number]) == (stem, word[len(stem) :]):
            yield stem


def analyze(word: str, known: frozenset[str] | set[str]) -> tuple[list[tuple[str, tuple[int, ...]]], bool]:
    """Parses (root, suffix numbers from the root outwards), and whether the step budget ran out.

    The suffixes are peeled from the end, in table order, longer stems first. Noun and verb endings don't
    mix; noun endings follow case, possessive, plural from outside in. A softened stem is tried with its
    hard consonant, too.
    """
    found: list[tuple[str, tuple[int, ...]]] = []
    steps, cut = 0, False
    if len(word.encode("utf-8", "surrogateescape")) >= ROOT_BYTES:
        return found, cut
    pending: list[Iterator[tuple[str, tuple[int, ...], str, int]]] = [iter([(word, (), "", 4)])]
    while pending:
        item = next(pending[-1], None)
        if item is None:
            pending.pop()
            continue
        if steps == STEPS:
            cut = True
            continue
        steps += 1
        if len(found) >= PARSES:
            continue
        form, outer, kind, slot = item
        if form in known:
            found.append((form, outer[::-1]))
        if len(outer) < DEPTH and len(form.encode("utf-8", "surrogateescape")) >= 2:
            pending.append(_peeled(form, outer, kind, slot))
    return found, cut


def _peeled(form: str, outer: tuple[int, ...], kind: str, slot: int) -> Iterator[tuple[str, tuple[int, ...], str, int]]:
    for number, suffix in enumerate(SUFFIXES):
        if (suffix.kind != DERIVED and kind not in ("", suffix.kind)) or (suffix.slot and suffix.slot >= slot):
            continue
        now = kind if suffix.kind == DERIVED else suffix.kind
        for stem in _splits(form, number):
            rest = (*outer, number), now, suffix.slot or slot
            yield stem, *rest
            if suffix.softening and lower(stem[-1]) not in VOWELS and stem[-1] in HARDENS:
                yield stem[:-1] + HARDENS[stem[-1]], *rest


def may_parse(word: str, known: frozenset[str] | set[str]) -> bool:
    """Whether some prefix of the word is a root, its last letter hardened or not: without one there is no parse."""
    if word in known:
        return True
    for n in range(1, len(word)):
        if word[:n] in known or (word[n - 1] in HARDENS and word[: n - 1] + HARDENS[word[n - 1]] in known):
            return True
    return False


def best(parses: list[tuple[str, tuple[int, ...]]], frequency: dict[str, int]) -> tuple[str, tuple[int, ...]] | None:
    """The parse of the most frequent root, then of the fewest suffixes, then the first."""
    return min(parses, key=lambda p: (-frequency.get(p[0], 0), len(p[1])), default=None)


def disambiguate(parses: DataFrame, frequency: DataFrame) -> DataFrame:
    """One parse of each word; frequency: word, cnt."""
    counts = frequency.select(F.col("word").alias("root"), "cnt")
    order = Window.partitionBy("word").orderBy(F.desc("cnt"), F.size("suffixes"), "parse_no")
    rows = parses.join(counts, "root", "left").withColumn("cnt", F.coalesce("cnt", F.lit(0)))
    return rows.withColumn("_no", F.row_number().over(order)).where("_no = 1").drop("_no")


def surface(root: str, suffixes: Iterable[int]) -> str:
    """The word that a root and its suffixes make."""
    out = root
    for number in suffixes:
        out = turkish.attach(out, SUFFIXES[number])
    return out
