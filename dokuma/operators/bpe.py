"""Byte-pair merges over a weighted word list: pair counts, training, encoding and decoding."""

from __future__ import annotations

import heapq
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Words of a training list, and bytes of a word that are encoded in strict mode.
WORDS, WORD_BYTES = 100_000, 192


def top_words(counts: DataFrame, k: int = WORDS) -> DataFrame:
    """The k most frequent words; ties by word."""
    return counts.orderBy(F.desc("cnt"), "word").limit(k)


def symbols(words: DataFrame) -> DataFrame:
    """word, cnt, pos, sym: each word's bytes as symbols."""
    hexed = F.hex(F.encode("word", "UTF-8"))
    places = F.sequence(F.lit(0), F.octet_length("word") - 1)
    return words.where("word <> ''").select("word", "cnt", F.explode(places).alias("pos")).withColumn("sym", F.conv(F.substring(hexed, F.col("pos") * 2 + 1, F.lit(2)), 16, 10).cast("int"))


def pairs(syms: DataFrame) -> DataFrame:
    """left, right, weight of all neighbouring symbols."""
    window = Window.partitionBy("word").orderBy("pos")
    near = syms.select("word", "cnt", F.col("sym").alias("left"), F.lead("sym").over(window).alias("right")).where("right is not null")
    return near.groupBy("left", "right").agg(F.sum("cnt").alias("weight"))


def best_pair(counted: DataFrame) -> DataFrame:
    """The heaviest pair; ties by left, then right."""
    return counted.orderBy(F.desc("weight"), "left", "right").limit(1)


def apply_merge(syms: DataFrame, left: int, right: int, new: int) -> DataFrame:
    """All words with the pair merged, left to right without overlap. In a run of one symbol every second
    place merges."""
    window = Window.partitionBy("word").orderBy("pos")
    hit = (F.col("sym") == left) & (F.lead("sym").over(window) == right)
    marked = syms.withColumn("hit", F.coalesce(hit, F.lit(False)))
    if left == right:
        before = F.coalesce(F.lag("hit").over(window), F.lit(False))
        run = F.sum(F.when(F.col("hit") & ~F.col("before"), 1).otherwise(0)).over(window)
        marked = marked.withColumn("before", before).withColumn("run", run)
        odd = (F.row_number().over(Window.partitionBy("word", "run", "hit").orderBy("pos")) - 1) % 2 == 0
        marked = marked.withColumn("hit", F.col("hit") & odd)
    gone = F.coalesce(F.lag("hit").over(window), F.lit(False))
    merged = marked.withColumn("gone", gone).where("not gone").withColumn("sym", F.when(F.col("hit"), new).otherwise(F.col("sym")))
    return merged.select("word", "cnt", F.row_number().over(window).alias("pos") - 1, "sym").toDF("word", "cnt", "pos", "sym")


def train(words: DataFrame, merges: int) -> list[tuple[int, int, int]]:
    """(left, right, new) of each merge. Spark counts the words; the driver merges a list of at most WORDS
    words, updating only what a merge touches."""
    return train_local([(r[0], r[1]) for r in top_words(words).collect()], merges)


def train_local(words: list[tuple[str, int]], merges: int) -> list[tuple[int, int, int]]:
    texts = [list(w.encode("utf-8")) for w, _ in words]
    weight, where = defaultdict(int), defaultdict(set)
    for i, syms in enumerate(texts):
        for pair in zip(syms, syms[1:], strict=False):
            weight[pair] += words[i][1]
            where[pair].add(i)
    heap = [(-n, pair) for pair, n in weight.items()]
    heapq.heapify(heap)
    made: list[tuple[int, int, int]] = []
    while heap and len(made) < merges:
        n, pair = heapq.heappop(heap)
        if not n or weight[pair] != -n:
            continue
        new = 256 + len(made)
        made.append((*pair, new))
        touched = set()
        for i in where.pop(pair):
            old, cnt = texts[i], words[i][1]
            out, k = [], 0
            while k < len(old):
                both = k + 1 < len(old) and (old[k], old[k + 1]) == pair
                out.append(new if both else old[k])
                k += 1 + both
            for sign, syms in ((-1, old), (1, out)):
                for p in zip(syms, syms[1:], strict=False):
                    weight[p] += sign * cnt
                    where[p].add(i)
                    touched.add(p)
            texts[i] = out
        weight.pop(pair, None)
        for p in touched - {pair}:
            if weight[p] > 0:
                heapq.heappush(heap, (-weight[p], p))
    return made


class Merges:
    """A merge list: ranks of pairs, and the bytes of each symbol."""

    def __init__(self, merges: list[tuple[int, int, int]]):
        self.merges = merges
        self.rank = {(a, b): (i, c) for i, (a, b, c) in enumerate(merges)}
        self.bytes = [bytes([b]) for b in range(256)]
        for a, b, _ in merges:
            self.bytes.append(self.bytes[a] + self.bytes[b])

    def encode(self, word: str | bytes, strict: bool = False) -> list[int]:
        """Symbols of a word: the pair of least rank merges first, leftmost first. strict takes the first WORD_BYTES
        bytes only. Open pairs wait in a heap, so a word of any length takes n log n steps."""
        syms = list(word.encode("utf-8", "surrogateescape") if isinstance(word, str) else word)
        if strict:
            del syms[WORD_BYTES:]
        n, rank = len(syms), self.rank
        heap = [(rank[p][0], i, p) for i, p in enumerate(zip(syms, syms[1:], strict=False)) if p in rank]
        if not heap:
            return syms
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i]
            if j >= n or (syms[i], syms[j]) != pair:
                continue  # one of the two has merged since
            syms[i], syms[j] = rank[pair][1], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (p := (syms[i], syms[k])) in rank:
                    heapq.heappush(heap, (rank[p][0], i, p))
            h = before[i]
            if h >= 0 and (p := (syms[h], syms[i])) in rank:
                heapq.heappush(heap, (rank[p][0], h, p))
        return [s for s in syms if s >= 0]

    def decode(self, syms: list[int]) -> bytes:
        return b"".join(self.bytes[s] for s in syms)

    def lines(self) -> str:
        return "".join(f"{a} {b}\n" for a, b, _ in self.merges)

    @classmethod
    def parse(cls, text: str) -> Merges:
        rows = [tuple(map(int, line.split())) for line in text.splitlines() if line.strip()]
        return cls([(a, b, 256 + i) for i, (a, b) in enumerate(rows)])


def encode_words(words: DataFrame, merges: Merges) -> DataFrame:
    """word, symbols of the distinct words."""

    @F.pandas_udf("array<int>")
    def encode(column: pd.Series) -> pd.Series:
        return column.map(lambda w: np.array(merges.encode(w), np.int32))

    return words.select("word").distinct().select("word", encode("word").alias("symbols"))


def decode_words(encoded: DataFrame, merges: Merges) -> DataFrame:
    @F.pandas_udf("string")
    def decode(column: pd.Series) -> pd.Series:
        return column.map(lambda s: merges.decode(list(s)).decode("utf-8", "replace"))

    return encoded.withColumn("decoded", decode("symbols"))
