"""Token streams: segmentation of text, word tokens, splits, windows and mixtures."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dokuma.functions import hashing, turkish
from dokuma.functions.turkish import SUFFIXES
from dokuma.operators import morphology
from dokuma.operators.bpe import Merges
from dokuma.operators.order import running, with_neighbour

# Bytes of a piece, share of validation tokens in 1000, sequences of a mixture by corpus.
PIECE, VALIDATION = 100, 10
MIXTURE = (("sub", 9, 4_000_000), ("wiki", 5, 8_000_000))

_RUN = re.compile(f"({turkish.LETTERS}+)|[^{turkish.LETTERS[1:-1]}]+")


def runs(text: Column) -> Column:
    """Maximal runs of letters and of other characters, in order."""
    other = "[^" + turkish.LETTERS[1:]
    return F.regexp_extract_all(text, F.lit(f"({turkish.LETTERS}+|{other}+)"), F.lit(1))


def eos_count(text: Column) -> Column:
    """Blank-line runs, each of which ends a passage."""
    return F.regexp_count(text, F.lit("\n{2,}"))


def cut(piece: str, size: int = PIECE, safe: bool = True) -> list[str]:
    """Pieces of at most `size` bytes, cut between characters; unless `safe`, anywhere (lone bytes are escaped)."""
    raw, out = piece.encode("utf-8", "surrogateescape"), []
    if not safe:
        return [raw[i : i + size].decode("utf-8", "surrogateescape") for i in range(0, len(raw), size)]
    while len(raw) > size:
        at = size
        while raw[at] & 0xC0 == 0x80:
            at -= 1
        out.append(raw[:at].decode("utf-8"))
        raw = raw[at:]
    return [*out, raw.decode("utf-8")] if raw else out


def segments(text: str, eos: bool = True, longest: int = PIECE) -> list[str | None]:
    """Pieces of a text in order; None stands for an end of passage. Without eos, as a prompt is encoded, line feeds
    are plain text and long pieces are cut at any byte. longest: bytes of a piece."""
    out: list[str | None] = []
    for m in _RUN.finditer(text):
        if m[1] or not eos or "\n\n" not in m[0]:
            # a character has four bytes at most: short pieces need no cut
            out += [m[0]] if 4 * len(m[0]) <= longest else cut(m[0], longest, eos)
            continue
        for i, gap in enumerate(re.split("\n{2,}", m[0])):
            out += ([None] if i else []) + cut(gap, longest)
    return out


class Vocabulary:
    """Token ids: the suffixes, then the merge symbols, then PAD, BOS and EOS."""

    def __init__(self, merges: Merges):
        self.merges, self.base = merges, len(SUFFIXES)
        self.pad = self.base + len(merges.bytes)
        self.bos, self.eos, self.size = self.pad + 1, self.pad + 2, self.pad + 3

    def encode_word(self, word: str, known: frozenset[str], frequency: dict[str, int]) -> list[int]:
        parse = morphology.best(morphology.analyze(word, known)[0], frequency) if morphology.may_parse(word, known) else None
        root, suffixes = parse or (word, ())
        return [self.base + s for s in self.merges.encode(root)] + list(suffixes)

    def encode(self, text: str, known: frozenset[str], frequency: dict[str, int], eos: bool = True) -> list[int]:
        out: list[int] = []
        for piece in segments(text, eos):
            out += [self.eos] if piece is None else self.encode_word(piece, known, frequency)
        return out

    def decode(self, ids: list[int], by_word: bool = True) -> str:
        """Text of the ids. A suffix follows the harmony of its own word, or of all text so far."""
        done, word = "", b""
        for i in ids:
            if i < self.base:
                stem = word.decode("utf-8", "surrogateescape")
                scope = stem if by_word else done + stem
                changed, tail = turkish.resolve(scope, SUFFIXES[i])
                stem = changed[len(scope) - len(stem) :]
                word = (stem + tail).encode("utf-8", "surrogateescape")
            elif i < self.pad:
                piece = self.merges.bytes[i - self.base]
                if word and not re.search(turkish.LETTERS, piece.decode("utf-8", "ignore") or "a"):
                    done, word = done + word.decode("utf-8", "surrogateescape"), b""
                word += piece
        return (done.encode("utf-8", "surrogateescape") + word).decode("utf-8", "replace")


#: Pieces that a worker remembers at most, and what it remembers: by the tokenizer's digest, ids by piece.
REMEMBERED = 1_000_000
_remembered: dict[str, dict[str | None, list[int]]] = {}


def tokenize(docs: DataFrame, vocabulary: Vocabulary, known: frozenset[str], frequency: dict[str, int], id_col: str = "doc_id") -> DataFrame:
    """doc_id, tokens. A worker analyses each piece once and remembers it over its batches and tasks."""
    digest = hashlib.sha256(repr((vocabulary.merges.merges, sorted(known), sorted(frequency.items()))).encode()).hexdigest()
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, known, frequency))

    @F.pandas_udf("array<int>")
    def encode(column: pd.Series) -> pd.Series:
        from dokuma.operators import tokens as here  # the module's own memory, not a copy sent along

        if digest not in here._remembered:
            here._remembered.clear()
            here._remembered[digest] = {None: [shared.value[0].eos]}
        seen = here._remembered[digest]

        def one(text: str | None) -> np.ndarray:
            out: list[int] = []
            for piece in segments(text or ""):
                ids = seen.get(piece)
                if ids is None:
                    if len(seen) > REMEMBERED:
                        seen.clear()
                        seen[None] = [shared.value[0].eos]
                    ids = seen[piece] = shared.value[0].encode_word(piece, *shared.value[1:])
                out += ids
            return np.array(out, np.int32)

        return column.map(one)

    return docs.select(id_col, encode("text").alias("tokens"))


def placed(texts: DataFrame, order: list[str]) -> DataFrame:
    """corpus, pos, tokens: each text's tokens and the position of the first one, which run on through each corpus in the given
    order of its texts. texts: corpus, tokens (an array) and the order's columns; a text's first position is the sum of the
    sizes before it."""
    rows = running(texts.withColumn("_size", F.size("tokens").cast("long")).where("_size > 0"), order, "_size", "_start", "corpus")
    return rows.select("corpus", F.col("_start").alias("pos"), "tokens")


def stream(texts: DataFrame, order: list[str]) -> DataFrame:
    """corpus, pos, token: the tokens of placed(), one by one."""
    rows = placed(texts, order)
    return rows.select("corpus", "pos", F.posexplode("tokens").alias("_at", "token")).select("corpus", (F.col("pos") + F.col("_at")).alias("pos"), "token")


def split(tokens: DataFrame, n: Column | None = None) -> DataFrame:
    """num_tokens, train_tokens, val_tokens of each corpus: the last VALIDATION in 1000 validate. A row is a token, or n tokens."""
    n = F.count("*") if n is None else F.sum(n)
    val = F.floor(n * VALIDATION / 1000).cast("long")
    return tokens.groupBy("corpus").agg(n.alias("num_tokens"), (n - val).alias("train_tokens"), val.alias("val_tokens"))


def validation_windows(sizes: DataFrame, windows: int, length: int) -> DataFrame:
    """corpus, window, start of evenly spaced windows in the validation part."""
    stride = F.floor((F.col("val_tokens") - length - 1) / windows)
    rows = sizes.where(F.col("val_tokens") >= windows + length + 1)
    return rows.select("corpus", F.explode(F.sequence(F.lit(0), F.lit(windows - 1))).alias("window"), F.col("train_tokens"), stride.alias("stride")).select("corpus", "window", (F.col("train_tokens") + F.col("window") * F.col("stride")).cast("long").alias("start"))


def window_tokens(windows: DataFrame, tokens: DataFrame, length: int) -> DataFrame:
    """corpus, window, ids, targets (ids shifted by one). Windows are few; each token row finds the windows
    that hold it through its span of positions, so the join is an equality."""
    span = windows.withColumn("cell", F.explode(F.sequence(F.floor(F.col("start") / length), F.floor((F.col("start") + length) / length))))
    placed = tokens.withColumn("cell", F.floor(F.col("pos") / length))
    inside = placed.join(span, ["corpus", "cell"]).where((F.col("pos") >= F.col("start")) & (F.col("pos") <= F.col("start") + length))
    keys = [c for c in windows.columns if c != "start"]
    rows = inside.groupBy(*keys, "start").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]).alias("t"))
    return rows.select(*keys, "start", F.slice("t", 1, length).alias("ids"), F.slice("t", 2, length).alias("targets"))


def next_tokens(texts: DataFrame, order: list[str]) -> DataFrame:
    """corpus, token, next: the pairs that a model learns from. Pairs within a text need no shuffle; those over
    the texts' borders come from each text's first and last token, in the order of the texts."""
    full = texts.where(F.size("tokens") > 0)
    n = F.size("tokens")
    inner = full.where(n > 1).select("corpus", F.explode(F.arrays_zip(F.slice("tokens", F.lit(1), n - 1).alias("token"), F.slice("tokens", F.lit(2), n - 1).alias("next"))).alias("p")).select("corpus", "p.token", "p.next")
    ends = full.select("corpus", *order, F.struct("corpus", F.get("tokens", F.lit(0)).alias("first")).alias("_head"), F.get("tokens", n - 1).alias("token"))
    over = with_neighbour(ends, ["corpus", *order], "_head", "_next", ahead=True).where(F.col("_next.corpus") == F.col("corpus"))
    return inner.unionByName(over.select("corpus", "token", F.col("_next.first").alias("next")))


def random_windows(size: int, length: int, batch: int, seed: int) -> np.ndarray:
    """Starts of a batch: each window has a generator of its own."""
    return np.array([hashing.pcg_range((seed * 1000003 + w) % hashing.WORD, 99 + w, np.array([0]), size - length - 1)[0] for w in range(batch)])


def mixture(sizes: DataFrame, step: int, length: int) -> DataFrame:
    """slot, corpus, start of a step's sequences: first one corpus's, then the other's."""
    train = {r["corpus"]: r["train_tokens"] for r in sizes.collect()}  # a row for each corpus
    rows, slot = [], 0
    for corpus, n, seed in MIXTURE:
        for start in random_windows(train[corpus], length, n, seed + step).tolist() if corpus in train else []:
            rows.append((slot, corpus, start))
            slot += 1
    return sizes.sparkSession.createDataFrame(rows, "slot int, corpus string, start long")


def sample_next(probabilities: DataFrame, draw: Column) -> DataFrame:
    """The first j whose running probability reaches the draw (the last j if rounding leaves none); columns i, j, p."""
    run = F.sum("p").over(Window.partitionBy("i").orderBy("j"))
    hit = F.min(F.when(F.col("_run") >= draw, F.col("j")))
    return probabilities.withColumn("_run", run).groupBy("i").agg(F.coalesce(hit, F.max("j")).alias("j"))


def sample_logits(logits: DataFrame, draw: Column, temperature: float = 1.0) -> DataFrame:
    """i, j: a draw from the softmax of logits (i, j, v) over the temperature."""
    row = Window.partitionBy("i")
    e = F.exp((F.col("v") - F.max("v").over(row)) / temperature)
    weights = logits.withColumn("_e", e)
    return sample_next(weights.withColumn("p", F.col("_e") / F.sum("_e").over(row)).drop("_e"), draw)


def token_class(token: Column, base: int, symbols: int) -> Column:
    """suffix, piece or special, by a token's id: suffixes first, then merge symbols."""
    return F.when(token < base, "suffix").when(token < base + symbols, "piece").otherwise("special")


def context(ids: Column, length: int = 1024) -> Column:
    """The last `length` ids."""
    return F.when(F.size(ids) > length, F.slice(ids, -length, length)).otherwise(ids)
