"""Registered queries that no SQL expresses, over a whole small table, against plain Python."""

import os
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from dokuma.functions import hashing, markup, turkish
from dokuma.operators import bpe, corpus, morphology, tokens
from dokuma.plans import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are not here")


@pytest.fixture(scope="module")
def texts():
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()
    return {d: t for d, t in rows if t is not None}


@pytest.fixture(scope="module")
def counts(texts):
    return Counter(turkish.lower(w) for t in texts.values() for w in re.findall(f"{turkish.LETTERS}+", t))


@pytest.fixture(scope="module")
def merges(counts):
    return bpe.train_local(sorted(counts.items(), key=lambda r: (-r[1], r[0]))[: bpe.WORDS], 200)


def rows_of(spark, name):
    return [tuple(r) for r in queries.QUERIES[name](spark, SF).collect()]


def judged(lines):
    """By block: its long lines, repeated ones among them, and whether it stays; lines: (line number, text)."""
    blocks, seen, out = defaultdict(list), set(), {}
    for n, text in lines:
        if len(text.encode()) >= corpus.LONG:
            blocks[n // corpus.BLOCK].append(text)
    for b in sorted(blocks):
        dup = sum(text in seen for text in blocks[b])
        out[b] = (len(blocks[b]), dup, 2 * dup <= len(blocks[b]))
        if out[b][2]:
            seen |= set(blocks[b])
    return out


def drawn(blocks):
    draws = hashing.pcg_range(corpus.SEED, corpus.SEQUENCE, np.arange(len(blocks)), 1000).tolist()
    return {b: (rank, d, d < corpus.KEPT) for rank, (b, d) in enumerate(zip(sorted(blocks), draws, strict=True))}


def test_blocks_and_samples(spark, texts):
    lines = list(enumerate(line for t in texts.values() for line in t.split("\n")))
    blocks = judged(lines)
    assert {r[0]: r[1:] for r in rows_of(spark, "q14_block_dedup_exact")} == blocks
    sample = queries.QUERIES["q15_block_sample"](spark, SF).collect()
    assert {r["block_id"]: (r["rank"], r["draw"], r["sampled"]) for r in sample} == drawn([b for b, v in blocks.items() if v[2]])


def test_subtitle_corpus(spark, texts):
    cleaned = {(d, n): markup.subtitle_clean(line) for d, t in texts.items() for n, line in enumerate(t.split("\n"))}
    assert {r[:2]: r[2] for r in rows_of(spark, "q21_subtitle_clean")} == {at: text for at, text in cleaned.items() if text}
    raw = enumerate(line for t in texts.values() for line in t.split("\n"))
    kept, last = [], None
    for n, line in raw:
        text = markup.subtitle_clean(line) if len(line.encode()) <= corpus.LINE else ""
        if text and text != last:
            kept.append((n, text))
            last = text
    gone = {b for b, v in judged(kept).items() if not v[2]}
    sample = drawn({n // corpus.BLOCK for n, _ in kept} - gone)
    want = {(n, text) for n, text in kept if sample.get(n // corpus.BLOCK, (0, 0, False))[2]}
    got = queries.QUERIES["q48_subtitle_corpus"](spark, SF).collect()
    assert {(r["line_no"], r["text"]) for r in got} == want and len(got) == len(want)


def test_texts_are_cleaned_once(spark):
    """Filters on clean text don't clean it a second time."""
    pages = spark.createDataFrame([("a", "b", 0, None)], "title string, text string, ns int, redirect string")
    for rows in (queries.QUERIES["q21_subtitle_clean"](spark, SF), corpus.articles(pages)):
        assert rows._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1


def test_wikitext(spark):
    pages = duckdb.sql(f"SELECT page_id, html FROM '{SF}/pages.parquet'").fetchall()
    assert dict(rows_of(spark, "q21_wikitext_clean")) == {p: markup.wikitext_clean(markup.xml_unescape(h)) for p, h in pages}


def test_merges_and_codes(spark, texts, counts, merges):
    assert rows_of(spark, "q24_bpe_train") == [(i, *m) for i, m in enumerate(merges)]
    assert rows_of(spark, "q61_bpe_train_all_words") == [(i, *m) for i, m in enumerate(merges[:64])]
    rank = {(a, b): (i, z) for i, (a, b, z) in enumerate(merges)}

    def plain(word):
        out = list(word.encode())
        while found := [(rank[p], i) for i, p in enumerate(zip(out, out[1:], strict=False)) if p in rank]:
            (_, new), i = min(found)
            out[i : i + 2] = [new]
        return out

    assert {w: list(s) for w, s in rows_of(spark, "q25_bpe_encode")} == {w: plain(w) for w in counts}

    # the tokenizer: ends of passages, pieces of a hundred bytes, the best parse or the merges of a whole word
    seed = {*queries.LEXICON}
    known = frozenset(seed | {w[:-3] for w in seed if re.search("m[ae]k$", w) and len(w.encode()) >= 4})
    shift, eos = len(turkish.SUFFIXES), len(turkish.SUFFIXES) + 256 + len(merges) + 2
    remembered = {}

    def ids(piece):
        if piece is None:
            return [eos]
        if piece not in remembered:
            parses = morphology.analyze(piece, known)[0]
            root, tail = min(parses, key=lambda p: (-{"git": 1000, "gid": 1}.get(p[0], 0), len(p[1])), default=(piece, ()))
            remembered[piece] = [shift + s for s in plain(root)] + list(tail)
        return remembered[piece]

    got = {d: list(t) for d, t in rows_of(spark, "q29_tokenize_corpus")}
    assert got == {d: [i for piece in tokens.segments(t) for i in ids(piece)] for d, t in texts.items()}


def test_mixture(spark, texts):
    streams = {"sub": [], "wiki": []}
    for d, t in texts.items():
        streams["sub" if d % 2 == 0 else "wiki"] += [len(w.encode()) for w in re.split("[ \n]+", t) if w]
    want, slot = {}, 0
    for name, n, seed in tokens.MIXTURE:
        train = len(streams[name]) - len(streams[name]) * tokens.VALIDATION // 1000
        for start in tokens.random_windows(train, 128, n, seed + 1).tolist():
            want[slot] = (name, start, streams[name][start : start + 128], streams[name][start + 1 : start + 129])
            slot += 1
    got = queries.QUERIES["q19_mixture_batch"](spark, SF).collect()
    assert {r["slot"]: (r["corpus"], r["start"], list(r["ids"]), list(r["targets"])) for r in got} == want
