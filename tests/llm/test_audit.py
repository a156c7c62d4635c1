"""The divergence audit, the run detector and the compression bands against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from dokuma.llm import bands, divergence, runs
from dokuma.llm import queries as llm_queries

SCHEMA = "doc_id long, text string, lang string, source string, term string, n long, p long"
WORD = re.compile(r"[^\x20\x09-\x0d]+")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abCdeéß日", k=rng.randint(1, 2)))
    prose = lambda n: " ".join(word() for _ in range(n))
    out = [(None, "no id at all", "en", "s1"), (-5, None, "en", "s1"), (-4, "", "en", None), (-3, " \n\t", None, "s2"), (1007, "x" * 5000, "en", "s2"), (1008, prose(6000), "fr", "s1")]
    for i in range(160):
        text = prose(rng.randint(0, 40))
        if rng.random() < 0.2:
            part = prose(rng.randint(1, 6))
            text += " " + " ".join([part] * rng.randint(2, 7)) + "\n" + prose(3) + "\n" + part + "\n" + part
        out.append((i, text, rng.choice(["en", "en", "fr", None]), rng.choice(["s1", "s1", "s1", "s2", "s3", "é", None])))
    return [*out, out[20], out[20]]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, "t", 1, 2) for r in rows], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def plain_divergence(rows, least_docs=10, listed=10):
    terms = lambda t: [w.translate({i: i + 32 for i in range(65, 91)}) for w in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", t or "")]
    clean = [(lang or "", source or "", terms(text)) for _, text, lang, source in rows]
    held, count = defaultdict(Counter), defaultdict(Counter)
    for lang, source, ts in clean:
        held[lang].update(set(ts))
        count[lang, source].update(ts)
        count[lang, None].update(ts)
    kept = {lang: [t for t, n in held[lang].items() if n >= least_docs] for lang in {c[0] for c in clean}}
    groups = sorted({c[:2] for c in clean})

    def p(lang, source, term):
        v, n = len(kept[lang]), sum(count[lang, source][t] for t in kept[lang])
        return 1 + 10**9 * (count[lang, source][term] + 2) // (n + 2 * v)

    f = lambda a, b: (a - b) ** 2 // (a + b)
    out = set()
    for lang, source in groups:
        shares = {t: p(lang, source, t) for t in kept[lang]}
        pairs = [(sum(f(shares[t], p(lang, other, t)) for t in kept[lang]), other) for lang_, other in groups if lang_ == lang and other != source]
        own = [(f(shares[t], p(lang, None, t)), t) for t in kept[lang] if count[lang, source][t] and shares[t] > p(lang, None, t)]
        for part, found, top in (("pair", pairs, None), ("term", own, listed)):
            found.sort(key=lambda x: (-x[0], x[1].encode()))
            out |= {(lang, source, part, item, value, rank) for rank, (value, item) in enumerate(found[:top], 1)}
    return out


@pytest.mark.parametrize("pairs", [divergence.PAIRS, 3])
def test_divergence(docs, rows, empty, monkeypatch, pairs):
    monkeypatch.setattr(divergence, "PAIRS", pairs)
    got = [tuple(r) for r in divergence.divergence(docs).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_divergence(rows)
    assert {r[2] for r in got} == {"pair", "term"}
    if pairs > 3:
        assert {tuple(r) for r in divergence.divergence(docs, 10**6).collect()} == plain_divergence(rows, 10**6)
        assert {tuple(r) for r in divergence.divergence(docs, 1, 3).collect()} == plain_divergence(rows, 1, 3)
        assert divergence.divergence(empty).isEmpty()


def test_shares_are_exact(spark):
    """Counts of a corpus of many TB, whose products leave 64 bits."""
    counts = [(0, 5, 3), (10**12, 10**13 + 7, 10**6), (9 * 10**17, 9 * 10**17 + 1, 123_457), (4, 0, 0)]
    df = spark.createDataFrame(counts, "c long, n long, v long").select(divergence.share(F.col("c"), F.col("n"), F.col("v")).alias("p"))
    assert [r["p"] for r in df.collect()] == [1 + 10**9 * (c + 2) // (n + 2 * v) if v else None for c, n, v in counts]


def plain_runs(w):
    n, out = len(w), set()
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            seg = w[s : i + q]
            if len(seg) >= max(6, 4 * q) and not any(seg[r:] == seg[: len(seg) - r] for r in range(1, q)):
                out.add((s, len(seg), q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_refinement_finds_all_runs():
    rng = random.Random(5)
    for _ in range(400):
        docs = []
        for _ in range(rng.randint(1, 5)):
            n, k = rng.randint(0, 60), rng.randint(1, 4)
            w = [rng.randrange(k) for _ in range(n)]
            if rng.random() < 0.6 and n > 8:
                a = rng.randrange(n)
                p = 1 + rng.randrange(max(1, (n - a) // 3))
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            docs.append(w)
        offsets = np.concatenate([[0], np.cumsum([len(w) for w in docs])]).astype(np.int64)
        doc, start, length, period = (v.tolist() for v in runs.runs(np.array([x for w in docs for x in w], np.int64), offsets))
        for i, w in enumerate(docs):
            assert [r[1:] for r in zip(doc, start, length, period, strict=True) if r[0] == i] == plain_runs(w)


def test_refinement_of_long_words():
    for word, want in (([0] * 3000, [(0, 3000, 1)]), ([*range(700)] * 4 + [0, 1], [(0, 2802, 700)]), ([*range(700)] * 3, [])):
        got = runs.runs(np.array(word, np.int64), np.array([0, len(word)]))
        assert [tuple(int(v) for v in r[1:]) for r in zip(*got, strict=True)] == want
    a, b = [0], [0, 1]
    while len(b) < 3000:
        a, b = b, b + a
    got = runs.runs(np.array(b, np.int64), np.array([0, len(b)]))
    assert not len(got[0])  # no fourth powers in a Fibonacci word


def plain_collapse(doc_id, text, plant):
    w = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode())
    if plant and doc_id is not None and h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = plain_runs(w)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(v for i, v in enumerate(w) if i not in gone)))


@pytest.mark.parametrize("plant", [True, False])
def test_periodic_runs(spark, docs, rows, empty, plant):
    short = [r for r in rows if r[0] != 1008]
    got = runs.periodic_runs(docs.where("doc_id is null or doc_id <> 1008"), plant=plant).select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()
    key = lambda r: (r[0] is not None, r[0] or 0)
    want = sorted((plain_collapse(r[0], r[1], plant) for r in short), key=key)
    assert sorted((tuple(r) for r in got), key=key) == want and any(r[1] > 0 for r in want)
    long = runs.periodic_runs(docs.where("doc_id = 1008"), plant=plant).first()
    assert [tuple(r) for r in long["runs"]] == plain_runs(WORD.findall(rows[5][1])) or plant
    assert runs.periodic_runs(empty).isEmpty()


def plain_base(text):
    w = WORD.findall(text or "")
    lines = [line for line in (text or "").split("\n") if WORD.search(line)]
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), failed


def plain_verdict(text):
    raw = (text or "").encode()
    pack = lambda b: len(zstandard.ZstdCompressor(level=bands.LEVEL).compress(b))

    def outside(b):
        _, least, most = next(band for band in bands.BANDS if len(b) < band[0])
        return not least <= len(b) * 1000 // pack(b) <= most

    chunks = [raw[i : i + bands.CHUNK] for i in range(0, len(raw), bands.CHUNK)]
    bad = [c for c in chunks if outside(c)]
    return len(chunks), len(bad), outside(raw), sum(map(len, bad)) * 1000 > bands.SHARE * len(raw)


def test_compression_bands(spark, docs, rows, empty):
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_chunks", "n_bad_chunks", "whole_outside", "chunks_outside", "kept"]

    def want(doc_id, text):
        base, verdict = plain_base(text), plain_verdict(text)
        return (doc_id, *base, *verdict, not (base[-1] or verdict[2] or verdict[3]))

    key = lambda r: (r[0] is not None, r[0] or 0)
    got = sorted((tuple(r) for r in bands.compression_bands(docs).select(*columns).collect()), key=key)
    assert got == sorted((want(r[0], r[1]) for r in rows), key=key)
    assert bands.compression_bands(empty).isEmpty()
    rng = random.Random(4)
    vocabulary = ["".join(rng.choices("aaabcdeeeefghiiiklmnnoooprssttuvz", k=rng.randint(2, 9))) for _ in range(900)]
    prose = lambda n: " ".join(rng.choices(vocabulary, k=n))
    noise = lambda n: "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=n))
    encoded = " ".join(noise(76) for _ in range(200))
    templates = "\n".join(f"order number {n} was sent today and will arrive soon" for n in range(400))
    cases = [(1, prose(40), True), (2, prose(3000), True), (3, encoded, False), (4, templates, False), (5, prose(1500) + " " + encoded, False), (6, prose(3000) + " " + encoded[:300], True), (7, "# $ % " + prose(30), True), (8, "too short", False)]
    got = {r["doc_id"]: r["kept"] for r in bands.compression_bands(spark.createDataFrame([c[:2] for c in cases], "doc_id long, text string")).collect()}
    assert got == {c[0]: c[2] for c in cases}


def test_registered():
    assert {"op11_baseline_correction", "op12_partition_refinement", "op13_compression_bands"} <= set(llm_queries.queries())
