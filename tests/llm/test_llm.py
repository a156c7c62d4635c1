"""The operators against brute force, the libraries, or held-out data, on small tables with odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from dokuma.llm import bpe, common, decontaminate, forest, fst, lines, pitman_yor, resample, sharding, suffix, topk
from dokuma.llm import queries as llm_queries
from dokuma.llm.components import components

RANKS, JSON = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
UP = {i: i + 32 for i in range(65, 91)}
SCHEMA = "doc_id long, text string, source string, _key long, n long"


def words_of(text):
    return [w for w in re.split(r"[\x20\x09-\x0d]+", (text or "").translate(UP)) if w]


@pytest.fixture(scope="module")
def rows():
    """Texts with copies, near copies, shared passages, periodic text, nulls, empties, repeats and one long text."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdeéß", k=rng.randint(1, 6)))
    prose = lambda n: " ".join(word() for _ in range(n))
    base = [prose(rng.randint(20, 120)) for _ in range(12)]
    passage = prose(60)
    out = [(None, "no id at all " * 3), (-5, None), (-4, ""), (-3, " \n\t"), (-2, "a b c"), (-1, "A  b\nC"), (7777, "ab" * 300), (7778, "x" * 1000), (7779, prose(4000))]
    for i in range(140):
        kind, text = rng.random(), rng.choice(base)
        if kind < 0.3:
            w = text.split()
            for _ in range(rng.randint(1, 5)):
                w[rng.randrange(len(w))] = word()
            text = " ".join(w)
        elif kind < 0.5:
            text = prose(30) + "\n" + passage + "\n" + prose(20)
        elif kind < 0.7:
            text = prose(rng.randint(0, 80))
        out.append((i * 3, text))
    return [*out, out[10], out[10]]  # one row comes three times


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(d, t, "s", 1, 2) for d, t in rows], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


def test_shards(spark, docs, empty, rows):
    got = sharding.shard_documents(docs, 5).collect()
    assert len(got) == len(rows)
    total, load = sum(r["size"] for r in got), Counter()
    for r in got:
        load[r["shard"]] += r["size"]
    assert set(load) <= set(range(5)) and max(load.values()) - min(load.values()) <= 2 * max(r["size"] for r in got) and total == sum(load.values())
    for s in load:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    texts = Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == texts
    assert sharding.shard_documents(empty, 5).count() == 0
    hot = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "one hot text").otherwise(F.concat(F.lit("text "), F.col("id"))).alias("text"))
    load = [r["b"] for r in sharding.shard_documents(hot, 10).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(load) == 10 and max(load) < 1.03 * min(load)


def test_written_shards(spark, odd, tmp_path):
    """Every record once, null and repeated ids included, in the order of its slot, with all its columns."""
    sharding.write_shards(odd, str(tmp_path / "out"), 3, rows_per_file=2)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert Counter(tuple(r)[: len(odd.columns)] for r in back.select(*odd.columns).collect()) == Counter(map(tuple, odd.collect()))
    for r in back.groupBy("shard").agg(F.sort_array(F.collect_list("slot")).alias("s")).collect():
        assert r["s"] == list(range(len(r["s"])))
    with pytest.raises(ValueError):
        sharding.write_shards(odd.withColumn("Slot", F.lit(1)), str(tmp_path / "no"), 3)
    named = sharding.shard(odd, F.xxhash64("text"), F.col("doc_id"), F.lit(1), 4)
    assert named.columns == [*odd.columns, "shard", "slot"] and Counter(tuple(r)[: len(odd.columns)] for r in named.collect()) == Counter(map(tuple, odd.collect()))


def test_near_duplicates_with_odd_ids_and_names(spark, odd):
    before = odd.collect()
    got = forest.near_duplicates(odd).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r["doc_id"] for r in before)
    linked = [r for r in got if r["n_shingles"] and r["component_id"] is None]
    assert {r["doc_id"] for r in linked} == {2**62, -(2**62), 5, 9, None, 2**63 - 1, -(2**63)} and len(linked) == 11
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    pairs = spark.createDataFrame([(5, "a b c d e f g h i j k l m n"), (5, "a b c d e f g h i j k l m n o"), (9, "a b c d e f g h i j k l m n o p")], "doc_id long, text string")
    assert sorted(tuple(r) for r in forest.near_duplicates(pairs).collect()) == [(5, 10, 5, True), (5, 11, 5, True), (9, 12, 5, False)]
    kept = forest.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    rows = kept.collect()
    assert not set(map(tuple, rows)) - set(map(tuple, before)) and sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows) == [(False, 5), (False, 7), (False, 7), (True, 0)]
    bench = spark.createDataFrame([(1, next(r["text"] for r in before if r["doc_id"] == 9))], "item_id long, text string")
    clean = decontaminate.drop_leaks(odd, bench).collect()
    assert sorted((r["doc_id"], r["text"] is None) for r in clean) == [(5, False), (7, False), (7, True)] and not set(map(tuple, clean)) - set(map(tuple, before))
    marks = spark.createDataFrame([(5, 1, 0)], "doc_id long, quality int, toxic int")
    assert Counter(map(tuple, resample.keep_quality(odd, marks).collect())) == Counter(map(tuple, before))


def test_hubs_are_spread(spark):
    star = [(0, i) for i in range(1, 400)] + [(i, 1000 + i) for i in range(1, 400, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(star, "a long, b long").repartition(4), held=20).collect()}
    assert set(got.values()) == {0} and len(got) == 400 + len(range(1, 400, 7))


WIDE = rb"(?<=\xe3\x80\x82)|(?<=\xef\xbc\x81)|(?<=\xef\xbc\x9f)"


def units_of(text, sentences):
    """(start, end, words, normal form) of each unit, word by word."""
    found, before = [], None
    for m in re.finditer(rb"[^\x20\x09-\x0d]+", text):
        at = m.start()
        for piece in filter(None, re.split(WIDE, m[0]) if sentences else [m[0]]):
            ended = before is not None and sentences and re.search(rb"([.!?][\"')\]}]{0,2}|\xe3\x80\x82|\xef\xbc[\x81\x9f])$", before)
            if before is None or ended or b"\n" in text[found[-1][1] : at]:
                found.append([at, at, 0, []])
            found[-1][1] = at + len(piece)
            found[-1][2] += -(-len(piece) // lines.WORD_BYTES)
            found[-1][3].append(piece.lower())
            before, at = piece, at + len(piece)
    starts = [0, *(u[0] for u in found[1:]), len(text)]
    return [(starts[k], starts[k + 1], n, tuple(w)) for k, (_, _, n, w) in enumerate(found)]


def lines_of(rows, least_run, sentences):
    seen, out = set(), {}
    tie = lambda r: (r[0] is not None, r[0] or 0)
    for d, t in sorted(set(rows), key=tie):
        text, runs = (t or "").encode(), []
        for a, b, n, w in units_of(text, sentences):
            if w in seen:
                runs = [*runs[:-1], (runs[-1][0], b, runs[-1][2] + n)] if runs and runs[-1][1] == a else [*runs, (a, b, n)]
            seen.add(w)
        spans = [(a, b) for a, b, n in runs if n >= least_run]
        kept = b"".join(text[x:y] for x, y in zip([0, *(b for _, b in spans)], [*(a for a, _ in spans), len(text)], strict=True))
        out[d] = (len(text), sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept).hexdigest(), spans)
    return out


@pytest.mark.parametrize(("least_run", "sentences"), [(30, True), (3, True), (1, False)])
def test_line_dedup(spark, docs, empty, rows, least_run, sentences):
    rng = random.Random(31)
    say = [" ".join(rng.choices(["ab", "cd", "Efg", "日本語", "longerthantwelvebytes"], k=rng.randint(1, 12))) + rng.choice([".", "!", '."', "。", "", "...)"]) for _ in range(25)]
    more = [(100_000 + i, "".join(rng.choice(say) + rng.choice([" ", "  ", "\n", "\n\n", ""]) for _ in range(rng.randint(0, 12)))) for i in range(120)]
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    got = {d: (*v[:4], [tuple(s) for s in v[4]]) for d, v in by_id(lines.line_dedup(both, least_run, sentences), "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed").items()}
    assert got == lines_of([*rows, *more], least_run, sentences)
    # whatever stays because its run is short is listed all the same
    every = by_id(lines.line_dedup(both, least_run, sentences), "repeated", "n_repeated")
    wanted = {d: [tuple(x) for x in v[4]] for d, v in lines_of([*rows, *more], 1, sentences).items()}
    assert {d: [tuple(x) for x in v[0]] for d, v in every.items()} == wanted and all(n == sum(b - a for a, b in v) for v, n in every.values())
    assert lines.line_dedup(empty).count() == 0


def test_registered_line_dedup(spark, tmp_path):
    """Copied paragraphs go wherever lines are broken; stock phrases and single repeated lines stay."""
    rng = random.Random(32)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    sentence = lambda n: " ".join(word() for _ in range(n)) + "."
    passage = [sentence(9) for _ in range(6)]
    text = ["\n".join([sentence(8), " ".join(passage), sentence(7)]), sentence(5) + " " + " ".join(passage) + " " + sentence(6), "About us\nHome\n" + sentence(12), "About us\nHome\n" + passage[0] + "\n" + sentence(9)]
    spark.createDataFrame(list(enumerate(text)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = by_id(llm_queries.op4_line_hashing(spark, str(tmp_path)), "n_removed")
    assert {d: n for d, (n,) in got.items()} == {0: 0, 1: len(" ".join(passage)) + 1, 2: 0, 3: 0}


def repeats(rows, least=100):
    seen, out = set(), {}
    for d, t in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        text = (t or "").encode()
        gone = bytearray(len(text))
        for s in range(len(text) - least + 1):
            if text[s : s + least] in seen:
                gone[s : s + least] = b"\1" * least
            seen.add(text[s : s + least])
        kept = bytes(b for b, g in zip(text, gone, strict=True) if not g)
        out[d] = (len(text), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("crowd", [2000, 3])
def test_suffix_dedup(docs, empty, rows, crowd):
    got = by_id(suffix.removal_digests(docs, crowd=crowd), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == repeats(rows)
    assert suffix.removal_digests(empty).count() == 0


def test_different_minimizers_do_not_meet(spark):
    """Texts that share no 32 bytes ask for none to be compared, however many there are."""
    rng = random.Random(77)
    docs = spark.createDataFrame([(d, "".join(rng.choices("abcdefghijklmnopqrstuvwxyz012345", k=2000))) for d in range(1500)], "doc_id long, text string")
    asked = []

    def find(keyed, fetched):
        return suffix.repeated_spans(keyed, lambda rows: asked.append(rows.count()) or fetched(rows))

    suffix.with_spans(docs, find)
    assert asked == [0]


@pytest.fixture(scope="module")
def odd(spark):
    """Ids at the ends of the range, null ids, one id with several texts, columns whose names clash with ours."""
    rng = random.Random(41)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    base = " ".join(word() for _ in range(60))
    rows = [(d, base + f" {k} {word()}") for k, d in enumerate([2**62, -(2**62), 5, 5, 9, None, None, 2**63 - 1, -(2**63)])] + [(5, " ".join(word() for _ in range(60))), (7, None), (7, "")]
    rows += [rows[2], rows[5]]
    extra = "_key long, key long, tie long, spans long, _size long, _doc long, _row long, row long, node long, n long, _root long"
    table = [(d, t, *(100 * i + k for k in range(11))) for i, (d, t) in enumerate(rows)]
    return spark.createDataFrame(table, "doc_id long, text string, " + extra).repartition(3)


def others(rows):
    return Counter((r["doc_id"], *r[2:]) for r in rows)


def test_suffix_with_odd_ids_and_names(spark, docs, odd, rows):
    out = suffix.remove_repeats(docs)
    assert out.columns == docs.columns and out.count() == len(rows)
    mixed = spark.createDataFrame([(1, "p" * 150 + "q"), (1, "r" * 150), (2, "q" + "p" * 150), (None, "r" * 120)], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_removed"]) for r in suffix.removal_digests(mixed).collect())
    assert [g[0] for g in got] == [0, 1, 1, 2] and got[0][2] == 119 and got[3][2] == 150
    before, after = odd.collect(), suffix.remove_repeats(odd)
    assert after.columns == odd.columns and others(after.collect()) == others(before)
    # a null id is the least, and of the other ids the smallest: only the first of these texts stays whole
    digests = suffix.removal_digests(odd).collect()
    assert Counter(r["doc_id"] for r in digests) == Counter(r["doc_id"] for r in before)
    whole = [r for r in digests if r["n_bytes"] > 300 and r["n_removed"] == 0]
    assert {r["doc_id"] for r in whole} == {None, 5} and len({r["kept_sha256"] for r in whole}) == 2
    by_line = lines.line_dedup(odd).collect()
    assert Counter((r["doc_id"], r["n_bytes"]) for r in by_line) == Counter((r["doc_id"], len((r["text"] or "").encode())) for r in before)


def test_expansion_groups_equal_strings():
    rng = random.Random(3)
    body = bytes(rng.choices(b"ab", k=400)) + b"a" * 100 + bytes(rng.choices(b"abc", k=300))
    text = np.concatenate([np.frombuffer(body, np.uint8).astype(np.uint16) + 2, [1, 0]])
    for least in (8, 20):
        order, apart = suffix.expand(text, least)
        group = np.cumsum(apart)
        strings = {}
        for row, at in enumerate(order):
            if at + least <= len(body):
                strings.setdefault(group[row], set()).add(body[at : at + least])
        assert all(len(s) == 1 for s in strings.values()) and len(strings) == len({body[i : i + least] for i in range(len(body) - least + 1)})


def near(rows):
    sets = {}
    for d, t in set(rows):
        w = words_of(t)
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    order = sorted(sets, key=lambda d: (d is not None, d or 0))
    root = {d: d for d in order}
    for i, a in enumerate(order):
        for b in order[i + 1 :]:
            common_ = len(sets[a] & sets[b])
            if common_ and 100 * common_ >= 75 * len(sets[a] | sets[b]):
                x, y = (next_root(root, d) for d in (a, b))
                lo, hi = (x, y) if order.index(x) < order.index(y) else (y, x)
                root[hi] = lo
    return {d: (len(sets[d]), next_root(root, d), next_root(root, d) == d) for d in order}


def next_root(root, d):
    while root[d] != d:
        d = root[d]
    return d


def test_near_duplicates(docs, empty, rows):
    expected = near(rows)
    assert sum(not kept for _, _, kept in expected.values()) > 20
    assert by_id(forest.near_duplicates(docs), "n_shingles", "component_id", "kept") == expected
    assert forest.near_duplicates(empty).count() == 0
    kept = forest.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(d for d, (_, _, k) in expected.items() if k)


def test_near_duplicates_in_a_crowd(spark):
    """Boilerplate puts hundreds of texts just under the threshold to each other and hides the partners."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    boilerplate, crowd, expected = [word() for _ in range(160)], [], {}
    for i in range(1200):
        own = [word() for _ in range(29)]
        crowd.append((i, " ".join(boilerplate + own)))  # 156 of 214 shingles in common with the others
        expected[i] = (185, i, True)
        if i % 30 == 0:  # 160 of 210 in common with the partner
            crowd.append((9000 - i, " ".join(boilerplate + own[:4] + [word() for _ in range(25)])))
            expected[9000 - i] = (185, i, False)
    got = forest.near_duplicates(spark.createDataFrame(crowd, "doc_id long, text string").repartition(4))
    assert by_id(got, "n_shingles", "component_id", "kept") == expected


def test_neighbours_across_tasks(spark):
    rows = [(bytes([0]) + b"\1" * 32, i, b"s" * 32) for i in range(9)]
    orders = spark.createDataFrame(rows, "v binary, key long, sketch binary")
    assert {(r["a"], r["b"]) for r in forest._neighbours(orders).collect()} == {(i, j) for i in range(9) for j in range(i + 1, 9)}


def test_common_counts():
    rng = np.random.default_rng(22)
    x, y = ([np.unique(rng.integers(0, 9000, rng.integers(1, 6000))) for _ in range(n)] for n in (7, 5))
    assert forest.common_counts(x, y).tolist() == [[len(np.intersect1d(a, b)) for b in y] for a in x]


def test_components(spark):
    rng = random.Random(2)
    path = [(i, i + 1) for i in range(200)] + [(1000 + i, 1000 + rng.randrange(i)) for i in range(1, 60)] + [(5000, 5000), (6001, 6000), (6000, 6001)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(path, "a long, b long").repartition(4)).collect()}
    assert got == {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(60)} | {6000: 6000, 6001: 6000}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


ODD = ["", "a", " ", "  \n\n", "it's we'll've 'rex", "''s x's's", " 's\t's\n'll", "<|endoftext|>", "a<|endoftext|> b<|endoft", "12٣é　 x😀日本.,!?", "a" * 500, " " * 300, "Hello  world\r\n\r\n  end "]


def test_bpe_encodes_as_the_library(spark, docs, rows):
    import tiktoken

    rng = random.Random(1)
    alphabet = [*"ab sst'  \n\t'redlvm12é 　😀.,!", "'ll", "'ve", "ing"]
    many = ODD + ["".join(rng.choices(alphabet, k=rng.randint(0, 40))) for _ in range(3000)] + [t for _, t in rows]
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    c = bpe.codec(RANKS)
    offsets, data = common.texts(pa.array(many, pa.string()))
    ids, at = c.encode(data, offsets)
    raw, places = c.decode(ids)
    for i, text in enumerate(many):
        own = ids[at[i] : at[i + 1]].tolist()
        assert own == library.encode_ordinary(text or "")
        assert raw[places[at[i]] : places[at[i + 1]]].tobytes() == (text or "").encode()
    expected = {d: (len(x := library.encode_ordinary(t or "")), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for d, t in rows}
    assert by_id(bpe.encode_column(docs, RANKS), "n_tokens", "ids_sha256", "decoded_sha256") == expected
    assert bpe.encode_column(docs.limit(0), RANKS).count() == 0
    back = bpe.decode_ids(bpe.encode_ids(docs, RANKS), RANKS)
    assert {r["doc_id"]: bytes(r["bytes"]) for r in back.collect()} == {d: (t or "").encode() for d, t in rows}


def test_very_long_text_is_cut_safely(spark):
    text = "some words and numbers 123 it's " * 150_000
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    from tokenizers import Tokenizer

    n = sum(len(Tokenizer.from_file(JSON).encode(text[:3200], add_special_tokens=False).ids) for _ in range(1)) * 1500
    assert bpe.encode_column(df, RANKS).first()["n_tokens"] == fst.count_tokens(df, JSON).first()["n_tokens"]
    assert abs(fst.count_tokens(df, JSON).first()["n_tokens"] - n) <= 1500


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(3).integers(0, 2**63, 5000, dtype=np.uint64))
    assert sorted(bpe.PerfectHash(keys)(keys)) == list(range(len(keys)))


def test_transducer_counts(docs, empty, rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(JSON)
    rng = random.Random(4)
    alphabet = [*"ab sst'  \n\t'redlvm12é 　😀.,!", "'ll", "<|endoftext|>"]
    many = ODD + ["".join(rng.choices(alphabet, k=rng.randint(0, 700))) for _ in range(300)]
    offsets, data = common.texts(pa.array(many))
    assert fst.tokenizer(JSON).count(data, offsets).tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in many]
    expected = {d: (len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 1024) for d, t in rows}
    assert by_id(fst.count_tokens(docs, JSON), "n_bytes", "n_tokens", "over_limit") == expected
    assert fst.count_tokens(empty, JSON).count() == 0


def test_segmenter_chunks_agree():
    rng = np.random.default_rng(5)
    symbols = rng.choice(np.arange(12, dtype=np.int8), 5000, p=[0.2, 0.05, 0.2, 0.05, 0.1, 0.15, 0.08, 0.05, 0.03, 0.04, 0.04, 0.01])
    state, codes = fst.START, []
    for s in symbols:
        codes.append(fst.OUT[state, s])
        state = fst.TO[state, s]
    assert fst.run_segmenter(symbols).tolist() == codes


def test_top_k(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=12).tolist()) for i in range(300)] + [(400, None), (420, [1.0, None]), (440, [float("nan")] * 12), (460, [0.5] * 3), (480, []), (5, rows_ := [0.1] * 12), (500, rows_), (None, rows_), (520, rows_)]
    df = spark.createDataFrame([(i, v, 9) for i, v in rows], "vec_id long, embedding array<double>, label int").repartition(6)
    got = {}
    for r in topk.top_k(df, "vec_id", "embedding", F.col("vec_id") % 20 == 0, 20, query_block=7, row_block=50).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    good = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    for q, v in good:
        if q % 20 == 0:
            scored = sorted(((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in good if i != q))[:20]
            assert sorted(got[q]) == [(n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    assert len(got) == sum(i % 20 == 0 for i, _ in good)
    assert topk.top_k(df.limit(0), "vec_id", "embedding", F.col("vec_id") % 20 == 0, 20).count() == 0


def test_top_k_with_norms_that_differ(spark):
    """Blocks by falling norm, floors shared between them, sums beyond 2^53, and components that leave 64 bits."""
    rng = np.random.default_rng(16)
    for scale in (1.0, 1e7):
        rows = [(i, (rng.normal(size=24) * scale * 10 ** (-2 * rng.random())).tolist()) for i in range(900)]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
        got = {}
        for r in topk.top_k(df, "vec_id", "embedding", F.col("vec_id") % 20 == 0, 7, query_block=16, row_block=60).collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
        whole = [(i, [math.floor(64 * x) for x in v]) for i, v in rows]
        for q, v in whole[::20]:
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in whole if i != q)[:7]
            assert sorted(got[q]) == [(n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    # a vector that leaves 64 bits takes no part; scores that do are the nearest that do not
    least, most = -(2**63), 2**63 - 1
    vectors = {0: [1e18], 1: [1.0], 20: [1e16, 3.0], 2: [1e16, -1.0], 3: [-1e16, 5.0], 4: [1e11, 1.0], 5: [2e9, 7.0], 40: [-(2.0**57), 1e5], 6: [2.0**57], 7: [float("inf")]}
    large = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")
    whole = {i: [math.floor(64 * x) for x in v] for i, v in vectors.items() if i not in (0, 6, 7)}
    got = defaultdict(list)
    for r in topk.top_k(large, "vec_id", "embedding", F.col("vec_id") % 20 == 0, 20, row_block=2).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    for q in (20, 40):
        scores = sorted((-min(max(sum(x * y for x, y in zip(whole[q], v, strict=False)), least), most), i) for i, v in whole.items() if i != q)
        assert sorted(got[q]) == [(n, i, -s) for n, (s, i) in enumerate(scores, 1)]
    assert set(got) == {20, 40}


def test_language_model(docs, empty, rows):
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    toks = [(d, [*words_of(t), None]) for d, t in rows]
    counts = Counter(w for d, ws in toks if not held(d) for w in ws)
    n, v = sum(counts.values()), len(counts)
    expected = Counter((d, held(d), len(ws), sum(counts[w] > 0 for w in ws), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), 5)) for d, ws in toks)
    got = pitman_yor.score(docs, pitman_yor.held_out_rows(F.col("doc_id"))).collect()
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in got) == expected
    total = {h: [sum(r[c] for r in got if r["held_out"] == h) for c in ("score", "base_score")] for h in (True, False)}
    assert all(model > base for model, base in total.values())
    assert pitman_yor.score(empty, pitman_yor.held_out_rows(F.col("doc_id"))).count() == 0


def seated_by_hand(train, asked, sweeps, burn, rng):
    """Mean predictive probabilities of (context, word) pairs under one customer at a time being taken away and
    seated again: restaurants as lists of table sizes."""
    pairs = Counter(train)
    ratio = lambda c: (lambda a, b: min(max(a / (a + 2 * b), 0.05), 0.95) if a and b else 0.5)(sum(x == 1 for x in c), sum(x == 2 for x in c))
    d, root_d = ratio(pairs.values()), ratio(Counter(w for _, w in pairs).values())
    types = len({w for _, w in train})
    own, root = {}, {w: [] for _, w in train}

    def parent(w):
        tables = root.get(w, [])
        total, n = sum(len(x) for x in root.values()), sum(sum(x) for x in root.values())
        return (sum(tables) - root_d * len(tables) + (pitman_yor.ROOT_STRENGTH + root_d * total) / (types + 1)) / (pitman_yor.ROOT_STRENGTH + n)

    def predict(u, w):
        here = own.get(u, {})
        tables, total, n = here.get(w, []), sum(len(x) for x in here.values()), sum(sum(x) for x in here.values())
        return (sum(tables) - d * len(tables) + (pitman_yor.STRENGTH + d * total) * parent(w)) / (pitman_yor.STRENGTH + n)

    def sit(tables, discount, fresh):
        at = rng.choices(range(len(tables) + 1), [x - discount for x in tables] + [fresh])[0]
        if at < len(tables):
            tables[at] += 1
            return False
        tables.append(1)
        return True

    def leave(tables):
        at = rng.choices(range(len(tables)), tables)[0]
        tables[at] -= 1
        if tables[at]:
            return False
        del tables[at]
        return True

    def add(u, w):
        here = own.setdefault(u, {})
        if sit(here.setdefault(w, []), d, (pitman_yor.STRENGTH + d * sum(len(x) for x in here.values())) * parent(w)):
            total = sum(len(x) for x in root.values())
            sit(root[w], root_d, (pitman_yor.ROOT_STRENGTH + root_d * total) / (types + 1))

    for u, w in train:
        add(u, w)
    out = Counter()
    for sweep in range(sweeps):
        for u, w in train:
            if leave(own[u][w]):
                leave(root[w])
            add(u, w)
        if sweep >= burn:
            for pair in asked:
                out[pair] += predict(*pair) / (sweeps - burn)
    return out


def test_language_model_against_seating_by_hand(spark):
    """The parallel sweeps give the scores of a sampler that moves one customer at a time, up to its noise."""
    rng = random.Random(14)
    rows = [(i, " ".join(rng.choices("abcdefghijkl", [9, 7, 5, 4, 3, 2, 2, 1, 1, 1, 1, 1], k=rng.randint(5, 25)))) for i in range(60)]
    held = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    pairs = {d: list(zip(["<", *t.split()], [*t.split(), ">"], strict=True)) for d, t in rows}
    p = seated_by_hand([x for d, ps in pairs.items() if not held(d) for x in ps], {x for ps in pairs.values() for x in ps}, 60, 20, rng)
    got = by_id(pitman_yor.score(spark.createDataFrame(rows, "doc_id long, text string"), pitman_yor.held_out_rows(F.col("doc_id"))), "score", "n_tokens")
    gaps = [(got[d][0] - sum(math.log10(p[x]) for x in ps)) / got[d][1] for d, ps in pairs.items()]
    assert max(map(abs, gaps)) < 0.05 and abs(sum(gaps) / len(gaps)) < 0.01


@pytest.mark.parametrize("mass", [None, 5000.0])
@pytest.mark.parametrize("d", [0.3, 0.7, 0.95])
def test_seats_are_the_conditional_at_any_count(d, mass):
    """Mean and deviation of the tables against the whole conditional, from the recurrence of the Stirling numbers."""
    wanted = {25, 50, 100, 512, 513, 1000, 2000}
    s, tables = np.full(2001, -np.inf), {}
    s[0] = 0.0
    for c in range(1, 2001):
        t, new = np.arange(1, c + 1), np.full(2001, -np.inf)
        with np.errstate(divide="ignore"):
            new[1 : c + 1] = np.logaddexp(s[:c], np.log(np.maximum(c - 1 - d * t, 0)) + s[1 : c + 1])
        s = new
        if c in wanted:
            tables[c] = s[1 : c + 1]
    rng, n = np.random.default_rng(21), 4000
    for c, base, rest in ((25, 0.05, 100), (50, 0.05, 100), (50, 0.3, 0), (100, 0.001, 10_000), (512, 0.05, 100), (513, 0.05, 100), (1000, 0.01, 1000), (1000, 1e-6, 10**6), (2000, 0.2, 5000), (2000, 0.001, 0)):
        k = np.arange(c)
        base_k = np.log(base) if mass is None else np.log((base * mass + k) / (mass + k))
        w = np.cumsum(np.log(2.0 + d * (rest + k)) + base_k) + tables[c]
        p = np.exp(w - w.max())
        p /= p.sum()
        mean = (p * (k + 1)).sum()
        spread = math.sqrt(max((p * (k + 1.0) ** 2).sum() - mean**2, 0))
        one = np.ones(n, np.int64)
        got = pitman_yor.seat(c * one, one, one + rest, np.full(n, base), d, 2.0, rng, None if mass is None else np.full(n, mass))
        assert abs(got.mean() - mean) < 4.5 * spread / math.sqrt(n) + 0.002 * mean
        assert abs(got.std() - spread) < 0.1 * spread + 0.05


def test_predictive_sums_to_one():
    rng = np.random.default_rng(8)
    context, word = rng.integers(0, 5, 300), rng.integers(0, 20, 300)
    pairs, count = np.unique(np.stack([context, word], 1), axis=0, return_counts=True)
    t = pitman_yor.seat(count, np.ones(len(count), np.int64), np.bincount(pairs[:, 0])[pairs[:, 0]], np.full(len(count), 0.05), 0.5, 1.0, rng)
    assert (t >= 1).all() and (t <= count).all()
    c0, t0 = np.bincount(pairs[:, 1], weights=t, minlength=20), np.ones(20)
    customers, tables = (np.bincount(pairs[:, 0], weights=x, minlength=5) for x in (count, t))
    root = pitman_yor.root_chance(c0, t0, c0.sum(), 20.0, 20, 0.5)
    unseen = pitman_yor.root_chance(np.zeros(1), np.zeros(1), c0.sum(), 20.0, 20, 0.5)
    assert abs(root.sum() + unseen[0] - 1) < 1e-9
    for u in range(5):
        own = pairs[:, 0] == u
        c, k = np.zeros(20), np.zeros(20)
        c[pairs[own, 1]], k[pairs[own, 1]] = count[own], t[own]
        p = pitman_yor.chance(c, k, customers[u], tables[u], root, 0.5).sum() + pitman_yor.chance(np.zeros(1), np.zeros(1), customers[u], tables[u], unseen, 0.5)[0]
        assert abs(p - 1) < 1e-9


def smith_waterman(a, b):
    h, best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)], 0
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (1 if x == y else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
            best = max(best, h[i][j])
    return best


def test_alignment():
    rng = np.random.default_rng(9)
    pairs = [(rng.integers(2, 6, rng.integers(1, 20)).astype(np.uint64), rng.integers(2, 6, rng.integers(1, 30)).astype(np.uint64)) for _ in range(150)]
    assert decontaminate.align([a for a, _ in pairs], [b for _, b in pairs])[0].tolist() == [smith_waterman(a, b) for a, b in pairs]


def test_leaks(spark, empty):
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    items = {i: [word() for _ in range(30)] for i in range(20)}
    rows, expected = [(-1, None), (-2, "")], set()
    for d in range(120):
        w = [word() for _ in range(60)]
        if d % 3 == 0:
            item = list(items[d % 20])
            for _ in range(d % 7):  # edited copies
                k = rng.randrange(len(item))
                item[k : k + 1] = rng.choice([[], [word()], [item[k], word()]])
            w[20:20] = item
            expected.add((d, d % 20))
        rows.append((d, ", ".join(w).upper() if d % 2 else " ".join(w)))
    bench = spark.createDataFrame([(i, " ".join(w), 0) for i, w in items.items()] + [(99, None, 0), (98, "a b", 0), (None, "x", 0)], "item_id long, text string, doc_id int")
    docs = spark.createDataFrame([(d, t, 0) for d, t in [*rows, rows[2]]], "doc_id long, text string, item_id int").repartition(4)
    found = decontaminate.leaks(docs, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == expected and len(found) == len(expected)
    assert {r["doc_id"] for r in decontaminate.drop_leaks(docs, bench).collect()} == {d for d, _ in rows} - {d for d, _ in expected}
    assert decontaminate.leaks(empty, bench).count() == 0 and decontaminate.leaks(docs, bench.limit(0)).count() == 0


def test_leaks_of_excerpts_and_heavy_edits(spark):
    rng = random.Random(23)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    item = [word() for _ in range(400)]
    edited = lambda w, n: [word() if k % 10 in range(10 - n, 10) else x for k, x in enumerate(w)]
    passages = [item[100:290], item[50:79], item[7:20], edited(item, 3), edited(item[:60], 4), item, item[30:36]]
    rows = [(d, " ".join([word() for _ in range(50)] + p + [word() for _ in range(50)])) for d, p in enumerate(passages)]
    found = decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()
    assert {r["doc_id"] for r in found} == {0, 1, 2, 3, 4, 5}  # six words are no excerpt


def test_resampling(spark, empty):
    rng = random.Random(13)
    plain = [f"w{i}" for i in range(400)]
    rows, labels, truth = [(None, "w1 w2"), (-1, None), (-2, "")], [], {}
    for d in range(1500):
        w = rng.choices(plain, k=60)
        kind = d % 5
        if kind == 3:
            w[rng.randrange(60)] = "vilehorrid"
            w[rng.randrange(60)] = "nastyword"
        if kind == 4:
            w = [rng.choice(plain)] * 60
        truth[d] = kind < 3
        rows.append((d, " ".join(w)))
        if d % 2:
            labels.append((d, int(kind != 4), int(kind == 3)))
    docs = spark.createDataFrame([(d, t, 5) for d, t in rows], "doc_id long, text string, quality int").repartition(3)
    marks = spark.createDataFrame([*labels, (None, 1, 0), (5, None, None), (10**9, 1, 1)], "doc_id long, quality int, toxic int")
    got = by_id(resample.resample(docs, marks), "kept")
    fresh = [d for d in truth if d % 2 == 0]
    assert sum(got[d][0] == truth[d] for d in fresh) >= 0.97 * len(fresh)
    assert len(got) == len(rows)
    assert resample.resample(empty, marks).count() == 0
    assert all(v[0] for v in by_id(resample.resample(docs, marks.limit(0)), "kept").values())
    assert resample.keep_quality(docs, marks).columns == docs.columns


def test_kth_largest(spark):
    rng = random.Random(14)
    values = [rng.choice([rng.gauss(0, 1), 0.5, 100.0]) for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for k in (1, 7, 1500, 3000):
        assert resample._kth(df, "v", k) == sorted(values, reverse=True)[k - 1]


def test_pipeline_stages(spark, rows, tmp_path):
    """Each stage on its predecessor's rows, against brute force on those very rows."""
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows if d is not None], "doc_id long, text string, lang string, source string, n_chars long")
    item = " ".join(next(t for d, t in rows if d == 7779).split()[100:140])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(d, 1, 0) for d in range(0, 60, 3)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    names, before = [n for n, _ in corpus_pipeline.STAGES], spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert names == ["quality", "near_dedup", "suffix_dedup", "decontamination", "encoding"]
    kept = {}
    for name, step in corpus_pipeline.STAGES:
        step(spark, before, str(tmp_path)).write.parquet(str(tmp_path / name))
        before = spark.read.parquet(str(tmp_path / name))
        kept[name] = before.collect()
        assert name == "encoding" or before.columns == docs.columns
    assert Counter(r["doc_id"] for r in kept["quality"]) == Counter(d for d, _ in rows if d is not None)  # no row is labelled low
    unique = [(r["doc_id"], r["text"]) for r in kept["near_dedup"]]
    expected = near([(r["doc_id"], r["text"]) for r in kept["quality"]])
    assert sorted(d for d, _ in unique) == sorted(d for d, v in expected.items() if v[2])
    gone = repeats(unique)
    for r in kept["suffix_dedup"]:
        n, removed, _, digest = gone[r["doc_id"]]
        text = (r["text"] or "").encode()
        assert removed <= n and n - removed <= len(text) <= n - removed + 6 * gone[r["doc_id"]][2]
        if len(text) == n - removed:
            assert hashlib.sha256(text).hexdigest() == digest
        assert r["text"] is None or r["n_chars"] == len(r["text"])
    assert {r["doc_id"] for r in kept["decontamination"]} == {r["doc_id"] for r in kept["suffix_dedup"]} - {7779}
    assert {r["doc_id"]: r["decoded_sha256"] for r in kept["encoding"]} == {r["doc_id"]: hashlib.sha256((r["text"] or "").encode()).hexdigest() for r in kept["decontamination"]}
