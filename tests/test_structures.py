"""Table functions, token files, blocks settled by ranges, the stateful stream, scans and sparse gradients."""

import random

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from dokuma.functions import tables, turkish
from dokuma.operators import bpe, bpe_train, corpus, lexicon, morphology, tensor, tiles, tokens
from dokuma.sources import tokenfiles
from dokuma.streaming import shards

TEXTS = [(1, "Ev, ev.\n\nx"), (2, None), (3, ""), (4, "ğ" * 70 + " 1\n\n\n" + "ab" * 60 + "!"), (4, "Ev, ev.\n\nx")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(d, t, 7) for d, t in TEXTS], "doc_id long, text string, pos int")


def test_document_tokens(spark, docs):
    def rows(kind):
        return [tuple(r)[1:] for r in tables.document_tokens(docs.where("doc_id = 4").coalesce(1), kind).collect()]

    long, short = TEXTS[3][1], TEXTS[4][1]
    for kind, cut in (("words", lambda t: [w for w in t.replace("\n", " ").split(" ") if w]), ("bytes", lambda t: list(t.encode())), ("pieces", tokens.segments)):
        assert [r[:2] for r in rows(kind)] == [*enumerate(cut(long)), *enumerate(cut(short))]
    assert [r[1:] for r in rows("runs")][-5:] == [("Ev", True), (", ", False), ("ev", True), (".\n\n", False), ("x", True)]
    assert all(p is None or len(p.encode()) <= 100 for _, p, _ in rows("pieces")) and (3, None, False) in rows("pieces")
    assert tables.document_tokens(docs.where("doc_id in (2, 3)")).isEmpty() and tables.document_tokens(docs.limit(0)).isEmpty()
    name = tables.register_document_tokens(spark)
    cut = spark.sql(f"SELECT token FROM {name}('aaaaaaaaaa', kind => 'pieces', longest => 4)")
    assert [r[0] for r in cut.collect()] == ["aaaa", "aaaa", "aa"]
    for wrong in ("'a', kind => 'letters'", "1", "'a', kind => 'pieces', longest => 2"):
        with pytest.raises(AnalysisException, match="document_tokens"):
            spark.sql(f"SELECT * FROM {name}({wrong})")


def test_token_ids(spark, docs):
    vocabulary = tokens.Vocabulary(bpe.Merges(bpe.train_local([("ev", 9), ("abab", 5)], 4)))
    known, counts = frozenset({"ev"}), {"ev": 3}
    name = tables.register_token_ids(spark, vocabulary, known, counts)
    got = spark.sql(f"SELECT d.doc_id, t.pos, t.token FROM {{docs}} d, LATERAL {name}(d.text) t", docs=docs.where("doc_id = 1"))
    assert [r["token"] for r in got.orderBy("pos").collect()] == vocabulary.encode(TEXTS[0][1], known, counts)


def test_token_files(spark, tmp_path):
    rows = spark.range(300_000).select(F.lit("a/b").alias("corpus"), F.col("id").alias("pos"), (F.col("id") * 14317 % 4_294_967_296).alias("token"))
    path = str(tmp_path / "t")
    tokenfiles.write_tokens(rows, path, 70_000)
    files = sorted(f.name for f in (tmp_path / "t").rglob("*") if f.is_file())
    assert files == [f"tokens-{n * 70_000:018d}.bin" for n in range(5)]
    for split, path_ in ((100_000, path), (1 << 30, f"file://{path}")):
        back = tokenfiles.read_tokens(spark, path_, split_bytes=split)
        assert back.count() == 300_000 and back.where("token <> pos * 14317 % 4294967296 or corpus <> 'a/b'").isEmpty()
    assert tokenfiles.read_tokens(spark, path, split_bytes=100_000).rdd.getNumPartitions() == 12
    some = tokenfiles.read_tokens(spark, path, first=65_000, until=145_001)
    assert some.agg(F.min("pos"), F.max("pos"), F.count("*")).first() == (65_000, 145_000, 80_001)
    # runs that lie over the files' edges, two corpora, and a second write in place of the first
    runs = spark.createDataFrame([("x", 0, list(range(25))), ("y", 3, [7]), ("x", 25, []), ("x", 25, [25, 26]), ("y", 0, [0, 1, 2])], "corpus string, pos long, tokens array<long>")
    tokenfiles.write_tokens(runs, path, 10)
    back = sorted((r["corpus"], r["pos"], r["token"]) for r in tokenfiles.read_tokens(spark, path).collect())
    assert back == [("x", i, i) for i in range(27)] + [("y", i, t) for i, t in enumerate([0, 1, 2, 7])]
    # bytes of no whole token, files of no folder
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "b.bin").write_bytes(np.arange(5, 9, dtype="<u4").tobytes() + b"\1")
    (tmp_path / "one" / "a.bin").write_bytes(np.arange(5, dtype="<u4").tobytes())
    assert sorted(tuple(r) for r in tokenfiles.read_tokens(spark, str(tmp_path / "one"), "c").collect()) == [("c", i, i) for i in range(9)]
    (tmp_path / "none").mkdir()
    assert tokenfiles.read_tokens(spark, str(tmp_path / "none")).isEmpty()


@pytest.mark.parametrize("wrong", ["pos <> 5", "pos < 100 or pos >= 200", "pos >= 100"])
def test_token_files_refuse_gaps(spark, tmp_path, wrong):
    rows = spark.range(250).select(F.lit("c").alias("corpus"), F.col("id").alias("pos"), F.col("id").alias("token"))
    with pytest.raises(Exception, match="position"):
        tokenfiles.write_tokens(rows.where(wrong), str(tmp_path / "t"), 100)
    assert not [f for f in (tmp_path / "t").rglob("*") if f.is_file()]


def plain_blocks(blocks, seen=()):
    """The sequential rule: lines, repeated lines and whether it stays, of each block."""
    seen, out = set(seen), {}
    for b in sorted(blocks):
        dup = sum(line in seen for line in blocks[b])
        out[b] = (len(blocks[b]), dup, 2 * dup <= len(blocks[b]))
        if out[b][2]:
            seen |= set(blocks[b])
    return out


def random_blocks(rng, n):
    pool = [f"line number {i} of the pool {i}" for i in range(60)]
    return {b: [rng.choice(pool[: 5 + 4 * b]) for _ in range(rng.randint(1, 8))] for b in range(n)}


@pytest.mark.parametrize("part", [500_000, 20, 7])
def test_blocks_in_ranges(spark, part):
    rng = random.Random(part)
    blocks = random_blocks(rng, 40)
    given = set(rng.sample(sorted({line for ls in blocks.values() for line in ls}), 3))
    rows = [(3 * b, line, line in given) for b, ls in blocks.items() for line in ls]
    got = corpus.dedup_blocks(spark.createDataFrame(rows, "block_id long, text string, seen boolean").repartition(3), part).collect()
    assert {r["block_id"] // 3: (r["n_long"], r["n_dup"], r["kept"]) for r in got} == plain_blocks(blocks, given)


@pytest.mark.parametrize("part", [500_000, 900])
def test_chain_of_blocks(spark, part):
    chain = {b: [f"x{b}", f"x{b - 1}", f"x{b - 1}"] for b in range(1000)}
    rows = [(b, line) for b, ls in chain.items() for line in ls]
    got = corpus.dedup_blocks(spark.createDataFrame(rows, "block_id long, text string"), part).collect()
    assert {r["block_id"]: (r["n_long"], r["n_dup"], r["kept"]) for r in got} == plain_blocks(chain)
    assert corpus.dedup_blocks(spark.createDataFrame([], "block_id long, text string")).isEmpty()


def test_stream_of_blocks(spark, tmp_path, monkeypatch):
    """The same decisions as over the whole, in four batches and over a restart."""
    monkeypatch.setattr(shards, "BUCKETS", 8)
    blocks = {b: [*ls, "short", ""] for b, ls in random_blocks(random.Random(9), 40).items()}
    rows = spark.createDataFrame([(b, line) for b, ls in blocks.items() for line in ls], "block_id long, text string")
    at = {n: str(tmp_path / n) for n in ("in", "seen", "out", "state")}
    query = None
    for lo in range(0, 40, 10):
        rows.where(f"block_id between {lo} and {lo + 9}").coalesce(1).write.mode("append").parquet(at["in"])
        if lo in (0, 20):
            if query is not None:
                query.stop()
            query = shards.dedup_shards(spark.readStream.schema("block_id long, text string").parquet(at["in"]), at["seen"], at["out"], at["state"])
        query.processAllAvailable()
    query.stop()
    want = plain_blocks({b: ls[:-2] for b, ls in blocks.items()})
    got = spark.read.parquet(at["out"]).groupBy("block_id").count().collect()
    assert {r["block_id"]: r["count"] for r in got} == {b: len(blocks[b]) for b, w in want.items() if w[2]}


def test_stream_of_many_lines(spark, tmp_path):
    """No line of a large batch is lost, and none goes through Python on its way to the state."""
    blocks = {b: [f"a line that only one block holds {b} {i}" for i in range(200)] for b in range(60)}
    blocks |= {b: blocks[b - 1][:150] + blocks[b][:50] for b in range(1, 60, 3)}
    rows = spark.createDataFrame([(b, line) for b, ls in blocks.items() for line in ls], "block_id long, text string")
    at = {n: str(tmp_path / n) for n in ("in", "seen", "out", "state")}
    rows.limit(0).write.parquet(at["in"])
    query = shards.dedup_shards(spark.readStream.schema("block_id long, text string").parquet(at["in"]), at["seen"], at["out"], at["state"])
    for shard in ("block_id < 30", "block_id >= 30"):
        rows.where(shard).write.mode("append").parquet(at["in"])
        query.processAllAvailable()
    kinds = {o.operatorName for p in query.recentProgress for o in p.stateOperators}
    query.stop()
    got = spark.read.parquet(at["out"]).groupBy("block_id").count().collect()
    assert {r["block_id"]: r["count"] for r in got} == {b: 200 for b, w in plain_blocks(blocks).items() if w[2]}
    assert kinds == {"stateStoreSave"}


def test_event_counts(spark, tmp_path):
    rows = "ts timestamp_ntz, event_type string, value double"
    for n, hours in enumerate(([0, 0, 1, 5], [0, 4, 9])):
        spark.createDataFrame([(f"2026-01-01 {h:02d}:10:00", "a", float(h)) for h in hours], "t string, event_type string, value double").select(F.col("t").cast("timestamp").alias("ts"), "event_type", "value").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(rows.replace("_ntz", "")).parquet(str(tmp_path / "in"))
        counted = shards.event_counts(stream)
        counted.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).select(F.hour("window.start").alias("h"), "n", "total").collect()
    # the second file's row of hour 0 comes after the watermark (5:10 less 2 hours) and is dropped
    assert sorted(tuple(r) for r in got) == [(0, 2, 0.0), (1, 1, 1.0), (4, 1, 4.0), (5, 1, 5.0)]


def test_scans_over_many_parts(spark):
    rng = np.random.default_rng(7)
    series = {0: rng.normal(size=3000) + 5, 1: rng.normal(size=1), 2: rng.normal(size=700)}
    rows = [(k, n, float(v)) for k, values in series.items() for n, v in enumerate(values)]
    df = spark.createDataFrame(rows, "k long, n long, v double").repartition(3)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        for keep in (0.98, 0.5, 0.0):
            got = {(r["k"], r["n"]): r["ema"] for r in tensor.ema(df, "n", "v", keep, ("k",)).collect()}
            for k, values in series.items():
                x = values[0]
                for n, v in enumerate(values):
                    x = keep * x + (1 - keep) * v
                    assert abs(got[k, n] - x) < 1e-9
        best = {(r["k"], r["n"]): (r["best_before"], r["is_best"]) for r in tensor.best_so_far(df, "n", "v", ("k",)).collect()}
        for k, values in series.items():
            least = np.minimum.accumulate(values)
            for n, v in enumerate(values):
                assert best[k, n] == ((None, True) if n == 0 else (least[n - 1], bool(v < least[n - 1])))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def frame(spark, m):
    return spark.createDataFrame([(i, j, float(v)) for (i, j), v in np.ndenumerate(m)], "i int, j int, v double")


def array(df, shape):
    out = np.zeros(shape)
    for r in df.collect():
        out[r["i"], r["j"]] += r["v"]
    return out


def slope(f, m):
    out = np.zeros_like(m)
    for at in np.ndindex(*m.shape):
        step = np.zeros_like(m)
        step[at] = 1e-6
        out[at] = (f(m + step) - f(m - step)) / 2e-6
    return out


def test_gradients_through_slices(spark):
    """What lies outside a slice has no row in the gradient, and counts as zero."""
    rng = np.random.default_rng(8)
    x, c, w, up = rng.normal(size=(3, 5)), rng.normal(size=(3, 2)), rng.normal(size=5), rng.normal(size=(3, 5))
    X, G = frame(spark, x), tensor.slice_cols_grad(frame(spark, c), 1)
    weight = spark.createDataFrame([(j, float(v)) for j, v in enumerate(w)], "j int, w double")

    def soft(m):
        e = np.exp(m - m.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    norm = lambda m: m / np.sqrt((m * m).mean(1, keepdims=True) + 1e-5) * w
    sliced = lambda f: lambda m: float((f(m)[:, 1:3] * c).sum())
    assert np.allclose(array(tensor.softmax_grad(tensor.softmax(X), G), x.shape), slope(sliced(soft), x), atol=1e-6)
    assert np.allclose(array(tensor.rmsnorm_grad(X, weight, G)[0], x.shape), slope(sliced(norm), x), atol=1e-6)
    da, db = tensor.swiglu_grad(X, frame(spark, up), G)
    gate = lambda a, b: a / (1 + np.exp(-a)) * b
    assert np.allclose(array(da, x.shape), slope(sliced(lambda m: gate(m, up)), x), atol=1e-6)
    assert np.allclose(array(db, x.shape), slope(sliced(lambda m: gate(x, m)), up), atol=1e-6)
    both = tensor.combine(G, X, lambda a, b: a + b)
    assert np.allclose(array(both, x.shape), x + np.pad(c, ((0, 0), (1, 2))))
    assert tensor.dense(G, 3, 5).count() == 15 and np.allclose(array(tensor.dense(G, 3, 5), x.shape), np.pad(c, ((0, 0), (1, 2))))
    # a rotation of a gradient with one entry of a pair
    turned = array(tensor.rope(tensor.slice_cols_grad(frame(spark, c[:, :1]), 2), 4, inverse=True), (3, 4))
    assert np.allclose((turned[:, 2:] ** 2).sum(1), c[:, 0] ** 2)


@pytest.mark.parametrize(("letters", "merges", "candidates"), [("ab", 60, 256), ("abcé", 60, 3), ("abcé", 10**6, 64)])
def test_merges_in_rounds(spark, monkeypatch, letters, merges, candidates):
    """The same merges as one after the other, ties and runs of one symbol among them, until no pair is left."""
    monkeypatch.setattr(bpe_train, "WORDS_A_ROW", 37)
    rng = random.Random(merges)
    words = sorted({"".join(rng.choices(letters, k=rng.randint(1, 12))) for _ in range(200 if merges == 60 else 40)})
    rows = [(w, rng.randint(1, 5)) for w in words] + [("a" * 40, 3)]
    df = spark.createDataFrame([*rows, ("", 4), (None, 2), ("ab", 0)], "word string, cnt long").repartition(3)
    assert bpe_train.train(df, merges, candidates) == bpe.train_local(rows, merges)
    assert bpe_train.train(df.limit(0), 5) == [] and bpe_train.train(df, 0) == []


def matrix(df, shape):
    out = np.zeros(shape)
    for r in tiles.entries(df, size=4).collect():
        if r["i"] < shape[0] and r["j"] < shape[1]:
            out[r["i"], r["j"]] += r["v"]
        else:
            assert r["v"] == 0
    return out


def test_products_of_tiles(spark, monkeypatch):
    monkeypatch.setattr(tiles, "HELD", 500)
    rng = np.random.default_rng(9)
    a, b = rng.normal(size=(10, 13)), rng.normal(size=(13, 6))
    a[3:8, 2:9] = 0  # a whole tile without a row
    b[12] = 0
    A = tiles.of_rows(spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(a)], "i long, v array<double>"), "i", "v", size=4)
    sparse = spark.createDataFrame([(i, j, float(v)) for (i, j), v in np.ndenumerate(a) if v], "i int, j int, v double")
    B = tiles.of_entries(spark.createDataFrame([(i, j, float(v)) for (i, j), v in np.ndenumerate(b) if v], "i int, j int, v double"), size=4)
    assert np.allclose(matrix(A, a.shape), a) and np.allclose(matrix(B, b.shape), b)
    for left in (A, tiles.of_entries(sparse, size=4)):
        assert np.allclose(matrix(tiles.product(left, B), (10, 6)), a @ b)
    assert np.allclose(matrix(tiles.transpose(A), (13, 10)), a.T)
    two = spark.createDataFrame([(k, i, [float(v) for v in row]) for i, row in enumerate(a) for k in ("x", None, "x")[: 1 + i % 3]], "k string, i long, v array<double>")
    products = tiles.entries(tiles.gram(two, "v", ("k",), 4), ("k",), 4).collect()
    for key, times in (("x", [1, 1, 2] * 4), (None, [0, 1, 1] * 4)):
        want, got = (a * np.array(times[:10])[:, None]).T @ a, np.zeros((13, 13))
        for r in products:
            if r["k"] == key:
                got[r["i"], r["j"]] += r["v"]
        assert np.allclose(got, want)
    assert tiles.gram(two.limit(0), "v", ("k",)).isEmpty() and tiles.product(A.limit(0), B).isEmpty()


@pytest.mark.parametrize("held", [64 << 20, 1])
def test_attention_by_bands(spark, monkeypatch, held):
    monkeypatch.setattr(tiles, "HELD", held)
    rng = np.random.default_rng(10)
    q, k, v = (rng.normal(size=(2, 11, 6)) * 3 for _ in range(3))
    rows = [(b, i, *(x[b, i].tolist() for x in (q, k, v))) for b in range(2) for i in range(11) if (b, i) != (1, 4)]
    df = spark.createDataFrame(rows, "b int, i int, q array<double>, k array<double>, v array<double>").repartition(3)
    got = {(r["b"], r["i"]): r["v"] for r in tiles.attention(df, 6, ("b",), 4).collect()}
    one = {r["i"]: r["v"] for r in tiles.attention(df.where("b = 0").drop("b"), 6, size=4).collect()}
    assert set(got) == {r[:2] for r in rows} and set(one) == set(range(11))
    for b, i in got:
        seen = [j for j in range(i + 1) if (b, j) != (1, 4)]
        s = np.exp(q[b, i] @ k[b, seen].T / np.sqrt(6))
        assert np.allclose(got[b, i], s / s.sum() @ v[b, seen]) and (b or np.allclose(one[i], got[b, i]))


def test_analysis_by_automaton(spark):
    """The parses of the word-by-word search, in its order, for a batch; the automaton takes its words and no others."""
    rng = random.Random(2)
    roots = ["kitap", "göz", "araba", "ev", "git", "gid", "gitmek", "g", "oku", "ağaç", "süt", "renk", "a", "e", "İs", "kanat", "at", "ata", "atlı", "lı", "ım", "ARABA"]
    for known in (frozenset(roots), frozenset([*roots, *"abcçdefgğhıijklm", "al", "la", "lal", "alı"]), frozenset()):
        automaton = lexicon.Automaton(known)

        def taken(word, automaton=automaton):
            state = np.zeros(1, np.int64)
            for c in word:
                state = automaton.step(state, np.array([ord(c)]))
            return bool(automaton.accepts(state)[0])

        words = []
        for _ in range(1200):
            word = rng.choice(roots)
            for _ in range(rng.randint(0, 5)):
                word = turkish.attach(word, rng.choice(turkish.SUFFIXES))
            words.append(word + (rng.choice("abğçI") if rng.random() < 0.2 else ""))
        words += ["ğü" * 22, "", "lalalalalalalalalala", "lıklılıklılıklılıklı", "ımımımımımımımım", "alımımımımlalalarlalar", "b", "日本"]
        words += ["".join(rng.choices("alrımknıdeibiytçğ", k=rng.randint(1, 14))) for _ in range(1200)]
        assert [taken(w) for w in words] == [w in known for w in words]
        assert lexicon.parses(words, automaton, known) == [morphology.analyze(w, known)[0] for w in words]
    assert len(lexicon.Automaton(["evler", "atlar", "ev", "at"]).final) < len("evleratlar") + 1
    df = spark.createDataFrame([(w,) for w in ["arabalar", "arabalar", "xyz", "", None]], "word string")
    got = lexicon.analyze_words(df, spark.createDataFrame([("araba",), (None,)], "word string")).collect()
    assert [(r["word"], r["parse_no"], r["root"], list(r["suffixes"])) for r in got] == [("arabalar", n, *p[:1], list(p[1])) for n, p in enumerate(morphology.analyze("arabalar", {"araba"})[0])]
