import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dokuma import session
from dokuma.functions import hashing
from dokuma.operators import bpe, corpus, morphology, tensor, tokens
from dokuma.operators.order import numbered, with_neighbour
from dokuma.plans import model
from dokuma.sources import files, tokenfiles
from dokuma.streaming import shards

KNOWN = frozenset(("kitap", "göz", "araba", "ev", "git", "gid", "gitmek", "gidmek", "g"))


@pytest.mark.parametrize(
    ("word", "root", "glosses"),
    [
        ("kitap", "kitap", []), ("gözlük", "göz", ["isimlestirme(-lık)"]), ("arabası", "araba", ["iyelik-3tekil"]), ("evlerde", "ev", ["cogul", "bulunma-hali(lokatif)"]),
        ("kitaplardan", "kitap", ["cogul", "ayrilma-hali(ablatif)"]), ("kitaplarımızdan", "kitap", ["cogul", "iyelik-1cogul", "ayrilma-hali(ablatif)"]), ("gidiyorlar", "git", ["simdiki-zaman", "cogul-3sahis(fiil)"]),
    ],
)
def test_analysis(word, root, glosses):
    parses, _ = morphology.analyze(word, KNOWN)
    best = morphology.best(parses, {"git": 1000, "gid": 1})
    assert best[0] == root and [morphology.SUFFIXES[i].gloss for i in best[1]] == glosses
    assert all(morphology.surface(*p) == word for p in parses)


def test_long_junk_has_no_parse():
    assert morphology.analyze("ğü" * 22, KNOWN) == ([], False)


def _plain_blocks(blocks):
    seen, kept = set(), {}
    for b in sorted(blocks):
        dup = sum(line in seen for line in blocks[b])
        kept[b] = 2 * dup <= len(blocks[b])
        if kept[b]:
            seen |= set(blocks[b])
    return kept


def test_block_dedup_is_sequential(spark):
    rng = random.Random(5)
    for _ in range(3):
        pool = [f"line number {i} of the pool {i}" for i in range(60)]
        blocks = {b: [rng.choice(pool[: 5 + 4 * b]) for _ in range(rng.randint(1, 8))] for b in range(14)}
        rows = [(b, line) for b, ls in blocks.items() for line in ls]
        found = corpus.dedup_blocks(spark.createDataFrame(rows, "block_id long, text string").repartition(3))
        assert {r["block_id"]: r["kept"] for r in found.collect()} == _plain_blocks(blocks)


def test_sampling_follows_the_generator(spark):
    out = {r["block_id"]: r["draw"] for r in corpus.sample_blocks(spark.range(50).select((F.col("id") * 7).alias("block_id"))).collect()}
    assert [out[7 * i] for i in range(50)] == hashing.pcg_range(2027, 4, np.arange(50), 1000).tolist()


def test_global_order(spark):
    rows = [(i // 7, i % 7, f"t{i % 3}") for i in range(60)]
    df = spark.createDataFrame(rows, "a long, b long, t string").repartition(5)
    got = {(r["a"], r["b"]): r["no"] for r in numbered(df, ["a", "b"], "no").collect()}
    assert [got[r[:2]] for r in rows] == list(range(60))
    back = {(r["a"], r["b"]): r["p"] for r in with_neighbour(df, ["a", "b"], "t", "p").collect()}
    assert [back[r[:2]] for r in rows] == [None, *[r[2] for r in rows[:-1]]]


def test_merges():
    words = [("aaab", 3), ("abab", 2), ("ğü", 1), ("bab", 4)]
    merges = bpe.Merges(bpe.train_local(words, 6))
    assert merges.merges[0][:2] == (97, 98)
    for w in ["aaab", "abab", "xyz", "ğüab", ""]:
        assert merges.decode(merges.encode(w)) == w.encode()
    assert bpe.Merges.parse(merges.lines()).merges == merges.merges


def test_one_merge_in_dataframes(spark):
    words = spark.createDataFrame([("aaaab", 2), ("baab", 1), ("abaa", 5)], "word string, cnt long")
    out = bpe.apply_merge(bpe.symbols(words), 97, 97, 256).groupBy("word").agg(F.sort_array(F.collect_list(F.struct("pos", "sym"))).alias("s")).collect()
    assert {r["word"]: [x["sym"] for x in r["s"]] for r in out} == {"aaaab": [256, 256, 98], "baab": [98, 256, 98], "abaa": [97, 98, 256]}


def test_tokens_round_trip(spark):
    vocabulary = tokens.Vocabulary(bpe.Merges(bpe.train_local([("kitap", 3), ("kitaplar", 2)], 4)))
    text = "Kitaplar evlerde, gözlük ve kitaplarımızdan!\n\nSon söz."
    ids = vocabulary.encode(text, KNOWN, {"git": 10})
    assert ids.count(vocabulary.eos) == 1 and any(i < vocabulary.base for i in ids)
    assert vocabulary.decode(ids) == text.replace("\n\n", "")
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    got = {r["doc_id"]: r["tokens"] for r in tokens.tokenize(docs, vocabulary, KNOWN, {"git": 10}).collect()}
    assert got == {1: ids, 2: [], 3: []}
    assert all(len(p.encode()) <= 100 for p in tokens.segments("ğ" * 333) if p)


def test_windows(spark):
    stream = spark.range(3000).select(F.lit("sub").alias("corpus"), F.col("id").alias("pos"), (F.col("id") * 3).alias("token"))
    sizes = tokens.split(stream)
    assert tuple(sizes.first()) == ("sub", 3000, 2970, 30)
    for r in tokens.window_tokens(tokens.mixture(sizes, 1, 16), stream, 16).collect():
        assert r["ids"] == [3 * (r["start"] + i) for i in range(16)] and r["targets"] == [x + 3 for x in r["ids"]]


def _frame(spark, m):
    return spark.createDataFrame([(i, j, float(v)) for i, row in enumerate(m) for j, v in enumerate(row)], "i long, j int, v double")


def _array(df, shape):
    out = np.zeros(shape)
    for r in df.collect():
        out[r["i"], r["j"]] = r["v"]
    return out


def test_gradients_by_finite_differences(spark):
    rng = np.random.default_rng(1)
    x, w, t = rng.normal(size=(3, 4)), rng.normal(size=(4, 5)), [1, 4, 0]

    def loss(x, w):
        z = np.maximum(x @ w, 0)
        z = z - z.max(1, keepdims=True)
        return float(np.mean(np.log(np.exp(z).sum(1)) - z[range(3), t]))

    X, W = _frame(spark, x), _frame(spark, w)
    targets = spark.createDataFrame(list(enumerate(t)), "i long, target int")
    h = tensor.matmul(X, W)
    y = tensor.each(h, tensor.relu)
    ops = {"y": (["h"], lambda g: (tensor.activation_grad("relu", h, y, g),)), "h": (["x", "w"], lambda g: tensor.matmul_grad(X, W, g))}
    grads = tensor.gradient("y", ops, tensor.cross_entropy_grad(y, targets, 3))
    for name, m in (("x", x), ("w", w)):
        got, eps = _array(grads[name], m.shape), 1e-6
        for at in np.ndindex(*m.shape):
            up, down = m.copy(), m.copy()
            up[at] += eps
            down[at] -= eps
            both = [(up, w), (down, w)] if name == "x" else [(x, up), (x, down)]
            assert abs((loss(*both[0]) - loss(*both[1])) / (2 * eps) - got[at]) < 1e-5


def test_block_and_inverse_rope(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3, 4))
    turned = tensor.rope(_frame(spark, x), 4)
    assert np.allclose(_array(tensor.rope(turned, 4, inverse=True), x.shape), x)
    eye = _frame(spark, np.eye(4))
    ones = spark.createDataFrame([(j, 1.0) for j in range(4)], "j int, w double")
    weights = {n: eye for n in ("q", "k", "v", "o", "gate", "up", "down")} | {"norm1": ones, "norm2": ones}
    assert np.isfinite(_array(tensor.block(_frame(spark, x), weights, 4), x.shape)).all()


def _plain_block(x, w, heads, width, hidden, length):
    norm = lambda m, g: m / np.sqrt((m * m).mean(1, keepdims=True) + 1e-5) * g
    h, size = norm(x, w["attn_norm"]) @ w["qkv"] + w["qkv_bias"], width // heads

    def turn(m):
        at = np.arange(len(m))[:, None] * 10000.0 ** (-2 * np.arange(size // 2) / size)
        out = np.empty_like(m)
        out[:, ::2], out[:, 1::2] = m[:, ::2] * np.cos(at) - m[:, 1::2] * np.sin(at), m[:, ::2] * np.sin(at) + m[:, 1::2] * np.cos(at)
        return out

    seen = np.zeros_like(x)
    for s in range(0, len(x), length):
        for c in range(0, width, size):
            q, k, v = (h[s : s + length, n * width + c : n * width + c + size] for n in range(3))
            z = turn(q) @ turn(k).T / np.sqrt(size)
            z[np.triu_indices(length, 1)] = -np.inf
            p = np.exp(z - z.max(1, keepdims=True))
            seen[s : s + length, c : c + size] = p / p.sum(1, keepdims=True) @ v
    x = x + seen @ w["out"] + w["out_bias"]
    both = norm(x, w["ffn_norm"]) @ w["gate_up"] + w["gate_up_bias"]
    gate, up = both[:, :hidden], both[:, hidden:]
    return x + (gate / (1 + np.exp(-gate)) * up) @ w["down"] + w["down_bias"]


def test_multi_head_block(spark):
    """Two sequences, two heads, biases: against numpy, with the parameters that the plan lists."""
    rng, width, hidden, length = np.random.default_rng(3), 8, 6, 3
    w = {p.name: rng.normal(size=(p.rows, p.cols)) for p in model.parameters(5, width, 1, hidden) if p.layer == 0}
    x = rng.normal(size=(2 * length, width))
    vector = lambda m, name: spark.createDataFrame([(j, float(v)) for j, v in enumerate(m[0])], f"j int, {name} double")
    frames = {n: vector(m, "b" if n.endswith("bias") else "w") if len(m) == 1 else _frame(spark, m) for n, m in w.items()}
    got = _array(tensor.multi_head_block(_frame(spark, x), frames, 2, width, hidden, length), x.shape)
    assert np.allclose(got, _plain_block(x, w, 2, width, hidden, length), atol=1e-9)


def test_logits_of_the_planned_model(spark):
    """Embedding, two layers with heads and biases, last norm and tied projection over a parameter table: against numpy."""
    rng, width, hidden, length, tokens_ = np.random.default_rng(13), 4, 6, 3, 7
    plan = model.parameters(tokens_, width, 2, hidden)
    w = {(p.layer, p.name): rng.normal(size=(p.rows, p.cols)) for p in plan}
    params = spark.createDataFrame([(*key, i, j, float(v)) for key, m in w.items() for (i, j), v in np.ndenumerate(m)], "layer int, name string, i long, j int, v double")
    ids = rng.integers(0, tokens_, 2 * length)
    x = w[-1, "embedding"][ids]
    for layer in range(2):
        x = _plain_block(x, {name: m for (at, name), m in w.items() if at == layer}, 2, width, hidden, length)
    x = x / np.sqrt((x * x).mean(1, keepdims=True) + 1e-5) * w[-1, "norm"][0]
    rows = spark.createDataFrame([(i, int(t)) for i, t in enumerate(ids)], "i int, token long")
    got = _array(model.logits(rows, params, 2, length), (2 * length, tokens_))
    assert np.allclose(got, x @ w[-1, "embedding"].T, atol=1e-8)


def test_shape_gradients(spark):
    """Sums, differences, scales, slices and concatenations, by finite differences of one function of two matrices."""
    rng = np.random.default_rng(4)
    a, b, c = rng.normal(size=(3, 4)), rng.normal(size=(3, 4)), rng.normal(size=(3, 4))
    A, B, C = (_frame(spark, m) for m in (a, b, c))

    def value(a, b):
        wide = np.concatenate([a[:, 1:3] + b[:, 1:3], (a - b)[:, 2:4]], 1)
        tall = np.concatenate([a[:1], 2.5 * b[1:3]], 0)
        return float((wide * tall * c).sum())

    wide = np.concatenate([a[:, 1:3] + b[:, 1:3], (a - b)[:, 2:4]], 1)
    tall = np.concatenate([a[:1], 2.5 * b[1:3]], 0)
    W, T = _frame(spark, wide), _frame(spark, tall)
    assert np.allclose(_array(tensor.concat_cols(tensor.combine(tensor.slice_cols(A, 1, 3), tensor.slice_cols(B, 1, 3), lambda x, y: x + y), tensor.slice_cols(tensor.combine(A, B, lambda x, y: x - y), 2, 4), 2), wide.shape), wide)
    product = tensor.combine(tensor.combine(W, T, lambda x, y: x * y), C, lambda x, y: x * y)
    assert abs(tensor.sum_all(product).first()[0] - value(a, b)) < 1e-9
    ops = {
        "loss": (["wide", "tall"], lambda g: tensor.mul_grad(W, T, tensor.combine(g, C, lambda x, y: x * y))),
        "wide": (["left", "right"], lambda g: tensor.concat_cols_grad(g, 2)),
        "left": (["la", "lb"], tensor.add_grad), "la": (["a"], lambda g: (tensor.slice_cols_grad(g, 1),)), "lb": (["b"], lambda g: (tensor.slice_cols_grad(g, 1),)),
        "right": (["diff"], lambda g: (tensor.slice_cols_grad(g, 2),)), "diff": (["a", "b"], tensor.sub_grad),
        "tall": (["top", "low"], lambda g: tensor.concat_rows_grad(g, 1)), "top": (["a"], lambda g: (g,)),
        "low": (["scaled"], lambda g: (tensor.slice_rows_grad(g, 1),)), "scaled": (["b"], lambda g: (tensor.scale_grad(g, 2.5),)),
    }
    grads = tensor.gradient("loss", ops, tensor.sum_all_grad(C, 1.0))
    for name in "ab":
        got, eps = _array(grads[name], a.shape), 1e-6
        for at in np.ndindex(*a.shape):
            step = np.zeros_like(a)
            step[at] = eps
            up, down = (value(a + d, b) if name == "a" else value(a, b + d) for d in (step, -step))
            assert abs((up - down) / (2 * eps) - got[at]) < 1e-5


def test_more_gradients(spark):
    rng = np.random.default_rng(5)
    x, w, g, gate, up = rng.normal(size=(3, 4)), rng.normal(size=4), rng.normal(size=(3, 4)), rng.normal(size=(3, 4)), rng.normal(size=(3, 4))
    X, G, weight = _frame(spark, x), _frame(spark, g), spark.createDataFrame([(j, float(v)) for j, v in enumerate(w)], "j int, w double")
    norm = lambda x, w: (x / np.sqrt((x * x).mean(1, keepdims=True) + 1e-5) * w * g).sum()
    gated = lambda a, b: (a / (1 + np.exp(-a)) * b * g).sum()

    def slope(f, m):
        out = np.zeros_like(m)
        for at in np.ndindex(*m.shape):
            step = np.zeros_like(m)
            step[at] = 1e-6
            out[at] = (f(m + step) - f(m - step)) / 2e-6
        return out

    dx, dw = tensor.rmsnorm_grad(X, weight, G)
    assert np.allclose(_array(dx, x.shape), slope(lambda m: norm(m, w), x), atol=1e-5)
    assert np.allclose([r["v"] for r in dw.orderBy("j").collect()], slope(lambda m: norm(x, m), w), atol=1e-5)
    da, db = tensor.swiglu_grad(_frame(spark, gate), _frame(spark, up), G)
    assert np.allclose(_array(da, x.shape), slope(lambda m: gated(m, up), gate), atol=1e-5) and np.allclose(_array(db, x.shape), slope(lambda m: gated(gate, m), up), atol=1e-5)
    for name, f in (("sigmoid", lambda m: 1 / (1 + np.exp(-m))), ("tanh", np.tanh)):
        assert np.allclose(_array(tensor.activation_grad(name, X, _frame(spark, f(x)), G), x.shape), slope(lambda m, f=f: (f(m) * g).sum(), x), atol=1e-5)
    assert np.allclose([r["v"] for r in tensor.bias_grad(G).orderBy("j").collect()], g.sum(0))
    assert np.allclose(_array(tensor.reshape(X, 4, 6), (2, 6)), x.reshape(2, 6))
    bias = spark.createDataFrame([(j, float(v)) for j, v in enumerate(w)], "j int, b double")
    assert np.allclose(_array(tensor.add_bias(X, bias), x.shape), x + w)
    two = X.withColumn("worker", F.lit(0)).unionByName(G.withColumn("worker", F.lit(1)))
    assert np.allclose(_array(tensor.mean_grad(two), x.shape), (x + g) / 2)
    # a worker without a row at a place, or without any, has zeros
    part = X.withColumn("worker", F.lit(0)).unionByName(tensor.slice_cols(G, 0, 2).withColumn("worker", F.lit(1)))
    masked = np.where(np.arange(x.shape[1]) < 2, g, 0)
    assert np.allclose(_array(tensor.mean_grad(part), x.shape), (x + masked) / 2)
    assert np.allclose(_array(tensor.mean_grad(part, 4), x.shape), (x + masked) / 4)


def test_long_average(spark):
    rng = np.random.default_rng(6)
    values = rng.normal(size=70_000) + 5
    got = np.array([r["ema"] for r in tensor.ema(spark.createDataFrame(list(enumerate(values.tolist())), "step long, loss double"), "step", "loss").orderBy("step").collect()])
    plain, x = [], values[0]
    for v in values:
        x = v if not plain else 0.98 * x + 0.02 * v
        plain.append(x)
    assert np.allclose(got, plain, rtol=1e-9)


def test_metrics(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0)], "s string, loss double")
    assert tensor.mean_of_means(rows, "s").first()[0] == 3.5
    two = spark.createDataFrame([("sub", 2.0), ("wiki", 3.0)], "corpus string, loss double")
    assert abs(tensor.weighted_metric(two, {"sub": 9, "wiki": 5}).first()[0] - (2 * 9 + 3 * 5) / 14) < 1e-12
    numbers = spark.createDataFrame([(0.0005,), (-1.25,), (12.9996,), (0.0,)], "v double").select(tensor.fixed3(F.col("v")).alias("t"))
    assert [r["t"] for r in numbers.collect()] == ["0.001", "-1.250", "13.000", "0.000"]


def test_sampling_with_temperature(spark):
    rng = np.random.default_rng(7)
    logits = rng.normal(size=(40, 9)) * 3
    for t in (0.5, 1.0, 2.0):
        p = np.exp((logits - logits.max(1, keepdims=True)) / t)
        p = (p / p.sum(1, keepdims=True)).cumsum(1)
        draw = (np.arange(40) % 17) / 17.5
        got = {r["i"]: r["j"] for r in tokens.sample_logits(_frame(spark, logits), F.col("i") % 17 / F.lit(17.5), t).collect()}
        assert got == {i: int(np.searchsorted(p[i], draw[i] - 1e-15)) for i in range(40)}
    sure = _frame(spark, np.array([[0.0, 0.0]]))
    assert tokens.sample_next(sure.withColumnRenamed("v", "p"), F.lit(0.5)).first()["j"] == 1  # rounding leaves no j: the last one
    kinds = spark.range(5).select(tokens.token_class(F.col("id"), 2, 2).alias("k"))
    assert [r["k"] for r in kinds.collect()] == ["suffix", "suffix", "piece", "piece", "special"]


def test_prompts_are_cut_at_any_byte():
    piece = "ğ" * 120  # 240 bytes
    assert [len(p.encode("utf-8", "surrogateescape")) for p in tokens.segments(piece, eos=False)] == [100, 100, 40]
    odd = "x" + piece
    assert b"".join(p.encode("utf-8", "surrogateescape") for p in tokens.segments(odd, eos=False)) == odd.encode()
    vocabulary = tokens.Vocabulary(bpe.Merges(bpe.train_local([("kitap", 3)], 4)))
    ids = vocabulary.encode(odd + "\n\nson", KNOWN, {}, eos=False)
    assert vocabulary.eos not in ids and b"".join(vocabulary.merges.bytes[i - vocabulary.base] for i in ids) == (odd + "\n\nson").encode()


def test_streams_of_texts(spark):
    rng = random.Random(8)
    texts = [("ab"[i % 2], i, [rng.randrange(100) for _ in range(rng.choice([0, 1, 1, 5]))]) for i in range(60)]
    df = spark.createDataFrame(texts, "corpus string, doc_id long, tokens array<int>").repartition(5)
    flat = {c: [t for x, _, ts in texts if x == c for t in ts] for c in "ab"}
    got = sorted(map(tuple, tokens.stream(df, ["doc_id"]).select("corpus", "pos", "token").collect()))
    assert got == sorted((c, i, t) for c in "ab" for i, t in enumerate(flat[c]))
    pairs = sorted(map(tuple, tokens.next_tokens(df, ["doc_id"]).collect()))
    assert pairs == sorted((c, x, y) for c in "ab" for x, y in zip(flat[c], flat[c][1:], strict=False))


def test_long_words_encode_whole():
    words = [("abab", 5), ("ab", 9), ("ba", 2)]
    merges = bpe.Merges(bpe.train_local(words, 5))
    rng = random.Random(9)

    def plain(word):
        out = list(word.encode())
        while known := [(merges.rank[p], i) for i, p in enumerate(zip(out, out[1:], strict=False)) if p in merges.rank]:
            (_, new), i = min(known)
            out[i : i + 2] = [new]
        return out

    for n in (1, 2, 7, 300):
        for _ in range(20):
            word = "".join(rng.choices("ab", k=n))
            assert merges.encode(word) == plain(word) and len(merges.decode(merges.encode(word, strict=True))) == min(n, 192)
    assert merges.decode(merges.encode("ab" * 200_000)) == b"ab" * 200_000


def test_line_and_token_files(spark, tmp_path):
    for name, lines in (("b.txt", ["z", "x" * 70_000, "w"]), ("a.txt", [f"line {i}" for i in range(500)])):
        (tmp_path / "text").mkdir(exist_ok=True)
        (tmp_path / "text" / name).write_text("".join(f"{line}\n" for line in lines))
    got = {r["line_no"]: r["text"] for r in files.read_numbered_lines(spark, str(tmp_path / "text")).collect()}
    assert got == {i: f"line {i}" for i in range(500)} | {500: "z", 502: "w"}
    at = str(tmp_path / "best")
    assert files.load_best(spark, at) == 3.0e38
    files.save_best(spark, 1.25, at)
    assert files.load_best(spark, at) == 1.25
    counted, seen = files.progress(spark.range(10), "progress", odd=F.col("id") % 2 == 1)
    counted.write.format("noop").mode("overwrite").save()
    assert seen.get == {"rows": 10, "odd": 5}


def test_subsets_by_bitmaps(spark, monkeypatch):
    df = spark.range(90_000).select((F.col("id") % 7).alias("_row"), F.col("id")).repartition(3)
    for limit in (64 << 20, 8192):
        monkeypatch.setattr(session, "BITMAPS", limit)
        rows = session.Rows(df)
        assert rows.columns == ["_row", "id"] and rows.id not in rows.columns
        marked = rows.df.where("id % 5 = 0").select(rows.id)
        assert rows.where(marked).agg(F.count("*"), F.sum("id")).first() == df.where("id % 5 = 0").agg(F.count("*"), F.sum("id")).first()
        assert rows.where(marked.unionByName(marked), keep=False).where("id % 5 = 0").isEmpty() and rows.where(marked, keep=False).count() == 72_000
    assert session.Rows(df.limit(0)).where(marked).isEmpty()


def test_files(spark, tmp_path):
    (tmp_path / "d.xml").write_text(
        "<mediawiki><page><title>Ev</title><ns>0</ns><revision><text> == Türkçe ==\n{{x}}" + "Uzun metin. " * 30 + "a&amp;nbsp;b</text></revision></page>"
        '<page><title>Y</title><ns>0</ns><redirect title="Ev"/><revision><text>yok</text></revision></page>'
        "<page><title>T</title><ns>1</ns><revision><text>yok</text></revision></page></mediawiki>"
    )
    pages = files.read_pages(spark, str(tmp_path / "d.xml"))
    assert pages.count() == 3
    out = corpus.articles(pages).collect()
    assert [r["title"] for r in out] == ["Ev"] and out[0]["text"].endswith("a b") and "{{" not in out[0]["text"]
    assert corpus.articles(pages, strict=True).first()["text"].endswith("a&nbsp;b")
    assert [r["word"] for r in corpus.root_candidates(pages).collect()] == ["Ev"]
    np.arange(10, dtype="<u4").tofile(tmp_path / "t.bin")
    toks = tokenfiles.read_tokens(spark, str(tmp_path / "t.bin"), "sub")
    assert [r["token"] for r in toks.orderBy("pos").collect()] == list(range(10))
    (tmp_path / "c.tsv").write_text("ev\t5\r\nbozuk\nsu\t7\n")
    assert sorted(map(tuple, files.read_counts(spark, str(tmp_path / "c.tsv")).collect())) == [("ev", 5), ("su", 7)]
    files.write_merges([(97, 98, 256)], spark, str(tmp_path / "m"))
    assert files.read_merges(spark, str(tmp_path / "m")) == [(97, 98, 256)]
    params = _frame(spark, np.ones((2, 2))).withColumn("param_idx", F.lit(0))
    at = files.save_checkpoint(params, 3, str(tmp_path / "ck"))
    shape = lambda n: spark.createDataFrame([(0, n, 2)], "param_idx int, rows long, cols int")
    assert files.load_checkpoint(spark, at, shape(2)).count() == 4
    with pytest.raises(ValueError):
        files.load_checkpoint(spark, at, shape(3))
    files.probe_write(spark, str(tmp_path))


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("Kim geIdi?\n...\n- Olur.\n")
    q = shards.clean_lines(spark, str(tmp_path / "in")).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["text"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["Kim geldi?", "Olur."]


def test_initial_parameters(spark):
    plan = model.parameters(7, 4, 2, 6)
    assert len(plan) == 1 + 10 * 2 + 1 and [p.index for p in plan] == list(range(22))
    rows = sorted(map(tuple, model.initial(spark, plan, 5, 1).select("param_idx", "i", "j", "v").collect()))
    drawn = [v for p, _, _, v in rows if plan[p].fill is None]
    assert np.allclose(drawn, 0.02 * hashing.pcg_normal(5, 1, len(drawn)))
    assert {v for p, _, _, v in rows if plan[p].fill is not None} == {0.0, 1.0}
    assert len(rows) == sum(p.rows * p.cols for p in plan)
