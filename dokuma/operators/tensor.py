"""Tensors as rows (i, j, v): products, activations, norms, attention, losses, gradients, optimiser steps.

Contractions are joins on the shared index and sums; reductions over a row are windows or groups. An entry without a row
is zero in sums, products and every gradient: what flows back through a slice has rows at the slice's places only. Values
that go through a function with f(0) other than 0, or are averaged over rows, need all their entries; dense() gives them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from dokuma.operators.order import ordered
from dokuma.session import stage


def _row() -> WindowSpec:
    return Window.partitionBy("i")


def explode_rows(df: DataFrame, i: str, vector: str) -> DataFrame:
    return df.select(F.col(i).cast("long").alias("i"), F.posexplode(vector).alias("j", "v")).select("i", "j", F.col("v").cast("double").alias("v"))


def matmul(a: DataFrame, b: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(i, k) x (k, j), for each batch in `by` on its own."""
    left = a.select(*by, "i", F.col("j").alias("k"), F.col("v").alias("x"))
    right = b.select(*by, F.col("i").alias("k"), "j", F.col("v").alias("y"))
    return left.join(right, [*by, "k"]).groupBy(*by, "i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("v"))


def transpose(a: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return a.select(*by, F.col("j").alias("i"), F.col("i").alias("j"), "v")


def slice_cols(a: DataFrame, lo: int, hi: int) -> DataFrame:
    return a.where(F.col("j").between(lo, hi - 1)).withColumn("j", F.col("j") - lo)


def slice_rows(a: DataFrame, lo: int, hi: int) -> DataFrame:
    return a.where(F.col("i").between(lo, hi - 1)).withColumn("i", F.col("i") - lo)


def concat_cols(a: DataFrame, b: DataFrame, width: int) -> DataFrame:
    return a.unionByName(b.withColumn("j", F.col("j") + width))


def concat_rows(a: DataFrame, b: DataFrame, height: int) -> DataFrame:
    return a.unionByName(b.withColumn("i", F.col("i") + height))


def reshape(a: DataFrame, old_width: int, new_width: int) -> DataFrame:
    flat = F.col("i") * old_width + F.col("j")
    return a.select(F.floor(flat / new_width).alias("i"), (flat % new_width).alias("j"), "v")


def combine(a: DataFrame, b: DataFrame, how) -> DataFrame:
    """how(x, y) of the entries at equal places; where one of the two has no row, it is zero."""
    zero = F.lit(0.0)
    both = a.join(b.withColumnRenamed("v", "w"), ["i", "j"], "full")
    return both.select("i", "j", how(F.coalesce("v", zero), F.coalesce("w", zero)).alias("v"))


def dense(a: DataFrame, height: int, width: int) -> DataFrame:
    """a with a row for every place of a height x width tensor, zeros among them."""
    places = a.sparkSession.range(height).select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("j"))
    return places.join(a, ["i", "j"], "left").select("i", "j", F.coalesce("v", F.lit(0.0)).alias("v"))


def each(a: DataFrame, how) -> DataFrame:
    return a.select("i", "j", how(F.col("v")).alias("v"))


def relu(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def silu(x: Column) -> Column:
    return x * sigmoid(x)


def add_bias(a: DataFrame, bias: DataFrame) -> DataFrame:
    """bias: j, b."""
    return a.join(bias, "j").select("i", "j", (F.col("v") + F.col("b")).alias("v"))


def softmax(a: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    row = Window.partitionBy(*by, "i")
    e = F.exp(F.col("v") - F.max("v").over(row))
    return a.withColumn("e", e).select(*by, "i", "j", (F.col("e") / F.sum("e").over(row)).alias("v"))


def rmsnorm(a: DataFrame, weight: DataFrame | None = None, eps: float = 1e-5) -> DataFrame:
    """x / sqrt(mean x^2 + eps), times the column's weight (j, w)."""
    out = a.select("i", "j", (F.col("v") / F.sqrt(F.avg(F.col("v") * F.col("v")).over(_row()) + eps)).alias("v"))
    return out if weight is None else out.join(weight, "j").select("i", "j", (F.col("v") * F.col("w")).alias("v"))


def rope(a: DataFrame, width: int, inverse: bool = False, base: float = 10000.0, position: Column | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Pairs (2k, 2k + 1) of row i turned by position * base^(-2k / width); the position is i by default. Sequences
    and heads in `by`."""
    k = F.floor(F.col("j") / 2)
    one = lambda odd: F.coalesce(F.max(F.when(F.col("j") % 2 == odd, F.col("v"))), F.lit(0.0))
    pairs = a.groupBy(*by, "i", k.alias("k")).agg(one(0).alias("x"), one(1).alias("y"))
    angle = (F.col("i") if position is None else position) * F.pow(F.lit(base), -2 * F.col("k") / F.lit(width)) * (-1 if inverse else 1)
    x, y, c, s = F.col("x"), F.col("y"), F.cos(angle), F.sin(angle)
    both = F.array(F.struct((2 * F.col("k")).alias("j"), (x * c - y * s).alias("v")), F.struct((2 * F.col("k") + 1).alias("j"), (x * s + y * c).alias("v")))
    return pairs.select(*by, "i", F.inline(both)).select(*by, "i", F.col("j").cast("int").alias("j"), "v")


def causal_attention(q: DataFrame, k: DataFrame, v: DataFrame, width: int, by: tuple[str, ...] = ()) -> DataFrame:
    """softmax(q k^T / sqrt(width)) v where row i sees rows j <= i only; sequences (and heads) in `by`."""
    left = q.select(*by, "i", F.col("j").alias("k"), F.col("v").alias("x"))
    right = k.select(*by, F.col("i").alias("j"), F.col("j").alias("k"), F.col("v").alias("y"))
    scores = left.join(right, [*by, "k"]).where("j <= i").groupBy(*by, "i", "j").agg((F.sum(F.col("x") * F.col("y")) / math.sqrt(width)).alias("v"))
    return matmul(softmax(scores, by), v, by)


def swiglu(gate: DataFrame, up: DataFrame, down: DataFrame) -> DataFrame:
    return matmul(combine(gate, up, lambda g, u: silu(g) * u), down)


def block(x: DataFrame, weights: dict[str, DataFrame], width: int) -> DataFrame:
    """A pre-norm transformer block of one head: x + attention(norm x), then that + swiglu(norm of it).
    weights: norm1, norm2 (j, w) and q, k, v, o, gate, up, down (i, j, v)."""
    h = rmsnorm(x, weights["norm1"])
    q, k, v = (matmul(h, weights[n]) for n in "qkv")
    x = combine(x, matmul(causal_attention(rope(q, width), rope(k, width), v, width), weights["o"]), lambda a, b: a + b)
    h = rmsnorm(x, weights["norm2"])
    return combine(x, swiglu(matmul(h, weights["gate"]), matmul(h, weights["up"]), weights["down"]), lambda a, b: a + b)


def multi_head_attention(x: DataFrame, weights: dict[str, DataFrame], heads: int, width: int, length: int) -> DataFrame:
    """Causal self-attention of a batch: rows i are positions of sequences of `length` rows, one after another; no row
    sees another sequence. weights: qkv (i, j, v: queries, keys and values side by side), qkv_bias (j, b), out, out_bias."""
    size, by = width // heads, ("s", "h")
    fused = add_bias(matmul(x, weights["qkv"]), weights["qkv_bias"])
    split = [F.floor(F.col("i") / length).alias("s"), F.floor(F.col("j") / size).alias("h"), (F.col("i") % length).alias("i"), (F.col("j") % size).cast("int").alias("j"), "v"]
    q, k, v = (slice_cols(fused, n * width, (n + 1) * width).select(*split) for n in range(3))
    seen = causal_attention(rope(q, size, by=by), rope(k, size, by=by), v, size, by)
    joined = seen.select((F.col("s") * length + F.col("i")).alias("i"), (F.col("h") * size + F.col("j")).cast("int").alias("j"), "v")
    return add_bias(matmul(joined, weights["out"]), weights["out_bias"])


def multi_head_block(x: DataFrame, weights: dict[str, DataFrame], heads: int, width: int, hidden: int, length: int) -> DataFrame:
    """A pre-norm block with the parameters of plans.model: attn_norm and ffn_norm (j, w), the attention's, gate_up (gates
    and ups side by side), gate_up_bias, down and down_bias."""
    plus = lambda a, b: a + b
    x = combine(x, multi_head_attention(rmsnorm(x, weights["attn_norm"]), weights, heads, width, length), plus)
    both = add_bias(matmul(rmsnorm(x, weights["ffn_norm"]), weights["gate_up"]), weights["gate_up_bias"])
    out = swiglu(slice_cols(both, 0, hidden), slice_cols(both, hidden, 2 * hidden), weights["down"])
    return combine(x, add_bias(out, weights["down_bias"]), plus)


def forward(ids: DataFrame, embedding: DataFrame, layers: list[dict[str, DataFrame]], norm: DataFrame, width: int) -> DataFrame:
    """Logits of a sequence (i, token): embedding, blocks, a last norm and the embedding's transpose."""
    x = embed(ids, embedding)
    for weights in layers:
        x = block(x, weights, width)
    return matmul(rmsnorm(x, norm), transpose(embedding))


def embed(ids: DataFrame, embedding: DataFrame) -> DataFrame:
    rows = embedding.withColumnRenamed("i", "token")
    return ids.join(rows, "token").select("i", "j", "v")


def embed_grad(ids: DataFrame, grad: DataFrame) -> DataFrame:
    """Scatter-add: gradients of the rows that share a token are summed."""
    return grad.join(ids, "i").groupBy(F.col("token").alias("i"), "j").agg(F.sum("v").alias("v"))


def cross_entropy(logits: DataFrame, targets: DataFrame) -> DataFrame:
    """i, loss: log-sum-exp less the target's logit; targets: i, target."""
    top = logits.groupBy("i").agg(F.max("v").alias("m"))
    sums = logits.join(top, "i").groupBy("i").agg(F.max("m").alias("m"), F.sum(F.exp(F.col("v") - F.col("m"))).alias("s"))
    hit = logits.join(targets, "i").where("j = target").select("i", F.col("v").alias("z"))
    return sums.join(hit, "i").select("i", (F.log("s") + F.col("m") - F.col("z")).alias("loss"))


def cross_entropy_grad(logits: DataFrame, targets: DataFrame, n: int) -> DataFrame:
    p = softmax(logits).join(targets, "i")
    return p.select("i", "j", ((F.col("v") - (F.col("j") == F.col("target")).cast("double")) / n).alias("v"))


def sum_all(a: DataFrame) -> DataFrame:
    """v: the sum of all entries."""
    return a.agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("v"))


def sum_all_grad(a: DataFrame, g: float) -> DataFrame:
    """The one gradient of the sum, at every place of a."""
    return a.select("i", "j", F.lit(float(g)).alias("v"))


def scale_grad(g: DataFrame, by: float) -> DataFrame:
    return each(g, lambda v: v * by)


def add_grad(g: DataFrame) -> tuple[DataFrame, DataFrame]:
    return g, g


def sub_grad(g: DataFrame) -> tuple[DataFrame, DataFrame]:
    return g, scale_grad(g, -1.0)


def slice_cols_grad(g: DataFrame, lo: int) -> DataFrame:
    """Back to the slice's place; entries outside it have no row, which stands for zero."""
    return g.withColumn("j", F.col("j") + lo)


def slice_rows_grad(g: DataFrame, lo: int) -> DataFrame:
    return g.withColumn("i", F.col("i") + lo)


def concat_cols_grad(g: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    return g.where(F.col("j") < width), g.where(F.col("j") >= width).withColumn("j", F.col("j") - width)


def concat_rows_grad(g: DataFrame, height: int) -> tuple[DataFrame, DataFrame]:
    return g.where(F.col("i") < height), g.where(F.col("i") >= height).withColumn("i", F.col("i") - height)


def softmax_grad(y: DataFrame, g: DataFrame) -> DataFrame:
    both = y.join(g.withColumnRenamed("v", "g"), ["i", "j"], "left").withColumn("g", F.coalesce("g", F.lit(0.0)))
    return both.select("i", "j", (F.col("v") * (F.col("g") - F.sum(F.col("v") * F.col("g")).over(_row()))).alias("v"))


def rmsnorm_grad(x: DataFrame, weight: DataFrame, g: DataFrame, eps: float = 1e-5) -> tuple[DataFrame, DataFrame]:
    """Gradients of x (i, j, v) and of the weight (j, v)."""
    both = x.join(g.withColumnRenamed("v", "g"), ["i", "j"], "left").withColumn("g", F.coalesce("g", F.lit(0.0))).join(weight, "j")
    r = 1 / F.sqrt(F.avg(F.col("v") * F.col("v")).over(_row()) + eps)
    s = F.sum(F.col("g") * F.col("w") * F.col("v")).over(_row())
    rows = both.withColumns({"r": r, "s": s, "n": F.count("*").over(_row())})
    dx = rows.select("i", "j", (F.col("w") * F.col("r") * F.col("g") - F.pow("r", F.lit(3)) / F.col("n") * F.col("v") * F.col("s")).alias("v"))
    return dx, rows.groupBy("j").agg(F.sum(F.col("g") * F.col("v") * F.col("r")).alias("v"))


def matmul_grad(a: DataFrame, b: DataFrame, g: DataFrame) -> tuple[DataFrame, DataFrame]:
    return matmul(g, transpose(b)), matmul(transpose(a), g)


def mul_grad(a: DataFrame, b: DataFrame, g: DataFrame) -> tuple[DataFrame, DataFrame]:
    times = lambda x, y: x * y
    return combine(g, b, times), combine(g, a, times)


def activation_grad(name: str, x: DataFrame, y: DataFrame, g: DataFrame) -> DataFrame:
    """Gradient through relu (of x), sigmoid or tanh (of the value y)."""
    if name == "relu":
        return combine(g, x, lambda d, v: F.when(v > 0, d).otherwise(0.0))
    return combine(g, y, (lambda d, v: d * v * (1 - v)) if name == "sigmoid" else (lambda d, v: d * (1 - v * v)))


def swiglu_grad(gate: DataFrame, up: DataFrame, g: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Gradients of gate and up through silu(gate) * up."""
    rows = gate.withColumnRenamed("v", "a").join(up.withColumnRenamed("v", "b"), ["i", "j"]).join(g, ["i", "j"], "left").withColumn("v", F.coalesce("v", F.lit(0.0)))
    s = sigmoid(F.col("a"))
    da = F.col("v") * F.col("b") * (s + F.col("a") * s * (1 - s))
    return rows.select("i", "j", da.alias("v")), rows.select("i", "j", (F.col("v") * silu(F.col("a"))).alias("v"))


def bias_grad(g: DataFrame) -> DataFrame:
    return g.groupBy("j").agg(F.sum("v").alias("v"))


def accumulate(*grads: DataFrame) -> DataFrame:
    """Contributions to one tensor, added up."""
    total = grads[0]
    for more in grads[1:]:
        total = total.unionByName(more)
    return total.groupBy("i", "j").agg(F.sum("v").alias("v"))


def mean_grad(grads: DataFrame, workers: int | None = None) -> DataFrame:
    """Gradients of several workers (worker, i, j, v) averaged; a worker without a row at a place has zero there. workers: their
    number, or null to count those that have a row anywhere."""
    if workers is None:
        workers = grads.agg(F.count_distinct("worker")).first()[0]
    return grads.groupBy("i", "j").agg((F.sum("v") / F.lit(max(workers, 1))).alias("v"))


def clip_scale(grads: DataFrame) -> DataFrame:
    """norm, scale: the global norm, and what brings it down to 1."""
    norm = F.sqrt(F.sum(F.col("v") * F.col("v")))
    return grads.agg(norm.alias("norm")).withColumn("scale", F.least(F.lit(1.0), 1 / F.col("norm")))


def adam(params: DataFrame, t: int, lr: float, b1: float = 0.9, b2: float = 0.999, eps: float = 1e-8) -> DataFrame:
    """params: i, j, v, grad, m, s; one bias-corrected step."""
    m = b1 * F.col("m") + (1 - b1) * F.col("grad")
    s = b2 * F.col("s") + (1 - b2) * F.col("grad") * F.col("grad")
    step = lr * (m / (1 - b1**t)) / (F.sqrt(s / (1 - b2**t)) + eps)
    return params.select("i", "j", (F.col("v") - step).alias("v"), m.alias("m"), s.alias("s"))


def warmup_cosine(step: Column, warmup: int, total: int, peak: float, least: float) -> Column:
    """A linear rise to the peak, half a cosine down to the least rate, and that rate from there on."""
    share = F.least(F.lit(1.0), (step - warmup) / F.lit(float(max(total - warmup, 1))))
    falling = least + (peak - least) * 0.5 * (1 + F.cos(F.lit(math.pi) * share)) if total > warmup else F.lit(least)
    return F.when(step < warmup, peak * (step + 1) / F.lit(float(max(warmup, 1)))).otherwise(falling)


def ema(rows: DataFrame, order: str, value: str, keep: float = 0.98, by: tuple[str, ...] = ()) -> DataFrame:
    """Running average of each series in `by` (of all rows, without), seeded by its first value, as a scan of pairs: n steps
    turn an average c into keep^n c + s, and two such pairs (keep^n, s) compose. Rows are range-partitioned once by series
    and order, so a series of any length is spread over tasks; each part sums its own s, and the parts' pairs, one for
    each part and series, are folded in order. The order must tell the rows of a series apart.

    Within a part, s is a weighted sum in closed form, in blocks over which the weights stay within doubles; what lies
    before the block before weighs less than e^-500 and is nothing in doubles."""
    size = max(int(500 / -math.log(keep)), 1) if 0 < keep < 1 else 1 if keep == 0 else 1 << 62
    parts = ordered(rows, *by, order)
    w = Window.partitionBy("_part", *by).orderBy(order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    seq = parts.withColumn("_n", F.row_number().over(w) - 1).withColumn("_at", F.col("_n") % size).withColumn("_block", F.floor(F.col("_n") / size))
    part = (1 - keep) * F.col(value) * F.pow(F.lit(keep), -F.col("_at"))
    inner = F.sum(part).over(Window.partitionBy("_part", *by, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)) * F.pow(F.lit(keep), F.col("_at"))
    seq = seq.withColumn("_inner", inner)
    end = F.last(F.when(F.col("_at") == size - 1, F.col("_inner")), ignorenulls=True).over(before)
    own = seq.withColumn("_own", F.col("_inner") + F.coalesce(end, F.lit(0.0)) * F.pow(F.lit(keep), F.col("_at") + 1))
    own = stage(own.drop("_inner", "_at", "_block"), "scan")
    pairs = own.groupBy(*by, "_part").agg(F.pow(F.lit(keep), F.count("*")).alias("f"), F.max_by("_own", "_n").alias("s"), F.min_by(value, "_n").alias("v"))
    # a part and its pair; a series has one for each part that it lies in
    chain = F.sort_array(F.collect_list(F.struct("_part", "f", "s", "v")))
    step = lambda acc, x: F.struct((x["f"] * acc["c"] + x["s"]).alias("c"), F.concat(acc["given"], F.array(F.struct(x["_part"].alias("_part"), acc["c"].alias("_given")))).alias("given"))
    first = F.struct(F.get("chain", F.lit(0))["v"].cast("double").alias("c"), F.expr("cast(array() as array<struct<_part: int, _given: double>>)").alias("given"))
    given = pairs.groupBy(*by).agg(chain.alias("chain")).select(*by, F.inline(F.aggregate("chain", first, step)["given"]))
    out = own.join(given, ["_part", *by])
    return out.withColumn("ema", F.col("_own") + F.col("_given") * F.pow(F.lit(keep), F.col("_n") + 1)).drop("_part", "_n", "_own", "_given")


def mean_of_means(losses: DataFrame, by: str, value: str = "loss") -> DataFrame:
    """loss: the mean over the sequences in `by` of each one's mean."""
    return losses.groupBy(by).agg(F.avg(value).alias("_m")).agg(F.avg("_m").alias("loss"))


def weighted_metric(metrics: DataFrame, weights: dict[str, int]) -> DataFrame:
    """metric: the corpora's values (corpus, loss), weighted by their shares in a batch."""
    share = F.create_map(*(F.lit(x) for c, n in weights.items() for x in (c, n / sum(weights.values()))))
    return metrics.agg(F.sum(F.col("loss") * share[F.col("corpus")]).alias("metric"))


def fixed3(value: Column) -> Column:
    """A number with three decimals, halves away from zero."""
    thousandths = F.floor(F.abs(value) * 1000 + 0.5)
    whole = F.floor(thousandths / 1000).cast("string")
    return F.concat(F.when(value < 0, "-").otherwise(""), whole, F.lit("."), F.lpad((thousandths % 1000).cast("string"), 3, "0"))


def best_so_far(rows: DataFrame, order: str, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """best_before, the least value of the earlier rows of a series, and is_best, whether a row is below it; by one range
    partitioning and one row for each part and series, like ema()."""
    parts = ordered(rows, *by, order)
    before = Window.partitionBy("_part", *by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    own = parts.withColumn("_own", F.min(value).over(before))
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    least = parts.groupBy(*by, "_part").agg(F.min(value).alias("_least")).select(*by, "_part", F.min("_least").over(earlier).alias("_given"))
    out = own.join(least, ["_part", *by]).withColumn("best_before", F.least("_own", "_given")).drop("_part", "_own", "_given")
    return out.withColumn("is_best", F.col("best_before").isNull() | (F.col(value) < F.col("best_before")))


def grow_depth(params: DataFrame, layers: int, target: int) -> DataFrame:
    """Layer l of the deeper model starts as layer l mod `layers`; columns layer and others."""
    plan = params.sparkSession.range(target).select(F.col("id").cast("int").alias("new_layer"), (F.col("id") % layers).cast("int").alias("layer"))
    return params.join(F.broadcast(plan), "layer").drop("layer").withColumnRenamed("new_layer", "layer")


def gradient(node: str, ops: dict[str, tuple[list[str], object]], seed: DataFrame) -> dict[str, DataFrame]:
    """Reverse mode over a graph of named nodes: ops gives each node's inputs and a function from its
    gradient to theirs. Contributions of several uses are added up. For fixture-sized graphs: the graph is
    walked on the driver, all arithmetic stays in DataFrames."""
    order, seen = [], set()

    def visit(name: str) -> None:
        if name not in seen:
            seen.add(name)
            for parent in ops.get(name, ([], None))[0]:
                visit(parent)
            order.append(name)

    visit(node)
    found: dict[str, list[DataFrame]] = {node: [seed]}
    out: dict[str, DataFrame] = {}
    for name in reversed(order):
        if name not in found:
            continue
        out[name] = accumulate(*found[name])
        parents, back = ops.get(name, ([], None))
        if back:
            for parent, g in zip(parents, back(out[name]), strict=True):
                found.setdefault(parent, []).append(g)
    return out
