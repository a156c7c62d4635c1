"""The parameter table of the transformer: its plan, its reproducible initial values, and the forward pass over it."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dokuma.functions import hashing
from dokuma.operators import tensor
from dokuma.session import stage

#: Deviation of the initial matrices.
SPREAD = 0.02


@dataclass(frozen=True)
class Parameter:
    index: int
    layer: int
    name: str
    rows: int
    cols: int
    fill: float | None  # None: normal draws


def parameters(vocabulary: int, width: int, layers: int, hidden: int) -> list[Parameter]:
    """All parameters in order: the embedding, ten of each layer, the last norm. Vectors have one row."""
    matrix, vector = (lambda n, r, c: (n, r, c, None)), (lambda n, c, v: (n, 1, c, v))
    layer = [
        vector("attn_norm", width, 1.0), matrix("qkv", width, 3 * width), vector("qkv_bias", 3 * width, 0.0), matrix("out", width, width), vector("out_bias", width, 0.0),
        vector("ffn_norm", width, 1.0), matrix("gate_up", width, 2 * hidden), vector("gate_up_bias", 2 * hidden, 0.0), matrix("down", hidden, width), vector("down_bias", width, 0.0),
    ]
    flat = [(-1, *matrix("embedding", vocabulary, width)), *((k, *p) for k in range(layers) for p in layer), (-1, *vector("norm", width, 1.0))]
    return [Parameter(i, *p) for i, p in enumerate(flat)]


def initial(spark: SparkSession, plan: list[Parameter], seed: int, sequence: int) -> DataFrame:
    """param_idx, layer, name, i, j, v. Each drawn element knows its number in the one stream of draws, so
    all are drawn in parallel and equal the values of drawing one after another."""

    @F.pandas_udf("double")
    def draw(number: pd.Series) -> pd.Series:
        return pd.Series(hashing.pcg_normal_at(seed, sequence, number.to_numpy(np.int64)) * SPREAD)

    rows, before = [], 0
    for p in plan:
        rows.append((p.index, p.layer, p.name, p.rows, p.cols, p.fill, before))
        before += p.rows * p.cols if p.fill is None else 0
    table = spark.createDataFrame(rows, "param_idx int, layer int, name string, n_rows long, n_cols long, fill double, before long")
    cells = table.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n_rows") - 1))).repartition("param_idx", "i")
    cells = cells.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n_cols") - 1)))
    number = F.when(F.col("fill").isNull(), F.col("before") + F.col("i") * F.col("n_cols") + F.col("j")).otherwise(0)
    return cells.withColumn("_d", draw(number)).select("param_idx", "layer", "name", "i", "j", F.coalesce("fill", "_d").alias("v"))


def logits(ids: DataFrame, params: DataFrame, heads: int, length: int) -> DataFrame:
    """i, j, v: the planned model's logits of each token j after row i. ids: i, token, in sequences of `length` rows one after
    another; params: the parameter table (layer, name, i, j, v). Embedding, a pre-norm block of each layer, the last norm,
    and the embedding's transpose as the output projection. Each layer's values are written, so plans do not grow with the
    number of layers."""
    sizes = {(r["layer"], r["name"]): r["n"] for r in params.groupBy("layer", "name").agg((F.max("j") + 1).alias("n")).collect()}  # a row for each parameter
    layers = 1 + max(layer for layer, _ in sizes)
    width = sizes[-1, "norm"]

    def of(layer: int, name: str) -> DataFrame:
        rows = params.where((F.col("layer") == layer) & (F.col("name") == name))
        if name.endswith("norm"):
            return rows.select("j", F.col("v").alias("w"))
        return rows.select("j", F.col("v").alias("b")) if name.endswith("bias") else rows.select("i", "j", "v")

    embedding = of(-1, "embedding")
    x = tensor.embed(ids, embedding)
    for layer in range(layers):
        weights = {name: of(layer, name) for at, name in sizes if at == layer}
        x = stage(tensor.multi_head_block(x, weights, heads, width, sizes[layer, "gate_up"] // 2, length), "layer")
    return tensor.matmul(tensor.rmsnorm(x, of(-1, "norm")), tensor.transpose(embedding))
