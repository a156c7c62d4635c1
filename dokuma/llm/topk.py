"""Exact top-k by inner product: columnar branch-and-bound over blocks of dimensions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dokuma.session import stage

#: Dimensions that are accumulated between two prunings, queries that are pruned together, and the share of
#: survivors below which they are compacted.
STEP, GROUP, COMPACT = 8, 128, 0.8
#: Levels of norms at most, by which blocks of rows are told apart.
LEVELS = 256
#: Magnitude below which float64 products and sums are exact.
EXACT = 2.0**53


def _dense(column: pa.Array) -> np.ndarray:
    """Rows by dimensions; shorter vectors are padded with zeros, which add nothing to a product."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), int(lengths.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def search_block(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int, floors: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, row number, score) of each query's k best rows, ties to the smaller id. floors: scores that k
    rows of each query are known to reach; rows below them are left out.

    Vectors lie by dimension. After each block of STEP dimensions a row's score is known within the product of the
    norms of what remains (Cauchy-Schwarz); rows that cannot reach the query's floor are dropped and the
    survivors compacted, from the first block on. Without a floor from elsewhere, the k-th best lower bound is one.
    """
    dims = max(queries.shape[1], rows.shape[1])
    widen = lambda m: np.pad(m, ((0, 0), (0, dims - m.shape[1])))
    queries, rows = widen(queries), widen(rows)
    peak = float(max(np.abs(queries).max(initial=0), 1)) * float(max(np.abs(rows).max(initial=0), 1)) * max(dims, 1)
    kind = np.float64 if peak < EXACT else object if peak >= 2.0**62 else np.int64
    # dimensions of large mass first: the bounds close sooner
    order = np.argsort(-(rows.astype(np.float64) ** 2).sum(0), kind="stable")
    q, r = queries[:, order].astype(kind), np.ascontiguousarray(rows[:, order].T.astype(kind))
    left_q = np.sqrt(np.cumsum((q.astype(np.float64) ** 2)[:, ::-1], 1)[:, ::-1])
    left_r = np.sqrt(np.cumsum((r.astype(np.float64) ** 2)[::-1], 0)[::-1])
    floors = np.full(len(q), -np.inf) if floors is None else floors
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for lo in range(0, len(q), GROUP):
        own, ids, known = q[lo : lo + GROUP], query_ids[lo : lo + GROUP], floors[lo : lo + GROUP].copy()
        at, score = np.arange(r.shape[1]), np.zeros((len(own), r.shape[1]), kind)
        # a query's own rows may be among the k best lower bounds
        spare = k + int(np.bincount(np.searchsorted(ids, row_ids[np.isin(row_ids, ids)]), minlength=1).max()) if (np.diff(ids) > 0).all() else r.shape[1]
        for d in range(0, dims, STEP):
            to = min(d + STEP, dims)
            score = score + own[:, d:to] @ (r[d:to] if len(at) == r.shape[1] else r[d:to, at])
            if to == dims or not len(at):
                break
            near, slack = score.astype(np.float64), left_q[lo : lo + GROUP, to, None] * left_r[to, at] * (1 + 1e-9) + 1e-6
            unknown = np.flatnonzero(np.isneginf(known)) if len(at) > spare else []
            if len(unknown) and 2 * to >= dims:
                known[unknown] = np.partition(near[unknown] - slack[unknown], len(at) - spare, axis=1)[:, len(at) - spare]
            alive = (near + slack >= known[:, None]).any(0)
            if alive.mean() < COMPACT:
                score, at = np.ascontiguousarray(score[:, alive]), at[alive]
        if kind is object:
            score = np.clip(score, -(2**63), 2**63 - 1).astype(np.int64)
        for i in range(len(own)):
            keep = np.flatnonzero((score[i] >= known[i]) & (row_ids[at] != ids[i]))
            if len(keep) > 4 * k:
                least = np.partition(score[i, keep], len(keep) - k)[len(keep) - k]
                keep = keep[score[i, keep] >= least]
            value = score[i, keep].astype(np.int64)
            # ~value falls where value rises, the least long included
            best = np.lexsort((row_ids[at[keep]], ~value))[:k]
            out.append((np.full(len(best), lo + i), at[keep[best]], value[best]))
    if not out:
        e = np.zeros(0, np.int64)
        return e, e, e
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def top_k(vectors: DataFrame, id_col: str, vec_col: str, is_query, k: int, query_block: int = 2048, row_block: int = 16384) -> DataFrame:
    """The k rows of highest integer inner product for every query row, exactly.

    Vectors are floor(64 * component), components taken as double. A vector that is null, or holds a
    null or non-finite component, takes no part, nor does a row without an id; an empty vector scores 0.
    Nor does a vector with a component whose floor(64 * x) leaves 64 bits. Products are summed exactly; a score that leaves
    64 bits is returned, and ranked, as the nearest one that does not. A query's own row is the row with its
    id (repeats of that id included). Fewer than k others: all of them. Ties go to the smaller id; repeated ids
    are separate candidates. An empty table gives an empty table; other columns are not looked at.

    The stated queries meet all rows block against block: neither side is collected or broadcast. Rows are dealt to
    blocks by falling norm, so the first block holds the likeliest ones: it is searched first, and each query's k-th
    score there is a floor that all other blocks share. A block whose norms cannot reach a query's floor does not
    meet that query at all; each block's k best at or above the floor are merged by query.
    """
    spark = vectors.sparkSession
    ok = F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & F.forall(F.col(vec_col), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    fits = F.forall(F.col(vec_col), lambda x: (x.cast("double") >= F.lit(-(2.0**57))) & (x.cast("double") < F.lit(2.0**57)))
    whole = F.transform(F.col(vec_col), lambda x: F.floor(x.cast("double") * 64))
    taken = vectors.where(ok).where(fits).select(F.col(id_col).cast("long").alias("id"), whole.alias("v"), is_query.alias("q"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    base = stage(taken.withColumn("norm", norm), "vectors")
    n, nq = base.agg(F.count("*"), F.count_if("q")).first()
    rb, qb = max(1, -(-n // row_block)), max(1, -(-nq // query_block))
    if n and rb * qb < spark.sparkContext.defaultParallelism:
        rb = max(rb, min(spark.sparkContext.defaultParallelism, -(-n // 512)))
    # norms at the levels' edges, falling; blocks of one level are told apart by hash
    wanted = min(rb, LEVELS)
    found_edges = base.select(F.percentile_approx("norm", [1 - i / wanted for i in range(1, wanted)], 10_000)).first()[0] if n and wanted > 1 else []
    edges = F.array(*(F.lit(e) for e in sorted(set(found_edges), reverse=True))) if found_edges else F.array().cast("array<double>")
    each = -(-rb // (len(set(found_edges)) + 1))
    below = F.size(F.filter(edges, lambda e: F.col("norm") < e))
    spread = lambda m: F.pmod(F.xxhash64("id", "v"), F.lit(m)).cast("int")
    rows = base.select("id", "v", (below * each + spread(each)).alias("rb"))
    queries = base.where("q").select("id", "v", "norm", spread(qb).alias("qb"))

    def search(table: pa.Table) -> pa.Table:
        q = table.column("q").to_numpy()
        ids, vecs = table.column("id").to_numpy(), _dense(table.column("v"))
        floors = table.column("floor").to_numpy()[q]
        qi, ri, score = search_block(vecs[q], ids[q], vecs[~q], ids[~q], k, floors)
        return pa.table({"query_id": ids[q][qi], "vec_id": ids[~q][ri], "score": score})

    def meet(asked: DataFrame, held: DataFrame, pairs: DataFrame) -> DataFrame:
        """asked (id, v, floor, qb, rb) against the rows of their blocks; pairs: the blocks (rb, qb) that meet."""
        rows_ = held.join(pairs, "rb").select("id", "v", F.lit(False).alias("q"), F.lit(float("-inf")).alias("floor"), "rb", "qb")
        both = rows_.unionByName(asked.select("id", "v", F.lit(True).alias("q"), "floor", "rb", "qb"))
        return both.groupBy("rb", "qb").applyInArrow(search, "query_id long, vec_id long, score long")

    first = queries.withColumns({"floor": F.lit(float("-inf")), "rb": F.lit(0)})
    found = stage(meet(first, rows.where("rb = 0"), first.select("rb", "qb").distinct()), "first")
    floors = found.groupBy(F.col("query_id").alias("id")).agg(F.count("*").alias("n"), F.min("score").alias("least"))
    floor = F.when(F.col("n") >= k, F.col("least").cast("double")).otherwise(F.lit(float("-inf")))
    floored = queries.join(floors, "id", "left").select("id", "v", "qb", "norm", F.coalesce(floor, F.lit(float("-inf"))).alias("floor"))
    # levels fall, so the blocks that a query can gain from are the first ones
    reached = F.size(F.filter(edges, lambda e: F.col("norm") * e * F.lit(1 + 1e-9) + F.lit(1e-6) >= F.col("floor")))
    last = (reached + 1) * each - 1
    rest = stage(floored.where(last >= 1).withColumn("rb", F.explode(F.sequence(F.lit(1), last))).select("id", "v", "floor", "qb", "rb"), "asked")
    others = meet(rest, rows, rest.select("rb", "qb").distinct())
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.unionByName(others).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def merge_queries(*found: DataFrame, k: int) -> DataFrame:
    """Results of several searches of the same queries (say, one for each new batch of rows) as one."""
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    all_ = found[0]
    for more in found[1:]:
        all_ = all_.unionByName(more)
    return all_.drop("rank").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

