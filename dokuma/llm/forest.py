"""MinHash near-duplicates by an LSH forest: signatures in several sorted orders, candidates among the
neighbours of longest common prefix, links confirmed on whole shingle sets, components over the links.

The depth adapts to the region: a region (rows that share so many minima) is descended into until what is left
is small enough for all its pairs. What shares only a crowded region is then compared whole, block by
block, where components are left to join. Rows of equal sets are one node, known by one row's number."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dokuma.llm.common import LOWER, U64, batch_of, key_columns, mix, parts, ramp, release, run_hash, sequence_sums, span_hash, texts, trimmed, words
from dokuma.llm.components import components
from dokuma.session import Rows, stage

SHINGLE = 5
#: Sorted orders, and minima in each one's key; neighbours must share the first ROOT of them.
TREES, DEPTH, ROOT = 16, 8, 3
#: Rows of a region up to which all its pairs are candidates; in a larger one that has no smaller region
#: within, so many nearest neighbours are, and the rest are compared in blocks.
SMALL, NEAR = 9, 3
#: Rows and shingles of a block of a larger region, about, and shingles that are compared at a time.
BLOCK_ROWS, BLOCK_SHINGLES, COLUMNS = 512, 400_000, 4096
#: Bytes of a group of blocks after which freed memory is given back.
RELEASE = 4 << 20
#: Pairs that are counted one by one at a time, and how much dearer that is than their product in a matrix.
PAIRS, DENSE = 1 << 21, 64
#: Bytes of a sketch, and how many must agree: 15 of 32 is 3.7 deviations below a similarity of 0.75.
SKETCH, AGREE = 32, 15

_rng = np.random.Generator(np.random.PCG64(977))
FACTORS = (_rng.integers(0, 2**31, TREES * DEPTH, dtype=np.uint32) * np.uint32(2) + np.uint32(1)).astype(np.uint32)


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes by text in rising order, and each text's first place among them."""
    low = LOWER[data]
    w0, w1, first = words(low, offsets)
    count = np.diff(first)
    number = np.where(count >= SHINGLE, count - SHINGLE + 1, np.minimum(count, 1))
    doc = np.repeat(np.arange(len(count)), number)
    start = first[doc] + ramp(number)
    hashes = run_hash(sequence_sums(span_hash(low, w0, w1)), start, start + np.minimum(count, SHINGLE)[doc])
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    keep = np.ones(len(doc), bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    hashes, doc = hashes[keep], doc[keep]
    return hashes, np.searchsorted(doc, np.arange(len(count) + 1))


def signatures(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """TREES * DEPTH minima of each non-empty set, by set."""
    full = np.flatnonzero(np.diff(at))
    out = np.zeros((len(at) - 1, len(FACTORS)), np.uint32)
    if len(full):
        h, begin = (hashes ^ (hashes >> U64(32))).astype(np.uint32), at[full]
        for p, a in enumerate(FACTORS):
            x = h * a
            x ^= x >> np.uint32(15)
            x *= np.uint32(0x2C1B3C6D)
            out[full, p] = np.minimum.reduceat(x, begin)
    return out


def _describe(rows: DataFrame) -> DataFrame:
    """row, doc_id, tie, n (set size), d1 and d2 (a digest of the set), sig (minima, big-endian)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = texts(batch.column(3))
            for lo, hi in parts(offsets):
                hashes, at = shingles(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                digests = []
                for seed in (U64(0x6A09E667F3BCC909), U64(0xBB67AE8584CAA73B)):
                    sums = np.concatenate([np.zeros(1, U64), np.cumsum(mix(hashes ^ seed), dtype=U64)])
                    digests.append(pa.array(mix(sums[at[1:]] - sums[at[:-1]]).astype(np.int64), pa.int64()))
                sig = signatures(hashes, at).astype(">u4")
                kept = [batch.column(i).slice(lo, hi - lo) for i in range(3)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(np.diff(at), pa.int64()), *digests, pa.array([r.tobytes() for r in sig], pa.binary())], names=["row", "doc_id", "tie", "n", "d1", "d2", "sig"])

    return rows.mapInArrow(trimmed(run), "row long, doc_id long, tie long, n long, d1 long, d2 long, sig binary")


def _orders(reps: DataFrame) -> DataFrame:
    """Each signature in every order: v (tree and its minima), key, sketch."""
    picked = [t * DEPTH + d for d in (DEPTH - 1, DEPTH - 2) for t in range(TREES)][:SKETCH]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(n, TREES, DEPTH * 4)
            v = np.empty((n, TREES, DEPTH * 4 + 1), np.uint8)
            v[:, :, 0], v[:, :, 1:] = np.arange(TREES), sig
            sketch = sig.reshape(n, TREES * DEPTH, 4)[:, picked, 3]
            key = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), TREES)
            fixed = lambda a, w: pa.Array.from_buffers(pa.binary(w), a.size // w, [None, pa.py_buffer(np.ascontiguousarray(a))]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([fixed(v, DEPTH * 4 + 1), pa.array(key), fixed(np.repeat(sketch, TREES, 0), SKETCH)], names=["v", "key", "sketch"])

    return reps.select("node", "sig").mapInArrow(trimmed(run), "v binary, key long, sketch binary")


def _neighbours(orders: DataFrame) -> DataFrame:
    """Candidate pairs a < b among the neighbours of longest common prefix; early marks the nearest
    neighbours of the first orders. The orders are sorted globally, so a region may span tasks; where a
    region goes on in the next tasks, the rows at the border are paired in a second step."""
    width = DEPTH * 4 + 1
    names, kinds = ["a", "b", "early", "task", "edge", "v", "sketch"], [pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]

    def pair(v: np.ndarray, key: np.ndarray, sketch: np.ndarray, fresh: int) -> tuple[np.ndarray, ...]:
        """Pairs whose later row is among the last `fresh` ones."""
        n = len(key)
        # minima in common with the row before, and the regions of each depth
        same = (v[1:, 1:] == v[:-1, 1:]).reshape(n - 1, DEPTH, 4).all(2)
        shared = np.where(v[1:, 0] == v[:-1, 0], np.cumprod(same, 1).sum(1), -1)
        regions = []
        for depth in range(ROOT, DEPTH + 1):
            run = np.concatenate([[0], np.cumsum(shared < depth)])
            regions.append((run, np.bincount(run)[run] <= SMALL))
        found = []
        for d in range(1, SMALL):
            later = np.arange(max(d, n - fresh), n)
            fits = np.zeros(len(later), bool)
            for depth, (run, few) in enumerate(regions):
                fits |= (run[later] == run[later - d]) & (few[later] | (depth == 0 and d <= NEAR))
            later = later[fits]
            later = later[((sketch[later] == sketch[later - d]).sum(1) >= AGREE) & (key[later] != key[later - d])]
            found.append((key[later - d], key[later], (v[later, 0] < NEAR) & (d == 1)))
        a, b, early = (np.concatenate(x) for x in zip(*found, strict=True))
        return np.minimum(a, b), np.maximum(a, b), early

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, held, done = TaskContext.get().partitionId(), None, 0

        def edges(rows: tuple[np.ndarray, ...], lo: int, hi: int) -> pa.RecordBatch:
            """Rows lo to hi, of which the last is row done - 1 of the task."""
            v, key, sketch = rows
            return batch_of([(int(key[i]), 0, False, task, done - len(key) + i, v[i].tobytes(), sketch[i].tobytes()) for i in range(lo, hi)], names, kinds)

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            v = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(n, width)
            key = batch.column(1).to_numpy(zero_copy_only=False)
            sketch = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(n, SKETCH)
            done += n
            if done - n < SMALL - 1:
                yield edges((v, key, sketch), 0, min(n, SMALL - 1 - (done - n)))
            if held is not None:
                v, key, sketch = (np.concatenate([h, x]) for h, x in zip(held, (v, key, sketch), strict=True))
            a, b, early = pair(v, key, sketch, n)
            held = v[-SMALL:], key[-SMALL:], sketch[-SMALL:]
            m, none = len(a), [None] * len(a)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(early), pa.array(none, pa.int32()), pa.array([-1] * m, pa.int64()), pa.array(none, pa.binary()), pa.array(none, pa.binary())], names=names)
        if done > SMALL - 1:  # those at the start are there already
            least = max(done - (SMALL - 1), SMALL - 1)
            yield edges(held, len(held[1]) - (done - least), len(held[1]))

    spark = orders.sparkSession
    many = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    made = stage(orders.repartitionByRange(many, "v", "key").sortWithinPartitions("v", "key").mapInArrow(trimmed(run), "a long, b long, early boolean, task int, edge long, v binary, sketch binary"), "neighbours")

    def border(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: (r["task"], r["edge"]))
        found = []
        for d in range(1, SMALL):
            for x, y in zip(rows, rows[d:], strict=False):
                if x["task"] != y["task"] and x["v"][: 1 + 4 * ROOT] == y["v"][: 1 + 4 * ROOT] and x["a"] != y["a"] and sum(p == q for p, q in zip(x["sketch"], y["sketch"], strict=True)) >= AGREE:
                    found.append((min(x["a"], y["a"]), max(x["a"], y["a"]), x["v"][0] < NEAR and d == 1))
        yield batch_of(found, ["a", "b", "early"], [pa.int64(), pa.int64(), pa.bool_()])

    # SMALL - 1 rows at each end of each task of the sort
    borders = made.where("edge >= 0").coalesce(1).mapInArrow(border, "a long, b long, early boolean")
    return made.where("edge < 0").select("a", "b", "early").unionByName(borders).groupBy("a", "b").agg(F.max("early").alias("early"))


def _crowds(orders: DataFrame) -> DataFrame:
    """region, key: the rows of the regions of more than SMALL rows."""
    rows = stage(orders.select(F.xxhash64(F.substring("v", 1, 1 + 4 * ROOT)).alias("region"), "key"), "regions")
    large = rows.groupBy("region").count().where(F.col("count") > SMALL).select("region")
    return stage(rows.join(large, "region"), "crowds")


def _wide(body: bytes) -> np.ndarray:
    return np.frombuffer(body, ">u8").astype(U64)


def common_counts(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """How many values each set of x shares with each of y. Values that lie in the same sets count together;
    those in few sets are counted pair by pair, the others by products of bit matrices."""
    sizes = np.array([len(s) for s in (*x, *y)])
    _, column, times = np.unique(np.concatenate([*x, *y]), return_inverse=True, return_counts=True)
    row, first = np.repeat(np.arange(len(sizes)), sizes), len(x)
    in_x = np.bincount(column[row < first], minlength=len(times))
    both = (in_x > 0) & (in_x < times)
    total = np.zeros(len(x) * len(y))
    if not both.any():
        return total.astype(np.int64).reshape(len(x), len(y))
    keep = both[column]
    row, column = row[keep], (np.cumsum(both) - 1)[column[keep]]
    order = np.argsort(column, kind="stable")  # by value, rows of x before rows of y
    row, column, in_x, times = row[order], column[order], in_x[both], times[both]
    tag = np.random.Generator(np.random.PCG64(31)).integers(0, 2**64, len(sizes), dtype=U64)
    start = np.concatenate([[0], np.cumsum(times)])
    _, pick, weight = np.unique(np.add.reduceat(tag[row], start[:-1]), return_index=True, return_counts=True)
    start, in_x, in_y = start[pick], in_x[pick], times[pick] - in_x[pick]
    few = in_x * in_y * DENSE < len(x) * len(y)

    # each row of x with each of y, for values in few sets
    at = np.repeat(np.flatnonzero(few), in_x[few])
    left = row[start[at] + ramp(in_x[few])]
    ends = np.cumsum(in_y[at])
    lo = 0
    while lo < len(at):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] - in_y[at[lo]] + PAIRS, "right")))
        part, n = at[lo:hi], in_y[at[lo:hi]]
        right = row[np.repeat(start[part] + in_x[part], n) + ramp(n)] - first
        total += np.bincount(np.repeat(left[lo:hi], n) * len(y) + right, np.repeat(weight[part], n), len(total))
        lo = hi

    total, many = total.reshape(len(x), len(y)), np.flatnonzero(~few)
    for lo in range(0, len(many), COLUMNS):
        part = many[lo : lo + COLUMNS]
        n = in_x[part] + in_y[part]
        has = np.zeros((len(sizes), len(part)), np.float32)  # whole numbers, exact up to 2^24
        has[row[np.repeat(start[part], n) + ramp(n)], np.repeat(np.arange(len(part)), n)] = 1
        total += (has[:first] * weight[part].astype(np.float32)) @ has[first:].T
    return total.astype(np.int64)


def _join_crowds(crowds: DataFrame, roots: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between components that lie in one large region: all its rows are compared on whole sets.

    Rows are dealt to blocks by hash and each two blocks are a task's group, so a hot region is many groups."""

    def run(table: pa.Table) -> pa.Table:
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        block, root, n = (table.column(c).to_numpy() for c in ("block", "root", "n"))
        bodies = table.column("body").to_pylist()
        x, y = np.flatnonzero(block == i), np.flatnonzero(block == j)
        links = []
        # sizes alone rule some pairs out
        open_ = (100 * np.minimum(n[x][:, None], n[y][None]) >= percent * np.maximum(n[x][:, None], n[y][None])) & (root[x][:, None] != root[y][None])
        x, y = x[open_.any(1)], y[open_.any(0)]
        if len(x):
            sets_ = [_wide(b) for b in bodies]
            common = common_counts([sets_[k] for k in x], [sets_[k] for k in y])
            hit = (100 * common >= percent * (n[x][:, None] + n[y][None] - common)) & (root[x][:, None] != root[y][None])
            p, q = np.nonzero(hit)
            pairs = np.unique(np.sort(np.stack([root[x[p]], root[y[q]]], 1), 1), axis=0)
            least: dict[int, int] = {}

            def find(k: int) -> int:
                while least.get(k, k) != k:
                    k = least[k] = least.get(least[k], least[k])
                return k

            for a, b in pairs.tolist():  # only the links that join
                if (u := find(a)) != (w := find(b)):
                    least[max(u, w)] = min(u, w)
                    links.append((a, b))
        if table.nbytes > RELEASE:
            release()
        return pa.Table.from_batches([batch_of(links, ["a", "b"], [pa.int64(), pa.int64()])])

    joined = stage(crowds.join(roots, F.col("key") == F.col("node"), "left").select("region", "key", F.coalesce("root", "key").alias("root")).join(sets.select("key", "n"), "key"), "joined")
    # rows of a region's largest component need no comparison with each other
    sizes = joined.groupBy("region", "root").agg(F.count("*").alias("m"), F.sum("n").alias("s"))
    of = sizes.groupBy("region").agg(F.max(F.struct("m", "root", "s")).alias("top"), F.sum("m").alias("m"), F.sum("s").alias("s"), F.count("*").alias("roots")).where("roots > 1")
    blocks = lambda m, s: F.greatest(F.ceil(m / BLOCK_ROWS), F.ceil(s / BLOCK_SHINGLES)).cast("int")
    live = stage(of.select("region", F.col("top.root").alias("giant"), blocks(F.col("top.m"), F.col("top.s")).alias("big"), blocks(F.col("m") - F.col("top.m"), F.col("s") - F.col("top.s")).alias("rest")), "live")
    dealt = joined.drop("n").join(live, "region")
    inner = F.col("root") == F.col("giant")
    dealt = dealt.withColumn("block", F.when(inner, F.pmod(F.xxhash64("key"), "big")).otherwise(F.col("big") + F.pmod(F.xxhash64("key"), "rest")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.when(inner, F.col("big")).otherwise(F.lit(0)), F.col("big") + F.col("rest") - 1)))
    dealt = dealt.select("key", "region", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "root")
    dealt = dealt.join(sets, "key").select("region", "i", "j", "block", "root", "n", "body")
    return dealt.groupBy("region", "i", "j").applyInArrow(run, "a long, b long").distinct()


def _sets(rows: Rows, involved: DataFrame) -> DataFrame:
    """Whole shingle sets (hashes of 64 bits, in rising order) of the rows that candidates name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = texts(batch.column(1))
            for lo, hi in parts(offsets):
                hashes, at = shingles(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                body = hashes.astype(">u8").tobytes()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(at), pa.int64()), pa.array([body[8 * x : 8 * y] for x, y in zip(at, at[1:], strict=False)], pa.binary())], names=["key", "n", "body"])

    return stage(rows.where(involved).select(rows.id, "text").mapInArrow(trimmed(run), "key long, n long, body binary"), "sets")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose whole sets have 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n, m, x, y = (batch.column(i).to_pylist() for i in range(6))
            rows, kept, of = [], None, None
            for i in range(len(a)):
                if of != a[i]:
                    of, kept = a[i], _wide(x[i])
                both = np.sort(np.concatenate([kept, _wide(y[i])]))
                common = int((both[1:] == both[:-1]).sum())
                if 100 * common >= percent * (n[i] + m[i] - common):
                    rows.append((a[i], b[i]))
            yield batch_of(rows, ["a", "b"], [pa.int64(), pa.int64()])

    sized = pairs.join(sets.select(F.col("key").alias("a"), "n"), "a").join(sets.select(F.col("key").alias("b"), F.col("n").alias("m")), "b")
    # sizes alone rule some pairs out
    possible = sized.where(100 * F.least("n", "m") >= percent * F.greatest("n", "m")).select("a", "b", "n", "m")
    first = possible.join(sets.select(F.col("key").alias("a"), F.col("body").alias("x")), "a")
    both = first.join(sets.select(F.col("key").alias("b"), F.col("body").alias("y")), "b").select("a", "b", "n", "m", "x", "y")
    return both.mapInArrow(trimmed(run), "a long, b long")


def _components(rows: Rows, percent: int) -> tuple[DataFrame, DataFrame]:
    """What is known of each row (row, doc_id, tie, n, d1, d2), and of each class of equal sets: d1, d2 and `least`,
    the first row (doc_id, tie, row; null ids first) of its component."""
    _, tie = key_columns()
    about = stage(_describe(rows.df.select(F.col(rows.id).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), tie.alias("tie"), "text")), "signatures")
    order = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "tie", "row")
    classes = stage(about.where("n > 0").groupBy("d1", "d2").agg(F.min(F.struct("row", "sig")).alias("r"), F.min(order).alias("least")).select("d1", "d2", F.col("r.row").alias("node"), F.col("r.sig").alias("sig"), "least"), "classes")
    pairs, crowds = stage(_neighbours(_orders(classes)), "pairs"), _crowds(_orders(classes))
    sets = _sets(rows, pairs.select("a").unionByName(pairs.select(F.col("b").alias("a"))).unionByName(crowds.select(F.col("key").alias("a"))))
    early = stage(_confirm(pairs.where("early"), sets, percent), "early")
    roots = stage(components(early), "roots")
    # what is not joined yet: the other candidates across components
    root = lambda c, to: roots.select(F.col("node").alias(c), F.col("root").alias(to))
    rest = pairs.where("not early").join(root("a", "ra"), "a", "left").join(root("b", "rb"), "b", "left")
    rest = rest.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")
    late = stage(_confirm(rest, sets, percent), "late")
    joined = lambda links: stage(components(links.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))), "roots")
    if not late.isEmpty():
        roots = joined(late)
    # what neighbours alone do not find in a crowded region
    crowded = stage(_join_crowds(crowds, roots, sets, percent), "crowded")
    if not crowded.isEmpty():
        roots = joined(crowded)
    rooted = stage(classes.select("d1", "d2", "node", "least").join(roots, "node", "left").select("d1", "d2", F.coalesce("root", "node").alias("root"), "least"), "rooted")
    first = rooted.groupBy("root").agg(F.min("least").alias("least"))
    return about.drop("sig"), rooted.drop("least").join(first, "root").select("d1", "d2", "least")


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row.

    A set holds the distinct 5-word shingles of a text, A-Z in lower case; a shorter text is one shingle,
    a text without words (or null) has none and is linked with nothing. Links join sets with at least
    `percent` hundredths of their union in common. component_id is the least doc_id that links reach (null is
    the least), kept tells whether it is the row's own doc_id. Repeated rows, and rows that share a doc_id, are
    each judged by their own text. An empty table gives an empty table; columns other than doc_id and text
    are not looked at.
    """
    about, found = _components(Rows(docs.select("doc_id", "text"), "texts"), percent)
    full = about.where("n > 0").join(found, ["d1", "d2"]).select("doc_id", F.col("n").alias("n_shingles"), F.col("least.doc_id").alias("component_id"))
    bare = about.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return full.unionByName(bare).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """One row of each component, the one of least doc_id (of several such, of the least text hash), and all
    rows without words. The rows keep all their columns, whatever their names; null ids, repeated ids and
    empty tables are allowed, as in near_duplicates."""
    rows = Rows(docs, "texts")
    about, found = _components(rows, percent)
    stay = found.select(F.col("least.row").alias("row")).distinct().unionByName(about.where("n = 0").select("row"))
    return rows.where(stay).select(*docs.columns)
