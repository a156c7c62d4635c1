"""Tensors in tiles: blocks of values in one row each, so that products join and shuffle blocks, not entries."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructType

#: Rows and columns of a tile, and bytes of unfinished sums that a task holds before it sends them on.
SIZE, HELD = 64, 64 << 20
#: Columns of a table of tiles, after those that tell tensors apart: places in units of tiles, shape, and the values row by row.
TILE = StructType().add("ti", LongType()).add("tj", LongType()).add("height", IntegerType()).add("width", IntegerType()).add("cells", BinaryType())


def _schema(df: DataFrame, by: tuple[str, ...], more: StructType) -> StructType:
    return StructType([*(df.schema[c] for c in by), *more.fields])


def _arrow(rows: list[tuple], by: list[pa.Field], names: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    fields = [*((f.name, f.type) for f in by), *names]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(fields)], names=[n for n, _ in fields])


_TILE = [("ti", pa.int64()), ("tj", pa.int64()), ("height", pa.int32()), ("width", pa.int32()), ("cells", pa.binary())]


def _matrix(cells: bytes, width: int) -> np.ndarray:
    return np.frombuffer(cells, "<f8").reshape(-1, width)


def _cut(m: np.ndarray, size: int, ti: int = 0, tj: int = 0) -> Iterator[tuple[int, int, int, int, bytes]]:
    """The tiles of a matrix whose first place is tile (ti, tj)."""
    for a in range(0, m.shape[0], size):
        for b in range(0, m.shape[1], size):
            part = np.ascontiguousarray(m[a : a + size, b : b + size], "<f8")
            yield ti + a // size, tj + b // size, *part.shape, part.tobytes()


def of_entries(a: DataFrame, by: tuple[str, ...] = (), size: int = SIZE) -> DataFrame:
    """Tiles of a tensor of rows (i, j, v); places without a row are zero. A tile has the shape that its largest places
    need, `size` at most: products pad the smaller one."""

    def pack(table: pa.Table) -> pa.Table:
        i, j, v = (table.column(c).to_numpy() for c in ("i", "j", "v"))
        ti, tj = int(i[0]) // size, int(j[0]) // size
        m = np.zeros((int(i.max()) % size + 1, int(j.max()) % size + 1))
        np.add.at(m, (i % size, j % size), v)
        key = tuple(table.column(c)[0].as_py() for c in by)
        return pa.Table.from_batches([_arrow([(*key, *t) for t in _cut(m, size, ti, tj)], [table.schema.field(c) for c in by], _TILE)])

    rows = a.select(*by, F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "v", F.floor(F.col("i") / size).alias("ti"), F.floor(F.col("j") / size).alias("tj"))
    return rows.groupBy(*by, "ti", "tj").applyInArrow(pack, _schema(a, by, TILE))


def of_rows(df: DataFrame, i: str, vector: str, by: tuple[str, ...] = (), size: int = SIZE) -> DataFrame:
    """Tiles of a tensor whose rows are arrays: what moves is a row of the table, not an entry. Numbers of rows must be unique."""

    def pack(table: pa.Table) -> pa.Table:
        at = table.column("_i").to_numpy()
        vectors = table.column("_v").to_pylist()
        m = np.zeros((int(at.max()) % size + 1, max(map(len, vectors))))
        for n, v in zip(at.tolist(), vectors, strict=True):
            m[n % size, : len(v)] = v
        key = tuple(table.column(c)[0].as_py() for c in by)
        return pa.Table.from_batches([_arrow([(*key, *t) for t in _cut(m, size, int(at[0]) // size)], [table.schema.field(c) for c in by], _TILE)])

    rows = df.where(F.col(vector).isNotNull()).select(*by, F.col(i).cast("long").alias("_i"), F.col(vector).cast("array<double>").alias("_v"), F.floor(F.col(i) / size).alias("_t"))
    return rows.groupBy(*by, "_t").applyInArrow(pack, _schema(df, by, TILE))


def entries(tiles: DataFrame, by: tuple[str, ...] = (), size: int = SIZE) -> DataFrame:
    """The rows (i, j, v) of all places of the tiles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                ti, tj, height, width, cells = (batch.column(c)[n].as_py() for c in TILE.names)
                i, j = np.divmod(np.arange(height * width), width)
                keys = [pa.repeat(batch.column(c)[n], height * width) for c in by]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(ti * size + i), pa.array((tj * size + j).astype(np.int32)), pa.array(np.frombuffer(cells, "<f8"))], names=[*by, "i", "j", "v"])

    return tiles.select(*by, *TILE.names).mapInArrow(run, _schema(tiles, by, StructType.fromDDL("i long, j int, v double")))


def _padded_sum(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if a.shape == b.shape:
        return a + b
    out = np.zeros(np.maximum(a.shape, b.shape))
    out[: a.shape[0], : a.shape[1]] += a
    out[: b.shape[0], : b.shape[1]] += b
    return out


def _summed(df: DataFrame, partial: Callable[[pa.RecordBatch], Iterator[tuple[tuple, np.ndarray]]], by: tuple[str, ...], places: Callable[[tuple, np.ndarray], Iterator[tuple]]) -> DataFrame:
    """Tiles of the sums, by key, of the matrices that partial() makes of each batch: added up within a task first, so a tile
    is sent about once by each task. A key begins with the values of `by`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        fields: list[pa.Field] = []

        def send() -> pa.RecordBatch:
            rows = [(*key[: len(by)], *tile) for key, m in held.items() for tile in places(key[len(by) :], m)]
            held.clear()
            return _arrow(rows, fields, _TILE)

        for batch in batches:
            fields = [batch.schema.field(c) for c in by]
            for key, m in partial(batch):
                held[key] = _padded_sum(held[key], m) if key in held else m
            if sum(m.nbytes for m in held.values()) > HELD:
                yield send()
        if held:
            yield send()

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros((0, 0))
        for cells, width in zip(table.column("cells").to_pylist(), table.column("width").to_pylist(), strict=True):
            total = _padded_sum(total, _matrix(cells, width))
        key = tuple(table.column(c)[0].as_py() for c in (*by, "ti", "tj"))
        return pa.Table.from_batches([_arrow([(*key, *total.shape, np.ascontiguousarray(total, "<f8").tobytes())], [table.schema.field(c) for c in by], _TILE)])

    out = _schema(df, by, TILE)
    return df.mapInArrow(run, out).groupBy(*by, "ti", "tj").applyInArrow(add, out)


def product(a: DataFrame, b: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Tiles of (i, k) x (k, j), for each tensor in `by` on its own: tiles meet by k, one row for each product of two tiles."""
    left = a.select(*by, "ti", F.col("tj").alias("_k"), F.col("width").alias("_wx"), F.col("cells").alias("_x"))
    right = b.select(*by, F.col("ti").alias("_k"), "tj", F.col("width").alias("_wy"), F.col("cells").alias("_y"))

    def partial(batch: pa.RecordBatch) -> Iterator[tuple[tuple, np.ndarray]]:
        columns = [batch.column(c).to_pylist() for c in (*by, "ti", "tj", "_wx", "_x", "_wy", "_y")]
        for *key, wx, x, wy, y in zip(*columns, strict=True):
            m, n = _matrix(x, wx), _matrix(y, wy)
            k = min(m.shape[1], n.shape[0])  # what one of the two lacks is zero
            yield tuple(key), m[:, :k] @ n[:k]

    return _summed(left.join(right, [*by, "_k"]), partial, by, lambda key, m: iter([(*key, *m.shape, np.ascontiguousarray(m, "<f8").tobytes())]))


def transpose(tiles: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            turned = [np.ascontiguousarray(_matrix(c, w).T).tobytes() for c, w in zip(batch.column("cells").to_pylist(), batch.column("width").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*by, "tj", "ti", "width", "height")), pa.array(turned, pa.binary())], names=[*by, *TILE.names])

    return tiles.select(*by, *TILE.names).mapInArrow(run, _schema(tiles, by, TILE))


def gram(df: DataFrame, vector: str, by: tuple[str, ...] = (), size: int = SIZE) -> DataFrame:
    """Tiles of X^T X for the rows X (arrays) of each group in `by`: summed where the rows lie, so no row moves. A task holds a
    matrix of the vectors' length squared for each group that it sees, HELD bytes in all before it sends them on."""

    def partial(batch: pa.RecordBatch) -> Iterator[tuple[tuple, np.ndarray]]:
        keys = list(zip(*(batch.column(c).to_pylist() for c in by), strict=True)) if by else [()] * batch.num_rows
        groups: dict[tuple, list[int]] = {}
        for n, key in enumerate(keys):
            groups.setdefault(key, []).append(n)
        vectors = batch.column("_v").to_pylist()
        for key, rows in groups.items():
            x = np.zeros((len(rows), max(len(vectors[n]) for n in rows)))
            for at, n in enumerate(rows):
                x[at, : len(vectors[n])] = vectors[n]
            yield key, x.T @ x

    rows = df.where(F.col(vector).isNotNull()).select(*by, F.col(vector).cast("array<double>").alias("_v"))
    return _summed(rows, partial, by, lambda key, m: _cut(m, size))


def attention(rows: DataFrame, width: int, by: tuple[str, ...] = (), size: int = SIZE) -> DataFrame:
    """by, i, v (an array): softmax(q k^T / sqrt(width)) v of the rows (by, i, q, k, v; arrays), where row i of a sequence sees
    its rows up to i. Bands of `size` rows meet the bands up to their own; each pair gives the greatest score, the sum of exponentials
    and the weighted values of its rows, which are combined within a task and then by band."""
    bands = _schema(rows, by, StructType.fromDDL("t long, i binary, q binary, k binary, v binary"))
    parts = [("t", pa.int64()), ("i", pa.binary()), ("m", pa.binary()), ("l", pa.binary()), ("o", pa.binary())]

    def pack(table: pa.Table) -> pa.Table:
        order = table.column("i").to_numpy().argsort()
        i = table.column("i").to_numpy()[order].astype("<i8")
        blocks = [np.array(table.column(c).to_pylist(), "<f8")[order].tobytes() for c in ("q", "k", "v")]
        key = tuple(table.column(c)[0].as_py() for c in by)
        return pa.Table.from_batches([_arrow([(*key, int(i[0]) // size, i.tobytes(), *blocks)], [table.schema.field(c) for c in by], [("t", pa.int64()), *((c, pa.binary()) for c in "iqkv")])])

    def merged(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
        m = np.maximum(a[1], b[1])
        x, y = np.exp(a[1] - m), np.exp(b[1] - m)
        return a[0], m, a[2] * x + b[2] * y, a[3] * x[:, None] + b[3] * y[:, None]

    def read(i: bytes, *rest: bytes) -> tuple[np.ndarray, ...]:
        at = np.frombuffer(i, "<i8")
        return at, *(np.frombuffer(r, "<f8").reshape(len(at), *([-1] if n == 2 else [])) for n, r in enumerate(rest))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[np.ndarray, ...]] = {}
        fields: list[pa.Field] = []

        def send() -> pa.RecordBatch:
            out = [(*key, *(x.tobytes() for x in value)) for key, value in held.items()]
            held.clear()
            return _arrow(out, fields, parts)

        for batch in batches:
            fields = [batch.schema.field(c) for c in by]
            for *key, i, q, i2, k, v in zip(*(batch.column(c).to_pylist() for c in (*by, "t", "i", "q", "_i", "k", "v")), strict=True):
                at, seen = np.frombuffer(i, "<i8"), np.frombuffer(i2, "<i8")
                q, k, v = (np.frombuffer(x, "<f8").reshape(len(n), -1) for x, n in ((q, at), (k, seen), (v, seen)))
                scores = np.where(seen[None] <= at[:, None], q @ k.T / math.sqrt(width), -np.inf)
                most = scores.max(1)
                # rows of the first band may see none of a band's rows
                weights = np.exp(scores - np.where(np.isneginf(most), 0, most)[:, None])
                value = (at, np.where(np.isneginf(most), -1e300, most), weights.sum(1), weights @ v)
                held[tuple(key)] = merged(held[tuple(key)], value) if tuple(key) in held else value
            if sum(x.nbytes for value in held.values() for x in value) > HELD:
                yield send()
        if held:
            yield send()

    def finish(table: pa.Table) -> pa.Table:
        total = None
        for blobs in zip(*(table.column(c).to_pylist() for c in "imlo"), strict=True):
            total = read(*blobs) if total is None else merged(total, read(*blobs))
        at, _, weight, out = total
        keys = [pa.array([table.column(c)[0].as_py()] * len(at), table.schema.field(c).type) for c in by]
        return pa.table([*keys, pa.array(at), pa.array((out / weight[:, None]).tolist(), pa.list_(pa.float64()))], names=[*by, "i", "v"])

    own = rows.select(*by, F.col("i").cast("long").alias("i"), *(F.col(c).cast("array<double>").alias(c) for c in "qkv"), F.floor(F.col("i") / size).alias("t"))
    packed = own.groupBy(*by, "t").applyInArrow(pack, bands)
    # a tensor without `by` is one sequence
    key = [*by] if by else ["_one"]
    tagged = packed if by else packed.withColumn("_one", F.lit(0))
    asked = tagged.select(*key, "t", "i", "q")
    seen = tagged.select(*key, F.col("t").alias("_t"), F.col("i").alias("_i"), "k", "v")
    met = asked.join(seen, key).where(F.col("_t") <= F.col("t")).select(*by, "t", "i", "q", "_i", "k", "v")
    sums = met.mapInArrow(run, _schema(rows, by, StructType.fromDDL("t long, i binary, m binary, l binary, o binary")))
    return sums.groupBy(*by, "t").applyInArrow(finish, _schema(rows, by, StructType.fromDDL("i long, v array<double>")))
