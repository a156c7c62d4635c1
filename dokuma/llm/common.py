"""Arrow and numpy helpers that the operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

U64 = np.uint64
#: Bytes of text that one numpy pass takes at once; a longer text forms a part of its own.
PART_BYTES = 500_000

_rng = np.random.Generator(np.random.PCG64(20240229))
BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
MULT = U64(0x9E3779B97F4A7C15 | 1)
BASE = U64(0xD1342543DE82EF95)
BASE_INV = U64(pow(0xD1342543DE82EF95, -1, 2**64))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply)."""
    h = h ^ (h >> U64(32))
    h = h * U64(0xD6E8FEB86659FD93)
    h = h ^ (h >> U64(32))
    h = h * U64(0xD6E8FEB86659FD93)
    return h ^ (h >> U64(32))


_powers = np.ones(1, U64)


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverse
    if len(_powers) < n + 1:
        size = max(n + 1, PART_BYTES * 2)
        with np.errstate(over="ignore"):
            up = np.full(size, BASE, U64)
            up[0] = 1
            down = np.full(size, BASE_INV, U64)
            down[0] = 1
            _powers, _inverse = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers, _inverse


_inverse = np.ones(1, U64)


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte strings data[start:end]; equal strings have equal hashes wherever they lie."""
    up, down = _power_table(len(data))
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum(BYTE_CODE[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64) * MULT)


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and UTF-8 bytes of a string column; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], body[offsets[0] : offsets[-1]]


def parts(offsets: np.ndarray, limit: int = PART_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about limit bytes each; every row is in one."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = hi


SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes outside [\\x20\\x09-\\x0D], cut at the texts' ends,
    and for each text the number of its first word (with one more entry at the end)."""
    n = len(data)
    if not n:
        e = np.zeros(0, np.int64)
        return e, e, np.zeros(len(offsets), np.int64)
    solid = ~SPACE[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = solid[:-1]
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = solid[1:]
    cut = offsets[(offsets > 0) & (offsets < n)]
    before[cut] = False
    after[cut - 1] = False
    starts = np.flatnonzero(solid & ~before)
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def binary_rows(blobs: list[bytes]) -> pa.Array:
    return pa.array(blobs, pa.binary())


def pack(table: np.ndarray) -> bytes:
    """A structured array as bytes, byte plane by byte plane: the planes of small numbers compress to nothing."""
    planes = [np.ascontiguousarray(table[f]).view(np.uint8).reshape(len(table), table.dtype[f].itemsize).T.tobytes() for f in table.dtype.names]
    return len(table).to_bytes(4, "little") + b"".join(planes)


def unpack(blobs: list[bytes], kind: np.dtype) -> np.ndarray:
    """The rows of all blobs that pack() made of this kind."""
    sizes = [int.from_bytes(b[:4], "little") for b in blobs]
    out, row = np.empty(sum(sizes), kind), 0
    for blob, n in zip(blobs, sizes, strict=True):
        at, raw = 4, np.frombuffer(blob, np.uint8)
        for f in kind.names:
            width = kind[f].itemsize
            out[f][row : row + n] = np.ascontiguousarray(raw[at : at + n * width].reshape(width, n).T).view(kind[f]).ravel()
            at += n * width
        row += n
    return out


def ramp(counts: np.ndarray) -> np.ndarray:
    """0 .. count-1 for each count, concatenated."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def sequence_sums(values: np.ndarray, seed: int = 0) -> np.ndarray:
    """Prefix sums from which run_hash() takes the hash of any run of values."""
    up, _ = _power_table(len(values))
    sums = np.zeros(len(values) + 1, U64)
    np.cumsum(mix(values ^ U64(seed)) * up[: len(values)], out=sums[1:])
    return sums


def run_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the runs of values from start to end; equal runs have equal hashes."""
    _, down = _power_table(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64) * MULT)


def by_bucket(table: np.ndarray, bucket: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(bucket, packed rows) of each bucket that has any."""
    if not len(table):
        return
    order = np.argsort(bucket, kind="stable")
    table, bucket = table[order], bucket[order]
    edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    for a, b in zip(edges, [*edges[1:], len(bucket)], strict=True):
        yield int(bucket[a]), pack(table[a:b])


def batch_of(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same map function, after which the worker gives freed memory back: workers are reused, and what
    one stage leaves in their heaps would add to the next one's."""

    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return outer


def release() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not the GNU C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


#: What numpy tables and rows call the two parts of a document's key, and what sets null ids apart.
KEY = [("key", "<i8"), ("tie", "<i8")]
_SIGN = -(2**63)


def key_columns(id_col: str = "doc_id", text: str = "text") -> tuple[Column, Column]:
    """key and tie, two longs that together order rows as (id, hash of the text) do, null ids first. They are
    equal for equal (id, text) only, up to chance collisions of 63 bits among the texts of one id."""
    h = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    number = F.col(id_col).cast("long")
    tie = F.when(number.isNull(), h.bitwiseOR(F.lit(_SIGN))).otherwise(h.bitwiseAND(F.lit(2**63 - 1)))
    return F.coalesce(number, F.lit(_SIGN)), tie


def by_key(table: np.ndarray, key: np.ndarray, tie: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """(key, tie, packed rows) of each document that has any."""
    if not len(table):
        return
    order = np.lexsort((tie, key))
    table, key, tie = table[order], key[order], tie[order]
    edges = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (tie[1:] != tie[:-1])]))
    for a, b in zip(edges, [*edges[1:], len(key)], strict=True):
        yield int(key[a]), int(tie[a]), pack(table[a:b])


def keyed_blob(key: int, tie: int, blob: bytes) -> bytes:
    return key.to_bytes(8, "little", signed=True) + tie.to_bytes(8, "little", signed=True) + blob


def split_blob(blob: bytes) -> tuple[int, int, bytes]:
    return int.from_bytes(blob[:8], "little", signed=True), int.from_bytes(blob[8:16], "little", signed=True), blob[16:]
