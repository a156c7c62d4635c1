"""64-bit FNV-1a, and the PCG32 generator by jump-ahead."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

# The offset and prime of the hash, and the multiplier of the generator.
OFFSET, PRIME = 1469598103934665603, 1099511628211
MULTIPLIER = 6364136223846793005
WORD = 2**64


def fnv1a(data: bytes) -> int:
    h = OFFSET
    for byte in data:
        h = (h ^ byte) * PRIME % WORD
    return h


@F.pandas_udf(LongType())
def fnv1a_col(text: pd.Series) -> pd.Series:
    """All strings at once, a byte position at a time; the unsigned hash as a signed long."""
    raw = [t.encode("utf-8") if t is not None else b"" for t in text]
    sizes = np.array([len(r) for r in raw])
    starts = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(raw) or b"\0", np.uint8)
    h = np.full(len(raw), OFFSET, np.uint64)
    order = np.argsort(-sizes, kind="stable")
    for i in range(int(sizes.max(initial=0))):
        live = order[: np.searchsorted(-sizes[order], -i, "left")]
        h[live] = (h[live] ^ data[starts[live] + i].astype(np.uint64)) * np.uint64(PRIME)
    return pd.Series(h.view(np.int64)).where(text.notna().to_numpy(), None)


def _advanced(state: int, step: int, jump: np.ndarray) -> np.ndarray:
    """The congruential state after `jump` steps: powers of the step's affine map by squaring."""
    s = np.full(len(jump), state % WORD, np.uint64)
    a, c, left = MULTIPLIER, step, jump.astype(np.uint64)
    while left.any():
        odd = (left & np.uint64(1)).astype(bool)
        s[odd] = s[odd] * np.uint64(a) + np.uint64(c)
        a, c, left = a * a % WORD, (a + 1) * c % WORD, left >> np.uint64(1)
    return s


def _output(state: np.ndarray) -> np.ndarray:
    x = (((state >> np.uint64(18)) ^ state) >> np.uint64(27)).astype(np.uint32)
    turn = (state >> np.uint64(59)).astype(np.uint32)
    return (x >> turn) | (x << ((np.uint32(32) - turn) & np.uint32(31)))


def pcg_u32(seed: int, sequence: int, draws: np.ndarray) -> np.ndarray:
    """The outputs numbered `draws` (from 0) of the generator of this seed and sequence."""
    step = (2 * sequence + 1) % WORD
    start = ((step + seed) * MULTIPLIER + step) % WORD
    return _output(_advanced(start, step, np.asarray(draws)))


def pcg_u64(seed: int, sequence: int, draws: np.ndarray) -> np.ndarray:
    """64-bit values by number: two outputs each, high half first."""
    high, low = (pcg_u32(seed, sequence, 2 * np.asarray(draws) + i).astype(np.uint64) for i in (0, 1))
    return (high << np.uint64(32)) | low


def pcg_range(seed: int, sequence: int, draws: np.ndarray, size: int) -> np.ndarray:
    """Range draws 0 .. size - 1 by number. A value below 2^64 mod size is rejected and the next one drawn, which
    moves all later draws. Where the values asked for show a rejection, all earlier ones are counted, so draws from 0
    on are those of drawing in order."""
    draws, least = np.asarray(draws), np.uint64(WORD % size)
    value = pcg_u64(seed, sequence, draws)
    if (value < least).any():
        # the numbers of the values that are accepted, as far as the last draw asked for
        found, at, wanted, step = [], 0, int(draws.max()) + 1, 1 << 20
        while sum(map(len, found)) < wanted:
            number = np.arange(at, at + min(step, 2 * wanted + 64))
            found.append(number[pcg_u64(seed, sequence, number) >= least])
            at += len(number)
        value = pcg_u64(seed, sequence, np.concatenate(found)[draws])
    return (value % np.uint64(size)).astype(np.int64)


def pcg_uniform(seed: int, sequence: int, draws: np.ndarray) -> np.ndarray:
    return pcg_u32(seed, sequence, draws) / 2.0**32


def pcg_normal_at(seed: int, sequence: int, index: np.ndarray) -> np.ndarray:
    """Normal draws by number: two uniforms, the first kept from 0, make draws 2k (cosine) and 2k + 1 (sine)."""
    index = np.asarray(index)
    pair = index - index % 2
    u = np.maximum(pcg_uniform(seed, sequence, pair), 2.0**-32)
    angle = 2 * np.pi * pcg_uniform(seed, sequence, pair + 1)
    return np.sqrt(-2 * np.log(u)) * np.where(index % 2 == 0, np.cos(angle), np.sin(angle))


def pcg_normal(seed: int, sequence: int, n: int) -> np.ndarray:
    return pcg_normal_at(seed, sequence, np.arange(n))


def shuffled(n: int, seed: int, sequence: int) -> np.ndarray:
    """A permutation of 0 .. n - 1 by exchanges from the end, a draw each; rejected draws are drawn again."""
    out = list(range(n))
    values, at = pcg_u64(seed, sequence, np.arange(n + 64)).tolist(), 0
    for i in range(n - 1, 0, -1):
        while values[at] < WORD % (i + 1):
            at += 1
            if at == len(values):
                values += pcg_u64(seed, sequence, np.arange(at, 2 * at)).tolist()
        j = values[at] % (i + 1)
        at += 1
        if at == len(values):
            values += pcg_u64(seed, sequence, np.arange(at, 2 * at)).tolist()
        out[i], out[j] = out[j], out[i]
    return np.array(out, np.int64)
