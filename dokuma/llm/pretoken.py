"""Splitting text into the pre-tokens of the public byte-level BPE pattern, in numpy.

The pattern is: contractions ('s 't 're 've 'm 'll 'd), then runs of letters, of numbers or of other
characters, each with one space before it if there is one, then white space that no other character
follows, then white space.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

WHITE, LETTER, NUMBER, OTHER = 0, 1, 2, 3


def class_table(find: Callable[[str, str], bytes]) -> np.ndarray:
    """Class of each code point, as the tokenizer's own regular expressions see it. find(pattern, text)
    returns the UTF-8 bytes of what the pattern matches in the text."""
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    table = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (WHITE, r"\s+")):
        table[np.frombuffer(find(pattern, every).decode().encode("utf-32-le"), np.uint32)] = kind
    return table


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes, and the byte at which each begins."""
    return np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32), np.flatnonzero((data & 0xC0) != 0x80)


def pre_tokens(cp: np.ndarray, kind: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether a pre-token starts at each character. first: whether a text starts there."""
    n = len(cp)
    if not n:
        return np.zeros(0, bool)
    start = first.copy()
    start[1:] |= kind[1:] != kind[:-1]
    change = start.copy()
    # what follows white space takes one space along; of a longer white run the last character stands alone
    after = np.flatnonzero(change[1:] & ~first[1:] & (kind[1:] != WHITE) & (kind[:-1] == WHITE)) + 1
    start[after - 1] = True
    start[after[cp[after - 1] == 32]] = False
    # contractions, where a match starts at the apostrophe
    quote = np.flatnonzero(start & change & (cp == 39))
    quote = quote[quote + 1 < n]
    quote = quote[~first[quote + 1]]
    one = cp[quote + 1]
    short = quote[np.isin(one, [ord(c) for c in "stmd"])]
    pair = quote[quote + 2 < n]
    pair = pair[~first[pair + 2]]
    a, b = cp[pair + 1], cp[pair + 2]
    pair = pair[((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))]
    start[short + 1] = False
    start[pair + 1] = False
    for at in (short + 2, pair + 3):
        start[at[at < n]] = True
    return start


def safe_cuts(text: bytes, limit: int) -> list[int]:
    """Offsets at which a very long text may be cut without changing its pre-tokens: before a space
    between two ASCII letters, about every `limit` bytes. A stretch without such a place stays whole."""
    cuts, at = [0], limit
    while at < len(text) - 2:
        at = text.find(b" ", at)
        if at < 0 or at > len(text) - 2:
            break
        if chr(text[at - 1]).isalpha() and text[at - 1] < 128 and chr(text[at + 1]).isalpha() and text[at + 1] < 128:
            cuts.append(at)
            at += limit
        else:
            at += 1
    return [*cuts, len(text)]
