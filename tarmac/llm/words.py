"""Words of whole texts as 64-bit numbers, computed over byte arrays without a loop per word.

A word's number is a polynomial over a table of 256 mixed values, taken modulo 2**64 from
running sums, then mixed. Upper-case A-Z counts as lower case, unless CASED is asked for. Texts are handled in pieces
that end between words, so that memory follows the piece and the number of words.
"""

from __future__ import annotations

import numpy as np

PIECE = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _letters(fold: bool) -> np.ndarray:
    codes = np.arange(256, dtype=np.uint64)
    upper = (codes >= 65) & (codes <= 90) & fold
    return mix(np.where(upper, codes + np.uint64(32), codes) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(0x1234567))


LETTERS, CASED = _letters(True), _letters(False)
_UP, _DOWN = _powers(_BASE, PIECE + 1), _powers(_BACK, PIECE + 1)

SPACED = np.ones(256, bool)
SPACED[[9, 10, 11, 12, 13, 32]] = False
ALPHANUMERIC = np.zeros(256, bool)
ALPHANUMERIC[48:58] = ALPHANUMERIC[65:91] = ALPHANUMERIC[97:123] = ALPHANUMERIC[128:] = True


def _piece(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, letters: np.ndarray) -> np.ndarray:
    n = len(raw)
    up, down = (_UP, _DOWN) if n <= PIECE else (_powers(_BASE, n + 1), _powers(_BACK, n + 1))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(letters[raw] * up[:n], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def numbered(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, letters: np.ndarray = LETTERS) -> np.ndarray:
    """Numbers of the stretches of bytes from `starts` to `ends`, both ascending."""
    out, first = np.empty(len(starts), np.uint64), 0
    while first < len(starts):
        base = starts[first]
        last = max(int(np.searchsorted(ends, base + PIECE, "right")), first + 1)
        out[first:last] = _piece(raw[base : ends[last - 1]], starts[first:last] - base, ends[first:last] - base, letters)
        first = last
    return out


def words(raw: np.ndarray, offsets: np.ndarray, inside: np.ndarray, letters: np.ndarray = LETTERS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Numbers, byte starts and byte ends of all words; and for each row where its words begin (n + 1).

    `inside` tells which bytes belong to words; a word never reaches over a row's border.
    With CASED as `letters`, upper and lower case differ.
    """
    n = len(raw)
    is_in = np.zeros(n + 2, bool)
    is_in[1:-1] = inside[raw]
    opens = is_in[1:-1] & ~is_in[:-2]
    borders = offsets[1:-1]
    borders = borders[(borders > 0) & (borders < n)]
    opens[borders] = is_in[borders + 1]
    closes = is_in[1:-1] & ~is_in[2:]
    closes[borders - 1] = is_in[borders]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return numbered(raw, starts, ends, letters), starts, ends, np.searchsorted(starts, offsets)


def sequences(numbers: np.ndarray, size: int) -> np.ndarray:
    """A number for each `size` consecutive entries."""
    n = len(numbers) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, size, np.uint64)
    for k in range(size):
        total = mix(total * np.uint64(0xA24BAED4963EE407) + numbers[k : k + n])
    return total
