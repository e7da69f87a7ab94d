"""Runs of repeated words by internal pattern matching.

A run is a longest stretch of words that repeats with a period, at least twice. Texts are searched
one batch at a time, all of a batch's words in the same arrays:

1. A suffix array over the words, by doubling; it stops where no two suffixes of a document agree
   any more. The rank of every suffix after each doubling names its first 2^k words.
2. A wavelet tree over the part of the suffix array whose first four words recur in the document.
   It answers, for a range of suffixes and a place in the text, which place in the range comes
   next (range successor): two descents, one to count and one to select.
3. Dyadic blocks of 2^k words ask for their next occurrences in the windows that follow them. A
   run that goes on for l words after its first period contains a block with 2^(k+1) - 1 <= l <
   2^(k+2) - 1 (blocks of four words begin at every even place, longer ones at multiples of their
   length), and that block's occurrence one period later. Occurrences nearer than half a block form
   a progression, whose difference is the only candidate where the block itself is its first
   element; any other occurrence in the window gives its distance.
4. Each candidate period is extended to both sides by the ranks. Stretches found with several
   periods keep the smallest.

Work is O(n log n) word operations for a text of n words, also where a text is one long run. All
documents are independent, so nothing is shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.llm.shared import in_batches, spans_of, utf8
from tarmac.llm.words import CASED, SPACED, words

LEAST = 12
PIECE = 1 << 20  # bytes of text searched at once
BASE = 2  # blocks have at least 2^BASE words


class Suffixes:
    """Suffix array of several rows of words, ranks after each doubling, and the groups of equal blocks."""

    def __init__(self, numbers: np.ndarray, at: np.ndarray):
        n = self.n = len(numbers)
        end = np.repeat(at[1:], np.diff(at))  # of each word's row
        _, letter = np.unique(numbers, return_inverse=True)
        own = np.repeat(np.arange(len(at) - 1), np.diff(at)) * (int(letter.max(initial=0)) + 1) + letter
        self.ranks: list[np.ndarray] = []
        self.blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # places, and their ranges in the array
        self.order = np.argsort(own, kind="stable")
        slots, key = np.arange(n), own[self.order]
        rank = np.empty(n + 1, np.int32)
        rank[n] = -1
        level = 0
        self.recurring = np.zeros(0, np.int64)  # slots whose first 2^BASE words recur
        while True:
            new = np.append(True, key[1:] != key[:-1]) if len(key) else np.zeros(0, bool)
            first = np.flatnonzero(new)
            size = np.diff(np.append(first, len(key)))
            group = np.cumsum(new) - 1
            rank[self.order[slots]] = slots[first][group]
            self.ranks.append(rank.copy())
            again = size[group] > 1
            slots = slots[again]
            if level == BASE:
                self.recurring = slots
            place = self.order[slots]
            if level >= BASE:
                step = 1 << (level if level > BASE else BASE - 1)
                asked = place % step == 0
                low = rank[place[asked]].astype(np.int64)
                self.blocks.append((place[asked], low, low + size[group[again]][asked]))
            if not len(slots):
                break
            after = place + (1 << level)
            inside = after < end[place]
            follows = np.where(inside, rank[np.minimum(after, n)], -1)
            key = rank[place].astype(np.int64) * (n + 1) + follows + 1
            order = np.argsort(key, kind="stable")
            self.order[slots], key = place[order], key[order]
            level += 1

    def common_after(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words agree from i on and from j on; i < j."""
        i, j, start = i.copy(), j.copy(), i
        for k in range(len(self.ranks) - 1, -1, -1):
            rank = self.ranks[k]
            step = (rank[np.minimum(i, self.n)] == rank[np.minimum(j, self.n)]).astype(np.int64) << k
            i += step
            j += step
        return i - start

    def common_before(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words agree before i and before j; i < j."""
        i, j, start = i.copy(), j.copy(), i
        for k in range(len(self.ranks) - 1, -1, -1):
            rank, far = self.ranks[k], i >= 1 << k
            step = (far & (rank[np.where(far, i - (1 << k), 0)] == rank[np.where(far, j - (1 << k), 0)])).astype(np.int64) << k
            i -= step
            j -= step
        return start - i


class WaveletTree:
    """Range successor over a permutation of 0 to m - 1."""

    def __init__(self, values: np.ndarray):
        self.m = len(values)
        self.depth = max(1, int(self.m - 1).bit_length())
        self.zeros: list[np.ndarray] = []  # per level: zero bits before each place
        for level in range(self.depth - 1, -1, -1):
            bit = (values >> level) & 1
            held = np.zeros(self.m + 1, np.int32)
            np.cumsum(bit == 0, out=held[1:])
            self.zeros.append(held)
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def _below(self, low: np.ndarray, high: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many values in places low to high - 1 are under x."""
        count = np.zeros(len(low), np.int64)
        for level, held in zip(range(self.depth - 1, -1, -1), self.zeros):
            one = (x >> level) & 1 == 1
            a, b = held[low], held[high]
            count += np.where(one, b - a, 0)
            low, high = np.where(one, held[-1] + low - a, a), np.where(one, held[-1] + high - b, b)
        return count

    def successor(self, low: np.ndarray, high: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The smallest value of at least x in places low to high - 1; -1 where there is none."""
        out = np.full(len(low), -1, np.int64)
        some = np.flatnonzero(x < self.m)
        nth = self._below(low[some], high[some], x[some])
        there = nth < (high - low)[some]
        some, nth = some[there], nth[there]
        low, high, value = low[some], high[some], np.zeros(len(some), np.int64)
        for level, held in zip(range(self.depth - 1, -1, -1), self.zeros):
            a, b = held[low], held[high]
            one = nth >= b - a
            nth = nth - np.where(one, b - a, 0)
            value |= one.astype(np.int64) << level
            low, high = np.where(one, held[-1] + low - a, a), np.where(one, held[-1] + high - b, b)
        out[some] = value
        return out


def _candidates(text: Suffixes) -> tuple[np.ndarray, np.ndarray]:
    """Places and periods that may belong to a run, each with a block there and one period later."""
    slots = text.recurring
    places, periods = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if not len(slots):
        return places[0], periods[0]
    kept = np.sort(text.order[slots])  # the tree holds numbers of recurring places, in the order of the text
    number = np.full(text.n + 1, len(kept), np.int64)
    number[kept] = np.arange(len(kept))
    number = np.minimum.accumulate(number[::-1])[::-1]  # of the first recurring place from here on
    tree = WaveletTree(number[text.order[slots]])
    before = np.zeros(text.n + 1, np.int64)
    before[slots + 1] = 1
    before = np.cumsum(before)
    for k, (block, low, high) in enumerate(text.blocks):
        size = 1 << (k + BASE)
        far = block + 4 * size - 2
        low, high = before[low], before[high]
        here, first = block, np.ones(len(block), bool)
        while len(block):
            found = tree.successor(low, high, number[np.minimum(here + 1, text.n)])
            live = found >= 0
            after = np.where(live, kept[np.maximum(found, 0)], text.n)
            live &= after <= far
            block, low, high, far, here, first, after = (x[live] for x in (block, low, high, far, here, first, after))
            gap = after - here
            last = after.copy()
            near = np.flatnonzero(2 * gap <= size)
            if len(near):  # a progression from `here` on
                reach = gap[near] + text.common_after(here[near], after[near])
                last[near] = here[near] + (reach - size) // gap[near] * gap[near]
            count = np.where(first & (2 * gap <= size), 1, (np.minimum(last, far) - after) // gap + 1)
            every = np.repeat(np.arange(len(block)), count)
            nth = np.arange(len(every)) - np.repeat(np.cumsum(count) - count, count)
            places.append(block[every])
            periods.append((after - block)[every] + nth * gap[every])
            here, first = last, np.zeros(len(block), bool)
    return np.concatenate(places), np.concatenate(periods)


def find_runs(numbers: np.ndarray, at: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts (from the first row's first word), lengths and smallest periods of all runs, by start and period."""
    text = Suffixes(numbers, at)
    place, period = _candidates(text)
    start = place - text.common_before(place, place + period)
    end = place + period + text.common_after(place, place + period)
    good = end - start >= np.maximum(least, 2 * period)
    start, end, period = start[good], end[good], period[good]
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[new], end[new], period[new]
    order = np.lexsort((period, start))
    return start[order], (end - start)[order], period[order]


def _collapsed(least: int, piece: int, batch: pa.RecordBatch) -> pa.RecordBatch:
    raw, offsets = utf8(batch.column(1))
    counts, kept_texts = [], []
    columns: list[list[np.ndarray]] = [[], [], []]
    begins = [0]
    for a, b in spans_of(offsets, piece):
        part = raw[offsets[a] : offsets[b]]
        numbers, _, _, at = words(part, offsets[a : b + 1] - offsets[a], SPACED, CASED)
        start, length, period = find_runs(numbers, at, least)
        step = np.zeros(len(numbers) + 1, np.int64)
        np.add.at(step, start + period, 1)
        np.add.at(step, start + length, -1)
        gone = np.cumsum(step[:-1]) > 0
        any_gone = np.concatenate([[0], np.cumsum(gone)])
        owner = np.searchsorted(at, start, "right") - 1
        whole = part.tobytes()
        for row in range(b - a):
            own = whole[offsets[a + row] - offsets[a] : offsets[a + row + 1] - offsets[a]].split()
            if any_gone[at[row + 1]] > any_gone[at[row]]:
                own = [own[k] for k in np.flatnonzero(~gone[at[row] : at[row + 1]])]
            kept_texts.append(b" ".join(own).decode())
        counts.append(np.diff(at))
        begins.extend((begins[-1] + np.searchsorted(owner, np.arange(1, b - a + 1))).tolist())
        for column, values in zip(columns, (start - at[owner], length, period)):
            column.append(values.astype(np.int64))
    flat = [pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in columns]
    runs = pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pa.StructArray.from_arrays(flat, names=["start", "length", "period"]))
    n = np.concatenate(counts).astype(np.int64) if counts else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), runs, pa.array(kept_texts, pa.string())], names=["doc_id", "n_words", "runs", "text"])


def collapse_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, n_words, runs, text for every row of `docs` (doc_id, text).

    Words are what ASCII white space separates, unchanged, numbered from 0. `runs` lists (start,
    length, period) by start, then period: every stretch whose words a smallest period apart are
    equal, of at least `least` words and two periods, that no neighbouring word extends. `text`
    holds the words that no run contains after its first period, one space between. Null and empty
    texts have no words, no runs and an empty text. Rows are judged one by one, so repeated rows
    give equal results, and doc_id is only passed on. Other columns are ignored; an empty table
    gives no rows. `least` is at least 12, as shorter stretches need shorter blocks.
    """
    if least < LEAST:
        raise ValueError(f"runs of under {LEAST} words are not searched")
    rows, piece = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), PIECE
    return in_batches(rows, lambda batch: _collapsed(least, piece, batch), "doc_id bigint, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, text string")
