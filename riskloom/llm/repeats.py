"""Periodic runs of words, found on a Re-Pair grammar.

The words of a block of texts become numbers, apart for each text, so that the block is one string in
which nothing repeats across texts. Re-Pair replaces frequent pairs by rules, in rounds: of overlapping
frequent pairs the more frequent one is taken, ties by a fixed order. A run with three periods repeats some
pair three times, so pairs below that make no rule, and a text without a rule has no run.

Runs are sought where two symbols meet: once inside every rule, at its first occurrence, and between the
symbols that remain, there within the whole text. A run that crosses a meeting point reaches at least half
its length to one side, so a short piece on that side recurs one period away; such pieces are looked up among
the equal pieces of the block, with lengths that double as periods do. Prefix hashes then extend a
candidate both ways. What is found in a rule is translated to all its occurrences; runs that go
on there are dropped, because they are found whole at a meeting point higher up. Every find is compared word by
word at the end; texts in which a hash has failed are searched again without hashes.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from riskloom.llm.common import keyed_text, portions

BATCH_BYTES = 2_000_000
#: Candidates that are extended at once.
CANDIDATES = 1_000_000
#: Occurrences of a pair that make a rule, and the shortest piece that is looked up.
LEAST_PAIRS, PIECE = 3, 4
#: A run has at least SHORTEST words and PERIODS periods; pieces of PIECE words suffice for these two.
SHORTEST, PERIODS = 24, 3
MIX = np.uint64(0x9E3779B97F4A7C15)


def _repeated(keys: np.ndarray, least: int) -> np.ndarray:
    """Places whose key may occur ``least`` times: all that do, and few others."""
    bits = max(10, int(len(keys)).bit_length() + 1)
    bucket = ((keys.astype("uint64") * MIX) >> np.uint64(64 - bits)).astype("int64")
    return np.flatnonzero(np.bincount(bucket, minlength=1 << bits)[bucket] >= least)


class Grammar:
    """Re-Pair of ``word`` whose numbers are below ``symbols``.

    ``starts`` are the positions of the remaining symbols. ``rule``, ``place``, ``left`` and ``whole`` give, for every
    occurrence of every rule, its number, position, and the words of its first symbol and of both.
    """

    def __init__(self, word: np.ndarray, symbols: int):
        seq, at, size = word.astype("int64"), np.arange(len(word)), np.ones(len(word), "int64")
        maybe = np.ones(max(len(word) - 1, 0), bool)  # pairs that can be frequent: others never become so
        found, rules = [], 0
        while len(seq) > 1:
            spots = np.flatnonzero(maybe)
            pairs = seq[spots] * symbols + seq[spots + 1]
            some = _repeated(pairs, LEAST_PAIRS) if len(spots) else spots
            spots, pairs = spots[some], pairs[some]
            kinds, number, times = np.unique(pairs, return_inverse=True, return_counts=True)
            often = times[number] >= LEAST_PAIRS
            spots, number = spots[often], number[often]
            if not len(spots):
                break
            order = np.lexsort((kinds.astype("uint64") * MIX, times))
            place = np.empty(len(kinds), "int64")
            place[order] = np.arange(len(kinds))
            chosen = _apart(spots, place[number], len(seq))
            # The most frequent pair of all is taken twice at least, so every round makes a rule.
            uses = np.bincount(number[chosen], minlength=len(kinds))
            chosen = chosen[uses[number[chosen]] > 1]
            rule = np.unique(number[chosen], return_inverse=True)[1]
            here = spots[chosen]
            found.append((rule + rules, at[here], size[here], size[here] + size[here + 1]))
            maybe = np.zeros(len(seq), bool)
            maybe[spots] = True
            seq[here] = symbols + rule
            size[here] += size[here + 1]
            maybe[here] = True
            maybe[np.maximum(here - 1, 0)] = True
            maybe[here + 1] = False
            keep = np.ones(len(seq), bool)
            keep[here + 1] = False
            seq, at, size, maybe = seq[keep], at[keep], size[keep], maybe[keep][:-1]
            made = int(rule.max()) + 1
            rules, symbols = rules + made, symbols + made
        self.starts = at
        empty = np.empty(0, "int64")
        self.rule, self.place, self.left, self.whole = (
            np.concatenate([f[i] for f in found]) if found else empty for i in range(4))
        self.rules = rules


def _apart(spots: np.ndarray, place: np.ndarray, length: int) -> np.ndarray:
    """Which of the pairs at ``spots`` are taken: those above both that they overlap.

    In a stretch of one symbol, whose pairs are equal, every second one is the higher.
    """
    same = np.concatenate([[False], (np.diff(spots) == 1) & (np.diff(place) == 0)])
    step = np.arange(len(spots))
    offset = step - np.maximum.accumulate(np.where(same, 0, step))
    value = place * 2 + (offset % 2 == 0)
    around = np.full(length + 2, -1, "int64")
    around[spots + 1] = value
    return np.flatnonzero((value > around[spots]) & (value > around[spots + 2]))


class Hashes:
    """Prefix hashes of a string of numbers, modulo 2^64."""

    def __init__(self, word: np.ndarray, seed: int = 42):
        draw = np.random.default_rng(seed)
        values = draw.integers(1, 2 ** 63, int(word.max(initial=0)) + 1, dtype="uint64")
        base = np.full(len(word) + 1, int(draw.integers(1, 2 ** 62)) * 2 + 1, "uint64")
        base[0] = 1
        self.power = np.cumprod(base)
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(values[word] * self.power[:-1])])

    def pieces(self, at: np.ndarray, size: int) -> np.ndarray:
        """Equal for equal pieces of ``size`` words."""
        return (self.sums[at + size] - self.sums[at]) * self.power[len(self.power) - 1 - at]

    def equal(self, x: np.ndarray, y: np.ndarray, size: np.ndarray) -> np.ndarray:
        return (self.sums[x + size] - self.sums[x]) * self.power[y - x] == self.sums[y + size] - self.sums[y]

    def forward(self, x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Words that agree from x and from y > x on, ``most`` at most."""
        return self._reach(most, lambda size: self.equal(x, y, size))

    def backward(self, x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Words that agree before x and before y > x, ``most`` at most."""
        return self._reach(most, lambda size: self.equal(x - size, y - size, size))

    @staticmethod
    def _reach(most: np.ndarray, agree) -> np.ndarray:
        low, high = np.zeros(len(most), "int64"), most.copy()
        for _ in range(int(most.max(initial=0)).bit_length()):
            middle = (low + high + 1) // 2
            ok = agree(middle)
            low, high = np.where(ok, middle, low), np.where(ok, high, middle - 1)
        return low


def _candidates(hashes: Hashes, length: int, low: np.ndarray, middle: np.ndarray, high: np.ndarray
                ) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(meeting point, x, period): words from x and from x + period on may agree around the meeting point."""
    size, spots, level = PIECE, np.arange(max(length - PIECE + 1, 0)), 0
    while len(spots):
        first, last = (1, 4 * PIECE - 1) if level == 0 else (2 * size, 4 * size - 1)
        pieces = hashes.pieces(spots, size)
        some = _repeated(pieces, 2)
        spots, pieces = spots[some], pieces[some]
        if not len(spots):
            break
        order = np.lexsort((spots, pieces))
        places, pieces = spots[order], pieces[order]
        alike = pieces[1:] == pieces[:-1]
        group = np.concatenate([[0], np.cumsum(~alike)])
        chain = group * (length + 1) + places
        rank = np.empty(len(spots), "int64")
        rank[order] = np.arange(len(spots))
        for anchor, side in ((middle, 1), (middle - size, -1)):
            at = np.minimum(np.searchsorted(spots, anchor), len(spots) - 1)
            ok = np.flatnonzero((spots[at] == anchor) & (anchor >= low))
            own = group[rank[at[ok]]] * (length + 1)
            if side > 0:
                near, far = anchor[ok] + first, np.minimum(anchor[ok] + last, high[ok] - 1)
            else:
                near, far = np.maximum(anchor[ok] - last, low[ok]), anchor[ok] - first
            begin = np.searchsorted(chain, own + near, "left")
            number = np.where(far >= near, np.searchsorted(chain, own + far, "right") - begin, 0)
            part = np.cumsum(number) // CANDIDATES
            for p in np.unique(part[number > 0]).tolist():
                take = np.flatnonzero((part == p) & (number > 0))
                times = number[take]
                step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                place = places[np.repeat(begin[take], times) + step]
                point = np.repeat(ok[take], times)
                period = np.abs(place - anchor[point])
                yield point, middle[point] - (period if side < 0 else 0), period
        size, level = size * 2, level + 1
        spots = np.sort(places[np.concatenate([alike, [False]]) | np.concatenate([[False], alike])])
        spots = spots[spots + size <= length]


def _least_period(start: np.ndarray, end: np.ndarray, period: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct stretches, each with its least period; ``more`` are further keys, which come first."""
    order = np.lexsort((period, end, start, *more[::-1]))
    columns = [c[order] for c in (*more, start, end)]
    first = np.ones(len(order), bool)
    if len(order):
        first[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return tuple(c[order][first] for c in (start, end, period, *more))


def runs_of(word: np.ndarray, symbols: int, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and period of all runs, by start, then period.

    ``edges`` are the bounds of the texts in ``word``; no number occurs in two texts.
    """
    grammar = Grammar(word, symbols)
    none = np.empty(0, "int64")
    if not grammar.rules:
        return none, none, none
    _, first = np.unique(grammar.rule, return_index=True)
    place, left, whole = grammar.place[first], grammar.left[first], grammar.whole[first]
    text = np.searchsorted(edges, grammar.starts, "right") - 1
    ruled = np.zeros(len(edges), bool)
    ruled[np.searchsorted(edges, place, "right") - 1] = True
    between = (grammar.starts > edges[text]) & ruled[text]
    starts, text = grammar.starts[between], text[between]
    low = np.concatenate([place, edges[text]])
    middle = np.concatenate([place + left, starts])
    high = np.concatenate([place + whole, edges[text + 1]])
    hashes = Hashes(word)

    finds = []
    for point, x, period in _candidates(hashes, len(word), low, middle, high):
        y = x + period
        # The half of the run that reaches furthest shows its first words at both places.
        need = np.maximum(SHORTEST // 2 - period, (period + 1) // 2)
        ahead = x == middle[point]
        fits = np.where(ahead, y + need <= high[point], x - need >= low[point])
        point, x, y, period, need, ahead = (v[fits] for v in (point, x, y, period, need, ahead))
        fits = hashes.equal(np.where(ahead, x, x - need), np.where(ahead, y, y - need), need)
        point, x, y, period = (v[fits] for v in (point, x, y, period))
        start = x - hashes.backward(x, y, x - low[point])
        end = y + hashes.forward(x, y, high[point] - y)
        long = end - start >= np.maximum(SHORTEST, PERIODS * period)
        finds.append((start[long], end[long], period[long], point[long]))
    if not finds:
        return none, none, none
    start, end, period, point = _least_period(*(np.concatenate([f[i] for f in finds]) for i in range(4)))

    failed = set()
    inside = point < len(place)
    checked = _least_period(start, end, period)
    for s, e, q in zip(*(c.tolist() for c in checked)):
        if not np.array_equal(word[s:e - q], word[s + q:e]):
            failed.add(int(np.searchsorted(edges, s, "right")) - 1)

    # To all occurrences of the rules.
    order = np.argsort(grammar.rule, kind="stable")
    counts = np.bincount(grammar.rule, minlength=grammar.rules)
    begin = np.cumsum(counts) - counts
    rule = point[inside]
    times = counts[rule]
    step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    shift = grammar.place[order[np.repeat(begin[rule], times) + step]] - np.repeat(place[rule], times)
    start = np.concatenate([start[~inside], np.repeat(start[inside], times) + shift])
    end = np.concatenate([end[~inside], np.repeat(end[inside], times) + shift])
    period = np.concatenate([period[~inside], np.repeat(period[inside], times)])
    ends_here = (start == 0) | (word[start - 1] != word[np.minimum(start - 1 + period, len(word) - 1)])
    ends_here &= (end == len(word)) | (word[np.minimum(end, len(word) - 1)] != word[end - period])
    start, end, period = _least_period(start[ends_here], end[ends_here], period[ends_here])
    for t in failed:
        ours = (start >= edges[t]) & (start < edges[t + 1])
        s, e, q = plain_runs(word[edges[t]:edges[t + 1]])
        start, end, period = (np.concatenate([a[~ours], b]) for a, b in (
            (start, s + edges[t]), (end, e + edges[t]), (period, q)))
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def plain_runs(word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The runs of one text by comparing it with itself at every period: exact, in quadratic time."""
    found: dict[tuple[int, int], int] = {}
    for q in range(1, len(word) // PERIODS + 1):
        same = np.concatenate([[False], word[:-q] == word[q:], [False]]).astype("int8")
        turns = np.diff(same)
        for s, e in zip(np.flatnonzero(turns == 1).tolist(), np.flatnonzero(turns == -1).tolist()):
            if e + q - s >= max(SHORTEST, PERIODS * q):
                found.setdefault((s, e + q), q)
    rows = np.array([(s, e, q) for (s, e), q in found.items()], "int64").reshape(-1, 3)
    return rows[:, 0], rows[:, 1], rows[:, 2]


def numbered(texts: list[list[bytes]]) -> tuple[np.ndarray, int, np.ndarray]:
    """Words as numbers that no two texts share, the count of numbers, and the bounds of the texts."""
    base, parts = 0, []
    for words in texts:
        numbers: dict[bytes, int] = defaultdict(count(base).__next__)
        parts.append(np.fromiter(map(numbers.__getitem__, words), "int64", len(words)))
        base += len(numbers)
    edges = np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype="int64")])
    return np.concatenate(parts), base, edges


def collapse_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: ``key``, ``n_words``, ``runs`` and ``collapsed``.

    ``runs`` is an array of (start, length, period), in words, by start, then period. ``collapsed`` joins by a
    space the words that no run holds after its first period. Null, empty and blank texts have no words, no
    run and an empty text. Repeated rows and null keys are returned as they are; an empty table gives an empty one.
    """
    schema = (f"`{key}` long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, BATCH_BYTES):
            texts = [t.encode().split() for t in batch.column("text").to_pylist()]
            word, symbols, edges = numbered(texts)
            start, end, period = runs_of(word, symbols, edges)
            owner = np.searchsorted(edges, start, "right") - 1
            begins = np.searchsorted(owner, np.arange(len(texts) + 1))
            dropped = np.zeros(len(word) + 1, "int64")
            np.add.at(dropped, start + period, 1)
            np.add.at(dropped, end, -1)
            kept = np.cumsum(dropped)[:-1] == 0
            collapsed = []
            for i, words in enumerate(texts):
                if begins[i] < begins[i + 1]:
                    words = [words[j] for j in np.flatnonzero(kept[edges[i]:edges[i + 1]]).tolist()]
                collapsed.append(b" ".join(words))
            runs = pa.StructArray.from_arrays(
                [pa.array(start - edges[owner]), pa.array(end - start), pa.array(period)],
                names=["start", "length", "period"])
            yield pa.RecordBatch.from_arrays([
                batch.column("key"), pa.array(np.diff(edges)),
                pa.ListArray.from_arrays(pa.array(begins.astype("int32")), runs),
                pa.array(collapsed, pa.binary()).cast(pa.string()),
            ], names=[key, "n_words", "runs", "collapsed"])

    return keyed_text(docs, key, text).mapInArrow(run, schema)
