"""Periodic runs of words, by block matching.

A run is a stretch of consecutive words with smallest period q (words q apart are equal) that has at least `least` words
and `times` periods, and that no neighbouring word extends. The search, in one text:

1. A word of a run occurs `times` times in it or more. Texts are cut at words that occur less often, and so are the
   pieces; what is left is searched. That loses no run and leaves little of ordinary prose.
2. For each power of two s, the aligned blocks of s words (at 0, s, 2s, ...) are the keys of an Aho-Corasick automaton
   over integers, which finds all their occurrences in the piece. A run of period q with s <= q < 2s holds an aligned
   block that starts among its first s words, and as it has `times` periods, that block occurs again at the distances q,
   2q, ... (times - 2)q inside it. So a block with such occurrences at a distance d in [s, 2s) is a seed of period d, and
   each run has a seed.
3. A seed is extended to both sides, word by word, as far as words d apart are equal. What is long enough is a run; it
   has been met with a smaller period before, if d isn't its smallest one.

Keys have KEY letters at most: for longer blocks a letter stands for a stretch of words, numbered exactly by doubling
(pairs of numbers), and the piece is searched once for each offset of its letters. So depth and size of an automaton are
bounded by KEY and by a piece's words.

Defined results: words are what ASCII white space parts; a null or empty text has no words and no runs, and collapses to
an empty text; bytes that aren't UTF-8 are words like others; very long texts are searched whole; equal rows get equal
results; an empty table gives an empty table. Added columns replace those of the same name; other columns stay.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words and periods of a run at least.
LEAST, TIMES = 6, 4
#: Letters of an automaton's key at most.
KEY = 32
#: Rounds of cutting at rare words.
CUTS = 8
#: Documents of an Arrow batch at most.
BATCH_ROWS = 500

ADDED = ("runs", "n_runs", "collapsed")


def pieces(words: list[bytes], least: int, times: int) -> list[tuple[int, int]]:
    """Stretches [low, high) in which each word occurs `times` times or more (or which CUTS rounds didn't cut further)."""
    out, open_ = [], [(0, len(words), 0)]
    while open_:
        low, high, cuts = open_.pop()
        if high - low < least:
            continue
        part = words[low:high]
        often = {w for w, n in Counter(part).items() if n >= times}
        rare = [low + i for i, w in enumerate(part) if w not in often] if often else [low]
        if not rare or (often and cuts == CUTS):
            out.append((low, high))
        elif often:
            ends = [low - 1, *rare, high]
            open_ += [(a + 1, b, cuts + 1) for a, b in zip(ends, ends[1:], strict=False) if b - a > least]
    return sorted(out)


def occurrences(names: np.ndarray, stretch: int, size: int, n: int) -> np.ndarray:
    """At each place, where the aligned block of `size` words that occurs there was first seen; -1 without one. names: a
    number for each stretch of `stretch` words."""
    import ahocorasick

    letters = size // stretch
    first: dict[tuple[int, ...], int] = {}
    for at in range(0, n - size + 1, size):
        first.setdefault(tuple(names[at : at + size : stretch].tolist()), at)
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for key, at in first.items():
        automaton.add_word(key, at)
    automaton.make_automaton()
    found = np.full(n, -1, np.int64)
    for offset in range(stretch):
        hits = np.array(list(automaton.iter(tuple(names[offset::stretch].tolist()))), np.int64).reshape(-1, 2)
        found[offset + (hits[:, 0] - (letters - 1)) * stretch] = hits[:, 1]
    return found


def seeds(found: np.ndarray, size: int, times: int) -> Iterator[tuple[int, np.ndarray]]:
    """By distance d in [size, 2 size): starts of aligned blocks that occur again at d, 2d, ... (times - 2)d."""
    n, most = len(found), min(2 * size - 1, len(found) // times)
    starts = np.arange(0, n - size + 1, size)
    again = range(1, times - 1)
    if size <= len(starts):
        for d in range(size, most + 1):
            at = starts[: np.searchsorted(starts, n - size - (times - 2) * d, "right")]
            yield d, at[np.logical_and.reduce([found[at + k * d] == found[at] for k in again])]
        return
    by_distance: dict[int, list[int]] = {}
    for at in starts.tolist():
        d = np.arange(size, min(most, (n - size - at) // (times - 2)) + 1)
        for x in d[np.logical_and.reduce([found[at + k * d] == found[at] for k in again])].tolist():
            by_distance.setdefault(x, []).append(at)
    for d in sorted(by_distance):
        yield d, np.array(by_distance[d])


def matching(x: np.ndarray, at: int, d: int) -> tuple[int, int]:
    """The largest [low, high) around `at` in which x[i] == x[i + d]; steps double, so that short ones cost little."""
    low, high, step = at, at, 16
    while high + d < len(x):
        differ = x[high : min(high + step, len(x) - d)] != x[high + d : high + d + step]
        k = int(differ.argmax())
        if differ[k]:
            high += k
            break
        high, step = high + len(differ), 2 * step
    step = 16
    while low > 0:
        start = max(0, low - step)
        differ = (x[start:low] != x[start + d : low + d])[::-1]
        k = int(differ.argmax())
        if differ[k]:
            low -= k
            break
        low, step = start, 2 * step
    return low, high


def runs_of(x: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a piece whose words are small numbers."""
    if times < 3:
        raise ValueError("a run needs three periods at least, or no block of it surely occurs twice")
    n = len(x)
    ends: dict[tuple[int, int], int] = {}
    known: dict[int, list[tuple[int, int]]] = {}  # by period: starts and ends, ascending
    names, stretch, size = x, 1, 1
    while size * times <= n:
        if size // stretch > KEY:
            pairs = names[:-stretch] * (int(names.max()) + 1) + names[stretch:]
            names, stretch = np.unique(pairs, return_inverse=True)[1], 2 * stretch
        for d, at in seeds(occurrences(names, stretch, size, n), size, times):
            of = [known[q] for q in known if d % q == 0]
            i = 0
            while i < len(at):
                start, until = int(at[i]), None
                for all_ in of:
                    k = bisect_right(all_, (start, n)) - 1
                    # inside a run of a period that divides d there is no other run of period d
                    if k >= 0 and start + (times - 2) * d + size <= all_[k][1]:
                        until = all_[k][1] - (times - 2) * d - size + 1
                if until is None:
                    low, until = matching(x, start, d)
                    end = until + d
                    if end - low >= max(least, times * d) and (low, end) not in ends:
                        ends[low, end] = d
                        known.setdefault(d, []).append((low, end))
                i += max(1, int(np.searchsorted(at[i:], until)))
        size *= 2
    return sorted((low, end - low, d) for (low, end), d in ends.items())


def found_in(text: bytes | None, least: int = LEAST, times: int = TIMES) -> tuple[list[dict[str, int]], bytes]:
    """The runs of a text by start and period, and the text without what any run repeats after its first period, its words parted by a space."""
    words = (text or b"").split()
    runs = []
    for low, high in pieces(words, least, times):
        number: dict[bytes, int] = {}
        x = np.fromiter((number.setdefault(w, len(number)) for w in words[low:high]), np.int64, high - low)
        runs += [{"start": low + start, "length": length, "period": period} for start, length, period in runs_of(x, least, times)]
    if runs:
        runs.sort(key=lambda r: (r["start"], r["period"]))
        stay = np.ones(len(words), bool)
        for r in runs:
            stay[r["start"] + r["period"] : r["start"] + r["length"]] = False
        words = [words[i] for i in np.flatnonzero(stay).tolist()]
    return runs, b" ".join(words)


def with_runs(docs: DataFrame, text: str = "text", keep: list[str] | None = None, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """The columns `keep` (all by default), runs (array of start, length, period; by start, then period), n_runs, and collapsed
    (the text without what runs repeat). Run what uses it inside store.batches_of(spark, BATCH_ROWS), so that texts come in
    small Arrow batches."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ADDED]
    at = [docs.columns.index(c) for c in keep]
    of = docs.columns.index(text)
    run = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [found_in(x.as_py(), least, times) for x in batch.column(of).cast(pa.binary())]
            runs, sizes = pa.array([g[0] for g in got], run), pa.array([len(g[0]) for g in got], pa.int64())
            # bytes stay as they are, even where they aren't UTF-8
            collapsed = pa.array([g[1] for g in got], pa.binary()).view(pa.string())
            yield pa.RecordBatch.from_arrays([*map(batch.column, at), runs, sizes, collapsed], [*keep, *ADDED])

    kinds = T.StructType([docs.schema[i] for i in at])
    numbers = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
    for name, kind in zip(ADDED, (T.ArrayType(numbers), T.LongType(), T.StringType()), strict=True):
        kinds = kinds.add(name, kind)
    return docs.mapInArrow(search, kinds)


def most_repeated(runs: Column) -> Column:
    """The run with most periods (compared exactly), of several the first by start, then by period; null without runs."""

    def better(best: Column, r: Column) -> Column:
        # both are in order of start and period, so only a truly greater one takes the place
        return F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)

    return F.aggregate(runs, F.get(runs, F.lit(0)), better)
