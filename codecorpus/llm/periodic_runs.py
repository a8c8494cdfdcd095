"""Periodic runs of words: Re-Pair grammars, runs across each nonterminal's boundary once, translated to all places, merged."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codecorpus.llm.fill_in_middle import slices
from codecorpus.llm.hashing import mixed

#: Least length of a run, in words; a run also has two periods at least.
LEAST = 12
#: A run longer than this matches itself, a period later, in a window of this many words at its nonterminal's boundary.
WINDOW = 3
_PRIMES = (np.uint64((1 << 31) - 1), np.uint64((1 << 31) - 19))


class Grammar(NamedTuple):
    """Nonterminals: begin, boundary and end of the first derivation; and all derivations, by nonterminal."""

    begin: np.ndarray
    middle: np.ndarray
    end: np.ndarray
    rule: np.ndarray
    place: np.ndarray


def _places_in_run(same: np.ndarray) -> np.ndarray:
    """How many entries right before each one are marked without a gap."""
    at = np.arange(len(same))
    return at - np.maximum.accumulate(np.where(same, 0, at))


def re_pair(ids: np.ndarray, rows: np.ndarray) -> Grammar:
    """A grammar for every text of a slice at once; ``ids`` of different texts differ.

    Each round pairs the symbols of the pairs that occur most often: of overlapping pairs the
    more frequent one, of a repeated symbol every other place. Rounds end when no pair of a
    text occurs twice; what is left is halved into a balanced tree, whose nodes derive one place.
    """
    symbol, row, begin = ids.astype(np.int64), rows, np.arange(len(ids))
    end, next_symbol = begin + 1, int(ids.max(initial=-1)) + 1
    firsts: list[tuple] = []
    derived: list[tuple] = []
    left: list[tuple] = []
    n_rules = 0

    def add(rule: np.ndarray, first: np.ndarray, at: np.ndarray) -> None:
        nonlocal n_rules
        firsts.append((begin[at[first]], begin[at[first] + 1], end[at[first] + 1]))
        derived.append((rule + n_rules, begin[at]))
        n_rules += len(first)

    def pair(at: np.ndarray) -> None:
        nonlocal symbol, row, begin, end
        end[at] = end[at + 1]
        stay = np.ones(len(symbol), dtype=bool)
        stay[at + 1] = False
        symbol, row, begin, end = symbol[stay], row[stay], begin[stay], end[stay]

    while len(symbol):
        at = np.flatnonzero(row[:-1] == row[1:])
        kinds, _ = pd.factorize(symbol[at] * next_symbol + symbol[at + 1])
        beside = np.concatenate([[False], np.diff(at) == 1])[: len(at)]
        same = beside & (kinds == np.concatenate([[-1], kinds[:-1]])[: len(at)])
        odd = _places_in_run(same) % 2 == 1
        counts = np.bincount(kinds[~odd]) if len(at) else np.empty(0, dtype=np.int64)
        often = np.where(odd, 0, counts[kinds])
        again = often >= 2
        weight = np.where(again, often * (len(counts) + 1) + kinds, 0)
        before = np.where(beside, np.concatenate([[0], weight[:-1]])[: len(at)], 0)
        after = np.where(np.concatenate([beside[1:], [False]])[: len(at)], np.concatenate([weight[1:], [0]])[: len(at)], 0)
        chosen = again & (weight > before) & (weight > after)
        # Texts in which no pair occurs twice are done.
        open_rows = np.zeros(int(row[-1]) + 1, dtype=bool)
        open_rows[row[at[chosen]]] = True
        done = ~open_rows[row]
        if done.any():
            left.append((row[done], begin[done], end[done]))
        if not chosen.any():
            break
        rule, kinds = pd.factorize(kinds[chosen])
        _, first = np.unique(rule, return_index=True)
        add(rule, first, at[chosen])
        symbol[at[chosen]] = next_symbol + rule
        next_symbol += len(first)
        gone = done.copy()
        end[at[chosen]] = end[at[chosen] + 1]
        gone[at[chosen] + 1] = True
        symbol, row, begin, end = symbol[~gone], row[~gone], begin[~gone], end[~gone]

    if left:
        row, begin, end = (np.concatenate(x) for x in zip(*left, strict=True))
        order = np.argsort(begin, kind="stable")
        symbol, row, begin, end = order, row[order], begin[order], end[order]
    while True:
        beside = np.concatenate([[False], row[1:] == row[:-1]])[: len(row)]
        at = np.flatnonzero(_places_in_run(beside) % 2 == 1) - 1
        if not len(at):
            break
        add(np.arange(len(at)), np.arange(len(at)), at)
        pair(at)

    if not firsts:
        none = np.empty(0, dtype=np.int64)
        return Grammar(none, none, none, none, none)
    b, m, e = (np.concatenate(x) for x in zip(*firsts, strict=True))
    rule, place = (np.concatenate(x) for x in zip(*derived, strict=True))
    order = np.argsort(rule, kind="stable")
    return Grammar(b, m, e, rule[order], place[order])


class Matches:
    """How far two places of a slice agree, to the right and to the left, by hashes of prefixes (two primes, 62 bits)."""

    def __init__(self, ids: np.ndarray) -> None:
        n = len(ids)
        self.primes = []
        for i, prime in enumerate(_PRIMES):
            base = mixed(np.array([i + 11], dtype=np.uint64))[0] % prime
            power = np.ones(n + 1, dtype=np.uint64)
            done = 1
            while done <= n:  # powers, doubled
                more = min(done, n + 1 - done)
                power[done : done + more] = power[:more] * (power[done - 1] * base % prime) % prime
                done += more
            values = mixed(ids.astype(np.uint64) + np.uint64(i << 40)) % prime
            total = np.concatenate([[np.uint64(0)], np.cumsum(values * power[:n] % prime, dtype=np.uint64) % prime])
            self.primes.append((prime, power, total))

    def _equal(self, x: np.ndarray, y: np.ndarray, size: np.ndarray) -> np.ndarray:
        same = np.ones(len(x), dtype=bool)
        for prime, power, total in self.primes:
            one = (total[x + size] + prime - total[x]) % prime * power[y - x] % prime
            same &= one == (total[y + size] + prime - total[y]) % prime
        return same

    def right(self, x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Most words, up to ``most``, that agree from x and from y > x on."""
        low, high = np.zeros_like(most), most.copy()
        while (open_ := low < high).any():
            half = (low + high + 1) // 2
            same = self._equal(x, y, half) & open_
            low, high = np.where(same, half, low), np.where(same | ~open_, high, half - 1)
        return low

    def left(self, x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Most words, up to ``most``, that agree before x and before y > x."""
        low, high = np.zeros_like(most), most.copy()
        while (open_ := low < high).any():
            half = (low + high + 1) // 2
            size = np.where(open_, half, 0)
            same = self._equal(x - size, y - size, size) & open_
            low, high = np.where(same, half, low), np.where(same | ~open_, high, half - 1)
        return low


def _windows(ids: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """A number for the words at i, i + 1 and i + 2; -1 where a text ends before."""
    found = np.full(len(ids) + WINDOW, -1, dtype=np.int64)
    if len(ids) >= WINDOW:
        at = np.flatnonzero(rows[: 1 - WINDOW] == rows[WINDOW - 1 :])
        codes = ids[at]
        for shift in range(1, WINDOW):
            codes, _ = pd.factorize(codes * np.int64(len(ids)) + ids[at + shift])
            codes = codes.astype(np.int64)
        found[at] = codes
    return found


def runs_of(ids: np.ndarray, rows: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and period of all runs of a slice of texts, by begin and period. ``ids`` of different texts differ."""
    none = np.empty(0, dtype=np.int64)
    windows = _windows(ids, rows)
    order = np.argsort(windows[: len(ids)], kind="stable")
    stride = np.int64(len(windows) + 1)
    sorted_windows = windows[order] * stride + order
    counts = np.bincount(windows[: len(ids)] + 1, minlength=1)
    counts[0] = 0
    often = np.concatenate([counts[windows[: len(ids)] + 1] > 1, np.zeros(WINDOW, dtype=bool)])
    if not often.any():
        return none, none, none
    grammar = re_pair(ids, rows)

    # A run of length l >= 12 and 2p across a boundary m agrees with itself, p words apart, in l - p >= 6 words
    # in a row around m: in the three from m on or in the three before it.
    long = np.flatnonzero(grammar.end - grammar.begin >= least)
    found = []
    for shift in (0, -WINDOW):
        at = grammar.middle[long] + shift
        rule = long[(at >= grammar.begin[long]) & often[np.maximum(at, 0)]]
        at = grammar.middle[rule] + shift
        key = windows[at] * stride
        first, last = np.searchsorted(sorted_windows, key + grammar.begin[rule]), np.searchsorted(sorted_windows, key + grammar.end[rule])
        size = last - first
        other = order[np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
        found.append((np.repeat(rule, size), other - np.repeat(at, size)))
    rule, apart = (np.concatenate(x) for x in zip(*found, strict=True))
    rule, apart = rule[apart != 0], apart[apart != 0]
    period = np.abs(apart)
    keep = 2 * period <= grammar.end[rule] - grammar.begin[rule]
    rule, apart, period = rule[keep], apart[keep], period[keep]
    begin, middle, end = grammar.begin[rule], grammar.middle[rule], grammar.end[rule]
    # Either the period before the boundary or the one after it is whole inside the run.
    near = np.where(apart < 0, middle - period, middle)
    keep = (near >= begin) & (near + period <= end)
    rule, period, begin, end, near = rule[keep], period[keep], begin[keep], end[keep], near[keep]
    if not len(rule):
        return none, none, none
    matches = Matches(ids)
    start = near - matches.left(near, near + period, near - begin)
    stop = near + period + matches.right(near, near + period, end - near - period)
    keep = stop - start >= np.maximum(least, 2 * period)
    rule, period, start, stop = rule[keep], period[keep], start[keep] - begin[keep], stop[keep] - begin[keep]
    order = np.lexsort((period, stop, start, rule))  # of one stretch the least period
    rule, period, start, stop = rule[order], period[order], start[order], stop[order]
    new = np.ones(len(rule), dtype=bool)
    new[1:] = (rule[1:] != rule[:-1]) | (start[1:] != start[:-1]) | (stop[1:] != stop[:-1])
    rule, period, start, stop = rule[new], period[new], start[new], stop[new]

    # To every place that the nonterminal derives.
    first, last = np.searchsorted(grammar.rule, rule), np.searchsorted(grammar.rule, rule, side="right")
    size = last - first
    place = grammar.place[np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
    start, stop, period = np.repeat(start, size) + place, np.repeat(stop, size) + place, np.repeat(period, size)

    # A run cut off by a nonterminal's edges lies in the whole run, which the least nonterminal around it has found.
    order = np.lexsort((-stop, start, period))
    start, stop, period = start[order], stop[order], period[order]
    reach = np.maximum.accumulate(period * stride + stop) if len(period) else none
    whole = np.ones(len(period), dtype=bool)
    whole[1:] = period[1:] * stride + stop[1:] > reach[:-1]
    start, stop, period = start[whole], stop[whole], period[whole]
    order = np.lexsort((period, stop, start))
    start, stop, period = start[order], stop[order], period[order]
    new = np.ones(len(start), dtype=bool)
    new[1:] = (start[1:] != start[:-1]) | (stop[1:] != stop[:-1])
    start, stop, period = start[new], stop[new], period[new]
    order = np.lexsort((period, start))
    return start[order], stop[order], period[order]


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _read(texts: list[bytes], least: int) -> list[pa.Array]:
    """Words, runs and collapsed text of each text."""
    words: list[bytes] = []
    ids: list[int] = []
    sizes = np.empty(len(texts), dtype=np.int64)
    base = 0
    for i, text in enumerate(texts):
        own = text.split()  # bytes split at the six blanks of ASCII and nothing else
        known = dict.fromkeys(own)
        known = dict(zip(known, range(base, base + len(known)), strict=True))
        base += len(known)
        ids += map(known.__getitem__, own)
        words += own
        sizes[i] = len(own)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    rows = np.repeat(np.arange(len(texts)), sizes)
    start, stop, period = runs_of(np.array(ids, dtype=np.int64), rows, least)
    of = np.searchsorted(bounds, start, side="right") - 1
    runs = pa.ListArray.from_arrays(
        pa.array(np.searchsorted(of, np.arange(len(texts) + 1)), pa.int32()),
        pa.StructArray.from_arrays([pa.array(start - bounds[of]), pa.array(stop - start), pa.array(period)], fields=list(_RUN)),
    )
    steps = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(steps, start + period, 1)
    np.add.at(steps, stop, -1)
    dropped = np.cumsum(steps)[:-1] > 0
    holds = np.zeros(len(texts), dtype=bool)
    holds[of] = True
    left = []
    for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        kept = (words[j] for j in (np.flatnonzero(~dropped[a:b]) + a).tolist()) if holds[i] else words[a:b]
        left.append(b" ".join(kept))
    return [pa.array(sizes), runs, pa.array(left, pa.binary()).cast(pa.string())]


def periodic_runs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least: int = LEAST) -> DataFrame:
    """``id, n_words, runs, collapsed`` for every row of ``docs``.

    Words are what blanks of ASCII part. A run is a stretch of words with least period q
    (words q apart are equal), of at least ``least`` words and 2 q, that no word beside it
    continues; ``runs`` holds start (from 0), length and period, by start and period.
    ``collapsed`` is the words joined by blanks, without those that a run has after its first q.

    Each text's words become a Re-Pair grammar. A run of the text lies across the boundary of
    one nonterminal, the least that spans it, so runs across each boundary are computed at one
    derivation and moved to all the others. Null and empty texts have no run and an empty
    ``collapsed``; a null id stays null; repeated rows and equal ids give one row each; one
    word repeated is a run of period 1. Columns of ``docs`` other than the two play no part.
    Texts are worked off in slices of about 2 MB, a longer one by itself, whole.
    A ``least`` below four times ``WINDOW`` would lose short runs and is refused.
    """
    if least < 4 * WINDOW:
        raise ValueError(f"least must be {4 * WINDOW} or more")
    read = docs.select(F.col(id_column).alias("id"), F.encode(F.coalesce(F.col(text_column).cast("string"), F.lit("")), "utf-8").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2_000_000):
            made = _read(batch.column("text").to_pylist(), least)
            yield pa.RecordBatch.from_arrays([batch.column("id"), *made], names=["id", "n_words", "runs", "collapsed"])

    kind = read.schema["id"].dataType.simpleString()
    return read.mapInArrow(run, f"id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
