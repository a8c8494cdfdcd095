"""Periodic runs against all periods tried at all places."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from codecorpus.llm.periodic_runs import Matches, periodic_runs, re_pair, runs_of
from codecorpus.llm.queries import QUERIES


def brute_runs(words: list[str], least: int = 12) -> list[tuple[int, int, int]]:
    """(start, length, period), by start and period."""
    found: dict[tuple[int, int], int] = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i) + 1
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda x: (x[0], x[2]))


def brute_collapsed(words: list[str], runs: list[tuple[int, int, int]]) -> str:
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in dropped)


def awkward(r: random.Random) -> list[str]:
    kind = r.randrange(7)
    if kind == 0:
        return [r.choice("ab") for _ in range(r.randrange(120))]
    if kind == 1:
        return ["a"] * r.randrange(70)
    if kind == 2:
        period = [r.choice("abc") for _ in range(r.randint(1, 20))]
        return (period * 20)[: r.randrange(100)] + [r.choice("abc") for _ in range(r.randrange(30))]
    if kind == 3:  # Fibonacci words: as many runs as can be
        a, b = ["a"], ["a", "b"]
        while len(b) < 150:
            a, b = b, b + a
        return b[: r.randrange(150)]
    if kind == 4:  # runs in runs
        x, y = ([r.choice("abcd") for _ in range(r.randint(1, 7))] * r.randint(2, 8) for _ in range(2))
        return (x + y) * r.randint(1, 4) + x
    if kind == 5:  # Thue-Morse words, on which sums of powers of one base collide
        return ["ab"[bin(i).count("1") % 2] for i in range(r.randrange(300))]
    return [str(r.randrange(1000)) for _ in range(r.randrange(200))]


def in_slice(texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    known: dict = {}
    ids = [known.setdefault((i, w), len(known)) for i, t in enumerate(texts) for w in t]
    rows = [i for i, t in enumerate(texts) for _ in t]
    return np.array(ids, dtype=np.int64), np.array(rows, dtype=np.int64), np.cumsum([0, *map(len, texts)])


def test_runs_by_all_periods():
    r = random.Random(5)
    for _ in range(50):
        texts = [awkward(r) for _ in range(25)]
        ids, rows, bounds = in_slice(texts)
        start, stop, period = runs_of(ids, rows)
        found = list(zip(start.tolist(), (stop - start).tolist(), period.tolist(), strict=True))
        expected = [(s + bounds[i], n, q) for i, t in enumerate(texts) for s, n, q in brute_runs(t)]
        assert found == expected


def test_a_grammar_derives_its_texts():
    r = random.Random(9)
    texts = [awkward(r) for _ in range(40)]
    ids, rows, _ = in_slice(texts)
    grammar = re_pair(ids, rows)
    for rule, place in zip(grammar.rule.tolist(), grammar.place.tolist(), strict=True):
        size = grammar.end[rule] - grammar.begin[rule]
        assert ids[place : place + size].tolist() == ids[grammar.begin[rule] : grammar.end[rule]].tolist()
        assert rows[place] == rows[place + size - 1]
    # A text of n words has n - 1 derivations, whatever the rules are.
    assert len(grammar.place) == sum(max(len(t) - 1, 0) for t in texts)
    # A repeated word needs few rules, each computed once.
    assert len(re_pair(np.zeros(4096, dtype=np.int64), np.zeros(4096, dtype=np.int64)).begin) <= 24


def test_agreement_of_places():
    r = random.Random(2)
    ids = np.array([r.randrange(2) for _ in range(60)] * 3, dtype=np.int64)
    matches = Matches(ids)
    x = np.array([r.randrange(90) for _ in range(300)])
    y = x + np.array([r.randint(1, 60) for _ in x])
    right, left = matches.right(x, y, len(ids) - y), matches.left(x, y, x)
    for a, b, n, m in zip(x.tolist(), y.tolist(), right.tolist(), left.tolist(), strict=True):
        assert n == next((k for k in range(len(ids) - b) if ids[a + k] != ids[b + k]), len(ids) - b)
        assert m == next((k for k in range(a) if ids[a - 1 - k] != ids[b - 1 - k]), a)


def as_words(text: str | None) -> list[str]:
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def test_awkward_rows_and_clashing_columns(spark, docs, rows, no_docs):
    r = random.Random(3)
    more = [(1000 + i, " x   ".join(awkward(r)) + "\n\t ", "", "", 0, 0, 0) for i in range(60)]
    frame = docs.unionAll(spark.createDataFrame(more, docs.schema)).withColumnsRenamed({"kid": "runs", "line_no": "collapsed", "lang": "n_words"})
    found = sorted(((f.id, f.n_words, [tuple(x) for x in f.runs], f.collapsed) for f in periodic_runs(frame).collect()), key=repr)
    expected = []
    for row in [*rows, *more]:
        words = as_words(row[1])
        runs = brute_runs(words) if len(words) < 5000 else []
        expected.append((row[0], len(words), runs, brute_collapsed(words, runs)))
    assert found == sorted(expected, key=repr)
    assert periodic_runs(no_docs).count() == 0
    with pytest.raises(ValueError, match="least"):
        periodic_runs(docs, least=6)


def test_query_by_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    expected = set()
    for doc_id, text in docs:
        words = as_words(text)
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        runs = brute_runs(words)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        top = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
        listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
        expected.add((doc_id, len(runs), *top, *(hashlib.sha256(x.encode()).hexdigest() for x in (listed, brute_collapsed(words, runs)))))
    found = QUERIES["op11_periodic_runs"](spark, "/root/testdata/sf0.001")
    assert set(map(tuple, found.collect())) == expected
    assert len([x for x in expected if x[1]]) > 10
