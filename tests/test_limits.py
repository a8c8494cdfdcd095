import random

import pytest
from pyspark.sql import functions as F

from codecorpus.operators import filters, limits


def walk(files, budget, most):
    """The rule, file by file."""
    kept, total, count = set(), {}, {}
    for repo, path, size in sorted(files):
        if count.get(repo, 0) < most and total.get(repo, 0) + size <= budget:
            kept.add((repo, path))
            total[repo] = total.get(repo, 0) + size
            count[repo] = count.get(repo, 0) + 1
    return kept


def frame(spark, rows):
    return spark.createDataFrame(rows, "repo string, path string, size long").repartition(7)


@pytest.mark.parametrize("shape", ["random", "falling", "rising", "tiny first", "zero"])
def test_budget_is_the_greedy_walk(spark, shape):
    rng = random.Random(3)
    sizes = {
        "random": lambda i: rng.randint(0, 400),
        "falling": lambda i: 400 - i,
        "rising": lambda i: i,
        "tiny first": lambda i: 1 if i == 0 else 1000 - i % 3,
        "zero": lambda i: 0,
    }[shape]
    # One repository owns most files.
    rows = [("big", f"f{i:04}", sizes(i)) for i in range(380)]
    rows += [(f"small{i % 5}", f"f{i:04}", sizes(i)) for i in range(60)]
    for budget, most in ((1000, 5), (1000, 100), (150, 10), (5000, 40)):
        found = limits.admit_within_budget(frame(spark, rows), budget, most).collect()
        assert {(r.repo, r.path) for r in found} == walk(rows, budget, most)


@pytest.mark.parametrize("share", [0.7, 2.0])
def test_a_large_budget_takes_few_rounds(spark, monkeypatch, share):
    """Rounds follow the files that don't fit, not the number of files."""
    rounds, plain = [], limits._first_files
    monkeypatch.setattr(limits, "_first_files", lambda *a: rounds.append(1) or plain(*a))
    rng = random.Random(5)
    rows = [("big", f"f{i:06}", rng.randint(0, 4000)) for i in range(60_000)] + [("small", f"f{i}", 100) for i in range(30)]
    budget = int(share * sum(size for _, _, size in rows))
    found = limits.admit_within_budget(frame(spark, rows), budget, 1_000_000).collect()
    assert {(r.repo, r.path) for r in found} == walk(rows, budget, 1_000_000)
    assert len(rounds) <= 10


def test_budget_of_no_files(spark):
    assert limits.admit_within_budget(frame(spark, [("r", "a", 5)]).filter("false"), 10, 3).count() == 0
    assert limits.admit_within_budget(frame(spark, [("r", "a", 50)]), 10, 3).count() == 0


def test_queue_positions_across_tasks(spark):
    rng = random.Random(4)
    rows = [("big" if i % 4 else f"s{i % 3}", f"f{i:05}", rng.randint(1, 3)) for i in range(4000)]
    files = spark.createDataFrame(rows, "repo string, path string, priority int").repartition(9)
    expected, last = {}, {}
    for repo, priority, path in sorted((r, p, f) for r, f, p in rows):
        last[repo] = last.get(repo, 0) + 1
        expected[repo, path] = last[repo]
    found = limits.priority_queue(files).collect()
    assert {(r.repo, r.path): r.queue_pos for r in found} == expected
    heads = {r.repo: r.path for r in limits.next_file(files).collect()}
    assert heads == {repo: path for (repo, path), n in expected.items() if n == 1}


def test_file_cap(spark):
    rows = [(f"r{i % 2}", f"f{i:03}", 1) for i in range(30)]
    found = {(r.repo, r.path) for r in limits.limit_files(frame(spark, rows), 4).collect()}
    assert found == {(f"r{i % 2}", f"f{i:03}") for i in range(8)}


def test_filters(spark):
    cases = [
        ("a/x.py", 1, True),
        ("a/x.PY", 1, False),
        ("a/node_modules/b/x.py", 1, False),
        ("a/node_modules.py", 1, True),
        ("a/.git/x.py", 1, False),
        ("a/config.json", 1, False),
        ("a/big.py", 5 * 1024 * 1024, True),
        ("a/bigger.py", 5 * 1024 * 1024 + 1, False),
        ("a/readme", 1, False),
        ("a/__init__.py", 0, True),
    ]
    files = frame(spark, [("r", p, s) for p, s, _ in cases])
    assert {r.path for r in filters.scannable(files).collect()} == {p for p, _, kept in cases if kept}
    assert filters.filter_extension(files, [".py"], ignore_case=True).filter("path = 'a/x.PY'").count() == 1
    named = spark.createDataFrame([("r", "secrets.json"), ("r", "d/config.json"), ("r", "config.json.py")], "repo string, path string")
    assert [r.path for r in filters.filter_file_name(named).collect()] == ["config.json.py"]
    languages = spark.createDataFrame([("C++",), ("R",), ("sql",), ("unknown",), ("C",)], "language string")
    assert {r.language for r in filters.filter_convertible(languages.withColumn("path", F.lit("x"))).collect()} == {"C++", "sql"}


def test_limits_beyond_a_head(spark):
    rows = [("r", f"f{i:05}", 1 + i % 7) for i in range(1_400)] + [("s", "a", 1)]
    files = frame(spark, rows)
    assert limits.limit_files(files, 1_200).count() == 1_201
    for budget, most in ((3_000, 1_300), (10**9, 1_000), (2_500, 10**6)):
        room, kept = budget, set()
        for repo, path, size in rows[:-1]:
            if size <= room and len(kept) < most:
                room -= size
                kept.add(path)
        found = limits.admit_within_budget(files, budget, most).collect()
        assert {r.path for r in found if r.repo == "r"} == kept
