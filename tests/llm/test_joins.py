"""N-gram join, line dedup, decontamination and components against brute force."""

from __future__ import annotations

import random
from collections import Counter
from pathlib import Path

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from codecorpus.llm.components import components
from codecorpus.llm.decontaminate import contamination, without_contaminated
from codecorpus.llm.line_dedup import alike, edit_distance, normalised, without_duplicate_lines
from codecorpus.llm.line_blocks import EXACT, Spread, as_table, keys_of, sketches, sketches_allow
from codecorpus.llm.ngram_join import bands_for, keep_one, ngram_join
from codecorpus.session import _WRITTEN


def test_components_of_random_edges_chains_and_none(spark):
    r = random.Random(4)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(500, 560)] + [(7, 7)]
    groups = brute.Groups()
    for a, b in edges:
        if a != b:
            groups.join(a, b)
    least = {}
    for x in groups.parent:
        least[groups.root(x)] = min(x, least.get(groups.root(x), x))
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {x: least[groups.root(x)] for x in groups.parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pointers_are_written_to_few_files(spark):
    settings = {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    known = set(_WRITTEN.get(spark.sparkContext.applicationId, []))
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long").repartition(20)
        assert components(edges).where("root = 0").count() == 41
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    rounds = [p for p in _WRITTEN[spark.sparkContext.applicationId] if p not in known]
    assert len(rounds) > 1
    assert max(len(list(Path(p).glob("part-*"))) for p in rounds) <= spark.sparkContext.defaultParallelism


def test_bands_reach_the_recall():
    for threshold, recall in [(0.8, 0.999), (0.5, 0.9), (0.9, 0.99), (0.99, 0.9)]:
        b, r = bands_for(threshold, recall)
        assert 1 - (1 - threshold**r) ** b >= recall


def test_ngram_join_finds_every_link_and_group(docs, rows):
    links, groups = brute.jaccard_links(rows)
    expected = Counter()
    members = brute.grouped((groups.root(i), i) for i in range(len(rows)))
    for i, row in enumerate(rows):
        size = len(brute.shingles(row[1]))
        if size == 0:
            class_id = row[0]
        else:
            ids = [rows[j][0] for j in members[groups.root(i)]]
            class_id = None if None in ids else min(ids)
        expected[(row[0], size, class_id, links[i])] += 1
    found = Counter((r.id, r["size"], r.class_id, r.n_links) for r in ngram_join(docs).collect())
    assert found == expected


def test_one_of_each_group_stays_with_all_its_columns(docs, rows):
    _, groups = brute.jaccard_links(rows)
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    stays = kept.collect()
    at = brute.grouped(((r[0], r[1]), i) for i, r in enumerate(rows))
    roots = [groups.root(at[(r.doc_id, r.text)][0]) for r in stays]
    assert len(roots) == len(set(roots))
    assert set(roots) == {groups.root(i) for i in range(len(rows))} - {
        x for x in (groups.root(i) for i in range(len(rows))) if x not in roots
    }
    with_words = {groups.root(i) for i, r in enumerate(rows) if brute.shingles(r[1])}
    assert with_words <= set(roots)


def test_tiles_don_t_change_the_result(docs, monkeypatch):
    import codecorpus.llm.ngram_join as module

    plain = module.compare_tiles
    monkeypatch.setattr(module, "compare_tiles", lambda *a: plain(*a, rows=3, weight=700))
    small = sorted(map(tuple, ngram_join(docs).collect()), key=repr)
    monkeypatch.undo()
    assert small == sorted(map(tuple, ngram_join(docs).collect()), key=repr)


def test_empty_tables(no_docs, spark):
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert ngram_join(no_docs).count() == 0
    assert keep_one(no_docs).count() == 0
    assert without_duplicate_lines(no_docs).count() == 0
    assert contamination(no_docs, items).count() == 0
    assert without_contaminated(no_docs, items).columns == no_docs.columns


def test_edit_distance_is_exact_up_to_the_limit():
    r = random.Random(9)
    for _ in range(1500):
        a, b = ("".join(r.choice("ab c") for _ in range(r.randrange(15))) for _ in range(2))
        true, most = brute.levenshtein(a, b), r.randrange(8)
        assert edit_distance(a, b, 99) == true
        assert (edit_distance(a, b, most) == true) if true <= most else edit_distance(a, b, most) > most


def lines_left(rows: list[tuple], similarity: float = 0.9) -> tuple:
    """Distinct lines of all texts, and their groups by edit similarity of every two."""
    names = sorted({" ".join(normalised(line)) for r in rows for line in (r[1] or "").split("\n") if normalised(line)})
    groups = brute.Groups()
    for i, j in brute.alike_pairs(names, similarity):
        groups.join(names[i], names[j])
    return names, groups


def test_fuzzy_lines_by_comparing_all(docs, rows):
    words, groups = lines_left(rows)
    cleaned = without_duplicate_lines(docs)
    assert set(docs.columns) < set(cleaned.columns)
    left = cleaned.collect()
    assert len(left) == len(rows)
    kept = Counter()
    for r in left:
        for line in (r.text or "").split("\n"):
            if normalised(line):
                kept[groups.root(" ".join(normalised(line)))] += 1
    assert set(kept) == {groups.root(x) for x in words}
    assert set(kept.values()) == {1}
    before = sum(1 for r in rows for line in (r[1] or "").split("\n") if normalised(line))
    assert sum(r.n_kept for r in left) == len(kept) and sum(r.n_dropped for r in left) == before - len(kept)
    nulls = [r for r in left if r.text is None]
    assert len(nulls) == sum(1 for r in rows if r[1] is None)
    first = {r.doc_id: r.text for r in left}
    text = {r[0]: r[1] for r in rows}
    assert first[1] == text[1] and first[16] == text[16] and first[17] == text[17]


def test_lines_that_differ_in_their_numbers_are_no_copies(spark):
    texts = ["Chapter 1\n1990: 12\n7\nsame words here", "Chapter 2\n2001: 47\n8\n7\nSame words, here!"]
    left = without_duplicate_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.text for r in left} == {0: texts[0], 1: "Chapter 2\n2001: 47\n8"}
    long = "row {} of the table holds these seven numbers {} {} {} {} {} {} {}"
    numbers = [long.format(1, *range(100, 107)), long.format(2, *range(987, 980, -1))]
    left = without_duplicate_lines(spark.createDataFrame(list(enumerate(numbers)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.text for r in left} == dict(enumerate(numbers))


def keys_by_line(lines: list[str]) -> list[set[int]]:
    spread = Spread(lines)
    assert spread.size.tolist() == list(map(len, lines))
    found: list[set[int]] = [set() for _ in lines]
    for i, key in zip(*(x.tolist() for x in keys_of(spread, np.arange(len(lines)), 0.9)), strict=True):
        found[i].add(key)
    return found


def edited(r: random.Random, line: str, most: int) -> str:
    """Up to ``most`` characters replaced, put in or taken out; no blanks side by side or at an end."""
    letters = list(line)
    for _ in range(most):
        at = r.randrange(1, len(letters) - 1)
        if " " not in letters[at - 1 : at + 2]:
            letters[at : at + r.choice([1, 1, 0, 2])] = r.choice(["q", "é", ""])
    return "".join(letters)


def test_short_lines_always_meet():
    r = random.Random(21)
    pool = brute.prose(33, 4000).split()
    checked = 0
    for _ in range(1500):
        line = " ".join(r.choice(pool) for _ in range(r.randint(2, 8)))[: r.randint(10, 39)].strip()
        other = edited(r, line, int(0.1 * len(line) + 1e-9))
        longest = max(len(line), len(other))
        if longest >= EXACT or line == other or brute.levenshtein(line, other) > 0.1 * longest + 1e-9 or " ".join(normalised(other)) != other:
            continue
        checked += 1
        one, two = keys_by_line([line, other])
        assert one & two, (line, other)
        table = as_table({**sketches([line, other]), "size": np.array([len(line), len(other)])})
        assert sketches_allow(0.9)(table, np.array([0]), np.array([1])).all()
    assert checked > 700


@pytest.mark.parametrize(("low", "high"), [(40, 80), (80, 160), (160, 320), (320, 640), (640, 2500)])
def test_most_long_lines_meet(low, high):
    """A tenth of the words, or a twentieth of the characters, changed at random places; 0.9 must meet and be allowed."""
    r = random.Random(low)
    lines = []
    while len(lines) < 200:
        line = brute.prose(r.randrange(10**6), high // 6, 400).replace("\n", " ")[: r.randrange(low + high // 10, high)].strip()
        lines.append(line)
    words, typos = [], []
    for line in lines:
        parts, letters = line.split(" "), list(line)
        for at in r.sample(range(len(parts)), max(1, len(parts) // 10)):
            parts[at] = "".join(r.choice("etaoin") for _ in parts[at])
        for at in r.sample(range(len(letters)), len(letters) // 20):
            letters[at] = r.choice("etaoin") if letters[at] != " " else " "
        words.append(" ".join(parts))
        typos.append("".join(letters))
    own = keys_by_line(lines)
    for changed in (words, typos):
        table = as_table({**sketches(lines + changed), "size": np.array(list(map(len, lines + changed)))})
        allowed = sketches_allow(0.9)(table, np.arange(200), 200 + np.arange(200))
        found = [bool(a & b) and ok for a, b, ok, x, y in zip(own, keys_by_line(changed), allowed, lines, changed, strict=True) if alike(x, y, 0.9)]
        assert len(found) > 50 and np.mean(found) >= 0.9


def test_recall_in_the_given_documents(spark):
    """All pairs of the distinct lines of the table, by edit similarity alone; per length at least 0.9 meet and are allowed."""
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    lines = sorted({" ".join(normalised(x)) for t in texts if t for x in t.split("\n") if normalised(x)})
    keys = keys_by_line(lines)
    table = as_table({**sketches(lines), "size": np.array(list(map(len, lines)))})
    met: dict[int, list[bool]] = {}
    for i, j in brute.alike_pairs(lines):
        allowed = sketches_allow(0.9)(table, np.array([i]), np.array([j]))[0]
        met.setdefault(max(len(lines[i]), len(lines[j])) // 160, []).append(bool(keys[i] & keys[j]) and bool(allowed))
    assert sum(map(len, met.values())) > 250
    assert {length: np.mean(found) for length, found in met.items() if np.mean(found) < 0.9} == {}


def test_a_common_block_is_dealt_into_tiles(spark, monkeypatch):
    import codecorpus.llm.line_blocks as module

    start = "the same words begin each of these lines of text and go on for a while until at last "
    lines = [start + " ".join(f"{w}{i % 40}" for w in ("one", "two", "three")) for i in range(120)] + [f"a short line {i} here" for i in range(30)]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    whole = sorted(map(tuple, without_duplicate_lines(rows).collect()))
    monkeypatch.setattr(module, "BUCKET", 5)
    assert sorted(map(tuple, without_duplicate_lines(rows).collect())) == whole
    assert sum(r[2] for r in whole) < len(lines) - 80


@pytest.mark.parametrize("changed", [{}, {"MOST_PAIRS": 0}, {"BUCKET": 2}])
def test_a_line_nearer_by_sketches_than_two_alike_ones_hides_no_link(spark, monkeypatch, changed):
    """The third line has the pairs of characters of both others but is like neither; the first two differ in 3 of 38 characters."""
    import codecorpus.llm.line_blocks as module

    for name, value in changed.items():
        monkeypatch.setattr(module, name, value)
    one, two = "the quick brown fo", "jumps over my dogs"
    lines = [one + "xyz" + two, one + "uvw" + two, two + one]
    assert [alike(lines[i], lines[j], 0.9) for i, j in ((0, 1), (0, 2), (1, 2))] == [True, False, False]
    rows = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    assert {r.doc_id: r.n_kept for r in without_duplicate_lines(rows).collect()} == {0: 1, 1: 0, 2: 1}


def test_a_row_many_times_over(spark):
    rows = spark.range(2000).selectExpr("7L as doc_id", "'one line of text\nanother' as text", "id as numbers")
    left = without_duplicate_lines(rows).collect()
    assert sorted(r.numbers for r in left) == list(range(2000))
    assert Counter(r.text for r in left) == {"": 1999, "one line of text\nanother": 1}
    assert Counter((r.n_kept, r.n_dropped) for r in left) == {(0, 2): 1999, (2, 0): 1}


def test_an_unknown_search_is_refused(no_docs):
    with pytest.raises(ValueError, match="search"):
        without_duplicate_lines(no_docs, search="none")


def test_lines_of_every_length_by_edit_similarity_of_all_pairs(spark):
    r = random.Random(12)
    texts = []
    for n in [2, 3, 4, 5, 7, 10, 10, 15, 27, 27, 57, 120]:
        words = brute.prose(r.randrange(10**6), n).split()
        near, typos = list(words), list(" ".join(words))
        near[r.randrange(n)] = "".join(r.choice("klmnop") for _ in range(3))
        for _ in range(len(typos) // 14):
            typos[r.randrange(len(typos))] = r.choice("qwertz")
        texts.append("\n".join([" ".join(words), " ".join(near), "".join(typos)]))
    lines = sorted({" ".join(normalised(x)) for t in texts for x in t.split("\n")})
    groups = brute.Groups()
    for i, a in enumerate(lines):
        groups.root(a)
        for b in lines[:i]:
            longest = max(len(a), len(b))
            if min(len(a), len(b)) >= 0.9 * longest and brute.levenshtein(a, b) <= 0.1 * longest:
                groups.join(a, b)
    left = without_duplicate_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), search="edits").collect()
    kept = Counter(groups.root(" ".join(normalised(x))) for row in left for x in row.text.split("\n") if x)
    assert len({groups.root(x) for x in lines}) < len(lines) - 10
    assert kept == Counter({groups.root(x) for x in lines})


ITEMS = [
    (1, brute.prose(1, 200)), (2, "One two THREE"), (3, ""), (None, "one"), (4, None), (5, brute.prose(77, 40)), (6, "straße 漢字 ÀÉ ñandú"),
    (6, "straße 漢字 ÀÉ ñandú"), (7, "The very same line of more than eight words stands here the very same"),
]


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


def test_contamination_by_looking_at_every_place(docs, rows, items):
    expected = Counter()
    for r in rows:
        n, hit, found = brute.contaminated(r[1], ITEMS)
        expected[(r[0], n, hit, tuple(found), hit > 0 and 20 * hit >= n)] += 1
    found = Counter((r.id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in contamination(docs, items).collect())
    assert found == expected
    clean = without_contaminated(docs, items)
    assert clean.columns == docs.columns
    assert clean.count() == sum(n for k, n in expected.items() if not k[4])


def test_shuffled_prefixes_give_the_same(docs, items, monkeypatch):
    import codecorpus.llm.decontaminate as module

    sent = sorted(map(tuple, contamination(docs, items).collect()), key=repr)
    monkeypatch.setattr(module, "BROADCAST_BYTES", -1)
    assert sorted(map(tuple, contamination(docs, items).collect()), key=repr) == sent


def test_decontamination_runs_no_python(docs, items):
    plan = contamination(docs, items)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
    assert contamination(docs.limit(0), items.where(F.lit(False))).count() == 0


def test_words_tell_of_long_lines_alike(monkeypatch):
    import random

    from codecorpus.llm import line_dedup

    def plain(a: str, b: str) -> int:
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    luck = random.Random(5)
    for _ in range(1500):
        a, b = ("".join(luck.choice("ab  c") for _ in range(luck.randint(0, 14))) for _ in range(2))
        true = plain(a, b)
        assert line_dedup.edits_at_most(a.split(" "), b.split(" "), 99) >= true
        for most in (0, 2, 5, 99):
            found = line_dedup.edit_distance(a, b, most)
            assert found == true if true <= most else found > most
    line = [f"word{i}" for i in range(60)]
    near = [*line[:9], "new", *line[9:30], "x", *line[31:50], *line[52:]]
    monkeypatch.setattr(line_dedup, "edit_distance", lambda *_: 1 / 0)
    assert line_dedup.alike(" ".join(line), " ".join(near), 0.9)


def test_many_pairs_within_some_edits_at_once(monkeypatch):
    from codecorpus.llm import edits

    monkeypatch.setattr(edits, "FEW", -(10**6))
    r = random.Random(7)
    for letters, longest in (("ab", 5), ("abc ", 70), ("añ漢ó", 200), ("etaoin shrdlu", 400)):
        a = ["".join(r.choice(letters) for _ in range(r.randint(0, longest))) for _ in range(40)]
        b = [edited(r, x, r.randint(0, 1 + len(x) // 8)) if len(x) > 9 and r.random() < 0.7 else r.choice(a) for x in a]
        most = [r.randint(0, 1 + longest // 6) for _ in a]
        true = [brute.levenshtein(x, y) <= k for x, y, k in zip(a, b, most, strict=True)]
        assert edits.within(a, b, np.array(most)).tolist() == true


def test_runs_rule_out_no_pair_that_is_alike():
    from codecorpus.llm.line_blocks import are_alike
    from codecorpus.llm.line_dedup import alike_by_words

    r = random.Random(9)
    a = [brute.prose(i, r.randint(3, 90)).replace("\n", " ") for i in range(150)]
    b = [edited(r, x, r.randint(0, len(x) // 6)) for x in a[:100]] + a[:50]
    true = [brute.levenshtein(x, y) <= int(0.1 * max(len(x), len(y)) + 1e-9) for x, y in zip(a, b, strict=True)]
    assert are_alike(a, b, 0.9, alike_by_words).tolist() == true
    assert 20 < sum(true) < 90


def test_lines_that_share_tiled_buckets_are_compared_in_one(monkeypatch):
    """The first two lines share both buckets, the third is in the second alone; none is like another."""
    from codecorpus.llm import line_blocks

    lines = [brute.prose(i, 12).replace("\n", " ")[:60] for i in range(3)]
    monkeypatch.setattr(line_blocks, "sketches_allow", lambda similarity: lambda table, i, j: np.ones(len(j), dtype=bool))
    table = {"id": np.arange(3), "size": np.array([60] * 3), "line": np.array(lines, dtype=object), **sketches(lines)}
    keys = np.empty(3, dtype=object)
    keys[:] = [np.array([-4, 9]), np.array([-4, 9]), np.array([9])]
    table["keys"] = keys
    groups = [({**{c: v[:n] for c, v in table.items()}, "block": np.full(n, block)}, None) for block, n in ((-4, 2), (9, 3))]
    asked = []
    work = line_blocks._tile_links(0.9, lambda a, b, similarity: asked.append((lines.index(a), lines.index(b))))
    assert work(groups) == []
    assert sorted(map(sorted, asked)) == [[0, 1], [0, 2], [1, 2]]


def test_the_filter_of_contaminated_texts_splits_them_once(docs, items):
    plan = without_contaminated(docs, items)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("split(") == 1
