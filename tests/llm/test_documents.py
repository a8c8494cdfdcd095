"""Quality rules, packing, shards and token counts against brute force."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from codecorpus.llm.fertility import judged, without_rejected
from codecorpus.llm.packing import ByteEncoder, first_fit_decreasing, packed
from codecorpus.llm.queries import vocabulary
from codecorpus.llm.shards import sharded
from codecorpus.llm.token_counts import clipped, edited_counts, edited_text, leaf_starts, recount, sum_tree, token_tree

RANKS = vocabulary("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))


def test_word_by_word_encoding_is_the_tokenizer_s(tokenizer, rows):
    r, encode = random.Random(3), ByteEncoder(RANKS, remembered=500)
    letters = "ab's é \n\n  .,!7漢　 <|endoftext|>"
    texts = [x[1] for x in rows if x[1] is not None] + ["".join(r.choice(letters) for _ in range(r.randrange(60))) for _ in range(600)]
    for text in texts:
        assert np.frombuffer(encode(text), dtype="<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text[:80]


def test_first_fit_decreasing_by_trying_every_bin():
    r = random.Random(8)
    for _ in range(40):
        sizes = np.array([r.randint(1, 64) for _ in range(r.randrange(60))], dtype=np.int64)
        rooms, expected = [], {}
        for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
            at = next((b for b, room in enumerate(rooms) if room >= sizes[i]), len(rooms))
            if at == len(rooms):
                rooms.append(64)
            expected[i] = (at, 64 - rooms[at])
            rooms[at] -= sizes[i]
        bins, offsets = first_fit_decreasing(sizes, 64)
        assert {i: (bins[i], offsets[i]) for i in range(len(sizes))} == expected


@pytest.mark.parametrize("group_size", [4096, 7])
def test_packing_places_every_id_once(docs, rows, tokenizer, group_size):
    pieces = packed(docs, RANKS, group_size=group_size).collect()
    ids = [np.array([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 0], dtype="<u4") for r in rows]
    expected = Counter((r[0], len(x), at, zlib.crc32(x[at : at + 1024].tobytes())) for r, x in zip(rows, ids, strict=True) for at in range(0, len(x), 1024))
    assert Counter((p.id, p.doc_tokens, p.start, p.ids_crc32) for p in pieces) == expected
    for of_one in brute.grouped((p.sequence_id, p) for p in pieces).values():
        upto = 0
        for p in sorted(of_one, key=lambda p: p.offset):
            assert p.offset == upto
            upto += p.length
        assert upto <= 1024


def test_packing_of_nothing(no_docs):
    assert packed(no_docs, RANKS).count() == 0


@pytest.mark.parametrize("n", [1, 4, 40])
def test_shards_are_contiguous_balanced_and_whole(docs, rows, n):
    placed = sharded(docs, n)
    assert set(docs.columns) | {"size", "shard", "slot"} == set(placed.columns)
    found = placed.collect()
    assert Counter((r.doc_id, r.text) for r in found) == Counter((r[0], r[1]) for r in rows)
    assert all(r["size"] == len((r.text or "").encode()) + 16 for r in found)
    total, largest = sum(r["size"] for r in found), max(r["size"] for r in found)
    of = brute.grouped((r.shard, r) for r in found)
    for members in of.values():
        assert sorted(r.slot for r in members) == list(range(len(members)))
        assert abs(sum(r["size"] for r in members) - total / n) <= largest
    ordered = sorted(found, key=lambda r: (r.shard, r.slot))
    ids = [(r.doc_id is not None, r.doc_id or 0) for r in ordered]
    assert ids == sorted(ids) and 0 <= min(of) and max(of) < n


def test_one_row_repeated_is_dealt_out(spark):
    same = spark.range(400).select(F.lit(None).cast("long").alias("doc_id"), F.lit("same text").alias("text"))
    sizes = Counter(r.shard for r in sharded(same, 8).collect())
    assert sorted(sizes.values()) == [50] * 8
    assert sharded(same.limit(0), 8).count() == 0


def test_quality_counts_and_windowed_entropy(docs, rows):
    import sentencepiece

    path = vocabulary("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = judged(docs, path).collect()
    expected = Counter()
    for r in rows:
        counts = brute.quality_counts(r[1])
        ids = [t for w in (r[1] or "").encode().split() for t in model.encode(w.decode())]
        starts = list(range(0, max(1, len(ids) - 127), 128)) + ([len(ids) - 128] if len(ids) > 128 and len(ids) % 128 else [])
        bits = []
        for window in (ids[s : s + 128] for s in starts if ids):
            h = -sum(c / len(window) * math.log2(c / len(window)) for c in Counter(window).values())
            bits.append(h if len(window) == 128 else h * 7 / math.log2(max(2, len(window))))
        entropy = sum(bits) / len(bits) if bits else 0.0
        failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
        expected[(r[0], *counts, len(ids), sum(model.is_byte(t) for t in ids), round(entropy, 6), failed)] += 1
    got = Counter(
        (r.id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.n_tokens, r.n_byte_tokens, round(r.entropy, 6), r.base_failed)
        for r in found
    )
    assert got == expected
    assert all(not r.kept for r in found if r.base_failed)


def test_bands_reject_odd_texts_and_leave_plain_ones(spark):
    plain = [(i, brute.prose(100 + i, 150 + i % 90), "en") for i in range(80)]
    odd = [(100 + i, " ".join(w + "###$$$%%%" for w in brute.prose(300 + i, 150).split()), "en") for i in range(4)]
    odd += [(110 + i, " ".join(f"{w} |" for w in brute.prose(400 + i, 150).split()), "en") for i in range(4)]
    rare = [(200, brute.prose(500, 150), "xx"), (201, "Это совсем другой язык для проверки правил " * 3 + " ".join(f"слово{i}" for i in range(80)), None)]
    frame = spark.createDataFrame(plain + odd + rare, "doc_id long, text string, lang string")
    kept = without_rejected(frame, vocabulary("piece_bpe_32k.model"))
    assert kept.columns == frame.columns
    assert sorted(r.doc_id for r in kept.collect()) == [*range(80), 200, 201]
    assert without_rejected(frame.limit(0), vocabulary("piece_bpe_32k.model")).count() == 0


def test_a_rare_language_is_judged_by_its_script(spark):
    plain = [(i, brute.prose(100 + i, 150 + i % 90), "en") for i in range(80)]
    rare = [(200, brute.prose(500, 150), "xx"), (201, brute.prose(501, 150), None)]
    odd = [(300 + i, " ".join(w + "###$$$%%%" for w in brute.prose(300 + i, 150).split()), lang) for i, lang in enumerate(["xx", "garbage", None])]
    frame = spark.createDataFrame(plain + rare + odd, "doc_id long, text string, lang string")
    found = judged(frame, vocabulary("piece_bpe_32k.model")).collect()
    assert sorted(r.id for r in found if not r.kept) == [300, 301, 302]
    few = spark.createDataFrame(plain[:20] + odd[:1], "doc_id long, text string, lang string")
    assert [r.id for r in judged(few, vocabulary("piece_bpe_32k.model")).collect() if not r.kept] == [300]


def test_verdicts_against_bands_of_sorted_measures(spark):
    """Bands of a language, its script and the whole table from sorted lists, drawn together by their counts."""
    r = random.Random(11)
    rows = []
    for i in range(260):
        lang = r.choice(["en"] * 8 + ["fr", "fr", "de", None, " "])
        words = brute.prose(1000 + i, r.choice([20, 60, 150, 400])).split()
        if lang == "de":
            words = ["".join(w) + "schaft" for w in words]
        if i % 13 == 0:
            words = [w + r.choice(["###", "漢字", "$%", "zzqx"]) for w in words]
        if i % 29 == 0:
            words = [r.choice(words[:2]) for _ in words]
        rows.append((i, " ".join(words), lang))
    rows += [(300 + i, "Это совсем другой язык " * 3 + " ".join(f"слово{i}{j}" for j in range(70)), "ru") for i in range(3)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = judged(frame, vocabulary("piece_bpe_32k.model")).collect()
    measures = ["chars_per_token", "fertility", "byte_share", "entropy"]

    def name(x):
        return x.lang if x.lang and x.lang.strip() else f"script {x.script}"

    def figures(group, floor):
        made = {}
        for m in measures:
            values = sorted(x[m] for x in group)
            tenth, mid, ninetieth = (values[max(0, math.ceil(q * len(values)) - 1)] for q in (0.1, 0.5, 0.9))
            made[m] = (mid, max((ninetieth - tenth) / 2, abs(mid) * floor))
        return len(group), made

    passed = [x for x in found if not x.base_failed]
    whole = figures(passed, 0.1)[1]
    reasons = set()
    for x in found:
        band = whole
        for group in ([y for y in passed if y.script == x.script], [y for y in passed if name(y) == name(x)]):
            if group:
                n, own = figures(group, 0.01)
                band = {m: tuple((n * n * a + 900 * b) / (n * n + 900) for a, b in zip(own[m], band[m], strict=True)) for m in measures}
        wide = 8 * math.sqrt(1 + 256 / max(1, x.n_tokens))
        off = {m: x[m] - band[m][0] for m in measures}
        reason = None
        if x.base_failed:
            reason = "base"
        elif off["entropy"] < -4 * band["entropy"][1]:
            reason = "entropy"
        elif off["fertility"] > wide * band["fertility"][1]:
            reason = "fertility"
        elif abs(off["chars_per_token"]) > wide * band["chars_per_token"][1]:
            reason = "chars per token"
        elif off["byte_share"] > 0.05 + wide * band["byte_share"][1]:
            reason = "byte fallback"
        assert (x.reason, x.kept) == (reason, reason is None), x
        reasons.add(reason)
    assert len(found) == len(rows) and {None, "base"} < reasons


@pytest.mark.parametrize("leaf", [1, 4, 40])
def test_recounting_equals_encoding_anew(leaf):
    r, encode = random.Random(leaf), ByteEncoder(RANKS)
    letters = "ab's é \n\n  .,!7漢<|endoftext|>   abcdefgh"

    def text_of(n):
        return "".join(r.choice(letters) for _ in range(n))

    def count(text):
        return len(encode.whole(text)) // 4

    for _ in range(400):
        text = text_of(r.randrange(90))
        starts = leaf_starts(text, leaf)
        tree = sum_tree([count(text[a:b]) for a, b in zip(starts, [*starts[1:], len(text)], strict=True)])
        assert tree[1] == count(text)
        for _ in range(3):
            edits = clipped([(r.randint(0, len(text) + 2), r.randint(0, 9), text_of(r.randrange(7))) for _ in range(r.randrange(4))], len(text))
            text, out = edited_text(text, edits), recount(text, starts, tree, edits, encode)
            assert out["tokens_after"] == count(text)
            starts = out["starts"]


def test_edits_of_a_table(docs, tokenizer):
    edits = F.expr(
        "case when doc_id % 5 = 0 then null when doc_id % 5 = 1 then array() else array(named_struct('at', 3, 'removed', 4, 'inserted', ' new one'), "
        "named_struct('at', 5, 'removed', -1, 'inserted', null), named_struct('at', 90000000, 'removed', 7, 'inserted', 'end'), "
        "named_struct('at', null, 'removed', null, 'inserted', 'A')) end"
    )
    framed = docs.withColumn("edits", edits).withColumn("tree", token_tree(F.col("text"), RANKS))
    found = framed.select("doc_id", "text", "edits", edited_counts(F.col("text"), F.col("tree"), F.col("edits"), RANKS).alias("c")).collect()
    assert len(found) == docs.count()
    for r in found:
        text = r.text or ""
        wanted = clipped([(e.at or 0, e.removed or 0, e.inserted or "") for e in r.edits or []], len(text))
        for side, value in (("tokens_before", text), ("tokens_after", edited_text(text, wanted))):
            assert r.c[side] == len(tokenizer.encode(value, add_special_tokens=False).ids)
        assert r.edits or r.c.leaves_read == 0
    assert framed.limit(0).select(edited_counts(F.col("text"), F.col("tree"), F.col("edits"), RANKS)).count() == 0


def test_a_task_measures_a_million_characters_at_a_time():
    """Memory follows the slice, results don't: one frame of long texts comes in pieces, with the rows it had."""
    import pandas as pd

    from codecorpus.llm.fertility import _measure
    from codecorpus.llm.queries import vocabulary

    texts = ["some words of a text " * 30_000, "other words here " * 36_000, "", None, "last " * 120_000]
    frame = pd.DataFrame({"id": list("abcde"), "kid": range(5), "kh": range(5), "text": texts, "lang": "en"})
    found = list(_measure(vocabulary("piece_bpe_32k.model"))(iter([frame])))
    assert len(found) > 1 and pd.concat(found).n_words.tolist() == [150_000, 108_000, 0, 0, 120_000]
