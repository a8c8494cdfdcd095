"""Attention over passages: measures, attention and gradients by plain versions, and held-out labels."""

from __future__ import annotations

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from codecorpus.llm.attention_quality import BINS, KINDS, MEASURES, PASSAGE, AttentionModel, fit, learned, passages, scored
from codecorpus.llm.queries import QUERIES

BLANKS = b" \t\n\r\x0b\x0c"


def plain_measures(text: str | None) -> list[list[float]]:
    """Measures of each passage, byte by byte and word by word."""
    raw = (text or "").encode()
    spans, at = [], 0
    while at < len(raw):
        if raw[at] in BLANKS:
            at += 1
            continue
        stop = at
        while stop < len(raw) and raw[stop] not in BLANKS:
            stop += 1
        spans.append((at, stop))
        at = stop
    rows = []
    for first in range(0, max(len(spans), 1), PASSAGE):
        own = spans[first : first + PASSAGE]
        row = [0.0] * MEASURES
        rows.append(row)
        if not own:
            continue
        stop = spans[first + PASSAGE][0] if first + PASSAGE < len(spans) else len(raw)
        part = raw[own[0][0] : stop]
        for i in range(len(part) - 2):
            code = part[i] << 16 | part[i + 1] << 8 | part[i + 2]
            row[(code * 0x9E3779B97F4A7C15 % 2**64) >> 57] += 1
        row[:BINS] = [math.sqrt(x / max(len(part) - 2, 1)) for x in row[:BINS]]
        for i, kind in enumerate(KINDS):
            row[BINS + i] = math.sqrt(sum(b in kind for b in part) / len(part))
        words = [raw[a:b] for a, b in own]
        row[-4] = len(set(words)) / len(words)
        row[-3] = sum(a == b for a, b in zip(words, words[1:], strict=False)) / len(words)
        row[-2] = math.log1p(len(words)) / math.log1p(PASSAGE)
        row[-1] = math.log1p(len(part) / len(words))
    return rows


def texts_of_any_kind() -> list[str | None]:
    r = random.Random(4)
    mixed = ["".join(r.choice("abAB  \n.,!7é漢 ") for _ in range(r.randrange(900))) for _ in range(40)]
    return [None, "", " \n\t ", "a", "  a", "a  ", "a a", "x " * 64, "x " * 65, "  y\n" * 200, *mixed, None]


def test_measures_by_the_plain_version():
    texts = texts_of_any_kind()
    made, count = passages(texts)
    expected = [plain_measures(t) for t in texts]
    assert count.tolist() == list(map(len, expected))
    np.testing.assert_allclose(made, np.array([row for rows in expected for row in rows]), atol=1e-12)


def a_model(seed: int) -> AttentionModel:
    r = np.random.default_rng(seed)
    start = learned(r.random((3, MEASURES)), np.array([1, 2]), np.array([1.0, 0.0]), steps=0)
    return AttentionModel(start.mean, start.scale, {k: r.normal(0, 0.4, v.shape) for k, v in start.weights.items()})


def test_scores_by_the_plain_version():
    model, texts = a_model(1), texts_of_any_kind()
    w = {k: v.tolist() for k, v in model.weights.items()}

    def times(row, matrix):
        return [sum(x * y for x, y in zip(row, column, strict=True)) for column in zip(*matrix, strict=True)]

    expected = []
    for text in texts:
        encoded, gates = [], []
        for row in plain_measures(text):
            x = [(v - m) / s for v, m, s in zip(row, model.mean, model.scale, strict=True)]
            h = [math.tanh(v + b) for v, b in zip(times(x, w["encode"]), w["encode_bias"], strict=True)]
            gate = sum(math.tanh(t) / (1 + math.exp(-u)) * g for t, u, g in zip(times(h, w["tell"]), times(h, w["let"]), w["gate"], strict=True))
            encoded.append(h)
            gates.append(math.exp(gate))
        z = [sum(g * h[i] for g, h in zip(gates, encoded, strict=True)) / sum(gates) for i in range(len(w["out"]))]
        expected.append(1 / (1 + math.exp(-sum(a * b for a, b in zip(z, w["out"], strict=True)) - w["out_bias"][0])))
    np.testing.assert_allclose(model.scores(*passages(texts)), expected, atol=1e-9)


def test_gradients_by_differences():
    model = a_model(2)
    measures, count = passages([t for t in texts_of_any_kind() if t][:12])
    x, label = model.encoded(measures), np.arange(len(count)) % 2.0
    _, slope = model.gradients(x, count, label)
    r = random.Random(6)
    for name, weights in model.weights.items():
        for _ in range(6):
            at = tuple(r.randrange(n) for n in weights.shape)
            kept = weights[at]
            losses = []
            for step in (1e-5, -1e-5):
                weights[at] = kept + step
                losses.append(model.gradients(x, count, label)[0])
            weights[at] = kept
            assert slope[name][at] == pytest.approx((losses[0] - losses[1]) / 2e-5, rel=1e-3, abs=1e-7)


def test_attention_finds_the_passage_that_tells():
    """Documents of ten passages are bad for one of them; attention must learn which."""
    r = random.Random(8)
    good = ["".join(r.choice("abcdefg") for _ in range(5)) for _ in range(300)]
    texts, labels, places = [], [], []
    for i in range(300):
        parts = [" ".join(r.choice(good) for _ in range(PASSAGE)) for _ in range(10)]
        place = r.randrange(10)
        if i % 2:
            parts[place] = " ".join(r.choice(["$$$", "###", "!!"]) for _ in range(PASSAGE))
        texts.append(" ".join(parts))
        labels.append(float(i % 2 == 0))
        places.append(place)
    made, count = passages(texts)
    upto = int(count[:200].sum())
    model = learned(made[:upto], count[:200], np.array(labels[:200]))
    scores = model.scores(made, count)[200:]
    assert np.mean((scores >= 0.5) == np.array(labels[200:])) > 0.95
    weight = model.attention(model.encoded(made), count)[3].reshape(-1, 10)
    np.testing.assert_allclose(weight.sum(axis=1), 1)
    assert np.mean([weight[i].argmax() == places[i] for i in range(201, 300, 2)]) > 0.9


def test_held_out_labels(spark):
    """Tables of ten thousand documents: the model has seen none of the held-out ones."""
    found = {r.doc_id: r for r in QUERIES["op13_attention_quality"](spark, "/root/testdata/sf0.1").collect()}
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()
    assert len(found) == 10_000
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in found.items())
    held = [(found[x.doc_id].score, x.quality) for x in labels if found[x.doc_id].held_out]
    good, bad = ([s for s, q in held if q == k] for k in (1, 0))
    assert len(bad) > 50
    assert np.mean([s >= 0.3 for s in good]) > 0.99
    assert np.mean([s < 0.3 for s in bad]) > 0.9
    assert np.mean([a > b for a in good for b in bad]) > 0.99


def test_labels_of_held_out_rows_and_other_columns_change_nothing(spark, docs):
    rows = [(i, i % 2, 0) for i in range(1, 60)] + [(None, 1, 0), (5, None, 1), (6, 1, 1)]
    labels = spark.createDataFrame(rows, "doc_id int, quality int, kid int")
    model = fit(docs, labels, steps=30)
    changed = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    other = fit(docs.withColumns({"lang": F.lit("xx"), "source": F.col("doc_id").cast("string")}), changed, steps=30)
    for name, weights in model.weights.items():
        np.testing.assert_array_equal(weights, other.weights[name])
    few = fit(docs, labels, steps=5, most_documents=7, most_passages=30)
    assert np.isfinite(few.weights["out"]).all()


def test_rows_of_any_kind(spark, docs, rows, no_docs):
    model = fit(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r.score for r in scored(docs, model).collect()} == {0.5}
    model = a_model(3)
    found = scored(docs.withColumnsRenamed({"kid": "score", "line_no": "held_out"}), model).collect()
    expected = np.round(model.scores(*passages([r[1] for r in rows])), 6)
    assert sorted(((f.id, f.score) for f in found), key=repr) == sorted(((r[0], float(s)) for r, s in zip(rows, expected, strict=True)), key=repr)
    assert scored(no_docs, model).count() == 0
    assert fit(no_docs, spark.createDataFrame([], "doc_id long, quality int")).weights["out"].tolist() == [0.0] * 24
