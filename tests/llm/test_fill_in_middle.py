"""Fill-in-the-middle samples against a plain version, and round trips."""

from __future__ import annotations

import hashlib
import random
import re

import pyarrow as pa

from codecorpus.llm.fill_in_middle import MARKS, fill_in_middle, rebuilt, transformed, with_restored


def plain_version(doc_id, text: str | None, fim: int = 100, spm: int = 50, seed: int = 7, marks=MARKS) -> tuple:
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    p, s, m = marks
    if not text or any(x in text for x in marks) or h[2] % 100 >= fim:
        return len(units), "plain", None, None, text
    if h[3] % 100 < spm:
        return len(units), "spm", len(prefix), len(middle), s + suffix + p + prefix + m + middle
    return len(units), "psm", len(prefix), len(middle), p + prefix + s + suffix + m + middle


def test_batches_by_the_plain_version():
    r = random.Random(1)
    texts = [None, "", "\n", "a", "a\n", "\n\na\nb", "x<P>y\nz", "<\nS>\n<M\n>", "\r\n \n", "é漢\nü\n\nq"]
    texts += ["".join(r.choice("ab\n<>PSMé") for _ in range(r.randrange(40))) for _ in range(3000)]
    draws = [[int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for i in range(len(texts))] for k in range(4)]
    for fim, spm in ((100, 50), (60, 0), (100, 100), (0, 50)):
        made = transformed(pa.array(texts), [pa.array(d, pa.int64()) for d in draws], fim, spm, MARKS)
        assert list(zip(*(c.to_pylist() for c in made), strict=True)) == [plain_version(i, t, fim, spm) for i, t in enumerate(texts)]
        assert rebuilt(made[4], made[1]).to_pylist() == [t or "" for t in texts]


def test_rows_of_any_kind(docs, rows, no_docs):
    frame = docs.withColumnsRenamed({"kid": "output", "line_no": "form", "lang": "id"})
    for options in ({}, {"seed": 3, "fim_percent": 70, "spm_percent": 20, "marks": ("<pre>", "|", "alpha")}):
        made = with_restored(fill_in_middle(frame, **options), options.get("marks", MARKS))
        found = sorted((tuple(r) for r in made.collect()), key=repr)
        names = {"fim_percent": "fim", "spm_percent": "spm"}
        given = {names.get(k, k): v for k, v in options.items()}
        assert found == sorted(((r[0], *plain_version(r[0], r[1], **given), r[1] or "") for r in rows), key=repr)
    assert with_restored(fill_in_middle(no_docs)).count() == 0


def test_ids_of_text(spark):
    frame = spark.createDataFrame([("a", "x\ny\n"), (None, "x\ny"), ("a", "x\ny\n")], "doc_id string, text string")
    found = sorted((tuple(r) for r in fill_in_middle(frame).collect()), key=repr)
    assert found == sorted(((i, *plain_version(i, t)) for i, t in [("a", "x\ny\n"), (None, "x\ny"), ("a", "x\ny\n")]), key=repr)


def test_one_pass_without_a_shuffle(docs):
    plan = fill_in_middle(docs.select("doc_id", "text"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.split("InMemoryRelation")[0]
