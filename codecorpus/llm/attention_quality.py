"""Quality classifier: gated attention over the passages of a document, learned from labels of whole documents."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codecorpus.llm.common import in_slices, written
from codecorpus.llm.hashing import mixed, word_hashes

#: Words of a passage; the last passage of a text may have fewer.
PASSAGE = 64
#: Bins of hashed byte trigrams; bytes of the kinds below and the remaining measures follow them.
BINS = 128
KINDS = (
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b".,;:?\"'()-", b"!#*$%&|<>@_=+/\\^~[]{}`",
    b"\n", b" \t\r\x0b\x0c", bytes(range(128, 256)),
)
MEASURES = BINS + len(KINDS) + 4
HIDDEN, GATES = 24, 12
_KIND = np.full(256, len(KINDS), dtype=np.int64)
for _i, _kind in enumerate(KINDS):
    _KIND[list(_kind)] = _i
_BLANK = np.zeros(256, dtype=bool)
_BLANK[list(b" \t\n\r\x0b\x0c")] = True


def passages(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Measures of all passages, one row each, and passages per text: one at least, all zero if there is no word."""
    raws = [t.encode("utf-8", "replace") if isinstance(t, str) else b"" for t in texts]
    raw = np.frombuffer(b"\n".join(raws) + b"\n", dtype=np.uint8)
    sizes = np.fromiter(map(len, raws), dtype=np.int64, count=len(raws)) + 1
    of_byte = np.repeat(np.arange(len(raws)), sizes)
    blank = _BLANK[raw]
    begins = ~blank & np.concatenate([[True], blank[:-1]])
    starts = np.flatnonzero(begins)
    of_word = of_byte[starts]
    n_words = np.bincount(of_word, minlength=len(raws))
    count = np.maximum(1, -(-n_words // PASSAGE))
    base = np.cumsum(count) - count
    passage = base[of_word] + (np.arange(len(starts)) - (np.cumsum(n_words) - n_words)[of_word]) // PASSAGE
    n = int(count.sum())
    made = np.zeros((n, MEASURES))
    if not len(starts):
        return made, count

    # Bytes belong to the passage of the last word that has begun in their text.
    word = np.cumsum(begins) - 1
    here = (word >= 0) & (of_word[np.maximum(word, 0)] == of_byte)
    here[np.cumsum(sizes) - 1] = False
    at = np.where(here, passage[np.maximum(word, 0)], -1)
    whole = np.flatnonzero((at[:-2] >= 0) & (at[:-2] == at[2:])) if len(at) > 2 else np.empty(0, dtype=np.int64)
    codes = raw.astype(np.uint64)
    codes = (codes[whole] << np.uint64(16)) | (codes[whole + 1] << np.uint64(8)) | codes[whole + 2]
    bins = (codes * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(57)).astype(np.int64)
    trigrams = np.bincount(at[whole] * BINS + bins, minlength=n * BINS).reshape(n, BINS)
    made[:, :BINS] = np.sqrt(trigrams / np.maximum(trigrams.sum(axis=1, keepdims=True), 1))
    inside = at >= 0
    length = np.bincount(at[inside], minlength=n)
    kinds = np.bincount(at[inside] * (len(KINDS) + 1) + _KIND[raw[inside]], minlength=n * (len(KINDS) + 1)).reshape(n, -1)
    made[:, BINS : BINS + len(KINDS)] = np.sqrt(kinds[:, : len(KINDS)] / np.maximum(length, 1)[:, None])

    words = np.maximum(np.bincount(passage, minlength=n), 1)
    hashes = word_hashes([w for r in raws for w in r.split()])
    distinct, _ = pd.factorize(mixed(hashes ^ mixed(passage.astype(np.uint64))))
    first = np.unique(distinct, return_index=True)[1]
    repeats = np.concatenate([[False], (hashes[1:] == hashes[:-1]) & (passage[1:] == passage[:-1])])
    made[:, -4] = np.bincount(passage[first], minlength=n) / words
    made[:, -3] = np.bincount(passage, weights=repeats, minlength=n) / words
    made[:, -2] = np.log1p(np.bincount(passage, minlength=n)) / np.log1p(PASSAGE)
    made[:, -1] = np.log1p(length / words)
    return made, count


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _sums(values: np.ndarray, count: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, np.cumsum(count) - count, axis=0)


@dataclass
class AttentionModel:
    """Measures are scaled, encoded as tanh(x encode); a passage weighs softmax(gate . (tanh(h tell) * sigmoid(h let)))."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def encoded(self, measures: np.ndarray) -> np.ndarray:
        return (measures - self.mean) / self.scale

    def attention(self, x: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
        """Per passage: encoding, the two gates and the weight within its document."""
        w = self.weights
        h = np.tanh(x @ w["encode"] + w["encode_bias"])
        tell, let = np.tanh(h @ w["tell"]), _sigmoid(h @ w["let"])
        raw = (tell * let) @ w["gate"]
        bag = np.repeat(np.arange(len(count)), count)
        most = np.maximum.reduceat(raw, np.cumsum(count) - count)
        weight = np.exp(raw - most[bag])
        return h, tell, let, weight / _sums(weight, count)[bag]

    def scores(self, measures: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Probability that a document's label is 1, from the weighted sum of its passages."""
        if not len(count):
            return np.empty(0)
        h, _, _, weight = self.attention(self.encoded(measures), count)
        return _sigmoid(_sums(weight[:, None] * h, count) @ self.weights["out"] + self.weights["out_bias"][0])

    def gradients(self, x: np.ndarray, count: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean logarithmic loss of some documents and its derivative by every weight."""
        w, bag = self.weights, np.repeat(np.arange(len(count)), count)
        h, tell, let, weight = self.attention(x, count)
        z = _sums(weight[:, None] * h, count)
        p = _sigmoid(z @ w["out"] + w["out_bias"][0])
        loss = float(-np.mean(label * np.log(p + 1e-12) + (1 - label) * np.log(1 - p + 1e-12)))
        d_logit = (p - label) / len(label)
        d_z = d_logit[:, None] * w["out"]
        d_weight = (d_z[bag] * h).sum(axis=1)
        d_raw = weight * (d_weight - _sums(weight * d_weight, count)[bag])
        d_gated = d_raw[:, None] * w["gate"]
        d_tell, d_let = d_gated * let * (1 - tell**2), d_gated * tell * let * (1 - let)
        d_h = weight[:, None] * d_z[bag] + d_tell @ w["tell"].T + d_let @ w["let"].T
        d_in = d_h * (1 - h**2)
        return loss, {
            "encode": x.T @ d_in, "encode_bias": d_in.sum(axis=0), "tell": h.T @ d_tell, "let": h.T @ d_let,
            "gate": (tell * let).T @ d_raw, "out": z.T @ d_logit, "out_bias": np.array([d_logit.sum()]),
        }


def learned(measures: np.ndarray, count: np.ndarray, label: np.ndarray, steps: int = 1500, batch: int = 64, rate: float = 0.004, decay: float = 1e-3) -> AttentionModel:
    """Weights that fit the labels of documents, by Adam over batches in a fixed random order."""
    r = np.random.default_rng(17)
    scale = np.maximum(measures.std(axis=0), 0.02) if len(measures) else np.ones(MEASURES)
    mean = measures.mean(axis=0) if len(measures) else np.zeros(MEASURES)
    share = (float(label.sum()) + 1) / (len(label) + 2)
    weights = {
        "encode": r.normal(0, MEASURES**-0.5, (MEASURES, HIDDEN)), "encode_bias": np.zeros(HIDDEN),
        "tell": r.normal(0, HIDDEN**-0.5, (HIDDEN, GATES)), "let": r.normal(0, HIDDEN**-0.5, (HIDDEN, GATES)),
        "gate": r.normal(0, GATES**-0.5, GATES), "out": np.zeros(HIDDEN), "out_bias": np.array([np.log(share / (1 - share))]),
    }
    model = AttentionModel(mean, scale, weights)
    if not len(label):
        return model
    x, begin = model.encoded(measures), np.cumsum(count) - count
    first = {k: np.zeros_like(v) for k, v in weights.items()}
    second = {k: np.zeros_like(v) for k, v in weights.items()}
    order = np.empty(0, dtype=np.int64)
    for step in range(1, steps + 1):
        if len(order) < min(batch, len(label)):
            order = np.concatenate([order, r.permutation(len(label))])
        some, order = order[:batch], order[batch:]
        size = count[some]
        at = np.repeat(begin[some] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        _, slope = model.gradients(x[at], size, label[some])
        fade = rate * (1 - 0.9 * step / steps)
        for k, d in slope.items():
            if not k.endswith("bias"):
                d = d + decay * weights[k]
            first[k] = 0.9 * first[k] + 0.1 * d
            second[k] = 0.999 * second[k] + 0.001 * d * d
            weights[k] -= fade * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return model


def held_out(identity: Column) -> Column:
    """Every fifth id, by a checksum of its decimal form; rows whose id is null count as one of them."""
    return F.crc32(F.coalesce(identity.cast("string"), F.lit(""))) % 5 == 0


def _measured(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in in_slices(frames, "text", 2_000_000):
        made, count = passages(frame.text.tolist())
        ends = np.cumsum(count)
        parts = [made[e - n : e].astype(np.float32).tobytes() for e, n in zip(ends.tolist(), count.tolist(), strict=True)]
        yield pd.DataFrame({"turn": frame.turn, "label": frame.label, "n": count, "measures": parts})


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "quality",
    most_documents: int = 4000,
    most_passages: int = 40_000,
    **training,
) -> AttentionModel:
    """A model of the labels of documents that are not ``held_out``.

    It is fitted on a sample: up to ``most_documents`` labelled documents, by a hash of their
    id, and of these, in that order, as many as have ``most_passages`` passages in all. Passages
    are measured in tasks; only the measures of the sample reach the driver. Several labels
    of an id count by their mean, null labels and ids not at all. Without any label scores are one half.
    """
    known = labels.where(F.col(label_column).isNotNull() & F.col(id_column).isNotNull() & ~held_out(F.col(id_column)))
    known = known.groupBy(F.col(id_column).alias("id")).agg(F.avg(label_column).alias("label"))
    known = known.withColumn("turn", F.xxhash64("id")).orderBy("turn", "id").limit(most_documents)
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).join(F.broadcast(known), "id")
    rows = written(rows.select("turn", "text", "label").mapInPandas(_measured, "turn long, label double, n long, measures binary"), "measured")
    # Equal ids may be many: the first documents alone are numbered, without their measures.
    some = rows.select("turn", "n", "label", F.xxhash64("measures").alias("print")).orderBy("turn", "print").limit(most_documents)
    upto = F.sum("n").over(Window.orderBy("turn", "print").rowsBetween(Window.unboundedPreceding, 0))
    some = some.withColumn("upto", upto).where(F.col("upto") <= most_passages).select("turn", "print").distinct()
    chosen = rows.withColumn("print", F.xxhash64("measures")).join(F.broadcast(some), ["turn", "print"])
    chosen = chosen.dropDuplicates(["turn", "print"]).select("turn", "print", "label", "n", "measures").toPandas().sort_values(["turn", "print"])
    count = chosen.n.to_numpy(dtype=np.int64)
    measures = np.frombuffer(b"".join(chosen.measures), dtype=np.float32).reshape(-1, MEASURES).astype(np.float64)
    return learned(measures, count, chosen.label.to_numpy(dtype=np.float64), **training)


def scored(docs: DataFrame, model: AttentionModel, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id, held_out, score, n_passages, top_passage, top_weight`` for every row of ``docs``.

    ``score`` (0 to 1, six decimals) is the probability of label 1, from all passages of the
    whole text and nothing else; ``top_passage`` (from 0) has the largest attention, ``top_weight``.
    Null and empty texts and texts of blanks are one passage without a word and get the
    score of that; equal texts get equal scores, whatever their ids, which may be null or repeated.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in in_slices(frames, "text", 2_000_000):
            made, count = passages(frame.text.tolist())
            weight = model.attention(model.encoded(made), count)[3]
            ends = np.cumsum(count).tolist()
            top = [int(weight[e - n : e].argmax()) for e, n in zip(ends, count.tolist(), strict=True)]
            yield pd.DataFrame(
                {
                    "id": frame.id, "held_out": frame.held_out, "score": np.round(model.scores(made, count), 6), "n_passages": count,
                    "top_passage": top, "top_weight": np.round(np.maximum.reduceat(weight, np.cumsum(count) - count), 6),
                }
            )

    rows = docs.select(F.col(id_column).cast("string").alias("id"), F.col(text_column).alias("text"), held_out(F.col(id_column)).alias("held_out"))
    made = rows.mapInPandas(run, "id string, held_out boolean, score double, n_passages long, top_passage long, top_weight double")
    return made.withColumn("id", F.col("id").cast(docs.schema[id_column].dataType))
