"""Language identification: text likelihood, declared language, address suffix and host priors, fused by Bayes' rule."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codecorpus.llm.common import in_slices, written

#: Runs of three bytes fall into so many cells.
CELLS = 1 << 16
_TAGS = re.compile(rb"<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", re.S | re.I)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[:65] = 32
_FOLD[91:97] = _FOLD[123:128] = 32


def cells_of(text: bytes) -> np.ndarray:
    """Cells of all runs of three bytes, A-Z in lower case, runs of other ASCII read as one blank."""
    raw = _FOLD[np.frombuffer(b" " + text + b" ", dtype=np.uint8)]
    raw = raw[np.concatenate([[True], (raw[1:] != 32) | (raw[:-1] != 32)])].astype(np.uint32)
    if len(raw) < 3:
        return np.empty(0, dtype=np.uint32)
    return ((raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]) * np.uint32(2654435761)) >> np.uint32(16)


def _bytes_of(text: object, markup: bool) -> bytes:
    raw = text.encode("utf-8", "replace") if isinstance(text, str) else b""
    return _TAGS.sub(b" ", raw) if markup else raw


def _counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sums: dict[str, np.ndarray] = {}
    for frame in in_slices(frames, "text"):
        for lang, texts in frame.groupby("lang").text:
            total = sums.setdefault(lang, np.zeros(CELLS, dtype=np.int64))
            for text in texts:
                total += np.bincount(cells_of(_bytes_of(text, False)), minlength=CELLS)
    for lang, total in sums.items():
        at = np.flatnonzero(total)
        yield pd.DataFrame({"lang": lang, "cell": at, "n": total[at]})


class Model:
    """Logarithms of cell likelihoods, one column per language, in the order of ``languages``."""

    def __init__(self, languages: list[str], table: np.ndarray) -> None:
        self.languages, self.table = languages, table


def fit(labelled: DataFrame, sample_per_language: int = 3_000, smoothing: float = 0.5, text_column: str = "text", lang_column: str = "lang") -> Model:
    """Likelihoods from a bounded sample of labelled rows: about ``sample_per_language`` of each language.

    Rows are counted per language first; then each is taken if a hash of its text falls below
    the language's share, so the sample is the same on every run and no group is gathered.
    The model has 65,536 numbers per language, which is all that comes to the driver.
    Rows without a language or text count for nothing.
    """
    rows = labelled.select(F.col(text_column).alias("text"), F.col(lang_column).cast("string").alias("lang")).where("text is not null and trim(lang) <> ''")
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((CELLS, 0), dtype=np.float32))
    shares = F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(min(1.0, sample_per_language / sizes[k])))])
    taken = rows.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < 1_000_000 * shares[F.col("lang")])
    counts = taken.mapInPandas(_counted, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    table = np.full((CELLS, len(languages)), smoothing, dtype=np.float64)
    found = counts.toPandas()
    table[found.cell.to_numpy(), [languages.index(x) for x in found.lang]] += found.n.to_numpy()
    return Model(languages, np.log(table / table.sum(axis=0)).astype(np.float32))


def _likelihoods(model: Model, markup: bool, effective: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in in_slices(frames, "text"):
            logs = []
            for text in frame.text:
                cells = cells_of(_bytes_of(text, markup))
                if not len(cells):
                    logs.append([0.0] * len(model.languages))
                    continue
                total = np.bincount(cells, minlength=CELLS) @ model.table if len(cells) > 4 * CELLS else model.table[cells].sum(axis=0, dtype=np.float64)
                logs.append((total * min(1.0, effective / len(cells))).tolist())
            yield pd.DataFrame({"id": frame.id.array, "url": frame.url.array, "declared": frame.declared.array, "logs": logs})

    return run


def _softmax(logs: Column) -> Column:
    top = F.array_max(logs)
    powers = F.transform(logs, lambda x: F.exp(x - top))
    return F.transform(powers, lambda x: x / F.aggregate(powers, F.lit(0.0), lambda a, b: a + b))


def _added(one: Column, two: Column) -> Column:
    return F.zip_with(one, two, lambda a, b: a + b)


def identify(
    pages: DataFrame,
    model: Model,
    id_column: str = "page_id",
    url_column: str = "url",
    text_column: str = "html",
    declared: Column | None = None,
    markup: bool = True,
    effective: int = 60,
    strength: float = 10.0,
    salts: int = 16,
) -> DataFrame:
    """One row per page: ``id, url, host, declared, suffix, language, probability, text_language``.

    1. Text: naive Bayes over runs of three bytes of the whole text (tags left out), tempered
       to ``effective`` runs, since neighbouring runs tell much the same.
    2. Declared language (``declared``, or the html tag's lang) and address suffix (last label
       of the host): how likely each is given a language, from sums of text posteriors over
       all pages, smoothed by their shares over all languages.
    3. Prior of the host: shares of text posteriors, smoothed towards its registered domain,
       which is smoothed towards the whole, each as strong as ``strength`` pages; a page
       doesn't vote for its own prior.
    The logarithms add up. All sums are grouped aggregates, combined before the shuffle; the
    join with hosts is salted, so a host with a third of the pages is dealt over ``salts`` tasks
    or more. Null or empty texts are decided by the other evidence, null urls share one host,
    and a page without any evidence gets the most common language. Without languages in
    the model, language is null. Ties go to the first language by name.
    """
    languages = model.languages
    if declared is None:
        declared = F.regexp_extract(F.coalesce(F.col(text_column), F.lit("")), r"(?i)<html[^>]*\slang=[\"']?([a-zA-Z]+)", 1)
    source = pages.select(
        F.col(id_column).cast("string").alias("id"), F.col(url_column).cast("string").alias("url"),
        F.lower(F.coalesce(declared, F.lit(""))).alias("declared"), F.col(text_column).alias("text"),
    )
    scored = written(
        source.mapInPandas(_likelihoods(model, markup, effective), "id string, url string, declared string, logs array<double>"), "likelihoods"
    ).withColumn("id", F.col("id").cast("long"))
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/:?#]+)", 1))
    labels = F.split("host", r"\.")
    scored = scored.withColumn("host", host).withColumns(
        {
            "suffix": F.when(F.instr("host", ".") > 0, F.element_at(labels, -1)).otherwise(""),
            "domain": F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), "."),
            "text": _softmax(F.col("logs")) if languages else F.col("logs"),
            "salt": F.pmod(F.xxhash64("id", "url"), F.lit(salts)).cast("int"),
        }
    )
    if not languages:
        none = F.lit(None)
        return scored.select("id", "url", "host", "declared", "suffix", none.cast("string").alias("language"), none.cast("double").alias("probability"), none.cast("string").alias("text_language"))
    n = len(languages)
    sums = F.array(*[F.sum(F.element_at("text", i + 1)) for i in range(n)])
    by_host = written(scored.groupBy("host", "domain").agg(sums.alias("host_sums")), "hosts")

    def rolled(frame: DataFrame, *keys: str) -> DataFrame:
        return frame.groupBy(*keys).agg(F.array(*[F.sum(F.element_at("host_sums", i + 1)) for i in range(n)]).alias("sums"))

    domains = rolled(by_host, "domain").withColumnRenamed("sums", "domain_sums")
    whole = rolled(by_host).first()
    whole_sums = np.array(whole.sums if whole and whole.sums and whole.sums[0] is not None else [0.0] * n)
    everywhere = F.array(*[F.lit(float(x)) for x in (whole_sums + 1) / (whole_sums + 1).sum()])

    def smoothed(counts: Column, towards: Column) -> Column:
        total = F.aggregate(counts, F.lit(0.0), lambda a, b: a + b)
        return F.zip_with(counts, towards, lambda c, t: (F.greatest(c, F.lit(0.0)) + strength * t) / (F.greatest(total, F.lit(0.0)) + strength))

    hosts = by_host.join(domains, "domain").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    hosts = written(hosts.drop("domain"), "host-priors")

    def evidence(column: str) -> DataFrame:
        """log P(value | language) for every value of the column."""
        counts = scored.where(F.col(column) != "").groupBy(column).agg(sums.alias("sums"))
        counts = written(counts, column)
        totals = counts.agg(*[F.coalesce(F.sum(F.element_at("sums", i + 1)), F.lit(0.0)).alias(f"t{i}") for i in range(n)]).first()
        every = max(1e-9, sum(totals))
        share = F.aggregate("sums", F.lit(0.0), lambda a, b: a + b) / every
        totals_array = F.array(*[F.lit(float(t)) for t in totals])
        logs = F.zip_with("sums", totals_array, lambda c, t: F.log((c + share + F.lit(1e-6)) / (t + 1)))
        return counts.select(column, logs.alias(f"{column}_logs"))

    zeros = F.array(*[F.lit(0.0)] * n)
    less_own = F.zip_with("host_sums", "text", lambda a, b: a - b)
    domain_less = F.zip_with("domain_sums", "text", lambda a, b: a - b)
    prior = F.transform(smoothed(less_own, smoothed(domain_less, everywhere)), lambda p: F.log(p))
    joined = (
        scored.join(hosts, ["host", "salt"])
        .join(evidence("declared"), "declared", "left")
        .join(evidence("suffix"), "suffix", "left")
        .withColumn("fused", _added(_added(F.col("logs"), prior), _added(F.coalesce("declared_logs", zeros), F.coalesce("suffix_logs", zeros))))
        .withColumn("fused", _softmax(F.col("fused")))
    )
    names = F.array(*[F.lit(x) for x in languages])

    def best(probabilities: Column) -> Column:
        return F.element_at(names, F.array_position(probabilities, F.array_max(probabilities)).cast("int"))

    return joined.select(
        "id", "url", "host", "declared", "suffix", best(F.col("fused")).alias("language"), F.array_max("fused").alias("probability"),
        F.when(F.array_max("logs") != F.array_min("logs"), best(F.col("text"))).alias("text_language"),
    )
