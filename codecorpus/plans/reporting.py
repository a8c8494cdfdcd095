"""Reports over a corpus from one pass over its texts."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codecorpus.operators.classify import classify
from codecorpus.operators.lines import rechunked
from codecorpus.operators.reports import (
    corpus_summary,
    file_details,
    language_stats,
    node_type_distribution,
    segment_stats,
    with_share,
)
from codecorpus.operators.segmentation import with_segments
from codecorpus.plans.conversion import stored
from codecorpus.session import scratch_path


class CorpusReport(NamedTuple):
    languages: DataFrame
    segments: DataFrame
    node_types: DataFrame
    details: DataFrame
    summary: DataFrame


def corpus_report(scanned: DataFrame) -> CorpusReport:
    """All reports on a scanned corpus.

    The texts are read once: what the reports need of each file (a few numbers
    and its node types) is written to the shared folder first.
    """
    segmented = with_segments(rechunked(classify(scanned)))
    facts = stored(
        segmented.select(
            "repo",
            "path",
            "language",
            "size",
            "loc",
            F.transform("segments", lambda s: F.struct(s["node_type"].alias("node_type"))).alias("segments"),
        ),
        scratch_path(scanned.sparkSession, "facts"),
    )
    details = file_details(facts)
    node_types = node_type_distribution(facts.select(F.explode("segments").alias("s")).select("s.node_type"))
    return CorpusReport(
        with_share(language_stats(facts), "files"),
        segment_stats(details),
        with_share(node_types, "segments"),
        details,
        corpus_summary(details),
    )
