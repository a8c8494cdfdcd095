"""N-gram Jaccard join by MinHash banding, verified on whole n-gram sets."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codecorpus.llm.common import Group, fresh, in_slices, row_key, written
from codecorpus.llm.components import components
from codecorpus.llm.hashing import mixed, set_hash, shingle_hashes
from codecorpus.llm.tiles import Forest, compare_tiles


def bands_for(threshold: float, recall: float, most: int = 256) -> tuple[int, int]:
    """Bands and rows per band: the steepest curve whose recall at the threshold is reached with ``most`` hashes.

    More rows per band let fewer unlike pairs through; bands then make up for the recall:
    1 - (1 - t^r)^b >= recall. Of all r whose b * r stays within ``most`` and costs at most
    a hundred hashes (or the fewest possible), the largest is taken.
    """
    options = []
    for r in range(1, 17):
        b = max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold**r)))
        if b * r <= most:
            options.append((b, r))
    cheap = [o for o in options if o[0] * o[1] <= 100] or options[:1]
    return max(cheap, key=lambda o: o[1])


def _signatures(n: int, bands: int, rows: int, seed: int):
    factors = np.random.default_rng(seed).integers(0, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    weights = np.random.default_rng(seed + 1).integers(0, 2**63, rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def band_hashes(hashes: np.ndarray) -> np.ndarray:
        least = np.full(bands * rows, np.iinfo(np.uint64).max, dtype=np.uint64)
        for at in range(0, len(hashes), 2048):
            np.minimum(least, (hashes[at : at + 2048, None] * factors[None, :]).min(axis=0), out=least)
        return mixed((least.reshape(bands, rows) * weights).sum(axis=1, dtype=np.uint64)).view(np.int64)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in in_slices(frames, "text"):
            sizes, sets, sketches = [], [], []
            for text in frame.text:
                hashes = shingle_hashes(text.lower().split() if isinstance(text, str) else [], n)
                sizes.append(len(hashes))
                sets.append(set_hash(hashes) if len(hashes) else 0)
                sketches.append(band_hashes(hashes) if len(hashes) else np.empty(0, dtype=np.int64))
            yield pd.DataFrame({"id": frame.id, "kid": frame.kid, "kh": frame.kh, "size": sizes, "cls": sets, "bands": sketches})

    return run


def _sets(n: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in in_slices(frames, "text"):
            found = [shingle_hashes(text.lower().split(), n) for text in frame.text]
            yield pd.DataFrame({"id": [set_hash(x) for x in found], "hashes": [x.tobytes() for x in found]})

    return run


def _shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, as products of 0/1 blocks over hashes that occur twice or more."""
    both = np.concatenate(left + right)
    values, codes, counts = np.unique(both, return_inverse=True, return_counts=True)
    column = np.cumsum(counts > 1) - 1
    rows = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in left + right])
    often = counts[codes] > 1
    rows, codes = rows[often], column[codes[often]]
    order = np.argsort(codes, kind="stable")
    rows, codes = rows[order], codes[order]
    shared = np.zeros((len(left), len(right)), dtype=np.float64)
    for at in range(0, int(codes[-1]) + 1 if len(codes) else 0, 8192):
        here = slice(np.searchsorted(codes, at), np.searchsorted(codes, at + 8192))
        grid = np.zeros((len(left) + len(right), 8192), dtype=np.float32)
        grid[rows[here], codes[here] - at] = 1
        shared += grid[: len(left)] @ grid[len(left) :].T
    return shared


def _compare(threshold: float):
    def run(left: Group, right: Group | None) -> list[tuple] | None:
        other = left if right is None else right
        a = [np.frombuffer(x, dtype=np.uint64) for x in left["hashes"]]
        b = [np.frombuffer(x, dtype=np.uint64) for x in other["hashes"]]
        if right is None and len(a) == 2:
            both = len(np.intersect1d(a[0], a[1], assume_unique=True))
            if both < threshold * (len(a[0]) + len(a[1]) - both) - 1e-9:
                return None
            (i, j), (m, n) = left["id"].tolist(), left["copies"].tolist()
            return [(i, None, n), (j, None, m), (i, j, 0)]
        shared = _shared(a, b)
        total = np.array([len(x) for x in a], dtype=np.float64)[:, None] + np.array([len(x) for x in b])[None, :] - shared
        linked = shared >= threshold * total - 1e-9
        if right is None:
            np.fill_diagonal(linked, False)
        ids_a, ids_b = left["id"].tolist(), other["id"].tolist()
        rows = [(i, None, n) for i, n in zip(ids_a, (linked @ other["copies"]).tolist(), strict=True) if n]
        if right is not None:
            rows += [(i, None, n) for i, n in zip(ids_b, (linked.T @ left["copies"]).tolist(), strict=True) if n]
        shift = 0 if right is None else len(ids_a)
        forest = Forest(shift + len(ids_b))
        return rows + [(ids_a[i], ids_b[j], 0) for i, j in np.argwhere(linked).tolist() if forest.join(i, j + shift)]

    return run


def ngram_join(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    n: int = 5,
    threshold: float = 0.8,
    recall: float = 0.999,
    seed: int = 11,
) -> DataFrame:
    """One row per document: ``id, kid, kh, size, class_id, n_copies, n_links, keeps``.

    Texts are lower-cased and cut at white space; their sets of n-word runs are compared by
    Jaccard similarity. Documents of equal sets are one class and meet as one row. MinHash
    bands (``bands_for``) are shuffled by their hashes; classes that share a band form
    blocks, within which all pairs of fitting size are verified on their whole sets
    (``compare_tiles``), so a link is missed only if its band is, and no pair is emitted.

    class_id: least id of the group that links connect. n_copies: documents of the same set.
    n_links: other documents at or above the threshold. size: distinct runs.
    keeps: whether the row has the least (id, content) of its group, so that one document of
    each group stays; rows equal in id and text all have it. kid, kh: see ``row_key``.

    A text with fewer than n words is one run. Null, empty and blank texts have no run:
    they are their own class, without links. Null ids are allowed. Equal sets are told by 64 bits.
    """
    bands, rows = bands_for(threshold, recall)
    kid, kh = row_key(F.col(id_column), F.col(text_column))
    keyed = docs.select(F.col(id_column).cast("string").alias("id"), kid.alias("kid"), kh.alias("kh"), F.col(text_column).alias("text"))
    sketch = written(
        keyed.mapInPandas(_signatures(n, bands, rows, seed), "id string, kid long, kh long, size int, cls long, bands array<long>"),
        "minhash",
    ).withColumn("id", F.col("id").cast("long"))
    classes = written(
        sketch.where("size > 0").groupBy(F.col("cls").alias("id")).agg(
            F.count("*").alias("copies"), F.min(F.struct("kid", "kh", F.col("id").alias("doc"))).alias("first"),
            F.first("size").alias("size"), F.first("bands").alias("bands"),
        ),
        "classes",
    )
    placed = classes.select("id", F.posexplode("bands").alias("band", "hash"))
    hubs = placed.groupBy("band", "hash").agg(F.min("id").alias("hub"), F.count("*").alias("n")).where("n > 1")
    hubs = written(hubs.drop("n"), "bands")
    blocks = components(placed.join(hubs, ["band", "hash"]).select(F.col("id").alias("a"), F.col("hub").alias("b")))
    members = written(
        blocks.select(F.col("node").alias("id"), F.col("root").alias("block")).join(classes.drop("bands"), "id"), "blocks"
    )
    wanted = members.select("first.kid", "first.kh").hint("merge")
    sets = keyed.join(wanted, ["kid", "kh"], "left_semi").select("text").mapInPandas(_sets(n), "id long, hashes binary")
    found = written(
        compare_tiles(members.select("block", "id", "size", "copies"), sets, _compare(threshold), "a long, b long, links long", threshold),
        "links",
    )
    groups = components(found.where("b is not null").select("a", "b"))
    links = found.groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links"))
    linked = written(classes.drop("bands", "size").join(groups.withColumnRenamed("node", "id"), "id", "left").join(links, "id", "left"), "linked")
    of_groups = linked.where("root is not null").groupBy("root").agg(F.min("first").alias("least"))
    settled = written(
        linked.join(of_groups, "root", "left").select(
            F.col("id").alias("cls"), "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("least", "first").alias("least")
        ),
        "groups",
    )
    alone = F.col("size") == 0
    return sketch.drop("bands").join(settled, "cls", "left").select(
        "id", "kid", "kh", "size",
        F.when(alone, F.col("id")).otherwise(F.col("least.doc")).alias("class_id"),
        F.when(alone, F.lit(1)).otherwise(F.col("copies")).cast("long").alias("n_copies"),
        F.when(alone, F.lit(0)).otherwise(F.col("links") + F.col("copies") - 1).cast("long").alias("n_links"),
        (alone | ((F.col("kid") == F.col("least.kid")) & (F.col("kh") == F.col("least.kh")))).alias("keeps"),
    )


def keep_one(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """The documents without near duplicates, in all their columns: one of each group stays.

    Rows equal in id and text are copies of each other too, whatever else they hold.
    """
    kid, kh = fresh(docs, "kid", "kh")
    one, two = row_key(F.col(id_column), F.col(text_column))
    keep = ngram_join(docs, id_column, text_column, **options).where("keeps").select(F.col("kid").alias(kid), F.col("kh").alias(kh))
    return docs.withColumns({kid: one, kh: two}).join(keep.distinct().hint("merge"), [kid, kh], "left_semi").dropDuplicates([kid, kh]).drop(kid, kh)
