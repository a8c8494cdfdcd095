"""Packing of documents into sequences: first-fit decreasing with a tournament tree."""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codecorpus.llm.common import Group, in_slices, over_groups

#: How the vocabulary's authors part a text before its merges (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END_OF_TEXT = "<|endoftext|>"
_SPACES = re.compile(r"\s ")


class ByteEncoder:
    """Ids of a byte-level vocabulary as little-endian 32-bit bytes, word by word, remembered.

    A space after something other than white space always begins a new piece, whatever
    follows, so a text may be cut there. Texts with runs of white space before a space are encoded whole.
    """

    def __init__(self, vocabulary: str, remembered: int = 300_000) -> None:
        import tiktoken

        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={END_OF_TEXT: len(ranks)})
        self.remembered, self.known = remembered, {}

    def whole(self, text: str) -> bytes:
        return np.asarray(self.encoding.encode(text, allowed_special="all"), dtype="<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if _SPACES.search(text):
            return self.whole(text)
        first, *rest = text.split(" ")
        known = self.known
        if len(known) > self.remembered:
            known.clear()
        for word in set(rest).difference(known):
            known[word] = self.whole(" " + word)
        return (self.whole(first) if first else b"") + b"".join(map(known.__getitem__, rest))


class Tournament:
    """Free room of bins, each inner node the larger of its two: the first bin with room in log n steps."""

    def __init__(self, bins: int, capacity: int) -> None:
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.room = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> tuple[int, int]:
        """The first bin with room for ``size``, and how much room it had before."""
        room, at = self.room, 1
        while at < self.leaves:
            at *= 2
            if room[at] < size:
                at += 1
        had = room[at]
        room[at] -= size
        leaf, at = at - self.leaves, at // 2
        while at:
            larger = max(room[2 * at], room[2 * at + 1])
            if room[at] == larger:
                break
            room[at] = larger
            at //= 2
        return leaf, had


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every piece (none larger than capacity), the largest first, ties in order."""
    bins, offsets = np.zeros(len(sizes), dtype=np.int64), np.zeros(len(sizes), dtype=np.int64)
    if not len(sizes):
        return bins, offsets
    tree = Tournament(len(sizes), capacity)
    for i in np.argsort(-sizes, kind="stable").tolist():
        bins[i], had = tree.place(int(sizes[i]))
        offsets[i] = capacity - had
    return bins, offsets


def _pieces(vocabulary: str, capacity: int, end: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, last = ByteEncoder(vocabulary), np.array([end], dtype="<u4").tobytes()
        for frame in in_slices(frames, "text"):
            rows, starts, lengths, sums, totals = [], [], [], [], []
            for i, text in enumerate(frame.text):
                ids = (encode(text) if isinstance(text, str) else b"") + last
                n = len(ids) // 4
                for at in range(0, n, capacity):
                    piece = ids[4 * at : 4 * (at + capacity)]
                    rows.append(i)
                    starts.append(at)
                    lengths.append(len(piece) // 4)
                    sums.append(zlib.crc32(piece))
                    totals.append(n)
            base = frame.iloc[rows]
            yield pd.DataFrame(
                {
                    "id": base.id.array, "box": base.box.array, "place": base.place.array, "start": starts,
                    "length": lengths, "ids_crc32": sums, "doc_tokens": totals,
                }
            )

    return run


_PIECE = "id string, box int, place long, start long, length long, ids_crc32 long, doc_tokens long"


def _pack(capacity: int):
    def run(group: Group) -> list[tuple]:
        order = np.lexsort((group["start"], group["place"]))
        bins, offsets = first_fit_decreasing(group["length"][order].astype(np.int64), capacity)
        ids = (group["box"].astype(np.int64)[order] << 36) | bins
        columns = [group[c][order].tolist() for c in ("id", "start", "length", "ids_crc32", "doc_tokens")]
        return list(zip(*columns, ids.tolist(), offsets.tolist(), strict=True))

    return run


def packed(
    docs: DataFrame,
    vocabulary: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    capacity: int = 1024,
    end: int = 0,
    group_size: int = 4096,
    seed: int = 7,
) -> DataFrame:
    """One row per piece: ``id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    ``vocabulary``: a rank file of a byte-level vocabulary. A document is its ids and ``end``
    (null and empty texts: ``end`` alone), cut into pieces of ``capacity`` and a rest.
    Documents are dealt at random, by a hash of id, content and place of reading, into groups
    of about ``group_size``; each group is packed first-fit decreasing on its own, the first
    bin with room found in a tournament tree. So a group of copies is spread, tasks are of
    even size, and no order over all documents is needed. A sequence is filled from offset 0
    without gaps; sequence ids are unique, not gapless.
    """
    groups = max(1, -(-docs.count() // group_size))
    spread = F.xxhash64(F.lit(seed), F.col(id_column), F.xxhash64(text_column), F.monotonically_increasing_id())
    source = docs.select(
        F.col(id_column).cast("string").alias("id"), F.pmod(spread, F.lit(groups)).cast("int").alias("box"), spread.alias("place"),
        F.col(text_column).alias("text"),
    )
    pieces = source.mapInPandas(_pieces(vocabulary, capacity, end), _PIECE)
    schema = "id string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return over_groups(pieces, ["box"], _pack(capacity), schema).withColumn("id", F.col("id").cast("long"))
