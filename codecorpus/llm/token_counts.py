"""Edit-aware token counting: a segment tree per document, of which edits touch only some leaves."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from codecorpus.llm.packing import ByteEncoder

#: A leaf is cut at the first safe place after so many characters.
LEAF = 256
#: White space after something else always begins a new piece, and what comes before ends there, whatever follows.
_SAFE = re.compile(r"(?<=\S)[ \n]")


def leaf_starts(text: str, leaf: int = LEAF) -> list[int]:
    """Where leaves begin; each can be encoded on its own. An empty text has one empty leaf."""
    starts, at = [0], 0
    while (cut := _SAFE.search(text, at + leaf)) is not None:
        at = cut.start()
        starts.append(at)
    return starts


def sum_tree(counts: list[int]) -> np.ndarray:
    """Counts at the leaves of a binary tree in an array, each inner node the sum of its two; the root is at 1."""
    size = 1 << max(0, (len(counts) - 1).bit_length())
    tree = np.zeros(2 * size, dtype=np.int64)
    tree[size : size + len(counts)] = counts
    level = size
    while level > 1:
        tree[level // 2 : level] = tree[level : 2 * level].reshape(-1, 2).sum(axis=1)
        level //= 2
    return tree


def set_leaf(tree: np.ndarray, leaf: int, count: int) -> None:
    at = len(tree) // 2 + leaf
    change = count - tree[at]
    while at and change:
        tree[at] += change
        at //= 2


def clipped(edits: list[tuple[int, int, str]], end: int) -> list[tuple[int, int, str]]:
    """Edits as (from, to, inserted) in order: inside the text, none reaching into the one before."""
    out, upto = [], 0
    for at, removed, inserted in sorted(edits, key=lambda e: e[0]):
        start = min(max(at, upto), end)
        stop = min(max(at + max(removed, 0), start), end)
        out.append((start, stop, inserted))
        upto = stop
    return out


def edited_text(text: str, edits: list[tuple[int, int, str]]) -> str:
    parts, at = [], 0
    for start, stop, inserted in edits:
        parts += [text[at:start], inserted]
        at = stop
    return "".join([*parts, text[at:]])


def regions(starts: list[int], end: int, edits: list[tuple[int, int, str]]) -> list[tuple[int, int, list]]:
    """Leaves (first, last) that edits touch, with the context their boundaries need, and their edits.

    A boundary holds while the characters on both its sides stay. So an edit at the very begin of
    a leaf also takes the leaf before, one that reaches its end the leaf after.
    """
    bounds = np.array([*starts, end])
    found: list[tuple[int, int, list]] = []
    for start, stop, inserted in edits:
        first = max(0, int(np.searchsorted(bounds[:-1], start, side="left")) - 1)
        last = min(len(starts) - 1, int(np.searchsorted(bounds[:-1], stop, side="right")) - 1)
        while last < len(starts) - 1 and stop >= bounds[last + 1]:
            last += 1
        last = max(first, last)
        if found and first <= found[-1][1]:
            before = found.pop()
            first, last = before[0], max(before[1], last)
            found.append((first, last, [*before[2], (start, stop, inserted)]))
        else:
            found.append((first, last, [(start, stop, inserted)]))
    return found


def recount(text: str, starts: list[int], tree: np.ndarray, edits: list[tuple[int, int, str]], encode) -> dict:
    """Re-encode the touched regions only; update the sums above them. ``tree`` is changed in place."""
    before = int(tree[1])
    moved, read, leaves = np.zeros(len(starts), dtype=np.int64), 0, 0
    for first, last, own in regions(starts, len(text), edits):
        left, right = starts[first], starts[last + 1] if last + 1 < len(starts) else len(text)
        region = edited_text(text[left:right], [(a - left, b - left, x) for a, b, x in own])
        set_leaf(tree, first, len(encode(region)) // 4)
        for leaf in range(first + 1, last + 1):
            set_leaf(tree, leaf, 0)
            moved[leaf] = left + len(region) - starts[leaf]
        moved[last + 1 :] = moved[last + 1 :] + len(region) - (right - left)
        # Emptied leaves begin where the region ends, in the text as edited so far.
        shift = int(moved[first])
        moved[first + 1 : last + 1] += shift
        read += len(region)
        leaves += last - first + 1
    return {
        "tokens_before": before, "tokens_after": int(tree[1]), "leaves": len(starts), "leaves_read": leaves, "chars_read": read,
        "starts": (np.array(starts) + moved).tolist(), "tree": tree.tolist(),
    }


_ENCODERS: dict[str, ByteEncoder] = {}


def _encoder(vocabulary: str) -> ByteEncoder:
    if vocabulary not in _ENCODERS:
        _ENCODERS[vocabulary] = ByteEncoder(vocabulary)
    return _ENCODERS[vocabulary]


def token_tree(text: Column, vocabulary: str) -> Column:
    """``starts array<long>, tree array<long>``: the document's leaves and their sums. Null is an empty text."""

    def run(texts: pd.Series) -> pd.DataFrame:
        encode, starts, trees = _encoder(vocabulary), [], []
        for text in texts:
            text = text if isinstance(text, str) else ""
            own = leaf_starts(text)
            starts.append(own)
            trees.append(sum_tree([len(encode(text[a:b])) // 4 for a, b in zip(own, [*own[1:], len(text)], strict=True)]))
        return pd.DataFrame({"starts": starts, "tree": trees})

    return F.pandas_udf(run, "starts array<long>, tree array<long>")(text)


def edited_counts(text: Column, tree: Column, edits: Column, vocabulary: str) -> Column:
    """Counts after edits: ``tokens_before, tokens_after, leaves, leaves_read, chars_read, starts, tree`` (longs).

    ``text``: as it was when ``tree`` (``token_tree``) was built. ``edits``: array of structs
    ``at, removed, inserted`` in characters of that text; null has none. They are taken in order of
    ``at``, cut to the text, and none removes what an earlier one has removed. starts and tree
    belong to the edited text, so counting goes on from there. A null text is empty, a null
    inserted text too; a null place or length is 0.
    """

    def run(texts: pd.Series, starts: pd.Series, trees: pd.Series, at: pd.Series, removed: pd.Series, inserted: pd.Series) -> pd.DataFrame:
        encode, out = _encoder(vocabulary), []
        for text, own, tree, a, r, i in zip(texts, starts, trees, at, removed, inserted, strict=True):
            text = text if isinstance(text, str) else ""
            wanted = [] if a is None else [
                (0 if pd.isna(x) else int(x), 0 if pd.isna(y) else int(y), z if isinstance(z, str) else "") for x, y, z in zip(a, r, i, strict=True)
            ]
            out.append(recount(text, [int(s) for s in own], np.array(tree, dtype=np.int64), clipped(wanted, len(text)), encode))
        return pd.DataFrame(out, columns=["tokens_before", "tokens_after", "leaves", "leaves_read", "chars_read", "starts", "tree"])

    schema = "tokens_before long, tokens_after long, leaves long, leaves_read long, chars_read long, starts array<long>, tree array<long>"
    parts = [edits.getField(name) for name in ("at", "removed", "inserted")]
    return F.pandas_udf(run, schema)(text, tree.getField("starts"), tree.getField("tree"), *parts)
