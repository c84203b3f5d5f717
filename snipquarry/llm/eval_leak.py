"""Evaluation texts leaking into training text.

Method: prefix-filtered set join. Every item-sized window (a run of up to 10 words) is a set of short
shingles ordered by rarity in the corpus; a page holding the window holds all of them, so the rarest
alone is the necessary prefix. Pages are matched on those prefix shingles, length and position bounds
say where the window would have to lie, and the run itself is then compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import hash_tokens, runs, words

RUN = 10
SHINGLE = 3
#: Characters of item text that one block may hold; more items are processed in several blocks.
BLOCK_CHARS = 8_000_000


class ItemIndex:
    """Windows of a block of items, and the rarest shingle of each, in arrays: about 40 bytes a window."""

    def __init__(self, items: list[tuple[int, str]]):
        self.texts = {i: t for i, t in items if words(t)}
        self._words: dict[int, list[str]] = {}

    def _hashes(self) -> Iterator[tuple[int, np.ndarray]]:
        return ((i, hash_tokens(words(t))) for i, t in self.texts.items())

    def shingles(self) -> dict[int, np.ndarray]:
        """Distinct shingle hashes by shingle length; very short items are their own shingle."""
        out: dict[int, list[np.ndarray]] = {}
        for _, h in self._hashes():
            k = min(SHINGLE, len(h))
            out.setdefault(k, []).append(runs(h, k))
        return {k: np.unique(np.concatenate(v)) for k, v in out.items()}

    def build(self, counts: dict[int, np.ndarray]) -> None:
        """Choose prefixes by the counts of ``shingles()`` in the corpus."""
        names = self.shingles()
        windows: dict[int, list[tuple[np.ndarray, ...]]] = {}  # by run length: run, item, position
        prefixes: dict[int, list[tuple[np.ndarray, ...]]] = {}  # by shingle length: shingle, offset, run length
        for i, h in self._hashes():
            size, k = min(RUN, len(h)), min(SHINGLE, len(h))
            grams, whole = runs(h, k), runs(h, size)
            rare = counts[k][np.searchsorted(names[k], grams)]
            offset = np.lib.stride_tricks.sliding_window_view(rare, size - k + 1).argmin(axis=1)
            at = np.arange(len(whole))
            windows.setdefault(size, []).append((whole, np.full(len(whole), i), at))
            prefixes.setdefault(k, []).append((grams[at + offset], offset, np.full(len(whole), size)))
        self.windows = {size: _by_first(parts) for size, parts in windows.items()}
        self.prefixes = {k: _by_first(parts, distinct=True) for k, parts in prefixes.items()}

    def held_by(self, text: str | None) -> set[int]:
        tokens = words(text)
        found: set[int] = set()
        if not tokens:
            return found
        h = hash_tokens(tokens)
        runs_of: dict[int, np.ndarray] = {}
        for k, (wanted, offsets, sizes) in self.prefixes.items():
            grams = runs(h, k)
            if not len(grams):
                continue
            first, last = np.searchsorted(wanted, grams), np.searchsorted(wanted, grams, side="right")
            for p in np.flatnonzero(last > first):
                for place in range(first[p], last[p]):
                    start, size = int(p) - int(offsets[place]), int(sizes[place])
                    if start < 0 or start + size > len(tokens):
                        continue
                    if size not in runs_of:
                        runs_of[size] = runs(h, size)
                    whole, item, position = self.windows[size]
                    a, b = (int(np.searchsorted(whole, runs_of[size][start], side=side)) for side in ("left", "right"))
                    for w in range(a, b):
                        i, at = int(item[w]), int(position[w])
                        if i not in found and tokens[start : start + size] == self._item(i)[at : at + size]:
                            found.add(i)
        return found

    def _item(self, i: int) -> list[str]:
        """The words of an item that a page may hold; few items are asked for."""
        if i not in self._words:
            if len(self._words) > 10_000:
                self._words.clear()
            self._words[i] = words(self.texts[i])
        return self._words[i]


def _by_first(parts: list[tuple[np.ndarray, ...]], distinct: bool = False) -> tuple[np.ndarray, ...]:
    """Parallel arrays joined and sorted by the first; with ``distinct`` equal rows stand once."""
    columns = [np.concatenate(x) for x in zip(*parts, strict=True)]
    order = np.lexsort(columns[::-1])
    columns = [columns[0][order], *(c[order].astype(np.int32) for c in columns[1:])]
    if distinct:
        new = np.concatenate(([True], np.any([c[1:] != c[:-1] for c in columns], axis=0)))
        columns = [c[new] for c in columns]
    return tuple(columns)


def _shingle_counts(docs: DataFrame, names: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """Occurrences of the items' shingles in all texts."""
    shared = docs.sparkSession.sparkContext.broadcast(names)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {k: np.zeros(len(v), dtype=np.int64) for k, v in shared.value.items()}
        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    h = hash_tokens(words(t))
                    for k, v in shared.value.items():
                        g = runs(h, k)
                        if len(g):
                            slot = np.minimum(np.searchsorted(v, g), len(v) - 1)
                            sums[k] += np.bincount(slot[v[slot] == g], minlength=len(v))
        for k, s in sums.items():
            at = np.flatnonzero(s)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k), pa.int32()), pa.array(at, pa.int32()), pa.array(s[at], pa.int64())], names=["k", "slot", "n"])

    out = {k: np.zeros(len(v), dtype=np.int64) for k, v in names.items()}
    # at most one row per shingle of the block
    for r in docs.mapInArrow(count, "k int, slot int, n long").groupBy("k", "slot").agg(F.sum("n").alias("n")).collect():
        out[r["k"]][r["slot"]] = r["n"]
    return out


def leaks(docs: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id): documents sharing a run of RUN consecutive words with an item, or all of a shorter item.

    Items without a word and null or empty texts match nothing; repeated documents or items give their
    pair once per document row; empty tables give an empty result; other columns are left aside.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    own = items.select(F.col(item).cast("long").alias("item_id"), F.col(item_text).alias("text")).where(F.col("text").isNotNull()).dropDuplicates(["item_id", "text"])
    own = materialize(own, "items")
    chars = own.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-chars // BLOCK_CHARS) or 1
    result = None
    for n in range(blocks):
        rows = own.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == n) if blocks > 1 else own
        # an id may come with several texts: each is an item of its own, reported under the id
        got = [(r["item_id"], r["text"]) for r in rows.collect()]
        ids = [i for i, _ in got]
        index = ItemIndex(list(enumerate(t for _, t in got)))
        names = index.shingles()
        index.build(_shingle_counts(d.select("text"), names) if names else {})
        shared = spark.sparkContext.broadcast((index, ids))

        def match(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index, ids = shared.value
            for b in batches:
                left, right = [], []
                for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    for x in sorted({ids[k] for k in index.held_by(t)}):
                        left.append(i)
                        right.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["doc_id", "item_id"])

        part = d.mapInArrow(match, "doc_id long, item_id long")
        result = part if result is None else result.unionByName(part)
    return result
