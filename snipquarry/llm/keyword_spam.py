"""Keyword-stuffed and link-list pages.

Method: pointwise mutual information of neighbouring words, from exact word and pair counts over the
whole corpus: counted by groups of pages, summed by key, and joined back to the groups. A page's own
occurrences, and its copies', are taken off, so that keywords which only this page joins say nothing for each other. A
page is spam if more than half of its words stand in word salad (pieces that are no sentences, with
little mean information around them), in excessively repeated collocations (sentences that only repeat
search phrases), or in links and tags.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, hash_tokens, runs, words

#: Pages that are counted and judged together.
GROUP_ROWS = 1024
#: The key of the number of all words.
TOTAL = np.uint64(0)
#: The mean information of fewer words says little.
MIN_WORDS = 30
#: A page is spam if more than this share of its words stands in such pieces.
SPAM_SHARE = 0.5
#: A collocation is excessive from this count and this share of the page's words on.
HOT_COUNT, HOT_SHARE = 4, 0.04
#: Neighbours on either side over which information is averaged, and the mean in bits below which a piece is word salad.
REACH, SALAD_BITS = 8, 2.25

_END = re.compile(r"[.!?:。!?:…][\"'”’»)\]*_]*\s*$")
_LINKISH = re.compile(r"(?:https?://|www\.)\S+|(?<![\w@])[\w-]+(?:\.[\w-]+)*\.[a-z]{2,10}/\S*", re.IGNORECASE)
_TAG = re.compile(r"#\w+")
_CUT = re.compile(r"(?<=[.!?。!?])\s+|(?<=[。!?])")


def _keys(text: str) -> np.ndarray:
    """The 64-bit keys of a text's words, of its neighbouring pairs, and of the text itself."""
    h = hash_tokens(words(text))
    return np.concatenate([h, runs(h, 2), [_text_key(text)]]) if len(h) else h


def _text_key(text: str) -> np.uint64:
    return np.uint64(xxhash.xxh3_64_intdigest(text, seed=1))


def counted(rows: DataFrame) -> DataFrame:
    """(group, key, n): for every group of pages, the exact count over all texts of each word and pair that the group has.

    Key ``TOTAL`` holds the number of all words. Groups are counted in one pass, and a key's counts are
    summed over them; nothing comes to the driver.
    """

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            keys, n = np.append(keys, TOTAL), np.append(n, n_words)
            return pa.RecordBatch.from_pydict({"group": pa.array(np.full(len(keys), group)), "key": pa.array(keys.view(np.int64)), "part": pa.array(n.astype(np.int64))})

        group, held, n_words = None, [], 0
        for b in batches:
            for g, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if g != group:
                    if held:
                        yield flush()
                    group, held, n_words = g, [], 0
                if t and len(keys := _keys(t)):
                    held.append(keys)
                    n_words += len(keys) // 2
        if held:
            yield flush()

    parts = rows.select("group", "text").mapInArrow(partial, "group long, key long, part long")
    return parts.select("group", "key", F.sum("part").over(Window.partitionBy("key")).alias("n"))


def spread(s: np.ndarray, reach: int = REACH) -> np.ndarray:
    """The mean over up to ``reach`` neighbours on either side."""
    sums, at = np.concatenate(([0.0], np.cumsum(s))), np.arange(len(s))
    low, high = np.maximum(at - reach, 0), np.minimum(at + reach + 1, len(s))
    return (sums[high] - sums[low]) / (high - low)


def information(h: np.ndarray, copies: int, keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """PMI in bits of every neighbouring pair of a page by the counts of all other pages, and the pair's count in the page.

    ``keys`` is sorted and has the page's words and pairs and ``TOTAL``. A page and its ``copies`` don't
    vouch for their own pairs, and one occurrence is added to what is seen and to what is expected, so that words without
    evidence have no information either way.
    """
    if len(h) < 2:
        return np.empty(0), np.empty(0, dtype=np.int64)
    one, at_one, own_one = np.unique(h, return_inverse=True, return_counts=True)
    two, at_two, own_two = np.unique(runs(h, 2), return_inverse=True, return_counts=True)
    others = lambda k, own: (counts[np.searchsorted(keys, k)] - copies * own).astype(float)
    words_seen, pairs_seen = others(one, own_one)[at_one], others(two, own_two)[at_two]
    expected = words_seen[:-1] * words_seen[1:] / max(1, int(counts[np.searchsorted(keys, TOTAL)]) - copies * len(h))
    return np.log2((pairs_seen + 1) / (expected + 1)), own_two[at_two]


def judge(text: str | None, keys: np.ndarray, counts: np.ndarray) -> dict[str, float]:
    """Word count, mean information, and the shares of words in links and tags, in word salad and in repeated collocations."""
    h = hash_tokens(words(text))
    n = len(h)
    out = {"n": n, "pmi": 0.0, "links": 0.0, "salad": 0.0, "stuffed": 0.0, "spam": False}
    if not n:
        return out
    info, own = information(h, int(counts[np.searchsorted(keys, _text_key(text))]), keys, counts)
    near = spread(info)
    out["pmi"] = float(info.mean()) if len(info) else 0.0
    couples = np.concatenate((own, [0]))
    hot = _touched((couples >= HOT_COUNT) & (couples >= HOT_SHARE * n))
    # a short text holds too few pairs for their mean: its salad also has to repeat phrases of different words
    phrase = _touched((couples > 1) & np.concatenate((h[1:] != h[:-1], [False]))) if n < MIN_WORDS else None
    links = salad = stuffed = at = 0
    for line in text.split("\n"):
        for piece in _CUT.split(line):
            k = len(WORD.findall(piece.lower()))
            if not k:
                continue
            start, at = at, at + k
            linkish = sum(len(WORD.findall(x)) for pattern in (_LINKISH, _TAG) for x in pattern.findall(piece))
            if linkish >= 0.5 * k:
                links += k
            elif 2 * hot[start:at].sum() >= k:
                stuffed += k
            elif not (_END.search(piece) and k >= 4 and piece.count(",") + piece.count("|") < 0.34 * k):
                if len(near) and near[start : max(at - 1, start + 1)].mean() < SALAD_BITS if start < len(near) else len(near) and near[-1] < SALAD_BITS:
                    salad += k if phrase is None or 2 * phrase[start:at].sum() > k else 0
    out["links"], out["salad"], out["stuffed"] = links / n, salad / n, stuffed / n
    out["spam"] = links + salad + stuffed > SPAM_SHARE * n
    return out


def _touched(pairs: np.ndarray) -> np.ndarray:
    """The words that stand in one of the marked pairs (pair i is words i and i + 1)."""
    return pairs | np.concatenate(([False], pairs[:-1]))


def judged(df: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, mean_pmi, link_share, salad_share, stuffed_share, spam): one row per row.

    Null and empty texts are never spam and have zeros; repeated rows are judged alike; an empty table gives an empty result; other columns are left aside.
    """
    from ..session import materialize

    rows = df.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = materialize(rows.withColumn("group", F.expr(f"monotonically_increasing_id() div {GROUP_ROWS}")), "spam")

    def run(pages: pa.Table, known: pa.Table) -> pa.Table:
        keys, at = np.unique(known["key"].to_numpy().view(np.uint64), return_index=True)
        counts = known["n"].to_numpy()[at]
        got = [judge(t, keys, counts) for t in pages["text"].to_pylist()]
        out = {"doc_id": pages["doc_id"], "n_words": [g["n"] for g in got], "mean_pmi": [g["pmi"] for g in got], "link_share": [g["links"] for g in got], "salad_share": [g["salad"] for g in got], "stuffed_share": [g["stuffed"] for g in got], "spam": [g["spam"] for g in got]}
        return pa.table(out, schema=pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("mean_pmi", pa.float64()), ("link_share", pa.float64()), ("salad_share", pa.float64()), ("stuffed_share", pa.float64()), ("spam", pa.bool_())]))

    return rows.groupBy("group").cogroup(counted(rows).groupBy("group")).applyInArrow(run, "doc_id long, n_words long, mean_pmi double, link_share double, salad_share double, stuffed_share double, spam boolean")


def spam_pages(df: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    return judged(df, doc, text).where("spam").select("doc_id")
