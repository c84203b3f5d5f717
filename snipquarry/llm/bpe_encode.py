"""Encoding of a whole corpus with a public byte-level BPE vocabulary.

Method: the corpus' frequent pre-tokens are encoded once and compiled into a minimal acyclic
transducer (equal suffixes share states; outputs are additive along a path, so a word's path sums to
its row in an id table). The transducer is a flat file in the shared folder that workers memory-map;
a batch's distinct pre-tokens walk it together, one byte per step. Pre-tokens it doesn't hold are
merged exactly by rank. Word frequencies only decide what the transducer holds, never a result.
"""

from __future__ import annotations

import base64
import os
import urllib.parse
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path

TOKENIZERS = "/opt/tokenizers"
#: Fixed value: the public pattern that splits text before byte-level merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MAX_LEXICON = 150_000
MIN_COUNT = 3
MAX_WORD_BYTES = 48
_MEMO_MAX = 100_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Byte-pair merges of one pre-token, lowest rank first, leftmost on ties.

    Short pieces rescan all pairs; long ones use a heap over a linked list, so that a run of a
    megabyte stays O(n log n).
    """
    if piece in ranks:
        return [ranks[piece]]
    if len(piece) > 64:
        return _merge_long(piece, ranks)
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            r = ranks.get(parts[i] + parts[i + 1])
            if r is not None and (best is None or r < best):
                best, at = r, i
        if best is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    import heapq

    n = len(piece)
    part: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
    right, left = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, size = heapq.heappop(heap)
        j = right[i] if part[i] is not None else n
        if j >= n or part[i] is None or len(part[i]) + len(part[j]) != size:
            continue
        part[i] += part[j]
        part[j] = None
        right[i] = right[j]
        if right[i] < n:
            left[right[i]] = i
        for a, b in ((left[i], i), (i, right[i])):
            if a >= 0 and b < n and (r := ranks.get(part[a] + part[b])) is not None:
                heapq.heappush(heap, (r, a, len(part[a]) + len(part[b])))
    return [ranks[p] for p in part if p is not None]


class Transducer:
    """Minimal acyclic automaton over bytes with additive outputs; word → its rank in sorted order."""

    def __init__(self, first: np.ndarray, keys: np.ndarray, targets: np.ndarray, outputs: np.ndarray, final: np.ndarray):
        self.first, self.keys, self.targets, self.outputs, self.final = first, keys, targets, outputs, final

    @classmethod
    def compile(cls, sorted_words: list[bytes]) -> Transducer:
        """Incremental construction from sorted, distinct words: a finished suffix joins an equal state."""
        register: dict[tuple, int] = {}
        states: list[tuple[bool, tuple]] = []

        def freeze(final: bool, edges: list[tuple[int, int]]) -> int:
            k = (final, tuple(edges))
            if (s := register.get(k)) is None:
                s = register[k] = len(states)
                states.append(k)
            return s

        # open path: per depth [final, edges already closed, byte that leads to the next depth]
        path: list[list] = [[False, [], -1]]
        previous = b""
        for w in [*sorted_words, None]:
            common = 0
            if w is not None:
                while common < min(len(w), len(previous)) and w[common] == previous[common]:
                    common += 1
            while len(path) - 1 > common:
                final, edges, _ = path.pop()
                path[-1][1].append((path[-1][2], freeze(final, edges)))
            if w is None:
                break
            for b in w[common:]:
                path[-1][2] = b
                path.append([False, [], -1])
            path[-1][0] = True
            previous = w
        root = freeze(path[0][0], path[0][1])
        reach = np.zeros(len(states), dtype=np.int64)  # words accepted from a state; targets come first
        for s, (final, edges) in enumerate(states):
            reach[s] = final + sum(reach[t] for _, t in edges)
        order = np.empty(len(states), dtype=np.int64)  # the root gets number 0
        order[:] = (root - np.arange(len(states))) % len(states)
        keys, targets, outputs = [], [], []
        final = np.zeros(len(states), dtype=np.uint8)
        for s, (is_final, edges) in enumerate(states):
            final[order[s]] = is_final
            before = int(is_final)
            for b, t in edges:
                keys.append(int(order[s]) << 8 | b)
                targets.append(int(order[t]))
                outputs.append(before)
                before += int(reach[t])
        by = np.argsort(np.array(keys, dtype=np.int64), kind="stable")
        keys = np.array(keys, dtype=np.int64)[by]
        first = np.searchsorted(keys, np.arange(len(states) + 1, dtype=np.int64) << 8)
        return cls(first.astype(np.int64), keys, np.array(targets, dtype=np.int64)[by], np.array(outputs, dtype=np.int64)[by], final)

    def walk(self, batch: list[bytes]) -> np.ndarray:
        """Row of every word, -1 for words not held; all words advance together, a byte per step."""
        n = len(batch)
        rows = np.zeros(n, dtype=np.int64)
        if not n or not len(self.keys):
            return np.full(n, -1, dtype=np.int64)
        lengths = np.fromiter(map(len, batch), dtype=np.int64, count=n)
        starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        data = np.frombuffer(b"".join(batch), dtype=np.uint8)
        state = np.zeros(n, dtype=np.int64)
        state[lengths > MAX_WORD_BYTES] = -1
        alive = np.flatnonzero((lengths > 0) & (state >= 0))
        step = 0
        while len(alive):
            wanted = state[alive] << 8 | data[starts[alive] + step]
            at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            ok = self.keys[at] == wanted
            state[alive[~ok]] = -1
            alive, at = alive[ok], at[ok]
            state[alive] = self.targets[at]
            rows[alive] += self.outputs[at]
            step += 1
            alive = alive[lengths[alive] > step]
        good = state >= 0
        good[good] = self.final[state[good]] == 1
        rows[~good] = -1
        return rows


_HEADER = 8


def lexicon_bytes(words: Iterable[bytes], ranks: dict[bytes, int]) -> bytes:
    """The flat file: a header of array lengths, then the arrays of the transducer and of the id table."""
    ws = sorted(set(words))
    t = Transducer.compile(ws)
    ids = [merge(w, ranks) for w in ws]
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int64)
    arrays = [t.keys, t.targets, t.outputs, t.final.astype(np.int64), offsets, np.array(list(chain.from_iterable(ids)), dtype=np.int64)]
    header = np.zeros(_HEADER, dtype=np.int64)
    header[: len(arrays)] = [len(a) for a in arrays]
    return b"".join(a.astype(np.int64).tobytes() for a in [header, *arrays])


class Lexicon:
    def __init__(self, flat: np.ndarray):
        sizes, at, parts = flat[:_HEADER], _HEADER, []
        for n in sizes[:6]:
            parts.append(flat[at : at + int(n)])
            at += int(n)
        keys, targets, outputs, final, self.offsets, self.ids = parts
        self.fst = Transducer(np.empty(0), keys, targets, outputs, final)


class Encoder:
    """One per Python worker: the mapped lexicon, the ranks, and a bounded memo of merged words."""

    def __init__(self, flat: np.ndarray, ranks: dict[bytes, int]):
        self.lexicon, self.ranks, self.memo = Lexicon(flat), ranks, {}
        self.split = regex.compile(PATTERN)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the offsets of each text."""
        index: dict[str, int] = {}
        add = index.setdefault
        where = [[add(p, len(index)) for p in self.split.findall(t)] if t else [] for t in texts]
        pieces = [p.encode() for p in index]
        rows = self.lexicon.fst.walk(pieces)
        offsets, ids = self.lexicon.offsets, self.lexicon.ids
        known = rows >= 0
        size = np.empty(len(pieces), dtype=np.int64)
        start = np.empty(len(pieces), dtype=np.int64)
        start[known] = offsets[rows[known]]
        size[known] = offsets[rows[known] + 1] - start[known]
        extra: list[int] = []
        memo, ranks = self.memo, self.ranks
        for i in np.flatnonzero(~known):
            p = pieces[i]
            got = memo.get(p)
            if got is None:
                got = merge(p, ranks)
                if len(p) <= 256:
                    if len(memo) > _MEMO_MAX:
                        memo.clear()
                    memo[p] = got
            start[i], size[i] = len(ids) + len(extra), len(got)
            extra += got
        pool = np.concatenate((ids, np.array(extra, dtype=np.int64)))
        flat = np.fromiter(chain.from_iterable(where), dtype=np.int64)
        counts = size[flat]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        take = np.arange(total) - np.repeat(ends - counts, counts) + np.repeat(start[flat], counts)
        words_before = np.concatenate(([0], np.cumsum([len(w) for w in where])))
        ids_before = np.concatenate(([0], ends))
        return pool[take].astype(np.int32), ids_before[words_before].astype(np.int32)


_encoders: dict[tuple[str, str], Encoder] = {}


def _encoder(lexicon: str, vocabulary: str) -> Encoder:
    if (e := _encoders.get((lexicon, vocabulary))) is None:
        _encoders.clear()
        local = urllib.parse.urlparse(lexicon).path if lexicon.startswith("file:") else SparkFiles.get(os.path.basename(lexicon))
        e = _encoders[lexicon, vocabulary] = Encoder(np.memmap(local, dtype=np.int64, mode="r"), load_ranks(vocabulary))
    return e


def frequent_words(df: DataFrame, text: str, most: int) -> DataFrame:
    """The ``most`` most frequent pre-tokens with their counts over all texts, at least ``MIN_COUNT`` each."""
    # the JVM's split differs from the pattern's in odd white space only; that never changes ids
    split = F.regexp_extract_all(F.col(text), F.lit(r"( ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+)"), F.lit(1))
    return (
        df.where(F.col(text).isNotNull()).select(F.explode(split).alias("w")).groupBy("w").agg(F.count("*").alias("n")).where((F.col("n") >= MIN_COUNT) & (F.octet_length("w") <= MAX_WORD_BYTES)).orderBy(F.desc("n"), "w").limit(most)
    )


def encode_corpus(df: DataFrame, id_col: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k", tokenizers: str = TOKENIZERS, max_lexicon: int = MAX_LEXICON) -> DataFrame:
    """(``id_col``, ``ids``): one row per input row.

    Null and empty texts give the empty list; blank texts are encoded as they are; strings that look
    like special tokens are ordinary text. Other columns are left aside, repeated rows stay repeated,
    an empty table gives an empty result.
    """
    spark = df.sparkSession
    path = f"{tokenizers}/{vocabulary}.tiktoken"
    df = df.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    words = [r["w"].encode() for r in frequent_words(df, "text", max_lexicon).collect()]  # bounded by max_lexicon
    where = scratch_path(spark, "lexicon") + ".bin"
    data = lexicon_bytes(words, load_ranks(path))
    if where.startswith("file:"):
        local = urllib.parse.urlparse(where).path
        os.makedirs(os.path.dirname(local), exist_ok=True)
        with open(local, "wb") as f:
            f.write(data)
    else:  # a remote shared folder can't be mapped: Spark fetches the file to each executor's own files folder
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(where)
        out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
        out.write(data)
        out.close()
        spark.sparkContext.addFile(where)
    kind = df.schema["id"].dataType.simpleString()
    arrow_id = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    arrow = pa.schema([(id_col, arrow_id), ("ids", pa.list_(pa.field("element", pa.int32())))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, offsets = _encoder(where, path).encode(b.column(1).to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32())).cast(arrow.field(1).type)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(arrow_id), lists], schema=arrow)

    return df.mapInArrow(run, f"{id_col} {kind}, ids array<int>")
