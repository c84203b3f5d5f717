"""Words, hashed shingles and bounded count sketches shared by the text operators.

A word is a longest run of Unicode letters and digits, in lower case.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = regex.compile(r"[\p{L}\p{N}]+")
#: Counters in a sketch: 2**18 counters of 32 bits are 1 MiB, whatever the corpus size.
SKETCH_BITS = 18
_SKETCH_BLOCKS = 64
_CACHE_MAX = 200_000
_MULT = np.uint64(0x9E3779B97F4A7C15)

_token_hash: dict[str, int] = {}


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def hash_tokens(tokens: list[str]) -> np.ndarray:
    """64-bit hashes of tokens; a bounded per-process cache spares repeated hashing."""
    cache, digest = _token_hash, xxhash.xxh3_64_intdigest
    if len(cache) > _CACHE_MAX:
        cache.clear()
    out = []
    for t in tokens:
        h = cache.get(t)
        if h is None:
            h = cache[t] = digest(t)
        out.append(h)
    return np.array(out, dtype=np.uint64)


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` consecutive tokens, in order."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    acc = hashes[:n].copy()
    for i in range(1, k):
        acc *= _MULT
        acc ^= acc >> np.uint64(29)
        acc += hashes[i : i + n]
    acc ^= acc >> np.uint64(32)
    acc *= np.uint64(0xD6E8FEB86659FD93)
    acc ^= acc >> np.uint64(32)
    return acc


def each_batch(df: DataFrame, schema: str, fn: Callable[[dict[str, list]], dict[str, object]]) -> DataFrame:
    """mapInArrow with columns as Python lists in, columns (lists or arrays) out."""
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                out = fn({n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)})
                yield pa.RecordBatch.from_arrays([x if isinstance(x := out[f.name], pa.Array) else pa.array(x, type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


#: Copies of one block of counters that a task adds up at once.
FAN_IN = 256


def count_sketch(df: DataFrame, slots_of: Callable[[pa.RecordBatch], np.ndarray], bits: int = SKETCH_BITS, fan_in: int = FAN_IN) -> np.ndarray:
    """Counts over all rows in ``2**bits`` counters; ``slots_of`` gives the counter of every item of a batch.

    Each partition sends one set of blocks of fixed size. Sets are summed on executors in a tree, ``fan_in`` at
    a time, so no task's input grows with the number of partitions, and only the finished sketch, of a fixed
    size, comes to the driver.
    """
    size = 1 << bits
    blocks = min(_SKETCH_BLOCKS, size)
    most = np.iinfo(np.uint32).max

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        acc = np.zeros(size, dtype=np.int64)
        seen = False
        for b in batches:
            if b.num_rows:
                slots = slots_of(b)
                if len(slots):
                    seen = True
                    acc += np.bincount(slots, minlength=size)
        if seen:
            rows = np.minimum(acc, most).astype(np.uint32).reshape(blocks, -1)
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_pydict({"block": pa.array(range(blocks), pa.int32()), "part": pa.array([part] * blocks, pa.int32()), "counts": pa.array([r.tobytes() for r in rows], pa.binary())})

    def total(key, pdf):
        import pandas as pd

        acc = sum(np.frombuffer(x, dtype=np.uint32).astype(np.int64) for x in pdf["counts"])
        return pd.DataFrame({"block": [key[0]], "part": [key[1]], "counts": [np.minimum(acc, most).astype(np.uint32).tobytes()]})

    schema = "block int, part int, counts binary"
    sums, parts = df.mapInArrow(partial, schema), df.rdd.getNumPartitions()
    while True:
        sums = sums.withColumn("part", F.expr(f"part div {fan_in}").cast("int")).groupBy("block", "part").applyInPandas(total, schema)
        if parts <= fan_in:
            break
        parts = -(-parts // fan_in)
    out = np.zeros((blocks, size // blocks), dtype=np.uint32)
    for r in sums.collect():  # one row per block
        out[r["block"]] = np.frombuffer(r["counts"], dtype=np.uint32)
    return out.reshape(-1)
