"""Set-similarity building blocks: hashed run sets, rarest-first prefixes, exact Jaccard.

For a threshold t, two sets with Jaccard >= t share an element among the first
n - ceil(t n) + 1 elements of each under any one total order. The order used here is rarest first by a
count sketch over all rows, of a size that follows the number of elements up to 2**MOST_BITS counters; the
sketch only affects speed, never the result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SKETCH_BITS, count_sketch

#: The largest sketch: 2**20 counters are 4 MiB.
MOST_BITS = 20
#: Thresholds are held as tenths, so that comparisons stay in whole numbers.
SIMILARITY_TENTHS = 7


def set_key(grams: np.ndarray) -> int:
    """Signed 64-bit name of a run set."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(grams.tobytes())).astype(np.int64))


def to_grams(run_hashes: np.ndarray) -> np.ndarray:
    """The distinct runs as sorted 32-bit numbers."""
    return np.unique((run_hashes >> np.uint64(32)).astype(np.uint32)).view(np.int32)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column end to end, and each row's length."""
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], np.diff(offsets)


def sketch_of(df: DataFrame, grams: str = "grams") -> np.ndarray:
    """Counts of elements, about sixteen to a counter unless that takes more than 2**MOST_BITS of them."""
    total = df.agg(F.sum(F.size(grams).cast("long"))).first()[0] or 0
    bits = max(SKETCH_BITS, min(MOST_BITS, (total // 16).bit_length()))
    shift = np.uint32(32 - bits)

    def slots(batch: pa.RecordBatch) -> np.ndarray:
        values, _ = _flat(batch.column(0))
        return (values.view(np.uint32) >> shift).astype(np.int64)

    return count_sketch(df.select(grams), slots, bits)


def prefix_postings(df: DataFrame, sketch: np.ndarray, carry: list[str], tenths: int = SIMILARITY_TENTHS, once_per: str | None = None) -> DataFrame:
    """(h, most, *carry): the rarest-first prefix of every row's ``grams``, and a bound on how many rows hold h.

    ``carry`` names long columns to repeat. With ``once_per``, rows of a partition with equal values
    there give postings once, so that copies of one text are pre-aggregated before any shuffle.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(sketch)  # at most 4 MiB, see MOST_BITS
    shift = np.uint32(32 - (len(sketch).bit_length() - 1))
    schema = pa.schema([("h", pa.int32()), ("most", pa.int64()), *((c, pa.int64()) for c in carry)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        seen: set[int] = set()
        for b in batches:
            if once_per and b.num_rows:
                ks = b.column("_once").to_pylist()
                keep = [not (k in seen or seen.add(k)) for k in ks]
                b = b.filter(pa.array(keep))
            if not b.num_rows:
                continue
            values, sizes = _flat(b.column("grams"))
            row = np.repeat(np.arange(len(sizes)), sizes)
            order = np.lexsort((values, counts[values.view(np.uint32) >> shift], row))
            rank = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            take = rank < np.repeat(sizes - (sizes * tenths + 9) // 10 + 1, sizes)
            picked = order[take]
            rows = row[picked]
            h = values[picked]
            columns = [pa.array(h, pa.int32()), pa.array(counts[h.view(np.uint32) >> shift].astype(np.int64))]
            columns += [b.column(c).take(pa.array(rows)) for c in carry]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    cols = [F.col("grams"), *(F.col(c).cast("long") for c in carry)] + ([F.col(once_per).alias("_once")] if once_per else [])
    return df.where(F.size("grams") > 0).select(*cols).mapInArrow(run, "h int, most long" + "".join(f", {c} long" for c in carry))


def sizes_allow(a: Column, b: Column, tenths: int = SIMILARITY_TENTHS) -> Column:
    """Length bound: sets whose sizes differ too much can't reach the threshold."""
    return (a * 10 >= b * tenths) & (b * 10 >= a * tenths)


def similar(a: str, b: str, tenths: int = SIMILARITY_TENTHS) -> Column:
    """Exact Jaccard test of two gram arrays, in whole numbers, inside the JVM."""
    both = F.size(F.array_intersect(a, b))
    return both * 10 >= (F.size(a) + F.size(b) - both) * tenths


#: A key filter has at most 2**25 bits, 4 MiB; with more keys than that it lets more rows pass, never fewer.
FILTER_BITS = 25
_FILTER_BLOCK = 15


def keep_keys(df: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    """Rows of ``df`` whose key may be among ``keys`` (all that are, and some others), without a shuffle of ``df``.

    A bit set of bounded size goes to the executors; an exact join must follow. ``keys`` must be
    materialised and evenly spread 64-bit hashes.
    """
    spark = df.sparkSession
    bits = max(_FILTER_BLOCK + 3, min(FILTER_BITS, int(keys.count() * 16).bit_length()))
    slot = F.shiftrightunsigned(F.col(key), 64 - bits)
    schema = "block long, bits binary"

    def pack(k, pdf):
        import pandas as pd

        b = np.zeros(1 << _FILTER_BLOCK, dtype=np.uint8)
        b[pdf["slot"].to_numpy() & ((1 << _FILTER_BLOCK) - 1)] = 1
        return pd.DataFrame({"block": [k[0]], "bits": [np.packbits(b).tobytes()]})

    slots = keys.select(slot.alias("slot")).distinct().withColumn("block", F.shiftright("slot", _FILTER_BLOCK))
    table = np.zeros((1 << (bits - _FILTER_BLOCK), 1 << (_FILTER_BLOCK - 3)), dtype=np.uint8)
    for r in slots.groupBy("block").applyInPandas(pack, schema).collect():
        table[r["block"]] = np.frombuffer(r["bits"], dtype=np.uint8)
    shared = spark.sparkContext.broadcast(table.reshape(-1))
    at = df.columns.index(key)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = b.column(at).to_numpy().view(np.uint64) >> np.uint64(64 - bits)
            hit = shared.value[(k >> np.uint64(3)).astype(np.int64)] >> (7 - (k & np.uint64(7))).astype(np.uint8) & 1
            yield b.filter(pa.array(hit.astype(bool)))

    return df.mapInArrow(run, df.schema)
