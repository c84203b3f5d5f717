"""Near-duplicate code with small edits: all pairs over a threshold, and their groups.

Method: BK-trees whose children are keyed by the integer Hamming distance to the parent, following
only edges within the radius. The Hamming distance is that of parity sketches (each element of a set
flips one of 256 bits), which never exceeds the size of the symmetric difference; so a radius derived
from the Jaccard threshold loses no pair. One tree over the corpus would prune nothing at this radius
and would grow with the data, so trees are built per shard: a shard holds the snippets that share one
element of their rarest-first prefix, and any pair over the threshold meets in some shard. Trees are
built where their shard is, never broadcast. Pairs that trees return are verified exactly.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import hash_tokens, runs
from .sets import SIMILARITY_TENTHS, keep_keys, prefix_postings, set_key, similar, sizes_allow, sketch_of, to_grams

RUN = 4
MIN_TOKENS = 25
BITS = 256
#: A larger shard is cut into blocks of about this many, and every two blocks meet in a task of their own.
SHARD_BLOCK = 2000
#: Elements that more rows may hold than this are never brought together in one task.
HOT = 50_000

TOKEN = re.compile(r"\w+|[^\w\s]")


def parity_sketch(grams: np.ndarray) -> bytes:
    bits = np.bincount((grams.view(np.uint32) * np.uint32(0x9E3779B1)) >> np.uint32(32 - 8), minlength=BITS) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def fingerprints(df: DataFrame, id_col: str, code: str) -> DataFrame:
    """(id, key, grams, sketch) of every row with at least MIN_TOKENS tokens; equal run sets share a key."""
    schema = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("grams", pa.list_(pa.field("element", pa.int32()))), ("sketch", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, keys, grams, sketches = [], [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                tokens = TOKEN.findall(t)
                if len(tokens) >= MIN_TOKENS:
                    g = to_grams(runs(hash_tokens(tokens), RUN))
                    ids.append(i)
                    keys.append(set_key(g))
                    grams.append(g)
                    sketches.append(parity_sketch(g))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(grams, schema.field(2).type), pa.array(sketches, pa.binary())], schema=schema)

    # 25 tokens need at least as many characters, so tiny rows never reach Python
    rows = df.select(F.col(id_col).cast("long"), F.col(code)).where(F.length(code) >= MIN_TOKENS)
    return rows.mapInArrow(run, "id long, key long, grams array<int>, sketch binary")


def radius(n: int, tenths: int = SIMILARITY_TENTHS) -> int:
    """Largest symmetric difference of a set of ``n`` with any set over the threshold."""
    return n * (10 - tenths) // tenths


class BKTree:
    """Nodes are (value, size, key); children by integer Hamming distance to the parent."""

    def __init__(self):
        self.nodes: list[tuple[int, int, int]] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int, size: int, key: int) -> None:
        self.nodes.append((value, size, key))
        self.children.append({})
        new = len(self.nodes) - 1
        at = 0
        while new:
            d = (value ^ self.nodes[at][0]).bit_count()
            step = self.children[at].get(d)
            if step is None:
                self.children[at][d] = new
                return
            at = step

    def within(self, value: int, r: int) -> Iterator[tuple[int, int, int]]:
        """(distance, size, key) of the nodes within ``r``; edges outside [d - r, d + r] aren't followed."""
        stack = [0] if self.nodes else []
        while stack:
            at = stack.pop()
            v, size, key = self.nodes[at]
            d = (value ^ v).bit_count()
            if d <= r:
                yield d, size, key
            kids = self.children[at]
            if kids:
                stack += [c for e, c in kids.items() if d - r <= e <= d + r]


def _shard_pairs(members: list[tuple[int, int, int, int]], tenths: int) -> Iterator[tuple[int, int]]:
    """Pairs of one shard task. members: (side, value, size, key); side 0 fills the tree, side 1 only asks,
    and without any side 1 the members ask each other."""
    tree = BKTree()
    asks = [m for m in members if m[0] == 1]
    fill = [m for m in members if m[0] == 0]
    alone = not asks
    for _, value, n, key in fill:
        if alone:
            yield from _ask(tree, value, n, key, tenths)
        tree.add(value, n, key)
    for _, value, n, key in asks:
        yield from _ask(tree, value, n, key, tenths)


def _ask(tree: BKTree, value: int, n: int, key: int, tenths: int) -> Iterator[tuple[int, int]]:
    for d, m, other in tree.within(value, radius(n, tenths)):
        if d * (10 + tenths) <= (n + m) * (10 - tenths) and n * 10 >= m * tenths and m * 10 >= n * tenths and key != other:
            yield (key, other) if key < other else (other, key)


def class_pairs(prints: DataFrame, tenths: int = SIMILARITY_TENTHS) -> DataFrame:
    """(key_a, key_b), key_a < key_b: distinct run sets with Jaccard >= tenths / 10. ``prints`` must be materialised."""
    posts = prefix_postings(prints, sketch_of(prints), ["key"], tenths, once_per="key")
    # elements that may be hot by the sketch's bound are cut into blocks at once; of the others, where no element has
    # more rows than that bound, one exchange serves the removal of repeats and the count
    mild = posts.where(F.col("most") <= HOT).select("h", "key").repartition("h").dropDuplicates(["h", "key"])
    mild = mild.withColumn("m", F.count("*").over(Window.partitionBy("h"))).where("m > 1")
    hot = posts.where(F.col("most") > HOT).dropDuplicates(["h", "key"]).select("h", "key", F.col("most").alias("m"))
    sketches = prints.groupBy("key").agg(F.first("sketch").alias("sketch"), F.first(F.size("grams")).alias("n"))
    tasks = mild.unionByName(hot).join(sketches, "key")
    # block x of a large shard meets every block y: the lower fills the tree, the higher asks
    blocks = F.ceil(F.col("m") / SHARD_BLOCK).cast("int")
    tasks = tasks.withColumn("x", F.pmod(F.xxhash64("key"), blocks).cast("int")).withColumn("y", F.explode(F.sequence(F.lit(0), blocks - 1)))
    tasks = tasks.select("h", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), (F.col("x") > F.col("y")).cast("int").alias("side"), "n", "key", "sketch")
    tasks = tasks.repartition("h", "i", "j").sortWithinPartitions("h", "i", "j")

    def trees(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, members, out = None, [], ([], [])

        def close() -> None:
            if len(members) > 1:
                for a, b in _shard_pairs(members, tenths):
                    out[0].append(a)
                    out[1].append(b)

        for b in batches:
            for h, i, j, side, n, key, sketch in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (h, i, j) != now:
                    close()
                    now, members = (h, i, j), []
                members.append((side, int.from_bytes(sketch, "big"), n, key))
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["key_a", "key_b"])
                out[0].clear()
                out[1].clear()
        close()
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["key_a", "key_b"])

    candidates = materialize(tasks.mapInArrow(trees, "key_a long, key_b long").distinct(), "code-candidates")
    named = materialize(candidates.select(F.explode(F.array("key_a", "key_b")).alias("key")).distinct(), "code-named")
    sets = keep_keys(prints.select("key", "grams"), named).join(named, "key", "left_semi").groupBy("key").agg(F.first("grams").alias("grams"))
    a = sets.select(F.col("key").alias("key_a"), F.col("grams").alias("ga"))
    b = sets.select(F.col("key").alias("key_b"), F.col("grams").alias("gb"))
    return candidates.join(a, "key_a").join(b, "key_b").where(sizes_allow(F.size("ga"), F.size("gb"), tenths) & similar("ga", "gb", tenths)).select("key_a", "key_b")


def near_duplicate_pairs(df: DataFrame, id_col: str = "id", code: str = "code_content", tenths: int = SIMILARITY_TENTHS) -> DataFrame:
    """(id_a, id_b), id_a < id_b: every pair of rows over the threshold, copies expanded.

    Rows with null, empty or short code (under MIN_TOKENS tokens) give no pair; repeated rows with one
    id give no pair with themselves; an empty table gives an empty result; other columns are left aside.
    """
    prints = materialize(fingerprints(df, id_col, code), "code-prints")
    members = prints.select("id", "key").distinct()
    links = class_pairs(prints, tenths)
    across = links.join(members.select(F.col("key").alias("key_a"), F.col("id").alias("p")), "key_a").join(members.select(F.col("key").alias("key_b"), F.col("id").alias("q")), "key_b")
    within = members.select("key", F.col("id").alias("p")).join(members.select("key", F.col("id").alias("q")), "key").where("p < q")
    return across.select("p", "q").unionByName(within.select("p", "q")).select(F.least("p", "q").alias("id_a"), F.greatest("p", "q").alias("id_b")).where("id_a < id_b")


def near_duplicate_groups(df: DataFrame, id_col: str = "id", code: str = "code_content", tenths: int = SIMILARITY_TENTHS) -> DataFrame:
    """(id, class_id, group_id, links): one row per row with enough tokens.

    class_id is the least id with an equal run set, group_id the least id that can be reached over
    similar pairs, links the number of similar classes. Copies aren't expanded into pairs.
    """
    prints = materialize(fingerprints(df, id_col, code), "code-prints")
    classes = materialize(prints.groupBy("key").agg(F.min("id").alias("class_id")), "code-classes")
    pairs = class_pairs(prints, tenths)
    names = classes.select("key", "class_id")
    edges = pairs.join(names.select(F.col("key").alias("key_a"), F.col("class_id").alias("a")), "key_a").join(names.select(F.col("key").alias("key_b"), F.col("class_id").alias("b")), "key_b").select("a", "b")
    edges = materialize(edges, "code-edges")
    degree = edges.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("links"))
    groups = connected(edges)
    out = prints.select("id", "key").join(names, "key").join(groups.select(F.col("node").alias("class_id"), "root"), "class_id", "left").join(degree, "class_id", "left")
    return out.select("id", "class_id", F.coalesce("root", "class_id").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))


def connected(edges: DataFrame) -> DataFrame:
    """(node, root): least node reachable, by alternating large-star and small-star rounds to a fixed point."""
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = materialize(now, "cc")
    while True:
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(lower.select("u", F.col("m").alias("v"))).distinct()
        after = materialize(small, "cc")
        if after.exceptAll(now).isEmpty() and now.exceptAll(after).isEmpty():
            break
        now = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).groupBy("node").agg(F.min("root").alias("root"))
