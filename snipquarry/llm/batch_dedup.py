"""Deduplicating new batches against all history, without working through the history anew.

Method: every accepted page leaves hashes in tables bucketed by hash: exact keys (normalised address, content
hash, text), paragraph hashes with their words, and passage hashes, with their holders. A new batch brings only
its own hashes; bucket-local joins find full copies, shared-paragraph coverage and shared passages, an exact
Jaccard test settles the pairs, and the batch's hashes are appended. Paragraphs alone would miss pages edited
in every paragraph, so passages are hashed too: winnowed runs of eight words. Two texts over the threshold
share s runs of five words and differ in at most 0.43 s; a break between shared stretches costs at least
eight, so some stretch holds 13 runs, that is 17 words, and winnowing marks every shared stretch of 17 words
alike in both. That argument counts distinct runs, so texts that repeat theirs also go the second way, as do
texts with a passage that more than sixteen texts of a batch hold: an exact join on rarest-first run prefixes.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, scratch_path
from .common import SKETCH_BITS, count_sketch, hash_tokens, runs, words
from .sets import SIMILARITY_TENTHS, keep_keys, prefix_postings, set_key, similar, sizes_allow, sketch_of, to_grams

RUN = 5
MIN_WORDS = 50
#: Words of a passage, and passages among which the least hash is kept.
PASSAGE, WINDOW = 8, 10
#: Holders of one mark that a batch keeps (the least key of each of as many parts); texts beyond post prefixes too.
FIRST_HOLDERS = 16
#: A text with fewer distinct five-word runs than this part of its runs repeats itself.
REPEATS = 0.8

#: Counters of the sketch that orders passages: 4 MiB, whatever the data.
ORDER_BITS = 20


def passage_order(df: DataFrame, text: str) -> np.ndarray:
    """Counts of passages in the accepted history; fixed from then on, so that marks never change."""

    def slots(b: pa.RecordBatch) -> np.ndarray:
        found = [runs(hash_tokens(words(t)), PASSAGE) >> np.uint64(64 - ORDER_BITS) for t in b.column(0).to_pylist() if t]
        return np.concatenate(found).astype(np.int64) if found else np.empty(0, dtype=np.int64)

    return count_sketch(df.select(text), slots, ORDER_BITS)


def winnow(hashes: np.ndarray, order: np.ndarray | None = None) -> np.ndarray:
    """Marks of a text's passages: of every WINDOW consecutive runs of PASSAGE words the rarest by ``order``,
    then the one of least hash. Any fixed order marks a shared stretch alike in both texts; a rare-first
    one passes over wording that very many pages share."""
    r = runs(hashes, PASSAGE)
    if not len(r):
        return r
    place = r >> np.uint64(20)
    if order is not None:
        rarity = np.minimum(order[(r >> np.uint64(64 - ORDER_BITS)).astype(np.int64)], (1 << 20) - 1)
        place = rarity.astype(np.uint64) << np.uint64(44) | place
    if len(r) <= WINDOW:
        return r[[place.argmin()]]
    windows = np.lib.stride_tricks.sliding_window_view(place, WINDOW)
    return np.unique(r[windows.argmin(axis=1) + np.arange(len(windows))])


# Query parameters that only follow the visitor.
TRACKING = frozenset(
    "ref referrer referer ref_src source_ref session sessionid session_id sid jsessionid phpsessid aspsessionid cfid cftoken gclid gclsrc dclid fbclid msclkid yclid twclid igshid mc_cid mc_eid _ga _gl _hsenc _hsmi campaign campaign_id cmpid affiliate aff_id trk wt_mc icid".split()
)
_TRACKING_PREFIX = ("utm_", "mtm_", "pk_")
_ESCAPE = re.compile(r"%([0-9A-Fa-f]{2})")
_SESSION_PART = re.compile(r";(?:jsessionid|phpsessid|sid)=[^/?#;]*", re.IGNORECASE)


def _unescape(m: re.Match) -> str:
    c = chr(int(m[1], 16))
    return c if c.isascii() and (c.isalnum() or c in "-._~") else m[0].upper()


def address(url: str | None) -> str | None:
    """The comparison form of an address: equal for addresses that lead to one page."""
    if not url or not url.strip():
        return None
    url = _ESCAPE.sub(_unescape, url.strip().split("#", 1)[0])
    scheme, sep, rest = url.partition("://")
    if not sep:
        return url
    scheme = scheme.lower()
    rest, _, query = rest.partition("?")
    host, slash, path = rest.partition("/")
    host = host.lower()
    if scheme in ("http", "https"):
        for own, port in (("http", ":80"), ("https", ":443")):
            if scheme == own and host.endswith(port):
                host = host[: -len(port)]
        scheme = "http"
    kept = sorted(p for p in query.split("&") if p and not ((name := p.split("=", 1)[0].lower()) in TRACKING or name.startswith(_TRACKING_PREFIX)))
    path = _SESSION_PART.sub("", path).rstrip("/")
    return f"{scheme}://{host}/{path}" + ("?" + "&".join(kept) if kept else "")


def _h(s: str) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(s)).astype(np.int64))


_LONGS = pa.list_(pa.field("element", pa.int64()))
_INTS = pa.list_(pa.field("element", pa.int32()))
_PAGE = pa.schema(
    [("doc_id", pa.int64()), ("batch_no", pa.int32()), ("exact", _LONGS), ("key", pa.int64()), ("n", pa.int32()), ("words", pa.int32()), ("repeats", pa.bool_()), ("grams", _INTS), ("marks", _LONGS), ("paragraphs", _LONGS), ("weights", _INTS), ("sketch", _LONGS)]
)
_PAGE_DDL = "doc_id long, batch_no int, exact array<bigint>, key long, n int, words int, repeats boolean, grams array<int>, marks array<bigint>, paragraphs array<bigint>, weights array<int>, sketch array<bigint>"
#: Bits of a page's parity sketch; see ``parity``.
BITS = 1024


def parity(grams: np.ndarray) -> np.ndarray:
    """Each run flips one of BITS bits: two sketches never differ in more bits than the sets in elements."""
    bits = np.bincount((grams.view(np.uint32) * np.uint32(0x9E3779B1)) >> np.uint32(32 - 10), minlength=BITS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def page_hashes(df: DataFrame, doc: str = "doc_id", batch: str = "batch_no", url: str = "url", content_hash: str = "content_hash", text: str = "text", order: np.ndarray | None = None) -> DataFrame:
    """One row of hashes per page; ``exact`` holds those of the address and the content hash, ``key`` and
    ``grams`` are null for texts under MIN_WORDS words."""

    shared = df.sparkSession.sparkContext.broadcast(order)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = shared.value
        for b in batches:
            out: dict[str, list] = {f.name: [] for f in list(_PAGE)[2:]}
            for u, c, t in zip(*(b.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                own = []
                if (a := address(u)) is not None:
                    own.append(_h("a:" + a))
                if c and c.strip():
                    own.append(_h("c:" + c.strip().lower()))
                out["exact"].append(own)
                parts = [hash_tokens(w) for p in t.split("\n") if (w := words(p))] if t else []
                n_words = sum(map(len, parts))
                if n_words < MIN_WORDS:
                    for name, column in out.items():
                        if name != "exact":
                            column.append([] if name in ("marks", "paragraphs", "weights") else None)
                    continue
                whole = np.concatenate(parts)
                g = to_grams(runs(whole, RUN))
                held = dict(sorted((xxhash.xxh3_64_intdigest(x.tobytes()), len(x)) for x in parts))
                found = (set_key(g), len(g), n_words, len(g) < REPEATS * (n_words - RUN + 1), g, winnow(whole, order).view(np.int64), np.array(list(held), dtype=np.uint64).view(np.int64), list(held.values()), parity(g))
                for name, value in zip(("key", "n", "words", "repeats", "grams", "marks", "paragraphs", "weights", "sketch"), found, strict=True):
                    out[name].append(value)
            columns = [b.column(0).cast(pa.int64()), b.column(1).cast(pa.int32())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(out[f.name], type=f.type) for f in list(_PAGE)[2:]], schema=_PAGE)

    rows = df.select(F.col(doc), F.coalesce(F.col(batch), F.lit(0)), F.col(url), F.col(content_hash), F.col(text))
    return rows.mapInArrow(run, _PAGE_DDL)


def _heads(texts: DataFrame) -> DataFrame:
    """(h, part, key, m, w): the marks (w null) and paragraphs (w words) of texts, grouped by each task.

    A passage keeps the least key of each of FIRST_HOLDERS parts. Of a paragraph the least holder is kept (part
    -1), as common ones only add to a pair's coverage. m is the number of holders.
    """
    schema = pa.schema([("h", pa.int64()), ("part", pa.int32()), ("key", pa.int64()), ("m", pa.int64()), ("w", pa.int32())])
    parts = FIRST_HOLDERS

    def flat(column: pa.Array, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        offsets = column.offsets.to_numpy()
        return column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], np.repeat(keys, np.diff(offsets))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def grouped() -> pa.RecordBatch:
            h, part, key, w = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((key, part, h))
            h, part, key, w = h[order], part[order], key[order], w[order]
            first = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (part[1:] != part[:-1]))))
            m = np.diff(np.append(first, len(h)))
            return pa.RecordBatch.from_arrays([pa.array(h[first]), pa.array(part[first], pa.int32()), pa.array(key[first]), pa.array(m, pa.int64()), pa.array(w[first], pa.int32(), mask=w[first] < 0)], schema=schema)

        held: list[tuple[np.ndarray, ...]] = []
        n = 0
        for b in batches:
            keys = b.column(0).to_numpy()
            h, k = flat(b.column(1), keys)
            held.append((h, ((k.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % parts, k, np.full(len(h), -1)))
            n += len(h)
            h, k = flat(b.column(2), keys)
            held.append((h, np.full(len(h), -1), k, flat(b.column(3), keys)[0].astype(np.int64)))
            n += len(h)
            if n >= FLUSH:
                yield grouped()
                held, n = [], 0
        if n:
            yield grouped()

    return texts.select("key", "marks", "paragraphs", "weights").mapInArrow(run, "h long, part int, key long, m long, w int")


#: Tables of a history: columns, and what they are bucketed by.
_TABLES = {
    "keys": ("k bigint", "k"),
    "posts": ("h bigint, key bigint, w int", "h"),
    "crowded": ("h bigint", "h"),
    "prefixes": ("h int, key bigint", "h"),
    "texts": ("key bigint, batch_no int, doc_id bigint, n int, words int, sketch array<bigint>", "key"),
    "sets": ("key bigint, grams array<int>", None),
}
#: Postings that a task groups before it sends them on.
FLUSH = 500_000


class History:
    """The bucketed hash tables of all accepted pages, in one folder that can be opened again.

    ``keys`` holds every exact key once. ``posts`` holds paragraphs (w words) with one holder and passages
    (w null) with up to FIRST_HOLDERS holders of each batch; ``crowded`` the passages that had more, and ``prefixes`` the run
    prefixes of the texts that hold these. ``texts`` holds every distinct text once, under the page that first
    had it. All are bucketed by what they are joined on, so appending shuffles the batch only and joining
    shuffles nothing of the history. ``add`` isn't atomic: after a failed one the folder's copy has to be used.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None, tenths: int = SIMILARITY_TENTHS):
        self.spark, self.path = spark, path or scratch_path(spark, "history")
        self.name = "history_" + xxhash.xxh3_64_hexdigest(self.path)
        try:
            about = spark.read.parquet(f"{self.path}/about").first()
        except AnalysisException:
            about = None
        if about is None:
            self.buckets, self.tenths, self.order, self.rarity = buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), tenths, None, None
        else:
            self.buckets, self.tenths = about["buckets"], about["tenths"]
            self.order, self.rarity = (np.frombuffer(about[c], dtype=np.uint32) for c in ("passages", "runs"))
        for table, (columns, by) in _TABLES.items():
            spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name}_{table} ({columns}) USING parquet OPTIONS (compression 'zstd') {f'CLUSTERED BY ({by}) INTO {self.buckets} BUCKETS' if by else ''} LOCATION '{self.path}/{table}'")

    def close(self) -> None:
        """Forget the tables' names; the folder stays."""
        for table in _TABLES:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{table}")

    def start(self, df: DataFrame, **columns: str) -> None:
        """Fix the orders of passages and runs by a first set of pages, and store them; no order changes a result."""
        text = columns.get("text", "text")
        self.order = passage_order(df, text)

        def slots(b: pa.RecordBatch) -> np.ndarray:
            found = [runs(hash_tokens(words(t)), RUN) >> np.uint64(64 - SKETCH_BITS) for t in b.column(0).to_pylist() if t]
            return np.concatenate(found).astype(np.int64) if found else np.empty(0, dtype=np.int64)

        self.rarity = count_sketch(df.select(text), slots)
        about = [(self.buckets, self.tenths, bytearray(self.order.tobytes()), bytearray(self.rarity.tobytes()))]
        self.spark.createDataFrame(about, "buckets int, tenths int, passages binary, runs binary").coalesce(1).write.parquet(f"{self.path}/about")

    def hashes(self, df: DataFrame, **columns: str) -> DataFrame:
        """The hash rows of pages, stored: what ``add`` takes."""
        return materialize(page_hashes(df, **columns, order=self.order), "pages")

    def _append(self, table: str, df: DataFrame) -> None:
        """One task and so one file per bucket."""
        columns, by = _TABLES[table]
        (df.repartition(self.buckets, by) if by else df).select([c.split()[0] for c in columns.split(", ")]).write.mode("append").insertInto(f"{self.name}_{table}")

    def _table(self, table: str) -> DataFrame:
        return self.spark.table(f"{self.name}_{table}")

    def add(self, pages: DataFrame, check: bool = True) -> DataFrame | None:
        """Append pages of ``hashes`` and hold them against what was added before or stands earlier among them
        (by batch number, then id). Gives (doc_id, reason, coverage) of those that bring nothing new, see
        ``new_batch_duplicates``.
        """
        at = F.struct("batch_no", "doc_id")
        # exact keys: a batch's copies are counted before they meet the history, so no key is hot
        keys = pages.select("doc_id", at.alias("at"), F.explode("exact").alias("k")).unionByName(pages.where("key is not null").select("doc_id", at.alias("at"), F.col("key").alias("k")))
        firsts = keys.groupBy("k").agg(F.min("at").alias("first"), F.count("*").alias("m"))
        held = firsts.join(self._table("keys").withColumn("old", F.lit(True)), "k", "left").withColumn("old", F.coalesce("old", F.lit(False)))
        held = materialize(held, "firsts")
        self._append("keys", held.where("not old"))
        # known keys: held before, or more than once in this batch
        copies = materialize(keys.join(held.where("old or m > 1"), "k").where("old or at > first").select("doc_id", "k").distinct(), "copies")
        # only the first page of each text posts its marks: whatever is like a copy is like the original
        texts = pages.where("key is not null").join(copies.withColumnRenamed("k", "key"), ["doc_id", "key"], "left_anti")
        texts = materialize(texts.drop("exact"), "texts")
        self._append("texts", texts)
        self._append("sets", texts)
        marks = texts.select("key", F.explode("marks").alias("h"), F.lit(None).cast("int").alias("w"))
        # grouped by each task before they are sent on, so no passage is hot
        heads = _heads(texts).repartition(self.buckets, "h").groupBy("h", "part").agg(F.min("key").alias("key"), F.sum("m").alias("m"), F.max("w").alias("w"))
        heads = materialize(heads, "heads")
        self._append("posts", heads)
        full = materialize(heads.where("m > 1 and w is null").select("h").distinct(), "crowded")
        self._append("crowded", full)
        crowd = keep_keys(marks.select("key", "h"), full, "h").join(full, "h", "left_semi").select("key").unionByName(texts.where("repeats").select("key")).distinct()
        self._append("prefixes", self._prefixes(texts.join(crowd, "key", "left_semi")))
        if not check:
            return None
        found = copies.select("doc_id").distinct().select("doc_id", F.lit("copy").alias("reason"), F.lit(1.0).alias("coverage"))
        open_ = texts.join(copies.select("doc_id").distinct(), "doc_id", "left_anti")
        mine = open_.select("key", F.explode("marks").alias("h")).unionByName(open_.select("key", F.explode("paragraphs").alias("h"))).withColumnRenamed("key", "mine")
        pairs = mine.join(self._table("posts"), "h").where("mine <> key").groupBy("mine", "key").agg(F.coalesce(F.sum("w"), F.lit(0)).alias("shared"))
        near = materialize(self._settle(materialize(pairs, "pairs")), "near")
        # the second way: prefixes of texts that repeat themselves or hold a passage that was crowded at some time
        asks = open_.join(near.select("doc_id"), "doc_id", "left_anti")
        crowded = asks.select("key", F.explode("marks").alias("h")).join(self._table("crowded"), "h", "left_semi").select("key")
        asks = asks.join(crowded.unionByName(asks.where("repeats").select("key")).distinct(), "key", "left_semi")
        more = self._prefixes(asks).withColumnRenamed("key", "mine").join(self._table("prefixes"), "h").where("mine <> key").select("mine", "key").distinct()
        late = self._settle(materialize(more.withColumn("shared", F.lit(0).cast("long")), "pairs"))
        near = near.unionByName(late).groupBy("doc_id").agg(F.max("coverage").alias("coverage"))
        return found.unionByName(near.select("doc_id", F.lit("near").alias("reason"), "coverage"))

    def _prefixes(self, texts: DataFrame) -> DataFrame:
        return prefix_postings(texts.select("key", "grams"), self.rarity, ["key"], self.tenths).drop("most")

    def _settle(self, pairs: DataFrame) -> DataFrame:
        """(doc_id, coverage) of the texts in ``mine`` with an earlier text alike: pairs pass the bounds on size, order
        and parity sketch, then the exact test. Coverage is the part of the words in paragraphs that this text is the holder of."""
        about = self._table("texts").select("key", F.struct("batch_no", "doc_id").alias("at"), "n", "words", "sketch")
        own = about.select(F.col("key").alias("mine"), F.col("at").alias("my_at"), F.col("n").alias("my_n"), F.col("words").alias("my_words"), F.col("sketch").alias("my_sketch"))
        differ = F.aggregate(F.zip_with("sketch", "my_sketch", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda a, x: a + x)
        t = self.tenths
        both = pairs.join(about, "key").join(own, "mine").where((F.col("at") < F.col("my_at")) & sizes_allow(F.col("n"), F.col("my_n"), t) & (differ * (10 + t) <= (F.col("n") + F.col("my_n")) * (10 - t)))
        left = materialize(both.select("mine", "key", F.col("my_at.doc_id").alias("doc_id"), F.least(F.col("shared") / F.col("my_words"), F.lit(1.0)).alias("coverage")), "open")
        named = materialize(left.select(F.explode(F.array("mine", "key")).alias("key")).distinct(), "named")
        sets = materialize(keep_keys(self._table("sets"), named).join(named, "key", "left_semi"), "sets")
        tested = left.join(sets.withColumnRenamed("grams", "g"), "key").join(sets.withColumnRenamed("key", "mine"), "mine").where(similar("g", "grams", t))
        return tested.groupBy("doc_id").agg(F.max("coverage").alias("coverage"))


def new_batch_duplicates(df: DataFrame, history_batch: int = 0, **columns: str) -> DataFrame:
    """(doc_id, reason, coverage): pages of batches after ``history_batch`` for which an earlier page has the same
    address, the same content hash, or a text alike (five-word runs, Jaccard of at least 0.7). A page may come
    with both reasons; coverage is the part of its words in paragraphs that are kept for the text that is alike, 1 for copies.

    Null or blank addresses and hashes equal nothing; null, empty and short texts are alike to nothing; a
    null batch number counts as history; of repeated rows with one doc_id none is earlier than the other;
    an empty table gives an empty result; other columns are left aside.
    """
    batch = F.coalesce(F.col(columns.get("batch", "batch_no")), F.lit(0))
    history = History(df.sparkSession)
    past = df.where(batch <= history_batch)
    history.start(past, **columns)
    history.add(history.hashes(past, **columns), check=False)
    # the later batches come in one step: what is earlier among them goes by batch number and id
    found = materialize(history.add(history.hashes(df.where(batch > history_batch), **columns)), "duplicates")
    history.close()
    return found
