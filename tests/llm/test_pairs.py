import random

import numpy as np
import pytest
from conftest import SMALL, agree, rows
from pyspark.sql import functions as F

from snipquarry.llm import queries
from snipquarry.llm.batch_dedup import address, new_batch_duplicates, winnow
from snipquarry.llm.code_neardup import BKTree, near_duplicate_groups, near_duplicate_pairs, parity_sketch, radius
from snipquarry.llm.common import hash_tokens, runs, words
from snipquarry.llm.eval_leak import leaks
from snipquarry.llm.sets import to_grams


@pytest.mark.parametrize("name", ["p2_found", "p4_found", "p6_found", "p8_found"])
def test_sql(spark, duck, name):
    agree(getattr(queries, name)(spark, SMALL), duck, queries.llm_oracle_sql()[name])


def code(rng, n=60):
    return " ".join(rng.choice(["alpha", "beta", "x", "y", "(", ")", "=", "call", "ret", str(rng.randrange(99))]) for _ in range(n))


def brute(rows_, least=25, k=4):
    import re

    sets = {}
    for i, t in rows_:
        tok = re.findall(r"\w+|[^\w\s]", t or "")
        if len(tok) >= least:
            sets[i] = {tuple(tok[j : j + k]) for j in range(len(tok) - k + 1)}
    ids = sorted(sets)
    return [(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if 10 * len(sets[a] & sets[b]) >= 7 * len(sets[a] | sets[b])]


def test_code_against_brute_force(spark):
    rng = random.Random(1)
    data = []
    for f in range(12):
        base = code(rng).split()
        for v in range(5):
            t = base[:]
            for _ in range(v):
                t[rng.randrange(len(t))] = "new"
            data.append((f * 10 + v, " ".join(t[30:] + t[:30] if v == 4 else t)))
    data += [(900, None), (901, ""), (902, "too short"), (903, "z " * 50_000), (904, "z " * 50_000)]
    d = spark.createDataFrame([(*r, "k") for r in data], "id long, code_content string, key string")
    want = brute(data)
    assert rows(near_duplicate_pairs(d)) == want
    assert near_duplicate_pairs(d.limit(0)).count() == 0
    g = {r.id: r for r in near_duplicate_groups(d).collect()}
    parent = {i: i for i in g}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in want:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    assert {i: r.group_id for i, r in g.items()} == {i: root(i) for i in g}


def test_hot_copies(spark):
    same = code(random.Random(3))
    d = spark.range(400).select("id", F.when(F.col("id") % 3 == 0, same).otherwise(F.concat(F.lit(same + " tail "), F.col("id").cast("string"))).alias("code_content"))
    g = near_duplicate_groups(d)
    assert g.count() == 400 and g.where("group_id <> 0").count() == 0


def test_large_shards_are_cut(spark, monkeypatch):
    from snipquarry.llm import code_neardup

    monkeypatch.setattr(code_neardup, "SHARD_BLOCK", 3)
    rng = random.Random(5)
    base = code(rng, 80)
    data = [(i, base + f" v{i}") for i in range(20)]
    d = spark.createDataFrame(data, "id long, code_content string")
    assert rows(near_duplicate_pairs(d)) == brute(data)


def test_tree_and_bounds():
    rng = random.Random(2)
    values = [rng.getrandbits(64) for _ in range(200)]
    t = BKTree()
    for i, v in enumerate(values):
        t.add(v, 1, i)
    q = values[7] ^ 0b1011
    assert sorted(k for _, _, k in t.within(q, 20)) == [i for i, v in enumerate(values) if (v ^ q).bit_count() <= 20]
    a, b = (to_grams(np.array([rng.getrandbits(64) for _ in range(150)], dtype=np.uint64)) for _ in range(2))
    d = (int.from_bytes(parity_sketch(a), "big") ^ int.from_bytes(parity_sketch(b), "big")).bit_count()
    assert d <= len(set(a) ^ set(b)) and radius(70) == 30


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("http://A.Example:80/x/", "https://a.example/x", True),
        ("https://a/x?b=2&a=1#f", "https://a/x?a=1&b=2&utm_source=q&sessionid=1&ref=z", True),
        ("https://a/g%2Dh", "https://a/g-h", True),
        ("https://a/x?page=1", "https://a/x?page=2", False),
        ("https://a/X", "https://a/x", False),
        ("upload://n/a.md", "upload://n/b.md", False),
    ],
)
def test_address(a, b, same):
    assert (address(a) == address(b)) is same


def test_winnow_marks_shared_stretches():
    rng = random.Random(4)
    shared = [f"w{rng.randrange(10**6)}" for _ in range(17)]
    for _ in range(50):
        a = [f"a{rng.randrange(10**6)}" for _ in range(30)] + shared
        b = shared + [f"b{rng.randrange(10**6)}" for _ in range(40)]
        assert set(winnow(hash_tokens(a))) & set(winnow(hash_tokens(b)))
    assert len(winnow(hash_tokens(["a"] * 3))) == 0


COLUMNS = "doc_id long, batch_no int, url string, content_hash string, text string, k string"


def pages_truth(data):
    seen, out = [], set()
    for i, b, u, h, t, _ in sorted(data, key=lambda r: (r[1] or 0, r[0])):
        w = words(t)
        s = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 50 else None
        a, c = address(u), h.strip().lower() if h and h.strip() else None
        for i2, a2, c2, s2 in seen:
            if i2 != i and (a and a == a2 or c and c == c2 or s and s2 and 10 * len(s & s2) >= 7 * len(s | s2)) and (b or 0) > 0:
                out.add(i)
        seen.append((i, a, c, s))
    return out


def test_batches_against_brute_force(spark):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(400)]
    data, i = [], 0
    bases = [[rng.choice(vocabulary) for _ in range(rng.choice([50, 60, 150, 400]))] for _ in range(25)]
    for n in range(160):
        w = rng.choice(bases)[:]
        for _ in range(rng.choice([0, 1, 2, 3, 6])):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        if rng.random() < 0.2:
            w = w[len(w) // 2 :] + w[: len(w) // 2]
        data.append((n, rng.choice([0, 0, 1, 2, 3, None]), f"https://h.example/{n}", None, " ".join(w), "x"))
    data += [(500, 1, None, " ", None, "x"), (501, 2, "", "", "", "x"), (502, 2, "https://h.example/3/", "A", "t", "x"), (503, 3, "u", "a", "s", "x"), (504, 1, "v", None, "same " * 60, "x"), (505, 3, "w", None, "same " * 90, "x")]
    d = spark.createDataFrame(data, COLUMNS)
    got = {r.doc_id for r in new_batch_duplicates(d).select("doc_id").collect()}
    assert got == pages_truth(data)
    assert new_batch_duplicates(d.limit(0)).count() == 0


def test_passage_of_a_third(spark, monkeypatch):
    """A licence in very many pages: pages alike only by it aren't found, true near copies are."""
    from snipquarry.llm import batch_dedup

    monkeypatch.setattr(batch_dedup, "FIRST_HOLDERS", 2)
    rng = random.Random(8)
    licence = " ".join(f"l{i}" for i in range(60))
    own = lambda n: " ".join(f"w{rng.randrange(10**7)}" for _ in range(n))
    data = [(i, i % 3, f"https://h/{i}", None, licence + " " + own(120), "x") for i in range(40)]
    tail = own(20)
    data += [(100 + i, 2, f"https://h/{100 + i}", None, licence + f" n{i} " + tail, "x") for i in range(6)]
    d = spark.createDataFrame(data, COLUMNS)
    assert {r.doc_id for r in new_batch_duplicates(d).select("doc_id").collect()} == pages_truth(data) == set(range(101, 106))


def test_history_is_opened_again(spark, tmp_path):
    """Batches that arrive one by one in a reopened folder find what one run over all of them finds."""
    from snipquarry.llm.batch_dedup import History

    rng = random.Random(11)
    bases = [[f"w{rng.randrange(900)}" for _ in range(rng.choice([60, 150]))] for _ in range(12)]
    data = []
    for n in range(90):
        w = rng.choice(bases)[:]
        for _ in range(rng.choice([0, 1, 2, 3])):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        data.append((n, n // 13, f"https://h.example/{n % 80}", None, "\n".join(" ".join(w[i : i + 25]) for i in range(0, len(w), 25)), "x"))
    d = spark.createDataFrame(data, COLUMNS)
    path, found = "file://" + str(tmp_path / "history"), set()
    first = History(spark, path, buckets=3)
    first.start(d.where("batch_no = 0"))
    first.add(first.hashes(d.where("batch_no = 0")), check=False)
    first.close()
    for b in range(1, 7):
        again = History(spark, path)
        assert again.buckets == 3 and again._table("keys").count() > 0
        found |= {r.doc_id for r in again.add(again.hashes(d.where(f"batch_no = {b}"))).collect()}
        again.close()
    assert found == pages_truth(data) == {r.doc_id for r in new_batch_duplicates(d).collect()}
    assert not spark.sql("show tables like 'history_*'").collect()


def test_repeating_texts_meet_by_prefixes(spark):
    """Texts of few words in changing order share no long stretch; they are found all the same."""
    rng = random.Random(3)
    data = []
    for n in range(30):
        w = [rng.choice("ab") for _ in range(300)]
        data.append((n, n % 3, f"https://h/{n}", None, " ".join(w), "x"))
    d = spark.createDataFrame(data, COLUMNS)
    assert {r.doc_id for r in new_batch_duplicates(d).select("doc_id").collect()} == pages_truth(data)


def test_sketch_is_summed_in_a_tree(spark):
    from snipquarry.llm.common import count_sketch

    d = spark.range(0, 20_000, 1, 2000)
    slots = lambda b: b.column(0).to_numpy() % 64
    assert (count_sketch(d, slots, 8, fan_in=50)[:64].sum(), count_sketch(d, slots, 8)[:64].min()) == (20_000, 312)


def test_leaks(spark):
    long = " ".join(f"t{i}" for i in range(30))
    docs = spark.createDataFrame([(1, "x " + " ".join(f"T{i}," for i in range(5, 15)) + " y", 0), (2, " ".join(f"t{i}" for i in range(5, 14)), 0), (3, "what IS this", 0), (4, None, 0), (5, "", 0), (6, "a " * 100_000 + long, 0), (1, "z", 0)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(1, long), (2, "What is this?"), (3, None), (4, "  "), (2, "What is this?")], "item_id long, text string")
    assert rows(leaks(docs, items)) == [(1, 1), (3, 2), (6, 1)]
    assert leaks(docs.limit(0), items).count() == 0 and leaks(docs, items.limit(0)).count() == 0


def test_leaks_in_blocks(spark, monkeypatch):
    from snipquarry.llm import eval_leak

    docs, items = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/eval_items.parquet")
    whole = rows(leaks(docs, items))
    monkeypatch.setattr(eval_leak, "BLOCK_CHARS", 20_000)
    assert rows(leaks(docs, items)) == whole


def test_runs():
    h = hash_tokens(["a", "b", "a", "b", "a"])
    assert runs(h, 2)[0] == runs(h, 2)[2] != runs(h, 2)[1] and len(runs(h, 6)) == 0
