import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from snipquarry.llm.keyword_spam import _keys, judge, judged, spam_pages
from snipquarry.llm.template_residue import examine, residue_pages

PROSE = "The cache keeps pages in memory until the reader asks for them again. It writes old ones to disk when the limit is reached. "


@pytest.mark.parametrize(
    ("text", "residue", "error"),
    [
        ("# T\n\nDear {{ user.name }}, welcome to the page of today.", True, False),
        ("# T\n\nUse `{{ user.name }}` to insert the name of the user.", False, False),
        ("# T\n\n```\n{{ x }}\n```\n\nText about code.", False, False),
        ("# T\n\nLorem ipsum dolor sit amet, consectetur adipiscing elit sed do.", True, False),
        ("# T\n\nThe filler \"Lorem ipsum dolor sit amet\" is well known to printers everywhere.", False, False),
        ("# T\n\nYour product text goes here. Add two or three sentences about it.", True, False),
        ("# %PAGE_TITLE%\n\nTBD (cache)", True, False),
        ("# 404 Not Found\n\nThe page /x could not be found.", False, True),
        ("# Docs\n\nPlease enable JavaScript to view this site.", False, True),
        ("# Docs\n\nSome features need scripts; <noscript>Please enable JavaScript.</noscript>\n\n" + PROSE * 6, False, False),
        ("# Errors\n\n" + PROSE * 5 + "The server answers with 404 Not Found when the page is gone.", False, False),
        ("# T\n\nSet the path to /users/{id} in the route of the server.", False, False),
        ("", False, False),
    ],
)
def test_examine(text, residue, error):
    got = examine(text)
    assert (got.residue or bool(got.gaps), got.error) == (residue, error)


def test_residue_table(spark):
    bad = "# T\n\n{{ x }}"
    d = spark.createDataFrame([(1, bad, "k"), (1, bad, "k"), (2, None, "k"), (3, "", "k"), (4, PROSE * 2000, None), (5, "# T\n\nDear {{ y }}", "k"), (6, "# T\n\nDear [[NAME]]", "k")], "doc_id long, markdown_content string, kind string").selectExpr("*", "kind as crawl_job_id", "null as upload_job_id")
    # the form of 6 stands with one name only: nothing to align it with, no slot
    assert sorted(r.doc_id for r in residue_pages(d).collect()) == [1, 5]
    assert residue_pages(d.limit(0)).count() == 0


def test_repeated_weak_template(spark):
    weak = lambda i: (i, f"# Hm\n\nedge node {i}abc12\n\nReturn home")
    d = spark.createDataFrame([weak(i) for i in range(4)] + [(9, "# Hm\n\nReturn home soon to a gone world")], "doc_id long, markdown_content string").selectExpr("*", "'j' as crawl_job_id", "null as upload_job_id")
    assert {r.doc_id for r in residue_pages(d).collect()} == {0, 1, 2, 3}


SPAM = [
    "cheap ticket, free bundle, crack driver, cheap ticket, free bundle 2020, crack driver, " * 8,
    "\n".join("http://a%d.example/cheap/x-%d.html" % (i, i) for i in range(20)),
    "\n".join("#cheap_ticket #freebundle #crack_driver #cheapticket" for _ in range(10)),
    "cheap ticket pool is the cheap ticket pool you need. Get cheap ticket pool today with cheap ticket pool! " * 6,
    "Cheap ticket | Free bundle | Crack driver | Cheap ticket\n" * 8,
]
THINGS = "cache reader queue writer index socket planner driver thread bundle".split()
ACTS = "keeps loads drops sorts moves checks holds merges".split()


def prose(n, seed=0):
    rng = random.Random(seed)
    pick = rng.choice
    return " ".join(f"The {pick(THINGS)} {pick(ACTS)} every {pick(THINGS)} {pick(['before', 'after', 'unless', 'while'])} its {pick(THINGS)} {pick(ACTS)} {rng.randrange(99)} {pick(THINGS)}s." for _ in range(n))


GOOD = [
    prose(12),
    prose(6) + "\n" + "\n".join(f"--{THINGS[i]}-{ACTS[i % 8]}: {prose(1, i)}" for i in range(10)),
    "\n".join(f"- Fixed: {prose(1, i)}" for i in range(20)),
    prose(9) + "\n" + "\n".join(f"{a}: {b}" for a, b in zip(THINGS, ACTS, strict=False)),
]


def test_spam(spark):
    none = np.zeros(1, np.uint64), np.ones(1)
    assert judge("", *none)["spam"] is False and judge(None, *none)["n"] == 0
    d = spark.createDataFrame([*((i, t, 1) for i, t in enumerate(SPAM)), *((100 + i, t, 1) for i, t in enumerate(GOOD)), (200, None, 1), (201, "", 1), (202, " ", 1), (0, SPAM[0], 1)], "doc_id long, text string, spam int")
    assert sorted(r.doc_id for r in spam_pages(d).collect()) == [0, 0, 1, 2, 3, 4]
    assert judged(d).count() == 13 and judged(d.limit(0)).count() == 0


def test_counts_are_exact_in_a_large_vocabulary(spark):
    # 3 million distinct pairs, more than a sketch of 2**20 counters holds apart
    line = "alpha beta gamma delta epsilon zeta eta theta"
    rare = spark.range(1500).selectExpr("id + 10 as doc_id", "concat_ws(' ', transform(sequence(1, 2000), i -> concat('w', id, 'x', i))) as text")
    page = f"{line}\n" + "\n".join(f"q{i}a q{i}b q{i}c q{i}d" for i in range(20))
    d = spark.createDataFrame([(1, page), (2, page + " end")], "doc_id long, text string").unionByName(rare)
    total = 88 + 89 + 1500 * 2000
    got = {r.doc_id: r for r in judged(d.repartition(4)).collect()}
    # every word and pair of the page stands once in one other page: one and one more seen, next to none expected
    assert got[1].mean_pmi == pytest.approx(np.log2(2 / (1 + 1 / (total - 88)))) and got[2].mean_pmi == pytest.approx(got[1].mean_pmi * 87 / 88)
    assert got[10].mean_pmi == 0
    assert got[1].link_share == 0


def test_information_decides(spark):
    # the same sentence-free lines: joined by many pages they are terms, joined by one page only they are salad
    rng = random.Random(5)
    phrases = [f"{a} {t}" for a in ("open", "closed", "mixed", "plain") for t in THINGS]
    salad = "\n".join(" ".join(rng.choices([w for p in phrases for w in p.split()], k=6)) for _ in range(12))
    terms = lambda i: "\n".join(rng.choice(phrases) + " " + rng.choice(phrases) for _ in range(12))
    d = spark.createDataFrame([(0, salad), *((i, terms(i)) for i in range(1, 400))], "doc_id long, text string")
    got = {r.doc_id: r.mean_pmi for r in judged(d).collect()}
    assert got[0] < min(v for k, v in got.items() if k)


def test_induced_slots(spark):
    def page(i, owner, greet):
        return i, f"# T{i}\n\nOwner of this page: {owner}\n\n## About\n\nDear {greet}, welcome to the manual of today.\n\nThe cache keeps %name% and <b>x</b> as they are."

    pages = [page(1, "Ann Lee", "reader"), page(2, "Bo Kim", "guest"), page(3, "", "reader"), page(4, "Cy Orr", "[[first_name]]"), page(5, "Di Poe", "%name%"), page(6, "Ed Roe", "")]
    pages.append((7, "# T7\n\nThe following holds:\n\n- Ann Lee\n\nWrite [optional] words."))
    d = spark.createDataFrame(pages, "doc_id long, markdown_content string").selectExpr("*", "'j' as crawl_job_id", "null as upload_job_id")
    assert sorted(tuple(r) for r in residue_pages(d).collect()) == [(i, "residue") for i in (3, 4, 5, 6)]
    # nothing to align with: no slot
    assert residue_pages(d.where("doc_id in (3, 4)")).count() == 0


def test_slots_in_lines_and_values_of_any_length(spark):
    long = " ".join(f"{PROSE.strip()} Part w{chr(97 + i % 26)}{chr(97 + i // 26)} ends here." for i in range(60))
    names = ("Ann Lee", "Bo Kim", "%name%")
    pages = [(i, f"# T{i}\n\n{long} Ask {v} for more.\n\nThe end of page w{i}.") for i, v in enumerate(names, 1)]
    pages += [(10 + i, f"# T{i}\n\nDear {v}, {long}\n\nThe end of page w{i}.") for i, v in enumerate(names, 1)]
    # 20: a blank whose siblings hold more than 81 characters
    values = (PROSE.strip(" .").replace(". ", ", "), "It writes old pages to disk, and the reader asks for them again when the limit of the memory is reached", "")
    pages += [(20 + i, f"# T{i}\n\nSummary of it: {v}\n\n## About\n\n{PROSE}") for i, v in enumerate(values, 1)]
    d = spark.createDataFrame(pages, "doc_id long, markdown_content string").selectExpr("*", "'j' as crawl_job_id", "null as upload_job_id")
    assert len(long) > 8000 and min(map(len, values[:2])) > 81
    assert sorted(tuple(r) for r in residue_pages(d).collect()) == [(i, "residue") for i in (3, 13, 23)]


def test_whole_page_templates(spark):
    stub = lambda i, n: (i, f"# Field {n}\n\nReturns the value of {n} in the table.")
    gone = lambda i, t: (i, f"# {t}\n\nWe retired /how-to/part-{i} some time ago.\n\nRequest id: {i}abc12f0")
    pages = [stub(1, "Alpha"), stub(2, "Beta"), stub(3, "Gamma"), gone(4, "Gone"), gone(5, "The cache"), gone(6, "A reader"), (7, "# Notes\n\nWe retired the old cache some time ago and nobody missed it.")]
    pages += [(100 + i, f"# Part {i}\n\n{PROSE}It has part w{chr(97 + i % 26)}{chr(97 + i // 26)}x.\n\nRead by {i} friends of the library of leaves today") for i in range(50)]
    d = spark.createDataFrame(pages, "doc_id long, markdown_content string").selectExpr("*", "'j' as crawl_job_id", "null as upload_job_id")
    # stubs are templates too, but not of error pages; copies of one error page are no template
    assert sorted(r.doc_id for r in residue_pages(d).collect()) == [4, 5, 6]
    assert residue_pages(d.where("doc_id = 4").unionByName(d.where("doc_id = 4").withColumn("doc_id", F.lit(8).cast("long")))).count() == 0


TRACE = "\n".join(f'  File "/srv/app/part{i}.py", line {i}, in run_part\n    return handlers[{i}](request, context)' for i in range(1, 30))


@pytest.mark.parametrize(
    ("text", "error"),
    [
        ("# 500 Internal Server Error\n\n```\nTraceback (most recent call last):\n" + TRACE + "\nKeyError: 'user'\n```", True),
        ("# 500 Internal Server Error\n\nTraceback (most recent call last):\n" + TRACE + "\nKeyError: 'user'", True),
        ("## Products\n\n[One](/1)\n\n# 404 Not Found\n\nThe page /x could not be found.", True),
        ("# Reading traces\n\n" + PROSE * 20 + "\n\n```\nTraceback (most recent call last):\n" + "\n".join(TRACE.split("\n")[:4]) + "\n```", False),
        ("# Not found\n\nThe lookup says so.\n\n```\nif key not in table:\n    return default_value(key)\n```", False),
        ("# 404 Not Found\n\nWhat it means.\n\n## Causes\n\nA page that is gone.", False),
    ],
)
def test_error_pages_with_traces_and_frames(text, error):
    assert examine(text).error is error


@pytest.mark.parametrize(
    ("text", "spam"),
    [
        ("http://a.example/cheap/x.html\nhttp://b.example/cheap/y.html", True),
        ("#cheap_ticket #freebundle #crack_driver #cheapticket", True),
        ("cheap ticket, free bundle, cheap ticket, free bundle, cheap ticket", True),
        ("The cache keeps every page until the reader asks for it.", False),
        ("Cache and queue\n\nThe queue", False),
        ("asdf asdf test test kernel blah blah blah", False),
    ],
)
def test_short_texts_are_judged(text, spam):
    own = _keys(text)
    keys = np.unique(np.concatenate(([np.uint64(0)], own)))
    counts = np.array([200] + [(own == k).sum() for k in keys[1:]])
    assert judge(text, keys, counts)["spam"] is spam
