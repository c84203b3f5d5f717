from conftest import SMALL, agree, rows

from snipquarry.llm.main_content import classify, main_bodies, main_body, outside_lines
from snipquarry.llm.queries import LINES_SQL
from snipquarry.llm.site_lines import repeated_lines, without_repeated_lines


def test_lines_match_sql(spark, duck):
    agree(repeated_lines(spark.read.parquet(f"{SMALL}/documents.parquet")).select("doc_id", "line_no"), duck, LINES_SQL)


def test_lines_cases(spark):
    legal = "All rights reserved by Example 2020!"
    pages = [(i, "j", f"text number {'abcdefghij'[i]} that is its own line here\n{legal if i < 5 else 'x'}\r\nshort line", "k") for i in range(10)]
    pages += [(20, None, legal, "k"), (21, "j", None, "k"), (22, "e", "", "k"), (23, "j", "ALL RIGHTS reserved, by example 1999", None)]
    d = spark.createDataFrame(pages, "doc_id long, crawl_job_id string, markdown_content string, source string")
    assert rows(repeated_lines(d).select("doc_id", "line_no")) == [(i, 1) for i in range(5)] + [(23, 0)]
    out = {r.doc_id: r for r in without_repeated_lines(d).collect()}
    assert out[0].n_removed == 1 and "rights" not in out[0].cleaned and out[20].cleaned == legal and out[21].cleaned is None
    assert repeated_lines(d.limit(0)).count() == 0 and without_repeated_lines(d.limit(0)).count() == 0


def test_hot_line_in_every_page(spark):
    d = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 = 0, 'hot', concat('j', id % 50)) as crawl_job_id", "concat('the very same legal notice stands here\n', id) as markdown_content")
    assert repeated_lines(d).count() == 3000


PAGE = """We use cookies to measure traffic.
[Accept](#)

[Home](/) / Docs

# The title

By Some Body | Published 2024-01-02

This is the first paragraph of the page, and it says something.

- [name](/n): explains what the name is for.
- [other](/o)

```
Share this page
```

> **Note:** keep me.

Subscribe to the Example newsletter and never miss a release.

### Related articles
* [One](/1)
* [Two](/2)

© 2020 Example Ltd. All rights reserved."""


def test_body():
    body = main_body(PAGE)
    for kept in ("# The title", "first paragraph", "explains what", "Share this page", "keep me"):
        assert kept in body
    for gone in ("cookies", "Accept", "Home", "Published", "[other]", "newsletter", "Related", "[Two]", "©"):
        assert gone not in body


def test_body_cases(spark):
    d = spark.createDataFrame([(1, PAGE, 5), (2, None, 5), (3, "", 5), (4, " \r\n ", 5), (5, "word " * 200_000, 5), (1, PAGE, 5)], "doc_id long, markdown_content string, line_no int")
    got = outside_lines(d)
    assert {r.doc_id for r in got.collect()} == {1}
    assert got.where("doc_id = 1").count() % 2 == 0
    bodies = {r.doc_id: r.body for r in main_bodies(d).collect()}
    assert bodies[2] is None and bodies[3] == "" and len(bodies[5]) == 1_000_000
    assert outside_lines(d.limit(0)).count() == 0
    assert [x.no for x in classify("```\n© 2020\n```")] == [0, 1, 2]


def test_path_ratios_decide(spark):
    """Site matter in wording that no list has, named by its ratio over the site; prose, tables and copies stay."""
    prose = ["The reader keeps every page in memory.", "A socket closes once its owner is gone.", "Old entries move to disk at night.", "Writers wait for the planner to end."]
    foot = "Quokkas {0} and friends look after these leaves with much love and patience"
    page = lambda i: f"# Page {i}\n\n{prose[i % 4]} It has number {i} and the word w{chr(97 + i)}x.\n\n| Key | Use |\n|---|---|\n| k{chr(97 + i)} | {prose[(i + 1) % 4]} w{chr(97 + i)}y |\n\n{foot.format(i)}"
    copied = "# Copied\n\nThis very sentence stands on many copies of one page.\n\nMore of it."
    rows_ = [(i, page(i), "a", None) for i in range(20)] + [(50 + i, copied, "a", None) for i in range(9)] + [(90, foot.format(1), None, None), (91, page(3), "lone", None)]
    d = spark.createDataFrame(rows_, "doc_id long, markdown_content string, crawl_job_id string, upload_job_id string")
    assert rows(outside_lines(d)) == [(i, 8) for i in range(20)]
    hot = d.unionByName(spark.range(1000, 4000).selectExpr("id as doc_id", f"concat('# T', id, '\n\n{prose[0]} ', uuid(), '\n\nQuokkas 1 and friends look after these leaves with much love and patience') as markdown_content", "'b' as crawl_job_id", "cast(null as string) as upload_job_id"))
    assert outside_lines(hot).where("doc_id >= 1000").count() == 3000


def test_cues_of_any_length():
    legal = "Copyright 2020 by Example. " + "All rights reserved in every country of the world and beyond it. " * 9
    talk = "The parser reads cookies. " + "It keeps what it has read until the request ends. " * 9
    assert [x.no for x in classify(f"# T\n\n{talk}\n\n{legal}") if x.out] == [4]
