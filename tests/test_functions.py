import pytest
from pyspark.sql import functions as F

from snipquarry.functions import clock, noise, similarity, text


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first()["x"]


def value(spark, f, v):
    return one(spark, f(F.col("v")), v=v)


@pytest.mark.parametrize(
    ("f", "given", "wanted"),
    [
        (text.language_name, "PY ", "python"),
        (text.language_name, None, "text"),
        (text.language_name, "", "text"),
        (text.language_name, "cobol", "cobol"),
        (text.language_of_file, "src/App.TSX", "typescript"),
        (text.language_of_file, "Dockerfile", "dockerfile"),
        (text.language_of_file, "noext", None),
        (text.content_type_of, "A/B.MDX", "markdown"),
        (text.content_type_of, "x.py", None),
        (text.is_code_worth_keeping, "a b", False),
        (text.is_code_worth_keeping, "été naïve über", True),
        (text.is_code_worth_keeping, "x\ny", True),
        (text.is_code_worth_keeping, "  \n ", False),
        (text.is_code_worth_keeping, None, False),
        (text.drop_link_lines, "a\n[x](y)\n\n\n\nb", "a\n\nb"),
        (text.unlink_markdown, "see [a](b) and [c][d]", "see a and c"),
        (text.drop_badges, "x https://img.shields.io/a/b y", "x  y"),
        (text.normalize_space, "a   b\n\n\n\n c ", "a b\n\nc"),
        (text.strip_front_matter, "---\na: 1\n---\nbody", "body"),
        (text.strip_front_matter, "body\n---\nx\n---\n", "body\n---\nx\n---\n"),
        (text.domain_of, "HTTPS://A.example:80/x", "a.example:80"),
        (text.domain_of, "https://User@A.Example:80/x", "user@a.example:80"),
        (text.domain_of, "a.example/x", "a.example"),
        (text.domain_of, "nothing", None),
        (text.normalize_url, "http://a/b/#c", "http://a/b/"),
        (text.title_of_url, "upload://n/dir/File.v2.md", "dir/File.v2"),
        (text.title_of_url, "https://a", "Untitled Document"),
        (text.title_of_markdown, "x\n #  T \n", "T"),
        (text.site_name, "Guide | Foo", "Foo"),
        (text.site_name, "Foo v2.1 Documentation", "Foo"),
        (text.repository_of, "git@github.com:a/b.git", "a/b"),
        (text.repository_of, "https://x/y", None),
        (text.snippet_type_of, "configuration", "config"),
        (text.snippet_type_of, None, "code"),
    ],
)
def test_scalar(spark, f, given, wanted):
    assert value(spark, f, given) == wanted


def test_reply_and_prompt(spark):
    r = value(spark, text.parse_reply, "LANGUAGE: go\n TITLE: T\nDESCRIPTION: D d")
    assert (r["language"], r["title"], r["description"]) == ("go", "T", "D d")
    assert value(spark, text.parse_reply, "TITLE: T") is None
    assert one(spark, text.build_prompt("C={context} X={code}", F.col("a"), F.col("b")), a="c" * 600, b="k") == "C=" + "c" * 500 + " X=k"


def test_truncate_and_count(spark):
    long = "a" * 390 + "\n" + "b" * 100
    assert value(spark, lambda c: text.smart_truncate(c, 100), long) == "a" * 390
    assert value(spark, lambda c: text.smart_truncate(c, 100), "a" * 500) == "a" * 400
    assert value(spark, lambda c: text.count_occurrences(c, "Ab"), "abAB ab") == 3
    assert value(spark, lambda c: text.count_occurrences(c, ""), "x") == 0


def test_noise_twins_agree(spark):
    for s in ("a [b](c)  d", "x\nNext\ny", "![i](u) z <!-- c\nd --> e", "home"):
        assert value(spark, text.filter_noise_markdown, s) == noise.filter_noise(s, "markdown")
    assert noise.clean_directives(".. toctree::\n   a\n\nkeep\n.. note:: N\n   body") == "keep\nN\nbody"


@pytest.mark.parametrize(("a", "b", "wanted"), [("abc", "abc", 1.0), ("abc", "xyz", 0.0), ("", "", 0.0), (None, "a", 0.0), ("a", "A", 1.0), ("foo-bar", "foo bar", 1.0)])
def test_similarity(spark, a, b, wanted):
    assert one(spark, similarity.similarity(F.col("a"), F.col("b")), a=a, b=b) == wanted


def test_query_match(spark):
    assert similarity.query_tokens("Foo_bar foo") == ["foo", "bar"]
    assert one(spark, similarity.matches([F.col("a"), F.col("b")], "x y"), a="x", b="Y z") is True
    assert one(spark, similarity.matches([F.col("a")], ""), a="x") is False


@pytest.mark.parametrize(("age", "label"), [(0, "Today"), (86400, "Yesterday"), (6 * 86400, "6 days ago"), (7 * 86400, "1 week ago"), (29 * 86400, "4 weeks ago"), (30 * 86400, "05/21/2025")])
def test_relative(spark, age, label):
    ts = F.lit("2025-06-20 00:00:00").cast("timestamp_ntz") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(age))
    assert one(spark, clock.relative_label(ts, clock.at("2025-06-20 00:00:00")), v="") == label


@pytest.mark.parametrize(("age", "wanted"), [(30, "healthy"), (31, "warning"), (60, "warning"), (61, "stalled")])
def test_health(spark, age, wanted):
    ts = clock.at("2025-01-01 00:00:00") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(age))
    assert one(spark, clock.health(ts, clock.at("2025-01-01 00:00:00")), v="") == wanted


def test_percent(spark):
    p = lambda d, t: one(spark, clock.percent(F.lit(d), F.lit(t)), v="")
    assert (p(1, 8), p(3, 8), p(5, 0), p(9, 3)) == (12, 38, 0, 100)
