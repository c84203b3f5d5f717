from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st

from snipquarry.llm.splitting import split, split_items


def check(text, limit, overlap, kind):
    got = split(text, limit, overlap, kind)
    assert "".join(text[f:e] for _, f, e in got) == text
    for i, (b, f, e) in enumerate(got):
        assert 0 <= f - b <= overlap and e - b <= limit and e > f
        assert i == 0 or f == got[i - 1][2] and b >= got[i - 1][1]
    return got


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .\n\r#`-é́‍", min_size=61, max_size=900), st.sampled_from(["document", "snippet"]))
def test_round_trip(text, kind):
    check(text, 60, 12, kind)


def test_least_pieces_and_boundaries():
    text = "\n\n".join("word " * 18 + "end." for _ in range(12))
    got = check(text, 400, 40, "document")
    assert len(got) == -(-(len(text) - 40) // 360) or len(got) == -(-(len(text) - 40) // 360) + 1
    assert all(text[f - 2 : f] == "\n\n" for _, f, _ in got[1:])
    fenced = "intro\n\n```\n" + "x = 1\n" * 40 + "```\n\n" + "tail sentence here. " * 20
    assert any(fenced[:f].endswith("```\n\n") or fenced[:f].endswith("```\n") for _, f, _ in check(fenced, 400, 20, "document")[1:])


def test_one_line_and_joined_characters():
    check("x" * 10_000, 2000, 100, "snippet")
    got = check("é" * 3000, 2000, 100, "document")
    assert all(("é" * 3000)[f] != "́" for _, f, _ in got[1:])
    check("a\r\n" * 2000, 2000, 100, "snippet")


def test_table(spark):
    d = spark.createDataFrame([(1, "a" * 8000, "x"), (2, "b" * 8001, None), (3, None, "y"), (4, "", "z"), (2, "b" * 8001, None)], "doc_id int, markdown_content string, piece string")
    got = split_items(d, "document", "doc_id", "markdown_content")
    assert rows(got.select("item_id", "piece_no", "n_pieces")) == [(2, 0, 2)] * 2 + [(2, 1, 2)] * 2
    assert split_items(d.limit(0), "document", "doc_id", "markdown_content").count() == 0


def test_late_cuts_keep_words_and_characters():
    from snipquarry.llm.splitting import _late

    for text in ("word " * 500, "e\u0301" * 900, "\u0301" * 700, "x" * 1000, "ab\r\n" * 300):
        got = _late(text, 100, 20)
        assert "".join(text[a:e] for _, a, e in got) == text
        assert all(e - b <= 100 and 0 <= a - b <= 20 and e > a for b, a, e in got)
    assert all(text[a - 1] == " " for text in ["word " * 500] for _, a, _ in _late(text, 100, 20)[1:])
    assert all(text[a] != "\u0301" for text in ["e\u0301" * 900] for _, a, _ in _late(text, 100, 20)[1:])
