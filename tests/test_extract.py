from snipquarry.functions.parsers import html_blocks, markdown_blocks, parser_for, rst_blocks, rst_title
from snipquarry.operators.extract import extract, register


def test_markdown_fences():
    b = list(markdown_blocks("```c++ x\nint a;\nint b;\n``` tail\n\n~~~\n```\nz\n~~~\n\n```\nopen\nend"))
    assert [(x.language, x.code) for x in b] == [("c", "int a;\nint b;"), (None, "```\nz"), (None, "open\nend")]
    assert (b[2].line_start, b[2].line_end) == (11, 13)


def test_markdown_headings_and_context():
    t = "---\nx: 1\n---\nMain\n====\n\nfirst [l](u)\n\n```\na\nb\n```\n\n1. second\n\n\tone two three\n\n## Sub\n> quoted\n\n```py\nc\nd\n```"
    b = list(markdown_blocks(t))
    assert [x.title for x in b] == ["Main", "Main", "Sub | Main"]
    assert [x.description for x in b] == ["first l", "second", "quoted"]


def test_markdown_skips_tiny_and_blank():
    assert not list(markdown_blocks("```\nx\n```\n\n```\n\n```\ntext"))
    assert not list(markdown_blocks(""))


def test_rst():
    t = "=====\nTitle\n=====\n\n.. note::\n   Kept :func:`body`.\n\n.. code-block:: py\n   :linenos:\n\n   a\n\n     b\n\nPart\n----\n\nSo::\n\n    x\n    y\n"
    b = list(rst_blocks(t))
    assert [(x.language, x.code) for x in b] == [("py", "a\n\n  b"), (None, "x\ny")]
    assert b[0].description == "Kept body." and b[1].title == "Part | Title"
    assert rst_title("=====\nTitle\n=====\n") == "Title" and rst_title("Name\n----\n\n") == "Name" and rst_title("x\ny") is None


def test_html():
    t = """<body><nav>menu entries here</nav><h1>Main</h1><div><h2>One</h2></div><p>Text before the code</p>
    <pre class="x"><code>a = 1
b &lt; 2<span class="copy-btn">Copy</span></code></pre><p>short</p><p>Between the two blocks</p>
    <pre>1: x
2: y</pre><button><code>in a button here now</code></button><script>if (a) { "</p><pre>no\nno</pre>" }</script><p>Unclosed <code>three words here</code></body>"""
    b = list(html_blocks(t))
    assert [x.code for x in b] == ["a = 1\nb < 2", "x\ny", "three words here"]
    assert [x.title for x in b] == ["One | Main"] * 3
    assert [x.description for x in b][:2] == ["Text before the code", "Between the two blocks"]
    assert not list(html_blocks("<p>no code"))


def test_choice():
    assert parser_for("RST") == "restructuredtext" and parser_for(None, "a.HTM") == "html" and parser_for("text") == "markdown"


def test_table_function(spark):
    d = spark.createDataFrame([(1, "```\na\nb\n```", "markdown", "x"), (2, None, "html", "y"), (3, "", None, "z")], "doc_id long, content string, content_type string, language string")
    assert [(r.id, r.block_no, r.code_content) for r in extract(d).collect()] == [(1, 1, "a\nb")]
    register(spark)
    d.createOrReplaceTempView("docs_t")
    got = spark.sql("select doc_id, e.code_content from docs_t, lateral extract_markdown(content) as e").collect()
    assert [tuple(r) for r in got] == [(1, "a\nb")]
