"""String, array and JSON scalars as Column functions; everything here stays inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Language aliases, as canonical name followed by its aliases.
_ALIASES = """
javascript js mjs cjs
typescript ts
python py py3 python3 pyw pyx pxd pyi
bash sh shell zsh fish
shell shellscript
yaml yml
cpp c++ cxx cc hpp hxx hh
csharp c# cs
objc objective-c objectivec m mm
go golang
html htm xhtml
ruby rb
perl pl
powershell ps1 psm1 psd1
kotlin kt kts
rust rs
markdown md
latex tex
sql postgresql mysql sqlite psql
batch bat cmd
fsharp fs
vbnet vb
julia jl
elixir ex exs
erlang erl hrl
nim nims
pascal pas pp
asm s
ini cfg
jsx react react.js reactjs next next.js nextjs
clojure clj cljs
asciidoc adoc
apache htaccess
"""
# Languages of file extensions, as language followed by its extensions.
_EXTENSIONS = """
javascript js jsx mjs cjs
typescript ts tsx
python py pyw pyx pxd pyi
html html htm xhtml
xml xml
css css
scss scss
sass sass
less less
json json
yaml yaml yml
toml toml
ini ini cfg
conf conf
shell sh
bash bash
zsh zsh
fish fish
powershell ps1 psm1 psd1
batch bat cmd
c c h
cpp cpp cxx cc hpp hxx hh
rust rs
go go
zig zig
java java
kotlin kt kts
scala scala
clojure clj cljs
groovy groovy
csharp cs
fsharp fs
vbnet vb
swift swift
objc m mm
sql sql psql mysql
ruby rb
php php
perl pl
lua lua
r r
julia jl
elixir ex exs
erlang erl hrl
nim nim nims
dart dart
pascal pas pp
asm asm s
markdown md
mdx mdx
rst rst
latex tex
asciidoc adoc
nginx nginx
apache htaccess
"""
# Languages of whole file names.
_FILENAMES = """
dockerfile dockerfile
makefile makefile
ruby gemfile rakefile vagrantfile podfile appfile fastfile snapfile scanfile
javascript gulpfile gruntfile
groovy jenkinsfile
swift cartfile
gitignore .gitignore
dockerignore .dockerignore
env .env
json .babelrc .eslintrc .prettierrc tsconfig.json package.json composer.json
toml cargo.toml pyproject.toml
go go.mod go.sum
text requirements.txt
markdown readme.md changelog.md
"""


def _table(text: str) -> dict[str, str]:
    return {alias: row[0] for row in map(str.split, text.strip().splitlines()) for alias in row[1:]}


ALIASES, EXTENSIONS, FILENAMES = _table(_ALIASES), _table(_EXTENSIONS), _table(_FILENAMES)


def _lookup(table: dict[str, str], key: Column) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


def strip(c: Column) -> Column:
    """Trim all white space, not blanks only."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def content_hash(c: Column) -> Column:
    """MD5 hex of the UTF-8 text; null stays null."""
    return F.md5(c)


def language_name(c: Column) -> Column:
    """Canonical language: aliases resolved, null and empty are 'text'."""
    low = strip(F.lower(c))
    return F.when(c.isNull() | (c == ""), "text").otherwise(F.coalesce(_lookup(ALIASES, low), low))


def language_of_file(name: Column) -> Column:
    """Language of a file name: special names first, then the extension; unknown is null."""
    low = strip(F.lower(name))
    return F.coalesce(_lookup(FILENAMES, low), _lookup(EXTENSIONS, F.nullif(F.regexp_extract(low, r"[^/.]\.([^./]+)$", 1), F.lit(""))))


def content_type_of(path: Column) -> Column:
    """Content type by extension, in any case; unknown is null."""
    low = F.lower(path)
    return (
        F.when(low.rlike(r"\.(md|markdown|mdx|mdown|mkd|mdwn)$"), "markdown")
        .when(low.rlike(r"\.(rst|rest|restx|rtxt|rstx)$"), "restructuredtext")
        .when(low.rlike(r"\.(html|htm)$"), "html")
        .when(low.rlike(r"\.txt$"), "text")
    )


def is_code_worth_keeping(c: Column) -> Column:
    """Several lines, or one with at least three words of three characters."""
    return F.coalesce((strip(c) != "") & (c.contains("\n") | (F.size(F.regexp_extract_all(c, F.lit(r"([\p{L}\p{N}_]{3,})"), F.lit(1))) >= 3)), F.lit(False))


def drop_link_lines(c: Column) -> Column:
    """Remove every line with an inline link, an image or a reference definition; collapse blank runs; trim."""
    bad = r"\[[^\]]+\]\([^)]+\)|!\[[^\]]*\]\([^)]+\)|^\s*\[[^\]]+\]:\s*https?://"
    kept = F.array_join(F.filter(F.split(c, "\n"), lambda x: ~x.rlike(bad)), "\n")
    return strip(F.regexp_replace(kept, r"\n{3,}", "\n\n"))


def unlink_markdown(c: Column) -> Column:
    c = F.regexp_replace(c, r"\[([^\]]+)\]\([^)]+\)", "$1")
    c = F.regexp_replace(c, r"\[([^\]]+)\]\[[^\]]+\]", "$1")
    return F.regexp_replace(c, r"(?m)^\[[^\]]+\]:\s+.+$", "")


def drop_images(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"!\[([^\]]*)\]\([^)]+\)", ""), r"!\[([^\]]*)\]\[[^\]]+\]", "")


def drop_html_comments(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)<!--.*?-->", "")


# Hosts of status badges.
BADGE_HOSTS = (r"shields\.io/", "badge", "travis-ci", "codecov", "coveralls")


def drop_badges(c: Column) -> Column:
    for host in BADGE_HOSTS:
        c = F.regexp_replace(c, r"https?://[^/]*" + host + r"[^\s\)]+", "")
    return c


def drop_rst_references(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"`([^<]+)\s+<[^>]+>`_", "$1"), r"\[[#\d]+\]_", "")


def normalize_space(c: Column) -> Column:
    """Runs of blanks to one, three or more line feeds to two, every line and the whole trimmed."""
    c = F.regexp_replace(F.regexp_replace(c, " +", " "), r"\n{3,}", "\n\n")
    return strip(F.array_join(F.transform(F.split(c, "\n"), strip), "\n"))


# What navigation lines look like.
NAVIGATION = r"^(previous|next|back|forward|home|index|contents?|table of contents)$|^go to|^return to|^back to|^\[?(<|>|<<|>>|←|→)\]?$|^page \d+"


def is_navigation(line: Column) -> Column:
    return strip(F.lower(line)).rlike(NAVIGATION)


def filter_noise_markdown(c: Column) -> Column:
    c = normalize_space(drop_badges(drop_html_comments(drop_images(unlink_markdown(c)))))
    return strip(F.array_join(F.filter(F.split(c, "\n"), lambda x: ~is_navigation(x)), "\n"))


def strip_front_matter(c: Column) -> Column:
    return F.regexp_replace(c, r"\A(?s:---\n(.*?)\n---\n|\+\+\+\n(.*?)\n\+\+\+\n)", "")


def domain_of(url: Column) -> Column:
    """Host with port in lower case; a dotted text without scheme is taken as https; else null."""
    full = F.when(url.rlike(r"^(?i)https?://"), url).when(url.contains(".") & ~url.contains(" "), F.concat(F.lit("https://"), url))
    return F.nullif(F.lower(F.regexp_extract(full, r"^(?i)https?://([^/?#]*)", 1)), F.lit(""))


def domains_of(urls: Column) -> Column:
    """Distinct domains of an array of addresses, in order, invalid ones left out."""
    return F.array_distinct(F.filter(F.transform(urls, domain_of), lambda d: d.isNotNull()))


def primary_domain(urls: Column) -> Column:
    return F.get(domains_of(urls), 0)


def normalize_url(url: Column) -> Column:
    """One trailing slash off, then the fragment, in this order."""
    return F.regexp_replace(F.regexp_replace(url, "/$", ""), "#.*$", "")


def is_valid_url(url: Column) -> Column:
    return F.coalesce(url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+"), F.lit(False))


def title_of_url(url: Column) -> Column:
    """File name of a file or upload address; others are untitled."""
    upload = F.regexp_extract(url, r"^upload://(.*)$", 1)
    name = F.regexp_extract(upload, r"^[^/]*/(.*)$", 1)
    return (
        F.when(url.startswith("file://"), F.regexp_extract(url, r"([^/]*)$", 1))
        .when(url.startswith("upload://") & upload.contains("/"), F.when(name.contains("."), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name))
        .when(url.startswith("upload://"), upload)
        .otherwise("Untitled Document")
    )


def title_of_markdown(c: Column, lines: int = 20) -> Column:
    """Text of the first '# ' line among the first lines, else null."""
    heads = F.filter(F.transform(F.slice(F.split(c, "\n"), 1, lines), strip), lambda x: x.startswith("# "))
    return F.when(F.size(heads) > 0, strip(F.substring(F.get(heads, 0), 3, 1_000_000)))


def resolve_title(explicit: Column, content: Column, url: Column) -> Column:
    return F.coalesce(F.nullif(explicit, F.lit("")), F.nullif(title_of_markdown(content), F.lit("")), title_of_url(url))


# Endings of page titles that aren't part of a site's name.
TITLE_ENDINGS = (" Documentation", " Docs", " | Home", " - Official Site", " - Home", " Reference", " API Reference", " Developer Guide", " · GitBook", " | MDN", " - MDN Web Docs")


def site_name(title: Column, metadata: Column | None = None) -> Column:
    """Site name from metadata (JSON) or from a cleaned page title, at most 50 characters."""
    clean = F.coalesce(*[F.when(title.endswith(e), F.substring(title, F.lit(1), F.length(title) - len(e))) for e in TITLE_ENDINGS], title)

    def first_if_good(sep: str, otherwise_last: bool):
        def pick(c: Column) -> Column:
            first, last = F.split_part(c, F.lit(sep), F.lit(1)), F.split_part(c, F.lit(sep), F.lit(-1))
            good = (F.length(first) <= 30) & ~F.lower(first).rlike("documentation|docs|guide")
            return F.when(good, strip(first)).otherwise(strip(last) if otherwise_last else c)

        return pick

    def part(c: Column) -> Column:
        return F.when(c.contains(" | "), first_if_good(" | ", True)(c)).when(c.contains(" - "), first_if_good(" - ", False)(c)).otherwise(c)

    def shorten(c: Column) -> Column:
        return F.when(F.length(c) > 50, F.concat(F.regexp_replace(F.substring(c, 1, 50), r" [^ ]*$", ""), F.lit("..."))).otherwise(strip(c))

    clean = let(F.regexp_replace(let(clean, part), r"\s+v?\d+(\.\d+)*$", ""), shorten)
    if metadata is None:
        return clean
    short = lambda key: let(F.nullif(F.get_json_object(metadata, f"$['{key}']"), F.lit("")), lambda v: F.when(F.length(v) <= 50, v))
    return F.coalesce(strip(short("og:site_name")), strip(short("application-name")), strip(F.regexp_replace(short("twitter:site"), "^@", "")), clean)


def repository_of(url: Column) -> Column:
    """owner/name of a repository address, over https or ssh; else null."""
    plain = F.regexp_replace(F.regexp_replace(url, r"[.git]+$", ""), r"^git@github\.com:", "https://github.com/")
    return F.when(plain.rlike(r"github\.com/[^/]+/[^/]+"), F.regexp_extract(plain, r"github\.com/([^/]+/[^/]+)", 1))


def blob_url(url: Column, branch: Column, path: Column) -> Column:
    return F.concat(F.lit("https://github.com/"), repository_of(url), F.lit("/blob/"), branch, F.lit("/"), F.regexp_replace(path, "^/+", ""))


def raw_url(url: Column, branch: Column, path: Column) -> Column:
    return F.concat(F.lit("https://raw.githubusercontent.com/"), repository_of(url), F.lit("/"), branch, F.lit("/"), F.regexp_replace(path, "^/+", ""))


def fallback_title(title: Column, page: Column, number: Column) -> Column:
    block = F.concat(F.lit("Code Block "), number.cast("string"))
    return F.coalesce(F.nullif(title, F.lit("")), F.concat(F.nullif(page, F.lit("")), F.lit(" - "), block), block)


def fallback_description(description: Column, page: Column) -> Column:
    return F.coalesce(F.nullif(description, F.lit("")), F.concat(F.lit("Code snippet from "), F.coalesce(F.nullif(page, F.lit("")), F.lit("documentation"))))


def parse_reply(reply: Column) -> Column:
    """struct(language, title, description) of a labelled reply; null unless title and description are there."""
    part = lambda k: F.nullif(F.trim(F.regexp_extract(reply, rf"(?m)^\s*{k}:(.*)$", 1)), F.lit(""))
    t, d = part("TITLE"), part("DESCRIPTION")
    return F.when(t.isNotNull() & d.isNotNull(), F.struct(part("LANGUAGE").alias("language"), t.alias("title"), d.alias("description")))


def build_prompt(template: str, context: Column, code: Column) -> Column:
    """Fill {context} with its first 500 and {code} with its first 2000 characters."""
    c = F.replace(F.lit(template), F.lit("{context}"), F.coalesce(F.substring(context, 1, 500), F.lit("")))
    return F.replace(c, F.lit("{code}"), F.coalesce(F.substring(code, 1, 2000), F.lit("")))


def snippet_type_of(purpose: Column) -> Column:
    # Purposes and the snippet types they are stored as.
    return F.coalesce(_lookup({"example": "example", "configuration": "config", "tutorial": "example", "utility": "function"}, F.lower(purpose)), F.lit("code"))


def count_tokens(c: Column) -> Column:
    """Token estimate: a quarter of the characters."""
    return F.floor(F.length(c) / 4).cast("long")


def hard_truncate(c: Column, tokens: int) -> Column:
    """(text, truncated): at most ``tokens`` estimated tokens, cut where they end."""
    cut = F.substring(c, 1, 4 * tokens)
    return F.struct(cut.alias("text"), F.coalesce(F.length(c) > 4 * tokens, F.lit(False)).alias("truncated"))


def same_domain(a: Column, b: Column) -> Column:
    """Whether two addresses are of one domain; false if either has none."""
    return F.coalesce(domain_of(a) == domain_of(b), F.lit(False))


def smart_truncate(c: Column, tokens: int) -> Column:
    """At most ``tokens`` estimated tokens, cut at the last line feed if it lies in the final fifth."""
    cut = F.substring(c, 1, tokens * 4)
    floor = int(tokens * 4 * 0.8)
    tail = F.substring(cut, floor + 1, tokens * 4)
    behind = F.instr(F.reverse(tail), "\n")
    return F.when(count_tokens(c) <= tokens, c).otherwise(F.when((behind > 0) & (F.length(cut) - behind > 0), F.substring(cut, F.lit(1), F.length(cut) - behind)).otherwise(cut))


def format_snippet(title: Column, description: Column, source: Column, language: Column, code: Column, tokens: int | None = None) -> Column:
    """The text block a search result is shown as."""
    if tokens:
        short = smart_truncate(code, tokens)
        code = F.when(F.length(short) < F.length(code), F.concat(short, F.lit("\n... [truncated due to size]"))).otherwise(short)
    or_else = lambda c, d: F.coalesce(F.nullif(c, F.lit("")), F.lit(d))
    return F.concat(
        F.lit("TITLE: "), or_else(title, "Untitled"), F.lit("\nDESCRIPTION: "), or_else(description, "No description available"), F.lit("\nSOURCE: "), F.coalesce(source, F.lit("None")),
        F.lit("\n\nLANGUAGE: "), or_else(language, "unknown"), F.lit("\nCODE:\n```\n"), F.coalesce(code, F.lit("None")), F.lit("\n```\n\n" + "-" * 40),
    )


def count_occurrences(c: Column, needle: str) -> Column:
    """Literal occurrences in any case; an empty needle occurs nowhere."""
    if not needle:
        return F.lit(0)
    low = needle.lower()
    return F.coalesce(((F.length(F.lower(c)) - F.length(F.replace(F.lower(c), F.lit(low), F.lit("")))) / len(low)).cast("int"), F.lit(0))


def glob_to_regex(glob: str) -> str:
    """A shell glob as an anchored regular expression; ** crosses folders."""
    import re

    return "^" + re.sub(r"\\\*\\\*/?|\\\*|\\\?", lambda m: ".*" if m[0].startswith("\\*\\*") else "[^/]*" if m[0] == "\\*" else "[^/]", re.escape(glob)) + "$"
