import uuid

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagelode.functions import html, text, urls, vectors
from pagelode.functions.hashing import content_hash, point_id
from pagelode.operators.chunking import chunk_pages


def model_sentences(t):
    out, at = [], 0
    for i in range(len(t) - 1):
        if t[i] in ".!?" and t[i + 1].isspace():
            out.append(t[at : i + 1].strip())
            at = i + 2
    return [s for s in [*out, t[at:].strip()] if s]


def model_pack(parts, joint, big=None):
    out, buf, n = [], None, 0
    keep = lambda b: [b] if b is not None and len(b) // 4 >= 10 else []
    for p in parts:
        size = len(p) // 4
        if big and size > 512:
            out += keep(buf) + big(p)
            buf, n = None, 0
        elif buf is None:
            buf, n = p, size
        elif n + size > 512:
            out += keep(buf)
            buf, n = p, size
        else:
            buf, n = buf + joint + p, n + size
    return out + keep(buf)


def model_chunks(t):
    t = t.strip()
    if not t:
        return []
    if len(t) // 4 <= 512:
        return [t] if len(t) // 4 >= 10 else []
    parts = [p.strip() for p in t.split("\n\n") if p.strip()]
    return model_pack(parts, "\n\n", lambda p: model_pack(model_sentences(p), " "))


def chunks_of(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r["c"] for r in rows.orderBy("i").select("i", text.chunk_texts("t").alias("c")).orderBy("i").collect()]


TEXTS = [
    None, "", "  \n ", "short", "x" * 39, "x" * 40, "x" * 2051, "x" * 2052, "word. " * 600, "A sentence ends here. " * 200,
    "\n\n".join(["p" * 200] * 40), "\n\n".join(["a" * 2044, "b" * 8, "tiny", "c" * 3000 + ". " + "d" * 3000, "end of it all, at last now."]), "fluff " * 700 + "! Off? f",
]


def test_chunks_equal_the_model(spark):
    assert chunks_of(spark, TEXTS) == [model_chunks(t or "") for t in TEXTS]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["ab ", "cd. ", "ef!\n", "\n\n", "g" * 300, "h" * 2100 + ". "]), max_size=60).map("".join), min_size=20, max_size=20))
def test_chunks_equal_the_model_on_random_texts(spark, texts):
    got = chunks_of(spark, texts)
    assert got == [model_chunks(t) for t in texts]
    assert all(len(c) // 4 >= 10 for cs in got for c in cs)


def page_rows(spark, pages):
    return spark.createDataFrame(pages, "url string, sections array<struct<heading:string,text:string>>, body_text string")


def test_two_sections_give_two_chunks(spark):
    long = "This section has quite a few words in it, enough to be kept."
    rows = chunk_pages(page_rows(spark, [("u", [("H1", long), ("H2", long)], long)])).orderBy("chunk_index").collect()
    assert [(r["heading"], r["chunk_index"]) for r in rows] == [("H1", 0), ("H2", 1)] and rows[0]["chunk_text"] == "H1\n\n" + long


def test_large_section_and_body_fallback(spark):
    big = "Twenty characters x. " * 200
    rows = chunk_pages(page_rows(spark, [("u", [("Big", big)], big)])).orderBy("chunk_index").collect()
    assert [len(r["chunk_text"]) - 5 for r in rows] == [len(c) for c in model_chunks(big)] and len(rows) > 1
    tiny = [("v", [("A", "tiny"), ("B", "small")], "tiny\n\nsmall and a few more words to reach the minimum"), ("w", [], ""), ("n", None, None)]
    rows = chunk_pages(page_rows(spark, tiny)).collect()
    assert [(r["url"], r["heading"]) for r in rows] == [("v", "")]


def test_token_estimates(spark):
    row = spark.sql("SELECT 'a😀bcdefg' AS t").select(text.estimate_tokens("t").alias("a"), text.estimate_tokens("t", utf16=True).alias("b")).first()
    assert (row["a"], row["b"]) == (2, 2)


# -- HTML ----------------------------------------------------------------------------------------------------

BASIC = """<html><head><title> A &amp; B </title><meta name="description" content="About &lt;it&gt;"></head><body><main><h1>One</h1><p>First <strong>bold</strong> text</p>
<h2>Two</h2><ul><li>Item 1<li>Item 2</ul><a href="/docs/x/#top">in</a><a href="https://other.org/">out</a><a href="mailto:a@b">m</a><a href="#f">f</a></main></body></html>"""
SELECT = html.Selectors(content="main", heading="h1, h2")


def test_basic_page():
    p = html.extract(BASIC, "https://example.com/start", SELECT)
    assert (p.title, p.summary, p.headings) == ("A & B", "About <it>", ["One", "Two"])
    assert [h for h, _ in p.sections] == ["One", "Two"] and p.links == ["https://example.com/docs/x"]
    assert "**bold**" in p.body_text and "- Item 1" in p.body_text and p.body_text == "\n\n".join(t for _, t in p.sections)


def test_table_and_modes():
    page = "<main><h1>T</h1><table><tr><th>A<th>B|C</tr><tr><td>1<td>2</table><pre> x &lt; y </pre><script>no()</script><hr></main>"
    body = html.extract(page, "http://h", SELECT).body_text
    assert "| A | B\\|C | \n| --- | --- | \n| 1 | 2 | " in body and "```\n x &lt; y \n```" in body and "no()" not in body and "---" in body
    assert "no()" in html.extract(page, "http://h", SELECT, keep_script_text=True).body_text
    assert "<p>Hello</p>" in html.extract("<main><p>Hello</p></main>", "http://h", SELECT, "Html").body_text
    assert html.extract("<main><p>a <b>b</b></p></main>", "http://h", SELECT, "Text").body_text == "a b"


def test_headings_carry_over_and_are_overwritten():
    page = "<div class='c'><h1>Lost</h1><h1>Kept</h1></div><div class='c x'><p>one</p><h2>Next</h2><p>two</p></div>"
    p = html.extract(page, "http://h", html.Selectors(content=".c", heading="h1,h2"))
    assert p.sections == [("Kept", "one"), ("Next", "two")]


PAGE = "<div id='top' class='x note y'><h1>1</h1><p class='noted'>2</p><a name='n'><b>3</b></a></div><meta name=author content=me><note>4</note>"


@pytest.mark.parametrize(
    "selector, tags",
    [
        ("h1", ["h1"]), ("H1", ["h1"]), (".note", ["div"]), ("#top", ["div"]), ("meta[name=author]", ["meta"]), ("meta[name='author']", ["meta"]), ("//a/b", ["b"]), ("a/b", ["b"]),
        ("a > b", []), ("//div/*", ["h1", "p", "a"]), ("//div/*[2]", ["p"]), ("//*[@name]", ["a", "meta"]), ("//*[@name='n']", ["a"]), ("//p[contains(@class, 'ote')]", ["p"]),
        ("//*[contains(concat(' ', normalize-space(@class), ' '), ' note ')]", ["div"]), ("//p[last()]", ["p"]), ("", []), ("p, h1, p", ["p", "h1", "p"]), ("./div//b", ["b"]), ("note", ["note"]),
    ],
)
def test_selectors(selector, tags):
    assert [n.tag for n in html.select(html.parse(PAGE), selector)] == tags


def test_character_references_stay_as_they_are():
    page = "<main title='a&amp;b &lt'>x &am; &am &amp &#38; &#x26 &copy&quot; & y<a href='/q?a=1&amp;b=2&c'>l</a><!-- &amp; --></main>"
    root = html.parse(page)
    assert root.outer_html() == page and root.children[0].attrs["title"] == "a&b <"
    p = html.extract(page, "http://h/", html.Selectors(content="main"), "Text")
    assert p.body_text == "x &am; &am & & & ©\" & y\nl" and p.links == ["http://h/q?a=1&b=2&c"]


def test_deep_pages():
    deep = "<div>" * 5000 + "<b>x</b>" + "</div>" * 5000
    page = f"<main><h1>T</h1>{deep}</main>"
    assert html.extract(page, "http://h", SELECT).sections == [("T", "**x**")]
    assert html.extract(page, "http://h", SELECT, "Html").sections == [("T", deep)]
    assert html.extract("<main>" + "<table><tr><td>" * 300 + "x</main>", "http://h", SELECT).body_text.count("| x |") == 300


def test_cells_hold_plain_text():
    body = html.extract("<main><table><tr><th>a <b>b</b><th> c&amp;d|e <!-- n --></tr><tr></tr><tr><td>1</table></main>", "http://h", SELECT).body_text
    assert body == "| a b | c&d\\|e | \n| --- | --- | \n| 1 |"


def test_xpath_and_unbalanced_markup():
    root = html.parse("<div id='a'><p>x<p>y<div class='k l'>z</div></div><ul><li>1<li>2</ul>")
    text_of = lambda s: [n.inner_text() for n in html.select(root, s)]
    assert text_of("p") == ["x", "y"] and text_of(".l") == ["z"] and text_of("//ul/li[2]") == ["2"] and text_of("#a, p") == ["xyz", "x", "y"]
    assert text_of("//div[contains(@class, 'k')]") == ["z"] and text_of("a > b") == [] and html.split_selector("//a[contains(@b, ',')], p") == ["//a[contains(@b, ',')]", "p"]
    assert html.parse("<p>" * 5000 + "x").inner_text() == "x"


def test_extract_pages_keeps_columns_and_nulls(spark):
    rows = spark.createDataFrame([(1, "http://h/", BASIC, "own"), (2, None, None, None)], "id int, url string, html string, title string")
    got = {r["id"]: r for r in html.extract_pages(rows, SELECT).collect()}
    assert got[1]["title"] == "A & B" and got[2]["title"] == "" and got[2]["sections"] == [] and "html" not in got[1].asDict()


# -- hashes, URLs, vectors -----------------------------------------------------------------------------------


def test_hashes(spark):
    import hashlib

    row = spark.sql("SELECT 'http://é/' AS u, 3 AS i").select(point_id(F.col("u"), F.col("i")).alias("p"), content_hash(F.col("u")).alias("h")).first()
    assert row["p"] == str(uuid.UUID(bytes_le=hashlib.md5("http://é/::3".encode()).digest())) and row["h"] == hashlib.sha256("http://é/".encode()).hexdigest()


def test_urls(spark):
    n = urls.normalised
    assert n("https://Ex.com:443/a/b", "../c/?q=1#f") == "https://ex.com/c/?q=1" and n("http://h:8080/", "/x//") == "http://h:8080/x"
    assert [n("http://h", x) for x in ("", "#a", "JavaScript:x", "mailto:x", "ftp://h/", "http://g/", "http://[bad")] == [None] * 7
    row = spark.sql("SELECT 'HTTP://A.b/x//' AS u, 'not a url' AS v").select(
        urls.trimmed(F.col("u")).alias("t"), urls.host_of(F.col("u")).alias("h"), urls.path_of(F.col("v")).alias("p"), urls.same_host(F.col("v"), F.col("u")).alias("s"), urls.visit_key(F.col("u")).alias("k")
    ).first()
    assert (row["t"], row["h"], row["s"], row["k"]) == ("HTTP://A.b/x", "a.b", False, "http://a.b/x")


def test_cosine(spark):
    row = spark.sql("SELECT array(1f, 0f) AS a, array(1f, 1f) AS b, array(0f, 0f) AS z").select(vectors.cosine(F.col("a"), F.col("b")).alias("c"), vectors.cosine(F.col("a"), F.col("z")).alias("n")).first()
    assert abs(row["c"] - 0.5**0.5) < 1e-7 and row["n"] is None
