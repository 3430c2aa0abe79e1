import hashlib
import math
import random

import numpy as np

from pagelode.llm import html_text, warc
from pagelode.llm.common import work_path


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_article_without_its_surroundings():
    page = """<html><head><title>t</title><style>p{}</style></head><body class="has-sidebar"><header>Top</header><nav><a href="/">Home</a></nav>
    <div class="cookie-notice">We use cookies</div><main><article><header><h1>T &amp; x</h1></header><p>a<br>b&nbsp; c<p>d <b>e</b>f
    <aside>no</aside><div class="ad">buy</div><ul><li>x<li>y</ul><!-- c <p>gone</p> --><script>var a="<p>";</script>
    <form><input>mail</form><section id="comments"><p>first!</p></section></article></main><footer>f</footer></body></html>"""
    assert html_text.main_blocks(page) == (2, ["T & x", "a b c", "d ef", "x", "y"])


def test_broken_pages():
    assert html_text.main_blocks("") == (0, [])
    assert html_text.main_blocks("a < b & c > d")[1] == ["a < b & c > d"]
    assert html_text.main_blocks('<p>one<div class="ad">two<p>three</p>')[1] == ["one", "three"]
    assert html_text.main_blocks("<article><p>cut &am")[1] == ["cut &am"]
    assert html_text.main_blocks('<p title="a>b">x</p><p title="open>y</p>')[1] == ["x", "y"]
    assert html_text.main_blocks("<!-- open <p>x")[1] == []
    assert html_text.main_blocks("<article>" * 3000 + "deep")[1] == ["deep"]


def test_many_excluded_elements_that_never_close():
    for start in ('<li class="social">', '<p class="ad">', '<tr class="promo">'):
        for n in (7, 8, 9, 300):
            assert html_text.main_blocks(f"{start}share" * n + "<article><p>one<p>two</article>")[1] == ["one", "two"]
            assert html_text.main_blocks("<p>one" + f"{start}share" * n + '<div class="ad">buy</div><div>two</div>')[1] == ["one", "two"]


def test_names_of_wrappers_and_sections():
    blocks = lambda page: html_text.main_blocks(page)[1]
    assert blocks('<div class="content-sidebar-wrap"><main><p>one</main></div>') == ["one"]
    assert blocks('<div id="page" class="has-sidebar"><article><p>one</article></div>') == ["one"]
    assert blocks('<div id="page" class="left-sidebar"><article>one</article></div><div id="comments"><article>no</article></div>') == ["one"]
    assert blocks('<form id="aspnetForm"><div class="menu">no</div><main>one</main></form>') == ["one"]
    assert blocks('<article><h2 id="related-work">Related work</h2><h3 id="social">s</h3><section id="social-impact">two</section></article>') == ["Related work", "s", "two"]
    assert blocks('<article>one</article><div class="sidebar"><article>teaser</article></div>') == ["one"]
    assert blocks('<div>one</div><div class="related-posts"><article>teaser</article></div>') == ["one"]
    for name in ("ad-box", "site-footer", "sidebarLeft", "share_buttons", "x cookie-notice", "ad-728", "footer-widgets", "author-widget"):
        assert blocks(f'<div>one</div><div class="{name}">no</div>') == ["one"]


def brute_hosts(rows):
    """By counting: page -> text of (page_id, url, html) rows."""
    by_host, out = {}, {}
    for k, (_, url, h) in enumerate(rows):
        by_host.setdefault((url or "").lower().partition("://")[2].partition("/")[0], []).append((k, *html_text.main_blocks(h or "")))
    for pages in by_host.values():
        holds, streams = {}, {tuple(b) for _, _, b in pages}
        for s in streams:
            w = " ".join(s).split()
            for i in range(len(w) - 7):
                holds.setdefault(tuple(w[i : i + 8]), set()).add(s)
        n = len(streams)
        for k, zone, blocks in pages:
            need = max(5, math.ceil(n / 2)) if zone else min(10, max(3, math.ceil(n / 5)))
            w = [(x, j) for j, b in enumerate(blocks) for x in b.split()]
            gone = set()
            for i in range(len(w) - 7):
                if len(holds[tuple(x for x, _ in w[i : i + 8])]) >= need:
                    gone.update(range(i, i + 8))
            own = any(len(b.split()) >= 8 and not gone & {p for p, (_, o) in enumerate(w) if o == j} for j, b in enumerate(blocks))
            if 2 * len(gone) > len(w) and not own if zone else len(gone) == len(w):
                gone = set()
            left = [" ".join(x for p, (x, o) in enumerate(w) if o == j and p not in gone) for j in range(len(blocks))]
            out[k] = "\n".join(x for x in left if x)
    return out


def host_rows(sizes, seed=1):
    """Plain pages of own text around notices: on all pages of a host, on a part of them, one in a paragraph of own text; copies, and marked pages."""
    r = random.Random(seed)
    words = lambda n: " ".join("w%d" % r.randrange(5000) for _ in range(n))
    rows = []
    for h, n in enumerate(sizes):
        always, often, inner = words(14), words(20), words(12)
        shared = [words(30) for _ in range(4)]
        for i in range(n):
            body = f"<p>{always}<p>{words(40)} {inner if i % 2 else ''} {words(20)}" + (f"<div>{often}</div>" if i % 7 == 0 else "") + f"<p>{r.choice(shared) if i % 11 == 0 else words(9)}"
            rows.append((len(rows), f"http://Host{h}.org/{i}", f"<article>{body}</article>" if i % 13 == 12 else body))
        rows += [(len(rows) + j, f"http://host{h}.org/copy{j}", rows[-1][2]) for j in range(2)]
        rows.append((len(rows), f"http://host{h}.org/only", f"<p>{always}"))
    return rows


def test_ordinary_pages_keep_their_text():
    blocks = lambda page: html_text.main_blocks(page)[1]
    long = "the text of the page goes on for a while and says what it has to say " * 4
    text = long.strip()
    assert blocks(f'<article><p title="the hidden gem of Rome">{long}</p><div hidden>no</div><p style="color:red; display: none">no</p></article>') == [text]
    assert blocks(f'<article><div class="prose hidden md:block">{long}</div></article>') == [text]
    assert blocks(f'<body><form id="aspnetForm"><div><p>{long}</p><p>more</p></div></form><form><p>Your mail</p></form></body>') == [text, "more"]
    assert blocks(f'<div>{long}</div><form><p>Your name<input></p></form>') == [text]
    assert blocks(f'<div id="content"><p>{long}</p></div><div class="more"><article>Teaser</article></div>') == [text, "Teaser"]
    assert blocks(f"<main><h1>Title</h1><p>intro</p><article>{long}</article><p>outro</p></main><div>else</div>") == ["Title", "intro", text, "outro"]
    assert blocks(f'<article><section class="menu"><p>{long}</p></section><div class="menu"><a href="/">{long}</a></div></article>') == [text]
    for name in ("code-widget", "product-notice"):
        assert blocks(f'<article><p>one</p><div class="{name}">{long}</div><div class="{name}">short</div></article>') == ["one", text]
    assert blocks(f'<article><p>{long}</p><ol class="replies"><li><article>first!</article></li><li><article>second</article></li></ol></article>') == [text]
    assert blocks(f"<article><div><article>{long}</article><article>two</article></div></article>") == [text, "two"]


def test_hostile_pages_end():
    import time

    n = 1_000_000
    for start in ("<![CDATA[", "<!-- ", "<a ", "</a ", "<!", "<?", '<a ">"', "<a '\">", "<div>x", "<article>x", "<article>x</article>", "<i>", "</b>", "<script>", "<", "&", '<li class="ad">', "<form><p>x", "<a href=/x>", "<a" + " " * 50):
        for end in ("", "]]>"):
            page = f"<main><p>first words</p>{start * (n // len(start))}{end}"
            at = time.process_time()
            got = html_text.main_blocks(page)[1]
            assert time.process_time() - at < 15 and got[0].startswith("first words"), (start, end)


def test_equal_blocks_in_both_zones():
    """Small hosts, large hosts and brute force agree, whatever the order of pages."""
    r = random.Random(9)
    words = lambda n: " ".join("w%d" % r.randrange(3000) for _ in range(n))
    notice = words(12)
    bodies = [f"<p>{notice}<p>{words(30)}" for _ in range(6)]
    rows = [(i, "http://h/x", b if kind else f"<article>{b}</article>") for kind in (0, 1) for i, b in enumerate(bodies)]
    for order in (rows, rows[::-1]):
        expect = brute_hosts(order)
        got = html_text.host_texts([html_text.main_blocks(h) for _, _, h in order])
        assert got == [expect[k] for k in range(len(order))]


def test_notices_go_from_short_articles():
    r = random.Random(10)
    words = lambda n: " ".join("w%d" % r.randrange(3000) for _ in range(n))
    notice, own = words(60), [words(40) for _ in range(20)]
    pages_ = [html_text.main_blocks(f"<article><div>{notice}</div><p>{x}</p></article>") for x in own]
    assert html_text.host_texts(pages_) == own


def zoned_rows(seed):
    """Blocks shared by pages of both zones, on hosts of several sizes."""
    r = random.Random(seed)
    words = lambda n: " ".join("w%d" % r.randrange(800) for _ in range(n))
    rows = []
    for h in range(4):
        shared = [words(r.randrange(6, 30)) for _ in range(5)]
        for i in range(r.choice((6, 15, 40))):
            body = "".join(f"<p>{r.choice(shared) if r.random() < 0.6 else words(r.randrange(5, 40))}" for _ in range(r.randrange(1, 5)))
            rows += [(len(rows) + k, f"http://h{h}/{i}", f"<article>{body}</article>" if r.random() < 0.5 else body) for k in range(r.choice((1, 1, 2)))]
    return rows


def test_zones_against_brute_force(spark):
    for seed in (1, 2):
        rows = zoned_rows(seed)
        expect = brute_hosts(rows)
        for most in (10_000, 0):
            got = html_text.main_text(pages(spark, rows).repartition(3), host_pages=most, block_text=4000).collect()
            assert {r["page_id"]: r["text"] for r in got} == expect and len(got) == len(rows)


def test_hosts_against_brute_force(spark):
    rows = host_rows([3, 50, 1200])
    expect = brute_hosts(rows)
    whole = {i: "\n".join(html_text.main_blocks(h)[1]) for i, _, h in rows}
    for lo, hi in ((0, 6), (6, 60), (60, len(rows))):  # the host step decides for each host
        assert sum(expect[i] != whole[i] for i in range(lo, hi)) > (hi - lo) / 2
    table = pages(spark, rows).repartition(3)
    for most, block in ((10_000, 1 << 23), (500, 50_000), (20, 3000), (0, 1 << 23)):  # no host, one, two, and all in blocks
        got = html_text.main_text(table, host_pages=most, block_text=block).collect()
        assert {r["page_id"]: r["text"] for r in got} == expect and len(got) == len(rows)
        assert all(r["n_chars"] == len(r["text"]) for r in got)


def test_suffix_array_orders_and_measures():
    r = random.Random(2)
    for _ in range(30):
        pages_ = [[r.randrange(3) for _ in range(r.randrange(1, 25))] for _ in range(r.randrange(1, 6))]
        tokens, page = np.array([x for p in pages_ for x in p]), np.repeat(np.arange(len(pages_)), list(map(len, pages_)))
        order, common = html_text.suffix_array(tokens, page)
        suffix = [p[i:] for p in pages_ for i in range(len(p))]
        assert [suffix[i] for i in order] == sorted(suffix)
        for k in range(1, len(order)):
            a, b = suffix[order[k - 1]], suffix[order[k]]
            assert common[k] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    assert len(html_text.suffix_array(np.zeros(0), np.zeros(0))[0]) == 0


def test_runs_go_and_unique_text_stays():
    notice = "please read our terms of use before you go on with this page today"
    own = [(0, [f"start{i} {notice} end{i}", " ".join(f"w{i}x{j}" for j in range(40))]) for i in range(3)]
    assert html_text.host_texts(own) == [f"start{i} end{i}\n" + own[i][1][1] for i in range(3)]
    assert html_text.host_texts(own[:2]) == ["\n".join(b) for _, b in own[:2]]
    copies = [(2, ["the very same article with more than eight words in it"])] * 9
    assert html_text.host_texts(copies) == [copies[0][1][0]] * 9
    near = [(2, ["the very same article with more than eight words in it " * 5 + str(i)]) for i in range(9)]
    assert html_text.host_texts(near) == [" ".join(b[0].split(" ")) for _, b in near]
    assert html_text.host_texts([]) == [] and html_text.host_texts([(0, [])] * 4) == [""] * 4


def test_main_text_table(spark):
    rows = [(i, f"http://h/{i}", f"<article><p>text {i}</p></article>") for i in range(30)]
    rows += [(30, None, None), (31, "http://h/0", ""), (0, "http://h/0", rows[0][2])]
    got = html_text.main_text(pages(spark, rows), host_pages=7).collect()
    assert sorted((r["page_id"], r["text"], r["n_chars"]) for r in got) == sorted(
        [(i, f"text {i}", len(f"text {i}")) for i in range(30)] + [(30, "", 0), (31, "", 0), (0, "text 0", 6)]
    )
    assert html_text.main_text(pages(spark, [])).count() == 0


def test_clashing_names_and_odd_rows(spark):
    rows = [(i, f"http://h/{i}", f"<p>own text {i}<p>please read our terms of use before you go on with this page") for i in range(6)] + [(None, None, None)] * 2
    expect = [(None, "", 0)] * 2 + [(i, f"own text {i}", 10) for i in range(6)]
    docs = pages(spark, rows).selectExpr("*", "1 AS host", "2 AS zone", "3 AS blocks", "4 AS n", "5 AS text")
    for most in (100, 0):  # in one task, and in blocks
        got = html_text.main_text(docs, host_pages=most).collect()
        assert sorted(((r["page_id"], r["text"], r["n_chars"]) for r in got), key=repr) == sorted(expect, key=repr)


def test_loser_tree_merges():
    import random

    r = random.Random(1)
    for k in range(1, 9):
        runs = [sorted((str(r.randrange(20)), "t", r.randrange(50)) for _ in range(r.randrange(12))) for _ in range(k)]
        assert list(warc.LoserTree(runs, warc.capture_key)) == sorted(x for run in runs for x in run)
    assert list(warc.LoserTree([], warc.capture_key)) == []


def test_records_round_trip():
    member = warc.record("http://a/ñ\n", 7, b"x\r\n\r\ny", "d", warc.DATE)
    headers, payload = warc.parse(member)
    assert payload == b"x\r\n\r\ny" and headers["WARC-Type"] == "response" and "\n" not in headers["WARC-Target-URI"]


def test_archive_and_history(spark):
    big = "<p>" + "z" * 200
    rows = [(i, f"http://www.b{i % 5}.org/p{i % 7}", big if i % 3 == 0 else f"page {i} " * (i + 1)) for i in range(60)]
    rows += [(60, None, None), (61, "http://a.org/", ""), (62, "bad url", "x" * 99), (63, "bad url", "x" * 99)]
    table = pages(spark, rows).repartition(9)
    folder = work_path(spark, "w")
    runs = warc.archived(table, folder)
    history = warc.history(runs, folder, ranges=4, fan_in=3)
    got = history.collect()
    order = [warc.capture_key(tuple(r)[1:]) for r in sorted(got, key=lambda r: r["range"])]
    assert order == sorted(order) and len(got) == 64
    for most in (64, 2):  # archives that stay open
        warc.OPEN = most
        read = [r["page_id"] for r in warc.read_records(history, 1).collect()]  # one task: the order of the whole history
        assert read == [r["page_id"] for r in sorted(got, key=lambda r: r["range"])]
    warc.OPEN = 64
    records = {r["page_id"]: r for r in warc.read_records(history).collect()}
    first = {}
    for i, _, h in sorted(rows, key=lambda r: r[0]):
        data = (h or "").encode()
        key = hashlib.sha256(data).hexdigest()
        r = records[i]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), key)
        if len(data) >= 100 and key in first:
            assert (r["record_type"], r["refers_to"]) == ("revisit", first[key])
        else:
            first[key] = i
            assert (r["record_type"], r["refers_to"]) == ("response", None)


def test_empty_archive(spark):
    folder = work_path(spark, "w")
    assert warc.read_records(warc.history(warc.archived(pages(spark, []), folder), folder)).count() == 0


def test_archives_are_in_order_and_hold_odd_rows(spark):
    big = "<p>" + "z" * 200
    rows = [(5, "http://b/1", big), (5, "http://b/2", big), (7, "http://a/3", big), (None, "http://c/4", big), (None, None, None), (9, "http://c/4", "x")]
    docs = pages(spark, rows).selectExpr("*", "1 AS digest", "2 AS payload", "3 AS refers_to").coalesce(1)
    folder = work_path(spark, "w")
    runs = warc.archived(docs, folder)
    offsets = {}
    for r in runs.collect():
        got = list(warc.read_run(r["run"]))
        assert [warc.capture_key(x) for x in got] == sorted(warc.capture_key(x) for x in got)
        assert [x[4] for x in got] == sorted(x[4] for x in got)  # places in the archive have the order of the run
        offsets.update({x[3]: None for x in got})
    assert len(offsets) == runs.count()
    got = warc.read_records(warc.history(runs, folder), 3).collect()
    assert sorted(((r["page_id"] or 0, r["record_type"], r["refers_to"]) for r in got), key=repr) == sorted(
        [(5, "response", None), (5, "response", None), (7, "revisit", 5), (0, "response", None), (0, "response", None), (9, "response", None)], key=repr
    )
