import datetime
import io
import json

import pytest
from pyspark.sql import functions as F

from pagelode import streaming
from pagelode.functions.html import Selectors
from pagelode.operators import crawl, search
from pagelode.operators.embed import EmbeddingError, EmbeddingProvider, HashProvider, HttpProvider, RetryingProvider, create_provider, embedded, whole_pages
from pagelode.operators.store import ChunkStore, classified, replaced
from pagelode.plans import cli, tools
from pagelode.sources import config, fetch, models, robots, sitemap
from pagelode.sources.config import CrawlConfig, EmbeddingConfig, SiteConfig

DAY1, DAY2 = datetime.datetime(2024, 1, 1), datetime.datetime(2024, 2, 1)


class Fake(EmbeddingProvider):
    name, dimensions = "fake", 2

    def __init__(self, failures=0):
        self.failures, self.calls = failures, 0

    def embed_batch(self, texts):
        self.calls += 1
        if self.calls <= self.failures:
            raise RuntimeError("boom")
        return [[1.0, 2.0] for _ in texts]


def test_retry_once():
    fake, waits = Fake(1), []
    assert RetryingProvider(fake, 1, sleep=waits.append).embed("x") == [1.0, 2.0] and fake.calls == 2 and waits == [1.0]


def test_retry_wraps_the_last_failure():
    with pytest.raises(EmbeddingError) as e:
        RetryingProvider(Fake(99), 0).embed_batch(["x"])
    assert (e.value.provider, e.value.operation, e.value.attempts) == ("fake", "batch embedding", 1) and isinstance(e.value.__cause__, RuntimeError)
    assert all(x in str(e.value) for x in ("fake", "batch embedding", "1", "boom"))


def test_providers():
    with pytest.raises(ValueError, match="onnx, openai"):
        create_provider(EmbeddingConfig("nope"))
    with pytest.raises(ValueError, match="API key"):
        create_provider(EmbeddingConfig("openai"))
    sent = []

    def opened(request):
        sent.append((request.full_url, json.loads(request.data)))
        return io.BytesIO(json.dumps({"data": [{"index": 1, "embedding": [2]}, {"index": 0, "embedding": [1]}]}).encode())

    assert HttpProvider("ollama", "http://x/v1/", "org/model", 3, None, False, opened).embed_batch(["a", "b"]) == [[1], [2]]
    HttpProvider("openai", "http://x/v1", "m", 3, "k", True, opened).embed_batch(["a"])
    assert sent == [("http://x/v1/embeddings", {"model": "model", "input": ["a", "b"]}), ("http://x/v1/embeddings", {"model": "m", "input": ["a"], "dimensions": 3})]


def test_requests_are_cut(monkeypatch):
    sizes = []

    def opened(request):
        texts = json.loads(request.data)["input"]
        sizes.append(len(texts))
        return io.BytesIO(json.dumps({"data": [{"index": i, "embedding": [float(t)]} for i, t in enumerate(texts)]}).encode())

    own = HttpProvider("ollama", "http://x/v1", "m", 1, None, False, opened, most_texts=4)
    assert own.embed_batch([str(i) for i in range(10)]) == [[float(i)] for i in range(10)] and sizes == [4, 4, 2] and own.embed_batch([]) == []
    waits = []
    monkeypatch.setattr("urllib.request.urlopen", lambda request, timeout: waits.append(timeout) or opened(request))
    HttpProvider("ollama", "http://x/v1", "m", 1, None, False, timeout=7).embed_batch(["1"])
    assert waits == [7]


def varint(n):
    return bytes([n]) if n < 128 else bytes([n & 127 | 128]) + varint(n >> 7)


def message(*fields):
    """Protocol buffer bytes of (number, value) fields: numbers, bytes or texts."""
    out = b""
    for number, value in fields:
        if isinstance(value, int):
            out += varint(number << 3) + varint(value)
        else:
            data = value if isinstance(value, bytes) else value.encode()
            out += varint(number << 3 | 2) + varint(len(data)) + data
    return out


def two_node_model(table):
    """A model that looks up each input id in a table: a Cast and a Gather."""
    import numpy as np

    def shape(kind, *dims):
        return message((1, message((1, kind), (2, message(*((1, message((2, d)) if isinstance(d, str) else message((1, d))) for d in dims))))))

    def value(name, kind, *dims):
        return message((1, name), (2, shape(kind, *dims)))

    weights = message((1, len(table)), (1, len(table[0])), (2, 1), (8, "table"), (9, np.array(table, "<f4").tobytes()))
    cast = message((1, "input_ids"), (2, "ids"), (4, "Cast"), (5, message((1, "to"), (3, 6), (20, 2))))
    gather = message((1, "table"), (1, "ids"), (2, "states"), (4, "Gather"))
    nodes = ((1, cast), (1, gather), (2, "g"), (5, weights))
    ends = ((11, value("input_ids", 7, "b", "n")), (11, value("attention_mask", 7, "b", "n")), (12, value("states", 1, "b", "n", len(table[0]))))
    return message((1, 8), (7, message(*nodes, *ends)), (8, message((1, ""), (2, 13))))


def test_a_local_model(tmp_path):
    import numpy as np

    words = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]", "red", "green", "##ish"]
    (tmp_path / "vocab.txt").write_text("\n".join(words))
    table = [[float((i * 7 + j * 3) % 5 - 2 + i / 10) for j in range(4)] for i in range(len(words))]
    (tmp_path / "model.onnx").write_bytes(two_node_model(table))
    own = create_provider(EmbeddingConfig("onnx", dimensions=4, model_path=str(tmp_path)))

    def expect(*pieces):
        mean = np.mean([table[words.index(p)] for p in ("[CLS]", *pieces, "[SEP]")], axis=0)
        return mean / np.linalg.norm(mean)

    got = own.embed_batch(["Red", "greenish red", "unheard"])
    for vector, pieces in zip(got, (["red"], ["green", "##ish", "red"], ["[UNK]"])):
        assert np.allclose(vector, expect(*pieces), atol=1e-6)  # padding doesn't count
    assert np.allclose(own.embed("red " * 600), expect(*["red"] * 510), atol=1e-6)  # cut at 512 places
    assert own.embed_batch([]) == []
    with pytest.raises(FileNotFoundError):
        create_provider(EmbeddingConfig("onnx", model_path=str(tmp_path / "none")))


class Picky(HashProvider):
    def embed_batch(self, texts):
        if any("bad" in t for t in texts):
            raise RuntimeError("refused")
        return super().embed_batch(texts)


def test_failures_stay_with_their_page(spark):
    rows = spark.createDataFrame([("a", "fine"), ("a", "bad word"), ("b", "fine too")], "url string, chunk_text string")
    got = embedded(rows, lambda: Picky(8))
    assert got.where("embed_error IS NOT NULL").count() == 1 and [r["url"] for r in whole_pages(got).collect()] == ["b"]


# -- sources -------------------------------------------------------------------------------------------------


def test_robots():
    r = robots.parse(
        "Disallow: /none\nUser-agent: *\nDisallow: /A # note\nDisallow:\nCrawl-delay: 2\nno colon\nUSER-AGENT: pagelode\nUser-agent: other\nDisallow: /o\n"
        "User-agent: my-PageLode/2\nDisallow: /p\nCrawl-delay: x\nSitemap: http://h/s.xml"
    )
    assert (r.disallowed, r.crawl_delay_ms, r.sitemaps) == (["/A", "/p"], 2000, ["http://h/s.xml"])
    assert not r.allows("/abc") and r.allows("/o") and robots.parse(None).allows("/")


def test_sitemaps(spark):
    ns = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
    web = {
        "http://h/i.xml": f"<sitemapindex {ns}><sitemap><loc> http://h/a.xml </loc></sitemap><sitemap><loc>http://h/i.xml</loc></sitemap></sitemapindex>",
        "http://h/a.xml": "<urlset><url><loc>http://h/1</loc></url><url><loc>http://g/2</loc></url><url><loc>http://h/1</loc></url><url><loc>x</loc></url></urlset>",
        "http://h/b.xml": "<urlset><url>",
    }
    answers = spark.createDataFrame([(k, v) for k, v in web.items()], "url string, html string")
    roots = spark.createDataFrame([("http://h/", "http://h/i.xml"), ("http://h/", "http://h/b.xml"), ("http://h/", "http://h/missing")], "site_url string, url string")
    found = sitemap.expanded(roots, lambda u: fetch.from_snapshot(u, answers))
    assert sorted(r["url"] for r in found.collect()) == ["http://g/2", "http://h/1", "x"] and [r["url"] for r in sitemap.on_site(found).collect()] == ["http://h/1"]


def test_deep_sitemap_indexes(spark):
    web = {f"http://h/{k}.xml": f"<sitemapindex><sitemap><loc>http://h/{k + 1}.xml</loc></sitemap></sitemapindex>" for k in range(21)}
    web["http://h/21.xml"] = "<urlset><url><loc>http://h/deep</loc></url></urlset>"
    answers = spark.createDataFrame(list(web.items()), "url string, html string")
    roots = spark.createDataFrame([("http://h/", "http://h/0.xml")], "site_url string, url string")
    found = sitemap.expanded(roots, lambda u: fetch.from_snapshot(u, answers))
    assert [r["url"] for r in found.collect()] == ["http://h/deep"]


def test_fetch_retries():
    answers, waits = [(503, None), (0, None), (200, "ok")], []
    assert fetch.get_with_retry(lambda u: answers.pop(0), "u", sleep=waits.append) == "ok" and waits == [1.0, 2.0]
    assert fetch.get_with_retry(lambda u: (404, None), "u", sleep=waits.append) is None and fetch.get_with_retry(lambda u: (500, None), "u", 1, sleep=waits.append) is None
    assert waits == [1.0, 2.0, 1.0]


def test_fetched_column(spark):
    urls = spark.createDataFrame([("http://a/1", 1), ("http://a/2", None), ("http://b/1", None)], "url string, crawl_delay_ms int")
    got = fetch.fetched(urls, lambda: lambda u: (200, f"page {u}") if "2" not in u else (404, None), 2)
    assert {r["url"]: r["html"] for r in got.collect()} == {"http://a/1": "page http://a/1", "http://a/2": None, "http://b/1": "page http://b/1"}


def test_delays_hold_between_pages_of_a_host(spark):
    """Also from one Arrow batch to the next, and not between hosts."""
    import pyarrow as pa

    waits, rows = [], [("http://a/1", "a"), ("http://a/2", "a"), ("http://b/1", "b"), ("http://b/2", "b")]

    class Plan:  # runs what the workers get here
        columns, schema = ["url"], spark.createDataFrame([], "url string").schema

        def withColumn(self, *_):
            return self

        def repartition(self, *_):
            return self

        def sortWithinPartitions(self, *_):
            return self

        def mapInArrow(self, run, _):
            return list(run(pa.RecordBatch.from_pydict({"url": [u], "_host": [h]}) for u, h in rows))

    assert len(fetch.fetched(Plan(), lambda: lambda u: (200, u), 2, 250, sleep=waits.append)) == 4 and waits == [0.25, 0.25]


def test_config(tmp_path):
    path = tmp_path / "c.json"
    path.write_text('{ // note\n "Crawl": {"sites": [{"URL": "http://h/?a=//b,]", "maxDepth": 1, "mode": "TEXT",}, /* x */], "requestDelayMs": 5}, "embedding": {"provider": "ollama"},}')
    c = config.load(str(path), ["--Store", "s1", "--store", "s2"], {"EMBEDDING_PROVIDER": "openai", "OPENAI_API_KEY": "k", "AZURE_OPENAI_API_KEY": "az"})
    assert (c.crawl.sites[0].url, c.crawl.sites[0].max_depth, config.site_mode(c.crawl.sites[0], c.crawl)) == ("http://h/?a=//b,]", 1, "Text")
    assert (c.store.path, c.embedding.provider, c.embedding.api_key, c.crawl.request_delay_ms) == ("s1", "openai", "k", 5)
    assert config.load(None, [], {"EMBEDDING_PROVIDER": "azure-openai", "OPENAI_API_KEY": "k", "AZURE_OPENAI_API_KEY": "az"}).embedding.api_key == "az"
    assert config.load("missing", [], {}).crawl.max_concurrency == 4 and EmbeddingConfig(model="a/b/c").resolve_model_path().endswith("/models/c")
    with pytest.raises(ValueError):
        config.mode_of("pdf")


def test_model_download(tmp_path):
    c = EmbeddingConfig(model_path=str(tmp_path / "m"))
    with pytest.raises(FileNotFoundError):
        models.ensure_model(c, ask=lambda q: "n")
    with pytest.raises(ConnectionError):  # an empty answer means yes
        models.ensure_model(c, ask=lambda q: "", opened=lambda url: (_ for _ in ()).throw(ConnectionError()))

    class Answer(io.BytesIO):
        headers = {"Content-Length": "3"}

    model, vocab = models.ensure_model(c, auto=True, opened=lambda url: Answer(b"abc"))
    assert open(model, "rb").read() == b"abc" == open(vocab, "rb").read() and models.ensure_model(c) == (model, vocab)


# -- store, crawl, search ------------------------------------------------------------------------------------


def body(*links, text="words"):
    anchors = "".join(f'<a href="{x}">{x}</a>' for x in links)
    return f"<html><head><title>T {text}</title></head><main><h1>Head</h1><p>{(text + ' ') * 30}</p>{anchors}</main></html>"


WEB = {
    "http://h": body("/a", "/B/", "/no/x", "http://g/", text="root"),
    "http://h/a": body("/c", "/", "/b", text="alpha"),
    "http://h/B": body("/c", "/a#x", text="beta"),
    "http://h/c": body("/d", text="gamma"),
    "http://h/d": body("/e", text="delta"),
    "http://h/robots.txt": "User-agent: *\nDisallow: /NO",
    "http://h/no/x": body(text="hidden"),
}
CRAWL = CrawlConfig(sites=[SiteConfig("http://h/", 2, selectors=Selectors(content="main"))])


def snapshot(spark, web):
    answers = spark.createDataFrame(list(web.items()), "url string, html string")
    return lambda urls: fetch.from_snapshot(urls, answers)


def test_breadth_first(spark):
    pages = crawl.crawl_pages(crawl.site_rows(spark, CRAWL), CRAWL, snapshot(spark, WEB))
    assert {r["url"]: r["depth"] for r in pages.collect()} == {"http://h": 0, "http://h/a": 1, "http://h/B": 1, "http://h/c": 2}


def test_sitemap_seeds_replace_the_site(spark):
    web = WEB | {"http://h/robots.txt": "Sitemap: http://h/s.xml", "http://h/s.xml": "<urlset><url><loc>http://h/d/</loc></url></urlset>"}
    pages = crawl.crawl_pages(crawl.site_rows(spark, CRAWL), CRAWL, snapshot(spark, web))
    assert {r["url"]: r["depth"] for r in pages.collect()} == {"http://h/d": 0}


def provider():
    return HashProvider(16)


@pytest.fixture
def store(spark, tmp_path):
    return ChunkStore(spark, f"file://{tmp_path}/index", 16)


def test_index_delta_and_replace(spark, store):
    sites = crawl.site_rows(spark, CRAWL)
    first = crawl.index_batch(crawl.crawl_pages(sites, CRAWL, snapshot(spark, WEB)), store, provider, DAY1).first()
    assert (first["pages_seen"], first["pages_stored"], first["pages_failed"]) == (4, 4, 0)
    changed = WEB | {"http://h/a": body("/c", text="changed")}
    second = crawl.index_batch(crawl.crawl_pages(sites, CRAWL, snapshot(spark, changed)), store, provider, DAY2).first()
    assert (second["pages_seen"], second["pages_stored"]) == (4, 1)
    dates = {r["url"]: r["capture_date"] for r in store.chunks().select("url", "capture_date").distinct().collect()}
    assert dates["http://h/a"] == DAY2 and dates["http://h"] == DAY1
    seen = {r["url"]: r["last_checked"] for r in store.pages().collect()}
    assert seen["http://h"] == DAY2 and store.count() == 4
    with pytest.raises(ValueError, match="dimensions"):
        ChunkStore(spark, store.path, 8).ensure()
    store.replace_pages(store.chunks().limit(0))
    assert len(store.versions()) == 3
    store.vacuum(1)
    assert len(store.versions()) == 1 and store.count() == 4


def page_row(spark, *rows):
    schema = "url string, title string, summary string, content_selector string, sections array<struct<heading:string,text:string>>, body_text string"
    return spark.createDataFrame([(u, "t", "", "", [("h", x)] if x else [], x) for u, x in rows], schema)


def test_only_touched_buckets_are_written(spark, store):
    long = "words that make a chunk of enough length to be kept in the table"
    urls = [f"http://h/{i}" for i in range(40)]
    crawl.index_batch(page_row(spark, *((u, long) for u in urls)), store, provider, DAY1).collect()
    one = store._latest()
    report = crawl.index_batch(page_row(spark, (urls[0], ""), (urls[1], long + " more"), (urls[2], long), ("http://h/new", "")), store, provider, DAY2).first()
    assert (report["pages_seen"], report["pages_stored"], report["chunks_stored"]) == (4, 1, 1)
    two = store._latest()
    moved = {b for b in one["chunks"] if two["chunks"].get(b) != one["chunks"][b]}
    buckets = {r["b"] for r in spark.createDataFrame([(u,) for u in (*urls[:2], "http://h/new")], "url string").selectExpr("cast(conv(substr(md5(url), 1, 8), 16, 10) as long) % 64 as b").collect()}
    assert moved <= set(map(str, buckets)) and len(moved) >= 1
    held = {r["url"] for r in store.chunks().collect()}
    assert held == set(urls[1:])  # the page that lost its text has no chunk left
    pages = {r["url"]: (r["n_chunks"], r["capture_date"], r["last_checked"]) for r in store.pages().collect()}
    assert pages[urls[0]] == (0, DAY2, DAY2) and pages["http://h/new"] == (0, DAY2, DAY2) and pages[urls[2]] == (1, DAY1, DAY2) and pages[urls[3]] == (1, DAY1, DAY1)
    assert [r["url"] for r in store.chunks(urls[5]).where(F.col("url") == urls[5]).collect()] == [urls[5]]
    again = crawl.index_batch(page_row(spark, (urls[0], "")), store, provider, DAY2).first()
    assert again["pages_stored"] == 0 and store._latest()["chunks"] == two["chunks"]
    store.vacuum(1)
    assert store.count() == 39 and store.pages().count() == 41


def test_a_page_that_fails_stays_as_it_was(spark, store):
    long = "words that make a chunk of enough length to be kept in the table"
    crawl.index_batch(page_row(spark, ("http://h/a", long), ("http://h/b", long)), store, lambda: Picky(16), DAY1).collect()
    report = crawl.index_batch(page_row(spark, ("http://h/a", long + " bad"), ("http://h/b", long + " good")), store, lambda: Picky(16), DAY2).first()
    assert (report["pages_stored"], report["pages_failed"]) == (1, 1)
    assert {r["url"]: r["capture_date"] for r in store.chunks().collect()} == {"http://h/a": DAY1, "http://h/b": DAY2}
    assert {r["url"]: r["capture_date"] for r in store.pages().collect()} == {"http://h/a": DAY1, "http://h/b": DAY2}


def test_classify_and_replace(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", None)], "url string, content_hash string")
    new = spark.createDataFrame([("a", "1"), ("b", "3"), ("c", "4"), ("d", None)], "url string, content_hash string")
    assert {r["url"]: r["change"] for r in classified(new, old).collect()} == {"a": "unchanged", "b": "changed", "c": "new", "d": "unchanged"}
    assert sorted(tuple(r) for r in replaced(old, new.where("url = 'b'"), "url").collect() if r[1]) == [("a", "1"), ("b", "3")]


def test_search_and_tools(spark, store):
    crawl.index_batch(crawl.crawl_pages(crawl.site_rows(spark, CRAWL), CRAWL, snapshot(spark, WEB)), store, provider, DAY1).collect()
    query = provider().embed("alpha")
    rows = search.results(search.search(store.chunks(), query, 2)).collect()
    assert rows[0]["url"] == "http://h/a" and rows[0]["score"] > 0.3
    assert search.search(store.chunks(), query, 2, 5, DAY2).count() == 0 and search.search(store.chunks(), query, 2, 60, DAY2).count() >= 1
    t = tools.Tools(store, provider(), ["http://h/"], DAY2)
    assert "http://h/a" in t.search_web_pages("alpha") and t.search_web_pages("alpha", stale_days=1) == "No results found."
    assert t.get_page("http://h/a").startswith("# T alpha") and "No page" in t.get_page("nope")
    assert t.list_urls().startswith("4 pages") and t.list_urls(60) == "No pages are older than 60 days." and "http://h/c" in t.list_urls(10)
    assert "Chunks: 4" in t.crawl_status()
    assert json.loads(tools.as_json(search.search(store.chunks(), query, 1)))[0]["url"] == "http://h/a" and "Title: T alpha" in tools.as_text(search.search(store.chunks(), query, 1))
    out = io.StringIO()
    calls = [{"id": 1, "method": "initialize"}, {"id": 2, "method": "tools/list"}, {"id": 3, "method": "tools/call", "params": {"name": "crawl_status"}}, {"id": 4, "method": "x"}, {"method": "note"}]
    cli.serve(t, [json.dumps(c) for c in calls], out)
    answers = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [a["id"] for a in answers] == [1, 2, 3, 4] and len(answers[1]["result"]["tools"]) == 4 and "error" in answers[3]


def test_search_plans(spark, store):
    store.ensure()
    plan = search.search(store.chunks(), [0.1] * 16, 3, 5, DAY2)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "capture_date" in plan.split("PushedFilters")[1][:200]


def test_batch_search_equals_single(spark):
    rows = spark.createDataFrame([(i, [float((i * 7 + j * 3) % 11 - 5) for j in range(6)]) for i in range(60)], "vec_id long, embedding array<float>")
    got = search.top_k_batch(rows.repartition(2), rows.where("vec_id < 7").withColumnRenamed("vec_id", "query_id"), 4, part_rows=3).collect()
    for q in range(7):
        own = sorted((r["rank"], r["id"], round(r["score"], 9)) for r in got if r["query_id"] == q)
        one = search.top_k(rows, rows.where(F.col("vec_id") == q).first()["embedding"], 4, None, "vec_id").collect()
        assert [x[2] for x in own] == [round(r["score"], 9) for r in one]


def test_command_line(spark, tmp_path, capsys):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"crawl": {"sites": [{"url": "http://h/", "maxDepth": 2, "selectors": {"content": "main"}}]}, "embedding": {"provider": "hash", "dimensions": 16}}))
    shared = ["--config", str(path), "--store", f"file://{tmp_path}/s"]
    assert cli.main(["crawl", *shared], spark, snapshot(spark, WEB)) == 0
    assert cli.main(["search", "alpha", "--json", *shared], spark) == 0
    assert json.loads(capsys.readouterr().out)[0]["url"] == "http://h/a"
    assert cli.main(["search", "x", *shared, "--embedding-provider", "nope"], spark) == 1
    assert cli.main(["crawl", "--due", *shared], spark, None) == 0  # crawled a moment ago: nothing is fetched
    assert "no site is due" in capsys.readouterr().err


def test_a_provider_that_fails_ends_the_command(spark, tmp_path, capsys):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"embedding": {"provider": "ollama", "endpoint": "http://127.0.0.1:9/v1", "maxRetries": 0, "dimensions": 4}}))
    store = ChunkStore(spark, f"file://{tmp_path}/s/web_pages", 4)
    assert not store.exists()
    store.ensure()
    assert store.exists() and cli.main(["search", "x", "--config", str(path), "--store", f"file://{tmp_path}/s"], spark) == 1
    assert "ollama" in capsys.readouterr().err


def test_stream_of_snapshots(spark, store, tmp_path):
    folder = str(tmp_path / "in")

    def put(name, rows):
        spark.createDataFrame(rows, streaming.SNAPSHOT).coalesce(1).write.mode("append").parquet(folder)

    put("1", [("http://h/a", body(text="old"), DAY1), ("http://h/a", body(text="new"), DAY2), ("http://h/b", body(text="beta"), DAY1)])
    run = lambda: streaming.index_stream(streaming.snapshots(spark, folder), store, provider, str(tmp_path / "cp"), Selectors(content="main")).awaitTermination()
    run()
    assert {r["url"]: r["title"] for r in store.chunks().collect()} == {"http://h/a": "T new", "http://h/b": "T beta"}
    put("2", [("http://h/b", body(text="better"), DAY2)])
    run()
    run()
    assert {r["url"]: r["title"] for r in store.chunks().collect()} == {"http://h/a": "T new", "http://h/b": "T better"}


def test_due_sites(spark):
    rows = spark.createDataFrame([("a", 24, DAY1), ("b", 24, None), ("c", 24 * 60, DAY1)], "url string, frequency_hours int, last_crawled timestamp")
    assert sorted(r["url"] for r in crawl.due(rows, DAY2).collect()) == ["a", "b"]


class Counting(EmbeddingProvider):
    """Notes how many texts of which lengths it is given at a time, in a file as it runs in workers."""

    name, dimensions = "counting", 1

    def __init__(self, path):
        self.path = path

    def embed_batch(self, texts):
        with open(self.path, "a") as f:
            f.write(json.dumps([len(t) for t in texts]) + "\n")
        if any("bad" in t for t in texts):
            raise RuntimeError("bad text")
        return [[float(len(t))] for t in texts]


def test_texts_are_embedded_once_and_with_texts_of_their_length(spark, tmp_path):
    from pagelode.operators.embed import batches_by_length, embedded_once

    assert batches_by_length([5, 1, 9, 1, 30, 2], 10) == [[1, 3, 5], [0], [2], [4]] and batches_by_length([]) == []
    texts = ["x" * (1 + n % 50) for n in range(400)] + ["bad", None, ""]
    rows = spark.createDataFrame([(n, t, "own") for n, t in enumerate(texts)], "id int, chunk_text string, _text string").coalesce(1)
    path = str(tmp_path / "calls")
    got = {r["id"]: r for r in embedded_once(rows, lambda: Counting(path), batch_chars=100).collect()}
    assert len(got) == len(texts) and all(got[n]["embedding"] == [float(len(t or ""))] for n, t in enumerate(texts) if t != "bad")
    assert "bad text" in got[400]["embed_error"] and got[400]["embedding"] is None and got[0]["_text"] == "own"
    calls = [json.loads(x) for x in open(path)]
    assert all(len(c) == 1 or max(c) * len(c) <= 100 for c in calls)
    assert sum(map(len, calls)) <= 52 + 52  # each text once, those of the batch with the bad one again one by one


def test_what_was_seen_is_not_moved_again(spark):
    from pagelode.operators.store import passing

    with passing(spark):
        seen = crawl.Seen(spark)
        for n in range(3):
            seen.add(spark.range(n * 10, n * 10 + 10).select(F.concat(F.lit("k"), "id").alias("key")))
        links = spark.range(25, 40).select(F.concat(F.lit("K"), "id").alias("url"), F.array(F.concat(F.lit("k"), "id")).alias("links"), F.lit("s").alias("site_url"), F.lit(0).alias("depth"), F.lit(3).alias("max_depth"))
        new = crawl.next_frontier(links, seen.keys()).hint("merge")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        try:
            plan = crawl.next_frontier(links, seen.keys())._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert {r["url"] for r in new.collect()} == {f"k{n}" for n in range(30, 40)}
        below_seen = plan[: plan.index("FileScan parquet")].rsplit("LeftAnti", 1)[1]
        assert "Bucketed: true" in plan and below_seen.count("Exchange") == 1  # that of the links
        seen.drop()
