import json
import re
import subprocess
import sys
from pathlib import Path

import pytest

from jobs import embedding_requests, index_pages
from jobs.command import settings
from jobs.queries import ORACLES, QUERIES
from pagelode.operators.chunking import page_chunks

ROOT = Path(__file__).parent.parent
SF = "/root/testdata/sf0.001"
BODY = "Word after word makes a text of more than forty characters, numbered "


def page(title, *paragraphs):
    return f"<title>{title}</title><main><h2>Head</h2>{''.join(f'<p>{BODY}{x}</p>' for x in paragraphs)}</main>"


def arrive(spark, folder, rows):
    spark.createDataFrame(rows, index_pages.INPUT).coalesce(1).write.mode("append").parquet(str(folder))


def index(spark, tmp, **more):
    return index_pages.run(spark, str(tmp / "in"), str(tmp / "out"), str(tmp / "mark"), **more)


def held(spark, tmp):
    rows = index_pages.current_chunks(spark, str(tmp / "out")).collect()
    assert len({r["point_id"] for r in rows}) == len(rows)
    return {r["url"]: (r["title"], r["chunk_text"]) for r in rows}


FIRST = [(1, "http://h/a", page("A", 1)), (2, "http://h/b", page("B", 1)), (3, "http://h/c", page("C", 1)), (4, "http://h/d", None), (5, None, page("no url", 1))]
SECOND = [
    (11, "http://h/a", page("A", 1)), (12, "http://h/b", page("B2", 2)), (13, "http://h/c", page("C")), (14, "http://h/e", page("E", 1)), (0, "http://h/d", page("old", 9)),
    (15, "http://h/f", page("F", 1)), (15, "http://h/f", page("F", 1)), (16, "http://h/f", page("F", 2)),
]
LAST = {u: (t, f"Head\n\n{BODY}{n}") for u, t, n in (("http://h/a", "A", 1), ("http://h/b", "B2", 2), ("http://h/e", "E", 1), ("http://h/f", "F", 2))}


def test_index_takes_only_what_is_new(spark, tmp_path):
    arrive(spark, tmp_path / "in", FIRST)
    [done] = index(spark, tmp_path)
    assert (done["rows_read"], done["pages_seen"], done["pages_stored"], done["chunks_written"]) == (5, 4, 4, 3)
    assert held(spark, tmp_path) == {f"http://h/{x}": (x.upper(), f"Head\n\n{BODY}1") for x in "abc"}
    assert index(spark, tmp_path) == []
    arrive(spark, tmp_path / "in", SECOND)
    [done] = index(spark, tmp_path)
    # d is older than what is known, a is unchanged, c has lost its text
    assert (done["rows_read"], done["pages_seen"], done["pages_stored"], done["chunks_written"]) == (8, 5, 4, 3)
    assert (done["rows_rejected"], done["rows_superseded"], done["pages_unchanged"], done["pages_emptied"]) == (0, 3, 1, 1)
    assert held(spark, tmp_path) == LAST
    assert index(spark, tmp_path) == [] and held(spark, tmp_path) == LAST
    rejected = index_pages._table(spark, str(tmp_path / "out"), "rejected").collect()
    assert [(r["page_id"], r["url"], r["reason"], r["batch"]) for r in rejected] == [(5, None, "no url", 0)]
    runs = {r["batch"]: r.asDict() for r in index_pages._table(spark, str(tmp_path / "out"), "runs").collect()}
    assert runs[1] == done and runs[0]["rows_read"] == 5 and len(runs) == 2


def test_index_is_the_same_in_any_order_and_at_once(spark, tmp_path):
    for name, parts in (("at once", [FIRST + SECOND]), ("backwards", [SECOND, FIRST]), ("row by row", [[x] for x in SECOND + FIRST])):
        for rows in parts:
            arrive(spark, tmp_path / name / "in", rows)
        done = index(spark, tmp_path / name, files_per_batch=3, snapshot_every=2)
        assert len(done) == -(-len(parts) // 3) and held(spark, tmp_path / name) == LAST, name
        assert [r["snapshot"] for r in done] == [n % 2 == 1 for n in range(len(done))]
    # what is known before a batch is read from the last snapshot and the batches since
    plan = index_pages.seen(spark, str(tmp_path / name / "out"), 4)._jdf.queryExecution().optimizedPlan().toString()
    assert "(batch#" in plan and "= 3)" in plan and "> 3)" in plan
    known = index_pages._table(spark, str(tmp_path / name / "out"), "known")
    assert known.where("batch = 3").count() == len({u for _, u, _ in (SECOND + FIRST)[:12] if u})


def test_a_batch_that_is_run_again_writes_the_same(spark, tmp_path):
    arrive(spark, tmp_path / "in", FIRST)
    index(spark, tmp_path)
    arrive(spark, tmp_path / "in", SECOND)
    index(spark, tmp_path)
    before = sorted(map(repr, index_pages._table(spark, str(tmp_path / "out"), "chunks").collect()))
    again = spark.createDataFrame(SECOND, index_pages.INPUT)
    for _ in range(2):  # as after a loss of the driver between the write and the mark
        index_pages.index_batch(again, 1, str(tmp_path / "out"), index_pages.Selectors(), "Markdown", 2)
    assert sorted(map(repr, index_pages._table(spark, str(tmp_path / "out"), "chunks").collect())) == before and held(spark, tmp_path) == LAST


def test_index_of_an_empty_folder(spark, tmp_path):
    arrive(spark, tmp_path / "in", [])
    index(spark, tmp_path)
    assert held(spark, tmp_path) == {}


def documents(spark, folder, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, point_id string").write.mode("overwrite").parquet(folder)


def test_each_text_is_asked_once(spark, tmp_path):
    texts = [" ".join(f"word{n}x{i}" for i in range(20 + n % 7)) for n in range(60)]
    rows = [(n, t, "en" if n % 3 else None, f"s{n}", "clash") for n, t in enumerate(texts)]
    rows += [(100 + n, texts[1], "en", "copy", "clash") for n in range(30)] + [(200, None, "en", "s", ""), (201, "", "en", "s", ""), (None, texts[1], "en", "s", ""), (202, "short", "en", None, "")]
    documents(spark, str(tmp_path / "docs"), rows)
    told = [embedding_requests.run(spark, str(tmp_path / "docs"), str(tmp_path / "out"), 200, 4, 16) for _ in range(2)]
    assert told[0] == told[1] and told[0]["documents_read"] == len(rows) and told[0]["points_written"] == 90 and told[0]["texts_written"] == 60
    got = embedding_requests.joined(spark, str(tmp_path / "out")).collect()
    expected = {(f"doc://{n}", t, lang or "und") for n, t, lang, _, _ in rows if n is not None and page_chunks(None, t)}
    assert {(r["url"], r["chunk_text"], r["lang"]) for r in got} == expected and len(got) == 90
    assert all(r["chunk_hash"] == r["text_hash"] for r in got)
    asked = {(r["lang"], r["chunk_hash"]): (r["request"], r["position"], r["n_tokens"], r["n_points"]) for r in got}
    assert max(x[3] for x in asked.values()) == 31
    by_request = {}
    for request, position, tokens, _ in asked.values():
        by_request.setdefault(request, []).append((position, tokens))
    assert len({r.split("-")[1] for r in by_request}) == 4  # buckets of 16 texts
    for places in by_request.values():
        assert sorted(p for p, _ in places) == list(range(len(places))) and len(places) <= 5
        assert sum(t for _, t in sorted(places)[:-1]) <= 200


def test_texts_with_vectors_are_not_asked_again_and_ids_count_once(spark, tmp_path):
    texts = [f"text number {n} " + "and more words " * 5 for n in range(8)]
    documents(spark, str(tmp_path / "docs"), [(n, t, "en", "s", "") for n, t in enumerate(texts)] + [(3, texts[4], "fr", "s", ""), (3, texts[3], "en", "s", "")])
    run = lambda name, **more: embedding_requests.run(spark, str(tmp_path / "docs"), str(tmp_path / name), **more)
    assert run("a")["points_written"] == 8
    asked = spark.read.schema(embedding_requests.REQUESTS).json(str(tmp_path / "a/requests"))
    done = [r["chunk_hash"] for r in asked.orderBy("chunk_hash").limit(3).collect()]
    spark.createDataFrame([(x, 1.0) for x in done], "chunk_hash string, v double").write.parquet(str(tmp_path / "vectors"))
    told = run("b", vectors=str(tmp_path / "vectors"))
    assert told["points_written"] == 8 and told["texts_written"] == run("a")["texts_written"] - 3
    left = embedding_requests.joined(spark, str(tmp_path / "b")).where("request IS NULL").select("chunk_hash").distinct().collect()
    assert sorted(r["chunk_hash"] for r in left) == done


def test_requests_of_an_empty_table(spark, tmp_path):
    documents(spark, str(tmp_path / "docs"), [])
    assert embedding_requests.run(spark, str(tmp_path / "docs"), str(tmp_path / "out"))["texts_written"] == 0
    assert embedding_requests.joined(spark, str(tmp_path / "out")).count() == 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_oracle(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    mine, theirs = QUERIES[name](spark, SF), con.execute(ORACLES[name])
    names = [x[0] for x in theirs.description]
    assert sorted(mine.columns) == sorted(names)
    assert sorted(repr(tuple(r)) for r in mine.select(*names).collect()) == sorted(map(repr, theirs.fetchall()))


def test_settings(tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"input": "a", "output": "b", "files_per_batch": 5}))
    own = settings(["--config", str(path), "--output", "c", "--checkpoint", "d"], index_pages.DEFAULTS, "")
    assert own == index_pages.DEFAULTS | {"input": "a", "output": "c", "checkpoint": "d", "files_per_batch": 5}
    with pytest.raises(ValueError, match="no value for: output"):
        settings(["--input", "x"], embedding_requests.DEFAULTS, "")
    path.write_text(json.dumps({"inptu": "a"}))
    with pytest.raises(ValueError, match="inptu"):
        settings(["--config", str(path)], embedding_requests.DEFAULTS, "")


def test_configurations_that_are_shipped_name_known_settings():
    for job in (index_pages, embedding_requests):
        own = json.loads((ROOT / "jobs" / f"{job.__name__.rpartition('.')[2]}.json").read_text())
        assert own and all(job.DEFAULTS[k] == v for k, v in own.items())


def test_command_line(tmp_path):
    args = ["--config", "jobs/embedding_requests.json", "--input", f"{SF}/documents.parquet", "--output", str(tmp_path / "out")]
    done = subprocess.run([sys.executable, "-m", "jobs.embedding_requests", *args], cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0 and re.search("'documents_read': 200", done.stderr), done.stderr[-2000:]
    assert any((tmp_path / "out/requests").glob("lang=*/*.json")) and any((tmp_path / "out/points").glob("lang=*/*.parquet"))


def test_jobs_stand_without_the_training_data_operators():
    for path in [*(ROOT / "jobs").glob("*.py"), Path(__file__)]:
        names = re.findall(r"^\s*(?:from|import)\s+([\w.]+)", path.read_text(), re.M)
        assert not [n for n in names if "llm" in n.split(".") or n.startswith("corpus")], path
