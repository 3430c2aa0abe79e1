"""What Arrow functions make of a batch at a time doesn't grow with the batch."""

import pyarrow as pa
import pytest

from pagelode.functions.html import extract_pages
from pagelode.functions.tables import PIECE_ROWS, pieces
from pagelode.operators.chunking import chunk_pages
from pagelode.operators.embed import HashProvider, embedded

N = 5000
LINE = "Words of a page that are enough for a chunk of its own, number %d."


def test_pieces_hold_the_rows_in_order():
    batch = pa.RecordBatch.from_pydict({"i": list(range(N)), "t": ["x" * 1000] * N})
    none = batch.slice(0, 0)
    got = list(pieces([none, batch, none, batch.slice(7, 5)], 700, 200_000))
    assert [x for b in got for x in b["i"].to_pylist()] == [*range(N), *range(7, 12)]
    assert max(b.nbytes for b in got) <= 200_000 and max(len(b) for b in got) <= 700
    assert [len(b) for b in pieces([batch.slice(0, 3)], 700, 1)] == [1, 1, 1]


def function_of(made, monkeypatch, frame):
    """The Arrow function that `made` hands to Spark."""
    with monkeypatch.context() as m:
        m.setattr(type(frame), "mapInArrow", lambda self, run, schema: run)
        return made(frame)


CASES = {
    "chunks": (chunk_pages, "url string, sections array<struct<heading:string,text:string>>, body_text string", lambda i: (f"u{i}", [{"heading": "h", "text": LINE % i}], LINE % i), "chunk_text", lambda i: "h\n\n" + LINE % i),
    "vectors": (lambda d: embedded(d, lambda: HashProvider(8)), "url string, chunk_text string", lambda i: (f"u{i}", LINE % i), "chunk_text", lambda i: LINE % i),
    "pages": (lambda d: extract_pages(d, fields=("title",)), "url string, html string", lambda i: (f"u{i}", f"<title>{i}</title><p>{LINE % i}"), "title", str),
}


@pytest.mark.parametrize("case", CASES)
def test_a_large_batch_is_taken_in_pieces(spark, monkeypatch, case):
    made, schema, row, column, value = CASES[case]
    run = function_of(made, monkeypatch, spark.createDataFrame([], schema))
    kinds = spark.createDataFrame([row(0)], schema).toArrow().schema
    rows = [dict(zip(kinds.names, row(i))) for i in range(N)]
    got = list(run(iter([pa.RecordBatch.from_pylist(rows, kinds)])))
    assert [x for b in got for x in b["url"].to_pylist()] == [f"u{i}" for i in range(N)]
    assert [x for b in got for x in b[column].to_pylist()] == [value(i) for i in range(N)]
    assert max(len(b) for b in got) <= PIECE_ROWS
