"""Pages to chunk rows."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.tables import pieces
from ..functions.text import MAX_TOKENS, MIN_TOKENS, chunked, with_heading


def page_chunks(sections, body: str | None, most: int = MAX_TOKENS, least: int = MIN_TOKENS, utf16: bool = False) -> list[tuple[str, str]]:
    """(heading, text) of a page's chunks. If no section gives a chunk, the body is chunked as one section without a heading."""
    found = [(s["heading"], t) for s in sections or () for t in chunked(s["text"], most, least, utf16)]
    return found or [("", t) for t in chunked(body, most, least, utf16)]


def chunk_pages(pages: DataFrame, most: int = MAX_TOKENS, least: int = MIN_TOKENS, utf16: bool = False) -> DataFrame:
    """pages (with sections and body_text) as one row a chunk: heading, chunk_index (dense from 0 per page), chunk_text.

    Pages without chunks give no row. One Arrow pass: a fold over strings copies them again and again as SQL.
    """
    names = [n for n in pages.columns if n not in ("heading", "chunk_text", "chunk_index", "sections", "body_text")]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*names).schema]
    schema = ", ".join([*fields, "heading string, chunk_index int, chunk_text string"])

    def run(batches):
        for batch in pieces(batches):
            row, index, headings, texts = [], [], [], []
            for i, (sections, body) in enumerate(zip(batch["sections"].to_pylist(), batch["body_text"].to_pylist())):
                for k, (heading, text) in enumerate(page_chunks(sections, body, most, least, utf16)):
                    row.append(i)
                    index.append(k)
                    headings.append(heading)
                    texts.append(with_heading(heading, text))
            kept = batch.select(names).take(pa.array(row, pa.int32()))
            own = [pa.array(headings, pa.string()), pa.array(index, pa.int32()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays([*kept.columns, *own], names=[*names, "heading", "chunk_index", "chunk_text"])

    return pages.select(*names, "sections", "body_text").mapInArrow(run, schema)
