"""Substring dedup over bytes by hash-compared suffix sorting.

Every byte covered by a string of `LENGTH` bytes that also starts in a document with a smaller id is removed.

1. Texts are kept in block files (see repeats). Each window of LENGTH bytes takes the least-hashed `K`-gram within it (the first
   of equals) as its anchor. A round tells each block which of its anchors are met elsewhere: only there can a window repeat.
2. Consecutive windows with one shared anchor make a stretch of at most 2 * LENGTH - K bytes. Equal stretches of a
   block are sent once, with the smallest doc_id there, to the bucket of their anchor. Of a hot anchor, the windows that a second
   round finds elsewhere are sent, each to the bucket of its own hash.
3. A bucket holds a part of the corpus's suffix array: the suffixes whose beginnings hold its anchors, one per window. Those with
   equal anchors at equal distance are sorted by a merge sort whose comparisons find the common extension of two
   suffixes by binary search over prefix polynomial hashes, and look at the byte behind it. Neighbours in that order that
   share LENGTH bytes by hash are compared byte by byte (a collision splits them), and each class of equal windows
   gets its smallest doc_id. Equal stretches are first taken together.
4. Answers (runs of windows of a stretch that start in a smaller document) return to their block, become ranges of
   bytes per document, and meet the texts in the block's file.

All passes over suffixes are array operations; a merge level works on all segments at once.

Defined results: null text is empty; a null id counts as larger than every other; rows that repeat an id aren't
removed on each other's account; texts shorter than LENGTH bytes keep all; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _Powers, alone, prefix_hashes, texts_as_bytes
from .repeats import (
    ANSWER, BLOB_SCHEMA, FILES, LATE, MET, SENT, Blocks, answers_of, blob_batch, buckets_of, by_target, dealt, get, marked, meet, met, named, own_files, pack, put,
    ranges_by_row, rows_of, runs, steps, sub_blocks, unpack,
)

LENGTH, K = 50, 20
#: Stretches that a task sorts at a time (more only if they have one anchor).
SORTED = 1 << 15
NO_ID = (1 << 63) - 1
_MUL = np.uint64(0xBF58476D1CE4E5B9)


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(32)
    h *= _MUL
    h ^= h >> np.uint64(29)
    return h


def window_anchors(raw: np.ndarray, offsets: np.ndarray, length: int = LENGTH, k: int = K):
    """(windows, place of each window's anchor, hashes of all k-grams, prefix hashes) of a block; no window crosses texts."""
    span = length - k + 1  # k-grams in a window
    n = len(raw) - k + 1
    none = np.empty(0, np.int64)
    if len(raw) < length:
        return none, none, np.empty(0, np.uint64), np.zeros(len(raw) + 1, np.uint64)
    prefix = prefix_hashes(raw)
    _, down = _Powers.get(n)
    h = _mixed((prefix[k:] - prefix[:n]) * down)
    best, place, reach = h, np.arange(n, dtype=np.int32), 1
    while reach < span:  # the first least k-gram of ever longer stretches
        step = min(reach, span - reach)
        later = best[step:] < best[:-step]
        place = np.where(later, place[step:], place[:-step])
        best = np.minimum(best[step:], best[:-step])
        reach += step
    ok = np.ones(len(best), bool)  # best[s] is of the window that starts at s
    cut = offsets[1:-1]
    if len(cut):
        marks = np.zeros(len(raw) + 1, np.int32)
        lo = np.maximum(cut - length + 1, 0)
        np.add.at(marks, lo, 1)
        np.add.at(marks, cut, -1)
        ok = np.cumsum(marks)[: len(best)] == 0
    windows = np.flatnonzero(ok)
    return windows, place[windows].astype(np.int64), h, prefix


def _span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return _mixed((prefix[ends] - prefix[starts]) * _Powers.get(len(prefix))[1][starts])


def _stretches(place: np.ndarray) -> np.ndarray:
    """The first windows of the stretches: consecutive windows with one anchor (texts don't share a place)."""
    return np.flatnonzero(np.r_[True, place[1:] != place[:-1]]) if len(place) else np.zeros(0, np.int64)


def _send_anchors(length: int, k: int, buckets: int):
    def run(batches):
        for block, held in by_target(batches):
            files = own_files(held)
            names, pieces = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
            for _, raw, offs in sub_blocks(rows_of(files)):
                windows, place, h, prefix = window_anchors(raw, offs, length, k)
                first = _stretches(place)
                if len(first):
                    w, last = windows[first], windows[np.r_[first[1:], len(windows)] - 1]
                    names.append(h[place[first]])
                    pieces.append(_span_hashes(prefix, w, last + length) + (place[first] - w).astype(np.uint64) * _MUL)
            yield blob_batch([*named(block, np.concatenate(names), buckets, np.concatenate(pieces)), (block, FILES, files)])

    return run


#: A stretch: its anchor, smallest doc_id and number in the block; how far the anchor is from its first window, and its windows.
_HEAD = np.dtype([("anchor", "<u8"), ("doc", "<i8"), ("at", "<u4"), ("left", "u1"), ("windows", "u1")])


def _send_stretches(length: int, k: int, buckets: int, folder: str):
    """Blocks: the distinct stretches with a shared anchor go to the anchor's bucket, and the names of their windows if the anchor is hot.
    Where they stand is kept in two files."""
    most = 2 * length - k

    def run(batches):
        for block, held in by_target(batches):
            files = own_files(held)
            batch = rows_of(files)
            ids = pc.fill_null(batch["doc_id"].cast(pa.int64()), NO_ID).to_numpy(zero_copy_only=False)
            parts, names = [], [np.empty(0, np.uint64)]
            for i, raw, offs in sub_blocks(batch):
                windows, place, h, _ = window_anchors(raw, offs, length, k)
                first = _stretches(place)
                names.append(h[place[first]])
                parts.append((i, raw, offs, windows[first], place[first], np.diff(np.r_[first, len(windows)])))
            shared, hot = met(np.concatenate(names), answers_of(held, MET), buckets)
            heads, texts, rows, starts, at, single = [], [], [], [], 0, []
            for (i, raw, offs, w, anchor, count), own in zip(parts, names[1:]):
                good, burning = np.flatnonzero((shared & ~hot)[at : at + len(w)]), np.flatnonzero((shared & hot)[at : at + len(w)])
                at += len(w)
                if len(burning):
                    one = np.repeat(w[burning], count[burning]) + steps(count[burning])
                    d = np.searchsorted(offs, one, side="right") - 1
                    single.append((np.lib.stride_tricks.sliding_window_view(raw, length)[one], d + i, one - offs[d]))
                if len(good):
                    w, anchor, count = w[good], anchor[good], count[good]
                    d = np.searchsorted(offs, w, side="right") - 1
                    head = np.zeros(len(w), _HEAD)
                    head["anchor"], head["left"], head["windows"], head["doc"] = own[good], anchor - w, count, ids[d + i]
                    text = np.lib.stride_tricks.sliding_window_view(np.r_[raw, np.zeros(most, np.uint8)], most)[w]
                    text[np.arange(most) >= (count + length - 1)[:, None]] = 0
                    heads.append(head)
                    texts.append(text)
                    rows.append(d + i)
                    starts.append(w - offs[d])
            out, alone_ = [], b""
            if single:
                late, own = _Late.of(*map(np.concatenate, zip(*single)), ids)
                out, alone_ = named(block, own, buckets), put(folder, late.packed()).encode()
            if not heads:
                yield blob_batch([*out, (block, FILES, files + b"\n\n" + alone_)])
                continue
            heads, texts, rows, starts = map(np.concatenate, (heads, texts, rows, starts))
            shape = np.concatenate([heads["left"][:, None], heads["windows"][:, None], texts], axis=1)
            _, head, group = np.unique(np.ascontiguousarray(shape).view(f"V{shape.shape[1]}").ravel(), return_index=True, return_inverse=True)
            least = np.full(len(head), NO_ID, np.int64)
            np.minimum.at(least, group, heads["doc"])
            sent = heads[head]
            sent["doc"], sent["at"] = least, np.arange(len(head))
            by, ends = dealt(sent["anchor"], buckets)
            sizes = sent["windows"].astype(np.int64) + length - 1
            for b, (s, e) in enumerate(zip(np.r_[0, ends[:-1]].tolist(), ends.tolist())):
                if e > s:
                    sel = by[s:e]
                    own = sent[sel]
                    packed = texts[head[sel]][np.arange(most) < sizes[sel][:, None]]
                    out.append((b, SENT, pack(np.array([block, e - s], "<i8"), own["doc"], own["at"], own["left"], own["windows"], packed)))
            counts = np.array([len(head), len(group)], "<i8")
            table = put(folder, pack(counts, least, sent["windows"], group.astype("<u4"), starts.astype("<u4"), rows.astype("<u4")))
            yield blob_batch([*out, (block, FILES, files + b"\n" + table.encode() + b"\n" + alone_)])

    return run


class _Late:
    """The windows of a block whose anchor is hot: the distinct ones, with the smallest doc_id each, and where they stand."""

    def __init__(self, texts: np.ndarray, least: np.ndarray, group: np.ndarray, rows: np.ndarray, starts: np.ndarray):
        self.texts, self.least, self.group, self.rows, self.starts = texts, least, group, rows, starts

    @classmethod
    def of(cls, texts: np.ndarray, rows: np.ndarray, starts: np.ndarray, ids: np.ndarray) -> tuple[_Late, np.ndarray]:
        """With the name of each window."""
        texts = np.ascontiguousarray(texts)
        _, head, group = np.unique(texts.view(f"V{texts.shape[1]}").ravel(), return_index=True, return_inverse=True)
        least = np.full(len(head), NO_ID, np.int64)
        np.minimum.at(least, group, ids[rows])
        late = cls(texts[head], least, group, rows, starts)
        return late, late.names()[group]

    def names(self) -> np.ndarray:
        n, length = self.texts.shape
        at = np.arange(n) * length
        return _span_hashes(prefix_hashes(self.texts.ravel()), at, at + length)

    def packed(self) -> bytes:
        counts = np.array([*self.texts.shape, len(self.group)], "<i8")
        return pack(counts, self.texts, self.least, *(x.astype("<u4") for x in (self.group, self.rows, self.starts)))

    @classmethod
    def read(cls, uri: bytes) -> _Late:
        data = unpack(get(uri.decode()))
        m, length, n = np.frombuffer(data, "<i8", 3).tolist()
        texts, at = np.frombuffer(data, np.uint8, m * length, 24).reshape(m, length), 24 + m * length
        return cls(texts, np.frombuffer(data, "<i8", m, at), *np.frombuffer(data, "<u4", 3 * n, at + 8 * m).reshape(3, n).astype(np.int64))


def _send_late(buckets: int):
    """Blocks: of the windows with hot anchors, those met elsewhere go to the buckets of their own names."""

    def run(batches):
        for block, held in by_target(batches):
            files, out = own_files(held), []
            uri = files.split(b"\n")[2]
            if uri:
                late = _Late.read(uri)
                names = late.names()
                some = np.flatnonzero(met(names[late.group], answers_of(held, MET), buckets)[0][np.unique(late.group, return_index=True)[1]])
                by, ends = dealt(names[some], buckets)
                for b, (s, e) in enumerate(zip(np.r_[0, ends[:-1]].tolist(), ends.tolist())):
                    if e > s:
                        sel = some[by[s:e]]
                        one = np.ones(len(sel), "u1")
                        out.append((b, SENT, pack(np.array([block, e - s], "<i8"), late.least[sel], sel.astype("<u4"), one - 1, one, late.texts[sel])))
            yield blob_batch([*out, (block, FILES, files), *((block, ANSWER, x) for x in answers_of(held))])

    return run


class SuffixSorter:
    """Sorts suffixes, given by their places in one byte array, within segments, by their first `length` bytes."""

    def __init__(self, raw: np.ndarray, length: int):
        self.raw = np.r_[raw, np.zeros(length, np.uint8)]
        self.length = length
        self.prefix = prefix_hashes(self.raw)
        _, self.down = _Powers.get(len(self.prefix))

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common extension of suffix pairs, up to length: binary search over prefix hashes."""
        low = np.zeros(len(a), np.int64)
        high = np.full(len(a), self.length)
        pa_, pb, da, db = self.prefix[a], self.prefix[b], self.down[a], self.down[b]
        while True:
            mid = (low + high + 1) >> 1
            if (low >= high).all():
                return low
            same = (self.prefix[a + mid] - pa_) * da == (self.prefix[b + mid] - pb) * db
            low = np.where(same, mid, low)
            high = np.where(same, high, mid - 1)

    def less(self, a: np.ndarray, b: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        n = self.common(a, b)
        x, y = self.raw[np.minimum(a + n, len(self.raw) - 1)], self.raw[np.minimum(b + n, len(self.raw) - 1)]
        return np.where(n >= self.length, or_equal, x < y)

    def sort(self, at: np.ndarray, segment: np.ndarray) -> np.ndarray:
        """Order of the suffixes (segments ascending as given): merges of runs of 1, 2, 4... in all segments at once."""
        order = np.arange(len(at))
        if not len(at):
            return order
        begin = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
        size = np.diff(np.r_[begin, len(at)])
        start_of, size_of = np.repeat(begin, size), np.repeat(size, size)
        width = 1
        while width < size.max():
            live = np.flatnonzero(size_of > width)  # places that still have runs to merge
            rel = live - start_of[live]
            run = rel // width
            left = run % 2 == 0
            base = start_of[live] + (run - (run % 2)) * width
            other = np.where(left, base + width, base)
            limit = start_of[live] + size_of[live]
            other_end = np.minimum(other + width, limit)
            has = other < limit
            low, high = np.zeros(len(live), np.int64), np.where(has, other_end - other, 0)
            mine = at[order[live]]
            while True:  # how many of the sibling run stand before: a binary search with suffix comparisons
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    break
                mid = (low[open_] + high[open_]) >> 1
                sibling = at[order[other[open_] + mid]]
                before = self.less(sibling, mine[open_], ~left[open_])  # equals of the left run come first
                low[open_] = np.where(before, mid + 1, low[open_])
                high[open_] = np.where(before, high[open_], mid)
            target = base + (live - np.where(left, base, base + width)) + low
            moved = order.copy()
            moved[target] = order[live]
            order = moved
            width *= 2
        return order

    def equal_to_previous(self, at: np.ndarray) -> np.ndarray:
        """Whether a suffix shares its length bytes with the one before it: by hash, then verified byte by byte."""
        out = np.zeros(len(at), bool)
        if len(at) > 1:
            same = np.flatnonzero(self.common(at[1:], at[:-1]) >= self.length) + 1
            view = np.lib.stride_tricks.sliding_window_view(self.raw, self.length)
            for i in range(0, len(same), 1 << 16):
                part = same[i : i + (1 << 16)]
                out[part] = (view[at[part]] == view[at[part - 1]]).all(axis=1)
        return out


def smallest_documents(rows: np.ndarray, packed: np.ndarray, length: int):
    """For stretches (rows of _HEAD, their bytes one after another): (first suffix of each, smallest doc_id per suffix)."""
    size = rows["windows"].astype(np.int64) + length - 1
    start = np.r_[0, np.cumsum(size)[:-1]]
    # equal stretches are one: order by anchor, shape and a hash of all bytes, then verified
    prefix = prefix_hashes(packed)
    _, down = _Powers.get(len(prefix))
    whole = (prefix[start + size] - prefix[start]) * down[start]
    order = np.lexsort((whole, rows["windows"], rows["left"], rows["anchor"]))
    o = rows[order]
    same = np.r_[False, (o["anchor"][1:] == o["anchor"][:-1]) & (o["left"][1:] == o["left"][:-1]) & (o["windows"][1:] == o["windows"][:-1]) & (whole[order][1:] == whole[order][:-1])]
    at = np.flatnonzero(same)
    if len(at):
        x, y = start[order[at]], start[order[at - 1]]
        sizes = size[order[at]]
        ends = np.cumsum(sizes)
        step = np.arange(ends[-1]) - np.repeat(ends - sizes, sizes)
        differ = packed[np.repeat(x, sizes) + step] != packed[np.repeat(y, sizes) + step]
        same[at[np.add.reduceat(differ, ends - sizes) > 0]] = False
    kind = np.empty(len(rows), np.int64)
    kind[order] = np.cumsum(~same) - 1
    head = order[~same]
    least = np.minimum.reduceat(rows["doc"][order], np.flatnonzero(~same))
    # suffixes of the distinct stretches
    windows = rows["windows"][head].astype(np.int64)
    first = np.r_[0, np.cumsum(windows)[:-1]]
    owner = np.repeat(np.arange(len(head)), windows)
    t = np.arange(windows.sum()) - first[owner]
    found = least[owner].copy()
    anchor = rows["anchor"][head]
    alone = np.r_[True, anchor[1:] != anchor[:-1]]
    alone &= np.r_[alone[1:], True]  # no other stretch has the anchor
    todo = np.flatnonzero(~alone[owner])
    if len(todo):
        distance = rows["left"][head][owner[todo]].astype(np.int64) - t[todo]
        place = start[head][owner[todo]] + t[todo]
        names = anchor[owner[todo]]
        by = np.lexsort((distance, names))
        todo, place, names, distance = todo[by], place[by], names[by], distance[by]
        segment = np.cumsum(np.r_[True, (names[1:] != names[:-1]) | (distance[1:] != distance[:-1])])
        sorter = SuffixSorter(packed, length)
        sort = sorter.sort(place, segment)
        equal = sorter.equal_to_previous(place[sort]) & np.r_[False, segment[1:] == segment[:-1]]
        classes = np.cumsum(~equal) - 1
        small = np.minimum.reduceat(found[todo[sort]], np.flatnonzero(~equal))
        found[todo[sort]] = small[classes]
    return first, kind, found


def _sort(length: int, k: int, answer: int = ANSWER):
    """Of a bucket's pieces: suffixes sorted; answers go back to the blocks. The anchors are the k-grams that the heads point at."""

    def run(blobs):
        sources, heads, packs, source = [], [], [], []
        for i, x in enumerate(blobs):
            x = unpack(x)
            block, n = np.frombuffer(x, "<i8", 2).tolist()
            sources.append(block)
            rows = np.zeros(n, _HEAD)
            rows["doc"] = np.frombuffer(x, "<i8", n, 16)
            rows["at"] = np.frombuffer(x, "<u4", n, 16 + 8 * n)
            rows["left"], rows["windows"] = np.frombuffer(x, "u1", 2 * n, 16 + 12 * n).reshape(2, n)
            packed = np.frombuffer(x, np.uint8, offset=16 + 14 * n)
            size = rows["windows"].astype(np.int64) + length - 1
            place = np.cumsum(size) - size + rows["left"]
            rows["anchor"] = _span_hashes(prefix_hashes(packed), place, place + k)
            heads.append(rows)
            packs.append(packed)
            source.append(np.full(n, i, np.int32))
        rows, packed, source = np.concatenate(heads), np.concatenate(packs), np.concatenate(source)
        del heads, packs
        size = rows["windows"].astype(np.int64) + length - 1
        start = np.cumsum(size) - size
        order = np.argsort(rows["anchor"], kind="stable")
        names = rows["anchor"][order]
        at = 0
        while at < len(order):
            end = min(at + SORTED, len(order))
            end = int(np.searchsorted(names, names[end - 1], side="right"))
            sel = order[at:end]
            out, where = _answers(rows[sel], packed[np.repeat(start[sel], size[sel]) + steps(size[sel])], source[sel], length)
            at = end
            if len(out):
                bounds = np.searchsorted(where, np.arange(len(blobs) + 1))
                yield blob_batch([(sources[i], answer, out[s:e].tobytes()) for i, (s, e) in enumerate(zip(bounds[:-1], bounds[1:])) if e > s])

    return run


def _answers(rows: np.ndarray, packed: np.ndarray, source: np.ndarray, length: int):
    """Runs of windows that start in a smaller document than their block knows, and the blocks, ascending."""
    first, kind, found = smallest_documents(rows, packed, length)
    windows = rows["windows"].astype(np.int64)
    owner, t = np.repeat(np.arange(len(rows)), windows), steps(windows)
    hit = found[first[kind[owner]] + t] < rows["doc"][owner]
    owner, t = owner[hit], t[hit]
    own = runs(owner, t)
    where = source[own["at"]]
    own["at"] = rows["at"][own["at"]]
    by = np.argsort(where, kind="stable")
    return own[by], where[by]


def _block_ranges(held, ids: np.ndarray, length: int) -> dict[int, np.ndarray]:
    """Row of the block -> ranges of bytes covered by strings that start in a document with a smaller id."""
    _, table, late = own_files(held).split(b"\n")
    found = [(np.zeros(0, np.int64),) * 2]
    if table:
        table = unpack(get(table.decode()))
        m, n = np.frombuffer(table, "<i8", 2).tolist()
        least = np.frombuffer(table, "<i8", m, 16)
        windows = np.frombuffer(table, "u1", m, 16 + 8 * m).astype(np.int64)
        group, starts, rows = np.frombuffer(table, "<u4", 3 * n, 16 + 9 * m).reshape(3, n).astype(np.int64)
        first, smaller = marked(answers_of(held), windows)  # per window: it starts in a smaller document than any here
        size = windows[group]
        owner, t = np.repeat(np.arange(n), size), steps(size)
        hit = smaller[first[group[owner]] + t] | (least[group] < ids[rows])[owner]
        owner, t = owner[hit], t[hit]
        found.append((rows[owner], starts[owner] + t))
    if late:
        own = _Late.read(late)
        _, smaller = marked(answers_of(held, LATE), np.ones(len(own.least), np.int64))
        hit = smaller[own.group] | (own.least[own.group] < ids[own.rows])
        found.append((own.rows[hit], own.starts[hit]))
    return ranges_by_row(*map(np.concatenate, zip(*found)), length)


def stages(length: int, k: int, buckets: int, folder: str) -> list:
    """What blocks and buckets do in turn, up to the answers that return to the blocks."""
    return [
        _send_anchors(length, k, buckets), meet, _send_stretches(length, k, buckets, folder), buckets_of(_sort(length, k)),
        _send_late(buckets), buckets_of(_sort(length, length, LATE)),
    ]


def with_ranges(docs: DataFrame, emit, schema, length: int = LENGTH, k: int = K) -> DataFrame:
    """emit(rows of a block, row -> ranges of bytes that repeat from a document with a smaller id), for all blocks. docs: doc_id long, text, and others."""
    own = Blocks(docs)
    buckets, folder = own.buckets, own.folder

    def settle(batches):
        for _, held in by_target(batches):
            batch = rows_of(own_files(held))
            ids = pc.fill_null(batch["doc_id"].cast(pa.int64()), NO_ID).to_numpy(zero_copy_only=False)
            yield emit(batch, _block_ranges(held, ids, length))

    rows = own.rows
    for stage in stages(length, k, buckets, folder):
        rows = own.gathered(rows).mapInArrow(alone(stage), BLOB_SCHEMA)
    return own.gathered(rows).mapInArrow(alone(settle), schema)


def without(text: bytes, ranges: np.ndarray | None) -> tuple[bytes, int]:
    """(bytes kept, number of removed runs)"""
    if ranges is None:
        return text, 0
    out, at = [], 0
    for a, b in ranges.tolist():
        out.append(text[at:a])
        at = b
    return b"".join([*out, text[at:]]), len(ranges)


def deduplicated(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs with `kept_bytes` (in place of a column of that name): each text's bytes without what repeats from documents with smaller ids."""
    rows = docs.drop("kept_bytes")

    def emit(batch, ranges):
        kept = [without(t, ranges.get(i))[0] for i, t in enumerate(texts_as_bytes(batch["text"]))]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(kept, pa.binary())], names=[*batch.schema.names, "kept_bytes"])

    return with_ranges(rows, emit, docs.drop("kept_bytes").schema.add("kept_bytes", "binary"), length)


def digests(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256)"""

    def emit(batch, ranges):
        got = []
        for i, text in enumerate(texts_as_bytes(batch["text"])):
            kept, spans = without(text, ranges.get(i))
            got.append((len(text), len(text) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
        cols = list(zip(*got)) or [[]] * 4
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(c, t) for c, t in zip(cols, types))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return with_ranges(rows, emit, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", length)


def op1_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
