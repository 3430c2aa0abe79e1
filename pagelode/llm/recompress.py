"""Substring dedup over words by recompression.

A text is a sequence of words. A round joins every run of a repeated symbol to one symbol, then every pair of a "left" symbol and a
"right" one that follows it, sides being drawn by a hash of the symbol. A symbol's name is a hash of the names of what it stands
for, so equal substrings get equal symbols in every document, except near their ends. For each symbol the words that
decide it (its own and those of the neighbours that its forming depended on) are tracked: a symbol decided within
a window is found in every copy of the window.

1. Texts are kept in block files (see repeats). Each of `ROUNDS` rounds runs in Spark: blocks send the names of the runs and pairs
   that the round has formed of parts found elsewhere; they are brought together by name over all documents, and a block learns
   which of its symbols exist in another place. A symbol met once kills every window that it is decided in, and nothing
   is formed of it any more: from round to round fewer and longer symbols remain, those of the long repeats.
2. A window of `WINDOW` words that is left takes as its anchor the least of the highest-level symbols decided within it (told apart by all
   words that decide it). Consecutive windows with one anchor make a stretch, whose words go to the bucket of the anchor,
   equal stretches of a block once, unless the anchor is met nowhere else. Of a hot anchor, the windows that one more round
   finds elsewhere are sent, each to the bucket of its own name.
3. In a bucket, windows that hold the same symbol at the same distance are compared word by word: names only bring windows together,
   and a collision of names joins nothing.
4. The answers return to their block, become ranges of words, and meet the texts in the block's file.

Defined results: null text has no words; repeated rows are copies of each other, so their windows repeat; texts with
fewer words than the window keep all; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BASE, _INVERSE, _Powers, _powers, alone, mixed, prefix_hashes, span_hashes, texts_as_bytes, word_spans
from .repeats import (
    ANSWER, BLOB_SCHEMA, FILES, LATE, MET, SENT, Blocks, answers_of, blob_batch, buckets_of, by_target, dealt, get, marked, meet, met, named, own_files, pack, put,
    ranges_by_row, rows_of, runs, steps, sub_blocks, unpack,
)

WINDOW, ROUNDS = 35, 3
HOT_ONES = 16  # a row that tells a block which of its stretches have a hot anchor
#: Stretches that a task compares at a time (more only if they have one anchor).
COMPARED = 1 << 14
_SIDE = [np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xC2B2AE3D27D4EB4F)]
_FAR = np.int32(1 << 29)  # differences of two still fit


class Level:
    """Symbols of one level over all words of a block: names, first words, the words [low, high) that decide each, and the first of the
    symbols of the level below that each is formed of. dead: it is known to be in one place only, or holds such a symbol."""

    def __init__(self, names, first, low, high, parts=None):
        self.names, self.first, self.low, self.high, self.parts = names, first, low, high, parts
        self.dead = np.zeros(len(names), bool)


def word_level(names: np.ndarray) -> Level:
    at = np.arange(len(names), dtype=np.int32)
    return Level(names, at, at, at + 1)


def _shift(x: np.ndarray, by: int, fill) -> np.ndarray:
    out = np.empty_like(x)
    if by > 0:
        out[:by], out[by:] = fill, x[:-by]
    else:
        out[by:], out[:by] = fill, x[-by:]
    return out


def _named(x: np.ndarray) -> np.ndarray:
    """Names of what has the hashes x."""
    return mixed(x)


def name_runs(level: Level, edge: np.ndarray, count: int) -> tuple[Level, np.ndarray]:
    """Joins runs of equal symbols. edge: whether a symbol begins a text. Returns the level and its edges."""
    n = level.names
    same = np.zeros(len(n), bool)
    same[1:] = (n[1:] == n[:-1]) & ~edge[1:]
    begins = np.flatnonzero(~same).astype(np.int32)
    ends = np.r_[begins[1:], np.int32(len(n))]
    size = ends - begins
    names = n[begins]
    many = size > 1
    names = np.where(many, _named(names * BASE + size.astype(np.uint64) * _SIDE[3] + np.uint64(count)), names)
    low, high = level.low[begins], level.high[ends - 1]
    own_edge = edge[begins]
    # a run ends where its neighbours differ, so they decide it too
    low = np.where(own_edge, -_FAR, np.minimum(low, _shift(level.low[ends - 1], 1, -_FAR)))
    last = np.r_[own_edge[1:], True]
    high = np.where(last, _FAR, np.maximum(high, _shift(level.high[begins], -1, _FAR)))
    return Level(names, level.first[begins], low, high, begins), own_edge


def name_pairs(level: Level, edge: np.ndarray, count: int) -> tuple[Level, np.ndarray]:
    """Joins each left symbol with a right symbol that follows it."""
    n = level.names
    right = mixed(n ^ _SIDE[count % 3]) >> np.uint64(63) == 1
    head = np.zeros(len(n), bool)
    head[:-1] = ~right[:-1] & right[1:] & ~edge[1:]
    tail = _shift(head, 1, False)
    begins = np.flatnonzero(~tail).astype(np.int32)
    paired = head[begins]
    nxt = np.minimum(begins + 1, len(n) - 1)
    names = np.where(paired, _named(n[begins] * _SIDE[1] + n[nxt] * BASE + np.uint64(count + 77)), n[begins])
    before, after = _shift(level.low, 1, -_FAR), _shift(level.high, -1, _FAR)
    before[edge] = -_FAR
    after[np.r_[edge[1:], True]] = _FAR
    # a right symbol alone depends on what stands before it, a left symbol alone on what follows
    low = np.where(paired | ~right[begins], level.low[begins], np.minimum(level.low[begins], before[begins]))
    high = np.where(paired, level.high[nxt], np.where(right[begins], level.high[begins], np.maximum(level.high[begins], after[begins])))
    return Level(names, level.first[begins], low, high, begins), edge[begins]


def levels(names: np.ndarray, edge: np.ndarray, rounds: int = ROUNDS) -> list[Level]:
    out = [word_level(names)]
    level = out[0]
    for r in range(rounds if len(names) else 0):
        runs_, edge = name_runs(level, edge, 2 * r)
        level, edge = name_pairs(runs_, edge, 2 * r + 1)
        level.parts = runs_.parts[level.parts]
        out.append(level)
    return out


def _least_between(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Index of the first least value in [a, b) for many non-empty ranges; a sparse table."""
    size = b - a
    steps = int(size.max()).bit_length() if len(size) else 0
    table = [np.arange(len(values), dtype=np.int32)]
    for k in range(1, steps):
        one, two = table[-1][: -(1 << (k - 1))], table[-1][1 << (k - 1) :]
        if len(one) == 0:
            break
        table.append(np.where(values[two] < values[one], two, one))
    out = np.empty(len(a), np.int64)
    log = np.frexp(size)[1] - 1
    for k in range(len(table)):
        at = np.flatnonzero(log == k)
        if len(at):
            one, two = table[k][a[at]], table[k][b[at] - (1 << k)]
            out[at] = np.where(values[two] < values[one], two, one)
    return out


class Parsed:
    """Some texts of a block: their words, windows (by first words), and the symbols of all levels."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, window: int, rounds: int = ROUNDS):
        self.window, self.raw = window, raw
        self.starts, self.ends, self.doc = (x.astype(np.int32) if len(raw) < 1 << 29 else x for x in word_spans(raw, offsets))
        doc = self.doc
        n = len(doc)
        self.bounds = np.searchsorted(doc, np.arange(len(offsets)))
        at = np.arange(max(0, n - window + 1))
        self.windows = at[doc[at] == doc[at + window - 1]] if len(at) else at
        if not len(self.windows):
            self.names, self.levels = np.empty(0, np.uint64), []
            return
        self.names = span_hashes(prefix_hashes(raw), self.starts, self.ends)
        self.levels = levels(self.names, np.r_[True, doc[1:] != doc[:-1]], rounds)

    def _formed(self, r: int) -> np.ndarray:
        """Symbols formed in round r of parts that aren't dead, and decided within some window."""
        level, below = self.levels[r], self.levels[r - 1]
        level.dead = np.logical_or.reduceat(below.dead, level.parts)
        size = np.diff(np.r_[level.parts, len(below.names)])
        return np.flatnonzero((size > 1) & ~level.dead & (level.low >= 0) & (level.high <= len(self.names)) & (level.high - level.low <= self.window))

    def offered(self, r: int) -> np.ndarray:
        """The names that round r sends."""
        return self.levels[r].names[self._formed(r)] if self.levels else np.empty(0, np.uint64)

    def learn(self, r: int, elsewhere: np.ndarray) -> None:
        """What round r has found: for each name sent, whether it is met in another place."""
        if self.levels:
            once = self._formed(r)[~elsewhere]
            self.levels[r].dead[once] = True

    def alive(self) -> np.ndarray:
        """Windows in which no symbol met once is decided."""
        change = np.zeros(len(self.names) + 2, np.int64)
        for level in self.levels[1:]:
            dead = level.dead & (level.high - level.low <= self.window)
            np.add.at(change, np.maximum(0, level.high[dead] - self.window), 1)
            np.add.at(change, level.low[dead] + 1, -1)
        return self.windows[np.cumsum(change)[self.windows] == 0] if self.levels else self.windows

    def anchors(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(name, place, first word) of the anchors of windows."""
        n, names = len(self.names), np.zeros(len(windows), np.uint64)
        places, first = np.zeros(len(windows), np.int64), np.zeros(len(windows), np.int64)
        todo = np.arange(len(windows))
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(self.names * _powers(BASE, n), out=total[1:])
        down = _powers(_INVERSE, n + 1)
        for k, level in reversed(list(enumerate(self.levels))):
            w = windows[todo]
            low = np.maximum.accumulate(level.low)
            high = np.minimum.accumulate(level.high[::-1])[::-1]
            a, b = np.searchsorted(low, w), np.searchsorted(high, w + self.window, side="right")
            some = np.flatnonzero(b > a)
            if len(some):
                # a symbol is told apart by all the words that decide it, not by its own alone
                a_word, b_word = np.clip(level.low, 0, n), np.clip(level.high, 0, n)
                wide = _named((total[b_word] - total[a_word]) * down[a_word] + level.names)
                least = _least_between(wide, a[some], b[some])
                names[todo[some]] = _named(wide[least] + np.uint64(k))
                places[todo[some]] = level.first[least] * (len(self.levels) + 1) + k
                first[todo[some]] = level.first[least]
                todo = np.delete(todo, some)
            if not len(todo):
                break
        return names, places, first

    def plain_words(self) -> tuple[bytes, np.ndarray]:
        """(the words, each with a space behind it; where each begins)"""
        size = self.ends - self.starts + 1
        begin = np.r_[0, np.cumsum(size)]
        data = np.r_[self.raw, np.uint8(32)][np.repeat(self.starts, size) + steps(size)]
        data[begin[1:] - 1] = 32
        return data.tobytes(), begin


def _bits(known: list[np.ndarray]) -> bytes:
    return b"".join(np.int64(len(x)).tobytes() + np.packbits(x).tobytes() for x in known)


def _known(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        n = int(np.frombuffer(data, "<i8", 1, at)[0])
        size = -(-n // 8)
        out.append(np.unpackbits(np.frombuffer(data, np.uint8, size, at + 8), count=n).astype(bool))
        at += 8 + size
    return out


def _after_rounds(held, batch: pa.RecordBatch, window: int, rounds: int, buckets: int) -> tuple[list[tuple[int, Parsed]], list[np.ndarray]]:
    """The parts of a block, parsed `rounds` levels high, with what the rounds so far have found; and that, a bit a name, for the rounds to come."""
    files, answers = own_files(held), answers_of(held, MET)
    known = _known(files.partition(b"\n")[2])
    parts = [(i, Parsed(raw, offs, window, rounds)) for i, raw, offs in sub_blocks(batch)]
    r = 0
    while r < len(known) or answers:
        r += 1
        names = [p.offered(r) for _, p in parts]
        if r > len(known):
            known.append(met(np.concatenate([np.empty(0, np.uint64), *names]), answers, buckets)[0])
            answers = []
        at = 0
        for (_, p), own in zip(parts, names):
            p.learn(r, known[r - 1][at : at + len(own)])
            at += len(own)
    return parts, known


def _send_names(window: int, r: int, buckets: int):
    """Blocks: what round r has formed."""

    def run(batches):
        for block, held in by_target(batches):
            path = own_files(held).partition(b"\n")[0]
            parts, known = _after_rounds(held, rows_of(path), window, r, buckets)
            while len(known) < r - 1:  # a block that had nothing to send
                known.append(np.zeros(0, bool))
            names = np.concatenate([np.empty(0, np.uint64), *(p.offered(r) for _, p in parts)])
            yield blob_batch([*named(block, names, buckets), (block, FILES, path + b"\n" + _bits(known))])

    return run


#: A stretch: its anchor and number in the block, how far the anchor is from its first window, its windows, whether the block has it twice, its bytes.
_HEAD = np.dtype([("anchor", "<u8"), ("at", "<u4"), ("size", "<u4"), ("left", "u1"), ("windows", "u1"), ("twice", "u1")])


class _Pieces:
    """Distinct stretches of a block: heads, and their words."""

    def __init__(self, heads: np.ndarray, texts: list[bytes]):
        self.heads, self.texts = heads, texts

    def packed(self, first: np.ndarray, *more: np.ndarray) -> bytes:
        """first: two numbers, of which the second is that of the stretches; more: what follows the heads."""
        own = [self.heads[name] for name in _HEAD.names]
        return pack(first, *own, *more, np.frombuffer(b"".join(self.texts), np.uint8))

    @classmethod
    def read(cls, data: bytes, *more: tuple[str, int]) -> tuple[_Pieces, list[np.ndarray]]:
        n, at = int(np.frombuffer(data, "<i8", 2)[1]), 16
        heads, extra = np.zeros(n, _HEAD), []
        for name in _HEAD.names:
            heads[name] = np.frombuffer(data, _HEAD[name], n, at)
            at += n * _HEAD[name].itemsize
        for kind, count in more:
            extra.append(np.frombuffer(data, kind, count, at))
            at += extra[-1].nbytes
        ends = at + np.cumsum(heads["size"].astype(np.int64))
        return cls(heads, [data[s:e] for s, e in zip((ends - heads["size"]).tolist(), ends.tolist())]), extra

    def sent(self, block: int, which: np.ndarray, buckets: int) -> list[tuple[int, int, bytes]]:
        """Those numbered, to the buckets of their anchors."""
        by, ends = dealt(self.heads["anchor"][which], buckets)
        out = []
        for b, (s, e) in enumerate(zip(np.r_[0, ends[:-1]].tolist(), ends.tolist())):
            if e > s:
                sel = which[by[s:e]]
                out.append((b, SENT, _Pieces(self.heads[sel], [self.texts[x] for x in sel.tolist()]).packed(np.array([block, e - s], "<i8"))))
        return out


def _heads(anchors, lefts, windows, twice, texts: list[bytes]) -> np.ndarray:
    out = np.zeros(len(texts), _HEAD)
    out["anchor"], out["left"], out["windows"], out["twice"] = np.array(anchors, np.uint64), lefts, windows, twice
    out["at"], out["size"] = np.arange(len(texts)), [len(x) for x in texts]
    return out


def _table(uri: bytes) -> tuple[_Pieces, np.ndarray, np.ndarray, np.ndarray]:
    """(stretches, and per place: number of the stretch, first word, row of the block)"""
    data = unpack(get(uri.decode()))
    n = int(np.frombuffer(data, "<i8", 1)[0])
    pieces, places = _Pieces.read(data, ("<u4", n), ("<u4", n), ("<u4", n))
    return pieces, *(x.astype(np.int64) for x in places)


def _late_table(uri: bytes) -> tuple[_Pieces, np.ndarray]:
    """(windows of hot anchors; per window of the hot stretches, in order: its number)"""
    data = unpack(get(uri.decode()))
    pieces, (which,) = _Pieces.read(data, ("<u4", int(np.frombuffer(data, "<i8", 1)[0])))
    return pieces, which.astype(np.int64)


def _send_anchors(window: int, rounds: int, buckets: int, folder: str):
    """Blocks: what the rounds have left is kept in a file, as stretches and where they stand; the names of their anchors are sent."""

    def run(batches):
        for block, held in by_target(batches):
            path = own_files(held).partition(b"\n")[0]
            found: dict[tuple, int] = {}
            often, group, starts, rows = [], [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i, p in _after_rounds(held, rows_of(path), window, rounds, buckets)[0]:
                w = p.alive()
                if not len(w):
                    continue
                names, places, first = p.anchors(w)
                at = np.flatnonzero(np.r_[True, (places[1:] != places[:-1]) | (w[1:] != w[:-1] + 1)])
                count = np.diff(np.r_[at, len(w)])
                data, begin = p.plain_words()
                w = w[at]
                a, b = begin[w], begin[w + count + window - 1]
                for name, left, n, x, y in zip(names[at].tolist(), (first[at] - w).tolist(), count.tolist(), a.tolist(), b.tolist()):
                    key = (name, left, n, data[x:y])
                    k = found.get(key)
                    if k is None:
                        k = found[key] = len(found)
                        often.append(0)
                    else:
                        often[k] = 1
                    group.append(k)
                d = p.doc[w]
                rows.append(d + i)
                starts.append(w - p.bounds[d])
            if not found:
                yield blob_batch([(block, FILES, path + b"\n\n")])
                continue
            texts = [k[3] for k in found]
            pieces = _Pieces(_heads(*([k[j] for k in found] for j in range(3)), often, texts), texts)
            group = np.array(group, "<u4")
            kept = pieces.packed(np.array([len(group), len(found)], "<i8"), group, np.concatenate(starts).astype("<u4"), np.concatenate(rows).astype("<u4"))
            names = pieces.heads["anchor"][group]
            yield blob_batch([*named(block, names, buckets, group.astype(np.uint64)), (block, FILES, path + b"\n" + put(folder, kept).encode() + b"\n")])

    return run


def _send_stretches(window: int, buckets: int, folder: str):
    """Blocks: the stretches whose anchor is met elsewhere go to its bucket; of a hot anchor, the names of their windows."""

    def run(batches):
        for block, held in by_target(batches):
            files = own_files(held)
            path, table, _ = files.split(b"\n")
            if not table:
                yield blob_batch([(block, FILES, files)])
                continue
            pieces, group, _, _ = _table(table)
            shared, hot = (x[np.unique(group, return_index=True)[1]] for x in met(pieces.heads["anchor"][group], answers_of(held, MET), buckets))
            out, late = pieces.sent(block, np.flatnonzero(shared & ~hot), buckets), b""
            found: dict[bytes, int] = {}
            which, twice = [], []
            for k in np.flatnonzero(shared & hot).tolist():
                text, more = pieces.texts[k], bool(pieces.heads["twice"][k])
                begin = [0, *(m.end() for m in re.finditer(b" ", text))]
                for t in range(int(pieces.heads["windows"][k])):
                    own = text[begin[t] : begin[t + window]]
                    j = found.get(own)
                    if j is None:
                        j = found[own] = len(found)
                        twice.append(more)
                    else:
                        twice[j] = True
                    which.append(j)
            if found:
                texts = list(found)
                names = _window_names(texts)
                singles = _Pieces(_heads(names, 0, 1, twice, texts), texts)
                late = put(folder, singles.packed(np.array([len(which), len(texts)], "<i8"), np.array(which, "<u4"))).encode()
                out += named(block, np.repeat(names, np.array(twice) + 1), buckets)
            hot_ones = np.packbits(shared & hot).tobytes()
            yield blob_batch([*out, (block, FILES, path + b"\n" + table + b"\n" + late), (block, HOT_ONES, hot_ones)])

    return run


def _window_names(texts: list[bytes]) -> np.ndarray:
    raw, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(x) for x in texts])
    prefix, starts = prefix_hashes(raw), ends - [len(x) for x in texts]
    return _named((prefix[ends] - prefix[starts]) * _Powers.get(len(prefix))[1][starts])


def _send_late(buckets: int):
    """Blocks: of the windows with hot anchors, those met elsewhere go to the buckets of their own names."""

    def run(batches):
        for block, held in by_target(batches):
            files, out = own_files(held), []
            late = files.split(b"\n")[2]
            if late:
                singles, _ = _late_table(late)
                repeats = singles.heads["twice"].astype(np.int64) + 1
                elsewhere = met(np.repeat(singles.heads["anchor"], repeats), answers_of(held, MET), buckets)[0][np.cumsum(repeats) - 1]
                out = singles.sent(block, np.flatnonzero(elsewhere), buckets)
            yield blob_batch([*out, *((block, kind, x) for kind, x in held if kind in (FILES, ANSWER, HOT_ONES))])

    return run


def _same_windows(heads: np.ndarray, texts: list[bytes], window: int) -> np.ndarray:
    """For distinct stretches, given with their words: per window of each, whether another stretch has the same words at the same distance
    from the same anchor. Hashes bring windows together; words decide."""
    windows = heads["windows"].astype(np.int64)
    joined = b"".join(texts)
    raw = np.frombuffer(joined, np.uint8)
    begin = np.r_[0, np.flatnonzero(raw == 32) + 1]  # of each word, and the end
    base = np.cumsum(windows + window - 1) - (windows + window - 1)
    owner, t = np.repeat(np.arange(len(heads)), windows), steps(windows)
    a, b = begin[base[owner] + t], begin[base[owner] + t + window]
    prefix = prefix_hashes(raw)
    value = _named((prefix[b] - prefix[a]) * _Powers.get(len(prefix))[1][a])
    name = np.unique(heads["anchor"], return_inverse=True)[1][owner]
    distance = heads["left"][owner].astype(np.int64) - t
    order = np.lexsort((owner, value, distance, name))
    o_name, o_distance, o_value, o_owner = name[order], distance[order], value[order], owner[order]
    same = np.r_[False, (o_name[1:] == o_name[:-1]) & (o_distance[1:] == o_distance[:-1]) & (o_value[1:] == o_value[:-1])]
    at = np.flatnonzero(same)
    if not len(at):
        return np.zeros(len(owner), bool)
    # two stretches that follow each other at several windows are compared once, over all those windows
    pair, which = np.unique(o_owner[at] << 32 | o_owner[at - 1], return_inverse=True)
    low, high = np.full(len(pair), 1 << 30), np.zeros(len(pair), np.int64)
    np.minimum.at(low, which, t[order[at]])
    np.maximum.at(high, which, t[order[at]])
    x, y = pair >> 32, pair & 0xFFFFFFFF
    shift = heads["left"][y].astype(np.int64) - heads["left"][x]
    spans = [begin[base[k] + t_] for k, t_ in ((x, low), (x, high + window), (y, low + shift), (y, high + shift + window))]
    equal = np.array([joined[p:q] == joined[r:s] for p, q, r, s in zip(*(z.tolist() for z in spans))], bool)
    doubt = np.zeros(len(order), bool)
    if not equal.all():  # windows of equal hashes are told apart by their words
        group = np.cumsum(~same)
        doubt = np.isin(group, group[at[~equal[which]]])
        classes: dict[tuple, list[int]] = {}
        for k in np.flatnonzero(doubt).tolist():
            i = order[k]
            classes.setdefault((int(o_name[k]), int(o_distance[k]), joined[a[i] : b[i]]), []).append(i)
        told = [i for c in classes.values() if len(c) > 1 for i in c]
    out = np.zeros(len(owner), bool)
    out[order] = (same | np.r_[same[1:], False]) & ~doubt
    if doubt.any():
        out[told] = True
    return out


def _compare(window: int, answer: int = ANSWER):
    """Of a bucket's pieces: stretches met in several blocks, and windows that distinct stretches share."""

    def run(blobs):
        sources, heads, texts, source = [], [], [], []
        for i, x in enumerate(blobs):
            x = unpack(x)
            sources.append(int(np.frombuffer(x, "<i8", 1)[0]))
            pieces, _ = _Pieces.read(x)
            texts += pieces.texts
            heads.append(pieces.heads)
            source.append(np.full(len(pieces.heads), i, np.int32))
        heads, source = np.concatenate(heads), np.concatenate(source)
        order = np.argsort(heads["anchor"], kind="stable")
        names = heads["anchor"][order]
        at = 0
        while at < len(order):
            end = min(at + COMPARED, len(order))
            end = int(np.searchsorted(names, names[end - 1], side="right"))
            sel = order[at:end]
            at = end
            found: dict[tuple, int] = {}
            kind, first, count = [], [], []
            for i, key in zip(sel.tolist(), zip(heads["anchor"][sel].tolist(), heads["left"][sel].tolist(), heads["windows"][sel].tolist(), [texts[k] for k in sel.tolist()])):
                k = found.get(key)
                if k is None:
                    k = found[key] = len(found)
                    first.append(i)
                    count.append(0)
                count[k] += 1
                kind.append(k)
            kind, first, count = np.array(kind), np.array(first), np.array(count)
            windows = heads["windows"][first].astype(np.int64)
            begin = np.cumsum(windows) - windows
            hit = np.repeat(count > 1, windows)
            anchor = heads["anchor"][first]
            several = np.flatnonzero(np.r_[False, anchor[1:] == anchor[:-1]] | np.r_[anchor[1:] == anchor[:-1], False])
            if len(several):
                own = np.repeat(begin[several], windows[several]) + steps(windows[several])
                hit[own] |= _same_windows(heads[first[several]], [texts[k] for k in first[several].tolist()], window)
            asked = np.flatnonzero(heads["twice"][sel] == 0)
            size = windows[kind[asked]]
            owner, t = np.repeat(asked, size), steps(size)
            yes = hit[begin[kind[owner]] + t]
            out = runs(owner[yes], t[yes])
            where = source[sel[out["at"]]]
            out["at"] = heads["at"][sel[out["at"]]]
            by = np.argsort(where, kind="stable")
            out, where = out[by], where[by]
            bounds = np.searchsorted(where, np.arange(len(blobs) + 1))
            answers = [(sources[i], answer, out[s:e].tobytes()) for i, (s, e) in enumerate(zip(bounds[:-1], bounds[1:])) if e > s]
            if answers:
                yield blob_batch(answers)

    return run


def _block_ranges(held, window: int) -> dict[int, np.ndarray]:
    """Row of the block -> ranges of words covered by windows that occur twice or more."""
    _, table, late = own_files(held).split(b"\n")
    if not table:
        return {}
    pieces, group, starts, rows = _table(table)
    windows = pieces.heads["windows"].astype(np.int64)
    first, hit = marked(answers_of(held), windows)
    hit |= np.repeat(pieces.heads["twice"] > 0, windows)
    if late:
        singles, which = _late_table(late)
        _, found = marked(answers_of(held, LATE), singles.heads["windows"].astype(np.int64))
        hot = np.unpackbits(np.frombuffer(next(x for kind, x in held if kind == HOT_ONES), np.uint8), count=len(windows)).astype(bool)
        hit[np.flatnonzero(np.repeat(hot, windows))] |= (found | (singles.heads["twice"] > 0))[which]
    size = windows[group]
    owner, t = np.repeat(np.arange(len(group)), size), steps(size)
    yes = hit[first[group[owner]] + t]
    owner, t = owner[yes], t[yes]
    return ranges_by_row(rows[owner], starts[owner] + t, window)


def stages(window: int, rounds: int, buckets: int, folder: str) -> list:
    """What blocks and buckets do in turn, up to the answers that return to the blocks."""
    out = []
    for r in range(1, rounds + 1):
        out += [_send_names(window, r, buckets), meet]
    out += [_send_anchors(window, rounds, buckets, folder), meet, _send_stretches(window, buckets, folder), buckets_of(_compare(window))]
    return [*out, _send_late(buckets), buckets_of(_compare(window, LATE))]


def with_ranges(docs: DataFrame, emit, schema, window: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """emit(rows of a block, row -> ranges of words in windows that occur twice or more), for all blocks."""
    own = Blocks(docs)

    def settle(batches):
        for _, held in by_target(batches):
            yield emit(rows_of(own_files(held)), _block_ranges(held, window))

    rows = own.rows
    for stage in stages(window, rounds, own.buckets, own.folder):
        rows = own.gathered(rows).mapInArrow(alone(stage), BLOB_SCHEMA)
    return own.gathered(rows).mapInArrow(alone(settle), schema)


def without(text: bytes, ranges: np.ndarray | None) -> tuple[list[bytes], int]:
    """(words kept, number removed)"""
    words = text.split()
    if ranges is None:
        return words, 0
    kept, at = [], 0
    for a, b in ranges.tolist():
        kept += words[at:a]
        at = b
    kept += words[at:]
    return kept, len(words) - len(kept)


_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def cut(text: bytes, ranges: np.ndarray) -> bytes:
    """The text without the words in the ranges; what stands between words elsewhere stays as it is."""
    at = [m.span() for m in _WORD.finditer(text)]
    out, last = [], 0
    for a, b in ranges.tolist():
        out.append(text[last : at[a][0]])
        last = at[b - 1][1]
    return b"".join([*out, text[last:]])


def deduplicated(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs without the words of repeated windows; texts of which no word is left go. Columns as given, n_chars with the text."""

    def emit(batch, ranges):
        texts, keep = batch["text"].to_pylist(), np.ones(len(batch), bool)
        for i, own in ranges.items():
            left = cut(texts[i].encode(), own)
            texts[i], keep[i] = left.decode(), bool(_WORD.search(left))
        columns = [pa.array(texts, batch[c].type) if c == "text" else batch[c] for c in batch.schema.names]
        return pa.RecordBatch.from_arrays(columns, names=batch.schema.names).filter(pa.array(keep, pa.bool_()))

    out = with_ranges(docs, emit, docs.schema, window)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))
    return out


def digests(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256)"""

    def emit(batch, ranges):
        n, removed, sha = [], [], []
        for i, text in enumerate(texts_as_bytes(batch["text"])):
            kept, gone = without(text, ranges.get(i))
            n.append(len(kept) + gone)
            removed.append(gone)
            sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        return pa.RecordBatch.from_arrays(
            [batch["doc_id"], pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())],
            names=["doc_id", "n_words", "n_removed", "kept_sha256"],
        )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return with_ranges(rows, emit, "doc_id long, n_words long, n_removed long, kept_sha256 string", window)


def op6_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
