"""Byte-level BPE by a lazily determinised transducer, and streaming decode.

Encoding reads a piece byte by byte. The machine's state is the longest run of bytes before the current place that the
token trie still knows; moves between states, and the tokens that can end in a state, are worked out when first met and
kept. Of the tokens that can end at a place, the one that is stable next to the last token of the part before it is
the last token of the text so far. A token is emitted once all places within the longest token's length of the
current one have it behind them: the lookahead is bounded.

Two neighbouring tokens are stable if no merge across their border comes first. A merge of a (on the right edge of
the left token) and b (on the left edge of the right token) with rank r does if a and b are both still there: r is
below the rank of the merge that takes a up, and not above that of the merge that takes b up (merges of one
rank go from left to right).

Decoding joins the tokens' bytes; text comes from an incremental UTF-8 state machine that holds back an
unfinished character.

Defined results: null text counts as empty (no ids).
"""

from __future__ import annotations

import base64
import hashlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.tables import spread
from .common import held
from .pieces import Memo, splitter

NEVER = 1 << 62


class Vocabulary:
    """Token bytes by id, ids by bytes, and for each token the pair that its last merge joins."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        self._edges: dict[tuple[int, int], tuple] = {}
        self._splits: dict[int, tuple[int, int] | None] = {}
        self.known: dict[int, bool] = {}
        self.children: list[dict[int, int]] = [{}]
        self.token_at: list[int] = [-1]
        for token, rank in ranks.items():
            at = 0
            for b in token:
                nxt = self.children[at].get(b)
                if nxt is None:
                    nxt = self.children[at][b] = len(self.children)
                    self.children.append({})
                    self.token_at.append(-1)
                at = nxt
            self.token_at[at] = rank

    @classmethod
    def from_rank_file(cls, path: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens that the token's own merge joins; None for a single byte, or if merges don't lead to it."""
        if token not in self._splits:
            parts = [self.bytes_of[token][i : i + 1] for i in range(len(self.bytes_of[token]))]
            while len(parts) > 2:
                found = [(self.ranks.get(a + b, NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
                rank, i = min(found)
                if rank >= token:
                    break
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            self._splits[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self._splits[token]

    def edge(self, token: int, side: int) -> tuple[tuple[int, int], ...]:
        """(token, rank of the merge that takes it up) along the left (0) or right (1) edge, from the whole token inwards."""
        key = (token, side)
        if key not in self._edges:
            out, at, until = [], token, NEVER
            while True:
                out.append((at, until))
                parts = self.split(at)
                if parts is None:
                    break
                at, until = parts[side], at
            self._edges[key] = tuple(out)
        return self._edges[key]

    def stable(self, left: int, right: int) -> bool:
        key = left << 20 | right
        got = self.known.get(key)
        if got is None:
            got = True
            for a, a_until in self.edge(left, 1):
                for b, b_until in self.edge(right, 0):
                    r = self.ranks.get(self.bytes_of[a] + self.bytes_of[b])
                    if r is not None and r < a_until and r <= b_until:
                        got = False
                        break
                if not got:
                    break
            if len(self.known) > 500_000:
                self.known.clear()
            self.known[key] = got
        return got


class Transducer:
    """Bytes in, token ids out; feed() may be called as bytes arrive, end() closes a piece.

    The machine's states are the longest runs of input that the token trie still knows; a state's moves and the
    tokens that may end in it are made when first met and kept (there are at most as many states as trie nodes).
    """

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.moves: list[dict[int, int]] = [{} for _ in vocab.children]
        self.back: list[int] = [-1] * len(vocab.children)  # state of the longest proper suffix
        self.ends: list[tuple | None] = [None] * len(vocab.children)
        self.back[0] = 0
        self.ends[0] = ()
        self.length_of = {i: len(t) for i, t in vocab.bytes_of.items()}
        self.longest = max(self.length_of.values(), default=1)
        self.parent: list[tuple[int, int]] = [(0, 0)] * len(vocab.children)
        for node, row in enumerate(vocab.children):
            for byte, child in row.items():
                self.parent[child] = (node, byte)

    def move(self, state: int, byte: int) -> int:
        """The state after one more byte; determinised when first asked for."""
        path = []
        while True:
            got = self.moves[state].get(byte)
            if got is None:
                got = self.vocab.children[state].get(byte)
            if got is not None or state == 0:
                break
            path.append(state)
            state = self.suffix(state)
        got = got or 0
        self.moves[state][byte] = got
        for x in path:
            self.moves[x][byte] = got
        if self.ends[got] is None:
            self.ends[got] = self._ends(got)
        return got

    def suffix(self, state: int) -> int:
        if self.back[state] < 0:
            up, byte = self.parent[state]
            self.back[state] = 0 if up == 0 else self.move(self.suffix(up), byte)
        return self.back[state]

    def _ends(self, state: int) -> tuple:
        """(token, length) of the tokens that end here, longest first."""
        out = []
        while state:
            token = self.vocab.token_at[state]
            if token >= 0:
                out.append((token, self.length_of[token]))
            state = self.suffix(state)
        return tuple(out)

    def start(self) -> Pending:
        return Pending()

    def feed(self, p: Pending, data: bytes) -> list[int]:
        """Takes bytes, returns the tokens that no later byte can change."""
        moves, ends, stable, known, last = self.moves, self.ends, self.vocab.stable, self.vocab.known, p.last
        state, at = p.state, len(last)
        for byte in data:
            nxt = moves[state].get(byte)
            state = nxt if nxt is not None else self.move(state, byte)
            for token, length in ends[state]:
                before = at - length
                if before < 0:
                    continue  # it would begin before the decided part
                left = last[before]
                if left < 0:
                    if before == 0 and not p.emitted:
                        break
                    continue
                ok = known.get(left << 20 | token)
                if ok is None:
                    ok = stable(left, token)
                if ok:
                    break
            else:
                raise ValueError(f"no token for byte {byte}: the vocabulary lacks single bytes")
            last.append(token)
            at += 1
        p.state = state
        return self._decided(p) if at > 8 * self.longest else []

    def _decided(self, p: Pending) -> list[int]:
        """Emits what all places within the lookahead have in common."""
        last, n = p.last, len(p.last) - 1
        live = set(range(max(0, n - self.longest + 1), n + 1))
        while len(live) > 1:
            m = max(live)
            live.remove(m)
            live.add(m - self.length_of[last[m]])
        cut = live.pop()
        out = self._path(last, cut)
        if cut:
            p.last, p.emitted = last[cut:], True
        return out

    def _path(self, last: list[int], at: int) -> list[int]:
        out = []
        while at > 0:
            out.append(last[at])
            at -= self.length_of[last[at]]
        return out[::-1]

    def end(self, p: Pending) -> list[int]:
        return self._path(p.last, len(p.last) - 1)

    def encode(self, piece: bytes) -> list[int]:
        p, out = self.start(), []
        step = 16 * self.longest
        for i in range(0, len(piece), step):
            out += self.feed(p, piece[i : i + step])
        return out + self.end(p)


class Pending:
    """Of a piece being read: the machine's state, and per place since the decided part the last token there."""

    __slots__ = ("state", "last", "emitted")

    def __init__(self):
        self.state, self.last, self.emitted = 0, [-1], False


class Utf8Stream:
    """Incremental UTF-8: feed() returns the text of whole characters and keeps an unfinished one for later."""

    def __init__(self, errors: str = "replace"):
        self.held, self.errors = b"", errors

    def feed(self, data: bytes) -> str:
        data = self.held + data
        keep = 0
        for back in range(1, min(3, len(data)) + 1):  # state of the last character: its lead byte and how far it came
            b = data[-back]
            if b >= 0xC0:
                need = 2 if b < 0xE0 else 3 if b < 0xF0 else 4
                keep = back if back < need else 0
                break
            if b < 0x80:
                break
        self.held = data[len(data) - keep :] if keep else b""
        return data[: len(data) - keep].decode("utf-8", self.errors)

    def finish(self) -> str:
        held, self.held = self.held, b""
        return held.decode("utf-8", self.errors)


class Codec:
    """Encodes texts and decodes ids of one rank file."""

    def __init__(self, rank_file: str, pattern: str):
        self.vocab = Vocabulary.from_rank_file(rank_file)
        self.transducer = Transducer(self.vocab)
        self.pieces = splitter(pattern)
        self.memo = Memo(self._piece)
        table = self.vocab.bytes_of
        self.token_bytes = [table.get(i, b"") for i in range(max(table) + 1)]

    def _piece(self, piece: str) -> bytes:
        data = piece.encode()
        whole = self.vocab.ranks.get(data)  # a piece that is a token is that token
        return array("I", [whole] if whole is not None else self.transducer.encode(data)).tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.memo.__getitem__, self.pieces(text)))

    def decode_bytes(self, ids: bytes) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def decode_stream(self, ids):
        """Text as ids arrive, one yield an id; the last yield closes an unfinished character."""
        utf8 = Utf8Stream()
        for i in ids:
            yield utf8.feed(self.token_bytes[i])
        yield utf8.finish()

    def decode(self, ids: bytes, step: int = 4096) -> str:
        utf8, out = Utf8Stream(), []
        for i in range(0, len(ids), 4 * step):
            out.append(utf8.feed(self.decode_bytes(ids[i : i + 4 * step])))
        return "".join(out) + utf8.finish()

    def decoded(self, ids: bytes) -> bytes:
        """The bytes of the text that the stream of ids decodes to."""
        return self.decode(ids).encode()


def codec(rank_file: str, pattern: str) -> Codec:
    return held(("codec", rank_file, pattern), lambda: Codec(rank_file, pattern))


def encoded(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """docs without text, with token_ids array<int>, n_tokens and round_trip (whether decoding gives the text's bytes again)."""
    new = ("token_ids", "n_tokens", "round_trip")
    names = [n for n in docs.columns if n not in (*new, "text")]
    schema = docs.select(*names).schema.add("token_ids", T.ArrayType(T.IntegerType())).add("n_tokens", "long").add("round_trip", "boolean")

    def run(batches):
        own = codec(rank_file, pattern)
        for batch in batches:
            ids, good = [], []
            for t in batch["text"]:
                text = t.as_py() or ""
                got = own.encode(text)
                ids.append(np.frombuffer(got, "<i4"))
                good.append(own.decoded(got) == text.encode())
            sizes = list(map(len, ids))
            values = np.concatenate(ids) if ids else np.empty(0, np.int32)
            column = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), pa.array(values, pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [*(batch[n] for n in names), column, pa.array(sizes, pa.int64()), pa.array(good, pa.bool_())], names=[*names, *new]
            )

    return docs.select(*names, "text").mapInArrow(run, schema)


def round_trips(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): each text encoded and decoded again."""

    def run(batches):
        own = codec(rank_file, pattern)
        for batch in batches:
            n, h, back = [], [], []
            for text in batch["text"]:
                ids = own.encode(text.as_py() or "")
                n.append(len(ids) // 4)
                h.append(hashlib.sha256(ids).hexdigest())
                back.append(hashlib.sha256(own.decoded(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(n, pa.int64()), pa.array(h, pa.string()), pa.array(back, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op3_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return round_trips(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
