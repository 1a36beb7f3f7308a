"""Byte-level BPE as a lazily determinised finite-state transducer, and streaming decoding.

The transducer reads bytes and emits tokens.  A chain of tokens, each compatible with the one
before, is the encoding of its bytes, and there is one for every run of bytes; so before each
byte there are as many open ways as there are earlier places from which the bytes read so far
begin a token: the chain up to that place, and the place that they have reached in the tree of
tokens.  A state is the set of these ways: the last token emitted, and for each way the tokens of
its chain that are not emitted yet and its node of the tree.  The merges are compiled into the tree's moves and the
compatibility of two tokens; states and their moves are made when a byte is first read
in them, so no move is made that no text needs.

A token is emitted once all ways agree on it, and is never taken back.  A way is closed when
no token begins with its bytes, which is after a token's greatest length at most, so what is not yet
emitted is a few tokens beyond that (`pending` tells how many bytes).

Decoding is a state machine over UTF-8: a state is the number and range of the
continuation bytes still due.  It is composed with the vocabulary, so that it steps
once for each token, and it holds back an unfinished character between steps.

Defined cases: a null text is empty; an empty text has no ids; repeated rows give
equal results; an empty table stays empty; a text of any length is encoded whole, piece by piece; ties cannot arise, as no two
tokens have one rank; further columns are left out, and their names do not matter.  Nothing is learned, so there is no
corpus state and no shuffle.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from voxtrail.llm.common import per_worker, slices

MOVES = 400_000
DECODED = 80_000
PIECES = 400_000
#: Longer pieces are encoded each time, so that what a worker keeps is bounded in bytes as well.
KEPT_CHARS = 64
_NONE = 1 << 60


def read_ranks(lines: Iterable[bytes]) -> dict[bytes, int]:
    """Ranks by token, from lines of base64 text and number."""
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


class Transducer:
    """Encodes pieces by the ranks, as repeated merging of the lowest ranked neighbours does."""

    def __init__(self, ranks: dict[bytes, int], max_moves: int = MOVES) -> None:
        self.ranks, self.max_moves = ranks, max_moves
        self.token = {v: k for k, v in ranks.items()}
        #: Nodes are numbered from the root, 0; a move is found by node * 256 + byte.
        self.tree: dict[int, int] = {}
        #: Of a node, the token that ends there, or -1; and whether longer tokens go through it.
        self.ends, self.inner = [-1], [True]
        for data in sorted(ranks):
            node = 0
            for byte in data:
                self.inner[node] = True
                node = self.tree.setdefault(node * 256 + byte, len(self.ends))
                if node == len(self.ends):
                    self.ends.append(-1)
                    self.inner.append(False)
            self.ends[node] = ranks[data]
        self._start_anew()

    def _start_anew(self) -> None:
        """Forgets all states but the first: nothing emitted, one way, at the root."""
        self.states: list[tuple[int, tuple[tuple[tuple[int, ...], int], ...]]] = [(-1, (((), 0),))]
        self.numbers = {self.states[0]: 0}
        #: By state * 256 + byte: the next state, and what is emitted.
        self.moves: dict[int, tuple[int, tuple[int, ...]]] = {}
        #: By left token * 2 ** 32 + right token.
        self.fits: dict[int, bool] = {}

    def merged(self, piece: bytes) -> list[int]:
        """Ids of a short piece by merging directly; used for pairs of tokens only."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        ranks = [self.ranks.get(piece[i : i + 2], _NONE) for i in range(len(piece) - 1)]
        while ranks and (least := min(ranks)) != _NONE:
            at = ranks.index(least)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at < len(ranks):
                ranks[at] = self.ranks.get(parts[at] + parts[at + 1], _NONE)
            if at:
                ranks[at - 1] = self.ranks.get(parts[at - 1] + parts[at], _NONE)
        return [self.ranks[p] for p in parts]

    def compatible(self, left: int, right: int) -> bool:
        """Whether two tokens stay as they are when their bytes are encoded together; left -1 is nothing."""
        key = (left << 32) + right
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) >= self.max_moves:
                self.fits.clear()
            want = [right] if left < 0 else [left, right]
            known = self.fits[key] = self.merged(b"".join(self.token[t] for t in want)) == want
        return known

    def move(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """Makes the move from a state by a byte: all its ways go on, those that end a token also begin at the root again."""
        last, ways = self.states[state]
        tree, ends, inner = self.tree, self.ends, self.inner
        gone: list[tuple[tuple[int, ...], int]] = []
        whole = None
        for chain, node in ways:
            further = tree.get(node * 256 + byte)
            if further is None:
                continue
            if inner[further]:
                gone.append((chain, further))
            if whole is None and (token := ends[further]) >= 0 and self.compatible(chain[-1] if chain else last, token):
                whole = (*chain, token)
        if whole is None:
            raise ValueError("a byte of the piece is no token")
        sure = len(whole)
        for chain, _ in gone:
            if chain[:sure] != whole[:sure]:
                sure = next((i for i, (a, b) in enumerate(zip(chain, whole)) if a != b), min(sure, len(chain)))
        out = whole[:sure]
        if sure:
            last = whole[sure - 1]
            gone = [(chain[sure:], node) for chain, node in gone]
        made = (last, (*gone, (whole[sure:], 0)))
        if len(self.moves) >= self.max_moves:
            self._start_anew()
            return self._number(made), out
        found = self.moves[state * 256 + byte] = self._number(made), out
        return found

    def pending(self, state: int) -> int:
        """Bytes that a state has read beyond the tokens emitted: its lookahead."""
        return sum(len(self.token[t]) for t in self.states[state][1][-1][0])

    def _number(self, state: tuple[int, tuple[tuple[tuple[int, ...], int], ...]]) -> int:
        number = self.numbers.setdefault(state, len(self.states))
        if number == len(self.states):
            self.states.append(state)
        return number

    def encode(self, piece: bytes) -> list[int]:
        """Ids of one piece; a piece that is a token by itself is that token.

        One move for each byte; at the end the way that stands at the root has the tokens still due.
        """
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        out: list[int] = []
        state = 0
        for byte in piece:
            made = self.moves.get(state * 256 + byte) or self.move(state, byte)
            state = made[0]
            if made[1]:
                out += made[1]
        return out + list(self.states[state][1][-1][0])


# Lead byte ranges of UTF-8 with the ranges that the second byte may take and the bytes that follow.
_LEADS = (
    (0x00, 0x7F, None, 0),
    (0xC2, 0xDF, (0x80, 0xBF), 1),
    (0xE0, 0xE0, (0xA0, 0xBF), 2),
    (0xE1, 0xEC, (0x80, 0xBF), 2),
    (0xED, 0xED, (0x80, 0x9F), 2),
    (0xEE, 0xEF, (0x80, 0xBF), 2),
    (0xF0, 0xF0, (0x90, 0xBF), 3),
    (0xF1, 0xF3, (0x80, 0xBF), 3),
    (0xF4, 0xF4, (0x80, 0x8F), 3),
)


def utf8_step(state: tuple[int, int, int], byte: int) -> tuple[tuple[int, int, int], bool]:
    """Next state and whether the byte fits; a state is (bytes due, least, greatest value of the next)."""
    due, low, high = state
    if due:
        fits = low <= byte <= high
        return ((due - 1, 0x80, 0xBF) if fits and due > 1 else (0, 0, 0)), fits
    for first, last, second, more in _LEADS:
        if first <= byte <= last:
            return ((more, *second) if second else (0, 0, 0)), True
    return (0, 0, 0), False


class StreamDecoder:
    """Decodes ids given bit by bit; text() never holds a broken character."""

    def __init__(self, token: dict[int, bytes]) -> None:
        self.token, self._moves = token, {}
        self.table = [token.get(i, b"") for i in range(max(token, default=0) + 1)]
        #: Whether a token, read between two characters, ends between two again.
        self.closed = np.array([i in token and not self._through((0, 0, 0), i)[0][0] for i in range(len(self.table))])
        self.reset()

    def _through(self, state: tuple[int, int, int], token: int) -> tuple[tuple[int, int, int], int, bool]:
        now, whole, fits = state, 0, True
        for i, byte in enumerate(self.token[token]):
            now, ok = utf8_step(now, byte)
            fits &= ok
            if not now[0]:
                whole = i + 1
        return now, whole, fits

    def reset(self) -> None:
        self.state, self.held = (0, 0, 0), b""

    def move(self, state: tuple[int, int, int], token: int) -> tuple[tuple[int, int, int], int, bool]:
        """State after a token, how many of its bytes end whole characters, and whether all of them fit."""
        made = self._moves.get((state, token))
        if made is None:
            if len(self._moves) > DECODED:
                self._moves.clear()
            made = self._moves[state, token] = self._through(state, token)
        return made

    def feed(self, ids: Iterable[int]) -> bytes:
        """The bytes of all characters that `ids` complete; between characters, closed tokens pass unread."""
        ids = ids if isinstance(ids, np.ndarray) else np.fromiter(ids, np.int64)
        some, state, due, at = ids.tolist(), self.state, len(self.held), 0  # `due` bytes at the end are of no whole character yet
        data = self.held + b"".join(map(self.table.__getitem__, some))
        for first in [0, *np.flatnonzero(~self.closed[ids]).tolist()]:
            if first < at:
                continue
            at = first
            while at < len(some):
                state, whole, _ = self.move(state, some[at])
                size = len(self.table[some[at]])
                due = size - whole if whole else due + size
                at += 1
                if not state[0]:
                    break
        self.state, self.held = state, data[len(data) - due :]
        return data[: len(data) - due]

    def end(self) -> bytes:
        """The bytes still held; none after whole texts."""
        rest = self.held
        self.reset()
        return rest


class Codec:
    """Splits texts by a pattern, encodes each match by the transducer, and decodes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, max_pieces: int = PIECES) -> None:
        self.transducer, self.find, self.max_pieces = Transducer(ranks), regex.compile(pattern).findall, max_pieces
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.decoder = StreamDecoder(self.transducer.token)

    def encode_bytes(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers; pieces met before are not walked again."""
        if len(self.memo) >= self.max_pieces:
            self.memo, self.older = {}, self.memo
        pieces, memo = self.find(text), self.memo
        found = list(map(memo.get, pieces))
        if None in found:
            older, encode, at = self.older, self.transducer.encode, -1
            for _ in range(found.count(None)):
                at = found.index(None, at + 1)
                piece = pieces[at]
                data = memo.get(piece) or older.get(piece)
                if data is None:
                    ids = encode(piece.encode())
                    data = struct.pack(f"<{len(ids)}I", *ids)
                    if len(piece) > KEPT_CHARS:
                        found[at] = data
                        continue
                found[at] = memo[piece] = data
        return b"".join(found)

    def encode(self, text: str) -> list[int]:
        """Ids of a text."""
        return np.frombuffer(self.encode_bytes(text), "<u4").tolist()

    def decode(self, ids: Iterable[int]) -> bytes:
        self.decoder.reset()
        return self.decoder.feed(ids) + self.decoder.end()


def _codec_maker(spark: SparkSession, ranks_path: str, pattern: str):
    """A function that gives the worker's codec; the vocabulary, of fixed size, is broadcast."""
    with open(ranks_path, "rb") as f:
        return per_worker(spark, Codec, read_ranks(f), pattern)


def encode_column(spark: SparkSession, text: Column, ranks_path: str, pattern: str) -> Column:
    """The ids of a text column, as array<int>."""
    codec = _codec_maker(spark, ranks_path, pattern)

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([codec().encode(t or "") for t in texts])

    return encode(text)


def decode_column(spark: SparkSession, ids: Column, ranks_path: str, pattern: str) -> Column:
    """The bytes of a column of ids."""
    codec = _codec_maker(spark, ranks_path, pattern)

    @F.pandas_udf("binary")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            yield pd.Series([codec().decode(() if x is None else map(int, x)) for x in rows])

    return decode(ids)


def round_trip_documents(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, and hashes of the ids and of the bytes that they decode to."""
    codec = _codec_maker(docs.sparkSession, ranks_path, pattern)

    @F.arrow_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            rows = []
            for text in slices(texts):
                data = codec().encode_bytes(text or "")
                ids = np.frombuffer(data, "<u4")
                rows.append((len(ids), hashlib.sha256(data).hexdigest(), hashlib.sha256(codec().decode(ids)).hexdigest()))
            kinds = (pa.int64(), pa.string(), pa.string())
            yield pa.StructArray.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", digest(F.col("text")).alias("d")).select("doc_id", "d.*")
