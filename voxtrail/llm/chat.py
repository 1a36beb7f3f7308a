"""Conversations as training windows of a bounded number of tokens.

Prefix sums of the turns' tokens choose spans of whole turns.  A window holds the conversation's system turn, some of
the turns before its span, repeated as far as `history` allows, and the span itself; only the assistant's
turns of the span are under the loss mask, so each of them is a target once.  Turns stand between markers, and
control strings inside roles and texts are escaped reversibly, so all turns can be read back from a window.

Conversations are dealt out in blocks of BLOCK_TURNS turn numbers, each with copies of the system turn and of the last
turns before it, so a conversation of any length spreads over tasks; prefix sums start anew in a block, which
costs one unfilled window.  A task reads its blocks turn by turn and holds no more of them than one window.

Defined cases: null texts and roles are empty; null conversation ids are one conversation; null turn numbers count as -1; rows of one
turn number stand in the order of role and text, repeated rows are turns of their own; the system turn is
the first row of a conversation if its role says so, and it is not repeated if it takes over half of
the budget; a turn longer than the room left has a window to itself, over the budget if need be; an
empty table gives no windows; further columns are left out, and their names do not matter.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from voxtrail.llm.common import BATCH_BYTES, bounded_batches

BUDGET = 2048
HISTORY = 512
HISTORY_TURNS = 4
BLOCK_TURNS = 512
#: Tokens of a turn's own markers.
TURN_TOKENS = 6
_SALTS = 64
OPEN, BETWEEN, CLOSE = "### ", ": ", "</turn>\n"
#: What is escaped, in the order in which it is done; no code holds what a later one replaces.
ESCAPES = (("\\", "\\\\"), ("###", "\\H"), ("</turn>", "\\T"))
WINDOWS = "conv_id long, block long, window int, repeated int, n_turns int, n_tokens long, text string, loss array<struct<start:int,length:int>>, alone boolean, closing boolean"
DIGESTS = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escape(text: str, codes: tuple = ESCAPES) -> str:
    for plain, code in codes:
        text = text.replace(plain, code)
    return text


def escape_role(role: str, codes: tuple = ESCAPES) -> str:
    """A role's first colon would end it."""
    return escape(role, codes).replace(":", "\\C")


def unescape(text: str, codes: tuple = ESCAPES) -> str:
    """Pairs of backslashes are taken from the left, so what is between them holds codes only."""
    parts = text.split("\\\\")
    for plain, code in (*codes[1:], (":", "\\C")):
        parts = [p.replace(code, plain) for p in parts]
    return "\\".join(parts)


def read_turns(text: str) -> list[tuple[str, str]]:
    """Roles and texts of a window's turns."""
    turns = (part[len(OPEN) :].split(BETWEEN, 1) for part in text.split(CLOSE)[:-1])
    return [(unescape(role), unescape(body)) for role, body in turns]


def count_tokens(text: Column) -> Column:
    """Pieces of at most eight characters, a word's with the space before it: texts of any kind have their number bounded from below."""
    return F.regexp_count(text, F.lit(r"\s?\S{1,8}|\s{1,8}")).cast("long")


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


class Windows:
    """Windows of one block, fed turn by turn: (role, text, tokens, tokens up to its end)."""

    def __init__(self, budget: int, history: int, history_turns: int) -> None:
        self.budget, self.history, self.history_turns = budget, history, history_turns
        self.system: tuple | None = None
        self.first = True
        #: The last turns, and the prefix sums at which they begin.
        self.past: list[tuple] = []
        self.starts: list[int] = []
        self.before: list[tuple] = []
        self.span: list[tuple] = []
        self.origin = self.number = 0

    def lead(self, turn: tuple | None) -> None:
        """A later block's system turn, or None: this block is not the first."""
        self.first = False
        self.keep_system(turn)

    def keep_system(self, turn: tuple | None) -> bool:
        """Whether the turn is repeated from now on."""
        self.system = turn if turn is not None and turn[2] <= self.budget // 2 else None
        return self.system is not None

    def remember(self, turn: tuple) -> None:
        self.past.append(turn)
        self.starts.append(turn[3] - turn[2])
        del self.past[: -self.history_turns], self.starts[: -self.history_turns]

    def add(self, turn: tuple) -> tuple | None:
        """The window that this turn ends, if any."""
        done = None
        fixed = self.system[2] if self.system and not self.holds_system() else 0
        if self.span and fixed + turn[3] - self.origin > self.budget:
            done = self.close()
        if not self.span:
            head = self.system[2] if self.system else 0
            start = turn[3] - turn[2]
            room = min(self.history, self.budget - head - turn[2])
            at = bisect_left(self.starts, start - room) if room > 0 else len(self.past)
            self.before = self.past[at:]
            self.origin = self.starts[at] if self.before else start
        self.span.append(turn)
        opening = self.first and turn[0] == "system" and self.keep_system(turn)
        self.first = False
        if not opening:
            self.remember(turn)
        return done

    def holds_system(self) -> bool:
        """Whether the window's own span begins with the system turn."""
        return bool(self.span) and self.span[0] is self.system

    def close(self) -> tuple | None:
        """(window, repeated, turns, tokens, text, loss) of the open window."""
        if not self.span:
            return None
        context = ([self.system] if self.system and not self.holds_system() else []) + self.before
        parts, loss, at = [], [], 0
        for i, (role, text, *_) in enumerate(context + self.span):
            head, body = OPEN + escape_role(role) + BETWEEN, escape(text)
            if role == "assistant" and i >= len(context):
                loss.append({"start": at + len(head), "length": len(body)})
            parts += (head, body, CLOSE)
            at += len(head) + len(body) + len(CLOSE)
        out = (self.number, len(context), len(context) + len(self.span), sum(t[2] for t in context + self.span), "".join(parts), loss)
        self.number += 1
        self.span, self.before = [], []
        return out


def blocks(turns: DataFrame, tokens=count_tokens, history_turns: int = HISTORY_TURNS, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """Turns by block, in order, with prefix sums of their tokens.

    Kind 0 marks a block that is not alone, with the system turn if it is a later one; 1 are turns before the block, 2 its own.
    """
    number = F.coalesce(F.col("turn").cast("long"), F.lit(-1))
    base = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.floor(number / block_turns).alias("block"),
        number.alias("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    # Conversations of several blocks: each block learns that it is not alone, every later one gets the first row's text if that is a system turn.
    per = base.groupBy("conv_id", "block").agg(F.min(F.struct("turn", "role")).alias("head"))
    ends = per.groupBy("conv_id").agg(F.min(F.struct("block", "head")).alias("first"), F.max("block").alias("last")).filter("first.block < last")
    ends = ends.select(F.col("conv_id").alias("conv"), F.col("first.block").alias("from"), F.col("first.head").alias("head"))
    opening = F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("turn") == F.col("head.turn")) & (F.col("head.role") == "system")
    leads = base.filter("role = 'system'").join(ends, opening).groupBy("conv").agg(F.min("text").alias("lead"))
    leads = leads.select(F.col("conv").alias("of"), "lead")
    leads = ends.join(leads, F.col("conv").eqNullSafe(F.col("of")), "left").select("conv", "from", "lead", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("salt"))
    same = F.col("conv_id").eqNullSafe(F.col("conv")) & (F.pmod("block", F.lit(_SALTS)) == F.col("salt"))
    role = F.when(F.col("block") == F.col("from"), "first").when(F.col("lead").isNotNull(), "system").otherwise("")
    lead = F.when(role == "system", F.col("lead")).otherwise("")
    carried = per.join(leads, same).select("conv_id", "block", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("turn"), role.alias("role"), lead.alias("text"))
    own = F.struct(F.col("block"), F.lit(2).alias("kind"))
    next_ = F.when(F.pmod("turn", F.lit(block_turns)) >= block_turns - history_turns, F.struct((F.col("block") + 1).alias("block"), F.lit(1).alias("kind")))
    rows = base.withColumn("at", F.explode(F.array_compact(F.array(own, next_)))).select("conv_id", "at.block", "at.kind", "turn", "role", "text")
    order = ["kind", "turn", "role", "text"]
    rows = rows.unionByName(carried).withColumn("cost", tokens(F.col("text")) + tokens(F.col("role")) + TURN_TOKENS)
    up_to = F.sum(F.when(F.col("kind") > 0, F.col("cost")).otherwise(0)).over(Window.partitionBy("conv_id", "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("up_to", up_to).sortWithinPartitions("conv_id", "block", *order)


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, history_turns: int = HISTORY_TURNS, tokens=count_tokens, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """Windows (WINDOWS) of all conversations, those of a block one after the other.

    `repeated` of a window's turns stand in earlier ones too, `loss` is in code points of `text`, `alone` says that the
    conversation has one block, `closing` that the window is its block's last.
    """
    bounded_batches(turns.sparkSession)
    schema = pa.schema(
        [
            ("conv_id", pa.int64()),
            ("block", pa.int64()),
            ("window", pa.int32()),
            ("repeated", pa.int32()),
            ("n_turns", pa.int32()),
            ("n_tokens", pa.int64()),
            ("text", pa.string()),
            ("loss", _SPANS),
            ("alone", pa.bool_()),
            ("closing", pa.bool_()),
        ]
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, alone, out, size = None, None, True, [], 0
        for batch in batches:
            for conv, block, kind, role, text, cost, up_to in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "block", "kind", "role", "text", "cost", "up_to"))):
                if (conv, block) != key:
                    if state is not None and (last := state.close()):
                        out.append((*key, *last, alone, True))
                        size += len(last[4])
                    key, state, alone = (conv, block), Windows(budget, history, history_turns), True
                turn = (role, text, cost, up_to)
                if kind == 0:
                    alone = False
                    if role != "first":
                        state.lead(turn if role else None)
                elif kind == 1:
                    state.first = False
                    state.remember(turn)
                elif full := state.add(turn):
                    out.append((*key, *full, alone, False))
                    size += len(full[4])
                if size > BATCH_BYTES // 4:
                    yield _batch(out, schema)
                    out, size = [], 0
        if state is not None and (last := state.close()):
            out.append((*key, *last, alone, True))
        if out:
            yield _batch(out, schema)

    return blocks(turns, tokens, history_turns, block_turns).mapInArrow(cut, WINDOWS)


class Digest:
    """What is read back from a conversation's windows, taken in order."""

    def __init__(self) -> None:
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n = self.chars = self.formatted = 0

    def add(self, text: str, repeated: int, spans: list[dict]) -> None:
        for role, body in read_turns(text)[repeated:]:
            self.turns.update(f"{role}\n{body}\n".encode())
            self.n += 1
        for span in spans:
            target = unescape(text[span["start"] : span["start"] + span["length"]])
            self.loss.update(target.encode())
            self.chars += len(target)
        self.formatted += len(text)

    def row(self) -> tuple:
        return self.n, self.turns.hexdigest(), self.chars, self.loss.hexdigest(), self.formatted


def read_back(made: DataFrame) -> DataFrame:
    """conv_id, turns, hashes of all turns and of all text under the mask, read from windows in the order in which `windows` gives them.

    Conversations of one block are read where their windows lie.  Others' windows are brought together first: a
    digest runs through them in order, so they pass through one task, a window at a time.
    """
    bounded_batches(made.sparkSession)
    told = [("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
    at = [("conv_id", pa.int64()), ("block", pa.int64()), ("window", pa.int32())]
    given = [("repeated", pa.int32()), ("text", pa.string()), ("loss", _SPANS)]
    between, final = pa.schema(at + given + told), pa.schema(at[:1] + told)

    def here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, due = None, (None, 0)
        for batch in batches:
            rows = []
            for conv, block, window, repeated, text, spans, alone, closing in zip(*(batch.column(c).to_pylist() for c in (*between.names[:6], "alone", "closing"))):
                if not alone:
                    rows.append((conv, block, window, repeated, text, spans, *[None] * 5))
                    continue
                if digest is None:
                    digest, due = Digest(), (conv, 0)
                if (conv, window) != due:
                    raise ValueError(f"window {window} of conversation {conv} is out of order")
                digest.add(text, repeated, spans)
                due = (conv, window + 1)
                if closing:
                    rows.append((conv, block, window, None, None, None, *digest.row()))
                    digest = None
            if rows:
                yield _batch(rows, between)

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, of = None, None
        for batch in batches:
            rows = []
            for conv, repeated, text, spans, *done in zip(*(batch.column(c).to_pylist() for c in ("conv_id", *(n for n, _ in given + told)))):
                if digest is not None and (text is None or conv != of):
                    rows.append((of, *digest.row()))
                    digest = None
                if text is None:
                    rows.append((conv, *done))
                    continue
                if digest is None:
                    digest, of = Digest(), conv
                digest.add(text, repeated, spans)
            if rows:
                yield _batch(rows, final)
        if digest is not None:
            yield _batch([(of, *digest.row())], final)

    order = [n for n, _ in at]
    kept = made.mapInArrow(here, f"conv_id long, block long, window int, repeated int, text string, loss array<struct<start:int,length:int>>, {DIGESTS}")
    return kept.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(together, f"conv_id long, {DIGESTS}")


def with_control_strings(turns: DataFrame) -> DataFrame:
    """The turns and conversation -7, whose texts look like the template."""
    said = F.lit("\\### Assistant: </turn> ok")
    more = turns.sparkSession.range(2, numPartitions=1).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    return turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(more)


def format_conversations(turns: DataFrame) -> DataFrame:
    """What is read back from the windows of all conversations and conversation -7."""
    return read_back(windows(with_control_strings(turns)))
