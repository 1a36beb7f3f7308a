"""Chat windows: escaping, budgets, history and masks against a plain greedy reading, and digests against SQL."""

import hashlib

import duckdb
import pytest
from hypothesis import given, settings, strategies as st

from voxtrail.llm import chat
from voxtrail.llm.common import table

SF = "/root/testdata/sf0.01"
SCHEMA = "conv_id long, turn long, role string, text string, block string, kind string, `window` string"
ODD = st.text(alphabet="\\#H TC:</turn>\n aé\U0001f642", max_size=30)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.tuples(ODD | st.sampled_from(["###", "\\H", "</turn>", "\\\\H", "#####", "\\</turn>"]), ODD), max_size=6))
def test_turns_are_read_back(turns):
    text = "".join(chat.OPEN + chat.escape_role(r) + chat.BETWEEN + chat.escape(t) + chat.CLOSE for r, t in turns)
    assert chat.read_turns(text) == turns
    for _, t in turns:
        assert "###" not in chat.escape(t) and "</turn>" not in chat.escape(t) and chat.unescape(chat.escape(t)) == t


def greedy(turns, budget, history, history_turns, cost):
    """Windows of one conversation as (context, span), turn by turn."""
    system = turns[0] if turns and turns[0][0] == "system" and cost(turns[0]) <= budget // 2 else None
    made, at = [], 0
    while at < len(turns):
        head = system if made else None
        room = min(history, budget - (cost(head) if head else 0) - cost(turns[at]))
        before = []
        for t in reversed(turns[(1 if system else 0) : at][-history_turns:]):
            if sum(map(cost, before)) + cost(t) > room:
                break
            before.insert(0, t)
        span = [turns[at]]
        used = sum(map(cost, before)) + cost(turns[at]) + (cost(head) if head else 0)
        at += 1
        while at < len(turns) and used + cost(turns[at]) <= budget:
            used += cost(turns[at])
            span.append(turns[at])
            at += 1
        made.append((([head] if head else []) + before, span))
    return made


def sizes(spark, turns):
    texts = sorted({x for r, t in turns for x in (r, t)})
    rows = spark.createDataFrame([(x,) for x in texts], "x string").select("x", chat.count_tokens(chat.F.col("x")).alias("n")).collect()
    n = {r.x: r.n for r in rows}
    return lambda turn: n[turn[0]] + n[turn[1]] + chat.TURN_TOKENS


@pytest.mark.parametrize("budget,history", [(60, 20), (40, 0), (200, 60), (10, 5)])
def test_windows_equal_a_plain_reading(spark, budget, history):
    import random

    draw, rows, convs = random.Random(budget), [], {}
    for conv in range(12):
        turns = [("system", "be brief " * draw.randint(0, 8))] if conv % 2 else []
        turns += [(("user", "assistant")[i % 2], "word " * draw.choice([0, 1, 3, 8, 40])) for i in range(draw.randint(0, 40))]
        convs[conv] = turns
        rows += [(conv, i, r, t, "x", "y", "z") for i, (r, t) in enumerate(turns)]
    draw.shuffle(rows)
    cost = sizes(spark, [t for c in convs.values() for t in c])
    made = chat.windows(spark.createDataFrame(rows, SCHEMA), budget, history).orderBy("conv_id", "window").collect()
    for conv, turns in convs.items():
        want = greedy(turns, budget, history, chat.HISTORY_TURNS, cost)
        got = [r for r in made if r.conv_id == conv]
        assert [r.window for r in got] == list(range(len(want)))
        for r, (before, span) in zip(got, want):
            assert chat.read_turns(r.text) == before + span and r.repeated == len(before) and r.n_turns == len(before + span)
            assert r.n_tokens == sum(map(cost, before + span)) and (r.n_tokens <= budget or len(span) == 1 and not (before and before[-1][0] != "system"))
            assert [chat.unescape(r.text[s.start : s.start + s.length]) for s in r.loss] == [t for role, t in span if role == "assistant"]


def test_long_conversations_spread_over_blocks(spark):
    turns = [("system", "hold on")] + [(("user", "assistant")[i % 2], f"turn {i} ###") for i in range(2000)]
    rows = [(5, i, r, t, "", "", "") for i, (r, t) in enumerate(turns)] + [(6, 700, "system", "not the first", "", "", ""), (6, 3, "user", "first", "", "", "")]
    made = chat.windows(spark.createDataFrame(rows, SCHEMA), 100, 30, block_turns=64).orderBy("conv_id", "block", "window").collect()
    own = [t for r in made if r.conv_id == 5 for t in chat.read_turns(r.text)[r.repeated :]]
    assert own == turns
    for r in made:
        if r.conv_id == 5 and (r.block, r.window) > (0, 0):
            told = chat.read_turns(r.text)[: r.repeated]
            assert told[0] == turns[0] and len(told) > 1 and told[1:] == [t for t in turns if t in told[1:]]
    assert {r.block for r in made if r.conv_id == 5} == set(range(32))
    assert [(r.block, r.repeated) for r in made if r.conv_id == 6] == [(0, 0), (10, 0)]
    back = {r.conv_id: r for r in chat.read_back(chat.windows(spark.createDataFrame(rows, SCHEMA), 100, 30, block_turns=64)).collect()}
    said = "".join(t for r, t in turns if r == "assistant")
    assert back[5].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest() and back[5].n_turns == len(turns)
    assert (back[5].loss_chars, back[5].loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest()) and back[6].n_turns == 2
    plan = chat.blocks(spark.createDataFrame(rows, SCHEMA))._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_null_turns_repeats_and_empty_tables(spark):
    rows = [(1, None, None, None), (1, 0, "assistant", "a"), (1, 0, "assistant", "a"), (None, 0, "user", "nobody"), (None, 600, "assistant", "later"), (2, 0, "system", "only")]
    df = spark.createDataFrame([(*r, "", "", "") for r in rows], SCHEMA)
    got = {r.conv_id: r for r in chat.read_back(chat.windows(df)).collect()}
    assert {k: (r.n_turns, r.loss_chars) for k, r in got.items()} == {1: (3, 2), None: (2, 5), 2: (1, 0)}
    empty = chat.format_conversations(df.filter("false")).collect()
    assert [(r.conv_id, r.n_turns) for r in empty] == [(-7, 2)]


def test_windows_out_of_order_are_an_error(spark):
    made = chat.windows(spark.createDataFrame([(1, i, "user", "word " * 30, "", "", "") for i in range(9)], SCHEMA), 60, 0)
    with pytest.raises(Exception, match="out of order"):
        chat.read_back(made.orderBy(chat.F.desc("window"))).collect()


def test_whole_table_equals_sql(spark):
    want = duckdb.sql(f"""
        with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from '{SF}/conversations.parquet'
            union all select -7, i, case i when 0 then 'user' else 'assistant' end, '\\### Assistant: </turn> ok' from range(2) r(i))
        select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn)) as turns_sha256,
            length(coalesce(string_agg(text, '' order by turn) filter (role = 'assistant'), '')) as loss_chars,
            sha256(coalesce(string_agg(text, '' order by turn) filter (role = 'assistant'), '')) as loss_sha256
        from c group by conv_id
    """).fetchall()
    out = chat.format_conversations(table(spark, SF, "conversations"))
    assert out.columns == ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    assert sorted(tuple(r)[:5] for r in out.collect()) == sorted(want)
