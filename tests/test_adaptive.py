"""The nearest rows by adaptive cells against brute force, at any density."""

import numpy as np
import pandas as pd
import pytest

from voxtrail.operators import adaptive

SCHEMA = "k string, id long, y double, x double, nearest string"


def frame(places, key="a", start=0):
    return pd.DataFrame([(key, start + i, float(y), float(x), "kept out") for i, (y, x) in enumerate(places)], columns=SCHEMA.replace(",", "").split()[::2])


def brute(left, right, own):
    out = {}
    for a in left.itertuples():
        b = right[(right.k == a.k) & ~(own & (right.id == a.id))]
        if len(b):
            out[a.k, a.id] = min(((a.y - q.y) * (a.y - q.y) + (a.x - q.x) * (a.x - q.x), q.id) for q in b.itertuples())
    return out


def answer(spark, left, right, own, **more):
    a, b = (spark.createDataFrame(d, SCHEMA) for d in (left, right))
    got = adaptive.nearest_anywhere(a, b, ["k"], ["y", "x"], ["k", "id"], "id", "id" if own else None, **more)
    assert got.columns == ["k", "id", "nearest", "d"]
    rows = got.collect()
    assert len({(r.k, r.id) for r in rows}) == len(rows)
    return {(r.k, r.id): (r.d, r.nearest) for r in rows}


def same(got, want):
    assert got.keys() == want.keys()
    for q, (d2, i) in want.items():
        assert got[q] == (pytest.approx(d2**0.5), i)


def clouds():
    rng = np.random.default_rng(3)
    crowd = rng.normal(0, 1e-3, (150, 2))
    lonely = rng.uniform(-1e4, 1e4, (25, 2))
    at_one = [(5.0, 5.0)] * 40
    grid = [(i % 6, i // 6) for i in range(36)]
    return pd.concat([frame([*crowd, *lonely, *at_one, *grid]), frame(rng.uniform(0, 1, (60, 2)), "b"), frame([(1, 1)], "c"), frame([(1, 2), (1, 2)], "d")])


def test_every_row_finds_the_nearest_other(spark):
    rows = clouds()
    same(answer(spark, rows, rows, True), brute(rows, rows, True))


@pytest.mark.parametrize("levels", [0, 1])
def test_what_is_crowded_at_the_end_is_joined(spark, levels):
    rows = clouds().iloc[::3]
    same(answer(spark, rows, rows, True, levels=levels), brute(rows, rows, True))


def test_other_sides_and_far_rows(spark):
    right = clouds()
    left = pd.concat([frame([(1e6, -1e6), (0, 0), (2.5, 2.5), (5, 5)]), frame([(0.5, 0.5)], "b"), frame([(0, 0)], "nobody")])
    same(answer(spark, left, right, False), brute(left, right, False))


def test_empty_sides_nulls_and_no_numbers(spark):
    rows = frame([(0, 0), (0, 1), (0, 3)])
    assert answer(spark, rows, rows.iloc[:0], True) == {} == answer(spark, rows.iloc[:0], rows, True)
    odd = [("a", 0, 0.0, 0.0, ""), ("a", 1, None, 0.5, ""), ("a", 2, float("nan"), 0.1, ""), ("a", 3, 0.0, float("inf"), ""), ("a", 4, 0.0, 9.0, ""), (None, 5, 0.0, 0.0, ""), ("a", None, 0.0, 1.0, "")]
    df = spark.createDataFrame(odd, SCHEMA)
    got = adaptive.nearest_anywhere(df.filter("id is not null"), df, ["k"], ["y", "x"], ["k", "id"], "id", "id").collect()
    assert {(r.id, r.nearest, r.d) for r in got} == {(0, 4, 9.0), (4, 0, 9.0)}


def test_few_rows_are_compared(spark, monkeypatch):
    """A crowd beside a far row: the nodes that rows keep open do not grow with the crowd."""
    rng = np.random.default_rng(0)
    rows = frame([*rng.uniform(0, 1, (2000, 2)), (1000.0, 1000.0)])
    kept, pin = [], adaptive.pin

    def counting(df, *more):
        out = pin(df, *more)
        if "hit" in out.columns:
            kept.append(out.count())
        return out

    monkeypatch.setattr(adaptive, "pin", counting)
    same(answer(spark, rows, rows, True, levels=8), brute(rows, rows, True))
    assert max(kept) < 8 * len(rows)


def test_rows_begin_near_their_answer(spark, monkeypatch):
    rng = np.random.default_rng(7)
    rows = pd.concat([frame(rng.uniform(0, 1, (1500, 2))), frame(rng.uniform(0, 1, (300, 2)), "b")])
    sizes, pin = [], adaptive.pin
    monkeypatch.setattr(adaptive, "pin", lambda df, *a: sizes.append((df.columns, (out := pin(df, *a)).count())) or out)
    monkeypatch.setattr(adaptive, "CURVE_ROWS", 2, raising=False)
    same(answer(spark, rows, rows, True), brute(rows, rows, True))
    # Of 16 children of every open node few are held.
    assert sum(n for c, n in sizes if "hit" in c) < 12 * len(rows)
    rows = pd.concat([rows, frame([(50, 50)], "b", 300)])
    few = rows.iloc[::20].assign(y=lambda r: r.y * 30 - 3)
    same(answer(spark, few, rows, False), brute(few, rows, False))
