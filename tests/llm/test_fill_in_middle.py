"""Cuts against a plain reading of all units, forms, markers in texts, restoration, and SQL over a whole table."""

import hashlib
import re

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from voxtrail.llm import fim
from voxtrail.llm.common import table
from voxtrail.llm.queries import ORACLE

SF = "/root/testdata/sf0.01"
UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(doc_id, text):
    text = text or ""
    h = [int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[8 * i : 8 * i + 8], 16) for i in range(4)]
    units = UNIT.findall(text)
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    prefix, middle, suffix = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, text
    if h[3] % 100 < 80:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abé中\U0001f642 \t\n\x0b\x0c\r\x1c  ", max_size=60), st.integers(1, 5), st.integers(1, 9))
def test_checkpoints_find_every_unit(text, step, block):
    data, units = text.encode(), UNIT.findall(text)
    index, forward = fim.Checkpoints(data, step, block), {}
    assert index.n == len(units)
    for k in range(len(units) + 1):
        before = "".join(units[:k])
        assert index.locate(k, forward) == (len(before.encode()), len(before))
    assert len(index.units) <= len(units) // step + 1


def test_the_index_of_a_long_text_is_sparse_and_is_read_little():
    text = ("été " * 300_000).encode()
    index, forward = fim.Checkpoints(text), {}
    assert index.n == 300_001 and len(index.units) == 300_000 // fim.STEP + 1
    assert index.locate(299_999, forward) == (299_999 * 6 - 1, 299_999 * 4 - 1)
    assert max(forward) < fim.STEP


def test_equal_to_a_plain_reading(spark, docs_of, awkward):
    texts = awkward + ["keeps <P> as it is", "<", "a <S b", "<<S", "x" * 10 + " <M", "tail  \r\n", "  not a space"] * 6
    docs = docs_of([(i, t, None) for i, t in enumerate(texts)] + [(None, "no id at all", None), (-5, "below zero here", None), (3, "again", None), (3, "again", None)])
    rows = fim.transform(docs).withColumn("back", fim.restore(fim.F.col("fim.output"), fim.F.col("fim.form"))).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert tuple(r.fim) == plain(r.doc_id, r.text)
        assert r.back == (r.text or "")
    assert {r.fim.form for r in rows} == {"plain", "spm", "psm"}


def test_columns_stay_and_empty_tables_pass(docs_of):
    docs = docs_of([(1, "one two", None)]).withColumnRenamed("score", "row").withColumnRenamed("component_id", "body")
    out = fim.transform(docs)
    assert out.columns == [*docs.columns, "fim"] and out.first().row == "x"
    assert fim.fill_in_middle_documents(docs_of([])).count() == 0
    assert fim.transform(docs, out="body").first().body.n == 2


@pytest.mark.parametrize("form", ["spm", "psm"])
def test_every_cut_is_restored(spark, form):
    texts = ["<a <S b <M c", "S> x", " <P", "\U0001f642 y"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 20)], "doc_id long, text string")
    rows = fim.transform(df, rate=100, spm=100 if form == "spm" else 0).withColumn("back", fim.restore(fim.F.col("fim.output"), fim.F.col("fim.form"))).collect()
    assert {r.fim.form for r in rows} == {form} and all(r.back == r.text for r in rows)


def test_whole_table_equals_sql(spark):
    duckdb.sql(f"create or replace view documents as select * from '{SF}/documents.parquet'")
    want = duckdb.sql(ORACLE["op11_fill_in_middle"]).df().sort_values("doc_id", ignore_index=True)
    got = fim.fill_in_middle_documents(table(spark, SF, "documents")).toPandas().sort_values("doc_id", ignore_index=True)
    assert got.shape == want.shape and list(got.columns) == list(want.columns)
    for c in got.columns:
        assert (got[c].fillna(-1).to_numpy() == want[c].fillna(-1).to_numpy()).all(), c
    assert np.isin(["plain", "spm", "psm"], got.form).all()
