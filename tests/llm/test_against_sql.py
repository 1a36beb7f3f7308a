"""Columns with one right answer against SQL, and cases that all operators share: repeated ids and long texts."""

import duckdb
import numpy as np
import public_tokenizers as P
import pytest

from voxtrail.llm import bpe, fingerprint, gru, langid, packing, pii, simhash, toxicity, urls
from voxtrail.llm.common import table

SF = "/root/testdata/sf0.01"


def test_edited_texts_equal_sql(spark):
    sql = f"""
        with d as (select doc_id, coalesce(text, '') as text from '{SF}/documents.parquet'),
        n as (select doc_id, text, coalesce(lead(text) over (order by doc_id desc), first(text) over (order by doc_id desc)) as next from d)
        select doc_id, length(text) as n_chars, sha256(left(text, length(text) - length(text) // 2) || left(next, length(text) // 2)) as edited_sha256 from n
    """
    want = {i: (n, h) for i, n, h in duckdb.sql(sql).fetchall()}
    got = {r.doc_id: (r.n_chars, r.edited_sha256) for r in fingerprint.fingerprint_documents(table(spark, SF, "documents")).collect()}
    assert got == want


def test_rules_equal_sql(spark):
    sql = f"""
        with u as (select page_id, coalesce(case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) end, '') as rest from '{SF}/pages.parquet'),
        p as (select page_id, lower(regexp_extract(rest, '^[^/?#]*')) as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u)
        select *, case when (host = 'example.net' or host like '%.example.net') and path like '/en/%' then 'example.net/en/'
            when (host = 'example.com' or host like '%.example.com') and path like '/de/%' then 'example.com/de/'
            when (host = 'org' or host like '%.org') and path like '/fr/%' then 'org/fr/'
            when (host = 'net' or host like '%.net') and path like '/%' then 'net/' end as rule from p
    """
    want = {r[0]: r[1:] for r in duckdb.sql(sql).fetchall()}
    out = urls.judge(table(spark, SF, "pages")).collect()
    verdict = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
    assert {r.page_id: (r.host, r.path, r.rule) for r in out} == want
    assert all(r.verdict == verdict[r.rule] for r in out if r.rule) and sum(r.rule is not None for r in out) > 50


REPEATED = [(1, "one two three 10.0.0.1", "en"), (1, "one two three 10.0.0.1", "en"), (1, "other words here", "de"), (None, "no id", "en"), (2, None, None)]


@pytest.mark.parametrize(
    "name,apply",
    [
        ("pii", lambda d: pii.pseudonymise_documents(d, pii.KEY)),
        ("bpe", lambda d: bpe.round_trip_documents(d, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)),
        ("packing", lambda d: packing.pack(d, P.path("word_bpe_49k.json"))),
        ("simhash", simhash.group_documents),
        ("fingerprint", fingerprint.fingerprint_documents),
        ("langid", langid.identify_documents),
        ("gru", lambda d: gru.score_documents(d, fit_tokens=100)),
        ("toxicity", lambda d: toxicity.score_documents(d, d.selectExpr("doc_id", "0 as toxic"))),
    ],
)
def test_repeated_and_null_ids_keep_their_rows(docs_of, name, apply):
    rows = apply(docs_of(REPEATED)).collect()
    assert sorted(str(r.doc_id) for r in rows) == ["1", "1", "1", "2", "None"], name


def test_long_texts_are_scored_whole_beside_short_ones():
    rng = np.random.default_rng(0)
    net = gru.Gru.start(np.array([5.0, 3, 8, 2, 1, 9, 4]), classes=3)
    long, short = rng.integers(0, 7, 120_000), [rng.integers(0, 7, n) for n in (1, 5, 40)]
    together = net.score([long.astype(np.int32), *short], 0)
    assert together[0] == pytest.approx(net.score([long], 0)[0], rel=1e-5)
    assert [net.score([s], 0)[0] for s in short] == pytest.approx(together[1:].tolist(), rel=1e-4)


def test_fingerprint_of_a_very_long_text_takes_bounded_memory():
    import tracemalloc

    text = " ".join(map(str, range(400_000)))
    words = text.encode().split()
    tracemalloc.start()
    simhash.fingerprint(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 * sum(len(w) + 40 for w in words)
