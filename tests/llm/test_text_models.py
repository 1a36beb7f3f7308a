"""Toxicity, language, URL trees and the recurrent model: held-out accuracy, probabilities, awkward tables."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxtrail.llm import gru, langid, toxicity, urls
from voxtrail.llm.common import table

SF = "/root/testdata/sf0.01"


def held(doc_id, m):
    return zlib.crc32(str(doc_id).encode()) % m


def test_language_accuracy_and_contract(spark):
    docs = table(spark, SF, "documents")
    out = langid.identify_documents(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(out) == docs.count() and all(r.held_out == (held(r.doc_id, 5) == 0) for r in out)
    fold = [r for r in out if r.held_out]
    assert np.mean([r.lang == r.lang_pred for r in fold]) > 0.97
    assert all(0 <= r.score <= 1 for r in out)


def test_language_awkward(spark, docs_of, awkward):
    docs = docs_of([(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), *((10 + i, t, None) for i, t in enumerate(awkward)), (None, "the", "en")])
    out = {r.doc_id: r for r in langid.identify_documents(docs).collect()}
    und = [10 + i for i, t in enumerate(awkward) if not any(c.isalpha() for c in t or "")]
    assert und and all(out[i].lang_pred == "und" and out[i].score == 0 for i in und)
    assert out[1].lang_pred == "en" and out[2].lang_pred == "de" and None in out
    empty = langid.identify_documents(docs_of([]))
    assert empty.collect() == []
    assert {r.lang_pred for r in langid.identify_documents(docs_of(["abc"])).collect()} == {"und"}


def test_unseen_words_fall_back_to_shorter_grams():
    m = langid.fit([("thething something", "en"), ("scheinlich freundlich", "de")])
    assert m.predict("everything")[0] == "en" and m.predict("wahrlich")[0] == "de"
    assert "lich" in m.gram_row and "everything" not in m.word_row


def test_kneser_ney_sums_to_one():
    model = toxicity.KneserNey(toxicity._counts(Counter({"abab": 3, "abc": 2, "b": 5})), {c: 0.25 for c in "abc>"}, 0.0)
    for context in ("", "<", "<a", "<ab", "b", "zz"):
        assert sum(model.char(context, c) for c in "abc>") == pytest.approx(1.0)


def test_log_ratios_equal_the_two_models_by_hand():
    rows = [(f"plain words here number {i % 7} and more of them", 0) for i in range(40)] + [(f"vile vileword and vilest words {'again' * (i % 3)}", 1) for i in range(20)]
    a, b = toxicity.class_models(rows)
    model = toxicity.Model(*toxicity._ratios(a, b), 1.0, 0.0)
    for word in ("vile", "plain", "words", "vilewordy", "unknown", "zz", "them", "v", "againagain", "numbervile"):
        assert model.word(word) == pytest.approx(a.word(word) - b.word(word))
    text = "plain vile words here"
    each = [(a.word(w) - b.word(w), len(w) + 1) for w in text.split()]
    n = toxicity.WINDOW
    assert model.difference(text) == pytest.approx(max(sum(x for x, _ in each[i : i + n]) / sum(c for _, c in each[i : i + n]) for i in range(len(each) - n + 1)))
    assert toxicity.discounts({"h": Counter("aabbbcccc")}) == [0.0, 0.5, 0.5, 0.5]


def test_toxicity_held_out(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    out = toxicity.score_documents(docs, labels).join(labels, "doc_id").collect()
    assert all(r.held_out == (held(r.doc_id, 5) == 0) and r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in out)
    pos, neg = ([r.score for r in out if r.held_out and r.toxic == y] for y in (1, 0))
    assert np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg]) > 0.9


def test_toxicity_awkward(spark, docs_of, awkward):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (99, 1), (1, 0), (None, 1)], "doc_id long, toxic int")
    out = toxicity.score_documents(docs_of(awkward), labels).collect()
    assert len(out) == len(awkward) and all(0 <= r.score <= 1 for r in out)
    assert toxicity.score_documents(docs_of([]), labels).collect() == []
    assert len(toxicity.score_documents(docs_of(awkward), labels.limit(0)).collect()) == len(awkward)


def test_toxic_word_raises_the_score():
    rows = [(f"plain words here number {i % 7} and more of them", 0) for i in range(60)] + [(f"plain words here vileword number {i % 7} and more of them", 1) for i in range(20)]
    m = toxicity.fit(rows)
    assert m.score("plain words vileword and more of them here") > 0.5 > m.score("plain words here and more of them")


def test_gru_scores_match_brute_counts(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    out = gru.score_documents(docs, fit_tokens=20_000).collect()
    texts = {r.doc_id: gru.tokens(r.text) for r in docs.collect()}
    counts = Counter(t for i, ts in texts.items() if held(i, 7) != 2 for t in ts)
    n, v = sum(counts.values()), len(counts)
    for r in out:
        ts = texts[r.doc_id]
        assert (r.n_tokens, r.train_tokens, r.held_out) == (len(ts), n, held(r.doc_id, 7) == 2)
        assert r.n_known == sum(t in counts for t in ts)
        assert r.base_score == pytest.approx(sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in ts))
    fold = [r for r in out if r.held_out]
    assert sum(r.score for r in fold) > sum(r.base_score for r in fold)


def test_gru_is_a_distribution_and_carries_state():
    net = gru.Gru.start(np.array([5.0, 3, 8, 2, 1, 9, 4]), classes=3)
    state = np.random.default_rng(0).standard_normal((1, gru.HIDDEN)).astype(np.float32)
    assert np.exp([net.outputs(state, np.array([k]))[0][0] for k in range(7)]).sum() == pytest.approx(1, abs=1e-5)
    line = np.arange(100) % 7
    alone = net.score([line], 0)[0]
    h, before, total = np.zeros((1, gru.HIDDEN), np.float32), 0, 0.0
    for k in line:
        h, _ = net.step(net.p["E"][[before]] @ net.p["W"] + net.p["b"], h)
        total += net.outputs(h, np.array([k]))[0][0]
        before = k
    assert alone == pytest.approx(total, rel=1e-4)
    assert net.score([line, line[:3], line], 0)[2] == pytest.approx(alone, rel=1e-4)


def test_gru_gradients():
    rng = np.random.default_rng(0)
    net = gru.Gru.start(np.array([5.0, 3, 8, 2, 1, 9, 4, 4]), classes=3)
    net.p = {k: p.astype(np.float64) for k, p in net.p.items()}
    args = (rng.integers(0, 8, (5, 3)), rng.integers(0, 8, (5, 3)), np.zeros((3, gru.HIDDEN)), rng.random((5, 3)) < 0.8)
    grads = net.window(*args, True)[2]
    for k, p in net.p.items():
        at = tuple(rng.integers(0, s) for s in p.shape)
        ends = []
        for e in (1e-4, -1e-4):
            p[at] += e
            ends.append(-net.window(*args, False)[0].sum())
            p[at] -= e
        assert (ends[0] - ends[1]) / 2e-4 == pytest.approx(grads[k][at], rel=2e-2, abs=1e-4)


def test_gru_awkward(spark, docs_of, awkward):
    out = gru.score_documents(docs_of(awkward), fit_tokens=2_000).collect()
    assert len(out) == len(awkward) and all(math.isfinite(r.score) and r.score <= 0 for r in out)
    assert {r.n_tokens for r in out if r.doc_id in (0, 1, 2)} == {1}
    assert gru.score_documents(docs_of([]), fit_tokens=100).collect() == []


def pages(spark, rows):
    return spark.createDataFrame([(i, u, "h", 1.0) for i, u in enumerate(rows)], "page_id long, url string, html string, score double")


def test_url_rules(spark):
    cases = {
        "http://a.net/x": ("a.net", "/x", "net/", "block"),
        "http://EXAMPLE.net/en/1?q#f": ("example.net", "/en/1", "example.net/en/", "allow"),
        "https://m.example.net/en/": ("m.example.net", "/en/", "example.net/en/", "allow"),
        "http://badexample.net/en/": ("badexample.net", "/en/", "net/", "block"),
        "http://www.example.com/de/9": ("www.example.com", "/de/9", "example.com/de/", "block"),
        "http://x.org/fr/": ("x.org", "/fr/", "org/fr/", "allow"),
        "http://x.org/en/": ("x.org", "/en/", None, None),
        "http://a.net": ("a.net", "", None, None),
        "a.net/x": ("", "", None, None),
        None: ("", "", None, None),
        "http://É.net/?": ("É.net", "/", "net/", "block"),
    }
    out = urls.judge(pages(spark, list(cases))).orderBy("page_id").collect()
    for r, (host, path, rule, verdict) in zip(out, cases.values()):
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict in ("allow", "block")
        assert verdict is None or r.verdict == verdict


def test_url_trees_learn_and_score_natively(spark):
    rng = np.random.default_rng(0)
    rows = [(f"http://host{rng.integers(1000)}.com/{'a/' * int(k)}p{'9' * (20 if bad else 1)}", int(bad)) for k, bad in zip(rng.integers(1, 6, 400), rng.random(400) < 0.4)]
    df = spark.createDataFrame(rows, "url string, block int")
    model = urls.fit(df)
    got = urls.add_features(df).withColumn("s", model.score()).select(((F.col("s") > 0).cast("int") == F.col("block")).alias("ok")).collect()
    assert np.mean([r.ok for r in got]) > 0.95


def _by_hand(model, row):
    """A model's score of one row's features, by walking its trees."""
    values = [row[f] for f in urls.FEATURES[:-1]] + [model.suffix.get(row["suffix"], 0.0)]

    def walk(node):
        while not isinstance(node, float):
            node = node[2] if values[node[0]] <= node[1] else node[3]
        return node

    return model.base + sum(walk(t) for t in model.trees)


def test_url_verdicts_equal_trees_walked_by_hand(spark):
    table_ = table(spark, SF, "pages")
    host, path = urls.host_and_path(F.col("url"))
    labelled = table_.select("url", urls.matching_rule(host, path, urls.RULES, "verdict").alias("v")).filter("v is not null")
    model = urls.fit(labelled.select("url", (F.col("v") == "block").cast("int").alias("block")))
    rows = {r["page_id"]: r.asDict() for r in urls.add_features(table_.select("page_id", "url")).collect()}
    for r in urls.judge(table_).collect():
        want = _by_hand(model, rows[r.page_id])
        assert r.score == pytest.approx(1 / (1 + math.exp(-want)))
        assert r.rule is not None or r.verdict == ("block" if want >= 0 else "allow")


def test_url_features_by_hand(spark):
    url = "HTTP://www.Shop-1.example.com/a/b-c/42?x=1&y=2#z"
    r = urls.add_features(spark.createDataFrame([(url,)], "url string")).first()
    share = Counter(url)
    entropy = -sum(n / len(url) * math.log2(n / len(url)) for n in share.values())
    assert (r.host, r.path, r.suffix) == ("www.shop-1.example.com", "/a/b-c/42", "com")
    assert (r.length, r.host_length, r.path_length, r.depth, r.host_dots, r.hyphens, r.parameters) == (len(url), 22, 9, 3, 3, 2, 2)
    assert r.digit_ratio == pytest.approx(5 / len(url)) and r.entropy == pytest.approx(entropy)


def test_url_in_very_many_rows_is_one_row_of_the_sample(spark):
    many = spark.range(50_000).selectExpr("'http://hot.example.net/x' as url", "1 as block")
    few = spark.createDataFrame([(f"http://h{i}.example.org/p{i}", i % 2) for i in range(400)], "url string, block int")
    model = urls.fit(many.unionByName(few), max_rows=300)
    assert {"net", "org"} >= set(model.suffix) and model.suffix


def test_url_odds_do_not_tell_a_row_its_own_label():
    hosts = [f"h{i}.example.com" for i in range(40)]
    y = np.arange(40) % 2.0
    odds = urls.other_odds([f"own{i}" for i in range(40)], hosts, y, np.ones(40))
    assert not odds.any()


def test_url_empty_and_unlabelled(spark):
    assert urls.judge(pages(spark, ["http://a.com/"]).limit(0)).collect() == []
    assert [r.verdict for r in urls.judge(pages(spark, ["http://a.com/"])).collect()] == ["allow"]


def test_gru_learns_from_every_training_document(spark):
    schema = "doc_id long, text string"
    rows = [(i, " ".join(f"w{(i * k) % 7}" for k in range(1, 30))) for i in range(24)]
    symbol = {gru.END: 1, **{f"w{i}".encode(): i + 2 for i in range(7)}}

    def learnt(some):
        net = gru.Gru.start(np.array([1.0, 24, *[90.0] * 7]), classes=3)
        fitted = gru.Scorer(net, symbol, {}, 24 * 30, 8, -3.0)
        gru.refine(spark.createDataFrame(some, schema).coalesce(1), fitted)
        return np.concatenate([net.p[k].ravel() for k in sorted(net.p)])

    whole = learnt(rows)
    for i in (0, 11, 23):
        assert not np.array_equal(learnt([(k, "w1 w1 w1 " + t if k == i else t) for k, t in rows]), whole)
