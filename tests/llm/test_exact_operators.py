"""Operators with one right answer, against brute force and the libraries they follow."""

import hashlib
import ipaddress
import re
import time
import unicodedata
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import xxhash
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from voxtrail import session
from voxtrail.llm import bpe, fingerprint, golay, graph, packing, pii, simhash, topk
from voxtrail.llm.common import table
from voxtrail.llm.graph import components

SF = "/root/testdata/sf0.001"
RANKS = bpe.read_ranks(open(P.path("byte_bpe_50k.tiktoken"), "rb"))
CODEC = bpe.Codec(RANKS, P.PATTERN)
TIKTOKEN = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
WORDS = packing.WordTokenizer(open(P.path("word_bpe_49k.json"), encoding="utf-8").read())
LIBRARY = Tokenizer.from_file(P.path("word_bpe_49k.json"))


# ---- byte-level BPE


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_bpe_equals_the_library(text):
    ids = CODEC.encode(text)
    assert ids == TIKTOKEN.encode_ordinary(text)
    assert CODEC.decode(ids) == text.encode()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(sorted(RANKS)), min_size=1, max_size=6))
def test_pieces_made_of_tokens(tokens):
    piece = b"".join(tokens)
    assert list(CODEC.transducer.encode(piece)) == TIKTOKEN._core_bpe.encode_single_piece(piece)


def test_moves_made_anew_equal_those_kept():
    small = bpe.Transducer(RANKS, max_moves=20)
    for text in ("antidisestablishmentarianism", "Donaudampfschifffahrt", "aaaaaaaaaaaaaaa", "é" * 30):
        assert small.encode(text.encode()) == CODEC.transducer.encode(text.encode()) == TIKTOKEN._core_bpe.encode_single_piece(text.encode())
    assert len(small.moves) <= 20


def test_tokens_are_emitted_after_bounded_lookahead():
    """What is not yet emitted stays within twice the longest token, however long the piece, and is never taken back."""
    rng, machine = np.random.default_rng(1), bpe.Transducer(RANKS)
    tokens, longest = sorted(RANKS), max(map(len, RANKS))
    pieces = [b"".join(tokens[i] for i in rng.integers(0, len(tokens), 300)) for _ in range(20)]
    pieces += [bytes(rng.integers(97, 101, 3000).tolist()), b"a" * 5000, b" " * 5000, b"=-" * 2000, b"ing" * 2000, rng.bytes(3000)]
    for piece in pieces:
        state, out, most = 0, [], 0
        want = TIKTOKEN._core_bpe.encode_single_piece(piece)
        for byte in piece:
            state, more = machine.moves.get(state * 256 + byte) or machine.move(state, byte)
            out += more
            most = max(most, machine.pending(state))
        assert out + list(machine.states[state][1][-1][0]) == want
        assert most <= 2 * longest


def test_one_long_piece_takes_work_in_proportion():
    rng = np.random.default_rng(0)
    piece = "".join(rng.choice(list("abcdefghijklmnoprstuvwxyzéèñü"), 300_000))
    start = time.process_time()
    ids = CODEC.transducer.encode(piece.encode())
    assert time.process_time() - start < 10
    assert b"".join(CODEC.transducer.token[i] for i in ids).decode() == piece
    assert ids[:1000] == TIKTOKEN._core_bpe.encode_single_piece(piece[:20_000].encode())[:1000]


def test_streaming_never_gives_broken_characters():
    text = "naïve 🙂 café 日本語 "
    d = bpe.StreamDecoder(CODEC.transducer.token)
    parts = [d.feed([i]) for i in CODEC.encode(text)]
    assert b"".join(parts) + d.end() == text.encode() and all(p.decode() is not None for p in parts)


def test_utf8_machine_agrees_with_python():
    for data in (b"\xc0\x80", b"\xed\xa0\x80", b"\xf4\x90\x80\x80", b"\xf0\x9f\x99\x82", "é".encode(), b"\xe0\x80\x80", b"a"):
        state, fits = (0, 0, 0), True
        for b in data:
            state, ok = bpe.utf8_step(state, b)
            fits &= ok
        try:
            data.decode()
            good = True
        except UnicodeDecodeError:
            good = False
        assert (fits and not state[0]) == good


def test_round_trip_table(spark, docs_of, awkward):
    out = {r.doc_id: r for r in bpe.round_trip_documents(docs_of(awkward), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()}
    for i, text in enumerate(awkward):
        ids = TIKTOKEN.encode_ordinary(text or "")
        assert out[i].n_tokens == len(ids)
        assert out[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert out[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    ids = docs_of(["abc déf"]).select(bpe.encode_column(spark, F.col("text"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).alias("i"))
    assert ids.first().i == TIKTOKEN.encode_ordinary("abc déf")
    assert bytes(ids.select(bpe.decode_column(spark, F.col("i"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).alias("d")).first().d).decode() == "abc déf"


# ---- packing


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8", exclude_categories=("Cs",)), st.sampled_from(" .,'!AbcİΣß\x1ćé")), max_size=50))
def test_words_give_the_library_ids(text):
    got = np.frombuffer(WORDS.encode_batch([text])[0], "<u4").tolist()
    assert got == LIBRARY.encode(text, add_special_tokens=False).ids


def test_special_marks_in_texts_follow_the_library():
    for text in ("a <|endoftext|> b", "a<|startoftext|>b"):
        assert np.frombuffer(WORDS.encode_batch([text])[0], "<u4").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_marks_after_letters_that_decompose_follow_the_library():
    letters = [c for c in map(chr, range(0x80, 0x30000)) if c.isalnum() and (len(c.lower()) > 1 or unicodedata.normalize("NFC", c) != c)]
    assert "İ" in letters and "\u0958" in letters
    for c in letters:
        for text in (f"{c}?", f"ab{c}!?", f"{c}' x", f"A{c}. b"):
            assert np.frombuffer(WORDS.encode_batch([text])[0], "<u4").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids, text


def test_words_that_were_forgotten_are_encoded_again():
    small = packing.WordTokenizer(open(P.path("word_bpe_49k.json"), encoding="utf-8").read(), 3)
    for text in ("one two, Three", "four five six!", "one two seven", "Three, one eight", "", "nine one"):
        assert np.frombuffer(small.encode_batch([text, text])[1], "<u4").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def _packed(lengths, capacity, **more):
    item, start, length, window = packing.pack_lengths(np.array(lengths, np.int64), capacity, **more)
    assert not lengths or np.bincount(window, length).max() <= capacity
    for i, n in enumerate(lengths):
        own = sorted(zip(start[item == i].tolist(), length[item == i].tolist()))
        assert own[0][0] == 0 and sum(m for _, m in own) == n and all(a + m == b for (a, m), (b, _) in zip(own, own[1:]))
    return item, window


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60), st.integers(64, 100))
def test_windows_hold_their_pieces(lengths, capacity):
    _packed(lengths, capacity, grain=8)


def test_most_items_stay_whole_and_little_is_empty():
    rng = np.random.default_rng(3)
    for lengths in (rng.integers(1, 2048, 600), np.minimum(2047, rng.lognormal(5.5, 1.2, 1500).astype(int) + 1), np.full(400, 1100)):
        item, window = _packed(lengths.tolist(), 2048)
        assert (window.max() + 1) * 2048 <= 1.016 * lengths.sum() + 2048
        if len(set(lengths)) > 1:
            assert (np.bincount(item) == 1).mean() > 0.8


def test_differencing_levels_known_sets():
    sums = lambda x, k: sorted(np.bincount(packing.differencing(np.array(x), k), x, k))
    assert sums([8, 7, 6, 5, 4], 2) == [14, 16]  # the method's well-known answer
    assert sums([4, 4, 4, 4, 2, 2], 2) == [10, 10]
    assert sums([5], 3) == [0, 0, 5]


def test_packed_table(spark, docs_of, awkward):
    out = packing.pack(docs_of(awkward), P.path("word_bpe_49k.json")).toPandas()
    for i, text in enumerate(awkward):
        ids = LIBRARY.encode(text or "", add_special_tokens=False).ids + [1]
        rows = out[out.doc_id == i].sort_values("start")
        assert rows.length.sum() == len(ids) and (rows.doc_tokens == len(ids)).all()
        data = np.array(ids, "<u4").tobytes()
        assert [zlib.crc32(data[4 * a : 4 * (a + n)]) for a, n in zip(rows.start, rows.length)] == rows.ids_crc32.tolist()
    for _, s in out.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *np.cumsum(s.length)[:-1]] and s.length.sum() <= 2048
    assert packing.pack(docs_of([]), P.path("word_bpe_49k.json")).collect() == []


# ---- fingerprints


def test_edited_texts_and_likeness(spark):
    docs = table(spark, SF, "documents")
    out = {r.doc_id: r for r in fingerprint.fingerprint_documents(docs).collect()}
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), reverse=True)
    shingles = lambda t: {tuple(w[i : i + 5]) for w in [t.split()] for i in range(max(1, len(w) - 4))}
    for k, (doc_id, text) in enumerate(rows):
        other = rows[(k + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + other[:half]
        r = out[doc_id]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b = shingles(text), shingles(edited)
        assert abs(r.near_edited - len(a & b) / len(a | b)) < 0.25
    assert len({r.fingerprint for r in out.values()}) <= len({t for _, t in rows})


def test_fingerprints_awkward(spark, docs_of, awkward):
    out = {r.doc_id: r for r in fingerprint.fingerprint_documents(docs_of(awkward)).collect()}
    assert len(out) == len(awkward) and out[3].fingerprint == out[4].fingerprint and out[0].fingerprint == out[1].fingerprint == ""
    assert out[0].near_edited == 1.0 and all(0 <= r.near_next <= 1 for r in out.values())
    one = fingerprint.fingerprint_documents(docs_of(["only one"])).first()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"onlyonly").hexdigest()
    assert fingerprint.fingerprint_documents(docs_of([])).collect() == []
    assert len(fingerprint.fingerprint_documents(docs_of([(7, "a", None), (7, "a", None), (None, "b", None)])).collect()) == 3


def test_next_documents_with_outlying_and_repeated_ids(spark, docs_of, monkeypatch):
    monkeypatch.setattr(fingerprint, "BUCKET_ROWS", 20)
    ids = [*range(200), *[77] * 150, 2**63 - 1, -(2**63), *[None] * 60]
    docs = docs_of([(i, f"text {n} of {i}", None) for n, i in enumerate(ids)])
    rows, _ = fingerprint.with_next(docs.select("doc_id", "text"), "doc_id", "text")
    rows = rows.select("doc_id", "text", "next_text", "__bucket", "__aux").collect()
    own = [r for r in rows if not r["__aux"]]
    assert max(Counter(r["__bucket"] for r in own).values()) < 120
    assert len(own) == len(ids) and {r.text for r in own} == {r.next_text for r in own}  # one ring of all rows
    first = lambda i: [r for r in own if r.doc_id == i]
    assert first(2**63 - 1)[0].next_text.endswith(" of 199") and first(100)[0].next_text.endswith(" of 99")
    assert sum(r.next_text.endswith(" of 77") for r in own if r.doc_id == 77) == 150 and first(78)[0].next_text.endswith(" of 77")
    last = [r for r in own if r.doc_id is None and r.next_text.endswith(f" of {2**63 - 1}")]
    assert len(last) == 1 and first(-(2**63))[0].next_text.endswith(" of None")


def test_sketches_merge_and_estimate(spark):
    text = " ".join(f"w{i}" for i in range(3000))
    df = spark.createDataFrame([(0, text), (1, text[:9000])], "k int, text string")
    s = {r.k: r for r in fingerprint.add_sketch(df, "text", "s").select("k", "s", fingerprint.distinct_shingles(F.col("s")).alias("n")).collect()}
    assert s[0].n == pytest.approx(2996, rel=0.25)
    both = fingerprint.merge(fingerprint.add_sketch(df, "text", "s").withColumn("g", F.lit(1)), ["g"], "s").first()
    assert both.s == sorted(set(s[0].s) | set(s[1].s))[:128]
    pair = spark.createDataFrame([(s[1].s, s[0].s)], "a array<bigint>, b array<bigint>").select(fingerprint.containment(F.col("a"), F.col("b")).alias("c")).first()
    assert pair.c == pytest.approx(1.0, abs=0.25)


# ---- exact search


def brute(ids, rows, k, every):
    out = {}
    for i, q in zip(ids, rows):
        if i % every == 0:
            best = sorted((-(int(np.dot(q, r))), j) for j, r in zip(ids, rows) if j != i)[:k]
            out[i] = [(n + 1, j, -s) for n, (s, j) in enumerate(best)]
    return out


def test_top_k_is_exact(spark):
    rows = table(spark, SF, "embeddings").collect()
    q = [np.floor(256 * np.array(r.embedding, np.float64)).astype(int) for r in rows]
    got = {}
    for r in topk.neighbours(table(spark, SF, "embeddings")).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert {k: sorted(v) for k, v in got.items()} == brute([r.vec_id for r in rows], q, 5, 50)


def test_top_k_with_outlying_and_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 4)
    monkeypatch.setattr(topk, "RANGE", 2)
    monkeypatch.setattr(topk, "QUERIES", 3)
    rng = np.random.default_rng(11)
    ids = [*range(0, 400, 10), *[50] * 30, 2**63 - 1, -(2**63)]
    rows = [(i, rng.standard_normal(5).round(3).tolist()) for i in ids]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in topk.neighbours(df).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    q = {i: np.floor(256 * np.array(v)).astype(int) for i, v in rows if i != 50}
    everything = [(i, np.floor(256 * np.array(v)).astype(int)) for i, v in rows]
    for i, v in q.items():
        if i % 50 == 0:
            best = sorted((-int(v @ w), j) for j, w in everything if j != i)[:5]
            assert sorted(got[i]) == [(n + 1, j, -s) for n, (s, j) in enumerate(best)]


def test_blocks_prune_without_loss():
    rng = np.random.default_rng(0)
    m = np.repeat(rng.integers(-50, 50, (20, 6)) * 5, 64, 0) + rng.integers(-3, 4, (1280, 6))
    b = topk.Blocks(np.arange(1280), m, 64)
    who, ids, score, scored = b.search(np.arange(5), m[:5].copy(), 3)
    assert scored < 5 * 20
    for i in range(5):
        want = sorted((-int(s), j) for j, s in enumerate(m @ m[i]) if j != i)[:3]
        assert [(-s, j) for s, j in zip(score[who == i], ids[who == i])] == want


def test_top_k_awkward(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (None, [1.0, 1.0]), (7, [0.5]), (8, [])]
    df = spark.createDataFrame([(a, b, 1) for a, b in rows], "vec_id long, embedding array<float>, score int")
    got = [(r["rank"], r.vec_id, r.score) for r in topk.neighbours(df).orderBy("rank").collect()]
    assert got == [(1, 1, 65536), (2, 2, 65536), (3, 7, 32768), (4, 8, 0)]
    assert topk.neighbours(df.limit(0)).collect() == []
    big = np.array([[2**40, 1], [2**40, -1]], np.int64)
    assert topk._products(big, np.array([[3, 5]], np.int64)).tolist() == [[3 * 2**40 + 5], [3 * 2**40 - 5]]


# ---- SimHash


def test_golay_words_within_two_bits_share_a_key():
    rng = np.random.default_rng(1)
    of = lambda v: set(golay.keys(np.array([v]))[1].tolist())
    for v in rng.integers(0, 1 << 23, 200).tolist():
        i, j = (1 << int(b) for b in rng.choice(23, 2, replace=False))
        assert of(v) & of(v ^ i) and of(v) & of(v ^ i ^ j) and len(of(v)) in (1, 6)
    codewords = golay.decode(np.arange(1 << 23))
    assert np.bincount(codewords).tolist() == [2048] * 4096  # perfect: every codeword has its ball of words


def unite(fps):
    """Component ids by comparing all pairs."""
    up = {i: i for i in fps}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(fps)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def naive(text):
    w = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_groups(spark, docs_of, awkward):
    texts = [r.text for r in table(spark, SF, "documents").collect()] + awkward
    out = {r.doc_id: r for r in simhash.group_documents(docs_of(texts)).collect()}
    fps = {i: naive(t) for i, t in enumerate(texts)}
    want = unite(fps)
    for i in fps:
        assert out[i].fingerprint == f"{fps[i]:016x}" and out[i].component_id == want[i]
    assert simhash.group_documents(docs_of([])).collect() == []


def test_links_in_crowded_keys(spark):
    """More fingerprints under one key than RUN, so that the exact way of neighbour words is taken."""
    rng = np.random.default_rng(5)
    base = 0x1234_5678_9ABC_DEF0
    fps = {base}
    for _ in range(500):
        x = base
        for b in rng.choice(22, int(rng.integers(0, 5)), replace=False):
            x ^= 1 << (22 + int(b))
        fps.add(x)
    fps |= {base ^ (0b111 << 60), base ^ (0b11111 << 50)}
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    nodes = spark.createDataFrame(signed, "fp long")
    hot = simhash.links_within_two_bits(nodes, len(signed))
    roots = {r.node: r.root for r in components(hot).collect()}
    want = unite({s[0]: s[0] & ((1 << 64) - 1) for s in signed})
    for a in want:
        for b in want:
            assert (want[a] == want[b]) == (roots.get(a, a) == roots.get(b, b))


def test_components_of_chains_and_stars(spark, monkeypatch):
    _components_of_chains_and_stars(spark)
    monkeypatch.setattr(graph, "PART_ROWS", 20)  # so that edges are in several parts
    monkeypatch.setattr(session, "PART_ROWS", 20)
    _components_of_chains_and_stars(spark)


def _components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 140)] + [(7, 7), (3, 2)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(51)) and all(got[i] == 100 for i in range(100, 140))
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_near_groups_find_near_copies(spark, docs_of):
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(2000)]
    texts = []
    for _ in range(40):
        t = rng.choice(words, 300).tolist()
        texts.append(" ".join(t))
        for k in (1, 3, 5):  # 5 * k changed shingles on either side of 300
            u = list(t)
            for at in rng.choice(300, k, replace=False):
                u[at] = "new" + str(rng.integers(10**6))
            texts.append(" ".join(u))
    got = {r.doc_id: r.component_id for r in simhash.near_groups(docs_of(texts)).collect()}
    assert np.mean([got[i] == i - i % 4 for i in range(160)]) > 0.93
    assert all(got[i] // 4 == i // 4 for i in range(160))


def _likeness(texts):
    """Brute-force Jaccard similarity of all pairs' sets of five-word shingles."""
    sets = [set(simhash.shingles(t, 5)) for t in texts]
    return {(i, j): len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i in range(len(sets)) for j in range(i)}


def _changed(rng, words, changes):
    out = list(words)
    for at in changes:
        out[at] = "new" + str(rng.integers(10**9))
    return " ".join(out)


def test_near_groups_link_nothing_below_the_threshold(spark, docs_of):
    rng = np.random.default_rng(3)
    texts = []
    for _ in range(150):
        base = rng.choice(2000, 300).astype(str).tolist()
        texts += [" ".join(base), _changed(rng, base, range(10, 260, 25))]  # 50 of 296 shingles changed: 0.71
    near = _likeness(texts)
    assert max(near.values()) < 0.75 and sum(v > 0.7 for v in near.values()) == 150
    assert all(r.doc_id == r.component_id for r in simhash.near_groups(docs_of(texts)).collect())


def test_near_groups_find_pairs_just_above_the_threshold(spark, docs_of):
    rng = np.random.default_rng(4)
    texts = []
    for i in range(300):
        base = rng.choice(2000, 300).astype(str).tolist()
        texts += [" ".join(base), _changed(rng, base, range(10, 10 + 40 * (5 + i % 2), 40))]  # 25 or 30 of 296 shingles: 0.84, 0.82
    near = {k: v for k, v in _likeness(texts).items() if v >= 0.8}
    assert len(near) == 300 and max(near.values()) < 0.85
    got = {r.doc_id: r.component_id for r in simhash.near_groups(docs_of(texts)).collect()}
    assert all(got[i] == got[j] for i, j in near)


def test_near_groups_of_crowded_keys_equal_brute_force(spark, docs_of, monkeypatch):
    monkeypatch.setattr(simhash, "CROWD", 4)
    monkeypatch.setattr(simhash, "HUBS", 2)
    rng, texts = np.random.default_rng(9), []
    for _ in range(3):
        base = rng.choice(3000, 200).astype(str).tolist()
        for k in range(30):  # a group that spreads: some pairs are alike, others only in chains or not at all
            texts.append(_changed(rng, base, rng.choice(200, rng.integers(0, 7), replace=False)))
    up = list(range(len(texts)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for (i, j), v in _likeness(texts).items():
        if v >= 0.8:
            a, b = find(i), find(j)
            up[max(a, b)] = min(a, b)
    got = {r.doc_id: r.component_id for r in simhash.near_groups(docs_of(texts)).collect()}
    assert got == {i: find(i) for i in range(len(texts))} and 3 < len(set(got.values())) < 60


def test_tables_miss_few_pairs_at_the_threshold():
    tables = simhash.table_minima()
    alike = np.random.default_rng(5).random((100_000, simhash.MINIMA)) < 0.8
    missed = ~np.any([alike[:, t].all(1) for t in tables], 0)
    assert missed.mean() < 1e-4


def test_near_copies_of_awkward_rows(spark, docs_of):
    long = " ".join(f"w{i}" for i in range(400))
    rows = [(1, long, "en"), (1, "another text under the same id with words enough", "en"), (2, long, "en"), (None, long, "en"), (None, "no id but a text of its own", "en")]
    rows += [(3, "one two three", "en"), (3, "one two three", "de"), (4, None, None), (5, "", None), (None, None, None)]
    docs = docs_of(rows)
    out = sorted((-1 if r.doc_id is None else r.doc_id, r.text or "") for r in simhash.drop_near_copies(docs).collect())
    assert out == sorted([(1, long), (1, rows[1][1]), (-1, rows[4][1]), (3, "one two three"), (4, "")])
    assert simhash.drop_near_copies(docs).columns == docs.columns and simhash.drop_near_copies(docs.limit(0)).collect() == []


def test_fingerprints_of_long_texts_in_parts(monkeypatch):
    text = " ".join(f"Word{i % 977}" for i in range(5000))
    monkeypatch.setattr(simhash, "PART_SHINGLES", 64)
    parts = list(simhash.shingle_parts(text, 3, 64))
    assert len(parts) > 70 and [s for p in parts for s in p] == simhash.shingles(text, 3) and simhash.fingerprint(text) == naive(text)


# ---- personal data


def test_pseudonyms_keep_formats_and_links(spark, docs_of):
    texts = [
        "mail anna.berg@mail.example.com, 192.168.7.9 and +1 (929) 555-1803; card 4428 3535 1010 3350",
        "again anna.berg@mail.example.com 192.168.7.9! +1 (929) 555-1803 4428353510103350 born 1990-02-28, ssn 123-45-6789",
        "not valid: 4428353510103351 999.1.1.1 2023-02-30 000-12-3456 1.2.3",
        None,
        "",
    ]
    a, b, c, d, e = [r.text for r in pii.pseudonymise(docs_of(texts), key=pii.KEY).orderBy("doc_id").collect()]
    mail = r"[a-z]{4}\.[a-z]{4}@mail\.example\.com"
    assert re.search(mail, a)[0] == re.search(mail, b)[0] != "anna.berg@mail.example.com"
    ip, phone = r"\b\d{1,3}(?:\.\d{1,3}){3}\b", r"\+1 \(\d{3}\) \d{3}-\d{4}"
    assert re.search(ip, a)[0] == re.search(ip, b)[0] != "192.168.7.9" and re.search(phone, a)[0] == re.search(phone, b)[0]
    card = re.search(r"\d{4} \d{4} \d{4} \d{4}", a)[0]
    digits = card.replace(" ", "")
    assert digits in b and digits != "4428353510103350" and digits[0] == "4"
    assert sum(int(x) if i % 2 == 0 else sum(divmod(2 * int(x), 10)) for i, x in enumerate(reversed(digits))) % 10 == 0
    assert "1990-02-28" not in b and re.search(r"\d{4}-\d{2}-\d{2}", b) and "123-45-6789" not in b
    assert c == texts[2] and d is None and e == ""


def test_pseudonyms_of_cards_beside_numbers_and_of_month_first_dates(spark, docs_of):
    card = "4111 1111 1111 1111"
    around = ["card {} 12/27", "{} 123", "12 {}", "order 12345 {} 99 x", "{}-12/27", "{} 12/25/2023", "{} 555-123-4567", "{}"]
    kinds = ["card", "card", "card", "card", "card", "card,date", "card,phone", "card"]
    dates = [f"{m:02d}/{d:02d}/2023" for m in range(1, 13) for d in range(13, 29)]
    amex = ["3782 822463 10005 1234", "13/13/2023 02/30/2023 4111 1111 1111 1112 12"]
    rows = pii.pseudonymise_documents(docs_of([a.format(card) for a in around] + amex + dates), pii.KEY).orderBy("doc_id").collect()
    assert [r.kinds for r in rows[:8]] == kinds
    new = rows[7].text
    assert new != card
    assert all(r.text == a.format(new) for r, a in zip(rows[:5], around))
    assert all(r.text.startswith(new + " ") for r in rows[5:7])
    assert rows[8].n_found == 1 and rows[8].text.endswith(" 1234") and rows[9].text == amex[1]
    moved = [r.text for r in rows[10:]]
    assert len(set(moved)) == len(dates) and all(re.fullmatch(r"(?:0[1-9]|1[0-2])/(?:1[3-9]|2\d|3[01])/\d{4}", d) for d in moved)


def _digest(*parts):
    return int(hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()[:15], 16)


def _pair(key, what, a, b, m, n):
    for i in range(pii.ROUNDS):
        if i % 2 == 0:
            a = (a + _digest(key, what, i, b) % m) % m
        else:
            b = (b + _digest(key, what, i, a) % n) % n
    return a, b


def _text(key, what, text):
    def shift(half, other, i):
        out, digest = "", "".join(hashlib.sha512("|".join(map(str, (key, what, i, k, other))).encode()).hexdigest() for k in range(-(-len(half) // 32)))
        for j, c in enumerate(half):
            first, size = (48, 10) if c.isdigit() else (97, 26) if c.islower() else (65, 26) if c.isupper() else (0, 0)
            out += chr((ord(c) - first + int(digest[4 * j : 4 * j + 4], 16)) % size + first) if size else c
        return out

    a, b = text[: len(text) // 2], text[len(text) // 2 :]
    for i in range(pii.ROUNDS):
        a, b = (shift(a, b, i), b) if i % 2 == 0 else (a, shift(b, a, i))
    return a + b


def _check_digit(body):
    total = sum(int(c) if i % 2 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(body)))
    return str(-total % 10)


def test_pseudonyms_equal_a_feistel_network_by_hand(spark, docs_of):
    import datetime as d

    key, rng, rows = "some key", np.random.default_rng(8), []
    day0 = d.date(1800, 1, 1)
    for _ in range(25):
        body = "4" + "".join(map(str, rng.integers(0, 10, 14)))
        moved = "4" + _text(key, "card", body[1:])
        rows.append((body + _check_digit(body), moved + _check_digit(moved)))
        area, group, serial = int(rng.integers(1, 666)), int(rng.integers(1, 100)), int(rng.integers(1, 10000))
        a, b = _pair(key, "ssn", area - 1, (group - 1) * 9999 + serial - 1, 898, 99 * 9999)
        rows.append((f"{area:03d}-{group:02d}-{serial:04d}", f"{a + 1 + (a + 1 > 665):03d}-{b // 9999 + 1:02d}-{b % 9999 + 1:04d}"))
        w, x, y, z = rng.integers(0, 256, 4).tolist()
        a, b = _pair(key, "ip", w * 256 + x, y * 256 + z, 1 << 16, 1 << 16)
        rows.append((f"{w}.{x}.{y}.{z}", f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"))
        six = [0x2001, *rng.integers(0, 1 << 16, 7).tolist()]
        number = int("".join(f"{g:04x}" for g in six[1:]), 16)
        a, b = _pair(key, "ipv6", number >> 56, number & ((1 << 56) - 1), 1 << 56, 1 << 56)
        moved = f"{a:014x}{b:014x}"
        rows.append((":".join(f"{g:X}" for g in six), ":".join(["2001", *(f"{int(moved[i : i + 4], 16):x}" for i in range(0, 28, 4))])))
        digits = "".join(map(str, rng.integers(0, 10, 10)))
        moved = _text(key, "phone", digits)
        rows.append((f"({digits[:3]}) {digits[3:6]}-{digits[6:]}", f"({moved[:3]}) {moved[3:6]}-{moved[6:]}"))
        rows.append((f"+49{digits}", f"+49{moved}"))
        name = "".join(rng.choice(list("abcdefXYZ019._"), 9)) + "q"
        rows.append((f"{name}@mail.example", f"{_text(key, 'email', name)}@mail.example"))
        n = int(rng.integers(0, 146_097))
        moved = n
        while moved == n or ((day0 + d.timedelta(moved)).day > 12) != ((day0 + d.timedelta(n)).day > 12):
            a, b = _pair(key, "date", moved // 773, moved % 773, 189, 773)
            moved = a * 773 + b
        rows.append(((day0 + d.timedelta(n)).isoformat(), (day0 + d.timedelta(moved)).isoformat()))
        account = "".join(map(str, rng.integers(0, 10, 18)))
        moved = _text(key, "iban", account)
        check = lambda x: f"{98 - int(x + '131400') % 97:02d}"  # noqa: E731  D and E as 13 and 14
        rows.append((f"DE{check(account)}{account}", f"DE{check(moved)}{moved}"))
    got = [r.text for r in pii.pseudonymise(docs_of([f"see {a} now" for a, _ in rows]), key=key).orderBy("doc_id").collect()]
    assert got == [f"see {b} now" for _, b in rows]


def test_the_key_comes_from_the_session(spark, docs_of):
    docs = docs_of(["mail anna.berg@mail.example.com"])
    with pytest.raises(ValueError, match="pseudonym.key"):
        pii.pseudonymise(docs)
    public = pii.pseudonymise(docs, key=pii.session_key(spark, pii.KEY)).first().text
    spark.conf.set(pii.KEY_SETTING, "a secret")
    try:
        assert pii.pseudonymise(docs).first().text == pii.pseudonymise(docs, key="a secret").first().text != public
    finally:
        spark.conf.unset(pii.KEY_SETTING)


def test_a_day_has_one_pseudonym_in_every_layout(spark, docs_of):
    import datetime as d

    days = [d.date(2023, 1, 1) + d.timedelta(i) for i in range(365)]
    layouts = ["%Y-%m-%d", "%Y/%m/%d", "%d/%m/%Y", "%d.%m.%Y", "%m/%d/%Y"]
    texts = [" ".join(day.strftime(f) for f in layouts[: 5 if day.day > 12 else 4]) for day in days]
    rows = pii.pseudonymise(docs_of(texts), key=pii.KEY).orderBy("doc_id").collect()
    seen = set()
    for day, r in zip(days, rows):
        new = {d.datetime.strptime(x, f).date() for x, f in zip(r.text.split(), layouts)}
        assert len(new) == 1 and (max(new).day > 12) == (day.day > 12)
        seen |= new
    assert len(seen) == 365


def test_addresses_of_letters_alone_are_found(docs_of):
    texts = ["host fdaa:bbcc:ddee:ffaa:bbcc:ddee:ffaa:bbcc up", "x:abc:y stays", "fe:ed:be:ef"]
    rows = pii.pseudonymise_documents(docs_of(texts), pii.KEY).orderBy("doc_id").collect()
    assert [r.n_found for r in rows] == [1, 0, 0] and "bbcc:ddee" not in rows[0].text and [r.text for r in rows[1:]] == texts[1:]


def test_many_values_in_one_text(docs_of):
    one = "card 4111 1111 1111 1111 of a@b.example "
    r = pii.pseudonymise(docs_of([one * 1500]), key=pii.KEY, found="found").first()
    assert len(r.found) == 3000 and all((one * 1500)[f.start : f.start + f.length] in ("4111 1111 1111 1111", "a@b.example") for f in r.found)
    assert r.text == r.text[: len(one)] * 1500


def test_invalid_accounts_and_foreign_numbers_stay(spark, docs_of):
    texts = ["DE89 3704 0044 0532 0130 01", "DE8937040044053201300", "XX89370400440532013000", "+1234", "a+49 30 1", "1990/02/30"]
    assert [r.text for r in pii.pseudonymise(docs_of(texts), key=pii.KEY).orderBy("doc_id").collect()] == texts


def test_long_addresses_are_linked_however_they_are_abbreviated(spark, docs_of):
    same = ["2001:db8::8a2e:370:7334", "2001:0DB8:0:0:0:8a2e:0370:7334", "2001:db8:0:0::8A2E:370:7334"]
    others = ["fe80::1", "fdab:cdef::a", "2001:db8::8a2e:370:7335"]
    plain = ["std::move a::b 12:30:45 dead::beef", "2001:1:2:3:4:5:6:7:8", "2001:1:2:3:4::5:6:7:8", "2001:db8::12345 x2001:db8::1 2020:: 00:1b:44:11:3a:b7"]
    rows = pii.pseudonymise_documents(docs_of([f"from [{a}], yes" for a in same + others] + plain), pii.KEY).orderBy("doc_id").collect()
    new = [re.fullmatch(r"from \[(.*)\], yes", r.text)[1] for r in rows[:6]]
    assert len(set(new[:3])) == 1 and len(set(new)) == 4 and not set(new) & set(same + others)
    assert all(r.kinds == "ipv6" and r.n_found == 1 for r in rows[:6]) and [a[:4] for a in new[2:5]] == ["2001", "fe80", "fdab"]
    assert all(len(a.split(":")) == 8 and ipaddress.ip_address(a) for a in new)
    assert [r.text for r in rows[6:]] == plain


def test_permutations_are_one_to_one(spark):
    pairs = spark.range(6 * 7).select(pii.permute_pair("k", "w", (F.col("id") / 7).cast("int"), (F.col("id") % 7).cast("int"), 6, 7).alias("p")).distinct()
    assert pairs.count() == 42 and pairs.agg(F.max("p.a"), F.max("p.b")).first() == (5, 6)
    texts = spark.range(1000).select(pii.permute_text("k", "w", F.format_string("%03d", "id")).alias("p")).distinct()
    assert texts.count() == 1000 and texts.filter(~F.col("p").rlike(r"^\d{3}$")).count() == 0


def test_social_numbers_and_dates_stay_valid(spark):
    ssn = spark.createDataFrame([(f"{a:03d}-{b:02d}-{c:04d}",) for a in (1, 665, 667, 899) for b in (1, 99) for c in (1, 9999)], "t string")
    got = ssn.select(pii.pseudonym(F.col("t"), pii.kind(F.col("t"))).alias("p"))
    got = spark.createDataFrame(got.collect(), "p string")
    assert got.distinct().count() == 16 and got.filter(pii.kind(F.col("p")) != "ssn").count() == 0
    dates = spark.createDataFrame([("29.02.2000",), ("01/01/1800",), ("2199-12-31",)], "t string")
    moved = spark.createDataFrame(dates.select(pii.pseudonym(F.col("t"), pii.kind(F.col("t"))).alias("p")).collect(), "p string")
    assert {r.k for r in moved.select(pii.kind(F.col("p")).alias("k")).collect()} == {"date"}


def test_spans_and_long_texts(spark, docs_of):
    text = "x " * 60_000 + "a@b.example and 10.0.0.1" + " y" * 1000
    r = pii.pseudonymise(docs_of([text]), key=pii.KEY, found="found").first()
    assert [(f.kind, text[f.start : f.start + f.length]) for f in r.found] == [("email", "a@b.example"), ("ip", "10.0.0.1")]
    assert len(pii.pseudonymise_documents(docs_of([]), pii.KEY).collect()) == 0


def test_near_copies_need_no_broadcast_that_grows(spark, docs_of, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") % 50)).unionByName(docs.limit(5).withColumn("doc_id", F.lit(None).cast("long")))
    every = docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 1000)).unionByName(docs.withColumn("doc_id", F.col("doc_id") + 2000))
    told = lambda df: sorted((str(r.doc_id), r.text or "") for r in df.collect())
    expected = [told(simhash.drop_near_copies(d)) for d in (docs, every)]
    sent, broadcast = [], F.broadcast
    monkeypatch.setattr(simhash, "BROADCAST_IDS", 10)
    monkeypatch.setattr(simhash.F, "broadcast", lambda df: sent.append((df.columns, df.count())) or broadcast(df))
    assert [told(simhash.drop_near_copies(d)) for d in (docs, every)] == expected
    assert all(n <= 10 or c == ["__of_row", "__bits"] for c, n in sent if "of_id" in c or "__bits" in c) and any("__bits" in c for c, _ in sent)


def test_near_copies_take_the_links_of_fingerprints(spark, docs_of):
    """Texts whose fingerprints are linked go, though less alike than the threshold by their sets of five words."""
    words = [f"word{i}" for i in range(4000)]
    base = words[:40] * 30 + words[40:52]
    other = base[:-1] + ["else"]
    texts = [" ".join(base), " ".join(other), "a text of its own that nothing is like"]
    for i in range(52, 400, 12):  # further endings, until two are linked by fingerprints but not by sets
        texts.append(" ".join(words[:40] * 30 + words[i : i + 12]))
    docs = docs_of(texts)
    linked = {r.doc_id: r.component_id for r in simhash.group_documents(docs).collect()}
    sets = {r.doc_id: r.component_id for r in simhash.near_groups(docs).collect()}
    both = {r.doc_id: r.component_id for r in simhash.near_groups(docs, prints_too=True).collect()}
    apart = [(i, j) for i in linked for j in linked if i < j and linked[i] == linked[j] and sets[i] != sets[j]]
    assert apart
    assert all(both[i] == both[j] for m in (linked, sets) for i in m for j in m if m[i] == m[j])
    kept = {r.doc_id for r in simhash.drop_near_copies(docs).collect()}
    assert kept == {i for i in both if both[i] == i}
