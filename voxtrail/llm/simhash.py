"""SimHash near-duplicates by Golay-code fuzzy hashing.

A fingerprint has a bit for each bit of the shingles' hashes, set where over half
of them have it.  For links at two differing bits or fewer, a 64-bit fingerprint is cut
into segments of 22, 21 and 21 bits.  One of three segments is free of errors, and
the next has two at most, so two linked fingerprints share, for some segment, its bits
with a Golay key of the next.  These keys (3 to 18 for each distinct fingerprint)
are shuffled and sorted; rows that meet under a key are compared, and a spanning set of
the links that hold is kept.  A key with more rows than RUN is not compared pair by
pair: its fingerprints go to the exact way of neighbour words, where each is listed under
itself and the 64 words one bit away; linked ones share such a word, and a word has 65
fingerprints at most.

Equal fingerprints are one node throughout, so exact copies, however many, cost one row.

`near_groups` is for texts that are alike by a given Jaccard similarity of their sets of
shingles, further apart than fingerprints show; on demand it takes the links of fingerprints as well.  MINIMA smallest values of the set under
as many hash functions, which two sets share each with the probability of their
similarity, make TABLES keys, each of BAND minima; two sets at 0.8 share no key with a
probability of 1e-5, which README derives.  Keys only propose: rows that meet
another under a key are given their sets, as 32-bit hashes, and a link holds where the
similarity of the two sets does.  It has no cap on partners.  A key with more than CROWD sets is
dealt to parts of about as many, and some of its sets (hubs) are compared with all parts.  Sets that are
connected by then need no comparison with each other, so only those outside the key's largest component
are hubs of the next rounds, until none is left that has not been one.

Defined cases: a null text is empty; a text without words has fingerprint zero, linked
like any other; fewer words than a shingle make one shingle; repeated rows and ids
are copies of each other; a component's id ignores null ids unless all are null.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from voxtrail.llm import golay
from voxtrail.llm.common import bounded_batches, slices
from voxtrail.llm.graph import components
from voxtrail.session import pin

WORDS = 3
SEED = 42
RUN = 64
KEYS = 18
PART_SHINGLES = 1 << 16
MINIMA = 128
BAND = 6
TABLES = 64
HOT_NODES = 1000
CROWD = 2000
HUBS = 64
#: Ids that a join may broadcast; in the driver each takes over 100 bytes, some of them twice.
BROADCAST_IDS = 100_000
#: Bits of a filter of ids: for each id, in a row (4 KB, as Spark's bitmaps have), and at most.
ID_BITS, ROW_BITS, FILTER_BITS = 16, 1 << 15, 1 << 25
_SEGMENTS = ((0, 22), (22, 21), (43, 21))


def shingle_parts(text: str | None, words: int, size: int = PART_SHINGLES) -> Iterator[list[bytes]]:
    """Shingles of a text's words, A-Z in lower case, `size` at a time; all words together if they are fewer."""
    w = text.encode().lower().split() if text else []
    if len(w) <= words:
        yield [b" ".join(w)] if w else []
        return
    for at in range(0, len(w) - words + 1, size):
        some = w[at : at + size + words - 1]
        yield list(map(b" ".join, zip(*(some[i:] for i in range(words)))))


def shingles(text: str | None, words: int) -> list[bytes]:
    """All shingles of a text."""
    return [s for part in shingle_parts(text, words) for s in part]


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """64-bit fingerprint by XXH64: each bit that over half of the shingles' hashes have; zero without shingles."""
    counts, n = np.zeros(64, np.int64), 0
    for part in shingle_parts(text, words):
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, part, repeat(SEED)), "<u8", len(part))
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(part)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


def golay_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, key) of every fuzzy key of 64-bit fingerprints (uint64), for links at two bits."""
    parts = [((prints >> np.uint64(at)) & np.uint64((1 << size) - 1)).astype(np.int64) for at, size in _SEGMENTS]
    rows, out = [], []
    for i in range(3):
        at, key = golay.keys(parts[(i + 1) % 3])
        rows.append(at)
        out.append((i << 40) | (parts[i][at] << 12) | key)
    return np.concatenate(rows), np.concatenate(out)


def table_minima(tables: int = TABLES) -> np.ndarray:
    """For each table, which minima of a set make its key; drawn once from a fixed seed."""
    rng = np.random.default_rng(SEED)
    return np.stack([rng.permutation(MINIMA)[:BAND] for _ in range(tables)])


def _odd(shape: tuple[int, ...]) -> np.ndarray:
    return np.random.default_rng(SEED + 1).integers(0, 1 << 64, shape, np.uint64) | np.uint64(1)


_HASHES, _SHIFTS = _odd((MINIMA,)), np.random.default_rng(SEED + 2).integers(0, 1 << 64, MINIMA, np.uint64)


def minima(found: np.ndarray) -> np.ndarray:
    """The smallest values of a set (uint64) under MINIMA hash functions."""
    out = np.full(MINIMA, ~np.uint64(0))
    for i in range(0, len(found), 256):
        out = np.minimum(out, (found[i : i + 256, None] * _HASHES + _SHIFTS).min(0))
    return out


def table_keys(least: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """[rows, tables] keys of sets by their minima (uint64 [rows, MINIMA])."""
    return (least[:, tables] * _odd(tables.shape)).sum(2, dtype=np.uint64).view(np.int64)


class _Forest:
    """Union of the rows of one batch, to keep only links that join two trees."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True


def _spanning(key: np.ndarray, prints: np.ndarray, most_bits: int) -> np.ndarray:
    """[links, 2] positions: a spanning set of the links between rows of equal `key`, which is sorted; RUN rows of a key at most."""
    out, forest = [], _Forest(len(key))
    for step in range(1, RUN):
        same = np.flatnonzero(key[step:] == key[:-step]) if step < len(key) else ()
        if not len(same):
            break
        near = same[_popcount(prints[same + step] ^ prints[same]) <= most_bits]
        out += [(i, i + step) for i in near.tolist() if forest.join(i, i + step)]
    return np.array(out, np.int64).reshape(-1, 2)


def _linker(most_bits: int):
    """Reads partitions of (key, id), sorted, where ids are fingerprints; yields links (a, b), and (a, null) for rows of keys with more than RUN rows."""

    def hot(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"a": rows.id.to_numpy(), "b": pd.array([None] * len(rows), "Int64")})

    def work(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        sizes = rows.groupby("key").key.transform("size").to_numpy()
        if (sizes > RUN).any():
            yield hot(rows[sizes > RUN])
        rows = rows[(sizes > 1) & (sizes <= RUN)]
        ids = rows.id.to_numpy()
        found = _spanning(rows.key.to_numpy(), ids.view(np.uint64), most_bits)
        if len(found):
            yield pd.DataFrame({"a": ids[found[:, 0]], "b": pd.array(ids[found[:, 1]], "Int64")})

    def links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, large = None, None
        for batch in batches:
            if large is not None:  # the rest of a key known to be large
                more = batch.key.to_numpy() == large
                if more.any():
                    yield hot(batch[more])
                batch = batch[~more]
                if not len(batch):
                    continue
                large = None
            batch = batch if held is None else pd.concat([held, batch], ignore_index=True)
            last = batch.key.to_numpy() == batch.key.iloc[-1]
            held = batch[last]
            yield from work(batch[~last])
            if len(held) > RUN:
                yield hot(held)
                held, large = None, held.key.iloc[0]
        if held is not None:
            yield from work(held)

    return links


def _by_key(rows: DataFrame) -> DataFrame:
    return rows.repartition(F.col("key")).sortWithinPartitions("key", "id")


def links_within_two_bits(nodes: DataFrame, count: int) -> DataFrame:
    """(a, b): links that connect what is connected at two bits or fewer; `nodes` has distinct 64-bit `fp` as long, `count` of them."""

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at, key = golay_keys(batch.fp.to_numpy().view(np.uint64))
            yield pd.DataFrame({"key": key, "id": batch.fp.to_numpy()[at]})

    rows = nodes.select("fp").mapInPandas(spread, "key long, id long")
    found = pin(_by_key(rows).mapInPandas(_linker(2), "a long, b long"), KEYS * count)
    hot = found.filter("b is null").select(F.col("a").alias("fp")).distinct()
    masks = F.array(F.lit(0).cast("long"), *[F.lit(v - (1 << 64) if v >= 1 << 63 else v).cast("long") for v in (1 << i for i in range(64))])
    listed = hot.select("fp", F.explode(F.transform(masks, lambda m: F.col("fp").bitwiseXOR(m))).alias("word"))
    least = listed.groupBy("word").agg(F.min("fp").alias("b"))
    return found.filter("b is not null").unionByName(listed.join(least, "word").select(F.col("fp").alias("a"), "b").filter("a <> b").distinct())


def _attach(docs: DataFrame, nodes: DataFrame, on: list[str]) -> DataFrame:
    """Joins each document to its node; nodes with very many documents are broadcast, HOT_NODES at most."""
    total = nodes.agg(F.sum("n")).first()[0] or 0
    heavy = F.col("n") > total / HOT_NODES
    few = nodes.filter(heavy).drop("n").withColumn("__hot", F.lit(True))
    marked = docs.join(F.broadcast(few), on, "left")
    hot = marked.filter("__hot").drop("__hot")
    cold = marked.filter("__hot is null").select(docs.columns)
    return hot.unionByName(cold.join(nodes.filter(~heavy).drop("n"), on).select(hot.columns))


def _print_column(words: int):
    """A function of a text column: fingerprints as long."""

    @F.arrow_udf("long")
    def prints(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(np.array([fingerprint(t, words) for t in slices(texts)], "<u8").view(np.int64))

    return prints


def group_documents(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, fingerprint and component_id of every document, for links at two differing bits or fewer."""
    bounded_batches(docs.sparkSession)

    base = pin(docs.select("doc_id", _print_column(words)(F.col("text")).alias("fp")))
    nodes = base.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"))
    count = nodes.count()
    nodes = pin(nodes, count)
    roots = components(links_within_two_bits(nodes, count)).withColumnRenamed("node", "fp")
    rooted = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = pin(rooted.join(least, "root").select("fp", "component_id", "n"), count)
    return _attach(base, named, ["fp"]).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The distinct shingles' 64-bit hashes, in order."""
    found = np.zeros(0, "<u8")
    for part in shingle_parts(text, words):
        part = np.unique(np.fromiter(map(xxhash.xxh3_64_intdigest, part, repeat(SEED)), "<u8", len(part)))
        found = np.union1d(found, part) if len(found) else part
    return found


def short_hashes(found: np.ndarray) -> np.ndarray:
    """A set of shingles by the upper halves of its hashes, which halves what is shuffled.

    Two different shingles share 32 bits once in 4e9 pairs, which can move the likeness of two sets of n shingles by
    1 / n in about n^2 / 4e9 of the cases: exact but for that.
    """
    return np.unique((found >> np.uint64(32)).astype("<u4"))


def _grow_sets(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Spanning links of one group by Jaccard similarity; as `_grow`."""
    sizes = np.array([len(s) for s in sets])
    code = np.unique(np.concatenate(sets), return_inverse=True)[1]
    ends = np.cumsum(sizes)
    mark = np.zeros(int(code.max(initial=-1)) + 1, bool)
    left, out = np.arange(len(sets)), []
    flat, starts, listed = code, ends - sizes, left  # the codes of the rows `listed`, of which `left` are a part
    while len(left):
        edge, left = [int(left[0])], left[1:]
        while edge and len(left):
            if 2 * len(left) < len(listed):
                flat, listed = np.concatenate([code[ends[i] - sizes[i] : ends[i]] for i in left.tolist()]), left
                starts = np.cumsum(sizes[left]) - sizes[left]
            at = edge.pop()
            own = code[ends[at] - sizes[at] : ends[at]]
            mark[own] = True
            common = np.add.reduceat(mark[flat], starts, dtype=np.int64)[np.searchsorted(listed, left)]
            mark[own] = False
            near = common / (sizes[at] + sizes[left] - common) >= similarity
            if near.any():
                found = left[near].tolist()
                out += [(at, j) for j in found]
                edge += found
                left = left[~near]
    return out


def _hub_links(rows: list[np.ndarray], hubs: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """(row, hub) of all pairs of sets of a part and hubs that are alike."""
    out, sizes, ends = [], np.array([len(r) for r in rows]), np.cumsum([len(r) for r in rows])
    flat = np.concatenate(rows)
    for j, hub in enumerate(hubs):
        at = np.minimum(np.searchsorted(hub, flat), len(hub) - 1)
        common = np.add.reduceat((hub[at] == flat).astype(np.int64), ends - sizes)
        near = common / (sizes + len(hub) - common) >= similarity
        out += [(int(i), j) for i in np.flatnonzero(near)]
    return out


def _crowd_links(rows: DataFrame, known: DataFrame, links: DataFrame, similarity: float) -> DataFrame:
    """(a, b): links of the sets under crowded keys, rows (key, node), that connect what is connected there; `links` are those of other keys."""

    def compare(some: pd.DataFrame, hubs: pd.DataFrame) -> pd.DataFrame:
        sets = [[np.frombuffer(x, "<u4") for x in t] for t in (some.shingles, hubs.hub_shingles)]
        found = _hub_links(*sets, similarity) if len(some) and len(hubs) else []
        return pd.DataFrame({"a": [some.node.iloc[i] for i, _ in found], "b": [hubs.hub.iloc[j] for _, j in found]}, dtype="int64")

    parts = rows.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / CROWD).alias("parts"))
    full = pin(rows.join(parts, "key").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts"))).join(known, "node"))
    state = pin(full.select("key", "node", "parts").withColumn("done", F.lit(False)))
    turn = 0
    while True:
        label = state.join(components(links), "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root")
        label = pin(label)
        main = label.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("main"))
        open_ = label.join(main, "key").filter("label <> main and not done")
        per = open_.groupBy("key").agg(F.count(F.lit(1)).alias("open"), F.min("node").alias("first"))
        share = F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(1 << 30)) < F.lit(float(HUBS << 30)) / F.col("open")
        hubs = pin(open_.join(per, "key").filter(share | (F.col("node") == F.col("first"))).select("key", "node", "parts"))
        if hubs.isEmpty():
            return links
        sent = hubs.join(known, "node").select(F.col("key").alias("of_key"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("of_part"), F.col("node").alias("hub"), F.col("shingles").alias("hub_shingles"))
        met = full.select("key", "part", "node", "shingles").groupBy("key", "part").cogroup(sent.groupBy("of_key", "of_part"))
        found = met.applyInPandas(compare, "a long, b long")
        links = pin(links.unionByName(found.filter("a <> b")))
        state = pin(label.join(hubs.select("key", "node", F.lit(True).alias("now")), ["key", "node"], "left").select("key", "node", "parts", (F.col("done") | F.col("now").isNotNull()).alias("done")))
        turn += 1


def _set_linker(similarity: float):
    """Reads partitions of (key, id, shingles) sorted by key; yields links (a, b) that hold by their sets."""

    def links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def work(ids: np.ndarray, data: list[bytes]) -> list[tuple[int, int]]:
            sets = [np.frombuffer(d, "<u4") for d in data]
            return [(ids[i], ids[j]) for i, j in _grow_sets(sets, similarity)] if len(sets) > 1 else []

        key, ids, data = None, [], []
        for batch in batches:
            out = []
            keys = batch.key.to_numpy()
            cuts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
            batch_ids, batch_data = batch.id.tolist(), batch.shingles.tolist()
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if keys[a] != key:
                    out += work(ids, data)
                    key, ids, data = keys[a], [], []
                ids += batch_ids[a:b]
                data += batch_data[a:b]
            if out:
                yield pd.DataFrame(out, columns=["a", "b"]).drop_duplicates()
        if out := work(ids, data):
            yield pd.DataFrame(out, columns=["a", "b"])

    return links


def text_hash(text: Column) -> Column:
    """64-bit hash of a text, which with the id tells rows apart; a null is an empty text."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def near_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8, tables: int = TABLES, prints_too: bool = False) -> DataFrame:
    """doc_id, text_hash, component_id and kept of every document; components are of texts alike by `similarity` of their shingles, in chains too.

    With `prints_too`, texts whose fingerprints are linked, as in `group_documents`, are in one component as well.

    A component's id is its smallest doc_id.  `kept` marks its first row by doc_id, nulls last, and text_hash; rows
    that agree in both are marked alike.
    """
    bounded_batches(docs.sparkSession)
    which = table_minima(tables)
    same = ["h0", "h1"]  # of equal sets of shingles

    def digest(found: np.ndarray) -> np.ndarray:
        return np.frombuffer(xxhash.xxh3_128_digest(found.tobytes(), SEED), "<i8")

    @F.arrow_udf("h0 long, h1 long, keys array<long>")
    def prints(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            heads, least, empty = [], [], []
            for t in slices(texts):
                found = shingle_set(t, words)
                heads.append(digest(found))
                least.append(minima(found))
                empty.append(not len(found))
            heads = np.array(heads, np.int64).reshape(-1, 2)
            keys = table_keys(np.array(least, np.uint64).reshape(-1, MINIMA), which)
            ends = np.arange(len(keys) + 1, dtype=np.int32) * len(which)
            keys = pa.ListArray.from_arrays(ends, pa.array(keys.ravel()), mask=pa.array(empty, pa.bool_()))
            yield pa.StructArray.from_arrays([pa.array(heads[:, 0].copy()), pa.array(heads[:, 1].copy()), keys], [*same, "keys"])

    @F.arrow_udf("binary")
    def sets(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([short_hashes(shingle_set(t, words)).tobytes() for t in slices(texts)], pa.binary())

    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    base = pin(docs.select("doc_id", text_hash(F.col("text")).alias("text_hash"), prints(F.col("text")).alias("p"), *([_print_column(WORDS)(F.col("text")).alias("fp")] if prints_too else [])).select("doc_id", "text_hash", *(["fp"] if prints_too else []), "p.*"))
    count = base.count()
    nodes = pin(base.groupBy(*same).agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("n"), F.first("keys").alias("keys")), tables * count // 8)
    nodes = nodes.withColumn("node", F.monotonically_increasing_id())  # of a written table, so always the same
    rows = nodes.select("node", F.explode("keys").alias("key"))
    # Most keys have one row; only documents that meet another get their sets, by a join.
    alone = Window.partitionBy("key")
    members = [F.count(F.lit(1)).over(alone).alias("met"), F.min("node").over(alone).alias("least"), F.bit_xor(F.xxhash64("node")).over(alone).alias("mix")]
    met = pin(rows.select("*", *members).filter("met > 1"), tables * count // 8)
    # Of keys under which the same documents meet, one will do.
    met = met.join(met.groupBy("met", "least", "mix").agg(F.min("key").alias("key")).select("key"), "key", "left_semi").select("key", "node", "met")
    some = nodes.join(met.select("node").distinct(), "node", "left_semi").select("node", F.col("first.doc_id").alias("of_id"), F.col("first.text_hash").alias("of_hash"))
    some = pin(some, count)
    hashed = docs.select("doc_id", "text", text_hash(F.col("text")).alias("text_hash"))
    # Sets are made before ids that are not broadcast are joined, as they are smaller than texts.
    several = some.count()
    if several <= BROADCAST_IDS:
        known = hashed.join(F.broadcast(some), _same_row()).select("node", sets(F.col("text")).alias("shingles"))
    else:
        known = _through_filter(hashed, some, several).select("doc_id", "text_hash", sets(F.col("text")).alias("shingles")).join(some.hint("merge"), _same_row()).select("node", "shingles")
    known = known.dropDuplicates(["node"])
    crowds = met.filter(F.col("met") > CROWD)
    crowded = not crowds.isEmpty()
    known = pin(known, count) if crowded else known
    rows = met.filter(F.col("met") <= CROWD).join(known, "node").select("key", F.col("node").alias("id"), "shingles")
    links = _by_key(rows).mapInPandas(_set_linker(similarity), "a long, b long")
    if crowded:
        links = _crowd_links(crowds.select("key", "node"), known, pin(links), similarity)
    if prints_too:
        links = links.unionByName(_print_links(base.select(*same, "fp").distinct().join(nodes.select(*same, "node"), same), count))
    roots = components(links)
    rooted = nodes.select(*same, "n", "node", "first").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("first").alias("least"))
    named = pin(rooted.join(least, "root").select(*same, "n", "least"), count)
    out = _attach(base.select("doc_id", "text_hash", *same), named, same)
    kept = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("text_hash") == F.col("least.text_hash"))
    return out.select("doc_id", "text_hash", F.col("least.doc_id").alias("component_id"), kept.alias("kept"))


def _print_links(nodes: DataFrame, count: int) -> DataFrame:
    """(a, b): links of the nodes, rows (node, fp) of which `count` at most, whose fingerprints are connected as in `group_documents`."""
    nodes = pin(nodes.select("node", "fp"), count)
    prints = pin(nodes.select("fp").distinct(), count)
    roots = components(links_within_two_bits(prints, count)).withColumnRenamed("node", "fp")
    rooted = pin(nodes.join(roots, "fp", "left").select("node", F.coalesce("root", "fp").alias("root")), count)
    least = rooted.groupBy("root").agg(F.min("node").alias("b"))
    return rooted.join(least, "root").filter("node <> b").select(F.col("node").alias("a"), "b").distinct()


def _same_row() -> Column:
    return (F.col("text_hash") == F.col("of_hash")) & F.col("doc_id").eqNullSafe(F.col("of_id"))


def _bits(rows: int, text_hash: str, doc_id: str) -> tuple[Column, list[Column]]:
    """The row of a filter of ids and the two bits there that stand for an id."""
    scattered = lambda n, size: F.pmod(F.xxhash64(text_hash, doc_id, F.lit(n)), F.lit(size))
    return scattered(0, rows), [scattered(n, ROW_BITS) for n in (1, 2)]


def _through_filter(docs: DataFrame, ids: DataFrame, count: int, how: str = "left_semi") -> DataFrame:
    """The rows of `docs` (doc_id, text_hash) that a filter of `ids` (of_id, of_hash; `count` of them) lets through, or with "left_anti" the others.

    It lets all rows of the ids through and a few hundredths of the others.  It has FILTER_BITS at most, so what is broadcast does not grow
    with the table, and rows are read where they are.
    """
    rows = max(1, min(FILTER_BITS, ID_BITS * count) // ROW_BITS)
    row, bits = _bits(rows, "of_hash", "of_id")
    filter_ = ids.select(row.alias("__of_row"), F.explode(F.array(*bits)).alias("bit")).groupBy("__of_row").agg(F.bitmap_construct_agg("bit").alias("__bits"))
    row, bits = _bits(rows, "text_hash", "doc_id")
    fits = row == F.col("__of_row")
    for bit in bits:
        byte = F.conv(F.hex(F.substring("__bits", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        fits = fits & (F.getbit(byte, (bit % 8).cast("int")) == 1)
    return docs.join(F.broadcast(filter_), fits, how)


def _with_ids(docs: DataFrame, ids: DataFrame, how: str = "inner") -> DataFrame:
    """`docs` (doc_id, text_hash) joined with `ids` (of_id, of_hash): few ids are broadcast, else rows that a filter lets through are shuffled."""
    count = ids.count()
    if count <= BROADCAST_IDS:
        return docs.join(F.broadcast(ids), _same_row(), how)
    found = _through_filter(docs, ids, count).join(ids.hint("merge"), _same_row(), how)
    return found.unionByName(_through_filter(docs, ids, count, how)) if how == "left_anti" else found


def drop_near_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of each component of `near_groups`, by fingerprints and sets: the first by doc_id, nulls last, and the text's hash.

    Of rows that agree in these, the first by all columns' text stays.  Texts are read in place: what
    is joined to them are the ids of rows that go.
    """
    pairs = near_groups(docs, words, similarity, prints_too=True).groupBy("doc_id", "text_hash").agg(F.first("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    pairs = pin(pairs.withColumn("plain", F.expr("kept and n = 1")), docs.count())
    total, some = pairs.count(), pairs.filter("not plain")
    ids = lambda rows: rows.select(F.col("doc_id").alias("of_id"), F.col("text_hash").alias("of_hash"))
    hashed = docs.withColumn("__doc", F.struct(*docs.columns)).select("__doc", "doc_id", text_hash(F.col("text")).alias("text_hash"))
    # Whichever are fewer, the rows that stay as they are or the others, are looked for.
    once = _with_ids(hashed, ids(some), "left_anti") if 2 * some.count() <= total else _with_ids(hashed, ids(pairs.filter("plain")), "left_semi")
    once = once.select("__doc.*")
    copies = _with_ids(hashed, ids(some.filter("kept"))).withColumn("__all", F.to_json("__doc"))
    one = copies.groupBy("of_id", "of_hash").agg(F.min_by("__doc", "__all").alias("row")).select("row.*")
    return once.unionByName(one.select(docs.columns))
