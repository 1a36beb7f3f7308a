"""Packing of tokenised documents into sequences by Karmarkar-Karp multiway differencing.

A document's ids are cut into whole sequences first; what remains of it, which of a document
shorter than a sequence is all of it, is one item.  Items are dealt to blocks of about
WINDOWS sequences each.  In a block, differencing starts with a partition for each item and
merges the two partitions of greatest imbalance, heaviest windows against lightest, until one
is left: near-equal windows.  The number of windows rises by one whenever one of them exceeds the
capacity.  Where that would leave more than PADDING of the block empty, some of its longest items
are cut into grains of GRAIN ids, which level the windows, and more of them if that
is not enough; all other items stay whole.

Only lengths and digests are shuffled, never ids.  Sequence numbers are unique, not
consecutive: a block's number with the window's, or a whole sequence's row number.

Defined cases: a null or empty text has one id, the end mark; equal documents are packed
each for itself; an empty table gives no rows; a block's last window is the only
one that can be much shorter than the others, and only where the table has few ids; a text of any length is read whole and
cut where windows end; null ids are ids like any other, last in order; windows of equal length are merged in the order of
their documents; further columns are left out, and their names do not matter.
"""

from __future__ import annotations

import heapq
import os
import re
import unicodedata
import zlib
from collections.abc import Iterator
from string import punctuation

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from voxtrail.llm.common import per_worker
from voxtrail.session import pin

CAPACITY = 2048
GRAIN = 32
WINDOWS = 256
PADDING = 0.015
MEMO = 900_000
END = (1).to_bytes(4, "little")
_FULL = 1 << 62
_SPACE = re.compile(r"[ \t\n\r]+")
_ODD = re.compile(r"[\x1c-\x1f]")  # blanks to str.split, but not to the file


class WordTokenizer:
    """Ids of texts by a `tokenizers` file whose pieces never span white space.

    Words are encoded once and kept, `memo` of them; an older generation is kept while a new one fills.  A text with one of the file's special marks,
    which could span words, is encoded as a whole.
    """

    def __init__(self, definition: str, memo: int = MEMO) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_str(definition)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.most = memo
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}
        self.closing: dict[str, bool] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.ending = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ending[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def _encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _base(self, word: str) -> tuple[str, bytes]:
        """A word in simpler words: ASCII marks after a letter or digit are a piece by themselves, and case makes no difference."""
        base, tail = word.rstrip(punctuation), b""
        if len(base) == len(word) or not base or not self._closes(base[-1]):
            base = word
        else:
            marks = word[len(base) :]
            found = self.tails.get(marks)
            if found is None:
                if len(self.tails) >= self.most:
                    self.tails.clear()
                found = self.tails[marks] = self._encode(marks)
            tail = found
        if base.isascii():
            base = base.lower()
        elif "A" <= base[0] <= "Z":
            base = base[0].lower() + base[1:]
        return base, tail

    def _closes(self, char: str) -> bool:
        """Whether a character ends in a letter or digit after the file's normalisation, so that marks behind it are a piece apart."""
        if char.isascii():
            return char.isalnum()
        found = self.closing.get(char)
        if found is None:
            last = unicodedata.normalize("NFC", char).lower()[-1]
            found = self.closing[char] = unicodedata.category(last)[0] in "LN"
        return found

    def _learn(self, words: set[str]) -> None:
        """Encodes new words of letters together: each is one piece, and its last id alone ends a piece."""
        words = [w for w in words if w.isalpha()]
        for i in range(0, len(words), 200):
            some = words[i : i + 200]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends = (4 * np.flatnonzero(self.ending[ids]) + 4).tolist()
            if len(ends) != len(some):
                continue  # these are left to be encoded one by one
            data = ids.tobytes()
            self.memo.update(zip(some, map(data.__getitem__, map(slice, [0, *ends], ends))))

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        split = [None if not t or any(s in t for s in self.special) else _SPACE.split(t) if _ODD.search(t) else t.split() for t in texts]
        if len(self.memo) >= self.most:
            self.memo, self.older = {}, self.memo
        find, found, gaps, new = self.memo.get, [], [], set()
        for words in split:
            some, holes, at = list(map(find, words or ())), [], -1
            for _ in range(some.count(None)):
                at = some.index(None, at + 1)
                holes.append(at)
                new.add(words[at])
            found.append(some)
            gaps.append(holes)
        self._meet(new)
        find = self.memo.__getitem__
        for words, some, holes in zip(split, found, gaps):
            for at in holes:
                some[at] = find(words[at])
        return [b"".join(some) if words is not None else self._encode(text or "") for text, words, some in zip(texts, split, found)]

    def _meet(self, new: set[str]) -> None:
        """Puts words into the memo, from the older one, from simpler words or by encoding them."""
        memo, older = self.memo, self.older
        aged = new & older.keys()
        memo.update(zip(aged, map(older.__getitem__, aged)))
        derived, unknown = [], set()
        for w in new - aged:
            base, tail = self._base(w)
            if base != w:
                derived.append((w, base, tail))
            if base not in memo:
                if base in older:
                    memo[base] = older[base]
                else:
                    unknown.add(base)
        self._learn(unknown)
        for w in unknown.difference(memo):
            memo[w] = self._encode(w)
        for w, base, tail in derived:
            memo[w] = memo[base] + tail


def differencing(lengths: np.ndarray, windows: int) -> np.ndarray:
    """The window, 0 to windows - 1, of each length, by largest differencing of `windows`-part partitions.

    A partition holds the sums of its windows in descending order, empty ones left out,
    and for each the node of the pieces in it; joining two windows makes a node of their
    nodes.  Sums are kept less the least one, which changes no difference.
    """
    n = len(lengths)
    if not n:
        return np.zeros(0, np.int64)
    order = np.argsort(-lengths, kind="stable")
    single, at = lengths[order], 0  # pieces by descending length, those from `at` on in no partition yet
    parts: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    heap: list[tuple[int, int]] = []
    joined, nodes, key, na = [], n, n, order[:0]

    def largest(most: int) -> tuple[np.ndarray, np.ndarray]:
        """The partition of greatest difference, or up to `most` pieces that come before any partition."""
        nonlocal at
        if at < n and (not heap or single[at] >= -heap[0][0]):
            stop = min(n, at + most)
            if heap and most > 1:
                stop = at + int(np.searchsorted(-single[at:stop], heap[0][0], side="right"))
            found = (single[at:stop], order[at:stop])
            at = stop
            return (found[0] - found[0][-1], found[1]) if len(found[0]) == windows else found
        return parts.pop(heapq.heappop(heap)[1])

    def pour(sums: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A partition of greatest difference with the pieces that come next, each in the lightest window, while they do."""
        nonlocal at, nodes
        least, bound, top = list(zip(sums.tolist(), range(windows))), -heap[0][0] if heap else 0, int(sums[0])
        heapq.heapify(least)
        ids = ids.copy()
        while at < n and top - least[0][0] >= single[at] >= bound:
            s, i = least[0]
            joined.append((nodes, ids[i : i + 1].copy(), order[at : at + 1]))
            ids[i] = nodes
            heapq.heapreplace(least, (s + int(single[at]), i))
            top = max(top, s + int(single[at]))
            nodes += 1
            at += 1
        least.sort(reverse=True)
        sums = np.array([s for s, _ in least], np.int64)
        return sums - sums[-1], ids[[i for _, i in least]]

    while at < n or heap:
        # A first piece takes up the next ones until it has all windows, as no difference exceeds its length
        # until then; so it gets as many of them at once.
        a, na = largest(windows)
        if at == n and not heap:
            break
        if len(a) == windows and at < n and a[0] >= single[at] >= (-heap[0][0] if heap else 0):
            a, na = pour(a, na)
            if at == n and not heap:
                break
        if len(a) == windows and max(single[at] if at < n else 0, -heap[0][0] if heap else 0) > a[0]:
            parts[key] = (a, na)  # others have a greater difference now that it is full
            heapq.heappush(heap, (-int(a[0]), key))
            key += 1
            continue
        b, nb = largest(1)
        both = max(0, len(a) + len(b) - windows)  # so many windows of each meet, the heaviest of one with the lightest of the other
        meet = a[len(a) - both :] + b[len(b) - both :][::-1]
        new = np.arange(nodes, nodes + both)
        if both:
            joined.append((nodes, na[len(a) - both :], nb[len(b) - both :][::-1]))
            nodes += both
        sums = np.concatenate((a[: len(a) - both], b[: len(b) - both], meet))
        ids = np.concatenate((na[: len(a) - both], nb[: len(b) - both], new))
        by = np.argsort(-sums, kind="stable")
        sums, ids = sums[by], ids[by]
        if len(sums) == windows:
            sums = sums - sums[-1]
        parts[key] = (sums, ids)
        heapq.heappush(heap, (-int(sums[0]), key))
        key += 1
    window = np.zeros(nodes, np.int64)
    window[na] = np.arange(len(na))
    for first, left, right in reversed(joined):
        window[left] = window[right] = window[first : first + len(left)]
    return window[:n]


def pack_lengths(lengths: np.ndarray, capacity: int = CAPACITY, grain: int = GRAIN, padding: float = PADDING) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of items in few windows, none above `capacity`: each one's item, place of its start there, length and window.

    A piece is an item, or one of its grains.  Items are cut, the longest first, until they are a share of
    all ids: none at first, then a sixteenth and twice as much every time.
    """
    by, total = np.argsort(-lengths, kind="stable"), int(lengths.sum())
    before = np.cumsum(lengths[by]) - lengths[by]
    fewest, share = max(1, -(-total // capacity)), 0.0
    most = max(fewest, int(total * (1 + padding) / capacity))
    while True:
        apart = np.zeros(len(lengths), bool)
        apart[by[before < share * total]] = True
        parts = np.where(apart, -(-lengths // grain), 1)
        item = np.repeat(np.arange(len(lengths)), parts)
        start = (np.arange(len(item)) - np.repeat(np.cumsum(parts) - parts, parts)) * grain
        length = np.where(apart[item], np.minimum(grain, lengths[item] - start), lengths[item])
        # Windows of `grain` ids less than the capacity are what grains level surely; whole items may be lucky.
        windows = fewest if not share else max(fewest, min(most, -(-total // max(1, capacity - grain // 2))))
        while windows <= most or share >= 1:
            at = differencing(length, windows)
            if np.bincount(at, length, windows).max(initial=0) <= capacity:
                return item, start, length, at
            windows += 1
        share = min(1.0, 2 * share or 0.0625)


def items(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, grain: int = GRAIN, memo: int = MEMO) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens and grains of every document's whole sequences and its rest.

    `grains` has the rest's checksums by grains of `grain` ids, as unsigned 32-bit integers.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        tokenizer = per_worker(docs.sparkSession, WordTokenizer, f.read(), memo)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, crc32, size = tokenizer().encode_batch, zlib.crc32, 4 * grain
        for batch in batches:
            texts, rows, at, crc, grains = batch.column(1), [], [], [], []
            for i in range(0, len(texts), 200):
                for row, ids in enumerate(encode(texts.slice(i, 200).to_pylist()), i):
                    data = ids + END
                    n = len(data) // 4
                    for start in range(0, n, capacity):
                        length = min(capacity, n - start)
                        part = data[4 * start : 4 * (start + length)]
                        rows.append(row)
                        at.append((start, length, n))
                        crc.append(crc32(part))
                        grains.append(None if length == capacity else np.array([crc32(part[k : k + size]) for k in range(0, len(part), size)], "<u4").tobytes())
            flat = np.array(at, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(flat[:, 0]), pa.array(flat[:, 1]), pa.array(np.array(crc, np.int64)), pa.array(flat[:, 2]), pa.array(grains, pa.binary())], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "grains"])

    return docs.select("doc_id", "text").mapInArrow(split, f"doc_id {dict(docs.dtypes)['doc_id']}, start long, length long, ids_crc32 long, doc_tokens long, grains binary")


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, grain: int = GRAIN, windows: int = WINDOWS, memo: int = MEMO) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset of all pieces of all documents; a worker keeps `memo` words twice."""
    found = pin(items(docs, tokenizer_path, capacity, grain, memo)).withColumn("row", F.monotonically_increasing_id())
    whole = found.filter(F.col("length") == capacity)
    whole = whole.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("row") + F.lit(_FULL)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = found.filter(F.col("length") < capacity)
    tokens = rest.agg(F.sum("length")).first()[0] or 0
    blocks = max(1, round(tokens / (capacity * windows)))

    def place(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("row", ignore_index=True)
        item, start, length, window = pack_lengths(block.length.to_numpy(), capacity, grain)
        cut = length < block.length.to_numpy()[item]
        crc = block.ids_crc32.to_numpy()[item]
        grains = block.grains.to_numpy()
        crc[cut] = [int.from_bytes(grains[i][k : k + 4], "little") for i, k in zip(item[cut].tolist(), (4 * start[cut] // grain).tolist())]
        block = block.iloc[item].assign(window=window, length=length, ids_crc32=crc, start=block.start.to_numpy()[item] + start)
        block = block.sort_values(["window", "row", "start"], ignore_index=True)
        block["offset"] = block.groupby("window").length.cumsum() - block.length
        block["sequence_id"] = block.block * (1 << 20) + block.window
        return block[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    dealt = rest.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)))
    kind = dict(docs.dtypes)["doc_id"]
    placed = dealt.groupBy("block").applyInPandas(place, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return placed.unionByName(whole)
