"""Fill-in-middle transformation with a sparse index of checkpoints.

A text is cut at two of its units (words with the space before them, or the space at its end) into prefix,
middle and suffix, which are written in another order between markers.  Units are counted in blocks of bytes; every
STEP of them, the byte and the code point reached are recorded.  A cut is found by binary search among
these checkpoints and by reading on from one for less than STEP units, so what is held of a
text besides itself is one entry for STEP units.  Workers return numbers only; the new text is made by Spark's own functions.

Defined cases: a null text is empty; an empty text has no units and stays plain; a null id counts as empty text in the
hash; repeated rows give equal results; an empty table gives no rows; texts of any length are cut whole; columns of
the caller stay, but for one of the name asked for.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from voxtrail.llm.common import bounded_batches, slices

STEP = 128
BLOCK = 1 << 20
MARKERS = {"prefix": "<P>", "suffix": "<S>", "middle": "<M>"}
_UNIT = rb"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"


class Checkpoints:
    """Units, bytes and code points of a text at every `step`-th unit."""

    def __init__(self, data: bytes, step: int = STEP, block: int = BLOCK) -> None:
        self.data = data
        self.units, self.bytes, self.chars = array("q", [0]), array("q", [0]), array("q", [0])
        self.n = n_chars = 0
        whole = np.frombuffer(data, np.uint8)
        for start in range(0, len(data), block):
            part = whole[start : start + block]
            space = (part == 32) | ((part >= 9) & (part <= 13))
            after = data[start + len(part) : start + len(part) + 1]
            stops = np.append(space[1:], not after or after.isspace()) & ~space
            ends = np.flatnonzero(stops)
            at = 0
            for end in ends[(step - 1 - self.n) % step :: step].tolist():
                n_chars += _code_points(part[at : end + 1])
                at = end + 1
                self.bytes.append(start + at)
                self.chars.append(n_chars)
                self.units.append(self.units[-1] + step)
            n_chars += _code_points(part[at:])
            self.n += len(ends)
        if data and data[-1:].isspace():
            self.n += 1

    def locate(self, unit: int, forward: dict[int, re.Pattern]) -> tuple[int, int]:
        """Bytes and code points before unit number `unit` ends; `forward` reads on by a number of units."""
        i = bisect_right(self.units, unit) - 1
        at, rest = self.bytes[i], unit - self.units[i]
        if rest not in forward:
            forward[rest] = re.compile(rb"(?:" + _UNIT + rb"){%d}" % rest)
        end = forward[rest].match(self.data, at).end()
        return end, self.chars[i] + _code_points(np.frombuffer(self.data, np.uint8, end - at, at)) if end > at else self.chars[i]


def _code_points(part: np.ndarray) -> int:
    """Bytes that are no continuation of a character."""
    return int(np.count_nonzero((part & 0xC0) != 0x80))


def cuts(text: Column, first: Column, second: Column, step: int = STEP) -> Column:
    """struct<n, prefix_chars, middle_chars, prefix_bytes, middle_bytes> of texts cut at units first % (n + 1) and second % (n + 1)."""

    @F.arrow_udf("n long, prefix_chars long, middle_chars long, prefix_bytes long, middle_bytes long")
    def cut(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        forward: dict[int, re.Pattern] = {}
        for texts, a, b in batches:
            rows = []
            for data, x, y in zip(slices(texts.cast(pa.binary())), a.to_pylist(), b.to_pylist()):
                index = Checkpoints(data or b"", step)
                (low_bytes, low_chars), (high_bytes, high_chars) = (index.locate(u, forward) for u in sorted((x % (index.n + 1), y % (index.n + 1))))
                rows.append((index.n, low_chars, high_chars - low_chars, low_bytes, high_bytes - low_bytes))
            columns = np.array(rows, np.int64).reshape(-1, 5).T
            yield pa.StructArray.from_arrays([pa.array(c) for c in columns], ["n", "prefix_chars", "middle_chars", "prefix_bytes", "middle_bytes"])

    return cut(text, first, second)


def draws(key: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers for each key, from a hash of the seed and its text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def transform(docs: DataFrame, text: str = "text", key: str = "doc_id", out: str = "fim", seed: int = 42, rate: int = 50, spm: int = 80, markers: dict[str, str] = MARKERS) -> DataFrame:
    """Adds struct `out`: n, form, prefix_chars, middle_chars and output.

    `rate` percent of the texts that hold no marker are transformed, `spm` percent of these to suffix, prefix, middle, the others to
    prefix, suffix, middle; `form` says which, or plain.
    """
    bounded_batches(docs.sparkSession)
    body, (h1, h2, h3, h4) = F.coalesce(F.col(text), F.lit("")), draws(F.col(key), seed)
    rows = docs.select(F.struct("*").alias("row"), body.alias("body"), cuts(body, h1, h2).alias("cut"), h3.alias("h3"), h4.alias("h4"))
    marked = F.lit(False)
    for m in markers.values():
        marked = marked | F.contains("body", F.lit(m))
    form = F.when((F.length("body") == 0) | marked | (F.col("h3") % 100 >= rate), "plain").when(F.col("h4") % 100 < spm, "spm").otherwise("psm")
    rows = rows.withColumn("form", form)
    a, b = F.col("cut.prefix_chars").cast("int"), F.col("cut.middle_chars").cast("int")
    prefix, middle = F.substring("body", F.lit(1), a), F.substring("body", a + 1, b)
    suffix = F.substring("body", a + b + 1, F.length("body"))
    p, s, m = (F.lit(markers[k]) for k in ("prefix", "suffix", "middle"))
    output = F.when(F.col("form") == "plain", F.col("body")).when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle)).otherwise(F.concat(s, suffix, p, prefix, m, middle))
    made = [F.when(F.col("form") != "plain", F.col(f"cut.{c}")).alias(c) for c in ("prefix_chars", "middle_chars")]
    kept = [F.col("row").getField(c).alias(c) for c in docs.columns if c != out]
    return rows.select(*kept, F.struct("cut.n", "form", *made, output.alias("output")).alias(out))


def restore(output: Column, form: Column, markers: dict[str, str] = MARKERS) -> Column:
    """The text that an output of `form` was made of.

    No part holds a marker, so the first place of each is where it was put.
    """
    lengths = {k: len(v) for k, v in markers.items()}

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        rest = F.substring(output, F.lit(lengths[first] + 1), F.length(output))
        one = F.substring_index(rest, markers[second], 1)
        rest = F.substring(rest, F.length(one) + lengths[second] + 1, F.length(output))
        two = F.substring_index(rest, markers["middle"], 1)
        return one, two, F.substring(rest, F.length(two) + lengths["middle"] + 1, F.length(output))

    prefix, suffix, middle = parts("prefix", "suffix")
    suffix2, prefix2, middle2 = parts("suffix", "prefix")
    return F.when(form == "plain", output).when(form == "psm", F.concat(prefix, middle, suffix)).otherwise(F.concat(prefix2, middle2, suffix2))


def fill_in_middle_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, lengths, and hashes of every document's output and of the text restored from it."""
    made = transform(docs.select("doc_id", "text")).select("doc_id", "fim.*")
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    )
