"""Language identification: known words by per-language log frequency, unseen ones by character n-grams.

A word seen in training is scored by its log frequency in each language.  An
unseen word falls back to its character n-grams (with word edges), longest first:
the longest length at which any of its n-grams was seen decides, by the mean of the
seen n-grams' log frequencies.  A document's language is the one with the
greatest sum over its words.

The model is fitted on a sample of labelled rows of about `fit_chars` characters
at most (default FIT_CHARS), of which each language may have an equal share, so rare
ones keep more of their rows and what is broadcast to executors is bounded.

Defined cases: a null text, or one without a letter, is `und` with score 0; ties
go to the first language by name; repeated rows get equal results; without any
training row every text is `und`; an empty table stays empty; a text of any length is read
whole; in `identify` further columns stay, but for lang_pred and score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from voxtrail.llm.common import fold, per_worker, slices

FIT_CHARS = 4_000_000
LONGEST = 5
MEMO_WORDS = 100_000
FLOOR = 0.2
_WORD = re.compile(r"[^\W\d_]+")


def words(text: str) -> list[str]:
    """The runs of letters of a text, in lower case."""
    return _WORD.findall(text.lower())


def grams(word: str, n: int) -> list[str]:
    edged = f"<{word}>"
    return [edged[i : i + n] for i in range(len(edged) - n + 1)]


@dataclass
class Model:
    """Rows of log frequencies by language, found by word or by n-gram."""

    langs: list[str]
    word_row: dict[str, int]
    gram_row: dict[str, int]
    word_log: np.ndarray
    gram_log: np.ndarray
    memo: dict[str, np.ndarray] = field(default_factory=dict)

    def unseen(self, word: str) -> np.ndarray:
        """Scores of a word that training had not: those of its longest seen n-grams."""
        for n in range(LONGEST, 0, -1):
            rows = [r for g in grams(word, n) if (r := self.gram_row.get(g)) is not None]
            if rows:
                return self.gram_log[rows].mean(0)
        return np.zeros(len(self.langs), np.float32)

    def predict(self, text: str | None) -> tuple[str, float]:
        found = words(text) if text else []
        if not found or not self.langs or not any(c.isalpha() for w in found for c in w):
            return "und", 0.0
        counts = Counter(found)
        rows, weights, total = [], [], np.zeros(len(self.langs))
        memo = self.memo
        for w, n in counts.items():
            row = self.word_row.get(w)
            if row is not None:
                rows.append(row)
                weights.append(n)
                continue
            scores = memo.get(w)
            if scores is None:
                if len(memo) >= MEMO_WORDS:
                    memo.clear()
                scores = memo[w] = self.unseen(w)
            total += n * scores
        if rows:
            total += np.asarray(weights, np.float64) @ self.word_log[rows]
        p = np.exp(total - total.max())
        best = int(np.argmax(total))
        return self.langs[best], float(p[best] / p.sum())


def _logs(counts: dict[str, Counter], langs: list[str]) -> tuple[dict[str, int], np.ndarray]:
    """Row of each key and its smoothed log frequencies by language."""
    row = {k: i for i, k in enumerate(sorted({k for c in counts.values() for k in c}))}
    out = np.full((len(row), len(langs)), FLOOR)
    for j, lang in enumerate(langs):
        c = counts[lang]
        out[[row[k] for k in c], j] += np.fromiter(c.values(), float, len(c))
        out[:, j] /= sum(c.values()) + FLOOR * max(1, len(row))
    return row, np.log(out).astype(np.float32)


def fit(rows: Iterator[tuple[str, str]]) -> Model:
    """Counts words and n-grams of (text, lang) pairs."""
    by_word: dict[str, Counter] = {}
    for text, lang in rows:
        by_word.setdefault(lang, Counter()).update(words(text))
    langs = sorted(by_word)
    by_gram = {lang: Counter() for lang in langs}
    for lang in langs:
        for w, n in by_word[lang].items():
            for size in range(1, LONGEST + 1):
                for g in grams(w, size):
                    by_gram[lang][g] += n
    word_row, word_log = _logs(by_word, langs)
    gram_row, gram_log = _logs(by_gram, langs)
    return Model(langs, word_row, gram_row, word_log, gram_log)


def fit_documents(docs: DataFrame, fit_chars: int = FIT_CHARS, held_out_modulus: int = 5) -> Model:
    """Fits on rows outside the held-out fold that have a language."""
    rows = docs.select("doc_id", "text", "lang").filter((fold(F.col("doc_id"), held_out_modulus) != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").agg(F.sum(F.length("text"))).collect()}
    if sum(sizes.values()) > fit_chars:
        share = {lang: min(1.0, fit_chars / len(sizes) / max(1, n)) for lang, n in sizes.items()}
        keep = F.create_map(*[F.lit(x) for lang, s in share.items() for x in (lang, int(s * (1 << 30)))])
        rows = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < keep[F.col("lang")])
    return fit((r[0], r[1]) for r in rows.select("text", "lang").orderBy("doc_id").toLocalIterator())


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """`docs` with columns lang_pred and score, in place of any of these names; needs neither shuffle nor sort."""
    get = per_worker(docs.sparkSession, Model, model.langs, model.word_row, model.gram_row, model.word_log, model.gram_log)

    @F.arrow_udf("lang_pred string, score double")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = get()
        for texts in batches:
            found = [model.predict(t) for t in slices(texts)]
            yield pa.StructArray.from_arrays([pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.float64())], ["lang_pred", "score"])

    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    return docs.withColumn("__lang", predict(F.col(text))).select(*kept, F.col("__lang.lang_pred").alias("lang_pred"), F.col("__lang.score").alias("score"))


def identify_documents(docs: DataFrame, fit_chars: int = FIT_CHARS) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    model = fit_documents(docs, fit_chars)
    return identify(docs.select("doc_id", "text"), model).select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")
