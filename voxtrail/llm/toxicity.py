"""Toxicity by class-conditional Kneser-Ney models over the characters of words.

Two models of the characters of a word, with up to ORDER - 1 characters before
them, are counted from toxic and from ordinary rows.  Each order discounts its
counts, by amounts estimated from the counts of counts, and backs off to the next shorter
context; the shortest distribution is shared, counted from both classes, so an
expression that neither class has seen often is about as likely under either.

A text is compared by its log-likelihood under either model, normalised by length: the difference for a
character, in the run of WINDOW words (or the whole text, if it has fewer) where it is greatest, as toxic
texts hold few toxic words.  The score is a logistic curve of this one number, whose slope, never
negative, and constant are fitted on rows that the models have not seen.

A word counts once for each row that has it.

The models are fitted on a sample of labelled rows of about `fit_chars` characters
for each class at most (default FIT_CHARS); what is broadcast is bounded so.

Defined cases: a null, empty or wordless text gets the score of no evidence; a
row of `labels` with a null label, or of no document, is not learned from; several
labels of one document all count; ties cannot arise, as scores depend on the text alone;
an empty table stays empty; a text of any length is read whole; in `score` further columns stay, but for its own score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from voxtrail.llm.common import fold, per_worker, slices

FIT_CHARS = 2_000_000
ORDER = 7
FOLDS = 2
MAX_MARKS = 1_000_000
WINDOW = 2
MEMO = 150_000
_WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> list[str]:
    """The runs of letters of a text, in lower case."""
    return _WORD.findall(text.lower()) if text else []


def _counts(vocabulary: Counter) -> list[dict[str, dict[str, int]]]:
    """For each order, counts of the next character by context; below the top order, of distinct longer contexts."""
    tables: list[dict[str, dict[str, int]]] = [{} for _ in range(ORDER)]
    seen: list[set[str]] = [set() for _ in range(ORDER)]
    for word, n in vocabulary.items():
        edged = f"<{word}>"
        for i in range(1, len(edged)):
            for k in range(min(ORDER - 1, i), -1, -1):
                context, char = edged[i - k : i], edged[i]
                top = k == ORDER - 1 or k == i
                if not top:
                    longer = edged[i - k - 1 : i + 1]
                    if longer in seen[k]:
                        break
                    seen[k].add(longer)
                found = tables[k].get(context)
                if found is None:
                    found = tables[k][context] = {}
                found[char] = found.get(char, 0) + (n if top else 1)
    return tables


def discounts(table: dict[str, dict[str, int]]) -> list[float]:
    """What counts of 0, 1, 2 and 3 or more are discounted by, from how many counts of 1 to 4 there are."""
    seen = Counter(n for c in table.values() for n in c.values() if n <= 4)
    if not all(seen[n] for n in (1, 2, 3, 4)):
        return [0.0, 0.5, 0.5, 0.5]
    share = seen[1] / (seen[1] + 2 * seen[2])
    return [0.0, *(min(n, max(0.1, n - (n + 1) * share * seen[n + 1] / seen[n])) for n in (1, 2, 3))]


@dataclass
class KneserNey:
    """Interpolated Kneser-Ney probabilities; `shared` gives those of the shortest context for both classes."""

    tables: list[dict[str, dict[str, int]]]
    shared: dict[str, float]
    floor: float
    off: list[list[float]] = field(init=False)
    sums: list[dict[str, tuple[int, float]]] = field(init=False)

    def __post_init__(self) -> None:
        self.off = [discounts(t) for t in self.tables]
        self.sums = [{h: (sum(c.values()), sum(d[min(n, 3)] for n in c.values())) for h, c in t.items()} for t, d in zip(self.tables, self.off)]

    def char(self, context: str, char: str) -> float:
        """Probability of `char` after `context`."""
        p = self.shared.get(char, self.floor)
        for k in range(1, len(context) + 1):
            h = context[len(context) - k :]
            total = self.sums[k].get(h)
            if total is None:
                break
            n, freed = total
            seen = self.tables[k][h].get(char, 0)
            p = (seen - self.off[k][min(seen, 3)] + freed * p) / n
        return p

    def word(self, word: str) -> float:
        """Log-likelihood of a word's characters and its end."""
        edged = f"<{word}>"
        return sum(math.log(self.char(edged[max(0, i - ORDER + 1) : i], edged[i])) for i in range(1, len(edged)))


class Model:
    """Log ratios of each seen (context, character), what contexts add on backing off, and the curve's slope and constant."""

    def __init__(self, ratio: dict[str, float], backoff: dict[str, float], slope: float, constant: float) -> None:
        self.ratio, self.backoff, self.slope, self.constant = ratio, backoff, slope, constant
        self.memo: dict[str, float] = {}
        self.older: dict[str, float] = {}
        self.grams: dict[str, float] = {}

    def word(self, word: str) -> float:
        """Log-likelihood ratio of a word: the sum over its characters and its end."""
        edged, ratio, grams, found = f"<{word}>", self.ratio, self.grams, 0.0
        for end in range(2, len(edged) + 1):
            gram = edged[max(0, end - ORDER) : end]
            hit = ratio.get(gram)
            if hit is None:
                hit = grams.get(gram)
                if hit is None:
                    if len(grams) >= MEMO:
                        grams.clear()
                    hit = grams[gram] = self._found(gram)
            found += hit
        return found

    def _found(self, gram: str) -> float:
        """The ratio of a gram's last character, by its longest seen suffix and the contexts passed on the way."""
        out = 0.0
        for low in range(len(gram) - 1):
            hit = self.ratio.get(gram[low:])
            if hit is not None:
                return out + hit
            out += self.backoff.get(gram[low:-1], 0.0)
        return out

    def difference(self, text: str | None) -> float:
        """The greatest difference of the log-likelihoods for a character over WINDOW words; 0 without words."""
        found = words(text)
        if not found:
            return 0.0
        if len(self.memo) >= MEMO:
            self.memo, self.older = {}, self.memo
        memo, older, at = self.memo, self.older, -1
        x = list(map(memo.get, found))
        for _ in range(x.count(None)):
            at = x.index(None, at + 1)
            word = found[at]
            rate = memo.get(word)
            if rate is None:
                rate = older.get(word)
                memo[word] = rate = self.word(word) if rate is None else rate
            x[at] = rate
        sums = np.concatenate(([0.0], np.cumsum(x)))
        chars = np.concatenate(([0], np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)))
        size = min(WINDOW, len(x))
        return float(((sums[size:] - sums[:-size]) / (chars[size:] - chars[:-size])).max())

    def score(self, text: str | None) -> float:
        """Probability of the toxic label."""
        z = self.slope * self.difference(text) + self.constant
        return 1 / (1 + math.exp(-min(40.0, max(-40.0, z))))


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope, 0 at least, and constant of a logistic curve, by Newton steps from a flat one, on a slightly ridged loss."""
    x = np.stack([x, np.ones(len(x))], 1)
    ridge = np.diag([1e-3, 1e-6])
    w = np.array([0.0, np.log((y.sum() + 1) / (len(y) - y.sum() + 1))])
    loss = lambda w: np.logaddexp(0, x @ w).sum() - y @ (x @ w) + w @ ridge @ w / 2
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T * (p * (1 - p)) @ x + ridge, x.T @ (y - p) - ridge @ w)
        while np.abs(step).max() > 1e-9 and loss(w + step) > loss(w):
            step = step / 2
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return (float(w[0]), float(w[1])) if w[0] > 0 else (0.0, float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))))


def class_models(rows: list[tuple[str, int]]) -> tuple[KneserNey, KneserNey]:
    """The models of toxic and of ordinary rows."""
    vocabulary = {1: Counter(), 0: Counter()}
    for text, y in rows:
        vocabulary[y].update(set(words(text)))
    both = [_counts(vocabulary[y]) for y in (1, 0)]
    shared = Counter()
    for tables in both:
        for c in tables[0].values():
            shared.update(c)
    total = sum(shared.values()) + len(shared) + 1
    base = {c: (n + 1) / total for c, n in shared.items()}
    return KneserNey(both[0], base, 1 / total), KneserNey(both[1], base, 1 / total)


def _ratios(a: KneserNey, b: KneserNey) -> tuple[dict[str, float], dict[str, float]]:
    """Log ratios of two models for all n-grams that either has seen, and what contexts add to those of shorter ones.

    Orders go from short to long, so a gram's probabilities come from those of the gram without its first character.
    """
    ratio: dict[str, float] = {}
    backoff: dict[str, float] = {}
    lower = {c: (p, p) for c, p in a.shared.items()}
    for k in range(1, ORDER):
        now: dict[str, tuple[float, float]] = {}
        (ta, sa, oa), (tb, sb, ob) = ((m.tables[k], m.sums[k], m.off[k]) for m in (a, b))
        for h in ta.keys() | tb.keys():
            (na, fa), (nb, fb), rest = sa.get(h, (1, 1.0)), sb.get(h, (1, 1.0)), h[1:]
            ca, cb = ta.get(h), tb.get(h)
            backoff[h] = math.log(fa / na / (fb / nb))
            for char in (ca or {}).keys() | (cb or {}).keys():
                pa, pb = lower[rest + char]
                if ca is not None:
                    seen = ca.get(char, 0)
                    pa = (seen - oa[min(seen, 3)] + fa * pa) / na
                if cb is not None:
                    seen = cb.get(char, 0)
                    pb = (seen - ob[min(seen, 3)] + fb * pb) / nb
                now[h + char] = pa, pb
                ratio[h + char] = math.log(pa / pb)
        lower = now
    return ratio, backoff


def _differences(rows: list[tuple[str, int]], texts: list[str]) -> list[float]:
    """What models of `rows` find in other texts."""
    model = Model(*_ratios(*class_models(rows)), 0.0, 0.0)
    return list(map(model.difference, texts))


def fit(rows: list[tuple[str, int]]) -> Model:
    """Fits the curve on rows compared by models that have not seen them, then the models on all rows."""
    rows = sorted(rows, key=lambda r: (-r[1], r[0]))
    share = (sum(y for _, y in rows) + 1) / (len(rows) + 2)
    if len({y for _, y in rows}) < 2:
        return Model({}, {}, 0.0, math.log(share / (1 - share)))
    x, y = [], []
    for part in range(FOLDS):
        x += _differences([r for i, r in enumerate(rows) if i % FOLDS != part], [t for t, _ in rows[part::FOLDS]])
        y += [label for _, label in rows[part::FOLDS]]
    return Model(*_ratios(*class_models(rows)), *logistic(np.array(x), np.array(y, float)))


def fit_documents(docs: DataFrame, labels: DataFrame, fit_chars: int = FIT_CHARS, held_out_modulus: int = 5) -> Model:
    """Fits on labelled rows outside the held-out fold, about `fit_chars` characters for each class at most."""
    marks = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter("toxic in (0, 1) and doc_id is not null")
    texts = docs.select("doc_id", "text").filter((fold(F.col("doc_id"), held_out_modulus) != 0) & F.col("text").isNotNull())
    sizes = texts.select("doc_id", F.length("text").alias("n")).join(marks, "doc_id").groupBy("toxic").agg(F.sum("n")).collect()
    share = {y: min(1.0, fit_chars / max(1, n)) for y, n in sizes}
    keep = sum((F.when(F.col("toxic") == y, int(s * (1 << 30))).otherwise(0) for y, s in share.items()), F.lit(0))
    chosen = marks.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < keep)
    if not share:
        return fit([])
    small = chosen.count() <= MAX_MARKS  # else, of very many labels of short texts, the join shuffles
    got = texts.join(F.broadcast(chosen) if small else chosen, "doc_id").select("text", "toxic").collect()
    return fit([(r[0], r[1]) for r in got])


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """`docs` with column score, in place of one of that name; needs neither shuffle nor sort."""
    get = per_worker(docs.sparkSession, Model, model.ratio, model.backoff, model.slope, model.constant)

    @F.arrow_udf("double")
    def rate(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = get()
        for texts in batches:
            yield pa.array([model.score(t) for t in slices(texts)], pa.float64())

    return docs.withColumn("score", rate(F.col(text)))


def score_documents(docs: DataFrame, labels: DataFrame, fit_chars: int = FIT_CHARS) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    scored = score(docs.select("doc_id", "text"), fit_documents(docs, labels, fit_chars))
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
