"""Language-model scores of whole documents by a gated recurrent network.

A GRU reads a text's tokens; its output is factored by class, first the class of the
next word, then the word in the class, so a step costs two short softmaxes.
Training is truncated backpropagation through windows in numpy, with the state carried from
window to window; scoring carries it through the whole document.  Weights start from a bounded
sample of training documents (about `fit_tokens` tokens, default FIT_TOKENS) on the driver.  Then replicas of
them learn side by side from all training documents, each from its part of about REPLICA
tokens, and their mean is the model's.

The network knows the VOCABULARY most frequent tokens.  Any other token is the
outcome "rare", times its share of the rare tokens' mass under add-one counts of all
training tokens, one share being left for all unseen tokens; so every text has a
probability.  Those counts are exact and made by the cluster: they grow with the
corpus, are never gathered, and meet the documents by a join.  Only the most
frequent ones, HEAVY at most, are broadcast.

Defined cases: a null text is empty and has one token, its end; a text of any length is
scored whole, in windows; equal texts get equal scores but for rounding of the last digits;
with no training row the counts are empty and the network is uniform; an empty table stays empty; words of equal count are
taken into the vocabulary by name; further columns are left out, and their names do not matter.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from voxtrail.llm.common import bounded_batches, bounded_sample, fold, per_worker
from voxtrail.session import pin

FIT_TOKENS = 500_000
REPLICA = 300_000
VOCABULARY = 2047
CLASSES = 46
HIDDEN = 24
EMBEDDING = 24
WINDOW = 32
LANES = 64
HEAVY = 150_000
#: The end mark; no token, as tokens have no blank.
END = b" "
CLIP = 1.0
_LOG10 = np.log(10.0)


def tokens(text: str | None) -> list[bytes]:
    """Words with A-Z in lower case, then the end mark."""
    found = text.encode().lower().split() if text else []
    found.append(END)
    return found


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1.0)


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(-1, keepdims=True)
    return x - np.log(np.exp(x).sum(-1, keepdims=True))


def _log_picked(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Log softmax of each row at one place, without making the others."""
    top = float(np.abs(x).max(initial=0.0))
    shift = 0.0 if top < 60 else x.max(-1, keepdims=True)
    total = np.exp(x - shift if top >= 60 else x) @ np.ones(x.shape[1], x.dtype)
    return x[np.arange(len(x)), at] - np.log(total) - (shift if top < 60 else shift[:, 0])


@dataclass
class Gru:
    """Weights, and for each symbol its class and place there; symbol 0 is "rare"."""

    classes: np.ndarray
    place: np.ndarray
    sizes: np.ndarray
    p: dict[str, np.ndarray]

    @classmethod
    def start(cls, frequency: np.ndarray, classes: int = CLASSES, seed: int = 7) -> Gru:
        """Classes of near-equal probability, filled by descending frequency; weights small and random."""
        order = np.argsort(-frequency, kind="stable")
        share = np.cumsum(np.sqrt(frequency[order])) / max(np.sqrt(frequency).sum(), 1e-9)
        at = np.minimum((share * classes * (1 - 1e-9)).astype(int), classes - 1)
        _, at = np.unique(at, return_inverse=True)
        of, place = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        of[order] = at
        sizes = np.bincount(at)
        place[order] = np.arange(len(order)) - np.concatenate(([0], np.cumsum(sizes)[:-1]))[at]
        rng, n, h, e, c = np.random.default_rng(seed), len(frequency), HIDDEN, EMBEDDING, len(sizes)
        draw = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
        p = {"E": draw(n, e), "W": draw(e, 3 * h), "U": draw(h, 3 * h), "b": np.zeros(3 * h, np.float32), "C": draw(h, c), "d": np.zeros(c, np.float32), "V": draw(n, h), "v": np.zeros(n, np.float32)}
        total = max(frequency.sum(), 1.0)
        p["d"][:] = np.log((np.bincount(of, frequency, c) + 1) / (total + c))
        p["v"][:] = np.log(frequency + 0.5)
        return cls(of, place, sizes, p)

    def __post_init__(self) -> None:
        #: The symbols of each class, by place.
        self.members = np.split(np.lexsort((self.place, self.classes)), np.cumsum(self.sizes)[:-1])

    def step(self, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, tuple]:
        """One step from projected inputs `x`; gives the new state and what backpropagation needs."""
        n = HIDDEN
        u = h @ self.p["U"]
        rz = _sigmoid(x[:, : 2 * n] + u[:, : 2 * n])
        r, z = rz[:, :n], rz[:, n:]
        c = np.tanh(x[:, 2 * n :] + r * u[:, 2 * n :])
        return c + z * (h - c), (h, r, z, c, u[:, 2 * n :])

    def outputs(self, states: np.ndarray, targets: np.ndarray, grads: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Log probability of each target after each state, and with `grads` also the states' gradients of minus their sum."""
        of = self.classes[targets]
        logits = states @ self.p["C"] + self.p["d"]
        out, back = _log_picked(logits, of), None
        if grads is not None:
            logits = _log_softmax(logits)
            g = np.exp(logits)
            g[np.arange(len(of)), of] -= 1
            grads["C"] += states.T @ g
            grads["d"] += g.sum(0)
            back = g @ self.p["C"].T
        order = np.argsort(of, kind="stable")
        cuts = np.searchsorted(of[order], np.arange(len(self.sizes) + 1))
        for c, words in enumerate(self.members):
            rows = order[cuts[c] : cuts[c + 1]]
            if not len(rows) or len(words) == 1:
                continue
            some, at = states[rows], self.place[targets[rows]]
            logits = some @ self.p["V"][words].T + self.p["v"][words]
            out[rows] += _log_picked(logits, at)
            if grads is not None:
                logits = _log_softmax(logits)
                g = np.exp(logits)
                g[np.arange(len(rows)), at] -= 1
                grads["V"][words] += g.T @ some
                grads["v"][words] += g.sum(0)
                back[rows] += g @ self.p["V"][words]
        return out, back

    def window(self, inputs: np.ndarray, targets: np.ndarray, h: np.ndarray, live: np.ndarray, learn: bool, table: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, dict | None]:
        """[steps, lanes] log probabilities, the last states, and the gradients if asked; dead places count nothing.

        `table` has the projected inputs of all symbols, where weights do not change between windows.
        """
        steps, lanes = inputs.shape
        x = self.p["E"][inputs.ravel()] @ self.p["W"] + self.p["b"] if table is None else table[inputs.ravel()]
        x = x.reshape(steps, lanes, -1)
        states, kept = np.empty((steps, lanes, HIDDEN), np.float32), []
        for t in range(steps):
            h, saved = self.step(x[t], h)
            states[t] = h
            if learn:
                kept.append(saved)
        at = np.flatnonzero(live.ravel())
        grads = {k: np.zeros_like(v) for k, v in self.p.items()} if learn else None
        found, back = self.outputs(states.reshape(-1, HIDDEN)[at], targets.ravel()[at], grads)
        out = np.zeros(steps * lanes)
        out[at] = found
        if learn:
            upper = np.zeros((steps * lanes, HIDDEN), np.float32)
            upper[at] = back
            self._through_time(upper.reshape(steps, lanes, -1), kept, inputs, grads)
        return out.reshape(steps, lanes), h, grads

    def _through_time(self, upper: np.ndarray, kept: list, inputs: np.ndarray, grads: dict) -> None:
        n, gh = HIDDEN, np.zeros_like(upper[0])
        gx = np.empty((*upper.shape[:2], 3 * n), np.float32)
        for t in range(len(kept) - 1, -1, -1):
            h, r, z, c, u = kept[t]
            gh = gh + upper[t]
            gc = gh * (1 - z) * (1 - c * c)
            gz = gh * (h - c) * z * (1 - z)
            gr = gc * u * r * (1 - r)
            gu = np.concatenate((gr, gz, gc * r), 1)
            gx[t] = np.concatenate((gr, gz, gc), 1)
            grads["U"] += h.T @ gu
            gh = gh * z + gu @ self.p["U"].T
        flat = gx.reshape(-1, 3 * n)
        grads["W"] += self.p["E"][inputs.ravel()].T @ flat
        grads["b"] += flat.sum(0)
        np.add.at(grads["E"], inputs.ravel(), flat @ self.p["W"].T)

    def train(self, symbols: list[np.ndarray], passes: int = 3, rate: float = 0.01) -> None:
        """Truncated backpropagation with Adam over the documents laid end to end in LANES lanes."""
        line = np.concatenate(symbols) if symbols else np.zeros(0, np.int64)
        lanes = max(1, min(LANES, len(line) // WINDOW))
        length = len(line) // lanes
        if length < 2:
            return
        lanes_of = line[: lanes * length].reshape(lanes, length).T
        end = int(symbols[0][-1])
        first, second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        turn = 0
        for done in range(passes):
            h = np.zeros((lanes, HIDDEN), np.float32)
            before = np.full((1, lanes), end)
            for a in range(0, length, WINDOW):
                targets = lanes_of[a : a + WINDOW]
                inputs = np.concatenate((before, targets[:-1]))
                before = targets[-1:]
                _, h, grads = self.window(inputs, targets, h, np.ones(targets.shape, bool), True)
                scale, turn = 1.0 / targets.size, turn + 1
                norm = scale * np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
                scale *= min(1.0, CLIP / max(norm, 1e-9))
                speed = rate * (0.3 if done == passes - 1 else 1.0)
                for k, g in grads.items():
                    g = g * np.float32(scale)
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.01 * (g * g - second[k])
                    self.p[k] -= speed * (first[k] / (1 - 0.9**turn)) / (np.sqrt(second[k] / (1 - 0.99**turn)) + 1e-8)

    def score(self, docs: list[np.ndarray], end: int) -> np.ndarray:
        """Natural log probability of each document's symbols; documents of like length go side by side, a window at a time."""
        out, table = np.zeros(len(docs)), self.p["E"] @ self.p["W"] + self.p["b"]
        order = sorted(range(len(docs)), key=lambda i: len(docs[i]))
        for a in range(0, len(order), 8 * LANES):
            some = order[a : a + 8 * LANES]
            lengths = np.array([len(docs[i]) for i in some])
            flat = np.concatenate([docs[i] for i in some])
            starts = np.cumsum(lengths) - lengths
            h, before = np.zeros((len(some), HIDDEN), np.float32), np.full(len(some), end)
            total = np.zeros(len(some))
            for t in range(0, int(lengths[-1]), WINDOW):
                first = int(np.searchsorted(lengths, t, side="right"))  # lanes before it have ended
                steps = np.arange(t, min(t + WINDOW, int(lengths[-1])))[:, None]
                live = steps < lengths[None, first:]
                targets = np.where(live, flat[np.minimum(starts[None, first:] + steps, len(flat) - 1)], end)
                inputs = np.concatenate((before[None, first:], targets[:-1]))
                got, h_new, _ = self.window(inputs, targets, h[first:], live, False, table)
                total[first:] += got.sum(0)
                h[first:], before[first:] = h_new, targets[-1]
            out[some] = total
        return out


@dataclass
class Scorer:
    """The network with its symbols, and the counts of the most frequent tokens."""

    net: Gru
    symbol: dict[bytes, int]
    heavy: dict[bytes, int]
    n: int
    v: int
    rare_log: float

    def unit(self, count: int) -> float:
        """log10 of a token's add-one share."""
        return float(np.log10((count + 1) / (self.n + self.v + 1)))


def _scorer(classes: np.ndarray, place: np.ndarray, sizes: np.ndarray, p: dict[str, np.ndarray], *rest) -> Scorer:
    return Scorer(Gru(classes, place, sizes, p), *rest)


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of a partition's tokens, in parts of bounded size."""
    found: Counter = Counter()
    for batch in batches:
        for text in batch.text:
            found.update(tokens(text))
            if len(found) > 300_000:
                yield pd.DataFrame({"token": list(found), "c": list(found.values())})
                found = Counter()
    if found:
        yield pd.DataFrame({"token": list(found), "c": list(found.values())})


def most_frequent(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """The tokens counted at least so often that there are `most` of them at most, by descending count.

    The bound is read off a histogram of counts in steps of an eighth of a power of two, so
    no more than `most` rows ever come to the driver.
    """
    step = F.floor(F.log2("c") * 8).cast("int")
    kept, least = 0, None
    for at, some in sorted(counts.groupBy(step.alias("b")).count().collect(), reverse=True):
        if kept + some > most:
            break
        kept, least = kept + some, at
    if least is None:
        return []
    return sorted(((bytes(r[0]), r[1]) for r in counts.filter(step >= least).collect()), key=lambda r: (-r[1], r[0]))


def fit(training: DataFrame, counts: DataFrame, n: int, v: int, fit_tokens: int = FIT_TOKENS) -> Scorer:
    """Trains the network on a bounded sample; takes the most frequent tokens of `counts`."""
    heavy = dict(most_frequent(counts, HEAVY))
    known = list(heavy)[:VOCABULARY]
    if END not in known:
        known = [*known[: VOCABULARY - 1], END]
    symbol = {t: i + 1 for i, t in enumerate(known)}
    frequency = np.array([0.0, *(heavy.get(t, 0) for t in known)])
    frequency[0] = max(1.0, n - frequency.sum())
    net = Gru.start(frequency)
    sample = bounded_sample(training, "text", 6 * fit_tokens, ["doc_id"]).orderBy("doc_id").select("text").toLocalIterator()
    net.train([np.array([symbol.get(t, 0) for t in tokens(r[0])]) for r in sample])
    mass = (n + v + 1 - sum(heavy.get(t, 0) + 1 for t in known)) / (n + v + 1)
    return Scorer(net, symbol, heavy, n, v, float(np.log10(max(mass, 1e-300))))


def _flat(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in sorted(p)])


def _shaped(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


def refine(training: DataFrame, fitted: Scorer, replica: int = REPLICA) -> None:
    """Replaces the network's weights by the mean of those of replicas, each trained on its part of `training`, which has all rows.

    Rows are dealt by a hash of their place, so repeated ids spread over replicas.  Replicas' weights are averaged
    in groups first; the driver gets about as many vectors as the square root of their number.
    """
    net = fitted.net
    count = max(1, round(fitted.n / replica))
    groups = max(1, round(count**0.5))
    get = per_worker(training.sparkSession, _scorer, net.classes, net.place, net.sizes, net.p, fitted.symbol, {}, fitted.n, fitted.v, fitted.rare_log)
    like = {k: np.empty(v.shape, np.int8) for k, v in net.p.items()}

    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        model = get()
        copy = Gru(model.net.classes, model.net.place, model.net.sizes, {k: v.copy() for k, v in model.net.p.items()})
        lines = [np.array([model.symbol.get(t, 0) for t in tokens(x)]) for x in rows.sort_values("place").text]
        copy.train(lines, passes=1)
        return pd.DataFrame({"part": [int(rows.part.iloc[0]) % groups], "n": [sum(map(len, lines))], "w": [_flat(copy.p).astype("<f4").tobytes()]})

    def mean(rows: pd.DataFrame) -> pd.DataFrame:
        n = rows.n.to_numpy()
        total = sum(k * np.frombuffer(w, "<f4").astype(np.float64) for k, w in zip(n, rows.w))
        return pd.DataFrame({"n": [int(n.sum())], "w": [(total / n.sum()).astype("<f4").tobytes()]})

    place = F.monotonically_increasing_id()
    dealt = training.select("text", place.alias("place")).withColumn("part", F.pmod(F.xxhash64("place", F.lit("part")), F.lit(count)).cast("int"))
    trained = dealt.groupBy("part").applyInPandas(learn, "part int, n long, w binary")
    got = trained.groupBy("part").applyInPandas(mean, "n long, w binary").collect()
    if got:
        n = sum(r.n for r in got)
        net.p = _shaped(sum(r.n / n * np.frombuffer(r.w, "<f4").astype(np.float64) for r in got), like)


def score_documents(docs: DataFrame, modulus: int = 7, held: int = 2, fit_tokens: int = FIT_TOKENS) -> DataFrame:
    """doc_id, held_out, token counts, base_score and score of every document."""
    bounded_batches(docs.sparkSession)
    part = fold(F.col("doc_id"), modulus)
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), part.alias("part"))
    training = base.filter(F.col("part") != held)
    counts = pin(training.select("text").mapInPandas(_count, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c")))
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    fitted = fit(training.select("doc_id", "text"), counts, n, v, fit_tokens)
    refine(training, fitted)
    net = fitted.net
    get = per_worker(docs.sparkSession, _scorer, net.classes, net.place, net.sizes, net.p, fitted.symbol, fitted.heavy, n, v, fitted.rare_log)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = get()
        symbol, heavy, net = model.symbol, model.heavy, model.net
        end, unit = symbol[END], {}
        for batch in batches:
            for a in range(0, len(batch), 1024):
                some = batch.iloc[a : a + 1024]
                lines, known, sums, rare, lost = [], [], [], [], []
                for text in some.text:
                    found = tokens(text)
                    line = np.fromiter(map(symbol.get, found, repeat(0)), np.int32, len(found))
                    lines.append(line)
                    total, other, hits, left = 0.0, 0.0, 0, Counter()
                    for t, c in Counter(found).items():
                        k = heavy.get(t)
                        if k is None:
                            left[t] = c
                            continue
                        log = unit.get(k)
                        if log is None:
                            log = unit[k] = model.unit(k)
                        hits += c
                        total += c * log
                        if t not in symbol:
                            other += c * log
                    known.append(hits)
                    sums.append(total)
                    rare.append(other - np.count_nonzero(line == 0) * model.rare_log)
                    lost.append(left)
                scores = net.score(lines, end) / _LOG10
                yield pd.DataFrame({"doc_id": some.doc_id, "part": some.part, "row": some.row, "n_tokens": [len(x) for x in lines], "hits": known, "base": sums, "model": scores + np.array(rare), "lost": [[{"t": t, "c": c} for t, c in x.items()] for x in lost]})

    kind = dict(docs.dtypes)["doc_id"]
    # The row number keeps repeated ids apart; it depends on files and splits alone.
    numbered = base.withColumn("row", F.monotonically_increasing_id())
    scored = pin(numbered.mapInPandas(score, f"doc_id {kind}, part long, row long, n_tokens long, hits long, base double, model double, lost array<struct<t: binary, c: long>>"))
    rest = scored.select("row", F.explode("lost").alias("x")).select("row", "x.t", "x.c").withColumnRenamed("c", "times")
    log = F.log10((F.coalesce("c", F.lit(0)) + 1) / F.lit(float(n + v + 1)))
    priced = rest.join(counts, rest.t == counts.token, "left").select("row", "times", (F.col("times") * log).alias("log"), F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0).alias("seen"))
    summed = priced.groupBy("row").agg(F.sum("log").alias("log"), F.sum("seen").alias("seen"))
    out = scored.drop("lost").join(summed, "row", "left")
    more = F.coalesce("log", F.lit(0.0))
    return out.select(
        "doc_id",
        (F.col("part") == held).alias("held_out"),
        "n_tokens",
        (F.col("hits") + F.coalesce("seen", F.lit(0))).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"),
        (F.col("model") + more).alias("score"),
    )
