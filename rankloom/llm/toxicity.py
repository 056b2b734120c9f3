"""Toxicity by class-conditional Kneser-Ney models: length-normalised log-likelihoods of both classes.

A text is read as its lower-cased words, and a word byte by byte, with its end, so that stems tell about forms never seen.
An expression is a byte with the ORDER - 1 bytes before it in its word.  Each class has a model of a byte after those before
it: absolutely discounted counts of the class, interpolated with a backoff that both classes share, Kneser-Ney down to single bytes, from continuation counts over both classes.  The discounts are set so that
both classes give the same mass to the backoff: an expression that is rare in both has nearly the same probability in
both, whatever the sizes of the classes.

A document's evidence is the difference of both classes' log-likelihoods divided by the number of expressions, of the whole
text and of its most toxic stretch of ``STRETCH`` expressions (about a word): a few words in a long text weigh little in
the first.  A logistic curve over both, fitted on training rows, each without its own counts, turns it into a probability.

Training rows: up to ``SAMPLE`` labelled rows, those with the smallest hash of their id.  Every document is scored whole.
Rules for odd rows: null texts are empty and have no evidence; null labels teach nothing; of several labels for an id the
largest counts; without any toxic or any ordinary training row all scores are 0; repeated rows score alike; further columns
don't matter, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import Slab, column, slabs
from .runtime import free, mapped, prepare, written

ORDER = 5
#: Mass of each class that goes to the shared backoff.
SHARED = 0.1
#: Expressions of a stretch.
STRETCH = 6
#: Different expressions that a task holds before it sends their counts.
BLOCK = 4_000_000
#: Most labelled rows that the model learns from.
SAMPLE = 60_000
THRESHOLD = 0.7

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_FOLD = np.where(_LETTER, np.arange(256), 0x20).astype(np.uint64)
_FOLD[65:91] += np.uint64(32)


def expressions(slab: Slab, order: int = ORDER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code, text, place) of every byte of a word and of the blank after it, with the order - 1 bytes before it; what is
    before the word counts as blank.  A code is its bytes as one integer."""
    n, texts = len(slab.data), len(slab)
    padded = np.full(n + texts + 1, 0x20, dtype=np.uint64)
    padded[np.arange(n) + np.repeat(np.arange(1, texts + 1), np.diff(slab.offsets))] = _FOLD[slab.data]
    of = np.concatenate([[0], np.repeat(np.arange(texts), np.diff(slab.offsets) + 1)])
    letter = padded != 0x20
    at = np.flatnonzero(letter[1:] | letter[:-1]) + 1
    code, inside = padded[at], np.ones(len(at), dtype=bool)
    for k in range(1, order):
        before = padded[np.maximum(at - k, 0)]
        inside &= before != 0x20
        code = code | np.where(inside, before, np.uint64(0x20)) << np.uint64(8 * k)
    return code, of[at], at


def _own(code: np.ndarray, text: np.ndarray) -> np.ndarray:
    """How often each expression's code occurs in its text."""
    _, back, n = np.unique((text.astype(np.uint64) << np.uint64(8 * ORDER)) | code, return_inverse=True, return_counts=True)
    return n[back]


class Model:
    """What the classes' log-likelihoods of an expression differ by, and the curve from evidence to probability.

    codes, ratios: expressions whose discounted count isn't 0 in both classes.  For all others the shared backoff cancels, and
    the difference is that of their contexts' backoff masses (contexts, masses); 0 for a context seen in neither class."""

    def __init__(self, codes=(), ratios=(), contexts=(), masses=(), slopes: np.ndarray = np.zeros(2), shift: float = -50.0):
        sort = lambda k, v: (np.asarray(k, np.uint64)[np.argsort(k)], np.asarray(v, float)[np.argsort(k)])
        (self.codes, self.ratios), (self.contexts, self.masses) = sort(codes, ratios), sort(contexts, masses)
        self.slopes, self.shift = slopes, shift

    @staticmethod
    def _find(keys: np.ndarray, values: np.ndarray, some: np.ndarray, default: np.ndarray | float) -> np.ndarray:
        if not len(keys):
            return np.zeros(len(some)) + default
        at = np.minimum(np.searchsorted(keys, some), len(keys) - 1)
        return np.where(keys[at] == some, values[at], default)

    def differences(self, code: np.ndarray) -> np.ndarray:
        """log P(last byte | the bytes before it) of the toxic class less that of the ordinary class, for each expression."""
        own, back = np.unique(code, return_inverse=True)
        backed_off = self._find(self.contexts, self.masses, own >> np.uint64(8), 0.0)
        return self._find(self.codes, self.ratios, own, backed_off)[back]

    def evidence(self, slab: Slab, stretch: int = STRETCH, differences=None) -> np.ndarray:
        """A row for each text: the length-normalised difference of the whole text's log-likelihoods, and the largest one
        of its stretches of ``stretch`` expressions (a shorter text counts as one), 0 at least."""
        code, text, _ = expressions(slab)
        found = differences(code, text) if differences else self.differences(code)
        number = np.bincount(text, minlength=len(slab))
        mean = np.bincount(text, weights=found, minlength=len(slab)) / np.maximum(number, 1)
        most = np.where(number < stretch, np.maximum(mean, 0), 0.0)
        if len(found) >= stretch:
            sums = np.concatenate([[0.0], np.cumsum(found)])
            windows = (sums[stretch:] - sums[:-stretch]) / stretch
            inside = text[: len(windows)] == text[stretch - 1 :]
            np.maximum.at(most, text[: len(windows)][inside], windows[inside])
        return np.stack([mean, most], axis=1)

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(evidence @ self.slopes + self.shift, -700, 700)))


def _discount(counts: np.ndarray, weight: np.ndarray, total: float, shared: float) -> float:
    """The d for which sum(weight * min(counts, d)) = shared * total."""
    low, high = 0.0, float(counts.max())
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if (weight * np.minimum(counts, mid)).sum() < shared * total else (low, mid)
    return low


def _curve(evidence: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, float]:
    """Slopes and shift of a logistic curve: Newton's method with halved steps, a weak prior.

    Evidence never speaks against toxicity by growing: an input whose slope would be negative is left out."""
    slopes = np.zeros(evidence.shape[1])
    if not toxic.any() or toxic.all():
        return slopes, -50.0
    scale = np.maximum(evidence.std(axis=0), 1e-9)
    weight = np.full(len(toxic), min(len(toxic), 2000) / len(toxic))
    use = np.arange(len(slopes))
    while True:
        x = np.column_stack([evidence[:, use] / scale[use], np.ones(len(evidence))])
        w, prior = np.zeros(len(use) + 1), np.array([1e-2] * len(use) + [1e-4])

        def loss(w):
            z = x @ w
            return (weight * (np.logaddexp(0, z) - toxic * z)).sum() + (prior * w * w).sum() / 2

        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
            step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(prior), x.T @ (weight * (toxic - p)) - prior * w)
            now = loss(w)
            while loss(w + step) > now and np.abs(step).max() > 1e-9:
                step = step / 2
            w = w + step
            if np.abs(step).max() < 1e-8:
                break
        if (w[:-1] >= 0).all():
            slopes[use] = w[:-1] / scale[use]
            return slopes, float(w[-1])
        use = np.delete(use, np.argmin(w[:-1]))


class Counts:
    """Counts of a class pair: expressions (codes) with toxic and ordinary counts, and sums over their contexts.

    P(x | h) of class c = max(n_c(hx) - d_c, 0) / n_c(h) + m_c(h) * B(x | h'), m_c(h) = sum over x of min(n_c(hx), d_c) / n_c(h)
    where B is the backoff that both classes share, h' is h without its first byte, and m_c(h) = 1 for an h that c hasn't seen."""

    def __init__(self, codes, t, o, contexts, sums, discounts, tails, kinds):
        self.codes, self.counts = codes, np.stack([t, o]).astype(float)
        self.contexts, self.sums = contexts, sums  # n_t(h), n_o(h), discounted mass of t and of o
        self.discounts, self.backoff = discounts, Backoff(tails, kinds)

    def masses(self) -> np.ndarray:
        """m_c(h) of every context, a row for each class."""
        n = self.sums[:2]
        return np.where(n > 0, self.sums[2:] / np.maximum(n, 1), 1.0)

    def probabilities(self) -> np.ndarray:
        """P(x | h) of every code, a row for each class."""
        at = np.searchsorted(self.contexts, self.codes >> np.uint64(8))
        own = np.maximum(self.counts - np.array(self.discounts)[:, None], 0) / np.maximum(self.sums[:2][:, at], 1)
        return own + self.masses()[:, at] * self.shared()

    def shared(self) -> np.ndarray:
        return self.backoff(self.codes & np.uint64((1 << (8 * (ORDER - 1))) - 1))

    def model(self, slopes=np.zeros(2), shift=-50.0) -> Model:
        p, m = self.probabilities(), self.masses()
        return Model(self.codes, np.log(p[0] / p[1]), self.contexts, np.log(m[0] / m[1]), slopes, shift)

    def left_out(self):
        """A function (code, text, toxic of each text) -> the differences, with a text's own counts left out of its class."""
        shared = self.shared()

        def of(code, text, toxic):
            h = code >> np.uint64(8)
            less = np.stack([_own(code, text), _own(h, text)]) * np.where(toxic[text], 1, -1)
            at = np.minimum(np.searchsorted(self.contexts, h), len(self.contexts) - 1)
            here = np.searchsorted(self.codes, code)
            here = np.minimum(here, len(self.codes) - 1)
            known = self.codes[here] == code if len(self.codes) else np.zeros(len(code), dtype=bool)
            out = []
            for c, sign in ((0, 1), (1, -1)):
                mine = less * sign > 0
                n = self.sums[c][at] - np.where(mine[1], np.abs(less[1]), 0)
                left = np.where(n > 0, np.minimum(self.sums[2 + c][at] / np.maximum(n, 1), 1), 1.0)
                if not len(self.codes):
                    out.append(left)
                    continue
                own = np.maximum(self.counts[c][here] - np.where(mine[0], np.abs(less[0]), 0) - self.discounts[c], 0)
                # Where both discounted counts are 0, the shared backoff cancels.
                out.append(np.where(known, np.where(n > 0, np.minimum(own / np.maximum(n, 1), 1), 0) + left * shared[here], left))
            return np.log(out[0] / out[1])

        return of


class Backoff:
    """The shared distribution of a byte after the bytes before it: interpolated Kneser-Ney down to single bytes, from the
    number of different bytes before which an expression occurs in either class."""

    def __init__(self, tails: np.ndarray, kinds: np.ndarray, size: int = ORDER - 1, discount: float = 0.75):
        order = np.argsort(tails)
        self.codes, self.n, self.size, self.discount = np.asarray(tails, np.uint64)[order], np.asarray(kinds, float)[order], size, discount
        if size:
            self.contexts, first = np.unique(self.codes >> np.uint64(8), return_index=True)
            self.total = np.add.reduceat(self.n, first) if len(first) else np.zeros(0)
            self.varied = np.diff(np.append(first, len(self.codes))).astype(float)
            inner, lead = np.unique(self.codes & np.uint64((1 << (8 * (size - 1))) - 1), return_counts=True)
            self.lower = Backoff(inner, lead, size - 1, discount)

    def __call__(self, some: np.ndarray) -> np.ndarray:
        if not self.size:
            return np.full(len(some), 1 / 256)
        below = self.lower(some & np.uint64((1 << (8 * (self.size - 1))) - 1))
        if not len(self.codes):
            return below
        at = np.minimum(np.searchsorted(self.codes, some), len(self.codes) - 1)
        n = np.where(self.codes[at] == some, self.n[at], 0.0)
        h = np.minimum(np.searchsorted(self.contexts, some >> np.uint64(8)), len(self.contexts) - 1)
        seen = self.contexts[h] == some >> np.uint64(8)
        p = (np.maximum(n - self.discount, 0) + self.discount * self.varied[h] * below) / self.total[h]
        return np.where(seen, p, below)


def count(rows: DataFrame) -> DataFrame:
    """code, t, o: how often an expression occurs in toxic and in ordinary rows; rows has text, toxic."""

    def run(batches):
        held: list[tuple] = []

        def out():
            code, n = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            codes, back = np.unique(code, return_inverse=True)
            t, o = (np.bincount(back, weights=n * f, minlength=len(codes)).astype(np.int64) for f in (np.concatenate([h[2] for h in held]), ~np.concatenate([h[2] for h in held])))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(codes.astype(np.int64)), pa.array(t), pa.array(o)], names=["code", "t", "o"])

        for batch in batches:
            flags = column(batch, "toxic").to_numpy(zero_copy_only=False).astype(bool)
            for s in slabs(column(batch, "text")):
                code, text, _ = expressions(s)
                mark = flags[s.first : s.first + len(s)][text]
                for f in (True, False):
                    own, n = np.unique(code[mark == f], return_counts=True)
                    held.append((own, n, np.full(len(own), f)))
                if sum(len(h[0]) for h in held) > BLOCK:
                    yield out()
        if held:
            yield out()

    return written(rows.transform(mapped, run, "code long, t long, o long").groupBy("code").agg(F.sum("t").alias("t"), F.sum("o").alias("o")), "expressions")


def counts(counted: DataFrame, shared: float = SHARED) -> Counts | None:
    """None without any toxic or any ordinary expression.  An expression whose counts are not above the discounts, which are 1
    at least, is told by its context alone, so that the many that occur once stay on the workers."""
    discounts = []
    for c in ("t", "o"):
        got = counted.where(F.col(c) > 0).groupBy(c).agg(F.count(F.lit(1)).alias("k")).toArrow()
        n, k = got.column(c).to_numpy().astype(float), got.column("k").to_numpy().astype(float)
        if not len(n):
            return None
        discounts.append(max(_discount(n, k, float((n * k).sum()), shared), 1.0))
    table = counted.where((F.col("t") > discounts[0]) | (F.col("o") > discounts[1])).toArrow()
    left = [F.sum(F.least(F.col(c).cast("double"), F.lit(d))).alias(f"m{c}") for c, d in zip("to", discounts)]
    by = counted.groupBy(F.shiftright("code", 8).alias("h")).agg(F.sum("t").alias("t"), F.sum("o").alias("o"), *left).toArrow()
    tails = counted.groupBy(F.col("code").bitwiseAND(F.lit((1 << (8 * (ORDER - 1))) - 1)).alias("x")).agg(F.count(F.lit(1)).alias("n")).toArrow()
    get = lambda t, c: t.column(c).to_numpy()
    order, rank = np.argsort(get(by, "h")), np.argsort(get(table, "code"))
    sums = np.stack([get(by, c).astype(float)[order] for c in ("t", "o", "mt", "mo")])
    return Counts(get(table, "code").astype(np.uint64)[rank], get(table, "t")[rank], get(table, "o")[rank], get(by, "h").astype(np.uint64)[order], sums, discounts, get(tails, "x").astype(np.uint64), get(tails, "n"))


def fit(docs: DataFrame, labels: DataFrame, held_out, sample: int = SAMPLE) -> Model:
    """Learns from documents with a label whose id isn't held out (a boolean column over doc_id)."""
    spark = prepare(docs.sparkSession)
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.where(~held_out).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # At most ``sample`` rows of two numbers: a bounded broadcast.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", (F.col("toxic") > 0).alias("toxic"))
    found = counts(count(rows))
    if found is None:
        return Model()
    shared = spark.sparkContext.broadcast(found)

    def left_out(batches):
        of = shared.value.left_out()
        for batch in batches:
            flags = column(batch, "toxic").to_numpy(zero_copy_only=False).astype(bool)
            for s in slabs(column(batch, "text")):
                mark = flags[s.first : s.first + len(s)]
                x = Model().evidence(s, differences=lambda code, text, mark=mark: of(code, text, mark))
                yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1]), pa.array(mark)], names=["mean", "most", "toxic"])

    seen = rows.transform(mapped, left_out, "mean double, most double, toxic boolean").toArrow()
    x = np.stack([seen.column(c).to_numpy() for c in ("mean", "most")], axis=1)
    return found.model(*_curve(x, seen.column("toxic").to_numpy(zero_copy_only=False).astype(float)))


def held_out_thirds():
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1


def score(docs: DataFrame, model: Model, *keep: str, name: str = "score") -> DataFrame:
    """keep columns, and the probability that a text is toxic."""
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            x = [shared.value.probability(shared.value.evidence(s)) for s in slabs(column(batch, "text"))]
            yield pa.RecordBatch.from_arrays([*(column(batch, k) for k in keep), pa.array(np.concatenate([*x, np.zeros(0)]))], names=[*keep, name])

    kinds = "".join(f"`{k}` {docs.schema[k].dataType.simpleString()}, " for k in keep)
    return docs.select(*dict.fromkeys([*keep, "text"])).transform(mapped, run, f"{kinds}{name} double")


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    model = fit(docs, labels, held_out_thirds())
    held = F.coalesce(held_out_thirds(), F.lit(False))
    return score(docs, model, "doc_id").select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_civil(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that aren't predicted toxic, with their columns as they were."""
    model, name = fit(docs, labels, held_out_thirds()), free("score", docs.columns)
    return score(docs, model, *docs.columns, name=name).where(F.col(name) < THRESHOLD).drop(name)
