"""Toxic spans by a linear-chain conditional random field.

Training (driver, on a bounded sample). ``max_docs`` toxic and twice as many
clean labelled documents, chosen by a hash of the id, are fetched; texts beyond ``max_chars`` are
not used for training. Document labels become token labels: a token of a toxic
document is toxic if one of its features (word, prefixes) is tied to toxic
documents by a log-likelihood ratio of at least ``min_ratio``; all others are
clean. A two-tag chain is fitted to them by gradient ascent on its conditional
log-likelihood, with forward-backward on windows side by side.

Scoring (executors, every whole text, no shuffle). Tokens without a weighted
feature have the same emission everywhere, so the chain is moved across a run
of them by a closed-form power of the transition matrix and forward-backward
visits weighted tokens only; its marginals are those of the full chain. The
marginals' maximum and sum are calibrated to a document score by a logistic
fit on the sample, weighted to the labels' true class shares. Tokens with a
marginal of one half or more form the reported spans (character offsets).

Defined cases: null and empty texts get the score of a text without evidence;
without any training row, or with one class only, the score is the share of
toxic labels (0 without labels); a repeated label row counts once and of
contradictory ones the toxic one holds; repeated documents are scored alike; of
several texts with one id the least one trains; a null id is never held out;
extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"\w+")


def words_of(text: str) -> list[str]:
    """The words of a text in lower case, one for each match of ``WORD`` in the text itself."""
    low = text.lower()
    # lower() may lengthen a text, and what it adds need not belong to words
    return WORD.findall(low) if len(low) == len(text) else [w.lower() for w in WORD.findall(text)]


PREFIXES = (3, 4, 5, 6)


def features(word: str) -> list[str]:
    return [word, *(f"{word[:n]}^" for n in PREFIXES if len(word) > n)]


def fold_of(id_col: str) -> F.Column:
    """crc32 of the id as text, modulo 5; fold 0 is held out of training."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5))


@dataclass
class Chain:
    """Tag scores: ``weights`` and ``bias`` for the toxic tag, ``trans`` between tags, ``start`` of a text."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = 0.0
    trans: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    start: np.ndarray = field(default_factory=lambda: np.zeros(2))
    platt: np.ndarray = field(default_factory=lambda: np.zeros(3))
    prior: float | None = 0.0

    def emission(self, word: str) -> float:
        return sum(self.weights.get(f, 0.0) for f in features(word))


class _Scores(dict):
    """Emissions by word; emptied when it has grown large."""

    def __init__(self, chain: Chain):
        super().__init__()
        self.chain = chain

    def __missing__(self, word: str) -> float:
        if len(self) > 300_000:
            self.clear()
        self[word] = out = self.chain.emission(word)
        return out


def marginals(chain: Chain, at: np.ndarray, extra: np.ndarray, n: int) -> np.ndarray:
    """P(tag = toxic) of the tokens ``at`` (ascending) of ``n`` tokens; ``extra``: their emissions beyond the bias."""
    e = np.array([1.0, math.exp(chain.bias)])
    step = np.exp(chain.trans) * e[None, :]  # into a token without evidence
    values, right = np.linalg.eig(step)
    values, right = values.real, right.real
    values, left = values / values.max(), np.linalg.inv(right)

    def jump(k: int) -> np.ndarray:
        m = (right * values**k) @ left
        return m / m.max()

    boost = [np.array([1.0, math.exp(min(60.0, x))]) for x in extra.tolist()]
    forward, at_list = [], at.tolist()
    a = np.exp(chain.start) * e
    a, here = a / a.sum(), 0
    for i, p in enumerate(at_list):
        if p > here:
            a = a @ jump(p - here)
        a = a * boost[i]
        a, here = a / a.sum(), p
        forward.append(a)
    out = np.empty(len(at_list))
    b, here = np.ones(2), n - 1
    for i in range(len(at_list) - 1, -1, -1):
        p = at_list[i]
        if here > p:
            b = jump(here - p) @ b
        m = forward[i] * b
        out[i] = m[1] / m.sum()
        b, here = b * boost[i], p
        b = b / b.max()
    return out


def evidence(chain: Chain, scores: dict, text: str | None):
    """(token count, places and emissions of weighted tokens, their character spans)."""
    if not text:
        return 0, np.empty(0, int), np.empty(0), []
    words = words_of(text)
    got = np.fromiter(map(scores.__getitem__, words), float, len(words))
    at = np.flatnonzero(got)
    if not len(at):
        return len(words), at, got[at], []
    where = [m.span() for m in WORD.finditer(text)]
    return len(words), at, got[at], [where[i] for i in at.tolist()]


def read_spans(chain: Chain, scores: dict, text: str | None) -> tuple[float, float, list[tuple[int, int]]]:
    """(largest marginal, sum of marginals, toxic character spans) of one text."""
    n, at, extra, where = evidence(chain, scores, text)
    if not len(at):
        return 0.0, 0.0, []
    p = marginals(chain, at, extra, n)
    spans: list[list[int]] = []
    last = -2
    for i in np.flatnonzero(p >= 0.5).tolist():
        if at[i] == last + 1 and spans:
            spans[-1][1] = where[i][1]
        else:
            spans.append(list(where[i]))
        last = at[i]
    return float(p.max()), float(p.sum()), [tuple(s) for s in spans]


def score(chain: Chain, most: float, total: float) -> float:
    if chain.prior is not None:
        return chain.prior
    z = float(chain.platt @ np.array([1.0, most, math.log1p(total)]))
    return 1.0 / (1.0 + math.exp(-max(-60.0, min(60.0, z))))


# -- training ---------------------------------------------------------------


def _ratio(a: np.ndarray, b: np.ndarray, na: int, nb: int) -> np.ndarray:
    """Log-likelihood ratio (G squared) of document counts a of na against b of nb, for features commoner in a."""
    def term(k, n, p):
        p = np.clip(p, 1e-12, 1 - 1e-12)
        return k * np.log(p) + (n - k) * np.log(1 - p)

    p = (a + b) / (na + nb)
    g = 2 * (term(a, na, a / na) + term(b, nb, b / nb) - term(a, na, p) - term(b, nb, p))
    return np.where(a / na > b / nb, g, 0.0)


def _found(text: str) -> set[str]:
    return {f for w in set(words_of(text)) for f in features(w)}


def _presence(texts: list[str], least: int, only: set[str] | None = None) -> Counter:
    """In how many texts each feature occurs, of those in ``least`` texts or more; given ``only``, of those features alone.

    Features are counted by 64-bit hashes first, so a rare one takes eight bytes.
    """
    if only is None:
        hashes = [np.fromiter((xxhash.xxh3_64_intdigest(f) for f in _found(t)), np.uint64) for t in texts]
        value, count = np.unique(np.concatenate(hashes or [np.empty(0, np.uint64)]), return_counts=True)
        often = set(value[count >= least].tolist())
        c = Counter(f for t, h in zip(texts, hashes) if not often.isdisjoint(h.tolist()) for f in _found(t) if xxhash.xxh3_64_intdigest(f) in often)
    else:
        c = Counter(f for t in texts for f in _found(t) & only)
    return Counter({f: n for f, n in c.items() if n >= least})


def select_features(toxic: list[str], clean: list[str], min_ratio: float, min_odds: float = 3.0) -> list[str]:
    """Features tied to toxic texts; a prefix or word counts once in a text."""
    ca = _presence(toxic, 5)
    names = sorted(ca)
    if not names:
        return []
    cb = _presence(clean, 1, set(names))
    a, b = (np.array([c.get(f, 0) for f in names], float) for c in (ca, cb))
    min_ratio = max(min_ratio, 2 * math.log(len(names)))  # so many features are tried
    odds = np.log((a + 0.5) / (len(toxic) + 1)) - np.log((b + 0.5) / (len(clean) + 1))
    return [f for f, ok in zip(names, (_ratio(a, b, len(toxic), len(clean)) >= min_ratio) & (odds >= min_odds)) if ok]


def _windows(toxic: list[str], clean: list[str], number: dict[str, int], window: int):
    """Distinct training windows as (window, place, feature) triples, tags, lengths and how often each occurs.

    Without evidence, the first window stands for a text; windows of one length
    and the same evidence at the same places are one window with a weight.
    """
    seen: dict[tuple, int] = {}
    for bad, texts in ((1, toxic), (0, clean)):
        for text in texts:
            words = words_of(text)
            for i in range(0, len(words), window):
                part = tuple((j, number[f]) for j, w in enumerate(words[i : i + window]) for f in features(w) if f in number)
                if part or i == 0:
                    key = (bool(bad and part), min(window, len(words) - i), part)
                    seen[key] = seen.get(key, 0) + 1
    rows = np.array([r for r, (_, _, part) in enumerate(seen) for _ in part], int)
    cols, feats = (np.array([x[k] for _, _, part in seen for x in part], int) for k in (0, 1))
    y = np.zeros((len(seen), window), bool)
    bad = np.array([b for b, _, _ in seen], bool)
    y[rows, cols] = bad[rows]
    return rows, cols, feats, y, np.arange(window) < np.array([n for _, n, _ in seen])[:, None], np.array(list(seen.values()), float)


def fit_chain(toxic: list[str], clean: list[str], share: float, min_ratio: float = 15.0, window: int = 128, rounds: int = 40) -> Chain:
    """Fit the chain and its calibration; ``share``: the true share of toxic documents among the labels."""
    chosen = select_features(toxic, clean, min_ratio)
    if not chosen:
        return Chain(prior=share)
    rows, cols, feats, y, mask, times = _windows(toxic, clean, {f: i for i, f in enumerate(chosen)}, window)
    k, steps = y.shape
    total = times.sum()
    params = np.concatenate([np.full(len(chosen), 1.0), [-3.0], np.zeros(6)])
    m, v = np.zeros_like(params), np.zeros_like(params)
    prev, here, pairs = y[:, :-1], y[:, 1:], mask[:, 1:]
    seen = np.array([[(((prev == a) & (here == b) & pairs).sum(1) * times).sum() for b in (False, True)] for a in (False, True)], float)
    for r in range(1, rounds + 1):
        w, bias, trans, start = params[: len(chosen)], params[len(chosen)], params[-6:-2].reshape(2, 2), params[-2:]
        em = np.full((k, steps), bias)
        np.add.at(em, (rows, cols), w[feats])
        u = np.exp(np.clip(em, -40, 40)).T.copy()
        A = np.exp(trans)
        al = np.empty((steps, 2, k))
        a0, a1 = np.full(k, math.exp(start[0])), math.exp(start[1]) * u[0]
        for t in range(steps):
            if t:
                b0, b1 = a0 * A[0, 0] + a1 * A[1, 0], (a0 * A[0, 1] + a1 * A[1, 1]) * u[t]
                on = mask[:, t]
                a0, a1 = np.where(on, b0, a0), np.where(on, b1, a1)
            s = a0 + a1
            a0, a1 = a0 / s, a1 / s
            al[t] = a0, a1
        be0, be1, expected, p = np.ones(k), np.ones(k), np.zeros((2, 2)), np.empty((k, steps))
        for t in range(steps - 1, -1, -1):
            g1 = al[t, 1] * be1
            p[:, t] = g1 / (al[t, 0] * be0 + g1)
            if t:
                in0, in1 = be0, u[t] * be1
                c = np.stack([al[t - 1, 0] * A[0, 0] * in0, al[t - 1, 0] * A[0, 1] * in1, al[t - 1, 1] * A[1, 0] * in0, al[t - 1, 1] * A[1, 1] * in1])
                on = mask[:, t]
                expected += ((c / c.sum(0)) @ (times * on)).reshape(2, 2)
                x0, x1 = A[0, 0] * in0 + A[0, 1] * in1, A[1, 0] * in0 + A[1, 1] * in1
                s = x0 + x1
                be0, be1 = np.where(on, x0 / s, 1.0), np.where(on, x1 / s, 1.0)
        miss = (y - p) * mask * times[:, None]
        first = float(miss[:, 0].sum())
        grad = np.concatenate([np.bincount(feats, miss[rows, cols], len(chosen)), [miss.sum()], (seen - expected).ravel(), [-first, first]]) / total - 1e-3 * np.concatenate([w, np.zeros(7)])
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        params = params + 0.2 * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-8)
    w = params[: len(chosen)]
    chain = Chain({f: float(x) for f, x in zip(chosen, w) if abs(x) > 1e-6}, float(params[len(chosen)]), params[-6:-2].reshape(2, 2), params[-2:], prior=None)
    scores = _Scores(chain)
    got = [read_spans(chain, scores, t)[:2] for texts in (toxic, clean) for t in texts]
    x = np.array([[1.0, a, math.log1p(b)] for a, b in got])
    z = np.r_[np.ones(len(toxic)), np.zeros(len(clean))]
    weight = np.r_[np.full(len(toxic), share / len(toxic)), np.full(len(clean), (1 - share) / len(clean))]
    beta = np.zeros(3)
    for _ in range(50):  # Newton's method with a small ridge
        q = 1 / (1 + np.exp(-np.clip(x @ beta, -40, 40)))
        h = (x * (weight * q * (1 - q))[:, None]).T @ x + 1e-5 * np.eye(3)
        beta = beta + np.clip(np.linalg.solve(h, x.T @ (weight * (z - q)) - 1e-5 * beta), -4, 4)
    chain.platt = beta
    return chain


def train(docs: DataFrame, labels: DataFrame, max_docs: int = 2000, max_chars: int = 20_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Chain:
    """Fit on at most ``max_docs`` toxic and twice as many clean labelled documents, none of the held-out fold.

    Ids of the sample go to the driver (three times ``max_docs`` rows at most),
    are broadcast (that same bound) and pick their texts in one scan.
    """
    lab = labels.select(F.col(id_col).cast("long").alias("__id"), F.col(label_col).cast("int").alias("__y")).where(F.col("__id").isNotNull() & F.col("__y").isin(0, 1) & (fold_of("__id") != 0))
    lab = lab.groupBy("__id").agg(F.max("__y").alias("__y"))
    shares = dict(lab.groupBy("__y").count().collect())
    n = sum(shares.values())
    if not shares.get(0) or not shares.get(1):
        return Chain(prior=shares.get(1, 0) / n if n else 0.0)
    picked = [r for y in (0, 1) for r in lab.where(F.col("__y") == y).orderBy(F.xxhash64("__id"), "__id").limit(max_docs if y else 2 * max_docs).collect()]
    spark = docs.sparkSession
    sample = F.broadcast(spark.createDataFrame(picked, "__id long, __y int"))
    fetched = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").alias("__t")).where(F.col("__t").isNotNull() & (F.length("__t") <= max_chars)).join(sample, "__id").groupBy("__id").agg(F.first("__y").alias("__y"), F.min("__t").alias("__t")).select("__y", "__t").collect()
    fetched = sorted(set(map(tuple, fetched)))  # the fit doesn't depend on the order of arrival
    toxic, clean = ([t for y, t in fetched if y == c] for c in (1, 0))
    share = shares[1] / n
    if not toxic or not clean:
        return Chain(prior=share)
    return fit_chain(toxic, clean, share)


def score_documents(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, spans) of every whole text; spans are the offending character offsets."""
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    schema = pa.schema([(id_col, pa.int64()), ("score", pa.float64()), ("spans", spans)])

    def run(batches):
        scores = _Scores(chain)
        for b in batches:
            got = [read_spans(chain, scores, t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([score(chain, a, s) for a, s, _ in got], pa.float64()), pa.array([[{"start": x, "end": y} for x, y in w] for _, _, w in got], spans)], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` long, score double, spans array<struct<start: long, end: long>>")


def drop_toxic(docs: DataFrame, chain: Chain, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """Rows of ``docs``, all columns, whose score is under the threshold."""
    schema = docs.schema

    def run(batches):
        scores = _Scores(chain)
        for b in batches:
            texts = b.column(text_col).to_pylist()
            keep = [score(chain, *read_spans(chain, scores, t)[:2]) < threshold for t in texts]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, schema)
