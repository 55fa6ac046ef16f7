"""Mixing documents to target token weights of soft domains.

A softmax classifier learns domains from a labelled table (a bounded sample of
it) and gives every document a posterior over domains. With t_i tokens, rate
r_i >= 0 and posterior p_i, the expected tokens of a domain are the sum of
r_i t_i p_i; rates are fitted to the targets by projected-gradient least
squares. Residuals are weighted by 1 / (domain mass) and rates by their tokens,
so that the step is the same for every document: r <- max(0, r - p . g), with g
the scaled residual of the last round. A rate is thus a function of p and the
few vectors g so far; a round is one aggregation over the (tokens, posterior)
table, nothing of a document's size is shuffled, and any later pass recomputes
a document's rate from its text alone.

Rates become whole copies by a hash of the id: floor(rate), and one more with
the probability of the fraction, so expected totals match.

Defined cases: null and empty texts have one (closing) token; without labels,
or with one domain only, every target domain gets equal posteriors or the one
domain all; labels of other domains than the targets' are ignored; repeated
labels count once (largest name); of several texts with one id the least one
trains; repeated rows are treated alike; targets that no document can serve
leave a residual, which is returned, and the nearest rates; a fit that neither
meets its targets nor comes to rest is an error; an empty table gives an empty
result; extra columns pass through under any name.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


from .common import materialise
from .tokens import encode

#: domain of the labelled table -> share of all tokens wanted
TARGETS = {"0": 0.1, "1": 0.9}
PAIRS = 1024


def text_features(text: str | None) -> np.ndarray:
    """Square roots of the shares of bytes and of hashed byte pairs, and the log size; one vectorised pass over a text."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    one = np.bincount(raw, minlength=256)
    two = np.bincount((raw[:-1].astype(np.int32) * 31 + raw[1:] * 7) & (PAIRS - 1), minlength=PAIRS) if len(raw) > 1 else np.zeros(PAIRS)
    return np.concatenate([np.sqrt(one / max(1, len(raw))), np.sqrt(two / max(1, len(raw))), [np.log1p(len(raw)) / 10, 1.0]])


@dataclass
class Classifier:
    domains: list[str]
    weights: np.ndarray | None = None  # features x domains

    def posterior(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full((len(x), len(self.domains)), 1 / len(self.domains))
        z = x @ self.weights
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def fit_classifier(texts: list[str], labels: list[str], domains: list[str], shares: np.ndarray, rounds: int = 300) -> Classifier:
    """Softmax regression; documents are weighted to the domains' true ``shares``."""
    present = sorted(set(labels))
    if not present:
        return Classifier(domains)
    x = np.stack([text_features(t) for t in texts])
    y = np.array([domains.index(v) for v in labels])
    hot = np.eye(len(domains))[y]
    weight = (shares / np.maximum(1, hot.sum(0)))[y]
    weight = (weight / weight.sum())[:, None]
    w, m, v = (np.zeros((x.shape[1], len(domains))) for _ in range(3))
    model = Classifier(domains, w)
    for i in range(1, rounds + 1):
        g = x.T @ (weight * (model.posterior(x) - hot)) + 1e-6 * model.weights
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        model.weights = model.weights - 0.1 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-10)
    absent = [i for i, d in enumerate(domains) if d not in present]
    model.weights[:, absent] = 0
    model.weights[-1, absent] = -60.0
    return model


def train_classifier(docs: DataFrame, labels: DataFrame, domains: list[str], domain_col: str = "quality", max_docs: int = 2000, max_chars: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> Classifier:
    """Fit on at most ``max_docs`` labelled documents of each domain, of at most ``max_chars`` characters."""
    lab = labels.select(F.col(id_col).cast("long").alias("__id"), F.col(domain_col).cast("string").alias("__y")).where(F.col("__id").isNotNull() & F.col("__y").isin(*domains))
    lab = lab.groupBy("__id").agg(F.max("__y").alias("__y"))
    counts = dict(lab.groupBy("__y").count().collect())  # one row for each target domain at most
    if not counts:
        return Classifier(domains)
    picked = [r for d in domains for r in lab.where(F.col("__y") == d).orderBy(F.xxhash64("__id"), "__id").limit(max_docs).collect()]
    sample = F.broadcast(docs.sparkSession.createDataFrame(picked, "__id long, __y string"))  # max_docs rows for each domain at most
    found = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").alias("__t")).where(F.col("__t").isNotNull() & (F.length("__t") <= max_chars)).join(sample, "__id").groupBy("__id").agg(F.first("__y").alias("__y"), F.min("__t").alias("__t")).select("__y", "__t").collect()
    found = sorted(set(map(tuple, found)))
    shares = np.array([counts.get(d, 0) for d in domains], float) / sum(counts.values())
    return fit_classifier([t for _, t in found], [y for y, _ in found], domains, shares)


@dataclass
class Mixture:
    """Everything a document's rate depends on, besides its text."""

    classifier: Classifier
    steps: list[list[float]] = field(default_factory=list)
    targets: list[float] = field(default_factory=list)
    totals: list[float] = field(default_factory=list)

    @property
    def residual(self) -> float:
        """How far the expected totals are from the targets, as a share of the budget."""
        return sum(abs(a - b) for a, b in zip(self.totals, self.targets)) / max(1e-300, sum(self.targets))

    def rates(self, posterior: np.ndarray) -> np.ndarray:
        r = np.ones(len(posterior))
        for g in self.steps:
            r = np.maximum(0.0, r - posterior @ np.array(g))
        return r


def _describe(docs: DataFrame, model: Classifier, id_col: str, text_col: str) -> DataFrame:
    """(id, tokens, posterior) of each row."""
    schema = pa.schema([(id_col, pa.int64()), ("tokens", pa.int64()), ("posterior", pa.list_(pa.float64()))])

    def run(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            for i in range(0, len(texts), 512):
                part = texts[i : i + 512]
                p = model.posterior(np.stack([text_features(t) for t in part]))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, len(part)), pa.array([len(encode(t)) + 1 for t in part], pa.int64()), pa.array(list(p), pa.list_(pa.float64()))], schema=schema)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` long, tokens long, posterior array<double>")


def _rate(steps: list[list[float]], k: int) -> F.Column:
    """The rate of a row as a JVM expression of its posterior."""
    if not steps:
        return F.lit(1.0)
    history = F.array(*[F.array(*map(F.lit, g)) for g in steps])
    dot = lambda g: sum((g[i] * F.col("posterior")[i] for i in range(1, k)), g[0] * F.col("posterior")[0])
    return F.aggregate(history, F.lit(1.0), lambda r, g: F.greatest(F.lit(0.0), r - dot(g)))


def fit_rates(described: DataFrame, model: Classifier, targets: dict[str, float], budget: float | None = None, max_rounds: int = 200, tolerance: float = 1e-4) -> Mixture:
    """Projected gradient on the rates until the residual is under ``tolerance`` of the budget, or stays where it is.

    Raises RuntimeError if ``max_rounds`` bring neither.
    """
    k = len(model.domains)
    p = [F.col("posterior")[i] for i in range(k)]
    t = F.col("tokens").cast("double")
    first = described.agg(F.sum(t).alias("t"), *[F.sum(t * p[i] * p[j]).alias(f"m{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    total = float(first["t"] or 0)
    wanted = np.array([targets[d] for d in model.domains], float)
    wanted = wanted / wanted.sum() * (total if budget is None else budget)
    out = Mixture(model, [], wanted.tolist(), [])
    if not total:
        return out
    mass = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            mass[i, j] = mass[j, i] = first[f"m{i}_{j}"]
    scale = 1 / np.maximum(np.diag(mass), 1e-9 * total)
    root = np.sqrt(scale)
    step = 1 / np.linalg.eigvalsh(root[:, None] * mass * root[None, :]).max()
    best, still = np.inf, 0
    for _ in range(max_rounds):
        got = described.select((_rate(out.steps, k) * t).alias("w"), *[x.alias(f"p{i}") for i, x in enumerate(p)]).agg(*[F.sum(F.col("w") * F.col(f"p{i}")).alias(f"s{i}") for i in range(k)]).first()
        out.totals = [float(got[f"s{i}"]) for i in range(k)]
        gap = np.array(out.totals) - wanted
        loss = float(gap @ (scale * gap))
        still = still + 1 if loss > best * (1 - 1e-3) else 0
        if out.residual <= tolerance or still >= 3:  # met, or at the nearest point: the weighted squares fall no further
            return out
        best = min(best, loss)
        out.steps.append((step * scale * gap).tolist())
    raise RuntimeError(f"the rates did not settle in {max_rounds} rounds; residual {out.residual:.2g} of the budget")


def _chance(key: F.Column) -> F.Column:
    """A number from 0 to 1 that depends on the id alone."""
    return F.pmod(F.xxhash64(F.lit(6), key), F.lit(1 << 52)) / F.lit(float(1 << 52))


def _copies(rate: F.Column, key: F.Column) -> F.Column:
    """floor(rate), and one more with the probability of the fraction."""
    u = _chance(key)
    return (F.floor(rate) + (u < rate - F.floor(rate)).cast("long")).cast("int")


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, budget: float | None = None, domain_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Mixture]:
    """((id, tokens, posterior, rate, residual, copies), the fitted mixture); the residual is that of the whole fit."""
    if not targets or any(v < 0 for v in targets.values()) or not sum(targets.values()):
        raise ValueError("targets must be nonnegative shares, not all zero")
    domains = sorted(targets)
    model = train_classifier(docs, labels, domains, domain_col, id_col=id_col, text_col=text_col)
    described = materialise(_describe(docs, model, id_col, text_col), "mixing-described")
    fitted = fit_rates(described, model, targets, budget)
    rated = described.withColumn("rate", _rate(fitted.steps, len(domains))).withColumn("residual", F.lit(fitted.residual if fitted.totals else 0.0))
    return rated.withColumn("copies", _copies(F.col("rate"), F.col(id_col))), fitted


def apply_mixture(docs: DataFrame, fitted: Mixture, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every row as many times as its copies; one pass over the texts, no shuffle."""
    names = docs.columns
    # the caller's columns travel in a struct, so no name of theirs can clash
    plain = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), _chance(F.col(f"`{id_col}`").cast("long")).alias("u"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches):
        for b in batches:
            p = fitted.classifier.posterior(np.stack([text_features(t) for t in b.column(2).to_pylist()])) if b.num_rows else np.empty((0, len(fitted.classifier.domains)))
            rates = fitted.rates(p)
            u = b.column(1).to_numpy(zero_copy_only=False)
            copies = (np.floor(rates) + (u < rates - np.floor(rates))).astype(np.int64)
            kept = b.column(0).take(pa.array(np.repeat(np.arange(b.num_rows), copies)))
            yield pa.RecordBatch.from_arrays(kept.flatten(), names=names)

    return plain.mapInArrow(run, docs.schema)
