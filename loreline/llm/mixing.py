"""Mixing sources to target weights by soft membership.

1. A softmax classifier, fitted on a bounded labelled sample of hashed word shares, predicts each text's domain posteriors p (a map over
   all texts, no shuffle).
2. Document rates r >= 0 are fitted so that the expected tokens of every domain, sum of r * n_words * p[k], meet the targets: projected
   gradient on least squares, distributed. A step needs one aggregate of a few numbers a domain over all rows; the rates themselves
   never leave the executors. Rates start at 1 and distance between rates is weighted by tokens, so that a long text's rate moves
   no further than a short one's of the same posterior; residuals are measured in the metric of the (domains x domains) moment
   matrix, which needs few steps whatever the domains' sizes.

Only rows of posteriors (no texts) are written to the checkpoint folder between steps.

Defined cases: null or empty text has no tokens and gets the rate of the classifier's prior; null ids and repeated rows are fitted like others; rows
without a label are not used in training; of conflicting labels of an id the largest counts; a domain in the targets that has no
labelled text gets posterior 0 (its target cannot be met, which ``achieved`` shows and a warning says); columns of ``keep`` may be called
like a result column's source (id, p, text), and other columns are ignored; targets are normalised to sum 1; an empty table gives an empty result.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loreline.llm import _linear as L
from loreline.llm import _text as X
from loreline.llm._frames import checkpoint, col, discard
from loreline.llm._sample import take, telling

DIMS = 1 << 15
EFFECT = 0.15  # correlation of a feature with a domain from which it tells it
SAMPLE = 8_000  # labelled texts the classifier is fitted on, at most
STEPS = 100  # at most; steps end when the targets are met, or when a step no longer brings them nearer


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, domains: list[str], sample: int = SAMPLE, dims: int = DIMS) -> np.ndarray:
    """Softmax weights (dims, domains); a domain without labelled texts gets the lowest score everywhere."""
    got = take(docs, labels, id_col, text_col, label_col, sample, dims, lambda names, df, n: telling(df, n, max(4.0, EFFECT * float(n.sum()) ** 0.5)))
    w = np.zeros((dims + 1, len(domains)))
    use = np.isin(got.names, domains)[got.y] & (got.words > 0) if got.names else np.zeros(0, bool)
    if not use.any():
        return w
    y = np.array([domains.index(k) if k in domains else -1 for k in got.names])[got.y[use]]
    seen = np.bincount(y, minlength=len(domains)) > 0
    rows = got.rows(got.times / (2.0 * np.repeat(np.maximum(got.words, 1), np.diff(got.first))), use, dims)
    hot = np.zeros((len(y), len(domains)))
    hot[np.arange(len(y)), y] = 1
    balance = (1 / np.maximum(np.bincount(y, minlength=len(domains)), 1))[y]
    balance /= balance.sum()

    def gradient(w):
        z = np.stack([rows.times(w[:-1, k]) for k in range(len(domains))], axis=1) + w[-1]
        z[:, ~seen] = -1e9
        g = (softmax(z) - hot) * balance[:, None]
        return np.concatenate([np.stack([rows.back(g[:, k]) for k in range(len(domains))], axis=1), g.sum(axis=0, keepdims=True)]) + 1e-7 * w

    w = L.adam(gradient, w, 60, 1.0)
    w[-1, ~seen] = -1e9
    return w


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def posteriors(docs: DataFrame, weights: np.ndarray, id_col: str, text_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per text: id, k0.. (the columns of ``keep``), n_words, p (posterior of each domain)."""
    model = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))  # a fixed size
    held = ["text" if k == text_col else f"k{i}" for i, k in enumerate(keep)]  # the text goes to Python once
    named = docs.select(col(id_col).cast("long").alias("id"), *[col(k).alias(h) for k, h in zip(keep, held) if h != "text"], col(text_col).alias("text"))

    def run(batches):
        w = model.value
        for b in X.slices(batches, "text"):
            f = L.Features(b.column("text"), len(w) - 1, share=True)
            p = softmax(f.dot(w[:-1]) + w[-1])
            yield pa.record_batch({"id": b.column("id")} | {h: b.column(h) for h in held} | {"n_words": pa.array(f.n_words), "p": pa.array(list(p), pa.list_(pa.float64()))})

    return named.mapInArrow(run, T.StructType([T.StructField("id", T.LongType()), *[T.StructField(h, docs.schema[k].dataType) for k, h in zip(keep, held)], T.StructField("n_words", T.LongType()), T.StructField("p", T.ArrayType(T.DoubleType()))]))


def _parts(k: int) -> list:
    return [F.coalesce(F.col("p")[i], F.lit(0.0)) for i in range(k)]


def fit_rates(rows: DataFrame, targets: list[float], steps: int = STEPS, tolerance: float = 1e-4) -> tuple[list[np.ndarray], np.ndarray]:
    """Projected gradient over rows of (n_words, p). Returns the moves, which give any row's rate (``rate_of``), and the achieved tokens of
    each domain, as shares of the goal's total.

    The driver gets domains**2 numbers once and ``domains`` numbers a step.
    """
    k = len(targets)
    p = _parts(k)
    a = [F.col("n_words") * x for x in p]  # expected tokens of each domain
    first = rows.agg(F.sum("n_words"), *[F.sum(x) for x in a], *[F.sum(a[i] * p[j]) for i in range(k) for j in range(i, k)]).first()
    total = float(first[0] or 0)
    goal = total * np.asarray(targets) / max(sum(targets), 1e-12)
    have = np.array([float(x or 0) for x in first[1:k + 1]])
    moment = np.zeros((k, k))
    moment[np.triu_indices(k)] = [float(x or 0) for x in first[k + 1:]]
    moment = moment + np.triu(moment, 1).T
    scale = max(np.trace(moment) / k, 1e-12)
    metric = np.linalg.pinv(moment + 1e-6 * scale * np.eye(k))  # in this metric a gradient step goes nearly all the way
    moves: list[np.ndarray] = []
    gap = have - goal
    for _ in range(steps):
        if not total or np.abs(gap).max() <= tolerance * total:
            break
        step = [*moves, metric @ gap]
        now = np.array([float(x or 0) for x in rows.agg(*[F.sum(x * rate_of(step, k)) for x in a]).first()])
        if np.abs(now - goal).max() > 0.99 * np.abs(gap).max():
            break  # as near as rates of 0 and more can come
        moves, have, gap = step, now, now - goal
    return moves, have / max(total, 1e-12)


def rate_of(moves: list[np.ndarray], k: int):
    """A row's rate: from 1, minus each move along its posterior, held at 0 or more."""
    rate = F.lit(1.0)
    for move in moves:
        rate = F.greatest(F.lit(0.0), rate - sum((x * F.lit(float(m)) for x, m in zip(_parts(k), move)), F.lit(0.0)))
    return rate


@dataclass
class Mixture:
    """Documents with their rates, and each domain's target and achieved share of the tokens; ``met``: all within ``TOLERANCE``."""

    frame: DataFrame
    domains: list[str]
    target: list[float]
    achieved: list[float]
    met: bool


TOLERANCE = 1e-3


def mixture_of(docs: DataFrame, labels: DataFrame, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", sample: int = SAMPLE, keep: tuple[str, ...] = ()) -> Mixture:
    """``labels`` holds (id, label_col). ``copies`` rounds the rate by a hash of the id, so that its mean is the rate. With ``keep`` the
    posteriors are worked out again for the result, so that no text is written to the checkpoint folder.
    """
    domains = sorted(targets)
    weights = train(docs, labels, id_col, text_col, label_col, domains, sample)
    rows = checkpoint(posteriors(docs, weights, id_col, text_col))
    moves, achieved = fit_rates(rows, [targets[d] for d in domains])
    if keep:
        discard(rows)
        rows = posteriors(docs, weights, id_col, text_col, keep)
    held = [F.col("text" if k == text_col else f"k{i}").alias(k) for i, k in enumerate(keep)]
    best = F.array_position("p", F.array_max("p")).cast("int")
    chance = F.pmod(F.xxhash64(F.col("id"), F.lit(17)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    out = rows.withColumn("rate", rate_of(moves, len(domains)))
    copies = (F.floor("rate") + (chance < F.col("rate") - F.floor("rate")).cast("long")).alias("copies")
    of = lambda values: F.element_at(F.array(*[F.lit(x) for x in values]), best)
    frame = out.select(F.col("id").alias(id_col), *held, "n_words", of(domains).alias("domain"), F.col("p").alias("posterior"), "rate", copies, of([float(x) for x in achieved]).alias("achieved"))
    target = [targets[d] / max(sum(targets.values()), 1e-12) for d in domains]
    return Mixture(frame, domains, target, [float(x) for x in achieved], not achieved.any() or bool(np.abs(achieved - target).max() <= TOLERANCE))


def mix_sources(docs: DataFrame, labels: DataFrame, targets: dict[str, float], **options) -> DataFrame:
    """Per text: id, the columns of ``keep``, n_words, domain (likeliest), posterior (in the order of sorted target names), rate, copies,
    achieved (share of the tokens that the domain gets). Warns if rates of 0 and more cannot meet the targets; see ``mixture_of``."""
    mix = mixture_of(docs, labels, targets, **options)
    if not mix.met:
        warnings.warn(f"targets not met: wanted {dict(zip(mix.domains, mix.target))}, achieved {dict(zip(mix.domains, mix.achieved))}", stacklevel=2)
    return mix.frame


# The language mixture the mixing query and the pipeline aim at (shares of words).
LANG_TARGETS = {"de": 0.2, "en": 0.4, "es": 0.2, "fr": 0.2}


def lang_labels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Domain labels of the labelled documents: their language."""
    return docs.select("doc_id", "lang").join(labels.select("doc_id"), "doc_id", "left_semi")
