"""Toxicity severity by cumulative-link ordinal regression on sparse text features.

P(grade > k) = sigmoid(w . x - theta_k): one weight vector is shared by all thresholds theta_1 <= theta_2 <= ...; the result is the
expected grade. x holds the presence of hashed words and word prefixes. The model is fitted on a bounded sample of labelled texts
(``sample`` rows, the ones with the smallest id hash); scoring is a map over all texts without a shuffle.

Labels may be grades themselves (any label above 1). Labels of 0 and 1 are graded before fitting: 0 is clean; toxic texts get
1 .. grades - 1 by how often the words stand in them that the sample shows to mark toxic texts (quantiles among its toxic texts), so
there severity above the threshold of toxicity is learned from a derived word list, not from people's grades.

Labelled texts are often picked for being toxic, so their share is not that of all texts. Where it is above ``prior``, all thresholds are
moved by the difference of the two log-odds: a text that tells nothing is then toxic with a chance of ``prior``, below one half.

Defined cases: null or empty text, and one without known features, gets the base severity and grade 0 at any share of toxic labels; null ids and repeated rows are scored like others; null
labels are not used; of conflicting labels of an id the largest counts, of several texts of a labelled id one is fitted on; without
labels of both kinds the severity is 0; other columns pass only if named in ``keep``, even those called like a result column.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loreline.llm import _linear as L
from loreline.llm import _text as X
from loreline.llm._frames import col
from loreline.llm._sample import Sample, take, telling

DIMS = 1 << 18
SAMPLE = 24_000  # labelled texts the model is fitted on, at most
GRADES = 3
PRIOR = 0.25  # largest share of toxic texts that is assumed of all texts


def marks(df: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Mask of cells that mark toxic texts: df and n by (clean, toxic)."""
    lift = np.log((df[1] + 0.5) / max(1, n[1])) - np.log((df[0] + 0.5) / max(1, n[0]))
    return (df[1] >= 3) & (lift >= 2.5)


def _two(by_label: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Counts by (clean, toxic) from counts by label."""
    return np.stack([by_label[~toxic].sum(axis=0), by_label[toxic].sum(axis=0)])


def grades_of(got: Sample, toxic: np.ndarray, grades: int) -> np.ndarray:
    """Grade of every text of a sample. Labels above 1 are grades themselves (at most grades - 1). Of 0/1 labels, 0 is clean and toxic
    texts get quantiles of the times that marked words stand in them."""
    value = np.array([float(k) for k in got.names])
    if value.max(initial=0) > 1:
        return np.clip(value, 0, grades - 1).astype(int)[got.y]
    is_mark = np.zeros(max(got.told.max(initial=0) + 1, 1), bool)
    is_mark[got.told] = marks(_two(got.df, toxic), _two(got.per_class(), toxic))
    row = np.repeat(np.arange(len(got.y)), np.diff(got.first))
    count = np.bincount(row, got.times * is_mark[got.cell], len(got.y))
    out = np.zeros(len(got.y), int)
    at = np.flatnonzero(toxic[got.y])
    if len(at):
        cuts = np.quantile(count[at], np.arange(1, grades - 1) / (grades - 1)) if grades > 2 else []
        out[at] = 1 + np.searchsorted(cuts, count[at], "left")
    return out


def fit(rows: L.Rows, y: np.ndarray, grades: int, steps: int = 150, rate: float = 0.08, penalty: float = 3e-5) -> tuple[np.ndarray, np.ndarray]:
    """Maximum likelihood of the cumulative-link model with a ridge penalty. Returns weights and ordered thresholds.

    The thresholds are theta_1 + cumulated exp(steps), so they stay ordered.
    """
    k = grades - 1
    high = np.stack([(y > j).mean() for j in range(k)])
    base = -np.log(np.clip(high, 1e-4, 1 - 1e-4) / (1 - np.clip(high, 1e-4, 1 - 1e-4)))
    start = np.concatenate([np.zeros(rows.dims), base[:1], np.log(np.maximum(np.diff(base), 0.05))])

    def thetas(p):
        return np.cumsum(np.concatenate([p[rows.dims:rows.dims + 1], np.exp(p[rows.dims + 1:])]))

    def gradient(p):
        w, th = p[:rows.dims], thetas(p)
        score = rows.times(w)
        edge = np.concatenate([np.full((rows.n, 1), np.inf), score[:, None] - th[None, :], np.full((rows.n, 1), -np.inf)], axis=1)
        above = np.where(np.isposinf(edge), 1.0, np.where(np.isneginf(edge), 0.0, L.sigmoid(edge)))
        at = np.arange(rows.n)
        prob = np.maximum(above[at, y] - above[at, y + 1], 1e-9)
        slope = above * (1 - above)
        g_score = -(slope[at, y] - slope[at, y + 1]) / prob / rows.n
        g_theta = np.zeros(k)
        np.add.at(g_theta, np.clip(y - 1, 0, k - 1), np.where(y > 0, slope[at, y] / prob / rows.n, 0))
        np.add.at(g_theta, np.clip(y, 0, k - 1), np.where(y < k, -slope[at, y + 1] / prob / rows.n, 0))
        tail = np.cumsum(g_theta[::-1])[::-1]
        return np.concatenate([rows.back(g_score) + penalty * w, tail[:1], tail[1:] * np.exp(p[rows.dims + 1:])])

    p = L.adam(gradient, start, steps, rate)
    return p[:rows.dims], thetas(p)


def _toxic(names: list[str]) -> np.ndarray:
    return np.array([float(k) > 0 for k in names], bool)


def _pick(names: list[str], df: np.ndarray, n: np.ndarray) -> np.ndarray:
    two, n2 = _two(df, _toxic(names)), _two(n, _toxic(names))
    return telling(two, n2) | marks(two, n2)


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, grades: int, sample: int, dims: int, prior: float = PRIOR):
    got = take(docs, labels, id_col, text_col, label_col, sample, dims, _pick)
    toxic = _toxic(got.names)
    if toxic.all() or not toxic.any():  # no labels, or of one kind only
        return np.zeros(dims, np.float32), np.full(grades - 1, 40.0)
    use = np.zeros(dims, bool)
    use[got.told[telling(_two(got.df, toxic), _two(got.per_class(), toxic))]] = True
    rows = got.rows(use[got.cell].astype(float), np.ones(len(got.y), bool), dims)
    w, th = fit(rows, grades_of(got, toxic, grades), grades)
    odds = lambda p: np.log(p / (1 - p))
    return w.astype(np.float32), th + max(0.0, odds(toxic[got.y].mean()) - odds(prior))


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", grades: int = GRADES, sample: int = SAMPLE, dims: int = DIMS, keep: tuple[str, ...] = (), prior: float = PRIOR) -> DataFrame:
    """Per text: id, the columns of ``keep``, severity (expected grade, 0 .. grades - 1), grade (most severe one that is likelier than not), toxic (grade >= 1)."""
    w, th = train(docs, labels, id_col, text_col, label_col, grades, sample, dims, prior)
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast((w, th))  # dims weights: a fixed size
    held = ["text" if k == text_col else f"k{i}" for i, k in enumerate(keep)]  # the text goes to Python once
    named = docs.select(col(id_col).cast("long").alias("id"), *[col(k).alias(h) for k, h in zip(keep, held) if h != "text"], col(text_col).alias("text"))

    def run(batches):
        w, th = model.value
        for b in X.slices(batches, "text"):
            f = L.Features(b.column("text"), len(w), share=False)
            above = L.sigmoid(f.dot(w)[:, None] - th[None, :])
            high = (above >= 0.5).sum(axis=1)
            yield pa.record_batch({"id": b.column("id")} | {h: b.column(h) for h in held} | {"severity": pa.array(above.sum(axis=1)), "grade": pa.array(high.astype(np.int32)), "toxic": pa.array(high > 0)})

    schema = T.StructType([T.StructField("id", T.LongType()), *[T.StructField(h, docs.schema[k].dataType) for k, h in zip(keep, held)], T.StructField("severity", T.DoubleType()), T.StructField("grade", T.IntegerType()), T.StructField("toxic", T.BooleanType())])
    return named.mapInArrow(run, schema).select(F.col("id").alias(id_col), *[F.col(h).alias(k) for k, h in zip(keep, held)], "severity", "grade", "toxic")
