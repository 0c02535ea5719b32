"""Quality classifier: histogram gradient-boosted trees over document statistics, flattened into arrays.

Every text becomes ``len(NAMES)`` statistics, computed for whole Arrow batches at once. Trees are grown level by level from binned
statistics on a bounded sample of labelled texts (``sample`` rows with the smallest id hash) and stored as flat arrays (feature,
threshold, children, value); scoring walks all texts of a batch down one tree at a time with array lookups. Scoring is a map without
a shuffle.

Defined cases: null and empty texts get the score of their (empty) statistics; null ids and repeated rows are scored like others;
null labels are not used; of conflicting labels of an id the largest counts, of several texts of a labelled id one is fitted on; with labels of one kind every score is the share of label 1 (0.5 without labels); other columns pass only if
named in ``keep``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loreline.llm import _text as X
from loreline.llm._frames import col
from loreline.llm._sample import labelled

NAMES = ("bytes", "words", "mean_word", "sd_word", "longest_word", "upper", "digit", "punct", "space", "wide", "exclaim", "rare_punct", "pipe", "stop_end", "lines", "words_per_line", "short_lines", "repeat_lines", "distinct_words", "top_word", "repeat_pairs", "repeat_shingles", "title_words", "upper_words", "mark_words", "entropy", "comma", "sentence")
SAMPLE = 20_000
TREES, DEPTH, BINS, RATE = 80, 4, 64, 0.15

_CLASS = np.zeros((256, 9), np.float32)
_CLASS[[*range(65, 91)], 0] = 1
_CLASS[[*range(48, 58)], 1] = 1
_CLASS[[c for c in range(33, 127) if not chr(c).isalnum()], 2] = 1
_CLASS[[9, 10, 11, 12, 13, 32], 3] = 1
_CLASS[128:, 4] = 1
_CLASS[ord("!"), 5] = 1
_CLASS[[ord(c) for c in "#$%&*+/<=>@\\^_`{}~"], 6] = 1
_CLASS[ord("|"), 7] = 1
_CLASS[ord(","), 8] = 1
_INK = np.arange(256) > 32
_STOP = np.isin(np.arange(256), [ord(c) for c in ".!?"])
_UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
_ALNUM = ~X.NOT_ALNUM


def _top_and_distinct(key: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Share of distinct values, and largest share of one value, in each text."""
    total = np.maximum(np.bincount(text, minlength=n), 1)
    order = np.lexsort((key, text))
    k, t = key[order], text[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (t[1:] != t[:-1])
    begin = np.flatnonzero(new)
    times = np.diff(np.append(begin, len(k)))
    top = np.zeros(n)
    np.maximum.at(top, t[begin], times)
    return np.bincount(t[begin], minlength=n) / total, top / total


def statistics(column) -> np.ndarray:
    """One row of NAMES for each text."""
    data, offsets = X.bytes_of(column)
    n = len(offsets) - 1
    size = np.diff(offsets)
    text_of = np.repeat(np.arange(n), size)
    # counts of byte classes by way of a histogram of bytes for each text
    hist = np.bincount(text_of * 256 + data, minlength=n * 256).reshape(n, 256).astype(np.float32) if len(data) else np.zeros((n, 256), np.float32)
    per_byte = hist @ _CLASS / np.maximum(size, 1)[:, None]
    p = hist / np.maximum(size, 1)[:, None]
    entropy = -(p * np.log2(np.maximum(p, 1e-9))).sum(axis=1)
    words = X.split_words(data, offsets)
    length = (words.end - words.start).astype(float)
    count = np.diff(words.first).astype(float)
    many = np.maximum(count, 1)
    mean = np.bincount(words.text, length, n) / many
    sd = np.sqrt(np.maximum(np.bincount(words.text, length**2, n) / many - mean**2, 0))
    longest = np.zeros(n)
    np.maximum.at(longest, words.text, length)
    by = lambda mask: np.bincount(words.text[mask], minlength=n) / many
    head = data[words.start] if len(words.start) else np.zeros(0, np.uint8)
    tail = data[words.end - 1] if len(words.start) else head
    second = data[np.minimum(words.start + 1, max(len(data) - 1, 0))] if len(words.start) else head
    lines_space = np.zeros(256, bool)
    lines_space[[10, 13]] = True
    lines = X.split_words(data, offsets, lines_space)
    n_lines = np.maximum(np.diff(lines.first), 1).astype(float)
    short = np.bincount(lines.text[(lines.end - lines.start) < 30], minlength=n) / n_lines
    hashes = X.hash_words(data, words, X.LOWER)
    distinct, top = _top_and_distinct(hashes, words.text, n)

    def repeated(width):
        value = X.roll(hashes, width)
        ok = words.text[:len(value)] == words.text[width - 1:] if len(value) else np.zeros(0, bool)
        return 1 - _top_and_distinct(value[ok], words.text[:len(value)][ok], n)[0] if len(value) else np.ones(n)

    line_distinct, _ = _top_and_distinct(X.hash_words(data, lines), lines.text, n)
    out = np.stack([np.log1p(size), np.log1p(count), mean, sd, longest, *per_byte.T[:8], by(_STOP[tail]), n_lines, count / n_lines, short, 1 - line_distinct, distinct, top, repeated(2), repeated(5), by(_UPPER[head]), by(_UPPER[head] & _UPPER[second]), by(~_ALNUM[tail]), entropy, per_byte[:, 8], count / np.maximum(np.bincount(words.text[_STOP[tail]], minlength=n), 1)], axis=1)
    return out.astype(np.float32)


class Trees:
    """Boosted trees as flat arrays of shape (trees, nodes); a leaf points to itself."""

    def __init__(self, bias: float, feature: np.ndarray, threshold: np.ndarray, left: np.ndarray, value: np.ndarray, depth: int):
        self.bias, self.feature, self.threshold, self.left, self.value, self.depth = bias, feature, threshold, left, value, depth

    def logit(self, x: np.ndarray) -> np.ndarray:
        row = np.arange(len(x))
        out = np.full(len(x), self.bias)
        for f, t, left, v in zip(self.feature, self.threshold, self.left, self.value):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = np.where(left[at] > 0, left[at] + (x[row, f[at]] > t[at]), at)
            out += v[at]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -40, 40)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE, ridge: float = 1.0, least: int = 8) -> Trees:
    """Boosting with logistic loss; splits come from histograms of gradients by bin, second-order gain."""
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins)[1:-1])) for j in range(width)] if n else [np.zeros(0)] * width
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1) if n else np.zeros((0, width), int)
    flat = binned + np.arange(width) * bins
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if n else 0.5
    bias = float(np.log(share / (1 - share)))
    size = 2 ** (depth + 1) - 1
    out = [np.zeros((trees, size), t) for t in (np.int32, np.float32, np.int32, float)]
    score = np.full(n, bias)
    for k in range(trees if n and 0 < y.mean() < 1 else 0):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        feature, threshold, left, value = (o[k] for o in out)
        node = np.zeros(n, np.int64)
        level, fresh = [0], 1
        for d in range(depth + 1):
            new_level = []
            place = {v: i for i, v in enumerate(level)}
            local = np.full(size, -1)
            local[level] = np.arange(len(level))
            rows = np.flatnonzero(local[node] >= 0)
            where = local[node[rows]]
            hist = [np.bincount((where[:, None] * width * bins + flat[rows]).ravel(), np.repeat(w[rows], width), len(level) * width * bins).reshape(len(level), width, bins) for w in (g, h, np.ones(n))]
            split = {}
            for v, i in place.items():
                gs, hs, ns = (np.cumsum(a[i], axis=1) for a in hist)
                gt, ht, nt = gs[0, -1], hs[0, -1], ns[0, -1]
                value[v] = -rate * gt / (ht + ridge)
                if d == depth or nt < 2 * least:
                    continue
                gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
                gain[(ns < least) | (nt - ns < least)] = -1
                j, b = np.unravel_index(np.argmax(gain), gain.shape)
                if gain[j, b] <= 1e-6 or b >= len(edges[j]):
                    continue
                feature[v], threshold[v], left[v] = j, edges[j][b], fresh
                split[v] = b
                new_level += [fresh, fresh + 1]
                fresh += 2
            if not split:
                break
            cut = np.full(size, -1)
            for v, b in split.items():
                cut[v] = b
            moved = rows[cut[node[rows]] >= 0]
            at = node[moved]
            node[moved] = left[at] + (binned[moved, feature[at]] > cut[at])
            level = new_level
        score += value[node]
    return Trees(bias, *out, depth)


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int = SAMPLE) -> Trees:
    """Fit on at most ``sample`` labelled texts; only their statistics reach the driver."""
    picked = labelled(labels, id_col, label_col, sample).select("id", F.col("y").cast("double").alias("y"))
    rows = docs.select(col(id_col).cast("long").alias("id"), col(text_col).alias("text")).join(F.broadcast(picked), "id")

    def run(batches):
        for b in X.slices(batches, "text"):
            yield pa.record_batch({"id": b.column("id"), "y": b.column("y"), "x": pa.array(list(statistics(b.column("text"))), pa.list_(pa.float32()))})

    one = rows.mapInArrow(run, "id long, y double, x array<float>").groupBy("id", "y").agg(F.min("x").alias("x"))  # one text an id
    got = one.toArrow()
    x = np.array(got["x"].to_pylist(), np.float32).reshape(-1, len(NAMES))
    y, ids = got["y"].to_numpy(), got["id"].to_numpy()
    order = np.lexsort((*x.T, ids))  # a fixed order, so that the fit is the same in every run
    return grow(x[order], (y[order] > 0).astype(float))


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per text: id, the columns of ``keep``, score (0 .. 1, higher: label 1 likelier) and predicted (1 if score >= 0.5)."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col, text_col, label_col, sample))  # a fixed size
    held = ["text" if k == text_col else f"k{i}" for i, k in enumerate(keep)]  # the text goes to Python once
    named = docs.select(col(id_col).cast("long").alias("id"), *[col(k).alias(h) for k, h in zip(keep, held) if h != "text"], col(text_col).alias("text"))

    def run(batches):
        for b in X.slices(batches, "text"):
            score = model.value.score(statistics(b.column("text")))
            yield pa.record_batch({"id": b.column("id")} | {h: b.column(h) for h in held} | {"score": pa.array(score), "predicted": pa.array((score >= 0.5).astype(np.int32))})

    schema = T.StructType([T.StructField("id", T.LongType()), *[T.StructField(h, docs.schema[k].dataType) for k, h in zip(keep, held)], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return named.mapInArrow(run, schema).select(F.col("id").alias(id_col), *[F.col(h).alias(k) for k, h in zip(keep, held)], "score", "predicted")
