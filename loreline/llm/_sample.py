"""A bounded sample of labelled texts as sparse features, cut to the features that tell labels apart.

Features are made on executors. Their document frequencies are summed there too, in chunks of cells, and only cells that tell labels
apart come to the driver; then the sample's rows come, cut to those cells, as flat arrays. At most ``sample`` rows reach the driver,
whatever the tables hold: an id counts once (of conflicting labels the largest, of several texts the first by its features).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreline.llm import _linear as L
from loreline.llm import _text as X
from loreline.llm._frames import checkpoint, col, discard

CHUNK = 1 << 14  # cells whose counts meet in one task


@dataclass
class Sample:
    """Text i has label names[y[i]], words[i] words, and the features cell[first[i]:first[i + 1]] with their times."""

    names: list[str]
    y: np.ndarray
    words: np.ndarray
    cell: np.ndarray
    times: np.ndarray
    first: np.ndarray
    told: np.ndarray  # the cells that are kept
    df: np.ndarray  # (labels, told) texts of each label that hold the cell

    def per_class(self) -> np.ndarray:
        return np.bincount(self.y, minlength=len(self.names))

    def rows(self, value: np.ndarray, use: np.ndarray, dims: int) -> L.Rows:
        """Feature rows of the texts marked in ``use``."""
        size = np.diff(self.first)
        inside = np.repeat(use, size)
        return L.Rows(self.cell[inside], value[inside], np.repeat(np.arange(int(use.sum())), size[use]), dims, int(use.sum()))


def labelled(labels: DataFrame, id_col: str, label_col: str, sample: int) -> DataFrame:
    """(id, y) of at most ``sample`` labelled ids, those with the smallest hash; of conflicting labels the largest."""
    rows = labels.dropna(subset=[id_col, label_col]).groupBy(col(id_col).cast("long").alias("id")).agg(F.max(col(label_col)).alias("y"))
    return rows.dropna(subset=["id"]).orderBy(F.xxhash64("id"), "id").limit(sample)


def telling(df: np.ndarray, n: np.ndarray, least: float = 4.0) -> np.ndarray:
    """Mask of cells whose presence in some label differs from that in the others by at least ``least`` standard errors."""
    out = np.zeros(df.shape[1], bool)
    total = df.sum(axis=0)
    for d, m in zip(df, n):
        rest = n.sum() - m
        if m and rest:
            pooled = total / (m + rest)
            out |= np.abs(d / m - (total - d) / rest) > least * np.sqrt(pooled * (1 - pooled) * (1 / m + 1 / rest) + 1e-12)
    return out


def take(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int, dims: int, pick: Callable[[list[str], np.ndarray, np.ndarray], np.ndarray] = lambda names, df, n: telling(df, n)) -> Sample:
    """The sample, cut to the cells that ``pick`` takes, given the labels, counts by label and cell, and texts by label."""
    spark = docs.sparkSession
    picked = labelled(labels, id_col, label_col, sample).select("id", F.col("y").cast("string").alias("y"))
    texts = docs.select(col(id_col).cast("long").alias("id"), col(text_col).alias("text")).join(F.broadcast(picked), "id")

    def features(batches):
        for b in X.slices(batches, "text"):
            f = L.Features(b.column("text"), dims, share=False)
            cut = [slice(f.first[r], f.first[r + 1]) for r in range(b.num_rows)]
            yield pa.record_batch({"id": b.column("id"), "y": b.column("y"), "words": pa.array(f.n_words), "cells": pa.array([f.cell[c].tobytes() for c in cut], pa.binary()), "times": pa.array([f.times[c].astype(np.uint32).tobytes() for c in cut], pa.binary())})

    made = texts.mapInArrow(features, "id long, y string, words long, cells binary, times binary")
    one = checkpoint(made.groupBy("id", "y").agg(F.min(F.struct("words", "cells", "times")).alias("r")).select("id", "y", "r.*"))
    counted = {r[0]: r[1] for r in one.groupBy("y").agg(F.count(F.lit(1))).collect()}  # one row a label
    names = sorted(counted)
    n = np.array([counted[k] for k in names], np.int64)
    at = {k: i for i, k in enumerate(names)}

    def count(batches):
        df = np.zeros(len(names) * dims, np.int32)
        for b in batches:
            data, offsets = X.bytes_of(b.column("cells"))
            y = np.array([at[k] for k in b.column("y").to_pylist()], np.int64)
            df += np.bincount(np.repeat(y, np.diff(offsets) // 4) * dims + data.copy().view(np.int32), minlength=len(df)).astype(np.int32)
        df = df.reshape(len(names), dims)
        some = [k for k in range(0, dims, CHUNK) if df[:, k:k + CHUNK].any()]
        yield pa.record_batch({"chunk": pa.array(some, pa.int64()), "df": pa.array([df[:, k:k + CHUNK].tobytes() for k in some], pa.binary())})

    def tell(table: pa.Table) -> pa.Table:
        df = sum(np.frombuffer(x, np.int32).reshape(len(names), -1).astype(np.int64) for x in table["df"].to_pylist())
        use = np.flatnonzero(pick(names, df, n))
        return pa.table({"cell": pa.array(use + table["chunk"][0].as_py()), "df": pa.array([x.tobytes() for x in df[:, use].T], pa.binary())})

    found = one.select("y", "cells").mapInArrow(count, "chunk long, df binary").groupBy("chunk").applyInArrow(tell, "cell long, df binary").toArrow() if names else None
    if found is None or not found.num_rows:
        told, df = np.zeros(0, np.int64), np.zeros((len(names), 0), np.int64)
    else:
        order = np.argsort(found["cell"].to_numpy())
        told = found["cell"].to_numpy()[order]
        df = X.bytes_of(found["df"])[0].copy().view(np.int64).reshape(-1, len(names))[order].T
    shared = spark.sparkContext.broadcast(told)

    def cut(batches):
        use = np.zeros(dims, bool)
        use[shared.value] = True
        for b in batches:
            data, offsets = X.bytes_of(b.column("cells"))
            cell, times = data.copy().view(np.int32), X.bytes_of(b.column("times"))[0].copy().view(np.uint32)
            mine = use[cell]
            edge = np.concatenate([[0], np.cumsum(mine)])[offsets // 4]
            cell, times = cell[mine], times[mine]
            spans = list(zip(edge[:-1], edge[1:]))
            yield pa.record_batch({"id": b.column("id"), "y": b.column("y"), "words": b.column("words"), "cells": pa.array([cell[a:z].tobytes() for a, z in spans], pa.binary()), "times": pa.array([times[a:z].tobytes() for a, z in spans], pa.binary())})

    got = one.mapInArrow(cut, "id long, y string, words long, cells binary, times binary").toArrow()
    discard(one)
    got = got.take(pa.array(np.argsort(got["id"].to_numpy(), kind="stable")))  # a fixed order, so that the fit is the same in every run
    data, offsets = X.bytes_of(got["cells"])
    return Sample(names, np.array([at[k] for k in got["y"].to_pylist()], np.int64), got["words"].to_numpy(), data.copy().view(np.int32), X.bytes_of(got["times"])[0].copy().view(np.uint32), offsets // 4, told, df)
