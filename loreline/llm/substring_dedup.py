"""Substring dedup by Rabin-Karp hashes of every fixed-length word window.

Plan: texts are dealt to groups of about ``GROUP_BYTES``; a group hashes all its windows, keeps one entry for each
different window (with the smallest id that has it) and deals the entries to buckets by a second hash; a bucket finds, for
every window, the smallest id over the corpus and answers each group with one bit an entry. The groups read their texts
again (the exchange is reused), mark the repeated windows, merge them into maximal intervals and cut those.

An entry moves once and in 8 bytes, a window that stands in a third of all texts moves once a group, and no step collects
more than a group or bucket, whose numbers grow with the corpus. Two windows count as equal if 64 bits of one hash and
the bucket of another hash agree, so the fingerprint grows with the number of buckets.

Defined cases: null text has no words; null id sorts after every id; equal ids never remove from each other; repeated
rows each get a row; other columns are ignored unless named in ``keep``; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loreline.llm import _text as X
from loreline.llm._frames import col, text_bytes

GROUP_BYTES = 3 << 20  # text in one group
BUCKET_BYTES = 8 << 20  # text whose windows meet in one bucket
_SECOND = X.U(0xC2B2AE3D27D4EB4F)


class _Windows:
    """All windows of one group: sorted by id, one entry for each different window."""

    def __init__(self, table: pa.Table, width: int, buckets: int):
        ids = X.ids_of(table["id"])
        data, offsets = X.bytes_of(table["text"])
        # equal rows are alike, so any order among them gives the same entries
        order = np.lexsort((table["tie"].to_numpy(), ids))
        self.table = table.take(pa.array(order))
        self.ids = ids[order]
        self.data, self.offsets = X.bytes_of(self.table["text"])
        self.words = X.split_words(self.data, self.offsets)
        hashes = X.hash_words(self.data, self.words)
        n = len(hashes) - width + 1
        self.at = np.flatnonzero(self.words.text[:n] == self.words.text[width - 1:]) if n > 0 else np.zeros(0, np.int64)
        value = X.mix(X.roll(hashes, width))[self.at] if n > 0 else np.zeros(0, X.U)
        id_at = self.ids[self.words.text[self.at]]
        by_value = np.argsort(value)
        ranked = value[by_value]
        new = np.ones(len(ranked), bool)
        new[1:] = ranked[1:] != ranked[:-1]
        begin = np.flatnonzero(new)
        self.entry_of = np.empty(len(value), np.int64)
        self.entry_of[by_value] = np.cumsum(new) - 1
        self.key = ranked[begin]
        self.owner = np.minimum.reduceat(id_at[by_value], begin) if len(begin) else np.zeros(0, np.int64)
        self.local = id_at > self.owner[self.entry_of]
        second = X.mix(X.roll(hashes, width, _SECOND))[self.at] if n > 0 else value
        pick = np.empty(len(self.key), X.U)
        pick[self.entry_of] = second
        self.bucket = (pick % X.U(buckets)).astype(np.int64)
        self.order = np.lexsort((self.owner, self.bucket))
        self.cut = np.searchsorted(self.bucket[self.order], np.arange(buckets + 1))


def _entries(width: int, buckets: int):
    def run(table: pa.Table) -> pa.Table:
        w = _Windows(table, width, buckets)
        owner, key = w.owner[w.order], w.key[w.order]
        rows = [(b, X.planes(np.diff(owner[lo:hi], prepend=np.int64(0))), key[lo:hi].tobytes()) for b, (lo, hi) in enumerate(zip(w.cut[:-1], w.cut[1:])) if hi > lo]
        return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int32()), "grp": pa.array([table["grp"][0].as_py()] * len(rows), pa.int64()), "owners": pa.array([r[1] for r in rows], pa.binary()), "entries": pa.array([r[2] for r in rows], pa.binary())})

    return run


def _answers(table: pa.Table) -> pa.Table:
    counts = [len(x) // 8 for x in table["entries"].to_pylist()]
    key = np.concatenate([np.frombuffer(x, X.U) for x in table["entries"].to_pylist()])
    owner = np.concatenate([np.cumsum(X.unplanes(x, n, 8, np.int64)) for x, n in zip(table["owners"].to_pylist(), counts)])
    order = np.argsort(key)
    ranked = key[order]
    new = np.ones(len(ranked), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    least = np.minimum.reduceat(owner[order], np.flatnonzero(new))
    repeated = np.empty(len(key), bool)
    repeated[order] = owner[order] > least[np.cumsum(new) - 1]
    at = np.concatenate([[0], np.cumsum(counts)])
    bits = [np.packbits(repeated[lo:hi]).tobytes() if repeated[lo:hi].any() else None for lo, hi in zip(at[:-1], at[1:])]
    out = pa.table({"grp": table["grp"], "bucket": table["bucket"], "bits": pa.array(bits, pa.binary())})
    return out.filter(out["bits"].is_valid())


def _cut(width: int, buckets: int, keep: list[str], names: list[str]):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({n: pa.array([], t) for n, t in zip(["id", *keep, *names], [pa.int64(), *[table.schema.field(k).type for k in keep], pa.int64(), pa.int64(), pa.string()])})
        w = _Windows(table, width, buckets)
        far = np.zeros(len(w.key), bool)
        for b, bits in zip(answers["bucket"].to_pylist(), answers["bits"].to_pylist()):
            lo, hi = w.cut[b], w.cut[b + 1]
            far[w.order[lo:hi]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=hi - lo).astype(bool)
        starts = w.at[w.local | far[w.entry_of]]
        removed = X.spans_cover(starts, width, len(w.words.start))
        n = w.table.num_rows
        out = {"id": w.table["id"]} | {k: w.table[k] for k in keep}
        out[names[0]] = pa.array(np.diff(w.words.first))
        out[names[1]] = pa.array(np.bincount(w.words.text[removed], minlength=n).astype(np.int64))
        out[names[2]] = X.join_words(w.data, w.words, ~removed, n).cast(pa.string())
        return pa.table(out)

    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, keep: tuple[str, ...] = ()) -> DataFrame:
    """Remove every word covered by a ``window``-word sequence that also starts in a text with a smaller id.

    Returns id, the columns of ``keep``, then n_words, n_removed and kept_text (kept words joined by one space).
    """
    if window < 1:
        raise ValueError("window must be at least 1")
    _, size = text_bytes(docs, "`" + text_col + "`")
    groups, buckets = max(1, -(-size // GROUP_BYTES)), max(1, -(-size // BUCKET_BYTES))
    held = [f"k{i}" for i in range(len(keep))]
    tie = F.xxhash64(col(id_col), col(text_col))
    texts = docs.select(col(id_col).cast("long").alias("id"), col(text_col).alias("text"), tie.alias("tie"), F.pmod(tie, F.lit(groups)).alias("grp"), *[col(k).alias(h) for k, h in zip(keep, held)])
    entries = texts.select("id", "text", "tie", "grp", *held).groupBy("grp").applyInArrow(_entries(window, buckets), "bucket int, grp long, owners binary, entries binary")
    # as many partitions as buckets, so that a task holds few of them at any size
    answers = entries.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_answers, "grp long, bucket int, bits binary")
    schema = T.StructType([T.StructField("id", T.LongType()), *[T.StructField(h, docs.schema[k].dataType) for k, h in zip(keep, held)], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])
    cut = texts.groupBy("grp").cogroup(answers.groupBy("grp")).applyInArrow(_cut(window, buckets, held, ["n_words", "n_removed", "kept_text"]), schema)
    return cut.select(F.col("id").alias(id_col), *[F.col(h).alias(k) for k, h in zip(keep, held)], "n_words", "n_removed", "kept_text")
