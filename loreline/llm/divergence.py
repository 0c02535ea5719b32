"""Source divergence audit: how far the word use of each source lies from that of every other source, and of its whole language.

Terms are runs of letters and non-ASCII characters, A-Z lower-cased. A language keeps the terms that stand in at least ``min_docs`` of its
documents. With ``count`` occurrences of a kept term in a group, N of all kept terms, and V kept terms, the group's smoothed share is
p = 1 + floor(10^9 (count + 1) / (N + V)), and a group's divergence from q in this term is f(p, q) = floor((p - q)^2 / q).

1. One map over the texts counts terms by (lang, source); counts are summed before they are shuffled.
2. The counts of a term in the sources of its language are one sparse vector. Terms of equal vectors (most terms are rare) have equal f
   everywhere, so vectors are deduplicated and each goes with its multiplicity. Every pair of sources is evaluated once per distinct vector:
   a cell (a share of a language's vectors) holds the totals of its language's sources and sums, for each pair in which a vector
   has an occurrence, multiplicity times f less the value of a term that neither source has; V times that value is added at the end.
3. A group's own terms are ranked by f against the whole language, in two steps (by a salt, then all), each of which keeps ``top``.

All arithmetic is on integers: f is below 1.1e18, its sum below (10^9 + V)^2 < 2^63 for V < 2e9, and p is divided out in three steps of three
digits, exact for N + V < 9e15.

A language's totals are repeated once a cell, and a cell returns sources x sources sums; it holds at least a quarter as many
vector entries as that (2 million at most), so what is added up stays in proportion to the counts, and to the square that the result itself has.

Defined cases: null text, lang and source count as ''; a group without kept terms takes part with N = 0; a language without kept terms has pairs of
value 0; a language of one source has no pairs; repeated rows are documents of their own; other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loreline.llm import _text as X
from loreline.llm._frames import checkpoint, col, discard

MIN_DOCS, TOP = 3, 200
CELL = (50_000, 2_000_000)  # vector entries of a cell: least and most
SALTS = 16
PAIR_BLOCK = 4 << 20  # pairs of (entry, source) that are evaluated at once
_TERM = np.ones(256, bool)  # separators; bytes of multi-byte characters are part of a term
_TERM[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False


def _count(batches):
    """(lang, source, term, n, docs) of each slice of texts, and one row with a null term for each group that stands in it."""
    for b in X.slices(batches, "text", 8 << 20):
        data, offsets = X.bytes_of(b.column("text"))
        words = X.split_words(data, offsets, _TERM)
        size = words.end - words.start
        begin = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat(words.start - begin[:-1], size) + np.arange(begin[-1])
        terms = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(begin.astype(np.int64).tobytes()), pa.py_buffer(X.LOWER[data[at]].tobytes() if len(at) else b"")]).dictionary_encode()
        group = pa.StructArray.from_arrays([b.column("lang"), b.column("source")], names=["lang", "source"])
        lang, source = (pc.dictionary_encode(b.column(c)) for c in ("lang", "source"))
        code = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
        groups, first, of = np.unique(code, return_index=True, return_inverse=True)
        group = group.take(pa.array(first))
        many = max(len(terms.dictionary), 1)
        # occurrences by (text, term), then by (group, term)
        each, times = np.unique(words.text * many + terms.indices.to_numpy(), return_counts=True)
        key, inverse, docs = np.unique(of[each // many] * many + each % many, return_inverse=True, return_counts=True)
        n = np.bincount(inverse, times, len(key)).astype(np.int64) if len(key) else np.zeros(0, np.int64)
        place = pa.array(np.concatenate([key // many, np.arange(len(groups))]))
        held = group.take(place)
        word = pa.concat_arrays([terms.dictionary.take(pa.array(key % many)).cast(pa.large_string()), pa.nulls(len(groups), pa.large_string())]).cast(pa.string())
        zero = np.zeros(len(groups), np.int64)
        yield pa.record_batch({"lang": held.field("lang"), "source": held.field("source"), "term": word, "n": pa.array(np.concatenate([n, zero])), "docs": pa.array(np.concatenate([docs.astype(np.int64), zero]))})


def share(count: np.ndarray, total) -> np.ndarray:
    """1 + floor(10^9 (count + 1) / total) for count < total, three digits at a time."""
    out, rest = np.zeros(np.broadcast(count, total).shape, np.int64), count + 1
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // total, rest % total
    return out + 1


def _share(count: Column, total: Column) -> Column:
    """``share`` as a column."""
    out, rest = F.lit(0).cast("long"), count + F.lit(1)
    div = lambda a, b: F.call_function("div", a, b)
    for _ in range(3):
        rest = rest * F.lit(1000)
        out, rest = out * F.lit(1000) + div(rest, total), F.pmod(rest, total)
    return out + F.lit(1)


def _f(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def _pairs(vectors: pa.Table, totals: pa.Table) -> pa.Table:
    """Sums of m * (f - f of an absent term) for each ordered pair of sources, over the distinct vectors of a cell."""
    kind = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("over", pa.int64())])
    if not vectors.num_rows or not totals.num_rows:
        return kind.empty_table()
    sources = totals["source"].combine_chunks()
    s = len(sources)
    total = totals["total"].to_numpy()
    none = share(np.zeros(s, np.int64), total)
    base = divergence(none[:, None], none[None, :])
    vec = vectors["vec"].combine_chunks()
    length = pc.list_value_length(vec).to_numpy(zero_copy_only=False).astype(np.int64)
    entry = vec.flatten()
    who = pc.index_in(entry.field("source"), value_set=sources).to_numpy(zero_copy_only=False).astype(np.int64)
    n, m = entry.field("n").to_numpy(zero_copy_only=False), vectors["m"].to_numpy()
    over = np.zeros((s, s), np.int64)
    step = max(1, PAIR_BLOCK // (s * s))
    ends = np.cumsum(length)
    for lo in range(0, len(length), step):
        hi = min(lo + step, len(length))
        a, b = (ends[lo - 1] if lo else 0), ends[hi - 1]
        row = np.repeat(np.arange(hi - lo), length[lo:hi])
        count = np.zeros((hi - lo, s), np.int64)
        count[row, who[a:b]] = n[a:b]
        p = share(count, total[None, :])
        has = count > 0
        weight = m[lo:hi]
        for i in range(s):  # all pairs of one source; those that neither has add nothing
            touched = has[:, i, None] | has
            extra = np.where(touched, divergence(p[:, i, None], p) - base[i], 0)
            over[i] += (extra * weight[:, None]).sum(axis=0)
    i, j = np.divmod(np.arange(s * s), s)
    told = np.flatnonzero(i != j)
    i, j = i[told], j[told]
    return pa.table({"lang": pa.array([totals["lang"][0].as_py()] * len(told), pa.string()), "source": sources.take(pa.array(i)), "item": sources.take(pa.array(j)), "over": pa.array(over[i, j])}, schema=kind)


def source_divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """Per (lang, source): part ``pair`` has every other source of the language, part ``term`` its ``top`` own terms; item, value, rank."""
    rows = docs.select(*[F.coalesce(col(c).cast("string"), F.lit("")).alias(a) for c, a in ((text_col, "text"), (lang_col, "lang"), (source_col, "source"))])
    counted = checkpoint(rows.mapInArrow(_count, "lang string, source string, term string, n long, docs long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    kept = checkpoint(counted.filter("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("source", "n"))).alias("vec"))
                      .filter(F.col("docs") >= F.lit(min_docs)).select("lang", "term", "n", "vec"))
    # totals of every group, and of every language
    size = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("n").alias("lang_n"))
    held = kept.select("lang", F.explode("vec").alias("e")).groupBy("lang", F.col("e.source").alias("source")).agg(F.sum("e.n").alias("group_n"))
    groups = counted.filter("term is null").select("lang", "source")
    totals = checkpoint(groups.join(held, ["lang", "source"], "left").join(size, "lang", "left").na.fill(0, ["group_n", "v", "lang_n"])
                        .select("lang", "source", "v", (F.col("group_n") + F.col("v")).alias("total"), (F.col("lang_n") + F.col("v")).alias("lang_total")))
    # distinct vectors, dealt to cells of a language
    distinct = checkpoint(kept.groupBy("lang", "vec").agg(F.count(F.lit(1)).alias("m")))
    s = totals.groupBy("lang").agg(F.count(F.lit(1)).alias("s"))
    room = F.least(F.greatest(F.col("s") * F.col("s") / F.lit(4), F.lit(CELL[0])), F.lit(CELL[1]))
    cells = checkpoint(distinct.groupBy("lang").agg(F.sum(F.size("vec")).alias("entries")).join(s, "lang").select("lang", F.greatest(F.lit(1), F.ceil(F.col("entries") / room)).cast("long").alias("cells")))
    dealt = distinct.join(cells, "lang").select("lang", F.pmod(F.xxhash64("vec"), F.col("cells")).alias("cell"), "vec", "m")
    asked = totals.join(cells, "lang").select("lang", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1)).alias("cell"), "source", "total")
    over = (dealt.groupBy("lang", "cell").cogroup(asked.groupBy("lang", "cell")).applyInArrow(_pairs, "lang string, source string, item string, over long")
            .groupBy("lang", "source", "item").agg(F.sum("over").alias("over")))
    none = lambda: _share(F.lit(0).cast("long"), F.col("total"))
    own = totals.select("lang", "source", "v", F.when(F.col("v") > 0, none()).alias("p"))
    pairs = (own.join(own.select("lang", F.col("source").alias("item"), F.col("p").alias("q")), "lang").filter("source <> item").join(over, ["lang", "source", "item"], "left")
             .select("lang", "source", F.lit("pair").alias("part"), "item", F.when(F.col("v") > 0, F.col("v") * _f(F.col("p"), F.col("q")) + F.coalesce("over", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("value")))
    order = (F.col("value").desc(), F.col("item").asc())
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order)))
    # terms of a vector share its values; the terms themselves are ranked
    entry = kept.select("lang", "term", "n", F.explode("vec").alias("e")).select("lang", F.col("e.source").alias("source"), F.col("term").alias("item"), "n", F.col("e.n").alias("own"))
    scored = (entry.join(totals, ["lang", "source"]).select("lang", "source", "item", _share(F.col("own"), F.col("total")).alias("p"), _share(F.col("n"), F.col("lang_total")).alias("q")).filter("p > q")
              .select("lang", "source", F.lit("term").alias("part"), "item", _f(F.col("p"), F.col("q")).alias("value"), F.pmod(F.xxhash64("item"), F.lit(SALTS)).alias("salt")))
    first = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "salt").orderBy(*order))).filter(F.col("rank") <= top).drop("rank", "salt")
    best = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order))).filter(F.col("rank") <= top)
    out = checkpoint(ranked.unionByName(best))
    discard(counted, kept, totals, distinct, cells)
    return out
