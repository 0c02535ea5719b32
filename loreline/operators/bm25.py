"""BM25 over a corpus of (doc_id, text): one inverted index, many queries at once.

Queries are exploded with multiplicity (a repeated word counts twice). The query side's terms are joined against the postings, so only
documents that share a token are scored. The term table of the queries is broadcast only below a checked row count.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loreline.functions.text import bm25_tokens
from loreline.sources.shared import dealt

K1, B = 1.5, 0.75
BROADCAST_ROWS = 100_000
PUSHED = 200  # tokens that are given to the scan by name


@dataclass
class Bm25Index:
    """postings(token, doc_id, tf, size), terms(token, df), stats(n, avgdl): plain tables that can be stored and reread."""

    postings: DataFrame
    terms: DataFrame
    stats: DataFrame


def sizes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    return docs.select(F.col(doc_id).alias("doc_id"), *carry, F.size(bm25_tokens(F.col(text))).alias("size"))


def corpus_stats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row: n documents, avgdl (1.0 for an empty corpus)."""
    return sizes(docs, doc_id, text).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("size"), F.lit(1.0)).alias("avgdl"))


def term_df(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """token, df: distinct tokens of each document first, so the shuffle carries one row a document and token."""
    return docs.select(F.explode(F.array_distinct(bm25_tokens(F.col(text)))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Bm25Index:
    # texts are dealt by document before they are taken apart: they are far smaller than postings, which then need no shuffle
    tokens = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).repartition("doc_id").select("doc_id", bm25_tokens(F.col("text")).alias("tokens")).withColumn("size", F.size("tokens"))
    postings = tokens.select("doc_id", "size", F.explode("tokens").alias("token")).groupBy("token", "doc_id").agg(F.count(F.lit(1)).cast("int").alias("tf"), F.first("size").alias("size"))
    return Bm25Index(postings, postings.groupBy("token").agg(F.count(F.lit(1)).alias("df")), corpus_stats(docs, doc_id, text))


def idf(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


def tf_norm(tf: Column, size: Column, avgdl: Column, k1: float = K1, b: float = B) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * size / avgdl))


def search(docs: DataFrame, queries: DataFrame, k: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Top k of every query (query_id, query): query_id, doc_id, score, rank. Ties go to the smaller doc_id.

    One pass finds the query tokens in the corpus (semi-join on the query terms before anything is shuffled), one aggregate
    scores; the document frequency comes from the same filtered postings. Hits are dealt by document, to as many tasks as documents
    times queries ask for: a common word gives a score for nearly all of these pairs, which then leave a task only if they are among its best.
    """
    asked, side = _asked(queries)
    wanted = asked.select("token").distinct()
    tokens = docs.select(F.col(doc_id).alias("doc_id"), bm25_tokens(F.col(text)).alias("tokens"))
    hits = (tokens.select("doc_id", F.size("tokens").alias("size"), F.explode("tokens").alias("token"))
            .join(side(wanted), "token", "left_semi"))
    hits = dealt(hits, docs.count() * queries.count(), "doc_id").groupBy("token", "doc_id").agg(F.count(F.lit(1)).alias("tf"), F.first("size").alias("size"))
    df = hits.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    stats = corpus_stats(docs, doc_id, text)
    return _ranked(hits, asked.join(df, "token").crossJoin(F.broadcast(stats)), side, k)  # stats is one row


def search_index(index: Bm25Index, queries: DataFrame, k: int) -> DataFrame:
    """``search`` on a stored index: reads the postings of the asked tokens only (files are sorted by token, few tokens are pushed down)."""
    asked, side = _asked(queries)
    known = [r[0] for r in asked.select("token").distinct().limit(PUSHED + 1).collect()]
    postings = index.postings.filter(F.col("token").isin(known)) if len(known) <= PUSHED else index.postings
    terms = index.terms.filter(F.col("token").isin(known)) if len(known) <= PUSHED else index.terms
    return _ranked(postings, asked.join(terms, "token").crossJoin(F.broadcast(index.stats)), side, k)  # stats is one row


def _asked(queries: DataFrame):
    """Terms of the queries (query_id, token, times), and broadcast where there are few enough of them."""
    asked = queries.select("query_id", F.explode(bm25_tokens(F.col("query"))).alias("token")).groupBy("query_id", "token").agg(F.count(F.lit(1)).alias("times"))
    small = asked.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return asked, (F.broadcast if small else (lambda d: d))


def _ranked(hits: DataFrame, terms: DataFrame, side, k: int) -> DataFrame:
    scored = (hits.join(side(terms), "token")
              .groupBy("query_id", "doc_id")
              .agg(F.sum(F.col("times") * idf(F.col("n"), F.col("df")) * tf_norm(F.col("tf"), F.col("size"), F.col("avgdl"))).alias("score"))
              .filter("score > 0"))
    best = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "doc_id")
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
