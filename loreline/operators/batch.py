"""Ranked retrieval for a table of queries (query_id, query) in one plan: the modes of ``retrieval`` with a query dimension.

Every branch is an equality join on something that queries and symbols share: a token, a trigram, a node, a frame's function name, the end of a
path. No mode collects anything, and no query has a plan of its own. Results equal those of ``retrieval`` query by query.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loreline.functions.text import code_tokens, normalize_path
from loreline.functions.trace import is_stack_trace, loose_frames
from loreline.operators import bm25, graph, retrieval
from loreline.operators.retrieval import GRAPH, KEYWORD, OVERFETCH, SEEDS, TRACE_DIRECT, TRACE_GRAPH, TRACE_IMPORT

Q = "query_id"
GRAM = 3


def _grams(text: Column) -> Column:
    """The different runs of GRAM characters of a text."""
    n = F.length(text) - GRAM + 1
    return F.array_distinct(F.transform(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), lambda k: F.substring(text, k, GRAM)))


def _short(text: Column) -> Column:
    """The different runs of fewer than GRAM characters of a text, the empty one too; null of a null."""
    n = F.length(text)
    of = lambda w: F.transform(F.when(n >= w, F.sequence(F.lit(1), n - w + 1)).otherwise(F.array().cast("array<int>")), lambda k: F.substring(text, k, w))
    return F.array_distinct(F.concat(F.when(text.isNotNull(), F.array(F.lit(""))), *map(of, range(1, GRAM))))


def gram_index(symbols: DataFrame, columns: tuple[str, ...] = ("name", "qualified_name"), key: str = "symbol_id") -> DataFrame:
    """(gram, key): which rows hold a run of three characters in one of the columns, ASCII case folded. A table that can be stored."""
    return symbols.select(key, F.explode(F.array_distinct(F.flatten(F.array(*[F.coalesce(_grams(F.lower(F.col(c))), F.array().cast("array<string>")) for c in columns])))).alias("gram"))


def like_search(symbols: DataFrame, queries: DataFrame, limit: int, columns: tuple[str, ...] = ("name", "qualified_name"), key: str = "symbol_id", grams: DataFrame | None = None) -> DataFrame:
    """For each query its first ``limit`` rows by key in which a column contains it: query_id, key, at (from 1).

    A row that contains a query contains the query's rarest trigram: that one alone is looked up, and what it gives is verified. Queries of fewer than
    three characters are looked up as they are, among the runs of their own length; the empty one stands in every row that has a text. All joins are
    shuffled: the planner knows no size of exploded rows and would send the index through the driver.
    """
    met = lambda rows: rows.hint("merge")
    grams = gram_index(symbols, columns, key) if grams is None else grams
    asked = queries.select(Q, F.lower("query").alias("_q"))
    own = asked.filter(F.length("_q") >= GRAM).select(Q, "_q", F.explode(_grams(F.col("_q"))).alias("gram"))
    often = grams.join(met(own.select("gram").distinct()), "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = own.join(met(often), "gram", "left").groupBy(Q, "_q").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r")).filter("r.n > 0").select(Q, "_q", F.col("r.gram").alias("gram"))
    texts = [F.lower(F.col(c)) for c in columns]
    text = symbols.select(key, *[t.alias(f"_t{k}") for k, t in enumerate(texts)])
    hit = reduce(lambda a, b: a | b, [F.coalesce(F.contains(F.col(f"_t{k}"), F.col("_q")), F.lit(False)) for k in range(len(columns))])
    long = grams.join(met(rarest), "gram").join(met(text), key).filter(hit).select(Q, key)
    few = asked.filter(F.length("_q") < GRAM)
    runs = F.array_distinct(F.flatten(F.array(*[F.coalesce(_short(t), F.array().cast("array<string>")) for t in texts])))
    # a share of all rows has a run of one or two characters, and only the first ``limit`` of them count: these are told before rows meet queries
    first = symbols.select(key, F.explode(runs).alias("_q")).withColumn("_r", F.row_number().over(Window.partitionBy("_q").orderBy(key))).filter(F.col("_r") <= limit).drop("_r")
    short = first.join(met(few), "_q").select(Q, key)
    place = Window.partitionBy(Q).orderBy(key)
    return long.unionByName(short).withColumn("at", F.row_number().over(place)).filter(F.col("at") <= limit)


def _branch(rows: DataFrame, at: int, source: str, score, order: list[str]) -> DataFrame:
    return rows.select(Q, F.lit(at).alias("branch_ord"), retrieval._order(*[F.col(c) for c in order]).alias("ord"), "symbol_id", score.cast("double").alias("score"), F.lit(source).alias("source"))


def lexical(symbols: DataFrame, queries: DataFrame, k: int, index: bm25.Bm25Index | None = None) -> tuple[DataFrame, DataFrame]:
    """Branches bm25 and keyword of every query."""
    if index is not None:
        found = bm25.search_index(index, queries, k)
    else:
        found = bm25.search(symbols.select("symbol_id", retrieval.index_text().alias("text")), queries, k, "symbol_id")
    return (_branch(found.withColumnRenamed("doc_id", "symbol_id"), 1, "bm25", F.col("score"), ["rank"]), _branch(like_search(symbols, queries, k), 2, "keyword", F.lit(KEYWORD), ["at"]))


def keyword_only(symbols: DataFrame, queries: DataFrame, top_k: int, index: bm25.Bm25Index | None = None) -> DataFrame:
    words, like = lexical(symbols, queries, OVERFETCH * top_k, index)
    both = like.withColumn("b", F.lit(0)).unionByName(words.withColumn("b", F.lit(1)))
    first = both.groupBy(Q, "symbol_id").agg(F.min(F.struct("b", "ord")).alias("at"))
    ranked = first.withColumn("ord", F.row_number().over(Window.partitionBy(Q).orderBy("at.b", "at.ord")).cast("long"))
    return retrieval.file_aggregate(ranked.withColumn("score", F.lit(1.0) - 0.01 * (F.col("ord") - 1)).join(symbols, "symbol_id"), top_k, by=Q)


def symbol_only(symbols: DataFrame, queries: DataFrame, top_k: int) -> DataFrame:
    """Scores of ``retrieval.symbol_scores`` by a join on tokens."""
    file = F.substring_index(normalize_path(F.coalesce("file_path", F.lit(""))), "/", -1)
    one = lambda c, kind: F.struct(c.alias("token"), F.lit(kind).alias("kind"))
    told = F.concat(F.array(one(F.lower("name"), "name"), one(file, "file"), one(F.regexp_replace(file, r"\.py$", ""), "stem")), F.transform(F.array_distinct(code_tokens(F.col("qualified_name"))), lambda t: one(t, "qualified")))
    keys = symbols.select("symbol_id", F.explode(told).alias("k")).select("symbol_id", "k.token", "k.kind").distinct()
    asked = queries.select(Q, F.explode(F.array_distinct(code_tokens(F.col("query")))).alias("token"))
    n = lambda kind: F.count_if(F.col("kind") == kind)
    score = F.when(n("name") > 0, 10.0).otherwise(0.0) + 2.0 * n("qualified") + F.when(n("file") > 0, 5.0).when(n("stem") > 0, 4.0).otherwise(0.0)
    scored = keys.join(asked, "token").groupBy(Q, "symbol_id").agg(score.alias("score"))
    return retrieval.file_aggregate(scored.join(symbols, "symbol_id").withColumn("ord", F.col("symbol_id")), top_k, by=Q)


def graph_branch(symbols: DataFrame, like: DataFrame, words: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    both = like.filter(F.col("ord.k0") <= SEEDS).withColumn("b", F.lit(0)).unionByName(words.filter(F.col("ord.k0") <= SEEDS).withColumn("b", F.lit(1)))
    first = both.groupBy(Q, "symbol_id").agg(F.min(F.struct("b", "ord")).alias("at"))
    seeds = first.withColumn("seed_ord", F.row_number().over(Window.partitionBy(Q).orderBy("at.b", "at.ord")))
    named = seeds.join(symbols.select("symbol_id", "qualified_name"), "symbol_id").select(F.struct(Q, "seed_ord").alias("tag"), F.col("qualified_name").alias("node"))
    rows = graph.bfs_from(edges, named, "tag", hops).join(symbols.select("symbol_id", F.col("qualified_name").alias("node")), "node").select("tag.*", "depth", "symbol_id")
    return _branch(rows, 4, "graph", F.lit(GRAPH), ["seed_ord", "depth", "symbol_id"])


def trace_branch(symbols: DataFrame, queries: DataFrame, edges: DataFrame, imports: DataFrame) -> DataFrame:
    frames = queries.filter(is_stack_trace(F.col("query"))).select(Q, F.posexplode(loose_frames(F.col("query"))).alias("frame", "f")).select(Q, "frame", "f.*").filter("function_name is not null and file_path is not null")
    path, own = F.lower(F.col("s.file_path")), F.lower(F.col("t.file_path"))
    direct = (symbols.alias("s").join(frames.alias("t"), F.col("s.name") == F.col("t.function_name")).filter((path == own) | F.endswith(path, F.substring_index(F.translate(own, "\\", "/"), "/", -1)))
              .select(Q, "frame", F.col("s.symbol_id").alias("symbol_id"), F.col("s.qualified_name").alias("node"), F.col("s.file_path").alias("file_path")))
    starts = direct.groupBy(Q, "node").agg(F.min(F.struct("frame", "symbol_id")).alias("o")).select(Q, F.struct(F.col("o.frame").alias("frame"), F.col("o.symbol_id").alias("match")).alias("tag"), "node")
    near = graph.first_reach(edges, starts, "tag", 2, Q).join(symbols.select("symbol_id", F.col("qualified_name").alias("node")), "node").select(Q, "tag.*", F.lit(1).alias("phase"), "depth", "symbol_id")
    files = direct.select(Q, "frame", F.col("symbol_id").alias("match"), "file_path").join(imports.select(F.col("path").alias("file_path"), "module_path", F.coalesce("line_number", F.lit(0)).alias("depth")), "file_path")
    targets = files.groupBy(Q, F.concat(F.lower("module_path"), F.lit(".py")).alias("tail")).agg(F.min(F.struct("frame", "match", "depth")).alias("o"))
    imported = retrieval.ending_with(symbols, targets).select(Q, "o.frame", "o.match", F.lit(2).alias("phase"), "o.depth", "symbol_id")
    every = direct.select(Q, "frame", F.col("symbol_id").alias("match"), F.lit(0).alias("phase"), F.lit(0).alias("depth"), "symbol_id").unionByName(near).unionByName(imported)
    first = every.groupBy(Q, "symbol_id").agg(F.min(F.struct("frame", "match", "phase", "depth")).alias("at"))
    pick = lambda a, b, c: F.when(F.col("at.phase") == 0, a).when(F.col("at.phase") == 1, b).otherwise(c)
    order = retrieval._order(*[F.col(f"at.{c}") for c in ("frame", "match", "phase", "depth")], F.col("symbol_id"))
    return first.select(Q, F.lit(0).alias("branch_ord"), order.alias("ord"), "symbol_id", pick(TRACE_DIRECT, TRACE_GRAPH, TRACE_IMPORT).cast("double").alias("score"), pick("trace_direct", "trace_graph", "trace_import").alias("source"))


def branches(symbols: DataFrame, queries: DataFrame, top_k: int, edges: DataFrame | None = None, imports: DataFrame | None = None, hops: int = 2, index: bm25.Bm25Index | None = None) -> DataFrame:
    words, like = lexical(symbols, queries, OVERFETCH * top_k, index)
    parts = [words, like]
    if edges is not None:
        parts.append(graph_branch(symbols, like, words, edges, hops))
        if imports is not None:
            parts.append(trace_branch(symbols, queries, edges, imports))
    return reduce(DataFrame.unionByName, parts)


def hybrid(symbols: DataFrame, queries: DataFrame, top_k: int, **sides) -> DataFrame:
    rows = branches(symbols, queries, top_k, **sides)
    fused = retrieval.rrf(rows.select(Q, "source", F.col("symbol_id").alias("key"), "score", F.struct("branch_ord", "ord").alias("ord")), by=Q)
    named = fused.select(Q, F.col("key").alias("symbol_id"), "score", "sources", F.col("key").alias("ord")).join(symbols.select("symbol_id", "file_path", "name", "qualified_name"), "symbol_id")
    return retrieval.file_aggregate(named, top_k, by=Q)


def full(symbols: DataFrame, queries: DataFrame, top_k: int, corrected: bool = False, **sides) -> DataFrame:
    merged = retrieval.merge_candidates(branches(symbols, queries, top_k, **sides), Q).join(queries.select(Q, F.col("query").alias("_query")), Q)
    scored = retrieval.rerank(merged, symbols, F.col("_query"), corrected)
    return retrieval.file_aggregate(scored.withColumn("ord", F.struct(-F.round("score", 9), "at")), top_k, by=Q)


def retrieve(symbols: DataFrame, queries: DataFrame, top_k: int, mode: str = "full", **sides) -> DataFrame:
    """Files of every query in rank order (``rank`` from 1)."""
    if mode == "keyword_only":
        return keyword_only(symbols, queries, top_k, sides.get("index"))
    if mode == "symbol_only":
        return symbol_only(symbols, queries, top_k)
    if mode in ("hybrid", "full"):
        return (hybrid if mode == "hybrid" else full)(symbols, queries, top_k, **sides)
    raise ValueError(f"unknown mode {mode!r}")
