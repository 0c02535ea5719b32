"""Ranked retrieval over a symbol table: substring search, rank fusion, candidate merge, rerank, file aggregation.

``symbols`` has (symbol_id, name, qualified_name, type, file_path, start_line, end_line, docstring, signature). A result branch is a
frame of (branch_ord, ord, symbol_id, score, source): branches are unioned in a fixed order, and every tie that insertion order would
decide is decided by (branch_ord, ord). Query-side features are literals, so they need no join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loreline.functions.text import code_tokens, normalize_path, symbol_text, token_overlap
from loreline.functions.trace import is_stack_trace, loose_error, loose_frames
from loreline.operators import bm25, graph, vector

# Scores of the branches, weights of the rerank and of the symbol mode.
KEYWORD, GRAPH, TRACE_DIRECT, TRACE_GRAPH, TRACE_IMPORT = 1.0, 0.5, 1.2, 0.9, 0.8
RRF_K, OVERFETCH, SEEDS = 60, 4, 3


def like_search(rows: DataFrame, query: str, limit: int, columns: tuple[str, ...] = ("name", "qualified_name"), key: str = "symbol_id") -> DataFrame:
    """Rows in which a column contains the query, ASCII case folded, wildcards literal; the first ``limit`` by key."""
    hit = reduce(lambda a, b: a | b, [F.contains(F.lower(F.col(c)), F.lower(F.lit(query))) for c in columns])
    return rows.filter(hit).orderBy(key).limit(limit)


def rrf(ranked: DataFrame, k: int = RRF_K, by: str | None = None) -> DataFrame:
    """Reciprocal rank fusion of (source, key, score, ord): key, score, sources, best_source.

    Rank is by score within a source, ties by ord. A key repeated within a source keeps its last rank, and every occurrence adds.
    """
    part = [by] if by else []
    order = Window.partitionBy(*part, "source").orderBy(F.desc("score"), "ord")
    per = (ranked.withColumn("rank", F.row_number().over(order)).groupBy(*part, "source", "key")
           .agg(F.max("rank").alias("rank"), F.count(F.lit(1)).alias("times"), F.max("score").alias("top"), F.min("ord").alias("ord")))
    return per.groupBy(*part, "key").agg(
        F.sum(F.col("times") / (F.lit(k) + F.col("rank"))).alias("score"),
        F.array_join(F.sort_array(F.collect_set("source")), "+").alias("sources"),
        F.min_by("source", F.struct(-F.col("top"), "ord")).alias("best_source"))


def file_aggregate(rows: DataFrame, top_k: int | None = None, path: str = "file_path", member: str = "symbol_id", by: str | None = None) -> DataFrame:
    """Group results (path, score, ord, member; ``ord`` of any type that sorts) by normalised path: best score plus a tenth of the others'; empty paths go.

    The first of the best (strictly greater wins) gives the row; members are listed in arrival order.
    """
    part = [by] if by else []
    norm = rows.withColumn("norm_path", normalize_path(F.col(path))).filter("norm_path is not null and norm_path <> ''")
    out = norm.groupBy(*part, "norm_path").agg(
        (F.max("score") + 0.1 * (F.sum("score") - F.max("score"))).alias("score"),
        F.min_by(member, F.struct(-F.col("score"), "ord")).alias("best"),
        F.transform(F.array_sort(F.collect_list(F.struct("ord", F.col(member).alias("m")))), lambda x: x["m"]).alias("members"),
        F.min("ord").alias("ord"))
    if top_k is None:
        return out
    if not by:
        return out.orderBy(F.desc(F.round("score", 9)), "ord").limit(top_k)
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(F.round("score", 9)), "ord"))).filter(F.col("rank") <= top_k)


def merge_candidates(branches: DataFrame, *by: str) -> DataFrame:
    """One row a symbol (and query, if ``by`` names one): score of the first arrival (branch_ord, ord), all sources."""
    first = F.struct("branch_ord", "ord")
    return branches.groupBy(*by, "symbol_id").agg(F.min_by("score", first).alias("score"), F.min(first).alias("at"), F.sort_array(F.collect_set("source")).alias("sources"), F.max(F.when(F.col("source") == "vector", F.col("score"))).alias("vector_score"), F.max(F.when(F.col("source") == "bm25", F.col("score"))).alias("bm25_score"))


def _order(*keys: Column) -> Column:
    """Place within a branch: up to five numbers, compared in turn. No window ranks a branch, which may hold a share of all symbols."""
    return F.struct(*[(keys[j] if j < len(keys) else F.lit(0)).cast("double" if j == 0 else "long").alias(f"k{j}") for j in range(5)])


def _branch(rows: DataFrame, at: int, source: str, score: Column, order: list[str]) -> DataFrame:
    return rows.select(F.lit(at).alias("branch_ord"), _order(*[F.col(c) for c in order]).alias("ord"), "symbol_id", score.cast("double").alias("score"), F.lit(source).alias("source"))


def _top(rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows of a branch that a limit bounds, numbered from 1."""
    return rows.withColumn("at", F.row_number().over(Window.orderBy(*order)))


def index_text() -> Column:
    """What the lexical index holds of a symbol."""
    return symbol_text(F.col("name"), F.col("qualified_name"), F.col("docstring"), F.col("signature"))


def lexical(symbols: DataFrame, query: str, k: int, text: Column | None = None, index: bm25.Bm25Index | None = None) -> tuple[DataFrame, DataFrame]:
    """Branches bm25 and keyword, ``k`` rows at most each. A stored ``index`` of the symbols' text saves reading it all."""
    asked = symbols.sparkSession.createDataFrame([(0, query)], "query_id int, query string")
    if index is not None:
        found = bm25.search_index(index, asked, k)
    else:
        found = bm25.search(symbols.select("symbol_id", (text if text is not None else index_text()).alias("text")), asked, k, "symbol_id")
    return (_branch(found.select(F.col("doc_id").alias("symbol_id"), "score", "rank"), 1, "bm25", F.col("score"), ["rank"]),
            _branch(_top(like_search(symbols, query, k), ["symbol_id"]), 2, "keyword", F.lit(KEYWORD), ["at"]))


def keyword_only(symbols: DataFrame, query: str, top_k: int, text: Column | None = None, index: bm25.Bm25Index | None = None) -> DataFrame:
    """Substring hits, then BM25 hits not yet seen; the score falls by 0.01 a place (no floor); files."""
    words, like = lexical(symbols, query, OVERFETCH * top_k, text, index)
    both = like.withColumn("b", F.lit(0)).unionByName(words.withColumn("b", F.lit(1)))
    first = both.groupBy("symbol_id").agg(F.min(F.struct("b", "ord")).alias("at"))
    ranked = first.withColumn("ord", F.row_number().over(Window.orderBy("at.b", "at.ord")).cast("long"))  # at most 8 k rows
    rows = ranked.withColumn("score", F.lit(1.0) - 0.01 * (F.col("ord") - 1)).join(symbols, "symbol_id")
    return file_aggregate(rows, top_k)


def symbol_scores(symbols: DataFrame, query: str) -> DataFrame:
    """Score of every symbol: 10 for its name, 2 a shared qualified token, 5 for the file name, else 4 for its stem; positive ones only."""
    asked = code_tokens(F.lit(query))
    file = F.substring_index(normalize_path(F.coalesce("file_path", F.lit(""))), "/", -1)
    score = (F.when(F.array_contains(asked, F.lower("name")), 10.0).otherwise(0.0)
             + 2.0 * F.size(F.array_intersect(asked, code_tokens(F.col("qualified_name"))))
             + F.when(F.array_contains(asked, file), 5.0).when(F.array_contains(asked, F.regexp_replace(file, r"\.py$", "")), 4.0).otherwise(0.0))
    return symbols.withColumn("score", score).filter("score > 0")


def symbol_only(symbols: DataFrame, query: str, top_k: int) -> DataFrame:
    return file_aggregate(symbol_scores(symbols, query).withColumn("ord", F.col("symbol_id")), top_k)


def graph_branch(symbols: DataFrame, seeds: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """Symbols within ``hops`` of each seed (symbol_id, seed_ord); a symbol reached from several seeds is listed for each."""
    named = seeds.join(symbols.select("symbol_id", "qualified_name"), "symbol_id").select("seed_ord", F.col("qualified_name").alias("node"))
    reach = graph.bfs_from(edges, named, "seed_ord", hops)
    rows = reach.join(symbols.select("symbol_id", F.col("qualified_name").alias("node")), "node")
    return _branch(rows, 4, "graph", F.lit(GRAPH), ["seed_ord", "depth", "symbol_id"])


def seeds_of(like: DataFrame, words: DataFrame) -> DataFrame:
    """The first three of each list, in that order, once each."""
    both = like.filter(F.col("ord.k0") <= SEEDS).withColumn("b", F.lit(0)).unionByName(words.filter(F.col("ord.k0") <= SEEDS).withColumn("b", F.lit(1)))
    first = both.groupBy("symbol_id").agg(F.min(F.struct("b", "ord")).alias("at"))
    return first.select("symbol_id", F.row_number().over(Window.orderBy("at.b", "at.ord")).alias("seed_ord"))


def ending_with(symbols: DataFrame, targets: DataFrame) -> DataFrame:
    """Targets (tail, ...) with every symbol_id whose path ends with the tail, case folded: an equality between tails and all ends of the paths."""
    path = F.lower("file_path")
    n = F.length("p")
    paths = symbols.select(path.alias("p")).distinct().filter("p <> ''")
    ends = paths.select("p", F.explode(F.transform(F.sequence(F.lit(1), n), lambda k: F.substring("p", k, n))).alias("tail"))
    return ends.join(targets, "tail").join(symbols.select("symbol_id", path.alias("p")), "p")


def trace_branch(symbols: DataFrame, edges: DataFrame, imports: DataFrame, query: str) -> DataFrame:
    """Symbols of a trace's frames (1.2), their two-hop neighbours (0.9), symbols of files they import (0.8); first emission counts."""
    spark = symbols.sparkSession
    frames = spark.range(1).select(F.posexplode(F.when(is_stack_trace(F.lit(query)), loose_frames(F.lit(query))).otherwise(F.slice(loose_frames(F.lit(query)), 1, 0))).alias("frame", "f")).select("frame", "f.*").filter("function_name is not null and file_path is not null")
    path, own = F.lower(F.col("s.file_path")), F.lower(F.col("t.file_path"))
    direct = (symbols.alias("s").join(F.broadcast(frames.alias("t")), F.col("s.name") == F.col("t.function_name"))  # one trace's frames
              .filter((path == own) | F.endswith(path, F.substring_index(F.translate(own, "\\", "/"), "/", -1)))
              .select("frame", F.col("s.symbol_id").alias("symbol_id"), F.col("s.qualified_name").alias("node"), F.col("s.file_path").alias("file_path")))
    near = graph.first_reach(edges, direct.groupBy("node").agg(F.min(F.struct("frame", "symbol_id")).alias("o")).select(F.col("o"), "node"), "o", 2)
    neighbours = near.join(symbols.select("symbol_id", F.col("qualified_name").alias("node")), "node").select(F.col("o.frame").alias("frame"), F.col("o.symbol_id").alias("match"), F.lit(1).alias("phase"), "depth", "symbol_id")
    files = direct.select("frame", F.col("symbol_id").alias("match"), "file_path").join(imports.select(F.col("path").alias("file_path"), "module_path", F.coalesce("line_number", F.lit(0)).alias("depth")), "file_path")
    targets = files.groupBy(F.concat(F.lower("module_path"), F.lit(".py")).alias("tail")).agg(F.min(F.struct("frame", "match", "depth")).alias("o"))  # a tail gives the same symbols to all
    imported = ending_with(symbols, targets).select("o.frame", "o.match", F.lit(2).alias("phase"), "o.depth", "symbol_id")
    every = (direct.select("frame", F.col("symbol_id").alias("match"), F.lit(0).alias("phase"), F.lit(0).alias("depth"), "symbol_id").unionByName(neighbours).unionByName(imported))
    first = every.groupBy("symbol_id").agg(F.min(F.struct("frame", "match", "phase", "depth")).alias("at"))
    score = F.when(F.col("at.phase") == 0, TRACE_DIRECT).when(F.col("at.phase") == 1, TRACE_GRAPH).otherwise(TRACE_IMPORT)
    source = F.when(F.col("at.phase") == 0, "trace_direct").when(F.col("at.phase") == 1, "trace_graph").otherwise("trace_import")
    rows = first.select("symbol_id", "at", score.alias("score"), source.alias("source"))
    return rows.select(F.lit(0).alias("branch_ord"), _order(*[F.col(f"at.{c}") for c in ("frame", "match", "phase", "depth")], F.col("symbol_id")).alias("ord"), "symbol_id", "score", "source")


def branches(symbols: DataFrame, query: str, top_k: int, edges: DataFrame | None = None, imports: DataFrame | None = None, embeddings: DataFrame | None = None, query_vector: list[float] | None = None, hops: int = 2, text: Column | None = None, index: bm25.Bm25Index | None = None) -> DataFrame:
    """Bag union of all branches in the order trace, bm25, keyword, vector, graph."""
    words, like = lexical(symbols, query, OVERFETCH * top_k, text, index)
    parts = [words, like]
    if embeddings is not None and query_vector is not None:
        near = vector.knn(embeddings.withColumnRenamed("symbol_id", "id"), query_vector, OVERFETCH * top_k)
        parts.append(_branch(near.select(F.col("id").alias("symbol_id"), "distance"), 3, "vector", vector.similarity(F.col("distance")), ["distance", "symbol_id"]))
    if edges is not None:
        parts.append(graph_branch(symbols, seeds_of(like, words), edges, hops))
        if imports is not None:
            parts.append(trace_branch(symbols, edges, imports, query))
    return reduce(DataFrame.unionByName, parts)


def hybrid(symbols: DataFrame, query: str, top_k: int, **sides) -> DataFrame:
    """Reciprocal rank fusion of all branches, then files."""
    rows = branches(symbols, query, top_k, **sides)
    fused = rrf(rows.select("source", F.col("symbol_id").alias("key"), "score", F.struct("branch_ord", "ord").alias("ord")))
    named = fused.select(F.col("key").alias("symbol_id"), "score", "sources", F.col("key").alias("ord")).join(symbols.select("symbol_id", "file_path", "name", "qualified_name"), "symbol_id")
    return file_aggregate(named, top_k)


def rerank(candidates: DataFrame, symbols: DataFrame, query: str | Column, corrected: bool = False) -> DataFrame:
    """Add semantic, keyword, path, symbol, stacktrace and the final score to merged candidates.

    The first arrival's score stands for both the vector and the BM25 score, as in the scoring rule that is matched; ``corrected``
    uses each branch's own score.
    """
    q = query if isinstance(query, Column) else F.lit(query)
    asked = code_tokens(q)
    rows = candidates.withColumnRenamed("score", "first_score").join(symbols, "symbol_id")
    doc = code_tokens(symbol_text(F.col("name"), F.col("qualified_name"), F.col("docstring"), F.col("signature")))
    path = normalize_path(F.coalesce("file_path", F.lit("")))
    has = lambda s: F.array_contains("sources", F.lit(s))
    own = lambda s: F.col(f"{s}_score") if corrected else F.col("first_score")
    semantic = F.when(has("vector"), 10.0 * own("vector")).otherwise(0.0)
    keyword = 10.0 * token_overlap(asked, doc) + F.when(has("bm25"), own("bm25") / 5.0).otherwise(0.0)
    inside = F.size(F.filter(asked, lambda t: (F.endswith(t, F.lit(".py")) | (F.length(t) > 3)) & F.contains(path, t)))
    paths = 15.0 * token_overlap(asked, code_tokens(path)) + 5.0 * inside
    symbol = F.when(F.array_contains(asked, F.lower("name")), 15.0).otherwise(0.0) + F.when(F.array_contains(asked, F.lower("qualified_name")), 25.0).otherwise(0.0)
    trace = is_stack_trace(q)
    frames = loose_frames(q)

    def of_frame(f):
        p = normalize_path(F.coalesce(f["file_path"], F.lit("")))
        base = F.when(p == "", 0.0).when(p == path, 100.0).when(F.endswith(path, p) | F.endswith(p, path), 80.0).when(F.substring_index(p, "/", -1) == F.substring_index(path, "/", -1), 60.0).otherwise(0.0)
        name = F.when(f["function_name"] == F.col("name"), 50.0).otherwise(0.0)
        line = F.when(f["line_number"].between(F.col("start_line"), F.col("end_line")), 40.0).otherwise(0.0)
        return F.when(base > 0, base + name + line).otherwise(0.0)

    said = code_tokens(loose_error(q)["error_message"])
    of_frames = F.aggregate(F.transform(frames, of_frame), F.lit(0.0), lambda a, x: a + x)
    about_test = F.contains(path, F.lit("test")) & ~F.exists(frames, lambda f: F.contains(F.lower(F.coalesce(f["file_path"], F.lit(""))), F.lit("test")))
    stack = F.when(trace, of_frames + F.when(F.size(F.array_intersect(said, doc)) > 0, 20.0).otherwise(0.0) - F.when(about_test, 20.0).otherwise(0.0)).otherwise(0.0)
    out = rows.withColumns({"semantic": semantic, "keyword": keyword, "path": paths, "symbol": symbol, "stacktrace": stack})
    return out.withColumn("score", F.col("semantic") + F.col("keyword") + F.col("path") + F.col("symbol") + F.col("stacktrace"))


def full(symbols: DataFrame, query: str, top_k: int, corrected: bool = False, **sides) -> DataFrame:
    """Merge all branches by symbol, rerank, files."""
    scored = rerank(merge_candidates(branches(symbols, query, top_k, **sides)), symbols, query, corrected)
    return file_aggregate(scored.withColumn("ord", F.struct(-F.round("score", 9), "at")), top_k)


def retrieve(symbols: DataFrame, query: str, top_k: int, mode: str = "full", **sides) -> DataFrame:
    if mode == "keyword_only":
        return keyword_only(symbols, query, top_k, index=sides.get("index"))
    if mode == "symbol_only":
        return symbol_only(symbols, query, top_k)
    if mode == "hybrid":
        return hybrid(symbols, query, top_k, **sides)
    if mode == "full":
        return full(symbols, query, top_k, **sides)
    raise ValueError(f"unknown mode {mode!r}")


def result_confidence(scores: DataFrame) -> DataFrame:
    """One row: the best of (score if at most 1, else score / 200 up to 0.99), within 0 and 1; 0 without results."""
    each = F.when(F.col("score") <= 1, F.col("score")).otherwise(F.least(F.lit(0.99), F.col("score") / 200))
    return scores.agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.max(each), F.lit(0.0)))).alias("confidence"))
