"""The query catalogue: one entry for each operator of the library, with its oracle where SQL can express it.

Tables hold no source code, so operators run on like-shaped columns or on text made from columns inside the query. Every query reads its
whole tables; limits stand only where a top-k is the feature.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loreline.functions import text as fx
from loreline.functions import trace as tr
from loreline.operators import batch, bm25, delta, evaluate, evidence, flow, freshness, graph, resolve, retrieval, skeleton, types, vector
from loreline.sources import files as fs
from loreline.sources import python_source as py
from loreline.sources.shared import checkpoint, dealt

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
ASKED = "the hand of thing"
PAIRS = 250_000  # pairs that one task tells apart: it keeps each of them twice, and what follows in the same task beside them


def query(sql: str | None = None):
    def keep(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return keep


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# ---------------------------------------------------------------- text search

_TOKENS = r"list_filter(string_split_regex(lower({0}), '[_.\s]+'), lambda x: x <> '')"


def _bm25_sql(docs: str, asked: str) -> str:
    """CTEs up to ``rk`` (query_id, doc_id, score, rank)."""
    return f"""
tok AS (SELECT doc_id, {_TOKENS.format("coalesce(text, '')")} AS t FROM ({docs})),
st AS (SELECT count(*) AS n, coalesce(avg(len(t)), 1.0) AS avgdl FROM tok),
post AS (SELECT doc_id, tk, l, count(*) AS tf FROM (SELECT doc_id, len(t) AS l, unnest(t) AS tk FROM tok) GROUP BY doc_id, tk, l),
df AS (SELECT tk, count(*) AS df FROM post GROUP BY tk),
q AS (SELECT query_id, tk, count(*) AS times FROM (SELECT query_id, unnest({_TOKENS.format("query")}) AS tk FROM ({asked})) GROUP BY query_id, tk),
sc AS (SELECT query_id, doc_id, sum(times * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / avgdl))) AS score FROM q JOIN df USING (tk) JOIN post USING (tk), st GROUP BY query_id, doc_id),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM sc WHERE score > 0)"""


_DOCS = "SELECT doc_id, text FROM documents"


@query(f"WITH {_bm25_sql(_DOCS, f'''SELECT 0 AS query_id, '{ASKED}' AS query''')} SELECT doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM rk WHERE rank <= 10")
def bm25_topk(spark, d):
    asked = spark.createDataFrame([(0, ASKED)], "query_id int, query string")
    return bm25.search(_t(spark, d, "documents"), asked, 10).select("doc_id", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {_bm25_sql(_DOCS, 'SELECT item_id AS query_id, text AS query FROM benchmark')} SELECT query_id, doc_id, round(score, 5) AS score, CAST(rank AS INTEGER) AS rank FROM rk WHERE rank <= 3")
def bm25_query_batch(spark, d):
    asked = _t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return bm25.search(_t(spark, d, "documents"), asked, 3).select("query_id", "doc_id", F.round("score", 5).alias("score"), "rank")


@query(f"SELECT count(*) AS n, round(avg(len({_TOKENS.format('text')})), 6) AS avgdl FROM documents")
def corpus_stats(spark, d):
    return bm25.corpus_stats(_t(spark, d, "documents")).select("n", F.round("avgdl", 6).alias("avgdl"))


@query(f"SELECT token, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({_TOKENS.format('text')}) AS token FROM documents) GROUP BY token")
def term_df(spark, d):
    return bm25.term_df(_t(spark, d, "documents"))


@query(f"SELECT doc_id, tk AS token, count(*) AS tf, n AS size FROM (SELECT doc_id, CAST(len(t) AS INTEGER) AS n, unnest(t) AS tk FROM (SELECT doc_id, {_TOKENS.format('text')} AS t FROM documents)) GROUP BY doc_id, tk, n")
def bm25_postings(spark, d):
    """All postings with the sizes of their documents, as they are stored."""
    return bm25.build_index(_t(spark, d, "documents")).postings.select("doc_id", "token", F.col("tf").cast("long").alias("tf"), "size")


@query(f"SELECT doc_id, tk AS token, count(*) AS tf FROM (SELECT doc_id, unnest({_TOKENS.format('text')}) AS tk FROM documents) GROUP BY doc_id, tk")
def bm25_index(spark, d):
    """All postings."""
    return bm25.build_index(_t(spark, d, "documents")).postings.select("doc_id", "token", F.col("tf").cast("long").alias("tf"))


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'red') OR contains(lower(p_type), 'red') ORDER BY p_partkey LIMIT 20")
def like_search(spark, d):
    return retrieval.like_search(_t(spark, d, "part"), "RED", 20, ("p_name", "p_type"), "p_partkey").select("p_partkey", "p_name")


_PLAIN = "list_distinct(list_filter(string_split_regex(lower({0}), '[^a-z0-9äöüßéèêçñáíóúà]+'), lambda x: length(x) > 1))"


@query(f"SELECT doc_id, round(len(list_intersect(q, t)) / len(q), 6) AS overlap FROM (SELECT doc_id, {_PLAIN.format('text')} AS t, {_PLAIN.format(f''''{ASKED}' ''')} AS q FROM documents) WHERE len(t) > 0 AND len(list_intersect(q, t)) > 0")
def token_overlap(spark, d):
    asked, own = fx.plain_tokens(F.lit(ASKED)), fx.plain_tokens(F.col("text"))
    # a generated column, as a filter on a plain one would be computed below it, from the text a second time
    return _t(spark, d, "documents").select("doc_id", F.explode(F.array(F.round(fx.token_overlap(asked, own), 6))).alias("overlap")).filter("overlap > 0")


# names here have no runs of capitals, so one pattern gives their camel parts
@query(r"""SELECT p_partkey, list_sort(list_distinct(list_filter(flatten(list_transform(string_split(x, ' '), lambda w: list_concat([lower(w)], list_transform(string_split_regex(w, '[/.\\\-_]+'), lambda t: lower(t)), list_transform(string_split(w, '_'), lambda t: lower(t)), list_transform(regexp_extract_all(w, '[A-Z]?[a-z]+'), lambda t: lower(t))))), lambda t: len(t) > 1))) AS tokens
FROM (SELECT p_partkey, 'src/' || replace(p_name, ' ', '_') || '/' || array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ') || 'Test.py' AS x FROM part)""")
def code_tokenize(spark, d):
    name = F.concat(F.lit("src/"), F.regexp_replace("p_name", " ", "_"), F.lit("/"), F.initcap("p_name"), F.lit("Test.py"))
    return _t(spark, d, "part").select("p_partkey", F.array_sort(fx.code_tokens(name)).alias("tokens"))


# ---------------------------------------------------------------- fusion, merge, files


def _two_lists(spark, d):
    docs = _t(spark, d, "documents")
    by_len = docs.select(F.lit("length").alias("source"), F.col("doc_id").alias("key"), F.col("n_chars").cast("double").alias("score"), F.col("doc_id").alias("ord"))
    by_mod = docs.select(F.lit("mod").alias("source"), F.col("doc_id").alias("key"), (F.col("doc_id") % 97).cast("double").alias("score"), F.col("doc_id").alias("ord"))
    return by_len.unionByName(by_mod)


_LISTS_SQL = "lists AS (SELECT 'length' AS source, doc_id AS key, CAST(n_chars AS DOUBLE) AS score, doc_id AS ord FROM documents UNION ALL SELECT 'mod', doc_id, CAST(doc_id % 97 AS DOUBLE), doc_id FROM documents)"


@query(f"WITH {_LISTS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, ord) AS rank FROM lists) SELECT key, round(sum(1.0 / (60 + rank)), 9) AS score, string_agg(DISTINCT source, '+' ORDER BY source) AS sources FROM r GROUP BY key")
def rrf_fusion(spark, d):
    return retrieval.rrf(_two_lists(spark, d)).select("key", F.round("score", 9).alias("score"), "sources")


@query("SELECT lower(source) AS norm_path, round(max(v) + 0.1 * (sum(v) - max(v)), 4) AS score, arg_max(doc_id, v * 1e9 - doc_id) AS best, CAST(count(*) AS INTEGER) AS members FROM (SELECT *, CAST(n_chars AS DOUBLE) AS v FROM documents) WHERE source <> '' GROUP BY lower(source)")
def file_aggregate(spark, d):
    rows = _t(spark, d, "documents").select(F.col("source").alias("file_path"), F.col("n_chars").cast("double").alias("score"), F.col("doc_id").alias("ord"), F.col("doc_id").alias("symbol_id"))
    return retrieval.file_aggregate(rows).select("norm_path", F.round("score", 4).alias("score"), "best", F.size("members").alias("members"))


@query(f"WITH {_LISTS_SQL}, b AS (SELECT *, CASE source WHEN 'mod' THEN 0 ELSE 1 END AS branch_ord FROM lists WHERE source = 'length' OR key % 3 = 0) SELECT key AS symbol_id, arg_min(score, branch_ord) AS score, string_agg(source, '+' ORDER BY source) AS sources FROM b GROUP BY key")
def candidate_merge(spark, d):
    rows = _two_lists(spark, d).filter("source = 'length' or key % 3 = 0").select(F.when(F.col("source") == "mod", 0).otherwise(1).alias("branch_ord"), "ord", F.col("key").alias("symbol_id"), "score", "source")
    return retrieval.merge_candidates(rows).select("symbol_id", "score", F.array_join("sources", "+").alias("sources"))


def _doc_symbols(spark, d):
    name = F.split("text", " ")[0]
    return _t(spark, d, "documents").select(F.col("doc_id").alias("symbol_id"), name.alias("name"), F.concat_ws(".", "source", "lang", name).alias("qualified_name"), F.lit("function").alias("type"), F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit(".py")).alias("file_path"), F.lit(1).alias("start_line"), F.lit(9).alias("end_line"), F.col("text").alias("docstring"), F.lit("").alias("signature"))


_SYM_SQL = "sym AS (SELECT doc_id AS symbol_id, string_split(text, ' ')[1] AS name, source || '.' || lang || '.' || string_split(text, ' ')[1] AS qualified_name, source || '/' || lang || '.py' AS file_path, text AS docstring FROM documents)"
_SYM_DOCS = "SELECT symbol_id AS doc_id, name || ' ' || qualified_name || ' ' || docstring || ' ' AS text FROM sym"
_LEX_SQL = f"{_SYM_SQL}, {_bm25_sql(_SYM_DOCS, '''SELECT 0 AS query_id, 'the' AS query''')}, lk AS (SELECT symbol_id, row_number() OVER (ORDER BY symbol_id) AS ord FROM sym WHERE contains(lower(name), 'the') OR contains(lower(qualified_name), 'the') QUALIFY ord <= 20), bm AS (SELECT doc_id AS symbol_id, score, rank AS ord FROM rk WHERE rank <= 20)"
_FILES_SQL = "SELECT norm_path, score, best, CAST(row_number() OVER (ORDER BY s DESC, ord) AS INTEGER) AS place FROM (SELECT lower(file_path) AS norm_path, round(CAST(max(score) + 0.1 * (sum(score) - max(score)) AS DOUBLE), 6) AS score, round(max(score) + 0.1 * (sum(score) - max(score)), 9) AS s, arg_max(symbol_id, {order}) AS best, min(ord) AS ord FROM m GROUP BY lower(file_path)) QUALIFY place <= 5"


def _files(found):
    return found.select("norm_path", F.round("score", 6).alias("score"), "best", F.row_number().over(Window.orderBy(F.desc(F.round(found["score"], 9)), "ord")).alias("place"))


@query(f"WITH {_LEX_SQL}, u AS (SELECT symbol_id, min(b * 1000 + ord) AS pos FROM (SELECT symbol_id, 0 AS b, ord FROM lk UNION ALL SELECT symbol_id, 1, ord FROM bm) GROUP BY symbol_id), m AS (SELECT symbol_id, file_path, row_number() OVER (ORDER BY pos) AS ord, 1.0 - 0.01 * (row_number() OVER (ORDER BY pos) - 1) AS score FROM u JOIN sym USING (symbol_id)) {_FILES_SQL.format(order='score')}")
def keyword_only(spark, d):
    return _files(retrieval.keyword_only(_doc_symbols(spark, d), "the", 5))


@query(f"WITH {_LEX_SQL}, r AS (SELECT symbol_id, sum(1.0 / (60 + ord)) AS score FROM (SELECT symbol_id, ord FROM lk UNION ALL SELECT symbol_id, ord FROM bm) GROUP BY symbol_id), m AS (SELECT symbol_id, file_path, score, symbol_id AS ord FROM r JOIN sym USING (symbol_id)) {_FILES_SQL.format(order='score * 1e12 - symbol_id')}")
def hybrid(spark, d):
    return _files(retrieval.hybrid(_doc_symbols(spark, d), "the", 5))


def _part_symbols(spark, d):
    name = F.split("p_name", " ")[1]
    path = F.concat(F.lit("parts/"), F.lower("p_type"), F.lit("/"), name, F.lit(".py"))
    return _t(spark, d, "part").select(F.col("p_partkey").alias("symbol_id"), name.alias("name"), F.concat_ws(".", F.lower("p_type"), F.regexp_replace("p_name", " ", ".")).alias("qualified_name"), F.lit("function").alias("type"), path.alias("file_path"), F.lit(1).alias("start_line"), F.lit(9).alias("end_line"), F.lit("").alias("docstring"), F.lit("").alias("signature"))


# qualified names here are lower-case words and dots, so their tokens are the whole name and its parts
_PART_SQL = "sym AS (SELECT p_partkey AS symbol_id, string_split(p_name, ' ')[2] AS name, lower(p_type) || '.' || replace(p_name, ' ', '.') AS qualified_name, 'parts/' || lower(p_type) || '/' || string_split(p_name, ' ')[2] || '.py' AS file_path FROM part), tk AS (SELECT *, list_distinct(list_append(string_split(qualified_name, '.'), qualified_name)) AS qt FROM sym)"


@query(f"WITH {_PART_SQL}, s AS (SELECT *, 10.0 * (name IN ('red', 'widget')) ::INT + 2.0 * len(list_intersect(qt, ['red', 'widget'])) + 4.0 * (name IN ('red', 'widget'))::INT AS score, symbol_id AS ord FROM tk), m AS (SELECT * FROM s WHERE score > 0) {_FILES_SQL.format(order='score * 1e12 - symbol_id')}")
def symbol_only(spark, d):
    return _files(retrieval.symbol_only(_part_symbols(spark, d), "red widget", 5))


def _asked_parts(spark, d):
    """A query for each type and brand number that some part of every fifth size has."""
    parts = _t(spark, d, "part").filter("p_size % 5 = 0")
    kind = F.lower("p_type")
    return parts.select(F.concat_ws(" ", kind, F.split("p_brand", "#")[1], F.lit("widget")).alias("query_id")).distinct().withColumn("query", F.col("query_id"))


_ASKED_SQL = "asked AS (SELECT DISTINCT lower(p_type) || ' ' || string_split(p_brand, '#')[2] || ' widget' AS query_id, [lower(p_type), string_split(p_brand, '#')[2], 'widget'] AS q FROM part WHERE p_size % 5 = 0)"


@query(f"""WITH {_PART_SQL}, {_ASKED_SQL}, s AS (SELECT query_id, symbol_id, file_path, (CASE WHEN list_contains(q, name) THEN 10.0 ELSE 0 END) + 2.0 * len(list_intersect(qt, q)) + (CASE WHEN list_contains(q, name) THEN 4.0 ELSE 0 END) AS score FROM asked, tk),
g AS (SELECT query_id, lower(file_path) AS norm_path, round(CAST(max(score) + 0.1 * (sum(score) - max(score)) AS DOUBLE), 6) AS score, arg_max(symbol_id, score * 1e12 - symbol_id) AS best, min(symbol_id) AS ord FROM s WHERE score > 0 GROUP BY ALL)
SELECT query_id, norm_path, score, best, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ord) AS INTEGER) AS rank FROM g QUALIFY rank <= 5""")
def symbol_only_batch(spark, d):
    """Mode symbol_only for a table of queries, in one plan."""
    return batch.symbol_only(_part_symbols(spark, d), _asked_parts(spark, d), 5).select("query_id", "norm_path", F.round("score", 6).alias("score"), "best", "rank")


@query("""WITH asked AS (SELECT DISTINCT substr(p_name, 2, 5) AS query_id FROM part WHERE p_size % 5 = 0 UNION SELECT DISTINCT upper(substr(p_type, 1, 2)) FROM part), h AS (SELECT query_id, p_partkey, row_number() OVER (PARTITION BY query_id ORDER BY p_partkey) AS place FROM asked JOIN part ON contains(lower(p_name), lower(query_id)) OR contains(lower(p_type), lower(query_id)))
SELECT query_id, p_partkey, CAST(place AS INTEGER) AS place FROM h WHERE place <= 20""")
def like_search_batch(spark, d):
    """Substring search for a table of queries by their rarest trigram; those of two characters meet all rows."""
    part = _t(spark, d, "part")
    asked = part.filter("p_size % 5 = 0").select(F.substring("p_name", 2, 5).alias("query_id")).union(part.select(F.upper(F.substring("p_type", 1, 2)))).distinct()
    return batch.like_search(part, asked.withColumn("query", F.col("query_id")), 20, ("p_name", "p_type"), "p_partkey").withColumnRenamed("at", "place")


@query(f"""WITH {_PART_SQL}, {_bm25_sql("SELECT symbol_id AS doc_id, name || ' ' || qualified_name AS text FROM sym", "SELECT 0 AS query_id, 'widget' AS query")},
lk AS (SELECT symbol_id, row_number() OVER (ORDER BY symbol_id) AS ord FROM sym WHERE contains(lower(name), 'widget') OR contains(lower(qualified_name), 'widget') QUALIFY ord <= 20),
bm AS (SELECT doc_id AS symbol_id, score, rank AS ord FROM rk WHERE rank <= 20),
c AS (SELECT symbol_id, arg_min(score, pos) AS first_score, min(pos) AS pos, bool_or(b = 1) AS bm FROM (SELECT symbol_id, score, ord, 1 AS b, 1000 + ord AS pos FROM bm UNION ALL SELECT symbol_id, 1.0, ord, 2, 2000 + ord FROM lk) GROUP BY symbol_id),
f AS (SELECT c.*, sym.*, 10.0 + CASE WHEN bm THEN first_score / 5.0 ELSE 0 END AS keyword, 15.0 * (name = 'widget')::INT + 5.0 * contains(file_path, 'widget')::INT AS path, 15.0 * (name = 'widget')::INT AS symbol FROM c JOIN sym USING (symbol_id)),
m AS (SELECT symbol_id, file_path, keyword + path + symbol AS score, row_number() OVER (ORDER BY round(keyword + path + symbol, 9) DESC, pos) AS ord FROM f) {_FILES_SQL.format(order='score * 1e9 - ord')}""")
def full_rerank(spark, d):
    return _files(retrieval.full(_part_symbols(spark, d), "widget", 5))


@query()
def full_all_branches(spark, d):
    """Mode full with trace, vector and graph branches on part symbols."""
    symbols = _part_symbols(spark, d)
    edges = symbols.select(F.col("qualified_name").alias("src"), F.concat_ws(".", F.lit("kind"), "name").alias("dst")).distinct()
    imports = symbols.select(F.col("file_path").alias("path"), F.lit("widget").alias("module_path"), F.lit(1).alias("line_number")).distinct()
    vectors = _t(spark, d, "embeddings").select(F.col("vec_id").alias("symbol_id"), "embedding")
    asked = [float(x) for x in vectors.filter("symbol_id = 0").first()["embedding"]]
    trace = 'Traceback (most recent call last):\n  File "parts/promo/bolt.py", line 3, in bolt\nValueError: red widget missing'
    return retrieval.full(symbols, trace, 5, edges=edges, imports=imports, embeddings=vectors, query_vector=asked).select("norm_path", F.round("score", 4).alias("score"), "best")


@query("SELECT CAST(greatest(0.0, least(1.0, coalesce(max(CASE WHEN v <= 1 THEN v ELSE least(0.99, v / 200) END), 0.0))) AS DOUBLE) AS confidence FROM (SELECT n_chars % 150 + 0.5::DOUBLE AS v FROM documents)")
def result_confidence(spark, d):
    return retrieval.result_confidence(_t(spark, d, "documents").select((F.col("n_chars") % 150 + 0.5).cast("double").alias("score")))


@query("WITH q AS (SELECT list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(list_distance(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), q.e), 6) AS distance FROM embeddings, q ORDER BY round(list_distance(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), q.e), 9), vec_id LIMIT 10")
def vector_topk(spark, d):
    rows = _t(spark, d, "embeddings")
    asked = rows.filter("vec_id = 0").first()["embedding"]
    return vector.knn(rows, asked, 10, "vec_id").select("vec_id", F.round("distance", 6).alias("distance"))


@query("SELECT vec_id, CASE WHEN vec_id % 10 = 0 THEN label + 100 ELSE label END AS label FROM embeddings")
def vector_upsert(spark, d):
    rows = _t(spark, d, "embeddings").select("vec_id", "label")
    new = rows.filter("vec_id % 10 = 0")
    return vector.upsert(rows, new.withColumn("label", F.col("label") + 7).withColumn("ord", F.lit(0)).unionByName(new.withColumn("label", F.col("label") + 100).withColumn("ord", F.lit(1))), "vec_id")


# ---------------------------------------------------------------- graph


def _edges(spark, d):
    """region -> nation -> customer, supplier; supplier -> part."""
    nation, region = _t(spark, d, "nation"), _t(spark, d, "region")
    e = lambda df, a, b, kind, at: df.select(a.alias("src"), b.alias("dst"), F.lit(kind).alias("relation_type"), F.lit(1.0).alias("weight"), F.lit(at).alias("phase"))
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    items = _t(spark, d, "lineitem")
    sold = dealt(items.select("l_suppkey", "l_partkey"), items.count(), "l_suppkey", "l_partkey", most=PAIRS).distinct()
    parts = [e(nation.join(region, nation.n_regionkey == region.r_regionkey), key("R", "r_regionkey"), key("N", "n_nationkey"), "contains", 0),
             e(_t(spark, d, "customer"), key("N", "c_nationkey"), key("C", "c_custkey"), "contains", 1),
             e(_t(spark, d, "supplier"), key("N", "s_nationkey"), key("S", "s_suppkey"), "contains", 2),
             e(sold, key("S", "l_suppkey"), key("P", "l_partkey"), "calls", 3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


_EDGES_SQL = """edges AS (SELECT 'R' || r_regionkey AS src, 'N' || n_nationkey AS dst, 'contains' AS relation_type, 0 AS phase FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 'N' || c_nationkey, 'C' || c_custkey, 'contains', 1 FROM customer UNION ALL SELECT 'N' || s_nationkey, 'S' || s_suppkey, 'contains', 2 FROM supplier
UNION ALL SELECT DISTINCT 'S' || l_suppkey, 'P' || l_partkey, 'calls', 3 FROM lineitem),
nb AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges)"""


@query(f"WITH {_EDGES_SQL} SELECT relation_type, phase, count(*) AS n, count(DISTINCT src) AS sources FROM edges GROUP BY relation_type, phase")
def graph_edges(spark, d):
    return _edges(spark, d).groupBy("relation_type", "phase").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("src").alias("sources"))


@query("WITH e AS (SELECT 'S' || l_suppkey AS src, 'P' || l_partkey AS dst, l_linenumber AS phase, l_orderkey AS ord, l_quantity AS w FROM lineitem) SELECT src, dst, phase, ord, w FROM e QUALIFY row_number() OVER (PARTITION BY src, dst ORDER BY phase DESC, ord DESC, w) = 1")
def digraph_last_wins(spark, d):
    e = _t(spark, d, "lineitem").select(F.concat(F.lit("S"), "l_suppkey").alias("src"), F.concat(F.lit("P"), "l_partkey").alias("dst"), F.col("l_linenumber").alias("phase"), F.col("l_orderkey").alias("ord"), F.col("l_quantity").alias("w"))
    return graph.digraph(e.groupBy("src", "dst", "phase", "ord").agg(F.min("w").alias("w")))


@query(f"WITH {_EDGES_SQL}, d0 AS (SELECT 'N3' AS node, 0 AS depth), d1 AS (SELECT b AS node, 1 AS depth FROM nb WHERE a = 'N3'), d2 AS (SELECT b AS node, 2 AS depth FROM nb JOIN d1 ON a = node), al AS (SELECT * FROM d0 UNION ALL SELECT * FROM d1 UNION ALL SELECT * FROM d2) SELECT node, min(depth) AS depth FROM al GROUP BY node")
def bfs_k(spark, d):
    return graph.bfs_expand(_edges(spark, d), "N3", 2)


@query(f"WITH {_EDGES_SQL}, m AS (SELECT 'R1' AS node UNION SELECT b FROM nb WHERE a = 'R1' UNION SELECT y.b FROM nb x JOIN nb y ON x.b = y.a WHERE x.a = 'R1') SELECT src, dst, relation_type FROM edges WHERE src IN (SELECT node FROM m) AND dst IN (SELECT node FROM m)")
def subgraph(spark, d):
    edges = _edges(spark, d)
    return graph.subgraph(spark.createDataFrame([], "qualified_name string, type string, file_path string"), edges, graph.bfs_expand(edges, "R1", 2))[1].select("src", "dst", "relation_type")


def _calls(spark, d):
    """Suppliers call parts."""
    calls = _t(spark, d, "lineitem").select(F.col("l_suppkey").alias("caller_id"), (F.col("l_partkey") + 1_000_000).alias("callee_id"), F.lit("direct").alias("call_type"), F.lit(1.0).alias("confidence"), F.col("l_linenumber").alias("line_number"))
    symbols = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("symbol_id"), F.col("s_name").alias("qualified_name")).union(_t(spark, d, "part").select(F.col("p_partkey") + 1_000_000, F.concat(F.col("p_name"), F.lit("#"), F.col("p_partkey"))))
    return calls, symbols


@query("SELECT p_name || '#' || p_partkey AS qualified_name, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_suppkey = (SELECT min(s_suppkey) FROM supplier WHERE s_name = 'Supplier#000000003') GROUP BY ALL")
def callees(spark, d):
    return graph.callees(*_calls(spark, d), "Supplier#000000003").groupBy("qualified_name").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT s_name AS qualified_name, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey WHERE p_partkey = 7 GROUP BY ALL")
def callers(spark, d):
    calls, symbols = _calls(spark, d)
    name = symbols.filter("symbol_id = 1000007").first()["qualified_name"]
    return graph.callers(calls, symbols, name).groupBy("qualified_name").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'callees' AS direction, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_suppkey = 2")
def relations(spark, d):
    return graph.relations(*_calls(spark, d), "Supplier#000000002", "both").groupBy("direction").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH RECURSIVE {_EDGES_SQL}, p AS (SELECT 'R0' AS node, 0 AS length UNION SELECT dst, length + 1 FROM p JOIN edges ON src = node WHERE length < 10) SELECT node, min(length) AS length FROM p GROUP BY node")
def shortest_path(spark, d):
    return graph.path_lengths(_edges(spark, d), "R0")


# rounds of the recurrence until ranks move by less than 1e-12 in all
_PAGERANK_SQL = f"""WITH RECURSIVE {_EDGES_SQL}, e AS (SELECT DISTINCT src, dst FROM edges), nodes AS (SELECT src AS node FROM e UNION SELECT dst FROM e), c AS (SELECT count(*) AS n FROM nodes), deg AS (SELECT src, count(*) AS k FROM e GROUP BY src),
p AS (SELECT node, CAST(1.0 / n AS DOUBLE) AS r, 0 AS round, CAST(1 AS DOUBLE) AS moved FROM nodes, c
UNION ALL SELECT node, r, round, sum(abs(r - was)) OVER () AS moved FROM (SELECT v.node, v.round + 1 AS round, v.r AS was, 0.15 / n + 0.85 * (coalesce(i.x, 0) + l.x / n) AS r
FROM p v CROSS JOIN c CROSS JOIN (SELECT coalesce(sum(r), 0) AS x FROM p WHERE node NOT IN (SELECT src FROM deg)) l LEFT JOIN (SELECT dst, sum(r / k) AS x FROM p JOIN e ON node = src JOIN deg USING (src) GROUP BY dst) i ON i.dst = v.node WHERE v.moved >= 1e-12))
SELECT node, round(r, 9) AS rank FROM p WHERE round = (SELECT max(round) FROM p)"""


@query(_PAGERANK_SQL)
def pagerank_fixed(spark, d):
    edges = _edges(spark, d)
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    return graph.pagerank(nodes, edges).select("node", F.round("rank", 9).alias("rank"))


@query()
def pagerank_top(spark, d):
    edges = _edges(spark, d)
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    return graph.top_ranked(nodes, edges, 20).select("node", F.round("rank", 6).alias("rank"))


@query()
def communities(spark, d):
    return graph.communities(_edges(spark, d))


@query()
def modularity_communities(spark, d):
    return graph.modularity_communities(_edges(spark, d))


@query(f"WITH {_EDGES_SQL}, n AS (SELECT src AS q FROM edges UNION SELECT dst FROM edges) SELECT (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM edges) AS edges")
def graph_counts(spark, d):
    edges = _edges(spark, d)
    none = spark.createDataFrame([], "qualified_name string, type string, file_path string, line_count int")
    return graph.counts(graph.with_implicit_nodes(none, edges), edges)


# ---------------------------------------------------------------- freshness and tables


def _snapshots(spark, d):
    docs = _t(spark, d, "documents").select(F.concat(F.lit("d"), "doc_id").alias("path"), "doc_id", "text")
    old = docs.filter("doc_id % 11 <> 0").select("path", fx.content_hash(F.col("text")).alias("hash"))
    new = docs.filter("doc_id % 7 <> 0").select("path", fx.content_hash(F.when(F.col("doc_id") % 5 == 0, F.concat(F.col("text"), F.lit("!"))).otherwise(F.col("text"))).alias("hash"))
    return old, new


_SNAP_SQL = "old AS (SELECT 'd' || doc_id AS path, left(sha256(text), 16) AS hash FROM documents WHERE doc_id % 11 <> 0), new AS (SELECT 'd' || doc_id AS path, left(sha256(CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END), 16) AS hash FROM documents WHERE doc_id % 7 <> 0), df AS (SELECT coalesce(old.path, new.path) AS path, CASE WHEN old.path IS NULL THEN 'new' WHEN new.path IS NULL THEN 'deleted' WHEN old.hash = new.hash THEN 'unchanged' ELSE 'changed' END AS status FROM old FULL JOIN new ON old.path = new.path)"


@query(f"WITH {_SNAP_SQL} SELECT path, status FROM df")
def freshness_diff(spark, d):
    return freshness.diff(*_snapshots(spark, d))


@query(f"WITH {_SNAP_SQL} SELECT count(*) FILTER (status = 'unchanged') AS unchanged, count(*) FILTER (status = 'changed') AS changed, count(*) FILTER (status = 'new') AS new, count(*) FILTER (status = 'deleted') AS deleted, count(*) FILTER (status = 'error') AS error, 'stale' AS freshness FROM df")
def freshness_report(spark, d):
    return freshness.report(freshness.diff(*_snapshots(spark, d)))


@query(f"WITH {_SNAP_SQL} SELECT old.path, CASE WHEN new.path IS NULL THEN 'missing' WHEN old.hash = new.hash THEN 'valid' ELSE 'changed' END AS status FROM old LEFT JOIN new ON old.path = new.path")
def evidence_validate(spark, d):
    return freshness.validate(*_snapshots(spark, d))


@query(f"WITH {_SNAP_SQL} SELECT path, hash, CASE WHEN status = 'unchanged' THEN 0 ELSE 1 END AS version FROM new JOIN df USING (path)")
def incremental_merge(spark, d):
    old, new = _snapshots(spark, d)
    return freshness.merge_files(old.withColumn("version", F.lit(0)), new.withColumn("version", F.lit(1)))


@query(f"WITH {_SNAP_SQL} SELECT path, hash, 0 AS version FROM old WHERE path NOT IN (SELECT path FROM new) OR (path, hash) IN (SELECT path, hash FROM new) UNION ALL SELECT path, hash, 1 FROM new WHERE (path, hash) NOT IN (SELECT path, hash FROM old)")
def upsert_file(spark, d):
    old, new = _snapshots(spark, d)
    return freshness.upsert_file(old.withColumn("version", F.lit(0)), new.withColumn("version", F.lit(1)))


@query("SELECT 'symbols' AS tbl, count(*) AS n FROM orders WHERE o_custkey % 10 <> 0 UNION ALL SELECT 'calls', count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey % 10 <> 0 UNION ALL SELECT 'files', count(*) FROM customer WHERE c_custkey % 10 <> 0")
def delete_cascade(spark, d):
    orders, items = _t(spark, d, "orders"), _t(spark, d, "lineitem")
    tables = {"files": _t(spark, d, "customer").select(F.col("c_custkey").alias("file_id")), "symbols": orders.select(F.col("o_orderkey").alias("symbol_id"), F.col("o_custkey").alias("file_id")), "calls": items.select(F.col("l_orderkey").alias("caller_id"), F.lit(-1).cast("long").alias("callee_id"))}
    left = freshness.delete_files(tables, tables["files"].filter("file_id % 10 = 0"))
    parts = [left[t].agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("tbl"), "n") for t in ("symbols", "calls", "files")]
    return parts[0].union(parts[1]).union(parts[2])


@query("SELECT count(*) AS symbols, count(*) FILTER (l_returnflag = 'A') AS classes, count(*) FILTER (l_returnflag IN ('N', 'R')) AS functions, (SELECT count(*) FROM orders) AS files, (SELECT count(*) FROM part) AS imports, (SELECT count(*) FROM supplier) AS calls, CAST(0.75 AS DOUBLE) AS resolution_rate FROM lineitem")
def index_stats(spark, d):
    kind = F.when(F.col("l_returnflag") == "A", "class").when(F.col("l_returnflag") == "N", "function").otherwise("method")
    return freshness.index_stats(_t(spark, d, "lineitem").select(kind.alias("type")), _t(spark, d, "orders"), _t(spark, d, "part"), _t(spark, d, "supplier"), 3, 1)


@query("SELECT doc_id, left(sha256(text), 16) AS hash, CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS INTEGER) AS line_count, CAST(strlen(text) AS BIGINT) AS size_bytes FROM documents")
def content_hash(spark, d):
    return _t(spark, d, "documents").select("doc_id", fx.content_hash(F.col("text")).alias("hash"), fx.line_count(F.col("text")).alias("line_count"), F.octet_length("text").cast("long").alias("size_bytes"))


@query("SELECT count(*) AS n, min(hash) AS lo, max(hash) AS hi FROM (SELECT left(sha256(p_name), 16) AS hash FROM part)")
def snapshot_map(spark, d):
    files = _t(spark, d, "part").select(F.col("p_partkey").cast("string").alias("path"), fx.content_hash(F.col("p_name")).alias("hash"))
    hashes = F.map_values("file_hashes")
    return freshness.snapshot(files).select(F.size("file_hashes").cast("long").alias("n"), F.array_min(hashes).alias("lo"), F.array_max(hashes).alias("hi"))


@query("SELECT DISTINCT unnest(['a/' || lower(p_type) || '.py', 'new/' || string_split(p_name, ' ')[2] || '.py', 'x ' || p_size || '.py']) AS path FROM part")
def changed_paths(spark, d):
    """One status text a part: an edit, a rename (its new name counts), a file that is no source, a quoted name."""
    word = F.split("p_name", " ")[1]
    said = F.concat(F.lit(" M a/"), F.lower("p_type"), F.lit(".py\nR  old/b.py -> new/"), word, F.lit(".py\n?? notes.txt\n A \"x "), F.col("p_size").cast("string"), F.lit(".py\"\n"))
    return fs.changed_paths(_t(spark, d, "part").select(said.alias("text")))


# ---------------------------------------------------------------- scalar text


@query(r"SELECT page_id, regexp_replace(lower(replace('./' || url, '\', '/')), '^(\./)+', '') AS path, list_extract(string_split(lower(url), '.'), -1) AS symbol, regexp_replace(replace(replace(replace(url, '\', '/'), '/', '.'), '.py', ''), '\.__init__$', '') AS module, list_extract(string_split(url, '/'), -1) AS base FROM pages")
def path_functions(spark, d):
    u = F.col("url")
    return _t(spark, d, "pages").select("page_id", fx.normalize_path(F.concat(F.lit("./"), u)).alias("path"), fx.normalize_symbol(u).alias("symbol"), fx.path_to_module(u).alias("module"), fx.basename(u).alias("base"))


@query("SELECT p_partkey, 'trace-' || left(sha256(p_partkey || ':' || p_name), 16) AS evidence_id, regexp_replace(p_brand, '[^a-zA-Z0-9_]', '_', 'g') AS safe, coalesce(TRY_CAST(string_split(p_brand, '#')[2] AS INTEGER), -1) AS number, string_split(p_name, ' ')[1] = string_split(p_type, ' ')[1] AS same_top FROM part")
def identifier_functions(spark, d):
    return _t(spark, d, "part").select("p_partkey", fx.evidence_id(F.lit("trace"), F.col("p_partkey"), F.col("p_name")).alias("evidence_id"), fx.safe_id(F.col("p_brand")).alias("safe"), fx.safe_int(F.split("p_brand", "#")[1], -1).alias("number"), fx.same_top_package(F.regexp_replace("p_name", " ", "."), F.regexp_replace("p_type", " ", ".")).alias("same_top"))


@query("SELECT DISTINCT p_type, CASE WHEN d1 <= d2 AND d1 <= CASE WHEN length(c) <= 6 THEN 2 ELSE 3 END THEN '/economy' WHEN d2 <= CASE WHEN length(c) <= 6 THEN 2 ELSE 3 END THEN '/promotion' END AS suggestion FROM (SELECT p_type, '/' || lower(p_type) AS c, levenshtein('/' || lower(p_type), '/economy') AS d1, levenshtein('/' || lower(p_type), '/promotion') AS d2 FROM part)")
def suggest_command(spark, d):
    words = _t(spark, d, "part").select("p_type").distinct().withColumn("command", F.concat(F.lit("/"), F.lower("p_type")))
    return fx.suggestions(words, F.col("command"), ["/economy", "/promotion"]).select("p_type", "suggestion")


@query("SELECT doc_id, array_to_string(list_transform(ls[a:b], lambda x, i: CASE WHEN i + a - 1 = ln THEN '=> ' ELSE '   ' END || (i + a - 1) || ': ' || x), chr(10)) AS snip, array_to_string(ls[2:4], chr(10)) AS src FROM (SELECT doc_id, ls, ln, greatest(1, ln - 5) AS a, least(len(ls), ln + 5) AS b FROM (SELECT doc_id, string_split(text, chr(10)) AS ls, doc_id % 9 + 1 AS ln FROM documents))")
def snippet_window(spark, d):
    ln = (F.col("doc_id") % 9 + 1).cast("int")
    return _t(spark, d, "documents").select("doc_id", fs.snippet(F.col("text"), ln).alias("snip"), fs.source_lines(F.col("text"), F.lit(2), F.lit(4)).alias("src"))


# ---------------------------------------------------------------- traces


def _traces(spark, d):
    path = F.concat(F.lit("/app/src/mod"), (F.col("user_id") % 25).cast("string"), F.lit(".py"))
    line = (F.col("event_id") % 90 + 1).cast("string")
    text = F.concat(F.lit('Traceback (most recent call last):\n  File "/app/src/main.py", line 3, in run\n    go()\n  File "'), path, F.lit('", line '), line, F.lit(", in handle_"), F.col("event_type"), F.lit("\nValueError: bad value "), F.col("event_id").cast("string"))
    return _t(spark, d, "events").select(F.col("event_id").alias("trace_id"), F.when(F.col("event_type") == "error", text).when(F.col("event_type") == "view", F.concat(F.lit("KeyError: lost in mod.py at line "), line)).otherwise(F.col("event_type")).alias("text"), "event_type", "user_id")


_TRACE_SQL = """tr AS (SELECT event_id AS trace_id, event_type, user_id, CASE event_type WHEN 'error' THEN 'Traceback (most recent call last):' || chr(10) || '  File "/app/src/main.py", line 3, in run' || chr(10) || '    go()' || chr(10) || '  File "/app/src/mod' || (user_id % 25) || '.py", line ' || (event_id % 90 + 1) || ', in handle_' || event_type || chr(10) || 'ValueError: bad value ' || event_id
WHEN 'view' THEN 'KeyError: lost in mod.py at line ' || (event_id % 90 + 1) ELSE event_type END AS text FROM events)"""


@query(f"WITH {_TRACE_SQL} SELECT trace_id, event_type IN ('error', 'view') AS is_trace, event_type = 'error' AS is_python FROM tr")
def trace_detect(spark, d):
    return _traces(spark, d).select("trace_id", tr.is_stack_trace(F.col("text")).alias("is_trace"), tr.can_parse_python(F.col("text")).alias("is_python"))


@query(f"WITH {_TRACE_SQL} SELECT trace_id, 0 AS frame, 'src/main.py' AS file_path, 3 AS line_number, 'run' AS function_name, 'go()' AS code_line FROM tr WHERE event_type = 'error' UNION ALL SELECT trace_id, 1, 'src/mod' || (user_id % 25) || '.py', CAST(trace_id % 90 + 1 AS INTEGER), 'handle_error', CAST(NULL AS VARCHAR) FROM tr WHERE event_type = 'error'")
def trace_frames(spark, d):
    """Strict frames; the code of a frame is the indented line below it, if there is one."""
    return evidence.frames(_traces(spark, d))


@query(f"WITH {_TRACE_SQL} SELECT trace_id, CASE event_type WHEN 'view' THEN 'KeyError' WHEN 'error' THEN 'ValueError' END AS error_type, CASE event_type WHEN 'view' THEN 'lost' WHEN 'error' THEN 'bad value ' || trace_id END AS error_message FROM tr")
def trace_error(spark, d):
    return _traces(spark, d).select("trace_id", tr.loose_error(F.col("text")).alias("e")).select("trace_id", "e.*")


@query(f"WITH {_TRACE_SQL} SELECT trace_id, 'mod.py' AS file_path, CAST(trace_id % 90 + 1 AS INTEGER) AS line_number, CAST(NULL AS VARCHAR) AS function_name FROM tr WHERE event_type = 'view' UNION ALL SELECT trace_id, '/app/src/main.py', 3, 'run' FROM tr WHERE event_type = 'error' UNION ALL SELECT trace_id, '/app/src/mod' || (user_id % 25) || '.py', CAST(trace_id % 90 + 1 AS INTEGER), 'handle_error' FROM tr WHERE event_type = 'error'")
def trace_loose(spark, d):
    return _traces(spark, d).select("trace_id", F.explode(tr.loose_frames(F.col("text"))).alias("f")).select("trace_id", "f.*")


def _mods(spark, d):
    """A file for each nation; a symbol in those of the first three regions."""
    nation = _t(spark, d, "nation")
    mod = lambda end: F.concat(F.lit("mod"), F.col("n_nationkey").cast("string"), F.lit(end))
    path = F.concat(F.lit("src/"), mod(".py"))
    symbols = nation.filter("n_regionkey < 3").select(F.col("n_nationkey").cast("long").alias("symbol_id"), F.concat(F.lit("src."), mod(".handle_error")).alias("qualified_name"), path.alias("file_path"), F.lit(10).alias("start_line"), F.lit(60).alias("end_line"))
    return nation.select(path.alias("path")), symbols


@query(f"WITH {_TRACE_SQL} SELECT trace_id, 0 AS frame, CAST(NULL AS BIGINT) AS symbol_id, 1 AS start_line, 8 AS end_line FROM tr WHERE event_type = 'error' UNION ALL SELECT trace_id, 1, CASE WHEN n_regionkey < 3 THEN CAST(n_nationkey AS BIGINT) END, CAST(greatest(1, trace_id % 90 - 4) AS INTEGER), CAST(trace_id % 90 + 6 AS INTEGER) FROM tr JOIN nation ON n_nationkey = user_id % 25 WHERE event_type = 'error'")
def trace_evidence(spark, d):
    return evidence.trace_evidence(_traces(spark, d), *_mods(spark, d)).select("trace_id", "frame", "symbol_id", "start_line", "end_line")


@query(f"WITH {_TRACE_SQL} SELECT trace_id, CASE event_type WHEN 'error' THEN 'ValueError: bad value ' || trace_id ELSE 'Could not parse stack trace' END AS summary, CASE WHEN event_type <> 'error' THEN 0.0 WHEN n_regionkey < 3 THEN 0.8 ELSE 0.4 END ::DOUBLE AS confidence FROM tr JOIN nation ON n_nationkey = user_id % 25")
def trace_bundles(spark, d):
    traces = _traces(spark, d)
    return evidence.bundles(traces.select("trace_id", "text"), evidence.trace_evidence(traces, *_mods(spark, d))).select("trace_id", "summary", "confidence")


@query("SELECT event_id AS trace_id, 'tests/test_' || event_type || '.py' AS file_path, CAST(user_id % 50 + 1 AS INTEGER) AS line_number, 'AssertionError' AS error_type, 'assert ' || event_id || ' == 0' AS message FROM events WHERE event_type = 'click'")
def pytest_failures(spark, d):
    rows = _t(spark, d, "events")
    failed = F.concat(F.lit(">       assert x == 0\nE       assert "), F.col("event_id").cast("string"), F.lit(" == 0\n\ntests/test_"), F.col("event_type"), F.lit(".py:"), (F.col("user_id") % 50 + 1).cast("string"), F.lit(": AssertionError"))
    text = F.when(F.col("event_type") == "click", failed).otherwise(F.col("event_type"))
    found = rows.select(F.col("event_id").alias("trace_id"), tr.parse_failure(text).alias("f"))
    return found.select("trace_id", F.explode("f.frames").alias("x"), F.element_at("f.exceptions", 1).alias("e")).select("trace_id", "x.file_path", "x.line_number", F.col("e.type").alias("error_type"), F.col("e.message").alias("message"))


@query("SELECT o_orderkey AS trace_id, count(*) AS n, CAST(min(l_linenumber) AS INTEGER) AS first_line FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND o_custkey % 7 + 1 BETWEEN l_linenumber AND l_linenumber + CAST(l_quantity AS INTEGER) % 4 GROUP BY o_orderkey")
def range_join_lines(spark, d):
    frames = _t(spark, d, "orders").select(F.col("o_orderkey").alias("trace_id"), F.lit(0).alias("frame"), F.col("o_orderkey").cast("string").alias("file_path"), (F.col("o_custkey") % 7 + 1).alias("line_number"))
    spans = _t(spark, d, "lineitem").select(F.col("l_partkey").alias("symbol_id"), F.col("l_orderkey").cast("string").alias("file_path"), F.col("l_linenumber").alias("start_line"), (F.col("l_linenumber") + F.col("l_quantity").cast("int") % 4).alias("end_line"))
    return evidence.frame_ranges(frames, spans).groupBy("trace_id").agg(F.count(F.lit(1)).alias("n"), F.min("start_line").cast("int").alias("first_line"))


@query("SELECT conv_id AS hypothesis_id, turn AS evidence_id FROM conversations WHERE turn NOT IN (SELECT doc_id FROM documents WHERE doc_id % 2 = 0)")
def dangling_evidence(spark, d):
    h = _t(spark, d, "conversations").groupBy(F.col("conv_id").alias("hypothesis_id")).agg(F.collect_list("turn").alias("evidence_ids"))
    return evidence.dangling(h, _t(spark, d, "documents").filter("doc_id % 2 = 0").select(F.col("doc_id").alias("evidence_id")))


@query("SELECT arg_max(event_id, value * 1e7 - event_id) AS hypothesis_id, max(value) AS confidence FROM events")
def best_hypothesis(spark, d):
    return evidence.best_hypothesis(_t(spark, d, "events").select(F.col("event_id").alias("hypothesis_id"), F.col("value").alias("confidence")))


# ---------------------------------------------------------------- name resolution


def _names(spark, d):
    """Symbols Brand.type.word; calls by word from a brand's class."""
    parts = _spread(spark, d)
    brand = F.regexp_replace("p_brand", "#", "")
    words = F.split("p_name", " ")
    symbols = parts.select(F.col("p_partkey").alias("symbol_id"), words[1].alias("name"), F.concat_ws(".", brand, F.lower("p_type"), words[1]).alias("qualified_name"))
    calls = parts.select(F.col("p_partkey").alias("call_id"), F.when(F.col("p_size") % 10 == 0, F.concat(F.lower("p_type"), F.lit("."), words[1])).when(F.col("p_size") % 10 == 1, "nothing").otherwise(words[1]).alias("target"), F.when(F.col("p_size") % 10 == 2, "self").otherwise("direct").alias("call_type"), F.concat(brand, F.lit(".Holder")).alias("caller_class"))
    return symbols, calls


_NAMES_SQL = """sy AS (SELECT p_partkey AS symbol_id, string_split(p_name, ' ')[2] AS name, replace(p_brand, '#', '') || '.' || lower(p_type) || '.' || string_split(p_name, ' ')[2] AS qname FROM part),
ix AS (SELECT name, qname, row_number() OVER (PARTITION BY name ORDER BY symbol_id, qname) AS ord, count(*) OVER (PARTITION BY name) AS n FROM sy),
ca AS (SELECT p_partkey AS call_id, CASE p_size % 10 WHEN 0 THEN lower(p_type) || '.' || string_split(p_name, ' ')[2] WHEN 1 THEN 'nothing' ELSE string_split(p_name, ' ')[2] END AS target, p_size % 10 = 2 AS is_self, replace(p_brand, '#', '') AS module FROM part)"""


@query(f"""WITH {_NAMES_SQL}, mm AS (SELECT call_id, min(ord) AS ord FROM ca JOIN ix ON name = target AND starts_with(qname, module || '.') GROUP BY call_id),
sf AS (SELECT call_id, min(ord) AS ord FROM ca JOIN ix ON contains(target, '.') AND name = string_split(target, '.')[-1] AND (qname = target OR ends_with(qname, '.' || target)) GROUP BY call_id)
SELECT call_id, CASE WHEN is_self THEN module || '.Holder.' || target WHEN a.qname IS NOT NULL THEN a.qname WHEN b.qname IS NOT NULL THEN b.qname WHEN c.qname IS NOT NULL THEN c.qname ELSE target END AS callee,
CASE WHEN is_self THEN 'self_method' WHEN a.qname IS NOT NULL THEN 'module_match' WHEN b.n = 1 THEN 'exact_match' WHEN b.qname IS NOT NULL THEN 'first_candidate' WHEN c.qname IS NOT NULL THEN 'suffix_match' ELSE 'unresolved' END AS resolution,
round(CASE WHEN is_self THEN 1.0 WHEN a.qname IS NOT NULL THEN 0.9 WHEN b.qname IS NOT NULL THEN 1.0 / b.n WHEN c.qname IS NOT NULL THEN CASE WHEN c.n = 1 THEN 1.0 ELSE 0.8 END ELSE 0.0 END, 6) AS confidence
FROM ca LEFT JOIN mm USING (call_id) LEFT JOIN ix a ON a.name = target AND a.ord = mm.ord LEFT JOIN ix b ON b.name = target AND b.ord = 1 LEFT JOIN sf USING (call_id) LEFT JOIN ix c ON c.name = string_split(target, '.')[-1] AND c.ord = sf.ord""")
def callee_resolution(spark, d):
    symbols, calls = _names(spark, d)
    index = resolve.symbol_index(symbols)
    return resolve.resolve_callees(calls, index).select("call_id", "callee", "resolution", F.round("confidence", 6).alias("confidence"))


def _name_snapshots(spark, d):
    """Two states of a tree with one symbol or one call a file: symbols go, come and are renamed, a few calls change their target."""
    symbols, calls = _names(spark, d)
    k = F.col("symbol_id")
    row = lambda name, qname: symbols.select(name.alias("name"), qname.alias("qname"), F.concat(F.lit("s"), k).alias("path"), k.cast("int").alias("pos"), F.lit("function").alias("type"), k.cast("long").alias("symbol_id"))
    old = row(F.col("name"), F.col("qualified_name")).filter("symbol_id % 41 <> 0")
    moved = lambda c: F.when(k % 97 == 0, F.concat(F.col(c), F.lit("er"))).otherwise(F.col(c))
    new = row(moved("name"), moved("qualified_name")).filter("symbol_id % 53 <> 0")
    c = F.col("call_id")
    call = lambda target: calls.select(F.concat(F.lit("c"), c).alias("path"), F.lit(0).alias("pos"), target.alias("target"), "call_type", "caller_class", F.lit(None).cast("string").alias("caller_qname"), F.lit(1).alias("line_number"))
    return old, new, call(F.col("target")), call(F.when(c % 59 == 0, F.concat(F.col("target"), F.lit("er"))).otherwise(F.col("target")))


_DELTA_SQL = """pt AS (SELECT p_partkey AS k, string_split(p_name, ' ')[2] AS w, replace(p_brand, '#', '') AS module, lower(p_type) AS t, p_size FROM part),
o AS (SELECT w AS name, module || '.' || t || '.' || w AS qname, k FROM pt WHERE k % 41 <> 0),
sy AS (SELECT w || CASE WHEN k % 97 = 0 THEN 'er' ELSE '' END AS name, module || '.' || t || '.' || w || CASE WHEN k % 97 = 0 THEN 'er' ELSE '' END AS qname, k FROM pt WHERE k % 53 <> 0),
ch AS (SELECT DISTINCT name FROM ((FROM o EXCEPT FROM sy) UNION ALL (FROM sy EXCEPT FROM o))),
ix AS (SELECT name, qname, row_number() OVER (PARTITION BY name ORDER BY 's' || k, k, qname) AS ord, count(*) OVER (PARTITION BY name) AS n FROM sy),
ca AS (SELECT k AS call_id, CASE p_size % 10 WHEN 0 THEN t || '.' || w WHEN 1 THEN 'nothing' ELSE w END || CASE WHEN k % 59 = 0 THEN 'er' ELSE '' END AS target, p_size % 10 = 2 AS is_self, module FROM pt),
mm AS (SELECT call_id, min(ord) AS ord FROM ca JOIN ix ON name = target AND starts_with(qname, module || '.') GROUP BY call_id),
sf AS (SELECT call_id, min(ord) AS ord FROM ca JOIN ix ON contains(target, '.') AND name = string_split(target, '.')[-1] AND (qname = target OR ends_with(qname, '.' || target)) GROUP BY call_id)"""


@query(f"""WITH {_DELTA_SQL} SELECT 'c' || call_id AS path, CASE WHEN is_self THEN module || '.Holder.' || target WHEN a.qname IS NOT NULL THEN a.qname WHEN b.qname IS NOT NULL THEN b.qname WHEN c.qname IS NOT NULL THEN c.qname ELSE target END AS callee,
CASE WHEN is_self THEN 'self_method' WHEN a.qname IS NOT NULL THEN 'module_match' WHEN b.n = 1 THEN 'exact_match' WHEN b.qname IS NOT NULL THEN 'first_candidate' WHEN c.qname IS NOT NULL THEN 'suffix_match' ELSE 'unresolved' END AS resolution,
round(CASE WHEN is_self THEN 1.0 WHEN a.qname IS NOT NULL THEN 0.9 WHEN b.qname IS NOT NULL THEN 1.0 / b.n WHEN c.qname IS NOT NULL THEN CASE WHEN c.n = 1 THEN 1.0 ELSE 0.8 END ELSE 0.0 END, 6) AS confidence,
(call_id % 59 = 0 OR string_split(target, '.')[-1] IN (SELECT name FROM ch)) AS again
FROM ca LEFT JOIN mm USING (call_id) LEFT JOIN ix a ON a.name = target AND a.ord = mm.ord LEFT JOIN ix b ON b.name = target AND b.ord = 1 LEFT JOIN sf USING (call_id) LEFT JOIN ix c ON c.name = string_split(target, '.')[-1] AND c.ord = sf.ord""")
def delta_resolution(spark, d):
    """Calls resolved on the first state and maintained to the second; ``again`` tells which were resolved a second time."""
    old, new, calls, now = _name_snapshots(spark, d)
    edited = now.join(calls, ["path", "target"], "left_anti")
    after = delta.maintain_calls(delta.resolve_calls(calls, old), edited, edited, new, delta.changed_names(old, new))
    return after.select("path", "callee", "resolution", F.round("confidence", 6).alias("confidence"), "again")


@query(f"WITH {_NAMES_SQL} SELECT name, CAST(count(*) AS INTEGER) AS n, min(qname) AS least FROM ix GROUP BY name")
def symbol_candidates(spark, d):
    found = resolve.candidates(resolve.symbol_index(_names(spark, d)[0]))
    return found.select("name", F.size("qnames").alias("n"), F.array_min("qnames").alias("least"))


@query(f"""WITH {_NAMES_SQL}, ba AS (SELECT p_partkey AS pos, replace(p_brand, '#', '') || '.Child' AS child, replace(p_brand, '#', '') AS module, string_split(p_name, ' ')[2] AS parent, p_size FROM part),
im AS (SELECT p_partkey AS pos, replace(p_brand, '#', '') || '.' || lower(p_type) || '.' || string_split(p_name, ' ')[2] AS f FROM part),
k AS (SELECT ba.pos, ix.qname, CASE WHEN starts_with(qname, module || '.') THEN 0 WHEN p_size % 3 = 0 AND im.f = qname THEN 1 ELSE 2 END AS rule, ord FROM ba JOIN ix ON name = parent JOIN im ON im.pos = ba.pos)
SELECT pos, arg_min(qname, rule * 1000000 + ord) AS parent_qname FROM k GROUP BY pos""")
def prioritized_parent(spark, d):
    symbols, _ = _names(spark, d)
    parts = _spread(spark, d)
    brand, word = F.regexp_replace("p_brand", "#", ""), F.split("p_name", " ")[1]
    path = F.col("p_partkey").cast("string").alias("path")
    bases = parts.select(F.concat(brand, F.lit(".Child")).alias("child"), word.alias("parent"), path, F.lit(1).alias("line_number"), F.col("p_partkey").alias("pos"))
    imports = parts.filter("p_size % 3 = 0").select(path, F.concat_ws(".", brand, F.lower("p_type")).alias("module_path"), word.alias("imported_name"), F.lit(None).cast("string").alias("alias"))
    return resolve.resolve_parents(bases, imports, resolve.symbol_index(symbols)).select("pos", "parent_qname")


@query(f"""WITH {_NAMES_SQL}, im AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE replace(p_brand, '#', '') || '.' || lower(p_type) END AS m, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'gone' ELSE string_split(p_name, ' ')[2] END AS n FROM part),
x AS (SELECT k, CASE WHEN n IS NULL THEN nullif(m, '') WHEN m <> '' THEN m || '.' || n ELSE n END AS dst FROM im)
SELECT 'pkg.s' || k AS src, dst, CAST(k % 9 + 1 AS INTEGER) AS line_number FROM x WHERE dst IN (SELECT qname FROM sy)""")
def import_edges(spark, d):
    """Edges from modules to the symbols that they import; names that no symbol has give none."""
    symbols, _ = _names(spark, d)
    k = F.col("p_partkey")
    module = F.when(k % 5 == 0, "").otherwise(F.concat_ws(".", F.regexp_replace("p_brand", "#", ""), F.lower("p_type")))
    name = F.when(k % 4 == 0, None).when(k % 4 == 1, "gone").otherwise(F.split("p_name", " ")[1])
    imports = _t(spark, d, "part").select(F.concat(F.lit("pkg/s"), k.cast("string"), F.lit(".py")).alias("path"), F.lit(0).alias("pos"), module.alias("module_path"), name.alias("imported_name"), F.lit(None).cast("string").alias("alias"), (k % 9 + 1).cast("int").alias("line_number"))
    return resolve.import_edges(imports, symbols).select("src", "dst", "line_number")


# ---------------------------------------------------------------- parsing


def _spread(spark, d):
    """Parts dealt to all cores before text or names are made of them: the table is small, so its file has few splits, but each part becomes a file to parse or some dotted names."""
    return _t(spark, d, "part").repartition(4 * spark.sparkContext.defaultParallelism, "p_partkey")


def _sources(spark, d):
    word = F.split("p_name", " ")
    code = F.concat(F.lit("import os\nfrom pkg.base import Base\n\n\nclass "), F.initcap(word[1]), F.col("p_partkey").cast("string"), F.lit("(Base):\n    \"\"\"A "), word[0], F.lit(" thing.\"\"\"\n\n    def size(self, n: int) -> int:\n        self.check(n)\n        return n + "), F.col("p_size").cast("string"), F.lit("\n\n\ndef make_"), word[1], F.lit("(x):\n    obj = "), F.initcap(word[1]), F.col("p_partkey").cast("string"), F.lit("()\n    obj.size(x)\n    return os.path.join(x)\n"))
    return _spread(spark, d).select(F.concat(F.lit("src/m"), F.col("p_partkey").cast("string"), F.lit(".py")).alias("path"), code.alias("content"), "p_partkey")


@query("SELECT 'src/m' || p_partkey || '.py' AS file_path, unnest([upper(left(w, 1)) || substr(w, 2) || p_partkey, 'size', 'make_' || w]) AS name, unnest(['class', 'method', 'function']) AS type, unnest(['src.m' || p_partkey || '.' || upper(left(w, 1)) || substr(w, 2) || p_partkey, 'src.m' || p_partkey || '.' || upper(left(w, 1)) || substr(w, 2) || p_partkey || '.size', 'src.m' || p_partkey || '.make_' || w]) AS qualified_name, unnest([5, 8, 13]) AS start_line, unnest([10, 10, 16]) AS end_line FROM (SELECT p_partkey, string_split(p_name, ' ')[2] AS w FROM part)")
def parse_symbols(spark, d):
    return py.symbols_of(py.parse_files(_sources(spark, d), ("symbols",))).select("file_path", "name", "type", "qualified_name", "start_line", "end_line")


@query("SELECT 'src/m' || p_partkey || '.py' AS path, unnest(['os', 'pkg.base']) AS module_path, unnest([NULL, 'Base']) AS imported_name, unnest([1, 2]) AS line_number FROM part")
def parse_imports(spark, d):
    return py.imports_of(py.parse_files(_sources(spark, d), ("imports",))).select("path", "module_path", "imported_name", "line_number")


@query("SELECT 'src/m' || p_partkey || '.py' AS path, unnest(['check', upper(left(w, 1)) || substr(w, 2) || p_partkey, 'size', 'join']) AS target, unnest(['self', 'direct', 'method', 'method']) AS call_type, unnest([9, 14, 15, 16]) AS line_number FROM (SELECT p_partkey, string_split(p_name, ' ')[2] AS w FROM part)")
def parse_calls(spark, d):
    return py.calls_of(py.parse_files(_sources(spark, d), ("calls",))).select("path", "target", "call_type", "line_number")


def _broken_sources(spark, d):
    """A file a part that does not parse: an unclosed call in a method, a header without its bracket, a half assignment, then sound code."""
    word = F.split("p_name", " ")
    cls = F.concat(F.initcap(word[1]), F.col("p_partkey").cast("string"))
    code = F.concat(F.lit("import os\nfrom pkg.base import Base\n\n\nclass "), cls, F.lit("(Base):\n    def size(self, n):\n        return self.check(n\n\n    def ok(self):\n        return os.getcwd()\n\n\ndef broken_"), word[0],
                    F.lit("(x:\n    y =\n    use(x)\n\n\ndef make_"), word[1], F.lit("(x):\n    return "), cls, F.lit("().ok()\n"))
    return _spread(spark, d).select(F.concat(F.lit("src/m"), F.col("p_partkey").cast("string"), F.lit(".py")).alias("path"), code.alias("content"))


@query("""WITH p AS (SELECT 'src/m' || p_partkey || '.py' AS path, 'src.m' || p_partkey || '.' AS m, string_split(p_name, ' ')[1] AS a, string_split(p_name, ' ')[2] AS w, upper(left(string_split(p_name, ' ')[2], 1)) || substr(string_split(p_name, ' ')[2], 2) || p_partkey AS c FROM part)
SELECT path, 'symbol' AS kind, unnest([m || c, m || c || '.size', m || c || '.ok', m || 'broken_' || a, m || 'make_' || w]) AS name, unnest(['class', 'method', 'method', 'function', 'function']) AS type, unnest([5, 6, 9, 13, 18]) AS start_line, unnest([10, 7, 10, 15, 19]) AS end_line FROM p
UNION ALL SELECT path, 'import', unnest(['os', 'pkg.base']), NULL, unnest([1, 2]), NULL FROM p UNION ALL SELECT path, 'call', unnest(['os.getcwd', 'use', 'ok', c]), unnest(['method', 'direct', 'method', 'direct']), unnest([10, 15, 19, 19]), NULL FROM p
UNION ALL SELECT path, 'base', 'Base', NULL, 5, NULL FROM p UNION ALL SELECT path, 'error', 'SyntaxError', NULL, NULL, NULL FROM p""")
def parse_broken(spark, d):
    """All rows of files that do not parse as a whole; each file is parsed once."""
    parsed = py.parse_files(_broken_sources(spark, d), ("symbols", "imports", "calls", "bases"))
    null = lambda kind: F.lit(None).cast(kind)
    row = lambda kind, name, what, start, end: F.struct(F.lit(kind).alias("kind"), name.alias("name"), what.alias("type"), start.alias("start_line"), end.alias("end_line"))
    rows = [F.transform("symbols", lambda s: row("symbol", s["qualified_name"], s["type"], s["start_line"], s["end_line"])),
            F.transform("imports", lambda i: row("import", i["module_path"], null("string"), i["line_number"], null("int"))),
            F.transform("calls", lambda c: row("call", c["chain"], c["call_type"], c["line_number"], null("int"))),
            F.transform("bases", lambda b: row("base", b["parent"], null("string"), b["line_number"], null("int"))),
            F.filter(F.array(row("error", F.substring_index("error", ":", 1), null("string"), null("int"), null("int"))), lambda e: e["name"].isNotNull())]
    return parsed.select("path", F.inline(F.concat(*rows)))


@query("SELECT relation_type, count(*) AS n FROM (SELECT 'inherits' AS relation_type FROM part UNION ALL SELECT unnest(['calls', 'calls', 'calls', 'calls']) FROM part) GROUP BY relation_type")
def call_graph_build(spark, d):
    parsed = checkpoint(py.parse_files(_sources(spark, d), ("symbols", "imports", "calls", "bases")))  # read by each kind of edge
    edges = resolve.build_edges(py.symbols_of(parsed), py.imports_of(parsed), py.bases_of(parsed), py.calls_of(parsed))
    return edges.groupBy("relation_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey, unnest(['int', 'Base', upper(left(w, 1)) || substr(w, 2) || p_partkey, upper(left(w, 1)) || substr(w, 2) || p_partkey, NULL]) AS type_name, unnest(['explicit_hint', 'import_mapping', 'self_inference', 'assignment', 'none']) AS strategy, unnest([0.95, 0.9, 0.85, 0.7, 0.0]::DOUBLE[]) AS confidence FROM (SELECT p_partkey, string_split(p_name, ' ')[2] AS w FROM part)")
def type_cascade(spark, d):
    asked = F.array(*[F.struct(F.lit(n).alias("line"), F.lit(x).alias("name")) for n, x in ((8, "size"), (14, "base"), (9, "self"), (15, "obj"), (16, "x"))])
    rows = _sources(spark, d).select("p_partkey", F.col("content").alias("source"), F.explode(asked).alias("q")).select("p_partkey", "source", "q.line", "q.name")
    return types.infer(rows).select("p_partkey", "type_name", "strategy", F.col("confidence").cast("double").alias("confidence"))


def _flow_sources(spark, d):
    """File k has a class whose method gives an instance of the class of file k / 2, and functions that pass such values on through that file."""
    k = F.col("p_partkey")
    n, up = k.cast("string"), F.floor(k / 2).cast("string")
    code = F.concat(F.lit("import src.m"), up, F.lit(" as other\n\n\nclass W"), n, F.lit(":\n    def up(self):\n        return other.W"), up, F.lit("()\n\n\nclass V"), n, F.lit("(W"), n, F.lit("):\n    pass\n\n\ndef make():\n    value = V"), n,
                    F.lit("()\n    return value.up()\n\n\ndef chain(flag):\n    if flag:\n        return chain(False)\n    found = other.make()\n    return same(found)\n\n\ndef same(x):\n    return x\n\n\ndef duck(thing):\n    thing.quack()\n    return thing.swim()\n"))
    return _spread(spark, d).select(F.concat(F.lit("src/m"), n, F.lit(".py")).alias("path"), code.alias("content"), k.alias("k"))


@query("""WITH p AS (SELECT p_partkey AS k, CAST(floor(p_partkey / 2) AS BIGINT) AS u, CAST(floor(floor(p_partkey / 2) / 2) AS BIGINT) AS v FROM part), a AS (SELECT p.*, p.u IN (SELECT k FROM p) AS has_u, p.u IN (SELECT k FROM p) AND p.v IN (SELECT k FROM p) AS has_v FROM p)
SELECT k, unnest(['make', 'chain', 'x', 'thing']) AS name, unnest([CASE WHEN has_u THEN 'W' || u END, CASE WHEN has_v THEN 'W' || v END, CASE WHEN has_v THEN 'W' || v END, 'DuckType(quack, swim)']) AS type_name,
unnest([CASE WHEN has_u THEN 'data_flow' ELSE 'none' END, CASE WHEN has_v THEN 'data_flow' ELSE 'none' END, CASE WHEN has_v THEN 'data_flow' ELSE 'none' END, 'duck_typing']) AS strategy,
unnest([CASE WHEN has_u THEN 0.6 ELSE 0.0 END, CASE WHEN has_v THEN 0.6 ELSE 0.0 END, CASE WHEN has_v THEN 0.6 ELSE 0.0 END, 0.4]::DOUBLE[]) AS confidence FROM a""")
def type_across_files(spark, d):
    """Types that come through calls, methods, inheritance and arguments of other files; where nothing flows, what a value is asked to do."""
    files = _flow_sources(spark, d)
    parsed = checkpoint(py.parse_files(files, ("symbols", "imports", "bases", "flows"), signatures=False))
    names = delta.names_of(py.symbols_of(parsed))
    bases = resolve.resolve_parents(py.bases_of(parsed), py.imports_of(parsed), delta.index_of(names))
    types_of = flow.named_types(flow.flow_types(py.flows_of(parsed), names, bases))
    module = F.concat(F.lit("src.m"), F.col("k").cast("string"), F.lit("."))
    asked = F.array(*[F.struct(F.lit(n).alias("line"), F.lit(x).alias("name"), F.concat(module, F.lit(s)).alias("slot")) for n, x, s in ((13, "make", "make()"), (18, "chain", "chain()"), (26, "x", "same.x"), (30, "thing", "duck.thing"))])
    rows = files.select("k", F.col("content").alias("source"), F.explode(asked).alias("q")).select("k", "source", "q.*")
    return types.infer(rows, types_of).select("k", "name", "type_name", "strategy", F.col("confidence").cast("double").alias("confidence"))


@query("""WITH RECURSIVE seeds AS (SELECT p_partkey AS slot, p_brand AS type FROM part WHERE p_partkey % 37 = 0), moves AS (SELECT p_partkey AS dst, CAST(floor(p_partkey / 2) AS BIGINT) AS src FROM part UNION ALL SELECT CAST(floor(p_partkey / 3) AS BIGINT), p_partkey FROM part WHERE p_partkey % 13 = 0),
known AS (SELECT slot, type FROM seeds UNION SELECT dst, type FROM known JOIN moves ON src = slot) SELECT slot, type FROM known""")
def type_fixpoint(spark, d):
    """The closure of types along moves, cycles included."""
    part = _t(spark, d, "part")
    k = F.col("p_partkey")
    moves = part.select(k.alias("dst"), F.floor(k / 2).alias("src")).unionByName(part.filter(k % 13 == 0).select(F.floor(k / 3).alias("dst"), k.alias("src")))
    return flow.fixpoint(part.filter(k % 37 == 0).select(k.alias("slot"), F.col("p_brand").alias("type")), moves)


@query("SELECT p_partkey, CAST(len(string_split(s, chr(10))) AS INTEGER) AS lines FROM (SELECT p_partkey, 'import os' || chr(10) || 'from' || chr(10) || chr(10) || chr(10) || 'c' || chr(10) || 'd' || chr(10) || chr(10) || 'def' || chr(10) || '#' || chr(10) || chr(10) || chr(10) || 'def' || chr(10) || 'a' || chr(10) || 'b' || chr(10) || 'c' || chr(10) AS s FROM part)")
def skeletonize(spark, d):
    made = skeleton.skeleton(F.col("content"), F.array(F.lit(15)))
    return _sources(spark, d).select("p_partkey", F.size(F.split(made, "\n")).alias("lines"))


# ---------------------------------------------------------------- evaluation


def _scored(spark, d):
    labels = _t(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    return labels.select(F.col("doc_id").cast("string").alias("case_id"), (F.col("quality") == 1).alias("top1"), ((F.col("quality") == 1) | (F.col("doc_id") % 2 == 0)).alias("top3"), F.when(F.col("toxic") == 1, 0.5).otherwise(1.0).alias("function_rate"), F.when(F.col("doc_id") % 3 == 0, "full").otherwise("hybrid").alias("mode"), (F.col("doc_id") % 7 == 0).alias("is_trace"), (F.col("doc_id") % 14 == 0).alias("parsed"))


_SCORED_SQL = "sc AS (SELECT doc_id, max(quality) = 1 AS top1, max(quality) = 1 OR doc_id % 2 = 0 AS top3, CASE WHEN max(toxic) = 1 THEN 0.5 ELSE 1.0 END AS function_rate, CASE WHEN doc_id % 3 = 0 THEN 'full' ELSE 'hybrid' END AS mode, doc_id % 7 = 0 AS is_trace, doc_id % 14 = 0 AS parsed FROM labels GROUP BY doc_id)"


@query(f"WITH {_SCORED_SQL} SELECT count(*) AS cases, round(avg(top1::INT), 9) AS top1_rate, round(avg(top3::INT), 9) AS top3_rate, round(avg(function_rate), 9) AS function_rate FROM sc")
def eval_metrics(spark, d):
    return evaluate.metrics(_scored(spark, d)).select("cases", *[F.round(c, 9).alias(c) for c in ("top1_rate", "top3_rate", "function_rate")])


@query(f"WITH {_SCORED_SQL} SELECT mode, count(*) AS cases, round(avg(top1::INT), 9) AS top1_rate, round(avg(top3::INT), 9) AS top3_rate, round(avg(function_rate), 9) AS function_rate FROM sc GROUP BY mode")
def mode_comparison(spark, d):
    return evaluate.metrics(_scored(spark, d), "mode").select("mode", "cases", *[F.round(c, 9).alias(c) for c in ("top1_rate", "top3_rate", "function_rate")])


@query(f"WITH {_SCORED_SQL}, c AS (SELECT CASE WHEN is_trace AND NOT parsed THEN 'stacktrace_parse_miss' WHEN NOT top3 THEN 'missed_recall' WHEN NOT top1 THEN 'ranking_error' WHEN function_rate < 1 THEN 'function_miss' ELSE 'other' END AS category FROM sc) SELECT x.category, count(c.category) AS n FROM (SELECT unnest(['stacktrace_parse_miss', 'missed_recall', 'ranking_error', 'function_miss', 'evaluator_warning', 'other']) AS category) x LEFT JOIN c USING (category) GROUP BY x.category")
def failure_histogram(spark, d):
    rows = _scored(spark, d)
    return evaluate.failure_histogram(rows.select(evaluate.classify_failure(F.col("top1"), F.col("top3"), F.col("function_rate"), F.col("is_trace"), F.col("parsed")).alias("category")))


@query("""WITH r AS (SELECT o_custkey AS case_id, o_orderkey AS sym, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rank, 'src/f' || (o_orderkey % 4) || '.py' AS path FROM orders),
w AS (SELECT c_custkey AS case_id, 'src/f' || (c_custkey % 4) || '.py' AS path FROM customer), b AS (SELECT case_id, min(rank) AS best FROM r JOIN w USING (case_id, path) GROUP BY case_id)
SELECT CAST(w.case_id AS VARCHAR) AS case_id, coalesce(best <= 1, false) AS top1, coalesce(best <= 3, false) AS top3 FROM w LEFT JOIN b USING (case_id)""")
def file_hits(spark, d):
    cases = _t(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("case_id"), F.array(F.concat(F.lit("./SRC/f"), (F.col("c_custkey") % 4).cast("string"), F.lit(".py"))).alias("expected_files"))
    results = _t(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("case_id"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("rank"), F.concat(F.lit("src\\f"), (F.col("o_orderkey") % 4).cast("string"), F.lit(".py")).alias("file_path"))
    return evaluate.file_hits(cases, results)


@query("""WITH r AS (SELECT o_custkey AS k, o_orderkey AS o, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rank FROM orders), f AS (SELECT * FROM r WHERE rank <= 5 AND o % 4 = k % 4),
w AS (SELECT c_custkey AS k, unnest(['fn' || (c_custkey % 5), 'm' || (c_custkey % 3)]) AS fn FROM customer), sp AS (SELECT DISTINCT 'm' || (s_suppkey % 3) AS fn, s_suppkey % 40 + 1 AS a, s_suppkey % 40 + 1 + s_suppkey % 7 AS b FROM supplier),
h AS (SELECT k, 'fn' || (o % 6) AS fn FROM f UNION SELECT k, 'm' || (o % 2) FROM f UNION SELECT f.k, fn FROM f JOIN sp ON o % 50 + 1 BETWEEN a AND b OR o % 60 + 1 BETWEEN a AND b)
SELECT CAST(w.k AS VARCHAR) AS case_id, avg(CASE WHEN h.fn IS NULL THEN 0.0 ELSE 1.0 END) AS function_rate FROM w LEFT JOIN h ON h.k = w.k AND h.fn = w.fn GROUP BY w.k""")
def function_hits(spark, d):
    """Expected functions that are hit by a name, a matched name, or a symbol around one of the lines."""
    c, o, s = F.col("c_custkey"), F.col("o_orderkey"), F.col("s_suppkey")
    text = lambda a, x, b="": F.concat(F.lit(a), x.cast("string"), F.lit(b))
    cases = _t(spark, d, "customer").select(c.cast("string").alias("case_id"), F.array(text("./SRC/f", c % 4, ".py")).alias("expected_files"), F.array(text("fn", c % 5), text("K.M", c % 3)).alias("expected_functions"))
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    matched = F.array(F.struct(text("K.m", o % 2).alias("name"), (o % 60 + 1).cast("int").alias("start_line")))
    results = _t(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("case_id"), place.alias("rank"), text("src\\f", o % 4, ".py").alias("file_path"), text("fn", o % 6).alias("name"), (o % 50 + 1).cast("int").alias("line_number"), matched.alias("matched"))
    symbols = _t(spark, d, "supplier").select(text("m", s % 3).alias("name"), text("K.m", s % 3).alias("qualified_name"), (s % 40 + 1).cast("int").alias("start_line"), (s % 40 + 1 + s % 7).cast("int").alias("end_line"))
    return evaluate.function_hits(cases, results, symbols)


@query(f"WITH {_SNAP_SQL} SELECT path, hash, CASE WHEN status = 'unchanged' THEN 0 ELSE 1 END AS version FROM new JOIN df USING (path)")
def watch_refresh(spark, d):
    """Two ticks over snapshots; the second finds nothing new."""
    from loreline.streaming.watch import refresh_snapshots

    old, new = _snapshots(spark, d)
    return refresh_snapshots(old, [new, new])
