"""Questions to an index: search, lookups, relations, call graphs, trace diagnosis. Every answer is a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreline.functions.trace import parse_failure
from loreline.operators import evidence, freshness, graph, retrieval, skeleton
from loreline.options import QueryOptions
from loreline.plans import index_job
from loreline.sources import files as sources
from loreline.sources.shared import checkpoint
from loreline.sources.store import IndexStore


class QueryService:
    """``root`` enables source text, skeletons and the freshness gate."""

    def __init__(self, spark: SparkSession, store_root: str, root: str | None = None, auto_refresh: bool = False):
        self.spark, self.store_root, self.root, self.auto_refresh = spark, store_root, root, auto_refresh
        self.store = IndexStore(spark, store_root)

    def _fresh(self) -> None:
        if self.auto_refresh and self.root:
            index_job.refresh_if_stale(self.spark, self.root, self.store_root)

    def symbols(self) -> DataFrame:
        return self.store.read("symbols")

    def search(self, query: str, options: QueryOptions = QueryOptions(), query_vector: list[float] | None = None) -> DataFrame:
        """Files in rank order: path, score, best symbol with its place, members, confidence of the whole result, snippet or skeleton."""
        self._fresh()
        now = self.store.at()  # one version for the whole search
        symbols = now.read("symbols")
        sides = {"index": now.lexical()}
        if options.mode in ("hybrid", "full"):
            embeddings = now.read("embeddings") if query_vector else None
            sides |= dict(edges=now.read("edges"), imports=now.read("imports"), embeddings=embeddings, query_vector=query_vector, hops=options.graph_hops)
            if options.mode == "full":
                sides["corrected"] = options.corrected_scores
        found = checkpoint(retrieval.retrieve(symbols, query, options.max_results, options.mode, **sides))  # max_results rows, planned once
        rows = found.join(symbols.select(F.col("symbol_id").alias("best"), "name", "qualified_name", "file_path", "start_line", "end_line", "docstring", "signature"), "best")
        rows = rows.crossJoin(F.broadcast(retrieval.result_confidence(found)))  # one row
        if options.include_code and self.root:
            rows = self._with_code(rows, query)
        return rows.orderBy(F.desc(F.round("score", 9)), "ord")

    def _with_code(self, rows: DataFrame, query: str) -> DataFrame:
        paths = [r[0] for r in rows.select("file_path").distinct().collect()]  # at most max_results
        code = sources.read_files(self.spark, self.root, paths).select(F.col("path").alias("file_path"), F.decode("content", "UTF-8").alias("content"))
        failure = self.spark.range(1).select(parse_failure(F.lit(query)).alias("f")).filter("f is not null").select(F.explode("f.frames").alias("x")).select("x.*")
        active = skeleton.match_active_lines(rows.select("file_path").distinct(), skeleton.active_lines(failure))
        rows = rows.join(code, "file_path", "left").join(active, "file_path", "left")
        plain = sources.source_lines(F.col("content"), F.col("start_line"), F.col("end_line"))
        return rows.withColumn("snippet", F.when(F.col("active_lines").isNotNull(), skeleton.skeleton(F.col("content"), F.col("active_lines"))).otherwise(plain)).drop("content", "active_lines")

    def lookup_symbol(self, name: str, limit: int = 10) -> DataFrame:
        return retrieval.like_search(self.symbols(), name, limit)

    def symbol_info(self, qualified_name: str) -> DataFrame:
        return self.store.symbol(qualified_name)

    def symbol_source(self, qualified_name: str) -> DataFrame:
        found = self.symbol_info(qualified_name)
        code = sources.read_files(self.spark, self.root, [r[0] for r in found.select("path").collect()])  # one symbol
        return sources.extract_symbols_source(found, code.select("path", F.decode("content", "UTF-8").alias("content")))

    def callers(self, qualified_name: str) -> DataFrame:
        now = self.store.at()
        return graph.callers(now.read("calls"), now.read("symbols"), qualified_name)

    def callees(self, qualified_name: str) -> DataFrame:
        now = self.store.at()
        return graph.callees(now.read("calls"), now.read("symbols"), qualified_name)

    def relations(self, qualified_name: str, direction: str = "both") -> DataFrame:
        now = self.store.at()
        return graph.relations(now.read("calls"), now.read("symbols"), qualified_name, direction)

    def call_graph(self, root: str, depth: int = 2) -> tuple[DataFrame, DataFrame]:
        nodes, edges = self.store.load_graph()
        return graph.call_graph(nodes, edges, root, depth)

    def stats(self) -> DataFrame:
        now = self.store.at()
        s = now.commit.stats
        return freshness.index_stats(*[now.read(t) for t in ("symbols", "files", "imports", "calls")], s.get("resolved_calls", 0), s.get("unresolved_calls", 0))

    def snapshot(self, paths: list[str] | None = None) -> DataFrame:
        return freshness.snapshot(self.store.read("files"), paths)

    def validate_evidence(self, expected: DataFrame) -> DataFrame:
        return freshness.validate(expected, sources.file_table(sources.scan_tree(self.spark, self.root)))

    def diagnose(self, traces: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(bundles, evidence) of traces (trace_id, text)."""
        self._fresh()
        code = sources.scan_tree(self.spark, self.root) if self.root else None
        now = self.store.at()
        found = evidence.trace_evidence(traces, now.read("files"), now.read("symbols"), code, self.root)
        return evidence.bundles(traces, found), found
