"""Plain functions over an index, one for each tool of the service: what an agent or a script calls."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession

from loreline.operators import evidence as ev
from loreline.options import IndexOptions, IndexResult, QueryOptions
from loreline.plans import index_job
from loreline.plans.query_service import QueryService
from loreline.sources import files as sources


def inside_roots(path: str, roots: list[str]) -> bool:
    """Whether a path lies in one of the allowed roots (after resolving dots)."""

    def parts(p: str) -> tuple[str, ...]:
        out: list[str] = []
        for x in PurePosixPath(p.replace("\\", "/")).parts:
            if x == "..":
                out = out[:-1] if len(out) > 1 else out
            elif x != ".":
                out.append(x)
        return tuple(out)

    own = parts(path)
    return any(own[:len(r)] == r for r in map(parts, roots))


def index_repository(spark: SparkSession, root: str, store: str, incremental: bool = False) -> IndexResult:
    return index_job.index_directory(spark, root, store, IndexOptions(incremental=incremental))


def refresh_index(spark: SparkSession, root: str, store: str) -> IndexResult | None:
    return index_job.refresh_if_stale(spark, root, store)


def validate_index_freshness(spark: SparkSession, root: str, store: str) -> DataFrame:
    return index_job.check_freshness(spark, root, store)


def validate_evidence(spark: SparkSession, root: str, store: str, expected: dict[str, str]) -> DataFrame:
    return QueryService(spark, store, root).validate_evidence(spark.createDataFrame(list(expected.items()), "path string, hash string"))


def changed_files_since(spark: SparkSession, root: str) -> DataFrame:
    return sources.changed_files_since(spark, root)


def search_symbols(spark: SparkSession, store: str, query: str, limit: int = 10, root: str | None = None, mode: str = "full") -> DataFrame:
    found = QueryService(spark, store, root).search(query, QueryOptions(max_results=limit, mode=mode))
    return ev.symbol_evidence(found)


def get_symbol_source(spark: SparkSession, root: str, store: str, qualified_name: str) -> DataFrame:
    return QueryService(spark, store, root).symbol_source(qualified_name)


def expand_symbol_relations(spark: SparkSession, store: str, qualified_name: str, direction: str = "both") -> DataFrame:
    return QueryService(spark, store).relations(qualified_name, direction)


def find_failure_evidence(spark: SparkSession, root: str, store: str, trace: str) -> DataFrame:
    return QueryService(spark, store, root).diagnose(spark.createDataFrame([(0, trace)], "trace_id long, text string"))[1]


def run_diagnosis(spark: SparkSession, root: str, store: str, trace: str) -> DataFrame:
    return QueryService(spark, store, root).diagnose(spark.createDataFrame([(0, trace)], "trace_id long, text string"))[0]
