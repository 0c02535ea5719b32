"""Command line: python -m loreline COMMAND --store DIR [--root DIR] [ARG]."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from loreline import api
from loreline.options import QueryOptions
from loreline.plans import evaluation, index_job, report
from loreline.plans.query_service import QueryService
from loreline.sources import files
from loreline.streaming import watch

COMMANDS = ("index", "query", "show", "graph", "tree", "visualize", "stats", "clear", "watch", "eval", "diagnose", "changed")


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser("loreline", description=__doc__)
    p.add_argument("command", choices=COMMANDS)
    p.add_argument("arg", nargs="?", default="")
    p.add_argument("--store", default="./index")
    p.add_argument("--root", default=".")
    p.add_argument("--mode", default="full")
    p.add_argument("--limit", type=int, default=10)
    p.add_argument("--depth", type=int, default=2)
    p.add_argument("--once", action="store_true")
    p.add_argument("--incremental", action="store_true")
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("loreline").getOrCreate()
    svc = QueryService(spark, a.store, a.root)
    if a.command == "index":
        print(api.index_repository(spark, a.root, a.store, a.incremental))
    elif a.command == "query":
        svc.search(a.arg, QueryOptions(max_results=a.limit, mode=a.mode)).select("norm_path", "score", "qualified_name", "confidence").show(a.limit, False)
    elif a.command == "show":
        svc.symbol_source(a.arg).show(1, False)
    elif a.command in ("graph", "tree", "visualize"):
        nodes, edges = svc.call_graph(a.arg, a.depth)
        print(report.mermaid(nodes, edges) if a.command == "graph" else report.tree(edges, a.arg, a.depth) if a.command == "tree" else report.write_graph_html(nodes, edges, a.arg, a.store))
    elif a.command == "stats":
        svc.stats().show()
    elif a.command == "clear":
        svc.store.clear()
    elif a.command == "watch":
        if a.once:
            print(watch.watch_once(spark, a.root, a.store) or "current")
        else:
            watch.watch(spark, a.root, a.store).awaitTermination()
    elif a.command == "eval":
        evaluation.compare_modes(svc, files.read_cases(spark, a.arg)).show()
    elif a.command == "diagnose":
        bundle, found = svc.diagnose(files.read_traces(spark, a.arg).selectExpr("0L as trace_id", "text"))
        print(report.evidence_markdown(bundle.first().asDict(), [r.asDict() for r in found.orderBy("frame").collect()]))
    elif a.command == "changed":
        index_job.sources.changed_files_since(spark, a.root).show(1000, False)


if __name__ == "__main__":
    main()
