"""Retrieval benchmark: run cases through a mode, score them, compare modes.

All cases of a mode are one plan (``operators.batch``); the time of a case is that of the mode divided by its cases. ``run_cases_apart`` gives every
case a search of its own, as a user would, and the same results.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreline.functions.text import symbol_text
from loreline.operators import batch, bm25, evaluate
from loreline.options import QueryOptions
from loreline.plans.query_service import QueryService
from loreline.sources.shared import checkpoint

RESULT = "case_id string, rank int, file_path string, name string, line_number int, matched array<struct<name:string,start_line:int>>, seconds double"


def run_cases(service: QueryService, cases: DataFrame, mode: str = "full", top: int = 5) -> DataFrame:
    """Results of every case: case_id, rank, file_path, name, line_number, matched, seconds (the mean of all cases)."""
    now = service.store.at()
    symbols, began = now.read("symbols"), time.time()
    sides = {"index": now.lexical()} if mode != "symbol_only" else {}
    if mode in ("hybrid", "full"):
        sides |= dict(edges=now.read("edges"), imports=now.read("imports"))
    asked = cases.select(F.col("case_id").alias("query_id"), "query")
    found = checkpoint(batch.retrieve(symbols, asked, top, mode, **sides).select("query_id", "rank", "best", "members"))
    seconds = (time.time() - began) / max(1, cases.count())
    of = symbols.select("symbol_id", "file_path", "name", "start_line")
    matched = (found.select("query_id", "rank", F.posexplode("members").alias("at", "symbol_id")).join(of, "symbol_id").groupBy("query_id", "rank")
               .agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "name", "start_line"))), lambda x: F.struct(x["name"].alias("name"), x["start_line"].alias("start_line"))).alias("matched")))
    rows = found.join(of.withColumnRenamed("symbol_id", "best"), "best").join(matched, ["query_id", "rank"])
    return rows.select(F.col("query_id").alias("case_id"), "rank", "file_path", "name", F.col("start_line").alias("line_number"), "matched", F.lit(seconds).alias("seconds"))


def run_cases_apart(service: QueryService, cases: DataFrame, mode: str = "full", top: int = 5) -> DataFrame:
    """``run_cases`` by one search a case, each with its own seconds."""
    spark, symbols = service.spark, service.symbols()
    names = symbols.select("symbol_id", F.struct("name", "start_line").alias("m"))
    rows = []
    for case in cases.select("case_id", "query").orderBy("case_id").collect():  # a benchmark's cases
        began = time.time()
        found = service.search(case["query"], QueryOptions(max_results=top, mode=mode, include_code=False))
        got = found.select("best", "file_path", "name", "start_line", "members").collect()
        seconds = time.time() - began
        members = {r["symbol_id"]: (r["m"]["name"], r["m"]["start_line"]) for r in names.filter(F.col("symbol_id").isin([m for g in got for m in g["members"]])).collect()} if got else {}
        rows += [(case["case_id"], k + 1, g["file_path"], g["name"], g["start_line"], [members[m] for m in g["members"] if m in members], seconds) for k, g in enumerate(got)]
    return spark.createDataFrame(rows, RESULT)


def keyword_batch(symbols: DataFrame, cases: DataFrame, top: int = 5) -> DataFrame:
    """BM25 results of all cases in one job: case_id, rank, file_path, name, line_number, matched."""
    docs = symbols.select("symbol_id", symbol_text(F.col("name"), F.col("qualified_name"), F.col("docstring"), F.col("signature")).alias("text"))
    found = bm25.search(docs, cases.select(F.col("case_id").alias("query_id"), "query"), top, "symbol_id")
    return found.join(symbols, found["doc_id"] == symbols["symbol_id"]).select(F.col("query_id").alias("case_id"), "rank", "file_path", "name", F.col("start_line").alias("line_number"), F.lit(None).cast("array<struct<name:string,start_line:int>>").alias("matched"))


def evaluate_mode(service: QueryService, cases: DataFrame, mode: str = "full") -> DataFrame:
    """One row a case: hits, function rate, class, seconds."""
    results = run_cases(service, cases, mode)
    seconds = results.groupBy("case_id").agg(F.max("seconds").alias("seconds"))
    return evaluate.evaluate(cases, results.drop("seconds"), service.symbols()).join(seconds, "case_id", "left")


def compare_modes(service: QueryService, cases: DataFrame, modes: tuple[str, ...] = ("keyword_only", "symbol_only", "hybrid", "full")) -> DataFrame:
    """One row a mode: cases, rates, mean seconds."""
    parts = [evaluate_mode(service, cases, m).withColumn("mode", F.lit(m)) for m in modes]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return evaluate.metrics(out, "mode")
