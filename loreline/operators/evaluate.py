"""Retrieval evaluation: hits, rates, failure classes, mode comparison. All cases are one table, so one job answers them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreline.functions.text import normalize_path, normalize_symbol
from loreline.operators.evidence import _binned

# Classes of failures.
CATEGORIES = ("stacktrace_parse_miss", "missed_recall", "ranking_error", "function_miss", "evaluator_warning", "other")


def classify_failure(top1: Column, top3: Column, function_rate: Column, is_trace: Column, parsed: Column) -> Column:
    return (F.when(is_trace & ~parsed, "stacktrace_parse_miss").when(~top3, "missed_recall").when(~top1, "ranking_error").when(function_rate < 1.0, "function_miss").otherwise("other"))


def file_hits(cases: DataFrame, results: DataFrame) -> DataFrame:
    """case_id, top1, top3 from results (case_id, rank, file_path)."""
    wanted = cases.select("case_id", F.explode("expected_files").alias("f")).select("case_id", normalize_path(F.col("f")).alias("path")).distinct()
    hit = results.select("case_id", "rank", normalize_path(F.col("file_path")).alias("path")).join(wanted, ["case_id", "path"]).groupBy("case_id").agg(F.min("rank").alias("best"))
    return cases.select("case_id").join(hit, "case_id", "left").select("case_id", F.coalesce(F.col("best") <= 1, F.lit(False)).alias("top1"), F.coalesce(F.col("best") <= 3, F.lit(False)).alias("top3"))


def function_hits(cases: DataFrame, results: DataFrame, symbols: DataFrame, top: int = 5) -> DataFrame:
    """case_id, function_rate: share of expected functions hit by one of the first results.

    results: (case_id, rank, file_path, name, line_number, matched array<struct<name, start_line>>). A result hits if its file is expected
    and its name, a matched name, or a symbol of that name around one of its lines is the expected one.
    """
    asked = cases.select("case_id", F.explode("expected_functions").alias("fn")).withColumn("fn", normalize_symbol(F.col("fn"))).distinct()
    files = cases.select("case_id", F.explode("expected_files").alias("f")).select("case_id", normalize_path(F.col("f")).alias("path")).distinct()
    found = results.filter(F.col("rank") <= top).withColumn("path", normalize_path(F.col("file_path"))).join(files, ["case_id", "path"], "left_semi")
    names = found.select("case_id", F.explode(F.concat(F.array("name"), F.coalesce(F.transform("matched", lambda m: m["name"]), F.array().cast("array<string>")))).alias("n")).select("case_id", normalize_symbol(F.col("n")).alias("fn"))
    lines = found.select("case_id", F.explode(F.concat(F.array(F.col("line_number").cast("int")), F.coalesce(F.transform("matched", lambda m: m["start_line"].cast("int")), F.array().cast("array<int>")))).alias("line")).filter("line is not null")
    spans = symbols.select(normalize_symbol(F.col("name")).alias("fn"), "start_line", "end_line").union(symbols.select(normalize_symbol(F.col("qualified_name")), "start_line", "end_line")).distinct()
    # a name may have very many spans: cases meet their own few lines, and spans the different (name, line) pairs alone
    near = asked.join(lines.distinct(), "case_id")
    binned = _binned(spans, "start_line", "end_line")
    levels = binned.groupBy("fn").agg(F.collect_set("_level").alias("_levels"))
    pairs = near.select("fn", "line").distinct().join(levels, "fn").withColumn("_level", F.explode("_levels")).withColumn("_bin", F.expr("shiftright(line, _level)")).drop("_levels")
    covered = pairs.join(binned, ["fn", "_level", "_bin"]).filter(F.col("line").between(F.col("start_line"), F.col("end_line"))).select("fn", "line").distinct()
    by_line = near.join(covered, ["fn", "line"], "left_semi").select("case_id", "fn")
    hit = asked.join(names.union(by_line).distinct().withColumn("hit", F.lit(1.0)), ["case_id", "fn"], "left")
    rate = hit.groupBy("case_id").agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("function_rate"))
    return cases.select("case_id").join(rate, "case_id", "left").select("case_id", F.coalesce("function_rate", F.lit(0.0)).alias("function_rate"))


def metrics(scored: DataFrame, by: str | None = None) -> DataFrame:
    """Rates over cases (top1, top3, function_rate[, seconds]); nulls for an empty table."""
    aggs = [F.count(F.lit(1)).alias("cases"), F.avg(F.col("top1").cast("double")).alias("top1_rate"), F.avg(F.col("top3").cast("double")).alias("top3_rate"), F.avg("function_rate").alias("function_rate")]
    if "seconds" in scored.columns:
        aggs.append(F.avg("seconds").alias("mean_seconds"))
    return scored.groupBy(by).agg(*aggs) if by else scored.agg(*aggs)


def failure_histogram(classified: DataFrame) -> DataFrame:
    """category, n with a row for each class, zeros included."""
    every = classified.sparkSession.createDataFrame([(c,) for c in CATEGORIES], "category string")
    return every.join(classified.groupBy("category").agg(F.count(F.lit(1)).alias("n")), "category", "left").select("category", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def evaluate(cases: DataFrame, results: DataFrame, symbols: DataFrame) -> DataFrame:
    """One row a case: top1, top3, function_rate, category."""
    from loreline.functions.trace import is_stack_trace, parse_failure

    rows = cases.join(file_hits(cases, results), "case_id").join(function_hits(cases, results, symbols), "case_id")
    trace = is_stack_trace(F.col("query"))
    return rows.select("case_id", "top1", "top3", "function_rate", classify_failure(F.col("top1"), F.col("top3"), F.col("function_rate"), trace, parse_failure(F.col("query")).isNotNull()).alias("category"))
