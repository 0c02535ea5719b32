"""Evidence from traces and symbols: frames joined to files and symbols, bundles, results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loreline.functions.text import basename, evidence_id, path_to_module
from loreline.functions.trace import can_parse_python, can_parse_pytest, parse_failure
from loreline.sources.files import snippet

CONTEXT = 5


def trace_path(path: Column, root: str | None = None) -> Column:
    """Path in the project: below the root, else from the last /src/ or /tests/ on, else unchanged."""
    p = F.translate(path, "\\", "/")
    marked = F.regexp_extract(p, r"^.*/((?:src|tests)/.*)$", 1)
    tail = F.when(marked != "", marked).otherwise(p)
    if root:
        base = root.rstrip("/") + "/"
        return F.when(p.startswith(base), F.substring(p, len(base) + 1, 1 << 20)).otherwise(tail)
    return tail


def frame_name(path: Column, function: Column) -> Column:
    """Qualified name of a frame: module and function (a frame does not tell the class)."""
    return F.concat_ws(".", path_to_module(path), function)


def frames(traces: DataFrame, root: str | None = None) -> DataFrame:
    """trace_id, frame, file_path, line_number, function_name, code_line of all traces (trace_id, text) that parse."""
    parsed = traces.withColumn("failure", parse_failure(F.col("text"))).filter("failure is not null")
    rows = parsed.select("trace_id", F.posexplode("failure.frames").alias("frame", "f"))
    return rows.select("trace_id", "frame", trace_path(F.col("f.file_path"), root).alias("file_path"), "f.line_number", "f.function_name", "f.code_line")


def known_paths(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Replace paths that no file has by the file with the same base name, if one ends with the path (the first by path)."""
    exact = files.select(F.col("path").alias("file_path"), F.lit(True).alias("exact"))
    by_name = files.select(basename(F.col("path")).alias("base"), F.col("path").alias("found"))
    keyed = rows.join(exact, "file_path", "left").withColumn("base", basename(F.col("file_path"))).withColumn("rid", F.xxhash64(*rows.columns))
    hits = keyed.filter("exact is null").join(by_name, "base").filter(F.endswith("found", F.col("file_path")) | (F.col("file_path") == F.col("base"))).groupBy("rid").agg(F.min("found").alias("found"))
    out = keyed.join(hits, "rid", "left").withColumn("file_path", F.coalesce("found", "file_path"))
    return out.select(*rows.columns)


def trace_evidence(traces: DataFrame, files: DataFrame, symbols: DataFrame, sources: DataFrame | None = None, root: str | None = None, by_line: bool = False) -> DataFrame:
    """One evidence row a frame: evidence_id, symbol (by module and function name), lines around it, score 1.

    ``by_line`` also takes the innermost symbol around the line where the name matches none.
    """
    rows = known_paths(frames(traces, root), files).withColumn("qualified_name", frame_name(F.col("file_path"), F.col("function_name")))
    ids = symbols.groupBy("qualified_name").agg(F.min("symbol_id").alias("symbol_id"))
    out = rows.join(ids, "qualified_name", "left")
    if by_line:
        around = out.filter("symbol_id is null").alias("r").join(symbols.alias("s"), (F.col("r.file_path") == F.col("s.file_path")) & F.col("r.line_number").between(F.col("s.start_line"), F.col("s.end_line")))
        inner = around.groupBy("r.trace_id", "r.frame").agg(F.min_by("s.symbol_id", F.col("s.end_line") - F.col("s.start_line")).alias("inner_id"))
        out = out.join(inner, ["trace_id", "frame"], "left").withColumn("symbol_id", F.coalesce("symbol_id", "inner_id")).drop("inner_id")
    out = out.withColumns({"start_line": F.greatest(F.lit(1), F.col("line_number") - CONTEXT), "end_line": F.col("line_number") + CONTEXT, "score": F.lit(1.0), "source": F.lit("trace"),
                           "evidence_id": evidence_id(F.lit("trace"), F.col("trace_id"), F.col("frame"), F.col("file_path"), F.col("line_number"))})
    if sources is not None:
        out = out.join(sources.select(F.col("path").alias("file_path"), F.col("content").cast("string").alias("content")), "file_path", "left").withColumn("snippet", snippet(F.col("content"), F.col("line_number"))).drop("content")
    return out


def bundles(traces: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row a trace: summary (of the last exception), error type, proximate frame, call chain, confidence (0.8 with symbols, 0.4 without, 0 without evidence)."""
    text = F.col("text")
    last = F.try_element_at("failure.exceptions", F.lit(-1))
    frame = F.try_element_at("failure.frames", F.lit(-1))
    base = traces.withColumn("failure", parse_failure(text)).select(
        "trace_id",
        F.when(F.col("failure").isNull(), "Could not parse stack trace").when(F.size("failure.frames") == 0, "No valid frames").otherwise(F.concat_ws(": ", last["type"], F.nullif(last["message"], F.lit("")))).alias("summary"),
        last["type"].alias("error_type"), F.when(F.size("failure.frames") > 0, F.concat(frame["file_path"], F.lit(":"), frame["line_number"])).alias("proximate_cause"))
    per = evidence.groupBy("trace_id").agg(F.count(F.lit(1)).alias("n"), F.count("symbol_id").alias("with_symbol"),
                                           F.transform(F.array_sort(F.collect_list(F.struct("frame", F.concat(F.col("file_path"), F.lit(":"), F.col("start_line"), F.lit(" in "), F.coalesce("function_name", F.lit("?"))).alias("t")))), lambda x: x["t"]).alias("call_chain"))
    return base.join(per, "trace_id", "left").withColumn("confidence", F.when(F.coalesce("n", F.lit(0)) == 0, 0.0).when(F.col("with_symbol") > 0, 0.8).otherwise(0.4)).drop("n", "with_symbol")


def symbol_evidence(symbols: DataFrame, reason: str = "search") -> DataFrame:
    """Evidence rows of symbols."""
    return symbols.select(evidence_id(F.lit(reason), F.col("qualified_name"), F.col("start_line")).alias("evidence_id"), F.lit(reason).alias("source"), "file_path", F.col("qualified_name").alias("symbol"), "start_line", "end_line")


def append_new(evidence: DataFrame, more: DataFrame) -> DataFrame:
    """Add rows whose evidence_id is not there yet."""
    return evidence.unionByName(more.join(evidence.select("evidence_id"), "evidence_id", "left_anti"))


def dangling(hypotheses: DataFrame, evidence: DataFrame) -> DataFrame:
    """Hypotheses (hypothesis_id, evidence_ids) that cite evidence which does not exist."""
    cited = hypotheses.select("hypothesis_id", F.explode("evidence_ids").alias("evidence_id"))
    return cited.join(evidence.select("evidence_id"), "evidence_id", "left_anti")


def best_hypothesis(hypotheses: DataFrame) -> DataFrame:
    """The most confident one; ties to the smaller id."""
    return hypotheses.agg(F.max_by("hypothesis_id", F.struct("confidence", -F.col("hypothesis_id"))).alias("hypothesis_id"), F.max("confidence").alias("confidence"))


def should_stop(iteration: int, confidence: float, most: int = 5, enough: float = 0.8) -> bool:
    return iteration >= most or confidence >= enough


def _binned(spans: DataFrame, start: str, end: str) -> DataFrame:
    """Spans with a level, whose bins are 2 ** level lines wide and no shorter than the span, and each of the one or two bins that they touch."""
    level = F.ceil(F.log2(F.col(end) - F.col(start) + 1)).cast("int")
    leveled = spans.filter(F.col(start) <= F.col(end)).withColumn("_level", level)
    bins = F.array_distinct(F.array(F.expr(f"shiftright(`{start}`, _level)"), F.expr(f"shiftright(`{end}`, _level)")))
    return leveled.withColumn("_bin", F.explode(bins))


def frame_ranges(frames_: DataFrame, symbols: DataFrame) -> DataFrame:
    """Range join of frames to the symbols around their line; the innermost first.

    An equality on path, level and bin: a frame looks into one bin for each level that its file has (32 at most), so a file with very many
    symbols costs its matches and their neighbours, not all of its pairs, and its rows spread over many tasks.
    """
    spans = _binned(symbols.select("file_path", "symbol_id", "start_line", "end_line"), "start_line", "end_line")
    levels = spans.groupBy("file_path").agg(F.collect_set("_level").alias("_levels"))
    asked = frames_.select("trace_id", "frame", "file_path", "line_number").join(levels, "file_path").withColumn("_level", F.explode("_levels")).withColumn("_bin", F.expr("shiftright(line_number, _level)")).drop("_levels")
    rows = asked.join(spans, ["file_path", "_level", "_bin"]).filter(F.col("line_number").between(F.col("start_line"), F.col("end_line")))
    inner = Window.partitionBy("trace_id", "frame").orderBy(F.col("end_line") - F.col("start_line"), "symbol_id")
    return rows.select("trace_id", "frame", "symbol_id", "start_line", "end_line").withColumn("rank", F.row_number().over(inner))


__all__ = ["append_new", "best_hypothesis", "bundles", "can_parse_pytest", "can_parse_python", "dangling", "frame_name", "frame_ranges", "frames", "known_paths", "should_stop", "symbol_evidence", "trace_evidence", "trace_path"]
