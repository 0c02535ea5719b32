"""Skeletons of Python sources: function bodies without an active line collapse to one comment, active lines get an arrow."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def skeletonize(source: str, active: set[int]) -> str:
    """Text of one source. A source that does not parse only has its active lines marked."""
    if not source.strip():
        return source
    lines = source.splitlines()
    try:
        found = [n for n in ast.walk(ast.parse(source)) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))]
    except (SyntaxError, ValueError, RecursionError):
        found = []
    # bodies by first and last line; a body on the line of its def is left alone, and of nested bodies the outermost collapses
    bodies = sorted((n.body[0].lineno, n.end_lineno, n.lineno) for n in found)
    fold: dict[int, int] = {}
    done = 0
    for first, last, head in bodies:
        if first > head and first > done and not any(first <= a <= last for a in active):
            fold[first], done = last, last
    out, at = [], 1
    while at <= len(lines):
        text = lines[at - 1]
        if at in fold:
            out.append(f"{text[:len(text) - len(text.lstrip())]}# ... [{fold[at] - at + 1} lines collapsed]")
            at = fold[at] + 1
        else:
            out.append(f"=> {text}" if at in active else text)
            at += 1
    return "\n".join(out) + ("\n" if source.endswith("\n") else "")


@F.pandas_udf(T.StringType())
def _skeletons(source: pd.Series, active: pd.Series) -> pd.Series:
    return pd.Series([skeletonize(s, {int(x) for x in a} if a is not None else set()) if s is not None else None for s, a in zip(source, active)], dtype=object)


def skeleton(source: Column, active_lines: Column) -> Column:
    """Column form: (source string, array<int>)."""
    return _skeletons(source, active_lines)


def active_lines(frames: DataFrame) -> DataFrame:
    """Lines of each path that frames (file_path, line_number) point at."""
    return frames.filter("line_number is not null").groupBy("file_path").agg(F.sort_array(F.collect_set("line_number")).alias("active_lines"))


def match_active_lines(files: DataFrame, active: DataFrame) -> DataFrame:
    """Each file with the lines of the first frame path that equals, contains or is contained in its path, or has its base name.

    ``active`` comes from one query's frames, so its size is bounded by a trace.
    """
    a, p = F.col("a.file_path"), F.col("f.file_path")
    base = lambda c: F.substring_index(c, "/", -1)
    hit = F.contains(p, a) | F.contains(a, p) | (base(p) == base(a))
    pairs = files.alias("f").join(F.broadcast(active.alias("a")), hit, "left")
    return pairs.groupBy(p.alias("file_path")).agg(F.min_by(F.col("a.active_lines"), F.struct(F.coalesce("a.ord", F.lit(0)) if "ord" in active.columns else a)).alias("active_lines"))
