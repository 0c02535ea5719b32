"""Maintenance of resolved names: after a change only what mentions a changed name is resolved again.

``names`` (name, qname, path, pos, type, symbol_id) holds a row for each symbol. Whatever a call, import or base class resolves to has one of a few
short names: the last part of its target, of what calls it, or of what it resolved to. If the rows of those names are as before,
so is the resolution. A changed file therefore gives the short names whose rows differ (``changed_names``), and only rows of its own and
rows that mention one of these are ``stale``; all others are carried over.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreline.operators import resolve

CALL = ("path", "pos", "target", "call_type", "caller_class", "caller_qname", "line_number")
BASE = ("path", "pos", "child", "parent", "line_number")
IMPORT = ("path", "pos", "module_path", "imported_name", "alias", "line_number")


def last(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def names_of(symbols: DataFrame) -> DataFrame:
    return symbols.select("name", F.col("qualified_name").alias("qname"), F.col("file_path").alias("path"), "pos", "type", "symbol_id")


def changed_rows(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows (name, qname, type) that are in one table of names and not in the other."""
    key = ("name", "qname", "path", "pos", "type", "symbol_id")
    sides = before.select(*key, F.lit(1).alias("side")).unionByName(after.select(*key, F.lit(2).alias("side")))
    return sides.groupBy(*key).agg(F.sum("side").alias("sides")).filter("sides <> 3").select("name", "qname", "type")


def changed_names(before: DataFrame, after: DataFrame) -> DataFrame:
    return changed_rows(before, after).select("name").distinct()


def index_of(names: DataFrame) -> DataFrame:
    """The candidates of every short name, as ``resolve.symbol_index`` has them."""
    return names.select("name", "qname", F.struct(F.col("path").alias("file_path"), "pos", F.col("qname").alias("qualified_name")).alias("at"))


def _any_of(rows: DataFrame, columns: list[Column], changed: DataFrame, key: tuple[str, ...], how: str) -> DataFrame:
    """Rows in which one of the names has changed (left_semi), or none has (left_anti)."""
    mentioned = rows.select(*key, F.explode(F.array_distinct(F.array(*columns))).alias("name")).join(changed, "name", "left_semi").select(*key).distinct()
    return rows.join(mentioned, list(key), how)


MENTIONS = {"resolved": ("target", "caller", "callee"), "resolved_bases": ("child", "parent", "parent_qname"), "resolved_imports": ("dst",)}


def stale(kind: str, rows: DataFrame, changed: DataFrame) -> DataFrame:
    return _any_of(rows, [last(F.col(c)) for c in MENTIONS[kind]], changed, ("path", "pos"), "left_semi")


def carried(kind: str, rows: DataFrame, changed: DataFrame) -> DataFrame:
    return _any_of(rows, [last(F.col(c)) for c in MENTIONS[kind]], changed, ("path", "pos"), "left_anti")


def mentions(calls: DataFrame, bases: DataFrame, imports: DataFrame, symbols: DataFrame) -> DataFrame:
    """path, name: every short name that the resolution of a file's rows may depend on."""
    whose = resolve.resolve_caller(F.col("caller_qname"), F.col("caller_class"), F.col("path"))
    parts = [calls.select("path", F.explode(F.array(last(F.col("target")), last(whose))).alias("name")),
             bases.select("path", F.explode(F.array(last(F.col("child")), last(F.col("parent")))).alias("name")),
             imports.select("path", last(resolve.import_name(F.col("module_path"), F.col("imported_name"))).alias("name")),
             symbols.select(F.col("file_path").alias("path"), last(F.regexp_replace("qualified_name", r"\.[^.]+$", "")).alias("name"))]
    return reduce(DataFrame.unionByName, parts).filter("name is not null").distinct()


def _only(names: DataFrame, wanted: DataFrame | None, by: str) -> DataFrame:
    return names if wanted is None else names.join(wanted, by, "left_semi")


def _ids(names: DataFrame, name: str, given: str) -> DataFrame:
    return names.groupBy(F.col("qname").alias(name)).agg(F.min("symbol_id").alias(given))


def resolve_calls(calls: DataFrame, names: DataFrame, few: bool = False) -> DataFrame:
    """Calls with caller, callee, resolution, confidence and the ids of both ends (null if unknown). ``few``: reduce the names to those asked for."""
    asked = calls.select(F.explode(F.array("target", last(F.col("target")))).alias("name")).distinct() if few else None
    found = resolve.resolved_calls(calls.select(*CALL), index_of(_only(names, asked, "name")))
    ends = found.select(F.explode(F.array("caller", "callee")).alias("qname")).distinct() if few else None
    known = _only(names, ends, "qname")
    return (found.join(_ids(known, "caller", "caller_id"), "caller", "left").join(_ids(known, "callee", "callee_id"), "callee", "left")
            .select(*CALL, "caller", "callee", "resolution", "confidence", "caller_id", "callee_id"))


def resolve_bases(bases: DataFrame, imports: DataFrame, names: DataFrame, few: bool = False) -> DataFrame:
    """Base classes with the parent's qualified name and both ids."""
    asked = bases.select(F.col("parent").alias("name")).distinct() if few else None
    found = resolve.resolve_parents(bases.select(*BASE), imports, index_of(_only(names, asked, "name")))
    ends = found.select(F.explode(F.array("child", "parent_qname")).alias("qname")).distinct() if few else None
    known = _only(names, ends, "qname")
    return found.join(_ids(known, "child", "child_id"), "child", "left").join(_ids(known, "parent_qname", "parent_id"), "parent_qname", "left").select(*BASE, "parent_qname", "child_id", "parent_id")


def resolve_imports(imports: DataFrame, names: DataFrame, few: bool = False) -> DataFrame:
    """Imports with the name they stand for, and whether a symbol has it."""
    rows = imports.select(*IMPORT).withColumn("dst", resolve.import_name(F.col("module_path"), F.col("imported_name")))
    known = _only(names, rows.select(F.col("dst").alias("qname")).distinct() if few else None, "qname").select(F.col("qname").alias("dst")).distinct().withColumn("known", F.lit(True))
    return rows.join(known, "dst", "left").select(*IMPORT, "dst", F.coalesce("known", F.lit(False)).alias("known"))


def edges_of(resolved: DataFrame, bases: DataFrame, imports: DataFrame) -> DataFrame:
    """Graph edges of resolved rows, before repeated pairs are reduced."""
    return resolve.import_edges_of(imports).unionByName(resolve.inherit_edges(bases)).unionByName(resolve.call_edges(resolved))


def maintain_calls(before: DataFrame, gone: DataFrame, fresh: DataFrame, names: DataFrame, changed: DataFrame) -> DataFrame:
    """Resolved calls after a change: ``before`` without those of ``gone`` paths, stale ones resolved again, and ``fresh`` raw ones.

    ``again`` tells the rows that were resolved in this step.
    """
    kept = before.join(gone.select("path"), "path", "left_anti")
    again = stale("resolved", kept, changed).select(*CALL).unionByName(fresh.select(*CALL))
    return carried("resolved", kept, changed).withColumn("again", F.lit(False)).unionByName(resolve_calls(again, names, True).withColumn("again", F.lit(True)))
