"""Name resolution: raw calls, imports and base classes to edges, by joins on reduced keys.

A short name may have a share of all symbols as candidates, so calls never meet them all: the index is first reduced to one row for each
name, for each name and dotted prefix, and for each dotted suffix (all aggregated map-side), and calls join those by equality.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreline.functions.text import path_to_module, same_top_package


def _met(rows: DataFrame) -> DataFrame:
    """Rows to be joined by a shuffle. Symbols come out of parsed or exploded rows, of which the planner knows no size: it would send millions
    of them through the driver as a small table."""
    return rows.hint("merge")


def symbol_index(symbols: DataFrame) -> DataFrame:
    """name, qname, at: candidates of every short name; ``at`` orders them by arrival."""
    order = [F.col(c) for c in ("file_path", "pos") if c in symbols.columns] or [F.col("symbol_id")]
    return symbols.select("name", F.col("qualified_name").alias("qname"), F.struct(*order, F.col("qualified_name")).alias("at"))


def candidates(index: DataFrame) -> DataFrame:
    """name -> qualified names in arrival order."""
    return index.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "qname"))), lambda x: x["qname"]).alias("qnames"))


def first_of(index: DataFrame) -> DataFrame:
    """name, first (the candidate that arrived first), n candidates."""
    return index.groupBy("name").agg(F.min_by("qname", "at").alias("first"), F.count(F.lit(1)).alias("n"))


def _cut(qname: Column, front: bool) -> Column:
    """All dotted prefixes of a name (each with its dot), or all dotted suffixes (the name itself first)."""
    parts = F.split(qname, r"\.")
    n = F.size(parts)
    if front:
        return F.transform(F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>")), lambda k: F.concat(F.array_join(F.slice(parts, F.lit(1), k), "."), F.lit(".")))
    return F.transform(F.sequence(F.lit(1), n), lambda k: F.array_join(F.slice(parts, k, n), "."))


def first_in_module(index: DataFrame) -> DataFrame:
    """name, prefix, inside: the first candidate whose qualified name begins with that dotted prefix."""
    return index.select("name", "qname", "at", F.explode(_cut(F.col("qname"), True)).alias("prefix")).groupBy("name", "prefix").agg(F.min_by("qname", "at").alias("inside"))


def first_with_suffix(index: DataFrame) -> DataFrame:
    """name, suffix, ending: the first candidate that is, or ends with a dot and, the suffix."""
    return index.select("name", "qname", "at", F.explode(_cut(F.col("qname"), False)).alias("suffix")).groupBy("name", "suffix").agg(F.min_by("qname", "at").alias("ending"))


def module_prefix(name: Column) -> Column:
    return F.concat(F.regexp_replace(name, r"\.[^.]*$", ""), F.lit("."))


def resolve_caller(caller_qname: Column, caller_class: Column, path: Column) -> Column:
    return F.coalesce(F.nullif(caller_qname, F.lit("")), F.nullif(caller_class, F.lit("")), path_to_module(path))


def resolve_callees(calls: DataFrame, index: DataFrame) -> DataFrame:
    """Calls (target, call_type, caller_class, ...) with callee, resolution, confidence.

    Rules in order: own class for self calls (1.0), a candidate of the caller's module (0.9), the only candidate (1.0), the first of n
    (1 / n); for dotted targets without candidates a suffix match (1.0, or 0.8 among several); else the raw target (0.0). An empty target
    gives nulls.
    """
    own = F.col("caller_class")
    has_class = F.coalesce(own != "", F.lit(False))
    dotted = F.contains("target", F.lit("."))
    keyed = calls.withColumns({"_name": F.col("target"), "_prefix": F.when(has_class, module_prefix(own)), "_last": F.when(dotted, F.substring_index("target", ".", -1)), "_suffix": F.when(dotted, F.col("target"))})
    named = first_of(index).withColumnsRenamed({"name": "_name"})
    last = first_of(index).select(F.col("name").alias("_last"), F.col("n").alias("_m"))
    rows = (keyed.join(_met(named), "_name", "left").join(_met(first_in_module(index).withColumnsRenamed({"name": "_name", "prefix": "_prefix"})), ["_name", "_prefix"], "left")
            .join(_met(first_with_suffix(index).withColumnsRenamed({"name": "_last", "suffix": "_suffix"})), ["_last", "_suffix"], "left").join(_met(last), "_last", "left"))
    rules = [(F.coalesce((F.col("call_type") == "self") & has_class, F.lit(False)), F.concat_ws(".", own, "target"), F.lit("self_method"), F.lit(1.0)),
             (F.col("inside").isNotNull(), F.col("inside"), F.lit("module_match"), F.lit(0.9)),
             (F.col("n") == 1, F.col("first"), F.lit("exact_match"), F.lit(1.0)),
             (F.col("n") > 1, F.col("first"), F.lit("first_candidate"), F.lit(1.0) / F.col("n")),
             (F.col("ending").isNotNull(), F.col("ending"), F.lit("suffix_match"), F.when(F.col("_m") == 1, 1.0).otherwise(0.8))]
    r = F.struct(F.col("target").alias("callee"), F.lit("unresolved").alias("resolution"), F.lit(0.0).alias("confidence"))
    for fits, callee, resolution, confidence in reversed(rules):
        r = F.when(fits, F.struct(callee.alias("callee"), resolution.alias("resolution"), confidence.alias("confidence"))).otherwise(r)
    return rows.withColumn("r", F.when(F.coalesce(F.col("target") != "", F.lit(False)), r)).select(*calls.columns, "r.callee", "r.resolution", "r.confidence")


def import_name(module: Column, name: Column) -> Column:
    return F.when(name.isNotNull() & (name != ""), F.when(module != "", F.concat_ws(".", module, name)).otherwise(name)).otherwise(F.nullif(module, F.lit("")))


def import_edges_of(resolved: DataFrame) -> DataFrame:
    """Edges from a module to what it imports, of imports (path, pos, line_number, dst, known)."""
    return resolved.filter("known").select(path_to_module(F.col("path")).alias("src"), "dst", F.lit("imports").alias("relation_type"), "line_number", F.lit(1.0).alias("weight"), F.lit(1.0).alias("confidence"), F.lit(None).cast("string").alias("resolution"), F.lit(1).alias("phase"), F.xxhash64("path", "pos").alias("ord"))


def import_edges(imports: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges from a module to the symbols it imports (only names that exist)."""
    rows = imports.withColumn("dst", import_name(F.col("module_path"), F.col("imported_name")))
    known = symbols.select(F.col("qualified_name").alias("dst")).distinct()
    return import_edges_of(rows.join(_met(known), "dst").withColumn("known", F.lit(True)))


def resolve_parents(bases: DataFrame, imports: DataFrame, index: DataFrame) -> DataFrame:
    """Base classes (child, parent, path, line_number, pos) with the parent's qualified name: same module, an import of that name, the
    first candidate, else the raw name."""
    b = bases.withColumn("base_id", F.xxhash64("path", "pos", "child", "parent"))
    given = imports.select("path", F.when(F.coalesce("alias", F.lit("")) != "", F.col("alias")).otherwise(F.col("imported_name")).alias("parent"), import_name(F.col("module_path"), F.col("imported_name")).alias("qname")).distinct()
    # symbols of one qualified name may be a share of all: one row for each name, before bases meet them
    told = index.groupBy(F.col("name").alias("parent"), "qname").agg(F.min("at").alias("at"))
    via = (b.select("base_id", "path", "parent").join(_met(given), ["path", "parent"]).join(_met(told), ["parent", "qname"])
           .groupBy("base_id").agg(F.min_by("qname", "at").alias("imported")))
    found = (b.withColumn("prefix", module_prefix(F.col("child"))).join(_met(first_in_module(index).withColumnRenamed("name", "parent")), ["parent", "prefix"], "left")
             .join(_met(via), "base_id", "left").join(_met(first_of(index).withColumnRenamed("name", "parent")), "parent", "left"))
    return found.withColumn("parent_qname", F.coalesce("inside", "imported", "first", "parent")).select(*bases.columns, "parent_qname")


def inherit_edges(resolved: DataFrame) -> DataFrame:
    return resolved.select(F.col("child").alias("src"), F.col("parent_qname").alias("dst"), F.lit("inherits").alias("relation_type"), "line_number", F.lit(1.0).alias("weight"), F.lit(1.0).alias("confidence"), F.lit(None).cast("string").alias("resolution"), F.lit(2).alias("phase"), F.xxhash64("path", "pos").alias("ord"))


def resolved_calls(calls: DataFrame, index: DataFrame) -> DataFrame:
    keyed = calls.withColumn("call_id", F.xxhash64("path", "pos", "target", "line_number"))
    return resolve_callees(keyed, index).withColumn("caller", resolve_caller(F.col("caller_qname"), F.col("caller_class"), F.col("path")))


def call_edges(resolved: DataFrame) -> DataFrame:
    return resolved.filter("caller is not null and callee is not null").select(F.col("caller").alias("src"), F.col("callee").alias("dst"), F.lit("calls").alias("relation_type"), "line_number", F.lit(1.0).alias("weight"), "confidence", "resolution", F.lit(3).alias("phase"), F.xxhash64("path", "pos").alias("ord"))


def is_known() -> Column:
    return F.col("caller_id").isNotNull() & F.col("callee_id").isNotNull()


def stored_of(resolved: DataFrame, *also: str) -> DataFrame:
    """calls rows of resolved calls whose two ends exist. Within one top package confidence is 0.85 at least and the label same_module."""
    near = same_top_package(F.col("caller"), F.col("callee"))
    kind, sure = F.when(near, "same_module").otherwise(F.col("resolution")), F.when(near, F.greatest(F.lit(0.85), F.col("confidence"))).otherwise(F.col("confidence"))
    return resolved.filter(is_known()).select("caller_id", "callee_id", kind.alias("call_type"), sure.alias("confidence"), "line_number", *also)


def build_edges(symbols: DataFrame, imports: DataFrame, bases: DataFrame, calls: DataFrame) -> DataFrame:
    """All edges in phase order: imports, inheritance, calls."""
    index = symbol_index(symbols)
    return import_edges(imports, symbols).unionByName(inherit_edges(resolve_parents(bases, imports, index))).unionByName(call_edges(resolved_calls(calls, index)))
