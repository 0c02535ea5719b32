"""Snapshots and their differences: what is new, changed, deleted, and the merge that follows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diff(indexed: DataFrame, current: DataFrame) -> DataFrame:
    """path, status over the full outer join of (path, hash): unchanged, changed, new, deleted; error where a current hash is null."""
    old, new = indexed.select("path", F.col("hash").alias("old"), F.lit(True).alias("was")), current.select("path", F.col("hash").alias("new"), F.lit(True).alias("is"))
    status = (F.when(F.col("was").isNull() & F.col("new").isNull(), "error").when(F.col("was").isNull(), "new").when(F.col("is").isNull(), "deleted")
              .when(F.col("new").isNull(), "error").when(F.col("old") == F.col("new"), "unchanged").otherwise("changed"))
    return old.join(new, "path", "full_outer").select("path", status.alias("status"))


def report(differences: DataFrame) -> DataFrame:
    """One row: status (stale if anything differs or failed) and the number of paths of each kind."""
    n = {k: F.count_if(F.col("status") == k).alias(k) for k in ("unchanged", "changed", "new", "deleted", "error")}
    return differences.agg(*n.values()).withColumn("freshness", F.when(F.col("changed") + F.col("new") + F.col("deleted") + F.col("error") > 0, "stale").otherwise("current"))


def listed(differences: DataFrame) -> DataFrame:
    """One row with sorted path lists; for reports on source trees, whose paths fit a row."""
    of = lambda k: F.sort_array(F.collect_list(F.when(F.col("status") == k, F.col("path")))).alias(k)
    return differences.agg(*[of(k) for k in ("unchanged", "changed", "new", "deleted", "error")]).withColumn("freshness", F.when(F.size("changed") + F.size("new") + F.size("deleted") + F.size("error") > 0, "stale").otherwise("current"))


def snapshot(files: DataFrame, paths: list[str] | None = None) -> DataFrame:
    """One row: map path -> hash; an empty restriction means all files."""
    rows = files.filter(F.col("path").isin(paths)) if paths else files
    return rows.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("path", "hash")))).alias("file_hashes"))


def validate(expected: DataFrame, current: DataFrame) -> DataFrame:
    """path, status of expected (path, hash) against current: valid, changed, missing."""
    rows = expected.select("path", F.col("hash").alias("expected")).join(current.select("path", F.col("hash").alias("found"), F.lit(True).alias("there")), "path", "left")
    return rows.select("path", F.when(F.col("there").isNull(), "missing").when(F.col("expected") == F.col("found"), "valid").otherwise("changed").alias("status"))


def unchanged(current: DataFrame, indexed: DataFrame) -> DataFrame:
    return current.join(indexed.select("path", "hash"), ["path", "hash"], "left_semi")


def to_parse(current: DataFrame, indexed: DataFrame) -> DataFrame:
    """Rows whose (path, hash) is not indexed: only these are parsed again."""
    return current.join(indexed.select("path", "hash"), ["path", "hash"], "left_anti")


def merge_files(indexed: DataFrame, current: DataFrame) -> DataFrame:
    """The table after a refresh: unchanged rows stay as they are, changed and new ones come from ``current``, deleted ones go."""
    kept = indexed.join(current.select("path", "hash"), ["path", "hash"], "left_semi")
    return kept.select(*indexed.columns).unionByName(to_parse(current, indexed).select(*indexed.columns))


def upsert_file(files: DataFrame, new: DataFrame) -> DataFrame:
    """Insert or replace by path; an equal hash changes nothing."""
    fresh = to_parse(new, files)
    return files.join(fresh.select("path"), "path", "left_anti").select(*files.columns).unionByName(fresh.select(*files.columns))


def delete_files(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Cascade over dependent tables. gone: (file_id)."""
    ids = gone.select("file_id").distinct()
    out = dict(tables)
    symbols = tables["symbols"].join(ids, "file_id", "left_semi").select("symbol_id")
    for name in ("files", "symbols", "imports"):
        if name in tables:
            out[name] = tables[name].join(ids, "file_id", "left_anti")
    keys = {"calls": ("caller_id", "callee_id"), "inherits": ("child_id",), "type_info": ("symbol_id",), "embeddings": ("symbol_id",)}
    for name, columns in keys.items():
        if name in tables:
            out[name] = reduce(lambda d, c: d.join(symbols.select(F.col("symbol_id").alias(c)), c, "left_anti"), columns, tables[name])
    return out


def index_stats(symbols: DataFrame, files: DataFrame, imports: DataFrame, calls: DataFrame, resolved: int, unresolved: int) -> DataFrame:
    """One row of counts and the share of calls that were resolved (1.0 without calls)."""
    total = resolved + unresolved
    kinds = symbols.agg(F.count(F.lit(1)).alias("symbols"), F.count_if(F.col("type") == "class").alias("classes"), F.count_if(F.col("type").isin("function", "method")).alias("functions"))
    one = lambda d, n: F.broadcast(d.agg(F.count(F.lit(1)).alias(n)))  # one row each
    return kinds.crossJoin(one(files, "files")).crossJoin(one(imports, "imports")).crossJoin(one(calls, "calls")).withColumn("resolution_rate", F.lit(resolved / total if total else 1.0))
