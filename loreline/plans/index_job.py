"""The index job: scan, diff, parse what changed, resolve what that concerns, rewrite the buckets it touches, commit a version.

One function (``changes_of``) serves the first build and every refresh: it derives the short names whose symbols differ, finds the files that mention one
of them, resolves only their rows that do, and carries all others over. Written are the buckets of changed files, of files with rows resolved
again, and of graph nodes whose edges moved. If another job commits first, the work is done again on what that job left.
"""

from __future__ import annotations

import time
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreline.errors import CommitConflict
from loreline.functions.text import content_hash
from loreline.operators import bm25, delta, flow, freshness, graph, resolve, retrieval, types, vector
from loreline.options import IndexOptions, IndexResult
from loreline.sources import files as sources
from loreline.sources import python_source as py
from loreline.sources.shared import Scratch
from loreline.sources.store import BUCKETS, Commit, IndexSnapshot, IndexStore, bucket_of

BUCKET_BYTES = 256 << 20  # source text of a bucket; a first build chooses their number
ATTEMPTS = 10
RACY_S = 2  # a file that changed so shortly before it was listed is read again
READ_BY_NAME = 10_000  # changed files up to which they are read by name
SHOWN = 1000


def _numbers(rows: DataFrame) -> set[int]:
    """The different bucket numbers of some rows (as many as there are buckets at most)."""
    return {r[0] for r in rows.select("bucket").distinct().collect()}


def changes_of(base: IndexSnapshot, changed: DataFrame, touched: DataFrame, keep: Scratch, embeddings: DataFrame | None = None) -> tuple[dict, DataFrame]:
    """(table -> (rows, buckets that they replace), parsed rows of the changed files).

    ``changed``: (path, content, size_bytes) of new and changed files; ``touched``: paths of those and of deleted ones. ``embeddings``
    (symbol_id, embedding, ord) are written over carried ones.
    """
    n, first = base.commit.buckets, not base.commit.tables
    at = lambda c: bucket_of(F.col(c), n).alias("bucket")
    touched = keep(touched.select("path", at("path")))
    near = _numbers(touched)
    fresh = keep(py.parse_files(changed))
    spread = None if first else near

    def old(table: str, buckets: set[int] | None, key: str | None = "path") -> DataFrame:
        """Rows of some buckets, without those of touched files."""
        rows = base.read_with_bucket(table, buckets)
        return rows if key is None else rows.join(touched.select(F.col("path").alias(key)), key, "left_anti")

    symbols = keep(py.symbols_of(fresh))
    calls, bases, imports = py.calls_of(fresh), py.bases_of(fresh), py.imports_of(fresh)
    # the short names whose symbols differ, and the files with rows that mention one
    before = keep(base.read("names", near).join(touched.select("path"), "path", "left_semi"))
    after = delta.names_of(symbols)
    differ = keep(delta.changed_rows(before, after))
    changed_names = keep(differ.select("name").distinct())
    wide = near if first else near | _numbers(base.read_with_bucket("mentions").join(changed_names, "name", "left_semi"))
    # stale rows and those of changed files are resolved, against the symbols that have one of the names that they mention
    raw = {"resolved": calls.select(*delta.CALL), "resolved_imports": imports.select(*delta.IMPORT), "resolved_bases": bases.select(*delta.BASE)}
    enclosing = F.regexp_replace("qualified_name", r"\.[^.]+$", "")
    classes = differ.filter("type = 'class'").select(F.col("qname").alias("parent_qname")).distinct()
    if first:
        todo, todo_symbols, names = raw, symbols.withColumn("bucket", at("file_path")), after
    else:
        held = {t: old(t, wide) for t in raw}
        todo = {t: keep(delta.stale(t, held[t], changed_names).select(*raw[t].columns).unionByName(raw[t])) for t in raw}
        moved_class = base.read_with_bucket("symbols").withColumn("parent_qname", enclosing).join(classes, "parent_qname", "left_semi").drop("parent_qname", "parent_class_id")
        moved_class = moved_class.join(touched.select(F.col("path").alias("file_path")), "file_path", "left_anti")
        todo_symbols = keep(moved_class.unionByName(symbols.withColumn("bucket", at("file_path")).select(*moved_class.columns)))
        wanted = delta.mentions(todo["resolved"], todo["resolved_bases"], todo["resolved_imports"], todo_symbols).select("name").distinct()
        names = keep(old("names", None).drop("bucket").unionByName(after).join(wanted, "name", "left_semi"))
    run = {"resolved": lambda rows: delta.resolve_calls(rows, names), "resolved_imports": lambda rows: delta.resolve_imports(rows, names), "resolved_bases": lambda rows: delta.resolve_bases(rows, now["resolved_imports"], names)}
    now, again, dropped = {}, {}, {}
    for table in run:  # base classes look at the imports of their file
        again[table] = keep(run[table](todo[table]).withColumn("bucket", at("path")))
        now[table] = again[table] if first else keep(delta.carried(table, held[table], changed_names).unionByName(again[table]))
        if not first:
            gone = base.read(table, near).join(touched.select("path"), "path", "left_semi")
            dropped[table] = gone.unionByName(delta.stale(table, held[table], changed_names).drop("bucket"))
    out = {t: (rows, None if first else wide) for t, rows in now.items()}
    out["calls"] = (resolve.stored_of(now["resolved"], "bucket"), None if first else wide)
    out["inherits"] = (now["resolved_bases"].filter("child_id is not null").select("child_id", "parent_id", F.col("parent").alias("parent_name"), "bucket"), None if first else wide)
    # edges of the source nodes whose rows came, went or were resolved again
    if first:
        out["edges"] = (graph.digraph(delta.edges_of(now["resolved"], now["resolved_bases"], now["resolved_imports"])).withColumn("bucket", at("src")), None)
    else:
        edges = lambda t: delta.edges_of(t["resolved"], t["resolved_bases"], t["resolved_imports"])
        moved = keep(edges(dropped).select("src").union(edges(again).select("src")).distinct().withColumn("bucket", at("src")))
        ends = _numbers(moved)
        others = set(range(n)) - wide
        whole = {t: base.read(t, others).unionByName(now[t].drop("bucket")) for t in now}
        mine = graph.digraph(edges(whole).join(moved.select("src"), "src", "left_semi")).withColumn("bucket", at("src"))
        rest = base.read_with_bucket("edges", ends).join(moved.select("src"), "src", "left_anti")
        out["edges"] = (rest.unionByName(mine.select(*rest.columns)), ends)
    # symbols of changed files, and those of other files whose class has another id
    also = near if first else near | _numbers(todo_symbols)
    found = py.with_parents(todo_symbols, names)
    if first:
        all_symbols = keep(found)
    else:
        kept = old("symbols", also, "file_path").join(todo_symbols.select("symbol_id"), "symbol_id", "left_anti")
        all_symbols = keep(kept.unionByName(found.select(*kept.columns)))
    out["symbols"] = (all_symbols, None if first else also)
    # tables of a file's own rows
    file = lambda rows, key="path": rows.withColumn("bucket", at(key))
    gone_ids = before.select("symbol_id")
    mine = {"parsed": file(fresh), "names": file(after), "imports": file(imports), "errors": file(fresh.filter("error is not null").select("path", "error")),
            "mentions": file(delta.mentions(calls, bases, imports, symbols)),
            "files": file(fresh.select(F.xxhash64("path").alias("file_id"), "path", "hash", F.lit("python").alias("language"), "line_count", "size_bytes")),
            "nodes": file(symbols.select("qualified_name", "type", "file_path", (F.col("end_line") - F.col("start_line") + 1).alias("line_count")), "file_path")}
    for table, rows in mine.items():
        out[table] = (old(table, near, "file_path" if table == "nodes" else "path").unionByName(rows, allowMissingColumns=True), spread)
    of_symbols = symbols.select("symbol_id", at("file_path"))
    typed = types.type_info(symbols, changed).join(of_symbols, "symbol_id")
    out["type_info"] = (base.read_with_bucket("type_info", near).join(gone_ids, "symbol_id", "left_anti").unionByName(typed), spread)
    # the inverted index
    lexical = bm25.build_index(symbols.select("symbol_id", retrieval.index_text().alias("text")), "symbol_id")
    posted = keep(base.read_with_bucket("bm25_postings", near).join(gone_ids.withColumnRenamed("symbol_id", "doc_id"), "doc_id", "left_anti")
                  .unionByName(lexical.postings.join(of_symbols.withColumnRenamed("symbol_id", "doc_id"), "doc_id").select("token", "doc_id", "tf", "size", "bucket")))
    in_near = all_symbols if first else all_symbols.filter(F.col("bucket").isin(*near) if near else F.lit(False))
    sizes = bm25.sizes(in_near.select("symbol_id", retrieval.index_text().alias("text"), "bucket").withColumnRenamed("symbol_id", "doc_id"), "doc_id", carry=("bucket",))
    out["bm25_postings"] = (posted, spread)
    out["bm25_terms"] = (posted.groupBy("bucket", "token").agg(F.count(F.lit(1)).alias("df")), spread)
    out["bm25_stats"] = (sizes.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")), spread)
    # embeddings of changed files go, as their text may have changed; given ones are written over the rest
    carried = base.read_with_bucket("embeddings", None if embeddings is not None else near).join(gone_ids, "symbol_id", "left_anti")
    if embeddings is not None:
        new = embeddings.select("symbol_id", "embedding", *(["ord"] if "ord" in embeddings.columns else [F.lit(0).alias("ord")]))
        put = vector.upsert(carried.select("symbol_id", "embedding"), new)
        place = old("names", None).drop("bucket").unionByName(after).select("symbol_id", at("path"))
        out["embeddings"] = (put.join(place, "symbol_id", "left").withColumn("bucket", F.coalesce("bucket", F.pmod("symbol_id", F.lit(n)).cast("int"))), None)
    elif not first:
        out["embeddings"] = (carried, spread)
    return out, fresh


def _stats(snapshot: IndexSnapshot, parsed: int) -> dict[str, int]:
    one = lambda table, *more: snapshot.read(table).agg(F.count(F.lit(1)), *more)  # one row
    names = one("names", F.count_if(F.col("type") == "class").alias("classes"))
    calls = one("resolved", F.count_if(resolve.is_known()).alias("known"), F.count_if(F.col("callee").isNotNull() & ~resolve.is_known()).alias("open"))
    row = one("files").crossJoin(F.broadcast(one("errors"))).crossJoin(F.broadcast(names)).crossJoin(F.broadcast(one("imports"))).crossJoin(F.broadcast(calls)).first()
    files, errors, symbols, classes, imports, called, resolved, missed = row
    return {"files": files, "parsed": parsed, "parse_errors": errors, "symbols": symbols, "classes": classes, "functions": symbols - classes, "imports": imports, "calls": called, "resolved_calls": resolved, "unresolved_calls": missed}


def _result(snapshot: IndexSnapshot, began: float) -> IndexResult:
    s = snapshot.commit.stats
    shown = snapshot.read("errors").select(F.concat_ws(": ", "path", "error")).orderBy("path").limit(SHOWN).collect() if s.get("parse_errors") else []  # the table holds all
    return IndexResult(snapshot.version, s.get("files", 0), s.get("parse_errors", 0), *[s.get(k, 0) for k in ("symbols", "classes", "functions", "imports", "calls", "resolved_calls", "unresolved_calls")], time.time() - began, [r[0] for r in shown])


def apply(store: IndexStore, base: IndexSnapshot, changed: DataFrame, touched: DataFrame, keep: Scratch, embeddings: DataFrame | None = None, listing: DataFrame | None = None) -> int:
    """Commit the version after ``base`` in which these files stand as given, and touched ones without content are gone.

    ``listing`` (path, size_bytes, modified, listed) tells later refreshes what need not be read again; without it touched files will be.
    """
    changes, fresh = changes_of(base, changed, touched, keep, embeddings)
    near = changes["files"][1]
    left = base.read_with_bucket("listing", near).join(touched.select("path"), "path", "left_anti")
    if listing is not None:
        own = listing.join(changed.select("path"), "path", "left_semi").withColumn("bucket", bucket_of(F.col("path"), base.commit.buckets))
        left = left.unionByName(own.select(*left.columns))
    changes["listing"] = (left, near)
    return store.commit(base, changes, lambda made: _stats(made, fresh.count()))


def _nothing(store: IndexStore, scanned: DataFrame) -> IndexSnapshot:
    """An empty version to build on: as many buckets as the text needs, never fewer than BUCKETS."""
    size = scanned.agg(F.coalesce(F.sum("size_bytes"), F.lit(0))).first()[0]
    return IndexSnapshot(store, Commit(version=store.version(), buckets=max(BUCKETS, -(-size // BUCKET_BYTES))))


def _suspects(listing: DataFrame, held: DataFrame) -> DataFrame:
    """Listed files that may differ from what the index holds: new ones, those of another size or time, and those whose time was so near that of
    their listing that they may have changed again within it."""
    same = held.filter(F.col("modified") < F.col("listed") - F.expr(f"INTERVAL {RACY_S} SECONDS")).select("path", "size_bytes", "modified")
    return listing.join(same, ["path", "size_bytes", "modified"], "left_anti")


def _current(spark: SparkSession, root: str, options: IndexOptions, base: IndexSnapshot, listing: DataFrame, keep: Scratch) -> tuple[DataFrame, DataFrame]:
    """(files that are read: path, content, size_bytes; paths that the index holds and the tree does not). Content is read only where size or time differ."""
    if not base.commit.tables.get("listing"):
        return sources.scan_tree(spark, root, options), base.read("files").select("path").join(listing.select("path"), "path", "left_anti")
    gone = base.read("files").select("path").join(listing.select("path"), "path", "left_anti")
    suspects = _suspects(listing, base.read("listing"))
    if options.settle_s:
        suspects = suspects.filter(F.col("modified") < F.current_timestamp() - F.expr(f"INTERVAL {options.settle_s} SECONDS"))
    paths = [r[0] for r in suspects.select("path").limit(READ_BY_NAME + 1).collect()]
    if len(paths) > READ_BY_NAME:  # most of the tree: one scan
        return sources.scan_tree(spark, root, options).join(suspects.select("path"), "path", "left_semi"), gone
    return sources.read_files(spark, root, paths).withColumn("size_bytes", F.length("content").cast("long")), gone


def index_directory(spark: SparkSession, root: str, store_root: str, options: IndexOptions = IndexOptions(), embeddings: DataFrame | None = None) -> IndexResult:
    """Index a source tree into a new version. Incremental: only files whose size or time differ are read, only new and changed ones parsed, and nothing
    is written if there are none. ``skipped`` counts files that parse in part or not at all.
    """
    began, store = time.time(), IndexStore(spark, store_root)
    for attempt in range(ATTEMPTS):
        with Scratch() as keep:
            listing = keep(sources.list_tree(spark, root, options).withColumn("listed", F.current_timestamp()))
            base = store.at() if options.incremental and store.version() else _nothing(store, listing)
            read, gone = _current(spark, root, options, base, listing, keep)
            files = base.read("files").select("path", "hash")
            changed = keep(freshness.to_parse(read.withColumn("hash", content_hash(F.col("content"))), files).drop("hash"))
            touched = keep(changed.select("path").union(gone))
            if base.commit.tables and embeddings is None and touched.isEmpty():
                return _result(base, began)
            try:
                return _result(store.at(apply(store, base, changed, touched, keep, embeddings, listing)), began)
            except CommitConflict:
                if attempt + 1 == ATTEMPTS:
                    raise


def delete_paths(spark: SparkSession, store_root: str, paths: DataFrame) -> int:
    """A version without these files (path): their rows go from every table, and what referred to them is resolved again."""
    store = IndexStore(spark, store_root)
    with Scratch() as keep:
        return apply(store, store.at(), spark.createDataFrame([], "path string, content binary, size_bytes long"), paths.select("path").distinct(), keep)


def add_flow_types(spark: SparkSession, store_root: str) -> int:
    """A version whose type_info has what flows across files: for functions that no surer strategy tells, and for parameters.

    A fixpoint over the facts of the whole index; refreshes carry its rows over until it is run again.
    """
    store = IndexStore(spark, store_root)
    base = store.at()
    with Scratch() as keep:
        flows = keep(py.flows_of(base.read("parsed")))
        known = keep(flow.flow_types(flows, base.read("names"), base.read("resolved_bases")))
        rows = flow.type_rows(base.read("symbols"), flows, known)
        held = base.read("type_info").filter(F.col("inference_strategy") != flow.STRATEGY)
        surer = held.filter((F.col("confidence") >= flow.CONFIDENCE) & F.col("parameter_name").isNull()).select("symbol_id", F.lit("").alias("_p")).distinct()
        new = keep(rows.withColumn("_p", F.coalesce("parameter_name", F.lit(""))).join(surer, ["symbol_id", "_p"], "left_anti").drop("_p"))
        beaten = new.filter("parameter_name is null").select("symbol_id")
        left = held.join(beaten, "symbol_id", "left_anti")
        place = base.read("names").select("symbol_id", bucket_of(F.col("path"), base.commit.buckets).alias("bucket"))
        return store.commit(base, {"type_info": (left.unionByName(new).join(place, "symbol_id"), None)}, lambda _: base.commit.stats)


def check_freshness(spark: SparkSession, root: str, store_root: str, options: IndexOptions = IndexOptions()) -> DataFrame:
    """One row: freshness and path lists."""
    return freshness.listed(freshness.diff(IndexStore(spark, store_root).read("files"), sources.file_table(sources.scan_tree(spark, root, options))))


def refresh_if_stale(spark: SparkSession, root: str, store_root: str, options: IndexOptions = IndexOptions()) -> IndexResult | None:
    """None if nothing changed, else the result of an incremental index."""
    before = IndexStore(spark, store_root).version()
    done = index_directory(spark, root, store_root, replace(options, incremental=True))
    return None if before and done.version == before else done
