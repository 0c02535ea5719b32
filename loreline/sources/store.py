"""Versioned index on Parquet with an atomic commit log and partial rewrites.

Layout: ``<root>/log/<version>.json`` commits a version; ``<root>/v=<version>/<table>/<writer>/bucket=<k>/`` holds data. Every table is dealt
to hash buckets (by path, edges by source node), and a commit names for each table the folder of every bucket. A version that changes few buckets
writes those and names the old folders of all others.

A commit file is created only if no other has that name (a hard link on a local disk, else a rename that fails on an existing file, as
HDFS does it). Of two jobs that start from one version the second to commit gets ``CommitConflict`` and starts again from the version that the
first one left; their files never mix, as each writes to a folder of its own. A job that dies leaves files that no commit names; ``vacuum`` removes
them. Readers hold one version (``IndexSnapshot``) for as long as they need it.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loreline.errors import CommitConflict, GraphChecksumError, IndexNotFound
from loreline.operators.bm25 import Bm25Index
from loreline.schemas import TABLES

BUCKETS = 16
WRITERS = 4  # tables that are written at a time
# rows are sorted by the lookup column inside a bucket, for pruning
ORDER = {"files": "path", "parsed": "path", "symbols": "qualified_name", "names": "name", "edges": "src", "nodes": "qualified_name", "imports": "path", "mentions": "name", "bm25_postings": "token", "bm25_terms": "token"}


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


@dataclass
class Commit:
    """What a version consists of: for each table the folder of every bucket that has rows."""

    version: int = 0
    buckets: int = BUCKETS
    stats: dict[str, int] = field(default_factory=dict)
    checksum: str = ""
    tables: dict[str, dict[str, str]] = field(default_factory=dict)


class IndexSnapshot:
    """One version, read once: all its tables belong together whatever is committed meanwhile."""

    def __init__(self, store: IndexStore, commit: Commit):
        self.store, self.spark, self.commit = store, store.spark, commit

    @property
    def version(self) -> int:
        return self.commit.version

    def read(self, table: str, buckets: set[int] | None = None) -> DataFrame:
        """A table, or some of its buckets; a table that the version does not hold is empty."""
        held = self.commit.tables.get(table, {})
        folders = [f"{self.store.root}/{path}" for k, path in sorted(held.items()) if buckets is None or int(k) in buckets]
        if not folders:
            return self.spark.createDataFrame([], TABLES[table])
        return self.spark.read.schema(TABLES[table]).parquet(*folders)

    def read_with_bucket(self, table: str, buckets: set[int] | None = None) -> DataFrame:
        """``read``, with the number of the bucket that each row stands in."""
        rows = self.read(table, buckets)
        if not rows.inputFiles():
            return rows.withColumn("bucket", F.lit(None).cast("int"))
        return rows.select("*", F.regexp_extract("_metadata.file_path", r"/bucket=(\d+)/", 1).cast("int").alias("bucket"))

    def lexical(self) -> Bm25Index | None:
        """The stored inverted index; None in versions without one. Document frequencies and sizes are kept by bucket and summed here."""
        if not self.commit.tables.get("bm25_postings"):
            return None
        terms = self.read("bm25_terms").groupBy("token").agg(F.sum("df").alias("df"))
        total = self.read("bm25_stats").agg(F.sum("n").alias("n"), F.coalesce(F.sum("size") / F.sum("n"), F.lit(1.0)).alias("avgdl"))
        return Bm25Index(self.read("bm25_postings"), terms, total)

    def load_graph(self) -> tuple[DataFrame, DataFrame]:
        """(nodes, edges) after a checksum test."""
        edges = self.read("edges")
        try:
            if any(n.endswith(".parquet") for n in self.store._names(f"v={self.version}", "edges")):
                raise GraphChecksumError(f"the edges of version {self.version} hold files that no job of the index wrote")
            found = graph_checksum(edges)
        except AnalysisException as e:  # a folder that the commit names is gone
            raise GraphChecksumError(str(e)) from e
        if self.version and found != self.commit.checksum:
            raise GraphChecksumError(f"edges of version {self.version} do not match the commit")
        return self.read("nodes"), edges


class IndexStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    # files
    def _path(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def _fs(self):
        return self._path("log").getFileSystem(self._conf)

    def _names(self, *parts: str) -> list[str]:
        fs, at = self._fs(), self._path(*parts)
        return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []

    def _text(self, *parts: str) -> str:
        stream = self._fs().open(self._path(*parts))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _create(self, text: str, *parts: str) -> bool:
        """Create a file with this text, whole or not at all; False if there is one of that name."""
        fs, target = self._fs(), self._path(*parts)
        temporary = self._path(*parts[:-1], f".{uuid.uuid4().hex}")
        stream = fs.create(temporary, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        local = fs.makeQualified(target).toUri()
        try:
            if local.getScheme() == "file":
                os.link(fs.makeQualified(temporary).toUri().getPath(), local.getPath())
            else:
                none = self.spark.sparkContext._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
                self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self._conf).rename(temporary, target, none)
            return True
        except FileExistsError:
            return False
        except Exception as e:
            if "FileAlreadyExistsException" in str(e):
                return False
            raise
        finally:
            fs.delete(temporary, False)

    # versions
    def versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self._names("log") if n.removesuffix(".json").isdigit())

    def version(self) -> int:
        """The latest committed version; 0 before the first."""
        return max(self.versions(), default=0)

    def at(self, version: int | None = None) -> IndexSnapshot:
        """A version (the latest one unless named); an empty one before the first."""
        v = self.version() if version is None else version
        return IndexSnapshot(self, Commit(**json.loads(self._text("log", f"{v:012d}.json"))) if v else Commit())

    def stats(self) -> dict[str, int]:
        return self.at().commit.stats

    def get_stat(self, key: str, default: int = 0) -> int:
        return self.stats().get(key, default)

    def read(self, table: str, version: int | None = None) -> DataFrame:
        snapshot = self.at(version)
        if not snapshot.version:
            raise IndexNotFound(self.root)
        return snapshot.read(table)

    def lexical(self) -> Bm25Index | None:
        return self.at().lexical()

    def load_graph(self) -> tuple[DataFrame, DataFrame]:
        """(nodes, edges) after a checksum test; without an index an empty graph."""
        return self.at().load_graph()

    def commit(self, base: IndexSnapshot, changes: dict[str, tuple[DataFrame, set[int] | None]], stats: Callable[[IndexSnapshot], dict[str, int]]) -> int:
        """Commit ``base`` with some buckets replaced (None: all of a table), as the version after it.

        ``changes``: table -> (rows with a column ``bucket``, the buckets that these rows replace). ``stats`` are counted on what was written. Raises
        CommitConflict if another job has committed that version; nothing of this one is visible then, and its files are removed.
        """
        v, writer = base.version + 1, uuid.uuid4().hex[:12]
        tables = {t: dict(b) for t, b in base.commit.tables.items()}

        def write(name: str) -> None:
            rows, touched = changes[name]
            out = f"v={v}/{name}/{writer}"
            dealt = rows.repartition("bucket")
            dealt = dealt.sortWithinPartitions("bucket", ORDER[name]) if name in ORDER else dealt
            dealt.select(*[F.col(f.name).cast(f.dataType) for f in TABLES[name]], "bucket").write.partitionBy("bucket").parquet(f"{self.root}/{out}")
            written = {n.split("=")[1]: f"{out}/{n}" for n in self._names(out) if n.startswith("bucket=")}
            tables[name] = {k: p for k, p in tables.get(name, {}).items() if touched is not None and int(k) not in touched} | written

        with ThreadPoolExecutor(WRITERS) as pool:  # small tables are written beside large ones
            list(pool.map(write, [t for t, (_, touched) in changes.items() if touched is None or touched]))
        now = Commit(v, base.commit.buckets, {}, base.commit.checksum, tables)
        made = IndexSnapshot(self, now)
        now.stats = {k: int(x) for k, x in stats(made).items()}
        if "edges" in changes:
            now.checksum = graph_checksum(made.read("edges"))
        if not self._create(json.dumps(now.__dict__), "log", f"{v:012d}.json"):
            for name in changes:
                self._fs().delete(self._path(f"v={v}", name, writer), True)
            raise CommitConflict(f"version {v} of {self.root} was committed by another job")
        return v

    def delete_all(self, table: str) -> int:
        """A version in which a table has no rows."""
        base = self.at()
        nothing = self.spark.createDataFrame([], TABLES[table]).withColumn("bucket", F.lit(0))
        return self.commit(base, {table: (nothing, None)}, lambda _: base.commit.stats)

    def vacuum(self, keep: int = 2) -> int:
        """Remove all but the latest ``keep`` versions and every folder that none of these names: the number of folders removed.

        No job may be writing meanwhile.
        """
        held = [self.at(v).commit for v in self.versions()[-keep:]]
        named = {p for c in held for b in c.tables.values() for p in b.values()}
        fs, gone = self._fs(), 0
        for old in self.versions()[:-keep]:
            fs.delete(self._path("log", f"{old:012d}.json"), False)
        for v in [n for n in self._names() if n.startswith("v=")]:
            for table in self._names(v):
                for writer in self._names(v, table):
                    for bucket in self._names(v, table, writer):
                        if f"{v}/{table}/{writer}/{bucket}" not in named:
                            fs.delete(self._path(v, table, writer, bucket), True)
                            gone += bucket.startswith("bucket=")
        return gone

    def clear(self) -> None:
        self._fs().delete(self._path(), True)

    # point lookups
    def file(self, path: str) -> DataFrame:
        return self.read("files").filter(F.col("path") == path)

    def files_by_suffix(self, suffix: str) -> DataFrame:
        """Literal, case folded."""
        return self.read("files").filter(F.endswith(F.lower("path"), F.lit(suffix.lower())))

    def symbol(self, qualified_name: str) -> DataFrame:
        """The symbol of that name with its path; the first by id among several."""
        now = self.at()
        return now.read("symbols").filter(F.col("qualified_name") == qualified_name).join(now.read("files").select("file_id", "path"), "file_id").orderBy("symbol_id").limit(1)

    def symbols(self) -> DataFrame:
        now = self.at()
        return now.read("symbols").join(now.read("files").select("file_id", "path"), "file_id")

    def symbols_of_file(self, file_id: int) -> DataFrame:
        return self.read("symbols").filter(F.col("file_id") == file_id).select("qualified_name")

    def imports_of(self, path: str) -> DataFrame:
        now = self.at()
        files = now.read("files").filter((F.col("path") == path) | F.endswith(F.lower("path"), F.lit(path.lower()))).select("file_id")
        return now.read("imports").join(files, "file_id", "left_semi")


def graph_checksum(edges: DataFrame) -> str:
    """Order-free checksum of an edge table: count and sum of row hashes."""
    row = edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("src", "dst", "relation_type", "line_number").cast("decimal(38,0)")), F.lit(0))).first()
    return json.dumps([int(row[0]), str(row[1])])
