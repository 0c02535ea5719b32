"""Readers: source trees, benchmark cases, trace files, changed-file lists, snippets."""

from __future__ import annotations

import fnmatch
import re
import subprocess

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loreline.functions.text import content_hash, line_count
from loreline.options import IndexOptions
from loreline.schemas import CASES
from loreline.sources.shared import checkpoint


def _glob_regex(pattern: str) -> str:
    return re.sub(r"\\z$|\\Z$", "$", fnmatch.translate(pattern.replace("**/", "*"))).replace("(?s:", "(?s:")


def _literal(path: str) -> str:
    """A path that is no pattern to Spark or Hadoop."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", path)


# Spark's file sources pass over names that begin with an underscore, which would lose every __init__.py: those are listed and read apart.


def underscored(spark: SparkSession, base: str) -> list[tuple[str, int, int]]:
    """(URI, length, time of change in ms) of .py files that, or a folder of which below ``base``, begin with an underscore: one listing call a pattern and level. Names
    that begin with a dot are passed over, as Spark does it.
    """
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(base)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def found(pattern: str) -> list[tuple[str, int, int]]:
        return [(s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in fs.globStatus(jvm.org.apache.hadoop.fs.Path(pattern)) or ()]

    root = _literal(base)
    out: set[tuple[str, int, int]] = set()
    level = 0
    while not level or found(f"{root}{'/[!.]*' * level}/"):
        for at in range(level + 1):
            parts = ["[!.]*"] * level + ["*.py"]
            parts[at] = "_*.py" if at == level else "_*"
            out.update(found("/".join([root, *parts])))
        level += 1
    return sorted(out)


def read_apart(spark: SparkSession, uris: list[str]) -> DataFrame:
    """path (URI), content, length of files by name: by executors where their store is a disk or one that Arrow reads, else through the driver's
    file system in batches that are written to the shared folder.
    """
    schema = "path string, content binary, length long"
    if not uris:
        return spark.createDataFrame([], schema)
    if all(re.match(r"(file:|/)", u) or re.match(r"(hdfs|s3|gs)://", u) for u in uris):
        def read(batches):
            import pyarrow as pa
            from pyarrow import fs

            for b in batches:
                for uri in b.column("path").to_pylist():  # a file at a time: memory follows the largest one
                    local = re.match(r"(?:file:)?/+(?=[^/])", uri)
                    store, path = (fs.LocalFileSystem(), "/" + uri[local.end():]) if local else fs.FileSystem.from_uri(uri)
                    with store.open_input_stream(path) as f:
                        data = f.read()
                    yield pa.record_batch({"path": pa.array([uri]), "content": pa.array([data], pa.binary()), "length": pa.array([len(data)], pa.int64())})

        n = max(1, min(len(uris) // 64, 4096))
        return spark.createDataFrame([(u,) for u in uris], "path string").repartition(n).mapInArrow(read, schema)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out, rows, size = None, [], 0
    for k, uri in enumerate(uris):
        path = jvm.org.apache.hadoop.fs.Path(uri)
        stream = path.getFileSystem(conf).open(path)
        data = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        stream.close()
        rows.append((uri, bytearray(data), len(data)))
        size += len(data)
        if size > 16 << 20 or k + 1 == len(uris):
            part = checkpoint(spark.createDataFrame(rows, schema))
            out, rows, size = part if out is None else out.unionByName(part), [], 0
    return out


def _below(base: str):
    """The path below ``base`` of a URI: what follows the root folder's own name."""
    tail = base.split("://")[-1].lstrip("/")
    return F.substring_index(F.col("path"), tail + "/", -1)


def scan_tree(spark: SparkSession, root: str, options: IndexOptions = IndexOptions()) -> DataFrame:
    """path (relative), content, size_bytes of every .py file that no ignore rule hits and that is not too large; sorted when written.

    Any store Spark reads will do. Size and path filters run before content is decoded.
    """
    base, most = root.rstrip("/"), int(options.max_file_size_mb * 1024 * 1024)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.py").option("recursiveFileLookup", "true").load(_literal(base)).select("path", "content", "length")
    apart = [u for u, *_ in _apart(spark, base, options)]
    rows = files.unionByName(read_apart(spark, apart)) if apart else files
    return rows.filter(F.col("length") <= most).select(_below(base).alias("path"), "content", F.col("length").alias("size_bytes")).filter(~ignored(F.col("path"), options))


def _apart(spark: SparkSession, base: str, options: IndexOptions) -> list[tuple[str, int, int]]:
    return [x for x in underscored(spark, base) if not set(x[0].split("/")[base.split("://")[-1].strip("/").count("/") + 1:]) & set(options.ignored_dirs)]


def list_tree(spark: SparkSession, root: str, options: IndexOptions = IndexOptions()) -> DataFrame:
    """path, size_bytes, modified of what ``scan_tree`` reads; no content is read."""
    base, most = root.rstrip("/"), int(options.max_file_size_mb * 1024 * 1024)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.py").option("recursiveFileLookup", "true").load(_literal(base)).select("path", "length", "modificationTime")
    if apart := _apart(spark, base, options):
        rows = spark.createDataFrame(apart, "path string, length long, ms long").select("path", "length", F.timestamp_millis("ms").alias("modificationTime"))
        files = files.unionByName(rows)
    return files.filter(F.col("length") <= most).select(_below(base).alias("path"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified")).filter(~ignored(F.col("path"), options))


def read_files(spark: SparkSession, root: str, paths: list[str]) -> DataFrame:
    """path, content of these files of a tree, those that exist; nothing else is listed or read."""
    base = root.rstrip("/")
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    there = [p for p in paths if p and (at := jvm.org.apache.hadoop.fs.Path(f"{base}/{p}")).getFileSystem(conf).exists(at)]
    apart = [p for p in there if any(x.startswith("_") for x in p.split("/"))]
    files = read_apart(spark, [f"{base}/{p}" for p in apart]).select("path", "content")
    if plain := [_literal(f"{base}/{p}") for p in there if p not in apart]:
        files = spark.read.format("binaryFile").load(plain).select("path", "content").unionByName(files)
    return files.select(_below(base).alias("path"), "content")


def ignored(path: Column, options: IndexOptions = IndexOptions()) -> Column:
    """Glob match, prefix of the bare pattern, or a folder that is never scanned."""
    parts = F.split(path, "/")
    hit = F.arrays_overlap(parts, F.array(*[F.lit(d) for d in options.ignored_dirs])) if options.ignored_dirs else F.lit(False)
    for p in options.ignore_patterns:
        hit = hit | path.rlike(_glob_regex(p))
        bare = p.rstrip("/*").rstrip("*")
        if bare and not set("*?[") & set(bare):
            hit = hit | path.startswith(bare)
    return hit


def file_table(scanned: DataFrame) -> DataFrame:
    """files rows of a scan."""
    text = F.decode("content", "UTF-8")
    return scanned.select("path", content_hash(F.col("content")).alias("hash"), F.lit("python").alias("language"), line_count(text).alias("line_count"), "size_bytes")


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Benchmark cases: a JSON list."""
    return spark.read.schema(CASES).option("multiLine", True).json(path)


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """Whole trace files: path, text, query (last line that is not blank)."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return rows.withColumn("query", F.try_element_at(lines, F.lit(-1)))


def changed_paths(porcelain: DataFrame, column: str = "text") -> DataFrame:
    """Distinct sorted .py paths of ``git status --porcelain`` text; a rename counts by its new name."""
    line = F.explode(F.split(F.col(column), "\n")).alias("line")
    name = F.trim(F.substring_index(F.substring("line", 4, 1 << 20), " -> ", -1))
    return porcelain.select(line).filter(F.length("line") > 3).select(F.regexp_replace(name, '^"|"$', "").alias("path")).filter(F.endswith("path", F.lit(".py"))).distinct().orderBy("path")


def changed_files_since(spark: SparkSession, root: str) -> DataFrame:
    """``changed_paths`` of a work tree (git runs on the driver; no work tree, or no git, gives no rows; TimeoutExpired after 60 seconds)."""
    try:
        said = subprocess.run(["git", "-C", root, "status", "--porcelain"], capture_output=True, text=True, timeout=60).stdout
    except OSError:
        said = ""
    return changed_paths(spark.createDataFrame([(said,)], "text string"))


def source_lines(content: Column, start: Column, end: Column, most: int = 80) -> Column:
    """Lines start .. end of a text, at most ``most`` of them."""
    n = F.greatest(F.lit(0), F.least(end - start + 1, F.lit(most)))
    return F.array_join(F.slice(F.split(content, "\n"), F.greatest(start, F.lit(1)), n), "\n")


def snippet(content: Column, line: Column, context: int = 5) -> Column:
    """Numbered lines around ``line``, which is marked with an arrow."""
    lines = F.split(content, "\n")
    first = F.greatest(F.lit(1), line - context)
    n = F.greatest(F.lit(0), F.least(F.size(lines), line + context) - first + 1)
    marked = F.transform(F.slice(lines, first, n), lambda x, i: F.concat(F.when(i + first == line, "=> ").otherwise("   "), (i + first).cast("string"), F.lit(": "), x))
    return F.array_join(marked, "\n")


def extract_symbols_source(symbols: DataFrame, sources: DataFrame, most: int = 80) -> DataFrame:
    """Symbols with their source text (null where the file is missing). sources: (path, content)."""
    return symbols.join(sources.select(F.col("path").alias("file_path"), "content"), "file_path", "left").withColumn("source", source_lines(F.col("content"), F.col("start_line"), F.col("end_line"), most)).drop("content")
