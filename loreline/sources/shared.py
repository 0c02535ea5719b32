"""Checkpoints as written tables in the folder that the session names in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ROWS = 1_000_000  # rows of one task in ``dealt``


def checkpoint_dir(spark: SparkSession) -> str:
    own = spark.conf.get("spark.checkpoint.dir", None)
    if own:
        return own
    at = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not at.isDefined():
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="loreline-"))
        at = spark.sparkContext._jsc.sc().getCheckpointDir()
    return at.get()


def checkpoint(df: DataFrame) -> DataFrame:
    """Write and reread: lineage ends there, and a lost executor costs nothing."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/loreline-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def shares(spark: SparkSession, rows: int, most: int = ROWS) -> int:
    """Partitions that keep what one task holds bounded (``most`` rows), whatever number of shuffle partitions is set."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // most))


def dealt(df: DataFrame, rows: int, *keys: str, most: int = ROWS) -> DataFrame:
    """Rows dealt by keys to ``shares``. What is then grouped by these keys is not shuffled again."""
    return df.repartition(shares(df.sparkSession, rows, most), *keys)


def bucketed(df: DataFrame, parts: int, key: str) -> DataFrame:
    """Write and reread as a table in buckets of a key: joins by it, round after round, do not shuffle these rows again."""
    name = f"loreline_{uuid.uuid4().hex}"
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{name}"
    df.write.bucketBy(parts, key).option("path", path).format("parquet").saveAsTable(name)
    out = df.sparkSession.table(name)
    out.written_to, out.known_as = path, name
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables that ``checkpoint`` wrote and that nothing reads any more."""
    for df in tables:
        context = df.sparkSession.sparkContext
        if hasattr(df, "known_as"):
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {df.known_as}")
        path = context._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """Checkpoints of one job, removed when it ends: ``with Scratch() as keep: rows = keep(rows)``."""

    def __init__(self):
        self.tables: list[DataFrame] = []

    def __call__(self, df: DataFrame) -> DataFrame:
        self.tables.append(checkpoint(df))
        return self.tables[-1]

    def buckets(self, df: DataFrame, parts: int, key: str) -> DataFrame:
        self.tables.append(bucketed(df, parts, key))
        return self.tables[-1]

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        discard(*self.tables)
