"""Vector search: exact L2 nearest neighbours with built-in array functions; a top-k never sorts the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x))


def similarity(distance: Column) -> Column:
    return 1.0 / (1.0 + distance)


def knn(embeddings: DataFrame, query: list[float], k: int, key: str = "id", vector: str = "embedding") -> DataFrame:
    """The k nearest of (key, vector): key, distance; ties to the smaller key (TakeOrderedAndProject)."""
    asked = F.array(*[F.lit(float(x)) for x in query])
    return embeddings.select(key, l2_distance(F.col(vector), asked).alias("distance")).orderBy(F.round("distance", 9), key).limit(k)


def upsert(embeddings: DataFrame, new: DataFrame, key: str = "symbol_id") -> DataFrame:
    """``new`` (with ``ord`` for repeated keys: the last wins) replaces rows of the same key."""
    last = new.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("ord")))).filter("_r = 1").drop("_r", "ord")
    return embeddings.join(last.select(key), key, "left_anti").unionByName(last)


def drop_stale(embeddings: DataFrame, symbols: DataFrame) -> DataFrame:
    """Embeddings of symbols that are gone go too."""
    return embeddings.join(symbols.select("symbol_id"), "symbol_id", "left_semi")
