"""Exact top-k search by inner product: three-phase uniform threshold (TPUT; Cao and Wang, PODC 2004).

The score of a vector is the sum of its scores on ``LISTS`` slices of the components, one local list each. Local scores are lifted
by a bound per query and slice (Cauchy-Schwarz) so that none is negative.

1. Gather: every cell keeps, for each query and list, its k best local scores; merged, they give a lower bound t1 of the k-th total.
2. Cutoff: a vector with every local score below t1 / LISTS cannot reach t1. The cutoffs travel with the queries (one number each);
   cells send the vectors with a local score at the cutoff or above: their partial sums and which lists they cover. The k-th partial
   sum is a better bound t2; vectors that cannot reach it, their missing lists taken at the cutoff, go.
3. Resolve: the totals of what is left are worked out from the whole vectors, and the k highest are the answer.

Candidates are packed into chunks of about ``CHUNK_BYTES`` with vectors of one length, queries into blocks of ``QUERY_BLOCK`` at most,
both in place, without a shuffle. In a phase blocks and chunks meet in the cells of a grid, of about ``CELL_BYTES`` of either (the stated query
set against all rows, in blocks): a shuffle by cell, no product of tables; a cell works on one block at a time. Nothing but counts and bounds
of the whole table comes to the driver. Candidates are all rows, never sampled. Matrix products run in double precision where sums
stay below 2 ** 52, and in int64 beyond that; where a score could pass 2 ** 62, ``top_k`` raises.

Defined cases: vectors that are null, empty, or hold null or non-finite components take no part; null ids take no part; a vector is scored
against vectors of its own length only, as others have no inner product with it; rows with the query's own id are no candidates of it;
every other row is a candidate, so copies of a row and rows of a repeated id each take a rank; a repeated query id asks with each of its
rows, and its answer is the k best of all their pairs; ties go to the smaller id; fewer candidates than k give all; other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loreline.llm._frames import checkpoint, col, discard

LISTS = 4
QUERY_BLOCK = 1024
CHUNK_BYTES = 1 << 20  # of packed candidates
CELL_BYTES = 32 << 20  # of blocks, and of chunks, that meet in one cell of the grid
ROWS = 1024  # candidate rows scored at once


def _slices(dims: int) -> list[slice]:
    edge = np.linspace(0, dims, min(LISTS, dims) + 1).astype(int).tolist()
    return [slice(a, b) for a, b in zip(edge[:-1], edge[1:])]


def _longs(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.int64)


def _pack(most: int | None):
    """Rows (row, vec, d, x) of a batch as rows of bytes, one for each length and ``most`` vectors (default: CHUNK_BYTES of them)."""

    def run(batches):
        for b in batches:
            lengths = b.column("d").to_numpy()
            for d in np.unique(lengths):
                own = b.filter(pa.array(lengths == d))
                step = most or max(1, CHUNK_BYTES // (8 * int(d)))
                for at in range(0, own.num_rows, step):
                    part = own.slice(at, step)
                    rows = part.column("row").to_numpy()
                    x = np.ascontiguousarray(part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d).astype(np.int64))
                    norms = [float(np.sqrt((x[:, c].astype(float) ** 2).sum(axis=1)).max()) for c in _slices(int(d))]
                    yield pa.record_batch({"d": pa.array([int(d)], pa.int32()), "named": pa.array([rows if most else []], pa.list_(pa.int64())), "rows": pa.array([rows.tobytes()], pa.binary()), "vecs": pa.array([part.column("vec").to_numpy().tobytes()], pa.binary()), "x": pa.array([x.tobytes()], pa.binary()), "norms": pa.array([norms], pa.list_(pa.float64())), "top": pa.array([float(np.abs(x.astype(float)).max())], pa.float64())})

    return run


_LOCAL = (("query", pa.int64()), ("list", pa.int32()), ("row", pa.int64()), ("u", pa.int64()))
_PART = (("query", pa.int64()), ("row", pa.int64()), ("part", pa.int64()), ("most", pa.int64()))
_PACKED = "d int, named array<long>, rows binary, vecs binary, x binary, norms array<double>, top double"


class _Block:
    """A block of queries: rows, ids, matrix; ``lift`` makes local scores non-negative."""

    def __init__(self, row: dict):
        self.rows, self.ids = _longs(row["q_rows"]), _longs(row["q_vecs"])
        self.q = _longs(row["q_x"]).reshape(len(self.rows), -1)
        self.cut = _slices(self.q.shape[1])
        self.exact = float(row["top"]) ** 2 * self.q.shape[1] < 2.0**52
        self.lift = np.stack([np.ceil(np.sqrt((self.q[:, c].astype(float) ** 2).sum(axis=1)) * r) + 1 for c, r in zip(self.cut, row["reach"])]).astype(np.int64)

    def local(self, x: np.ndarray) -> np.ndarray:
        """(lists, queries, rows) lifted local scores."""
        kind = np.float64 if self.exact else np.int64
        return np.stack([(self.q[:, c].astype(kind) @ x[:, c].T.astype(kind)).astype(np.int64) + up[:, None] for c, up in zip(self.cut, self.lift)])


def _pieces(row: dict, dims: int):
    rows, vecs, x = _longs(row["rows"]), _longs(row["vecs"]), _longs(row["x"]).reshape(-1, dims)
    for at in range(0, len(rows), ROWS):
        yield rows[at:at + ROWS], vecs[at:at + ROWS], x[at:at + ROWS]


def _keep(best: np.ndarray, k: int, score: np.ndarray, *more: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """The k best of ``best`` and ``score`` along the last axis, with what goes along (pairs of old and new)."""
    every = np.concatenate([best, score], axis=-1)
    at = np.argpartition(-every, k - 1, axis=-1)[..., :k]
    return [np.take_along_axis(every, at, -1), *(np.take_along_axis(np.concatenate(m, axis=-1), at, -1) for m in more)]


def _gather(k: int):
    def run(blocks: pa.Table, chunks: pa.Table) -> pa.Table:
        """The k best local scores of each query and list among the candidates of a cell."""
        out = [pa.table({c: pa.array([], t) for c, t in _LOCAL})]
        for asked in blocks.to_pylist():
            block = _Block(asked)
            shape = (len(block.cut), len(block.rows), k)
            u, row = np.full(shape, -1, np.int64), np.zeros(shape, np.int64)
            for chunk in _each(chunks):
                for rows, ids, x in _pieces(chunk, block.q.shape[1]):
                    new = block.local(x)
                    new[:, block.ids[:, None] == ids[None, :]] = -1
                    u, row = _keep(u, k, new, (row, np.broadcast_to(rows, new.shape)))
            j, q, r = np.nonzero(u >= 0)
            out.append(pa.table({"query": pa.array(block.rows[q]), "list": pa.array(j.astype(np.int32)), "row": pa.array(row[j, q, r]), "u": pa.array(u[j, q, r])}))
        return pa.concat_tables(out)

    return run


def _send(k: int):
    def run(blocks: pa.Table, chunks: pa.Table) -> pa.Table:
        """What may reach the k-th total among the candidates of a cell."""
        out = [pa.table({c: pa.array([], t) for c, t in _PART})]
        for asked in blocks.to_pylist():
            block = _Block(asked)
            known = dict(zip(asked["asked"] or [], asked["t1"] or []))
            cut = np.array([-(-known.get(int(q), 0) // len(block.cut)) for q in block.rows], np.int64)
            floor = np.full((len(block.rows), k), -1, np.int64)  # the k best partial sums so far: a lower bound that only grows
            found = []
            for chunk in _each(chunks):
                for rows, ids, x in _pieces(chunk, block.q.shape[1]):
                    u = block.local(x)
                    over = (u >= cut[None, :, None]) & ~(block.ids[:, None] == ids[None, :])[None]
                    some = over.any(axis=0)
                    part = np.where(over, u, 0).sum(axis=0)
                    floor = _keep(floor, k, np.where(some, part, -1))[0]
                    most = part + (~over).sum(axis=0) * np.maximum(cut[:, None] - 1, 0)
                    q, r = np.nonzero(some & (most >= floor.min(axis=1)[:, None]))
                    found.append(np.stack([q, rows[r], part[q, r], most[q, r]]))
            q, row, part, most = np.concatenate(found, axis=1) if found else np.zeros((4, 0), np.int64)
            still = most >= floor.min(axis=1)[q]
            out.append(pa.table({"query": pa.array(block.rows[q[still]]), "row": pa.array(row[still]), "part": pa.array(part[still]), "most": pa.array(most[still])}))
        return pa.concat_tables(out)

    return run


def _each(chunks: pa.Table):
    for b in chunks.to_batches():
        for k in range(b.num_rows):
            yield {c: b.column(c)[k].as_py() for c in ("rows", "vecs", "x")}


class _Grid:
    """Blocks and chunks dealt to the cells of a grid: each cell holds about CELL_BYTES of either, and every pair of equal length meets in one cell."""

    def __init__(self, blocks: DataFrame, chunks: DataFrame):
        parts = lambda df, c: max(1, -(-int(df.agg(F.coalesce(F.sum(F.octet_length(c)), F.lit(0))).first()[0]) // CELL_BYTES))
        self.across, self.down = parts(blocks, "q_x"), parts(chunks, "x")
        self.chunks = chunks.select("d", "rows", "vecs", "x", F.pmod(F.xxhash64("rows"), F.lit(self.down)).alias("cg"), F.explode(F.sequence(F.lit(0), F.lit(self.across - 1))).alias("bg"))

    def meet(self, blocks: DataFrame, run, schema: str) -> DataFrame:
        dealt = blocks.withColumn("bg", F.pmod(F.xxhash64("block"), F.lit(self.across))).withColumn("cg", F.explode(F.sequence(F.lit(0), F.lit(self.down - 1))))
        cell = ("d", "bg", "cg")
        return dealt.groupBy(*cell).cogroup(self.chunks.groupBy(*cell)).applyInArrow(run, schema)


def top_k(vectors: DataFrame, queries, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """For each query its k highest integer inner products of floor(scale * component): query_id, rank, vec_id, score.

    ``queries`` is a boolean column that picks the query rows of ``vectors``.
    """
    v = F.transform(col(vector_col), lambda x: x.cast("double"))
    fit = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    named = vectors.filter(fit & col(id_col).isNotNull()).select(col(id_col).cast("long").alias("vec"), F.transform(v, lambda x: F.floor(x * F.lit(scale)).cast("long")).alias("x"), queries.alias("is_query"))
    # a row's number is written down once: it names the row in all phases
    rows = checkpoint(named.select(F.monotonically_increasing_id().alias("row"), "vec", F.size("x").alias("d"), "x", "is_query"))
    packed = lambda df, most: df.select("row", "vec", "d", "x").mapInArrow(_pack(most), _PACKED)
    chunks = checkpoint(packed(rows, None))
    facts = chunks.groupBy("d").agg(F.max("top").alias("top"), F.array(*[F.max(F.try_element_at("norms", F.lit(j + 1))) for j in range(LISTS)]).alias("reach"))
    worst = facts.agg(F.max(F.pow("top", F.lit(2.0)) * F.col("d"))).first()[0]
    if worst is not None and worst >= 2.0**62:
        raise ValueError("inner products of these vectors can pass 2 ** 62")
    blocks = checkpoint(packed(rows.filter("is_query"), QUERY_BLOCK).join(facts.select("d", F.col("top").alias("peak"), "reach"), "d")
                        .select(F.col("named")[0].alias("block"), "d", "named", F.col("rows").alias("q_rows"), F.col("vecs").alias("q_vecs"), F.col("x").alias("q_x"), F.col("peak").alias("top"), "reach"))
    grid = _Grid(blocks, chunks)
    # 1: k best local scores a query and list; the k-th of their partial sums
    local = grid.meet(blocks.drop("named"), _gather(k), "query long, list int, row long, u long")
    tops = local.withColumn("r", F.row_number().over(Window.partitionBy("query", "list").orderBy(F.desc("u"), "row"))).filter(F.col("r") <= k)
    sums = tops.groupBy("query", "row").agg(F.sum("u").alias("part"))
    kth = lambda df, name: df.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("part")))).filter(F.col("r") == k).select("query", F.col("part").alias(name))
    t1 = blocks.select("block", F.explode("named").alias("query")).join(kth(sums, "t1"), "query")
    cutoffs = t1.groupBy("block").agg(F.collect_list("query").alias("asked"), F.collect_list("t1").alias("t1"))  # QUERY_BLOCK of them at most
    given = checkpoint(blocks.drop("named").join(cutoffs, "block", "left"))
    # 2: what may reach the k-th total
    sent = checkpoint(grid.meet(given, _send(k), "query long, row long, part long, most long"))
    left = sent.join(kth(sent, "t2"), "query", "left").filter(F.col("most") >= F.coalesce("t2", F.lit(0))).select("query", "row")
    discard(blocks, given, chunks)
    # 3: whole scores of what is left
    asked = rows.filter("is_query").select(F.col("row").alias("query"), F.col("vec").alias("query_id"), F.col("x").alias("q"))
    whole = left.join(rows.select("row", "vec", "x"), "row").join(asked, "query")
    score = F.aggregate(F.zip_with("x", "q", lambda a, c: a * c), F.lit(0).cast("long"), lambda a, y: a + y)
    ranked = whole.select("query_id", "vec", score.alias("score")).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec"))).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("vec").alias("vec_id"), "score")
