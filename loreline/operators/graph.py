"""Graph operators on edges(src, dst, ...): reach, subgraph, PageRank, shortest path, communities, callers and callees.

Iterative operators keep a frontier, never all paths; lineage is cut by checkpoints in the shared folder. Nothing but counts and
convergence figures comes back to the driver.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loreline.sources.shared import Scratch, bucketed, checkpoint, dealt, discard, shares


def digraph(edges: DataFrame) -> DataFrame:
    """One edge an ordered pair: the last by (phase, ord) wins."""
    last = Window.partitionBy("src", "dst").orderBy(F.desc("phase"), F.desc("ord"))
    return edges.withColumn("_r", F.row_number().over(last)).filter("_r = 1").drop("_r")


def with_implicit_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Add end points that are no symbols (unresolved names) with default attributes."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("qualified_name")).distinct().join(nodes.select("qualified_name"), "qualified_name", "left_anti")
    return nodes.withColumn("is_external", F.lit(False)).unionByName(ends.select("qualified_name", F.lit("function").alias("type"), F.lit("").alias("file_path"), F.lit(0).alias("line_count"), F.lit(True).alias("is_external")))


def both_ways(edges: DataFrame) -> DataFrame:
    """Undirected pairs (a, b), both ways."""
    return edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(edges.select("dst", "src"))


def neighbours(edges: DataFrame) -> DataFrame:
    """Undirected pairs (a, b), both ways, once."""
    return both_ways(edges).distinct()


def bfs_from(edges: DataFrame, starts: DataFrame, tag: str, hops: int) -> DataFrame:
    """Undirected reach of many starts (tag, node) at once: tag, node, depth. A start that is no node of the graph reaches nothing."""
    pairs = both_ways(checkpoint(edges.select("src", "dst")))  # read in every hop; edges that stand twice do no harm
    known = pairs.select(F.col("a").alias("node"))
    seen = starts.select(tag, "node").distinct().join(known, "node", "left_semi").select(tag, "node", F.lit(0).alias("depth"))
    front = seen
    for d in range(1, hops + 1):
        step = front.join(pairs, front["node"] == pairs["a"]).select(tag, F.col("b").alias("node")).distinct()
        front = step.join(seen.select(tag, "node"), [tag, "node"], "left_anti").withColumn("depth", F.lit(d))
        if hops > 2:
            front = checkpoint(front)
            if front.isEmpty():
                break
        seen = seen.unionByName(front)
    return seen


def first_reach(edges: DataFrame, starts: DataFrame, tag: str, hops: int, by: str | None = None) -> DataFrame:
    """Undirected reach of many starts (tag, node): for each node (and ``by``) the smallest tag that reaches it within ``hops``, with its depth.

    The same as the least (tag, depth) of ``bfs_from``, but a round keeps one row a node, where many starts around one hub would give their
    product. Smallest tags spread by rounds; the round in which a node's last tag came is its depth.
    """
    part = [by] if by else []
    pairs = both_ways(checkpoint(edges.select("src", "dst")))
    known = pairs.select(F.col("a").alias("node"))
    least = F.min(F.struct(tag, "depth")).alias("_l")
    now = starts.select(*part, tag, "node").join(known, "node", "left_semi").withColumn("depth", F.lit(0)).groupBy(*part, "node").agg(least).select(*part, "node", "_l.*")
    for d in range(1, hops + 1):
        now = checkpoint(now)
        step = now.join(pairs, now["node"] == pairs["a"]).select(*part, F.col("b").alias("node"), tag).withColumn("depth", F.lit(d))
        now = now.select(*part, "node", tag, "depth").unionByName(step).groupBy(*part, "node").agg(least).select(*part, "node", "_l.*")
    return now


def bfs_expand(edges: DataFrame, start: str, hops: int = 2) -> DataFrame:
    """node, depth within ``hops`` of one start, directions ignored."""
    starts = edges.sparkSession.createDataFrame([(0, start)], "tag int, node string")
    return bfs_from(edges, starts, "tag", hops).select("node", "depth")


def subgraph(nodes: DataFrame, edges: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Induced directed subgraph on members(node); attributes that are missing get defaults."""
    kept = members.select("node").distinct()
    inner = edges.join(kept.withColumnRenamed("node", "src"), "src", "left_semi").join(kept.withColumnRenamed("node", "dst"), "dst", "left_semi")
    named = kept.join(nodes, kept["node"] == nodes["qualified_name"], "left").select(F.col("node").alias("qualified_name"), F.coalesce("type", F.lit("function")).alias("type"), F.coalesce("file_path", F.lit("")).alias("file_path"))
    return named, inner


def call_graph(nodes: DataFrame, edges: DataFrame, root: str, depth: int = 2) -> tuple[DataFrame, DataFrame]:
    return subgraph(nodes, edges, bfs_expand(edges, root, depth))


def pagerank(nodes: DataFrame, edges: DataFrame, iterations: int | None = None, alpha: float = 0.85, tolerance: float | None = 1e-12) -> DataFrame:
    """node, rank: weighted PageRank, dangling rank spread evenly.

    Rounds go on until ranks, which sum to 1, move by less than ``tolerance`` in all, whatever the number of nodes; ``iterations`` ends
    them sooner. ``tolerance`` None runs exactly ``iterations`` rounds.
    """
    if iterations is None and not tolerance:
        raise ValueError("rounds without a tolerance need a number of iterations")
    n = nodes.count()
    if not n:
        return nodes.sparkSession.createDataFrame([], "node string, rank double")
    weight = F.col("weight") if "weight" in edges.columns else F.lit(1.0)
    told = checkpoint(edges.select("src", "dst", weight.alias("w")))
    rows = told.count()
    flow = checkpoint(dealt(told, rows, "src", "dst").groupBy("src", "dst").agg(F.sum("w").alias("w")))
    out = flow.groupBy("src").agg(F.sum("w").alias("total"))
    # in buckets of the end that gives: a round shuffles ranks, and edges not at all
    parts = shares(nodes.sparkSession, rows)
    share = bucketed(flow.join(out, "src").select("src", "dst", (F.col("w") / F.col("total")).alias("p")).repartition(parts, "src"), parts, "src")
    ranks = step = checkpoint(nodes.select("node").distinct().join(out.withColumnRenamed("src", "node"), "node", "left").select("node", F.col("total").isNull().alias("dangling"), F.lit(1.0 / n).alias("rank")))
    for _ in itertools.count() if iterations is None else range(iterations):
        # the dangling mass is one number, joined as a one-row aggregate: no driver round trip
        lost = ranks.agg(F.coalesce(F.sum(F.when(F.col("dangling"), F.col("rank"))), F.lit(0.0)).alias("lost"))
        into = share.join(ranks.select(F.col("node").alias("src"), "rank").hint("shuffle_hash"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") * F.col("p")).alias("into"))
        moved = ranks.join(into, "node", "left").crossJoin(F.broadcast(lost)).select("node", "dangling", F.col("rank").alias("was"), ((1 - alpha) / n + alpha * (F.coalesce("into", F.lit(0.0)) + F.col("lost") / n)).alias("rank"))
        last, step = step, checkpoint(moved)
        discard(last)
        ranks = step.select("node", "dangling", "rank")
        if tolerance is not None:
            by = step.agg(F.sum(F.abs(F.col("rank") - F.col("was")))).first()[0]
            if not math.isfinite(by):
                raise ValueError("ranks are no numbers; weights must be finite and not negative")
            if by < tolerance:
                break
    discard(share, told, flow)
    return ranks.select("node", "rank")


def top_ranked(nodes: DataFrame, edges: DataFrame, top_n: int = 20, **options) -> DataFrame:
    return pagerank(nodes, edges, **options).orderBy(F.desc(F.round("rank", 12)), "node").limit(top_n)


def shortest_path(edges: DataFrame, source: str, target: str, most: int | None = None) -> list[str] | None:
    """Directed, unweighted; among shortest paths the lexicographically first. None if there is none (of ``most`` hops, if given).

    A breadth-first front keeps one parent a node (the one with the smallest path), so a level holds each node once.
    """
    spark = edges.sparkSession
    pairs = checkpoint(edges.select("src", "dst").distinct())
    if source == target:
        return [source] if not pairs.filter((F.col("src") == source) | (F.col("dst") == source)).isEmpty() else None
    front = spark.createDataFrame([(source, [source])], "node string, path array<string>")
    seen = front.select("node")
    for _ in itertools.count() if most is None else range(most):
        step = front.join(pairs, front["node"] == pairs["src"]).groupBy(F.col("dst").alias("node")).agg(F.min("path").alias("p")).join(seen, "node", "left_anti")
        front = checkpoint(step.select("node", F.concat("p", F.array("node")).alias("path")))
        found = front.filter(F.col("node") == target).first()
        if found:
            return list(found["path"])
        if front.isEmpty():
            return None
        seen = seen.union(front.select("node"))
    return None


def path_lengths(edges: DataFrame, source: str, most: int | None = None) -> DataFrame:
    """node, length of the shortest directed path from the source (of ``most`` hops, if given)."""
    spark = edges.sparkSession
    pairs = checkpoint(edges.select("src", "dst").distinct())
    seen = front = spark.createDataFrame([(source, 0)], "node string, length int")
    for d in itertools.count(1) if most is None else range(1, most + 1):
        front = checkpoint(front.join(pairs, front["node"] == pairs["src"]).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("length", F.lit(d)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def _numbered(edges: DataFrame, keep: Scratch) -> tuple[DataFrame, DataFrame, int]:
    """(node, id) with ids from 0 in the order of names, the edges with ids in place of src and dst, and how many edges. Nulls are no nodes."""
    told = keep(edges)
    rows = told.count()
    nodes = keep(told.select(F.explode(F.array("src", "dst")).alias("node")).filter("node is not null").distinct())
    count = nodes.count()
    if count >= 1 << 31:
        raise ValueError(f"{count} nodes, but ids have 31 bits")
    at = F.monotonically_increasing_id()
    placed = keep(nodes.repartitionByRange(shares(told.sparkSession, count), "node").sortWithinPartitions("node").select("node", F.shiftright(at, 33).alias("part"), at.bitwiseAND((1 << 33) - 1).alias("place")))
    # one row a partition
    before = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    ids = keep(placed.join(F.broadcast(before), "part").select("node", (F.col("before") + F.col("place")).alias("id")))
    rest = [c for c in told.columns if c not in ("src", "dst")]
    first = dealt(told, rows, "src").join(ids.select(F.col("node").alias("src"), F.col("id").alias("_s")), "src").select("_s", "dst", *rest)
    coded = dealt(first, rows, "dst").join(ids.select(F.col("node").alias("dst"), F.col("id").alias("_d")), "dst").select(F.col("_s").alias("src"), F.col("_d").alias("dst"), *rest)
    return ids, keep(coded), rows


def _by_name(labels: DataFrame, ids: DataFrame) -> DataFrame:
    """Labels (node, community) of ids, with names."""
    named = labels.join(ids.select(F.col("id").alias("node"), F.col("node").alias("_n")), "node")
    return named.join(ids.select(F.col("id").alias("community"), F.col("node").alias("_c")), "community").select(F.col("_n").alias("node"), F.col("_c").alias("community"))


def communities(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """node, community: label propagation with a fixed order (the most frequent neighbouring label, ties to the smallest).

    Offered in place of modularity clustering, which is not deterministic; labels are names of member nodes. Two labels that trade places
    forever are stopped by damping: a node also counts its own label. Nodes go by numbers in the order of their names; pairs lie in buckets
    of the end that sends its label, so that a round shuffles the labels sent, once, and nothing else of their number.
    """
    low = (1 << 32) - 1
    with Scratch() as keep:
        ids, coded, rows = _numbered(edges.select("src", "dst"), keep)
        parts = shares(edges.sparkSession, 2 * rows)
        pairs = keep.buckets(both_ways(coded).repartition(parts, "b").distinct(), parts, "b")
        labels = ids.select(F.col("id").alias("node"), F.col("id").alias("community"))
        for _ in range(rounds):
            sent = pairs.join(labels.withColumnRenamed("node", "b").hint("shuffle_hash"), "b").select(F.col("a").alias("node"), "community", F.lit(False).alias("own"))
            votes = sent.union(labels.select("node", "community", F.lit(True))).repartition(parts, "node").groupBy("node", "community").agg(F.count(F.lit(1)).alias("n"), F.max("own").alias("own"))
            # the largest number, then the smallest label
            best = votes.groupBy("node").agg(F.max(F.shiftleft("n", 32) + (F.lit(low) - F.col("community"))).alias("_b"), F.max(F.when(F.col("own"), F.col("community"))).alias("was"))
            step = keep(best.select("node", (F.lit(low) - F.col("_b").bitwiseAND(low)).alias("community"), "was"))
            labels = step.select("node", "community")
            if step.filter("community <> was").isEmpty():
                break
        return checkpoint(_by_name(labels, ids))


def modularity_communities(edges: DataFrame, rounds: int = 20, levels: int = 10, least: float = 1e-7) -> DataFrame:
    """node, community (its smallest node): modularity clustering by local moves and contraction (Louvain), in a fixed order.

    In a round every node looks at its neighbours' communities and takes the one of largest gain, ties to the smallest label; a community
    of one node joins another of one node only if that has the smaller label, so that two never trade places. Rounds end when modularity
    no longer grows by ``least``, and the best labels are kept; communities then become nodes of the next level.

    Nodes go by numbers in the order of their names; links lie in buckets of the end that sends its label, with its community's weight and
    size beside it. A round shuffles what is sent, once; from the same rows comes the modularity of the labels that were sent.
    """
    spark = edges.sparkSession
    with Scratch() as keep:
        weight = F.col("weight") if "weight" in edges.columns else F.lit(1.0)
        ids, coded, rows = _numbered(edges.select("src", "dst", weight.cast("double").alias("w")), keep)
        parts = shares(spark, 2 * rows)
        ways = coded.filter("src <> dst").select(F.col("src").alias("a"), F.col("dst").alias("b"), "w")
        links = keep.buckets(ways.union(ways.select("b", "a", "w")).repartition(parts, "b").groupBy("a", "b").agg(F.sum("w").alias("w")), parts, "b")
        out = ids.select(F.col("id").alias("node"), F.col("id").alias("community"))
        twice_m = links.agg(F.sum("w")).first()[0]
        if not twice_m:
            return checkpoint(_by_name(out, ids))
        quality = None
        for level in range(levels):
            loops = links.filter("a = b").agg(F.coalesce(F.sum("w"), F.lit(0.0))).first()[0] if level else 0.0
            labels = keep(links.groupBy(F.col("b").alias("node")).agg(F.sum("w").alias("k")).withColumn("community", F.col("node")))
            good = labels
            start = quality
            for done in range(rounds + 1):
                sizes = labels.groupBy("community").agg(F.sum("k").alias("total"), F.count(F.lit(1)).alias("n"))
                told = keep(labels.join(sizes, "community").select("node", "k", "community", "total", "n"))
                step = keep(_moves(links, told, parts, twice_m))
                inside, squares = step.agg(F.sum("inside")).crossJoin(told.agg(F.sum(F.col("k") * F.col("total")))).first()
                now = (inside + loops) / twice_m - squares / twice_m**2
                if quality is None:
                    start = quality = now
                if done:
                    if now <= quality + least:
                        break
                    good, quality = labels, now
                labels = step.select("node", "k", "community")
            if quality <= start + least:
                break
            # a community goes by its smallest node
            name = good.groupBy("community").agg(F.min("node").alias("name"))
            named = keep(good.join(name, "community").select("node", F.col("name").alias("community")))
            out = keep(out.join(named.select(F.col("node").alias("community"), F.col("community").alias("next")), "community", "left").select("node", F.coalesce("next", "community").alias("community")))
            ends = lambda c: named.select(F.col("node").alias(c), F.col("community").alias(f"c{c}")).hint("shuffle_hash")  # noqa: B023, E731
            sent = links.join(ends("b"), "b").select("a", "cb", "w").repartition(parts, "a").groupBy("a", "cb").agg(F.sum("w").alias("w"))
            joined = keep(sent.join(ends("a"), "a").groupBy(F.col("ca").alias("a"), F.col("cb").alias("b")).agg(F.sum("w").alias("w")))
            parts = shares(spark, joined.count())
            links = keep.buckets(joined.repartition(parts, "b"), parts, "b")
        return checkpoint(_by_name(out, ids))


def _moves(links: DataFrame, told: DataFrame, parts: int, twice_m: float) -> DataFrame:
    """(node, k, community to go to, inside: weight toward its present community) for all nodes of told (node, k, community, total, n)."""
    given = told.select(F.col("node").alias("b"), "community", "total", "n").hint("shuffle_hash")
    sent = links.filter("a <> b").join(given, "b").select(F.col("a").alias("node"), "community", "total", "n", "w").union(told.select("node", "community", "total", "n", F.lit(0.0)))
    toward = sent.repartition(parts, "node").groupBy("node", "community").agg(F.sum("w").alias("into"), F.max("total").alias("total"), F.max("n").alias("n"))
    own = told.select("node", "k", F.col("community").alias("own"), F.col("n").alias("mates")).hint("shuffle_hash")
    mine = F.col("community") == F.col("own")
    gain = F.round(F.col("into") - F.col("k") * (F.col("total") - F.when(mine, F.col("k")).otherwise(0.0)) / twice_m, 9)
    allowed = mine | (F.col("mates") > 1) | (F.col("n") > 1) | (F.col("community") < F.col("own"))
    return (toward.join(own, "node").filter(allowed).groupBy("node")
            .agg(F.min_by("community", F.struct(-gain, (~mine).cast("int"), "community")).alias("community"), F.first("k").alias("k"), F.sum(F.when(mine, F.col("into"))).alias("inside")))


def _ends(calls: DataFrame, symbols: DataFrame, qualified_name: str, given: str, other: str) -> DataFrame:
    own = symbols.filter(F.col("qualified_name") == qualified_name).agg(F.min("symbol_id").alias(given))
    return calls.join(F.broadcast(own), given).join(symbols.withColumnRenamed("symbol_id", other), other)


def callees(calls: DataFrame, symbols: DataFrame, qualified_name: str) -> DataFrame:
    return _ends(calls, symbols, qualified_name, "caller_id", "callee_id")


def callers(calls: DataFrame, symbols: DataFrame, qualified_name: str) -> DataFrame:
    return _ends(calls, symbols, qualified_name, "callee_id", "caller_id")


def relations(calls: DataFrame, symbols: DataFrame, qualified_name: str, direction: str = "both") -> DataFrame:
    """direction, symbol columns: what calls the symbol and what it calls."""
    if direction not in ("callers", "callees", "both"):
        raise ValueError(f"unknown direction {direction!r}")
    parts = []
    if direction in ("callers", "both"):
        parts.append(callers(calls, symbols, qualified_name).withColumn("direction", F.lit("callers")).select("direction", "qualified_name", "call_type", "confidence", "line_number"))
    if direction in ("callees", "both"):
        parts.append(callees(calls, symbols, qualified_name).withColumn("direction", F.lit("callees")).select("direction", "qualified_name", "call_type", "confidence", "line_number"))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.agg(F.count(F.lit(1)).alias("nodes")).crossJoin(edges.agg(F.count(F.lit(1)).alias("edges")))
