"""Plans that stay bounded on large tables: what is parsed once, spread, shuffled instead of broadcast."""

import random

import pytest
from pyspark.sql import functions as F

from loreline.operators import batch, bm25, evaluate, graph, resolve
from loreline.plans import catalogue
from loreline.sources import python_source as py
from loreline.sources import shared

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]


@pytest.mark.parametrize("name", ["parse_symbols", "parse_imports", "parse_calls", "parse_broken"])
def test_files_are_parsed_once_and_on_all_cores(spark, name):
    df = catalogue.queries()[name](spark, SF)
    assert plan(df).count("InArrow") == 1 and "InPandas" not in plan(df)
    assert df.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_only_the_asked_relations_are_made(spark):
    files = spark.createDataFrame([("a.py", "import os\nclass A(B):\n    def f(self):\n        return os.getcwd()\n"), ("b.py", "def (")], "path string, content string")
    whole = py.parse_files(files)
    some = py.parse_files(files, ("symbols", "calls"))
    assert some.columns == ["path", "hash", "line_count", "size_bytes", "error", "symbols", "calls"]
    assert sorted(map(str, some.collect())) == sorted(map(str, whole.select(some.columns).collect()))


def test_resolution_sends_no_symbols_through_the_driver(spark):
    files = spark.createDataFrame([("a.py", "def f():\n    return g()\n")], "path string, content string")
    parsed = py.parse_files(files)
    edges = resolve.build_edges(py.symbols_of(parsed), py.imports_of(parsed), py.bases_of(parsed), py.calls_of(parsed))
    assert "Broadcast" not in plan(edges)
    assert [(e.src, e.dst) for e in edges.filter(F.col("relation_type") == "calls").collect()] == [("a.f", "g")]


def test_substring_search_sends_no_index_through_the_driver(spark):
    df = spark.createDataFrame([(k, n, q) for k, (n, q) in enumerate([("Abc", "x"), ("bcd", None), (None, None), ("", "AB"), ("éa", "b"), ("ab", "ab")])], "symbol_id long, name string, qualified_name string")
    asked = spark.createDataFrame([(q, q) for q in ("bcd", "AB", "b", "", "É", "zz", "abcd")], "query_id string, query string")
    found = batch.like_search(df, asked, 3)
    assert "Broadcast" not in plan(found)
    assert sorted((x.query_id, x.symbol_id, x["at"]) for x in found.collect()) == sorted(
        [("bcd", 1, 1), ("AB", 0, 1), ("AB", 3, 2), ("AB", 5, 3), ("b", 0, 1), ("b", 1, 2), ("b", 3, 3), ("", 0, 1), ("", 1, 2), ("", 3, 3), ("É", 4, 1)])


def test_first_reach_is_the_least_of_all_reaches_without_their_product(spark):
    r = random.Random(9)
    edges = spark.createDataFrame([(f"n{r.randrange(40)}", f"n{r.randrange(40)}") for _ in range(45)] + [(f"h{k}", "hub") for k in range(60)], "src string, dst string")
    starts = spark.createDataFrame([(r.randrange(3), k, f"h{k}") for k in range(60)] + [(r.randrange(3), 100 + k, f"n{k}") for k in range(0, 40, 3)] + [(0, 999, "no node")], "g int, tag long, node string")
    want = {(x.g, x.node): tuple(x.t) for x in graph.bfs_from(edges, starts.withColumn("t", F.struct("g", "tag")), "t", 2).groupBy("t.g", "node").agg(F.min(F.struct("t.tag", "depth")).alias("t")).collect()}
    got = graph.first_reach(edges, starts, "tag", 2, "g").collect()
    assert {(x.g, x.node): (x.tag, x.depth) for x in got} == want and len(got) == len(want)
    one = graph.first_reach(edges, starts.filter("node like 'h%'"), "tag", 2).collect()
    assert len(one) == 61 and {(x.tag, x.depth) for x in one if x.node != "h0"} == {(0, 1), (0, 2)}


def test_texts_are_tokenised_once_for_an_overlap(spark):
    df = catalogue.queries()["token_overlap"](spark, SF)
    told = plan(df)
    assert told.count("split(lower(coalesce(text") == 1


def test_files_are_walked_for_what_is_asked_only():
    source = "import a as x\nif x:\n    import b as x\n\n\nclass A(x.B):\n    def f(self, n: int = g(1)) -> int:\n        with x.y() as z:\n            w = [q for q in z if h(q)]\n        return w\n"
    whole, some = py.parse_source(source, "m.py"), py.parse_source(source, "m.py", ("symbols", "imports", "bases", "flows"), signatures=False)
    assert some["symbols"] == [s | {"signature": None} for s in whole["symbols"]] and whole["symbols"][1]["signature"]
    assert all(some[k] == whole[k] for k in ("imports", "bases", "flows", "error")) and whole["calls"] and "calls" not in some


def test_bases_meet_one_row_of_a_qualified_name(spark):
    symbols = spark.createDataFrame([(k, "C", "p.m.C") for k in range(50)], "symbol_id long, name string, qualified_name string")
    bases = spark.createDataFrame([(f"q.D{k}", "C", f"q{k}.py", 1, k) for k in range(50)], "child string, parent string, path string, line_number int, pos int")
    imports = spark.createDataFrame([(f"q{k}.py", "p.m", "C", None) for k in range(50)], "path string, module_path string, imported_name string, alias string")
    got = resolve.resolve_parents(bases, imports, resolve.symbol_index(symbols))
    assert {x.parent_qname for x in got.collect()} == {"p.m.C"} and got.count() == 50
    assert "min(at#" in plan(got)


def test_spans_of_a_name_meet_lines_by_bins(spark):
    cases = spark.createDataFrame([(str(k), ["a.py"], ["f", "g"]) for k in range(3)], "case_id string, expected_files array<string>, expected_functions array<string>")
    results = spark.createDataFrame([("0", 1, "a.py", "x", 7, [("y", -3)]), ("1", 1, "a.py", "x", None, None), ("2", 1, "b.py", "f", 7, None), ("2", 2, "a.py", "x", 9, [("K.g", None)])],
                                    "case_id string, rank int, file_path string, name string, line_number int, matched array<struct<name: string, start_line: int>>")
    symbols = spark.createDataFrame([("f", "K.f", s, s + w) for s in range(-4, 9) for w in (0, 3)] + [("f", "K.f", 9, 8), ("g", "K.g", None, 5)], "name string, qualified_name string, start_line int, end_line int")
    got = evaluate.function_hits(cases, results, symbols)
    assert {x.case_id: x.function_rate for x in got.collect()} == {"0": 0.5, "1": 0.0, "2": 1.0}
    assert "_bin" in plan(got)


def test_reach_writes_edges_once_and_deals_them_by_their_number(spark, monkeypatch):
    written = []
    monkeypatch.setattr(graph, "checkpoint", lambda df: written.append(df.localCheckpoint()) or written[-1])
    edges = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "c"), ("c", "d"), ("d", "a")], "src string, dst string")
    starts = spark.createDataFrame([(0, "a"), (1, "no node")], "tag int, node string")
    assert sorted(map(tuple, graph.bfs_from(edges, starts, "tag", 1).collect())) == [(0, "a", 0), (0, "b", 1), (0, "d", 1)]
    assert written[0].count() == 5  # not both ways, nothing grouped
    n = spark.sparkContext.defaultParallelism
    assert [shared.dealt(edges, k, "src").rdd.getNumPartitions() for k in (5, 3 * n * shared.ROWS)] == [n, 3 * n]


def test_postings_are_not_shuffled(spark):
    docs = spark.createDataFrame([(1, "a b a"), (1, "a b a"), (2, None), (3, "B.c")], "doc_id long, text string")
    got = bm25.build_index(docs).postings
    assert sorted(map(tuple, got.collect())) == [("a", 1, 4, 3), ("b", 1, 2, 3), ("b", 3, 1, 2), ("c", 3, 1, 2)]
    told = plan(got).split("== Initial Plan ==")[-1]
    assert told.count("Exchange") == 1 and "hashpartitioning(doc_id" in told


def test_scores_of_documents_and_queries_stay_in_their_task(spark):
    docs = spark.createDataFrame([(1, "the a a"), (2, "the b"), (3, None), (4, "a.b the")], "doc_id long, text string")
    asked = spark.createDataFrame([(0, "a the"), (1, "b"), (2, "none")], "query_id int, query string")
    got = bm25.search(docs, asked, 2)
    assert sorted((x.query_id, x["rank"], x.doc_id) for x in got.collect()) == [(0, 1, 1), (0, 2, 4), (1, 1, 2), (1, 2, 4)]
    told = plan(got).split("== Initial Plan ==")[-1]
    assert "hashpartitioning(doc_id" in told
    assert not [x for x in told.split("\n") if "hashpartitioning(query_id" in x and "doc_id" in x.split("hashpartitioning(")[1].split(")")[0]]


def _odd_graph(spark):
    r = random.Random(4)
    pairs = [(f"n{r.randrange(30)}", f"n{r.randrange(30)}") for _ in range(60)] + [("n1", "n2"), ("n2", "n1"), ("n3", "n3"), ("solo", "solo"), ("é", "Z")] + [("hub", f"n{k}") for k in range(30)]
    return pairs, spark.createDataFrame([*pairs, ("alone", None)], "src string, dst string")


def _told(monkeypatch):
    plans, write = [], shared.checkpoint
    monkeypatch.setattr(shared, "checkpoint", lambda df: plans.append(plan(df).split("== Initial Plan ==")[-1]) or write(df))
    return plans


def test_a_round_of_label_propagation_shuffles_the_labels_sent_once(spark, monkeypatch):
    pairs, edges = _odd_graph(spark)
    told = _told(monkeypatch)
    got = {x.node: x.community for x in graph.communities(edges, 4).collect()}
    near = {p for a, b in pairs for p in ((a, b), (b, a))}
    label = {x: x for p in near for x in p} | {"alone": "alone"}
    for _ in range(4):
        votes = {x: [label[b] for a, b in near if a == x] + [label[x]] for x in label}
        label = {x: min(v, key=lambda c, v=v: (-v.count(c), c)) for x, v in votes.items()}
    assert got == label
    rounds = [p for p in told if "shiftleft" in p]
    assert rounds and all(sum("hashpartitioning(" in x and "Exchange" in x for x in p.split("\n")) <= 2 and "SortMergeJoin" not in p for p in rounds)  # labels by b, votes by node
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("loreline_")]


def test_a_round_of_local_moves_shuffles_what_is_sent_once(spark, monkeypatch):
    _, edges = _odd_graph(spark)
    told = _told(monkeypatch)
    got = {x.node: x.community for x in graph.modularity_communities(edges).collect()}
    assert {x for x in got if got[x] == x} >= {"alone", "solo"} and got["é"] == got["Z"] == "Z" and all(got[c] == c for c in got.values())
    rounds = [p for p in told if "AS inside" in p or "inside#" in p]
    assert rounds and all(sum("hashpartitioning(" in x and "Exchange" in x for x in p.split("\n")) <= 3 for p in rounds)  # what is told by b and by node, what is sent by node
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("loreline_")]


def test_a_round_of_pagerank_shuffles_no_edges(spark, monkeypatch):
    plans, write = [], graph.checkpoint
    monkeypatch.setattr(graph, "checkpoint", lambda df: plans.append(plan(df)) or write(df))
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "c"), ("c", "a")], "src string, dst string")
    got = {x.node: x["rank"] for x in graph.pagerank(spark.createDataFrame([("a",), ("b",), ("c",)], "node string"), edges, 1, tolerance=None).collect()}
    assert {k: round(v, 9) for k, v in got.items()} == {"a": round(0.05 + 0.85 / 3, 9), "b": round(0.05 + 0.85 / 6, 9), "c": round(0.05 + 0.85 / 2, 9)}
    assert "Bucketed: true" in plans[-1]
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("loreline_")]


def test_a_task_tells_few_pairs_apart(spark, tmp_path):
    """Pairs of lineitem are dealt by their number, well below a million a task, and ends of edges are named in one pass over them."""
    rows = 4_000_000
    spark.range(rows).select((F.col("id") % 7).alias("l_suppkey"), (F.col("id") % 11).alias("l_partkey")).write.parquet(str(tmp_path / "lineitem.parquet"))
    for name in ("nation", "region", "customer", "supplier"):
        (tmp_path / f"{name}.parquet").symlink_to(f"{SF}/{name}.parquet")
    edges = catalogue._edges(spark, str(tmp_path))
    assert edges.filter("phase = 3").rdd.getNumPartitions() == max(spark.sparkContext.defaultParallelism, rows // catalogue.PAIRS) == 16
    assert edges.filter("phase = 3").count() == 77
    none = spark.createDataFrame([("S1",)], "qualified_name string").selectExpr("qualified_name", "'class' as type", "'' as file_path", "0 as line_count")
    ends = graph.with_implicit_nodes(none, edges.filter("phase = 3").unionByName(spark.createDataFrame([(None, "S1")], "src string, dst string"), allowMissingColumns=True))
    assert plan(ends).count("REPARTITION_BY_NUM") == 1
    got = [(x.qualified_name, x.is_external) for x in ends.collect()]
    assert len(got) == 19 and set(got) == {("S1", False), (None, True), *((f"S{k}", True) for k in range(7) if k != 1), *((f"P{k}", True) for k in range(11))}
