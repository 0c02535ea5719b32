import pytest
from pyspark.sql import functions as F

from loreline.operators import bm25, evaluate, evidence, freshness, graph, resolve, retrieval, skeleton, types, vector


def test_bm25(spark):
    docs = spark.createDataFrame([(0, "login user"), (1, "logout user"), (2, "process data")], "doc_id long, text string")
    ask = lambda q: [r.doc_id for r in bm25.search(docs, spark.createDataFrame([(0, q)], "query_id int, query string"), 5).orderBy("rank").collect()]
    assert ask("login") == [0] and ask("zzzzz") == [] and set(ask("user")) == {0, 1}
    none = docs.limit(0)
    assert bm25.corpus_stats(none).first().avgdl == 1.0


def test_like_escapes_wildcards(spark):
    rows = spark.createDataFrame([(1, "test_func", "test.test_func")], "symbol_id long, name string, qualified_name string")
    assert retrieval.like_search(rows, "TEST_func", 5).count() == 1 and retrieval.like_search(rows, "%", 5).count() == 0


def test_rrf(spark):
    rows = spark.createDataFrame([("bm25", "a", 10.0, 0), ("graph", "a", 0.5, 1), ("bm25", "b", 5.0, 2)], "source string, key string, score double, ord long")
    got = {r.key: r for r in retrieval.rrf(rows).collect()}
    assert got["a"].score > got["b"].score and got["a"].sources == "bm25+graph"
    # a key repeated in a source keeps its last rank, and each occurrence adds
    twice = spark.createDataFrame([("g", "x", 1.0, 0), ("g", "x", 1.0, 1)], rows.schema)
    assert retrieval.rrf(twice).first().score == pytest.approx(2 / 62)


def test_file_aggregate(spark):
    rows = spark.createDataFrame([("Indexer.py", 0.9, 0, 1), ("indexer.py", 0.7, 1, 2), ("parser.py", 0.8, 2, 3), ("", 9.0, 3, 4)], "file_path string, score double, ord long, symbol_id long")
    got = retrieval.file_aggregate(rows, 5).orderBy(F.desc("score")).collect()
    assert [(r.norm_path, round(r.score, 6), r.best, r.members) for r in got] == [("indexer.py", 0.97, 1, [1, 2]), ("parser.py", 0.8, 3, [3])]


def symbols(spark):
    return spark.createDataFrame([(1, "login", "auth.login", "function", "src/auth.py", 5, 15, "", ""), (2, "query", "db.query", "function", "src/db.py", 5, 15, "", "")], "symbol_id long, name string, qualified_name string, type string, file_path string, start_line int, end_line int, docstring string, signature string")


def test_trace_aware_retrieval(spark):
    s = symbols(spark)
    edges = spark.createDataFrame([("auth.login", "db.query")], "src string, dst string")
    imports = spark.createDataFrame([("src/auth.py", "db", 1)], "path string, module_path string, line_number int")
    trace = 'Traceback (most recent call last):\n  File "src/auth.py", line 10, in login\nValueError: x'
    rows = retrieval.trace_branch(s, edges, imports, trace).collect()
    assert {(r.symbol_id, r.source) for r in rows} == {(1, "trace_direct"), (2, "trace_graph")}
    for mode in ("full", "hybrid"):
        got = retrieval.retrieve(s, trace, 5, mode, edges=edges, imports=imports).orderBy(F.desc("score")).collect()
        assert {r.norm_path for r in got} == {"src/auth.py", "src/db.py"} and got[0].norm_path == "src/auth.py"
    assert retrieval.retrieve(s, "login", 5, "symbol_only").first().best == 1
    assert retrieval.retrieve(s, "login", 5, "keyword_only").first().best == 1
    with pytest.raises(ValueError):
        retrieval.retrieve(s, "x", 5, "nope")


def test_confidence(spark):
    f = lambda *v: retrieval.result_confidence(spark.createDataFrame([(float(x),) for x in v], "score double")).first()[0]
    assert f(0.5, 100) == 0.5 and f(500) == 0.99 and f() == 0.0


def test_vector(spark):
    rows = spark.createDataFrame([(1, [0.0, 0.0]), (2, [3.0, 4.0])], "id long, embedding array<float>")
    got = vector.knn(rows, [0.0, 0.0], 2).collect()
    assert [(r.id, r.distance) for r in got] == [(1, 0.0), (2, 5.0)]


def edges(spark, *pairs):
    return spark.createDataFrame(list(pairs), "src string, dst string")


def test_graph(spark):
    e = edges(spark, ("a", "b"), ("b", "c"), ("x", "y"))
    reach = lambda s, k: {r.node for r in graph.bfs_expand(e, s, k).collect()}
    assert reach("a", 2) == {"a", "b", "c"} and reach("a", 1) == {"a", "b"} and reach("c", 5) == {"a", "b", "c"} and reach("nope", 2) == set()
    assert reach("a", 1) <= reach("a", 2)
    assert graph.shortest_path(e, "a", "c") == ["a", "b", "c"] and graph.shortest_path(e, "a", "y") is None and graph.shortest_path(e, "c", "a") is None
    n = spark.createDataFrame([("a",), ("b",), ("c",)], "node string")
    rank = graph.pagerank(n, edges(spark, ("a", "b"), ("b", "c")), 60).collect()
    assert sum(r.rank for r in rank) == pytest.approx(1, abs=1e-4)
    assert graph.pagerank(n.limit(0), edges(spark, ("a", "b"))).count() == 0
    assert {r.community for r in graph.communities(edges(spark, ("a", "b"), ("b", "c"), ("a", "c"), ("x", "y")), 5).collect() if r.node in "abc"} == {"a"}


def test_diamond_with_cycle(spark):
    e = edges(spark, ("root", "l"), ("root", "r"), ("l", "s"), ("r", "s"), ("s", "root")).withColumn("relation_type", F.lit("calls"))
    nodes, kept = graph.call_graph(spark.createDataFrame([], "qualified_name string, type string, file_path string"), e, "root", 2)
    assert nodes.count() == 4 and kept.count() == 5 and nodes.first().type == "function"


def test_digraph_keeps_the_last(spark):
    e = spark.createDataFrame([("a", "b", "imports", 1, 0), ("a", "b", "calls", 3, 0)], "src string, dst string, relation_type string, phase int, ord long")
    assert [r.relation_type for r in graph.digraph(e).collect()] == ["calls"]


def test_resolution(spark):
    s = spark.createDataFrame([(1, "bar", "pkg.MyClass.bar"), (2, "foo", "pkg.module.foo"), (3, "dup", "a.dup"), (4, "dup", "b.dup")], "symbol_id long, name string, qualified_name string")
    c = spark.createDataFrame([(1, "bar", "self", "pkg.MyClass"), (2, "foo", "direct", None), (3, "nope", "direct", None), (4, "", "direct", None), (5, "dup", "direct", "b.C"), (6, "dup", "direct", None), (7, "module.foo", "method", None)], "call_id long, target string, call_type string, caller_class string")
    got = {r.call_id: (r.callee, r.resolution, r.confidence) for r in resolve.resolve_callees(c, resolve.symbol_index(s)).collect()}
    assert got == {1: ("pkg.MyClass.bar", "self_method", 1.0), 2: ("pkg.module.foo", "exact_match", 1.0), 3: ("nope", "unresolved", 0.0), 4: (None, None, None), 5: ("b.dup", "module_match", 0.9), 6: ("a.dup", "first_candidate", 0.5), 7: ("pkg.module.foo", "suffix_match", 1.0)}


def test_freshness(spark):
    old = spark.createDataFrame([("auth.py", "1"), ("utils.py", "2"), ("same.py", "3")], "path string, hash string")
    new = spark.createDataFrame([("auth.py", "9"), ("new_module.py", "4"), ("same.py", "3")], "path string, hash string")
    r = freshness.listed(freshness.diff(old, new)).first()
    assert (r.changed, r.new, r.deleted, r.unchanged, r.freshness) == (["auth.py"], ["new_module.py"], ["utils.py"], ["same.py"], "stale")
    assert freshness.report(freshness.diff(old, old)).first().freshness == "current"
    merged = {(x.path, x.hash) for x in freshness.merge_files(old, new).collect()}
    assert merged == {(x.path, x.hash) for x in new.collect()}
    assert freshness.snapshot(old, []).first().file_hashes == {"auth.py": "1", "utils.py": "2", "same.py": "3"}
    assert {x.path: x.status for x in freshness.validate(old, new).collect()} == {"auth.py": "changed", "utils.py": "missing", "same.py": "valid"}


SOURCE = 'def foo(x):\n    print("foo")\n    return x\n\ndef bar(y):\n    print("bar")\n    return y\n'


def test_skeleton():
    assert skeleton.skeletonize(SOURCE, set()).strip() == "def foo(x):\n    # ... [2 lines collapsed]\n\ndef bar(y):\n    # ... [2 lines collapsed]"
    assert skeleton.skeletonize(SOURCE, {6}).strip() == 'def foo(x):\n    # ... [2 lines collapsed]\n\ndef bar(y):\n=>     print("bar")\n    return y'
    assert skeleton.skeletonize("def broken(:\n", {1}) == "=> def broken(:\n" and skeleton.skeletonize("  ", set()) == "  "


def test_types(spark):
    src = "from m import Repo\nclass Foo:\n    def run(self, n: int) -> str:\n        x = Bar()\n        y.save(); y.load()\n        return n\n"
    asked = [("run", 3, "str", "explicit_hint"), ("n", 3, "int", "explicit_hint"), ("repo", 1, "Repo", "import_mapping"), ("self", 4, "Foo", "self_inference"), ("x", 5, "Bar", "assignment"), ("y", 6, "DuckType(load, save)", "duck_typing"), ("zz", 6, None, "none")]
    rows = spark.createDataFrame([(src, n, x) for x, n, _, _ in asked], "source string, line int, name string")
    got = {(r.name, r.line): (r.type_name, r.strategy) for r in types.infer(rows).collect()}
    assert got == {(x, n): (t, s) for x, n, t, s in asked}


def test_evidence(spark):
    traces = spark.createDataFrame([(1, 'Traceback (most recent call last):\n  File "/p/src/m.py", line 7, in run\n    go()\nKeyError: k'), (2, "nothing")], "trace_id long, text string")
    files = spark.createDataFrame([("src/m.py",)], "path string")
    s = spark.createDataFrame([(5, "src.m.run", "src/m.py", 5, 9)], "symbol_id long, qualified_name string, file_path string, start_line int, end_line int")
    sources = spark.createDataFrame([("src/m.py", "\n".join(f"l{i}" for i in range(1, 12)))], "path string, content string")
    ev = evidence.trace_evidence(traces, files, s, sources)
    r = ev.first()
    assert (r.symbol_id, r.start_line, r.end_line) == (5, 2, 12) and "=> 7: l7" in r.snippet
    b = {x.trace_id: x for x in evidence.bundles(traces, ev).collect()}
    assert b[1].summary == "KeyError: k" and b[1].confidence == 0.8 and b[1].call_chain == ["src/m.py:2 in run"] and b[2].confidence == 0.0
    assert evidence.should_stop(5, 0.0) and evidence.should_stop(1, 0.8) and not evidence.should_stop(1, 0.5)


def test_evaluation(spark):
    cases = spark.createDataFrame([("c1", "q", "find", ["src/a.py"], ["m.run"]), ("c2", "q", "find", ["src/b.py"], ["go"])], "case_id string, type string, query string, expected_files array<string>, expected_functions array<string>")
    res = spark.createDataFrame([("c1", 1, "./SRC/a.py", "other", 7, None), ("c2", 1, "src/x.py", "go", 1, None), ("c2", 2, "src/b.py", "zz", 1, None)], "case_id string, rank int, file_path string, name string, line_number int, matched array<struct<name:string,start_line:int>>")
    syms = spark.createDataFrame([("run", "m.run", 5, 9)], "name string, qualified_name string, start_line int, end_line int")
    got = {r.case_id: (r.top1, r.top3, r.function_rate, r.category) for r in evaluate.evaluate(cases, res, syms).collect()}
    assert got == {"c1": (True, True, 1.0, "other"), "c2": (False, True, 0.0, "ranking_error")}
    m = evaluate.metrics(evaluate.evaluate(cases, res, syms)).first()
    assert (m.top1_rate, m.top3_rate, m.function_rate) == (0.5, 1.0, 0.5)
    assert evaluate.metrics(evaluate.evaluate(cases.limit(0), res, syms)).first().top1_rate is None


@pytest.fixture(scope="module")
def small_graph(spark, tmp_path_factory):
    """Tables of the catalogue's graph: 2 regions, 3 nations, 4 customers, 3 suppliers, 5 parts."""
    d = str(tmp_path_factory.mktemp("graph"))
    tables = {"region": ("r_regionkey", [(0,), (1,)]), "nation": ("n_nationkey,n_regionkey", [(0, 0), (1, 0), (2, 1)]), "customer": ("c_custkey,c_nationkey", [(1, 0), (2, 0), (3, 1), (4, 2)]),
              "supplier": ("s_suppkey,s_nationkey", [(1, 0), (2, 1), (3, 2)]), "lineitem": ("l_suppkey,l_partkey", [(1, 1), (1, 2), (2, 2), (2, 3), (3, 4), (3, 5), (3, 5)])}
    for name, (columns, rows) in tables.items():
        spark.createDataFrame(rows, [c for c in columns.split(",")]).write.parquet(f"{d}/{name}.parquet")
    pairs = {(f"R{b}", f"N{a}") for a, b in tables["nation"][1]} | {(f"N{b}", f"C{a}") for a, b in tables["customer"][1]} | {(f"N{b}", f"S{a}") for a, b in tables["supplier"][1]} | {(f"S{a}", f"P{b}") for a, b in tables["lineitem"][1]}
    return d, pairs


def test_graph_queries_run_on_the_whole_graph(spark, small_graph):
    from loreline.plans import catalogue

    d, pairs = small_graph
    nodes = sorted({x for p in pairs for x in p})
    rank = {x: 1 / len(nodes) for x in nodes}
    out = {x: [b for a, b in pairs if a == x] for x in nodes}
    for _ in range(100):
        lost = sum(rank[x] for x in nodes if not out[x])
        rank = {x: 0.15 / len(nodes) + 0.85 * (sum(rank[a] / len(out[a]) for a, b in pairs if b == x) + lost / len(nodes)) for x in nodes}
    got = {r.node: r["rank"] for r in catalogue.queries()["pagerank_top"](spark, d).collect()}
    assert got.keys() == set(nodes) and all(abs(got[x] - rank[x]) < 1e-4 for x in nodes)
    label = {x: x for x in nodes}
    for _ in range(10):
        votes = {x: [label[b if a == x else a] for a, b in pairs if x in (a, b)] + [label[x]] for x in nodes}
        label = {x: min(v, key=lambda c, v=v: (-v.count(c), c)) for x, v in votes.items()}
    assert {r.node: r.community for r in catalogue.queries()["communities"](spark, d).collect()} == label


def test_pagerank_goes_on_until_ranks_stand_still(spark, small_graph):
    import duckdb

    from loreline.plans import catalogue

    def ranks(pairs):
        nodes = sorted({x for p in pairs for x in p})
        rank = {x: 1 / len(nodes) for x in nodes}
        out = {x: [b for a, b in pairs if a == x] for x in nodes}
        for _ in range(300):
            lost = sum(rank[x] for x in nodes if not out[x])
            rank = {x: 0.15 / len(nodes) + 0.85 * (sum(rank[a] / len(out[a]) for a, b in pairs if b == x) + lost / len(nodes)) for x in nodes}
        return rank

    d, pairs = small_graph
    want = {x: round(r, 9) for x, r in ranks(pairs).items()}
    assert {r.node: r["rank"] for r in catalogue.queries()["pagerank_fixed"](spark, d).collect()} == want
    con = duckdb.connect()
    for name in ("region", "nation", "customer", "supplier", "lineitem"):
        con.execute(f"create view {name} as select * from '{d}/{name}.parquet/*.parquet'")
    assert dict(con.execute(catalogue.oracle_sql()["pagerank_fixed"]).fetchall()) == want
    # what is left to move does not grow with the number of nodes: a cycle with a tail, beside nodes that stand alone
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), *((f"n{k}", "d") for k in range(2000))]
    got = {r.node: r["rank"] for r in graph.pagerank(spark.createDataFrame([(x,) for x in ranks(pairs)], "node string"), edges(spark, *pairs)).collect()}
    assert all(abs(got[x] - r) < 1e-11 for x, r in ranks(pairs).items())
    with pytest.raises(ValueError):
        graph.pagerank(spark.createDataFrame([("a",)], "node string"), edges(spark, ("a", "a")), tolerance=None)


def test_long_chains_have_paths(spark):
    e = edges(spark, *[(f"n{i:02}", f"n{i + 1:02}") for i in range(52)])
    assert graph.shortest_path(e, "n00", "n52") == [f"n{i:02}" for i in range(53)]
    tail = e.filter("src >= 'n30'")
    assert {r.node: r.length for r in graph.path_lengths(tail, "n30").collect()} == {f"n{i}": i - 30 for i in range(30, 53)}


def test_bm25_index_holds_every_posting(spark, tmp_path):
    from collections import Counter

    from loreline.plans import catalogue

    docs = [(1, "a b a"), (2, "Load the user"), (3, ""), (4, None), (5, "word " * 25 + "rare")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {(i, w, n) for i, t in docs for w, n in Counter((t or "").lower().split()).items()}
    got = catalogue.queries()["bm25_index"](spark, str(tmp_path)).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_modularity_communities(spark):
    """Planted groups are found, and modularity comes near that of a plain one-by-one Louvain."""
    import random

    r = random.Random(3)
    group = {f"g{k}n{j}": k for k in range(6) for j in range(8)}
    names = sorted(group)
    links = {(a, b) for a in names for b in names if a < b and r.random() < (0.7 if group[a] == group[b] else 0.03)}
    e = edges(spark, *links, ("solo", "solo"))
    got = {x.node: x.community for x in graph.modularity_communities(e).collect()}
    assert got.pop("solo") == "solo" and got.keys() == group.keys()

    def score(label):
        k = {x: sum(x in p for p in links) for x in names}
        inside = sum(label[a] == label[b] for a, b in links) / len(links)
        return inside - sum((sum(k[x] for x in names if label[x] == c) / (2 * len(links))) ** 2 for c in set(label.values()))

    plain = {x: x for x in names}
    moved = True
    while moved:  # first phase of the plain method, one node at a time
        moved = False
        for x in names:
            best = max(sorted({plain[b if a == x else a] for a, b in links if x in (a, b)} | {plain[x]}), key=lambda c: score(plain | {x: c}))
            if score(plain | {x: best}) > score(plain) + 1e-9:
                plain[x], moved = best, True
    assert score(got) >= max(score(group), score(plain)) - 0.02
    assert all(c == min(x for x in names if got[x] == c) for c in set(got.values()))
    two = graph.modularity_communities(edges(spark, ("a", "b"), ("b", "c"), ("a", "c"), ("c", "x"), ("x", "y"), ("y", "z"), ("x", "z"))).collect()
    assert {x.node: x.community for x in two} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x", "z": "x"}
    assert graph.modularity_communities(edges(spark, ("a", "a"))).collect()[0].community == "a"
