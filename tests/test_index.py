import pytest
from pyspark.sql import functions as F

from loreline.errors import GraphChecksumError, IndexNotFound
from loreline.operators import graph
from loreline.options import IndexOptions, QueryOptions
from loreline.plans import index_job, report
from loreline.plans.query_service import QueryService
from loreline.sources import files as fs
from loreline.sources.python_source import parse_source
from loreline.sources.store import IndexStore
from loreline.streaming import watch

AUTH = '''import os
from db import query as q


class Base:
    pass


class Auth(Base):
    """Signs in."""

    def login(self, user: str) -> bool:
        """Log a user in."""
        self.check(user)
        return helper(user)

    async def check(self, user):
        def inner():
            return os.path.join(user)
        return inner()


def helper(x):
    return x
'''


@pytest.fixture()
def project(tmp_path):
    root = tmp_path / "p"
    (root / "venv").mkdir(parents=True)
    (root / "auth.py").write_text(AUTH)
    (root / "db.py").write_text("def query(sql):\n    return sql\n")
    (root / "bad.py").write_text("def broken(:\n")
    (root / "venv" / "skip.py").write_text("x = 1\n")
    return root


def test_parse_source():
    got = parse_source(AUTH, "auth.py")
    names = [(s["qualified_name"], s["type"]) for s in got["symbols"]]
    assert names == [("auth.Base", "class"), ("auth.Auth", "class"), ("auth.Auth.login", "method"), ("auth.Auth.check", "method"), ("auth.Auth.check.inner", "method"), ("auth.helper", "function")]
    assert [(i["module_path"], i["imported_name"], i["alias"]) for i in got["imports"]] == [("os", None, None), ("db", "query", "q")]
    assert [(c["target"], c["call_type"]) for c in got["calls"]] == [("check", "self"), ("helper", "direct"), ("join", "method"), ("inner", "direct")]
    assert got["bases"] == [{"child": "auth.Auth", "parent": "Base", "line_number": 9}]
    assert parse_source("def (", "x.py")["error"]


def test_scan(spark, project):
    assert sorted(r.path for r in fs.scan_tree(spark, str(project)).collect()) == ["auth.py", "bad.py", "db.py"]
    tiny = IndexOptions(max_file_size_mb=20 / 1024 / 1024)
    assert sorted(r.path for r in fs.scan_tree(spark, str(project), tiny).collect()) == ["bad.py"]
    only = IndexOptions(ignore_patterns=("bad.py", "d*.py"))
    assert sorted(r.path for r in fs.scan_tree(spark, str(project), only).collect()) == ["auth.py"]


def test_scan_of_names_that_begin_with_an_underscore(spark, tmp_path):
    root = tmp_path / "a [b] c"
    for name in ("__init__.py", "pkg/__init__.py", "pkg/_own/deep/x y.py", "pkg/_own/__main__.py", "pkg/plain.py", "_top.py", "__pycache__/z.py", "pkg/é_ü/_ö.py", "pkg/_big.py"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(f"# {name}\n" + "x" * (3000 if "big" in name else 0))
    (root / "pkg" / "_own" / "note.txt").write_text("no")
    want = ["__init__.py", "_top.py", "pkg/__init__.py", "pkg/_own/__main__.py", "pkg/_own/deep/x y.py", "pkg/plain.py", "pkg/é_ü/_ö.py"]
    got = fs.scan_tree(spark, str(root), IndexOptions(max_file_size_mb=2000 / 1024 / 1024)).collect()
    assert sorted(r.path for r in got) == want and all(bytes(r.content).decode() == f"# {r.path}\n" and r.size_bytes == len(r.content) for r in got)
    asked = fs.read_files(spark, str(root), ["pkg/__init__.py", "pkg/plain.py", "gone.py", "pkg/_own/deep/x y.py"]).collect()
    assert sorted(r.path for r in asked) == ["pkg/__init__.py", "pkg/_own/deep/x y.py", "pkg/plain.py"]
    # a store that only the driver's file system opens
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.under.link./in", f"file://{tmp_path}")
    far = fs.read_apart(spark, ["viewfs://under/in/a [b] c/pkg/_own/deep/x y.py", "viewfs://under/in/a [b] c/_top.py"]).collect()
    assert sorted(bytes(r.content).decode() for r in far) == ["# _top.py\n", "# pkg/_own/deep/x y.py\n"]


def test_index_query_refresh(spark, project, tmp_path):
    store = str(tmp_path / "ix")
    with pytest.raises(IndexNotFound):
        IndexStore(spark, store).read("files")
    r = index_job.index_directory(spark, str(project), store)
    assert (r.version, r.files, r.symbols, r.classes, r.calls) == (1, 3, 7, 2, 4) and r.errors[0].startswith("bad.py")
    svc = QueryService(spark, store, str(project))
    assert svc.callees("auth.Auth.login").count() == 2
    assert [x.qualified_name for x in svc.callers("auth.helper").collect()] == ["auth.Auth.login"]
    with pytest.raises(ValueError):
        svc.relations("auth.helper", "sideways")
    nodes, edges = svc.call_graph("auth.Auth.login", 1)
    assert "auth.helper" in {x.qualified_name for x in nodes.collect()}
    assert edges.filter("relation_type = 'calls'").count() >= 2
    assert svc.store.read("inherits").count() == 1 and svc.store.read("edges").filter("relation_type = 'imports'").count() == 1
    assert svc.symbols().filter("name = 'login'").first().parent_class_id == svc.symbols().filter("name = 'Auth'").first().symbol_id
    top = svc.search("login user", QueryOptions(mode="full", max_results=3)).first()
    assert top.norm_path == "auth.py" and "def" in top.snippet and 0 <= top.confidence <= 1
    for mode in ("keyword_only", "symbol_only", "hybrid"):
        assert svc.search("login", QueryOptions(mode=mode)).first().norm_path == "auth.py"
    trace = spark.createDataFrame([(1, f'Traceback (most recent call last):\n  File "{project}/db.py", line 2, in query\n    return sql\nValueError: no')], "trace_id long, text string")
    bundle, ev = svc.diagnose(trace)
    assert bundle.first().confidence == 0.8 and ev.first().qualified_name == "db.query"
    assert "ValueError" in report.evidence_markdown(bundle.first().asDict(), [e.asDict() for e in ev.collect()])
    assert index_job.refresh_if_stale(spark, str(project), store) is None  # idempotent
    assert watch.watch_once(spark, str(project), store) is None
    (project / "db.py").unlink()
    (project / "new.py").write_text("def fresh():\n    pass\n")
    seen = index_job.check_freshness(spark, str(project), store).first()
    assert (seen.new, seen.deleted, seen.freshness) == (["new.py"], ["db.py"], "stale")
    done = index_job.refresh_if_stale(spark, str(project), store)
    assert done.version == 2 and svc.store.version() == 2
    assert svc.lookup_symbol("fresh").count() == 1 and svc.lookup_symbol("query").count() == 0
    row = svc.stats().first()
    assert row.files == 3 and row.symbols == 7
    # tampering is noticed
    v = svc.store.version()
    edges = spark.createDataFrame(svc.store.read("edges").limit(1).collect(), svc.store.read("edges").schema)
    edges.write.mode("overwrite").parquet(f"{store}/v={v}/edges")
    with pytest.raises(GraphChecksumError):
        svc.store.load_graph()
    svc.store.clear()
    assert svc.store.version() == 0 and svc.store.load_graph()[1].count() == 0


def test_refresh_parses_what_changed_and_keeps_the_rest(spark, project, tmp_path):
    store = str(tmp_path / "ix")
    vectors = lambda ix: {r.symbol_id: list(r.embedding) for r in ix.read("embeddings").collect()}
    assert index_job.index_directory(spark, str(project), store).skipped == 1
    ix = IndexStore(spark, store)
    assert ix.get_stat("parsed") == 3
    ids = {r.qualified_name: r.symbol_id for r in ix.read("symbols").collect()}
    given = spark.createDataFrame([(i, [float(k), 1.0]) for k, i in enumerate(ids.values())], "symbol_id long, embedding array<float>")
    index_job.index_directory(spark, str(project), store, IndexOptions(incremental=True), given)
    assert ix.version() == 2 and ix.get_stat("parsed") == 0 and len(vectors(ix)) == len(ids) == 7
    types = ix.read("type_info").count()
    (project / "db.py").write_text("def query(sql):\n    return sql\n\n\ndef more(x: int):\n    return x\n")
    done = index_job.refresh_if_stale(spark, str(project), store)
    assert (done.version, done.files, done.skipped, done.symbols) == (3, 3, 1, 8) and ix.get_stat("parsed") == 1
    assert set(vectors(ix)) == {i for n, i in ids.items() if n.startswith("auth.")} and ix.read("type_info").count() >= types
    assert [r.path for r in ix.read("errors").collect()] == ["bad.py"]
    # a rebuild from nothing gives the same tables
    index_job.index_directory(spark, str(project), str(tmp_path / "other"))
    for table in ("files", "symbols", "imports", "calls", "inherits", "type_info", "edges", "nodes", "bm25_postings", "bm25_terms", "bm25_stats"):
        rows = lambda at: sorted(map(str, IndexStore(spark, at).read(table).collect()))  # noqa: B023, E731
        assert rows(store) == rows(str(tmp_path / "other")), table


def test_a_stored_index_answers_like_a_scan(spark, project, tmp_path):
    from loreline.operators import bm25, retrieval

    store = str(tmp_path / "ix")
    index_job.index_directory(spark, str(project), store)
    symbols, stored = IndexStore(spark, store).read("symbols"), IndexStore(spark, store).lexical()
    asked = spark.createDataFrame([(0, "log a user in"), (1, "query query"), (2, "zzz")], "query_id int, query string")
    docs = symbols.select("symbol_id", retrieval.index_text().alias("text"))
    want = sorted((r.query_id, r.doc_id, round(r.score, 9), r["rank"]) for r in bm25.search(docs, asked, 5, "symbol_id").collect())
    got = bm25.search_index(stored, asked, 5)
    assert want and sorted((r.query_id, r.doc_id, round(r.score, 9), r["rank"]) for r in got.collect()) == want
    assert "PushedFilters: [In(token" in got._jdf.queryExecution().toString()


def test_watch_stream(spark, project, tmp_path):
    import time

    store, seen = str(tmp_path / "ix"), []
    q = watch.watch(spark, str(project), store, 0.2, on_refresh=lambda i, r: seen.append(r.version))
    try:
        for _ in range(120):
            if seen:
                break
            time.sleep(0.5)
    finally:
        q.stop()
    assert seen and seen[0] == 1


def test_change_stream(spark, tmp_path):
    indexed = spark.createDataFrame([("a", "1"), ("b", "1")], "path string, hash string")
    spark.createDataFrame([("a", "2"), ("c", "1")], "path string, hash string").write.parquet(str(tmp_path / "in"))
    got = {}
    q = watch.change_stream(spark, str(tmp_path / "in"), indexed, lambda df, i: got.update({r.path: r.status for r in df.collect()}), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert got == {"a": "changed", "b": "deleted", "c": "new"}


def test_rendering(spark, tmp_path):
    nodes = spark.createDataFrame([("m.a",), ("m.b",)], "qualified_name string")
    edges = spark.createDataFrame([("m.a", "m.b", "calls"), ("m.b", "m.a", "calls"), ("m.a", "z", "calls")], "src string, dst string, relation_type string")
    text = report.mermaid(nodes, edges)
    assert "m_a --> m_b" in text and "z" not in text.replace("graph", "")
    assert report.tree(edges, "m.a").splitlines()[0] == "m.a" and "(seen)" in report.tree(edges, "m.a")
    path = report.write_graph_html(nodes, edges, "m.a/<x>", str(tmp_path))
    assert path.endswith("graph_m.a__x_.html") and "m.b" in open(path).read()
    assert graph.counts(nodes, edges).first().edges == 3


def test_git_and_cases(spark, tmp_path):
    assert fs.changed_files_since(spark, str(tmp_path)).count() == 0
    p = tmp_path / "cases.json"
    p.write_text('[{"case_id": "1", "type": "Code Query", "query": "q", "expected_files": ["a.py"], "expected_functions": ["f"]}]')
    assert fs.read_cases(spark, str(p)).first().expected_files == ["a.py"]
    (tmp_path / "t.txt").write_text("x\nlast line \n\n")
    assert fs.read_traces(spark, str(tmp_path / "t.txt")).first().query == "last line"
