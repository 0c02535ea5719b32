from loreline import api
from loreline.plans import evaluation
from loreline.plans.query_service import QueryService
from loreline.schemas import CASES


def test_tools(spark, tmp_path):
    root, store = tmp_path / "p", str(tmp_path / "ix")
    root.mkdir()
    (root / "a.py").write_text("def alpha(x):\n    return beta(x)\n\n\ndef beta(x):\n    return x\n")
    (root / "b.py").write_text("class Gamma:\n    def run(self):\n        return 1\n")
    assert api.index_repository(spark, str(root), store).symbols == 4
    assert api.refresh_index(spark, str(root), store) is None
    assert api.validate_index_freshness(spark, str(root), store).first().freshness == "current"
    hashes = QueryService(spark, store).snapshot().first().file_hashes
    assert {r.status for r in api.validate_evidence(spark, str(root), store, hashes).collect()} == {"valid"}
    assert api.search_symbols(spark, store, "alpha", 3, str(root)).first().symbol == "a.alpha"
    assert "return beta" in api.get_symbol_source(spark, str(root), store, "a.alpha").first().source
    assert [r.qualified_name for r in api.expand_symbol_relations(spark, store, "a.beta", "callers").collect()] == ["a.alpha"]
    trace = f'Traceback (most recent call last):\n  File "{root}/a.py", line 6, in beta\n    return x\nValueError: v'
    assert api.find_failure_evidence(spark, str(root), store, trace).first().qualified_name == "a.beta"
    assert api.run_diagnosis(spark, str(root), store, trace).first().error_type == "ValueError"
    cases = spark.createDataFrame([("1", "Code Query", "alpha", ["a.py"], ["alpha"]), ("2", "Code Query", "Gamma run", ["b.py"], ["run"])], CASES)
    got = {r.mode: r for r in evaluation.compare_modes(QueryService(spark, store), cases, ("keyword_only", "full")).collect()}
    assert got["full"].top1_rate == 1.0 and got["full"].function_rate == 1.0 and got["full"].mean_seconds > 0
    assert evaluation.keyword_batch(QueryService(spark, store).symbols(), cases).filter("case_id = '1' and rank = 1").first().name == "alpha"


def test_roots():
    assert api.inside_roots("/a/b/c.py", ["/a/b"]) and not api.inside_roots("/a/bc", ["/a/b"]) and not api.inside_roots("/a/b/../c", ["/a/b"])
