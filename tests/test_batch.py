"""All modes for a table of queries at once: the results of one search a query."""

import random

import pytest
from loreline.operators import batch, bm25, retrieval
from loreline.plans import evaluation, index_job
from loreline.plans.query_service import QueryService
from loreline.schemas import CASES

SYMBOLS = "symbol_id long, name string, qualified_name string, type string, file_path string, start_line int, end_line int, docstring string, signature string"
TRACE = 'Traceback (most recent call last):\n  File "src/m1.py", line 5, in load_user\n    x\n  File "lib/m2.py", line 9, in parse_row\n    y\nValueError: bad row in table'


def table(spark):
    r = random.Random(3)
    words = ["load", "user", "parse", "row", "save", "table", "check", "index"]
    rows = []
    for k in range(120):
        name = f"{r.choice(words)}_{r.choice(words)}" if k % 7 else r.choice(words).title()
        path = f"{r.choice(['src', 'lib', 'tests'])}/m{k % 9}.py" if k % 31 else None
        rows.append((k, name, f"pkg.m{k % 9}.{name}", "function", path, k % 40 + 1, k % 40 + 9, r.choice([None, "Loads a row of the table", "checks users"]), f"def {name}(x)"))
    edges = {(rows[r.randrange(120)][2], rows[r.randrange(120)][2]) for _ in range(150)}
    imports = {(f"src/m{r.randrange(9)}.py", r.choice(["m3", "M4", "pkg.m5"]), r.randrange(9)) for _ in range(12)}
    return spark.createDataFrame(rows, SYMBOLS), spark.createDataFrame([(a, b, "calls") for a, b in edges], "src string, dst string, relation_type string"), spark.createDataFrame(list(imports), "path string, module_path string, line_number int")


QUERIES = ["load user", "parse_row", "Row", "user", "ab", "x", "", "nothing like it", "m3.py check index", TRACE]


@pytest.mark.parametrize("mode", ["keyword_only", "symbol_only", "hybrid", "full"])
def test_a_batch_answers_like_single_queries(spark, mode):
    symbols, edges, imports = table(spark)
    asked = spark.createDataFrame([(f"q{k}", q) for k, q in enumerate(QUERIES)], "query_id string, query string")
    index = bm25.build_index(symbols.select("symbol_id", retrieval.index_text().alias("text")), "symbol_id")
    sides = dict(edges=edges, imports=imports) if mode in ("hybrid", "full") else {}
    got = {}
    for x in batch.retrieve(symbols, asked, 4, mode, index=index, **sides).collect():
        got.setdefault(x.query_id, []).append((x["rank"], x.norm_path, round(x.score, 6), x.best, x.members))
    single = {"symbol_only": range(len(QUERIES)), "keyword_only": (0, 4, 9), "hybrid": (9,), "full": (0, 9)}[mode]  # a plan each
    for k in single:
        q = QUERIES[k]
        want = [(n + 1, x.norm_path, round(x.score, 6), x.best, x.members) for n, x in enumerate(retrieval.retrieve(symbols, q, 4, mode, index=index, **sides).collect())]
        assert sorted(got.get(f"q{k}", [])) == want, (mode, q)


def test_substring_search_by_trigrams(spark):
    r = random.Random(5)
    rows = [(k, "".join(r.choice("abAB_é") for _ in range(r.randint(0, 9))), "".join(r.choice("ab%.") for _ in range(r.randint(0, 9))) if k % 5 else None) for k in range(150)]
    df = spark.createDataFrame(rows, "symbol_id long, name string, qualified_name string")
    asked = [(k, "".join(r.choice("abB%_é") for _ in range(r.randint(1, 5)))) for k in range(60)]
    got = {}
    for x in batch.like_search(df, spark.createDataFrame(asked, "query_id int, query string"), 7).collect():
        got.setdefault(x.query_id, []).append((x.at, x.symbol_id))
    for k, q in asked:
        want = [i for i, a, b in rows if q.lower() in a.lower() or q.lower() in (b or "").lower()][:7]
        assert sorted(got.get(k, [])) == [(n + 1, i) for n, i in enumerate(want)], q


def test_cases_in_one_plan_and_apart(spark, tmp_path):
    root, store = tmp_path / "p", str(tmp_path / "ix")
    root.mkdir()
    for k in range(6):
        (root / f"m{k}.py").write_text(f"import m{(k + 1) % 6}\n\n\nclass Part{k}:\n    def load_{k}(self):\n        return helper_{(k + 1) % 6}(1)\n\n\ndef helper_{k}(x):\n    '''Helps part {k}.'''\n    return x\n")
    index_job.index_directory(spark, str(root), store)
    service = QueryService(spark, store)
    cases = spark.createDataFrame([("1", "Code Query", "load_2", ["m2.py"], ["load_2"]), ("2", "Code Query", "helps part 3", ["m3.py"], ["helper_3"]), ("3", "Stack Trace", 'Traceback (most recent call last):\n  File "m4.py", line 6, in load_4\n    x\nValueError: y', ["m4.py"], ["Part4.load_4"])], CASES)
    plain = lambda rows: sorted(map(str, rows.drop("seconds").collect()))
    two = cases.filter("case_id <> '1'")
    assert plain(evaluation.run_cases(service, two, "keyword_only")) == plain(evaluation.run_cases_apart(service, two, "keyword_only"))
    got = {r.mode: r for r in evaluation.compare_modes(service, cases, ("symbol_only", "full")).collect()}
    assert len(got) == 2 and got["full"].cases == 3 and got["full"].top1_rate == 1.0 and all(r.mean_seconds > 0 for r in got.values())


def test_frames_in_one_file_of_very_many_spans(spark):
    from loreline.operators import evidence

    r = random.Random(8)
    spans = [("hot.py", k, a := r.randrange(200_000), a + r.choice([0, 1, 2, 3, 7, 8, 30, 31, 400])) for k in range(20_000)]
    spans += [("hot.py", 20_000, 1, 250_000), ("hot.py", 20_001, 9, 8), ("hot.py", 20_002, None, 5), ("b.py", 30_000, 5, 5), ("c.py", 30_001, 0, 2**31 - 2)]
    frames = [(t, 0, "hot.py", r.randrange(200_400)) for t in range(400)] + [(900, 1, "b.py", 5), (901, 0, "b.py", 6), (902, 0, "gone.py", 1), (903, 0, "c.py", 7), (904, 0, "hot.py", None)]
    got = evidence.frame_ranges(spark.createDataFrame(frames, "trace_id long, frame int, file_path string, line_number int"), spark.createDataFrame(spans, "file_path string, symbol_id long, start_line int, end_line int"))
    want = []
    for t, f, p, line in frames:
        hit = sorted((b - a, i) for q, i, a, b in spans if q == p and None not in (a, b, line) and a <= line <= b)
        want += [(t, f, i, n + 1) for n, (_, i) in enumerate(hit)]
    assert sorted((x.trace_id, x.frame, x.symbol_id, x["rank"]) for x in got.collect()) == sorted(want) and len(want) > 2000
