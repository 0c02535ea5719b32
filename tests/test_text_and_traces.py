from pyspark.sql import functions as F

from loreline.functions import text as fx
from loreline.functions import trace as tr


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def test_tokenizers(spark):
    r = one(spark, a=fx.bm25_tokens(F.lit("Foo_bar.baz  Qux")), b=F.array_sort(fx.code_tokens(F.lit("find parseFile in src/ast_parser.py!"))), c=fx.code_tokens(F.lit(None).cast("string")))
    assert r.a == ["foo", "bar", "baz", "qux"]
    assert {"parse", "file", "parsefile", "src", "ast", "parser", "py", "src/ast_parser.py"} <= set(r.b)
    assert r.c == []


def test_unicode_words_do_not_split(spark):
    assert "naïveécole" in one(spark, a=fx.code_tokens(F.lit("naïveÉcole"))).a


def test_paths(spark):
    r = one(spark, a=fx.normalize_path(F.lit(".\\./Src\\A.py")), b=fx.path_to_module(F.lit("/r/pkg/__init__.py"), F.lit("/r")), c=fx.normalize_symbol(F.lit("A.b.C")), d=fx.basename(F.lit("x\\y/z.py")))
    assert r.a in ("src/a.py", "././src/a.py"[4:]) and r.b == "pkg" and r.c == "c" and r.d == "z.py"


def test_overlap_and_suggestions(spark):
    q, d = F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"))
    empty = F.array().cast("array<string>")
    r = one(spark, a=fx.token_overlap(q, d), b=fx.token_overlap(empty, d))
    assert r.a == 0.5 and r.b == 0.0
    words = spark.createDataFrame([("/indx",), ("indx",), ("/zzzzzzzz",)], "w string")
    assert [x.suggestion for x in fx.suggestions(words, F.col("w"), ["/index", "/query"]).collect()] == ["/index", None, None]


PY = 'Traceback (most recent call last):\n  File "src/app.py", line 8, in run\n    load_user()\n  File "src/db.py", line 12, in load_user\n    raise ValueError("missing")\nValueError: missing'


def test_strict_python(spark):
    f = one(spark, f=tr.parse_failure(F.lit(PY))).f
    assert [x.function_name for x in f.frames] == ["run", "load_user"] and f.frames[-1].line_number == 12
    assert f.exceptions[-1].type == "ValueError" and f.exceptions[-1].message == "missing" and f.frames[0].code_line == "load_user()"


def test_chained(spark):
    text = 'Traceback (most recent call last):\n  File "a.py", line 1, in f\nKeyError: k\n\nThe above exception was the direct cause of the following exception:\n\nTraceback (most recent call last):\n  File "b.py", line 2, in g\nRuntimeError: boom'
    f = one(spark, f=tr.parse_failure(F.lit(text))).f
    assert [e.type for e in f.exceptions] == ["KeyError", "RuntimeError"] and f.chain_markers == ["direct_cause"]


def test_pytest_failure(spark):
    text = "    def test_math():\n>       assert 3 == 4\nE       assert 3 == 4\n\ntests/test_math.py:8: AssertionError"
    f = one(spark, f=tr.parse_failure(F.lit(text))).f
    assert f.frames[0].file_path == "tests/test_math.py" and f.frames[0].line_number == 8 and f.frames[0].function_name == "<pytest>"
    assert f.exceptions[0].type == "AssertionError" and f.exceptions[0].message == "assert 3 == 4" and f.frames[0].code_line == "assert 3 == 4"


def test_informal_report(spark):
    r = one(spark, f=tr.loose_frames(F.lit("FileNotFoundError: no file in ast_parser.py at line 45 inside parse_file")), e=tr.loose_error(F.lit("FileNotFoundError: no file in ast_parser.py at line 45 inside parse_file")), n=tr.parse_failure(F.lit("hello")), t=tr.is_stack_trace(F.lit(None).cast("string")))
    assert (r.f[0].file_path, r.f[0].line_number, r.f[0].function_name) == ("ast_parser.py", 45, "parse_file")
    assert r.e.error_type == "FileNotFoundError" and r.e.error_message == "no file" and r.n is None and r.t is False


def test_dotted_frames(spark):
    r = one(spark, f=tr.loose_frames(F.lit("boom\n at pkg.mod.run(src/mod.py:7)")))
    assert (r.f[0].file_path, r.f[0].line_number, r.f[0].function_name) == ("src/mod.py", 7, "run")
