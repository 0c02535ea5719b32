"""Refresh by deltas: equal to a full build, and written only where something changed; commits of several jobs."""

import random

import pytest

from loreline.errors import CommitConflict
from loreline.operators import delta
from loreline.options import IndexOptions
from loreline.plans import index_job
from loreline.schemas import TABLES
from loreline.sources.shared import Scratch
from loreline.sources.store import IndexStore

NAMES = "name string, qname string, path string, pos int, type string, symbol_id long"
CALLS = "path string, pos int, target string, call_type string, caller_class string, caller_qname string, line_number int"


def rows(snapshot, table):
    return sorted(map(str, snapshot.read(table).collect()))


def same(spark, store, other):
    a, b = IndexStore(spark, store).at(), IndexStore(spark, other).at()
    for table in TABLES:
        if table != "listing":  # has times
            assert rows(a, table) == rows(b, table), table
    stats = lambda s: {k: v for k, v in s.commit.stats.items() if k != "parsed"}
    assert stats(a) == stats(b) and a.commit.checksum == b.commit.checksum


@pytest.mark.parametrize("seed", [1, 2])
def test_maintained_calls_are_those_of_a_full_resolution(spark, seed):
    r = random.Random(seed)
    short = [f"n{k}" for k in range(12)]

    def state(files):
        names, calls = [], []
        for f, s in files.items():
            q = random.Random(s)
            for pos in range(q.randint(0, 3)):
                n = q.choice(short)
                names.append((n, f"{f}.{q.choice(['K', 'L'])}.{n}", f, pos, "method", hash((f, s, pos, n)) % 10**9))
            for pos in range(q.randint(0, 4)):
                t = q.choice([*short, "gone", f"K.{q.choice(short)}"])
                calls.append((f, pos, t, q.choice(["self", "direct", "method"]), q.choice([None, f"{f}.K"]), q.choice([None, f"{f}.K.{q.choice(short)}"]), pos + 1))
        return names, calls

    before = {f"m{k}": r.random() for k in range(25)}
    after = {f: (r.random() if r.random() < 0.1 else s) for f, s in before.items() if r.random() < 0.95} | {"new": r.random()}
    touched = {f for f in before.keys() | after.keys() if before.get(f) != after.get(f)}
    (n1, c1), (n2, c2) = state(before), state(after)
    n1, n2 = spark.createDataFrame(n1, NAMES), spark.createDataFrame(n2, NAMES)
    gone = spark.createDataFrame([(f,) for f in touched], "path string")
    fresh = spark.createDataFrame([c for c in c2 if c[0] in touched], CALLS)
    got = delta.maintain_calls(delta.resolve_calls(spark.createDataFrame(c1, CALLS), n1), gone, fresh, n2, delta.changed_names(n1, n2)).collect()
    want = delta.resolve_calls(spark.createDataFrame(c2, CALLS), n2).collect()
    assert sorted(str(tuple(x)[:-1]) for x in got) == sorted(str(tuple(x)) for x in want)
    assert 0 < sum(x.again for x in got) < len(got)


def code(k, names, r):
    """A file that defines some names and uses others."""
    own, used = r.sample(names, 2), r.sample(names, 3)
    return (f"from m{r.randrange(40)} import {used[0]}\nimport m{r.randrange(40)}\n\n\nclass {own[0].title()}({used[1].title()}):\n    def {own[1]}(self, x: int) -> int:\n        self.{used[2]}(x)\n        return {used[0]}(x)\n\n\n"
            f"def {own[0]}(y):\n    z = {used[1].title()}()\n    return z.{own[1]}(y)\n" + ("def half(:\n" if k % 11 == 0 else ""))


def test_refreshes_equal_a_full_build_and_write_what_they_touch(spark, tmp_path):
    r = random.Random(4)
    names = [f"name{k}" for k in range(30)]
    root = tmp_path / "p"
    (root / "sub").mkdir(parents=True)
    for k in range(40):
        (root / f"m{k}.py").write_text(code(k, names, r))
    store = str(tmp_path / "ix")
    assert index_job.index_directory(spark, str(root), store).files == 40
    # a change that no other file mentions
    (root / "m3.py").write_text((root / "m3.py").read_text() + "\n\ndef quite_new(a):\n    return a\n")
    assert index_job.refresh_if_stale(spark, str(root), store).version == 2
    touched = {t: {p.split("bucket=")[1] for p in b.values() if p.startswith("v=2/")} for t, b in IndexStore(spark, store).at().commit.tables.items()}
    assert all(len(touched[t]) == 1 for t in ("parsed", "files", "names", "symbols", "resolved", "calls", "bm25_postings", "mentions")) and len(touched["edges"]) <= 8
    # names that others mention go, come, and move; a class is defined twice
    for k in (5, 9):
        (root / f"m{k}.py").write_text(code(k, names, r))
    (root / "m7.py").unlink()
    (root / "m8.py").write_text("\n\n" + (root / "m8.py").read_text())
    (root / "m12").mkdir()
    (root / "m12" / "__init__.py").write_text((root / "m12.py").read_text() + "\n")
    assert index_job.refresh_if_stale(spark, str(root), store).version == 3
    # deletion without a scan
    ix = IndexStore(spark, store)
    index_job.delete_paths(spark, store, spark.createDataFrame([("m1.py",), ("unknown.py",)], "path string"))
    (root / "m1.py").unlink()
    index_job.index_directory(spark, str(root), str(tmp_path / "full"))
    same(spark, store, str(tmp_path / "full"))
    # old versions stay readable until they are removed
    assert ix.at(1).read("files").count() == 40 and ix.versions() == [1, 2, 3, 4]
    assert ix.delete_all("calls") == 5 and ix.read("calls").count() == 0 and ix.read("inherits").count() > 0
    some = ("files", "edges", "resolved", "bm25_postings")
    before = {t: rows(ix.at(4), t) for t in some}
    assert ix.vacuum(keep=2) > 0 and ix.versions() == [4, 5]
    assert before == {t: rows(ix.at(4), t) for t in some}


def test_of_two_writers_one_starts_again(spark, tmp_path, monkeypatch):
    root, store = tmp_path / "p", str(tmp_path / "ix")
    root.mkdir()
    for k in range(3):
        (root / f"m{k}.py").write_text(f"def f{k}():\n    return f{(k + 1) % 3}()\n")
    index_job.index_directory(spark, str(root), store)
    ix = IndexStore(spark, store)
    base = ix.at()
    content = spark.createDataFrame([("other.py", bytearray(b"def g():\n    return f0()\n"), 24)], "path string, content binary, size_bytes long")
    # a second job commits while the first one works
    nothing = {"errors": (spark.createDataFrame([("x.py", "e", 0)], "path string, error string, bucket int"), None)}
    assert ix.commit(base, nothing, lambda made: {"errors": made.read("errors").count()}) == 2 and ix.get_stat("errors") == 1
    with pytest.raises(CommitConflict):
        ix.commit(base, nothing, lambda made: {})
    assert ix.versions() == [1, 2] and len(ix._names("v=2", "errors")) == 1
    # through the job itself: the first attempt meets a commit of another job between its reading and its own commit
    apply, calls = index_job.apply, []

    def disturbed(*args):
        calls.append(args[1].version)
        if len(calls) == 1:
            with Scratch() as keep:
                apply(IndexStore(spark, store), IndexStore(spark, store).at(), content.replace("other.py", "third.py", "path"), content.replace("other.py", "third.py", "path").select("path"), keep)
        return apply(*args)

    monkeypatch.setattr(index_job, "apply", disturbed)
    (root / "m1.py").write_text("def f1():\n    return 1\n")
    done = index_job.index_directory(spark, str(root), store, IndexOptions(incremental=True))
    assert calls == [2, 3] and done.version == 4 and ix.versions() == [1, 2, 3, 4]
    assert sorted(x.path for x in ix.read("files").collect()) == ["m0.py", "m1.py", "m2.py"]


def test_an_unchanged_tree_reads_no_content(spark, tmp_path, monkeypatch):
    import os
    import time

    from loreline.sources import files as fs

    root, store = tmp_path / "p", str(tmp_path / "ix")
    (root / "pkg").mkdir(parents=True)
    for name in ("pkg/__init__.py", "a.py", "b.py"):
        (root / name).write_text(f"def f_{len(name)}():\n    return 1\n")
        os.utime(root / name, (time.time() - 60, time.time() - 60))
    assert index_job.index_directory(spark, str(root), store).files == 3
    read = []
    by_name = fs.read_files
    monkeypatch.setattr(fs, "scan_tree", lambda *a: pytest.fail("the whole tree was read"))
    monkeypatch.setattr(fs, "read_files", lambda s, r, paths: read.append(sorted(paths)) or by_name(s, r, paths))
    assert index_job.refresh_if_stale(spark, str(root), store) is None and read == [[]]
    os.utime(root / "a.py", (time.time() - 30, time.time() - 30))  # another time, the same text
    assert index_job.refresh_if_stale(spark, str(root), store) is None and read[1:] == [["a.py"]]
    (root / "b.py").write_text("def g():\n    return 22\n")
    waits = IndexOptions(incremental=True, settle_s=3600)
    assert index_job.index_directory(spark, str(root), store, waits).version == 1  # b is still being written
    done = index_job.refresh_if_stale(spark, str(root), store)
    assert done.version == 2 and set(read[-1]) >= {"b.py"} and "pkg/__init__.py" not in read[-1]
    assert IndexStore(spark, store).read("symbols").filter("name = 'g'").count() == 1


def test_a_commit_file_is_created_once(spark, tmp_path):
    ix = IndexStore(spark, str(tmp_path / "a b"))
    assert ix._create("one", "log", "x.json") and not ix._create("two", "log", "x.json")
    assert ix._text("log", "x.json") == "one" and ix._names("log") == ["x.json"] and ix.version() == 0
