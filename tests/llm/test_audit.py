"""Fill-in-middle and the source divergence audit against plain versions."""

import hashlib
import random
import re

import numpy as np
import pytest

from loreline.llm import divergence as dv
from loreline.llm.divergence import source_divergence
from loreline.llm.fill_middle import BLOCK, CODE_POINT, TOGETHER, fill_in_middle, restored, splitter, units

DOCS = "doc_id long, text string, lang string, source string"


def plain_cut(i, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k:8 * k + 8], 16) for k in range(4))
    n = len(text)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return (i, n, "plain", None, None, text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if h4 % 100 < 20:
        return (i, n, "spm", a, b - a, "<S>" + text[b:] + "<P>" + text[:a] + "<M>" + text[a:b])
    return (i, n, "psm", a, b - a, "<P>" + text[:a] + "<S>" + text[b:] + "<M>" + text[a:b])


def test_fill_in_middle_against_a_plain_version(spark):
    r = random.Random(5)
    odd = ["a", "é", "\n", "\r", "́", "🤦", "🏼", "‍", "<", ">", "P", "S", "M", "\x00", " ", "ß"]
    docs = [(i, "".join(r.choice(odd[:9] + odd[11:]) for _ in range(r.randint(0, 40)))) for i in range(120)]
    docs += [(200 + i, "".join(r.choice(odd) for _ in range(30))) for i in range(60)]
    docs += [(300, None), (301, ""), (None, "no id at all"), (302, "a <S> b"), (7, "again"), (7, "again"), (303, "long " * 60_000), (304, "é" * 1025), (305, "<" * 50), (306, "<P" * 30)]
    got = fill_in_middle(spark.createDataFrame(docs, "doc_id long, text string")).withColumn("back", restored()).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[-1])
    assert sorted((tuple(x)[:6] for x in got), key=key) == sorted((plain_cut(*d) for d in docs), key=key)
    texts = {(i, t or "") for i, t in docs}
    assert {(x.doc_id, x.back) for x in got} == texts
    assert {x.form for x in got} == {"plain", "psm", "spm"}


def test_fill_in_middle_by_other_units_columns_and_no_rows(spark):
    starts = splitter(r"\s*\S+")("ein  zwei\ndrei")
    assert starts.tolist() == [0, 3, 9] and splitter()("x" * 1500).tolist() == list(range(1500)) and CODE_POINT
    docs = spark.createDataFrame([(1, "alpha beta gamma delta", 5, "x"), (2, "eins zwei drei", 6, "y")], "doc_id long, text string, n long, `a.b` string")
    renamed = docs.withColumnRenamed("n", "output_n")
    got = fill_in_middle(renamed, unit=r"\s*\S+", plain_from=100, keep=("output_n", "a.b")).withColumn("back", restored()).collect()
    assert sorted((x.doc_id, x.n, x["output_n"], x["a.b"], x.back) for x in got) == [(1, 4, 5, "x", "alpha beta gamma delta"), (2, 3, 6, "y", "eins zwei drei")]
    assert fill_in_middle(docs).count() == 2  # a column of the input with a clashing name
    assert fill_in_middle(docs.limit(0)).collect() == []


def test_units_give_every_start_without_listing_them():
    of = units()
    for text in ("", "é\r\n🤦🏼x", "a" * BLOCK, "éb\n" * (2 * BLOCK)):
        n, start = of(text)
        assert n == len(text) and [start(k) for k in range(n + 1)] == list(range(n + 1))
    n, start = of("ab\n" * (TOGETHER * BLOCK // 2))  # blocks of more than one call
    assert n == 3 * (TOGETHER * BLOCK // 2) and [start(k) for k in (0, n // 2, n - 1, n)] == [0, n // 2, n - 1, n]
    text = "ein  zwei\ndrei "
    n, start = units(r"\s*\S+")(text)
    assert [start(k) for k in range(n)] == splitter(r"\s*\S+")(text).tolist() == [0, 3, 9, 14] and start(n) == len(text)


def plain_divergence(docs, least=3, top=200):
    rows = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for _, text, lang, source in docs]
    out = []
    for lang in {x[0] for x in rows}:
        own = [(s, w) for g, s, w in rows if g == lang]
        words = {t for _, w in own for t in w}
        kept = {t for t in words if sum(t in w for _, w in own) >= least}
        v = len(kept)
        sources = {s for s, _ in own}
        count = {s: {t: sum(w.count(t) for z, w in own if z == s) for t in kept} for s in sources}
        whole = {t: sum(count[s][t] for s in sources) for t in kept}
        p = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + v) for t in kept}
        ps, q = {s: p(count[s]) for s in sources}, p(whole)
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pair = sorted(((-sum(f(ps[s][t], ps[z][t]) for t in kept), z.encode(), z) for z in sources if z != s))
            out += [(lang, s, "pair", z, -x, k + 1) for k, (x, _, z) in enumerate(pair)]
            term = sorted((-f(ps[s][t], q[t]), t.encode(), t) for t in kept if count[s][t] > 0 and ps[s][t] > q[t])
            out += [(lang, s, "term", t, -x, k + 1) for k, (x, _, t) in enumerate(term[:top])]
    return out


@pytest.mark.parametrize("seed,cell,top", [(1, (50_000, 2_000_000), 200), (2, (7, 20), 3)])
def test_divergence_against_a_plain_version(spark, seed, cell, top, monkeypatch):
    monkeypatch.setattr(dv, "CELL", cell)
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcXYZéß日") for _ in range(r.randint(1, 3))) for _ in range(50)]
    docs = [(i, r.choice([" ", "1", "_", "\x7f", "\n"]).join(r.choice(vocab) for _ in range(r.randint(0, 30))), r.choice(["en", "en", "de"]), f"s{min(r.randint(0, 9), 5)}") for i in range(90)]
    docs += [(1, "same words here", "en", "s1")] * 3 + [(None, None, None, None), (5, "", "fr", "s1"), (6, "rare words", "fr", "s2"), (7, None, "en", "empty"), (8, "alone alone", "xx", "s9"), (9, "word " * 20_000, "de", "s3"), (10, "3 4 5 -- !", "en", "é")]
    got = [tuple(x) for x in source_divergence(spark.createDataFrame(docs, DOCS), top=top).collect()]
    assert sorted(got) == sorted(plain_divergence(docs, top=top))


def test_divergence_of_nothing_and_exact_shares(spark):
    docs = spark.createDataFrame([], DOCS)
    assert source_divergence(docs).collect() == []
    clash = spark.createDataFrame([(1, "one two", "en", "a", 1, "x"), (2, "one two", "en", "b", 2, "y"), (3, "one", "en", "b", 3, "z")], "n long, text string, lang string, source string, term long, vec string")
    assert {(x.source, x.part, x.item) for x in source_divergence(clash).collect()} == {("a", "pair", "b"), ("b", "pair", "a")}  # the one kept term has p = q
    count, total = np.array([0, 1, 12345, 9 * 10**14]), np.array([3, 2, 99_999, 9 * 10**15 // 4])
    assert dv.share(count, total).tolist() == [1 + 10**9 * (int(c) + 1) // int(n) for c, n in zip(count, total)]
    assert dv.divergence(np.array([10**9 + 1]), np.array([1])).tolist() == [10**18]
