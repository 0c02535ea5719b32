import random

import os
import sys

sys.path.insert(0, os.path.dirname(__file__))
import brute
import numpy as np
import pyarrow as pa

from loreline.llm import decontam, html_extract, license_scan, quality
from loreline.llm.mixing import fit_rates, mix_sources, rate_of
from loreline.llm.topk import top_k
from loreline.llm.toxicity import score_toxicity


def test_topk_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr("loreline.llm.topk.QUERY_BLOCK", 3)
    monkeypatch.setattr("loreline.llm.topk.ROWS", 16)
    r = random.Random(1)
    rows = [(i, [r.choice([-1.0, 0.5, 0.25, r.random()]) for _ in range(6)]) for i in range(400)]
    rows += [(1000, None), (1001, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (1050, [float("nan")] * 6), (1002, [float("inf")] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    from pyspark.sql import functions as F

    rows32 = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert sorted(tuple(x) for x in top_k(df, F.col("vec_id") % 50 == 0).collect()) == sorted(brute.top_k(rows32))
    few = df.filter("vec_id in (0, 1, 2)")
    assert top_k(few, F.col("vec_id") % 50 == 0).count() == 2 and top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_topk_takes_every_row_as_a_candidate(spark, monkeypatch):
    """Copies, ties, repeated ids with different vectors, a query id with several rows, and several lengths: as the query's SQL says."""
    from pyspark.sql import functions as F

    monkeypatch.setattr("loreline.llm.topk.QUERY_BLOCK", 2)
    r = random.Random(12)
    rows = [(i, [float(r.randint(-8, 8)) for _ in range(6)]) for i in range(120)]
    for i in (1, 2, 3, 60):
        rows += [(i, [9.0 if j % 3 == c % 3 else 8.0 for j in range(6)]) for c in range(9)]
    rows += [(0, [float(r.randint(-8, 8)) for _ in range(6)])] + [rows[50]] * 3 + [rows[7]] * 8
    rows += [(i, [float(r.randint(-8, 8)) for _ in range(3)]) for i in range(140, 160)] + [(200, [1.0])]
    want = []
    for q in sorted({i for i, _ in rows if i % 50 == 0}):
        pairs = [(-sum(int(256 * x) * int(256 * y) for x, y in zip(a, v)), j) for i, a in rows if i == q for j, v in rows if j != q and len(v) == len(a)]
        want += [(q, n + 1, j, -s) for n, (s, j) in enumerate(sorted(pairs)[:5])]
    assert {w[0] for w in want} == {0, 50, 100, 150}
    for piece, parts in ((1024, 1), (16, 3), (7, 1)):
        monkeypatch.setattr("loreline.llm.topk.ROWS", piece)
        monkeypatch.setattr("loreline.llm.topk.CHUNK_BYTES", 48 * piece)
        df = spark.createDataFrame(r.sample(rows, len(rows)), "vec_id long, embedding array<float>").repartition(parts)
        assert sorted(tuple(x) for x in top_k(df.withColumn("row", F.lit(1)), F.col("vec_id") % 50 == 0).collect()) == want


def test_decontamination(spark):
    r = random.Random(2)
    item = [f"item{k}" for k in range(30)]
    filler = lambda n: [f"f{r.randrange(5000)}" for _ in range(n)]
    near = list(item)
    near[0] = "other"
    half = item[:12] + filler(18)
    docs = [(1, " ".join(filler(50) + item + filler(50))), (2, " ".join(filler(40) + near)), (3, " ".join(filler(20) + half + filler(9))), (4, None), (5, ""), (None, " ".join(item)), (6, " ".join(filler(3000))), (7, "tiny text")]
    items = spark.createDataFrame([(9, " ".join(item)), (9, " ".join(item)), (10, None), (11, ""), (12, "tiny text")], "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontam.find_contamination(df, items).collect()}
    assert got == {(1, 9), (2, 9), (None, 9), (7, 12)}
    assert sorted(x.doc_id for x in decontam.drop_contaminated(df, items).collect()) == [3, 4, 5, 6]
    assert decontam.find_contamination(df.limit(0), items).count() == decontam.find_contamination(df, items.limit(0)).count() == 0


def test_decontamination_is_the_same_in_any_blocks(spark, monkeypatch):
    """Items share phrases, so that weights and windows of one come from others; texts hold them changed, near the threshold."""
    r = random.Random(11)
    phrases = [" ".join(f"p{k}w{j}" for j in range(8)) for k in range(4)]
    items = [(k, " ".join(f"i{k}w{j}" for j in range(r.randint(4, 14))) + " " + " ".join(r.sample(phrases, r.randint(1, 3)))) for k in range(24)]
    items += [(3, items[3][1]), (50, items[5][1] + " and more words")]
    docs = []
    for i in range(300):
        w = r.choice(items)[1].split()
        for _ in range(r.randint(0, 3)):
            w[r.choice([0, 1, len(w) - 1, r.randrange(len(w))])] = f"x{i}"
        docs.append((i, " ".join(["start"] * r.randint(0, 9) + w + r.choice(phrases).split()[:r.randint(0, 8)])))
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = lambda: sorted((x.doc_id, x.item_id, round(x.similarity, 9), x.start_word, x.n_words, x.distance) for x in decontam.find_contamination(df, bench).collect())
    left = lambda: sorted(x.doc_id for x in decontam.drop_contaminated(df, bench).collect())
    one, kept = found(), left()
    assert 0 < len({x[0] for x in one}) < 300 and len(kept) == 300 - len({x[0] for x in one})
    monkeypatch.setattr(decontam, "BLOCK_ITEMS", 3)
    assert found() == one and left() == kept


def test_decontamination_against_every_window(spark):
    """Brute force over all starts and items, with words changed, put in and left out: the same pairs, but for those outside the radius."""
    import math
    from collections import Counter

    r = random.Random(15)
    bag = lambda w: Counter(tuple(w[j:j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else Counter({tuple(w): 1} if w else {})
    phrases = [[f"p{k}w{j}" for j in range(7)] for k in range(5)]
    items = [(k, [f"i{k}w{j}" for j in range(r.randint(6, 40))] + r.choice(phrases)) for k in range(30)] + [(30, ["only", "three", "words"])]
    docs = []
    for i in range(400):
        w = list(r.choice(items)[1])
        for _ in range(r.choice([0, 1, 1, 2, 3])):
            at = r.randrange(len(w) + 1)
            w[at:at + r.choice([0, 1])] = r.choice([[f"x{i}"], [f"x{i}", "y"], []])
        docs.append((i, ["lead"] * r.randint(0, 30) + w + r.choice(phrases)[:r.randint(0, 7)] + ["tail"] * r.randint(0, 9)))
    df = Counter(s for _, w in items for s in bag(w))
    weight = lambda s: 1 + math.log(len(items) / df[s]) if s in df else 1 + math.log(len(items))
    want = set()
    for i, w in docs:
        for k, own in items:
            b = bag(own)
            for at in range(max(1, len(w) - len(own) + 1)):
                a = bag(w[at:at + len(own)])
                low = sum(min(n, a[s]) * weight(s) for s, n in b.items())
                high = sum(max(a[s], b[s]) * weight(s) for s in a.keys() | b.keys())
                if low >= 0.8 * high - 1e-9:
                    want.add((i, k))
                    break
    frame = spark.createDataFrame([(i, " ".join(w), 0) for i, w in docs], "doc_id long, text string, item long")
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontam.find_contamination(frame, bench).collect()}
    assert got <= want and len(got) >= 0.98 * len(want) and 150 < len(want)
    kept = decontam.drop_contaminated(frame, bench)
    assert kept.columns == frame.columns and {x.doc_id for x in kept.collect()} == {i for i, _ in docs} - {i for i, _ in got}


def test_multi_index_finds_all_within_the_radius():
    r = np.random.default_rng(3)
    words = lambda: " ".join(f"w{x}" for x in r.integers(0, 10**6, 20))
    index = decontam.Index(list(range(300)), [words() for _ in range(300)])
    prints = index.print[r.integers(0, 300, 500)] ^ np.array([sum(1 << int(b) for b in r.choice(64, r.integers(0, 24), replace=False)) for _ in range(500)], np.uint64)
    window, item = index.candidates(prints)
    near = np.bitwise_count(prints[:, None] ^ index.print[None, :]) <= index.radius
    assert set(zip(window.tolist(), item.tolist())) == set(zip(*[x.tolist() for x in np.nonzero(near)]))


def test_licenses(spark):
    r = random.Random(4)
    filler = lambda n: " ".join(f"f{r.randrange(900)}" for _ in range(n))
    docs = [(1, f"{filler(33)}\nReleased under the MIT License.\n{filler(20)}"), (2, "Licensed under CC BY-NC 4.0."), (3, filler(500)), (4, None), (5, ""), (6, filler(90) + " " + license_scan.NOTICES[2][1] + " " + filler(7)), (7, "the license of this work is unknown")]
    got = {(x.doc_id, x.license) for x in license_scan.scan_licenses(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {(1, "MIT"), (2, "CC-BY-NC-4.0"), (6, "MIT")}


def test_licenses_against_plain_containment(spark):
    """Whole licenses and notices with words changed, left out and put in: what has 0.8 of a template's shingles is found."""
    import re

    r = random.Random(31)
    plain = lambda t: [w.lower() for w in re.findall(r"[A-Za-z0-9]+", t)]
    pairs = lambda w: {tuple(w[j:j + 2]) for j in range(len(w) - 1)}
    own = [(n, plain(t)) for n, t in license_scan.templates()]
    assert len({n for n, _ in own}) > 15 and max(len(w) for _, w in own) > 5000
    docs, want = [], []
    for i in range(120):
        name, w = own[i % len(own)]
        w = list(w)
        for _ in range(int(len(w) * r.choice([0, 0.01, 0.03, 0.06]))):
            at = r.randrange(len(w))
            w[at:at + r.choice([0, 1])] = r.choice([[], [f"x{r.randrange(999)}"]])
        if len(pairs(w) & pairs(own[i % len(own)][1])) >= 0.8 * len(pairs(own[i % len(own)][1])):
            want.append((i, name))
        docs.append((i, " ".join([f"f{r.randrange(999)}" for _ in range(r.randint(0, 700))] + w + [f"f{r.randrange(999)}" for _ in range(90)])))
    got = {(x.doc_id, x.license) for x in license_scan.scan_licenses(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    missed = [x for x in want if x not in got]
    assert len(want) > 60 and len(missed) <= 0.02 * len(want), missed
    clean = [(i, " ".join(r.choice(plain(license_scan.templates()[-1][1])) for _ in range(400))) for i in range(40)]
    assert license_scan.scan_licenses(spark.createDataFrame(clean, "doc_id long, text string")).count() == 0
    odd = spark.createDataFrame([(None, "Released under the MIT License.", "a"), (1, None, "b"), (2, "Released under the MIT License. " * 20000, "c")], "doc_id long, text string, license string")
    assert sorted((x.doc_id or 0, x.license) for x in license_scan.scan_licenses(odd).collect()) == [(0, "MIT"), (2, "MIT")]


def labelled(n=400):
    r = random.Random(5)
    calm, rude = [f"calm{k}" for k in range(60)], ["vile", "nasty", "rotten"]
    docs, labels = [], []
    for i in range(n):
        w = [r.choice(calm) for _ in range(r.randint(5, 60))]
        toxic = i % 5 == 0
        for _ in range(r.randint(1, 6) if toxic else 0):
            w.insert(r.randrange(len(w)), r.choice(rude))
        good = i % 3 > 0
        docs.append((i, " ".join(w) if good else " ".join(w).upper().replace(" ", "!! "), "x" if i % 2 else "y"))
        labels.append((i, int(good), int(toxic)))
    return docs + [(n, None, None), (n + 1, "", "x")], labels


def test_toxicity_and_quality(spark):
    docs, labels = labelled()
    df = spark.createDataFrame(docs, "doc_id long, text string, severity string")
    lab = spark.createDataFrame([(i, q, t) for i, q, t in labels if i % 4], "doc_id long, quality int, toxic int").union(spark.createDataFrame([(None, None, None)], "doc_id long, quality int, toxic int"))
    got = {x.doc_id: x for x in score_toxicity(df, lab).collect()}
    held = [(i, q, t) for i, q, t in labels if i % 4 == 0]
    assert np.mean([got[i].toxic == bool(t) for i, _, t in held]) > 0.95
    assert all(0 <= x.severity <= 2 and x.grade in (0, 1, 2) for x in got.values()) and not got[401].toxic
    q = {x.doc_id: x for x in quality.score_quality(df, lab).collect()}
    assert np.mean([q[i].predicted == g for i, g, _ in held]) > 0.95 and all(0 <= x.score <= 1 for x in q.values()) and len(q) == 402
    none = lab.limit(0)
    assert {x.severity for x in score_toxicity(df, none).collect()} == {0.0} or max(x.severity for x in score_toxicity(df, none).collect()) < 1e-6
    assert {x.score for x in quality.score_quality(df, none).collect()} == {0.5}
    assert score_toxicity(df.limit(0), lab).count() == quality.score_quality(df.limit(0), lab).count() == 0


def test_severity_follows_given_grades(spark):
    """Labels 0 .. 3 by people: on texts held out, severity orders the grades and its mean error is small; conflicting labels, odd columns."""
    r = random.Random(41)
    calm = [f"calm{k}" for k in range(80)]
    marks = {1: ["silly", "dull"], 2: ["nasty", "rotten"], 3: ["vile", "hateful"]}
    docs = []
    for i in range(900):
        g = r.choice([0, 0, 0, 1, 2, 3])
        w = [r.choice(calm) for _ in range(r.randint(10, 50))]
        for k in range(1, g + 1):
            w.insert(r.randrange(len(w)), r.choice(marks[k]))
        docs.append((i, " ".join(w), g))
    df = spark.createDataFrame(docs, "doc_id long, text string, toxic int")
    lab = spark.createDataFrame([(i, g) for i, _, g in docs if i % 3] + [(1, 0), (2, None), (None, 3)], "doc_id long, toxic int")
    got = {x.doc_id: x for x in score_toxicity(df, lab, grades=4).collect()}
    held = [(g, got[i].severity, got[i].grade) for i, _, g in docs if i % 3 == 0]
    assert np.mean([abs(g - s) for g, s, _ in held]) < 0.35 and np.mean([g == k for g, _, k in held]) > 0.85
    means = [np.mean([s for g, s, _ in held if g == k]) for k in range(4)]
    assert means == sorted(means) and means[3] - means[0] > 2
    assert score_toxicity(df.union(df), lab, grades=4, sample=50).count() == 1800


def test_trees_match_a_plain_walk():
    r = np.random.default_rng(6)
    x = r.normal(size=(500, 4)).astype(np.float32)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    t = quality.grow(x, y, trees=30)

    def walk(row):
        total = t.bias
        for f, th, left, v in zip(t.feature, t.threshold, t.left, t.value):
            at = 0
            while left[at]:
                at = left[at] + int(row[f[at]] > th[at])
            total += v[at]
        return total

    assert np.allclose(t.logit(x), [walk(row) for row in x])
    assert ((t.score(x) > 0.5) == y).mean() > 0.95
    assert quality.statistics(pa.array(["", None, "a"])).shape == (3, len(quality.NAMES))


def test_mixing_meets_targets(spark):
    r = random.Random(7)
    docs = [(i, " ".join(f"{'ab'[i % 3 > 0]}{r.randrange(30)}" for _ in range(r.randint(5, 50))), "ab"[i % 3 > 0]) for i in range(300)] + [(900, None, None), (901, "", "a")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    out = mix_sources(df, df.select("doc_id", "lang").filter("doc_id < 200"), {"a": 3, "b": 1}, keep=("text", "lang")).collect()
    total = sum(x.n_words for x in out)
    share = sum(x.rate * x.n_words * x.posterior[0] for x in out) / total
    assert abs(share - 0.75) < 1e-3 and all(x.rate >= 0 for x in out) and len(out) == 302
    assert np.mean([x.domain == x.lang for x in out if x.n_words]) > 0.95
    assert mix_sources(df.limit(0), df.select("doc_id", "lang"), {"a": 1, "b": 1}).count() == 0
    # projection: a domain with target 0 ends at rate 0, never below
    rows = spark.createDataFrame([(10, [1.0, 0.0]), (30, [0.0, 1.0])], "n_words long, p array<double>")
    moves, have = fit_rates(rows, [0.0, 1.0])
    assert [round(x[0], 3) for x in rows.select(rate_of(moves, 2)).collect()] == [0.0, round(40 / 30, 3)] and have[0] < 1e-5


PAGE = "<html><head><title>t</title><script>var a='<p>no</p>'</script></head><body><nav><li>menu</li></nav><div class='ad'>buy</div>{}<footer>&copy; x</footer></body></html>"


def test_html(spark):
    f = html_extract.blocks_of
    assert f(PAGE.format("<article><h1>T &amp; U</h1><p><b>One\n two<br><p>Three</p><div class='comments'><p>reader</p></div></article>")) == ["T & U", "One two", "Three"]
    assert f(PAGE.format("<p>plain</p><form>f</form><aside>s</aside><!-- <p>c</p> --><div id='cookie-notice'>n</div>")) == ["plain"]
    assert f(None) == f("") == f("<p>") == [] and f("a < b &am") == ["a < b &am"]
    assert f("<article><p>open") == ["open"] and f("<p>x</b>y") == ["xy"]
    pages = [(k, f"http://h.example/a/{k}", f"<p>Site name</p><p>story {k}</p><p>Call us</p>") for k in range(4)] + [(9, None, None), (10, "http://h.example/b", "<article><p>Site name</p><p>Call us</p></article>"), (11, "http://h.example/b", "<article><p>Site name</p><p>Call us</p></article>")]
    got = {x.page_id: x.text for x in html_extract.extract_html(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert {got[k] for k in range(4)} == {f"story {k}" for k in range(4)} and got[9] == "" and got[10] == got[11] == "Site name\nCall us"
    assert html_extract.extract_html(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_neighbours_on_the_host(spark, monkeypatch):
    """One page a lead ('/a-1001', '/b-1001', ...), and more ranges than pages of a host: each page meets the pages beside it."""
    schema = "page_id long, url string, html string"
    monkeypatch.setattr("loreline.llm.html_extract.SAMPLED", 1, raising=False)
    pages = [(100 * h + k, f"http://h{h}.example/{'abcdefgh'[k]}-1001", f"<p>Site {h}</p><p>story {h} {k}</p><p>Call us</p><p>pair {h} {k // 2}</p>") for h in range(5) for k in range(8)]
    pages += [(900, "http://alone.example/x", "<p>Site 0</p><p>Call us</p>"), (None, "http://nulls.example/x", "<p>n</p><p>m</p>"), (901, "http://nulls.example/x", "<p>n</p><p>o</p>")]
    got = {(x.page_id, x.url): x.text for x in html_extract.extract_html(spark.createDataFrame(pages, schema).repartition(5)).collect()}
    assert len(got) == len(pages)
    for h in range(5):
        for k in range(8):
            assert got[100 * h + k, pages[8 * h + k][1]] == f"story {h} {k}"
    assert got[900, "http://alone.example/x"] == "Site 0\nCall us"
    assert got[None, "http://nulls.example/x"] == "m" and got[901, "http://nulls.example/x"] == "o"


def test_html_figures_comments_and_broken_markup(spark):
    import time

    f = html_extract.page_blocks
    assert f("<article><p>One</p><figure><img src=x><figcaption>A caption</figcaption></figure><p>x<math><mi>y</mi></math></p></article><p>out</p>") == (["One", "A caption", "xy"], True)
    assert f("<!-- <article> --><script>'<main>'</script><p>text</p>") == (["text"], False)
    assert f("<p title='a > b'>in</p><p class=\"x>tail</p>") == (["in", "tail"], False)
    began = time.time()
    assert len(f("<p><a href=\"x>" * 20001)[0]) >= 0 and len(f("<div class='" * 30000)[0]) >= 0 and f("<!-- " * 50000) == ([], False)
    long = "".join(f"<p>line {k}</p>" for k in range(30000))
    assert len(f(long)[0]) == 30000 and time.time() - began < 20
    rows = [(k, f"http://h.example/{k}", f"<article><p>Head</p><p>{'word ' * 9}{k}</p></article>", "t") for k in range(3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    text = lambda **o: [x.text for x in html_extract.extract_html(df, **o).orderBy("page_id").collect()]
    assert text() == [f"Head\n{'word ' * 9}{k}" for k in range(3)] and text(difference_marked=True) == [f"{'word ' * 9}{k}" for k in range(3)]


def test_lcs_takes_little_memory():
    import tracemalloc

    r = np.random.default_rng(4)
    x, y = r.integers(0, 3000, 4000), r.integers(0, 3000, 4000)
    tracemalloc.start()
    n = html_extract.shared_lines(x, y).sum()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n > 50 and peak < 4 << 20


def test_lcs_mask():
    a = lambda *x: np.array(x, np.int64)
    assert html_extract.shared_lines(a(1, 2, 3, 4, 5), a(1, 3, 9, 5)).tolist() == [True, False, True, False, True]
    assert html_extract.shared_lines(a(1, 2), a()).tolist() == [False, False]
    r = random.Random(8)
    for _ in range(200):
        x, y = [[r.randrange(4) for _ in range(r.randrange(9))] for _ in range(2)]
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i in range(len(x)):
            for j in range(len(y)):
                best[i + 1][j + 1] = best[i][j] + 1 if x[i] == y[j] else max(best[i][j + 1], best[i + 1][j])
        assert html_extract.shared_lines(a(*x), a(*y)).sum() == best[-1][-1]


def test_lines_that_all_near_articles_share_are_furniture(spark, monkeypatch):
    """Differencing decides lines of marked articles too: those on all the nearest pages go, those that some share stay, and copies keep all."""
    body = lambda k: f"<p>{'word ' * 9}{k}</p>"
    page = lambda k: f"<article><p>Follow us</p>{body(k)}<h2>Part {k // 7}</h2><p>Read more</p></article>"
    urls = lambda host, n: [(f"https://{host}/{k:04d}", k) for k in range(n)]
    rows = [(u, page(k)) for u, k in urls("many", 60)] + [(u, page(k)) for u, k in urls("few", html_extract.NEAR)]
    rows += [(u, f"<article><p>Follow us</p>{body(0)}<p>copy {k}</p></article>") for u, k in urls("copies", 30)] + [(u, "<article><p>Same</p></article>") for u, k in urls("same", 30)]
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(rows)], "page_id long, url string, html string").repartition(4)
    body = lambda k: f"{'word ' * 9}{k}"
    whole = lambda k: f"Follow us\n{body(k)}\nPart {k // 7}\nRead more"
    want = [f"{body(k)}\nPart {k // 7}" for k in range(60)] + [whole(k) for k in range(html_extract.NEAR)]
    want += [f"Follow us\n{body(0)}\ncopy {k}" for k in range(30)] + ["Same"] * 30
    for few in (html_extract.FEW, 1):
        monkeypatch.setattr("loreline.llm.html_extract.FEW", few)
        assert [x.text for x in html_extract.extract_html(df).orderBy("page_id").collect()] == want
