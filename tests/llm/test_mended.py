"""Long and repeated benchmark items, licenses side by side, labels that are mostly toxic."""

import itertools
import random
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from loreline.llm import _text as X
from loreline.llm import decontam, license_scan
from loreline.llm.toxicity import score_toxicity


def test_repeated_long_items_are_found_in_bounded_memory():
    r = random.Random(1)
    vocab = [f"w{k}" for k in range(5000)]
    item, short = (" ".join(r.choice(vocab) for _ in range(n)) for n in (2000, 200))
    index = decontam.Index([1, 2], [item, short])
    for text, want in ((" ".join([item] * 90), (0, 0, 1.0, 0, 2000, 0)), ("x y " + " ".join([short] * 900), (0, 1, 1.0, 2, 200, 0))):
        tracemalloc.start()
        began = time.time()
        found = decontam.matches_in(index, *X.bytes_of(pa.array([text], pa.large_string())), 0.8)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert found == [want] and peak < 600 << 20 and time.time() - began < 120, (found, peak)


@pytest.mark.parametrize("seed", range(6))
def test_sliding_similarity_is_the_exact_one(seed):
    """Many windows of one item at once, over texts that repeat shingles of it."""
    r = random.Random(seed)
    words = [f"w{r.randrange(12)}" for _ in range(40)]
    index = decontam.Index([0, 1], [" ".join(words), "w1 w2 w3 w4 w5 w6 " * 3], shingle=2)
    text = " ".join(r.choice([words, words[5:30], [f"w{r.randrange(14)}" for _ in range(9)]])[k] for _ in range(12) for k in range(9))
    hashes, parts, ok = decontam.hashes_of([text], 2)
    place = np.where(ok, index.every.find(hashes), -1)
    for item in (0, 1):
        size = int(index.length[item]) - 1
        start = np.array(sorted(r.sample(range(len(place) - size), 40)))
        n = np.full(len(start), size)
        want = decontam.similarities(index, place, start, n, np.full(len(start), item))
        assert np.allclose(decontam.sliding(index, place, start, size, item), want, atol=1e-12)


def test_fingerprints_of_runs_are_those_of_each_run_alone(monkeypatch):
    monkeypatch.setattr(decontam, "VOTE_ROWS", 16)
    r = np.random.default_rng(2)
    shingles, votes = r.integers(0, 1 << 63, 300, dtype=np.uint64), r.integers(1, 1 << 18, 300)
    first = np.arange(0, 280)
    count = np.full(280, 20)
    bits = np.unpackbits(X.mix(shingles ^ decontam._SALT).view(np.uint8).reshape(-1, 8), axis=1).astype(np.int64) * 2 - 1
    want = [np.packbits((bits[a:a + n] * votes[a:a + n, None]).sum(axis=0) > 0).view(np.uint64)[0] for a, n in zip(first, count)]
    assert decontam.fingerprints(shingles, votes, first, count).tolist() == want


def test_weights_do_not_depend_on_the_block():
    items = ["one two three four five six", "one two three four five seven eight", "only here are these words now"]
    every = decontam.shingles_of(items, 3)
    several = every.df > 1
    shared = decontam.Shingles(every.known[several], every.df[several], every.items)
    alone = decontam.Index([1], items[1:2], 3, shared=shared)
    hashes, _, ok = decontam.hashes_of(["zero one two three four five seven eight nine"], 3)
    a, b = alone.every.find(hashes[ok]), every.find(hashes[ok])
    assert np.allclose(alone.every.weight(a), every.weight(b)) and (alone.every.votes(a) == every.votes(b)).all()


def scanned(index, text):
    return {(m[1], m[3], m[4]): m[2] for m in license_scan.scan(index, *X.bytes_of(pa.array([text], pa.large_string())), license_scan.CONTAINMENT)}


def test_licenses_side_by_side_are_all_found_where_they_stand():
    index = license_scan.Index(license_scan.templates())
    given = license_scan.templates()
    whole = given[len(license_scan.NOTICES):]
    size = lambda t: len(X.split_words(*X.bytes_of(pa.array([t], pa.large_string())), X.NOT_ALNUM).start)
    r = random.Random(3)
    cases = list(itertools.permutations(range(len(whole)), 2)) + r.sample(list(itertools.permutations(range(len(whole)), 3)), 150)
    for case in cases:
        parts = [whole[k] for k in case]
        found = scanned(index, "some words first\n\n" + "\n\nand then\n\n".join(t for _, t in parts))
        names = [n for n, _ in parts]
        assert set(names) <= {k[0] for k in found}, case
        at = 3
        for n, t in parts:
            if names.count(n) == 1:
                assert any(k[0] == n and abs(k[1] - at) <= 1 and abs(k[2] - size(t)) <= 2 and share == 1.0 for k, share in found.items()), (case, n, at, found)
            at += size(t) + 2
    texts = [t for _, t in license_scan.NOTICES]
    for a, b in itertools.permutations(range(len(texts)), 2):
        found = scanned(index, f"{texts[a]} And more. {texts[b]}")
        assert {license_scan.NOTICES[a][0], license_scan.NOTICES[b][0]} <= {k[0] for k in found}, (texts[a], texts[b])
    # a part of one license does not hide the next
    named = dict(whole)
    gpl, mit = named["GPL-3.0"], named["MIT"]
    found = scanned(index, gpl[: int(len(gpl) * 0.9)] + "\n" + mit)
    assert {"GPL-3.0", "MIT"} <= {k[0] for k in found}


def test_texts_that_tell_nothing_are_clean_at_any_share_of_toxic_labels(spark):
    r = random.Random(8)
    docs = [(i, " ".join([f"calm{r.randrange(60)}" for _ in range(30)] + ["vile", "nasty"] * (i % 4 > 0))) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i, _ in docs], "doc_id long, toxic int")
    odd = [(1000, None), (1001, ""), (1002, "words never seen"), (None, None), (1003, "vile nasty vile"), (1003, "vile nasty vile")]
    got = score_toxicity(spark.createDataFrame(docs + odd, "doc_id long, text string"), labels).collect()
    by = {x.doc_id: x for x in got if x.doc_id is not None and x.doc_id >= 1000}
    assert not any(by[k].toxic or by[k].grade or by[k].severity >= 0.5 for k in (1000, 1001, 1002)) and by[1003].toxic and len(got) == 406
    assert not next(x for x in got if x.doc_id is None).toxic
    clean = [x.toxic for x in got if x.doc_id is not None and x.doc_id < 400 and x.doc_id % 4 == 0]
    rude = [x.toxic for x in got if x.doc_id is not None and x.doc_id < 400 and x.doc_id % 4 > 0]
    assert not any(clean) and all(rude)


def test_the_pipeline_keeps_odd_rows(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(9)
    docs = [(i, " ".join(f"calm{r.randrange(90)}" for _ in range(40)) + " vile nasty" * (i % 4 > 0), "en", "s", 1, "x") for i in range(200)]
    odd = [(1000, None, "en", "s", 0, "x"), (1001, "", "de", None, 0, None), (1002, "few words never seen", None, "s", 20, "x"), (None, "another text without an id", "en", "s", 5, "x"), (1003, "a row that stands here twice", "fr", "s", 9, "x"), (1003, "a row that stands here twice", "fr", "s", 9, "x")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, severity string"
    spark.createDataFrame(docs + odd, schema).write.parquet(f"{tmp_path}/a/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 > 0)) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/a/labels.parquet")
    spark.createDataFrame([(1, "an item of the benchmark that nothing here holds")], "item_id long, text string").write.parquet(f"{tmp_path}/a/benchmark.parquet")
    left = corpus_pipeline.toxicity(spark, spark.read.parquet(f"{tmp_path}/a/documents.parquet"), f"{tmp_path}/a")
    assert left.columns == list(corpus_pipeline.COLUMNS) and left.count() == 50 + len(odd)
    done = corpus_pipeline.run(spark, f"{tmp_path}/a").collect()
    kept = sorted(x.doc_id for x in done if x.doc_id is not None)
    assert kept == sorted([i for i in range(0, 200, 4)] + [1000, 1001, 1002, 1003, 1003]) and sum(x.doc_id is None for x in done) == 1
    # the last stage leaves out what has no rate: texts without words have no share of any target
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/a/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/b/{t}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").collect() == []


@pytest.mark.parametrize("html,want", [
    ('<body><div class="layout has-sidebar"><p>Body of the page.</p><div class="sidebar">side</div></div></body>', ["Body of the page."]),
    ('<body class="x"><div class="page no-comments"><p>Text.</p></div><div class="comments">what readers say, at length</div></body>', ["Text."]),
    ('<div id="page-sidebar"><p>All the text of this page, a lot of it, stands in here.</p></div>', ["All the text of this page, a lot of it, stands in here."]),
    ('<div class="page"><p>The main body, long enough to be told from what is beside it.</p></div><article>teaser one</article><article><p>teaser two</p></article>', ["The main body, long enough to be told from what is beside it."]),
    ('<article><p>Short.</p></article><div>Longer text beside the only article of the page, which it marks.</div>', ["Short."]),
    ('<article><h1>A</h1><p>First of several articles that are most of the page.</p></article><article>Second of them, with its own text.</article><p>foot</p>', ["A", "First of several articles that are most of the page.", "Second of them, with its own text."]),
    ('<article><p>Text <span class="ad">buy</span> goes on.</p><div class="related-posts">more</div><div class="share">x</div></article>', ["Text goes on."]),
    ('<div class="comments">' + "reader " * 40 + '</div><div><p>' + "body " * 12 + "</p></div>", [" ".join(["body"] * 12)]),
])
def test_layout_classes_and_teasers(html, want):
    from loreline.llm.html_extract import blocks_of

    assert blocks_of(html) == want
