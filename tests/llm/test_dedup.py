import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
import os
import sys

sys.path.insert(0, os.path.dirname(__file__))
import brute
import numpy as np

from loreline.llm import suffix_dedup as sd
from loreline.llm.jaccard_join import bands, keep_one, near_duplicates, signatures
from loreline.llm.substring_dedup import substring_dedup
from loreline.llm.suffix_dedup import suffix_dedup

SCHEMA = "doc_id long, text string"


def corpus(seed, n=60, vocabulary=40):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 6)))
    vocab = [word() for _ in range(vocabulary)]
    passages = [[r.choice(vocab) for _ in range(r.randint(10, 40))] for _ in range(4)]
    docs = []
    for i in range(n):
        w = [r.choice(vocab) for _ in range(r.randint(0, 60))]
        if r.random() < 0.5:
            p = r.choice(passages)
            at = r.randint(0, len(w))
            w[at:at] = p
        if docs and r.random() < 0.3:
            w = (docs[r.randrange(len(docs))][1] or "").split()
            if w and r.random() < 0.7:
                w[r.randrange(len(w))] = "changed"
        docs.append((i, r.choice([" ", "  ", "\n"]).join(w)))
    docs += [(n, None), (n + 1, ""), (n + 2, "one two"), (n + 3, "One two"), (n + 4, "  \t "), (n + 5, "word " * 3000), (n + 6, "-" * 5000), (n + 7, "-" * 4000 + " x")]
    r.shuffle(docs)
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_substring_against_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr("loreline.llm.substring_dedup.GROUP_BYTES", 2000)
    monkeypatch.setattr("loreline.llm.substring_dedup.BUCKET_BYTES", 4000)
    docs = corpus(seed)
    got = substring_dedup(spark.createDataFrame(docs, SCHEMA)).collect()
    assert sorted(tuple(r) for r in got) == sorted(brute.substring_dedup(docs))


@pytest.mark.parametrize("seed", [3, 4])
def test_suffix_against_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr("loreline.llm.suffix_dedup.GROUP_BYTES", 2000)
    monkeypatch.setattr("loreline.llm.suffix_dedup.BUCKET_BYTES", 4000)
    docs = corpus(seed)
    got = suffix_dedup(spark.createDataFrame(docs, SCHEMA)).collect()
    assert sorted((r[0], r[1], r[2], r[3], bytes(r[4])) for r in got) == sorted(brute.suffix_dedup(docs))


@pytest.mark.parametrize("seed", [5, 6])
def test_near_duplicates_against_brute_force(spark, seed):
    docs = corpus(seed, 80)
    got = near_duplicates(spark.createDataFrame(docs, SCHEMA)).collect()
    assert sorted(tuple(r) for r in got) == sorted(brute.near_duplicates(docs))


def test_large_group_of_near_copies(spark):
    """Chains: neighbours link, ends do not; all are one class. Also groups past the small-group path."""
    r = random.Random(9)
    base = [f"w{k}" for k in range(200)]
    docs, now = [], list(base)
    for i in range(150):
        docs.append((i, " ".join(now)))
        now = list(now)
        now[r.randrange(200)] = f"n{i}"
    got = near_duplicates(spark.createDataFrame(docs, SCHEMA)).collect()
    assert sorted(tuple(x) for x in got) == sorted(brute.near_duplicates(docs))


def test_odd_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert substring_dedup(empty).count() == suffix_dedup(empty).count() == near_duplicates(empty).count() == 0
    long = " ".join(f"w{k}" for k in range(40))
    rows = [(1, long, 7), (1, long, 7), (None, long, 8), (2, long, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words long")
    got = sorted((r.doc_id if r.doc_id is not None else 99, r.n_removed) for r in substring_dedup(df).collect())
    assert got == [(1, 0), (1, 0), (2, 40), (99, 40)]
    assert sorted((r.doc_id if r.doc_id is not None else 99, r.n_removed) for r in suffix_dedup(df).collect()) == [(1, 0), (1, 0), (2, len(long)), (99, len(long))]
    near = sorted((r.doc_id if r.doc_id is not None else 99, r.component_id) for r in near_duplicates(df).collect())
    assert near == [(1, 1), (1, 1), (2, 1), (99, None)]
    kept = keep_one(df)
    assert kept.columns == df.columns and sorted(r.doc_id or 99 for r in kept.collect()) == [1, 1, 99]


def test_repeated_ids_are_one_node_with_several_sets(spark):
    """Every id has two texts (or none), near copies of texts of other ids; links through either count."""
    r = random.Random(13)
    bases = [[f"b{k}w{j}" for j in range(60)] for k in range(14)]
    rows = []
    for i in range(40):
        for k in {r.randrange(14), r.randrange(14)} if i % 10 == 0 else {r.randrange(14)}:
            w = list(bases[k])
            w[r.randrange(60)] = f"x{i}"
            rows.append((i, " ".join(w)))
        rows.append((i, f"own text of {i} " * 3))
        rows.append((i, None))
    pairs = [(x, brute.shingles(t)) for x, t in rows]
    root = {i: i for i in range(40)}
    for _ in range(40):
        for i, x in pairs:
            for j, y in pairs:
                if x and y and 100 * len(x & y) >= 80 * len(x | y):
                    root[i] = root[j] = min(root[i], root[j])
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert sorted(tuple(x) for x in got) == sorted((i, len(s), root[i]) for i, s in pairs)
    assert 1 < len(set(root.values())) < 40


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 400), st.integers(0, 120), st.integers(0, 10**6))
def test_partenum_loses_no_linked_pair(n, change, seed):
    r = np.random.default_rng(seed)
    x = np.unique(r.integers(0, 2**63, n, dtype=np.int64).astype(np.uint64))
    gone = min(change // 2, len(x) - 1)
    y = np.unique(np.concatenate([x[gone:], r.integers(0, 2**63, change - change // 2, dtype=np.int64).astype(np.uint64)]))
    both = len(np.intersect1d(x, y))
    if 100 * both >= 80 * (len(x) + len(y) - both):
        assert len(np.intersect1d(signatures(x, 80), signatures(y, 80)))


def test_bands_cover_linked_sizes():
    for s in range(1, 300):
        for t in range(s, s * 5 // 4 + 1):
            assert {b for b, _ in bands(s, 80)} & {b for b, _ in bands(t, 80)}


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(2, 4), min_size=1, max_size=120), st.integers(1, 20))
def test_interval_expansion(symbols, length):
    text = np.array([*symbols, 0], np.uint16)
    order, interval = sd.equal_prefixes(text, length)
    whole = [i for i in range(len(symbols)) if i + length <= len(symbols)]
    of = dict(zip(order.tolist(), interval.tolist()))
    for i in whole:
        for j in whole:
            assert (of[i] == of[j]) == (symbols[i:i + length] == symbols[j:j + length])


def test_many_one_shingle_texts(spark):
    """Short texts differ or are equal; none meets all others in a signature that covers nothing."""
    texts = [(i, f"short text {i % 4000}") for i in range(5000)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(spark.createDataFrame(texts, SCHEMA)).collect()}
    assert got == {i: (1, i % 4000) for i in range(5000)}


def test_small_sets_share_a_signature():
    r = np.random.default_rng(17)
    for _ in range(4000):
        n = int(r.integers(1, 40))
        x = np.unique(r.integers(0, 2**63, n, dtype=np.int64).astype(np.uint64))
        change = int(r.integers(0, n // 4 + 2))
        y = np.unique(np.concatenate([x[change // 2:], r.integers(0, 2**63, change - change // 2, dtype=np.int64).astype(np.uint64)]))
        both = len(np.intersect1d(x, y))
        if len(y) and 100 * both >= 80 * (len(x) + len(y) - both):
            assert len(np.intersect1d(signatures(x, 80), signatures(y, 80)))


@pytest.mark.parametrize("seed", [21, 22])
def test_paged_groups_against_brute_force(spark, seed, monkeypatch):
    """Signatures of many sets, in pages and tiles: chains of near copies, and unlike texts around one passage."""
    for name, value in (("PAGE", 7), ("CHUNK", 50), ("TILE", 5), ("SALT_AT", 4), ("VERIFY", 9)):
        monkeypatch.setattr(f"loreline.llm.jaccard_join.{name}", value)
    r = random.Random(seed)
    docs, now = [], [f"w{k}" for k in range(60)]
    for i in range(70):
        docs.append((i, " ".join(now)))
        now = list(now)
        now[r.randrange(60)] = f"n{i}"
    passage = " ".join(f"p{k}" for k in range(80))
    for i in range(70, 150):
        docs.append((i, passage + " " + " ".join(f"x{r.randrange(400)}" for _ in range(r.choice([8, 10, 12, 14])))))
    docs += [(i, docs[r.randrange(150)][1]) for i in range(150, 170)]
    r.shuffle(docs)
    got = near_duplicates(spark.createDataFrame(docs, SCHEMA).repartition(6)).collect()
    assert sorted(tuple(x) for x in got) == sorted(brute.near_duplicates(docs))


@pytest.mark.parametrize("symbols", [2, 60, 254])
def test_suffixes_told_apart_are_not_sorted_again(symbols, monkeypatch):
    rng = np.random.default_rng(symbols)
    one = rng.integers(2, 2 + symbols, 3000).astype(np.uint16)
    text = np.concatenate([one, [0], rng.integers(2, 2 + symbols, 17000), [0], one[:2000], [0]]).astype(np.uint16)
    sizes = []
    for name in ("sort", "argsort"):
        own = getattr(np, name)
        monkeypatch.setattr(sd.np, name, lambda x, *a, own=own, **k: sizes.append(len(x)) or own(x, *a, **k))
    order, interval = sd.equal_prefixes(text, 50)
    monkeypatch.undo()
    assert sizes[0] == len(text) and sum(sizes) < 3 * len(text)
    raw = text.tobytes() + bytes(100)
    found = [raw[2 * k:2 * k + 100] for k in order]
    big = [x.hex() for x in (text[k:k + 50].astype(">u2").tobytes().ljust(100, b"\0") for k in order)]
    assert big == sorted(big) and sorted(order) == list(range(len(text)))
    whole = [np.all(text[k:k + 50] > 0) and k + 50 <= len(text) for k in order]
    for p in range(1, len(order)):
        assert (interval[p] == interval[p - 1]) == bool(found[p] == found[p - 1] and whole[p])
