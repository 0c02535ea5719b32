"""LSH forest: regions and candidates by themselves, and whole results against a plain version."""

import os
import random
import sys

sys.path.insert(0, os.path.dirname(__file__))
import brute
import numpy as np
import pytest

from loreline.llm import lsh_forest as lf
from loreline.llm.lsh_forest import candidates, forest_duplicates, minhashes, regions, signatures

SCHEMA = "doc_id long, text string"


def plain(docs):
    sets = [(i, brute.shingles(t, 2)) for i, t in docs]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[a + 1:]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return [(i, len(s), find(i), find(i) == i) for i, s in sets]


def test_regions_are_as_deep_as_they_are_dense():
    r = random.Random(1)
    value = np.sort(np.array([(r.choice([7, 7, 7, 9, 11]) << 32) | (r.choice([0, 0, 5]) << 24) | r.randrange(1 << 24) & 0x03030303 for _ in range(300)], np.uint64))
    got = {tuple(map(int, x)) for x in regions(value, 10)}

    def split(lo, hi, depth):
        if hi - lo <= 10 or depth == lf.MOST:
            return {(lo, hi)} if hi - lo > 1 else set()
        prefix = [int(v) >> 8 * (lf.MOST - depth - 1) for v in value[lo:hi]]
        cuts = [lo] + [lo + k for k in range(1, hi - lo) if prefix[k] != prefix[k - 1]] + [hi]
        return set().union(*(split(a, b, depth + 1) for a, b in zip(cuts, cuts[1:])))

    key = [int(v) >> 32 for v in value]
    cuts = [0] + [k for k in range(1, 300) if key[k] != key[k - 1]] + [300]
    assert got == set().union(*(split(a, b, lf.LEAST) for a, b in zip(cuts, cuts[1:])))


def test_candidates_against_all_pairs_of_a_region():
    r = np.random.default_rng(3)
    bits = r.integers(0, 1 << 32, 60, dtype=np.uint32)
    bits[::7] = bits[0] ^ (np.uint32(1) << r.integers(0, 32, len(bits[::7])).astype(np.uint32))
    spans = np.array([[0, 25], [30, 60]])
    want = [any(lo <= i < hi and lo <= j < hi and i != j and bin(int(bits[i] ^ bits[j])).count("1") <= lf.DIFFER for lo, hi in spans for j in range(60)) for i in range(60)]
    assert candidates(bits, spans).tolist() == want and any(want) and not all(want)


def test_no_pair_at_the_threshold_is_missed_by_all_trees():
    """2,000 pairs of Jaccard 0.8 and a little more: each shares a region and passes the bits in some tree, even at full depth in nearly all."""
    r = np.random.default_rng(5)
    deep = shallow = 0
    for _ in range(20):
        sets = []
        for _ in range(100):
            n = int(r.integers(9, 200))
            both = -(-8 * n // 9)  # n shingles each, 8 of 9 shared: 8 / 10
            x = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64))
            y = np.unique(np.concatenate([x[:both], r.integers(0, 1 << 63, n - both, dtype=np.uint64)]))
            sets += [x, y]
        key, tail, bits = signatures(minhashes(sets))
        close = np.bitwise_count(bits[:, ::2] ^ bits[:, 1::2]) <= lf.DIFFER
        same = key[:, ::2] == key[:, 1::2]
        shallow += int((same & close).any(axis=0).sum())
        deep += int((same & close & (tail[:, ::2] == tail[:, 1::2])).any(axis=0).sum())
    assert shallow == 2000 and deep >= 1999


@pytest.mark.parametrize("seed,region,page", [(1, 64, 1024), (2, 2, 3)])
def test_forest_against_brute_force(spark, seed, region, page, monkeypatch):
    monkeypatch.setattr(lf, "BUCKET_BYTES", 2000)
    monkeypatch.setattr(lf, "REGION", region)
    monkeypatch.setattr(lf, "PAGE", page)
    r = random.Random(seed)
    vocab = [f"w{k}" for k in range(60)]
    docs = []
    for i in range(160):
        w = [r.choice(vocab) for _ in range(r.randint(1, 60))]
        if docs and r.random() < 0.6:
            w = (docs[r.randrange(len(docs))][1] or "").split()
            for _ in range(r.randint(0, 3)):
                if w:
                    w[r.randrange(len(w))] = r.choice(vocab)
        docs.append((i, r.choice([" ", "\n", "  "]).join(x.upper() if r.random() < 0.1 else x for x in w)))
    family = [r.choice(vocab) + str(k) for k in range(80)]  # a chain of near copies
    for i in range(40):
        family[2 * i % 80] = f"new{i}"
        docs.append((500 + i, " ".join(family)))
    docs += [(900, None), (901, ""), (902, "one"), (903, "One"), (904, " \t"), (905, "one two"), (906, "word " * 4000), (907, "word " * 9)]
    r.shuffle(docs)
    got = sorted(tuple(x) for x in forest_duplicates(spark.createDataFrame(docs, SCHEMA)).collect())
    assert got == sorted(plain(docs))


def test_odd_tables(spark):
    assert forest_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    docs = [(1, "a b c d e f", 3), (1, "a b c d e f", 3), (1, "quite another text here", 4), (2, "quite another text here", 5), (None, "a b c d e f", 6), (None, None, 7), (3, "A b C d e f", 8)]
    got = forest_duplicates(spark.createDataFrame(docs, "`my.id` long, `the text` string, component long"), "my.id", "the text").collect()
    assert sorted((x["my.id"] is None, x["my.id"] or 0, x.n_shingles, x.component_id or 0, x.kept) for x in got) == [
        (False, 1, 3, 1, True), (False, 1, 5, 1, True), (False, 1, 5, 1, True), (False, 2, 3, 1, False), (False, 3, 5, 1, False), (True, 0, 0, 0, True), (True, 0, 5, 0, True)]
