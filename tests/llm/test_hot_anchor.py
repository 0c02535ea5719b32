"""Segments around a common phrase travel in pieces: the same bytes go, and no bucket gathers all of them."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import brute
from loreline.llm import suffix_dedup as sd


def common(seed: int, n: int):
    r = random.Random(seed)
    noise = lambda k: "".join(r.choice("abcdefgh é") for _ in range(k))
    phrase = "the same long common phrase, word for word "
    bits = [noise(60) for _ in range(6)]
    return [(k // 2 if k % 9 == 0 else k, noise(r.randrange(40)) + r.choice(bits)[r.randrange(20):] + phrase[:r.randrange(20, 43)] + r.choice(bits)[:r.randrange(60)] + noise(r.randrange(30)) + phrase + noise(40)) for k in range(n)]


@pytest.mark.parametrize("hot", [0, 5])
@pytest.mark.parametrize("length,anchor", [(50, 20), (12, 8), (3, 2)])
def test_pieces_remove_what_whole_segments_do(spark, hot, length, anchor, monkeypatch):
    monkeypatch.setattr(sd, "GROUP_BYTES", 3000)
    monkeypatch.setattr(sd, "BUCKET_BYTES", 4000)
    docs = common(length, 90)
    got = sd.suffix_dedup(spark.createDataFrame(docs, "doc_id long, text string"), length=length, anchor=anchor, hot=hot).collect()
    assert sorted((r[0], r[1], r[2], r[3], bytes(r[4])) for r in got) == sorted(brute.suffix_dedup(docs, length))


def test_a_common_phrase_does_not_gather_in_one_bucket():
    def largest(hot: int) -> int:
        sent, asked = Counter(), {}
        tables = [pa.table({"id": [g * 300 + k for k in range(300)], "text": [t for _, t in common(g, 300)], "tie": list(range(300)), "grp": [g] * 300}) for g in range(4)]
        for g, t in enumerate(tables):
            for row in sd._ask(50, 20, 64)(t).to_pylist():
                asked.setdefault(row["bucket"], []).append(row)
        answers = pa.concat_tables([sd._answer(hot)(pa.Table.from_pylist(rows)) for rows in asked.values()])
        for g, t in enumerate(tables):
            for row in sd._open_bytes(50, 20, 64)(t, answers.filter(pa.compute.equal(answers["grp"], g))).to_pylist():
                sent[row["bucket"]] += int(np.frombuffer(row["sizes"], np.uint16).sum())
        return max(sent.values())

    assert largest(20) * 2 < largest(10**9)


def sent(docs, length=50, anchor=20, buckets=3, groups=4):
    """Entries that groups ask about, and bytes of those that go open."""
    tables = [pa.table({"id": [k for k, _ in docs[g::groups]], "text": [t for _, t in docs[g::groups]], "tie": list(range(len(docs[g::groups]))), "grp": [g] * len(docs[g::groups])}) for g in range(groups)]
    met = lambda rows, f: pa.concat_tables([f(pa.Table.from_pylist([r for r in rows if r["bucket"] == b])) for b in sorted({r["bucket"] for r in rows})])
    of = lambda t, g: t.filter(pa.compute.equal(t["grp"], g))
    again = met([r for t in tables for r in sd._tell(length, anchor, buckets)(t).to_pylist()], sd._again)
    asked = [r for g, t in enumerate(tables) for r in sd._ask(length, anchor, buckets)(t, of(again, g)).to_pylist()]
    if not asked:
        return 0, 0
    answers = met(asked, sd._answer(512))
    opened = [r for g, t in enumerate(tables) for r in sd._open_bytes(length, anchor, buckets)(t, of(answers, g)).to_pylist()]
    return sum(len(r["owners"]) // 8 for r in asked), sum(len(r["content"]) for r in opened)


def test_anchors_that_meet_by_chance_send_nothing():
    """Texts that share 30 bytes share anchors and no string of 50: neither they nor their bytes travel."""
    r = random.Random(1)
    noise = lambda k: "".join(r.choice("abcdefghijklmnop") for _ in range(k))
    phrase = noise(30)
    texts = [(k, noise(90) + phrase + noise(90)) for k in range(200)]
    assert sent(texts) == (0, 0)
    # 50 bytes in common at any distance from what surrounds them do
    asked, opened = sent([(k, noise(90) + phrase + "0123456789abcdefghij" + noise(90)) for k in range(200)])
    assert asked >= 200 and opened >= 200 * 50


def test_strings_that_just_reach_the_length_are_found_wherever_they_stand(spark, monkeypatch):
    monkeypatch.setattr(sd, "GROUP_BYTES", 3000)
    monkeypatch.setattr(sd, "BUCKET_BYTES", 4000)
    r = random.Random(2)
    noise = lambda k: "".join(r.choice("abcdefghé ") for _ in range(k))
    shared = [noise(70).encode()[:50 + k % 3].decode(errors="ignore") for k in range(40)]
    docs = [(k, noise(r.randrange(60)) + shared[k % 40][k % 2:] + noise(r.randrange(60)) + shared[k * 7 % 40]) for k in range(120)]
    got = sd.suffix_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    want = brute.suffix_dedup(docs, 50)
    assert sorted((x[0], x[1], x[2], x[3], bytes(x[4])) for x in got) == sorted(want) and sum(x[2] > 0 for x in want) > 40
