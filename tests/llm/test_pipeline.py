import os
import random
import sys

sys.path.insert(0, os.path.dirname(__file__))
import brute
import corpus_pipeline
from loreline.llm.toxicity import score_toxicity


def test_pipeline_against_plain_stages(spark, tmp_path):
    r = random.Random(11)
    words = [f"w{k}" for k in range(400)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    passage, item = text(60), " ".join(f"item{k}" for k in range(25))
    docs, labels = [], []
    for i in range(260):
        t = text(r.randint(20, 90))
        toxic = i % 6 == 0
        if toxic:
            t += " vile nasty vile"
        elif i % 7 == 1:
            t += " " + passage
        elif i % 11 == 2:
            t += " " + item
        elif i % 13 == 3 and docs:
            t = docs[r.randrange(len(docs))][1] + " extra"
        docs.append((i, t, ["en", "de", "fr", "es"][i % 4], f"src{i % 3}", len(t)))
        labels.append((i, 1, int(toxic)))
    docs += [(300, "", "en", "s", 0), (301, "short text", "de", "s", 10)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {x.doc_id: x for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    df, lab = spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet")
    rude = {x.doc_id for x in score_toxicity(df, lab).filter("toxic").collect()}
    assert {i for i, _, t in labels if t} <= rude and len(rude) <= 46
    left = [(i, t) for i, t, *_ in docs if i not in rude]
    heads = {i for i, _, c in brute.near_duplicates(left) if i == c}
    cut = {i: (n, gone, kept) for i, n, gone, kept in brute.substring_dedup([d for d in left if d[0] in heads])}
    clean = {i: kept for i, (_, _, kept) in cut.items() if item not in kept}
    assert set(got) == set(clean)
    assert all(got[i].text == t and got[i].n_chars == len(t) for i, t in clean.items())
    assert all(x.rate > 0 and x.copies >= 0 for x in got.values())
    assert len(corpus_pipeline.STAGES) == 5 and got[301].source == "s"
