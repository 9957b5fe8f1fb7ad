"""The pipeline's near-dedup against the exact Jaccard similarity of all pairs."""

import random

import numpy as np

import corpus_pipeline
from tessera.llm import near_copies, simhash

rng = random.Random(11)
WORDS = [f"w{i}" for i in range(5000)]


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similar(a, b):
    return a == b or 100 * len(a & b) >= 80 * len(a | b)


def changed(text, times):
    w = text.split()
    for i in rng.sample(range(len(w)), times):
        w[i] = rng.choice(WORDS)
    return " ".join(w)


def corpus():
    base = [" ".join(rng.choices(WORDS, k=rng.randint(60, 250))) for _ in range(40)]
    # one changed word in 50 leaves about 0.82 of the shingles, more of them less than 0.8
    texts = [*base, *(changed(t, len(t.split()) // 50) for t in base), *(changed(t, len(t.split()) // 20) for t in base)]
    chain = [base[0]]
    for _ in range(5):
        chain.append(changed(chain[-1], 1))
    return [*texts, *chain, base[1].upper(), base[2], None, "", " \n", "one two", "One two"]


def test_near_dedup_keeps_one_of_each_exact_group(spark):
    texts = corpus()
    sets = [shingles(t) for t in texts]
    group = list(range(len(texts)))
    for _ in range(8):
        for a in range(len(texts)):
            for b in range(len(texts)):
                if similar(sets[a], sets[b]):
                    group[a] = group[b] = min(group[a], group[b])
    docs = spark.createDataFrame([*enumerate(texts), (None, texts[0]), (3, texts[3])], "doc_id long, text string")
    out = corpus_pipeline.near_dedup(spark, docs, "")
    assert sorted(r["doc_id"] for r in out.collect() if r["doc_id"] is not None) == sorted([*{g for i, g in enumerate(group)}, 3])
    assert out.where("doc_id is null").count() == 1 and out.columns == docs.columns
    # the case needs candidates past the SimHash radius
    assert {r["doc_id"] for r in simhash.one_of_each_group(docs, 5, 6).collect()} != {r["doc_id"] for r in out.collect()}
    assert near_copies.one_of_each_group(docs.where("false")).count() == 0


def test_large_clusters_are_searched_by_pairs_of_blocks(spark, monkeypatch):
    chain = [" ".join(rng.choices(WORDS, k=80))]
    for _ in range(40):
        chain.append(changed(chain[-1], 1))
    docs = spark.createDataFrame([*enumerate([*chain, *(" ".join(rng.choices(WORDS, k=80)) for _ in range(10))])], "doc_id long, text string")
    want = sorted(tuple(r) for r in near_copies.groups(docs, 5, 6, 80).collect())
    monkeypatch.setattr(near_copies, "BLOCK_BYTES", 3000)
    assert sorted(tuple(r) for r in near_copies.groups(docs, 5, 6, 80).collect()) == want and len({c for _, c in want}) < 20


def test_near_simhashes_of_different_texts_stay(spark, monkeypatch):
    monkeypatch.setattr(simhash, "fingerprint", lambda text, width: 7)
    docs = spark.createDataFrame([(i, " ".join(rng.choices(WORDS, k=60))) for i in range(20)], "doc_id long, text string")
    assert near_copies.groups(docs, 5, 6, 80).where("doc_id <> component_id").count() == 0


def test_groups_within_are_exact():
    sets = [np.array(sorted(rng.sample(range(40), rng.randint(20, 40))), "<u8") for _ in range(60)]
    found, want = near_copies.groups_within(sets, 80), list(range(60))
    for _ in range(60):
        for a in range(60):
            for b in range(60):
                if similar(set(sets[a].tolist()), set(sets[b].tolist())):
                    want[a] = want[b] = min(want[a], want[b])
    assert found.tolist() == want
