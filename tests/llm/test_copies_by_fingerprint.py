"""The near-duplicate stage's first pairs come from SimHash fingerprints and their pivot distance table."""

import random

import corpus_pipeline
from tiersift.llm import near_copies, simhash


def test_fingerprints_of_sets():
    rng = random.Random(3)
    for n in (1, 4, 5, 6, 300):
        s = near_copies.shingle_set(" ".join(f"w{rng.randrange(50)}" for _ in range(n)))
        want = sum(1 << k for k in range(64) if 2 * sum(int(h) >> k & 1 for h in s) > len(s))
        assert near_copies.majority(s) == want


def test_stage_goes_through_the_pivot_table(spark, monkeypatch):
    rng, texts = random.Random(5), []
    for _ in range(20):
        base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
        texts += [" ".join(base), " ".join([*base[:-1], "end"]), " ".join(["x", *base[1:]])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    plain = docs.select("text")
    sets = near_copies.prefixes(plain, near_copies.repeated(plain, 60 * 400)).cache()
    rows = {r.fp: r.sim for r in sets.collect()}
    root = {r.node: r.root for r in simhash.components(near_copies.fingerprint_pairs(sets)).collect()}
    near = [(a, b) for a in rows for b in rows if a < b and ((rows[a] ^ rows[b]) & (1 << 64) - 1).bit_count() <= 3]
    assert len(near) > 10 and all(root[a] == root[b] for a, b in near)
    made, table = [], simhash.pivot_table
    monkeypatch.setattr(simhash, "pivot_table", lambda *a: made.append(1) or table(*a))
    assert corpus_pipeline.near_duplicates(spark, docs, "").count() == 20 and made
