"""The pipeline's near-duplicate stage against brute force over all pairs."""

import random
import re
from collections import Counter

import corpus_pipeline
from tiersift.llm import near_copies, simhash


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def test_near_copies_equal_brute_force(spark):
    rng = random.Random(4)
    texts = [None, "", " ", "one", "One", "two words", "a b c d e", "A  b c d e"]
    line = " ".join(f"common{i}" for i in range(30))
    for n in (12, 60, 200, 700):
        for _ in range(6):
            base = [f"w{rng.randrange(10**6)}" for _ in range(n)]
            for edits in (0, 1, 2, n // 60, n // 45, n // 38, n // 20):
                t = list(base)
                for _ in range(edits):
                    t[rng.randrange(n)] = f"x{rng.randrange(10**6)}"
                texts.append(" ".join(t))
            texts += [line + " " + " ".join(base), " ".join(base[: n * 4 // 5]), " ".join(base).upper()]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "null id"), (9, texts[9]), (9, texts[40])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    beyond = 0
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                root[find(i)] = find(j)
                beyond += (simhash.fingerprint(rows[i][1]) ^ simhash.fingerprint(rows[j][1])).bit_count() > 3
    assert beyond > 50
    least = {}
    for i, (d, _) in enumerate(rows):
        least.setdefault(find(i), []).append(d)
    want = Counter((d, min((x for x in least[find(i)] if x is not None), default=None)) for i, (d, _) in enumerate(rows))
    assert Counter((r.doc_id, r.component_id) for r in near_copies.near_copies(docs).collect()) == want
    kept = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert sorted(find(next(i for i, x in enumerate(rows) if x == (r.doc_id, r.text))) for r in kept) == sorted(least)


def test_empty_table(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string").limit(0)
    assert near_copies.near_copies(docs).count() == 0


def test_near_copies_in_blocks(spark):
    base = [f"w{i}" for i in range(100)]
    texts = [" ".join([*base[:i], "x", *base[i + 1 :]]) for i in range(0, 100, 5)] + [" ".join(base)]
    texts = spark.createDataFrame([(t,) for t in texts], "text string")
    sets = near_copies.prefixes(texts, near_copies.repeated(texts, 2000)).cache()
    edges = near_copies.links(sets, block=3)
    assert simhash.components(edges).select("root").distinct().count() == 1 and simhash.components(edges).count() == 21


def test_counts_are_dealt_over_parts(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "HELD", 50)
    texts = spark.createDataFrame([(" ".join(f"w{i + j}" for j in range(30)),) for i in range(0, 200, 5)], "text string")
    shards = near_copies.repeated(texts, 10**6)
    assert len(shards) > 8
    want = Counter(int(h) >> 32 for r in texts.collect() for h in near_copies.shingle_set(r.text))
    keys = near_copies.np.array(sorted(want), near_copies.np.uint64)
    found = near_copies.hash_arrays.Arrays(shards).find(keys)
    assert [0 if n != n else int(n) for n in found] == [want[int(k)] if want[int(k)] > 1 else 0 for k in keys]
