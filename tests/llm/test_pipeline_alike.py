"""The near-duplicate stage on texts that are much alike but not similar: their square does not leave the tasks that compare."""

import random

import numpy as np
import pytest
from tiersift.llm import near_copies, simhash


def family(rng, n, size, edits):
    """Texts of one family: each with words of its own in place of some, which others share in part."""
    base = [f"w{rng.randrange(10**6)}" for _ in range(size)]
    other = [f"x{rng.randrange(10**6)}" for _ in range(size)]
    out = []
    for _ in range(n):
        t = list(base)
        for i in rng.sample(range(size), edits):
            t[i] = other[i]
        out.append(" ".join(t))
    return out


def similar_roots(texts):
    sets, root = [frozenset(near_copies.shingle_set(t).tolist()) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                root[find(i)] = find(j)
    return [find(i) for i in range(len(texts))]


def test_sketches_never_say_more_than_the_sets():
    rng = np.random.default_rng(1)
    sets = []
    for n in (1, 40, 43, 90, 400, 1000, 7000):
        base = np.unique(rng.integers(0, 2**63, n, np.uint64))
        sets += [base, np.unique(np.concatenate([base[n // 10 :], rng.integers(0, 2**63, n // 9, np.uint64)]))]
    made = [near_copies.sketch(s) for s in sets]
    assert all(len(x) * 8 <= near_copies.MOST_BITS for x in made)
    words, n = np.frombuffer(b"".join(made), "<u8"), np.array([len(x) // 8 for x in made])
    i, j = map(np.ravel, np.meshgrid(np.arange(len(sets)), np.arange(len(sets))))
    far = near_copies.bits_apart(i, j, words, np.cumsum(n) - n, n)
    want = np.array([len(np.setxor1d(sets[a], sets[b])) for a, b in zip(i, j)])
    assert (far <= want).all() and (far[i == j] == 0).all() and (far[want > 0] > 0).sum() > len(sets)


def test_families_leave_few_pairs(spark, monkeypatch):
    rng = random.Random(2)
    texts = [t for size in (120, 400) for t in family(rng, 80, size, size // 11)]
    roots, rows, cut = similar_roots(texts), {}, near_copies.cut

    def counted(df, name):
        out = cut(df, name)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(near_copies, "cut", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in near_copies.near_copies(docs).collect()}
    least = {}
    for i, x in enumerate(roots):
        least.setdefault(x, i)
    assert found == {i: least[x] for i, x in enumerate(roots)}
    assert rows["copies-pairs"] < 80  # of 6,320 pairs that share a shingle of their prefixes


@pytest.mark.parametrize("most", [0, 5, 10**6])
def test_nearest_pairs_first_give_the_same_components(spark, monkeypatch, most):
    rng = random.Random(6)
    texts = [t for edits in (2, 4, 6) for t in family(rng, 25, 200, edits)]
    monkeypatch.setattr(near_copies, "nearest_first", lambda *a, f=near_copies.nearest_first: f(*a[:-1], most))
    plain = spark.createDataFrame([(t,) for t in texts], "text string")
    sets = near_copies.prefixes(plain, near_copies.repeated(plain, 75 * 200)).cache()
    at = {near_copies.xxh64_intdigest(near_copies.shingle_set(t).tobytes(), near_copies.SEED): i for i, t in enumerate(texts)}
    got = {at[r.node % 2**64]: at[r.root % 2**64] for r in simhash.components(near_copies.links(sets, block=7)).collect()}
    want = similar_roots(texts)
    assert 3 < len(set(want)) < 75
    assert all((want[i] == want[j]) == (got.get(i, i) == got.get(j, j)) for i in range(75) for j in range(i))
