"""The n-gram model against a brute-force Kneser-Ney, and the bands on texts that do not vouch for themselves."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tiersift.llm import hash_arrays, quality


def brute_kneser_ney(texts, order):
    """log P(last byte | bytes before) of an n-gram, by the textbook's recursion over dictionaries."""
    counts = {order: Counter()}
    for t in texts:
        data = b"\0" * (order - 1) + t.encode()
        counts[order].update(data[i : i + order] for i in range(len(data) - order + 1))
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    cuts = {}
    for n, table in counts.items():
        of = Counter(table.values())
        y = of[1] / (of[1] + 2 * of[2]) if of[1] + 2 * of[2] else None
        cuts[n] = []
        for k in (1, 2, 3):
            d = k - (k + 1) * y * of[k + 1] / of[k] if y is not None and of[k] else None
            cuts[n].append(d if d is not None and 0 < d < k else 0.5 * k)
    totals, freed = ({n: defaultdict(float) for n in counts} for _ in range(2))
    for n, table in counts.items():
        for g, c in table.items():
            totals[n][g[:-1]] += c
            freed[n][g[:-1]] += cuts[n][min(c, 3) - 1]

    def p(g):
        n = len(g)
        if not n:
            return 1 / 256
        total = totals[n].get(g[:-1])
        if not total:
            return p(g[1:])
        c = counts[n][g]
        return (max(0.0, c - cuts[n][min(c, 3) - 1]) if c else 0.0) / total + freed[n][g[:-1]] / total * p(g[1:])

    return p


def test_probabilities_equal_brute_force(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(0, 90))) for _ in range(12)]
    docs = spark.createDataFrame([(7, t) for t in texts] + [(9, "other model"), (7, None)], "l long, text string")
    model, p = quality.Model(hash_arrays.shards_of(quality.train(docs))), brute_kneser_ney(texts, quality.ORDER)
    grams = [bytes(rng.choice(b"abcd \xc3\xa9z\0") for _ in range(5)) for _ in range(300)] + [t.encode()[-5:].rjust(5, b"\0") for t in texts]
    codes = np.array([int.from_bytes(g, "big") for g in grams], np.uint64)
    got = model.log_probability(np.full(len(grams), 7, np.uint64), codes)
    assert got == pytest.approx([math.log(p(g)) for g in grams], abs=1e-4)
    whole = "abcd é dcba zz" * 3
    data = b"\0" * 4 + whole.encode()
    want = -sum(math.log(p(data[i : i + 5])) for i in range(len(data) - 4)) / (len(data) - 4)
    assert model.log_perplexities([7, 7, 9], [whole, "", None]) == pytest.approx([want, 0, 0], abs=1e-4)


def test_long_texts_are_scored_whole(spark, monkeypatch):
    docs = spark.createDataFrame([(7, "a banana bandana " * 5)], "l long, text string")
    shards = hash_arrays.shards_of(quality.train(docs))
    texts = ["a banana in a cabana " * 9, "bandanas", None, "nab " * 30]
    whole = quality.Model(shards).log_perplexities([7, 7, 7, 8], texts)
    monkeypatch.setattr(quality, "PIECE", 11)
    assert quality.Model(shards).log_perplexities([7, 7, 7, 8], texts) == pytest.approx(whole)


def test_counts_are_whole_however_often_they_are_handed_on(spark, monkeypatch):
    texts = ["abracadabra " * 9, None, "", "cad", "abra"] * 4
    docs = spark.createDataFrame([(i % 2, t) for i, t in enumerate(texts)], "l long, text string").coalesce(1)
    monkeypatch.setattr(quality, "HELD", 3)
    monkeypatch.setattr(quality, "PIECE", 7)
    want = Counter()
    for i, t in enumerate(texts):
        data = b"\0" * 4 + (t or "").encode()
        want.update((i % 2, int.from_bytes(data[k : k + 5], "big")) for k in range(len(data) - 4))
    assert {(r.l, r.code): r.c for r in quality.count_ngrams(docs).collect()} == dict(want)


def made(spark, extra):
    rng = random.Random(5)
    tables = {}
    for lang, letters in (("en", "etaoinshrdlu"), ("fr", "ésàçtnruqolx")):
        words = ["".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(300)]
        tables[lang] = [" ".join(rng.choice(words) for _ in range(8)) + "." for _ in range(150)]
    rows = [(i, " ".join(rng.sample(tables[lang], 20)), lang) for i, lang in enumerate(["en"] * 300 + ["fr"] * 200)]
    wrong = [(5000 + i, " ".join(rng.sample(tables["fr"], 20)), "en") for i in range(3)]
    noise = [(6000 + i, " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(150)), "en") for i in range(8)]
    salad = [(7000 + i, " ".join(rng.sample(rows[i][1].split(), len(rows[i][1].split()))), "en") for i in range(8)]
    return rows, wrong + noise + salad, spark.createDataFrame(rows + wrong + noise + salad + extra, "doc_id long, text string, lang string")


def test_bands_reject_what_only_its_own_text_vouches_for(spark):
    rows, bad, docs = made(spark, [(8000, None, "en"), (8001, "", None), (8002, rows_text(60), None)])
    got = {r.doc_id: r for r in quality.quality(docs).collect()}
    assert all(got[i].log_ppl > got[i].high and not got[i].kept for i, _, _ in bad)
    assert sum(got[i].kept for i, _, _ in rows) >= 0.99 * len(rows)
    assert got[8002].kept and not got[8000].kept and not got[8001].kept


def rows_text(n):
    return " ".join(f"word{i}" for i in range(n))


def test_bands_reject_what_lies_below(spark):
    rows = [("en\0" + "10", 2 + 0.01 * (i % 21)) for i in range(400)] + [("en\0" + "10", 0.7), ("en\0" + "10", 0.0), ("xx\0" + "7", 3.0)]
    rows += [("en\0" + "7", 4.0 + i) for i in range(5)]  # texts of a rare length don't set their own bar
    edges = {r.name: r for r in quality.bands(spark.createDataFrame(rows, "name string, log_ppl double")).collect()}
    assert 0.7 < edges["en\0" + "10"].low < 2 and edges["en\0" + "10"].high > 2.2 and edges["en\0" + "10"].n == 402
    assert edges["en\0" + "7"].high < 4
    assert edges["xx\0" + "7"].low == pytest.approx(3 - quality.FLOOR) and edges["xx\0" + "7"].high == pytest.approx(3 + quality.FLOOR)


def test_keep_good_keeps_the_rows_that_the_query_keeps(spark, monkeypatch):
    _, _, docs = made(spark, [(8000, None, "en"), (8001, "", None), (8002, rows_text(60), None), (None, rows_text(70), "fr"), (3, rows_text(80), "en")])
    docs = docs.select("doc_id", F.lit(1).alias("name"), "text", F.lit(2).alias("low"), "lang", F.lit(3).alias("c0"), F.lit(4).alias("l"))
    want = Counter(r.doc_id for r in quality.quality(docs).where("kept").collect())
    got = quality.keep_good(docs)
    assert got.columns == docs.columns and Counter(r.doc_id for r in got.collect()) == want
    monkeypatch.setattr(quality, "BROADCAST_BANDS", 0)
    assert Counter(r.doc_id for r in quality.keep_good(docs).collect()) == want
    assert quality.keep_good(docs.limit(0)).count() == 0


def test_arrays_of_other_stores_are_held_in_bounded_number(tmp_path, monkeypatch):
    keys = np.arange(0, 10_000, 3, dtype=np.uint64)
    shards = [hash_arrays.store(f"file://{tmp_path}/a", keys[i : i + 400], keys[i : i + 400]) for i in range(0, len(keys), 400)]
    h = np.array([9999, 0, 1, 3, 9998, 5000, 5001], np.uint64)
    want = [9999, 0, math.nan, 3, math.nan, math.nan, 5001]
    assert hash_arrays.Arrays(shards).find(h).tolist() == pytest.approx(want, nan_ok=True)
    monkeypatch.setattr(hash_arrays.fs, "LocalFileSystem", type(None))
    far = hash_arrays.Arrays(shards)
    assert far.find(h).tolist() == pytest.approx(want, nan_ok=True)
    assert far.find(keys).tolist() == keys.tolist() and len(far.open) == hash_arrays.LOADED
