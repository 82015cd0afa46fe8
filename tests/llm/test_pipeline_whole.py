"""The whole pipeline against plain Python, stage by stage, each on the rows that its predecessor kept."""

import hashlib
import random
from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F
from test_operators import brute_contamination, brute_features
from test_pipeline_duplicates import shingles
from test_quality_model import brute_kneser_ney, rows_text
from tiersift.llm import language, quality
from tiersift.llm.common import cut
from tiersift.llm.queries import vocabulary

COLUMNS = "doc_id long, text string, lang string, source string, name string, key long, c0 int, row_key long"


def tables(spark, folder):
    rng, prose = random.Random(6), {}
    for lang, letters in (("en", "etaoinshrdlu"), ("fr", "ésàçtnruqolx")):
        words = ["".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(300)]
        prose[lang] = [" ".join(rng.choice(words) for _ in range(8)) + "." for _ in range(150)]
    texts = [(" ".join(rng.sample(prose[lang], 20)), lang) for lang in ["en"] * 150 + ["fr"] * 90]
    items = [" ".join(f"item{i}word{j}" for j in range(10)) for i in range(4)]
    near = [(t.replace(t.split()[40], "other", 1), lang) for t, lang in texts[:6]]
    own = lambda lang: " ".join(rng.sample(prose[lang], 20))
    leaks = [(f"{own(lang)} {items[i % 4].upper()} and {items[(i + 1) % 4]}", lang) for i, lang in enumerate(["en"] * 4)]
    single = [(own("en") + " " + items[0], "en")]
    noise = [(" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(150)), "en") for _ in range(4)]
    odd = [(None, "en"), ("", None), ("12 34 " * 60, "en"), ("short text", "en"), ("the same three words " * 60, "en"), (rows_text(90), None), (" ".join(rng.choice(prose["en"]) for _ in range(3000)), "en")]
    made = [(i, t, lang) for i, (t, lang) in enumerate(texts + near + texts[:3] + leaks + single + noise + odd)]
    made += [(None, texts[30][0] + " tail", "en"), (None, None, None), made[50], made[50], (51, texts[60][0], "en")]
    rows = [(i, t, lang, "s", "x", 1, 2, 3) for i, t, lang in made]
    spark.createDataFrame(rows, COLUMNS).repartition(4).write.parquet(f"{folder}/documents.parquet")
    bench = [(i, t, "term") for i, t in enumerate([*items, None, ""])]
    spark.createDataFrame(bench, "item_id long, text string, term string").write.parquet(f"{folder}/benchmark.parquet")


def keyed(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def check_language(before, after):
    net, rows = language.train(before), keyed(before)
    want = Counter()
    for (d, t), n in rows.items():
        named, scores = net.predict([t])
        if named[0] != "und" and scores[0] >= language.LEAST_SCORE:
            want[d, t] = n
    assert keyed(after) == want
    assert not any(t is None or not any(c.isalpha() for c in t) for _, t in want)
    assert sum(want.values()) >= 0.95 * sum(n for (_, t), n in rows.items() if t and "." in t)


def check_quality(spark, before, after):
    lang, text = F.col("lang"), F.col("text")
    rows = before.select("doc_id", "text", quality.band_of(lang, text).alias("band"), quality.model_of(lang, text, False).alias("own"), quality.model_of(lang, text, True).alias("other")).collect()
    models = {m: brute_kneser_ney([r.text or "" for r in rows if r.own == m], quality.ORDER) for m in {r.other for r in rows}}
    scored = []
    for r in rows:
        data = b"\0" * 4 + (r.text or "").encode()
        p, once = models[r.other], Counter(data[i : i + 5] for i in range(len(data) - 4))
        scored.append(-sum(n * quality.math.log(p(g)) for g, n in once.items()) / max(1, len(data) - 4))
    edges = {b.name: b for b in quality.bands(spark.createDataFrame([(r.band, s) for r, s in zip(rows, scored)], "name string, log_ppl double")).collect()}
    got, unsure, rejected = keyed(after), 0, 0
    for r, s in zip(rows, scored):
        f, band = brute_features(r.text), edges[r.band]
        base, low, high = f[0] < 50 or 100 * f[4] > 50 * f[0], band.low or 0.0, quality.math.inf if band.high is None else band.high
        if not base and min(abs(s - low), abs(s - high)) < 0.01:
            unsure += 1  # the bands' steps are of rounded scores
            continue
        assert (got[r.doc_id, r.text] > 0) == (not base and low <= s <= high), (r.doc_id, s, low, high)
        rejected += not base and not low <= s <= high
    assert unsure <= 0.03 * len(rows) and rejected >= 4


def check_duplicates(before, after):
    rows = [(r.doc_id, r.text) for r in before.collect()]
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                root[find(i)] = find(j)
    groups = {}
    for i, row in enumerate(rows):
        groups.setdefault(find(i), []).append(row)
    want = Counter(min(((d is None, d or 0) for d, _ in g)) for g in groups.values())
    kept = keyed(after)
    assert Counter((d is None, d or 0) for d, _ in kept.elements()) == want and set(kept) <= set(rows)
    assert len(groups) < len(rows) - 8


def test_pipeline_equals_brute_force(spark, tmp_path):
    folder = str(tmp_path)
    tables(spark, folder)
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        after = cut(stage(spark, docs, folder), f"test-{name}")
        seen.append((name, docs, after))
        docs = after
    assert [n for n, _, _ in seen] == ["language", "quality", "near_duplicates", "decontamination", "bpe"]
    assert all(after.columns == before.columns for _, before, after in seen[:-1])
    check_language(*seen[0][1:])
    check_quality(spark, *seen[1][1:])
    check_duplicates(*seen[2][1:])

    _, before, after = seen[3]
    rows, items = keyed(before), [(str(r.item_id), r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    verdicts = [v[-1] for v in brute_contamination(list(rows), items)]
    assert keyed(after) == Counter({row: n for (row, n), bad in zip(rows.items(), verdicts) if not bad}) and sum(verdicts) >= 3

    from tokenizers import Tokenizer

    model, want = Tokenizer.from_file(vocabulary("byte_bpe_50k.json")), Counter()
    for (d, t), n in keyed(seen[4][1]).items():
        ids = model.encode(t or "", add_special_tokens=False).ids
        back = model.decode(ids, skip_special_tokens=False)
        want[d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()] += n
    result = lambda df: Counter(tuple(r) for r in df.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())
    assert result(seen[4][2]) == want
    assert result(corpus_pipeline.run(spark, folder)) == want


def test_empty_pipeline(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "a")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
