"""The operators against brute force, on fixtures with nulls, empty and long texts, ties, repeats and clashing names."""

import base64
import hashlib
import re
import zlib
from collections import Counter

import pytest
from xxhash import xxh64_intdigest

from tiersift.llm import decontaminate, dom, hash_arrays, language, licences, quality, simhash, token_bins, token_codec, token_counts, warc
from tiersift.llm.queries import vocabulary

TEXTS = [
    None,
    "",
    " ",
    "one",
    "Two words",
    "The quick brown fox jumps over the lazy dog near the river bank today",
    "the quick brown fox jumps over the lazy dog near the river bank today",
    "The quick brown fox jumps over the lazy dog near the river bank tonight",
    "línea uno\nlínea dos\n\nlínea uno\n\tfin  de   texto ",
    "special <|endoftext|> inside </s> <s> text",
    "naïve café 東京 🙂 ﬁ▁x y",
    "word " * 3000,
    "Released under the MIT License.",
]


def documents(spark, texts=TEXTS):
    rows = [(i, t, "en" if i % 2 else "fr", "k", i) for i, t in enumerate(texts)]
    rows += [(None, "null id", None, None, None), (5, texts[5], "en", "k", 0)] if len(texts) > 5 else []
    # columns whose names the operators use themselves
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, row_key string, n long")


def empty(spark):
    return documents(spark, []).limit(0)


def by_row(df, *cols):
    return Counter(tuple(r[c] for c in cols) for r in df.collect())


def test_token_bins(spark):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    docs = documents(spark)
    got = token_bins.read(token_bins.write(docs, vocabulary("byte_bpe_50k.json"), 50257, 2)).collect()
    want = Counter()
    for r in docs.collect():
        want[(r.doc_id, *model.encode(r.text or "", add_special_tokens=False).ids, 2)] += 1
    assert Counter((r.doc_id, *r.ids) for r in got) == want
    got.sort(key=lambda r: r.start)
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids)
        assert r.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in r.ids))
        at += r.n_tokens
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))
    assert token_bins.read(token_bins.write(empty(spark), vocabulary("byte_bpe_50k.json"), 50257, 2)).count() == 0


def test_bpe_codec(spark):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    docs, want = documents(spark), Counter()
    for r in docs.collect():
        ids = model.encode(r.text or "", add_special_tokens=False).ids
        back = model.decode(ids, skip_special_tokens=False)
        want[(r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())] += 1
    got = token_codec.round_trip(docs, vocabulary("byte_bpe_50k.json"))
    assert by_row(got, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want
    assert token_codec.round_trip(empty(spark), vocabulary("byte_bpe_50k.json")).count() == 0


def test_token_counts(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    docs = documents(spark)
    want = Counter((r.doc_id, len((r.text or "").encode()), len(model.encode(r.text or "")), len(model.encode(r.text or "")) > 4096) for r in docs.collect())
    assert by_row(token_counts.token_counts(docs, vocabulary("piece_bpe_32k.model")), "doc_id", "n_bytes", "n_tokens", "over_limit") == want
    assert token_counts.token_counts(empty(spark), vocabulary("piece_bpe_32k.model")).count() == 0


def test_warc(spark):
    html = ["<p>a</p>", "<p>b</p>", "<p>a</p>", None, "", "<p>é\r\n\r\nx</p>", "<p>a</p>"]
    pages = spark.createDataFrame([(i, None if i == 1 else f"http://h/{i}", h, "x") for i, h in enumerate(html)], "page_id long, url string, html string, winner string")
    best = {h or "": i for i, h in enumerate(html)}
    want = Counter()
    for i, h in enumerate(html):
        data, top = (h or "").encode(), best[h or ""]
        want[(i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if top == i else "revisit", None if top == i else top)] += 1
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert by_row(warc.captures(pages), *columns) == want
    nested = warc.transactions(warc.read(warc.write(pages))).collect()
    assert len(nested) == len(html) and all(r.request and r.metadata for r in nested)
    assert warc.captures(pages.limit(0)).count() == 0


def brute_contamination(docs, items):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    windows = {}
    for name, t in items:
        w = cut(t)
        for i in range(max(1, len(w) - 7)) if w else ():
            windows.setdefault(tuple(w[i : i + 8]), set()).add(name)
    for d, t in docs:
        w, hit, names = cut(t), set(), set()
        for i in range(len(w)):
            for k in range(1, 9):
                if found := windows.get(tuple(w[i : i + k])) if i + k <= len(w) else None:
                    hit |= set(range(i, i + k))
                    names |= found
        yield d, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), len(names) >= 2


def test_decontamination(spark):
    a = " ".join(f"alpha{i}" for i in range(12)).replace("alpha3", "the").replace("alpha4", "the")
    items = [(1, a), (2, "Short item"), (10, "the " * 9), (3, None), (4, ""), (5, "ÉTUDE de cas " * 4)]
    texts = [None, "", a.upper() + " tail", "x " + " ".join(a.split()[2:11]) + " short ITEM y", "the " * 30, "short, item" * 3, "Étude de cas " * 5, "ÉTUDE DE CAS " * 5, a[:40]]
    docs = documents(spark, texts)
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, term long")
    want = Counter(brute_contamination([(r.doc_id, r.text) for r in docs.collect()], [(str(i), t) for i, t in items]))
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert by_row(decontaminate.contamination(docs, bench), *columns) == want
    assert decontaminate.contamination(empty(spark), bench).count() == 0
    assert {r.n_items for r in decontaminate.contamination(docs, bench.limit(0)).collect()} == {0}
    kept = decontaminate.keep_clean(docs, bench)
    assert kept.columns == docs.columns and kept.count() == sum(n for k, n in want.items() if not k[-1])


def brute_near(docs, items, counts):
    """Items whose two rarest different terms stand at most 8 words apart."""
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")
    for d, t in docs:
        w, near = [x.lower() for x in cut(t)], set()
        for name, text in items:
            best = sorted({x.lower() for x in cut(text)}, key=lambda x: (counts[x], x))[:2]
            if len(best) == 2:
                a, b = ([i for i, x in enumerate(w) if x == y] for y in best)
                if any(abs(i - j) <= 8 for i in a for j in b):
                    near.add(name)
        yield d, len(near)


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "a b c a d"), (2, "d a")], "row_key long, text string")
    terms = spark.createDataFrame([("a", ""), ("d", "")], "term string, with string")
    pairs = spark.createDataFrame([(7, "a", "d")], "query int, term string, other string")
    near = decontaminate.proximity(decontaminate.positional_index(docs, terms), pairs, 1)
    assert by_row(near, "row_key", "pos", "other_pos") == Counter({(1, 4, 3): 1, (2, 1, 0): 1})


@pytest.mark.parametrize("bound", [decontaminate.BROADCAST_ROWS, -1])
def test_decontamination_of_random_texts(spark, monkeypatch, bound):
    import random

    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", bound)
    if bound < 0:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    rng = random.Random(8)
    vocab = ["the", "of", "a"] * 6 + [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([1, 2, 3, 4, 5, 7, 8, 9, 12, 15, 16, 30])))) for i in range(40)]
    texts = [None, "the " * 300]
    for _ in range(60):
        t = [rng.choice(vocab) for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            w = rng.choice(items)[1].split()
            a = rng.randrange(len(w))
            at = rng.randint(0, len(t))
            t[at:at] = w[a : a + rng.randint(1, 14)]
        texts.append(", ".join(t).title() if rng.random() < 0.3 else " ".join(t))
    docs = documents(spark, texts)
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").lower())
    near = dict(brute_near(rows, items, Counter(w for _, t in rows for w in words(t))))
    want = Counter((*x, near[x[0]]) for x in brute_contamination(rows, [(str(i), t) for i, t in items]))
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_near")
    try:
        assert by_row(decontaminate.contamination(docs, bench), *columns) == want
        clean = Counter(k[0] for k in want.elements() if not k[5])
        assert by_row(decontaminate.keep_clean(docs, bench), "doc_id") == Counter({(k,): v for k, v in clean.items()})
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_language(spark):
    base = {"en": "the and of with that this house people ", "de": "der und nicht eine haus leute straße über ", "fr": "le la dans être maison élève peuple où "}
    rows = [(i, " ".join((base[k] * 3).split()[i % 7 :][:15]), k) for i in range(240) for k in base]
    rows = [(3 * i + j, t, k) for j, k0 in enumerate(base) for i, t, k in rows if k == k0]
    docs = spark.createDataFrame([*rows, (9001, None, "en"), (9002, "123 !!", "en"), (9003, "", None), (None, "der und nicht", None)], "doc_id long, text string, lang string")
    got = language.languages(docs).collect()
    assert len(got) == len(rows) + 4 and all(0 <= r.score <= 1 for r in got)
    known = {i: k for i, _, k in rows}
    held = [r for r in got if r.held_out and r.doc_id in known]
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert sum(r.lang_pred == known[r.doc_id] for r in held) >= 0.95 * len(held)
    assert {r.lang_pred for r in got if r.doc_id in (9001, 9002, 9003)} == {"und"}
    assert language.languages(empty(spark)).count() == 0
    unlabelled = docs.selectExpr("doc_id", "text", "cast(null as string) lang").limit(3)
    assert {r.lang_pred for r in language.languages(unlabelled).collect()} == {"und"}


def brute_features(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines, seen, repeats = (text or "").split("\n"), set(), 0
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            repeats += x in seen
            seen.add(x)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), repeats, len(covered)


def test_quality(spark):
    docs = documents(spark, [*TEXTS, "a b c a b c # $ <x>\na b c", " ".join(f"w{i}" for i in range(60)) * 2])
    got = quality.quality(docs)
    want = Counter((r.doc_id, *brute_features(r.text)) for r in docs.collect())
    assert by_row(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words") == want
    for r in got.collect():
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert quality.quality(empty(spark)).count() == 0
    assert quality.keep_good(docs).columns == docs.columns


def test_quality_model_is_a_distribution(spark):
    docs = spark.createDataFrame([(0, "abracadabra abra cad"), (0, "banana")], "l long, text string")
    model = quality.Model(hash_arrays.shards_of(quality.train(docs)))
    import numpy as np

    for context in (b"abra", b"zzzz", b"\0\0\0\0", b"anan"):
        head = int.from_bytes(context, "big") << 8
        p = np.exp(model.log_probability(np.zeros(256, np.uint64), np.array([head | b for b in range(256)], np.uint64)))
        assert p.sum() == pytest.approx(1, abs=1e-4)


def test_main_text():
    pages = dom.labelled_pages(120, seed=77)
    got = dom.trained().extract([h for h, _ in pages])
    assert sum(a == b for a, (_, b) in zip(got, pages)) >= 0.95 * len(pages)


def test_main_text_cases(spark):
    article = "<html><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><div class='ad'>Buy now.</div><article><h1>A title &amp; more</h1><p><b>First  para<br>graph of the text, which is long.<p>Second\n one of the text, also long.</p></article><footer>&copy; x</footer>"
    pages = spark.createDataFrame([(1, "u", article), (2, None, None), (None, "u", ""), (3, "u", "<p>" * 3000), (4, "u", "<a href='x"), (1, "u", article)], "page_id long, url string, html string")
    got = dom.main_texts(pages).collect()
    texts = {r.page_id: r.text for r in got}
    assert len(got) == 6 and texts[1] == "A title & more\nFirst para graph of the text, which is long.\nSecond one of the text, also long."
    assert texts[2] == "" and texts[None] == "" and all(r.n_chars == len(r.text) for r in got)
    assert dom.main_texts(pages.limit(0)).count() == 0


def test_sum_product_equals_enumeration():
    import itertools

    import numpy as np

    rng = np.random.default_rng(1)
    parents, kinds = np.array([-1, 0, 0, 1, 1, 3]), rng.integers(0, 4, 6)
    unary, pair = rng.normal(size=6), rng.normal(size=(4, 2, 2))
    levels = [np.array([0]), np.array([1, 2]), np.array([3, 4]), np.array([5])]
    weights = {s: np.exp(sum(unary[i] * s[i] for i in range(6)) + sum(pair[kinds[i], s[parents[i]], s[i]] for i in range(1, 6))) for s in itertools.product((0, 1), repeat=6)}
    total = sum(weights.values())
    marginal, _, log_z = dom.sum_product(unary, pair, parents, kinds, levels)
    by_node, _, by_node_z = dom._by_node(unary, pair, parents, kinds, list(range(6)), 1)
    assert by_node == pytest.approx(marginal) and by_node_z == pytest.approx(log_z)
    assert log_z == pytest.approx(np.log(total))
    assert marginal == pytest.approx([sum(w for s, w in weights.items() if s[i]) / total for i in range(6)])


def test_licences(spark):
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
    names = " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    texts = [None, "", "x. Released under the MIT License.", "a\nLicensed under CC BY-NC 4.0.\nb", bsd, bsd + names, "the MIT license is not a sentence here", "MIT License\nLicensed under the Apache License, Version 2.0."]
    got = {r.doc_id: r.licences for r in licences.scan(documents(spark, texts)).collect() if r.doc_id is not None}
    assert [got[i] for i in range(8)] == ["", "", "MIT", "CC-BY-NC-4.0", "BSD-2-Clause", "BSD-3-Clause", "", "Apache-2.0,MIT"]
    assert licences.scan(empty(spark)).count() == 0


def brute_simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark):
    long = " ".join(f"term{i}" for i in range(400))
    texts = [*TEXTS, *[long + f" tail{i}" for i in range(6)], long]
    docs = documents(spark, texts)
    rows = [(r.doc_id, brute_simhash(r.text)) for r in docs.collect()]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least.setdefault(find(i), []).append(d)
    want = Counter((d, f"{fp:016x}", min((x for x in least[find(i)] if x is not None), default=None)) for i, (d, fp) in enumerate(rows))
    assert by_row(simhash.near_duplicates(docs), "doc_id", "fingerprint", "component_id") == want
    assert simhash.near_duplicates(empty(spark)).count() == 0
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns and kept.count() == len(least)


def test_simhash_blocks_lose_no_link(spark):
    import random

    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(20)]
    fps = {b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 3))) for b in base for _ in range(12)}
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    edges = simhash.links(spark.createDataFrame(signed, "fp long"), block=3).collect()
    root = {f[0]: f[0] for f in signed}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in edges:
        root[find(r.a)] = find(r.b)
    for a in fps:
        for b in fps:
            if (a ^ b).bit_count() <= 3:
                assert find(a - (1 << 64) if a >> 63 else a) == find(b - (1 << 64) if b >> 63 else b)
