"""The engine's operators on small fixtures, and the entry points."""

import math

import pytest
from pyspark.sql import functions as F

from tiersift.functions import scalars
from tiersift.functions.sections import is_method, is_noise, normal_title
from tiersift.operators import hierarchy, retrieval, sessions
from tiersift.sources import corpus, tables


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first().x


@pytest.mark.parametrize("title, normal, noise, method", [("3. References ", "references", True, False), ("II) Proposed  Method", "proposed method", False, True), ("Author Contributions", "author contributions", True, False), ("Methodical", "methodical", False, False), ("研究方法论", "研究方法论", False, True), ("Preference learning", "preference learning", True, False), (None, "", False, False)])
def test_titles(spark, title, normal, noise, method):
    t = F.lit(title).cast("string")
    assert (one(spark, normal_title(t)), one(spark, is_noise(t)), one(spark, is_method(t))) == (normal, noise, method)


def test_scores(spark):
    for d, want in [(0.0, 1.0), (-1e-9, 1.0), (1e-9, 1 / (1e-9 + 1e-8)), (0.5, 1 / (0.5 + 1e-8))]:
        assert one(spark, scalars.distance_score(F.lit(d))) == pytest.approx(want)
    assert one(spark, scalars.positive_score(F.lit(-1.0))) == pytest.approx(1 / (2 + 1e-8))


def test_expiry(spark):
    now, day = 1_700_000_000, 86_400
    cases = [(now - 30 * day, False), (now - 30 * day - 1, True), (0, False), (None, False), ((now + day) * 1000, False), ((now - 40 * day) * 1000, False)]
    rows = spark.createDataFrame([(i, at) for i, (at, _) in enumerate(cases)], "i int, at long").select("i", scalars.is_expired(F.col("at"), now).alias("x")).collect()
    assert {r.i: r.x for r in rows} == {i: want for i, (_, want) in enumerate(cases)}


def test_frames(spark):
    for n in (0, 2, 3, 7, 9):
        h = F.array(*[F.lit(i) for i in range(n)]).cast("array<int>")
        assert one(spark, scalars.last_turns(h, 2)) == list(range(n))[-2:]
        assert one(spark, scalars.prior_turns(h, 2, 5)) == list(range(n))[max(0, n - 7) : max(0, n - 2)]


def test_rank_fusion_ignores_scale(spark):
    rows = [(1, i, s, m) for i, (s, m) in enumerate([(0.8, 0.1), (0.2, 0.9), (0.5, 0.5)])]
    a = retrieval.rank_fusion(spark.createDataFrame(rows, "qid int, id int, o double, m double"), "o", "m").collect()
    b = retrieval.rank_fusion(spark.createDataFrame([(q, i, o * 100, m * 7) for q, i, o, m in rows], "qid int, id int, o double, m double"), "o", "m").collect()
    assert {r.id: r.fused_score for r in a} == {r.id: r.fused_score for r in b}
    assert {r.id: r.rank_original for r in a} == {0: 1, 1: 3, 2: 2}


def test_bm25_equals_brute_force(spark):
    texts = ["the cat sat", "the dog sat the", "a bird", "", None, "the the the cat"]
    queries = ["cat sat", "the the", "", "zzz"]
    words = [(t or "").split() for t in texts]
    n, avgdl = len(words), sum(map(len, words)) / len(words)
    vocab = {w for ws in words for w in ws}
    idf = {w: math.log(n - sum(w in ws for ws in words) + 0.5) - math.log(sum(w in ws for ws in words) + 0.5) for w in vocab}
    mean = sum(idf.values()) / len(idf)
    want = {}
    for q, text in enumerate(queries):
        for d, ws in enumerate(words):
            s = sum((idf[w] if idf[w] >= 0 else 0.25 * mean) * ws.count(w) * 2.5 / (ws.count(w) + 1.5 * (0.25 + 0.75 * len(ws) / avgdl)) for w in text.split() if w in ws)
            if s > 0:
                want[q, d] = s
    got = retrieval.bm25_topk(spark.createDataFrame(list(enumerate(queries)), "qid int, text string"), spark.createDataFrame(list(enumerate(texts)), "id int, text string"), 10)
    assert {(r.qid, r.id): r.score for r in got.collect()} == pytest.approx(want, abs=1e-5)


def test_dense_in_blocks(spark):
    vectors = spark.createDataFrame([(i, [math.cos(i * 0.7), math.sin(i * 0.7)]) for i in range(40)] + [(99, None)], "id long, embedding array<float>")
    asked = vectors.where("id % 20 = 0").withColumnRenamed("id", "qid")
    past, parts = (sorted((r.qid, r.rank, r.id) for r in retrieval.dense_topk(asked, vectors, 5, 3, most).collect()) for most in (100, 0))
    assert past == parts and len(past) == 10
    assert retrieval.dense_topk(asked.limit(0), vectors, 5).count() == 0


def pack(texts, budget):
    taken, length = [], 0
    for t in texts:
        room = budget - length
        if room <= 0:
            break
        if len(t) > room:
            if taken:
                continue
            t = t[:room] if room <= len(scalars.CUT_MARK) else t[: room - len(scalars.CUT_MARK)].rstrip() + scalars.CUT_MARK
            if not t:
                continue
        taken.append(t)
        length += len(t)
    return taken, length


@pytest.mark.parametrize("sizes, budget", [([1200, 10], 200), ([50, 300, 20], 100), ([5, 5], 5), ([40], 8), ([0, 3], 10), ([10, 95, 90], 100)])
def test_packing(spark, sizes, budget):
    texts = ["x" * n for n in sizes]
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "q int, o int, text string")
    got = hierarchy.packed(rows, "q", "o", "text", budget).first()
    assert (got.blocks, got.total_length) == pack(texts, budget)


def test_promotion(spark):
    hits = spark.createDataFrame([(1, 1, 0.92), (1, 2, 0.82), (1, 3, 0.79), (1, 4, -1.0)], "qid int, id int, score double")
    parents = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, None)], "id int, parent_id string")
    got = {r.parent_id: (r.score, r.rank) for r in retrieval.promote(hits, parents, "other").collect()}
    assert got["b"] == (pytest.approx(0.82 + 0.3 * 0.805 + 0.15), 1) and got["a"] == (pytest.approx(0.92 * 1.3), 2)
    got = {r.parent_id: r.score for r in retrieval.promote(hits, parents, "general_overview").collect()}
    assert got["b"] == pytest.approx(0.82 + 0.18 * 0.805 + 0.08)


def test_compare_and_set(spark):
    stored = spark.createDataFrame([(1, ["a"], "s"), (2, ["b"], "s"), (3, None, None)], "id int, history array<string>, summary string")
    updates = spark.createDataFrame([(1, ["a"], [], "new"), (2, ["old"], [], "new")], "id int, seen array<string>, history array<string>, summary string")
    got = {r.id: r.summary for r in sessions.compare_and_set(stored, updates).collect()}
    assert got == {1: "new", 2: "s", 3: None}


def test_files_and_snapshots(spark, tmp_path):
    (tmp_path / "in" / "below").mkdir(parents=True)
    for name in ("a.pdf", "B.PDF", "c.txt", "below/d.pdf"):
        (tmp_path / "in" / name).write_bytes(b"%PDF-1" + name.encode())
    listed = corpus.files(spark, str(tmp_path / "in"))
    assert {r["name"] for r in listed.collect()} == {"a.pdf", "B.PDF"}
    paths = [r.path for r in corpus.by_path(listed).collect()]
    assert [r.path for r in corpus.selected(listed, '["%s", "nowhere", "%s", "%s"]' % (paths[1], paths[0], paths[1])).orderBy("place").collect()] == [paths[1], paths[0], paths[1]]
    assert corpus.selected(listed, "no json").count() == corpus.selected(listed, None).count() == 0
    contents = spark.createDataFrame([("b", b"2"), ("a", b"1")], "path string, content binary")
    assert corpus.folder_name(contents) == __import__("hashlib").md5(b"12").hexdigest() and corpus.folder_name(contents.limit(0)) is None
    store = str(tmp_path / "s")
    tables.save_snapshot({"element": spark.range(3)}, store)
    tables.save_snapshot({"element": tables.upserted(tables.load_snapshot(spark, store, "element"), spark.range(2, 5).toDF("id"), "id")}, store)  # reads what it replaces
    assert tables.load_snapshot(spark, store, "element").count() == 5 and tables.snapshot_there(spark, store) and not tables.snapshot_there(spark, store + "x")


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
