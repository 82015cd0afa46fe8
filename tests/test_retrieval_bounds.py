"""What the arms of retrieval pass on, send and repeat: bounded by the queries and tasks, whatever the documents."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tiersift.operators import retrieval
from tiersift.plans import oracles, queries


@pytest.fixture
def passed(monkeypatch):
    """The numbers of rows that were ranked."""
    counts, ranked = [], retrieval.ranked

    def counted(df, *a, **b):
        counts.append(df.count())
        return ranked(df, *a, **b)

    monkeypatch.setattr(retrieval, "ranked", counted)
    return counts


def texts(n):
    rng = np.random.default_rng(3)
    return [" ".join(rng.choice([f"w{i}" for i in range(40)], rng.integers(1, 30)).tolist() + ["all"] * (k % 3)) for k in range(n)]


def test_bm25_passes_on_the_best_of_each_task(spark, passed):
    docs = spark.createDataFrame(list(enumerate(texts(600))), "id long, text string").repartition(4)
    asked = spark.createDataFrame([(i, f"w{i} w{i + 1} all nowhere") for i in range(5)], "qid long, text string")
    got = retrieval.bm25_topk(asked, docs, 3).collect()
    assert len(got) == 15 and passed[0] <= 3 * 5 * 4  # of nearly 3,000 pairs that share a term


@pytest.mark.parametrize("kind", ["long", "string"])
def test_bm25_ways_agree(spark, kind):
    rows = [(i // 7 if i > 280 else i, t) for i, t in enumerate(texts(300))] + [(None, "w1 w2 all"), (None, "w3"), (400, None), (401, "")]
    docs = spark.createDataFrame(rows, "id long, text string").select(F.col("id").cast(kind).alias("id"), "text").repartition(3)
    asked = spark.createDataFrame([(i, f"w{i} w{i + 1} w{i + 1} all nowhere") for i in range(6)] + [(9, "nowhere"), (10, None)], "qid long, text string")
    ways = [sorted((r.qid, r.rank, str(r.id), r.score) for r in retrieval.bm25_topk(asked, docs, 20, most=most).collect()) for most in (1000, 0)]
    assert ways[0] == ways[1] and len(ways[0]) == 120
    assert retrieval.bm25_topk(asked, docs.limit(0), 20).count() == retrieval.bm25_topk(asked.limit(0), docs, 20).count() == 0


@pytest.mark.parametrize("name", ["bm25_topk", "bm25_topk_filtered", "cross_query_rrf", "multi_query_fuse", "rank_percent", "min_max_scores"])
def test_ids_that_repeat_equal_sql(spark, tmp_path, name):
    words = texts(90)
    docs = [(i % 60, t, f"src{i % 4}") for i, t in enumerate(words)] + [(3, words[3], "src0"), (3, words[63], None), (None, "w1 w2 all all", "src1")]
    tables = {"documents": (docs[:60] if name == "bm25_topk_filtered" else docs, "doc_id long, text string, source string"), "benchmark": ([(i, f"w{i} w{i + 2} all") for i in range(12)], "item_id long, text string"), "labels": ([(i, int(i % 3 > 0)) for i in range(50)], "doc_id long, quality int")}
    base = duckdb.connect()
    for t, (rows, kind) in tables.items():
        spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/{t}.parquet")
        base.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    got = queries.QUERIES[name](spark, str(tmp_path))
    want = base.execute(f"SELECT {', '.join(got.columns)} FROM ({oracles.ORACLE_SQL[name]})").fetchall()
    assert want and sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_dense_passes_on_the_best_of_each_task(spark, passed, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK", 64)
    rng = np.random.default_rng(5)
    rows = np.concatenate([rng.normal(size=(700, 8)), np.repeat(rng.normal(size=(1, 8)), 300, 0)])[rng.permutation(1000)]
    every = [(i, rows[i].tolist()) for i in range(1000)]
    vectors = spark.createDataFrame(every, "id long, embedding array<float>").repartition(2)
    got = sorted((r.qid, r.rank, r.id) for r in retrieval.dense_topk(vectors.where("id % 20 = 0").withColumnRenamed("id", "qid"), vectors, 5).collect())
    unit = rows.astype(np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    far = np.round(1 - unit @ unit.T, retrieval.PLACES) + 0.0
    assert got == [(q, k + 1, int(i)) for q in range(0, 1000, 20) for k, i in enumerate(np.lexsort((np.arange(1000), far[q]))[:5])]
    assert passed[0] <= 5 * 50 * 2


def test_questions_hits_go_to_the_documents(spark):
    plan = queries.citations(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan.split("Aggregate")[0]
