"""Letters that lower() changes by what stands beside them, through the positional index."""

from tiersift.llm import decontaminate


def test_words_are_the_same_wherever_they_stand(spark):
    words = [f"ΛΟΓ{chr(0x391 + i)}Σ" for i in range(9)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, ".Α ".join(words))], "doc_id long, text string")
    bench = spark.createDataFrame([("a", ".".join(words)), ("b", "x")], "item_id string, text string")
    rows = decontaminate.contamination(docs, bench).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_hit, r.n_items) for r in rows] == [(9, 9, 1), (17, 0, 0)]
