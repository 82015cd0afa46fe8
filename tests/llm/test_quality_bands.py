"""The bands reject word salad and table junk and keep clean texts."""

import random

from tiersift.llm import quality


def test_bands(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    sentences = [" ".join(rng.choice(words) for _ in range(8)) + "." for _ in range(120)]
    rows = [(i, " ".join(rng.sample(sentences, 20)), "en") for i in range(300)]
    salad, table = [], []
    for k in range(4):
        w = rows[k][1].split()
        rng.shuffle(w)
        salad.append((1000 + k, " ".join(w), "en"))
        table.append((2000 + k, " | ".join(rng.choice(words).capitalize() for _ in range(120)), "en"))
    few = [(3000, rows[0][1] + " one more", "xx"), (3001, rows[1][1], "xx")]
    docs = spark.createDataFrame(rows + salad + table + few, "doc_id long, text string, lang string")
    kept = {r.doc_id for r in quality.quality(docs).where("kept").collect()}
    assert not kept & {r[0] for r in salad + table}
    assert kept == {r[0] for r in rows + few}
