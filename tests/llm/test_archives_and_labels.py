"""Records in any order, file and number of links; languages in any number; blocks and shards of token files; shared folders."""

import numpy as np
import pytest

from tiersift.llm import common, language, token_bins, warc
from tiersift.llm.queries import vocabulary


def test_transactions_by_any_link(spark, tmp_path):
    def rec(kind, name, *to):
        block = b"HTTP/1.1 200 OK\r\n\r\nhi" if kind == "response" else b"page-id: 7"
        return warc.record(kind, f"urn:{name}", [("WARC-Concurrent-To", f"<urn:{t}>") for t in to], block)

    files = {
        "a.warc.gz": rec("metadata", "m1", "q1", "r1") + rec("request", "q1", "r1") + rec("warcinfo", "w"),
        "b.warc.gz": rec("response", "r2", "q2", "m2") + rec("response", "r1") + rec("metadata", "m2"),
        "c.warc.gz": rec("request", "q2") + rec("request", "q9", "r9") + rec("response", "r3") + rec("metadata", "m4", "r1", "r3"),
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    paths = spark.createDataFrame([(f"file://{tmp_path}/{n}",) for n in files], "path string")
    got = {r.capture_id: (r.request and r.request.record_id, r.metadata and r.metadata.record_id) for r in warc.transactions(warc.read(paths)).collect()}
    assert got == {"urn:r1": ("urn:q1", "urn:m1"), "urn:r2": ("urn:q2", "urn:m2"), "urn:r3": (None, "urn:m4")}


def test_no_language_is_left_out(spark):
    rows = [(3 * i, f"{chr(97 + i % 26)}{chr(97 + i // 26)} " * 9, f"lang{i}") for i in range(120)] * 2
    labels, x, y = language.training_windows(spark.createDataFrame(rows + [(1, None, "none"), (2, "12 34", "digits")], "doc_id long, text string, lang string"))
    want = {f"lang{i}" for i in range(120) if __import__("zlib").crc32(str(3 * i).encode()) % 3 != 1}
    assert set(labels) == want and set(y.tolist()) == set(range(len(want))) and x.shape == (len(y), language.WINDOW)


def test_token_files_of_several_blocks_and_shards(spark, monkeypatch, tmp_path):
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 50257, int(n)).astype(np.uint32) for n in rng.integers(1, 400, 60)]
    path = f"file://{tmp_path}/one.bits"
    token_bins.write_shard(path, list(range(59)) + [None], docs, token_bins.width(50257), block_ids=128)
    shard, every = token_bins.Shard(path), np.concatenate(docs)
    assert len(shard.blocks) > 50 and shard.doc_ids[-1] is None
    for k in (0, 7, 31, 59):
        assert np.array_equal(shard.document(k), docs[k])
    for a, b in ((0, 1), (127, 129), (128, 256), (5, 5), (1000, len(every)), (0, len(every))):
        assert np.array_equal(shard.ids(a, b), every[a:b])
    assert all(np.array_equal(x, docs[i]) for i, (_, _, x) in enumerate(shard.documents()))


def test_a_cluster_needs_a_shared_folder(spark):
    class Cluster:
        conf, sparkContext = type("C", (), {"get": lambda *a: None})(), type("S", (), {"master": "local-cluster[2,1,512]", "getCheckpointDir": lambda s: None})()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(Cluster(), "x")
    assert vocabulary("byte_bpe_50k.json").endswith("byte_bpe_50k.json")
