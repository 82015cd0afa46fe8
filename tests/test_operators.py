"""Functions, retrieval cuts, context, sessions, corpus, models and streaming on small fixtures."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tiersift import models
from tiersift.functions import prompts, scalars
from tiersift.functions.sections import is_noise
from tiersift.operators import hierarchy, retrieval, sessions
from tiersift.sources import corpus, tables
from tiersift.streaming import ingestion
from tiersift.streaming import sessions as streamed


def values(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first().asDict()


def test_scalars(spark):
    lit = F.lit
    none = lit(None).cast("string")
    a = F.array(lit(1.0), lit(0.0))
    got = values(
        spark,
        tokens=scalars.tokens(lit("A_b 中文, x1")),
        ratio=scalars.chinese_ratio(lit("中文 ab 12")),
        none_ratio=scalars.chinese_ratio(lit("12")),
        words=scalars.token_count(lit("中文ab cd x1 é")),
        short=scalars.shortened(lit(" a \t b\n\n\n\nc "), 20),
        cut=scalars.shortened(lit("abcd  efgh"), 5),
        page=scalars.page_number(lit("-3")),
        no_page=scalars.page_number(lit("x")),
        hash=scalars.document_hash(none, lit(" AB_paper")),
        own_hash=scalars.document_hash(lit(" Ff "), none),
        no_hash=scalars.document_hash(lit(" "), lit("x")),
        key=scalars.dedupe_key(none, lit("P"), lit(" S "), lit(2), lit("t")),
        text_key=scalars.dedupe_key(none, none, none, none, lit(" T ")),
        whole=scalars.asks_for_whole(lit("总结全文")),
        part=scalars.asks_for_whole(lit("全文第2页")),
        clamped=scalars.clamped(lit(0), 7, 1, 5),
        zero=scalars.clamped(lit(0.0), 0.7, 0.0, 2.0, True),
        uuid=scalars.is_uuid(lit("{12345678-1234-1234-1234-123456789abc}")),
        no_uuid=scalars.is_uuid(lit("1234")),
        title=scalars.session_title(none, lit("x" * 30)),
        kept_title=scalars.session_title(lit("mine"), lit("x")),
        frame=scalars.event_frame(F.struct(lit("d").alias("type"))),
        same=scalars.cosine_distance(a, a),
        across=scalars.cosine_distance(a, F.array(lit(0.0), lit(2.0))),
        nothing=scalars.cosine_distance(a, F.array(lit(0.0), lit(0.0))),
        window=F.array(*scalars.generation_window(lit(100), lit(500))),
    )
    assert got == {
        "tokens": ["a_b", "中", "文", "x1"], "ratio": 0.5, "none_ratio": 0.0, "words": 3, "short": "a b\n\nc", "cut": "abcd...", "page": 1, "no_page": 1, "hash": "ab", "own_hash": "ff", "no_hash": "",
        "key": "section:p|s|2", "text_key": "text:t", "whole": True, "part": False, "clamped": 5, "zero": 0.0, "uuid": True, "no_uuid": False, "title": "x" * 24, "kept_title": "mine",
        "frame": 'data: {"type":"d"}\n\n', "same": 0.0, "across": 1.0, "nothing": None, "window": [92, 1],
    }
    assert scalars.fusion_weights("fact_qa", "paper") == (0.9, 1.15) and scalars.fusion_weights("general_overview", "element") == (1.3, 0.9) and scalars.fusion_weights("?", "paper") == (1.15, 0.95)
    assert scalars.blend_weights(3, 1) == (0.75, 0.25) and scalars.blend_weights(0, 0) == (0, 0)


def test_prompts(spark):
    said = "1. first query\n- First  Query\n* \"second one\"；标签：x\nq\n" + "y" * 121 + "\nthird\nfourth"
    refs = F.array(F.lit('[1] (来源: A - B)\n"t"'), F.lit("no source"), F.lit('[2] (来源: a - b)\n"u"'), F.lit('[3] (来源: C)\n"v"'))
    pairs = F.array(F.struct(F.lit("q").alias("question"), F.lit(None).cast("string").alias("answer")))
    got = values(
        spark,
        queries=prompts.sub_queries(F.lit(said), F.lit("question")),
        there=prompts.sub_queries(F.lit("A question\nother"), F.lit("a QUESTION")),
        none=prompts.sub_queries(F.lit(None).cast("string"), F.lit("q")),
        intent=prompts.intent(F.lit(" `FACT_qa`\n")),
        no_intent=prompts.intent(F.lit("fact_qa because")),
        history=prompts.history_text(pairs),
        source=prompts.numbered_source(F.lit(1), F.lit(""), F.lit("S"), F.lit(3), F.lit("t")),
        tail=prompts.with_sources(F.lit("Answer.\n\n参考来源: old\nold"), refs),
        no_tail=prompts.with_sources(F.lit("A"), F.array().cast("array<string>")),
        prompt=prompts.prompt(F.lit("{query}|{context}"), F.lit("q"), F.lit("0123456789"), 20),
    )
    assert got == {
        "queries": ["question", "first query", "second one"], "there": ["A question", "other"], "none": ["q"], "intent": "fact_qa", "no_intent": None, "history": "第1轮用户：q\n第1轮助手：",
        "source": '[1] (来源: 未知文献 - S (第 3 页))\n"t"', "tail": "Answer.\n\n回答引用内容：\n[1] A - B\n[2] a - b\n[3] C", "no_tail": "A\n\n回答引用内容：\n[1] 无可用来源", "prompt": "q|012",
    }


def hits(spark, rows):
    return spark.createDataFrame(rows, "qid int, id int, score double, rank int")


def test_an_exact_match_stands_behind_near_ones(spark):
    near = hits(spark, [(1, 7, 1.0, 1), (1, 8, 40.0, 2)])  # scores of distances 0 and 0.025
    got = [(r.id, r.rank) for r in retrieval.rrf({"dense": (near, 1.0)}).orderBy("rank").collect()]
    assert got == [(8, 1), (7, 2)]


def test_cuts(spark):
    rows = hits(spark, [(1, i, s, i) for i, s in enumerate([10.0, 8.0, 6.9, 5.0], 1)] + [(2, 9, -1.0, 1), (2, 8, -2.0, 2)])
    ids = lambda df: sorted((r.qid, r.id) for r in df.collect())
    assert ids(retrieval.keep_ratio(rows, 0.7)) == [(1, 1), (1, 2), (2, 9)] or ids(retrieval.keep_ratio(rows, 0.7))[:2] == [(1, 1), (1, 2)]
    assert len(ids(retrieval.keep_ratio(rows, 0.7, True))) == 4
    assert ids(retrieval.chosen_children(rows.where("qid = 1"))) == [(1, 1), (1, 2)]
    titles = spark.createDataFrame([(1, "References"), (2, "Intro"), (3, None)], "id int, title string")
    assert ids(retrieval.without_noise(rows.where("qid = 1"), titles, is_noise)) == [(1, 2), (1, 3), (1, 4)]
    allowed = spark.createDataFrame([(2,), (2,)], "id int")
    assert ids(retrieval.allowed_only(rows, allowed, "id")) == [(1, 2)] and len(ids(retrieval.allowed_only(rows, None, "id"))) == 6


def test_rerank_by_a_model_and_without(spark):
    rows = hits(spark, [(1, 1, 3.0, 1), (1, 2, 2.0, 2), (1, 3, 1.0, 3)])
    texts = spark.createDataFrame([(1, "no"), (2, "some cat"), (3, "cat sat")], "id int, content string")
    queries = spark.createDataFrame([(1, "cat sat")], "qid int, query string")
    order = lambda df: [r.id for r in df.orderBy("rank").collect()]
    assert order(retrieval.rerank(rows, None, 2)) == [1, 2]
    assert order(retrieval.rerank(rows, models.lexical_scorer(texts, queries), None, 0.0, 1.0)) == [3, 2, 1]
    assert order(retrieval.rerank(rows, models.scorer(lambda: lambda pairs: [len(t) for _, t in pairs], texts, queries), None, 0.0, 1.0)) == [2, 3, 1]
    assert models.scorer(None, texts, queries) is None and models.tried(lambda: 1 / 0) is None


def test_multi_query(spark):
    rows = [(1, q, r, k, s) for q, r, k, s in [(1, 1, "A", 0.5), (1, 2, "B", 0.9), (1, 3, "C", 0.2), (2, 1, "A", 0.6), (2, 2, "D", 0.1), (3, 1, "A", 0.4)]]
    schema = "g int, qid int, rank int, key string, score double"
    got = retrieval.multi_query_fuse(spark.createDataFrame(rows, schema), "g").orderBy("rank").collect()
    assert [(r.key, r.hit_count) for r in got] == [("A", 3), ("B", 1), ("C", 1), ("D", 1)]
    got = retrieval.multi_query_fuse(spark.createDataFrame(rows + [(1, 3, 2, "E", 0.01)], schema), "g").orderBy("rank").collect()
    assert [(r.key, r.score) for r in got] == [("B", pytest.approx(0.9 * 1.15)), ("A", pytest.approx(0.6 * 1.45)), ("C", pytest.approx(0.23)), ("D", pytest.approx(0.115))]


def chunk_rows(spark, rows):
    return spark.createDataFrame(rows, "doc_hash string, chunk_index int, text string, section_title string, section_hierarchy string, page int, source_type string")


def test_index_build_and_overview(spark):
    rows = [("d", 0, " intro one ", "Intro", "Intro", 2, "text"), ("d", 1, "  ", "Intro", "Intro", 2, "text"), ("d", 2, "how", "Setup", "Methods > Setup", 3, "text"), ("d", 3, "cites", "References", None, 9, "text"), ("d", 4, "intro two", "Intro", "Intro", 4, "table"), ("e", 0, "only", "References", None, None, None)]
    made = ingestion.indexed(chunk_rows(spark, rows))
    elements = {r.element_id: r for r in made["element"].collect()}
    assert set(elements) == {"d_paper_sec_0_elem_0", "d_paper_sec_0_elem_1", "d_paper_sec_1_elem_0", "e_paper_sec_0_elem_0"}
    assert elements["d_paper_sec_0_elem_1"].text_content == "intro two" and elements["d_paper_sec_0_elem_1"].element_type == "table"
    sections = {r.section_id: r for r in made["section"].collect()}
    assert (sections["d_paper_sec_0"].document, sections["d_paper_sec_0"].start_page, sections["d_paper_sec_0"].end_page, sections["d_paper_sec_1"].section_title) == ("intro one\n\nintro two", 2, 4, "Setup")
    papers = {r.doc_hash: r for r in made["paper"].collect()}
    assert (papers["d"].page_count, papers["d"].section_titles, papers["d"].chunk_count, papers["e"].document, papers["e"].page_count) == (9, "Intro | Setup", 3, "only", 1)
    kept = hierarchy.overview_sections(made["section"])
    assert {r.section_id for r in kept.collect()} == {"d_paper_sec_0"}
    packets = {r.doc_hash: r.packet for r in hierarchy.overview_packet(made["paper"], kept, hierarchy.overview_elements(made["element"], kept)).collect()}
    assert packets["d"].endswith("### 1. Intro\n页码: 第2-4页\nintro one\nintro two") and "1. Intro（第2-4页，2块）" in packets["d"]
    assert packets["e"].endswith("【各章节全部内容】")
    blocks = hierarchy.element_blocks(hierarchy.neighbours(made["element"].withColumn("paper_title", F.lit("P"))))
    first = blocks.where("element_id = 'd_paper_sec_0_elem_0'").select("block", hierarchy.citation("element").alias("c")).first()
    assert first.block == "\n【文本段落信息】\n来源论文: P\n所属章节: Intro\n位置: 第2页\n类型: text\n\n【内容】\nintro one\n\n【上下文】\nintro two\n" and first.c.element_id == "d_paper_sec_0_elem_0"
    children = spark.createDataFrame([("d_paper_sec_0", i, i, t) for i, t in enumerate(["", "a" * 300, "b", "c", "d"])], "section_id string, rank int, page int, content string")
    shown = hierarchy.section_blocks(made["section"].withColumn("title", F.lit("P")), children).where("section_id = 'd_paper_sec_0'").select("block", hierarchy.citation("section").alias("c")).first()
    assert "【命中片段】\n第1页: " + "a" * 220 + "\n...\n第2页: b\n...\n第3页: c\n" in shown.block and shown.c.page == 2


def test_structured_and_final_context(spark):
    rows = [(1, 1, "element", "e1", "p", "", "x", 0.5), (1, 2, "section", "s1", "p", "T", "x", 0.7), (1, 3, "element", "e2", "q", "U", "x", 0.9), (1, 4, "element", "e3", "", "V", "x", 1.0)]
    got = hierarchy.structured(spark.createDataFrame(rows, "qid int, rank int, level string, id string, paper_id string, title string, name string, score double")).orderBy("rank").collect()
    assert [(r.paper_id, r.score, r.title, [s.id for s in r.sections], [e.id for e in r.elements]) for r in got] == [("p", 0.7, "T", ["s1"], ["e1"]), ("q", 0.9, "U", [], ["e2"])]
    cites = F.array(F.struct(F.lit("S").alias("section_title"), F.lit(2).alias("page")))
    text = values(spark, x=hierarchy.final_context(F.lit("q"), F.array(F.lit("b")), cites), none=hierarchy.final_context(F.lit("q"), F.array().cast("array<string>"), cites))
    assert text["none"] == "未找到相关内容。" and text["x"].endswith("b\n\n参考文献:\n[1] S (第2页)\n")


def test_sessions(spark):
    turns = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "q1"), (1, 2, "assistant", "a1"), (1, 3, "user", "q2"), (2, 0, "user", "x"), (2, 1, "user", "y")], "conv_id int, turn int, role string, text string")
    rows = sessions.pairs(turns)
    assert sorted((r.conv_id, r.pair, r.question, r.answer) for r in rows.collect()) == [(1, 0, "q1", "a1"), (1, 1, "q2", ""), (2, 0, "x", ""), (2, 1, "y", "")]
    assert [(r.conv_id, r.message_count, r.updated_at) for r in sessions.listing(rows).collect()] == [(1, 4, 3), (2, 4, 1)]
    assert [(r.role, r.content) for r in sessions.messages(rows).where("conv_id = 1").orderBy("seq").collect()] == [("user", "q1"), ("assistant", "a1"), ("user", "q2"), ("assistant", "")]
    now = 1_700_000_000
    stored = spark.createDataFrame([("a", "t", now, now, '[["q", null], ["x"], 3]', "s"), ("b", "t", now, now, "broken", "s"), ("c", "t", 1, 1, "[]", "s")], "id string, title string, created_at long, updated_at long, history string, summary string")
    loaded = sessions.load(stored, now)
    assert {r.id: [tuple(p) for p in r.history] for r in loaded.collect()} == {"a": [], "b": []} or {r.id: [tuple(p) for p in r.history] for r in loaded.collect()} == {"a": [("q", "")], "b": []}
    good = sessions.load(spark.createDataFrame([("a", "t", now, now, '[["q", "a"], ["x"]]', "s")], stored.schema), now)
    assert json.loads(sessions.save(good, now).first().history) == [["q", "a"]]


def test_uploads(spark):
    rows = spark.createDataFrame([("a.pdf", 10, b"%PDF-"), ("a.PDF", 30 << 20, b"%PDF-"), ("a.txt", 1, b"%PDF-"), ("../a.pdf", 1, b"%PDF-"), ("a.pdf", 1, b"junk!"), ("", 1, b"%PDF-")], "name string, size long, first binary")
    assert [r.x for r in rows.select(corpus.rejected(F.col("name"), F.col("size"), F.col("first")).alias("x")).collect()] == [None, "size", "type", "type", "type", "type"]
    batch = spark.createDataFrame([(1, "a?.pdf", b"1"), (2, "b.pdf", b"1"), (3, "a.pdf", b"2"), (4, "c.pdf", b"0"), (5, "d.pdf", b"3")], "order int, name string, content binary")
    store = spark.createDataFrame([("d.pdf", __import__("hashlib").md5(b"0").hexdigest())], "name string, hash string")
    got = {r.order: r.stored for r in corpus.stored_names(batch, store).collect()}
    assert got == {1: "a.pdf", 3: "a_c81e728d.pdf", 5: "d_eccbc87e.pdf"}
    counted = corpus.outcome(spark.createDataFrame([(None, True), (None, False), ("type", False), ("size", False)], "reason string, is_new boolean")).first()
    assert tuple(counted) == (1, 1, 1, 1)
    with pytest.raises(ValueError):
        corpus.checked_batch(batch, 4)
    with pytest.raises(ValueError):
        corpus.single(spark.createDataFrame([("a",), ("b",)], "path string"))
    assert corpus.single(spark.createDataFrame([("a",), ("a",)], "path string")) == "a"


def test_lookups_and_chunks(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    ids = spark.createDataFrame([("b", 0), ("a", 1), ("b", 2), (" ", 3), ("z", 4)], "id string, place int")
    assert [r.id for r in tables.by_ids(rows, ids, "id").orderBy("place").collect()] == ["b", "a"]
    lines = spark.createDataFrame([(1, i, "w " * 4) for i in range(5)], "doc_id int, chunk_index int, text string")
    got = tables.token_chunks(lines, 8, 4).orderBy("chunk").collect()
    assert [(r.chunk, r.n_tokens) for r in got] == [(0, 8), (1, 12), (2, 8)]
    assert {r.v for r in tables.first_seen(spark.createDataFrame([("A", 2), ("a", 1), ("b", 3)], "k string, v int"), F.lower("k"), "v").collect()} == {1, 3}


def test_models(spark):
    states, mask = np.array([[[3.0, 0.0], [0.0, 4.0], [9.0, 9.0]]]), np.array([[1, 1, 0]])
    assert models.pooled(states, mask)[0] == pytest.approx([0.6, 0.8])
    rows = spark.createDataFrame([(1, "ab"), (2, None)], "id int, text string")
    assert [r.embedding for r in models.embedded(rows, lambda: lambda texts: [[float(len(t))] for t in texts]).orderBy("id").collect()] == [[2.0], [0.0]]
    questions = spark.createDataFrame([(5, "what is it")], "question int, text string")
    assert [(r.qid, r.query) for r in models.expanded(questions, lambda t: "more of it\nless").collect()] == [(0, "what is it"), (1, "more of it"), (2, "less")]
    assert models.intents(questions).first().intent == "fact_qa"
    assert rows.select(models.segmented(F.col("text"), lambda: list).alias("x")).first().x == ["a", "b"]


def test_ingestion_is_idempotent(spark, tmp_path):
    inbox, store = tmp_path / "in", str(tmp_path / "store")
    inbox.mkdir()
    parser = lambda: lambda data: [(line, "Intro", "Intro", 1, "text") for line in data.decode().split("\n")]
    parse = lambda files: models.parsed(files, parser)
    for k, content in enumerate(["one\ntwo", "three", "one\ntwo"]):
        (inbox / f"{k}.pdf").write_text(content)
        ingestion.ingest(spark, str(inbox), store, str(tmp_path / "check"), parse).awaitTermination()
    assert tables.load_snapshot(spark, store, "paper").count() == 2 and tables.load_snapshot(spark, store, "element").count() == 3


def test_sessions_as_a_stream(spark, tmp_path):
    rows = [("a", 1, "[]", '[["q","a"]]', ""), ("a", 2, "[]", "[]", "lost"), ("b", 1, '[["x","y"]]', "[]", "lost"), ("a", 3, '[["q", "a"]]', "[]", "short")]
    schema = "id string, seq long, seen string, history string, summary string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "u"))
    found = []
    stream = streamed.applied(spark.readStream.schema(schema).parquet(str(tmp_path / "u")))
    stream.writeStream.foreachBatch(lambda df, _: found.extend(df.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert {(r.id, r.seq): r.applied for r in found} == {("a", 1): True, ("a", 2): False, ("b", 1): False, ("a", 3): True}
    assert {r.seq: r.summary for r in found if r.id == "a"}[3] == "short"
