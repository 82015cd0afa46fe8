"""Queries over the supplied tables. ``oracles`` has the SQL that each can be held against."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import prompts, scalars
from ..functions.sections import any_part, is_method, is_noise, normal_title
from ..operators import hierarchy, retrieval, sessions
from ..sources import corpus, tables
from ..sources.tables import table

#: Hits that each arm recalls for fusion; titles that the lines of a document go through, three lines each.
DEPTH, NOW_S = 54, 1_700_000_000
#: Questions up to which their hits go to every task, so that the documents they are joined with stay where they are.
MOST_QUESTIONS = 10_000
TITLES = ["Introduction", "Methods", "Results > Preference Study", "References", "Discussion"]


def _titles(number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(t) for t in TITLES]), (F.pmod(number, F.lit(len(TITLES))) + 1).cast("int"))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def _asked(vectors: DataFrame) -> DataFrame:
    """The stated query set: every vector whose id is divisible by 20."""
    return vectors.where("id % 20 = 0").withColumnRenamed("id", "qid")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")


def _allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("id"))


def _document_titles(rows: DataFrame) -> DataFrame:
    return rows.select("id", _titles(F.col("id")).alias("title"))


def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _vectors(spark, sf_dir)
    return retrieval.dense_topk(_asked(vectors), vectors, 10).withColumn("score", F.round("score", 4))


def dense_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _vectors(spark, sf_dir)
    hits = retrieval.dense_topk(_asked(vectors), retrieval.allowed_only(vectors, _allowed(spark, sf_dir), "id"), 10)
    return retrieval.without_noise(hits, _document_titles(vectors), is_noise).withColumn("score", F.round("score", 4)).select("qid", "id", "distance", "score", "rank")


def _dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dense arm of the questions: an item's vector is that of its id."""
    vectors = _vectors(spark, sf_dir)
    asked = vectors.join(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id")).distinct(), "id", "left_semi").withColumnRenamed("id", "qid")
    return retrieval.dense_topk(asked, vectors, DEPTH)


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.bm25_topk(_questions(spark, sf_dir), _documents(spark, sf_dir), DEPTH)


def bm25_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    hits = retrieval.bm25_topk(_questions(spark, sf_dir), retrieval.allowed_only(docs, _allowed(spark, sf_dir), "id"), DEPTH)
    return retrieval.without_noise(hits, _document_titles(docs), is_noise).select("qid", "id", "score", "rank")


def rrf_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    dense, sparse = scalars.fusion_weights("fact_qa", "element")
    return retrieval.rrf({"dense": (_dense(spark, sf_dir), dense), "sparse": (bm25_topk(spark, sf_dir), sparse)})


def _sent(hits: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    return F.broadcast(hits) if _questions(spark, sf_dir).count() <= MOST_QUESTIONS else hits


def _parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("parent_id"))


def parent_promote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.promote(_sent(rrf_hybrid(spark, sf_dir), spark, sf_dir), _parents(spark, sf_dir))


def parent_prescreen(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = retrieval.promote(_sent(rrf_hybrid(spark, sf_dir), spark, sf_dir), _parents(spark, sf_dir), "general_overview")
    return retrieval.chosen_parents(found, None, "general_overview")


def child_percent_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.chosen_children(rrf_hybrid(spark, sf_dir))


def cross_query_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.cross_query_rrf(bm25_topk(spark, sf_dir).withColumn("question", F.floor(F.col("qid") / 3)), "question")


def multi_query_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = bm25_topk(spark, sf_dir).select(F.floor(F.col("qid") / 3).alias("question"), "qid", "rank", F.col("id").alias("key"), "score")
    return retrieval.multi_query_fuse(hits, "question")


def dynamic_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.keep_dynamic(rrf_hybrid(spark, sf_dir))


def rank_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.keep_percent(bm25_topk(spark, sf_dir))


def rank_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = _sent(bm25_topk(spark, sf_dir).select("qid", "id", "score"), spark, sf_dir).join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "n_chars"), "id")
    return retrieval.rank_fusion(both, "score", "n_chars")


def min_max_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.min_max(bm25_topk(spark, sf_dir), "score")


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as chunks; three lines make a section of the next title, ten a page."""
    lines = tables.chunks(table(spark, sf_dir, "documents"))
    title = _titles(F.floor(F.col("chunk_index") / 3))
    named = lines.select(F.md5(F.col("doc_id").cast("string")).alias("doc_hash"), "chunk_index", "text", title.alias("section_hierarchy"), F.element_at(F.split(title, " > "), -1).alias("section_title"), (F.floor(F.col("chunk_index") / 10) + 1).alias("page"), F.lit("text").alias("source_type"))
    return hierarchy.normal_chunks(named)


def hier_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _chunks(spark, sf_dir)
    return rows.select("doc_hash", "chunk_index", "text", "section_key", "page", any_part(F.col("parts"), F.col("section_title"), is_noise).alias("noise"), any_part(F.col("parts"), F.col("section_title"), is_method).alias("method"))


def noise_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.body(_chunks(spark, sf_dir)).select("doc_hash", "chunk_index", "page_count")


def _elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.elements(hierarchy.body(_chunks(spark, sf_dir)))


def hier_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _elements(spark, sf_dir).drop("ordinal", "page_count")


def hier_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.sections(_elements(spark, sf_dir))


def hier_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.papers(_elements(spark, sf_dir))


def overview_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.overview_sections(hier_sections(spark, sf_dir)).select("section_id", "section_title", "start_page", "place")


def overview_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _elements(spark, sf_dir)
    return hierarchy.overview_elements(rows, hierarchy.overview_sections(hierarchy.sections(rows))).select("element_id", "section_id", "place")


def overview_packet(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _elements(spark, sf_dir)
    kept = hierarchy.overview_sections(hierarchy.sections(rows))
    return hierarchy.overview_packet(hierarchy.papers(rows), kept, hierarchy.overview_elements(rows, kept))


def neighbor_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.neighbours(_elements(spark, sf_dir)).select("element_id", "context")


def level_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _elements(spark, sf_dir)
    return rows.groupBy("paper_id", "section_id").agg(F.count("*").alias("n")).groupBy("paper_id").agg(F.count("*").alias("s"), F.sum("n").alias("n")).agg(F.count("*").alias("papers"), F.sum("s").alias("sections"), F.sum("n").alias("elements"))


def structured_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _sent(rrf_hybrid(spark, sf_dir), spark, sf_dir).join(_parents(spark, sf_dir), "id").select("qid", "rank", F.lit("element").alias("level"), "id", F.col("parent_id").alias("paper_id"), _titles(F.col("id")).alias("title"), F.lit("text").alias("name"), "score")
    rolled = hierarchy.structured(hits)
    return rolled.select("qid", "paper_id", "score", "title", F.array_join(F.transform("elements", lambda x: x["id"].cast("string")), ",").alias("elements"), "rank")


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _sent(rrf_hybrid(spark, sf_dir).where("rank <= 6"), spark, sf_dir).join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", "text"), "id")
    reference = prompts.numbered_source(F.col("rank"), F.col("source"), _titles(F.col("id")), F.pmod(F.col("id"), F.lit(4)), F.col("text"))
    return hits.select("qid", "id", reference.alias("reference"), prompts.source_of(reference).alias("source"))


def budget_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = hierarchy.packed(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")
    return packed.select("conv_id", F.size("blocks").alias("n_blocks"), F.md5(F.array_join("blocks", "|")).alias("hash"), "total_length")


def section_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", normal_title(title).alias("title"), is_noise(title).alias("noise"), is_method(title).alias("method"))


def text_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.round(scalars.chinese_ratio(text), 6).alias("chinese"), F.size(scalars.tokens(text)).alias("n_tokens"), scalars.token_count(text).alias("n_words"), scalars.shortened(text, 120).alias("short"))


def query_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat(F.lit("1. "), F.replace("text", F.lit(" "), F.lit("\n- ")), F.lit("\n第一：x\n"), F.upper("text"))
    question = F.left("text", F.lit(40))
    parsed = table(spark, sf_dir, "benchmark").select("item_id", prompts.sub_queries(said, question).alias("q"))
    return parsed.select("item_id", F.size("q").alias("n"), F.array_join("q", "|").alias("queries"))


def intent_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(F.lit("`Fact_QA` "), F.lit('"document_overview"'), F.lit("general_overview."), F.lit("  general_overview\n"))
    return table(spark, sf_dir, "benchmark").select("item_id", prompts.intent(F.element_at(names, (F.pmod("item_id", F.lit(4)) + 1).cast("int"))).alias("intent"))


def clamp_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity").cast("int")
    made, room = scalars.generation_window(q * 16, q * q)
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", scalars.clamped(q % 7 * 100, 512, 64, 450).cast("int").alias("length"), F.round(scalars.clamped(F.col("l_discount").cast("double") * 30, 0.7, 0.0, 2.0, True), 6).alias("temperature"), made.alias("made"), room.alias("room"))
    return rows


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.pairs(table(spark, sf_dir, "conversations"))


def session_last2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.frame(_pairs(spark, sf_dir), 0, 2)


def session_prior5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.frame(_pairs(spark, sf_dir), 2, 5)


def session_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.listing(_pairs(spark, sf_dir))


def session_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.messages(_pairs(spark, sf_dir))


def session_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as if begun half a day apart, every other one in milliseconds."""
    s = F.lit(NOW_S) - F.col("conv_id") * 43_200
    made = table(spark, sf_dir, "conversations").select("conv_id").distinct().withColumn("created_at", F.when(F.col("conv_id") % 2 == 0, s).otherwise(s * 1000))
    return made.select("conv_id", scalars.is_expired(F.col("created_at"), NOW_S).alias("expired"))


def history_cas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histories cut to their last two pairs, where what was seen (never a conversation's pairs of an odd number) is still there."""
    rows = _pairs(spark, sf_dir).groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pair", "question"))), lambda x: x["question"]).alias("history"))
    stored = rows.select(F.col("conv_id").alias("id"), "history", F.lit("old").alias("summary"))
    updates = rows.select(F.col("conv_id").alias("id"), F.when(F.size("history") % 2 == 0, F.col("history")).otherwise(F.slice("history", 1, 1)).alias("seen"), scalars.last_turns(F.col("history"), 2).alias("history"), F.lit("new").alias("summary"))
    return sessions.compare_and_set(stored, updates).select("id", F.size("history").alias("n"), "summary")


def new_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return tables.new_by_content(docs.where("source = 'src0'"), docs.where("coalesce(source, '') <> 'src0'"), "text", "doc_id")


def upload_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 5
    name = F.concat(F.when(k == 1, F.lit("../")).otherwise(F.lit("")), F.lit("paper "), F.col("doc_id"), F.when(k == 2, F.lit(".txt")).otherwise(F.lit(".PDF")))
    content = F.concat(F.when(k == 3, F.lit("")).otherwise(F.lit("%PDF-")), F.coalesce("text", F.lit("")))
    rows = table(spark, sf_dir, "documents").select("doc_id", name.alias("name"), F.octet_length(content).alias("size"), F.encode(F.left(content, F.lit(5)), "utf-8").alias("first"))
    return rows.select("doc_id", corpus.plain_name(F.col("name")).alias("plain"), F.coalesce(corpus.rejected(F.col("name"), F.col("size") * 8192, F.col("first")), F.lit("")).alias("reason"))


def anti_join_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.not_indexed(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels").where("quality = 1"), "doc_id")


def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return tables.upserted(old, table(spark, sf_dir, "documents").where("n_chars > 500").select("doc_id", F.lit(9).alias("quality")), "doc_id")


def token_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.token_chunks(tables.chunks(table(spark, sf_dir, "documents"))).select("doc_id", "chunk", "n_tokens", F.md5("text").alias("hash"))


def distance_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of neighbouring vectors: cosine distances, and the scores of distances and of inner products below 0."""
    rows = _vectors(spark, sf_dir)
    pairs = rows.join(rows.select((F.col("id") - 1).alias("id"), F.col("embedding").alias("other")), "id")
    d = F.round(scalars.cosine_distance(F.col("embedding"), F.col("other")), 6)
    return pairs.select("id", d.alias("distance"), F.round(scalars.distance_score(d), 4).alias("score"), F.round(scalars.positive_score(1 - d), 6).alias("positive"))


QUERIES = {
    f.__name__: f
    for f in (dense_topk, dense_topk_filtered, bm25_topk, bm25_topk_filtered, rrf_hybrid, parent_promote, parent_prescreen, child_percent_keep, cross_query_rrf, multi_query_fuse, dynamic_select, rank_percent, rank_fusion, min_max_scores)
    + (hier_chunks, noise_filter, hier_elements, hier_sections, hier_papers, overview_sections, overview_elements, overview_packet, neighbor_context, level_counts, structured_rollup, citations, budget_pack)
    + (section_titles, text_scalars, query_parse, intent_parse, clamp_params, session_last2, session_prior5, session_list, session_messages, session_expiry, history_cas)
    + (new_contents, upload_check, anti_join_indexed, upsert, token_chunks, distance_scores)
}
