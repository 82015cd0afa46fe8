"""The paper, section and element levels: building them, the overview of a document, neighbours, context and citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import cut_block, page_number, shortened, strip, whole_number
from ..functions.sections import any_part, hierarchy_parts, is_method, is_noise, leaf_title, section_key

#: Characters of an abstract, of a neighbour and of a matched child; what is missing in an order.
ABSTRACT, NEIGHBOUR, SNIPPET, LAST = 1000, 200, 220, 10**6
#: Names of element types; labels; what stands for something unknown.
TYPES = {"text": "文本段落", "figure": "图片", "table": "表格", "equation": "公式", "citation": "引用"}
NO_PAPER, UNKNOWN, NOTHING = "未知文献", "未知", "未找到相关内容。"
BUDGET = 25_000


def normal_chunks(chunks: DataFrame) -> DataFrame:
    """chunks (doc_hash, chunk_index, text, section_title, section_hierarchy, page, source_type) without blank ones.

    Texts are stripped, pages are numbers from 1, parts and key are of the section; chunk_index counts the blank ones.
    """
    text = strip(F.coalesce(F.col("text"), F.lit("")))
    parts = hierarchy_parts(F.col("section_hierarchy"))
    return chunks.withColumn("text", text).where("text <> ''").withColumns({"page": page_number(F.col("page").cast("string")), "parts": parts, "section_key": section_key(parts, F.col("section_title"))})


def body(chunks: DataFrame) -> DataFrame:
    """Normal chunks without those of noise sections, unless a document has no others; page_count is of all."""
    noise = any_part(F.col("parts"), F.col("section_title"), is_noise)
    whole = Window.partitionBy("doc_hash")
    marked = chunks.withColumn("noise", noise)
    marked = marked.withColumns({"page_count": F.max("page").over(whole), "only_noise": F.min(F.col("noise").cast("int")).over(whole) == 1})
    return marked.where("not noise or only_noise").drop("noise", "only_noise")


def _joined(order: str, text: str, by: str = "\n\n") -> Column:
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, text))), lambda x: x[text]), by)


def elements(chunks: DataFrame) -> DataFrame:
    """The elements of body chunks: ids, their section's, and positions counted from 1 within a section."""
    first = F.min("chunk_index").over(Window.partitionBy("doc_hash", "section_key"))
    placed = chunks.withColumn("first_index", first)
    number = F.dense_rank().over(Window.partitionBy("doc_hash").orderBy("first_index")) - 1
    position = F.row_number().over(Window.partitionBy("doc_hash", "section_key").orderBy("chunk_index"))
    placed = placed.withColumns({"ordinal": number, "position": position}).withColumn("paper_id", F.concat("doc_hash", F.lit("_paper")))
    placed = placed.withColumn("section_id", F.concat("paper_id", F.lit("_sec_"), "ordinal"))
    return placed.select(
        F.lit("element").alias("level"),
        F.concat("section_id", F.lit("_elem_"), F.col("position") - 1).alias("element_id"),
        F.col("section_id").alias("parent_id"),
        "paper_id",
        "section_id",
        F.coalesce(F.nullif(strip(F.col("section_title")), F.lit("")), F.lit("Document")).alias("section_title"),
        F.col("section_key").alias("section_hierarchy"),
        F.coalesce("source_type", F.lit("text")).alias("element_type"),
        "position",
        "page",
        "chunk_index",
        "doc_hash",
        F.col("text").alias("text_content"),
        "ordinal",
        "page_count",
    )


def sections(rows: DataFrame) -> DataFrame:
    """One row a section of elements: its ordered text, pages, number of chunks, and number by first appearance from 1."""
    rolled = rows.groupBy("doc_hash", "paper_id", "section_id", "section_hierarchy", "ordinal").agg(F.min("page").alias("start_page"), F.max("page").alias("end_page"), F.count("*").alias("chunk_count"), _joined("chunk_index", "text_content").alias("document"))
    return rolled.select(F.lit("section").alias("level"), "section_id", F.col("paper_id").alias("parent_id"), "paper_id", leaf_title(F.col("section_hierarchy")).alias("section_title"), "section_hierarchy", (F.col("ordinal") + 1).cast("string").alias("section_number"), "start_page", "end_page", "chunk_count", "doc_hash", "document")


def papers(rows: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """One row a document of elements: its ordered text, abstract, titles of its sections, and counts. titles: (doc_hash, title)."""
    leaf = F.struct("ordinal", leaf_title(F.col("section_hierarchy")).alias("leaf"))
    rolled = rows.withColumn("leaf", leaf).groupBy("doc_hash", "paper_id").agg(F.max("ordinal").alias("last"), F.count("*").alias("chunk_count"), F.max("page_count").alias("page_count"), F.sort_array(F.collect_set("leaf")).alias("leaves"), _joined("chunk_index", "text_content").alias("document"))
    rolled = rolled.join(titles, "doc_hash", "left") if titles is not None else rolled.withColumn("title", F.col("doc_hash"))
    return rolled.select(F.lit("paper").alias("level"), "paper_id", "title", F.left("document", F.lit(ABSTRACT)).alias("abstract"), "doc_hash", (F.col("last") + 1).alias("section_count"), "chunk_count", F.array_join(F.transform("leaves", lambda x: x["leaf"]), " | ").alias("section_titles"), "page_count", "document")


def overview_sections(rows: DataFrame) -> DataFrame:
    """Sections that are neither noise nor method, with their place in the document's order."""
    parts = hierarchy_parts(F.col("section_hierarchy"))
    title = F.col("section_title")
    kept = rows.where(~any_part(parts, title, is_noise) & ~any_part(parts, title, is_method))
    order = Window.partitionBy("doc_hash").orderBy(whole_number(F.col("section_number"), LAST), F.coalesce("start_page", F.lit(LAST)), "section_title", "section_id")
    return kept.withColumn("place", F.row_number().over(order))


def overview_elements(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """The elements of kept sections, with their place in their section."""
    order = Window.partitionBy("section_id").orderBy(F.coalesce("position", F.lit(LAST)), F.coalesce("chunk_index", F.lit(LAST)))
    return rows.join(kept.select("section_id"), "section_id", "left_semi").withColumn("place", F.row_number().over(order))


def overview_packet(paper_rows: DataFrame, kept: DataFrame, element_rows: DataFrame) -> DataFrame:
    """(doc_hash, packet): a document's title and counts, abstract, list of sections and their whole texts."""
    texts = element_rows.groupBy("section_id").agg(_joined("place", "text_content", "\n").alias("full"))
    listed = kept.join(texts, "section_id", "left").withColumn("full", F.coalesce(F.nullif("full", F.lit("")), strip(F.col("document"))))
    pages = F.when(F.col("start_page") == F.col("end_page"), F.format_string("第%d页", "start_page")).otherwise(F.format_string("第%d-%d页", "start_page", "end_page"))
    line = F.format_string("%d. %s（%s，%d块）", "place", "section_hierarchy", pages, "chunk_count")
    block = F.when(F.col("full") != "", F.format_string("\n### %d. %s\n页码: %s\n%s", "place", "section_hierarchy", pages, "full"))
    rolled = listed.groupBy("doc_hash").agg(F.sort_array(F.collect_list(F.struct("place", line.alias("line"), block.alias("block")))).alias("all"))
    out = paper_rows.join(rolled, "doc_hash", "left")
    head = F.concat_ws("\n", F.lit("【文档级概述资料包】"), F.concat(F.lit("标题: "), "title"), F.concat(F.lit("文档ID: "), "paper_id"), F.concat(F.lit("doc_hash: "), "doc_hash"), F.when(F.col("page_count") > 0, F.concat(F.lit("页数: "), "page_count")), F.concat(F.lit("正文块数: "), "chunk_count"), F.when(F.col("abstract") != "", F.concat(F.lit("\n【摘要】\n"), shortened(F.col("abstract"), 1200))))
    lines = F.array_join(F.transform("all", lambda x: x["line"]), "\n")
    blocks = F.array_join(F.transform(F.filter("all", lambda x: x["block"].isNotNull()), lambda x: x["block"]), "\n")
    packet = F.concat_ws("\n", head, F.lit("\n【章节结构】"), F.nullif(lines, F.lit("")), F.lit("\n【各章节全部内容】"), F.nullif(blocks, F.lit("")))
    return out.select("doc_hash", strip(packet).alias("packet"))


def neighbours(rows: DataFrame, reach: int = 2, most: int = 2) -> DataFrame:
    """elements (section_id, position, text_content) with context: the first ``most`` other texts at most ``reach`` positions away, cut."""
    here = F.struct("position", "text_content")
    around = F.collect_list(here).over(Window.partitionBy("section_id").orderBy("position").rangeBetween(-reach, reach))
    others = F.filter(around, lambda x: (x["text_content"] != F.col("text_content")) & (x["text_content"] != ""))
    return rows.withColumn("context", F.array_join(F.transform(F.slice(others, 1, most), lambda x: F.left(x["text_content"], F.lit(NEIGHBOUR))), "\n...\n"))


def element_blocks(rows: DataFrame) -> DataFrame:
    """rows (neighbours() with paper_title) with block: what an element says, where from, and what stands around it."""
    names = F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair])
    kind = F.coalesce(names[F.col("element_type")], F.lit("内容"))
    where = F.concat_ws("\n", F.concat(F.lit("来源论文: "), F.coalesce("paper_title", "paper_id")), F.concat(F.lit("所属章节: "), F.coalesce("section_title", F.lit(UNKNOWN))), F.format_string("位置: 第%d页", "page"), F.concat(F.lit("类型: "), "element_type"))
    return rows.withColumn("block", F.concat(F.lit("\n【"), kind, F.lit("信息】\n"), where, F.lit("\n\n【内容】\n"), "text_content", F.lit("\n\n【上下文】\n"), "context", F.lit("\n")))


def section_blocks(rows: DataFrame, children: DataFrame, most: int = 3) -> DataFrame:
    """rows (sections() with title) with block: a section's text after snippets of its first matched children (section_id, rank, page, content)."""
    shown = children.where(strip(F.coalesce(F.col("content"), F.lit(""))) != "" )
    shown = shown.withColumn("place", F.row_number().over(Window.partitionBy("section_id").orderBy("rank"))).where(F.col("place") <= most)
    snippet = F.format_string("第%d页: %s", "page", F.left(strip(F.col("content")), F.lit(SNIPPET)))
    parts = shown.withColumn("snippet", snippet).groupBy("section_id").agg(_joined("place", "snippet", "\n...\n").alias("matched"))
    joined = rows.join(parts, "section_id", "left")
    matched = F.coalesce(F.concat(F.lit("\n【命中片段】\n"), "matched"), F.lit(""))
    head = F.concat(F.lit("\n【章节信息】\n论文: "), F.coalesce("title", "paper_id"), F.lit("\n章节: "), F.coalesce("section_title", F.lit(UNKNOWN)), F.format_string("\n页码: 第%d页\n", "start_page"))
    return joined.withColumn("block", F.concat(head, matched, F.lit("\n\n【内容】\n"), "document", F.lit("\n"))).drop("matched")


def citation(level: str) -> Column:
    """The citation of a row of a level, as a struct."""
    paper = F.coalesce("title" if level != "element" else "paper_title", F.lit(NO_PAPER)).alias("paper_title")
    if level == "paper":
        return F.struct(F.lit(level).alias("type"), "paper_id", paper)
    own = [F.col("section_id"), F.col("start_page").alias("page")] if level == "section" else [F.col("element_id"), F.col("page"), F.col("element_type")]
    return F.struct(F.lit(level).alias("type"), "paper_id", paper, F.coalesce("section_title", F.lit(UNKNOWN)).alias("section_title"), *own)


def structured(hits: DataFrame, most_sections: int = 5, most_elements: int = 10) -> DataFrame:
    """(qid, paper_id, score, title, sections, elements, rank) of hits (qid, rank, level, id, paper_id, title, name, score).

    One row a paper in the order of its first hit: its best score, first title that is not empty, and best sections and elements.
    """
    def best(level: str, n: int) -> Column:
        of = F.sort_array(F.collect_list(F.when(F.col("level") == level, F.struct((-F.col("score")).alias("by"), "rank", "id", F.col("name").alias("title"), "score"))))
        return F.transform(F.slice(of, 1, n), lambda x: F.struct(x["id"].alias("id"), x["title"].alias("title"), x["score"].alias("score")))

    named = hits.where(F.coalesce("paper_id", F.lit("")) != "")
    rolled = named.groupBy("qid", "paper_id").agg(F.min("rank").alias("first"), F.greatest(F.max("score"), F.lit(0.0)).alias("score"), F.min_by("title", F.when(F.coalesce("title", F.lit("")) != "", F.col("rank"))).alias("title"), best("section", most_sections).alias("sections"), best("element", most_elements).alias("elements"))
    return rolled.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("first"))).drop("first")


def final_context(query: Column, blocks: Column, citations: Column) -> Column:
    """The text that answers are made from: the question, the blocks, and a numbered list of citations (section_title, page)."""
    line = "\n" + "=" * 50 + "\n"
    listed = F.array_join(F.transform(citations, lambda c, i: F.format_string("[%d] %s (第%d页)", i + 1, c["section_title"], c["page"])), "\n")
    whole = F.concat(F.lit("\n用户问题: "), query, F.lit(f"\n\n相关文献内容:\n{line}\n"), F.array_join(blocks, line), F.lit("\n\n参考文献:\n"), listed, F.lit("\n"))
    return F.when(F.size(blocks) > 0, whole).otherwise(F.lit(NOTHING))


def packed(blocks: DataFrame, by: str, order: str, text: str, budget: int = BUDGET) -> DataFrame:
    """(by, blocks, total_length): blocks taken in order while they fit a budget of characters.

    One that doesn't fit is passed over, but the first taken is cut to fit. The texts of a group (the
    results kept for one query) are folded in one row.
    """
    start = F.struct(F.array().cast("array<string>").alias("taken"), F.lit(0).alias("length"))

    def take(state, x):
        room = F.lit(budget) - state["length"]
        fits = F.char_length(x[text]) <= room
        block = F.when(room <= 0, F.lit(None)).when(fits, x[text]).when(F.size(state["taken"]) == 0, F.nullif(cut_block(x[text], room), F.lit("")))
        return F.when(block.isNull(), state).otherwise(F.struct(F.concat(state["taken"], F.array(block)).alias("taken"), (state["length"] + F.char_length(block)).alias("length")))

    rows = blocks.groupBy(by).agg(F.sort_array(F.collect_list(F.struct(order, F.coalesce(F.col(text), F.lit("")).alias(text)))).alias("rows"))
    folded = rows.select(by, F.aggregate("rows", start, take).alias("fold"))
    return folded.select(by, F.col("fold.taken").alias("blocks"), F.col("fold.length").alias("total_length"))
