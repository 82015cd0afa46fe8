"""Texts around a question: its sub-queries and intent, the history, and the sources of an answer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import strip

#: How many sub-queries are kept, and their lengths.
MOST_QUERIES, SHORTEST, LONGEST, LABEL = 3, 2, 120, 6
#: Intents; what stands before an item of a list; quotes around a sub-query and within an intent.
INTENTS = ["document_overview", "general_overview", "fact_qa"]
BULLET, QUOTES, INTENT_QUOTES = r"^(\d+[.)]|[-*•])\s*", " \t\"'“”‘’", "[`\"'“”‘’]"
#: The headings of an answer's sources, and what stands for none.
TAIL, NO_SOURCE, UNKNOWN_PAPER, UNKNOWN_SECTION = "回答引用内容", "无可用来源", "未知文献", "未知章节"
OLD_TAIL = r"(?is)\n{2,}(回答引用内容|参考来源)\s*[：:].*$"
SOURCE_LINE = r"^\[(\d+)\]\s*\(来源:\s*(.*?)\)\s*$"


def first_spellings(items: Column) -> Column:
    """items without those that an earlier one equals but for case."""
    lowered = F.transform(items, F.lower)
    return F.filter(items, lambda x, i: F.array_position(lowered, F.lower(x)) == i + 1)


def sub_queries(said: Column, question: Column, most: int = MOST_QUERIES) -> Column:
    """The sub-queries that a model named, a line each, after the question itself unless it is among them."""
    lines = F.split(F.coalesce(said, F.lit("")), "[\n\r;；]+")
    bare = F.transform(lines, lambda x: strip(F.regexp_replace(F.btrim(F.regexp_replace(x, BULLET, ""), F.lit(QUOTES)), r"(?U)\s+", " ")))
    length = F.char_length
    label = lambda x: F.contains(x, F.lit("：")) & (length(F.substring_index(x, "：", 1)) <= LABEL)
    good = first_spellings(F.filter(bare, lambda x: (length(x) >= SHORTEST) & (length(x) <= LONGEST) & ~label(x)))
    there = F.exists(good, lambda x: F.lower(x) == F.lower(question))
    return F.slice(F.when(there, good).otherwise(F.concat(F.array(question), good)), 1, most)


def intent(said: Column) -> Column:
    """The intent that a model named; null if it named none."""
    bare = F.lower(strip(F.regexp_replace(F.coalesce(said, F.lit("")), INTENT_QUOTES, "")))
    return F.when(bare.isin(INTENTS), bare)


def history_text(pairs: Column) -> Column:
    """Pairs (question, answer) as numbered lines."""
    return F.array_join(F.transform(pairs, lambda p, i: F.format_string("第%d轮用户：%s\n第%d轮助手：%s", i + 1, F.coalesce(p["question"], F.lit("")), i + 1, F.coalesce(p["answer"], F.lit("")))), "\n")


def numbered_source(number: Column, paper_title: Column, section_title: Column, page: Column, text: Column) -> Column:
    """A reference: its number, source and text."""
    name = lambda c, none: F.coalesce(F.nullif(c, F.lit("")), F.lit(none))
    shown = F.coalesce(page.cast("string"), F.lit(""))
    place = F.when(shown.isin("", "?", "0"), F.lit("")).otherwise(F.concat(F.lit(" (第 "), shown, F.lit(" 页)")))
    return F.concat(F.lit("["), number.cast("string"), F.lit("] (来源: "), name(paper_title, UNKNOWN_PAPER), F.lit(" - "), name(section_title, UNKNOWN_SECTION), place, F.lit(')\n"'), F.coalesce(text, F.lit("")), F.lit('"'))


def source_of(reference: Column) -> Column:
    """The source that a reference's first line names, without its number; empty if it names none."""
    return strip(F.regexp_extract(strip(F.substring_index(F.coalesce(reference, F.lit("")), "\n", 1)), SOURCE_LINE, 2))


def numbered_line(reference: Column) -> Column:
    """The line [number] source of a reference; empty if it names none."""
    number = F.regexp_extract(strip(F.substring_index(F.coalesce(reference, F.lit("")), "\n", 1)), SOURCE_LINE, 1)
    return F.when(source_of(reference) != "", F.concat(F.lit("["), number, F.lit("] "), source_of(reference))).otherwise(F.lit(""))


def with_sources(answer: Column, references: Column) -> Column:
    """An answer with the list of its sources, in place of one that it had."""
    lines = first_spellings(F.filter(F.transform(references, numbered_line), lambda x: x != ""))
    named = F.filter(F.transform(lines, lambda x: strip(F.regexp_replace(x, r"^\[\d+\]\s*", ""))), lambda x: x != "")
    listed = F.when(F.coalesce(F.size(named), F.lit(0)) > 0, named).otherwise(F.array(F.lit(NO_SOURCE)))
    tail = F.array_join(F.transform(listed, lambda x, i: F.format_string("[%d] %s", i + 1, x)), "\n")
    bare = F.regexp_replace(strip(F.coalesce(answer, F.lit(""))), OLD_TAIL, "")
    return strip(F.concat(bare, F.lit(f"\n\n{TAIL}：\n"), tail))


def prompt(template: Column, question: Column, context: Column, room: int) -> Column:
    """A template with {query} and {context} filled in, the context cut to what the template leaves of room."""
    left = F.greatest(F.lit(room) - F.char_length(template), F.lit(0))
    return F.replace(F.replace(template, F.lit("{context}"), F.left(context, left)), F.lit("{query}"), question)
