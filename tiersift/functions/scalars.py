"""Scalar functions of retrieval, context, uploads and sessions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The mark after a cut block, the least distance that counts as one, Chinese characters, and tokens.
CUT_MARK, TINY = "\n...[内容截断]", 1e-8
#: White space of any script.
WHITE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
CHINESE = "[一-鿿]"
TOKEN = f"{CHINESE}|[a-zA-Z0-9_]+"
#: Dense and sparse weights by intent and by whether whole papers are ranked.
FUSION_WEIGHTS = {("fact_qa", True): (0.9, 1.15), ("fact_qa", False): (1.0, 1.2), ("general_overview", False): (1.3, 0.9), ("", True): (1.15, 0.95), ("", False): (1.2, 0.9)}
#: What a question for a whole document says, and what one for a part of it says.
WHOLE_MARKS, PART_MARKS = ["整篇", "全文", "全篇", "整份", "主要贡献", "总体概述"], ["第", "页", "章节", "方法设计", "结果部分", "摘要里"]
#: Bounds and defaults of generation.
DAY_S, EXPIRY_DAYS, TITLE_CHARS, NEW_TITLE, RENAME_CHARS = 86_400, 30, 24, "新对话", 100


def strip(text: Column) -> Column:
    """Without white space of any script at its ends."""
    return F.btrim(text, F.lit(WHITE))


def distance_score(distance: Column) -> Column:
    """A distance as a score: its inverse, or 1 for no distance."""
    return F.when(distance > 0, 1 / (distance + TINY)).otherwise(F.lit(1.0))


def positive_score(score: Column) -> Column:
    """Negative scores brought between 0 and 1."""
    return F.when(score < 0, 1 / (1 - score + TINY)).otherwise(score)


def fusion_weights(intent: str, level: str) -> tuple[float, float]:
    """The weights of the dense and the sparse arm."""
    paper = level == "paper"
    return FUSION_WEIGHTS.get((intent, paper), FUSION_WEIGHTS["", paper])


def blend_weights(original: float, model: float) -> tuple[float, float]:
    """Two weights brought to a sum of 1."""
    total = max(original + model, TINY)
    return original / total, model / total


def cosine_distance(a: Column, b: Column) -> Column:
    """1 less the cosine of two vectors, in double; null where one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    return 1 - F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def tokens(text: Column) -> Column:
    """Chinese characters and runs of letters, digits and underscores, in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def token_count(text: Column) -> Column:
    """Chinese characters and words of Latin letters, counted without a tokenizer."""
    return F.coalesce(F.regexp_count(text, F.lit(CHINESE)) + F.regexp_count(text, F.lit(r"(?U)\b[a-zA-Z]+\b")), F.lit(0))


def chinese_ratio(text: Column) -> Column:
    """Chinese characters as a part of these and Latin letters; 0 for neither."""
    chinese = F.regexp_count(text, F.lit(CHINESE))
    return F.coalesce(F.try_divide(chinese, chinese + F.regexp_count(text, F.lit("[a-zA-Z]"))), F.lit(0.0))


def shortened(text: Column, limit: int) -> Column:
    """Blanks and tabs collapsed, at most one empty line kept, and cut after limit characters with three dots."""
    flat = F.regexp_replace(F.regexp_replace(strip(F.coalesce(text, F.lit(""))), r"[ \t]+", " "), r"\n{3,}", "\n\n")
    return F.when(F.char_length(flat) <= limit, flat).otherwise(F.concat(F.rtrim(F.left(flat, F.lit(limit)), F.lit(WHITE)), F.lit("...")))


def cut_block(text: Column, room: Column) -> Column:
    """A block in the room that is left: whole, or cut with a mark, or cut bare if the mark has no room."""
    mark = F.lit(CUT_MARK)
    short = F.concat(F.rtrim(F.left(text, room - F.char_length(mark)), F.lit(WHITE)), mark)
    return F.when(room <= 0, F.lit("")).when(F.char_length(text) <= room, text).when(room <= F.char_length(mark), F.left(text, room)).otherwise(short)


def whole_number(value: Column, default: int) -> Column:
    """A number as an integer, or the default for what is none."""
    return F.coalesce(F.try_cast(value, "int") if hasattr(F, "try_cast") else value.try_cast("int"), F.lit(default))


def page_number(value: Column) -> Column:
    """A page, counted from 1; what is no page is page 1."""
    return F.greatest(whole_number(value, 1), F.lit(1))


def normal_hash(value: Column) -> Column:
    """A document's hash in lower case without blanks around it; null if nothing is left."""
    return F.nullif(F.lower(strip(value)), F.lit(""))


def document_hash(doc_hash: Column, paper_id: Column) -> Column:
    """The hash that metadata name, or else that of the paper's id; empty if there is none."""
    of_paper = F.regexp_extract(F.coalesce(F.lower(strip(paper_id)), F.lit("")), "^(.*)_paper$", 1)
    return F.coalesce(normal_hash(doc_hash), of_paper)


def dedupe_key(section_id: Column, paper_title: Column, section_title: Column, page: Column, text: Column) -> Column:
    """What names a hit's section: its id, or its titles and page, or its text."""
    plain = lambda c: strip(F.coalesce(c.cast("string"), F.lit("")))
    named = F.concat(F.lit("section:"), F.lower(plain(paper_title)), F.lit("|"), F.lower(plain(section_title)), F.lit("|"), plain(page))
    return F.when(plain(section_id) != "", F.concat(F.lit("section_id:"), plain(section_id))).when(plain(section_title) != "", named).otherwise(F.concat(F.lit("text:"), F.lower(plain(text))))


def asks_for_whole(query: Column) -> Column:
    """Whether a question is for a whole document and names no part of one."""
    says = lambda marks: F.coalesce(query.rlike("|".join(marks)), F.lit(False))
    return says(WHOLE_MARKS) & ~says(PART_MARKS)


def clamped(value: Column, default: float, low: float, high: float, zero_counts: bool = False) -> Column:
    """A parameter within its bounds; null, and 0 unless it counts, stand for the default."""
    given = value if zero_counts else F.nullif(value, F.lit(0))
    return F.greatest(F.lit(low), F.least(F.coalesce(given, F.lit(default)), F.lit(high)))


def generation_window(context: Column, tokens_wanted: Column) -> tuple[Column, Column]:
    """(tokens to generate, room for the prompt) of a context, 8 kept free."""
    size = F.greatest(F.coalesce(context, F.lit(16)), F.lit(16))
    made = F.least(F.greatest(F.coalesce(tokens_wanted, F.lit(1)), F.lit(1)), F.greatest(size - 8, F.lit(1)))
    return made, F.greatest(size - made - 8, F.lit(1))


def seconds(stamp: Column, now_s: int) -> Column:
    """A time in seconds; one that lies beyond now, were it milliseconds, is taken for milliseconds."""
    return F.when(stamp > now_s * 1000, F.floor(stamp / 1000)).otherwise(stamp)


def is_expired(created: Column, now_s: int, days: int = EXPIRY_DAYS) -> Column:
    """Older than so many days. As in ``seconds``, only stamps beyond now in milliseconds are read as such; 0 never expires."""
    return F.coalesce((created != 0) & (F.lit(now_s) - seconds(created, now_s) > days * DAY_S), F.lit(False))


def is_uuid(text: Column) -> Column:
    """Whether a text is a UUID: 32 hex digits, with hyphens, braces or the urn prefix or without."""
    bare = F.translate(F.regexp_replace(text, "urn:|uuid:", ""), "{}-", "")
    return F.coalesce(bare.rlike("^[0-9a-fA-F]{32}$"), F.lit(False))


def session_title(title: Column, message: Column) -> Column:
    """A session's title, or the start of its first message while it has none of its own."""
    return F.when(F.coalesce(title, F.lit(NEW_TITLE)) == NEW_TITLE, F.left(F.coalesce(message, F.lit("")), F.lit(TITLE_CHARS))).otherwise(title)


def renamed(title: Column) -> Column:
    return F.left(title, F.lit(RENAME_CHARS))


def event_frame(payload: Column) -> Column:
    """A struct as one server-sent event."""
    return F.concat(F.lit("data: "), F.to_json(payload), F.lit("\n\n"))


def last_turns(history: Column, k: int) -> Column:
    size = F.size(history)
    return F.slice(history, F.greatest(size - k + 1, F.lit(1)), k) if k > 0 else F.slice(history, 1, 0)


def prior_turns(history: Column, k: int, m: int) -> Column:
    """The m turns before the last k."""
    size = F.size(history)
    start = F.greatest(size - k - m, F.lit(0))
    return F.slice(history, start + 1, F.greatest(size - k - start, F.lit(0)))
