"""Benchmark decontamination by a distributed positional inverted index. DataFrame functions only.

A pass over the corpus counts the benchmark's terms. An item is cut into blocks of half a window: every window holds a
whole block. A block's anchors are its rarest term and the rarest of its others, each with a neighbour in the block.
The index stores postings (term, with, row_key, pos, around): the places where a term stands before the word ``with``,
and the words around, sorted by term in each of its files. A posting of a block's rarest anchor, shifted by the anchor's place in
the item, proposes that the item starts at a position of the document (an alignment); it stands if the list of the
second anchor, shifted alike, holds it too. The windows around a block that stands are verified word for word in the
posting's words around, so no text is read again, and none is ever shuffled.

Proximity: an item is near a document if the item's two rarest different terms stand at most a window apart in it, in
either order. Their postings have ``with`` empty. Each posting is held against the last one of the other term only.

The index is made over the words of the exact rule: lower() changes some letters by what stands beside them, so that a
word of an item could differ from the same word of a document.

Hit words are gathered as bits of cells of 64 words, and copies of a row (equal id and text) are combined before every
shuffle. Rows are named by a 64-bit hash of id and text.

Defined results: null text, of a document or an item, has no words; an item without words has no windows; equal
ids of several items count as one item, a null item id is read as "null"; repeated documents get equal rows;
empty tables give no items, or no rows; other columns are not read; a document of any length is read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, lower_ascii
from .joins import join_counted

WINDOW, MIN_ITEMS = 8, 2
#: Fixed value: what separates words, in lower case or as they are.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Rows and bytes of a table up to which a copy goes to every task; larger ones are shuffled.
BROADCAST_ROWS, BROADCAST_BYTES = 2_000_000, 32 << 20


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SEPARATORS), "")


def small(df: DataFrame, *texts: str) -> DataFrame:
    """df, a written table, with a hint to broadcast it if its rows and the bytes of its texts are within bounds."""
    size = F.lit(0)
    for t in texts:
        size = size + F.octet_length(t)
    found = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()
    return F.broadcast(df) if found.n <= BROADCAST_ROWS and found.bytes <= BROADCAST_BYTES else df


def items_of(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(iid, item_id, words): the distinct items with words."""
    rows = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("item_id"), words(lower_ascii(F.col(text_col))).alias("words"))
    return rows.where(F.size("words") > 0).distinct().withColumn("iid", F.xxhash64("item_id", "words"))


def term_counts(docs: DataFrame, terms: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, n) over the whole corpus for the terms given; those that never occur have n 0."""
    found = docs.select(F.explode(words(lower_ascii(F.col(text_col)))).alias("term"))
    counted = found.join(small(terms, "term"), "term").groupBy("term").agg(F.count("*").alias("n"))
    return terms.join(counted, "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("n"))


def anchors_of(items: DataFrame, counts: DataFrame, n: int = WINDOW) -> DataFrame:
    """(iid, block, length, first, first_term, first_with, second, second_term, second_with) of every block.

    first and second are places in the item; with is the word after the term, or empty in a block of one word.
    """
    size, half = F.size("words"), (n + 1) // 2
    length = F.least(size, F.lit(half))
    blocks = items.select("iid", F.col("words").alias("terms"), length.alias("length"), F.explode(F.sequence(F.lit(0), size - length, length)).alias("block"))
    places = blocks.select("iid", "block", "length", "terms", F.explode(F.sequence(F.col("block"), F.col("block") + F.col("length") - 1)).alias("place"))
    ranked = places.withColumn("term", F.get("terms", F.col("place"))).join(counts, "term").groupBy("iid", "block", "length", F.col("terms")).agg(F.sort_array(F.collect_list(F.struct("n", "place"))).alias("by"))
    # a pair starts at the rare term, or before it where that is the block's last
    start = lambda place: F.least(place, F.greatest(F.col("block") + F.col("length") - 2, F.col("block")))
    first = start(F.get("by", F.lit(0))["place"])
    others = F.filter(F.transform("by", lambda x: start(x["place"])), lambda p: p != first)
    found = ranked.select("iid", "block", "length", "terms", first.alias("first"), F.coalesce(F.get(others, F.lit(0)), first).alias("second"))
    after = lambda place: F.when(F.col("length") > 1, F.get("terms", F.col(place) + 1)).otherwise(F.lit(""))
    return found.select("iid", "block", "length", "first", F.get("terms", F.col("first")).alias("first_term"), after("first").alias("first_with"), "second", F.get("terms", F.col("second")).alias("second_term"), after("second").alias("second_with"))


def rarest_of(items: DataFrame, counts: DataFrame) -> DataFrame:
    """(iid, term, other): the two rarest different terms of every item that has two."""
    terms = items.select("iid", F.explode(F.array_distinct("words")).alias("term")).join(counts, "term")
    best = terms.groupBy("iid").agg(F.slice(F.sort_array(F.collect_list(F.struct("n", "term"))), 1, 2).alias("best")).where(F.size("best") == 2)
    return best.select("iid", F.get("best", F.lit(0))["term"].alias("term"), F.get("best", F.lit(1))["term"].alias("other"))


def positional_index(docs: DataFrame, wanted: DataFrame, n: int = WINDOW) -> DataFrame:
    """The postings (term, with, row_key, pos, around, base) of wanted (term, with) in docs (row_key, text).

    Written, and sorted by term in each file. around: the words from place base of the document to n after pos, of
    those with ``with``; base is at most n before pos. wanted should be a written table.
    """
    pairs = wanted.where("with <> ''").select(F.col("term").alias("pair_term"), F.col("with").alias("pair_with"))
    alone = wanted.where("with = ''").select(F.col("term").alias("alone_term"))
    # generated code may make a plain column again for each word, so key and words are made as one
    once = F.array(F.struct("row_key", words(lower_ascii(F.col("text"))).alias("ws")))
    every = docs.select(F.explode(once).alias("doc")).select("doc.row_key", "doc.ws")
    every = every.select("row_key", "ws", F.posexplode("ws").alias("pos", "term"))
    every = every.withColumn("with", F.coalesce(F.get("ws", F.col("pos") + 1), F.lit("")))
    found = every.join(small(pairs, "pair_term", "pair_with"), (F.col("term") == F.col("pair_term")) & (F.col("with") == F.col("pair_with")), "left")
    found = found.join(small(alone, "alone_term"), F.col("term") == F.col("alone_term"), "left").where("pair_term is not null or alone_term is not null")
    base = F.greatest(F.col("pos") - n, F.lit(0))
    # the words around are cut here, so that what follows carries these and not a document's words
    around = F.slice("ws", base + 1, F.col("pos") - base + n + 1)
    pair, single = F.when(F.col("pair_term").isNotNull(), F.col("with")), F.when(F.col("alone_term").isNotNull(), F.lit(""))
    found = found.select("term", "row_key", "pos", base.alias("base"), around.alias("around"), F.array(pair, single).alias("kinds"))
    kept = found.select("term", "row_key", "pos", "base", "around", F.explode("kinds").alias("with")).where("with is not null")
    return cut(kept.select("term", "with", "row_key", "pos", "base", "around").sortWithinPartitions("term"), "positional-index")


def phrases(index: DataFrame, items: DataFrame, anchors: DataFrame, n: int = WINDOW) -> DataFrame:
    """(row_key, item_id, start, length): the windows of items that occur in documents, by their first word's position."""
    one = anchors.select(F.col("first_term").alias("term"), F.col("first_with").alias("with"), "iid", "block", F.col("length").alias("block_length"), "first", "second")
    two = anchors.select(F.col("second_term").alias("term"), F.col("second_with").alias("with"), "iid", F.col("second").alias("place")).distinct()
    key = ["row_key", "iid", "align", "place"]
    rare = index.join(small(one, "term", "with"), ["term", "with"]).select("row_key", "iid", (F.col("pos") - F.col("first")).alias("align"), F.col("second").alias("place"), "block", "block_length", "base", "around")
    rare = rare.groupBy(*key).agg(*[F.first(c).alias(c) for c in ("block", "block_length", "base", "around")])
    other = index.join(small(two, "term", "with"), ["term", "with"]).select("row_key", "iid", (F.col("pos") - F.col("place")).alias("align"), "place").distinct()
    stand = rare.join(other, key, "left_semi")
    stand = stand.join(small(items.select("iid", "item_id", F.array_join("words", " ").alias("joined")), "item_id", "joined"), "iid").withColumn("words", F.split("joined", " "))
    size = F.size("words")
    length = F.least(size, F.lit(n))
    first = F.greatest(F.col("block") + F.col("block_length") - length, F.lit(0), -F.col("align"))
    last = F.least(F.col("block"), size - length)
    same = lambda s: F.slice("words", s + 1, length) == F.slice("around", F.col("align") + s - F.col("base") + 1, length)
    starts = F.filter(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>")), same)
    return stand.select("row_key", "item_id", "align", length.alias("length"), F.explode(starts).alias("s")).select("row_key", "item_id", (F.col("align") + F.col("s")).alias("start"), "length")


def proximity(index: DataFrame, pairs: DataFrame, within: int) -> DataFrame:
    """(query, row_key, pos, other_pos): postings of pairs (query, term, other) with the last posting of the other term before them, if at most ``within`` words away."""
    sides = pairs.select("query", "term", F.lit(0).alias("side")).union(pairs.select("query", F.col("other").alias("term"), F.lit(1).alias("side")))
    sides = cut(sides, "proximity-terms")
    places = index.where(F.col("with") == "").select("term", "row_key", "pos").join(small(sides, "term"), "term").select("query", "row_key", "pos", "side").distinct()
    before = Window.partitionBy("query", "row_key").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    last = lambda side: F.max(F.when(F.col("side") == side, F.col("pos"))).over(before)
    near = places.withColumn("other_pos", F.when(F.col("side") == 0, last(1)).otherwise(last(0)))
    return near.where(F.col("pos") - F.col("other_pos") <= within).select("query", "row_key", "pos", "other_pos")


def judged(rows: DataFrame, benchmark: DataFrame, n: int, min_items: int) -> DataFrame:
    """(row_key, n_hit, names, n_near) of the rows (row_key, text) in which something of an item occurs, one row a key."""
    items = cut(items_of(benchmark), "items")
    terms = cut(items.select(F.explode("words").alias("term")).distinct(), "item-terms")
    counts = cut(term_counts(rows, terms), "item-term-counts")
    anchors = cut(anchors_of(items, counts, n), "item-anchors")
    rarest = cut(rarest_of(items, counts), "item-rarest")
    wanted = anchors.select(F.col("first_term").alias("term"), F.col("first_with").alias("with")).union(anchors.select("second_term", "second_with"))
    wanted = wanted.union(rarest.select("term", F.lit(""))).union(rarest.select("other", F.lit("")))
    index = positional_index(rows, cut(wanted.distinct(), "item-wanted"), n)
    windows = phrases(index, items, anchors, n)
    # a window covers bits of one cell of 64 words or of two (of more if windows are longer)
    cell = F.floor(F.col("start") / 64).cast("int")
    cells = F.explode(F.sequence(cell, F.floor((F.col("start") + F.col("length") - 1) / 64).cast("int")))
    bits = windows.select("row_key", "start", "length", cells.alias("cell")).distinct()
    low, high = F.greatest(F.col("start") - 64 * F.col("cell"), F.lit(0)), F.least(F.col("start") + F.col("length") - 64 * F.col("cell"), F.lit(64))
    ones = F.when(high - low >= 64, F.lit(-1).cast("long")).otherwise(F.call_function("shiftleft", F.call_function("shiftleft", F.lit(1).cast("long"), (high - low).cast("int")) - 1, low.cast("int")))
    hit = bits.groupBy("row_key", "cell").agg(F.bit_or(ones).alias("mask")).groupBy("row_key").agg(F.sum(F.bit_count("mask")).alias("n_hit"))
    named = windows.select("row_key", "item_id").distinct().groupBy("row_key").agg(F.array_sort(F.collect_list("item_id")).alias("names"))
    ids = items.select(F.col("iid").alias("query"), "item_id")
    near = proximity(index, rarest.withColumnRenamed("iid", "query"), n).select("query", "row_key").distinct().join(small(cut(ids, "item-ids"), "item_id"), "query")
    near = near.select("row_key", "item_id").distinct().groupBy("row_key").agg(F.count("*").alias("n_near"))
    return cut(hit.join(named, "row_key", "full").join(near, "row_key", "full"), "contamination")


def row_key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col), F.col(id_col).isNull(), F.col(text_col))


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, min_items: int = MIN_ITEMS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near) for every row of docs; n_near: items near it."""
    text = F.col(text_col)
    found = judged(docs.select(row_key(id_col, text_col).alias("row_key"), text.alias("text")), benchmark, n, min_items)
    rows = docs.select(row_key(id_col, text_col).alias("row_key"), F.col(id_col).alias("doc_id"), F.coalesce(F.array_size(words(text)), F.lit(0)).cast("long").alias("n_words"))
    rows = cut(rows, "contamination-rows")
    repeats = rows.groupBy("row_key").agg(F.count("*").alias("n"))
    out = join_counted(rows, cut(found.join(repeats, "row_key"), "contamination-counted"), "row_key", rows.count())
    names = F.coalesce("names", F.array().cast("array<string>"))
    n_items = F.size(names).cast("long")
    zero = F.lit(0).cast("long")
    return out.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", zero).alias("n_hit"),
        n_items.alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        (n_items >= min_items).alias("contaminated"),
        F.coalesce("n_near", zero).alias("n_near"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, min_items: int = MIN_ITEMS, text_col: str = "text") -> DataFrame:
    """The rows of docs that are not contaminated, with all their columns, whatever their names.

    A row is judged by its text alone. The keys of contaminated texts go to every task if they are few enough; beyond
    that the rows are dealt by key.
    """
    columns = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*columns)
    text = columns[docs.columns.index(text_col)]
    key = F.xxhash64(text)
    found = judged(plain.select(key.alias("row_key"), F.col(text).alias("text")), benchmark, n, min_items)
    bad = cut(found.where(F.size("names") >= min_items).select(F.col("row_key").alias("bad_key")), "contaminated")
    return plain.join(small(bad), key == F.col("bad_key"), "left_anti").toDF(*docs.columns)
