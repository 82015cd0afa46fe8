"""SimHash near-duplicates, with pivot distance tables.

Fingerprints: 64 bits from XXH64 (seed 42) of the 3-word shingles. Distinct fingerprints that differ in at most
``distance`` bits are linked; documents of linked fingerprints form components.

The pivot distance table is made once and stored: of each distinct fingerprint, its Hamming distances to PIVOTS fixed
reference fingerprints. Distances of linked fingerprints to any pivot differ by at most ``distance`` (triangle
inequality), so pairs whose largest coordinate difference is beyond it are discarded, and only survivors are
verified by their own bits. The distances of random fingerprints lie so close together that one pivot lets about half
of all pairs pass, so pivots alone would compare each with a share of all; the pairs that the table judges come from
segments: with ``distance`` 3, two linked fingerprints agree in one of four 16-bit segments and in one of four 12-bit
parts of the rest, so sixteen tables of 28-bit keys hold every linked pair in at least one bucket. In a bucket the
rows are in the order of the first pivot's distances, and each meets only those within ``distance`` of its own. A
bucket beyond BLOCK fingerprints is cut into blocks, each pair of blocks a group of its own, so no bucket is collected
whole and none is capped; a group gives back a spanning forest of what it links, not all pairs.

Components come from alternating large-star and small-star steps over tables in the shared folder.

Defined results: null text and text without words have fingerprint zero, and link like any other; texts of
fewer words than a shingle give one shingle of what they have; repeated rows are each a document; a null id
counts as larger than all others, so a component of null ids only has component_id null; an empty table gives
an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import LOWER, UPPER, cut, discard, map_rows
from .joins import join_counted

SHINGLE, SEED, DISTANCE, PIVOTS, BLOCK = 3, 42, 3, 24, 4096
_words = re.compile(r"[^\x20\x09-\x0D]+").findall
_lower = str.maketrans(UPPER, LOWER)
#: Keys of 8 bytes up to which a table of them goes to every task.
BROADCAST_KEYS = 4_000_000
#: Shingles whose bits are counted at a time.
PIECE = 1 << 15


def words_of(text: str | None) -> list[str]:
    text = text or ""
    return _words(text.lower() if text.isascii() else text.translate(_lower))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    words = words_of(text)
    if not words:
        return 0
    parts = [words[i:] for i in range(shingle)] if len(words) >= shingle else [[w] for w in words]
    shingles = list(map(" ".join, zip(*parts)))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(shingles), PIECE):
        h = np.array([xxh64_intdigest(s, SEED) for s in shingles[at : at + PIECE]], ">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(shingles)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) for every row; fp is the fingerprint's 64 bits as a signed integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], ["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run, f"doc_id {kind}, fp long")


def pivots(n: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints: fixed, spread over the bits by their rule."""
    return np.array([xxh64_intdigest(f"pivot {i}", SEED) for i in range(n)], np.uint64)


def pivot_table(distinct: DataFrame, n: int = PIVOTS) -> DataFrame:
    """(fp, table): a byte for the Hamming distance of each fingerprint to each pivot; written."""
    signed = pivots(n).view(np.int64).tolist()
    each = [F.substring(F.hex(F.bit_count(F.col("fp").bitwiseXOR(F.lit(p))).cast("long") + 256), -2, 2) for p in signed]
    return cut(distinct.select("fp", F.unhex(F.concat(*each)).alias("table")), "simhash-pivots")


def linked_pairs(fps: np.ndarray, table: np.ndarray, other: np.ndarray | None, other_table: np.ndarray | None, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of linked fingerprints within fps, or between fps and other, some rows of fps at a time. Tables: as of pivot_table()."""
    same = other is None
    other, other_table = (fps, table) if same else (other, other_table)
    left_table, order = table.astype(np.int8), np.argsort(other_table[:, 0], kind="stable")
    right, right_table = other[order], other_table[order].astype(np.int8)
    low = np.searchsorted(right_table[:, 0], left_table[:, 0] - distance, "left")
    high = np.searchsorted(right_table[:, 0], left_table[:, 0] + distance, "right")
    for at in range(0, len(fps), 256):
        some = slice(at, at + 256)
        n = high[some] - low[some]
        i = np.repeat(np.arange(at, at + len(n)), n)
        j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[some], n)
        for k in range(1, left_table.shape[1]):
            if not len(i):
                break
            near = np.abs(left_table[i, k] - right_table[j, k]) <= distance
            i, j = i[near], j[near]
        near = np.bitwise_count(fps[i] ^ right[j]) <= distance
        i, j = i[near], order[j[near]]
        if same:
            i, j = i[i < j], j[i < j]
        yield i, j


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int]]:
    """Of the pairs, those that join what was apart before."""
    root, kept = list(range(n)), []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for i, j in pairs:
        for a, b in zip(i.tolist(), j.tolist()):
            x, y = find(a), find(b)
            if x != y:
                root[max(x, y)] = min(x, y)
                kept.append((a, b))
    return kept


def keys(fp: Column) -> Column:
    """The sixteen bucket keys of a fingerprint: table number, segment and part of the rest."""
    made = []
    for s in range(4):
        segment = F.shiftrightunsigned(fp, 16 * s).bitwiseAND(0xFFFF)
        low = fp.bitwiseAND((1 << 16 * s) - 1)
        rest = F.shiftleft(F.shiftrightunsigned(fp, 16 * s + 16), 16 * s) if s < 3 else F.lit(0)
        rest = rest.bitwiseOR(low)
        for p in range(4):
            part = F.shiftrightunsigned(rest, 12 * p).bitwiseAND(0xFFF)
            made.append(F.lit(((4 * s + p)) << 28).bitwiseOR(F.shiftleft(segment, 12)).bitwiseOR(part))
    return F.array(*made)


def in_blocks(sized: DataFrame, size: str, block: int, others: list[str] = []) -> DataFrame:
    """(key, fp, others, own, x, y): rows of a key, with their number in size, dealt to the pairs (x, y) of its blocks, and these over tasks."""
    blocks = F.ceil(F.col(size) / block).cast("int")
    own = F.pmod(F.xxhash64("fp"), blocks).cast("int")
    # a row goes to every pair of blocks that its own is in; one block, the usual case, is the pair (0, 0)
    dealt = (
        sized.withColumns({"own": own, "blocks": blocks})
        .select("key", "fp", *others, "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"))
        .select("key", "fp", *others, "own", F.least("own", "with").alias("x"), F.greatest("own", "with").alias("y"))
    )
    # comparing takes long for few bytes: a stated number of partitions, so that small ones are not put together
    return dealt.repartition(int(sized.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key", "x", "y")


def links(distinct: DataFrame, distance: int = DISTANCE, block: int = BLOCK, n_pivots: int = PIVOTS) -> DataFrame:
    """(a, b) of fp: links that span every component of the fingerprints in distinct (fp), in either order."""
    if distance > 3:
        raise ValueError("the sixteen tables hold links of at most three bits")
    rows = pivot_table(distinct, n_pivots).select("fp", "table", F.explode(keys(F.col("fp"))).alias("key"))
    counts = cut(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "simhash-buckets")
    sized = join_counted(rows, counts.withColumn("size", F.col("n")), "key", rows.count(), "inner")
    placed = in_blocks(sized, "size", block, ["table"])

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        fp = group["fp"].to_numpy().astype(np.int64)
        table = np.frombuffer(b"".join(group["table"]), np.uint8).reshape(len(fp), -1)
        if group["x"].iat[0] == group["y"].iat[0]:
            pairs = linked_pairs(fp.view(np.uint64), table, None, None, distance)
        else:
            first = (group["own"] == group["x"]).to_numpy()
            at, to = np.flatnonzero(first), np.flatnonzero(~first)
            pairs = ((at[i], to[j]) for i, j in linked_pairs(fp[at].view(np.uint64), table[at], fp[to].view(np.uint64), table[to], distance))
        kept = np.array(forest(len(fp), pairs), np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": fp[kept[:, 0]], "b": fp[kept[:, 1]]})

    return placed.groupBy("key", "x", "y").applyInPandas(compare, "a long, b long").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): every node of edges (a, b) with its component's least node."""
    edges = cut(edges.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).where("lo < hi").distinct(), "links")
    for _ in range(rounds):
        n = edges.count()
        if not n:
            break
        # large star: a node's greater neighbours go to the least of itself and all its neighbours
        both = edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")).union(edges.select("hi", "lo"))
        least = cut(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n")), "links-least")
        large = join_counted(both, least, "u", 2 * n, "inner").where("v > u").select(F.col("m").alias("lo"), F.col("v").alias("hi"))
        large = cut(large.where("lo < hi").distinct(), "links-large")
        discard(least)
        # small star: a node and its lesser neighbours go to the least of them
        least = cut(large.groupBy("hi").agg(F.min("lo").alias("m"), F.count("*").alias("n")), "links-least")
        small = join_counted(large, least, "hi", large.count(), "inner")
        small = small.select(F.col("m").alias("lo"), F.col("lo").alias("hi")).union(least.select(F.col("m").alias("lo"), "hi"))
        after = cut(small.where("lo < hi").distinct(), "links")
        same = after.count() == n and after.exceptAll(edges).isEmpty()
        discard(least, large, edges)
        edges = after
        if same:
            break
    else:
        raise RuntimeError(f"links did not settle in {rounds} rounds")
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(edges.select("lo", "lo").distinct())


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id, root) for every row of docs; root is the component's least fp."""
    rows = cut(fingerprints(docs, shingle, id_col, text_col), "simhash-rows")
    classes = cut(classes_of(rows), "simhash-classes")
    return joined_components(rows, links(classes, distance), classes)


def classes_of(rows: DataFrame) -> DataFrame:
    return rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))


def joined_components(rows: DataFrame, edges: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """(doc_id, fingerprint, component_id, root) for every row of rows (doc_id, fp), by links (a, b) of fp."""
    classes = classes or cut(classes_of(rows), "simhash-classes")
    found = components(edges)
    joined = classes.join(found, classes.fp == found.node, "left").select("fp", "n", "least", F.coalesce("root", "fp").alias("root"))
    joined = cut(joined, "simhash-roots")
    # only classes with links need their root's least document; there is one row a class, never one a copy
    linked = joined.join(found.select(F.col("root").alias("fp")).distinct().union(found.select(F.col("node").alias("fp"))).distinct(), "fp", "left_semi")
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    named = cut(joined.join(least, "root", "left").select("fp", "n", "root", F.coalesce("component_id", "least").alias("component_id")), "simhash-named")
    out = join_counted(rows, named, "fp", rows.count(), "inner")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "root")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", find: Callable = near_duplicates) -> DataFrame:
    """The rows of docs without all but one of each component, with all their columns: that with the least id stays, of
    rows with equal ids that with the least hash of id and text, of rows that share these too any one.

    find gives the components, as near_duplicates does. The keys of the rows that go are sent to every task if they
    are few enough; beyond that the rows are dealt by key.
    """
    columns = [f"c{i}" for i in range(len(docs.columns))]
    id_, text = (F.col(columns[docs.columns.index(c)]) for c in (id_col, text_col))
    keyed = docs.toDF(*columns).withColumn("key", F.xxhash64(id_, id_.isNull(), text))
    found = cut(find(keyed.select(F.struct(id_.isNull().alias("no"), id_.alias("id"), F.col("key").alias("key")).alias("doc_id"), text.alias("text"))), "simhash-found")
    gone = cut(found.where(~found["doc_id"].eqNullSafe(found["component_id"])).select(F.col("doc_id.key").alias("gone")).distinct(), "simhash-gone")
    kept = keyed.join(few(gone), F.col("key") == F.col("gone"), "left_anti")
    repeats = found.where(found["doc_id"].eqNullSafe(found["component_id"])).groupBy(F.col("doc_id.key").alias("again")).agg(F.count("*").alias("n"))
    repeats = cut(repeats.where("n > 1").select("again"), "simhash-repeats")
    if not repeats.isEmpty():
        again = F.col("key") == F.col("again")
        kept = kept.join(few(repeats), again, "left_anti").union(kept.join(few(repeats), again, "left_semi").dropDuplicates(["key"]))
    return kept.drop("key").toDF(*docs.columns)


def few(keys: DataFrame) -> DataFrame:
    """A written table of keys, with a hint to broadcast it if there are at most BROADCAST_KEYS."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys
