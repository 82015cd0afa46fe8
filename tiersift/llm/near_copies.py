"""Near copies by word shingles: texts whose sets of SHINGLE-word shingles have a Jaccard similarity of 0.8 or more.

The join is exact. All sets are put in one order, rarest shingles first; two sets of size s and t that are
similar share a shingle among the first s - ceil(0.8 s) + 1 of one and the first t - ceil(0.8 t) + 1 of the other.
Shingles that occur in one row only link nothing, so few rows are left. Pairs that share one are discarded if
their sizes forbid the similarity, or if the parities of their shingles in 64 parts differ in more bits than
the sets may in shingles; what survives is verified by the sets themselves.

The first pairs come by SimHash: the fingerprints of the sets are linked within three bits by ``simhash.links``, through
its stored pivot distance table. Similar sets may differ in more bits, so the shingles of the prefixes propose the
rest; the sets themselves verify what either proposes.

Large groups of copies give no square of pairs: each row of a fingerprint or a shingle is first held against one row
of it, and then only rows that are in different components by then are paired, in blocks, as ``simhash.links`` does.
Texts that are much alike but not similar stay apart, so the rows of a shingle meet in their square: where they meet,
pairs are held against each other by sketches, the parities of their shingles in some 2 parts a shingle, so few pairs
leave the task. Where more pairs than sets do, each set's nearest pair is verified before all others, for ROUNDS
rounds at most, and only pairs of different components stay.

A shingle's hash is made of its words' hashes, for all shingles of a text at once.

How often shingles occur is counted by the upper half of their hashes, which may only make one look more frequent:
the order stays the same for all rows, so that no pair is lost by it.

Defined results: as in ``simhash``; texts without words are copies of each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from . import hash_arrays
from .common import cut, map_rows, shared_dir, tidy
from .joins import join_counted
from .simhash import SEED, components, few, in_blocks, joined_components
from .simhash import links as simhash_links

SHINGLE, BLOCK, ROUNDS = 5, 4096, 3
#: Shingles that a task holds before it hands them on; shingles of a part of the counts; the most parts.
HELD, PART, MOST_PARTS = 1 << 20, 1 << 20, 1 << 15
#: Bits of a sketch, at most; rows, and pairs, that a task compares at a time.
MOST_BITS, ROWS, PAIRS = 1 << 13, 1 << 15, 1 << 15
#: An odd factor that mixes the hashes of words.
MIX = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of a text's shingles, ascending; of fewer words, one shingle of what there is."""
    words = (text or "").encode().lower().split()  # of bytes: A-Z only, and ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
    size = min(shingle, len(h))
    mixed = np.full(len(h) - size + 1, size, np.uint64)
    for i in range(size):
        mixed ^= h[i : i + len(mixed)]
        mixed *= MIX
        mixed ^= mixed >> np.uint64(32)
    mixed.sort()
    return mixed[np.concatenate([[True], mixed[1:] != mixed[:-1]])]


def majority(hashes: np.ndarray) -> int:
    """The SimHash fingerprint of a set: a bit is 1 if set in over half the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), HELD >> 5):
        some = hashes[at : at + (HELD >> 5)].astype(">u8")
        ones += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def sketch(hashes: np.ndarray) -> bytes:
    """The parities of a set's hashes in parts, a power of two of them, 1.5 a hash at least up to MOST_BITS.

    Sets that differ in d hashes differ in d bits at most, also where a wider sketch is folded to the width of the other.
    """
    bits = min(MOST_BITS, 64 << (max(0, 3 * len(hashes) // 2 - 1) >> 6).bit_length())
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, fp, size) for every row; fp is the set's digest as a signed integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t) for t in b.column(1).to_pylist()]
            fp = np.array([xxh64_intdigest(s.tobytes(), SEED) if len(s) else 0 for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64()), pa.array(list(map(len, sets)), pa.int64())], ["doc_id", "fp", "size"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run, f"doc_id {kind}, fp long, size long")


def repeated(texts: DataFrame, total: int) -> list[tuple[str, str, int]]:
    """Shards (path, low, n) of the shingles that occur in more than one row, by the upper half of their hashes."""
    parts, folder = min(MOST_PARTS, max(16, -(-total // PART))), shared_dir(texts.sparkSession, "shingle-counts")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = (np.arange(1, parts, dtype=np.uint64) << np.uint64(32)) // np.uint64(parts)

        def batch(held: list[np.ndarray]) -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            at = np.searchsorted(h, bounds)
            packed = [pa.array([x.astype("<u4").tobytes() for x in np.split(y, at)], pa.binary()) for y in (h, n)]
            return pa.RecordBatch.from_arrays([pa.array(range(parts), pa.int64()), *packed], ["part", "shingles", "counts"])

        held, n = [], 0
        for b in batches:
            for t in b.column(0).to_pylist():
                held.append(np.unique(shingle_set(t) >> np.uint64(32)))
                n += len(held[-1])
                if n >= HELD:
                    yield batch(held)
                    held, n = [], 0
                    tidy()
        if n:
            yield batch(held)

    def store(group: pa.Table) -> pa.Table:
        # a key and its count as one number: sorted in place, and no more than that in memory
        both = np.frombuffer(b"".join(group["shingles"].to_pylist()), "<u4").astype(np.uint64) << np.uint64(32)
        both |= np.frombuffer(b"".join(group["counts"].to_pylist()), "<u4")
        both.sort()
        h = (both >> np.uint64(32)).astype(np.uint32)
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.empty(0, np.int64)
        n = np.add.reduceat(both & np.uint64(0xFFFFFFFF), first) if len(h) else both
        h, n = h[first][n > 1], n[n > 1]
        del both, first
        tidy()
        if not len(h):
            return pa.table({"path": pa.array([], pa.string()), "low": pa.array([], pa.string()), "n": pa.array([], pa.int64())})
        path, low, size = hash_arrays.store(folder, h.astype(np.uint64), n)
        return pa.table({"path": [path], "low": [low], "n": [size]})

    chunks = map_rows(texts, gather, "part long, shingles binary, counts binary")
    return hash_arrays.shards_of(cut(chunks.repartition(parts, "part").groupBy("part").applyInArrow(store, "path string, low string, n long"), "shingle-counts-manifest"))


def prefixes(texts: DataFrame, shards: list[tuple[str, str, int]]) -> DataFrame:
    """(fp, size, parity, sim, shingles, first, sketch) of every set that may have a similar one.

    sim is its SimHash fingerprint; first are the repeated shingles of its prefix. The counts of many sets are looked
    up at once, as each look goes through all shards.
    """

    def candidates(sets: list[np.ndarray], counts: hash_arrays.Arrays, seen: set[int]) -> pa.RecordBatch:
        rows = []
        found = counts.find(np.concatenate([np.empty(0, np.uint64), *sets]) >> np.uint64(32))
        for s, n in zip(sets, np.split(found, np.cumsum(list(map(len, sets)))[:-1])):
            again = np.flatnonzero(~np.isnan(n))
            room = len(s) - (4 * len(s) + 4) // 5 + 1 - (len(s) - len(again))
            if room <= 0 or (name := xxh64_intdigest(s.tobytes(), SEED)) in seen:
                continue
            seen.add(name)
            first = s[again[np.lexsort((s[again], n[again]))[:room]]]
            parity = np.bitwise_xor.reduce(np.uint64(1) << (s >> np.uint64(58)))
            rows.append((name, len(s), int(parity), majority(s), s.tobytes(), first.view(np.int64), sketch(s)))
        fp, size, parity, sim, shingles, first, sketches = zip(*rows) if rows else [()] * 7
        signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64), pa.int64())
        return pa.RecordBatch.from_arrays([signed(fp), pa.array(size, pa.int64()), signed(parity), signed(sim), pa.array(shingles, pa.binary()), pa.array(first, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], ["fp", "size", "parity", "sim", "shingles", "first", "sketch"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen, held, n = hash_arrays.opened(shards), set(), [], 0
        for b in batches:
            for t in b.column(0).to_pylist():
                s = shingle_set(t)
                if len(s):
                    held.append(s)
                    n += len(s)
                if n >= HELD >> 1:
                    yield candidates(held, counts, seen)
                    held, n = [], 0
        if held:
            yield candidates(held, counts, seen)

    return map_rows(texts, run, "fp long, size long, parity long, sim long, shingles binary, first array<long>, sketch binary").dropDuplicates(["fp"])


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar."""
    side = lambda c: sets.select(F.col("fp").alias(c), F.col("shingles").alias(f"{c}_set"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(5 * both >= 4 * (len(x) + len(y) - both))
            yield b.select([0, 1]).filter(pa.array(good, pa.bool_()))

    joined = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_set", "b_set")
    return cut(map_rows(joined, run, "a long, b long"), "copies-verified")


def bits_apart(i: np.ndarray, j: np.ndarray, words: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Bits in which the sketches of rows i and j differ, at the width of the smaller. A row has n words from at on."""

    def folded(rows: np.ndarray, width: int) -> np.ndarray:
        out = words[at[rows, None] + np.arange(width)]
        for k in range(1, int(n[rows].max()) // width):
            more = np.flatnonzero(n[rows] > k * width)
            out[more] ^= words[at[rows[more], None] + np.arange(k * width, (k + 1) * width)]
        return out

    out, width = np.empty(len(i), np.int64), np.minimum(n[i], n[j])
    for w in np.unique(width).tolist():
        some = np.flatnonzero(width == w)
        out[some] = np.bitwise_count(folded(i[some], w) ^ folded(j[some], w)).sum(1, dtype=np.int64)
    return out


def may_be_similar(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """(a, b, far) of fp: pairs of whole groups (key, x, y) whose sizes and sketches allow them, of different roots. rows: by key, x, y, own, size."""
    key, x, y, own, size, root, fp = (rows[c].to_numpy().astype(np.int64) for c in ("key", "x", "y", "own", "size", "root", "fp"))
    sketches = rows["sketch"].to_pylist()
    words = np.frombuffer(b"".join(sketches), "<u8")
    n_words = np.array([len(s) // 8 for s in sketches], np.int64)
    at = np.cumsum(n_words) - n_words
    group = np.concatenate([[True], (key[1:] != key[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
    part = np.cumsum(group | np.concatenate([[True], own[1:] != own[:-1]])) - 1  # the rows of a group that are of one block
    group = np.cumsum(group)[np.searchsorted(part, np.arange(part[-1] + 1))]
    # a row meets the later ones of its own block, or those of the other block, where the sizes allow it
    cross = x != y
    to = np.minimum(part + cross, part[-1])
    meets = ~cross | ((own == x) & (to > part) & (group[to] == group[part]))
    place = (part << 32) + size
    low = np.where(cross, np.searchsorted(place, (to << 32) + (4 * size + 4) // 5), np.arange(len(fp)) + 1)
    n = np.where(meets, np.maximum(np.searchsorted(place, (to << 32) + 5 * size // 4, "right") - low, 0), 0)
    ends = np.cumsum(n)
    for begin in range(0, int(ends[-1]), PAIRS):
        pair = np.arange(begin, min(begin + PAIRS, int(ends[-1])))
        i = np.searchsorted(ends, pair, "right")
        j = low[i] + pair - (ends[i] - n[i])
        i, j = i[some := root[i] != root[j]], j[some]
        bits, both = bits_apart(i, j, words, at, n_words), size[i] + size[j]
        near = 9 * bits <= both
        i, j, far = i[near], j[near], bits[near] / both[near]
        found = pd.DataFrame({"a": np.minimum(fp[i], fp[j]), "b": np.maximum(fp[i], fp[j]), "far": far}).drop_duplicates()
        if len(found):
            yield pa.RecordBatch.from_pandas(found, preserve_index=False)


def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """may_be_similar() for the rows of a task; a group is whole before it is compared."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) < ROWS:
            continue
        rows = pa.Table.from_batches(held)
        key, x, y = (rows[c].to_numpy() for c in ("key", "x", "y"))
        last = int(np.flatnonzero((key != key[-1]) | (x != x[-1]) | (y != y[-1]))[-1:].sum() + 1) if (key[0], x[0], y[0]) != (key[-1], x[-1], y[-1]) else 0
        if last:
            yield from may_be_similar(rows.slice(0, last))
        held = rows.slice(last).combine_chunks().to_batches()
    if held:
        yield from may_be_similar(pa.Table.from_batches(held))


def nearest_first(pairs: DataFrame, sets: DataFrame, found: DataFrame, done: DataFrame, most: int) -> DataFrame:
    """Similar pairs that join with done, of components found, what all similar ones of pairs (a, b, far) would."""
    for _ in range(ROUNDS):
        if pairs.count() <= most:
            break
        ends = pairs.select(F.col("a").alias("of"), "a", "b", "far").union(pairs.select("b", "a", "b", "far"))
        near = cut(ends.groupBy("of").agg(F.min(F.struct("far", "a", "b")).alias("x")).select("x.a", "x.b").distinct(), "copies-nearest")
        done = done.union(verified(near, sets))
        found = cut(components(done).withColumnRenamed("node", "fp"), "copies-again")
        side = lambda c: few(found.select(F.col("fp").alias(c), F.col("root").alias(f"{c}_root")))  # noqa: E731, B023
        joined = pairs.join(near, ["a", "b"], "left_anti").join(side("a"), "a", "left").join(side("b"), "b", "left")
        pairs = cut(joined.where(F.coalesce("a_root", "a") != F.coalesce("b_root", "b")).select("a", "b", "far"), "copies-pairs")
    return done.union(verified(pairs.select("a", "b"), sets))


def fingerprint_pairs(sets: DataFrame) -> DataFrame:
    """(a, b) of fp: sets whose SimHash fingerprints are linked, by one set of each fingerprint. sets: as of prefixes(), written."""
    heads = cut(sets.groupBy("sim").agg(F.min("fp").alias("head"), F.count("*").alias("n")), "copies-fingerprints")
    found = cut(simhash_links(heads.select(F.col("sim").alias("fp"))), "copies-fingerprint-links")
    side = lambda c: few(heads.select(F.col("sim").alias(c), F.col("head").alias(f"{c}_head")))
    apart = found.join(side("a"), "a").join(side("b"), "b").select(F.col("a_head").alias("a"), F.col("b_head").alias("b"))
    alike = join_counted(sets.select("sim", "fp"), heads, "sim", sets.count(), "inner").where("fp <> head")
    return apart.union(alike.select(F.col("head").alias("a"), F.col("fp").alias("b")))


def links(sets: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b) of fp: links that span every component of similar sets. sets: as of prefixes(), written."""
    rows = cut(sets.select("fp", "size", "parity", F.explode("first").alias("key")), "copies-keys")
    counts = rows.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("fp", "size", "parity")).alias("head"))
    counts = cut(counts.where("n > 1").withColumn("rows", F.col("n")), "copies-buckets")
    sized = cut(join_counted(rows, counts, "key", rows.count(), "inner"), "copies-sized")

    def may(size: Column, parity: Column) -> Column:
        near = 9 * F.bit_count(parity.bitwiseXOR(F.col("parity"))) <= size + F.col("size")
        return near & (5 * F.least(size, "size") >= 4 * F.greatest(size, "size"))

    star = sized.where((F.col("fp") != F.col("head.fp")) & may(F.col("head.size"), F.col("head.parity")))
    proposed = fingerprint_pairs(sets).union(star.select(F.col("head.fp").alias("a"), F.col("fp").alias("b")))
    first = verified(proposed.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), sets)
    found = cut(components(first).withColumnRenamed("node", "fp"), "copies-first")
    rest = sized.select("key", "fp", "size", F.col("rows").alias("n")).join(found, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rest = cut(rest, "copies-rest")
    apart = rest.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("key", "n")
    rest = join_counted(rest.drop("n"), cut(apart.withColumn("rows", F.col("n")), "copies-apart"), "key", rest.count(), "inner").withColumnRenamed("rows", "rows_of")
    rest = rest.join(sets.select("fp", "sketch"), "fp")
    placed = in_blocks(rest, "rows_of", block, ["size", "root", "sketch"]).sortWithinPartitions("key", "x", "y", "own", "size")
    pairs = cut(map_rows(placed, compare, "a long, b long, far double").distinct(), "copies-pairs")
    return nearest_first(pairs, sets, found, first, sets.count())


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id, root) for every row of docs; fingerprint is the set's digest, root the component's least."""
    rows = cut(digests(docs, id_col, text_col), "copies-rows")
    texts = docs.select(F.col(text_col).alias("text"))
    shards = repeated(texts, rows.agg(F.sum("size")).first()[0] or 0)
    sets = cut(prefixes(texts, shards), "copies-sets") if shards else None
    return joined_components(rows.drop("size"), links(sets) if sets else rows.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0))
