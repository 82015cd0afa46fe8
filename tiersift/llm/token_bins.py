"""Token-id files in fixed-width bit packing.

A shard holds the ids of consecutive documents, each id in the fewest bits that the vocabulary needs:

    magic (8 bytes) | bits, block_ids (u32) | n_docs, n_ids, n_blocks (u64)
    doc_id of each document (i64) | its null flag (u8) | start of each document in the shard, and n_ids (u64)
    byte offset of each block from the first block, and their end (u64)
    blocks: block_ids ids each, the last fewer, packed from the low bits of little-endian 64-bit words up

Any run of ids is read by its blocks alone, and a block is unpacked by one vector operation for each of the 64
places of an id in a group of 64, whose words are always ``bits``.

Shards are written by the tasks of a range partitioning by document id. A task writes under a name of its own
attempt, and only the names in the written manifest count, so lost executors and repeated attempts leave at
most unused files. Storage is whatever pyarrow.fs can reach from a URI.

Defined results: null text is empty text, whose only id is the end id; null ids come first; rows with equal ids
follow each other in the order of their texts' hashes; an empty table writes no shard and reads as no rows;
other columns of the input are not read. A document of any length goes to one shard.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, limit_batches, shared_dir
from .pretokens import splits_at_each_space

MAGIC = b"TSBITS1\0"
HEAD = struct.Struct("<8sIIQQQ")
BLOCK_IDS = 1 << 16
#: A shard is closed when it has so many ids: bounds what a task holds.
SHARD_IDS = 1 << 22
#: Units that are encoded as one text; bytes of text whose words are numbered together.
JOINED, HELD = 1000, 16 << 20


def width(vocab_size: int) -> int:
    """The fewest bits that hold ids below vocab_size."""
    return max(1, (vocab_size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """ids in bits each; groups of 64 ids fill whole words, and bytes after the last id are left out."""
    n = len(ids)
    groups = np.zeros((-(-n // 64), 64), np.uint64)
    groups.reshape(-1)[:n] = ids
    columns, words = np.ascontiguousarray(groups.T), np.zeros((bits, len(groups)), np.uint64)
    for k in range(64):
        w, shift = divmod(k * bits, 64)
        words[w] |= columns[k] << np.uint64(shift)
        if shift + bits > 64:
            words[w + 1] |= columns[k] >> np.uint64(64 - shift)
    return np.ascontiguousarray(words.T).astype("<u8").tobytes()[: -(-n * bits // 8)]


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    """The first n ids of packed data."""
    count = -(-n // 64)
    padded = np.zeros(count * bits * 8, np.uint8)
    padded[: len(data)] = np.frombuffer(data, np.uint8)[: len(padded)]
    words = np.ascontiguousarray(padded.view("<u8").reshape(count, bits).T)
    columns, mask = np.empty((64, count), np.uint32), np.uint64((1 << bits) - 1)
    for k in range(64):
        w, shift = divmod(k * bits, 64)
        x = words[w] >> np.uint64(shift)
        if shift + bits > 64:
            x = x | words[w + 1] << np.uint64(64 - shift)
        columns[k] = x & mask
    return np.ascontiguousarray(columns.T).reshape(-1)[:n]


def write_shard(path: str, doc_ids: list, docs: list[np.ndarray], bits: int, block_ids: int = BLOCK_IDS) -> int:
    """Writes one shard; returns its number of ids."""
    starts = np.array([0, *accumulate(map(len, docs))], "<u8")
    ids, n = np.concatenate(docs) if docs else np.empty(0, np.uint32), int(starts[-1])
    blocks = [pack(ids[i : i + block_ids], bits) for i in range(0, n, block_ids)]
    store, name = fs.FileSystem.from_uri(path)
    store.create_dir(name.rpartition("/")[0], recursive=True)
    with store.open_output_stream(name) as f:
        f.write(HEAD.pack(MAGIC, bits, block_ids, len(docs), n, len(blocks)))
        f.write(np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes())
        f.write(np.array([d is None for d in doc_ids], "u1").tobytes())
        f.write(starts.tobytes())
        f.write(np.array([0, *accumulate(map(len, blocks))], "<u8").tobytes())
        for b in blocks:
            f.write(b)
    return n


class Shard:
    """A shard opened for random access: only its tables are in memory."""

    def __init__(self, path: str):
        store, name = fs.FileSystem.from_uri(path)
        self.file = store.open_input_file(name)
        magic, self.bits, self.block_ids, n_docs, self.n_ids, n_blocks = HEAD.unpack(self.file.read(HEAD.size))
        if magic != MAGIC:
            raise ValueError(f"{path} is no token-id shard")
        ids = np.frombuffer(self.file.read(8 * n_docs), "<i8").tolist()
        self.doc_ids = [None if no else d for d, no in zip(ids, self.file.read(n_docs))]
        self.starts = np.frombuffer(self.file.read(8 * n_docs + 8), "<u8").astype(np.int64)
        self.blocks = np.frombuffer(self.file.read(8 * n_blocks + 8), "<u8").astype(np.int64)
        self.base = self.file.tell()

    def ids(self, first: int, end: int) -> np.ndarray:
        """Ids first to end of the shard, read from the blocks that hold them."""
        if first >= end:
            return np.empty(0, np.uint32)
        a, b = first // self.block_ids, -(-end // self.block_ids)
        self.file.seek(self.base + int(self.blocks[a]))
        data = self.file.read(int(self.blocks[b] - self.blocks[a]))
        at, parts = 0, []
        for k in range(a, b):
            size = int(self.blocks[k + 1] - self.blocks[k])
            parts.append(unpack(data[at : at + size], min(self.block_ids, self.n_ids - k * self.block_ids), self.bits))
            at += size
        return np.concatenate(parts)[first - a * self.block_ids : end - a * self.block_ids]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))

    def documents(self) -> Iterator[tuple[object, int, np.ndarray]]:
        """(doc_id, start in the shard, ids) of every document, a run of blocks at a time."""
        k = 0
        while k < len(self.doc_ids):
            last = max(k + 1, int(np.searchsorted(self.starts, self.starts[k] + 16 * self.block_ids, "right")) - 1)
            first = int(self.starts[k])
            run = self.ids(first, int(self.starts[last]))
            for i in range(k, last):
                yield self.doc_ids[i], int(self.starts[i]), run[self.starts[i] - first : self.starts[i + 1] - first]
            k = last

    def close(self) -> None:
        self.file.close()


class Encoder:
    """The tokenizers library with each distinct word encoded once a call; whole texts where words do not add up."""

    def __init__(self, path: str):
        # the cluster's tasks fill the cores: threads of the library's own only get in each other's way
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        from .pretokens import UnitCache, byte_units
        from .token_counts import splits_at_spaces

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        self.plain = splits_at_spaces(self.model)
        self.special = [t.content for t in self.model.get_added_tokens_decoder().values()]
        find = self.model.pre_tokenizer.pre_tokenize_str if self.plain else None
        self.units = lambda text: byte_units(text, lambda t: [t[a:b] for _, (a, b) in find(t)])
        self.cache = UnitCache(self._encode_units, 800_000)
        vocab = self.model.get_vocab()
        self.n_bytes = np.zeros(max(vocab.values(), default=0) + 1, np.int64)
        for token, i in vocab.items():
            self.n_bytes[i] = len(token)  # in a byte-level vocabulary each letter of a token is a byte

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_units(self, units: list[str]) -> list[bytes]:
        """Each unit's ids as bytes. Units that start with a space and hold more than white space are encoded as
        one text, JOINED at a time, since a pre-token starts at each of their spaces; ids are told apart by bytes."""
        own = [u for u in units if not (u[0] == " " and not u.isspace())]
        made = dict(zip(own, [np.array(ids, "<u4").tobytes() for ids in self._ids(own)]))
        rest = [u for u in units if u not in made] if own else units
        for at in range(0, len(rest), JOINED):
            some = rest[at : at + JOINED]
            ids = np.array(self._ids(["".join(some)])[0], "<u4")
            stops = np.concatenate([[0], np.cumsum(self.n_bytes[ids])])
            ends = np.concatenate([[0], np.cumsum([len(u.encode()) for u in some])])
            cuts = np.searchsorted(stops, ends)
            if np.array_equal(stops[np.minimum(cuts, len(ids))], ends):
                data, cuts = ids.tobytes(), (4 * cuts).tolist()
                made.update(zip(some, [data[i:j] for i, j in zip(cuts, cuts[1:])]))
            else:
                made.update(zip(some, [np.array(x, "<u4").tobytes() for x in self._ids(some)]))
        return [made[u] for u in units]

    def encode(self, texts: list[str], end: bytes) -> list[np.ndarray]:
        """Each text's ids and the end's."""
        out, plain, units = [None] * len(texts), [], []
        for k, t in enumerate(texts):
            if not t or not self.plain or any(s in t for s in self.special):
                out[k] = np.frombuffer(np.array(self.model.encode(t, add_special_tokens=False).ids, "<u4").tobytes() + end, "<u4")
            elif splits_at_each_space(t):
                plain.append(k)
            else:
                units.append((k, self.units(t)))
        for (k, _), found in zip(units, self.cache.find([u for _, u in units])):
            out[k] = np.frombuffer(b"".join(found) + end, "<u4")
        if plain:
            for k, ids in zip(plain, self._encode_plain([texts[k] for k in plain])):
                out[k] = np.concatenate([ids, np.frombuffer(end, "<u4")])
        return out

    def _encode_plain(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of texts that split at each space: their words are numbered outside Python, and each is encoded once."""
        parts = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        coded, stops = pc.dictionary_encode(parts.values), np.asarray(parts.offsets, np.int64)
        words, codes = coded.dictionary.to_pylist(), np.asarray(coded.indices, np.int64).copy()
        ids, size = self._encode_words(words, np.asarray(pc.binary_length(coded.dictionary), np.int64))
        # what a text begins with has no space before it
        first = [t.split(" ", 1)[0] for t in texts]
        heads = {h: len(words) + i for i, h in enumerate(dict.fromkeys(first))}
        data = [f if h else b"" for h, f in zip(heads, self.cache.find([[h or " " for h in heads]])[0])]
        codes[stops[:-1]] = [heads[h] for h in first]
        size = np.concatenate([size, np.fromiter(map(len, data), np.int64, len(data)) >> 2])
        ids = np.concatenate([ids, np.frombuffer(b"".join(data), "<u4")])
        n = size[codes]
        ends = np.cumsum(n)
        at = np.repeat((np.cumsum(size) - size)[codes] - ends + n, n)
        at += np.arange(len(at))
        return np.split(ids[at], ends[stops[1:-1] - 1])

    def _encode_words(self, words: list[str], n_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of words that each have a space before them, and each word's number of ids; JOINED words are one text."""
        found, sizes = [np.empty(0, "<u4")], [np.empty(0, np.int64)]
        for at in range(0, len(words), JOINED):
            some = words[at : at + JOINED]
            ids = np.array(self._ids([" " + " ".join(some)])[0], "<u4")
            stops, ends = np.cumsum(self.n_bytes[ids]), np.cumsum(n_bytes[at : at + JOINED] + 1)
            cuts = np.searchsorted(stops, ends)
            if len(ids) and np.array_equal(stops[np.minimum(cuts, len(ids) - 1)], ends):
                found.append(ids), sizes.append(np.diff(cuts, prepend=-1))
            else:  # ids that reach over words
                each = self._ids([" " + w if w else "" for w in some])
                found += [np.array(x, "<u4") for x in each]
                sizes.append(np.array([len(x) for x in each], np.int64))
        return np.concatenate(found), np.concatenate(sizes)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def together(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) of batches put together up to HELD bytes and a batch: many words are the same, and each is encoded once."""
    ids, texts, held = [], [], 0
    for b in batches:
        ids += b.column(0).to_pylist()
        texts += [t or "" for t in b.column(1).to_pylist()]
        held += b.nbytes
        if held >= HELD:
            yield ids, texts
            ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


def write(docs: DataFrame, path: str, vocab_size: int, end_id: int, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes docs' ids, in ascending order of id, to shards; returns the manifest, one row a shard.

    Manifest: (part, seq, path, n_docs, n_ids, first_id), with first_id the number of ids in all shards before.
    """
    spark = docs.sparkSession
    limit_batches(spark)
    folder = folder or shared_dir(spark, "token-bins")
    bits, end = width(vocab_size), struct.pack("<I", end_id)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # a document id may stand for many rows: their hashes and places spread them over several tasks
    rows = rows.withColumns({"_hash": F.xxhash64("text"), "_at": F.monotonically_increasing_id()})
    rows = rows.repartitionByRange(parts, "doc_id", "_hash", "_at").sortWithinPartitions("doc_id", "_hash", "_at").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, coder, made = TaskContext.get(), encoder(path), []
        ids, docs_ids, held, attempt = [], [], 0, uuid.uuid4().hex[:8]

        def close() -> None:
            name = f"{folder}/part-{task.partitionId():06d}-{len(made):05d}-{attempt}.bits"
            made.append((task.partitionId(), len(made), name, len(ids), write_shard(name, ids, docs_ids, bits)))

        for some, texts in together(batches):
            for d, x in zip(some, coder.encode(texts, end)):
                ids.append(d)
                docs_ids.append(x)
                held += len(x)
                if held >= SHARD_IDS:
                    close()
                    ids, docs_ids, held = [], [], 0
        if ids:
            close()
        columns = list(zip(*made)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()))], ["part", "seq", "path", "n_docs", "n_ids"])

    manifest = cut(rows.mapInArrow(run, "part int, seq int, path string, n_docs long, n_ids long"), "token-bins-manifest")
    totals = {r.part: r.n for r in manifest.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}  # one number a partition
    before = dict(zip(sorted(totals), accumulate([0, *(totals[p] for p in sorted(totals))])))
    at = spark.createDataFrame(list(before.items()), "part int, before long")
    order = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.join(at, "part").select("part", "seq", "path", "n_docs", "n_ids", (F.col("before") + F.coalesce(F.sum("n_ids").over(order), F.lit(0))).alias("first_id"))


def read(manifest: DataFrame, with_ids: bool = True) -> DataFrame:
    """Every document of a manifest's shards: (doc_id, start, n_tokens, ids_crc32) and ids array<int> unless told not to."""
    limit_batches(manifest.sparkSession)
    names = ["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids]
    kinds = [pa.int64()] * 4 + [pa.list_(pa.int32())] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * len(names), kinds)], names)

        for b in batches:
            for path, first in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                shard, rows, held = Shard(path), [], 0
                for d, start, ids in shard.documents():
                    rows.append((d, first + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), *[ids.astype(np.int32)] * with_ids))
                    held += len(ids) * with_ids + 16
                    if held > 1 << 20:
                        yield batch(rows)
                        rows, held = [], 0
                shard.close()
                yield batch(rows)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    tasks = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("path", "first_id").repartition(tasks, "path").mapInArrow(run, schema)
