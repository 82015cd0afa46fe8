"""BPE encoding and decoding through a pair occurrence index.

For the distinct pre-tokens of a batch of a partition, an index maps every adjacent pair that has a rank to all
its positions. The ranks that are active are taken in ascending order; a rank's merge is applied at all its
positions, left to right, and the lists of the pairs that it makes are updated. Pairs that it breaks stay in
their lists and are passed over when their turn comes. A merge makes only pairs with its new symbol, whose
ranks are higher, so the order equals that of merging each pre-token alone.

Defined results: null text is empty text, which has no ids and decodes to ""; special strings inside a text
become their own ids, as the library does by default; a repeated row is encoded again; an empty table gives an
empty result; other columns of the input are not read.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
import struct
from collections.abc import Callable, Iterator
from itertools import chain
from sys import getsizeof

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows
from .pretokens import BYTE_PATTERN, byte_units

#: Characters that are cut into units at a time; bytes of pre-tokens that are merged at a time; ids that are digested at a time.
PIECE, MERGED, DIGESTED = 1 << 20, 1 << 18, 1 << 16
#: Bytes of known units.
HELD = 24 << 20


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class PairIndex:
    """The ranked pairs of many symbol sequences, with all their positions. A pair (a, b) is written a << 20 | b."""

    def __init__(self, ranks: dict[int, tuple[int, int]]):
        """ranks: pair -> (rank, symbol that it becomes)."""
        self.ranks = ranks
        self.keys = np.sort(np.fromiter(ranks, np.int64, len(ranks)))

    def positions(self, symbols: np.ndarray, joined: np.ndarray) -> dict[int, list[int]]:
        """Every ranked pair with its positions. joined: whether a symbol and the next are of one sequence."""
        pairs = symbols[:-1] << 20 | symbols[1:]
        at = np.flatnonzero(joined)
        found = np.searchsorted(self.keys, pairs[at])
        at = at[self.keys[np.minimum(found, len(self.keys) - 1)] == pairs[at]]
        at = at[np.argsort(pairs[at], kind="stable")]
        if not len(at):
            return {}
        cuts = np.flatnonzero(np.diff(pairs[at])) + 1
        starts = np.concatenate([[0], cuts])
        every, ends = at.tolist(), [*cuts.tolist(), len(at)]
        return {p: every[i:j] for p, i, j in zip(pairs[at[starts]].tolist(), starts.tolist(), ends)}

    def merge(self, words: list[list[int]]) -> list[list[int]]:
        """words with all merges applied."""
        ranks, n = self.ranks, sum(map(len, words))
        if not n:
            return [[] for _ in words]
        symbols = list(chain.from_iterable(words))
        ends = np.cumsum([len(w) for w in words])
        joined = np.ones(n, bool)
        joined[ends[(ends > 0)] - 1] = False
        where = self.positions(np.array(symbols, np.int64), joined[:-1])
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[~joined] = -1
        before[1:][~joined[:-1]] = -1
        after, before = after.tolist(), before.tolist()
        active = [(*ranks[p], p) for p in where]
        heapq.heapify(active)
        pop, push, known = heapq.heappop, heapq.heappush, ranks.get
        while active:
            _, new, pair = pop(active)
            left, right = pair >> 20, pair & 0xFFFFF
            high, places = new << 20, where.pop(pair)
            places.sort()
            for i in places:
                if symbols[i] != left:
                    continue
                j = after[i]
                if j < 0 or symbols[j] != right:
                    continue
                symbols[i], symbols[j] = new, -1
                k = after[i] = after[j]
                if k >= 0:
                    before[k] = i
                    made = high | symbols[k]
                    if made in where:
                        where[made].append(i)
                    elif rank := known(made):
                        where[made] = [i]
                        push(active, (*rank, made))
                h = before[i]
                if h >= 0:
                    made = symbols[h] << 20 | new
                    if made in where:
                        where[made].append(h)
                    elif rank := known(made):
                        where[made] = [h]
                        push(active, (*rank, made))
        ends = ends.tolist()
        return [[s for s in symbols[start:end] if s >= 0] for start, end in zip([0, *ends], ends)]


class KnownUnits:
    """The ids of units that came before, in arrays: hashes in ascending order, where each unit's ids begin and end, and ids.

    A unit takes 16 bytes and 4 for each id; its string is not kept. What a hash finds is held against the unit by its
    spelling. Beyond HELD bytes the largest part, the oldest, goes: an entry only saves work.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]], spell: Callable[[list[int]], bytes], held: int = HELD):
        self.encode, self.spell, self.held = encode, spell, held
        self.parts: list[tuple[np.ndarray, ...]] = []

    def learn(self, units: set[str]) -> dict[str, bytes]:
        """The ids of all units, as little-endian 32-bit integers."""
        names, made, spell = list(units), {}, self.spell
        h = np.fromiter(map(hash, names), np.int64, len(names))
        order = np.argsort(h)
        h = h[order]
        for hashes, begin, end, ids in self.parts:
            at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            hit = np.flatnonzero(hashes[at] == h)
            at, view = at[hit], memoryview(ids)
            for i, x, y in zip(order[hit].tolist(), begin[at].tolist(), end[at].tolist()):
                some = view[x:y]
                if spell(some.tolist()) == names[i].encode():
                    made[names[i]] = some.tobytes()
        if rest := sorted(units.difference(made)):  # words that begin alike are merged faster side by side
            packed = self.encode(rest)
            made.update(zip(rest, packed))
            end = np.cumsum([len(p) >> 2 for p in packed])
            begin = np.concatenate([[0], end[:-1]])
            self._keep(np.fromiter(map(hash, rest), np.int64, len(rest)), begin, end, np.frombuffer(b"".join(packed), np.uint32))
        return made

    def _keep(self, hashes: np.ndarray, begin: np.ndarray, end: np.ndarray, ids: np.ndarray) -> None:
        """Adds a part; it takes up the parts before it that are not much larger, so that parts are few."""
        while self.parts and len(self.parts[-1][0]) <= 2 * len(hashes):
            other = self.parts.pop()
            begin, end = (np.concatenate([x, y + len(other[3])]) for x, y in ((other[1], begin), (other[2], end)))
            hashes, ids = np.concatenate([other[0], hashes]), np.concatenate([other[3], ids])
        order = np.argsort(hashes)
        self.parts.append((hashes[order], begin[order].astype(np.uint32), end[order].astype(np.uint32), ids))
        while sum(x.nbytes for part in self.parts for x in part) > self.held:
            self.parts.pop(0)


class Codec:
    """A byte-level BPE vocabulary from a tokenizers file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        pre = parts["pre_tokenizer"] or {}
        if parts["normalizer"] is not None or pre.get("type") != "ByteLevel" or pre.get("use_regex") is not True or pre["add_prefix_space"] or parts["model"].get("ignore_merges"):
            raise ValueError("only byte-level BPE with the usual pattern and no normaliser is handled")
        vocab, letters = parts["model"]["vocab"], byte_letters()
        merges = [m if isinstance(m, list) else m.split(" ") for m in parts["model"]["merges"]]
        self.index = PairIndex({vocab[a] << 20 | vocab[b]: (rank, vocab[a + b]) for rank, (a, b) in enumerate(merges)})
        self.start = [vocab[letters[b]] for b in range(256)]
        back = {v: k for k, v in letters.items()}
        self.bytes = {i: bytes(back[ch] for ch in t) for t, i in vocab.items()} | {t["id"]: t["content"].encode() for t in parts["added_tokens"]}
        self.decimal = [str(i) for i in range(max(self.bytes) + 1)]
        self.special = {t["content"]: t["id"] for t in parts["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in parts["added_tokens"]):
            raise ValueError("special strings that take in what is beside them are not handled")
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.find = regex.compile(BYTE_PATTERN).findall
        # a pre-token starts at a space between letters or digits, whatever stands before and after
        self.between = regex.compile(r"(?<=[\p{L}\p{N}]) (?=[\p{L}\p{N}])").search
        self.known = KnownUnits(self._encode_units, lambda ids: b"".join(map(self.bytes.__getitem__, ids)))

    def _encode_units(self, units: list[str]) -> list[bytes]:
        """Each unit's ids, as little-endian 32-bit integers. Pre-tokens are merged MERGED bytes at a time."""
        split = [self.find(u) for u in units]
        start, made, waiting, size = self.start, {}, {}, 0

        def merge() -> None:
            made.update((w, struct.pack(f"<{len(ids)}I", *ids)) for w, ids in zip(waiting, self.index.merge(list(waiting.values()))))
            waiting.clear()

        for w in dict.fromkeys(chain.from_iterable(split)):
            waiting[w] = [start[b] for b in w.encode()]
            size += len(waiting[w])
            if size >= MERGED:
                merge()
                size = 0
        merge()
        return [made[s[0]] if len(s) == 1 else b"".join([made[w] for w in s]) for s in split]

    def _pieces(self, text: str) -> Iterator[str]:
        """The text in pieces of about PIECE characters that are encoded each alone; special strings are pieces."""
        for part in self.cut.split(text) if self.cut and any(s in text for s in self.special) else [text]:
            at = 0
            while part not in self.special and len(part) - at > PIECE and (space := self.between(part, at + PIECE)):
                yield part[at : space.start()]
                at = space.start()
            yield part[at:] if at else part

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Each text's ids, in arrays of 32-bit unsigned integers."""
        made: list[list[bytes]] = [[] for _ in texts]
        waiting: list[tuple[int, list[str] | bytes]] = []
        size = 0

        def learn() -> None:
            get = self.known.learn(set().union(*[u for _, u in waiting if isinstance(u, list)])).__getitem__
            for i, units in waiting:
                made[i].append(b"".join(map(get, units)) if isinstance(units, list) else units)
            waiting.clear()

        for i, text in enumerate(texts):
            for piece in self._pieces(text):
                waiting.append((i, struct.pack("<I", self.special[piece]) if piece in self.special else byte_units(piece, self.find) if piece else []))
                size += len(piece)
                if size >= PIECE:
                    learn()
                    size = 0
        learn()
        return [np.frombuffer(m[0] if len(m) == 1 else b"".join(m), "<u4") for m in made]

    def digests(self, ids: np.ndarray) -> tuple[str, str]:
        """SHA-256 of the decimal ids, joined by commas, and of their decoded text; DIGESTED ids at a time."""
        joined, decoded, utf8 = hashlib.sha256(), hashlib.sha256(), codecs.getincrementaldecoder("utf-8")("replace")
        for at in range(0, len(ids), DIGESTED):
            some = ids[at : at + DIGESTED].tolist()
            joined.update((("," if at else "") + ",".join(map(self.decimal.__getitem__, some))).encode())
            decoded.update(utf8.decode(b"".join(map(self.bytes.__getitem__, some))).encode())
        decoded.update(utf8.decode(b"", True).encode())
        return joined.hexdigest(), decoded.hexdigest()

    def decode(self, ids: np.ndarray | list[int]) -> str:
        """The text of ids; bytes that are not UTF-8 become U+FFFD, as the library does."""
        return b"".join(map(self.bytes.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids)).decode("utf-8", "replace")


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(c.encode([t or "" for t in b.column(1).to_pylist()]), pa.list_(pa.int32()))], ["doc_id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run, f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) for every row of ids; null ids decode to ""."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.decode(i or []) for i in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return map_rows(encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")), run, f"doc_id {kind}, text string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode, then decode, in one pass that moves no ids between processes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            all_ids = c.encode([t or "" for t in b.column(1).to_pylist()])
            joined, decoded = zip(*map(c.digests, all_ids)) if all_ids else ((), ())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(map(len, all_ids), pa.int64()), pa.array(joined, pa.string()), pa.array(decoded, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
