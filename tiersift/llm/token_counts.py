"""Token counts by a map-side two-tier lookup.

Tier one is a broadcast table of the units (words with their spaces) that are frequent in a bounded sample,
each with its number of tokens; tier two is a cache in each Python worker for the units that miss it, which
encodes a unit once. Neither tier changes a count, and no unit is shuffled over the corpus.

Defined results: null text counts as empty, which has no bytes and no tokens; a repeated row is counted like
any other; an empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import limit_batches, map_rows
from .pretokens import LAST_SPACE, UnitCache, byte_units, piece_units

#: Documents sampled for tier one, and the units that it keeps: its broadcast size is bounded by both.
SAMPLE_ROWS, FREQUENT_UNITS, LONGEST_UNIT = 2000, 20_000, 64

_workers: dict[str, tuple] = {}


def piece_counter(path: str):
    """(units of a text, counts of a list of units) for a SentencePiece model."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    apart = not any("▁" in p.lstrip("▁") for p in pieces)

    def units(text: str) -> list[str]:
        return piece_units(text) if apart and "▁" not in text else [text]

    def counts(new: list[str]) -> list[int]:
        return [1 if u == LAST_SPACE else len(ids) for u, ids in zip(new, model.encode(new, num_threads=1))]

    return units, counts


def byte_counter(path: str):
    """The same for a tokenizers file."""
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    plain, special = splits_at_spaces(model), [t.content for t in model.get_added_tokens_decoder().values()]

    def find(text: str) -> list[str]:
        return [text[a:b] for _, (a, b) in model.pre_tokenizer.pre_tokenize_str(text)]

    def units(text: str) -> list[str]:
        return byte_units(text, find) if plain and not any(s in text for s in special) else [text]

    def counts(new: list[str]) -> list[int]:
        return [len(e.ids) for e in model.encode_batch_fast(new, add_special_tokens=False)]

    return units, counts


def splits_at_spaces(model) -> bool:
    """Whether a tokenizers model is byte-level BPE with the usual pattern, so that byte_units() holds for it."""
    import json

    parts = json.loads(model.to_str())
    pre = parts["pre_tokenizer"] or {}
    return parts["normalizer"] is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") is True and not pre["add_prefix_space"] and not parts["model"].get("ignore_merges")


def counter(path: str) -> tuple:
    """The worker's (units, cache) for a vocabulary file; kept as long as the worker lives."""
    if path not in _workers:
        units, counts = (piece_counter if path.endswith(".model") else byte_counter)(path)
        _workers[path] = units, UnitCache(counts)
    return _workers[path]


def frequent_units(docs: DataFrame, path: str, text_col: str = "text") -> dict[str, int]:
    """Tier one: the most frequent units of at most SAMPLE_ROWS documents, chosen by hash, with their counts."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, _ = counter(path)
        seen: Counter = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                seen.update(u for u in units(t or "") if len(u) <= LONGEST_UNIT)
        top = seen.most_common(FREQUENT_UNITS)
        yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["unit", "n"])

    n = docs.count()
    part = docs.select(F.col(text_col).alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, SAMPLE_ROWS / max(n, 1))))
    limit_batches(docs.sparkSession)
    found = part.limit(2 * SAMPLE_ROWS).mapInArrow(tally, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))
    top = [r.unit for r in found.orderBy(F.desc("n"), "unit").limit(FREQUENT_UNITS).collect()]
    _, cache = counter(path)
    return dict(zip(top, cache.encode(top))) if top else {}


def token_counts(docs: DataFrame, path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of docs."""
    tier_one = docs.sparkSession.sparkContext.broadcast(frequent_units(docs, path, text_col))
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = tier_one.value
        units, second = counter(path)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            split = [units(t) for t in texts]
            second.learn([[u for u in us if u not in first] for us in split])
            look = {**first, **second}.__getitem__ if len(second) < len(first) else lambda u: first[u] if u in first else second[u]
            n = [sum(map(look, us)) for us in split]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return map_rows(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run, f"doc_id {kind.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
