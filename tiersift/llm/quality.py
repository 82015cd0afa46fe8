"""Quality rules: base rules on words, then bands of n-gram perplexity for each language.

The model is a modified Kneser-Ney model over the bytes of texts, of order ORDER. The documents of a language are
dealt to two halves by a hash of their texts, each half gives a model, and a document is scored by the model of the
half that it is not in: no text vouches for itself, however often it is repeated. Tasks count the n-grams of their
documents, Spark adds the counts up over the whole corpus, and joins of the n-gram tables give discounts,
probabilities and back-off weights. They are stored as sorted hash arrays (``hash_arrays``).

An n-gram's key is a 64-bit hash of its language's name, half, order and bytes; two of a billion entries collide with
a chance of a few in a hundred, and would then share a value.

Bands: the documents of a language give the median log perplexity a byte and the median absolute deviation from it
(from exact counts in steps of STEP); documents beyond ``upper`` deviations above or ``lower`` below are rejected. Short
texts spread wider than long ones, so the deviation is taken for each length, a power of two of bytes. It counts as if
SHARED more documents had the language's own deviation and is at most MOST of those, so that the few texts of a rare
length do not set their own bar; and the fewer documents a language has, the wider its bands, by 1 + FEW / their number.
Where the language's deviation is at most a step, as of one or of equal texts, there is none to measure by and the band
is ``floor`` wide. Bands are wider below, as near copies in the other half make a clean text score low.

Defined results: null text has no words and fails the base rules; a null language is a language of its own;
text without bytes has log perplexity 0 and stands in no band's counts; a byte that the other half of a language
never showed, as where that half is empty, costs log 256; repeated rows count as often as they occur and are judged
alike; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import hash_arrays
from .common import cut, discard, limit_batches, map_rows, shared_dir
from .joins import join_counted

ORDER, STEP = 5, 0.001
#: Bands in deviations above and below a language's median log perplexity, and their width where there is no deviation.
UPPER_DEVIATIONS, LOWER_DEVIATIONS, FLOOR, FEW = 6.0, 12.0, 0.35, 20
#: Documents of the language's own deviation that each length has besides its own; the most of those that its deviation may be.
SHARED, MOST = 100, 3.0
#: Powers of two of bytes within which lengths have bands of their own; shorter and longer texts share the ends'.
SHORT, LONG = 7, 12
MIN_WORDS, MAX_REPEATED = 50, 50
#: Bytes of text that are counted or scored at a time; distinct n-grams that a task holds before it hands them on.
PIECE, HELD = 1 << 19, 1 << 20
#: Bands up to which their table goes to every task; a larger one is joined by its key.
BROADCAST_BANDS = 100_000
SYMBOLS = "#*$%&|<>"
_words = re.compile(r"[^\x20\x09-\x0D]+").findall
#: 2^64 over the golden ratio: multiplying by it is one-to-one and spreads keys.
MIX = np.uint64(0x9E3779B97F4A7C15)


def features(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    words = _words(text)
    lines = [x for x in text.split("\n") if _words(x)] if "\n" in text else []
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        counts = Counter(windows)
        end = 0
        for i, w in enumerate(windows):
            if counts[w] > 1:
                repeated += i + 3 - max(i, end)
                end = i + 3
    return len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated


def ngrams(text: bytes, order: int = ORDER) -> np.ndarray:
    """The n-gram that ends at each byte, as one number; before the text stand zero bytes."""
    b = np.frombuffer(b"\0" * (order - 1) + text, np.uint8)
    code = np.zeros(len(text), np.uint64)
    for i in range(order):
        code = code << np.uint64(8) | b[i : i + len(text)]
    return code


def model_of(lang: Column, text: Column, other: bool) -> Column:
    """The hash of a language and of the half that a text is in, or of the other half."""
    half = F.pmod(F.xxhash64(text, F.lit(1)), F.lit(2))
    return F.xxhash64(F.coalesce(lang.cast("string"), F.lit("\0")), 1 - half if other else half)


def band_of(lang: Column, text: Column) -> Column:
    """The name of a text's band: its language and its length."""
    length = F.floor(F.log2(F.greatest(F.coalesce(F.octet_length(text), F.lit(1)), F.lit(1)) + 0.5))
    return F.concat(F.coalesce(lang.cast("string"), F.lit("\0")), F.lit("\0"), F.least(F.greatest(length, F.lit(SHORT)), F.lit(LONG)).cast("string"))


def keys(model: np.ndarray, order: int, code: np.ndarray, context: bool = False) -> np.ndarray:
    """The hash of an n-gram, or of a context of that order."""
    packed = np.uint64(context) << np.uint64(43) | np.uint64(order) << np.uint64(40) | code
    return (packed ^ model * MIX) * MIX


def pieces(text: bytes, order: int) -> Iterator[np.ndarray]:
    """The n-grams of a text, PIECE bytes at a time."""
    for at in range(0, len(text), PIECE):
        before = text[max(0, at - order + 1) : at].rjust(order - 1, b"\0") if at else b"\0" * (order - 1)
        yield ngrams(before + text[at : at + PIECE], order)[order - 1 :]


def added(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Keys, ascending and distinct, with their counts added up."""
    k, n = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(k, kind="stable")
    k, n = k[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.empty(0, np.int64)
    return k[first], np.add.reduceat(n, first) if len(k) else n


def count_ngrams(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(l, code, c): how often each n-gram of the order occurs in all texts of a model. docs: (l, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models: dict[int, int] = {}  # models get numbers of 24 bits in a task
        held, size = [], 0

        def flush(least: int) -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            k, n = added(held) if held else (np.empty(0, np.uint64), np.empty(0, np.int64))
            held, size = [(k, n)], len(k)
            if size >= least:
                names = np.array(list(models) or [0], np.int64)
                for at in range(0, size, 1 << 16):
                    some = slice(at, at + (1 << 16))
                    l, code = names[(k[some] >> np.uint64(40)).astype(np.int64)], (k[some] & np.uint64((1 << 40) - 1)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(l), pa.array(code), pa.array(n[some])], ["l", "code", "c"])
                held, size = [], 0
                models.clear()

        def take(waiting: list[np.ndarray]) -> None:
            nonlocal size
            k, n = np.unique(np.concatenate(waiting), return_counts=True)
            held.append((k, n.astype(np.int64)))
            size += len(k)

        for b in batches:
            waiting, bytes_ = [], 0
            for l, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not t:
                    continue
                number = np.uint64(models.setdefault(l, len(models))) << np.uint64(40)
                for codes in pieces(t.encode("utf-8", "replace"), order):
                    waiting.append(number | codes)
                    bytes_ += len(codes)
                    if bytes_ >= PIECE:
                        take(waiting)
                        waiting, bytes_ = [], 0
            if waiting:
                take(waiting)
            if size >= 2 * HELD or len(models) >= 1 << 20:
                yield from flush(HELD if len(models) < 1 << 20 else 0)
        yield from flush(0)

    return map_rows(docs, run, "l long, code long, c long").groupBy("l", "code").agg(F.sum("c").alias("c"))


def discounts(table: DataFrame) -> DataFrame:
    """(l, d1, d2, d3): the modified Kneser-Ney discounts of each language's n-grams of one order."""
    of = [F.sum((F.col("c") == k).cast("double")).alias(f"n{k}") for k in (1, 2, 3, 4)]
    y = F.try_divide("n1", F.col("n1") + 2 * F.col("n2"))
    # where counts of counts are missing or give no discount between 0 and the count: half of it
    rule = {k: k - (k + 1) * y * F.try_divide(f"n{k + 1}", f"n{k}") for k in (1, 2, 3)}
    safe = [F.when((r > 0) & (r < k), r).otherwise(0.5 * k).alias(f"d{k}") for k, r in rule.items()]
    return table.groupBy("l").agg(*of).select("l", *safe)


def train(docs: DataFrame, order: int = ORDER, folder: str | None = None) -> DataFrame:
    """Trains on docs (l, text), a model for each l, and stores them; returns the manifest (path, low, n), one row a shard."""
    spark = docs.sparkSession
    limit_batches(spark)
    folder = folder or shared_dir(spark, "ngram-model")
    tables = {order: cut(count_ngrams(docs, order), "ngrams")}
    for n in range(order - 1, 0, -1):  # lower orders count the different bytes before an n-gram
        low = F.col("code").bitwiseAND((1 << 8 * n) - 1)
        tables[n] = tables[n + 1].groupBy("l", low.alias("code")).agg(F.count("*").alias("c"))
    entries, below, made = [], None, [tables[order]]
    for n in range(1, order + 1):
        table = tables[n] if n == order else cut(tables[n], f"ngrams-{n}")
        cuts = discounts(table)
        mine = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        # languages are few and their rows many: the discounts go to the tasks, not the rows to the discounts
        known = table.join(F.broadcast(cuts), "l") if cuts.count() <= 10_000 else table.join(cuts, "l")
        known = known.withColumns({"ctx": F.shiftright("code", 8), "d": mine})
        contexts = known.groupBy("l", "ctx").agg(F.sum("c").alias("total"), F.sum("d").alias("freed"))
        contexts = cut(contexts.select("l", "ctx", "total", (F.col("freed") / F.col("total")).alias("gamma")), f"contexts-{n}")
        p = known.join(contexts, ["l", "ctx"]).withColumn("low", F.col("code").bitwiseAND((1 << 8 * (n - 1)) - 1))
        if below is None:
            p = p.withColumn("under", F.lit(1 / 256))
        else:
            p = p.join(below.select("l", F.col("code").alias("low"), F.col("p").alias("under")), ["l", "low"])
        p = p.select("l", "code", ((F.col("c") - F.col("d")) / F.col("total") + F.col("gamma") * F.col("under")).alias("p"))
        below = cut(p, f"probabilities-{n}")
        made += [contexts, below, *[table] * (n < order)]
        entries.append(below.select("l", F.lit(n).alias("n"), F.lit(False).alias("is_context"), "code", F.log("p").alias("value")))
        entries.append(contexts.select("l", F.lit(n).alias("n"), F.lit(True).alias("is_context"), F.col("ctx").alias("code"), F.log("gamma").alias("value")))
    every = entries[0]
    for e in entries[1:]:
        every = every.union(e)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            l, n, c, code = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for i in range(4))
            k = (c << np.uint64(43) | n << np.uint64(40) | code) ^ l * MIX
            yield pa.RecordBatch.from_arrays([pa.array((k * MIX ^ np.uint64(1 << 63)).view(np.int64)), b.column(4).cast(pa.float32())], ["h", "value"])

    pairs = cut(every.mapInArrow(hashed, "h long, value float"), "ngram-hashes")
    discard(*made)
    shards = max(1, -(-pairs.count() // hash_arrays.SHARD))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        h = np.concatenate([b.column(0).to_numpy().view(np.uint64) ^ np.uint64(1 << 63) for b in got]) if got else np.empty(0, np.uint64)
        if len(h):
            row = hash_arrays.store(folder, h, np.concatenate([b.column(1).to_numpy() for b in got]))
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], ["path", "low", "n"])

    placed = pairs.repartitionByRange(shards, "h").sortWithinPartitions("h")
    manifest = cut(placed.mapInArrow(put, "path string, low string, n long"), "ngram-model-manifest")
    discard(pairs)
    return manifest


class Model:
    def __init__(self, shards: list[tuple[str, str, int]], order: int = ORDER):
        self.order, self.arrays = order, hash_arrays.opened(shards)

    def log_probability(self, model: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Of the last byte of each n-gram: from the longest known suffix, with the back-off weights of those passed over."""
        find = self.arrays.find
        out = find(keys(model, self.order, code)).astype(np.float64)
        left, weight = np.flatnonzero(np.isnan(out)), np.zeros(len(code))
        for n in range(self.order, 0, -1):
            if not len(left):
                break
            c = code[left] & np.uint64((1 << 8 * n) - 1)
            if n < self.order:
                p = find(keys(model[left], n, c))
                got = ~np.isnan(p)
                out[left[got]] = p[got] + weight[left[got]]
                left, c = left[~got], c[~got]
            weight[left] += np.nan_to_num(find(keys(model[left], n, c >> np.uint64(8), True)))
        out[left] = weight[left] - math.log(256)
        return out

    def log_perplexities(self, models: list[int], texts: list[str | None]) -> list[float]:
        """Of each text a byte; 0 for text without bytes. Texts are scored PIECE bytes at a time, each distinct n-gram once."""
        sums, sizes = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        waiting: dict[int, list[tuple[int, np.ndarray]]] = {}
        held: dict[int, int] = {}

        def score(l: int) -> None:
            rows = waiting.pop(l)
            held.pop(l)
            code, at = np.unique(np.concatenate([c for _, c in rows]), return_inverse=True)
            p = self.log_probability(np.full(len(code), l, np.int64).view(np.uint64), code)[at]
            n = np.array([len(c) for _, c in rows])
            np.subtract.at(sums, [i for i, _ in rows], np.add.reduceat(p, np.cumsum(n) - n))

        for i, (l, t) in enumerate(zip(models, texts)):
            data = (t or "").encode("utf-8", "replace")
            sizes[i] = len(data)
            for codes in pieces(data, self.order):
                waiting.setdefault(l, []).append((i, codes))
                held[l] = held.get(l, 0) + len(codes)
                if held[l] >= PIECE:
                    score(l)
                elif sum(held.values()) >= 4 * PIECE:
                    score(max(held, key=held.get))
        for l in list(waiting):
            score(l)
        return (sums / np.maximum(sizes, 1)).tolist()


FEATURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def failed(n_words: Column | int, n_repeat_words: Column | int):
    """The base rules."""
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEATED * n_words)


def score(docs: DataFrame, manifest: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, lang, name of the band, the five features, log_ppl) for every row."""
    shards, text, lang = hash_arrays.shards_of(manifest), F.col(text_col), F.col(lang_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), lang.alias("lang"), band_of(lang, text).alias("name"), model_of(lang, text, True).alias("l"), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(shards)
        for b in batches:
            texts = b.column(4).to_pylist()
            made = list(zip(*map(features, texts))) or [()] * 5
            ppl = model.log_perplexities(b.column(3).to_pylist(), texts)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *[pa.array(x, pa.int64()) for x in made], pa.array(ppl, pa.float64())], ["doc_id", "lang", "name", *[f.split()[0] for f in FEATURES.split(", ")], "log_ppl"])

    return map_rows(rows, run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, lang {docs.schema[lang_col].dataType.simpleString()}, name string, {FEATURES}, log_ppl double")


def bands(scored: DataFrame, upper: float = UPPER_DEVIATIONS, lower: float = LOWER_DEVIATIONS, floor: float = FLOOR) -> DataFrame:
    """(name, low, high, n): each band of log perplexity, and its number of rows. scored: (name, log_ppl)."""
    steps = scored.select("name", F.round(F.col("log_ppl") / STEP).cast("long").alias("step"), (F.col("log_ppl") > 0).alias("has"))
    hist = steps.groupBy("name", "step", "has").agg(F.count("*").alias("k"))
    hist = cut(hist.withColumn("lang", F.regexp_replace("name", "\0[0-9]+$", "")), "perplexity-steps")

    def median(rows: DataFrame, key: str, by: str, name: str) -> DataFrame:
        summed = rows.groupBy(key, by).agg(F.sum("k").alias("k"))
        upto, whole = Window.partitionBy(key).orderBy(by).rangeBetween(Window.unboundedPreceding, 0), Window.partitionBy(key)
        ranked = summed.withColumns({"upto": F.sum("k").over(upto), "of": F.sum("k").over(whole)})
        return ranked.where(2 * F.col("upto") >= F.col("of")).groupBy(key).agg(F.min(by).alias(name), F.first("of").alias(f"{name}_of"))

    middle = median(hist.where("has"), "lang", "step", "mid")
    away = hist.where("has").join(middle, "lang").withColumn("away", F.abs(F.col("step") - F.col("mid")))
    whole, own = median(away, "lang", "away", "mad").drop("mad_of"), median(away, "name", "away", "own")
    got = hist.groupBy("lang", "name").agg(F.sum("k").alias("n")).join(middle, "lang", "left").join(whole, "lang", "left").join(own, "name", "left")
    n = F.coalesce("own_of", F.lit(0))
    mad = F.least((n * F.coalesce("own", F.lit(0)) + SHARED * F.col("mad")) / (n + SHARED), MOST * F.col("mad"))
    width, none = 1.4826 * mad * STEP * (1 + FEW / F.col("mid_of")), F.col("mad") <= 1
    return got.select(
        "name",
        "n",
        (F.col("mid") * STEP - F.when(none, F.lit(floor)).otherwise(lower * width)).alias("low"),
        (F.col("mid") * STEP + F.when(none, F.lit(floor)).otherwise(upper * width)).alias("high"),
    )


def trained(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return train(docs.select(model_of(F.col(lang_col), F.col(text_col), False).alias("l"), F.col(text_col).alias("text")))


def inside(log_ppl: Column, low: Column, high: Column) -> Column:
    return (log_ppl >= F.coalesce(low, F.lit(0.0))) & (log_ppl <= F.coalesce(high, F.lit(math.inf)))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, lang, log_ppl, low, high)."""
    scored = cut(score(docs, trained(docs, text_col, lang_col), id_col, text_col, lang_col), "quality-scores")
    edges = cut(bands(scored), "quality-bands")
    joined = join_counted(scored, edges, "name", scored.count())
    out = failed(F.col("n_words"), F.col("n_repeat_words"))
    kept = ~out & inside(F.col("log_ppl"), F.col("low"), F.col("high"))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", out.alias("base_failed"), kept.alias("kept"), "lang", "log_ppl", "low", "high")


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs that quality() keeps, with all their columns, whatever their names.

    No row is copied or shuffled: a first pass over the texts gives the bands, a second one judges each row where it
    is. The second pass scores again what the base rules let through; that costs less than moving texts.
    """
    manifest = trained(docs, text_col, lang_col)
    shards = hash_arrays.shards_of(manifest)
    columns = [f"c{i}" for i in range(len(docs.columns))]
    text, lang = (F.col(columns[docs.columns.index(c)]) for c in (text_col, lang_col))
    plain = docs.toDF(*columns)

    def ppl(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(shards)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.log_perplexities(b.column(1).to_pylist(), b.column(2).to_pylist()), pa.float64())], ["name", "log_ppl"])

    scored = cut(map_rows(plain.select(band_of(lang, text).alias("name"), model_of(lang, text, True).alias("l"), text.alias("text")), ppl, "name string, log_ppl double"), "quality-scores")
    edges = cut(bands(scored), "quality-bands")
    named = plain.withColumns({"name": band_of(lang, text), "l": model_of(lang, text, True)})
    if edges.count() <= BROADCAST_BANDS:
        named = named.join(F.broadcast(edges.drop("n")), "name", "left")
    else:
        named = join_counted(named, edges, "name", scored.count())
    named = named.select(*columns, text.alias("text"), "l", "low", "high")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, n = Model(shards), len(columns)
        for b in batches:
            texts = b.column(n).to_pylist()
            made = list(map(features, texts))
            passed = [i for i, f in enumerate(made) if not failed(f[0], f[4])]
            low, high, l = (b.column(n + k).to_pylist() for k in (2, 3, 1))
            found = model.log_perplexities([l[i] for i in passed], [texts[i] for i in passed])
            good = np.zeros(len(texts), bool)
            for i, p in zip(passed, found):
                good[i] = (low[i] or 0.0) <= p <= (math.inf if high[i] is None else high[i])
            yield b.select(range(n)).filter(pa.array(good))

    kinds = ", ".join(f"{c} {f.dataType.simpleString()}" for c, f in zip(columns, docs.schema))
    return map_rows(named, judge, kinds).toDF(*docs.columns)
