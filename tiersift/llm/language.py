"""Language identification by a byte convolutional network.

A text's bytes are cut into windows of WINDOW bytes, the last one filled up with zeros. Each byte has a vector;
filters of several widths slide over a window, the largest value of each filter over the window is kept, and a
softmax layer gives the languages' probabilities. A text's probabilities come from the mean of its windows'
log probabilities, weighted by their bytes. All windows of the whole text count.

Training, in numpy on the driver: labelled texts are drawn by hash of their ids, evenly over all languages, and tasks
cut windows of random place and length from them. At most SAMPLE_ROWS texts, or EACH a language where languages are
many, give at most SNIPPETS windows, or EACH a language; only windows come to the driver. No language is left out.
Filters are trained through the vectors; for prediction, each filter's product with each byte's vector at each of its
places is tabulated, so a window is a few table look-ups and additions.

Defined results: null text and text without letters are "und" with score 0, as is every text if nothing
labelled was there to learn from; ties between languages go to the first by name; repeated rows get equal
results; an empty table gives an empty result; other columns are not read. Very long texts are predicted
BLOCK windows at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import keep_rows, map_rows

WINDOW, WIDTHS, FILTERS, VECTOR, BLOCK = 256, (2, 3, 4), 16, 8, 128
#: Bounds of what training sees: texts, and windows cut from them.
SAMPLE_ROWS, SNIPPETS, EACH, EPOCHS, BATCH = 2000, 4000, 8, 5, 32
NONE = "und"
#: The score below which a pipeline takes a document's language for unknown.
LEAST_SCORE = 0.4
_letter = regex.compile(r"\p{L}").search


def windows(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(windows of WINDOW bytes, the bytes of text in each)."""
    n = max(1, -(-len(data) // WINDOW))
    filled = np.zeros(n * WINDOW, np.uint8)
    filled[: len(data)] = np.frombuffer(data, np.uint8)
    sizes = np.full(n, WINDOW)
    sizes[-1] = len(data) - (n - 1) * WINDOW
    return filled.reshape(n, WINDOW), sizes


class Network:
    def __init__(self, labels: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.labels = labels
        self.p = {"e": rng.normal(0, 0.5, (256, VECTOR)).astype(np.float32)}
        for w in WIDTHS:
            self.p[f"w{w}"] = rng.normal(0, (w * VECTOR) ** -0.5, (w * VECTOR, FILTERS)).astype(np.float32)
        self.p["o"] = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(labels))).astype(np.float32)
        self.p["b"] = np.zeros(len(labels), np.float32)
        self.tables = None

    def step(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and gradients for windows x with labels y."""
        p, n = self.p, len(x)
        e = p["e"][x]
        pooled, spots, cols = [], [], []
        for w in WIDTHS:
            col = np.concatenate([e[:, k : WINDOW - w + 1 + k] for k in range(w)], axis=2)
            act = col @ p[f"w{w}"]
            spot = act.argmax(1)
            pooled.append(np.take_along_axis(act, spot[:, None, :], 1)[:, 0])
            spots.append(spot)
            cols.append(col)
        raw = np.concatenate(pooled, 1)
        hidden = np.maximum(raw, 0)
        z = hidden @ p["o"] + p["b"]
        z = np.exp(z - z.max(1, keepdims=True))
        prob = z / z.sum(1, keepdims=True)
        loss = -np.log(prob[np.arange(n), y] + 1e-9).mean()
        d = prob
        d[np.arange(n), y] -= 1
        d /= n
        g = {"o": hidden.T @ d, "b": d.sum(0), "e": np.zeros_like(p["e"])}
        back = (d @ p["o"].T) * (raw > 0)
        rows = np.arange(n)[:, None]
        for i, w in enumerate(WIDTHS):
            part, spot = back[:, i * FILTERS : (i + 1) * FILTERS], spots[i]
            at = cols[i][rows, spot]  # what each filter saw at its largest value
            g[f"w{w}"] = np.einsum("nfc,nf->cf", at, part)
            through = part[:, :, None] * p[f"w{w}"].T[None]
            for k in range(w):
                np.add.at(g["e"], x[rows, spot + k], through[:, :, k * VECTOR : (k + 1) * VECTOR])
        return float(loss), g

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, rate: float = 0.01, seed: int = 11) -> Network:
        rng = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        t, total = 0, epochs * -(-len(x) // BATCH)
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), BATCH):
                some = order[at : at + BATCH]
                _, g = self.step(x[some], y[some])
                t += 1
                now = rate * (1 - t / (total + 1))
                for k, a in g.items():
                    m[k] = 0.9 * m[k] + 0.1 * a
                    v[k] = 0.999 * v[k] + 0.001 * a * a
                    self.p[k] -= (now * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        return self

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        """Of each label for each window."""
        if self.tables is None:
            self.tables = {w: [self.p["e"] @ self.p[f"w{w}"][k * VECTOR : (k + 1) * VECTOR] for k in range(w)] for w in WIDTHS}
        out = []
        for at in range(0, len(x), BLOCK):
            b = x[at : at + BLOCK]
            pooled = []
            for w in WIDTHS:
                act = self.tables[w][0][b[:, : WINDOW - w + 1]]
                for k in range(1, w):
                    act += self.tables[w][k][b[:, k : WINDOW - w + 1 + k]]
                pooled.append(act.max(1))
            z = np.maximum(np.concatenate(pooled, 1), 0) @ self.p["o"] + self.p["b"]
            z = z - z.max(1, keepdims=True)
            out.append(z - np.log(np.exp(z).sum(1, keepdims=True)))
        return np.concatenate(out)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The language and score of each text."""
        named, scores = [NONE] * len(texts), [0.0] * len(texts)
        there = [i for i, t in enumerate(texts) if t and self.labels and _letter(t)]
        cut = [windows(texts[i].encode("utf-8", "surrogatepass")) for i in there]
        if not cut:
            return named, scores
        sizes, counts = np.concatenate([s for _, s in cut]), np.array([len(s) for _, s in cut])
        p = self.log_probabilities(np.concatenate([w for w, _ in cut])) * sizes[:, None]
        starts = np.cumsum(counts) - counts
        mean = np.add.reduceat(p, starts) / np.add.reduceat(sizes, starts)[:, None]
        prob = np.exp(mean)
        prob /= prob.sum(1, keepdims=True)
        for i, k, row in zip(there, prob.argmax(1).tolist(), prob):
            named[i], scores[i] = self.labels[k], float(row[k])
        return named, scores


def training_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray, np.ndarray]:
    """(labels, windows, the windows' labels by number) of texts that may be learned from: labelled, with a letter, and not held out."""
    known = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    learn = F.coalesce(F.pmod(F.crc32(F.col("id").cast("binary")), F.lit(3)) != 1, F.lit(True))
    known = known.where(F.col("lang").isNotNull() & learn & F.col("text").rlike(r"\p{L}"))
    counts = known.groupBy("lang").agg(F.count("*").alias("n")).collect()  # a number for each language
    labels = sorted(r.lang for r in counts)
    if len(labels) < 2:
        return labels, np.empty((0, WINDOW), np.uint8), np.empty(0, np.int64)
    share, each = max(EACH, SAMPLE_ROWS // len(labels)), max(1, SNIPPETS // SAMPLE_ROWS)
    space = 1 << 30  # some more than the share are drawn by chance, then the first of them taken
    chances = docs.sparkSession.createDataFrame([(r.lang, int(space * min(1.0, (1.5 * share + 20) / r.n))) for r in counts], "lang string, chance long")
    drawn = known.join(F.broadcast(chances), "lang").where(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(space)) < F.col("chance"))
    drawn = drawn.select("lang", F.xxhash64("id", F.lit(2)).alias("h"), "text")

    def cut_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for lang, h, text in zip(*[c.to_pylist() for c in b.columns]):
                rng, data = np.random.default_rng([h & 0xFFFFFFFF, h >> 32 & 0xFFFFFFFF]), text.encode("utf-8", "replace")
                for k in range(each):
                    size = int(rng.integers(8, WINDOW + 1)) if rng.random() < 0.6 else WINDOW
                    at = int(rng.integers(0, max(1, len(data) - size + 1)))
                    made.append((lang, h, k, windows(data[at : at + size])[0][0].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*made)) or [[]] * 4, (pa.string(), pa.int64(), pa.int32(), pa.binary()))], ["lang", "h", "k", "window"])

    made = map_rows(drawn, cut_windows, "lang string, h long, k int, window binary")
    order = Window.partitionBy("lang").orderBy("h", "k", "window")
    taken = made.withColumn("place", F.row_number().over(order)).where(F.col("place") <= share * each).orderBy("h", "k", "lang", "window").collect()
    number = {lang: i for i, lang in enumerate(labels)}
    return labels, np.frombuffer(b"".join(r.window for r in taken), np.uint8).reshape(-1, WINDOW), np.array([number[r.lang] for r in taken], np.int64)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Network:
    labels, x, y = training_windows(docs, id_col, text_col, lang_col)
    net = Network(labels)
    return net.fit(x, y) if len(x) else net


def predict(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row. A null id counts as not held out."""
    shared = docs.sparkSession.sparkContext.broadcast(net)  # a fixed number of weights
    held = F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))
    rows = docs.select(F.col(id_col).alias("doc_id"), held.alias("held_out"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            named, scores = shared.value.predict(b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(named, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return map_rows(rows, run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, held_out boolean, lang_pred string, score double")


def languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    return predict(docs, train(docs, id_col, text_col, lang_col), id_col, text_col)


def keep_known(docs: DataFrame, text_col: str = "text", least: float = LEAST_SCORE) -> DataFrame:
    """The rows of docs whose language is found: not "und", and with a score of at least ``least``."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, text_col=text_col))

    def judge():
        net = shared.value

        def verdict(texts: list) -> list[bool]:
            named, scores = net.predict(texts)
            return [n != NONE and s >= least for n, s in zip(named, scores)]

        return verdict

    return keep_rows(docs, judge, [text_col])
