"""Hooks for models that the engine calls but does not bring: each has a form that works without one.

A model is loaded once a worker, by the function that is given; it gets lists and gives lists.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import prompts
from .functions.scalars import asks_for_whole, tokens


@lru_cache(8)
def loaded(load: Callable):
    """A worker's model; eight are kept."""
    return load()


def tried(load: Callable):
    """A model, or None if it can't be loaded."""
    try:
        return load()
    except Exception:  # whatever a library raises: without the model the order of hits stays
        return None


def pooled(states: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Token states (text, token, part) averaged over the tokens that count, brought to length 1."""
    weights = mask[:, :, None].astype(np.float64)
    mean = (states * weights).sum(1) / np.maximum(weights.sum(1), 1e-9)
    return mean / np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-12)


def embedded(rows: DataFrame, load: Callable, text: str = "text") -> DataFrame:
    """rows with embedding array<float>, by a model that gives a vector for each text of a list."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = loaded(load)
        for b in batches:
            yield pd.Series([np.asarray(v, np.float32) for v in model(b.fillna("").tolist())])

    return rows.withColumn("embedding", run(F.col(text)))


def scorer(load: Callable | None, texts: DataFrame, queries: DataFrame) -> Callable[[DataFrame], DataFrame] | None:
    """What retrieval.rerank() calls: hits (qid, id, score) with model_score for the texts (id, content) and queries (qid, query)."""
    if load is None:
        return None

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = loaded(load)
        for q, t in batches:
            yield pd.Series(model(list(zip(q.fillna(""), t.fillna(""))))).astype("float64")

    return lambda hits: hits.join(texts.select("id", "content"), "id", "left").join(queries.select("qid", "query"), "qid", "left").withColumn("model_score", run("query", "content")).drop("content", "query")


def lexical_scorer(texts: DataFrame, queries: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A scorer without a model: the part of a query's different tokens that a text has."""
    asked, said = F.array_distinct(tokens(F.col("query"))), tokens(F.col("content"))
    score = F.coalesce(F.try_divide(F.size(F.array_intersect(asked, said)), F.size(asked)), F.lit(0.0))
    return lambda hits: hits.join(texts.select("id", "content"), "id", "left").join(queries.select("qid", "query"), "qid", "left").withColumn("model_score", score).drop("content", "query")


def expanded(questions: DataFrame, say: Callable[[str], str] | None = None) -> DataFrame:
    """(question, qid, query) of questions (question, text): sub-queries by what a model says of each; the question alone without one.

    The model is called on the driver, for the questions that were asked.
    """
    if say is None:
        told = questions.withColumn("said", F.lit(""))
    else:
        rows = [(r.question, r.text, say(r.text)) for r in questions.select("question", "text").collect()]
        told = questions.sparkSession.createDataFrame(rows, f"question {questions.schema['question'].dataType.simpleString()}, text string, said string")
    return told.select("question", F.posexplode(prompts.sub_queries(F.col("said"), F.col("text"))).alias("qid", "query"))


def intents(questions: DataFrame, said: Column | None = None) -> DataFrame:
    """questions (text) with intent: what a model said, or else by the question's own words."""
    plain = F.when(asks_for_whole(F.col("text")), "document_overview").otherwise("fact_qa")
    return questions.withColumn("intent", plain if said is None else F.coalesce(prompts.intent(said), plain))


def segmented(text: Column, load: Callable | None = None) -> Column:
    """Tokens by a segmenter that cuts each text of a list, or by the engine's own pattern."""
    if load is None:
        return tokens(text)

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = loaded(load)
        for b in batches:
            yield pd.Series([[t for t in model(x) if t.strip()] for x in b.fillna("")])

    return run(text)


def summary(old: str, history: str, say: Callable[[str], str] | None = None, most: int = 2000) -> str:
    """A summary of turns on top of an old one, by a model or by keeping the end of both."""
    return say(f"{old}\n{history}".strip()) if say else f"{old}\n{history}".strip()[-most:]


def parsed(contents: DataFrame, load: Callable) -> DataFrame:
    """(path, chunk_index, text, section_title, section_hierarchy, page, source_type) of files (path, content).

    The parser gives for a file's bytes a list of (text, title, hierarchy, page, type).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = loaded(load)
        for b in batches:
            rows = [(p, i, *x) for p, c in zip(b["path"], b["content"]) for i, x in enumerate(model(bytes(c)))]
            yield pd.DataFrame(rows, columns=["path", "chunk_index", "text", "section_title", "section_hierarchy", "page", "source_type"])

    return contents.select("path", "content").mapInPandas(run, "path string, chunk_index int, text string, section_title string, section_hierarchy string, page int, source_type string")
