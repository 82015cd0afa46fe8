"""Incremental ingestion: files that arrive are indexed once, however often a batch is repeated."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import hierarchy
from ..sources import tables

LEVELS = {"element": "element_id", "section": "section_id", "paper": "paper_id"}


def indexed(chunks: DataFrame) -> dict[str, DataFrame]:
    """The three levels of chunks, as of hierarchy.normal_chunks()'s input."""
    rows = hierarchy.elements(hierarchy.body(hierarchy.normal_chunks(chunks)))
    return {"element": rows, "section": hierarchy.sections(rows), "paper": hierarchy.papers(rows)}


def index(chunks: DataFrame, store: str) -> None:
    """Adds documents to the store, but for those that it has; the store is replaced when all levels are whole."""
    spark = chunks.sparkSession
    if not tables.snapshot_there(spark, store):
        tables.save_snapshot(indexed(chunks), store)
        return
    fresh = tables.not_indexed(chunks, tables.load_snapshot(spark, store, "paper"), "doc_hash")
    if not fresh.isEmpty():
        tables.save_snapshot({k: tables.upserted(tables.load_snapshot(spark, store, k), df, LEVELS[k]) for k, df in indexed(fresh).items()}, store)


def ingest(spark: SparkSession, folder: str, store: str, checkpoint: str, parse: Callable[[DataFrame], DataFrame], glob: str = "*.pdf") -> StreamingQuery:
    """Indexes the files that lie in a folder and were not seen before, then ends.

    parse gives chunks (path, ...) of files (path, content), as models.parsed() does. A batch that is repeated after a
    failure adds nothing, since its documents are in the store already.
    """
    found = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", glob).load(folder)

    def take(batch: DataFrame, _: int) -> None:
        hashed = batch.select("path", F.md5("content").alias("doc_hash"))
        hashed = tables.first_seen(hashed, F.col("doc_hash"), "path")
        index(parse(batch.select("path", "content")).join(hashed, "path"), store)

    return found.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
