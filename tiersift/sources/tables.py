"""Where data comes from and goes to: tables of a folder, chunks of documents, upserts and snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import strip, token_count

#: Tokens of a chunk, and those that a chunk repeats of the one before.
CHUNK_TOKENS, OVERLAP = 256, 30


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def chunks(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, chunk_index, text): non-blank lines, stripped; the index counts blank lines too."""
    lines = documents.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(text_col, "\n")).alias("chunk_index", "text"))
    return lines.select("doc_id", "chunk_index", strip(F.col("text")).alias("text")).where("text <> ''")


def token_chunks(lines: DataFrame, most: int = CHUNK_TOKENS, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, chunk, text, n_tokens) of lines (doc_id, chunk_index, text): peers joined up to ``most`` tokens.

    A line goes to the chunk in which the tokens before it fall; the lines that begin within the last ``overlap`` tokens
    of a chunk are repeated in the next one. A line longer than a chunk stays whole.
    """
    n = F.greatest(token_count(F.col("text")), F.lit(1))
    before = F.sum("n").over(Window.partitionBy("doc_id").orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, -1))
    placed = lines.withColumn("n", n).withColumn("before", F.coalesce(before, F.lit(0)))
    own = F.floor(F.col("before") / most)
    again = F.col("before") >= (own + 1) * most - overlap
    placed = placed.withColumn("last", F.max("before").over(Window.partitionBy("doc_id")))
    to = F.when(again & (F.col("last") >= (own + 1) * most), F.array(own, own + 1)).otherwise(F.array(own))
    dealt = placed.withColumn("chunk", F.explode(to))
    rolled = dealt.groupBy("doc_id", "chunk").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk_index", "text"))), lambda x: x["text"]), "\n").alias("text"), F.sum("n").alias("n_tokens"))
    return rolled


def by_ids(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows with one of ids (key, place), each once and in the order of its first place; blank ids are dropped."""
    wanted = ids.where(strip(F.coalesce(F.col(key).cast("string"), F.lit(""))) != "").groupBy(key).agg(F.min("place").alias("place"))
    return rows.join(wanted, key)


def by_hash(rows: DataFrame, doc_hash: str) -> DataFrame:
    """The rows of one document; the filter reaches the scan."""
    return rows.where(F.col("doc_hash") == doc_hash.strip().lower())


def metadata(rows: DataFrame, *texts: str) -> DataFrame:
    """The rows without their texts, which are then not read."""
    return rows.drop(*texts)


def has_rows(rows: DataFrame) -> bool:
    return not rows.isEmpty()


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with the rows of new in place of, or beside, its own."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def not_indexed(batch: DataFrame, store: DataFrame, key: str) -> DataFrame:
    """The rows of batch whose key the store does not have."""
    return batch.join(store.select(key).distinct(), key, "left_anti")


def new_by_content(store: DataFrame, batch: DataFrame, content: str, order: str) -> DataFrame:
    """The first row of each content in batch whose hash the store does not have."""
    hashed = batch.withColumn("hash", F.md5(F.col(content)))
    fresh = hashed.join(store.select(F.md5(F.col(content)).alias("hash")).distinct(), "hash", "left_anti")
    return fresh.groupBy("hash").agg(F.min(order).alias(order))


def first_seen(rows: DataFrame, key: Column, order: str) -> DataFrame:
    """Of rows with equal keys the first in order: a union of lists without repeats."""
    return rows.withColumn("_key", key).withColumn("_n", F.row_number().over(Window.partitionBy("_key").orderBy(order))).where("_n = 1").drop("_key", "_n")


def _paths(spark: SparkSession, *paths: str):
    made = [spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p) for p in paths]
    return made[0].getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), made


def save_snapshot(levels: dict[str, DataFrame], folder: str) -> None:
    """Writes all levels beside the folder and puts them in its place when they are whole, so that levels may come from it."""
    spark = next(iter(levels.values())).sparkSession
    staged, old = f"{folder.rstrip('/')}.new", f"{folder.rstrip('/')}.old"
    for level, df in levels.items():
        df.write.mode("overwrite").parquet(f"{staged}/{level}")
    store, (at, new, before) = _paths(spark, folder, staged, old)
    store.delete(before, True)
    if store.exists(at):
        store.rename(at, before)
    store.rename(new, at)
    store.delete(before, True)


def load_snapshot(spark: SparkSession, folder: str, level: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{level}")


def snapshot_there(spark: SparkSession, folder: str) -> bool:
    store, (at,) = _paths(spark, folder)
    return bool(store.exists(at))
