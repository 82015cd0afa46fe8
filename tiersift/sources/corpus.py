"""The files of a corpus: listings, selections, checks of uploads, their names and identities, and what came of a batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import normal_hash

#: Accepted suffixes, MiB of a file, files of a batch, and how a PDF begins.
SUFFIXES, MOST_MIB, MOST_FILES, MAGIC = (".pdf",), 20, 10, b"%PDF-"
MIB = 1 << 20


def files(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """(path, name, size_bytes, updated_at) of a folder's own files with a suffix in any case, newest first. Contents are not read."""
    found = spark.read.format("binaryFile").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    good = F.lit(False)
    for s in suffixes:
        good = good | F.lower("path").endswith(s.lower())
    return found.where(good).select("path", name.alias("name"), F.col("length").alias("size_bytes"), F.unix_millis("modificationTime").alias("updated_at")).orderBy(F.desc("updated_at"), "path")


def by_path(listed: DataFrame) -> DataFrame:
    return listed.orderBy("path")


def selected(listed: DataFrame, chosen: str | None) -> DataFrame:
    """The paths of a JSON list that are files of the corpus, with their place in it; none if it is no list of paths."""
    spark = listed.sparkSession
    wanted = spark.range(1).select(F.posexplode(F.coalesce(F.from_json(F.lit(chosen or "[]"), "array<string>"), F.array().cast("array<string>"))).alias("place", "path"))
    return wanted.join(listed.select("path"), "path", "left_semi")


def hashes_of(chosen: DataFrame, hashed: DataFrame) -> DataFrame:
    """(doc_hash) of chosen (path) by hashed (path, doc_hash), normal and without repeats."""
    return chosen.join(hashed, "path").select(normal_hash(F.col("doc_hash")).alias("doc_hash")).where("doc_hash is not null").distinct()


def single(chosen: DataFrame) -> str:
    """The path of the one document that is chosen; an error if there are none or more."""
    found = [r.path for r in chosen.select("path").distinct().limit(2).collect()]
    if len(found) != 1:
        raise ValueError("choose one document")
    return found[0]


def rejected(name: Column, size: Column, first: Column, suffixes: tuple[str, ...] = SUFFIXES, mib: int = MOST_MIB) -> Column:
    """Why a file is not taken: its type or its size; null if it is."""
    suffix = F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))
    safe = (F.coalesce(name, F.lit("")) != "") & ~F.contains(name, F.lit("..")) & ~F.contains(name, F.lit("/")) & ~F.contains(name, F.lit("\\"))
    pdf = F.coalesce(F.startswith(first, F.lit(MAGIC)), F.lit(False))
    return F.when(~safe | ~suffix.isin(*suffixes), "type").when(size > mib * MIB, "size").when((suffix == ".pdf") & ~pdf, "type")


def plain_name(name: Column) -> Column:
    """A name of letters, digits, underscores, hyphens, blanks and dots."""
    return F.regexp_replace(F.element_at(F.split(name, "/"), -1), r"[^\p{L}\p{N}_\- .]", "")


def stored_names(batch: DataFrame, store: DataFrame) -> DataFrame:
    """(order, name, hash, stored) of the files of batch (order, name, content) whose content the store (name, hash) lacks.

    Of equal contents the first counts. A name that the store or an earlier file of the batch has gets the hash's start behind its stem.
    """
    hashed = batch.select("order", plain_name(F.col("name")).alias("name"), F.md5("content").alias("hash"))
    fresh = hashed.join(store.select("hash").distinct(), "hash", "left_anti")
    fresh = fresh.withColumn("n", F.row_number().over(Window.partitionBy("hash").orderBy("order"))).where("n = 1")
    taken = store.select("name").distinct().withColumn("there", F.lit(True))
    fresh = fresh.withColumn("n", F.row_number().over(Window.partitionBy("name").orderBy("order"))).join(taken, "name", "left")
    stem, suffix = F.regexp_extract("name", r"^(.+?)(\.[^.]*)?$", 1), F.regexp_extract("name", r"^(.+?)(\.[^.]*)?$", 2)
    other = F.concat(stem, F.lit("_"), F.left("hash", F.lit(8)), suffix)
    return fresh.select("order", "name", "hash", F.when(F.col("there") | (F.col("n") > 1), other).otherwise(F.col("name")).alias("stored"))


def outcome(batch: DataFrame) -> DataFrame:
    """Counts of a batch (reason, is_new): files added, already there, and not taken by type and by size."""
    taken = F.col("reason").isNull()
    return batch.agg(F.count_if(taken & F.col("is_new")).alias("added"), F.count_if(taken & ~F.col("is_new")).alias("skipped_existing"), F.count_if(F.col("reason") == "type").alias("skipped_type"), F.count_if(F.col("reason") == "size").alias("skipped_size"))


def checked_batch(batch: DataFrame, most: int = MOST_FILES) -> DataFrame:
    """batch, if it holds a file and no more than ``most``."""
    n = batch.limit(most + 1).count()
    if not n or n > most:
        raise ValueError(f"a batch holds 1 to {most} files")
    return batch


def folder_name(contents: DataFrame) -> str | None:
    """The hash of all contents (path, content) in the order of paths, which names their snapshot; None without files.

    A hash of one stream has one order: a corpus' files are hashed one after the other, as they come from the executors.
    """
    import hashlib

    total, found = hashlib.md5(), False
    for r in contents.select("path", "content").orderBy("path").toLocalIterator():
        total.update(r.content)
        found = True
    return total.hexdigest() if found else None
