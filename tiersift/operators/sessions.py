"""Sessions: histories of question and answer pairs, frames of turns, listings, expiry and guarded updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import is_expired, session_title

PAIR = "array<struct<question: string, answer: string>>"


def pairs(turns: DataFrame) -> DataFrame:
    """(conv_id, pair, question, answer, turn) of turns (conv_id, turn, role, text): each user's turn with the assistant's next one.

    Pairs are counted from 0; a question without an answer has an empty one, and other roles are passed over.
    """
    said = turns.where(F.col("role").isin("user", "assistant"))
    after = Window.partitionBy("conv_id").orderBy("turn", F.desc("role"), "text")
    said = said.withColumns({"next_role": F.lead("role").over(after), "next_text": F.lead("text").over(after)})
    asked = said.where("role = 'user'").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("question"), F.coalesce(F.when(F.col("next_role") == "assistant", F.col("next_text")), F.lit("")).alias("answer"))
    return asked.withColumn("pair", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "question", "answer")) - 1)


def frame(rows: DataFrame, skip: int, take: int) -> DataFrame:
    """Of each conversation, the ``take`` pairs before its last ``skip``; back counts from the end."""
    back = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("pair")))
    return rows.withColumn("back", back).where((F.col("back") > skip) & (F.col("back") <= skip + take))


def listing(rows: DataFrame) -> DataFrame:
    """(conv_id, title, message_count, updated_at), the last updated first: two messages a pair; updated_at is the last pair's turn."""
    rolled = rows.groupBy("conv_id").agg(F.min_by("question", "pair").alias("first"), (2 * F.count("*")).alias("message_count"), F.max("turn").alias("updated_at"))
    return rolled.select("conv_id", session_title(F.lit(None).cast("string"), F.col("first")).alias("title"), "message_count", "updated_at").orderBy(F.desc("updated_at"), "conv_id")


def messages(rows: DataFrame) -> DataFrame:
    """(conv_id, seq, role, content): two messages a pair, in order."""
    both = F.array(F.struct(F.lit(0).alias("k"), F.lit("user").alias("role"), F.col("question").alias("content")), F.struct(F.lit(1).alias("k"), F.lit("assistant").alias("role"), F.col("answer").alias("content")))
    return rows.select("conv_id", "pair", F.explode(both).alias("m")).select("conv_id", (2 * F.col("pair") + F.col("m.k")).alias("seq"), "m.role", "m.content")


def history_of(stored: Column) -> Column:
    """The pairs of a history stored as JSON; entries that are no pair are dropped, and what is no list is empty."""
    listed = F.from_json(stored, "array<array<string>>")
    made = F.transform(F.filter(listed, lambda p: F.size(p) == 2), lambda p: F.struct(F.coalesce(p[0], F.lit("")).alias("question"), F.coalesce(p[1], F.lit("")).alias("answer")))
    return F.coalesce(made, F.array().cast(PAIR))


def stored_history(history: Column) -> Column:
    return F.to_json(F.transform(history, lambda p: F.array(p["question"], p["answer"])))


def load(stored: DataFrame, now_s: int) -> DataFrame:
    """Stored sessions (id, title, created_at, updated_at, history, summary) that are not expired, with their pairs."""
    return stored.where(~is_expired(F.col("created_at"), now_s)).withColumn("history", history_of(F.col("history")))


def save(sessions: DataFrame, now_s: int) -> DataFrame:
    """What replaces the store: sessions that are not expired, with their histories as JSON."""
    return sessions.where(~is_expired(F.col("created_at"), now_s)).withColumn("history", stored_history(F.col("history")))


def compare_and_set(stored: DataFrame, updates: DataFrame) -> DataFrame:
    """stored (id, history, summary) where updates (id, seen, history, summary) took effect only if history is still what was seen."""
    u = updates.select("id", "seen", F.col("history").alias("_h"), F.col("summary").alias("_s"))
    same = F.col("seen").isNotNull() & F.col("history").eqNullSafe(F.col("seen"))
    joined = stored.join(u, "id", "left")
    return joined.select("id", F.when(same, F.col("_h")).otherwise(F.col("history")).alias("history"), F.when(same, F.col("_s")).otherwise(F.col("summary")).alias("summary"))
