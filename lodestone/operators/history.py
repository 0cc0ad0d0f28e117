"""The list of saved conversations: save, archive, rename, describe, delete (DML-08, TOP-12).

A history is (id, title, custom_title, description, archived, saved_at, place, messages), messages an array of (role, content);
the greatest `place` is the front. Changes are keyed, so each is an anti-join and a union over rows that are found by id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Conversations that are kept, and characters of a title, a title of one's own and a description.
MOST, TITLE_CHARS, OWN_TITLE_CHARS, DESCRIPTION_CHARS = 50, 60, 120, 400
COLUMNS = ("id", "title", "custom_title", "description", "archived", "saved_at", "place", "messages")


def title_of(messages: Column) -> Column:
    """The first user message on one line, at most TITLE_CHARS of it and then an ellipsis; '' without one."""
    said = F.coalesce(F.filter(messages, lambda m: m["role"] == "user")[0]["content"], F.lit(""))
    line = F.trim(F.regexp_replace(said, r"\s*\n\s*", " "))
    return F.when(F.length(line) > TITLE_CHARS, F.concat(F.substring(line, 1, TITLE_CHARS), F.lit("…"))).otherwise(line)


def save(history: DataFrame, new: DataFrame, most: int = MOST) -> DataFrame:
    """Conversations (id, saved_at, messages) at the front, in the order of `saved_at`; the oldest beyond `most` go.

    Those without a user message aren't saved. A title of one's own, a description and the archive mark stay with the id.
    """
    said = new.where(F.exists("messages", lambda m: m["role"] == "user"))
    old = history.select("id", F.col("title").alias("_t"), F.col("custom_title").alias("_c"), "description", "archived")
    top = history.agg(F.coalesce(F.max("place"), F.lit(0)).alias("_top"))  # one row
    own = F.coalesce("_c", F.lit(False)) & (F.coalesce("_t", F.lit("")) != "")
    front = said.join(old, "id", "left").crossJoin(F.broadcast(top)).select(
        "id", F.when(own, F.col("_t")).otherwise(title_of(F.col("messages"))).alias("title"), own.alias("custom_title"), "description", F.coalesce("archived", F.lit(False)).alias("archived"), "saved_at",
        (F.col("_top") + F.row_number().over(Window.orderBy("saved_at", "id"))).cast("long").alias("place"), "messages",
    )
    every = history.join(said.select("id"), "id", "left_anti").select(*COLUMNS).unionByName(front)
    return every.orderBy(F.desc("place")).limit(most)


def archive(history: DataFrame, ids: DataFrame, archived: bool = True) -> DataFrame:
    """The archive mark of `ids(id)` set or taken off; unknown ids change nothing."""
    met = history.join(ids.select("id", F.lit(True).alias("_m")).distinct(), "id", "left")
    return met.withColumn("archived", F.when(F.col("_m"), F.lit(archived)).otherwise(F.coalesce("archived", F.lit(False)))).select(*COLUMNS)


def rename(history: DataFrame, changes: DataFrame) -> DataFrame:
    """Titles and descriptions of `changes(id, new_title, new_description)`; null leaves what there is, blank takes it back.

    A title taken back is the first message's again, if that gives one.
    """
    met = history.join(changes.select("id", "new_title", "new_description"), "id", "left")
    title, about = F.trim(F.regexp_replace("new_title", r"\s*\n\s*", " ")), F.trim(F.regexp_replace("new_description", r"\s+", " "))
    made = title_of(F.col("messages"))
    return met.select(
        "id", F.when(title.isNull(), F.col("title")).when(title != "", F.substring(title, 1, OWN_TITLE_CHARS)).when(made != "", made).otherwise(F.col("title")).alias("title"),
        F.when(title.isNull(), F.coalesce("custom_title", F.lit(False))).otherwise(title != "").alias("custom_title"),
        F.when(about.isNull(), F.col("description")).when(about != "", F.substring(about, 1, DESCRIPTION_CHARS)).alias("description"),
        "archived", "saved_at", "place", "messages",
    )


def delete(history: DataFrame, ids: DataFrame) -> DataFrame:
    return history.join(ids.select("id"), "id", "left_anti")


def listed(history: DataFrame, archived: bool = False) -> DataFrame:
    """Active or archived conversations, the newest first."""
    return history.where(F.coalesce("archived", F.lit(False)) == archived).orderBy(F.desc("place"))
