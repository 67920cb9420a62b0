"""Conversations to labelled messages, batches and their contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BATCH, CONTEXT = 10, 3
# What stands for a missing time and a missing description.
NO_TIME, NO_CAPTION = "未知时间", "No description"


def session_number(key: Column) -> Column:
    """Number of a ``session_N`` key; null for any other key. The whole key must match."""
    return F.when(key.rlike(r"^session_\d+$"), F.regexp_extract(key, r"(\d+)$", 1).cast("int"))


def render(speaker: Column, text: Column, time: Column, image: Column | None = None, query: Column | None = None, caption: Column | None = None) -> Column:
    """One message as text; with an image, its query and caption stand before the words."""
    when, said = F.coalesce(time, F.lit(NO_TIME)), F.coalesce(text, F.lit(""))
    plain = F.concat(F.lit("【"), speaker, F.lit(' said: "'), said, F.lit(" Dialogue time:"), when, F.lit("】"))
    if image is None:
        return plain
    asked, shown = (F.coalesce(c, F.lit(NO_CAPTION)) for c in (query, caption))
    seen = F.concat(F.lit("【"), speaker, F.lit(" sent an image: "), asked, F.lit(". Image content: "), shown, F.lit(". Dialogue: "), said, F.lit(" Dialogue time:"), when, F.lit("】"))
    return F.when(F.coalesce(image, F.lit("")) != "", seen).otherwise(plain)


def label(turns: DataFrame, dialog: str = "dialog", order: tuple[str, ...] = ("session", "turn")) -> DataFrame:
    """Running number of each message in its dialog from 1, and its place in its session from 1."""
    return turns.withColumn("label", F.row_number().over(Window.partitionBy(dialog).orderBy(*order)).cast("long")).withColumn("pos", F.row_number().over(Window.partitionBy(dialog, order[0]).orderBy(*order[1:])).cast("long"))


def batch(messages: DataFrame, size: int = BATCH) -> DataFrame:
    """Number of the batch inside its session; a session's last batch may be short."""
    return messages.withColumn("batch_no", F.floor((F.col("pos") - 1) / size).cast("long"))


def first_of_label(messages: DataFrame, by: list[str], label: str, order: str) -> DataFrame:
    """of messages of a batch with one label the first."""
    rank = F.row_number().over(Window.partitionBy(*by, label).orderBy(order))
    return messages.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def batch_context(messages: DataFrame, size: int = BATCH, context: int = CONTEXT) -> DataFrame:
    """Each batch with the labels of the last ``context`` messages before it in its session, in order."""
    session = Window.partitionBy("dialog", "session").orderBy("pos").rowsBetween(-context, -1)
    before = batch(messages, size).withColumn("context", F.collect_list("label").over(session))
    keys = ["dialog", "session", "batch_no"]
    return before.groupBy(*keys).agg(F.count("*").alias("n_messages"), F.min("label").alias("first_label"), F.max("label").alias("last_label"), F.min_by("context", "pos").alias("context"))


def sentences(docs: DataFrame, key: str, text: str, mark: str, size: int = 5) -> DataFrame:
    """Trimmed sentences of each text with their number and group; empty ones take no number."""
    split = docs.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), mark, -1)).alias("at", "raw")).withColumn("sentence", F.trim(F.col("raw"), F.lit(" \n\t"))).where("sentence <> ''")
    numbered = split.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("at")).cast("long"))
    return numbered.select(key, "n", F.floor((F.col("n") - 1) / size).cast("long").alias("group_no"), "sentence")


def head(messages: DataFrame, most: int, by: str = "dialog", order: str = "label") -> DataFrame:
    """The first ``most`` messages of each dialog."""
    return messages.withColumn("_rank", F.row_number().over(Window.partitionBy(by).orderBy(order))).where(F.col("_rank") <= most).drop("_rank")


def first_sessions(messages: DataFrame, most: int, by: str = "dialog") -> DataFrame:
    """Messages of the first ``most`` sessions of each dialog."""
    rank = F.dense_rank().over(Window.partitionBy(by).orderBy("session"))
    return messages.withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_rank")


def tail(messages: DataFrame, most: int, by: list[str], order: str = "label") -> DataFrame:
    """The last ``most`` messages of each group."""
    return messages.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(order)))).where(F.col("_rank") <= most).drop("_rank")


def within_budget(blocks: DataFrame, by: str, order: str, text: str, most: int) -> DataFrame:
    """Blocks whose running length stays within ``most`` characters; 0 keeps all."""
    if most <= 0:
        return blocks
    running = F.sum(F.char_length(text)).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return blocks.withColumn("used", running).where(F.col("used") <= most)


def merge_labels(first: Column, second: Column) -> Column:
    """Labels of both lists as trimmed strings, without repeats, first list first."""
    plain = lambda c: F.transform(c, lambda x: F.trim(x.cast("string")))
    return F.array_distinct(F.concat(plain(first), plain(second)))
