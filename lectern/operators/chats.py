"""Conversations: lists, histories, exports, budgets of text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def listed(chats: DataFrame, messages: DataFrame) -> DataFrame:
    """id, title, at, n of each chat, one without messages too; the last changed first."""
    n = messages.groupBy(F.col("chat_id").alias("_c")).agg(F.count("*").alias("n"))
    joined = chats.join(n, chats["id"] == n["_c"], "left")
    return joined.select("id", "title", F.coalesce("updated_at", "created_at").alias("at"), F.coalesce("n", F.lit(0).cast("long")).alias("n")).orderBy(F.desc("at"), F.desc("id"))


def title_of(text, size: int = 24, default: str = "New chat"):
    short = F.substring(F.trim(F.regexp_replace(text, "\\s+", " ")), 1, size)
    return F.coalesce(F.nullif(short, F.lit("")), F.lit(default))


def last_turns(messages: DataFrame, most: int = 4, size: int = 1200) -> DataFrame:
    """The last turns of each conversation, cut to size."""
    ranked = messages.withColumn("_k", F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("turn"))))
    return ranked.where(F.col("_k") <= most).select("conv_id", "turn", "role", F.substring("text", 1, size).alias("text"))


def exported(messages: DataFrame) -> DataFrame:
    """conv_id, markdown: all messages of a conversation under their roles."""
    block = F.concat(F.lit("## "), "role", F.lit("\n\n"), "text")
    grouped = messages.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", block.alias("b")))).alias("m"))
    return grouped.select("conv_id", F.array_join(F.transform("m", lambda s: s["b"]), "\n\n").alias("markdown"))


def last_of_role(messages: DataFrame, role: str = "assistant") -> DataFrame:
    return messages.where(F.col("role") == role).groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"))


def within_budget(pages: DataFrame, budget: int = 120_000) -> DataFrame:
    """Pages (doc_id, page, text) up to the first that goes over the budget of characters; blank ones are passed over."""
    w = W.partitionBy("doc_id").orderBy("page").rowsBetween(W.unboundedPreceding, 0)
    return pages.where(F.trim("text") != "").withColumn("upto", F.sum(F.length("text")).over(w)).where(F.col("upto") <= budget).withColumn("upto", F.col("upto").cast("long"))
