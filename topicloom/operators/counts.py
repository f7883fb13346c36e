"""Topic assignments, count tables, and deltas between two states."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.functions.mathx import draw_topic


def init_topics(encoded: DataFrame, topics: int, seed: int) -> DataFrame:
    """Cold start: a uniform topic for each token, by hash of its place."""
    return encoded.withColumn("topic", draw_topic(F.col("doc_id"), F.col("pos"), topics, seed))


def doc_topic(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("doc_id", "topic").agg(F.count("*").alias("cnt"))


def word_topic(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("word_id", "topic").agg(F.count("*").alias("cnt"))


def topic_summary(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("topic").agg(F.count("*").alias("cnt"))


def topic_summary_of(model: DataFrame) -> DataFrame:
    """``topic, cnt`` from word-topic counts."""
    return model.groupBy("topic").agg(F.sum("cnt").alias("cnt"))


def deltas(tokens: DataFrame) -> DataFrame:
    """``topic`` to ``new_topic``: -1 and +1 for every token that changes."""
    pair = F.array(F.struct(F.col("topic"), F.lit(-1).alias("delta")), F.struct(F.col("new_topic").alias("topic"), F.lit(1).alias("delta")))
    moved = tokens.filter(F.col("topic") != F.col("new_topic"))
    return moved.select("word_id", F.explode(pair).alias("d")).select("word_id", "d.topic", "d.delta")


def sum_deltas(changes: DataFrame) -> DataFrame:
    """Sums by word and topic; zeros vanish."""
    return changes.groupBy("word_id", "topic").agg(F.sum("delta").alias("delta")).filter("delta <> 0")


def apply_deltas(model: DataFrame, changes: DataFrame) -> DataFrame:
    """``word_id, topic, cnt`` after the changes; zeros vanish."""
    both = model.select("word_id", "topic", "cnt").unionByName(changes.select("word_id", "topic", F.col("delta").cast("long").alias("cnt")))
    return both.groupBy("word_id", "topic").agg(F.sum("cnt").alias("cnt")).filter("cnt <> 0")


def sum_summary_deltas(changes: DataFrame) -> DataFrame:
    """``topic, delta``: word-topic changes summed by topic; zeros vanish."""
    return changes.groupBy("topic").agg(F.sum("delta").alias("delta")).filter("delta <> 0")


def apply_summary_deltas(summary: DataFrame, changes: DataFrame) -> DataFrame:
    """``topic, cnt`` after the changes; topics left without tokens vanish."""
    both = summary.select("topic", "cnt").unionByName(changes.select("topic", F.col("delta").cast("long").alias("cnt")))
    return both.groupBy("topic").agg(F.sum("cnt").alias("cnt")).filter("cnt <> 0")
