"""Ranked words of topics, and text dumps of the model with their parser."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from topicloom.plans.lineage import ranks


def topic_words(model: DataFrame, ids: DataFrame, top: int | None = None) -> DataFrame:
    """``topic, rank, word_id, word, cnt, prob``: by count, then id; prob is the share in the topic."""
    total = model.groupBy("topic").agg(F.sum("cnt").alias("total"))
    x = model.select("topic", "word_id", "cnt").join(F.broadcast(total), "topic")  # one row per topic
    order = [F.desc("cnt"), F.asc("word_id")]
    if top:  # each task keeps the first rows of a topic alone
        x = x.withColumn("rank", F.row_number().over(Window.partitionBy("topic").orderBy(*order))).filter(F.col("rank") <= top)
    else:
        x = ranks(x, "rank", ["topic"], *order)
    return x.join(ids.select("word_id", "word"), "word_id").select("topic", "rank", "word_id", "word", "cnt", (F.col("cnt") / F.col("total")).alias("prob"))


def topic_report(ranked: DataFrame, digits: int = 6) -> DataFrame:
    """``line``: per topic its number and then ``word:prob`` pairs by rank; ``ranked`` is ``topic_words`` with a top."""
    pair = F.struct("rank", F.concat_ws(":", "word", F.format_string(f"%.{digits}f", "prob")).alias("shown"))
    per = ranked.groupBy("topic").agg(F.array_sort(F.collect_list(pair)).alias("ps"))
    return per.select(F.concat_ws("\t", F.col("topic").cast("string"), F.array_join(F.transform("ps", lambda p: p["shown"]), " ")).alias("line"))


def dump_text(model: DataFrame) -> DataFrame:
    """``line``: word id and its topic:count pairs, topics ascending, zeros left out."""
    pair = F.struct("topic", F.concat_ws(":", "topic", "cnt").alias("shown"))
    per = model.filter("cnt <> 0").groupBy("word_id").agg(F.array_sort(F.collect_list(pair)).alias("ps"))
    return per.select(F.concat_ws(" ", F.col("word_id").cast("string"), F.array_join(F.transform("ps", lambda p: p["shown"]), " ")).alias("line"))


def dump_summary(summary: DataFrame) -> DataFrame:
    """One ``line`` of topic:count pairs."""
    pair = F.struct("topic", F.concat_ws(":", "topic", "cnt").alias("shown"))
    per = summary.agg(F.array_sort(F.collect_list(pair)).alias("ps"))  # one entry per topic
    return per.select(F.array_join(F.transform("ps", lambda p: p["shown"]), " ").alias("line"))


def parse_dump(lines: DataFrame) -> DataFrame:
    """``line`` -> ``word_id, topic, cnt``."""
    parts = F.split(F.trim("line"), " +")
    x = lines.select(F.element_at(parts, 1).cast("int").alias("word_id"), F.explode(F.slice(parts, 2, F.size(parts))).alias("p"))
    pair = F.split("p", ":")
    return x.select("word_id", F.element_at(pair, 1).cast("int").alias("topic"), F.element_at(pair, 2).cast("long").alias("cnt"))


def read_dumps(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Union of the dumps of several clients."""
    return parse_dump(spark.read.text(list(paths)).withColumnRenamed("value", "line"))
