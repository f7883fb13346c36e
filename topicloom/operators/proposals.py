"""Proposal distributions and Metropolis-Hastings acceptance, as Columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _over_topics(df: DataFrame, topics: int) -> DataFrame:
    return df.withColumn("topic", F.explode(F.sequence(F.lit(0), F.lit(topics - 1))))


def word_proposal(ids: DataFrame, model: DataFrame, summary: DataFrame, topics: int, beta: float, n_words: int) -> DataFrame:
    """``word_id, topic, mass, prob``: mass (n_tw + beta) / (n_t + V beta), and its share."""
    x = _over_topics(ids.select("word_id"), topics).join(model, ["word_id", "topic"], "left")
    x = x.join(F.broadcast(summary.select("topic", F.col("cnt").alias("nt"))), "topic", "left")  # one row per topic
    mass = (F.coalesce("cnt", F.lit(0)) + beta) / (F.coalesce("nt", F.lit(0)) + n_words * beta)
    x = x.select("word_id", "topic", mass.alias("mass"))
    total = x.groupBy("word_id").agg(F.sum("mass").alias("total"))
    return x.join(total, "word_id").select("word_id", "topic", "mass", (F.col("mass") / F.col("total")).alias("prob"))


def doc_proposal(docs: DataFrame, doc_counts: DataFrame, topics: int, alpha: float) -> DataFrame:
    """``doc_id, topic, prob`` with prob (n_td + alpha) / (N_d + alpha K)."""
    size = doc_counts.groupBy("doc_id").agg(F.sum("cnt").alias("nd"))
    x = _over_topics(docs.select("doc_id").join(size, "doc_id"), topics).join(doc_counts, ["doc_id", "topic"], "left")
    return x.select("doc_id", "topic", ((F.coalesce("cnt", F.lit(0)) + alpha) / (F.col("nd") + alpha * topics)).alias("prob"))


def _counts(df: DataFrame, key: str, name: str) -> DataFrame:
    """``key`` and a map from its topics to counts, at most one entry per topic."""
    return df.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("topic", "cnt"))).alias(name))


def acceptance(tokens: DataFrame, model: DataFrame, summary: DataFrame, doc_counts: DataFrame, n_words: int, alpha: float, beta: float, kind: str) -> DataFrame:
    """Acceptance of ``new_topic`` t for a token whose topic s is its old one.

    Target counts exclude the token itself; proposal counts do not.  ``kind``: word or
    doc proposal.  Both topics' counts come with one row per word and one per document;
    only the two that a token needs go on with it to the next join.
    """

    def both(x: DataFrame, n: str) -> DataFrame:
        return x.withColumns({f"{n}_{side}": F.try_element_at(n, F.col(col)) for side, col in (("s", "topic"), ("t", "new_topic"))}).drop(n)

    x = both(tokens.join(_counts(doc_counts, "doc_id", "nd"), "doc_id", "left"), "nd")
    x = both(x.join(_counts(model, "word_id", "nw"), "word_id", "left"), "nw")
    totals = summary.agg(F.map_from_entries(F.collect_list(F.struct("topic", "cnt"))).alias("nt"))
    x = both(x.crossJoin(F.broadcast(totals)), "nt")  # a single row, one entry per topic
    c = {k: F.coalesce(k, F.lit(0)) for k in ("nw_s", "nw_t", "nd_s", "nd_t", "nt_s", "nt_t")}
    same = F.when(F.col("new_topic") == F.col("topic"), 1).otherwise(0)
    vb = n_words * beta
    up = (c["nd_t"] - same + alpha) * (c["nw_t"] - same + beta) * (c["nt_s"] - 1 + vb)
    down = (c["nd_s"] - 1 + alpha) * (c["nw_s"] - 1 + beta) * (c["nt_t"] - same + vb)
    if kind == "word":
        up, down = up * (c["nw_s"] + beta) * (c["nt_t"] + vb), down * (c["nw_t"] + beta) * (c["nt_s"] + vb)
    else:
        up, down = up * (c["nd_s"] + alpha), down * (c["nd_t"] + alpha)
    return x.select("doc_id", "pos", "word_id", "topic", "new_topic", F.least(F.lit(1.0), up / down).alias("accept"))
