"""Log-likelihoods of documents and words."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topicloom.functions.mathx import log_gamma, log_gamma_of


def doc_llh(doc_counts: DataFrame, topics: int, a: float) -> DataFrame:
    """``doc_id, llh`` of documents with tokens (others count 0)."""
    lg = log_gamma(F.col("cnt") + a)
    x = doc_counts.groupBy("doc_id").agg(F.sum(lg).alias("lg"), F.count("*").alias("nnz"), F.sum("cnt").alias("nd"))
    constant = log_gamma_of(topics * a) - topics * log_gamma_of(a)
    llh = constant + F.col("lg") + (topics - F.col("nnz")) * log_gamma_of(a) - log_gamma(F.col("nd") + topics * a)
    return x.select("doc_id", llh.alias("llh"))


def word_llh(model: DataFrame, topics: int, beta: float) -> DataFrame:
    """``word_id, llh`` of words with tokens."""
    x = model.groupBy("word_id").agg(F.sum(log_gamma(F.col("cnt") + beta)).alias("lg"), F.count("*").alias("nnz"))
    return x.select("word_id", (F.col("lg") + (topics - F.col("nnz")) * log_gamma_of(beta)).alias("llh"))


def llh_normalizer(summary: DataFrame, topics: int, beta: float, n_words: int) -> DataFrame:
    """``normalizer``: topics without tokens count, too."""
    vb = n_words * beta
    x = summary.agg(F.sum(log_gamma(F.col("cnt") + vb)).alias("lg"), F.count("*").alias("nnz"))
    head = topics * (log_gamma_of(vb) - n_words * log_gamma_of(beta))
    return x.select((F.lit(head) - F.coalesce("lg", F.lit(0.0)) - (topics - F.col("nnz")) * log_gamma_of(vb)).alias("normalizer"))


def corpus_doc_llh(doc_counts: DataFrame, topics: int, a: float, blocks: DataFrame | None = None, cap: int | None = None) -> DataFrame:
    """``llh``: the sum over documents; with ``cap`` over the first of each block alone, an estimate for large blocks."""
    x = doc_llh(doc_counts, topics, a)
    if cap is not None:
        first = blocks.withColumn("n", F.row_number().over(Window.partitionBy("block_id").orderBy("doc_id"))).filter(F.col("n") <= cap)
        x = first.select("doc_id").join(x, "doc_id")
    return x.select(F.coalesce(F.sum("llh"), F.lit(0.0)).alias("llh"))


def corpus_word_llh(model: DataFrame, summary: DataFrame, topics: int, beta: float, n_words: int, mode: str = "reference") -> DataFrame:
    """``llh``: words and normaliser.  ``mode`` reference skips words without tokens; exact adds their constant."""
    x = word_llh(model, topics, beta).agg(F.coalesce(F.sum("llh"), F.lit(0.0)).alias("llh"), F.count("*").alias("n"))
    absent = (n_words - F.col("n")) * F.lit(topics * log_gamma_of(beta)) if mode == "exact" else F.lit(0.0)
    norm = llh_normalizer(summary, topics, beta, n_words)
    return x.crossJoin(F.broadcast(norm)).select((F.col("llh") + absent + F.col("normalizer")).alias("llh"))  # a row each


def corpus_parts(doc_counts: DataFrame, model: DataFrame, blocks: DataFrame, cap: int, topics: int, a: float, beta: float, n_words: int) -> DataFrame:
    """``part, llh``: documents, those among the first ``cap`` of a block, words, and words with those that have no token.

    Each document and each word is reckoned once for all parts; topics are summed from the words' counts.
    """
    rank = F.row_number().over(Window.partitionBy("block_id").orderBy("doc_id"))
    first = blocks.select("doc_id", rank.alias("n")).filter(F.col("n") <= cap).select("doc_id", F.lit(True).alias("capped")).distinct()
    total = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    docs = doc_llh(doc_counts, topics, a).join(first, "doc_id", "left").agg(total("llh").alias("doc"), total(F.when(F.col("capped"), F.col("llh"))).alias("doc_capped"))
    norm = llh_normalizer(model.groupBy("topic").agg(F.sum("cnt").alias("cnt")), topics, beta, n_words)
    words = word_llh(model, topics, beta).agg(total("llh").alias("llh"), F.count("*").alias("n")).crossJoin(F.broadcast(norm))  # a row each
    word = F.col("llh") + F.col("normalizer")
    words = words.select(word.alias("word"), (word + (n_words - F.col("n")) * F.lit(topics * log_gamma_of(beta))).alias("word_exact"))
    rows = [df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("part"), F.col(c).alias("llh")) for c in df.columns])).alias("x")).select("x.*") for df in (docs, words)]
    return rows[0].unionByName(rows[1])


def corpus_llh(tokens: DataFrame, topics: int, cfg, n_words: int, mode: str = "reference") -> dict[str, float]:
    """Document and word log-likelihood of one state."""
    from topicloom.operators import counts as C

    doc = corpus_doc_llh(C.doc_topic(tokens), topics, cfg.ll_alpha).first()[0]
    word = corpus_word_llh(C.word_topic(tokens), C.topic_summary(tokens), topics, cfg.beta, n_words, mode).first()[0]
    return {"doc": doc, "word": word}


def acceptance_counters(accepted: DataFrame) -> DataFrame:
    """``n_tokens, n_changes, n_certain, expected``: proposals, those that change the topic, those sure to be taken, and how many are taken in expectation."""
    change = F.col("topic") != F.col("new_topic")
    return accepted.agg(
        F.count("*").alias("n_tokens"), F.count(F.when(change, 1)).alias("n_changes"),
        F.count(F.when(change & (F.col("accept") >= 1), 1)).alias("n_certain"), F.coalesce(F.sum(F.when(change, F.col("accept"))), F.lit(0.0)).alias("expected"),
    )
