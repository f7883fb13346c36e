"""Memory plans: row layouts, offsets, and greedy slicing of a block's vocabulary."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topicloom.functions.mathx import next_power_of_two, owner


def _model_layout(tf, topics: int, load: int):
    dense = tf >= topics // (2 * load)
    cap = F.when(dense, F.lit(topics).cast("long")).otherwise(next_power_of_two(tf * load))
    return dense, cap, F.when(dense, F.lit(topics).cast("long")).otherwise(cap * 2)


def dict_meta(ids: DataFrame, topics: int, load: int, clients: int) -> DataFrame:
    """``client_id, word_id, offset, end_offset, capacity, is_dense``: running offsets by client."""
    dense, cap, size = _model_layout(F.col("tf"), topics, load)
    x = ids.select(owner(F.col("word_id"), clients).alias("client_id"), "word_id", dense.cast("int").alias("is_dense"), cap.alias("capacity"), size.alias("size"))
    end = F.sum("size").over(Window.partitionBy("client_id").orderBy("word_id").rowsBetween(Window.unboundedPreceding, 0))
    return x.select("client_id", "word_id", (end - F.col("size")).alias("offset"), end.alias("end_offset"), "capacity", "is_dense")


def dict_meta_by_client(ids: DataFrame, topics: int, load: int, clients: int) -> DataFrame:
    _, _, size = _model_layout(F.col("tf"), topics, load)
    return ids.groupBy(owner(F.col("word_id"), clients).alias("client_id")).agg(
        F.count("*").alias("n_words"), F.sum("tf").alias("tf"), F.sum(size).alias("memory")
    )


def row_sizes(vocab: DataFrame, topics: int, load: int) -> DataFrame:
    """``block_id, word_id, model_size, alias_size, delta_size`` of a block's words."""
    _, _, model = _model_layout(F.col("global_tf"), topics, load)
    alias = F.when(F.col("global_tf") >= 2 * topics // 3, F.lit(2 * topics).cast("long")).otherwise(F.col("global_tf") * 3)
    delta = F.when(F.col("local_tf") >= topics // (4 * load), F.lit(topics).cast("long")).otherwise(next_power_of_two(F.col("local_tf") * 2 * load) * 2)
    return vocab.select("block_id", "word_id", model.alias("model_size"), alias.alias("alias_size"), delta.alias("delta_size"))


def slices(sizes: DataFrame, model_cap: int, alias_cap: int, delta_cap: int) -> DataFrame:
    """``block_id, slice_id, word_id``: words by id; a new slice starts where a sum would overflow.

    A fold over one block's vocabulary, which a block bounds, that keeps the running
    sums and the words that slices start with.  A word that exceeds a capacity by
    itself is an error; no slice is empty.
    """
    caps, cols = (model_cap, alias_cap, delta_cap), ("model_size", "alias_size", "delta_size")
    word = F.struct("word_id", *cols)
    per = sizes.groupBy("block_id").agg(F.sort_array(F.collect_list(word)).alias("ws"))
    start = F.struct(*[F.lit(0).cast("long").alias(n) for n in "mad"], F.array().cast("array<int>").alias("starts"))

    def step(acc, w):
        sums = [acc[n] + w[c] for n, c in zip("mad", cols, strict=True)]
        over = (sums[0] > caps[0]) | (sums[1] > caps[1]) | (sums[2] > caps[2])
        alone = (w["model_size"] > caps[0]) | (w["alias_size"] > caps[1]) | (w["delta_size"] > caps[2])
        first = F.when(alone, F.raise_error(F.concat(F.lit("a word exceeds a slice: "), w["word_id"].cast("string"))).cast("int")).otherwise(w["word_id"])
        opens = over | alone | (F.size(acc["starts"]) == 0)
        kept = [F.when(over, w[c]).otherwise(s).alias(n) for n, c, s in zip("mad", cols, sums, strict=True)]
        return F.struct(*kept, F.when(opens, F.concat(acc["starts"], F.array(first))).otherwise(acc["starts"]).alias("starts"))

    folded = per.select("block_id", "ws", F.aggregate("ws", start, step)["starts"].alias("starts"))
    x = folded.select("block_id", "starts", F.explode("ws.word_id").alias("word_id"))
    return x.select("block_id", (F.size(F.filter("starts", lambda w: w <= F.col("word_id"))) - 1).cast("int").alias("slice_id"), "word_id")


def slice_index(sliced: DataFrame) -> DataFrame:
    """``block_id, slice_id, word_id, index``: a word's place in its slice, from 0."""
    at = F.row_number().over(Window.partitionBy("block_id", "slice_id").orderBy("word_id")) - 1
    return sliced.select("block_id", "slice_id", "word_id", at.alias("index"))


def alias_capacity(model: DataFrame, ids: DataFrame, topics: int) -> DataFrame:
    """``word_id, planned, refined``: alias entries by a word's frequency, and by its non-zero counts once they are known.

    Rows of frequent words are dense and keep an entry per topic.
    """
    nnz = model.filter("cnt <> 0").groupBy("word_id").agg(F.count("*").alias("nnz"))
    dense = F.col("tf") >= 2 * topics // 3
    x = ids.select("word_id", "tf").join(nnz, "word_id", "left")
    whole = F.lit(topics).cast("long")
    return x.select("word_id", F.when(dense, whole).otherwise(F.col("tf")).alias("planned"), F.when(dense, whole).otherwise(F.coalesce("nnz", F.lit(0))).alias("refined"))


def slice_summary(sliced: DataFrame, vocab: DataFrame) -> DataFrame:
    """``block_id, slice_id, first_word, last_word, n_words, global_tf, local_tf``."""
    return sliced.join(vocab, ["block_id", "word_id"]).groupBy("block_id", "slice_id").agg(
        F.min("word_id").alias("first_word"), F.max("word_id").alias("last_word"), F.count("*").alias("n_words"),
        F.sum("global_tf").alias("global_tf"), F.sum("local_tf").alias("local_tf"),
    )


def slice_rows(model: DataFrame, words: DataFrame) -> DataFrame:
    """Model rows of the words that slices ask for."""
    return model.join(words.select("word_id").distinct(), "word_id", "left_semi")


def slice_requests(model: DataFrame, sliced: DataFrame) -> DataFrame:
    """``block_id, slice_id, word_id, topic, cnt``: the model rows that each slice of each block asks for.

    A word of a block meets its counts as one row; they are laid out after the join.
    """
    rows = model.groupBy("word_id").agg(F.collect_list(F.struct("topic", "cnt")).alias("e"))  # at most one entry per topic
    x = sliced.select("block_id", "slice_id", "word_id").join(rows, "word_id")
    return x.select("block_id", "slice_id", "word_id", F.inline("e"))
