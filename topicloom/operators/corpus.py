"""From documents to vocabulary, token table and blocks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicloom.functions import text as T
from topicloom.plans.lineage import BROADCAST_BYTES, bounded_batches, cut, dense_ids, lookup

#: Documents whose tokens a task holds, in expectation, where they are dealt by block.
DEALT = 4096


def tokenize(docs: DataFrame) -> DataFrame:
    """``doc_id, pos, word``; pos from 1.  Null and empty texts give no rows; a null id stays null, other columns are not read."""
    return docs.select("doc_id", F.posexplode(T.tokens(F.col("text"))).alias("at", "word")).select("doc_id", (F.col("at") + 1).alias("pos"), "word")


def term_frequency(docs: DataFrame) -> DataFrame:
    """``word, tf, df`` of ``text``: occurrences and documents (rows) of each word.

    A document's words are sorted in its row, where the first of each is marked, so one
    shuffle by word, of sums combined before it, is all.
    """
    sorted_ = docs.select(F.sort_array(T.tokens(F.col("text"))).alias("ws"))
    marked = F.transform("ws", lambda w, i: F.struct(w.alias("word"), F.when((i > 0) & (w == F.get("ws", i - 1)), 0).otherwise(1).alias("d")))
    x = sorted_.select(F.explode(marked).alias("x"))
    return x.groupBy(F.col("x.word").alias("word")).agg(F.count("*").alias("tf"), F.sum("x.d").alias("df"))


def word_counts(docs: DataFrame) -> DataFrame:
    """``word, tf`` alone: nothing is sorted or marked, words are counted as they are split."""
    return docs.select(F.explode(T.tokens(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("tf"))


def drop_stop_words(counts: DataFrame, words: Iterable[str] | DataFrame = T.STOP_WORDS) -> DataFrame:
    """Anti join with a stop-word list, which is small by nature."""
    spark = counts.sparkSession
    words = words if isinstance(words, DataFrame) else spark.createDataFrame([(w,) for w in sorted(set(words))], "word string")
    return counts.join(words, "word", "left_anti")


def vocabulary(counts: DataFrame, min_count: int) -> DataFrame:
    return counts.filter(F.col("tf") >= min_count)


def _shuffled(c: str, seed: int) -> Column:
    """What rows are ordered by in a seeded shuffle that SQL can repeat."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(c).cast("string")).cast("binary"))


def word_ids(vocab: DataFrame, shuffle_seed: int | None = None) -> DataFrame:
    """``word_id, word, tf`` and ``df`` if ``vocab`` has it; ids from 0 by falling tf, then word, or in a seeded shuffle."""
    order = [F.desc("tf"), F.asc("word")] if shuffle_seed is None else [_shuffled("word", shuffle_seed), F.asc("word")]
    return dense_ids(vocab, "word_id", *order).select(F.col("word_id").cast("int").alias("word_id"), "word", "tf", *[c for c in ("df",) if c in vocab.columns])


def dictionary_bytes(ids: DataFrame) -> int:
    """About what a task holds of a dictionary: its words, and so much a row."""
    return ids.select(F.sum(F.octet_length("word") + 48)).first()[0] or 0


def encode(docs: DataFrame, ids: DataFrame, max_tokens: int, most: int = BROADCAST_BYTES) -> DataFrame:
    """``doc_id, pos, word_id``: the first tokens of each document that have an id, pos from 1.

    Texts, not tokens, are dealt by document: words are looked up and cut where they are.
    Rows that repeat an id are one document, their tokens in turn by position.  A
    dictionary of more than ``most`` bytes is not broadcast: see ``_encode_by_block``.
    """
    if dictionary_bytes(ids) > most:
        lists = _encode_by_block(docs, ids, max_tokens)
        return lists.select("doc_id", F.explode(F.arrays_zip("pos", "words")).alias("t")).select("doc_id", "t.pos", F.col("t.words").alias("word_id"))
    kept = tokenize(docs.repartition("doc_id")).join(F.broadcast(ids.select("word", "word_id")), "word")
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos", "word_id"))
    return kept.withColumn("rank", rank).filter(F.col("rank") <= max_tokens).select("doc_id", F.col("rank").alias("pos"), "word_id")


def _dealt(docs: DataFrame) -> Column:
    """The block that a document is dealt to, to be encoded."""
    blocks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int").alias("block")


def known_words(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``block, word, word_id`` of the distinct words that have an id, of each block of documents."""
    asked = docs.select(_dealt(docs), F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("word")).distinct()
    return asked.join(ids.select("word", "word_id"), "word").select("block", "word", "word_id")


def _encode_by_block(docs: DataFrame, ids: DataFrame, max_tokens: int, known: DataFrame | None = None) -> DataFrame:
    """``doc_id, words, pos``: the first tokens of each document that have an id, by word id and place; pos from 1.

    Documents are dealt to blocks; a block's distinct words, not its tokens, look up their
    ids (``known``: ``known_words``, if the caller has stored them).  A word is asked for once
    by each block that has it, so no word is hot; its ids come to the block before the block's
    texts, which are dealt whole, and split and encoded in passing.
    """
    none = lambda t: F.lit(None).cast(t)
    kind = docs.schema["doc_id"].dataType.simpleString()
    known = known_words(docs, ids) if known is None else known
    known = known.select("block", F.lit(0).alias("kind"), "word", "word_id", none(kind).alias("doc_id"), none("string").alias("text"))
    texts = docs.select(_dealt(docs), F.lit(1).alias("kind"), none("string").alias("word"), none("int").alias("word_id"), "doc_id", "text")
    both = known.unionByName(texts).repartition("block").sortWithinPartitions("block", "kind", "doc_id")
    both = bounded_batches(both.select("block", "kind", "word", "word_id", "doc_id", T.tokens(F.col("text")).alias("words")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, words, ids_, held, done = None, [], [], [], []

        def end() -> None:
            """The document whose rows are held is done."""
            doc = held[0][0]
            pos, word = (np.concatenate([h[k] for h in held]) for k in (1, 2))
            held.clear()
            word = word[np.lexsort((word, pos))][:max_tokens]
            order = np.argsort(word, kind="stable")
            done.append((doc, word[order], order + 1))

        def emit() -> pa.RecordBatch:
            """The documents that are done, together: a batch has its price."""
            names, *lists = zip(*done, strict=True)
            done.clear()
            edges = pa.array(np.cumsum([0, *map(len, lists[0])]), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(names, out_type), *(pa.ListArray.from_arrays(edges, pa.array(np.concatenate(x), pa.int32())) for x in lists)], ["doc_id", "words", "pos"])

        for b in batches:
            out_type = b.schema.field("doc_id").type
            block, what = b.column("block").to_numpy(), b.column("kind").to_numpy()
            edge = [0, *(np.flatnonzero((block[1:] != block[:-1]) | (what[1:] != what[:-1])) + 1).tolist(), b.num_rows] if b.num_rows else []
            for lo, hi in zip(edge[:-1], edge[1:], strict=True):
                piece = b.slice(lo, hi - lo)
                if block[lo] != here:
                    if held:
                        end()
                    here, words, ids_ = block[lo], [], []
                if not what[lo]:
                    words.append(piece.column("word"))
                    ids_.append(piece.column("word_id").to_numpy())
                    continue
                table = pa.concat_arrays(words) if words else pa.array([], pa.string())
                number = np.concatenate(ids_) if ids_ else np.zeros(0, np.int32)
                tokens = piece.column("words")
                at = pc.index_in(tokens.flatten(), value_set=table).fill_null(-1).to_numpy()
                start = tokens.offsets.to_numpy()
                start = start - start[0]
                for i, doc in enumerate(piece.column("doc_id").to_pylist()):
                    if held and held[0][0] != doc:
                        end()
                    own = at[start[i] : start[i + 1]]
                    pos = np.flatnonzero(own >= 0)
                    held.append((doc, pos, number[own[pos]]))
            if done:
                yield emit()
        if held:
            end()
            yield emit()

    return both.mapInArrow(run, f"doc_id {kind}, words array<int>, pos array<int>")


def documents_with_tokens(docs: DataFrame, encoded: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, words`` (sorted by word id) of every document, empty ones too."""
    per = encoded.groupBy("doc_id").agg(F.sort_array(F.collect_list("word_id")).alias("words"))  # at most max_tokens each
    words = F.coalesce("words", F.array().cast("array<int>"))
    return docs.select("doc_id").join(per, "doc_id", "left").select("doc_id", F.size(words).alias("n_tokens"), words.alias("words"))


def doc_blocks(docs: DataFrame, block_size: int, shuffle_seed: int | None = None) -> DataFrame:
    """``doc_id, block_id``: runs of ``block_size`` documents in order; the last holds the rest."""
    order = [F.asc("doc_id")] if shuffle_seed is None else [_shuffled("doc_id", shuffle_seed), F.asc("doc_id")]
    x = dense_ids(docs.select("doc_id"), "at", *order)
    return x.select("doc_id", F.floor(F.col("at") / block_size).cast("int").alias("block_id"))


def _by_block(encoded: DataFrame, blocks: DataFrame, how: str) -> DataFrame:
    """``block_id, word_id`` of every token, dealt by block.

    There are as many partitions as hold about ``DEALT`` documents each, so what a task
    holds, to sort or to count, does not grow with the corpus; sums by block and word
    have no further exchange.
    """
    n = max(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-blocks.count() // DEALT))
    x = blocks.repartition(n, "doc_id").join(encoded.select("doc_id", "word_id").repartition(n, "doc_id"), "doc_id", how)
    return x.select("block_id", "word_id").repartition(n, "block_id")


def block_vocab(encoded: DataFrame, blocks: DataFrame, ids: DataFrame) -> DataFrame:
    """``block_id, word_id, global_tf, local_tf``; the local counts are after the cut."""
    local = _by_block(encoded, blocks, "inner").groupBy("block_id", "word_id").agg(F.count("*").alias("local_tf"))
    glob = ids.select("word_id", F.col("tf").alias("global_tf"))
    return local.join(lookup(glob, ids.count() * 24), "word_id").select("block_id", "word_id", "global_tf", "local_tf")


def block_stats(encoded: DataFrame, blocks: DataFrame) -> DataFrame:
    """``block_id, n_docs, n_tokens, n_words``."""
    x = _by_block(encoded, blocks, "left").groupBy("block_id", "word_id").agg(F.count("word_id").alias("n"))
    t = x.groupBy("block_id").agg(F.sum("n").alias("n_tokens"), F.count("word_id").alias("n_words"))
    return blocks.groupBy("block_id").agg(F.count("*").alias("n_docs")).join(t, "block_id")


def numbered_vocabulary(docs: DataFrame, cfg, stop_words=T.STOP_WORDS) -> DataFrame:
    """Vocabulary with ids, checkpointed."""
    return cut(word_ids(vocabulary(drop_stop_words(term_frequency(docs), stop_words), cfg.min_count)))


def prepare(docs: DataFrame, cfg, stop_words=T.STOP_WORDS) -> tuple[DataFrame, DataFrame]:
    """Vocabulary with ids, and encoded tokens, both checkpointed."""
    ids = numbered_vocabulary(docs, cfg, stop_words)
    return ids, cut(encode(docs, ids, cfg.max_tokens))
