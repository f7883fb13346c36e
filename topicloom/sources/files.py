"""Text files in, tables and text files out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Buckets of a block store.
BUCKETS = 64


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, path, text``: one document per regular file, empty ones too, not recursive; ids by hash of the path.

    Spark reads no files without bytes, so these are listed; names that start with a dot
    or an underscore are no documents.
    """
    x = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(path).select("path", F.decode("content", "UTF-8").alias("text"))
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    listed = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)
    bare = [(f.getPath().toString(), "") for f in listed if f.isFile() and not f.getLen() and f.getPath().getName()[0] not in "._"]
    both = x.unionByName(spark.createDataFrame(bare, "path string, text string"))
    return both.select(F.xxhash64("path").alias("doc_id"), "path", "text")


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """Stop words of a file, separated by white space, as they are written."""
    return spark.read.text(path).select(F.explode(F.split("value", r"\s+")).alias("word")).filter("word <> ''").distinct()


def write_dictionary(ids: DataFrame, path: str) -> None:
    """``id word tf`` by line."""
    ids.select("word_id", "word", "tf").write.mode("errorifexists").csv(path, sep=" ")


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("word_id int, word string, tf long").csv(path, sep=" ")


def write_blocks(tokens: DataFrame, blocks: DataFrame, path: str) -> None:
    """Token table by block; a new path for every state, so a reader never sees half of one."""
    tokens.join(blocks, "doc_id").repartition("block_id").sortWithinPartitions("block_id", "doc_id").write.mode("errorifexists").partitionBy("block_id").parquet(path)


def read_block(spark: SparkSession, path: str, block_id: int | None = None) -> DataFrame:
    x = spark.read.parquet(path)
    return x if block_id is None else x.filter(F.col("block_id") == block_id)


def store_blocks(rows: DataFrame, table: str, buckets: int = BUCKETS, path: str | None = None) -> None:
    """``rows`` with a ``block_id`` as a bucketed table, sorted by block in each bucket.

    However many blocks there are, there are ``buckets`` files a task at most; tables with
    as many buckets are joined by block, and summed by it, without a shuffle.
    """
    sort = [c for c in ("block_id", "doc_id", "word_id", "pos") if c in rows.columns]
    out = rows.repartition(buckets, "block_id").write.mode("errorifexists").format("parquet").bucketBy(buckets, "block_id").sortBy(*sort)
    (out.option("path", path) if path else out).saveAsTable(table)


def stored_blocks(spark: SparkSession, table: str, block_id: int | None = None) -> DataFrame:
    """A bucketed table, or one block of it, for which one bucket is read."""
    x = spark.table(table)
    return x if block_id is None else x.filter(F.col("block_id") == block_id)


def write_block_vocab(vocab: DataFrame, path: str) -> None:
    """Vocabulary by block: a table for reading back under ``table``, lines to look at under ``text``."""
    x = vocab.select("block_id", "word_id", "global_tf", "local_tf").repartition("block_id").sortWithinPartitions("block_id", "word_id")
    x.write.mode("errorifexists").partitionBy("block_id").parquet(f"{path}/table")
    x.select("block_id", F.concat_ws(" ", "word_id", "global_tf", "local_tf").alias("line")).write.mode("errorifexists").partitionBy("block_id").text(f"{path}/text")


def read_block_vocab(spark: SparkSession, path: str, block_id: int | None = None) -> DataFrame:
    x = spark.read.parquet(f"{path}/table")
    return x if block_id is None else x.filter(F.col("block_id") == block_id)


def write_dict_meta(meta: DataFrame, path: str) -> None:
    """Layouts by client, rows by word."""
    meta.repartition("client_id").sortWithinPartitions("client_id", "word_id").write.mode("errorifexists").partitionBy("client_id").parquet(path)


def read_dict_meta(spark: SparkSession, path: str, client_id: int | None = None) -> DataFrame:
    x = spark.read.parquet(path)
    return x if client_id is None else x.filter(F.col("client_id") == client_id)


def write_lines(lines: DataFrame, path: str) -> None:
    lines.select("line").write.mode("errorifexists").text(path)


def count_documents(path_df: DataFrame) -> int:
    """Documents of a file with one per line; empty lines do not count."""
    return path_df.filter("value <> ''").count()
