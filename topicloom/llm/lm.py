"""Scores of whole documents by a gated recurrent language model trained on the corpus.

Words are hashed once, where a text is read, and numbered within blocks of texts.  Only a
block's distinct words are shuffled: their counts are summed over all training documents,
looked up by hash, and sent back to the block, whose documents then become symbols.

The most frequent words are symbols of their own, all others are classes by the binary
logarithm of their count; a class's probability is the network's (``gru``), a word's share
of it its share of the class's counts.  Words that training has not seen belong to the
class of those seen once, with the share that Good and Turing's estimate gives them.

Training is one pass over all training documents in ``ROUNDS`` rounds: every task goes on
from the same network over its documents, and the networks are averaged by symbols, ``FAN``
at a time.  Nothing but the network, of fixed size, and a few counts reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.llm import gru
from topicloom.llm.common import bounded_batches, cut, forget, lean, send
from topicloom.llm.langid import _texts
from topicloom.llm.shingles import word_hashes

#: Words with vectors of their own, and how many share a class of the output.
FREQUENT, PER_CLASS = 1024, 32
#: Bytes of the texts whose words are numbered together.
BLOCK_BYTES = 16 << 20
#: Entries of a block's vocabulary in a row.
CHUNK = 8192
ROUNDS = 2
#: Networks that a task averages.
FAN = 16
#: Symbols of the documents that are in a task's memory together; a longer document is alone.
SYMBOLS = 2_000_000
END = 0x5EED0FE17D0C5EED
HELD_OUT, OF = 1, 5


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training; a null id counts as empty."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(OF)) == HELD_OUT


def hashed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of each text, its end last, and where texts start and end among them."""
    data, start = _texts(column)
    words, before = word_hashes(data[start[0] : start[-1]], start - start[0])
    edges = before + np.arange(len(start))
    out = np.empty(edges[-1], np.uint64)
    ends = edges[1:] - 1
    out[ends] = np.uint64(END)
    inner = np.ones(len(out), bool)
    inner[ends] = False
    out[inner] = words
    return out, edges


def _index(kind: pa.DataType):
    """Rows of documents (kind 1, ``at`` their number) and of vocabularies (kind 0, ``at`` the first word's) by block."""
    names = ["block", "kind", "at", "doc_id", "held_out", "ids", "words", "counts"]
    types = [pa.int64(), pa.int32(), pa.int32(), kind, pa.bool_(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32())]

    def rows(n: int, **have) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([have[c].cast(t) if c in have else pa.nulls(n, t) for c, t in zip(names, types, strict=True)], names)

    def flush(block: int, held: list) -> Iterator[pa.RecordBatch]:
        words = np.concatenate([w for _, _, w, _ in held])
        codes, distinct = pd.factorize(words)
        codes = codes.astype(np.int32)
        learns = np.concatenate([np.repeat(~np.asarray(h, bool), np.diff(e)) for _, h, _, e in held])
        counts = np.bincount(codes[learns], minlength=len(distinct)).astype(np.int32)
        first = number = 0
        for ids, out, w, edges in held:
            own = codes[first : first + len(w)]
            pack = zstandard.ZstdCompressor(1).compress
            texts = [pack(own[lo:hi]) for lo, hi in zip(edges[:-1], edges[1:], strict=True)]
            n = len(texts)
            yield rows(n, block=pa.array(np.full(n, block)), kind=pa.array(np.ones(n, np.int32)), at=pa.array(np.arange(number, number + n)), doc_id=ids, held_out=pa.array(out), ids=pa.array(texts, pa.binary()))
            first, number = first + len(w), number + n
        for lo in range(0, len(distinct), CHUNK * 16):
            part = [distinct[i : i + CHUNK].view(np.int64) for i in range(lo, min(lo + CHUNK * 16, len(distinct)), CHUNK)]
            seen = [counts[i : i + CHUNK] for i in range(lo, min(lo + CHUNK * 16, len(distinct)), CHUNK)]
            n = len(part)
            yield rows(n, block=pa.array(np.full(n, block)), kind=pa.array(np.zeros(n, np.int32)), at=pa.array(np.arange(n) * CHUNK + lo), words=pa.array(part, pa.list_(pa.int64())), counts=pa.array(seen, pa.list_(pa.int32())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, held, size = TaskContext.get().partitionId() << 32, [], 0
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                piece = b.slice(lo, 1024)
                w, edges = hashed(piece.column(2))
                held.append((piece.column(0), np.asarray(piece.column(1).to_pylist()), w, edges))
                size += piece.column(2).nbytes
                if size >= BLOCK_BYTES:
                    yield from flush(block, held)
                    block, held, size = block + 1, [], 0
        if held:
            yield from flush(block, held)

    return run


class Symbols:
    """From words' hashes and counts to symbols and to the logarithm of a word's share of its class."""

    def __init__(self, top: list[tuple[int, int]], bins: dict[int, tuple[int, int]], twice: int):
        """``top``: hash and count of the frequent words, in order; ``bins``: words and tokens of the others, by class."""
        hashes = np.array([h for h, _ in top], np.int64)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        self.n_top, self.n_bins = len(top), max(bins, default=0) + 1
        self.tokens = np.array([bins.get(b, (0, 0))[1] for b in range(self.n_bins)], float)
        once = bins.get(0, (0, 0))[0]
        unseen = (once + 1) / (once + 2 * twice + 2) if once else 1.0
        self.unseen, self.once = np.log(unseen), np.log((1 - unseen) / once) if once else 0.0
        self.counts = np.concatenate([[c for _, c in top], self.tokens])

    def of(self, words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rank = np.maximum(counts, 1).astype(float)
        bins = np.frexp(rank)[1] - 1
        bins = np.minimum(bins, self.n_bins - 1)
        symbol = self.n_top + bins
        share = np.log(rank / np.maximum(self.tokens[bins], 1))
        share = np.where(bins == 0, np.where(counts > 0, self.once, self.unseen), share)
        if self.n_top:
            at = np.minimum(np.searchsorted(self.hashes, words), self.n_top - 1)
            top = self.hashes[at] == words
            symbol = np.where(top, self.order[at], symbol)
            share = np.where(top, 0.0, share)
        return symbol.astype(np.uint16), share


def _encode(kind: pa.DataType, symbols: Symbols, total: int, distinct: int):
    names = ["doc_id", "held_out", "round", "n_tokens", "n_known", "base_score", "share", "symbols"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, parts, table, number = None, [], None, 0
        for b in batches:
            here, what = b.column("block").to_numpy(), b.column("kind").to_numpy()
            edge = [0, *(np.flatnonzero((here[1:] != here[:-1]) | (what[1:] != what[:-1])) + 1).tolist(), b.num_rows] if b.num_rows else []
            for lo, hi in zip(edge[:-1], edge[1:], strict=True):
                piece = b.slice(lo, hi - lo)
                if here[lo] != block:
                    block, parts, table = here[lo], [], None
                if not what[lo]:
                    parts.append((piece.column("word").to_numpy(), piece.column("n").to_numpy()))
                    continue
                if table is None:
                    words, n = (np.concatenate(x) for x in zip(*parts, strict=True))
                    symbol, share = symbols.of(words, n)
                    table = symbol, share, n > 0, np.log10((n + 0.5) / (total + 0.5 * (distinct + 1)))
                symbol, share, known, base = table
                unpack = zstandard.ZstdDecompressor().decompress
                codes = [np.frombuffer(unpack(x), np.int32) for x in piece.column("ids").to_pylist()]
                size = len(codes)
                cols = [
                    piece.column("doc_id"), piece.column("held_out"), pa.array((np.arange(number, number + size) % ROUNDS).astype(np.int32)), pa.array([len(c) for c in codes], pa.int64()),
                    pa.array([int(known[c].sum()) for c in codes], pa.int64()), pa.array([float(base[c].sum()) for c in codes]), pa.array([float(share[c].sum()) for c in codes]),
                    pa.array([symbol[c].tobytes() for c in codes], pa.binary()),
                ]
                number += size
                yield pa.RecordBatch.from_arrays(cols, names)

    return run


def encode(docs: DataFrame, frequent: int = FREQUENT) -> tuple[DataFrame, Symbols, int]:
    """``doc_id, held_out, round, n_tokens, n_known, base_score, share, symbols`` (cut) of ``doc_id, held_out, text``, the symbols, and training tokens."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"block long, kind int, at int, doc_id {kind}, held_out boolean, ids binary, words array<long>, counts array<int>"
    source = bounded_batches(docs.select("doc_id", "held_out", F.coalesce("text", F.lit("")).alias("text")))
    arrow = _arrow(source, "doc_id")
    indexed = cut(source.mapInArrow(lean(_index(arrow)), schema))
    entries = indexed.filter("kind = 0").select("block", "at", F.posexplode(F.arrays_zip("words", "counts")).alias("i", "e"))
    entries = entries.select("block", (F.col("at") + F.col("i")).alias("at"), F.col("e.words").alias("word"), F.col("e.counts").alias("seen"))
    counts = cut(entries.filter("seen > 0").groupBy("word").agg(F.sum("seen").alias("n")))
    top = [(r["word"], r["n"]) for r in counts.orderBy(F.desc("n"), "word").limit(frequent).collect()]
    by_bin = counts.groupBy(F.floor(F.log2("n") + 1e-12).cast("int").alias("bin"), (F.col("n") == 2).alias("two")).agg(F.count("*").alias("words"), F.sum("n").alias("tokens")).collect()  # a few rows
    bins: dict[int, list[int]] = {}
    for r in by_bin:
        b = bins.setdefault(r["bin"], [0, 0])
        b[0], b[1] = b[0] + r["words"], b[1] + r["tokens"]
    total, distinct = sum(t for _, t in bins.values()), sum(w for w, _ in bins.values())
    for _, n in top:
        bins[n.bit_length() - 1][0] -= 1
        bins[n.bit_length() - 1][1] -= n
    twice = sum(r["words"] for r in by_bin if r["two"]) - sum(n == 2 for _, n in top)
    symbols = Symbols(top, {b: (w, t) for b, (w, t) in bins.items() if w}, twice)
    none = lambda t: F.lit(None).cast(t)
    words = entries.join(counts, "word", "left").select("block", F.lit(0).alias("kind"), "at", "word", F.coalesce("n", F.lit(0)).cast("long").alias("n"), none(kind).alias("doc_id"), none("boolean").alias("held_out"), none("binary").alias("ids"))
    texts = indexed.filter("kind = 1").select("block", "kind", "at", none("long").alias("word"), none("long").alias("n"), "doc_id", "held_out", "ids")
    both = bounded_batches(words.unionByName(texts).repartition("block").sortWithinPartitions("block", "kind", "at"))
    out = f"doc_id {kind}, held_out boolean, round int, n_tokens long, n_known long, base_score double, share double, symbols binary"
    encoded = cut(both.mapInArrow(lean(_encode(arrow, symbols, total, distinct)), out))
    forget(indexed)
    forget(counts)
    return encoded, symbols, total


def _arrow(df: DataFrame, name: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[name].dataType)


def _groups(batches: Iterator[pa.RecordBatch], most: int = SYMBOLS) -> Iterator[tuple[list[np.ndarray], list[pa.RecordBatch]]]:
    """Documents of symbols and their batches, about ``most`` symbols together."""
    docs, held, size = [], [], 0
    for b in batches:
        if not b.num_rows:
            continue
        new = [np.frombuffer(x, np.uint16) for x in b.column("symbols").to_pylist()]
        docs += new
        held.append(b)
        size += sum(map(len, new))
        if size >= most:
            yield docs, held
            docs, held, size = [], [], 0
    if held:
        yield docs, held


def train(encoded: DataFrame, net: gru.Network, rounds: int = ROUNDS) -> gru.Network:
    """The network after one pass over the training documents; it is returned as it was if there are none."""
    spark = encoded.sparkSession
    out = "part long, weight double, vector binary"
    names = ["part", "weight", "vector"]

    def mean(rows: list[tuple[int, float, bytes]]) -> tuple[float, np.ndarray]:
        whole, vector = sum(w for _, w, _ in rows), np.zeros(1)
        for _, w, v in sorted(rows, key=lambda r: r[0]):
            vector = vector + np.frombuffer(v, np.float32).astype(float) * (w / whole)
        return whole, vector.astype(np.float32)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [tuple(r[c] for c in names) for b in batches for r in b.to_pylist()]
        for part in sorted({r[0] // FAN for r in rows}):
            whole, vector = mean([r for r in rows if r[0] // FAN == part])
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([whole]), pa.array([vector.tobytes()], pa.binary())], names)

    for k in range(rounds):
        sent = send(spark, net)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            own, seen = sent.value.copy(), 0
            tops = own.squares()
            for docs, _ in _groups(batches):
                seen += gru.train(own, docs, tops)
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([float(seen)]), pa.array([own.vector().tobytes()], pa.binary())], names)

        states = cut(bounded_batches(encoded.filter(~F.col("held_out") & (F.col("round") == k)).select("symbols")).mapInArrow(lean(run), out))
        while (n := states.count()) > FAN:
            smaller = cut(states.repartition(max(1, -(-n // FAN)), F.floor(F.col("part") / FAN)).mapInArrow(lean(merge), out))
            forget(states)
            states = smaller
        rows = [tuple(r) for r in states.collect()]
        forget(states)
        if rows:
            net = net.copy()
            net.take(mean(rows)[1])
    return net


def score(encoded: DataFrame, net: gru.Network, total: int) -> DataFrame:
    kind = encoded.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    sent = send(encoded.sparkSession, net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs, held in _groups(batches):
            found, at = gru.score(sent.value, docs), 0
            for b in held:
                own = (found[at : at + b.num_rows] + b.column("share").to_numpy()) / np.log(10)
                at += b.num_rows
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names[:4]), pa.array(np.full(b.num_rows, total)), b.column("base_score"), pa.array(own)], names)

    x = bounded_batches(encoded.select("doc_id", "held_out", "n_tokens", "n_known", "base_score", "share", "symbols"))
    return x.mapInArrow(lean(run), f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def score_documents(docs: DataFrame, frequent: int = FREQUENT, per_class: int = PER_CLASS, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row of ``doc_id, text``.

    A null or empty text is its end alone; repeated rows count and are scored again; a
    null id is trained on; other columns are not read; an empty table gives no rows.
    Without training documents all words are unknown and every score is 0.
    """
    x = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    encoded, symbols, total = encode(x, frequent)
    net = gru.Network(symbols.n_top, symbols.n_bins, per_class, symbols.counts)
    return score(encoded, train(encoded, net, rounds), total)
