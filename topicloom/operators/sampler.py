"""Metropolis-Hastings sampling of topics, vectorised across the documents of a batch.

Given the counts of the last iteration documents are independent.  All documents
that have a token at rank r take their step for it together.  Draws are a hash of
(seed, iteration, document, rank, draw), so a retried task repeats itself and
neither the layout of documents nor of the model changes a result.

The model is sparse: rows ``word_id, topic, cnt``.  A word's proposal has two parts: its
own topics with mass n_tw / (n_t + V beta), and a part that all words share,
beta / (n_t + V beta); each has its alias table.  The model is cut in slices of words,
which visit the blocks of documents in turn; a block builds the tables of a slice's
rows and lets its documents pass.  There are as many blocks as the cluster has work for,
whatever the number of documents, so what is sent grows with the model, not with them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.operators.alias import CHUNK, Tables
from topicloom.plans.lineage import bounded_batches, remove, store

DOCS = 4096
#: Documents of a block at least, in expectation, and blocks for each task that runs at once at most.
LEAST_BLOCK, PARTS = 256, 4
#: Entries of model rows that a slice has, and a block holds; a word is never split.
MAX_ENTRIES = 4_000_000
#: Cells of the dense topic counts of a batch of documents; with more topics they are counted as needed.
MAX_CELLS = 8_000_000
#: Counts of a slice's rows are looked up by place, not searched, if topics are at most so many times the entries of a word.
DENSE = 4
_U, _MASK = np.uint64, np.uint64(0xFFFFFFFF)
MULTIPLIER = 73244475
#: Draws of a step: own or shared, column, stay, accept; place, prior, topic, accept; the chunk's column and stay.
DRAWS = 16


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 32-bit values, held in 64 bits, one to one."""
    for _ in range(2):
        x = ((x ^ (x >> _U(16))) * _U(MULTIPLIER)) & _MASK
    return x ^ (x >> _U(16))


def document_hash(seed: int, iteration: int, doc: np.ndarray) -> np.ndarray:
    d = np.asarray(doc).astype(np.uint64)
    h = mixed(np.full(d.shape, seed & 0xFFFFFFFF, np.uint64))
    h = mixed(h ^ _U(iteration & 0xFFFFFFFF))
    return mixed(mixed(h ^ (d & _MASK)) ^ (d >> _U(32)))


def uniform(h: np.ndarray, draw: int) -> np.ndarray:
    """In [0, 1), from a token's hash and the number of the draw."""
    return mixed(h ^ _U(draw)) * 2.0**-32


class Shared:
    """What all words share: topic totals, and the part of the proposal that beta gives every topic."""

    def __init__(self, nt: np.ndarray, n_words: int, alpha: float, beta: float):
        self.nt, self.alpha, self.beta, self.vb = nt.astype(np.float64), alpha, beta, n_words * beta
        self.table = Tables(beta / (self.nt + self.vb), np.array([0, len(nt)]))
        self.mass = self.table.mass[0]


class Rows:
    """Model rows of some words: ``words``, sorted, and where the entries of each start; topics sorted in a word."""

    def __init__(self, words: np.ndarray, start: np.ndarray, topics: np.ndarray, cnts: np.ndarray, s: Shared):
        self.words, self.topics, self.k = words, topics, len(s.nt)
        self.table = Tables(cnts / (s.nt[topics] + s.vb), start)
        self.mass = np.append(self.table.mass, 0.0)  # a word without a row has its last
        key, self.dense = np.repeat(np.arange(len(words)), np.diff(start)) * self.k + topics, None
        if len(words) * self.k <= DENSE * len(cnts):
            self.dense = np.zeros((len(words) + 1) * self.k)  # a word without a row, place -1, has the last
            self.dense[key] = cnts
        else:
            self.key = np.append(key, np.iinfo(np.int64).max)
            self.cnt = np.append(cnts, 0).astype(np.float64)

    @classmethod
    def of(cls, word: np.ndarray, topic: np.ndarray, cnt: np.ndarray, s: Shared) -> Rows:
        """From entries sorted by word and topic."""
        at = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(word) else np.zeros(0, np.int64)
        return cls(word[at], np.append(at, len(word)), topic.astype(np.int64), cnt, s)

    def place(self, word: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.full(len(word), -1)
        at = np.minimum(np.searchsorted(self.words, word), len(self.words) - 1)
        return np.where(self.words[at] == word, at, -1)

    def count(self, row: np.ndarray, topic: np.ndarray) -> np.ndarray:
        wanted = row * self.k + topic
        if self.dense is not None:
            return self.dense[wanted]
        at = np.searchsorted(self.key, wanted)
        return np.where((self.key[at] == wanted) & (row >= 0), self.cnt[at], 0.0)

    def propose(self, s: Shared, row: np.ndarray, u: list[np.ndarray]) -> np.ndarray:
        """A topic by the word's own entries or by the shared part, each through its alias table; ``u``: part, column, stay, and, if a table has ``many``, a chunk's."""
        mass = self.mass[row]
        own = u[0] * (mass + s.mass) < mass
        out = np.empty(len(row), np.int64)
        for rest, table, of in ((~own, s.table, None), (own, self.table, self.topics)):
            i = np.flatnonzero(rest)
            if len(i):
                at = table.draw(np.zeros(len(i), np.int64) if of is None else row[i], *(x[i] for x in u[1:]))
                out[i] = at if of is None else of[at]
        return out


class Batch:
    """Documents whose tokens are sampled together; passes over the words come in order."""

    def __init__(self, ids, words: list[np.ndarray], topics: list[np.ndarray], k: int):
        self.order = np.argsort([-len(w) for w in words], kind="stable")
        self.size = np.array([len(words[i]) for i in self.order], np.int64)
        n, self.k = len(self.order), k
        self.longest = int(self.size.max(initial=0))
        self.w, self.z = np.full((n, self.longest), -1, np.int32), np.full((n, self.longest), -1, np.int32)
        self.nd = np.zeros((n, k), np.int32) if n * k <= MAX_CELLS else None
        for r, i in enumerate(self.order):
            self.w[r, : self.size[r]], self.z[r, : self.size[r]] = words[i], topics[i]
            if self.nd is not None:
                self.nd[r] = np.bincount(topics[i], minlength=k)
        self.before = self.z.copy()
        self.doc = np.asarray(ids, np.int64)[self.order]
        self.moves = np.zeros((n, 2), np.int64)

    def count(self, live: np.ndarray, topic: np.ndarray) -> np.ndarray:
        return self.nd[live, topic] if self.nd is not None else (self.z[live] == topic[:, None]).sum(1)

    def sweep(self, s: Shared, rows: Rows, first: int, last: int, seed: int, iteration: int, steps: int, kind: str = "train") -> None:
        """Sample the tokens of words from ``first`` to before ``last``.

        ``kind``: train; infer samples against a model that does not hold the documents, so
        own tokens are not excluded from its counts; chain leaves a document's counts and
        topics as they were for its other tokens; propose takes one word proposal as it is.
        """
        hashes = document_hash(seed, iteration, self.doc)
        needs = (0, 1, 2, 8, 9) if s.table.many or rows.table.many else (0, 1, 2)
        for r in range(self.longest):
            live = np.arange(np.searchsorted(-self.size, -r, side="left"))
            live = live[(self.w[live, r] >= first) & (self.w[live, r] < last)]
            if not len(live):
                continue
            row, old, h = rows.place(self.w[live, r]), self.before[live, r].astype(np.int64), mixed(hashes[live] ^ _U(r))
            cur, total = old.copy(), self.size[live]
            for step in range(steps):
                u = lambda j: uniform(h, step * DRAWS + j)  # noqa: E731, B023
                t = rows.propose(s, row, [u(j) for j in needs])
                if kind == "propose":
                    cur = t
                    break
                before = cur
                cur = self._accept(s, rows, live, row, old, cur, t, u(3), True, kind == "infer")
                self.moves[live, 0] += cur != before
                before = cur
                pick = self.z[live, np.minimum((u(4) * total).astype(np.int64), total - 1)]
                t = np.where(u(5) < total / (total + s.alpha * self.k), pick, np.minimum((u(6) * self.k).astype(np.int64), self.k - 1))
                cur = self._accept(s, rows, live, row, old, cur, t, u(7), False, kind == "infer")
                self.moves[live, 1] += cur != before
            if kind in ("chain", "propose"):
                self.before[live, r] = cur  # ``z`` keeps what the other tokens see
                continue
            if self.nd is not None:
                self.nd[live, old] -= 1  # each document once
                self.nd[live, cur] += 1
            self.z[live, r] = cur

    def _accept(self, s, rows, live, row, old, cur, t, u, by_word, infer):
        """Ratio of targets without the token itself, times the inverse ratio of proposals with it.

        Counts of an older snapshot need not hold the token where it is now; none falls below zero.
        """
        own_s, own_t = (0, 0) if infer else ((cur == old).astype(float), (t == old).astype(float))
        a, b, vb = s.alpha, s.beta, s.vb
        nd_s, nd_t, nw_s, nw_t = self.count(live, cur), self.count(live, t), rows.count(row, cur), rows.count(row, t)
        up = (nd_t - own_t + a) * (np.maximum(nw_t - own_t, 0) + b) * (np.maximum(s.nt[cur] - own_s, 0) + vb)
        down = (nd_s - own_s + a) * (np.maximum(nw_s - own_s, 0) + b) * (np.maximum(s.nt[t] - own_t, 0) + vb)
        if by_word:
            up, down = up * (nw_s + b) * (s.nt[t] + vb), down * (nw_t + b) * (s.nt[cur] + vb)
        else:
            up, down = up * (nd_s + a), down * (nd_t + a)
        return np.where(u * down < up, t, cur)

    def topics(self, kind: str = "train") -> list[np.ndarray]:
        z = self.before if kind in ("chain", "propose") else self.z
        out: list[np.ndarray] = [None] * len(self.order)  # type: ignore[list-item]
        for r, i in enumerate(self.order):
            out[i] = z[r, : self.size[r]]
        return out

    def changed(self) -> np.ndarray:
        """How many tokens of each document changed, in the order given."""
        n = np.empty(len(self.order), np.int64)
        n[self.order] = (self.before != self.z).sum(1)
        return n

    def accepted(self) -> np.ndarray:
        """Accepted word and document proposals by document, in the order given."""
        out = np.empty_like(self.moves)
        out[self.order] = self.moves
        return out


def shared(summary: DataFrame, topics: int, n_words: int, alpha: float, beta: float) -> Shared:
    nt = np.zeros(topics, np.int64)
    for r in summary.collect():  # one row per topic
        nt[r["topic"]] = r["cnt"]
    return Shared(nt, n_words, alpha, beta)


def own_tables(model: DataFrame, s: Shared) -> DataFrame:
    """``word_id, topic, size, stay, alias_topic`` of every entry's place in its word's table (rows of one chunk each).

    A word's entries are together and sorted; those of a batch's last word wait for the next.
    """
    sent = model.sparkSession.sparkContext.broadcast(s)  # a few numbers per topic
    names = ["word_id", "topic", "size", "stay", "alias_topic"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def emit(word, topic, cnt) -> pa.RecordBatch:
            rows = Rows.of(word, topic, cnt, sent.value)
            t = rows.table
            if (t.chunks > 1).any():
                raise ValueError("a word has several chunks")
            chunk = np.repeat(np.arange(len(t.size)), t.size)
            cols = word, topic, t.size[chunk], t.threshold / t.total[chunk], topic[t.start[chunk] + t.alias]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names)

        for b in batches:
            if b.num_rows:
                held.append(tuple(b.column(c).to_numpy() for c in ("word_id", "topic", "cnt")))
                word, topic, cnt = (np.concatenate(x) for x in zip(*held, strict=True))
                n = int(np.searchsorted(word, word[-1]))
                held = [(word[n:], topic[n:], cnt[n:])]
                if n:
                    yield emit(word[:n], topic[:n], cnt[:n])
        if held:
            yield emit(*held[0])

    x = bounded_batches(model.filter("cnt <> 0").select("word_id", "topic", "cnt").repartition("word_id").sortWithinPartitions("word_id", "topic"))
    return x.mapInArrow(run, "word_id int, topic int, size long, stay double, alias_topic int")


def requests(docs: DataFrame) -> DataFrame:
    """``block, word_id``: the words of each block of documents."""
    return docs.select("block", F.explode(F.array_distinct("words")).alias("word_id")).distinct()


def slices(model: DataFrame, most: int) -> list[tuple[int, int]]:
    """Ranges of words, from the first to before the last, that cover all, of about ``most`` model rows at most.

    A row is an entry, so quantiles of the word over the rows cut the entries evenly; a
    word is in one range, however many entries it has.
    """
    n = -(-model.count() // most)
    cuts = model.approxQuantile("word_id", [i / n for i in range(1, n)], 0.1 / n) if n > 1 else []
    edges = [0, *sorted({int(c) + 1 for c in cuts}), 1 << 31]
    return list(zip(edges[:-1], edges[1:], strict=True))


def sample(docs: DataFrame, asked: DataFrame, model: DataFrame, sent: Broadcast, seed: int, iteration: int, steps: int, kind: str = "train", most: int = MAX_ENTRIES) -> DataFrame:
    """``doc_id, block, words, topics, drawn, moved, by_word, by_doc`` after one pass over all tokens.

    ``docs``: ``doc_id, block, words, topics``, words sorted; ``asked``: ``requests``;
    ``model``: ``word_id, topic, cnt``; ``sent``: a broadcast ``Shared``, the caller's to
    destroy.  ``moved`` has word, old and new topic of the tokens that changed; ``by_word``
    and ``by_doc`` count accepted moves.  ``kind`` as in ``Batch.sweep``; chain and propose
    leave ``topics`` and put what they draw in ``drawn``.

    Slices of the model (``slices``) visit the blocks in turn.  A block holds a slice and
    lets its documents pass, a batch at a time, so what it holds does not grow with them,
    and a model row is sent once to each block that has its word.
    """
    return told(swept(docs, asked, model, sent, seed, iteration, steps, kind, most)[0])


def swept(docs: DataFrame, asked: DataFrame, model: DataFrame, sent: Broadcast, seed: int, iteration: int, steps: int, kind: str = "train", most: int = MAX_ENTRIES, over: Callable[[], None] | None = None) -> tuple[DataFrame, str | None]:
    """What ``sample`` tells, as small as it is sent and stored; and files that it rests on, if any, to be removed after.

    Beside its topics a document has, as ``moved``, those that its tokens had before (a chain
    or proposals: none, ``topics`` are these), and how many differ, ``n_moved``.  Topics take
    a byte where that will do.  ``over`` is called when ``docs`` are not read any more, if
    that is before the last slice.
    """
    ranges, spark = slices(model, most), docs.sparkSession
    topics = F.col("topics").cast(f"array<{_topic_type(len(sent.value.nt))}>")
    empty, zero = F.slice(topics, 1, 0), F.lit(0).cast("long")
    drawn, before = (topics, empty) if kind in ("chain", "propose") else (empty, topics)
    sums = [zero.alias(c) for c in ("n_moved", "by_word", "by_doc")]
    x, path = docs.select("doc_id", "block", "words", topics.alias("topics"), drawn.alias("drawn"), before.alias("moved"), *sums), None
    for i, (first, last) in enumerate(ranges):
        own = (F.col("word_id") >= first) & (F.col("word_id") < last)
        new = _visit(x, asked.filter(own), model.filter(own), sent, first, last, seed, iteration, steps, kind)
        if i == len(ranges) - 1:
            return new, path
        earlier = path
        x, path = store(new, "swept")
        if earlier:
            remove(spark, earlier)
        elif over:
            over()
    raise AssertionError


def told(rows: DataFrame) -> DataFrame:
    """What ``sample`` returns, from ``swept`` rows."""
    drew = F.size("drawn") > 0
    old, new = F.when(drew, F.col("topics")).otherwise(F.col("moved")), F.when(drew, F.col("drawn")).otherwise(F.col("topics"))
    pairs = F.filter(F.arrays_zip(F.col("words").alias("word_id"), old.alias("old"), new.alias("new")), lambda t: t["old"] != t["new"])
    wide = [F.col(c).cast("array<int>").alias(c) for c in ("topics", "drawn")]
    return rows.select("doc_id", "block", "words", *wide, pairs.cast("array<struct<word_id:int,old:int,new:int>>").alias("moved"), "by_word", "by_doc")


def _topic_type(topics: int) -> str:
    return "tinyint" if topics <= 1 << 7 else "smallint" if topics <= 1 << 15 else "int"


def _visit(docs: DataFrame, asked: DataFrame, model: DataFrame, sent: Broadcast, first: int, last: int, seed: int, iteration: int, steps: int, kind: str) -> DataFrame:
    """One slice of the model, words from ``first`` to before ``last``, visits all blocks."""
    # Lists that a row has none of are empty, not null: with a bound on bytes Spark's Arrow
    # writer fills in all the null lists of a batch anew at each row.
    none = lambda t: (F.array() if t.startswith("array") else F.lit(None)).cast(t)
    kinds = dict(docs.dtypes)
    out = ["doc_id", "block", "words", "topics", "drawn", "moved", "n_moved", "by_word", "by_doc"]
    number = _topic_type(len(sent.value.nt))
    held = docs.select("block", F.lit(1).alias("kind"), F.col("doc_id").alias("id"), none("int").alias("chunk"), none("array<long>").alias("cnts"), *out[2:])
    # Entries of a word go in rows of up to CHUNK topics, which is the order they are sorted by below.
    chunk = F.floor(F.col("topic") / CHUNK).cast("int").alias("chunk")
    packed = model.groupBy("word_id", chunk).agg(F.sort_array(F.collect_list(F.struct("topic", "cnt"))).alias("e"))
    packed = packed.select("word_id", "chunk", F.col("e.topic").alias("topics"), F.col("e.cnt").alias("cnts"))
    pulled = asked.join(packed, "word_id").select("block", F.lit(0).alias("kind"), F.col("word_id").cast("long").alias("id"), "chunk", "cnts", *[F.col(c).cast(kinds[c]).alias(c) if c == "topics" else none(kinds[c]).alias(c) for c in out[2:]])
    plain = {"tinyint": np.int8, "smallint": np.int16, "int": np.int32}[number]

    def lists(x: list[np.ndarray]) -> pa.ListArray:
        flat = np.concatenate(x) if x else np.zeros(0)
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, x)]), pa.int32()), pa.array(flat.astype(plain)))

    def sampled(b: pa.RecordBatch, rows: Rows) -> pa.RecordBatch:
        flat = [(b.column(c).offsets.to_numpy(), b.column(c).flatten().to_numpy()) for c in ("words", "topics", "drawn")]
        words, topics, drawn = ([v[o[i] - o[0] : o[i + 1] - o[0]] for i in range(b.num_rows)] for o, v in flat)
        g = Batch(b.column("id").to_numpy(), words, topics, len(sent.value.nt))
        g.sweep(sent.value, rows, first, last, seed, iteration, steps, kind)
        new, by = g.topics(kind), np.column_stack([g.changed(), g.accepted()])
        if kind in ("chain", "propose"):  # what this slice has drawn, beside what others have
            drawn, new = [np.where((w >= first) & (w < last), t, d) for w, t, d in zip(words, new, drawn, strict=True)], topics
        sums = [pa.array(b.column(c).to_numpy() + by[:, k]) for k, c in enumerate(out[6:])]
        return pa.RecordBatch.from_arrays([b.column("id"), b.column("block"), b.column("words"), lists(new), lists(drawn), b.column("moved"), *sums], out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, parts, rows = None, [], None
        for b in batches:
            if not b.num_rows:
                continue
            here, what = b.column("block").to_numpy(), b.column("kind").to_numpy()
            edge = [0, *(np.flatnonzero((here[1:] != here[:-1]) | (what[1:] != what[:-1])) + 1).tolist(), b.num_rows]
            for lo, hi in zip(edge[:-1], edge[1:], strict=True):
                if here[lo] != block:
                    block, parts, rows = here[lo], [], None
                piece = b.slice(lo, hi - lo)
                if not what[lo]:
                    topics, cnts = piece.column("topics"), piece.column("cnts").flatten().to_numpy()
                    parts.append((np.repeat(piece.column("id").to_numpy(), np.diff(topics.offsets.to_numpy())), topics.flatten().to_numpy(), cnts))
                    continue
                if rows is None:
                    rows = Rows.of(*((np.concatenate(c) for c in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 3), sent.value)
                    parts = []
                for at in range(0, piece.num_rows, DOCS):
                    yield sampled(piece.slice(at, DOCS), rows)

    x = held.unionByName(pulled).repartition(parts_of(docs.sparkSession), "block").sortWithinPartitions("block", "kind", "id", "chunk")
    return bounded_batches(x).mapInArrow(run, ", ".join(f"{c} {'long' if c == 'doc_id' else kinds[c]}" for c in out))


def parts_of(spark: SparkSession) -> int:
    """Partitions of blocks: some for each task that runs at once, so that they even out."""
    return PARTS * spark.sparkContext.defaultParallelism
