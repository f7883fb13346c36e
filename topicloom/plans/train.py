"""Training by bulk-synchronous iterations, warm start from memory or disk, and fold-in inference."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from topicloom.config import Config, due
from topicloom.functions.mathx import draw_topic
from topicloom.operators import corpus as P
from topicloom.operators import counts as C
from topicloom.operators import report, sampler, stats
from topicloom.plans.lineage import BROADCAST_BYTES, cut, forget, remove, store


def pack(tokens: DataFrame, blocks: int = 1) -> DataFrame:
    """Token rows -> ``doc_id, block, words, topics``, tokens by word id; rows with a null id are left out."""
    one = F.struct("word_id", "pos", "topic")
    x = tokens.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.sort_array(F.collect_list(one)).alias("t"))  # a document's tokens are capped
    block = F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int").alias("block")
    return x.select("doc_id", block, F.col("t.word_id").alias("words"), F.col("t.topic").alias("topics"))


def started(corpus: DataFrame, ids: DataFrame, cfg: Config, most: int = BROADCAST_BYTES) -> tuple[DataFrame, str]:
    """What ``pack`` gives of the encoded texts with their first topics, stored, and its path.

    Texts are dealt by document once, and lists leave that stage: tokens are not stored row
    by row, nor shuffled to be packed.
    """
    corpus = corpus.filter(F.col("doc_id").isNotNull())
    if P.dictionary_bytes(ids) <= most:
        return store(pack(C.init_topics(P.encode(corpus, ids, cfg.max_tokens, most), cfg.topics, cfg.seed)), "docs")
    known = cut(P.known_words(corpus, ids))  # what led to it goes before the texts are dealt
    topics = F.transform("pos", lambda p: draw_topic(F.col("doc_id"), p, cfg.topics, cfg.seed))
    x = P._encode_by_block(corpus, ids, cfg.max_tokens, known).filter(F.size("words") > 0)
    out = store(x.select("doc_id", F.lit(0).alias("block"), "words", topics.alias("topics")), "docs")
    forget(known)
    return out


def unpack(docs: DataFrame) -> DataFrame:
    pairs = F.arrays_zip("words", "topics")
    return docs.select("doc_id", F.explode(pairs).alias("t")).select("doc_id", F.col("t.words").alias("word_id"), F.col("t.topics").alias("topic"))


def blocks_of(docs: DataFrame) -> int:
    """Blocks of documents: as many as the cluster has work for, fewer where documents are few."""
    return max(1, min(sampler.parts_of(docs.sparkSession), docs.count() // sampler.LEAST_BLOCK))


def by_word(counts: DataFrame) -> DataFrame:
    """Counts dealt by word; what is cut so keeps it, and joins and merges by word leave it where it is."""
    return counts.repartition(int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "word_id")


def changes(docs: DataFrame) -> DataFrame:
    """``word_id, topic, delta`` of the tokens that the last pass moved; zeros vanish."""
    if "n_moved" in docs.columns:  # ``swept`` rows: no list of moves need be made
        tokens = docs.filter("n_moved > 0").select(F.explode(F.arrays_zip("words", "moved", "topics")).alias("t"))
        moved = tokens.select(F.col("t.words").alias("word_id"), F.col("t.moved").cast("int").alias("topic"), F.col("t.topics").cast("int").alias("new_topic"))
    else:
        moved = docs.select(F.explode("moved").alias("m")).select("m.word_id", F.col("m.old").alias("topic"), F.col("m.new").alias("new_topic"))
    return C.sum_deltas(C.deltas(moved))


@dataclass
class Counts:
    """A model's counts: ``rows`` (cut) ``word_id, topic, cnt``, dealt by word, and the totals of all topics."""

    rows: DataFrame
    totals: np.ndarray

    @classmethod
    def of(cls, rows: DataFrame, topics: int) -> Counts:
        out = cls(cut(by_word(rows), dealt=True), np.zeros(topics, np.int64))
        out._add(C.topic_summary_of(out.rows))
        return out

    def _add(self, by_topic: DataFrame) -> None:
        for r in by_topic.collect():  # a row per topic
            self.totals[r[0]] += r[1]

    def after(self, docs: DataFrame) -> Counts:
        """With what the last pass changed: only changed pairs of word and topic are shuffled, the rows stay where they are."""
        delta = cut(by_word(changes(docs)), dealt=True)
        out = Counts(cut(C.apply_deltas(self.rows, delta), dealt=True), self.totals.copy())
        out._add(C.sum_summary_deltas(delta))
        forget(delta)
        return out

    def send(self, cfg: Config, n_words: int) -> Broadcast:
        """What all words share; the caller destroys it."""
        return self.rows.sparkSession.sparkContext.broadcast(sampler.Shared(self.totals, n_words, cfg.alpha, cfg.beta))


@dataclass
class Model:
    cfg: Config
    ids: DataFrame
    docs: DataFrame
    n_words: int
    metrics: list[dict]
    done: int = 0
    counts: Counts | None = field(default=None, repr=False)
    _sent: Broadcast | None = field(default=None, repr=False)

    def word_topic(self) -> DataFrame:
        return self.frozen().rows

    def topic_words(self, top: int | None = None) -> DataFrame:
        return report.topic_words(self.word_topic(), self.ids, top)

    def log_likelihood(self, mode: str = "reference") -> dict[str, float]:
        return stats.corpus_llh(unpack(self.docs), self.cfg.topics, self.cfg, self.n_words, mode)

    def frozen(self) -> Counts:
        """The model's counts, made once however often they are asked for."""
        if self.counts is None:
            self.counts = Counts.of(C.word_topic(unpack(self.docs)), self.cfg.topics)
        return self.counts

    def transform(self, docs: DataFrame, iterations: int = 10) -> DataFrame:
        """``doc_id, topic, cnt`` of other documents against the frozen model.

        The result is cut; ``lineage.forget`` removes its files once it has been read.
        """
        m = self.frozen()
        if self._sent is None:
            self._sent = m.send(self.cfg, self.n_words)  # once for the model's life
        enc = cut(P.encode(docs, self.ids, self.cfg.max_tokens))
        x = cut(pack(C.init_topics(enc, self.cfg.topics, self.cfg.seed), blocks_of(enc.select("doc_id").distinct())))
        forget(enc)
        asked = cut(by_word(sampler.requests(x)), dealt=True)
        for it in range(iterations):
            rows, rest = sampler.swept(x, asked, m.rows, self._sent, self.cfg.seed, it, self.cfg.mh_steps, "infer")
            new = cut(rows.select("doc_id", "block", "words", "topics"))
            if rest:
                remove(docs.sparkSession, rest)
            forget(x)
            x = new
        out = cut(C.doc_topic(unpack(x)))
        forget(asked)
        forget(x)
        return out

    def save(self, path: str) -> None:
        """Vocabulary, documents with their topics, counts and state, each under a new path."""
        self.ids.write.mode("errorifexists").parquet(f"{path}/ids")
        self._commit(path)

    def _commit(self, path: str) -> None:
        self.docs.select("doc_id", "block", "words", "topics").write.mode("overwrite").parquet(f"{path}/docs")
        self.word_topic().write.mode("overwrite").parquet(f"{path}/counts")
        state = json.dumps({"cfg": asdict(self.cfg), "n_words": self.n_words, "done": self.done, "metrics": self.metrics})
        self.docs.sparkSession.createDataFrame([(state,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/state")  # last: what has a state is whole

    @classmethod
    def load(cls, spark: SparkSession, path: str, ids: str | None = None) -> Model:
        state = json.loads(spark.read.text(f"{path}/state").first()["value"])
        cfg = Config(**state["cfg"])
        words, docs = (cut(spark.read.parquet(p)) for p in (ids or f"{path}/ids", f"{path}/docs"))
        counts = Counts.of(spark.read.parquet(f"{path}/counts"), cfg.topics)
        return cls(cfg, words, docs, state["n_words"], state["metrics"], state["done"], counts)


class Log:
    """Committed iterations of a run under a folder: ``it=n`` is whole once its state, written last, is.

    The last two are kept, so one that is being written never replaces the only one.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._folder = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._folder.getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def iterations(self) -> list[int]:
        """Whole iterations, in order."""
        if not self._fs.exists(self._folder):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(self._folder)]
        found = [int(n.removeprefix("it=")) for n in names if n.startswith("it=")]
        return sorted(n for n in found if self._fs.exists(self._at(f"it={n}/state/_SUCCESS")))

    def begin(self, ids: DataFrame) -> None:
        ids.write.mode("overwrite").parquet(f"{self.path}/ids")

    def commit(self, m: Model) -> None:
        m._commit(f"{self.path}/it={m.done}")
        for old in self.iterations()[:-2]:
            self._fs.delete(self._at(f"it={old}"), True)

    def recover(self) -> Model | None:
        """The model of the last whole iteration, to ``resume`` from; None if there is none."""
        whole = self.iterations()
        return Model.load(self.spark, f"{self.path}/it={whole[-1]}", f"{self.path}/ids") if whole else None


def fit(corpus: DataFrame | None, cfg: Config, resume: Model | None = None, on_dump: Callable[[int, DataFrame], None] | None = None, log: str | None = None) -> Model:
    """Train on ``doc_id, text``; ``resume`` goes on from an earlier model and equals an unbroken run.

    An iteration samples every document against the counts of the last one, to which it
    then adds what it changed.  Each is checkpointed, so lineage stays short and a lost
    executor costs one iteration's tasks at most; the state before the last is removed
    as soon as the next one, or its first slice, is stored.
    With ``log``, a folder, each iteration is committed there, too, and ``Log.recover``
    gives the last whole one after the driver is lost.
    Documents of a block are sampled together with the model rows of its words.
    With ``cfg.staleness`` n an iteration samples against the counts of n iterations
    before the last, or the oldest of this run; a resumed run starts with fresh ones.
    What an iteration changed is then counted while the next one samples.
    """
    if resume is not None:
        ids, docs, n_words, done, metrics, counts = resume.ids, resume.docs, resume.n_words, resume.done, list(resume.metrics), resume.frozen()
        path = None  # its documents are not this run's to remove
    else:
        ids = P.numbered_vocabulary(corpus, cfg)
        docs, path = started(corpus, ids, cfg)
        n_words, done, metrics = ids.count(), 0, []
        docs = docs.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks_of(docs))).cast("int"))
        counts = Counts.of(C.word_topic(unpack(docs)), cfg.topics)
    spark = docs.sparkSession
    written = Log(spark, log) if log else None
    if written and resume is None:
        written.begin(ids)
    asked, given = cut(by_word(sampler.requests(docs)), dealt=True), counts if resume is not None else None
    # One counting after the other, beside the sampling if that need not wait for it.
    counting = ThreadPoolExecutor(1)
    after = lambda before, new: counting.submit(inheritable_thread_target(spark)(lambda: before.result().after(new)))
    snapshots = [counting.submit(lambda: counts)]
    model = Model(cfg, ids, docs, n_words, metrics, done, counts)

    def over() -> None:
        """The documents before this pass go."""
        nonlocal path
        snapshots[-1].result()  # has read them
        if path:
            remove(spark, path)
            path = None

    for it in range(done, done + cfg.iterations):
        began = time.monotonic()
        old, seen = snapshots[0].result(), Observation()
        sent = old.send(cfg, n_words)
        rows, rest = sampler.swept(docs, asked, old.rows, sent, cfg.seed, it, cfg.mh_steps, over=over)
        rows, stored = store(rows.observe(seen, F.sum("by_word").alias("by_word"), F.sum("by_doc").alias("by_doc"), F.sum(F.size("words")).alias("tokens"), F.sum("n_moved").alias("moved")), "docs")
        sent.destroy()
        if rest:
            remove(spark, rest)
        over()
        new, path = sampler.told(rows), stored
        snapshots.append(after(snapshots[-1], rows))
        if len(snapshots) > cfg.staleness + 1 and (gone := snapshots.pop(0).result()) is not given:
            snapshots[0].result()  # has read the counts that go
            forget(gone.rows)
        docs, got = new, {k: v or 0 for k, v in seen.get.items()}
        row = {"iteration": it, "seconds": time.monotonic() - began, "tokens": got["tokens"], "moved": got["moved"]}
        proposed = max(1, got["tokens"] * cfg.mh_steps)
        row |= {"tokens_per_s": row["tokens"] / row["seconds"], "accepted_word": got["by_word"] / proposed, "accepted_doc": got["by_doc"] / proposed}
        if due(it, cfg.llh_every):
            row |= stats.corpus_llh(unpack(docs), cfg.topics, cfg, n_words)
        metrics.append(row)
        if written or on_dump and due(it, cfg.dump_every) or it + 1 == done + cfg.iterations:
            last = snapshots[-1].result()
            model = Model(cfg, ids, docs, n_words, metrics, it + 1, last)
        if written:
            written.commit(model)
        if on_dump and due(it, cfg.dump_every):
            on_dump(it, model.word_topic())
    for m in snapshots[:-1]:
        if m.result() is not given:
            forget(m.result().rows)
    counting.shutdown()
    forget(asked)
    return model
