import math
import time
from collections import defaultdict
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from topicloom.config import Config, due, load_config, parse_params
from topicloom.functions import mathx as M
from topicloom.functions import text as T
from topicloom.operators import corpus as P
from topicloom.operators import counts as C
from topicloom.operators import planning, report, sampler, stats
from topicloom.operators.alias import CHUNK, Tables, table_mass
from topicloom.plans import lineage
from topicloom.plans.lineage import dense_ids
from topicloom.plans.train import Counts, Log, Model, by_word, changes, fit, pack, started, unpack
from topicloom.sources import files
from topicloom.streaming.infer import infer_stream

TEXTS = ["", None, "the cat don't_stop È", "cat dog cat dog bird", "dog  dog\tcat--bird", "bird cat dog fish " * 10, "of the and"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")


def test_tokenize_is_ascii(docs):
    got = [r.word for r in P.tokenize(docs).filter("doc_id = 2").orderBy("pos").collect()]
    assert got == ["the", "cat", "don", "t", "stop", "È"]


def test_vocabulary_boundary_and_stop_words(docs):
    tf = P.term_frequency(docs)
    counts = {r.word: (r.tf, r.df) for r in tf.collect()}
    assert counts["fish"] == (10, 1) and counts["the"] == (2, 2)
    assert {r.word for r in P.vocabulary(P.drop_stop_words(tf), 10).collect()} == {"cat", "dog", "bird", "fish"}
    assert {r.word for r in P.vocabulary(P.drop_stop_words(tf), 11).collect()} == {"cat", "dog", "bird"}


def test_cut_after_join_and_empty_documents(docs):
    cfg = Config(min_count=10, max_tokens=7)
    ids, enc = P.prepare(docs, cfg)
    n = {r.doc_id: r.n_tokens for r in P.documents_with_tokens(docs, enc).collect()}
    assert n == {0: 0, 1: 0, 2: 1, 3: 5, 4: 4, 5: 7, 6: 0}
    assert sorted(r.word_id for r in ids.collect()) == list(range(ids.count()))


@pytest.mark.parametrize("n,size", [(10, 5), (11, 5), (3, 5)])
def test_blocks(spark, n, size):
    b = P.doc_blocks(spark.range(n).withColumnRenamed("id", "doc_id"), size).groupBy("block_id").count().collect()
    assert sorted(r["count"] for r in b) == sorted([size] * (n // size) + ([n % size] if n % size else []))


def test_dense_ids_in_order(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("x"))
    rows = dense_ids(df, "i", F.asc("x")).orderBy("x").collect()
    assert [r.i for r in rows] == list(range(5000))


def test_log_gamma_and_powers(spark):
    xs = [0.01, 0.5, 1.0, 1.85, 10.0, 1e6]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(M.log_gamma(F.col("x"))).collect()]
    assert all(abs(a - math.lgamma(x)) < 1e-7 * max(1, abs(math.lgamma(x))) for a, x in zip(got, xs, strict=True))
    p = [r[0] for r in spark.range(0, 70).select(M.next_power_of_two(F.col("id"))).collect()]
    assert p == [1 if x < 2 else 1 << (x - 1).bit_length() for x in range(70)]


def test_deltas_conserve(docs):
    _, enc = P.prepare(docs, Config(min_count=2))
    moved = C.init_topics(enc, 4, 1).withColumn("new_topic", M.draw_topic(F.col("doc_id"), F.col("pos"), 4, 99991))
    after = C.apply_deltas(C.word_topic(moved), C.sum_deltas(C.deltas(moved)))
    direct = C.word_topic(moved.withColumn("topic", F.col("new_topic")))
    assert after.exceptAll(direct).isEmpty() and direct.exceptAll(after).isEmpty()


def test_slices_roll_over_and_refuse_large_words(spark):
    sizes = spark.createDataFrame([(0, w, 4, 1, 1) for w in range(10)], "block_id int, word_id int, model_size long, alias_size long, delta_size long")
    got = {r.word_id: r.slice_id for r in planning.slices(sizes, 8, 99, 99).collect()}
    assert got == {w: w // 2 for w in range(10)}
    with pytest.raises(Exception, match="exceeds a slice"):
        planning.slices(sizes, 3, 99, 99).collect()


@pytest.mark.parametrize("sizes", [[37] * 50, [100] * 3, range(1, 60), [1, CHUNK, CHUNK + 1, 5 * CHUNK + 3, 2]])
def test_alias_tables_keep_the_mass(sizes):
    """Rows of equal and of all lengths, and rows of several chunks; weights of 40 bits."""
    rng = np.random.default_rng(1)
    start = np.concatenate([[0], np.cumsum(list(sizes))])
    mass = rng.gamma(0.1, size=start[-1]) + 1e-9
    t = Tables(mass, start)
    got = table_mass(t)
    for i, (lo, hi) in enumerate(zip(start[:-1], start[1:], strict=True)):
        assert np.allclose(got[lo:hi], mass[lo:hi] / mass[lo:hi].sum(), rtol=1e-6, atol=1e-11) and t.mass[i] == pytest.approx(mass[lo:hi].sum(), rel=1e-9)
    assert (t.threshold <= np.repeat(t.total, t.size)).all() and (t.threshold >= 0).all()


def rows_of(nw, s, words):
    """Model rows of a dense count matrix."""
    w, t = np.nonzero(nw)
    return sampler.Rows.of(np.asarray(words)[w], t, nw[w, t], s)


def test_a_word_with_a_million_topics(spark):
    """Its chunks are drawn by their mass; it is sampled in pieces of the model smaller than it."""
    k = 1_000_000
    rng = np.random.default_rng(10)
    s = sampler.Shared(np.full(k, 50), 10, 0.1, 0.01)
    cnt = np.where(np.arange(k) < 1000, 400, 1)
    rows = sampler.Rows.of(np.full(k, 3), np.arange(k), cnt, s)
    assert len(rows.table.size) == -(-k // CHUNK)
    row = rows.place(np.full(100_000, 3))
    t = rows.propose(s, row, list(rng.random((5, len(row)))))
    own = (cnt / (s.nt + s.vb)).sum()
    assert (t < 1000).mean() == pytest.approx((400 * 1000 / 50.1 + 1000 * 0.01 / 50.1) / (own + s.mass), rel=0.03)
    model = spark.range(k).select(F.lit(3).alias("word_id"), F.col("id").cast("int").alias("topic"), F.when(F.col("id") < 1000, 400).otherwise(1).cast("long").alias("cnt"))
    docs = spark.createDataFrame([(1, 0, [3, 3, 5], [7, 8, 9])], "doc_id long, block int, words array<int>, topics array<int>")
    sent = spark.sparkContext.broadcast(s)
    got = [sampler.sample(docs, sampler.requests(docs), model, sent, 1, 0, 4, most=n).first().topics for n in (sampler.MAX_ENTRIES, 400_000)]
    assert got[0] == got[1] and len(got[0]) == 3


def test_proposal_has_both_parts():
    """Drawn topics follow (n_tw + beta) / (n_t + V beta), also for a word without a row."""
    rng = np.random.default_rng(4)
    nw = rng.poisson(0.8, (3, 20)) * rng.integers(0, 9, (3, 20))
    s = sampler.Shared(nw.sum(0) + 1, 50, 0.1, 0.3)
    rows, n = rows_of(nw, s, [5, 6, 9]), 200_000
    for word, counts in ((6, nw[1]), (7, np.zeros(20))):
        row = rows.place(np.full(n, word))
        got = np.bincount(rows.propose(s, row, list(rng.random((5, n)))), minlength=20) / n
        want = (counts + 0.3) / (s.nt + 50 * 0.3)
        assert np.abs(got - want / want.sum()).max() < 0.005
        assert rows.count(row[:20], np.arange(20)).tolist() == counts.tolist()


@pytest.mark.parametrize("kind", ["train", "infer"])
def test_a_sweep_leaves_the_target_distribution(kind, monkeypatch):
    """One token, many chains: topics follow the target, with counts held densely and counted as needed."""
    rng = np.random.default_rng(5)
    nw, k, a, b = rng.integers(1, 9, (4, 6)), 6, 0.3, 0.2
    s = sampler.Shared(nw.sum(0) + 5, 4, a, b)
    docs = [(np.array([2]), np.array([int(rng.integers(k))])) for _ in range(30_000)]
    for cells in (10**9, 0):
        monkeypatch.setattr(sampler, "MAX_CELLS", cells)
        rest = np.array([3, 3, 3]), np.array([1, 1, 4])  # tokens of a word that is not swept
        batch = sampler.Batch(np.arange(len(docs)), [np.concatenate([w, rest[0]]) for w, _ in docs], [np.concatenate([z, rest[1]]) for _, z in docs], k)
        batch.sweep(s, rows_of(nw, s, range(4)), 0, 3, 1, 1, 60, kind)
        got = batch.topics(kind)
        assert all((z[1:] == rest[1]).all() for z in got)
        if kind == "train":  # the model's counts hold the token in its old topic
            first = [z for (_, (o,)), z in zip(docs, got, strict=True) if o == 2]
            want = (np.bincount(rest[1], minlength=k) + a) * (nw[2] - (np.arange(k) == 2) + b) / (s.nt - (np.arange(k) == 2) + s.vb)
            assert np.abs(np.bincount([z[0] for z in first], minlength=k) / len(first) - want / want.sum()).max() < 0.025


def test_many_topics_and_chunks_of_the_model(spark):
    """A million cells per document batch are not held; chunks and blocks change no result."""
    rng = np.random.default_rng(6)
    texts = [(i, " ".join(f"w{rng.integers(300)}" for _ in range(60))) for i in range(80)]
    m = fit(spark.createDataFrame(texts, "doc_id long, text string"), Config(min_count=1, topics=10_000, iterations=1))
    assert unpack(m.docs).count() == 80 * 60 and unpack(m.docs).agg(F.max("topic")).first()[0] > 5000
    sent, got = m.frozen().send(m.cfg, m.n_words), []
    for blocks, entries in ((1, 10**9), (7, 2000)):
        docs = m.docs.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int"))
        out = sampler.sample(docs, sampler.requests(docs), m.word_topic(), sent, 42, 1, 2, most=entries)
        got.append(sorted((r.doc_id, r.topics, r.by_word, r.by_doc, sorted(r.moved)) for r in out.collect()))
    assert got[0] == got[1] and len(got[0]) == 80
    assert len(sampler.slices(m.word_topic(), 50)) > 20 and sampler.slices(m.word_topic(), 10**9) == [(0, 1 << 31)]
    drawn = [sorted((r.doc_id, r.topics, r.drawn) for r in sampler.sample(m.docs, sampler.requests(m.docs), m.word_topic(), sent, 42, 1, 2, "chain", n).collect()) for n in (10**9, 2000)]
    assert drawn[0] == drawn[1] and any(t != d for _, t, d in drawn[0])


def test_model_rows_sent_do_not_grow_with_documents(spark):
    """Twice the documents, as many blocks: each of them is sent a word's rows once."""
    rng = np.random.default_rng(15)
    text = lambda: " ".join(f"w{rng.integers(30)}" for _ in range(40))
    most = sampler.parts_of(spark)
    sent = []
    for n in (most * sampler.LEAST_BLOCK // 8, most * sampler.LEAST_BLOCK // 4):
        docs = spark.createDataFrame([(i, text()) for i in range(n)], "doc_id long, text string")
        ids, enc = P.prepare(docs, Config(min_count=1))
        packed = pack(C.init_topics(enc, 4, 1), most // 8)
        sent.append(sampler.requests(packed).count())
    assert sent[0] == sent[1] == 30 * (most // 8)


def test_no_null_lists_go_to_the_sampler(spark, monkeypatch):
    """Spark's Arrow writer takes time with the square of a batch's rows over them."""
    seen = []
    monkeypatch.setattr(sampler, "bounded_batches", lambda df: seen.append(df) or df)
    docs = spark.createDataFrame([(1, 0, [3, 4], [0, 1])], "doc_id long, block int, words array<int>, topics array<int>")
    model = spark.createDataFrame([(3, 0, 2), (3, 1, 1), (4, 1, 5)], "word_id int, topic int, cnt long")
    sent = spark.sparkContext.broadcast(sampler.Shared(np.full(2, 9), 10, 0.1, 0.01))
    assert sampler.sample(docs, sampler.requests(docs), model, sent, 1, 0, 2).count() == 1
    lists = [c for c, t in seen[0].dtypes if t.startswith("array")]
    assert {"words", "topics", "drawn", "moved"} <= set(lists) and seen[0].filter(" or ".join(f"{c} is null" for c in lists)).isEmpty()


def test_counts_by_place_equal_searched_ones(monkeypatch):
    rng = np.random.default_rng(6)
    nw = rng.poisson(0.7, (30, 8))
    s, words = sampler.Shared(nw.sum(0) + 1, 50, 0.1, 0.3), np.arange(30) * 3
    placed = rows_of(nw, s, words)
    monkeypatch.setattr(sampler, "DENSE", 0)
    searched = rows_of(nw, s, words)
    assert placed.dense is not None and searched.dense is None
    row, topic = placed.place(rng.integers(0, 100, 5000)), rng.integers(0, 8, 5000)
    assert (row < 0).any() and (placed.count(row, topic) == searched.count(row, topic)).all()


def test_resume_from_disk_equals_an_unbroken_run(spark, tmp_path):
    rng = np.random.default_rng(7)
    docs = spark.createDataFrame([(i, " ".join(f"w{rng.integers(40)}" for _ in range(30))) for i in range(40)] + [(None, "w1 w2")], "doc_id long, text string")
    cfg = Config(min_count=1, topics=3, iterations=2)
    fit(docs, cfg).save(str(tmp_path / "m"))
    back = Model.load(spark, str(tmp_path / "m"))
    assert back.cfg == cfg and back.done == 2 and len(back.metrics) == 2
    two, four = fit(None, cfg, resume=back), fit(docs, Config(min_count=1, topics=3, iterations=4))
    assert [m["iteration"] for m in two.metrics] == [0, 1, 2, 3] and two.done == four.done == 4
    assert unpack(two.docs).exceptAll(unpack(four.docs)).isEmpty() and two.docs.count() == 40
    assert unpack(back.docs).count() == 40 * 30  # what was loaded stands
    assert all(0 < m["accepted_word"] < 1 and 0 < m["accepted_doc"] < 1 for m in two.metrics)


def test_counts_follow_what_moved(spark):
    """After each pass they equal a recount, and neither they nor what asks for them is shuffled."""
    rng = np.random.default_rng(11)
    docs = spark.createDataFrame([(i, " ".join(f"w{rng.integers(50)}" for _ in range(40))) for i in range(50)], "doc_id long, text string")
    for n in (1, 3):
        m = fit(docs, Config(min_count=1, topics=4, iterations=n))
        recount = C.word_topic(unpack(m.docs))
        assert recount.exceptAll(m.word_topic()).isEmpty() and m.word_topic().exceptAll(recount).isEmpty()
        assert m.counts.totals.tolist() == [r.cnt for r in C.topic_summary(unpack(m.docs)).orderBy("topic").collect()]
        assert sum(x["moved"] for x in m.metrics) > 0 and all(x["tokens"] == 2000 for x in m.metrics)
    delta, asked = (lineage.cut(by_word(x), dealt=True) for x in (changes(m.docs), sampler.requests(m.docs)))
    for x in (C.apply_deltas(m.counts.rows, delta), asked.hint("merge").join(m.counts.rows, "word_id")):
        assert "Exchange" not in x._jdf.queryExecution().toString()
    same = Counts(m.counts.rows, m.counts.totals).after(m.docs.withColumn("moved", F.slice("moved", 1, 0)))
    assert same.rows.exceptAll(m.counts.rows).isEmpty()


def test_a_run_survives_its_driver(spark, tmp_path):
    """It stops in the third iteration; what was committed goes on to where an unbroken run arrives."""
    rng = np.random.default_rng(12)
    docs = spark.createDataFrame([(i, " ".join(f"w{rng.integers(30)}" for _ in range(30))) for i in range(40)], "doc_id long, text string")
    cfg, path = Config(min_count=1, topics=3, iterations=4, dump_every=1), str(tmp_path / "log")

    def lost(it, _):
        if it == 2:
            raise KeyboardInterrupt

    log = Log(spark, path)
    assert log.recover() is None
    with pytest.raises(KeyboardInterrupt):
        fit(docs, cfg, log=path, on_dump=lost)
    assert log.iterations() == [2, 3]
    (tmp_path / "log/it=4").mkdir()  # one that was begun
    back = log.recover()
    assert back.done == 3 and len(back.metrics) == 3
    rest, whole = fit(None, replace(cfg, iterations=1), resume=back, log=path), fit(docs, cfg)
    assert rest.done == whole.done == 4 and log.iterations() == [3, 4]
    assert unpack(rest.docs).exceptAll(unpack(whole.docs)).isEmpty() and rest.word_topic().exceptAll(whole.word_topic()).isEmpty()


def test_stale_snapshots(spark):
    """The second iteration samples against the first one's counts; no token is lost."""
    rng = np.random.default_rng(9)
    docs = spark.createDataFrame([(i, " ".join(f"w{rng.integers(30)}" for _ in range(30))) for i in range(30)], "doc_id long, text string")
    cfg = Config(min_count=1, topics=3, iterations=1, staleness=1)
    one, stale, fresh = fit(docs, cfg), fit(docs, replace(cfg, iterations=3)), fit(docs, replace(cfg, iterations=3, staleness=0))
    assert unpack(stale.docs).count() == 900 and not unpack(stale.docs).exceptAll(unpack(fresh.docs)).isEmpty()
    assert unpack(one.docs).exceptAll(unpack(fit(docs, replace(cfg, staleness=0)).docs)).isEmpty()


def test_stream_is_folded_in(spark, tmp_path):
    rng = np.random.default_rng(8)
    docs = spark.createDataFrame([(i, " ".join(f"w{rng.integers(20)}" for _ in range(30))) for i in range(20)], "doc_id long, text string")
    m = fit(docs, Config(min_count=1, topics=3, iterations=1))
    docs.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
    q = infer_stream(stream, m, str(tmp_path / "out"), str(tmp_path / "cp"), 2, {"availableNow": True})
    assert q.awaitTermination(120) and q.exception() is None
    got = spark.read.parquet(str(tmp_path / "out")).groupBy("doc_id").agg(F.sum("cnt").alias("n")).collect()
    assert {r.doc_id: r.n for r in got} == {i: 30 for i in range(20)}


def test_training_keeps_little_on_disk(spark, monkeypatch):
    """Shuffle files go as soon as what they led to is stored; a pass in slices holds two copies of the documents, of few bytes a token."""
    from pathlib import Path

    rng = np.random.default_rng(16)
    docs = spark.createDataFrame([(i, " ".join(f"w{int(rng.exponential(300))}" for _ in range(200))) for i in range(1000)], "doc_id long, text string")
    folder, whole = Path(lineage.shared_folder(spark).removeprefix("file:")), sampler.slices
    local = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    shuffled = lambda: {p for d in local for p in Path(d).rglob("shuffle_*")}
    held = lambda: {p.parent for p in folder.rglob("part-*")}
    monkeypatch.setattr(sampler, "slices", lambda model, most: whole(model, 1500))
    most, visit, before = [], sampler._visit, held()

    def visited(*given):
        most.append(sum(p.stat().st_size for d in held() - before for p in d.glob("part-*")))
        return visit(*given)

    monkeypatch.setattr(sampler, "_visit", visited)
    ran = shuffled()
    m = fit(docs, Config(min_count=1, topics=8, iterations=1))
    assert len(most) > 2 and max(most) < 200_000 * 8
    rest = held() - before
    assert sum(d.name.startswith(("docs-", "swept-")) for d in rest) == 1
    assert sum(p.stat().st_size for d in rest if d.name.startswith("docs-") for p in d.glob("part-*")) < 200_000 * 4
    lineage.forget(lineage.cut(docs.groupBy("doc_id").count()))
    for _ in range(50):  # files go beside what is done next
        if sum(p.exists() and p.suffix == ".data" for p in shuffled() - ran) < 20:
            break
        time.sleep(0.1)
    else:
        raise AssertionError("shuffle files stay")
    assert unpack(m.docs).count() == 200_000 and m.metrics[0]["moved"] == m.docs.select(F.explode("moved")).count() > 0


@pytest.mark.parametrize("kind", ["train", "chain"])
def test_moves_are_told_from_topics(spark, kind):
    rng = np.random.default_rng(18)
    docs = spark.createDataFrame([(i, 0, sorted(rng.integers(0, 9, 30).tolist()), rng.integers(0, 200, 30).tolist()) for i in range(20)], "doc_id long, block int, words array<int>, topics array<int>")
    model = C.word_topic(unpack(docs))
    sent = spark.sparkContext.broadcast(sampler.shared(C.topic_summary_of(model), 200, 9, 0.1, 0.01))
    got = sampler.sample(docs, sampler.requests(docs), model, sent, 1, 0, 2, kind, 300)
    assert dict(got.dtypes)["moved"] == "array<struct<word_id:int,old:int,new:int>>"
    first = {r.doc_id: r.topics for r in docs.collect()}
    for r in got.collect():
        now = r.drawn if kind == "chain" else r.topics
        assert [tuple(m) for m in r.moved] == [x for x in zip(r.words, first[r.doc_id], now, strict=True) if x[1] != x[2]] != []


def test_training_starts_alike_with_any_dictionary(spark):
    rng = np.random.default_rng(17)
    rows = [(i % 50 if i % 9 else None, " ".join(f"w{int(rng.exponential(20))}" for _ in range(rng.integers(0, 30)))) for i in range(120)]
    df, cfg = spark.createDataFrame([*rows, (500, None), (501, "w1 w2 " * 400)], "doc_id long, text string"), Config(min_count=3, max_tokens=40, topics=5)
    ids, enc = P.prepare(df, cfg)
    want, names = pack(C.init_topics(enc, 5, cfg.seed)).collect(), ["doc_id", "words", "topics"]
    for most in (lineage.BROADCAST_BYTES, 0):
        got, path = started(df, ids, cfg, most)
        assert sorted(tuple(r[c] for c in names) for r in got.collect()) == sorted(tuple(r[c] for c in names) for r in want)
        lineage.remove(spark, path)


def test_transforming_leaves_no_files(spark):
    from pathlib import Path

    docs = spark.createDataFrame([(i, "x y z x y") for i in range(20)], "doc_id long, text string")
    m = fit(docs, Config(min_count=1, topics=3, iterations=1))
    folder = Path(lineage.shared_folder(spark).removeprefix("file:"))
    held = lambda: {str(p) for p in folder.rglob("rdd-*")}
    m.frozen()
    before = held()
    for _ in range(3):
        got = m.transform(docs, 2)
        assert got.agg(F.sum("cnt")).first()[0] == 100
        lineage.forget(got)
    assert held() == before


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace as N

    empty = N(isEmpty=lambda: True)
    session = N(sparkContext=N(_jsc=N(sc=lambda: N(getCheckpointDir=lambda: empty)), master="spark://x"), conf=N(get=lambda *_: None))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        lineage.shared_folder(session)


def test_files(spark, tmp_path, docs):
    """Every sink read back, and the directory and word readers."""
    at = lambda name: str(tmp_path / name)
    (tmp_path / "docs").mkdir()
    for i, text in enumerate(["one two", "", "drei\nvier"]):
        (tmp_path / "docs" / f"{i}.txt").write_text(text)
    read = files.read_documents(spark, at("docs")).collect()
    assert sorted(r.text for r in read) == ["", "drei\nvier", "one two"] and len({r.doc_id for r in read}) == 3
    (tmp_path / "stop").write_text("the a\n  of\ta\n")
    assert sorted(r.word for r in files.read_words(spark, at("stop")).collect()) == ["a", "of", "the"]
    ids, enc = P.prepare(docs, Config(min_count=2))
    same = lambda a, b: a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    files.write_dictionary(ids, at("dict"))
    assert same(files.read_dictionary(spark, at("dict")), ids.select("word_id", "word", "tf"))
    blocks = P.doc_blocks(docs, 3)
    files.write_blocks(enc, blocks, at("blocks"))
    whole = enc.join(blocks, "doc_id")
    assert same(files.read_block(spark, at("blocks")).select(whole.columns), whole)
    assert same(files.read_block(spark, at("blocks"), 1).select(whole.columns), whole.filter("block_id = 1"))
    vocab = P.block_vocab(enc, blocks, ids)
    files.write_block_vocab(vocab, at("vocab"))
    assert same(files.read_block_vocab(spark, at("vocab")).select(vocab.columns), vocab)
    assert same(files.read_block_vocab(spark, at("vocab"), 1).select(vocab.columns), vocab.filter("block_id = 1"))
    assert spark.read.text(at("vocab/text")).count() == vocab.count()
    meta = planning.dict_meta(ids, 8, 2, 4)
    files.write_dict_meta(meta, at("meta"))
    assert same(files.read_dict_meta(spark, at("meta")).select(meta.columns), meta)
    assert files.read_dict_meta(spark, at("meta"), 1).count() == meta.filter("client_id = 1").count()
    lines = report.dump_summary(C.topic_summary(C.init_topics(enc, 3, 1)))
    files.write_lines(lines, at("summary"))
    assert spark.read.text(at("summary")).first()[0] == lines.first()[0]
    assert files.count_documents(spark.read.text(at("stop"))) == 2
    with pytest.raises(Exception, match="(?i)exist"):
        files.write_dictionary(ids, at("dict"))


def test_capped_and_exact_likelihood(docs):
    _, enc = P.prepare(docs, Config(min_count=2))
    init = C.init_topics(enc, 3, 1)
    counts, blocks = C.doc_topic(init), P.doc_blocks(docs, 3)
    each = {r.doc_id: r.llh for r in stats.doc_llh(counts, 3, 0.01).collect()}
    assert stats.corpus_doc_llh(counts, 3, 0.01).first()[0] == pytest.approx(sum(each.values()))
    assert stats.corpus_doc_llh(counts, 3, 0.01, blocks, 2).first()[0] == pytest.approx(sum(v for i, v in each.items() if i % 3 < 2))
    ref, exact = (stats.corpus_llh(init, 3, Config(), 100, mode)["word"] for mode in ("reference", "exact"))
    assert exact - ref == pytest.approx((100 - C.word_topic(init).select("word_id").distinct().count()) * 3 * M.log_gamma_of(0.01))


def test_rows_of_one_document_and_null_ids(spark):
    """Repeated ids are one document, null ids stay apart, other columns are not read."""
    df = spark.createDataFrame([(1, "b a", 7), (1, "a c", 8), (None, "a b", 9), (2, None, 9)], "doc_id long, text string, pos int")
    ids = P.word_ids(P.vocabulary(P.term_frequency(df), 1))
    assert {r.word: (r.tf, r.df) for r in ids.collect()} == {"a": (3, 3), "b": (2, 2), "c": (1, 1)}
    got = P.encode(df, ids, 3).collect()
    assert sorted((r.doc_id or 0, r.pos) for r in got) == [(0, 1), (0, 2), (1, 1), (1, 2), (1, 3)]
    assert P.encode(df.limit(0), ids, 3).count() == 0


def test_a_dictionary_beyond_a_broadcast(spark):
    """Looked up by blocks of documents it gives the same tokens; no token is shuffled by its word."""
    rng = np.random.default_rng(13)
    rows = [(i % 70 if i % 9 else None, " ".join(f"w{int(rng.exponential(20))}" for _ in range(rng.integers(0, 30)))) for i in range(120)]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in [*rows, (500, None), (501, ""), (502, "unknown only")]], "doc_id long, text string, block int, word string")
    ids = P.word_ids(P.vocabulary(P.term_frequency(df), 3))
    one, other = P.encode(df, ids, 12), P.encode(df, ids, 12, most=0)
    assert one.count() > 300 and one.exceptAll(other).isEmpty() and other.exceptAll(one).isEmpty() and one.schema.names == other.schema.names
    assert "BroadcastHashJoin" in one._jdf.queryExecution().toString() and P.encode(df.limit(0), ids, 12, most=0).count() == 0
    texts = P._encode_by_block(df, ids, 12)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in texts and "hashpartitioning(word" in texts


def test_ranks_inside_keys(spark, monkeypatch):
    """A key that holds most rows goes over several partitions; ranks go on from one to the next."""
    rng = np.random.default_rng(14)
    rows = [(0 if rng.random() < 0.8 else int(rng.integers(1, 6)), int(rng.integers(50)), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "k int, v int, i int")
    per = defaultdict(list)
    for k, v, i in rows:
        per[k].append((-v, i))
    want = {(k, -v, i): n for k, vs in per.items() for n, (v, i) in enumerate(sorted(vs), 1)}
    small = "spark.sql.adaptive.coalescePartitions.enabled"  # these rows would go to one partition
    spark.conf.set(small, "false")
    for most in (lineage.BROADCAST_BYTES, 0):
        monkeypatch.setattr(lineage, "lookup", lambda x, size, most=most: F.broadcast(x) if size <= most else x)
        got = lineage.ranks(df, "rank", ["k"], F.desc("v"), F.asc("i"))
        assert {(r.k, r.v, r.i): r["rank"] for r in got.collect()} == want
    spread = lineage.numbered(df, "k", F.desc("v")).filter("k = 0").select("__p").distinct().count()
    spark.conf.set(small, "true")
    assert spread > 1 and lineage.ranks(df.limit(0), "rank", ["k"], "v").count() == 0


def test_block_store(spark, docs, tmp_path):
    """Tables in buckets: summed and joined by block without a shuffle."""
    ids, enc = P.prepare(docs, Config(min_count=2))
    blocks = P.doc_blocks(docs, 3)
    tokens, vocab = enc.join(blocks, "doc_id"), P.block_vocab(enc, blocks, ids)
    files.store_blocks(tokens, "tokens_by_block", 4, str(tmp_path / "tokens"))
    files.store_blocks(vocab, "vocab_by_block", 4, str(tmp_path / "vocab"))
    stored = files.stored_blocks(spark, "tokens_by_block")
    assert stored.exceptAll(tokens.select(stored.columns)).isEmpty() and tokens.select(stored.columns).exceptAll(stored).isEmpty()
    plan = lambda x: x._jdf.queryExecution().executedPlan().toString()
    local = stored.groupBy("block_id", "word_id").agg(F.count("*").alias("n"))
    both = files.stored_blocks(spark, "vocab_by_block").hint("merge").join(local, ["block_id", "word_id"])
    assert "Exchange" not in plan(local) and both.filter("n <> local_tf").isEmpty() and both.count() == vocab.count()
    by_block = stored.groupBy("block_id").agg(F.count("*").alias("n")).hint("merge").join(files.stored_blocks(spark, "vocab_by_block"), "block_id")
    assert "Exchange" not in plan(by_block)
    one = files.stored_blocks(spark, "tokens_by_block", 1)
    assert one.count() == tokens.filter("block_id = 1").count()
    spark.sql("DROP TABLE tokens_by_block")
    spark.sql("DROP TABLE vocab_by_block")


def test_dump_round_trip(docs, spark, tmp_path):
    _, enc = P.prepare(docs, Config(min_count=2))
    model = C.word_topic(C.init_topics(enc, 4, 1))
    path = str(tmp_path / "dump")
    report.dump_text(model).write.text(path)
    back = report.read_dumps(spark, [path])
    assert back.exceptAll(model).isEmpty() and model.exceptAll(back).isEmpty()


def test_training_improves_and_repeats(spark):
    rng = np.random.default_rng(0)
    texts = [(i, " ".join(f"w{(i % 2) * 20 + rng.integers(20)}" for _ in range(40))) for i in range(60)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    cfg = Config(min_count=1, topics=2, iterations=12, llh_every=1)
    m = fit(docs, cfg)
    assert m.metrics[-1]["doc"] > m.metrics[0]["doc"] and m.metrics[-1]["word"] > m.metrics[0]["word"]
    assert unpack(m.docs).count() == 60 * 40
    again = fit(docs.repartition(7), cfg)
    assert unpack(m.docs).exceptAll(unpack(again.docs)).isEmpty()
    top = m.transform(docs, 5).groupBy("doc_id").agg(F.sum("cnt").alias("n")).collect()
    assert all(r.n == 40 for r in top)


def test_config(spark):
    assert parse_params("a = 1 # x\n#b=2\nc = 'q'\n") == {"a": "1", "c": "q"}
    assert load_config(["topics = 5", "alpha=0.5"]) == Config(topics=5, alpha=0.5)
    with pytest.raises(KeyError):
        load_config(["nope = 1"])
    assert [due(i, 2) for i in range(4)] == [False, True, False, True] and not due(3, -1) and not due(3, 0)


def test_stop_word_defaults():
    assert len(T.STOP_WORDS) == len(set(T.STOP_WORDS)) < 200


def test_every_slice_gets_its_model_rows(spark, tmp_path):
    from topicloom import queries

    words = [f"word{i}" for i in range(20)]
    rows = [(i, " ".join(words[i % 7 : i % 7 + 12])) for i in range(600)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.QUERIES["slice_requests"](spark, str(tmp_path)).collect()
    asked = queries.QUERIES["slice_meta"](spark, str(tmp_path)).collect()
    model = queries.QUERIES["word_topic"](spark, str(tmp_path)).collect()
    assert {r.block_id for r in got} == {0, 1, 2}
    want = [(a.block_id, a.slice_id, m.word_id, m.topic, m.cnt) for a in asked for m in model if m.word_id == a.word_id]
    assert sorted(map(tuple, got)) == sorted(want)


def test_corpus_llh_reckons_each_document_once(spark, tmp_path):
    from topicloom import queries

    rows = [(i, f"alpha beta w{i % 3} w{i % 7} gamma") for i in range(60)]
    docs = spark.createDataFrame(rows + rows[:20], "doc_id long, text string")  # some rows repeat
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    s = queries.State(spark, str(tmp_path))
    assert s.ids.columns == ["word_id", "word", "tf"]
    k, a, b, n = s.cfg.topics, s.cfg.ll_alpha, s.cfg.beta, s.n_words
    got = {r.part: r.llh for r in queries._corpus_llh(s).collect()}
    word = {m: stats.corpus_word_llh(s.model, s.summary, k, b, n, m).first()[0] for m in ("reference", "exact")}
    assert got["word"] == pytest.approx(word["reference"]) and got["word_exact"] == pytest.approx(word["exact"])
    # All documents are under the cap; those of repeated rows counted twice before, in SQL once.
    assert got["doc"] == pytest.approx(stats.corpus_doc_llh(s.doc_counts, k, a).first()[0]) and got["doc_capped"] == pytest.approx(got["doc"])
