"""Queries of topic modelling over ``documents``, with their DuckDB oracles."""

from __future__ import annotations

from dataclasses import replace
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.config import Config
from topicloom.functions import mathx as M
from topicloom.functions import text as T
from topicloom.operators import corpus as P
from topicloom.operators import counts as C
from topicloom.operators import planning, proposals, report, sampler, stats
from topicloom.operators.alias import BITS
from topicloom.plans.lineage import cut

CFG = Config()
CAPS = (40_000, 40_000, 40_000)
#: Words of a topic that the report shows, and documents of a block that the capped likelihood takes.
TOP, LLH_CAP = 20, 100


class State:
    """The tables that queries share, built lazily for one input."""

    def __init__(self, spark: SparkSession, sf_dir: str, cfg: Config = CFG):
        self.docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
        self.cfg, self._made = cfg, {}

    def __getattr__(self, name):
        made = self.__dict__["_made"]
        if name not in made:
            made[name] = getattr(self, f"_{name}")()
        return made[name]

    def _tf(self):
        return P.term_frequency(self.docs)

    def _vocab(self):
        return P.vocabulary(P.drop_stop_words(self.tf), self.cfg.min_count)

    def _ids(self):
        return P.word_ids(P.vocabulary(P.drop_stop_words(P.word_counts(self.docs)), self.cfg.min_count))  # no df: only queries that show it count it

    def _n_words(self):
        return self.ids.count()

    def _encoded(self):
        return cut(P.encode(self.docs, self.ids, self.cfg.max_tokens))  # the texts are read and split once

    def _blocks(self):
        return P.doc_blocks(self.docs, self.cfg.block_size)

    def _block_vocab(self):
        return P.block_vocab(self.encoded, self.blocks, self.ids)

    def _init(self):
        return C.init_topics(self.encoded, self.cfg.topics, self.cfg.seed)

    def _moved(self):
        return self.init.withColumn("new_topic", M.draw_topic(F.col("doc_id"), F.col("pos"), self.cfg.topics, self.cfg.seed + 123_456_789))

    def _model(self):
        return C.word_topic(self.init)

    def _summary(self):
        return C.topic_summary(self.init)

    def _doc_counts(self):
        return C.doc_topic(self.init)

    def _slices(self):
        return planning.slices(planning.row_sizes(self.block_vocab, self.cfg.topics, self.cfg.load_factor), *CAPS)


def _rounded(df: DataFrame, digits: int, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


def _acceptance(kind: str, s: State) -> DataFrame:
    return proposals.acceptance(s.moved, s.model, s.summary, s.doc_counts, s.n_words, s.cfg.alpha, s.cfg.beta, kind)


def _accept(kind: str, s: State) -> DataFrame:
    return _rounded(_acceptance(kind, s), 6, "accept").select("doc_id", "pos", "new_topic", "accept")


def _drawn(s: State) -> DataFrame:
    """``word_id, topic, prob``: what the alias tables of the words' own entries draw."""
    at = sampler.own_tables(s.model, sampler.shared(s.summary, s.cfg.topics, s.n_words, s.cfg.alpha, s.cfg.beta))
    stays = at.select("word_id", "topic", (F.col("stay") / F.col("size")).alias("prob"))
    goes = at.select("word_id", F.col("alias_topic").alias("topic"), ((1 - F.col("stay")) / F.col("size")).alias("prob"))
    return stays.unionByName(goes).groupBy("word_id", "topic").agg(F.sum("prob").alias("prob"))


def _corpus_llh(s: State) -> DataFrame:
    """``part, llh``: documents, those under the cap, words, and words with those that have no token."""
    return stats.corpus_parts(s.doc_counts, s.model, s.blocks, LLH_CAP, s.cfg.topics, s.cfg.ll_alpha, s.cfg.beta, s.n_words)


BUILD = {
    "tokenize": lambda s: P.tokenize(s.docs),
    "tf_df": lambda s: s.tf,
    "stopword_anti": lambda s: P.drop_stop_words(s.tf),
    "vocab": lambda s: s.vocab,
    "word_ids": lambda s: P.word_ids(s.vocab),
    "doc_tokens_512": lambda s: s.encoded,
    "docs_left_tokens": lambda s: P.documents_with_tokens(s.docs, s.encoded).select("doc_id", "n_tokens", F.array_join("words", " ").alias("words")),
    "doc_blocks": lambda s: s.blocks,
    "block_vocab": lambda s: s.block_vocab,
    "block_stats": lambda s: P.block_stats(s.encoded, s.blocks),
    "dict_meta": lambda s: planning.dict_meta(s.ids, s.cfg.topics, s.cfg.load_factor, s.cfg.clients),
    "dict_meta_by_client": lambda s: planning.dict_meta_by_client(s.ids, s.cfg.topics, s.cfg.load_factor, s.cfg.clients),
    "slice_meta": lambda s: s.slices,
    "slice_summary": lambda s: planning.slice_summary(s.slices, s.block_vocab),
    "word_ids_shuffled": lambda s: P.word_ids(s.vocab, s.cfg.seed).select("word_id", "word", "tf", "df"),
    "doc_blocks_shuffled": lambda s: P.doc_blocks(s.docs, s.cfg.block_size, s.cfg.seed),
    "slice_semi_join": lambda s: planning.slice_rows(s.model, s.slices),
    "slice_requests": lambda s: planning.slice_requests(s.model, s.slices),
    "slice_index": lambda s: planning.slice_index(s.slices),
    "alias_capacity": lambda s: planning.alias_capacity(s.model, s.ids, s.cfg.topics),
    "init_topics": lambda s: s.init,
    "doc_topic": lambda s: s.doc_counts,
    "word_topic": lambda s: s.model,
    "topic_summary": lambda s: s.summary,
    "deltas": lambda s: C.deltas(s.moved),
    "delta_agg": lambda s: C.sum_deltas(C.deltas(s.moved)),
    "delta_apply": lambda s: C.apply_deltas(s.model, C.sum_deltas(C.deltas(s.moved))),
    "summary_apply": lambda s: C.apply_summary_deltas(s.summary, C.sum_summary_deltas(C.deltas(s.moved))),
    "alias_table": lambda s: _rounded(_drawn(s), 9, "prob"),
    "word_proposal": lambda s: _rounded(proposals.word_proposal(s.ids, s.model, s.summary, s.cfg.topics, s.cfg.beta, s.n_words), 9, "mass", "prob"),
    "doc_proposal": lambda s: _rounded(proposals.doc_proposal(s.docs, s.doc_counts, s.cfg.topics, s.cfg.alpha), 9, "prob"),
    "mh_word_accept": partial(_accept, "word"),
    "mh_doc_accept": partial(_accept, "doc"),
    "accept_counters": lambda s: _rounded(stats.acceptance_counters(_acceptance("word", s)), 2, "expected"),
    "doc_llh": lambda s: _rounded(stats.doc_llh(s.doc_counts, s.cfg.topics, s.cfg.ll_alpha), 3, "llh"),
    "word_llh": lambda s: _rounded(stats.word_llh(s.model, s.cfg.topics, s.cfg.beta), 3, "llh"),
    "llh_normalizer": lambda s: _rounded(stats.llh_normalizer(s.summary, s.cfg.topics, s.cfg.beta, s.n_words), 2, "normalizer"),
    "corpus_llh": lambda s: _rounded(_corpus_llh(s), 1, "llh"),
    "topic_report": lambda s: report.topic_report(report.topic_words(s.model, s.ids, TOP)),
    "dump_summary": lambda s: report.dump_summary(s.summary),
    "topic_words": lambda s: report.topic_words(s.model, s.ids).select("topic", "rank", "word", "cnt"),
    "topic_word_prob": lambda s: _rounded(report.topic_words(s.model, s.ids).select("topic", "word", "prob"), 9, "prob"),
    "dump_text": lambda s: report.dump_text(s.model),
    "dump_parse": lambda s: report.parse_dump(report.dump_text(s.model)),
}

QUERIES = {name: (lambda spark, sf_dir, f=f: f(State(spark, sf_dir))) for name, f in BUILD.items()}


def _sampled(s: State, kind: str) -> DataFrame:
    """``doc_id, rank, word_id, topic``: every token after a pass that leaves the other tokens as they were; rank from 0 by word and position."""
    from topicloom.plans.train import blocks_of, pack

    docs = cut(pack(s.init, blocks_of(s.docs)))
    sent = s.docs.sparkSession.sparkContext.broadcast(sampler.shared(s.summary, s.cfg.topics, s.n_words, s.cfg.alpha, s.cfg.beta))  # a few numbers per topic
    new = sampler.sample(docs, sampler.requests(docs), s.model, sent, s.cfg.seed, 0, s.cfg.mh_steps, kind)
    return new.select("doc_id", F.posexplode(F.arrays_zip("words", "drawn")).alias("rank", "t")).select("doc_id", "rank", F.col("t.words").alias("word_id"), F.col("t.drawn").alias("topic"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def propose_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One word proposal of every token, drawn through the alias tables."""
    return _sampled(State(spark, sf_dir), "propose")


def mh_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every token's chain of word and document proposals, the other tokens as they were."""
    return _sampled(State(spark, sf_dir), "chain")


def train(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topic counts by word after a few iterations (no SQL: ``train_step`` is one of them)."""
    from topicloom.plans.train import fit

    return fit(_documents(spark, sf_dir), replace(CFG, iterations=3)).word_topic()


def train_step_conservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens before and after an iteration: sampling moves tokens, it loses none."""
    from topicloom.plans.train import fit, unpack

    m = fit(_documents(spark, sf_dir), replace(CFG, iterations=1))
    return unpack(m.docs).groupBy("word_id").agg(F.count("*").alias("n_tokens"))


def train_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every word and topic after one iteration."""
    from topicloom.plans.train import fit

    return fit(_documents(spark, sf_dir), replace(CFG, iterations=1)).word_topic()


def throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``topic, tokens_before, tokens_after, moved_in, moved_out`` of an iteration, from what its sampling moved."""
    from topicloom.plans.train import fit, unpack

    docs = fit(_documents(spark, sf_dir), replace(CFG, iterations=1)).docs
    moved = docs.select(F.explode("moved").alias("m")).select("m.old", "m.new")
    after = C.topic_summary(unpack(docs)).withColumnRenamed("cnt", "tokens_after")
    came, went = (moved.groupBy(F.col(c).alias("topic")).agg(F.count("*").alias(n)) for c, n in (("new", "moved_in"), ("old", "moved_out")))
    x = after.join(came, "topic", "full").join(went, "topic", "full").fillna(0)
    return x.select("topic", (F.col("tokens_after") - F.col("moved_in") + F.col("moved_out")).alias("tokens_before"), "tokens_after", "moved_in", "moved_out")


def infer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics of the benchmark passages against a trained model."""
    from topicloom.plans.train import fit

    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("doc_id"), "text")
    return fit(_documents(spark, sf_dir), replace(CFG, iterations=2)).transform(items, 2)


def infer_conservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each passage after folding in: as many as it has in the vocabulary, up to the cut."""
    return infer(spark, sf_dir).groupBy("doc_id").agg(F.sum("cnt").alias("n_tokens"))


QUERIES |= {f.__name__: f for f in (propose_topics, mh_chain, train, train_step, train_step_conservation, throughput, infer, infer_conservation)}


def _llg(x: str) -> str:
    series = " + ".join([repr(M.LANCZOS_BASE), *(f"({c!r}) / (({x}) + {k})" for k, c in enumerate(M.LANCZOS, 1))])
    return f"((({x}) + 0.5) * ln(({x}) + 5.5) - (({x}) + 5.5) + ln({M.ROOT_TWO_PI!r} * ({series}) / ({x})))"


def _pow2(x: str) -> str:
    return f"CAST(CASE WHEN ({x}) <= 1 THEN 1 ELSE 1::BIGINT << length(ltrim(bin(({x}) - 1), '0')) END AS BIGINT)"


def _topic(seed: int, c: Config) -> str:
    x = f"((doc_id * 1000003 + pos * 7919 + {seed}) & 2147483647)"
    a = f"xor({x}, ({x} << 13) & 4294967295)"
    b = f"xor({a}, {a} >> 17)"
    d = f"(xor({b}, ({b} << 5) & 4294967295) & 2147483647)"
    return f"CAST(floor({d} * CAST({M.UNIT!r} AS DOUBLE) * {c.topics}) AS INTEGER)"


def _mixed(x: str) -> str:
    return f"list_reduce([({x})::BIGINT, {sampler.MULTIPLIER}, {sampler.MULTIPLIER}, 1], lambda a, k: (xor(a, a >> 16) * k) & 4294967295)"


def _document_hash(seed: int, iteration: int) -> str:
    run = f"xor({_mixed(str(seed))}, {iteration})"
    return _mixed(f"xor({_mixed(f'xor({_mixed(run)}, doc_id & 4294967295)')}, (doc_id >> 32) & 4294967295)")


def _uniform(draw: int) -> str:
    return f"({_mixed(f'xor(h, {draw})')} / 4294967296::DOUBLE)"


def _tables(c: Config) -> list[tuple[str, str]]:
    """Alias tables of all words, and of the shared part as word -1, in lists by entry; topic totals; packed documents."""
    one = f"{1 << BITS}::DOUBLE"
    return [
        ("tot", f"SELECT k.topic, coalesce(t.cnt, 0) AS nt, v * CAST({c.beta} AS DOUBLE) AS vb FROM ks k CROSS JOIN nv LEFT JOIN nt t ON t.topic = k.topic"),
        ("ent", f"SELECT word_id, topic, n.cnt / (nt + vb) AS mass FROM ntw n JOIN tot USING (topic) UNION ALL SELECT -1, topic, CAST({c.beta} AS DOUBLE) / (nt + vb) FROM tot"),
        ("wts", f"SELECT *, greatest(1, CAST(floor(mass / max(mass) OVER p * {one}) AS BIGINT)) AS w, max(mass) OVER p / {one} AS unit, count(*) OVER p AS n FROM ent WINDOW p AS (PARTITION BY word_id)"),
        ("exc", "SELECT *, CAST(sum(w) OVER (PARTITION BY word_id) AS BIGINT) AS m, n * w - CAST(sum(w) OVER (PARTITION BY word_id) AS BIGINT) AS x FROM wts"),
        ("run", "SELECT *, CAST(sum(greatest(-x, 0)) OVER p AS BIGINT) AS d, CAST(sum(greatest(x, 0)) OVER p AS BIGINT) AS e FROM exc WINDOW p AS (PARTITION BY word_id ORDER BY topic)"),
        ("lists", "SELECT word_id, list(d ORDER BY topic) AS ds, list(e ORDER BY topic) AS es FROM run GROUP BY word_id"),
        ("ali", "SELECT r.*, least(n - 1, len(list_filter(es, lambda y: y <= CASE WHEN x <= 0 THEN d + x ELSE e END))) AS alias, ds[least(n - 1, len(list_filter(ds, lambda y: y < e))) + 1] AS reached FROM run r JOIN lists USING (word_id)"),
        ("tab", "SELECT word_id, any_value(n) AS n, any_value(m) AS m, any_value(m)::DOUBLE * any_value(unit) AS mass, list(topic ORDER BY topic) AS tp, list(alias ORDER BY topic) AS al, list(CASE WHEN x <= 0 THEN n * w ELSE m - (reached - e) END ORDER BY topic) AS th FROM ali GROUP BY word_id"),
        ("nwl", "SELECT word_id, list(coalesce(cnt, 0) ORDER BY topic) AS nw FROM (SELECT word_id, topic FROM (SELECT DISTINCT word_id FROM ntw) CROSS JOIN ks) LEFT JOIN ntw USING (word_id, topic) GROUP BY word_id"),
        ("wrd", "SELECT * FROM tab JOIN nwl USING (word_id)"),
        ("sha", "SELECT t.n AS sn, t.m AS sm, t.mass AS smass, t.al AS sal, t.th AS sth, q.nts, q.vb FROM tab t CROSS JOIN (SELECT list(nt ORDER BY topic) AS nts, any_value(vb) AS vb FROM tot) q WHERE t.word_id = -1"),
        ("pck", f"SELECT doc_id, count(*) AS total, list(word_id ORDER BY word_id, pos) AS ws, list(topic ORDER BY word_id, pos) AS z, {_document_hash(c.seed, 0)} AS hd FROM init GROUP BY doc_id"),
        ("cnd", f"SELECT *, [len(list_filter(z, lambda y: y = t)) FOR t IN range({c.topics})] AS nd FROM pck"),
    ]


def _chain(source: str, c: Config, steps: int) -> str:
    """``source`` with ``cur``: a token's topic ``old`` after the steps of its chain; ``t``: its first word proposal."""
    k, a, b = c.topics, f"{c.alpha!r}::DOUBLE", f"{c.beta!r}::DOUBLE"
    q = f"SELECT *, old AS c0 FROM ({source})"

    def add(name: str, expr: str) -> None:
        nonlocal q
        q = f"SELECT *, {expr} AS {name} FROM ({q})"

    def drawn(u1: str, u2: str, n: str, m: str, th: str, al: str) -> str:
        i = f"least(CAST(floor({u1} * {n}) AS BIGINT), {n} - 1) + 1"
        return f"CASE WHEN {u2} * {m} < {th}[{i}] THEN {i} - 1 ELSE {al}[{i}] END"

    def accept(cur: str, t: str, u: str, by_word: bool) -> None:
        same = {x: f"CAST({x} = old AS INTEGER)" for x in (cur, t)}
        nd, nw, nt = ({x: f"{n}[{x} + 1]" for x in (cur, t)} for n in ("nd", "nw", "nts"))
        side = lambda x, y: f"({nd[x]} - {same[x]} + {a}) * (greatest({nw[x]} - {same[x]}, 0) + {b}) * (greatest({nt[y]} - {same[y]}, 0) + vb)"
        up, down = side(t, cur), side(cur, t)
        if by_word:
            up, down = f"{up} * ({nw[cur]} + {b}) * ({nt[t]} + vb)", f"{down} * ({nw[t]} + {b}) * ({nt[cur]} + vb)"
        else:
            up, down = f"{up} * ({nd[cur]} + {a})", f"{down} * ({nd[t]} + {a})"
        add("u", u)
        add("took", f"u * ({down}) < {up}")

    cur = "c0"
    for step in range(steps):
        u = [_uniform(step * sampler.DRAWS + j) for j in range(8)]
        add("u1", u[1])
        add("u2", u[2])
        own, rest = drawn("u1", "u2", "n", "m", "th", "al"), drawn("u1", "u2", "sn", "sm", "sth", "sal")
        add(f"t{step}", f"CASE WHEN {u[0]} * (mass + smass) < mass THEN tp[{own} + 1] ELSE {rest} END")
        accept(cur, f"t{step}", u[3], True)
        q = f"SELECT * EXCLUDE (u, u1, u2, took), CASE WHEN took THEN t{step} ELSE {cur} END AS w{step} FROM ({q})"
        add(f"d{step}", f"CASE WHEN {u[5]} < total / (total + {c.alpha * k!r}::DOUBLE) THEN z[least(CAST(floor({u[4]} * total) AS BIGINT), total - 1) + 1] ELSE least(CAST(floor({u[6]} * {k}) AS BIGINT), {k} - 1) END")
        accept(f"w{step}", f"d{step}", u[7], False)
        cur = f"c{step + 1}"
        q = f"SELECT * EXCLUDE (u, took), CASE WHEN took THEN d{step} ELSE w{step} END AS {cur} FROM ({q})"
    return f"SELECT *, {cur} AS cur FROM ({q})"


def _sampling(c: Config) -> dict[str, str]:
    """One pass over all tokens, each by itself, or each after those before it in its document."""
    each = f"SELECT d.* EXCLUDE (r), r - 1 AS r, ws[r] AS word_id, z[r] AS old, {_mixed('xor(hd, r - 1)')} AS h FROM (SELECT *, unnest(range(1, total + 1)) AS r FROM cnd) d"
    alone = _chain(f"SELECT * FROM ({each}) JOIN wrd USING (word_id) CROSS JOIN sha", c, c.mh_steps)
    turn = _chain(f"SELECT s.*, s.z[r + 1] AS old, {_mixed('xor(hd, r)')} AS h, w.* EXCLUDE (word_id), sha.* FROM s JOIN wrd w ON w.word_id = s.ws[s.r + 1] CROSS JOIN sha WHERE s.r < s.total", c, c.mh_steps)
    after = "SELECT doc_id, total, ws, hd, r + 1 AS r, list_concat(z[1:r], [CAST(cur AS INTEGER)], z[r + 2:]) AS z, [nd[t + 1] - CAST(t = old AS INTEGER) + CAST(t = cur AS INTEGER) FOR t IN range(len(nd))] AS nd FROM (%s)" % turn
    swept = f"s AS (SELECT doc_id, total, ws, hd, 0::BIGINT AS r, z, nd FROM cnd UNION ALL {after})"
    return {"alone": f"SELECT doc_id, CAST(r AS INTEGER) AS rank, word_id, CAST(%s AS INTEGER) AS topic FROM ({alone})", "swept": swept}


def oracles(c: Config = CFG) -> dict[str, str]:
    stop = ", ".join(f"('{w}')" for w in T.STOP_WORDS)
    k, a, b, load = c.topics, c.alpha, c.beta, c.load_factor
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{T.UPPER}', '{T.LOWER}'), '[^\\s\\v[:punct:]]+')"
    dense = f"tf >= {k // (2 * load)}"
    cap = f"CASE WHEN {dense} THEN {k}::BIGINT ELSE {_pow2(f'tf * {load}')} END"
    size = f"CASE WHEN {dense} THEN {k}::BIGINT ELSE 2 * {_pow2(f'tf * {load}')} END"
    d, e = f"lg + ({k} - nnz)", M.log_gamma_of
    steps = [
        ("tokens", f"SELECT doc_id, unnest(range(1, len(w) + 1)) AS pos, unnest(w) AS word FROM (SELECT doc_id, {words} AS w FROM documents)"),
        ("tfdf", "SELECT word, count(*) AS tf, count(DISTINCT doc_id) AS df FROM tokens GROUP BY word"),
        ("kept", f"SELECT * FROM tfdf WHERE word NOT IN (SELECT w FROM (VALUES {stop}) AS s(w))"),
        ("voc", f"SELECT * FROM kept WHERE tf >= {c.min_count}"),
        ("ids", "SELECT CAST(row_number() OVER (ORDER BY tf DESC, word) - 1 AS INTEGER) AS word_id, word, tf, df FROM voc"),
        ("enc", f"SELECT doc_id, pos, word_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY t.pos) AS pos, word_id FROM tokens t JOIN ids USING (word)) WHERE pos <= {c.max_tokens}"),
        ("blocks", f"SELECT doc_id, CAST(floor((row_number() OVER (ORDER BY doc_id) - 1) / {c.block_size}) AS INTEGER) AS block_id FROM documents"),
        ("bv", "SELECT block_id, word_id, any_value(tf) AS global_tf, count(*) AS local_tf FROM enc JOIN blocks USING (doc_id) JOIN ids USING (word_id) GROUP BY block_id, word_id"),
        ("init", f"SELECT *, {_topic(c.seed, c)} AS topic FROM enc"),
        ("moved", f"SELECT *, {_topic(c.seed + 123_456_789, c)} AS new_topic FROM init"),
        ("ntw", "SELECT word_id, topic, count(*) AS cnt FROM init GROUP BY word_id, topic"),
        ("nt", "SELECT topic, count(*) AS cnt FROM init GROUP BY topic"),
        ("ntd", "SELECT doc_id, topic, count(*) AS cnt FROM init GROUP BY doc_id, topic"),
        ("chg", "SELECT word_id, topic, -1 AS delta FROM moved WHERE topic <> new_topic UNION ALL SELECT word_id, new_topic, 1 FROM moved WHERE topic <> new_topic"),
        ("agg", "SELECT word_id, topic, CAST(sum(delta) AS BIGINT) AS delta FROM chg GROUP BY word_id, topic HAVING sum(delta) <> 0"),
        ("ks", f"SELECT CAST(unnest(range({k})) AS INTEGER) AS topic"),
        ("nv", "SELECT count(*) AS v FROM ids"),
        ("rep", "SELECT topic, CAST(row_number() OVER (PARTITION BY topic ORDER BY cnt DESC, word_id) AS INTEGER) AS rank, word, cnt, cnt / sum(cnt) OVER (PARTITION BY topic) AS prob FROM ntw JOIN ids USING (word_id)"),
        ("sz", f"SELECT block_id, word_id, row_number() OVER (PARTITION BY block_id ORDER BY word_id) AS r, {size.replace('tf', 'global_tf')} AS m, CASE WHEN global_tf >= {2 * k // 3} THEN {2 * k} ELSE 3 * global_tf END AS al, CASE WHEN local_tf >= {k // (4 * load)} THEN {k} ELSE 2 * {_pow2(f'local_tf * {2 * load}')} END AS dl FROM bv"),
        ("sl", f"SELECT block_id, word_id, r, 0 AS slice_id, m, al, dl FROM sz WHERE r = 1 UNION ALL SELECT z.block_id, z.word_id, z.r, s.slice_id + over_, CASE WHEN over_ = 1 THEN z.m ELSE s.m + z.m END, CASE WHEN over_ = 1 THEN z.al ELSE s.al + z.al END, CASE WHEN over_ = 1 THEN z.dl ELSE s.dl + z.dl END FROM sl s JOIN sz z ON z.block_id = s.block_id AND z.r = s.r + 1, LATERAL (SELECT CAST(s.m + z.m > {CAPS[0]} OR s.al + z.al > {CAPS[1]} OR s.dl + z.dl > {CAPS[2]} AS INTEGER) AS over_) o"),
    ]
    mat = ", ".join(f"{n} AS {'' if n == 'sl' else 'MATERIALIZED '}({q})" for n, q in steps)
    acc = (
        "SELECT doc_id, CAST(pos AS INTEGER) AS pos, new_topic, round(least(1.0, up / down), 6) AS accept FROM (SELECT doc_id, pos, new_topic, "
        f"(dt - same + {a}) * (wt - same + {b}) * (ns - 1 + vb) * %s AS up, (ds - 1 + {a}) * (ws - 1 + {b}) * (nt_ - same + vb) * %s AS down FROM ("
        "SELECT m.doc_id, m.pos, m.new_topic, coalesce(a1.cnt, 0) AS ws, coalesce(a2.cnt, 0) AS wt, coalesce(b1.cnt, 0) AS ds, coalesce(b2.cnt, 0) AS dt, coalesce(c1.cnt, 0) AS ns, coalesce(c2.cnt, 0) AS nt_, "
        f"CAST(m.topic = m.new_topic AS INTEGER) AS same, v * CAST({b} AS DOUBLE) AS vb FROM moved m CROSS JOIN nv "
        "LEFT JOIN ntw a1 ON a1.word_id = m.word_id AND a1.topic = m.topic LEFT JOIN ntw a2 ON a2.word_id = m.word_id AND a2.topic = m.new_topic "
        "LEFT JOIN ntd b1 ON b1.doc_id = m.doc_id AND b1.topic = m.topic LEFT JOIN ntd b2 ON b2.doc_id = m.doc_id AND b2.topic = m.new_topic "
        "LEFT JOIN nt c1 ON c1.topic = m.topic LEFT JOIN nt c2 ON c2.topic = m.new_topic))"
    )
    acc = acc.replace(f"{a})", f"CAST({a} AS DOUBLE))").replace(f"{b})", f"CAST({b} AS DOUBLE))")
    wp = f"SELECT i.word_id, k.topic, (coalesce(n.cnt, 0) + CAST({b} AS DOUBLE)) / (coalesce(t.cnt, 0) + v * CAST({b} AS DOUBLE)) AS mass FROM ids i CROSS JOIN ks k CROSS JOIN nv LEFT JOIN ntw n ON n.word_id = i.word_id AND n.topic = k.topic LEFT JOIN nt t ON t.topic = k.topic"
    dl = f"SELECT doc_id, {e(k * c.ll_alpha) - k * e(c.ll_alpha)!r} + {d} * ({e(c.ll_alpha)!r}) - {_llg(f'nd + {k * c.ll_alpha!r}::DOUBLE')} AS llh FROM (SELECT doc_id, sum({_llg(f'cnt + {c.ll_alpha}::DOUBLE')}) AS lg, count(*) AS nnz, sum(cnt) AS nd FROM ntd GROUP BY doc_id)"
    wl = f"SELECT word_id, {d} * ({e(b)!r}) AS llh FROM (SELECT word_id, sum({_llg(f'cnt + {b}::DOUBLE')}) AS lg, count(*) AS nnz FROM ntw GROUP BY word_id)"
    nl = f"SELECT {k} * (lv - v * ({e(b)!r})) - lg - ({k} - nnz) * lv AS normalizer FROM (SELECT any_value(v) AS v, any_value({_llg(f'v * {b}::DOUBLE')}) AS lv, sum({_llg(f'cnt + v * {b}::DOUBLE')}) AS lg, count(*) AS nnz FROM nt CROSS JOIN nv)"
    corpus = (
        f"SELECT part, round(llh, 1) AS llh FROM (SELECT 'doc' AS part, sum(llh) AS llh FROM ({dl}) UNION ALL "
        f"SELECT 'doc_capped', sum(llh) FROM ({dl}) WHERE doc_id IN (SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY block_id ORDER BY doc_id) AS n FROM blocks) WHERE n <= {LLH_CAP}) UNION ALL "
        f"SELECT 'word', (SELECT sum(llh) FROM ({wl})) + (SELECT normalizer FROM ({nl})) UNION ALL "
        f"SELECT 'word_exact', (SELECT sum(llh) FROM ({wl})) + (SELECT normalizer FROM ({nl})) + ((SELECT v FROM nv) - (SELECT count(*) FROM ({wl}))) * {k} * ({e(b)!r}))"
    )
    ends = {
        "tokenize": "SELECT doc_id, CAST(pos AS INTEGER) AS pos, word FROM tokens",
        "tf_df": "SELECT * FROM tfdf",
        "stopword_anti": "SELECT * FROM kept",
        "vocab": "SELECT * FROM voc",
        "word_ids": "SELECT * FROM ids",
        "doc_tokens_512": "SELECT doc_id, CAST(pos AS INTEGER) AS pos, word_id FROM enc",
        "docs_left_tokens": "SELECT d.doc_id, CAST(count(e.word_id) AS INTEGER) AS n_tokens, coalesce(string_agg(e.word_id, ' ' ORDER BY e.word_id), '') AS words FROM documents d LEFT JOIN enc e USING (doc_id) GROUP BY d.doc_id",
        "doc_blocks": "SELECT * FROM blocks",
        "block_vocab": "SELECT * FROM bv",
        "block_stats": "SELECT block_id, count(DISTINCT b.doc_id) AS n_docs, count(e.word_id) AS n_tokens, count(DISTINCT e.word_id) AS n_words FROM blocks b LEFT JOIN enc e USING (doc_id) GROUP BY block_id",
        "dict_meta": f"SELECT client_id, word_id, CAST(sum(size) OVER w - size AS BIGINT) AS \"offset\", CAST(sum(size) OVER w AS BIGINT) AS end_offset, capacity, is_dense FROM (SELECT CAST(word_id % {c.clients} AS INTEGER) AS client_id, word_id, CAST({dense} AS INTEGER) AS is_dense, {cap} AS capacity, {size} AS size FROM ids) WINDOW w AS (PARTITION BY client_id ORDER BY word_id)",
        "dict_meta_by_client": f"SELECT CAST(word_id % {c.clients} AS INTEGER) AS client_id, count(*) AS n_words, CAST(sum(tf) AS BIGINT) AS tf, CAST(sum({size}) AS BIGINT) AS memory FROM ids GROUP BY 1",
        "slice_meta": "SELECT block_id, CAST(slice_id AS INTEGER) AS slice_id, word_id FROM sl",
        "slice_summary": "SELECT block_id, CAST(slice_id AS INTEGER) AS slice_id, min(word_id) AS first_word, max(word_id) AS last_word, count(*) AS n_words, CAST(sum(global_tf) AS BIGINT) AS global_tf, CAST(sum(local_tf) AS BIGINT) AS local_tf FROM sl JOIN bv USING (block_id, word_id) GROUP BY block_id, slice_id",
        "word_ids_shuffled": f"SELECT CAST(row_number() OVER (ORDER BY md5('{c.seed}:' || word), word) - 1 AS INTEGER) AS word_id, word, tf, df FROM voc",
        "doc_blocks_shuffled": f"SELECT doc_id, CAST(floor((row_number() OVER (ORDER BY md5('{c.seed}:' || doc_id), doc_id) - 1) / {c.block_size}) AS INTEGER) AS block_id FROM documents",
        "slice_semi_join": "SELECT * FROM ntw WHERE word_id IN (SELECT word_id FROM sl)",
        "slice_requests": "SELECT block_id, CAST(slice_id AS INTEGER) AS slice_id, word_id, topic, cnt FROM sl JOIN ntw USING (word_id)",
        "init_topics": "SELECT doc_id, CAST(pos AS INTEGER) AS pos, word_id, topic FROM init",
        "doc_topic": "SELECT * FROM ntd",
        "word_topic": "SELECT * FROM ntw",
        "topic_summary": "SELECT * FROM nt",
        "deltas": "SELECT word_id, topic, delta FROM chg",
        "delta_agg": "SELECT * FROM agg",
        "delta_apply": "SELECT word_id, topic, CAST(sum(cnt) AS BIGINT) AS cnt FROM (SELECT * FROM ntw UNION ALL SELECT * FROM agg) GROUP BY 1, 2 HAVING sum(cnt) <> 0",
        "word_proposal": f"SELECT word_id, topic, round(mass, 9) AS mass, round(mass / sum(mass) OVER (PARTITION BY word_id), 9) AS prob FROM ({wp})",
        "doc_proposal": f"SELECT n.doc_id, k.topic, round((coalesce(c.cnt, 0) + CAST({a} AS DOUBLE)) / (nd + CAST({a} AS DOUBLE) * {k}), 9) AS prob FROM (SELECT doc_id, sum(cnt) AS nd FROM ntd GROUP BY doc_id) n CROSS JOIN ks k LEFT JOIN ntd c ON c.doc_id = n.doc_id AND c.topic = k.topic",
        "mh_word_accept": acc % (f"(ws + CAST({b} AS DOUBLE)) * (nt_ + vb)", f"(wt + CAST({b} AS DOUBLE)) * (ns + vb)"),
        "mh_doc_accept": acc % (f"(ds + CAST({a} AS DOUBLE))", f"(dt + CAST({a} AS DOUBLE))"),
        "slice_index": "SELECT block_id, CAST(slice_id AS INTEGER) AS slice_id, word_id, CAST(row_number() OVER (PARTITION BY block_id, slice_id ORDER BY word_id) - 1 AS INTEGER) AS index FROM sl",
        "alias_capacity": f"SELECT word_id, CASE WHEN tf >= {2 * k // 3} THEN {k}::BIGINT ELSE tf END AS planned, CASE WHEN tf >= {2 * k // 3} THEN {k}::BIGINT ELSE coalesce(nnz, 0) END AS refined FROM ids LEFT JOIN (SELECT word_id, count(*) AS nnz FROM ntw GROUP BY word_id) USING (word_id)",
        "summary_apply": "SELECT new_topic AS topic, count(*) AS cnt FROM moved GROUP BY new_topic",
        "accept_counters": "SELECT count(*) AS n_tokens, count(*) FILTER (topic <> new_topic) AS n_changes, count(*) FILTER (topic <> new_topic AND accept >= 1) AS n_certain, round(sum(accept) FILTER (topic <> new_topic), 2) AS expected FROM ("
        + (acc % (f"(ws + CAST({b} AS DOUBLE)) * (nt_ + vb)", f"(wt + CAST({b} AS DOUBLE)) * (ns + vb)")).replace("round(least(1.0, up / down), 6) AS accept", "topic, least(1.0, up / down) AS accept").replace("FROM (SELECT doc_id, pos, new_topic, ", "FROM (SELECT doc_id, pos, topic, new_topic, ").replace("SELECT m.doc_id, m.pos, m.new_topic, ", "SELECT m.doc_id, m.pos, m.topic, m.new_topic, ")
        + ")",
        "corpus_llh": corpus,
        "topic_report": f"SELECT topic || chr(9) || string_agg(word || ':' || printf('%.6f', prob), ' ' ORDER BY rank) AS line FROM rep WHERE rank <= {TOP} GROUP BY topic",
        "dump_summary": "SELECT string_agg(topic || ':' || cnt, ' ' ORDER BY topic) AS line FROM nt",
        "doc_llh": f"SELECT doc_id, round({e(k * c.ll_alpha) - k * e(c.ll_alpha)!r} + {d} * ({e(c.ll_alpha)!r}) - {_llg(f'nd + {k * c.ll_alpha!r}::DOUBLE')}, 3) AS llh FROM (SELECT doc_id, sum({_llg(f'cnt + {c.ll_alpha}::DOUBLE')}) AS lg, count(*) AS nnz, sum(cnt) AS nd FROM ntd GROUP BY doc_id)",
        "word_llh": f"SELECT word_id, round({d} * ({e(b)!r}), 3) AS llh FROM (SELECT word_id, sum({_llg(f'cnt + {b}::DOUBLE')}) AS lg, count(*) AS nnz FROM ntw GROUP BY word_id)",
        "llh_normalizer": f"SELECT round({k} * (lv - v * ({e(b)!r})) - lg - ({k} - nnz) * lv, 2) AS normalizer FROM (SELECT any_value(v) AS v, any_value({_llg(f'v * {b}::DOUBLE')}) AS lv, sum({_llg(f'cnt + v * {b}::DOUBLE')}) AS lg, count(*) AS nnz FROM nt CROSS JOIN nv)",
        "topic_words": "SELECT topic, rank, word, cnt FROM rep",
        "topic_word_prob": "SELECT topic, word, round(prob, 9) AS prob FROM rep",
        "dump_text": "SELECT word_id || ' ' || string_agg(topic || ':' || cnt, ' ' ORDER BY topic) AS line FROM ntw GROUP BY word_id",
        "dump_parse": "SELECT * FROM ntw",
        "infer_conservation": f"SELECT item_id AS doc_id, CAST(least({c.max_tokens}, count(*)) AS BIGINT) AS n_tokens FROM (SELECT item_id, unnest({words}) AS word FROM benchmark) JOIN ids USING (word) GROUP BY item_id",
        "train_step_conservation": "SELECT word_id, count(*) AS n_tokens FROM enc GROUP BY word_id",
    }
    out = {n: f"WITH RECURSIVE {mat} {q}" for n, q in ends.items()}
    part = _sampling(c)
    more = f"WITH RECURSIVE {mat}, {', '.join(f'{n} AS MATERIALIZED ({q})' for n, q in _tables(c))}"
    out["alias_table"] = f"{more} SELECT word_id, topic, round(w::DOUBLE / m, 9) AS prob FROM exc WHERE word_id >= 0"
    out |= {"propose_topics": f"{more} {part['alone'] % 't0'}", "mh_chain": f"{more} {part['alone'] % 'cur'}"}
    final = "SELECT doc_id, unnest(ws) AS word_id, unnest(z) AS topic FROM s WHERE r = total"
    out["train_step"] = f"{more}, {part['swept']} SELECT word_id, topic, count(*) AS cnt FROM ({final}) GROUP BY word_id, topic"
    both = f"SELECT unnest(s.z) AS new, unnest(p.z) AS old FROM s JOIN pck p USING (doc_id) WHERE s.r = s.total"
    out["throughput"] = (
        f"{more}, {part['swept']}, b AS MATERIALIZED ({both}) SELECT topic, (SELECT count(*) FROM b WHERE old = topic) AS tokens_before, (SELECT count(*) FROM b WHERE new = topic) AS tokens_after, "
        "(SELECT count(*) FROM b WHERE new = topic AND old <> new) AS moved_in, (SELECT count(*) FROM b WHERE old = topic AND old <> new) AS moved_out FROM ks"
    )
    return out


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked words per topic, from raw documents."""
    return QUERIES["topic_words"](spark, sf_dir)
