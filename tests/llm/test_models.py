"""Whitening, spelling variants, language-model scores, and ends that are not silent."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from topicloom.llm import bpe, gru, langid, lm, mixing, sharding, spelling, whitening

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "clash") for i, v in rows], "vec_id long, embedding array<float>, n int, component string")


@pytest.mark.parametrize("n", [1, 2, 3, 17, 40])
def test_symmetric_qr(n):
    rng = np.random.default_rng(n)
    q = np.linalg.qr(rng.normal(size=(n, n)))[0]
    for values in (rng.normal(size=n), np.r_[np.ones(n - n // 2), np.zeros(n // 2)]):
        a = q * values @ q.T
        got, basis = whitening.symmetric_qr((a + a.T) / 2)
        assert np.allclose(got, np.sort(values)[::-1], atol=1e-12) and np.allclose(basis.T @ basis, np.eye(n), atol=1e-12)
        assert np.allclose(a @ basis, basis * got, atol=1e-12)


def test_moments_are_merged_exactly():
    x = np.random.default_rng(1).normal(1e4, 1, size=(300, 5))
    whole = whitening.Moments(5)
    for lo, hi in ((0, 1), (1, 1), (1, 170), (170, 300)):
        part = whitening.Moments(5)
        for row in x[lo:hi]:
            part.add(row)
        if part.n:
            whole.merge(part)
    assert whole.n == 300 and np.allclose(whole.covariance(), np.cov(x.T, bias=True), rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("parts", [1, 40])
def test_whitening_against_numpy(spark, parts):
    rng = np.random.default_rng(2)
    good = [(i, rng.normal(0.3, 0.5, 6).astype(np.float32).tolist()) for i in range(90)] + [(None, [0.0] * 6), (7, [-0.0, 1.0, 0.0, 0.0, 0.0, 0.5])]
    rows = [*good, *good[:30], (500, None), (501, [1.0] * 5 + [None]), (502, [float("nan")] * 6), (503, [float("inf")] + [0.0] * 5), (504, [])]
    got = whitening.whiten(vectors(spark, rows).repartition(parts)).collect()
    x = np.array([np.floor(256 * np.array(v, float)) for _, v in [*good, *good[:30]]]).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, total = len(fit), fit.sum(0)
    e, q = np.linalg.eigh(np.cov(fit.T, bias=True))
    e, q = e[::-1], q[:, ::-1]
    want = Counter((i, k + 1, int(((n * r - total) ** 2).sum()), round(abs(float((r - total / n) @ q[:, k] / np.sqrt(e[k]))), 8)) for (i, _), r in zip([*good, *good[:30]], x, strict=True) for k in range(4))
    assert Counter((r.vec_id, r.component, r.deviation, round(abs(r.whitened), 8)) for r in got) == want
    assert all(r.n == n and r.identity_error < 1e-9 and r.explained == pytest.approx(e[r.component - 1] / e.sum()) for r in got)


def test_whitening_odd(spark):
    df = vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [2.0, 4.0]), (4, None)])
    assert {(r.vec_id, r.component) for r in whitening.whiten(df).collect()} == {(1, 1), (2, 1), (3, 1)}  # one direction varies
    assert whitening.whiten(df.limit(0)).count() == 0 and whitening.whiten(df.filter("vec_id < 3")).count() == 0
    with pytest.raises(ValueError, match="dimensions"):
        whitening.whiten(vectors(spark, [(1, [1.0]), (2, [1.0, 2.0])]))
    big = [(1, [1e15, 0.0]), (2, [-1e15, 1.0]), (3, [1e30, 0.0])]
    assert {(r.vec_id, r.deviation) for r in whitening.whiten(vectors(spark, big)).collect()} == {(1, None), (2, None)}


def variants(texts):
    n = Counter()
    for i, t in texts:
        for w in re.findall(spelling.RUN, t or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            n[w if h % 199 else w[: h % len(w)] + w[h % len(w) + 1 :]] += 1
    n = {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}

    def near(a, b):
        if abs(len(a) - len(b)) > 1 or a == b:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    close = {a: [b for b in n if near(a, b)] for a in n}
    form = {a: f for a, bs in close.items() if bs and n[f := min(bs, key=lambda b: (-n[b], b))] >= 5 * n[a]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), c, len(close[w]), n.get(form.get(w))) for w, c in n.items())


def damaged_words(seed):
    rng = np.random.default_rng(seed)
    letters = "etaonéÀÿ÷b"
    stems = ["".join(rng.choice(list(letters), rng.integers(6, 10))) for _ in range(25)]
    out = []
    for i in range(60):
        said = []
        for _ in range(250):
            w = stems[min(int(rng.exponential(4)), 24)]
            k = rng.integers(len(w))
            said.append((w[:k] + rng.choice(list(letters)) + w[k + rng.integers(2) :]) if rng.random() < 0.15 else w.upper() if rng.random() < 0.1 else w)
        out.append((i, rng.choice([" ", "1", "_-"]).join(said)))
    return out


def test_spelling_against_brute_force(spark):
    texts = [*damaged_words(3), (None, "letter " * 40), (61, None), (62, ""), (63, "l" * 20_000 + " "), (65, "stepaa " * 6 + "stepab " * 40 + "stepbb " * 300), *[(64, "lettre lettr lettres " + "l" * 20_000)] * 6]
    docs = spark.createDataFrame([(i, t, "x", 3) for i, t in texts], "doc_id long, text string, word string, n int")
    want = variants(texts)
    assert len(want) > 60 and sum(f is not None for _, f, *_ in want) > 20 and any(r != f for _, f, r, *_ in want if f)
    for salt_words in (spelling.SALT_WORDS, 20):
        assert sorted(map(tuple, spelling.group_variants(docs, salt_words=salt_words).collect()), key=lambda r: r[0]) == want
    assert spelling.group_variants(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        spelling.group_variants(docs, least_letters=5)


def test_roots_follow_long_chains(spark):
    links = spark.createDataFrame([(f"w{i:02}", f"w{i + 1:02}") for i in range(20)], "word string, form string")
    assert {r.word: r.root for r in spelling.roots(links).collect()} == {f"w{i:02}": "w20" for i in range(20)}


def network(rng, words=9, rare=3):
    net = gru.Network(words, rare, 4, rng.integers(1, 50, words + rare), state=5)
    for n in net.names:
        a = getattr(net, n).astype(np.float64)
        setattr(net, n, np.where(a < -1e8, a, a + rng.normal(0, 0.3, a.shape)))
    return net


def test_gradients(monkeypatch):
    """Of every parameter, against differences of the log-likelihood; documents start inside the window."""
    monkeypatch.setattr(gru, "_F", np.float64)
    rng = np.random.default_rng(4)
    net = network(rng)
    docs = [rng.integers(0, 12, n).astype(np.uint16) for n in (5, 3, 7, 1, 2)]
    (before, target, fresh, valid, _), *rest = gru.windows(docs, net.start, 2, 16)
    assert not rest and fresh.sum() == 5
    state = np.zeros((2, 5))
    whole = lambda: net.output(net.advance(before, fresh, state)[0].reshape(-1, 5)[valid.ravel()], target.ravel()[valid.ravel()]).sum()
    _, grads = net.gradients(before, target, fresh, valid, net.advance(before, fresh, state))
    rows, g = grads["enter"]
    grads["enter"] = np.zeros_like(net.enter)
    grads["enter"][rows] = g
    for name in net.names:
        a = getattr(net, name)
        for at in [tuple(rng.integers(s) for s in a.shape) for _ in range(12)]:
            if a[at] < -1e8:
                continue
            keep, step = a[at], 1e-5
            a[at] = keep + step
            up = whole()
            a[at] = keep - step
            down = whole()
            a[at] = keep
            assert -grads[name][at] == pytest.approx((up - down) / (2 * step), abs=1e-5), name


def test_state_is_carried_and_probabilities_sum_to_one():
    rng = np.random.default_rng(5)
    net = network(rng)
    for n in net.names:
        setattr(net, n, getattr(net, n).astype(np.float32))
    docs = [rng.integers(0, 12, int(n)).astype(np.uint16) for n in rng.integers(1, 90, 40)] + [rng.integers(0, 12, 900).astype(np.uint16)]
    want = gru.score(net, docs, 1, 10_000)
    for lanes, window in ((3, 4), (64, 16), (7, 1)):
        assert np.allclose(gru.score(net, docs, lanes, window), want, rtol=1e-4, atol=1e-3)
    for d in docs[:5]:
        one = np.array([gru.score(net, [np.append(d, x).astype(np.uint16)])[0] for x in range(12)])
        assert np.exp(one - gru.score(net, [d])[0]).sum() == pytest.approx(1, abs=1e-3)
    symbols = lm.Symbols([(5, 90), (3, 80)], {0: (3, 3), 1: (2, 5), 3: (1, 9)}, 1)
    counts = np.array([90, 80, 1, 1, 1, 2, 3, 9, 0])
    symbol, share = symbols.of(np.array([5, 3, 11, 12, 13, 14, 15, 16, 17]), counts)
    assert symbol.tolist() == [0, 1, 2, 2, 2, 3, 3, 5, 2]
    assert [np.exp(share[symbol == s]).sum() for s in (2, 3, 5)] == pytest.approx([1, 1, 1])


def test_scores(spark):
    """Counts and base scores as written out; the model learns what follows what, on texts it has not seen."""
    rng = np.random.default_rng(6)
    texts = []
    for i in range(400):
        lang = rng.integers(2)
        words = [f"{'Ab'[lang]}{rng.integers(40)}" for _ in range(rng.integers(20, 60))]
        texts.append((i, " ".join(words)))
    odd = [(None, "null\tid a1"), (900, None), (901, ""), (902, "né  B1 x"), (7, "again A1 rare"), (7, "again A1 rare"), (903, "b1 " * 20_000)]
    rows = texts + odd
    docs = spark.createDataFrame([(i, t, 5.0, True) for i, t in rows], "doc_id long, text string, score double, held_out boolean")
    got = lm.score_documents(docs.repartition(5)).collect()
    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 5 == 1
    tokens = [(i, [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)), None]) for i, t in rows]
    count = Counter(w for i, ws in tokens if not held(i) for w in ws)
    n, v = sum(count.values()), len(count)
    base = lambda ws: sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
    want = sorted((-1 if i is None else i, held(i), len(ws), sum(w in count for w in ws), n, round(base(ws), 4)) for i, ws in tokens)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    unseen = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 400]
    assert len(unseen) > 50 and sum(r.score for r in unseen) > 0.97 * sum(r.base_score for r in unseen) and all(r.score < 0 for r in got)
    assert lm.score_documents(docs.limit(0)).count() == 0
    alone = lm.score_documents(docs.filter(F.col("doc_id").isin([i for i, _ in texts if held(i) and i != 7][:3]))).collect()
    assert len(alone) == 3 and all(r.score == r.base_score == r.n_known == r.train_tokens == 0 for r in alone)


def test_a_common_tail(spark):
    """With few frequent words, all others are classes by their count, and what is scored stays a probability."""
    rng = np.random.default_rng(7)
    docs = spark.createDataFrame([(i, " ".join(f"w{int(rng.pareto(0.7))}" for _ in range(40))) for i in range(150)], "doc_id long, text string")
    got = lm.score_documents(docs, frequent=8, per_class=3).collect()
    assert sum(r.score for r in got) > sum(r.base_score for r in got) * 1.1 and all(r.score < 0 for r in got)
    _, symbols, _ = lm.encode(docs.withColumn("held_out", F.lit(False)), 8)
    assert symbols.n_top == 8 and symbols.n_bins > 2


def test_ends_are_not_silent(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "a b c " * (i % 7 + 1), f"s{i % 3}") for i in range(60)], "doc_id long, text string, source string")
    monkeypatch.setattr(mixing, "MAX_STEPS", 1)
    with pytest.raises(RuntimeError, match="did not settle"):
        mixing.mix(docs)
    monkeypatch.setattr(sharding, "MOST_MOVES", 0)
    with pytest.raises(RuntimeError, match="not balanced"):
        sharding.rebalance({i: 0 for i in range(8)}, {i: 10 + i for i in range(8)}, 2)
    from public_tokenizers import path

    with pytest.raises(ValueError, match="byte-level"):
        bpe.Encoder(path("word_bpe_49k.json"))


def test_languages_that_tie(spark):
    """Equal texts under two labels: the smaller name; nothing is lost."""
    rows = [(i, "the same words in both", "b" if i % 2 else "a") for i in range(60)]
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string").filter("doc_id % 4 < 4")).collect()
    assert len(got) == 60 and {r.score > 0 for r in got} == {True}
    m = langid.Model(["a", "b"], np.array([0, 1]), np.array([97, 97]), np.array([3.0, 3.0]))
    out = langid.predict(spark.createDataFrame([(1, "aaa")], "doc_id long, text string"), m).first()
    assert out.lang_pred == "a" and out.score == pytest.approx(0.5)
