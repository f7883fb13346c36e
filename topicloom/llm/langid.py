"""Language identification by prediction by partial matching over bytes.

Each language has a context tree: for every context of up to ``ORDER`` bytes the
counts of the byte that follows.  The code length of a byte starts at its longest
context; a byte seen there costs -log2(count / (total + distinct)), any other costs
the escape -log2(distinct / (total + distinct)) and is coded in the next shorter
context, from which the bytes already ruled out are excluded; the last resort is a
uniform byte.  The statistics are frozen after training, so every (context, byte)
has one exact cost per language.  They are kept sparse: per language the counts of
the bytes seen in a context, and a few numbers per context.  As a byte seen in a
context is seen in all shorter ones, what a shorter context excludes is what the next
longer one has seen, so these give the exact cost of unseen bytes, too.  A text is
scored by its distinct (context, byte) pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.llm.common import bounded_batches, lean, send

ORDER = 3
#: Training texts per language at most, in expectation; the sample is by hash of the id.
SAMPLE_PER_LANG = 2000
UNKNOWN = "und"
CHUNK = 1 << 19


def held_out(id_col: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and where each text starts and ends; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    data, start = column.buffers()[2], np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), start


def _grams(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each byte: it and the ``ORDER`` bytes before it in its text (zeros before its start)."""
    n = len(data)
    out = data.astype(np.uint32)
    since = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
    for k in range(1, ORDER + 1):
        before = np.zeros(n, np.uint32)
        before[k:] = data[:-k] if n > k else data[:0]
        before[since < k] = 0
        out |= before << np.uint32(8 * k)
    return out


def count_grams(labelled: DataFrame) -> DataFrame:
    """``lang, text`` -> ``lang, gram, n``: bytes with their contexts, summed over the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs = np.array(b.column(0).to_pylist(), object)
            data, start = _texts(b.column(1))
            for lang in sorted(set(langs)):
                own = [i for i in np.flatnonzero(langs == lang) if start[i + 1] > start[i]]
                if own:
                    sizes = np.array([start[i + 1] - start[i] for i in own])
                    grams = _grams(np.concatenate([data[start[i] : start[i + 1]] for i in own]), np.cumsum(sizes) - sizes)
                    key, n = np.unique(grams, return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(key)), pa.array(key.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"]
                    )

    counted = labelled.select("lang", "text").mapInArrow(lean(run), "lang string, gram long, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``wanted`` in sorted ``keys``, and which are there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _suffix(context: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` latest bytes of contexts."""
    return context & np.asarray((1 << (8 * k)) - 1, context.dtype)


class Tree:
    """Frozen counts of one language, by length of context.

    ``contexts[k]``: contexts of length k, sorted; ``start[k]``, ``escape[k]``: bits of
    a context's denominator and of its escape, if coding starts there; ``start_below``,
    ``escape_below``: those of the next shorter context after an escape from this one;
    ``grams[k]``, ``gain[k]``: (context, byte), sorted, and the log of its count.
    """

    def __init__(self, contexts: list[np.ndarray], gram: np.ndarray, n: np.ndarray):
        self.contexts, self.grams, self.gain = [], [], []
        self.start, self.escape, self.start_below, self.escape_below = [], [], [], []
        for k in range(ORDER + 1):
            key, where = np.unique(_suffix(gram, k + 1), return_inverse=True)
            count = np.bincount(where, n, len(key))
            own = _find(contexts[k], key >> 8)[1]
            key, count = key[own], count[own]
            c, where = np.unique(key >> 8, return_inverse=True)
            total, distinct = np.bincount(where, count, len(c)), np.bincount(where, minlength=len(c)).astype(float)
            if k:
                # What is left of the shorter context without the bytes seen here.
                at = _find(before[0], _suffix(c, k - 1))[0]
                same = _find(before[3], _suffix(key, k))[0]
                rest = before[1][at] - np.bincount(where, before[4][same], len(c)), before[2][at] - distinct
            else:
                rest = np.zeros(len(c)), 256 - distinct
            for into, (t, d) in (((self.start, self.escape), (total, distinct)), ((self.start_below, self.escape_below), rest)):
                whole = np.log2(np.maximum(t + d, 1))
                into[0].append(whole.astype(np.float32))
                into[1].append(np.where(d > 0, whole - np.log2(np.maximum(d, 1)), 0).astype(np.float32))
            if not k:  # below the empty context each byte left costs the same; nothing escapes
                self.start_below[0] = np.log2(np.maximum(256 - distinct, 1)).astype(np.float32)
            self.contexts.append(c.astype(np.uint32))
            self.grams.append(key.astype(np.uint32))
            self.gain.append(np.log2(count).astype(np.float32))
            before = c, total, distinct, key, count

    def costs(self, gram: np.ndarray) -> np.ndarray:
        """Bits of bytes in their contexts, as ``_grams`` gives them."""
        out = np.zeros(len(gram))
        open_ = np.ones(len(gram), bool)  # not coded yet
        longer = np.full(len(gram), -1)  # place of the context escaped from
        for k in range(ORDER, -1, -1):
            at, there = _find(self.contexts[k], _suffix(gram >> np.uint32(8), k))
            use = np.flatnonzero(open_ & there)
            if not len(use):
                continue
            at, came = at[use], longer[use]
            begins = came < 0
            up = np.maximum(came, 0)
            spot, seen = _find(self.grams[k], _suffix(gram[use], k + 1))
            above = k + 1 if k < ORDER else k
            start, escape = self.start[k][at], self.escape[k][at]
            if not begins.all():
                start = np.where(begins, start, self.start_below[above][up])
                escape = np.where(begins, escape, self.escape_below[above][up])
            out[use] += np.where(seen, start - self.gain[k][spot], escape)
            open_[use[seen]] = False
            longer[use] = at
        # In a tree with any text the empty context is there.
        last = np.flatnonzero(open_)
        out[last] += self.start_below[0][0] if len(self.contexts[0]) else 8.0
        return out


class Model:
    """Frozen context trees of all languages.

    All contexts of the sample are used, however rare; there is no bound on their number.
    """

    def __init__(self, langs: list[str], lang: np.ndarray, gram: np.ndarray, n: np.ndarray):
        self.langs = langs
        gram = gram.astype(np.int64)
        self.contexts = [np.zeros(1, np.int64)]
        for k in range(1, ORDER + 1):
            self.contexts.append(np.unique(_suffix(gram >> 8, k)))
        order = np.argsort(lang, kind="stable")
        ends = np.searchsorted(lang[order], np.arange(len(langs) + 1))
        self.trees = [Tree(self.contexts, gram[own], n[own]) for own in (order[lo:hi] for lo, hi in zip(ends[:-1], ends[1:], strict=True))]

    @property
    def cost(self) -> np.ndarray:
        """Bits by context, byte and language; a dense table, to look at small models."""
        grams = np.concatenate([(c[:, None] << 8 | np.arange(256)).ravel() for c in self.contexts]).astype(np.uint32)
        # A context stands for itself alone: longer ones that its zero bytes could match are not asked.
        size = np.repeat(np.arange(ORDER + 1), [256 * len(c) for c in self.contexts])
        out = np.zeros((len(grams), len(self.trees)))
        for i, t in enumerate(self.trees):
            for k in range(ORDER + 1):
                cut_ = Tree.__new__(Tree)
                cut_.__dict__ = t.__dict__ | {"contexts": [c if x <= k else c[:0] for x, c in enumerate(t.contexts)]}
                out[size == k, i] = cut_.costs(grams[size == k])
        return out.reshape(-1, 256, len(self.trees))

    def bits(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Code length of each text in each language; ``starts`` of non-empty texts in ``data``."""
        gram, where = np.unique(_grams(data, starts), return_inverse=True)
        out = [np.add.reduceat(t.costs(gram)[where], starts) for t in self.trees]
        return np.stack(out, axis=1)

    def score(self, data: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Bits by text and language, over chunks of bounded size."""
        texts = len(start) - 1
        out = np.zeros((texts, len(self.trees)))
        lo = 0
        while lo < texts:
            hi = max(lo + 1, int(np.searchsorted(start, start[lo] + CHUNK, side="right")) - 1)
            own = np.arange(lo, hi)
            own = own[start[own + 1] > start[own]]
            if len(own):
                out[own] = self.bits(data[start[lo] : start[hi]], start[own] - start[lo])
            lo = hi
        return out


def train(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang", per_lang: int = SAMPLE_PER_LANG) -> Model:
    """Fit context trees on labelled rows outside the held-out quarter.

    ``per_lang`` bounds the sample: in expectation so many texts per language, chosen
    by hash of the id, whole texts; languages with fewer are used whole.
    """
    x = bounded_batches(docs).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).filter(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("id"))
    )
    have = {r["lang"]: r["n"] for r in x.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(have)
    draw = F.pmod(F.xxhash64(F.lit("langid"), F.col("id")), F.lit(1 << 20)) / float(1 << 20)
    chosen = F.lit(False)
    for name in langs:
        chosen = chosen | ((F.col("lang") == name) & (draw < per_lang / have[name]))
    rows = count_grams(x.filter(chosen)).toArrow() if langs else None
    number = {name: i for i, name in enumerate(langs)}
    if rows is None or not rows.num_rows:
        return Model([], np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    names = rows.column("lang").combine_chunks().dictionary_encode()
    lang = np.array([number[v] for v in names.dictionary.to_pylist()])[names.indices.to_numpy()]
    return Model(langs, lang, rows.column("gram").to_numpy(), rows.column("n").to_numpy().astype(np.float64))


def predict(docs: DataFrame, model: Model, id_col="doc_id", text_col="text", carry: bool = False) -> DataFrame:
    """``doc_id, lang_pred, score`` for every row, from its whole text alone.

    ``score`` is the posterior of the best language under equal priors, from the code
    lengths.  ``und`` with score 0: null text, no letter in it, or an empty model.
    Ties go to the smaller language name; repeated rows stay repeated; a null id stays
    null; other columns are not read, but with ``carry`` they go along in ``row``.
    """
    spark = docs.sparkSession
    sent = send(spark, (model.langs, model.trees))  # bounded by the sample of texts
    head = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row") if carry else F.col(id_col).alias("doc_id")
    kept = "row" if carry else "doc_id"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model.__new__(Model)
        m.langs, m.trees = sent.value
        names = np.array([*m.langs, UNKNOWN], object)
        for b in batches:
            texts = b.column(1)
            letters = np.array([t.is_valid and any(map(str.isalpha, t.as_py())) for t in texts], bool)
            best, score = np.full(len(texts), len(m.langs)), np.zeros(len(texts))
            if m.langs and len(texts):
                bits = m.score(*_texts(texts))
                first = bits.argmin(1)
                post = 1 / np.exp2(-np.minimum(bits - bits.min(1, keepdims=True), 1000)).sum(1)
                best, score = np.where(letters, first, best), np.where(letters, post, 0.0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names[best].tolist(), pa.string()), pa.array(score)], [kept, "lang_pred", "score"])

    x = bounded_batches(docs).select(head, F.col(text_col).alias("text"))
    kind = x.schema[kept].dataType.simpleString()
    return x.mapInArrow(lean(run), f"{kept} {kind}, lang_pred string, score double")


def identify(docs: DataFrame, **kw) -> DataFrame:
    """Train on ``docs`` and predict all of it: ``doc_id, held_out, lang_pred, score``."""
    model = train(docs, **kw)
    got = predict(docs, model)
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def accept(docs: DataFrame, text_col="text", **kw) -> DataFrame:
    """Rows of ``docs`` whose text has a letter, so that it can be in a language: those not predicted ``und``.

    Code lengths choose a language but reject none: junk in a known script and texts in
    other languages stay.  If nothing could be learned, no row is rejected.
    """
    model = train(docs, text_col=text_col, **kw)
    if not model.langs:
        return docs
    got = predict(docs, model, text_col=text_col, carry=True)
    return got.filter(F.col("lang_pred") != UNKNOWN).select("row.*")
