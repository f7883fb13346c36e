"""Near-duplicate texts by order min-hash and banded alignment.

Sketches are taken on a text's five-word shingles, each labelled by its occurrence: a
sketch takes the two labelled shingles with the smallest hashes and keeps them in text
order, so it is sensitive to edits and to order; sixteen sketches are sixteen chances
to meet.  Candidates are verified by banded alignment of their words: with m the words
of the longest common order, m / (|a| + |b| - m) must reach the similarity, 0.8.

A pair with a similarity of 0.8 or more in five-word shingles has a higher one in
words, so it links; it fails to meet with probability below 1e-6.  Texts with scattered
edits keep fewer shingles than words: a pair that shares half of its shingles
fails to meet with probability about 0.01, one that shares a third with 0.15.

Texts with equal words are collapsed first and only one of each class goes on.  The
members of a bucket (one sketch value) are then verified against the bucket's most
connected text: one pair each, not all pairs, which joins dense groups.  Where a
bucket still spans several components, all its pairs between different components
are looked at in tiles: by length and by word counts in ``BINS`` bins (a bound that
loses nothing), then by the words they share, then by alignment.

Texts that met others are laid out once as hashes of their words, by id; every later
step reads that table, whatever the size of the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topicloom.llm.common import bounded_batches, cut, lean, passing, salted_join
from topicloom.llm.graph import connected_components
from topicloom.llm.langid import _texts
from topicloom.llm.shingles import FULL, SKETCHES, Centre, Sketched, label, needed, word_hashes

SIMILARITY = 0.8
TILE = 640
STAR = 256
CHUNK = 1 << 19


def sketches(docs: DataFrame) -> DataFrame:
    """``id, text`` -> ``id, d1, d2, n, keys, bins`` for texts with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, start = _texts(b.column(1))
            lo = 0
            while lo < b.num_rows:
                hi = max(lo + 1, int(np.searchsorted(start, start[lo] + CHUNK, side="right")) - 1)
                s = Sketched(data[start[lo] : start[hi]], start[lo : hi + 1] - start[lo])
                digest = np.frombuffer(b"".join(s.digest), np.int64).reshape(-1, 2)
                keys = pa.ListArray.from_arrays(pa.array(np.arange(len(s.own) + 1) * SKETCHES, pa.int32()), pa.array(s.keys.ravel()))
                cols = [b.column(0).slice(lo, hi - lo).take(pa.array(s.own)), pa.array(digest[:, 0].copy()), pa.array(digest[:, 1].copy()), pa.array(s.n), keys, pa.array(s.bins, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["id", "d1", "d2", "n", "keys", "bins"])
                lo = hi

    return docs.mapInArrow(lean(run), "id long, d1 long, d2 long, n long, keys array<long>, bins binary")


def _possible(na: np.ndarray, nb: np.ndarray, ba: np.ndarray, bb: np.ndarray, least: float) -> np.ndarray:
    """Whether counts allow ``least``: matches cannot exceed the sum of smaller bin counts."""
    need = needed(na, nb, least)
    full = (ba == FULL).any(1) | (bb == FULL).any(1)
    return (need <= np.minimum(na, nb)) & (full | (np.minimum(ba, bb).sum(1, dtype=np.int64) >= need))


def _bins(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), -1)


def prune(pairs: DataFrame, stats: DataFrame, least: float) -> DataFrame:
    """Pairs ``hub, rep`` that their counts allow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                na, nb = b.column("na").to_numpy(), b.column("nb").to_numpy()
                ok = _possible(na, nb, _bins(b.column("ba")), _bins(b.column("bb")), least)
                yield b.select(["hub", "rep"]).filter(pa.array(ok))

    one = stats.select(F.col("rep").alias("hub"), F.col("n").alias("na"), F.col("bins").alias("ba"))
    two = stats.select("rep", F.col("n").alias("nb"), F.col("bins").alias("bb"))
    return pairs.join(one, "hub").join(two, "rep").select("hub", "rep", "na", "nb", "ba", "bb").mapInArrow(lean(run), "hub long, rep long")


def word_table(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """``id, words``: packed 64-bit hashes of the words of the texts named by ``ids``; cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, start = _texts(b.column(1))
            lo = 0
            while lo < b.num_rows:
                hi = max(lo + 1, int(np.searchsorted(start, start[lo] + CHUNK, side="right")) - 1)
                words, before = word_hashes(data[start[lo] : start[hi]], start[lo : hi + 1] - start[lo])
                own = [words[before[i] : before[i + 1]].tobytes() for i in range(hi - lo)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(own, pa.binary())], ["id", "words"])
                lo = hi

    asked = docs.join(ids.hint("shuffle_hash"), "id", "left_semi")
    return cut(asked.select("id", "text").mapInArrow(lean(run), "id long, words binary").dropDuplicates())


def verify(pairs: DataFrame, words: DataFrame, least: float) -> DataFrame:
    """Pairs ``hub, rep`` -> those whose alignment reaches ``least``, as ``src, dst``.

    A hub's members are dealt to groups of about ``STAR``, each with its own row of
    the hub's words; a group streams through one task, which holds the hub's words.
    """
    sizes = pairs.groupBy("hub").agg(F.ceil(F.count("*") / STAR).cast("int").alias("groups"))
    hubs = sizes.select("hub", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"), F.col("hub").alias("id"))
    members = salted_join(pairs, sizes, "hub", "rep").select("hub", F.pmod(F.xxhash64("rep"), F.col("groups")).cast("int").alias("group"), F.col("rep").alias("id"))
    rows = hubs.unionByName(members).join(words, "id")
    rows = rows.withColumn("member", F.col("id") != F.col("hub")).repartition("hub", "group").sortWithinPartitions("hub", "group", "member")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, centres = None, []
        for b in batches:
            out: list[tuple[int, int]] = []
            hub, group, ids = (b.column(c).to_pylist() for c in ("hub", "group", "id"))
            for i, packed in enumerate(b.column("words").to_pylist()):
                own = np.frombuffer(packed, np.uint64)
                if ids[i] == hub[i]:
                    if key != (hub[i], group[i]):
                        key, centres = (hub[i], group[i]), []
                    centres.append(Centre(own))
                elif key == (hub[i], group[i]) and any(c.similarity(own, least) for c in centres):
                    out.append((hub[i], ids[i]))
            cols = list(zip(*out, strict=True)) or [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64())], ["src", "dst"])

    return rows.select("hub", "group", "id", "words").mapInArrow(lean(run), "src long, dst long").distinct()


def _tiled(rows: DataFrame, block, schema: str, *cols: str) -> DataFrame:
    """Run ``block`` on the rows of each (key, a, b), which meet sorted in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for b in batches:
            if not b.num_rows:
                continue
            keys = np.stack([b.column(c).to_numpy() for c in ("key", "a", "b")], 1)
            starts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1), len(keys)]
            for lo, hi in zip(starts[:-1], starts[1:], strict=True):
                if tuple(keys[lo]) != last and held:
                    yield from block(pa.Table.from_batches(held))
                    held = []
                last = tuple(keys[lo])
                held.append(b.slice(lo, hi - lo))
        if held:
            yield from block(pa.Table.from_batches(held))

    x = rows.select("key", "a", "b", "side", "rep", "label", "n", *cols)
    return x.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b").mapInArrow(lean(run), schema)


def _meets(side: np.ndarray, lab: np.ndarray, n: np.ndarray, least: float) -> np.ndarray:
    """Which rows of a tile may pair: other labels, the right sides, near enough lengths."""
    need = needed(n[:, None], n[None, :], least)
    ok = (lab[:, None] != lab[None, :]) & (need <= np.minimum(n[:, None], n[None, :]))
    return ok & (side[:, None] != side[None, :]) if (side != 2).any() else ok


def shared(lists: list[np.ndarray]) -> np.ndarray:
    """How many entries each two lists of distinct values share."""
    out = np.zeros((len(lists), len(lists)), np.float32)
    flat = np.concatenate(lists)
    _, where, count = np.unique(flat, return_inverse=True, return_counts=True)
    rows = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    column = np.cumsum(count > 1) - 1
    keep = count[where] > 1
    rows, cols = rows[keep], column[where[keep]]
    for lo in range(0, int((count > 1).sum()), 8192):
        own = (cols >= lo) & (cols < lo + 8192)
        m = np.zeros((len(lists), 8192), np.float32)
        m[rows[own], cols[own] - lo] = 1
        out += m @ m.T
    return out


def _cross(buckets: DataFrame, words: DataFrame, least: float) -> DataFrame:
    """Pairs of a bucket's members with different labels that may link: ``hub, rep``.

    Counts in bins first find the members of each tile that have a possible partner
    at all; only for these the words themselves are compared, in blocks, and pairs that
    share enough of them, each as often as in both, are left for alignment.
    """
    tiles = buckets.groupBy("key").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    x = salted_join(buckets, tiles, "key", "rep").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int"))
    x = x.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    x = x.withColumn("a", F.least("own", "other")).withColumn("b", F.greatest("own", "other"))
    x = x.withColumn("side", F.when(F.col("a") == F.col("b"), 2).when(F.col("own") == F.col("a"), 0).otherwise(1))
    kept = ["key", "a", "b", "side", "rep", "label", "n"]

    def partners(t: pa.Table) -> Iterator[pa.RecordBatch]:
        lab, n, side = (t.column(c).to_numpy() for c in ("label", "n", "side"))
        bins = _bins(t.column("bins"))
        may, some = _meets(side, lab, n, least), np.zeros(len(t), bool)
        for i in range(len(t)):
            j = np.flatnonzero(may[i] & ~some) if some[i] else np.flatnonzero(may[i])
            j = j[j > i]
            if len(j):
                ok = j[_possible(np.full(len(j), n[i]), n[j], np.broadcast_to(bins[i], (len(j), bins.shape[1])), bins[j], least)]
                some[ok] = True
                some[i] |= len(ok) > 0
        yield from t.select(kept).filter(pa.array(some)).combine_chunks().to_batches()

    def pairs(t: pa.Table) -> Iterator[pa.RecordBatch]:
        rep, lab, n, side = (t.column(c).to_numpy() for c in ("rep", "label", "n", "side"))
        lists = [np.unique((label(np.frombuffer(v, np.uint64)) >> np.uint64(32)).astype(np.uint32)) for v in t.column("words").to_pylist()]
        # Labelled words that fall on one 32-bit value count once there: they may all match.
        lost = n - np.array([len(x) for x in lists])
        need = needed(n[:, None], n[None, :], least)
        i, j = np.nonzero(np.triu(_meets(side, lab, n, least) & (shared(lists) + np.minimum(lost[:, None], lost[None, :]) >= need), 1))
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(rep[i], rep[j])), pa.array(np.maximum(rep[i], rep[j]))], ["hub", "rep"])

    active = cut(_tiled(x, partners, "key long, a int, b int, side int, rep long, label long, n long", "bins"))
    # An id that names several texts has each of them here; n tells which is meant.
    listed = words.select(F.col("id").alias("rep"), "words", (F.octet_length("words") / 8).cast("long").alias("n"))
    return _tiled(active.join(listed, ["rep", "n"]), pairs, "hub long, rep long", "words").distinct()


def _whole_ids(docs: DataFrame, id_col: str) -> None:
    if not isinstance(kind := docs.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"{id_col} must be an integer column, not {kind.simpleString()}")


def near_duplicates(docs: DataFrame, id_col="doc_id", text_col="text", least: float = SIMILARITY) -> DataFrame:
    """``doc_id, component_id, kept`` for every row of ``docs``.

    ``component_id`` is the smallest doc_id reachable by links of similarity ``least``
    or more; ``kept`` marks one id per component.  Texts with fewer than five words are
    one shingle and link only with texts of equal words.  Null and empty texts, texts
    of white space and rows with a null id link with nothing.  Repeated rows share a
    component; rows that give one id to several texts join their components.  Other
    columns are not read; an empty table gives no rows; ids that are no integers are
    an error.
    """
    _whole_ids(docs, id_col)
    rows = bounded_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    usable = rows.filter(F.col("id").isNotNull() & F.col("text").isNotNull())
    seen = cut(sketches(usable))
    classes = seen.groupBy("d1", "d2").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("bins").alias("bins"))
    classes = cut(classes)
    stats = classes.select("rep", "n", "bins")
    values = classes.select("rep", F.posexplode("keys").alias("k", "v")).select("rep", F.xxhash64("k", "v").alias("key"))
    sizes = values.groupBy("key").agg(F.count("*").alias("size"))
    buckets = cut(salted_join(values, sizes.filter("size > 1"), "key", "rep"))
    degree = buckets.groupBy("rep").agg(F.sum(F.col("size") - 1).alias("degree"))
    ranked = buckets.join(degree, "rep").select("key", "rep", F.struct("degree", (-F.col("rep")).alias("r")).alias("rank"))
    centre = ranked.groupBy("key").agg((-F.max("rank")["r"]).alias("hub"))
    starred = cut(salted_join(buckets, centre, "key", "rep").select("key", "rep", "hub"))
    pairs = cut(prune(starred.filter("rep <> hub").select("hub", "rep").distinct(), stats, least))
    words = word_table(starred.select(F.col("rep").alias("id")).distinct(), usable)
    links = cut(verify(pairs, words, least))
    labels = connected_components(links).select(F.col("node").alias("rep"), "component")
    marked = starred.join(labels, "rep", "left").select("key", "rep", "hub", F.coalesce("component", "rep").alias("label"))
    rest = marked.filter("rep <> hub")
    open_ = rest.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("key")
    crossing = _cross(salted_join(rest, open_, "key", "rep").join(stats, "rep"), words, least)
    more = cut(verify(cut(crossing), words, least))
    comps = connected_components(links.unionByName(more))
    members = seen.select("id", "d1", "d2").join(classes.select("d1", "d2", "rep"), ["d1", "d2"]).join(comps, F.col("rep") == F.col("node"), "left")
    members = members.groupBy("id").agg(F.min(F.coalesce("component", "rep")).alias("component_id"))
    out = rows.select("id").join(members, "id", "left")
    component: Column = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias("doc_id"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def deduplicate(docs: DataFrame, id_col="doc_id", text_col="text", least: float = SIMILARITY) -> DataFrame:
    """Rows of ``docs`` with one document of each group left, all columns as they were.

    Of rows that repeat an id with an equal text one stays, the first by its columns
    written as JSON; rows with a null id, which are in no group, all stay, as do null
    and empty texts.
    """
    with passing(docs.sparkSession):
        found = near_duplicates(docs, id_col, text_col, least)
        gone = cut(found.filter(~F.col("kept")).select(F.col("doc_id").alias("__gone")).distinct(), keep=True)
    # Ids that go grow with the corpus: they are joined like any table, at every size.
    left = docs.join(gone, F.col(id_col).cast("long") == F.col("__gone"), "left_anti")
    ids = docs.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__twice")).agg(F.count("*").alias("n"))
    twice = cut(ids.filter("n > 1").select("__twice"))
    if twice.isEmpty():
        return left
    on = F.col(id_col) == F.col("__twice")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    again = left.join(twice, on, "left_semi").select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), whole.alias("row"))
    first = again.groupBy("__id", "__text").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row.*")
    return left.join(twice, on, "left_anti").unionByName(first)
