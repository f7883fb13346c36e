"""Near-duplicate embeddings by spherical-cap filters.

Filter directions are words of random product codes: a random rotation, the space
cut into two halves, a codebook of random unit vectors for each half; a direction is
a pair of codewords, so C**2 directions cost 2 C inner products.  Each vector has its
``BEST`` directions of every code; vectors that share a direction meet and are verified
by their exact cosine.

A code is a random rotation, so every pair of a cosine misses in it, having no common
direction, with the same probability whatever the data, and codes miss independently.
That probability grows with the number of directions.  It is measured on random pairs
(``miss_rate``), and so many codes are taken that a pair at the cosine asked for
misses in all with probability ``MISS`` at most; more similar pairs miss less.  The
number of directions grows with the number of vectors and keeps buckets small; buckets
that are large all the same are cut into tiles, and pairs of tiles are verified as blocks.

Exact copies are collapsed first.  A pair counts once, in the smallest direction it
shares; tiles emit a count per vector and a local root, never pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.llm.common import cut, small
from topicloom.llm.graph import connected_components

COSINE = 0.95
HITS = 32
BUCKET = 96
CODES = 4
BEST = HITS // CODES
#: Probability at most that a pair at the cosine asked for shares no direction.
MISS = 1e-6
PROBES = 2000
TILE = 512


def codebook_size(n: int, hits=HITS, bucket=BUCKET, codes=CODES) -> int:
    """Codewords per half such that buckets hold about ``bucket`` of ``n`` vectors."""
    return max(24, math.ceil(math.sqrt(max(1, n) * hits / bucket / codes)))


@lru_cache(16)
def product_code(code: int, dim: int, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rotation and the two codebooks of one code; a fixed seed makes tasks agree."""
    rng = np.random.default_rng([20240607, code, dim, words])
    turn, _ = np.linalg.qr(rng.standard_normal((dim, dim)))
    half = (dim + 1) // 2
    books = []
    for d in (half, dim - half):
        book = rng.standard_normal((words, d))
        books.append(book / np.maximum(np.linalg.norm(book, axis=1, keepdims=True), 1e-300) if d else book)
    return turn, books[0], books[1]


def _largest(x: np.ndarray, k: int) -> np.ndarray:
    return np.argpartition(x, x.shape[1] - k, axis=1)[:, -k:]


def best_directions(x: np.ndarray, code: int, words: int, best=BEST) -> np.ndarray:
    """Unit vectors -> the ``best`` directions of each in one code.

    The best pairs of codewords are among the best codewords of either half.
    """
    turn, one, two = product_code(code, x.shape[1], words)
    y = x @ turn
    a, b = y[:, : one.shape[1]] @ one.T, y[:, one.shape[1] :] @ two.T
    i, j = _largest(a, best), _largest(b, best)
    both = np.take_along_axis(a, i, 1)[:, :, None] + np.take_along_axis(b, j, 1)[:, None, :]
    at = _largest(both.reshape(len(x), -1), best)
    return np.take_along_axis(i, at // best, 1) * words + np.take_along_axis(j, at % best, 1)


def random_pairs(n: int, dim: int, cosine: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """``n`` random pairs of unit vectors at this cosine."""
    rng = np.random.default_rng(seed)
    x, z = rng.standard_normal((2, n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-300)
    return x, cosine * x + math.sqrt(max(0.0, 1 - cosine**2)) * z


@lru_cache(64)
def miss_rate(dim: int, words: int, cosine: float) -> float:
    """Share of random pairs without a common direction in one code, rounded up."""
    x, y = random_pairs(PROBES, dim, cosine, 5)
    met = 0
    for lo in range(0, PROBES, 250):
        p, q = (best_directions(v[lo : lo + 250], 0, words) for v in (x, y))
        met += int((p[:, :, None] == q[:, None, :]).any((1, 2)).sum())
    return (PROBES - met + 1) / (PROBES + 1)


def codes_for(dim: int, words: int, cosine: float = COSINE, miss: float = MISS) -> int:
    """Codes such that a pair at ``cosine`` misses in all with probability ``miss`` at most."""
    if dim == 1:
        return CODES  # vectors of one component link when equal, and equal ones share all
    return max(CODES, math.ceil(math.log(miss) / math.log(min(miss_rate(dim, words, cosine), 1 - 1 / PROBES))))


def decode(x: np.ndarray, words: int, codes: int = CODES) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors -> (row, direction) of their best directions in all codes, rows sorted."""
    found = [c * words * words + best_directions(x, c, words) for c in range(codes)]
    dirs = np.sort(np.concatenate(found, axis=1), axis=1)
    return np.repeat(np.arange(len(x)), dirs.shape[1]), dirs.ravel()


def _unit(raw: bytes | list, kind: str) -> np.ndarray:
    x = np.frombuffer(raw, kind).astype(np.float64)
    # Scaled first, so that very large and very small components keep their cosine.
    x = x / np.abs(x).max()
    return x / np.linalg.norm(x)


def _meet(classes: DataFrame, words: int, codes: dict[int, int], kind: str) -> DataFrame:
    """``rep, n, vec`` -> ``code, rep, n, codes, vec``, one row per direction of a vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                vecs = part.column("vec").to_pylist()
                dims = np.array([len(v) for v in vecs])
                for dim in np.unique(dims):
                    own = np.flatnonzero(dims == dim)
                    x = np.stack([_unit(vecs[i], kind) for i in own])
                    r, d = decode(x, words, codes[x.shape[1]])
                    d = d + (x.shape[1] << 44)
                    ends = np.searchsorted(r, np.arange(len(own) + 1))
                    lists = [d[ends[i] : ends[i + 1]].tobytes() for i in range(len(own))]
                    at = pa.array(own[r])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(d), part.column("rep").take(at), part.column("n").take(at), pa.array([lists[i] for i in r], pa.binary()), part.column("vec").take(at)],
                        ["code", "rep", "n", "codes", "vec"],
                    )

    return classes.select("rep", "n", "vec").mapInArrow(run, "code long, rep long, n long, codes binary, vec binary")


def links_in(side: np.ndarray, x: np.ndarray, cosine: float) -> np.ndarray:
    """Which rows link; ``side`` 2: a tile with itself, else only rows of sides 0 and 1."""
    g = x @ x.T >= cosine
    np.fill_diagonal(g, False)
    if (side != 2).any():
        g &= side[:, None] != side[None, :]
    return g


def first_meeting(code: int, codes: list[np.ndarray]) -> np.ndarray:
    """Pairs of rows that share no direction smaller than ``code``."""
    lists = [c[c < code] for c in codes]
    if not any(map(len, lists)):
        return np.ones((len(codes), len(codes)), bool)
    flat = np.concatenate(lists)
    words, where, count = np.unique(flat, return_inverse=True, return_counts=True)
    rows = np.repeat(np.arange(len(lists)), [len(c) for c in lists])
    keep = count[where] > 1
    column = np.cumsum(count > 1) - 1
    m = np.zeros((len(lists), int((count > 1).sum())), np.float32)
    m[rows[keep], column[where[keep]]] = 1
    return m @ m.T == 0


def local_roots(g: np.ndarray, rep: np.ndarray) -> np.ndarray:
    """Smallest id that each row reaches inside the block."""
    root = rep.copy()
    while True:
        heard = np.where(g, root[None, :], np.iinfo(np.int64).max).min(1)
        new = np.minimum(root, heard)
        if (new == root).all():
            return root
        root = new


def _verify(met: DataFrame, cosine: float, kind: str) -> DataFrame:
    """Blocks (code, a, b) -> ``rep, links, root``: one row per linked vector of a block."""

    def block(code: int, t: pa.Table) -> pa.RecordBatch | None:
        x = np.stack([_unit(v, kind) for v in t.column("vec").to_pylist()])
        side, rep, n = (t.column(c).to_numpy() for c in ("side", "rep", "n"))
        g = links_in(side, x, cosine)
        own = np.flatnonzero(g.any(1))
        if not len(own):
            return None
        g, rep, n = g[np.ix_(own, own)], rep[own], n[own]
        lists = t.column("codes").to_pylist()
        once = g & first_meeting(code, [np.frombuffer(lists[i], np.int64) for i in own])
        links = np.where(once, n[None, :], 0).sum(1)
        return pa.RecordBatch.from_arrays([pa.array(rep), pa.array(links), pa.array(local_roots(g, rep))], ["rep", "links", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def finish():
            t = pa.Table.from_batches(held)
            held.clear()
            return block(t.column("code")[0].as_py(), t) if len(t) > 1 else None

        last = None
        for b in batches:
            if not b.num_rows:
                continue
            keys = np.stack([b.column(c).to_numpy() for c in ("code", "a", "b")], 1)
            starts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1), len(keys)]
            for lo, hi in zip(starts[:-1], starts[1:], strict=True):
                key = tuple(keys[lo])
                if key != last and held and (out := finish()) is not None:
                    yield out
                last = key
                held.append(b.slice(lo, hi - lo))
        if held and (out := finish()) is not None:
            yield out

    cols = ["code", "a", "b", "side", "rep", "n", "codes", "vec"]
    x = met.select(*cols).repartition("code", "a", "b").sortWithinPartitions("code", "a", "b")
    return x.mapInArrow(run, "rep long, links long, root long")


def classes_of(vectors: DataFrame, id_col="vec_id", vector_col="embedding") -> DataFrame:
    """Distinct usable vectors: ``vec_key, rep, n``; rep is the smallest id, n the rows."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    usable = F.col(id_col).isNotNull() & v.isNotNull() & finite & F.exists(v, lambda c: c != 0)
    return vectors.filter(usable).groupBy(v.alias("vec_key")).agg(F.min(id_col).alias("rep"), F.count("*").alias("n"))


def near_duplicates(vectors: DataFrame, id_col="vec_id", vector_col="embedding", cosine: float = COSINE) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row, whatever its other columns.

    Vectors that are null, zero, or hold null or non-finite components, and rows with
    a null id, link with nothing and are components of their own.  Vectors of other
    dimensions never link.  Repeated rows link with each other; ids are taken to name
    vectors, so rows that give one id to several vectors share a component.  An
    empty table gives no rows.
    """
    item = vectors.schema[vector_col].dataType.elementType.simpleString()
    kind = "<f4" if item == "float" else "<f8"
    size = 4 if kind == "<f4" else 8
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(f"array<{'float' if size == 4 else 'double'}>").alias("vec_key"))
    classes = cut(classes_of(rows, "vec_id", "vec_key"))
    dims = {r["dim"]: r["n"] for r in classes.groupBy(F.size("vec_key").alias("dim")).agg(F.count("*").alias("n")).collect()}
    words = codebook_size(sum(dims.values()))
    codes = {dim: codes_for(dim, words, cosine) for dim in dims}
    met = _meet(_packed(classes, kind), words, codes, kind)
    sizes = met.groupBy("code").agg(F.count("*").alias("k")).filter(F.col("k") > TILE)
    large = cut(sizes.select("code", F.ceil(F.col("k") / TILE).cast("int").alias("tiles")))
    x = met.join(small(large, large.count()), "code", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    x = x.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    x = x.withColumn("a", F.least("own", "other")).withColumn("b", F.greatest("own", "other"))
    x = x.withColumn("side", F.when(F.col("a") == F.col("b"), 2).when(F.col("own") == F.col("a"), 0).otherwise(1))
    found = cut(_verify(x, cosine, kind).groupBy("rep", "root").agg(F.sum("links").alias("links")))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    comps = connected_components(found.filter("rep <> root").select(F.col("rep").alias("src"), F.col("root").alias("dst")))
    known = classes.join(links, "rep", "left").join(comps, classes["rep"] == comps["node"], "left").select(
        "vec_key", F.coalesce("component", "rep").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")
    )
    usable = rows.join(known, "vec_key", "left")
    own = F.col("component_id").isNull() | F.col("vec_id").isNull()
    component = F.when(own, F.col("vec_id")).otherwise(F.col("component_id"))
    return usable.select(
        "vec_id",
        F.when(own, 0).otherwise(F.col("n_links")).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )


def _packed(classes: DataFrame, kind: str) -> DataFrame:
    """Vectors as packed bytes, so that each moves once as a flat value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vec = [np.array(v, kind).tobytes() for v in b.column("vec_key").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("rep"), b.column("n"), pa.array(vec, pa.binary())], ["rep", "n", "vec"])

    return classes.select("rep", "n", "vec_key").mapInArrow(run, "rep long, n long, vec binary")
