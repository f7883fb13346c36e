"""Best-fit packing of token pieces into sequences, in bulk-synchronous sweeps.

Documents and gaps are tables.  A sweep sorts both together by range of size, largest
first, and matches every document with a gap of its own, the successor of its length
among the gaps that no longer document has: read from the largest down, gaps are
stacked and a document takes the last one stacked.  Each task matches its range; what
it cannot match is ranked, and the counts of the ranges (one row each) tell which
ranks of a range meet which ranks of a larger one.  A gap that holds several of the
longest documents left counts as so many, so ranks, not tasks, resolve conflicts.  Then
the gaps that were filled shrink, and the sweep repeats until nothing matches.

Documents longer than half a sequence open one each.  The others come in two tiers, down
to an ``1 / TIER`` of that and below, so that few sweeps fill a gap with many small ones.  What finds no gap opens as many sequences as its tokens fill at
least; after ``OPENINGS`` such rounds the rest of a tier opens enough to place it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topicloom.llm.bpe import Encoder
from topicloom.llm.common import bounded_batches, cut, forget, held, lean

CAPACITY = 1024
EOS = 2
TIER = 8
OPENINGS = 4
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
MATCHED, WAITING, FREE = 0, 1, 2


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoder(path: str) -> Encoder:
    return held(f"encoder {path}", lambda: Encoder(path))


def cuts(n: int, capacity: int) -> np.ndarray:
    """Bounds of a document's pieces: only the first may be shorter than ``capacity``."""
    head = n % capacity or min(n, capacity)
    return np.concatenate([[0], np.arange(head, n + 1, capacity)])


def make_pieces(docs: DataFrame, id_col="doc_id", text_col="text", capacity=CAPACITY, path: str | None = None, eos=EOS, with_ids=False) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32`` and, if asked, ``ids``."""
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                names, texts = part.column(0), [t or "" for t in part.column(1).to_pylist()]
                rows, piece, start, length, crc, kept = [], [], [], [], [], []
                for i, ids in enumerate(enc.encode(texts)):
                    ids = np.append(ids, np.uint32(eos)).astype("<u4")
                    at = cuts(len(ids), capacity)
                    for k in range(len(at) - 1):
                        own = ids[at[k] : at[k + 1]]
                        rows.append(i)
                        piece.append(k)
                        start.append(at[k])
                        length.append(len(own))
                        crc.append(zlib.crc32(own.tobytes()))
                        if with_ids:
                            kept.append(own)
                cols = [
                    names.take(pa.array(rows, pa.int32())),
                    pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array(crc, pa.int64()),
                ]
                if with_ids:
                    cols.append(pa.array(kept, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(cols)])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = PIECES.replace("doc_id long", f"doc_id {kind}") + (", ids array<int>" if with_ids else "")
    return bounded_batches(docs).select(F.col(id_col), F.col(text_col)).mapInArrow(lean(run, f"encoder {path}"), schema)


def stack_match(gap: np.ndarray) -> np.ndarray:
    """Rows from the largest size down, ``gap`` true for gaps: for each document the row of its gap, else -1.

    A document takes the last gap before it that is not taken: the smallest that fits.
    """
    step = np.where(gap, 1, -1)
    height = np.cumsum(step)
    floor = np.minimum(np.minimum.accumulate(height), 0) if len(height) else height
    lost = np.diff(floor, prepend=0) < 0  # the stack was empty
    level = height - floor + ~gap
    row = np.flatnonzero(~lost)
    row = row[np.lexsort((row, level[row], -floor[row]))]
    out = np.full(len(gap), -1)
    one, two = row[:-1], row[1:]
    pair = gap[one] & ~gap[two] & (level[one] == level[two]) & (floor[one] == floor[two])
    out[two[pair]] = one[pair]
    return out


def carry(waiting: list[int], free: list[int]) -> tuple[list[tuple[int, int, int, int, int]], list[int], list[int]]:
    """Match what ranges, from the largest down, could not match inside.

    Returns segments (range, first rank, end, range of the gaps, rank of the first gap;
    gaps go down), how many documents of each range are matched, and how many gaps are left.
    """
    stack: list[int] = []
    left, taken, segments = list(free), [0] * len(waiting), []
    for p, n in enumerate(waiting):
        while taken[p] < n and stack:
            q = stack[-1]
            take = min(left[q], n - taken[p])
            segments.append((p, taken[p], taken[p] + take, q, left[q] - 1))
            taken[p] += take
            left[q] -= take
            if not left[q]:
                stack.pop()
        if left[p]:
            stack.append(p)
    return segments, taken, left


def _match_ranges(x: DataFrame) -> DataFrame:
    """``size, gap, id`` sorted by range -> ``part, kind, item, length, seq, room, rank``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A range of the sizes, two numbers a row.
        parts = [tuple(c.to_numpy(zero_copy_only=False) for c in b.columns) for b in batches] or [(np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))]
        size, gap, ident = (np.concatenate(c) for c in zip(*parts, strict=True))
        to = stack_match(gap)
        item = np.flatnonzero(to >= 0)
        used = np.zeros(len(gap), bool)
        used[to[item]] = True
        wait, free = np.flatnonzero(~gap & (to < 0)), np.flatnonzero(gap & ~used)
        part, none = TaskContext.get().partitionId(), np.int64(-1)
        for kind, i, g in ((MATCHED, item, to[item]), (WAITING, wait, None), (FREE, None, free)):
            n = len(i if i is not None else g)
            fill = np.full(n, none)
            cols = [
                pa.array(np.full(n, part), pa.int32()), pa.array(np.full(n, kind), pa.int32()),
                *([pa.array(ident[i]), pa.array(size[i])] if i is not None else [pa.nulls(n, pa.int64()), pa.array(np.zeros(n, np.int64))]),
                *([pa.array(ident[g]), pa.array(size[g])] if g is not None else [pa.nulls(n, pa.int64()), pa.array(fill)]),
                pa.array(np.arange(n)),
            ]
            yield pa.RecordBatch.from_arrays(cols, ["part", "kind", "item", "length", "seq", "room", "rank"])

    return x.select("size", "gap", "id").mapInArrow(lean(run), "part int, kind int, item long, length long, seq long, room long, rank long")


def sweep(items: DataFrame, gaps: DataFrame, shortest: int, longest: int, capacity: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``pid, length`` and ``seq, room`` -> documents that wait, the state of all gaps after the sweep, and a table to forget.

    The state has a row per document placed (``item, seq, offset``) and one per gap that
    is left (``last`` true: ``seq, room``).  The documents that wait rest on the third.
    """
    spark = items.sparkSession
    copies = F.greatest(F.lit(1), F.floor(F.col("room") / longest)).cast("int")
    slots = gaps.filter(F.col("room") >= shortest).select(F.col("room").alias("size"), F.lit(True).alias("gap"), F.col("seq").alias("id"), F.explode(F.sequence(F.lit(1), copies)).alias("copy"))
    both = items.select(F.col("length").alias("size"), F.lit(False).alias("gap"), F.col("pid").alias("id")).unionByName(slots.drop("copy"))
    order = [F.desc("size"), F.desc("gap"), F.asc("id")]
    m = cut(_match_ranges(both.repartitionByRange(*order).sortWithinPartitions(*order)))
    said = {(r["part"], r["kind"]): r["n"] for r in m.filter(F.col("kind") != MATCHED).groupBy("part", "kind").agg(F.count("*").alias("n")).collect()}
    parts = sorted({p for p, _ in said})  # at most one row per range and kind
    segments, taken, left = carry([said.get((p, WAITING), 0) for p in parts], [said.get((p, FREE), 0) for p in parts])
    # Two numbers a range, by its number, as constants of the plan.
    number = {p: i for i, p in enumerate(parts)}
    by_part = lambda values: F.element_at(F.lit([values[number[p]] if p in number else 0 for p in range(max(parts, default=0) + 1)]).cast("array<long>"), F.col("part") + 1)
    wait = m.filter((F.col("kind") == WAITING) & (F.col("rank") >= by_part(taken))).select(F.col("item").alias("pid"), "length")
    touched = m.filter(F.col("kind") == MATCHED).select("item", "length", "seq", "room")
    if segments:
        rows = [(parts[p], lo, hi, parts[q], at) for p, lo, hi, q, at in segments]
        meet = F.broadcast(spark.createDataFrame(rows, "part int, lo long, hi long, there int, at long"))  # two per range at most
        late = m.filter(F.col("kind") == WAITING).join(meet, "part").filter((F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
        late = late.select("item", "length", F.col("there").alias("part"), (F.col("at") - F.col("rank") + F.col("lo")).alias("rank"))
        touched = touched.unionByName(late.join(m.filter(F.col("kind") == FREE).select("part", "rank", "seq", "room"), ["part", "rank"]).select("item", "length", "seq", "room"))
    idle = m.filter((F.col("kind") == FREE) & (F.col("rank") < by_part(left))).select("item", "length", "seq", "room")
    small = gaps.filter(F.col("room") < shortest).select(F.lit(None).cast("long").alias("item"), F.lit(0).cast("long").alias("length"), "seq", "room")
    # What a gap took in this sweep stands in it one after another.
    here = Window.partitionBy("seq").orderBy(F.col("item").asc_nulls_last())
    before = F.coalesce(F.sum("length").over(here.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = F.sum("length").over(Window.partitionBy("seq"))
    x = touched.unionByName(idle).unionByName(small)
    x = x.select("item", "seq", (F.lit(capacity) - F.col("room") + before).alias("offset"), (F.col("room") - whole).alias("room"), (F.row_number().over(here) == 1).alias("last"))
    return wait, cut(x.filter(F.col("item").isNotNull() | F.col("last") & (F.col("room") > 0))), m


def _extent(items: DataFrame, gaps: DataFrame) -> list[int]:
    """Of documents: how many, shortest, longest, tokens; and the widest gap."""
    both = items.select("length", F.lit(None).cast("long").alias("room")).unionByName(gaps.select(F.lit(None).cast("long").alias("length"), "room"))
    return [x or 0 for x in both.agg(F.count("length"), F.min("length"), F.max("length"), F.sum("length"), F.max("room")).first()]


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``; other columns of ``pieces`` go along.

    Every piece is placed, none exceeds its sequence, offsets are gapless from 0.
    Lengths are from 1 to ``capacity``, else it is an error.  Repeated rows are packed
    as often as they come; an empty table gives no rows.  ``__pid`` must not be a column.
    """
    spark = pieces.sparkSession
    rows = cut(pieces.select("*", F.monotonically_increasing_id().alias("__pid")))
    n, least, most = rows.agg(F.count("*"), F.min("length"), F.max("length")).first()
    if n and not 1 <= least <= most <= capacity:
        raise ValueError(f"lengths from {least} to {most} do not fit into {capacity}")
    opens = F.col("length") * 2 > capacity
    own = rows.filter(opens).select(*pieces.columns, F.col("__pid").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    gaps = rows.filter(opens & (F.col("length") < capacity)).select(F.col("__pid").alias("seq"), (F.lit(capacity) - F.col("length")).alias("room"))
    small = rows.filter(~opens).select(F.col("__pid").alias("pid"), F.col("length").cast("long").alias("length"))
    placed, opened, half = [], 0, capacity // 2
    for low, high in ((half // TIER, half), (0, half // TIER)):
        items, rounds, stood, waited = small.filter((F.col("length") > low) & (F.col("length") <= high)), 0, None, None
        count, shortest, longest, tokens, widest = _extent(items, gaps)
        while count:
            if widest < shortest or count == stood:
                new = -(-tokens // capacity) if rounds < OPENINGS else -(-count // (capacity // longest))
                fresh = spark.range(opened, opened + new).select((-1 - F.col("id")).alias("seq"), F.lit(capacity).cast("long").alias("room"))
                gaps, opened, rounds = gaps.unionByName(fresh), opened + new, rounds + 1
            items, state, rests = sweep(items, gaps, shortest, longest, capacity)
            if waited is not None:
                forget(waited)
            waited, stood = rests, count
            placed.append(state.filter("item IS NOT NULL").select(F.col("item").alias("__pid"), F.col("seq").alias("sequence_id"), "offset"))
            gaps = state.filter("last AND room > 0").select("seq", "room")
            count, shortest, longest, tokens, widest = _extent(items, gaps)
        if waited is not None:
            forget(waited)
    if not placed:
        return own
    where = placed[0]
    for p in placed[1:]:
        where = where.unionByName(p)
    return own.unionByName(rows.filter(~opens).join(where, "__pid").select(*pieces.columns, "sequence_id", "offset"))


def pack_documents(docs: DataFrame, id_col="doc_id", text_col="text", capacity=CAPACITY, path=None, with_ids=False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece.

    Null text counts as empty: one piece, the end mark alone.  Only documents longer
    than ``capacity`` are cut.  Repeated rows are packed each, a null id stays null,
    other columns are not read; an empty table gives no rows.  Tokens are made once:
    the pieces, without text, are checkpointed before they are packed.
    """
    return pack(make_pieces(docs, id_col, text_col, capacity, path, with_ids=with_ids), capacity)
