"""Sharding by fixed virtual slots and a versioned slot-to-shard map.

A record's key is hashed into one of a fixed number of slots.  Bytes and rows are
summed by slot, and a map from slot to shard, not the records, is what balancing
decides and edits.  Version 1 is there before any data: slots in turn.  Once bytes are
summed, a rebalance moves as few slots as even loads need, and the edited map is
stored as the next version.  The map has one row per slot, a constant, however large
the data.
"""

from __future__ import annotations

import bisect

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from topicloom.llm.common import scratch_path

SLOTS = 8192
SHARDS = 24
#: How far apart loads may be, as a share of their mean.
TOLERANCE = 0.0005
MAP_SCHEMA = "slot int, shard int"
#: Moves a slot, on average, after which a map counts as one that cannot be edited.
MOST_MOVES = 4


def slot_of(id_col: Column, content: Column, slots: int = SLOTS) -> Column:
    """Slot of a record; the content's hash stands in for a missing key and parts repeated ones."""
    return F.pmod(F.xxhash64(F.lit("slot"), id_col, content), F.lit(slots)).cast("int")


def first_map(shards: int, slots: int = SLOTS) -> dict[int, int]:
    """The map before any load is known: slots in turn."""
    return {slot: slot % shards for slot in range(slots)}


def rebalance(current: dict[int, int], load: dict[int, int], shards: int, tolerance: float = TOLERANCE) -> dict[int, int]:
    """Edit ``current`` for new loads or another number of shards; few slots move.

    Slots of shards that no longer exist move first.  Then the slot that best halves
    the gap moves from the fullest shard to the emptiest.  If none narrows the gap, the
    pair of slots whose exchange does best is exchanged.  It ends when all are within
    ``tolerance`` of the mean; a shard that neither narrows keeps its load and the
    next fullest is looked at.
    """
    out = dict(current)
    have: dict[int, set[int]] = {s: set() for s in range(shards)}
    total = dict.fromkeys(range(shards), 0)
    loose = []
    for slot, shard in current.items():
        if shard in have:
            have[shard].add(slot)
            total[shard] += load.get(slot, 0)
        else:
            loose.append(slot)

    def move(slot: int, to: int):
        if out[slot] in have and slot in have[out[slot]]:
            have[out[slot]].remove(slot)
            total[out[slot]] -= load.get(slot, 0)
        out[slot] = to
        have[to].add(slot)
        total[to] += load.get(slot, 0)

    for slot in sorted(loose, key=lambda s: (-load.get(s, 0), s)):
        move(slot, min(total, key=lambda s: (total[s], s)))
    mean, stuck = sum(total.values()) / shards, set()
    moves = 0
    while open_ := [s for s in total if s not in stuck]:  # without one no move or exchange makes the shards more equal
        if (moves := moves + 1) > MOST_MOVES * max(1, len(current)):
            raise RuntimeError(f"shards are not balanced after {moves} moves: {max(total.values())} and {min(total.values())} bytes")
        high, low = max(open_, key=lambda s: (total[s], s)), min(total, key=lambda s: (total[s], -s))
        gap = total[high] - total[low]
        if gap <= tolerance * mean:
            break
        fit = [s for s in have[high] if 0 < load.get(s, 0) < gap]
        slot = min(fit, key=lambda s: (abs(load[s] - gap / 2), s), default=None)
        if slot is not None and abs(load[slot] - gap / 2) <= gap / 4:
            move(slot, low)
            continue
        # An exchange moves the difference of two loads.
        down = sorted((load.get(s, 0), s) for s in have[low])
        best = None
        for s in sorted(have[high]):
            at = bisect.bisect_left(down, (load.get(s, 0) - gap / 2, -1))
            for w, t in down[max(0, at - 1) : at + 1]:
                if 0 < load.get(s, 0) - w < gap:
                    best = min(best or (gap, 0, 0), (abs(load[s] - w - gap / 2), s, t))
        if slot is not None and (best is None or abs(load[slot] - gap / 2) <= best[0]):
            move(slot, low)
        elif best is not None:
            move(best[1], low)
            move(best[2], high)
        else:
            stuck.add(high)
    return out


def store_map(spark: SparkSession, root: str, version: int, mapping: dict[int, int]) -> None:
    """Write one version of the map; older versions stay readable."""
    spark.createDataFrame(sorted(mapping.items()), MAP_SCHEMA).coalesce(1).write.parquet(f"{root}/version={version}")


def load_map(spark: SparkSession, root: str, version: int) -> dict[int, int]:
    return {r.slot: r.shard for r in spark.read.schema(MAP_SCHEMA).parquet(f"{root}/version={version}").collect()}


def slot_stats(rows: DataFrame) -> dict[int, tuple[int, int]]:
    """slot -> (bytes, rows); at most one row per slot reaches the driver."""
    got = rows.groupBy("vslot").agg(F.sum("size").cast("long").alias("b"), F.count("*").alias("n")).collect()
    return {r.vslot: (r.b, r.n) for r in got}


def shard_documents(docs: DataFrame, id_col="doc_id", text_col="text", shards: int = SHARDS, slots: int = SLOTS, map_root: str | None = None) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, vslot, map_version`` for every row.

    Shards hold near equal bytes: version 1 of the map, slots in turn, is edited for the
    bytes found and the rows go by version 2.  ``slot`` is the row's place in its shard, gapless
    from 0: the rows of the shard's earlier virtual slots, then its rank in its own.
    Null text has size 8 and checksum 0, a null id hashes by its text, repeated rows
    take places of their own; an empty table gives no rows; other columns are not
    read.  Ranks are taken within a virtual slot, never within a whole shard.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    rows = rows.withColumn("vslot", slot_of(F.col("doc_id"), F.col("text_crc32"), slots))
    stats = slot_stats(rows)
    root = map_root or scratch_path(spark, "slot-map")
    store_map(spark, root, 1, first_map(shards, slots))
    store_map(spark, root, 2, rebalance(load_map(spark, root, 1), {s: b for s, (b, _) in stats.items()}, shards))
    mapping = load_map(spark, root, 2)
    base, at = [], dict.fromkeys(range(shards), 0)
    for s in range(slots):
        base.append((s, mapping[s], at[mapping[s]]))
        at[mapping[s]] += stats.get(s, (0, 0))[1]
    places = F.broadcast(spark.createDataFrame(base, "vslot int, shard int, base long"))  # one row per slot
    rank = F.row_number().over(Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")) - 1
    return (
        rows.withColumn("rank", rank)
        .join(places, "vslot")
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("base") + F.col("rank")).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
            "vslot",
            F.lit(2).alias("map_version"),
        )
    )
