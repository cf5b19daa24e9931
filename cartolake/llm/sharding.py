"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns many virtual nodes on a ring of 64-bit positions; a key belongs to the first virtual node clockwise
from its hash. Shards have a capacity. Rows that meet a full shard go on clockwise to the next virtual node whose shard
has room. With capacities that differ by one row at most and add up to all rows, balance is guaranteed (law `rows`),
while most rows stay on the shard that the plain ring would give them.

Only the row counts of the arcs come to the driver: shards x virtual_nodes numbers, whatever the input. The walk
around the ring turns them into runs (arc, ranks from..to -> shard, first slot), and the rows find theirs by arc and rank.
The rank within an arc is made in ranges and, for rows that are alike, in slices, so that a hot key is split over many tasks.
"""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import join_sliced, materialize, slice_rows

#: Rows that one task ranks at most, about: the ranges of an arc and the slices of equal rows follow from it.
ROWS_PER_RANKING = 20_000


def ring(shards: int, virtual_nodes: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (signed 64-bit, ascending) and the shard that owns each."""
    nodes = sorted((xxhash.xxh64_intdigest(f"shard-{s}/node-{v}", seed=42) - 2**63, s) for s in range(shards) for v in range(virtual_nodes))
    return np.array([p for p, _ in nodes], dtype=np.int64), np.array([s for _, s in nodes], dtype=np.int32)


def capacities(total: int, shards: int) -> list[int]:
    """Row capacities that add up to total and differ by one at most."""
    return [total // shards + (s < total % shards) for s in range(shards)]


def runs(counts: list[int], owners: list[int], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, end rank, shard, first slot) for all rows of all arcs.

    First each shard takes rows of its own arcs, in clockwise order, as far as it has room; then what is left of each
    arc walks on clockwise. counts: rows of each arc; owners: shard of each arc; room: capacity of each shard.
    """
    room, used, out, rest = list(room), [0] * len(room), [], []
    arcs_of: dict[int, list[int]] = {}
    for arc, owner in enumerate(owners):
        arcs_of.setdefault(owner, []).append(arc)

    def give(arc: int, first: int, n: int, shard: int) -> None:
        if n:
            out.append((arc, first, first + n, shard, used[shard]))
            used[shard] += n
            room[shard] -= n

    for arc, (n, owner) in enumerate(zip(counts, owners, strict=True)):
        taken = min(n, room[owner])
        give(arc, 0, taken, owner)
        if taken < n:
            rest.append((arc, taken, n))
    for arc, first, end in rest:
        # the next virtual node clockwise of every shard that still has room, nearest first
        ahead = []
        for shard, arcs in arcs_of.items():
            if room[shard]:
                k = bisect.bisect_right(arcs, arc)
                ahead.append(((arcs[k] if k < len(arcs) else arcs[0] + len(owners)) - arc, shard))
        for _, shard in sorted(ahead):
            n = min(end - first, room[shard])
            give(arc, first, n, shard)
            first += n
            if first == end:
                break
    return out


def ranked_in(rows: DataFrame, group: str, key: str, number: str, rows_per_task: int = ROWS_PER_RANKING) -> DataFrame:
    """rows (number differs in each) with rank: the place within its group by key, a hash; gapless from 0.

    No task ranks much more than rows_per_task rows. A group is cut into ranges of its key by the largest group's size; a
    key's copies, which no range can part, are counted first, and only they are told apart by number. A key with many copies
    is cut into slices (join_sliced) before its rows meet their place, and these are ranked one by one.
    """
    counts = rows.groupBy(group, key).agg(F.count("*").alias("copies"))
    largest, total = counts.groupBy(group).agg(F.sum("copies").alias("n")).agg(F.max("n"), F.sum("n")).first()
    parts, most = max(1, min(1 << 24, (largest or 0) // rows_per_task + 1)), slice_rows(total or 0, rows_per_task)
    part = F.shiftright(F.shiftrightunsigned(key, 33) * parts, 31).cast("int")
    # the key as an unsigned number: its order must be that of the parts
    order = [F.shiftrightunsigned(key, 33), F.col(key)]
    within = Window.partitionBy(group, "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    none, ranged = F.lit(0).cast("long"), counts.withColumn("part", part)
    sizes = ranged.groupBy(group, "part").agg(F.sum("copies").alias("n"))
    offsets = sizes.select(group, "part", F.coalesce(F.sum("n").over(before), none).alias("offset"))
    placed = ranged.withColumn("start", F.coalesce(F.sum("copies").over(within), none)).join(offsets, [group, "part"]).select(group, key, "copies", (F.col("start") + F.col("offset")).alias("start"))
    met = join_sliced(rows, placed, counts, [group, key], F.xxhash64(number), most)
    single = met.where("copies = 1").withColumn("rank", F.col("start"))
    several = met.where("copies > 1")
    each = several.groupBy(group, key, "slice").agg(F.count("*").alias("n"))
    ahead = F.sum("n").over(Window.partitionBy(group, key).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    shifts = each.select(group, key, "slice", F.coalesce(ahead, none).alias("shift"))
    own = F.row_number().over(Window.partitionBy(group, key, "slice").orderBy(number)) - 1
    copies = several.withColumn("own", own).join(shifts, [group, key, "slice"]).withColumn("rank", F.col("start") + F.col("shift") + F.col("own"))
    return single.select(*rows.columns, "rank").unionByName(copies.select(*rows.columns, "rank"))


def shard_documents(docs: DataFrame, shards: int = 40, virtual_nodes: int = 100) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, size, text_crc32, law, shard, slot, grown_shard.

    A null text counts as empty (size 16, crc32 0); a null doc_id has a place on the ring like any other key; equal
    rows each get their own slot. An empty table gives no rows. Other columns of docs are dropped, whatever their names; a
    text of any length is met whole. Within an arc rows stand by a hash of doc_id, size and text_crc32, so what overflows
    follows the rows and not how they lie in files; only rows alike in these change places. The law is `rows`: shard sizes
    differ by one row at most. The bound depends on all rows, so grown_shard is null, and with one more shard some rows
    also move between old ones.
    """
    spark = docs.sparkSession
    positions, owners = ring(shards, virtual_nodes)
    at = spark.sparkContext.broadcast(positions)  # shards x virtual_nodes numbers

    @F.pandas_udf("int")
    def arc_of(position: pd.Series) -> pd.Series:
        return pd.Series((np.searchsorted(at.value, position.to_numpy(), side="left") % len(at.value)).astype("int32"))

    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("row_no"),
    )
    rows = rows.withColumns({"arc": arc_of(F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(-1)))), "order_hash": F.xxhash64("doc_id", "size", "text_crc32")})
    rows = materialize(rows, "ring")
    per_arc = {r["arc"]: r["n"] for r in rows.groupBy("arc").agg(F.count("*").alias("n")).collect()}  # a row for each arc
    table = runs([per_arc.get(a, 0) for a in range(len(positions))], owners.tolist(), capacities(sum(per_arc.values()), shards))
    runs_df = spark.createDataFrame(
        pd.DataFrame(table, columns=["arc", "first", "end", "shard", "slot_at"]), "arc int, first long, end long, shard int, slot_at long"
    )
    ranked = ranked_in(rows, "arc", "order_hash", "row_no")
    hit = [ranked["arc"] == runs_df["arc"], ranked["rank"] >= runs_df["first"], ranked["rank"] < runs_df["end"]]
    # at most shards x virtual_nodes + shards runs a hand-over: a bounded table
    return ranked.join(F.broadcast(runs_df), hit).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        (F.col("slot_at") + F.col("rank") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
