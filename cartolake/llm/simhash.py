"""SimHash near-duplicates by anchor-point covering.

Two 64-bit fingerprints within 3 bits have a 32-bit half in which they differ by 1 bit at most. In each half the anchors
are a covering code: the Hamming code [31, 26] (perfect, covering radius 1) times the free 32nd bit. A fingerprint's home
is the anchor that decodes it; it is replicated to every anchor within covering radius plus threshold that could be the
home of a fingerprint 1 bit away: 1 + 15 + 1 per half. Per anchor, homes are compared with visitors, an equi-join on
(half, anchor) with a bit count as its condition. So each link is found from its smaller fingerprint's home anchor.

Equal fingerprints are one node, so copies never make pairs. Components come from alternating minimum-label hops over the
links of different fingerprints, with the labels written to the shared folder after every round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import encoded, join_sliced, materialize, slice_rows, texts_of

SHINGLE_WORDS = 3
MAX_BITS = 3
SEED = 42
#: Links of one node that a task meets at once, and the most nodes with more links than that.
SLICE_LINKS, HOT_NODES = 256, 50_000
#: Fingerprints whose home is one anchor that a task meets at once, and rows of one fingerprint that a task labels, about.
CELL_HOMES, LABEL_ROWS = 4_096, 100_000
#: Shingle hashes whose bits are counted at once.
CHUNK = 1 << 16


def fingerprint(text: bytes) -> int:
    """Of lower-cased (A-Z) whole text: bit k is set if it is set in over half of the shingles' hashes. Unsigned."""
    words = text.lower().split()  # of bytes: exactly A-Z, and exactly the characters \x20 \x09-\x0D
    n = max(len(words) - SHINGLE_WORDS + 1, 1 if words else 0)
    if not n:
        return 0
    joined, lengths = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    first, last = starts[:n].tolist(), ends[-n:].tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(first[at : at + CHUNK], last[at : at + CHUNK], strict=True)], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(sum(1 << k for k in np.flatnonzero(2 * counts > n).tolist()))


def fingerprints(docs: DataFrame, *carried: str) -> DataFrame:
    """doc_id, the carried columns, fp (the fingerprint as a signed long) for every row. Texts of null or without words have fingerprint 0."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *carried, "text")
    schema = own.drop("text").schema.add("fp", "long")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(encoded(t)) for (t,) in texts_of([batch], "text")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", *carried)), pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", *carried, "fp"])

    return own.mapInArrow(of, schema)


def syndrome(half: Column) -> Column:
    """Of the low 31 bits by the Hamming code: 0 for a codeword, else 1 + the position of the bit to flip."""
    out = F.lit(0)
    for k in range(5):
        mask = sum(1 << (p - 1) for p in range(1, 32) if p >> k & 1)
        out = out + F.shiftleft(F.bit_count(half.bitwiseAND(F.lit(mask))).bitwiseAND(F.lit(1)), k)
    return out


def flip(half: Column, position: Column) -> Column:
    """half (a long) with the bit at a 1-based position flipped; position 0 flips none."""
    one = F.when(position > 0, F.call_function("shiftleft", F.lit(1).cast("long"), (position - 1).cast("int"))).otherwise(F.lit(0).cast("long"))
    return half.bitwiseXOR(one)


def home(half: Column) -> Column:
    return flip(half, syndrome(half))


def halves(nodes: DataFrame) -> DataFrame:
    """fp, side (0 or 1), half (0 .. 2^32 - 1)."""
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned("fp", 32)
    return nodes.select("fp", F.posexplode(F.array(low, high)).alias("side", "half"))


def cell_cuts(homes: DataFrame, count: int, cell_homes: int) -> DataFrame:
    """side, anchor, cuts of the cells with more than cell_homes homes: with slice_rows, as many as may be broadcast."""
    most = slice_rows(count, cell_homes)
    sizes = homes.groupBy("side", "anchor").agg(F.count("*").alias("n")).where(F.col("n") > most)
    return sizes.select("side", "anchor", F.ceil(F.col("n") / most).cast("int").alias("cuts"))


def dealt(rows: DataFrame, own: str, other: str, cuts: DataFrame) -> DataFrame:
    """rows with cut_a and cut_b: the own one by the hash of the fingerprint, and the row again for each of the other's."""
    n = F.coalesce("cuts", F.lit(1))
    met = rows.join(F.broadcast(cuts), ["side", "anchor"], "left").withColumn(f"cut_{own}", F.pmod(F.xxhash64(own), n).cast("int"))
    return met.withColumn(f"cut_{other}", F.explode(F.sequence(F.lit(0), n - 1))).drop("cuts")


def links(nodes: DataFrame, max_bits: int = MAX_BITS, cell_homes: int = CELL_HOMES) -> DataFrame:
    """a < b: the pairs of different fingerprints (nodes.fp, distinct) that differ by max_bits or fewer (3 at most).

    A cell (an anchor of a half) with more than cell_homes homes is cut on both sides, and its parts meet in tasks of their own.
    Homes and visitors are merged: Spark sizes both by the nodes' file, before the explodes, and would broadcast 34 rows a node.
    """
    # dealt out before the 34-fold explode, which else runs in as few tasks as the nodes have files
    sides = halves(nodes.repartition(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp"))
    homes = sides.select("side", home(F.col("half")).alias("anchor"), F.col("fp").alias("a"))
    # anchors that are the home of some half within 1 bit: each of the 32 flips, decoded
    reach = F.array_distinct(F.concat(F.array(home(F.col("half"))), F.transform(F.sequence(F.lit(1), F.lit(32)), lambda p: home(flip(F.col("half"), p)))))
    visitors = sides.select("side", F.explode(reach).alias("anchor"), F.col("fp").alias("b"))
    apart = F.col("a").bitwiseXOR(F.col("b"))
    cuts = materialize(cell_cuts(homes, 2 * nodes.count(), cell_homes), "cells")
    met = dealt(homes, "a", "b", cuts).hint("merge").join(dealt(visitors, "b", "a", cuts).hint("merge"), ["side", "anchor", "cut_a", "cut_b"])
    found = met.where((F.col("a") < F.col("b")) & (F.bit_count(apart) <= max_bits))
    # a pair has one half within 1 bit at least; of two such the low one counts, and none counts where it is met by chance
    low = F.bit_count(apart.bitwiseAND(F.lit(0xFFFFFFFF))) <= max_bits // 2
    first = (F.col("side") == 0) == low
    return found.where(first).select("a", "b")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, root: the smallest node reachable, for every node of edges (a, b). Roots and nodes without edges have no row.

    Large-star and small-star rounds: every node links its larger neighbours to its smallest one, then its smaller
    neighbours to the smallest, until the edges are stars. The rounds grow with the logarithm of a component's size;
    more than max_rounds raise an error. A node with many links is met in slices (see least_neighbour).
    """
    edges = materialize(edges.select("a", "b").where("a <> b"), "links")
    count = edges.count()
    if not count:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))

    def star(pairs: DataFrame, larger: bool, most: int) -> DataFrame:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))) if larger else pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least, met = least_neighbour(both, most)
        hung = met.where(F.col("b") > F.col("a") if larger else F.lit(True)).select(F.col("b").alias("a"), F.col("m").alias("b"))
        if not larger:
            hung = hung.unionByName(least.select("a", F.col("m").alias("b")))
        return hung.where("a <> b").distinct()

    seen = None
    for _ in range(max_rounds):
        # a star has no more links than the round's edges, so twice these are all that least_neighbour meets
        most = max(SLICE_LINKS, 1 + 2 * count // HOT_NODES)
        edges = materialize(star(star(edges, True, most), False, most), "stars")
        # stars in which every link goes to its root don't change any more
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.groupBy(F.greatest("a", "b").alias("node")).agg(F.min(F.least("a", "b")).alias("root"))
        seen, count = now, now["n"]
    raise RuntimeError(f"links did not become stars in {max_rounds} rounds")


def least_neighbour(both: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """(a, m, ...: each node's smallest neighbour or itself; a, b, m: its links with it) for links (a, b).

    A node with more than `most` links is cut into slices by its neighbour's hash, so that no task meets all links of one
    node. The nodes that are cut are broadcast: of n links there are n / most at most, and components chooses most so
    that these are HOT_NODES at most.
    """
    slices = F.ceil(F.col("links") / most).cast("int")
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("links")).select("a", F.least("a", "m").alias("m"), slices.alias("slices"))
    hot = F.broadcast(least.where("slices > 1").select("a", "slices"))
    one = F.coalesce("slices", F.lit(1))
    cut = both.join(hot, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), one).cast("int").alias("slice"))
    copies = least.select("a", "m", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
    return least, cut.join(copies.hint("merge"), ["a", "slice"]).select("a", "b", "m")


def rooted(nodes: DataFrame) -> DataFrame:
    """nodes (fp, distinct, and others) with root, the smallest fingerprint of its component."""
    roots = components(links(nodes))
    return nodes.join(roots.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def representatives(docs: DataFrame, number: str) -> DataFrame:
    """number, a column that differs in every row of docs, of one row of each component: the one with the smallest
    (doc_id, number), null doc_ids last. doc_ids may repeat, in one component or in several."""
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", number)
    nodes = materialize(fingerprints(docs, number).groupBy("fp").agg(F.min(order).alias("least")), "nodes")
    return rooted(nodes).groupBy("root").agg(F.min("least").alias("least")).select(f"least.{number}")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id for every row of docs (doc_id, text); other columns are dropped.

    Null, empty and blank texts share fingerprint 0 and are linked like any other; equal rows each have a row; a null
    doc_id takes part but is never a component's id unless no other is there; an empty table gives no rows. A text of any
    length is met whole; of equal doc_ids with different texts each row has the fingerprint of its own text.
    """
    rows = materialize(fingerprints(docs), "fingerprints")
    nodes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")), "nodes")
    member = rooted(nodes)
    named = member.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = member.join(named.hint("merge"), "root").select("fp", "component_id", "copies")
    # any slice of a fingerprint's rows will do, as each has the label
    met = join_sliced(rows, labels.hint("merge"), nodes, ["fp"], F.xxhash64(F.monotonically_increasing_id()), slice_rows(rows.count(), LABEL_ROWS))
    return met.select("doc_id", "fp", "component_id")


def near_duplicate_report(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
