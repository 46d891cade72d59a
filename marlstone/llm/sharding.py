"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

A row starts at the point of its doc_id on the ring and takes the first shard
clockwise that isn't full. Rows arrive in a fixed order (by a hash of the row),
so a shard is fully described by its cutoff: the arrival number at which it
became full. With n shards there are at most n fill events. Each is found from
counts by (arc of the ring, block of arrivals) and a refinement of one block at a time,
so only bounded histograms reach the driver and every row is placed in parallel.
"""

from __future__ import annotations

import bisect
import random

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.frames import only, settle

RING = 1 << 24   # places on the ring
BIN = 1 << 12    # places in a bin, by which a row finds the arc it lies on
VNODES = 64      # virtual nodes of each shard
COUNTS = 1 << 16  # counts of one histogram pass, by arc and block of arrivals
TABLE = 1 << 22  # entries of the table that is broadcast: arcs x shards
NEVER = 2**62


def ring(shards: int, vnodes: int = VNODES, seed: int = 7) -> tuple[list[int], list[list[int]]]:
    """The virtual nodes' places in order, and for the arc that ends at each, all shards as they follow clockwise.

    A shard's places don't depend on the number of shards.
    """
    points = []
    for s in range(shards):
        r = random.Random(f"{seed}/{s}")
        points += [(r.randrange(RING), s) for _ in range(vnodes)]
    points.sort()
    near: list[list[int]] = [[]] * len(points)
    follow: list[int] = []
    for i in range(2 * len(points) - 1, -1, -1):  # twice round: what follows a node is known when it is reached again
        s = points[i % len(points)][1]
        follow = [s, *(x for x in follow if x != s)]
        near[i % len(points)] = follow
    return [p for p, _ in points], near


def arc_table(points: list[int]) -> list[tuple[int, int, list[int]]]:
    """For each bin of the ring: its number, the arc at its begin and the places of virtual nodes in it."""
    return [(b, bisect.bisect_left(points, b * BIN), points[bisect.bisect_left(points, b * BIN) : bisect.bisect_left(points, (b + 1) * BIN)]) for b in range(RING // BIN)]


def ranked(df: DataFrame, order: list[str], group: list[str], bucket: Column, name: str) -> DataFrame:
    """Adds ``name``: the row's number from 0 within ``group`` in the order (bucket, *order).

    Two levels: rows are numbered inside a bucket, buckets are offset by counts;
    no task holds a whole group.
    """
    df = df.withColumn("__b", bucket)
    sizes = df.groupBy(*group, "__b").agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    before = F.sum("__n").over(w.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(*group, "__b", F.coalesce(before, F.lit(0)).alias("__before"))
    nth = F.row_number().over(Window.partitionBy(*group, "__b").orderBy(*order))
    return (
        df.withColumn("__nth", nth)
        .join(sizes, [*group, "__b"])
        .withColumn(name, (F.col("__before") + F.col("__nth") - 1).cast("long"))
        .drop("__b", "__nth", "__before")
    )


def _buckets(n: int, per: int = 50_000) -> int:
    return max(1, -(-n // per))


def shard_documents(docs: DataFrame, shards: int = 8, slack: float = 0.0, vnodes: int = VNODES) -> DataFrame:
    """Places every row; no shard holds more than its capacity.

    ``slack`` 0: capacities add up to the number of rows and differ by one at
    most, so the counts do too. ``slack`` e > 0: each shard takes up to
    ceil((1 + e) * rows / shards), which moves fewer rows when shards are added.

    size is the UTF-8 length plus 1; null text counts as none (size 1, crc32 of
    no bytes 0). A null doc_id hashes like any value. Rows that repeat a doc_id
    start at the same point and overflow clockwise like any others, so a hot
    doc_id is spread. Empty table: empty result; other columns are ignored.

    Returns doc_id, size, text_crc32, shard, slot (gapless from 0 in a shard).
    """
    if shards < 1 or slack < 0 or vnodes < 1:
        raise ValueError("shards and vnodes are at least 1, slack not negative")
    if shards * shards * vnodes > TABLE:
        raise ValueError(f"the ring's table has shards x shards x vnodes entries, {TABLE} at most: take fewer virtual nodes")
    points, prefs = ring(shards, vnodes)
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = only(docs, "doc_id", "text").select(
        "doc_id",
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    rows = rows.withColumn("at", F.xxhash64(F.lit("arrival"), "doc_id", "size", "text_crc32"))
    # a row lies on the arc that ends at the first virtual node at or after its place
    bins = spark.createDataFrame(arc_table(points), "bin int, arc int, nodes array<int>")
    rows = rows.withColumn("place", F.pmod(F.xxhash64(F.lit("ring"), "doc_id"), F.lit(RING)).cast("int")).withColumn("bin", F.floor(F.col("place") / BIN).cast("int"))
    ahead = F.size(F.filter("nodes", lambda p: p < F.col("place")))
    rows = rows.join(F.broadcast(bins), "bin").withColumn("spot", F.pmod(F.col("arc") + ahead, F.lit(len(points)))).drop("bin", "arc", "nodes", "place")
    rows = settle(rows.withColumn("row", F.monotonically_increasing_id()), "shardrows")
    total = rows.count()
    many = _buckets(total)
    # the arrival hash is uniform over signed 64 bits: its top bits are an even bucket that keeps order
    rows = rows.withColumn("bucket", F.floor((F.shiftright("at", 32).cast("double") / 2**32 + 0.5) * many).cast("int"))
    # rows that repeat one document share a hash, hence a bucket: in a bucket of over four times its share
    # rows come in the order in which they were read, so that its parts are numbered apart
    hot = rows.groupBy("bucket").count().filter(F.col("count") > 4 * total / many + 1000).select("bucket", F.lit(True).alias("hot"))
    rows = rows.join(F.broadcast(hot), "bucket", "left")
    part = F.when(F.col("hot"), F.shiftright("row", 33)).otherwise(F.lit(0).cast("long"))
    keyed = settle(ranked(rows, ["at", "row"], [], F.struct("bucket", part.alias("part")), "arrival").select("doc_id", "size", "text_crc32", "spot", "arrival"), "arrivals")

    room = [total // shards + (s < total % shards) for s in range(shards)] if slack == 0 else [int(-(-(1 + slack) * total // shards))] * shards
    cutoff = _fill(keyed, total, prefs, room)

    table = spark.createDataFrame([(i, p) for i, p in enumerate(prefs)], "spot int, prefs array<int>")
    limits = F.array(*[F.lit(c) for c in cutoff])
    placed = keyed.join(F.broadcast(table), "spot").withColumn(
        "shard", F.filter("prefs", lambda s: F.col("arrival") < F.element_at(limits, s + 1))[0]
    )
    slot_bucket = F.floor(F.col("arrival") * (many / max(total, 1))).cast("int")
    return ranked(placed.select("doc_id", "size", "text_crc32", "shard", "arrival"), ["arrival"], ["shard"], slot_bucket, "slot").drop("arrival")


def _fill(keyed: DataFrame, total: int, prefs: list[list[int]], room: list[int]) -> list[int]:
    """For each shard the arrival number from which it takes no more (NEVER if it doesn't fill)."""
    left, cutoff = list(room), [NEVER if r else 0 for r in room]
    order = np.array(prefs)

    def histogram(lo: int, hi: int) -> tuple[int, dict[int, np.ndarray]]:
        width = max(1, -(-(hi - lo) // max(16, COUNTS // len(prefs))))
        counts = (
            keyed.filter((F.col("arrival") >= lo) & (F.col("arrival") < hi))
            .groupBy(F.floor((F.col("arrival") - lo) / width).cast("int").alias("block"), "spot").count().toArrow()
        )
        out: dict[int, np.ndarray] = {}
        for b, s, n in zip(*(counts.column(i).to_pylist() for i in range(3))):
            out.setdefault(b, np.zeros(len(prefs), dtype=np.int64))[s] = n
        return width, out

    def walk(lo: int, hi: int) -> None:
        """Takes the arrivals of [lo, hi) in order, going down only into blocks in which a shard fills."""
        width, blocks = histogram(lo, hi)
        for b in sorted(blocks):
            if all(c != NEVER for c in cutoff):
                return
            closed = np.array([c != NEVER for c in cutoff])
            to = order[np.arange(len(prefs)), np.argmax(~closed[order], axis=1)]
            takes = np.bincount(to, weights=blocks[b], minlength=len(room)).astype(np.int64)
            if all(t < r or t == 0 for t, r in zip(takes, left)):
                for s, t in enumerate(takes):
                    left[s] -= int(t)
            elif width == 1:
                s = int(np.argmax(takes))
                left[s] -= 1
                if left[s] == 0:
                    cutoff[s] = lo + b + 1
            else:
                walk(lo + b * width, min(hi, lo + (b + 1) * width))

    if total:
        walk(0, total)
    return cutoff
