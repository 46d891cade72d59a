"""MinHash near-dedup: one-permutation hashing, optimal densification, star edges.

1. Each document's distinct word shingles are hashed once; the hash range is cut
   into bins and a bin keeps its least hash. Empty bins copy the bin that their
   own fixed random sequence of bins reaches first (optimal densification).
2. Documents with the same shingle set form a class; only one of a class goes on.
3. Bands of bins give buckets. In a bucket the member that meets most others in all
   its buckets is the centre of a star: one candidate edge for each other member,
   never all pairs. A group of copies of one text has that text as its centre.
4. Edges are confirmed on the full shingle sets and components are formed.
5. A bucket whose members already share one component is done. The members of all
   other buckets are searched exactly, across components only: shingles are put in
   order of rarity, and two sets that are similar enough must share a shingle among
   the first few of both (prefix and position filters). So no link between members
   of a bucket is lost, there is no cap, and members of one component never meet.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.components import connected_components
from marlstone.llm.frames import first_of_repeats, id_key, only, settle, stowed
from marlstone.llm.words import NOT_SPACE, U, mix, shingles, text_buffer, text_groups, words

SHINGLE, BANDS, ROWS = 5, 48, 5
BINS = BANDS * ROWS
PERCENT = 75
CELLS = 1 << 18  # of the table that tells frequent shingles from rare ones
_probe = np.stack([np.random.Generator(np.random.PCG64([11, i])).permutation(BINS) for i in range(BINS)])
_BAND = np.random.Generator(np.random.PCG64(5)).integers(1, 2**62, (BANDS, ROWS), dtype=np.uint64) * U(2) + U(1)


def shingle_sets(number: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingles of each text; fewer than SHINGLE words make one shingle."""
    every = shingles(number, SHINGLE)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= SHINGLE:
            s = np.sort(every[a : b - SHINGLE + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif b > a:
            out.append(shingles(number[a:b], b - a) ^ U(b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """One row of BINS hashes for each set; empty sets keep zeros."""
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    cell = owner * BINS + ((flat >> U(32)) * U(BINS) >> U(32)).astype(np.int64)
    head = np.ones(len(cell), dtype=bool)
    head[1:] = cell[1:] != cell[:-1]
    low, full = np.zeros(len(sets) * BINS, np.uint64), np.zeros(len(sets) * BINS, bool)
    low[cell[head]], full[cell[head]] = flat[head], True
    low, full = low.reshape(-1, BINS), full.reshape(-1, BINS)
    row, col = np.nonzero(~full & (sizes > 0)[:, None])
    for k in range(BINS):
        if not len(row):
            break
        to = _probe[col, k]
        hit = full[row, to]
        low[row[hit], col[hit]] = low[row[hit], to[hit]]
        row, col = row[~hit], col[~hit]
    return low


def band_keys(low: np.ndarray) -> np.ndarray:
    return mix((mix(low.reshape(-1, BANDS, ROWS)) * _BAND).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


SKETCH = "doc_id long, row long, check long, n_shingles long, digest binary, bands binary"


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_buffer(batch.column(3))
        for i, j in text_groups(offsets):
            w = words(data, offsets[i : j + 1], NOT_SPACE)
            sets = shingle_sets(w.number, w.first)
            bands = band_keys(sketches(sets))
            raw = [s.tobytes() for s in sets]
            yield pa.record_batch(
                [
                    batch.column(0)[i:j], batch.column(1)[i:j], batch.column(2)[i:j],
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(x, digest_size=16).digest() for x in raw], pa.binary()),
                    pa.array([b.tobytes() if len(s) else b"" for b, s in zip(bands, sets)], pa.binary()),
                ],
                names=["doc_id", "row", "check", "n_shingles", "digest", "bands"],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_buffer(batch.column(1))
        for i, j in text_groups(offsets):
            w = words(data, offsets[i : j + 1], NOT_SPACE)
            yield pa.record_batch([batch.column(0)[i:j], pa.array([s.tobytes() for s in shingle_sets(w.number, w.first)], pa.binary())], names=["node", "shingles"])


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many of a batch's sets have a shingle in each of the CELLS cells."""
    for batch in batches:
        if batch.num_rows:
            many = np.bincount(np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(2)]) % U(CELLS))
            cell = np.flatnonzero(many)
            yield pa.record_batch([pa.array(cell.astype(np.int32)), pa.array(many[cell])], names=["cell", "many"])


def _prefixes(weight):
    """(node, label, shingles) to the first shingles of each set in order of rarity.

    ``back`` is how many shingles of the set follow. Shingles further back than
    those given can't be the first one shared with a similar set.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                firsts = []
                for x in part.column(2):
                    s = np.frombuffer(x.as_buffer(), np.uint64)
                    s = s[np.lexsort((s, weight.value[s % U(CELLS)]))]
                    firsts.append(s[: len(s) + PERCENT * len(s) // -100 + 1])
                many = [len(s) for s in firsts]
                size = np.array([len(x.as_buffer()) // 8 for x in part.column(2)])
                back = np.concatenate([np.arange(n - 1, n - 1 - m, -1) for n, m in zip(size.tolist(), many)])
                columns = [np.repeat(c, many) for c in (part.column(0).to_numpy(), part.column(1).to_numpy(), size)]
                yield pa.record_batch([pa.array(c) for c in (*columns, np.concatenate(firsts).view(np.int64), back)], names=["node", "label", "n", "shingle", "back"])

    return run


def _explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, node) from (node, bands)."""
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            keys = np.frombuffer(b"".join(part.column(1).to_pylist()), np.int64)
            yield pa.record_batch([pa.array(keys), pa.array(np.repeat(part.column(0).to_numpy(zero_copy_only=False), BANDS))], names=["bucket", "node"])


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3)):
            a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = np.sort(np.concatenate((a, b)))
            shared = int(np.count_nonzero(both[1:] == both[:-1]))
            keep.append(100 * shared >= PERCENT * (len(a) + len(b) - shared))
        yield pa.record_batch([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def near_dedup(docs: DataFrame) -> DataFrame:
    """One row per document with its class of near duplicates.

    Documents are linked when their sets of five-word shingles have
    100 * intersection >= 75 * union. Fewer words than five make one shingle; a
    null, empty or blank text has none and is linked with nothing. A null doc_id
    keeps its row: it is linked like any other, and component_id is the smallest
    doc_id that isn't null (null only where the whole component has none). Rows
    that repeat a doc_id are separate rows of one class if their texts agree.
    Empty table: empty result; other columns are ignored. Very long texts are
    taken whole.

    Returns doc_id, n_shingles, component_id, kept (doc_id = component_id; of rows
    that repeat that doc_id in one component, one).
    """
    return _classified(docs).select("doc_id", "n_shingles", "component_id", "kept")


def _classified(docs: DataFrame) -> DataFrame:
    texts = only(docs, "doc_id", "text").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("check"), "text"
    )
    rows = texts.select("doc_id", F.monotonically_increasing_id().alias("row"), "check", "text")
    leaf = settle(rows.mapInArrow(_sketch, SKETCH), "sketches")
    named = leaf.filter("n_shingles > 0")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    classes = settle(named.groupBy("digest").agg(F.min("row").alias("node"), F.min(rank).alias("least"), F.max("n_shingles").alias("n")), "classes")
    groups = classes.join(_link(texts, leaf, classes), "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = groups.groupBy("label").agg(F.min("least").alias("best"))
    found = groups.join(least, "label").select("digest", F.col("best.doc_id").alias("component_id"), F.col("best.row").alias("best"))
    out = leaf.select("doc_id", "row", "check", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("digest")).alias("digest")).join(found, "digest", "left")
    alone = F.col("n_shingles") == 0
    return out.select(
        "doc_id", "check", "n_shingles",
        F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        (alone | (F.col("row") == F.col("best"))).alias("kept"),
    )


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group of near duplicates; all columns stay, whatever their names.

    The one is the row that ``near_dedup`` keeps: the smallest doc_id of the
    component (a row with a null doc_id only if there is no other). Rows without
    words (null, empty or blank texts) are linked with nothing: all of them stay,
    repeated or not. Of rows that repeat a doc_id and its text one stays. Empty
    table: empty result. Very long texts are compared whole.
    """
    plain, (doc_id, text) = stowed(docs, "doc_id", "text")
    stay = _classified(docs).filter("kept").groupBy(id_key("doc_id").alias("id"), "check").agg(F.max("n_shingles").alias("n"))
    mine = plain.withColumn("id", id_key(doc_id)).withColumn("check", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    lone = F.when(F.col("n") == 0, F.monotonically_increasing_id()).otherwise(F.lit(-1))
    met = mine.join(stay, ["id", "check"]).withColumn("lone", lone).drop("n")
    return first_of_repeats(met, ["id", "check", "lone"]).select(plain.columns).toDF(*docs.columns)


def _link(texts: DataFrame, leaf: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, label) of the classes that have links."""
    firsts = classes.select("node")
    bands = leaf.select(F.col("row").alias("node"), "bands").join(firsts, "node", "left_semi").mapInArrow(_explode, "bucket long, node long")
    bands = settle(bands, "bands")
    shared = bands.join(bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).filter("members > 1"), "bucket")
    # the member that meets most others makes the best centre: in a group of copies that is the text they come from
    pull = shared.groupBy("node").agg(F.sum("members").alias("pull"))
    shared = settle(shared.select("bucket", "node").join(pull, "node"), "shared")
    centres = shared.groupBy("bucket").agg(F.max(F.struct("pull", "node"))["node"].alias("centre"))
    members = settle(shared.select("bucket", "node").join(centres, "bucket"), "members")
    # full sets of the documents that have candidates at all; repeated rows have the same set
    some = leaf.select(F.col("row").alias("node"), id_key("doc_id").alias("id"), "check").join(members.select("node").distinct(), "node", "left_semi")
    met = texts.withColumn("id", id_key("doc_id")).join(some, ["id", "check"]).select("node", "text")
    sets = settle(met.mapInArrow(_sets, "node long, shingles binary").dropDuplicates(["node"]), "sets")

    stars = members.filter("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    links = _confirmed(stars, sets)
    labels = connected_components(links)
    known = members.select("bucket", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    known = settle(known, "known")
    still = known.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("bucket")
    rest = settle(known.join(still, "bucket").select("node", "label").distinct(), "rest")
    if rest.isEmpty():
        return labels
    more = _confirmed(_crossing(rest, sets), sets)
    return labels if more.isEmpty() else connected_components(links.union(more))


def _crossing(rest: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): pairs of different labels that the prefix and position filters can't rule out."""
    mine = settle(rest.join(sets, "node").select("node", "label", "shingles"), "mixed")
    # any order that is the same for all sets will do: counts by cell tell the frequent shingles from the rare, in a table of fixed size
    counts = mine.mapInArrow(_cells, "cell int, many long").groupBy("cell").agg(F.sum("many").alias("many")).toArrow()
    weight = np.zeros(CELLS, np.int64)
    weight[counts.column(0).to_numpy()] = counts.column(1).to_numpy()
    weight = mine.sparkSession.sparkContext.broadcast(weight)
    prefix = settle(mine.mapInArrow(_prefixes(weight), "node long, label long, n long, shingle long, back long"), "prefixes")
    sizes = rest.groupBy("label").agg(F.count(F.lit(1)).alias("nodes"))
    sized = prefix.groupBy("shingle", "label").agg(F.count(F.lit(1)).alias("here")).join(sizes, "label")
    mixed = sized.groupBy("shingle").agg(F.max_by("label", F.struct("nodes", "label")).alias("main"), F.count(F.lit(1)).alias("labels")).filter("labels > 1").select("shingle", "main")
    met = settle(prefix.join(mixed, "shingle"), "met")
    x = met.filter("label <> main").select("shingle", F.col("node").alias("x"), F.col("label").alias("lx"), F.col("n").alias("nx"), F.col("back").alias("bx"))
    y = met.select("shingle", F.col("node").alias("y"), F.col("label").alias("ly"), F.col("n").alias("ny"), F.col("back").alias("by"))
    # 100 * i >= PERCENT * (nx + ny - i) needs this intersection; no more than the rest of both can follow the first one shared
    need = F.ceil((F.col("nx") + F.col("ny")) * PERCENT / (100 + PERCENT) - 1e-9)
    near = x.join(y, (x["shingle"] == y["shingle"]) & (F.col("lx") != F.col("ly")) & (F.least("bx", "by") + 1 >= need))
    return near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose full shingle sets are similar enough."""
    met = pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    met = met.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
    return settle(met.select("a", "b", "sa", "sb").mapInArrow(_confirm, "a long, b long"), "links")
