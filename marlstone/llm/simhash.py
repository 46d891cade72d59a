"""SimHash near-dedup: fingerprints of shingles, linked through a Gray-order hierarchical index.

1. A fingerprint bit is set if over half of a text's shingles (repeats included) have
   it set in their XXH64. Equal fingerprints are one node.
2. Two fingerprints with 3 or fewer differing bits agree on one quarter of the bits.
   So the index has four orders, one for each quarter, which is moved to the front;
   its values are the upper nodes and are dealt out over the cluster.
3. Below an upper node, members are sorted by Gray rank, so that neighbours differ in
   few bits. Groups of neighbours become nodes that hold the bits on which all their
   members agree (a mask and a pattern), level by level. Pairs of nodes are followed
   from the top; the differences on the bits that both fix accumulate, and a pair with
   over 3 is dropped with all that is below it, as is one that is linked already.
4. An upper node with over GROUP members is opened further. Its members are first
   linked in lots, which joins most of a dense cloud. If they then have one component
   they are done; otherwise the bits left are quartered once more. With BASE bits left
   no group can exceed GROUP, since its members differ. So no task meets a larger group
   and nothing is left out.
5. Every group gives a forest (fewer edges than members), never all its pairs; the
   forests' components are those of all links.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.components import connected_components
from marlstone.llm.frames import only, settle
from marlstone.llm.words import U, mix, text_buffer

SHINGLE, SEED, BITS = 3, 42, 64
NEAR = 3                 # differing bits of a link
BASE = 12                # bits left when quartering ends
GROUP = 1 << BASE        # members of a group that are met at once
FAN = 8                  # children of a node
HOT, SALTS = 4096, 64    # documents of one fingerprint that stay together; places over which more of them are dealt
STRETCH = 1 << 20        # bytes of a text whose shingles are hashed at once
BLOCK = 1 << 16          # pairs of nodes that are opened at once


def normal_stretches(text: bytes, size: int = STRETCH) -> Iterator[list[bytes]]:
    """The lower-cased words of a text, a stretch at a time; each stretch begins with the last SHINGLE - 1 words before it."""
    at, carry = 0, []
    while at < len(text):
        stop = min(len(text), at + size)
        while stop < len(text) and text[stop] not in b" \t\n\r\x0b\x0c":  # a word isn't cut
            stop += 1
        found = carry + text[at:stop].lower().split()
        at = stop
        yield found
        carry = found[-(SHINGLE - 1) :]


def fingerprint(text: bytes, digest, size: int = STRETCH) -> int:
    """The fingerprint of a text; 0 without words."""
    ones, many, words = np.zeros(BITS, np.int64), 0, []
    for words in normal_stretches(text, size):
        if len(words) < SHINGLE:
            continue
        joined = b" ".join(words)
        end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        start = np.append(0, end[:-1] + 1)
        view = memoryview(joined)
        cut = [view[a:z] for a, z in zip(start.tolist(), end[SHINGLE - 1 :].tolist())]
        h = np.fromiter(map(digest, cut), np.uint64, len(cut))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        many += len(h)
    if not many and words:  # fewer words than a shingle has: the whole sequence is one
        return digest(b" ".join(words))
    return int.from_bytes(np.packbits(2 * ones > many, bitorder="little").tobytes(), "little")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    digest = partial(xxhash.xxh64_intdigest, seed=SEED)
    for batch in batches:
        data, offsets = text_buffer(batch.column(1))
        prints = [fingerprint(data[a:z].tobytes(), digest) for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        yield pa.record_batch([batch.column(0), pa.array(np.array(prints, np.uint64).view(np.int64))], names=["doc_id", "node"])


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each value in the Gray code's order, where neighbours differ in one bit."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> U(s)
    return x


def hierarchy(members: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(mask, pattern) of the nodes of each level, leaves first; node i has children i*FAN to i*FAN+FAN-1 below it."""
    levels = [(np.full(len(members), ~U(0)), members)]
    while len(levels[-1][0]) > 1:
        mask, pattern = levels[-1]
        at = np.arange(0, len(mask), FAN)
        same = ~(np.bitwise_or.reduceat(pattern, at) ^ np.bitwise_and.reduceat(pattern, at)) & np.bitwise_and.reduceat(mask, at)
        levels.append((same, pattern[at] & same))
    return levels


def _roots(up: np.ndarray) -> np.ndarray:
    while True:
        top = up[up]
        if (top == up).all():
            return up
        up = top


def forest(members: np.ndarray, near: int = NEAR) -> tuple[np.ndarray, np.ndarray]:
    """Edges (a, b) that span the components of distinct members linked at ``near`` or fewer differing bits."""
    members = members[np.argsort(gray_rank(members))]
    levels = hierarchy(members)
    up = np.arange(len(members))
    out: list[tuple[np.ndarray, np.ndarray]] = []

    def link(a: np.ndarray, b: np.ndarray) -> None:
        """Joins the components of a[i] and b[i]; keeps the edges that did it."""
        nonlocal up
        while len(a):
            ra, rb = up[a], up[b]
            new = ra != rb
            a, b, lo, hi = a[new], b[new], np.minimum(ra, rb)[new], np.maximum(ra, rb)[new]
            roots, nth = np.unique(hi, return_index=True)  # each root hooks once
            out.append((members[a[nth]], members[b[nth]]))
            up[roots] = lo[nth]
            up = _roots(up)

    if len(members) > 1:  # neighbours in Gray order first: what they join needn't be compared again
        close = np.flatnonzero(np.bitwise_count(members[1:] ^ members[:-1]) <= near)
        link(close, close + 1)
    todo = [(len(levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while todo:
        level, x, y, differ = todo.pop()
        if level:  # pairs inside one component have nothing to add
            at = np.arange(0, len(members), FAN**level)
            lo, hi = np.minimum.reduceat(up, at), np.maximum.reduceat(up, at)
            live = ~((lo[x] == hi[x]) & (lo[y] == hi[y]) & (lo[x] == lo[y]))
            x, y, differ = x[live], y[live], differ[live]
        if len(x) > BLOCK // (FAN * FAN) and level:
            for i in range(0, len(x), BLOCK // (FAN * FAN)):
                part = slice(i, i + BLOCK // (FAN * FAN))
                todo.append((level, x[part], y[part], differ[part]))
            continue
        if not level:
            link(x, y)
            continue
        mask, pattern = levels[level - 1]
        i, j = (g.ravel() for g in np.meshgrid(np.arange(FAN), np.arange(FAN), indexing="ij"))
        cx, cy = (x[:, None] * FAN + i).ravel(), (y[:, None] * FAN + j).ravel()
        before, shared_above = np.repeat(differ, FAN * FAN), np.repeat(levels[level][0][x] & levels[level][0][y], FAN * FAN)
        ok = (cx < len(mask)) & (cy < len(mask)) & (cx <= cy if level > 1 else cx < cy)
        cx, cy, before, shared_above = cx[ok], cy[ok], before[ok], shared_above[ok]
        # bits fixed above were counted there; those that both children fix besides are added
        total = before + np.bitwise_count((pattern[cx] ^ pattern[cy]) & mask[cx] & mask[cy] & ~shared_above)
        ok = total <= near
        if ok.any():
            todo.append((level - 1, cx[ok], cy[ok], total[ok]))
    none = np.zeros(0, np.uint64)
    return (np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])) if out else (none, none)


def quarters(left: int) -> list[int]:
    """The masks of the four quarters of the bits set in ``left``, highest first."""
    bits = [1 << i for i in range(BITS - 1, -1, -1) if left >> i & 1]
    cuts = [len(bits) * k // 4 for k in range(5)]
    return [sum(bits[a:z]) for a, z in zip(cuts, cuts[1:])]


def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, label, fixed) to one row for each quarter of the bits that ``fixed`` leaves: (key, node, label, fixed).

    ``key`` names the quarters taken so far and their values, by a 64-bit hash; two
    groups that share one would be searched together, which finds no wrong link.
    """
    for batch in batches:
        node, label, fixed, upper = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        many = [np.zeros(0, np.int64)] * 4
        parts = [many]
        for f in np.unique(fixed):
            own = fixed == f
            x = node[own].view(np.uint64)
            for q in quarters(~int(f) & (2**BITS - 1)):
                now = (int(f) & (2**BITS - 1)) | q
                key = mix(mix(x & U(now)) ^ mix(np.full(len(x), now, np.uint64)) ^ mix(upper[own].view(np.uint64) + U(q)))
                parts.append([key.view(np.int64), node[own], label[own], np.full(len(x), np.uint64(now)).view(np.int64)])
        columns = [np.concatenate(c) for c in zip(*parts)]
        for at in range(0, len(columns[0]), 1 << 15):
            yield pa.record_batch([pa.array(c[at : at + (1 << 15)]) for c in columns], names=["key", "node", "label", "fixed"])


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (key, lot, node) in order of (key, lot): the forest edges of each group."""
    held = [np.zeros(0, np.int64)] * 3  # rows of the latest group, which may go on

    def edges(key: np.ndarray, lot: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
        x = node.view(np.uint64)
        opens = np.append(True, (key[1:] != key[:-1]) | (lot[1:] != lot[:-1]))
        start = np.flatnonzero(opens)
        size = np.diff(np.append(start, len(x)))
        # a group of up to FAN members is a single leaf: members are compared at each distance in it
        leaf = np.repeat(np.where(size <= FAN, np.arange(len(size)), -1), size)
        out = []
        for d in range(1, FAN):
            at = np.flatnonzero((leaf[d:] == leaf[:-d]) & (leaf[d:] >= 0) & (np.bitwise_count(x[d:] ^ x[:-d]) <= NEAR))
            out.append((x[at], x[at + d]))
        out += [forest(x[a : a + n]) for a, n in zip(start[size > FAN].tolist(), size[size > FAN].tolist())]
        a, b = (np.concatenate(c).view(np.int64) for c in zip(*out))
        return pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])

    for batch in batches:
        now = [np.concatenate((h, batch.column(i).to_numpy(zero_copy_only=False))) for i, h in enumerate(held)]
        cut = np.flatnonzero((now[0][1:] != now[0][:-1]) | (now[1][1:] != now[1][:-1])) + 1
        whole = int(cut[-1]) if len(cut) else 0
        if whole:
            yield edges(*[c[:whole] for c in now])
        held = [c[whole:] for c in now]
    if len(held[0]):
        yield edges(*held)


def _grown(rows: DataFrame) -> DataFrame:
    """Forest edges of groups (key, lot, node)."""
    dealt = rows.select("key", "lot", "node").repartition("key", "lot").sortWithinPartitions("key", "lot")
    return dealt.mapInArrow(_forests, "a long, b long")


def link_fingerprints(nodes: DataFrame, group: int = GROUP) -> DataFrame:
    """(node, label) of all distinct ``node`` that have links; label is the least node (as a signed number) of the component."""
    now = nodes.select("node", F.col("node").alias("label"), F.lit(0).cast("long").alias("fixed"), F.lit(0).cast("long").alias("key"))
    edges = None
    while True:
        rows = settle(now.select("node", "label", "fixed", "key").mapInArrow(_open, "key long, node long, label long, fixed long"), "quarters")
        groups = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi"), F.min(BITS - F.bit_count("fixed")).alias("left"))
        large = (F.col("n") > group) & (F.col("left") > BASE)
        groups = settle(groups.filter("n > 1 and lo <> hi").select("key", "n", large.alias("large")), "groups")
        met = rows.join(groups, "key")
        lot = F.when(F.col("large"), F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / group))).otherwise(F.lit(0))
        grown = settle(_grown(met.withColumn("lot", lot.cast("long"))), "forest")
        edges = grown if edges is None else edges.union(grown)
        labels = connected_components(edges)
        opened = groups.filter("large").select("key")
        if opened.isEmpty():
            return labels
        # groups that were met in lots only go on if they still have several components
        rest = rows.join(opened, "key").drop("label").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        rest = settle(rest, "rest")
        apart = rest.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("key")
        now = rest.join(apart, "key")


def simhash_dedup(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """One row per document with its fingerprint and its class of near duplicates.

    Words are maximal runs without ASCII white space, A-Z lower-cased; a fingerprint
    is taken over all three-word shingles, repeats included. Fewer words than three
    make one shingle; a null, empty or blank text has the fingerprint 0, linked like
    any other. Fingerprints with NEAR or fewer differing bits are linked. A null
    doc_id keeps its row and is linked like any other; component_id is the smallest
    doc_id that isn't null (null only where the whole component has none). Rows that
    repeat a doc_id or a text stay separate rows. Empty table: empty result; other
    columns are ignored. Texts of any length are hashed whole, a stretch at a time.
    ``group`` changes how the work is dealt out, never the result.

    Returns doc_id, fingerprint (16 lowercase hex digits), component_id.
    """
    rows = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    leaf = settle(rows.mapInArrow(_fingerprints, "doc_id long, node long"), "fingerprints")
    nodes = settle(leaf.groupBy("node").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("many")), "nodes")
    known = nodes.join(link_fingerprints(nodes.select("node"), group), "node", "left").withColumn("label", F.coalesce("label", "node"))
    best = known.groupBy("label").agg(F.min("least").alias("component_id"))
    found = settle(known.join(best, "label").select("node", "many", "component_id"), "classes")
    # documents of a fingerprint that very many share are dealt out by a salt; the fingerprint's row is copied for each salt
    salted = leaf.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    hot = found.filter(F.col("many") > HOT).select("node", F.struct("component_id").alias("hot"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    met = settle(salted.join(hot, ["node", "salt"], "left").select("doc_id", "node", "hot"), "met")
    rest = met.filter("hot is null").select("doc_id", "node").join(found.filter(F.col("many") <= HOT), "node")
    out = met.filter("hot is not null").select("doc_id", "node", "hot.component_id").union(rest.select("doc_id", "node", "component_id"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("node"), 16, "0")).alias("fingerprint"), "component_id")
