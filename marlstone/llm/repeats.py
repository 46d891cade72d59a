"""Suffix-array dedup by a run-length index: long verbatim repeats.

A repeat is a 100-byte string that also starts earlier in the corpus. To spread
one index over a cluster, the text is cut by content:

1. Every 100-byte window has an anchor, the least hash among its 16-byte strings
   (leftmost if tied). Equal windows have equal anchors, so windows can only repeat
   inside an anchor's group. Neighbouring windows with the same anchor occurrence
   make one segment (184 bytes at most).
2. Copies of a segment are set aside before and after the shuffle by a fingerprint
   (64 bits besides the anchor's 64): all but the earliest are repeats as a whole,
   so a passage that a third of all documents share is indexed once. Anchors with a
   single segment are done.
3. Different segments with one anchor are where repeats begin and end. Their bytes
   are fetched and indexed, many anchors at a time: a run-compressed Burrows-Wheeler
   transform with suffix positions sampled at both ends of runs. Segments are then
   streamed through the index from their ends: each step follows the transform's
   runs to the row of the next longer suffix and keeps the length that this suffix
   shares with the row above, one more than before inside a run, compared byte by
   byte at the samples where a run begins. Rows that share 100 bytes form a class,
   in which all but the earliest position are repeats.
   An anchor whose segments exceed one index (a short line that stands in very many
   surroundings) is split: its windows are dealt out anew by a further 16-byte string,
   the next least hash among theirs, which equal windows share too; equal segments
   (compared byte by byte) are settled on the way. What still exceeds an index after
   LEVELS such steps is dealt out by windows, which are compared byte by byte.
4. Marks are joined to the documents, merged into maximal runs, and removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.frames import only, settle
from marlstone.llm.sharding import ranked
from marlstone.llm.words import BYTE, U, mix, powers, text_buffer, text_groups

LENGTH, GRAM = 100, 16
SPAN = LENGTH - GRAM + 1     # 16-byte strings in a window
PLACE_BITS = 30              # place of a byte in the bytes that are handled at once
BLOCK_BYTES = 1 << 20        # windows of a longer text that are handled at once
INDEX_BYTES = 2_000_000      # segment text in one index; a larger anchor group is split
BATCH_BYTES = 1 << 17        # segment text of small anchor groups that are indexed together: sorts of this size stay in cache
DEPTH = 189                  # suffixes are sorted whole, as no segment is longer
LEVELS = 4                   # times that an anchor group is split by a further string
KNOWN = 100_000              # heavy anchors, and segments of them, up to which they are broadcast


def _prefix_sums(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of a polynomial hash before each byte, and what takes the place out of a difference of two."""
    up, down = powers(len(b) + 1)
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(BYTE[b] * up[: len(b)], out=total[1:])
    return total, down


def blocks(offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, int]]:
    """(first, last text, their offsets, place in the text) of what is handled at once.

    That is some texts, or a part of a longer one; parts overlap so that each window is in one of them.
    """
    for i, j in text_groups(offsets):
        begin, end = int(offsets[i]), int(offsets[j])
        if j - i > 1 or end - begin <= BLOCK_BYTES + LENGTH:
            yield i, j, offsets[i : j + 1], 0
            continue
        for at in range(0, end - begin - LENGTH + 1, BLOCK_BYTES):
            yield i, j, np.array([begin + at, min(end, begin + at + BLOCK_BYTES + LENGTH - 1)]), at


def segments(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(anchor, fingerprint, text, start in text, length) of each segment of the texts."""
    lo = int(offsets[0])
    b, edge = data[lo : int(offsets[-1])], offsets - lo
    n = len(b)
    if n < LENGTH:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.int64))
    total, down = _prefix_sums(b)
    gram = mix((total[GRAM:] - total[:-GRAM]) * down[: n - GRAM + 1])
    low = U((1 << PLACE_BITS) - 1)  # hashes are compared without these bits, in texts of any size alike
    packed = (gram & ~low) | np.arange(len(gram), dtype=np.uint64)
    blocks = -(-len(packed) // SPAN) + 1
    padded = np.full(blocks * SPAN, ~U(0))
    padded[: len(packed)] = packed
    square = padded.reshape(blocks, SPAN)
    ahead = np.minimum.accumulate(square, axis=1).ravel()
    behind = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = n - LENGTH + 1
    anchor = (np.minimum(behind[:windows], ahead[SPAN - 1 : SPAN - 1 + windows]) & low).astype(np.int64)
    # windows that cross a text's end don't count
    inside = np.ones(windows + 1, bool)
    depth = np.zeros(windows + 1, np.int64)
    for e in edge[1:-1]:
        depth[max(0, e - LENGTH + 1)] += 1 if e - LENGTH + 1 < windows else 0
        depth[min(e, windows)] -= 1 if e - LENGTH + 1 < windows else 0
    inside[:windows] = np.cumsum(depth)[:windows] == 0
    inside[windows] = False
    new = np.ones(windows, bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | ~inside[: windows - 1]
    new &= inside[:windows]
    first = np.flatnonzero(new)
    closes = np.flatnonzero(inside[:windows] & (np.concatenate((new[1:], [True])) | ~inside[1:]))
    length = closes - first + LENGTH
    mark = mix((total[first + length] - total[first]) * down[first] + length.astype(np.uint64) * U(0x9E3779B97F4A7C15))
    text = np.searchsorted(edge, first, side="right") - 1
    return gram[anchor[first]].view(np.int64), mark.view(np.int64), text, first - edge[text], length


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_buffer(batch.column(1))
        order = batch.column(0).to_numpy(zero_copy_only=False)
        for i, j, some, at in blocks(offsets):
            anchor, mark, text, start, length = segments(data, some)
            doc, start = order[i:j][text], start + at
            # of equal segments here all but the earliest are repeats already: they needn't meet their anchor's group
            by = np.lexsort((start, doc, mark, anchor))
            again = np.zeros(len(by), bool)
            again[by[1:]] = (anchor[by[1:]] == anchor[by[:-1]]) & (mark[by[1:]] == mark[by[:-1]])
            yield pa.record_batch(
                [pa.array(again), pa.array(anchor), pa.array(mark), pa.array(doc), pa.array((start << 8) | length)],
                names=["again", "anchor", "mark", "doc", "span"],
            )


def _sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From segments in order of (again, anchor, mark, doc, span): repeats (anchor null) and firsts of mixed anchors.

    An anchor whose firsts have more than INDEX_BYTES together is named once more, with a null doc.
    """
    names = ["anchor", "doc", "span"]
    last, told = None, True  # the latest first occurrence, and whether it has been passed on
    weight = 0               # bytes passed on for its anchor
    for batch in batches:
        if not batch.num_rows:
            continue
        known = batch.column(0).to_numpy(zero_copy_only=False)
        a, m, d, s = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(1, 5))
        if known.any():
            yield pa.record_batch([pa.nulls(int(known.sum()), pa.int64()), pa.array(d[known]), pa.array(s[known])], names=names)
            a, m, d, s = a[~known], m[~known], d[~known], s[~known]
            if not len(a):
                continue
        carried = last is not None
        if carried:
            a, m, d, s = (np.concatenate(([x], y)) for x, y in zip(last, (a, m, d, s)))
        same_a = np.concatenate(([False], a[1:] == a[:-1]))
        first = ~same_a | np.concatenate(([True], m[1:] != m[:-1]))
        again = ~first
        at = np.flatnonzero(first)
        mixed = np.zeros(len(at), bool)
        later = same_a[at]                 # not its anchor's first segment
        mixed |= later
        mixed[:-1] |= later[1:]            # its anchor has a further segment
        if carried and told:
            mixed[0] = False
        out = np.concatenate((at[mixed], np.flatnonzero(again)))
        opens = np.flatnonzero(~later)
        if not len(opens) or opens[0]:
            opens = np.concatenate(([0], opens))
        total = np.add.reduceat(np.where(mixed, s[at] & 255, 0), opens)
        was, total[0] = weight, total[0] + (weight if carried else 0)
        over = total > INDEX_BYTES
        over[0] &= not (carried and was > INDEX_BYTES)
        weight = int(total[-1])
        if over.any():
            named = pa.array(a[at[opens[over]]])
            yield pa.record_batch([named, pa.nulls(len(named), pa.int64()), pa.nulls(len(named), pa.int64())], names=names)
        last = (a[at[-1]], m[at[-1]], d[at[-1]], s[at[-1]])
        told = bool(mixed[-1] or (len(at) == 1 and carried and told))
        yield pa.record_batch([pa.array(a[out], mask=again[out]), pa.array(d[out]), pa.array(s[out])], names=names)


class RunIndex(NamedTuple):
    """A run-compressed Burrows-Wheeler transform of segments, each closed by an end of its own.

    Row k < segments is the end of segment k; the suffixes follow in order, equal
    ones in order of their segments. Nothing is kept by row, only by run.
    """

    starts: np.ndarray   # first row of each run
    symbols: np.ndarray  # the run's preceding byte + 1, 0 before a segment's begin
    ends: np.ndarray     # (runs, 2) suffix positions at the run's first and last row, sampled
    rows: int


def run_index(text: np.ndarray, stop: np.ndarray) -> RunIndex:
    """``stop``: for each byte the end of its segment. A segment has fewer than DEPTH bytes and isn't empty."""
    n = len(text)
    at = np.arange(n)
    symbol = text.astype(np.int64) + 1

    def pack(rank: np.ndarray, base: int, steps: list[int]) -> np.ndarray:
        key = rank.copy()
        for s in steps:
            key *= base
            if s < n:
                key[: n - s] += np.where(at[s:] < stop[: n - s], rank[s:], 0)
        return key

    key, depth = pack(symbol, 257, [1, 2, 3, 4, 5, 6]), 7
    while depth < DEPTH:
        order = np.argsort(key)
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate(([1], key[order][1:] != key[order][:-1])))
        base = int(rank.max()) + 1
        parts = 3 if base**3 < 2**63 else 2
        key, depth = pack(rank, base, [k * depth for k in range(1, parts)]), parts * depth
    last = np.flatnonzero(np.append(stop[1:] != stop[:-1], True))  # each segment's last byte
    # an end is named by the position after its segment's last byte, which it shares with the next one's first
    position = np.concatenate((last + 1, np.argsort(key, kind="stable")))
    before = np.concatenate(([0], symbol[:-1]))
    before[np.append(0, last[:-1] + 1)] = 0
    bwt = np.concatenate((symbol[last], before[position[len(last) :]]))
    starts = np.flatnonzero(np.append(True, bwt[1:] != bwt[:-1]))
    final = np.append(starts[1:], len(bwt)) - 1
    return RunIndex(starts, bwt[starts], np.stack([position[starts], position[final]], axis=1), len(bwt))


def _shared(text: np.ndarray, x: np.ndarray, y: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """How many bytes the text shares at ``x`` and at ``y``, up to ``limit``."""
    padded = np.concatenate((text, np.zeros(8, np.uint8)))
    eight = np.lib.stride_tricks.sliding_window_view(padded, 8).copy().view(np.uint64).ravel()
    out = np.zeros(len(x), np.int64)
    live = np.flatnonzero(limit > 0)
    while len(live):
        at = out[live]
        differ = eight[x[live] + at] ^ eight[y[live] + at]
        low = differ & (~differ + U(1))  # the lowest bit that differs is in the first byte that differs
        same = np.where(differ == 0, 8, np.log2(np.maximum(low, U(1)).astype(float)).astype(np.int64) >> 3)
        out[live] = np.minimum(at + same, limit[live])
        live = live[(same == 8) & (out[live] < limit[live])]
    return out


def matching_statistics(index: RunIndex, text: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each position the row of its suffix and how many bytes it shares with the row above.

    All segments are streamed at once, from their ends to their begins.
    """
    runs, symbols = len(index.starts), index.symbols
    size = np.diff(np.append(index.starts, index.rows))
    # a run's rows follow those of earlier runs of the same byte; below them come all smaller bytes and the ends
    by = np.argsort(symbols, kind="stable")
    total = np.bincount(symbols, weights=size, minlength=258).astype(np.int64)
    below = np.cumsum(total) - total
    ordered = np.cumsum(size[by]) - size[by]
    head = np.empty(runs, np.int64)  # the row to which a run's first row leads
    head[by] = ordered
    # before[r]: the latest earlier run of the same byte; what it shares with this one is compared at the samples
    before = np.full(runs, -1)
    before[by[1:]] = np.where(symbols[by[1:]] == symbols[by[:-1]], by[:-1], -1)
    opening = np.zeros(runs, np.int64)
    met = np.flatnonzero((before >= 0) & (symbols > 0))
    x, y = index.ends[met, 0] - 1, index.ends[before[met], 1] - 1
    opening[met] = _shared(text, x, y, np.minimum(stop[x] - x, stop[y] - y))
    # spelled out by row for the streaming: the row each row leads to, and what a run's first row opens with (-1 elsewhere)
    run = np.repeat(np.arange(runs), size)
    leads = (head - index.starts)[run] + np.arange(index.rows)
    opens = np.full(index.rows, -1)
    opens[index.starts] = opening
    row, shared = np.empty((2, len(text)), np.int64)
    at = np.flatnonzero(np.append(stop[1:] != stop[:-1], True)) + 1  # one past the next byte, for each segment
    begin = np.append(0, at[:-1])
    now, length = np.arange(len(at)), np.zeros(len(at), np.int64)
    while len(at):
        fresh = opens[now]
        now, length = leads[now], np.where(fresh < 0, length + 1, fresh)
        at = at - 1
        row[at], shared[at] = now, length
        on = at > begin
        if not on.all():
            at, begin, now, length = at[on], begin[on], now[on], length[on]
    return row, shared


def repeated_starts(index: RunIndex, text: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Positions whose LENGTH bytes also start earlier in the indexed text, in order."""
    row, shared = matching_statistics(index, text, stop)
    fresh = np.ones(index.rows, bool)
    fresh[row] = shared < LENGTH
    position = np.flatnonzero(stop - np.arange(len(text)) >= LENGTH)
    group = np.cumsum(fresh)[row[position]]
    order = np.argsort(group, kind="stable")  # keeps the order of positions inside a class
    again = np.append(False, group[order][1:] == group[order][:-1])
    return np.sort(position[order[again]])


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (anchor, doc, span, bytes) in order of (anchor, doc, span): repeated spans."""
    names = ["doc", "span"]

    def run(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        data, offsets = text_buffer(rows.column(3).combine_chunks().view(pa.string()))
        text = data[offsets[0] : offsets[-1]]
        edge = offsets - offsets[0]
        if not len(text):
            return
        stop = np.repeat(edge[1:], np.diff(edge))
        starts = repeated_starts(run_index(text, stop), text, stop)
        if not len(starts):
            return
        owner = np.searchsorted(edge, starts, side="right") - 1
        cut = np.concatenate(([True], (starts[1:] != starts[:-1] + 1) | (owner[1:] != owner[:-1])))
        a = np.flatnonzero(cut)
        z = np.append(a[1:], len(starts)) - 1
        seg = owner[a]
        begin = (rows.column(2).to_numpy() >> 8)[seg] + starts[a] - edge[seg]
        yield pa.record_batch([pa.array(rows.column(1).to_numpy()[seg]), pa.array((begin << 8) | (starts[z] - starts[a] + LENGTH))], names=names)

    def indexed(rows: pa.Table, stops: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Indexes the groups that end at ``stops``, as many at once as fit BATCH_BYTES; no group exceeds INDEX_BYTES."""
        done = 0
        weight = np.cumsum(rows.column(2).to_numpy() & 255)
        while len(ahead := stops[stops > done]):
            base = weight[done - 1] if done else 0
            fit = ahead[weight[ahead - 1] - base <= min(BATCH_BYTES, INDEX_BYTES)]
            stop = int(fit[-1] if len(fit) else ahead[0])
            yield from run(rows.slice(done, stop - done))
            done = stop

    def ends(rows: pa.Table) -> np.ndarray:
        anchor = rows.column(0).to_numpy()
        return np.flatnonzero(anchor[1:] != anchor[:-1]) + 1

    held: list[pa.RecordBatch] = []
    size, enough = 0, INDEX_BYTES
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.nbytes
        if size >= enough:
            rows = pa.Table.from_batches(held)
            cuts = ends(rows)
            yield from indexed(rows, cuts)
            held = rows.slice(int(cuts[-1]) if len(cuts) else 0).to_batches()
            size = sum(x.nbytes for x in held)
            enough = max(INDEX_BYTES, 2 * size)
    if held:
        rows = pa.Table.from_batches(held)
        yield from indexed(rows, np.append(ends(rows), rows.num_rows))


PIECE = "anchor long, doc long, span long, bytes binary"


def _piece(anchor: np.ndarray, doc: np.ndarray, span: np.ndarray, bodies: list[bytes]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(anchor), pa.array(doc), pa.array(span), pa.array(bodies, pa.binary())], names=["anchor", "doc", "span", "bytes"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fetches the bytes of the wanted segments: (doc, doc_id, text, (anchor, span) each or null) to (anchor, doc, span, bytes)."""
    for batch in batches:
        batch = batch.filter(batch.column(3).is_valid())
        data, offsets = text_buffer(batch.column(2))
        doc = batch.column(0).to_numpy(zero_copy_only=False)
        want = batch.column(3)
        for k in range(batch.num_rows):
            pairs = want[k].values
            body = data[offsets[k] : offsets[k + 1]]
            for at in range(0, len(pairs), 1 << 14):
                part = pairs.slice(at, 1 << 14)
                span = part.field(1).to_numpy(zero_copy_only=False)
                cut = [body[s : s + n].tobytes() for s, n in zip((span >> 8).tolist(), (span & 255).tolist())]
                yield _piece(part.field(0).to_numpy(zero_copy_only=False), np.full(len(span), doc[k]), span, cut)


def _windows_of(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all segments, owner of each window, its place there, its place among all bytes)."""
    data, offsets = text_buffer(rows.column(3).view(pa.string()))
    b, edge = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    many = np.diff(edge) - LENGTH + 1
    owner = np.repeat(np.arange(len(many)), many)
    nth = np.arange(len(owner)) - (np.cumsum(many) - many)[owner]
    return b, owner, nth, edge[owner] + nth


def _refine(level: int):
    """Segments of one anchor to shorter ones, each of neighbouring windows that agree in their least string but ``level``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                b, owner, nth, place = _windows_of(rows)
                total, down = _prefix_sums(b)
                gram = mix((total[GRAM:] - total[:-GRAM]) * down[: len(b) - GRAM + 1])
                inside = np.sort(gram[place[:, None] + np.arange(SPAN)], axis=1)
                rank = np.cumsum(inside[:, 1:] != inside[:, :-1], axis=1)  # of distinct strings
                at_level = np.argmax(rank == level, axis=1)
                value = np.where(rank[:, -1] >= level, inside[np.arange(len(inside)), at_level + 1], U(0))
                fresh = np.append(True, (value[1:] != value[:-1]) | (owner[1:] != owner[:-1]))
                a = np.flatnonzero(fresh)
                length = np.append(a[1:], len(value)) - a - 1 + LENGTH
                anchor, doc, span = (rows.column(i).to_numpy(zero_copy_only=False)[owner[a]] for i in range(3))
                key = mix(anchor.view(np.uint64) ^ mix(value[a] + U(level)))
                cut = [b[p : p + n].tobytes() for p, n in zip(place[a].tolist(), length.tolist())]
                yield _piece(key.view(np.int64), doc, (((span >> 8) + nth[a]) << 8) | length, cut)

    return run


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of segments, each under a hash of its bytes."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            rows = batch.slice(at, 256)
            b, owner, nth, place = _windows_of(rows)
            total, down = _prefix_sums(b)
            value = mix((total[place + LENGTH] - total[place]) * down[place])
            doc, span = (rows.column(i).to_numpy(zero_copy_only=False)[owner] for i in (1, 2))
            yield _piece(value.view(np.int64), doc, (((span >> 8) + nth) << 8) | LENGTH, [b[p : p + LENGTH].tobytes() for p in place.tolist()])


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From pieces in order of (anchor, bytes, doc, span): adds again, true but for the earliest of those with equal bytes."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        anchor, body = batch.column(0).to_numpy(zero_copy_only=False), batch.column(3)
        again = np.zeros(batch.num_rows, bool)
        again[1:] = (anchor[1:] == anchor[:-1]) & pc.equal(body[1:], body[:-1]).to_numpy(zero_copy_only=False)
        again[0] = last is not None and last == (anchor[0], body[0].as_py())
        last = anchor[-1], body[len(body) - 1].as_py()
        yield pa.record_batch([pa.array(again), *batch.columns], names=["again", "anchor", "doc", "span", "bytes"])


def _told(pieces: DataFrame) -> DataFrame:
    ordered = pieces.repartition("anchor").sortWithinPartitions("anchor", "bytes", "doc", "span")
    return settle(ordered.mapInArrow(_once, f"again boolean, {PIECE}"), "told")


def split_heavy(rest: DataFrame, levels: int, limit: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """(pieces of anchors that fit an index, repeats found on the way) from the segments of anchors that don't."""
    fit, marks = [], []
    for level in range(1, levels + 1):
        told = _told(rest.mapInArrow(_refine(level), PIECE))
        marks.append(told.filter("again").select("doc", "span"))
        firsts = told.filter("not again").drop("again")
        size = F.sum(F.col("span").bitwiseAND(255))
        large = settle(firsts.groupBy("anchor").agg(size.alias("size")).filter(F.col("size") > limit).select("anchor"), "large")
        if large.isEmpty():
            return [*fit, firsts], marks
        fit.append(firsts.join(large, "anchor", "left_anti"))
        rest = firsts.join(large, "anchor", "left_semi").select("anchor", "doc", "span", "bytes")
    marks.append(_told(rest.mapInArrow(_windows, PIECE)).filter("again").select("doc", "span"))
    return fit, marks


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_buffer(batch.column(2))
        marks = batch.column(3)
        removed, runs, digest, kept = [], [], [], []
        for k in range(batch.num_rows):
            body = data[offsets[k] : offsets[k + 1]]
            if not marks[k].is_valid:
                removed.append(0), runs.append(b""), digest.append(hashlib.sha256(body).hexdigest())
                continue
            span = np.sort(marks[k].values.to_numpy(zero_copy_only=False))
            start, end = span >> 8, np.maximum.accumulate((span >> 8) + (span & 255))
            opens = np.concatenate(([True], start[1:] > end[:-1]))
            a = start[opens]
            z = end[np.append(np.flatnonzero(opens)[1:], len(start)) - 1]
            rest = hashlib.sha256()
            for s, e in zip([0, *z.tolist()], [*a.tolist(), len(body)]):
                rest.update(body[s:e])
            removed.append(int((z - a).sum())), digest.append(rest.hexdigest())
            runs.append(np.stack([a, z], axis=1).astype(np.int64).tobytes())
        yield pa.record_batch(
            [batch.column(1), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array([len(r) // 16 for r in runs], pa.int64()), pa.array(digest, pa.string()), pa.array(runs, pa.binary())],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"],
        )


def _numbered(docs: DataFrame) -> DataFrame:
    """(doc, doc_id, text): doc numbers rows in order of doc_id.

    Unique ids serve as they are. Otherwise rows are ranked by (doc_id, row), nulls first.
    """
    rows = only(docs, "doc_id", "text")
    n, ids, distinct, lo, hi = rows.agg(F.count(F.lit(1)), F.count("doc_id"), F.countDistinct("doc_id"), F.min("doc_id"), F.max("doc_id")).first()
    if n == ids == distinct:
        return rows.select(F.col("doc_id").cast("long").alias("doc"), "doc_id", "text")
    rows = settle(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    many = max(1, n // 50_000)
    width = max(1, ((hi or 0) - (lo or 0)) // many + 1)
    bucket = F.coalesce(F.floor((F.col("doc_id") - F.lit(lo or 0)) / width).cast("int"), F.lit(-1))
    order = ranked(rows.select("doc_id", "row"), ["doc_id", "row"], [], bucket, "doc").select("row", "doc")
    return settle(rows.join(order, "row").select("doc", "doc_id", "text"), "numbered")


def _wanted(firsts: DataFrame) -> DataFrame:
    return firsts.groupBy("doc").agg(F.collect_list(F.struct("anchor", "span")).alias("want"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per document: what is left without bytes of strings that also start earlier.

    A byte goes if a LENGTH-byte string that covers it also starts earlier: in a
    document with a smaller doc_id, or earlier in the same document; overlaps
    count, strings are judged on the input. Texts are UTF-8 bytes; null is empty;
    texts shorter than LENGTH stay. Null doc_ids come before all others, rows that
    repeat a doc_id in input order. Empty table: empty result; other columns are
    ignored. A text of any length is whole: it is cut in blocks that overlap.

    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (binary: int64
    pairs [from, to) of removed bytes).
    """
    docs = _numbered(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()
    parts = docs.select("doc", "text").mapInArrow(_segments, "again boolean, anchor long, mark long, doc long, span long")
    parts = parts.repartition(F.when(F.col("again"), F.xxhash64("doc", "span")).otherwise(F.col("anchor"))).sortWithinPartitions("again", "anchor", "mark", "doc", "span")
    sifted = settle(parts.mapInArrow(_sift, "anchor long, doc long, span long"), "sifted")
    firsts = sifted.filter("anchor is not null and doc is not null")
    found = [sifted.filter("anchor is null").select("doc", "span")]
    heavy = settle(sifted.filter("doc is null").select("anchor").distinct(), "heavy")
    fit: list[DataFrame] = []
    if many := heavy.count():
        heavy = F.broadcast(heavy) if many <= KNOWN else heavy
        apart = settle(_wanted(firsts.join(heavy, "anchor", "left_semi")), "apart")
        # their texts are fetched by a scan of the documents where the wanted places are few, else by a shuffle
        apart = F.broadcast(apart) if apart.agg(F.sum(F.size("want"))).first()[0] <= KNOWN else apart
        fetched = docs.join(apart, "doc").select("doc", "doc_id", "text", "want").mapInArrow(_cut, PIECE)
        fit, more = split_heavy(settle(fetched, "pieces"), LEVELS, INDEX_BYTES)
        found += more
        firsts = firsts.join(heavy, "anchor", "left_anti")
    # both joins deal the same three columns of every document by doc, so Spark shuffles the texts once and reads them twice
    texts = docs.select("doc", "doc_id", "text")
    pieces = texts.join(_wanted(firsts), "doc", "left").select("doc", "doc_id", "text", "want").mapInArrow(_cut, PIECE)
    pieces = reduce(DataFrame.union, [pieces, *fit])
    pieces = pieces.repartition("anchor").sortWithinPartitions("anchor", "doc", "span")
    marks = reduce(DataFrame.union, [pieces.mapInArrow(_index, "doc long, span long"), *found])
    spans = marks.groupBy("doc").agg(F.collect_list("span").alias("marks"))
    return texts.join(spans, "doc", "left").select("doc", "doc_id", "text", "marks").mapInArrow(
        _remove, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans binary"
    )
