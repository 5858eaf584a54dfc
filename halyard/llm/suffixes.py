"""Suffix-array deduplication: bytes covered by a string of 100 bytes that also starts earlier.

Which windows can repeat.  Of the 69 grams of 32 bytes in each 100-byte window the one of least hash is its
anchor, so equal windows have equal anchors.  Windows whose anchor's hash occurs once can't repeat, and are left out:
hashes only leave out and route.

Shards.  The windows that are left, in blocks of the text, are put together by the megabyte.  A suffix array of a shard's
text (Larsson-Sadakane refinement: ranks by eight bytes, then doubled, only groups that aren't sorted yet) and Kasai's common
prefixes tell which windows are equal: neighbours that agree in 100 bytes or more.  All but the earliest are repeats.

Merging.  What is first in a shard goes on as lists in the order of its suffix array, a list for each stretch with one
anchor.  Lists of one anchor are merged in pairs by binary search, byte by byte; where windows meet, the later one is a repeat.
Heavy anchors (a bounded number, known to all) are first merged in parts, and then window by window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import buffers, discard, materialize, mix, partitions, releasing, slices, table, take_ranges, text_or_empty

SPAN = 100
GRAM = 32
BEFORE = SPAN - GRAM
#: Windows of a list, at most: a column is one byte.
LIST = 200
#: Windows of a block, at most, and text of a shard.
BLOCK, SHARD_BYTES = 1024, 1 << 19
#: Windows of a document that are looked at together.
CHUNK = 1 << 18
#: Occurrences of an anchor beyond which it is heavy, and how many anchors can be (the commonest ones; that bounds the broadcast).
HOT, HEAVY_MOST = 1 << 17, 1 << 16
HEAVY = np.dtype([("anchor", "<u8"), ("count", ">u8")])
#: Lists that are merged together; of an anchor with more, the windows of one class by a hash at a time.
MERGE_LISTS = 2048
#: Stands for a null doc_id: after all others.
LAST = (1 << 63) - 1
#: No byte of UTF-8.
STOP = 0xFF
NOTHING = np.uint64((1 << 64) - 1)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * _A)
_KEY = "k long, h long"


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes, never 0, of the 32 bytes from each position on (by doubling)."""
    x, width = _BYTES[data], 1
    while width < GRAM:
        y = x[:-width] * _A
        y += x[width:]
        y ^= y >> np.uint64(29)
        y *= _B
        x, width = y, 2 * width
    x ^= x >> np.uint64(32)
    return x | np.uint64(1)


def sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over each ``width`` neighbours, from the left one on."""
    done, out = 1, x
    while done * 2 <= width:
        out, done = pick(out[:-done], out[done:]), done * 2
    rest = width - done
    return pick(out[: len(out) - rest], out[rest:]) if rest else out


def anchors(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the anchors of all windows that lie within a text, and the hashes of all grams."""
    n = len(data)
    if n < SPAN:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = gram_hashes(data)
    least = sliding(h, BEFORE + 1, np.minimum)
    crossing = np.zeros(n + 1, np.int32)
    np.add.at(crossing, np.maximum(at[:-1], at[1:] - SPAN + 1), 1)
    np.add.at(crossing, at[1:], -1)
    least[np.cumsum(crossing)[: len(least)] > 0] = 0
    padded = np.zeros(len(h) + BEFORE, np.uint64)
    padded[BEFORE : BEFORE + len(least)] = least
    found = np.flatnonzero(sliding(padded, BEFORE + 1, np.maximum) == h)
    return found, h


def record_batch(rows: list[tuple], fields: str) -> pa.RecordBatch:
    """Rows as a batch; ``fields`` as in a DDL schema of long, int and binary columns."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    names, types = zip(*(f.split() for f in fields.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=list(names))


DEALT = "to int, reply int, a binary, b binary, c binary, d binary, e binary, f binary"
NEEDED = np.dtype([("hash", "<u8"), ("place", "<u4")])
REPLY = "to int, k binary, h binary, sizes binary, needed binary, copied binary, heavy binary"


def groups_of_documents(k: np.ndarray, h: np.ndarray, groups: int) -> np.ndarray:
    return (mix(k.astype(np.int64).view(np.uint64) ^ mix(h.astype(np.int64).view(np.uint64))) % np.uint64(groups)).astype(np.int64)


def replies(k: np.ndarray, h: np.ndarray, records: np.ndarray, groups: int) -> list[tuple]:
    """Records of documents, packed by group of documents: rows of REPLY."""
    to = groups_of_documents(k, h, groups)
    order = np.lexsort((records["place"], h, k, to))
    k, h, to, records = k[order], h[order], to[order], records[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(new)
    sizes = np.diff([*at, len(k)])
    cuts = np.searchsorted(to[at], np.arange(groups + 1))
    ends = np.concatenate([[0], np.cumsum(sizes)])
    raw = records.tobytes()
    out = []
    for g in np.flatnonzero(np.diff(cuts)).tolist():
        some = slice(cuts[g], cuts[g + 1])
        out.append((g, k[at[some]].tobytes(), h[at[some]].tobytes(), sizes[some].astype("<u4").tobytes(), raw[NEEDED.itemsize * ends[cuts[g]] : NEEDED.itemsize * ends[cuts[g + 1]]], bytes(int(cuts[g + 1] - cuts[g])), b""))
    return out


def copy_replies(k: np.ndarray, h: np.ndarray, groups: int) -> list[tuple]:
    """That documents equal earlier ones, by group of documents: rows of REPLY."""
    to = groups_of_documents(k, h, groups)
    return [(g, k[to == g].tobytes(), h[to == g].tobytes(), bytes(4 * n), b"", b"\1" * n, b"") for g in np.unique(to).tolist() for n in [int((to == g).sum())]]


def deal(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Anchors of each slice packed by bucket, with document and place.

    Of an anchor that repeats within the slice only its hash and count are sent there: its places are known to be needed,
    and go to their documents.  So do texts that equal an earlier one of the slice (compared byte by byte).
    """
    for rows in slices(batches, "text", 1 << 20):
        ks, hs = rows.column("k").to_numpy(), rows.column("h").to_numpy()
        data, at = buffers(rows.column("text"))
        lengths = np.diff(at)
        first_of: dict[tuple, int] = {}
        copies, alive = [], lengths >= SPAN
        order = np.lexsort((hs, ks))
        for d in order[alive[order]].tolist():
            first = first_of.setdefault((int(hs[d]), int(lengths[d])), d)
            if first != d and np.array_equal(data[at[d] : at[d + 1]], data[at[first] : at[first + 1]]):
                alive[d] = False
                if ks[d] != ks[first]:
                    copies.append(d)
        found, h = anchors(data, at)
        who = np.searchsorted(at, found, "right") - 1
        found, who = found[alive[who]], who[alive[who]]
        hashes = h[found]
        by = np.argsort(hashes, kind="stable")
        hashes, found, who = hashes[by], found[by], who[by]
        fresh = np.ones(len(by), bool)
        fresh[1:] = hashes[1:] != hashes[:-1]
        first = np.flatnonzero(fresh)
        counts = np.diff([*first, len(by)])
        again = np.repeat(counts > 1, counts)
        place = (found - at[who]).astype("<u4")
        keys = np.stack([ks, hs], 1).astype("<i8")
        out = [(r[0], 1, *r[1:]) for r in copy_replies(ks[copies], hs[copies], buckets)] if copies else []
        if again.any():
            record = np.empty(int(again.sum()), NEEDED)
            record["hash"], record["place"] = hashes[again], place[again]
            out += [(r[0], 1, *r[1:]) for r in replies(ks[who[again]], hs[who[again]], record, buckets)]
        kinds = hashes[first]
        bucket = (mix(kinds.copy()) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        for b in np.flatnonzero(np.diff(cuts)).tolist():
            some = order[cuts[b] : cuts[b + 1]]
            single = first[some[counts[some] == 1]]
            mine, local = np.unique(who[single], return_inverse=True)
            out.append((b, 0, kinds[some].tobytes(), counts[some].astype("<u4").tobytes(), local.astype("<u4").tobytes(), place[single].tobytes(), keys[mine].tobytes(), b""))
        if out:
            yield record_batch(out, DEALT)


def find_repeated(groups: int):
    """By group of documents: places of the anchors that occur more than once, and copies; and of each bucket its heavy anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for batch in batches:
            for to, reply, a, b, c, d, e, f in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if reply:
                    yield record_batch([(to, a, b, c, d, e, f)], REPLY)
                else:
                    parts.append((np.frombuffer(a, "<u8"), np.frombuffer(b, "<u4"), np.frombuffer(c, "<u4"), np.frombuffer(d, "<u4"), np.frombuffer(e, "<i8").reshape(-1, 2)))
        if not parts:
            return
        kinds, of = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        total = np.bincount(of, np.concatenate([p[1] for p in parts])).astype(np.int64)
        top = np.flatnonzero(total > HOT)
        if len(top):
            pairs = np.empty(len(top), HEAVY)
            pairs["anchor"], pairs["count"] = kinds[top], total[top]
            yield record_batch([(0, *[b""] * 5, pairs.tobytes())], REPLY)
        chosen = total[of] > 1
        begin, held, size = 0, [], 0
        for own, n, who, place, keys in parts:
            single = n == 1
            mine = chosen[begin : begin + len(own)][single]
            begin += len(own)
            if mine.any():
                record = np.empty(int(mine.sum()), NEEDED)
                record["hash"], record["place"] = own[single][mine], place[mine]
                held.append((keys[who[mine]], record))
                size += len(record)
            if size > 200_000:
                yield record_batch(replies(*_keys_and_records(held), groups), REPLY)
                held, size = [], 0
        if held:
            yield record_batch(replies(*_keys_and_records(held), groups), REPLY)

    return releasing(run)


def _keys_and_records(held: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys = np.concatenate([x[0] for x in held])
    return keys[:, 0], keys[:, 1], np.concatenate([x[1] for x in held])


@releasing
def open_replies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a document with all that the replies tell about it."""
    k, h, sizes, records, copied = [], [], [], [], []
    for batch in batches:
        for a, b, n, r, c in zip(*(batch.column(x).to_pylist() for x in ("k", "h", "sizes", "needed", "copied")), strict=True):
            k.append(np.frombuffer(a, "<i8"))
            h.append(np.frombuffer(b, "<i8"))
            sizes.append(np.frombuffer(n, "<u4"))
            records.append(np.frombuffer(r, NEEDED))
            copied.append(np.frombuffer(c, np.uint8))
    if not k:
        return
    k, h, sizes, records, copied = (np.concatenate(x) for x in (k, h, sizes, records, copied))
    starts = np.cumsum(sizes, dtype=np.int64) - sizes
    order = np.lexsort((h, k))
    new = np.ones(len(order), bool)
    new[1:] = (k[order][1:] != k[order][:-1]) | (h[order][1:] != h[order][:-1])
    at = np.concatenate([np.flatnonzero(new), [len(order)]])
    for i in range(0, len(at) - 1, 2000):
        bounds = at[i : i + 2001]
        some = order[bounds[0] : bounds[-1]]
        local = bounds - bounds[0]
        ends = np.concatenate([[0], np.cumsum(sizes[some], dtype=np.int64)])[local] * NEEDED.itemsize
        raw = records[take_ranges(starts[some], sizes[some].astype(np.int64))].tobytes()
        needed = pa.Array.from_buffers(pa.large_binary(), len(local) - 1, [None, pa.py_buffer(ends), pa.py_buffer(raw)]).cast(pa.binary())
        lead = some[local[:-1]]
        yield pa.RecordBatch.from_arrays([pa.array(k[lead]), pa.array(h[lead]), needed, pa.array(np.maximum.reduceat(copied[some], local[:-1]) > 0)], names=["_k", "_h", "needed", "copied"])


@releasing
def press(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts packed for the way through the shuffle."""
    packer = zstandard.ZstdCompressor(level=1)
    for rows in slices(batches, "text"):
        at = rows.schema.get_field_index("text")
        packed = pa.array([packer.compress((t or "").encode()) for t in rows.column(at).to_pylist()], pa.binary())
        yield rows.set_column(at, "packed", packed)


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Rows, some megabytes at a time, with their texts."""
    packer = zstandard.ZstdDecompressor()
    for rows in slices(batches, "packed", 1 << 19):
        yield rows, [packer.decompress(z) if z else b"" for z in rows.column("packed").to_pylist()]


def blocks_of(rows: pa.RecordBatch, texts: list[bytes]) -> Iterator[tuple]:
    """Windows with a needed anchor, in blocks: (k, h, position of the first window, windows, text, anchors), a chunk at a time."""
    ks, hs = rows.column("k").to_numpy(), rows.column("h").to_numpy()
    held, size = [], 0
    for d, (text, raw) in enumerate(zip(texts, rows.column("needed").to_pylist(), strict=True)):
        record = np.frombuffer(raw, NEEDED) if raw else np.zeros(0, NEEDED)
        if not len(record):
            continue
        record = record[np.argsort(record["place"], kind="stable")]
        for begin in range(0, len(text) - SPAN + 1, CHUNK):
            low, high = np.searchsorted(record["place"], [begin, begin + CHUNK + BEFORE])
            if low < high:
                held.append((d, begin, text[begin : begin + CHUNK + SPAN - 1], record[low:high]))
                size += len(held[-1][2])
        if size >= CHUNK:
            yield cut_blocks(held, ks, hs)
            held, size = [], 0
    if held:
        yield cut_blocks(held, ks, hs)


def cut_blocks(units: list[tuple], ks: np.ndarray, hs: np.ndarray) -> tuple:
    data = np.frombuffer(b"".join(u[2] for u in units), np.uint8)
    lengths = np.array([len(u[2]) for u in units])
    at = np.concatenate([[0], np.cumsum(lengths)])
    per = [len(u[3]) for u in units]
    record = np.concatenate([u[3] for u in units])
    doc, base = np.array([u[0] for u in units]), np.array([u[1] for u in units])
    h = np.full(len(data) + BEFORE, NOTHING)
    place = record["place"].astype(np.int64) - np.repeat(base, per) + np.repeat(at[:-1], per)
    inside = place < np.repeat(at[1:], per)
    h[place[inside]] = record["hash"][inside]
    least = sliding(h, BEFORE + 1, np.minimum)
    window = least != NOTHING
    for e in at[1:].tolist():
        window[max(0, e - SPAN + 1) : e] = False
    starts = np.flatnonzero(window)
    unit = np.searchsorted(at, starts, "right") - 1
    new = np.ones(len(starts), bool)
    new[1:] = (starts[1:] != starts[:-1] + 1) | (unit[1:] != unit[:-1])
    run = np.flatnonzero(new)
    new[(np.arange(len(starts)) - run[np.cumsum(new) - 1]) % BLOCK == 0] = True
    first = np.flatnonzero(new)
    counts = np.diff([*first, len(starts)])
    s, u = starts[first], unit[first]
    return ks[doc[u]], hs[doc[u]], base[u] + s - at[u], counts, data[take_ranges(s, counts + SPAN - 1)], least[starts]


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes of an array of bytes in order: by eight bytes, then by refinement of the groups that aren't sorted yet."""
    n = len(text)
    padded = np.zeros(n + 8, np.uint8)
    padded[:n] = text
    words = np.ndarray((n,), ">u8", padded, strides=(1,)).astype(np.uint64)
    order = np.argsort(words, kind="quicksort").astype(np.int32)
    ordered = words[order]
    begins = np.ones(n, bool)
    begins[1:] = ordered[1:] != ordered[:-1]
    return refined(order, begins, n)


def refined(order: np.ndarray, begins: np.ndarray, n: int) -> np.ndarray:
    """Sort the groups of suffixes that agree so far by the ranks of what follows, ever twice as far."""
    rank = np.empty(n + 9, np.int64)
    rank[n:] = -np.arange(1, 10)  # where a text has ended, the sooner the less
    rank[order] = np.flatnonzero(begins)[np.cumsum(begins) - 1]
    h = 8
    slots = np.flatnonzero(~(begins & np.concatenate([begins[1:], [True]])))
    while len(slots):
        some = order[slots].astype(np.int64)
        key = (rank[some] << 32) + rank[np.minimum(some + h, n + 8)] + 9
        inner = np.argsort(key, kind="quicksort")  # groups keep their slots; members are sorted within
        some, key = some[inner], key[inner]
        order[slots] = some
        fresh = np.ones(len(key), bool)
        fresh[1:] = key[1:] != key[:-1]
        rank[some] = slots[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
        alone = fresh.copy()
        alone[:-1] &= fresh[1:]
        slots = slots[~alone]
        h *= 2
    return order


def common_prefixes(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Kasai's common prefixes, by position, of suffixes with the preceding ones in order.

    A prefix is never more than one shorter than that of the position before, and exactly one shorter where the bytes before
    both suffixes agree; so only the other positions are compared, all of them together and eight bytes at a time.
    """
    n = len(text)
    padded = np.zeros(n + 16, np.uint8)
    padded[:n] = text
    words = np.ndarray((n + 9,), "<u8", padded, strides=(1,))
    before = np.full(n, -1, np.int32)
    before[order[1:]] = order[:-1]
    p = np.arange(1, n)
    q = before[1:]
    compared = np.ones(n, bool)
    compared[1:] = (q <= 0) | (before[:-1] < 0) | (text[p - 1] != text[np.maximum(q, 1) - 1])
    at = np.flatnonzero(compared)
    held = np.zeros(len(at), np.int32)
    going = np.flatnonzero(before[at] >= 0)
    a, b = at[going], before[at[going]].astype(np.int64)
    while len(going):
        x = words[a] ^ words[b]
        same = np.flatnonzero(x == 0)
        ended = np.flatnonzero(x)
        low = x[ended] & (~x[ended] + np.uint64(1))
        held[going[ended]] += (np.log2(low.astype(np.float64)) / 8).astype(np.int32)
        going = going[same]
        held[going] += 8
        a, b = a[same] + 8, b[same] + 8
        inside = np.maximum(a, b) <= n
        going, a, b = going[inside], a[inside], b[inside]
    held = np.minimum(held, n - np.maximum(at, before[at]))
    out = np.repeat(held, np.diff([*at, n]))
    out -= (np.arange(n) - np.repeat(at, np.diff([*at, n]))).astype(np.int32)
    return out


SETTLED = "level int, to int, k long, h long, spans binary, ids binary, sizes binary, columns binary, texts binary"


def mark_rows(k: np.ndarray, h: np.ndarray, starts: np.ndarray, in_order: bool = False) -> Iterator[pa.RecordBatch]:
    """By document, the starts of its repeated windows as packed (first, last) u4 pairs of stretches."""
    if not len(k):
        return
    if not in_order:
        order = np.lexsort((starts, h, k))
        k, h, starts = k[order], h[order], starts[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (h[1:] != h[:-1])
    cut = new.copy()
    cut[1:] |= starts[1:] > starts[:-1] + 1
    at = np.flatnonzero(cut)
    raw = np.stack([starts[at], starts[np.append(at[1:], len(k)) - 1]], 1).astype("<u4").tobytes()
    docs = np.flatnonzero(new)
    bounds = np.searchsorted(at, np.append(docs, len(k))).tolist()
    to = (mix(h[docs].view(np.uint64) + np.uint64(1)) % np.uint64(1 << 20)).tolist()  # any even deal will do
    rows = [(0, t, a, b, raw[8 * x : 8 * y], *[None] * 4) for t, a, b, x, y in zip(to, k[docs].tolist(), h[docs].tolist(), bounds[:-1], bounds[1:], strict=True)]
    for i in range(0, len(rows), 10_000):
        yield record_batch(rows[i : i + 10_000], SETTLED)


LISTS = np.dtype([("anchor", "<u8"), ("k", "<i8"), ("h", "<i8"), ("place", "<u4")])


def list_rows(level: int, to: np.ndarray, ids: np.ndarray, sizes: np.ndarray, columns: np.ndarray, text: np.ndarray, starts: np.ndarray, spread: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Lists packed by where they go: sizes windows each, ``columns`` in order, text of ``spread`` bytes from starts on."""
    if not len(to):
        return
    packer = zstandard.ZstdCompressor(level=1)
    order = np.argsort(to, kind="stable")
    to = to[order]
    column_at = np.cumsum(sizes, dtype=np.int64) - sizes
    out, size = [], 0
    begins = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
    for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(to)], strict=True):
        some = order[a:b]
        body = text[take_ranges(starts[some], spread[some])].tobytes()
        measures = np.stack([sizes[some], spread[some]]).astype("<u2").tobytes()
        out.append((level, int(to[a]), None, None, None, ids[some].tobytes(), measures, columns[take_ranges(column_at[some], sizes[some])].tobytes(), packer.compress(body)))
        size += len(body)
        if size > 4 << 20:
            yield record_batch(out, SETTLED)
            out, size = [], 0
    if out:
        yield record_batch(out, SETTLED)


def settle(heavy, buckets: int):
    """Shard after shard: repeats within it as marks, and lists of what is first there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = np.frombuffer(heavy.value, np.uint64)
        held, size = [], 0
        for rows, texts in unpacked(batches):
            copied = rows.column("copied").to_numpy(zero_copy_only=False)
            whole = np.flatnonzero(copied).tolist()
            if whole:
                ks, hs = rows.column("k").to_pylist(), rows.column("h").to_pylist()
                yield record_batch([(0, d, ks[d], hs[d], np.array([0, len(texts[d]) - SPAN], "<u4").tobytes(), *[None] * 4) for d in whole], SETTLED)
            for blocks in blocks_of(rows.filter(pa.array(~copied)), [t for t, c in zip(texts, copied, strict=True) if not c]):
                held.append(blocks)
                size += len(blocks[4])
                if size >= SHARD_BYTES:
                    yield from settle_shard(held, often, buckets)
                    held, size = [], 0
        if held:
            yield from settle_shard(held, often, buckets)

    return releasing(run)


def settle_shard(parts: list[tuple], often: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    k, h, place, counts, body, anchor = (np.concatenate(x) for x in zip(*parts, strict=True))
    if not len(k):
        return
    order = np.lexsort((place, h, k))  # so that the earliest of equal windows lies first
    twice = np.zeros(len(order), bool)
    for x in (k, h, place):
        twice[1:] |= x[order][1:] != x[order][:-1]
    twice[0] = True
    order = order[twice]  # a row that comes again is the same document
    text_at, anchor_at = np.cumsum(counts + SPAN - 1) - (counts + SPAN - 1), np.cumsum(counts) - counts
    anchor = anchor[take_ranges(anchor_at[order], counts[order])]
    k, h, place, text_at, counts = k[order], h[order], place[order], text_at[order], counts[order]
    spread = counts + SPAN - 1
    starts = np.cumsum(spread + 4) - (spread + 4)
    text = np.full(int((spread + 4).sum()), STOP, np.uint8)
    text[take_ranges(starts, spread)] = body[take_ranges(text_at, spread)]
    for byte in range(3):  # an end of its own for every block
        text[starts + spread + 1 + byte] = np.arange(len(starts)) >> (16 - 8 * byte) & 0xFF
    array = suffix_array(text)
    prefix = common_prefixes(text, array)
    number = np.full(len(text), -1, np.int32)  # of windows, in order of document and place
    windows = take_ranges(starts, counts)
    number[windows] = np.arange(len(windows))
    kind = np.cumsum(prefix[array] < SPAN)  # over all suffixes: one that begins at an end's number may lie first among equal windows
    array, kind = array[number[array] >= 0], kind[number[array] >= 0]
    head = np.ones(len(array), bool)
    head[1:] = kind[1:] != kind[:-1]
    mine = number[array]
    lead = np.minimum.reduceat(mine, np.flatnonzero(head))[np.cumsum(head) - 1]
    block = np.repeat(np.arange(len(counts)), counts)
    window_place = place[block] + np.arange(len(windows)) - np.repeat(np.cumsum(counts) - counts, counts)
    late = np.sort(mine[mine != lead])
    yield from mark_rows(k[block[late]], h[block[late]], window_place[late], True)
    first = np.zeros(len(windows), bool)
    first[lead] = True
    keep = np.flatnonzero(first)
    new = np.ones(len(keep), bool)
    new[1:] = (keep[1:] != keep[:-1] + 1) | (block[keep][1:] != block[keep][:-1]) | (anchor[keep][1:] != anchor[keep][:-1])
    run = np.flatnonzero(new)
    new[(np.arange(len(keep)) - run[np.cumsum(new) - 1]) % LIST == 0] = True
    begin = np.flatnonzero(new)
    of = np.full(len(windows), -1, np.int64)
    of[keep] = np.cumsum(new) - 1
    ranked = mine[first[mine]]  # the windows that are first, in order of the suffix array
    ranked = ranked[np.argsort(of[ranked], kind="stable")]
    columns = (ranked - keep[begin][of[ranked]]).astype(np.uint8)
    sizes = np.diff([*begin, len(keep)])
    lead = keep[begin]
    ids = np.empty(len(begin), LISTS)
    ids["anchor"], ids["k"], ids["h"], ids["place"] = anchor[lead], k[block[lead]], h[block[lead]], window_place[lead]
    hot = np.isin(ids["anchor"], often) if len(often) else np.zeros(len(ids), bool)
    salt = mix(ids["h"].astype(np.int64).view(np.uint64) + np.uint64(1)) * hot
    to = (mix(ids["anchor"] ^ salt) % np.uint64(buckets)).astype(np.int64)
    at = np.cumsum(sizes) - sizes
    for level, some in ((1, np.flatnonzero(hot)), (2, np.flatnonzero(~hot))):
        yield from list_rows(level, to[some], ids[some], sizes[some], columns[take_ranges(at[some], sizes[some])], text, windows[lead[some]], sizes[some] + SPAN - 1)


def merge_lists(buckets: int):
    """Merge the lists that meet in a bucket, anchor by anchor; of heavy anchors (level 1), what is left goes on window by window.

    Marks pass through.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdDecompressor()
        parts: dict[int, list] = {1: [], 2: []}
        for batch in batches:
            levels = batch.column("level").to_numpy()
            if (levels == 0).any():
                yield batch.filter(pa.array(levels == 0))
            for level, raw, measures, columns, packed in zip(*(batch.filter(pa.array(levels > 0)).column(c).to_pylist() for c in ("level", "ids", "sizes", "columns", "texts")), strict=True):
                m = np.frombuffer(measures, "<u2").reshape(2, -1)
                parts[level].append((np.frombuffer(raw, LISTS), m[0].astype(np.int64), m[1].astype(np.int64), np.frombuffer(columns, np.uint8), np.frombuffer(packer.decompress(packed), np.uint8)))
        for level in (1, 2):
            if parts[level]:
                whole = tuple(np.concatenate(x) for x in zip(*parts.pop(level), strict=True))
                yield from merge_level(level, *whole, buckets)

    return releasing(run)


def merge_level(level: int, ids: np.ndarray, sizes: np.ndarray, spread: np.ndarray, columns: np.ndarray, text: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    text_at, column_at = np.cumsum(spread) - spread, np.cumsum(sizes) - sizes
    order = np.lexsort((ids["place"], ids["h"], ids["k"], ids["anchor"]))
    anchor = ids["anchor"][order]
    begins = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    per = np.diff([*begins, len(order)])
    if level == 1:
        yield from windows_on(ids, sizes, columns, text, text_at, column_at, order[begins[per == 1]], None, buckets)
    begins, per = begins[per > 1], per[per > 1]  # an anchor with one list has nothing to meet
    chunk = (np.cumsum(per) - per) // MERGE_LISTS
    body, tails = text.tobytes(), columns.tobytes()
    for c in np.unique(chunk).tolist():
        some = np.flatnonzero(chunk == c)
        lists = order[take_ranges(begins[some], per[some])]
        group = np.repeat(np.arange(len(some)), per[some])
        # lists that are alike in every byte meet at once: the later ones are late
        first_of: dict[tuple, int] = {}
        lead = [first_of.setdefault((g, body[a : a + m], tails[b : b + n]), i) for i, (g, a, m, b, n) in enumerate(zip(group.tolist(), text_at[lists].tolist(), spread[lists].tolist(), column_at[lists].tolist(), sizes[lists].tolist(), strict=True))]
        lead = np.array(lead)
        own = np.flatnonzero(lead == np.arange(len(lists)))
        again = np.flatnonzero(lead != np.arange(len(lists)))
        mine, first = ids[lists[again]], ids[lists[lead[again]]]
        again = lists[again[(mine["k"] != first["k"]) | (mine["h"] != first["h"]) | (mine["place"] != first["place"])]]
        if len(again):
            who = np.repeat(again, sizes[again])
            yield from mark_rows(ids["k"][who], ids["h"][who], ids["place"][who].astype(np.int64) + columns[take_ranges(column_at[again], sizes[again])])
        lists, group = lists[own], group[own]
        begin = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        count = np.diff([*begin, len(group)])
        if level == 2:  # what has met all others
            more = np.repeat(count > 1, count)
            lists, group, count = lists[more], group[more], count[count > 1]
        turn = take_ranges(np.zeros(len(count), np.int64), count)
        if not len(lists):
            continue
        n = sizes[lists]
        owner = np.repeat(np.arange(len(lists)), n)
        column = columns[take_ranges(column_at[lists], n)].astype(np.int64)
        at = text_at[lists][owner] + column
        passes = -(-len(lists) // (2 * MERGE_LISTS))
        kind = class_of(text, at) % np.uint64(passes) if passes > 1 else None
        for own_class in range(passes):
            here = slice(None) if kind is None else np.flatnonzero(kind == own_class)
            own = owner[here]
            matrix = np.empty((len(own), 8 + SPAN), np.uint8)
            matrix[:, 8:] = np.lib.stride_tricks.sliding_window_view(text, SPAN)[at[here]]
            matrix[:, :4] = group[own].astype(">u4").view(np.uint8).reshape(-1, 4)
            left, late = merge_pairs(matrix, turn[own], np.stack([own, ids["place"][lists][own].astype(np.int64) + column[here]], 1), ids, lists)
            who = lists[late[:, 0]]
            yield from mark_rows(ids["k"][who], ids["h"][who], late[:, 1])
            if level == 1:
                yield from windows_on(ids, sizes, columns, text, text_at, column_at, lists, left, buckets)


def class_of(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of windows by four pieces of their text."""
    words = np.ndarray((len(text) - 7,), "<u8", text, strides=(1,))
    h = np.zeros(len(at), np.uint64)
    for shift in (0, 30, 62, SPAN - 8):
        h = mix(h * _A + words[at + shift])
    return h


def merge_pairs(matrix: np.ndarray, turn: np.ndarray, own: np.ndarray, ids: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge sorted lists in pairs, by binary search, until one is left of each group: (what is left, what is late), as (list, place).

    Rows begin with group and turn; within a group lists come in order of document, so of equal windows of two lists the
    one of smaller turn is the earlier, unless both are the same place of one document.
    """
    late = []
    matrix = matrix.view(f"V{matrix.shape[1]}").ravel()
    while turn.max(initial=0) > 0:
        odd = turn & 1 == 1
        turn = turn >> 1
        head = np.ndarray((len(matrix),), [("group", ">u4"), ("turn", ">u4"), ("window", f"V{SPAN}")], matrix)
        head["turn"] = turn
        keys = matrix.view(f"S{matrix.itemsize}")
        one, two = keys[~odd], keys[odd]
        at = np.searchsorted(one, two)
        met = np.zeros(len(two), bool)
        inside = at < len(one)
        met[inside] = one[at[inside]] == two[inside]
        there, here = own[~odd][at[met]], own[odd][met]
        a, b = lists[there[:, 0]], lists[here[:, 0]]
        same = (ids["k"][a] == ids["k"][b]) & (ids["h"][a] == ids["h"][b]) & (there[:, 1] == here[:, 1])
        sooner = ~same & (here[:, 1] < there[:, 1]) & (ids["k"][a] == ids["k"][b]) & (ids["h"][a] == ids["h"][b])
        late.append(np.where(sooner[:, None], there, here)[~same])
        kept = own[~odd]
        kept[at[met]] = np.where(sooner[:, None], here, there)
        rest = np.flatnonzero(odd)[~met]
        to = at[~met] + np.arange(len(rest))  # where the new ones come to lie
        old = np.ones(len(one) + len(rest), bool)
        old[to] = False
        merged, turns, owns = np.empty(len(old), matrix.dtype), np.empty(len(old), turn.dtype), np.empty((len(old), 2), np.int64)
        merged.view(keys.dtype)[old], turns[old], owns[old] = one, turn[~odd], kept
        merged.view(keys.dtype)[to], turns[to], owns[to] = two[~met], turn[rest], own[rest]
        matrix, turn, own = merged, turns, owns
    return own, np.concatenate(late) if late else np.zeros((0, 2), np.int64)


def windows_on(ids, sizes, columns, text, text_at, column_at, lists, left, buckets: int) -> Iterator[pa.RecordBatch]:
    """Windows of heavy anchors as lists of their own, routed by a hash of all their bytes."""
    if not len(lists):
        return
    if left is None:
        owner = np.repeat(np.arange(len(lists)), sizes[lists])
        place = ids["place"][lists][owner].astype(np.int64) + columns[take_ranges(column_at[lists], sizes[lists])]
    else:
        owner, place = left[:, 0], left[:, 1]
    starts = text_at[lists][owner] + place - ids["place"][lists][owner]
    own = ids[lists[owner]].copy()
    own["place"] = place
    rows = np.lib.stride_tricks.sliding_window_view(text, SPAN)
    h = np.zeros(len(starts), np.uint64)
    for c in range(0, SPAN, 4):
        h = mix(h * _A + np.ascontiguousarray(rows[starts, c : c + 4]).view("<u4").ravel())
    own["anchor"] = h
    n = len(starts)
    yield from list_rows(2, (mix(h.copy()) % np.uint64(buckets)).astype(np.int64), own, np.ones(n, np.int64), np.zeros(n, np.uint8), text, starts, np.full(n, SPAN))


def covered(n: int, spans: list[bytes]) -> np.ndarray:
    """Which of n bytes lie in a window that starts within one of the stretches."""
    pairs = np.frombuffer(b"".join(spans), "<u4").reshape(-1, 2).astype(np.int64)
    change = np.zeros(n + 1, np.int32)
    np.add.at(change, pairs[:, 0], 1)
    np.add.at(change, pairs[:, 1] + SPAN, -1)
    return np.cumsum(change[:-1]) > 0


def finish(keep: list[str], with_text: bool):
    """The result's columns; with text, what is left of it, in whole characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in unpacked(batches):
            out = []
            for text, spans in zip(texts, rows.column("spans").to_pylist(), strict=True):
                n_removed = n_spans = 0
                left = text
                if spans:
                    gone = covered(len(text), spans)
                    left = np.frombuffer(text, np.uint8)[~gone].tobytes()
                    n_removed, n_spans = int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[0])
                out.append((len(text), n_removed, n_spans, left.decode("utf-8", "ignore") if with_text else hashlib.sha256(left).hexdigest()))
            columns = [rows.column(c) for c in keep]
            columns += [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "n_bytes", "n_removed", "n_spans", "kept"])

    return releasing(run)


def deduplicate(docs: DataFrame, keep: list[str], with_text: bool) -> DataFrame:
    """The ``keep`` columns, n_bytes, n_removed, n_spans and ``kept`` of every row: the digest of what is left, or its text.

    Null text is empty, and has nothing to remove; neither has a text under 100 bytes.  A null doc_id comes after
    all others.  Rows with the same doc_id are ordered by a hash of their text; rows that also share the text are
    taken for one document, and fare alike.
    """
    spark = docs.sparkSession
    buckets = partitions(spark)
    kinds = dict(docs.dtypes)
    named = [f"_{i}" for i in range(len(keep))]  # so that no name clashes
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("k"), F.xxhash64(text_or_empty()).alias("h"), text_or_empty().alias("text"), *[F.col(f"`{c}`").alias(n) for c, n in zip(keep, named, strict=True)])
    dealt = base.select("k", "h", "text").mapInArrow(releasing(lambda it: deal(it, buckets)), DEALT)
    answers = materialize(dealt.repartition(buckets, "to").mapInArrow(find_repeated(buckets), REPLY), "anchors")
    top = answers.where(F.octet_length("heavy") > 0).select(F.explode(F.expr("transform(sequence(1, octet_length(heavy), 16), i -> substring(heavy, i, 16))")).alias("x"))
    top = top.orderBy(F.substring("x", 9, 8).desc(), "x").limit(HEAVY_MOST).collect()
    often = np.sort(np.frombuffer(b"".join(bytes(r["x"]) for r in top), HEAVY)["anchor"].astype(np.uint64))
    heavy = spark.sparkContext.broadcast(often.tobytes())

    by_doc = answers.where(F.octet_length("k") > 0).repartition(buckets, "to").mapInArrow(open_replies, "_k long, _h long, needed binary, copied boolean")
    key = (F.col("k") == F.col("_k")) & (F.col("h") == F.col("_h"))
    texts = base.where(F.octet_length("text") >= SPAN).select("k", "h", "text").mapInArrow(press, f"{_KEY}, packed binary")
    settled = texts.join(by_doc, key).drop("_k", "_h").mapInArrow(settle(heavy, buckets), SETTLED)
    merged = materialize(settled.repartition(buckets, "to").mapInArrow(merge_lists(buckets), SETTLED), "marks")
    last = merged.where("level = 2").repartition(buckets, "to").mapInArrow(merge_lists(buckets), SETTLED)
    marks = merged.where("level = 0").unionByName(last).groupBy("k", "h").agg(F.collect_list("spans").alias("spans"))
    marks = materialize(marks.withColumnsRenamed({"k": "_k", "h": "_h"}), "document-marks")
    discard(answers, merged)

    fields = "".join(f"{n} {kinds[c]}, " for c, n in zip(keep, named, strict=True))
    packed = base.mapInArrow(press, f"{_KEY}, packed binary" + "".join(f", {n} {kinds[c]}" for c, n in zip(keep, named, strict=True)))
    marked = packed.join(marks, key, "left").select(*named, "packed", "spans")
    out = marked.mapInArrow(finish(named, with_text), f"{fields}n_bytes long, n_removed long, n_spans long, kept string")
    return out.withColumnsRenamed(dict(zip(named, keep, strict=True)))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the bytes of repeated 100-byte strings."""
    out = deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"], False)
    return out.withColumnRenamed("kept", "kept_sha256")
