"""Removal of repeated byte strings by a hash-compared suffix sort.

A byte goes if a ``LENGTH``-byte string that covers it also starts earlier:
in a document with a smaller id, or earlier in the same one.  Documents stay
whole in every step but are never compared in pairs:

1. Anchors.  Every ``LENGTH``-byte string contains ``LENGTH - GRAM + 1`` strings
   of ``GRAM`` bytes; the one with the smallest hash is its anchor.  Equal
   strings have equal anchors at the same place, so strings can only be equal
   where an anchor occurs twice, and an anchor stands for about twenty string
   starts.  Hashes are polynomial, taken from prefix sums, one subtraction and
   one multiplication each.
2. Repeated anchors.  Each task packs the anchor hashes of a block of documents
   by hash range; a range finds those that occur more than once and answers
   each block with flags.
3. Records.  A block sends, for each flagged anchor, the bytes of the strings
   that have it.  Equal records of a block are sent once, with their first
   place.  An anchor with more than ``HOT`` occurrences (a passage that many
   documents share) is sent as two records, by the bytes to its right and to
   its left, so that different surroundings spread over the ranges.
4. Suffix sort.  The strings of different records with one anchor are sorted as
   suffixes of the records' concatenated bytes: a mergesort whose comparison
   finds the common extension by binary search over prefix hashes, in
   ``log2(LENGTH)`` steps.  Strings that the hashes call equal are compared byte
   by byte.  The earliest of equal strings stays, the answer says which others
   go.
5. Each block marks the bytes of the strings that go.

Documents are dealt into blocks once, and the blocks are written with their
numbers; steps 1, 3 and 5 read that table, so a task that is repeated, or a job
that deals out its input otherwise, finds the same blocks.  Tables move between
steps as packed rows per block and range.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tern.llm.common import materialize_in_batches, need, row_key, rows_of, text_of
from tern.session import materialize

LENGTH, GRAM = 100, 64
REACH = LENGTH - GRAM  # an anchor starts 0 to REACH bytes after its string
HOT = 4096
BLOCK = 1 << 21  # bytes of text in a block
PIECE = 1 << 19  # bytes that are hashed at a time
SORT = 1 << 20  # strings that are sorted at a time
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
NO_ID = np.iinfo(np.int64).max


# ------------------------------------------------------------- prefix hashing


def _powers(n: int, base: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        np.multiply.accumulate(np.full(n - 1, base, np.uint64), out=out[1:])
    return out


class Hashes:
    """Polynomial hashes (modulo 2**64) of all strings of a byte array."""

    letters = np.random.default_rng(1).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    up = _powers(1, BASE)
    down = _powers(1, pow(BASE, -1, 1 << 64))

    def __init__(self, data: np.ndarray):
        n = len(data)
        if len(Hashes.up) <= n:
            size = max(n + 1, PIECE + 2 * LENGTH)
            Hashes.up, Hashes.down = _powers(size, BASE), _powers(size, pow(BASE, -1, 1 << 64))
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(self.letters[data] * self.up[:n], out=self.prefix[1:])

    def of(self, start: np.ndarray, length) -> np.ndarray:
        return (self.prefix[start + length] - self.prefix[start]) * self.down[start]

    def all(self, length: int) -> np.ndarray:
        """Of every string of this length."""
        n = len(self.prefix) - length
        return (self.prefix[length:] - self.prefix[:n]) * self.down[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


# --------------------------------------------------------------------- anchors


def anchors(texts: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
    """For runs of documents: number of the document, place of the anchor,
    first and last start of the strings that have it, hash of the anchor."""
    at = 0
    while at < len(texts):
        size, to = len(texts[at]), at + 1
        while to < len(texts) and size + len(texts[to]) <= PIECE:
            size, to = size + len(texts[to]), to + 1
        data = np.frombuffer(b"".join(texts[at:to]), np.uint8)
        ends = np.cumsum([len(t) for t in texts[at:to]])
        for k in range(0, len(data), PIECE):  # more than one only for a single long text
            if len(part := data[k : k + PIECE + LENGTH - 1]) >= LENGTH:
                yield _anchors(part, k, at, ends)
        at = to


def _anchors(part: np.ndarray, k: int, first: int, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    grams = mixed(Hashes(part).all(GRAM))
    place = np.arange(len(grams), dtype=np.uint64)
    low = (grams & ~np.uint64((1 << 24) - 1)) | place  # the leftmost of equal hashes
    width = 1
    while 2 * width <= REACH + 1:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < REACH + 1:
        rest = REACH + 1 - width
        low = np.minimum(low[:-rest], low[rest:])
    # a new anchor, or a new document; not where a string would leave its document
    ends = ends - k
    begins = np.concatenate([[-k], ends[:-1]])
    stop = np.minimum(ends - LENGTH + 1, len(low))
    new = np.empty(len(low), bool)
    new[0] = True
    np.not_equal(low[1:], low[:-1], out=new[1:])
    for begin, valid, end in zip(np.maximum(begins, 0).tolist(), stop.tolist(), ends.tolist()):
        new[max(begin, valid) : end] = False
        if valid > begin:
            new[begin] = True
    start = np.flatnonzero(new)
    if not len(start):
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),)
    doc = np.searchsorted(ends, start, side="right")
    last = np.minimum(np.append(start[1:], len(low)), stop[doc]) - 1
    at = (low[start] & np.uint64((1 << 24) - 1)).astype(np.int64)
    base = begins[doc]
    return doc + first, at - base, start - base, last - base, grams[at]


class Block:
    """Documents of one block with their anchors, ordered by hash range."""

    def __init__(self, texts: list[bytes], ranges: int):
        self.texts = texts
        found = list(anchors(texts))
        cols = [np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(5)]
        h = cols[4].astype(np.uint64)
        # anchors have small hashes, being the smallest of many: mixed again, so that ranges are even
        where = ((mixed(h) >> np.uint64(48)) * np.uint64(ranges) >> np.uint64(16)).astype(np.int64)
        order = np.argsort(where, kind="stable")
        self.doc, self.at, self.first, self.last, self.hash = (c[order] for c in (*cols[:4], h))
        self.range = where[order]
        self.edge = np.searchsorted(self.range, np.arange(ranges + 1))

    def records(self, flags: dict[int, np.ndarray], ids: np.ndarray, ranges: int):
        """Records of the flagged anchors: the distinct ones as a list of
        (range, key, shift, bytes, id, document, start), in a fixed order; and
        for each anchor part its (document, first, last, number of the record,
        whether it is the record's first place)."""
        flag = np.zeros(len(self.at), np.uint8)
        for k in np.flatnonzero(np.diff(self.edge)).tolist():
            flag[self.edge[k] : self.edge[k + 1]] = flags[k]
        parts = []
        for i in np.flatnonzero(flag).tolist():
            d, q, a, b, h = int(self.doc[i]), int(self.at[i]), int(self.first[i]), int(self.last[i]), int(self.hash[i])
            if flag[i] == 1:
                parts.append((ids[d], d, a, b, q, h))
                continue
            # more right of the anchor is known of strings that start late, more left of early ones
            text, half = self.texts[d], REACH // 2
            cut = max(a, q - half)
            if cut <= b:
                parts.append((ids[d], d, cut, b, q, h ^ zlib.crc32(text[q : q + LENGTH - half]) << 16 & (1 << 64) - 1))
            if a < cut:
                parts.append((ids[d], d, a, min(b, cut - 1), q, h ^ zlib.crc32(text[q - half - 1 : q + GRAM]) << 20 & (1 << 64) - 1))
        parts.sort(key=lambda p: p[:3])
        known: dict[tuple, int] = {}
        out, places = [], []
        for id_, d, a, b, q, key in parts:
            piece = (key, q - b, self.texts[d][a : b + LENGTH])
            n = known.setdefault(piece, len(out))
            places.append((d, a, b, n, n == len(out)))
            if n == len(out):
                where = ((key * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 48) * ranges >> 16
                out.append((where, key, q - b, piece[2], int(id_), d, a))
        return out, places


# ----------------------------------------------------------------- suffix sort


def extension(hashes: Hashes, a: np.ndarray, b: np.ndarray, longest: int = LENGTH) -> np.ndarray:
    """Length of the common extension of the strings that start at ``a`` and
    ``b``, at most ``longest``, by binary search over their prefix hashes."""
    lo, hi = np.zeros(len(a), np.int64), np.full(len(a), longest)
    for _ in range(int(longest).bit_length()):
        mid = (lo + hi + 1) >> 1
        same = hashes.of(a, mid) == hashes.of(b, mid)
        lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
    return lo


def before(data: np.ndarray, hashes: Hashes, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the string at ``a`` sorts below the one at ``b``."""
    n = extension(hashes, a, b)
    k = np.minimum(n, LENGTH - 1)
    return (n < LENGTH) & (data[a + k] < data[b + k])


def merge_sorted(data: np.ndarray, hashes: Hashes, start: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Order of the strings ``start`` within each ``group`` (ascending numbers):
    a stable mergesort from runs of one upwards.  A string's place in the
    merged run is its place in its own run plus the number of strings of the
    other run below it, found by binary search with ``before``."""
    n = len(start)
    order = np.arange(n)
    first = np.searchsorted(group, group)  # where the group starts
    size = np.searchsorted(group, group, side="right") - first
    width = 1
    while n and width < size.max():
        place = np.arange(n) - first
        active = np.flatnonzero(size > width)
        p, f, s = place[active], first[active], size[active]
        run = p // width
        left = run % 2 == 0
        other = f + np.where(left, run + 1, run - 1) * width
        end = np.minimum(other + width, f + s)
        lo, hi = np.minimum(other, end), end.copy()
        begin = lo.copy()
        mine = start[order[active]]
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            mid = (lo[open_] + hi[open_]) >> 1
            theirs = start[order[mid]]
            # stable: of equal strings those of the left run come first
            below = np.where(left[open_], before(data, hashes, theirs, mine[open_]), ~before(data, hashes, mine[open_], theirs))
            lo[open_] = np.where(below, mid + 1, lo[open_])
            hi[open_] = np.where(below, hi[open_], mid)
        pair = f + run // 2 * 2 * width
        moved = order.copy()
        moved[pair + p % width + (lo - begin)] = order[active]
        order, width = moved, 2 * width
    return order


def repeated(records: list[tuple]) -> list[int]:
    """For each distinct record (key, shift, bytes, order), all of one key
    together, a bit mask of its strings that also start in an earlier record."""
    masks = [0] * len(records)
    by_key: dict[int, list[int]] = {}
    for i, r in enumerate(records):
        by_key.setdefault(r[0], []).append(i)
    batch, size = [], 0
    for same in by_key.values():
        if len(same) > 1:
            batch += same
            size += sum(len(records[i][2]) - LENGTH + 1 for i in same)
        if size >= SORT:
            _repeated(records, batch, masks)
            batch, size = [], 0
    if batch:
        _repeated(records, batch, masks)
    return masks


def _repeated(records: list[tuple], chosen: list[int], masks: list[int]) -> None:
    data = np.frombuffer(b"".join(records[i][2] for i in chosen), np.uint8)
    n = np.array([len(records[i][2]) - LENGTH + 1 for i in chosen])
    off = np.concatenate([[0], np.cumsum([len(records[i][2]) for i in chosen])[:-1]])
    rec = np.repeat(np.arange(len(chosen)), n)
    within = np.arange(len(rec)) - np.repeat(np.cumsum(n) - n, n)
    start = off[rec] + within
    shift = np.array([records[i][1] for i in chosen])[rec] + n[rec] - 1 - within  # from string to anchor
    key = np.array([records[i][0] for i in chosen], np.uint64)[rec]
    rank = np.empty(len(chosen), np.int64)
    rank[sorted(range(len(chosen)), key=lambda j: records[chosen[j]][3])] = np.arange(len(chosen))
    hashes = Hashes(data)
    # equal strings have one anchor at one place; runs start in the order of the documents
    order = np.lexsort((rank[rec], shift, key))
    key, shift, start, rec, within = key[order], shift[order], start[order], rec[order], within[order]
    group = np.cumsum(np.concatenate([[0], (key[1:] != key[:-1]) | (shift[1:] != shift[:-1])]))
    by = merge_sorted(data, hashes, start, group)
    start, rec, within = start[by], rec[by], within[by]
    same = (group[1:] == group[:-1]) & (extension(hashes, start[:-1], start[1:]) == LENGTH)
    at = np.flatnonzero(same)
    for k in range(0, len(at), 1 << 16):  # what the hashes call equal is compared
        i = at[k : k + (1 << 16)]
        view = np.lib.stride_tricks.sliding_window_view(data, LENGTH)
        if (view[start[i]] != view[start[i + 1]]).any():
            raise RuntimeError("two different strings have one hash; use another BASE")
    for i in (at + 1).tolist():
        masks[chosen[rec[i]]] |= 1 << int(within[i])


# ---------------------------------------------------------------------- tables


def _squeeze(*parts: bytes) -> bytes:
    return zstandard.compress(np.array([len(p) for p in parts], np.int64).tobytes() + b"".join(parts), 3)


def _spread(blob: bytes, n: int) -> list[bytes]:
    raw = zstandard.decompress(blob)
    sizes = np.frombuffer(raw, np.int64, n)
    ends = 8 * n + np.cumsum(sizes)
    return [raw[e - s : e] for s, e in zip(sizes, ends)]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """Number and documents (id, key, text) of the blocks of a task."""
    first, held, size, n = TaskContext.get().partitionId() << 32, [], 0, 0
    for row in rows_of(batches):
        held.append(row)
        size += len(row[2])
        if size >= BLOCK:
            yield first + n, held
            held, size, n = [], 0, n + 1
    if held:
        yield first + n, held


_PARTS = "block long, range int, data binary"
_PARTS_ARROW = pa.schema([("block", pa.int64()), ("range", pa.int32()), ("data", pa.binary())])


def _hashes_of(blocks: DataFrame, ranges: int) -> DataFrame:
    """Step 1: 48 bits of every anchor's hash, by block and range."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, blob in zip(batch["block"], batch["data"]):
                b = Block(_open(blob.as_py())[3], ranges)
                low = (b.hash & np.uint64((1 << 48) - 1)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
                out = [
                    {"block": number.as_py(), "range": k, "data": low[b.edge[k] : b.edge[k + 1]].tobytes()}
                    for k in np.flatnonzero(np.diff(b.edge)).tolist()
                ]
                if out:
                    yield pa.RecordBatch.from_pylist(out, _PARTS_ARROW)

    return blocks.mapInArrow(part, _PARTS)


def _flags(key: tuple, table: pa.Table) -> pa.Table:
    """Step 2: per block 0 (once), 1 (repeated) or 2 (hot) for each anchor."""
    blobs = table["data"].to_pylist()
    low = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, 6)
    wide = np.zeros((len(low), 8), np.uint8)
    wide[:, :6] = low
    _, at, n = np.unique(wide.view("<u8").ravel(), return_inverse=True, return_counts=True)
    flag = ((n > 1).astype(np.uint8) + (n > HOT).astype(np.uint8))[at]
    ends = np.cumsum([len(b) // 6 for b in blobs])
    out = [zstandard.compress(flag[e - len(b) // 6 : e].tobytes(), 3) for b, e in zip(blobs, ends)]
    return pa.table([table["block"], table["range"], pa.array(out, pa.binary())], _PARTS_ARROW)


def _texts(rows: DataFrame) -> DataFrame:
    """Blocks with their documents."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, docs in _blocks(batches):
            ids = np.array([NO_ID if d[0] is None else d[0] for d in docs], np.int64)
            none = np.array([d[0] is None for d in docs], np.uint8)
            keys = np.array([d[1] for d in docs], np.int64)
            sizes = np.array([len(d[2]) for d in docs], np.int64)
            blob = _squeeze(ids.tobytes(), none.tobytes(), keys.tobytes(), sizes.tobytes(), b"".join(d[2] for d in docs))
            yield pa.RecordBatch.from_pylist([{"block": number, "range": -1, "data": blob}], _PARTS_ARROW)

    return rows.mapInArrow(part, _PARTS)


def _open(blob: bytes):
    ids, none, keys, sizes, text = _spread(blob, 5)
    sizes = np.frombuffer(sizes, np.int64)
    ends = np.cumsum(sizes)
    texts = [text[e - s : e] for s, e in zip(sizes.tolist(), ends.tolist())]
    return np.frombuffer(ids, np.int64), np.frombuffer(none, np.uint8), np.frombuffer(keys, np.int64), texts


def _flags_of(right: pa.Table) -> dict[int, np.ndarray]:
    return {
        k: np.frombuffer(zstandard.decompress(d), np.uint8)
        for k, d in zip(right["range"].to_pylist(), right["data"].to_pylist()) if k >= 0
    }


def _records_of(ranges: int):
    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        """Step 3: the block's distinct records, by range of their key."""
        ids, _, _, texts = _open(left["data"][0].as_py())
        records, _ = Block(texts, ranges).records(_flags_of(right), ids, ranges)
        number, out = left["block"][0].as_py(), []
        records.sort(key=lambda r: r[0])  # stable: the order within a range is that of step 5
        at = 0
        while at < len(records):
            to = at
            while to < len(records) and records[to][0] == records[at][0]:
                to += 1
            mine = records[at:to]
            arrays = [np.array([r[i] for r in mine], t).tobytes() for i, t in ((1, np.uint64), (2, np.int64), (4, np.int64), (5, np.int64), (6, np.int64))]
            sizes = np.array([len(r[3]) for r in mine], np.int64).tobytes()
            out.append({"block": number, "range": mine[0][0], "data": _squeeze(*arrays, sizes, b"".join(r[3] for r in mine))})
            at = to
        return pa.Table.from_pylist(out, _PARTS_ARROW)

    return send


def _masks(key: tuple, table: pa.Table) -> pa.Table:
    """Step 4: for each record of each block a bit mask of its strings that
    also start earlier: all of them, unless it is the earliest of its kind."""
    known: dict[tuple, int] = {}
    distinct, of, spans = [], [], []
    for block, blob in zip(table["block"].to_pylist(), table["data"].to_pylist()):
        *arrays, sizes, text = _spread(blob, 7)
        keys, shifts, ids, docs, starts = (np.frombuffer(a, t).tolist() for a, t in zip(arrays, (np.uint64, *[np.int64] * 4)))
        at = 0
        for k, shift, size, id_, doc, start in zip(keys, shifts, np.frombuffer(sizes, np.int64).tolist(), ids, docs, starts):
            piece = (k, shift, text[at : at + size])
            at += size
            order = (id_, block, doc, start)
            n = known.setdefault(piece, len(distinct))
            if n == len(distinct):
                distinct.append([*piece, order])
            elif order < distinct[n][3]:
                distinct[n][3] = order
            of.append((n, order))
        spans.append((block, len(keys)))
    masks = repeated(distinct)
    out, at = [], 0
    for block, n in spans:
        mine = np.array(
            [masks[i] if order == distinct[i][3] else (1 << len(distinct[i][2]) - LENGTH + 1) - 1 for i, order in of[at : at + n]], np.uint64
        )
        at += n
        out.append({"block": block, "range": -2 - key[0].as_py(), "data": zstandard.compress(mine.tobytes(), 3)})
    return pa.Table.from_pylist(out, _PARTS_ARROW)


_RESULT = "id long, key long, kept binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _finish(ranges: int, with_bytes: bool):
    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        """Step 5: what is left of each document."""
        ids, none, keys, texts = _open(left["data"][0].as_py())
        records, places = Block(texts, ranges).records(_flags_of(right), ids, ranges)
        masks = {-2 - k: np.frombuffer(zstandard.decompress(d), np.uint64).tolist()
                 for k, d in zip(right["range"].to_pylist(), right["data"].to_pylist()) if k < -1}
        next_of = dict.fromkeys(masks, 0)
        mask = []
        for r in records:  # in each range the order of step 3
            mask.append(masks[r[0]][next_of[r[0]]])
            next_of[r[0]] += 1
        gone: dict[int, list[int]] = {}
        for d, a, b, n, first in places:
            if not first:
                gone.setdefault(d, []).extend(range(a, b + 1))
            elif m := mask[n]:
                gone.setdefault(d, []).extend(a + k for k in range(b - a + 1) if m >> k & 1)
        out = []
        for d, text in enumerate(texts):
            kept, spans = text, 0
            if d in gone:
                step = np.zeros(len(text) + 1, np.int64)
                starts = np.array(gone[d])
                np.add.at(step, starts, 1)
                np.add.at(step, starts + LENGTH, -1)
                covered = np.cumsum(step[:-1]) > 0
                spans = int(covered[0]) + int((covered[1:] & ~covered[:-1]).sum())
                kept = np.frombuffer(text, np.uint8)[~covered].tobytes()
            out.append((None if none[d] else int(ids[d]), int(keys[d]), kept if with_bytes else None, len(text), len(text) - len(kept),
                        spans, hashlib.sha256(kept).hexdigest()))
        names = [c.split()[0] for c in _RESULT.split(", ")]
        types = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    return finish


def remove_repeats(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   with_bytes: bool = True) -> DataFrame:
    """One row per document: ``id_col``, ``_t_row`` (its row key), ``kept`` (the
    bytes left; null without ``with_bytes``), ``n_bytes``, ``n_removed``,
    ``n_spans`` (maximal removed runs) and ``kept_sha256``.

    Ids are integers; a null id comes last, and rows of one id come in the
    order in which Spark reads them.  Null texts count as empty; texts of fewer
    than ``LENGTH`` bytes lose nothing.
    """
    need(docs, id_col, text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), row_key(docs).alias("key"), text_of(text_col).alias("t"))
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = materialize_in_batches(_texts(rows), "repeat-blocks")
    flags = materialize_in_batches(_hashes_of(texts, ranges).groupBy("range").applyInArrow(_flags, _PARTS), "repeat-flags", 8)
    records = texts.groupBy("block").cogroup(flags.groupBy("block")).applyInArrow(_records_of(ranges), _PARTS)
    masks = materialize(records.groupBy("range").applyInArrow(_masks, _PARTS), "repeat-masks")
    answers = flags.unionByName(masks)
    out = texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_finish(ranges, with_bytes), _RESULT)
    return out.select(
        F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), F.col("key").alias("_t_row"),
        "kept", "n_bytes", "n_removed", "n_spans", "kept_sha256",
    )
