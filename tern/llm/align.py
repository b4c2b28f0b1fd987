"""Alignment of two tokenizers over a corpus.

Each text is encoded by a byte-level vocabulary (A) and by a piece vocabulary
(B).  Where tokens of both end at one byte, a group ends; an A and a B token
whose byte ranges overlap are linked, and the links of a pair of ids are counted
over the corpus.

Alignments compose.  A byte range of a document yields a ``Fragment``: an open
prefix up to the first common end, the closed groups from there to the last one,
and an open suffix.  Composing two neighbours closes what the suffix of the one
and the prefix of the other have in common, and it is associative.  A document
of more than ``CHUNK`` bytes is cut into byte ranges that spread over the tasks;
their fragments are composed ``FANIN`` neighbours at a time until one is left,
so no task encodes a whole long document.  Each tokenizer's stream is cut at its
own certain cuts at or behind a range's border, A's in front of a space that
follows a printable character (where a pre-token begins whatever stands before),
B's between two characters that stand together in no piece (no merge can join
them); so the two streams of a range neither begin nor end at one byte.
Documents of one range are aligned many at a time.

The corpus counts travel like the words of the scoring operator: a block of
documents sends its distinct pairs by range of B's id, a range adds them up and
answers each block with the counts and whether a count is the highest of its B
id; the block's links wait in the shared folder as places in that answer.  A
pair that all documents have is one entry per block.

The vocabulary files are read on the driver and broadcast.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tern.llm import bpe
from tern.llm.common import materialize_in_batches, need, row_key
from tern.session import materialize

CHUNK = 1 << 16  # bytes of a document that one task encodes at a time
FANIN = 16  # fragments that one task composes
TOGETHER = 1 << 20  # bytes of documents that are aligned together
BLOCK = 1 << 21  # links of a block
B_BITS = 15  # of a B id in a packed pair; A's has the other 16 of 31
A_CUT = re.compile(rb"(?<=[!-~]) ")


# ------------------------------------------------------------------ tokenizers


def load(a_path: str, b_path: str) -> tuple[dict[bytes, int], bytes]:
    """What the two vocabulary files hold: A's tokens with their ids, and B's
    model without the space that it would put in front of every range."""
    from sentencepiece import sentencepiece_model_pb2

    vocabulary = bpe.load(a_path)
    ids, made = vocabulary["ids"], [s & bpe.ID_MASK for s in vocabulary["steps"].values()]
    if made != sorted(made) or max(ids[bytes([k])] for k in range(256)) > made[0] or max(ids.values()) >= 1 << 31 - B_BITS:
        raise ValueError(f"{a_path}: ids do not follow the order of the merges")
    model = sentencepiece_model_pb2.ModelProto()
    with open(b_path, "rb") as f:
        model.ParseFromString(f.read())
    rules = model.normalizer_spec
    if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.add_dummy_prefix or len(model.pieces) > 1 << B_BITS:
        raise ValueError(f"{b_path} is not a plain piece vocabulary with byte fallback")
    rules.add_dummy_prefix = False
    return ids, model.SerializeToString()


class Tokenizers:
    """Both tokenizers of a worker process."""

    def __init__(self, ids: dict[bytes, int], model: bytes):
        self.a = tiktoken.Encoding("a", pat_str=bpe.PATTERN, mergeable_ranks=ids, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        n, m = max(ids.values()) + 1, self.b.get_piece_size()
        self.a_bytes: list[bytes] = [b""] * n
        for t, i in ids.items():
            self.a_bytes[i] = t
        pieces = [self.b.id_to_piece(i) for i in range(m)]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_size = np.array([len(t) for t in self.a_bytes])
        self.b_size = np.array([len(t) for t in self.b_bytes])
        self.inside = {x for i, p in enumerate(pieces) if not self.b.is_byte(i) for q in [p.replace("▁", " ")] for x in zip(q, q[1:])}
        # an id's digits before a comma, the bar and the semicolon
        self.width = max(n, m)
        digits = [str(i).encode() for i in range(self.width)]
        self.digits = np.array([d + s for s in (b",", b"|", b";") for d in digits], object)

    def cuts(self, raw: bytes, at: int) -> tuple[int, int]:
        """The first certain cut of A and of B at or behind byte ``at`` (the
        text's end if there is none)."""
        found = A_CUT.search(raw, at)
        while at < len(raw) and raw[at] & 0xC0 == 0x80:
            at += 1
        before = at - 1
        while before > 0 and raw[before] & 0xC0 == 0x80:
            before -= 1
        b, last = at, raw[before:at].decode()
        while b < len(raw):
            to = b + 1
            while to < len(raw) and raw[to] & 0xC0 == 0x80:
                to += 1
            letter = raw[b:to].decode()
            if (last, letter) not in self.inside:
                break
            b, last = to, letter
        return (found.start() if found else len(raw)), b

    def encode(self, a: list[bytes], b: list[bytes]) -> list[tuple[np.ndarray, np.ndarray, bool]]:
        """Ids of both vocabularies for each part, and whether the tokens'
        bytes are those of the parts."""
        out = []
        for x, y, j in zip(a, b, self.b.encode([y.decode() for y in b], num_threads=1)):
            i = self.a.encode_to_numpy(x.decode(), disallowed_special=()).astype(np.int64) if x else np.zeros(0, np.int64)
            same = b"".join([self.b_bytes[k] for k in j]) == y and b"".join([self.a_bytes[k] for k in i.tolist()]) == x
            out.append((i, np.array(j, np.int64), same))
        return out


_made: tuple[object, Tokenizers] | None = None


def _tokenizers(shared) -> Tokenizers:
    """The tokenizers of this worker process, made anew for another broadcast."""
    global _made
    if _made is None or _made[0] is not shared.value:
        _made = shared.value, Tokenizers(*shared.value)
    return _made[1]


# ------------------------------------------------------------------- alignment


@dataclass
class Closed:
    """Groups: how many tokens and groups, the links as packed id pairs, and
    the groups' ids as text, each group followed by a semicolon."""

    n_a: int = 0
    n_b: int = 0
    n_groups: int = 0
    links: list[np.ndarray] = field(default_factory=list)
    text: list[bytes] = field(default_factory=list)

    def __add__(self, other: Closed) -> Closed:
        return Closed(self.n_a + other.n_a, self.n_b + other.n_b, self.n_groups + other.n_groups, self.links + other.links, self.text + other.text)


def close(t: Tokenizers, a: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_end: np.ndarray, ends: np.ndarray) -> list[Closed]:
    """The groups of several byte ranges that follow each other from byte 0 and
    end, with a token of either side, at the bytes ``ends``."""
    if not len(ends):
        return []
    mark = np.zeros(int(ends[-1]) + 1, np.uint8)
    mark[a_end] = 1
    mark[b_end] += 2
    at = np.flatnonzero(mark)  # every end; between two of them one A and one B token overlap: a link
    kind = mark[at]
    in_a, in_b, both = kind & 1, kind >> 1, kind == 3
    a_of, b_of = np.cumsum(in_a, dtype=np.int64) - in_a, np.cumsum(in_b, dtype=np.int64) - in_b
    links = (a[a_of] << B_BITS | b[b_of]).astype(np.int32)
    group = np.cumsum(both) - both
    group_a, group_b = group[in_a == 1], group[in_b == 1]
    n = int(both.sum())
    first_a, first_b = np.searchsorted(group_a, np.arange(n + 1)), np.searchsorted(group_b, np.arange(n + 1))
    # A's tokens of a group, then B's
    code = np.empty(len(a) + len(b), np.int64)
    place_a, place_b = np.arange(len(a)) + first_b[group_a], np.arange(len(b)) + first_a[group_b + 1]
    code[place_a], code[place_b] = a, b
    code[place_a[first_a[1:] - 1]] += t.width
    code[place_b[first_b[1:] - 1]] += 2 * t.width
    digits = t.digits[code].tolist()
    cut = np.searchsorted(at, ends, side="right")
    na, nb, ng = (np.concatenate([[0], x[cut - 1]]) for x in (np.cumsum(in_a, dtype=np.int64), np.cumsum(in_b, dtype=np.int64), np.cumsum(both)))
    cut = np.concatenate([[0], cut])
    out = []
    for k in range(len(ends)):
        text = b"".join(digits[na[k] + nb[k] : na[k + 1] + nb[k + 1]])
        out.append(Closed(*(int(x[k + 1] - x[k]) for x in (na, nb, ng)), [links[cut[k] : cut[k + 1]]], [text]))
    return out


NONE = np.zeros(0, np.int64)


@dataclass
class Open:
    """Tokens whose groups are not complete: ids and ends (bytes of the
    document) of both sides."""

    a: np.ndarray = field(default_factory=lambda: NONE)
    a_end: np.ndarray = field(default_factory=lambda: NONE)
    b: np.ndarray = field(default_factory=lambda: NONE)
    b_end: np.ndarray = field(default_factory=lambda: NONE)

    def __add__(self, other: Open) -> Open:
        return Open(*(np.concatenate([getattr(self, k), getattr(other, k)]) for k in ("a", "a_end", "b", "b_end")))

    def between(self, low: int, high: int) -> Open:
        """The tokens that end behind ``low``, at ``high`` at the latest."""
        i, j = np.searchsorted(self.a_end, [low, high], side="right")
        k, m = np.searchsorted(self.b_end, [low, high], side="right")
        return Open(self.a[i:j], self.a_end[i:j], self.b[k:m], self.b_end[k:m])

    def closed(self, t: Tokenizers, start: int) -> Closed:
        """As groups; the tokens begin at ``start``, where a group begins, and
        end where one ends."""
        if not len(self.a):
            return Closed()
        return close(t, self.a, self.a_end - start, self.b, self.b_end - start, self.a_end[-1:] - start)[0]


LAST = 1 << 62


@dataclass
class Fragment:
    """The alignment of a byte range: tokens up to the first common end
    (``prefix``), groups from there (byte ``low``) to the last one (byte
    ``high``), and the tokens behind (``suffix``).  Without a common end
    ``closed`` is None and all tokens are the prefix.  ``same`` is false if the
    tokens' bytes are not those of the text."""

    prefix: Open
    closed: Closed | None = None
    suffix: Open = field(default_factory=Open)
    low: int = 0
    high: int = 0
    same: bool = True

    @staticmethod
    def of(t: Tokenizers, tokens: Open, same: bool = True) -> Fragment:
        common = np.intersect1d(tokens.a_end, tokens.b_end, assume_unique=True)
        if not len(common):
            return Fragment(tokens, same=same)
        low, high = int(common[0]), int(common[-1])
        closed = tokens.between(low, high).closed(t, low)
        return Fragment(tokens.between(-1, low), closed, tokens.between(high, LAST), low, high, same)

    def then(self, t: Tokenizers, other: Fragment) -> Fragment:
        """The alignment of this range and the one that follows it."""
        same = self.same and other.same
        open_ = self.prefix if self.closed is None else self.suffix
        middle = Fragment.of(t, open_ + other.prefix, same)
        if self.closed is None:
            if other.closed is None:
                return middle
            # the other's prefix ends at a common end, so the middle has one
            return Fragment(middle.prefix, middle.closed + other.closed, other.suffix, middle.low, other.high, same)
        if middle.closed is None:
            return Fragment(self.prefix, self.closed, middle.prefix, self.low, self.high, same)
        # the middle begins where a group begins: its prefix is a group
        closed = self.closed + middle.prefix.closed(t, self.high) + middle.closed
        if other.closed is None:
            return Fragment(self.prefix, closed, middle.suffix, self.low, middle.high, same)
        return Fragment(self.prefix, closed + other.closed, other.suffix, self.low, other.high, same)

    def whole(self, t: Tokenizers) -> Closed | None:
        """The groups of a whole document (none if its bytes are not its tokens')."""
        if not self.same or self.closed is None:
            return None
        return self.prefix.closed(t, 0) + self.closed

    def pack(self) -> bytes:
        c = self.closed or Closed()
        arrays = [getattr(o, k) for o in (self.prefix, self.suffix) for k in ("a", "a_end", "b", "b_end")]
        head = [self.low, self.high, self.same, self.closed is not None, c.n_a, c.n_b, c.n_groups]
        return _squeeze(np.array(head, np.int64), *arrays, np.concatenate([np.zeros(0, np.int32), *c.links]), np.frombuffer(b"".join(c.text), np.uint8))

    @staticmethod
    def unpack(blob: bytes) -> Fragment:
        head, *arrays, links, text = _spread(blob, *[np.int64] * 9, np.int32, np.uint8)
        low, high, same, some, n_a, n_b, n_groups = head.tolist()
        closed = Closed(n_a, n_b, n_groups, [links], [text.tobytes()]) if some else None
        return Fragment(Open(*arrays[:4]), closed, Open(*arrays[4:]), low, high, bool(same))


def _squeeze(*arrays: np.ndarray) -> bytes:
    parts = [np.ascontiguousarray(a).tobytes() for a in arrays]
    return zstandard.compress(np.array([len(p) for p in parts], np.int64).tobytes() + b"".join(parts), 1)


def _spread(blob: bytes, *kinds) -> list[np.ndarray]:
    raw = zstandard.decompress(blob)
    sizes = np.frombuffer(raw, np.int64, len(kinds))
    ends = 8 * len(kinds) + np.cumsum(sizes)
    return [np.frombuffer(raw[e - s : e], k) for e, s, k in zip(ends.tolist(), sizes.tolist(), kinds)]


# ---------------------------------------------------------------------- ranges


_RANGES = "doc long, id {id}, key long, pos int, a binary, a_at long, b binary, b_at long"
_FRAGMENTS = "doc long, id {id}, key long, pos int, data binary"


def _arrow(spark: SparkSession, ddl: str) -> pa.Schema:
    return to_arrow_schema(spark.createDataFrame([], ddl).schema)


def _rows(batches: Iterator[pa.RecordBatch], at_once: int = 16) -> Iterator[tuple]:
    for batch in batches:
        for at in range(0, batch.num_rows, at_once):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, at_once).columns))


def ranges(long: DataFrame, shared, id_type: str) -> DataFrame:
    """The byte ranges of long documents (``doc``, ``id``, ``key``, ``raw``)."""
    ddl = _RANGES.format(id=id_type)
    schema = _arrow(long.sparkSession, ddl)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _tokenizers(shared)
        for doc, id_, key, raw in _rows(batches, 1):
            cut = (0, 0)
            for pos in range(-(-len(raw) // CHUNK)):
                to = t.cuts(raw, (pos + 1) * CHUNK) if (pos + 1) * CHUNK < len(raw) else (len(raw), len(raw))
                row = {"doc": doc, "id": id_, "key": key, "pos": pos, "a": raw[cut[0] : to[0]], "a_at": cut[0], "b": raw[cut[1] : to[1]], "b_at": cut[1]}
                yield pa.RecordBatch.from_pylist([row], schema)
                cut = to

    return long.select("doc", "id", "key", "raw").mapInArrow(part, ddl)


def fragments(parts: DataFrame, shared, id_type: str) -> DataFrame:
    """The fragment of each byte range."""
    ddl = _FRAGMENTS.format(id=id_type)
    schema = _arrow(parts.sparkSession, ddl)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _tokenizers(shared)
        for doc, id_, key, pos, a, a_at, b, b_at in _rows(batches, 4):
            i, j, same = t.encode([a], [b])[0]
            tokens = Open(i, a_at + np.cumsum(t.a_size[i]), j, b_at + np.cumsum(t.b_size[j]))
            # without the text's bytes the ends mean nothing
            data = (Fragment.of(t, tokens) if same else Fragment(Open(), same=False)).pack()
            yield pa.RecordBatch.from_pylist([{"doc": doc, "id": id_, "key": key, "pos": pos, "data": data}], schema)

    return parts.mapInArrow(part, ddl)


def compose(rows: DataFrame, rounds: int, shared, id_type: str) -> DataFrame:
    """One fragment per document, ``FANIN`` neighbours at a time."""
    ddl = _FRAGMENTS.format(id=id_type)
    schema = _arrow(rows.sparkSession, ddl)

    def together(key: tuple, table: pa.Table) -> pa.Table:
        t = _tokenizers(shared)
        table = table.sort_by("pos")
        whole = None
        for blob in table["data"]:
            f = Fragment.unpack(blob.as_py())
            whole = f if whole is None else whole.then(t, f) if whole.same and f.same else Fragment(Open(), same=False)
        first = table.select(["doc", "id", "key"]).slice(0, 1).to_pylist()[0]
        return pa.Table.from_pylist([first | {"pos": key[1].as_py(), "data": whole.pack()}], schema)

    for _ in range(rounds):
        rows = rows.groupBy("doc", F.floor(F.col("pos") / FANIN).cast("int").alias("up")).applyInArrow(together, ddl)
    return rows


# ---------------------------------------------------------------------- blocks


_BLOCKS = """block long, bucket int, data binary, ids array<{id}>, keys array<long>, n_a array<long>, n_b array<long>, n_groups array<long>,
    digests array<string>, groups array<string>"""


def _blocks(found: Iterator[tuple], kind: int, buckets: int, schema: pa.Schema, with_groups: bool) -> Iterator[pa.RecordBatch]:
    """Documents (id, key, groups) as blocks.  Bucket -1 of a block has them and
    their links as places among the block's pairs; bucket k has the pairs whose
    B id falls in its range, with their counts."""
    number = (2 * TaskContext.get().partitionId() + kind) << 32
    held: list[tuple] = []

    def block() -> Iterator[pa.RecordBatch]:
        sizes = np.array([sum(map(len, c.links)) if c else 0 for _, _, c in held])
        links = np.concatenate([np.zeros(0, np.int32), *(x for _, _, c in held if c for x in c.links)])
        pairs, place, n = np.unique(links, return_inverse=True, return_counts=True)
        where = (pairs & ((1 << B_BITS) - 1)).astype(np.int64) * 40503 % 65521 % buckets
        order = np.argsort(where, kind="stable")
        rank = np.empty(len(pairs), np.int32)
        rank[order] = np.arange(len(pairs), dtype=np.int32)
        pairs, n, where = pairs[order], n[order], where[order]
        texts = [b"".join(c.text)[:-1] if c else b"" for _, _, c in held]
        count = lambda k: [getattr(c, k) if c else 0 for _, _, c in held]
        yield pa.RecordBatch.from_pylist([{
            "block": number, "bucket": -1, "data": _squeeze(sizes, rank[place]), "ids": [h[0] for h in held], "keys": [h[1] for h in held],
            "n_a": count("n_a"), "n_b": count("n_b"), "n_groups": count("n_groups"),
            "digests": [hashlib.sha256(x).hexdigest() if h[2] else "" for x, h in zip(texts, held)],
            "groups": [x.decode() for x in texts] if with_groups else None,
        }], schema)
        edge = np.searchsorted(where, np.arange(buckets + 1))
        rows = [{"block": number, "bucket": k, "data": _squeeze(pairs[edge[k] : edge[k + 1]], n[edge[k] : edge[k + 1]])} for k in np.flatnonzero(np.diff(edge)).tolist()]
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    size = 0
    for row in found:
        held.append(row)
        size += sum(map(len, row[2].links)) if row[2] else 1
        if size >= BLOCK:
            yield from block()
            held, size, number = [], 0, number + 1
    if held:
        yield from block()


def _short(t: Tokenizers, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Groups of documents of one range (id, key, raw), many at a time."""
    held: list[tuple] = []

    def together() -> Iterator[tuple]:
        some = [h for h in held if h[2]]
        coded = t.encode([h[2] for h in some], [h[2] for h in some])
        good = [(h, i, j) for h, (i, j, same) in zip(some, coded) if same]
        done: dict[int, Closed] = {}
        if good:
            a, b = np.concatenate([i for _, i, _ in good]), np.concatenate([j for _, _, j in good])
            closed = close(t, a, np.cumsum(t.a_size[a]), b, np.cumsum(t.b_size[b]), np.cumsum([len(h[2]) for h, _, _ in good]))
            done = {id(h): c for (h, _, _), c in zip(good, closed)}
        for h in held:
            yield h[0], h[1], done.get(id(h))

    size = 0
    for row in _rows(batches):
        held.append(row)
        size += len(row[2] or b"")
        if size >= TOGETHER:
            yield from together()
            held, size = [], 0
    yield from together()


# ------------------------------------------------------------------ the corpus


_COUNTS = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("data", pa.binary())])


def pair_counts(key: tuple, table: pa.Table) -> pa.Table:
    """For each block the corpus counts of its pairs, in its order, and whether
    a count is the highest of the pair's B id."""
    parts = [_spread(blob.as_py(), np.int32, np.int64) for blob in table["data"]]
    pairs, at = np.unique(np.concatenate([p for p, _ in parts]), return_inverse=True)
    total = np.zeros(len(pairs), np.int64)
    np.add.at(total, at, np.concatenate([n for _, n in parts]))
    b = pairs & ((1 << B_BITS) - 1)
    most = np.zeros(1 << B_BITS, np.int64)
    np.maximum.at(most, b, total)
    best = total == most[b]
    ends = np.cumsum([len(p) for p, _ in parts])
    data = [_squeeze(total[at[e - len(p) : e]], best[at[e - len(p) : e]]) for e, (p, _) in zip(ends, parts)]
    return pa.table([table["block"], table["bucket"], pa.array(data, pa.binary())], _COUNTS)


_RESULT = """id {id}, key long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, groups string"""


def align(spark: SparkSession, docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text",
          with_groups: bool = True) -> DataFrame:
    """One row per document: ``id_col``, ``_t_row`` (its row key), ``n_a`` and
    ``n_b`` (tokens), ``n_groups``, ``n_links``, ``n_best`` (links whose pair
    has the highest count of its B id, ties included), ``count_sum`` (of the
    links' pair counts), ``groups_sha256`` and ``groups``: the ids as
    ``a1,a2|b1;a3|b2,b3`` (null without ``with_groups``).

    Both vocabularies see the text behind one space, special tokens' strings are
    plain text.  Null and empty texts, and texts that a vocabulary cannot give
    back byte by byte, have no tokens: zeros and an empty ``groups_sha256``.
    Rows that are equal in every column count each by itself.
    """
    need(docs, id_col, text_col)
    shared = spark.sparkContext.broadcast(load(a_path, b_path))
    id_type = docs.schema[id_col].dataType.simpleString()
    text = F.col(f"`{text_col}`").cast("string")
    raw = F.when(text != "", F.concat(F.lit(" "), text).cast("binary"))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), row_key(docs).alias("key"), raw.alias("raw"))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ddl = _BLOCKS.format(id=id_type)
    schema = _arrow(spark, ddl)
    size = F.coalesce(F.length("raw"), F.lit(0))
    longest = rows.agg(F.max(size)).first()[0] or 0

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _blocks(_short(_tokenizers(shared), batches), 0, buckets, schema, with_groups)

    def composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _tokenizers(shared)
        found = ((id_, key, Fragment.unpack(data).whole(t)) for _, id_, key, _, data in _rows(batches, 4))
        return _blocks(found, 1, buckets, schema, with_groups)

    made = rows.where(size <= CHUNK).mapInArrow(short, ddl)
    if longest > CHUNK:
        long = rows.where(size > CHUNK).withColumn("doc", F.monotonically_increasing_id())
        parts = ranges(long, shared, id_type).repartition(buckets, "doc", "pos")
        rounds, n = 0, -(-longest // CHUNK)
        while n > 1:
            rounds, n = rounds + 1, -(-n // FANIN)
        made = made.unionByName(compose(fragments(parts, shared, id_type), rounds, shared, id_type).mapInArrow(composed, ddl))
    blocks = materialize_in_batches(made, "align-blocks")
    asked = blocks.where("bucket >= 0").select("block", "bucket", "data").groupBy("bucket")
    counts = materialize(asked.applyInArrow(pair_counts, "block long, bucket int, data binary"), "align-counts")
    result = _RESULT.format(id=id_type)
    out_schema = _arrow(spark, result)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        head = left.to_pylist()[0]
        answers = [_spread(d, np.int64, np.bool_) for _, d in sorted(zip(right["bucket"].to_pylist(), right["data"].to_pylist()))]
        total = np.concatenate([np.zeros(0, np.int64), *(x for x, _ in answers)])
        best = np.concatenate([np.zeros(0, bool), *(x for _, x in answers)])
        sizes, place = _spread(head["data"], np.int64, np.int32)
        ends = np.cumsum(sizes)
        over = lambda x: (s := np.concatenate([[0], np.cumsum(x[place], dtype=np.int64)]))[ends] - s[ends - sizes]
        n = len(sizes)
        return pa.table([head["ids"], head["keys"], head["n_a"], head["n_b"], head["n_groups"], sizes, over(best), over(total), head["digests"],
                         head["groups"] or [None] * n], out_schema)

    heads = blocks.where("bucket = -1").groupBy("block")
    out = heads.cogroup(counts.groupBy("block")).applyInArrow(finish, result)
    return out.withColumnsRenamed({"id": id_col, "key": "_t_row"})
