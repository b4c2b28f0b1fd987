"""Language-model scoring by prediction by partial matching, pretrained.

The model is a trie of byte contexts of up to ``ORDER`` bytes with the counts of
the symbol that follows, over all training documents.  A symbol is a byte
or the end of the text; a text begins in the context of ends.  The
probability of a symbol in a context is its count over the context's total
plus its number of distinct symbols; that number is the escape's share (method
C).  After an escape the next shorter context answers, without the symbols
that the longer one had (exclusion), and below the empty context the symbols
never seen are equally likely.

Contexts of up to two bytes have a bound however large the corpus is: three
neighbouring symbols are at most ``257**3`` numbers, and the probabilities of
all of them are one table that is sent to every task.  Longer contexts have
none, they grow with the corpus, so they are never broadcast.  Each task packs
the distinct strings of ``ORDER + 1`` symbols of a block of documents, with how
often documents to learn from have them, by a hash of the two symbols before the
last.  So all contexts that end in these two meet in one bucket; it adds the
counts up, has the exact statistics of the orders above one, and answers each
block with the probability of each of its strings, going on in the table where
order two escapes.  With the answers and its texts, which wait in the shared
folder, the block is scored.

Beside it stands the smoothed word model, which travels the same way: each
block's words by hash, with their counts, and the block's postings for the
answers.  A word or a string that a third of all documents have is one entry
per block, and only packed rows are shuffled, not one per word and document.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tern.llm.common import materialize_in_batches, need, row_key, rows_of, text_of
from tern.llm.language_id import BITS, Tree, string_runs
from tern.session import materialize

SYMBOLS, END = 257, 256
CELLS = SYMBOLS**3
ORDER = 4  # bytes of context
FOLD, OUT = 7, 2  # documents with this remainder are not learned from
PIECE = 1 << 19  # symbols that a task looks at at a time
BLOCK = 1 << 23  # bytes of text whose words are grouped together
FLUSH = 1 << 30  # symbols after which a task sends its counts, below 2**31


def held_out(id_col: str, fold: int = FOLD, out: int = OUT) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % fold == out, F.lit(False))


# ------------------------------------------------------------------ byte model


def cells_of(raws: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For runs of texts (or parts of one long text): the number of the first
    text, the cell (two symbols of context and the symbol) at each byte and
    end, and where each text of the run starts."""
    at = 0
    while at < len(raws):
        size, to = len(raws[at]) + 1, at + 1
        while to < len(raws) and size + len(raws[to]) + 1 <= PIECE:
            size, to = size + len(raws[to]) + 1, to + 1
        data = np.frombuffer(b"".join([x for r in raws[at:to] for x in (r, b"\0")]), np.uint8)
        starts = np.cumsum([0] + [len(r) + 1 for r in raws[at : to - 1]])
        ends = np.append(starts[1:] - 1, len(data) - 1)
        for k in range(0, len(data), PIECE):
            part = data[max(k - 2, 0) : k + PIECE].astype(np.int32)
            part[ends[(ends >= max(k - 2, 0)) & (ends < k + PIECE)] - max(k - 2, 0)] = END
            if k < 2:
                part = np.concatenate([np.full(2 - k, END, np.int32), part])
            before = part[:-2].copy()
            before[starts[(starts >= k) & (starts < k + PIECE)] - k] = END
            yield at, (before * SYMBOLS + part[1:-1]) * SYMBOLS + part[2:], starts if k == 0 else starts[:1]
        at = to


def count_cells(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``cell`` and ``n`` over every symbol of every text in ``docs``."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, held = np.zeros(CELLS, np.int32), 0

        def rows() -> pa.RecordBatch:
            at = np.flatnonzero(n)
            return pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at].astype(np.int64))], ["cell", "n"])

        for batch in batches:
            for _, cells, _ in cells_of(batch.column(0).cast(pa.binary()).to_pylist()):
                np.add.at(n, cells, np.int32(1))
                held += len(cells)
                if held >= FLUSH:
                    yield rows()
                    n[:], held = 0, 0
        yield rows()

    counted = docs.select(text_of(text_col).alias("t")).mapInArrow(part, "cell long, n long")
    return counted.groupBy("cell").agg(F.sum("n").alias("n"))


class Model:
    """Log10 probabilities ``table[before, last, symbol]`` over ranks: ``rank``
    maps a symbol to its place among those seen, the last place is for others."""

    def __init__(self, cells: np.ndarray, n: np.ndarray):
        a, b, c = cells // SYMBOLS**2, cells // SYMBOLS % SYMBOLS, cells % SYMBOLS
        seen = np.unique(np.concatenate([a, b, c, [END]])).astype(np.int64)
        self.rank = np.full(SYMBOLS, len(seen), np.int64)
        self.rank[seen] = np.arange(len(seen))
        k = self.size = len(seen) + 1
        n2 = np.zeros((k, k, k), np.float64)
        n2[self.rank[a], self.rank[b], self.rank[c]] = n
        n1 = n2.sum(axis=0)
        n0 = n1.sum(axis=0, keepdims=True)
        # below the empty context: the symbols it has not seen, alike
        unseen = SYMBOLS - int((n0 > 0).sum())
        low = np.where(n0 > 0, -np.inf, -np.log10(max(unseen, 1)))
        nothing = np.zeros((1, k), bool)
        p0 = _answer(n0, nothing, low, unseen == 0)
        after0 = _answer(n0, n1 > 0, low, unseen == 0)  # an escape excludes what the longer context had
        p1 = np.where(n1.sum(axis=1, keepdims=True) > 0, _answer(n1, nothing, after0), p0)
        self.table = np.empty((k, k, k), np.float32)
        for before in range(k):
            m = n2[before]
            p2 = _answer(m, nothing, _answer(n1, m > 0, after0))
            self.table[before] = np.where(m.sum(axis=1, keepdims=True) > 0, p2, p1)

    def logs(self, strings: np.ndarray) -> np.ndarray:
        """Log10 probability of the last symbol of packed strings after the two before it."""
        symbol = lambda back: self.rank[strings >> BITS * back & ((1 << BITS) - 1)]
        return self.table.reshape(-1)[(symbol(2) * self.size + symbol(1)) * self.size + symbol(0)]


def _answer(n: np.ndarray, gone: np.ndarray, after: np.ndarray, last: bool = False) -> np.ndarray:
    """Log10 of each symbol's probability in contexts (rows) with counts ``n``,
    without the symbols ``gone``; ``after`` answers where a symbol is new.  A
    context with no symbol left passes on at no cost; ``last``: there is
    nothing to escape to."""
    left = np.where(gone, 0, n)
    total, kinds = left.sum(axis=1, keepdims=True), (left > 0).sum(axis=1, keepdims=True)
    whole = total if last else total + kinds
    with np.errstate(divide="ignore", invalid="ignore"):
        own, escape = np.log10(left / whole), np.where(kinds > 0, np.log10(kinds / whole), 0.0)
    return np.where(left > 0, own, escape + after)


def fit(docs: DataFrame, text_col: str = "text") -> Model:
    """The model of all texts of ``docs``; an empty table gives equal chances.
    At most ``257**3`` counts reach the driver, whatever the corpus."""
    t = count_cells(docs, text_col).toArrow()
    return Model(t["cell"].to_numpy(), t["n"].to_numpy())


# ------------------------------------------------------------------ word model


def _pack(*arrays: np.ndarray, words: list[bytes] | None = None) -> bytes:
    text = b"\n".join(words) if words else b""
    parts = [text] + [a.tobytes() for a in arrays]
    return zlib.compress(np.array([len(p) for p in parts], np.int64).tobytes() + b"".join(parts), 1)


def _unpack(blob: bytes, *kinds) -> list:
    raw = zlib.decompress(blob)
    sizes = np.frombuffer(raw, np.int64, len(kinds) + 1)
    at = 8 * len(sizes)
    out: list = [raw[at : at + sizes[0]].split(b"\n")]
    at += sizes[0]
    for size, kind in zip(sizes[1:], kinds):
        out.append(np.frombuffer(raw[at : at + size], kind))
        at += size
    return out


def _squeeze(*arrays: np.ndarray) -> bytes:
    """Numbers of one kind each, their bytes of equal weight together."""
    parts = [np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T.tobytes() for a in arrays]
    return zstandard.compress(np.array([len(p) for p in parts], np.int64).tobytes() + b"".join(parts), 3)


def _spread(blob: bytes, *kinds) -> list[np.ndarray]:
    raw, out = zstandard.decompress(blob), []
    at = 8 * len(kinds)
    for size, kind in zip(np.frombuffer(raw, np.int64, len(kinds)).tolist(), kinds):
        part = np.frombuffer(raw[at : at + size], np.uint8).reshape(np.dtype(kind).itemsize, -1)
        out.append(np.ascontiguousarray(part.T).view(kind).reshape(-1))
        at += size
    return out


def strings_in(raws: list[bytes], learn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct strings of the texts, ascending, and how often those that
    are learned from have them."""
    parts = []
    for at, strings, starts in string_runs(raws, ORDER):
        known = np.repeat(learn[at : at + len(starts)], np.diff(np.append(starts, len(strings))))
        parts.append(np.unique(strings[known], return_counts=True))  # sorted by value, which is faster than by place
        other = np.unique(strings[~known])
        parts.append((other, np.zeros(len(other), np.int64)))
    every, place = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return every, np.bincount(place, np.concatenate([n for _, n in parts]).astype(float), len(every)).astype(np.int64)


def bucket_of(strings: np.ndarray, buckets: int) -> np.ndarray:
    """By the two symbols before the last one."""
    return (strings >> BITS & ((1 << 2 * BITS) - 1)) * 40503 % 1000003 % buckets


def string_logs(model: Broadcast):
    """The answer of a bucket to each block: log10 of the probability of each of
    the block's strings."""

    def answer(key: tuple, table: pa.Table) -> pa.Table:
        asked = []
        for blob in table["words"]:
            steps, n = _spread(blob.as_py(), np.int64, np.int64)
            asked.append((np.cumsum(steps), n))
        every, place = np.unique(np.concatenate([s for s, _ in asked]), return_inverse=True)
        counts = np.bincount(place, np.concatenate([n for _, n in asked]).astype(float), len(every))
        tree = Tree(every[counts > 0], counts[counts > 0], ORDER, 2)
        bits, open_, node = tree.walk(every)
        logs = -bits * np.log10(2)
        # the table begins with order two; where that has escaped already, only what follows is taken
        behind = np.where(node >= 0, tree.escape[2][np.maximum(node, 0)], 0.0) if len(tree.contexts[2]) else 0.0
        logs[open_] += model.value.logs(every[open_]) - behind * np.log10(2)
        ends = np.cumsum([len(s) for s, _ in asked])
        data = [_squeeze(logs[place[e - len(s) : e]].astype(np.float32)) for e, (s, _) in zip(ends.tolist(), asked)]
        return pa.table([table["block"], table["bucket"], pa.array(data, pa.binary()), pa.nulls(len(data), pa.int64()), pa.nulls(len(data), pa.int64())], _COUNTS)

    return answer


BLOCKS = """block long, bucket int, words binary, posts binary,
    ids array<{id}>, keys array<long>, outs array<boolean>, tokens array<long>"""


def blocks(docs: DataFrame, buckets: int) -> DataFrame:
    """Documents (``id``, ``key``, ``t``, ``out``) as blocks of at least
    ``BLOCK`` bytes of one task.  Bucket -1 of a block has the documents with
    their texts (``posts``); bucket k has ``words`` (those of one hash range,
    and how often each is in documents to learn from) and ``posts`` (for each
    word its number of documents, then those and how often they have it);
    bucket ``buckets + k`` has strings in ``words``, as steps from one to the
    next, and how often each is in documents to learn from."""
    id_type = docs.schema["id"].dataType.simpleString()
    schema = BLOCKS.format(id=id_type)
    arrow = to_arrow_schema(docs.sparkSession.createDataFrame([], schema).schema)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32  # names this task's blocks
        held, size, n = [], 0, 0
        for row in rows_of(batches):
            held.append(row)
            size += len(row[2])
            if size >= BLOCK:
                yield from block(first + n, held)
                held, size, n = [], 0, n + 1
        if held:
            yield from block(first + n, held)

    def block(number: int, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        raws = [r[2] for r in rows]
        place: dict[bytes, int] = {}
        owner, where, times = [], [], []
        for raw in raws:
            c = Counter(raw.lower().split())  # bytes: ASCII case and white space only
            c[b""] += 1  # the end of the text
            where += [place.setdefault(w, len(place)) for w in c]
            times += c.values()
            owner.append(len(c))
        words = list(place)
        where, times = np.array(where, np.int32), np.array(times, np.int32)
        tokens = np.add.reduceat(times, np.cumsum([0] + owner[:-1]), dtype=np.int64)
        owner = np.repeat(np.arange(len(rows), dtype=np.int32), owner)
        out = np.array([r[3] for r in rows], bool)
        learn = np.bincount(where, np.where(out[owner], 0, times), len(words)).astype(np.int64)
        bucket = np.array([zlib.crc32(w) for w in words], np.int64) % buckets
        by_bucket = np.argsort(bucket, kind="stable")
        rank = np.empty(len(words), np.int64)
        rank[by_bucket] = np.arange(len(words))
        order = np.argsort(rank[where], kind="stable")
        per_word = np.bincount(rank[where], minlength=len(words)).astype(np.int32)
        owner, times = owner[order], times[order]
        post = np.concatenate([[0], np.cumsum(per_word)])
        edge = np.searchsorted(bucket[by_bucket], np.arange(buckets + 1))

        def row(k: int, **values) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"block": number, "bucket": k} | values], arrow)

        sizes = np.array([len(r) for r in raws], np.int64)
        yield row(-1, ids=[r[0] for r in rows], keys=[r[1] for r in rows], outs=out.tolist(), tokens=tokens.tolist(),
                  posts=_squeeze(sizes, np.frombuffer(b"".join(raws), np.uint8)))
        strings, n = strings_in(raws, ~out)
        where = bucket_of(strings, buckets)
        order = np.argsort(where, kind="stable")  # ascending within a bucket
        strings, n, edge2 = strings[order], n[order], np.searchsorted(where[order], np.arange(buckets + 1))
        for k in np.flatnonzero(np.diff(edge2)).tolist():
            a, b = edge2[k], edge2[k + 1]
            yield row(buckets + k, words=_squeeze(np.diff(strings[a:b], prepend=0), n[a:b]))
        for k in np.flatnonzero(np.diff(edge)).tolist():
            a, b = edge[k], edge[k + 1]
            yield row(k, words=_pack(learn[by_bucket[a:b]], words=[words[i] for i in by_bucket[a:b]]),
                      posts=_pack(per_word[a:b], owner[post[a] : post[b]], times[post[a] : post[b]]))

    return docs.select("id", "key", "t", "out").mapInArrow(part, schema)


def word_counts(key: tuple, table: pa.Table) -> pa.Table:
    """The corpus counts of a bucket's words, for each block in the order of
    its words; and one row (block -1) with the bucket's tokens and words."""
    total: dict[bytes, int] = {}
    blobs = table["words"].to_pylist()
    for blob in blobs:
        words, learn = _unpack(blob, np.int64)
        for w, c in zip(words, learn.tolist()):
            total[w] = total.get(w, 0) + c
    out = [{"block": b, "bucket": key[0].as_py(), "counts": _pack(np.array([total[w] for w in _unpack(blob, np.int64)[0]], np.int64))}
           for b, blob in zip(table["block"].to_pylist(), blobs)]
    out.append({"block": -1, "bucket": key[0].as_py(), "tokens": sum(total.values()), "kinds": sum(c > 0 for c in total.values())})
    return pa.Table.from_pylist(out, _COUNTS)


_COUNTS = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("counts", pa.binary()), ("tokens", pa.int64()), ("kinds", pa.int64())])


def lm_scores(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id_col``, ``_t_row`` (its row key), ``held_out``,
    ``n_tokens``, ``n_known`` (tokens with a count), ``train_tokens``,
    ``base_score`` (smoothed words) and ``score`` (the byte contexts), both log10.

    Documents whose id's CRC-32 leaves the remainder ``OUT`` modulo ``FOLD`` are
    scored but not learned from; a null id is learned from.  Null and empty
    texts have one token and one symbol, the end.  If nothing can be learned,
    all symbols are alike and no word is known.
    """
    need(docs, id_col, text_col)
    rows = docs.select(
        F.col(id_col).alias("id"), row_key(docs).alias("key"), text_of(text_col).alias("t"), held_out(id_col).alias("out")
    )
    model = spark.sparkContext.broadcast(fit(rows.where(~F.col("out")), "t"))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    packed = materialize_in_batches(blocks(rows, buckets), "lm-blocks")
    answer = "block long, bucket int, counts binary, tokens long, kinds long"
    asked = packed.where("bucket >= 0").select("block", "bucket", "words")
    words = asked.where(F.col("bucket") < buckets).groupBy("bucket").applyInArrow(word_counts, answer)
    strings = asked.where(F.col("bucket") >= buckets).groupBy("bucket").applyInArrow(string_logs(model), answer)
    counts = materialize(words.unionByName(strings), "lm-counts")
    n, v = counts.where("block = -1").agg(F.sum("tokens"), F.sum("kinds")).first()
    n, v = n or 0, v or 0
    out_type = pa.schema([("id", to_arrow_schema(rows.schema).field("id").type), ("key", pa.int64()), ("held_out", pa.bool_()),
                          ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        reply = dict(zip(right["bucket"].to_pylist(), right["counts"].to_pylist()))
        left = left.sort_by("bucket")
        head = left.slice(0, 1).to_pylist()[0]  # bucket -1
        size = len(head["ids"])
        base, known, score = np.zeros(size), np.zeros(size), np.zeros(size)
        for k, posts in zip(left["bucket"].to_pylist()[1:], left["posts"].to_pylist()[1:]):
            if posts is None:
                continue
            _, per_word, owner, times = _unpack(posts, np.int32, np.int32, np.int32)
            c = np.repeat(_unpack(reply[k], np.int64)[1], per_word)
            base += np.bincount(owner, times * np.log10((c + 1) / (n + v + 1)), size)
            known += np.bincount(owner, np.where(c > 0, times, 0), size)
        sizes, text = _spread(head["posts"], np.int64, np.uint8)
        ends = np.cumsum(sizes).tolist()
        text = text.tobytes()
        raws = [text[e - s : e] for e, s in zip(ends, sizes.tolist())]
        # the answers are in the order of the buckets, and in each of its strings
        logs = np.concatenate([np.zeros(0, np.float32), *(_spread(reply[k], np.float32)[0] for k in sorted(reply) if k >= buckets)])
        runs = []
        for at, strings, starts in string_runs(raws, ORDER):
            kinds, place = np.unique(strings, return_inverse=True)
            runs.append((at, starts, kinds, place.astype(np.int32)))
        every = np.unique(np.concatenate([kinds for _, _, kinds, _ in runs]))
        by_string = np.empty(len(every))
        by_string[np.argsort(bucket_of(every, buckets), kind="stable")] = logs
        for at, starts, kinds, place in runs:
            score[at : at + len(starts)] += np.add.reduceat(by_string[np.searchsorted(every, kinds)][place], starts)
        return pa.table([head["ids"], head["keys"], head["outs"], head["tokens"], known.astype(np.int64), base, score], out_type)

    sides = packed.drop("words").groupBy("block").cogroup(counts.where("block >= 0").select("block", "bucket", "counts").groupBy("block"))
    id_type = rows.schema["id"].dataType.simpleString()
    scored = sides.applyInArrow(
        finish, f"id {id_type}, key long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    )
    return scored.select(
        F.col("id").alias(id_col), F.col("key").alias("_t_row"), "held_out", "n_tokens", "n_known",
        F.lit(n).cast("long").alias("train_tokens"), "base_score", "score",
    )
