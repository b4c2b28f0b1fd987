"""FeatureCollections larger than a task (S3).

A JSON reader takes a document as one value, so one document is one task's.
Here a file is read by byte ranges like any text, and the borders of its
features are found without reading it from the start:

1. The text source, with ``}`` as its line separator, splits a file anywhere and
   gives each task whole records.  A task packs consecutive records into chunks
   and notes, for each, whether its quotes turn "outside a string" into
   "inside", and by how much its brackets change the depth if it begins outside
   or inside.  Chunks are written once.
2. Both notes add up, so a running sum over the chunks of a file (one short row
   each) tells how deep, and whether in a string, every chunk begins.
3. Knowing that, a chunk finds the objects at depth two and whether they are in
   the document's ``features``.  Those that begin and end in it are complete;
   the others are put together from the pieces of neighbouring chunks.

Backslashes before a quote are counted; a brace in a string is no border.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tern.session import materialize, settings

CHUNK = 1 << 22  # bytes of records in a chunk, unless one record is longer
KEY = re.compile(rb'"((?:[^"\\]|\\.)*)"\s*:\s*$')

_CHUNKS = "file string, size long, block long, part int, text binary, turns int, outside int, inside int"
_PIECES = "file string, block long, part int, seq int, kind int, document int, listed boolean, text binary"
HEAD, COMPLETE, TAIL, MIDDLE, SUMMARY = range(5)


def split_of(size: int) -> int:
    """Bytes of a range where ``size`` bytes are read: some hundred ranges, none
    below 64 KB, for which a task is not worth its start, nor above 32 MB."""
    return min(max(size // 256, 64 << 10), 32 << 20)


def quotes(data: np.ndarray) -> np.ndarray:
    """Places of the quotes that no backslash escapes."""
    at = np.flatnonzero(data == 34)
    escaped = []
    for k in np.flatnonzero(data[at[at > 0] - 1] == 92) + int(len(at) > 0 and at[0] == 0):
        n, q = 0, int(at[k]) - 1
        while q >= 0 and data[q] == 92:
            n, q = n + 1, q - 1
        if n % 2:
            escaped.append(k)
    return np.delete(at, escaped)


def brackets(data: np.ndarray, quoted: np.ndarray, in_string: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the brackets outside strings, and +1 or -1 for each."""
    at = np.flatnonzero((data | 32 == 123) | (data | 32 == 125))  # { [ and } ]
    at = at[(np.searchsorted(quoted, at) + in_string) % 2 == 0]
    return at, np.where(data[at] | 32 == 123, 1, -1)


def _pack(batches: Iterator[pa.RecordBatch], chunk: int) -> Iterator[pa.RecordBatch]:
    held: list[bytes] = []
    key, size, part = None, 0, 0

    def packed() -> pa.RecordBatch:
        text = b"}".join([*held, b""])
        data = np.frombuffer(text, np.uint8)
        q = quotes(data)
        depth = [int(brackets(data, q, s)[1].sum()) for s in (0, 1)]
        columns = [[key[0]], [key[1]], [key[2]], [part], [text], [len(q) % 2], [depth[0]], [depth[1]]]
        types = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int32(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [c.split()[0] for c in _CHUNKS.split(", ")])

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[1:] != key or size >= chunk:
                if held:
                    yield packed()
                part = part + 1 if row[1:] == key else 0
                key, held, size = row[1:], [], 0
            held.append(row[0])
            size += len(row[0]) + 1
    if held:
        yield packed()


def chunks(spark: SparkSession, path: str, split_bytes: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """The files' chunks, written, with the state in which each begins
    (``in_string``, ``depth``) and whether its last byte is not the file's."""
    lines = spark.read.option("lineSep", "}").text(path).select(
        F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("block"),
    )
    conf = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}
    if split_bytes:
        conf |= {"spark.sql.files.maxPartitionBytes": str(split_bytes), "spark.sql.files.openCostInBytes": str(split_bytes)}
    with settings(spark, conf):
        packed = materialize(lines.mapInArrow(lambda b: _pack(b, chunk), _CHUNKS), "json-chunks")
    whole = Window.partitionBy("file")
    before = whole.orderBy("block", "part").rowsBetween(Window.unboundedPreceding, -1)
    notes = packed.select("file", "size", "block", "part", F.length("text").alias("n"), "turns", "outside", "inside")
    notes = notes.withColumn("in_string", F.coalesce(F.sum("turns").over(before), F.lit(0)) % 2)
    change = F.when(F.col("in_string") == 0, F.col("outside")).otherwise(F.col("inside"))
    # the reader does not say whether the file's last record ended with a brace
    last = F.row_number().over(whole.orderBy(F.col("block").desc(), F.col("part").desc())) == 1
    state = notes.select(
        "file", "block", "part", F.col("in_string").cast("int").alias("in_string"),
        F.coalesce(F.sum(change).over(before), F.lit(0)).cast("int").alias("depth"),
        (last & (F.sum("n").over(whole) > F.col("size"))).alias("added"),
    )
    return packed.select("file", "block", "part", "text").join(state, ["file", "block", "part"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pieces of each chunk, and a summary: how many documents begin in it,
    and whether it ends within ``features`` (null: as it began)."""
    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("part", pa.int32()), ("seq", pa.int32()), ("kind", pa.int32()),
                        ("document", pa.int32()), ("listed", pa.bool_()), ("text", pa.binary())])
    for batch in batches:
        for file, block, part, text, in_string, depth, added in zip(*(c.to_pylist() for c in batch.columns)):
            text = text[:-1] if added else text
            data = np.frombuffer(text, np.uint8)
            at, change = brackets(data, quotes(data), in_string)
            after = depth + np.cumsum(change)
            opens = change > 0
            level = after - change  # in front of the bracket
            docs = at[opens & (level == 0)]
            lists = at[opens & (level == 1)]
            listed = [data[p] == 91 and bool((m := KEY.search(text, max(0, p - 256), p)) and m[1] == b"features") for p in lists.tolist()]
            starts = at[opens & (level == 2) & (data[at] == 123)]
            ends = at[~opens & (after == 2) & (data[at] == 125)] + 1
            rows = []
            if depth > 2:
                rows.append((HEAD if len(ends) else MIDDLE, text[: int(ends[0])] if len(ends) else text, 0, None))
                ends = ends[1:]
            for k, s in enumerate(starts.tolist()):
                inside = int(np.searchsorted(lists, s)) - 1
                rows.append((COMPLETE if k < len(ends) else TAIL, text[s : int(ends[k])] if k < len(ends) else text[s:],
                             int(np.searchsorted(docs, s)), listed[inside] if inside >= 0 else None))
            rows.append((SUMMARY, None, len(docs), listed[-1] if listed else None))
            yield pa.RecordBatch.from_pylist(
                [dict(zip(schema.names, (file, block, part, i, kind, d, x, t))) for i, (kind, t, d, x) in enumerate(rows)], schema
            )


def features(spark: SparkSession, path: str, split_bytes: int | None = None, chunk: int = CHUNK, strict: bool = True) -> DataFrame:
    """The features of the FeatureCollections in the files of ``path``:
    ``file``, ``document`` (its number in the file), ``pos`` (from 0, within the
    document's ``features``) and ``value`` (VARIANT).

    Every task reads a range of a file (``split_bytes``, or the session's split
    size).  A feature that the file's end cuts off raises, or is left out if not
    ``strict``; a malformed one raises.  Elements of ``features`` that are no
    objects are no features.
    """
    with settings(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": "4"}):
        pieces = materialize(chunks(spark, path, split_bytes, chunk).mapInArrow(_cut, _PIECES), "json-pieces")
    at = ["file", "block", "part"]
    before = Window.partitionBy("file").orderBy("block", "part").rowsBetween(Window.unboundedPreceding, -1)
    tails = pieces.where(F.col("kind") == TAIL).select(*at, F.struct("block", "part").alias("_tail"))
    summary = pieces.where(F.col("kind") == SUMMARY).drop("text", "seq", "kind").join(tails, at, "left")
    summary = materialize(summary.select(
        *at, F.coalesce(F.sum("document").over(before), F.lit(0)).alias("_documents"),
        F.coalesce(F.last("listed", ignorenulls=True).over(before), F.lit(False)).alias("_listed"),
        F.last("_tail", ignorenulls=True).over(before).alias("_owner"),
    ), "json-summary")
    begun = pieces.where(F.col("kind").isin(COMPLETE, TAIL)).join(summary, at)
    begun = begun.where(F.coalesce("listed", "_listed")).withColumn("document", (F.col("_documents") + F.col("document") - 1).cast("int"))
    # positions: within the chunk, then the chunks before, then the document's first
    rank = F.row_number().over(Window.partitionBy(*at).orderBy("seq"))
    begun = materialize(begun.select(*at, "kind", "document", "text", rank.alias("_rank")), "json-begun")
    per = begun.groupBy(*at).agg(F.count(F.lit(1)).alias("_n"))
    per = per.select(*at, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    placed = begun.join(per, at).withColumn("_i", F.col("_base") + F.col("_rank") - 1)
    first = placed.groupBy("file", "document").agg(F.min("_i").alias("_first"))
    placed = placed.join(first, ["file", "document"]).withColumn("pos", (F.col("_i") - F.col("_first")).cast("int"))
    # what goes on behind a chunk's end belongs to the last feature that began before
    rest = pieces.where(F.col("kind").isin(HEAD, MIDDLE)).join(summary, at).where("_owner is not null")
    rest = rest.select("file", F.col("_owner.block").alias("_b"), F.col("_owner.part").alias("_p"), F.struct("block", "part", "text").alias("_s"), "kind")
    rest = rest.groupBy("file", "_b", "_p").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("_s")), lambda s: s["text"].cast("string")), "").alias("_rest"),
        F.max(F.col("kind") == HEAD).alias("_ended"),
    ).withColumnsRenamed({"_b": "block", "_p": "part"})
    cut = placed.where(F.col("kind") == TAIL).join(rest, at, "left").select(
        "file", "document", "pos", F.concat(F.col("text").cast("string"), F.coalesce("_rest", F.lit(""))).alias("text"),
        F.coalesce("_ended", F.lit(False)).alias("_ended"),
    )
    if strict:
        said = F.raise_error(F.concat(F.lit("the file ends within a feature: "), "file")).cast("string")
        cut = cut.withColumn("text", F.when(F.col("_ended"), F.col("text")).otherwise(said))
    else:
        cut = cut.where("_ended")
    done = placed.where(F.col("kind") == COMPLETE).select("file", "document", "pos", F.col("text").cast("string").alias("text"))
    return done.unionByName(cut.drop("_ended")).select("file", "document", "pos", F.parse_json("text").alias("value"))
