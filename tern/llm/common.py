"""Helpers that the corpus operators share.

Text rules used throughout: a null text counts as the empty text, white space
is the six ASCII characters ``[\\x20\\x09-\\x0D]`` and a word is a maximal run
of anything else.  Operators that return documents carry them as one struct, so
no name of an input column can clash with a working column; operators that
return findings read the columns they need only.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tern.session import materialize

SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def need(df: DataFrame, *names: str) -> None:
    """Raise unless ``df`` has the named columns."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")


def packed(df: DataFrame) -> DataFrame:
    """The rows as one struct column ``_t_doc``, with ``_t_row``."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_t_doc"), row_key(df).alias("_t_row"))


def unpacked(df: DataFrame) -> DataFrame:
    """The rows of ``packed`` with their own columns."""
    return df.select("_t_doc.*")


def text_of(col: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def word_count(text: Column) -> Column:
    """Number of words (long)."""
    return F.size(F.filter(F.split(text, SPACES), lambda w: w != "")).cast("long")


def row_key(df: DataFrame) -> Column:
    """A 64-bit hash of the whole row; equal rows have equal keys."""
    return F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])


def keep_rows(docs: DataFrame, decisions: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` without the rows that ``decisions`` drops.

    ``decisions`` has one row per document: ``id_col``, ``_t_row`` (its
    ``row_key``) and ``_t_kept``.  Only the keys of dropped rows are joined,
    against which Spark keeps a document if none matches.  Of rows that are
    equal in every column and all kept, one stays.
    """
    dropped = decisions.where(~F.col("_t_kept")).select(F.col(id_col).alias("_t_id"), "_t_row").distinct()
    twice = (
        decisions.where("_t_kept").groupBy(F.col(id_col).alias("_t_id"), "_t_row").count().where("count > 1").drop("count")
    )
    twice = materialize(twice, "repeated")
    rows = packed(docs).withColumnRenamed("_t_row", "_t_own")
    match = F.col("_t_doc")[id_col].eqNullSafe(F.col("_t_id")) & (F.col("_t_own") == F.col("_t_row"))
    kept = rows.join(dropped, match, "left_anti")
    if twice.isEmpty():
        return unpacked(kept)
    single = unpacked(kept.join(twice, match, "left_anti"))
    return single.unionByName(unpacked(kept.join(twice, match, "left_semi")).dropDuplicates())


def materialize_in_batches(df: DataFrame, name: str, rows: int = 1000) -> DataFrame:
    """``materialize`` with at most ``rows`` rows in an Arrow batch, for jobs
    whose Python tasks read whole texts or packed blocks: a batch is held by the
    JVM, by Arrow and as Python objects at once."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(key)
    conf.set(key, str(rows if int(before) <= 0 else min(rows, int(before))))
    try:
        return materialize(df, name)
    finally:
        conf.set(key, before)


def rows_of(batches: Iterator[pa.RecordBatch], at_once: int = 64) -> Iterator[tuple]:
    """The rows of Arrow batches as tuples, strings as UTF-8 bytes.  Few rows
    are Python objects at a time, however many a batch has."""
    for batch in batches:
        columns = [c.cast(pa.binary()) if pa.types.is_string(c.type) else c for c in batch.columns]
        for at in range(0, batch.num_rows, at_once):
            yield from zip(*(c.slice(at, at_once).to_pylist() for c in columns))


def parts_of(batches: Iterator[pd.Series], at_once: int = 256) -> Iterator[pd.Series]:
    """The batches of a pandas UDF in smaller parts, so that what a part needs
    beside its texts is small however many rows a batch has."""
    for batch in batches:
        for at in range(0, max(len(batch), 1), at_once):
            yield batch.iloc[at : at + at_once]
