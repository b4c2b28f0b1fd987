"""Exact deduplication by skew-safe combining.

Texts are equal when identical after each run of ASCII white space is replaced
by one space.  Equal texts meet in three steps, and every step groups by the
whole normalised text (the digest in front only spreads and orders the keys),
so a digest collision can never merge different texts:

1. local: the map-side aggregate of each task keeps one row per text,
2. salted: those rows are merged per (digest, text, salt), the salt being the
   number of the task modulo ``salts``; a text held by a third of all rows
   arrives as one row per task, spread over ``salts`` reducers,
3. global: at most ``salts`` winners per text are combined.

Membership then goes back to the documents by a narrow join on the digest and,
where different texts share a digest, on a second look at the text itself.
Only groups of two and more rows take part; a hot group is one row on the
small side, and AQE splits the hot key on the other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tern.llm.common import SPACES, keep_rows, need, row_key, text_of
from tern.session import materialize


def normalised(text_col: str = "text") -> Column:
    return F.regexp_replace(text_of(text_col), SPACES, " ")


def _order(id_col: str) -> Column:
    # nulls after every id; the row key decides between rows of one id
    return F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col("_t_row").alias("row"))


def text_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """One row per distinct normalised text: ``_t_digest`` (SHA-256 of the
    UTF-8 bytes), ``_t_text`` (null where one row only has it), ``_t_first``
    (smallest id, nulls last, then smallest row key) and ``_t_size``."""
    rows = docs.select(
        F.col(id_col), row_key(docs).alias("_t_row"), normalised(text_col).alias("_t_text")
    ).select(
        F.unhex(F.sha2("_t_text", 256)).alias("_t_digest"),
        "_t_text",
        (F.spark_partition_id() % salts).alias("_t_salt"),
        _order(id_col).alias("_t_o"),
    )
    salted = rows.groupBy("_t_digest", "_t_text", "_t_salt").agg(
        F.min("_t_o").alias("_t_o"), F.count(F.lit(1)).alias("_t_n")
    )
    whole = salted.groupBy("_t_digest", "_t_text").agg(F.min("_t_o").alias("_t_first"), F.sum("_t_n").alias("_t_size"))
    return whole.withColumn("_t_text", F.when(F.col("_t_size") > 1, F.col("_t_text")))


def membership(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """One row per document, dropped ones too: ``id_col``, ``_t_row``,
    ``_t_digest``, ``keep_id``, ``group_size``, ``_t_kept``.

    Of equal texts the row with the smallest id stays; a null id comes after
    every other; rows of one id and text are told apart by a hash of the whole
    row, and rows equal in every column are all marked as kept (``exact_dedup``
    leaves one of them).  Empty and null texts are equal to each other.
    """
    need(docs, id_col, text_col)
    groups = materialize(text_groups(docs, id_col, text_col, salts), "exact-groups")
    # texts that share a digest are told apart by the text; others need no text
    shared = materialize(groups.groupBy("_t_digest").count().where("count > 1").select("_t_digest"), "exact-collisions")
    rows = docs.select(F.col(id_col), row_key(docs).alias("_t_row"), normalised(text_col).alias("_t_text")).withColumn(
        "_t_digest", F.unhex(F.sha2("_t_text", 256))
    )
    plain = groups.where("_t_size > 1").select("_t_digest", "_t_first", "_t_size")
    if shared.isEmpty():
        found = rows.drop("_t_text").join(plain, "_t_digest", "left")
    else:
        apart = groups.join(shared, "_t_digest", "left_semi")
        found = (
            rows.join(shared, "_t_digest", "left_anti").drop("_t_text").join(plain, "_t_digest", "left")
        ).unionByName(
            rows.join(shared, "_t_digest", "left_semi").join(apart, ["_t_digest", "_t_text"], "left").drop("_t_text")
        )
    alone = F.col("_t_size").isNull()
    return found.select(
        F.col(id_col),
        "_t_row",
        "_t_digest",
        F.when(alone, F.col(id_col)).otherwise(F.col("_t_first.id")).alias("keep_id"),
        F.coalesce("_t_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (_order(id_col) == F.col("_t_first"))).alias("_t_kept"),
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """``docs`` with one row of each group of equal texts, columns unchanged.

    Empty input gives empty output; extra columns are carried along.
    """
    decisions = materialize(membership(docs, id_col, text_col, salts).select(id_col, "_t_row", "_t_kept"), "exact-kept")
    return keep_rows(docs, decisions, id_col)
