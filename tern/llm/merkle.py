"""Merkle dataset manifest by slot pivots.

Every document is a leaf, every group (source) a tree over its leaves in the
order of their ids, and the groups' roots are the leaves of one tree above them.
A run of ``FANOUT`` consecutive nodes is one parent: an aggregate by parent
spreads the children into ``FANOUT`` columns, one conditional aggregate per slot
(a slot has one child).
The hash of the columns together is the parent; the columns to the left and to
the right of a child's own slot are its siblings on this level.  The way up is
one such pivot per level, each a third of the one before; the way down joins
each pivot to its parents' proofs, so a proof grows by a level at a time and no
node is hashed twice.

Positions come from a range-partitioned sort that is written once: a row's place
among the rows of its task plus the rows of its group in earlier tasks.  No task
holds a whole group, so one source may have a third of all rows, and what the
driver learns is one number, the size of the largest group.

A manifest's proof is an array of ``left`` and ``right`` siblings, from the leaf
up; ``folded`` computes the root again from a leaf and a proof, whatever the
documents are by then.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tern.llm.common import need
from tern.session import materialize

FANOUT = 3
PATH = "array<struct<left:string,right:string>>"


def leaf_of(fields: Iterable[Column]) -> Column:
    """Lowercase hex SHA-256 of the fields one after the other: ``-`` for null,
    otherwise the number of UTF-8 bytes, a colon and the value as text."""
    parts = []
    for f in fields:
        text = f.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that follows from a leaf and the siblings of its proof."""
    return F.aggregate(proof, leaf, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def proof_digest(proof: Column) -> Column:
    """SHA-256 of the siblings, level by level, left to right (of nothing if
    the whole manifest is one document)."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def numbered(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """``rows`` with ``_t_i``, the position within ``group`` by the ``order``
    columns (nulls first), and ``_t_n``, the group's number of rows.

    The sorted rows are written once with their place; the count of each group
    in each task (no more rows than tasks and groups together) gives the offset.
    """
    keys = [F.col(group), *[F.col(c).asc_nulls_first() for c in order]]
    placed = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_t_at", F.monotonically_increasing_id())
    placed = materialize(placed.withColumn("_t_part", F.shiftright("_t_at", 33)), "merkle-order")
    runs = placed.groupBy(group, "_t_part").agg(F.min("_t_at").alias("_t_from"), F.count(F.lit(1)).alias("_t_c"))
    earlier = Window.partitionBy(group).orderBy("_t_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        group, "_t_part", (F.coalesce(F.sum("_t_c").over(earlier), F.lit(0)) - F.col("_t_from")).alias("_t_shift"),
        F.sum("_t_c").over(Window.partitionBy(group)).alias("_t_n"),
    )
    met = placed.join(materialize(runs, "merkle-runs"), [group, "_t_part"])
    return met.withColumn("_t_i", F.col("_t_at") + F.col("_t_shift")).drop("_t_at", "_t_part", "_t_shift")


def _height(n: int, fanout: int) -> int:
    """Levels above ``n`` leaves until one node remains."""
    k = 0
    while n > 1:
        n, k = -(-n // fanout), k + 1
    return k


def climb(leaves: DataFrame, fanout: int = FANOUT) -> tuple[list[DataFrame], DataFrame]:
    """The pivots of every level and the tops.

    ``leaves`` has ``_t_g`` (the group), ``_t_i``, ``_t_n`` and ``_t_v``, a
    struct with the hash ``h`` and whatever comes back with a leaf.  Pivot k has
    one row per node of level k + 1: ``_t_g``, ``_t_i``, the slots ``_t_c0`` to
    ``_t_c{fanout - 1}`` (null where the last run is short), ``_t_n`` of its
    level and its hash ``_t_h``.  ``tops`` has ``_t_g``, ``_t_level``, ``_t_h``
    and, for groups of one row, ``_t_v``.
    """
    widest = leaves.agg(F.max("_t_n")).first()[0] or 0
    value = leaves.schema["_t_v"].dataType.simpleString()
    tops = leaves.where("_t_n = 1").select("_t_g", F.lit(0).alias("_t_level"), F.col("_t_v.h").alias("_t_h"), "_t_v")
    nodes, pivots = leaves.select("_t_g", "_t_i", "_t_n", "_t_v"), []
    for level in range(1, _height(widest, fanout) + 1):
        slot = F.col("_t_i") % fanout
        many = nodes.where("_t_n > 1").groupBy("_t_g", F.floor(F.col("_t_i") / fanout).cast("long").alias("_t_i"))
        spread = many.agg(
            *[F.first(F.when(slot == s, F.col("_t_v")), ignorenulls=True).alias(f"_t_c{s}") for s in range(fanout)],
            F.max(F.ceil(F.col("_t_n") / fanout).cast("long")).alias("_t_n"),
        )
        h = F.sha2(F.concat(*[F.coalesce(F.col(f"_t_c{s}.h"), F.lit("")) for s in range(fanout)]), 256)
        pivots.append(materialize(spread.withColumn("_t_h", h), f"merkle-level-{level}"))
        nodes = pivots[-1].select("_t_g", "_t_i", "_t_n", F.struct(F.col("_t_h").alias("h")).alias("_t_v"))
        ended = pivots[-1].where("_t_n = 1")
        tops = tops.unionByName(ended.select("_t_g", F.lit(level).alias("_t_level"), "_t_h", F.lit(None).cast(value).alias("_t_v")))
    return pivots, tops


def descend(pivots: list[DataFrame], tops: DataFrame, carried: list[str], fanout: int = FANOUT) -> DataFrame:
    """One row per leaf: ``_t_g``, ``_t_v``, ``carried`` columns of its group's
    top and ``_t_path``, the siblings from the leaf up to the group's top
    followed by the top's own ``_t_path``."""
    keep = [*carried, "_t_path"]
    at = lambda level: tops.where(F.col("_t_level") == level).select("_t_g", F.lit(0).cast("long").alias("_t_i"), *keep)
    nodes = None
    for level in range(len(pivots), 0, -1):
        nodes = at(level) if nodes is None else nodes.unionByName(at(level))
        side = lambda slots: F.concat(F.lit(""), *[F.coalesce(F.col(f"_t_c{s}.h"), F.lit("")) for s in slots])
        child = [
            F.struct(
                (F.col("_t_i") * fanout + s).alias("i"), F.col(f"_t_c{s}").alias("v"),
                F.struct(side(range(s)).alias("left"), side(range(s + 1, fanout)).alias("right")).alias("own"),
            )
            for s in range(fanout)
        ]
        met = pivots[level - 1].drop("_t_n", "_t_h").join(nodes, ["_t_g", "_t_i"])
        met = met.select("_t_g", *keep, F.explode(F.array(*child)).alias("c")).where("c.v is not null")
        path = F.concat(F.array("c.own"), "_t_path").alias("_t_path")
        nodes = met.select("_t_g", F.col("c.i").alias("_t_i"), *carried, path, F.col("c.v").alias("_t_v"))
        if level > 1:
            nodes = nodes.drop("_t_v")
    alone = tops.where("_t_level = 0").select("_t_g", *keep, "_t_v")
    return alone if nodes is None else nodes.select("_t_g", *keep, "_t_v").unionByName(alone)


def manifest(leaves: DataFrame, id_col: str = "doc_id", group_col: str = "source", leaf_col: str = "leaf", fanout: int = FANOUT) -> DataFrame:
    """``leaves`` with ``subroot``, ``root`` and ``proof`` (``PATH``) added.

    ``leaves`` has one row per document with its id, group and hash (see
    ``leaf_of``); further columns come along, those named like a result column
    are replaced.  Leaves ascend by id (null first), rows of one id by their
    hash; rows that agree in both are interchangeable.  Groups ascend bytewise,
    a null group first and apart from the empty string.  A group of one row is
    its own root, an empty table has no rows and no root.
    """
    need(leaves, id_col, group_col, leaf_col)
    made = ("subroot", "root", "proof")
    own = [F.col(f"`{c}`") for c in leaves.columns if c not in made]
    group = F.coalesce(F.concat(F.lit(":"), F.col(f"`{group_col}`").cast("string")), F.lit(""))
    rows = leaves.select(
        group.alias("_t_g"), F.col(f"`{id_col}`").alias("_t_id"), F.col(f"`{leaf_col}`").alias("_t_leaf"),
        F.struct(F.col(f"`{leaf_col}`").alias("h"), F.struct(*own).alias("doc")).alias("_t_v"),
    )
    pivots, tops = climb(numbered(rows, "_t_g", "_t_id", "_t_leaf"), fanout)
    tops = materialize(tops, "merkle-tops")
    # the groups' roots are the leaves of the tree above
    over = tops.select(F.lit("").alias("_t_all"), F.col("_t_g").alias("_t_k"), F.struct(F.col("_t_h").alias("h"), "_t_g").alias("_t_v"))
    above, root = climb(numbered(over, "_t_all", "_t_k").withColumnRenamed("_t_all", "_t_g"), fanout)
    root = root.withColumns({"root": F.col("_t_h"), "_t_path": F.array().cast(PATH)})
    proved = descend(above, root, ["root"], fanout).select(F.col("_t_v._t_g").alias("_t_g"), "root", "_t_path")
    tops = materialize(tops.withColumnRenamed("_t_h", "subroot").join(proved, "_t_g"), "merkle-roots")
    out = descend(pivots, tops, ["subroot", "root"], fanout)
    return out.select("_t_v.doc.*", "subroot", "root", F.col("_t_path").alias("proof"))
