"""Sharding by a k-d tree over metadata.

The table is split in two again and again: a node that stands for ``m`` shards
is cut along its widest metadata dimension so that the left part has
``floor(m / 2) / m`` of its bytes, until every leaf has the target bytes of one
shard.  All nodes of a depth are cut together.  The cut is the weighted median
of the dimension, found by histograms: bytes are summed by node and the leading
bits of the coordinate (one aggregate, combined before the shuffle), and only
the rows in the bucket that holds the median are summed again by the next bits.

Rows with one coordinate (a source that has a third of all rows) do not have to
stay together: a hash of the row follows the coordinate as its low bits, so the
median may lie inside a value.  Leaves differ by a document's bytes at most for
each cut above them.

The tree has one node per shard, so its tables are as large as the number of
shards, whatever the number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from tern.llm.common import need, text_of
from tern.session import materialize

COORD, TIE = 31, 31  # bits of a coordinate and of the hash behind it
BITS = 13  # bits that one histogram resolves
SLOT_BITS = 12


def _coordinates(docs: DataFrame, dims: list[str]) -> list[Column]:
    """Each dimension as a long of ``COORD`` bits: numbers between the table's
    smallest and largest, other types by a hash of the value, null first."""
    numeric = [d for d in dims if isinstance(docs.schema[d].dataType, NumericType)]
    edges = docs.agg(*[f(F.col(d).cast("double")) for d in numeric for f in (F.min, F.max)]).first() if numeric else []
    top = (1 << COORD) - 1
    out = []
    for d in dims:
        if d in numeric:
            k = numeric.index(d)
            lo, hi = edges[2 * k] or 0.0, edges[2 * k + 1] or 0.0
            c = ((F.col(d).cast("double") - lo) / ((hi - lo) or 1.0) * (top - 1) + 1).cast("long")
        else:
            c = F.pmod(F.xxhash64(F.col(d).cast("string")), F.lit(top - 1)) + 1
        out.append(F.when(F.col(d).isNull(), F.lit(0).cast("long")).otherwise(c))
    return out


def _cuts(rows: DataFrame, nodes: list[tuple[int, int, float]]) -> list[tuple[int, int, int]]:
    """(node, dimension, cut) for nodes given as (node, dimension, bytes to the
    left): rows whose key along the dimension is below the cut go left."""
    spark = rows.sparkSession
    plan = spark.createDataFrame([(n, d) for n, d, _ in nodes], "_t_node long, _t_dim int")
    keyed = rows.join(plan, "_t_node").select(
        "_t_node", "size", (F.shiftleft(F.element_at("_t_c", F.col("_t_dim") + 1), TIE) + F.col("_t_tie")).alias("_t_key")
    )
    want = {n: w for n, _, w in nodes}
    dim = {n: d for n, d, _ in nodes}
    prefix = {n: 0 for n in want}
    left = COORD + TIE
    while left > 0:
        step = min(BITS, left)
        here = spark.createDataFrame([(n, p, float(want[n])) for n, p in prefix.items()], "_t_node long, _t_prefix long, _t_want double")
        inside = keyed.join(here, "_t_node").where(F.shiftright("_t_key", left) == F.col("_t_prefix"))
        sums = inside.groupBy("_t_node", F.shiftright("_t_key", left - step).alias("_t_b")).agg(
            F.sum("size").alias("_t_s"), F.first("_t_want").alias("_t_want")
        )
        run = F.sum("_t_s").over(Window.partitionBy("_t_node").orderBy("_t_b").rowsBetween(Window.unboundedPreceding, 0))
        edge = (  # at most 2**BITS rows per node reach the window, one per node the driver
            sums.withColumn("_t_run", run).where("_t_run >= _t_want").groupBy("_t_node")
            .agg(F.min(F.struct("_t_b", "_t_run", "_t_s")).alias("e")).select("_t_node", "e.*").collect()
        )
        for r in edge:
            prefix[r["_t_node"]] = r["_t_b"]
            want[r["_t_node"]] -= r["_t_run"] - r["_t_s"]
            if left == step and want[r["_t_node"]] * 2 >= r["_t_s"]:
                prefix[r["_t_node"]] += 1  # the last key goes left if that is nearer
        for n in set(prefix) - {r["_t_node"] for r in edge}:  # rounding: all that is there goes left
            prefix[n] = (prefix[n] + 1 << step) - (0 if left == step else 1)
        left -= step
    return [(n, dim[n], p) for n, p in prefix.items()]


def kd_shards(docs: DataFrame, shards: int = 8, dims: tuple[str, ...] = ("source", "lang", "n_chars"),
              id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id_col``, ``size`` (UTF-8 bytes of the text plus
    1), ``text_crc32``, ``shard`` (0 to ``shards`` - 1) and ``slot`` (gapless
    from 0 in each shard).

    Null texts count as empty, a null coordinate is the smallest.  Rows that
    are equal in id, text and metadata are interchangeable: which of them gets
    which place is open, everything else is the same in every run.  With fewer
    rows than shards some shards stay empty.
    """
    need(docs, id_col, text_col, *dims)
    text = text_of(text_col)
    coords = _coordinates(docs, list(dims))
    rows = docs.select(
        F.col(id_col).alias("_t_id"), F.octet_length(text).cast("long").alias("_t_bytes"), F.crc32(F.encode(text, "utf-8")).alias("text_crc32"),
        F.array(*coords).alias("_t_c"),
    ).select(
        "_t_id", (F.col("_t_bytes") + 1).alias("size"), "text_crc32", "_t_c",
        F.xxhash64("_t_id", "text_crc32", "_t_bytes", "_t_c").alias("_t_hash"),
    )
    tie = F.shiftrightunsigned("_t_hash", 64 - TIE)
    rows = materialize(rows.withColumn("_t_tie", tie).withColumn("_t_node", F.lit(0).cast("long")), "kd-rows")
    # a node is known by the first shard below it
    plan = {0: shards}
    while any(m > 1 for m in plan.values()):
        split = {n: m for n, m in plan.items() if m > 1}
        widths = [
            (F.max(F.element_at("_t_c", k + 1)) - F.min(F.element_at("_t_c", k + 1))).alias(f"_t_w{k}") for k in range(len(dims))
        ]
        chosen = []
        for r in rows.groupBy("_t_node").agg(F.sum("size").alias("_t_sum"), *widths).collect():  # a row per node
            if m := split.get(r["_t_node"]):
                wide = max(range(len(dims)), key=lambda k: (r[f"_t_w{k}"], -k))
                chosen.append((r["_t_node"], wide, r["_t_sum"] * (m // 2) / m))
        if not chosen:
            break
        cuts = rows.sparkSession.createDataFrame(
            [(n, d, c, n + split[n] // 2) for n, d, c in _cuts(rows, chosen)], "_t_node long, _t_dim int, _t_cut long, _t_right long"
        )
        key = F.shiftleft(F.element_at("_t_c", F.col("_t_dim") + 1), TIE) + F.col("_t_tie")
        moved = rows.join(cuts, "_t_node", "left").withColumn(
            "_t_node", F.when(key >= F.col("_t_cut"), F.col("_t_right")).otherwise(F.col("_t_node"))
        )
        rows = materialize(moved.drop("_t_dim", "_t_cut", "_t_right"), "kd-rows")
        plan = {k: v for n, m in plan.items() for k, v in ([(n, m // 2), (n + m // 2, m - m // 2)] if m > 1 else [(n, m)])}
    return _slots(rows).select(
        F.col("_t_id").alias(id_col), "size", "text_crc32", F.col("_t_node").cast("int").alias("shard"), "slot"
    )


def _slots(rows: DataFrame) -> DataFrame:
    """Numbers the rows of each node from 0: by hash ranges, whose sizes give
    each range its first number, and by the hash within a range."""
    part = rows.withColumn("_t_part", F.shiftrightunsigned("_t_hash", 64 - SLOT_BITS).cast("int"))
    sizes = part.groupBy("_t_node", "_t_part").agg(F.count(F.lit(1)).alias("_t_n"))
    ahead = Window.partitionBy("_t_node").orderBy("_t_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_t_node", "_t_part", F.coalesce(F.sum("_t_n").over(ahead), F.lit(0)).alias("_t_off"))
    within = F.row_number().over(Window.partitionBy("_t_node", "_t_part").orderBy("_t_hash", "_t_id", "text_crc32"))
    numbered = part.withColumn("_t_at", within).join(offsets, ["_t_node", "_t_part"])
    return numbered.withColumn("slot", (F.col("_t_off") + F.col("_t_at") - 1).cast("long"))
