"""Mixing sources to target weights by hash-threshold histograms.

The mix takes every document of a source ``whole`` times and, once more, those
whose hash lies below the source's threshold.  The threshold is the hash at
which the running size of the source, in hash order, comes nearest to what is
still to be taken.  It is found without sorting documents: sizes are summed by
source and leading hash digits (one aggregate, combined before the shuffle),
the bucket in which the budget is used up is found per source from at most
``16**DIGITS`` sums, and only the documents of that boundary bucket are summed
again by their next digits.  After ``LEVELS`` levels the digits are used up and
the threshold is one hash value.

The hash is the MD5 of the document id, so reruns agree and a larger target
takes a superset.  Documents of one id share a hash and are taken alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tern.llm.common import need, packed, text_of, unpacked, word_count
from tern.session import materialize

DIGITS, LEVELS = 3, 6
WEIGHTS = (5.0, 2.0, 1.0)
SHARE, MOST = 1.5, 2.0


def _hash(id_: Column) -> Column:
    return F.substring(F.md5(F.coalesce(id_.cast("string"), F.lit(""))), 1, DIGITS * LEVELS)


def source_sizes(sized: DataFrame) -> DataFrame:
    """``_t_source``, ``source_size`` and ``_t_rank``: the position by code
    point, null last.  Ranks come from counts per range of sources, so no task
    sees all sources."""
    sums = sized.groupBy("_t_source").agg(F.sum("size").alias("source_size"))
    last = F.col("_t_source").isNull()
    ranged = materialize(
        sums.repartitionByRange(last, "_t_source")
        .sortWithinPartitions(last, "_t_source")
        .withColumn("_t_at", F.monotonically_increasing_id()),
        "mix-sources",
    )
    part = F.shiftright("_t_at", 33)
    # one row per partition of the range exchange
    before = ranged.groupBy(part.alias("_t_part")).agg(F.count(F.lit(1)).alias("_t_n"))
    offsets = before.select(
        "_t_part",
        F.coalesce(F.sum("_t_n").over(Window.orderBy("_t_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_t_off"),
    )
    return (
        ranged.withColumn("_t_part", part)
        .join(F.broadcast(offsets), "_t_part")
        .select("_t_source", "source_size", (F.col("_t_off") + F.col("_t_at") - F.shiftleft("_t_part", 33)).alias("_t_rank"))
    )


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Adds ``target``: ``share`` of the total size, divided by the weights
    (repeating over the ranks).  A target stops at ``most`` times its source's
    size; what it does not use is divided among the others by weight, until
    none is above.  Each round is one aggregate with a single row."""
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("_t_rank") % len(weights) + 1).cast("int"))
    sources = materialize(
        sources.withColumn("_t_w", w).withColumn("_t_cap", F.col("source_size") * F.lit(float(most))), "mix-caps"
    )
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level = -1.0
    while True:
        full = F.col("_t_cap") < F.lit(level) * F.col("_t_w")
        used, free = sources.agg(F.sum(F.when(full, F.col("_t_cap"))), F.sum(F.when(~full, F.col("_t_w")))).first()
        after = (share * total - (used or 0.0)) / free if free else level
        if after <= level or not free:
            break
        level = after
    return sources.withColumn("target", F.least(F.col("_t_cap"), F.lit(max(level, 0.0)) * F.col("_t_w"))).drop("_t_w", "_t_cap")


def thresholds(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds ``_t_whole`` and ``_t_cut``: hashes below ``_t_cut`` are taken once
    more ('' takes none; '~' lies above every hash)."""
    size = F.col("source_size")
    whole = F.when(size > 0, F.floor(F.col("target") / size)).otherwise(F.lit(0)).cast("long")
    state = materialize(
        sources.withColumn("_t_whole", whole)
        .withColumn("_t_rest", F.when(size > 0, F.col("target") - F.col("_t_whole") * size).otherwise(F.lit(0.0)))
        .withColumn("_t_cut", F.lit(""))
        .withColumn("_t_open", F.col("_t_rest") > 0),
        "mix-state",
    )
    by_bucket = Window.partitionBy("_t_source").orderBy("_t_bucket")
    for level in range(1, LEVELS + 1):
        here = state.where("_t_open").select(F.col("_t_source").alias("_t_s"), "_t_cut", "_t_rest")
        # documents of the open bucket of their source: all, then those with its digits
        inside = sized.join(
            here, F.col("_t_source").eqNullSafe(F.col("_t_s")) & F.col("_t_hash").startswith(F.col("_t_cut"))
        )
        sums = inside.groupBy("_t_source", F.substring("_t_hash", 1, DIGITS * level).alias("_t_bucket")).agg(
            F.sum("size").alias("_t_sum"), F.first("_t_rest").alias("_t_rest")
        )
        running = F.sum("_t_sum").over(by_bucket.rowsBetween(Window.unboundedPreceding, 0))
        edge = (
            sums.withColumn("_t_run", running)
            .where("_t_run >= _t_rest")
            .groupBy("_t_source")
            .agg(F.min(F.struct("_t_bucket", "_t_run", "_t_sum")).alias("e"))
            .select(
                F.col("_t_source").alias("_t_s"),
                F.col("e._t_bucket").alias("_t_next"),
                (F.col("e._t_run") - F.col("e._t_sum")).alias("_t_before"),
                F.col("e._t_sum").alias("_t_edge"),
            )
        )
        found = state.join(edge, F.col("_t_source").eqNullSafe(F.col("_t_s")), "left").drop("_t_s")
        rest = F.col("_t_rest") - F.col("_t_before")
        cut = F.when(F.col("_t_next").isNotNull(), F.col("_t_next")).otherwise(F.col("_t_cut"))
        if level == LEVELS:  # one hash: taken if that comes nearer to the budget
            cut = F.when(F.col("_t_next").isNotNull() & (rest * 2 >= F.col("_t_edge")), F.concat(cut, F.lit("~"))).otherwise(cut)
        state = materialize(
            found.withColumn("_t_cut", cut)
            .withColumn("_t_rest", F.coalesce(rest, F.col("_t_rest")))
            .withColumn("_t_open", F.col("_t_open") & F.col("_t_next").isNotNull())
            .drop("_t_next", "_t_before", "_t_edge"),
            "mix-state",
        )
    return state


def mix_decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                  weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """One row per document: ``id_col``, ``size`` (its words; null text: 0),
    ``source_size``, ``target`` and ``copies`` (how often the mix takes it).

    Documents without words have nothing to add and are taken by their hash
    like all others.  A source without words has target 0.  Null is a source
    of its own, and comes last; null ids share one hash.
    """
    need(docs, id_col, text_col, source_col)
    sized = materialize(
        docs.select(
            F.col(id_col).alias("_t_id"), F.col(source_col).alias("_t_source"), _hash(F.col(id_col)).alias("_t_hash"),
            word_count(text_of(text_col)).alias("size"),
        ),
        "mix-sizes",
    )
    state = thresholds(sized, targets(source_sizes(sized), weights, share, most))
    return _taken(sized, state).select(
        F.col("_t_id").alias(id_col), "size", F.col("_t_of").alias("source_size"), F.col("_t_target").alias("target"),
        F.col("_t_copies").alias("copies"),
    )


def _taken(rows: DataFrame, state: DataFrame) -> DataFrame:
    # the thresholds are one row per source, written with their size known, so
    # Spark broadcasts them while they are small and splits hot sources if not
    cuts = state.select(
        F.col("_t_source").alias("_t_s"), F.col("source_size").alias("_t_of"), F.col("target").alias("_t_target"), "_t_whole", "_t_cut"
    )
    return rows.join(cuts, F.col("_t_source").eqNullSafe(F.col("_t_s"))).withColumn(
        "_t_copies", F.col("_t_whole") + F.when(F.col("_t_hash") < F.col("_t_cut"), 1).otherwise(0)
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``docs`` with each document as often as the mix takes it (0 to ``most``
    times), columns unchanged."""
    need(docs, id_col, text_col, source_col)
    sized = materialize(
        docs.select(
            F.col(source_col).alias("_t_source"), _hash(F.col(id_col)).alias("_t_hash"), word_count(text_of(text_col)).alias("size")
        ),
        "mix-sizes",
    )
    state = thresholds(sized, targets(source_sizes(sized), weights, share, most))
    rows = packed(docs)
    tagged = rows.withColumn("_t_source", F.col("_t_doc")[source_col]).withColumn("_t_hash", _hash(F.col("_t_doc")[id_col]))
    taken = _taken(tagged, state).where("_t_copies > 0")
    return unpacked(taken.select("_t_doc", F.explode(F.sequence(F.lit(1), F.col("_t_copies").cast("int")))))
