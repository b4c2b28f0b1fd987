"""SimHash near-deduplication by a self-join of a binary trie.

The distinct fingerprints are the leaves of a binary trie.  The join walks the
trie against itself: a pair of nodes carries the bits in which their prefixes
differ, both nodes are expanded together, and the pair is dropped as soon as
it differs in more than ``budget`` bits.  Pairs that reach the leaves are the
links; no bucket is capped and no pair within the budget is missed.

The walk is dealt out to Spark in two parts.  The top of the trie is a table of
node pairs with their counts of leaves; a pair is expanded there, ``STEP`` bits
at a time, by the bit patterns that the rest of its budget allows, until it is
small enough for a task (``PAIR`` leaves) or ``DEEPEST`` bits are used up.  Each
surviving pair is one group of the second part: its leaves meet in one task,
which walks on below with arrays of node pairs.  A pair whose leaves are still
more than a task should hold is split into blocks of leaves, and every block of
one side is walked against every block of the other, so nothing is lost and no
task holds a whole hot prefix.  Node pairs and blocks are tables throughout; the
driver learns only whether a level has pairs left to expand.

A task does not return its links but a star for each group of leaves that they
connect, so a dense group costs its size and not its square.  The stars are
then joined up by alternating minimum exchanges (large star, small star) until
nothing changes.  Documents of one fingerprint are one leaf throughout.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tern.llm.common import keep_rows, materialize_in_batches, need, parts_of, row_key, text_of
from tern.session import materialize

SHINGLE, BUDGET, SEED = 3, 2, 42
STEP, DEEPEST = 4, 40  # bits by which a pair is expanded, and bits that the table may use
PAIR = 1 << 16  # leaves of a node pair that one task walks
FRONTIER = 1 << 20  # node pairs that a task holds at a time
LANES = np.uint64(0x0101010101010101)


# ---------------------------------------------------------------- fingerprints


def fingerprint(text: str, words: int = SHINGLE) -> int:
    """64 bits: bit k is set if it is set in over half of the shingles' XXH64
    hashes, repeats counted; zero without words."""
    w = text.encode("utf-8").lower().split()  # bytes: ASCII case and white space only
    if not w:
        return 0
    if len(w) <= words:
        return xxhash.xxh64_intdigest(b" ".join(w), SEED)
    line, digest = b" ".join(w), xxhash.xxh64_intdigest
    starts = [0, *accumulate(map(len, w))]
    starts = [s + i for i, s in enumerate(starts)]  # of each word in the line, one space in between
    hashes = [digest(line[s : e - 1], SEED) for s, e in zip(starts, starts[words:])]
    return majority(np.array(hashes, np.uint64))


def majority(hashes: np.ndarray) -> int:
    n, out = len(hashes), 0
    for k in range(8):
        # eight counters at once, one per byte; a byte holds up to 255 ones
        lanes = (hashes >> np.uint64(k)) & LANES
        sums = np.add.reduceat(lanes, np.arange(0, n, 255)).view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
        for byte in np.flatnonzero(sums * 2 > n):
            out |= 1 << (8 * int(byte) + k)
    return out


def fingerprints(docs: DataFrame, text_col: str = "text", words: int = SHINGLE, name: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint (as a signed long) of its whole text."""

    @F.pandas_udf("long")
    def fp(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts_of(texts):
            yield pd.Series(np.array([fingerprint(t, words) for t in part], np.uint64).view(np.int64))

    return docs.withColumn(name, fp(text_of(text_col)))


# ---------------------------------------------------------- walk within a task


def walk(a: np.ndarray, b: np.ndarray, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) with at most ``budget`` differing bits between the
    sorted fingerprints ``a`` and ``b``, by walking their tries together.

    A node is a range of the sorted array that shares its leading bits.  The
    stack holds pieces of the frontier; a piece is at most ``FRONTIER`` pairs.
    """
    if not len(a) or not len(b):
        return
    one = np.array([0], np.int64)
    stack = [(0, one, np.array([len(a)]), one, np.array([len(b)]), np.array([0]))]
    while stack:
        bit, a0, a1, b0, b1, err = stack.pop()
        if len(a0) > FRONTIER:
            for at in range(0, len(a0), FRONTIER):
                stack.append((bit, *(x[at : at + FRONTIER] for x in (a0, a1, b0, b1, err))))
            continue
        # pairs of single leaves: the rest of the bits at once
        single = (a1 - a0 == 1) & (b1 - b0 == 1)
        if single.any():
            i, j = a0[single], b0[single]
            near = np.bitwise_count(a[i] ^ b[j]) <= budget
            if near.any():
                yield i[near], j[near]
        if bit == 64 or single.all():
            if bit == 64 and not single.all():  # equal leaves cannot be: both sides are distinct
                raise AssertionError("fingerprints are not distinct")
            continue
        a0, a1, b0, b1, err = (x[~single] for x in (a0, a1, b0, b1, err))
        mask = np.uint64(1) << np.uint64(63 - bit)
        am, bm = _middle(a, a0, a1, mask), _middle(b, b0, b1, mask)
        parts = [(a0, am, b0, bm, err), (am, a1, bm, b1, err), (a0, am, bm, b1, err + 1), (am, a1, b0, bm, err + 1)]
        cols = [np.concatenate([p[k] for p in parts]) for k in range(5)]
        ok = (cols[1] > cols[0]) & (cols[3] > cols[2]) & (cols[4] <= budget)
        if ok.any():
            stack.append((bit + 1, *(c[ok] for c in cols)))


def _middle(x: np.ndarray, start: np.ndarray, end: np.ndarray, mask: np.uint64) -> np.ndarray:
    """For each range the first index whose leaf has the bit set."""
    lo, hi = start.copy(), end.copy()
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo
        mid = (lo + hi) >> 1
        one = np.zeros(len(lo), bool)
        one[open_] = (x[mid[open_]] & mask) != 0
        hi = np.where(open_ & one, mid, hi)
        lo = np.where(open_ & ~one, mid + 1, lo)


class Union:
    """Connected groups of the leaves 0..n-1 by arrays of links."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            r = self.root
            i, j = r[i], r[j]
            apart = i != j
            i, j = i[apart], j[apart]
            np.minimum.at(r, np.maximum(i, j), np.minimum(i, j))
            while True:
                jumped = r[r]
                if (jumped == r).all():
                    break
                r = jumped
            self.root = r


def star_of_pair(key: tuple, table: pa.Table, budget: int) -> pa.Table:
    """Links of one node pair, as a star per connected group."""
    fp = table["fp"].to_numpy().view(np.uint64)
    side = table["side"].to_numpy()
    a = np.unique(fp[side != 1])  # side 2: both
    b = np.unique(fp[side != 0])
    every = np.union1d(a, b)
    ia, ib = np.searchsorted(every, a), np.searchsorted(every, b)
    groups = Union(len(every))
    for i, j in walk(a, b, budget):
        groups.link(ia[i], ib[j])
    low = np.flatnonzero(groups.root != np.arange(len(every)))
    return pa.table({"u": every[low].view(np.int64), "v": every[groups.root[low]].view(np.int64)})


# ------------------------------------------------------------ top of the trie


def _prefix(bits) -> Column:
    return F.shiftrightunsigned("_t_fp", 64 - bits)


def node_pairs(leaves: DataFrame, budget: int, pair: int = PAIR) -> DataFrame:
    """Node pairs that tasks walk: ``bits``, ``left`` <= ``right`` (prefixes of
    so many bits), ``n_left`` and ``n_right`` (their leaves)."""
    masks = [F.lit(m) for m in range(1 << STEP)]
    cost = lambda m: F.bit_count(m).cast("int")

    def nodes(bits: int) -> DataFrame:
        return leaves.groupBy(_prefix(bits).alias("node")).agg(F.count(F.lit(1)).alias("n"))

    def met(pairs: DataFrame, bits: int, name: str) -> DataFrame:
        """The pairs (left, right, err) of which both nodes exist."""
        known = materialize(nodes(bits), "simhash-nodes")
        both = pairs.join(known.select(F.col("node").alias("left"), F.col("n").alias("n_left")), "left")
        both = both.join(known.select(F.col("node").alias("right"), F.col("n").alias("n_right")), "right")
        return materialize(both.where((F.col("err") <= budget) & (F.col("left") <= F.col("right"))).withColumn("bits", F.lit(bits)), name)

    first = nodes(STEP).select(F.col("node").alias("left"), F.explode(F.array(*masks)).alias("m"))
    first = first.select("left", F.col("left").bitwiseXOR(F.col("m").cast("long")).alias("right"), cost(F.col("m")).alias("err"))
    bits, pairs = STEP, met(first, STEP, "simhash-pairs")
    size = F.col("n_left") + F.when(F.col("left") != F.col("right"), F.col("n_right")).otherwise(0)
    columns = ["bits", "left", "right", "n_left", "n_right"]
    done = pairs.where(size <= pair).select(*columns)
    big = pairs.where(size > pair)
    while bits < DEEPEST and not big.isEmpty():
        child = big.select("left", "right", "err", F.explode(F.array(*masks)).alias("i")).select("*", F.explode(F.array(*masks)).alias("m"))
        child = child.where(F.col("err") + cost(F.col("m")) <= budget)
        down = lambda c, low: F.shiftleft(F.col(c), STEP).bitwiseOR(low.cast("long")).alias(c)
        child = child.select(
            down("left", F.col("i")), down("right", F.col("i").bitwiseXOR(F.col("m"))), (F.col("err") + cost(F.col("m"))).alias("err")
        )
        bits += STEP
        pairs = met(child, bits, "simhash-pairs")
        done = done.unionByName(pairs.where(size <= pair).select(*columns))
        big = pairs.where(size > pair)
    return done.unionByName(big.select(*columns))


def links(spark: SparkSession, leaves: DataFrame, budget: int = BUDGET, pair: int = PAIR) -> DataFrame:
    """Stars (``u``, ``v``, both fingerprints) that connect every two of the
    distinct fingerprints in ``leaves`` (``_t_fp``) within ``budget`` bits."""
    pairs = node_pairs(leaves, budget, pair)
    blocks = lambda c: F.ceil(F.col(c) / pair).cast("int")
    own = F.col("left") == F.col("right")
    work = pairs.select("bits", "left", "right", blocks("n_left").alias("nl"), blocks("n_right").alias("nr"))
    work = work.select("*", F.explode(F.sequence(F.lit(0), F.col("nl") - 1)).alias("x"))
    work = work.select("*", F.explode(F.sequence(F.when(own, F.col("x")).otherwise(0), F.col("nr") - 1)).alias("y"))
    work = materialize(work.withColumn("_t_pair", F.monotonically_increasing_id()), "simhash-work")
    same = own & (F.col("x") == F.col("y"))
    side = lambda node, block, of, k: F.struct(
        F.col(node).alias("node"), F.col(block).alias("block"), F.col(of).alias("blocks"), k.alias("side")
    )
    left, right = side("left", "x", "nl", F.when(same, 2).otherwise(0)), side("right", "y", "nr", F.lit(1))
    plan = work.select("_t_pair", "bits", F.explode(F.when(same, F.array(left)).otherwise(F.array(left, right))).alias("s")).select("_t_pair", "bits", "s.*")
    sent = None
    for bits in range(STEP, DEEPEST + 1, STEP):
        mine = plan.where(F.col("bits") == bits).drop("bits")
        if bits > STEP and mine.isEmpty():
            continue
        part = leaves.select("_t_fp", _prefix(bits).alias("node")).join(mine, "node")
        part = part.where(F.pmod(F.xxhash64("_t_fp"), F.col("blocks")) == F.col("block")).select("_t_pair", F.col("_t_fp").alias("fp"), "side")
        sent = part if sent is None else sent.unionByName(part)
    return sent.groupBy("_t_pair").applyInArrow(lambda key, t: star_of_pair(key, t, budget), "u long, v long")


# ------------------------------------------------------- connected components


def components(edges: DataFrame) -> DataFrame:
    """``_t_fp`` and ``_t_root`` for every node of ``edges`` (``u``, ``v``):
    alternating large-star and small-star steps, each two aggregates with
    partial minima; a hub is one key of an aggregate, never a collected list."""
    edges = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "stars")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: larger neighbours go to the smallest neighbour
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.where("u <> v").distinct(), "stars")
        # small star: smaller neighbours and the node itself go to the smallest
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        met = large.join(low, "u")
        small = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(met.select("u", F.col("m").alias("v")))
        small = materialize(small.where("u <> v").distinct(), "stars")
        same = small.join(edges, ["u", "v"], "left_anti").isEmpty() and edges.join(small, ["u", "v"], "left_anti").isEmpty()
        edges = small
        if same:
            break
    return edges.select(F.col("u").alias("_t_fp"), F.col("v").alias("_t_root"))


# ------------------------------------------------------------------ operators


def near_groups(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE,
                budget: int = BUDGET) -> DataFrame:
    """One row per document: ``id_col``, ``_t_row``, ``_t_fp``, ``_t_root``
    (the component's smallest fingerprint) and ``component_id``, the smallest id
    that links reach (itself included).

    Texts without words have fingerprint zero and link like others; null texts
    count as empty, null ids never are the smallest unless all are null.
    """
    need(docs, id_col, text_col)
    tagged = docs.select(F.col(id_col), row_key(docs).alias("_t_row"), text_of(text_col).alias("_t_text"))
    rows = materialize_in_batches(fingerprints(tagged, "_t_text", words, "_t_fp").drop("_t_text"), "simhash")
    leaves = materialize(rows.groupBy("_t_fp").agg(F.min(id_col).alias("_t_min")), "simhash-leaves")
    roots = components(links(spark, leaves, budget))
    named = leaves.join(roots, "_t_fp", "left").withColumn("_t_root", F.coalesce("_t_root", "_t_fp"))
    smallest = named.groupBy("_t_root").agg(F.min("_t_min").alias("component_id"))
    classes = materialize(named.join(smallest, "_t_root").select("_t_fp", "_t_root", "component_id"), "simhash-classes")
    return rows.join(classes, "_t_fp")


def keep_first(docs: DataFrame, rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest
    id, and of rows of that id the smallest row key.  ``rows`` has one row per
    document: ``id_col``, ``_t_row`` and ``_t_root``, which names its component;
    ids may be null or repeated, so they cannot."""
    order = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col("_t_row").alias("row"))
    named = materialize(rows.withColumn("_t_o", order), "near-groups")
    # partial minima, so a component with a third of all rows is not one task's
    first = named.groupBy("_t_root", (F.col("_t_row") % 16).alias("_t_salt")).agg(F.min("_t_o").alias("_t_o"))
    first = first.groupBy("_t_root").agg(F.min("_t_o").alias("_t_first"))
    met = named.join(first, "_t_root")
    decisions = materialize(
        met.select(F.col(id_col), "_t_row", (F.col("_t_o") == F.col("_t_first")).alias("_t_kept")), "near-kept"
    )
    return keep_rows(docs, decisions, id_col)


def near_dedup(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE,
               budget: int = BUDGET) -> DataFrame:
    """``docs`` with one document of each group, columns unchanged: the one
    with the smallest id, and of rows of that id the smallest row key."""
    return keep_first(docs, near_groups(spark, docs, id_col, text_col, words, budget), id_col)
