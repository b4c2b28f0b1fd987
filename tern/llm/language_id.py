"""Language identification by prediction by partial matching.

Every learned language has a tree of byte contexts of up to ``ORDER`` bytes with
the counts of the symbol that follows (a byte, or the end of the text; a text
begins after one end).  A text's code length under a language is what PPM with
escape method C and full exclusion needs for it with the counts frozen: the
longest context that the tree knows answers; a symbol that it has not seen costs
an escape and is asked for in the next shorter context, without the symbols that
the longer one has.  The language with the shortest code wins.

Training reads a bounded sample: at most ``ROWS`` labelled documents of a
language in the order of a hash of the row, whole texts, together at most
``BYTES`` bytes (a longer document is not learned from).  So the trees have a
size bound, whatever the corpus is: ``BYTES`` strings of ``ORDER + 1`` symbols a
language, and are sent to the tasks that score.  The strings are counted in
Spark; scoring reads every byte of every document.

A task looks at ``AT_ONCE`` bytes at a time.  A position's cost depends on its
last ``ORDER + 1`` symbols only, so each distinct string of these is scored once
and its costs, one a language, are added up by document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tern.llm.common import need, parts_of, row_key, text_of
from tern.session import materialize

ORDER = 4
END, BITS = 256, 9  # the symbol beside the bytes; bits of a symbol in a packed string
ROWS, BYTES = 400, 1 << 20  # the sample of a language
MANY = 1000  # languages; a table with more has something else in that column
FOLD, OUT = 4, 2
AT_ONCE = 1 << 21
UNKNOWN = "und"


def held_out(id_col: str) -> Column:
    """Rows that are never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % FOLD == OUT, F.lit(False))


def strings_of(raws: list[bytes], order: int = ORDER) -> np.ndarray:
    """The last ``order + 1`` symbols at each byte and end of the texts, packed,
    oldest first; before its first byte a text has ends."""
    sizes = np.array([len(r) + 1 for r in raws])
    data = np.frombuffer(b"".join(x for r in raws for x in (r, b"\0")), np.uint8).astype(np.int64)
    ends = np.cumsum(sizes) - 1
    data[ends] = END
    starts = ends + 1 - sizes
    out = data.copy()
    fill = np.zeros(len(data), bool)  # positions whose symbol `back` before lies in front of the text
    for back in range(1, order + 1):
        fill[starts[sizes >= back] + back - 1] = True
        before = np.empty_like(data)
        before[back:], before[:back] = data[:-back], END
        before[fill] = END
        out |= before << (BITS * back)
    return out


def string_runs(raws: list[bytes], order: int = ORDER, at_once: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The strings of runs of texts, or of parts of one long text: the number of
    the run's first text, the strings, and where each text's strings start."""
    at, size = 0, at_once or AT_ONCE
    while at < len(raws):
        n, to = len(raws[at]) + 1, at + 1
        while to < len(raws) and n + len(raws[to]) + 1 <= size:
            n, to = n + len(raws[to]) + 1, to + 1
        if n <= size:
            yield at, strings_of(raws[at:to], order), np.cumsum([0] + [len(r) + 1 for r in raws[at : to - 1]])
        else:
            for k in range(0, n, size):  # the symbols k to k + size, with those before as their context
                low = max(0, k - order)
                part = strings_of([raws[at][low : k + size]], order)
                # what has a whole context, and the end of the text only in its last part
                yield at, part[(k - low) : (None if k + size >= n else -1)], np.zeros(1, np.int64)
        at = to


class Tree:
    """The frozen statistics of one language: for each order from ``lowest`` on
    the packed strings (context and symbol, ascending) with the logarithm of
    their count, and the contexts with the logarithms of what they are divided
    by."""

    def __init__(self, strings: np.ndarray, counts: np.ndarray, order: int = ORDER, lowest: int = 0):
        self.order, self.lowest = order, lowest
        self.strings, self.log_count, self.contexts, self.own, self.escape, self.less, self.less_escape = ([None] * (order + 1) for _ in range(7))
        total, kinds, count = [None] * (order + 1), [None] * (order + 1), [None] * (order + 1)
        for k in range(order, lowest - 1, -1):
            key = strings & ((1 << BITS * (k + 1)) - 1)
            self.strings[k], at = np.unique(key, return_inverse=True)
            count[k] = np.bincount(at, counts, len(self.strings[k]))
            self.log_count[k] = np.log2(count[k])
            self.contexts[k], at = np.unique(self.strings[k] >> BITS, return_inverse=True)
            n = len(self.contexts[k])
            total[k], kinds[k] = np.bincount(at, count[k], n), np.bincount(at, minlength=n).astype(float)
        with np.errstate(divide="ignore"):
            for k in range(lowest, order + 1):
                # the empty context of an alphabet that is seen whole has nothing to escape to
                full = k == 0 and kinds[0] == END + 1
                whole = total[k] + (0 if full else kinds[k])
                self.own[k], self.escape[k] = np.log2(whole), np.log2(kinds[k] / whole)
                if k == lowest:
                    continue
                # after an escape from a context its parent answers without the context's symbols
                parent = np.searchsorted(self.contexts[k - 1], self.contexts[k] & ((1 << BITS * (k - 1)) - 1))
                owner = np.searchsorted(self.contexts[k], self.strings[k] >> BITS)
                there = np.searchsorted(self.strings[k - 1], self.strings[k] & ((1 << BITS * k) - 1))
                left = total[k - 1][parent] - np.bincount(owner, count[k - 1][there], len(owner) and len(self.contexts[k]))
                more = kinds[k - 1][parent] - kinds[k]
                whole = left + (0 if k == 1 and kinds[0] == END + 1 else more)
                self.less[k] = np.log2(np.where(whole > 0, whole, 1))
                # nothing left: the next one is asked at no cost
                self.less_escape[k] = np.where(more > 0, np.log2(np.where(more > 0, more, 1)) - self.less[k], 0.0)
        if not lowest:
            self.unseen = float(np.log2(max(END + 1 - (kinds[0][0] if len(kinds[0]) else 0), 1)))

    def bits(self, strings: np.ndarray) -> np.ndarray:
        """Code length of the last symbol of each string in the context of the
        symbols before it."""
        out, open_, _ = self.walk(strings)
        out[open_] += self.unseen
        return out

    def walk(self, strings: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The code lengths as far as the orders from ``lowest`` on code the
        symbols; which strings they do not code, and for these the context of
        the lowest order that escaped (-1: it is not known)."""
        out = np.zeros(len(strings))
        open_ = np.arange(len(strings))  # not coded yet
        child = np.full(len(strings), -1)  # the context that escaped, among those of the order above
        for k in range(self.order, self.lowest - 1, -1):
            if not len(open_):
                break
            if not len(self.contexts[k]):
                continue
            s = strings[open_]
            context = s >> BITS & ((1 << BITS * k) - 1)
            node = np.minimum(np.searchsorted(self.contexts[k], context), len(self.contexts[k]) - 1)
            known = self.contexts[k][node] == context
            symbol = s & ((1 << BITS * (k + 1)) - 1)
            at = np.minimum(np.searchsorted(self.strings[k], symbol), len(self.strings[k]) - 1)
            seen = self.strings[k][at] == symbol  # then its context is known as well
            first = child < 0
            whole, escape = self.own[k][node], self.escape[k][node]
            if k < self.order:
                up = np.where(first, 0, child)
                whole = np.where(first, whole, self.less[k + 1][up])
                escape = np.where(first, escape, self.less_escape[k + 1][up])
            out[open_] += np.where(seen, whole - self.log_count[k][at], np.where(known, -escape, 0.0))
            open_, child = open_[~seen], np.where(known, node, -1)[~seen]
        return out, open_, child


class Languages:
    """The trees of all languages."""

    def __init__(self, trees: dict[str, Tree]):
        self.names = sorted(trees)
        self.trees = [trees[n] for n in self.names]

    def lengths(self, raws: list[bytes]) -> np.ndarray:
        """Code length in bits of each text (rows) under each language."""
        out = np.zeros((len(raws), len(self.trees)))
        for at, strings, starts in string_runs(raws, self.trees[0].order):
            kind, place = np.unique(strings, return_inverse=True)
            for j, tree in enumerate(self.trees):
                out[at : at + len(starts), j] += np.add.reduceat(tree.bits(kind)[place], starts)
        return out


def count_strings(rows: DataFrame, order: int = ORDER) -> DataFrame:
    """``lang``, ``string`` and ``n`` over every symbol of the texts ``t``."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict = {}
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by.setdefault(name, []).append(text.encode())
            for name, raws in by.items():
                s, n = np.unique(strings_of(raws, order), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(s)), pa.array(s), pa.array(n)], ["lang", "string", "n"])

    return rows.select("lang", "t").mapInArrow(part, "lang string, string long, n long").groupBy("lang", "string").agg(F.sum("n").alias("n"))


def sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = ROWS, size: int = BYTES) -> DataFrame:
    """``lang`` and ``t`` of the rows to learn from."""
    usable = docs.select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("t"),
        F.xxhash64(row_key(docs), F.lit(1)).alias("h"), held_out(id_col).alias("out"),
    ).where("lang is not null and t is not null and not out").where(F.octet_length("t") <= size)
    counted = usable.groupBy("lang").count()
    # a hash below the threshold leaves somewhat more rows than wanted; then the first of them
    share = F.least(F.lit(1.0), F.lit(2.0 * rows) / F.col("count") + 1e-9).alias("share")
    few = usable.join(F.broadcast(_checked(counted)).select("lang", share), "lang").where(F.pmod("h", F.lit(1 << 30)) < F.col("share") * (1 << 30))
    ranked = few.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h", "t"))).where(F.col("k") <= rows)
    ranked = materialize(ranked.select("lang", "t", "k"), "language-sample")
    upto = Window.partitionBy("lang").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("size", F.sum(F.octet_length("t")).over(upto)).where(F.col("size") <= size).select("lang", "t")


def _checked(counted: DataFrame) -> DataFrame:
    """The counts by language, written; at most ``MANY`` rows."""
    counted = materialize(counted, "language-counts")
    if (n := counted.count()) > MANY:
        raise ValueError(f"{n} languages; more than {MANY}")
    return counted


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = ORDER,
        rows: int = ROWS, size: int = BYTES) -> Languages | None:
    """The trees of all languages that have a row to learn from (none: None).

    Rows without text or language and held-out ids are not learned from; rows
    without an id are.  At most ``size`` strings a language reach the driver.
    """
    need(docs, id_col, text_col, lang_col)
    counts = count_strings(sample(docs, id_col, text_col, lang_col, rows, size), order).toArrow()
    name, string, n = counts["lang"].to_numpy(), counts["string"].to_numpy(), counts["n"].to_numpy()
    trees = {k: Tree(string[name == k], n[name == k], order) for k in set(name.tolist())}
    return Languages(trees) if trees else None


def predict(spark: SparkSession, docs: DataFrame, model: Languages | None, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` added (columns of these names
    are replaced).

    ``lang_pred`` is the language of the shortest code (of equal ones the first
    by name) and ``score`` its share among all languages, each weighed by two to
    the power of minus its code length.  A text that is null or has no letter
    is ``und`` with score 0, as is every text if nothing was learned.
    """
    need(docs, text_col)
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score")]
    if model is None:
        return docs.select(*rest, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def best(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        languages = shared.value
        names = np.array(languages.names, object)
        for part in parts_of(texts, 1024):
            lengths = languages.lengths([t.encode() for t in part])
            low = lengths.argmin(axis=1)
            share = 1 / np.exp2(np.maximum(lengths[np.arange(len(low)), low][:, None] - lengths, -1000)).sum(axis=1)
            yield pd.DataFrame({"lang_pred": names[low], "score": share})

    letters = F.coalesce(F.col(f"`{text_col}`").cast("string").rlike(r"\p{L}"), F.lit(False))
    found = docs.select(*rest, letters.alias("_t_l"), best(text_of(f"`{text_col}`")).alias("_t_b"))
    return found.select(
        *rest, F.when(F.col("_t_l"), F.col("_t_b.lang_pred")).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(F.col("_t_l"), F.col("_t_b.score")).otherwise(0.0).alias("score"),
    )
