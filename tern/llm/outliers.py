"""Quality rules: robust multivariate outliers by minimum covariance determinant.

Counts of words, symbols, repeated lines and repeated five-word windows are
taken from every whole text, and from them a vector of transformed shares
(``VECTOR``).  For each language and source the vectors' location and scatter
are estimated from the half of the rows whose scatter has the least determinant,
so junk of up to half of a group cannot widen the estimate that should reject
it.  From each of ``STARTS`` (medians with median deviations, and the mean and
covariance of all rows) concentration steps take the half with the smallest
Mahalanobis distances and estimate again from it.  No step raises the
determinant, and the estimate of the start that ends lowest is used.

A step's half has exactly ``SHARE`` of the group's weight: distances are counted
in ``FINE`` buckets per factor of two, buckets below the border count whole and
the rows of the border bucket all with the weight that is left.  So ties, equal
rows and rows of one bucket need no order.  The scatter is that of the half
times ``CONSISTENCY``, which makes it that of all rows where they are normal,
plus ``TINY`` squared on the diagonal, which keeps it regular; the determinant is
of this sum, for which steps do not rise either.  A start is settled when its
logarithm falls by less than ``SETTLED`` (or after ``STEPS`` steps); settled
ones leave the later steps.

A document whose squared distance to its group's estimate is beyond ``CUT``, the
0.999 quantile of chi-square with six degrees of freedom, is rejected.  Groups
with fewer than ``LEAST`` rows use their language's estimate, languages with
fewer that of the whole table.  In this verdict (not in the steps) a row's
deviation counts at least as its sampling deviation: the root of a share of
``n`` things has variance ``1/(4n)``, so one repeated line of six says little
and fifteen of thirty say much.  Nothing is fitted to labels.

Everything is DataFrame functions.  A step is two aggregates over a narrow table
(counts by bucket, then weighted sums of products), both combined before the
shuffle, so a group with a third of all rows costs no task more than others.
The scatter matrix of a group is inverted in column expressions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tern.llm.common import SPACES, WORD, need, row_key, text_of
from tern.session import discard, materialize

BLANK = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MARKS = "!?;:\"'()[]{}=_~^@/\\+" + SYMBOLS
WINDOW = 5
SHARE, LEAST = 0.5, 200
CONSISTENCY = 1.7845  # SHARE over chi-square(8)'s probability at the median of chi-square(6)
SETTLED = 1e-3  # fall of a log determinant that counts as none
STARTS, STEPS = ("medians", "moments"), 60
FINE = 64  # buckets of distances per factor of two
FEW = 20_000  # groups whose estimates (about 400 bytes each) are broadcast; more are joined by group and salt
TINY = 1e-3  # deviation that keeps the scatter from being singular
#: name, what it is a share of (a repeat is a window and its copy)
VECTOR = (("word_length", "words"), ("symbols", "words"), ("marks", "words"), ("capitals", "words"), ("dup_lines", "lines"), ("repeats", "runs"))
CUT = 22.4577


def _let(value: Column, body) -> Column:
    """``body(v)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _without(text: Column, letters: str) -> Column:
    return F.length(F.translate(text, letters, ""))


def repeated_words(words: Column) -> Column:
    """Words in five-word windows that occur twice or more in ``words``.

    Windows are compared by 64-bit hashes within one document.  Only documents
    with fewer distinct windows than windows sort them.
    """

    def hashes(w: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)),
            lambda i: F.xxhash64(*[F.element_at(w, (i + k).cast("int")) for k in range(WINDOW)]),
        )

    def places(h: Column) -> Column:  # of the windows that another one equals, ascending
        tagged = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return _let(
            tagged,
            lambda s: F.sort_array(
                F.transform(
                    F.filter(
                        F.transform(
                            s,
                            lambda x, j: F.struct(
                                x["i"].alias("i"),
                                (
                                    ((j > 0) & (F.get(s, j - 1)["h"] == x["h"]))
                                    | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False))
                                ).alias("twice"),
                            ),
                        ),
                        lambda x: x["twice"],
                    ),
                    lambda x: x["i"],
                )
            ),
        )

    def covered(h: Column) -> Column:
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        return F.aggregate(
            places(h),
            start,
            lambda a, p: F.struct((a["n"] + p + WINDOW - F.greatest(a["end"], p)).alias("n"), (p + WINDOW).alias("end")),
            lambda a: a["n"],
        )

    some = _let(hashes(words), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))
    return F.when(F.size(words) < WINDOW + 1, F.lit(0)).otherwise(some).cast("long")


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *group: str) -> DataFrame:
    """``id_col``, ``_t_row``, ``group`` columns and the counts of each text:
    ``n_words``, ``word_chars`` (code points in words), ``n_symbols``,
    ``n_dup_lines`` (lines with a word that equal an earlier one),
    ``n_repeat_words``, and ``_t_marks``, ``_t_capitals``, ``_t_lines``."""
    need(docs, id_col, text_col, *group)
    text = F.col("_t_text")
    kept = [F.col(id_col), *[F.col(g) for g in group], F.col("_t_row")]
    read = docs.select(F.col(id_col), *[F.col(g) for g in group], row_key(docs).alias("_t_row"), text_of(text_col).alias("_t_text"))
    trimmed = F.btrim(text, F.lit(BLANK))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACES))
    counted = read.select(
        *kept,
        _let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("r"))).alias("_t_w"),
        _without(text, BLANK).cast("long").alias("word_chars"),
        (F.length(text) - _without(text, SYMBOLS)).cast("long").alias("n_symbols"),
        _let(
            F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)),
            lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")),
        ).alias("_t_l"),
        (F.length(text) - _without(text, MARKS)).cast("long").alias("_t_marks"),
        (F.length(text) - _without(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")).cast("long").alias("_t_capitals"),
    )
    return counted.select(
        *kept, F.col("_t_w.n").alias("n_words"), "word_chars", "n_symbols", F.col("_t_l.dup").alias("n_dup_lines"),
        F.col("_t_w.r").alias("n_repeat_words"), "_t_marks", "_t_capitals", F.col("_t_l.n").alias("_t_lines"),
    )


def _vector() -> list[Column]:
    """The transformed statistics of a row with words."""
    n, chars = F.col("n_words"), F.greatest(F.col("word_chars"), F.lit(1))
    share = lambda a, b: F.sqrt(F.col(a) / b)  # noqa: E731  steadies the variance of a share
    return [
        F.log(chars / n), share("n_symbols", chars), share("_t_marks", chars), share("_t_capitals", chars),
        share("n_dup_lines", F.greatest(F.col("_t_lines"), F.lit(1))), share("n_repeat_words", n),
    ]


def _sampling() -> list[Column]:
    """Sampling deviations of a row's shares, by what they are shares of."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    units = {"words": n, "lines": F.greatest(F.col("_t_lines"), F.lit(1)), "runs": n / (2 * WINDOW)}
    return [(0.5 / F.sqrt(units[k])).alias(f"_t_f_{k}") for k in UNITS]


UNITS = ("words", "lines", "runs")
D, SALTS, KEY = len(VECTOR), 16, ["_t_group", "_t_salt"]
X = [f"_t_x{i}" for i in range(D)]
FLOORS = [f"_t_f_{k}" for k in UNITS]
PAIRS = [(i, j) for i in range(D) for j in range(i + 1)]


def _floored() -> list[Column]:
    """The row's differences from its group's location, smaller where the
    group's deviation is below the row's sampling deviation: as if the greater
    of the two were the group's, with the same correlations."""
    return [
        (F.col(x) - F.col(f"_t_m{i}")) * F.least(F.lit(1.0), F.col(f"_t_sd{i}") / F.col(f"_t_f_{VECTOR[i][1]}"))
        for i, x in enumerate(X)
    ]


def _distance(diff: list[Column] | None = None) -> Column:
    """Squared distance of the row's vector (or of ``diff``) under its group's
    estimate: the sum of squares of ``inverse(L) (x - m)``, where the scatter is
    ``L L'``."""
    diff = diff or [F.col(x) - F.col(f"_t_m{i}") for i, x in enumerate(X)]
    z = [reduce(lambda a, b: a + b, [F.col(f"_t_v{i}_{j}") * diff[j] for j in range(i + 1)]) for i in range(D)]
    return reduce(lambda a, b: a + b, [v * v for v in z])


def _invert(scatter: DataFrame) -> DataFrame:
    """Adds ``_t_v{i}_{j}``, the inverse of the Cholesky factor of the scatter
    ``_t_s{i}_{j}`` (lower triangles), one column after the other, and
    ``_t_log``, the logarithm of the determinant."""
    out = scatter
    for i in range(D):
        for j in range(i + 1):
            rest = F.col(f"_t_s{i}_{j}")
            for k in range(j):
                rest = rest - F.col(f"_t_l{i}_{k}") * F.col(f"_t_l{j}_{k}")
            # rounding apart, the factor's diagonal is at least TINY
            out = out.withColumn(f"_t_l{i}_{j}", F.sqrt(F.greatest(rest, F.lit(TINY**2 / 2))) if i == j else rest / F.col(f"_t_l{j}_{j}"))
    for j in range(D):
        out = out.withColumn(f"_t_v{j}_{j}", 1 / F.col(f"_t_l{j}_{j}"))
        for i in range(j + 1, D):
            rest = reduce(lambda a, b: a + b, [F.col(f"_t_l{i}_{k}") * F.col(f"_t_v{k}_{j}") for k in range(j, i)])
            out = out.withColumn(f"_t_v{i}_{j}", -rest / F.col(f"_t_l{i}_{i}"))
    log = 2 * reduce(lambda a, b: a + b, [F.log(f"_t_l{i}_{i}") for i in range(D)])
    deviations = [F.sqrt(f"_t_s{i}_{i}").alias(f"_t_sd{i}") for i in range(D)]
    return out.select(
        *ESTIMATE, "_t_n", log.alias("_t_log"), *[f"_t_m{i}" for i in range(D)], *deviations, *[f"_t_v{i}_{j}" for i, j in PAIRS]
    )


ESTIMATE = ["_t_group", "_t_start"]


class Groups:
    """Rows of all groups and how tables of one row per group meet them."""

    def __init__(self, rows: DataFrame, n: int):
        self.rows, self.few, self.files = rows, n <= FEW, 1 + n // FEW

    def meet(self, per_group: DataFrame) -> DataFrame:
        """The rows of the groups in ``per_group`` with its columns.  A table of
        at most ``FEW`` groups is broadcast; of a larger one each row is copied
        per salt, so that a group with a third of all rows is in ``SALTS`` tasks."""
        if self.few:
            return self.rows.join(F.broadcast(per_group), "_t_group")
        return self.rows.join(per_group.withColumn("_t_salt", F.explode(F.array(*[F.lit(k) for k in range(SALTS)]))), KEY)

    def table(self, per_group: DataFrame, name: str) -> DataFrame:
        """Written in few files: it is small, and read once more per step."""
        return materialize(per_group.coalesce(self.files), name)

    def moments(self, near: DataFrame, weight: Column, *carried: str) -> DataFrame:
        """Scatter and location from weighted sums around the location before."""
        diff = [F.col(x) - F.col(f"_t_m{i}") for i, x in enumerate(X)]
        sums = near.groupBy(*ESTIMATE).agg(
            F.sum(weight).alias("_t_w"), *[F.first(c).alias(c) for c in ("_t_n", *carried, *[f"_t_m{i}" for i in range(D)])],
            *[F.sum(weight * d).alias(f"_t_a{i}") for i, d in enumerate(diff)],
            *[F.sum(weight * diff[i] * diff[j]).alias(f"_t_p{i}_{j}") for i, j in PAIRS],
        )
        mean = lambda c: F.col(c) / F.col("_t_w")
        cov = lambda i, j: mean(f"_t_p{i}_{j}") - mean(f"_t_a{i}") * mean(f"_t_a{j}")
        return sums.select(
            *ESTIMATE, "_t_n", *carried, *[(F.col(f"_t_m{i}") + mean(f"_t_a{i}")).alias(f"_t_m{i}") for i in range(D)],
            *[(CONSISTENCY * cov(i, j) + (TINY**2 if i == j else 0.0)).alias(f"_t_s{i}_{j}") for i, j in PAIRS],
        )


def _starts(groups: Groups) -> DataFrame:
    """The first estimate of each group from each of ``STARTS``."""
    rows = groups.rows
    n = F.count(F.lit(1)).alias("_t_n")
    mid = groups.table(rows.groupBy("_t_group").agg(n, *[F.percentile_approx(x, 0.5).alias(f"_t_m{i}") for i, x in enumerate(X)]), "mcd-medians")
    off = groups.meet(mid.drop("_t_n")).groupBy("_t_group").agg(
        *[F.percentile_approx(F.abs(F.col(x) - F.col(f"_t_m{i}")), 0.5).alias(f"_t_a{i}") for i, x in enumerate(X)]
    )
    medians = mid.join(off, "_t_group").withColumn("_t_start", F.lit(0))
    for i, j in PAIRS:
        own = F.pow(F.col(f"_t_a{i}") * 1.4826, 2) + TINY**2
        medians = medians.withColumn(f"_t_s{i}_{j}", own if i == j else F.lit(0.0))
    moments = groups.moments(groups.meet(mid.withColumn("_t_start", F.lit(1))), F.lit(1.0))
    return groups.table(_invert(medians).unionByName(_invert(moments)), "mcd-estimate")


def _concentrate(groups: Groups, estimate: DataFrame) -> DataFrame:
    """One step: the next estimates, with ``_t_before``, the log determinant
    before (that of a first estimate is not one of a half and counts as none)."""
    near = groups.meet(estimate).withColumn("_t_b", F.floor(F.log2(F.greatest(_distance(), F.lit(1e-12))) * FINE))
    counts = near.groupBy(*ESTIMATE, "_t_b").agg(F.count(F.lit(1)).alias("_t_c"), F.first("_t_n").alias("_t_n"))
    upto = Window.partitionBy(*ESTIMATE).orderBy("_t_b").rowsBetween(Window.unboundedPreceding, 0)
    half = F.ceil(F.col("_t_n") * SHARE)
    below = F.col("_t_upto") - F.col("_t_c")
    edge = counts.withColumn("_t_upto", F.sum("_t_c").over(upto)).where((below < half) & (half <= F.col("_t_upto")))
    edge = groups.table(edge.select(*ESTIMATE, F.col("_t_b").alias("_t_edge"), ((half - below) / F.col("_t_c")).alias("_t_part")), "mcd-edge")
    near = groups.meet(estimate.join(edge, ESTIMATE)).withColumn("_t_b", F.floor(F.log2(F.greatest(_distance(), F.lit(1e-12))) * FINE))
    weight = F.when(F.col("_t_b") < F.col("_t_edge"), 1.0).otherwise(F.col("_t_part"))
    sums = groups.moments(near.where("_t_b <= _t_edge"), weight, "_t_log")
    after = _invert(sums.drop("_t_log")).join(estimate.select(*ESTIMATE, F.col("_t_log").alias("_t_before")), ESTIMATE)
    after = groups.table(after, "mcd-estimate")
    discard(edge)
    return after


def estimates(rows: DataFrame) -> DataFrame:
    """The estimate of each ``_t_group``: of its starts, the one whose steps
    ended at the least determinant.  ``rows`` is a written table with
    ``_t_group``, ``_t_salt`` and the vector ``X``."""
    groups = Groups(rows, rows.select("_t_group").distinct().count())
    active = _starts(groups)
    done: DataFrame | None = None
    for step in range(STEPS):
        after = _concentrate(groups, active)
        discard(active)
        falls = (F.col("_t_log") < F.col("_t_before") - SETTLED) if step else F.lit(True)
        settled = groups.table(after.where(~falls).drop("_t_before"), "mcd-settled") if step else after.limit(0).drop("_t_before")
        active = groups.table(after.where(falls).drop("_t_before"), "mcd-estimate")
        discard(after)
        done = settled if done is None else done.unionByName(settled)
        if active.isEmpty():
            break
    done = done.unionByName(active)
    order = F.struct("_t_log", "_t_start")
    best = done.groupBy("_t_group").agg(F.min_by(F.struct(*[c for c in done.columns if c != "_t_group"]), order).alias("_t_e"))
    return best.select("_t_group", "_t_e.*").drop("_t_start")


def _used(estimate: DataFrame) -> DataFrame:
    return estimate.where((F.col("_t_n") >= LEAST) | (F.col("_t_group") == "*"))


def outliers(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", groups: tuple[str, ...] = ("lang", "source"),
             cut: float = CUT) -> DataFrame:
    """``statistics`` of each document with ``base_failed`` (fewer than 10
    words, or over a fifth of them in repeated windows), ``distance`` (squared,
    null where the base rule failed) and ``kept``.

    Null texts are empty and fail the base rule; null languages and sources are
    groups of their own.  Rows that fail the base rule give no estimate.
    """
    counted = materialize(
        statistics(docs, id_col, text_col, *groups).withColumn(
            "base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
        ),
        "outlier-statistics",
    )
    # from the finest group to the whole table; '' stands for null, a value gets a colon in front
    names = [F.coalesce(F.concat(F.lit(":"), F.col(g).cast("string")), F.lit("")) for g in groups]
    levels = [F.to_json(F.array(*names[: len(names) - k])) if k < len(names) else F.lit("*") for k in range(len(names) + 1)]
    rows = counted.where("not base_failed").select(
        F.explode(F.array(*levels)).alias("_t_group"), F.pmod("_t_row", F.lit(SALTS)).cast("int").alias("_t_salt"), *[x.alias(n) for x, n in zip(_vector(), X)],
        *_sampling(),
    )
    rows = materialize(rows, "mcd-rows")
    usable = materialize(_used(estimates(rows)).drop("_t_n", "_t_log"), "mcd-usable")
    known = usable.select(F.col("_t_group").alias("_t_g"))
    tagged = counted
    for k, level in enumerate(levels[:-1]):
        tagged = tagged.withColumn("_t_level", level).join(
            known.withColumnRenamed("_t_g", f"_t_g{k}"), F.col("_t_level") == F.col(f"_t_g{k}"), "left"
        ).drop("_t_level")
    chosen = F.coalesce(*[F.col(f"_t_g{k}") for k in range(len(levels) - 1)], F.lit("*"))
    for x, n in zip(_vector(), X):
        tagged = tagged.withColumn(n, F.when(~F.col("base_failed"), x))
    tagged = tagged.select("*", *_sampling())
    met = tagged.withColumn("_t_group", chosen).join(usable, "_t_group", "left")
    distance = F.when(~F.col("base_failed"), _distance(_floored()))
    return met.withColumn("distance", distance).select(
        F.col(id_col), "_t_row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance",
        (~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= cut)).alias("kept"),
    )
