"""Personal data by weak-supervision aggregation, in DataFrame functions only.

Base spans are what four patterns find (email, ip, card, phone), after their
checks.  Wider patterns give further candidates.  Regex, gazetteer, context and
shape labelers vote on every candidate (for, against or not at all); the votes
are counted by pattern of votes, a table whose size is that of the patterns.
Expectation maximisation on those counts estimates how reliable each labeler
is, and so how likely each pattern is to be personal data.  With these
probabilities as labels a final classifier, naive Bayes over the span's shape
and surroundings, is trained from sums by feature value; candidates that it
accepts and that overlap no base span are added.

Positions come without a Python function: splitting a text at a pattern gives
the pieces between its matches, whose lengths, summed along the document,
place every match.  The possessive patterns find the same matches as the
greedy ones but take time in proportion to the text: a match starts where a
run of its characters starts, or where the match before ended.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tern.llm.common import need, row_key, text_of
from tern.session import materialize

KINDS = ("email", "ip", "card", "phone")
AROUND = 32  # characters kept on each side of a candidate

_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_AT, _DOT = r"(?:\x20?[\[(]at[\])]\x20?)", r"(?:\x20?[\[(]dot[\])]\x20?|\.)"
WIDER = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++{_AT}{_LABEL}++(?:{_DOT}{_LABEL}++)++",
    "card": r"(?:\G|(?<![0-9]))[0-9]{4}+(?:[.\x20_/-][0-9]{4}+){3}(?![0-9])",
    "phone": r"(?:\G|(?<![0-9]))(?:\([0-9]{2,4}+\)|[0-9]{2,4}+)[\x20./-][0-9]{3,4}+[\x20./-][0-9]{3,4}+(?![0-9])",
}
MARKS = {"email": "@|[\\[(]at[\\])]", "ip": "[0-9]", "card": "[0-9]", "phone": "[0-9]"}

# fixed values: what stands in front of personal data, and of other numbers
CUES = {
    "email": ("mail", "e-mail", "email", "contact", "write", "correo", "courriel", "kontakt"),
    "ip": ("ip", "host", "address", "server", "from", "client"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "carte", "tarjeta", "karte"),
    "phone": ("phone", "tel", "call", "fax", "mobile", "cell", "telefon", "telefono", "appelez"),
}
AGAINST = ("version", "isbn", "issn", "doi", "section", "chapter", "page", "token", "order", "invoice", "no.", "id", "part", "build")
DOMAINS = ("example", "gmail", "yahoo", "outlook", "hotmail", "mail", "gmx", "icloud", "proton")
PRIVATE = r"^(?:0|10|127|255)\.|^192\.168\.|^172\.(?:1[6-9]|2[0-9]|3[01])\."
ACCEPT, ROUNDS = 0.95, 30
LABELERS = ("pattern", "checksum", "gazetteer", "cue", "other_number", "edges")


# ------------------------------------------------------------------ candidates


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _matches(text: Column, kind: str, pattern: str, strict: bool) -> Column:
    """Matches in order: the length of the piece before, the match, and what
    stands around it."""
    found = _let(
        F.split(text, pattern, -1),
        lambda gaps: F.transform(
            F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
            lambda hit, i: F.struct(
                F.lit(kind).alias("kind"),
                F.lit(strict).alias("strict"),
                i.alias("n"),
                F.length(F.get(gaps, i)).cast("long").alias("gap"),
                hit.alias("hit"),
                F.right(F.get(gaps, i), F.lit(AROUND)).alias("left"),
                F.left(F.get(gaps, i + 1), F.lit(AROUND)).alias("right"),
            ),
        ),
    )
    empty = F.array().cast("array<struct<kind:string,strict:boolean,n:int,gap:bigint,hit:string,left:string,right:string>>")
    return F.when(text.rlike(MARKS[kind]), found).otherwise(empty)


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    doubled = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    each = F.transform(
        F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 1, doubled(c.cast("int"))).otherwise(c.cast("int"))
    )
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _passes(kind: Column, hit: Column) -> Column:
    """The checks of a base match."""
    digits = _digits(hit)
    n = F.length(digits)
    small = F.forall(F.split(hit, r"\."), lambda p: p.rlike("^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})$"))
    return (
        F.when(kind == "email", F.lit(True))
        .when(kind == "ip", small)
        .when(kind == "card", F.when(n.between(13, 19), luhn(digits)).otherwise(F.lit(False)))
        .otherwise(n.between(9, 15))
    )


def candidates(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """All documents (``_t_doc`` names the row) and all candidates with their
    place: ``_t_doc``, kind, strict, start, end, hit, left, right, base."""
    text = F.col("_t_text")
    rows = docs.select(F.col(id_col), row_key(docs).alias("_t_row"), text_of(text_col).alias("_t_text"))
    found = F.concat(*[_matches(text, k, p, True) for k, p in BASE.items()], *[_matches(text, k, p, False) for k, p in WIDER.items()])
    named = materialize(
        rows.select(F.col(id_col), "_t_row", F.monotonically_increasing_id().alias("_t_doc"), found.alias("_t_found")), "pii-found"
    )
    along = Window.partitionBy("_t_doc", "kind", "strict").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    each = named.select("_t_doc", F.explode("_t_found").alias("f")).select("_t_doc", "f.*")
    end = F.sum(F.col("gap") + F.length("hit")).over(along)
    placed = each.withColumn("end", end).withColumn("start", F.col("end") - F.length("hit"))
    return named, placed.withColumn("base", F.col("strict") & _passes(F.col("kind"), F.col("hit"))).drop("n", "gap")


# -------------------------------------------------------------------- labelers


def _any_word(text: Column, words: tuple[str, ...]) -> Column:
    lowered = F.lower(text)
    return reduce(lambda a, b: a | b, [lowered.contains(w) for w in words])


def _by_kind(kind: Column, values: dict) -> Column:
    out = F.when(kind == KINDS[0], values[KINDS[0]])
    for k in KINDS[1:]:
        out = out.when(kind == k, values[k])
    return out


def votes(spans: DataFrame) -> DataFrame:
    """Adds one column per labeler: 1 for, -1 against, 0 no vote."""
    kind, hit, left, right = F.col("kind"), F.col("hit"), F.col("left"), F.col("right")
    n = F.length(_digits(hit))
    long_number = n.between(13, 19)
    vote = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0)
    no = F.lit(False)
    return spans.select(
        "*",
        vote(F.col("base"), F.col("strict")).alias("pattern"),
        F.when(long_number & kind.isin("card", "phone"), F.when(luhn(_digits(hit)), 1).otherwise(-1)).otherwise(0).alias("checksum"),
        _by_kind(kind, {
            "email": vote(_any_word(hit, DOMAINS), no),
            "ip": vote(no, hit.rlike(PRIVATE)),
            "card": vote(hit.rlike("^[3-6]"), hit.rlike("^0")),
            "phone": vote(hit.rlike(r"^\+[1-9]") | hit.rlike(r"^\("), hit.rlike("^0000")),
        }).alias("gazetteer"),
        vote(_by_kind(kind, {k: _any_word(left, v) for k, v in CUES.items()}), no).alias("cue"),
        vote(no, _any_word(F.right(left, F.lit(14)), AGAINST)).alias("other_number"),
        vote(no, left.rlike(r"[A-Za-z0-9_.=#/]$") | right.rlike(r"^[A-Za-z0-9_/%]")).alias("edges"),
    )


def reliabilities(counts: list[tuple]) -> tuple[dict, dict]:
    """Expectation maximisation over (kind, votes, number): the probability of
    each (kind, votes), and each labeler's rate of each vote by class.

    Votes are independent given the class; the start trusts every labeler
    alike, which settles which class is which.
    """
    m = len(LABELERS)
    rate = [{(c, v): (0.6 if v == (1 if c else -1) else 0.1 if v == -(1 if c else -1) else 0.3) for c in (0, 1) for v in (-1, 0, 1)} for _ in range(m)]
    prior = dict.fromkeys(KINDS, 0.5)
    chance: dict[tuple, float] = {}
    for _ in range(ROUNDS):
        for kind, vs, _n in counts:
            logs = [math.log(p) + sum(math.log(rate[i][(c, v)]) for i, v in enumerate(vs)) for c, p in ((0, 1 - prior[kind]), (1, prior[kind]))]
            chance[(kind, vs)] = 1 / (1 + math.exp(min(logs[0] - logs[1], 700)))
        for k in KINDS:
            mine = [(chance[(kind, vs)], n) for kind, vs, n in counts if kind == k]
            prior[k] = (sum(p * n for p, n in mine) + 1) / (sum(n for _, n in mine) + 2)
        for i in range(m):
            for c in (0, 1):
                held = {v: 1.0 for v in (-1, 0, 1)}
                for kind, vs, n in counts:
                    p = chance[(kind, vs)]
                    held[vs[i]] += n * (p if c else 1 - p)
                total = sum(held.values())
                for v in held:
                    rate[i][(c, v)] = held[v] / total
    return chance, {LABELERS[i]: r for i, r in enumerate(rate)}


# ------------------------------------------------------------ final classifier


def _features() -> list[Column]:
    """Categories of a span (few values each), for the final classifier."""
    hit, left, right = F.col("hit"), F.col("left"), F.col("right")
    shape = F.regexp_replace(F.regexp_replace(hit, "[0-9]+", "9"), "[A-Za-z]+", "a")
    last = F.lower(F.regexp_extract(left, r"([A-Za-z]+)[^A-Za-z0-9]*$", 1))
    cue = F.when(_by_kind(F.col("kind"), {k: _any_word(last, v) for k, v in CUES.items()}), "cue").when(_any_word(last, AGAINST), "other").otherwise("none")
    return [
        F.concat(F.lit("shape:"), F.left(shape, F.lit(12))),
        F.concat(F.lit("digits:"), F.least(F.length(_digits(hit)), F.lit(20)).cast("string")),
        F.concat(F.lit("word:"), cue),
        F.concat(F.lit("before:"), F.when(left == "", "start").when(left.rlike(r"\s$"), "space").when(left.rlike("[A-Za-z0-9]$"), "word").otherwise("mark")),
        F.concat(F.lit("after:"), F.when(right == "", "end").when(right.rlike(r"^\s"), "space").when(right.rlike("^[A-Za-z0-9]"), "word").otherwise("mark")),
    ]


def added(voted: DataFrame) -> DataFrame:
    """Candidates beyond the base spans that the final classifier accepts.

    The classifier's table has a row per kind and feature value and is joined,
    so its size does not matter; the patterns of votes are at most ``3`` to the
    number of labelers for each kind.
    """
    spark = voted.sparkSession
    names = list(LABELERS)
    counts = [(r["kind"], tuple(r[n] for n in names), r["count"]) for r in voted.groupBy("kind", *names).count().collect()]
    empty = voted.select("_t_doc", "kind", "start", "end").limit(0)
    if not any(n for _, _, n in counts):
        return empty
    chance, _ = reliabilities(counts)
    table = spark.createDataFrame([(k, *vs, p) for (k, vs), p in chance.items()], "kind string, " + ", ".join(f"{n} int" for n in names) + ", p double")
    soft = voted.join(table, ["kind", *names]).withColumn("f", F.array(*_features()))
    sums = soft.select("kind", "p", F.explode("f").alias("v")).groupBy("kind", "v").agg(
        (F.sum("p") + 1).alias("yes"), (F.sum(1 - F.col("p")) + 1).alias("no")
    )
    whole = soft.groupBy("kind").agg((F.sum("p") + 1).alias("all_yes"), (F.sum(1 - F.col("p")) + 1).alias("all_no"))
    weights = materialize(
        sums.join(whole, "kind").select("kind", "v", F.log(F.col("yes") / F.col("all_yes") * F.col("all_no") / F.col("no")).alias("w")), "pii-weights"
    )
    whole = materialize(whole.select("kind", F.log(F.col("all_yes") / F.col("all_no")).alias("w0")), "pii-prior")
    open_ = soft.where(~F.col("base") & ~F.col("strict"))
    scored = (
        open_.select("_t_doc", "kind", "start", "end", "p", F.explode("f").alias("v"))
        .join(weights, ["kind", "v"])
        .groupBy("_t_doc", "kind", "start", "end", "p")
        .agg(F.sum("w").alias("w"))
        .join(whole, "kind")
    )
    likely = 1 / (1 + F.exp(-(F.col("w") + F.col("w0"))))
    return scored.where((likely >= ACCEPT) & (F.col("p") >= 0.5)).select("_t_doc", "kind", "start", "end")


def settled(spans: DataFrame) -> DataFrame:
    """``spans`` (``_t_doc``, ``kind``, ``start``, ``end``, ``base``) without the
    added ones that overlap a base span, whatever its kind, and of the others
    without those that overlap an added span that starts before and stays (of
    spans with one start the shortest goes first, then by kind).

    Added spans that overlap in a chain are an island; within one they are
    taken in their order, so a span is dropped only for one that is returned.
    """
    whole = Window.partitionBy("_t_doc")
    ours = lambda c: F.when(F.col("base"), F.col(c))
    upto = whole.orderBy("start", F.col("base").desc()).rowsBetween(Window.unboundedPreceding, 0)
    onward = whole.orderBy(F.col("start").desc(), F.col("base").desc()).rowsBetween(Window.unboundedPreceding, 0)
    near = spans.withColumn("_t_l", F.max(ours("end")).over(upto)).withColumn("_t_r", F.min(ours("start")).over(onward))
    free = (F.coalesce("_t_l", F.lit(-1)) <= F.col("start")) & (F.col("_t_r").isNull() | (F.col("_t_r") >= F.col("end")))
    extra = near.where(~F.col("base") & free).select("_t_doc", "kind", "start", "end")
    order = whole.orderBy("start", "end", "kind")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    extra = extra.withColumn("_t_new", (F.coalesce(reach, F.lit(-1)) <= F.col("start")).cast("int"))
    extra = extra.withColumn("_t_island", F.sum("_t_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    island = extra.groupBy("_t_doc", "_t_island").agg(F.sort_array(F.collect_list(F.struct("start", "end", "kind"))).alias("s"))
    first = F.struct(F.slice("s", 1, 1).alias("kept"), F.col("s")[0]["end"].alias("end"))
    taken = F.aggregate(
        F.slice("s", 2, F.size("s")), first,
        lambda a, x: F.when(x["start"] < a["end"], a).otherwise(F.struct(F.concat(a["kept"], F.array(x)).alias("kept"), x["end"].alias("end"))),
        lambda a: a["kept"],
    )
    kept = island.select("_t_doc", F.explode(taken).alias("x")).select("_t_doc", "x.kind", "x.start", "x.end", F.lit(False).alias("base"))
    return spans.where("base").select("_t_doc", "kind", "start", "end", "base").unionByName(kept)


# -------------------------------------------------------------------- operator


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id_col``, ``_t_row`` and ``found``, an array of
    (kind number, start, end, base) in the order of kind and start; offsets in
    code points, the end exclusive.

    Null and empty texts have no spans.  Base spans of one kind never overlap;
    an added span overlaps no base span of its document, whatever its kind, and
    no other added span that is returned.
    """
    need(docs, id_col, text_col)
    named, spans = candidates(docs, id_col, text_col)
    voted = materialize(votes(spans), "pii-votes")
    base = voted.where("base").select("_t_doc", "kind", "start", "end")
    more = added(voted).withColumn("base", F.lit(False)).unionByName(base.withColumn("base", F.lit(True)))
    clear = settled(materialize(more, "pii-spans"))
    number = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int")
    per_doc = clear.groupBy("_t_doc").agg(
        F.sort_array(F.collect_list(F.struct(number.alias("k"), "start", "end", "base"))).alias("found")
    )
    none = F.array().cast("array<struct<k:int,start:bigint,end:bigint,base:boolean>>")
    return named.select(F.col(id_col), "_t_row", "_t_doc").join(per_doc, "_t_doc", "left").select(
        F.col(id_col), "_t_row", F.coalesce("found", none).alias("found")
    )


def joined(found: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(found, lambda s: F.concat_ws(":", F.element_at(kinds, s["k"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )
