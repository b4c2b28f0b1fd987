"""Which added spans stay, against a plain version, and the labelers' model
against a plain one."""

import math
import random
from collections import Counter

from pyspark.sql import functions as F

from tern.llm import pii
from tern.session import materialize

SPAN = "_t_doc long, kind string, start long, end long, base boolean"


def plain_settled(spans):
    base = [s for s in spans if s[3]]
    out, end = list(base), -1
    for k, a, b, _ in sorted((s for s in spans if not s[3]), key=lambda s: (s[1], s[2], s[0])):
        if a >= end and not any(x[1] < b and a < x[2] for x in base):
            out.append((k, a, b, False))
            end = b
    return sorted(out)


def test_added_spans_are_dropped_for_returned_ones_only(spark):
    rows = [(1, "card", 0, 10, True), (1, "card", 8, 20, False), (1, "phone", 18, 30, False),
            (2, "card", 5, 9, False), (2, "ip", 5, 9, False), (2, "phone", 8, 12, False), (2, "email", 12, 14, False)]
    got = {(r["_t_doc"], r.kind, r.start, r.end) for r in pii.settled(spark.createDataFrame(rows, SPAN)).collect()}
    assert got == {(1, "card", 0, 10), (1, "phone", 18, 30), (2, "card", 5, 9), (2, "email", 12, 14)}


def test_settled_equals_plain(spark):
    r = random.Random(4)
    of = {}
    for d in range(120):
        spans = set()
        for _ in range(r.randint(1, 14)):
            a = r.randint(0, 60)
            spans.add((r.choice(pii.KINDS), a, a + r.randint(1, 12), r.random() < 0.3))
        of[d] = sorted(spans)
    rows = [(d, *s) for d, spans in of.items() for s in spans]
    got: dict = {}
    for x in pii.settled(spark.createDataFrame(rows, SPAN).repartition(4)).collect():
        got.setdefault(x["_t_doc"], []).append((x.kind, x.start, x.end, x.base))
    for d, spans in of.items():
        assert sorted(got.get(d, [])) == plain_settled(spans), spans


def test_added_spans_equal_a_plain_classifier(spark):
    """The final classifier's answers, computed row by row in Python from the
    same votes and features."""
    r = random.Random(6)
    forms = ["mail a{0}@example.com", "write to b{0} (at) gmail (dot) com please", "card 4111 1111 1111 1111 ok", "visa 4111/1111/1111/1111 now",
             "call (212) 555-01{0}", "tel +1 212 555 01{0}", "order 1234.5678.9012.34{0}", "page 12 345 67{0} of", "host 8.8.{0}.8", "build 1.2.3.{0}"]
    of = {d: " and ".join(r.choice(forms).format(r.randint(10, 99)) for _ in range(r.randint(1, 6))) for d in range(400)}
    docs = spark.createDataFrame(list(of.items()), "doc_id long, text string")
    _, spans = pii.candidates(docs, "doc_id", "text")
    voted = materialize(pii.votes(spans), "test-votes")
    got = {(r["_t_doc"], r.kind, r.start, r.end) for r in pii.added(voted).collect()}
    rows = voted.withColumn("f", F.array(*pii._features())).collect()
    names = list(pii.LABELERS)
    key = lambda r: (r.kind, tuple(r[n] for n in names))
    chance, _ = pii.reliabilities([(k, v, n) for (k, v), n in Counter(map(key, rows)).items()])
    yes, no, all_yes, all_no = Counter(), Counter(), Counter(), Counter()
    for r in rows:
        p = chance[key(r)]
        all_yes[r.kind] += p
        all_no[r.kind] += 1 - p
        for f in r.f:
            yes[r.kind, f] += p
            no[r.kind, f] += 1 - p
    expect = set()
    for r in rows:
        if r.base or r.strict:
            continue
        w = math.log((all_yes[r.kind] + 1) / (all_no[r.kind] + 1))
        for f in r.f:
            w += math.log((yes[r.kind, f] + 1) / (all_yes[r.kind] + 1) * (all_no[r.kind] + 1) / (no[r.kind, f] + 1))
        if 1 / (1 + math.exp(-w)) >= pii.ACCEPT and chance[key(r)] >= 0.5:
            expect.add((r["_t_doc"], r.kind, r.start, r.end))
    assert got == expect and len(got) > 100 and {k for _, k, _, _ in got} == {"email", "card", "phone"}
