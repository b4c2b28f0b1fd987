"""Cases in which an operator once did less than the whole job."""

import random

from tern.llm import outliers, simhash, suffix_dedup

from .fixtures import awkward


def test_unrelated_texts_of_one_id_stay(spark):
    """Components are told apart by their root: texts without an id, or with
    the same one, are not one group."""
    left = [(r.doc_id, r.text) for r in simhash.near_dedup(spark, awkward(spark)).collect()]
    assert {t for d, t in left if d == 16} == {"twice", "not the same"} and len([1 for d, _ in left if d == 16]) == 2
    words = "red green blue lake hill road bird tree wind sand".split()
    docs = spark.createDataFrame([(None, f"{a} {b} stands for itself and nothing else {a}{b}") for a in words for b in words], "doc_id long, text string")
    groups = {r._t_root for r in simhash.near_groups(spark, docs).collect()}
    assert len(groups) > 90 and simhash.near_dedup(spark, docs).count() == len(groups)


def test_repeated_lines_alone_reject(spark):
    """Also where two fifths of a group are such texts; one repeated line does
    not, and neither do rows without words divide by zero."""
    r = random.Random(3)
    word = lambda: "".join(r.choice("etaoinshrdlu") for _ in range(r.randint(3, 8)))
    line = lambda: " ".join(word() for _ in range(9))
    rows, junk, one = [], set(), set()
    for d in range(500):
        lines = [line() for _ in range(30)]
        if d % 5 < 2:
            junk.add(d)
            lines = [x for y in lines for x in (y, "went there")]
        elif d % 50 == 4:
            one.add(d)
            lines.insert(7, "went there")
            lines.append("went there")
        rows.append((d, "\n".join(lines), "en", "web"))
    rows += [(1000, "", "en", "web"), (1001, None, None, None)]
    got = {x.doc_id: x for x in outliers.outliers(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not any(got[d].base_failed or got[d].kept for d in junk)
    assert all(got[d].kept for d in one) and not got[1000].kept and not got[1001].kept
    clean = set(range(500)) - junk - one
    assert sum(got[d].kept for d in clean) > 0.98 * len(clean)


def test_blocks_of_regrouped_input(spark, monkeypatch):
    """A source that deals out its rows otherwise each time it is read."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(suffix_dedup, "BLOCK", 1 << 14)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    plain = suffix_dedup.remove_repeats(spark, docs, with_bytes=False).drop("_t_row").collect()
    moving = docs.repartition(5, F.rand())
    again = suffix_dedup.remove_repeats(spark, moving, with_bytes=False).drop("_t_row").collect()
    assert sorted(plain) == sorted(again) and sum(r.n_removed for r in plain) > 0


def test_ranges_of_anchors_are_even():
    """An anchor is the smallest hash of many, so by the hash itself the first
    range would hold a sixth of all."""
    import numpy as np

    r = np.random.default_rng(0)
    block = suffix_dedup.Block([bytes(r.integers(97, 123, 400_000, dtype=np.uint8))], 20)
    sizes = np.diff(block.edge)
    assert sizes.sum() > 10_000 and sizes.max() < 1.3 * sizes.mean()
