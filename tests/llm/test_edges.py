"""Every operator on awkward rows and on an empty table: no crash, and the
results that the docstrings define."""

import hashlib

import public_tokenizers
import pytest

from tern.llm import bpe, exact_dedup, kd_shards, mixing, outliers, pii, ppm, quality_cnn, simhash, suffix_dedup

from .fixtures import awkward, awkward_rows, empty

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
N = len(awkward_rows())


def test_mixing(spark):
    docs = awkward(spark)
    rows = mixing.mix_decisions(docs).collect()
    assert len(rows) == N and all(0 <= r.copies <= 2 for r in rows)
    by = {r.doc_id: r for r in rows if r.doc_id}
    assert by[4].size == by[5].size == by[6].size == 0 and by[8].size == 2
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in rows)
    assert mixing.mix(empty(spark)).count() == 0 and mixing.mix_decisions(empty(spark)).count() == 0


def test_quality(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert isinstance(quality_cnn.fit(docs, labels), float)  # one class only: a constant
    kept = quality_cnn.keep_good(spark, docs, labels, least=0.0)
    assert kept.columns == docs.columns and kept.count() == N
    more = spark.createDataFrame([(d, d % 2, 0) for d in (1, 2, 3, 7, 8, 9, 11, 12, 13, 14)], "doc_id long, quality int, toxic int")
    net = quality_cnn.fit(docs, more)
    scores = [r.score for r in quality_cnn.score(spark, docs, net).collect()]
    assert len(scores) == N and all(0 <= s <= 1 for s in scores)
    assert quality_cnn.keep_good(spark, empty(spark), more).count() == 0


def test_exact(spark):
    docs = awkward(spark)
    rows = exact_dedup.membership(docs).collect()
    assert len(rows) == N
    by = {(r.doc_id, r._t_row): r for r in rows}
    find = lambda d: [r for r in rows if r.doc_id == d]
    assert find(2)[0].keep_id == 1 and not find(2)[0]._t_kept and find(3)[0]._t_kept
    assert find(4)[0].group_size == 2 and find(5)[0].keep_id == 4 and find(6)[0]._t_kept  # one space is not empty
    assert len(by) == N - 1  # one row is repeated in every column
    nulls = find(None)
    assert len(nulls) == 2 and all(r.keep_id is None and r.group_size == 2 for r in nulls) and sum(r._t_kept for r in nulls) == 1
    out = exact_dedup.exact_dedup(docs)
    assert out.columns == docs.columns
    left = [(r.doc_id, r.text) for r in out.collect()]
    assert len(left) == len(set(left)) == N - 1 - 1 - 1 - 1  # texts 2, 5, one null id, one repeated row
    assert exact_dedup.exact_dedup(empty(spark)).count() == 0


def test_exact_with_digest_collisions(spark, monkeypatch):
    """All digests alike: the content alone decides."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(exact_dedup.F, "sha2", lambda c, n: F.lit("00"), raising=True)
    try:
        rows = exact_dedup.membership(awkward(spark)).collect()
    finally:
        monkeypatch.undo()
    assert sorted((r.doc_id or 0, r.keep_id or 0, r.group_size) for r in rows) == sorted(
        (r.doc_id or 0, r.keep_id or 0, r.group_size) for r in exact_dedup.membership(awkward(spark)).collect()
    )


def test_pii(spark):
    rows = {r.doc_id: r for r in pii.personal_data(awkward(spark)).collect() if r.doc_id == 17 or r.doc_id == 4}
    text = next(r[1] for r in awkward_rows() if r[0] == 17)
    got = {(pii.KINDS[s.k - 1], text[s.start : s.end]) for s in rows[17].found if s.base}
    assert got == {("phone", "+1 (212) 555-0100"), ("email", "a.b@c-d.org"), ("card", "4111 1111 1111 1111"), ("ip", "10.0.0.255"), ("ip", "1.2.3.4")}
    assert rows[4].found == []
    assert pii.personal_data(awkward(spark)).count() == N and pii.personal_data(empty(spark)).count() == 0


def test_shards(spark):
    rows = kd_shards.kd_shards(awkward(spark), 4).collect()
    assert len(rows) == N
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert next(r for r in rows if r.doc_id == 4).size == 1 and next(r for r in rows if r.doc_id == 4).text_crc32 == 0
    assert kd_shards.kd_shards(empty(spark)).count() == 0 and {r.shard for r in kd_shards.kd_shards(awkward(spark), 1).collect()} == {0}


def test_rules(spark):
    rows = {r.doc_id: r for r in outliers.outliers(awkward(spark)).collect()}
    assert rows[4].n_words == 0 and rows[4].base_failed and not rows[4].kept
    assert rows[13].base_failed and rows[14].n_dup_lines == 2 and rows[1].kept
    assert outliers.outliers(empty(spark)).count() == 0


def test_simhash(spark):
    docs = awkward(spark)
    rows = simhash.near_groups(spark, docs).collect()
    assert len(rows) == N
    by = {r.doc_id: r for r in rows}
    assert by[2].component_id == by[3].component_id == 1 and by[5].component_id == by[6].component_id == 4 and by[4]._t_fp == 0
    out = simhash.near_dedup(spark, docs)
    assert out.columns == docs.columns and out.count() == len({r._t_root for r in rows})
    assert {r.text for r in out.where("doc_id = 16").collect()} == {"twice", "not the same"}
    assert simhash.near_dedup(spark, empty(spark)).count() == 0


def test_suffix(spark):
    rows = suffix_dedup.remove_repeats(spark, awkward(spark)).collect()
    assert len(rows) == N
    by = {r.doc_id: r for r in rows}
    assert by[10].n_removed > 400000 and by[12].n_spans == 1 and by[12].n_bytes - by[12].n_removed == 1
    assert by[4].n_bytes == 0 and by[4].kept_sha256 == hashlib.sha256(b"").hexdigest()
    assert suffix_dedup.remove_repeats(spark, empty(spark)).count() == 0


def test_lm(spark):
    rows = ppm.lm_scores(spark, awkward(spark)).collect()
    assert len(rows) == N and all(r.score < 0 and r.base_score < 0 for r in rows)
    by = {r.doc_id: r for r in rows}
    assert by[4].n_tokens == by[5].n_tokens == by[6].n_tokens == 1 and by[4].score == by[5].score
    assert ppm.lm_scores(spark, empty(spark)).count() == 0


def test_bpe(spark):
    docs = awkward(spark)
    out = bpe.decoded(spark, bpe.with_tokens(spark, docs, VOCABULARY), VOCABULARY)
    for r in out.collect():
        assert r.decoded == (r.text or "")
    assert bpe.digests(spark, docs, VOCABULARY).count() == N and bpe.with_tokens(spark, empty(spark), VOCABULARY).count() == 0
    with pytest.raises(ValueError):
        bpe.load(public_tokenizers.path("word_bpe_49k.json"))
