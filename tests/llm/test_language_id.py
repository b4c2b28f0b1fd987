"""Code lengths against a plain PPM, held-out accuracy, awkward rows."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tern.llm import language_id as lang
from tern.llm.queries import QUERIES

from .fixtures import awkward, awkward_rows, empty, table

TEN = "/root/testdata/sf0.1"


def plain_bits(train, test, order):
    """PPM, method C, exclusion of everything that longer contexts have seen."""
    counts: dict = {}
    symbols = lambda b: [256] * order + [*b, 256]
    for b in train:
        s = symbols(b)
        for i in range(order, len(s)):
            for o in range(order + 1):
                counts.setdefault(tuple(s[i - o : i]), Counter())[s[i]] += 1

    def cost(context, x):
        gone, out = set(), 0.0
        for o in range(order, -1, -1):
            seen = counts.get(tuple(context[order - o :]), {})
            left = {k: v for k, v in seen.items() if k not in gone}
            if left:
                whole = sum(left.values()) + (0 if o == 0 and len(counts[()]) == 257 else len(left))
                if x in left:
                    return out + math.log2(whole / left[x])
                out += math.log2(whole / len(left))
            gone |= set(seen)
        return out + math.log2(257 - len(gone))

    return [sum(cost(s[i - order : i], s[i]) for i in range(order, len(s))) for s in map(symbols, test)]


def tree(train, order):
    s, n = np.unique(lang.strings_of(train, order), return_counts=True)
    return lang.Tree(s, n, order)


@pytest.mark.parametrize("order", [1, 2, 4])
def test_code_lengths(order):
    r = random.Random(order)
    make = lambda letters, n: bytes(r.choice(letters) for _ in range(n))
    train = [make(b"abcab", r.randint(0, 60)) for _ in range(30)] + [b"", "né à la".encode() * 5]
    test = [make(b"abcabx", r.randint(0, 80)) for _ in range(40)] + [b"", b"zzz", "\u65e5\u672c".encode(), b"a", *train[:5]]
    languages = lang.Languages({"one": tree(train, order), "two": tree([make(b"xyz", 90)], order)})
    got = languages.lengths(test)
    assert np.allclose(got[:, 0], plain_bits(train, test, order))
    assert languages.names == ["one", "two"]


def test_every_symbol_seen():
    """The empty context has nothing to escape to."""
    train = [bytes(range(256)) * 2]
    test = [b"ab", bytes([7, 3, 9]), b""]
    assert np.allclose(lang.Languages({"x": tree(train, 2)}).lengths(test)[:, 0], plain_bits(train, test, 2))


def test_parts_of_long_texts(monkeypatch):
    """A text longer than a task looks at together costs the same."""
    r = random.Random(1)
    train = [bytes(r.choice(b"abcd") for _ in range(300)) for _ in range(4)]
    test = [bytes(r.choice(b"abcde") for _ in range(n)) for n in (10, 1000, 0, 63, 64, 65)]
    languages = lang.Languages({"x": tree(train, 4), "y": tree(train[:1], 4)})
    whole = languages.lengths(test)
    monkeypatch.setattr(lang, "AT_ONCE", 64)
    assert np.allclose(languages.lengths(test), whole)


def test_held_out_accuracy(spark):
    of = {d: v for d, v in table("documents", TEN)[["doc_id", "lang"]].itertuples(index=False)}
    got = {r.doc_id: r for r in QUERIES["op13_language"](spark, TEN).collect()}
    assert set(got) == set(of)
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) and 0 <= r.score <= 1 for d, r in got.items())
    out = [d for d in of if got[d].held_out]
    assert sum(got[d].lang_pred == of[d] for d in out) / len(out) > 0.995


def test_awkward_rows(spark):
    docs = awkward(spark)
    model = lang.fit(docs)
    assert model is not None and set(model.names) <= {r[2] for r in awkward_rows() if r[2]}
    got = lang.predict(spark, docs, model)
    assert set(got.columns) == set(docs.columns) | {"lang_pred", "score"}
    rows = got.collect()
    assert len(rows) == len(awkward_rows())
    for r in rows:
        letters = r.text is not None and any(c.isalpha() for c in r.text)
        assert r.lang_pred in model.names if letters else (r.lang_pred, r.score) == ("und", 0.0)
    nothing = lang.fit(empty(spark))
    assert nothing is None and lang.predict(spark, empty(spark), model).count() == 0
    assert {(r.lang_pred, r.score) for r in lang.predict(spark, docs, nothing).collect()} == {("und", 0.0)}


def test_sample_is_bounded_and_never_held_out(spark):
    """One language with nearly all rows, most of them equal; whole texts only."""
    rows = [(i, "the same words again", "en") for i in range(3000)] + [(5000 + i, f"der Satz {i}", "de") for i in range(40)]
    rows += [(9000, "x" * 5000, "de"), (9001, None, "de"), (9002, "no language", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = lang.sample(docs, rows=25, size=400).collect()
    by = Counter(r.lang for r in got)
    assert 0 < by["en"] <= 25 and 0 < by["de"] <= 25 and set(by) == {"en", "de"}
    texts = {t for _, t, _ in rows if t}
    assert all(r.t in texts and len(r.t) < 400 for r in got)
    for k in by:
        assert sum(len(r.t.encode()) for r in got if r.lang == k) <= 400
    learned = {t for i, t, _ in rows if t and zlib.crc32(str(i).encode()) % 4 != 2}
    assert all(r.t in learned for r in got)
