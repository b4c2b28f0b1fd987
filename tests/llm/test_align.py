"""The alignment against a plain version that uses the tokenizers' own
libraries on whole documents."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tern.llm import align
from tern.llm.queries import QUERIES

from .fixtures import awkward, awkward_rows, empty, texts

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def plain(of):
    """Per key: n_a, n_b, n_groups, n_links, n_best, count_sum, groups."""
    ta, tb = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    ta.encode_special_tokens = True
    letters = {**{chr(b): b for b in [*range(33, 127), *range(161, 173), *range(174, 256)]}}
    letters |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if chr(b) not in letters)}
    entry = {i: bytes(letters[c] for c in s) for s, i in ta.get_vocab(with_added_tokens=False).items() if all(c in letters for c in s)}
    piece = lambda i: bytes([int(tb.id_to_piece(i)[3:5], 16)]) if tb.is_byte(i) else tb.id_to_piece(i).replace("\u2581", " ").encode()
    links, groups = {}, {}
    for k, text in of.items():
        links[k], groups[k] = [], []
        if not text:
            continue
        a = [(i, entry[i]) for i in ta.encode(" " + text, add_special_tokens=False).ids]
        b = [(i, piece(i)) for i in tb.encode(text)]
        if any(b"".join(x for _, x in s) != (" " + text).encode() for s in (a, b)):
            continue
        i = j = at_a = at_b = 0
        ga, gb = [], []
        while i < len(a) or j < len(b):
            if at_a <= at_b and i < len(a):
                ga.append(a[i][0])
                start, at_a, i = at_a, at_a + len(a[i][1]), i + 1
            else:
                gb.append(b[j][0])
                at_b, j = at_b + len(b[j][1]), j + 1
            if at_a == at_b:
                groups[k].append((ga, gb))
                ga, gb = [], []
        spans = lambda s: [(x, e - len(r), e) for (x, r), e in zip(s, np.cumsum([len(r) for _, r in s]).tolist())]
        sa, sb = spans(a), spans(b)
        first = 0
        for x, s, e in sa:
            while sb[first][2] <= s:
                first += 1
            q = first
            while q < len(sb) and sb[q][1] < e:
                links[k].append((x, sb[q][0]))
                q += 1
    count = Counter(p for v in links.values() for p in v)
    most: dict = defaultdict(int)
    for (_, y), n in count.items():
        most[y] = max(most[y], n)
    out = {}
    for k in of:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups[k])
        out[k] = (sum(len(x) for x, _ in groups[k]), sum(len(y) for _, y in groups[k]), len(groups[k]), len(links[k]),
                  sum(count[p] == most[p[1]] for p in links[k]), sum(count[p] for p in links[k]), text)
    return out


def values(r):
    return (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum)


def test_query(spark):
    got = {r.doc_id: r for r in QUERIES["op12_align"](spark, "/root/testdata/sf0.001").collect()}
    expect = plain(texts())
    assert set(got) == set(expect)
    for d, r in got.items():
        assert values(r) == expect[d][:6]
        assert r.groups_sha256 == (hashlib.sha256(expect[d][6].encode()).hexdigest() if r.n_a else "")


ODD = ["a", "b", " ", "  ", "\n", "\u00e9", "\U0001f600", "<|endoftext|>", "9", "'s", "'", "-", "\u0301", "\u00df", "\x85", "\u200b", "\x00", "aaaa", "\u3000",
       "\u65e5\u672c\u8a9e", "\u2581", "<0x41>", "<s>", "<unk>", "The", " quick", "\t", "qx", "\ud55c"]


@pytest.mark.parametrize("chunk, fanin", [(1 << 16, 16), (23, 2), (64, 3)])
def test_odd_texts_in_any_ranges(spark, monkeypatch, chunk, fanin):
    """Texts that the piece vocabulary cannot give back, long runs without a
    cut, and documents of many ranges, composed in several rounds."""
    monkeypatch.setattr(align, "CHUNK", chunk)
    monkeypatch.setattr(align, "FANIN", fanin)
    r = random.Random(chunk)
    of = {i: "".join(r.choice(ODD) for _ in range(r.randint(0, 90))) for i in range(150)}
    of |= {200: "a" * 700, 201: " " * 500, 202: " ", 203: "x", 204: None, 205: "", 206: "\u65e5\u672c" * 200, 207: " ".join(["word"] * 150), 208: "tail  "}
    docs = spark.createDataFrame(list(of.items()), "doc_id long, text string").repartition(3)
    expect = plain(of)
    assert any(not expect[i][0] and of[i] for i in of) and any(expect[i][0] for i in of)
    rows = align.align(spark, docs, A, B).collect()
    assert len(rows) == len(of)
    for row in rows:
        assert values(row) == expect[row.doc_id][:6] and row.groups == expect[row.doc_id][6]


def test_awkward_rows(spark):
    """Null ids, repeated rows (each counts), clashing names, an empty table."""
    rows = align.align(spark, awkward(spark), A, B, with_groups=False).collect()
    expect = plain(dict(enumerate(r[1] for r in awkward_rows())))
    assert Counter((r.doc_id, *values(r)) for r in rows) == Counter((r[0], *expect[i][:6]) for i, r in enumerate(awkward_rows()))
    assert align.align(spark, empty(spark), A, B).count() == 0
    with pytest.raises(ValueError):
        align.load(public_tokenizers.path("word_bpe_49k.json"), B)


def test_composition_is_associative():
    t = align.Tokenizers(*align.load(A, B))
    r = random.Random(8)
    for _ in range(40):
        raw = (" " + "".join(r.choice(ODD[:20]) for _ in range(80))).encode()
        cut, parts = (0, 0), []
        for at in [*sorted(r.sample(range(1, len(raw)), 6)), len(raw)]:
            to = max(cut, t.cuts(raw, at))
            to = (max(cut[0], to[0]), max(cut[1], to[1]))
            i, j, same = t.encode([raw[cut[0] : to[0]]], [raw[cut[1] : to[1]]])[0]
            assert same
            parts.append(align.Fragment.of(t, align.Open(i, cut[0] + np.cumsum(t.a_size[i]), j, cut[1] + np.cumsum(t.b_size[j]))))
            cut = to
        results = set()
        for _ in range(4):
            left = list(parts)
            while len(left) > 1:
                k = r.randrange(len(left) - 1)
                left[k : k + 2] = [align.Fragment.unpack(left[k].then(t, left[k + 1]).pack())]
            c = left[0].whole(t)
            results.add((c.n_a, c.n_b, c.n_groups, b"".join(c.text), np.concatenate(c.links).tobytes()))
        assert len(results) == 1
