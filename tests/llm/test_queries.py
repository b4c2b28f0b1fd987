"""Each operator's query against SQL or a plain version on sf0.001."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from tern.llm import mixing, outliers, pii, ppm, quality_cnn, simhash, suffix_dedup
from tern.llm.queries import ORACLES, QUERIES
from tern.plans.verify import duck_connection, rows_of_duck, rows_of_spark

from .fixtures import SF, table, texts

WORD = r"[^\x20\x09-\x0D]+"
sha = lambda b: hashlib.sha256(b).hexdigest()


def run(spark, name, sf=SF):
    return {r.doc_id: r for r in QUERIES[name](spark, sf).collect()}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    cols, rows = rows_of_spark(QUERIES[name](spark, SF))
    other, expect = rows_of_duck(duck_connection(SF), ORACLES[name])
    assert cols == other and Counter(rows) == Counter(expect)


def test_mixing_meets_the_targets(spark):
    got = run(spark, "op1_mixing", "/root/testdata/sf0.01").values()
    per: dict = {}
    of = {d: s for d, s in table("documents", "/root/testdata/sf0.01")[["doc_id", "source"]].itertuples(index=False)}
    for r in got:
        p = per.setdefault(of[r.doc_id], [0, r.target, 0, r.source_size])
        p[0], p[2] = p[0] + r.taken, max(p[2], r.size)
        assert r.taken in (0, r.size, 2 * r.size)
    assert all(abs(taken - target) <= largest for taken, target, largest, _ in per.values())
    assert math.isclose(sum(p[1] for p in per.values()), 1.5 * sum(p[3] for p in per.values()), rel_tol=1e-9)
    assert all(p[1] <= 2 * p[3] + 1e-6 for p in per.values())


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    got = run(spark, "op2_quality_cnn", sf)
    labels = [(d, q) for d, q in table("labels", sf)[["doc_id", "quality"]].itertuples(index=False) if zlib.crc32(str(d).encode()) % 4 == 2]
    assert len(labels) > 500
    assert sum(got[d].predicted == q for d, q in labels) / len(labels) > 0.97
    good = [got[d].predicted for d, q in labels if q == 1]
    assert sum(good) / len(good) > 0.985
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) and r.predicted == (r.score >= 0.7) for d, r in got.items())


def test_network_reads_the_whole_text():
    net = quality_cnn.Network(3)
    t = net.tables()
    r = np.random.default_rng(0)
    raws = [bytes(r.integers(0, 256, n, dtype=np.uint8)) for n in (0, 1, 100, 128, 129, 5000, 700_000)]
    one = [net.probability([x], t)[0] for x in raws]
    assert np.allclose(net.probability(raws, t), one)
    for raw, p in zip(raws, one):  # plain convolution, chunk by chunk
        data = quality_cnn.blocks_of(raw)
        wide = np.concatenate([data, np.zeros(quality_cnn.WIDTH - 1, np.uint8)])
        a = sum(net.w[k][wide[k : k + len(data)]] for k in range(quality_cnn.WIDTH)).reshape(-1, quality_cnn.BLOCK, quality_cnn.FILTERS).max(axis=1)
        chunk = np.maximum(a, np.concatenate([a[1:], a[-1:]]))
        act = np.maximum(chunk + net.b, 0)
        x = np.concatenate([act.mean(axis=0), act.max(axis=0)])
        assert abs(1 / (1 + np.exp(-(x @ net.v + net.c))) - p) < 1e-4


def luhn(d):
    twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
    return sum(x - 9 if x > 9 else x for x in twice) % 10 == 0


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m.group())
            ok = {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m.group().split(".")),
                  "card": lambda: 13 <= len(d) <= 19 and luhn(d), "phone": lambda: 9 <= len(d) <= 15}[kind]()
            out += [(kind, m.start(), m.end())] * ok
    return out


def test_pii_base_spans(spark, workdir):
    import random

    r = random.Random(3)
    parts = ["a@b.c", "_x", "@d.e", "1.2.3.4", ".5", "+1", "(", "555", "-", "4111 1111 1111 1111", " ", "+49 30 1234567", "x", "0", "0000255.1.1.1", "é",
             "😀", "\n", "a.b@c-d.e.f", "%", "9999", "me (at) example (dot) com", "4111/1111/1111/1111"]
    odd = {i: "".join(r.choice(parts) for _ in range(r.randint(0, 25))) for i in range(400)}
    odd |= {400: "9" * 30000 + " a@b.cc", 401: "a" * 100000 + "@b", 402: "1 " * 20000}
    spark.createDataFrame(list(odd.items()), "doc_id long, text string").write.parquet(f"{workdir}/documents.parquet")
    for sf, of in ((SF, texts()), (workdir, odd)):
        for d, row in run(spark, "op4_pii", sf).items():
            spans = base_spans(of[d])
            text = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
            assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(s[0] == k for s in spans) for k in PATTERNS]
            assert row.base_sha256 == sha(text.encode())
            every = [s.split(":") for s in row.spans.split(",") if s]
            assert {tuple(s) for s in every} >= {(k, str(a), str(b)) for k, a, b in spans}
            order = [(list(PATTERNS).index(k), int(a)) for k, a, _ in every]
            assert order == sorted(order)


def test_labelers_are_weighed_by_agreement():
    """A labeler that contradicts the others gets a low rate."""
    m = len(pii.LABELERS)
    for_, against = (1,) * (m - 1), (-1,) * (m - 1)
    chance, rate = pii.reliabilities([("card", (*for_, -1), 50), ("card", (*against, 1), 50), ("card", (*for_, 1), 5)])
    assert chance[("card", (*for_, -1))] > 0.95 > 0.05 > chance[("card", (*against, 1))]
    assert rate[pii.LABELERS[-1]][(1, 1)] < 0.3 < rate[pii.LABELERS[0]][(1, 1)]


def test_shards_are_even_and_gapless(spark):
    sf = "/root/testdata/sf0.01"
    got, of = run(spark, "op5_kd_shards", sf), texts(sf)
    sums, slots = Counter(), {}
    for d, r in got.items():
        assert r.size == len(of[d].encode()) + 1 and r.text_crc32 == zlib.crc32(of[d].encode()) and r.law == "bytes" and r.grown_shard is None
        sums[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert sorted(sums) == list(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    largest = max(r.size for r in got.values())
    assert max(sums.values()) - min(sums.values()) <= 4 * largest
    again = run(spark, "op5_kd_shards", sf)
    assert all(tuple(r) == tuple(again[d]) for d, r in got.items())


def plain_counts(text):
    w = re.findall(WORD, text)
    at: dict = {}
    for i in range(len(w) - 4):
        at.setdefault(tuple(w[i : i + 5]), []).append(i)
    covered = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered),
            len(w) < 10 or 100 * len(covered) > 20 * len(w))


def test_rules_count_and_keep_clean_documents(spark):
    sf = "/root/testdata/sf0.01"
    got, of = run(spark, "op6_outliers", sf), texts(sf)
    for d, r in got.items():
        assert plain_counts(of[d]) == (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        assert not (r.base_failed and r.kept)
    quality = dict(table("labels", sf)[["doc_id", "quality"]].itertuples(index=False))
    good = [got[d].kept for d, q in quality.items() if q == 1 and not got[d].base_failed]
    bad = [got[d].kept for d, q in quality.items() if q == 0]
    assert sum(good) / len(good) > 0.99 and sum(bad) / len(bad) < 0.15


def test_distances_equal_numpy(spark):
    """Cholesky in column expressions against numpy, on a made-up scatter."""
    from pyspark.sql import functions as F

    r = np.random.default_rng(2)
    a = r.normal(size=(outliers.D, outliers.D))
    cov, m, x = a @ a.T + np.eye(outliers.D), r.normal(size=outliers.D), r.normal(size=outliers.D)
    row = {f"_t_s{i}_{j}": float(cov[i, j]) for i, j in outliers.PAIRS} | {f"_t_m{i}": float(v) for i, v in enumerate(m)}
    df = outliers._invert(spark.range(1).select(F.lit("g").alias("_t_group"), F.lit(0).alias("_t_start"), F.lit(1).alias("_t_n"), *[F.lit(v).alias(k) for k, v in row.items()]))
    for k, v in zip(outliers.X, x):
        df = df.withColumn(k, F.lit(float(v)))
    got = df.select(outliers._distance(), "_t_log").first()
    assert math.isclose(got[0], (x - m) @ np.linalg.inv(cov) @ (x - m), rel_tol=1e-9)
    assert math.isclose(got[1], np.linalg.slogdet(cov)[1], rel_tol=1e-9)


def plain_fingerprint(text):
    w = re.findall(WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    if not w:
        return 0
    parts = [" ".join(w)] if len(w) < 3 else [" ".join(w[i : i + 3]) for i in range(len(w) - 2)]
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def plain_components(fp):
    root = {d: d for d in fp}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(fp)
    f = np.array([fp[d] for d in ids], np.uint64)
    for i, d in enumerate(ids):
        for j in np.flatnonzero(np.bitwise_count(f[i] ^ f) <= 2):
            a, b = sorted((find(d), find(ids[int(j)])))
            root[b] = a
    return {d: find(d) for d in ids}


def test_simhash(spark):
    got, of = run(spark, "op7_simhash"), texts()
    fp = {d: plain_fingerprint(t) for d, t in of.items()}
    assert {d: r.fingerprint for d, r in got.items()} == {d: f"{f:016x}" for d, f in fp.items()}
    assert {d: r.component_id for d, r in got.items()} == plain_components(fp)


def test_simhash_links_and_components(spark):
    """Planted chains: every link within two bits, whatever prefixes it crosses."""
    r = np.random.default_rng(5)
    fp = r.integers(0, 1 << 63, 300, dtype=np.uint64) * np.uint64(2)
    chain = [fp[0]]
    for _ in range(400):  # a long chain, two bits a step
        a, b = r.integers(0, 64, 2)
        chain.append(chain[-1] ^ (np.uint64(1) << np.uint64(a)) ^ (np.uint64(1) << np.uint64(b)))
    near = fp[:100] ^ (np.uint64(1) << r.integers(0, 64, 100).astype(np.uint64))
    every = np.unique(np.concatenate([fp, near, chain]))
    leaves = spark.createDataFrame([(int(x),) for x in every.view(np.int64)], "_t_fp long")
    expect = plain_components({i: int(x) for i, x in enumerate(every)})
    for pair in (1 << 16, 7):  # whole prefixes, and node pairs cut into blocks
        root = {r["_t_fp"]: r["_t_root"] for r in simhash.components(simhash.links(spark, leaves, 2, pair)).collect()}
        got = {}
        for i, x in enumerate(every.view(np.int64).tolist()):
            got.setdefault(root.get(x, x), []).append(i)
        want: dict = {}
        for i, c in expect.items():
            want.setdefault(c, []).append(i)
        assert sorted(got.values()) == sorted(want.values())


def plain_repeats(of):
    seen, out = set(), {}
    for d in sorted(of):
        b = of[d].encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 99):
            w = b[i : i + 100]
            if w in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[d] = (len(b), len(b) - len(kept), sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone)), sha(kept))
    return out


@pytest.mark.parametrize("hot", [4096, 2])
def test_repeats(spark, monkeypatch, hot):
    """Also with every anchor treated as a hot one."""
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    got = run(spark, "op8_suffix_dedup")
    assert {d: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for d, r in got.items()} == plain_repeats(texts())


def test_suffix_sort_orders_strings():
    r = np.random.default_rng(1)
    block = bytes(r.integers(97, 99, 130, dtype=np.uint8))
    data = np.frombuffer(b"".join(block[: int(n)] + b"x" * 120 for n in r.integers(0, 130, 60)), np.uint8)
    start = np.arange(len(data) - 100)
    r.shuffle(start)
    group = np.sort(r.integers(0, 5, len(start)))
    order = suffix_dedup.merge_sorted(data, suffix_dedup.Hashes(data), start, group)
    raw = data.tobytes()
    got = [(int(g), raw[s : s + 100]) for g, s in zip(group, start[order])]
    assert got == sorted(got) and sorted(order.tolist()) == list(range(len(start)))
    assert all(set(order[group == g].tolist()) == set(np.flatnonzero(group == g).tolist()) for g in range(5))
    # a stable sort: equal strings keep their order
    assert all(a < b for a, b, x, y in zip(order, order[1:], got, got[1:]) if x == y)


def naive_ppm(train, test, order=4):
    counts: dict = {}
    symbols = lambda b: [256] * order + [*b, 256]
    for b in train:
        s = symbols(b)
        for i in range(order, len(s)):
            for o in range(order + 1):
                counts.setdefault(tuple(s[i - o : i]), Counter())[s[i]] += 1

    def log(context, x):
        gone, out = set(), 0.0
        for o in range(order, -1, -1):
            c = counts.get(tuple(context[order - o :]), {})
            left = {k: v for k, v in c.items() if k not in gone}
            if not left:
                continue
            total, kinds = sum(left.values()), len(left)
            whole = total if o == 0 and len(counts[()]) == 257 else total + kinds
            if x in left:
                return out + math.log10(left[x] / whole)
            out, gone = out + math.log10(kinds / whole), gone | set(c)
        return out - math.log10(257 - len(counts.get((), ())))

    return [sum(log(s[i - order : i], s[i]) for i in range(order, len(s))) for s in map(symbols, test)]


def test_lm(spark):
    got, of = run(spark, "op9_ppm"), texts()
    out = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in of}
    tokens = {d: [*t.encode().lower().split(), b""] for d, t in of.items()}
    c = Counter(w for d, ws in tokens.items() if not out[d] for w in ws)
    n, v = sum(c.values()), len(c)
    some = [*sorted(of)[:20], *[d for d in sorted(of) if out[d]][:10]]
    scores = dict(zip(some, naive_ppm([of[d].encode() for d in of if not out[d]], [of[d].encode() for d in some])))
    for d, r in got.items():
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out[d], len(tokens[d]), sum(c[w] > 0 for w in tokens[d]), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens[d]), rel_tol=1e-9)
        if d in scores:
            assert math.isclose(r.score, scores[d], rel_tol=1e-5)


def test_lm_learns_longer_contexts(spark):
    """Held-out bits a byte: longer contexts must not cost code length."""
    of = texts("/root/testdata/sf0.01")
    train = [t.encode() for d, t in of.items() if zlib.crc32(str(d).encode()) % 7 != 2][:300]
    test = [t.encode() for d, t in of.items() if zlib.crc32(str(d).encode()) % 7 == 2][:12]
    bits = [-sum(naive_ppm(train, test, k)) / math.log10(2) / sum(len(t) + 1 for t in test) for k in (2, ppm.ORDER)]
    assert bits[1] < 0.95 * bits[0], bits


def test_parts_of_long_texts_are_scored_alike(spark, monkeypatch):
    from tern.llm import language_id

    r = np.random.default_rng(6)
    docs = [(i, " ".join("".join(map(chr, r.integers(97, 103, 4))) for _ in range(n))) for i, n in enumerate((5, 400, 30, 0, 900, 2))]
    docs = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    whole = {x.doc_id: x.score for x in ppm.lm_scores(spark, docs).collect()}
    plain = dict(zip(sorted(whole), naive_ppm([x.text.encode() for x in docs.collect() if zlib.crc32(str(x.doc_id).encode()) % 7 != 2],
                                              [x.text.encode() for x in docs.orderBy("doc_id").collect()])))
    assert all(math.isclose(whole[d], plain[d], rel_tol=1e-5) for d in whole)
    raws = [x.text.encode() for x in docs.collect()]
    one = list(language_id.string_runs(raws, 4))
    parts = list(language_id.string_runs(raws, 4, 50))
    assert len(one) == 1 and len(parts) > 40 and np.array_equal(np.concatenate([s for _, s, _ in parts]), one[0][1])


def test_ppm_probabilities_add_up():
    r = np.random.default_rng(4)
    train = [bytes(r.integers(97, 103, 200, dtype=np.uint8)) for _ in range(5)]
    cells = np.concatenate([c for _, c, _ in ppm.cells_of(train)])
    k, n = np.unique(cells, return_counts=True)
    m = ppm.Model(k, n)
    unseen = ppm.SYMBOLS - (m.size - 1)
    p = 10.0 ** m.table.astype(np.float64)
    assert np.allclose(p[:, :, :-1].sum(axis=2) + unseen * p[:, :, -1], 1, atol=1e-5)


def test_bpe(spark):
    got, of = run(spark, "op10_bpe"), texts()
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for d, r in got.items():
        ids = t.encode(of[d], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), sha(",".join(map(str, ids)).encode()))
        assert r.decoded_sha256 == sha(t.decode(ids, skip_special_tokens=False).encode())


def test_bpe_odd_texts():
    import random

    from tern.llm import bpe

    path = public_tokenizers.path("byte_bpe_50k.json")
    t, coder, r = Tokenizer.from_file(path), bpe.Coder(bpe.load(path)), random.Random(1)
    parts = ["a", "b", " ", "\n", "é", "😀", "<|endoftext|>", "9", "'s", "'", "-", "́", "ß", "\x85", "​", "\x00", "aaaa", "　"]
    odd = ["", "<|endoftext|>", "   \n\n x", "a" * 3000, "日本語", "I'll don't 'S", "ab" * 500 + "Zq" * 100]
    odd += ["".join(r.choice(parts) for _ in range(r.randint(0, 60))) for _ in range(300)]
    for x in odd:
        ids = coder.encode(x)
        assert ids == t.encode(x, add_special_tokens=False).ids and coder.decode(ids) == t.decode(ids, skip_special_tokens=False)


TEN = "/root/testdata/sf0.01"  # enough labels to learn from


def test_pipeline(spark):
    """Each stage against a plain version on the rows that it got."""
    import corpus_pipeline
    from tern.session import materialize

    docs = spark.read.parquet(f"{TEN}/documents.parquet")
    before, columns = docs.toPandas(), docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, TEN), "test-stage")
        seen[name] = (before, docs.toPandas())
        assert name == "bpe encoding" or docs.columns == columns
        before = seen[name][1]
    ids = lambda f: sorted(f.doc_id.tolist())
    inn, out = seen["quality classifier"]
    labels = table("labels", TEN)
    bad = set(labels[labels.quality == 0].doc_id) & set(inn.doc_id)
    good = set(labels[(labels.quality == 1) & (labels.toxic == 0)].doc_id)
    assert len(bad & set(out.doc_id)) <= 0.2 * len(bad) and len(good - set(out.doc_id)) <= 0.03 * len(good)
    inn, out = seen["exact dedup"]
    first: dict = {}
    for d, t in sorted(zip(inn.doc_id, inn.text)):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), d)
    assert ids(out) == sorted(first.values())
    inn, out = seen["simhash near-dedup"]
    assert ids(out) == sorted(set(plain_components({d: plain_fingerprint(t) for d, t in zip(inn.doc_id, inn.text)}).values()))
    inn, out = seen["mixing"]
    sizes = {d: len(re.findall(WORD, t)) for d, t in zip(inn.doc_id, inn.text)}
    copies = Counter(out.doc_id)
    target = {r.source: r.target for r in mixing.mix_decisions(spark.createDataFrame(inn)).join(spark.createDataFrame(inn[["doc_id", "source"]]), "doc_id").collect()}
    for s, t in target.items():
        mine = inn[inn.source == s].doc_id
        assert abs(sum(sizes[d] * copies[d] for d in mine) - t) <= max(sizes[d] for d in mine)
    inn, out = seen["bpe encoding"]
    tok = Tokenizer.from_file(corpus_pipeline.VOCABULARY)
    for t, i, n in zip(out.text, out.token_ids, out.n_tokens):
        assert list(i) == tok.encode(t, add_special_tokens=False).ids and n == len(i)
    assert corpus_pipeline.run(spark, TEN).count() == len(out)
