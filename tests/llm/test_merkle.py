"""The manifest against a tree built in plain Python (the query itself is
compared with SQL in test_queries)."""

import hashlib

from pyspark.sql import functions as F

from tern.llm import merkle

from .fixtures import awkward, awkward_rows, empty

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
H = lambda *x: hashlib.sha256("".join(x).encode()).hexdigest()


def plain_tree(leaves, fanout=3):
    """Root and, for each leaf, its (left, right) siblings from below."""
    paths, under = [[] for _ in leaves], [[i] for i in range(len(leaves))]
    while len(leaves) > 1:
        nodes, below = [], []
        for a in range(0, len(leaves), fanout):
            run = leaves[a : a + fanout]
            for k, mine in enumerate(under[a : a + fanout]):
                for i in mine:
                    paths[i].append(("".join(run[:k]), "".join(run[k + 1 :])))
            nodes.append(H(*run))
            below.append([i for mine in under[a : a + fanout] for i in mine])
        leaves, under = nodes, below
    return leaves[0], paths


def plain_manifest(rows, fanout=3):
    """Sorted (leaf, subroot, root, proof) of (id, source, leaf) rows."""
    by: dict = {}
    for i, s, leaf in rows:
        by.setdefault(s, []).append((i is not None, i or 0, leaf))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = [plain_tree([x[2] for x in sorted(by[s])], fanout) for s in order]
    root, above = plain_tree([t[0] for t in trees], fanout)
    return sorted(
        (x[2], sub, root, path + above[k])
        for k, (s, (sub, paths)) in enumerate(zip(order, trees)) for x, path in zip(sorted(by[s]), paths)
    )


def flat(rows):
    return sorted((r.leaf, r.subroot, r.root, [tuple(p) for p in r.proof]) for r in rows)


def test_leaf_of_fields(spark):
    df = spark.createDataFrame([(1, "ä", None, ""), (None, "x:y", 5, None)], "a long, b string, c int, d string")
    got = [r[0] for r in df.select(merkle.leaf_of([F.col(c) for c in df.columns])).collect()]
    assert got == [H("1:1", "2:ä", "-", "0:"), H("-", "3:x:y", "1:5", "-")]


def test_awkward_rows(spark):
    """Null ids and sources, repeated rows, clashing names; folding and one
    changed byte."""
    docs = awkward(spark).withColumn("root", F.lit("mine")).withColumn("proof", F.lit(1))
    leaves = docs.withColumn("leaf", merkle.leaf_of([F.col(c) for c in FIELDS]))
    got = merkle.manifest(leaves)
    assert set(got.columns) == set(leaves.columns) | {"subroot"} and got.columns.count("root") == 1
    other = F.sha2(F.concat("leaf", F.lit("x")), 256)
    rows = got.withColumns({"same": merkle.folded(F.col("leaf"), F.col("proof")), "changed": merkle.folded(other, F.col("proof")),
                            "digest": merkle.proof_digest(F.col("proof"))}).collect()
    assert len(rows) == len(awkward_rows())
    assert all(r.same == r.root != r.changed for r in rows)
    assert all(r.digest == H(*(x for p in r.proof for x in p)) for r in rows)
    assert flat(rows) == plain_manifest([(r.doc_id, r.source, r.leaf) for r in leaves.collect()])
    none = empty(spark).withColumn("leaf", F.lit(""))
    assert merkle.manifest(none).count() == 0


def test_sizes_of_groups(spark):
    """Groups of 1 to 28 rows, a null group beside an empty name, and one group
    that holds most of the rows; other fanouts."""
    rows = [(i, f"s{n}", H(f"{n},{i}")) for n in (1, 2, 3, 4, 9, 10, 27, 28) for i in range(n)]
    rows += [(i, "hot", H(f"hot {i}")) for i in range(1500)] + [(7, None, H("none")), (7, "", H("empty"))]
    df = spark.createDataFrame(rows, "doc_id long, source string, leaf string").repartition(7)
    for fanout in (3, 2, 5):
        assert flat(merkle.manifest(df, fanout=fanout).collect()) == plain_manifest(rows, fanout)
    one = merkle.manifest(spark.createDataFrame(rows[:1], df.schema)).first()
    assert one.root == one.subroot == one.leaf and one.proof == []
