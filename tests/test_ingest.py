"""FeatureCollections read by byte ranges, and ingest that keeps malformed
records apart."""

import json
import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tern.session import settings
from tern.sources import files, geojson

ODD = ['a } b', 'say "hi"', "back\\slash", 'end\\"', "[{", "é😀", '{"type":"Feature"', "\\", "line\nend", ""]


def feature(r, depth=2):
    props = {"name": r.choice(ODD), "n": r.randrange(99), "list": [r.choice(ODD) for _ in range(r.randrange(3))]}
    if depth and r.random() < 0.4:
        props["inner"] = feature(r, depth - 1)
    return {"type": "Feature", "geometry": {"type": "LineString", "coordinates": [[r.random(), 1] for _ in range(r.randrange(5))]}, "properties": props}


def collection(r, n):
    before = {"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": r.choice(ODD), "features": [{"no": "feature"}]}}, "bbox": [1, [2], {"x": {}}]}
    after = {"others": [{"not": {"a": "feature"}}], "note": r.choice(ODD)}
    return {**before, "features": [feature(r) for _ in range(n)], **after}


def write(path, documents, gap="\n", **how):
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(gap.join(json.dumps(d, ensure_ascii=False, **how) for d in documents))


def read(spark, path, **how):
    rows = geojson.features(spark, path, **how).select("file", "document", "pos", F.to_json("value").alias("v")).collect()
    return sorted((os.path.basename(r.file), r.document, r.pos, json.dumps(json.loads(r.v), sort_keys=True)) for r in rows)


@pytest.mark.parametrize("split, chunk", [(None, 1 << 22), (300, 40), (64, 1)])
def test_ranges_equal_json(spark, workdir, split, chunk):
    """Nested objects of the same look, braces, quotes and backslashes in
    strings, several documents in a file, indented text, chunks of one record."""
    r = random.Random(chunk)
    sets = {"a.json": [collection(r, 15)], "b.json": [collection(r, n) for n in (0, 1, 4)], "c.json": [{"features": [1, None, "x", {"only": "one"}]}], "d.json": [collection(r, 3)]}
    for name, documents in sets.items():
        write(f"{workdir}/{name}", documents, indent=1 if name == "d.json" else None, gap="\n\n" if name == "b.json" else " ")
    expect = sorted(
        (name, k, p, json.dumps(f, sort_keys=True))
        for name, documents in sets.items() for k, d in enumerate(documents)
        for p, f in enumerate(x for x in d["features"] if isinstance(x, dict))
    )
    assert read(spark, workdir, split_bytes=split, chunk=chunk) == expect


def test_a_large_file_is_many_tasks(spark, workdir):
    r = random.Random(5)
    many = [feature(r, 0) for _ in range(300)] * 60
    with open(f"{workdir}/big.json", "w") as f:
        f.write('{"type":"FeatureCollection","features":[' + ",\n".join(json.dumps(x) for x in many) + "]}")
    size = os.path.getsize(f"{workdir}/big.json")
    parts = geojson.chunks(spark, workdir, split_bytes=size // 10)
    assert parts.select("block").distinct().count() >= 10
    got = geojson.features(spark, workdir, split_bytes=size // 10).select("pos", F.variant_get("value", "$.properties.n", "int").alias("n"))
    assert sorted(map(tuple, got.collect())) == [(i, f["properties"]["n"]) for i, f in enumerate(many)]


def test_files_that_end_within_a_feature(spark, workdir):
    text = json.dumps({"features": [{"a": {"b": 1}}, {"c": {"d": 2}}]})
    with open(f"{workdir}/cut.json", "w") as f:
        f.write(text[: text.index(": 2}") + 4])  # one brace is missing
    assert [x[2] for x in read(spark, workdir, strict=False)] == [0]
    with pytest.raises(Exception, match="ends within a feature"):
        read(spark, workdir)
    os.makedirs(f"{workdir}/none")
    with open(f"{workdir}/none/empty.json", "w") as f:
        f.write("")
    assert read(spark, f"{workdir}/none") == []


def test_escaped_quotes():
    text = rb'"a\"b" {"x\\": "\\\"}"} "\\\\" ['
    data = np.frombuffer(text, np.uint8)
    q = geojson.quotes(data)
    assert len(q) % 2 == 0
    at, change = geojson.brackets(data, q, 0)
    assert [chr(text[p]) for p in at] == ["{", "}", "["] and change.tolist() == [1, -1, 1]


# --------------------------------------------------------------- quarantine


def landing_file(path, lines):
    with open(path, "wb") as f:
        f.write(b"\n".join(lines) + b"\n")


def test_malformed_records_are_kept_with_their_place(spark, workdir):
    r = random.Random(2)
    where = {k: f"{workdir}/{k}" for k in ("landing", "good", "bad", "checkpoint")}
    os.makedirs(where["landing"])
    expect, n_good = Counter(), 0
    for k in range(3):
        lines = []
        for i in range(400):
            kind = r.random()
            lines.append(b"" if kind < 0.05 else b'{"i": ' + str(i).encode() if kind < 0.1 else "né{".encode() if kind < 0.12 else json.dumps({"i": i, "t": "é" * r.randrange(9)}, ensure_ascii=False).encode())
        landing_file(f"{where['landing']}/f{k}.json", lines)
        at = 0
        for x in lines:
            if x and (x.startswith(b"n") or not x.endswith(b"}")):
                expect[(f"f{k}.json", at, x.decode())] += 1
            n_good += x.endswith(b"}")
            at += len(x) + 1
    start = lambda: files.ingest_with_quarantine(spark, *where.values()).awaitTermination()
    bad = lambda: Counter((os.path.basename(x.file_path), x.byte_offset, x.record) for x in spark.read.parquet(where["bad"]).collect())
    with settings(spark, {"spark.sql.files.maxPartitionBytes": "3000", "spark.sql.files.openCostInBytes": "0"}):  # files of several blocks
        start()
    assert bad() == expect and spark.read.parquet(where["good"]).count() == n_good
    # the stream goes on
    landing_file(f"{where['landing']}/later.json", [b'{"i": 1}', b"broken", b'{"i": 2}'])
    start()
    assert bad() == expect + Counter({("later.json", 9, "broken"): 1}) and spark.read.parquet(where["good"]).count() == n_good + 2


def test_a_replayed_batch_changes_nothing(spark, workdir):
    os.makedirs(f"{workdir}/in")
    landing_file(f"{workdir}/in/a.json", [b'{"i": 1}', b"{", b'{"i": 2}', b"]"])
    batch = spark.read.option("lineSep", "\n").text(f"{workdir}/in").select(
        "value", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("block"))
    read_both = lambda: [sorted(map(str, spark.read.parquet(f"{workdir}/{k}").collect())) for k in ("good", "bad")]
    files.write_batch(batch, 0, f"{workdir}/good", f"{workdir}/bad")
    first = read_both()
    for _ in range(2):
        files.write_batch(batch, 0, f"{workdir}/good", f"{workdir}/bad")
    assert read_both() == first and [len(x) for x in first] == [2, 2]
    files.write_batch(batch.limit(0), 1, f"{workdir}/good", f"{workdir}/bad")  # nothing in it
    assert read_both() == first


def test_ranges_grow_with_the_files(spark):
    """A fixed range of 64 KB made as many tasks as the files have of it."""
    from tern.plans import driver_queries as q

    sizes = [1, 10**7, 10**9, 5 * 10**9, 10**11]
    splits = [geojson.split_of(s) for s in sizes]
    assert splits == sorted(splits) and splits[0] == 64 << 10 and all(s / x <= 300 for s, x in zip(sizes[:-1], splits))
    seen = {}
    real = geojson.features

    def features(spark, path, **how):
        seen.update(how, path=path)
        return real(spark, path, **how)

    geojson.features = features
    try:
        assert q.split_features(spark, "/root/testdata/sf0.01").count() > 0
    finally:
        geojson.features = real
    assert seen["split_bytes"] >= 64 << 10 and seen["chunk"] * 4 == seen["split_bytes"]
    written = [f for f in os.listdir(seen["path"]) if f.startswith("part-")]
    assert len(written) == 8  # a file for each document, whatever their numbers hash to
