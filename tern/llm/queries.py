"""One query per corpus operator, on the whole ``documents`` table.

Each query calls its operator with production parameters and derives the
result's digest columns from what the operator returns.  ``ORACLES`` holds
DuckDB SQL where SQL can express the result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tern.llm import align, bpe, exact_dedup, kd_shards, language_id, merkle, mixing, outliers, pii, ppm, quality_cnn, simhash, suffix_dedup
from tern.sources.tables import table


def _documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(*columns)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_decisions(_documents(spark, sf_dir, "doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op2_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir, "doc_id", "text")
    net = quality_cnn.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality_cnn.score(spark, docs, net)
    return scored.select(
        "doc_id", quality_cnn.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact_dedup.membership(_documents(spark, sf_dir, "doc_id", "text"))
    return rows.select(
        "doc_id", "keep_id", "group_size", F.col("_t_kept").alias("kept"), F.lower(F.hex("_t_digest")).alias("text_sha256")
    )


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pii.personal_data(_documents(spark, sf_dir, "doc_id", "text"))
    base = F.filter("found", lambda s: s["base"])
    of_kind = lambda k: F.size(F.filter(base, lambda s: s["k"] == k)).cast("long")
    count = [of_kind(k).alias(f"n_{name}") for k, name in enumerate(pii.KINDS, 1)]
    return rows.select(
        "doc_id", *count, F.sha2(pii.joined(base), 256).alias("base_sha256"), pii.joined(F.col("found")).alias("spans")
    )


def op5_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = kd_shards.kd_shards(_documents(spark, sf_dir, "doc_id", "text", "lang", "source", "n_chars"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op6_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = outliers.outliers(_documents(spark, sf_dir, "doc_id", "text", "lang", "source"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", "kept"
    )


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_groups(spark, _documents(spark, sf_dir, "doc_id", "text"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("_t_fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suffix_dedup.remove_repeats(spark, _documents(spark, sf_dir, "doc_id", "text"), with_bytes=False)
    return rows.drop("_t_row", "kept")


def op9_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.lm_scores(spark, _documents(spark, sf_dir, "doc_id", "text")).drop("_t_row")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(spark, _documents(spark, sf_dir, "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))


#: what a leaf of the manifest covers
LEAF = ("doc_id", "source", "lang", "n_chars", "text")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tampering takes the line ends out of every other document's text."""
    docs = _documents(spark, sf_dir, *LEAF)
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False))
    text = F.when(hit, F.translate("text", "\n", "")).otherwise(F.col("text"))
    leaves = docs.select(
        "doc_id", "source", merkle.leaf_of([F.col(c) for c in LEAF]).alias("leaf"),
        merkle.leaf_of([text if c == "text" else F.col(c) for c in LEAF]).alias("_t_now"),
    )
    proved = merkle.manifest(leaves).withColumn("folded_root", merkle.folded(F.col("_t_now"), F.col("proof")))
    return proved.select(
        "doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def op12_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir, "doc_id", "text")
    a, b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return align.align(spark, docs, a, b, with_groups=False).drop("_t_row", "groups")


def op13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir, "doc_id", "text", "lang")
    found = language_id.predict(spark, docs.select("doc_id", "text"), language_id.fit(docs))
    return found.select("doc_id", language_id.held_out("doc_id").alias("held_out"), "lang_pred", "score")


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_quality_cnn": op2_quality_cnn,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_pii": op4_pii,
    "op5_kd_shards": op5_kd_shards,
    "op6_outliers": op6_outliers,
    "op7_simhash": op7_simhash,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_ppm": op9_ppm,
    "op10_bpe": op10_bpe,
    "op11_merkle": op11_merkle,
    "op12_align": op12_align,
    "op13_language": op13_language,
}

ORACLES = {
    "op1_mixing": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 18) AS h,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS w
  FROM d GROUP BY source),
lvl(n, level) AS (
  SELECT 0, CAST(-1.0 AS DOUBLE)
  UNION ALL
  SELECT n + 1, (SELECT (1.5 * sum(source_size) - coalesce(sum(2.0 * source_size) FILTER (2.0 * source_size < lvl.level * w), 0.0))
                        / sum(w) FILTER (NOT 2.0 * source_size < lvl.level * w) FROM s)
  FROM lvl WHERE n < 60),
t AS (
  SELECT source, source_size, least(2.0 * source_size, (SELECT max(level) FROM lvl) * w)::DOUBLE AS target FROM s),
u AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
v AS (
  SELECT *, CASE WHEN source_size > 0 THEN target - whole * source_size ELSE 0 END AS rest FROM u),
b AS (SELECT source, h, sum(size) AS cell FROM d GROUP BY source, h),
r AS (SELECT *, sum(cell) OVER (PARTITION BY source ORDER BY h) AS run FROM b),
e AS (
  SELECT v.source, v.rest, arg_min(r.h, r.h) AS h, arg_min(r.run - r.cell, r.h) AS before, arg_min(r.cell, r.h) AS cell
  FROM v JOIN r ON v.source IS NOT DISTINCT FROM r.source WHERE v.rest > 0 AND r.run >= v.rest GROUP BY v.source, v.rest)
SELECT d.doc_id, d.size, v.source_size, v.target,
       CAST(d.size * (v.whole + CASE WHEN e.h IS NOT NULL
         AND (d.h < e.h OR (d.h = e.h AND 2 * (e.rest - e.before) >= e.cell)) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN v ON d.source IS NOT DISTINCT FROM v.source LEFT JOIN e ON d.source IS NOT DISTINCT FROM e.source
""",
    "op3_exact_dedup": r"""
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[ \x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)
""",
    "op11_merkle": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, text, lang, n_chars,
         -- the lowest bit of the CRC-32 of the decimal id, a bit at a time
         list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
           lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
             lambda x, y: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384::BIGINT ELSE 0 END))) % 2 = 1 AS hit
  FROM documents),
p AS (
  SELECT doc_id, source, hit,
         coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
           || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS front,
         coalesce(strlen(text) || ':' || text, '-') AS own,
         coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-') AS less
  FROM d),
leaves AS (
  SELECT doc_id, coalesce(':' || source, '') AS g, sha256(front || own) AS leaf, sha256(front || CASE WHEN hit THEN less ELSE own END) AS other,
         row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n
  FROM p),
t(g, level, i, n, h) AS (
  SELECT g, 0, i, n, leaf FROM leaves
  UNION ALL
  SELECT g, level + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM t WHERE n > 1 GROUP BY g, level, n, i // 3),
tops AS (SELECT g, h FROM t WHERE n = 1),
u(level, i, n, h) AS (
  SELECT 0, row_number() OVER (ORDER BY g) - 1, count(*) OVER (), h FROM tops
  UNION ALL
  SELECT level + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM u WHERE n > 1 GROUP BY level, n, i // 3),
tt AS (SELECT g, level, i, h FROM t),
f(doc_id, g, level, i, n, proof, h) AS (
  SELECT doc_id, g, 0, i, n, '', other FROM leaves
  UNION ALL
  SELECT f.doc_id, f.g, f.level + 1, f.i // 3, (f.n + 2) // 3, f.proof || coalesce(a.h, '') || coalesce(b.h, ''),
         sha256(CASE f.i % 3 WHEN 0 THEN f.h || coalesce(a.h, '') || coalesce(b.h, '') WHEN 1 THEN a.h || f.h || coalesce(b.h, '') ELSE a.h || b.h || f.h END)
  FROM f LEFT JOIN tt a ON a.g = f.g AND a.level = f.level AND a.i = f.i // 3 * 3 + CASE f.i % 3 WHEN 0 THEN 1 ELSE 0 END
         LEFT JOIN tt b ON b.g = f.g AND b.level = f.level AND b.i = f.i // 3 * 3 + CASE f.i % 3 WHEN 2 THEN 1 ELSE 2 END
  WHERE f.n > 1),
place AS (SELECT g, h, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM tops),
e(doc_id, g, level, i, n, proof, h) AS (
  SELECT f.doc_id, f.g, 0, place.i, place.n, f.proof, f.h FROM f JOIN place ON place.g = f.g WHERE f.n = 1
  UNION ALL
  SELECT e.doc_id, e.g, e.level + 1, e.i // 3, (e.n + 2) // 3, e.proof || coalesce(a.h, '') || coalesce(b.h, ''),
         sha256(CASE e.i % 3 WHEN 0 THEN e.h || coalesce(a.h, '') || coalesce(b.h, '') WHEN 1 THEN a.h || e.h || coalesce(b.h, '') ELSE a.h || b.h || e.h END)
  FROM e LEFT JOIN u a ON a.level = e.level AND a.i = e.i // 3 * 3 + CASE e.i % 3 WHEN 0 THEN 1 ELSE 0 END
         LEFT JOIN u b ON b.level = e.level AND b.i = e.i // 3 * 3 + CASE e.i % 3 WHEN 2 THEN 1 ELSE 2 END
  WHERE e.n > 1)
SELECT l.doc_id, l.leaf, place.h AS subroot, r.h AS root, sha256(e.proof) AS proof_sha256, e.h AS folded_root, e.h = r.h AS verified
FROM leaves l JOIN e ON e.doc_id = l.doc_id AND e.n = 1 JOIN place ON place.g = l.g JOIN (SELECT h FROM u WHERE n = 1) r ON true
""",
}
