"""File landing area and JSON ingest.

* ``load_json_variant``: ``COPY INTO t FROM @stage FILE_FORMAT=(TYPE='JSON')``
  into one VARIANT column.  ``multiline=True`` reads whole documents (one
  document is one task: a GeoJSON FeatureCollection of any size);
  ``multiline=False`` reads newline-delimited records, which split across
  tasks and are the format to prefer at scale.
* ``list_files``: the stage's directory table from the file-source
  ``_metadata`` column, without reading file contents.
* ``ingest_stream``: files loaded as they land (the continuous-ingest prose),
  exactly once per file by the stream checkpoint.
* ``ingest_with_quarantine``: the same for newline-delimited records, malformed
  ones kept apart with their place instead of stopping the stream.

FeatureCollections that are larger than a task are read by ``geojson.features``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tern.session import materialize


def load_json_variant(
    spark: SparkSession, path: str, column: str = "raw_data", multiline: bool = True, keep_corrupt: bool = False
) -> DataFrame:
    """JSON files -> one VARIANT column.  With ``keep_corrupt`` malformed
    records are kept in ``_corrupt_record`` (and ``column`` is NULL) instead
    of failing the load."""
    r = spark.read.option("multiLine", str(multiline).lower())
    if keep_corrupt:
        r = r.option("mode", "PERMISSIVE").schema(f"{column} variant, _corrupt_record string").option(
            "singleVariantColumn", column
        )
    else:
        r = r.option("mode", "FAILFAST").option("singleVariantColumn", column)
    return r.json(path)


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Directory listing of a landing folder: relative name, size, time."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return df.select(
        F.col("_metadata.file_name").alias("relative_path"),
        F.col("_metadata.file_size").alias("size"),
        F.col("_metadata.file_modification_time").alias("last_modified"),
        F.col("_metadata.file_path").alias("file_url"),
    )


def ingest_stream(
    spark: SparkSession,
    landing: str,
    target: str,
    checkpoint: str,
    column: str = "raw_data",
    multiline: bool = True,
    trigger: dict | None = None,
):
    """Continuous ingest of landing files into a Parquet table folder.

    Each file is loaded once (the checkpoint records consumed files); the
    source file name is kept for lineage.  A malformed record fails the query.
    Returns the StreamingQuery.
    """
    src = (
        spark.readStream.option("multiLine", str(multiline).lower())
        .option("mode", "FAILFAST")
        .option("singleVariantColumn", column)
        .schema(f"{column} variant")
        .json(landing)
        .select(column, F.col("_metadata.file_name").alias("file_name"))
    )
    q = src.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", target)
    return q.trigger(**(trigger or {"availableNow": True})).start()


def split_batch(batch: DataFrame, column: str = "raw_data") -> tuple[DataFrame, DataFrame]:
    """The records of newline-delimited JSON (``value``, ``file_path``, ``block``)
    as two tables: good ones (``column``, ``file_path``) and malformed ones
    (``file_path``, ``byte_offset``, ``record``).  Blank lines are neither.

    The text source gives no offsets.  Within a block of a file they are the
    running sum of the lines' bytes, and a block starts with the bytes of the
    blocks before it; a task's share is one block, and only lengths are sorted.
    """
    ours = batch.where(F.btrim("value") != "")
    good = ours.withColumn(column, F.try_parse_json("value")).where(F.col(column).isNotNull()).select(column, "file_path")
    malformed = F.when((F.btrim("value") != "") & F.try_parse_json("value").isNull(), F.col("value"))
    lines = materialize(batch.select(
        "file_path", "block", F.monotonically_increasing_id().alias("_line"), (F.octet_length("value") + 1).alias("_size"), malformed.alias("record")
    ), "ingest-lines")
    hit = lines.where("record is not null").select("file_path").distinct()
    lines = lines.join(hit, "file_path", "left_semi")
    earlier = Window.partitionBy("file_path", "block").orderBy("_line").rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumn("_within", F.coalesce(F.sum("_size").over(earlier), F.lit(0))).where("record is not null")
    blocks = materialize(batch.select("file_path", "block", (F.octet_length("value") + 1).alias("_size")).groupBy("file_path", "block").agg(
        F.sum("_size").alias("_size")), "ingest-blocks")
    before = Window.partitionBy("file_path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("file_path", "block", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    bad = lines.join(starts, ["file_path", "block"]).select("file_path", (F.col("_start") + F.col("_within")).alias("byte_offset"), "record")
    return good, bad


def write_batch(batch: DataFrame, batch_id: int, target: str, quarantine: str, column: str = "raw_data") -> None:
    """One batch of the stream: both tables get a folder of the batch's number,
    which a replay of the batch replaces by the same rows."""
    good, bad = split_batch(batch, column)
    good.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")
    bad.write.mode("overwrite").parquet(f"{quarantine}/batch={batch_id}")


def ingest_with_quarantine(
    spark: SparkSession, landing: str, target: str, quarantine: str, checkpoint: str, column: str = "raw_data", trigger: dict | None = None
):
    """Continuous ingest of newline-delimited JSON files into the Parquet
    folder ``target`` (``column``, ``file_path``, partition ``batch``); malformed
    records go to ``quarantine`` (``file_path``, ``byte_offset``, ``record``) and
    the stream goes on.

    A file belongs to one batch, and a batch's rows are in one folder of each
    table, so nothing is written twice when a batch is repeated.  While a batch
    is being replayed its folders may be missing for readers.  Returns the
    StreamingQuery.
    """
    src = spark.readStream.option("lineSep", "\n").text(landing).select(
        "value", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("block")
    )
    q = src.writeStream.foreachBatch(lambda batch, k: write_batch(batch, k, target, quarantine, column))
    return q.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
