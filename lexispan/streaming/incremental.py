"""Incremental indexing: a stream of files that are new, and a refresh that also minds changed and deleted ones."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from lexispan.functions.naming import EXTENSIONS
from lexispan.operators.extract import facts, source_files
from lexispan.sources.files import local_path, read_texts, unlisted

_GLOB = "*.{" + ",".join(EXTENSIONS) + "}"
MANIFEST = "file_path string, modified timestamp, size bigint, facts_run int, run int"


def new_files(spark: SparkSession, root: str) -> DataFrame:
    """Stream of source files below a folder. A path comes once: for files that change there is ``refresh``."""
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("recursiveFileLookup", "true").option("pathGlobFilter", _GLOB).load(root)
    text = F.col("content").cast("string")
    return source_files(raw.where(F.is_valid_utf8(text)).select(local_path(F.col("path")).alias("file_path"), text.alias("content")))


def index_stream(spark: SparkSession, root: str, path: str, checkpoint: str) -> StreamingQuery:
    """Append the facts of all files not yet seen under ``path``, then stop; run again for those that came since. The checkpoint makes each file's facts come once."""
    return facts(new_files(spark, root)).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("fact").outputMode("append").trigger(availableNow=True).start()


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The last complete run's files: (file_path, modified, size, facts_run, run); none before the first."""
    try:
        every = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    except AnalysisException:  # nothing is there yet
        return spark.createDataFrame([], MANIFEST)
    return every.where(F.col("run") == (every.agg(F.max("run")).first()[0] or 0))


def refresh(spark: SparkSession, root: str, path: str) -> dict:
    """Bring the facts under ``path`` up to the files below ``root``; how many are new, changed, deleted and the same.

    Places and times are listed without reading a file; only files that are new, or of
    another time or size than in the manifest, are read and parsed, into a folder of
    this run. The new manifest says for each file whose run's facts hold, so a changed
    file's facts are replaced and a deleted one's are gone; it is written last, and
    until then the old state stands.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", _GLOB).load(root)
    now = listed.select(local_path(F.col("path")).alias("file_path"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"))
    if more := unlisted(spark, root, True, _GLOB):
        now = now.unionByName(read_texts(spark, more).select("file_path", F.timestamp_seconds(F.crc32("content")).alias("modified"), F.octet_length("content").cast("bigint").alias("size")))  # their text tells if they changed
    last = manifest(spark, path)
    run = (last.agg(F.max("run")).first()[0] or 0) + 1
    old = last.select("file_path", F.col("modified").alias("_modified"), F.col("size").alias("_size"), "facts_run")
    met = now.join(old, "file_path", "full")
    state = F.when(F.col("size").isNull(), "deleted").when(F.col("_size").isNull(), "new").when((F.col("size") != F.col("_size")) | (F.col("modified") != F.col("_modified")), "changed").otherwise("same")
    told = met.withColumn("state", state).persist()
    try:
        counts = {r.state: r["count"] for r in told.groupBy("state").count().collect()}
        asked = told.where("state IN ('new', 'changed')").select("file_path")
        if counts.get("new") or counts.get("changed"):
            texts = read_texts(spark, root, True, _GLOB).where("is_utf8").join(asked, "file_path", "left_semi")
            facts(source_files(texts)).write.mode("overwrite").partitionBy("fact").parquet(f"{path}/facts/facts_run={run}")
        kept = told.where("state <> 'deleted'").select("file_path", "modified", "size", F.when(F.col("state") == "same", F.col("facts_run")).otherwise(run).cast("int").alias("facts_run"))
        kept.write.mode("overwrite").parquet(f"{path}/manifest/run={run}")
    finally:
        told.unpersist()
    return {k: counts.get(k, 0) for k in ("new", "changed", "deleted", "same")}


def current(spark: SparkSession, path: str) -> DataFrame:
    """(fact, body) rows that hold after the last ``refresh``, for ``extract.table``."""
    rows = spark.read.option("basePath", f"{path}/facts").schema("body string, facts_run int, fact string").parquet(f"{path}/facts").withColumn("file_path", F.get_json_object("body", "$.file_path"))
    return rows.join(manifest(spark, path).select("file_path", "facts_run"), ["file_path", "facts_run"], "left_semi").select("fact", "body")
