"""Versions of files as a stream: state per path tells what is new, changed or gone, and facts follow.

A feed has a row per version, (file_path, content, modified), content null where the file is
gone. The state of a path is the hash and time of its last version. A batch's facts go into a
folder of their own and a log says which batch's facts hold, so a batch that runs again
writes the same again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from lexispan.operators.extract import facts, source_files
from lexispan.session import ship

FEED = "file_path string, content string, modified timestamp"
_CHANGE = "file_path string, content string, modified timestamp, state string"
_LOG = "file_path string, modified timestamp, state string, run bigint"


def _step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """The last version of a batch, if it is not older than the state's and differs from it."""
    hash_, time = state.get if state.exists else (None, None)
    rows = pd.concat(list(batches))
    last = rows.sort_values(["modified", "sha256"], na_position="first").iloc[-1]
    new = None if pd.isna(last["sha256"]) else last["sha256"]
    if time is not None and last["modified"] < pd.Timestamp(time):
        return  # a late version: what is known is newer
    state.update((new, last["modified"].to_pydatetime()))
    if new != hash_:
        told = "deleted" if new is None else "new" if hash_ is None else "changed"
        yield pd.DataFrame({"file_path": [key[0]], "content": [last["content"] if new else None], "modified": [last["modified"]], "state": [told]})


def changes(feed: DataFrame) -> DataFrame:
    """(file_path, content, modified, state) of a stream of versions: rows that are new, changed or deleted; the same again and what comes late gives none."""
    ship(feed.sparkSession)
    rows = feed.where("file_path IS NOT NULL AND modified IS NOT NULL").withColumn("sha256", F.sha2("content", 256))
    return rows.groupBy("file_path").applyInPandasWithState(_step, _CHANGE, "sha256 string, modified timestamp", "append", "NoTimeout")


def index_versions(spark: SparkSession, feed: str, path: str, checkpoint: str) -> StreamingQuery:
    """Bring the facts under ``path`` up to the versions in a folder of Parquet files, then stop; run again for those that came since."""

    def write(batch: DataFrame, run: int) -> None:
        rows = batch.persist()
        try:
            texts = source_files(rows.where("state <> 'deleted'").select("file_path", "content"))
            facts(texts).write.mode("overwrite").partitionBy("fact").parquet(f"{path}/facts/run={run}")
            rows.select("file_path", "modified", "state", F.lit(run).cast("bigint").alias("run")).write.mode("overwrite").parquet(f"{path}/log/run={run}")
        finally:
            rows.unpersist()

    stream = spark.readStream.schema(FEED).parquet(feed)
    return changes(stream).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def standing(spark: SparkSession, path: str) -> DataFrame:
    """(file_path, modified, state, run) of the files that are there, with the run whose facts hold."""
    log = spark.read.option("basePath", f"{path}/log").schema(_LOG).parquet(f"{path}/log")
    last = log.withColumn("_nth", F.row_number().over(Window.partitionBy("file_path").orderBy(F.desc("run"))))
    return last.where("_nth = 1 AND state <> 'deleted'").drop("_nth")


def current(spark: SparkSession, path: str) -> DataFrame:
    """(fact, body) rows that hold, for ``extract.table``."""
    rows = spark.read.option("basePath", f"{path}/facts").schema("body string, run bigint, fact string").parquet(f"{path}/facts").withColumn("file_path", F.get_json_object("body", "$.file_path"))
    return rows.join(standing(spark, path).select("file_path", "run"), ["file_path", "run"], "left_semi").select("fact", "body")
