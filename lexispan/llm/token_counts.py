"""Token counts: an exact histogram of encoded lengths.

Documents are aggregated by encoded length; suffix sums over the histogram then
answer totals, quantiles and truncated totals for every context limit.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexispan.llm.common import released, ship, written
from lexispan.llm.tokens import encoder, slices


def encoded_lengths(docs: DataFrame, vocabulary: str, text: str = "text", extra: int = 0) -> DataFrame:
    """(n_tokens) of each row: ids of its whole text (null: empty) plus ``extra``.

    Rows alike count each for itself; only ``text`` is read, so other columns may
    have any name, n_tokens included. No rows: no rows.
    """
    ship(docs.sparkSession)

    def lengths(batches):
        encode = encoder(vocabulary).encode
        for batch in batches:
            for part in slices(batch, "text"):
                _, at = encode(part.column("text"))
                yield pa.RecordBatch.from_arrays([pa.array(np.diff(at) + extra)], ["n_tokens"])

    return docs.select(F.col(text).alias("text")).mapInArrow(released(lengths), "n_tokens long")


def histogram(lengths: DataFrame, bucket: int = 4096) -> DataFrame:
    """One row per distinct length, as a context limit.

    n_docs and tokens have that very length; docs_over and tokens_over are the
    suffix sums beyond it; truncated_total is the sum of min(length, limit);
    quantile is the share of documents of at most that length. Sums run first over
    ``bucket`` lengths at a time, then inside each, so no task gathers all lengths.
    No documents: no rows.
    """
    # written, as it is read twice and what makes it is encoding all texts
    per = written(lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs")), "lengths").withColumn("bucket", F.floor(F.col("n_tokens") / bucket))
    whole = per.groupBy("bucket").agg(F.sum("n_docs").alias("b_docs"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("b_tokens"))
    after = Window.orderBy("bucket").rowsBetween(1, Window.unboundedFollowing)
    every = Window.partitionBy()
    whole = whole.select(
        "bucket",
        F.coalesce(F.sum("b_docs").over(after), F.lit(0)).alias("later_docs"),
        F.coalesce(F.sum("b_tokens").over(after), F.lit(0)).alias("later_tokens"),
        F.sum("b_docs").over(every).alias("all_docs"),
        F.sum("b_tokens").over(every).alias("all_tokens"),
    )
    inside = Window.partitionBy("bucket").orderBy("n_tokens").rowsBetween(1, Window.unboundedFollowing)
    summed = (
        per.withColumn("tokens", F.col("n_docs") * F.col("n_tokens"))
        .withColumn("in_docs", F.coalesce(F.sum("n_docs").over(inside), F.lit(0)))
        .withColumn("in_tokens", F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
        .join(whole, "bucket")
    )
    return summed.select(
        "n_tokens", "n_docs", "tokens",
        (F.col("in_docs") + F.col("later_docs")).alias("docs_over"),
        (F.col("in_tokens") + F.col("later_tokens")).alias("tokens_over"),
        "all_docs", "all_tokens",
    ).select(
        "n_tokens", "n_docs", "tokens", "docs_over", "tokens_over",
        (F.col("all_tokens") - F.col("tokens_over") + F.col("docs_over") * F.col("n_tokens")).alias("truncated_total"),
        ((F.col("all_docs") - F.col("docs_over")) / F.col("all_docs")).alias("quantile"),
    )


def quantile(hist: DataFrame, share: float) -> DataFrame:
    """The smallest length that at least ``share`` of the documents do not exceed (no rows: null)."""
    return hist.where(F.col("quantile") >= share).agg(F.min("n_tokens").alias("n_tokens"))


def truncated_total(hist: DataFrame, limit: int) -> DataFrame:
    """Tokens that remain if every document is cut to ``limit`` ids; also for limits that no document has."""
    return hist.agg(F.coalesce(F.sum(F.least(F.col("n_tokens"), F.lit(limit)) * F.col("n_docs")), F.lit(0)).alias("tokens"))
