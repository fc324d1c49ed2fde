"""Mixing sources to target weights, with DataFrame functions only.

Tokens are aggregated per source, targets are set by water filling, and each
document is then emitted floor(rate) times plus once more where a hash-seeded
draw in [0, 1) is below the fraction of its source's rate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexispan.llm.common import written

#: A word: code points other than space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def draw(seed: int, *columns: str) -> Column:
    """A number in [0, 1) from the columns' values: 52 bits of an MD5, alike on every engine and rerun."""
    key = F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in columns))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def ranked(rows: DataFrame, order: list[Column], sums: dict[str, str], wide: bool) -> DataFrame:
    """Rows with ``_nth`` from 1 and, for each of ``sums``, the sum of that column over the rows before.

    ``wide``: rows are many, so they are dealt by ranges of the order, summed inside each
    range, and only the ranges' own sums, a row for each partition, meet in a task.
    """
    last = Window.unboundedPreceding
    if not wide:
        by = Window.orderBy(*order)
        return rows.withColumns({"_nth": F.row_number().over(by)} | {k: F.coalesce(F.sum(c).over(by.rowsBetween(last, -1)), F.lit(0)) for k, c in sums.items()})
    dealt = written(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    by = Window.partitionBy("_part").orderBy(*order)
    inside = dealt.withColumns({"_nth": F.row_number().over(by)} | {k: F.coalesce(F.sum(c).over(by.rowsBetween(last, -1)), F.lit(0)) for k, c in sums.items()})
    whole = dealt.groupBy("_part").agg(F.count("*").alias("_n"), *[F.sum(c).alias(f"_{k}") for k, c in sums.items()])
    before = Window.orderBy("_part").rowsBetween(last, -1)
    base = whole.select("_part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_base{c}") for c in ("_n", *(f"_{k}" for k in sums))])
    met = inside.join(base, "_part").withColumns({"_nth": F.col("_nth") + F.col("_base_n")} | {k: F.col(k) + F.col(f"_base_{k}") for k in sums})
    return met.drop("_part", "_base_n", *(f"_base_{k}" for k in sums))


def weighted_sources(sizes: DataFrame, cycle: int = 3, wide: bool = False) -> DataFrame:
    """(source, source_size) with weights 1 to ``cycle``, repeating, over the sources in code point order, null last."""
    numbered = ranked(sizes, [F.col("source").asc_nulls_last()], {}, wide)
    return numbered.withColumn("weight", ((F.col("_nth") - 1) % cycle + 1).cast("double")).drop("_nth")


def water_fill(weighted: DataFrame, most: float = 3.0, wide: bool = False) -> DataFrame:
    """Add ``target``: shares of all sizes by weight, none above ``most`` times its source's size.

    Sources fill up in the order of most * size / weight. If the first k are full,
    the others share what those leave by weight, so the level is that of the
    smallest k whose next source is not above its limit. ``wide`` as in ``ranked``.
    """
    full = F.lit(most) * F.col("source_size")
    filled = ranked(weighted.withColumn("fill", full / F.col("weight")), [F.col("fill"), F.col("source").asc_nulls_last()], {"taken_before": "source_size", "weight_before": "weight"}, wide)
    # two sums and one level are all that the driver sees of the sources
    total, weights = weighted.agg(F.sum("source_size"), F.sum("weight")).first()
    level = filled.withColumn("level", (F.lit(float(total or 0)) - F.lit(most) * F.col("taken_before")) / (F.lit(float(weights or 0)) - F.col("weight_before")))
    # the level that holds is the first that its own source stays at or under
    held = level.agg(F.min(F.when(F.col("level") <= F.col("fill"), F.struct("fill", "level")))).first()[0]
    target = F.least(full, F.lit(held.level) * F.col("weight")) if held else full
    return filled.withColumn("target", target).drop("fill", "taken_before", "weight_before", "_nth")


def mix(docs: DataFrame, sizes: Column, most: float = 3.0, cycle: int = 3, seed: int = 17, weights: DataFrame | None = None, broadcast_rows: int = 50_000) -> DataFrame:
    """Documents with size, source_size, target, rate and copies, the number of times that the mix takes each.

    ``weights`` (source, weight) replaces the repeating weights; sources that it
    lacks are not taken. Null text has size 0; a null source is a source of its own;
    a null id draws by its text; rows alike in id draw alike; without rows there is
    nothing to take. Columns of the input whose names clash with those added are
    replaced. Sources are ranked in one task, and their rates broadcast, only if they
    were counted to be at most ``broadcast_rows``; beyond that they are ranked by ranges
    and the rates joined by shuffling.
    """
    added = ("size", "source_size", "weight", "target", "rate", "copies")
    sized = docs.drop(*added).withColumn("size", sizes.cast("long"))
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = written(per, "sources")
    wide = per.count() > broadcast_rows  # else one task may rank them all
    if weights is None:
        per = weighted_sources(per, cycle, wide)
    else:
        w = weights.select(F.col("source").alias("_s"), F.col("weight").cast("double"))
        per = per.join(w, per.source.eqNullSafe(w._s)).drop("_s").where("weight > 0")
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(most))).otherwise(F.lit(0.0))
    rates = written(water_fill(per, most, wide).withColumn("rate", rate).withColumnRenamed("source", "_source"), "rates")
    rates = rates if wide else F.broadcast(rates)
    joined = sized.join(rates, sized.source.eqNullSafe(rates._source), "left").drop("_source", "weight").fillna({"rate": 0.0})
    text = [c for c in ("text", "source") if c in docs.columns]
    key = F.when(F.col("doc_id").isNull(), draw(seed, "doc_id", *text)).otherwise(draw(seed, "doc_id"))
    whole = F.floor("rate")
    return joined.withColumn("copies", (whole + F.when(key < F.col("rate") - whole, 1).otherwise(0)).cast("long"))


def emitted(mixed: DataFrame) -> DataFrame:
    """Each document as many times as it is taken."""
    return mixed.where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("_copy")


def word_count(text: str = "text") -> Column:
    """Number of words of whole texts; null: 0."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
