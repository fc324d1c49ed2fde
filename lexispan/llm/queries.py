"""The queries opN_<name>, each an operator of this subpackage over its whole table, and their SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file; the folder is a parameter of the environment."""
    folder = os.environ.get("LEXISPAN_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return str(public_tokenizers.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexispan.llm.token_io import round_trip

    return round_trip(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), 1)


def op2_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexispan.llm.vector_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"), 0.9)


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexispan.llm.mixing import mix, word_count

    mixed = mix(table(spark, sf_dir, "documents"), word_count())
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexispan.llm.suffix_dedup import remove

    found = remove(table(spark, sf_dir, "documents"), 400)
    return found.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexispan.llm.simhash import classes

    found = classes(table(spark, sf_dir, "documents"), 4, 42, 4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexispan.llm.token_counts import encoded_lengths, histogram

    return histogram(encoded_lengths(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json")))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexispan.llm.quality import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), F.col("source"), F.concat(F.coalesce("source", F.lit("")), F.lit("/"), F.coalesce("lang", F.lit(""))))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexispan.llm.toxicity import score, train

    docs = table(spark, sf_dir, "documents")
    return score(docs.select("doc_id", "text"), train(docs, table(spark, sf_dir, "labels"))).select("doc_id", "held_out", "score", "predicted")


def op9_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexispan.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexispan.llm.ann import search

    rows = table(spark, sf_dir, "embeddings")
    return search(rows, rows.where("vec_id % 100 = 0"), 10)


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexispan.llm.centroids import cluster, told

    return told(*cluster(table(spark, sf_dir, "embeddings")))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexispan.llm.quality_rules import judge

    judged = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), F.col("lang"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexispan.llm.runs import digest, find

    return digest(find(table(spark, sf_dir, "documents"), stretch=True))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"op3_mix_sources": MIX_SQL, "op11_centroid_clusters": _cluster_sql()}


MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight FROM s
), f AS (
  SELECT *, 3.0::DOUBLE * source_size / weight AS fill, (sum(source_size) OVER ())::DOUBLE AS total FROM w
), l AS (
  SELECT *,
    (total - 3.0::DOUBLE * coalesce(sum(source_size) OVER (ORDER BY fill, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
      / sum(weight) OVER (ORDER BY fill, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM f
), h AS (SELECT arg_min(level, fill) AS level FROM l WHERE level <= fill
), t AS (
  SELECT l.source, l.source_size, coalesce(least(3.0::DOUBLE * l.source_size, h.level * l.weight), 3.0::DOUBLE * l.source_size) AS target FROM l, h
), r AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(target / source_size, 3.0::DOUBLE) ELSE 0.0::DOUBLE END AS rate FROM t
), x AS (
  SELECT d.doc_id, d.size, r.source_size, r.target, r.rate,
    ('0x' || substr(md5('17:' || d.doc_id::VARCHAR), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS u
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
)
SELECT doc_id, size, source_size, target,
  ((floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM x
"""


def _cluster_sql(k: int = 40, rounds: int = 5, components: int = 64, seed: int = 2) -> str:
    """Rounds written out one after another, each vector against all centroids; divisions are made exact before they are floored."""
    parts = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE len(embedding) = {components} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {components})""",
        "x AS MATERIALIZED (SELECT r, generate_subscripts(e, 1) AS d, unnest(e) AS x FROM v)",
        f"c0 AS MATERIALIZED (SELECT k, generate_subscripts(e, 1) AS d, unnest(e) AS y FROM (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), e) - 1 AS k, e FROM v) WHERE k < {k})",
    ]
    for i in range(rounds + 1):
        parts.append(f"a{i} AS MATERIALIZED (SELECT r, k, far FROM (SELECT r, k, sum((x - y) * (x - y))::BIGINT AS far FROM x JOIN c{i} USING (d) GROUP BY r, k) QUALIFY row_number() OVER (PARTITION BY r ORDER BY far, k) = 1)")
        if i < rounds:
            parts.append(f"m{i} AS (SELECT k, d, sum(x)::BIGINT AS s, count(*) AS n FROM x JOIN a{i} USING (r) GROUP BY k, d)")
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT k, d, CASE WHEN n IS NULL THEN y ELSE (s - ((s % n) + n) % n) // n END AS y FROM c{i} LEFT JOIN m{i} USING (k, d))")
    parts.append(f"h AS (SELECT k, sha256(string_agg(y::VARCHAR, ',' ORDER BY d)) AS centroid_sha256 FROM c{rounds} GROUP BY k)")
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, k::INT AS cluster, far AS distance, (sum(far) OVER (PARTITION BY k))::BIGINT AS cluster_inertia, (sum(far) OVER ())::BIGINT AS inertia, centroid_sha256 FROM a{rounds} JOIN v USING (r) JOIN h USING (k)"""
