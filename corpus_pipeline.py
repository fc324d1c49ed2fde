"""The training-data pipeline: five stages, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns that stages read or set; a table needs doc_id, text and source of them, and may have any others.
OWN = ("doc_id", "text", "lang", "source", "n_chars")


def _apart(docs: DataFrame, stage) -> DataFrame:
    """A stage over the table with its other columns under names that no operator uses; they come back as they were."""
    held = {c: f"_held_{i}" for i, c in enumerate(docs.columns) if c not in OWN}
    out = stage(docs.withColumnsRenamed(held))
    return out.select(*[F.col(held.get(c, c)).alias(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score does not reject, learnt from the labels beside the documents.

    Null and empty texts score as texts without a toxic window; without labels of both
    classes nothing is rejected; repeated rows, and rows without an id, are judged by
    their text each; no documents give none.
    """
    from lexispan.llm.toxicity import score, train

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _apart(docs, lambda d: score(d, train(d, labels)).where("predicted = 0"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: texts joined by pairs that share 0.8 of their 5-word shingles, each pair confirmed.

    The smallest id stays; of rows that share it, or have none, one. Null texts and
    texts without a word are one group, texts of fewer words than a shingle are told by
    all their words.
    """
    from lexispan.llm.simhash import similar_kept

    return _apart(docs, lambda d: similar_kept(d, 5, 42, 8, 0.8))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without 400-byte strings, and passages of 51 whole words, that start more than once; characters cut apart go whole.

    Null texts become empty, as texts do of which nothing is left; rows alike are
    copies of each other and lose all their repeats; n_chars, where there is one, is
    that of what is left.
    """
    from lexispan.llm.suffix_dedup import remove

    def left(d):
        out = remove(d, 400, as_text=True, words=51).withColumn("text", F.col("kept"))
        return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in d.columns else out

    return _apart(docs, left)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the number of copies that the target weights ask for.

    A null source is a source of its own; texts without a word, null ones too, come as often as
    their source's others; rows that share an id draw alike, those without draw by text.
    """
    from lexispan.llm.mixing import emitted, mix, word_count

    return _apart(docs, lambda d: emitted(mix(d, word_count())))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, placed in sequences of at most 1024 ids. Null and empty texts are the end id alone; repeated rows and rows without an id are packed each for itself."""
    from lexispan.llm.packing import pack
    from lexispan.llm.queries import vocabulary

    return pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_dedup", drop_near_copies),
    ("suffix_dedup", cut_repeats),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

#: Encoding, near-duplicate links and suffix comparison have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``."""
    from lexispan.llm.common import written

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
