"""From raw documents to packed training sequences.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame. ``run`` writes each stage's result as Parquet to
the shared folder and reads it again for the next one. All stages but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm import decontaminate, minhash, packing, paragraphs, ppm
from siftline.llm.queries import byte_vocabulary
from siftline.llm.tokens import crc_remainder, place, renamed, restored
from siftline.session import stage

#: Texts whose language is less likely than this are rejected.
LEAST_SCORE = 0.5


def _counted(before: DataFrame, docs: DataFrame) -> DataFrame:
    """``n_chars`` follows the text where the table has that column."""
    if "n_chars" not in docs.columns:
        return docs
    count = F.char_length("text").cast(before.schema["n_chars"].dataType)
    return docs.withColumn("n_chars", F.coalesce(count, "n_chars")).select(*before.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter; all other rows stay as they are.

    ``LEAST_SCORE`` rejects hardly more than these: the posterior of any text of several words is near 1, so gibberish,
    encoded data and languages not learnt stay.

    The languages are learnt from labelled rows, without those whose id is held out. If no row is labelled there is
    nothing to reject by, and all texts with a letter stay.
    """
    labelled = docs.where(crc_remainder("doc_id", 5) != 0).select("text", "lang")
    tree = ppm.fit(labelled)
    if not tree.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    rows = renamed(docs)
    found = ppm.identify(rows, tree, rows.columns, place(docs, "text"))
    kept = found.where((F.col("lang_pred") != ppm.UNDETERMINED) & (F.col("score") >= LEAST_SCORE))
    return restored(kept, docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group that five-word shingles link at 80 percent or more."""
    return minhash.drop_near_duplicates(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts all but the first occurrence of repeated passages out of the texts; no row goes."""
    return _counted(docs, paragraphs.remove_repeats(docs))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts the passages of the benchmark out of the texts; no row goes."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _counted(docs, decontaminate.decontaminate(docs, benchmark))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, each with its place in a sequence of at most 1024 tokens."""
    cut = packing.pieces(docs, byte_vocabulary(), with_ids=False).drop("ids")
    return packing.pack(cut, n_pieces=packing.expected_pieces(docs))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_passages", benchmark_passages),
    ("packed_sequences", packed_sequences),
]

#: No SQL expresses these stages; they are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of what the stages keep of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs
