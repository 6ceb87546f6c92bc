"""The corpus pipeline: five stages, each written as Parquet and read again.

Every stage takes documents with the columns doc_id, text and source, nulls in
any of them, and whatever other columns there are, under any names: all but the
last return the columns they got.  Null and empty texts fail the quality rules.
An empty table gives an empty result.  Repeated rows are copies of one another:
near-duplicate detection keeps one.  Very long texts are judged, cut and encoded
whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstat.llm import bpe, mixing, near_dedup, quality_rules, suffix_dedup
from quillstat.llm.common import release, tables_made, written


def _field(struct: str, name: str) -> Column:
    return F.col(struct).getField(name).alias(name)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects; null and empty texts are rejected."""
    return docs.where(quality_rules.rejection(docs).isNull())


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: that of the least id, a null id only where there is no other.

    Of rows that repeat an id one is kept.  Texts without a word link with nothing.
    """
    rows = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    found = near_dedup.near_duplicates(rows, carry=["doc"]).where("representative")
    return found.select(*[_field("carried_doc", c) for c in docs.columns])


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the byte strings that an earlier one holds; n_chars, where there is one, follows the text.

    Documents of which nothing stays are gone.  Null ids lose nothing.
    """
    rows = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("doc"))
    cut = suffix_dedup.remove_repeats(rows, with_text=True, carry=["doc"]).where("text <> '' OR n_removed = 0")
    # a null text stays null: only a text that lost something is another
    new = {"text": F.col("text").alias("text"), "n_chars": F.length("text").cast(docs.schema["n_chars"].dataType).alias("n_chars") if "n_chars" in docs.columns else None}
    return cut.select(*[new[c] if c in new else _field("doc", c) for c in docs.columns])


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: whole epochs as repeated rows; documents without a word are never taken."""
    rows = docs.select("doc_id", "source", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    mixed = mixing.mix(rows, carry=["doc"])
    times = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(F.lit(0)).cast("int")
    return mixed.select("doc", F.explode(F.array_repeat(F.lit(0), times))).select(*[_field("doc", c) for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids; a null text has none."""
    return bpe.encode_documents(docs)


STAGES = [("quality rules", quality), ("near duplicates", near_duplicates), ("suffix array", repeated_strings), ("mixing", mixture), ("bpe", encode)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage's rows are written into the shared folder and read again.

    A stage's working tables and its predecessor's rows are deleted once its own
    rows are written.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        first = tables_made() - (i > 0)
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"stage{i}")
            release(spark, first, tables_made() - 1)
    return docs
