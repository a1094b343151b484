"""From raw documents to packed training sequences: the stages of a corpus run.

Every stage works on all rows its predecessor kept. All but the last return the columns of
documents; texts change in the substring stage only, and n_chars with them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from rowassay.llm import jaccard_join, mixing, packing, paragraph_dedup, quality
from rowassay.llm.shared import emptied, named, small_batches, written

TOKENIZER = "word_bpe_49k.json"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality trees reject go.

    Null, empty and short texts fail the base rules and go; repeated rows are judged each, whole
    texts however long. An empty table stays empty, as in every stage.
    """
    return quality.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that with the smallest id.

    Rows of one id are one document, that with the smallest text stays; null ids and documents
    without words stay as they are.
    """
    return jaccard_join.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Paragraphs an earlier document holds are cut out; documents of which nothing is left go.

    Texts that lose nothing, null and empty ones included, stay as they are. Rows equal in id and
    text lose the same passages; the passage with the smallest id, hash and place stays.
    """
    cut = paragraph_dedup.without_repeats(docs)
    left = cut.where("__gone = 0 OR text RLIKE '[^\\\\x20\\\\x09-\\\\x0D]'")
    count = F.length("text").cast(docs.schema["n_chars"].dataType)
    return left.withColumn("n_chars", F.when(F.col("__gone") > 0, count).otherwise(F.col("n_chars"))).select(*named(docs.columns))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice.

    Null sources are one source; rows of one id are taken together, null ids share one place.
    """
    taken = mixing.copies(docs, mixing.mix_plan(docs))
    return taken.withColumn("__turn", F.explode(F.array_repeat(F.lit(0), F.col("__copies")))).select(*named(docs.columns))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences; null and empty texts are one end id."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("source_mix", source_mix),
    ("packed_sequences", packed_sequences),
]
#: Trees, components and token ids cannot be said in SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage in turn over the documents; each is written and read again before the next.

    A stage's table is freed once the next one is written.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with small_batches(spark):
            docs, path = written(stage(spark, docs, sf_dir), name)
        if before is not None:
            emptied(spark, before)
        before = path
    return docs
