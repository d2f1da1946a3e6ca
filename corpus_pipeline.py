"""A corpus cleaned in five stages, each an operator of sedge.llm over all that its predecessor kept.

Each stage's result is written as Parquet and read again as the next one's documents. Within a stage rows are told
apart by a number of their own, so ids may repeat or be null and each row is judged by its own text. Texts of any length are
read whole; other columns may have any name and come through as they are; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedge.llm import decontaminate, neardup, personal, pieces, rules
from sedge.llm.durable import checkpointed, keyed, shared_dir, unused
from sedge.llm.queries import TOKENIZERS, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or their host's verdict reject go.

    Null and empty texts have no words and go. Rows without a source are judged alone. Repeated rows count each for
    their host, and stay or go together.
    """
    rows, key = keyed(docs)
    gone = rules.quality_rules(rows, id_col=key).where("NOT kept").select(F.col("doc_id").alias(key))
    return rows.join(gone, key, "left_anti").select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, 0.8) stays, one of the smallest id (null: last).

    Of rows of equal id the first row in the input stays, so of repeated rows one does. Null texts and texts without words
    are copies of nothing and stay; a text of fewer than five words is one shingle.
    """
    rows, key = keyed(docs)
    copies = checkpointed(neardup.near_duplicates(rows, words=5, id_col=key).where("NOT kept").select(F.col("doc_id").alias(key), "component_id"))
    heads = copies.select(F.col("component_id").alias(key), "component_id").distinct()
    members = copies.unionByName(heads)
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(key).alias("key"))
    stays = members.join(rows.select(key, "doc_id"), key).groupBy("component_id").agg(F.min(order).alias("first")).select(F.col("first.key").alias(key))
    gone = members.select(key).join(stays, key, "left_anti")
    return rows.join(gone, key, "left_anti").select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, within its error budget, go.

    Null and empty texts hold nothing and stay; items without text are not looked for; repeated rows go each.
    """
    rows, key = keyed(docs)
    gone = decontaminate.contaminated(rows, table(spark, sf_dir, "benchmark"), id_col=key).select(F.col("doc_id").alias(key)).distinct()
    return rows.join(gone, key, "left_anti").select(docs.columns)


def redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars follows the text.

    Null texts stay null. Of overlapping spans the first names the whole; repeated rows are changed alike.
    """
    rows, key = keyed(docs)
    spans = unused(rows, "spans")
    found = personal.find_personal(rows, id_col=key).where(F.size("spans") > 0).select(F.col("doc_id").alias(key), F.col("spans").alias(spans))
    text = personal.redacted(F.col("text"), F.coalesce(spans, F.array().cast(personal._SPANS)))
    clean = rows.join(found, key, "left").withColumn("text", text)
    return clean.withColumn("n_chars", F.length("text").cast("long") if "n_chars" in docs.columns else F.lit(None)).select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, exact of each row, repeated ones and null ids too.

    Null and empty texts have no ids. Of segmentations of equal score the one whose last pieces are longer counts.
    """
    return pieces.encode(docs, pieces.Vocabulary.read(f"{TOKENIZERS}/piece_bpe_32k.model"))


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("decontamination", decontamination), ("redaction", redaction), ("tokens", tokens)]

#: SQL has no SentencePiece.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents, through files in the shared folder."""
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{base}/{name}")
            docs = spark.read.parquet(f"{base}/{name}")
    return docs
