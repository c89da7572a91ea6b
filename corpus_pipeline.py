"""From raw documents to packed sequences: filter by quality, drop exact and near copies, mix the sources, pack."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paperloom.llm.exact_dedup import drop_exact_copies
from paperloom.llm.mixing import in_mixed_order
from paperloom.llm.near_dup import drop_near_copies
from paperloom.llm.packing import pack, public_path
from paperloom.llm.quality import keep_good
from paperloom.runtime import Scratch, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score a half or more stay, with all columns.

    Null and empty texts all score alike, what the model says of a text without evidence; repeated rows stay or go together; null ids and clashing names (score) are kept as they are. An empty table gives an empty one.
    """
    return keep_good(spark, docs, sf_dir)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays, with all columns: the longest original, of ties the smallest id.

    Null, empty and blank texts are one group. Of rows that repeat an id and a text one stays. An empty table gives an empty one; clashing names (keep_id, kept) are kept as they are.
    """
    return drop_exact_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, with all columns: the one of the smallest id.

    Null and empty texts have no near copies and stay. Of rows that repeat an id and a text one stays, rows without an id stay. An empty table gives an empty one; other columns are kept as they are.
    """
    return drop_near_copies(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay, with all columns, laid out in the order of the mix: files of rising positions.

    Null sources are a source of their own; null ids, null and empty texts and repeated rows are placed like others. An empty table gives an empty one; clashing names (slot, position) are kept as they are.
    """
    return in_mixed_order(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 4096 ids, whose numbers follow the mix.

    A table read again comes in partitions by file size, so the order of the mix is made anew from the rows: it depends on them alone.
    Null and empty texts are one end id; repeated rows and null ids are packed like others. An empty table gives no pieces; other columns are ignored.
    """
    return pack(in_mixed_order(docs), public_path())


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("mixing", mixed), ("packing", packed)]

#: A learned score and a tokenizer's ids can't be had in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written and read again, and goes when the next one is there."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        kept = Scratch(stage(spark, docs, sf_dir), f"stage-{name}")
        if before:
            before.drop()
        docs, before = kept.df, kept
    return STAGES[-1][1](spark, docs, sf_dir)
