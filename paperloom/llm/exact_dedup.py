"""Exact deduplication by 128-bit content hash, with a byte comparison inside each group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.runtime import Scratch, spread, table

SPACE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """The text without ASCII white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, "")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: which row of its group of equal texts stays.

    Texts are equal when they are identical without ASCII white space. Rows group by a 128-bit
    content hash (half of a SHA-256). In each hash group the least and the greatest text are
    compared byte by byte, which finds any collision; only then is a group split by its texts.
    Of each group the row whose original text has most code points stays, then the smallest id.

    Counts, extremes and winners are combined before the shuffle, so a group with a third of all
    rows sends one row per task; the join back to the rows is one that adaptive execution splits.

    Null texts count as empty, and all empty texts are one group. Ids are integers; a null id
    loses against any other. Rows that repeat an id and a text stand or fall together. An empty
    table gives an empty result. Other columns are ignored.
    Returns: the id column, keep_id, group_size, kept, text_sha256.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    rows = rows.select("_id", F.char_length("_text").alias("_n"), normalised(F.col("_text")).alias("_norm"))
    rows = rows.withColumn("_sha", F.unhex(F.sha2(F.encode("_norm", "UTF-8"), 256)))
    winner = F.max(F.struct("_n", F.bitwise_not("_id").alias("_rank"))).alias("_won")

    groups = rows.groupBy(F.substring("_sha", 1, 16).alias("_h")).agg(F.count(F.lit(1)).alias("_size"), winner, F.min("_norm").alias("_least"), F.max("_norm").alias("_most"))
    groups = groups.select("_h", F.lit(None).cast("binary").alias("_full"), "_size", F.bitwise_not("_won._rank").alias("_keep"), (F.col("_least") != F.col("_most")).alias("_collided"))
    groups = Scratch(groups, "exact-groups").df
    digests = rows.select("_id", "_sha", F.substring("_sha", 1, 16).alias("_h"))
    joined = digests.join(groups.where("not _collided").drop("_full"), "_h")
    if not groups.where("_collided").isEmpty():
        clashing = rows.withColumn("_h", F.substring("_sha", 1, 16)).join(groups.where("_collided").select("_h"), "_h", "left_semi")
        split = clashing.groupBy("_h", "_norm").agg(F.count(F.lit(1)).alias("_size"), winner).withColumn("_keep", F.bitwise_not("_won._rank"))
        joined = joined.unionByName(clashing.join(split, ["_h", "_norm"]).select("_h", "_id", "_sha", "_size", "_keep", F.lit(False).alias("_collided")))
    return joined.select(
        F.col("_id").alias(id_col),
        F.col("_keep").alias("keep_id"),
        F.col("_size").alias("group_size"),
        F.col("_id").eqNullSafe(F.col("_keep")).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
    )


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without rows that repeat another's id and text; texts are shuffled only if some id is repeated."""
    repeated = docs.groupBy(F.col(id_col).alias("_i")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return docs if repeated.isEmpty() else docs.dropDuplicates([id_col, text_col])


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that ``exact_groups`` keeps, with all their columns, and of rows that repeat an id and a text one."""
    docs = without_repeats(docs, id_col, text_col)
    gone = exact_groups(docs, id_col, text_col).where("not kept").select(F.col(id_col).alias("_gone"), F.col("text_sha256").alias("_gone_sha")).distinct()
    same = docs[id_col].cast("long").eqNullSafe(gone["_gone"]) & (F.sha2(F.encode(normalised(docs[text_col]), "UTF-8"), 256) == gone["_gone_sha"])
    return docs.join(gone, same, "left_anti")


def op3_exact_dedup(spark, sf_dir):
    """``exact_groups`` over all ``documents``."""
    return exact_groups(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents
), g AS (
  SELECT norm, count(*) AS group_size, max(n) AS most FROM d GROUP BY norm
), k AS (
  SELECT d.norm, min(d.doc_id) AS keep_id FROM d JOIN g ON d.norm = g.norm AND d.n = g.most GROUP BY d.norm
)
SELECT d.doc_id, k.keep_id, g.group_size, d.doc_id = k.keep_id AS kept, sha256(d.norm) AS text_sha256
FROM d JOIN g ON d.norm = g.norm JOIN k ON d.norm = k.norm
"""
