"""Lexical index and BM25 ranking, many queries at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.text import science_tokens
from paperloom.runtime import Scratch, spread

# Fixed values of the ranking function.
K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
FORMAT = "bm25-v1"


def postings(docs: DataFrame, text: str = "text", doc: str = "doc_id", scope: str | None = None) -> DataFrame:
    """(scope, doc_id, term, tf, len) of every document. Term counts are combined before the shuffle; a document's length is known before it is exploded."""
    toks = science_tokens(F.col(text))
    rows = docs.select(_scope(scope).alias("scope"), F.col(doc).alias("doc_id"), toks.alias("_toks")).select("scope", "doc_id", F.size("_toks").cast("long").alias("len"), F.explode("_toks").alias("term"))
    return rows.groupBy("scope", "doc_id", "term", "len").agg(F.count(F.lit(1)).alias("tf"))


def doc_stats(docs: DataFrame, text: str = "text", doc: str = "doc_id", scope: str | None = None) -> DataFrame:
    """(scope, doc_id, len), documents without tokens too."""
    return docs.select(_scope(scope).alias("scope"), F.col(doc).alias("doc_id"), F.size(science_tokens(F.col(text))).cast("long").alias("len"))


def _scope(scope: str | None) -> Column:
    return F.lit("all") if scope is None else F.col(scope).cast("string")


def corpus_stats(stats: DataFrame) -> DataFrame:
    """(scope, n_docs, avg_len): one row for each scope."""
    return stats.groupBy("scope").agg(F.count(F.lit(1)).alias("n_docs"), F.avg("len").alias("avg_len"))


def idf(n: Column, df: Column) -> Column:
    return F.greatest(F.log(1 + (n - df + 0.5) / (df + 0.5)), F.lit(IDF_FLOOR))


def term_stats(index: DataFrame, corpus: DataFrame) -> DataFrame:
    """(scope, term, df, idf)."""
    df = index.groupBy("scope", "term").agg(F.count(F.lit(1)).alias("df"))
    return df.join(corpus, "scope").select("scope", "term", "df", idf(F.col("n_docs"), F.col("df")).alias("idf"))


def query_terms(queries: DataFrame, text: str = "text", query: str = "item_id") -> DataFrame:
    """(query_id, term, qf)."""
    return queries.select(F.col(query).alias("query_id"), F.explode(science_tokens(F.col(text))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qf"))


def bm25_scores(queries: DataFrame, index: DataFrame, corpus: DataFrame) -> DataFrame:
    """(query_id, scope, doc_id, score) of all documents that share a term with a query. ``corpus`` has (scope, n_docs, avg_len).

    Terms of queries meet the index in an equi-join that adaptive execution can split; the index is reduced to terms that some query has before anything else
    is computed, and contributions are summed before the shuffle.
    """
    found = index.join(queries.select("term").distinct(), "term", "left_semi")
    terms = term_stats(found, corpus)
    scored = found.join(terms, ["scope", "term"]).join(corpus.select("scope", "avg_len"), "scope").join(queries, "term")
    tf, qf = F.col("tf").cast("double"), F.col("qf").cast("double")
    part = F.col("idf") * (qf * (K1 + 1) / (qf + K1)) * (tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.col("avg_len"))))
    return scored.groupBy("query_id", "scope", "doc_id").agg(F.sum(part).alias("score"))


def asked_index(docs: DataFrame, queries: DataFrame, text: str = "text", doc: str = "doc_id", scope: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(index, corpus): the postings of the terms of ``queries`` (query_id, term, qf), and (scope, n_docs, avg_len) of all documents, from one pass over ``docs``, whose texts are tokenised once.

    Each document gives a row without a term beside its tokens; tokens that no query has go before the shuffle if the queries' terms are few enough to be broadcast, which Spark decides by their size.
    What is left is a table in the shared folder, which both results read.
    """
    texts = spread(docs.select(_scope(scope).alias("scope"), F.col(doc).alias("doc_id"), F.col(text).alias("_text")))
    toks = texts.select("scope", "doc_id", science_tokens(F.col("_text")).alias("_toks"))
    rows = toks.select("scope", "doc_id", F.size("_toks").cast("long").alias("len"), F.explode(F.concat(F.array(F.lit("")), "_toks")).alias("term"))
    wanted = queries.select("term").distinct().unionByName(docs.sparkSession.createDataFrame([("",)], "term string"))
    kept = Scratch(rows.join(wanted, "term", "left_semi").groupBy("scope", "doc_id", "term", "len").agg(F.count(F.lit(1)).alias("tf")), "bm25").df
    corpus = kept.where("term = ''").groupBy("scope").agg(F.sum("tf").alias("n_docs"), (F.sum(F.col("len") * F.col("tf")) / F.sum("tf")).alias("avg_len"))
    return kept.where("term != ''"), corpus


def top_k(scores: DataFrame, k: int, by: list[str] | None = None) -> DataFrame:
    """The ``k`` best rows of each query, scores rounded to six places, ties by document; with their rank from 1. Ranks below k are cut before the shuffle."""
    order = Window.partitionBy(*(by or ["query_id"])).orderBy(F.desc("score"), "doc_id")
    return scores.withColumn("score", F.round("score", 6)).withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def bm25_search(docs: DataFrame, queries: DataFrame, k: int = 40, scope: str | None = None, doc: str = "doc_id", query: str = "item_id") -> DataFrame:
    """(query_id, scope, doc_id, score, rank): the ``k`` best documents of each query, and of each scope if documents are ranked within one."""
    asked = query_terms(queries, query=query)
    index, corpus = asked_index(docs, asked, doc=doc, scope=scope)
    return top_k(bm25_scores(asked, index, corpus), k, ["query_id"] + ["scope"] * (scope is not None))


def contains_term(index: DataFrame, term: str) -> DataFrame:
    """The documents that hold a term."""
    return index.where(F.col("term") == term).select("scope", "doc_id")


def save_index(index: DataFrame, path: str) -> None:
    """Postings with their format's version, laid out by a hash of the term so that a query reads few files."""
    index.withColumn("format", F.lit(FORMAT)).withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(64))).repartition("bucket").sortWithinPartitions("term").write.mode("overwrite").partitionBy("bucket").parquet(path)


def load_index(spark, path: str, terms: list[str] | None = None) -> DataFrame:
    """Postings of the known format; of ``terms`` only their buckets are read. Other formats give no rows."""
    index = spark.read.parquet(path).where(F.col("format") == FORMAT)
    if terms is not None:
        buckets = spark.range(1).select(F.explode(F.array(*(F.pmod(F.xxhash64(F.lit(t)), F.lit(64)) for t in terms))).alias("b")).distinct()
        index = index.where(F.col("bucket").isin([r["b"] for r in buckets.collect()]) & F.col("term").isin(terms))
    return index.drop("format", "bucket")
