"""Searches made of the ranking operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.text import highlight
from paperloom.operators import fusion, lexical


def sparse_dense_search(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, score, rank) by inner products of sparse unit vectors (doc_id, slot, value): an equi-join on slots and a sum."""
    q = queries.select(F.col("doc_id").alias("query_id"), "slot", F.col("value").alias("_q"))
    scores = vectors.join(q, "slot").groupBy("query_id", "doc_id").agg(F.sum(F.col("value") * F.col("_q")).alias("score"))
    return lexical.top_k(scores.where("score > 0"), k)


def as_leg(ranked: DataFrame, name: str) -> DataFrame:
    return ranked.select("query_id", F.lit(name).alias("leg"), "doc_id", "score", "rank")


def weights_of(queries: DataFrame) -> DataFrame:
    """(query_id, leg, weight) of queries (query_id, text)."""
    w = queries.select("query_id", fusion.leg_weights(F.col("text")).alias("w"))
    legs = F.explode(F.array(*(F.struct(F.lit(leg).alias("leg"), F.col(f"w.{leg}").cast("double").alias("weight")) for leg in ("lexical", "dense", "visual"))))
    return w.select("query_id", legs.alias("x")).select("query_id", "x.leg", "x.weight")


def hybrid(legs: list[DataFrame], queries: DataFrame, chunks: DataFrame, top: int = fusion.TOP_K, candidates: int = fusion.CANDIDATES, cap: int | None = fusion.CAP, kinds: list[str] | None = None, sections: list[str] | None = None, pre_filter: bool = False, scorer: Column | None = None, pins: bool = True) -> DataFrame:
    """Ranked legs fused by the queries' weights, joined to their chunks, filtered, reranked, diversified by (paper, section), with named labels in front.

    ``chunks`` has (doc_id, paper_id, section, kind, ord, label). Filters apply after the cut of the fused list, so fewer than ``top`` may be left; ``pre_filter`` applies them before.
    """
    allowed = F.lit(True)
    if kinds is not None:
        allowed &= F.col("kind").isin(kinds)
    if sections is not None:
        allowed &= F.col("section").isin(sections)
    rows = legs[0]
    for leg in legs[1:]:
        rows = rows.unionByName(leg)
    meta = chunks.select("doc_id", "paper_id", "section", "kind")
    if pre_filter:
        rows = fusion.rank_legs(rows.drop("rank").join(meta.where(allowed).select("doc_id"), "doc_id", "left_semi"))
    cut = max(3 * top, candidates) if scorer is not None or cap else top
    fused = fusion.fuse(rows, weights_of(queries), top=cut)
    hits = fused.join(meta, "doc_id").where(allowed)
    hits = fusion.rerank(hits, scorer, max(top, fusion.RERANK))
    if cap:
        hits = fusion.diversify(hits, ["paper_id", "section"], cap)
    if pins:
        hits = fusion.pin_labels(hits, chunks, queries)
    return hits.where(F.col("rank") <= top)


def where_matched(needle: Column, text: Column, caption: Column | None = None, label: Column | None = None, ocr: Column | None = None, description: Column | None = None, grid: Column | None = None) -> Column:
    """Names of the parts that hold a needle, without regard to case; the body if none does."""
    low = F.lower(needle)
    has = lambda c, name: F.when(F.lower(F.coalesce(c, F.lit(""))).contains(low), F.lit(name))
    # What the parts are called.
    parts = [has(c, name) for c, name in ((text, "body"), (caption, "caption"), (label, "label"), (ocr, "text inside the figure"), (description, "figure description")) if c is not None]
    if grid is not None:
        parts.append(F.when(F.exists(F.flatten(grid), lambda x: F.lower(x).contains(low)), F.lit("table cell")))
    found = F.array_compact(F.array(*parts))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("body")))


def find_everywhere(rows: DataFrame, needles: DataFrame, text: str = "search_text", doc: str = "doc_id", block: int = 1000) -> DataFrame:
    """(query_id, doc_id and the columns of ``rows``) for every row whose text holds a needle literally, without regard to case.

    ``needles`` (query_id, needle). A needle's rarest token, by document frequency, picks the candidate rows through the inverted index, and the literal test decides. Needles without whole tokens inside are tested against all rows, in
    blocks of ``block`` needles, so a row is met once a block and only hits leave it.
    """
    low = rows.withColumn("_low", F.lower(F.col(text)))
    inner = F.regexp_extract_all(F.lower(F.col("needle")), F.lit(r"(?<=[^a-z0-9])[a-z0-9]+(?=[^a-z0-9])"), F.lit(0))
    asked = needles.select("query_id", F.lower("needle").alias("_needle"), F.array_distinct(inner).alias("_inner")).where("_needle != ''")
    words = low.select(F.col(doc).alias("_doc"), F.explode(F.array_distinct(F.regexp_extract_all("_low", F.lit("[a-z0-9]+"), F.lit(0)))).alias("_w"))
    terms = asked.select("query_id", "_needle", F.explode("_inner").alias("_w"))
    used = words.join(terms.select("_w").distinct(), "_w", "left_semi")
    df = used.groupBy("_w").agg(F.count(F.lit(1)).alias("_df"))
    rare = terms.join(df, "_w", "left").groupBy("query_id", "_needle").agg(F.min_by("_w", F.struct(F.coalesce("_df", F.lit(0)), "_w")).alias("_w"))
    candidates = used.join(rare, "_w").select("query_id", "_needle", "_doc")
    by_token = candidates.join(low, F.col("_doc") == F.col(doc)).where(F.col("_low").contains(F.col("_needle")))
    bare = asked.where(F.size("_inner") == 0).select("query_id", "_needle")
    out = by_token.drop("_doc")
    n = bare.count()
    if n:
        blocks = bare.groupBy(F.pmod(F.xxhash64("query_id", "_needle"), F.lit(-(-n // block))).alias("_block")).agg(F.collect_list(F.struct("query_id", "_needle")).alias("_needles"))
        hits = low.crossJoin(blocks.select("_needles")).withColumn("_hit", F.explode(F.filter("_needles", lambda x: F.col("_low").contains(x["_needle"]))))  # blocks, not needles
        out = out.unionByName(hits.withColumns({"query_id": F.col("_hit.query_id"), "_needle": F.col("_hit._needle")}).drop("_needles", "_hit"))
    return out.drop("_low", "_needle")


def find_by_kind(found: DataFrame, kind: str = "kind") -> DataFrame:
    """Number of matches of each query and kind."""
    return found.groupBy("query_id", kind).agg(F.count(F.lit(1)).alias("n"))


def snippets(hits: DataFrame, text: str, query: str, window: int = 220) -> DataFrame:
    """Hits with their snippets; to be run after the cut."""
    return hits.withColumn("snippets", highlight(F.col(text), F.col(query), window))


def in_given_order(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows of ``ids`` (id, pos) with their position."""
    return ids.join(rows, ids["id"] == rows[key]).drop("id").orderBy("pos")


def balanced(hits: DataFrame, per_paper: int) -> DataFrame:
    """Hits (query_id, paper_id, preferred, score, doc_id), the ``per_paper`` best of each paper, papers in turn."""
    inside = F.row_number().over(Window.partitionBy("query_id", "paper_id").orderBy(F.desc("preferred"), F.desc("score"), "doc_id"))
    return fusion.interleave(hits.withColumn("rank", inside.cast("long")).where(F.col("rank") <= per_paper), "paper_id")
