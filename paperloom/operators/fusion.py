"""Weights by the shape of a query, rank fusion, diversity, label pins, interleaving."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.scholarly import canonical_label, label_references
from paperloom.functions.vocabulary import any_of

# Sizes and constants of the ranking.
RRF_K, TOP_K, CANDIDATES, RERANK = 60, 12, 40, 8
CAP = 4
# Cues of questions that ask for a number, for a meaning, or for something to look at. A digit anywhere asks for a number too.
NUMBER_CUES = "how many/much/long/often, what score/value/number/rate/size/accuracy/f1/bleu/auc/p-value/percentage, equation, hyperparameter*, hyper-parameter*"
MEANING_CUES = "why, how does, explain, compare, implication*, intuition, motivat*, rationale, summar*, contribut*, novel*, limitation*"
SIGHT_CUES = "figure, fig #, fig. #, fig#, fig.#, chart, graph, plot, diagram, architecture, image, visuali*, show(n) in, depict*"
NUMERIC, CONCEPTUAL, VISUAL = rf"(?i)\d|\b{any_of(NUMBER_CUES)}", rf"(?i)\b{any_of(MEANING_CUES)}", rf"(?i)\b{any_of(SIGHT_CUES)}"


def leg_weights(c: Column) -> Column:
    """(lexical, dense, visual): numeric questions lean on words, conceptual ones on meaning."""
    text = F.coalesce(c, F.lit(""))
    numeric, conceptual = text.rlike(NUMERIC), text.rlike(CONCEPTUAL)
    lexical = F.when(numeric, 1.5).otherwise(1.0)
    return F.struct(
        F.when(conceptual, F.greatest(F.lit(0.6), lexical * 0.75)).otherwise(lexical).alias("lexical"),
        F.when(conceptual, 1.4).when(numeric, 0.85).otherwise(1.0).alias("dense"),
        F.when(text.rlike(VISUAL), 1.5).otherwise(0.7).alias("visual"),
    )


def rank_legs(legs: DataFrame) -> DataFrame:
    """(query_id, leg, doc_id, score) with the rank from 1 inside each query's leg, ties by document."""
    return legs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "leg").orderBy(F.desc("score"), "doc_id")).cast("long"))


def fuse(legs: DataFrame, weights: DataFrame | None = None, k: int = RRF_K, top: int | None = None) -> DataFrame:
    """Reciprocal rank fusion: (query_id, doc_id, score, legs, rank) from ranked legs (query_id, leg, doc_id, score, rank).

    ``weights`` has (query_id, leg, weight), 1 if none is given; legs of weight 0 or less don't count. Each document's sum is rounded to six places; ties go by document.
    """
    rows = legs.withColumn("weight", F.lit(1.0)) if weights is None else legs.join(weights, ["query_id", "leg"], "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    part = F.col("weight") / (F.lit(k) + F.col("rank"))
    each = F.map_from_entries(F.array_sort(F.collect_list(F.struct("leg", F.struct("rank", "score")))))
    fused = rows.where("weight > 0").groupBy("query_id", "doc_id").agg(F.round(F.sum(part), 6).alias("score"), each.alias("legs"))
    ranked = fused.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")).cast("long"))
    return ranked if top is None else ranked.where(F.col("rank") <= top)


def diversify(ranked: DataFrame, groups: list[str], cap: int = CAP, limit: int | None = None) -> DataFrame:
    """A ranking (query_id, rank) in which each group's first ``cap`` come in their order and the rest behind them; the new rank is ``rank``."""
    inside = F.row_number().over(Window.partitionBy("query_id", *groups).orderBy("rank"))
    marked = ranked.withColumn("_over", inside > cap)
    out = marked.withColumn("_new", F.row_number().over(Window.partitionBy("query_id").orderBy("_over", "rank")).cast("long")).drop("_over", "rank").withColumnRenamed("_new", "rank")
    return out if limit is None else out.where(F.col("rank") <= limit)


def pin_labels(ranked: DataFrame, chunks: DataFrame, queries: DataFrame, limit: int | None = None) -> DataFrame:
    """A ranking (query_id, doc_id, score, rank) with the chunks whose label a query names in front, at score 1.

    ``chunks`` has (doc_id, paper_id, ord, label), ``queries`` (query_id, text). Both spellings of a label count as one.

    Queries that name the same labels have the same pins in the same order, which is found once for them all. Only where the ranking itself decides between pins, as it does when a ranked one shares its place in its paper
    with another or is ranked twice, is a query's list made by itself.
    """
    ranked = ranked.select("query_id", "doc_id", "score", "rank")
    named = queries.select("query_id", F.explode(label_references(F.col("text"))).alias("_label")).distinct()
    labelled = chunks.where("label != ''").select("doc_id", canonical_label(F.col("label")).alias("_label"), F.struct("paper_id", "ord").alias("_at"))
    known = named.join(labelled.select("_label").distinct(), "_label", "left_semi")
    by_query = known.groupBy("query_id").agg(F.array_sort(F.collect_set("_label")).alias("_labels"))
    kinds = by_query.groupBy("_labels").agg(F.min("query_id").alias("_kind"))
    asked = by_query.join(kinds, "_labels").select("query_id", "_kind")

    met = ranked.groupBy("query_id", "doc_id").agg(F.count(F.lit(1)).alias("_n")).join(labelled.select("doc_id", "_label").distinct(), "doc_id").join(known, ["query_id", "_label"]).select("query_id", "doc_id", "_n").distinct()
    place = Window.partitionBy("_at")
    shared = labelled.select("doc_id", (F.min("doc_id").over(place) != F.max("doc_id").over(place)).alias("_shared")).where("_shared").select("doc_id").distinct()
    odd = met.where("_n > 1").unionByName(met.join(shared, "doc_id", "left_semi").select(*met.columns)).select("query_id").unionByName(by_query.where("query_id is null").select("query_id")).distinct().toDF("_odd")
    here = F.col("query_id").eqNullSafe(F.col("_odd"))

    # dealt by kind at once, so neither the first place of each chunk nor the order moves rows again
    lists = kinds.select("_kind", F.explode("_labels").alias("_label")).join(labelled, "_label").select("_kind", "doc_id", "_at").repartition("_kind").groupBy("_kind", "doc_id").agg(F.min("_at").alias("_at"))
    lists = lists.withColumn("_place", F.row_number().over(Window.partitionBy("_kind").orderBy("_at", "doc_id")).cast("long"))
    pinned = lists.join(asked.join(odd, here, "left_anti"), "_kind").select("query_id", "doc_id", F.lit(1.0).alias("score"), F.lit(True).alias("pinned"), F.col("_place").alias("rank"))
    pins = asked.join(lists.groupBy("_kind").agg(F.max("_place").alias("_pins")), "_kind").select("query_id", "_pins")
    others = ranked.join(met.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti").join(odd, here, "left_anti").withColumn("_rn", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "doc_id")).cast("long"))
    others = others.join(pins, "query_id", "left").select("query_id", "doc_id", "score", F.lit(False).alias("pinned"), (F.coalesce("_pins", F.lit(0)) + F.col("_rn")).alias("rank"))
    out = pinned.unionByName(others).unionByName(_pinned_each(ranked.join(odd, here, "left_semi"), labelled, named.join(odd, here, "left_semi")))
    return out if limit is None else out.where(F.col("rank") <= limit)


def _pinned_each(ranked: DataFrame, labelled: DataFrame, named: DataFrame) -> DataFrame:
    """``pin_labels`` with a list for each query: chunks (doc_id, _label, _at) and queries (query_id, _label)."""
    pins = labelled.join(named, "_label").groupBy("query_id", "doc_id").agg(F.min("_at").alias("_at"))
    rows = ranked.join(pins.select("query_id", "doc_id", "_at"), ["query_id", "doc_id"], "full")
    order = Window.partitionBy("query_id").orderBy(F.col("_at").isNull(), "_at", "rank", "doc_id")
    return rows.select("query_id", "doc_id", F.when(F.col("_at").isNotNull(), 1.0).otherwise(F.col("score")).alias("score"), F.col("_at").isNotNull().alias("pinned"), F.row_number().over(order).cast("long").alias("rank"))


def rerank(ranked: DataFrame, score: Column | None = None, top: int = RERANK) -> DataFrame:
    """A ranking ordered anew by a scorer over its rows, cut to ``top``; without a scorer it stays as it is."""
    if score is None:
        return ranked
    scored = ranked.withColumn("rerank_score", score)
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "rank")).cast("long")).where(F.col("rank") <= top)


def interleave(ranked: DataFrame, group: str) -> DataFrame:
    """Rankings of groups as one, a row of each group in turn, groups by their key; the new rank is ``rank``."""
    turn = F.row_number().over(Window.partitionBy("query_id", group).orderBy("rank"))
    return ranked.withColumn("_turn", turn).withColumn("_new", F.row_number().over(Window.partitionBy("query_id").orderBy("_turn", group)).cast("long")).drop("rank", "_turn").withColumnRenamed("_new", "rank")


def best_of_queries(hits: DataFrame) -> DataFrame:
    """Of the hits of several weighted queries (topic_id, query_no, weight, doc_id, score) each document once, with its best weighted score and the query that gave it, the first of ties."""
    weighted = F.round(F.col("score") * F.col("weight"), 6)
    return hits.withColumn("_s", weighted).groupBy("topic_id", "doc_id").agg(F.max("_s").alias("score"), F.max_by("query_no", F.struct("_s", -F.col("query_no"))).alias("query_no"))


def prefer(hits: DataFrame, preferred: Column, by: str = "topic_id") -> DataFrame:
    """Hits ranked with preferred ones first, then by score, then by document."""
    return hits.withColumn("preferred", preferred).withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("preferred"), F.desc("score"), "doc_id")).cast("long"))


def first_seen(legs: DataFrame) -> DataFrame:
    """The ids of several lists (query_id, leg_no, pos, doc_id), each once, in the order in which they are first seen."""
    first = legs.groupBy("query_id", "doc_id").agg(F.min(F.struct("leg_no", "pos")).alias("_at"))
    return first.select("query_id", "doc_id", F.row_number().over(Window.partitionBy("query_id").orderBy("_at")).cast("long").alias("pos"))
