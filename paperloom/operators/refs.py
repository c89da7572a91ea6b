"""Resolution of references, and titles joined by likeness."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.text import tokens

# Likeness of titles from which a reference is resolved, and from which it is in the library.
RESOLVED, IN_LIBRARY = 0.82, 0.9


def from_printed(references: DataFrame) -> DataFrame:
    """References (ref) with ``resolved`` (source, id, url, confidence) from what is printed: an arXiv id, a DOI, a URL, in this order; null if there is none."""
    r = lambda c: F.col(f"ref.{c}")
    of = lambda ident, url, confidence: F.struct(F.lit("printed").alias("source"), ident.alias("id"), url.alias("url"), F.lit(confidence).alias("confidence"))
    found = F.when(r("arxiv_id").isNotNull(), of(r("arxiv_id"), F.concat(F.lit("https://arxiv.org/abs/"), r("arxiv_id")), 1.0)).when(r("doi").isNotNull(), of(r("doi"), F.concat(F.lit("https://doi.org/"), r("doi")), 0.95)).when(r("url").isNotNull(), of(r("url"), r("url"), 0.8))
    return references.withColumn("resolved", found)


#: Ids in one row of the list of those that have the same words.
IDS = 1024


def title_pairs(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(a, b, similarity) of titles (id, title) whose sets of words have a Jaccard similarity of at least ``least``.

    Sets of words are compared once, however many titles have them, and named by their sorted words. Prefix filter: each set offers only its rarest words, as many as a pair must share one of, so that frequent words,
    wherever they stand, build no buckets; sizes are compared before the sets. Ids meet last, those of the right side in lists, so pairs of ids are made where they leave and are never shuffled.
    """
    sets = lambda d: d.select("id", F.array_sort(F.array_distinct(tokens(F.col("title"), False))).alias("s")).where(F.size("s") > 0)
    x, y = sets(left), sets(right)
    xs, ys = x.groupBy("s").agg(F.count(F.lit(1)).alias("m")), y.groupBy("s").agg(F.count(F.lit(1)).alias("m"))
    df = xs.union(ys).select("m", F.explode("s").alias("w")).groupBy("w").agg(F.sum("m").alias("df"))

    def prefixes(d: DataFrame, name: str) -> DataFrame:
        each = d.select("s", F.size("s").alias("n"), F.explode("s").alias("w")).join(df, "w")
        ranked = each.withColumn("rn", F.row_number().over(Window.partitionBy("s").orderBy("df", "w")))
        return ranked.where(F.col("rn") <= F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1).select(F.col("s").alias(f"s{name}"), "w", F.col("n").alias(f"n{name}"))

    sized = prefixes(xs, "a").join(prefixes(ys, "b"), "w").where((F.col("na") >= F.col("nb") * least - 1e-9) & (F.col("nb") >= F.col("na") * least - 1e-9))
    alike = sized.select("sa", "sb", F.round(F.size(F.array_intersect("sa", "sb")) / F.size(F.array_union("sa", "sb")), 6).alias("similarity")).where(F.col("similarity") >= least).distinct()
    listed = y.join(ys, "s").groupBy(F.col("s").alias("sb"), F.pmod(F.xxhash64("id"), F.ceil(F.col("m") / IDS)).alias("_block")).agg(F.collect_list("id").alias("ids"))
    asked = alike.join(x.select(F.col("id").alias("a"), F.col("s").alias("sa")), "sa").select("a", "sb", "similarity")
    blocks = ys.select(F.col("s").alias("sb"), F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("m") / IDS) - 1)).alias("_block"))
    # few bytes become many rows, so the number of tasks is given and not made from sizes
    spark = left.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    met = asked.join(blocks, "sb").repartition(n, "sb", "_block").join(listed.repartition(n, "sb", "_block"), ["sb", "_block"])
    return met.select("a", F.explode("ids").alias("b"), "similarity")


def resolve(references: DataFrame, works: DataFrame, least: float = RESOLVED) -> DataFrame:
    """References (id, ref) with ``resolved``: printed identifiers first, and where no arXiv id is printed the most similar title of a catalogue ``works`` (id, source, url, title), arXiv's before others, if it is as like as ``least``.

    A printed DOI stays beside what the title found.
    """
    printed = from_printed(references)
    need = printed.where("ref.arxiv_id is null and ref.title is not null").select("id", F.col("ref.title").alias("title"))
    found = title_pairs(need, works.select("id", "title"), least).join(works.select(F.col("id").alias("b"), "source", "url"), "b")
    best = found.groupBy("a").agg(F.min_by(F.struct("source", F.col("b").cast("string").alias("id"), "url", F.col("similarity").alias("confidence")), F.struct(F.col("source") != "arxiv", -F.col("similarity"), "b")).alias("_t"))
    return printed.join(best, printed["id"] == best["a"], "left").withColumn("resolved", F.coalesce(F.when(F.col("ref.arxiv_id").isNotNull(), F.col("resolved")), "_t", "resolved")).drop("a", "_t")


def in_library(references: DataFrame, papers: DataFrame, least: float = IN_LIBRARY) -> DataFrame:
    """References (id, ref) with ``paper_id``, the newest paper (paper_id, arxiv_id, doi, title, created_at) that has its arXiv id, its DOI or a title above ``least``; ``can_add`` if there is none and it has an identifier.

    Three equi-joins, whose finds are ranked together.
    """
    r = references.select("id", F.col("ref.arxiv_id").alias("ax"), F.lower("ref.doi").alias("doi"), F.col("ref.title").alias("title"))
    newest = papers.select("paper_id", F.col("arxiv_id").alias("ax"), F.lower("doi").alias("doi"), "title", "created_at")
    by_arxiv = r.where("ax is not null").join(newest.where("ax != ''").select("paper_id", "ax", "created_at"), "ax").select("id", "paper_id", "created_at")
    by_doi = r.where("doi is not null").join(newest.where("doi != ''").select("paper_id", "doi", "created_at"), "doi").select("id", "paper_id", "created_at")
    alike = title_pairs(r.where("title is not null").select("id", "title"), newest.select(F.col("paper_id").alias("id"), "title"), least).where(F.col("similarity") > least)
    by_title = alike.join(newest.select(F.col("paper_id").alias("b"), "created_at"), "b").select(F.col("a").alias("id"), F.col("b").alias("paper_id"), "created_at")
    first = by_arxiv.union(by_doi).union(by_title).groupBy("id").agg(F.max_by("paper_id", F.struct("created_at", "paper_id")).alias("paper_id"))
    return references.join(first, "id", "left").withColumns({"in_library": F.col("paper_id").isNotNull(), "can_add": F.col("paper_id").isNull() & F.coalesce("ref.arxiv_id", "ref.doi", "ref.url").isNotNull()})
