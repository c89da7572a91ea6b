"""The relational side: papers, collections, notes, threads, analyses, usage. Tables are DataFrames; a write gives the new table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.text import slugify
from paperloom.schemas import KINDS, NOTE_COLOURS, PAPER_STATES, READ_STATES, SECTIONS


# Reading.


def by_key(rows: DataFrame, **keys) -> DataFrame:
    """Rows with the given values: an equality that reaches the scan."""
    return rows.where(reduce(lambda a, b: a & b, (F.col(k) == F.lit(v) for k, v in keys.items()), F.lit(True)))


def filtered(papers: DataFrame, needle: str | None = None, columns: tuple[str, ...] = ("title", "abstract", "filename"), **equal) -> DataFrame:
    """Papers with the given values (None: any), and with the needle literally in one of the columns, without regard to case."""
    out = by_key(papers, **{k: v for k, v in equal.items() if v is not None})
    if needle:
        out = out.where(reduce(lambda a, b: a | b, (F.lower(F.coalesce(F.col(c), F.lit(""))).contains(needle.lower()) for c in columns)))
    return out


def elements_of(elements: DataFrame, kinds: list[str] | None = None, sections: list[str] | None = None, page: int | None = None, boxed: bool = False) -> DataFrame:
    out = elements
    if kinds:
        out = out.where(F.col("kind").isin(kinds))
    if sections:
        out = out.where(F.col("section").isin(sections))
    if page is not None:
        out = out.where(F.col("page") == page)
    return out.where("bbox is not null") if boxed else out


def search_elements(elements: DataFrame, needle: str, papers: list[int] | None = None, limit: int = 200) -> DataFrame:
    """Elements that hold a needle literally, by paper and place, at most ``limit``."""
    out = elements.where(F.lower("search_text").contains(needle.lower()))
    out = out if papers is None else out.where(F.col("paper_id").isin(papers))
    return out.orderBy("paper_id", "ord").limit(limit)


def page_of(rows: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    """A page of an ordered list."""
    return rows.orderBy(*order).offset(offset).limit(limit)


def default_row(rows: DataFrame, key: str) -> DataFrame:
    """The row with the smallest key, by an aggregate rather than a sort."""
    return rows.agg(F.min_by(F.struct(*rows.columns), key).alias("r")).where("r is not null").select("r.*")


def valid_rows(elements: DataFrame) -> DataFrame:
    """Elements whose unknown kinds and sections have become other and unknown."""
    known = lambda c, values, other: F.when(F.col(c).isin(values), F.col(c)).otherwise(F.lit(other)).alias(c)
    return elements.withColumns({"kind": known("kind", KINDS, "other"), "section": known("section", SECTIONS, "unknown")})


def outward(elements: DataFrame) -> DataFrame:
    """Elements as they are handed out: no search text, and an image only if it has a digest."""
    return elements.withColumn("image", F.when(F.coalesce(F.col("image.digest"), F.lit("")) != "", F.col("image"))).drop("search_text")


# Joins and sums.


def collections_with_counts(collections: DataFrame, papers: DataFrame) -> DataFrame:
    counts = papers.groupBy("collection_id").agg(F.count(F.lit(1)).alias("n_papers"))
    return collections.join(counts, "collection_id", "left").withColumn("n_papers", F.coalesce("n_papers", F.lit(0)).cast("long"))


def notes_in_context(notes: DataFrame, elements: DataFrame, papers: DataFrame) -> DataFrame:
    """Notes with their element's page, kind and first 280 characters, and their paper's title; notes on whole papers too."""
    e = elements.select("element_id", F.col("page").alias("element_page"), F.col("kind").alias("element_kind"), F.substring("text", 1, 280).alias("element_text"))
    return notes.join(e, "element_id", "left").join(papers.select("paper_id", F.col("title").alias("paper_title")), "paper_id", "left")


def counts_by(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def outline(elements: DataFrame) -> DataFrame:
    """(paper_id, counts by kind, counts by section) as maps."""
    both = elements.select("paper_id", F.explode(F.array(F.struct(F.lit("kind").alias("what"), F.col("kind").alias("key")), F.struct(F.lit("section").alias("what"), F.col("section").alias("key")))).alias("x")).groupBy("paper_id", "x.what", "x.key").agg(F.count(F.lit(1)).alias("n"))
    as_map = lambda what: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("what") == what, F.struct("key", "n"))))).alias(f"{what}_counts")
    return both.groupBy("paper_id").agg(as_map("kind"), as_map("section"))


def note_counts(notes: DataFrame) -> DataFrame:
    return counts_by(notes.where("element_id is not null"), "element_id")


def composition(elements: DataFrame, kinds: tuple[str, ...] = ("paragraph", "table", "figure", "formula", "reference")) -> DataFrame:
    """(paper_id, kind, n, share) of five kinds; shares of all elements of the paper that are of these kinds."""
    rows = counts_by(elements.where(F.col("kind").isin(*kinds)), "paper_id", "kind")
    return rows.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("paper_id")), 6))


def first_of_each(rows: DataFrame, groups: list[str], order: list, most: int = 40) -> DataFrame:
    """Rows of each group up to ``most``, with the group's size. Ranks are cut and sizes combined before their shuffles, so a large group isn't one task's."""
    ranked = rows.withColumn("rn", F.row_number().over(Window.partitionBy(*groups).orderBy(*order)).cast("long")).where(F.col("rn") <= most)
    sizes = rows.groupBy(*(F.col(g).alias(f"_size_{g}") for g in groups)).agg(F.count(F.lit(1)).alias("group_size"))
    same = [ranked[g].eqNullSafe(sizes[f"_size_{g}"]) for g in groups]
    return ranked.join(sizes, same).select(*(ranked[c] for c in rows.columns), "group_size", "rn")


def state_counts(papers: DataFrame) -> DataFrame:
    """One row: papers by read state."""
    return papers.agg(*(F.count_if(F.col("read_state") == s).alias(s) for s in READ_STATES), F.count(F.lit(1)).alias("papers"))


# Usage.

# Dollars for a million tokens in and out, by model family.
PRICES = [("small", 0.15, 0.60), ("medium", 1.00, 3.00), ("large", 5.00, 15.00)]


def priced(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Usage rows with ``cost_usd`` from (model, in_per_mtok, out_per_mtok); unknown models cost nothing."""
    cost = (F.col("input_tokens") * F.coalesce("in_per_mtok", F.lit(0.0)) + F.col("output_tokens") * F.coalesce("out_per_mtok", F.lit(0.0))) / 1e6
    return usage.drop("cost_usd").join(prices, "model", "left").withColumn("cost_usd", cost).drop("in_per_mtok", "out_per_mtok")


def usage_totals(usage: DataFrame, *keys: str) -> DataFrame:
    """Calls, tokens, units and cost: of all rows (one row even for none) or by keys."""
    total = lambda c, zero: F.coalesce(F.sum(c), F.lit(zero)).alias(c)
    return usage.groupBy(*keys).agg(F.count(F.lit(1)).alias("calls"), total("input_tokens", 0), total("output_tokens", 0), total("units", 0), total("cost_usd", 0.0))


def usage_by_model(usage: DataFrame, limit: int = 50) -> DataFrame:
    return usage_totals(usage, "provider", "model", "kind").orderBy(F.desc("calls"), "provider", "model", "kind").limit(limit)


def merged_catalogue(curated: DataFrame, live: DataFrame, most: int, exclude: str = r"(?i)embed|whisper|tts|image|moderation|guard|rerank") -> DataFrame:
    """Curated models that are live, in their order, then other live chat models by name, ``most`` in all. (model, pos) and (model)."""
    there = live.where(~F.col("model").rlike(exclude)).select("model").distinct()
    known = curated.join(there, "model").select("model", F.lit(0).alias("_g"), "pos")
    others = there.join(curated.select("model"), "model", "left_anti").select("model", F.lit(1).alias("_g"), F.lit(0).alias("pos"))
    order = Window.orderBy("_g", "pos", "model")
    return known.union(others).orderBy("_g", "pos", "model").limit(most).withColumn("rank", F.row_number().over(order).cast("long")).select("rank", "model", (F.col("_g") == 0).alias("curated"))


# Writing.


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Old and new rows, of each key the one with the greatest ``order``; of ties the new one."""
    rows = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    best = Window.partitionBy(*keys).orderBy(F.desc(order), F.desc("_new"))
    return rows.withColumn("_rn", F.row_number().over(best)).where("_rn = 1").drop("_rn", "_new")


def not_yet(new: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """New rows whose key isn't known, each key once: what an idempotent ingest has left to do."""
    return new.dropDuplicates([key]).join(known.select(key), key, "left_anti")


def replaced(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """A table in which all rows of the new rows' keys are replaced."""
    return table.join(rows.select(key).distinct(), key, "left_anti").unionByName(rows)


def overwrite_partitions(rows: DataFrame, path: str, key: str) -> None:
    """The same on disk: partitions of the keys that come are replaced as a whole, others stay."""
    rows.repartition(key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def updated(table: DataFrame, where: Column, stamp: str | None = "updated_at", **values) -> DataFrame:
    """A table whose matching rows have new values, and the time in ``updated_at``."""
    changes = {k: F.when(where, v if isinstance(v, Column) else F.lit(v)).otherwise(F.col(k)) for k, v in values.items()}
    if stamp in table.columns:
        changes[stamp] = F.when(where, F.current_timestamp()).otherwise(F.col(stamp))
    return table.withColumns(changes)


def set_triage(papers: DataFrame, paper_id: int, read_state: str | None = None, verdict: str | None = None) -> DataFrame:
    """Papers with a read state and a verdict of at most 600 characters; unknown states are an error."""
    if read_state is not None and read_state not in READ_STATES:
        raise ValueError(f"read_state is one of {READ_STATES}")
    values = {k: v for k, v in (("read_state", read_state), ("verdict", None if verdict is None else verdict[:600])) if v is not None}
    return updated(papers, F.col("paper_id") == paper_id, **values)


def set_status(papers: DataFrame, paper_id: int, status: str, detail: str = "") -> DataFrame:
    if status not in PAPER_STATES:
        raise ValueError(f"status is one of {PAPER_STATES}")
    return updated(papers, F.col("paper_id") == paper_id, status=status, status_detail=detail)


def clean_notes(notes: DataFrame) -> DataFrame:
    """Notes with bodies trimmed to 4000 characters and known colours."""
    return notes.withColumns({"body": F.substring(F.trim("body"), 1, 4000), "colour": F.when(F.col("colour").isin(NOTE_COLOURS), F.col("colour")).otherwise(F.lit(NOTE_COLOURS[0]))})


def unique_slugs(names: DataFrame, name: str, order: str, per_bucket: int = 100_000) -> DataFrame:
    """Names with a slug each, no two alike: in the order of ``order`` the first of a base gets the base itself and each later one -2, -3 ... in turn, but for numbers that make the base of another name.

    Names of one base are counted in ranges of ``order``, so a base of very many names isn't one task's.
    """
    rows = names.withColumn("_base", slugify(F.col(name)))
    total = rows.count()
    parts = max(1, -(-total // per_bucket))
    cuts = rows.select(F.percentile_approx(order, [k / parts for k in range(1, parts)], 10_000).alias("q")).first()["q"] if parts > 1 else []
    rows = rows.withColumn("_part", sum(((F.col(order) > F.lit(q)).cast("int") for q in sorted(set(cuts or []))), F.lit(0)))
    counts = rows.groupBy("_base", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_base").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("_base", "_part", F.coalesce(before, F.lit(0)).alias("_before"))
    # numbers that are taken: bases that end in -k, by what stands before it
    ending = counts.select("_base").distinct().select(F.regexp_extract("_base", "^(.+)-([1-9][0-9]{0,17})$", 1).alias("_base"), F.regexp_extract("_base", "^(.+)-([1-9][0-9]{0,17})$", 2).try_cast("long").alias("_k"))
    taken = ending.where("_base != '' and _k > 1").groupBy("_base").agg(F.sort_array(F.collect_set("_k")).alias("_taken"))
    inside = F.row_number().over(Window.partitionBy("_base", "_part").orderBy(order))
    placed = rows.withColumn("_in", inside).join(starts, ["_base", "_part"]).join(taken, "_base", "left").withColumn("_number", F.col("_before") + F.col("_in"))
    # the n-th free number: one more for each taken one that isn't greater
    free = F.aggregate(F.coalesce("_taken", F.expr("cast(array() as array<bigint>)")), F.col("_number").cast("long"), lambda n, k: F.when(k <= n, n + 1).otherwise(n))
    return placed.withColumn("slug", F.when(F.col("_number") > 1, F.concat("_base", F.lit("-"), free.cast("string"))).otherwise(F.col("_base"))).select(*names.columns, "slug")


def without(table: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """A table without the rows of the keys that go; for a cascade it is applied to every child table."""
    return table.join(gone.select(key).distinct(), key, "left_anti")


def deleted_with_count(table: DataFrame, where: Column) -> tuple[DataFrame, DataFrame]:
    """The rows that stay, and a row with the number that go."""
    gone = F.coalesce(where, F.lit(False))
    return table.where(~gone), table.agg(F.count_if(gone).alias("deleted"))


def bumped_threads(threads: DataFrame, messages: DataFrame) -> DataFrame:
    """Threads whose ``updated_at`` is their latest message's time."""
    last = messages.groupBy("thread_id").agg(F.max("created_at").alias("_last"))
    return threads.join(last, "thread_id", "left").withColumn("updated_at", F.greatest("updated_at", "_last")).drop("_last")


def threads_of(threads: DataFrame, collection_id: int | None = None, paper_id: int | None = None) -> DataFrame:
    out = by_key(threads, **{"collection_id": collection_id} if collection_id is not None else {})
    return out.where((F.col("paper_id") == paper_id) | F.array_contains("paper_ids", paper_id)) if paper_id is not None else out


def last_turns(messages: DataFrame, n: int = 6, thread: str = "thread_id", order: str = "message_id") -> DataFrame:
    """The last ``n`` messages of each thread, with ``back``, 1 for the last."""
    return messages.withColumn("back", F.row_number().over(Window.partitionBy(thread).orderBy(F.desc(order))).cast("long")).where(F.col("back") <= n)
