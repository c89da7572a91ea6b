"""Queries over relational tables: library, notes, usage, storage, streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.operators import exports, library, storage
from paperloom.plans.registry import query
from paperloom.runtime import scratch_path, table
from paperloom.streaming import jobs


@query("collections_with_counts", "SELECT n_nationkey AS collection_id, n_name AS name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS n_papers FROM nation")
def collections_with_counts(spark, sf):
    """Nations as collections, with their customers as papers."""
    collections = table(spark, sf, "nation").select(F.col("n_nationkey").alias("collection_id"), F.col("n_name").alias("name"))
    papers = table(spark, sf, "customer").select(F.col("c_nationkey").alias("collection_id"))
    return library.collections_with_counts(collections, papers)


_NOTE = "SELECT o_orderkey AS note_id, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey END AS element_id, o_custkey % 1000 AS paper_id FROM orders"


@query(
    "notes_with_context",
    f"""SELECT note_id, n.element_id, n.paper_id, e.c_nationkey AS element_page, e.c_mktsegment AS element_kind, left(e.c_name, 280) AS element_text, p.p_name AS paper_title
FROM ({_NOTE}) n LEFT JOIN customer e ON e.c_custkey = n.element_id LEFT JOIN part p ON p.p_partkey = n.paper_id""",
)
def notes_with_context(spark, sf):
    """Notes with their element and paper, notes on whole papers too."""
    notes = table(spark, sf, "orders").select(F.col("o_orderkey").alias("note_id"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey")).alias("element_id"), (F.col("o_custkey") % 1000).alias("paper_id"))
    elements = table(spark, sf, "customer").select(F.col("c_custkey").alias("element_id"), F.col("c_nationkey").alias("page"), F.col("c_mktsegment").alias("kind"), F.col("c_name").alias("text"))
    papers = table(spark, sf, "part").select(F.col("p_partkey").alias("paper_id"), F.col("p_name").alias("title"))
    return library.notes_in_context(notes, elements, papers)


@query("note_counts", f"SELECT element_id, count(*) AS n FROM ({_NOTE}) WHERE element_id IS NOT NULL GROUP BY 1")
def note_counts(spark, sf):
    """Notes of each element."""
    return library.note_counts(table(spark, sf, "orders").select(F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey")).alias("element_id")))


@query("library_filter", "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus = 'O' AND contains(lower(coalesce(o_orderpriority, '')), 'urg')")
def library_filter(spark, sf):
    """Papers of a state with a needle in a column."""
    return library.filtered(table(spark, sf, "orders"), "URG", ("o_orderpriority",), o_orderstatus="O", o_custkey=None).select("o_orderkey", "o_orderstatus", "o_orderpriority")


@query("paging", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 100")
def paging(spark, sf):
    """The third page of fifty, newest first."""
    return library.page_of(table(spark, sf, "orders"), [F.desc("o_orderdate"), "o_orderkey"], 100, 50).select("o_orderkey", "o_custkey")


@query("default_row", "SELECT n_nationkey, n_name FROM nation ORDER BY n_nationkey LIMIT 1")
def default_row(spark, sf):
    """The collection that new papers go to."""
    return library.default_row(table(spark, sf, "nation").select("n_nationkey", "n_name"), "n_nationkey")


@query("element_counts", "SELECT l_orderkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL")
def element_counts(spark, sf):
    """Elements of each paper by kind."""
    return library.counts_by(table(spark, sf, "lineitem"), "l_orderkey", "l_returnflag")


@query(
    "outline_maps",
    """SELECT paper_id, what, key, count(*) AS n FROM (SELECT l_orderkey AS paper_id, 'kind' AS what, l_returnflag AS key FROM lineitem UNION ALL SELECT l_orderkey, 'section', l_linestatus FROM lineitem) GROUP BY ALL""",
)
def outline_maps(spark, sf):
    """Outlines, their maps as rows."""
    rows = library.outline(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("paper_id"), F.col("l_returnflag").alias("kind"), F.col("l_linestatus").alias("section")))
    side = lambda what: rows.select("paper_id", F.lit(what).alias("what"), F.explode(f"{what}_counts").alias("key", "n"))
    return side("kind").union(side("section"))


@query("composition_shares", "SELECT paper_id, kind, n, round(n / sum(n) OVER (PARTITION BY paper_id), 6) AS share FROM (SELECT l_orderkey AS paper_id, l_returnflag AS kind, count(*) AS n FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY ALL)")
def composition_shares(spark, sf):
    """Shares of two kinds in each paper."""
    return library.composition(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("paper_id"), F.col("l_returnflag").alias("kind")), ("A", "R"))


@query("first_of_each_section", "SELECT c_custkey, c_mktsegment, count(*) OVER (PARTITION BY c_mktsegment) AS group_size, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer QUALIFY rn <= 40")
def first_of_each_section(spark, sf):
    """The first forty of each section, with the section's size."""
    rows = library.first_of_each(table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal"), ["c_mktsegment"], [F.desc("c_acctbal"), "c_custkey"])
    return rows.select("c_custkey", "c_mktsegment", F.col("group_size").cast("long").alias("group_size"), "rn")


_STATE = "CASE o_orderkey % 4 WHEN 0 THEN 'unread' WHEN 1 THEN 'reading' WHEN 2 THEN 'read' ELSE 'rejected' END"


@query("read_state_counts", f"SELECT count(*) FILTER ({_STATE} = 'unread') AS unread, count(*) FILTER ({_STATE} = 'reading') AS reading, count(*) FILTER ({_STATE} = 'read') AS read, count(*) FILTER ({_STATE} = 'rejected') AS rejected, count(*) AS papers FROM orders")
def read_state_counts(spark, sf):
    """Papers by read state in one row."""
    return library.state_counts(table(spark, sf, "orders").select(F.expr(_STATE).alias("read_state")))


_PRICES = "(VALUES ('click', 0.5, 1.5), ('view', 0.1, 0.2), ('purchase', 3.0, 9.0)) AS m(model, in_per_mtok, out_per_mtok)"
_USAGE = "SELECT event_id, event_type AS model, user_id % 3 AS provider, event_id % 1000 AS input_tokens, event_id % 77 AS output_tokens, 1 AS units FROM events"


def _usage(spark, sf):
    u = table(spark, sf, "events").select("event_id", F.col("event_type").alias("model"), (F.col("user_id") % 3).alias("provider"), (F.col("event_id") % 1000).alias("input_tokens"), (F.col("event_id") % 77).alias("output_tokens"), F.lit(1).cast("long").alias("units"))
    prices = spark.createDataFrame([("click", 0.5, 1.5), ("view", 0.1, 0.2), ("purchase", 3.0, 9.0)], "model string, in_per_mtok double, out_per_mtok double")
    return library.priced(u, prices)


_PRICED = f"SELECT u.*, (input_tokens * coalesce(in_per_mtok, 0) + output_tokens * coalesce(out_per_mtok, 0)) / 1e6 AS cost_usd FROM ({_USAGE}) u LEFT JOIN {_PRICES} ON u.model = m.model"


@query("usage_cost", f"SELECT event_id, round(cost_usd, 9) AS cost_usd FROM ({_PRICED})")
def usage_cost(spark, sf):
    """The cost of each call; unknown models cost nothing."""
    return _usage(spark, sf).select("event_id", F.round("cost_usd", 9).alias("cost_usd"))


@query("usage_totals", f"SELECT count(*) AS calls, CAST(coalesce(sum(input_tokens), 0) AS BIGINT) AS input_tokens, CAST(coalesce(sum(output_tokens), 0) AS BIGINT) AS output_tokens, CAST(coalesce(sum(units), 0) AS BIGINT) AS units, round(coalesce(sum(cost_usd), 0), 4) AS cost_usd FROM ({_PRICED})")
def usage_totals(spark, sf):
    """All calls, tokens and dollars."""
    return library.usage_totals(_usage(spark, sf)).withColumn("cost_usd", F.round("cost_usd", 4))


@query("usage_by_model", f"SELECT provider, model, count(*) AS calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(units) AS BIGINT) AS units, round(sum(cost_usd), 4) AS cost_usd FROM ({_PRICED}) GROUP BY ALL ORDER BY calls DESC, provider, model LIMIT 50")
def usage_by_model(spark, sf):
    """Use by provider and model, most calls first."""
    return library.usage_by_model(_usage(spark, sf).withColumn("kind", F.lit("chat"))).drop("kind").withColumn("cost_usd", F.round("cost_usd", 4))


@query("thread_last_turns", "SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations QUALIFY back <= 6")
def thread_last_turns(spark, sf):
    """The last six turns of each conversation."""
    return library.last_turns(table(spark, sf, "conversations").select("conv_id", "turn", "role"), 6, "conv_id", "turn")


@query("bumped_threads", "SELECT conv_id AS thread_id, max(turn) AS updated_at FROM conversations GROUP BY 1")
def bumped_threads(spark, sf):
    """Threads with the place of their latest message."""
    c = table(spark, sf, "conversations")
    threads = c.select(F.col("conv_id").alias("thread_id")).distinct().withColumn("updated_at", F.lit(-1).cast("long"))
    return library.bumped_threads(threads, c.select(F.col("conv_id").alias("thread_id"), F.col("turn").alias("created_at"))).select("thread_id", "updated_at")


@query("orphan_blobs", "SELECT count(*) AS n, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes FROM (SELECT DISTINCT sha256(text) AS digest, strlen(text) AS size FROM documents) b WHERE digest NOT IN (SELECT sha256(text) FROM documents JOIN labels USING (doc_id))")
def orphan_blobs(spark, sf):
    """Texts as blobs: those that no labelled document uses, and their bytes."""
    docs = table(spark, sf, "documents")
    digest = F.sha2(F.encode("text", "UTF-8"), 256)
    blobs = docs.select(digest.alias("digest"), F.octet_length("text").cast("long").alias("size")).dropDuplicates(["digest"])
    used = docs.join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi").select(digest.alias("digest")).distinct()
    return storage.sweep_report(blobs, used)


@query("dedupe_by_hash", "SELECT sha256(text) AS file_hash, count(*) AS n FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0) GROUP BY 1")
def dedupe_by_hash(spark, sf):
    """What an ingest of the odd documents has left to do when the even ones are known, with how often each came."""
    docs = table(spark, sf, "documents").select("doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("file_hash"))
    odd = docs.where("doc_id % 2 = 1")
    left = library.not_yet(odd.select("file_hash"), docs.where("doc_id % 2 = 0"), "file_hash")
    return odd.join(left, "file_hash").groupBy("file_hash").agg(F.count(F.lit(1)).alias("n"))


@query("upsert_latest", "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1")
def upsert_latest(spark, sf):
    """The latest row of each user and kind from two halves of the table."""
    e = table(spark, sf, "events").select("user_id", "event_type", "event_id", "value")
    return library.upsert(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["user_id", "event_type"], "event_id")


@query("cascade_delete", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def cascade_delete(spark, sf):
    """Elements that stay when finished papers go."""
    return library.without(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"), table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey")


@query("deleted_count", "SELECT count(*) AS deleted FROM orders WHERE o_orderstatus = 'P'")
def deleted_count(spark, sf):
    """How many analyses a deletion takes."""
    return library.deleted_with_count(table(spark, sf, "orders"), F.col("o_orderstatus") == "P")[1]


_slug = "trim(regexp_replace(lower(strip_accents(c_mktsegment)), '[^a-z0-9]+', '-', 'g'), '-')"


@query("unique_slugs", f"SELECT c_custkey, CASE WHEN row_number() OVER (PARTITION BY {_slug} ORDER BY c_custkey) > 1 THEN {_slug} || '-' || row_number() OVER (PARTITION BY {_slug} ORDER BY c_custkey) ELSE {_slug} END AS slug FROM customer")
def unique_slugs(spark, sf):
    """A slug for each customer from its segment, numbered where it comes again."""
    return library.unique_slugs(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "c_custkey").select("c_custkey", "slug")


@query(
    "merged_catalogue",
    "WITH l AS (SELECT DISTINCT p_brand AS model FROM part), c AS (VALUES ('Brand#55', 1), ('Brand#11', 2), ('Brand#99', 3)) SELECT row_number() OVER (ORDER BY col1 IS NULL, col1, model) AS rank, model, col1 IS NOT NULL AS curated FROM l LEFT JOIN c AS t(col0, col1) ON col0 = model QUALIFY rank <= 12",
)
def merged_catalogue(spark, sf):
    """Curated brands that are there, then others, twelve in all."""
    curated = spark.createDataFrame([("Brand#55", 1), ("Brand#11", 2), ("Brand#99", 3)], "model string, pos int")
    return library.merged_catalogue(curated, table(spark, sf, "part").select(F.col("p_brand").alias("model")), 12)


@query("triage_update", "SELECT o_orderkey, CASE WHEN o_orderkey = 7 THEN 'read' ELSE 'unread' END AS read_state FROM orders")
def triage_update(spark, sf):
    """Papers after one of them was read."""
    papers = table(spark, sf, "orders").select(F.col("o_orderkey").alias("paper_id"), F.lit("unread").alias("read_state"), F.lit("").alias("verdict"))
    return library.set_triage(papers, 7, "read", "x" * 700).select(F.col("paper_id").alias("o_orderkey"), "read_state")


@query("replace_partition", "SELECT o_orderkey, CASE WHEN o_custkey % 10 = 0 THEN 'new' ELSE o_orderstatus END AS status FROM orders")
def replace_partition(spark, sf):
    """Elements of some papers replaced as a whole."""
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.col("o_orderstatus").alias("status"))
    return library.replaced(o, o.where("o_custkey % 10 = 0").withColumn("status", F.lit("new")), "o_custkey").select("o_orderkey", "status")


@query("union_of_digests", "SELECT DISTINCT d FROM (SELECT sha256(c_name) AS d FROM customer UNION ALL SELECT sha256(s_name) FROM supplier UNION ALL SELECT sha256(p_name) FROM part)")
def union_of_digests(spark, sf):
    """Digests of three tables, each once."""
    d = lambda t, c: table(spark, sf, t).select(F.sha2(F.encode(c, "UTF-8"), 256).alias("d"))
    return d("customer", "c_name").union(d("supplier", "s_name")).union(d("part", "p_name")).distinct()


@query("blob_paths", "SELECT page_id, left(sha256(html), 2) || '/' || substr(sha256(html), 3, 2) || '/' || sha256(html) AS path FROM pages")
def blob_paths(spark, sf):
    """Where each page's content is stored."""
    return table(spark, sf, "pages").select("page_id", storage.blob_path(F.sha2(F.encode("html", "UTF-8"), 256)).alias("path"))


@query("csv_lines", """SELECT c_custkey, '"' || replace(c_name || ', "' || c_mktsegment, '"', '""') || '",' || c_nationkey || chr(10) AS line FROM customer""")
def csv_lines(spark, sf):
    """Rows as lines of CSV."""
    grid = F.array(F.array(F.concat("c_name", F.lit(', "'), "c_mktsegment"), F.col("c_nationkey").cast("string")))
    return table(spark, sf, "customer").select("c_custkey", exports.grid_csv(grid).alias("line"))


_ROLLUP = "SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS calls, round(sum(value), 4) AS value FROM events GROUP BY ALL"


@query("usage_stream_rollup", _ROLLUP)
def usage_stream_rollup(spark, sf):
    """Calls by hour and kind, computed by a stream to its end, in complete mode."""
    schema = table(spark, sf, "events").schema
    source = scratch_path(spark, "stream-in")
    table(spark, sf, "events").write.parquet(source)
    stream = jobs.parquet_stream(spark, source, schema)
    out = scratch_path(spark, "stream-out")
    rows = jobs.usage_rollup(stream)
    writer = rows.writeStream.outputMode("complete").option("checkpointLocation", scratch_path(spark, "stream-state")).trigger(availableNow=True)
    writer.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(out)).start().awaitTermination()
    return spark.read.parquet(out).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("usage_batch_rollup", _ROLLUP)
def usage_batch_rollup(spark, sf):
    """The same by a batch."""
    return jobs.usage_rollup_batch(table(spark, sf, "events")).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(
    "user_sessions",
    """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM e)
SELECT user_id, min(ts) AS start_ts, count(*) AS events FROM s GROUP BY user_id, no""",
)
def user_sessions(spark, sf):
    """Sessions of users with gaps of half an hour."""
    return jobs.sessions(table(spark, sf, "events")).select("user_id", F.col("start").cast("timestamp_ntz").alias("start_ts"), "events")
