"""Queries on tables on which they failed before, against their SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.functions.scholarly import canonical_label, label_references
from paperloom.operators import dense, fusion, hashing
from paperloom.plans.catalogue import ORACLE_SQL, QUERIES


@pytest.fixture
def against_sql(spark, tmp_path):
    """Runs a query on tables given as DuckDB SQL: its rows and those of its SQL, sorted."""

    def run(name: str, **tables: str):
        con = duckdb.connect()
        for t, sql in tables.items():
            con.execute(f"COPY ({sql}) TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
        found = con.execute(ORACLE_SQL[name])
        columns = [d[0] for d in found.description]
        want = found.fetchall()
        got = [tuple(r[c] for c in columns) for r in QUERIES[name](spark, str(tmp_path)).collect()]
        order = lambda rows: sorted(rows, key=repr)
        return order(got), order(want)

    return run


def test_references_keep_apart_beyond_a_hundred_thousand_keys(against_sql):
    got, want = against_sql("references_in_library", part="SELECT (i // 24) * 100000 + i % 24 AS p_partkey, 'large ring' AS p_name FROM range(72) t(i)", customer="SELECT i AS c_custkey FROM range(10) t(i)")
    assert got == want


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _most(df, metric: str) -> int:
    """The largest value of a metric of any operator while the query runs."""
    df.write.format("noop").mode("overwrite").save()
    sc = df.sparkSession.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    store = df.sparkSession._jsparkSession.sharedState().statusStore()
    last = store.executionsList().last()
    ids = [m.accumulatorId() for m in (last.metrics().apply(k) for k in range(last.metrics().size())) if m.name() == metric]
    values = store.executionMetrics(last.executionId())
    return max(int(values.apply(k).replace(",", "")) for k in ids if values.contains(k))


def test_features_are_counted_where_their_text_is(spark, against_sql):
    docs = "SELECT * FROM (VALUES (1, 'Deep nets, deep nets and 😀 smiles'), (2, ''), (3, NULL), (1, 'deep nets again'), (4, 'abc'), (5, repeat('many words go here ', 300))) t(doc_id, text)"
    got, want = against_sql("hashed_vectors", documents=docs)
    assert got == want and len(got) == 3
    plan = _plan(dense.hashed_features(spark.createDataFrame([(1, "a text")], "doc_id long, text string")))
    assert plan.count("Exchange") == 1 and "Aggregate" not in plan


def test_texts_are_normalised_alike(spark):
    texts = ["  Ünï\tcödé  ﬁne … ½ ΑΣ ŉ ", "a\x1cb\x85c\u3000d", "", None, "Ḿixed\nCASE", "\x1f x \u200b", "😀 A"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", T.normalise_text(F.col("t")).alias("n")).orderBy("k").collect()
    assert [r["n"] for r in rows] == [hashing.normalised(t) for t in texts]


def test_balanced_hits_meet_once_a_kind(spark, against_sql, tmp_path):
    keys = "SELECT i * 37 % 6000 AS {0} FROM range({1}) t(i) UNION ALL SELECT * FROM (VALUES (3), (3), (28), (NULL), (-4), (-29), (-29)) o({0})"
    got, want = against_sql("balanced_hits", supplier=keys.format("s_suppkey", 40), part=keys.format("p_partkey", 6000))
    assert got == want
    big = str(tmp_path / "big")
    for name, key, n in (("supplier", "s_suppkey", 2000), ("part", "p_partkey", 20000)):
        spark.range(n).withColumnRenamed("id", key).write.parquet(f"{big}/{name}.parquet")
    assert _most(QUERIES["balanced_hits"](spark, big), "number of output rows") < 1_000_000  # of 1.6 million pairs


def _pins(spark, per_query):
    """A ranking with two chunks at one place, chunks of two labels, one that is ranked twice, and queries that name the same."""
    chunks = spark.createDataFrame([(1, 1, 1, "Table 1"), (2, 1, 1, "tab. 1"), (3, 1, 0, "Figure 2"), (3, 2, 0, "Table 1"), (4, 1, 2, "fig. 2"), (5, 1, 3, ""), (6, 0, 9, "Figure 2")], "doc_id long, paper_id long, ord long, label string")
    queries = spark.createDataFrame([(1, "see Table 1"), (2, "Table 1 and Figure 2"), (3, "figure 2, table 1"), (4, "nothing"), (5, "figure 9"), (6, "fig 2"), (7, "Fig. 2"), (8, "table 1")], "query_id long, text string")
    ranked = spark.createDataFrame([(1, 2, 0.9, 1), (1, 9, 0.8, 2), (2, 4, 0.9, 1), (2, 8, 0.8, 2), (2, 7, 0.7, 3), (4, 1, 0.9, 1), (5, 5, 0.5, 1), (6, 4, 0.9, 1), (6, 4, 0.8, 2), (7, 9, 0.9, 1), (10, 3, 0.9, 1)], "query_id long, doc_id long, score double, rank long")
    if not per_query:
        return fusion.pin_labels(ranked, chunks, queries)
    named = queries.select("query_id", F.explode(label_references(F.col("text"))).alias("_label")).distinct()
    return fusion._pinned_each(ranked, chunks.where("label != ''").select("doc_id", canonical_label(F.col("label")).alias("_label"), F.struct("paper_id", "ord").alias("_at")), named)


def test_pins_of_like_queries_are_each_querys_own(spark, against_sql):
    got, want = (sorted(map(tuple, _pins(spark, x).collect())) for x in (False, True))
    assert got == want and len(got) == 30
    got, want = against_sql("label_pin", part="SELECT i AS p_partkey FROM range(4000) t(i)", supplier="SELECT CASE WHEN i < 150 THEN i ELSE i + 8580 END AS s_suppkey FROM range(300) t(i)")
    assert got == want


def test_pins_are_not_sorted_for_each_query(spark, tmp_path):
    for name, key, n, step in (("supplier", "s_suppkey", 2000, 8730), ("part", "p_partkey", 20000, 1)):
        spark.range(n).select((F.col("id") * step).alias(key)).write.parquet(f"{tmp_path}/{name}.parquet")
    assert _most(QUERIES["label_pin"](spark, str(tmp_path)), "shuffle records written") < 100_000  # of 310,000 pins


def test_pairs_of_like_titles_are_not_shuffled(spark, against_sql, tmp_path):
    names = "CASE i % 9 WHEN 0 THEN 'A b c d e' WHEN 1 THEN 'e D, c b a' WHEN 2 THEN 'a b c d e f' WHEN 3 THEN 'x' WHEN 4 THEN NULL WHEN 5 THEN '?' WHEN 6 THEN 'a b c d' ELSE concat('part ', i // 18) END"
    got, want = against_sql("title_similarity_join", part=f"SELECT CASE WHEN i = 77 THEN 80 ELSE i END AS p_partkey, {names} AS p_name FROM range(400) t(i)")
    assert got == want
    spark.range(6000).selectExpr("id AS p_partkey", "concat('name ', id % 5) AS p_name").write.parquet(f"{tmp_path}/big/part.parquet")
    pairs = QUERIES["title_similarity_join"](spark, f"{tmp_path}/big")
    assert pairs.count() == 300 * 1200 and _most(pairs, "shuffle records written") < 50_000
