"""Queries over texts: tokens, ranking, vectors, fusion, search."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.functions.scholarly import label_references
from paperloom.operators import chunking, dense, fusion, lexical, refs, retrieval
from paperloom.plans.registry import query
from paperloom.runtime import spread, table


def norm(x: str) -> str:
    return rf"trim(regexp_replace(lower(strip_accents(coalesce({x}, ''))), '\s+', ' ', 'g'))"


def words(items: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in items)


def toks(x: str) -> str:
    pattern = T.SCIENCE_PATTERN.replace("'", "''")
    return rf"list_filter(list_transform(regexp_extract_all({norm(x)}, '{pattern}'), lambda t: regexp_replace(t, '\s+', '', 'g')), lambda t: t NOT IN ({words(T.PAPER_STOPWORDS)}) AND (length(t) > 1 OR regexp_matches(t, '^\d$')))"


BM25 = f"""
d AS (SELECT doc_id, {{scope}} AS scope, {toks('text')} AS tk FROM documents),
p AS (SELECT scope, doc_id, term, len, count(*) AS tf FROM (SELECT scope, doc_id, len(tk) AS len, unnest(tk) AS term FROM d) GROUP BY ALL),
c AS (SELECT scope, count(*) AS n, avg(len(tk)) AS avg_len FROM d GROUP BY scope),
t AS (SELECT p.scope, term, count(*) AS df, greatest(ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)), 1e-6) AS idf FROM p JOIN c ON p.scope = c.scope GROUP BY p.scope, term),
q AS (SELECT item_id AS query_id, term, count(*) AS qf FROM (SELECT item_id, unnest({toks('text')}) AS term FROM benchmark) GROUP BY ALL),
s AS (SELECT q.query_id, p.scope, p.doc_id, round(sum(idf * (qf * 2.2 / (qf + 1.2)) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len)))), 6) AS score
      FROM q JOIN p ON q.term = p.term JOIN t ON t.scope = p.scope AND t.term = p.term JOIN c ON c.scope = p.scope GROUP BY ALL)
"""


@query("science_token_counts", f"SELECT term, count(*) AS n FROM (SELECT unnest({toks('text')}) AS term FROM documents) GROUP BY term")
def science_token_counts(spark, sf):
    """Occurrences of each scientific token."""
    return spread(table(spark, sf, "documents").select("text")).select(F.explode(T.science_tokens(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@query("word_tokens", f"SELECT doc_id, len(list_filter(regexp_extract_all({norm('text')}, '[a-z0-9]+'), lambda w: w NOT IN ({words(T.STOPWORDS)}) AND length(w) > 1)) AS n_tokens FROM documents")
def word_tokens(spark, sf):
    """Words of each document without stopwords."""
    return spread(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", F.size(T.tokens(F.col("text"))).cast("long").alias("n_tokens"))


_strip = "regexp_replace(coalesce(html, ''), '<[^>]+>', ' ', 'g')"
for _a, _b in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&rsquo;", "''"), ("&ldquo;", '"'), ("&rdquo;", '"')):
    _strip = f"replace({_strip}, '{_a}', '{_b}')"
_strip = rf"trim(regexp_replace({_strip}, '\s+', ' ', 'g'))"


@query("strip_html_text", f"SELECT page_id, {_strip} AS body FROM pages")
def strip_html_text(spark, sf):
    """Pages without markup."""
    return spread(table(spark, sf, "pages").select("page_id", "html")).select("page_id", T.strip_html(F.col("html")).alias("body"))


@query("content_hashes", f"SELECT page_id, sha256({norm(_strip)}) AS content_hash FROM pages")
def content_hashes(spark, sf):
    """Hashes of pages' normalised texts."""
    return spread(table(spark, sf, "pages").select("page_id", "html")).select("page_id", T.content_hash(F.col("html")).alias("content_hash"))


_slug = f"trim(regexp_replace({norm('p_name')}, '[^a-z0-9]+', '-', 'g'), '-')"


@query("slugify_titles", f"SELECT p_partkey, CASE WHEN {_slug} = '' THEN 'item' WHEN length({_slug}) > 12 THEN regexp_replace(left({_slug}, 12), '-[^-]*$', '') ELSE {_slug} END AS slug FROM part")
def slugify_titles(spark, sf):
    """Slugs of twelve characters at most."""
    return table(spark, sf, "part").select("p_partkey", T.slugify(F.col("p_name"), 12).alias("slug"))


@query("token_estimate", "SELECT doc_id, greatest(1, length(text) // 4) AS tokens, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS words FROM documents")
def token_estimate(spark, sf):
    """Estimated tokens and words."""
    return table(spark, sf, "documents").select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"), T.word_count(F.col("text")).alias("words"))


@query("truncated_texts", r"SELECT doc_id, CASE WHEN length(trim(text)) <= 80 THEN trim(text) ELSE regexp_replace(left(trim(text), 77), ' [^ ]*$', '') || '...' END AS head FROM documents")
def truncated_texts(spark, sf):
    """The first eighty characters, cut at a blank."""
    return table(spark, sf, "documents").select("doc_id", T.truncate(F.col("text"), 80).alias("head"))


@query(
    "degenerate_flags",
    r"""WITH d AS (SELECT doc_id, trim(text) AS t, list_filter(regexp_split_to_array(trim(text), '\s+'), lambda x: x <> '') AS k FROM documents)
SELECT doc_id, CASE WHEN length(t) < 40 THEN false WHEN regexp_matches(t, '<(pad|eos|bos|unk|s|/s|mask|sep|cls)>', 'i') THEN true WHEN len(k) < 12 THEN false
ELSE len(list_filter(k, lambda x: length(x) = 1)) / len(k) > 0.33 OR (len(k) >= 40 AND len(list_distinct(list_transform(k, lambda x: lower(x)))) / len(k) < 0.2) OR (len(k) >= 60 AND NOT regexp_matches(t, '[.!?]\s')) END AS degenerate FROM d""",
)
def degenerate_flags(spark, sf):
    """Which documents are noise rather than writing."""
    return spread(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", chunking.looks_degenerate(F.col("text")).alias("degenerate"))


@query("identify_urls", "SELECT page_id, CASE WHEN regexp_matches(url, '^https?://[^/]+', 'i') THEN 'url' ELSE 'unknown' END AS kind, url AS id FROM pages")
def identify_urls(spark, sf):
    """What kind of identifier each page's address is."""
    found = T.identify(F.col("url"))
    return table(spark, sf, "pages").select("page_id", found["kind"].alias("kind"), found["id"].alias("id"))


def _cues(pattern: str) -> str:
    return f"regexp_matches(coalesce(text, ''), '{pattern.removeprefix('(?i)')}', 'i')"


_N, _C, _V = _cues(fusion.NUMERIC), _cues(fusion.CONCEPTUAL), _cues(fusion.VISUAL)


@query(
    "query_weights",
    f"""SELECT conv_id, turn, CAST(CASE WHEN {_C} THEN greatest(0.6, (CASE WHEN {_N} THEN 1.5 ELSE 1.0 END) * 0.75) WHEN {_N} THEN 1.5 ELSE 1.0 END AS DOUBLE) AS lexical,
CAST(CASE WHEN {_C} THEN 1.4 WHEN {_N} THEN 0.85 ELSE 1.0 END AS DOUBLE) AS dense, CAST(CASE WHEN {_V} THEN 1.5 ELSE 0.7 END AS DOUBLE) AS visual FROM conversations""",
)
def query_weights(spark, sf):
    """Weights of the legs by the shape of each message."""
    w = fusion.leg_weights(F.col("text"))
    return table(spark, sf, "conversations").select("conv_id", "turn", *(w[x].cast("double").alias(x) for x in ("lexical", "dense", "visual")))


@query("bm25_idf", f"WITH {BM25.format(scope="'all'")} SELECT term, df, round(idf, 6) AS idf FROM t")
def bm25_idf(spark, sf):
    """Document frequencies and weights of all terms."""
    docs = table(spark, sf, "documents")
    terms = lexical.term_stats(lexical.postings(docs), lexical.corpus_stats(lexical.doc_stats(docs)))
    return terms.select("term", "df", F.round("idf", 6).alias("idf"))


@query("bm25_topk", f"WITH {BM25.format(scope="'all'")} SELECT query_id, doc_id, round(score, 3) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 10")
def bm25_topk(spark, sf):
    """The ten best documents of each benchmark passage."""
    found = lexical.bm25_search(table(spark, sf, "documents"), table(spark, sf, "benchmark"), 10)
    return found.select("query_id", "doc_id", F.round("score", 3).alias("score"), "rank")


@query("per_source_bm25", f"WITH {BM25.format(scope='source')} SELECT query_id, scope, doc_id, round(score, 3) AS score, row_number() OVER (PARTITION BY query_id, scope ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 3")
def per_source_bm25(spark, sf):
    """The three best documents of each passage within each source, weights within the source."""
    found = lexical.bm25_search(table(spark, sf, "documents"), table(spark, sf, "benchmark"), 3, scope="source")
    return found.select("query_id", "scope", "doc_id", F.round("score", 3).alias("score"), "rank")


def _overlap_leg(spark, sf, k: int):
    """A second leg: how many different words a passage and a document share, weighted by nothing."""
    docs, queries = spread(table(spark, sf, "documents").select("doc_id", "text")), table(spark, sf, "benchmark")
    d = docs.select("doc_id", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("w"))
    q = queries.select(F.col("item_id").alias("query_id"), F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("w"))
    scores = d.join(q, "w").groupBy("query_id", "doc_id").agg(F.count(F.lit(1)).cast("double").alias("score"))
    return lexical.top_k(scores, k)


_OVERLAP = f"""
ow AS (SELECT DISTINCT doc_id, w FROM (SELECT doc_id, unnest(list_filter(regexp_extract_all({norm('text')}, '[a-z0-9]+'), lambda w: w NOT IN ({words(T.STOPWORDS)}) AND length(w) > 1)) AS w FROM documents)),
oq AS (SELECT DISTINCT item_id AS query_id, w FROM (SELECT item_id, unnest(list_filter(regexp_extract_all({norm('text')}, '[a-z0-9]+'), lambda w: w NOT IN ({words(T.STOPWORDS)}) AND length(w) > 1)) AS w FROM benchmark)),
os AS (SELECT query_id, doc_id, count(*) AS score FROM ow JOIN oq USING (w) GROUP BY ALL),
ol AS (SELECT query_id, 'overlap' AS leg, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM os QUALIFY rank <= 40),
bl AS (SELECT query_id, 'lexical' AS leg, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 40),
f AS (SELECT query_id, doc_id, round(sum(1.0 / (60 + rank)), 6) AS score, count(*) AS legs FROM (SELECT * FROM ol UNION ALL SELECT * FROM bl) GROUP BY ALL),
fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM f)
"""


def _two_legs(spark, sf):
    docs, queries = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    return retrieval.as_leg(lexical.bm25_search(docs, queries, 40), "lexical").unionByName(retrieval.as_leg(_overlap_leg(spark, sf, 40), "overlap"))


@query("rrf_fusion", f"WITH {BM25.format(scope="'all'")}, {_OVERLAP} SELECT query_id, doc_id, score, legs, rank FROM fr WHERE rank <= 12")
def rrf_fusion(spark, sf):
    """Two legs fused by reciprocal ranks."""
    return fusion.fuse(_two_legs(spark, sf), top=12).select("query_id", "doc_id", "score", F.size("legs").cast("long").alias("legs"), "rank")


@query(
    "diversify_cap",
    f"""WITH {BM25.format(scope="'all'")}, {_OVERLAP},
g AS (SELECT query_id, doc_id, score, fr.rank AS r, row_number() OVER (PARTITION BY query_id, source, lang ORDER BY fr.rank) > 2 AS late FROM fr JOIN documents USING (doc_id) WHERE fr.rank <= 40)
SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY late, r) AS rank FROM g QUALIFY rank <= 12""",
)
def diversify_cap(spark, sf):
    """The fused ranking with at most two of a source and language in front."""
    fused = fusion.fuse(_two_legs(spark, sf), top=40).join(table(spark, sf, "documents").select("doc_id", "source", "lang"), "doc_id")
    return fusion.diversify(fused, ["source", "lang"], 2, 12).select("query_id", "doc_id", "score", "rank")


def _chunks(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.col("source").alias("paper_id"), F.col("lang").alias("section"), F.lit("text").alias("kind"), F.col("doc_id").alias("ord"), F.lit("").alias("label"), "text")


_STOPPED = f"list_filter(regexp_extract_all(t, '[a-z0-9]+'), lambda w: w NOT IN ({words(T.STOPWORDS)}) AND length(w) > 1)"


def _vectors(prefix: str, source: str, key: str) -> str:
    """Hashed vectors in SQL: (id, slot, value) of unit length as {prefix}v."""
    return f"""
{prefix}t AS (SELECT {key} AS id, {norm("text")} AS t FROM {source}), {prefix}w AS (SELECT id, replace(t, ' ', '_') AS flat, {_STOPPED} AS w FROM {prefix}t),
{prefix}f AS (SELECT id, 'w:' || unnest(w) AS f FROM {prefix}w UNION ALL SELECT id, unnest(list_transform(range(1, len(w)), lambda i: 'b:' || w[i] || '_' || w[i + 1])) FROM {prefix}w
  UNION ALL SELECT id, unnest(list_transform(range(1, length(flat) - 2), lambda i: 'c:' || substr(flat, i, 4))) FROM {prefix}w),
{prefix}c AS (SELECT id, f, md5(f) AS h, 1 + ln(count(*)) AS x FROM {prefix}f GROUP BY id, f),
{prefix}s AS (SELECT id, CAST('0x' || substr(h, 1, 7) AS BIGINT) % 1024 AS slot, sum(CASE WHEN substr(h, 8, 1) >= '8' THEN -x ELSE x END) AS value FROM {prefix}c GROUP BY ALL),
{prefix}v AS (SELECT id, slot, value / sqrt(sum(value * value) OVER (PARTITION BY id)) AS value FROM {prefix}s)"""


@query(
    "hybrid_search",
    f"""WITH {BM25.format(scope="'all'")}, {_vectors("d", "documents", "doc_id")}, {_vectors("q", "benchmark", "item_id")},
hs AS (SELECT qv.id AS query_id, dv.id AS doc_id, round(sum(qv.value * dv.value), 6) AS score FROM qv JOIN dv USING (slot) GROUP BY ALL),
legs AS (SELECT query_id, 'lexical' AS leg, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 40
  UNION ALL SELECT query_id, 'dense', doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM hs QUALIFY rank <= 40),
weights AS (SELECT item_id AS query_id, CASE WHEN {_C} THEN greatest(0.6, (CASE WHEN {_N} THEN 1.5 ELSE 1.0 END) * 0.75) WHEN {_N} THEN 1.5 ELSE 1.0 END AS lexical, CASE WHEN {_C} THEN 1.4 WHEN {_N} THEN 0.85 ELSE 1.0 END AS dense FROM benchmark),
hf AS (SELECT query_id, doc_id, round(sum(CAST(CASE leg WHEN 'lexical' THEN lexical ELSE dense END AS DOUBLE) / (60 + rank)), 6) AS score FROM legs JOIN weights USING (query_id) GROUP BY ALL),
hr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM hf QUALIFY r <= 40),
hg AS (SELECT hr.*, row_number() OVER (PARTITION BY query_id, source, lang ORDER BY r) > 4 AS late FROM hr JOIN documents USING (doc_id))
SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY late, r) AS rank FROM hg QUALIFY rank <= 12""",
)
def hybrid_search(spark, sf):
    """The flagship: words and hashed vectors, weighted by the passage's shape, fused, diversified; the twelve best documents of each passage."""
    docs = table(spark, sf, "documents")
    queries = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    words_leg = retrieval.as_leg(lexical.bm25_search(docs, queries, 40, query="query_id"), "lexical")
    vectors = dense.hashed_embeddings(docs).select(F.col("doc_id").alias("id"), "vec")
    asked = dense.hashed_embeddings(queries, doc="query_id").select(F.col("doc_id").alias("id"), "vec")
    dense_leg = retrieval.as_leg(dense.search(vectors, asked, 40, 1024, docs.count(), queries.count()), "dense")
    hits = retrieval.hybrid([words_leg, dense_leg], queries, _chunks(spark, sf))
    return hits.select("query_id", "doc_id", "score", "rank")


@query(
    "find_everywhere",
    "SELECT item_id AS query_id, doc_id, lang FROM benchmark b JOIN documents d ON contains(lower(d.text), lower(b.text))",
)
def find_everywhere(spark, sf):
    """Every document that holds a benchmark passage word for word."""
    docs = spread(table(spark, sf, "documents").select("doc_id", "text", "lang"))
    needles = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("needle"))
    return retrieval.find_everywhere(docs, needles, "text").select("query_id", "doc_id", "lang")


@query("find_by_kind", "SELECT item_id AS query_id, lang, count(*) AS n FROM benchmark b JOIN documents d ON contains(lower(d.text), lower(b.text)) GROUP BY ALL")
def find_by_kind(spark, sf):
    """How often each passage is found, by language."""
    return retrieval.find_by_kind(find_everywhere(spark, sf), "lang")


@query(
    "multi_query_merge",
    f"""WITH {BM25.format(scope="'all'")},
h AS (SELECT query_id // 4 AS topic_id, query_id % 4 AS query_no, doc_id, round(score * CASE WHEN query_id % 4 = 0 THEN 1.0 ELSE 0.75 END, 6) AS ws, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM s QUALIFY r <= 40),
b AS (SELECT topic_id, doc_id, max(ws) AS score FROM h GROUP BY ALL)
SELECT topic_id, doc_id, round(score, 4) AS score, lang = 'en' AS preferred, row_number() OVER (PARTITION BY topic_id ORDER BY lang = 'en' DESC, score DESC, doc_id) AS rank FROM b JOIN documents USING (doc_id) QUALIFY rank <= 12""",
)
def multi_query_merge(spark, sf):
    """Four weighted passages a topic, each document once with its best score, English ones first."""
    docs = table(spark, sf, "documents")
    hits = lexical.bm25_search(docs, table(spark, sf, "benchmark"), 40)
    weighted = hits.select(F.expr("query_id div 4").alias("topic_id"), (F.col("query_id") % 4).alias("query_no"), "doc_id", "score").withColumn("weight", F.when(F.col("query_no") == 0, 1.0).otherwise(0.75))
    best = fusion.best_of_queries(weighted).join(docs.select("doc_id", "lang"), "doc_id")
    return fusion.prefer(best, F.col("lang") == "en").where("rank <= 12").select("topic_id", "doc_id", F.round("score", 4).alias("score"), "preferred", "rank")


@query(
    "balanced_interleave",
    f"""WITH {BM25.format(scope='source')},
r AS (SELECT query_id, scope, doc_id, row_number() OVER (PARTITION BY query_id, scope ORDER BY score DESC, doc_id) AS rn FROM s QUALIFY rn <= 2)
SELECT query_id, scope, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY rn, scope) AS rank FROM r""",
)
def balanced_interleave(spark, sf):
    """Two documents of each source, sources in turn."""
    hits = lexical.bm25_search(table(spark, sf, "documents"), table(spark, sf, "benchmark"), 2, scope="source")
    return fusion.interleave(hits, "scope").select("query_id", "scope", "doc_id", "rank")


@query(
    "first_seen_union",
    f"""WITH {BM25.format(scope="'all'")}, {_OVERLAP},
a AS (SELECT query_id, doc_id, min(pos) AS pos FROM (SELECT query_id, doc_id, rank AS pos FROM bl WHERE rank <= 5 UNION ALL SELECT query_id, doc_id, 1000 + rank FROM ol WHERE rank <= 5) GROUP BY ALL)
SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS pos FROM a""",
)
def first_seen_union(spark, sf):
    """The best five of both legs, each once, in the order in which they are seen."""
    legs = _two_legs(spark, sf).where("rank <= 5").select("query_id", F.when(F.col("leg") == "lexical", 0).otherwise(1).alias("leg_no"), F.col("rank").alias("pos"), "doc_id")
    return fusion.first_seen(legs)


@query(
    "dense_topk",
    """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), n AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS l FROM e),
s AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, round(list_dot_product(q.v, d.v) / (q.l * d.l), 6) AS score FROM n q, n d WHERE q.vec_id % 20 = 0 AND q.l > 0 AND d.l > 0)
SELECT query_id, doc_id, round(score, 4) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 10""",
)
def dense_topk(spark, sf):
    """The ten nearest vectors of every twentieth vector, exactly."""
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return dense.search(vectors, vectors.where("id % 20 = 0"), 10).select("query_id", "doc_id", F.round("score", 4).alias("score"), "rank")


#: The fixtures hold no near copies of vectors, so every tenth comes once more, a little changed.
_PAIRS = """WITH o AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), e AS (SELECT * FROM o UNION ALL SELECT vec_id + 1000000, label, list_transform(v, lambda x, i: x * (1.0 + (i % 4) * 0.25)) FROM o WHERE vec_id % 10 = 0),
n AS (SELECT vec_id, label, v, sqrt(list_dot_product(v, v)) AS l FROM e)
SELECT a.vec_id AS a, b.vec_id AS b, round(round(list_dot_product(a.v, b.v) / (a.l * b.l), 6), 4) AS score FROM n a JOIN n b ON a.vec_id < b.vec_id{same} WHERE round(list_dot_product(a.v, b.v) / (a.l * b.l), 6) >= {least}"""


def _copied_vectors(spark, sf):
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("vec"))
    changed = vectors.where("id % 10 = 0").select((F.col("id") + 1000000).alias("id"), "label", F.transform("vec", lambda x, i: x * (1.0 + ((i + 1) % 4) * 0.25)).alias("vec"))
    return vectors.unionByName(changed)


@query("near_duplicate_vectors", _PAIRS.format(same="", least=0.9))
def near_duplicate_vectors(spark, sf):
    """All pairs of vectors with a cosine of nine tenths or more."""
    return dense.similar_pairs(_copied_vectors(spark, sf), dense.CUTS["base"][0]).select("a", "b", F.round("score", 4).alias("score"))


@query("cluster_pairs", _PAIRS.format(same=" AND a.label = b.label", least=0.24))
def cluster_pairs(spark, sf):
    """Pairs of one label above the lexical cut of a cluster."""
    return dense.similar_pairs(_copied_vectors(spark, sf), dense.CUTS["lexical"][1], group="label").select("a", "b", F.round("score", 4).alias("score"))


@query("pooled_vectors", "SELECT label, i - 1 AS i, round(avg(x), 6) AS x FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL")
def pooled_vectors(spark, sf):
    """The mean vector of each label, a row for each number."""
    pooled = dense.mean_pool(table(spark, sf, "embeddings").select("label", F.col("embedding").alias("vec")), ["label"])
    return pooled.select("label", F.posexplode("vec").alias("i", "x")).select("label", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


@query("hashed_vectors", f"WITH {_vectors('d', 'documents', 'doc_id')} SELECT id AS doc_id, count(*) AS slots, round(sqrt(sum(value * value)), 4) AS norm FROM dv GROUP BY id")
def hashed_vectors(spark, sf):
    """Hashed vectors of all documents, as norms and how many slots they fill."""
    return dense.hashed_vectors_sparse(table(spark, sf, "documents")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("slots"), F.round(F.sqrt(F.sum(F.col("value") * F.col("value"))), 4).alias("norm"))


_ASKING = "concat(text, CASE conv_id % 3 WHEN 0 THEN concat(' See Fig. ', CAST(turn AS STRING), ' and figure ', CAST(turn AS STRING), ', not TABLE ', CAST(conv_id AS STRING), '.1.') WHEN 1 THEN concat(' Is Eq ', CAST(conv_id AS STRING), ' right?') ELSE ' No configuration 7.' END)"


@query(
    "label_references",
    """SELECT conv_id, turn, concat('figure ', turn) AS label, 0 AS at FROM conversations WHERE conv_id % 3 = 0 UNION ALL SELECT conv_id, turn, concat('table ', conv_id, '.1'), 1 FROM conversations WHERE conv_id % 3 = 0 UNION ALL
SELECT conv_id, turn, concat('equation ', conv_id), 0 FROM conversations WHERE conv_id % 3 = 1""",
)
def label_refs(spark, sf):
    """The figures, tables and equations that messages name, each once, in their order."""
    asked = table(spark, sf, "conversations").withColumn("text", F.expr(_ASKING))
    return asked.select("conv_id", "turn", F.posexplode(label_references(F.col("text"))).alias("at", "label"))


@query("chunk_documents")
def chunk_documents(spark, sf):
    """All documents in chunks of at most 1800 characters."""
    return chunking.chunk_texts(spread(table(spark, sf, "documents").select("doc_id", "text")))


_names = "list_distinct(regexp_extract_all({n}, '[a-z0-9]+'))"


@query(
    "title_similarity_join",
    f"""WITH t AS (SELECT p_partkey, {_names.format(n=norm('p_name'))} AS s FROM part)
SELECT a.p_partkey AS a, b.p_partkey AS b, round(len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))), 6) AS similarity FROM t a JOIN t b ON a.p_partkey % 20 = 0 AND len(a.s) > 0 AND len(b.s) > 0
WHERE round(len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))), 6) >= 0.82""",
)
def title_similarity_join(spark, sf):
    """Parts whose names are alike, for every twentieth part against all."""
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"))
    return refs.title_pairs(parts.where("id % 20 = 0"), parts, refs.RESOLVED)
