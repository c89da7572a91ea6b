"""Properties and awkward rows of the library's operators."""

import re

import pytest

from paperloom.functions import scholarly as S
from paperloom.functions import text as T
from paperloom.operators import chunking, dense, exports, fusion, layout, lexical, library, retrieval, storage, structure
from paperloom.runtime import table
from paperloom.schemas import TABLES, schema
from paperloom.sources import readers
from paperloom.streaming import jobs


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column).first()[0]


def test_schemas_parse(spark):
    assert len(TABLES) >= 10 and all(len(schema(n)) for n in TABLES)


@pytest.mark.parametrize(
    ("text", "tokens"),
    [
        ("p < 0.05 and 41.0% of BERT-base in 10^-4 s", ["p<0.05", "41.0%", "bert-base", "10^-4"]),
        ("Ünïcode Café ½ [12, 13]", ["unicode", "cafe", "1", "2", "[12,13]"]),
        ("1.2e-4 30 px 7", ["1.2e-4", "30px", "7"]),
        (None, []),
        ("", []),
    ],
)
def test_science_tokens(spark, text, tokens):
    from pyspark.sql import functions as F

    assert [t for t in one(spark, T.science_tokens(F.col("x")), text) if t not in ("⁄",)] == tokens


def test_text_functions_stand_null(spark):
    from pyspark.sql import functions as F

    x = F.col("x")
    for f in (T.normalise_text, T.strip_html, T.slugify, T.clean_pdf_text, T.word_count, T.estimate_tokens, T.tokens, T.identify, T.safe_filename, T.content_hash):
        assert one(spark, f(x), None) is not None
    assert one(spark, T.truncate(x, 10), "a long text of words") == "a long..."
    assert one(spark, T.unwrap_list(F.parse_json(x)), '{"items": ["a", "b"]}') == ["a", "b"]
    assert one(spark, T.grid_to_html(F.array(F.array(x))), 'a<"b"') == "<table><tr><th>a&lt;&quot;b&quot;</th></tr></table>"
    snippets = one(spark, T.highlight(x, F.lit("needle")), "some words before the needle and some after it")
    assert len(snippets) == 1 and "needle" in snippets[0]["snippet"]
    assert one(spark, T.sentences(x), "It works, e.g. Here. See Fig. 3 for more. Done.") == ["It works, e.g. Here.", "See Fig. 3 for more.", "Done."]


@pytest.mark.parametrize(
    ("function", "text", "want"),
    [
        (T.sentences, "It was 95. We then went on, as Dr. Who did (cf. Ref. 2). See vol. 3. No. 4 is 3.5 high. (So.) Done", ["It was 95.", "We then went on, as Dr. Who did (cf. Ref. 2).", "See vol. 3.", "No. 4 is 3.5 high.", "(So.) Done"]),
        (S.strip_numbering, "Section 3 Methods", "Methods"),
        (S.strip_numbering, "Appendix B", "Appendix B"),
        (S.strip_numbering, "A.1. Proofs of it", "Proofs of it"),
        (S.strip_numbering, "Ill-posed problems", "Ill-posed problems"),
        (S.section_of, "Chapter 4. Datasets used", "data"),
        (S.section_of, "Datasheets", "unknown"),
        (T.sanitise_output, "one\n\n  \u2014 two", "one\n\n  - two"),
        (T.sanitise_output, "3\u20134 a \u2014 b, , c\u2011d", "3 to 4 a, b, c-d"),
        (T.clean_pdf_text, "self-\n  Attention BERT-\nBase \u22121 \u02c6x\u202f5\nnext.\nLine", "selfAttention BERTBase -1 ^x 5 next.\nLine"),
    ],
)
def test_functions_on_awkward_texts(spark, function, text, want):
    from pyspark.sql import functions as F

    assert one(spark, function(F.col("x")), text) == want


@pytest.mark.parametrize(
    ("text", "kind", "ident"),
    [
        ("arXiv:hep-th/9901001", "arxiv", "hep-th/9901001"),
        ("math.GT/0309136v2", "arxiv", "math.GT/0309136v2"),
        ("1706.03762v5", "arxiv", "1706.03762v5"),
        ("https://arxiv.org/html/2407.01449v2", "arxiv", "2407.01449"),
        ("http://www.arxiv.org/pdf/cs/0112017.pdf", "arxiv", "cs/0112017"),
        ("10.1109/cvpr.2016.90", "doi", "10.1109/cvpr.2016.90"),
        ("ftp://x", "unknown", "ftp://x"),
    ],
)
def test_identify(spark, text, kind, ident):
    from pyspark.sql import functions as F

    found = one(spark, T.identify(F.col("x")), text)
    assert (found["kind"], found["id"]) == (kind, ident)


@pytest.mark.parametrize(
    ("answer", "want"),
    [
        ('{"bullets": ["a"], "n": 1}', ["a"]),
        ('{"whatever": ["a", "b"], "n": 1}', ["a", "b"]),
        ('{"rows": ["r"], "items": ["i"]}', ["i"]),
        ('{"x": ["a"], "y": ["b"]}', []),
        ('{"x": {}, "y": {}}', []),
        ('["z"]', ["z"]),
        ('{"a":1}', ['{"a":1}']),
        ("3", []),
    ],
)
def test_unwrap_list(spark, answer, want):
    from pyspark.sql import functions as F

    assert one(spark, T.unwrap_list(F.parse_json(F.col("x"))), answer) == want


def test_slugs_are_unique(spark):
    names = ["a", "a", "a 2", "a 2", "a", "A-3", "b", "a", "", None, "a-2-2"]
    for per_bucket in (3, 100):
        rows = library.unique_slugs(spark.createDataFrame(list(enumerate(names)), "k int, name string"), "name", "k", per_bucket).orderBy("k").collect()
        assert [r["slug"] for r in rows] == ["a", "a-4", "a-2", "a-2-3", "a-5", "a-3", "b", "a-6", "item", "item-2", "a-2-2"]


def test_query_shapes(spark):
    from pyspark.sql import functions as F

    w = lambda text: tuple(round(float(v), 3) for v in one(spark, fusion.leg_weights(F.col("x")), text))
    assert w("how many layers") == (1.5, 0.85, 0.7) and w("what F1 was reached") == (1.5, 0.85, 0.7)
    assert w("Why does it work") == (0.75, 1.4, 0.7) and w("summarise the limitations in 3 lines") == (1.125, 1.4, 0.7)
    assert w("the architecture, as shown in Fig. 2") == (1.5, 0.85, 1.5) and w("configure it") == (1.0, 1.0, 0.7) and w(None) == (1.0, 1.0, 0.7)


def test_references_are_parsed(spark):
    from pyspark.sql import functions as F

    r = one(spark, S.parse_reference(F.col("x")), "[12] A. Vaswani, N. Shazeer, and I. Polosukhin. Attention is all you need. Advances in Systems, 30, 2017. https://x.org/a).")
    assert (r["number"], r["title"], r["year"], r["url"], len(r["authors"])) == (12, "Attention is all you need", 2017, "https://x.org/a", 3)
    assert one(spark, S.split_entries(F.col("x")), "1. First entry here. 2. Second entry there. 3. not one") == ["1. First entry here. ", "2. Second entry there. 3. not one"]
    assert one(spark, S.numeric_markers(F.col("x")), "as [1, 3-5] and [2–3], not [x] nor [4a]") == [1, 3, 4, 5, 2]
    assert [tuple(m) for m in one(spark, S.author_year_markers(F.col("x")), "(Müller et al., 2019) (O'Neil and Ng 2020a) (no, 2020)")] == [("müller", 2019), ("o'neil", 2020)]
    assert [one(spark, S.may_be_title(F.col("x")), t) for t in ("arXiv:2501.1 [cs]", "A Preprint on X", "2024 12th Meeting", "Licensed under X", "DOI 10.1", "Proceedings")] == [False, True, False, False, False, True]


def test_greedy_captions_compete(spark):
    boxes = [(0, "figure", "", 100, 200), (1, "caption", "Figure 1: a", 210, 220), (2, "caption", "Figure 2: b", 225, 235), (3, "figure", "", 250, 300), (4, "caption", "Figure 3: c", 600, 610)]
    rows = [(1, 1, o, k, t, (0.0, float(a), 50.0, float(b))) for o, k, t, a, b in boxes]
    df = spark.createDataFrame(rows, "paper_id long, page int, ord int, kind string, text string, bbox struct<x0:double,y0:double,x1:double,y1:double>")
    assert sorted((r["caption_ord"], r["target_ord"]) for r in layout.greedy_captions(df).collect()) == [(1, 0), (2, 3)]
    assert sorted((r["caption_ord"], r["target_ord"]) for r in layout.nearest_captions(df).collect()) == [(1, 0), (2, 0)]


def test_labels(spark):
    from pyspark.sql import functions as F

    x = F.col("x")
    assert one(spark, S.label_references(x), "Compare Fig. 3 and Table 2 with figure 3") == ["figure 3", "table 2"]
    assert one(spark, S.caption_label(x), "Tab. 4: Results") == "table 4"
    assert one(spark, S.canonical_label(x), "Fig 3") == "figure 3"
    assert one(spark, S.equation_number(x), "x = y (3.2)") == "3.2"
    assert one(spark, S.strip_equation_number(x), "x = y (3.2)") == "x = y"


def test_bm25_prefers_the_planted(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma"), (2, "alpha alpha delta"), (3, ""), (4, None)], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "gamma beta"), (2, "unknownword"), (3, None)], "item_id long, text string")
    rows = lexical.bm25_search(docs, queries, 5).collect()
    assert [(r["query_id"], r["doc_id"], r["rank"]) for r in rows] == [(1, 1, 1)]
    assert lexical.contains_term(lexical.postings(docs), "delta").count() == 1


def test_index_is_saved_and_read(spark, tmp_path):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "beta gamma")], "doc_id long, text string")
    lexical.save_index(lexical.postings(docs), str(tmp_path / "i"))
    assert lexical.load_index(spark, str(tmp_path / "i"), ["beta"]).count() == 2
    assert lexical.load_index(spark, str(tmp_path / "i")).count() == 4


def test_search_with_zero_vectors_and_blocks(spark):
    v = spark.createDataFrame([(k, [float(k % 3), float(k % 5), 1.0 if k else 0.0] if k else [0.0, 0.0, 0.0]) for k in range(30)], "id long, vec array<float>")
    small = {tuple(r) for r in dense.search(v, v, 5, block=8).collect()}
    assert small == {tuple(r) for r in dense.search(v, v, 5).collect()}
    assert 0 not in {r[0] for r in small}
    pairs = {tuple(r) for r in dense.similar_pairs(v, 0.99).collect()}
    assert pairs and {tuple(r) for r in dense.similar_pairs(v, 0.99, block=8).collect()} == pairs
    assert {tuple(r) for r in dense.similar_pairs(v.selectExpr("*", "id % 2 as g"), 0.99, block=4, group="g").collect()} == {p for p in pairs if p[0] % 2 == p[1] % 2}


def test_embedders(spark):
    docs = spark.createDataFrame([(1, "some words"), (2, ""), (3, None)], "doc_id long, text string")
    rows = {r["doc_id"]: r["vec"] for r in dense.hashed_embeddings(docs, dim=64).collect()}
    assert abs(sum(x * x for x in rows[1]) - 1) < 1e-9 and not any(rows[2]) and not any(rows[3])
    got = {r["doc_id"]: r["vec"] for r in dense.embed_with(docs, lambda ts: [[3.0, 4.0]] * len(ts), 2).collect()}
    assert got[1] == pytest.approx([0.6, 0.8]) and got[2] == [0.0, 0.0]
    e = dense.Embedder
    assert dense.resolve([e("a", True, 1, 1), e("onnx", True, 0), e("b", False, 9, 1)]).name == "a"
    ok, skipped = dense.compatible(spark.createDataFrame([("a:b:1",), ("c:d:2",)], "signature string"), "a:b:1")
    assert ok.count() == 1 and skipped.first()["n"] == 1


def test_fusion_is_a_permutation(spark):
    legs = spark.createDataFrame([(1, leg, d, float(s)) for leg in ("lexical", "dense") for d, s in ((1, 3), (2, 2), (3, 1))], "query_id long, leg string, doc_id long, score double")
    fused = fusion.fuse(fusion.rank_legs(legs)).join(spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "doc_id long, g string"), "doc_id")
    out = fusion.diversify(fused, ["g"], 1).orderBy("rank").collect()
    assert [r["doc_id"] for r in out] == [1, 3, 2] and all(len(r["legs"]) == 2 for r in out)
    none = fusion.fuse(fusion.rank_legs(legs), spark.createDataFrame([(1, "dense", 0.0)], "query_id long, leg string, weight double"))
    assert all(len(r["legs"]) == 1 for r in none.collect())


def test_find_everywhere_without_whole_tokens(spark):
    rows = spark.createDataFrame([(1, "An Apple a day"), (2, "pineapples"), (3, None)], "doc_id long, search_text string")
    needles = spark.createDataFrame([(1, "apple"), (2, "n apple a"), (3, "%"), (4, "")], "query_id long, needle string")
    assert sorted((r["query_id"], r["doc_id"]) for r in retrieval.find_everywhere(rows, needles).collect()) == [(1, 1), (1, 2), (2, 1)]
    assert sorted((r["query_id"], r["doc_id"]) for r in retrieval.find_everywhere(rows, needles, block=1).collect()) == [(1, 1), (1, 2), (2, 1)]
    from pyspark.sql import functions as F

    assert one(spark, retrieval.where_matched(F.lit("AP"), F.col("x"), label=F.lit("apt")), "map") == ["body", "label"]


def test_chunks_hold_to_the_budget(spark):
    text = " ".join(f"Sentence number {k} says a few words." for k in range(300))
    rows = chunking.chunk_texts(spark.createDataFrame([(1, text), (2, "too short"), (3, "x" * 5000), (4, None)], "doc_id long, text string")).collect()
    assert all(len(r["text"]) <= chunking.BUDGET for r in rows) and {r["doc_id"] for r in rows} == {1, 3}
    assert {f"number {k} " for k in range(300)} <= {f"number {w} " for r in rows for w in __import__("re").findall(r"number (\d+) ", r["text"])}


def brute_chunks(text, budget, overlap, least):
    """The same by a loop over sentences."""
    size = lambda xs: sum(len(x) + 1 for x in xs)
    parts = [p for p in re.split(T.SENTENCE_PATTERN, text.strip(" ")) if p]
    parts = [p[k : k + budget] for p in parts for k in range(0, len(p), budget)]
    out, now = [], []
    for p in parts:
        if now and size(now) + len(p) > budget:
            out.append(" ".join(now))
            kept = []
            for x in reversed(now):
                if size(kept) + len(x) > overlap:
                    break
                kept.insert(0, x)
            now = kept if size(kept) + len(p) <= budget else []
        now.append(p)
    out += [" ".join(now)] if now else []
    return [p for p in out if len(out) == 1 or len(p) >= least]


def test_chunks_of_all_documents_are_a_loops(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    for budget, overlap in ((1800, 320), (300, 120)):
        want = [(r["doc_id"], k, p) for r in docs.collect() if len(r["text"].strip(" ")) >= 80 for k, p in enumerate(brute_chunks(r["text"], budget, overlap, 80))]
        got = chunking.chunk_texts(docs, budget=budget, overlap=overlap).collect()
        assert len(want) > 300 and sorted((r["doc_id"], r["ord"], r["text"]) for r in got) == sorted(want)


def test_library_writes(spark, tmp_path):
    papers = spark.createDataFrame([(1, "unread", ""), (2, "read", "v")], "paper_id long, read_state string, verdict string")
    assert library.set_triage(papers, 1, "read", "x" * 900).where("paper_id = 1").first()["verdict"] == "x" * 600
    with pytest.raises(ValueError):
        library.set_triage(papers, 1, "lost")
    library.overwrite_partitions(papers, str(tmp_path / "p"), "paper_id")
    library.overwrite_partitions(papers.where("paper_id = 2").withColumn("verdict", papers["read_state"]), str(tmp_path / "p"), "paper_id")
    assert {(r["paper_id"], r["verdict"]) for r in spark.read.parquet(str(tmp_path / "p")).collect()} == {(1, ""), (2, "read")}
    stay, n = library.deleted_with_count(papers, papers["paper_id"] == 1)
    assert stay.count() == 1 and n.first()["deleted"] == 1


def test_storage_and_sources(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "b.pdf").write_bytes(b"nothing")
    (tmp_path / "c.pdf").write_bytes(b"")
    assert [r["length"] for r in readers.pdf_files(spark, str(tmp_path)).collect()] == [10]
    blobs = spark.createDataFrame([("a" * 64,)], "digest string")
    rows = spark.createDataFrame([(b"x", "image/png"), (b"x", "image/png"), (b"y", "text/html")], "content binary, media_type string")
    assert storage.new_blobs(rows, blobs).count() == 1
    assert [readers.is_public_host(h) for h in ("example.org", "localhost", "10.0.0.1", "8.8.8.8", "[::1]", "", None, "169.254.1.1")] == [True, False, False, True, False, False, False, False]


def test_stream_ingest_is_idempotent(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "file_hash string, t long").selectExpr("file_hash", "timestamp_seconds(t) as created_at")
    rows.write.parquet(str(tmp_path / "in"))
    stream = jobs.new_papers(jobs.parquet_stream(spark, str(tmp_path / "in"), rows.schema))
    for _ in range(2):
        jobs.run(stream, jobs.append_once(str(tmp_path / "out")), str(tmp_path / "state")).awaitTermination()
    assert sorted(r["file_hash"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]


def test_layout_and_structure_stand_empty_tables(spark):
    boxes = spark.createDataFrame([], "paper_id long, page int, ord int, kind string, text string, level int, bbox struct<x0:double,y0:double,x1:double,y1:double>")
    for df in (layout.nearest_captions(boxes), layout.greedy_captions(boxes), layout.overlapping(boxes), structure.heading_trails(boxes), structure.renumber(boxes), layout.title_candidate(boxes)):
        assert df.count() == 0


def test_csv_cells_are_quoted(spark):
    from pyspark.sql import functions as F

    assert one(spark, exports.grid_csv(F.array(F.array(F.col("x"), F.lit("b")))), 'a,"q"\nz') == '"a,""q""\nz",b\n'
