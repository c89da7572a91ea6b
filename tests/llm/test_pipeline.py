"""Each stage of the pipeline against a brute-force version, on its own input, awkward rows among it."""

import re
from collections import defaultdict

import corpus_pipeline
from rows import frame, texts
from test_llm_operators import brute_exact, brute_near, brute_score

from paperloom.llm import mixing, packing, quality
from paperloom.runtime import Scratch, scratch_path, table

SF = "/root/testdata/sf0.001"


def pairs(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()), key=str)


def test_stages_one_by_one(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "exact", "near", "mixing", "packing"]

    good = Scratch(stages["quality"](spark, docs, SF), "t").df
    model = quality.learned(spark, docs, SF)
    want = [(r["doc_id"], r["text"]) for r in quality.score(docs, model).where("score >= 0.5").collect()]
    assert good.columns == columns and pairs(good) == sorted(want, key=str) and 0 < len(want) <= docs.count()

    once = Scratch(stages["exact"](spark, good, SF), "t").df
    keep = {i for i, _, _, kept, _ in brute_exact(want) if kept}
    assert once.columns == columns and pairs(once) == sorted(((i, t) for i, t in want if i in keep), key=str)

    apart = Scratch(stages["near"](spark, once, SF), "t").df
    left = pairs(once)
    keep = {i for i, _, c in brute_near(left) if i == c}
    assert apart.columns == columns and pairs(apart) == [x for x in left if x[0] in keep]

    mixed = stages["mixing"](spark, apart, SF)
    order = [r["doc_id"] for r in mixing.mix(apart).orderBy("position").collect()]
    assert mixed.columns == columns and [r["doc_id"] for r in mixed.collect()] == order

    tokens = defaultdict(int)
    for r in stages["packing"](spark, Scratch(mixed, "t").df, SF).collect():
        tokens[r["doc_id"]] += r["length"]
    encode = packing.word_bpe(packing.public_path())
    assert tokens == {i: len(encode(t)) // 4 for i, t in pairs(apart)}


def test_sequences_follow_the_mix_after_the_table_is_read_again(spark):
    held = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.maxPartitionBytes": "64k", "spark.sql.files.openCostInBytes": "64k"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        mixed = dict(corpus_pipeline.STAGES)["mixing"](spark, table(spark, SF, "documents"), SF)
        path = scratch_path(spark, "t")
        ids = [r["doc_id"] for r in mixed.collect()]
        for a, b in ((0, 20), (20, 120), (120, 140), (140, len(ids))):  # files of unequal size
            mixed.where(mixed["doc_id"].isin(ids[a:b])).coalesce(1).write.mode("append").parquet(path)
        read = spark.read.schema(mixed.schema).parquet(path)
        assert [r["doc_id"] for r in read.collect()] != ids
        place = {r["doc_id"]: r["position"] for r in mixing.mix(read).collect()}
        assert sorted(place, key=place.get) == ids
        by = defaultdict(list)
        for r in dict(corpus_pipeline.STAGES)["packing"](spark, read, SF).collect():
            by[r["sequence_id"] >> 33].append(place[r["doc_id"]])
        parts = [by[k] for k in sorted(by)]
        assert len(parts) > 1 and all(max(a) < min(b) for a, b in zip(parts, parts[1:], strict=False))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def whole(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_stages_stand_awkward_rows(spark):
    """Nulls, empty and long texts, ties, repeated rows and clashing names: every column of what stays is as it was."""
    bare = lambda t: re.sub("[ \t-\r]", "", t or "")
    rows = [*texts(), texts()[0], (None, None)]
    docs = frame(spark, rows).withColumn("position", mixing.F.lit(5))
    stages = dict(corpus_pipeline.STAGES)
    model = quality.learned(spark, table(spark, SF, "documents"), SF)
    good = stages["quality"](spark, docs.select("*"), SF)
    assert good.columns == docs.columns and set(whole(good)) <= set(whole(docs))
    got = quality.score(docs, model, score_col="_p").select("doc_id", "text", "_p").collect()
    assert len(got) == len(rows) and all(abs(r["_p"] - brute_score(r["text"], model)) < 1e-9 for r in got)
    once = Scratch(stages["exact"](spark, docs, SF), "t").df
    assert sorted(bare(r["text"]) for r in once.collect()) == sorted({bare(t) for _, t in rows})
    assert once.columns == docs.columns and set(whole(once)) <= set(whole(docs))
    apart = Scratch(stages["near"](spark, once, SF), "t").df
    assert 0 < apart.count() < once.count() and apart.columns == docs.columns and set(whole(apart)) <= set(whole(once))
    mixed = stages["mixing"](spark, apart, SF)
    assert mixed.columns == docs.columns and whole(mixed) == whole(apart)
    encode, tokens = packing.word_bpe(packing.public_path()), defaultdict(int)
    for r in stages["packing"](spark, docs, SF).collect():
        tokens[r["doc_id"]] += r["length"]
    want = defaultdict(int)
    for i, t in rows:
        want[i] += len(encode(t)) // 4
    assert tokens == want
    empty = frame(spark, [])
    for name in ("quality", "exact", "near", "mixing", "packing"):
        assert stages[name](spark, empty, SF).count() == 0


def test_quality_stage_keeps_what_plain_scores_keep(spark):
    docs = table(spark, SF, "documents")
    model = quality.learned(spark, docs, SF)
    want = [(r["doc_id"], r["text"]) for r in docs.collect() if brute_score(r["text"], model) >= 0.5]
    assert pairs(dict(corpus_pipeline.STAGES)["quality"](spark, docs, SF)) == sorted(want, key=str) and len(want) < docs.count()
