"""Each operator against a brute-force version, on awkward rows and on a small table."""

import hashlib
import math
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from rows import frame, texts

from paperloom.llm import byte_spans, exact_dedup, fingerprints, licences, mixing, near_dup, packing, quality, sentence_spans, warc
from paperloom.runtime import scratch_path, table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents")


@pytest.fixture(scope="module")
def plain(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def both(spark, plain):
    return [(frame(spark), texts()), (frame(spark, plain), plain), (frame(spark, []), [])]


def same(found, wanted):
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(map(tuple, found), key=key) == sorted(map(tuple, wanted), key=key)


# 1 packing


def test_packing_holds_every_id_once(spark, plain):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.public_path())
    for df, rows in both(spark, plain[:60]):
        pieces, sequences = defaultdict(list), defaultdict(list)
        for r in packing.pack(df, packing.public_path(), with_ids=True).collect():
            ids = np.frombuffer(r["ids"], "<u4")
            assert len(ids) == r["length"] > 0 and zlib.crc32(r["ids"]) == r["ids_crc32"]
            pieces[r["doc_id"], r["doc_tokens"]].append((r["start"], ids.tolist()))
            sequences[r["sequence_id"]].append((r["offset"], r["length"], r["sequence_length"]))
        want = defaultdict(list)
        for i, t in rows:
            ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
            want[i, len(ids)].append(ids)
        assert {k: sorted(x for _, p in v for x in p) for k, v in pieces.items()} == {k: sorted(x for d in v for x in d) for k, v in want.items()}
        for k, v in want.items():
            if len(v) == 1:
                assert [x for _, p in sorted(pieces[k]) for x in p] == v[0]
        for parts in sequences.values():
            at = 0
            for offset, length, whole in sorted(parts):
                assert offset == at
                at += length
            assert at == whole <= 4096 and at & (at - 1) == 0


def test_word_ids_are_the_tokenizers(plain):
    from tokenizers import Tokenizer

    tokenizer, encode = Tokenizer.from_file(packing.public_path()), packing.word_bpe(packing.public_path())
    odd = ["It's DON'T we'll x'D ''s 's", "a\tb\rc\x0bd\x0ce\x1cf", "<|endoftext|> hi <|startoftext|>x", "é ́    İΣΑΣ ß ŒÆ ǅ 漢字 １２ ½ ² a1b22", "x...y,,z!?.a_b-c $5.00 A1B2 #@!", "", "\n\n  ", "o'clock's 'tis 'RE", "\x00\x01 a\x00b"]
    for text in [t for _, t in plain[:40]] + odd:
        assert np.frombuffer(encode(text), "<u4").tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 2]


def test_bins_take_a_fixed_number_of_documents():
    bins = packing.Bins()
    out = [s for k in range(9) for s in bins.put((k, 0, 1024, b"\0" * 4096))]
    assert [[p[:3] for p in s] for s in out] == [[(k, 0, 1024) for k in range(4)], [(k, 0, 1024) for k in range(4, 8)]]
    assert [[p[2] for p in s] for s in bins.finish()] == [[1024]]
    bins = packing.Bins()
    assert not [s for k in range(3) for s in bins.put((k, 0, 1100, b"\0" * 4400))]  # three of class 3 wait for 796 ids
    out = list(bins.put((9, 0, 5000, b"\0" * 20_000)))
    assert [[p[:3] for p in s] for s in out] == [[(9, 0, 4096)], [(0, 0, 1100), (1, 0, 1100), (2, 0, 1100), (9, 4096, 796)]]
    assert [[p[:3] for p in s] for s in bins.finish()] == [[(9, 4892, 64)], [(9, 4956, 32)], [(9, 4988, 8)], [(9, 4996, 4)]]


def test_bins_on_random_lengths():
    """Each id once and in order, full bins without padding, and few documents cut, whether long ones come or not."""
    rng = np.random.default_rng(6)
    for most in (400, 4096, 9000):
        sizes = rng.integers(1, most, 3000).tolist()
        bins, out = packing.Bins(), []
        for k, n in enumerate(sizes):
            out += bins.put((k, 0, n, np.arange(n, dtype="<u4").tobytes()))
        whole = len(out)
        assert sum(p[2] for x in bins.open.values() for p in x) <= 64 * 4096 and len(bins.waiting) <= packing.WAITING
        out += bins.finish()
        at = dict.fromkeys(range(len(sizes)), 0)
        pieces = sorted((doc, start, size, ids) for s in out for doc, start, size, ids in s)
        for doc, start, size, ids in pieces:
            assert start == at[doc] and size > 0 and np.frombuffer(ids, "<u4").tolist() == list(range(start, start + size))
            at[doc] += size
        assert list(at.values()) == sizes
        lengths = [sum(p[2] for p in s) for s in out]
        assert set(lengths[:whole]) == {4096} and all(n & (n - 1) == 0 for n in lengths)
        cut = {p[0] for p in pieces if p[2] < sizes[p[0]] <= 4096}
        assert len(cut) < sum(n <= 4096 for n in sizes) / (2 if most == 4096 else 5)


def test_few_documents_are_cut(spark):
    got = packing.op1_packing(spark, "/root/testdata/sf0.01").where("doc_tokens <= 4096").selectExpr("count(distinct doc_id) as n", "count(distinct if(length < doc_tokens, doc_id, null)) as cut").first()
    assert got["n"] > 900 and 5 * got["cut"] < got["n"]


# 2 mixing


def test_pfair_lag_is_below_one_block():
    for weights in ({"a": 1}, {"a": 5, "b": 3, "c": 1}, {str(k): (k + 1) ** 2 for k in range(17)}, {"a": 1000, "b": 1}):
        slots = mixing.shares(weights, 200)
        assert sum(slots.values()) == max(200, len(weights))
        at, period = mixing.pfair(slots), sum(slots.values())
        assert sorted(x for v in at.values() for x in v) == list(range(period))
        for s, n in slots.items():
            done = np.cumsum(np.bincount(at[s], minlength=period))
            assert np.abs(done - np.arange(1, period + 1) * n / period).max() < 1


def test_lag_against_the_weights_is_below_one_block():
    for n in (3, 20, 500, 1000, 1500):
        weights = {"hot": n / 2.0, **{f"s{k}": 1.0 for k in range(n - 1)}}
        blocks = {s: math.ceil(40 * w) for s, w in weights.items()}
        at = mixing.schedule(mixing.shares(mixing.targets(weights, list(weights), 1000), mixing.FINE), blocks)
        assert sorted(x for v in at.values() for x in v)[-1] < 2 * sum(blocks.values())
        for s, w in weights.items():
            j, share = np.arange(blocks[s]), w / sum(weights.values())
            slots = np.array(at[s])
            assert (slots >= np.floor(j / share - 1e-6)).all() and (slots + 1 <= np.ceil((j + 1) / share + 1e-6)).all()


def test_mix_of_many_sources_keeps_the_weights(spark):
    rows = [(k, "hot") for k in range(3000)] + [(3000 + k, f"s{k % 1200}") for k in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, source string")
    weights = {"hot": 600.0, **{f"s{k}": 1.0 for k in range(1200)}}
    got = mixing.mix(df, weights, block=1).where("source = 'hot' and slot < 1800").count()
    assert abs(got - 600) <= 1
    assert mixing.targets({"a": 3.0}, ["a", "b", None], 1000) == {"a": 3.0, "b": 0.003, None: 0.003}


def test_mix_places_each_row_once(spark, plain):
    for df, rows in both(spark, plain):
        got = mixing.mix(df, block=4, period=20).collect()
        assert len(got) == len(rows) and len({r["position"] for r in got}) == len(rows)
        assert all(r["position"] // 4 == r["slot"] and r["_source"] == "w" for r in got)
        by = defaultdict(set)
        for r in got:
            by[r["slot"]].add(r["source"])
        assert all(len(v) == 1 for v in by.values())


def brute_mix(df, rows, weights, block):
    """Slots taken one by one: of the sources whose next block is released, the one whose block is due first."""
    hashes = {(r["doc_id"], r["text"]): r["h"] for r in df.selectExpr("doc_id", "text", "xxhash64(doc_id) as h").collect()}
    source = lambda i: None if (i or 0) % 3 == 0 else f"s{(i or 0) % 3}"  # noqa: E731  as in rows.frame
    by = defaultdict(list)
    for i, t in rows:
        by[source(i)].append((hashes[i, t], i is not None, i or 0))
    total = sum(weights.values())
    done, slot, out = dict.fromkeys(by, 0), 0, []
    while any(done[s] * block < len(v) for s, v in by.items()):
        ready = []
        for s in sorted(by, key=str):
            j = done[s]
            if j * block < len(by[s]) and j * total / weights[s] < slot + 1 - 1e-9:
                ready.append((math.ceil((j + 1) * total / weights[s] - 1e-9), str(s), s))
        if ready:
            _, _, s = min(ready, key=lambda x: x[:2])
            members = [x[2] if x[1] else None for x in sorted(by[s])]
            out += [(i, slot, slot * block + k) for k, i in enumerate(members[done[s] * block : (done[s] + 1) * block])]
            done[s] += 1
        slot += 1
    return out


@pytest.mark.parametrize("weights", [{"s1": 3.1417, "s2": 1.3713, None: 2.2391}, {"s1": 1.0137, "s2": 1.1719, None: 7.3331}])
def test_mix_is_a_plain_schedule(spark, plain, weights):
    for rows in (texts(), plain):
        df = frame(spark, rows)
        got = mixing.mix(df, weights, block=4).collect()
        same([(r["doc_id"], r["slot"], r["position"]) for r in got], brute_mix(df, rows, weights, 4))
        # the table's own lag: what a source has had of its share, until it has run out
        most = {s: max((r["slot"] for r in got if r["source"] == s), default=-1) for s in weights}
        for s, w in weights.items():
            taken = sorted({r["slot"] for r in got if r["source"] == s})
            for now in range(most[s] + 1):
                assert abs(sum(x <= now for x in taken) - (now + 1) * w / sum(weights.values())) < 1


def test_stage_keeps_columns_of_the_same_names(spark):
    rows = [(1, "a text", "x", 777, 778, "mine"), (2, "another", None, 1, 2, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, slot int, position int, score string")
    same([tuple(r) for r in mixing.in_mixed_order(df).collect()], rows)
    got = [tuple(r) for r in quality.keep_good(spark, df, SF, least=0.0).collect()]
    same(got, rows)


def test_ranks_in_many_buckets(spark, docs):
    rows = mixing.source_ranks(docs, docs.count(), docs["source"], "doc_id", per_bucket=10).collect()
    by = defaultdict(list)
    for r in rows:
        by[r["_source"]].append(r["_rank"])
    assert len(rows) == 200 and all(sorted(v) == list(range(len(v))) for v in by.values())


# 3 exact dedup


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub("[ \t-\r]", "", t or "")].append((i, len(t or "")))
    out = []
    for norm, members in groups.items():
        keep = sorted(members, key=lambda m: (-m[1], m[0] is None, m[0] or 0))[0][0]
        out += [(i, keep, len(members), i == keep, hashlib.sha256(norm.encode()).hexdigest()) for i, _ in members]
    return out


def test_exact_groups(spark, plain):
    for df, rows in both(spark, plain):
        same(exact_dedup.exact_groups(df).collect(), brute_exact(rows))


def test_exact_groups_with_colliding_hashes(spark, monkeypatch):
    real = exact_dedup.F.substring
    monkeypatch.setattr(exact_dedup.F, "substring", lambda c, a, n: exact_dedup.F.lit(b"x") if c == "_sha" else real(c, a, n))
    same(exact_dedup.exact_groups(frame(spark)).collect(), brute_exact(texts()))


def test_drop_exact_copies_keeps_one_of_each(spark):
    kept = [re.sub("[ \t-\r]", "", r["text"] or "") for r in exact_dedup.drop_exact_copies(frame(spark)).collect()]
    assert sorted(kept) == sorted({re.sub("[ \t-\r]", "", t or "") for _, t in texts()})


# 4 quality


def test_quality_on_held_out_rows(spark):
    rows = [r.asDict() for r in quality.op4_quality(spark, "/root/testdata/sf0.01").collect()]
    labels = {r["doc_id"]: r["quality"] for r in table(spark, "/root/testdata/sf0.01", "labels").collect()}
    assert len(rows) == 1000
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
    held = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert sum(p == q for p, q in held) / len(held) > 0.93


def test_quality_on_awkward_rows(spark):
    model = quality.fit(["good words here and there"] * 9, ["###!!! ### $$$"] * 9)
    rows = quality.score(frame(spark), model).collect()
    assert len(rows) == len(texts()) and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.score(frame(spark, []), model).count() == 0
    assert quality.fit([], ["x"]).offset < 0 < quality.fit(["x"], []).offset
    assert quality.fit(["x"], ["y"]).level == 3


def brute_score(text, model):
    """From plain zstandard: blocks of 512 bytes compressed with either dictionary, and the curve."""
    import zstandard

    raw, total = (text or "").encode(), [0, 0]
    for k, d in enumerate((model.good, model.bad)):
        c = zstandard.ZstdCompressor(level=model.level, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False)
        total[k] = sum(len(c.compress(raw[at : at + 512])) for at in range(0, len(raw), 512))
    x = (total[1] - total[0]) / (total[0] + total[1]) if raw else 0.0
    return 1 / (1 + math.exp(-(model.slope * x + model.offset)))


def test_scores_are_plain_zstandards(spark, plain, docs):
    model = quality.learned(spark, docs, SF)
    assert len(model.good) > 1000 and len(model.bad) > 1000 and model.slope > 0
    for df, rows in both(spark, plain):
        got = sorted((str(r["doc_id"]), r["text"] or "", r["score"]) for r in quality.score(df, model, score_col="score").select("doc_id", "text", "score").collect())
        want = sorted((str(i), t or "", brute_score(t, model)) for i, t in rows)
        assert [x[:2] for x in got] == [x[:2] for x in want] and np.allclose([x[2] for x in got], [x[2] for x in want], rtol=1e-9)


def test_held_out_labels_teach_nothing(spark, docs, tmp_path):
    labels = table(spark, SF, "labels")
    flipped = labels.withColumn("quality", quality.F.when(quality.F.expr(quality.HELD_OUT), 1 - labels["quality"]).otherwise(labels["quality"]))
    assert flipped.exceptAll(labels).count() > 0
    flipped.write.parquet(str(tmp_path / "labels.parquet"))
    assert quality.learned(spark, docs, str(tmp_path)) == quality.learned(spark, docs, SF)


# 5 fingerprints


def brute_likeness(a, b):
    """From the sums of signs of the hash bits of neighbouring words, over paragraphs."""
    import xxhash

    def units(text):
        out = []
        for line in filter(None, text.split("\n")):
            w = line.split(" ")
            for k, x in enumerate(w):
                h = xxhash.xxh64_intdigest(x.encode(), seed=42)
                out.append(xxhash.xxh64_intdigest(w[k + 1].encode(), seed=h) if k + 1 < len(w) else h)
        return np.array(out, np.uint64)

    def signs(text):
        u = units(text)
        return np.array([2 * int(((u >> np.uint64(k)) & np.uint64(1)).sum()) - len(u) for k in range(64)], float)

    if sorted(filter(None, a.split("\n"))) == sorted(filter(None, b.split("\n"))):
        return 1.0
    x, y = signs(a), signs(b)
    both = (x**2).mean() + (y**2).mean()
    return max(0.0, min(1.0, 1 - ((x - y) ** 2).mean() / (both or 1.0)))


def test_likeness_is_that_of_the_sign_sums(spark, plain):
    rows = [(i, t[:3000]) for i, t in plain[:80]] + [(1000, ""), (1001, "one"), (1002, "one\n\none"), (1003, "a  b\n a")]
    got = {r["doc_id"]: r for r in fingerprints.fingerprints(frame(spark, rows)).collect()}
    order, after = neighbours(rows)
    for (i, t), (_, u) in zip(order, after, strict=True):
        half = len(t) // 2
        assert got[i]["near_next"] == pytest.approx(brute_likeness(t, u), abs=1e-9)
        assert got[i]["near_edited"] == pytest.approx(brute_likeness(t, t[: len(t) - half] + u[:half]), abs=1e-9)


def neighbours(rows):
    order = sorted((r for r in rows if r[0] is not None), key=lambda r: -r[0]) + [r for r in rows if r[0] is None]
    return order, order[1:] + order[:1]


def test_fingerprints(spark, plain):
    got = {r["doc_id"]: r for r in fingerprints.fingerprints(frame(spark, plain)).collect()}
    order, after = neighbours(plain)
    assert len(got) == len(plain)
    for (i, t), (j, u) in zip(order, after, strict=True):
        r, half = got[i], len(t) // 2
        edited = t[: len(t) - half] + u[:half]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert (r["near_next"] == 1) == (r["fingerprint"] == got[j]["fingerprint"])
    by = defaultdict(set)
    for i, t in plain:
        by["\n".join(sorted(x for x in t.split("\n") if x))].add(got[i]["fingerprint"])
    assert all(len(v) == 1 for v in by.values()) and len({x for v in by.values() for x in v}) == len(by)
    assert np.mean([r["near_edited"] for r in got.values()]) > np.mean([r["near_next"] for r in got.values()]) + 0.25


def test_fingerprints_on_awkward_rows_and_small_buckets(spark, monkeypatch):
    rows = fingerprints.fingerprints(frame(spark)).collect()
    assert len(rows) == len(texts()) and all(0 <= r[k] <= 1 for r in rows for k in ("near_edited", "near_next"))
    assert fingerprints.fingerprints(frame(spark, [])).count() == 0
    real = fingerprints.with_next
    monkeypatch.setattr(fingerprints, "with_next", lambda d: real(d, bucket_bytes=2000))
    key = lambda r: (r["doc_id"] is None, r["doc_id"], r["fingerprint"], r["edited_sha256"])
    assert sorted(map(key, fingerprints.fingerprints(frame(spark)).collect()), key=str) == sorted(map(key, rows), key=str)


def test_fingerprints_add_and_take_away(spark):
    F = fingerprints.F
    rows = spark.createDataFrame([(1, "a b\nc d e\nf"), (2, "f\nc d e"), (3, "a b"), (4, "c d e\na b\nf")], "k int, t string")
    v = {r["k"]: r["v"] for r in fingerprints.with_units(rows, F.col("t"), ["k"]).groupBy("k").agg(*fingerprints.vector_sums()).select("k", fingerprints.vector().alias("v")).collect()}
    assert v[1] == v[4]
    lit = lambda x: F.array(*map(F.lit, x))
    r = spark.range(1).select(fingerprints.combine(lit(v[2]), lit(v[3])).alias("sum"), fingerprints.combine(lit(v[1]), lit(v[3]), -1).alias("rest")).first()
    assert r["sum"] == v[1] and r["rest"] == v[2]


# 6 near copies


def brute_near(rows):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                up[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None and sets[k]:
            least[root(k)] = min(i, least.get(root(k), i))
    return [(i, len(s), least.get(root(k)) if s else i) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True))]


def test_near_groups(spark, plain):
    for df, rows in both(spark, plain):
        same(near_dup.near_groups(df).collect(), brute_near(rows))


def test_near_groups_of_many_near_copies(spark, plain, monkeypatch):
    monkeypatch.setattr(near_dup, "HOT", 3)
    rng = np.random.default_rng(5)
    words = " ".join(t for _, t in plain[:3]).split()[:400]
    rows = []
    for k in range(60):
        w = words[: 60 + 60 * (k % 5)]
        for x in rng.integers(0, len(w), rng.integers(0, 4)):
            w = [*w[:x], f"new{rng.integers(9)}", *w[x + 1 :]]
        rows.append((k, " ".join(w)))
    same(near_dup.near_groups(frame(spark, rows)).collect(), brute_near(rows))


@pytest.mark.parametrize("block", [1024, 7])
def test_near_groups_of_subclusters_around_a_common_passage(spark, monkeypatch, block):
    """Clusters that hold one passage but don't link, members far from their cluster's centre that link to each other only, halves without words of their own, and null ids."""
    monkeypatch.setattr(near_dup, "HOT", 4)
    monkeypatch.setattr(near_dup, "BLOCK", block)
    rng = np.random.default_rng(8)
    passage = [f"p{k}" for k in range(60)]
    rows = []
    for c in range(5):
        own = passage + [f"c{c}x{k}" for k in range(20 + 30 * c)]
        for _ in range(14):
            w = list(own)
            for x in rng.integers(0, len(w), rng.integers(0, 5)):
                w[x] = f"n{rng.integers(6)}"
            rows.append(w)
        for _ in range(6):  # pieces of the cluster's text alone: no rare shingles at all
            a = int(rng.integers(0, len(own) // 2))
            rows.append(own[a : a + int(rng.integers(len(own) // 3, len(own)))])
        far = own[: len(own) // 2] + [f"f{c}y{k}" for k in range(len(own) // 2)]
        rows += [far, [*far[:-1], "z"], [*far[1:]]]
    rows += [[f"w{rng.integers(40)}" for _ in range(rng.integers(1, 9))] for _ in range(30)]
    rows = [(k, " ".join(w)) for k, w in enumerate(rows)]
    rows += [(None, rows[0][1] + " more"), (None, "only here twice and linked to each other by most of their words a b c d e f g"), (None, "only here twice and linked to each other by most of their words a b c d e f h"), (900, "only here twice and linked to each other by most of their words a b c d e f")]
    rows += [rows[0]] * 9 + [(None, rows[20][1])] * 9 + [(901, t) for _, t in rows[40:60]]  # repeated rows, null ids, an id of many texts
    same(near_dup.near_groups(frame(spark, rows).repartition(7)).collect(), brute_near(rows))


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a = np.unique(rng.integers(0, 1 << 63, rng.integers(3, 900)).astype(np.uint64))
        b = np.unique(np.r_[a[rng.random(len(a)) > 0.1], rng.integers(0, 1 << 63, rng.integers(1, 90)).astype(np.uint64)])
        apart = len(np.setxor1d(a, b))
        assert near_dup.apart_at_least(near_dup.parity_sketch(a), near_dup.parity_sketch(b)) <= apart
        if 7 * apart <= len(a) + len(b):
            assert len(np.intersect1d(near_dup.slot_keys(a), near_dup.slot_keys(b))) > max(near_dup.droppable(len(a)), near_dup.droppable(len(b)))


# 7 WARC


def test_warc_round_trip(spark):
    html = "<p>" + "x" * 150
    rows = [(1, "u", html), (2, None, html), (3, "a\r\nb", None), (4, "u", "é" * 50_000 + "\r\n\r\nWARC/1.1\r\n"), (5, "u", "short"), (6, "u", "short"), (1, "u", html), (None, "u", html), (None, None, None), (7, "u", "y" * 99), (8, "u", "y" * 99), (9, "u", "y" * 100), (10, "u", "y" * 100)]
    pages = spark.createDataFrame([(*r, "z", "w") for r in rows], "page_id long, url string, html string, record string, _first string")
    path = scratch_path(spark, "t")
    warc.write_warc(pages, path)
    first = {html: 1, "y" * 100: 9}
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        to = first.get(h) if first.get(h) != i else None
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if to else "response", to, True))
    same(warc.read_warc(spark, path).collect(), want)
    empty = scratch_path(spark, "t")
    warc.write_warc(pages.limit(0), empty)
    assert warc.read_warc(spark, empty).count() == 0


def test_each_record_is_a_gzip_member(spark):
    path = scratch_path(spark, "t")
    pages = spark.createDataFrame([(k, "u", f"page {k} " * (1 + 3000 * (k == 3))) for k in range(6)], "page_id long, url string, html string")
    warc.write_warc(pages.coalesce(1), path, segment=4096)
    files = spark.read.format("binaryFile").load(path + "/*.warc.gz").collect()
    members, records = 0, 0
    for f in files:
        rest = f["content"]
        while rest:
            d = zlib.decompressobj(31)
            text = d.decompress(rest)
            assert d.eof and text.startswith(b"WARC/1.1\r\n") and text.endswith(b"\r\n\r\n")
            records += len(list(warc.read_records(__import__("io").BytesIO(text))))
            members, rest = members + 1, d.unused_data
    assert members == records > 6
    assert sorted((r["page_id"], r["intact"]) for r in warc.read_warc(spark, path).collect()) == [(k, True) for k in range(6)]


def test_broken_segments_are_told():
    blocks = [{"origin": "<urn:page:3:0.1>", "number": n, "total": None, "digest": "", "block": b"x"} for n in (1, 3)]
    assert warc.reassembled(blocks) == (3, None, None, "response", None, False)
    assert warc.dechunked(warc.chunked(b"ab\r\n" * 9000)) == b"ab\r\n" * 9000


# 8 licences


def brute_licence(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(k, label) for phrase, label in licences.BASE.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
    return len(words), len(places), min((k for k, _ in places), default=None), max((k for k, _ in places), default=None), ",".join(sorted({x for _, x in places}))


def test_licence_scan(spark, plain):
    for df, rows in both(spark, plain):
        got = licences.licence_scan(df).collect()
        same([r[:6] for r in got], [(i, *brute_licence(t)) for i, t in rows])
        assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in got)


def test_licence_expressions():
    e = licences.evaluate
    assert e("MIT OR GPL-3.0-only") == ({"mit", "gpl"}, True)
    assert e("MIT AND GPL-2.0+") == ({"mit", "gpl"}, False)
    assert e("MIT OR GPL-2.0 AND LGPL-2.1") == ({"mit", "gpl", "lgpl"}, True)
    assert e("(MIT OR GPL-2.0) AND LGPL-2.1") == ({"mit", "gpl", "lgpl"}, False)
    assert e("Apache-2.0 WITH LLVM-exception") == ({"apache"}, True)
    for bad in ("", "MIT OR", "AND MIT", "(MIT", "MIT)", "MIT GPL", "()", "WITH"):
        assert e(bad) is None
    n = licences.scan("x\n# SPDX-License-Identifier: Apache-2.0 OR MIT\nmit license mit license")
    assert n[:4] == (13, 2, 9, 11) and n[4:7] == ("mit", "apache,mit", 1.0)


def test_licence_tags_with_more_on_their_line():
    for text, labels in (
        ("SPDX-License-Identifier: MIT This file is part of it", "mit"),
        ("SPDX-License-Identifier: MIT SPDX-License-Identifier: Apache-2.0 more", "apache,mit"),
        ("SPDX-License-Identifier: MIT OR SPDX-License-Identifier: ISC", "isc,mit"),
        ("<!-- SPDX-License-Identifier: (MIT OR ISC) AND (GPL-2.0 -->", "isc,mit"),
        ("SPDX-License-Identifier: OR MIT", ""),
    ):
        found = licences.scan(text)
        assert found[5] == labels and found[6] == (1.0 if labels else 0.0)
    assert licences.well_formed("((MIT)) WITH x) y") == "((MIT)) WITH x"
    assert licences.well_formed("(" * 100_000 + "MIT") == ""


# 9 byte spans


def brute_bytes(df, rows, span=400, least=256):
    raws = [(t or "").encode() for _, t in rows]
    tags = {(r["doc_id"], r["text"]): r["tag"] for r in df.selectExpr("doc_id", "text", "xxhash64(text) as tag").collect()}
    place = [(-(1 << 63) if i is None else i, tags[i, t]) for i, t in rows]

    def left(size, hit):
        """Per row: bytes that go, their runs, and the bytes that stay, where ``hit`` tells if the string at a place goes."""
        starts = defaultdict(list)
        for d, raw in enumerate(raws):
            for k in range(len(raw) - size + 1):
                starts[raw[k : k + size]].append((d, k))
        gone = [bytearray(len(r)) for r in raws]
        for where in starts.values():
            first = min((*place[d], k) for d, k in where)
            for d, k in where:
                if hit(len(where), (*place[d], k) != first):
                    gone[d][k : k + size] = b"\1" * size
        kept = [bytes(b for b, f in zip(raw, flags, strict=True) if not f) for raw, flags in zip(raws, gone, strict=True)]
        return [(len(raw) - len(k), len(re.findall(b"\1+", bytes(f))), k) for raw, k, f in zip(raws, kept, gone, strict=True)]

    both = zip(rows, raws, left(span, lambda n, later: n > 1), left(least, lambda n, later: later), strict=True)
    return [(i, len(raw), *whole, *later) for (i, _), raw, whole, later in both]


def crafted(plain):
    rng = np.random.default_rng(3)
    shared = [t.replace("\n", " ")[:700] for _, t in plain[:6] if len(t) > 800]
    rows = []
    for k, (_, t) in enumerate(plain[:70]):
        s = shared[k % len(shared)]
        a = int(rng.integers(0, 150))
        t = t[:2500]
        x = int(rng.integers(0, len(t) + 1))
        rows.append((k, t[:x] + s[a : a + int(rng.integers(380, 520))] + t[x:]))
    return [*rows, (100, "ab" * 900), (101, "abc" * 500), (102, "q" * 399), (103, "q" * 400), (104, "q" * 401), (105, "é" * 300)]


def test_repeated_bytes(spark, plain):
    short = [r for r in texts() if len(r[1] or "") < 10_000]
    long_ones = [(200, "x" * 50 + " ".join(map(str, range(9000)))), (201, " ".join(map(str, range(9000))))]
    for rows in (short, crafted(plain), [*long_ones, *long_ones[:1]], []):
        df = frame(spark, rows)
        same(byte_spans.repeated_bytes(df).collect(), brute_bytes(df, rows))


def test_repeated_bytes_of_hot_cores(spark, plain):
    rows = crafted(plain)
    df = frame(spark, rows)
    want = brute_bytes(df, rows)
    same(byte_spans.repeated_bytes(df, hot=2).collect(), want)
    same(byte_spans.repeated_bytes(df, span=256).select("doc_id", "n_removed", "kept_first").collect(), [(i, n, k) for (i, _, n, *_), (*_, k) in zip(brute_bytes(df, rows, 256), want, strict=True)])


def test_cores_that_fill_several_chunks(spark, plain):
    """Runs of equal windows and hot cores go on from one chunk of rows to the next."""
    rows = crafted(plain)
    df = frame(spark, rows)
    tagged = df.selectExpr("doc_id as _id", "xxhash64(text) as _tag", "text as _text")
    by = lambda chunk, hot: byte_spans._by_core(byte_spans._anchor_rows(tagged, 400, 256, 128).repartition(2, "_core").sortWithinPartitions("_core", "_w1", "_w2", "_id", "_tag", "_at"), 400, hot, chunk)
    for hot in (2, 20_000):
        whole, cut = ({(r["_kind"], r["_core"], r["_w1"], r["_id"], r["_at"]) for r in by(c, hot).where("_kind < 8").collect()} for c in (200_000, 3))
        assert {r[1:] for r in whole} == {r[1:] for r in cut} if hot > 2 else {r[1:] for r in whole} <= {r[1:] for r in cut}


def test_longest_previous():
    from paperloom.llm.factors import longest_previous

    rng = np.random.default_rng(2)
    for n in (0, 1, 5, 60):
        t = bytes(rng.integers(97, 99, n).astype(np.uint8))
        brute = [max([0, *(next(k for k in range(n + 1) if i + k == n or t[i + k] != t[j + k]) for j in range(i))]) for i in range(n)]
        assert longest_previous(t).tolist() == brute


def test_factors_of_windows_of_one_core():
    """Strings around a core, against a comparison of all pairs."""
    rng = np.random.default_rng(4)
    for _ in range(60):
        n = int(rng.integers(2, 14))
        lefts = rng.integers(0, 9, n)
        windows = [bytes(rng.integers(97, 99, x).astype(np.uint8)) + b"core" + bytes(rng.integers(97, 99, rng.integers(0, 9)).astype(np.uint8)) for x in lefts.tolist()]
        places = [(int(x),) for x in rng.permutation(n)]
        got = byte_spans.settle_cores([7] * n, windows, lefts.tolist(), places, 10, 7)
        for x in range(n):
            want = [0, 0, 0, 0]
            for y in range(n):
                if x == y:
                    continue
                a, b, c, d = windows[x][: lefts[x]][::-1], windows[y][: lefts[y]][::-1], windows[x][lefts[x] :], windows[y][lefts[y] :]
                common = lambda p, q: next((k for k, (u, v) in enumerate(zip(p, q)) if u != v), min(len(p), len(q)))
                h, r = common(a, b), common(c, d)
                for k, size, ok in ((0, 10, True), (2, 7, places[y] < places[x])):
                    if ok and h + r >= size:
                        want[k], want[k + 1] = max(want[k], h), max(want[k + 1], r)
            assert list(got[x]) == want


# 10 sentence spans


def brute_spans(rows):
    place = lambda r: (r[0], sentence_spans._tag(r[1]))
    first = {}
    for r in sorted((r for r in rows if r[0] is not None), key=place):
        for h, k, _ in sentence_spans.spans(r[1]):
            first.setdefault(h, (*place(r), k))
    out = []
    for i, t in rows:
        marks = sentence_spans.sentences(t)
        flags = bytearray(len(marks))
        if i is not None:
            for h, k, size in sentence_spans.spans(t):
                if first[h] != (*place((i, t)), k):
                    flags[k : k + size] = b"\1" * size
        out.append((i, len(marks), sum(flags), sentence_spans.without(t or "", marks, flags) if sum(flags) else t or ""))
    return out


def test_repeated_spans(spark, plain):
    for df, rows in both(spark, plain):
        same(sentence_spans.repeated_spans(df).collect(), brute_spans(rows))


def plain_sentences(text):
    """Sentences by a walk over characters: a piece ends behind a line feed, or where white space follows a full stop, question or exclamation mark."""
    out, now = [], ""
    for k, c in enumerate(text):
        if c == "\n" or c.isspace() and now and (now[-1] in ".!?" or not now.strip()):
            if now.strip():
                out.append(now)
            now = ""
        else:
            now += c
    return [x.split() for x in [*out, now] if x.strip()]


def test_repeated_runs_of_sentences_go(spark, plain):
    """All runs of up to twelve sentences compared as words: three or more with ten words, or fewer with twenty."""
    rows = [(i, " ".join(t.split(" "))) for i, t in plain if len(t) < 6000][:150]
    rows += [(2000 + k, "It is. So! " * (k + 1) + "Then nothing more. " + rows[k][1][:700]) for k in range(20)]
    seen, want = set(), {}
    for i, t in rows:
        words = plain_sentences(t)
        gone = set()
        for a in range(len(words)):
            for b in range(a, min(a + 12, len(words))):
                n = sum(map(len, words[a : b + 1]))
                if n >= (10 if b - a >= 2 else 20):
                    key = tuple(tuple(w) for w in words[a : b + 1])
                    if key in seen:
                        gone |= set(range(a, b + 1))
                    seen.add(key)
        want[i] = (len(words), len(gone), [w for k, w in enumerate(words) if k not in gone])
    assert sum(g for _, g, _ in want.values()) > 50
    for r in sentence_spans.repeated_spans(frame(spark, rows)).collect():
        n, gone, kept = want[r["doc_id"]]
        assert (r["n_sentences"], r["n_removed"]) == (n, gone) and r["kept_text"].split() == [x for w in kept for x in w]


def test_a_planted_passage_goes_where_it_comes_again(spark):
    passage = "Here is a passage of some length. It has a second sentence with more words in it, and goes on. Then a third one ends it for good."
    rows = [(k, f"Text {k} begins in its own way. {passage} And text {k} ends in its own way.") for k in range(5)]
    got = {r["doc_id"]: r["kept_text"] for r in sentence_spans.repeated_spans(frame(spark, rows)).collect()}
    assert [passage in got[k] for k in range(5)] == [True] + [False] * 4
    assert all(got[k] == f"Text {k} begins in its own way. And text {k} ends in its own way." for k in range(1, 5))


def windows(text, n=51):
    w = text.split()
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}


def test_no_window_of_51_words_stays_twice(spark):
    rng = np.random.default_rng(11)
    words = [f"w{k}" for k in range(3000)]
    line = lambda most, ends: " ".join(rng.choice(words, rng.integers(1, most + 1))) + str(rng.choice(ends))
    rows = []
    for k, (most, ends) in enumerate([(1, ["\n"]), (2, ["!! ", "\n", "\n \n"]), (3, ["\n", ". "]), (6, ["? ", "\n\n"]), (16, [". "])]):
        passage = "".join(line(most, ends) for _ in range(130 // most + 30))
        rows += [(10 * k + c, "".join(line(most, ends) for _ in range(20)) + passage + "".join(line(most, ends) for _ in range(20))) for c in range(3)]
    assert all(windows(rows[3 * k][1]) & windows(rows[3 * k + c][1]) for k in range(5) for c in (1, 2))
    got = {r["doc_id"]: r["kept_text"] for r in sentence_spans.repeated_spans(frame(spark, rows)).collect()}
    seen = set()
    for i, _ in rows:
        assert not windows(got[i]) & seen
        seen |= windows(got[i])
    assert [got[i] for i, _ in rows[::3]] == [t for _, t in rows[::3]]


def test_longer_runs_cover_every_run_of_enough_words():
    rng = np.random.default_rng(12)
    for _ in range(200):
        sizes = [int(x) for x in rng.choice([0, 1, 1, 2, 3, 12], rng.integers(0, 25))]
        spans = {(a, b) for a, b in sentence_spans.longer(sizes, 3, 10)} | {(k, k + 2) for k in range(len(sizes) - 2) if sum(sizes[k : k + 3]) >= 10}
        for a in range(len(sizes)):
            for b in range(a, len(sizes)):
                worded = [k for k in range(a, b + 1) if sizes[k]]
                if len(worded) >= 3 and sum(sizes[a : b + 1]) >= 10:
                    assert set(worded) <= {k for x, y in spans if a <= x and y <= b for k in range(x, y + 1)}
    assert sentence_spans.longer([0] * 50_000 + [12, 1, 1], 3, 10) == []
