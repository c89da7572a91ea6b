"""Document fingerprints as homomorphic multiset hashes, in DataFrame functions alone."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.runtime import spread, table

#: Wide lanes (sums modulo 2^32 of halves of hashes of whole paragraphs) and sign lanes (sums modulo 2^24 of single hash bits of word pairs).
WIDE, SIGNS = 8, 64
_32, _24 = 0xFFFFFFFF, 0xFFFFFF


def with_units(rows: DataFrame, text: Column, keys: list[str]) -> DataFrame:
    """A row for each pair of neighbouring words of each paragraph, with the paragraph's wide hashes in its first row only.

    Paragraphs are the lines of a text; a paragraph's last word also counts alone. A text without lines gives one row of nulls.
    """
    lines = rows.select(*keys, F.explode_outer(F.filter(F.split(text, "\n"), lambda x: x != "")).alias("_p"))
    hashes = [F.xxhash64("_p", F.lit(seed)).alias(f"_w{seed}") for seed in range(WIDE // 2)]
    words = F.split("_p", " ")
    lines = lines.select(*keys, *hashes, words.alias("_words"))
    pairs = F.arrays_zip(F.col("_words").alias("a"), F.slice("_words", F.lit(2), F.greatest(F.size("_words") - 1, F.lit(0))).alias("b"))
    return lines.select(*keys, *(f"_w{seed}" for seed in range(WIDE // 2)), F.posexplode_outer(pairs).alias("_at", "_unit")).select(
        *keys, *(F.when(F.col("_at") == 0, F.col(f"_w{seed}")).otherwise(F.lit(0)).alias(f"_w{seed}") for seed in range(WIDE // 2)), F.xxhash64("_unit.a", "_unit.b").alias("_h"), F.col("_at").isNotNull().cast("long").alias("_one")
    )


def vector_sums() -> list[Column]:
    """Aggregates over ``with_units`` rows. Two sign lanes share a sum, 32 bits apart, so no sum leaves 64 bits below 2^31 units."""
    wide = [F.sum(f(F.col(f"_w{seed}"))).alias(f"_s{2 * seed + k}") for seed in range(WIDE // 2) for k, f in enumerate((lambda h: h.bitwiseAND(F.lit(_32)), lambda h: F.shiftrightunsigned(h, 32)))]
    signs = [F.sum(F.shiftright(F.col("_h"), bit).bitwiseAND(F.lit((1 << 32) + 1)) * F.col("_one")).alias(f"_b{bit}") for bit in range(SIGNS // 2)]
    return [*wide, *signs, F.sum("_one").alias("_units")]


def vector() -> Column:
    """The lanes of ``vector_sums`` as one array: units, wide lanes, sign lanes."""
    lanes = [F.col("_units").bitwiseAND(F.lit(_32))]
    lanes += [F.col(f"_s{k}").bitwiseAND(F.lit(_32)) for k in range(WIDE)]
    for bit in range(SIGNS // 2):
        lanes += [F.col(f"_b{bit}").bitwiseAND(F.lit(_24)), F.shiftrightunsigned(F.col(f"_b{bit}"), 32).bitwiseAND(F.lit(_24))]
    return F.array(*lanes)


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """The vector of the union of two multisets of paragraphs, or with sign -1 of the first without the second: insertion and deletion."""
    return F.transform(F.zip_with(a, b, lambda x, y: x + sign * y), lambda x, i: x.bitwiseAND(F.when(i <= WIDE, F.lit(_32)).otherwise(F.lit(_24))))


def as_text(v: Column) -> Column:
    """A vector as hex digits: 8 for the units and each wide lane, 6 for each sign lane."""
    return F.lower(F.array_join(F.transform(v, lambda x, i: F.when(i <= WIDE, F.lpad(F.hex(x), 8, "0")).otherwise(F.lpad(F.hex(x), 6, "0"))), ""))


def _energy(v: Column) -> Column:
    """The mean square of the sign lanes as sums of +1 and -1: it estimates the squared length of the multiset of word pairs."""
    units = F.element_at(v, 1)
    n = F.when(units >= 1 << 31, units - (1 << 32)).otherwise(units)
    signed = F.transform(F.slice(v, WIDE + 2, SIGNS), lambda c: F.pow((2 * F.when(c >= 1 << 23, c - (1 << 24)).otherwise(c) - n).cast("double"), F.lit(2.0)))
    return F.aggregate(signed, F.lit(0.0), lambda a, x: a + x) / SIGNS


def likeness(a: Column, b: Column) -> Column:
    """From two vectors alone: 1 for equal ones; else 1 - |A - B|^2 / (|A|^2 + |B|^2) as the sign lanes estimate it, held between 0 and 1."""
    both = _energy(a) + _energy(b)
    return F.when(a == b, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - _energy(combine(a, b, -1)) / F.when(both > 0, both).otherwise(F.lit(1.0)))))


def with_bucket(docs: DataFrame, bounds: list[int]) -> DataFrame:
    """``docs`` with ``_bucket``: how many of the rising bounds are at most ``_id`` (0 for null).

    A search in two steps: among every so many-th bound, which stand in the plan, about as many as the root of their number; then in a table of the bounds between, eight bytes each.
    """
    if not bounds:
        return docs.withColumn("_bucket", F.lit(0))
    step = max(1, math.isqrt(len(bounds)))
    fine = [(k // step + 1, k, bounds[k : k + step]) for k in range(0, len(bounds), step)]
    coarse = F.expr("array(" + ",".join(f"cast({xs[0]} as bigint)" for _, _, xs in fine) + ")")
    below = lambda xs: F.size(F.filter(xs, lambda x: x <= F.col("_id")))
    between = docs.sparkSession.createDataFrame(pa.table([pa.array(c, t) for c, t in zip(zip(*fine, strict=True), (pa.int32(), pa.int32(), pa.list_(pa.int64())), strict=True)], names=["_step", "_before", "_bounds"]))
    found = docs.withColumn("_step", F.when(F.col("_id").isNull(), F.lit(0)).otherwise(below(coarse))).join(F.broadcast(between), "_step", "left")
    return found.withColumn("_bucket", F.when(F.col("_step") == 0, F.lit(0)).otherwise(F.col("_before") + below(F.col("_bounds")))).drop("_step", "_before", "_bounds")


#: Buckets at most. Beyond that many of BUCKET_BYTES they grow: 100 TB makes a million of 100 MB, whose bounds are 8 MB.
MOST_BUCKETS, BUCKET_BYTES = 1 << 20, 8 << 20


def with_next(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``docs`` (_id, _text) with ``_bucket``, ``_row``, ``_guest`` and ``_next``, the text of the next row in descending order of the id.

    Ids are cut at quantiles into buckets of about ``bucket_bytes`` of text, and texts are shuffled once, by bucket. What follows a bucket's last row
    is the first row of the bucket below (of the lowest: of the topmost), which is sent to it as a guest row. The driver gets the bounds of the buckets; the first rows' ids are a table of a row for each bucket, sixteen bytes each.
    """
    known = docs.agg(F.sum(F.octet_length("_text")).alias("bytes"), F.count(F.lit(1)).alias("n")).first()
    wanted = max(1, min(MOST_BUCKETS, -(-(known["bytes"] or 0) // bucket_bytes), known["n"]))
    bounds: list[int] = []
    if wanted > 1:
        probabilities = [k / wanted for k in range(1, wanted)]
        bounds = sorted({int(x) for x in docs.where("_id is not null").select(F.col("_id").cast("double").alias("_id")).approxQuantile("_id", probabilities, max(1 / (8 * wanted), 1e-6))})
    rows = with_bucket(docs, bounds)
    tops = rows.groupBy("_bucket").agg(F.max("_id").alias("_top"))
    around = Window.orderBy("_bucket")  # a row for each bucket
    whole = Window.partitionBy()
    guests = tops.select("_top", F.coalesce(F.lead("_bucket").over(around), F.min("_bucket").over(whole)).alias("_to"))
    joined = rows.join(F.broadcast(guests), rows["_id"].eqNullSafe(guests["_top"]), "left")
    stay = F.struct(F.col("_bucket").alias("bucket"), F.lit(0).alias("guest"))
    places = F.when(F.col("_to").isNull(), F.array(stay)).otherwise(F.array(stay, F.struct(F.col("_to").alias("bucket"), F.lit(1).alias("guest"))))
    placed = joined.select("_id", "_text", F.explode(places).alias("_place")).select("_id", "_text", "_place.bucket", "_place.guest").toDF("_id", "_text", "_bucket", "_guest")
    order = Window.partitionBy("_bucket").orderBy("_guest", F.col("_id").desc_nulls_last(), F.xxhash64("_text"))
    return placed.select("*", F.row_number().over(order).alias("_row"), F.lead("_text").over(order).alias("_next"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each row's whole text and of its edited text, and how alike they say the texts are.

    A fingerprint is the sum, modulo powers of two, of vectors hashed from the text's paragraphs, so paragraphs may come in any order, and
    ``combine`` adds or takes away paragraphs. Wide lanes make unequal multisets of paragraphs differ; sign lanes, hashed from the
    paragraph's pairs of neighbouring words, give an estimate of likeness.

    The edited text is the text with its last floor(n / 2) code points replaced by the first as many (or all) of the next row's text, in descending order
    of the id, null ids last, repeated ids in the order of a hash of their texts; the first row follows the last. Null texts count as empty; an empty text
    has the vector 0, likeness 1 to an empty one and 0 to others. An empty table gives an empty result. Other columns are ignored.
    Returns: the id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    """
    rows = with_next(docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")))
    n = F.char_length("_text")
    edited = F.concat(F.expr("substring(_text, 1, char_length(_text) - char_length(_text) div 2)"), F.expr("substring(coalesce(_next, ''), 1, cast(char_length(_text) div 2 as int))"))
    rows = rows.select("_bucket", "_row", "_guest", "_id", n.cast("long").alias("_n"), "_text", F.when(F.col("_guest") == 0, edited).alias("_edited"))
    rows = rows.select("*", F.sha2(F.encode("_edited", "UTF-8"), 256).alias("_sha"))
    kinds = F.filter(F.array(F.struct(F.lit(0).alias("kind"), F.col("_text").alias("text")), F.struct(F.lit(1).alias("kind"), F.col("_edited").alias("text"))), lambda x: x["text"].isNotNull())
    keys = ["_bucket", "_row", "_guest", "_id", "_n", "_sha", "_kind"]
    texts = rows.select(*keys[:-1], F.explode(kinds).alias("_t")).select(*keys[:-1], F.col("_t.kind").alias("_kind"), F.col("_t.text").alias("_text"))
    vectors = with_units(texts, F.col("_text"), keys).groupBy(*keys).agg(*vector_sums())
    vectors = vectors.select(*keys, vector().alias("_v"))
    both = vectors.groupBy(*keys[:-1]).agg(F.max(F.when(F.col("_kind") == 0, F.col("_v"))).alias("_own"), F.max(F.when(F.col("_kind") == 1, F.col("_v"))).alias("_changed"))
    order = Window.partitionBy("_bucket").orderBy("_row")
    paired = both.select("*", F.lead("_own").over(order).alias("_after")).where("_guest = 0")
    return paired.select(
        F.col("_id").alias(id_col),
        F.col("_n").alias("n_chars"),
        F.col("_sha").alias("edited_sha256"),
        as_text(F.col("_own")).alias("fingerprint"),
        as_text(F.col("_changed")).alias("edited_fingerprint"),
        likeness(F.col("_own"), F.col("_changed")).alias("near_edited"),
        likeness(F.col("_own"), F.col("_after")).alias("near_next"),
    )


def op5_fingerprints(spark, sf_dir):
    """``fingerprints`` over all ``documents``."""
    return fingerprints(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
