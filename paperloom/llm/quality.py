"""Quality scores from how well zstandard dictionaries of good and of bad text compress a document."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.runtime import bounded_batches, spread, table

BLOCK = 512


@dataclass(frozen=True)
class CompressionModel:
    """Two dictionaries and a logistic curve over the difference of compressed sizes."""

    good: bytes
    bad: bytes
    level: int
    slope: float
    offset: float


class Sizer:
    """Compressed sizes of texts under both dictionaries of a model."""

    def __init__(self, good: bytes, bad: bytes, level: int):
        self._with = []
        for raw in (good, bad):
            d = zstandard.ZstdCompressionDict(raw)
            d.precompute_compress(level=level)
            self._with.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_dict_id=False))

    def difference(self, text: str | None) -> float:
        """(bad size - good size) / (bad size + good size) over all blocks of the whole text; 0 for an empty one."""
        raw = (text or "").encode("utf-8", "surrogatepass")
        if not raw:
            return 0.0
        sizes = [0, 0]
        for at in range(0, len(raw), BLOCK):
            piece = raw[at : at + BLOCK]
            for k, c in enumerate(self._with):
                sizes[k] += len(c.compress(piece))
        return (sizes[1] - sizes[0]) / (sizes[0] + sizes[1])


def _dictionary(texts: list[str], size: int) -> bytes:
    """A trained dictionary, or raw content where there is too little text to train on."""
    samples = [raw[at : at + BLOCK] for t in texts if (raw := (t or "").encode("utf-8", "surrogatepass")) for at in range(0, len(raw), BLOCK)]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[:size] or b"\x00" * 8


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a slightly ridged logistic regression by Newton steps; classes count alike for the slope and as they are for the offset."""
    scale = float(np.std(x)) or 1.0
    z, w = np.stack([x / scale, np.ones_like(x)], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + np.diag([1e-2, 1e-6])
        step = np.linalg.solve(h, z.T @ (y - p) - np.array([1e-2, 1e-6]) * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def fit(good: list[str], bad: list[str], dict_bytes: int = 32 * 1024, level: int = 3, good_share: float | None = None) -> CompressionModel:
    """Train on two lists of texts.

    Even rows build the dictionaries and odd rows fit the curve, so the curve sees texts that the dictionaries
    haven't seen. ``good_share`` is the share of good texts where the model will be used (half if unknown);
    it corrects the offset for the shares of the sample. With texts of one label only the model says that label.
    """
    if not good or not bad:
        return CompressionModel(b"\x00" * 8, b"\x00" * 8, level, 0.0, 4.0 if good or not bad else -4.0)
    pair = [_dictionary(t[0::2], dict_bytes) for t in (good, bad)]
    sizer = Sizer(*pair, level)
    held = [(sizer.difference(t), y) for ts, y in ((good, 1.0), (bad, 0.0)) for t in (ts[1::2] or ts)]
    x, y = np.array([a for a, _ in held]), np.array([b for _, b in held])
    slope, offset = _logistic(x, y)
    share = min(max(good_share if good_share is not None else 0.5, 0.01), 0.99)
    offset += math.log(share / (1 - share)) - math.log(y.mean() / (1 - y.mean()))
    return CompressionModel(*pair, level, slope, offset)


def training_texts(docs: DataFrame, labels: DataFrame, usable: Column, rows: int, max_bytes: int) -> tuple[list[str], list[str], float]:
    """At most ``rows`` texts of each label and ``max_bytes`` of text, in the order of a hash of the id, and the share of label 1.

    A document with clashing labels, or with none, is left out; ids that repeat in ``docs`` give all their texts that aren't empty, one length of each id counting against the bounds. The driver first gets ids and lengths of the sample, then its texts.
    """
    agreed = labels.where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("_q"), F.max("quality").alias("_q2")).where("_q = _q2")
    known = docs.where(usable).select("doc_id", F.octet_length("text").alias("_n")).where("_n > 0").join(agreed.select("doc_id", "_q"), "doc_id").select("doc_id", "_n", "_q")
    counts = {r["_q"]: r["n"] for r in known.groupBy("_q").agg(F.count(F.lit(1)).alias("n")).collect()}
    wanted: dict[int, int] = {}
    for q in (1, 0):
        left = max_bytes // 2
        for r in known.where(F.col("_q") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).collect():
            if r["_n"] <= left:
                left -= r["_n"]
                wanted[r["doc_id"]] = q
    texts: tuple[list[str], list[str]] = ([], [])
    got = docs.where(usable & F.col("doc_id").isin(list(wanted))).select("doc_id", "text").collect() if wanted else []
    for r in sorted(got, key=lambda r: (r["doc_id"], r["text"] or "")):
        texts[wanted[r["doc_id"]]].append(r["text"])
    return texts[1], texts[0], counts.get(1, 0) / max(1, sum(counts.values()))


def score(docs: DataFrame, model: CompressionModel, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with ``score_col``: how likely label 1 is, from 0 to 1, from the whole text alone.

    A null or empty text, whose difference is 0, gets the curve's value there. Rows that repeat a text score alike, null ids like others; an empty table gives an empty result. A column of the same name is replaced, others stay.
    """
    bounded_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of dict_bytes each
    kept = [c for c in docs.columns if c != score_col]
    fields = docs.select(*kept).schema.add(score_col, "double")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        sizer = Sizer(m.good, m.bad, m.level)
        for b in batches:
            d = np.array([sizer.difference(t.as_py()) for t in b.column(b.schema.get_field_index(text_col))], dtype=float)
            p = 1 / (1 + np.exp(-np.clip(m.slope * d + m.offset, -700, 700)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p, pa.float64())], names=[*b.schema.names, score_col])

    return docs.select(*kept).mapInArrow(scored, fields)


HELD_OUT = "crc32(encode(cast(doc_id as string), 'UTF-8')) % 3 = 1"

#: The bounds of the sample that the query and the pipeline learn from: rows of each label, and bytes of text.
SAMPLE_ROWS, SAMPLE_BYTES = 2000, 24_000_000


def learned(spark, docs: DataFrame, sf_dir: str) -> CompressionModel:
    """A model of ``labels.quality`` from rows that aren't held out."""
    usable = ~F.coalesce(F.expr(HELD_OUT), F.lit(True))
    good, bad, share = training_texts(docs, table(spark, sf_dir, "labels"), usable, SAMPLE_ROWS, SAMPLE_BYTES)
    return fit(good, bad, good_share=share)


def op4_quality(spark, sf_dir):
    """Scores of all ``documents``, learned from the labelled rows that aren't held out.

    Each row is scored from its own text, repeated rows alike. A row whose id is null counts as held out: false.
    """
    docs = table(spark, sf_dir, "documents")
    scored = score(spread(docs.select("doc_id", "text")), learned(spark, docs, sf_dir))
    return scored.select("doc_id", F.coalesce(F.expr(HELD_OUT), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(spark, docs: DataFrame, sf_dir: str, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score ``least`` or more, with all their columns, one named score too.

    Null and empty texts score what the curve gives for a difference of 0, all alike; rows that repeat a text share its fate, and null ids are scored like others. An empty table gives an empty result.
    """
    name = "_score"
    while name in docs.columns:
        name += "_"
    return score(docs, learned(spark, docs, sf_dir), score_col=name).where(F.col(name) >= least).select(*docs.columns)
