"""Substring deduplication by runs of consecutive sentences."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.runtime import bounded_batches, spread, table

#: Ends of sentences: white space behind a full stop, question or exclamation mark, and line ends.
_END = re.compile(r"(?<=[.!?])\s+|\n+")
#: Runs of RUN sentences or more count from SHORT words on; runs of fewer sentences count from LONG words on.
RUN, SHORT, LONG = 3, 10, 20


def sentences(text: str | None) -> list[tuple[int, int]]:
    """Start and end of each sentence in the text, blanks at its ends left out."""
    text, out, at = text or "", [], 0
    for m in _END.finditer(text):
        if m.start() > at:
            out.append((at, m.start()))
        at = m.end()
    if at < len(text):
        out.append((at, len(text)))
    return out


def spans(text: str | None, run: int = RUN, short: int = SHORT, long: int = LONG) -> list[tuple[int, int, int]]:
    """(hash, first sentence, how many) of every run of ``run`` sentences, of every shorter run of many words, and of the ``longer`` runs that short sentences need."""
    text = text or ""
    marks = sentences(text)
    parts = [text[a:b].split() for a, b in marks]
    sizes = [len(p) for p in parts]
    digests = [xxhash.xxh3_128_digest(" ".join(p).encode("utf-8", "surrogatepass")) for p in parts]
    out = []
    for size in range(1, run + 1):
        least = short if size == run else long
        words = sum(sizes[: size - 1])
        for k in range(len(parts) - size + 1):
            words += sizes[k + size - 1]
            if words >= least:
                out.append((xxhash.xxh3_128_intdigest(b"".join(digests[k : k + size])), k, size))
            words -= sizes[k]
    for first, last in longer(sizes, run, short):
        worded = [digests[k] for k in range(first, last + 1) if sizes[k]]
        out.append((xxhash.xxh3_128_intdigest(b"".join(worded)), first, last + 1 - first))
    return out


def longer(sizes: list[int], run: int, short: int) -> list[tuple[int, int]]:
    """First and last sentence of the shortest runs of ``run`` worded sentences or more that reach ``short`` words, from every sentence on and up to
    every sentence, but for those of ``run`` sentences that stand together.

    Any run of so many sentences and words is covered by those that lie in it: a sentence from which, and up to which, there is too little of
    the run lies in the shortest one up to the run's end. Sentences without words aren't counted, so a run has ``run`` + ``short`` at most to hash.
    """
    worded = [k for k, n in enumerate(sizes) if n] if 0 in sizes else range(len(sizes))
    sums = [0, *itertools.accumulate(sizes[k] for k in worded)]
    found: set[tuple[int, int]] = set()
    for k in range(len(worded) - run + 1):
        if sums[k + run] - sums[k] >= short:
            if worded[k + run - 1] - worded[k] >= run:
                found.add((worded[k], worded[k + run - 1]))
            continue
        first, last = k, k + run
        while last < len(worded) and sums[last] - sums[k] < short:
            last += 1
        if sums[last] - sums[k] >= short:
            found.add((worded[k], worded[last - 1]))
        while first and sums[k + run] - sums[first] < short:
            first -= 1
        if sums[k + run] - sums[first] >= short:
            found.add((worded[first], worded[k + run - 1]))
    return sorted(found)


def _tag(text: str | None) -> int:
    """A number that tells apart texts whose rows share an id."""
    return xxhash.xxh32_intdigest((text or "").encode("utf-8", "surrogatepass")) - (1 << 31)


_ROWS = "_hi long, _lo long, _id long, _tag int, _at int, _size int, _later boolean"


def _split_first(cols: list[np.ndarray]) -> np.ndarray:
    """Of rows (hi, lo, id, tag, at, ...): whether each stands behind another row of its hash, in the order of id, tag and place. Rows that agree in all of these are one occurrence."""
    hi, lo, ids, tag, at = cols[:5]
    order = np.lexsort((at, tag, ids, lo, hi))
    same = np.r_[False, (hi[order][1:] == hi[order][:-1]) & (lo[order][1:] == lo[order][:-1])]
    first = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    lead = order[first]
    later = np.empty(len(order), bool)
    later[order] = (ids[order] != ids[lead]) | (tag[order] != tag[lead]) | (at[order] != at[lead])
    return later


def _spans_of(docs: DataFrame, run: int, short: int, long: int) -> DataFrame:
    """A row for each span; of equal spans among some 200,000 of a task all but the first are marked as later already."""

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        cols = [np.array(c, t) for c, t in zip(zip(*rows, strict=True), (np.int64, np.int64, np.int64, np.int32, np.int32, np.int32), strict=True)]
        return pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array(_split_first(cols))], names=["_hi", "_lo", "_id", "_tag", "_at", "_size", "_later"])

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = t.as_py()
                tag = _tag(text)
                for h, k, size in spans(text, run, short, long):
                    rows.append(((h >> 64) - (1 << 63), (h & ((1 << 64) - 1)) - (1 << 63), i, tag, k, size))
                if len(rows) >= 200_000:
                    yield batch(rows)
                    rows = []
        if rows:
            yield batch(rows)

    return docs.mapInArrow(mapped, _ROWS)


def _later_ones(rows: DataFrame) -> DataFrame:
    """Of span rows dealt by hash and sorted by hash and place, those that aren't their hash's first: _id, _tag, _at, _size. A task holds a batch and the first row of the hash that it is at."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = None  # hi, lo, id, tag, at of the first row of the last hash
        for b in batches:
            later = b.column(6)
            passed = b.filter(later)
            if len(passed):
                yield passed.select([2, 3, 4, 5])
            b = b.filter(pa.compute.invert(later))
            if not len(b):
                continue
            cols = [c.to_numpy() for c in b.columns[:5]]
            if first is not None:
                cols = [np.r_[f, c] for f, c in zip(first, cols, strict=True)]
            hi, lo = cols[:2]
            new = np.r_[True, (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])]
            lead = np.maximum.accumulate(np.where(new, np.arange(len(hi)), 0))
            gone = np.logical_or.reduce([c != c[lead] for c in cols[2:5]])
            if first is not None:
                gone = gone[1:]
            first = [c[lead[-1] : lead[-1] + 1] for c in cols]
            if gone.any():
                yield b.filter(pa.array(gone)).select([2, 3, 4, 5])

    return rows.mapInArrow(mapped, "_id long, _tag int, _at int, _size int")


def repeated_spans(docs: DataFrame, run: int = RUN, short: int = SHORT, long: int = LONG, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row its whole text without the sentences that repeated spans cover: text, how many sentences it has and how many go.

    Every run of ``run`` consecutive sentences with ``short`` words or more is hashed, and shorter runs with ``long`` words or more, to 128 bits over the words alone.
    Where sentences are so short that ``run`` of them have fewer words, the run goes on until it has ``short`` (``longer``), so every repeated run of ``run`` sentences or more and ``short`` words
    or more goes. Sentences are the unit: words that repeat inside sentences that differ stay.
    Of equal spans anywhere, the first in the order of id and place stays; the sentences of all others go, with the white space behind them. Equal spans that a task holds together are settled
    before the shuffle, so a span in a third of all rows sends a few rows a task; settled rows are dealt by document.

    Null and empty texts have no sentences. Rows that repeat an id and a text are cut alike, as one; rows that share an id only are told apart
    by their texts. Null ids take no part and keep their texts. An empty table gives an empty result. Other columns are ignored.
    Returns: the id column, n_sentences, n_removed, kept_text.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    found = _spans_of(rows.where("_id is not null"), run, short, long)
    dealt = found.repartition(F.when(F.col("_later"), F.xxhash64("_id")).otherwise(F.col("_hi"))).sortWithinPartitions("_hi", "_lo", "_id", "_tag", "_at")
    cuts = _later_ones(dealt).groupBy("_id").agg(F.collect_set(F.struct("_tag", "_at", "_size")).alias("_cuts"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, gone, kept = [], [], []
            for t, c in zip(b.column(1), b.column(2), strict=True):
                text = t.as_py()
                marks = sentences(text)
                n.append(len(marks))
                flags = bytearray(len(marks))
                found = c.as_py()
                if found:
                    tag = _tag(text)
                    for x in found:
                        if x["_tag"] == tag:
                            flags[x["_at"] : x["_at"] + x["_size"]] = b"\1" * x["_size"]
                gone.append(sum(flags))
                kept.append(text or "" if not gone[-1] else without(text, marks, flags))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=[id_col, "n_sentences", "n_removed", "kept_text"])

    return rows.join(cuts, "_id", "left").mapInArrow(cut, f"`{id_col}` long, n_sentences long, n_removed long, kept_text string")


def without(text: str, marks: list[tuple[int, int]], flags: bytearray) -> str:
    """The text without the flagged sentences and what stands between each and the next."""
    starts = [0, *(a for a, _ in marks[1:])] if marks else [0]
    ends = [*starts[1:], len(text)]
    return "".join(text[a:b] for a, b, f in zip(starts, ends, flags, strict=True) if not f)


def op10_sentence_spans(spark, sf_dir):
    """``repeated_spans`` over all ``documents``, kept texts as digests."""
    found = repeated_spans(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return found.select("doc_id", "n_sentences", "n_removed", F.char_length("kept_text").cast("long").alias("kept_chars"), F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


