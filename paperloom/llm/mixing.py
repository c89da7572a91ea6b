"""Mixing sources to target weights by a proportionate-fair schedule."""

from __future__ import annotations

import heapq
import math
from array import array

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.runtime import table


def shares(weights: dict, period: int) -> dict:
    """Whole numbers of slots in a period that add up to it, in proportion to the weights, at least one each (largest remainders)."""
    if not weights:
        return {}
    period = max(period, len(weights))
    total = sum(weights.values())
    spare = period - len(weights)
    exact = {s: w / total * spare if total > 0 else spare / len(weights) for s, w in weights.items()}
    out = {s: 1 + math.floor(x) for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: (math.floor(exact[s]) - exact[s], str(s)))[: period - sum(out.values())]:
        out[s] += 1
    return out


#: Slots that weights are rounded to. With S sources a share is off by S / 2^40 at most, so over 2^40 / S slots the error stays below one block.
FINE = 1 << 40
#: Blocks whose slots stand in one row of the plan.
CHUNK = 256


def schedule(parts: dict, blocks: dict) -> dict:
    """For each source, the slots of its blocks, ``blocks`` many; its target share is its whole number in ``parts`` to their sum.

    Block j of a source with n of D parts is released at floor(j D / n) and due at ceil((j + 1) D / n). In each slot the released block
    with the earliest deadline runs (ties by name). As the shares add up to one, every block runs inside its window,
    so at any time a source has had its share to within less than one block. Slots in which no block is released stay empty.
    """
    total = sum(parts.values())
    order = sorted(parts, key=str)
    out: dict = {s: array("q") for s in order}
    waiting = [(0, k, 0) for k, s in enumerate(order) if blocks[s]]  # release, source, block
    heapq.heapify(waiting)
    ready: list = []
    slot = 0
    while waiting or ready:
        if not ready:
            slot = max(slot, waiting[0][0])
        while waiting and waiting[0][0] <= slot:
            _, k, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * total // parts[order[k]]), k, j))
        due, k, j = heapq.heappop(ready)
        if due <= slot:
            raise AssertionError("a block missed its deadline")
        out[order[k]].append(slot)
        if j + 1 < blocks[order[k]]:
            heapq.heappush(waiting, ((j + 1) * total // parts[order[k]], k, j + 1))
        slot += 1
    return out


def pfair(slots: dict) -> dict:
    """The slots of one period of ``slots`` many for each source: a schedule that can be repeated."""
    return {s: list(v) for s, v in schedule(slots, slots).items()}


def targets(weights: dict, sources: list, period: int) -> dict:
    """A weight above 0 for each source: one that ``weights`` doesn't name, or gives nothing, weighs a ``period``-th of all that have one (all alike if none has)."""
    named = {s: max(0.0, weights.get(s, 0.0)) for s in sources}
    least = sum(named.values()) / period or 1.0
    return {s: w or least for s, w in named.items()}


def source_counts(docs: DataFrame, source_col: str = "source") -> dict:
    """Rows of each source (null: None), on the driver: one number for each source."""
    return {r["_s"]: r["n"] for r in docs.groupBy(F.col(source_col).cast("string").alias("_s")).agg(F.count(F.lit(1)).alias("n")).collect()}


def source_ranks(docs: DataFrame, n: int, source: Column, id_col: str, per_bucket: int = 20_000) -> DataFrame:
    """``docs`` (of ``n`` rows) with ``_source`` and ``_rank``, the row's place from 0 in its source in the order of a hash of its id.

    A source is ranked in buckets of the hash, so a source with a third of all rows spreads over all tasks; only counts of
    (source, bucket) are put in order.
    """
    bits = max(0, min(30, math.ceil(math.log2(max(1, n / per_bucket)))))
    rows = docs.withColumn("_source", source).withColumn("_hash", F.xxhash64(F.col(id_col)))
    rows = rows.withColumn("_bucket", F.shiftrightunsigned("_hash", 64 - bits) if bits else F.lit(0).cast("long"))
    counts = rows.groupBy("_source", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("_source").alias("_s"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).cast("long").alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_source", "_bucket").orderBy("_hash", id_col)) - 1
    ranked = rows.withColumn("_in", inside.cast("long"))
    joined = ranked.join(starts, ranked["_source"].eqNullSafe(starts["_s"]) & (ranked["_bucket"] == starts["_b"]))
    return joined.withColumn("_rank", F.col("_start") + F.col("_in")).drop("_s", "_b", "_start", "_in", "_hash", "_bucket")


def mix(docs: DataFrame, weights: dict | None = None, block: int = 16, period: int = 1000, source_col: str = "source", id_col: str = "doc_id") -> DataFrame:
    """``docs`` with ``slot`` and ``position``: the place of each row in a mix of its sources to target weights.

    Each source is cut into blocks of ``block`` rows, in the order of a hash of the ids, and ``schedule`` gives the blocks their slots from the target weights themselves;
    ``position`` is slot * block + place in the block, so it orders all rows without ties. Every row is placed once: a source that
    runs out leaves its later slots empty, and the others keep their proportions.

    ``weights`` has a number for each source (a null source: None); a source that it doesn't name weighs a ``period``-th of those named
    together. By default the square roots of the sources' row counts are the weights. The slots of all blocks, eight bytes for each ``block`` rows, must fit on the driver.
    Rows that repeat an id are placed one by one, null ids too. Columns named slot and position are replaced. An empty table gives an empty result.
    """
    docs = docs.drop("slot", "position")
    rows = docs.select(F.struct("*").alias("_all"), F.col(source_col).cast("string").alias("_from"), F.col(id_col).alias("_id"))
    counts = source_counts(docs, source_col)
    weights = targets({s: math.sqrt(n) for s, n in counts.items()} if weights is None else weights, list(counts), period)
    at = schedule(shares(weights, FINE), {s: -(-n // block) for s, n in counts.items()})
    plan = docs.sparkSession.createDataFrame(_plan(at))
    ranked = source_ranks(rows, sum(counts.values()), F.col("_from"), "_id").withColumn("_block", F.expr(f"_rank div {int(block)}"))
    placed = ranked.join(plan, ranked["_source"].eqNullSafe(plan["_s"]) & (F.expr(f"_block div {CHUNK}") == plan["_chunk"]))
    slot = F.element_at("_slots", F.expr(f"cast(_block % {CHUNK} + 1 as int)"))
    return placed.withColumn("slot", slot).withColumn("position", F.col("slot") * block + F.col("_rank") % block).select("_all.*", "slot", "position")


def _plan(at: dict) -> pa.Table:
    """A row for each source and ``CHUNK`` of its blocks, with their slots."""
    rows = [(s, k // CHUNK, v[k : k + CHUNK]) for s, v in at.items() for k in range(0, len(v), CHUNK)]
    columns = ([r[0] for r in rows], [r[1] for r in rows], [r[2].tolist() for r in rows])
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.list_(pa.int64())), strict=True)], names=["_s", "_chunk", "_slots"])


def in_mixed_order(docs: DataFrame, weights: dict | None = None, block: int = 16, period: int = 1000) -> DataFrame:
    """The rows of ``docs``, with all columns, laid out in the order of the mix: sorted partitions of rising positions, which a written table keeps in its files.

    No row goes: null and empty texts, repeated rows and null ids are placed like others, a null source is a source of its own, and columns named slot or position stay as they are. An empty table gives an empty result.
    """
    rows = docs.select(F.struct("*").alias("_row"), "source", "doc_id")
    mixed = mix(rows, weights, block, period)
    return mixed.repartitionByRange("position").sortWithinPartitions("position").select("_row.*")


def op2_mixing(spark, sf_dir):
    """The place of each row of ``documents`` in the mix, sources weighted by the square roots of their row counts."""
    return mix(table(spark, sf_dir, "documents").select("doc_id", "source"))
