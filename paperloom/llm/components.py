"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.runtime import Scratch


def components(edges: DataFrame) -> DataFrame:
    """(_node, _comp) for each node of ``edges`` (_a, _b); _comp is the smallest node of the component.

    Alternating stars: each node's larger neighbours, then its smaller ones, are tied to the smallest node it knows, until nothing changes. Minima are combined
    before the shuffle, every round is a table in the shared folder, and the rounds grow as the logarithm of the longest chain. The driver gets two numbers a round.
    """
    now = Scratch(edges.where("_a != _b").select(F.greatest("_a", "_b").alias("_u"), F.least("_a", "_b").alias("_v")).distinct(), "edges")
    told = None
    while True:
        either = now.df.union(now.df.select(F.col("_v").alias("_u"), F.col("_u").alias("_v")))
        least = either.groupBy("_u").agg(F.min("_v").alias("_m")).select("_u", F.least("_m", "_u").alias("_m"))
        # large star: neighbours above u go to u's least
        large = either.join(least, "_u").where("_v > _u and _v != _m").select(F.col("_v").alias("_u"), F.col("_m").alias("_v")).distinct()
        # small star: u and its neighbours below go to the least of them
        low = large.groupBy("_u").agg(F.min("_v").alias("_m"))
        small = large.join(low, "_u").select(F.explode(F.array(F.struct(F.col("_u"), F.col("_m")), F.struct(F.col("_v").alias("_u"), F.col("_m")))).alias("_e")).select("_e._u", F.col("_e._m").alias("_v")).where("_u != _v").distinct()
        after = Scratch(small, "edges")
        seen = after.df.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("_u", "_v")).alias("h")).first()
        seen = (seen["n"], seen["h"])
        now.drop()
        now = after
        if seen == told:
            break
        told = seen
    return now.df.select(F.col("_u").alias("_node"), F.col("_v").alias("_comp")).union(now.df.select("_v", "_v").distinct())
