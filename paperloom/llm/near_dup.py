"""N-gram Jaccard join by parity sketches: exact links between texts of similar word shingles, and their components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.components import components
from paperloom.llm.exact_dedup import without_repeats
from paperloom.llm.shingles import mixed, shingle_set
from paperloom.runtime import Scratch, bounded_batches, release, small_batches, spread, table

#: Texts link when PER_CENT * union <= 100 * intersection. Bounds below follow from three quarters: sizes of linked sets differ by 4/3 at most,
#: and their symmetric difference is at most a seventh of the sum of their sizes.
PER_CENT = 75
#: A key that more classes share is hot: no pairs are made of it directly.
HOT = 32
_FIRST, _RATIO, _SLOTS = 512, 8, 4096


def bands(n: int) -> list[int]:
    """The size bands in which a set of n shingles is joined: its own, and the next if a linked set can be there."""
    own, top = 0, _FIRST
    while n >= top:
        own, top = own + 1, top * _RATIO
    return [own, own + 1] if 4 * n >= 3 * top else [own]


def most_apart(n: int) -> int:
    """The largest symmetric difference of a set of n shingles and any linked one."""
    return n // 3


def spare(n: int) -> int:
    """How many keys a set of n shingles emits beyond ``most_apart``."""
    return 3 + n // 20


def droppable(n: int) -> int:
    """A set of n shingles shares more keys than this with any linked one."""
    return 0 if n < 16 else 2 + (3 * n // 4) // 20


def slot_keys(s: np.ndarray) -> np.ndarray:
    """The join keys of a set.

    In a band, every shingle falls into one of as many slots as the band's largest set has shingles, and a slot's value is the XOR of its shingles.
    A symmetric difference of d shingles changes d slots at most. So of the first d + 1 slots that aren't empty in either of two linked sets, taken
    in the order of the slots, at least one has the same value in both (pigeonholes); ``spare`` more are emitted, so that linked sets share several keys.
    """
    n, out = len(s), []
    if n < 3:  # such sets link to equal sets only
        return np.empty(0, np.uint64)
    for band in bands(n):
        slots = max(_SLOTS, _FIRST * _RATIO**band)
        at = s % np.uint64(slots)
        order = np.argsort(at, kind="stable")
        at, values = at[order], s[order]
        starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        starts = starts[: most_apart(n) + spare(n) + 1]
        folded = np.bitwise_xor.reduceat(values, starts)
        if len(starts) > most_apart(n) + spare(n):
            folded, starts = folded[:-1], starts[:-1]
        out.append(mixed(folded + mixed(at[starts] * np.uint64(64) + np.uint64(band + 1))))
    return np.concatenate(out)


def parity_sketch(s: np.ndarray) -> bytes:
    """Bits that each shingle flips one of; at least twice as many as shingles, a power of two."""
    bits = 64
    while bits < 2 * len(s):
        bits *= 2
    counts = np.bincount((s >> np.uint64(16)).astype(np.uint64) % np.uint64(bits), minlength=bits)
    return np.packbits(counts & 1, bitorder="little").tobytes()


def apart_at_least(a: bytes, b: bytes) -> int:
    """A lower bound of the symmetric difference of two sets: the Hamming distance of their sketches, the longer one folded onto the shorter."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if len(x) < len(y):
        x, y = y, x
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _class_of(s: np.ndarray, salt: int) -> tuple[int, int]:
    d = xxhash.xxh3_128_intdigest(s.tobytes(), seed=salt)
    return (d >> 64) - (1 << 63), (d & ((1 << 64) - 1)) - (1 << 63)


def _sets(docs: DataFrame, salt: int) -> DataFrame:
    """Of each row (_id, _text, _row): _id, _row, _n (shingles), _node (its class of equal sets, null if empty), _check, _sketch."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ns, nodes, checks, sketches = [], [], [], []
            for t in b.column(1):
                s = shingle_set(t.as_py())
                node, check = _class_of(s, salt) if len(s) else (None, None)
                ns.append(len(s))
                nodes.append(node)
                checks.append(check)
                sketches.append(parity_sketch(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ns, pa.int64()), pa.array(nodes, pa.int64()), pa.array(checks, pa.int64()), pa.array(sketches, pa.binary()), b.column(2)], names=["_id", "_n", "_node", "_check", "_sketch", "_row"])

    return docs.mapInArrow(mapped, "_id long, _n long, _node long, _check long, _sketch binary, _row long")


def _keys(docs: DataFrame, salt: int) -> DataFrame:
    """A row for each key of each class of equal sets that a task meets: _key, _node."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        names = ["_key", "_node"]
        keys, nodes, size = [], [], 0
        for b in batches:
            for t in b.column(1):
                s = shingle_set(t.as_py())
                if len(s) < 3 or (node := _class_of(s, salt)[0]) in seen:
                    continue
                seen.add(node)
                k = slot_keys(s)
                keys.append(k)
                nodes.append(np.full(len(k), node))
                size += len(k)
                if size > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(nodes))], names=names)
                    keys, nodes, size = [], [], 0
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(nodes))], names=names)

    return docs.mapInArrow(mapped, "_key long, _node long")


def _bucketed(keys: DataFrame) -> DataFrame:
    """Within partitions by key: pairs of classes that share a key (_key null) and how many they share there, and the rows of hot keys (_b null).

    A task holds its partition as two arrays of numbers, and its distinct pairs.
    """

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if not got:
            return
        key, node = (np.concatenate(x) for x in zip(*got, strict=True))
        del got
        order = np.lexsort((node, key))
        key, node = key[order], node[order]
        new = np.r_[True, (key[1:] != key[:-1]) | (node[1:] != node[:-1])]
        key, node = key[new], node[new]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[starts, len(key)])
        few = (sizes > 1) & (sizes <= HOT)
        a, b = [], []
        for size in np.unique(sizes[few]):
            of = starts[few & (sizes == size)]
            left, right = np.triu_indices(size, 1)
            a.append(node[of[:, None] + left].ravel())
            b.append(node[of[:, None] + right].ravel())
        if a:
            a, b = np.concatenate(a), np.concatenate(b)
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
            shared = np.diff(np.r_[first, len(a)]).astype(np.int32)
            for at in range(0, len(first), 100_000):
                f = first[at : at + 100_000]
                yield pa.RecordBatch.from_arrays([pa.nulls(len(f), pa.int64()), pa.array(a[f]), pa.array(b[f]), pa.array(shared[at : at + 100_000])], names=["_key", "_a", "_b", "_shared"])
        hot = np.repeat(sizes > HOT, sizes)
        key, node = key[hot], node[hot]
        for at in range(0, len(key), 100_000):
            n = len(key[at : at + 100_000])
            yield pa.RecordBatch.from_arrays([pa.array(key[at : at + n]), pa.array(node[at : at + n]), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32())], names=["_key", "_a", "_b", "_shared"])

    return keys.mapInArrow(mapped, "_key long, _a long, _b long, _shared int")


def _sharing_enough(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Of pairs (_a, _b, _shared), those of sizes that can be linked that share as many keys as linked sets must: the lesser ``spare``, less the hot keys that the pair may share. ``nodes`` has (_node, _n, _hot)."""
    left, right = nodes.toDF("_a", "_na", "_ha"), nodes.toDF("_b", "_nb", "_hb")
    small = F.least("_na", "_nb")
    enough = F.when(small < 16, F.lit(1)).otherwise(F.greatest(F.lit(1), 3 + F.floor(small / 20) - F.least("_ha", "_hb")))
    summed = pairs.groupBy("_a", "_b").agg(F.sum("_shared").alias("_shared"))
    return summed.join(left, "_a").join(right, "_b").where((4 * small >= 3 * F.greatest("_na", "_nb")) & (F.col("_shared") >= enough)).select("_a", "_b")


class _Round:
    """One pass of keys over classes ``nodes`` (_node, _n): the pairs that share cold keys, and the rows of hot keys of the classes that can't drop theirs."""

    def __init__(self, keys: DataFrame, nodes: DataFrame, parts: int):
        self._found = Scratch(_bucketed(keys.repartition(parts, "_key")), "near-found")
        hot = self._found.df.where("_b is null").select("_key", F.col("_a").alias("_node"))
        many = hot.groupBy("_node").agg(F.count(F.lit(1)).alias("_hot"))
        light = nodes.select("_node", "_n").join(many, "_node", "left").select("_node", "_n", F.coalesce("_hot", F.lit(0)).alias("_hot"))
        self.pairs = Scratch(_sharing_enough(self._found.df.where("_b is not null").select("_a", "_b", "_shared"), light), "near-direct")
        kept = F.col("_hot") > F.when(F.col("_n") < 16, F.lit(0)).otherwise(2 + F.expr("(3 * _n div 4) div 20"))
        self.heavy = Scratch(light.where(kept).select("_node", "_n"), "near-heavy")
        self.hot = hot
        self.n = self.heavy.df.count()

    def drop(self) -> None:
        self._found.drop()
        self.heavy.drop()


def _rare_first(sets: DataFrame) -> DataFrame:
    """From classes (_node, _n, _set): _key, _node, _cold, the shingles of each set's prefix when shingles of at most HOT of these classes come first, in the order of their hashes, and the others by how many have them.

    Of two linked sets each has n / 4 shingles at most that the other lacks. So under any one order of all shingles, the first n / 4 + 1 + ``spare`` of each hold more than the lesser ``spare`` that both have.
    _cold is how many shingles of the set at most HOT classes have; two sets that have none of these in common differ in all of them.
    """
    each = sets.select("_node", "_n", F.explode("_set").alias("_key"))
    often = each.groupBy("_key").agg(F.count(F.lit(1)).alias("_of")).where(F.col("_of") > HOT)
    told = each.join(often, "_key", "left").select("_node", "_n", F.struct(F.coalesce("_of", F.lit(0)).alias("of"), F.col("_key").alias("key")).alias("_e"))
    held = told.groupBy("_node", "_n").agg(F.sort_array(F.collect_list("_e")).alias("_es"), F.count_if(F.col("_e.of") == 0).alias("_cold"))
    prefix = F.expr("slice(_es, 1, cast(_n div 4 + 4 + _n div 20 as int))")
    return held.select("_node", "_cold", F.explode(prefix).alias("_e")).select(F.col("_e.key").alias("_key"), "_node", "_cold")


def _filtered(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Of distinct pairs (_a, _b), those that sizes and sketches allow to be linked."""
    left = nodes.select(F.col("_node").alias("_a"), F.col("_n").alias("_na"), F.col("_sketch").alias("_sa"))
    right = nodes.select(F.col("_node").alias("_b"), F.col("_n").alias("_nb"), F.col("_sketch").alias("_sb"))
    sized = pairs.join(left, "_a").join(right, "_b").where("4 * least(_na, _nb) >= 3 * greatest(_na, _nb)").select("_a", "_b", "_na", "_nb", "_sa", "_sb")

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            na, nb = b.column(2).to_numpy(), b.column(3).to_numpy()
            ok = [apart_at_least(x.as_py(), y.as_py()) <= (n + m) // 7 for x, y, n, m in zip(b.column(4), b.column(5), na, nb, strict=True)]
            yield b.filter(pa.array(ok, pa.bool_())).select([0, 1])

    return sized.mapInArrow(mapped, "_a long, _b long")


def _sets_of(wanted: DataFrame, nodes: DataFrame, docs: DataFrame, salt: int) -> DataFrame:
    """_node, _set (sorted hashes as bytes) of classes ``wanted`` (_node), each once, made again from the text of one row of each."""
    texts = docs.join(nodes.select("_node", F.col("_any").alias("_row")).join(wanted, "_node"), "_row").select("_node", "_text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for b in batches:
            node, made = [], []
            for n, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if n in done:
                    continue
                s = shingle_set(t.as_py())
                if len(s) and _class_of(s, salt)[0] == n:  # hashes of texts may collide
                    done.add(n)
                    node.append(n)
                    made.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(made, pa.binary())], names=["_node", "_set"])

    return texts.mapInArrow(sets, "_node long, _set binary").groupBy("_node").agg(F.any_value("_set").alias("_set"))  # rows that repeat another's id and text are in several tasks


def _as_numbers(sets: DataFrame) -> DataFrame:
    """Sets of bytes as arrays of signed 64-bit numbers."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [np.frombuffer(x.as_py(), np.int64) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in made], pa.int64()), pa.array(made, pa.list_(pa.int64()))], names=["_node", "_n", "_set"])

    return sets.mapInArrow(mapped, "_node long, _n long, _set array<long>")


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, salt: int) -> DataFrame:
    """Of distinct pairs, those whose sets link. The sets are made again from the texts."""
    made = _sets_of(pairs.select(F.explode(F.array("_a", "_b")).alias("_node")).distinct(), nodes, docs, salt)
    both = pairs.join(made.toDF("_a", "_sa"), "_a").join(made.toDF("_b", "_sb"), "_b").select("_a", "_b", "_sa", "_sb")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * common >= PER_CENT * (len(x) + len(y) - common))
            yield b.filter(pa.array(ok, pa.bool_())).select([0, 1])

    return both.mapInArrow(linked, "_a long, _b long").distinct()


#: Rows of one key that are compared at once, and the longest sketch, in 64-bit numbers, that goes with each.
BLOCK, SKETCH = 1024, 16


def _folded(x: np.ndarray, width: int) -> np.ndarray:
    """Sketches (rows of 64-bit numbers) folded to ``width`` numbers or fewer: halves XORed until they are short enough. They still bound differences from below."""
    while x.shape[1] > width:
        x = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :]
    return x


def _short(nodes: DataFrame) -> DataFrame:
    """_node, _sketch of SKETCH numbers at most."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [_folded(np.frombuffer(x.as_py(), np.uint64)[None, :], SKETCH).tobytes() for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary())], names=["_node", "_sketch"])

    return nodes.select("_node", "_sketch").mapInArrow(mapped, "_node long, _sketch binary")


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows of hot keys with blocks: a key of many rows has its rows in blocks of about BLOCK, and each row goes to all pairs (_i, _j) that its own block (_own) is in."""
    blocks = rows.groupBy("_key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("_of"))
    own = rows.join(blocks, "_key").withColumn("_own", F.pmod(F.xxhash64("_node"), F.col("_of")))
    each = own.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_of") - 1)))
    return each.withColumn("_i", F.least("_own", "_other")).withColumn("_j", F.greatest("_own", "_other")).select("_key", "_i", "_j", "_own", "_node", "_comp", "_n", "_cold", "_sketch")


def _fitting(group: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    """Of the rows of one pair of blocks, the pairs of classes that may be linked and aren't in one component: sizes fit, the shingles that few classes have may all differ, and sketches are near enough."""
    t = pa.Table.from_batches(group)
    i, j = t.column("_i")[0].as_py(), t.column("_j")[0].as_py()
    own, node, comp, n, cold = (t.column(c).to_numpy() for c in ("_own", "_node", "_comp", "_n", "_cold"))
    kept: tuple[list, list] = ([], [])
    if (comp == comp[0]).all():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    sketch, size = np.zeros((len(node), SKETCH), np.uint64), np.zeros(len(node), np.int64)
    for k, raw in enumerate(t.column("_sketch").to_pylist()):
        x = np.frombuffer(raw, np.uint64)
        sketch[k, : len(x)], size[k] = x, len(x)
    left = np.flatnonzero(own == i)
    right = left if i == j else np.flatnonzero(own == j)
    for at in range(0, len(left), 256):
        a, b = left[at : at + 256][:, None], right[None, :]
        ok = (comp[a] != comp[b]) & (4 * np.minimum(n[a], n[b]) >= 3 * np.maximum(n[a], n[b])) & (7 * (cold[a] + cold[b]) <= n[a] + n[b])
        if i == j:
            ok &= a < b
        x, y = np.nonzero(ok)
        x, y = left[at + x], right[y]
        near = np.ones(len(x), bool)
        for s in np.unique(size[x]):
            for z in np.unique(size[y][size[x] == s]):
                some = np.flatnonzero((size[x] == s) & (size[y] == z))
                for q in range(0, len(some), 50_000):
                    w = some[q : q + 50_000]
                    apart = _folded(sketch[x[w], :s], min(s, z)) ^ _folded(sketch[y[w], :z], min(s, z))
                    near[w] = 7 * np.bitwise_count(apart).sum(1, dtype=np.int64) <= n[x[w]] + n[y[w]]
        x, y = node[x[near]], node[y[near]]
        kept[0].append(np.minimum(x, y))
        kept[1].append(np.maximum(x, y))
    return np.concatenate(kept[0] or [np.empty(0, np.int64)]), np.concatenate(kept[1] or [np.empty(0, np.int64)])


def _across(rows: DataFrame) -> DataFrame:
    """From rows (_key, _node, _comp, _n, _cold, _sketch) of hot keys: the pairs (_a, _b) of classes of one key that may be linked and aren't in one component yet, some of them repeated.

    Rows come sorted by pairs of blocks, and a task holds one pair of blocks at a time.
    """

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None

        def close() -> Iterator[pa.RecordBatch]:
            a, b = _fitting(held)
            for at in range(0, len(a), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(a[at : at + 100_000]), pa.array(b[at : at + 100_000])], names=["_a", "_b"])

        for b in batches:
            if not len(b):
                continue
            key, i, j = (b.column(k).to_numpy() for k in range(3))
            starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
            for x, y in zip(starts.tolist(), [*starts[1:].tolist(), len(b)], strict=True):
                if held and last != (key[x], i[x], j[x]):
                    yield from close()
                    held = []
                held.append(b.slice(x, y - x))
                last = (key[x], i[x], j[x])
        if held:
            yield from close()

    return _dealt(rows).repartition("_key", "_i", "_j").sortWithinPartitions("_key", "_i", "_j").mapInArrow(mapped, "_a long, _b long")


#: How often the classes that can't drop their hot keys are joined by rarer keys before blocks of them are compared.
ROUNDS = 3


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row its number of distinct shingles and the smallest id that links reach from it.

    Words are lower-cased (A-Z) runs between ASCII white space; shingles take five words, or all of a shorter text. Rows link when the shingles they share are three quarters or more of
    all shingles of both. All links between different texts count, and none is missed: equal sets are first made one class (by a 128-bit hash, of which collisions in
    the 64 bits used as a name are looked for); classes that share a slot key are candidates; parity sketches and sizes exclude most of the rest; sets made again from the texts decide.

    Hot keys, which more than HOT classes share, make no pairs directly. A class drops its hot keys if it has fewer of them than any linked class must share with it. The others
    are joined again, with each other only, by prefixes in which the shingles that few of them have come first (``_rare_first``); so those that merely quote a common passage fall away.
    What remains are large groups of near copies. Each is held against its key's class with the fewest rare shingles, and then only classes of a key that aren't in one component yet
    are compared, in blocks, by sizes, by their rare shingles (of which a pair has none in common, or it is a candidate already) and by sketches; pairs that pass are verified like others.

    Null and empty texts have no shingles and link to nothing, each its own component. Repeated rows are one class. A null id is its own component if it is alone or with other null ids only. An empty table gives an empty result. Other columns are ignored.
    Returns: the id column, n_shingles, component_id.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).withColumn("_row", F.xxhash64("_id", "_text"))  # finds a row again, whatever ids repeat or are null
    spark = docs.sparkSession
    bounded_batches(spark)
    for salt in range(8):
        sets = Scratch(_sets(docs, salt), "near-sets")
        nodes = sets.df.where("_node is not null").groupBy("_node").agg(F.min("_id").alias("_doc"), F.min("_row").alias("_any"), F.min("_n").alias("_n"), F.min("_check").alias("_c1"), F.max("_check").alias("_c2"), F.any_value("_sketch").alias("_sketch"))
        nodes = Scratch(nodes, "near-nodes")
        if nodes.df.where("_c1 != _c2").isEmpty():
            break
        sets.drop()
        nodes.drop()
    n = nodes.df.agg(F.sum("_n").alias("n")).first()["n"] or 0
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    now = _Round(_keys(docs, salt), nodes.df.select("_node", "_n"), max(least, n // 3_000_000))
    release(spark)
    candidates, used = [now.pairs], [now.pairs]
    dense = None
    if now.n:
        with small_batches(spark, 32):  # rows hold whole sets
            members = Scratch(_as_numbers(_sets_of(now.heavy.df.select("_node"), nodes.df, docs, salt)), "near-members")
        for turn in range(ROUNDS):
            before, current = now, members.df.join(now.heavy.df.select("_node"), "_node")
            keys = Scratch(_rare_first(current), "near-rare")
            now = _Round(keys.df.select("_key", "_node"), before.heavy.df, max(least, n // 3_000_000))
            candidates.append(now.pairs)
            used.append(now.pairs)
            before.drop()
            if now.n == 0 or 10 * now.n > 9 * before.n or turn == ROUNDS - 1:
                break
            keys.drop()
        if now.n:
            cold = keys.df.select("_node", "_cold").distinct()
            dense = now.hot.join(now.heavy.df, "_node").join(cold, "_node").where("4 * _cold <= _n")
            dense = Scratch(dense.select("_key", "_node", "_n", "_cold"), "near-hot")
            centre = dense.df.groupBy("_key").agg(F.min(F.struct("_cold", "_node")).alias("_m")).select("_key", F.col("_m._node").alias("_to"))
            stars = dense.df.join(centre, "_key").where("_node != _to").select(F.least("_node", "_to").alias("_a"), F.greatest("_node", "_to").alias("_b")).distinct()
            stars = Scratch(stars, "near-stars")
            candidates.append(stars)
            used.append(stars)
        keys.drop()
        members.drop()
    now.drop()
    release(spark)
    pairs = candidates[0].df
    for c in candidates[1:]:
        pairs = pairs.union(c.df)
    survivors = Scratch(_filtered(pairs.distinct(), nodes.df), "near-pairs")
    for c in used:
        c.drop()
    release(spark)
    with small_batches(spark, 32):
        links = Scratch(_verified(survivors.df, nodes.df, docs, salt), "near-links")
    release(spark)
    comps = components(links.df)
    if dense:
        sketches = _short(nodes.df.join(dense.df.select("_node").distinct(), "_node"))
        placed = dense.df.join(comps, "_node", "left").join(sketches, "_node").select("_key", "_node", F.coalesce("_comp", "_node").alias("_comp"), "_n", "_cold", "_sketch")
        rest = Scratch(_filtered(_across(placed).distinct().join(survivors.df, ["_a", "_b"], "left_anti"), nodes.df), "near-rest")
        if not rest.df.isEmpty():
            with small_batches(spark, 32):
                more = Scratch(_verified(rest.df, nodes.df, docs, salt), "near-more")
            comps = components(links.df.union(more.df))
            more.drop()
        rest.drop()
        dense.drop()
    survivors.drop()
    groups = nodes.df.select("_node", "_doc").join(comps, "_node", "left").select("_node", "_doc", F.coalesce("_comp", "_node").alias("_comp"))
    least_of = groups.groupBy("_comp").agg(F.min("_doc").alias("component_id"))
    named = Scratch(groups.join(least_of, "_comp").select("_node", "component_id"), "near-named")
    links.drop()
    nodes.drop()
    release(spark)
    joined = sets.df.select("_id", "_n", "_node").join(named.df, "_node", "left")
    return joined.select(F.col("_id").alias(id_col), F.col("_n").alias("n_shingles"), F.when(F.col("_node").isNull(), F.col("_id")).otherwise(F.col("component_id")).alias("component_id"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is their component's smallest, with all columns, and of rows that repeat an id and a text one.

    Rows that share an id share its fate: they go if one of them does. Rows without an id stay.
    """
    docs = without_repeats(docs, id_col, text_col)
    gone = near_groups(docs, id_col, text_col).where(F.col("component_id") != F.col(id_col)).select(F.col(id_col).alias("_gone")).distinct()
    return docs.join(gone, docs[id_col].cast("long") == gone["_gone"], "left_anti")


def op6_near_copies(spark, sf_dir):
    """``near_groups`` over all ``documents``."""
    return near_groups(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
