"""Removal of repeated byte strings over a whole corpus: content-chosen anchors bring equal strings together, factor lengths in suffix order decide."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.factors import longest_factors, previous_factors
from paperloom.llm.shingles import mixed
from paperloom.runtime import Scratch, release, spread, table

#: Every byte goes that a string of SPAN bytes covers which starts anywhere else too; and a later copy is a string of LEAST bytes that starts earlier too.
SPAN, LEAST = 400, 256
#: An anchor is the smallest hash of all strings of CORE bytes inside a string of LEAST bytes, so equal strings have anchors at equal places.
CORE = 128
#: Cores with more different surroundings than this are settled by counting hashes of their strings instead of in one task's suffix order.
HOT = 65_536
_P = 0x9E3779B97F4A7C15 | 1
_STEP = 1 << 18


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_P, _STEP + 1), _powers(pow(_P, -1, 1 << 64), _STEP + 1)
#: A random number for each byte value.
_BYTE = mixed(np.arange(1, 257, dtype=np.uint64))


def rolling(raw: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each string of ``width`` bytes."""
    if len(raw) < width:
        return np.empty(0, np.uint64)
    out = []
    for at in range(0, len(raw) - width + 1, _STEP - width):
        piece = _BYTE[raw[at : at + _STEP]]
        total = np.r_[np.uint64(0), np.cumsum(piece * _UP[: len(piece)], dtype=np.uint64)]
        part = (total[width:] - total[:-width]) * _DOWN[: len(piece) - width + 1]
        out.append(part[: _STEP - width])
    return mixed(np.concatenate(out))


def _sliding_least(v: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, by running minima of blocks from both sides."""
    n = len(v)
    fill = -n % width
    w = np.r_[v, np.full(fill, np.iinfo(np.uint64).max, np.uint64)].reshape(-1, width)
    ahead = np.minimum.accumulate(w, 1).ravel()
    behind = np.minimum.accumulate(w[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(raw: np.ndarray, span: int = LEAST, core: int = CORE) -> tuple[np.ndarray, np.ndarray]:
    """Places and core hashes of all anchors of a byte string: of each ``span`` bytes, the core with the least hash, the last such."""
    h = rolling(raw, core)
    width = span - core + 1
    if len(h) < width:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    chosen = []
    step = (1 << 22) - width
    for at in range(0, len(h) - width + 1, step):
        part = h[at : at + step + width - 1]
        low = np.uint64((1 << 22) - 1)
        marked = (mixed(part + np.uint64(1)) & ~low) | (low - np.arange(len(part), dtype=np.uint64))
        best = _sliding_least(marked, width)
        best = best[np.r_[True, best[1:] != best[:-1]]]
        chosen.append(at + (low - (best & low)).astype(np.int64))
    places = np.unique(np.concatenate(chosen))
    return places, h[places]


def merged(pairs: np.ndarray) -> list[list[int]]:
    """Overlapping or touching (start, end) pairs as one."""
    out: list[list[int]] = []
    for a, b in pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))].tolist():
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


# Rows of the search. _kind 0: an anchor with its window's hash; 1: the same, its window known to be repeated; 3: an anchor whose window is wanted (_w1: whether it is known to be repeated); 4: the same of a hot core;
# ANY and LATER: a settled interval of a document.
ANY, LATER = 8, 9
_ROWS = "_kind int, _core long, _w1 long, _w2 long, _id long, _tag long, _at long, _from long, _to long"
_NAMES = [x.split()[0] for x in _ROWS.split(", ")]
_TYPES = [np.int32, *[np.int64] * 8]


def _batch(columns: tuple) -> pa.RecordBatch:
    n = max(np.size(c) for c in columns)
    return pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(np.asarray(c, t), n)) for c, t in zip(columns, _TYPES, strict=True)], names=_NAMES)


def _interval_rows(kind: int, ids: np.ndarray, tag: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Intervals, those of a document that touch as one. They are dealt like anchors, by a hash of their document."""
    if not len(ids):
        return
    rows = np.lexsort((start, tag, ids))
    a, b, i, g = start[rows], end[rows], ids[rows], tag[rows]
    new = np.r_[True, (i[1:] != i[:-1]) | (g[1:] != g[:-1]) | (a[1:] > b[:-1])]  # windows are cut at the same widths, so ends rise with starts
    heads = np.flatnonzero(new)
    yield _batch((kind, mixed(i[heads].view(np.uint64) + g[heads].view(np.uint64)).view(np.int64), 0, 0, i[heads], g[heads], 0, a[heads], np.maximum.reduceat(b, heads)))


class _Runs:
    """Equal windows among rows (kind, core, w1, w2, id, tag, at, from, to) sorted by core, window and place."""

    def __init__(self, rows: tuple):
        kind, core, w1, w2, ids, tag, at, start, end = rows
        self.new = np.r_[True, (core[1:] != core[:-1]) | (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1])]
        self.heads = np.flatnonzero(self.new)
        run = np.cumsum(self.new) - 1
        self.many = (np.diff(np.r_[self.heads, len(core)]) > 1) | (np.add.reduceat(kind == 1, self.heads) > 0)
        self.known = self.many[run]
        head = self.heads[run]
        self.later = (ids != ids[head]) | (tag != tag[head]) | (at != at[head])
        self.rows = rows

    def intervals(self, span: int) -> Iterator[pa.RecordBatch]:
        _, _, _, _, ids, tag, _, start, end = self.rows
        for kind, hit in ((ANY, self.known & (end - start >= span)), (LATER, self.later)):
            yield from _interval_rows(kind, ids[hit], tag[hit], start[hit], end[hit])

    def firsts(self) -> tuple:
        """The first row of each window, of kind 1 if the window is repeated."""
        out = [c[self.heads] for c in self.rows]
        out[0] = np.where(self.many, 1, 0).astype(np.int32)
        return tuple(out)


def _anchor_rows(docs: DataFrame, span: int, least: int, core: int) -> DataFrame:
    """Anchors of all rows. Windows that a batch holds twice are settled there: their intervals go by document, and the first row of them goes on, known to be repeated."""

    def settle(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        rows = tuple(np.concatenate(x) for x in zip(*parts, strict=True))
        rows = tuple(c[np.lexsort((rows[6], rows[5], rows[4], rows[3], rows[2], rows[1]))] for c in rows)
        runs = _Runs(rows)
        yield from runs.intervals(span)
        yield _batch(runs.firsts())

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts, size = [], 0
            for i, g, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                raw = (t.as_py() or "").encode("utf-8", "surrogatepass")
                if len(raw) < least:
                    continue
                at, h = anchors(np.frombuffer(raw, np.uint8), least, core)
                start, end = np.maximum(at - (span - core), 0), np.minimum(at + span, len(raw))
                digests = b"".join([xxhash.xxh3_128_digest(raw[x:y], seed=z - x) for x, y, z in zip(start.tolist(), end.tolist(), at.tolist(), strict=True)])
                w = np.frombuffer(digests, np.int64).reshape(-1, 2)
                n = len(at)
                parts.append((np.zeros(n, np.int32), h.view(np.int64), w[:, 0], w[:, 1], np.full(n, i), np.full(n, g), at, start, end))
                size += n
                if size > 200_000:
                    yield from settle(parts)
                    parts, size = [], 0
            if parts:
                yield from settle(parts)

    return docs.mapInArrow(mapped, _ROWS)


def _by_core(rows: DataFrame, span: int, hot: int, chunk: int = 200_000) -> DataFrame:
    """From rows in partitions by core, sorted by core, window and place: intervals of equal windows, and of cores with several different windows the first row of each (kind 3, of hot cores 4).

    A task holds ``chunk`` rows and the different windows of one core, ``hot`` of them at most, whatever the size of its partition.
    """

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, burning = 0, None

        def digest(final: bool) -> Iterator[pa.RecordBatch | tuple]:
            nonlocal burning
            runs = _Runs(tuple(np.concatenate(x) for x in zip(*held, strict=True)))
            yield from runs.intervals(span)
            rows = runs.firsts()
            core = rows[1]
            heads = np.flatnonzero(np.r_[True, core[1:] != core[:-1]])
            sizes = np.diff(np.r_[heads, len(core)])
            kinds = np.where(sizes > hot, 4, np.where(sizes > 1, 3, 0))
            if burning is not None:
                kinds[core[heads] == burning] = 4
            keep = len(core)
            if not final:  # the last core may go on
                keep = len(core) - 1 if kinds[-1] == 4 else int(heads[-1])
                burning = core[-1] if kinds[-1] == 4 else None
            kind = np.repeat(kinds, sizes)
            on = np.flatnonzero(kind[:keep] > 0)
            for x in range(0, len(on), 100_000):
                r = on[x : x + 100_000]
                yield _batch((kind[r], core[r], rows[0][r], 0, *(c[r] for c in rows[4:])))
            yield tuple(c[keep:] for c in rows)

        for b in batches:
            settled = pa.compute.greater_equal(b.column(0), ANY)
            passed = b.filter(settled)
            if len(passed):
                yield passed
            b = b.filter(pa.compute.invert(settled))
            if len(b):
                held.append(tuple(c.to_numpy() for c in b.columns))
                size += len(b)
            if size >= chunk:
                *out, rest = digest(False)
                yield from out
                held, size = [rest], 0  # what is kept counts anew, so that many windows of one core are looked at once a chunk
        if held:
            *out, _ = digest(True)
            yield from out

    return rows.mapInArrow(mapped, _ROWS)


_WINDOWS = "_hot boolean, _core long, _known boolean, _id long, _tag long, _at long, _from long, _bytes binary"


def _windows(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """The bytes of wanted windows."""
    lists = wanted.groupBy("_id", "_tag").agg(F.collect_list(F.struct("_kind", "_core", "_w1", "_at", "_from", "_to")).alias("_wanted"))

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        types = (pa.bool_(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[x.split()[0] for x in _WINDOWS.split(", ")])

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for i, g, t, wants in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
                raw = (t.as_py() or "").encode("utf-8", "surrogatepass")
                out += [(w["_kind"] == 4, w["_core"], w["_w1"] == 1, i, g, w["_at"], w["_from"], raw[w["_from"] : w["_to"]]) for w in wants.as_py()]
                if len(out) > 5000:
                    yield batch(out)
                    out = []
            if out:
                yield batch(out)

    return docs.join(lists, ["_id", "_tag"]).select("_id", "_tag", "_text", "_wanted").mapInArrow(mapped, _WINDOWS)


def _neighbours(group: np.ndarray, parts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows in the order of their group and bytes, and the length that each shares with the one before it (-1 in another group)."""
    order = np.array(sorted(range(len(parts)), key=list(zip(group.tolist(), parts, strict=True)).__getitem__))
    sizes = np.array([len(x) for x in parts])[order]
    text = np.frombuffer(b"".join([parts[k].ljust(width, b"\0") for k in order.tolist()]), np.uint8).reshape(-1, width)
    shared = np.full(len(parts), -1, np.int64)
    same = np.flatnonzero(group[order][1:] == group[order][:-1]) + 1
    for at in range(0, len(same), 4096):
        r = same[at : at + 4096]
        differ = text[r] != text[r - 1]
        first = np.where(differ.any(1), differ.argmax(1), width)
        shared[r] = np.minimum(first, np.minimum(sizes[r], sizes[r - 1]))
    return order, shared


def _reach(places: list[int], right: list[int], shared_right: list[int], left: list[int], shared_left: list[int], spans: tuple[int, int]) -> list[list[int]]:
    """For windows around one core, how far to the left and right of the core's start the strings go that are ``spans[0]`` long or longer and stand in any other window, and of ``spans[1]`` in an earlier one.

    ``right`` has the windows in the order of their bytes from the core on and ``left`` in the order of the bytes before it, backwards; ``shared`` are the lengths that neighbours there have in common.
    Strings that start l bytes before the core are equal only in windows that share these l bytes, which are neighbours on the left; among those, their suffix order is that on the right.
    So for each l at which windows part, longest factors and longest previous factors (by previous and next smaller places) give the strings' lengths.
    """
    n = len(places)
    rank = [0] * n
    for k, x in enumerate(right):
        rank[x] = k
    lows = np.array(shared_right[1:], np.int64)
    reach = [[0, 0, 0, 0] for _ in range(n)]
    for level in sorted({x for x in shared_left[1:] if x > 0} | {0}, reverse=True):
        at = 0
        while at < n:
            end = at + 1
            while end < n and shared_left[end] >= level:
                end += 1
            if end - at > 1:
                members = sorted(left[at:end], key=rank.__getitem__)
                ranks = [rank[x] for x in members]
                between = np.minimum.reduceat(lows[: ranks[-1]], ranks[:-1]).tolist()
                earlier = previous_factors([places[x] for x in members], between)
                for x, whole, before in zip(members, longest_factors(between), earlier, strict=True):
                    for k, length, span in ((0, whole, spans[0]), (2, before, spans[1])):
                        if length and level + length >= span:
                            reach[x][k] = max(reach[x][k], level)
                            reach[x][k + 1] = max(reach[x][k + 1], length)
            at = end
    return reach


def settle_cores(cores: list[int], windows: list[bytes], lefts: list[int], places: list[tuple], span: int, least: int) -> list[tuple[int, int, int, int]]:
    """For windows of several cores, with the bytes before the core (``lefts``) and their places: how many bytes before and from the core's start are covered by strings of ``span`` bytes that stand in another
    window of the core too, and by strings of ``least`` bytes that stand in an earlier one. Both strings hold the core, at the same place in both windows."""
    group = np.unique(np.array(cores), return_inverse=True)[1]
    rights = [w[x:] for w, x in zip(windows, lefts, strict=True)]
    before = [w[:x][::-1] for w, x in zip(windows, lefts, strict=True)]
    right, shared_right = _neighbours(group, rights, max(map(len, rights)))
    left, shared_left = _neighbours(group, before, max(1, max(map(len, before))))
    heads = np.flatnonzero(shared_right < 0).tolist()
    out = [(0, 0, 0, 0)] * len(windows)
    for a, b in zip(heads, [*heads[1:], len(windows)], strict=True):
        rows = right[a:b].tolist()
        if b - a == 2:  # one pair: it shares what it shares
            x, y = rows
            r, h = int(shared_right[a + 1]), int(shared_left[a + 1])
            second = x if places[x] > places[y] else y
            for k in rows:
                whole = (h, r) if h + r >= span else (0, 0)
                out[k] = (*whole, *((h, r) if k == second and h + r >= least else (0, 0)))
            continue
        number = {x: k for k, x in enumerate(sorted(rows))}
        order = sorted(rows, key=places.__getitem__)
        place = [0] * len(rows)
        for k, x in enumerate(order):
            place[number[x]] = k
        found = _reach(place, [number[x] for x in rows], shared_right[a:b].tolist(), [number[x] for x in left[a:b].tolist()], shared_left[a:b].tolist(), (span, least))
        for x in rows:
            out[x] = tuple(found[number[x]])
    return out


_INTERVALS = "_kind int, _id long, _tag long, _from long, _to long"


def _settled(windows: DataFrame, span: int, least: int, core: int, chunk: int = 2 << 20) -> DataFrame:
    """Intervals from windows dealt by core and sorted by core and place, in pieces of whole cores of about ``chunk`` bytes."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, None

        def close() -> Iterator[pa.RecordBatch]:
            found = settle_cores([x[0] for x in held], [x[5] for x in held], [x[3] - x[4] for x in held], [(x[1], x[2], x[3]) for x in held], span, least)
            rows = []
            for (_, i, g, at, _, _), (a, b, c, d) in zip(held, found, strict=True):
                if b:
                    rows.append((ANY, i, g, at - a, at + b))
                if d:
                    rows.append((LATER, i, g, at - c, at + d))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), *[pa.int64()] * 4), strict=True)], names=[x.split()[0] for x in _INTERVALS.split(", ")])

        for b in batches:
            for row in zip(*(b.column(k).to_pylist() for k in (1, 3, 4, 5, 6, 7)), strict=True):
                if size >= chunk and row[0] != last:
                    yield from close()
                    held, size = [], 0
                if held and held[-1][:4] == row[:4]:  # rows that repeat an id and a text
                    continue
                held.append(row)
                size += len(row[5])
                last = row[0]
        if held:
            yield from close()

    return windows.mapInArrow(mapped, _INTERVALS)


def _hot_strings(windows: DataFrame, span: int, least: int, core: int) -> DataFrame:
    """Of windows of hot cores, a row for each of their strings that hold the core: its kind, two hashes of it, its core and its place beside that, the row's document and the string's start."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for key, i, tag, at, start, raw in zip(*(b.column(k).to_pylist() for k in (1, 3, 4, 5, 6, 7)), strict=True):
                for kind, size in ((ANY, span), (LATER, least)):
                    for x in range(max(0, at - start - size + core), min(at - start, len(raw) - size) + 1):
                        h = xxhash.xxh3_128_intdigest(raw[x : x + size], seed=(key + start + x - at) & ((1 << 64) - 1))
                        out.append((kind, (h >> 64) - (1 << 63), (h & ((1 << 64) - 1)) - (1 << 63), i, tag, start + x))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), *[pa.int64()] * 5), strict=True)], names=["_kind", "_h1", "_h2", "_id", "_tag", "_from"])

    return windows.mapInArrow(mapped, "_kind int, _h1 long, _h2 long, _id long, _tag long, _from long")


def repeated_bytes(docs: DataFrame, span: int = SPAN, least: int = LEAST, core: int = CORE, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row, what is left of its text's UTF-8 bytes when every byte goes that is covered by a string of ``span`` bytes that starts anywhere else too; and what is left when only later copies go:
    bytes covered by a string of ``least`` bytes (``span`` at most) that also starts earlier, in a row of a smaller id or before in the same text, so the first copy stays.

    Texts are cut at their ends, so matches never cross rows; overlapping strings count, and all is judged on the input. Each string of ``least`` bytes has an anchor, chosen by its content
    alone, so equal strings meet under the hash of their anchor's core. Anchors whose whole windows (all strings around the core) are equal are settled by
    a 128-bit hash, within batches even before the shuffle, so copies in a third of all rows send one row a batch. The windows of cores that stand
    in several different windows are fetched, and longest factors and longest previous factors in their suffix order tell how far strings repeat. Cores with more than ``hot`` different windows are
    settled by counting 128-bit hashes of their strings.

    Null texts are empty; a text shorter than ``least`` keeps all. A row that repeats another's text is a repetition of it, so both lose all if they are long enough, and the one of the larger id is the later copy;
    rows that repeat an id and a text are one row to what is earlier. Rows that share an id are told apart by their texts. Null ids come first. An empty table gives an empty result. Other columns are ignored.
    Returns: the id column, n_bytes, n_removed, n_spans, kept (the bytes that are left), n_later, n_later_spans, kept_first (the bytes that are left without later copies).
    """
    if not core <= least <= span:
        raise ValueError("core <= least <= span")
    docs = docs.select(F.col(id_col).cast("long").alias("_own"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("_id"), F.xxhash64(F.col(text_col)).alias("_tag"), F.col(text_col).alias("_text"))
    short = docs.select("_id", "_tag", "_text")
    spark = docs.sparkSession
    rows = _anchor_rows(short, span, least, core).repartition("_core").sortWithinPartitions("_core", "_w1", "_w2", "_id", "_tag", "_at")
    found = Scratch(_by_core(rows, span, hot), "bytes-found")
    release(spark)
    windows = Scratch(_windows(found.df.where("_kind < 8"), short), "bytes-windows")
    release(spark)
    intervals = found.df.where("_kind >= 8").select("_kind", "_id", "_tag", "_from", "_to")
    plain = windows.df.where("not _hot").repartition("_core").sortWithinPartitions("_core", "_id", "_tag", "_at")
    intervals = intervals.union(_settled(plain, span, least, core))
    used = [found, windows]
    if not windows.df.where("_hot").isEmpty():
        held = Scratch(_hot_strings(windows.df.where("_hot").repartition(F.xxhash64("_id", "_at")), span, least, core), "bytes-strings")
        used.append(held)
        strings = held.df
        place = F.struct("_id", "_tag", "_from")
        twice = strings.groupBy("_kind", "_h1", "_h2").agg(F.count(F.lit(1)).alias("_n"), F.min(place).alias("_first")).where("_n > 1")
        hit = strings.join(twice, ["_kind", "_h1", "_h2"]).where((F.col("_kind") == ANY) | (F.col("_first") != place))
        intervals = intervals.union(hit.select("_kind", "_id", "_tag", "_from", (F.col("_from") + F.when(F.col("_kind") == ANY, span).otherwise(least)).alias("_to")))
    lists = Scratch(intervals.groupBy("_id", "_tag").agg(F.collect_set(F.struct("_kind", "_from", "_to")).alias("_gone")), "bytes-gone").df
    for x in used:
        x.drop()
    release(spark)

    def without(raw: bytes, runs: list[list[int]]) -> bytes:
        left, at = [], 0
        for x, y in runs:
            left.append(raw[at:x])
            at = y
        return b"".join([*left, raw[at:]])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: tuple[list, ...] = tuple([] for _ in range(7))
            for t, gone in zip(b.column(1), b.column(2), strict=True):
                raw = (t.as_py() or "").encode("utf-8", "surrogatepass")
                values: list = [len(raw)]
                for kind in (ANY, LATER):
                    mine = [(x["_from"], x["_to"]) for x in gone.as_py() if x["_kind"] == kind] if gone.is_valid else []
                    runs = merged(np.array(mine)) if mine else []
                    kept = without(raw, runs)
                    values += [len(raw) - len(kept), len(runs), kept]
                for c, v in zip(cols, values, strict=True):
                    c.append(v)
            types = (pa.int64(), *(pa.int64(), pa.int64(), pa.binary()) * 2)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=[id_col, *_RESULT])

    return docs.join(lists, ["_id", "_tag"], "left").select("_own", "_text", "_gone").mapInArrow(cut, f"`{id_col}` long, n_bytes long, n_removed long, n_spans long, kept binary, n_later long, n_later_spans long, kept_first binary")


_RESULT = ["n_bytes", "n_removed", "n_spans", "kept", "n_later", "n_later_spans", "kept_first"]


def op9_byte_spans(spark, sf_dir):
    """``repeated_bytes`` over all ``documents``, what is left as digests."""
    out = repeated_bytes(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_later", "n_later_spans", F.sha2("kept_first", 256).alias("first_kept_sha256"))
