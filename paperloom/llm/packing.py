"""Harmonic packing of token sequences, each worker on its own."""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from paperloom.runtime import bounded_batches, spread, table

CAPACITY = 4096
#: Documents of fewer ids than this are in no class; they fill the room that bins of the classes leave.
LEAST = 64
#: Bins with a full number of documents that wait for something to fill their room.
WAITING = 32

_memo: dict = {}
_PIECES = re.compile(r"[a-z]+|[0-9]|[^a-z0-9]+")


class _Words(dict):
    """Ids of a word as little-endian unsigned 32-bit bytes, encoded when first asked for.

    It keeps at most two generations of MOST words: when the young one is full, it replaces the old one, from which words that are asked for again come back.
    """

    MOST = 400_000

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer, self.model = tokenizer, tokenizer.model
        self.old: dict[str, bytes] = {}

    def encode(self, word: str) -> bytes:
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def parts(self, word: str) -> bytes:
        """Words of ASCII letters are as the tokenizer's normalizer and pre-tokenizer leave them, so its model alone, which is faster, gives their ids."""
        if word.isascii() and word.isalpha() and word.islower():
            return array("I", [t.id for t in self.model.tokenize(word)]).tobytes()
        if word.isascii() and word.isprintable() and "'" not in word:
            pieces = _PIECES.findall(word.lower())
            if len(pieces) > 1:
                return b"".join(map(self.__getitem__, pieces))
        return self.encode(word)

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = self.parts(word)
        if len(word) <= 64:
            if len(self) >= self.MOST:
                self.old = dict(self)
                self.clear()
            self[word] = ids
        return ids


def word_bpe(path: str, end_id: int = 2) -> Callable[[str | None], bytes]:
    """A function from a text to its ids, as bytes, with ``end_id`` at the end.

    The tokenizer of this file lower-cases, and its pre-tokenizer never joins what a blank or line feed divides, nor ASCII letters, digits and other
    signs (contractions apart); so words are encoded once and remembered. Texts that may hold a special token's string are encoded as a whole.
    """
    if path not in _memo:
        from tokenizers import Tokenizer

        words = _Words(Tokenizer.from_file(path))
        _memo[path] = words
    words, tail = _memo[path], array("I", [end_id]).tobytes()

    def ids(text: str | None) -> bytes:
        text = text or ""
        if "<|" in text:
            return words.encode(text) + tail
        return b"".join(map(words.__getitem__, filter(None, text.replace("\n", " ").split(" ")))) + tail

    return ids


class Bins:
    """One worker's bins. ``put`` and ``finish`` yield closed sequences as lists of (document, start, length, ids) in order.

    A document whose length is in (capacity / (k + 1), capacity / k] is of class k, and a bin of this class takes exactly k such documents, whole. The room that is left then
    is filled to the last id: from rests of documents longer than a bin, which alone must be cut, else by documents shorter than ``least``, else, when more than ``WAITING`` bins wait, by a document of a
    class that fits, or is cut if none does. Held are fewer than k documents of each class and the waiting bins: some ``capacity / least`` + WAITING sequences' worth of ids.
    """

    def __init__(self, capacity: int = CAPACITY, least: int = LEAST):
        self.capacity, self.least = capacity, least
        self.open: dict[int, list] = {}
        self.rests: list = []  # cut already, so they may be cut again
        self.short: list = []
        self.filling = 0  # ids of both
        self.waiting: list[tuple[int, list]] = []

    def put(self, piece: tuple) -> Iterator[list]:
        doc, start, size, ids = piece
        while size > self.capacity:
            yield [(doc, start, self.capacity, ids[: 4 * self.capacity])]
            start, size, ids = start + self.capacity, size - self.capacity, ids[4 * self.capacity :]
        piece = (doc, start, size, ids)
        if start or size < self.least:
            (self.rests if start else self.short).append(piece)
            self.filling += size
        else:
            k = self.capacity // size
            held = self.open.setdefault(k, [])
            held.append(piece)
            if len(held) == k:
                room = self.capacity - sum(p[2] for p in held)
                del self.open[k]
                if room:
                    self.waiting.append((room, held))
                else:
                    yield held
        yield from self._fill()

    def _fill(self) -> Iterator[list]:
        """Close the waiting bins whose room can be filled."""
        while self.waiting:
            while len(self.waiting) > WAITING and self.filling < self.waiting[0][0]:
                self._give(self.waiting[0][0] - self.filling)
            if self.filling < self.waiting[0][0]:
                return
            room, held = self.waiting.pop(0)
            self.filling -= room
            while room:
                at = self.rests or self.short
                doc, start, size, ids = at.pop()
                if size > room:
                    self.rests.append((doc, start + room, size - room, ids[4 * room :]))
                    size, ids = room, ids[: 4 * room]
                held.append((doc, start, size, ids))
                room -= size
            yield held

    def _give(self, room: int) -> None:
        """Let a document of a class fill room: of the classes whose documents all fit, the one of the longest, else the one of the shortest; or the last of a waiting bin."""
        fitting = [k for k in self.open if self.capacity // k <= room]
        if self.open:
            k = min(fitting) if fitting else max(self.open)
            piece = self.open[k].pop()
            if not self.open[k]:
                del self.open[k]
            (self.short if fitting else self.rests).append(piece)
            self.filling += piece[2]
            return
        _, held = self.waiting.pop()
        self.rests += held
        self.filling += sum(p[2] for p in held)

    def finish(self) -> Iterator[list]:
        """What is left, end to end: waiting bins first, then larger classes, in full bins and then in sequences whose lengths are falling powers of two: they need no padding either."""
        left = [p for _, held in self.waiting for p in held] + [p for k in sorted(self.open) for p in self.open[k]] + self.rests + self.short
        total = sum(p[2] for p in left)
        size = self.capacity
        while total:
            while size > total:
                size //= 2
            head, left = cut_at(left, size)
            total -= size
            yield head


def cut_at(pieces: list, size: int) -> tuple[list, list]:
    """The first ``size`` ids of pieces that stand end to end, and the rest."""
    head: list = []
    for k, (doc, start, length, ids) in enumerate(pieces):
        if size == 0:
            return head, pieces[k:]
        if length <= size:
            head.append((doc, start, length, ids))
            size -= length
        else:
            head.append((doc, start, size, ids[: 4 * size]))
            return head, [(doc, start + size, length - size, ids[4 * size :]), *pieces[k + 1 :]]
    return head, []


SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long, sequence_length long"


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pack the ids of all rows' whole texts into sequences of at most ``capacity`` ids.

    Documents fall into reciprocal classes: those of class k have capacity / (k + 1) to capacity / k ids, and a bin takes k of them, whole (``Bins``). Each partition fills its own bins,
    without a shuffle; the room that k documents leave is filled to the last id, and a partition's last ids go to sequences whose lengths are powers of two, so no sequence needs
    padding. Cut are documents longer than a bin, one document or rest for each bin's room at most, and what is left in the end. A task holds one text at a time, and the open bins.

    A null or empty text is its end id alone. Repeated rows and null ids are packed like others. An empty table gives an empty result. Other columns are ignored.
    Returns a row for each piece: the id column, start, length, ids_crc32, doc_tokens, sequence_id, offset and sequence_length, and with ``with_ids`` the piece's ids (little-endian 32-bit).
    ``sequence_id`` is the partition's number times 2^33 plus a counter.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.selectExpr(f"`{id_col}` as id", f"`{text_col}` as text")
    id_type = rows.schema["id"].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, {SCHEMA}" + (", ids binary" if with_ids else "")
    names = [id_col, *(x.split()[0].strip("`") for x in SCHEMA.split(", ")), *["ids"] * with_ids]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, bins, out = word_bpe(tokenizer), Bins(capacity, least), []
        sequence = TaskContext.get().partitionId() << 33
        id_arrow = None

        def close(pieces: list) -> None:
            nonlocal sequence
            offset = 0
            whole = sum(p[2] for p in pieces)
            for (doc, doc_tokens), start, length, ids in pieces:
                out.append((doc, start, length, zlib.crc32(ids), doc_tokens, sequence, offset, whole, *[ids] * with_ids))
                offset += length
            sequence += 1

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [[]] * len(names)
            types = [id_arrow, *[pa.int64()] * 7, *[pa.binary()] * with_ids]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        for b in batches:
            id_arrow = b.column(0).type
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = encode(text.as_py())
                n = len(ids) // 4
                for full in bins.put(((doc, n), 0, n, ids)):
                    close(full)
                if len(out) >= (500 if with_ids else 20_000):
                    yield flush()
        for full in bins.finish():
            close(full)
        if id_arrow is not None:
            yield flush()

    return rows.mapInArrow(packed, schema)


def public_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark, sf_dir):
    """``pack`` over all ``documents`` with the 49k word vocabulary."""
    return pack(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), public_path())
