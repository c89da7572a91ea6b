"""Hashed features of texts: counts of words, pairs of words and runs of four characters, a document at a time."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa

from paperloom.functions.text import _FROM, _SEVERAL, _TO, STOPWORDS

try:
    from _md5 import md5  # half the time of OpenSSL's on short texts
except ImportError:
    from hashlib import md5

_WORD, _STOP = re.compile("[a-z0-9]+"), frozenset(STOPWORDS)
#: Bounds on what a worker holds: characters of a text at once, documents and features of a batch that leaves, hashes that it remembers.
PIECE, DOCS, FEATURES, KNOWN = 1 << 20, 256, 1 << 21, 1 << 20


_FOLDED = {c: _TO[k] if k < len(_TO) else "" for k, c in enumerate(_FROM)} | dict(_SEVERAL)
_SPACES = re.compile("[\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_SEPARATORS = re.compile("[\x1c-\x1f]")  # white space to Python only


def normalised(text: str | None) -> str:
    """``text.normalise_text`` of one text: lower case, no accents, single blanks; null counts as empty."""
    if not text:
        return ""
    if not text.isascii():
        for c in set(text):
            if c in _FOLDED:
                text = text.replace(c, _FOLDED[c])
    text = text.lower()
    return _SPACES.sub(" ", text).strip(" ") if _SEPARATORS.search(text) else " ".join(text.split())


def heads(features: list[str]) -> np.ndarray:
    """The first eight hex digits of each feature's MD5. Normalised text has no line ends, so features are encoded at once."""
    return np.frombuffer(b"".join([md5(f, usedforsecurity=False).digest() for f in "\n".join(features).encode().split(b"\n")] if features else []), ">u4")[::4].astype(np.int64)


class Grams:
    """Hashes of runs of four characters, each four 16-bit units in one number; those met before are remembered."""

    def __init__(self) -> None:
        self.known, self.head = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def heads(self, grams: np.ndarray) -> np.ndarray:
        for _ in range(2):
            at = np.searchsorted(self.known, grams)
            there = at < len(self.known)
            there[there] = self.known[at[there]] == grams[there]
            if there.all():
                break
            new = np.unique(grams[~there])
            if len(self.known) + len(new) > KNOWN:
                self.__init__()
                new = np.unique(grams)
            text = new.astype("<u8").tobytes().decode("utf-16-le")
            known, head = np.concatenate([self.known, new]), np.concatenate([self.head, heads(["c:" + text[k : k + 4] for k in range(0, len(text), 4)])])
            order = np.argsort(known)
            self.known, self.head = known[order], head[order]
        return self.head[at]


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers and their counts, added up."""
    if len(parts) == 1:
        return parts[0]
    found, at = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
    return found, np.bincount(at, np.concatenate([n for _, n in parts]), len(found)).astype(np.int64)


class Document:
    """What the rows of one id hold: counts of words, of pairs, and of runs of characters."""

    def __init__(self, ident) -> None:
        self.id, self.rows = ident, 0
        self.words, self.pairs, self.rare = Counter(), Counter(), Counter()
        self.grams: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, text: str | None) -> None:
        """A row's text."""
        self.rows += 1
        text = normalised(text)
        words = [w for w in _WORD.findall(text) if len(w) > 1 and w not in _STOP]
        self.words.update(words)
        self.pairs.update([f"b:{a}_{b}" for a, b in pairwise(words)])
        flat = text.replace(" ", "_")
        for k in range(0, len(flat) - 3, PIECE):
            piece = flat[k : k + PIECE + 3]
            units = piece.encode("utf-16-le")
            if len(units) > 2 * len(piece):  # characters of two units
                self.rare.update(["c:" + piece[i : i + 4] for i in range(len(piece) - 3)])
                continue
            g = np.sort(np.ndarray(len(piece) - 3, "<u8", units, strides=(2,)))
            first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
            self.grams.append((g[first], np.diff(first, append=len(g))))
            if len(self.grams) > 64:
                self.grams = [merged(self.grams)]

    def size(self) -> int:
        return len(self.words) + len(self.pairs) + len(self.rare) + sum(len(g) for g, _ in self.grams)


_grams = Grams()


def slotted(docs: list[Document], dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents x slots) of values, and which slots any feature fell into."""
    key, n, head = [], [], []
    for k, d in enumerate(docs):
        d.rare.update({f"w:{w}": c for w, c in d.words.items()})
        for counts in (d.rare, d.pairs):
            key.append(np.full(len(counts), k))
            n.append(np.fromiter(counts.values(), np.int64, len(counts)))
            head.append(heads(list(counts)))
    grams = [(k, *merged(d.grams)) for k, d in enumerate(docs) if d.grams]
    if grams:
        key += [np.full(len(g), k) for k, g, _ in grams]
        n += [c for _, _, c in grams]
        head.append(_grams.heads(np.concatenate([g for _, g, _ in grams])))
    h = np.concatenate(head)
    # the slot is the first seven hex digits, the sign the eighth
    at = np.concatenate(key) * dim + (h >> 4) % dim
    value = np.where(h & 8, -1.0, 1.0) * (1 + np.log(np.concatenate(n)))
    size = len(docs) * dim
    return np.bincount(at, value, size).astype(np.float64, copy=False).reshape(-1, dim), np.bincount(at, minlength=size).reshape(-1, dim) > 0


def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[list[Document]]:
    """Documents in lists of bounded size, from (id, text) rows that have a document's rows side by side."""
    done, size, now = [], 0, None
    for b in batches:
        for ident, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if now is None or now.id != ident:
                if now is not None:
                    done.append(now)
                    size += now.size()
                if len(done) >= DOCS or size >= FEATURES:
                    yield done
                    done, size = [], 0
                now = Document(ident)
            now.add(text)
    if now is not None:
        yield [*done, now]
