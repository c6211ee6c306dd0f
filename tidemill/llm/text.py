"""Whole-batch text passes over Arrow buffers: words, n-gram hashes, character classes.

A word is a maximal run of ASCII letters and digits and of other characters outside ASCII, after lower-casing; no-break spaces and general and CJK
punctuation (U+00A0, U+2000 to U+207F, U+3000 to U+303F) part words, and each kana or ideograph (U+3040 to U+9FFF) is a word, as these scripts have no spaces. Every pass walks whole texts; buffers are cut between documents only.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 512 << 10  # memory per pass, not a bound on any text
_U = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_INV = pow(_P, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {"p": np.ones(1, _U), "i": np.ones(1, _U)}

WORD = np.zeros(256, bool)
WORD[ord("a") : ord("z") + 1] = WORD[ord("0") : ord("9") + 1] = WORD[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: near-equal inputs get unrelated outputs."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["p"]) < n:
        for k, base in (("p", _P), ("i", _INV)):
            a = np.full(n, base, _U)
            a[0] = 1
            _powers[k] = np.cumprod(a, dtype=_U)
    return _powers["p"], _powers["i"]


def buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array without nulls."""
    texts = texts.cast(pa.large_string())
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(texts: pa.Array | pa.ChunkedArray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(first row, slice) with about size bytes in each slice; nulls become empty texts."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64))
    a = 0
    while a < len(texts):
        before = int(ends[a - 1]) if a else 0
        b = max(a + 1, int(np.searchsorted(ends, before + size, "right")))
        yield a, pc.fill_null(texts.slice(a, b - a).cast(pa.large_string()), "")
        a = b


def tidied(run):
    """run over batches, then hand freed memory back: Python workers stay alive between tasks, beside the next stage's."""

    def tidy(batches):
        yield from run(batches)
        _powers["p"] = _powers["i"] = np.ones(1, _U)
        pa.default_memory_pool().release_unused()
        if sys.platform == "linux":
            ctypes.CDLL(None).malloc_trim(0)

    return tidy


def runs(raw: np.ndarray, off: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of bytes in table; no run crosses a document."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = table[raw]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cut = off[1:-1]
    cut = cut[(cut > 0) & (cut < len(raw))]
    first[cut] = inside[cut]
    last[cut - 1] = inside[cut - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def word_runs(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words in lower-cased UTF-8."""
    start, end = runs(raw, off, WORD)
    lead = np.flatnonzero(raw >= 0xE2) if len(raw) else np.zeros(0, np.int64)
    lead = lead[raw[lead] <= 0xE9]
    space = np.flatnonzero(raw == 0xC2)
    space = space[raw[space + 1] == 0xA0]
    if not len(lead) and not len(space):
        return start, end
    a, b = raw[lead], raw[lead + 1]
    mark, own = lead[((a == 0xE2) & (b <= 0x81)) | ((a == 0xE3) & (b == 0x80))], lead[(a > 0xE3) | ((a == 0xE3) & (b > 0x80))]
    inside = WORD[raw]
    for k in range(3):
        inside[mark + k] = False
    inside[space] = inside[space + 1] = False
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cut = np.concatenate([off[1:-1], own, own + 3])
    cut = cut[(cut > 0) & (cut < len(raw))]
    first[cut], last[cut - 1] = inside[cut], inside[cut - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def span_hash(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span."""
    if not len(start):
        return np.zeros(0, _U)
    p, i = _power(len(raw))
    s = np.zeros(len(raw) + 1, _U)
    np.cumsum((raw.astype(_U) + _U(1)) * p[: len(raw)], out=s[1:], dtype=_U)
    return mix((s[end] - s[start]) * i[start] + (end - start).astype(_U) * _U(0xD6E8FEB86659FD93))


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first word of each document, plus the total) for a slice from chunks()."""
    raw, off = buffer(pc.utf8_lower(texts))
    start, end = word_runs(raw, off)
    return span_hash(raw, start, end), np.searchsorted(start, off)


def ngrams(h: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word n-grams and each document's first; fewer than n words make one shorter gram."""
    size = np.diff(at)
    if not len(h):
        return np.zeros(0, _U), np.zeros(len(at), np.int64)
    acc = np.zeros(len(h), _U)
    doc = np.repeat(np.arange(len(size)), size)
    for k in range(n):
        w = np.zeros(len(h), _U)
        if k < len(h):
            same = doc[k:] == doc[: len(h) - k]
            w[: len(h) - k] = np.where(same, h[k:], _U(0))
        acc = mix(acc * _U(0x9FB21C651E98DF25) + w + _U(1))
    pos = np.arange(len(h)) - at[doc]
    keep = (pos <= size[doc] - n) | (pos == 0)
    count = np.bincount(doc[keep], minlength=len(size))
    return acc[keep], np.concatenate([[0], np.cumsum(count)])


def word_counts(texts: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Words of each text, without hashing; 0 for null."""
    out = []
    for _, t in chunks(texts):
        raw, off = buffer(pc.utf8_lower(t))
        start, _ = word_runs(raw, off)
        out.append(np.diff(np.searchsorted(start, off)))
    return np.concatenate(out) if out else np.zeros(0, np.int64)
