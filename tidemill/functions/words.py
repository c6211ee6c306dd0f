"""Words and marks of whole batches, as arrays over code points: a pass of numpy in place of an array of strings a text."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

WORD, LETTER, SPACE, ASCII_MARK = 1, 2, 4, 8
CHUNK_CHARS = 1 << 18  # memory a pass, not a bound on any text
_U = np.uint64


def _kind(c: str) -> int:
    k = unicodedata.category(c)[0]
    if k in "LMN" or c == "_":
        return WORD | (LETTER if k == "L" else 0) | (ASCII_MARK if c == "_" else 0)
    return SPACE if c in " \t\n\x0b\f\r" else ASCII_MARK if "!" <= c <= "~" else 0


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """The kind of each code point below 65536."""
    return np.array([_kind(chr(i)) for i in range(1 << 16)], np.uint8)


def _kinds_of(points: np.ndarray) -> np.ndarray:
    out = _kinds()[points & 0xFFFF]
    far = np.flatnonzero(points > 0xFFFF)
    if len(far):
        unlike, which = np.unique(points[far], return_inverse=True)
        out[far] = np.array([_kind(chr(c)) for c in unlike.tolist()], np.uint8)[which]
    return out


def chunks(texts: pa.Array):
    """(code points, first of each text and the end) for slices of whole texts; null is empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    size = np.asarray(pc.utf8_length(texts)).astype(np.int64)
    ends, a = np.cumsum(size), 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + CHUNK_CHARS, "right")))
        yield np.frombuffer("".join(texts.slice(a, b - a).to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32), np.concatenate([[0], np.cumsum(size[a:b])])
        a = b


def tokens(points: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, kinds of the characters, whether a word) of the words and single marks; none crosses a text."""
    kind = _kinds_of(points)
    word, mark = (kind & WORD) > 0, (kind & (WORD | SPACE)) == 0
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    cut = off[1:-1]
    cut = cut[(cut > 0) & (cut < len(points))]
    first[cut], last[cut - 1] = word[cut], word[cut - 1]
    start, end = np.flatnonzero(first | mark), np.flatnonzero(last | mark) + 1
    return start, end, kind, word[start]


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[at[1:]] - total[at[:-1]]


def word_stats(stop_words: tuple[str, ...]):
    """A struct column of words (ASCII marks are none), their characters, words and marks with a letter, and stop words, of a text column."""
    assert all(1 <= len(w) <= 4 and w.isascii() for w in stop_words)
    packed = np.array(sorted(sum(ord(c) << 8 * i for i, c in enumerate(w)) for w in stop_words), np.uint32)

    def run(texts: pa.Array) -> pa.Array:
        parts = [np.zeros((0, 4), np.int64)]
        for points, off in chunks(texts):
            start, end, kind, word = tokens(points, off)
            size = end - start
            at = np.searchsorted(start, off)
            lone = (size == 1) & ((kind[start] & ASCII_MARK) > 0)
            letters = np.concatenate([[0], np.cumsum((kind & LETTER) > 0)])
            short = np.flatnonzero(word & (size <= 4))
            code = np.zeros(len(short), np.uint32)
            plain = np.ones(len(short), bool)
            for i in range(4):
                here = size[short] > i
                c = points[np.minimum(start[short] + i, max(len(points) - 1, 0))] if len(points) else np.zeros(0, np.uint32)
                plain &= ~here | (c < 128)
                code |= np.where(here, c << np.uint32(8 * i), 0).astype(np.uint32)
            stop = np.zeros(len(start), np.int64)
            stop[short] = plain & np.isin(code, packed)
            parts.append(np.column_stack([_sums(~lone, at), _sums(size * ~lone, at), _sums(letters[end] > letters[start], at), _sums(stop, at)]))
        got = np.concatenate(parts)
        return pa.StructArray.from_arrays([pa.array(got[:, k]) for k in range(4)], ["n", "chars", "letters", "stops"])

    return lambda c: F.arrow_udf(run, "n long, chars long, letters long, stops long").asNondeterministic()(c.cast("string"))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0x7FB5D329728EA185)
    x = (x ^ (x >> _U(27))) * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


def token_hashes(points: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each token's characters: sums of mixed (character, place in the token)."""
    if not len(start):
        return np.zeros(0, _U)
    inside = np.repeat(np.arange(len(start)), end - start)
    place = np.arange(len(inside)) - np.repeat(np.cumsum(end - start) - (end - start), end - start)
    mixed = _mix(points[start[inside] + place].astype(_U) * _U(0x9E3779B97F4A7C15) + place.astype(_U) * _U(0xC2B2AE3D27D4EB4F) + _U(1))
    total = np.concatenate([np.zeros(1, _U), np.cumsum(mixed, dtype=_U)])
    at = np.concatenate([[0], np.cumsum(end - start)])
    return _mix(total[at[1:]] - total[at[:-1]])


def _grams(h: np.ndarray, most: int):
    """(n, hashes of the n-grams of h) for n from 1 to most: one step each, from those before."""
    acc = np.zeros(len(h), _U)
    for n in range(1, most + 1):
        acc = _mix(acc[: max(0, len(h) - n + 1)] * _U(0xD6E8FEB86659FD93) + h[n - 1 :])
        yield n, acc


def _greedy(grams: np.ndarray, n: int, upto: np.ndarray) -> int:
    """Characters in n-grams seen before, from left to right, jumping over each hit. Grams that occur once are passed over."""
    order = np.argsort(grams, kind="stable")
    ranked = grams[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(grams), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    at = np.flatnonzero(twice)
    seen, chars, i = set(), 0, 0
    for p, g in zip(at.tolist(), grams[at].tolist()):
        if p >= i:
            if g in seen:
                chars += int(upto[p + n] - upto[p])
                i = p + n
            else:
                seen.add(g)
    return chars


def repetitions(h: np.ndarray, size: np.ndarray, at: np.ndarray, top: tuple[int, ...], again: tuple[int, ...]) -> np.ndarray:
    """repetition() of many texts, a row each: the tokens of text k are those from at[k] to at[k + 1]. Grams of all texts are made and sorted together."""
    texts = len(at) - 1
    out = np.zeros((texts, len(top) + len(again)), np.int64)
    text = np.repeat(np.arange(texts), np.diff(at))
    upto = np.concatenate([[0], np.cumsum(size)])
    left = None  # texts with a repeated gram: a repeated gram has a repeated shorter one
    for n, g in _grams(h, max(top + again, default=0)):
        if n in top or (n in again and left is None):
            inside = np.flatnonzero(text[: len(g)] == text[n - 1 :])
            order = inside[np.lexsort((g[inside], text[inside]))]
            first = np.ones(len(order), bool)
            first[1:] = (g[order[1:]] != g[order[:-1]]) | (text[order[1:]] != text[order[:-1]])
            begin = np.flatnonzero(first)
            count, place = np.diff(np.append(begin, len(order))), order[begin]
            own, start = np.unique(text[place], return_index=True)
        if n in top and len(begin):
            most = np.maximum.reduceat(count, start)
            tied = count == np.repeat(most, np.diff(np.append(start, len(count))))
            k = np.minimum.reduceat(np.where(tied, place, len(h)), start)
            out[own, top.index(n)] = (upto[k + n] - upto[k] + n - 1) * most
        if n in again:
            left = np.unique(text[place[count > 1]]) if left is None else left
            for t in left.tolist():
                a, b = int(at[t]), int(at[t + 1])
                out[t, len(top) + again.index(n)] = _greedy(g[a : max(a, b - n + 1)], n, upto[a : b + 1])
            left = left[out[left, len(top) + again.index(n)] > 0]
    return out


def repetition(h: np.ndarray, size: np.ndarray, top: tuple[int, ...], again: tuple[int, ...]) -> list[int]:
    """Of a text's tokens: the characters of all occurrences of the commonest n-gram (of equally common ones the first) for each of top, spaces between words counted; then those in repeated n-grams for each of again."""
    return repetitions(h, size, np.array([0, len(h)]), tuple(top), tuple(again))[0].tolist()


def repetition_shares(top: tuple[int, ...], again: tuple[int, ...]):
    """An array column of the shares of a text that repetition() counts."""
    assert list(again) == sorted(again)

    def run(texts: pa.Array) -> pa.Array:
        rows = []
        for points, off in chunks(texts):
            start, end, _, _ = tokens(points, off)
            found = repetitions(token_hashes(points, start, end), end - start, np.searchsorted(start, off), top, again)
            rows.append(found / np.maximum(np.diff(off), 1)[:, None])
        flat = np.concatenate([np.zeros((0, len(top) + len(again))), *rows])
        return pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1]), pa.array(flat.ravel()))

    return lambda c: F.arrow_udf(run, "array<double>").asNondeterministic()(c.cast("string"))
