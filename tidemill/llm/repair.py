"""Token ids as binary shards, compressed by Re-Pair grammars.

Documents are tokenised with a byte-level BPE whose vocabulary file is named by a parameter; by the default pattern each different word of a shard is encoded once. Within a shard (about shard_bytes of text) frequent
pairs of neighbouring ids are replaced by nonterminals again and again, until no pair is found min_count times. A round replaces all pairs that are found at least `ratio` times as often as
the most frequent one, so that hundreds of rounds do what a round for each pair would; where two of them overlap the more frequent one (of equal ones the smaller pair of ids), then the left one, wins. At the end
rules that are used once in the text are taken back. Pairs never cross documents. A shard's rules and their expansion lengths are
stored beside its documents, so that any range of tokens is decoded by walking only the symbols that cover it.

Rows: kind 'rules' (symbols: int32 left, right of each rule; lengths: int32) and kind 'doc' (symbols: int32; n_tokens). Nonterminal k is vocabulary + k.

Defined results: a null text gives a row with null n_tokens and symbols, an empty one 0 tokens; null and repeated ids are rows like others; extra columns are
ignored; an empty table gives no rows; special tokens' strings are ordinary text.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
SCHEMA = "shard long, kind string, doc_id long, n_tokens long, symbols binary, lengths binary"


def encoding(vocabulary: bytes, pattern: str = PATTERN):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


#: Kinds of bytes: 1 letter, 2 digit, 3 mark, 4 apostrophe, 5 space, 6 other white space; 0 control characters and all outside ASCII.
_KIND = np.zeros(256, np.uint8)
_KIND[0x21:0x7F], _KIND[ord("'")], _KIND[ord(" ")], _KIND[9:14] = 3, 4, 5, 6
_KIND[48:58], _KIND[65:91], _KIND[97:123] = 2, 1, 1
#: Pairs of kinds, as 8 * one + next, between which PATTERN always parts.
_PARTED = np.zeros(256, np.uint8)
_PARTED[[8 * a + b for a, b in [(1, 2), (1, 3), (1, 4), (2, 1), (2, 3), (2, 4), (3, 1), (3, 2)] + [(a, b) for a in (1, 2, 3, 4) for b in (5, 6)]]] = 1


def widths(coder) -> np.ndarray:
    """Bytes of each token."""
    out = np.zeros(coder.n_vocab, np.int64)
    for token in coder.token_byte_values():
        out[coder.encode_single_token(token)] = len(token)
    return out


def plain_ids(texts: pa.Array, coder) -> tuple[np.ndarray, np.ndarray]:
    """(ids, each text's first, plus the total), text by text."""
    ids = [np.array(coder.encode_ordinary(t), np.int32) for t in texts.to_pylist()]
    return np.concatenate([np.zeros(0, np.int32), *ids]), np.cumsum([0] + [len(x) for x in ids])


def token_ids(texts: pa.Array, coder, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What plain_ids gives by PATTERN, of a slice from text.chunks().

    Texts are cut where PATTERN parts them whatever is around: before a space that a visible ASCII character follows, and between kinds of ASCII.
    A unit's tokens don't hang on its neighbours, so each different one is encoded once, all of them in one call, unless most of the text is different ones."""
    raw, off = text.buffer(texts)
    size = len(raw)
    kind = np.frombuffer(raw.tobytes().translate(_KIND.tobytes()), np.uint8)
    cut = np.zeros(len(raw) + 1, bool)
    cut[1:-1] = np.frombuffer((kind[:-1] << 3 | kind[1:]).tobytes().translate(_PARTED.tobytes()), bool)
    cut[:-2] |= (kind[:-1] == 5) & (kind[1:] - np.uint8(1) < 4)
    cut[off] = True
    cut = np.flatnonzero(cut)
    units = pa.LargeStringArray.from_buffers(len(cut) - 1, pa.py_buffer(cut), pa.py_buffer(raw)).dictionary_encode()
    which, units = np.asarray(units.indices), units.dictionary
    raw, at = text.buffer(units)
    if 5 * len(raw) > 3 * size or not size:
        return plain_ids(texts, coder)
    one, two = _KIND[raw[at[:-1]]], _KIND[raw[np.minimum(at[:-1] + 1, len(raw) - 1)]]
    before = np.where((one == 5) & (np.diff(at) > 1) & (two > 0) & (two < 5), 0, np.where(one == 1, 1, 2))  # what makes a unit start with a space and a visible character
    alone = np.flatnonzero(one == 0)
    together = np.flatnonzero(one)
    before = before[together]
    lead = pa.array(["", " 0", " a"], pa.large_string()).take(pa.array(before))
    raw, at = text.buffer(pc.binary_join_element_wise(lead, units.take(pa.array(together)), pa.scalar("", pa.large_string())))
    ids = [np.array(coder.encode_ordinary(raw.tobytes().decode()), np.int32)]
    end = np.cumsum(width[ids[0]])
    start, stop = np.zeros(len(units), np.int64), np.zeros(len(units), np.int64)
    start[together] = np.searchsorted(end, at[:-1] + np.where(before, 2, 0), "right")
    stop[together] = np.searchsorted(end, at[1:], "right")
    ids += [np.array(coder.encode_ordinary(t), np.int32) for t in units.take(pa.array(alone)).to_pylist()]
    stop[alone] = np.cumsum([len(x) for x in ids])[1:]
    start[alone] = stop[alone] - [len(x) for x in ids[1:]]
    ids, many = np.concatenate(ids), (stop - start)[which]
    end = np.cumsum(many)
    place = np.repeat(start[which] - (end - many), many)
    place += np.arange(len(place))
    return ids[place], np.concatenate([[0], end])[np.searchsorted(cut, off)]


_SLOTS = 18  # bits of a pair's place in the table of counts


def _place(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    h = left.astype(np.uint32) * np.uint32(0x9E3779B1)
    h ^= right.astype(np.uint32) * np.uint32(0x85EBCA77)
    h *= np.uint32(0xC2B2AE3D)
    return h >> np.uint32(32 - _SLOTS)


def compress(s: np.ndarray, at: np.ndarray, first: int, min_count: int = 8, ratio: float = 0.3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, each document's first, rules as rows of left and right) of token ids s; nonterminals start at `first`."""
    s = s.astype(np.int32)
    sizes = np.diff(at)
    end = 1 << _SLOTS  # stands for the place of a document's last id
    h = np.full(len(s), end)
    h[:-1] = _place(s[:-1], s[1:])
    h[at[1:][sizes > 0] - 1] = end
    seen = np.bincount(h, minlength=end + 1)  # kept up to date from round to round, as h is
    rules, many, gaps, live = [np.zeros((0, 2), np.int64)], 0, len(s), None
    while len(s) > 1:
        if gaps > len(s) // 4:  # ids that go leave gaps for some rounds
            if many:
                s, h = s[there], h[there]
            live = None
            after, before, there, gaps = np.arange(1, len(s) + 1, dtype=np.int32), np.arange(-1, len(s), dtype=np.int32), np.ones(len(s), bool), 0
        seen[end] = 0
        least = max(min_count, int(seen.max() * ratio))
        while True:
            at_pair = np.flatnonzero((seen >= least).take(h)) if live is None else live[seen[h[live]] >= least]  # all that follows looks at pairs that may be frequent alone
            key = s[at_pair].astype(np.int64) << 32
            key |= s[after[at_pair]]
            found, count = np.unique(key, return_counts=True)
            found, count = found[count >= least], count[count >= least]
            if len(found) or least == min_count:
                break
            least = max(min_count, int(least * ratio))  # a place in the table was shared
        if not len(found):
            break
        found = found[np.lexsort((found, -count))]
        slot = _place(found >> 32, found & 0xFFFFFFFF)
        table = np.full(end + 1, -1, np.int32)
        table[slot[::-1]] = np.arange(len(found), dtype=np.int32)[::-1]  # of two pairs in a slot the commoner is done now
        rank = table[h[at_pair]]
        real = np.flatnonzero(rank >= 0)
        live = at_pair[real] if least == min_count else None  # from here on a pair is frequent only if it is so now or is new, as pairs lose places once they are there
        real = real[found[rank[real]] == key[real]]
        at_pair, rank = at_pair[real], rank[real]
        near = after[at_pair[:-1]] == at_pair[1:]
        left, right = np.full(len(rank), len(found)), np.full(len(rank), len(found))
        left[1:][near], right[:-1][near] = rank[:-1][near], rank[1:][near]
        place = np.arange(len(rank))
        start = np.maximum.accumulate(np.where(rank == left, 0, place))  # of a run of one pair: every other place is taken
        take = (rank[start] < left[start]) & (rank <= right) & ((place - start) % 2 == 0)
        hit, rank = at_pair[take], rank[take]
        used = np.bincount(rank, minlength=len(found)) > 0
        s[hit] = first + many + (np.cumsum(used) - 1)[rank]
        rules.append(np.column_stack([found[used] >> 32, found[used] & 0xFFFFFFFF]))
        many += len(rules[-1])
        gone, left = after[hit], before[hit]
        there[gone] = False
        gaps += len(gone)
        last, left = h[gone] == end, left[(left >= 0) & there[left] & (h[left] != end)]  # left: its neighbour is a new one
        seen -= np.bincount(np.concatenate([h[hit], h[gone], h[left]]), minlength=end + 1)
        after[hit] = after[gone]
        before[after[hit]] = hit
        h[hit[last]] = h[gone] = end
        new = np.concatenate([hit[~last], left])
        h[new] = _place(s[new], s[after[new]])
        live = None if live is None else np.union1d(live, new)
        seen += np.bincount(h[new], minlength=end + 1)
    if many:
        s, h = s[there], h[there]
    s, link, made = _pruned(s.astype(np.int64), h != end, np.concatenate(rules), first)
    left_in = np.zeros(len(sizes), np.int64)
    left_in[sizes > 0] = np.diff(np.concatenate([[-1], np.flatnonzero(~link)]))
    return s, np.concatenate([[0], np.cumsum(left_in)]), made


def _pruned(s: np.ndarray, link: np.ndarray, rules: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same without rules that are used once, where that one use is in the text or in another such rule."""
    sides = rules.ravel() - first
    used = np.bincount(s[s >= first] - first, minlength=len(rules)) + np.bincount(sides[sides >= 0], minlength=len(rules))
    user = np.full(len(rules), -1)
    user[sides[sides >= 0]] = np.flatnonzero(sides >= 0) // 2
    gone = np.zeros(len(rules), bool)
    for k in np.flatnonzero(used == 1)[::-1].tolist():  # a rule's users come after it
        gone[k] = user[k] < 0 or gone[user[k]]
    while len(hit := np.flatnonzero((s >= first) & np.concatenate([gone, [False]])[np.where(s >= first, s - first, -1)])):
        pair = rules[s[hit] - first]
        size = np.ones(len(s), np.int64)
        size[hit] = 2
        to = np.cumsum(size) - size
        out, joined = np.repeat(s, size), np.repeat(link, size)
        out[to[hit]], out[to[hit] + 1], joined[to[hit]] = pair[:, 0], pair[:, 1], True
        s, link = out, joined
    name = first + np.cumsum(~gone) - 1
    s[s >= first] = name[s[s >= first] - first]
    rules = rules[~gone]
    rules[rules >= first] = name[rules[rules >= first] - first]
    return s, link, rules


def expansion_lengths(rules: np.ndarray, first: int) -> np.ndarray:
    out = [0] * len(rules)
    for k, (a, b) in enumerate(rules.tolist()):
        out[k] = (out[a - first] if a >= first else 1) + (out[b - first] if b >= first else 1)
    return np.array(out, np.int64)


def decode(symbols: bytes, rules: bytes, lengths: bytes, first: int, start: int = 0, stop: int | None = None) -> list[int]:
    """Tokens start..stop of a document; symbols outside are skipped by their length."""
    s, r, n = np.frombuffer(symbols, np.int32), np.frombuffer(rules, np.int32).reshape(-1, 2), np.frombuffer(lengths, np.int32)
    size = np.ones(len(s), np.int64)
    size[s >= first] = n[s[s >= first] - first]
    ends = np.cumsum(size)
    stop = int(ends[-1]) if len(s) and stop is None else min(stop or 0, int(ends[-1]) if len(s) else 0)
    out: list[int] = []
    if start >= stop:
        return out
    i, j = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends, stop, "left"))
    at = int(ends[i] - size[i])
    stack = s[i : j + 1][::-1].tolist()
    while stack and at < stop:
        x = stack.pop()
        if x < first:
            if at >= start:
                out.append(x)
            at += 1
        elif at + n[x - first] <= start:
            at += int(n[x - first])
        else:
            a, b = r[x - first]
            stack += [int(b), int(a)]
    return out


def token_shards(docs: DataFrame, tokenizer: str = TOKENIZER, pattern: str = PATTERN, shard_bytes: int = 4 << 20, min_count: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The shards of docs as rows of rules and documents. The driver reads the vocabulary, so executors need no file."""
    with open(tokenizer, "rb") as f:
        vocabulary = f.read()

    def run(batches):
        coder = encoding(vocabulary, pattern)
        first, width = coder.n_vocab, widths(coder)
        shard = TaskContext.get().partitionId() << 32
        for b in batches:
            ids, there = b.column(0), b.column(1).is_valid().to_pylist()
            for a, part in text.chunks(b.column(1), shard_bytes):
                flat, at = token_ids(part, coder, width) if pattern == PATTERN else plain_ids(part, coder)
                size = np.diff(at)
                s, at, rules = compress(flat, at, first, min_count)
                s = s.astype("<i4")
                n, real = len(part), there[a : a + len(part)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([shard] * (n + 1), pa.int64()),
                        pa.array(["rules"] + ["doc"] * n),
                        pa.concat_arrays([pa.nulls(1, pa.int64()), ids.slice(a, n)]),
                        pa.array([None] + [int(k) if ok else None for k, ok in zip(size, real)], pa.int64()),
                        pa.array([rules.astype("<i4").tobytes()] + [s[at[k] : at[k + 1]].tobytes() if real[k] else None for k in range(n)], pa.binary()),
                        pa.array([expansion_lengths(rules, first).astype("<i4").tobytes()] + [None] * n, pa.binary()),
                    ],
                    ["shard", "kind", "doc_id", "n_tokens", "symbols", "lengths"],
                )
                shard += 1

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(text.tidied(run), SCHEMA)
