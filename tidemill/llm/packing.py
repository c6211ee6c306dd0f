"""Best-two-fit packing of documents into sequences of `capacity` tokens.

Tokens are ids of the byte-level BPE whose vocabulary file is named by a parameter, so a sequence of 2048 fits a model with that vocabulary and context; tokenizer=None counts words in their place.

A bin is filled greedily with the longest piece that fits. If a gap is left, its smallest piece gives way to the two unpacked
pieces that together fill the gap and its place most, if they are longer than it. Longer texts are cut into full sequences and
a rest, which is packed. Shards hold about shard_rows documents by the hash of their id, however many there are; only ids and lengths are shuffled.

Defined results: rows without tokens (null or empty texts) are in no bin; repeated rows and null ids are packed like other rows;
ties take the smallest id; other columns are ignored; an empty table gives no bins.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repair, store, text


def _pair(mask: int, count: dict[int, list], room: int, more_than: int) -> tuple[int, int] | None:
    """The two unpacked lengths with the largest sum in (more_than, room]."""
    best, found = more_than, None
    a = (mask & ((1 << room) - 1)).bit_length() - 1  # leaves at least 1 for the other
    while a > 0 and 2 * a > best:
        low = mask & ((1 << min(a, room - a) + 1) - 1)
        b = low.bit_length() - 1
        if b == a and len(count[a]) < 2:
            b = (low & ~(1 << a)).bit_length() - 1
        if b > 0 and a + b > best:
            best, found = a + b, (a, b)
            if best == room:
                break
        a = (mask & ((1 << a) - 1)).bit_length() - 1
    return found


def best_two_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of positions into lengths, each of which is in 1..capacity."""
    count: dict[int, list[int]] = defaultdict(list)
    for k in range(len(lengths) - 1, -1, -1):
        count[lengths[k]].append(k)
    mask = sum(1 << n for n in count)
    bins = []

    def take(n: int) -> int:
        nonlocal mask
        k = count[n].pop()
        if not count[n]:
            mask &= ~(1 << n)
        return k

    while mask:
        gap, inside = capacity, []
        while gap and (n := (mask & ((1 << gap + 1) - 1)).bit_length() - 1) > 0:
            inside.append(take(n))
            gap -= n
        if gap and mask and len(inside) > 1:
            least = lengths[inside[-1]]
            if two := _pair(mask, count, gap + least, least):
                back = inside.pop()
                inside += [take(two[0]), take(two[1])]
                count[least].append(back)
                mask |= 1 << least
        bins.append(inside)
    return bins


def _pack(capacity: int):
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("doc_id", "ascending"), ("tokens", "ascending")])
        ids, size = t.column("doc_id").to_pylist(), np.asarray(t.column("tokens"))
        who, start, length = [], [], []
        whole = []
        for k in np.flatnonzero(size):
            full, rest = divmod(int(size[k]), capacity)
            whole += [([ids[k]], [i * capacity], [capacity]) for i in range(full)]
            if rest:
                who.append(ids[k])
                start.append(full * capacity)
                length.append(rest)
        bins = whole + [([who[k] for k in b], [start[k] for k in b], [length[k] for k in b]) for b in best_two_fit(length, capacity)]
        shard = t.column("shard")[0].as_py()
        return pa.table({"shard": pa.array([shard] * len(bins), pa.int64()), "bin": pa.array(range(len(bins)), pa.int64()), "doc_ids": pa.array([b[0] for b in bins], pa.list_(pa.int64())), "starts": pa.array([b[1] for b in bins], pa.list_(pa.int64())), "lengths": pa.array([b[2] for b in bins], pa.list_(pa.int64())), "used": pa.array([sum(b[2]) for b in bins], pa.int64())})

    return run


def token_counts(docs: DataFrame, id_col: str, text_col: str, tokenizer: str | None) -> DataFrame:
    """(doc_id, tokens) of each row, 0 for null; words where tokenizer is None. The driver reads the vocabulary, so executors need no file."""
    vocabulary = None
    if tokenizer is not None:
        with open(tokenizer, "rb") as f:
            vocabulary = f.read()

    def run(batches):
        coder = None if vocabulary is None else repair.encoding(vocabulary)
        for b in batches:
            if coder is None:
                n = text.word_counts(b.column(1))
            else:
                n = [len(coder.encode_ordinary(t)) for _, part in text.chunks(b.column(1)) for t in part.to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], ["doc_id", "tokens"])

    store.small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(text.tidied(run), "doc_id long, tokens long")


def pack(docs: DataFrame, capacity: int = 2048, shard_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = repair.TOKENIZER) -> DataFrame:
    """(shard, bin, doc_ids, starts, lengths, used): the pieces of each sequence, as token ranges of documents."""
    shards = max(1, -(-docs.count() // shard_rows))
    rows = token_counts(docs, id_col, text_col, tokenizer)
    shard = F.pmod(F.xxhash64("doc_id", "tokens"), F.lit(shards)).alias("shard")
    return rows.filter("tokens > 0").select("doc_id", "tokens", shard).groupBy("shard").applyInArrow(_pack(capacity), "shard long, bin long, doc_ids array<long>, starts array<long>, lengths array<long>, used long")
