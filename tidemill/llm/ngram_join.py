"""N-gram Jaccard join by parity sketches.

Each document is its set of word n-grams. Documents with equal sets form one class, so that groups
of copies cost one row. The smallest class member stands for it.

Sketch: an n-gram flips one 64-bit pattern in one of PARTS words (exclusive or), so two sketches differ in
at most as many words as the symmetric difference has members. Sets larger than `sample` are sketched
over the n-grams with the smallest hashes, at a rate set by the size band (powers of two), so that a
sketch has the same length at every size. Classes meet if any word of their sketches, within a band that
both belong to, is equal: up to PARTS - 1 differences this can't fail (pigeonhole) but where all equal words are empty, so
small sets have their n-grams as words too, and no pair with one of up to SMALL can fail; beyond, chance leaves a word
alone with a probability that tests measure (above 0.97 of all pairs at the threshold, nearly all above it).
A class also joins the next band if a partner within the threshold could lie there.

A word shared by more than `hot` classes is dealt out in blocks of classes, and each two blocks meet in a task of their own, so that no group is held
whole; there the bit sketches are compared and only pairs that pass are kept. Rows of a hot word stream through, none is left out.
Candidates whose bit sketches (one bit flipped for each n-gram) differ in more bits than the threshold allows are dropped:
exactly so for unsampled sets, and by four standard deviations of the sampled difference for others.
All the rest are verified on the full n-gram sets. A task that verifies gives each class's links and its group within the task, not the pairs,
so that what follows grows with the documents even where near copies are many.

Defined results: null or wordless texts link with nothing and are classes by themselves; rows without an id are left out; a text of fewer than n words is one gram;
repeated rows count once; an id with several texts is one document with the links of all of them; other columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store, text, tiles

PARTS = 32
BITS = 8  # 64-bit words of the bit sketch
SMALL = 8
_U = np.uint64


def _sets(texts: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct n-gram hashes) of the rows that have words."""
    for a, t in text.chunks(texts):
        g, at = text.ngrams(*text.words(t), n)
        for k in np.flatnonzero(np.diff(at)):
            s = np.sort(g[at[k] : at[k + 1]])
            yield a + int(k), s[np.concatenate([[True], s[1:] != s[:-1]])]


def class_of(s: np.ndarray) -> int:
    """The name of a set: a 64-bit hash of its members."""
    return int((text.mix(s).sum(dtype=_U) ^ _U(len(s) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)).astype(np.int64))


def bands(size: int, sample: int, threshold: float) -> list[int]:
    """Band j holds sets of up to sample * 2^j; a set also belongs to the next if a larger partner may."""
    j = max(0, int(np.ceil(np.log2(size / sample) - 1e-12)))
    return [j, j + 1] if size / threshold > sample * 2**j else [j]


def sketch(s: np.ndarray, j: int) -> np.ndarray:
    """The sketch's words for band j as join keys; words without an n-gram are left out."""
    rate = (1 << 64) >> j
    part = s[: np.searchsorted(s, _U(rate - 1), "right")]
    where = (text.mix(part ^ _U(0xA5A5A5A5A5A5A5A5)) >> _U(59)).astype(np.int64)
    word = np.zeros(PARTS, _U)
    load = np.bincount(where, minlength=PARTS)
    order = np.argsort(where, kind="stable")
    full = np.flatnonzero(load)
    if len(full):
        word[full] = np.bitwise_xor.reduceat(part[order], (np.cumsum(load) - load)[full])
    return text.mix(word[full] + (full.astype(_U) * _U(64) + _U(j + 1)) * _U(0xC2B2AE3D27D4EB4F)).astype(np.int64)


def bit_sketch(s: np.ndarray, j: int) -> np.ndarray:
    """The parity of the n-grams in each of 64 * BITS places, over the same sample as sketch()."""
    part = text.mix(s[: np.searchsorted(s, _U(((1 << 64) >> j) - 1), "right")] ^ _U(0x5851F42D4C957F2D))
    odd = np.bincount((part >> _U(55)).astype(np.int64), minlength=64 * BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    at = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64)))


def _signatures(n: int, threshold: float, sample: int):
    """(doc_id, cls, size) of all rows, and the sketches of the first row of each class in a batch, so that copies don't carry theirs along."""

    def run(batches):
        for b in batches:
            cls, size, band = np.zeros(len(b), np.int64), np.zeros(len(b), np.int32), np.zeros(len(b), np.int32)
            full, keys, bits, seen = np.zeros(len(b), bool), [], [], set()
            for k, s in _sets(b.column(1), n):
                cls[k], size[k] = c, _ = class_of(s), len(s)
                js = bands(len(s), sample, threshold)
                band[k] = js[0]
                if c in seen:
                    continue
                seen.add(c)
                full[k] = True
                grams = [text.mix(s ^ _U(0x2545F4914F6CDD1D)).astype(np.int64)] if len(s) * threshold <= SMALL else []
                keys.append(np.concatenate([sketch(s, j) for j in js] + grams))
                bits.append(np.concatenate([bit_sketch(s, j) for j in js]))
            at = pa.array(np.where(full, np.cumsum(full) - 1, 0), mask=~full)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cls, mask=size == 0), pa.array(size), pa.array(band), _lists(keys).take(at), _lists(bits).take(at)], ["doc_id", "cls", "size", "band", "keys", "bits"])

    return text.tidied(run)


def _pairs(a: np.ndarray, size: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of a group whose sizes allow the threshold."""
    x, y = np.triu_indices(len(a), 1)
    ok = np.minimum(size[x], size[y]) >= threshold * np.maximum(size[x], size[y]) - 1e-9
    return a[x[ok]], a[y[ok]]


def _meet(threshold: float, hot: int, block: int):
    """Rows (key, cls, size) sorted by key and cls: pairs (x, y) of each group of up to hot classes; the rows of larger ones as (x: key, y: cls, size, label: smallest class, block)."""
    names, types = ["x", "y", "size", "label", "block"], [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32()]

    def pack(columns):
        for i in range(0, len(columns[0]), 1 << 17):
            part = [c[i : i + (1 << 17)] for c in columns]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(part, types)] + [pa.nulls(len(part[0]), t) for t in types[len(part) :]], names)

    def run(batches):
        none = np.zeros(0, np.int64)
        rest, open_hot = (none, none, none), None  # open_hot: (key, label, rows so far, last class) of a hot group that may go on

        def dealt(key, cls, size, label, before):
            return pack([key, cls, size, np.full(len(key), label), (before + np.arange(len(key))) // block])

        def out(rows, last):
            nonlocal rest, open_hot
            key, cls, size = (np.concatenate(p) for p in zip(rest, rows))
            rest = (none, none, none)
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])
            if open_hot and len(key):
                new[0] = (key[0], cls[0]) != (open_hot[0], open_hot[3])
            key, cls, size = key[new], cls[new], size[new]
            if open_hot and len(key):
                m = int(np.argmax(key != open_hot[0])) if key[-1] != open_hot[0] else len(key)
                yield from dealt(key[:m], cls[:m], size[:m], open_hot[1], open_hot[2])
                open_hot = (*open_hot[:2], open_hot[2] + m, cls[m - 1] if m else open_hot[3]) if m == len(key) else None
                key, cls, size = key[m:], cls[m:], size[m:]
            if not len(key):
                return
            edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
            if not last:  # the last group may go on in the next batch
                a = edge[-2]
                if len(key) - a > hot:
                    yield from dealt(key[a:], cls[a:], size[a:], cls[a], 0)
                    open_hot = (key[a], cls[a], len(key) - a, cls[-1])
                else:
                    rest = (key[a:], cls[a:], size[a:])
                edge = edge[:-1]
            n = np.diff(edge)
            two = edge[:-1][n == 2]
            ok = np.minimum(size[two], size[two + 1]) >= threshold * np.maximum(size[two], size[two + 1]) - 1e-9
            x, y = [cls[two][ok]], [cls[two + 1][ok]]
            for i, m in zip(edge[:-1][n > 2].tolist(), n[n > 2].tolist()):
                if m > hot:
                    yield from dealt(key[i : i + m], cls[i : i + m], size[i : i + m], cls[i], 0)
                    continue
                for v, w in zip((x, y), _pairs(cls[i : i + m], size[i : i + m], threshold)):
                    v.append(w)
                if len(x) > 4096:
                    yield from pack([np.concatenate(x), np.concatenate(y)])
                    x, y = [], []
            if x:
                yield from pack([np.concatenate(x), np.concatenate(y)])

        for b in batches:
            yield from out([np.asarray(c).astype(np.int64) for c in b.columns[:3]], False)
        yield from out((none, none, none), True)

    return text.tidied(run)


def _near(cls: np.ndarray, size: np.ndarray, band: np.ndarray, bits: np.ndarray, threshold: float, side: np.ndarray | None = None) -> Iterator[np.ndarray]:
    """Pieces of the pairs of a group that sizes and bit sketches allow, by the rule of _alike; bits has the sketches of a class's one or two bands. With side, pairs of unlike sides alone."""
    for p in np.unique(band):
        for q in (p, p + 1):
            x, y = np.flatnonzero(band == p), np.flatnonzero(band == q)
            step = max(1, (1 << 18) // max(1, len(y)))
            for i in range(0, len(x) if len(y) else 0, step):
                r = x[i : i + step]
                ok = np.minimum(size[r][:, None], size[y]) >= threshold * np.maximum(size[r][:, None], size[y]) - 1e-9
                if p == q:
                    ok &= r[:, None] < y
                if side is not None:
                    ok &= side[r][:, None] != side[y]
                j, k = np.nonzero(ok)
                j, k = r[j], y[k]
                apart = np.bitwise_count(bits[j, q - p] ^ bits[k, 0]).sum(1, dtype=np.int64)
                most = (1 - threshold) / (1 + threshold) * (size[j] + size[k]) * 0.5**q
                ok = apart <= most + 4 * np.sqrt(most * (1 - 0.5**q)) + 1e-6
                a, b = cls[j[ok]], cls[k[ok]]
                yield np.column_stack([np.minimum(a, b), np.maximum(a, b)])


def _meet_hot(threshold: float):
    """Rows (label, p, q, key, cls, size, band, block, bits) sorted so: the pairs of each two blocks p, q of a label that may be alike, about once, though classes meet in many words."""

    def run(batches):
        rest, at, todo, held = None, None, [], 0

        def give(done: list[np.ndarray]):
            if done:
                both = np.concatenate(done)
                both = both[np.lexsort((both[:, 1], both[:, 0]))]
                both = both[np.concatenate([[True], (both[1:] != both[:-1]).any(1)])[: len(both)]]
                for i in range(0, len(both), 1 << 17):
                    part = both[i : i + (1 << 17)]
                    yield pa.RecordBatch.from_arrays([pa.array(part[:, 0]), pa.array(part[:, 1])], ["x", "y"])

        def out(rows, last):
            nonlocal rest, at, todo, held
            rows = rows if rest is None else rest if rows is None else [np.concatenate(p) for p in zip(rest, rows)]
            if rows is not None and len(rows[0]):
                head, (key, cls, size, band, block, bits) = np.column_stack(rows[:3]), rows[3:]
                edge = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (head[1:] != head[:-1]).any(1), [True]]))
                if not last:
                    rest = [v[edge[-2] :] for v in rows]
                    edge = edge[:-1]
                for i, j in zip(edge[:-1], edge[1:]):
                    if at is None or (head[i] != at).any():
                        yield from give(todo)
                        at, todo, held = head[i], [], 0
                    _, p, q = head[i]
                    for pairs in _near(cls[i:j], size[i:j], band[i:j], bits[i:j], threshold, None if p == q else block[i:j]):
                        todo.append(pairs)
                        held += len(pairs)
                        if held > 1 << 21:
                            yield from give(todo)
                            todo, held = [], 0
            if last:
                yield from give(todo)

        for b in batches:
            n = np.asarray(b.column(8).value_lengths()).astype(np.int64)
            bits = np.zeros((len(n), 2 * BITS), _U)
            bits[np.arange(2 * BITS) < n[:, None]] = np.asarray(b.column(8).flatten()).view(_U)
            yield from out([*(np.asarray(c).astype(np.int64) for c in b.columns[:8]), bits.reshape(-1, 2, BITS)], False)
        yield from out(None, True)

    return text.tidied(run)


def _alike(pairs: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose bit sketches allow the threshold."""
    side = lambda v: reps.select(F.col("cls").alias(v), *[F.col(c).alias(f"{c}_{v}") for c in ("size", "band", "bits")])
    both = pairs.join(side("x"), "x").join(side("y"), "y").withColumn("at", F.greatest("band_x", "band_y"))
    bit = lambda v, i: F.get(F.col(f"bits_{v}"), (F.col("at") - F.col(f"band_{v}")) * BITS + i)
    apart = sum((F.bit_count(bit("x", i).bitwiseXOR(bit("y", i))) for i in range(BITS)), F.lit(0))
    rate = F.pow(F.lit(0.5), F.col("at"))
    most = (1 - threshold) / (1 + threshold) * (F.col("size_x") + F.col("size_y")) * rate
    return both.filter(apart <= most + 4 * F.sqrt(most * (1 - rate)) + 1e-6).select("x", "y")


def _verified(pairs: pa.Table, sets: pa.Table, threshold: float) -> Iterator[tuple[int, int, int]]:
    """(row of x in sets, row of y, shared n-grams) of the pairs that reach the threshold."""
    flat = sets.column("grams").combine_chunks()
    flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
    at, values = np.asarray(flat.offsets), np.asarray(flat.values).view(_U)
    where = {c: i for i, c in enumerate(sets.column("cls").to_pylist())}
    for x, y in zip(pairs.column("x").to_pylist(), pairs.column("y").to_pylist()):
        i, j = where.get(x), where.get(y)
        if i is None or j is None:
            continue
        s, t = values[at[i] : at[i + 1]], values[at[j] : at[j + 1]]
        both = np.concatenate([s, t])
        both.sort()
        m = int(np.count_nonzero(both[1:] == both[:-1]))
        if m >= threshold * (len(s) + len(t) - m) - 1e-9:
            yield i, j, m


def _linked(threshold: float):
    """(doc, root, links) of each class of a tile that has links."""

    def run(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        return tiles.gathered(sets.column("rep").to_pylist(), sets.column("n").to_pylist(), ((i, j) for i, j, _ in _verified(pairs, sets, threshold)))

    return run


def _paired(threshold: float):
    """(doc_a, doc_b, shared, size_a, size_b) of the pairs of a tile."""

    def run(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        rep, size = sets.column("rep").to_pylist(), np.diff(np.asarray(sets.column("grams").combine_chunks().offsets)).tolist()
        got = [(i, j, m) if rep[i] < rep[j] else (j, i, m) for i, j, m in _verified(pairs, sets, threshold) if rep[i] != rep[j]]
        columns = zip(*((rep[i], rep[j], m, size[i], size[j]) for i, j, m in got)) if got else [()] * 5
        return pa.table({k: pa.array(c, pa.int64() if k[0] == "d" else pa.int32()) for k, c in zip(("doc_a", "doc_b", "shared", "size_a", "size_b"), columns)})

    return run


def _gram_sets(n: int):
    def run(batches):
        for b in batches:
            rows, cls, sets, held = [], [], [], 0
            for k, s in _sets(b.column(1), n):
                rows.append(k)
                cls.append(class_of(s))
                sets.append(s.view(np.int64))
                held += len(s)
                if held > 1 << 18:
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(cls, pa.int64()), _lists(sets)], ["doc_id", "cls", "grams"])
                    rows, cls, sets, held = [], [], [], 0
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(cls, pa.int64()), _lists(sets)], ["doc_id", "cls", "grams"])

    return text.tidied(run)


class _Join:
    """The candidate pairs of docs, placed in tiles with the sets that verify them."""

    def __init__(self, docs: DataFrame, n: int, threshold: float, sample: int, hot: int, id_col: str, text_col: str, broadcast_rows: int, block: int, tile_pairs: int):
        spark = docs.sparkSession
        store.small_batches(spark)
        parts = store.partitions(spark)
        self.threshold = threshold
        rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter("doc_id is not null")
        sig = store.materialise(rows.mapInArrow(_signatures(n, threshold, sample), "doc_id long, cls long, size int, band int, keys array<long>, bits array<long>"), "signatures")
        self.documents = store.materialise(sig.select("doc_id", "cls", "size").distinct(), "documents")
        self.classes = store.materialise(self.documents.filter("cls is not null").groupBy("cls", "size").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "classes")
        bearers = sig.filter("keys is not null")
        one = bearers.groupBy("cls").agg(F.min("doc_id").alias("doc_id"))
        reps = store.materialise(bearers.join(one, ["cls", "doc_id"], "left_semi").select("cls", "size", "band", "keys", "bits"), "sketches")
        store.discard(sig)
        words = reps.select(F.explode("keys").alias("key"), "cls", "size").repartition(parts, "key").sortWithinPartitions("key", "cls")
        met = store.materialise(words.mapInArrow(_meet(threshold, hot, block), "x long, y long, size int, label long, block int"), "met")
        side = reps.select("cls", "size", "band", "bits").dropDuplicates(["cls", "size", "band"])
        warm = met.filter("label is not null").select("label", F.col("x").alias("key"), F.col("y").alias("cls"), "block")
        blocks = warm.groupBy("label", "key").agg(F.max("block").alias("last"))
        dealt = warm.join(blocks, ["label", "key"]).withColumn("other", F.explode(F.sequence(F.lit(0), "last")))
        dealt = dealt.join(side, "cls").select("label", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "key", "cls", "size", "band", "block", "bits")
        again = dealt.repartition(parts, "label", "p", "q").sortWithinPartitions("label", "p", "q", "key", "cls")
        cold = _alike(met.filter("label is null").select("x", "y").distinct(), side, threshold)
        pairs = store.materialise(cold.unionByName(again.mapInArrow(_meet_hot(threshold), "x long, y long")).distinct(), "pairs")
        store.discard(met, reps)

        self.placed = tiles.place(pairs, tile_pairs)
        store.discard(pairs)
        wanted = tiles.wanted(self.placed)
        wanted = wanted.join(self.classes.select("cls", "rep", "n"), "cls")
        asked = store.materialise(wanted.select(F.col("rep").alias("doc_id")).distinct(), "asked")
        few = asked.count() <= broadcast_rows
        texts = rows.join(F.broadcast(asked) if few else asked, "doc_id", "left_semi").select("doc_id", "text").filter("text is not null")
        grams = texts.mapInArrow(_gram_sets(n), "doc_id long, cls long, grams array<long>")
        self.sets = grams.join(wanted, "cls").filter("doc_id = rep").select("cls", "at", "rep", "n", "grams")

    def give(self, function, schema: str) -> DataFrame:
        return self.placed.groupBy("tile").cogroup(self.sets.groupBy("at")).applyInArrow(function(self.threshold), schema)


def near_copies(docs: DataFrame, n: int = 3, threshold: float = 0.5, sample: int = 96, hot: int = 64, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = 1_000_000, block: int = 4096, tile_pairs: int = 1 << 15) -> DataFrame:
    """(doc_id, class_id, links) of each document: the smallest id of those it hangs together with by links, and how many others it links with.

    Two documents link if the Jaccard similarity of their n-gram sets is >= threshold. See the module for the method.
    """
    join = _Join(docs, n, threshold, sample, hot, id_col, text_col, broadcast_rows, block, tile_pairs)
    return tiles.classes(join.documents.select("doc_id", "cls"), join.classes, join.give(_linked, tiles.LINKED))


def ngram_jaccard_join(docs: DataFrame, n: int = 3, threshold: float = 0.5, sample: int = 96, hot: int = 64, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = 1_000_000, block: int = 4096, tile_pairs: int = 1 << 15, expand: bool = False) -> DataFrame:
    """Pairs (doc_a < doc_b, shared, size_a, size_b, jaccard) of Jaccard similarity >= threshold.

    Class representatives are paired with each other; any other member of a class of equal sets is paired with its representative. With expand all pairs of documents are given,
    whose number grows with the square of a class.
    """
    join = _Join(docs, n, threshold, sample, hot, id_col, text_col, broadcast_rows, block, tile_pairs)
    near = join.give(_paired, "doc_a long, doc_b long, shared int, size_a int, size_b int")
    members = join.documents.join(join.classes.select("cls", "rep"), "cls").filter("doc_id <> rep").select(F.col("rep").alias("doc_a"), F.col("doc_id").alias("doc_b"), "size")
    same = members.select("doc_a", "doc_b", F.col("size").alias("shared"), F.col("size").alias("size_a"), F.col("size").alias("size_b"))
    if expand:
        every = join.documents.join(join.classes.select("cls", "rep"), "cls").select("rep", "doc_id", "cls", "size")
        out = near.join(every.select(F.col("rep").alias("doc_a"), F.col("doc_id").alias("a")), "doc_a").join(every.select(F.col("rep").alias("doc_b"), F.col("doc_id").alias("b")), "doc_b")
        swap = F.col("a") > F.col("b")
        near = out.filter("a <> b").select(F.least("a", "b").alias("doc_a"), F.greatest("a", "b").alias("doc_b"), "shared", F.when(swap, F.col("size_b")).otherwise(F.col("size_a")).alias("size_a"), F.when(swap, F.col("size_a")).otherwise(F.col("size_b")).alias("size_b"))
        first, second = every.select("cls", "size", F.col("doc_id").alias("doc_a")), every.select("cls", F.col("doc_id").alias("doc_b"))
        same = first.join(second, "cls").filter("doc_a < doc_b").select("doc_a", "doc_b", F.col("size").alias("shared"), F.col("size").alias("size_a"), F.col("size").alias("size_b"))
    both = near.unionByName(same)
    return both.withColumn("jaccard", F.col("shared") / (F.col("size_a") + F.col("size_b") - F.col("shared")))


def one_of_each(docs: DataFrame, n: int = 3, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = 1_000_000) -> DataFrame:
    """docs without all but the smallest id of each group of near copies; rows with a null id or text stay."""
    name = store.free_name(docs, "__gone")
    groups = near_copies(docs, n, threshold, id_col=id_col, text_col=text_col)
    gone = store.materialise(groups.filter("doc_id <> class_id").select(F.col("doc_id").alias(name)), "gone")
    few = gone.count() <= broadcast_rows
    return docs.join(F.broadcast(gone) if few else gone, docs[id_col].cast("long") == gone[name], "left_anti")
