"""Near duplicates among embeddings by counting collisions of one-dimensional projections.

Unit vectors are projected on `projections` random directions, in whole steps of a sixteenth of the half-width w. Two vectors collide in a projection if one lies in the window of half-width w
centred on the other; w is the distance that belongs to the threshold. Pairs with at least `least` collisions are candidates; `least` is the largest count that a pair at the threshold
reaches with probability sqrt(recall) (binomial). Within a bucket vectors are sorted by their first projection, and a query looks only at the stretch of it that holds all
pairs of the threshold but one in two thousand. Candidates are verified by the cosine of the vectors themselves.

Windows of single projections pass a fixed share of all pairs, so counting alone is quadratic. Buckets keep it below: each of T tables splits vectors by the signs of k projections of
its own, with k from the number of vectors and T so that a pair at the threshold shares a bucket in some table with probability sqrt(recall) at least; the whole recall is
therefore at least `recall` at every size. A pair is counted in the first table that it shares a bucket in, so no pair comes twice. A bucket of more than two times bucket_rows vectors
(many near copies of one) is dealt out in blocks, each two of which meet in a task of their own; no group is held whole and there is no cap on partners.
Only ids, steps and signs are shuffled for this; vectors travel for verification, to the tiles of the candidates.

Equal embeddings are one class, for which the smallest id stands. A task that verifies gives links and groups, not pairs.

Defined results: rows without an id are left out; null, empty, zero or non-finite embeddings link with nothing and are classes by themselves; several rows of an id count once (the embedding with the smallest hash);
vectors of different lengths never link; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store, text, tiles

SEED = 1992
STEPS = 16
_U = np.uint64


def plan(count: int, threshold: float, projections: int, recall: float, bucket_rows: int) -> tuple[float, int, int, int]:
    """(half-width, least collisions, sign bits, tables)."""
    half = math.sqrt(max(2 - 2 * threshold, 1e-12))
    p = math.erf((1 - 1 / STEPS) / math.sqrt(2))  # the least, whatever the rounding to steps does
    tail, least, part = 1.0, 0, math.sqrt(recall)
    for k in range(projections):  # P(more than k collisions)
        tail -= math.comb(projections, k) * p**k * (1 - p) ** (projections - k)
        if tail < part:
            break
        least = k + 1
    bits = max(0, math.ceil(math.log2(max(count, 1) / bucket_rows)))
    same = (1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi) ** bits
    return half, least, bits, 1 if not bits else math.ceil(math.log(1 - part) / math.log(1 - same))


def _fit(a: pa.Array) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Whether each row has a usable vector; (rows, vectors as doubles) of each length."""
    size = np.asarray(a.value_lengths().fill_null(0)).astype(np.int64)
    at = np.concatenate([[0], np.cumsum(size)])
    flat = np.asarray(a.flatten().fill_null(np.nan), np.float64)
    ok, out = np.zeros(len(a), bool), []
    for d in np.unique(size[size > 0]):
        rows = np.flatnonzero(size == d)
        x = flat[at[rows][:, None] + np.arange(d)]
        good = np.isfinite(x).all(1) & (x != 0).any(1)
        ok[rows[good]] = True
        out.append((rows[good], x[good] + 0.0))  # no negative zeros
    return ok, out


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _class(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each vector."""
    odd = np.random.default_rng([SEED, 3, x.shape[1]]).integers(0, 1 << 63, x.shape[1], dtype=np.uint64) * _U(2) + _U(1)
    return text.mix((text.mix(x.view(_U)) * odd).sum(1, dtype=_U) + _U(x.shape[1])).astype(np.int64)


def _signs(x: np.ndarray, bits: int, tables: int) -> np.ndarray:
    if not bits:
        return np.zeros((len(x), 1), np.int64)
    signs = x @ np.random.default_rng([SEED, 1, x.shape[1]]).normal(size=(x.shape[1], bits * tables)) > 0
    return signs.reshape(len(x), tables, bits) @ (1 << np.arange(bits, dtype=np.int64))


def _steps(x: np.ndarray, projections: int, half: float) -> np.ndarray:
    at = x @ np.random.default_rng([SEED, 2, x.shape[1]]).normal(size=(x.shape[1], projections))
    return np.clip(np.round(at * (STEPS / half)), -30000, 30000).astype(np.int16)


def _fixed(x: np.ndarray) -> pa.Array:
    """Rows of fixed-size numbers as binary."""
    x = np.ascontiguousarray(x)
    width = x.shape[1] * x.itemsize
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer((np.arange(len(x) + 1, dtype=np.int32) * width)), pa.py_buffer(x)])


def _signatures(projections: int, half: float, bits: int, tables: int):
    """(id, cls, dims, steps, signs) of all rows; cls is null where there is no usable vector."""

    def run(batches):
        for b in batches:
            for i in range(0, len(b), 4096):
                part = b.slice(i, 4096)
                vectors = part.column(1)
                ok, groups = _fit(vectors)
                cls, dims = np.zeros(len(part), np.int64), np.zeros(len(part), np.int32)
                steps, signs = np.zeros((len(part), projections), np.int16), np.zeros((len(part), tables), np.int64)
                for rows, x in groups:
                    if len(rows):
                        cls[rows], dims[rows] = _class(x), x.shape[1]
                        x = _unit(x)
                        steps[rows], signs[rows] = _steps(x, projections, half), _signs(x, bits, tables)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(cls, mask=~ok), pa.array(dims), _fixed(steps), _fixed(signs)], ["id", "cls", "dims", "steps", "signs"])

    return text.tidied(run)


def _count(projections: int, least: int, tables: int):
    """Rows (cls, steps, signs, block) of one bucket, or of two of its blocks: pairs (x, y) with enough collisions."""

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        table, p, q = key[1].as_py(), key[3].as_py(), key[4].as_py()
        cls, block = np.asarray(t.column("cls")), np.asarray(t.column("block"))
        steps = np.frombuffer(b"".join(t.column("steps").to_pylist()), np.int16).reshape(-1, projections)
        signs = np.frombuffer(b"".join(t.column("signs").to_pylist()), np.int64).reshape(len(cls), -1)[:, :table]
        order = np.lexsort((cls, steps[:, 0]))
        cls, block, steps, signs = cls[order], block[order], np.ascontiguousarray(steps[order].T), signs[order]
        first, reach = steps[0].astype(np.int32), math.ceil(3.5 * STEPS)
        x, y = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i in range(0, len(cls), 256):  # pairs (i.., later) in the order of the first projection
            m = min(256, len(cls) - i)
            end = int(np.searchsorted(first, first[i + m - 1] + reach, "right"))
            hits = np.zeros((m, end - i), np.uint8)
            for s in steps:
                apart = s[i : i + m, None] - s[None, i:end]
                apart += STEPS
                hits += apart.view(np.uint16) <= 2 * STEPS
            a, b = np.nonzero(hits >= least)
            a, b = a[b > a] + i, b[b > a] + i
            ok = np.ones(len(a), bool) if p == q else block[a] != block[b]
            if table:
                ok &= ~(signs[a] == signs[b]).any(1)
            x.append(cls[a[ok]])
            y.append(cls[b[ok]])
        a, b = np.concatenate(x), np.concatenate(y)
        return pa.table({"x": pa.array(np.minimum(a, b)), "y": pa.array(np.maximum(a, b))})

    return run


def _verified(pairs: pa.Table, vectors: pa.Table, threshold: float):
    """(row of x in vectors, row of y, cosine) of the pairs that reach the threshold."""
    where = {c: k for k, c in enumerate(vectors.column("cls").to_pylist())}
    both = [(where[x], where[y]) for x, y in zip(pairs.column("x").to_pylist(), pairs.column("y").to_pylist()) if x in where and y in where]
    if not both:
        return
    v = vectors.column("v").combine_chunks()
    _, groups = _fit(v.chunk(0) if isinstance(v, pa.ChunkedArray) else v)
    unit = {}
    for rows, x in groups:
        unit |= dict(zip(rows.tolist(), _unit(x)))
    for k in range(0, len(both), 1 << 14):
        part = [(i, j) for i, j in both[k : k + (1 << 14)] if len(unit[i]) == len(unit[j])]
        for d in {len(unit[i]) for i, _ in part}:
            own = [(i, j) for i, j in part if len(unit[i]) == d]
            cos = np.einsum("ij,ij->i", np.array([unit[i] for i, _ in own]), np.array([unit[j] for _, j in own]))
            yield from ((*own[k], float(cos[k])) for k in np.flatnonzero(cos >= threshold))


def _linked(threshold: float):
    def run(pairs: pa.Table, vectors: pa.Table) -> pa.Table:
        return tiles.gathered(vectors.column("rep").to_pylist(), vectors.column("n").to_pylist(), ((i, j) for i, j, _ in _verified(pairs, vectors, threshold)))

    return run


def _paired(threshold: float):
    def run(pairs: pa.Table, vectors: pa.Table) -> pa.Table:
        rep = vectors.column("rep").to_pylist()
        got = [(min(rep[i], rep[j]), max(rep[i], rep[j]), c) for i, j, c in _verified(pairs, vectors, threshold) if rep[i] != rep[j]]
        return pa.table({k: pa.array([g[n] for g in got], t) for n, (k, t) in enumerate((("vec_a", pa.int64()), ("vec_b", pa.int64()), ("cosine", pa.float64())))})

    return run


class _Join:
    def __init__(self, vectors: DataFrame, threshold: float, projections: int, recall: float, bucket_rows: int, id_col: str, vector_col: str, broadcast_rows: int, tile_pairs: int):
        spark = vectors.sparkSession
        store.small_batches(spark)
        parts = store.partitions(spark)
        rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).filter("id is not null")
        half, least, bits, tables = plan(rows.count(), threshold, projections, recall, bucket_rows)
        sig = store.materialise(rows.mapInArrow(_signatures(projections, half, bits, tables), "id long, cls long, dims int, steps binary, signs binary"), "signatures")
        self.documents = store.materialise(sig.groupBy("id").agg(F.min("cls").alias("cls")).withColumnRenamed("id", "doc_id"), "documents")
        self.classes = store.materialise(self.documents.filter("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "classes")
        one = sig.join(self.classes.select("cls", F.col("rep").alias("id")), ["cls", "id"], "left_semi").dropDuplicates(["cls", "id"])
        code = F.sequence(F.lit(0), F.lit(tables - 1))
        bucket = one.select("cls", "dims", "steps", "signs", F.explode(code).alias("table")).withColumn("code", F.substring("signs", F.col("table") * 8 + 1, F.lit(8)))
        placed = store.materialise(bucket, "buckets")
        store.discard(sig)
        by = ["dims", "table", "code"]
        large = placed.groupBy(by).count().filter(F.col("count") > 2 * bucket_rows).select(*by, F.ceil(F.col("count") / bucket_rows).cast("int").alias("blocks"))
        dealt = placed.join(large, by, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("cls", *by, F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "steps", "signs")
        pairs = store.materialise(dealt.groupBy(*by, "p", "q").applyInArrow(_count(projections, least, tables), "x long, y long"), "pairs")
        self.placed = tiles.place(pairs, tile_pairs)
        store.discard(placed, pairs)
        wanted = tiles.wanted(self.placed).join(self.classes, "cls")
        asked = store.materialise(wanted.select(F.col("rep").alias("id")).distinct(), "asked")
        few = asked.count() <= broadcast_rows
        texts = rows.join(F.broadcast(asked) if few else asked, "id", "left_semi")

        def named(batches):
            for b in batches:
                _, groups = _fit(b.column(1))
                cls = np.zeros(len(b), np.int64)
                for r, x in groups:
                    cls[r] = _class(x)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cls), b.column(1)], ["id", "cls", "v"])

        kind = rows.schema["v"].dataType.simpleString()
        vs = texts.mapInArrow(text.tidied(named), f"id long, cls long, v {kind}")
        self.vectors = vs.join(wanted, "cls").filter("id = rep").select("cls", "at", "rep", "n", "v")
        self.threshold = threshold

    def give(self, function, schema: str) -> DataFrame:
        return self.placed.groupBy("tile").cogroup(self.vectors.groupBy("at")).applyInArrow(function(self.threshold), schema)


def near_copies(vectors: DataFrame, threshold: float = 0.95, projections: int = 40, recall: float = 0.98, bucket_rows: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", broadcast_rows: int = 1_000_000, tile_pairs: int = 1 << 17) -> DataFrame:
    """(id_col, class_id, links) of each vector: the smallest id of those it hangs together with by links, and how many others have a cosine >= threshold with it."""
    join = _Join(vectors, threshold, projections, recall, bucket_rows, id_col, vector_col, broadcast_rows, tile_pairs)
    return tiles.classes(join.documents, join.classes, join.give(_linked, tiles.LINKED)).withColumnRenamed("doc_id", id_col)


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, projections: int = 40, recall: float = 0.98, bucket_rows: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", broadcast_rows: int = 1_000_000, tile_pairs: int = 1 << 17) -> DataFrame:
    """Pairs (vec_a < vec_b, cosine) of cosine >= threshold between the representatives of classes, and of each other member of a class with its representative."""
    join = _Join(vectors, threshold, projections, recall, bucket_rows, id_col, vector_col, broadcast_rows, tile_pairs)
    same = join.documents.join(join.classes, "cls").filter("doc_id <> rep").select(F.col("rep").alias("vec_a"), F.col("doc_id").alias("vec_b"), F.lit(1.0).alias("cosine"))
    return join.give(_paired, "vec_a long, vec_b long, cosine double").unionByName(same)
