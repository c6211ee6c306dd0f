"""Nearest neighbours: exact in blocks, and by the cells of trained centroids."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrow import slices
from .dedup import written


def _distance(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    if metric == "l2":
        return np.maximum((q * q).sum(1)[:, None] + (x * x).sum(1)[None] - 2 * q @ x.T, 0)
    if metric == "cosine":
        return 1 - (q / np.linalg.norm(q, axis=1, keepdims=True)) @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T
    return -(q @ x.T)


def _flat(a: pa.Array) -> np.ndarray:
    return np.asarray(a.flatten(), np.float64).reshape(len(a), -1)


def _rows(a: pa.ChunkedArray) -> np.ndarray:
    flat = a.combine_chunks()
    return np.asarray(flat.flatten(), np.float64).reshape(len(a), -1)


BLOCK_VALUES, Q_ROWS, X_ROWS = 1 << 22, 256, 4096  # numbers in a block of vectors (32 MB); vectors a pass


def _round(d: np.ndarray, places: int) -> np.ndarray:
    return np.floor(d * 10.0**places + 0.5) / 10.0**places


def _left(q: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Vectors whose products with those of _right, with an addend for each query, are the distances."""
    if metric == "l2":
        return np.hstack([q, np.ones((len(q), 1))]), (q * q).sum(1)
    return (q / np.linalg.norm(q, axis=1, keepdims=True), np.ones(len(q))) if metric == "cosine" else (q, np.zeros(len(q)))


def _right(x: np.ndarray, metric: str) -> np.ndarray:
    if metric == "l2":
        return np.hstack([-2 * x, (x * x).sum(1)[:, None]])
    return -x / np.linalg.norm(x, axis=1, keepdims=True) if metric == "cosine" else -x


def _pairwise(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """The distance of each row of q to that of x."""
    if metric == "l2":
        return ((q - x) ** 2).sum(1)
    if metric == "cosine":
        return 1 - (q * x).sum(1) / (np.linalg.norm(q, axis=1) * np.linalg.norm(x, axis=1))
    return -(q * x).sum(1)


def nearest(q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, metric: str = "l2", places: int = 9, cell: np.ndarray | None = None, probed=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, id, distance) of the exact k nearest of each query by rounded distance, then id. Rows of x are looked at in passes of a fixed size,
    and only those that can be among the best so far are sorted. With cell, the ordered cell of each row of x, and probed, a function from queries to a table of cells to look at, only rows of those count."""
    out, right = ([], [], []), _right(x, metric)
    far = np.sqrt((right * right).sum(1).max(initial=0))
    kind = np.float32 if far < 1e15 else np.float64  # products only say which rows to compare exactly; slack covers their error
    right = right.astype(kind)
    for i in range(0, len(q), Q_ROWS):
        qs = q[i : i + Q_ROWS]
        left, more = _left(qs, metric)
        slack = (left.shape[1] + 8) * np.finfo(kind).eps * (np.abs(more) + far * np.sqrt((left * left).sum(1))) + 0.5 * 10.0**-places
        left = left.astype(kind) if np.abs(left).max(initial=0) < 1e15 else left
        look = probed(qs) if probed is not None else None
        n = len(qs)
        best, near = np.full((n, k), np.inf), np.full((n, k), np.iinfo(np.int64).max)
        for j in range(0, len(x), X_ROWS):
            part, own = x[j : j + X_ROWS], ids[j : j + X_ROWS]
            rows = np.arange(n) if look is None else np.flatnonzero(look[:, cell[j] : cell[j + len(part) - 1] + 1].any(1))
            if not len(rows):
                continue
            d = left[rows] @ right[j : j + X_ROWS].T
            kth = best[rows, -1]
            fresh = np.flatnonzero(np.isinf(kth))
            if look is not None and len(fresh):
                d[fresh] = np.where(look[rows[fresh]][:, cell[j : j + len(part)]], d[fresh], np.inf)
            bound = (kth - more[rows] + slack[rows]).astype(d.dtype)
            if len(fresh) and len(part) > k:
                bound[fresh] = np.partition(d[fresh], k - 1, axis=1)[:, k - 1] + 2 * slack[rows[fresh]]
            r, c = np.divmod(np.flatnonzero(d <= bound[:, None]), d.shape[1])
            if look is not None:
                some = np.isfinite(d[r, c]) & look[rows[r], cell[j + c]]
                r, c = r[some], c[some]
            some = (own[c] < near[rows[r], -1]) | (d[r, c] + more[rows[r]] < kth[r] - 10.0**-places + slack[rows[r]])
            r, c = r[some], c[some]
            if not len(r):
                continue
            exact = np.concatenate([_round(_pairwise(qs[rows[r[a : a + 8192]]], part[c[a : a + 8192]], metric), places) for a in range(0, len(r), 8192)])
            hit = np.unique(r)
            place = np.concatenate([np.repeat(hit, k), r])
            dist = np.concatenate([best[rows[hit]].ravel(), exact])
            name = np.concatenate([near[rows[hit]].ravel(), own[c]])
            order = np.lexsort((name, dist, place))
            start = np.searchsorted(place[order], hit)
            take = order[start[:, None] + np.arange(k)]
            best[rows[hit]], near[rows[hit]] = dist[take], name[take]
        found = np.isfinite(best)
        out[0].append(i + np.nonzero(found)[0])
        out[1].append(near[found])
        out[2].append(best[found])
    cat = lambda z, t: np.concatenate(z) if z else np.zeros(0, t)
    return cat(out[0], np.int64), cat(out[1], np.int64), cat(out[2], np.float64)


_FOUND = "query_id long, vec_id long, distance double"


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def _grid(spark, n_queries: int, n_base: int, dim: int, blocks: int | None = None) -> tuple[int, int]:
    """Blocks of queries and of base: each of at most BLOCK_VALUES numbers, and enough pairs for all cores."""
    most, tasks = max(1, BLOCK_VALUES // max(1, dim)), 2 * spark.sparkContext.defaultParallelism
    b = blocks or -(-n_base // most) or 1
    q = max(1, -(-n_queries // most), min(-(-tasks // b), -(-n_queries // 64)))
    return q, b if blocks else max(b, min(-(-tasks // q), -(-n_base // X_ROWS)))


def _table(qid: np.ndarray, got: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.Table:
    return pa.table({"query_id": pa.array(qid[got[0]], pa.int64()), "vec_id": pa.array(got[1], pa.int64()), "distance": pa.array(got[2], pa.float64())})


def knn(queries: DataFrame, base: DataFrame, k: int, metric: str = "l2", blocks: int | None = None, places: int = 9) -> DataFrame:
    """(query_id, vec_id, distance, rank): the exact k nearest by distance in so many places; ties go to the smaller id. queries and base have (id, v).

    Queries and base rows are dealt into blocks of a bounded size, a task compares two blocks, and the best k of each are ranked. So memory doesn't grow with the tables,
    and what is shuffled is each table times the blocks of the other.
    """
    spark = queries.sparkSession
    size = base.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim")).first()
    a, b = _grid(spark, queries.count(), size["n"], size["dim"] or 1, blocks)
    deal = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    q = queries.select(F.col("id").cast("long").alias("query_id"), "v", F.explode(F.sequence(deal(a) * b, deal(a) * b + b - 1)).alias("pair"))
    x = base.select(F.col("id").cast("long").alias("id"), F.col("v").alias("w"), F.explode(F.sequence(deal(b), deal(b) + (a - 1) * b, F.lit(b))).alias("place"))

    def near(q: pa.Table, x: pa.Table) -> pa.Table:
        if not len(q) or not len(x):
            return _table(np.zeros(0, np.int64), (np.zeros(0, np.int64),) * 3)
        ids = np.asarray(x.column("id"))
        order = np.argsort(ids, kind="stable")
        return _table(np.asarray(q.column("query_id")), nearest(_rows(q.column("v")), _rows(x.column("w"))[order], ids[order], k, metric, places))

    found = q.repartition(a * b, "pair").groupBy("pair").cogroup(x.repartition(a * b, "place").groupBy("place")).applyInArrow(near, _FOUND)
    return _ranked(found, k)


def train_cells(base: DataFrame, cells: int, rounds: int = 8, seed: int = 1992) -> np.ndarray:
    """Centroids by k-means over all vectors: each round sums the vectors of a cell by partition; only the centroids come to the driver."""
    c = _rows(base.select("id", "v").orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(cells).toArrow().column("v"))
    for _ in range(rounds):

        def sums(batches, c=c):
            n, total = np.zeros(len(c), np.int64), np.zeros(c.shape)
            for b in batches:
                x = np.asarray(b.column(0).flatten(), np.float64).reshape(len(b), -1)
                for i in range(0, len(x), 512):
                    own = _distance(x[i : i + 512], c, "l2").argmin(1)
                    n += np.bincount(own, minlength=len(c))
                    np.add.at(total, own, x[i : i + 512])
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some]), pa.array(list(total[some]), pa.list_(pa.float64()))], ["cell", "n", "total"])

        def add(t: pa.Table) -> pa.Table:
            total = _rows(t.column("total")).sum(0) / np.asarray(t.column("n")).sum()
            return pa.table({"cell": t.column("cell").slice(0, 1), "mean": pa.array([total], pa.list_(pa.float64()))})

        new = base.select(F.col("v").cast("array<double>")).mapInArrow(sums, "cell long, n long, total array<double>").groupBy("cell").applyInArrow(add, "cell long, mean array<double>").toArrow()
        c = c.copy()
        c[np.asarray(new.column("cell"))] = _rows(new.column("mean"))
    return c


def choose_probes(queries: DataFrame, base: DataFrame, k: int, centroids: np.ndarray, recall: float = 0.95, sample: int = 256, seed: int = 7) -> int:
    """The fewest cells to probe that hold `recall` of the exact neighbours of `sample` queries; the sample is drawn by hash and decides on nothing else."""
    q = queries.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(sample)
    found = knn(q, base, k).join(base.select(F.col("id").alias("vec_id"), F.col("v").alias("w")), "vec_id").join(q.select(F.col("id").alias("query_id"), "v"), "query_id").select("v", "w").toArrow()
    if not len(found):
        return 1
    near = _distance(_rows(found.column("v")), centroids, "l2").argsort(1, kind="stable")
    own = _distance(_rows(found.column("w")), centroids, "l2").argmin(1)
    at = np.sort((near == own[:, None]).argmax(1))
    return int(at[int(np.ceil(recall * len(at))) - 1]) + 1


def knn_cells(queries: DataFrame, base: DataFrame, k: int, centroids: np.ndarray, probes: int) -> DataFrame:
    """The k nearest among the vectors of the `probes` cells nearest to each query: approximate, and linear in base.

    Cells are gathered into blocks of a bounded size. A query goes once to each block that has one of its cells, and not once to each cell.
    """
    spark, dim = queries.sparkSession, centroids.shape[1]
    most = max(1, BLOCK_VALUES // dim)

    def looked(v: np.ndarray) -> np.ndarray:
        near = np.argsort(_distance(v, centroids, "l2"), axis=1, kind="stable")[:, :probes]
        out = np.zeros((len(v), len(centroids)), bool)
        np.put_along_axis(out, near, True, 1)
        return out

    def placed(batches):
        for b in (part for whole in batches for part in slices(whole, 4096, 1 << 23)):
            own = _distance(_flat(b.column(1)), centroids, "l2").argmin(1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(own.astype(np.int32))], ["id", "w", "cell"])

    kind = base.schema["v"].dataType.simpleString()
    own = written(base.select(F.col("id").cast("long").alias("id"), "v").mapInArrow(placed, f"id long, w {kind}, cell int"), "cells")
    sizes = {r["cell"]: r["count"] for r in own.groupBy("cell").count().collect()}  # a number for each cell
    a, b = _grid(spark, queries.count(), sum(sizes.values()), dim)
    most = min(most, -(-sum(sizes.values()) // b) or 1)
    first, parts, n, held = np.zeros(len(centroids), np.int64), np.zeros(len(centroids), np.int64), 0, 0
    for c in range(len(centroids)):  # a cell larger than a block has several for itself
        size = sizes.get(c, 0)
        if held and held + size > most:
            n, held = n + 1, 0
        first[c], parts[c] = n, max(1, -(-size // most)) if size else 0
        n, held = (n + parts[c], 0) if parts[c] > 1 else (n, held + size)
    b = int((first + parts).max())
    spans = np.zeros((len(centroids), b), bool)
    for c in range(len(centroids)):
        spans[c, first[c] : first[c] + parts[c]] = True

    def sent(batches):
        for part in (part for whole in batches for part in slices(whole, 1024)):
            rows, block = np.nonzero((looked(_flat(part.column(1))).astype(np.float32) @ spans.astype(np.float32)) > 0)
            for i in range(0, len(rows), 8192):
                at = pa.array(rows[i : i + 8192])
                pair = part.column(2).take(at).to_numpy().astype(np.int64) * b + block[i : i + 8192]
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), pa.array(pair.astype(np.int32))], ["query_id", "v", "pair"])

    deal = F.pmod(F.xxhash64("id"), F.lit(a)).cast("int")
    q = queries.select(F.col("id").cast("long").alias("id"), "v", deal.alias("deal")).mapInArrow(sent, f"query_id long, v {queries.schema['v'].dataType.simpleString()}, pair int")
    at = F.col("cell") if not len(first) else F.get(F.array(*[F.lit(int(f)) for f in first]), F.col("cell")) + F.pmod(F.xxhash64("id"), F.greatest(F.lit(1), F.get(F.array(*[F.lit(int(p)) for p in parts]), F.col("cell")))).cast("int")
    x = own.withColumn("at", at).select("id", "w", "cell", F.explode(F.sequence(F.col("at"), F.col("at") + (a - 1) * b, F.lit(b))).alias("place"))

    def near(q: pa.Table, x: pa.Table) -> pa.Table:
        if not len(q) or not len(x):
            return _table(np.zeros(0, np.int64), (np.zeros(0, np.int64),) * 3)
        ids, cell = np.asarray(x.column("id")), np.asarray(x.column("cell"))
        order = np.lexsort((ids, cell))
        return _table(np.asarray(q.column("query_id")), nearest(_rows(q.column("v")), _rows(x.column("w"))[order], ids[order], k, cell=cell[order], probed=looked))

    found = q.repartition(a * b, "pair").groupBy("pair").cogroup(x.repartition(a * b, "place").groupBy("place")).applyInArrow(near, _FOUND)
    return _ranked(found, k)


def write_index(base: DataFrame, centroids: np.ndarray, path: str) -> None:
    """A persistent index: vectors with their ids by cell, and the centroids beside them. A search reads the cells that it probes alone."""
    spark = base.sparkSession

    def cell(batches):
        for b in batches:
            v = np.asarray(b.column(1).flatten(), np.float64).reshape(len(b), -1)
            own = np.concatenate([_distance(v[i : i + 512], centroids, "l2").argmin(1) for i in range(0, max(1, len(v)), 512)])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(own.astype(np.int32))], ["id", "v", "cell"])

    placed = base.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v")).mapInArrow(cell, "id long, v array<double>, cell int")
    placed.repartition("cell").sortWithinPartitions("cell", "id").write.partitionBy("cell").parquet(f"{path}/vectors")
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "cell int, v array<double>").coalesce(1).write.parquet(f"{path}/centroids")


def open_index(spark, path: str) -> tuple[DataFrame, np.ndarray]:
    """(id, v, cell) and the centroids (as many as cells, so they fit the driver)."""
    c = spark.read.parquet(f"{path}/centroids").orderBy("cell").select("v").toArrow()
    return spark.read.parquet(f"{path}/vectors"), _rows(c.column("v"))


def search_index(spark, path: str, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
    """The k nearest vectors of an index in the `probes` nearest cells of each query; all cells give the exact ones."""
    base, centroids = open_index(spark, path)
    return knn_cells(queries, base.select("id", "v"), k, centroids, min(probes or len(centroids), len(centroids)))
