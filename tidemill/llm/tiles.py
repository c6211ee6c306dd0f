"""Verification of candidate pairs in tiles, and the groups that verified pairs make.

A tile is a set of pairs that is verified in one task, with one copy of what each of its members needs for that. A task gives the links and the group
of each member, not the pairs, so that what follows grows with the members.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store

LINKED = "doc long, root long, links long"


def place(pairs: DataFrame, tile_pairs: int) -> DataFrame:
    """(x, y, tile) of pairs (x, y), each of which comes once.

    Pairs that share a small neighbour go to one place, so that a member travels about once, not once a pair; a place of more than tile_pairs pairs is split by both members.
    """
    parts = store.partitions(pairs.sparkSession)
    ends = pairs.select("x", "y").unionByName(pairs.select(F.col("y").alias("x"), F.col("x").alias("y")))
    low = ends.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("low"))
    near = pairs.join(low.select("x", F.col("low").alias("lx")), "x").join(low.select(F.col("x").alias("y"), F.col("low").alias("ly")), "y").select("x", "y", F.least("lx", "ly").alias("low"))
    near = store.materialise(near, "near")
    large = near.groupBy("low").count().filter(F.col("count") > tile_pairs).select("low", F.ceil(F.sqrt(F.col("count") / tile_pairs)).cast("int").alias("split"))
    cut = F.coalesce(F.col("split"), F.lit(1))
    tile = F.pmod(F.xxhash64("low", F.pmod(F.xxhash64("x"), cut), F.pmod(F.xxhash64("y"), cut)), F.lit(8 * parts))
    placed = store.materialise(near.join(large, "low", "left").select("x", "y", tile.alias("tile")), "placed")
    store.discard(near)
    return placed


def wanted(placed: DataFrame) -> DataFrame:
    """(cls, at): the tiles that each member is needed in."""
    return placed.select(F.col("x").alias("cls"), F.col("tile").alias("at")).unionByName(placed.select(F.col("y").alias("cls"), F.col("tile").alias("at"))).distinct()


def gathered(rep: list[int], n: list[int], pairs: Iterable[tuple[int, int]]) -> pa.Table:
    """(doc, root, links) of the members of a tile that are in a verified pair of places in rep; root is the smallest document that one hangs together with here, n how many each stands for."""
    links, up = [0] * len(rep), list(range(len(rep)))

    def find(i: int) -> int:
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    for i, j in pairs:
        links[i] += n[j]
        links[j] += n[i]
        i, j = find(i), find(j)
        if i != j:
            i, j = (i, j) if rep[i] <= rep[j] else (j, i)
            up[j] = i
    has = [i for i in range(len(rep)) if links[i]]
    return pa.table({"doc": pa.array([rep[i] for i in has], pa.int64()), "root": pa.array([rep[find(i)] for i in has], pa.int64()), "links": pa.array([links[i] for i in has], pa.int64())})


def classes(documents: DataFrame, classes: DataFrame, linked: DataFrame) -> DataFrame:
    """(doc_id, class_id, links) from documents (doc_id, cls), classes (cls, rep, n) and what gathered() gave for all tiles."""
    found = store.materialise(linked, "linked")
    groups = components(found, "doc", "root")
    more = found.groupBy("doc").agg(F.sum("links").alias("more"))
    rows = documents.join(classes.select("cls", "rep", "n"), "cls", "left")
    rows = rows.join(more.withColumnRenamed("doc", "rep"), "rep", "left").join(groups.withColumnRenamed("id", "rep"), "rep", "left")
    return rows.groupBy("doc_id").agg(F.min(F.coalesce("group", "rep", "doc_id")).alias("class_id"), F.sum(F.coalesce("n", F.lit(1)) - 1 + F.coalesce("more", F.lit(0))).alias("links"))


def united(a: list[int], b: list[int]) -> dict[int, int]:
    """The smallest id that each id of the edges (a, b) is connected to."""
    up: dict[int, int] = {}

    def find(i: int) -> int:
        while (j := up.setdefault(i, i)) != i:
            up[i] = i = up[j]
        return i

    for x, y in zip(a, b):
        x, y = find(x), find(y)
        if x != y:
            up[max(x, y)] = min(x, y)
    return {i: find(i) for i in list(up)}


def components(pairs: DataFrame, a: str = "doc_a", b: str = "doc_b", rounds: int = 60, few: int = 500_000) -> DataFrame:
    """(id, group): the smallest id each id is connected to.

    Up to `few` edges are counted and united on the driver. More are joined in alternating large-star and small-star steps: each round's edges are written to the shared
    folder, and rounds grow with the logarithm of the longest chain. Both give the same groups.
    """
    edges = store.materialise(pairs.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "edges")
    if edges.count() <= few:
        t = edges.toArrow()
        group = united(t.column("u").to_pylist(), t.column("v").to_pylist())
        store.discard(edges)
        return edges.sparkSession.createDataFrame(pa.table({"id": pa.array(group.keys(), pa.int64()), "group": pa.array(group.values(), pa.int64())}))
    before = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.greatest("u", "m").alias("u"), F.least("u", "m").alias("v")), F.struct(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()
        new = store.materialise(small, "edges")
        mark = tuple(new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        store.discard(edges)
        edges = new
        if mark == before:
            break
        before = mark
    low = edges.groupBy("u").agg(F.min("v").alias("group")).select(F.col("u").alias("id"), "group")
    return low.unionByName(low.select(F.col("group").alias("id"), "group").distinct())
