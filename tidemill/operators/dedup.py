"""The reference's deduplication: MinHash clusters, repeated sentence spans, keys."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrow import slices


def shared_path(spark: SparkSession, name: str) -> str:
    """A new place in the folder of spark.checkpoint.dir, or below the warehouse where that is unset and all runs on this machine (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shingles(docs: DataFrame, id_col: str, n: int) -> DataFrame:
    """(id, g) for all word n-grams; a text of fewer words is one gram. Words are a column of their own, or each gram would split the text again."""
    words = docs.select(F.col(id_col).alias("id"), F.filter(F.split(F.lower("text"), r"(?U)\W+"), lambda x: x != "").alias("w"))
    return words.select("id", "w", F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1)))).alias("i")).select("id", F.array_join(F.slice("w", F.col("i"), n), " ").alias("g"))


MERSENNE = (1 << 31) - 1


def permutations(count: int, seed: int = 1) -> list[tuple[int, int]]:
    """Multipliers and addends of hash functions x -> (a x + b) mod MERSENNE, by a fixed linear congruential sequence."""
    out, x = [], seed
    for _ in range(2 * count):
        x = (x * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        out.append((x >> 33) % (MERSENNE - 1) + 1)
    return list(zip(out[::2], out[1::2]))


def least_hashes(batches: Iterable[pa.RecordBatch], functions: list[tuple[int, int]]) -> Iterable[pa.RecordBatch]:
    """(id, h0, h1, ...) of batches of (id, x below 2^28): the least value of each hash function over the rows of an id in a batch."""
    for b in batches:
        if not len(b):
            continue
        ids, x = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        start = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))  # grams of a text come one after the other; an id that comes again has another row
        out = [pa.array(ids[start])]
        for m, add in functions:
            y = x * m + add
            y = (y & MERSENNE) + (y >> 31)  # below 2^32
            y = (y & MERSENNE) + (y >> 31)
            y[y == MERSENNE] = 0
            out.append(pa.array(np.minimum.reduceat(y, start)))
        yield pa.RecordBatch.from_arrays(out, ["id", *(f"h{k}" for k in range(len(functions)))])


def band_keys(docs: DataFrame, id_col: str, n: int, bands: int, rows: int) -> DataFrame:
    """(id, key): for each band the least values of its hash functions over a document's grams, as partial minima beside the scan. A gram is hashed once."""
    hashed = shingles(docs, id_col, n).filter("id is not null").select("id", F.conv(F.substring(F.md5("g"), 1, 7), 16, 10).cast("long").alias("x"))
    names = [f"h{k}" for k in range(bands * rows)]
    parts = hashed.mapInArrow(partial(least_hashes, functions=permutations(bands * rows)), f"id {hashed.schema['id'].dataType.simpleString()}, " + ", ".join(f"{h} long" for h in names))
    least = parts.groupBy("id").agg(*[F.min(h).alias(h) for h in names])
    return least.select("id", F.explode(F.array(*[F.concat_ws("-", F.lit(str(b)), *[F.col(f"h{b * rows + r}") for r in range(rows)]) for b in range(bands)])).alias("key"))


def minhash_pairs(docs: DataFrame, id_col: str = "doc_id", n: int = 5, bands: int = 14, rows: int = 8) -> DataFrame:
    """Edges (a, b) that connect all documents sharing a band key: each bucket is tied to its smallest id, so a bucket of k gives k - 1 edges."""
    keys = written(band_keys(docs, id_col, n, bands, rows), "bands")
    low = keys.groupBy("key").agg(F.min("id").alias("a"), F.count("*").alias("n")).filter("n > 1")
    return keys.join(low, "key").filter("id <> a").select("a", F.col("id").alias("b")).distinct()


def _united(edges: pa.Table) -> pa.Table:
    up: dict[int, int] = {}

    def find(i: int) -> int:
        while (j := up.setdefault(i, i)) != i:
            up[i] = i = up[j]
        return i

    for x, y in zip(edges.column("a").to_pylist(), edges.column("b").to_pylist()):
        x, y = find(x), find(y)
        if x != y:
            up[max(x, y)] = min(x, y)
    return pa.table({"id": pa.array(list(up), pa.int64()), "cluster": pa.array([find(i) for i in list(up)], pa.int64())})


def components(edges: DataFrame, few: int = 500_000) -> DataFrame:
    """(id, cluster) with the smallest id of each connected component. Up to `few` edges, counted, are united on the driver; for more, rounds are written, so lineage stays short."""
    edges = written(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")), "pairs")
    if edges.count() <= few:
        return edges.sparkSession.createDataFrame(_united(edges.toArrow()))
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = written(both.distinct(), "edges")
    labels = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "id"), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        up = labels.join(near.withColumnRenamed("a", "id"), "id", "left").withColumn("next", F.least("label", F.coalesce("near", "label")))
        jump = labels.select(F.col("id").alias("next"), F.col("label").alias("far"))
        new = written(up.join(jump, "next", "left").select("id", F.least("next", F.coalesce("far", "next")).alias("new"), F.col("label").alias("old")), "labels")
        changed = new.filter("new <> old").limit(1).count()
        labels = new.select("id", F.col("new").alias("label"))
        if not changed:
            return labels.select("id", F.col("label").alias("cluster"))


def keep_flag(removed: Column, source: Column, always: set[str]) -> Column:
    """Kept if not removed, or of a source that always stays."""
    return ~F.coalesce(removed, F.lit(False)) | source.isin(*always)


def _without(text: str, places: list[int], span: int, split: str) -> tuple[str, int]:
    parts, gone = text.split(split), set()
    for p in places:
        gone.update(range(p, p + span))
    return split.join(x for k, x in enumerate(parts) if k not in gone), len(gone)


def span_dedup(docs: DataFrame, span: int = 3, id_col: str = "doc_id", text_col: str = "text", split: str = "\n", most: int | None = None) -> DataFrame:
    """(id_col, text_col, n_cut): sentences that lie in a span of `span` seen before, in an earlier document or place, are cut; the rest is joined again.

    Hashes of spans are shuffled, not sentences; of repeated ones the first is found by a grouped minimum. With `most`, documents of that many sentences or more are left out, as the reference has it.
    """
    parts = F.split(text_col, split, -1)
    rows = docs.filter(F.size(parts) < most) if most else docs
    at = F.sequence(F.lit(0), F.size("p") - span)
    spans = rows.select(id_col, parts.alias("p")).filter(F.size("p") >= span).select(id_col, F.explode(F.transform(at, lambda i: F.struct(i.alias("pos"), F.unhex(F.md5(F.concat_ws("\x1f", *[F.get("p", i + k) for k in range(span)]))).alias("h")))).alias("s")).select(id_col, "s.pos", "s.h")
    spans = written(spans, "spans")
    first = spans.groupBy("h").agg(F.min(F.struct(id_col, "pos")).alias("first"), F.count("*").alias("n")).filter("n > 1").select("h", "first")
    again = spans.join(first, "h").filter(F.struct(id_col, "pos") != F.col("first")).groupBy(id_col).agg(F.collect_list("pos").alias("places"))

    @F.arrow_udf("text string, n_cut long")
    def cut(texts: pa.Array, places: pa.Array) -> pa.Array:
        done = []
        for part in slices(pa.RecordBatch.from_arrays([texts, places], ["t", "p"])):
            got = [(t, None if t is None else 0) if t is None or not p else _without(t, p, span, split) for t, p in zip(*(c.to_pylist() for c in part.columns))]
            done.append(pa.StructArray.from_arrays([pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.int64())], ["text", "n_cut"]))
        return pa.concat_arrays(done) if done else pa.array([], pa.struct([("text", pa.string()), ("n_cut", pa.int64())]))

    done = rows.select(id_col, text_col).join(again, id_col, "left").select(id_col, cut(F.col(text_col), F.col("places")).alias("c"))
    return done.select(id_col, F.col("c.text").alias(text_col), "c.n_cut")


def anchors(words: list[str], gram: int, window: int) -> list[tuple[int, int]]:
    """(place, hash) of the word grams that are the least of some `window` neighbouring ones, the first of equal ones; a shorter text is one window."""
    h = [int(hashlib.md5(" ".join(words[i : i + gram]).encode()).hexdigest()[:15], 16) for i in range(len(words) - gram + 1)]
    if not h:
        return []
    views = np.lib.stride_tricks.sliding_window_view(np.array(h, np.int64), min(window, len(h)))
    return [(int(i), h[i]) for i in np.unique(views.argmin(1) + np.arange(len(views)))]


def anchor_batches(batches: Iterable[pa.RecordBatch], gram: int, window: int) -> Iterable[pa.RecordBatch]:
    """(id, pos, h) of the anchors in batches of (id, words), some texts at a time."""
    for b in (part for whole in batches for part in slices(whole, 16)):
        out = [(i, p, h) for i, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for p, h in anchors(w, gram, window)]
        yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in range(3)], ["id", "pos", "h"])


def repeated_passages(docs: DataFrame, least: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, pos, first_doc, first_pos): places where a text repeats half of `least` words of an earlier document or place.

    Any passage of `least` words that occurs twice has such a place, wherever it is: both occurrences have the same least hash among their grams of half that length.
    So a few hashes a text are shuffled and no suffix array is built. Null texts and those of fewer words than a gram have none.
    """
    gram = (least + 1) // 2
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.filter(F.split(F.lower(text_col), r"(?U)\W+"), lambda x: x != "").alias("w")).filter(F.size("w") >= gram)

    marks = written(rows.mapInArrow(partial(anchor_batches, gram=gram, window=least - gram + 1), "id long, pos long, h long"), "anchors")
    first = marks.groupBy("h").agg(F.min(F.struct("id", "pos")).alias("first"), F.count("*").alias("n")).filter("n > 1").select("h", "first")
    again = marks.join(first, "h").filter(F.struct("id", "pos") != F.col("first"))
    return again.select(F.col("id").alias(id_col), "pos", F.col("first.id").alias("first_doc"), F.col("first.pos").alias("first_pos"))
