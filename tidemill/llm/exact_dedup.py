"""Exact dedup against a persistent digest index.

The index is a Parquet table bucketed and sorted by digest, so that the anti-join with new digests moves the
new ones alone. A load keeps the first row (smallest id, nulls last) of each text that the index lacks, then appends its digest under the load's name.
A load doesn't count what it appended itself: if it is run again under its name, because its rows weren't written after the index was, it keeps the same rows and appends nothing twice.

Defined results: null texts are no copies of each other and stay, unindexed; the empty text is a text like others;
of repeated rows (same text and id) one stays; extra columns are kept, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import store


class DigestIndex:
    """Opened on a folder; made there if it is new. The number of buckets belongs to the index for good: one that is there keeps its own."""

    def __init__(self, spark: SparkSession, path: str, buckets: int):
        self.spark, self.path = spark, path
        self.buckets = self._layout(buckets)
        self.table = f"digest_index_{uuid.uuid5(uuid.NAMESPACE_URL, path).hex}"
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.table} (digest BINARY, doc_id BIGINT, load STRING) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{path}'")

    def _layout(self, buckets: int) -> int:
        """The number of buckets that a file beside the data names, written with a new index."""
        fs, folder = store.file_system(self.spark, self.path)
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        there = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
        for name in there:
            if name.startswith("_buckets="):
                return int(name.partition("=")[2])
        fs.mkdirs(folder)
        fs.create(path(folder, f"_buckets={buckets}")).close()
        return buckets

    def read(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.table)
        return self.spark.table(self.table)

    def append(self, digests: DataFrame, load: str) -> None:
        own = self.read().filter(F.col("load") == load).select("digest")
        new = digests.select("digest", "doc_id").join(own.hint("merge"), "digest", "left_anti").withColumn("load", F.lit(load))
        store.materialise(new, "append").write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.table)


def digest(text):
    return F.unhex(F.sha2(text.cast("string"), 256))


def exact_dedup(docs: DataFrame, index: DigestIndex, load: str, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = 1_000_000) -> DataFrame:
    """The rows of docs to keep, in their own columns; the index then holds their digests, under the name of the load.

    Only digests and ids are shuffled while the rows to drop are at most broadcast_rows, as these are then broadcast; beyond that rows are joined with them by sort-merge, and texts travel once.
    """
    names = docs.columns
    d, i, kept, own, row = (store.free_name(docs, f"__{x}") for x in ("d", "i", "keep", "digest", "row"))
    key = docs.select(digest(docs[text_col]).alias("digest"), docs[id_col].cast("long").alias("doc_id")).filter("digest is not null")
    spread = key.repartition(index.buckets, "digest").groupBy("digest", "doc_id").agg(F.count("*").alias("n"))
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"))
    known = index.read().filter(F.col("load") != load).select(F.col("digest"), F.lit(True).alias("known"))
    seen = spread.withColumn("first", order == F.min(order).over(Window.partitionBy("digest")))
    fresh = store.materialise(seen.filter("first").hint("merge").join(known.hint("merge"), "digest", "left_anti").select("digest", "doc_id"), "fresh")
    state = spread.join(fresh.withColumn("keep", F.lit(True)).withColumnRenamed("doc_id", "kept"), "digest", "left").withColumn("keep", F.coalesce(F.col("keep") & F.col("doc_id").eqNullSafe(F.col("kept")), F.lit(False)))
    marked = store.materialise(state.filter("not keep or n > 1").select(F.col("digest").alias(d), F.col("doc_id").alias(i), F.col("keep").alias(kept)), "drop")
    index.append(fresh, load)
    store.discard(fresh)
    few = marked.count() <= broadcast_rows
    right = F.broadcast(marked) if few else marked
    full = docs.withColumn(own, digest(docs[text_col]))
    joined = full.join(right, F.col(own).eqNullSafe(F.col(d)) & full[id_col].cast("long").eqNullSafe(F.col(i)), "left")
    once = joined.filter(F.col(kept).isNull()).select(*[full[c] for c in names])
    again = joined.filter(F.col(kept)).withColumn(row, F.row_number().over(Window.partitionBy(d, i).orderBy(F.lit(1)))).filter(F.col(row) == 1).select(*names)
    return once.unionByName(again) if marked.filter(F.col(kept)).limit(1).count() else once
