"""Quality classifier: ridge regression on random Fourier features of document statistics, calibrated by isotonic regression.

Statistics are of whole texts. The kernel is Gaussian on standardised statistics. Normal equations are summed over
partitions; both the sums and the calibration bins have a fixed size, so what reaches the driver doesn't grow with the data.
At most max_labelled labelled documents are used (those whose ids have the smallest hashes); 3 of 10 of these calibrate.

Defined results: a text that is null or has no words scores 0 and is rejected; with no labelled rows all scores are null
and all rows are kept; with one class its value is each score; several labels of an id are averaged, null labels ignored; an id with several texts is an example with each of them,
repeated rows are one; ties and repeated rows score alike; extra columns are kept, and where docs has columns of the result's names, the new ones get underscores before theirs; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store, text

_CLASS = np.full(256, 12, np.int64)
for _k, _chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n", ".,;:", "!?", "#$%&*@^~", "|", "'\"()-", "<>{}[]\\/+=_")):
    for _c in _chars:
        _CLASS[ord(_c)] = _k
_CLASS[0x80:0xC0], _CLASS[0xC0:] = 13, 11
CLASSES, STATS = 14, 25
_U = np.uint64
_LINE = np.ones(256, bool)
_LINE[10] = False


def _distinct(doc: np.ndarray, h: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """For each document the number of distinct values and the count of the commonest."""
    key = np.sort((doc.astype(_U) << _U(44)) | (h >> _U(20)))
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    run = np.diff(np.concatenate([first, [len(key)]]))
    who = (key[first] >> _U(44)).astype(np.int64)
    most = np.zeros(docs, np.int64)
    np.maximum.at(most, who, run)
    return np.bincount(who, minlength=docs), most


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of STATS numbers for each text; the last is the number of words."""
    out = [np.zeros((0, STATS))]
    for _, t in text.chunks(texts):
        n = len(t)
        raw, off = text.buffer(t)
        size = np.diff(off)
        kinds = np.bincount(np.repeat(np.arange(n) * CLASSES, size) + _CLASS[raw], minlength=n * CLASSES).reshape(n, CLASSES)
        chars = np.maximum(size - kinds[:, 13], 1)
        low, loff = text.buffer(pc.utf8_lower(t))
        start, end = text.word_runs(low, loff)
        h = text.span_hash(low, start, end)
        at = np.searchsorted(start, loff)
        words = np.diff(at)
        doc = np.repeat(np.arange(n), words)
        long = (end - start).astype(float)
        w = np.maximum(words, 1)
        mean = np.bincount(doc, long, n) / w
        spread = np.sqrt(np.maximum(np.bincount(doc, long * long, n) / w - mean * mean, 0))
        unlike, most = _distinct(doc, h, n)
        same = np.zeros(len(h), bool)
        same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
        pair = text.mix(h[:-1] * _U(3) + h[1:]) if len(h) > 1 else np.zeros(0, _U)
        inside = doc[1:] == doc[:-1]
        pairs, _ = _distinct(doc[1:][inside], pair[inside], n)
        ls, le = text.runs(raw, off, _LINE)
        lines = np.diff(np.searchsorted(ls, off))
        ldoc = np.repeat(np.arange(n), lines)
        own, _ = _distinct(ldoc, text.span_hash(raw, ls, le), n)
        share = kinds[:, :13] / chars[:, None]
        letters = np.maximum(kinds[:, 0] + kinds[:, 1], 1)
        out.append(np.column_stack([np.sqrt(share), np.log1p(chars), mean, spread, unlike / w, most / w, np.bincount(doc, same, n) / w, pairs / np.maximum(words - 1, 1), own / np.maximum(lines, 1), kinds[:, 1] / letters, np.log1p(np.bincount(ldoc, le - ls, n) / np.maximum(lines, 1)), np.log1p(words), words]))
    return np.concatenate(out)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    phase: np.ndarray
    ridge: np.ndarray
    edges: np.ndarray
    levels: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats[:, :-1] - self.mean) / self.scale, -8, 8)
        z = np.cos(x @ self.weights + self.phase) * np.sqrt(2 / len(self.phase))
        return np.column_stack([z, np.ones(len(z))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return np.concatenate([self.features(stats[i : i + 4096]) @ self.ridge for i in range(0, len(stats), 4096)] or [np.zeros(0)])

    def score(self, stats: np.ndarray) -> np.ndarray:
        s = self.levels[np.searchsorted(self.edges, self.raw(stats), "right")]
        return np.where(stats[:, -1] > 0, s, 0.0)


def isotonic(y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Nondecreasing least-squares fit to means y of n rows each (pool adjacent violators)."""
    value, weight, width = [], [], []
    for a, b in zip(y, n):
        value.append(float(a))
        weight.append(float(b))
        width.append(1)
        while len(value) > 1 and value[-2] >= value[-1]:
            v, m, k = value.pop(), weight.pop(), width.pop()
            value[-1] = (value[-1] * weight[-1] + v * m) / (weight[-1] + m)
            weight[-1] += m
            width[-1] += k
    return np.repeat(value, width)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", features: int = 256, penalty: float = 1e-3, max_labelled: int = 40_000, bins: int = 512, id_col: str = "doc_id", text_col: str = "text", parts: int = 16) -> Model | None:
    """The fitted model, or None without labelled rows."""
    marks = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label).cast("double").alias("y")).dropna().groupBy("doc_id").agg(F.avg("y").alias("y"))
    marks = store.materialise(marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled), "marks")  # bounded, so it can be broadcast
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(marks), "doc_id")

    def stats(batches):
        for b in batches:
            s = statistics(b.column(1))
            flat = pa.array(s.ravel())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.ListArray.from_arrays(pa.array(np.arange(len(s) + 1, dtype=np.int32) * STATS), flat)], ["doc_id", "y", "s"])

    store.small_batches(docs.sparkSession)
    seen = store.materialise(rows.mapInArrow(text.tidied(stats), "doc_id long, y double, s array<double>").distinct().withColumn("held", F.pmod(F.xxhash64(F.col("doc_id"), F.lit(7)), F.lit(10)) < 3).repartition(parts, "doc_id"), "labelled")
    k = STATS - 1
    first = seen.select(F.count("*"), F.min("y"), F.max("y"), *[f(F.col("s")[i]) for i in range(k) for f in (F.avg, F.stddev_pop)]).first()
    if not first[0]:
        return None
    rng = np.random.default_rng(1992)
    moments = np.array(first[3:], float).reshape(k, 2)
    scale = np.where(moments[:, 1] > 1e-9, moments[:, 1], 1.0)
    model = Model(moments[:, 0], scale, rng.normal(size=(k, features)) / np.sqrt(k), rng.uniform(0, 2 * np.pi, features), np.zeros(features + 1), np.zeros(0), np.array([first[1]]))
    if first[1] == first[2]:
        return model

    def read(b):
        return np.asarray(b.column("s").flatten()).reshape(-1, STATS), np.asarray(b.column("y")), np.asarray(b.column("held").cast(pa.int8())).astype(bool)

    def sums(batches):
        d = features + 1
        a, c = np.zeros((d, d)), np.zeros(d)
        for b in batches:
            s, y, held = read(b)
            z = model.features(s[~held])
            a += z.T @ z
            c += z.T @ y[~held]
        yield pa.RecordBatch.from_arrays([pa.array([np.column_stack([a, c]).tobytes()], pa.binary())], ["sums"])

    total = sum(np.frombuffer(r.sums).reshape(features + 1, features + 2) for r in seen.mapInArrow(text.tidied(sums), "sums binary").toLocalIterator())
    a = total[:, :-1]
    model.ridge = np.linalg.solve(a + penalty * max(a[-1, -1], 1) / features * np.eye(len(a)), total[:, -1])

    def held_out(batches):
        for b in batches:
            s, y, held = read(b)
            at = np.clip(np.floor((model.raw(s[held]) + 1) / 3 * bins), 0, bins - 1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(y[held])], ["bin", "y"])

    got = seen.mapInArrow(held_out, "bin long, y double").groupBy("bin").agg(F.count("*").alias("n"), F.avg("y").alias("y")).orderBy("bin").collect()
    if got:
        level = isotonic(np.array([r.y for r in got]), np.array([r.n for r in got]))
        at = np.array([r.bin for r in got])
        model.edges = ((at[1:] + at[:-1] + 1) / 2) / bins * 3 - 1
        model.levels = level
    else:
        model.edges, model.levels = (np.arange(1, bins)) / bins, np.arange(bins) / (bins - 1)
    store.discard(seen, marks)
    return model


def score(model: Model | None, column: Column) -> Column:
    """The calibrated probability that a text is good."""
    if model is None:
        return F.lit(None).cast("double")

    @F.arrow_udf("double")
    def run(t: pa.Array) -> pa.Array:
        return pa.array(model.score(statistics(t)))

    return run.asNondeterministic()(column.cast("string"))  # or a filter on the score would make the plan score twice


def scored(docs: DataFrame, labels: DataFrame, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with quality_score and quality_keep (a score of at least `least`, or no model)."""
    model = fit(docs, labels, id_col=id_col, text_col=text_col, **options)
    name, keep = store.free_name(docs, "quality_score"), store.free_name(docs, "quality_keep")
    return docs.withColumn(name, score(model, docs[text_col])).withColumn(keep, F.coalesce(F.col(name) >= least, F.lit(True)))


def good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of docs that scored() keeps, in their own columns."""
    return (with_it := scored(docs, labels, **options)).filter(F.col(with_it.columns[-1])).select(*docs.columns)
