"""Table logic around model scores; the score itself is a column or a function that makes one."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .dedup import written


SMALL = 1_000_000  # rows of a few numbers that are broadcast


def likert(logits: Column) -> Column:
    """The expected place, from 1, under the softmax of logits."""
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda s, x: s + x)
    weighted = F.aggregate(F.transform(e, lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return weighted / total


def scored_paragraphs(docs: DataFrame, key: str, scorer: Callable[[Column], Column], separator: str = r"\n{2,}") -> DataFrame:
    """(key, para_idx, para, score)"""
    return docs.select(key, F.posexplode(T.paragraphs(F.col("text"), separator)).alias("para_idx", "para")).withColumn("score", scorer(F.col("para")))


def regroup(docs: DataFrame, kept: DataFrame, key: str) -> DataFrame:
    """Documents of the kept paragraphs, in order, with their mean score; documents that lost all have '' and 0."""
    by = kept.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("para_idx", "para"))).alias("v"), F.avg("score").alias("score"))
    text = by.select(key, F.array_join(F.transform("v", lambda x: x["para"]), "\n\n").alias("text"), "score")
    return docs.drop("text").join(text, key, "left").withColumn("text", F.coalesce("text", F.lit(""))).withColumn("score", F.coalesce("score", F.lit(0.0)))


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, word, n) of each text, whatever the case of its words. Texts are dealt by id, as they are smaller than their words by row, and so many to a part that its words can be counted in memory."""
    word = F.explode(F.filter(F.split(F.lower(text_col), r"(?U)\W+"), lambda x: x != "")).alias("word")
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), docs.count() // 5000)
    return docs.select(id_col, text_col).repartition(parts, id_col).select(id_col, word).groupBy(id_col, "word").agg(F.count("*").alias("n"))


def train_words(counts: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> tuple[DataFrame, list[tuple]]:
    """A multinomial naive Bayes model of word_counts, smoothed by one: (word, label, logp), and (label, prior, logp of a missing word) of each label, of which there are few. labels has (id_col, label)."""
    known = labels.dropna().dropDuplicates([id_col])
    known = F.broadcast(known) if known.count() <= SMALL else known
    n = written(counts.join(known, id_col).groupBy("word", "label").agg(F.sum("n").alias("n")), "word-model")
    words = n.select("word").distinct().count()
    docs = known.join(counts.select(id_col).distinct(), id_col, "left_semi").groupBy("label").agg(F.count("*").alias("docs"))
    total = n.groupBy("label").agg(F.sum("n").alias("total"))
    prior = [(r.label, math.log(r.docs), -math.log(r.total + words), r.total) for r in docs.join(total, "label").collect()]
    size = F.create_map(*[F.lit(x) for label, _, _, t in prior for x in (label, float(t + words))]) if prior else F.lit(None).cast("map<int, double>")
    return n.select("word", "label", F.log((F.col("n") + 1) / size[F.col("label")]).alias("logp")), [p[:3] for p in prior]


def classify(docs: DataFrame, counts: DataFrame, model: DataFrame, prior: list[tuple], id_col: str = "doc_id") -> DataFrame:
    """(id_col, predicted): the label of the greatest posterior, of equal ones the greater; words that the model lacks say nothing. Texts without known words get the commonest label, all null without labels."""
    labels = F.array(*[F.struct(F.lit(a).alias("label"), F.lit(b).alias("prior"), F.lit(c).alias("none")) for a, b, c in prior])
    if not prior:
        return docs.select(id_col, F.lit(None).alias("predicted"))
    none = F.create_map(*[F.lit(x) for a, _, c in prior for x in (a, c)])
    wide = written(model.groupBy("word").agg(*[F.max(F.when(F.col("label") == a, F.col("logp") - none[F.col("label")])).alias(f"__{k}") for k, (a, _, _) in enumerate(prior)]), "wide-model")
    wide = F.broadcast(wide) if wide.count() <= SMALL else wide  # then the counts stay where they are, and a sum for each text is shuffled
    sums = counts.join(wide, "word").groupBy(id_col).agg(F.sum("n").alias("words"), F.array(*[F.sum(F.col("n") * F.col(f"__{k}")) for k in range(len(prior))]).alias("mores"))
    every = docs.select(id_col).distinct().join(sums, id_col, "left").select(id_col, "words", "mores", F.posexplode(labels).alias("k", "p")).select(id_col, "words", F.get("mores", "k").alias("more"), "p.*")
    score = F.col("prior") + F.coalesce("words", F.lit(0)) * F.col("none") + F.coalesce("more", F.lit(0.0))
    best = every.groupBy(id_col).agg(F.max(F.struct(F.round(score, 6).alias("score"), "label")).alias("m"))
    return best.select(id_col, F.col("m.label").alias("predicted"))
