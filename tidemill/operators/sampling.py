"""Sampling by hash draws: a row's fate depends on its key and the seed alone, not on partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import hash_draw


def take_per_group(df: DataFrame, group: list[str], n: Column | int, key: str, seed: int = 1992) -> DataFrame:
    """n rows of each group, without replacement."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(hash_draw(F.col(key), seed), key))
    return df.withColumn("__rank", rank).filter(F.col("__rank") <= n).drop("__rank")


def stratified_targets(df: DataFrame, total: int, group: str = "source", tokens: str = "num_tokens", least: int = 0) -> DataFrame:
    """(group, wanted, docs, p): rows wanted of each group by its share of tokens, at most all of them."""
    by = df.groupBy(group).agg(F.sum(tokens).alias("tokens"), F.count("*").alias("docs"))
    want = F.least(F.greatest(F.ceil(F.col("tokens") / F.sum("tokens").over(Window.partitionBy()) * total), F.lit(least)), F.col("docs"))
    return by.withColumn("wanted", want.cast("long")).withColumn("p", F.col("wanted") / F.col("docs")).select(group, "wanted", "docs", "p")


def stratified_bernoulli(df: DataFrame, total: int, key: str, group: str = "source", least: int = 0) -> DataFrame:
    targets = stratified_targets(df, total, group, least=least).select(group, "p")
    return df.join(F.broadcast(targets), group).filter(hash_draw(F.col(key)) < F.col("p")).drop("p")


def stratified_exact(df: DataFrame, total: int, key: str, group: str = "source", least: int = 0, seed: int = 1992, cells: int = 4096) -> DataFrame:
    """As many rows of each group as its target says, those with the smallest draws.

    Draws are counted in cells; cells below a group's cut are kept whole, and only the rows of the cell that holds the cut are ranked, so no group is sorted in one place.
    """
    targets = stratified_targets(df, total, group, least=least).select(group, "wanted")
    drawn = df.withColumn("__u", hash_draw(F.col(key), seed)).withColumn("__cell", F.floor(F.col("__u") * cells))
    by = drawn.groupBy(group, "__cell").agg(F.count("*").alias("__n")).join(F.broadcast(targets), group)
    upto = F.sum("__n").over(Window.partitionBy(group).orderBy("__cell"))
    cut = by.withColumn("__upto", upto).groupBy(group).agg(F.max("wanted").alias("__wanted"), F.min(F.when(F.col("__upto") > F.col("wanted"), F.col("__cell"))).alias("__cut"), F.max(F.when(F.col("__upto") <= F.col("wanted"), F.col("__upto"))).alias("__below"))
    with_cut = drawn.join(F.broadcast(cut), group)
    low = with_cut.filter(F.col("__cut").isNull() | (F.col("__cell") < F.col("__cut")))
    edge = with_cut.filter(F.col("__cell") == F.col("__cut")).withColumn("__r", F.row_number().over(Window.partitionBy(group).orderBy("__u", key)))
    edge = edge.filter(F.col("__r") <= F.col("__wanted") - F.coalesce("__below", F.lit(0))).drop("__r")
    return low.unionByName(edge).drop("__u", "__cell", "__wanted", "__cut", "__below")


def mixture_copies(df: DataFrame, weights: DataFrame, key: str, group: str = "source") -> DataFrame:
    """Each row as often as its group's weight says: below 1 a Bernoulli draw, from 1 its whole part; groups without a weight go."""
    w = F.coalesce(F.col("weight"), F.lit(0.0))
    n = F.when(w < 1, (hash_draw(F.col(key)) < w).cast("int")).otherwise(F.floor(w).cast("int"))
    return df.join(F.broadcast(weights), group, "left").withColumn("__n", n).filter("__n > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("__n")))).drop("__n", "weight")


def token_budget(df: DataFrame, budget: int, key: list[str], tokens: str = "num_tokens", seed: int = 7) -> DataFrame:
    """If there are more tokens than the budget, the share budget / tokens of rows, in the order of their draw.

    The cut is found by counting draws, not by sorting all rows in one place: rows below a bound on the draw are kept,
    and only the rows of the one range of draws that the cut falls into are ranked.
    """
    draw = hash_draw(F.concat_ws("-", *key), seed)
    drawn = df.withColumn("__u", draw)
    total, rows = df.agg(F.sum(tokens), F.count("*")).first()
    if not total or total <= budget:
        return df
    keep = int(budget / total * rows)
    cells = 1 << 16
    by = drawn.groupBy(F.floor(F.col("__u") * cells).alias("cell")).count().orderBy("cell").collect()  # at most 65,536 rows, however many df has
    seen, cut = 0, None
    for r in by:
        if seen + r["count"] > keep:
            cut = r["cell"]
            break
        seen += r["count"]
    if cut is None:
        return df
    low = drawn.filter(F.floor(F.col("__u") * cells) < cut)
    edge = drawn.filter(F.floor(F.col("__u") * cells) == cut).withColumn("__r", F.row_number().over(Window.partitionBy(F.floor(F.col("__u") * cells)).orderBy("__u", *key))).filter(F.col("__r") <= keep - seen).drop("__r")
    return low.unionByName(edge).drop("__u")


def split_by_draw(key: Column, shares: dict[str, float], seed: int = 1992) -> Column:
    """The split of a row, by cumulative shares; the last split takes the rest."""
    u, upto, out = hash_draw(key, seed), 0.0, None
    names = list(shares)
    for name in names[:-1]:
        upto += shares[name]
        out = F.when(u < upto, name) if out is None else out.when(u < upto, name)
    return out.otherwise(names[-1]) if out is not None else F.lit(names[-1])


def stochastic_round(x: Column, key: Column, seed: int = 11) -> Column:
    return (F.floor(x) + (hash_draw(key, seed) < x - F.floor(x)).cast("int")).cast("int")


def upsampling_count(factor: Column, method: str, k: float, key: Column) -> Column:
    """Copies of a row for a factor; a negative factor drops it."""
    n = {"linear": 1 + factor * k, "proportional": factor * k, "exponential": F.least(F.exp(factor) * k, F.lit(5.0))}[method]
    return F.when(factor < 0, 0).otherwise(stochastic_round(n, key))


def keep_by_score(score: Column, target: float, mean: float, key: Column) -> Column:
    """Keep in proportion to the score, moved so that its mean is the target share."""
    moved = score + (target - mean)
    return F.when(moved <= 0, False).when(moved >= 1, True).otherwise(hash_draw(key, 13) <= moved)
