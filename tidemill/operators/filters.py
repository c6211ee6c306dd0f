"""Row filters that say why a row goes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import words

LINE_BREAK = "[\\n\\r\\x0B\\x0C\\x1C-\\x1E\\x85\\u2028\\u2029]"
STOP_WORDS = ("the", "be", "to", "of", "and", "that", "have", "with")
TOP = {2: 0.20, 3: 0.18, 4: 0.16}
DUPLICATE = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}


def with_reason(df: DataFrame, *rules: tuple[str, Column]) -> DataFrame:
    """A reason column: the name of the first rule that holds, null if none does."""
    reason = F.lit(None).cast("string")
    for name, rule in reversed(rules):
        reason = F.when(rule, F.lit(name)).otherwise(reason)
    return df.withColumn("reason", reason)


def repeated(parts: Column) -> tuple[Column, Column]:
    """(second and later occurrences, their characters) of an array of strings."""
    unique = F.array_distinct(parts)
    chars = lambda a: F.aggregate(a, F.lit(0), lambda n, x: n + F.length(x))
    return F.size(parts) - F.size(unique), chars(parts) - chars(unique)


def line_parts(c: Column, breaks: str = LINE_BREAK, spaces: str = T.SPACES) -> Column:
    """The paragraphs and lines of a text, for line_repetition."""
    lines = F.filter(F.transform(F.split(c, breaks, -1), lambda x: F.btrim(x, F.lit(spaces))), lambda x: x != "")
    return F.struct(F.split(F.btrim(c, F.lit(spaces)), r"\n{2,}", -1).alias("para"), lines.alias("line"))


def line_repetition(c: Column, parts: Column, none: float = 0.0) -> dict[str, Column]:
    """Shares of repeated paragraphs and lines, by count and by characters of the text; none is the share of nothing.

    Give it the line_parts as a column of its own, or each share would split the text again.
    """
    out = {}
    for name in ("para", "line"):
        n, chars = repeated(parts[name])
        out[f"dup_{name}_frac"] = F.coalesce(F.try_divide(n, F.size(parts[name])), F.lit(none))
        out[f"dup_{name}_char_frac"] = F.coalesce(F.try_divide(chars, F.length(c)), F.lit(none))
    return out


def gram_repetition(c: Column) -> Column:
    """An array of shares of the text: the commonest 2-, 3- and 4-gram, then repeated 5- to 10-grams."""
    return words.repetition_shares(tuple(TOP), tuple(DUPLICATE))(c)


def repetition_reason(df: DataFrame, text: str = "text") -> DataFrame:
    """The first repetition rule that fails. Native rules come first, so they decide before the n-gram scan is looked at."""
    limit = {"dup_para_frac": 0.3, "dup_para_char_frac": 0.2, "dup_line_frac": 0.3, "dup_line_char_frac": 0.2}
    shares = line_repetition(F.col(text), F.col("__parts"))
    native, grams = F.col("__native"), F.col("__grams")
    rules = [(k, native[i] > limit[k]) for i, k in enumerate(limit)]
    rules += [(f"top_{n}_gram", grams[i] > v) for i, (n, v) in enumerate(TOP.items())]
    rules += [(f"dup_{n}_gram", grams[i + len(TOP)] > v) for i, (n, v) in enumerate(DUPLICATE.items())]
    made = df.withColumn("__parts", line_parts(F.col(text))).withColumn("__native", F.array(*[shares[k] for k in limit])).withColumn("__grams", gram_repetition(F.col(text)))
    return with_reason(made, ("empty", F.coalesce(F.length(text), F.lit(0)) == 0), *rules).drop("__parts", "__native", "__grams")


def word_stats(c: Column) -> Column:
    """What quality_rules looks at: counted in one pass over a batch, so give it a column of its own."""
    return words.word_stats(STOP_WORDS)(c)


def quality_rules(c: Column, stats: Column, least: int = 50, most: int | None = None, hashes: float | None = None) -> list[tuple[str, Column]]:
    """The ordered quality rules for a text and its word_stats; limits that are None are off, as the reference has them in production. Single ASCII marks are no words."""
    n = stats["n"]
    mean = F.try_divide(stats["chars"], n)
    lines = F.split(c, LINE_BREAK, -1)
    share = lambda rule: F.try_divide(F.size(F.filter(lines, rule)), F.size(lines))
    rules = [("short", n < least)]
    if most:
        rules.append(("long", n > most))
    rules += [("short_words", mean < 3), ("long_words", mean > 10)]
    if hashes:
        dots = F.size(F.split(c, r"\.\.\.", -1)) + F.size(F.split(c, "…", -1)) - 2
        rules += [("hashes", (F.size(F.split(c, "#", -1)) - 1) / n > hashes), ("ellipses", dots / n > hashes)]
    return rules + [
        ("bullets", share(lambda x: x.rlike(r"(?U)^\s*[•-]")) > 0.9),
        ("ellipsis_ends", share(lambda x: x.rlike(r"(?U)(?:\.\.\.|…)\s*$")) > 0.3),
        ("few_letters", stats["letters"] / n < 0.8),
        ("few_stop_words", stats["stops"] < 2),
    ]


def quality_reason(df: DataFrame, text: str = "text", **limits) -> DataFrame:
    """The first quality rule that fails."""
    return with_reason(df.withColumn("__words", word_stats(F.col(text))), *quality_rules(F.col(text), F.col("__words"), **limits)).drop("__words")


def filter_driver(df: DataFrame, excluded: set[str], text: str = "text", source: str = "source") -> DataFrame:
    """Repetition, then quality; rows of excluded sources pass unread."""
    checked = repetition_reason(df, text).withColumnRenamed("reason", "__repetition")
    both = quality_reason(checked, text).withColumn("reason", F.coalesce("__repetition", "reason"))
    return both.withColumn("reason", F.when(~F.col(source).isin(*excluded), F.col("reason"))).drop("__repetition")


ALLOW = ("history", "assessment", "impression", "findings", "course", "exam")
DENY = ("medications", "allergies", "discharge instructions", "followup", "facility")


def section_reason(header: Column, body: Column, entity: Column | None = None) -> Column:
    """Why a clinical section goes: its header decides if it can, then length, then digits, then a missing entity."""
    head = F.lower(F.coalesce(header, F.lit("")))
    has = lambda names: F.exists(F.array(*map(F.lit, names)), lambda n: head.contains(n))
    words = F.filter(F.split(body, r"(?U)\s+", -1), lambda w: w != "")
    noise = F.size(F.filter(words, lambda w: w.rlike(r"(?U)\d|^\W")))
    rules = F.when(has(DENY), "header").when(has(ALLOW), F.lit(None).cast("string")).when(F.size(words) <= 3, "short").when(noise * 2 >= F.size(words), "digits")
    return rules.when(~entity, "no_entity") if entity is not None else rules


def expectations(df: DataFrame, key: str, text: str) -> DataFrame:
    """(check, n_bad) in one pass but for the key's distinct count."""
    bad = df.agg(F.count_if(F.coalesce(F.length(F.col(key).cast("string")), F.lit(0)) == 0).alias("empty_id"), F.count_if(F.coalesce(F.length(text), F.lit(0)) == 0).alias("empty_text"), (F.count(key) - F.countDistinct(key)).alias("duplicate_id"))
    return bad.select(F.explode(F.create_map(*[x for c in bad.columns for x in (F.lit(c), F.col(c))])).alias("check", "n_bad"))
