"""Entities by a lexicon: a word join in place of a model, which any function of texts can replace."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lexicon_entities(docs: DataFrame, lexicon: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, entity, type, mentions): the words of a text that the lexicon (entity, type) has, whatever their case.

    Words are counted in each document before the join, so a word that all texts repeat costs a row a document. Null texts have none; an entity of several types is given with each.
    """
    word = F.explode(F.filter(F.split(F.lower(text_col), r"(?U)\W+"), lambda x: x != "")).alias("entity")
    seen = docs.select(id_col, word).groupBy(id_col, "entity").agg(F.count("*").alias("mentions"))
    known = lexicon.select(F.lower("entity").alias("entity"), "type").distinct()
    return seen.join(known, "entity").select(id_col, "entity", "type", "mentions")
