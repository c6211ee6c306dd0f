"""Each stage of the pipeline on its own input, against brute force."""

import corpus_pipeline
from pyspark.sql import functions as F

from tidemill.llm import ngram_join, quality, repair
from tidemill.llm.queries import QUERIES
from tidemill.llm.store import tables

from .test_operators import brute_pairs

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = tables(spark, SF, "documents")
    columns = docs.columns
    good = corpus_pipeline.good_documents(spark, docs, SF).cache()
    scored = quality.scored(docs, tables(spark, SF, "labels")).filter("quality_keep").select("doc_id")
    assert good.columns == columns and {r.doc_id for r in good.collect()} == {r.doc_id for r in scored.collect()}
    labels = {r.doc_id: r.quality for r in tables(spark, SF, "labels").collect()}
    kept = {r.doc_id for r in good.collect()}
    assert sum(i in kept for i, q in labels.items() if q == 1) >= 0.98 * sum(q == 1 for q in labels.values())

    first = corpus_pipeline.distinct_documents(spark, good, SF).cache()
    by = {}
    for r in sorted(good.collect()):
        by.setdefault(r.text, r.doc_id)
    assert first.columns == columns and {r.doc_id for r in first.collect()} == set(by.values())

    one = corpus_pipeline.near_duplicates(spark, first, SF).cache()
    texts = [(r.doc_id, r.text) for r in first.collect()]
    group = {i: i for i, _ in texts}

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for a, b in brute_pairs(texts):
        a, b = sorted((find(a), find(b)))
        group[b] = a
    assert one.columns == columns and {r.doc_id for r in one.collect()} == {find(i) for i in group}

    mixed = corpus_pipeline.mixed_documents(spark, one, SF).cache()
    assert mixed.columns == columns and {r.doc_id for r in mixed.collect()} <= {r.doc_id for r in one.collect()}

    coder = repair.encoding(open(repair.TOKENIZER, "rb").read())
    packed = corpus_pipeline.sequences(spark, mixed, SF).collect()
    assert sum(r.used for r in packed) == sum(len(coder.encode_ordinary(r.text)) for r in mixed.collect()) and max(r.used for r in packed) <= 2048


def test_run_and_registry(spark):
    import __spark_entry__

    assert corpus_pipeline.run(spark, SF).count() > 0
    names = __spark_entry__.queries()
    assert {f"op{n}" for n in range(1, 11)} == {k.split("_")[0] for k in QUERIES} and "pipeline" in names
    assert [s[0] for s in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "n-gram Jaccard join", "mixing sources to target weights", "best-fit packing"]


def test_recall_on_documents(spark):
    docs = tables(spark, SF, "documents")
    got = {(r.doc_a, r.doc_b) for r in ngram_join.ngram_jaccard_join(docs).collect()}
    assert got == brute_pairs([(r.doc_id, r.text) for r in docs.select("doc_id", F.col("text")).collect()])


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, quality_keep string, mix_copies int, digest string, class_id long, __gone long"


def test_stages_on_awkward_tables(spark):
    """Nulls, empty texts, repeated rows and clashing columns go through every stage; so does an empty table."""
    some = [r.text for r in tables(spark, SF, "documents").limit(40).collect()]
    rows = [(i, t, "en", None, 1, "mine", 7, "d", 5, 6) for i, t in [*enumerate(some), (0, some[0]), (None, "a text without an id"), (None, None), (900, None), (901, ""), (902, "!!! ...")]]
    for docs in (spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([], SCHEMA)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns
            docs = spark.createDataFrame(out.collect(), SCHEMA)
            assert all(r.quality_keep == "mine" and r.mix_copies == 7 for r in docs.collect())
        corpus_pipeline.sequences(spark, docs, SF).collect()
