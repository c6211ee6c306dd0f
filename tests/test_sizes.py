"""Odd rows, ties of rounding, and growth with the size of the tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidemill.functions import arrow as A
from tidemill.functions import text as T
from tidemill.functions import words
from tidemill.operators import dedup, filters, guidelines, scoring, vectors
from tidemill.sources import tables as S


def test_csv_keeps_white_space_line_breaks_and_empty_texts(spark, tmp_path):
    texts = [None, "", "  lead", "trail  ", "\t", " ", "\r\n", "a\r\nb", "a\rb\r", "\r", "\n", '"', '\\"', "\\", 'a\\"b', '""', "a,b", "\x00", "\x85a ", "null", "#", 'x"\n,"y"']
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    S.write_csv(df, str(tmp_path / "csv"))
    got = S.read_csv(spark, str(tmp_path / "csv"), df.schema)
    assert got.schema == df.schema
    assert {r.id: r.text for r in got.collect()} == dict(enumerate(texts))


def test_line_repetition_rounds_and_splits_like_its_sql(spark, tmp_path):
    import duckdb

    from tidemill.plans.table_queries import c6_line_repetition
    from tidemill.plans.registry import ORACLE_SQL

    # 41 of 5120 characters is a half at the tenth place; the others have breaks, edges and emptiness of many kinds
    texts = ["x" * 41 + "\n" + "x" * 41 + "\n" + "y" * (5120 - 84), None, "", " ", "a\rb\ra", "\x85a\na", "\x0ba\na", "a\x1ca", " a\na a", "x\n\n\nx\n\nx\r"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: tuple(map(repr, r[1:])) for r in c6_line_repetition(spark, lambda name: docs).collect()}
    docs.write.parquet(str(tmp_path / "documents"))
    c = duckdb.connect()
    c.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents/*.parquet')")
    assert got == {r[0]: tuple(map(repr, r[1:])) for r in c.execute(ORACLE_SQL["c6_line_repetition"]).fetchall()}


def test_guideline_batches_are_worked_on_in_small_parts():
    """Python's memory goes with the part, not with the batch that Spark sends."""
    n, text = 3000, "one two three four five six seven eight nine ten eleven\n" * 4
    parts = pa.list_(pa.struct([("name", pa.string()), ("text", pa.string())]))
    for kind in ("wikidoc", "rch", "mayo", "nice"):
        b = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array([kind] * n), pa.array(["t"] * n), pa.array([text] * n), pa.array([None] * n, parts), pa.array([None] * n, pa.string())], ["doc_id", "kind", "title", "text", "sections", "overview"])
        got = list(guidelines.cleaned_batches([b]))
        assert sum(map(len, got)) == n and max(map(len, got)) <= 256
        assert pa.Table.from_batches(got).column("text").to_pylist() == [guidelines.guideline(kind, "t", text)[1]] * n


def test_slices_are_bounded_in_bytes():
    b = pa.RecordBatch.from_arrays([pa.array(["x" * 100_000] * 500)], ["t"])
    got = list(A.slices(b))
    assert sum(map(len, got)) == 500 and max(g.nbytes for g in got) <= 1 << 20
    assert list(A.slices(b.slice(0, 0))) == []


def test_sections_or_text_travel_to_the_rules(spark):
    rows = [(1, "mayo", "t", "own text", [("a", "some text")], "o"), (2, "nice", "t", "own text", None, "o"), (3, "rch", "t", "own text", [("a", "some text")], "o"), (4, "mayo", "t", None, [("a", "x")], "o"), (5, "mayo", "t", "own", [], "o")]
    df = spark.createDataFrame(rows, "doc_id long, kind string, title string, text string, sections array<struct<name: string, text: string>>, overview string")
    got = {r.doc_id: (r.title, r.text) for r in guidelines.clean_guidelines(df).collect()}
    parts = [(i, k, t, x, None if s is None else [{"name": a, "text": b} for a, b in s], o) for i, k, t, x, s, o in rows]
    want = {i: guidelines.guideline(k, t, x, s, o) for i, k, t, x, s, o in parts}
    assert got == {i: w for i, w in want.items() if w and w[1]}


def test_anchor_batches_are_worked_on_in_small_parts():
    words = [f"w{k}" for k in range(60)]
    b = pa.RecordBatch.from_arrays([pa.array(range(200)), pa.array([words] * 200)], ["id", "w"])
    got = list(dedup.anchor_batches([b], 25, 26))
    assert len(got) >= 200 / 16 and max(len(g) for g in got) <= 16 * len(dedup.anchors(words, 25, 26))
    assert pa.Table.from_batches(got).num_rows == 200 * len(dedup.anchors(words, 25, 26))


def _nearest(q, x, ids, k, places, mask=None):
    out = []
    for i in range(len(q)):
        d = vectors._round(((q[i] - x) ** 2).sum(1), places)
        order = np.lexsort((ids, d))
        order = order if mask is None else order[mask[i][order]]
        out += [(i, int(ids[j]), float(d[j])) for j in order[:k]]
    return out


def test_nearest_breaks_ties_of_rounded_distances_by_id():
    r = np.random.default_rng(1)
    x = r.normal(size=(9000, 8))
    x[100:6000] = x[50]
    q = np.concatenate([x[:150], x[6000:6150]])
    for ids in (np.arange(9000) * 3, r.permutation(9000)):
        for places in (9, 2):
            got = vectors.nearest(q, x, ids, 7, places=places)
            assert list(zip(*(g.tolist() for g in got))) == _nearest(q, x, ids, 7, places)
    far = q[:20] * 1e17
    assert list(zip(*(g.tolist() for g in vectors.nearest(far, far, np.arange(20), 1)))) == _nearest(far, far, np.arange(20), 1, 9)


def test_knn_in_blocks_of_a_bounded_size(spark, monkeypatch):
    """Tables of many blocks and a cell that is larger than one give what brute force gives."""
    r = np.random.default_rng(2)
    x = r.integers(0, 4, size=(1200, 4)).astype(float)
    x[:400] = x[0] + r.normal(size=(400, 4)) / 100
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<float>")
    x = x.astype(np.float32).astype(float)
    monkeypatch.setattr(vectors, "BLOCK_VALUES", 400)
    a, b = vectors._grid(spark, 1200, 1200, 4)
    assert a >= 12 and b >= 12
    q = df.filter("id % 4 = 0")
    got = sorted((g.query_id, g["rank"], g.vec_id, g.distance) for g in vectors.knn(q, df, 5, places=6).collect())
    want = _nearest(x[::4], x, np.arange(1200), 5, 6)
    assert got == [(4 * i, k % 5 + 1, j, d) for k, (i, j, d) in enumerate(want)]
    c = x[[0, 500, 700, 900, 1100]]
    got = sorted((g.query_id, g["rank"], g.vec_id, g.distance) for g in vectors.knn_cells(q, df, 5, c, 2).collect())
    near = np.argsort(vectors._distance(x[::4], c, "l2"), axis=1, kind="stable")[:, :2]
    mask = (vectors._distance(x, c, "l2").argmin(1)[None, :, None] == near[:, None, :]).any(2)
    want = _nearest(x[::4], x, np.arange(1200), 5, 9, mask)
    assert [(i, j, d) for i, _, j, d in got] == [(4 * i, j, d) for i, j, d in want]


def test_few_shot_sorts_no_pairs(spark, tmp_path):
    """The best of each row are taken from arrays before the window, also from several arrays and for rows that come twice."""
    import duckdb

    from tidemill.plans.registry import ORACLE_SQL
    from tidemill.plans.table_queries import i14_few_shot

    tables = {
        "conversations": spark.createDataFrame([(i // 2, i % 2, "user" if i % 3 else "system", "t") for i in range(60)] + [(1, 0, "user", "again")], "conv_id long, turn long, role string, text string"),
        "benchmark": spark.createDataFrame([(i, f"text {i}") for i in range(2500)], "item_id long, text string"),
    }
    df = i14_few_shot(spark, tables.__getitem__)
    plan = df._jdf.queryExecution().sparkPlan().toString()
    assert plan.index("Window") < plan.index("Generate") < plan.index("sort_array")  # from the top: pairs are in no sort
    c = duckdb.connect()
    for name, t in tables.items():
        t.write.parquet(str(tmp_path / name))
        c.execute(f"create view {name} as select * from read_parquet('{tmp_path}/{name}/*.parquet')")
    assert sorted(map(tuple, df.collect())) == sorted(c.execute(ORACLE_SQL["i14_few_shot"]).fetchall())


def test_repetition_of_many_texts_at_once():
    """Grams of a whole batch are sorted together; each text has what it has alone."""
    r = np.random.default_rng(3)
    sizes = [0, 1, 3, 200, 9, 60, 2, 500, 0]
    h = np.concatenate([r.integers(0, m, n) for n, m in zip(sizes, (1, 1, 1, 4, 1, 30, 1, 3, 1))]).astype(np.uint64)
    chars, at = (h.astype(np.int64) % 4) + 1, np.concatenate([[0], np.cumsum(sizes)])
    got = words.repetitions(h, chars, at, (2, 3, 4), (5, 6, 7, 8, 9, 10))
    assert got.shape == (9, 9)
    for k in range(9):
        a, b = at[k], at[k + 1]
        tokens, upto = h[a:b].tolist(), np.concatenate([[0], np.cumsum(chars[a:b])])
        want = []
        for n in (2, 3, 4):
            grams = [tuple(tokens[i : i + n]) for i in range(len(tokens) - n + 1)]
            best = max(grams, key=grams.count, default=None)
            i = grams.index(best) if grams else 0
            want.append(int(upto[i + n] - upto[i] + n - 1) * grams.count(best) if grams else 0)
        for n in (5, 6, 7, 8, 9, 10):
            seen, total, i = set(), 0, 0
            while i + n <= len(tokens):
                g = tuple(tokens[i : i + n])
                total += int(upto[i + n] - upto[i]) if g in seen else 0
                i += n if g in seen else 1
                seen.add(g)
            want.append(total)
        assert got[k].tolist() == want


def test_line_parts_are_made_once(spark):
    df = filters.repetition_reason(spark.createDataFrame([(1, "a\na")], "id long, text string"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("transform(split(text") == 1
    assert df.first().reason == "dup_line_frac"


def test_strip_takes_all_white_space(spark):
    got = spark.createDataFrame([(c, f"{chr(c)}a{chr(c)}") for c in range(1, 0x10000) if not 0xD800 <= c < 0xE000], "c int, t string").select("c", T.strip(F.col("t")).alias("s"), F.regexp_replace("t", r"(?U)^\s+|\s+$", "").alias("want"))
    assert got.filter("s <> want").count() == 0 and got.filter("s = 'a'").count() == len(T.SPACES)


def test_scrub_is_linear_in_a_line_and_the_same(spark):
    import random
    import time

    r = random.Random(5)
    bits = ["**", "*", "[", "]", "[**", "**]", "\n", "7", "12/3", "url", "URL ", "Holiday", " ", "clip number", "x", "\r", "é"]
    texts = ["".join(r.choice(bits) for _ in range(r.randrange(1, 25))) for _ in range(4000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = T.chain(F.col("t"), *((f"(?id){p}", "___") for p in T.SCRUB))
    assert df.select(T.scrub(F.col("t")).alias("a"), plain.alias("b")).filter("a <> b").count() == 0
    began = time.time()
    spark.createDataFrame([("**a b " * 40_000,)], "t string").select(F.length(T.scrub(F.col("t")))).collect()
    assert time.time() - began < 20  # every mark looked to the end of the line, seven times: minutes


def test_word_counts_shuffle_texts_and_scores_shuffle_sums(spark):
    docs = spark.createDataFrame([(i, "good fine" if i % 2 else "bad poor poor") for i in range(40)] + [(0, "bad")], "doc_id long, text string")
    counts = scoring.word_counts(docs)
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("Generate") < plan.index("Exchange")  # from the top: rows of words are made after it
    assert {(r.word, r.n) for r in counts.filter("doc_id = 0").collect()} == {("bad", 2), ("poor", 2)}
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("label")).distinct()
    model, prior = scoring.train_words(counts, labels)
    got = {r.doc_id: r.predicted for r in scoring.classify(docs, counts, model, prior).collect()}
    assert got == {i: i % 2 for i in range(40)}


def test_least_hashes_are_partial_minima():
    r = np.random.default_rng(4)
    ids, x = [5] * 300 + [7] + [5] * 20 + [9] * 40, r.integers(0, 1 << 28, 361)
    x[0], x[1] = 0, (1 << 28) - 1
    functions = [*dedup.permutations(112), (dedup.MERSENNE - 1, dedup.MERSENNE - 1), (1, dedup.MERSENNE)]
    b = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(x)], ["id", "x"])
    (got,) = dedup.least_hashes([b, b.slice(0, 0)], functions)
    assert got.column(0).to_pylist() == [5, 7, 5, 9]
    for k, (m, add) in enumerate(functions):
        h = [(int(v) * m + add) % dedup.MERSENNE for v in x]
        assert got.column(k + 1).to_pylist() == [min(h[:300]), h[300], min(h[301:321]), min(h[321:])]
