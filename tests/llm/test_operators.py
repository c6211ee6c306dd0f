"""Each dealt operator on awkward tables, and against brute force, round trips or held-out accuracy."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemill.llm import embedding_dups, exact_dedup, html_text, licenses, mixing, ngram_join, packing, quality, repair, tiles, warc
from tidemill.llm.store import new_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, cls long, size int, __gone long"
LONG = " ".join(f"w{i % 977}x{i}" for i in range(60_000))


def rows(texts):
    return [(i, t, "en", "s", len(t or ""), "d", 1, 2, 3) for i, t in texts]


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empty, long, repeated rows, ties, clashing column names."""
    text = "the quick brown fox jumps over the lazy dog and runs far away from here"
    return spark.createDataFrame(rows([(1, text), (2, text), (2, text), (3, None), (None, text), (None, None), (4, ""), (5, "!!! ..."), (6, "one"), (7, LONG), (8, LONG + " end"), (9, "été là où\x00")]), SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return re.findall("[\u3040-\u9fff]|[a-z0-9\x80-\x9f\xa1-\u1fff\u2080-\u2fff\ua000-\U0010ffff]+", t.lower())


def brute_pairs(texts, n=3, threshold=0.5):
    sets = {}
    for i, t in texts:
        if i is not None and t is not None and (w := words(t)):
            sets.setdefault(frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))), set()).add(i)
    found, classes = set(), [(min(v), s) for s, v in sets.items()]
    for v in sets.values():
        found |= {(min(v), x) for x in v if x != min(v)}
    for k, (a, s) in enumerate(classes):
        for b, t in classes[:k]:
            if a != b and len(s & t) >= threshold * len(s | t):
                found.add((min(a, b), max(a, b)))
    return found


def test_words_of_all_scripts():
    """Words are those of the rule, with ideographs one by one and typographic marks between words; no word crosses a text."""
    from tidemill.llm import text

    rng = random.Random(2)
    pieces = ["a", "B1", "é", "漢", "字", "かな", "、", "。", "“", "”", "–", "\xa0", " ", "\n", ",", "한글", "😀", "\u207f", "\u2080", "\u3000", "ü"]
    texts = ["", "漢", "“", *("".join(rng.choice(pieces) for _ in range(rng.randint(0, 12))) for _ in range(300))]
    got = text.word_counts(pa.array(texts, pa.large_string()))
    assert got.tolist() == [len(words(t)) for t in texts]
    h, at = text.words(pa.array(texts, pa.large_string()))
    same = {}
    for k, t in enumerate(texts):
        for x, w in zip(h[at[k] : at[k + 1]].tolist(), words(t)):
            assert same.setdefault(w, x) == x
    assert len(set(same.values())) == len(same)


def test_join_awkward(awkward, empty):
    got = {(r.doc_a, r.doc_b) for r in ngram_join.ngram_jaccard_join(awkward).collect()}
    assert got == {(1, 2), (7, 8)}
    assert ngram_join.ngram_jaccard_join(empty).count() == 0
    every = {(r.doc_a, r.doc_b) for r in ngram_join.ngram_jaccard_join(awkward, expand=True).collect()}
    assert every == got
    rows = {r.doc_id: (r.class_id, r.links) for r in ngram_join.near_copies(awkward).collect()}
    assert rows == {1: (1, 1), 2: (1, 1), 7: (7, 1), 8: (7, 1)} | {i: (i, 0) for i in (3, 4, 5, 6, 9)}
    assert ngram_join.near_copies(empty).count() == 0
    left = ngram_join.one_of_each(awkward)
    assert left.columns == awkward.columns
    assert sorted(r.doc_id for r in left.filter("doc_id is not null").collect()) == [1, 3, 4, 5, 6, 7, 9]
    assert left.filter("doc_id is null").count() == 2


def test_join_recall(spark):
    rng = random.Random(5)
    vocabulary = [f"t{i}" for i in range(3000)]
    texts = []
    for base in range(60):
        w = rng.choices(vocabulary, k=rng.choice([5, 20, 60, 150, 700, 3000]))
        texts.append((len(texts), " ".join(w)))
        for share in (0.02, 0.05, 0.1):
            texts.append((len(texts), " ".join(x if rng.random() > share else rng.choice(vocabulary) for x in w)))
    want = brute_pairs(texts)
    got = {(r.doc_a, r.doc_b) for r in ngram_join.ngram_jaccard_join(spark.createDataFrame(rows(texts), SCHEMA)).collect()}
    assert got <= want and len(got) >= 0.97 * len(want)


def test_join_hot_groups(spark):
    """A group far larger than `hot` loses no pair."""
    rng = random.Random(6)
    base = [f"t{i}" for i in range(120)]
    texts = []
    for i in range(90):
        w = list(base)
        w[rng.randrange(120)] = f"u{i}"
        texts.append((i, " ".join(w)))
    got = {(r.doc_a, r.doc_b) for r in ngram_join.ngram_jaccard_join(spark.createDataFrame(rows(texts), SCHEMA), hot=8).collect()}
    want = brute_pairs(texts)
    assert len(want) == 90 * 89 // 2 and len(got & want) >= 0.97 * len(want) and got <= want


@pytest.mark.parametrize(("count", "words", "last"), [(100, 4, True), (100, 6, True), (100, 8, True), (100, 12, True), (130, 16, False)])
def test_join_hot_groups_of_short_texts(spark, count, words, last):
    """Short texts whose words are all hot lose no pair, nor does a text that shares one hot word alone; the shortest are below the threshold."""
    rng = random.Random(words)
    base = [f"t{i}" for i in range(words)]
    texts = []
    for i in range(count):
        w = list(base)
        w[-1 if last else rng.randrange(words)] = f"u{i}"
        texts.append((i, " ".join(w)))
    texts += [(count, " ".join(base[:-1])), (count + 1, " ".join(base + ["z1", "z2"]))]
    got = {(r.doc_a, r.doc_b) for r in ngram_join.ngram_jaccard_join(spark.createDataFrame(rows(texts), SCHEMA)).collect()}
    want = brute_pairs(texts)
    assert len(want) > (0 if words == 4 else count) and got == want


def links_of(texts, pairs):
    """(smallest id of the group, links) of each text by brute force; pairs has all pairs."""
    group, links = {i: i for i, _ in texts}, {i: 0 for i, _ in texts}

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for a, b in pairs:
        links[a] += 1
        links[b] += 1
        a, b = sorted((find(a), find(b)))
        group[b] = a
    return {i: (find(i), links[i]) for i, _ in texts}


def brute_all(texts, n=3, threshold=0.5):
    sets = {i: frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) for i, t in texts if (w := words(t or ""))}
    return {(a, b) for a, s in sets.items() for b, t in sets.items() if a < b and len(s & t) >= threshold * len(s | t)}


@pytest.mark.parametrize(("hot", "block", "tile"), [(64, 4096, 1 << 15), (4, 5, 7)])
def test_links_with_copies_in_hot_groups(spark, hot, block, tile):
    """Classes of copies, hot words in many blocks and split tiles: each document's class and links are those of brute force."""
    rng = random.Random(8)
    base = [f"t{i}" for i in range(40)]
    texts = []
    for i in range(45):
        w = list(base)
        w[rng.randrange(40)] = f"u{i % 30}"
        texts += [(len(texts) + k, " ".join(w)) for k in range(rng.choice([1, 1, 1, 4]))]
    texts += [(1000 + i, " ".join([*base[:3], *(f"x{i}y{k}" for k in range(20))])) for i in range(12)] + [(2000, ""), (2001, None)]
    docs = spark.createDataFrame(rows(texts), SCHEMA)
    got = {r.doc_id: (r.class_id, r.links) for r in ngram_join.near_copies(docs, hot=hot, block=block, tile_pairs=tile).collect()}
    every = brute_all(texts)
    assert got == links_of(texts, every) and len(every) > 1500
    assert {(r.doc_a, r.doc_b) for r in ngram_join.ngram_jaccard_join(docs, hot=hot, block=block, expand=True).collect()} == every


def test_hot_words_stream_over_batches():
    """Groups that go on over batches, with repeated rows at the seams, are dealt out whole, in blocks, under one label."""
    rng = np.random.default_rng(2)
    key = np.sort(rng.choice([1, 2, 3, 4, 5], 400, p=[0.01, 0.5, 0.04, 0.4, 0.05]))
    cls = rng.integers(0, 150, 400)
    order = np.lexsort((cls, key))
    key, cls = key[order], cls[order]
    size = np.full(400, 10)
    batches = [pa.RecordBatch.from_arrays([pa.array(key[i : i + 37]), pa.array(cls[i : i + 37]), pa.array(size[i : i + 37])], ["key", "cls", "size"]) for i in range(0, 400, 37)]
    hot, pairs, groups = {}, set(), {k: sorted(set(cls[key == k].tolist())) for k in set(key.tolist())}
    for b in ngram_join._meet(0.5, 20, 16)(iter(batches)):
        for x, y, _, label, block in zip(*(c.to_pylist() for c in b.columns)):
            if label is None:
                pairs.add((x, y))
            else:
                hot.setdefault((x, label), []).append((y, block))
    assert {k: [c for c, _ in v] for (k, _), v in hot.items()} == {k: g for k, g in groups.items() if len(g) > 20}
    assert all(label == groups[k][0] and [b for _, b in v] == [i // 16 for i in range(len(v))] for (k, label), v in hot.items())
    assert pairs == {(a, b) for g in groups.values() if len(g) <= 20 for a in g for b in g if a < b}


def test_hot_pairs_are_compared_as_cold_ones():
    """Every pair within the threshold passes, over size bands, and no other than the sketches allow."""
    rng = np.random.default_rng(3)
    base = np.unique(rng.integers(0, 1 << 63, 220, dtype=np.uint64) * np.uint64(2))
    sets = [base[:n][rng.random(n) > 0.1] for n in (60, 80, 95, 100, 120, 150, 190, 200, 220) for _ in range(4)]
    js = [ngram_join.bands(len(s), 96, 0.5) for s in sets]
    bits = np.array([[ngram_join.bit_sketch(s, j).view(np.uint64) for j in (*b, *b)[:2]] for s, b in zip(sets, js)])
    size, band = np.array([len(s) for s in sets]), np.array([b[0] for b in js])
    got = [tuple(p) for block in ngram_join._near(np.arange(len(sets)), size, band, bits, 0.5) for p in block.tolist()]
    want = {(a, b) for b in range(len(sets)) for a in range(b) if len(np.intersect1d(sets[a], sets[b])) >= 0.5 * len(np.union1d(sets[a], sets[b])) and {*js[a]} & {*js[b]}}
    assert len(got) == len(set(got)) and want <= set(got) and len(want) > 300


def test_parity_bounds():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a = np.unique(rng.integers(0, 1 << 63, rng.integers(1, 90), dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) > 0.1], rng.integers(0, 1 << 63, 5, dtype=np.uint64)]))
        apart = len(np.setxor1d(a, b))
        x, y = ngram_join.bit_sketch(a, 0), ngram_join.bit_sketch(b, 0)
        assert sum(int(v & (1 << 64) - 1).bit_count() for v in (x ^ y).tolist()) <= apart
        if apart < 20:
            assert set(ngram_join.sketch(a, 0).tolist()) & set(ngram_join.sketch(b, 0).tolist())


@pytest.mark.parametrize("few", [0, 1000])
def test_components(spark, few):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (100, 105), (7, 3), (5, 5)]
    got = {r.id: r.group for r in tiles.components(spark.createDataFrame(edges, "doc_a long, doc_b long"), few=few).collect()}
    assert got == {i: 0 for i in range(31)} | {100: 100, 101: 100, 105: 100}
    assert tiles.components(spark.createDataFrame([], "doc_a long, doc_b long"), few=few).count() == 0


def test_exact_dedup(spark, awkward, empty):
    index = exact_dedup.DigestIndex(spark, new_path(spark, "index"), 4)
    kept = exact_dedup.exact_dedup(awkward, index, "one")
    assert kept.columns == awkward.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, i) for i in (1, 3, 4, 5, 6, 7, 8, 9)] + [(True, 0)]
    again = exact_dedup.exact_dedup(awkward.unionByName(spark.createDataFrame(rows([(50, "new"), (50, "new")]), SCHEMA)), index, "two")
    assert sorted((r.doc_id or 0, r.text) for r in again.collect()) == sorted([(50, "new"), (3, None), (0, None)], key=lambda x: (x[0], x[1] or ""))
    assert exact_dedup.exact_dedup(empty, index, "three").count() == 0
    reopened = exact_dedup.DigestIndex(spark, index.path, 9)
    assert reopened.buckets == 4 and reopened.read().count() == 8 and reopened.read().select("digest").distinct().count() == 8
    retried = exact_dedup.exact_dedup(awkward, reopened, "one")
    assert sorted(str(r) for r in retried.collect()) == sorted(str(r) for r in kept.collect()) and reopened.read().count() == 8
    small = exact_dedup.DigestIndex(spark, new_path(spark, "index"), 4)
    beyond = exact_dedup.exact_dedup(awkward, small, "one", broadcast_rows=0)  # the join without broadcasts
    assert sorted(str(r) for r in beyond.collect()) == sorted(str(r) for r in kept.collect())


def junk(rng, i):
    w = [rng.choice(["stone", "river", "the", "of", "walk", "green", "house", "and"]) + rng.choice(["", "s", "ed"]) for _ in range(rng.randint(8, 200))]
    if i % 4 == 0:
        return 0, " ".join(x + rng.choice(["###", "&&&", "***"]) for x in w)
    if i % 4 == 1:
        return 0, " ".join([w[0]] * len(w))
    return 1, " ".join(w).capitalize() + "."


def test_quality(spark, awkward, empty):
    rng = random.Random(3)
    made = [(i, *junk(rng, i)) for i in range(900)]
    docs = spark.createDataFrame(rows([(i, t) for i, _, t in made]), SCHEMA)
    labels = spark.createDataFrame([(i, y, None) for i, y, _ in made[:500]] + [(None, 1, 1), (7000, None, 0), (2, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.scored(docs, labels).collect()}
    held = [i for i, _, _ in made[500:]]
    assert np.mean([got[i].quality_keep == bool(made[i][1]) for i in held]) > 0.97
    assert all(0 <= r.quality_score <= 1 for r in got.values())
    odd = quality.scored(awkward, labels)
    assert odd.columns[: len(awkward.columns)] == awkward.columns and odd.count() == awkward.count()
    assert {(r.quality_score, r.quality_keep) for r in odd.filter("text is null or text in ('', '!!! ...')").collect()} == {(0.0, False)}
    none = quality.scored(awkward, labels.limit(0))
    assert none.filter("quality_keep and quality_score is null").count() == awkward.count()
    one = quality.scored(docs, labels.filter("quality = 1").filter("doc_id < 400"))
    assert {r.quality_score for r in one.collect()} == {1.0}
    assert quality.scored(empty, labels).count() == 0


def test_clashing_names(spark, awkward):
    """Results keep the caller's columns of the same names, and their own output can be their input."""
    labels = spark.createDataFrame([(1, 1, 1), (7, 0, 0), (9, 0, 1)], "doc_id long, quality int, toxic int")
    mine = awkward.withColumn("quality_score", F.lit(-1.0)).withColumn("quality_keep", F.lit("mine"))
    got = quality.scored(mine, labels)
    assert got.columns == [*mine.columns, "_quality_score", "_quality_keep"] and {(r.quality_score, r.quality_keep) for r in got.collect()} == {(-1.0, "mine")}
    assert quality.good(mine, labels).columns == mine.columns and quality.good(mine, labels).filter("quality_keep = 'mine'").count() == got.filter("_quality_keep").count()
    domains = spark.createDataFrame([(1, "a"), (7, "b"), (9, "b")], "doc_id long, domain string")
    once = mixing.mixed(awkward, domains, {"a": 1.0, "b": 2.0})
    twice = mixing.mixed(once, domains, {"a": 2.0, "b": 1.0})
    assert twice.columns == [*once.columns, "_mix_tokens", "_mix_posterior", "_mix_rate", "_mix_copies"] and twice.count() == once.count()
    assert sorted((r.doc_id or 0, r.mix_copies) for r in twice.collect()) == sorted((r.doc_id or 0, r.mix_copies) for r in once.collect())
    copies = sorted(r.doc_id or 0 for r in mixing.repeated(once, domains, {"a": 1.0, "b": 2.0}).collect())
    assert copies == sorted(i for r in once.collect() for i in [r.doc_id or 0] * r.mix_copies)


def test_quality_against_brute_force(spark):
    """The fitted model is the ridge regression and the isotonic fit that plain formulas on all labelled rows give."""
    rng = random.Random(12)
    made = [(i, *junk(rng, i)) for i in range(400)]
    made = [(i, y if rng.random() > 0.1 else 1 - y, t) for i, y, t in made]
    docs = spark.createDataFrame(rows([(i, t) for i, _, t in made] + [(3, "another text of the same id, labelled with it")]), SCHEMA)
    labels = spark.createDataFrame([(i, y) for i, y, _ in made], "doc_id long, quality int")
    model = quality.fit(docs, labels, features=32, penalty=1e-2)
    held = {r.doc_id: r.held for r in docs.select("doc_id", (F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(10)) < 3).alias("held")).collect()}
    every = [*made, (3, made[3][1], "another text of the same id, labelled with it")]
    stats = quality.statistics(pa.array([t for _, _, t in every], pa.large_string()))
    y, out = np.array([y for _, y, _ in every], float), np.array([held[i] for i, _, _ in every])
    x = np.clip((stats[:, :-1] - stats[:, :-1].mean(0)) / np.where(stats[:, :-1].std(0) > 1e-9, stats[:, :-1].std(0), 1), -8, 8)
    z = np.column_stack([np.cos(x @ model.weights + model.phase) * np.sqrt(2 / 32), np.ones(len(x))])
    lam = 1e-2 * (~out).sum() / 32
    ridge = np.linalg.lstsq(np.vstack([z[~out], np.sqrt(lam) * np.eye(33)]), np.concatenate([y[~out], np.zeros(33)]), rcond=None)[0]
    assert np.allclose(model.raw(stats), z @ ridge, atol=1e-6)
    bins = np.clip(np.floor((z[out] @ ridge + 1) / 3 * 512), 0, 511)
    edges = np.unique(bins)
    sums, sizes = np.array([y[out][bins == b].sum() for b in edges]), np.array([(bins == b).sum() for b in edges])
    fitted = [max(min(sums[a : b + 1].sum() / sizes[a : b + 1].sum() for b in range(k, len(edges))) for a in range(k + 1)) for k in range(len(edges))]
    assert np.allclose(model.levels, fitted)
    got = {r.text: r.quality_score for r in quality.scored(docs, labels, features=32, penalty=1e-2).collect()}
    want = {t: s for (_, _, t), s in zip(every, model.score(stats))}
    assert got == pytest.approx(want)


def brute_rates(p, n, goal, rounds=20000):
    """The least residual that nonnegative rates can reach, by plain projected gradient on every rate."""
    a = p * n[:, None]
    r, step = np.ones(len(a)), 1 / np.linalg.norm(a, 2) ** 2
    for _ in range(rounds):
        r = np.maximum(0, r - step * (a @ (r @ a - goal)))
    return float(((r @ a - goal) ** 2).sum())


@pytest.mark.parametrize("targets", [{"a": 2.0, "b": 1.0}, {"a": 1.0, "b": 0.0}, {"a": 9.0, "b": 1.0}])
def test_mixing_against_brute_force(spark, targets):
    """The residual is the least one, where targets can be met and where they can't."""
    rng = random.Random(5)
    vocabulary = {"a": [f"a{i}" for i in range(20)], "b": [f"b{i}" for i in range(20)]}
    made = [(i, d := rng.choice("aab"), " ".join(rng.choice(vocabulary[d] if rng.random() < 0.7 else vocabulary["ab"[d == "a"]]) for _ in range(rng.randint(1, 12)))) for i in range(150)]
    docs = spark.createDataFrame(rows([(i, t) for i, _, t in made]), SCHEMA)
    labelled = spark.createDataFrame([(i, d) for i, d, _ in made], "doc_id long, domain string")
    got = mixing.mixed(docs, labelled, targets).collect()
    p, n, r = np.array([x.mix_posterior for x in got]), np.array([x.mix_tokens for x in got], float), np.array([x.mix_rate for x in got])
    goal = np.array([targets["a"], targets["b"]]) / sum(targets.values()) * n.sum()
    mine = float((((n * r) @ p - goal) ** 2).sum())
    assert (r >= 0).all() and mine <= brute_rates(p, n, goal) + 5e-3 * float((goal**2).sum())


def test_normal_equations_and_isotonic():
    assert quality.isotonic(np.array([0.1, 0.5, 0.3, 0.9]), np.array([1, 1, 3, 1])).tolist() == pytest.approx([0.1, 0.35, 0.35, 0.9])
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(40, 5)), rng.normal(size=40)
    parts = sum(np.column_stack([a.T @ a, a.T @ b]) for a, b in zip(np.split(x, 4), np.split(y, 4)))
    assert np.allclose(parts, np.column_stack([x.T @ x, x.T @ y]))


def test_mixing(spark, awkward, empty):
    rng = random.Random(4)
    vocabulary = {"a": [f"a{i}" for i in range(60)], "b": [f"b{i}" for i in range(60)], "c": [f"a{i}" for i in range(30)] + [f"b{i}" for i in range(30)]}
    made = [(i, d := rng.choice("aaaabc"), " ".join(rng.choices(vocabulary[d], k=rng.randint(5, 80)))) for i in range(1500)]
    docs = spark.createDataFrame(rows([(i, t) for i, _, t in made]), SCHEMA)
    labelled = spark.createDataFrame([(i, d) for i, d, _ in made[:600]] + [(None, "a"), (5, None)], "doc_id long, domain string")
    targets = {"a": 2.0, "b": 1.0, "c": 1.0}
    got = mixing.mixed(docs, labelled, targets).collect()
    total = sum(r.mix_tokens for r in got)
    for k, want in enumerate((0.5, 0.25, 0.25)):
        assert sum(r.mix_tokens * r.mix_posterior[k] * r.mix_rate for r in got) == pytest.approx(want * total, rel=0.01)
        assert all(r.mix_rate >= 0 and abs(r.mix_copies - r.mix_rate) < 1 for r in got)
    sure = [max(range(3), key=lambda k: r.mix_posterior[k]) == "abc".index(made[r.doc_id][1]) for r in got if r.doc_id >= 600]
    assert np.mean(sure) > 0.9
    odd = mixing.mixed(awkward, labelled, targets)
    assert odd.count() == awkward.count() and odd.filter("text is null or text = ''").agg(F.max("mix_copies")).first()[0] == 0
    assert mixing.mixed(empty, labelled, targets).count() == 0
    assert len({r.mix_rate for r in mixing.mixed(docs, labelled.limit(0), targets).collect()}) == 1


def brute_two_fit(lengths, capacity):
    """The same rule, by search through lists."""
    left, bins = sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)), []
    while left:
        inside, gap = [], capacity
        while fit := [k for k in left if lengths[k] <= gap]:
            inside.append(fit[0])
            left.remove(fit[0])
            gap -= lengths[fit[0]]
        if gap and left and len(inside) > 1:
            room, least = gap + lengths[inside[-1]], lengths[inside[-1]]
            pairs = [(lengths[a] + lengths[b], max(lengths[a], lengths[b])) for x, a in enumerate(left) for b in left[x + 1 :] if least < lengths[a] + lengths[b] <= room]
            if pairs:
                best = max(pairs)
                first = next(k for k in left if lengths[k] == best[1])
                second = next(k for k in left if lengths[k] == best[0] - best[1] and k != first)
                left.remove(first)
                left.remove(second)
                back = inside.pop()
                inside += [first, second]
                left = sorted([*left, back], key=lambda k: (-lengths[k], k))
        bins.append(inside)
    return bins


def test_best_two_fit():
    rng = random.Random(7)
    for _ in range(60):
        capacity = rng.choice([10, 50, 200])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 60))]
        got, want = packing.best_two_fit(lengths, capacity), brute_two_fit(lengths, capacity)
        assert [sorted(lengths[k] for k in b) for b in got] == [sorted(lengths[k] for k in b) for b in want]
        assert sorted(k for b in got for k in b) == list(range(len(lengths))) and all(sum(lengths[k] for k in b) <= capacity for b in got)


@pytest.mark.parametrize("tokenizer", [None, repair.TOKENIZER])
def test_packing(awkward, empty, tokenizer):
    coder = repair.encoding(open(repair.TOKENIZER, "rb").read())
    count = (lambda t: len(words(t))) if tokenizer is None else lambda t: len(coder.encode_ordinary(t))
    got = packing.pack(awkward, 2048, 5, tokenizer=tokenizer).collect()
    pieces = sorted((i is None, i or 0, s, n) for r in got for i, s, n in zip(r.doc_ids, r.starts, r.lengths))
    size = [(r.doc_id, count(r.text or "")) for r in awkward.collect()]
    assert sum(p[3] for p in pieces) == sum(n for _, n in size) == sum(r.used for r in got) and max(r.used for r in got) <= 2048
    assert sorted(p[2] for p in pieces if p[1] == 7) == list(range(0, dict(size)[7], 2048))
    assert not {3, 4} & {p[1] for p in pieces} and (tokenizer is None) == (5 not in {p[1] for p in pieces}) and packing.pack(empty).count() == 0


def test_warc(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/1", "<p>x</p>", 9), (2, "http://a/2", "<p>x</p>", 9), (3, None, "é" * 200_000, 9), (None, "http://b\r\nX: y", "", 9), (5, "u", None, 9), (5, "u", "z", 9), (5, "u", "z", 9)], "page_id long, url string, html string, offset long")
    files = warc.write(pages, f"file://{tmp_path}/w", file_bytes=300)
    index = warc.index(files)
    assert index.count() == 6
    got = sorted((r.record_id or 0, r.url, r.html) for r in warc.read(index, gap=10, span=100).collect())
    assert got == sorted([(1, "http://a/1", "<p>x</p>"), (2, "http://a/2", "<p>x</p>"), (3, None, "é" * 200_000), (0, "http://b%0D%0AX: y", ""), (5, "u", "z"), (5, "u", "z")])
    some = warc.read(index.filter("record_id in (2, 3)")).collect()
    assert sorted(r.record_id for r in some) == [2, 3]
    assert sorted(r.record_id or 0 for r in warc.read(warc.first_of_digest(index)).collect()) == [0, 1, 3, 5]
    assert warc.round_trip(spark, pages.limit(0)).count() == 0


def test_warc_cut_file(tmp_path):
    import io

    data = b"".join(__import__("gzip").compress(warc._record(i, "u", "x" * i)) for i in range(5))
    assert len(list(warc.members(io.BytesIO(data), 7))) == 5
    assert len(list(warc.members(io.BytesIO(data[:-3])))) == 4
    assert list(warc.members(io.BytesIO(b"not gzip"))) == []
    spans = [(a, n) for a, n, _ in warc.members(io.BytesIO(data), 11)]
    assert all(data[a : a + 2] == b"\x1f\x8b" for a, _ in spans) and sum(n for _, n in spans) == len(data)


def test_repair_round_trip(awkward, empty):
    coder = repair.encoding(open(repair.TOKENIZER, "rb").read())
    got = repair.token_shards(awkward, shard_bytes=100_000, min_count=4).collect()
    rules = {r.shard: r for r in got if r.kind == "rules"}
    docs = [r for r in got if r.kind == "doc"]
    assert len(docs) == awkward.count()
    texts = []
    for r in docs:
        if r.symbols is None:
            assert r.n_tokens is None
            texts.append(None)
            continue
        g = rules[r.shard]
        ids = repair.decode(r.symbols, g.symbols, g.lengths, coder.n_vocab)
        assert len(ids) == r.n_tokens
        for a, b in ((0, 3), (5, 6), (r.n_tokens // 2, r.n_tokens), (r.n_tokens, r.n_tokens + 2)):
            assert repair.decode(r.symbols, g.symbols, g.lengths, coder.n_vocab, a, b) == ids[a:b]
        texts.append(coder.decode(ids))
        assert ids == coder.encode_ordinary(texts[-1])
    assert sorted(map(str, texts)) == sorted(str(r.text) for r in awkward.collect())
    assert repair.token_shards(empty).count() == 0


def test_repair_leaves_no_frequent_pair():
    rng = np.random.default_rng(2)
    for s in (rng.integers(0, 4, 3000), np.zeros(1000, np.int64), np.arange(50)):
        at = np.array([0, len(s) // 3, len(s)])
        out, place, rules = repair.compress(s, at, 100, 6)
        size = repair.expansion_lengths(rules, 100)
        flat = repair.decode(out.astype("<i4").tobytes(), rules.astype("<i4").tobytes(), size.astype("<i4").tobytes(), 100)
        assert flat == s.tolist()
        left = [p for a, b in zip(place, place[1:]) for p in zip(out[a:b].tolist(), out[a + 1 : b].tolist())]
        assert not left or max(sum(p == q for q in left) for p in set(left)) < 6


def plain_repair(docs, first, min_count):
    """Re-Pair one pair at a time, the most frequent first, by lists; (symbols, rules)."""
    rules = 0
    while True:
        count = {}
        for d in docs:
            last = None
            for k, p in enumerate(zip(d, d[1:])):
                if last != (p, k - 1):  # overlapping places of a run count every other time
                    count[p] = count.get(p, 0) + 1
                    last = (p, k)
                else:
                    last = None
        if not count or max(count.values()) < min_count:
            return sum(map(len, docs)), rules
        best, out = min(count, key=lambda p: (-count[p], p)), []
        for d in docs:
            new, k = [], 0
            while k < len(d):
                if tuple(d[k : k + 2]) == best:
                    new.append(first + rules)
                    k += 2
                else:
                    new.append(d[k])
                    k += 1
            out.append(new)
        docs, rules = out, rules + 1


def test_repair_is_as_small_as_plain_repair():
    """Rounds of many pairs give grammars about as small as one pair at a time does, and no rule is used once in the text alone."""
    rng = np.random.default_rng(6)
    phrases = [rng.integers(0, 40, rng.integers(2, 12)) for _ in range(60)]
    for few in (60, 15):
        docs = [np.concatenate([phrases[min(few - 1, int(rng.exponential(few / 4)))] for _ in range(rng.integers(5, 60))]) for _ in range(60)]
        at = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
        out, place, rules = repair.compress(np.concatenate(docs), at, 100, 6)
        symbols, plain = plain_repair([d.tolist() for d in docs], 100, 6)
        assert len(out) + 2 * len(rules) <= 1.05 * (symbols + 2 * plain)
        size = repair.expansion_lengths(rules, 100).astype("<i4").tobytes()
        assert all(repair.decode(out[a:b].astype("<i4").tobytes(), rules.astype("<i4").tobytes(), size, 100) == d.tolist() for a, b, d in zip(place, place[1:], docs))
        used = np.bincount(np.concatenate([out, rules.ravel()]), minlength=100 + len(rules))[100:]
        text_once = set(out[np.isin(out, np.flatnonzero(used == 1) + 100)].tolist())
        assert not text_once


def test_repair_ties_take_the_smaller_pair():
    """Of equally frequent overlapping pairs the smaller pair of ids is replaced."""
    s = np.array([1, 2, 3] * 10)
    out, _, rules = repair.compress(s, np.array([0, *range(3, 31, 3)]), 100, 6)
    assert rules[0].tolist() == [1, 2]


class Counted:
    """A coder that counts the characters it is given."""

    def __init__(self, coder):
        self.coder, self.chars = coder, 0

    def encode_ordinary(self, text):
        self.chars += len(text)
        return self.coder.encode_ordinary(text)


def test_repair_encodes_each_different_word_once():
    """Ids of odd texts are the coder's own, and a word that comes again isn't encoded again."""
    coder = repair.encoding(open(repair.TOKENIZER, "rb").read())
    width = repair.widths(coder)
    rng = random.Random(4)
    odd = [*"abZ019''.,!-   \n\n\t\r\v\f\x00\x01\x1c\x1f\x7f", "'s", "'ll", "'re", "é", "ß", "中", "😀", "٣", "½", "\u0301", "\u00a0", "\u0085", "\u2003", "\u3000", "\u200b", "\ufeff"]
    tables = [[""], [None], ["é", "中中", " é"], ["  ", " a", "\n", "'"], ["中" * 3000]]
    tables += [["".join(rng.choices(odd[: rng.choice([12, 27, 99])], k=rng.randrange(40))) for _ in range(rng.randrange(1, 120))] for _ in range(150)]
    for table in tables + [t * 3 for t in tables]:  # with most words different, and with none that is there once
        ids, at = repair.token_ids(pa.array([t or "" for t in table], pa.large_string()), coder, width)
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [coder.encode_ordinary(t or "") for t in table]
    counted = Counted(coder)
    words = [f"word{k}, né{k} don't" for k in range(50)]
    texts = [" ".join(rng.choices(words, k=40)) for _ in range(200)]
    repair.token_ids(pa.array(texts, pa.large_string()), counted, width)
    assert counted.chars < sum(map(len, texts)) / 20


def test_repair_goes_by_other_patterns(spark):
    """A pattern of the caller's own has other parts than the default one."""
    pattern = r"[^ ]+ ?| "
    coder = repair.encoding(open(repair.TOKENIZER, "rb").read(), pattern)
    texts = ["it's a test, isn't it  1a", "", "x y"]
    got = repair.token_shards(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), pattern=pattern, min_count=99).filter("kind = 'doc'").collect()
    assert {r.doc_id: np.frombuffer(r.symbols, np.int32).tolist() for r in got} == {k: coder.encode_ordinary(t) for k, t in enumerate(texts)}


def brute_vectors(x, threshold=0.95):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    cos = unit @ unit.T
    return {(int(a), int(b)) for a, b in zip(*np.where(cos >= threshold)) if a < b}


def test_embeddings(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(1500, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    near = base[:400] + rng.normal(size=(400, 64)) * rng.choice([0.01, 0.02, 0.03, 0.035], 400)[:, None]
    x = np.concatenate([base, near])
    data = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)]
    odd = [(None, data[0][1], 1), (9000, None, 1), (9001, [], 1), (9002, [0.0] * 64, 1), (9003, [float("nan")] * 64, 1), (9004, [1.0, 0.0], 1), (9005, [1.0, 0.0], 1), (5, data[5][1], 1), (9006, [1.0, None], 1)]
    v = spark.createDataFrame(data + odd, "vec_id long, embedding array<double>, class_id int")
    want = brute_vectors(x)
    for bucket in (10_000, 200):
        rows = embedding_dups.near_duplicates(v, bucket_rows=bucket).collect()
        got = {(r.vec_a, r.vec_b) for r in rows}
        assert len(rows) == len(got) and (9004, 9005) in got
        got.discard((9004, 9005))
        assert got <= want and len(got) >= 0.97 * len(want)
    got = {r.vec_id: (r.class_id, r.links) for r in embedding_dups.near_copies(v).collect()}
    assert len(got) == len(x) + 7 and got[9005] == (9004, 1) and all(got[i] == (i, 0) for i in (9000, 9001, 9002, 9003, 9006))
    assert embedding_dups.near_copies(v.limit(0)).count() == 0 and embedding_dups.near_duplicates(v.limit(0)).count() == 0


def test_tight_clusters_of_embeddings(spark):
    """Groups of near copies beyond the bucket size, in blocks and split tiles, and many equal vectors: links of brute force at the recall that the plan states."""
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(3, 64))
    x = np.concatenate([c + rng.normal(size=(n, 64)) * s for c, n, s in zip(centre, (260, 150, 90), (0.05, 0.15, 0.17))] + [rng.normal(size=(200, 64)), np.repeat(rng.normal(size=(1, 64)), 120, 0)])
    order = rng.permutation(len(x))
    x = x[order]
    want = brute_vectors(x, 0.95)
    links, docs = np.zeros(len(x), int), spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    for a, b in want:
        links[a] += 1
        links[b] += 1
    equal = order >= 700
    for options in ({}, {"bucket_rows": 40, "tile_pairs": 50}):
        got = sorted(embedding_dups.near_copies(docs, **options).collect())
        assert [r.vec_id for r in got] == list(range(len(x)))
        found = np.array([r.links for r in got])
        assert (found <= links).all() and found.sum() >= 0.97 * links.sum() and (found[equal] == 119).all()
        assert {r.class_id for r in got if equal[r.vec_id]} == {int(np.flatnonzero(equal)[0])}


def naive_extract(body):
    """The rule by recursion over a tree of (tag, class, kids): scores, the best container, its siblings and their text."""
    up, order = {}, []

    def walk(n, parent):
        up[id(n)] = parent
        order.append(n)
        for k in n[2]:
            if not isinstance(k, str):
                walk(k, n)

    walk(body, None)
    text = lambda n: n if isinstance(n, str) else "".join(text(k) for k in n[2])
    flat = lambda n: re.sub(r"\s+", " ", text(n)).strip()
    pieces = lambda n: [n] if isinstance(n, str) else [x for k in n[2] for x in pieces(k)]
    chars = lambda n: sum(len(re.sub(r"\s+", " ", x)) for x in pieces(n) if x.strip())
    links = lambda n: 0 if isinstance(n, str) else chars(n) if n[0] == "a" else sum(links(k) for k in n[2])
    score = {}
    for n in order:
        block = any(not isinstance(k, str) and k[0] in html_text._BLOCK for k in n[2])
        if (n[0] in ("p", "blockquote", "td") or n[0] == "div" and not block) and len(t := flat(n)) >= 25:
            points, at = 1 + t.count(",") + min(3, len(t) // 100), n
            for part in (1, 0.5):
                at = up[id(at)]
                if at is None:
                    break
                start = {"div": 5, "article": 10, "blockquote": 3}.get(at[0], 0) + 25 * ("content" in at[1]) - 25 * ("menu" in at[1])
                score.setdefault(id(at), start)
                score[id(at)] += part * points
    if not score:
        return None
    for n in order:
        if id(n) in score:
            score[id(n)] *= 1 - links(n) / max(1, chars(n))
    best = max((n for n in order if id(n) in score), key=lambda n: score[id(n)])
    family = up[id(best)][2] if up[id(best)] else [best]
    keep = []
    for k in family:
        if k is best or not isinstance(k, str) and score.get(id(k), -1e9) >= max(10, 0.2 * score[id(best)]):
            keep.append(k)
        elif not isinstance(k, str) and k[0] == "p":
            c, dense = chars(k), links(k) / max(1, chars(k))
            if c > 80 and dense < 0.25 or 0 < c <= 80 and not dense and text(k).rstrip().endswith("."):
                keep.append(k)
    lines = lambda n: n if isinstance(n, str) else (("\n" * (n[0] in html_text._BLOCK)) + "".join(lines(k) for k in n[2]) + "\n" * (n[0] in html_text._BLOCK))
    shown = [" ".join(x.split()) for x in "".join(lines(k) for k in keep).split("\n")]
    return "\n".join(x for x in shown if x), score[id(best)]


def test_html_against_recursion():
    rng = random.Random(11)

    def made(depth):
        kids = [rng.choice(["", "some words, here and there, ", "short. ", "a sentence that goes on for a while, with a comma or two, and then ends. "]) for _ in range(rng.randint(0, 2))]
        if depth:
            kids += [make(rng.choice(["div", "div", "article", "p", "blockquote", "span"]), depth - 1) for _ in range(rng.randint(0, 4))]
        rng.shuffle(kids)
        return [k for k in kids if k]

    def make(tag, depth):
        if tag in ("p", "span"):
            inner = ["prose, and more prose, to be scored, at some length. " * rng.randint(0, 3), ("a", "", ["linked words "]) if rng.random() < 0.3 else "tail."]
            return (tag, "", [k for k in inner if k])
        return (tag, rng.choice(["", "", "content", "menu"]), made(depth))

    show = lambda n: n if isinstance(n, str) else f"<{n[0]}{f' class={n[1]}' if n[1] else ''}>{''.join(map(show, n[2]))}</{n[0]}>"
    scored = 0
    for _ in range(400):
        body = ("body", "", made(4))
        want = naive_extract(body)
        got = html_text.extract("<html>" + show(body) + "</html>")
        if want is None:
            assert got[1] == 0
        else:
            scored += 1
            assert got[1] == pytest.approx(want[1], abs=1e-5) and got[0] == want[0]
    assert scored > 200


@pytest.mark.parametrize("page", ["<blockquote>" * 100_000 + "text, " * 20, "<b>" * 50_000 + "<p>" * 50_000, "<b>" * 50_000 + "</x>" * 50_000, "<!" * 100_000, "<![CDATA[" * 100_000, "<script " * 100_000, "<table><tr><td>" * 33_000, "<ul><li><b>x" * 33_000])
def test_html_takes_time_in_proportion(page):
    import time

    began = time.process_time()
    html_text.extract(page)
    assert time.process_time() - began < 4  # the quadratic walks took minutes


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var x="<p>no</p>";</script></head><body><nav><a href=/>Home, sweet, home, and more words here</a></nav>
<div class="sidebar"><p>Buy now, buy cheap, buy often, buy here, and buy again today.</p></div>
<article><h1>Head</h1><p>First paragraph, with commas, and enough words to count for something at all.<p>Second &amp; last paragraph, also long enough, with a <a href=x>link</a> in it.</article><footer>&copy; someone</footer></body></html>"""


def test_html(spark):
    text, score = html_text.extract(PAGE)
    assert text.split("\n") == ["Head", "First paragraph, with commas, and enough words to count for something at all.", "Second & last paragraph, also long enough, with a link in it."]
    deep = "<div>" * 5000 + "<p>" + "word, " * 50 + "</p>" + "</div>" * 5000
    assert html_text.extract(deep)[0].startswith("word,")
    assert html_text.extract(None) == (None, None) and html_text.extract("") == ("", 0.0)
    assert html_text.extract("just text <b>here") == ("just text here", 0.0)
    assert html_text.extract("a < b <!-- c") [0].startswith("a < b")
    two = "<div><p>" + "one, " * 20 + "</p></div>"
    assert html_text.extract(f"<body>{two}{two}</body>")[0].count("one,") >= 20
    pages = spark.createDataFrame([(1, PAGE, "t"), (1, PAGE, "t"), (None, None, None)], "page_id long, html string, text string")
    assert [r.found.text is None for r in pages.select(html_text.extracted(F.col("html")).alias("found")).collect()] == [False, False, True]
    assert pages.limit(0).select(html_text.extracted(F.col("html")).alias("found")).count() == 0


def lis_brute(pairs):
    best = 0
    for mask in range(1 << len(pairs)):
        ys = [p[1] for k, p in enumerate(pairs) if mask >> k & 1]
        if all(a < b for a, b in zip(ys, ys[1:])):
            best = max(best, len(ys))
    return best


def test_patience():
    rng = random.Random(9)
    for _ in range(200):
        b = [rng.randint(0, 9) for _ in range(rng.randint(0, 12))]
        a = [x for x in b if rng.random() > 0.2] + [rng.randint(0, 9) for _ in range(rng.randint(0, 5))]
        pairs = licenses.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
        y = rng.sample(range(20), rng.randint(0, 9))
        assert len(licenses._increasing(list(enumerate(y)))) == lis_brute(list(enumerate(y)))
    assert len(licenses.patience(list("abcdef"), list("abcdef"))) == 6


def coverage_brute(words, template):
    """The longest common subsequence of a whole text and a template, by the plain table."""
    best = [0] * (len(template) + 1)
    for w in words:
        above = 0
        for j, t in enumerate(template, 1):
            above, best[j] = best[j], above + 1 if w == t else max(best[j], best[j - 1])
    return best[-1]


def test_licenses_wherever_they_are(spark):
    """Copies with 0.6 of their length put between the words, and 12 in 100 words lost, at every offset: each is found, and never more than the longest common subsequence."""
    rng = random.Random(13)
    scanner = licenses.Scanner(licenses.TEMPLATES, 0.8, 0.55)
    split = lambda t: re.findall(r"[a-z0-9]+", t.lower())
    for name in ("MIT", "BSD-3-Clause", "Apache-2.0-header", "MIT-line", "GPL-3.0-line"):
        t = split(licenses.TEMPLATES[name])
        spread = [x for i, w in enumerate(t) for x in ([w, f"z{i}"] if i % 5 < 3 else [w])]
        lost = [w for i, w in enumerate(t) if i % 8 != 3 or len(t) < 20]
        for copy, full in ((spread, True), (lost, False), (t, True)):
            texts = [" ".join([f"q{i}" for i in range(at)] + copy + ["tail"] * 7) for at in range(0, 2 * len(t) + 3, max(1, len(t) // 20))]
            found = {(r, k): (c, m) for r, k, c, _, _, m in scanner.scan(pa.array(texts))}
            for r, text in enumerate(texts):
                assert (r, name) in found and (found[r, name][0] == 1.0) >= full and found[r, name][1] <= coverage_brute(split(text), t)


def test_licenses_with_stray_words(spark):
    """Common words of the template before and after a copy don't hide it."""
    rng = random.Random(14)
    scanner = licenses.Scanner(licenses.TEMPLATES, 0.8, 0.6)
    for name, t in licenses.TEMPLATES.items():
        copy = re.findall(r"[a-z0-9]+", t.lower())
        if len(copy) > 20:
            copy[len(copy) // 3] = "changed"
        for _ in range(12):
            noise = [rng.choice(copy) if rng.random() < 0.3 else f"n{rng.randint(0, 99)}" for _ in range(rng.randint(0, 80))]
            found = {k for _, k, *_ in scanner.scan(pa.array([" ".join([*noise, *copy, *noise[::-1]])]))}
            assert name in found


def test_licenses_defined_results(spark):
    t = licenses.TEMPLATES["GPL-3.0-line"]
    docs = spark.createDataFrame([(None, t, 1), (1, t, 1), (1, t, 1), (2, f"{t} {t}", 1), (3, None, 1), (4, "", 1)], "doc_id long, text string, license int")
    got = sorted(((r.doc_id, r.first_word, r.matched) for r in licenses.scan(docs).filter("license = 'GPL-3.0-line'").collect()), key=str)
    assert got == sorted([(None, 0, 12), (1, 0, 12), (1, 0, 12), (2, 0, 12)], key=str)


def test_licenses(spark, awkward, empty):
    rng = random.Random(10)
    filler = [f"f{i}" for i in range(200)] + ["the", "license", "under", "version"]
    made, want = [], {}
    for i in range(80):
        w = rng.choices(filler, k=rng.randint(0, 400))
        if i % 2:
            name = rng.choice(sorted(licenses.TEMPLATES))
            t = licenses.TEMPLATES[name].split()
            if len(t) > 20 and i % 4 == 1:
                t[rng.randrange(len(t))] = "changed"
            at = rng.randint(0, len(w))
            w[at:at] = t * rng.choice([1, 1, 3])
            want[i] = name
        made.append((i, " ".join(w)))
    got = {}
    for r in licenses.scan(spark.createDataFrame(rows(made), SCHEMA)).collect():
        got.setdefault(r.doc_id, set()).add(r.license)
    assert set(got) == set(want) and all(want[i] in got[i] for i in want)
    assert licenses.scan(awkward).count() == 0 and licenses.scan(empty).count() == 0
