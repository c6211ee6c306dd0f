"""The reference's own operators: hand-made cases, brute force, and the registry without the llm folders."""

import random
import subprocess
import sys

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemill.functions import arrow as A
from tidemill.functions import text as T
from tidemill.functions import words
from tidemill.operators import dedup, entities, filters, guidelines, pack, sampling, scoring, vectors, windows
from tidemill.sources import tables


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("f", "given", "want"),
    [
        (T.token_count, "a, b.", 3),
        (T.token_count, "été là", 2),
        (T.normalize_sections, "\n## A\n### B\n##### C", "\n# A\n## B\n### C"),
        (T.deepen_headers, "# A\nb\n## C", "## A\nb\n### C"),
        (T.clinical_lines, "A :  b\n\n\nC", "A: b\n\nC"),
        (T.scrub, "seen by [**Last Name 12**] today", "seen by ___ today"),
        (T.normalize_web, " a  b\t\tc \n\n\n d ", "a b c\n\nd"),
        (T.remove_references, "a [1] b [x](y) <i>c", "a  c"),
        (T.answer_letter, "# ANSWER  C\n**********# ANSWER A", "C"),
    ],
)
def test_text(spark, f, given, want):
    assert one(spark, f(F.col("t")), t=given) == want


def test_numbers(spark):
    assert [one(spark, T.human_number(F.col("n")), n=n) for n in (999, 50_000, 1_000_000)] == ["999", "50k", "1mn"]
    assert [one(spark, T.rescale(F.col("n")), n=n) for n in (1, 4)] == [0.0, 1.0]
    assert one(spark, scoring.likert(F.array(*[F.lit(1.0)] * 4)), n=1) == pytest.approx(2.5)


def test_sequential_text():
    text = "Intro\n# Introduction x\nfoo 1\n123\nReferences\nz"
    assert A.truncate(text, ["introduction"], [], ["references"]) == "# Introduction x\nfoo 1"
    assert A.group_headers(["# H", "one two three", "# G"], 3) == ["# H\none two three", "# G"]
    assert A.in_context_path([("A", "B", 4), ("B", "C", 2), ("A", "C", 3), ("B", "D", 3), ("E", "F", 3), ("F", "D", 3)]) == list("EFDBAC")
    assert A.note_sections(A.segments("Chief Complaint: chest pain")) == [{"header": "Chief Complaint:", "text": "chest pain"}]
    assert A.repair_encoding("caf\\u00e9 [1, 2] ﬁne") == "café fine"
    assert A.annotated_article("Results body cite end", [{"start": 0, "end": 7, "kind": "header"}, {"start": 13, "end": 17, "kind": "ref"}]) == "## Results\nbody end"
    assert A.html_sections("<h2>One</h2><p>a b c d e f<table><tr><td>no</table><h2>References</h2><p>a b c d e f")[0] == {"header": "One", "text": "a b c d e f"}


def plain_repetition(words, n):
    """(characters of the commonest n-gram, characters in repeated n-grams), by strings and lists."""
    grams = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]
    best = max(grams, key=grams.count, default="")
    seen, chars, i = [], 0, 0
    while i <= len(words) - n:
        gram = words[i : i + n]
        if gram in seen:
            chars, i = chars + len("".join(gram)), i + n
        else:
            seen.append(gram)
            i += 1
    return len(best) * grams.count(best), chars


def test_repetition():
    rng = random.Random(1)
    for _ in range(150):
        text = "".join(rng.choice(["a", "bb", "été", "_", ",", "x1", "𝔸", "…"]) + rng.choice([" ", " ", "", "\n"]) for _ in range(rng.randint(0, 40)))
        plain = __import__("regex").findall(r"[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_ \n]", text)
        points, off = next(words.chunks(pa.array([text])))
        start, end, _, word = words.tokens(points, off)
        assert [text[a:b] for a, b in zip(start, end)] == plain
        got = words.repetition(words.token_hashes(points, start, end), end - start, (2, 3, 4), (5, 6))
        assert got == [plain_repetition(plain, n)[0] for n in (2, 3, 4)] + [plain_repetition(plain, n)[1] for n in (5, 6)]


def test_word_stats(spark):
    """Words, their characters, those with letters, stop words; nulls and empty texts have none; long texts go over chunks."""
    long = "the cat " * 60_000
    d = spark.createDataFrame([(1, "the cat, and THE dog_1 _ 42 …!"), (2, None), (3, ""), (4, long), (5, "with")], "id long, t string")
    got = {r.id: tuple(r.w) for r in d.select("id", filters.word_stats(F.col("t")).alias("w")).collect()}
    assert got == {1: (7, 3 + 3 + 3 + 3 + 5 + 2 + 1, 5, 2), 2: (0, 0, 0, 0), 3: (0, 0, 0, 0), 4: (120_000, 360_000, 120_000, 60_000), 5: (1, 4, 1, 1)}


def test_filter_keeps_all_rows_with_reasons(spark):
    d = spark.createDataFrame([(1, "", "a"), (2, "x\nx\nx\ny", "a"), (3, "the cat is of the house and with us. " * 2, "a"), (4, "", "b")], "doc_id long, text string, source string")
    got = {r.doc_id: r.reason for r in filters.filter_driver(d, {"b"}).collect()}
    assert got[1] == "empty" and got[2] == "dup_line_frac" and got[3] is not None and got[4] is None


BODY = "This two three four five six seven eight nine ten eleven"


@pytest.mark.parametrize(
    ("kind", "title", "text", "want"),
    [
        ("aafp", "Flu | AAFP", "x\n## Recommendation\na b c\nuse it | now\nFlu\ndo this\n## References\nz", ("Flu", "Flu\n\n# Recommendation\ndo this")),
        ("aafp", "Flu", "The AAFP supports the guideline of others on this topic.\nmore", None),
        ("cco", None, "cover\nQUESTIONS to ask\n• treat early\ntwo words\no give it to them\nThis report is copyrighted by us", (None, "QUESTIONS to ask\n- treat early\n- give it to them")),
        ("cdc_diseases", "Travel", "### Disease Directory\nx", None),
        ("cdc_diseases", "Travel", "top\n### Yellow Fever\n* get a **shot** now\n+ get two more shots\nask your insurance about it\nAfter Travel\nz", ("Yellow Fever", "Travel\n\n### Yellow Fever\n-  get a shot now\n- get two more shots\n")),
        ("cdc", "t", "# ALL CAPS\nq first item\n• \n body \nAcknowledgments\nz", ("t", "# All Caps\n- first item\nbody")),
        ("cma", None, "Title\nOverview here\nTable 1 things\na | b\nkept line\nReferences\nz", ("Title", "Title\nOverview here\nkept line")),
        ("cma_pdfs", None, "12\n3. treat them\n#.\nrest\nFunding by us", (None, "- treat them\nrest")),
        ("cps", None, "x\n### Abstract of it all\nshort one\nthis line is kept\nsee Figure 3 for more\nthis one as well\nSelected resources", (None, "### Abstract of it all\nthis line is kept\nthis one as well")),
        ("cps", None, "### Abstract of it all\nonly this line", None),
        ("drugs", "Pill - side effects", "* [menu\nTake (by mouth) [one] pill\na | b\n--done", ("Pill", "Take  one pill\ndone")),
        ("gc", "Title", "Title Document Objectives\nAIMS OF IT\n" + f"{BODY}\n" * 3 + "(c)\nDisclaimer", ("", f"Document Objectives\n\n# AIMS OF IT\n{BODY}\n{BODY}\n{BODY}")),
        ("gc", "t", "Document Objectives\n" + BODY, None),
        ("icrc", None, "1first aid\n12\nplain\nContacts\nz", (None, "- first aid\nplain")),
        ("idsa", None, "Name\nIntroduction\n1. do this\n2. do , that .\n* a\nb (c )\nd\nNotes\nz", ("Name", "Name\nIntroduction\n- do this\n- do that.\n a\nb (c\nd")),
        ("idsa", None, "Name\nThis new guideline is currently in development", None),
        ("magic", None, "skip\nLoading Data...\nfirst\nAbstract\n1\nTreatment\n2\ngive it\nand more\n3\nFunding of it\n4\nsomebody\nend\nend", (None, "Abstract\n\n# Treatment\ngive it\nand more")),
        ("who", "t", "x\nIntroduction to all of it\ntwo words\n• give them water\nAcknowledgements\nz", ("t", "Introduction to all of it\n- give them water")),
        ("spor", None, "a b c|\ntwo words\nd e f---g h i\nCONFLICT OF INTEREST none", (None, "a b c\nd e f\ng h i")),
        ("wikidoc", "n", "Editor-In-Chief: x\n" + f"{BODY}\n" * 3 + "Any recommendations found on these pages are\nhidden\n## Next\nCLASS 1\nshown Redirect to this\nExternal links\nz", ("n", f"{BODY}\n{BODY}\n{BODY}\n\n# Next\nshown")),
        ("wikidoc", "n", BODY, None),
        ("rch", "n", " as it is [1] ", ("n", " as it is [1] ")),
        ("nobody", "n", "x", None),
        ("who", "n", None, None),
    ],
)
def test_guidelines(kind, title, text, want):
    assert guidelines.guideline(kind, title, text) == want


def test_guidelines_of_sections(spark):
    parts = [{"name": "Use", "text": "take [1] it\nby MayoClinic\n"}, {"name": "Update", "text": "new\n"}, {"name": "Committee discussion", "text": "said\n"}]
    assert guidelines.guideline("mayo", "n", None, parts) == ("n", "# Use\ntake  it\n# Update\nnew\n# Committee discussion\nsaid".replace("it\n#", "it\n\n#").replace("new\n#", "new\n\n#"))
    assert guidelines.guideline("nice", "n", None, parts, "about") == ("n", "n\n\nabout\n\n# Use\ntake  it\nby MayoClinic\n\n# Committee discussion\nsaid")
    assert guidelines.guideline("nice", "n", None, parts[1:2]) is None
    rows = [(1, "spor", None, "a b c", None, None), (2, "nice", "n", None, [("Use", "x y\n")], "o"), (3, "who", "n", None, None, None)]
    d = spark.createDataFrame(rows, "doc_id long, kind string, title string, text string, sections array<struct<name: string, text: string>>, overview string")
    assert {r.doc_id: r.text for r in guidelines.clean_guidelines(d).collect()} == {1: "a b c", 2: "n\n\no\n\n# Use\nx y"}
    assert guidelines.clean_guidelines(d.drop("sections", "overview").limit(0)).count() == 0


@pytest.mark.parametrize("mark", ["[**Serial Number 3**]", "[**Known patient lastname 7**]", "[**2101-3-4**]", "[**7-12**]", "[**1/1990**]", "[** **]", "[**Doctor First Name**]", "[**Hospital Ward**]", "[**Holiday 7**]", "**1991**", "[**Age over 90 **]", "[**Clip Number (Radiology) 9**]", "[**Social Security Number**]", "[**Country**]", "[**URL 8**]", "[**Telephone/Fax 1**]", "[**Pager number 4**]", "[**State**]", "[**Month**]", "[**Company 3**]", "[**Job Number 5**]", "[**Unit Number 6**]", "[**Attending Info**]", "[**Dictator**]", "[**Contact Info 1**]", "[**University/College**]", "[**Street Address**]"])
def test_scrub_marks(spark, mark):
    assert len(T.SCRUB) == 32
    assert one(spark, T.scrub(F.col("t")), t=f"a {mark} b") == "a ___ b"


def test_html_children():
    page = "<body><p>no<div class=main><h2>Head</h2><section><h3>One</h3><p>a <b>b</b></p><ul><li>x<li>y z</ul>tail</section><section><h3>References</h3><p>gone</section></div>"
    assert A.html_children(page, "div") == "## Head\n\n## One\na b\n- x\n- y z\ntail"
    assert A.html_children("") == ""


def test_stratified_exact_is_a_ranking(spark):
    d = spark.range(3000).select("id", F.when(F.col("id") < 2500, "a").otherwise("b").alias("source"), F.lit(10).alias("num_tokens"))
    for cells in (1, 7, 4096):
        got = {r.id for r in sampling.stratified_exact(d, 100, "id", cells=cells).collect()}
        want = set()
        for s, n in (("a", 84), ("b", 17)):
            want |= {r.id for r in d.filter(F.col("source") == s).orderBy(T.hash_draw(F.col("id")), "id").limit(n).collect()}
        assert got == want


def test_resumed_and_named(spark, tmp_path):
    d = spark.createDataFrame([(i, f"s{i % 3}") for i in range(30)], "id long, shard string")
    tables.enrich(d.filter("id < 10"), f"{tmp_path}/e", "id", lambda rows: [{"id": r["id"], "n": r["id"] * 2} for r in rows], "id long, n long")
    tables.enrich(d, f"{tmp_path}/e", "id", lambda rows: [{"id": r["id"], "n": -1} for r in rows], "id long, n long")
    assert {r.id: r.n for r in spark.read.parquet(f"{tmp_path}/e").collect()} == {i: i * 2 if i < 10 else -1 for i in range(30)}
    for _ in range(2):
        tables.process_shards(d, f"{tmp_path}/s", lambda rows: rows.withColumn("x", F.lit(1)))
    assert spark.read.parquet(f"{tmp_path}/s").count() == 30
    blocks = spark.createDataFrame([(i, [i] * 4) for i in range(23)], "block_id long, input_ids array<int>")
    tables.write_matrix(blocks, f"file://{tmp_path}/m", 4, 5)
    got = sorted((r.block_id, r.input_ids) for r in tables.read_matrix(spark, f"file://{tmp_path}/m", 4, 10, 5).collect())
    assert got == [(i, [i] * 4) for i in range(20)]
    assert (tmp_path / "m" / "00000002.i4").stat().st_size == 5 * 4 * 4


def test_word_classifier(spark):
    """Against the plain formula; unknown words say nothing, texts without words get the commonest label, and without labels there is none."""
    rng = random.Random(4)
    made = [(i, y := rng.choice([0, 1, 1]), " ".join(rng.choice("abcdef"[y : y + 5]) for _ in range(rng.randint(1, 20)))) for i in range(120)]
    docs = spark.createDataFrame([(i, t) for i, _, t in made] + [(500, None), (501, "zz zz")], "doc_id long, text string")
    counts = scoring.word_counts(docs)
    labels = spark.createDataFrame([(i, y) for i, y, _ in made[:80]] + [(3, made[3][1]), (None, 1), (9999, 0)], "doc_id long, label int")
    got = {r.doc_id: r.predicted for r in scoring.classify(docs, counts, *scoring.train_words(counts, labels)).collect()}
    from collections import Counter
    from math import log

    n = {y: Counter(w for _, z, t in made[:80] if z == y for w in t.split()) for y in (0, 1)}
    v, docs_of = len(set(n[0]) | set(n[1])), Counter(y for _, y, _ in made[:80])
    score = lambda t, y: log(docs_of[y]) + sum(log((n[y][w] + 1) / (n[y].total() + v)) for w in t.split() if w in n[0] or w in n[1])
    assert got == {i: max((round(score(t, y), 6), y) for y in (0, 1))[1] for i, _, t in made} | {500: 1, 501: 1}
    none = scoring.classify(docs, counts, *scoring.train_words(counts, labels.limit(0)))
    assert {r.predicted for r in none.collect()} == {None}


def test_entities(spark):
    docs = spark.createDataFrame([(1, "Aspirin and aspirin, not IBUPROFEN"), (2, None), (3, "")], "doc_id long, text string")
    lexicon = spark.createDataFrame([("ASPIRIN", "drug"), ("aspirin", "drug"), ("ibuprofen", "drug"), ("x", "y")], "entity string, type string")
    assert sorted(map(tuple, entities.lexicon_entities(docs, lexicon).collect())) == [(1, "aspirin", "drug", 2), (1, "ibuprofen", "drug", 1)]


def test_every_long_repeat_has_an_anchor(spark):
    """Passages of the least length planted at any offset are found, shorter repeats than a gram aren't; nulls and short texts have none."""
    rng = random.Random(3)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    passage = fresh(20)
    texts = [fresh(rng.randint(0, 60)) + passage + fresh(rng.randint(0, 60)) for _ in range(30)] + [fresh(80) for _ in range(10)] + [fresh(20) + passage[:9] + fresh(20)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(100, None), (101, ""), (102, "one two")]
    got = dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"), 20).collect()
    assert {r.doc_id for r in got if r.first_doc == 0} == set(range(1, 30)) and all(r.first_doc < r.doc_id < 30 for r in got)


def test_span_dedup_takes_rows_of_any_kind(spark):
    """Nulls, empty and short texts, repeats inside a text, and the reference's bound."""
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a\nb"), (4, "x\ny\nz\nx\ny\nz"), (5, "q\nx\ny\nz")], "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_cut) for r in dedup.span_dedup(docs).collect()}
    assert got == {1: (None, None), 2: ("", 0), 3: ("a\nb", 0), 4: ("x\ny\nz", 3), 5: ("q", 3)}
    assert {r.doc_id for r in dedup.span_dedup(docs, most=5).collect()} == {2, 3, 5}


def test_sampling(spark):
    d = spark.range(1000).select(F.col("id"), F.lit("s").alias("source"), F.lit(10).alias("num_tokens"))
    few = sampling.token_budget(d, 2500, ["id"])
    assert few.count() == 250
    ranked = {r.id for r in d.orderBy(T.hash_draw(F.col("id"), 7), "id").limit(250).collect()}
    assert {r.id for r in few.collect()} == ranked
    weights = spark.createDataFrame([("s", 2.9)], "source string, weight double")
    assert sampling.mixture_copies(d, weights, "id").count() == 2000
    assert sampling.mixture_copies(d.withColumn("source", F.lit("z")), weights, "id").count() == 0


def test_windows_and_packing(spark):
    d = spark.range(200).select("id", F.transform(F.sequence(F.lit(1), F.pmod("id", F.lit(7)) + 1), lambda x: x.cast("int")).alias("ids"))
    assert [r.n for r in windows.global_row_number(d, "id", "n").orderBy("id").collect()] == list(range(200))
    blocks = [r.input_ids for r in pack.pack_blocks(d, "id", "ids", 16).orderBy("block_id").collect()]
    flat = [x for i in range(200) for x in range(1, i % 7 + 2)]
    assert [x for b in blocks for x in b] == flat[: len(flat) // 16 * 16]


def test_dedup(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (7, 8), (3, 9)], "a long, b long")
    for few in (0, 100):
        assert {r.id: r.cluster for r in dedup.components(edges, few).collect()} == {1: 1, 2: 1, 3: 1, 9: 1, 7: 7, 8: 7}
    docs = spark.createDataFrame([(1, "a\nb\nc\nd"), (2, "x\nb\nc\nd\ny")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in dedup.span_dedup(docs).collect()}
    assert got == {1: "a\nb\nc\nd", 2: "x\ny"}


def test_knn_cells_recall(spark):
    """Against the exact neighbours of all vectors, not only of those that chose the probes."""
    from tidemill.queries import QUERIES

    exact, cells = ({(r.query_id, r.vec_id) for r in QUERIES[q](spark, "/root/testdata/sf0.01").collect()} for q in ("l4_knn_exact", "l4_knn_cells"))
    assert len(cells) == len(exact) and len(exact & cells) >= 0.9 * len(exact)


def test_context_path_walks_every_vector(spark):
    """No edge between labels is cut: the walk of a component is the plain search over all its edges."""
    from tidemill.queries import QUERIES

    got = QUERIES["l5_context_path"](spark, "/root/testdata/sf0.01").collect()
    ids = [r.vec_id for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id").collect()]
    assert sorted(r.vec_id for r in got) == sorted(ids)
    paths = {}
    for r in sorted(got, key=lambda r: (r.cluster, r.pos)):
        paths.setdefault(r.cluster, []).append(r.vec_id)
    near = QUERIES["l4_knn_exact"](spark, "/root/testdata/sf0.01").filter("rank <= 4 and query_id <> vec_id").collect()
    group = {x: c for c, path in paths.items() for x in path}
    graph = {}
    for a, b in sorted({(min(r.query_id, r.vec_id), max(r.query_id, r.vec_id)) for r in near}):
        assert group[a] == group[b]
        graph.setdefault(a, set()).add(b)
        graph.setdefault(b, set()).add(a)
    place = {x: i for i, x in enumerate(graph)}
    for path in paths.values():
        left = {x: set(graph[x]) for x in path}
        while path:
            first = min(left, key=lambda x: (len(left[x]), place[x]))
            gone = {first} | left[first]
            assert path[0] == first and set(path[: len(gone)]) == gone
            path = path[len(gone) :]
            left = {x: y - gone for x, y in left.items() if x not in gone}


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_imports_without_llm(tmp_path):
    code = "import sys; sys.modules['tidemill.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; print(len(e.queries()), any(k.startswith('op') for k in e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd="/root/repo" if __file__.startswith("/root/repo") else ".", check=True).stdout.split()
    assert int(out[0]) > 100 and out[1] == "False"
