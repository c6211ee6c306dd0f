"""Sources, sinks, deduplication, scores, vectors, packing, instructions, concepts and guidelines."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import arrow as A
from ..functions import text as T
from ..operators import dedup, entities, pack, sampling, scoring, vectors, windows
from ..sources import tables as S
from .registry import query
from .table_queries import DOCS, WEIGHTS, corpus, draw

ALL = "select doc_id, text, lang, source, n_chars from documents"
_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _place(spark, name):
    return dedup.shared_path(spark, name)


# sources and sinks: what is written is read back


@query(ALL)
def a1_parquet(spark, load):
    path = _place(spark, "a1")
    S.write_parquet(load("documents"), path)
    return S.read_parquet(spark, path)


@query(ALL)
def a4_gzip_jsonl(spark, load):
    path = _place(spark, "a4")
    S.write_jsonl(load("documents"), path)
    return S.read_jsonl(spark, path, _SCHEMA)


@query("select conv_id, turn, role from conversations")
def a5_lenient_jsonl(spark, load):
    """Half of the lines are broken; they are skipped."""
    path = _place(spark, "a5")
    good = load("conversations").select(F.to_json(F.struct("conv_id", "turn", "role")).alias("value"))
    good.unionByName(good.select(F.concat(F.lit("{"), "value").alias("value"))).write.text(path)
    return S.read_jsonl(spark, path, "conv_id long, turn long, role string", lenient=True).filter("conv_id is not null")


@query(ALL)
def a6_csv(spark, load):
    path = _place(spark, "a6")
    S.write_csv(load("documents"), path)
    return S.read_csv(spark, path, _SCHEMA)


@query("select o_orderkey, year(o_orderdate)::int as year from orders")
def a7_year_files(spark, load):
    path = _place(spark, "a7")
    S.write_csv(load("orders").withColumn("y", F.year("o_orderdate")).select("o_orderkey", "y"), path + "-2001")
    return S.read_csv(spark, path + "-2001", "o_orderkey long, y int").select("o_orderkey", F.col("y").alias("year"))


@query("select n_nationkey, n_name, n_regionkey from nation")
def a8_piped_table(spark, load):
    path = _place(spark, "a8")
    load("nation").write.csv(path, sep="|", quote="")
    return S.read_piped(spark, path, "n_nationkey int, n_name string, n_regionkey int")


@query("select r_name title, n_name context, n_nationkey::varchar id, 'Where?' question, n_nationkey % 2 = 0 is_impossible, [n_name, r_name] answers from nation join region on n_regionkey = r_regionkey")
def a9_nested_qa(spark, load):
    n = load("nation").join(F.broadcast(load("region")), F.col("n_regionkey") == F.col("r_regionkey"))
    qa = F.struct(F.col("n_nationkey").cast("string").alias("id"), F.lit("Where?").alias("question"), (F.col("n_nationkey") % 2 == 0).alias("is_impossible"), F.array(F.struct(F.col("n_name").alias("text")), F.struct(F.col("r_name").alias("text"))).alias("answers"))
    para = F.struct(F.col("n_name").alias("context"), F.array(qa).alias("qas"))
    data = n.groupBy(F.col("r_name").alias("title")).agg(F.collect_list(para).alias("paragraphs")).agg(F.collect_list(F.struct("title", "paragraphs")).alias("data"))
    path = _place(spark, "a9")
    data.write.json(path)
    return S.nested_qa(spark.read.schema(S.QA).json(path))


@query("select p_partkey::varchar id, p_name as name, p_size as size from part")
def a10_keyed_object(spark, load):
    one = load("part").select(F.to_json(F.create_map(F.col("p_partkey").cast("string"), F.struct(F.col("p_name").alias("name"), F.col("p_size").alias("size")))).alias("value"))
    path = _place(spark, "a10")
    one.write.text(path)
    return S.keyed_object(S.read_lines(spark, path), "value", "struct<name: string, size: int>").select("id", "value.name", "value.size")


@query("select doc_id::varchar as value from labels where toxic = 1")
def a12_line_list(spark, load):
    path = _place(spark, "a12")
    S.write_lines(load("labels").filter("toxic = 1"), "doc_id", path)
    return S.read_lines(spark, path)


@query("select doc_id from documents")
def a13_key_from_raw_lines(spark, load):
    path = _place(spark, "a13")
    load("documents").select("doc_id", "lang").write.json(path)
    return S.read_lines(spark, path).select(F.regexp_extract("value", r'"doc_id":\s*(\d+)', 1).cast("long").alias("doc_id"))


@query("select shard, count(*) n, min(doc_id) first, max(doc_id) last from (select doc_id, (row_number() over (order by doc_id) - 1) * 8 // (select count(*) from documents) as shard from documents) group by shard")
def a14_contiguous_shards(spark, load):
    d = windows.global_row_number(load("documents").select("doc_id"), "doc_id", "r")
    n = load("documents").count()
    return d.groupBy(F.floor(F.col("r") * 8 / n).alias("shard")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))


@query("select doc_id, ('0x' || substr(md5(doc_id::varchar), 1, 8))::bigint % 8 as shard from documents")
def a15_hash_shards(spark, load):
    """The shards of a table together hold each row once."""
    from functools import reduce

    parts = [S.shard(load("documents"), "doc_id", i, 8).select("doc_id", F.lit(i).cast("long").alias("shard")) for i in range(8)]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("select doc_id, text from documents where lang = 'fr' and doc_id % 2 = 1")
def a2_named_config(spark, load):
    """Languages are configurations, odd and even ids their splits; one of each is read."""
    path = _place(spark, "a2")
    parted = load("documents").select("doc_id", "text", F.col("lang").alias("config"), F.when(F.col("doc_id") % 2 == 1, "odd").otherwise("even").alias("split"))
    parted.write.partitionBy("config", "split").parquet(path)
    return S.read_config(spark, path, "fr", "odd")


@query("select conv_id, turn, role, 'lines' as form from conversations union all select n_nationkey, n_regionkey, n_name, 'document' from nation")
def a3_json(spark, load):
    """Lines, and files of one array each, with inferred schemas."""
    path = _place(spark, "a3")
    load("conversations").select("conv_id", "turn", "role").write.json(f"{path}/lines")
    array = load("nation").agg(F.to_json(F.collect_list(F.struct("n_nationkey", "n_regionkey", "n_name"))).alias("value"))
    array.write.text(f"{path}/document")
    lines = S.read_json(spark, f"{path}/lines").select("conv_id", "turn", "role", F.lit("lines").alias("form"))
    whole = S.read_json(spark, f"{path}/document", multi_line=True)
    return lines.unionByName(whole.select(F.col("n_nationkey").alias("conv_id"), F.col("n_regionkey").alias("turn"), F.col("n_name").alias("role"), F.lit("document").alias("form")))


@query(f"select doc_id, source, num_tokens from (select *, row_number() over (partition by source order by {draw('doc_id')}, doc_id) r from {DOCS}) where r <= 40 and num_tokens >= 50")
def a11_resumed_shards(spark, load):
    """Sources are shards; each is sampled and filtered. A first run has some of them done, the second does the rest and nothing twice."""
    path, docs = _place(spark, "a11"), corpus(load)

    def process(rows):
        return sampling.take_per_group(rows, ["source"], 40, "doc_id").filter("num_tokens >= 50").select("doc_id", "source", "num_tokens")

    S.process_shards(docs.filter("source < 'src3'"), path, process, "source")
    S.process_shards(docs, path, process, "source")
    S.process_shards(docs, path, process, "source")
    return S.read_parquet(spark, path).select("doc_id", F.col("source").cast("string").alias("source"), "num_tokens")


@query("select vec_id, chunk, row_number() over (order by chunk, vec_id) - 1 as row_index from (select vec_id, vec_id % 12 as chunk from embeddings)")
def a16_vector_chunks(spark, load):
    """Chunk folders of ids and vectors, read as one in the order of their numbers (10 after 9)."""
    path = _place(spark, "a16")
    load("embeddings").select("vec_id", "embedding", F.pmod("vec_id", F.lit(12)).alias("chunk")).write.partitionBy("chunk").parquet(path)
    rows = S.read_parquet(spark, path).filter(F.size("embedding") > 0).select("vec_id", F.col("chunk").cast("long").alias("chunk"))
    placed = rows.withColumn("at", F.col("chunk") * 1_000_000_000_000 + F.col("vec_id"))
    return windows.global_row_number(placed, "at", "row_index").select("vec_id", "chunk", "row_index")


@query("select doc_id, upper(lang) || '-' || n_chars as tag from documents")
def a20_resumed_enrichment(spark, load):
    """Asked in batches of 100; a second run asks for what the first lacks."""
    path, docs = _place(spark, "a20"), load("documents").select("doc_id", "lang", "n_chars")
    ask = lambda rows: [{"doc_id": r["doc_id"], "tag": f"{r['lang'].upper()}-{r['n_chars']}"} for r in rows]
    for part in (docs.filter("lang = 'en'"), docs, docs):
        S.enrich(part, path, "doc_id", ask, "doc_id long, tag string")
    return S.read_parquet(spark, path)


@query("select page_id, sha256(substr(url, 1, 400)) digest from pages")
def a25_payload_digest(spark, load):
    return load("pages").select("page_id", S.payload_digest(F.encode("url", "utf-8")).alias("digest"))


@query("select doc_id, 'removed' as part, case when n_chars < 500 then 'short' else 'language' end as reason from documents where n_chars < 500 or lang <> 'en' union all select doc_id, 'kept', null from documents where n_chars >= 500 and lang = 'en'")
def k4_kept_and_removed(spark, load):
    from ..operators.filters import with_reason

    path = _place(spark, "k4")
    S.write_kept_and_removed(with_reason(load("documents"), ("short", F.col("n_chars") < 500), ("language", F.col("lang") != "en")), path)
    kept = spark.read.parquet(f"{path}/kept").select("doc_id", F.lit("kept").alias("part"), F.lit(None).cast("string").alias("reason"))
    gone = S.read_jsonl(spark, f"{path}/removed", "doc_id long, reason string").select("doc_id", F.lit("removed").alias("part"), "reason")
    return kept.unionByName(gone)


@query("select source, count(*) documents from documents group by source")
def k5_stats_csv(spark, load):
    path = _place(spark, "k5")
    S.write_csv(load("documents").groupBy("source").agg(F.count("*").alias("documents")), path, one_file=True)
    return S.read_csv(spark, path, "source string, documents long")


@query("select doc_id, quality from labels")
def k7_append_new(spark, load):
    """Written twice; the second run adds only what the first lacks."""
    path, rows = _place(spark, "k7"), load("labels").select("doc_id", "quality")
    S.append_new(rows.filter("quality = 1"), path, "doc_id", rows.schema)
    S.append_new(rows, path, "doc_id", rows.schema)
    return spark.read.schema(rows.schema).parquet(path)


@query("select doc_id, max(quality) quality from labels group by doc_id")
def k8_combine_versions(spark, load):
    a = load("labels").select("doc_id", "quality", F.lit(1).alias("v"))
    both = a.unionByName(a.withColumn("v", F.lit(2)))
    return windows.first_by(both, ["doc_id"], [F.desc("v"), F.desc("quality")]).select("doc_id", "quality")


@query(f"select doc_id, case when {draw('doc_id')} < 0.9 then 'train' when {draw('doc_id')} < 0.95 then 'validation' else 'test' end as split from documents")
def k11_split_writer(spark, load):
    path = _place(spark, "k11")
    split = sampling.split_by_draw(F.col("doc_id"), {"train": 0.9, "validation": 0.05, "test": 0.05})
    S.write_parquet(load("documents").withColumn("split", split), path, by=["split"])
    return S.read_parquet(spark, path).select("doc_id", "split")


@query("select source, lang, count(*) n from (select source, case when source = 'src1' then 'xx' else lang end as lang from documents) group by all")
def k12_partition_upsert(spark, load):
    path = _place(spark, "k12")
    d = load("documents").select("doc_id", "lang", "source")
    S.write_parquet(d, path, by=["source"])
    S.write_parquet(d, path, mode="ignore")
    S.upsert_by(d.filter("source = 'src1'").withColumn("lang", F.lit("xx")), path, "source")
    return S.read_parquet(spark, path).groupBy("source", "lang").agg(F.count("*").alias("n"))


@query("select source || ': ' || count(*) || ' documents' as value from documents group by source")
def k13_text_report(spark, load):
    path = _place(spark, "k13")
    S.write_report(load("documents").groupBy("source").agg(F.count("*").alias("n")), path, F.concat("source", F.lit(": "), "n", F.lit(" documents")))
    return S.read_lines(spark, path)


# sequential text


@query(r"""select doc_id, array_to_string(list_filter(regexp_split_to_array(regexp_replace(replace(replace(regexp_replace(text, '[ÅÀÂ]', '', 'g'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), '\[\d+(?:, ?\d+)*\]', '', 'g'), '[\s\p{Z}]+'), lambda x: x <> ''), ' ') as text from documents""")
def b17_repair_encoding(spark, load):
    return load("documents").select("doc_id", A.arrow(A.repair_encoding, "string", pa.string())(F.col("text")).alias("text"))


@query("""with p as (select conv_id, arg_min(text, turn) a, string_agg(role, '<!>' order by turn) h, string_agg(text, '<!>' order by turn) s from conversations group by conv_id)
select conv_id, '# ' || conv_id || chr(10) || chr(10) || '## ABSTRACT' || chr(10) || a || (select string_agg(chr(10) || chr(10) || '## ' || r || chr(10) || t, '' order by turn) from (select turn, role r, regexp_replace(text, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g') t from conversations c where c.conv_id = p.conv_id)) as text from p""")
def b18_assemble_article(spark, load):
    rows = load("conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("v"))

    def run(batches):
        for b in (part for whole in batches for part in A.slices(whole)):
            out = []
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                out.append(A.assemble_article(str(i), v[0]["text"], "<!>".join(x["role"] for x in v), "<!>".join(x["text"] for x in v)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["conv_id", "text"])

    return rows.mapInArrow(run, "conv_id long, text string")


@query()
def b23_segments(spark, load):
    return load("documents").select("doc_id", F.posexplode(A.arrow(A.segments, "array<string>", A.STRINGS)(F.col("text"))).alias("pos", "segment"))


@query()
def b25_note_sections(spark, load):
    note = F.concat(F.initcap("role"), F.lit(": "), "text")
    f = A.arrow(lambda t: A.note_sections(A.segments(t)), A.SECTION_SQL, A.SECTION)
    return load("conversations").select("conv_id", "turn", F.explode(f(note)).alias("s")).select("conv_id", "turn", "s.header", "s.text")


def _detected(prefix: int) -> str:
    counts = ", ".join(f"len(list_filter(w, lambda x: x in ({', '.join(repr(x) for x in sorted(v))}))) {k}" for k, v in A.COMMON.items())
    most = " ".join(f"when {k} = m then '{k}'" for k in sorted(A.COMMON))
    return f"(select doc_id, case when m = 0 then 'unknown' {most} end detected from (select *, greatest({', '.join(A.COMMON)}) m from (select doc_id, {counts} from (select doc_id, regexp_extract_all(lower(substr(text, 1, {prefix})), '[\\p{{L}}]+') w from documents))))"


@query(f"select a.doc_id, a.detected, b.detected as by_guideline_rule, lang from {_detected(2000)} a join {_detected(10000)} b using (doc_id) join documents using (doc_id)")
def b28_language(spark, load):
    """By the prefix that articles are judged by, and by that of guidelines."""
    both = [A.arrow(lambda t, p=p: A.language(t, p), "string", pa.string())(F.col("text")) for p in (2000, 10_000)]
    return load("documents").select("doc_id", both[0].alias("detected"), both[1].alias("by_guideline_rule"), "lang")


@query(f"select doc_id, detected from {_detected(2000)} where detected = 'en'")
def c9_language(spark, load):
    found = load("documents").select("doc_id", A.arrow(A.language, "string", pa.string())(F.col("text")).alias("detected"))
    return found.filter("detected = 'en'")


@query()
def b32_html_children(spark, load):
    return load("pages").select("page_id", A.arrow(A.html_children, "string", pa.string())(F.col("html")).alias("text"))


@query()
def b29_annotated_article(spark, load):
    """Each document's first line is taken for a header and its second sentence for a reference."""
    head = F.struct(F.lit(0).alias("start"), F.locate("\n", F.col("text")).cast("int").alias("end"), F.lit("header").alias("kind"))
    dot = F.locate(".", F.col("text")).cast("int")
    ref = F.struct(dot.alias("start"), (dot + 5).alias("end"), F.lit("ref").alias("kind"))
    f = A.arrow(lambda t, s: A.annotated_article(t, s), "string", pa.string())
    return load("documents").withColumn("spans", F.array(head, ref)).select("doc_id", f(F.col("text"), F.col("spans")).alias("text"))


@query()
def b30_html_sections(spark, load):
    """Sections seen in an earlier page are left out."""
    f = A.arrow(lambda t: A.html_sections(t, 25), A.SECTION_SQL, A.SECTION)
    s = load("pages").select("page_id", F.posexplode(f(F.col("html"))).alias("pos", "s")).select("page_id", "pos", "s.header", "s.text")
    return windows.first_by(s, [F.md5("text")], [F.col("page_id"), F.col("pos")])


@query()
def b31_html_article(spark, load):
    f = A.arrow(lambda t: "\n\n".join((f"## {s['header']}\n" if s["header"] else "") + s["text"] for s in A.html_sections(t)), "string", pa.string())
    return load("pages").select("page_id", f(F.col("html")).alias("text"))


@query("with recursive n as (select page_id, page_id % 7 as host from pages), r(page_id, depth) as (select page_id, 0 from n where page_id = 0 union select m.page_id, depth + 1 from r join n on n.page_id = r.page_id join n m on (m.page_id = 2 * n.page_id + 1 or m.page_id = 2 * n.page_id + 2) where depth < 60) select page_id, min(depth)::bigint depth from r group by page_id")
def b34_crawl(spark, load):
    """The pages reached from the first over links (here: to 2i + 1 and 2i + 2), a written frontier at a time."""
    links = load("pages").select("page_id", F.explode(F.array(2 * F.col("page_id") + 1, 2 * F.col("page_id") + 2)).alias("to"))
    links = links.join(load("pages").select(F.col("page_id").alias("to")), "to", "left_semi").select("page_id", "to")
    seen = dedup.written(load("pages").filter("page_id = 0").select("page_id", F.lit(0).cast("long").alias("depth")), "seen")
    depth = 0
    while True:
        front = seen.filter(F.col("depth") == depth)
        new = links.join(front.select("page_id"), "page_id", "left_semi").select(F.col("to").alias("page_id")).distinct().join(seen.select("page_id"), "page_id", "left_anti").withColumn("depth", F.lit(depth + 1).cast("long"))
        grown = dedup.written(seen.unionByName(new), "seen")
        if not grown.filter(F.col("depth") == depth + 1).limit(1).count():
            return grown
        seen, depth = grown, depth + 1


# deduplication

_G = r"""select doc_id id, case when len(w) < 5 then [array_to_string(w, ' ')] else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as g
from (select doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{M}\p{N}_]+'), lambda x: x <> '') w from documents)"""
_MINS = ", ".join(f"min((x * {a} + {b}) % {dedup.MERSENNE}) h{k}" for k, (a, b) in enumerate(dedup.permutations(112)))
_BANDS = ", ".join("concat_ws('-', " + ", ".join([str(b)] + [f"h{b * 8 + r}" for r in range(8)]) + ")" for b in range(14))
_EDGES = f"m as (select id, {_MINS} from (select id, ('0x' || substr(md5(unnest(g)), 1, 7))::bigint x from ({_G})) group by id), k as (select id, unnest([{_BANDS}]) k from m), e as (select distinct a, id b from (select id, min(id) over (partition by k) a from k) where a <> id)"


@query(f"with {_EDGES} select a, b from e")
def d1_minhash_edges(spark, load):
    return dedup.minhash_pairs(load("documents"))


_CLUSTERS = f"with recursive {_EDGES}, u as (select a, b from e union select b, a from e), r(id, root) as (select a, a from u union select u.b, r.root from r join u on u.a = r.id where r.root < u.b), c as (select id, min(root) as cluster from r group by id)"


@query(f"{_CLUSTERS} select id, cluster from c")
def d1_minhash_clusters(spark, load):
    return dedup.components(dedup.minhash_pairs(load("documents")))


@query(f"{_CLUSTERS} select doc_id, source from documents left join c on id = doc_id where coalesce(cluster = doc_id, true) or source = 'src4'")
def d2_keep_or_whitelist(spark, load):
    c = dedup.components(dedup.minhash_pairs(load("documents"))).filter("id <> cluster").select(F.col("id").alias("doc_id"), F.lit(True).alias("removed"))
    d = load("documents").select("doc_id", "source").join(c, "doc_id", "left")
    return d.filter(dedup.keep_flag(F.col("removed"), F.col("source"), {"src4"})).select("doc_id", "source")


@query(f"select source, sum(num_tokens)::bigint before, sum(case when r = 1 then num_tokens else 0 end)::bigint after from (select *, row_number() over (partition by text order by doc_id) r from {DOCS}) group by source")
def d3_token_reduction(spark, load):
    d = corpus(load)
    first = F.min("doc_id").over(Window.partitionBy(F.md5("text"))) == F.col("doc_id")
    return d.select("source", "num_tokens", first.alias("first")).groupBy("source").agg(F.sum("num_tokens").alias("before"), F.sum(F.when(F.col("first"), F.col("num_tokens")).otherwise(0)).alias("after"))


@query("""with s as (select doc_id, i - 1 pos, ps[i] s, len(ps) n from (select doc_id, string_split(text, chr(10)) ps from documents), lateral (select unnest(range(1, len(ps) + 1)) i)),
h as (select *, case when pos + 3 <= n then s || chr(31) || lead(s, 1) over w || chr(31) || lead(s, 2) over w end h from s window w as (partition by doc_id order by pos)),
a as (select *, h is not null and row_number() over (partition by h order by doc_id, pos) > 1 a from h), c as (select *, max(a::int) over (partition by doc_id order by pos rows between 2 preceding and current row) c from a)
select doc_id, coalesce(string_agg(case when c = 0 then s end, chr(10) order by pos), '') as text, sum(c)::bigint n_cut from c group by doc_id""")
def d4_span_dedup(spark, load):
    return dedup.span_dedup(load("documents"))


@query(r"""with w as (select doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{M}\p{N}_]+'), lambda x: x <> '') w from documents),
g as (select doc_id, i - 1 pos, ('0x' || substr(md5(array_to_string(w[i:i + 24], ' ')), 1, 15))::bigint h, len(w) - 24 n from w, lateral (select unnest(range(1, len(w) - 23)) i)),
a as (select distinct doc_id, m.p pos, m.h h from (select doc_id, pos, n, arg_min({'h': h, 'p': pos}, {'h': h, 'p': pos}) over (partition by doc_id order by pos rows between current row and 25 following) m from g) where pos < greatest(n - 25, 1)),
f as (select *, count(*) over (partition by h) c, first_value({'d': doc_id, 'p': pos}) over (partition by h order by doc_id, pos) f from a)
select doc_id, pos, f.d first_doc, f.p first_pos from f where c > 1 and not (f.d = doc_id and f.p = pos)""")
def d5_repeated_passages(spark, load):
    """Passages of 50 words that occur twice."""
    return dedup.repeated_passages(load("documents"))


@query("select min(doc_id) doc_id, substr(regexp_replace(lower(substr(text, 1, 500)), '[^a-z0-9]', '', 'g'), 1, 500) k from documents group by k")
def d7_prefix_dedup(spark, load):
    return windows.first_by(load("documents").select("doc_id", T.alnum_key(F.col("text"), 500).alias("k")), ["k"], [F.col("doc_id")])


@query("select doc_id, source from (select *, count(*) over (partition by text) n from documents) where n = 1")
def d8_drop_all_duplicates(spark, load):
    n = F.count("*").over(Window.partitionBy("h"))
    return load("documents").select("doc_id", "source", F.md5("text").alias("h")).withColumn("n", n).filter("n = 1").select("doc_id", "source")


@query("select min(p_partkey) p_partkey, p_name, count(*) copies from part group by p_name having not ends_with(p_name, ' x')")
def d9_article_dedup(spark, load):
    p = load("part").groupBy("p_name").agg(F.min("p_partkey").alias("p_partkey"), F.count("*").alias("copies"))
    return p.filter(~F.col("p_name").endswith(" x")).select("p_partkey", "p_name", "copies")


# scores, vectors


@query(f"""with p as (select doc_id, string_split(text, chr(10)) p from documents), c as (select doc_id, p[1 + floor({draw('doc_id', 5)} * len(p))::int] p from p)
select doc_id, 'Rate this text from 1 to 4.' || chr(10) || array_to_string(string_split(p, ' ')[1:512], ' ') as prompt from c""")
def l1_teacher_prompt(spark, load):
    p = T.lines(F.col("text"))
    one = F.element_at(p, (F.floor(T.hash_draw(F.col("doc_id"), 5) * F.size(p)) + 1).cast("int"))
    return load("documents").select("doc_id", F.concat(F.lit("Rate this text from 1 to 4.\n"), T.first_words(one, 512)).alias("prompt"))


@query(f"select doc_id, (quality * 3 + 1 - 1.0) / 3.0 as label, {draw('doc_id')} < 0.1 as validation from labels")
def l2_distillation_set(spark, load):
    return load("labels").select("doc_id", T.rescale(F.col("quality") * 3 + 1).alias("label"), (T.hash_draw(F.col("doc_id")) < 0.1).alias("validation"))


_PARA = "(select doc_id, i - 1 para_idx, ps[i] p, length(ps[i]) / (length(ps[i]) + 100.0) s from (select doc_id, string_split(text, chr(10)) ps from documents), lateral (select unnest(range(1, len(ps) + 1)) i))"
_ADJ = "(s + (0.65 - 0.5))"


@query(f"""with k as (select doc_id, string_agg(p, chr(10) || chr(10) order by para_idx) as text, avg(s) s from {_PARA} where {_ADJ} > 0 and ({_ADJ} >= 1 or {draw("doc_id || '-' || para_idx", 13)} <= {_ADJ}) group by doc_id)
select d.doc_id, coalesce(k.text, '') as text, round(coalesce(s, 0), 9) score from documents d left join k using (doc_id)""")
def l3_score_and_filter(spark, load):
    p = scoring.scored_paragraphs(load("documents"), "doc_id", lambda c: F.length(c) / (F.length(c) + 100.0), r"\n")
    kept = p.filter(sampling.keep_by_score(F.col("score"), 0.65, 0.5, F.concat_ws("-", "doc_id", "para_idx")))
    return scoring.regroup(load("documents"), kept, "doc_id").select("doc_id", "text", T.rounded(F.col("score"), 9).alias("score"))


@query("""with d as (select a.vec_id query_id, b.vec_id, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: (p[1]::double - p[2]::double) * (p[1]::double - p[2]::double))), 6) distance from embeddings a, embeddings b),
r as (select *, row_number() over (partition by query_id order by distance, vec_id) as rank from d) select query_id, vec_id, distance, rank from r where rank <= 10""")
def l4_knn_exact(spark, load):
    v = load("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return vectors.knn(v, v, 10, places=6).select("query_id", "vec_id", F.round("distance", 6).alias("distance"), F.col("rank").cast("long").alias("rank"))


@query("""with d as (select a.vec_id query_id, b.vec_id, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: (p[1]::double - p[2]::double) * (p[1]::double - p[2]::double))), 6) distance from embeddings a, embeddings b where a.vec_id % 20 = 0),
r as (select *, row_number() over (partition by query_id order by distance, vec_id) as rank from d) select query_id, vec_id, distance, rank from r where rank <= 5""")
def k10_vector_index(spark, load):
    """An index on disk, opened again; queries are the vectors whose id is divisible by 20, and all cells are probed, so the result is exact."""
    v = load("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    path = _place(spark, "k10")
    vectors.write_index(v, vectors.train_cells(v, max(1, round(v.count() ** 0.5)), rounds=2), path)
    found = vectors.search_index(spark, path, v.filter("id % 20 = 0"), 5)
    return found.select("query_id", "vec_id", F.round("distance", 6).alias("distance"), F.col("rank").cast("long").alias("rank"))


@query()
def l4_knn_cells(spark, load):
    v = load("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    cells = max(1, round(v.count() ** 0.5))
    centroids = vectors.train_cells(v, cells)
    return vectors.knn_cells(v, v, 10, centroids, vectors.choose_probes(v, v, 10, centroids))


@query()
def l5_context_path(spark, load):
    """A path through each whole component of the neighbour graph, named by its smallest id; one component is one task, as the walk is sequential."""
    v = load("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    near = vectors.knn(v, v, 4).filter("query_id <> vec_id")
    edges = dedup.written(near.groupBy(F.least("query_id", "vec_id").alias("a"), F.greatest("query_id", "vec_id").alias("b")).agg(F.min("distance").alias("w")), "near")
    cluster = dedup.components(edges)

    def path(t: pa.Table) -> pa.Table:
        t = t.sort_by([("a", "ascending"), ("b", "ascending")])
        order = A.in_context_path(list(zip(t.column("a").to_pylist(), t.column("b").to_pylist(), t.column("w").to_pylist())))
        return pa.table({"cluster": pa.array([t.column("cluster")[0].as_py()] * len(order), pa.int64()), "pos": pa.array(range(len(order)), pa.int64()), "vec_id": pa.array(order, pa.int64())})

    walked = edges.join(cluster.withColumnRenamed("id", "a"), "a").groupBy("cluster").applyInArrow(path, "cluster long, pos long, vec_id long")
    alone = v.join(cluster, "id", "left_anti").select(F.col("id").cast("long").alias("cluster"), F.lit(0).cast("long").alias("pos"), F.col("id").cast("long").alias("vec_id"))
    return walked.unionByName(alone)


@query(r"""with a as (select conv_id, turn, role || ' # ANSWER ' || chr(65 + (turn % 4)::int) c from conversations), t as (select *, string_split(c, ' # ANSWER ') p from a)
select conv_id, turn, case when len(p) = 2 and p[2] = chr(65 + (conv_id % 4)::int) then p[1] else '' end as rationale from t""")
def l9_rationale_gate(spark, load):
    """A rationale is kept only if there is one answer mark and the letter after it is right."""
    p = F.split(F.concat("role", F.lit(" # ANSWER "), F.char(65 + F.col("turn") % 4)), r" # ANSWER ", -1)
    ok = (F.size(p) == 2) & (F.get(p, F.lit(1)) == F.char(65 + F.col("conv_id") % 4))
    return load("conversations").select("conv_id", "turn", F.when(ok, p[0]).otherwise("").alias("rationale"))


@query(r"""with t as (select doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{M}\p{N}_]+'), lambda x: x <> '')) w from documents), c as (select doc_id, w, count(*) n from t group by all),
m as (select w, quality, sum(n) n from c join labels using (doc_id) where quality is not null group by all), v as (select count(distinct w) v from m), s as (select quality, sum(n) s from m group by all),
p as (select quality, ln(count(*)) prior, any_value(s) s, any_value(v) v from labels join documents using (doc_id) join s using (quality), v where quality is not null group by all),
k as (select doc_id, sum(n) words from c where w in (select w from m) group by all),
x as (select d.doc_id, p.quality, prior - coalesce(words, 0) * ln(s + v) + coalesce((select sum(c.n * ln(m.n + 1)) from c join m on m.w = c.w and m.quality = p.quality where c.doc_id = d.doc_id), 0) z from documents d left join k using (doc_id), p)
select doc_id, arg_max(quality, (round(z, 6), quality)) predicted from x group by doc_id""")
def l6_subset_classifier(spark, load):
    """Word counts of the labelled documents tell good from bad ones."""
    labels = load("labels").select("doc_id", F.col("quality").alias("label"))
    counts = dedup.written(scoring.word_counts(load("documents")), "word-counts")
    return scoring.classify(load("documents"), counts, *scoring.train_words(counts, labels))


@query(r"""with l as (select distinct w as entity from (select unnest(regexp_extract_all(lower(text), '[\p{L}]+')) w from benchmark) where length(w) >= 6),
d as (select doc_id, w as entity, count(*) mentions from (select doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{M}\p{N}_]+'), lambda x: x <> '')) w from documents) group by all)
select doc_id, entity, 'term' as type, mentions from d join l using (entity)""")
def l7_entities(spark, load):
    """The lexicon is the long words of the benchmark."""
    words = load("benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}]+)"), 1)).alias("entity")).filter(F.length("entity") >= 6)
    return entities.lexicon_entities(load("documents"), words.withColumn("type", F.lit("term")))


# tokens


@query("select doc_id, list_transform(string_split(text || chr(3), ''), lambda x: ascii(x)) input_ids from documents")
def m1_tokenize(spark, load):
    return load("documents").select("doc_id", pack.char_ids(F.concat("text", F.char(F.lit(3)))).alias("input_ids"))


_WMIX = "(values " + ", ".join(f"('{s}', {w})" for s, w in WEIGHTS) + ") w(source, weight)"


@query(f"with m as (select doc_id, d.source, num_tokens, unnest(range(1, 1 + (case when weight < 1 then ({draw('uuid')} < weight)::int else floor(weight)::int end))) as copy from {DOCS} d join {_WMIX} using (source)) select source, sum(num_tokens)::bigint tokens, count(*) documents from m group by source")
def m2_mixture_stats(spark, load):
    mixed = sampling.mixture_copies(corpus(load), spark.createDataFrame(WEIGHTS, "source string, weight double"), "uuid")
    return mixed.groupBy("source").agg(F.sum("num_tokens").alias("tokens"), F.count("*").alias("documents"))


@query("""with t as (select doc_id, string_split(text || chr(3), '') t from documents), p as (select *, sum(len(t)) over (order by doc_id) - len(t) as a0 from t), e as (select a0 + i - 1 pos, ascii(t[i]) id from p, lateral (select unnest(range(1, len(t) + 1)) i))
select (pos // 4096)::bigint block_id, list(id order by pos) input_ids from e group by 1 having count(*) = 4096""")
def m3_pack_blocks(spark, load):
    ids = load("documents").select("doc_id", pack.char_ids(F.concat("text", F.char(F.lit(3)))).alias("ids"))
    return pack.pack_blocks(ids, "doc_id", "ids", 4096)


@query("select config, source, count(*) documents from (select 'flat' config, source from documents where source in ('src1', 'src2') union all select 'double', source from documents, (select unnest(range(2))) where source = 'src1') group by all")
def m4_config_sweep(spark, load):
    from functools import reduce

    configs = {"flat": [("src1", 1.0), ("src2", 1.0)], "double": [("src1", 2.0)]}
    runs = [sampling.mixture_copies(corpus(load), spark.createDataFrame(w, "source string, weight double"), "uuid").select(F.lit(k).alias("config"), "source") for k, w in configs.items()]
    return reduce(lambda a, b: a.unionByName(b), runs).groupBy("config", "source").agg(F.count("*").alias("documents"))


@query("""with t as (select conv_id, turn, list_transform(string_split(role, ''), lambda x: ascii(x)) p, list_transform(string_split(text, ''), lambda x: ascii(x)) c from conversations), i as (select *, (p || c || [3])[1:256] i, (list_transform(p, lambda x: -100) || c || [3])[1:256] l from t)
select conv_id, turn, i || list_transform(range(256 - len(i)), lambda x: 0) input_ids, l || list_transform(range(256 - len(i)), lambda x: -100) labels, list_transform(i, lambda x: 1) || list_transform(range(256 - len(i)), lambda x: 0) attention_mask from i""")
def m6_sft_examples(spark, load):
    e = pack.sft_example(pack.char_ids(F.col("role")), pack.char_ids(F.col("text")), 256, 0, 3)
    return load("conversations").select("conv_id", "turn", e.alias("e")).select("conv_id", "turn", "e.input_ids", "e.labels", "e.attention_mask")


@query("select conv_id, turn, [length(text) - 1, turn % 4, 65, 66, 67, 68] labels from conversations")
def m7_mcq_labels(spark, load):
    labels = pack.mcq_labels(pack.char_ids(F.col("text")), F.array(*[F.lit(65 + i) for i in range(4)]), (F.col("turn") % 4).cast("int"))
    return load("conversations").select("conv_id", "turn", labels.cast("array<bigint>").alias("labels"))


_BLOCKS_SQL = """with t as (select doc_id, string_split(text || chr(3), '') t from documents), p as (select *, sum(len(t)) over (order by doc_id) - len(t) as a0 from t), e as (select a0 + i - 1 pos, ascii(t[i]) id from p, lateral (select unnest(range(1, len(t) + 1)) i)),
b as (select (pos // 2048)::bigint block_id, list(id order by pos) input_ids from e group by 1 having count(*) = 2048)"""


@query(f"{_BLOCKS_SQL} select block_id, input_ids from b where block_id < (select count(*) // 16 * 16 from b)")
def k6_token_matrix(spark, load):
    """Blocks as raw int32 files, read back in whole multiples of 16 rows."""
    path = _place(spark, "k6")
    ids = load("documents").select("doc_id", pack.char_ids(F.concat("text", F.char(F.lit(3)))).alias("ids"))
    S.write_matrix(pack.pack_blocks(ids, "doc_id", "ids", 2048), path, 2048, 256)
    return S.read_matrix(spark, path, 2048, 16, 256)


@query("select config, 'points' as model, 2048 as length, count(*) as documents from (select 'all' config, 1 from documents union all select 'english', 1 from documents where lang = 'en') group by config")
def m5_named_outputs(spark, load):
    """The folder of an output says which configuration, tokenizer and length it has."""
    path, d = _place(spark, "m5"), load("documents")
    for config, rows in (("all", d), ("english", d.filter("lang = 'en'"))):
        S.write_parquet(rows.select("doc_id", F.lit(config).alias("config"), F.lit("points").alias("model"), F.lit(2048).alias("length")), path, mode="append", by=["config", "model", "length"])
    return S.read_parquet(spark, path).groupBy("config", "model", F.col("length").cast("int").alias("length")).agg(F.count("*").alias("documents"))


@query("select doc_id from (select doc_id, row_number() over (order by doc_id) r from documents) where r <= (select count(*) // 64 * 64 from documents)")
def m8_whole_batches(spark, load):
    """The rows of whole batches of 64, in order."""
    d = load("documents").select("doc_id")
    return windows.global_row_number(d, "doc_id", "r").filter(F.col("r") < d.count() // 64 * 64).select("doc_id")


# instructions and concepts


@query("""select 'nli-' || doc_id as id, '# INSTRUCTION' || chr(10) || 'Does it follow?' || chr(10) || chr(10) || '# QUESTION' || chr(10) || source || chr(10) || chr(10) || '# CHOICES' || chr(10) || 'A) yes' || chr(10) || 'B) no' || chr(10) || chr(10) || '# ANSWER' as prompt, case quality when 1 then 'A' else 'B' end as completion, 2 num_options, 'nli' as source from documents join labels using (doc_id)
union all select 'lang-' || doc_id, '# INSTRUCTION' || chr(10) || 'Name the language.' || chr(10) || chr(10) || '# QUESTION' || chr(10) || source || chr(10) || chr(10) || '# CHOICES' || chr(10) || 'A) en' || chr(10) || 'B) other' || chr(10) || chr(10) || '# ANSWER', case lang when 'en' then 'A' else 'B' end, 2, 'lang' from documents""")
def n1_qa_configs(spark, load):
    """One select for each configuration row, united."""
    d = load("documents")
    configs = [("nli", "Does it follow?", ("yes", "no"), F.col("quality") == 1, d.join(load("labels"), "doc_id")), ("lang", "Name the language.", ("en", "other"), F.col("lang") == "en", d)]
    out = None
    for name, instruction, options, first, rows in configs:
        prompt = T.qa_prompt(F.lit(instruction), F.col("source"), F.array(*map(F.lit, options)))
        part = rows.select(F.concat(F.lit(f"{name}-"), F.col("doc_id").cast("string")).alias("id"), prompt.alias("prompt"), F.when(first, "A").otherwise("B").alias("completion"), F.lit(len(options)).alias("num_options"), F.lit(name).alias("source"))
        out = part if out is None else out.unionByName(part)
    return out


@query("select n_regionkey as id, case when n_regionkey % 2 = 0 then 'The question cannot be answered.' else min(n_name) end as completion from nation group by n_regionkey")
def n3_extractive_qa(spark, load):
    by = load("nation").groupBy(F.col("n_regionkey").alias("id")).agg(F.array_sort(F.collect_set("n_name")).alias("answers"))
    return by.select("id", F.when(F.col("id") % 2 == 0, "The question cannot be answered.").otherwise(F.col("answers")[0]).alias("completion"))


@query("select conv_id, turn, text as prompt, answer as completion from (select *, lead(text) over (partition by conv_id order by turn) answer, lead(role) over (partition by conv_id order by turn) next from conversations) where role = 'user' and next = 'assistant' and trim(answer) <> ''")
def n4_dialogue_qa(spark, load):
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = load("conversations").withColumn("completion", F.lead("text").over(w)).withColumn("next", F.lead("role").over(w))
    return c.filter("role = 'user' and next = 'assistant'").filter(F.trim("completion") != "").select("conv_id", "turn", F.col("text").alias("prompt"), "completion")


@query("select p_partkey id, 'What is ' || p_name || '?' as prompt, p_type as completion from part where length(trim(p_type)) > 0")
def n5_flashcards(spark, load):
    return load("part").filter(F.length(F.trim("p_type")) > 0).select(F.col("p_partkey").alias("id"), F.concat(F.lit("What is "), "p_name", F.lit("?")).alias("prompt"), F.col("p_type").alias("completion"))


@query(f"select split, source, count(*) n from (select *, row_number() over (partition by source, split order by {draw('doc_id')}, doc_id) r from (select *, case when {draw('doc_id')} < 0.9 then 'train' else 'test' end as split from documents)) where split <> 'train' or r <= 15 group by all")
def n6_instruction_union(spark, load):
    d = load("documents").withColumn("split", sampling.split_by_draw(F.col("doc_id"), {"train": 0.9, "test": 0.1}))
    capped = sampling.take_per_group(d.filter("split = 'train'"), ["source"], 15, "doc_id").unionByName(d.filter("split <> 'train'"))
    return capped.groupBy("split", "source").agg(F.count("*").alias("n"))


@query("""with c as (select o_custkey cui, o_orderpriority as name, count(*) n from orders group by all), m as (select cui, string_agg(name, '|' order by n desc, name) as names, arg_min(name, (-n, name)) as name from c group by cui),
t as (select c_custkey cui, n_name as type, r_name as grp from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey)
select cui, name, names, type as tui_name, grp as sem_group from m join t using (cui)""")
def n7_concepts(spark, load):
    by = load("orders").groupBy(F.col("o_custkey").alias("cui"), F.col("o_orderpriority").alias("name")).agg((-F.count("*")).alias("m"))
    names = by.groupBy("cui").agg(F.array_sort(F.collect_list(F.struct("m", "name"))).alias("v")).select("cui", F.col("v")[0]["name"].alias("name"), F.array_join(F.transform("v", lambda x: x["name"]), "|").alias("names"))
    places = load("nation").join(F.broadcast(load("region")), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    kinds = load("customer").join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("cui"), F.col("n_name").alias("tui_name"), F.col("r_name").alias("sem_group"))
    return names.join(kinds, "cui").select("cui", "name", "names", "tui_name", "sem_group")


@query("""with d as (select l_orderkey cui, string_agg(p_name, chr(10) order by p_name, l_linenumber) definitions from lineitem join part on l_partkey = p_partkey where l_returnflag = 'N' group by 1),
r as (select a.l_orderkey cui, string_agg(a.l_shipmode || ' ' || b.l_partkey, '|' order by a.l_linenumber, b.l_linenumber, a.l_shipmode || ' ' || b.l_partkey) relations from (select *, l_returnflag as l_shipmode from lineitem) a join lineitem b on a.l_orderkey = b.l_orderkey and a.l_partkey <> b.l_partkey group by 1)
select o_orderkey cui, coalesce(definitions, '') definitions, coalesce(relations, '') relations from orders left join d on d.cui = o_orderkey left join r on r.cui = o_orderkey""")
def n8_concept_relations(spark, load):
    li = load("lineitem")
    d = li.filter("l_returnflag = 'N'").join(load("part"), F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_orderkey").alias("cui")).agg(F.array_sort(F.collect_list(F.struct("p_name", "l_linenumber"))).alias("v")).select("cui", F.array_join(F.transform("v", lambda x: x["p_name"]), "\n").alias("definitions"))
    a = li.select(F.col("l_orderkey").alias("cui"), F.col("l_partkey").alias("pa"), F.col("l_linenumber").alias("na"), "l_returnflag")
    b = li.select(F.col("l_orderkey").alias("cui"), F.col("l_partkey").alias("pb"), F.col("l_linenumber").alias("nb"))
    r = a.join(b, "cui").filter("pa <> pb").groupBy("cui").agg(F.array_sort(F.collect_list(F.struct("na", "nb", F.concat_ws(" ", "l_returnflag", "pb").alias("t")))).alias("v")).select("cui", F.array_join(F.transform("v", lambda x: x["t"]), "|").alias("relations"))
    base = load("orders").select(F.col("o_orderkey").alias("cui"))
    return base.join(d, "cui", "left").join(r, "cui", "left").select("cui", F.coalesce("definitions", F.lit("")).alias("definitions"), F.coalesce("relations", F.lit("")).alias("relations"))


@query(r"""with d as (select l_orderkey cui, '# ' || l_orderkey || chr(10) || string_agg(distinct p_name, chr(10) order by p_name) as text from lineitem join part on l_partkey = p_partkey group by 1)
select cui, text, len(regexp_split_to_array(text, '[^\p{L}\p{M}\p{N}_]+'))::bigint num_tokens from d""")
def n9_pseudo_docs(spark, load):
    by = load("lineitem").join(load("part"), F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_orderkey").alias("cui")).agg(F.sort_array(F.collect_set("p_name")).alias("v"))
    text = F.concat(F.lit("# "), F.col("cui").cast("string"), F.lit("\n"), F.array_join("v", "\n"))
    return by.select("cui", text.alias("text")).withColumn("num_tokens", T.token_count(F.col("text")))
