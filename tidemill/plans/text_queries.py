"""Scalar text operators over documents, pages and dialogues."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from .registry import query


def rx(c: str, *steps: tuple[str, str], flags: str = "g") -> str:
    for p, r in steps:
        p, r = p.replace("'", "''"), r.replace("'", "''")
        c = f"regexp_replace({c}, E'{_e(p)}', E'{_e(r)}', '{flags}')"
    return c


def _e(p: str) -> str:
    return p.replace("\\", "\\\\").replace("\n", "\\n").replace("\t", "\\t")


def strip(c: str) -> str:
    return rx(c, (r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))


def each_line(c: str, f) -> str:
    return f"array_to_string(list_transform(string_split({c}, chr(10)), lambda x: {f('x')}), chr(10))"


SQUEEZE = ((" +", " "), ("\t+", " "))
TOKENS = r"len(regexp_split_to_array({}, '[^\p{{L}}\p{{M}}\p{{N}}_]+'))"
WEB = each_line(strip(rx("text", ("\n{2,}", "\n\n"), *SQUEEZE)), strip)
ENCYCLOPEDIA = strip("'# ' || " + rx("text", ("\n{2,}", "\n\n"), *SQUEEZE))
URLS = (r"(?:https|http)?://[\p{L}\p{M}\p{N}_./?=&%-]*[\p{L}\p{M}\p{N}_]", "")
REFS = (("<.*?>", ""), (r"\[.*?\]\(.*?\)", ""), (r"\[.*?\]", ""))
LISTS = (("\n\\* ", "\n- "), ("\n•", "\n-"), ("\no", "\n-"), ("\n\uf0b7", "\n-"), ("\n\\+ ", "\n- "), ("• ", "- "), (r"\* ", "- "))
GLYPHS = (("[◆•▪■□�]", ""), (r"\*-", ""), ("\n>", "\n"), (r"\*\*", ""))


def newlines(c: str) -> str:
    kept = f"list_filter(string_split({c}, chr(10)), lambda x: regexp_matches(x, '[a-zA-Z]'))"
    return rx(f"(case when len({kept}) > 0 then array_to_string({kept}, chr(10)) || chr(10) else '' end)", (r"\n\s*\n", "\n"), ("\n{2,}", "\n"), ("\n#", "\n\n#"))


@query(f"select doc_id, {TOKENS.format('text')}::bigint num_tokens from documents")
def b1_token_count(spark, load):
    return load("documents").select("doc_id", T.token_count(F.col("text")).alias("num_tokens"))


@query(f"select doc_id, {WEB} text from documents")
def b2_normalize_web(spark, load):
    return load("documents").select("doc_id", T.normalize_web(F.col("text")).alias("text"))


@query(f"select doc_id, {ENCYCLOPEDIA} text from documents")
def b3_normalize_encyclopedia(spark, load):
    return load("documents").select("doc_id", T.normalize_encyclopedia(F.col("text")).alias("text"))


@query(f"select doc_id, {each_line(ENCYCLOPEDIA, strip)} text from documents")
def b4_normalize_book(spark, load):
    return load("documents").select("doc_id", T.normalize_book(F.col("text")).alias("text"))


_BLOCKS = "array_to_string(list_transform(regexp_split_to_array(text, E'\\n{2,}'), lambda b: case when upper(b) = b then '## ' || b else b end), chr(10))"


@query(f"select doc_id, {each_line(rx(f'''('# ' || source || chr(10) || '## ABSTRACT' || chr(10) || lang || chr(10) || {_BLOCKS})''', *SQUEEZE), strip)} text from documents")
def b5_normalize_scholarly(spark, load):
    return load("documents").select("doc_id", T.normalize_scholarly(F.col("source"), F.col("lang"), F.col("text")).alias("text"))


@query(f"select doc_id, {strip(rx('''replace(replace(text, '[unreadable]', ''), 'DESCRIPTION (provided by applicant)', '')''', (r'[\s\p{Z}]+', ' ')))} text from documents")
def b6_grant_abstract(spark, load):
    return load("documents").select("doc_id", T.grant_abstract(F.col("text")).alias("text"))


@query(f"select page_id, {rx('html', URLS)} html, {rx('url', URLS)} url from pages")
def b7_remove_urls(spark, load):
    return load("pages").select("page_id", T.remove_urls(F.col("html")).alias("html"), T.remove_urls(F.col("url")).alias("url"))


@query(f"select page_id, {rx('html', *REFS)} html from pages")
def b8_remove_references(spark, load):
    return load("pages").select("page_id", T.remove_references(F.col("html")).alias("html"))


@query(f"""select doc_id, case when contains(t, E'\\n#') then {rx('''replace(t, chr(10) || repeat('#', n::int), E'\\n#')''', ("\n#{3,}", "\n###"))} else t end as text
from (select *, list_min(list_transform(regexp_extract_all(t, E'\\n#+'), lambda h: length(h) - 1)) n from (select doc_id, replace(replace(text, ' | ', E'\\n### '), '. ', E'\\n## ') t from documents))""")
def b9_normalize_sections(spark, load):
    marked = F.replace(F.replace(F.col("text"), F.lit(" | "), F.lit("\n### ")), F.lit(". "), F.lit("\n## "))
    return load("documents").select("doc_id", T.normalize_sections(marked).alias("text"))


@query(f"select doc_id, {rx('text', *LISTS)} text from documents")
def b10_normalize_lists(spark, load):
    return load("documents").select("doc_id", T.normalize_lists(F.col("text")).alias("text"))


@query(f"select doc_id, {rx('text', *GLYPHS)} text from documents")
def b11_remove_glyphs(spark, load):
    return load("documents").select("doc_id", T.remove_glyphs(F.col("text")).alias("text"))


@query(f"select doc_id, {newlines('text')} text from documents")
def b12_normalize_newlines(spark, load):
    return load("documents").select("doc_id", T.normalize_newlines(F.col("text")).alias("text"))


@query(f"""with t as (select page_id, {rx('html', URLS, *REFS, *LISTS, *GLYPHS)} t from pages), n as (select *, list_min(list_transform(regexp_extract_all(t, E'\\n#+'), lambda h: length(h) - 1)) n from t),
m as (select page_id, case when contains(t, E'\\n#') then {rx('''replace(t, chr(10) || repeat('#', n::int), E'\\n#')''', ("\n#{3,}", "\n###"))} else t end as t from n)
select page_id, {strip(newlines('t'))} html from m""")
def b13_clean_guideline(spark, load):
    return load("pages").select("page_id", T.clean_guideline(F.col("html")).alias("html"))


@query("select conv_id, string_agg('# ' || role || chr(10) || chr(10) || text, '' order by turn) text from conversations group by conv_id")
def b15_join_sections(spark, load):
    parts = F.sort_array(F.collect_list(F.struct("turn", F.col("role").alias("name"), "text")))
    return load("conversations").groupBy("conv_id").agg(T.join_sections(parts).alias("text"))


@query(f"select doc_id, {rx('''replace(text, ' | ', E'\\n# ')''', ('(?m)^#', '##'))} text from documents")
def b16_deepen_headers(spark, load):
    return load("documents").select("doc_id", T.deepen_headers(F.replace(F.col("text"), F.lit(" | "), F.lit("\n# "))).alias("text"))


@query("""with t as (select page_id, case when contains(html, '<article>') then substr(html, strpos(html, '<article>') + 9) else html end t from pages)
select page_id, case when contains(t, '</article>') then substr(t, 1, strpos(t, '</article>') - 1) when contains(t, '<footer>') then substr(t, 1, strpos(t, '<footer>') - 1) else t end html from t""")
def b19_slice_between(spark, load):
    return load("pages").select("page_id", T.slice_between(F.col("html"), "<article>", ["</article>", "<footer>"]).alias("html"))


@query(f"select doc_id, {rx(each_line(strip('text'), lambda x: strip(rx(x, (r'[\s\p{Z}]+', ' ')))), ('\n{2,}', '\n\n'), (' +:', ':'))} text from documents")
def b20_clinical_lines(spark, load):
    return load("documents").select("doc_id", T.clinical_lines(F.col("text")).alias("text"))


_MARKS = ((" the ", " [**Last Name (un) 12**] "), (" of ", " [**Hospital Ward**] "), (" and ", " [**2101-3-4**] "), (" de ", " [**7-12**] "), (" la ", " [** **] "), (" in ", " [**Doctor First Name**] "), (" to ", " [**Holiday 7**] "), (" que ", " **1991** "), (" und ", " [**Age over 90 **] "), (" is ", " [**Clip Number (Radiology) 9**] "))
_NOTE = "text"
for _a, _b in _MARKS:
    _NOTE = f"replace({_NOTE}, '{_a}', '{_b}')"


@query(f"select doc_id, {rx(_NOTE, *((f'(?i){p}', '___') for p in T.SCRUB))} text from documents")
def b21_scrub(spark, load):
    note = F.col("text")
    for a, b in _MARKS:
        note = F.replace(note, F.lit(a), F.lit(b))
    return load("documents").select("doc_id", T.scrub(note).alias("text"))


@query(r"""with l as (select doc_id, i, ls[i] || ':' as line from (select doc_id, string_split(text, chr(10)) ls from documents), lateral (select unnest(range(1, len(ls) + 1)) i)),
w as (select *, list_filter(regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace(line, '\([^)]*\)', '', 'g'), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'), ':$', ''), '[\s\p{Z}]+'), lambda x: x <> '') w from l)
select doc_id, count(*) n_lines, count(*) filter (where not starts_with(line, 'Disp') and len(w) > 0 and len(list_filter(w, lambda x: not (x in ('of', 'on', 'or') or regexp_matches(x, '^\p{Lu}')))) = 0) n_titles from w group by doc_id""")
def b22_titles(spark, load):
    line = load("documents").select("doc_id", F.explode(T.lines(F.col("text"))).alias("line")).select("doc_id", F.concat("line", F.lit(":")).alias("line"))
    return line.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if(T.is_title(F.col("line"))).alias("n_titles"))


@query(r"""with w as (select doc_id, string_split(replace(text, '.', ':'), ' ') w from documents), p as (select *, list_position(list_transform(w[1:5], lambda x: ends_with(x, ':')), true) p from w)
select doc_id, case when p > 0 then array_to_string(w[1:p], ' ') end as header, array_to_string(case when p > 0 then w[p + 1:] else w end, ' ') as text from p""")
def b24_header_parse(spark, load):
    h = T.header_of(F.replace(F.col("text"), F.lit("."), F.lit(":")))
    return load("documents").select("doc_id", h.alias("h")).select("doc_id", "h.header", "h.text")


@query("select doc_id, i - 1 as para_idx, p[i] as text from (select doc_id, regexp_split_to_array(text, E'\\n+') p from documents), lateral (select unnest(range(1, len(p) + 1)) i)")
def b26_paragraphs(spark, load):
    return load("documents").select("doc_id", F.posexplode(T.paragraphs(F.col("text"), r"\n+")).alias("para_idx", "text")).withColumn("para_idx", F.col("para_idx").cast("long"))


@query("""select page_id, url from pages where not contains(url, '?') and not contains(url, '#') and not contains(url, 'example.net') and not contains(url, 'www.')""")
def b33_link_filter(spark, load):
    banned = ("?", "#", "example.net", "www.")
    keep = F.lit(True)
    for b in banned:
        keep &= ~F.col("url").contains(b)
    return load("pages").filter(keep).select("page_id", "url")


@query("select doc_id, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') key_all, regexp_replace(lower(substr(text, 1, 500)), '[^a-z0-9]', '', 'g') key_500 from documents")
def b35_alnum_key(spark, load):
    return load("documents").select("doc_id", T.alnum_key(F.col("text")).alias("key_all"), T.alnum_key(F.col("text"), 500).alias("key_500"))


@query("select p_partkey, translate(replace(lower(p_name || ' & ' || p_brand || ': ' || p_type || '.'), '&', 'and'), ':,.-', '') journal from part")
def b36_journal_key(spark, load):
    return load("part").select("p_partkey", T.journal_key(F.concat("p_name", F.lit(" & "), "p_brand", F.lit(": "), "p_type", F.lit("."))).alias("journal"))


@query("select doc_id, array_to_string(string_split(text, ' ')[1:512], ' ') as text from documents")
def b37_first_words(spark, load):
    return load("documents").select("doc_id", T.first_words(F.col("text"), 512).alias("text"))


@query("select source || '-' || doc_id as uuid, sha1(source || doc_id) as sha, source || '-shard=' || lang || '-idx=' || (row_number() over (partition by source, lang order by doc_id) - 1) as shard_id from documents")
def b38_ids(spark, load):
    idx = F.expr("row_number() over (partition by source, lang order by doc_id) - 1")
    return load("documents").select(F.concat_ws("-", "source", "doc_id").alias("uuid"), F.sha1(F.concat("source", F.col("doc_id").cast("string"))).alias("sha"), F.concat(F.col("source"), F.lit("-shard="), "lang", F.lit("-idx="), idx.cast("string")).alias("shard_id"))


@query("""select doc_id, source, '{"lang":"' || lang || '","n_chars":' || n_chars || '}' as meta from documents""")
def b39_meta_json(spark, load):
    return load("documents").select("doc_id", "source", T.meta_json("lang", "n_chars").alias("meta"))


@query("select doc_id as id, source as subset, row_number() over (order by doc_id) - 1 as row_idx from documents")
def b40_row_index(spark, load):
    """Row numbers from counts of each key range, so that no one task sees all rows."""
    from ..operators.windows import global_row_number

    return global_row_number(load("documents").select(F.col("doc_id").alias("id"), F.col("source").alias("subset")), "id", "row_idx")


_HUMAN = "case when {0} < 1000 then {0}::varchar when {0} < 1000000 then ({0} // 1000) || 'k' when {0} < 1000000000 then ({0} // 1000000) || 'mn' when {0} < 1000000000000 then ({0} // 1000000000) || 'bn' else ({0} // 1000000000000) || 'tn' end"


@query(f"select doc_id, {_HUMAN.format('n_chars')} chars, {_HUMAN.format('(n_chars * 1000003)')} many, {_HUMAN.format('(n_chars * 10000000019)')} more from documents")
def b41_human_number(spark, load):
    n = F.col("n_chars")
    return load("documents").select("doc_id", T.human_number(n).alias("chars"), T.human_number(n * 1000003).alias("many"), T.human_number(n * 10000000019).alias("more"))


@query("select doc_id, (quality + 1 - 1.0) / 3.0 as label from labels")
def b42_rescale(spark, load):
    return load("labels").select("doc_id", T.rescale(F.col("quality") + 1).alias("label"))


@query(r"""select doc_id, array_to_string(list_transform(list_filter(list_transform(range(1, len(s) + 1), lambda i: {'i': i, 's': s[i]}), lambda e: list_position(s, e.s) = e.i), lambda e: e.s), ' ') as text
from (select doc_id, string_split(regexp_replace(text, '([.!?]) ', E'\\1\x01', 'g'), E'\x01') s from documents)""")
def b43_distinct_sentences(spark, load):
    return load("documents").select("doc_id", T.distinct_sentences(F.col("text")).alias("text"))


@query(r"""with a as (select conv_id, turn, case when turn % 3 = 0 then '# ANSWER ' || chr(65 + (turn % 6)::int) || chr(10) || text else text || chr(10) || '**********' || '# ANSWER B' end as text from conversations)
select conv_id, turn, nullif(regexp_extract(string_split(text, '**********')[1], '# ANSWER\s+([A-D])', 1), '') as answer from a""")
def b44_answer_letter(spark, load):
    t = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("# ANSWER "), F.char(65 + F.col("turn") % 6), F.lit("\n"), "text")).otherwise(F.concat("text", F.lit("\n**********# ANSWER B")))
    return load("conversations").select("conv_id", "turn", T.answer_letter(t).alias("answer"))


@query(r"""with m as (select doc_id, source, regexp_extract_all(replace(replace(text, ' the ', ' <<the '), '. ', '>>. '), '(?s)<<(.*?)>>', 1) s from documents)
select source, sum(list_sum(list_transform(s, lambda x: len(regexp_split_to_array(x, '[^\p{L}\p{M}\p{N}_]+')))))::bigint removed from m group by source""")
def b45_removed_spans(spark, load):
    t = F.replace(F.replace(F.col("text"), F.lit(" the "), F.lit(" <<the ")), F.lit(". "), F.lit(">>. "))
    return load("documents").groupBy("source").agg(F.sum(T.marked_tokens(t, "<<", ">>")).alias("removed"))


@query(f"select page_id, {strip(rx('html', ('</?[a-z]+>', ''), (r'(?:https?://|www\.)[^\t\n\f\r ]+', ''), (r'\[pmid:\d+\]', ''), (' {2,}', ' ')))} as text from pages")
def b46_strip_markup(spark, load):
    return load("pages").select("page_id", T.strip_markup(F.col("html")).alias("text"))


@query("""select doc_id, array_to_string(list_filter(['# INSTRUCTION' || chr(10) || 'Choose.', '# CONTEXT' || chr(10) || nullif(lang, 'en'), '# QUESTION' || chr(10) || text,
'# CHOICES' || chr(10) || 'A) ' || lang || chr(10) || 'B) ' || source, '# ANSWER'], lambda x: x is not null), chr(10) || chr(10)) as prompt from documents""")
def b47_qa_prompt(spark, load):
    context = F.when(F.col("lang") != "en", F.col("lang"))
    return load("documents").select("doc_id", T.qa_prompt(F.lit("Choose."), F.col("text"), F.array("lang", "source"), context).alias("prompt"))


@query("select conv_id, turn, regexp_replace(text, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g') || chr(10) || chr(10) || '# ANSWER' || chr(10) || role as text from conversations")
def b48_lm_text(spark, load):
    prompt = F.concat(T.strip(F.col("text")), F.lit("\n\n# ANSWER\n"))
    return load("conversations").select("conv_id", "turn", T.lm_text(prompt, F.col("role")).alias("text"))


@query("select doc_id, 'Represent this document: ' || text as text from documents")
def b49_embedding_prefix(spark, load):
    return load("documents").select("doc_id", F.concat(F.lit("Represent this document: "), "text").alias("text"))


@query("select source, string_agg(distinct lang, '|' order by lang) langs from documents group by source")
def b50_flatten_values(spark, load):
    return load("documents").groupBy("source").agg(F.array_join(F.sort_array(F.collect_set("lang")), "|").alias("langs"))
