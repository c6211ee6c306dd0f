"""Truncation, header groups and the 18 guideline rules (G1 to G18), each over all documents, with its SQL: stages of lists of lines."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from ..functions import arrow as A
from ..operators import guidelines as G
from .registry import query
from .text_queries import GLYPHS, LISTS, REFS, URLS, newlines, rx, strip

NL = "chr(10)"
ORDER = ("aafp", "cco", "cdc_diseases", "cdc", "cma", "cma_pdfs", "cps", "drugs", "gc", "icrc", "idsa", "magic", "mayo", "nice", "rch", "spor", "who", "wikidoc")


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _starts(words: tuple[str, ...]) -> str:
    return "(" + " or ".join(f"starts_with(v.{k}, {_q(w)})" for w in words for k in "xabc") + ")" if words else "false"


def _any(c: str, words: tuple[str, ...]) -> str:
    return "(" + " or ".join(f"contains({c}, {_q(w)})" for w in words) + ")"


def _each(f: str, source: str = "t") -> str:
    """Lines x as f has them, null for none, each ended by a line break."""
    kept = f"list_filter(list_transform(string_split({source}, {NL}), lambda x: {f}), lambda y: y is not null)"
    return f"case when len({kept}) > 0 then array_to_string({kept}, {NL}) || {NL} else '' end"


BARE = strip("replace(lower(x), '#', '')")
FEW = rf"len(list_filter(regexp_split_to_array({strip('x')}, '[\s\p{{Z}}]+'), lambda w: w <> '')) < 3"
LETTERS = "regexp_replace(x, '[^a-zA-Z]', '', 'g')"
LINES = {
    "aafp": rf"case when len(list_filter(regexp_split_to_array({BARE}, '[\s\p{{Z}}]+'), lambda w: length(w) > 1)) = 0 or starts_with(lower(title), {BARE}) or contains({BARE}, '|') or contains({BARE}, 'http') then null else x end",
    "cco": f"case when starts_with({strip('x')}, '•') then '- ' || {strip('substr(x, 2)')} when {FEW} or {LETTERS} = '' then null else regexp_replace(x, '^o ', '- ') end",
    "cdc_diseases": f"case when {FEW} or {_any('x', ('insurance', ' | CDC'))} then null else replace(replace(replace(x, '+ ', '- '), '**', ''), '*', '- ') end",
    "cma": f"case when contains(x, '|') or contains(x, title) or starts_with({strip('lower(x)')}, 'table') or starts_with({strip('lower(x)')}, 'figure') then null else x end",
    "cma_pdfs": "case when regexp_full_match({0}, '(•|[0-9]*)') then null else regexp_replace(x, '^[0-9]+\\.\\s', '- ') end".format(strip("regexp_replace(x, '[#.]', '', 'g')")),
    "cps": f"case when {FEW} or {_any('x', G._CPS)} then null else {strip('x')} end",
    "gc": f"case when {strip('x')} = '(c)' then null when regexp_matches(x, '[A-Z]') and not regexp_matches(x, '[a-z]') and length(regexp_replace(x, '[^a-zA-Z0-9]', '', 'g')) > 2 then {NL} || '# ' || {strip('x')} else {strip('x')} end",
    "icrc": f"case when {LETTERS} = '' then null when regexp_matches(x, '^[0-9]+[a-zA-Z]') then '- ' || {strip('substr(x, 2)')} else x end",
    "idsa": f"case when regexp_full_match(string_split({BARE}, '.')[1], '[0-9]+') then '- ' || {strip(f'''substr(x, case when contains({BARE}, '.') then strpos({BARE}, '.') + 1 else 1 end)''')} when starts_with(lower(title), {BARE}) then null else x end",
    "who": f"case when {FEW} then null else replace({strip('''replace(x, '• ', '- ')''')}, '{G.MARK}', '') end",
}


def _truncated(rule: G.Rule) -> str:
    """CTEs that cut t of o, as t of c."""
    return f"""v as (select *, list_transform(string_split(t, {NL}), lambda x: {{'x': x, 'a': {strip('lower(x)')}, 'b': {BARE}, 'c': trim(regexp_replace(lower(x), '[^a-z ]', '', 'g'))}}) l from o),
f as (select *, list_transform(l, lambda v: {_starts(rule.starters)}) s, list_transform(l, lambda v: {_starts(rule.removers)}) r, list_transform(l, lambda v: {_starts(rule.stoppers)}) p, range(1, len(l) + 1) i from v),
g as (select *, coalesce(list_min(list_filter(i, lambda k: s[k])), 1000000000) i0, coalesce(list_min(list_filter(i, lambda k: p[k] and not r[k] and not s[k])), 1000000000) p0 from f),
h as (select *, coalesce(list_min(list_filter(i, lambda k: k > i0 and p[k] and not r[k])), 1000000000) p1 from g),
c as (select doc_id, title, title0, {strip(f'''array_to_string(list_transform(list_filter(i, lambda k: case when i0 < p0 then k = i0 or k > i0 and k < p1 and not r[k] and l[k].c <> '' else k < p0 and not r[k] and l[k].c <> '' end), lambda k: l[k].x), {NL})''')} t from h)"""


def _sql(kind: str) -> str:
    rule, source = G.RULES[kind], "select doc_id, source title, source title0, text t from documents"
    stages = [f"d as ({source})"]
    opening = {"icrc": ("title", "t"), "rch": ("title", "t")}.get(kind, ("title", strip("t")))
    where = ""
    if kind in ("cma", "idsa"):
        opening = (f"string_split({strip('t')}, {NL})[1]", strip("t"))
    if kind == "aafp":
        opening = (strip("title"), strip("t"))
        where = " where not coalesce(ends_with(rtrim(list_filter(string_split(t, chr(10)), lambda x: starts_with(x, 'The AAFP supports'))[1]), 'on this topic.'), false)"
    if kind == "cdc_diseases":
        where = f" where {strip(f'string_split({strip('t')}, {NL})[1]')} <> '### Disease Directory'"
    if kind == "idsa":
        where = " where not contains(t, 'This new guideline is currently in development')"
    if kind == "drugs":
        opening = (strip("string_split(title, ' - ')[1]"), f"array_to_string(list_filter(string_split({strip('t')}, {NL}), lambda x: not contains(x, '|')), {NL})")
    if kind == "gc":
        opening = (f"replace(replace({strip('title')}, '[\"', ''), '\"]', '')", f"replace(replace({strip('t')}, '[\"', ''), '\"]', '')")
    if kind in ("mayo", "nice"):
        out = "" if kind == "mayo" else " where contains(lower(n), 'discussion') or not (" + " or ".join(f"contains(lower(n), {_q(w)})" for w in G.NICE_OUT) + ")"
        stages = [f"d as (select doc_id, source title, source title0, (select string_agg('# ' || n || {NL} || {NL} || s, '' order by k) from (values (1, source, text), (2, 'Update on ' || lang, lang), (3, 'Discussion of updates', lang)) x(k, n, s){out}) t from documents)"]
    if kind == "magic":
        stages.append(f"""m as (select *, string_split({strip('t')} || {NL} || {NL}, {NL}) s from d), n as (select *, len(s) n, list_transform(s, lambda x: regexp_full_match({strip('x')}, '[0-9]+')) z from m),
k as (select *, list_transform(range(1, greatest(n - 2, 1)), lambda j: z[j] and not z[j + 1] and z[j + 2]) h from n),
o as (select doc_id, title, title0, array_to_string(list_concat(list_transform(list_filter(range(1, n - 2), lambda j: h[j] or not coalesce(h[j - 1], false)), lambda j: case when h[j] then '# ' || {strip('s[j + 1]')} else {strip('s[j + 1]')} end), list_slice(s, case when coalesce(h[n - 3], false) then n - 1 else n - 2 end, n)), {NL}) t from k)""")
    else:
        stages.append(f"o as (select doc_id, {opening[0]} title, title0, {opening[1]} t from d{where})")
    stages.append(_truncated(rule) if rule.cut else "c as (select * from o)")
    title, body = "title", "t"
    if kind == "cdc_diseases":
        title = strip(f"substr(string_split(t, {NL})[1], 4)")
    if kind in LINES:
        body = _each(LINES[kind])
    if kind == "cdc":
        stop = f"coalesce(list_min(list_filter(range(1, len(l) + 1), lambda k: not starts_with(l[k], 'q ') and starts_with(lower(regexp_replace(l[k], '[^a-zA-Z]', '', 'g')), 'acknowledg'))), len(l) + 1)"
        stages.append(f"c2 as (select doc_id, title, title0, array_to_string(list_slice(l, 1, {stop} - 1), {NL}) t, {stop} = 1 none from (select *, string_split(t, {NL}) l from c))")
        words = f"array_to_string(list_transform(string_split(x, ' '), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ')"
        body = f"case when none then '' else {_each(f'''case when {strip("regexp_replace(x, '[•#]', '', 'g')")} = '' then null when starts_with(x, 'q ') then '- ' || {strip('substr(x, 3)')} when starts_with(x, '#') and not regexp_matches(x, '[a-z]') then {words} else {strip('x')} end''')} end"
    if kind == "wikidoc":
        last = "list_max(list_filter(range(1, k + 1), lambda j: starts_with(l[j], 'Any recommendations found on these pages') or starts_with(l[j], '#')))"
        stages.append(f"c2 as (select doc_id, title, title0, list_transform(list_filter(range(1, len(l) + 1), lambda k: starts_with(l[k], '#') or not starts_with(l[k], 'Any recommendations found on these pages') and not starts_with(l[k], 'CLASS') and coalesce(starts_with(l[{last}], '#'), true)), lambda k: l[k]) l from (select *, string_split(t, {NL}) l from c))")
        body = f"regexp_replace(case when len(l) > 0 then array_to_string(l, {NL}) || {NL} else '' end, 'Redirect to.*', '', 'g')"
    if kind == "drugs":
        body = f"replace({strip(rx('''replace(t, '*', '-')''', (r'[\[\]]', ''), (r'\([^)]+\)', '')))}, '--', '')"
    if kind == "spor":
        body = f"array_to_string(list_transform(list_filter(string_split(replace(replace(t, '|', ''), '---', {NL}), {NL}), lambda x: not ({FEW})), lambda x: {strip('x')}), {NL})"
    if kind == "magic":
        stages.append(f"""c2 as (select *, array_to_string(list_transform(list_filter(string_split(t, {NL}), lambda x: {BARE} <> '' and not contains(x, '|')), lambda x: {strip('x')}), {NL}) u from c),
c3 as (select *, string_split({strip(f'''replace(replace(replace(replace(replace(u, {NL} || '**', {NL} || '## '), '*', ''), {NL} || '(', '('), {NL} || ')', ')'), {NL} || ';', ';')''')}, {NL}) l from c2)""")
        head = "trim(regexp_replace(lower(l[list_max(list_filter(range(1, k + 1), lambda j: j = 1 or starts_with(l[j], '#')))]), '[^a-z ]', '', 'g'))"
        skipped = " or ".join(f"starts_with({head}, {_q(w)})" for w in G._MAGIC_HEADERS)
        number = "regexp_full_match(trim(regexp_replace(lower(l[k]), '[^a-z0-9 ]', '', 'g')), '[0-9]+')"
        body = f"array_to_string(list_transform(list_filter(range(1, len(l) + 1), lambda k: not ({skipped}) and not starts_with(l[k], '!') and not {number}), lambda k: case when starts_with(l[k], '#') and len(string_split(l[k], ' ')) > 7 then {strip('''replace(l[k], '#', '')''')} else l[k] end), {NL})"
    if rule.headed:
        body = f"{'title0' if kind == 'cdc_diseases' else 'title'} || {NL} || {NL} || ({body})"
    if kind == "idsa":
        body = f"replace(replace(replace(replace(replace({body}, ' ,', ''), ' .', '.'), '*', ''), ' )', ''), '-. ', '- ')"
    last = stages[-1].split(" as (select")[0].rsplit("\n", 1)[-1].split(" ")[-1] if kind in ("cdc", "wikidoc", "magic") else "c"
    last = {"cdc": "c2", "wikidoc": "c2", "magic": "c3"}.get(kind, "c")
    stages.append(f"e as (select doc_id, {title} title, {body} t from {last})")
    if kind in G.UNCLEANED:
        stages.append("z as (select * from e)")
    else:
        stages.append(f"""e1 as (select doc_id, title, {rx('t', URLS, *REFS, *LISTS, *GLYPHS)} t from e), e2 as (select *, list_min(list_transform(regexp_extract_all(t, E'\\n#+'), lambda x: length(x) - 1)) n from e1),
e3 as (select doc_id, title, case when contains(t, E'\\n#') then {rx('''replace(t, chr(10) || repeat('#', n::int), E'\\n#')''', ("\n#{3,}", "\n###"))} else t end t from e2),
z as (select doc_id, title, {strip(newlines('t'))} t from e3)""")
    done = {"cdc": f"replace(t, {NL} || '# -', {NL} || '#')", "mayo": f"array_to_string(list_filter(string_split(t, {NL}), lambda x: not contains(x, 'MayoClinic')), {NL})", "nice": f"title || {NL} || {NL} || t"}.get(kind, "t")
    long = f"len(list_filter(string_split(t, {NL}), lambda x: len(string_split(x, ' ')) > 10)) >= 3"
    kept = {"gc": long, "wikidoc": long, "idsa": f"len(string_split(t, {NL})) >= 5", "cps": f"len(string_split(t, {NL})) >= 3"}.get(kind, "true")
    return f"with {', '.join(stages)} select doc_id, title, text from (select doc_id, title, {done} as text, {kept} as kept from z) where kept and length(text) > 0"


@query(f"with o as (select doc_id, source title, source title0, text t from documents), {_truncated(G.Rule(('the', 'la'), ('de', 'of'), ('licensed', 'released')))} select doc_id, t as text from c")
def b14_truncate(spark, load):
    cut = A.arrow(lambda t: A.truncate(t, ("the", "la"), ("de", "of"), ("licensed", "released")), "string", pa.string())
    return load("documents").select("doc_id", cut(F.col("text")).alias("text"))


@query(f"""with l as (select doc_id, list_transform(string_split(text, {NL}), lambda x: {{'g': []::varchar[], 'h': x}}) l from documents),
r as (select doc_id, list_reduce(l, lambda a, b: case when not starts_with(b.h, '#') and len(string_split(case when a.h is null then b.h else a.h || {NL} || b.h end, ' ')) >= 32
  then {{'g': list_append(a.g, case when a.h is null then b.h else a.h || {NL} || b.h end), 'h': null::varchar}} else {{'g': a.g, 'h': case when a.h is null then b.h else a.h || {NL} || b.h end}} end, {{'g': []::varchar[], 'h': null::varchar}}) r from l),
g as (select doc_id, case when r.h is null then r.g else list_append(r.g, r.h) end g from r)
select doc_id, (i - 1)::int pos, g[i] as paragraphs from g, lateral (select unnest(range(1, len(g) + 1)) i)""")
def b27_group_headers(spark, load):
    f = A.arrow(lambda t: A.group_headers(t.split("\n")), "array<string>", A.STRINGS)
    return load("documents").select("doc_id", F.posexplode(f(F.col("text"))).alias("pos", "paragraphs"))


def _register(n: int, kind: str) -> None:
    def run(spark, load):
        d = load("documents")
        part = lambda name, text: F.struct(name.alias("name"), text.alias("text"))
        sections = F.array(part(F.col("source"), F.col("text")), part(F.concat(F.lit("Update on "), "lang"), F.col("lang")), part(F.lit("Discussion of updates"), F.col("lang")))
        return G.clean_guidelines(d.select("doc_id", F.lit(kind).alias("kind"), F.col("source").alias("title"), "text", sections.alias("sections"))).select("doc_id", "title", "text")

    run.__name__, run.__doc__ = f"g{n}_{kind}", f"The rule of {kind} over all documents."
    query(_sql(kind))(run)


for _n, _kind in enumerate(ORDER, 1):
    _register(_n, _kind)
