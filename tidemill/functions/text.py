"""Scalar text functions from column to column; all of them stay inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_BREAK = r"(?U)\W+"
#: Separators, and with them all white space.
SEPARATORS = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
SPACES = "\t\n\x0b\f\r\x85" + SEPARATORS


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends. (Only one argument: F.transform gives a second one the place.)"""
    return F.btrim(c, F.lit(SPACES))


def rounded(c: Column, places: int) -> Column:
    """A double scaled, rounded to a whole number and scaled back, as SQL engines do; F.round goes by the decimal digits and differs at halves."""
    return F.round(c * float(10**places), 0) / float(10**places)


def chain(c: Column, *steps: tuple[str, str]) -> Column:
    """Regular expressions replaced one after the other."""
    return reduce(lambda x, s: F.regexp_replace(x, s[0], s[1]), steps, c)


def lines(c: Column) -> Column:
    return F.split(c, "\n", -1)


def each_line(c: Column, f) -> Column:
    return F.array_join(F.transform(lines(c), f), "\n")


def token_count(c: Column) -> Column:
    """Pieces between runs of non-word characters; empty pieces at the ends count."""
    return F.size(F.split(c, WORD_BREAK, -1)).cast("long")


def words_and_marks(c: Column) -> Column:
    """Words and single punctuation marks, our stand-in for a word tokenizer."""
    return F.regexp_extract_all(c, F.lit(r"([\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s])"), 1)


_SQUEEZE = ((r" +", " "), (r"\t+", " "))


def normalize_web(c: Column) -> Column:
    return each_line(strip(chain(c, (r"\n{2,}", "\n\n"), *_SQUEEZE)), strip)


def normalize_encyclopedia(c: Column) -> Column:
    """Squeezed as web text, with a title mark; lines keep their indents."""
    return strip(F.concat(F.lit("# "), chain(c, (r"\n{2,}", "\n\n"), *_SQUEEZE)))


def normalize_book(c: Column) -> Column:
    return each_line(normalize_encyclopedia(c), strip)


def normalize_scholarly(title: Column, abstract: Column, body: Column) -> Column:
    """Title and abstract headers; blocks in capitals become headers."""
    blocks = F.split(body, r"\n{2,}", -1)
    marked = F.array_join(F.transform(blocks, lambda b: F.when(F.upper(b) == b, F.concat(F.lit("## "), b)).otherwise(b)), "\n")
    whole = F.concat(F.lit("# "), title, F.lit("\n## ABSTRACT\n"), abstract, F.lit("\n"), marked)
    return each_line(chain(whole, *_SQUEEZE), strip)


def grant_abstract(c: Column) -> Column:
    plain = F.replace(F.replace(c, F.lit("[unreadable]"), F.lit("")), F.lit("DESCRIPTION (provided by applicant)"), F.lit(""))
    return strip(F.regexp_replace(plain, r"(?U)\s+", " "))


def remove_urls(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)(?:https|http)?://[\w./?=&%-]*\b", "")


def remove_references(c: Column) -> Column:
    return chain(c, (r"<.*?>", ""), (r"\[.*?\]\(.*?\)", ""), (r"\[.*?\]", ""))


def normalize_sections(c: Column, deepest: int = 3) -> Column:
    """Header levels moved so that the least is 1, and cut at the deepest."""
    least = F.array_min(F.transform(F.regexp_extract_all(c, F.lit(r"\n(#+)"), 1), lambda h: F.length(h)))
    moved = F.regexp_replace(c, F.concat(F.lit("\n"), F.repeat(F.lit("#"), least)), F.lit("\n#"))
    return F.when(c.contains("\n#"), F.regexp_replace(moved, "\n#{%d,}" % deepest, "\n" + "#" * deepest)).otherwise(c)


def normalize_lists(c: Column) -> Column:
    """Bullets of many kinds become '- '; as in the reference, a line that starts with the letter o is taken for one."""
    return chain(c, ("\n\\* ", "\n- "), ("\n•", "\n-"), ("\no", "\n-"), ("\n\uf0b7", "\n-"), ("\n\\+ ", "\n- "), ("• ", "- "), ("\\* ", "- "))


def remove_glyphs(c: Column) -> Column:
    return chain(F.translate(c, "◆•▪■□�", ""), (r"\*-", ""), ("\n>", "\n"), (r"\*\*", ""))


def normalize_newlines(c: Column) -> Column:
    """Lines without an ASCII letter go; a blank line before headers."""
    kept = F.filter(lines(c), lambda x: x.rlike("[a-zA-Z]"))
    text = F.when(F.size(kept) > 0, F.concat(F.array_join(kept, "\n"), F.lit("\n"))).otherwise(F.lit(""))
    return chain(text, (r"\n\s*\n", "\n"), (r"\n{2,}", "\n"), (r"\n#", "\n\n#"))


def clean_guideline(c: Column) -> Column:
    steps = (remove_urls, remove_references, normalize_lists, remove_glyphs, normalize_sections, normalize_newlines, strip)
    return reduce(lambda x, f: f(x), steps, c)


def join_sections(sections: Column) -> Column:
    """An ordered array of (name, text) as one text."""
    return F.array_join(F.transform(sections, lambda s: F.concat(F.lit("# "), s["name"], F.lit("\n\n"), s["text"])), "")


def deepen_headers(c: Column) -> Column:
    return F.regexp_replace(c, r"(?m)^#", "##")


def slice_between(c: Column, start: str, stops: list[str]) -> Column:
    """The text after the start mark and before the first of stops that occurs; marks that don't occur cut nothing."""
    at = F.locate(start, c)
    tail = F.when(at > 0, F.substring(c, at + len(start), F.length(c))).otherwise(c)
    cut = F.lit(None)
    for s in reversed(stops):
        cut = F.when(F.locate(s, tail) > 0, F.substring(tail, F.lit(1), F.locate(s, tail) - 1)).otherwise(cut)
    return F.coalesce(cut, tail)


def clinical_lines(c: Column) -> Column:
    """Lines squeezed; one blank line stands for any run of blank ones; no space before colons."""
    squeezed = F.transform(lines(strip(c)), lambda x: strip(F.regexp_replace(x, r"(?U)\s+", " ")))
    return chain(F.array_join(squeezed, "\n"), (r"\n{2,}", "\n\n"), (r" +:", ":"))


_MARKED = ("serial number", "identifier", "medical record number", "social security number", "age", "phone", "pager number", "contact info", "provider number", "name", "dictator",
           "attending", "hospital", "location", "address", "country", "state", "university", "year", "month", "date")
_ON_LINE = ("clip number", "holiday", "company", "job number", "unit number", "url", "[0-9]+")
#: De-identification marks in order: what is named near their start; dates by digits; what is named anywhere on the line; marks with a digit, and blank ones.
SCRUB = [
    *(rf"\[\*\*.{{0,15}}{w}.*?\*\*\]" for w in _MARKED),
    *(rf"\[?\*\*{d}\*\*\]?" for d in ("[0-9]{0,2}/[0-9]{0,4}", "[0-9]{0,4}", "(?:[0-9]{0,4}-)?[0-9]{0,2}-[0-9]{0,2}")),
    *(rf"\[?\*\*.*{w}.*\*\*\]?" for w in _ON_LINE),
    r"\[?\*\* +\*\*\]?",
]
#: The same for what is named anywhere on the line, in time linear in the line: from its first mark, if that is followed by the first such name and another mark, to its last.
_LINEAR = {rf"\[?\*\*.*{w}.*\*\*\]?": rf"(?m)^((?>.*?(?=\[?\*\*)))\[?\*\*(?>.*?{w.rstrip('+')}).*\*\*\]?" for w in _ON_LINE}


def bound(c: Column, f) -> Column:
    """f of a column that is evaluated once, however often f names it."""
    return F.get(F.transform(F.array(c), lambda x: f(x)), F.lit(0))


def scrub(c: Column, mark: str = "___") -> Column:
    """De-identification marks replaced rule by rule, whatever their case. Lines end at line feeds.

    A rule runs only over texts that still have marks and had its name: replacing makes no new ones.
    """

    def rules(text: Column, low: Column) -> Column:
        for k, p in enumerate(SCRUB):
            named = k < len(_MARKED)
            word = _MARKED[k] if named else _ON_LINE[k - len(_MARKED) - 3] if p in _LINEAR else None
            new = (f"(?id){_LINEAR[p]}", f"$1{mark}") if p in _LINEAR else (f"(?id){p}", mark)

            def step(t: Column, new=new, named=named, word=word) -> Column:
                can = F.contains(t, F.lit("[**" if named else "**"))
                can = can & F.contains(low, F.lit(word)) if word and word.replace(" ", "").isalpha() else can
                return F.when(can, F.regexp_replace(t, *new)).otherwise(t)

            text = bound(text, step)
        return text

    return bound(c, lambda t: bound(F.lower(t), lambda low: rules(t, low)))


def is_title(c: Column) -> Column:
    """Ends with a colon, and each word outside parentheses starts with a capital, but for of, on and or."""
    bare = F.regexp_replace(c, r"\([^)]*\)", "")
    words = F.filter(F.split(F.regexp_replace(strip(bare), ":$", ""), r"(?U)\s+"), lambda w: w != "")
    return c.endswith(":") & ~c.startswith("Disp") & (F.size(words) > 0) & F.forall(words, lambda w: w.isin("of", "on", "or") | w.rlike(r"^\p{Lu}"))


def header_of(c: Column) -> Column:
    """(header, text): up to the first of the first 5 words that ends with a colon."""
    words = F.split(c, " ")
    at = F.array_position(F.transform(F.slice(words, 1, 5), lambda w: w.endswith(":")), True)
    head = F.when(at > 0, F.array_join(F.slice(words, 1, at.cast("int")), " "))
    body = F.when(at > 0, F.array_join(F.slice(words, at.cast("int") + 1, F.size(words)), " ")).otherwise(c)
    return F.struct(head.alias("header"), body.alias("text"))


def paragraphs(c: Column, separator: str = r"\n{2,}") -> Column:
    return F.split(c, separator, -1)


def alnum_key(c: Column, prefix: int | None = None) -> Column:
    """Lower-case ASCII letters and digits alone, of the first characters if prefix is given."""
    return F.regexp_replace(F.lower(F.substring(c, 1, prefix) if prefix else c), "[^a-z0-9]", "")


def journal_key(c: Column) -> Column:
    return F.translate(F.replace(F.lower(c), F.lit("&"), F.lit("and")), ":,.-", "")


def first_words(c: Column, n: int) -> Column:
    return F.array_join(F.slice(F.split(c, " ", -1), 1, n), " ")


def human_number(c: Column) -> Column:
    """1000 as 1k, and mn, bn and tn."""
    out = F.when(c < 1_000, c.cast("string"))
    for size, name in ((1_000, "k"), (1_000_000, "mn"), (1_000_000_000, "bn")):
        out = out.when(c < size * 1000, F.concat(F.floor(c / size).cast("string"), F.lit(name)))
    return out.otherwise(F.concat(F.floor(c / 1_000_000_000_000).cast("string"), F.lit("tn")))


def rescale(c: Column, low: float = 1.0, high: float = 4.0) -> Column:
    return (c - low) / (high - low)


def distinct_sentences(c: Column) -> Column:
    """The first of equal sentences stays."""
    return F.array_join(F.array_distinct(F.split(c, r"(?<=[.!?]) ", -1)), " ")


def answer_letter(c: Column) -> Column:
    """The letter after '# ANSWER' before the first line of asterisks."""
    head = F.element_at(F.split(c, r"\*{10}"), 1)
    return F.nullif(F.regexp_extract(head, r"# ANSWER\s+([A-D])", 1), F.lit(""))


def marked_tokens(c: Column, start: str = "\x1b[31m", end: str = "\x1b[0m") -> Column:
    """Tokens of all spans between start and end marks."""
    spans = F.regexp_extract_all(c, F.lit(rf"(?s)\Q{start}\E(.*?)\Q{end}\E"), 1)
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + token_count(s))


def strip_markup(c: Column) -> Column:
    """Without plain tags, links and [pmid:n] marks, spaces squeezed."""
    return strip(chain(c, (r"</?[a-z]+>", ""), (r"(?:https?://|www\.)\S+", ""), (r"\[pmid:\d+\]", ""), (r" {2,}", " ")))


def lm_text(prompt: Column, completion: Column, marker: str = "# ANSWER") -> Column:
    """Prompt and completion as one text; the prompt has to end with its answer mark."""
    ends = strip(prompt).endswith(marker)
    return F.when(ends, F.concat(strip(prompt), F.lit("\n"), strip(completion))).otherwise(F.raise_error(F.lit(f"a prompt doesn't end with {marker}")))


def letter(i: Column) -> Column:
    return F.char(i + 65)


def choices_block(choices: Column) -> Column:
    return F.array_join(F.transform(choices, lambda c, i: F.concat(letter(i), F.lit(") "), c)), "\n")


def qa_prompt(instruction: Column, question: Column, choices: Column | None = None, context: Column | None = None) -> Column:
    """Blocks of instruction, context, question and choices, then the answer mark; blocks that are null are left out."""
    block = lambda name, c: F.when(c.isNotNull(), F.concat(F.lit(f"# {name}\n"), c))
    parts = [block("INSTRUCTION", instruction)] + ([block("CONTEXT", context)] if context is not None else []) + [block("QUESTION", question)]
    if choices is not None:
        parts.append(block("CHOICES", choices_block(choices)))
    return F.concat_ws("\n\n", *parts, F.lit("# ANSWER"))


def meta_json(*extras: str) -> Column:
    return F.to_json(F.struct(*extras), {"ignoreNullFields": "false"})


def hash_draw(key: Column, seed: int = 1992) -> Column:
    """A number in [0, 1) that depends on the key and seed alone."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}-"), key.cast("string"))), 1, 8), 16, 10).cast("long") / float(1 << 32)
