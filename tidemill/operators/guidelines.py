"""Guideline cleaning as one operator: a rule for each kind of source, before and after the cleaning that all share.

Rules have state from line to line, so documents go through Arrow batches once; as columns the shared cleaning would be spelled out again wherever a later rule looks at it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import slices, truncate

MARK = ""  # a bullet of a private font
Lines = Callable[[list[str], str], Iterable[str]]


@dataclass(frozen=True)
class Rule:
    """opening: (title, text) before anything else, None drops the document. cut: whether the text is truncated by starters, removers and stoppers.
    lines: the lines that stay, given all and the title. closing: over the joined lines. headed: the title goes before the text."""

    starters: tuple[str, ...] = ()
    removers: tuple[str, ...] = ()
    stoppers: tuple[str, ...] = ()
    opening: Callable[[str, str], tuple[str, str] | None] = lambda title, text: (title, text.strip())
    cut: bool = True
    lines: Lines | None = None
    closing: Callable[[str], str] = lambda text: text
    headed: bool = False
    from_sections: bool = False


def _bare(line: str) -> str:
    return line.lower().replace("#", "").strip()


def _letters(line: str) -> str:
    return re.sub("[^a-zA-Z]", "", line)


def _few(line: str, least: int = 3) -> bool:
    return len(line.split()) < least


def _first_line_title(title: str, text: str) -> tuple[str, str]:
    text = text.strip()
    return text.split("\n")[0], text


def _aafp_opening(title: str, text: str) -> tuple[str, str] | None:
    """Documents that endorse those of others go."""
    said = [x for x in text.strip().split("\n") if x.startswith("The AAFP supports")]
    if said and said[0].strip().endswith("on this topic."):
        return None
    return title.strip().replace(" | AAFP", "").replace(" - Choosing Wisely", ""), text.strip()


def _aafp(lines: list[str], title: str) -> Iterable[str]:
    for x in lines:
        bare = _bare(x)
        if not (all(len(w) == 1 for w in bare.split()) or title.lower().startswith(bare) or "|" in bare or "http" in bare):
            yield x


def _cco(lines: list[str], title: str) -> Iterable[str]:
    for x in lines:
        if x.strip().startswith("•"):
            yield "- " + x[1:].strip()
        elif not _few(x) and _letters(x):
            yield re.sub("^o ", "- ", x)


_TRAVEL = ("insurance", " | CDC")


def _cdc_diseases_opening(title: str, text: str) -> tuple[str, str] | None:
    """A list of diseases is no guideline."""
    return None if text.strip().split("\n")[0].strip() == "### Disease Directory" else (title, text.strip())


def _cdc_diseases(lines: list[str], title: str) -> Iterable[str]:
    for x in lines:
        if not _few(x) and not any(s in x for s in _TRAVEL):
            yield x.replace("+ ", "- ").replace("**", "").replace("*", "- ")


def _cdc(lines: list[str], title: str) -> Iterable[str]:
    """Nothing from the acknowledgements on; headers in capitals are written as words."""
    for x in lines:
        letters = _letters(x)
        if not re.sub("[•#]", "", x).strip():
            continue
        if x.startswith("q "):
            yield "- " + x[2:].strip()
        elif letters.lower().startswith("acknowledg"):
            return
        elif x.startswith("#") and (not letters or letters.isupper()):
            yield " ".join(w.capitalize() for w in x.split(" "))
        else:
            yield x.strip()


def _cma(lines: list[str], title: str) -> Iterable[str]:
    """Tables and figures go up to the next blank line."""
    inside = False
    for x in lines:
        bare = x.strip().lower()
        if bare.startswith(("table", "figure")):
            inside = True
        elif "|" in x or title in x:
            continue
        elif inside:
            inside = x != ""
        else:
            yield x


def _cma_pdfs(lines: list[str], title: str) -> Iterable[str]:
    for x in lines:
        bare = re.sub("[#.]", "", x).strip()
        if bare not in ("", "•") and not bare.isdigit():
            yield re.sub(r"^\d+\.\s", "- ", x)


_CPS = ("|", "Figure", "The Canadian Paediatric Society gives permission", "Keywords:", "Key words:")


def _cps(lines: list[str], title: str) -> Iterable[str]:
    return (x.strip() for x in lines if not _few(x) and not any(s in x for s in _CPS))


def _drugs_opening(title: str, text: str) -> tuple[str, str]:
    return title.split(" - ")[0].strip(), "\n".join(x for x in text.strip().split("\n") if "|" not in x)


def _drugs_closing(text: str) -> str:
    return re.sub(r"\([^)]+\)", "", re.sub(r"[\[\]]", "", text.replace("*", "-"))).strip().replace("--", "")


def _gc_opening(title: str, text: str) -> tuple[str, str]:
    title, text = title.strip(), text.strip()
    if title == "Title":
        title, text = "", text[6:]
    odd = lambda t: t.replace('["', "").replace('"]', "")
    return odd(title), odd(text)


def _gc(lines: list[str], title: str) -> Iterable[str]:
    """Lines in capitals become headers."""
    for x in map(str.strip, lines):
        letters = re.sub("[^a-zA-Z0-9]", "", x)
        if x != "(c)":
            yield f"\n# {x}" if letters.isupper() and len(letters) > 2 else x


def _icrc(lines: list[str], title: str) -> Iterable[str]:
    for x in lines:
        if _letters(x):
            yield "- " + x[1:].strip() if re.match(r"\d+[a-zA-Z]+", x) else x


def _idsa_opening(title: str, text: str) -> tuple[str, str] | None:
    return None if "This new guideline is currently in development" in text else _first_line_title(title, text)


def _idsa(lines: list[str], title: str) -> Iterable[str]:
    for x in lines:
        bare = _bare(x)
        if bare.split(".")[0].isdigit():
            yield "- " + x[bare.find(".") + 1 :].strip()
        elif not title.lower().startswith(bare):
            yield x


def _idsa_closing(text: str) -> str:
    for a, b in ((" ,", ""), (" .", "."), ("*", ""), (" )", ""), ("-. ", "- ")):
        text = text.replace(a, b)
    return text


def _magic_opening(title: str, text: str) -> tuple[str, str]:
    """Chunks that were still loading go. A line between two lines of a number is a header; the first line goes, as do the numbers."""
    chunks = [c for c in text.strip().split("Loading Data...\n") if "Write remark here" not in c and "Write header here" not in c]
    s, out, i = "".join(c + "\n\n" for c in chunks).split("\n"), [], 0
    while i < len(s) - 3:
        before, now, after = (x.strip() for x in s[i : i + 3])
        header = before.isdigit() and not now.isdigit() and after.isdigit()
        out.append(f"# {now}" if header else now)
        i += 2 if header else 1
    return title, "\n".join([*out, *s[i:]])


_MAGIC_HEADERS = (
    "acknowledgements", "acknowledgments", "authorship", "contributors", "date of publication", "declarations of interest", "disclaimer", "disclosure",
    "external reviewers", "funding", "isbn", "members", "previous versions in magicapp", "publication approval", "publisher", "references",
)


def _magic_closing(text: str) -> str:
    """Sections below the headers that are not wanted go, and headers of more than seven words are text."""
    text = "\n".join(x.strip() for x in text.split("\n") if _bare(x) and "|" not in x)
    text = text.replace("\n**", "\n## ").replace("*", "")
    for mark in "();":
        text = text.replace("\n" + mark, mark)
    out, skipping = [], False
    for k, x in enumerate(text.strip().split("\n")):
        if x.startswith("#") or not k:
            skipping = re.sub("[^a-z ]", "", x.lower()).strip().startswith(_MAGIC_HEADERS)
        if skipping or x.startswith("!") or re.sub("[^a-z0-9 ]", "", x.lower()).strip().isdigit():
            continue
        out.append(x.replace("#", "").strip() if x.startswith("#") and len(x.split(" ")) > 7 else x)
    return "\n".join(out)


def _spor_closing(text: str) -> str:
    return "\n".join(x.strip() for x in text.replace("|", "").replace("---", "\n").split("\n") if not _few(x))


def _who(lines: list[str], title: str) -> Iterable[str]:
    return (x.replace("• ", "- ").strip().replace(MARK, "") for x in lines if not _few(x))


def _wikidoc(lines: list[str], title: str) -> Iterable[str]:
    """A disclaimer goes up to the next header."""
    inside = False
    for x in lines:
        if x.startswith("Any recommendations found on these pages"):
            inside = True
        elif x.startswith("#"):
            inside = False
            yield x
        elif not inside and not x.startswith("CLASS"):
            yield x


RULES: dict[str, Rule] = {
    "aafp": Rule(
        ("clinical preventive service recommendation", "key recommendations", "recommendation"),
        ("**[", "---", "===", "[", "http"),
        ("*keyboard\\_tab*", "*these guidelines are provided only", "*these recommendations are provided only", "more about choosing wisely", "more about practice guidelines", "references", "related content", "sources"),
        _aafp_opening, lines=_aafp, headed=True,
    ),
    "cco": Rule(
        ("guideline objectives", "intended purpose", "introduction", "questions"),
        ("an assessment conducted in ", "care has been taken in the preparation ", "these guidelines recommendations have been endorsed", "this is a quick reference guide", "this report is copyrighted by"),
        lines=_cco,
    ),
    "cdc": Rule(cut=False, lines=_cdc),
    "cdc_diseases": Rule(("###",), _TRAVEL, ("after travel", "more information"), _cdc_diseases_opening, lines=_cdc_diseases, headed=True),
    "cma": Rule(
        ("### 1. what", "### abstract", "### key information", "### what", "introduction", "key information", "overview", "preamble"),
        ("![", "* [", "+ [", "---", "===", "[", "figure", "footnote", "refer to", "table", "|"),
        ("### authors’ statement", "### references", "### selected references", "acknowledgements", "acknowledgments", "additional resources", "additional tables", "appendix", "list of abbreviations", "references", "report a problem", "selected references"),
        _first_line_title, lines=_cma, headed=True,
    ),
    "cma_pdfs": Rule(stoppers=("acknowledg", "conflict of interest", "disclaimer", "funding"), lines=_cma_pdfs),
    "cps": Rule(("### abstract",), _CPS, ("acknowledgements", "current:  about cps position", "selected resources"), lines=_cps),
    "drugs": Rule(removers=("###", "* [", "---", "===", "[", "[medical", "always consult your healthcare provider", "frequently asked", "further information", "more about"), opening=_drugs_opening, closing=_drugs_closing),
    "gc": Rule(("document objectives",), ("(c)", "http", "publication date", "www"), ("disclaimer", "recommendation grading", "source citation"), _gc_opening, lines=_gc),
    "icrc": Rule(stoppers=("acknowledgements", "acknowledgments", "contacts"), opening=lambda title, text: (title, text), lines=_icrc),
    "idsa": Rule(
        ("abstract", "introduction"),
        ("---", "===", "[!", "appropriate use criteria", "published"),
        ("acknowledgments", "disclaimer", "for more information", "notes", "references", "supplementary", "to access a more user", "to view the full version"),
        _idsa_opening, lines=_idsa, closing=_idsa_closing, headed=True,
    ),
    "magic": Rule(
        ("abstract", "introduction"),
        ("![", "---", "< less", "===", "about this guideline", "loading data...", "more >", "please visit the", "updates", "view section text", "write general section text"),
        opening=_magic_opening, closing=_magic_closing,
    ),
    "mayo": Rule(cut=False, from_sections=True, opening=lambda title, text: (title, text)),
    "nice": Rule(cut=False, from_sections=True, opening=lambda title, text: (title, text)),
    "rch": Rule(cut=False, opening=lambda title, text: (title, text)),
    "spor": Rule(stoppers=("conflict of interest",), closing=_spor_closing),
    "who": Rule(("introduction ",), ("under the terms of this licence", "|"), ("acknowl",), lines=_who),
    "wikidoc": Rule(
        removers=("associate editor", "click here", "editor", "for patient information click here", "how to edit trial information", "media:", "template:", "to go back to the main page"),
        stoppers=("external links",), lines=_wikidoc, closing=lambda text: re.sub("Redirect to.*", "", text),
    ),
}
UNCLEANED = ("cdc_diseases", "rch")


def apply_rule(kind: str, title: str | None, text: str | None) -> tuple[str | None, str] | None:
    """(title, text) up to the shared cleaning, or None for a document that goes."""
    rule = RULES[kind]
    if text is None or (opened := rule.opening(title or "", text)) is None:
        return None
    name, text = opened
    if rule.cut:
        text = truncate(text, rule.starters, rule.removers, rule.stoppers)
    if kind == "cdc_diseases":
        name = text.split("\n")[0][3:].strip()
    if rule.lines:
        text = "".join(x + "\n" for x in rule.lines(text.split("\n"), name))
    text = rule.closing((f"{(title or '') if kind == 'cdc_diseases' else name}\n\n" if rule.headed else "") + text)
    return (None if title is None and not rule.headed else name), text


_CLEANING = [(re.compile(p), r) for p, r in (
    (r"(?:https|http)?://[\w./?=&%-]*\b", ""), ("<.*?>", ""), (r"\[.*?\]\(.*?\)", ""), (r"\[.*?\]", ""),
    (rf"\n(?:•|o|{MARK})", "\n-"), (r"\n[*+] ", "\n- "), (r"[•*] ", "- "), (r"\*-|[◆•▪■□�]", ""), (r"\n>", "\n"), (r"\*\*", ""),
)]


def clean(text: str, deepest: int = 3) -> str:
    """What all kinds share: no URLs or references, one kind of bullet, headers from the first level on, no lines without a letter."""
    for pattern, new in _CLEANING:
        text = pattern.sub(new, text)
    marks = re.findall(r"\n(#+)", text)
    if marks:
        text = text.replace("\n" + min(marks, key=len), "\n#")
        text = re.sub("\n#{%d,}" % deepest, "\n" + "#" * deepest, text)
    kept = [x for x in text.split("\n") if re.search("[a-zA-Z]", x)]
    return "\n".join(f"\n{x}" if k and x.startswith("#") else x for k, x in enumerate(kept)).strip()


#: Section names that a source leaves out, but for discussions.
NICE_OUT = ("advice", "committee", "implementation", "team", "update")


def joined(kind: str, sections: list[dict]) -> str | None:
    """The sections that a kind keeps as one text; None if none stays."""
    left = [s for s in sections if kind != "nice" or "discussion" in s["name"].lower() or not any(w in s["name"].lower() for w in NICE_OUT)]
    return "".join(f"# {s['name']}\n\n{s['text']}" for s in left) if left or kind != "nice" else None


def guideline(kind: str, title: str | None, text: str | None, sections: list[dict] | None = None, overview: str | None = None) -> tuple[str | None, str] | None:
    """(title, text) of a document by the rule of its kind, or None if it goes."""
    if kind not in RULES:
        return None
    if RULES[kind].from_sections and sections is not None:
        text = joined(kind, sections)
    if (got := apply_rule(kind, title, text)) is None:
        return None
    title, text = got
    text = text if kind in UNCLEANED else clean(text)
    if kind == "cdc":
        text = text.replace("\n# -", "\n#")
    elif kind == "mayo":
        text = "\n".join(x for x in text.split("\n") if "MayoClinic" not in x)
    elif kind == "nice":
        text = "".join(f"{x}\n\n" for x in (title, overview) if x) + text
    lines = text.split("\n")
    if len(lines) < {"idsa": 5, "cps": 3}.get(kind, 0) or kind in ("gc", "wikidoc") and sum(len(x.split(" ")) > 10 for x in lines) < 3:
        return None
    return title, text


def cleaned_batches(batches: Iterable[pa.RecordBatch], min_chars: int = 0) -> Iterable[pa.RecordBatch]:
    """(doc_id, kind, title, text) of batches of (doc_id, kind, title, text, sections, overview), some rows at a time."""
    kinds = [pa.int64(), *[pa.string()] * 3]
    for b in (part for whole in batches for part in slices(whole)):
        rows = []
        for i, kind, *given in zip(*(c.to_pylist() for c in b.columns)):
            got = guideline(kind, *given)
            if got and len(got[1]) > min_chars:
                rows.append((i, kind, *got))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["doc_id", "kind", "title", "text"])


def clean_guidelines(df: DataFrame, min_chars: int = 0) -> DataFrame:
    """(doc_id, kind, title, text) of the rows of df (doc_id, kind, title, text and, for sources that have them, sections as an array of (name, text) and overview) that their rule keeps.

    Rows of unknown kinds, without a text or with none left go. Where df has no sections, those sources' texts are taken as they are.
    """
    sections = F.col("sections") if "sections" in df.columns else F.lit(None).cast("array<struct<name: string, text: string>>")
    overview = F.col("overview") if "overview" in df.columns else F.lit(None)
    by_parts = F.coalesce(F.col("kind").isin(*(k for k, rule in RULES.items() if rule.from_sections)), F.lit(False))
    text = F.when(by_parts & F.col("sections").isNotNull(), F.lit("")).otherwise(F.col("text"))  # a rule looks at the sections or at the text, so one of them travels
    rows = df.select(F.col("doc_id").cast("long"), "kind", F.col("title").cast("string"), F.col("text").cast("string"), F.when(by_parts, sections).alias("sections"), overview.cast("string").alias("overview"))
    return rows.withColumn("text", text).mapInArrow(partial(cleaned_batches, min_chars=min_chars), "doc_id long, kind string, title string, text string")
