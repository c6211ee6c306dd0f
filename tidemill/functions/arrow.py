"""Sequential text logic that columns can't express, as plain functions and as Arrow UDFs over whole batches."""

from __future__ import annotations

import heapq
import html
import re
from collections.abc import Callable
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def slices(batch: pa.RecordBatch | pa.Array, most_rows: int = 256, most_bytes: int = 1 << 20):
    """Views of a batch of at most so many rows, and on the average so many bytes: what a pass makes of its values is as small, however large a batch is."""
    step = max(1, min(most_rows, len(batch) * most_bytes // max(1, batch.nbytes)))
    for i in range(0, len(batch), step):
        yield batch.slice(i, step)


def arrow(f: Callable, kind: str, arrow_type: pa.DataType) -> Callable[..., Column]:
    """A plain function of one or more values as a column function; null in the first value gives null."""

    def call(*columns: Column) -> Column:
        if len(columns) == 1:

            @F.arrow_udf(kind)
            def one(a: pa.Array) -> pa.Array:
                return pa.concat_arrays([pa.array([None if x is None else f(x) for x in part.to_pylist()], arrow_type) for part in slices(a)] or [pa.array([], arrow_type)])

            return one(*columns)

        @F.arrow_udf(kind)
        def two(a: pa.Array, b: pa.Array) -> pa.Array:
            both = pa.RecordBatch.from_arrays([a, b], ["a", "b"])
            return pa.concat_arrays([pa.array([None if x is None else f(x, y) for x, y in zip(*(c.to_pylist() for c in part.columns))], arrow_type) for part in slices(both)] or [pa.array([], arrow_type)])

        return two(*columns)

    return call


STRINGS = pa.list_(pa.string())


def truncate(text: str, starters=(), removers=(), stoppers=()) -> str:
    """From the first line that begins with a starter to the first that begins with a stopper, without removed lines.

    A line is looked at as it is, lower-cased, without header marks, and with letters only; lines without letters go.
    """
    starters, removers, stoppers = ([w.lower() for w in x or ()] for x in (starters, removers, stoppers))
    out: list[str] = []
    begun = False
    for line in text.split("\n"):
        low = line.lower()
        letters = re.sub("[^a-z ]", "", re.sub("[^a-zA-Z ]", "", low)).strip()
        views = (line, low.strip(), low.replace("#", "").strip(), letters)
        starts = lambda words: any(v.startswith(w) for v in views for w in words)  # noqa: E731, B023
        if starters and not begun and starts(starters):
            out, begun = [line], True
        elif starts(removers):
            continue
        elif starts(stoppers):
            break
        elif letters:
            out.append(line)
    return "\n".join(out).strip()


def group_headers(paragraphs: list[str], least: int = 32) -> list[str]:
    """Paragraphs joined until a group has enough words and doesn't end with a header."""
    groups, held = [], []
    for p in paragraphs:
        held.append(p)
        header = p.startswith("#") and "\n" not in p
        if not header and len("\n".join(held).split(" ")) >= least:
            groups.append("\n".join(held))
            held = []
    return groups + (["\n".join(held)] if held else [])


_LIGATURES = {"ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "ﬃ": "ffi", "ﬄ": "ffl"}


def repair_encoding(text: str, lines: bool = False) -> str:
    """Escapes and twice-encoded characters put right, ligatures spelled out, numeric citations cut, white space squeezed."""

    def unescape(m: re.Match) -> str:
        return chr(int(m[1] or m[2], 16))

    text = re.sub(r"\\u([0-9a-fA-F]{4})|\\x([0-9a-fA-F]{2})", unescape, text)

    def again(m: re.Match) -> str:
        try:
            return m[0].encode("cp1252").decode("utf-8")
        except UnicodeError:
            return m[0]

    text = re.sub(r"[Â-ô][\u0080-¿‘-”€™ŒœŠš†-…]{1,3}", again, text)
    text = re.sub("[ÅÀÂ]", "", text)
    for a, b in _LIGATURES.items():
        text = text.replace(a, b)
    text = re.sub(r"\[\d+(?:, ?\d+)*\]", "", text)
    return "\n".join(" ".join(x.split()) for x in text.split("\n")) if lines else " ".join(text.split())


def assemble_article(title: str, abstract: str, headers: str, sections: str, keep_title: bool = True) -> str:
    """Title, abstract and sections of '<!>'-separated lists; what has no partner is left out. keep_title False is what the reference does."""
    out = [f"# {title}"] if keep_title else []
    out.append(f"## ABSTRACT\n{abstract}")
    for h, s in zip(headers.split("<!>"), sections.split("<!>")):
        paras = [p.strip() for p in re.split(r"</?p>", s) if p.strip()]
        out.append("\n".join([f"## {h.strip()}", *paras]))
    return "\n\n".join(out)


_TITLE = re.compile(r"^[A-Z][^\n:]*:")
_LIST = re.compile(r"^\s*(?:\d+[.)]|[-*•])\s+")


def is_title(s: str) -> bool:
    words = re.sub(r"\([^)]*\)", "", s).strip().removesuffix(":").split()
    return s.endswith(":") and not s.startswith("Disp") and bool(words) and all(w in ("of", "on", "or") or w[0].isupper() for w in words)


def segments(text: str) -> list[str]:
    """Clinical text in segments: rules and blank lines, headers, list items, then sentences of prose; one-line answers stay with their header."""
    text = re.sub(r"-{3,}|_{3,}", lambda m: f"\n\n{m[0][0] * 5}\n\n", text)
    out: list[str] = []
    for block in re.split(r"\n{2,}", text):
        held: list[str] = []

        def flush() -> None:
            if held:
                prose = " ".join(held)  # noqa: B023
                out.extend(s for s in re.split(r"(?<=[.!?])\s+(?=[A-Z(])", prose) if s)
                held.clear()  # noqa: B023

        for line in map(str.strip, block.split("\n")):
            if not line:
                continue
            m = _TITLE.match(line)
            if m and is_title(m[0]):
                flush()
                out.append(m[0])
                if rest := line[m.end() :].strip():
                    if len(rest.split()) <= 4 and not rest.endswith("."):
                        out[-1] += " " + rest
                    else:
                        held.append(rest)
            elif _LIST.match(line) or set(line) <= {"-", "_"}:
                flush()
                out.append(line)
            else:
                held.append(line)
        flush()
    return out


def note_sections(parts: list[str]) -> list[dict]:
    """Segments gathered below their headers; headers without text vanish."""
    out: list[dict] = []
    header, body = None, []
    for p in [*parts, None]:
        m = _TITLE.match(p) if p is not None else None
        if p is None or (m and is_title(m[0])):
            if body:
                out.append({"header": header, "text": " ".join(body)})
            header, body = (m[0] if m else None), []
            if m and (rest := p[m.end() :].strip()):
                body.append(rest)
        else:
            body.append(p)
    return out


#: Common words that tell a language; words of several of them are left out.
COMMON = {
    "en": {"the", "of", "and", "to", "that", "is", "was", "for", "with", "it", "are", "this", "not", "be", "from", "by", "have"},
    "fr": {"le", "les", "des", "et", "est", "dans", "pour", "du", "une", "par", "qui", "sur", "avec", "pas", "aux", "sont", "ou"},
    "de": {"der", "die", "das", "und", "ist", "von", "zu", "mit", "den", "ein", "nicht", "auf", "im", "dem", "eine", "auch", "sich"},
    "es": {"el", "los", "las", "y", "del", "por", "con", "una", "para", "es", "no", "lo", "su", "al", "como", "más", "se"},
}


def language(text: str, prefix: int | None = 2000, common: dict[str, set[str]] = COMMON) -> str:
    """The language whose common words a text has most of, of equal ones the first by name; 'unknown' without any.

    prefix is the reference's rule: it looks at the first 2000 characters of articles and 10,000 of guidelines; None looks at all.
    """
    words = re.findall(r"[^\W\d_]+", text[:prefix].lower())
    score = {k: sum(w in v for w in words) for k, v in common.items()}
    best = max(sorted(score), key=score.get)
    return best if score[best] else "unknown"


def html_children(page: str, holder: str = "main") -> str:
    """The headings, paragraphs and list items that are children of a page's holder elements (or of its body), in order: '## ' headings, '- ' items, other text as it is.

    Sections below the holder are walked as it is; the last one goes if it holds references.
    """
    p = _Children(holder)
    p.feed(page)
    p.close()
    blocks = p.blocks if any(p.blocks) else []
    if len(blocks) > 1 and "references" in " ".join(blocks[-1]).lower():
        blocks = blocks[:-1]
    return re.sub(r"\n{3,}", "\n\n", "\n\n".join("\n".join(b) for b in blocks)).strip()


_KNOWN = {"abstract", "introduction", "background", "methods", "materials and methods", "results", "discussion", "conclusion", "conclusions"}


def annotated_article(text: str, spans: list[dict]) -> str:
    """Text by its annotations: headers marked, formulas named, references cut, nothing after the first figure. Later spans win over earlier ones."""
    tag: list[str | None] = [None] * len(text)
    stop = len(text)
    for s in spans:
        a, b = max(0, s["start"]), min(len(text), s["end"])
        tag[a:b] = [s["kind"]] * max(0, b - a)
        if s["kind"] == "figure":
            stop = min(stop, a)
    out, i = [], 0
    while i < stop:
        j = i
        while j < stop and tag[j] == tag[i]:
            j += 1
        piece = text[i:j]
        if tag[i] == "header":
            name = piece.strip()
            out.append(f"\n\n{'##' if name.lower() in _KNOWN else '###'} {name}\n")
        elif tag[i] == "formula":
            out.append(" [formula] ")
        elif tag[i] == "ref":
            out.append(" ")
        else:
            out.append(piece)
        i = j
    done = re.sub(r"[ \t]+", " ", "".join(out))
    return re.sub(r"\n{3,}", "\n\n", re.sub(r" ?\n ?", "\n", done)).strip()


def caption(text: str, most: int = 12) -> str:
    """A caption's first sentence, of at most `most` words."""
    first = re.split(r"(?<=[.!?])\s", text.strip(), maxsplit=1)[0].split()
    return " ".join(first[:most]) + ("..." if len(first) > most else "")


class _Sections(HTMLParser):
    HEADS, SKIP = {"h1", "h2", "h3", "h4"}, {"table", "script", "style", "nav", "footer", "head"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[list[str]] = [["", ""]]
        self.skip, self.head, self.item = 0, False, False

    def handle_starttag(self, tag, attrs):
        if tag in self.SKIP:
            self.skip += 1
        elif tag in self.HEADS:
            self.out.append(["", ""])
            self.head = True
        elif tag in ("p", "li", "br"):
            self.head = False
            self.out[-1][1] += "\n- " if tag == "li" else "\n"

    def handle_endtag(self, tag):
        if tag in self.SKIP:
            self.skip = max(0, self.skip - 1)
        elif tag in self.HEADS:
            self.head = False

    def handle_data(self, data):
        if not self.skip:
            self.out[-1][0 if self.head else 1] += data


class _Children(HTMLParser):
    """Text of h*, p, ul and ol in blocks, one for each section; other elements are looked into, tables and page furniture are not."""

    SKIP = {"table", "script", "style", "nav", "footer", "header", "head", "aside", "form"}

    def __init__(self, holder: str) -> None:
        super().__init__(convert_charrefs=True)
        self.holder, self.blocks, self.kind, self.held, self.skip, self.lists = holder, [[]], None, "", 0, 0

    def flush(self) -> None:
        text = " ".join(self.held.split())
        if text:
            self.blocks[-1].append({"h": "\n## ", "li": "- "}.get(self.kind, "") + text)
        self.held, self.kind = "", None

    def handle_starttag(self, tag, attrs):
        if tag in self.SKIP:
            self.skip += 1
            return
        heading = re.fullmatch("h[1-6]", tag)
        if tag == self.holder:
            self.held, self.kind, self.blocks = "", None, [[]]
        elif tag == "section":
            self.flush()
            self.blocks.append([])
        elif heading or tag in ("p", "li", "ul", "ol", "br", "div"):
            self.flush()
            self.kind = "h" if heading else "li" if tag == "li" else None

    def handle_endtag(self, tag):
        if tag in self.SKIP:
            self.skip = max(0, self.skip - 1)
        elif re.fullmatch("h[1-6]|p|li|ul|ol|div|section", tag) or tag == self.holder:
            self.flush()

    def handle_data(self, data):
        if not self.skip:
            self.held += data

    def close(self):
        super().close()
        self.flush()


def html_sections(page: str, least: int = 5, stops: tuple[str, ...] = ("references", "external links"), skip: tuple[str, ...] = ()) -> list[dict]:
    """(header, text) of a page's sections: no tables, nothing from a stop header on, no named headers, no sections under `least` words."""
    p = _Sections()
    p.feed(page)
    p.close()
    out = []
    for head, body in p.out:
        head = " ".join(head.split())
        text = "\n".join(x for x in (" ".join(y.split()) for y in body.split("\n")) if x)
        if any(head.lower().startswith(s) for s in stops):
            break
        if len(text.split(" ")) >= least and head.lower() not in skip and text:
            out.append({"header": head, "text": html.unescape(text)})
    return out


def in_context_path(edges: list[tuple]) -> list:
    """The order of documents for one context: the node with the fewest neighbours (the first inserted of these), then its neighbours by weight, all removed, and so on."""
    graph: dict = {}
    for a, b, w in edges:
        graph.setdefault(a, {})[b] = w
        graph.setdefault(b, {})[a] = w
    place = {n: i for i, n in enumerate(graph)}
    heap = [(len(near), place[n], n) for n, near in graph.items()]  # entries of degrees since changed are passed over
    heapq.heapify(heap)
    path = []
    while heap:
        degree, _, node = heapq.heappop(heap)
        if node not in graph or len(graph[node]) != degree:
            continue
        near = sorted(graph[node].items(), key=lambda x: x[1])
        for n in [node, *(n for n, _ in near)]:
            path.append(n)
            for m in graph.pop(n):
                if m in graph:
                    graph[m].pop(n)
                    heapq.heappush(heap, (len(graph[m]), place[m], m))
    return path


SECTION = pa.list_(pa.struct([("header", pa.string()), ("text", pa.string())]))
SECTION_SQL = "array<struct<header: string, text: string>>"
