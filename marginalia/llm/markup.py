"""Markup residue in notes: which families occur, and the text without it (problem 3).

A text is read as a stream of events. Fenced code and backtick spans are set aside first. The standard
library's parser then gives the HTML events (known tags, comments, character references); what it reports as
text is searched for wiki and LaTeX constructs by patterns that ask for the construct's own syntax, so that
prices, comparisons, paths and ``R&D`` stay prose. The same events give each line's ratio of text to tags; a
Gaussian smooths the ratios along the lines, and a threshold found by splitting them in two clusters marks
the lines of the lower cluster. Such lines are dropped where they carry links or layout and nothing
that holds meaning: no words, or mostly words inside ``nav``, ``footer`` or ``menu``, or nearly only words of two or more
links; headings, list items, table cells, code and formulas always stay. Elements that are never closed count for nothing.

Defined results: a null text gives a null clean text and no families; an empty one an empty text; open tags,
fences and environments end with the text; repeated rows give repeated rows; other columns stay as they are.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from html.entities import html5
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Element names of HTML, of which a tag must be to count.
ELEMENTS = frozenset(
    "a abbr acronym address applet area article aside audio b base basefont bdi bdo big blink blockquote body br button canvas caption center cite code col "
    "colgroup data datalist dd del details dfn dialog dir div dl dt em embed fieldset figcaption figure font footer form frame frameset h1 h2 h3 h4 h5 h6 head "
    "header hgroup hr html i iframe img input ins kbd label legend li link main map mark marquee menu meta meter nav nobr noframes noscript object ol optgroup "
    "option output p param picture pre progress q rp rt ruby s samp script section select slot small source span strike strong style sub summary sup svg table "
    "tbody td template textarea tfoot th thead time title tr track tt u ul var video wbr".split()
)
# LaTeX command names that occur in running text, besides any command with a braced argument.
COMMANDS = (
    "alpha beta gamma delta epsilon theta lambda mu pi rho sigma tau phi omega approx leq geq neq times cdot cdots ldots dots sum prod int frac sqrt infty partial "
    "rightarrow leftarrow Rightarrow to in forall exists emph textbf textit texttt section subsection subsubsection paragraph chapter footnote cite ref label "
    "begin end item caption centering maketitle tableofcontents newpage noindent hline left right mathrm mathbf mathbb text textsc underline href url "
    "includegraphics usepackage documentclass newline linebreak smallskip medskip bigskip quad qquad par"
).split()

FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})[^\n]*$", re.M)
TICKS = re.compile(r"(?<!`)(`+)(?!`)((?:(?!\n[ \t]*\n).)+?)(?<!`)\1(?!`)", re.S)
HOLD, HOLD_END = "\ue000", "\ue001"  # around the number of a part set aside
HELD = re.compile(f"{HOLD}(\\d+){HOLD_END}")
REFERENCE = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
# Attributes have a value, or are one of the names that need none ("a <b and c> d" is prose).
_bare = "allowfullscreen async autofocus autoplay border checked compact controls default defer disabled hidden ismap loop multiple muted nohref noshade novalidate nowrap open readonly required reversed selected"
TAG = re.compile(
    r"</?([A-Za-z][A-Za-z0-9]*)(?=[\s/>])(?:\s+(?:[A-Za-z_:@][\w:.@-]*\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'=<>`]+)|(?:" + _bare.replace(" ", "|") + r")(?=[\s/>])))*\s*/?>", re.I
)

WIKI = {
    "template": re.compile(r"\{\{[^\W\d_][\w .:-]*(?:\|(?:[^{}]|(?<!\{)\{(?!\{)[^{}]*\}(?!\}))*)?\}\}"),  # without another in it
    "strong": re.compile(r"(?<![\w'])'{2,3}(?!')(?=\S)((?:(?!\n[ \t]*\n).)+?)(?<=\S)(?<!')'{2,3}(?![\w'])", re.S),
    "heading": re.compile(r"^(={2,6})[ \t]*([^=\n][^\n]*?)[ \t]*\1[ \t]*$", re.M),
    "table": re.compile(r"^\{\|[^\n]*\n.*?^\|\}[ \t]*$|^\{\|[^\n]*$", re.M | re.S),
    "outlink": re.compile(r"(?<!\[)\[(?:https?|ftp|mailto):[^\s\]\[]+[ \t]+([^\]\[\n]+)\](?!\()"),
    "signature": re.compile(r"(?:--[ ]?)?(?<!~)~{3,5}(?!~)(?=\s|$|[.,;])"),
    "switch": re.compile(r"__(?:NOTOC|TOC|FORCETOC|NOEDITSECTION|NEWSECTIONLINK|HIDDENCAT|NOINDEX|INDEX|NOGALLERY)__"),
    "file": re.compile(r"\[\[(?:File|Image|Category|Media|Special|Fichier|Catégorie|Datei|Kategorie|Archivo|Categoría):[^\[\]]*\]\]"),
    "redirect": re.compile(r"^#(?:REDIRECT|REDIRECTION|WEITERLEITUNG|REDIRECCIÓN)\b[^\n]*", re.M | re.I),
}
_command = "(?:" + "|".join(sorted(COMMANDS, key=len, reverse=True)) + ")"
LATEX = {
    "display": re.compile(r"(?<!\\)\$\$(?=[^$]*[\\^_={}])(?:[^$])+?\$\$|(?<!\\)\\\[(?:\\\\|(?!\\[\]\[]|\n[ \t]*\n).)+\\\]", re.S),
    "inline": re.compile(r"(?<!\\)\\\((?:\\\\|(?!\\[()]|\n[ \t]*\n).)+\\\)|(?<![\\$\w])\$(?=[^\s$])(?=[^$\n]*[\\^_={}])[^$\n]+(?<=[^\s$\\])\$(?![\d$])", re.S),
    "environment": re.compile(r"\\(?:begin|end)\{[A-Za-z]+\*?\}(?:\[[^\]\n]*\])?"),
    "command": re.compile(rf"(?<!\\)\\[A-Za-z]{{2,}}\*?(?=\{{)|(?<![\\\w:.])\\{_command}\b\*?"),
}


def set_aside(text: str) -> tuple[str, list[str]]:
    """The text with fenced code and backtick spans replaced by numbered marks, and those parts."""
    parts: list[str] = []
    text = text.replace(HOLD, "").replace(HOLD_END, "")

    def keep(part: str) -> str:
        parts.append(part)
        return f"{HOLD}{len(parts) - 1}{HOLD_END}"

    out, at, open_, mark = [], 0, -1, ""
    lines = text.replace("\r\n", "\n").replace("\r", "\n")
    for m in FENCE.finditer(lines):
        if open_ < 0:
            if m[1][0] == "`" and "`" in m[0].lstrip()[len(m[1]) :]:
                continue  # a span, not a fence
            open_, mark = m.start(), m[1]
        elif m[1][0] == mark[0] and len(m[1]) >= len(mark) and m[0].strip() == m[1]:
            out += [lines[at:open_], keep(lines[open_ : m.end()])]
            at, open_ = m.end(), -1
    if open_ >= 0:
        out += [lines[at:open_], keep(lines[open_:])]
    else:
        out.append(lines[at:])
    return TICKS.sub(lambda m: keep(m[0]), "".join(out)), parts


class _Events(HTMLParser):
    """Text with HTML taken out, the spots where it was, and the number of tags on each line of the result."""

    BLOCKS = frozenset("p div section article header footer main aside nav table thead tbody tfoot tr ul ol dl dd dt blockquote form figure pre center h1 h2 h3 h4 h5 h6 hr address fieldset".split())
    LAYOUT = frozenset(("nav", "footer", "menu"))
    GUARDED = frozenset("li td th dt dd h1 h2 h3 h4 h5 h6 pre code".split())

    def __init__(self, keep):
        super().__init__(convert_charrefs=False)
        self.out: list[str] = []
        self.tags, self.line, self.seen, self.lists, self.keep, self.pre, self.skip, self.cells = {}, 0, False, [], keep, None, 0, 0
        self.spans: list[tuple[str, Counter]] = []  # open links and layout, and their characters of words on each line
        self.linked, self.links, self.laid, self.guarded = Counter(), Counter(), Counter(), set()

    def put(self, text: str) -> None:
        if self.skip:
            return
        if self.pre is not None:
            self.pre.append(text)
            return
        self.out.append(text)
        if self.spans:
            for i, part in enumerate(text.split("\n")):
                if n := len(re.findall(r"\w", part)):
                    for _, on in self.spans:
                        on[self.line + i] += n
        self.line += text.count("\n")

    def open_span(self, tag: str) -> None:
        if tag == "a" or tag in self.LAYOUT:
            self.spans = [x for x in self.spans if x[0] != tag] + [(tag, Counter())]  # neither nests in its like

    def close_span(self, tag: str) -> None:
        for x in [x for x in self.spans if x[0] == tag]:
            self.spans.remove(x)
            (self.linked if tag == "a" else self.laid).update(x[1])
            self.links.update(x[1].keys() if tag == "a" else ())

    def mark(self) -> None:
        self.seen = True
        self.tags[self.line] = self.tags.get(self.line, 0) + 1

    def newline(self, n: int = 1) -> None:
        tail = "".join(self.out[-3:])
        have = len(tail) - len(tail.rstrip("\n")) if tail or self.out else n
        if n > have:
            self.put("\n" * (n - have))

    def handle_starttag(self, tag, attrs):
        if tag not in ELEMENTS:
            return self.put(self.get_starttag_text())
        self.mark()
        if tag in ("script", "style"):
            self.skip += 1
        elif tag == "pre":
            self.newline(2)
            self.pre = []
        elif tag == "code" and self.pre is None:
            self.put("`")
        elif tag == "br":
            self.put("\n")
        elif tag in ("ul", "ol"):
            self.lists.append([tag, 0])
            self.newline()
        elif tag == "li":
            self.newline()
            kind = self.lists[-1] if self.lists else ["ul", 0]
            kind[1] += 1
            self.put("  " * max(0, len(self.lists) - 1) + (f"{kind[1]}. " if kind[0] == "ol" else "- "))
        elif tag in ("td", "th"):
            self.put(" | " if self.cells else "")
            self.cells += 1
        elif len(tag) == 2 and tag[0] == "h" and tag[1].isdigit():
            self.newline(2)
            self.put("#" * int(tag[1]) + " ")
        elif tag in self.BLOCKS:
            self.cells = 0 if tag == "tr" else self.cells
            self.newline(1 if tag in ("tr", "dd", "dt") else 2 if tag == "p" else 1)
        self.tags[self.line] = self.tags.get(self.line, 0)
        if tag in self.GUARDED:
            self.guarded.add(self.line)
        self.open_span(tag)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in ELEMENTS and tag in ("script", "style", "pre"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag not in ELEMENTS:
            return self.put(f"</{tag}>")
        self.mark()
        self.close_span(tag)
        if tag in self.GUARDED:
            self.guarded.add(self.line)
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        elif tag == "pre" and self.pre is not None:
            code, self.pre = "".join(self.pre).strip("\n"), None
            self.put(self.keep("```\n" + code + "\n```") + "\n")
        elif tag == "code" and self.pre is None:
            self.put("`")
        elif tag in ("ul", "ol"):
            if self.lists:
                self.lists.pop()
            self.newline()
        elif tag in self.BLOCKS:
            self.newline()

    def handle_data(self, data):
        self.put(data)

    def handle_comment(self, data):
        self.mark()

    def handle_decl(self, decl):
        self.mark() if decl.lower().startswith("doctype") else self.put(f"<!{decl}>")

    def unknown_decl(self, data):
        self.put(f"<![{data}]>")

    def handle_pi(self, data):
        self.put(f"<?{data}>")

    def handle_charref(self, name):
        ref = f"&#{name};"
        if self.rawdata[self.offset_of() :].startswith(ref):
            self.mark()
            return self.put(unescape(ref))
        self.put(f"&#{name}")

    def handle_entityref(self, name):
        ref = f"&{name};"
        if f"{name};" in html5 and self.rawdata[self.offset_of() :].startswith(ref):
            self.mark()
            return self.put(unescape(ref).replace("\xa0", " "))
        self.put(f"&{name}")

    def offset_of(self) -> int:
        line, column = self.getpos()
        while len(self.starts) < line:
            self.starts.append(self.rawdata.index("\n", self.starts[-1]) + 1)
        return self.starts[line - 1] + column

    def close_all(self):
        self.close()
        if self.pre is not None:
            code, self.pre = "".join(self.pre).strip("\n"), None
            self.put(self.keep("```\n" + code + "\n```"))


def _html(text: str, keep) -> tuple[str, _Events | None]:
    if "<" not in text and "&" not in text:
        return text, None
    # A "<" that opens no known tag or comment, and a "&" that opens no reference, are prose: hidden from the parser.
    prose = {"<": "\ue002", "&": "\ue003"}

    def hide(m: re.Match) -> str:
        return prose[m[0]]

    pieces, at = [], 0
    for m in re.finditer(r"<!--.*?-->|<!--|<!DOCTYPE[^>]*>|" + TAG.pattern + "|" + REFERENCE.pattern, text, re.S | re.I):
        whole = m[0]
        known = whole.startswith("<!") or (whole[0] == "<" and re.match(r"</?([A-Za-z0-9]+)", whole)[1].lower() in ELEMENTS) or (whole[0] == "&" and (whole[1] == "#" or whole[1:] in html5))
        pieces.append(re.sub("[<&]", hide, text[at : m.start()]))
        pieces.append(whole if known and whole != "<!--" else re.sub("[<&]", hide, whole))
        at = m.end()
    pieces.append(re.sub("[<&]", hide, text[at:]))
    events = _Events(keep)
    events.starts = [0]
    events.feed("".join(pieces))
    events.close_all()
    return "".join(events.out).replace("\ue002", "<").replace("\ue003", "&"), events


def _table(m: re.Match) -> str:
    rows, now = [], []
    for line in m[0].split("\n")[1:]:
        line = line.strip()
        if line.startswith(("|-", "|}")):
            rows, now = rows + [now] * bool(now), []
        elif line.startswith(("|+",)):
            rows.append([line[2:].strip()])
        elif line[:1] in ("|", "!"):
            now += [c.split("|")[-1].strip() if "=" in c.split("|")[0] and "|" in c else c.strip() for c in re.split(r"\|\||!!", line[1:])]
        elif line:
            now.append(line)
    rows += [now] * bool(now)
    return "\n".join("| " + " | ".join(r) + " |" for r in rows)


def _template(m: re.Match) -> str:
    fields = m[0][2:-2].split("|")[1:]
    return "; ".join(f"{a.strip()}: {b.strip()}" if sep else a.strip() for a, sep, b in (x.partition("=") for x in fields if x.strip()))


def _wiki(text: str) -> tuple[str, bool]:
    seen, before = False, text
    for name, to in (
        ("table", _table), ("heading", lambda m: "#" * len(m[1]) + " " + m[2]), ("template", _template), ("strong", lambda m: m[1]), ("outlink", lambda m: m[1]),
        ("signature", lambda m: ""), ("switch", lambda m: ""), ("file", lambda m: ""), ("redirect", lambda m: ""),
    ):
        text, n = WIKI[name].subn(to, text)
        seen = seen or n > 0
        while n and name == "template":  # nested ones, from the inside
            text, n = WIKI[name].subn(to, text)
    return (text, seen) if seen else (before, False)


def _latex(text: str, keep) -> tuple[str, bool]:
    seen = False
    for name in ("display", "inline"):  # formulas stay as they are
        text, n = LATEX[name].subn(lambda m: keep(m[0]), text)
        seen = seen or n > 0
    if "\\" in text and (LATEX["environment"].search(text) or LATEX["command"].search(text)):
        seen = True
        text = re.sub(r"\\(section|chapter|subsection|subsubsection|paragraph)\*?\{([^{}]*)\}", lambda m: "#" * (2 + ("subsection", "subsubsection").index(m[1]) if "sub" in m[1] else 1 + (m[1] != "chapter")) + " " + m[2], text)
        text = re.sub(r"\\(?:begin|end)\{tabular\}(?:\{[^}\n]*\})?", "", text)
        text = LATEX["environment"].sub("", text)
        text = re.sub(r"^([ \t]*)\\item(?:\[([^\]\n]*)\])?[ \t]*", lambda m: m[1] + "- " + (m[2] + " " if m[2] else ""), text, flags=re.M)
        text = re.sub(r"[~ ]?\\(?:cite|ref|label|eqref|citep|citet)\*?(?:\[[^\]\n]*\])*\{[^{}]*\}", "", text)
        text = re.sub(r"\\footnote\{((?:[^{}]|\{[^{}]*\})*)\}", r" (\1)", text)
        n = 1
        while n:  # nested arguments, from the inside; every round takes commands away
            text, n = re.subn(r"(?<!\\)\\[A-Za-z]{2,}\*?(?:\[[^\]\n]*\])?\{([^{}]*)\}", r"\1", text)
        text = re.sub(rf"(?<![\\\w:.])\\{_command}\b[ \t]?", "", text)
        text = re.sub(r"[ \t]*\\\\[ \t]*(?=\n|$|\S)", "\n", text)
        text = re.sub(r"^([^\n|]*\S)[ \t]+&[ \t]+([^\n]*)$", lambda m: "| " + re.sub(r"[ \t]*&[ \t]*", " | ", m[0]).strip() + " |", text, flags=re.M)
    return text, seen


STRUCTURE = re.compile(r"[ \t]*(?:#{1,6}[ \t]|[-*+][ \t]|\d+[.)][ \t]|\||>|={2,6}[^=])")


def select_regions(text: str, events: _Events) -> str:
    """Drops the lines that smoothing and clustering of text-to-tag ratios give to layout, keeping structure."""
    lines, tags = text.split("\n"), events.tags
    if sum(tags.values()) < 3 or len(lines) < 3:
        return text
    ratio = np.array([len(x.strip()) / max(1, tags.get(i, 0)) for i, x in enumerate(lines)])
    weight = np.exp(-0.5 * np.arange(-2, 3) ** 2)
    smooth = np.convolve(np.pad(ratio, 2, mode="edge"), weight / weight.sum(), mode="valid")
    low, high = smooth.min(), smooth.max()
    for _ in range(12):  # two clusters on a line
        cut = (low + high) / 2
        if not (smooth <= cut).any() or not (smooth > cut).any():
            break
        low, high = smooth[smooth <= cut].mean(), smooth[smooth > cut].mean()
    cut = (low + high) / 2
    out = []
    for i, x in enumerate(lines):
        words = len(re.findall(r"\w", x))
        guarded = i in events.guarded or HELD.search(x) or STRUCTURE.match(x)
        moved = not guarded and (2 * events.laid[i] > words or events.links[i] > 1 and events.linked[i] >= 0.8 * words)
        empty = tags.get(i, 0) >= 2 and not words and not HELD.search(x)
        layout = x.strip() and smooth[i] <= cut and (moved if words else empty)
        if not layout:
            out.append(x)
    return "\n".join(out)


def read(text: str) -> tuple[str, list[str]]:
    """The clean text, and the families of markup that occurred outside code."""
    rest, parts = set_aside(text)

    def keep(part: str) -> str:
        parts.append(part)
        return f"{HOLD}{len(parts) - 1}{HOLD_END}"

    formulas, latex = _latex_formulas(rest, keep)
    plain, events = _html(formulas, keep)
    html = events is not None and events.seen
    if html:
        plain = select_regions(plain, events)
    plain, wiki = _wiki(plain)
    plain, commands = _latex(plain, keep)
    families = [name for name, on in (("html", html), ("wiki", wiki), ("latex", latex or commands)) if on]
    while HELD.search(plain):  # a part holds only parts set aside before it
        plain = HELD.sub(lambda m: parts[int(m[1])], plain)
    if families:
        plain = re.sub(r"[ \t]+$", "", plain, flags=re.M)
        plain = re.sub(r"\n{3,}", "\n\n", plain).strip("\n")
    return plain, families


def _latex_formulas(text: str, keep) -> tuple[str, bool]:
    """Formulas go aside before the HTML is read: they hold "<" and "&"."""
    if "$" not in text and "\\" not in text:
        return text, False
    seen = False
    for name in ("display", "inline"):
        text, n = LATEX[name].subn(lambda m: keep(m[0]), text)
        seen = seen or n > 0
    return text, seen


def _run(column: str, clean: bool, out_schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [read(x) if x is not None else (None, []) for x in batch.column(column).to_pylist()]
            columns = [c for name, c in zip(batch.schema.names, batch.columns) if clean or name != column]
            columns += [pa.array([t for t, _ in got], pa.string())] if clean else []
            yield pa.RecordBatch.from_arrays([*columns, pa.array([f for _, f in got], pa.list_(pa.string()))], schema=out_schema)

    return run


def clean_markup(rows: DataFrame, column: str = "body", clean_as: str = "clean_text", families_as: str = "markup", clean: bool = True) -> DataFrame:
    """The rows with the clean text of ``column`` and the sorted families of markup in it (html, latex, wiki).
    ``clean=False`` leaves the texts out and only names the families."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kept = [f for f in rows.schema.fields if clean or f.name != column]
    schema = T.StructType([*kept, *([T.StructField(clean_as, T.StringType())] if clean else []), T.StructField(families_as, T.ArrayType(T.StringType()))])
    return rows.mapInArrow(_run(column, clean, to_arrow_schema(schema)), schema)


def markup_found(notes: DataFrame) -> DataFrame:
    """path, family: once for each note and family of markup in its body."""
    got = clean_markup(notes.select("path", "body").where("path is not null"), clean=False)
    return got.select("path", F.explode("markup").alias("family")).distinct()
