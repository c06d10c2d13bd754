"""Problem 3: clean text of HTML, Markdown, wiki and LaTeX markup.

A scan finds every construct that may be markup. A linear classifier turns its features into two costs, of calling
it markup and of calling it plain text, which become the capacities of its edges to the two terminals. Constructs
that open and close one element (DOM proximity) and constructs of one kind in neighbouring lines (adjacency) are
joined by smoothness edges. The minimum cut, found by max-flow, labels all constructs of a text at once; those on
the source side are markup and are rewritten. A second cut over the blocks of the text, with costs by their links
and labels, separates content from boilerplate such as categories and navigation.
"""

import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

HTML, MARKDOWN, WIKI, LATEX = "html", "markdown", "wiki", "latex"

#: Weights of the classifier: cost of calling a construct plain (first) or markup (second), by what speaks for it.
PRIOR, SURE, LIKELY, WEAK, AGAINST = 1.0, 6.0, 3.0, 1.4, 5.0
#: Smoothness: between parts of one element; between constructs of one kind whose lines are at most NEAR apart.
DOM, ADJACENT, NEAR = 3.0, 0.5, 2

#: Elements of HTML.
_ELEMENTS = (
    "a abbr address article aside audio b base big blockquote body br button canvas caption center cite code col dd del details dfn dialog div dl dt em embed "
    "fieldset figcaption figure font footer form frame h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link main map mark menu meta "
    "nav noscript object ol option p picture pre q s samp script section select small span strike strong style sub summary sup svg table tbody td textarea tfoot th thead "
    "time title tr tt u ul var video"
).split()
_BLOCK_ELEMENTS = set("address article aside blockquote body br center dd details div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol p pre section table tbody tfoot thead title tr ul".split())
#: Commands of LaTeX that may stand without an argument.
_BARE_COMMANDS = "alpha beta gamma delta epsilon theta lambda mu pi sigma omega infty cdot times le leq ge geq neq approx sum prod int frac sqrt log ln sin cos lim item maketitle tableofcontents hline noindent newpage clearpage centering ldots dots quad qquad left right".split()

_PREFIX = r"^(?:(?:User|Assistant|Session Summary): )?"
_CODE = re.compile(
    rf"(?P<fence>{_PREFIX} {{0,3}}(?P<marks>`{{3,}}|~{{3,}})(?P<info>[^\n`]*)(?:\n|\Z))|(?P<pre><pre\b[^<>\n]*>)|(?P<jira>\{{(?:code|noformat)(?::[^{{}}\n]*)?\}})|(?P<moin>\{{\{{\{{)"
    r"|(?P<nowiki><(?P<tag>nowiki|syntaxhighlight|source)\b[^<>\n]*>)|(?P<verb>\\begin\{(?P<env>verbatim|lstlisting|minted)\*?\})|(?P<ticks>(?<![\\`])(?P<n>`{1,2})(?!`))",
    re.M | re.I,
)
_HTML = re.compile(r"(?P<comment><!--.*?(?:-->|\Z))|(?P<doctype><!doctype[^<>]*>)|(?P<tag></?(?P<name>" + "|".join(_ELEMENTS) + r")(?:\s[^<>]*|/)?>)|(?P<entity>&(?:#\d{1,7}|#x[0-9a-f]{1,6}|[a-z][a-z0-9]{1,30});)", re.S | re.I)
_LATEX = re.compile(
    r"(?P<begin>\\begin\{(?P<env>[A-Za-z]+\*?)\}(?:\[[^\]\n]*\])?)|(?P<end>\\end\{(?P<endenv>[A-Za-z]+\*?)\})|(?P<display>\\\[(?P<d>(?:(?!\\\[|\n[ \t]*\n).)+?)\\\])|(?P<inline>\\\((?P<i>(?:(?!\\\(|\n[ \t]*\n).)+?)\\\))|(?P<dollars>\$\$(?P<dd>[^$]+?)\$\$)"
    r"|(?P<dollar>(?<![\\$\w])\$(?=[^\s$])(?P<s>[^$\n]{0,300}?[^\s$\\])\$(?![\w$]))|(?P<command>\\(?P<c>[A-Za-z]+)\*?(?:\[[^\]\n]*\])?(?P<arg>\{)?)",
    re.S,
)
_MATH = re.compile(r"\\[A-Za-z]|[\^_]|[=<>+*/]|^[A-Za-z]'?$")
_WIKI = re.compile(
    r"(?P<table>^[ \t:]*\{\|.*?(?:^[ \t]*\|\}|\Z))|(?P<heading>^(?P<eq>={1,6})[ \t]*(?P<title>[^=\s][^=\n]*?)[ \t]*(?P=eq)[ \t]*$)|(?P<jheading>^h(?P<level>[1-6])\. +(?=\S))|(?P<template>\{\{(?![\s{])(?P<body>[^{}]*?)\}\})"
    r"|(?P<link>!?\[\[(?![\s\-\[])(?P<target>[^\[\]\n]*[^\[\]\s])\]\])|(?P<jlink>\[(?P<text>[^\[\]|\n]+)\|(?P<url>(?:[a-z]+://|mailto:|#|\^|/)[^\]\s]*)\])|(?P<elink>\[(?:https?|ftp)://[^\s\]]+ (?P<etext>[^\]\n]+)\](?!\())"
    r"|(?P<bold>'''(?=[^\s'])(?P<bb>(?:(?!''')[^\n])*?[^\s'])'''(?!'))|(?P<italic>(?<!')''(?=[^\s'])(?P<ii>[^\n']*[^\s'])''(?!'))|(?P<macro>\{(?:quote|panel|info|note|tip|warning|color|toc|anchor|expand)(?::[^{}\n]*)?\})"
    r"|(?P<magic>__(?:NO|FORCE)?TOC__|__NOEDITSECTION__|^#REDIRECT\b)|(?P<ref></?(?:ref|references|gallery|math|poem|includeonly|noinclude|onlyinclude)\b[^<>\n]*>)|(?P<jtable>^\|\|[^\n]*\|\|[ \t]*$)|(?P<bq>^bq\. +(?=\S))",
    re.M | re.S,
)
#: A text without any of these has no wiki construct.
_WIKI_SIGN = re.compile(r"[{\[<]|''|__|^=|^\|\||^[ \t:]*\{\||^h[1-6]\. |^bq\. |^#REDIRECT", re.M)
#: What a line must start with to be a construct of its own, and a line under a heading.
_LINE_SIGN = re.compile(r"^(?:(?:User|Assistant|Session Summary): )?[ \t]*(?:[#>*+|:_-]|\d{1,9}[.)]|\[[^\]\n]+\]:)", re.M)
_UNDER = re.compile(r"^ {0,3}(?:={3,}|-{3,})[ \t]*$", re.M)
_MARKDOWN = re.compile(
    rf"(?P<heading>{_PREFIX} {{0,3}}(?P<hashes>#{{1,6}})[ \t]+(?=\S))|(?P<setext>^(?P<above>[^\s>|#\x00][^\n]*)\n {{0,3}}(?P<under>={{3,}}|-{{3,}})[ \t]*$)|(?P<quote>{_PREFIX} {{0,3}}(?P<gt>>(?:[ \t]?>)*)[ \t]?(?=\S))"
    rf"|(?P<rule>^ {{0,3}}(?:(?:\*[ \t]*){{3,}}|(?:-[ \t]*){{3,}}|(?:_[ \t]*){{3,}})$)|(?P<bullet>{_PREFIX}(?P<indent>[ \t]*)[-+*][ \t]+(?:\[[ xX]\] )?(?=\S))|(?P<number>{_PREFIX}(?P<nindent>[ \t]*)\d{{1,9}}[.)][ \t]+(?=\S))"
    r"|(?P<delim>^[ \t]*\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)+\|?[ \t]*$|^[ \t]*\|[ \t]*:?-+:?[ \t]*\|[ \t]*$)|(?P<row>^[ \t]*\|[^\n|]*\|[^\n]*$)|(?P<define>^ {0,3}\[[^\]\n]+\]:[ \t]+\S+[^\n]*$)",
    re.M,
)
_INLINE = re.compile(
    r"(?P<image>!\[(?P<alt>[^\[\]\n]*)\]\([^()\n]*(?:\([^()\n]*\)[^()\n]*)*\))|(?P<link>(?<!\\)\[(?P<label>[^\[\]\n]+)\](?:\((?:[^()\s\n]|\([^()\n]*\))+(?:[ \t]+[\"'(][^\n]*?[\"')])?\)|\[[^\[\]\n]*\]))|(?P<auto><(?:https?|ftp|mailto):[^\s<>]+>)"
    r"|(?P<strong>(?<![\w*\\])(?P<stars>\*{2,3})(?=[^\s*])(?P<b>(?:(?!\*\*)[^\n])*?[^\s*\\])(?P=stars)(?![\w*]))|(?P<under>(?<![\w\\])__(?=[^\s_])(?P<u>(?:(?!__)[^\n])*?[^\s_\\])__(?!\w))|(?P<em>(?<![\w*\\])\*(?=[^\s*])(?P<e>[^*\n]*[^\s*\\])\*(?![\w*]))"
    r"|(?P<uem>(?<![\w\\])_(?=[^\s_])(?P<ue>[^_\n]*[^\s_\\])_(?!\w))|(?P<strike>(?<![~\\])~~(?=[^\s~])(?P<st>[^\n~]*[^\s~])~~(?!~))"
)
_IDENTIFIER = re.compile(r"[A-Za-z_]\w*$")


@dataclass(slots=True)
class Construct:
    start: int
    end: int
    kind: str
    form: str
    plain_cost: float  # of calling it plain text: what speaks for markup
    markup_cost: float = PRIOR  # of calling it markup: what speaks against
    edits: list = field(default_factory=list)  # (start, end, new text)
    group: str = ""  # parts of one element share it
    line: int = 0


class Cut:
    """The minimum cut between a source and a sink: Dinic's algorithm over adjacency lists."""

    def __init__(self, n: int):
        self.n = n
        self.to: list[int] = []
        self.room: list[float] = []
        self.at: list[list[int]] = [[] for _ in range(n + 2)]
        self.source, self.sink = n, n + 1

    def edge(self, a: int, b: int, there: float, back: float) -> None:
        self.at[a].append(len(self.to))
        self.at[b].append(len(self.to) + 1)
        self.to += [b, a]
        self.room += [there, back]

    def _levels(self) -> list[int]:
        level = [-1] * (self.n + 2)
        level[self.source] = 0
        queue = deque([self.source])
        while queue:
            a = queue.popleft()
            for e in self.at[a]:
                if self.room[e] > 1e-9 and level[self.to[e]] < 0:
                    level[self.to[e]] = level[a] + 1
                    queue.append(self.to[e])
        return level

    def source_side(self) -> list[bool]:
        """Whether each node stays with the source."""
        while (level := self._levels())[self.sink] >= 0:
            tried = [0] * (self.n + 2)
            path: list[int] = []
            a = self.source
            while True:
                if a == self.sink:
                    least = min(self.room[e] for e in path)
                    for e in path:
                        self.room[e] -= least
                        self.room[e ^ 1] += least
                    k = next(i for i, e in enumerate(path) if self.room[e] <= 1e-9)
                    a = self.to[path[k] ^ 1]
                    del path[k:]
                    continue
                while tried[a] < len(self.at[a]):
                    e = self.at[a][tried[a]]
                    if self.room[e] > 1e-9 and level[self.to[e]] == level[a] + 1:
                        break
                    tried[a] += 1
                if tried[a] < len(self.at[a]):
                    path.append(e)
                    a = self.to[e]
                elif path:
                    level[a] = -1
                    a = self.to[path.pop() ^ 1]
                else:
                    break
        return [x >= 0 for x in level[: self.n]]


def minimum_cut(source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels (True: source side) of least cost: ``sink`` is paid on the source side, ``source`` on the other, an edge where it is cut."""
    if all(a > b for a, b in zip(source, sink)):
        return [True] * len(source)  # no edge need be cut
    cut = Cut(len(source))
    for i, (a, b) in enumerate(zip(source, sink)):
        if a > b:
            cut.edge(cut.source, i, a - b, 0.0)
        elif b > a:
            cut.edge(i, cut.sink, b - a, 0.0)
    for i, j, w in edges:
        cut.edge(i, j, w, w)
    return cut.source_side()


def normal(text: str) -> str:
    """One kind of line end, no character that the scan uses as a mark."""
    return text.replace("\r\n", "\n").replace("\r", "\n").replace("\u2028", "\n").replace("\u2029", "\n").replace("\x00", " ")


def _code(text: str) -> tuple[list[Construct], str]:
    """Code blocks and code spans, first come first served, and the text with their insides masked."""
    if "`" not in text and "~~~" not in text and "<" not in text and "{" not in text:
        return [], text
    out, parts, at = [], [], 0
    hide = lambda a, b: re.sub(r"[^\n]", "\0", text[a:b])
    pos = 0
    ends: dict[str, int] = {}  # closing marks that occur no more after a place

    def closing(pattern: str, start: int, flags: int = 0) -> re.Match | None:
        if ends.get(pattern, len(text) + 1) <= start:
            return None
        m = re.compile(pattern, flags).search(text, start)
        if m is None:
            ends[pattern] = start
        return m

    while m := _CODE.search(text, pos):
        a, b = m.span()
        form = m.lastgroup if m.lastgroup in ("fence", "pre", "jira", "moin", "nowiki", "verb", "ticks") else next(k for k in ("fence", "pre", "jira", "moin", "nowiki", "verb", "ticks") if m.group(k))
        if form == "fence":
            marks = m.group("marks")
            close = closing(rf"^ {{0,3}}{re.escape(marks[0])}{{{len(marks)},}}[ \t]*$", b, re.M)
            inner_end, end = (close.start(), close.end()) if close else (len(text), len(text))
            c = Construct(a, end, MARKDOWN, "code", SURE, edits=[(a, b, f"```{m.group('info').strip()}\n"), (inner_end, end, "```" if close else "\n```")])
        elif form == "ticks":
            close = closing(r"(?<!`)" + m.group("n") + r"(?!`)", b)
            if close is None or "\n" in text[b : close.start()] or close.start() == b:
                pos = b
                continue
            end = close.end()
            c = Construct(a, end, MARKDOWN, "span", LIKELY)
        else:
            name = re.search(r"\w+", m.group("env") or m.group("tag") or m.group())
            pattern = {"pre": r"</pre\s*>", "moin": r"\}\}\}"}.get(form) or {"jira": r"\{%s\}", "nowiki": r"</%s\s*>", "verb": r"\\end\{%s\*?\}"}[form] % name.group()
            close = closing(pattern, b, re.I)
            if close is None:
                if form != "pre":
                    pos = b
                    continue
                inner_end = end = len(text)
            else:
                inner_end, end = close.span()
            body = text[b:inner_end]
            start = b + (re.match(r"\s*<code[^<>]*>", body, re.I).end() if form == "pre" and re.match(r"\s*<code[^<>]*>", body, re.I) else 0)
            tail = re.search(r"</code\s*>\s*$", body, re.I) if form == "pre" else None
            stop = b + tail.start() if tail and b + tail.start() >= start else inner_end
            c = Construct(a, end, {"pre": HTML, "verb": LATEX}.get(form, WIKI), "code", SURE if close else LIKELY, edits=[(a, start, "\n```\n"), (stop, end, "\n```\n")])
        out.append(c)
        parts += [text[at:a], hide(a, end)]
        at = end
        pos = max(end, b)
    return out, "".join(parts) + text[at:]


def _blank(text: str, spans: list[tuple[int, int]]) -> str:
    """The text with these spans masked."""
    parts, at = [], 0
    for a, b in sorted(spans):
        if b > at:
            parts += [text[at : max(a, at)], re.sub(r"[^\n]", "\0", text[max(a, at) : b])]
            at = b
    return "".join(parts) + text[at:]


def _html(text: str) -> list[Construct]:
    if "<" not in text and "&" not in text:
        return []
    out, open_at = [], {}
    for m in _HTML.finditer(text):
        a, b = m.span()
        before = text[a - 1] if a else ""
        if m.group("entity"):
            new = unescape(m.group())
            if new != m.group():
                out.append(Construct(a, b, HTML, "entity", LIKELY, edits=[(a, b, new.replace("\xa0", " "))]))
            continue
        if m.group("comment") or m.group("doctype"):
            out.append(Construct(a, b, HTML, "comment", SURE, edits=[(a, b, "")]))
            continue
        name, closing = m.group("name").lower(), m.group().startswith("</")
        new = "\n" if name in _BLOCK_ELEMENTS else " | " if name in ("td", "th") and closing else ""
        if name == "li":
            new = "" if closing else "\n- "
        elif re.fullmatch("h[1-6]", name) and not closing:
            new = "\n" + "#" * int(name[1]) + " "
        sure = "=" in m.group() or closing or name in ("br", "hr", "img") or not (before.isalnum() or before == "_")
        c = Construct(a, b, HTML, "tag:" + name, LIKELY if sure else WEAK, PRIOR if sure else PRIOR + 1, edits=[(a, b, new)])
        if not closing:
            open_at.setdefault(name, []).append(c)
            c.group = f"{name}@{a}"
        elif open_at.get(name):
            c.group = open_at[name].pop().group
        out.append(c)
    return out


def _latex(text: str) -> list[Construct]:
    if "\\" not in text and "$" not in text:
        return []
    out, open_at = [], {}
    for m in _LATEX.finditer(text):
        a, b = m.span()
        if m.group("begin"):
            c = Construct(a, b, LATEX, "begin", LIKELY, edits=[(a, b, "$$" if m.group("env").rstrip("*") in ("equation", "align", "gather", "displaymath", "math") else "")])
            c.group = f"{m.group('env')}@{a}"
            open_at.setdefault(m.group("env"), []).append(c)
        elif m.group("end"):
            c = Construct(a, b, LATEX, "end", LIKELY, edits=[(a, b, "$$" if m.group("endenv").rstrip("*") in ("equation", "align", "gather", "displaymath", "math") else "")])
            if open_at.get(m.group("endenv")):
                c.group = open_at[m.group("endenv")].pop().group
        elif m.group("display") or m.group("inline") or m.group("dollars"):
            body = m.group("d") or m.group("i") or m.group("dd")
            mark = "$" if m.group("inline") else "$$"
            like = LIKELY if _MATH.search(body.strip()) else WEAK
            c = Construct(a, b, LATEX, "formula", like, PRIOR if like == LIKELY else PRIOR + 1, edits=[(a, a + 2, mark), (b - 2, b, mark)])
        elif m.group("dollar"):
            body = m.group("s")
            strong = re.search(r"\\[A-Za-z]|[\^_]\{?\w", body) or re.fullmatch(r"[A-Za-z]'?", body)
            some = re.search(r"[=<>+]", body) and re.search("[A-Za-z]", body) and not re.search(r"[A-Za-z]{4,}", body)
            if not strong and not some:
                continue
            shell = re.match(r"[A-Z_]{2,}\b|\{|\(", body)
            c = Construct(a, b, LATEX, "formula", LIKELY if strong else WEAK + 1, PRIOR + (AGAINST if shell else 0))
        else:
            before = text[a - 1] if a else ""
            name, arg = m.group("c"), m.group("arg")
            if not arg and name not in _BARE_COMMANDS:
                continue
            path = before.isalnum() or before in (":", "/")
            c = Construct(a, b, LATEX, "command:" + name, LIKELY if arg else WEAK + 0.6, PRIOR + (AGAINST if path else 0))
            if arg:
                close = _matching(text, b)
                if name in ("section", "subsection", "subsubsection", "chapter", "paragraph", "title"):
                    c.edits = [(a, b, {"chapter": "# ", "title": "# ", "section": "# ", "subsection": "## "}.get(name, "### "))]
                elif name in ("textbf", "emph", "textit", "texttt", "underline", "text", "mbox"):
                    c.edits = [(a, b, "")]
                if c.edits and close:
                    c.edits.append((close, close + 1, ""))
                    c.end = close + 1
                elif c.edits:
                    c.edits = []
            elif name == "item":
                c.edits = [(a, b, "-")]
        out.append(c)
    return out


def _matching(text: str, start: int) -> int:
    """The closing brace of a group that opens before ``start``, on the same line; 0 if there is none."""
    depth = 1
    for m in re.compile(r"[{}\n]").finditer(text, start):
        if m.group() == "\n":
            return 0
        depth += 1 if m.group() == "{" else -1
        if depth == 0:
            return m.start()
    return 0


def _wiki(text: str) -> list[Construct]:
    if not _WIKI_SIGN.search(text):
        return []
    out = []
    for m in _WIKI.finditer(text):
        a, b = m.span()
        form = next(k for k in ("table", "heading", "jheading", "template", "link", "jlink", "elink", "bold", "italic", "macro", "magic", "ref", "jtable", "bq") if m.group(k) is not None)
        c = Construct(a, b, WIKI, form, LIKELY)
        if form == "table":
            c.plain_cost = SURE
            body = re.sub(r"^[ \t]*(?:\{\|[^\n]*|\|\}|\|-[^\n]*)\n?", "", m.group(), flags=re.M)
            body = re.sub(r"^[ \t]*[|!]\+?[ \t]*", "", body, flags=re.M).replace("||", "|").replace("!!", "|")
            c.edits = [(a, b, body.rstrip("\n"))]
        elif form == "heading":
            c.edits = [(a, m.start("title"), "#" * len(m.group("eq")) + " "), (m.end("title"), b, "")]
        elif form == "jheading":
            c.edits = [(a, b, "#" * int(m.group("level")) + " ")]
        elif form == "template":
            body = m.group("body")
            c.plain_cost = LIKELY if "|" in body or body[:1].isupper() else WEAK
            c.markup_cost = PRIOR + (AGAINST if body.endswith((" ", "\t")) or re.search(r"[.(\[]", body.split("|")[0]) and "|" not in body else 0)
            args = [x.split("=", 1)[-1] if re.match(r"\s*\w+\s*=", x) else x for x in body.split("|")[1:]]
            c.edits = [(a, b, " ".join(x.strip() for x in args) if "|" in body else body)]
        elif form == "link":
            target = m.group("target")
            shell = re.match(r"[!$(\"]", target) or re.search(r"\s(?:==?|!=|-[a-z]{2}|=~|&&)\s", target)
            c.markup_cost = PRIOR + (AGAINST if shell else 0)
            c.form = "category" if re.match(r"(?i)(category|kategorie|catégorie|categoría|категория):", target) else "link"
            c.edits = [(a, b, "" if c.form == "category" else target.rpartition("|")[2])]
        elif form in ("jlink", "elink"):
            c.edits = [(a, b, m.group("text") or m.group("etext"))]
        elif form in ("bold", "italic"):
            n = 3 if form == "bold" else 2
            c.edits = [(a, a + n, ""), (b - n, b, "")]
        elif form == "jtable":
            c.edits = [(a, b, m.group().strip().strip("|").replace("||", " | "))]
        else:
            c.edits = [(a, b, "> " if form == "bq" else "")]
        out.append(c)
    return out


def _markdown(text: str) -> list[Construct]:
    out, pos = [], 0
    starts = {m.start() for m in _LINE_SIGN.finditer(text)} | {text.rfind("\n", 0, m.start() - 1) + 1 for m in _UNDER.finditer(text) if m.start()}
    for start in sorted(starts):
        if start < pos or not (m := _MARKDOWN.match(text, start)):
            continue
        a, b = m.span()
        form = next(k for k in ("heading", "setext", "quote", "rule", "bullet", "number", "delim", "row", "define") if m.group(k) is not None)
        c = Construct(a, b, MARKDOWN, form, LIKELY)
        pos = b
        if form == "setext":
            c.edits = [(a, a, "# " if m.group("under")[0] == "=" else "## "), (m.end("above"), b, "")]
        elif form == "heading":
            c.edits = [(m.start("hashes"), b, m.group("hashes") + " ")]
        elif form == "quote":
            c.plain_cost = LIKELY if len(m.group("gt")) < 3 else WEAK
            c.markup_cost = PRIOR + (2 if m.group("gt") == ">>>" else 0)
            c.edits = [(m.start("gt"), b, "> ")]
        elif form == "bullet":
            lone = not re.search(r"[A-Za-z\u00c0-\uffff]", text[b : text.find("\n", b) if text.find("\n", b) >= 0 else len(text)])
            c.plain_cost = WEAK if lone else LIKELY - 0.5
            c.edits = [(m.end("indent"), b, "- ")]
        elif form == "number":
            c.plain_cost = LIKELY - 0.5
        elif form == "delim":
            c.edits = [(a, min(b + 1, len(text)), "")]
        elif form == "row":
            ended = m.group().rstrip().endswith("|")
            c.plain_cost = WEAK + 0.6 * ended
            c.edits = [(a, b, " | ".join(x.strip() for x in m.group().strip().strip("|").split("|")))] if ended else []
        elif form == "define":
            c.edits = [(a, b, "")]
        elif form == "rule":
            c.plain_cost = WEAK
        out.append(c)
    for m in _INLINE.finditer(text) if any(c in text for c in "*_[<~") else ():
        a, b = m.span()
        form = next(k for k in ("image", "link", "auto", "strong", "under", "em", "uem", "strike") if m.group(k) is not None)
        c = Construct(a, b, MARKDOWN, form, LIKELY)
        if form == "image":
            c.edits = [(a, b, m.group("alt"))]
        elif form == "link":
            reference = m.group()[-1] == "]"
            c.plain_cost, c.markup_cost = (WEAK, PRIOR + 0.6) if reference else (LIKELY, PRIOR)
            c.edits = [(a, m.start("label"), ""), (m.end("label"), b, "")]
            if not reference and (a and (text[a - 1].isalnum() or text[a - 1] in "_)]")):
                c.markup_cost += AGAINST  # an index and a call
        elif form == "auto":
            c.edits = [(a, a + 1, ""), (b - 1, b, "")]
        elif form in ("strong", "strike"):
            n = len(m.group("stars") or "~~")
            c.edits = [(a, a + n, ""), (b - n, b, "")]
        elif form == "under":
            c.markup_cost = PRIOR + (AGAINST if _IDENTIFIER.match(m.group("u")) and (m.group("u").islower() or text[b : b + 1] in (".", "(")) else 0)
            c.edits = [(a, a + 2, ""), (b - 2, b, "")]
        else:
            body = m.group("e") or m.group("ue")
            glob = form == "em" and re.match(r"\.\w|/", body)
            c.plain_cost, c.markup_cost = LIKELY - 0.5, PRIOR + (AGAINST if glob or form == "uem" and re.search(r"[/.(]", body) and " " not in body else 0)
            c.edits = [(a, a + 1, ""), (b - 1, b, "")]
        out.append(c)
    return out


def constructs(text: str) -> list[Construct]:
    """Every construct of a text (with line ends made normal) that may be markup, in order. A construct counts for one kind only."""
    found, masked = _code(text)
    tags = _html(masked)
    masked = _blank(masked, [(c.start, c.end) for c in tags if c.form != "entity"])
    wiki = _wiki(masked)
    for c in wiki:  # what stands in a table of a wiki is its own
        if c.form == "table":
            tags = [t for t in tags if not (c.start <= t.start < c.end and t.form == "entity")]
    masked = _blank(masked, [(c.start, c.end) for c in wiki if c.markup_cost <= PRIOR and c.form not in ("bold", "italic")] + [(c.start, c.start + 3) for c in wiki if c.form == "bold"])
    tex = _latex(masked)
    masked = _blank(masked, [(c.start, c.end) for c in tex if c.form == "formula"] + _environments(tex))
    found += [*tags, *wiki, *tex, *_markdown(masked)]
    found.sort(key=lambda c: (c.start, -c.end))
    line, at = 0, 0
    for c in found:
        line += text.count("\n", at, c.start)
        at = c.start
        c.line = line
    return found


def _environments(tex: list[Construct]) -> list[tuple[int, int]]:
    """The insides of formula environments, in which nothing is Markdown."""
    at = {c.group: c.end for c in tex if c.form == "begin" and c.edits[0][2]}
    return [(at[c.group], c.start) for c in tex if c.form == "end" and c.group in at]


def labels(found: list[Construct]) -> list[bool]:
    """Which constructs are markup: the source side of the minimum cut."""
    edges, last, groups = [], {}, {}
    for i, c in enumerate(found):
        if c.kind in last and c.line - found[last[c.kind]].line <= NEAR:
            edges.append((last[c.kind], i, ADJACENT))
        last[c.kind] = i
        if c.group:
            if c.group in groups:
                edges.append((groups[c.group], i, DOM))
            groups[c.group] = i
    table = None  # rows of a table belong to its delimiter
    for i, c in enumerate(found):
        if c.form in ("row", "delim"):
            if table is not None and c.line - found[table].line <= 1:
                edges.append((table, i, DOM))
            table = i
    return minimum_cut([c.plain_cost for c in found], [c.markup_cost for c in found], edges)


def kinds(text: str | None) -> list[str]:
    """The kinds of markup written in a text; none where it is null, empty or blank."""
    if not text or text.isspace():
        return []
    found = constructs(normal(text))
    return sorted({c.kind for c, is_markup in zip(found, labels(found)) if is_markup})


def clean(text: str | None) -> str | None:
    """The text without markup: headings as '#', lists as '-', code in fences, formulas in '$'; null stays null.

    Blocks on the boilerplate side of the second cut (comments, categories, blocks of bare links) are left out.
    """
    if not text or text.isspace():
        return text
    text = normal(text)
    found = constructs(text)
    taken = [c for c, is_markup in zip(found, labels(found)) if is_markup]
    edits = sorted((e for c in taken for e in c.edits), key=lambda e: (e[0], e[1]))
    blocks = _boilerplate(text, taken)
    out, at = [], 0
    for a, b, new in sorted([*edits, *[(a, b, "") for a, b in blocks]], key=lambda e: (e[0], -e[1] if not e[2] else e[1])):
        if a < at:
            continue
        out += [text[at:a], new]
        at = b
    out.append(text[at:])
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", "".join(out))).strip("\n")


def _boilerplate(text: str, taken: list[Construct]) -> list[tuple[int, int]]:
    """Spans of the blocks (between blank lines) that the second cut takes for boilerplate."""
    code = [(c.start, c.end) for c in taken if c.form == "code"]
    cuts, k = [], 0
    for m in re.finditer(r"\n[ \t]*\n", text):
        while k < len(code) and code[k][1] <= m.start():
            k += 1
        if k == len(code) or m.end() <= code[k][0]:
            cuts.append(m.end())
    bounds = [0, *cuts, len(text)]
    content, junk, k = [], [], 0
    for a, b in zip(bounds, bounds[1:]):
        linked = dropped = nav = 0
        while k < len(taken) and taken[k].start < b:
            c = taken[k]
            k += 1
            size = min(c.end, b) - c.start
            if c.form in ("category", "comment", "magic", "define"):
                dropped += size
            elif c.form in ("link", "jlink", "elink", "auto", "image"):
                linked += size
                nav += 1
        size = len(text[a:b].strip()) or 1
        rest = max(size - linked - dropped, 0)
        content.append(0.5 + min(rest, 200) / 40)
        junk.append(4.0 * (dropped / size) ** 2 + (3.0 * linked / size if nav > 2 else 0.0))
    joined = [(i, i + 1, ADJACENT / 2) for i in range(len(content) - 1)]
    keep = minimum_cut(content, junk, joined)
    return [(a, b) for (a, b), kept in zip(zip(bounds, bounds[1:]), keep) if not kept]


def marked(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, kind): one row per distinct key and kind of markup in its text.

    Null, empty and blank texts and null keys have none; repeated rows count once. Whole texts are read, one
    pass, in Arrow batches; only (key, kind) is shuffled.
    """
    name = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out = [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                got = kinds(t)
                rows += [i] * len(got)
                out += got
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(out, pa.string())], ["k", "kind"])

    slim = df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).where("k is not null and t is not null")
    return slim.mapInArrow(run, f"k {name}, kind string").distinct().withColumnRenamed("k", key)


def cleaned(df: DataFrame, text: str, out: str = "clean_text") -> DataFrame:
    """All rows and columns of ``df`` and the clean text. Null and blank texts stay as they are; nothing is shuffled.

    A column called ``out`` is replaced.
    """
    kept = [c for c in df.columns if c != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = pa.array([clean(t) for t in batch.column(len(kept)).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], got], [*kept, out])

    rows = df.select(*[F.col(f"`{c}`") for c in kept], F.col(text).cast("string").alias("__text"))
    schema = StructType([*df.select(*[F.col(f"`{c}`") for c in kept]).schema.fields, StructField(out, StringType())])
    return rows.mapInArrow(run, schema)
