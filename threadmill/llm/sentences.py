"""Problem 10: sentences of texts in many languages and scripts.

A first pass over all documents counts, per language, what follows each word with a period, how often each word
opens a sentence where that is beyond doubt, and what follows an ellipsis. Log-likelihood ratios turn the counts
into abbreviations, collocations and sentence starters; a second pass classifies every candidate with them.
"""

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadmill.session import cut

#: Ratios above these count as significant (chi-squared, one degree of freedom, p = 0.005).
SIGNIFICANT = 7.88
#: So many entries of the model are broadcast at most, the most frequent ones; the rest are joined to the texts that ask for them.
BROADCAST = 300_000

_SCRIPTS = [("th", 0x0E00, 0x0E7F), ("lo", 0x0E80, 0x0EFF), ("ja", 0x3040, 0x30FF), ("zh", 0x4E00, 0x9FFF), ("zh", 0x3400, 0x4DBF), ("ru", 0x0400, 0x052F), ("el", 0x0370, 0x03FF), ("el", 0x1F00, 0x1FFF), ("ar", 0x0600, 0x077F), ("hi", 0x0900, 0x097F), ("ko", 0xAC00, 0xD7AF), ("he", 0x0590, 0x05FF)]
#: Frequent function words of languages in Latin script.
_FUNCTION_WORDS = {
    "en": "the and of to in is that it was for with are this on not from".split(),
    "de": "der die das und ist nicht ein eine mit von zu den im für wir auf".split(),
    "fr": "le la les et est une des pas que pour dans du avec nous vous au".split(),
    "es": "el los las y es una que por con para del no se en más al".split(),
}
_RANGES = re.compile("|".join(f"([{chr(a)}-{chr(b)}]+)" for _, a, b in _SCRIPTS) + "|([A-Za-zÀ-ɏ]+)")

PARAGRAPH = re.compile(r"(?:(?:\r\n|[\r\n\x85 ])(?:[^\S\r\n\x85 ]*(?:\r\n|[\r\n\x85 ]))+|[\x0c ])")
_WIDE = "。！？．‼⁇⁈⁉"
_TERMINAL = re.compile("[.!?…;" + _WIDE + "।॥؟۔։።።။។]+")
_NO_SPACE = set(_WIDE + "।॥።။។")
_OPENERS = {"“": "”", "„": "“”", "«": "»", "‹": "›", "「": "」", "『": "』", "《": "》", "(": ")", "（": "）", "[": "]", "［": "］", "【": "】"}
_CLOSERS = set("".join(_OPENERS.values())) | {'"'}
_BRACKETS = set("(（[［【")
_LEAD = "\"“„«‹「『《(（[［【¿¡'‘’*_ \t\xa0 \r\n"
_TRAIL = "\"”“»›」』》)）]］】'’.,;:!?…，、；：。！？؟،।*_"
_NUMBER = re.compile(r"[+-]?\d[\d.,:/]*$")
_THAI = re.compile("[฀-໿]")
_SPACELESS = re.compile("(\\S*[\u0e00-\u0eff]\\S*)[^\\S\r\n\x85\u2028\u2029]+(?=[^\\sๆฯ])")
_CJK = re.compile("[぀-ヿ㐀-䶿一-鿿]")
_KANA = re.compile("[぀-ヿ]")
_CLOSING = re.compile("[ \xa0\u202f" + re.escape("".join(sorted(_CLOSERS))) + "]*")
_FIRST = re.compile(r"\s*")
_OPENING = re.compile("[" + re.escape(_LEAD) + "]*")
_WORD = re.compile(r"\S+")
_BLANKS = " \t\r\n\xa0 "


_LANGUAGES = {w: [k for k, v in _FUNCTION_WORDS.items() if w in v] for v in _FUNCTION_WORDS.values() for w in v}
_ASCII_WORD = re.compile("[a-z]+")
#: Other languages that are written in a script which stands for one above.
_SAME_SCRIPT = {"ru": "uk be bg sr mk kk ky mn tg".split(), "ar": "fa ur ps ku ug sd".split(), "hi": "mr ne sa".split()}
#: A label that names another language holds unless so large a share of the words are function words of one of the four.
CONTRADICTED = 0.12


def _label(label: str | None) -> str:
    return re.split(r"[-_]", (label or "").strip().lower())[0]


def _chosen(scripts: dict, n_latin: int, score: dict, n_words: int, label: str | None) -> str:
    if scripts:
        top = max(scripts, key=scripts.get)
        n = scripts[top]
        if top == "zh" and scripts.get("ja", 0) * 8 > n:
            top = "ja"
        if n * (2 if top in ("zh", "ja", "ko", "th", "lo") else 1) >= n_latin / 2:
            name = _label(label)
            return name if name in _SAME_SCRIPT.get(top, ()) else top
    name = _label(label)
    best = max(_FUNCTION_WORDS, key=lambda k: score.get(k, 0))
    if name not in _FUNCTION_WORDS and 2 <= len(name) <= 3 and name.isalpha() and name not in _OF_SCRIPT and score.get(best, 0) < CONTRADICTED * n_words:
        return name
    if score.get(best):
        return best
    return name if name in _FUNCTION_WORDS else "en"


_OF_SCRIPT = {k for k, _, _ in _SCRIPTS}.union(*_SAME_SCRIPT.values())


def language(text: str, label: str | None) -> str:
    """The language by script and, in Latin script, by function words of four languages; the label decides between languages that these can't tell apart."""
    if text.isascii():
        words = text.lower().split()  # function words rarely have marks beside them
        score: dict = {}
        for w, n in Counter(filter(_LANGUAGES.__contains__, words)).items():
            for k in _LANGUAGES[w]:
                score[k] = score.get(k, 0) + n
        return _chosen({}, len(text), score, len(words), label)
    return _Spans(text).language(0, len(text), label)


class _Spans:
    """The words of a text by script, so that any stretch of it can be asked for its language."""

    def __init__(self, text: str):
        self.at: list[int] = []
        self.what: list = []  # (script, length) or the languages of a function word, or None for another Latin word
        self.size: list[int] = []
        for m in _RANGES.finditer(text):
            i, w = m.lastindex, m.group()
            self.at.append(m.start())
            self.size.append(len(w))
            if i > len(_SCRIPTS):
                self.what.append(_LANGUAGES.get(w.lower()))
            else:
                self.what.append(_SCRIPTS[i - 1][0])

    def language(self, start: int, end: int, label: str | None) -> str:
        scripts: dict = {}
        score: dict = {}
        n_latin = n_words = 0
        for i in range(bisect_left(self.at, start), bisect_left(self.at, end)):
            what, n = self.what[i], self.size[i]
            if what.__class__ is str:
                scripts[what] = scripts.get(what, 0) + n
            else:
                n_latin += n
                n_words += 1
                if what:
                    for k in what:
                        score[k] = score.get(k, 0) + 1
        return _chosen(scripts, n_latin, score, n_words, label)


_FOREIGN = {k: {w for w, v in _LANGUAGES.items() if k not in v} for k in _FUNCTION_WORDS}


def _mixed(text: str, lang: str) -> bool:
    """Whether anything in a text may speak for another language."""
    return lang not in _FUNCTION_WORDS or not text.isascii() or not _FOREIGN[lang].isdisjoint(_ASCII_WORD.findall(text.lower()))


def kind_of(token: str) -> str:
    """num, low, up or other, by the first letter or digit; other also where scripts without case follow."""
    if _CJK.search(token):
        return "other"
    for c in token:
        if c.isdigit():
            return "num"
        if c.isalpha():
            return "low" if c.islower() else "up" if c.isupper() else "other"
    return "other"


def bare(token: str) -> str:
    """A token without quotes, brackets and marks around it; numbers are one type."""
    t = token.lstrip(_LEAD).rstrip(_TRAIL)
    return "##" if _NUMBER.match(t) else t


def before_period(token: str) -> str:
    t = token.lstrip(_LEAD).lower()
    return "##" if re.fullmatch(r"\d+", t) else "#.#" if _NUMBER.match(t) else t


_BOUNDARY = re.compile("[。！？!?]+[\"”」』》）)\\s]*([^\\W_]\\w)")
_DOTTED = re.compile("…[…\"”」』》）)\\s]*([^\\W_]\\w)")


def count(text: str, lang: str, tallies: Counter, words: Counter) -> None:
    """Add what one text shows to the tallies (lang, what, w, x), and its tokens to those of its language."""
    at = 0
    for stop in [*[m.span() for m in PARAGRAPH.finditer(text)], (len(text), len(text))]:
        tokens = _WORD.findall(text, at, stop[0])
        at = stop[1]
        if not tokens:
            continue
        words.update(tokens)
        _first_word(tokens, 0, lang, tallies)  # a paragraph's first word opens a sentence
        for i in [i for i, token in enumerate(tokens) if token[-1] in ".!?؟।"]:
            token = tokens[i]
            if token[-1] == ".":
                if token[-2:] != ".." and i + 1 < len(tokens):
                    nxt = tokens[i + 1]
                    tallies[lang, "pair", before_period(token[:-1]), f"{kind_of(nxt)} {bare(nxt)}"] += 1
            elif token.lstrip(_LEAD):
                _first_word(tokens, i + 1, lang, tallies)
    if lang in ("zh", "ja", "ko", "th", "lo"):
        for what, pattern in (("opens", _BOUNDARY), ("follows", _DOTTED)):
            for w in pattern.findall(text):
                tallies[lang, what, w, ""] += 1


def _first_word(tokens: list[str], i: int, lang: str, tallies: Counter) -> None:
    for token in tokens[i : i + 8]:
        if x := bare(token):
            tallies[lang, "start", x, ""] += 1
            return
        if any(c in _CLOSERS for c in token):
            return  # what follows a quotation may go on


def llr(k: F.Column, n: F.Column, rest_k: F.Column, rest_n: F.Column) -> F.Column:
    """Dunning's log-likelihood ratio that k of n comes from another rate than rest_k of rest_n; 0 where the rate isn't higher."""

    def ll(a, b, p):
        p = F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12))
        return a * F.log(p) + (b - a) * F.log(1 - p)

    k, n, rest_k, rest_n = (c.cast("double") for c in (k, n, rest_k, rest_n))
    rest_n = F.greatest(rest_n, F.lit(1.0))
    p, q, both = k / n, rest_k / rest_n, (k + rest_k) / (n + rest_n)
    ratio = 2 * (ll(k, n, p) + ll(rest_k, rest_n, q) - ll(k, n, both) - ll(rest_k, rest_n, both))
    return F.when(p > q, ratio).otherwise(F.lit(0.0))


@dataclass
class Model:
    """What was learned: sets of (language, ...)."""

    starters: set = field(default_factory=set)
    others: set = field(default_factory=set)  # words that never open a sentence
    abbreviations: set = field(default_factory=set)
    before_numbers: set = field(default_factory=set)
    collocations: set = field(default_factory=set)
    continued: set = field(default_factory=set)  # what goes on after an ellipsis
    rare: DataFrame | None = None  # (role, lang, w, x) of the entries that are not in the sets

    def sets(self) -> dict[str, set]:
        return {role: getattr(self, role) for role in _ASKED}

    def key(self, role: str, lang: str, w: str, x: str) -> tuple:
        return (lang, w, x) if role == "collocations" else (lang, w)


#: What is asked for by which part of a candidate: the next word, the word before, both, or the letters after an ellipsis.
_ASKED = {"starters": "x", "others": "x", "abbreviations": "w", "before_numbers": "w", "collocations": "wx", "continued": "dots"}


def tally(df: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, what, w, x, n) over all documents; counted per Arrow batch first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tallies: Counter = Counter()
            words: dict[str, Counter] = {}
            for t, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if t and not t.isspace():
                    name = language(t, label)
                    count(t, name, tallies, words.setdefault(name, Counter()))
            for name, tokens in words.items():
                for token, n in tokens.items():
                    if x := bare(token):
                        tallies[name, "word", x, ""] += n
            keys = list(tallies)
            yield pa.RecordBatch.from_arrays([*[pa.array([k[i] for k in keys], pa.string()) for i in range(4)], pa.array([tallies[k] for k in keys], pa.int64())], ["lang", "what", "w", "x", "n"])

    slim = df.select(F.col(text).cast("string"), F.col(lang).cast("string") if lang in df.columns else F.lit(None).cast("string"))
    return slim.mapInArrow(run, "lang string, what string, w string, x string, n bigint").groupBy("lang", "what", "w", "x").agg(F.sum("n").alias("n"))


def learn(df: DataFrame, text: str = "text", lang: str = "lang", most: int = BROADCAST) -> Model:
    """The model of all documents of ``df``; empty tables give an empty one.

    Corpus statistics are joined and tested in the cluster. Of what is significant, the ``most`` most frequent
    entries at most come to the driver; the others stay a table, so every entry counts.
    """
    counts = cut(tally(df, text, lang))
    words = counts.where("what = 'word'").select("lang", F.col("w").alias("x"), F.col("n").alias("total"))
    starts = counts.where("what = 'start'").select("lang", F.col("w").alias("x"), F.col("n").alias("first"))
    sizes = counts.groupBy("lang").agg(*[F.sum(F.when(F.col("what") == k, F.col("n")).otherwise(0)).alias(f"all_{k}") for k in ("word", "start", "pair", "opens", "follows")])
    both = words.join(starts, ["lang", "x"], "left").fillna(0, ["first"]).join(F.broadcast(sizes), "lang")  # a row per language
    ratio = F.col("first") / F.col("total")
    both = both.withColumn("llr", llr(F.col("first"), F.col("total"), F.col("all_start") - F.col("first"), F.col("all_word") - F.col("total")))
    role = F.when((F.col("first") >= 2) & (ratio >= 0.1) & (F.col("llr") > SIGNIFICANT), "starter").when((F.col("total") >= 5) & (ratio < 0.02), "other")
    roles = cut(both.withColumn("role", role).where("role is not null").select("lang", "x", "role", "total"))

    pairs = counts.where("what = 'pair'").select("lang", "w", F.substring_index("x", " ", 1).alias("kind"), F.expr("substring(x, instr(x, ' ') + 1)").alias("x"), "n")
    pairs = cut(pairs.join(roles.drop("total"), ["lang", "x"], "left"))
    goes_on = (F.col("kind") == "num") | ((F.col("kind") == "low") & ~F.col("role").eqNullSafe("starter")) | F.col("role").eqNullSafe("other")
    per = pairs.groupBy("lang", "w").agg(F.sum("n").alias("n"), F.sum(F.when(goes_on, F.col("n")).otherwise(0)).alias("on"), F.sum(F.when(F.col("kind") == "num", F.col("n")).otherwise(0)).alias("num"))
    totals = per.groupBy("lang").agg(F.sum("n").alias("all_n"), F.sum("on").alias("all_on"), F.sum("num").alias("all_num"))
    per = per.join(F.broadcast(totals), "lang")
    per = per.withColumns({"llr": llr(F.col("on"), F.col("n"), F.col("all_on") - F.col("on"), F.col("all_n") - F.col("n")), "llr_num": llr(F.col("num"), F.col("n"), F.col("all_num") - F.col("num"), F.col("all_n") - F.col("n"))})
    short = (F.length("w") == 1) | F.contains("w", F.lit("."))
    abbreviations = per.where((F.col("w") != "##") & (F.col("w") != "#.#") & (F.col("on") / F.col("n") >= 0.5) & ((F.col("llr") > SIGNIFICANT) | short))
    numbers = per.where((F.col("num") / F.col("n") >= 0.5) & (F.col("llr_num") > SIGNIFICANT))

    follow = pairs.groupBy("lang", "x").agg(F.sum("n").alias("n_x"))
    joint = pairs.where("role = 'other'").groupBy("lang", "w", "x").agg(F.sum("n").alias("k")).join(per.select("lang", "w", "n", "all_n"), ["lang", "w"]).join(follow, ["lang", "x"])
    collocations = joint.where(llr(F.col("k"), F.col("n"), F.col("n_x") - F.col("k"), F.col("all_n") - F.col("n")) > SIGNIFICANT)

    # What follows an ellipsis far more often than it opens a sentence goes on.
    dots = counts.where("what = 'follows'").select("lang", "w", F.col("n").alias("k")).join(counts.where("what = 'opens'").select("lang", "w", F.col("n").alias("o")), ["lang", "w"], "left").fillna(0, ["o"]).join(F.broadcast(sizes), "lang")
    rate = (F.col("k") / F.col("all_follows")) / (F.greatest(F.col("o"), F.lit(0.5)) / F.greatest(F.col("all_opens"), F.lit(1)))
    continued = dots.where((rate >= 4) & (llr(F.col("k"), F.col("all_follows"), F.col("o"), F.col("all_opens")) > SIGNIFICANT))

    rows = lambda d, role, w, x, n: d.select(F.lit(role).alias("role"), "lang", F.col(w).alias("w"), (F.col(x) if x else F.lit("")).alias("x"), F.col(n).alias("n"))
    others = roles.where("role = 'other'").join(pairs.select("lang", "x").distinct(), ["lang", "x"], "left_semi")
    entries = rows(roles.where("role = 'starter'"), "starters", "x", None, "total").unionByName(rows(others, "others", "x", None, "total"))
    for d, role, x, n in ((abbreviations, "abbreviations", None, "n"), (numbers, "before_numbers", None, "n"), (collocations, "collocations", "x", "k"), (continued, "continued", None, "k")):
        entries = entries.unionByName(rows(d, role, "w", x, n))
    entries = cut(entries)
    model, least = Model(), 0
    if entries.count() > most:
        least = 1 + entries.orderBy(F.desc("n")).limit(most + 1).agg(F.min("n")).first()[0]
        model.rare = entries.where(F.col("n") < least).drop("n")
    for r in entries.where(F.col("n") >= least).drop("n").toLocalIterator():
        getattr(model, r.role).add(model.key(*r))
    return model


_QUOTES = re.compile('["“”„«»‹›「」『』《》()（）\\[\\]［］【】]')


def quotations(p: str) -> list[tuple[int, int]]:
    """The outermost quotations and brackets of a paragraph that are closed in it: (opening, closing) positions."""
    stack: list[tuple[int, str]] = []
    open_for: dict[str, list[int]] = {}  # closing mark -> places in the stack
    pairs = []

    def push(i: int, closers: str) -> None:
        for c in closers:
            open_for.setdefault(c, []).append(len(stack))
        stack.append((i, closers))

    for m in _QUOTES.finditer(p):
        c, i = m.group(), m.start()
        open_at = open_for[c][-1] if open_for.get(c) else None
        if open_at is not None and (c != "“" or stack[open_at][1] == "“”"):
            if c == '"' and i + 1 < len(p) and p[i + 1].isalnum() and i and p[i - 1].isspace():
                push(i, '"')  # a second opening mark: the first was never closed
                continue
            pairs.append((stack[open_at][0], i))
            while len(stack) > open_at:
                for x in stack.pop()[1]:
                    open_for[x].pop()
        elif c == '"':
            if i == 0 or p[i - 1].isspace() or p[i - 1] in _OPENERS or not p[i - 1].isalnum():
                push(i, '"')
        elif c in _OPENERS:
            push(i, _OPENERS[c])
    pairs.sort()
    out: list[tuple[int, int]] = []
    for a, b in pairs:
        if not out or a > out[-1][1]:
            out.append((a, b))
    return out


def sentences(text: str, lang: str, model: Model) -> list[tuple[int, int]]:
    """(start, end) of every sentence, without white space around."""
    out: list[tuple[int, int]] = []
    at = 0
    for stop in [*[m.span() for m in PARAGRAPH.finditer(text)], (len(text), len(text))]:
        p = text[at : stop[0]]
        cuts = _cuts(p, lang, model) if p else []
        last = 0
        for c in [*cuts, len(p)]:
            piece = p[last:c]
            body = piece.strip()
            if body:
                a = at + last + len(piece) - len(piece.lstrip())
                out.append((a, a + len(body)))
            last = c
        at = stop[1]
    return out


def _cuts(p: str, lang: str, model: Model) -> list[int]:
    spans = quotations(p)
    opens = [a for a, _ in spans]
    events = [(m.start(), m.end(), m.group()) for m in _TERMINAL.finditer(p)]
    if _THAI.search(p):
        events += [(m.end(1), m.end(), " ") for m in _SPACELESS.finditer(p) if not _TERMINAL.match(m.group(1)[-1])]
        events.sort()
    cuts: list[int] = []
    length = len(p.rstrip())
    start = 0  # of the current sentence
    spans_of_words, mixed = None, True
    for a, b, run in events:
        if a < start:
            continue
        k = bisect_right(opens, a) - 1
        span = spans[k] if k >= 0 and spans[k][0] < a < spans[k][1] else None
        if run == " ":
            if span is None:
                cuts.append(a)
                start = b
            continue
        if run.startswith(";") or (run.endswith(";") and run != ";"):
            if not (a and "Ͱ" <= p[a - 1] <= "῿" or (lang == "el" and b < len(p) and p[b].isspace() or lang == "el" and b == len(p))):
                if run == ";":
                    continue
        end = b
        quoted = bracketed = at_start = False
        if span is not None:
            close = span[1]
            if _CLOSING.match(p, b).end() < close:
                continue  # inside a quotation
            at_start = span[0] == _FIRST.match(p, start).end()
            bracketed = p[span[0]] in _BRACKETS
            quoted = not bracketed
            end = close + 1
        while end < len(p) and p[end] in _CLOSERS and not (p[end] == '"' and bisect_right(opens, end) - 1 >= 0 and spans[bisect_right(opens, end) - 1][0] == end) and p[end] not in _OPENERS:
            end += 1
        if end >= length:
            break
        ends = _ends(p, start, a, b, end, run, lang, model, quoted, bracketed, at_start)
        if ends and run == "." and span is None:
            if mixed and spans_of_words is None and (mixed := _mixed(p, lang)):
                spans_of_words = _Spans(p)
            # a sentence may be quoted from another language
            near = spans_of_words.language(max(start, end - 120), end + 60, lang) if mixed else lang
            if near != lang:
                ends = _ends(p, start, a, b, end, run, near, model, quoted, bracketed, at_start)
        if ends:
            cuts.append(end)
            start = end
    return cuts


def _ends(p: str, start: int, a: int, b: int, end: int, run: str, lang: str, model: Model, quoted: bool, bracketed: bool, at_start: bool) -> bool:
    """Whether a sentence ends with the terminal run [a, b), whose closing marks go to ``end``."""
    nxt = p[end]
    spaced = nxt.isspace()
    wide = any(c in _NO_SPACE for c in run)
    if not spaced and not wide and "…" not in run:
        if not ((quoted or bracketed) and (nxt in _OPENERS or _CJK.match(nxt))):
            return run[-1] in "!?" and bool(_CJK.match(nxt)) and not quoted
    token = (_WORD.search(p, end) or [""])[0]
    kind, x = kind_of(token), bare(token)
    starter, other = (lang, x) in model.starters, (lang, x) in model.others
    if bracketed:
        return at_start
    if quoted:
        if kind == "low":
            return starter and not other and token[0] not in ",;:—–-"
        if token[:1] in ",;:—–-،，、；：" or token[:1] in ")）":
            return False
        if kind == "other":
            return spaced and at_start and (starter or bool(_CJK.match(token)) and not _CJK.match(p[a - 1]))
        return True
    if token[:1] in ",;:，、；：،" or token[:1] in "—–" and kind == "low":
        return False
    if run[-1] in "?!" and not wide or run[-1] in "؟":
        if kind == "low" and not starter and other:
            return False
        return True
    if "…" in run or run.startswith(".."):
        if wide:
            return True
        if kind == "low" and not _CJK.match(p[a - 1 : a]):
            return False
        if _CJK.match(p[a - 1 : a]):  # the sentence may stand in a text of another language
            lang = "ja" if _KANA.search(p, max(0, a - 30), a) else "zh"
        return not _CJK.match(token) or (lang, token[:2]) not in model.continued  # a name from elsewhere may open any sentence
    if wide or run[0] in "۔;։":
        return True
    # a period
    word = _before(p, a)
    w = before_period(word)
    if w == "##" and not p[start : a - len(word)].strip(_LEAD):
        return False  # the number of a list item opens its sentence
    abbreviation = (lang, w) in model.abbreviations
    if kind == "num":
        return not ((lang, w) in model.before_numbers or (len(w) == 1 and w.isalpha() and not starter))
    if kind == "low":
        return starter and not abbreviation
    if starter:
        return True
    if (lang, w, x) in model.collocations or abbreviation:
        return False
    if len(w) == 1 and w.isalpha() or w.count(".") and re.fullmatch(r"(?:\w\.)+\w", w):
        return not other and kind != "up"
    return not (w == "##" and other)


def _before(p: str, a: int) -> str:
    """What stands before a mark, back to the last blank."""
    i = a
    while i and p[i - 1] not in _BLANKS:
        i -= 1
    return p[i:a]


def asked(text: str) -> set[tuple[str, str, str]]:
    """(part, w, x) of every entry that sentences() can look up for a text, in whatever language."""
    out = set()
    at = 0
    for stop in [*[m.span() for m in PARAGRAPH.finditer(text)], (len(text), len(text))]:
        p = text[at : stop[0]]
        at = stop[1]
        for m in _TERMINAL.finditer(p):
            a, b = m.span()
            w = before_period(_before(p, a))
            out.add(("w", w, ""))
            for end in range(b, min(_CLOSING.match(p, b).end(), len(p) - 1) + 1):
                x = bare((_WORD.search(p, end) or [""])[0])
                out |= {("x", x, ""), ("wx", w, x), ("dots", (_WORD.search(p, end) or [""])[0][:2], "")}
    return out


def _rare_of_texts(texts: DataFrame, rare: DataFrame) -> DataFrame:
    """(text_id, rare): the rare entries that each text asks for; texts are known by their hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = list(asked(t))
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(found), pa.string()), *[pa.array([f[i] for f in found], pa.string()) for i in range(3)]], ["text_id", "part", "w", "x"])

    wanted = texts.where("t is not null").select("text_id", "t").mapInArrow(run, "text_id string, part string, w string, x string").distinct()
    part = F.create_map(*[F.lit(v) for pair in _ASKED.items() for v in pair])[F.col("role")]
    return wanted.join(rare.withColumn("part", part), ["part", "w", "x"]).groupBy("text_id").agg(F.collect_list(F.struct("role", "lang", "w", "x")).alias("rare"))


def found(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(key, sent_start, sent_end) of every sentence; null, empty and blank texts have none, repeated rows give theirs again."""

    known = Model(**model.sets())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, a, b = [], [], []
            more = batch.column(3).to_pylist() if batch.num_columns > 3 else [None] * batch.num_rows
            for i, (t, label) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                if t and not t.isspace():
                    own = [(known.sets()[r["role"]], known.key(r["role"], r["lang"], r["w"], r["x"])) for r in more[i] or ()]
                    for entries, k in own:
                        entries.add(k)
                    for s, e in sentences(t, language(t, label), known):
                        rows.append(i)
                        a.append(s)
                        b.append(e)
                    for entries, k in own:
                        entries.discard(k)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int32())), pa.array(a, pa.int64()), pa.array(b, pa.int64())], [key, "sent_start", "sent_end"])

    kind = df.schema[key].dataType.simpleString()
    label = F.col(lang).cast("string") if lang in df.columns else F.lit(None).cast("string")
    rows = df.select(F.col(key), F.col(text).cast("string").alias("t"), label.alias("__lang"))
    if model.rare is not None:
        rows = rows.withColumn("text_id", F.sha2("t", 256))
        rows = rows.join(_rare_of_texts(rows, model.rare), "text_id", "left").select(key, "t", "__lang", "rare")
    return rows.mapInArrow(run, f"`{key}` {kind}, sent_start bigint, sent_end bigint")
