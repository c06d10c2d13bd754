"""Keyword search with BM25 over an inverted index (SR2, SR3, TK2, JN9, AG6).

index() turns documents into postings, one row per term, document and column with its positions. A query is
parsed on the driver into a tree of phrases; search() reads only the postings of its terms (the filter reaches the
scan), gathers them per document and evaluates the tree with array expressions in the JVM. Counts of documents and
lengths are those of the whole corpus, whatever filters the results.
"""

import re
import unicodedata
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadmill.config import Settings

COLUMNS = ("doc_id", "content")
#: Weight of a column in the score; every column counts in lengths.
WEIGHTS = {"doc_id": 0.0, "content": 1.0}


def _folds() -> tuple[str, str]:
    """Lower-case letters with marks and the letters they are folded to."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in [*range(0xE0, 0x250), *range(0x1E00, 0x1F00)] if chr(c).islower()]
    pairs = [(a, b) for a, b in pairs if a != b and b.isascii() and b.isalpha()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


MARKED, PLAIN = _folds()


def tokens(text: Column | str) -> Column:
    """The terms of a text: runs of letters and digits, in lower case, without marks on Latin letters."""
    text = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.translate(F.lower(text), MARKED, PLAIN), r"[^\p{L}\p{N}\p{Co}]+"), lambda t: t != "")


def fold(text: str) -> list[str]:
    """tokens() of a query's text."""
    return re.findall(r"[^\W_]+", text.lower().translate(str.maketrans(MARKED, PLAIN)))


@dataclass(frozen=True)
class Index:
    postings: DataFrame  # term, doc_id, column, positions
    lengths: DataFrame  # doc_id, length
    documents: DataFrame  # doc_id and everything that is returned or filtered by


def index(documents: DataFrame) -> Index:
    """The index of documents (doc_id, content, ...). Of repeated doc_ids one row counts; null content has no terms, null ids are left out."""
    rows = documents.where("doc_id is not null").dropDuplicates(["doc_id"])
    cells = rows.select("doc_id", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), tokens(F.coalesce(c, F.lit(""))).alias("t")) for c in COLUMNS])).alias("cell")).select("doc_id", "cell.*")
    postings = cells.select("doc_id", "column", F.posexplode("t").alias("position", "term")).groupBy("term", "doc_id", "column").agg(F.array_sort(F.collect_list("position")).alias("positions"))
    lengths = rows.select("doc_id", reduce(lambda a, b: a + b, [F.size(tokens(F.coalesce(c, F.lit("")))) for c in COLUMNS]).cast("bigint").alias("length"))
    return Index(postings, lengths, rows)


def term_stats(documents: DataFrame, text: str = "content") -> DataFrame:
    """AG6: (term, df, cf): documents that hold a term, and its occurrences in all."""
    rows = documents.select(F.monotonically_increasing_id().alias("row"), F.coalesce(text, F.lit("")).alias("t")).select("row", F.explode(tokens("t")).alias("term"))
    return rows.groupBy("term", "row").agg(F.count("*").alias("n")).groupBy("term").agg(F.count("*").alias("df"), F.sum("n").alias("cf"))


# The query language


class Malformed(ValueError):
    pass


@dataclass(frozen=True)
class Phrase:
    terms: tuple[str, ...]
    prefix: bool = False
    initial: bool = False
    columns: tuple[str, ...] = COLUMNS


@dataclass(frozen=True)
class Near:
    phrases: tuple[Phrase, ...]
    distance: int = 10


@dataclass(frozen=True)
class Node:
    kind: str  # and, or, not
    parts: tuple = field(default_factory=tuple)


_LEX = re.compile(r'\s*(?:(?P<string>"(?:[^"]|"")*")|(?P<word>[A-Za-z0-9_\x1a\u0080-\U0010ffff]+)|(?P<mark>[(){}:,+*^-]))')


class Parser:
    """Recursive descent; implicit AND binds closest, then NOT, AND, OR."""

    def __init__(self, query: str):
        self.items: list[tuple[str, str]] = []
        at = 0
        query = query.rstrip()
        while at < len(query):
            m = _LEX.match(query, at)
            if not m:
                raise Malformed(f"syntax error near {query[at:at + 10]!r}")
            self.items.append((m.lastgroup, m.group(m.lastgroup)))
            at = m.end()
        self.at = 0

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        return self.items[self.at + ahead] if self.at + ahead < len(self.items) else ("end", "")

    def take(self, value: str | None = None) -> tuple[str, str]:
        item = self.peek()
        if item[0] == "end" or value is not None and item[1] != value:
            raise Malformed("syntax error")
        self.at += 1
        return item

    def parse(self):
        tree = self.either()
        if self.peek()[0] != "end":
            raise Malformed("syntax error")
        return tree

    def _chain(self, word: str, below):
        parts = [below()]
        while self.peek() == ("word", word):
            self.take()
            parts.append(below())
        return parts

    def either(self):
        parts = self._chain("OR", self.both)
        return Node("or", tuple(parts)) if len(parts) > 1 else parts[0]

    def both(self):
        parts = self._chain("AND", self.without)
        return Node("and", tuple(parts)) if len(parts) > 1 else parts[0]

    def without(self):
        parts = self._chain("NOT", self.implicit)
        tree = parts[0]
        for p in parts[1:]:
            tree = Node("not", (tree, p))
        return tree

    def implicit(self):
        parts = [self.unit()]
        while self.peek()[0] == "string" or self.peek()[0] == "word" and self.peek()[1] not in ("AND", "OR", "NOT") or self.peek()[1] in ("(", "{", "^", "-"):
            parts.append(self.unit())
        return Node("and", tuple(parts)) if len(parts) > 1 else parts[0]

    def _columns(self) -> tuple[str, ...] | None:
        """A column filter, if one stands here."""
        start, negated = self.at, False
        if self.peek()[1] == "-" and self.peek()[0] == "mark":
            negated = True
            self.take()
        names = []
        if self.peek()[1] == "{" and self.peek()[0] == "mark":
            self.take()
            while self.peek()[1] != "}":
                names.append(self.name())
            self.take()
        elif self.peek()[0] in ("word", "string") and self.peek(1) == ("mark", ":"):
            names.append(self.name())
        elif negated:
            raise Malformed("syntax error")
        else:
            self.at = start
            return None
        self.take(":")
        for n in names:
            if n.lower() not in COLUMNS + ("session_id", "git_branch", "turn_index", "timestamp", "chunk_type", "project_root"):
                raise Malformed(f"no such column: {n}")
        names = [n.lower() for n in names]
        return tuple(c for c in COLUMNS if (c in names) != negated)

    def name(self) -> str:
        kind, value = self.take()
        if kind not in ("word", "string"):
            raise Malformed("syntax error")
        return value.strip('"')

    def unit(self):
        columns = self._columns()
        if columns is not None:
            if self.peek() == ("mark", "("):
                self.take()
                tree = self.either()
                self.take(")")
                return _within(tree, columns)
            return _within(self.near_or_phrase(), columns)
        if self.peek() == ("mark", "("):
            self.take()
            tree = self.either()
            self.take(")")
            return tree
        return self.near_or_phrase()

    def near_or_phrase(self):
        if self.peek() == ("word", "NEAR") and self.peek(1) == ("mark", "("):
            self.take()
            self.take()
            phrases, distance = [], 10
            while self.peek()[1] not in (")", ","):
                phrases.append(self.phrase())
            if self.take()[1] == ",":
                kind, number = self.take()
                if kind != "word" or not number.isdigit():
                    raise Malformed("expected integer")
                distance = int(number)
                self.take(")")
            return Near(tuple(phrases), distance)
        return self.phrase()

    def phrase(self) -> Phrase:
        initial = self.peek() == ("mark", "^")
        if initial:
            self.take()
        terms, prefix = [], False
        while True:
            kind, value = self.take()
            if kind not in ("word", "string") or kind == "word" and value in ("AND", "OR", "NOT"):
                raise Malformed("syntax error")
            terms += fold(value[1:-1].replace('""', '"') if kind == "string" else value)
            if self.peek() == ("mark", "*"):
                self.take()
                prefix = True
            if self.peek() != ("mark", "+"):
                return Phrase(tuple(terms), prefix and bool(terms), initial)
            self.take()


def _within(tree, columns: tuple[str, ...]):
    if isinstance(tree, Phrase):
        return Phrase(tree.terms, tree.prefix, tree.initial, tuple(c for c in tree.columns if c in columns))
    if isinstance(tree, Near):
        return Near(tuple(_within(p, columns) for p in tree.phrases), tree.distance)
    return Node(tree.kind, tuple(_within(p, columns) for p in tree.parts))


def _slim(tree):
    """The tree without phrases that have no terms; None where nothing is left."""
    if isinstance(tree, Phrase):
        return tree if tree.terms else None
    if isinstance(tree, Near):
        phrases = tuple(p for p in tree.phrases if p.terms)
        return Near(phrases, tree.distance) if len(phrases) > 1 else phrases[0] if phrases else None
    parts = [_slim(p) for p in tree.parts]
    if tree.kind == "not":
        return Node("not", tuple(parts)) if parts[0] and parts[1] else parts[0]
    parts = [p for p in parts if p]
    return Node(tree.kind, tuple(parts)) if len(parts) > 1 else parts[0] if parts else None


def parse(query: str):
    """The tree of a query, or None where it can match nothing.

    Every double quote is doubled before the first try; whatever the language does not take is one phrase of all its words.
    """
    doubled = query.replace('"', '""')
    try:
        return _slim(Parser(doubled).parse())
    except Malformed:
        terms = tuple(fold(query))
        return Phrase(terms) if terms else None


def phrases(tree) -> list[Phrase]:
    if isinstance(tree, Phrase):
        return [tree]
    if isinstance(tree, Near):
        return list(tree.phrases)
    return [p for part in tree.parts for p in phrases(part)]


def _positions(term: str, prefix: bool, column: str) -> Column:
    """Where a term stands in a column of the gathered document."""
    same = lambda x: F.startswith(x["term"], F.lit(term)) if prefix else x["term"] == term
    return F.flatten(F.transform(F.filter("postings", lambda x: (x["column"] == column) & same(x)), lambda x: x["positions"]))


def _places(p: Phrase, column: str) -> Column:
    """Where a phrase starts in a column of the gathered document."""
    shifted = lambda places, i: F.transform(places, lambda x: x - i)
    lists = [shifted(_positions(t, p.prefix and i == len(p.terms) - 1, column), i) for i, t in enumerate(p.terms)]
    places = reduce(F.array_intersect, lists[1:], F.array_distinct(lists[0]))
    return F.filter(places, lambda x: x == 0) if p.initial else places


def _within_reach(places: Column, s: Column, reach: int) -> Column:
    return F.exists(places, lambda x: (x <= s) & (s - x <= reach))


def _holds(tree, at: dict[Phrase, dict[str, str]]) -> Column:
    if isinstance(tree, Phrase):
        return reduce(lambda a, b: a | b, [F.size(F.col(c)) > 0 for c in at[tree].values()], F.lit(False))
    if isinstance(tree, Near):
        found = []
        for column in COLUMNS:
            if not all(column in p.columns for p in tree.phrases):
                continue
            # the rightmost place of a choice is tried in turn; each phrase then starts at most so far before it
            spots = F.flatten(F.array(*[F.col(at[p][column]) for p in tree.phrases]))
            near = lambda s: reduce(lambda a, b: a & b, [_within_reach(F.col(at[p][column]), s, tree.distance + len(p.terms)) for p in tree.phrases])
            found.append(F.exists(spots, near))
        return reduce(lambda a, b: a | b, found, F.lit(False))
    parts = [_holds(p, at) for p in tree.parts]
    if tree.kind == "not":
        return parts[0] & ~parts[1]
    return reduce((lambda a, b: a & b) if tree.kind == "and" else (lambda a, b: a | b), parts)


def scored(idx: Index, query: str, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, score) of every document that a query matches; the smaller the score, the better (BM25)."""
    tree = parse(query)
    if tree is None:
        return idx.lengths.where("false").select("doc_id", F.lit(0.0).alias("score"))
    units = phrases(tree)
    exact = {t for p in units for t in (p.terms[:-1] if p.prefix else p.terms)}
    starts = {p.terms[-1] for p in units if p.prefix}
    wanted = reduce(lambda a, b: a | b, [F.col("term").isin(*sorted(exact))] * bool(exact) + [F.startswith("term", F.lit(s)) for s in sorted(starts)])
    docs = idx.postings.where(wanted).groupBy("doc_id").agg(F.collect_list(F.struct("term", "column", "positions")).alias("postings"))
    at = {}
    for i, p in enumerate(dict.fromkeys(units)):
        at[p] = {c: f"p{i}_{c}" for c in p.columns}
        docs = docs.withColumns({name: _places(p, c) for c, name in at[p].items()})
    docs = docs.drop("postings").join(idx.lengths, "doc_id")
    names = [f"f{i}" for i in range(len(units))]
    weighted = [reduce(lambda a, b: a + b, [WEIGHTS[c] * F.size(F.col(n)) for c, n in at[p].items()], F.lit(0.0)) for p in units]
    held = [F.sum(reduce(lambda a, b: a | b, [F.size(F.col(n)) > 0 for n in at[p].values()], F.lit(False)).cast("bigint")) for p in units]
    counts = docs.agg(*[F.coalesce(h, F.lit(0)).alias(f"n{i}") for i, h in enumerate(held)])
    corpus = idx.lengths.agg(F.count("*").alias("n_docs"), F.avg("length").alias("mean"))
    stats = corpus.crossJoin(counts)  # one row by one row
    hits = docs.where(_holds(tree, at)).select("doc_id", "length", *[w.alias(n) for w, n in zip(weighted, names)]).crossJoin(F.broadcast(stats))
    k1, b = settings.bm25_k1, settings.bm25_b
    parts = []
    for i, n in enumerate(names):
        raw = F.log((F.col("n_docs") - F.col(f"n{i}") + 0.5) / (F.col(f"n{i}") + 0.5))
        idf = F.when(raw <= 0, 1e-6).otherwise(raw)
        f = F.col(n)
        parts.append(idf * f * (k1 + 1) / (f + k1 * (1 - b + b * F.col("length") / F.col("mean"))))
    return hits.select("doc_id", (-reduce(lambda a, c: a + c, parts)).alias("score"))


def search(idx: Index, query: str, n: int = 15, where: Column | None = None, settings: Settings = Settings()) -> DataFrame:
    """The n best matches: the documents' columns, score, and rank from 1. ``where`` filters results, not statistics; ties go by doc_id."""
    rows = scored(idx, query, settings)
    documents = idx.documents if where is None else idx.documents.where(where)
    return rows.join(documents, "doc_id").orderBy("score", "doc_id").limit(n)
