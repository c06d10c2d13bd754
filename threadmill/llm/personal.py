"""Problem 6: personal information in free text, and keyed surrogates for it.

E-mail addresses, phone numbers, identity numbers and street addresses are found by their shape, persons by name
parts: a given list is widened by the corpus, as words that stand beside known given names are family names and
the other way round. Every entity receives a surrogate made from a keyed hash of its normal form, alike in type,
script, gender and layout: digits for digits, names for names, each written as the original was. Normal forms keep
coreference (one person in another order or case has one surrogate). A check in the cluster finds surrogates that
meet each other or a real entity; these are drawn again until all are distinct.
"""

import hashlib
import hmac
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from threadmill.session import cut

EMAIL, PHONE, ID_NUMBER, ADDRESS, PERSON = "email", "phone", "id_number", "address", "person"
#: So many learned name parts are broadcast at most, the most frequent ones; the rest are joined to the texts that hold them.
BROADCAST = 200_000
#: A word is a name part if at least this share of its places beside another capitalised word is beside a known one.
SHARE, ROUNDS = 0.5, 3

_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
_DOT_WORD = r"(?:\s?[\[({]\s?(?:dot|punkt|punto|point)\s?[\])}]\s?|\s(?:dot|punkt|punto|point)\s)"
_EMAIL = re.compile(
    rf"(?<![\w.+%/@-])(?P<local>[A-Za-z0-9](?:[A-Za-z0-9._%+-]*[A-Za-z0-9_+-])?)(?:(?P<at>[@＠]|&#64;|&commat;)(?P<domain>{_LABEL}(?:[.．]{_LABEL})*[.．][A-Za-z]{{2,}})(?![\w@＠-]|[.．]\w|:[\w/~])"
    rf"|(?P<wat>\s?[\[({{]\s?(?:at|arroba|ät)\s?[\])}}]\s?|\sat\s)(?P<wdomain>{_LABEL}(?:(?:\.|{_DOT_WORD}){_LABEL})*(?:\.|{_DOT_WORD})[A-Za-z]{{2,}})(?![\w@-]|\.\w))",
    re.I,
)
#: Without an at sign, an address needs one of these.
_EMAIL_SIGN = re.compile(r"[\[({]\s?(?:at|arroba|ät)\s?[\])}]|\s(?:dot|punkt|punto|point)\s|&#64;|&commat;|\sat\s[\w-]+(?:\.[\w-]+)*\.[a-z]{2,}", re.I)
_PHONE = re.compile(
    r"[+(0-9](?<![\w.+/@-].)(?:(?<=\+)\d{1,3}(?:[ .\-/]?(?:\(\d{1,5}\)|\d{1,5})){1,6}|(?<=0)0\d{2,3}(?:[ .\-/]?(?:\(\d{1,5}\)|\d{1,5})){1,6}|(?<=\()[2-9]\d{2}\) ?\d{3}[-. ]\d{4}|(?<=[2-9])\d{2}(?P<s>[-. ])\d{3}(?P=s)\d{4}|(?<=0)\d(?P<f>[-. ])\d{2}(?:(?P=f)\d{2}){3}"
    r"|(?<=\()0\d{1,4}\) ?\d{3,8}(?:[ -]\d{2,5}){0,2}|(?<=0)\d{2,4}[ /\-]\d{3,8}(?:[ \-]\d{2,5}){0,2})(?!\w|[./:\-]\d)"
)
#: Words that name the personal numbers of people.
_NAMED = re.compile(
    r"(?<!\w)(?:social security|ssn|(?:national )?insurance n|ni (?:no|number)|nino|dni|nie|nif|steuer-?(?:id|nummer|identifikationsnummer)|idnr|tax(?:payer)? (?:id|no|number|identification)|tin|num[ée]ro de s[ée]cu|s[ée]curit[ée] sociale|nir|passport|reisepass|pasaporte|passeport"
    r"|(?:national )?identity (?:card|no|number)|id card|personalausweis|carte d.identit[ée]|codice fiscale|cpf|curp|pesel|bsn|sin|паспорт|снилс|инн)",
    re.I,
)
#: One of these is in every text in which _NAMED finds something.
_NAMED_SIGNS = ("social s", "ssn", "insurance n", "ni n", "nino", "dni", "nie", "nif", "steuer", "idnr", "tax", "tin", "cu", "sociale", "nir", "passport", "reisepass", "pasaporte", "passeport", "identity", "id card", "ausweis", "identit", "fiscale", "cpf", "curp", "pesel", "bsn", "sin", "паспорт", "снилс", "инн")
_ID_SIGN = re.compile(r"\d{3}-\d{2}-\d{4}|[12] ?\d{2} ?\d{2} ?\d[\dAB] ?\d{3} ?\d{3} ?\d{2}")
_ID = re.compile(
    r"(?<![\w.+/@-])(?:(?P<ssn>\d{3}-\d{2}-\d{4})|(?P<nir>[12] ?\d{2} ?\d{2} ?(?:\d{2}|2[AB]) ?\d{3} ?\d{3}(?: ?\d{2})?)|\d{3} \d{2} \d{4}|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]|[XYZ]?\d{7,8}-?[A-Z]|\d{2} \d{3} \d{3} \d{3}|\d{3}\.\d{3}\.\d{3}-\d{2}"
    r"|[A-Z]{6}\d{2}[A-Z]\d{2}[A-Z]\d{3}[A-Z]|[A-Z]{1,3}\d[A-Z0-9]{5,7}|\d{9,11})(?!\w|[./@:\-]\w)"
)
#: Kinds of streets, by the place of the number.
_AFTER = r"(?:Street|Lane|Avenue|Boulevard|Road|Drive|Court|Place|Square|Terrace|Parkway|Crescent|Highway|Way|Close|St\.?|Ln\.?|Ave\.?|Blvd\.?|Rd\.?|Dr\.?|Ct\.?|Pl\.?|Sq\.?|Hwy\.?|Pkwy\.?)"
#: A text without any of these has no address.
_STREET_SIGNS = (
    "street", "str.", "strasse", "lane", "avenue", "boulevard", "road", "drive", "court", "place", "square", "terrace", "parkway", "crescent", "highway", "way", "close", "rue", "av.", "bd ", "chemin", "impasse", "quai", "alle", "route", "cours", "weg", "platz", "gasse",
    "ring", "ufer", "damm", "markt", "hof", "chaussee", "am ", "an der ", "im ", "zum ", "zur ", "calle", "avenida", "avda", "plaza", "paseo", "camino", "carrer", "via", "piazza", "corso", "rua", "travessa",
)
_STREET_SHORT = re.compile(r" (?:st|ln|ave|blvd|rd|dr|ct|pl|sq|hwy|pkwy)(?!\w)")
_STREET_OTHER = re.compile(r"straße|all[ée]e|[а-я]\.|улиц|проспект|переул|площад|шоссе|бульвар|[路街道巷]")
_CAP = r"[^\W\d_a-zß-ÿа-я][\w'’]*(?:-[\w'’]+)*"
_ADDRESS = re.compile(
    rf"(?<![\w.+/@-])(?:\d{{1,5}}(?: ?[A-Za-z])? (?:(?:North|South|East|West|N\.|S\.|E\.|W\.|NE|NW|SE|SW) )?(?:{_CAP} ){{1,3}}{_AFTER}(?!\w)|\d{{1,5}} (?!bis |ter |quater )[a-z]+(?:-[a-z]+)* (?:street|lane|avenue|boulevard|road|drive|court|square|terrace)(?!\w)"
    rf"|\d{{1,5}}(?: ?(?:bis|ter|quater))?,? (?:rue|avenue|av\.|boulevard|bd|place|chemin|impasse|quai|all[ée]e|route|cours)(?: (?:de la|de l['’]|du|des|de|d['’]))? ?{_CAP}(?: {_CAP})*"
    rf"|(?:(?:Am|An der|An den|Auf der|Im|In der|Zum|Zur|Alte|Neue|Unter den) )?{_CAP}(?:str\.|straße|strasse|weg|platz|gasse|allee|ring|ufer|damm|markt|hof|chaussee) \d{{1,4}}(?: ?[a-z](?!\w))?|(?:Am|An der|Im|Zum|Zur) {_CAP} \d{{1,4}}[a-z]?(?=$|[.,;\n])"
    rf"|(?:Calle|Avenida|Avda\.|Plaza|Paseo|Camino|Carrer|Via|Viale|Piazza|Corso|Rua|Travessa)(?: (?:del|de la|de los|de las|de|da|do|dos|della|dei))? {_CAP}(?: {_CAP})*,? (?:n\.?º ?|nº ?)?\d{{1,4}}[A-Za-z]?"
    rf"|(?:ул\.|улица|просп\.|пр\.|проспект|пер\.|переулок|наб\.|пл\.|площадь|шоссе|бульвар) ?[А-ЯЁ][А-Яа-яё-]*(?: [А-ЯЁ][А-Яа-яё-]*)*,? (?:д\.|дом) ?\d{{1,4}}(?:[а-я](?!\w))?(?:,? (?:корп\.|к\.|кв\.) ?\d{{1,4}})*|[一-鿿]{{2,8}}(?:路|街|道|巷)\d{{1,5}}号)(?!\w)",
)
_WORD = re.compile(r"(?<![\w@.+/\\-])[^\W\d_]+(?:[-'’][^\W\d_]+)*(?![\w@+/\\-]|\.\w)")
#: Particles and titles of names.
_PARTICLES = "van der|van den|van de|van|von der|von|zu|de la|de los|del|della|de|da|dos|do|di|du|la|le|ter|ten|den|bin|ibn|al|el|af|av"
_INITIALS = r"(?:[^\W\d_]\.(?: |(?=[^\W\d_]\.)))*"
_FAMILY = re.compile(rf" {_INITIALS}(?:(?:{_PARTICLES}) )?(?P<name>[^\W\d_]+(?:[-'’][^\W\d_]+)*)(?![\w@+/\\-]|\.\w)", re.I)
_GIVEN = re.compile(r",[ ](?P<name>[^\W\d_]+(?:[-'’][^\W\d_]+)*)(?:(?: [^\W\d_]\.)+)?(?![\w@+/\\-]|\.\w)")
_TITLE = re.compile(r"(?:Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Mme|Mlle|Sr|Sra|Sir|Dame)\.? $")
_PAIR = re.compile(rf"(?<![\w@.+/\\-])(?=(?P<a>{_CAP}) {_INITIALS}(?:(?:{_PARTICLES}) )?(?P<b>{_CAP})(?![\w@+/\\-]|\.\w))")
_SLAVIC = re.compile(r"(?<![\w@.+/\\-])(?P<given>[А-ЯЁ][а-яё]+(?: [А-ЯЁ][а-яё]+(?:вич|вна|ична))?) (?P<family>[А-ЯЁ][а-яё]*(?:ов|ев|ёв|ин|ын|ова|ева|ёва|ина|ына|ский|ская|цкий|цкая|ко|юк|ук|ич)(?:-[А-ЯЁ][а-яё]+)?)(?!\w)")


@dataclass
class Names:
    """Casefolded name parts."""

    given: set = field(default_factory=set)
    family: set = field(default_factory=set)
    rare: DataFrame | None = None  # (part, kind) of those that are not in the sets
    finder: object = None  # made by each worker; False: every word is looked up


@dataclass(frozen=True, slots=True)
class Entity:
    start: int
    end: int
    kind: str
    found: str
    normal: str  # what mentions of one entity share


def _known(word: str, names: set) -> bool:
    w = word.casefold()
    return w in names or any(p in names for p in re.split("[-'’]", w) if len(p) > 2) and "-" in w


def _style(words: list[str]) -> str:
    return "upper" if all(w.isupper() for w in words) else "lower" if all(w.islower() for w in words) else "title" if all(w[0].isupper() for w in words) else ""


def _finder(names: Names):
    """An automaton over all name parts, kept with the names."""
    if names.finder is None:
        import ahocorasick

        names.finder = ahocorasick.Automaton()
        for w in names.given | names.family:
            names.finder.add_word(w, len(w))
        names.finder.make_automaton()
    return names.finder


def _name_words(text: str, names: Names) -> Iterator[re.Match]:
    """The words of a text that hold a name part."""
    low = text.lower()
    if names.finder is False or len(low) != len(text) or not (names.given or names.family):
        yield from _WORD.finditer(text)
        return
    last = -1
    for end, n in _finder(names).iter(low):
        start = end - n + 1
        while start > 0 and (low[start - 1].isalpha() or low[start - 1] in "-'’"):
            start -= 1
        if start > last:
            last = start
            while start < end and not low[start].isalpha():
                start += 1
            if m := _WORD.match(text, start):
                yield m


def _persons(text: str, names: Names) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, given, family) of the names in a text."""
    given, family = names.given, names.family
    for m in _name_words(text, names):
        w = m.group()
        if _known(w, given) and (f := _FAMILY.match(text, m.end())):
            other = f.group("name")
            style = _style([w, other])
            if _known(other, family) and style or style == "title" and _TITLE.search(text, max(0, m.start() - 6), m.start()):
                yield m.start(), f.end(), w, other
        if _known(w, family) and (g := _GIVEN.match(text, m.end())):
            other = g.group("name")
            if _known(other, given) and _style([w, other]):
                yield m.start(), g.end(), other, w
    for m in _SLAVIC.finditer(text) if not text.isascii() else ():
        yield m.start(), m.end(), m.group("given"), m.group("family")


def _valid_phone(s: str) -> bool:
    n = sum(c.isdigit() for c in s)
    return 8 <= n <= 15 and s.count("(") == s.count(")")


def _valid_nir(s: str) -> bool:
    d = s.replace(" ", "").replace("2A", "19").replace("2B", "18")
    return len(d) == 15 and int(d[13:]) == 97 - int(d[:13]) % 97


def entities(text: str | None, names: Names) -> list[Entity]:
    """What is personal in a text, in order and without overlaps; nothing in null, empty or blank texts."""
    if not text or text.isspace():
        return []
    taken: list[tuple[int, int]] = []
    out: list[Entity] = []

    def take(a: int, b: int, kind: str, normal: str) -> None:
        hits.append((a, b, kind, normal))

    def settle() -> None:
        """Add the hits that lie apart from everything found before."""
        nonlocal taken
        free, k = [], 0
        for a, b, kind, normal in sorted(hits, key=lambda h: (h[0], -h[1])):
            while k < len(taken) and taken[k][1] <= a:
                k += 1
            if (k == len(taken) or taken[k][0] >= b) and (not free or free[-1][1] <= a):
                free.append((a, b))
                out.append(Entity(a, b, kind, text[a:b], normal))
        taken = sorted(taken + free)
        hits.clear()

    hits: list[tuple[int, int, str, str]] = []
    if "@" in text or "＠" in text or _EMAIL_SIGN.search(text):
        for m in _EMAIL.finditer(text):
            domain = re.sub(_DOT_WORD, ".", m.group("domain") or m.group("wdomain"), flags=re.I).replace("．", ".")
            take(*m.span(), EMAIL, f"{m.group('local')}@{domain}".casefold())
        settle()
    if re.search(r"\d", text):
        low = text.lower()
        cues = [m.span() for m in _NAMED.finditer(text)] if any(c in low for c in _NAMED_SIGNS) else []
        k = 0
        for m in _ID.finditer(text) if cues or _ID_SIGN.search(text) else ():
            a, b = m.span()
            while k < len(cues) and cues[k][1] < a - 60:
                k += 1
            near = any((c[1] <= a and a - c[1] <= 40 and "\n" not in text[c[1] : a]) or (c[0] >= b and c[0] - b <= 12 and "\n" not in text[b : c[0]]) for c in cues[k : k + 8])
            if near or m.group("ssn") or m.group("nir") and _valid_nir(m.group()):
                take(a, b, ID_NUMBER, re.sub(r"[^0-9A-Z]", "", m.group()))
        settle()
        for m in _PHONE.finditer(text):
            if _valid_phone(m.group()):
                take(*m.span(), PHONE, re.sub(r"^00", "+", re.sub(r"[^0-9+]", "", m.group().replace("(0)", ""))))
        settle()
        for m in _ADDRESS.finditer(text) if any(x in low for x in _STREET_SIGNS) or _STREET_SHORT.search(low) or not low.isascii() and _STREET_OTHER.search(low) else ():
            take(*m.span(), ADDRESS, re.sub(r"[\s,.]+", " ", m.group()).strip().casefold())
        settle()
    for a, b, given, family in _persons(text, names):
        take(a, b, PERSON, f"{given.casefold()} {family.casefold()}")
    settle()
    return sorted(out, key=lambda e: e.start)


def learn_names(df: DataFrame, text: str, known: DataFrame, most: int = BROADCAST) -> Names:
    """The name parts of ``known`` (name_part, part_kind) and those that all texts of ``df`` add to them.

    Pairs of capitalised words are counted per Arrow batch, then in the cluster. In each round a word is learned as
    a family name if in at least half of its places it follows a known given name, and in at least two; given names
    likewise. Of what is learned at most ``most`` parts come to the driver; the others stay a table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tally: dict[tuple[str, str], int] = {}
            for t in batch.column(0).to_pylist():
                for m in _PAIR.finditer(t):
                    key = (m.group("a").casefold(), m.group("b").casefold())
                    tally[key] = tally.get(key, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in tally], pa.string()), pa.array([k[1] for k in tally], pa.string()), pa.array(list(tally.values()), pa.int64())], ["given", "family", "n"])

    pairs = df.select(F.col(text).cast("string").alias("t")).where("t is not null").mapInArrow(run, "given string, family string, n bigint").groupBy("given", "family").agg(F.sum("n").alias("n"))
    pairs = cut(pairs)
    parts = known.where("name_part is not null").select(F.lower("name_part").alias("part"), F.col("part_kind").alias("kind")).distinct()
    sides = {"family": "given", "given": "family"}
    totals = {s: pairs.groupBy(s).agg(F.sum("n").alias("all")) for s in sides}
    for _ in range(ROUNDS):
        more = []
        for side, other in sides.items():
            beside = pairs.join(parts.where(F.col("kind") == other).select(F.col("part").alias(other)), other).groupBy(side).agg(F.sum("n").alias("k"))
            more.append(beside.join(totals[side], side).where((F.col("k") >= 2) & (F.col("k") >= SHARE * F.col("all"))).select(F.col(side).alias("part"), F.lit(side).alias("kind")))
        parts = cut(parts.unionByName(more[0]).unionByName(more[1]).distinct())
    names = Names()
    if parts.count() > most:
        seen = totals["given"].select(F.col("given").alias("part"), "all").unionByName(totals["family"].select(F.col("family").alias("part"), "all")).groupBy("part").agg(F.sum("all").alias("n"))
        ranked = cut(parts.join(seen, "part", "left").fillna(0, ["n"]))
        least = 1 + ranked.orderBy(F.desc("n")).limit(most + 1).agg(F.min("n")).first()[0]
        names.rare, parts = ranked.where(F.col("n") < least).drop("n"), ranked.where(F.col("n") >= least).drop("n")
    for r in parts.toLocalIterator():
        (names.given if r.kind == "given" else names.family).add(r.part)
    return names


def _with_rare(rows: DataFrame, names: Names) -> DataFrame:
    """rows (t, ...) with ``rare``: the rare name parts that each text holds."""
    if names.rare is None:
        return rows.withColumn("rare", F.lit(None).cast("array<struct<part:string,kind:string>>"))
    rows = rows.withColumn("text_id", F.sha2("t", 256))
    words = rows.where("t is not null").select("text_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("t"), F.lit(r"[\p{L}]+(?:[-'’][\p{L}]+)*"), F.lit(0)))).alias("part")).distinct()
    held = words.join(names.rare, "part").groupBy("text_id").agg(F.collect_list(F.struct("part", "kind")).alias("rare"))
    return rows.join(held, "text_id", "left").drop("text_id")


def _own(names: Names, rare: list | None) -> Names:
    """The names with a text's rare ones."""
    if not rare:
        return names
    return Names(names.given | {r["part"] for r in rare if r["kind"] == "given"}, names.family | {r["part"] for r in rare if r["kind"] == "family"}, finder=False)


def mentions(df: DataFrame, key: str, text: str, names: Names) -> DataFrame:
    """(key, kind, found, normal): one row per distinct key, kind and text as written.

    Null keys and texts give no rows, repeated rows count once. Whole texts are read in one pass.
    """
    kind = df.schema[key].dataType.simpleString()
    rows = _with_rare(df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).where("k is not null and t is not null"), names).select("k", "t", "rare")
    known = Names(names.given, names.family)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = [], []
            for i, (t, rare) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                got = {(e.kind, e.found): e for e in entities(t, _own(known, rare))}
                at += [i] * len(got)
                found += got.values()
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *[pa.array([getattr(e, c) for e in found], pa.string()) for c in ("kind", "found", "normal")]], ["k", "kind", "found", "normal"])

    return rows.mapInArrow(run, f"k {kind}, kind string, found string, normal string").dropDuplicates(["k", "kind", "found"]).withColumnRenamed("k", key)


_SOUNDS = {"latin": (list("bdfgklmnprstvz"), list("aeiou"), list("lmnrstk"), "a"), "cyrillic": (list("бвгдклмнпрстз"), list("аеиоу"), list("лмнрстк"), "а")}


class Dice:
    """Numbers drawn from a keyed hash."""

    def __init__(self, key: str, *what: str):
        self.bits = int.from_bytes(hmac.new(key.encode(), "\0".join(what).encode("utf-8", "surrogatepass"), hashlib.sha512).digest(), "big")

    def one_of(self, n: int) -> int:
        self.bits, k = divmod(self.bits, n)
        return k


def _word(dice: Dice, script: str, feminine: bool, syllables: int = 3) -> str:
    start, vowel, end, last = _SOUNDS[script]
    w = "".join(start[dice.one_of(len(start))] + vowel[dice.one_of(len(vowel))] for _ in range(syllables))
    return w + end[dice.one_of(len(end))] + (last if feminine else "")


def _script(s: str) -> str:
    return "cyrillic" if re.search("[Ѐ-ӿ]", s) else "latin"


def _feminine(part: str) -> bool:
    return part.casefold()[-1:] in "aeiаеия" or part.casefold().endswith(("ская", "цкая"))


def _as(pattern: str, word: str) -> str:
    """The word in the case of the pattern; every part of a pattern with hyphens is a capital one."""
    return word.upper() if pattern.isupper() and len(pattern) > 1 else word.lower() if pattern.islower() else word.capitalize()


def _part(key: str, kind: str, part: str, attempt: int) -> str:
    return _word(Dice(key, kind, part, str(attempt)), _script(part), _feminine(part))


def canonical(key: str, kind: str, normal: str, attempt: int) -> str:
    """The surrogate of an entity in normal form: alike in kind, script, gender and length; any attempt gives another."""
    dice = Dice(key, kind, normal, str(attempt))
    if kind == PERSON:
        given, family = normal.rsplit(" ", 1) if " " in normal else (normal, normal)
        return f"{_part(key, 'given', given, attempt)} {_part(key, 'family', family, attempt)}"
    if kind == EMAIL:
        local, _, domain = normal.partition("@")
        return f"{_word(dice, 'latin', False)}{dice.one_of(10_000) if re.search(r'[0-9]', local) else ''}@{'.'.join(_word(dice, 'latin', False, 2) for _ in domain.split('.')[:-1])}.example"
    if kind == ADDRESS:
        return re.sub(r"\d+", lambda m: _digits(dice, m.group()), re.sub(r"[^\W\d_]{4,}", lambda m: m.group() if _STREET_WORD.fullmatch(m.group()) else _word(dice, _script(m.group()), False, 2) + _street_end(m.group()), normal))
    keep = (3 if normal[:1] == "+" else 1) if kind == PHONE and attempt < 4 else 0  # the country or trunk code, while there is room
    return normal[:keep] + "".join(_digits(dice, c) if c.isdigit() else chr(ord("A") + dice.one_of(26)) if c.isalpha() else c for c in normal[keep:])


_STREET_WORD = re.compile(r"street|lane|avenue|boulevard|blvd|road|drive|court|place|square|terrace|parkway|crescent|highway|close|north|south|east|west|rue|chemin|impasse|quai|all[ée]e|route|cours|calle|avenida|plaza|paseo|camino|viale|piazza|corso|улица|проспект|переулок|площадь|шоссе|бульвар|просп", re.I)


def _street_end(word: str) -> str:
    m = re.search(r"(?:str|straße|strasse|weg|platz|gasse|allee|ring|ufer|damm|markt|hof|chaussee)$", word, re.I)
    return m.group() if m else ""


def _digits(dice: Dice, number: str) -> str:
    return "".join(str(dice.one_of(9) + 1 if i == 0 and len(number) > 1 and number[0] != "0" else dice.one_of(10)) for i in range(len(number)))


def written(e: Entity, surrogate: str) -> str:
    """The canonical surrogate in the layout of the mention."""
    if e.kind == PERSON:
        given, family = surrogate.rsplit(" ", 1)
        old_given, old_family = e.normal.rsplit(" ", 1)
        pattern = re.compile("|".join(f"({re.escape(x)})" for x in (old_given, old_family)), re.I)
        return pattern.sub(lambda m: _as(m.group().split(" ")[0].split("-")[0], given if m.group(1) else family), e.found)
    if e.kind == EMAIL:
        local, domain = surrogate.split("@")
        m = _EMAIL.match(e.found)
        at, dot = m.group("at") or m.group("wat"), re.search(rf"{_DOT_WORD}|[.．]", m.group("domain") or m.group("wdomain"), re.I).group()
        out = local + at + dot.join(domain.split("."))
        return out.upper() if m.group("local").isupper() and len(m.group("local")) > 1 else out
    if e.kind == ADDRESS:
        words = iter(re.findall(r"\w+(?:[-'’]\w+)*", surrogate))
        return re.sub(r"\w+(?:[-'’]\w+)*", lambda m: _as(m.group(), w) if (w := next(words, m.group())) and w[0].isalpha() else w, e.found)
    fill = iter(surrogate.lstrip("+") if e.kind == PHONE else surrogate)
    skip = re.sub(r"^00", "", e.found) if e.kind == PHONE else e.found
    head = e.found[: len(e.found) - len(skip)]
    body = skip.replace("(0)", "\0")
    return head + "".join(next(fill, c) if c.isalnum() else c for c in body).replace("\0", "(0)")


def collisions(entities: DataFrame, key: str) -> DataFrame:
    """(kind, normal, attempt) of the entities (kind, normal) whose first surrogate will not do.

    A surrogate that another entity has too, or that is itself a real entity, is drawn again: of the entities that
    share one the first in order keeps it. Rounds go on until none is left; each looks at all surrogates taken so far,
    so distinct entities have distinct surrogates.
    """
    def drawn(rows: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                kinds, normals, attempts = (batch.column(i).to_pylist() for i in range(3))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([canonical(key, *x) for x in zip(kinds, normals, attempts)], pa.string())], ["kind", "normal", "attempt", "surrogate"])

        return rows.select("kind", "normal", "attempt").mapInArrow(run, "kind string, normal string, attempt int, surrogate string")

    kept = cut(drawn(entities.select("kind", "normal").distinct().withColumn("attempt", F.lit(0))))
    again = None
    while True:
        real = kept.select("kind", F.col("normal").alias("surrogate"), F.lit(True).alias("real"))
        w = Window.partitionBy("kind", "surrogate").orderBy("attempt", "normal")
        judged = kept.join(real, ["kind", "surrogate"], "left").withColumn("place", F.row_number().over(w))
        bad = cut(judged.where("place > 1 or real").select("kind", "normal", (F.col("attempt") + 1).alias("attempt")))
        if bad.isEmpty():
            break
        kept = cut(kept.join(bad.select("kind", "normal"), ["kind", "normal"], "left_anti").unionByName(drawn(bad)))
        again = kept.where("attempt > 0")
    return again.select("kind", "normal", "attempt") if again is not None else kept.where("false").select("kind", "normal", "attempt")


def personal(df: DataFrame, key: str, text: str, known: DataFrame, secret: str = "threadmill") -> DataFrame:
    """(key, kind, found, surrogate): one row per distinct key, kind and text as written, and what replaces it.

    Empty tables give no rows. Only mentions are shuffled, never texts.
    """
    found = cut(mentions(df, key, text, learn_names(df, text, known)))
    again = collisions(found, secret)
    rows = found.join(again, ["kind", "normal"], "left")
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, kinds, texts, normals, attempts = (c.to_pylist() for c in batch.columns)
            out = [written(Entity(0, len(f), k, f, n), canonical(secret, k, n, a or 0)) for k, f, n, a in zip(kinds, texts, normals, attempts)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.string())], ["k", "kind", "found", "surrogate"])

    return rows.select(F.col(key).alias("k"), "kind", "found", "normal", "attempt").mapInArrow(run, f"k {kind}, kind string, found string, surrogate string").withColumnRenamed("k", key)


def redacted(df: DataFrame, text: str, known: DataFrame, secret: str = "threadmill", typed: bool = True, out: str = "redacted_text") -> DataFrame:
    """All rows and columns of ``df`` and the text with placeholders: ``[person Kotas Velim]``, or the bare surrogate if not ``typed``.

    Null texts stay null, texts without personal data as they are. A column called ``out`` is replaced. The texts
    that hold an entity whose surrogate was drawn again are joined to those by their hash.
    """
    names = learn_names(df, text, known)
    kept = [c for c in df.columns if c != out]
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(text).cast("string").alias("t")).withColumn("text_id", F.sha2("t", 256))
    found = cut(mentions(rows.select("text_id", "t"), "text_id", "t", names))
    again = found.join(collisions(found, secret), ["kind", "normal"]).groupBy("text_id").agg(F.collect_set(F.struct("kind", "normal", "attempt")).alias("again"))
    rows = _with_rare(rows.join(again, "text_id", "left").drop("text_id"), names).select("row", "t", "again", "rare")
    known_names = Names(names.given, names.family)

    def replaced(t: str | None, again: list | None, rare: list | None) -> str | None:
        attempts = {(r["kind"], r["normal"]): r["attempt"] for r in again or ()}
        parts, at = [], 0
        for e in entities(t, _own(known_names, rare)):
            new = written(e, canonical(secret, e.kind, e.normal, attempts.get((e.kind, e.normal), 0)))
            parts += [t[at : e.start], f"[{e.kind} {new}]" if typed else new]
            at = e.end
        return "".join(parts) + t[at:] if parts else t

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [replaced(*x) for x in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(new, pa.string())], ["row", out])

    schema = StructType([rows.schema["row"], StructField(out, StringType())])
    return rows.mapInArrow(run, schema).select("row.*", out)
