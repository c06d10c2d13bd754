import re

import pytest

from threadmill.llm import personal
from threadmill.llm.personal import Names, canonical, entities, learn_names, mentions, redacted, written

NAMES = Names({"mara", "imani", "yannick"}, {"quisby", "ferncastle-uhl", "hexbury"})
KNOWN = [("Mara", "given"), ("Imani", "given"), ("Quisby", "family"), (None, "family")]

FOUND = {
    "email": ["mara.quisby@example.org", "MARA@MAIL.X.EXAMPLE", "mara＠example.com", "mara at mail dot example dot com", "mara[at]example[dot]com", "mara{at}x{dot}test", "mara(at)x-labs(dot)example", "m+tag@x-labs.example"],
    "phone": ["+49 30 23125 900", "+16175550151", "415.555.0108", "713-555-0134", "+1-202-555-0179", "01.99.00.84.69", "(713) 555-0152", "020 7946 0627", "0044 (0)20 7946 0622", "030/23125-803"],
    "address": ["285 Old-Copper Lane", "18 North Moonlatch Ave.", "86 ferriswell drive", "86B Ashmere Rd", "187 bis avenue du Moonlatch", "171, rue des Ashmeres", "Am Sedgewayplatz 285", "Ashmereweg 127a", "Brindlestr. 150", "Calle del Old-Copper, 333", "ул. Тихая, д. 285"],
    "person": ["Mara Quisby", "Quisby, Mara", "MARA QUISBY", "mara quisby", "Mara T. Ferncastle-Uhl", "Yannick van der Hexbury", "Йонас Тарнквистов", "Илзе Оксбранская"],
}
IDS = [("SSN 941 58 8973", "941 58 8973"), ("social security number (905-27-5489)", "905-27-5489"), ("QQ 69 94 67 A as insurance number", "QQ 69 94 67 A"), ("DNI, it reads 00009377R", "00009377R"), ("numéro de sécu: 1 38 99 49 570 384 79", "1 38 99 49 570 384 79"), ("Steuer-ID 00 099 394 009", "00 099 394 009"), ("passport no. X0N551708", "X0N551708")]
NOTHING = [
    "Clone git@git.venturi.example:team/a.git again.", "The prompt showed root@build-77:~ and hung.", "Pin x@76.2.1 and drop @consumer.cached.", "Server 192.0.2.65 answers on port 29681 since 2026-03-10 10:25:07.", "Job id 1687816356 ended, build 10.0.16870.88 too.",
    "Ticket ORD-2994-8308 mentions 52 Main threads in lane 2.", "Blue Harbor and Night Build are releases.", "The run key is 2a06decd-5386-4a1b-9c2d-5b1bbb4901da.", "The branch mara-index and the host quisby33 are gone.", "2026-01-05T00:00:00.977Z WARN quillow took 562 ms", "", " \n", None,
]


@pytest.mark.parametrize("kind,text", [(k, t) for k, ts in FOUND.items() for t in ts])
def test_kinds(kind, text):
    for around in ("{}", "It is {} now.", "x={};", "**Note** {}\r\n"):
        assert [(e.kind, e.found) for e in entities(around.format(text), NAMES)] == [(kind, text)]


def test_numbers_of_people():
    assert [[(e.kind, e.found) for e in entities(t, NAMES)] for t, _ in IDS] == [[("id_number", n)] for _, n in IDS]


@pytest.mark.parametrize("text", NOTHING)
def test_nothing_personal(text):
    assert entities(text, NAMES) == []


@pytest.mark.parametrize("kind,text", [(k, t) for k, ts in FOUND.items() for t in ts])
def test_surrogates_keep_kind_and_layout(kind, text):
    (e,) = entities(text, NAMES)
    new = written(e, canonical("key", e.kind, e.normal, 0))
    assert new != text and new == written(e, canonical("key", e.kind, e.normal, 0)) != written(e, canonical("other", e.kind, e.normal, 0))
    assert new.isupper() == text.isupper() and new.islower() == text.islower()
    if kind == "phone":
        assert re.sub(r"\d", "0", new) == re.sub(r"\d", "0", text)
    if kind != "person":
        assert [x.kind for x in entities(new, NAMES)] == [kind]


def test_mentions_of_one_person_share_a_surrogate():
    new = [written(e, canonical("k", e.kind, e.normal, 0)) for t in ("Mara Quisby", "QUISBY, MARA", "Mara T. Quisby") for e in entities(t, NAMES)]
    given, family = new[0].split(" ")
    assert new[1:] == [f"{family}, {given}".upper(), f"{given} T. {family}"]


def test_names_are_learned_from_the_corpus(spark):
    texts = ["I met Mara Velt.", "Imani Velt came.", "Ask Oda Velt. Oda Velt.", "Blue Harbor. Blue Harbor.", None, ""]
    df, known = spark.createDataFrame([(t,) for t in texts], "t string"), spark.createDataFrame(KNOWN, "name_part string, part_kind string")
    whole, few = learn_names(df, "t", known), learn_names(df, "t", known, most=2)
    assert "velt" in whole.family and "oda" in whole.given and "blue" not in whole.given | whole.family
    assert few.rare is not None and len(few.given | few.family) <= 2
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [sorted(map(tuple, mentions(rows, "i", "t", n).collect())) for n in (whole, few)]
    assert got[0] == got[1] and {r[2] for r in got[0]} == {"Mara Velt", "Imani Velt", "Oda Velt"}


def test_collisions_are_drawn_again(spark, monkeypatch):
    rows = [("phone", f"+1617{n:04d}") for n in range(40)]
    monkeypatch.setattr(personal, "canonical", lambda key, kind, normal, attempt: canonical(key, kind, normal, attempt)[:5] + "000" if attempt == 0 else canonical(key, kind, normal, attempt))
    df = spark.createDataFrame(rows, "kind string, normal string")
    again = {(r.kind, r.normal): r.attempt for r in personal.collisions(df, "k").collect()}
    final = [personal.canonical("k", *r, again.get(r, 0)) for r in rows]
    assert again and len(set(final)) == 40 and not set(final) & {n for _, n in rows}


def test_redacted_tables(spark):
    known = spark.createDataFrame(KNOWN, "name_part string, part_kind string")
    text = "Write to Mara Quisby (mara@example.org), +49 30 23125 900.\nThanks, Mara Quisby"
    df = spark.createDataFrame([(1, text), (1, text), (2, None), (3, ""), (4, "x " * 200_000 + "mara@example.org")], "redacted_text int, t string")
    got = [r.redacted_text for r in redacted(df, "t", known).collect()]
    assert got.count(None) == 1 and got.count("") == 1 and len(got) == 5
    new = next(x for x in got if x and x.startswith("Write"))
    assert "Mara" not in new and re.fullmatch(r"Write to (\[person \w+ \w+\]) \((\[email \S+\])\), \[phone \+49[\d ]+\]\.\nThanks, \1", new)
    assert redacted(df.limit(0), "t", known).count() == 0
    bare = [r.redacted_text for r in redacted(df, "t", known, typed=False).collect()]
    assert any("[" not in x and "Mara" not in x for x in bare if x and x.startswith("Write"))
