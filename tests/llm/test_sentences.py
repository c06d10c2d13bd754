import time

from threadmill.llm import sentences as module
from threadmill.llm.sentences import Model, found, language, learn, quotations, sentences

SCHEMA = "doc_id bigint, text string, lang string"


def test_rare_but_significant_entries_are_kept(spark):
    text = "See the zorb. 10 of them are in the list."
    filler = [(10 + i, "And. " * 270_000, "en") for i in range(8)]  # two events of the word are less than a millionth of these
    df = spark.createDataFrame([(0, text, "en"), (1, text.replace("10", "11"), "en"), *filler], SCHEMA)
    model = learn(df)
    assert ("en", "zorb") in model.before_numbers
    assert [(r.sent_start, r.sent_end) for r in found(df.where("doc_id = 0"), model).collect()] == [(0, len(text))]


def test_joined_entries_give_the_same_sentences(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    whole, few = learn(df), learn(df, most=20)
    assert whole.rare is None and few.rare is not None
    assert sum(map(len, few.sets().values())) <= 20 < sum(map(len, whole.sets().values()))
    rows = lambda model: sorted(tuple(r) for r in found(df.unionByName(df.limit(3)), model).collect())
    assert rows(few) == rows(whole)


def test_languages_keep_statistics_of_their_own():
    assert language("The plan is in the cache and that was it.", None) == "en"
    assert language("El plan no es el que se usa para la cola.", "en") == "es"
    assert language("Il gatto dorme sul divano rosso vicino alla finestra", "it-IT") == "it"
    assert language("Kot śpi na czerwonej kanapie przy oknie", "PL") == "pl"
    assert language("The plan is in the cache and that was it.", "it") == "en"  # contradicted by the text
    assert language("Це дуже гарний план", "uk") == "uk" and language("Это очень хороший план", "en") == "ru"


def test_ellipses_go_on_where_what_follows_opens_no_sentence(spark):
    rows = [(i, "缓存已经清空……再试一次吧。日志里没有错误。" if i % 2 else "日志里没有错误。这个缓存需要清空。", "zh") for i in range(60)]
    rows += [(100 + i, "何もない…ログには何もない。ログには何もない。", "ja") for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    model = learn(df)
    assert ("zh", "再试") in model.continued and not any(k == "ja" for k, _ in model.continued)
    cut = lambda t, lang: [t[a:b] for a, b in sentences(t, lang, model)]
    assert cut(rows[1][1], "zh") == ["缓存已经清空……再试一次吧。", "日志里没有错误。"]
    assert cut("何もない…ログには何もない。", "ja") == ["何もない…", "ログには何もない。"]


def test_long_paragraphs_take_linear_time():
    for piece in ("see (a und b. ", "a.a.", "x. ", '"a. ', "e.g. the case. ", "“„«"):
        took = []
        for n in (20_000, 80_000):
            t = time.perf_counter()
            sentences(piece * (n // len(piece)), "en", Model())
            took.append(time.perf_counter() - t)
        assert took[1] < 12 * took[0] + 0.2, piece


def test_quotations_are_the_outermost():
    p = "a (b «c» [d) e] „f“ g"
    assert [p[a : b + 1] for a, b in quotations(p)] == ["(b «c» [d)", "„f“"]


def test_the_significance_test_decides(spark, monkeypatch):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    tested = learn(df)
    monkeypatch.setattr(module, "SIGNIFICANT", 1e9)
    none = learn(df)
    assert len(tested.starters) > 20 and not none.starters and not none.collocations and not none.before_numbers
    assert {w for _, w in none.abbreviations} < {w for _, w in tested.abbreviations}
    rows = lambda model: {tuple(r) for r in found(df, model).collect()}
    assert len(rows(tested) ^ rows(none)) > 500
