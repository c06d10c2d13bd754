import random
import string

import pytest
from tokenizers import Tokenizer

from threadmill.llm import tokens

FILE = f"{tokens.FOLDER}/byte_bpe_50k.json"
WORDS = {
    "letters": lambda r, n: "".join(r.choice(string.ascii_letters) for _ in range(n)),
    "two letters": lambda r, n: "".join(r.choice("ab") for _ in range(n)),
    "one letter": lambda r, n: "a" * n,
    "digits": lambda r, n: "".join(r.choice(string.digits) for _ in range(n)),
    "marks": lambda r, n: "".join(r.choice("=-#/*") for _ in range(n)),
    "blanks": lambda r, n: " " * n + "x",
    "unspaced": lambda r, n: "".join(r.choice("数据索引任务在凌晨失败了") for _ in range(n)),
    "long tokens": lambda r, n: "ÃÂ" * (n // 2) + "".join(r.choice("ÃÂ") for _ in range(40)),
    "natural": lambda r, n: "".join(r.choice(["the", "token", "ization", "report", "print", "embed", "download", "clone", "ing"]) for _ in range(n // 5)),
}


@pytest.fixture(scope="module")
def pair():
    return tokens.loaded(tokens.FOLDER, "byte_bpe_50k"), Tokenizer.from_file(FILE)


@pytest.mark.parametrize("kind", WORDS)
def test_long_words_equal_the_public_tokenizer(pair, kind):
    ours, theirs = pair
    rng = random.Random(2)
    texts = [WORDS[kind](rng, n) for n in (tokens.LONG - 1, tokens.LONG + 3, 900, 5000)]
    assert ours.encode(texts).to_pylist() == [theirs.encode(t, add_special_tokens=False).ids for t in texts]


def test_documents_equal_the_public_tokenizer(spark, pair):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}
    got = {r.doc_id: r.ids for r in tokens.encode(df, "doc_id", "text").collect()}
    assert got == {k: pair[1].encode(t, add_special_tokens=False).ids if t else [] for k, t in texts.items()}


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, " \n\t"), (3, " \n\t"), (None, "a\0b")], "doc_id bigint, text string")
    got = [(r.doc_id, len(r.ids)) for r in tokens.encode(df, "doc_id", "text").collect()]
    assert [n for k, n in got if k in (1, 2)] == [0, 0] and len(got) == 5
    assert tokens.encode(df.limit(0), "doc_id", "text").count() == 0
    assert [r.n for r in tokens.count_tokens(df, "text", "n").collect()] == [n for _, n in got]
