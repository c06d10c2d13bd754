import random
from itertools import product

import pytest

from threadmill.llm.markup import clean, cleaned, kinds, marked, minimum_cut

MARKED = {
    "# Title\n\ntext": ["markdown"],
    "Plan\n-----\ntext": ["markdown"],
    "a **b** and `c`": ["markdown"],
    "```html\n<div>{{ x }}</div>\n```": ["markdown"],
    "<pre><code>**a** \\textbf{b}</code></pre>": ["html"],
    "It&#8217;s &amp; so": ["html"],
    "one<br>two<br/>three": ["html"],
    "== Title ==\n'''a''' and ''b''": ["wiki"],
    "[[Category:Lock]] {{Note|x}}": ["wiki"],
    '{| class="wikitable"\n! a !! b\n|-\n| 1 || 2\n|}': ["wiki"],
    "h3. Title\n{code:java}\n# x\n{code}": ["wiki"],
    "The cost is $O(n \\log n)$ per run.": ["latex"],
    "\\begin{itemize}\n\\item one\n\\end{itemize}": ["latex"],
    "<b>x</b> and *y*": ["html", "markdown"],
}
PLAIN = [
    "Traceback says File <stdin>, line 82, in <module>.", "The field is a Map<String, List<Row>> now.", "It holds when a < 56 and b > 59.", "The plan costs $5 or $26 a month.", "We need x == 38 and y == 39 here.",
    "It matches *.py and __init__.py only.", "That is 2 * 25 * 4 bytes, and snake_case_name stays.", "It lives in C:\\temp\\new_table on that box.", "The test [[ -f $HOME/merge ]] is false there.", "Use config --force -v | tee log, then stop.",
    "The Q&A page lists issue #27 and #31.", "Pin x@76.2.1 and drop @consumer.cached from the class.", "", "  \n", None,
]


@pytest.mark.parametrize("text", MARKED)
def test_kinds(text):
    assert kinds(text) == MARKED[text]
    assert kinds(text.replace("\n", "\r\n")) == MARKED[text]


@pytest.mark.parametrize("text", PLAIN)
def test_plain_text_stays(text):
    assert kinds(text) == []
    assert clean(text) == text


def test_structure_is_kept():
    html = "<h2>A &amp; B</h2><ul><li>one</li><li>two</li></ul><p>It is $x^2$.</p><!-- no --><pre><code>a < b</code></pre>"
    assert clean(html) == "## A & B\n\n- one\n- two\n\nIt is $x^2$.\n\n```\na < b\n```"
    assert clean("== T ==\n* one\n[[a|b]] [[Category:x]]\n\nh2. U") == "## T\n- one\nb\n\n## U"
    assert clean("\\section{A}\n\\begin{itemize}\n\\item \\textbf{x}\n\\end{itemize}") == "# A\n\n- x"


def test_minimum_cut_equals_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        n = rng.randint(1, 7)
        source, sink = ([rng.randint(0, 9) for _ in range(n)] for _ in range(2))
        edges = [(rng.randrange(n), rng.randrange(n), rng.randint(0, 6)) for _ in range(rng.randint(0, 9))]
        edges = [e for e in edges if e[0] != e[1]]
        cost = lambda x: sum(b if on else a for on, a, b in zip(x, source, sink)) + sum(w for i, j, w in edges if x[i] != x[j])
        assert cost(minimum_cut(source, sink, edges)) == pytest.approx(min(map(cost, product([True, False], repeat=n))))


def test_a_weak_construct_follows_its_neighbours():
    assert kinds("| who | Please ask.") == kinds("| a | b |\n|---|---|\n| who | Please ask.") == ["markdown"]
    assert clean("__init__ is here") == "__init__ is here"


def test_tables_with_nulls_repeats_and_clashing_names(spark):
    rows = [("a", "# x", 1), ("a", "# x", 1), ("b", None, 2), ("c", "", 3), (None, "# y", 4), ("d", "<b>x</b> **y** " + "z" * 300_000, 5)]
    df = spark.createDataFrame(rows, "k string, t string, clean_text int")
    assert sorted(map(tuple, marked(df, "k", "t").collect())) == [("a", "markdown"), ("d", "html"), ("d", "markdown")]
    got = cleaned(df, "t").collect()
    assert len(got) == 6 and {r.k: r.clean_text for r in got}["b"] is None and got[0].clean_text == "# x"
    assert marked(df.limit(0), "k", "t").count() == 0
