import random
import time

import pytest
from conftest import rows
from pyspark.sql import functions as F

from chatlake.llm import markup


@pytest.mark.parametrize(
    "text, found",
    [
        ("<b>x</b>", ["html"]),
        ("<BR>", ["html"]),
        ("a &amp; b&#x2026;", ["html"]),
        ("<!-- c -->", ["html"]),
        ("<b\n class='x'>y</b>", ["html"]),
        ("<pre><code># a\n**b** [[c]] $x^2$</code></pre>", ["html"]),
        ("<pre>never closed **b**", ["html"]),
        ("## Head", ["markdown"]),
        ("Head\n====", ["markdown"]),
        ("- [x] done", ["markdown"]),
        ("> quoted", ["markdown"]),
        ("see [a](http://b.test/c)", ["markdown"]),
        ("![a](b.png)", ["markdown"]),
        ("a[^1]\n\n[^1]: b", ["markdown"]),
        ("[a][r]\n\n[r]: http://b.test", ["markdown"]),
        ("**a** and ~~b~~ *c*", ["markdown"]),
        ("use `a_b`", ["markdown"]),
        ("| a | b |\n|---|---:|\n| 1 | 2 |", ["markdown"]),
        ("```\n<b> \\cite{x} [[y]]", ["markdown"]),
        ("~~~\n== a ==\n~~~", ["markdown"]),
        ("1. a\n2. b", ["markdown"]),
        ("***", ["markdown"]),
        ("== Head ==", ["wiki"]),
        ("[[Page|label]]", ["wiki"]),
        ("{{quote|x}} ''y''", ["wiki"]),
        ("'''Bold''' word", ["wiki"]),
        ("{| class=wikitable\n! a\n|-\n| b\n|}", ["wiki"]),
        ("[http://a.test label]", ["wiki"]),
        ("\\section{A}\\label{b}", ["latex"]),
        ("\\begin{itemize}\n\\item a\n\\end{itemize}", ["latex"]),
        ("\\begin{verbatim}\n# a **b**\n\\end{verbatim}", ["latex"]),
        ("the value $x^2$ here", ["latex"]),
        ("\\( \\alpha \\) and \\[ a = b \\]", ["latex"]),
        ("$$a + b$$", ["latex"]),
        ("Let $v_1$ and <i>x</i>", ["html", "latex"]),
        # characters in their plain sense
        ("a < b and c > d", []),
        ("--input <file> --outdir <folder>", []),
        ("<3 and :-> are fine, ^_^ too", []),
        ("It costs $20 today and $19 tomorrow.", []),
        ("3 * 4 * 5 cm", []),
        ("C:\\notes\\suffix\\ is a path", []),
        ("set max_size_ok and a_b_c", []),
        ("[[1, 2], [3, 4]]", []),
        ("rows[0][1] == x", []),
        ("C# and F# and #442", []),
        ("Q&A and R&D", []),
        ("a == b, then b == c", []),
        ("mail <ann@b.test> now", []),
        ("$HOME/$USER", []),
        ("cat a | sort | uniq", []),
        ("call __init__ twice", []),
        ("", []),
    ],
)
def test_notations(text, found):
    assert markup.render(text)[1] == found


@pytest.mark.parametrize(
    "text, clean",
    [
        ("<p>One<p>Two<ul><li>a<li>b<ol><li>c</ol></ul>", "One\n\nTwo\n\n- a\n- b\n  1. c"),
        ("<table><tr><td>a<td>long<tr><td>bcd<td>x</table>", "a   | long\nbcd | x"),
        ("<h2>T</h2>x<script>var a</script><span hidden>h</span>&lt;", "## T\n\nx<"),
        ("<pre>  a\n  b</pre>", "```\n  a\n  b\n```"),
        ("a<br>b", "a\nb"),
        ("\\subsection{T}\n\\begin{enumerate}\n\\item a\n\\item b \\emph{c}\n\\end{enumerate}", "## T\n\n1. a\n2. b c"),
        ("See \\cite{k} $x_1$", "See $x_1$"),
        ("=== T ===\n[[A|b]] '''c''' [[Category:D]]", "### T\nb c"),
        ("{{quote|said}}", "said"),
        ("Head\n----\n[a](u) **b** `c`", "## Head\na b c"),
        ("```py\nx = 1", "```py\nx = 1\n```"),
        ("| a | b |\n|---|---|\n| cc | d |", "a  | b\ncc | d"),
        ("no markup  at\tall ", "no markup  at\tall "),
    ],
)
def test_clean_text(text, clean):
    assert markup.render(text)[0] == clean


def test_visible_words_survive():
    text = "<div>" * 500 + "deep" + "</div>" * 500
    assert markup.render(text)[0] == "deep"
    assert markup.render("</b></i>stray")[0] == "stray"


def test_found_and_clean(spark):
    m = spark.createDataFrame(
        [("a", "text", ["<b>x</b>", "**y**"], "k"), ("a", "text", ["<b>x</b>", "**y**"], "k"), ("b", "code", ["<b>x</b>"], "k"), ("c", None, [None, "plain", "$x^2$"], "k"), ("d", "text", None, "k"), (None, "text", ["''z'' it"], "k"), ("e", "text", [""], "k"), ("f", "text", ["word " * 20_000 + "<i>end</i>"], "k")],
        "node_id string, content_type string, parts array<string>, markup string",
    )
    assert rows(markup.markup_found(m)) == sorted([("a", "html"), ("a", "markdown"), ("c", "latex"), (None, "wiki"), ("f", "html")], key=repr)
    clean = rows(markup.clean_parts(m.where("node_id <> 'f'")), "node_id", "part_no", "text")
    assert clean == sorted([("a", 0, "x"), ("a", 0, "x"), ("a", 1, "y"), ("a", 1, "y"), ("b", 0, "<b>x</b>"), ("c", 1, "plain"), ("c", 2, "$x^2$"), ("e", 0, "")], key=repr)
    assert markup.markup_found(m.limit(0)).count() == 0


LONG = "a + b_1 " * 400


@pytest.mark.parametrize("formula", ["$$ x^2 $$", "$$ x $$", "$$\nE = mc^2\n$$", "$$\n\\frac{a}{b} = \\sqrt{c}\n$$", "$$ y \\text{ if $x$} $$", "\\[\nE = mc^2\n\\]", "\\[ a \\\\[2pt] b \\]", "\\\\[ a \\\\]", "\\(a\n+ b\\)", "$x_1 +\n\\frac{a}{b}$", f"$${LONG}$$", f"\\[{LONG}\\]", f"\\({LONG}\\)", f"${LONG}+ c$"])
def test_formulas_across_spaces_and_lines(formula):
    text = f"so {formula} holds"
    assert markup.render(text) == (text, ["latex"])
    assert markup.render(formula) == (formula, ["latex"])


@pytest.mark.parametrize("text", ["Sushi is $$ or, at noon, $$ again", "Sushi: $$\nPizza: $$", "costs $20\nand $19_x", "an open \\[ and no end", "an open $$ and no end"])
def test_prices_and_open_delimiters_are_no_formulas(text):
    assert markup.render(text) == (text, [])


@pytest.mark.parametrize("piece", ["\\[", "\\(", "\\\\[", "$$ a ", "$a_\n b", "\\begin{align}"])
def test_formula_scan_is_linear(piece):
    began = time.process_time()
    markup.Rendering().formulas(piece * 100_000)
    assert time.process_time() - began < 5


def test_prefilter_passes_all_that_is_reported(spark):
    r = random.Random(3)
    pieces = [">", ";", ":", "-", "--", "+", "*", "_", "=", "\n", "\n", " ", "\t", "a", "b c", "1.", "2)", "１.", "٣.", "'", "''", "~", "`", "#", "[", "]", "(", ")", "|", "\\", "$", "&amp;", "<b>", "\ue000", "\ue001", "\r\n"]
    texts = [">quoted words\nreply", "x\n>y", ";Term\n:Definition", "-- -", "１. a\n２. b", "''a''"]
    for _ in range(30_000):
        texts.append("".join(r.choice(pieces if r.random() < 0.7 else pieces[:18]) for _ in range(r.randint(1, 9))))
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    passed_over = [x.t for x in df.where(~F.col("t").rlike(markup.ANY_MARK)).collect()]
    assert len(passed_over) > 500 and [t for t in passed_over if markup.render(t)[1] or markup.render(t)[0] != t] == []


def test_quotes_and_definitions_without_blanks(spark):
    m = spark.createDataFrame([("a", "text", [">quoted words\nreply"]), ("b", "text", [";Term\n:Definition"])], "node_id string, content_type string, parts array<string>")
    assert rows(markup.markup_found(m)) == [("a", "markdown"), ("b", "wiki")]
    assert rows(markup.clean_parts(m), "node_id", "text") == [("a", "> quoted words\nreply"), ("b", "Term\n  Definition")]


@pytest.mark.parametrize(
    "text, clean",
    [
        ("- a\n  - b\n    1. c\n    2. d\n- e\n\nend", "- a\n  - b\n    1. c\n    2. d\n- e\n\nend"),
        ("3. a\n4. b\n\n- [x] c", "3. a\n4. b\n\n- [x] c"),
        ("> a\n> **b**\n\nc", "> a\n> b\n\nc"),
        ("| a | **bb** |\n|---|---|\n| cc | d |\nend", "a  | bb\ncc | d\nend"),
        ("\\begin{tabular}{ll}\n\\hline\na & bb \\\\\nccc & \\textbf{d} \\\\\n\\end{tabular}", "a   | bb\nccc | d"),
        ("\\begin{itemize}\n\\item a\n\\begin{enumerate}\n\\item b\n\\item c\n\\end{enumerate}\n\\item d\n\\end{itemize}", "- a\n  1. b\n  2. c\n- d"),
        ("{|\n! a !! bb\n|-\n| '''ccc''' || d\n|}", "a   | bb\nccc | d"),
        ("<ul><li>one<li>two **three**</ul>", "- one\n- two three"),
        ("\\textbf{a {b} c} \\emph{d}", "\\textbf{a {b} c} d"),
        ("\\href{u}{text} \\emph{\\textbf{x}}", "text x"),
        ("\\emph{never closed", "\\emph{never closed"),
    ],
)
def test_other_notations_go_through_the_tree(text, clean):
    assert markup.render(text)[0] == clean


def test_no_caps_on_length_or_nesting():
    formula = "\\frac{a}{b}+" * 900
    assert formula in markup.render(f"x \\[{formula}c\\] y")[0] and formula in markup.render(f"$${formula}c$$")[0]
    deep = markup.render("<ul><li>x" * 1000 + "<li>y")[0]
    assert deep.count("- x") == 1000 and deep.rstrip().endswith("- y")
    assert markup.render("<div>" * 5000 + "in")[0] == "in"
    assert markup.render("{{a|" * 10 + "x" + "}}" * 10) == ("", ["wiki"])
    assert markup.render("\\emph{" * 3000 + "x" + "}" * 3000)[0] == "x"
    assert markup.render("".join("  " * k + "- i\n" for k in range(60)))[0].count("- i") == 60
    assert markup.render("> " * 400 + "x")[0].endswith("x")


def test_every_notation_becomes_elements(monkeypatch):
    """Headings of all four notations come out of the one renderer."""
    seen = []
    real = markup.build_tree
    monkeypatch.setattr(markup, "build_tree", lambda text, r: seen.append(real(text, r)) or seen[-1])
    for text in ("# T", "== T ==", "\\section{T}", "<h1>T</h1>"):
        markup.render(text)
    assert [[c.name for c in t.children if not isinstance(c, str)][0] for t in seen] == ["h1", "h2", "h1", "h1"]
