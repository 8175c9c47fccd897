"""Text rules: hand-made cases and plain loops."""

import random
import re

from pyspark.sql import functions as F

from foliospark.functions import blocks as K
from foliospark.functions import markup, quality, text
from foliospark.schemas import BLOCKS


def test_runs(evaluate):
    assert evaluate(text.collapse_runs, ["a" * 13 + "b", "abc" * 5 + "X", "a" * 9, "ab\n" * 6]) == [
        "aaab", "abcabcabcX", "a" * 9, "ab\n" * 6]
    assert evaluate(text.collapse_punct, ["....., __ ------", "...."]) == ["..., __ ---", "...."]


def test_sequences_like_the_plain_pattern(evaluate):
    rng = random.Random(7)
    values = []
    for _ in range(300):
        s = ""
        for _ in range(rng.randint(1, 4)):
            unit = "".join(rng.choice("ab é.") for _ in range(rng.choice([1, 2, 3, 7, 8, 9, 40, 63, 64, 70])))
            s += unit * rng.randint(1, 7) + rng.choice(["", "\n", "x", "\n\n"])
        values.append(s)
    want = [re.sub(r"(.{2,})\1{4,}", r"\1\1\1", v) for v in values]
    assert evaluate(text.collapse_sequences, values) == want
    assert sum(a != b for a, b in zip(values, want)) > 50


def test_tags_and_math(evaluate):
    assert evaluate(text.collapse_tags, ["<td r=<td r=<td r=", "<b<b"]) == ["<td r=", "<b<b"]
    assert evaluate(text.math_to_latex, ['a <math display="block"> x </math>', "<math>y\n</math>"]) == [
        "a \n$$\nx\n$$\n", " $y$ "]


def loop_dedupe(value):
    out, last = [], None
    for line in re.split("\r\n|\n", value):
        if not line.strip():
            out.append(line)
            continue
        norm = line.lower().replace(" ", "")
        if norm in (last, "&-"):
            continue
        out.append(line)
        last = norm
    return "\n".join(out)


def test_line_dedupe(evaluate):
    assert evaluate(text.line_dedupe, ["A B\n\nab\n&-\nc\nC"]) == ["A B\n\nc"]
    rng = random.Random(3)
    values = ["\n".join(rng.choice(["a", "A ", "b", "", " ", "& -", "b\r"]) for _ in range(rng.randint(0, 12)))
              for _ in range(300)]
    assert evaluate(text.line_dedupe, values) == [loop_dedupe(v) for v in values]


def test_format_block(evaluate):
    one = lambda category, mode="reference": lambda c: text.format_block(F.lit(category), c, mode)
    assert evaluate(one("Formula"), ["$$x", " x "]) == ["$$x", "\n$$\nx\n$$\n"]
    assert evaluate(one("Table"), [" ..... "]) == ["....."]
    assert evaluate(one("Image"), ["a" * 12]) == ["aaa"]
    assert evaluate(one("Image", "intended"), ["a" * 12]) == ["a" * 12]
    assert evaluate(one("Text"), [None, ""]) == ["", ""]


def test_repetition(evaluate):
    digits = "".join(str(i) for i in range(700))
    values = ["ab" * 499, "ab" * 500, "x" * 500 + digits + "x" * 500, None, ""]
    assert evaluate(quality.is_repetitive, values) == [False, True, False, False, False]


def test_white_space_is_unicode(evaluate):
    from foliospark.functions.columns import is_blank, trimmed
    assert evaluate(trimmed, [" 　 a b  \x85"]) == ["a b"]
    assert evaluate(is_blank, [" 　", "", None, "​"]) == [True, True, True, False]


HTML = {
    "<h2> A </h2><p>b<br>c</p>": "## A\n\nb\nc",
    "<p>x <b>y</b> <i>z</i> <del>w</del> E=mc<sup>2</sup></p>": "x **y** *z* ~~w~~ E=mc^2^",
    '<a class="q" href="u"> t </a><img src="s" alt="d">': "[t](u)![d](s)",
    "<ul><li>a</li><li>b</li></ul>": "- a\n- b",
    "<ol><li>a</li><li>b</li></ol>c<ol><li>d</li></ol>": "1. a\n2. b\n\nc\n\n1. d",
    "<table><tr><th>h</th><th>k</th></tr><tr><td>1</td><td>2|3</td></tr></table>":
        "| h | k |\n| --- | --- |\n| 1 | 2\\|3 |",
    "<!-- c --><script>s()</script>a &lt;b&gt; &amp;amp;": "a <b> &amp;",
    '<input type="checkbox" checked> on <input type="checkbox"> off': "[x]  on [ ]  off",
    "<pre>a\n b</pre><code>k</code>": "```\na\n b\n```\n\n`k`",
    "<u>kept</u><hr>": "<u>kept</u>\n\n* * *",
}


HTML |= {
    "<ul><li>a<ul><li>b<ol><li>c</li><li>d</li></ol></li></ul></li><li>e</li></ul>":
        "- a\n    - b\n        1. c\n        2. d\n- e",
    "<table><caption>C</caption><tr><th colspan=2>h</th><th rowspan='2'>k</th></tr><tr><td>1<td>2</tr><tr><td>3</td></tr></table>":
        "C\n\n| h |  | k |\n| --- | --- | --- |\n| 1 | 2 |  |\n| 3 |  |  |",
    "<table><tr><td><table><tr><td>x</td><td>y</td></tr></table></td><td>a</td></tr></table>": "| x y | a |\n| --- | --- |",
    "<a href='u'>q</a> <a href=v>w</a> <a href='http://x.y'>x.y</a> <a>n</a> <a href='mailto:m'>m</a>":
        "[q](u) [w](v) http://x.y n m",
    "<pre><code>def f():\n    return 1 &lt; 2\n\n\n  x</code></pre>t": "```\ndef f():\n    return 1 < 2\n\n\n  x\n```\n\nt",
    "<pre>```</pre>": "````\n```\n````",
    "<p>x <math>a &lt; b<b></math> &eacute;&nbsp;&#x41; <img alt='x>y'></p>": "x <math>a &lt; b<b></math> é A ![x>y]()",
    "<p><b>open<br><p>next": "open\n\nnext",
    "<b>a <b>b</b></b> <i></i><h2>T<br>u</h2>": "**a b**\n\n## T u",
    "a < b > c <3 <x y": "a < b > c <3 <x y",
    "<ul><li><p>a</p><p>b</p></ul></ul>": "- a\n    b",
    "<li>lone</li><td>cell": "- lone\n\ncell",
    "</p></b></table>": "", "": "", "<table></table><ul></ul>": "",
}


def test_divisions_of_a_batch_are_made_in_slices():
    import pyarrow as pa
    held = []

    class Batch:  # an Arrow array that tells how many of its texts become Python strings at once
        def __init__(self, rows):
            self.rows = rows

        def __len__(self):
            return len(self.rows)

        def slice(self, at, n):
            return Batch(self.rows[at:at + n])

        def to_pylist(self):
            held.append(len(self.rows))
            return self.rows

    rows = [None if k % 7 == 0 else f"<div data-bbox='[1]' data-label='L'>{k}<div data-bbox='[2]'>x</div></div>" * (k % 3)
            for k in range(500)]
    got = markup.divisions.func(Batch(rows))
    assert got.to_pylist() == [None if t is None else [dict(zip(("box", "label", "inner"), d)) for d in markup.boxed_divisions(t)]
                               for t in rows]
    assert max(held) <= 100 and len(markup.divisions.func(pa.array([], pa.string()))) == 0


def test_entities_end_in_a_semicolon(evaluate):
    cases = {"<title>x&amp</title>": "<title>x&amp</title>", "&lt &lt; &ampx; &nosuch; &copy2024": "&lt < &ampx; &nosuch; &copy2024",
             "<a href='u?a=1&copy=2&amp;b=3'>t</a>": "[t](u?a=1&copy=2&b=3)", "&#233;&#xE9;&#233": "éé&#233"}
    assert evaluate(markup.html_to_markdown, list(cases)) == list(cases.values())


def test_html_to_markdown(evaluate):
    got = evaluate(markup.html_to_markdown, list(HTML))
    assert dict(zip(HTML, got)) == HTML


def test_markup_takes_odd_input(evaluate):
    deep = "<ul><li>" * 200 + "x"
    wide = "<table><tr>" + "<td colspan=99999 rowspan=0>x" * 3 + "</table>"
    got = evaluate(markup.html_to_markdown, [None, deep, wide, "<b>" * 5000 + "y", "<" * 5000])
    assert got[0] is None and got[1].endswith("- x") and got[2].count("x") == 3
    assert got[3:] == ["y", "<" * 5000]
    assert evaluate(markup.each_to_markdown, [["<p>a", None], [], None], "array<string>") == [["a", None], [], None]


def test_chandra_cleanup_order(evaluate):
    assert evaluate(markup.chandra_markdown, [
        '<p>A B</p><p>ab</p><math display="block">x</math>.......']) == ["A B\n\n\n\n$$\nx\n$$\n..."]


def blocks_of(spark, rows):
    return spark.createDataFrame([(rows,)], __import__("pyspark.sql.types", fromlist=["x"]).StructType().add("b", BLOCKS))


def test_page_markdown(spark):
    rows = [([1.0], "Title", " T "), (None, "Page-header", "H"), (None, "Text", "  "),
            (None, "Formula", "x"), (None, "Picture", "![image](data:...)"), (None, "Text", None)]
    df = blocks_of(spark, rows)
    r = df.select(K.dots_markdown(F.col("b")).alias("d"), K.dots_markdown(F.col("b"), True).alias("k"),
                  K.plain_markdown(F.col("b")).alias("p"), K.chandra_page_markdown(F.col("b")).alias("c"),
                  K.has_pictures(F.col("b")).alias("has")).first()
    assert r.d == "T\n\n\n$$\nx\n$$\n\n\n![image](data:...)"
    assert r.k.startswith("T\n\nH")
    assert r.p == " T \n\nH\n\n  \n\nx\n\n![image](data:...)\n\n"
    assert r.c == "T\n\nx\n\n![image](data:...)"
    assert r.has is True


def test_long_lines_collapse(evaluate):
    """A line of megabytes is read in memory linear in it, and a long unit in it is found."""
    import random
    rng = random.Random(6)
    noise = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=n))
    plain, unit = noise(3_000_000), noise(90)
    marked = noise(40_000) + unit * 7 + "|" + noise(40_000)
    got = evaluate(text.collapse_sequences, [plain, marked])
    assert got[0] == plain and got[1] == marked.replace(unit * 7, unit * 3)


def test_only_lines_with_repeats_meet_the_pattern(monkeypatch):
    """Lines of every kind, cut into small chunks, like the plain patterns; lines without repeats are not tried."""
    import pyarrow as pa
    from foliospark.functions import runs
    rng, values = random.Random(11), []
    for _ in range(300):
        s = ""
        for _ in range(rng.randint(0, 5)):
            letters = rng.choice(["ab é.", "abcdefghij klmn", "😀é\x85 \rx"])
            unit = "".join(rng.choice(letters) for _ in range(rng.choice([1, 2, 3, 9, 16, 33, 63, 64, 65, 70, 129, 200])))
            s += unit * rng.choice([1, 2, 4, 5, 6, 10, 11]) + rng.choice(["", "\n", "x", "\r\n"])
        values.append(rng.choice([s, s, s, None]))
    tried = []
    one = runs._sequences
    monkeypatch.setattr(runs, "_sequences", lambda line, bound: tried.append(line) or one(line, bound))
    for chunk in (64, 1000, runs.CHUNK):
        monkeypatch.setattr(runs, "CHUNK", chunk)
        got = runs.collapsed(pa.array(values, pa.string()), True).to_pylist()
        assert got == [v if v is None else re.sub(r"(.{2,})\1{4,}", r"\1\1\1", re.sub(r"(.)\1{9,}", r"\1\1\1", v)) for v in values]
    tried.clear()
    words = [f"word {i} of a line that holds the word {i % 7} again" for i in range(2000)]
    assert runs.collapsed(pa.array(words, pa.string()), True).to_pylist() == words and not tried


def test_html_and_repeats_in_one_projection(spark):
    df = spark.createDataFrame([(["<b>a</b>"], "x" * 12)], "h array<string>, t string")
    row = df.select(F.concat(markup.each_to_markdown("h")[0], text.collapse_runs(F.col("t"))).alias("x")).first()
    assert row.x == "**a**xxx"
