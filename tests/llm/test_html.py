import time

import pytest

from gridtally.llm import html_text
from gridtally.llm.html_text import visible_text


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("", ""),
        ("plain &lt;b&gt; &amp;\n  text", "plain <b> & text"),
        ("<p>a<p>b<br>c<div>d <i>e</i>\n f</div>g", "a\n\nb\nc\n\nd e f\ng"),
        ("<title>t</title><script>x='</p>'</script><p>a<!-- no --> b<style>p{}</style>", "a b"),
        ("<head><meta><title>t</title><body>a", "a"),
        ("<ul><li>one<li>two<ul><li>in</ul></ul>after", "- one\n- two\n  - in\n\nafter"),
        ("<ol start=3><li>a<li value=9>b<li><p>c</p><p>d</p></ol>", "3. a\n9. b\n10. c\n\n    d"),
        ("<dl><dt>T<dd>one<dd>two</dl>", "T\n    one\n    two"),
        ("<blockquote>q<p>r</blockquote>", "    q\n\n    r"),
        ("<pre>\n a\n  b</pre>c", " a\n  b\n\nc"),
        ("<h1>H</h1>x<hr>y", "H\n\nx\n\ny"),
        ("<p hidden>no<p style='DISPLAY : none'>no<p>yes", "yes"),
        ("<style>.x, #y{color:red;display:none}</style><b class='z x'>no</b><i id=y>no</i>ok", "ok"),
        ("<div style='visibility:hidden'>no<b style='visibility:visible'>yes</b></div>", "yes"),
        ("<details><summary>S</summary>no</details><details open>yes</details>", "S\nyes"),
        ("<select><option>A<option selected>B</select><input value=v>", "B v"),
        ("<input type=submit value=Send><input type=HIDDEN value=x><input type=password value=x>ok", "Send ok"),
        ("a<input type=checkbox value=x><input><input value='' hidden><input value=x hidden>b", "ab"),
        ("<noscript>no</noscript><iframe>no</iframe><template>no</template>ok", "ok"),
        ("a < b > c </p></zz><b", "a < b > c <b"),
        ("<a title='x > y' href=it's>k</a>", "k"),
        ("<!-- open", ""),
        ("<script>never closed <p>x", ""),
        ("</br>x<br/>y", "x\ny"),
        ("<td>a<td>b", "a b"),
    ],
)
def test_layout(html, text):
    assert visible_text(html) == text


@pytest.mark.parametrize(
    ("css", "body", "text"),
    [
        ("@media print{nav,.side{display:none}}", "<nav>a</nav><b class=side>b</b>", "a\nb"),
        ("@media (max-width:600px){aside{display:none}}", "<aside>a</aside>", "a"),
        ("@media screen and (min-width:600px){aside{display:none}}", "<aside>a</aside>ok", "ok"),
        ("@media not print{b{display:none}}@media (400px<=width<=700px){i{display:none}}", "<b>x</b><i>a</i>", "a"),
        ("@media print{@media screen{b{display:none}}}b{color:red}", "<b>a</b>", "a"),
        ("@supports (display:grid){b{display:none}}@supports not (display:grid){i{display:none}}", "<b>x</b><i>a</i>", "a"),
        ("@keyframes k{from{display:none}}@font-face{src:url(a;b})}b{display:none}", "<b>x</b>ok", "ok"),
        ("@import 'x';.m{display:none} .m{display:block}", "<p class=m>a", "a"),
        (".m{display:none}", "<p class=m style='display:block'>a<p class=m>x", "a"),
        (".m{display:none!important}", "<p class=m style='display:block'>x</p>ok", "ok"),
        (".m{display:none;display:nonsense}", "<p class=m>x</p>ok", "ok"),
        ("#i{display:none}.m{display:block}", "<p class=m id=i>x</p>ok", "ok"),
        ("div.h{display:none}", "<div class=h>x</div><p class=h>a", "a"),
        (".a .b, .c>.d{display:none}", "<p class=b>a<p class=a><b class=b>x</b><i class=c><u><u class=d>b", "a\n\nb"),
        ("h1+p{display:none}i~u{display:none}", "<h1>a</h1><p>x</p><p>b<u>c</u><i>d</i><s>e</s><u>x", "a\n\nbcde"),
        ("b{visibility:hidden}b i{visibility:visible}", "<b>x<i>a</i></b>", "a"),
        (".h{visibility:hidden}", "<ul><li class=h>x<li>a</ul><table><tr class=h><td>x<tr><td>b</table>", "- a\n\nb"),
        (".sm\\:h{display:none}", "<b class=sm:h>x</b>ok", "ok"),
        ("[data-x='}'],a[href^=mailto i]{display:none}", "<b data-x='}'>x</b><a href=MAILTO:a>x</a>ok", "ok"),
        ("li:nth-child(2n+1):not(.k){display:none}", "<ul><li>x<li>a<li class=k>b</ul>", "- a\n- b"),
        ("b:hover,b::before{display:none}b:is(.x,.y){display:none}", "<b>a</b><b class=y>x</b>", "a"),
        (".p{.q{display:none}&.r{display:none}}", "<p class='p r'>x<p class=p>a<b class=q>x", "a"),
        ("@layer a,b;@layer b{i{display:inline}}@layer a{i{display:none}}", "<i>a</i>", "a"),
        ("p{display:block}", "<p hidden>a", "a"),
        ("table>tbody>tr>td.h{display:none}", "<table><tr><td>a<td class=h>x</table>", "a"),
        (".js .h{display:none}body>b{display:none}", "<html class=js><i class=h>x</i><b>x</b>ok", "ok"),
        ("/* b{ */ i{display:none /* } */} b{color:red}", "<b>a</b><i>x</i>", "a"),
        ("i{display:none", "<b>a</b><i>x</i>", "a"),
    ],
)
def test_style_sheets(css, body, text):
    assert visible_text(f"<style>{css}</style>{body}") == text


def test_style_elements_that_do_not_apply():
    rule = "b{display:none}"
    html = f"<style media=print>{rule}</style><noscript><style>{rule}</style></noscript>"
    assert visible_text(f"{html}<style type=text/less>{rule}</style><b>a</b>") == "a"
    assert visible_text(f"{html}<style media='all, print'>{rule}</style><b>x</b>ok") == "ok"


@pytest.mark.parametrize("css", ["{" * 5000, "}" * 9, ":not(" * 5000, "a{&" * 5000, "b " * 9999, "@media " + "(" * 5000, "url(" * 9999, "@layer" + "{@layer" * 999])
def test_broken_sheets_hide_nothing(css):
    assert visible_text(f"<style>{css}{{display:none}}</style><i>a</i>") == "a"


def test_tables_are_aligned():
    html = (
        "<table><caption>Cap</caption><tr><th>Name<th>N<th>Note"
        "<tr><td>Al<td>1<td>x<tr><td rowspan=2>日本<td>22<td>y<tr><td>333<td>z"
        "<tr><td colspan=3>over all columns</table>"
    )
    assert visible_text(html).split("\n") == [
        "Cap",
        "Name  N    Note",
        "Al    1    x",
        "日本  22   y",
        "      333  z",
        "over all columns",
    ]


def test_wide_cells_run_over():
    wide = "w" * 100
    lines = visible_text(f"<table><tr><td>{wide}<td>b<tr><td>c<td>d</table>").split("\n")
    assert lines == [f"{wide}  b", "c  d"]


def test_nested_table():
    html = "<table><tr><td>a<td><table><tr><td>x<td>y<tr><td>xx<td>z</table></table>"
    assert visible_text(html) == "a  x   y\n   xx  z"


def test_all_visible_words_are_kept_in_order():
    words = [f"w{i}" for i in range(2000)]
    tags = ["<p>", "<div>", "</div>", "<li>", "<b>", "</p>", "<tr>", "<ul>", "</ul>", " ", "<h2>"]
    html = "".join(f"{tags[(i * 7) % len(tags)]}{w} " for i, w in enumerate(words))
    text = visible_text(html)
    assert [w for w in text.split() if w.startswith("w")] == words


@pytest.mark.parametrize("depth", [300, 5_000, 100_000])
def test_deep_pages_hide_what_is_hidden(depth):
    html = "<div>" * depth + "<p style='display:none'>hidden</p><span style='display:none'>h2<b>x</b></span>shown"
    assert visible_text(html) == "shown"
    mixed = "<b>" * depth + "<template>no</template><i hidden>no</i>yes" + "</b>" * depth + "<p>behind"
    assert visible_text(mixed) == "yes\n\nbehind"


def test_deep_pages_take_linear_time():
    def seconds(depth):
        start = time.perf_counter()
        assert visible_text("<div><span>" * depth + "x" + "</span></q></div>" * depth) == "x"
        return time.perf_counter() - start

    seconds(100)
    assert seconds(32_000) < 16 * seconds(4_000) + 0.5


def test_column(spark):
    deep = "<div>" * 5000 + "deep" + "<table>" * 600 + "x"
    long = "<p>long text " * 20_000
    rows = [(1, None, "t"), (2, "", "t"), (None, deep, "t"), (4, long, "t"), (4, long, "t")]
    pages = spark.createDataFrame(rows, "page_id long, html string, text string")
    out = html_text.extract(pages)
    assert out.columns == pages.columns
    texts = [r.text for r in out.collect()]
    assert texts[:2] == [None, ""]
    assert texts[2].split() == ["deep", "x"]
    assert texts[3] == texts[4] and texts[3].count("long") == 20_000
    assert html_text.extract(pages.limit(0)).collect() == []
