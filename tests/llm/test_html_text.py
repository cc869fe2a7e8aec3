import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from nodalis.llm.html_text import extract, text_of

CASES = [
    ("<p>a<p>b", "a\n\nb"),
    ("x<br>y<br/><br>z", "x\ny\n\nz"),
    ("<div>a</div>b<div>c<span> d </span> e</div>", "a\nb\nc d e"),
    ("<h1>T</h1>text  with \n space<h2>U</h2>", "T\n\ntext with space\n\nU"),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>after", "  * a\n  * b\n    * c\n  * d\n\nafter".replace("  * ", "* ", 1).replace("\n  * b", "\n* b").replace("\n  * d", "\n* d").replace("\n    * c", "\n  * c")),
    ("<ol start=9><li>a<li>b<li value=3>c</ol>", None),
    ("<head><title>no</title><style>p{}</style></head><script>1</script><p hidden>h</p><p style='display: none'>n</p><b>yes</b>", "yes"),
    ("<table><tr><th>Name<th>N<tr><td>alpha<td>1<tr><td>b<td>22</table>", "Name   N\nalpha  1\nb      22"),
    ("<table><tr><td colspan=2>wide cell here<td>x<tr><td>a<td>b<td>c</table>", "wide cell here  x\na  b            c"),
    ("<table><tr><td rowspan=2>r<td>1<tr><td>2</table>", "r  1\n   2"),
    ("<table><caption>Cap</caption><td>one<td><p>two<p>three</table>t", "Cap\none  two\n\n     three\n\nt"),
    ("<pre>\n a\n  b</pre>c", " a\n  b\n\nc"),
    ("a &amp; b&nbsp;c &lt;x&gt;", "a & b\xa0c <x>"),
    ("<details>hid<summary>sum</summary>more</details><details open>vis</details>", "sum\nvis"),
    ("<dl><dt>t<dd>d<dt>u<dd>e</dl>", "t\n  d\nu\n  e"),
    ("</p>x</b></div>y", "xy"),
    ("<select><option>a<option>b</select>", "a\nb"),
    ("<!-- c --><!DOCTYPE html>t<![CDATA[z]]>", None),
    ("", ""),
]


@pytest.mark.parametrize(("html", "text"), [c for c in CASES if c[1] is not None])
def test_layout(html, text):
    got = text_of(html)
    norm = lambda s: "\n".join(x.rstrip() for x in s.split("\n"))
    if html.startswith("<ul>"):
        assert [x.strip() for x in got.split("\n")] == ["* a", "* b", "* c", "* d", "", "after"]
        indents = [len(x) - len(x.lstrip()) for x in got.split("\n")[:4]]
        assert indents[0] == indents[1] == indents[3] < indents[2]
    else:
        assert norm(got) == norm(text)


def test_numbers():
    got = [x.strip() for x in text_of("<ol start=9><li>a<li>b<li value=3>c</ol>").split("\n")]
    assert got == ["9. a", "10. b", "3. c"]


def test_deep_and_long():
    assert text_of("<div>" * 50_000 + "x" + "</div>" * 50_000) == "x"
    assert text_of("<table><tr><td>" * 300 + "x") .strip() == "x"
    long = "<p>word " * 50_000
    assert text_of(long).count("word") == 50_000


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<table>", "</table>", "<tr>", "<td>", "</td>", "<li>", "<ul>", "</ul>", "<b>", "</b>", "<ol>", "<caption>", "</caption>", "<pre>", "</pre>", "<div>", "</div>", "w1", " w2 ", "<br>", "<select>", "<", "&", "<!", "<!--"]), max_size=25))
def test_no_visible_word_is_lost(parts):
    html = "".join(parts)
    if "<!" not in html and "<" not in [p for p in parts]:
        for w in ("w1", "w2"):
            assert text_of(html).count(w) == html.count(w)
    else:
        text_of(html)


def test_rows(spark):
    df = spark.createDataFrame([(1, "<p>a", "z"), (2, None, "z"), (3, "", None), (None, "<b>x", "z"), (1, "<p>a", "z")], "page_id long, html string, text string")
    assert [(r.page_id, r.text) for r in extract(df).collect()] == [(1, "a"), (2, None), (3, ""), (None, "x"), (1, "a")]
    assert extract(df.where("false")).count() == 0


@pytest.mark.parametrize("section", ["<![foo[x]]>", "<![x]>", "<![ endif]>", "<![>", "<![if !IE]>", "<![CDATA[x]]>", "<![foo\nbar>"])
def test_text_after_a_marked_section_stays(section):
    assert text_of(f"<p>before{section}after<p>more") == "beforeafter\n\nmore"


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<html><head><title>t</title>bare <b>bold</b>", "bare bold"),
        ("<head><meta charset=utf-8><title>t</title>\n<span>a</span> <a href=x>b</a>", "a b"),
        ("<head><style>p{}</style><script>1</script><noscript><link></noscript><template>no</template></head>x", "x"),
        ("<b style='backface-visibility: hidden'>shown</b><i style='color:red;/* c */ visibility: hidden'>not</i><u style=' display:none'>not</u>", "shown"),
        ("a<svg><title>t</title><defs><text>no</text></defs><path d=''/><text>one</text><text>two</text></svg>b", "a one two b"),
        ("<svg><defs/><text><![CDATA[a>b]]></text></svg>", "a>b"),
        ("<math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>no</annotation></math>", "x=1"),
        ("<desc>html</desc>", "html"),
    ],
)
def test_all_that_browsers_show(html, text):
    assert text_of(html) == text
