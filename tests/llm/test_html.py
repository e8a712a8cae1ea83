import random
import re

import pytest

from cohortlens.llm import html, queries

CASES = {
    "": "",
    None: "",
    "plain   text\n here": "plain text here",
    "<p>one<p>two <b>bold</b>,<i> it</i></p>three": "one\n\ntwo bold, it\n\nthree",
    "a<br>b<br/>c": "a\nb\nc",
    "<ul><li>x<li>y<ul><li>z</ul><li>w</ul>": "- x\n- y\n  - z\n- w",
    "<ol start=3><li>x<li>y</ol>": "3. x\n4. y",
    "<table><tr><th>name<th>n<tr><td>long name<td>12</table>": "name       n\nlong name  12",
    "<table><tr><td colspan=2>wide cell here<td>c<tr><td>a<td>b<td>d</table>": "wide cell here  c\na  b            d",
    "<table><tr><td rowspan=2>a<td>b<tr><td>c</table>": "a  b\n   c",
    "<table><td>one<td>two": "one  two",
    "<div>a</div><div>b</div>": "a\nb",
    "<pre>  x\n   y\n</pre>z": "  x\n   y\n\nz",
    "<script>var a='<p>no</p>'</script><style>p{}</style>yes<!-- no -->": "yes",
    "<p hidden>no</p><p style='display: none'>no</p><p style='visibility:hidden'>no <b style='visibility:visible'>yes</b></p>": "yes",
    "<style>.ad, #x {display:none}</style><div class='a ad'>no</div><p id=x>no</p><p>yes</p>": "yes",
    "<details><summary>s</summary>no</details><details open><summary>t</summary>yes</details><dialog>no</dialog>": "s\nt\nyes",
    "<head><title>no</title><meta charset=x><body>yes": "yes",
    "<head><title>no</title><p>yes": "yes",
    "&lt;b&gt; &amp; &eacute;&nbsp;&middot; &#x41;": "<b> & é · A",
    "</div></p>x</b><b>y": "x y".replace(" ", ""),
    "<a href=x>one</a> <a href=y>two</a>": "one two",
    "<dl><dt>t<dd>d<dt>u<dd>e</dl>": "t\n  d\nu\n  e",
    "<blockquote>q<p>r</blockquote>s": "  q\n\n  r\n\ns",
    "<select><option>no</select><input type=submit value=go><input type=hidden value=no>": "go",
    "<h1>t</h1>x<hr>y": "t\n\nx\n\ny",
}


@pytest.mark.parametrize("markup", CASES)
def test_rendering(markup):
    assert html.visible_text(markup) == CASES[markup]


def test_deep_and_long_markup_keeps_its_text():
    assert html.visible_text("<div>" * 5000 + "in" + "</div>" * 5000).strip() == "in"
    assert html.visible_text("<ul><li>" * 3000 + "in").replace(" ", "").replace("-", "") == "in"
    assert html.visible_text("<p>word " * 3000).split() == ["word"] * 3000
    assert html.visible_text("<div>" * 500 + "<script>no</script>yes") == "yes"


def test_any_markup_is_rendered():
    rnd = random.Random(1)
    bits = ["<p>", "</p>", "<div>", "</div>", "<table>", "</table>", "<tr>", "<td>", "</td>", "<li>", "<ul>", "</ul>", "<b>", "</b>", "<a>", "</a>", "<h2>", "<br>", "<", ">", "&amp", "<!--", "-->", " ", "\n"]
    for _ in range(300):
        words = [f"w{i}" for i in range(6)]
        parts = words + rnd.choices([b for b in bits if b not in ("<", "<!--")], k=12)
        rnd.shuffle(parts)
        text = html.visible_text("".join(parts))
        assert sorted(re.findall(r"w\d", text)) == words


def test_dataframe(spark):
    df = spark.createDataFrame([(1, "<p>a", "x"), (1, "<p>a", "x"), (None, "b", "x"), (2, None, "x")], "page_id long, html string, text string")
    assert sorted(map(str, html.extracted(df).collect())) == sorted(["Row(page_id=1, text='a')"] * 2 + ["Row(page_id=None, text='b')", "Row(page_id=2, text='')"])
    assert html.extracted(df.limit(0)).collect() == []


def test_query(spark, sf_dir):
    out = {r.page_id: r.text for r in queries.op5_html_text(spark, sf_dir).collect()}
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    assert len(out) == len(pages)
    for r in pages:
        assert not re.search(r"track\(|margin:0|<p>", out[r.page_id])
        for word in re.findall(r"<p>([^<>&]+)</p>", r.html)[:3]:
            assert " ".join(word.split()) in out[r.page_id]


RULES = {
    "div p{display:none}": "<div><b><p>no</p></b></div><p>yes</p>",
    ".c>.d{display:none}": "<div class=c><i class=d>no</i><b><i class=d>yes</i></b></div>",
    ":is(p, #a){display:none}": "<p>no</p><div id=a>no</div><div>yes</div>",
    "div:not(.keep, [open]){display:none}": "<div>no</div><div class=keep>yes</div><div open>, too</div>",
    "p{display:none !IMPORTANT}": "<p style='display:block'>no</p>yes",
    "p{display:none!important} #a{display:block}": "<p id=a>no</p>yes",
    "#a{display:block} p{display:none}": "<p id=a>yes</p><p>no</p>",
    "p.x{display:block} .x{display:none}": "<p class=x>yes</p><b class=x>no</b>",
    "p{display:none} p{display:block}": "<p>yes</p>",
    "body > div, P.q{display:none}": "<div>no</div><p class=q>no</p><p><b>yes</b></p>",
    "[data-x='1'], a[href]{display:none}": "<p data-x=1>no</p><p data-x=2>yes</p><a href=u>no</a>",
    "p:hover, p + p, p::before, p:is(:hover){display:none}": "<p>yes</p><p>, too</p>",
    "div *{display:none} div b{display:inline}": "<div><b>yes</b><i>no</i></div>",
    "@layer l{#a{display:none}} p{display:block}": "<p id=a>yes</p>",
    "p{visibility:hidden} p b{visibility:visible}": "<p>no<b>yes</b></p>",
}


@pytest.mark.parametrize("sheet", RULES)
def test_selectors_and_cascade(sheet):
    body = RULES[sheet]
    shown = " ".join(html.visible_text(f"<style>{sheet}</style><body>{body}").split())
    assert "no" not in shown and "yes" in shown and ("too" in shown) == ("too" in body)


def test_inline_importance_and_list_values():
    assert html.visible_text("<p style='display:none!important;display:block'>no</p>yes") == "yes"
    assert html.visible_text("<ol><li>a<li value=5>b<li>c</ol>") == "1. a\n5. b\n6. c"


AT_RULES = {
    "@media print{.content{display:none}} @media (max-width:600px){nav{display:none}}": "nav\ncontent",
    "@media screen{nav{display:none}}": "content",
    "@media only screen and (min-width: 40em){nav{display:none}}": "content",
    "@media (400px <= width <= 700px){nav{display:none}}": "nav\ncontent",
    "@media (unknown: thing){nav{display:none}}": "nav\ncontent",
    "@media print{@media screen{nav{display:none}}} .content{display:none}": "nav",
    "@import url(x.css); nav{display:none}": "content",
    "@layer a{nav{display:none}} nav{display:block}": "nav\ncontent",
    "@supports not (display:grid){nav{display:none}}": "nav\ncontent",
    "nav{display:none; a{color:red}}": "content",
}


@pytest.mark.parametrize("css", AT_RULES)
def test_at_rules(css):
    assert html.visible_text(f"<style>{css}</style><nav>nav</nav><div class=content>content</div>") == AT_RULES[css]


SHOWN = {
    "<p>where <math><mi>x</mi><mo>=</mo><mn>1</mn><semantics><mi>y</mi><annotation>no</annotation></semantics></math> holds": "where x=1y holds",
    "<textarea>\n a <b>x</b> &amp;\n  c</textarea>z": " a <b>x</b> &\n  cz",
    "<select><option>no<option selected>yes<option>no</select> after": "yes after",
    "<select multiple><optgroup label=g><option>a<option label=b>no</optgroup><option hidden>no</select>": "g\na\nb",
    "<select size=2><option>a<option>b</select>": "a\nb",
    "<svg><title>no</title><defs><text>no</text></defs><path d=x/><g><text>one <tspan>two</tspan></text></g>no<text display=none>no</text><text>three<desc>no</desc></text></svg>end": "one two\nthree\nend",
    "<svg>" + "<path d=x/>" * 400 + "<text>yes</text></svg>": "yes",
    "<svg><switch><foreignObject><p>yes</p></foreignObject><text>no</text></switch></svg>": "yes",
    "<map name=m><p>inside</p><area href=x></map>": "inside",
    "<desc>yes</desc>": "yes",
    "<div>" * 500 + "<svg><text>yes</text></svg><textarea>a&lt;</textarea><select><option>no</select>": "yesa<",
    "<div>" * 147 + "<svg><g><g><g><text>yes</text></g></g></g></svg>": "yes",
    "<svg>" * 5000 + "<text>yes": "yes",
}


@pytest.mark.parametrize("markup", SHOWN, ids=range(len(SHOWN)))
def test_formulas_drawings_and_fields(markup):
    assert html.visible_text(markup).strip("\n") == SHOWN[markup]
