"""Blocks of the parser, held-out labelled pages, and the tables' pages by their mark-up."""

import html
import os
import re

import duckdb
import numpy as np
import pytest

from tessera.llm import pages
from tessera.llm.page_samples import PAGES, Maker

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model():
    return pages.train()


def texts(x):
    return [b.text for b in pages.blocks(x)]


def test_blocks():
    assert texts("<p>a  b\n c<p>d<br>e &amp; f&nbsp;g</div>h") == ["a b c", "d e & f g", "h"]
    assert texts("<ul><li>x<li>y <b>z</ul><table><tr><td>1<td>2</table>") == ["x", "y z", "1", "2"]
    assert texts("<script>var t='</p>';</script><style>p{}</style><!-- no --><p>yes</p>") == ["yes"]
    assert texts("<head><title>no</title></head>plain &lt;text&gt;") == ["plain <text>"]
    assert texts("") == texts(None) == []
    assert texts("<p") == [] or texts("<p") == ["<p"]
    inner = pages.blocks("<article class='Post x'><p><b>a</p><p>b</p></article><p>c")
    assert [[t for t, _ in b.path] for b in inner] == [["article", "p"], ["article", "p"], ["p"]]


def test_end_tags_of_head_and_body_may_be_left_out(model):
    prose = "Long ago the river ran through the valley, and people lived there. They had many goats, and they sang."
    for head in ("<head><meta charset=utf-8><title>no</title><style>p{}</style><script>var x;</script>", "<head><title>no</title><link rel=x>", "<title>no</title>", "<head>"):
        for body in ("<body>", ""):
            page = f"<!DOCTYPE html><html>{head}{body}<article><h1>The river</h1><p>{prose}<p>{prose}</article>"
            assert texts(page) == ["The river", prose, prose]
            assert pages.main_text(model, page) == f"The river\n{prose}\n{prose}"
    assert texts("<head><title>no</title><body>plain") == ["plain"]


def test_formulas_and_inner_text_of_media_are_kept(model):
    assert texts("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p>") == ["so x=2 holds"]
    for tag in ("object", "audio", "video", "canvas"):
        assert texts(f"<p>see <{tag}>the <b>other</b> text</{tag}> here</p>") == ["see the other text here"]
    prose = "Long ago the river ran through the valley, and people lived there. They had many goats, and they sang."
    assert pages.main_text(model, f"<body><article><p>{prose} <math><mi>x</mi></math></p><object><p>{prose}</p></object></article>") == f"{prose} x\n{prose}"


def test_all_ancestors_and_the_whole_text_count(model):
    prose = "Long ago the river ran through the valley, and people lived there. They had many goats, and they sang."
    deep, shut = "<div>" * 20, "</div>" * 20
    page = f"""<body><main><article>{deep}<h1>The river</h1><p>{prose}</p><p>{prose} {prose}</p>{shut}</article></main>
      <aside class="sidebar related">{deep}<p>{prose} Aside.</p><p>{prose} {prose}</p>{shut}</aside>
      <section id="comments"><div class="comment">{deep}<p>{prose} Comment.</p>{shut}</div></section><footer>{deep}<p>{prose} Footer.</p>{shut}</footer></body>"""
    assert pages.main_text(model, page) == f"The river\n{prose}\n{prose} {prose}"
    names = {pages._hash(f"name {w}") for w in ("sidebar", "related")} | {pages._hash("in aside")}
    block = next(b for b in pages.blocks(page) if b.text.endswith("Aside."))
    assert names <= set(pages._path_features(block.path))

    def real(text):
        return pages.features([pages.Block(text, 0, (("p", ""),))])[2][0]

    long = "7 " * 300 + "A" * 300 + "ÄÖ٣" + ". Some words; and more, of them. " * 200
    want = [sum(c in ".,;:!?" for c in long) / len(long) * 5, sum(map(str.isupper, long)) / len(long), sum(map(str.isdigit, long)) / len(long)]
    assert np.allclose(real(long)[[3, 5, 6]], want)
    words = [f"w{c}ord" + c * 3 for c in "abcdefghijklm"]
    found = pages.features([pages.Block(" ".join(words), 0, (("p", ""),))])[0]
    assert len(" ".join(words)) <= 120 and {pages._hash(f"word {w}") for w in words} <= set(found.tolist())


def test_held_out_pages(model):
    right = total = 0
    for seed in range(PAGES + 1000, PAGES + 1100):
        found, y = pages.labelled_blocks(Maker(seed).page())
        right += int((pages.labels(model, found) == np.array(y)).sum())
        total += len(y)
    assert right / total > 0.97


def test_common_layouts(model):
    prose = "Long ago the river ran through the valley, and people lived there. They had many goats, and they sang."
    page = f"""<html><body><header><a href=/>Site</a></header><div class="cookie-banner"><p>We use cookies.</p></div><nav><ul><li><a href=/a>Home</a></ul></nav>
      <main><h1>The river</h1><p>{prose}</p><div class="advert">Buy now</div><p>{prose} {prose}</p><form><p>Sign up</p><input></form></main>
      <aside class="sidebar"><p>Other stories</p></aside><section id="comments"><div class="comment"><p>{prose}</p></div></section><footer><p>&copy; 2024</p></footer>"""
    assert pages.main_text(model, page) == f"The river\n{prose}\n{prose} {prose}"


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
def test_pages_of_the_tables(spark, model):
    want = {}
    for i, h in duckdb.sql(f"SELECT page_id, html FROM '{SF}/pages.parquet'").fetchall():
        article = re.search(r"<article>(.*?)</article>", h, re.S).group(1).replace("<br>", " ")
        parts = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in re.split(r"</?(?:h1|p)>", article))
        want[i] = "\n".join(p for p in parts if p)
    got = {r.page_id: r.text for r in pages.extract(spark.read.parquet(f"{SF}/pages.parquet"), model).collect()}
    assert got.keys() == want.keys()
    assert sum(got[i] == want[i] for i in want) >= 0.98 * len(want)


def test_odd_rows(spark, model):
    rows = [(1, "u", None), (1, None, ""), (None, "u", "<p>"), (3, "u", "<nav><a href=/>Home</a></nav>"), (4, "u", "<article>" + "<p>Some words, many of them, go here again.</p>" * 20000 + "</article>"), (5, "u", "<<<>>&#0;&#xD800;&bogus;")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = pages.extract(df, model).collect()
    assert len(got) == len(rows) and all(r.text is not None for r in got)
    by = {r.page_id: r.text for r in got}
    assert by[1] == "" and by[3] == "" and by[4].count("\n") == 19999
    assert pages.extract(df.limit(0), model).count() == 0


def test_text_of_pictures_maps_and_noscript_stays():
    html = "<article><p>one</p><svg><text>two</text></svg><map><p>three</p></map><noscript><p>four</p></noscript><embed><p>five</p></article>"
    assert [b.text for b in pages.blocks(html)] == ["one", "two", "three", "four", "five"]


def test_features_kept_up_to_date_are_those_of_the_path():
    html = "<main id='m'>a<div class='x y'>b<p>c<ul><li class='x'>d<li>e</ul><div class='x'>f</div>g</p></div>h<p>i</main>j"
    found = pages.blocks(html)
    assert len(found) == 10
    for b in found:
        assert set(pages._path_features(b.path)) == set(pages._place_features(b.place) + b.above)


def test_deep_pages_cost_what_they_hold():
    import time

    began = time.time()
    deep = "<div><div class='a b'>x" * 25_000
    found = pages.blocks("<article><p>first</p>" + deep + "</article></section></div>" * 50)
    assert len(found) == 25_001 and len(found[-1].above) < 10
    unique = "".join(f"<div id='n{i}'>t" for i in range(3_000))
    assert len(pages.blocks(unique)[-1].above) <= pages.HASHED
    pages.features(found[:2000])
    assert time.time() - began < 20
