"""Article text of pages, folding and alignment of streams."""

import random
import re

import pytest

from foldwise.llm import wrappers

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body>
<header class="site"><h2>Site</h2></header><nav><ul><li><a href="/">Home</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div><aside>Side</aside>
<article class="post"><h1>Title {i} &amp; more</h1><p>First&nbsp;block <b>bold</b>{i}
 with   space<br>after break</p><p>Second &lt;block&gt; {i}<script>var x="<p>no</p>";</script>
<form><input><button>Send</button></form><div class="advert">Buy</div>
<ul><li>one {i}<li>two {i}</ul><!-- hidden --><section id="comments"><p>Nice!</p></section></article>
<footer>&copy; Site</footer></body></html>"""
EXPECTED = ("Title {i} & more\n\nFirst block bold{i} with space after break\n\n"
            "Second <block> {i}\n\none {i}\n\ntwo {i}")
DIVS = ("<html><body><div id=menu><a>Home</a></div><div class='content'><h1>Head {i}</h1>"
        "<p>Text {i}</p></div><div class=box><p>Same words on all pages</p></div></body></html>")
SCHEMA = "page_id bigint, url string, html string, host string, text string, blocks int"


def extract(spark, rows):
    df = spark.createDataFrame([(*r, "h", "t", 1) for r in rows], SCHEMA).repartition(3)
    return {r["page_id"]: r["text"] for r in wrappers.extracted(df).collect()}


def test_articles(spark):
    rows = [(i, f"https://a.example/{i}", PAGE.format(i=i)) for i in range(8)]
    rows += [(100 + i, f"http://b.example:80/{i}", DIVS.format(i=i)) for i in range(8)]
    got = extract(spark, rows)
    assert all(got[i] == EXPECTED.format(i=i) for i in range(8))
    assert all(got[100 + i] == f"Head {i}\n\nText {i}" for i in range(8))


def test_odd_rows(spark):
    rows = [(1, None, None), (2, "", ""), (3, "x", "only text"), (4, "http://c/", "<p>a<p>b<br>c"),
            (5, "http://c/", "<article><p>open <b>bold"), (6, "http://c/", "<"), (None, None, "<p>n"),
            (7, "http://c/", "<article><p>" + "long " * 50_000 + "</article>"),
            (8, "http://c/", "<!-- <p>never"), (9, "http://c/", "<script>x"),
            (10, "http://d/", "<p>twice</p>"), (10, "http://d/", "<p>twice</p>")]
    got = extract(spark, rows)
    assert got[1] == got[2] == got[6].replace("<", "") == got[8] == got[9] == ""
    assert got[3] == "only text" and got[4] == "a\n\nb c" and got[5] == "open bold"
    assert got[None] == "n" and got[10] == "twice"
    assert got[7] == ("long " * 50_000).strip()
    assert extract(spark, rows[:0]) == {}


def test_classes_of_the_page_are_no_notice():
    page = "<body class='sidebar-right has-comments'><main class=social><p>Kept</p></main></body>"
    assert [t for _, t in wrappers.main_blocks(page, True)] == ["Kept"]


def test_copies_are_no_notice(spark):
    """Pages that are all alike keep their text."""
    rows = [(i, "http://e/", "<article><p>the same article</p></article>") for i in range(9)]
    assert set(extract(spark, rows).values()) == {"the same article"}


@pytest.mark.parametrize("around", ["article", "div"])
def test_versions_and_standing_headings_are_no_notices(spark, around):
    """Versions of one article keep what they share; copies of a page don't make notices."""
    page = ("<body><div class=box><p>Standing box</p></div><{a}><h1>Title</h1><p>Shared text</p>"
            "<h2>Ingredients</h2><p>Version {i}</p></{a}></body>")
    rows = [(i, "http://f/", page.format(a=around, i=i)) for i in range(10)]
    rows += [(20 + i, "http://g/", f"<body><div><p>Said {i // 9}</p></div><section><p>Once</p>"
              "</section></body>") for i in range(10)]
    got = extract(spark, rows)
    assert all(got[i] == f"Title\n\nShared text\n\nIngredients\n\nVersion {i}" for i in range(10))
    assert all(got[20 + i] == f"Said {i // 9}\n\nOnce" for i in range(10))


@pytest.mark.parametrize("items, expected", [
    (["<a", ">a", "<a", ">a", "<a", ">a"], [["+", ["<a", ">a"]]]),
    (["#", "#"], ["#"]), ([], []), (["<a", "<b"], ["<a", "<b"])])
def test_folded(items, expected):
    assert wrappers.folded(items) == expected


def test_aligned():
    a, b = ["<x", "#", ">x", "<y", ">y"], ["<x", "#", ">x", "<z", ">z", "<y", ">y"]
    assert wrappers.aligned(a, b) == ["<x", "#", ">x", ["?", ["<z", ">z"]], "<y", ">y"]
    assert wrappers.aligned(wrappers.aligned(a, b), a) == wrappers.aligned(a, b)
    many = wrappers.folded(["<x", ">x", "<x", ">x"])
    assert wrappers.aligned(["<u", *many], ["<u"]) == ["<u", ["?", many]]


INSIDE = """<html><body><nav><a>Home</a></nav><article><h1>Title {i}</h1>
<div class='share-price'><p>Price {i}</p></div><div class='related-work'><p>Work of {i}</p></div>
<p class='alert-level'>Level {i}</p><table class='signup-stats'><tr><td>Stat {i}</td></tr></table>
<div class='related-work share-note'><p>Note on all pages</p></div>
<section class='comments comment-list'><p>I like {i}</p></section><p>End {i}</p></article></body></html>"""


@pytest.mark.parametrize("pages", [1, 2, 4, 5, 9])
def test_class_words_inside_an_article(spark, pages):
    """Telling words among others drop nothing by themselves; text of the wrapper then goes."""
    got = extract(spark, [(i, "http://h/", INSIDE.format(i=i)) for i in range(pages)])
    note = "Note on all pages\n\n" if pages == 1 else ""
    assert all(got[i] == f"Title {i}\n\nPrice {i}\n\nWork of {i}\n\nLevel {i}\n\nStat {i}\n\n"
               f"{note}End {i}" for i in range(pages))


NEUTRAL = """<html><body><div class=ka><ul>{links}</ul></div><div class=kb><p>Fixed words</p></div>
<div class=kc><h2>Head {i}</h2><p>Body <a href=x>link {i}</a> of {i}</p><p>{i} more</p></div>
<div class=kd><div class=ke><a href=y>See {i}</a></div><div class=ke><a href=z>And {i}</a></div></div>
</body></html>"""


@pytest.mark.parametrize("pages", [2, 4, 5, 30])
def test_the_wrapper_alone_decides(spark, pages):
    """Neutral tags and classes: menus and fixed text are told by slots and groups, whatever
    the number of pages."""
    rows = [(i, "http://n/", NEUTRAL.format(i=i, links="".join(
        f"<li><a href=/{k}>Link {k} {i}</a></li>" for k in range(2 + i % 3)))) for i in range(pages)]
    got = extract(spark, rows)
    assert all(got[i] == f"Head {i}\n\nBody link {i} of {i}\n\n{i} more" for i in range(pages))


def test_one_page_has_no_wrapper_to_speak_of(spark):
    got = extract(spark, [(0, "http://o/", NEUTRAL.format(i=0, links="<li><a>L</a></li>"))])
    assert got[0].startswith("L\n\nFixed words\n\nHead 0")


def pattern(items):
    """A wrapper as a regular expression over tokens that end in a line feed."""
    out = ""
    for item in items:
        if isinstance(item, list):
            out += f"(?:{pattern(item[1])}){item[0]}"
        elif item in ("#", "@"):
            out += "(?:[#@]\n)+" if item == "#" else "(?:@\n)+"
        else:
            out += re.escape(item) + "\n"
    return out


def spread(items, rng):
    """Tokens that folded items stand for, with some number of repeats."""
    for item in items:
        if isinstance(item, list):
            for _ in range(rng.randint(1, 3)):
                yield from spread(item[1], rng)
        else:
            yield item


def test_every_stream_matches_its_wrapper():
    """Brute force: a wrapper, read as a regular expression, matches all that it was made of."""
    rng = random.Random(1)
    parts = ["<p>{}</p>", "<ul><li>{}<li>{}</ul>", "<div class=c><h3>{}</h3><p>{}</p></div>",
             "<a href=x>{}</a>", "<section><p>{}</p><p>{}</p></section>"]
    for _ in range(60):
        pages = ["<body>" + "".join(rng.choice(parts).format("x", "y")
                                    for _ in range(rng.randint(0, 7))) + "</body>"
                 for _ in range(rng.randint(2, 6))]
        streams = [wrappers.stream(p) for p in pages]
        wrapper = streams[0]
        for s in streams[1:]:
            wrapper = wrappers.aligned(wrapper, s)
        match = re.compile(pattern(wrapper)).fullmatch
        for s in streams:
            assert match("".join(t + "\n" for t in spread(s, rng))), (wrapper, s)


def test_menus_are_repeated_links():
    page = ("<ul class=m><li><a>One</a><li><a>Two</a></ul><ul class=t><li><a>One</a> and more"
            "<li><a>Two</a></ul><p><a>Alone</a></p>")
    assert wrappers.menus(wrappers.stream(page)) == {("ul class=m", "li")}


def test_merging_in_rounds(spark, monkeypatch):
    """Many streams of one host need several rounds and give one wrapper."""
    monkeypatch.setattr(wrappers, "FAN_IN", 2)
    rows = [("h", f"<body><div class=a{'' if i % 2 else 'b'}><p>x</p></div>" + "<hr><h2>y</h2>" * (i % 3)
             + "".join(f"<div class=q{chr(97 + j)}><p>z</p></div>" for j in range(8) if i >> j & 1))
            for i in range(20)]
    found = wrappers.wrappers(spark.createDataFrame(rows, "host string, html string")).collect()
    assert len(found) == 1 and found[0]["host"] == "h"
