import html
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from riskframe.llm import extraction, markup
from tests.conftest import SMALL

PAGE = """<!DOCTYPE html><html><head><title>T</title></head><body class="home"><header class="site"><h1>Site</h1></header>
<nav><ul><li><a>m1</a></ul></nav><div class="cookie-notice">We use cookies</div><main><article><header><h1 class="title">The &amp;
 Title</h1><p>by x</p></header><p>One <b>two</b>
 three<br>four<p>Five&nbsp;six &#8212; seven<ul><li>a<li>b</ul><table><tr><td>c1<td>c2</table><form><input value=1>no</form>
<div class="comments"><p>bad</p></div><aside>side</aside><!-- x > y --><script>if(a<b){"</p>"}</script>tail</article><p>outside</p></main>
<footer>f</footer></body></html>"""


def text_of(spark, rows):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, host string, part int")
    return {r["page_id"]: r for r in extraction.extract(pages).collect()}


def test_zones_and_blocks():
    assert [t for z, t in markup.blocks(PAGE) if z == markup.ARTICLE] == [
        "The & Title", "by x", "One two three four", "Five six — seven", "a", "b", "c1", "c2", "tail",
    ]
    assert [t for z, t in markup.blocks(PAGE) if z == markup.MAIN] == ["outside"]


@pytest.mark.parametrize(
    "page, expected",
    [
        (None, []),
        ("", []),
        ("plain &lt;text", ["plain <text"]),
        ("<p>a<p>b</div>c<b>d", ["a", "b", "c d".replace(" ", "")]),
        ("<p>cut in a tag<a href='x", ["cut in a tag"]),
        ("<p title='a > b'>q &am", ["q &am"]),
        ("<script>never closed <p>x", []),
        ("<!-- never closed <p>x", []),
        ("a<p hidden>b</p>c", ["a", "c"]),
    ],
)
def test_broken_markup(page, expected):
    assert [t for z, t in markup.blocks(page) if z == markup.OPEN] == expected


def test_boilerplate_of_a_host_goes_where_no_article_is_declared(spark):
    notice = "all rights reserved by the owner of this fine site since nineteen ninety five"
    rows = [(i, "http://h.example/%d" % i, f"<div>{notice} number{i} tail{i}</div><p>body of page {i} own{i}</p>", "", "", 1) for i in range(12)]
    rows += [(100, "http://h.example/a", f"<div>{notice}</div><article><p>{notice} x</p></article>", "", "", 1)]
    rows += [(101, None, f"<p>{notice}</p>", "", "", 1), (102, "not a url", None, None, None, None)]
    rows += [(103, "http://other.example/a", f"<p>{notice}</p>", "", "", 1), rows[0]]
    got = text_of(spark, rows)
    assert got[3]["text"] == "number3 tail3\nbody of page 3 own3"
    # on every page of the host, in and out of articles: boilerplate even inside one
    assert got[100]["text"] == "x"
    assert got[101]["text"] == notice and got[103]["text"] == notice
    assert got[102]["text"] == "" and got[102]["n_chars"] == 0


def test_copies_keep_their_text(spark):
    page = "<article><p>" + " ".join(f"w{i}" for i in range(60)) + "</p></article>"
    got = text_of(spark, [(i, "http://h.example/", page, "", "", 1) for i in range(40)])
    assert len(got) == 40 and {r["n_chars"] for r in got.values()} == {len(page) - 26}
    open_ = page.replace("article", "div")
    assert {r["n_chars"] for r in text_of(spark, [(i, "http://h/", open_, "", "", 1) for i in range(9)]).values()} == {len(page) - 26}


def test_hot_hosts_are_divided(spark, monkeypatch):
    monkeypatch.setattr(extraction, "TASK_BYTES", 2000)
    rows = [(i, "http://hot.example/", f"<article><p>text {i} of {i}</p></article>" + " " * 200, "", "", 1) for i in range(60)]
    got = text_of(spark, rows)
    assert {i: r["text"] for i, r in got.items()} == {i: f"text {i} of {i}" for i in range(60)}


def test_pages_of_the_smallest_tables_give_their_article(spark):
    got = {r["page_id"]: r for r in extraction.op7_html(spark, SMALL).collect()}
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        inner = re.search(r"<article>(.*?)(?:</article>|$)", p["html"], re.DOTALL)[1]
        lines = [" ".join(html.unescape(re.sub(r"</?b>|<br>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        assert got[p["page_id"]]["text"] == "\n".join(x for x in lines if x)
        assert got[p["page_id"]]["n_chars"] == len(got[p["page_id"]]["text"])


def test_empty_table(spark):
    assert text_of(spark, []) == {}


NOTICE = "all rights reserved by the owner of this fine site since nineteen ninety five"


def test_boilerplate_of_divided_hosts_and_of_their_neighbours_goes(spark, monkeypatch):
    rows = [
        (i, f"http://{'hot' if i < 60 else 'calm'}.example/{i}", f"<div>{NOTICE}</div><p>body of page {i} own{i}</p>", "", "", 1)
        for i in range(70)
    ]
    expected = {i: f"body of page {i} own{i}" for i in range(70)}
    assert {i: r["text"] for i, r in text_of(spark, rows).items()} == expected
    # parts of about one page each, and a calm host that fits a task
    monkeypatch.setattr(extraction, "TASK_BYTES", 140)
    assert {i: r["text"] for i, r in text_of(spark, rows).items()} == expected
    monkeypatch.setattr(extraction, "TASK_BYTES", 1500)
    assert {i: r["text"] for i, r in text_of(spark, rows).items()} == expected


def test_near_copies_of_an_article_keep_their_text(spark):
    words = [f"w{i}" for i in range(60)]
    texts = {i: " ".join([*words[:30], f"own{i}", *words[31:]]) for i in range(20)}
    got = text_of(spark, [(i, "http://h.example/", f"<article><p>{t}</p></article>", "", "", 1) for i, t in texts.items()])
    assert {i: r["text"] for i, r in got.items()} == texts


def test_short_furniture_goes_where_no_article_is_declared(spark):
    rows = [
        (i, "http://h.example/", f"<p>Home</p><p>About us</p><p>only {i}</p><p>body of page {i} own{i}</p><p>All rights reserved</p>", "", "", 1)
        for i in range(12)
    ]
    got = text_of(spark, rows)
    assert {i: r["text"] for i, r in got.items()} == {i: f"only {i}\nbody of page {i} own{i}" for i in range(12)}


@pytest.mark.parametrize(
    "page, expected",
    [
        ('<article style="overflow:hidden"><p>one</p></article>', ["one"]),
        ('<article data-topic="hidden gems"><p>one</p></article>', ["one"]),
        ('<article data-id="nav" data-class="menu" title="share"><p>one</p></article>', ["one"]),
        ('<article><section id="side-effects"><p>s</p></section><div class="social-history">h</div><p class="header-note">n</p></article>', ["s", "h", "n"]),
        ('<article id="nav-history" class="post menu"><p>z</p></article>', ["z"]),
        ('<article><p>text <span class="share">unclosed words</p><p>more</p></article>', ["text", "more"]),
        ("<article><header><p>Standfirst</p></header><p>b</p></article>", ["Standfirst", "b"]),
        ("<article><div class='post-header'><h2>t</h2></div><div class='share-buttons'>s</div><p>b</p></article>", ["t", "b"]),
        ("<article><p>body</p></article><section><h2>Comments</h2><article><p>bad</p></article></section>", ["body"]),
        ("<article><p>b</p><h3>3 comments</h3><p>bad</p></article><article><p>ok</p></article>", ["b", "ok"]),
        ("<article><h2>Comments</h2><p>bad</p><h2>Next part</h2><p>good</p></article>", ["Next part", "good"]),
        ("<article><h2>Comments on the law</h2><p>good</p></article>", ["Comments on the law", "good"]),
        ("<article hidden><p>x</p></article><article><p style='display: none'>x</p><p hidden=''>x</p><p>y</p></article>", ["y"]),
    ],
)
def test_attributes_names_and_comments(page, expected):
    assert [t for z, t in markup.blocks(page) if z == markup.ARTICLE] == expected


@pytest.mark.parametrize("name, gone", [("site-footer", True), ("cookie-notice", True), ("ads", True), ("nav-links", True), ("main_nav", True),
                                        ("advice", False), ("shareholder", False), ("side-effects", False), ("menuhin", False), ("commentary", False)])
def test_whole_names_tell_furniture(name, gone):
    assert markup.blocks(f"<div class='x {name}'>a</div>") == [(markup.CHROME if gone else markup.OPEN, "a")]


def test_repeated_runs_equal_brute_force():
    """Words covered by substrings of eight words or more that stand on enough pages of a host."""
    rng = random.Random(5)
    for trial in range(30):
        shared = [[f"s{rng.randrange(12)}" for _ in range(rng.randrange(6, 14))] for _ in range(3)]
        pages, hosts = [], []
        for _ in range(rng.randrange(2, 10)):
            page = []
            for _ in range(rng.randrange(1, 4)):
                own = [f"w{rng.randrange(4 + trial)}" for _ in range(rng.randrange(0, 10))]
                block = own + (rng.choice(shared) if rng.random() < 0.7 else []) + own[:2]
                if block:
                    page.append((markup.OPEN, block))
            pages.append(page)
            hosts.append(rng.randrange(2))
        hosts = np.array(hosts)
        where, whole = defaultdict(set), defaultdict(set)
        for p, page in enumerate(pages):
            for _, own in page:
                whole[hosts[p], tuple(own)].add(p)
                for i in range(len(own) - 7):
                    where[hosts[p], tuple(own[i : i + 8])].add(p)
        marks = extraction.boilerplate(hosts, pages)
        for p, page in enumerate(pages):
            often = lambda found: len(found) >= 3 and len(found) >= 0.3 * (hosts == hosts[p]).sum()  # noqa: B023, E731
            for (_, own), (mark, _) in zip(page, marks[p], strict=True):
                expected = [len(own) < 8 and often(whole[hosts[p], tuple(own)])] * len(own)
                for i in range(len(own) - 7):
                    if often(where[hosts[p], tuple(own[i : i + 8])]):
                        expected[i : i + 8] = [True] * 8
                assert list(mark) == expected


@pytest.mark.parametrize("shared", [200_000, 0])
def test_named_runs_reach_all_parts_either_way(spark, monkeypatch, shared):
    monkeypatch.setattr(extraction, "TASK_BYTES", 1500)
    monkeypatch.setattr(extraction, "SHARED_ROWS", shared)
    rows = [
        (i, f"http://{'hot' if i < 60 else 'calm'}.example/{i}", f"<div>{NOTICE}</div><p>body of page {i} own{i}</p>", "", "", 1)
        for i in range(70)
    ]
    assert {i: r["text"] for i, r in text_of(spark, rows).items()} == {i: f"body of page {i} own{i}" for i in range(70)}


def test_parts_are_shuffled_once(spark, monkeypatch):
    monkeypatch.setattr(extraction, "TASK_BYTES", 1500)
    rows = [(i, f"http://hot.example/{i}", f"<div>{NOTICE}</div><p>body of page {i} own{i}</p>", "", "", 1) for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, host string, part int")
    plan = extraction.extract(pages)._jdf.queryExecution().executedPlan().toString()
    # the one exchange left is that of the undivided hosts
    assert plan.count("Exchange hashpartitioning") == 1 and "MapInPandas" in plan
