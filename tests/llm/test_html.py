import html
import random
import re
import time

import numpy as np

from loomline.llm import html_extract
from loomline.llm.html_extract import extract, main_text

SCHEMA = "html string, page_id long, url string, text int"
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{x:1}</style><script>var a = "<p>no</p>";</script></head><body>
<header class="site-header"><h2>Site</h2></header><nav><ul><li><a href="/a">A</a><li><a href="/b">B</a></ul></nav>
<div class="cookie-notice"><p>We use cookies on this site and would like you to agree to all of them now.</p></div>
<div id=content><article><h1>Head&amp;line</h1><p>First   <b>bold</b>ly &lt;said&gt; &eacute;.<br>Second line<p>Unclosed <i>para<p>Next &#x41; and more words of the article to read here.</article>
<div class="ad">Buy now!</div><section class="comments"><p>I do not agree with a long comment that has many words in it.</p></section></div>
<aside>Side</aside><form><label>Mail</label><input name=q></form><footer>&copy; me</footer></body></html>"""


def test_whole_page():
    assert main_text(PAGE) == "Head&line First boldly <said> é. Second line Unclosed para Next A and more words of the article to read here."


def test_without_article():
    text = PAGE.replace("<article>", "<div>").replace("</article>", "</div>")
    assert main_text(text) == main_text(PAGE)


def test_edges(spark):
    rows = [(PAGE, 1, "u", 0), (PAGE, 1, "u", 0), (None, 2, None, 0), ("", None, "x", 0), ("plain words", 3, "y", 0), ("<p>" + "word " * 50000, 4, "z", 0), ("<script>x", 5, "", 0)]
    got = [(r.page_id, r.text, r.n_chars) for r in extract(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert len(got) == 7 and all(len(t) == n for _, t, n in got)
    by = {k: t for k, t, _ in got}
    assert by[2] == by[None] == by[5] == "" and by[3] == "plain words" and len(by[4]) == 249999
    assert extract(spark.createDataFrame([], SCHEMA)).count() == 0


def test_given_pages(spark):
    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        inner = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        assert main_text(r.html) == " ".join(html.unescape(re.sub(r"<[^>]*>", " ", inner)).split())


def page(body):
    return f'<html><head><title>T</title></head><body><nav><a href="/a">A</a></nav>{body}<footer>me</footer></body></html>'


LONG, SHORT = "many words of a paragraph that is long " * 60, "A paragraph of its own with some words to read."


def test_one_very_long_paragraph():
    text = f"<div id=x><h1>Title</h1><p>{SHORT}</p><p>{LONG}</p><p>{SHORT}</p></div>"
    assert main_text(page(text)) == f"Title {SHORT} {LONG.strip()} {SHORT}"


def test_heading_and_last_section_outside_the_body_container():
    text = f"<div><h1>Title</h1><p>{SHORT}</p></div><div>{f'<p>{LONG[:400]}</p>' * 8}</div><section><p>{SHORT}</p></section>"
    assert main_text(page(text)) == " ".join(["Title", SHORT, *[LONG[:400].strip()] * 8, SHORT])


def test_linked_line_between_paragraphs():
    text = f"<div><p>{LONG}</p><p>Short.</p><p>Shorter.</p><p><a href=/r>See the whole report</a></p><p>Short.</p><p>Shorter.</p><p>{LONG}</p></div>"
    assert "See the whole report" in main_text(page(text))


def test_sibling_articles_are_kept_and_a_small_one_is_only_a_hint():
    two = f"<article><p>{LONG}</p></article><article><p>{SHORT} {LONG[:300]}</p></article>"
    assert main_text(page(two)) == f"{LONG.strip()} {SHORT} {LONG[:300].strip()}"
    small = f"<article><p>{SHORT}</p></article><div><p>{LONG}</p><p>{LONG}</p></div>"
    assert main_text(page(small)).count(LONG.strip()) == 2


def body(text, head=""):
    return f"<html><body><nav><a href=/a>A</a></nav>{head}{text}<footer>me</footer></body></html>"


def test_names_mark_boilerplate_only_as_a_whole():
    prose = f"<h1>Title</h1><p>{LONG}</p><p>{SHORT}</p>"
    want = f"Title {LONG.strip()} {SHORT}"
    for name in ("layout has-sidebar", "no-comments", "ad-free content", "notice-board", "post social-post"):
        assert main_text(body(f'<div class="{name}">{prose}</div>')) == want, name
    for name in ("sidebar", "ad", "site-header", "cookie-notice", "post-comments", "footer-links", "box related-posts"):
        assert main_text(body(f'<div>{prose}</div><div class="{name}"><p>{SHORT}</p></div>')) == want, name
    assert main_text(f"<body><form action=/x><div>{prose}<input name=q><select><option>no</select></div></form></body>") == want
    assert main_text(body(f"<article><header><h1>Title</h1></header><p>{LONG}</p><p>{SHORT}</p></article>", "<header><h2>Site</h2></header>")) == want


def test_levels_decide(monkeypatch):
    """With random levels most pages come out otherwise; a block of short lines is left out by its level alone."""
    rng = np.random.default_rng(2)
    plain = "".join(f"<p>{LONG[: 100 + 37 * k]}</p>" for k in range(12))
    links = "<div>" + "".join(f"<span>Go</span><br><b>to</b><br><i>{k}</i><br>" for k in range(9)) + "</div>"
    text = body(f"<div>{plain}</div>{links}")
    want = " ".join(LONG[: 100 + 37 * k].strip() for k in range(12))
    assert main_text(text) == want
    monkeypatch.setattr(html_extract, "smoothed", lambda x: rng.random(len(x)))
    assert sum(main_text(text) != want for _ in range(20)) > 10


def brute(html_text):
    """The method by its definition: every line has the set of its elements, and all sums are taken over all lines."""
    p = html_extract.Lines()
    p.feed(html_text)
    p.close()
    p.flush()

    def path(k):
        return set() if not k else {k} | path(p.parent[k])

    rows = [(t, tags, max(0, len(t) - linked), path(k)) for t, tags, linked, k in p.lines]
    lifted = set()
    while True:
        left = [r[3] & p.marked - lifted for r in rows]
        plain = [not r[3] & p.aside for r in rows]
        mass = {k: sum(r[2] for r, m, ok in zip(rows, left, plain, strict=True) if ok and m == {k}) for k in p.marked - lifted}
        free = sum(r[2] for r, m, ok in zip(rows, left, plain, strict=True) if ok and not m)
        named = any(ok and not m and r[3] & p.roots for r, m, ok in zip(rows, left, plain, strict=True))
        k = max(sorted(mass), key=lambda k: mass[k], default=0)
        if named or mass.get(k, 0) <= 4 * free:
            break
        lifted.add(k)
    free = [i for i in range(len(rows)) if plain[i] and not left[i]]
    if not free:
        return ""

    def held(ids):
        return sum(rows[i][2] for i in free if rows[i][3] & ids)

    roots = {k for k in p.roots if held({k})}
    if roots and 2 * held(roots) >= sum(rows[i][2] for i in free):
        inside = {k: {r for r in roots if r != k and k in path(r)} for k in roots}
        roots = {k for k in roots if not inside[k] or held(inside[k]) < 0.9 * held({k})}
    else:
        roots = set()
    scores = []
    for i, (_, tags, n, elements) in enumerate(rows):
        score = np.log1p(n / max(1, tags)) if i in free else 0.0
        if score and elements & p.headings:
            score += 1.0
        if i in free and roots:
            score = score + 1.5 if elements & roots else score * 0.3
        scores.append(score)
    kernel = {d: np.exp(-(d**2) / 2) for d in range(-2, 3)}
    last = len(rows) - 1
    level = np.array([sum(w * scores[min(max(i + d, 0), last)] for d, w in kernel.items()) / sum(kernel.values()) for i in range(len(rows))])
    high = min(level.std(), level.max())
    chosen = {i for i in free if level[i] >= high} or set(free)
    home = {i: max(rows[i][3] & p.containers, default=0) for i in free}
    for order in (free, free[::-1]):
        for before, i in zip(order, order[1:]):
            if before in chosen and level[i] >= 0.5 * high and (home[i] == home[before] or order is not free and rows[i][3] & p.headings):
                chosen.add(i)
    every = sum(rows[i][2] for i in free)
    for_text = {}
    for i in free:
        pieces = [k for k in rows[i][3] & p.pieces if 2 * held({k}) <= every]
        for_text[i] = max((k for k in rows[i][3] & p.containers if not any(x in path(k) for x in pieces)), default=0)
    for h in set(for_text.values()):
        own = [i for i in free if for_text[i] == h]
        if 2 * sum(rows[i][2] for i in own if i in chosen) > sum(rows[i][2] for i in own):
            chosen |= set(own)
    return " ".join(rows[i][0] for i in sorted(chosen))


def test_equals_brute_force(spark):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    rng = random.Random(4)
    tags = ["div", "p", "article", "main", "section", "table", "tr", "td", "ul", "li", "nav", "header", "h2", "a href=/x", "span", "b", "form", 'div class="sidebar"', 'div class="comments"', "footer", "br", "script", "article"]
    for _ in range(400):
        out, open_ = [], []
        for _ in range(rng.randint(1, 60)):
            x = rng.random()
            if x < 0.4:
                t = rng.choice(tags)
                out.append(f"<{t}>")
                open_.append(t.split()[0])
            elif x < 0.6 and open_:
                out.append(f"</{rng.choice(open_)}>")
            else:
                out.append("words " * rng.choice([1, 1, 2, 5, 30, 200]))
        pages.append("".join(out))
    assert len(pages) > 600
    for page_ in pages:
        assert main_text(page_) == brute(page_), page_[:200]


def test_time_is_in_proportion_to_elements():
    many = "<main>" + "<article><p>words of an article here</p></article>" * 10_000 + "</main>"
    began = time.perf_counter()
    assert main_text(many).count("article") == 10_000
    nested = "<div>some words" * 20_000
    assert main_text(nested).count("some") == 20_000
    assert time.perf_counter() - began < 10


def test_short_parts_of_an_article_are_kept():
    table = "<table>" + "".join(f"<tr><td>{i}</td><td>{i * i}</td></tr>" for i in range(10)) + "</table>"
    refs = "<ul>" + "".join(f"<li><a href=/r{i}>Reference {i}</a></li>" for i in range(8)) + "</ul>"
    got = main_text(body(f"<div><h1>Title</h1><p>{LONG}</p>{table}<p>{LONG}</p>{refs}</div><div><a href=/1>one</a> <a href=/2>two</a></div>"))
    assert got.startswith("Title") and "7 49 8 64" in got and got.endswith("Reference 7")
    assert main_text(body(f"<main><header><h1>Title</h1></header><p>{LONG}</p></main>", "<header><h2>Site</h2></header>")) == f"Title {LONG.strip()}"


def test_readers_texts_are_left_out():
    for name in ('id="disqus_thread"', 'class="user-reviews"', 'class="customer_reviews list"', 'id="giscus"', 'class="fb-comments"'):
        assert main_text(body(f"<div><p>{LONG}</p><p>{SHORT}</p></div><div {name}><p>{SHORT}</p><p>{LONG[:200]}</p></div>")) == f"{LONG.strip()} {SHORT}", name
    assert main_text(body(f'<div class="book-reviews"><p>{LONG}</p></div>')) == LONG.strip()
