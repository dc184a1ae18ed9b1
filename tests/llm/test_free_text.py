"""Brute-force twins of op8 and op9."""

import random
import re
import time

import pytest

from coppice.llm import decontam, htmltext


def plain_distance(pattern, text):
    """Least distance of pattern to a substring, by the full table."""
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for k, p in enumerate(pattern):
            new.append(min(row[k] + (p != c), row[k + 1] + 1, new[k] + 1))
        row = new
        best = min(best, row[-1])
    return best


def test_myers_equals_table():
    rng = random.Random(5)
    for _ in range(200):
        a = "".join(rng.choice("ab c") for _ in range(rng.randint(1, 90)))
        b = "".join(rng.choice("ab c") for _ in range(rng.randint(0, 120)))
        assert decontam.myers(a, b)[0] == plain_distance(a, b)


def edited(rng, text, n):
    for _ in range(n):
        k = rng.randrange(len(text))
        text = rng.choice([text[:k] + "q" + text[k:], text[:k] + text[k + 1 :], text[:k] + "q" + text[k + 1 :]])
    return text


def test_pigeonhole_is_complete(spark):
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa", "theta"]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(k, say(rng.randint(3, 30))) for k in range(12)] + [(90, None), (91, ""), (92, "zz top")]
    docs = [(None, "zz  TOP"), (1000, None), (1001, ""), (1002, "zz"), (1003, "a zz top b zz top")]
    for k in range(60):
        item = rng.choice(items[:12])[1]
        docs.append((k, f"{say(20)}\n{edited(rng, item, rng.randint(0, len(item) // 9)).upper()}\t {say(20)}"))
    frame = spark.createDataFrame([(d, t, "en", "s", 1, 2) for d, t in docs], "doc_id bigint, text string, lang string, source string, n_chars bigint, item_id int")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.distance for r in decontam.matches(frame, bench).collect()}
    want = {}
    for d, t in docs:
        for i, x in items:
            if x and t:
                x = decontam.normalised(x)
                n = plain_distance(x, decontam.normalised(t))
                if n <= len(x) * 8 // 100:
                    want[d, i] = n
    assert got == want
    assert {r.doc_id for r in decontam.clean(frame, bench).collect()} == {d for d, _ in docs} - {d for d, _ in want}
    assert decontam.clean(frame, bench).columns == frame.columns
    assert decontam.matches(frame.where("false"), bench).count() == 0
    assert decontam.matches(frame, bench.where("false")).count() == 0


def test_blocks_of_items_give_the_same(spark, monkeypatch, sf_dir):
    docs, bench = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    once = sorted(decontam.matches(docs, bench).collect())
    monkeypatch.setattr(decontam, "BLOCK_CHARS", 2000)
    assert sorted(decontam.matches(docs, bench).collect()) == once and once


P = "This is a long enough paragraph, with commas, words and more words that make it count as text."
CASES = [
    (None, ""), ("", ""), ("   ", ""), ("plain words only", "plain words only"), ("<script>x</script>", ""),
    (f"<html><head><title>t</title></head><body><nav><a href=1>Home</a></nav><article><h1>T&amp;T</h1><p>{P}<p>b<br>c  \n d</article><footer>f</footer></body></html>", f"T&T\n{P}\nb c d"),
    (f"<body><div class=sidebar><p>{P}{P}</p></div><div id=main><h2>H</h2><p>{P}</p><ul><li>one<li>two</ul><p>{P}</p></div><section class='comments'><p>{P}</p></section></body>", f"H\n{P}\none\ntwo\n{P}"),
    (f"<body><div class='cookie-notice'>{P}</div><main><header><h1>Head</h1></header><p>{P}</p><aside>{P}</aside><form><p>{P}</p></form></main></body>", f"Head\n{P}"),
    (f"<div><p>{P}</p><p>cut &am", f"{P}\ncut &am"), (f"<article><p>{P}</p><p>cut<a hre", f"{P}\ncut"),
    (f"<article><p>{P}</p><style>p{{}}</style><script>var t='</p>';</script><!-- <p>no</p> --><p a='>'>yes</p></article>", f"{P}\nyes"),
    (f"<div class=content-with-sidebar><p>{P}</p></div>", P), ("<article>" + "<div>" * 3000 + P + "</div>" * 3000 + "</article>", P),
]


@pytest.mark.parametrize("html,want", CASES)
def test_main_text(html, want):
    assert htmltext.main_text(html) == want


def test_extract_whole_table(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    odd = spark.createDataFrame([(None, None, None), (1, "u", "<p>x</p>"), (1, "u", "<p>x</p>")], pages.schema)
    got = htmltext.extract(pages.unionByName(odd)).collect()
    assert len(got) == pages.count() + 3
    from html import unescape

    source = {r.page_id: r.html for r in pages.collect()}
    for r in got:
        assert r.n_chars == len(r.text)
        article = re.search(r"<article>(.*?)(?:</article>|\Z)", source.get(r.page_id) or "", re.S)
        if article and r.url != "u":
            flat = re.sub(r"<[^>]*\Z|</?b>", "", re.sub(r"</?(?:p|h1)>", "\n", article[1].replace("<br>", " ")))
            assert r.text == "\n".join(x for x in (" ".join(unescape(b).split()) for b in flat.split("\n")) if x)
    assert htmltext.extract(pages.where("false")).count() == 0
    clash = pages.selectExpr("*", "'x' as text", "1 as n_chars", "2 as at")
    assert htmltext.extract(clash).columns == ["page_id", "url", "at", "text", "n_chars"]


_TEXT = "This is a sentence of some length, with a comma or two, that reads like an article. "


@pytest.mark.parametrize("part", [
    f'<section id="discussion"><h2>Discussion</h2><p>{_TEXT * 3}</p><p>{_TEXT}</p></section>', '<h2 id="related-work">Related work</h2>', '<h3 id="form-and-function">Form</h3>',
    '<pre class="warning">x = 1</pre>', f'<div class="tags-and-scope"><p>{_TEXT}</p></div>', f'<div class="has-sidebar"><p>{_TEXT}</p></div>', '<header class="article-header"><h1>Title</h1></header>',
])
def test_article_parts_stay(part):
    html = f"<body><nav><a href=x>Menu</a></nav><article><p>{_TEXT * 2}</p>{part}<p>{_TEXT * 2}</p></article><footer>Foot.</footer></body>"
    inner = [" ".join(t.split()) for t in re.findall(r">([^<>]+)<", part)]
    assert htmltext.main_text(html) == "\n".join([(_TEXT * 2).strip(), *inner, (_TEXT * 2).strip()])


@pytest.mark.parametrize("part", [
    '<div class="sidebar"><p>Side text, with commas, and more.</p></div>', '<div class="notice">Please accept, or not.</div>', '<div class="related-box"><a href=x>One</a> <a href=y>Two</a></div>',
    f'<div id="comments"><h2>Comments</h2><p>{_TEXT * 3}</p></div>', '<form><p>Name, please</p></form>', '<aside><p>Aside, of course.</p></aside>', '<div class="ad-slot-1">Buy this.</div>',
    '<p class="social-bar"><a href=x>Share</a></p>', '<div hidden>Hidden.</div>', '<ul class="tags"><li>one</li><li>two</li></ul>',
])
def test_boilerplate_goes_wherever_it_stands(part):
    body = (_TEXT * 4).strip()
    assert htmltext.main_text(f"<body>{part}<article><p>{body}</p>{part}<p>{body}</p></article>{part}</body>") == f"{body}\n{body}"


def test_stories_of_several_parts():
    short, long = "A short closing remark.", (_TEXT * 4).strip()
    assert htmltext.main_text(f"<body><main><article><p>{long}</p></article><article><p>{short * 2}</p></article></main></body>") == f"{long}\n{short * 2}"
    assert htmltext.main_text(f"<div id=story><div>{short}</div><div><p>{long}</p><p>{long}</p></div><div>{short}</div></div>") == f"{short}\n{long}\n{long}\n{short}"
    assert htmltext.main_text(f'<body><div class=x>Foot</div><div class="part"><p>{long}</p></div><div class="part">{short}</div><div><a href=x>{short}</a></div></body>') == f"{long}\n{short}"
    nested = f"<article><p>{long}</p><article><p>{short}</p></article><blockquote><p>{short}</p></blockquote></article>"
    assert htmltext.main_text(nested) == f"{long}\n{short}\n{short}"


@pytest.mark.parametrize("tag", ["div", "b", "li", "p", "article", "td"])
def test_deep_pages_take_linear_time(tag):
    page = lambda n: f"<{tag}>some text, here" * n + "</i></ul>" * n
    took = []
    for n in (10_000, 40_000):
        start = time.perf_counter()
        htmltext.main_text(page(n))
        took.append(time.perf_counter() - start)
    assert took[1] < 10 * took[0] + 0.2


def test_short_articles_beside_longer_adverts():
    advert = "An advert of some length. " * 3
    assert htmltext.main_text(f'<body><div class="ad">{advert}</div><article><h1>T.</h1><p>T.</p></article></body>') == "T.\nT."
    assert htmltext.main_text(f'<body><div class="notice">{advert}</div><article><p>T.</p></article></body>') == "T."
    assert htmltext.main_text(f'<div class="content header"><main><p>{_TEXT}</p></main></div>') == _TEXT.strip()
    assert htmltext.main_text(f'<div id="discussion"><p>{_TEXT * 9}</p></div>') == (_TEXT * 9).strip()
