"""Template deduction: classes against brute force, and what the template decides."""

import random
import time

import pytest

from fieldeval.llm import htmltext

PAGES = "page_id long, url string, html string"
SIDE = {
    "right-sidebar": "Side links and more",
    "cookie-bar": "We use cookies here",
    "user-comments-box": "Join the talk",
    "x7": "Our offices are closed on Sundays",
}


def page(k, layout=0, words=30):
    rnd = random.Random(k)
    text = " ".join(rnd.choices("stone river wind house water road tree light".split(), k=words))
    sides = "".join(f'<div class="{name}"><b>{layout}</b><p>{side}</p></div>' for name, side in SIDE.items())
    head = f'<div class="top{layout}"><p>Layout {layout} of us</p></div>'
    return f"<html><body>{head}<h1>Head {k}</h1><p>{text}</p>{sides}</body></html>", f"Head {k} {text}"


def extracted(spark, rows):
    found = htmltext.extract(spark.createDataFrame(rows, PAGES).repartition(3)).collect()
    return {r["page_id"]: r["text"] for r in found}


@pytest.mark.parametrize("n", [3, 5, 30])
def test_template_tells_boilerplate_without_telling_names(spark, n):
    rows, want = [], {}
    for k in range(n):
        source, want[k] = page(k)
        rows.append((k, f"http://h.example/{k}", source))
    assert extracted(spark, rows) == want


def test_several_layouts_of_a_host(spark):
    rows, want = [], {}
    for k in range(24):
        source, want[k] = page(k, k % 3)
        rows.append((k, f"http://h.example/{k}", source))
    assert extracted(spark, rows) == want


def test_two_pages_and_copies_are_no_template(spark):
    pair = [(k, f"http://two.example/{k}", page(k)[0]) for k in range(2)]
    article = "<html><body><h1>One</h1><p>The same long text on each of them.</p><p>Number {}</p></body></html>"
    copies = [(10 + k, f"http://copy.example/{k}", article.format(k)) for k in range(6)]
    got = extracted(spark, pair + copies)
    assert all("Side links" in got[k] for k in range(2))
    assert all(got[10 + k] == f"One The same long text on each of them. Number {k}" for k in range(6))


def test_shared_passage_in_articles_stays(spark):
    """A passage that a few articles of a host share is theirs."""
    passage = "This passage stands in all of them and belongs to each."
    rows = [
        (k, f"http://h.example/{k}", f"<body><div>Menu of ours</div><article><h1>{k}</h1><p>{page(k)[1]}</p><p>{passage}</p></article></body>")
        for k in range(6)
    ]
    assert extracted(spark, rows) == {k: f"{k} {page(k)[1]} {passage}" for k in range(6)}


def test_classes_are_the_plain_ones(spark):
    rnd = random.Random(3)
    rows = []
    for k in range(40):
        host = rnd.choice(["a.example", "b.example", "c.example"])
        rows.append((k, f"http://{host}/{k}", page(rnd.randrange(30), rnd.randrange(3), 5)[0]))
    hosted = htmltext._with_host(spark.createDataFrame(rows, PAGES))
    got = {}
    for r in htmltext.templates(hosted).collect():
        for token, name in zip(r["tokens"], r["classes"]):
            got.setdefault((r["host"], name), set()).add(token)
    want = set()
    for host in ("a.example", "b.example", "c.example"):
        pages = sorted({html for _, url, html in rows if f"//{host}/" in url})
        counts = [{} for _ in pages]
        for held, source in zip(counts, pages):
            for token in htmltext.parse(source).tokens:
                held[token] = held.get(token, 0) + 1
        vectors = {}
        for token in set().union(*counts):
            vectors.setdefault(tuple(held.get(token, 0) for held in counts), set()).add(token)
        for vector, tokens in vectors.items():
            on = sum(c > 0 for c in vector)
            if on >= htmltext.LEAST_PAGES and on >= htmltext.SUPPORT * len(pages) and len(tokens) >= htmltext.LEAST_TOKENS:
                want.add((host, frozenset(tokens)))
    assert {(host, frozenset(tokens)) for (host, _), tokens in got.items()} == want and len(want) > 6


@pytest.mark.parametrize(
    "source, text",
    [
        ('<div class="article-body"><p>Real text here</p></div><article class="teaser">Teaser</article>', "Real text here Teaser"),
        ("<h1><a>Title</a></h1><p>Text one</p><p><a>A sentence of a link</a></p>", "Title Text one A sentence of a link"),
        ("<ul><li><a>Home</a></li><li><a>News</a></li></ul><p>Text one</p>", "Text one"),
        ("<article><p>A long text of many words</p></article><div>Short rest</div>", "A long text of many words"),
    ],
)
def test_what_belongs_to_the_text(source, text):
    assert htmltext.main_text(htmltext.parse(source), set()) == text


def test_long_pages_parse_in_linear_time():
    for source in ("<div>" * 40_000 + "</b>" * 40_000, "<b>" * 40_000 + "<p>x" * 40_000, "<p><i>" * 20_000 + "</p>" * 40_000, "<li><b>" * 20_000):
        began = time.time()
        htmltext.parse(source)
        assert time.time() - began < 5
