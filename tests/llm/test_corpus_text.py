"""Token counts, packing, language, quality and page text."""

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from fieldeval.llm import htmltext, langid, packing, quality, tokencount
from fieldeval.llm.tokens import SPECIAL, VOCABULARY, byte_bpe

DOCS = "doc_id long, text string"
SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(VOCABULARY)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab é\n\t 12.,'!ßn 漢😀"), max_size=60))
def test_ids_are_the_tokenizers_own(text):
    whole = Tokenizer.from_file(VOCABULARY)
    assert byte_bpe().ids(text) == whole.encode(text, add_special_tokens=False).ids


def test_special_string(plain):
    text = f"a {SPECIAL} b"
    assert byte_bpe().ids(text) == plain.encode(text, add_special_tokens=False).ids


def test_spans_and_attribution(plain):
    encoder = byte_bpe()
    lengths = tokencount.token_lengths(encoder)
    text = "Wörter 漢字 😀 and more\n\n\nline two."
    encoded = plain.encode(text, add_special_tokens=False)
    start, end = tokencount.token_spans(text, encoder.ids(text), lengths)
    assert list(zip(start.tolist(), end.tolist())) == encoded.offsets
    sections = [(0, 3), (3, 9), (12, 20)]
    for k, (low, high) in zip(tokencount.attribute(start, end, sections).tolist(), encoded.offsets):
        shared = [max(0, min(b, high) - max(a, low)) for a, b in sections]
        assert k == (shared.index(max(shared)) if max(shared) else -1)


def test_section_counts(spark, plain):
    rows = [(1, "one two\n\n\nthree four"), (2, None), (3, ""), (1, "one two\n\n\nthree four"), (4, "w " * 30_000)]
    got = tokencount.section_counts(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == 4 + 1 + 1 + 4 + 1
    first = sorted((r["section"], r["start"], r["end"], r["n_tokens"]) for r in got if r["doc_id"] == 1)[::2]
    assert [r[0] for r in first] == [0, 1, 2, 3] and first[0][1:3] == (0, 8) and first[3][1:3] == (10, 20)
    for doc_id, text in rows:
        mine = [r for r in got if r["doc_id"] == doc_id]
        total = len(plain.encode(text or "", add_special_tokens=False).ids)
        assert {r["doc_tokens"] for r in mine} == {total}
        assert sum(r["n_tokens"] for r in mine) in (total, 2 * total)
    assert tokencount.section_counts(spark.createDataFrame([], DOCS)).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=200), st.integers(1, 20))
def test_best_fit_is_the_plain_one(lengths, most):
    """Against a search through all open bins; the fullest one closes first."""
    bins = packing.OpenBins(64, most)
    used: dict[int, int] = {}
    open_bins: list[int] = []
    for n in lengths:
        fits = [b for b in open_bins if 64 - used[b] >= n]
        found, offset = bins.put(n)
        if fits:
            assert 64 - used[found] == min(64 - used[b] for b in fits)
        else:
            assert found == len(used)
            if len(open_bins) >= most:
                open_bins.remove(max(reversed(open_bins), key=used.__getitem__))
        assert offset == used.get(found, 0)
        used[found] = offset + n
        if not fits:
            open_bins.append(found)
        if used[found] == 64:
            open_bins.remove(found)
    assert all(v <= 64 for v in used.values())


def test_pieces():
    assert packing.pieces(np.zeros(10), 4) == [(0, 2), (2, 4), (6, 4)]
    assert packing.pieces(np.zeros(8), 4) == [(0, 4), (4, 4)]
    assert packing.pieces(np.zeros(4), 4) == [(0, 4)] and packing.pieces(np.zeros(1), 4) == [(0, 1)]


def test_pack_round_trip(spark, plain):
    rng = random.Random(2)
    rows = [(k, " ".join(rng.choices(["alpha", "beta", "gamma"], k=rng.randint(0, 900)))) for k in range(60)]
    rows += [(100, None), (101, ""), (102, "word " * 9000), (3, rows[3][1])]
    got = packing.pack(spark.createDataFrame(rows, DOCS + "")).collect()
    assert len(packing.pack(spark.createDataFrame([], DOCS)).collect()) == 0
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    total = 0
    for doc_id, text in dict(rows).items():
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        mine = sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got if r["doc_id"] == doc_id)
        copies = 2 if doc_id == 3 else 1
        total += copies * len(ids)
        mine = mine[::copies]
        assert [p for p, *_ in mine] == list(range(len(mine)))
        assert all(zlib.crc32(ids[s : s + n].tobytes()) == crc for _, s, n, crc in mine)
        assert sum(n for _, _, n, _ in mine) == len(ids)
        assert all(n == packing.CAPACITY for _, _, n, _ in mine[1:])
    assert len(by_sequence) <= -(-total // packing.CAPACITY) + 1


@pytest.fixture(scope="module")
def net(spark):
    return langid.train(spark.read.parquet(f"{SF}/documents.parquet"))


def test_language_on_held_out_documents(spark, net):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("held_out", langid.in_fold())
    rows = langid.identify(docs, net).where("held_out").collect()
    assert len(rows) > 150
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_convolution_by_tables(net):
    """The sum of table rows is the convolution of embedded bytes with the filters."""
    x = np.random.default_rng(1).integers(0, 256, (3, langid.WINDOW)).astype(np.uint8)
    top, _ = net.pooled(x)
    plain = np.full((3, len(net.bias)), -np.inf)
    for at in range(langid._POSITIONS):
        total = np.zeros((3, len(net.bias)))
        for k, w in enumerate(net.filters):
            total[:, : len(w)] += net.embed[x[:, at + k]] @ w.T
        plain = np.maximum(plain, total)
    assert np.allclose(top, plain + net.bias, atol=1e-4)


def test_language_cases(spark, net):
    rows = [(1, None, "en", 5), (2, "", None, 5), (3, "123 ... !", "en", 5), (4, "the and of " * 9000, None, 5), (4, "the and", "en", None)]
    docs = spark.createDataFrame(rows, DOCS + ", lang string, score int")
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in langid.identify(docs, net).orderBy("doc_id").collect()]
    assert got[:3] == [(1, "und", 0.0), (2, "und", 0.0), (3, "und", 0.0)]
    assert {x[1] for x in got[3:]} <= set(net.langs)
    nothing = docs.where("false")
    assert langid.train(nothing) is None and langid.identify(nothing, None).count() == 0
    assert langid.kept_languages(nothing).columns == docs.columns
    assert {r["lang_pred"] for r in langid.identify(docs, None).collect()} == {"und"}


def test_quality(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model, scorer = quality.train(docs)
    assert ((model.accuracy() > 0.5) & (model.accuracy() <= 1)).all()
    rows = quality.scored(docs, scorer).join(labels, "doc_id").collect()
    good = [r["keep"] for r in rows if r["quality"] == 1]
    bad = [r["keep"] for r in rows if r["quality"] == 0]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.35 * len(bad)
    odd = spark.createDataFrame([(1, None, 2), (2, "", 2), (2, "", 2), (None, "a " * 50_000, None)], DOCS + ", score int")
    assert quality.scored(odd, scorer).count() == 4
    nothing = odd.where("false")
    assert quality.scored(nothing, quality.train(nothing)[1]).count() == 0


def test_em_finds_accuracies():
    rng = np.random.default_rng(5)
    truth = rng.random(20_000) < 0.8
    rates = [0.95, 0.85, 0.75, 0.9]
    votes = np.stack([np.where(rng.random(len(truth)) < r, truth, ~truth) * 2 - 1 for r in rates], axis=1)
    votes[rng.random(votes.shape) < 0.2] = 0
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = quality.estimate(patterns, counts.astype(float))
    assert np.allclose(model.accuracy(), rates, atol=0.03) and abs(model.prior - 0.8) < 0.03


PAGE = """<html><head><title>T{k}</title><style>p</style><script>var a="</p><p>x";</script></head><body>
<header>Site</header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<aside>Side {k}</aside><{tag}><h1>Head {k}</h1><p>First {k}&nbsp;&amp; <b>bold{k}</b>text {k}<br>next {k}<p>{k} &lt; 99 </p>
<p>Sign our guest book</p><form>Name</form></{tag}><div id="comments"><p>Nice {k}</p></div><footer>&copy; us</footer></body></html>"""


def test_page_text(spark):
    rows = [(k, f"http://h.example/{k}", PAGE.format(k=k, tag="article")) for k in range(30)]
    rows += [(k, f"http://d.example/{k}", PAGE.format(k=k, tag="div")) for k in range(110, 112)]
    rows += [(200, None, None), (201, "nonsense", ""), (202, "http://x.example", "a < b &am"), (0, rows[0][1], rows[0][2])]
    pages = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string")
    got = {}
    for r in htmltext.extract(pages).collect():
        assert r["n_chars"] == len(r["text"])
        got[r["page_id"]] = r["text"]
    for k in range(30):  # the line that all pages of the host share is its template's
        assert got[k] == f"Head {k} First {k} & bold{k}text {k} next {k} {k} < 99"
    assert got[110] == "Head 110 First 110 & bold110text 110 next 110 110 < 99 Sign our guest book"
    assert (got[200], got[201], got[202]) == ("", "", "a < b &am")
    assert htmltext.extract(pages).count() == len(rows)
    assert htmltext.extract(pages.where("false")).count() == 0


@pytest.mark.parametrize(
    "source",
    [
        '<body class="no-sidebar"><article>{}</article></body>',
        '<body class="sidebar"><main>{}</main></body>',
        '<html class="menu"><body class="right-sidebar"><article>{}</article></body></html>',
        '<article class="post comments-open">{}</article>',
        '<main id="search">{}</main>',
        '<main id="search-results">{}</main>',
        '<div class="has-banner"><article>{}</article></div>',
        '<div class="banner"><main>{}</main></div>',
        '<article><header>{}</header></article>',
        '<article><div class="entry-header">{}</div></article>',
        '<article><div class="header">{}</div></article>',
    ],
)
def test_names_around_an_article(source):
    rest = '<div class="cookie-notice">C</div><div id="comments"><article class="comment">N</article></div><header>S</header>'
    assert htmltext.main_text(htmltext.parse(source.format("<h1>Head</h1><p>Text</p>") + rest), set()) == "Head Text"


def test_copies_of_a_page_are_no_template(spark):
    pages = [(k, f"http://h.example/{k}", PAGE.format(k=1, tag="article")) for k in range(40)]
    got = htmltext.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert {r["text"] for r in got} == {"Head 1 First 1 & bold1text 1 next 1 1 < 99 Sign our guest book"}


def test_sample_pages(spark):
    """Articles of the sample pages, cut out by their tags."""
    import html
    import re

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in htmltext.extract(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        plain = re.sub(r"</?(?!b\b)\w+[^>]*>", " ", article).replace("<b>", "").replace("</b>", "")
        assert got[r["page_id"]] == " ".join(html.unescape(plain).split())
