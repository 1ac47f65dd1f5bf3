"""Main text of web pages by equivalence-class template deduction over pages of one host."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldeval.llm.common import chunks, records, with_fields, written

#: A class is part of the template of a host, or of one of its layouts, if its tokens stand on
#: this share of the host's different pages, on so many pages and in so many tokens at least.
SUPPORT = 0.2
LEAST_PAGES = 3
LEAST_TOKENS = 2
#: Inside an article few pages may share a passage; there a class needs so many pages and this share.
SURE_SUPPORT = 0.95
SURE_PAGES = 20
#: Templates of so many tokens are broadcast; larger ones are joined with salted hosts.
BROADCAST_TOKENS = 500_000
SALTS = 64
_TEXT_BYTES = 1 << 20
_HELD = 100_000

# Names in HTML.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup"
    " time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
LEFT_OUT = frozenset(
    "head title nav header footer aside form button select option textarea label fieldset menu dialog iframe object svg"
    " canvas noscript template audio video map".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hr main menu nav ol p pre section table ul".split()
)
CLOSES_ITSELF = frozenset("li dt dd tr td th option".split())
SCOPES = frozenset("article section main div ul ol dl table tbody td th body html aside nav header footer form".split())
# A class, id or role made of these words alone names what is no article.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar aside"
    " nav navbar navigation menu breadcrumb breadcrumbs topbar footer header masthead notice notices alert cookie"
    " cookies consent gdpr popup modal overlay newsletter subscribe signup login comment comments commentlist discussion"
    " respond reply replies disqus share sharing social related recommended widget contentinfo complementary search form"
    " toolbar pagination pager copyright disclaimer".split()
)
BODY = frozenset(("article", "main"))
#: Elements that no name leaves out, and names that inside an article mark a part of it.
WHOLE = BODY | {"html", "body"}
HEADS = frozenset(("header", "masthead"))

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style)\b[^>]*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][\w:-]*+)((?:\"[^\"]*+\"|'[^']*+'|[^'\">])*+)>"
    r"|<[/!?a-zA-Z][^<>]*+>?"
    r"|([^<]++|<)",
    re.DOTALL | re.IGNORECASE,
)
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_PARTS = re.compile(r"[^a-z0-9]+")


PROSE = frozenset("h1 h2 h3 h4 h5 h6 p blockquote figcaption caption".split())
Run = tuple[int, str, bool, bool, bool]


@dataclass
class Element:
    tag: str
    path: int
    #: Left out for its tag, or for its names, or for those of what it is in.
    out: bool
    marked: bool
    body: bool
    link: bool
    #: Whether a block of links alone may be part of the text: in a heading or a paragraph.
    prose: bool


@dataclass
class Page:
    """Tokens of a page in order, and its runs of text."""

    tokens: list[int] = field(default_factory=list)
    #: (token, text, left out, in an article, in a list's link), or None between blocks.
    runs: list[Run | None] = field(default_factory=list)


def _key(*parts: object) -> int:
    found = xxhash.xxh64_intdigest("\0".join(map(str, parts)).encode("utf-8", "replace"))
    return found - (1 << 64) if found >= 1 << 63 else found


def parse(source: str) -> Page:
    """Tags by their path of tags and classes, and runs of decoded text by path and text."""
    page = Page()
    stack = [Element("", 0, False, False, False, False, False)]
    unclosed: dict[str, int] = {}  # how many elements of a tag are open, so no tag is looked for in vain
    articles = 0
    for found in _TOKEN.finditer(source):
        _, closing, tag, attributes, text = found.groups()
        if text is not None:
            top = stack[-1]
            text = html.unescape(text)
            plain = " ".join(text.split())
            token = _key(top.path, plain) if plain else 0
            if plain:
                page.tokens.append(token)
            page.runs.append((token, text, top.out or top.marked, top.body, top.link and not top.prose))
            continue
        if tag is None:
            continue
        tag = tag.lower()
        if tag not in INLINE:
            page.runs.append(None)
        if closing:
            if unclosed.get(tag):
                at = _last(stack, tag)
                page.tokens.append(_key("/", stack[at].path))
                _close(stack, at, unclosed)
            continue
        _close_implied(stack, tag, unclosed)
        top = stack[-1]
        names = " ".join(a or b or c for _, a, b, c in _NAMES.findall(attributes)).lower() if attributes else ""
        path = _key(top.path, tag, names)
        page.tokens.append(path)
        if tag in VOID or attributes.endswith("/"):
            continue
        body = top.body or tag in BODY
        out = top.out or (tag in LEFT_OUT and not (tag == "header" and body))
        marked = top.marked
        if tag == "main" or (tag == "article" and not articles):
            # What is around the page's article is never left out for its names.
            marked = False
        elif tag not in WHOLE:
            marked = marked or any(_is_mark(name, body) for name in names.split())
        articles += tag in BODY and not out
        stack.append(Element(tag, path, out, marked, body, top.link or tag == "a", top.prose or tag in PROSE))
        unclosed[tag] = unclosed.get(tag, 0) + 1
    return page


def _last(stack: list[Element], tag: str) -> int:
    """Place of the innermost open element of a tag; there is one."""
    return next(at for at in range(len(stack) - 1, 0, -1) if stack[at].tag == tag)


def _close(stack: list[Element], at: int, unclosed: dict[str, int]) -> None:
    """End an element and all inside it: each element is ended once, however deep they nest."""
    for element in stack[at:]:
        unclosed[element.tag] -= 1
    del stack[at:]


def _is_mark(name: str, body: bool) -> bool:
    """Whether a class, id or role says that its element is no article: all its words do."""
    words = {word for word in _PARTS.split(name) if word}
    return bool(words) and words <= MARKS and not (body and words <= HEADS)


def _close_implied(stack: list[Element], tag: str, unclosed: dict[str, int]) -> None:
    """Ends the paragraph or item that the new tag ends without saying so."""
    wanted = "p" if tag in CLOSES_P else tag if tag in CLOSES_ITSELF else None
    if wanted is None or not unclosed.get(wanted):
        return
    for at in range(len(stack) - 1, 0, -1):
        if stack[at].tag == wanted:
            _close(stack, at, unclosed)
            return
        if stack[at].tag in SCOPES:
            return


def main_text(page: Page, template: set[int], sure: set[int] | None = None) -> str:
    """Text of the page's slots: runs that are no template token and are not left out.

    The template decides first. `sure` are its tokens that hold inside articles as well, all of
    them if not given. A page of which the other tokens would take most is a copy of its like,
    and keeps them. Of what stays, the page's articles are the text if they have most of it;
    else all is, but for blocks of links alone outside headings and paragraphs.
    """
    certain = template if sure is None else sure
    slots = [run for run in page.runs if run is None or not (run[2] or run[0] in certain)]
    kept = [run for run in slots if run is None or run[3] or run[0] not in template]
    if 2 * _length(kept) < _length(slots):
        kept = slots
    blocks: list[list[Run]] = [[]]
    for run in kept:
        if run is None:
            blocks.append([])
        else:
            blocks[-1].append(run)
    inside = [run for run in kept if run is None or run[3]]
    outside = [run for block in blocks if any(r[0] and not r[4] for r in block) for run in block if not run[3]]
    if _length(inside) and _length(inside) >= _length(outside):
        parts = [" " if run is None else run[1] for run in inside]
        return " ".join("".join(parts).split())
    texts = ("".join(run[1] for run in block) for block in blocks if any(run[0] and not run[4] for run in block))
    return " ".join(" ".join(texts).split())


def _length(runs: list[Run | None] | list[Run]) -> int:
    """Words of runs."""
    return sum(len(run[1].split()) for run in runs if run is not None)


def _with_host(pages: DataFrame) -> DataFrame:
    address = F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return pages.withColumn("host", F.lower(address))


_STAT = "host string, token long, pages long, vector long, place double"


def _stat_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each host and token: pages with it, its occurrence vector folded into one number
    (every page adds a hash of page and count), and where it stands on average."""
    held: dict[tuple[str, int], list[float]] = {}

    def flush() -> pa.RecordBatch:
        rows = [(h, t, n, v, p) for (h, t), (n, v, p) in held.items()]
        held.clear()
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
        columns = zip(*rows) if rows else [()] * 5
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, kinds)], ["host", "token", "pages", "vector", "place"]
        )

    for part in chunks(batches, 2, _TEXT_BYTES):
        for host, page_key, source in part:
            counts: dict[int, int] = {}
            first: dict[int, int] = {}
            for at, token in enumerate(parse(source).tokens):
                counts[token] = counts.get(token, 0) + 1
                first.setdefault(token, at)
            for token, count in counts.items():
                entry = held.setdefault((host, token), [0, 0, 0.0])
                entry[0] += 1
                entry[1] ^= _key(page_key, count)
                entry[2] += first[token]
        if len(held) >= _HELD:
            yield flush()
    yield flush()


def templates(hosted: DataFrame) -> DataFrame:
    """(host, tokens, classes, sure): the tokens of each host's templates in order, the number of
    the equivalence class of each, and whether it holds inside articles.

    Tokens that share an occurrence vector over the host's different pages form a class; a class
    on some of the pages is of one layout. Copies of a page count once, so a page is no template
    of its own copies.
    """
    different = hosted.where("html is not null").select("host", F.xxhash64("html").alias("page_key"), "html")
    different = different.dropDuplicates(["host", "page_key"])
    stats = different.mapInArrow(_stat_rows, _STAT).groupBy("host", "token").agg(
        F.sum("pages").alias("pages"), F.bit_xor("vector").alias("vector"), F.sum("place").alias("place")
    )
    # As every token here stands on a fifth of the host's pages, a host has no more of them than
    # five of its pages have.
    totals = hosted.where("html is not null").select("host", F.xxhash64("html").alias("page_key")).distinct()
    totals = totals.groupBy("host").agg(F.count("*").alias("total"))
    common = stats.join(totals, "host").where((F.col("pages") >= LEAST_PAGES) & (F.col("pages") >= SUPPORT * F.col("total")))
    sure = (F.col("pages") >= SURE_PAGES) & (F.col("pages") >= SURE_SUPPORT * F.col("total"))
    classes = common.groupBy("host", "pages", "vector", sure.alias("sure")).agg(
        F.collect_list(F.struct((F.col("place") / F.col("pages")).alias("place"), "token")).alias("members")
    )
    classes = classes.where(F.size("members") >= LEAST_TOKENS).select(
        "host", "sure", F.xxhash64("pages", "vector").alias("class"), F.explode("members").alias("member")
    )
    ordered = classes.groupBy("host").agg(
        F.array_sort(F.collect_list(F.struct("member.place", "member.token", "class", "sure"))).alias("all")
    )
    return ordered.select("host", *(F.col(f"all.{one}").alias(all_) for one, all_ in (("token", "tokens"), ("class", "classes"), ("sure", "sure"))))


def fitting(page: Page, tokens: list[int], classes: list[int]) -> set[int]:
    """Template tokens of the classes that nest on this page: all their tokens stand there in
    the template's order, and between the same tokens of the classes around them."""
    place = {token: k for k, token in enumerate(tokens)}
    first: dict[int, int] = {}
    for at, token in enumerate(page.tokens):
        if token in place:
            first.setdefault(token, at)
    whole: dict[int, list[int]] = {}
    for token, name in zip(tokens, classes):
        whole.setdefault(name, []).append(token)
    nested: set[int] = set()
    for members in sorted(whole.values(), key=len, reverse=True):
        seen = [first.get(token) for token in members]
        if any(at is None for at in seen) or seen != sorted(seen):
            continue
        # Nested: sorted by template order, the tokens so far stay in page order with these.
        joint = sorted([*nested, *members], key=place.__getitem__)
        at = [first[token] for token in joint]
        if at == sorted(at):
            nested.update(members)
    return nested


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages (page_id, url, html).

    Null html gives an empty text; a null or relative url belongs to the empty host. Pages of
    hosts with fewer than LEAST_PAGES different pages have no template; inside articles a token
    is the template's only with more pages of its host. Character references
    are decoded, white space is one space, blocks are joined by one. Repeated rows repeat, an
    empty table gives no rows, further columns are ignored.
    """
    hosted = _with_host(pages.select("page_id", "url", "html"))
    found = written(templates(hosted), "templates")
    size = found.agg(F.sum(F.size("tokens"))).first()[0] or 0
    if size <= BROADCAST_TOKENS:
        joined = hosted.join(F.broadcast(found), "host", "left")
    else:
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
        salted = hosted.withColumn("salt", F.pmod(F.xxhash64("page_id", "html"), F.lit(SALTS)).cast("int"))
        joined = salted.join(found.select("*", salts), ["host", "salt"], "left")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for source, tokens, classes, sure in records(iter([batch.select(["html", "tokens", "classes", "sure"])])):
                page = parse(source or "")
                nested = fitting(page, tokens or [], classes or [])
                certain = {token for token, holds in zip(tokens or [], sure or []) if holds}
                texts.append(main_text(page, nested, nested & certain))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    schema = with_fields(pages.select("page_id", "url"), ("text", T.StringType()), ("n_chars", T.LongType()))
    return joined.select("page_id", "url", "html", "tokens", "classes", "sure").mapInArrow(rows, schema)
