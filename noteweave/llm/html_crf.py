"""Main-text extraction with a linear-chain conditional random field over the leaf blocks of a page.

A page is cut into leaf blocks: runs of text between block-level tags. Each block carries features of
its ancestor tags (names, and the words of their class, id and role attributes) and of its text (length,
punctuation, link share, telling words). Two labels, main text or not, form a chain; the model is trained
by penalised maximum likelihood on labelled pages and decoded by Viterbi. The blocks labelled main are
joined in page order by a newline.

Labelled pages are HTML whose main elements carry ``data-main``, an attribute that is never a feature.
`labelled_pages` makes a bounded, seeded set of them from the usual ways of marking up an article and
what stands around it; `train` takes any others.

Defined results: null and empty pages, and pages without a main block, give an empty text; character
references are decoded; white space in a block, breaks and non-breaking spaces included, becomes one
space; a tag that is never closed ends with its container; a comment, script or style that is never
closed runs to the end; repeated rows are independent; an empty table gives an empty result; further
columns are not read.
"""

from __future__ import annotations

import html as htmllib
import random
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteweave.llm.common import prepare, small_batches

#: Labelled pages used for training, and the most that `train` takes: a documented bound.
TRAINING_PAGES, MOST_PAGES = 600, 5_000

BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noscript object ol optgroup option p pre search section select "
    "summary table tbody td template textarea tfoot th thead title tr ul".split()
)
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A start tag of the key ends an open element of the value, up to the nearest of the last set.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "body": {"head", "title"}}
ENDS_P = BLOCK - frozenset("button option optgroup select td th tr tbody thead tfoot caption legend textarea title".split())
SCOPE = frozenset("table ul ol dl div article aside section nav main body select td th form".split())

TOKEN = re.compile(r"<!--(?:.*?-->|.*\Z)|<!\[CDATA\[(?:.*?\]\]>|.*\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
WORD = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")
CLOSING = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I) for tag in RAW}
#: Words in a text that tell of a notice, form, advert, menu or comment.
TELLING = frozenset("cookie cookies subscribe newsletter login signup register advertisement sponsored advert promoted comments reply replies privacy terms copyright rights reserved share follow menu search consent accept".split())


def _marks(attributes: str) -> tuple[set[str], bool]:
    """Feature words of the class, id and role attributes; whether data-main is there."""
    found, main = set(), False
    if attributes and not attributes.isspace():
        for name, a, b, c in ATTRIBUTE.findall(attributes):
            name = name.lower()
            if name in ("class", "id", "role", "itemprop", "aria-label"):
                found.update(f"word:{w.lower()}" for w in WORD.findall(htmllib.unescape(a or b or c)))
            elif name == "data-main":
                main = True
            elif name in ("hidden", "contenteditable"):
                found.add(f"word:{name}")
    return found, main


def leaf_blocks(page: str) -> list[tuple[str, frozenset, float, bool, str]]:
    """(text, ancestor features, link share, labelled main, innermost tag) of each leaf block."""
    out: list[tuple[str, frozenset, float, bool, str]] = []
    stack: list[tuple[str, frozenset, bool]] = [("", frozenset(), False)]
    parts: list[str] = []
    state = {"links": 0, "linked": 0, "size": 0}

    def text(piece: str) -> None:
        if piece:
            piece = htmllib.unescape(piece) if "&" in piece else piece
            parts.append(piece)
            state["size"] += len(piece)
            if state["links"]:
                state["linked"] += len(piece)

    def flush() -> None:
        if parts:
            if words := " ".join("".join(parts).split()):
                tag, features, main = stack[-1]
                out.append((words, features, state["linked"] / max(1, state["size"]), main, tag))
            parts.clear()
        state["linked"] = state["size"] = 0

    def close(depth: int) -> None:
        flush()
        del stack[depth:]

    at, end = 0, len(page)
    while at < end:
        m = TOKEN.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        slash, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            if m[0].startswith("<![CDATA["):
                text(htmllib.escape(m[0][9:].removesuffix("]]>")))
            continue
        tag = tag.lower()
        if slash:
            if tag == "a":
                state["links"] = 0
            elif tag in BLOCK:
                flush()
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth][0] == tag:
                        close(depth)
                        break
                    if tag in ("p", "li") and stack[depth][0] in SCOPE:
                        break
            continue
        if tag == "a":
            state["links"] = 1
        elif tag == "br":
            parts.append(" ")
        elif tag in BLOCK:
            flush()
            if tag in ENDS_P and stack[-1][0] == "p":
                stack.pop()
            ends = ENDS.get(tag)
            for depth in range(len(stack) - 1, 0, -1) if ends else ():
                if stack[depth][0] in ends:
                    del stack[depth:]
                    break
                if stack[depth][0] in SCOPE:
                    break
            if tag != "hr":
                state["links"] = 0
                words, main = _marks(attributes)
                _, above, was = stack[-1]
                stack.append((tag, above | words | {f"in:{tag}"}, was or main))
        if tag in RAW:  # a slash at the end does not close these
            ending = CLOSING[tag].search(page, at)
            stop = ending.start() if ending else end
            if tag in ("title", "textarea"):
                text(page[at:stop])
            at = stop
    flush()
    return out


def features(block: tuple[str, frozenset, float, bool, str]) -> set[str]:
    words, above, linked, _, tag = block
    tokens = words.split(" ", 60)
    found = {"bias", f"own:{tag}", f"links:{min(3, int(linked * 4))}", f"words:{min(5, len(tokens).bit_length())}", *above}
    if words[-1] in ".!?…:;\"”»)":
        found.add("ends:mark")
    if words[0] in "©®™" or "©" in words[:40]:
        found.add("has:copyright")
    if "," in words:
        found.add("has:comma")
    if len(tokens) <= 30 and not TELLING.isdisjoint(x.lower().strip(".,:;!?()") for x in tokens):
        found.add("has:telling")
    return found


class Field:
    """The trained model: a weight for each feature (main against not), and the chain's weights."""

    def __init__(self, weights: dict[str, float], chain: np.ndarray):
        self.weights, self.chain = weights, chain

    def labels(self, blocks: list) -> list[bool]:
        """The best labels, by Viterbi."""
        if not blocks:
            return []
        get = self.weights.get
        (c00, c01), (c10, c11) = self.chain.tolist()
        back, zero, one = [], 0.0, 0.0
        for i, block in enumerate(blocks):
            emission = sum(get(f, 0.0) for f in features(block))
            if i:
                a, b = zero + c00 >= one + c10, zero + c01 >= one + c11
                back.append((not a, not b))
                zero, one = (zero + c00 if a else one + c10), (zero + c01 if b else one + c11)
            one += emission
        path = [one > zero]
        for step in reversed(back):
            path.append(step[path[-1]])
        return path[::-1]

    def main_text(self, page: str | None) -> str:
        blocks = leaf_blocks(page) if page else []
        return "\n".join(b[0] for b, keep in zip(blocks, self.labels(blocks), strict=True) if keep)


def train(pages: Iterable[str], rounds: int = 100, penalty: float = 0.02) -> Field:
    """Penalised maximum likelihood by full-batch gradient steps (Adam) over at most MOST_PAGES pages."""
    chains = [c for _, page in zip(range(MOST_PAGES), pages, strict=False) if (c := leaf_blocks(page))]
    names: dict[str, int] = {}
    rows = [[sorted(names.setdefault(f, len(names)) for f in sorted(features(b))) for b in c] for c in chains]
    if not rows:
        return Field({}, np.zeros((2, 2)))
    longest, n = max(map(len, rows)), len(rows)
    matrix = np.zeros((n, longest, len(names)), np.float32)
    gold, there = np.zeros((n, longest), int), np.zeros((n, longest), bool)
    for r, (row, chain) in enumerate(zip(rows, chains, strict=True)):
        for i, (own, block) in enumerate(zip(row, chain, strict=True)):
            matrix[r, i, own], gold[r, i], there[r, i] = 1, block[3], True
    flat, w, c = matrix[there], np.zeros(len(names)), np.zeros((2, 2))
    moments = [np.zeros(len(names) + 4), np.zeros(len(names) + 4)]
    both = there[:, 1:]
    pairs = np.zeros((2, 2))
    np.add.at(pairs, (gold[:, :-1][both], gold[:, 1:][both]), 1)
    for step in range(1, rounds + 1):
        emission = np.zeros((n, longest))
        emission[there] = flat @ w.astype(np.float32)
        scores = np.stack([np.zeros_like(emission), emission], axis=2)
        forward, backward = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        forward[:, 0] = scores[:, 0]
        for i in range(1, longest):
            new = np.logaddexp(forward[:, i - 1, :1] + c[0], forward[:, i - 1, 1:] + c[1]) + scores[:, i]
            forward[:, i] = np.where(there[:, i, None], new, forward[:, i - 1])
        for i in range(longest - 2, -1, -1):
            after = scores[:, i + 1] + backward[:, i + 1]
            new = np.logaddexp(c[:, 0] + after[:, :1], c[:, 1] + after[:, 1:])
            backward[:, i] = np.where(there[:, i + 1, None], new, 0)
        total = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
        one = np.exp(forward[:, :, 1] + backward[:, :, 1] - total[:, None])
        pair = forward[:, :-1, :, None] + c + (scores[:, 1:] + backward[:, 1:])[:, :, None, :] - total[:, None, None, None]
        expected = np.exp(pair[both]).sum(axis=0)
        slope = np.concatenate([(gold[there] - one[there]) @ flat - penalty * w, (pairs - expected).ravel() - penalty * c.ravel()])
        moments[0] = 0.9 * moments[0] + 0.1 * slope
        moments[1] = 0.999 * moments[1] + 0.001 * slope**2
        change = 0.15 * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.999**step)) + 1e-8)
        w, c = w + change[:-4], c + change[-4:].reshape(2, 2)
    return Field({f: float(w[i]) for f, i in names.items()}, c)


#: Ways to mark up what stands around an article, by kind: element and attributes.
AROUND = {
    "menu": ['nav', 'nav class="menu"', 'div class="nav"', 'div id="menu"', 'ul class="navbar"', 'div class="main-menu"', 'nav id="navigation"', 'div class="breadcrumb"', 'div class="breadcrumbs"', 'div role="navigation"', 'ol class="pagination"', 'div class="toc"', 'ul class="tags"', 'menu'],
    "header": ['header', 'header class="site-header"', 'div id="header"', 'div class="header"', 'div class="masthead"', 'div class="top-bar"', 'div class="banner"', 'header role="banner"', 'div id="top"', 'div class="logo"'],
    "footer": ['footer', 'footer class="site-footer"', 'div id="footer"', 'div class="footer"', 'div class="copyright"', 'div class="bottom"', 'footer role="contentinfo"', 'div class="legal"', 'div class="credits"'],
    "sidebar": ['aside', 'aside class="sidebar"', 'div class="sidebar"', 'div id="sidebar"', 'div class="side"', 'aside id="related"', 'div class="related"', 'div class="widget"', 'section class="recommended"', 'div class="trending"', 'div class="popular"', 'div class="author-bio"', 'div class="more-stories"', 'div role="complementary"'],
    "notice": ['div class="cookie"', 'div id="cookie-banner"', 'div class="notice"', 'div class="consent"', 'div class="alert"', 'section class="gdpr"', 'div class="modal"', 'div class="popup"', 'div role="alert"', 'div class="overlay"', 'div class="paywall"', 'dialog', 'noscript', 'div role="dialog"', 'div class="disclaimer"', 'div class="message"', 'div id="notification"'],
    "advert": ['div class="ad"', 'div class="ads"', 'div id="ad-top"', 'div class="advert"', 'aside class="ad"', 'div class="advertisement"', 'div class="sponsored"', 'div class="promo"', 'ins class="adsbygoogle"', 'section class="promoted"', 'div class="ad-slot"', 'div class="sponsor"', 'div class="affiliate"'],
    "form": ['form', 'form class="search"', 'form id="login"', 'div class="newsletter"', 'form class="subscribe"', 'div class="signup"', 'fieldset', 'div class="share"', 'div class="social"', 'form class="contact"', 'div class="search-box"'],
    "comments": ['section class="comments"', 'div id="comments"', 'div class="comments"', 'ol class="commentlist"', 'div class="comment-list"', 'div class="comment"', 'div id="disqus_thread"', 'div class="replies"', 'section id="respond"', 'div class="reader-comments"', 'ul class="comments"', 'div class="discussion"', 'div class="responses"', 'div class="user-comments"', 'article class="comment"', 'div class="feedback"', 'div class="reviews"'],
}
#: Ways to mark up the article itself.
ARTICLE = ['article', 'article class="post"', 'main', 'main id="content"', 'div class="content"', 'div id="content"', 'div class="article"', 'div class="article-body"', 'div class="post-content"', 'div class="entry-content"', 'section class="story"', 'div id="main"', 'div itemprop="articleBody"', 'div class="text"', 'div class="body"', 'div class="post"', 'section', 'div']
#: Fixed words of notices, forms, menus and comments, as they stand on many pages.
PHRASES = ["We use cookies.", "Accept all cookies", "Subscribe to our newsletter", "Sign up", "Log in", "Share this", "Follow us", "Advertisement", "Sponsored", "All rights reserved.", "Privacy policy", "Terms of use", "Leave a reply", "Read more", "Related articles", "Search", "Post a comment", "Your email", "Menu", "Home", "Contact", "About us"]


def labelled_pages(n: int = TRAINING_PAGES, seed: int = 7) -> list[str]:
    """Labelled pages: an article between menus, headers, notices, adverts, forms, sidebars and comments."""
    rng = random.Random(seed)

    def sentence(low: int = 2, high: int = 18) -> str:
        words = ["".join(rng.choice("bcdfghklmnprstvzßñç") + rng.choice("aeiouéäöüó") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(low, high))]
        if len(words) > 6:
            words[rng.randrange(5)] += ","
        return (" ".join(words)).capitalize() + rng.choice([".", ".", ".", "", "!", "?"])

    def prose() -> str:
        return " ".join(sentence() for _ in range(rng.choice([1, 1, 2, 3, 5, 8])))

    def inline(words: str) -> str:
        tag = rng.choice(["b", "i", "em", "strong", "span", "a href='#'"])
        cut = words.find(" ") + 1
        return f"{words[:cut]}<{tag}>{words[cut : cut + 9]}</{tag.split()[0]}>{words[cut + 9 :]}" if rng.random() < 0.2 else words

    def element(spec: str, inside: str) -> str:
        return f"<{spec}>{inside}</{spec.split()[0]}>"

    def around(kind: str) -> str:
        spec = rng.choice(AROUND[kind])
        if kind == "menu" or kind in ("sidebar", "footer", "header") and rng.random() < 0.4:
            items = [f"<a href='/{i}'>{sentence(1, 3)}</a>" for i in range(rng.randint(1, 8))]
            inside = "".join(f"<li>{x}</li>" for x in items)
            inside = inside if spec[:2] in ("ul", "ol") else f"<ul>{inside}</ul>" if rng.random() < 0.8 else " ".join(items)
        elif kind == "form":
            inside = f"<label>{rng.choice(PHRASES)}</label><input name='q'><button>{rng.choice(PHRASES)}</button>" + rng.choice(["", f"<p>{prose()}</p>", f"<select><option>{sentence(1, 2)}<option>{sentence(1, 2)}</select>"])
        else:
            texts = [rng.choice([prose(), prose(), sentence(), rng.choice(PHRASES)]) for _ in range(rng.choice([1, 1, 2, 3]))]
            if kind == "footer":
                texts[0] = rng.choice(["&copy; ", "© 2024 ", ""]) + texts[0]
            heading = f"<h3>{sentence(1, 4)}</h3>" if rng.random() < 0.25 else ""
            wrap = rng.choice(["p", "p", "div", "li", ""])
            inside = heading + "".join(f"<{wrap}>{x}</{wrap}>" if wrap else x for x in (texts if wrap else texts[:1]))
        return element(spec, inside)

    def body() -> str:
        parts = [f"<h1>{sentence(2, 8)}</h1>"] if rng.random() < 0.7 else []
        for _ in range(rng.choice([1, 1, 2, 3, 4, 6, 9])):
            kind = rng.random()
            if kind < 0.08:  # such lines are main text where they stand in an article
                parts.append(f"<p>{rng.choice(PHRASES)}</p>")
            elif kind < 0.62:
                parts.append(f"<p>{inline(prose())}" + rng.choice(["</p>", "</p>", "</p>", ""]))
            elif kind < 0.7:
                parts.append(f"<p><b>{sentence()}<br><p>{prose()}</p>")
            elif kind < 0.78:
                tag = rng.choice(["h2", "h3", "h4"])
                parts.append(f"<{tag}>{sentence(1, 6)}</{tag}><p>{prose()}</p>")
            elif kind < 0.86:
                tag = rng.choice(["ul", "ol"])
                parts.append(element(tag, "".join(f"<li>{inline(sentence())}</li>" for _ in range(rng.randint(1, 5)))))
            elif kind < 0.91:
                parts.append(f"<blockquote>{rng.choice(['<p>', ''])}{prose()}</blockquote>")
            elif kind < 0.95:
                parts.append(f"<table><tr><td>{sentence(1, 3)}<td>{sentence(1, 3)}</table>")
            elif kind < 0.98:
                parts.append(f"<pre>{sentence()}</pre>")
            else:
                parts.append(f"<div>{prose()}</div>")
        return "".join(parts)

    pages = []
    for _ in range(n):
        inner = body()
        if rng.random() < 0.4:
            cut = inner.rfind("<p>")
            inner = (inner[:cut] if cut > 0 else inner) + "\0" + (inner[cut:] if cut > 0 else "")
        inserted = around(rng.choice(["advert", "advert", "form", "sidebar", "notice", "menu", "comments"]))
        spec = rng.choice(ARTICLE)
        if "\0" in inner:  # what stands inside the article and is not of it
            before, after = inner.split("\0")
            wrapped = lambda x: f"<div data-main>{x}</div>" if x else ""
            article = element(spec, wrapped(before) + inserted + wrapped(after))
        else:
            article = element(spec + " data-main", inner)
        if rng.random() < 0.25:
            article = element(rng.choice(["div class='page'", "div id='wrapper'", "div class='container'", "main", "div class='row'"]), article)
        before = "".join(around(k) for k in ("notice", "header", "menu", "form", "advert", "sidebar") if rng.random() < 0.4)
        after = "".join(around(k) for k in ("advert", "sidebar", "comments", "form", "footer", "notice") if rng.random() < 0.45)
        before, after = (x if rng.random() < 0.8 else "" for x in (before, after))
        if rng.random() < 0.1:
            pages.append(before + article + after)  # a fragment
            continue
        pages.append(f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{sentence(2, 8)}</title><style>p{{}}</style><script>var a='<p>x</p>';</script></head><body>{before}{article}{after}</body></html>")
    return pages


def extract(spark: SparkSession, df: DataFrame, keep: list[str], html_col: str = "html", model: Field | None = None) -> DataFrame:
    """The columns `keep`, `text` (the main text) and `n_chars` for each row."""
    prepare(spark)
    shared = spark.sparkContext.broadcast(model or train(labelled_pages()))  # a few hundred weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        for batch in small_batches(batches, "_page"):
            texts = [field.main_text(page) for page in batch.column("_page").to_pylist()]
            columns = [batch.column(c) for c in kept] + [pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*kept, "_text", "_chars"])

    kept = [f"_k{i}" for i in range(len(keep))]
    rows = df.select(*(F.col(c).alias(k) for c, k in zip(keep, kept, strict=True)), F.col(html_col).cast("string").alias("_page"))
    schema = ", ".join([*(f"{k} {rows.schema[k].dataType.simpleString()}" for k in kept), "_text string, _chars long"])
    out = rows.mapInArrow(run, schema)
    return out.select(*(F.col(k).alias(c) for c, k in zip(keep, kept, strict=True)), F.col("_text").alias("text"), F.col("_chars").alias("n_chars"))
