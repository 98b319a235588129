"""HTML extraction: a linear-chain conditional random field over the leaf blocks of a page.

A page becomes its leaf blocks: text between the edges of block elements, with the elements around
it. Each block has features of its ancestors' tags, class and id words, and of its text; a chain of
two labels, article or not, has weights for them and for label changes, apart for blocks with the
same and with another parent. Viterbi's best labels decide which blocks are the article.

It is trained on labelled pages: up to TRAINING pages of the table that mark their article with
`<article>`, as they are and with their parts set anew in other layouts, whose labels are known.
"""

from __future__ import annotations

import functools
import html
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import SPACE, col, mapped

#: Pages the model is fitted on at most, each of so many characters at most; every page is extracted whole.
TRAINING, TRAINING_CHARS = 160, 40_000
#: Layouts made of each of them, passes of the fit, its step and its pull towards zero.
LAYOUTS, PASSES, STEP, DECAY = 3, 100, 0.15, 0.02

#: Elements of HTML by their role in reading.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe svg math select noembed noframes xmp object canvas audio video".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option"
    " p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that are a block rather than hold some; blocks in the same element but for these have the same parent.
LEAF = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote figcaption button label legend caption b i a em strong span u s small code".split())
#: A start tag of the first kind ends an open element of the second, unless one of the third is open inside.
CLOSES = {
    **dict.fromkeys("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split(), (("p",), ("button", "td", "th"))),
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)), "td": (("td", "th"), ("table", "tr")), "th": (("td", "th"), ("table", "tr")),
    "option": (("option",), ("select",)), "tbody": (("thead", "tbody"), ("table",)), "body": (("head",), ()),
}
TAGS = "article main section nav header footer aside form ul ol li table td th dl blockquote pre figure figcaption button label fieldset dialog details a p div h1 h2 h3 h4 h5 h6 address menu b center".split()
#: Words in class, id and role by what they say about a part of a page.
CUES = {
    "content": "article articlebody content post entry story main text body prose page-content",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager tabs toolbar topbar skip toc",
    "head": "header masthead banner logo branding site-title tagline hero",
    "foot": "footer copyright legal colophon imprint contentinfo disclaimer",
    "side": "sidebar aside widget related recommended popular trending teaser complementary rail more tags share social follow",
    "ad": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion adsbygoogle adbox dfp outbrain taboola",
    "comment": "comment comments commentlist reply replies respond discussion disqus feedback reviews",
    "notice": "cookie cookies consent gdpr notice notices alert modal popup overlay newsletter subscribe signup paywall warning dialog",
    "form": "form search login signin register contact input",
    "hidden": "hidden invisible sr-only visually-hidden screen-reader-text d-none",
}
_WORDS = {w: c for c, words in CUES.items() for w in words.split()}
_TEXT = [
    "bias", "words0", "words3", "words8", "words20", "words50", "linked", "links", "half", "mark", "sentence", "sign", "upper", "symbols", "digits", "first", "nested", "no p",
]
FEATURES = [*(f"in {t}" for t in TAGS), *(f"at {t}" for t in TAGS), *(f"cue {c}" for c in CUES), *(f"near {c}" for c in CUES), *_TEXT]
_AT = {f: i for i, f in enumerate(FEATURES)}
#: Weights: features, then label changes [another or same parent][label before][label], then the first label.
SIZE = len(FEATURES) + 8 + 2

_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_STOP = re.compile(r"""["'>]""")
_ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|aria-hidden|style|x-[01])(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_BLANKS = re.compile(r"[\x20\x09-\x0D]+")
_SPACE = SPACE.decode()
_END = re.compile(r"[.!?:;…。؟！？][\"'”’»)]*$")


@functools.lru_cache(4096)
def _cues(attributes: str) -> tuple[tuple[str, ...], int | None]:
    """Cues in the attributes of a start tag, and the label it carries in labelled pages."""
    out, gold = set(), None
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name in ("class", "id", "role"):
            for token in value.split():
                if c := _WORDS.get(token):
                    out.add(c)
                else:
                    out |= {_WORDS[w] for w in re.split(r"[^a-z]+", token) if w in _WORDS}
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            out.add("hidden")
        elif name in ("x-0", "x-1"):
            gold = int(name[2])
    return tuple(sorted(out)), gold


class _Open:
    """An open element, with what it and those around it mean for blocks inside."""

    __slots__ = ("features", "gold", "holder", "inner", "tag")

    def __init__(self, tag: str, around: _Open | None, attributes: str, serial: int):
        cues, gold = _cues(attributes) if attributes else ((), None)
        own = [_AT[f] for f in (f"in {tag}", *(f"cue {c}" for c in cues)) if f in _AT]
        self.tag, self.holder = tag, around.holder if around and tag in LEAF else serial
        self.features = around.features | frozenset(own) if around and own else around.features if around else frozenset(own)
        self.inner = tuple(_AT[f"near {c}"] for c in cues) or (around.inner if around else ())
        self.gold = around.gold if gold is None and around else gold


class Block:
    __slots__ = ("around", "features", "gold", "linked", "parent", "tag", "text")

    def __init__(self, text: str, linked: int, element: _Open):
        self.text, self.linked, self.tag, self.gold = text, linked, element.tag, element.gold
        self.around, self.parent = element, element.holder


def leaf_blocks(page: str) -> list[Block]:
    """The blocks of a page that have text, in order: character references decoded, white space made one space, ends trimmed. Linear in the page."""
    out: list[Block] = []
    root = _Open("", None, "", 0)
    stack, depth = [root], {}
    parts: list[str] = []
    linked = serial = 0
    low, n, at = None, len(page), 0
    gone: dict[str, int] = {}

    def end_block():
        nonlocal parts, linked
        if parts:
            text = _BLANKS.sub(" ", "".join(parts)).strip(_SPACE)
            if text:
                element = next(e for e in reversed(stack) if e.tag in BLOCK or e is root)
                out.append(Block(text, linked, element))
            parts, linked = [], 0

    def add(text: str):
        nonlocal linked
        text = html.unescape(text) if "&" in text else text
        parts.append(text)
        if depth.get("a"):
            linked += len(text.strip(_SPACE))

    def pop_to(tag: str):
        while True:
            e = stack.pop()
            depth[e.tag] -= 1
            if e.tag == tag:
                return

    def find(what: str, start: int) -> int:
        """Where `what` comes next; what was once not found isn't sought again."""
        if what in gone:
            return -1
        i = (low if what.startswith("</") else page).find(what, start)
        if i < 0:
            gone[what] = 1
        return i

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            add(page[at:])
            break
        if lt > at:
            add(page[at:lt])
        mark = page[lt + 1 : lt + 2]
        if mark == "!" or mark == "?":
            comment = page.startswith("<!--", lt)
            end = find("-->", lt + 4) if comment else find(">", lt)
            if end < 0:
                break
            at = end + (3 if comment else 1)
            continue
        closing = mark == "/"
        m = _NAME.match(page, lt + 1 + closing)
        if not m:
            if closing:  # a stray end tag
                end = find(">", lt)
                at = n if end < 0 else end + 1
            else:
                add("<")
                at = lt + 1
            continue
        tag, i = m[0].lower(), m.end()
        while True:
            stop = _STOP.search(page, i)
            if not stop:
                i = n
                break
            if stop[0] == ">":
                i = stop.start()
                break
            shut = find(stop[0], stop.end())
            i = stop.end() if shut < 0 else shut + 1
        attributes, at = page[m.end() : i], i + 1
        if i >= n:
            break  # a tag that the page cuts
        if tag == "br":
            parts.append(" ")
            continue
        if tag in BLOCK:
            end_block()
        if closing:
            if depth.get(tag):
                pop_to(tag)
            continue
        if tag in RAW:
            if low is None:
                low = page.lower()
                if len(low) != n:  # letters that lower to two
                    low = "".join(c.lower() if c.isascii() else c for c in page)
            end = find(f"</{tag}", at)
            at = n if end < 0 else page.find(">", end) + 1 or n
            parts.append(" ")
            continue
        if tag in CLOSES:
            ends, walls = CLOSES[tag]
            for e in reversed(stack) if any(depth.get(x) for x in ends) else ():
                if e.tag in ends:
                    pop_to(e.tag)
                    break
                if e.tag in walls:
                    break
        if tag not in VOID and not attributes.endswith("/"):
            serial += 1
            stack.append(_Open(tag, stack[-1], attributes, serial))
            depth[tag] = depth.get(tag, 0) + 1
    end_block()
    return out


def features(block: Block, first: bool) -> list[int]:
    """Numbers of the features that a block has."""
    text, words = block.text, block.text.count(" ") + 1
    has = ["bias"]
    has += [f for f, least in (("words3", 3), ("words8", 8), ("words20", 20), ("words50", 50)) if words >= least] or ["words0"]
    share = block.linked / len(text)
    has += [f for f, yes in (
        ("linked", share > 0.9), ("half", share > 0.3), ("links", block.linked > 0), ("mark", any(c in text for c in ".,!?")), ("sentence", bool(_END.search(text[-8:]))), ("sign", "©" in text or "|" in text or "»" in text),
        ("upper", text[:1].isupper()), ("symbols", 5 * sum(map(text.count, "#*$%&|<>")) > len(text)), ("digits", 3 * sum(map(text.count, "0123456789")) > len(text)), ("first", first),
    ) if yes]
    around = block.around.features
    if _AT["in p"] not in around:
        has.append("no p")
    own = f"at {block.tag}"
    return [*around, *block.around.inner, *([_AT[own]] if own in _AT else []), *(_AT[f] for f in has)]


def _changes(weights) -> tuple:
    k = len(FEATURES)
    return [[[float(weights[k + 4 * s + 2 * a + b]) for b in (0, 1)] for a in (0, 1)] for s in (0, 1)], [float(weights[k + 8]), float(weights[k + 9])]


def viterbi(scores: list[float], same: list[bool], change, start) -> list[int]:
    """Best labels of a chain: `scores` are those of label 1, label 0 has none."""
    if not scores:
        return []
    v0, v1, back = start[0], start[1] + scores[0], []
    for x, s in zip(scores[1:], same[1:], strict=True):
        (a00, a01), (a10, a11) = change[s]
        b0, b1 = v0 + a00 >= v1 + a10, v0 + a01 >= v1 + a11
        v0, v1 = (v0 + a00 if b0 else v1 + a10), (v0 + a01 if b1 else v1 + a11) + x
        back.append((b0, b1))
    label = int(v1 > v0)
    out = [label]
    for b in reversed(back):
        label = 0 if b[label] else 1
        out.append(label)
    return out[::-1]


def main_text(page: str, weights: list[float]) -> str:
    """The blocks labelled as the article, two line feeds between."""
    blocks = leaf_blocks(page)
    change, start = _changes(weights)
    scores = [sum(weights[f] for f in features(b, i == 0)) for i, b in enumerate(blocks)]
    same = [i > 0 and b.parent == blocks[i - 1].parent for i, b in enumerate(blocks)]
    return "\n\n".join(b.text for b, y in zip(blocks, viterbi(scores, same, change, start), strict=True) if y)


# Labelled pages.


def _parts(page: str) -> tuple[list[tuple[str, str]], list[str]] | None:
    """(tag, text) of the blocks of a page's only `<article>`, and the texts around it; None where that isn't marked."""
    if len(re.findall(r"<article[\s>]", page, re.I)) != 1:
        return None
    inside, outside = [], []
    for b in leaf_blocks(re.sub(r"<article", "<article x-1", page, flags=re.I)):
        (inside if b.gold else outside).append((b.tag, b.text))
    return (inside, [x for _, x in outside]) if inside else None


def _tag(r: random.Random, choices: str) -> tuple[str, str]:
    open_ = r.choice(choices.split("|")).strip()
    return f"<{open_}>", f"</{open_.split()[0]}>"


def layout(r: random.Random, inside: list[tuple[str, str]], outside: list[str], prose: list[str]) -> str:
    """A page with the given article and furniture in one of many usual layouts; x-1 marks the article, x-0 the rest. `prose` feeds comments and teasers."""
    word = lambda: html.escape(r.choice(outside or prose).split(" ")[0][:20])
    line = lambda: html.escape(r.choice(prose))
    short = lambda: " ".join(line().split(" ")[: r.randrange(2, 7)])

    def within(choices: str, *inner: str) -> str:
        a, b = _tag(r, choices)
        return a[:-1] + " x-0>" + "".join(inner) + b

    def links() -> str:
        n = r.randrange(3, 9)
        if r.random() < 0.6:
            return "<ul>" + "".join(f'<li><a href="/{i}">{word() if r.random() < 0.6 else short()}</a></li>' for i in range(n)) + "</ul>"
        return r.choice([" | ", " ", " · "]).join(f'<a href="/{i}">{word()}</a>' for i in range(n))

    menu = lambda: within('nav|ul class="menu"|div class="navbar"|div id="nav"|nav class="main-navigation"|div class="breadcrumbs"|div role="navigation"', links())
    head = lambda: within('header|div id="header"|div class="site-header"|div class="masthead"|header class="banner"|div', f"<a href='/'>{word()}</a>" if r.random() < 0.5 else f"<h2>{word()}</h2>", f"<p>{short()}</p>" if r.random() < 0.5 else "", menu() if r.random() < 0.5 else "")
    ad = lambda: within('div class="ad"|div class="advert"|aside class="sponsored"|div class="ads banner-ad"|div id="ad-top"|section class="promo"', f"<p>{line()}</p>" if r.random() < 0.5 else line())
    notice = lambda: within('div class="cookie-notice"|div id="consent"|div role="dialog"|div class="alert"|section class="newsletter"|div class="gdpr-banner"|aside class="notice"', f"<p>{line()}</p>" if r.random() < 0.6 else line(), f"<button>{word()}</button>" if r.random() < 0.6 else "")
    side = lambda: within('aside|div class="sidebar"|div id="sidebar"|div class="widget"|aside class="related"|div class="related-posts"|div class="popular"|div class="social-share"', f"<h3>{short()}</h3>", links() if r.random() < 0.6 else f"<p>{line()}</p><p>{line()}</p>")
    form = lambda: within('form|form class="search"|form action="/signup"|div class="login-form"', f"<label>{short()}</label><input name=q><p>{line()}</p><button>{word()}</button>")
    foot = lambda: within('footer|div id="footer"|div class="site-footer"|div class="copyright"|footer class="legal"', f"<p>&copy; {word()} {line()}</p>" if r.random() < 0.5 else f"&copy; {word()} &middot; {line()}", links() if r.random() < 0.4 else "")

    def comments() -> str:
        a, b = _tag(r, 'div class="comment"|li class="comment"|article class="comment"|div class="reply"|div|p')
        said = lambda: f"{short()}<br>{line()}" if a == "<p>" else f"<b>{word()}</b><p>{line()}</p>" + (f"<p>{line()}</p>" if r.random() < 0.3 else "")
        return within('section id="comments"|div class="comments"|ol class="commentlist"|div id="disqus_thread"|section class="discussion"', f"<h3>{short()}</h3>", *(a + said() + b for _ in range(r.randrange(1, 6))), form() if r.random() < 0.3 else "")

    shut = r.random() < 0.8
    body = []
    for i, (tag, text) in enumerate(inside):
        text = html.escape(text)
        if tag not in ("h1", "h2", "h3", "h4"):
            tag = r.choices(["p", "div", "blockquote", "li", "h2", "pre"], [80, 5, 4, 4, 4, 3])[0]
        if r.random() < 0.15:
            a, b = (text + " ").split(" ", 1)
            text = r.choice([f"<b>{a}</b> {b}", f'<a href="#">{a}</a> {b}', f"<i>{a}</i> {b}"])
        made = f"<ul><li>{text}</ul>" if tag == "li" else f"<{tag}>{text}" + (f"</{tag}>" if shut or tag != "p" else "")
        body.append(f"<header>{made}</header>" if i == 0 and r.random() < 0.2 else made)
        if r.random() < 0.06:
            body.append(r.choice([ad, side, form, notice])())
    a, b = _tag(r, 'article|article|main|main id="content"|div class="post-content"|div id="content"|div class="entry"|section class="article-body"|div class="story"|div role="main"|div|td|section|div class="c1"')
    article = f"{a[:-1]} x-1>{''.join(body)}" + (comments() if r.random() < 0.15 else "") + b
    if r.random() < 0.3:
        article = f"<main>{article}{side() if r.random() < 0.4 else ''}</main>"
    before = [f() for f, p in ((notice, 0.3), (head, 0.7), (menu, 0.6), (ad, 0.3), (side, 0.2), (form, 0.1)) if r.random() < p]
    after = [f() for f, p in ((comments, 0.35), (side, 0.4), (ad, 0.25), (form, 0.2), (menu, 0.15), (notice, 0.2), (foot, 0.85)) if r.random() < p]
    page = "".join(before) + article + "".join(after)
    if a.startswith("<td"):
        page = f"<table><tr>{''.join(f'<td x-0>{x}</td>' for x in before)}{article}</tr></table>" + "".join(after)
    return f"<html><body>{f'<div class=page>{page}</div>' if r.random() < 0.3 else page}</body></html>"


#: Prose for tables without any page that marks its article.
_PROSE = ["The river rose in the night, and nobody in the village had slept.", "She wrote the letter again, this time without the apology.", "Prices fell for a third month.", "What the survey shows is less clear than its title."]


def labelled(pages: list[str]) -> list[str]:
    """Labelled pages: those given that mark their article, and layouts of their parts."""
    found = [(p, x) for p in pages if (x := _parts(p))]
    prose = [s for _, (inside, _) in found for _, s in inside if 20 < len(s) < 600] or _PROSE
    parts = [x for _, x in found] or [([("h1", _PROSE[2]), *(("p", s) for s in _PROSE)], ["Home", "News", "Contact"])] * 20
    r = random.Random(11)
    out = [re.sub(r"<article", "<article x-1", p, flags=re.I) for p, _ in found]
    for inside, outside in parts:
        for _ in range(LAYOUTS):
            out.append(layout(r, inside[:40], outside, prose))
    return out


def fit(pages: list[str]) -> list[float]:
    """Weights of largest likelihood over labelled pages, by gradient steps over all chains at once, forward and backward."""
    chains = []
    for p in pages:
        blocks = leaf_blocks(p)
        if blocks:
            same = [i > 0 and b.parent == blocks[i - 1].parent for i, b in enumerate(blocks)]
            chains.append(([features(b, i == 0) for i, b in enumerate(blocks)], [int(b.gold or 0) for b in blocks], same))
    weights = np.zeros(SIZE)
    if not chains:
        return weights.tolist()
    k, n, most = len(FEATURES), len(chains), max(len(c[0]) for c in chains)
    y, same, there = np.zeros((n, most), np.int64), np.zeros((n, most), np.int64), np.zeros((n, most), bool)
    x = np.zeros((sum(len(c[0]) for c in chains), k), np.float32)
    for i, (f, labels, s) in enumerate(chains):
        y[i, : len(f)], same[i, : len(f)], there[i, : len(f)] = labels, s, True
    for row, at in zip(x, (at for c in chains for at in c[0]), strict=True):
        row[at] = 1
    size = there.sum(1)
    rows = np.arange(n)
    seen = np.zeros(SIZE)
    seen[:k] = y[there] @ x
    for s, a, b in ((s, a, b) for s in (0, 1) for a in (0, 1) for b in (0, 1)):
        seen[k + 4 * s + 2 * a + b] = np.sum(there[:, 1:] & (same[:, 1:] == s) & (y[:, :-1] == a) & (y[:, 1:] == b))
    seen[k + 8 :] = np.bincount(y[:, 0], minlength=2)
    first, second = np.zeros(SIZE), np.zeros(SIZE)
    for step in range(1, PASSES + 1):
        score = np.zeros((n, most, 2))
        score[:, :, 1][there] = x @ weights[:k].astype(np.float32)
        change = weights[k : k + 8].reshape(2, 2, 2)[same]
        forward, backward = np.zeros((n, most, 2)), np.zeros((n, most, 2))
        forward[:, 0] = weights[k + 8 :] + score[:, 0]
        for t in range(1, most):
            forward[:, t] = np.logaddexp(*(forward[:, t - 1, a, None] + change[:, t, a] for a in (0, 1))) + score[:, t]
        for t in range(most - 2, -1, -1):
            on = np.logaddexp(*((backward[:, t + 1, b] + score[:, t + 1, b])[:, None] + change[:, t + 1, :, b] for b in (0, 1)))
            backward[:, t] = np.where(there[:, t + 1, None], on, 0)
        total = np.logaddexp(*forward[rows, size - 1].T)
        prob = np.exp(np.minimum(forward + backward - total[:, None, None], 0)) * there[:, :, None]
        hoped = np.zeros(SIZE)
        hoped[:k] = prob[:, :, 1][there].astype(np.float32) @ x
        pair = np.exp(np.minimum(forward[:, :-1, :, None] + change[:, 1:] + (score + backward)[:, 1:, None, :] - total[:, None, None, None], 0)) * there[:, 1:, None, None]
        for s in (0, 1):
            hoped[k + 4 * s : k + 4 * s + 4] = (pair * (same[:, 1:] == s)[:, :, None, None]).sum((0, 1)).ravel()
        hoped[k + 8 :] = prob[:, 0].sum(0)
        slope = (seen - hoped) / n - DECAY * weights / 10
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        weights += STEP * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return weights.tolist()


def train(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> list[float]:
    """Weights fitted on the TRAINING pages with the least hashes of their id, by one task; only ids are
    read to choose them, all tasks look for their rows, and only weights come to the driver."""
    ship(pages.sparkSession)
    short = pages.filter(F.length(col(html_col)) <= TRAINING_CHARS)
    ids = [r[0] for r in pages.select(col(id_col).alias("i")).filter("i IS NOT NULL").distinct().orderBy(F.xxhash64("i"), "i").limit(TRAINING).collect()]

    def run(batches):
        texts = sorted(x for batch in batches for x in batch.column(0).to_pylist())[:TRAINING]
        yield pa.RecordBatch.from_arrays([pa.array([fit(labelled(texts))], pa.list_(pa.float64()))], ["weights"])

    chosen = short.filter(col(id_col).isin(ids)).select(col(html_col).cast("string").alias("html"))
    got = chosen.repartition(1).mapInArrow(run, "weights array<double>").first() if ids else None
    return list(got[0]) if got else fit(labelled([]))


def extract(pages: DataFrame, weights: list[float], html_col: str = "html") -> DataFrame:
    """All rows and columns of `pages`, the text of the article in place of the html; null or without blocks: empty."""
    at = pages.columns.index(html_col)

    def run(batches):
        for batch in batches:
            texts = [main_text(x or "", weights) for x in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return mapped(pages, run)


def html_extraction(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, text and its code points.

    Whole pages, closed or cut off anywhere. A null or empty page has an empty text. Ids may repeat or
    be null; other columns are ignored; an empty table gives no rows. Pages are read once to extract
    them, with no shuffle; the model comes from a bounded sample.
    """
    plain = pages.select(col(id_col).alias("page_id"), col(url_col).alias("url"), col(html_col).cast("string").alias("text"))
    weights = train(pages, id_col, html_col)
    return extract(plain, weights, "text").withColumn("n_chars", F.length("text").cast("long"))


def op12_html_extraction(spark, sf_dir: str) -> DataFrame:
    return html_extraction(spark.read.parquet(f"{sf_dir}/pages.parquet"))
