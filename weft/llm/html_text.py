"""Main text of web pages by a tree-structured graphical model.

A page is parsed into a tree of block-level elements whose leaves are blocks of text. Each node is a binary
variable: does it hold content? Unary potentials come from the tag, words in class, id and role, the
block's length, share of links and punctuation, and depth; pairwise potentials connect parent and child, by the kind
of the child. Sum-product messages, upward and then downward, give exact marginals; blocks whose marginal is at least
0.5 are the text. Weights are trained here by gradient ascent on the log-likelihood of generated labelled pages
of many layouts. Pages are handled as one forest per batch, level by level, in numpy.
"""

from __future__ import annotations

import functools
import html as entities
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import batch_of, in_a_task, pick

# Where markup begins; the rest of a tag up to its ">" is read by ATTRIBUTES, or by LOOSE where quotes aren't closed before the page ends.
# No part of either is read twice, so a page takes time in proportion to its length.
MARKUP = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*+)|(!--)|[!?/])")
ATTRIBUTES = re.compile(r"""((?:[\s/]++|[^\s/>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)*+)>""")
LOOSE = re.compile(r"([^>]*+)>")
COMMENT_END, EMPTY_COMMENT = re.compile(r"--!?>"), re.compile(r"-?>")
#: Elements without content: of RAW_TEXT the inside is characters up to the end tag, of the others it is markup.
RAW_TEXT = {"script", "style", "title", "textarea", "noscript", "iframe", "noframes", "noembed", "xmp"}
RAW = {"template", "select", "button", "svg", "math", "foreignobject", "object", "canvas", "datalist", "audio", "video"}
#: What can't stand in an element without content, so that it ends it.
ENDS_PHRASE = set("article aside body footer form h1 h2 h3 h4 h5 h6 header main nav ol section table ul".split())
#: An end tag doesn't reach beyond these, unless it is of a table's own parts.
LIMITS = {"td", "th", "table", "template", "object"}
TABLE_PARTS = {"table", "tr", "td", "th", "tbody", "thead", "tfoot"}
MOST_DEPTH = 512
SCRIPT = re.compile(r"<!--(?:-?>)?|-->|</?script(?=[\s/>])", re.I)
BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html label legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - {"dd", "dt", "li", "td", "th", "tr", "tbody", "thead", "tfoot", "label", "legend", "head", "html", "body", "summary", "figcaption"} | {"li", "dd", "dt"}
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"})}
GROUPS = {t: i for i, t in enumerate("leaf html body article main section div p h1 h2 ul li nav header footer aside form table td blockquote pre figure dl other".split())}
GROUPS |= {"h3": GROUPS["h2"], "h4": GROUPS["h2"], "h5": GROUPS["h2"], "h6": GROUPS["h2"], "ol": GROUPS["ul"], "menu": GROUPS["nav"], "tr": GROUPS["td"], "th": GROUPS["td"], "tbody": GROUPS["table"], "thead": GROUPS["table"], "tfoot": GROUPS["table"], "figcaption": GROUPS["figure"], "dt": GROUPS["dl"], "dd": GROUPS["dl"], "fieldset": GROUPS["form"], "label": GROUPS["form"], "legend": GROUPS["form"], "search": GROUPS["form"]}
N_GROUPS = max(GROUPS.values()) + 1
NAMES = [re.compile(p) for p in (
    r"\b(ad|ads|adv|advert\w*|adsense|adbox|sponsor\w*|promo\w*|promotion|dfp)\b", r"nav|menu|crumb|pagina|pager|\btoc\b|\btabs?\b|toolbar|skip", r"header|masthead|topbar|brand|logo|\btop\b", r"foot|bottom|copyright|colophon|legal",
    r"side|widget|rail\b|related|recommend|popular|trending|\bmore\b|teaser|archive|tagcloud", r"cookie|consent|notice|gdpr|banner|alert|popup|modal|newsletter|subscri|sign|paywall|warning|info", r"comment|repl(y|ies)|discuss|disqus|respond|feedback|guestbook",
    r"shar(e|ing)|social|follow|tweet|facebook|like", r"form|search|login|contact|field|input", r"article|content|post\b|entry|story|\bmain\b|\btext\b|\bbody\b|hentry|prose", r"meta|byline|author|date|tags?\b|categor|caption|credit")]
N_NAMES = len(NAMES)
FIELDS = [N_GROUPS, *[2] * N_NAMES, 6, 4, 4, 5, 4, 2, 2, 2]
FIRST = np.concatenate([[0], np.cumsum(FIELDS)])[:-1]
N_FEATURES = sum(FIELDS)
LETTER = re.compile(r"[^\W\d_]")


NAMED = re.compile(r"""(?<![\w-])(?:class|id|role|aria-label|itemprop)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""", re.I)


@functools.lru_cache(20_000)
def flags_of(attributes: str) -> tuple[int, ...]:
    found = " ".join(a or b or c for a, b, c in NAMED.findall(attributes))
    words = re.sub(r"[^a-z0-9]+", " ", re.sub(r"([a-z])([A-Z])", r"\1 \2", found).lower())
    return tuple(int(bool(p.search(words))) for p in NAMES) if words.strip() else (0,) * N_NAMES


def name_flags(attributes: str) -> tuple[int, ...]:
    """Which kinds of names the attributes hold. Long ones aren't remembered."""
    return (flags_of if len(attributes) < 1000 else flags_of.__wrapped__)(attributes) if "=" in attributes else (0,) * N_NAMES


@functools.cache
def end_tag(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I)


def raw_end(source: str, tag: str, at: int) -> int | None:
    """Where the end tag of a raw text element begins that was opened before `at`; None without one."""
    end = end_tag(tag).search(source, at)
    if not end:
        return None
    start = end.start()
    if tag == "script" and source.find("<!--", at, start) >= 0:
        # inside a comment of a script, a script's own start and end tags are part of it
        inner = comment = False
        for m in SCRIPT.finditer(source, at):
            what = m[0].lower()
            if what in ("-->", "<!-->", "<!--->"):
                comment = inner = False
            elif what == "<!--":
                comment = True
            elif what == "<script":
                inner = comment
            elif inner:
                inner = False
            else:
                return m.start()
    return start


class Page:
    """parent, group and name flags of every node; leaves with their text."""

    __slots__ = ("parent", "group", "names", "texts", "links", "depth", "gold")

    def __init__(self, source: str, gold_word: str | None = None):
        self.parent, self.group, self.names, self.depth = [-1], [GROUPS["other"]], [(0,) * N_NAMES], [0]
        self.texts: dict[int, str] = {}
        self.links: dict[int, float] = {}
        self.gold: dict[int, bool] = {}
        stack: list[tuple[str, int, bool]] = [("#root", 0, False)]  # tag, node, is its content left out?
        open_tags: Counter = Counter()
        next_end: dict[str, int] = {}
        pieces: list[str] = []
        in_link = linked = 0
        at, rest_of_tag = 0, ATTRIBUTES

        def flush():
            nonlocal pieces, linked
            if pieces:
                text = " ".join("".join(pieces).split())
                if text:
                    node = self.add(stack[-1][1], GROUPS["leaf"], (0,) * N_NAMES)
                    self.texts[node] = text
                    self.links[node] = linked / max(1, len(text))
                    if gold_word is not None:
                        self.gold[node] = gold_word in text
                pieces, linked = [], 0

        def text_to(end: int):
            nonlocal linked
            if end > at and not stack[-1][2]:
                piece = source[at:end]
                piece = entities.unescape(piece) if "&" in piece else piece
                pieces.append(piece)
                if in_link:
                    linked += len(piece)

        def pop_to(k: int):
            flush()
            open_tags.subtract(t for t, _, _ in stack[k:])
            del stack[k:]

        def ends_later(tag: str) -> bool:
            if next_end.get(tag, -1) < at:
                found = end_tag(tag).search(source, at)
                next_end[tag] = found.start() if found else len(source) + 1
            return next_end[tag] <= len(source)

        def open_block(tag: str, attributes: str):
            nonlocal in_link
            for k in range(len(stack) - 1, 0, -1):
                if not stack[k][2]:
                    break
                if stack[k][0] in ("select", "datalist", "svg", "math") or (stack[k][0] == "button" and tag in ENDS_PHRASE):
                    pop_to(k)
                elif stack[k][0] in ("template", "object", "foreignobject"):
                    break
            out = stack[-1][2]
            if not out:
                flush()
                if tag in CLOSES_P:
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k][0] == "p":
                            pop_to(k)
                            break
                        if stack[k][0] in ("td", "th", "table", "button", "li", "div", "section", "article"):
                            break
                if tag in CLOSES:
                    same, limit = CLOSES[tag]
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k][0] in same:
                            pop_to(k)
                            if tag != "tr":
                                break
                        elif stack[k][0] in limit:
                            break
            if tag != "hr":
                in_link = 0 if tag in ("article", "main", "section") else in_link
                stack.append((tag, stack[-1][1] if out else self.add(stack[-1][1], GROUPS.get(tag, GROUPS["other"]), name_flags(attributes)), out))
                open_tags[tag] += 1

        pos = 0
        while m := MARKUP.search(source, pos):
            text_to(m.start())
            at = m.end()
            if not m[2]:
                if m[3]:
                    short = EMPTY_COMMENT.match(source, at) or COMMENT_END.search(source, at)
                    pos = at = short.end() if short else len(source)
                else:
                    pos = at = source.find(">", at) + 1 or len(source)
                continue
            tail = rest_of_tag.match(source, at)
            if not tail and rest_of_tag is ATTRIBUTES:
                rest_of_tag = LOOSE
                tail = LOOSE.match(source, at)
            if not tail:
                at = len(source)  # the page ends within a tag
                break
            pos = at = tail.end()
            tag, attributes = m[2].lower(), tail[1]
            if m[1]:
                if tag == "a":
                    in_link = 0
                elif open_tags[tag] > 0:
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k][0] == tag:
                            pop_to(k)
                            break
                        if stack[k][0] in LIMITS and (stack[k][0] == "table" or tag not in TABLE_PARTS) and tag not in ("body", "html"):
                            break
                continue
            empty = attributes[-1:] == "/" and attributes[-2:-1] in ("", " ", "\t", "\n", '"', "'")
            if tag in RAW_TEXT:
                if not empty and tag not in next_end:
                    end = raw_end(source, tag, at)
                    if end is not None:
                        tail = ATTRIBUTES.match(source, end + 2 + len(tag)) or LOOSE.match(source, end)
                        pos = at = tail.end() if tail else len(source)
                    elif tag in ("script", "style"):
                        pos = at = len(source)
                    else:
                        next_end[tag] = len(source) + 1  # never closed: as if it weren't there
            elif tag in RAW:
                if not empty and ends_later(tag):
                    if tag in ("button", "select"):  # one in another ends that
                        for k in range(len(stack) - 1, 0, -1):
                            if stack[k][0] == tag:
                                pop_to(k)
                            if not stack[k - 1][2]:
                                break
                    stack.append((tag, stack[-1][1], True))
                    open_tags[tag] += 1
            elif tag in BLOCK:
                open_block(tag, attributes)
            elif tag == "a":
                in_link = 1
            elif tag in ("br", "img", "input") and not stack[-1][2]:
                pieces.append(" ")
        text_to(len(source))
        flush()

    def add(self, parent: int, group: int, names: tuple[int, ...]) -> int:
        """A new node; beyond MOST_DEPTH levels, as in browsers, its parent's sibling."""
        if self.depth[parent] >= MOST_DEPTH:
            parent = self.parent[parent]
        self.parent.append(parent)
        self.group.append(group)
        self.names.append(names)
        self.depth.append(self.depth[parent] + 1)
        return len(self.parent) - 1


class Forest:
    """The nodes of many pages, with features, by level."""

    def __init__(self, pages: list[Page]):
        sizes = np.array([len(p.parent) for p in pages])
        base = np.concatenate([[0], np.cumsum(sizes)])
        self.base = base
        shift = np.repeat(base[:-1], sizes)
        self.parent = np.concatenate([p.parent for p in pages]).astype(np.int64) if len(pages) else np.zeros(0, np.int64)
        root = self.parent < 0
        self.parent += shift
        self.parent[root] = -1
        self.group = np.concatenate([p.group for p in pages])
        self.depth = np.concatenate([p.depth for p in pages])
        f = np.zeros((len(self.parent), len(FIELDS)), np.int64)
        f[:, 0] = self.group
        f[:, 1 : 1 + N_NAMES] = np.concatenate([np.array(p.names).reshape(-1, N_NAMES) for p in pages])
        c = 1 + N_NAMES
        leaf = np.array([base[i] + k for i, p in enumerate(pages) for k in p.texts], np.int64)
        text = [t for p in pages for t in p.texts.values()]
        links = np.array([x for p in pages for x in p.links.values()])
        if len(leaf):
            n = np.array([len(t) for t in text])
            f[leaf, c] = np.searchsorted([15, 40, 80, 200], n, "right") + 1
            f[leaf, c + 1] = np.searchsorted([0.1, 0.5], links, "right") + 1
            f[leaf, c + 2] = [1 + (t[-1] in ".!?…:\"'”") + (t[-1] in ".!?…\"'”" and len(t) > 60) for t in text]
            f[leaf, c + 6] = ["©" in t or "(c)" in t[:5] for t in text]
        f[:, c + 3] = np.minimum(self.depth // 2, 4)
        own = f[np.maximum(self.parent, 0), 0]
        f[:, c + 4] = np.select([own == GROUPS["p"], own == GROUPS["li"], np.isin(own, [GROUPS["h1"], GROUPS["h2"]])], [1, 2, 3], 0)
        order = np.argsort(self.depth, kind="stable")
        self.levels = np.split(order, np.searchsorted(self.depth[order], np.arange(1, int(self.depth.max(initial=0)) + 1)))[1:]
        # inside an article or main element; inside something named as boilerplate
        good, bad = np.isin(self.group, [GROUPS["article"], GROUPS["main"]]), np.zeros(len(f), bool)
        bad |= f[:, 1:10].any(1)
        bad |= np.isin(self.group, [GROUPS[x] for x in ("nav", "footer", "aside", "form")])
        for at in self.levels:
            good[at] |= good[self.parent[at]]
            bad[at] |= bad[self.parent[at]]
        f[:, c + 5], f[:, c + 7] = good, bad
        self.features = f + FIRST

    def marginals(self, w: np.ndarray, pair: np.ndarray):
        """(P(node is content), P(parent, child) of every edge, log partition function of all)."""
        n = len(self.parent)
        unary = np.zeros((n, 2))
        unary[:, 1] = w[self.features].sum(1)
        up = unary.copy()  # unary and messages of the children
        sent = np.zeros((n, 2))
        for at in reversed(self.levels):
            sent[at] = np.logaddexp.reduce(up[at][:, None, :] + pair[self.group[at]], axis=2)
            np.add.at(up, self.parent[at], sent[at])
        down = np.zeros((n, 2))  # message of the parent
        edge = np.zeros((n, 2, 2))
        for at in self.levels:
            p = self.parent[at]
            rest = up[p] + down[p] - sent[at]
            x = rest[:, :, None] + pair[self.group[at]]
            down[at] = np.logaddexp.reduce(x, axis=1)
            joint = x + up[at][:, None, :]
            edge[at] = np.exp(joint - np.logaddexp.reduce(joint.reshape(len(at), 4), axis=1)[:, None, None])
        belief = up + down
        return np.exp(belief[:, 1] - np.logaddexp(belief[:, 0], belief[:, 1])), edge


# == labelled pages


LAYOUTS = ["article", "main", "main article", "div", "nested div", "section", "table", "columns", "bare", "itemprop", "unclosed"]


def page(r: random.Random, layouts: list[str] = LAYOUTS) -> str:
    """A generated page in one of the layouts; every block of content holds the word zqx, and no other does."""
    word = lambda: "".join(r.choice(["th", "er", "on", "an", "re", "he", "in", "é", "sch", "ou", "la", "ción"]) for _ in range(r.randint(1, 5)))
    words = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    end = lambda: r.choice([".", ".", ".", "!", "?", "", ""])
    yes = lambda a, b: words(a, b) + " zqx" + end()
    maybe = lambda p, f: f() if r.random() < p else ""
    link = lambda: f'<a href="/{word()}">{words(1, 3)}</a>'
    items = lambda: "".join(f"<li>{link()}</li>" for _ in range(r.randint(2, 9)))
    cls = lambda *xs: r.choice([f' class="{r.choice(xs)}"', f' id="{r.choice(xs)}"', f' class="{word()} {r.choice(xs)}"'])

    nav = lambda: r.choice([lambda: f"<nav><ul>{items()}</ul></nav>", lambda: f"<div{cls('nav', 'menu', 'navbar', 'main-menu', 'breadcrumbs')}><ul>{items()}</ul></div>", lambda: f"<nav>{link()} | {link()} | {link()}</nav>", lambda: f"<ul{cls('menu', 'nav-list')}>{items()}</ul>"])()
    header = lambda: r.choice([lambda: f"<header><h1>{words(1, 3)}</h1><p>{words(2, 8)}</p>{nav()}</header>", lambda: f"<div{cls('header', 'masthead', 'site-header')}><p>{words(2, 6)}</p></div>", lambda: f'<header class="site-header"><div class="logo">{words(1, 3)}</div></header>'])()
    footer = lambda: r.choice([lambda: f"<footer>&copy; {word()}.example.com &middot; {words(3, 12)}{end()}</footer>", lambda: f"<div{cls('footer', 'site-footer')}><p>{words(3, 20)}{end()}</p><ul>{items()}</ul></div>", lambda: f"<footer><p>{words(4, 25)}{end()}</p><nav>{link()} {link()}</nav></footer>"])()
    ad = lambda: r.choice([lambda: f"<div{cls('ad', 'ads', 'advert', 'advertisement', 'sponsored', 'promo', 'ad-box')}>{maybe(0.4, lambda: '<p>')}{words(3, 30)}{end()}</div>", lambda: f'<aside class="ad"><p>{words(5, 30)}{end()}</p></aside>', lambda: f"<div{cls('ad', 'banner-ad')}><a href='/x'>{words(3, 10)}</a></div>"])()
    notice = lambda: r.choice([lambda: f"<div{cls('cookie', 'cookie-banner', 'notice', 'consent', 'gdpr', 'alert', 'newsletter')}><p>{words(8, 40)}{end()}</p>{maybe(0.5, lambda: '<button>OK</button>')}</div>", lambda: f'<div role="alert">{words(5, 30)}{end()}</div>', lambda: f'<section class="notice"><h2>{words(1, 4)}</h2><p>{words(5, 30)}{end()}</p></section>'])()
    side = lambda: r.choice([lambda: f"<aside><h3>{words(1, 3)}</h3><ul>{items()}</ul></aside>", lambda: f"<div{cls('sidebar', 'widget', 'related', 'recommended')}><h2>{words(1, 4)}</h2><p>{words(5, 40)}{end()}</p><ul>{items()}</ul></div>", lambda: f"<aside><p>{words(8, 50)}{end()}</p></aside>"])()
    form = lambda: r.choice([lambda: f"<form><label>{words(1, 3)}</label><input name='q'><p>{words(3, 20)}{end()}</p><button>Go</button></form>", lambda: f"<form{cls('search', 'login', 'contact')}>{words(1, 6)} <input><select><option>{word()}</option></select></form>"])()
    reader = lambda: f"<div class='comment'><p>{words(3, 60)}{end()}</p></div>"
    comments = lambda: r.choice([lambda: f"<section{cls('comments', 'comment-list', 'discussion', 'replies')}><h2>{words(1, 3)}</h2>{''.join(reader() for _ in range(r.randint(1, 6)))}</section>", lambda: f"<div{cls('comments', 'disqus_thread', 'respond')}><ul>{''.join(f'<li><p>{words(3, 50)}{end()}</p></li>' for _ in range(r.randint(1, 6)))}</ul></div>", lambda: f"<ol{cls('commentlist', 'comments')}>{''.join(f'<li>{words(3, 50)}{end()}</li>' for _ in range(r.randint(1, 5)))}</ol>", lambda: "".join(f"<article class='comment'><p>{words(3, 50)}{end()}</p></article>" for _ in range(r.randint(1, 4)))])()
    share = lambda: f"<div{cls('share', 'social')}>{link()} {link()} {words(0, 3)}</div>"

    def para() -> str:
        x = r.random()
        if x < 0.55:
            text = yes(1, r.choice([3, 20, 60, 120]))
            if r.random() < 0.25:
                text = f"{words(1, 10)} <a href='/{word()}'>{words(1, 4)}</a> {text}"
            return r.choice([f"<p>{text}</p>", f"<p>{text}", f"<p><b>{text}<br>", f"<div>{text}</div>", f"<p>{text}</p>"])
        if x < 0.68:
            return r.choice([f"<h2>{yes(1, 6)}</h2>", f"<h3>{yes(1, 6)}</h3>"])
        if x < 0.78:
            return f"<ul>{''.join(f'<li>{yes(1, 25)}</li>' for _ in range(r.randint(1, 6)))}</ul>"
        if x < 0.84:
            return f"<blockquote><p>{yes(3, 40)}</p></blockquote>"
        if x < 0.89:
            return f"<table><tr><td>{yes(1, 5)}</td><td>{yes(1, 5)}</td></tr><tr><td>{yes(1, 5)}<td>{yes(1, 5)}</table>"
        if x < 0.93:
            return f"<figure><img src='x'><figcaption>{yes(2, 12)}</figcaption></figure>"
        if x < 0.96:
            return f"<pre>{yes(2, 20)}</pre>"
        return f"<section><h2>{yes(1, 5)}</h2><p>{yes(5, 60)}</p></section>"

    body = []
    for _ in range(r.choice([0, 1, 2, 4, 8, 15])):
        body.append(para())
        body.append(maybe(0.05, ad))
        body.append(maybe(0.03, side))
        body.append(maybe(0.02, form))
        body.append(maybe(0.02, notice))
    title = r.choice([f"<h1>{yes(1, 12)}</h1>", f"<header><h1>{yes(1, 10)}</h1></header>", f"<h1>{yes(1, 12)}</h1>", ""])
    inner = title + "".join(body) + maybe(0.12, share) + maybe(0.08, comments)
    layout = r.choice(layouts + ["article", "article"] * ("article" in layouts))
    main = {
        "article": lambda: f"<article>{inner}</article>", "main": lambda: f"<main>{inner}</main>", "main article": lambda: f"<main role='main'><article{maybe(0.3, lambda: cls('post', 'entry', 'hentry'))}>{inner}</article></main>", "div": lambda: f"<div{cls('content', 'article', 'post', 'entry-content', 'main', 'story')}>{inner}</div>",
        "nested div": lambda: f"<div{cls('content', 'main', 'page', 'wrapper')}><div class='post'>{inner}</div>{maybe(0.3, side)}</div>", "section": lambda: f"<section{cls('article', 'content')}>{inner}</section>",
        "table": lambda: f"<table{maybe(0.5, lambda: cls('layout', 'wrapper'))}><tr><td{cls('menu', 'nav', 'left')}><ul>{items()}</ul></td><td{maybe(0.7, lambda: cls('content', 'main', 'body'))}>{inner}</td></tr></table>",
        "columns": lambda: f"<div class='container'><div class='row'><div class='col-8'>{inner}</div><div class='col-4 sidebar'><h3>{words(1, 3)}</h3><ul>{items()}</ul></div></div></div>", "bare": lambda: inner,
        "itemprop": lambda: f"<div itemscope><div itemprop='articleBody'>{inner}</div></div>", "unclosed": lambda: f"<div id=main class='content x'><article>{inner}",
    }[layout]()
    before = maybe(0.6, nav) + maybe(0.4, header) + maybe(0.4, ad) + maybe(0.3, notice) + maybe(0.1, form) + maybe(0.2, side)
    after = maybe(0.25, comments) + maybe(0.3, side) + maybe(0.2, ad) + maybe(0.15, form) + maybe(0.1, notice) + maybe(0.7, footer)
    script = lambda: r.choice(["<script>for(var i=0;i<n;i++){f(i)}</script>", "<script>var t=\"</p>\";</script>", "<script>if(a<b&&c>d){s='<div class=x>'}</script>", "<script><!-- x<y --></script>", "<style>a>b{content:'<p>'}</style>", "<noscript><p>no</p></noscript>", "<svg><title>x</title><path d='M0'/></svg>", "<!-- <p>old</p> <!-- -->", "<template><p>t</p></template>", ""])
    return f"<!DOCTYPE html><html><head><title>{words(1, 5)}</title><style>p{{}}</style>{script()}</head><body>{script()}{before}<!-- x -->{main}{script()}{after}" + r.choice(["</body></html>", ""])


@functools.cache
def train(count: int = 1500, rounds: int = 120, seed: int = 3, layouts: tuple[str, ...] = tuple(LAYOUTS)) -> tuple[np.ndarray, np.ndarray]:
    """(unary weights, pairwise potentials by the child's group) from `count` generated pages."""
    r = random.Random(seed)
    pages = [Page(page(r, list(layouts)), "zqx") for _ in range(count)]
    forest = Forest(pages)
    y = np.zeros(len(forest.parent), np.int64)
    y[[forest.base[i] + k for i, p in enumerate(pages) for k, v in p.gold.items() if v]] = 1
    for at in reversed(forest.levels):
        np.maximum.at(y, forest.parent[at], y[at])
    child = forest.parent >= 0
    group, parent = forest.group[child], forest.parent[child]
    w, pair = np.zeros(N_FEATURES), np.zeros((N_GROUPS, 2, 2))
    seen = np.zeros_like(pair)
    np.add.at(seen, (group, y[parent], y[child]), 1)
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(pair), np.zeros_like(pair)]
    for k in range(1, rounds + 1):
        marginal, edge = forest.marginals(w, pair)
        g = np.bincount(forest.features.ravel(), np.repeat(y - marginal, forest.features.shape[1]), N_FEATURES)
        expect = np.zeros_like(pair)
        np.add.at(expect, group, edge[child])
        for i, (p, d) in enumerate(((w, g - 0.5 * w), (pair, seen - expect - 0.5 * pair))):
            m, v = state[2 * i], state[2 * i + 1]
            m += 0.1 * (d - m)
            v += 0.01 * (d * d - v)
            p += 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return w, pair


def main_texts(sources: list[str], w: np.ndarray, pair: np.ndarray) -> list[str]:
    pages = [Page(s) for s in sources]
    if not pages:
        return []
    forest = Forest(pages)
    content, _ = forest.marginals(w, pair)
    return ["\n".join(t for k, t in p.texts.items() if content[b + k] >= 0.5) for p, b in zip(pages, forest.base)]


RESULT = pa.schema([("id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", training_pages: int = 1500) -> DataFrame:
    """One row per input row: id, url, text, n_chars (code points of text).

    text: blocks of content in page order, joined by one line feed; white space inside a block is one space; character
    references are decoded. Nulls: a null or empty page has an empty text; null ids and urls are kept, as are
    repeated rows. Whole pages are read. Other columns are ignored; an empty table gives an empty result. The model is trained
    on `training_pages` generated pages (a bound that doesn't depend on the data).
    """
    w, pair = in_a_task(pages.sparkSession, train, training_pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 200):
                part = b.slice(lo, 200)
                ids, urls = part.column(0).to_pylist(), part.column(1).to_pylist()
                texts = main_texts([x or "" for x in part.column(2).to_pylist()], w, pair)
                yield batch_of(RESULT, [(i, u, t, len(t)) for i, u, t in zip(ids, urls, texts)])

    three = pick(pages, i=id_col, u=url_col, h=html_col).select(F.col("i").cast("long").alias("i"), F.col("u").cast("string").alias("u"), F.col("h").cast("string").alias("h"))
    return three.mapInArrow(run, "id long, url string, text string, n_chars long").toDF(id_col, url_col, "text", "n_chars")
