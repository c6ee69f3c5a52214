"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the DOM.

A page is read once, in linear time, into leaf blocks: runs of text between the starts and ends of
block elements, each with the tags and the class, id and role words of its ancestors.  A block's
score is a sum of feature weights (ancestor tags and words, its own tag, length, links, ending,
signs, short words); a pair of neighbours adds a weight for their two labels, one set for each way
in which they lie to each other.  Weights are fitted by gradient steps on the
conditional likelihood (forward and backward sums over all training pages at once) and pages are
decoded by Viterbi.

The tables hold no labels, so the labelled pages come from ``labelled_pages``: page layouts with
menus, notices, adverts, forms, sidebars, comments and footers around an article, in semantic and in
plain markup, drawn by a seed; in them every block of the article starts with a private mark.  The
number of pages is a parameter, and nothing of the corpus is fitted.

Defined results: a null or empty page, and one without main text, gives the empty text; references
are decoded as browsers do (also without a semicolon where the standard allows it); white space is
what Unicode calls so; scripts, styles, templates, titles, text areas and embedded frames hold no
text; an unclosed comment, script or quote ends as browsers or their simplest recovery would end it;
elements deeper than ``DEEPEST`` count to the element there; a page of any length is read whole;
repeated rows give repeated results and other columns are ignored.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortflow.llm.common import bounded, released

DEEPEST = 512                     # nesting from which on elements are flattened
MARK = "\ue000"                   # starts every block of the article in a labelled page

# Element names of the HTML standard, by how they are read.
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure "
                   "footer form h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu nav ol optgroup option p pre section select "
                   "summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style textarea title iframe noembed noframes template xmp".split())
ENDS_P = BLOCKS - frozenset("body button html head option optgroup".split()) | {"hr"}
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
           "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
           "tbody": ({"thead", "tbody"}, {"table"}), "tfoot": ({"thead", "tbody"}, {"table"}), "p": ({"p"}, set())}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())          # the end of one ends any
P_SCOPE = frozenset("button caption table td th".split())

_OPEN = re.compile(r"<(?:!--|[!?]|/?[A-Za-z])")
_NAME = re.compile(r"/?([A-Za-z][^\s/>]*+)")
_REST = re.compile(r"""(?:[^"'>]++|"[^"]*+"|'[^']*+')*+>""")
_ATTR = re.compile(r"""([^\s"'<>/=]++)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


# ------------------------------------------------------------------ leaf blocks

@dataclass
class Element:
    tag: str
    inside: frozenset             # features of this element and its ancestors
    number: int


@dataclass
class Block:
    text: str
    inside: frozenset
    around: frozenset             # the features of the element that holds its own
    parent: int                   # the number of its own element
    tag: str
    linked: float                 # share of its characters in links


def _attributes(source: str) -> frozenset:
    out = set()
    for m in _ATTR.finditer(source):
        name = m.group(1).lower()
        value = m.group(2) or m.group(3) or m.group(4) or ""
        if name in ("class", "id", "role", "itemprop"):
            out |= {"word:" + w.lower() for w in _WORD.findall(value)}
        elif name == "style" and "none" in value.lower() and "display" in value.lower():
            out.add("word:hidden")
    if re.search(r"(?i)(?<![\w-])hidden(?![\w-])", _ATTR.sub(" ", source)):
        out.add("word:hidden")
    return frozenset(out)


class _Reader:
    def __init__(self):
        self.blocks: list[Block] = []
        self.stack = [Element("", frozenset(), 0)]
        self.open: dict[str, int] = {}
        self.link = 0                                # depth of the open link, if any
        self.count = 0
        self.text: list[str] = []
        self.chars = [0, 0]                          # of the block: outside and inside links

    def flush(self):
        if self.text:
            text = " ".join("".join(self.text).split())
            self.text = []
            if text:
                held = (e for e in reversed(self.stack) if e.tag in BLOCKS or not e.tag)
                top = next(held)
                around = next(held, top).inside
                self.blocks.append(Block(text, self.stack[-1].inside, around, top.number, top.tag, self.chars[1] / max(1, sum(self.chars))))
        self.chars = [0, 0]

    def add(self, raw: str):
        text = unescape(raw) if "&" in raw else raw
        self.text.append(text)
        self.chars[1 if self.link else 0] += len(text.strip())

    def pop(self):
        e = self.stack.pop()
        self.open[e.tag] -= 1
        if self.link > len(self.stack):
            self.link = 0

    def close_to(self, tags, scope) -> None:
        """End the innermost open element of ``tags``, if it lies inside the innermost one of ``scope``."""
        if not any(self.open.get(t) for t in tags):
            return
        for i in range(len(self.stack) - 1, 0, -1):
            tag = self.stack[i].tag
            if tag in tags:
                while len(self.stack) > i:
                    self.pop()
                return
            if tag in scope:
                return

    def start(self, tag: str, rest: str):
        if tag in BLOCKS or tag == "hr":
            self.flush()
        if tag == "br":
            self.text.append(" ")
        if tag in ENDS_P:
            self.close_to({"p"}, P_SCOPE)
        if tag in IMPLIED and tag != "p":
            self.close_to(*IMPLIED[tag])
        if tag in VOID or rest.endswith("/") and tag not in BLOCKS and tag != "a":
            return
        if tag == "a":
            self.link = len(self.stack) + 1
        if len(self.stack) > DEEPEST:
            return
        top = self.stack[-1]
        own = {"in:" + tag} | (_attributes(rest) if "=" in rest or "hidden" in rest else frozenset())
        self.count += 1
        self.stack.append(Element(tag, top.inside if own <= top.inside else top.inside | own, self.count))
        self.open[tag] = self.open.get(tag, 0) + 1

    def end(self, tag: str):
        if tag in BLOCKS:
            self.flush()
        if tag == "a":
            self.link = 0
        if tag in BLOCKS:
            self.close_to(HEADINGS if tag in HEADINGS else {tag}, ())
        else:                                        # an inline end does not close blocks around it
            self.close_to({tag}, BLOCKS)


def leaf_blocks(html: str) -> list[Block]:
    """The blocks of a page that have text, in page order."""
    r, at, plain = _Reader(), 0, False
    while True:
        m = _OPEN.search(html, at)
        if m is None:
            r.add(html[at:])
            break
        if m.start() > at:
            r.add(html[at:m.start()])
        mark = m.group()
        if mark == "<!--":
            if html.startswith((">", "->"), m.end()):
                at = html.index(">", m.end()) + 1
                continue
            stop = html.find("-->", m.end())
            at = len(html) if stop < 0 else stop + 3
            continue
        if mark in ("<!", "<?"):
            stop = html.find(">", m.end())
            at = len(html) if stop < 0 else stop + 1
            continue
        name = _NAME.match(html, m.start() + 1)
        rest = None if plain else _REST.match(html, name.end())
        if rest is None:
            plain = True                             # a quote never closes: from here on the next > ends a tag
            stop = html.find(">", name.end())
            at, inner = (len(html), html[name.end():]) if stop < 0 else (stop + 1, html[name.end():stop])
        else:
            at, inner = rest.end(), rest.group()[:-1]
        tag = name.group(1).lower()
        if mark.startswith("</"):
            r.end(tag)
        elif tag in SILENT:
            stop = re.compile(rf"</{tag}(?![^\s/>])", re.I).search(html, at)
            if stop is None:
                break
            at = html.find(">", stop.end()) + 1 or len(html)
        else:
            r.start(tag, inner)
    r.flush()
    return r.blocks


# ------------------------------------------------------------------ features

def _level(x: float, steps) -> int:
    return sum(x >= s for s in steps)


def text_features(b: Block, place: float) -> list[str]:
    t = b.text
    words = t.split(" ")
    letters = sum(map(str.isalpha, t[:400])) or 1
    upper = sum(map(str.isupper, t[:400]))
    out = ["bias", "tag:" + b.tag, f"chars:{_level(len(t), (8, 16, 32, 64, 128, 256, 512))}", f"words:{_level(len(words), (2, 4, 7, 12, 25, 60))}",
           f"linked:{_level(b.linked, (0.01, 0.3, 0.6, 0.9))}", f"place:{_level(place, (0.1, 0.5, 0.9))}",
           "ends:" + ("stop" if t[-1] in ".!?…。\"”»'" else "colon" if t[-1] in ":…" else "other"),
           f"stops:{_level(sum(map(t.count, '.!?')), (1, 2, 4))}", f"commas:{_level(t.count(','), (1, 3))}",
           f"upper:{_level(upper / letters, (0.05, 0.2, 0.6))}", f"tag+linked:{b.tag}:{b.linked > 0.5}", f"tag+words:{b.tag}:{_level(len(words), (4, 12))}"]
    out += ["sign:" + s for s in "©|»«›→•@" if s in t[:400]]
    if len(words) <= 12:
        out += ["text:" + w for w in {w.strip(".,:;!?()[]").lower() for w in words} if w]
    return out


class Scorer:
    """Emission scores of blocks; the part of the ancestors is computed once per distinct set."""

    def __init__(self, weights: dict[str, float]):
        self.weights, self.known = weights, {}

    def inside(self, features: frozenset) -> float:
        got = self.known.get(features)
        if got is None:
            if len(self.known) > 50_000:
                self.known.clear()
            got = self.known[features] = sum(self.weights.get(f, 0.0) for f in features)
        return got

    def scores(self, blocks: list[Block]) -> np.ndarray:
        w, n = self.weights, max(1, len(blocks) - 1)
        return np.array([self.inside(b.inside) + sum(w.get(f, 0.0) for f in text_features(b, i / n)) for i, b in enumerate(blocks)])


# ------------------------------------------------------------------ the chain

@dataclass
class Model:
    weights: dict[str, float]     # of label 1 (main text) against label 0
    pairs: np.ndarray             # (relation to the block before, label before, label)


def relations(blocks: list[Block]) -> np.ndarray:
    """How each block but the first lies to the one before it: 2 in its element or in one of its kind beside it, 1 in another one beside it, 0 elsewhere."""
    return np.array([2 if a.parent == b.parent else (a.around == b.around) * (1 + (a.tag == b.tag)) for a, b in zip(blocks, blocks[1:])], dtype=np.int64)


def viterbi(scores: np.ndarray, same: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """The likeliest labels; ties go to 0."""
    if not len(scores):
        return np.zeros(0, dtype=np.int64)
    out, s0, s1 = np.zeros((len(scores), 2), dtype=np.int8), 0.0, float(scores[0])
    table = pairs.tolist()
    for i, (e, k) in enumerate(zip(scores[1:].tolist(), same.tolist()), 1):
        t = table[k]
        a0, a1, b0, b1 = s0 + t[0][0], s1 + t[1][0], s0 + t[0][1], s1 + t[1][1]
        out[i] = a1 > a0, b1 > b0
        s0, s1 = max(a0, a1), max(b0, b1) + e
    label = np.zeros(len(scores), dtype=np.int64)
    label[-1] = s1 > s0
    for i in range(len(scores) - 1, 0, -1):
        label[i - 1] = out[i, label[i]]
    return label


def _lse(a, b):
    m = np.maximum(a, b)
    return m + np.log1p(np.exp(-np.abs(a - b)))


def _expectations(e: np.ndarray, same: np.ndarray, mask: np.ndarray, pairs: np.ndarray):
    """(probabilities of label 1, expected pairs, log sums) of padded pages (pages, blocks)."""
    pages, n = e.shape
    score = np.stack([np.zeros_like(e), e], axis=2)
    step = pairs[same]                                                  # (pages, n, 2, 2): from the block before
    f = np.zeros((n, pages, 2))
    f[0] = score[:, 0]
    for i in range(1, n):
        t = step[:, i]
        new = _lse(f[i - 1][:, 0, None] + t[:, 0], f[i - 1][:, 1, None] + t[:, 1]) + score[:, i]
        f[i] = np.where(mask[:, i, None], new, f[i - 1])
    b = np.zeros((n, pages, 2))
    for i in range(n - 2, -1, -1):
        t, after = step[:, i + 1], b[i + 1] + score[:, i + 1]
        new = _lse(t[:, :, 0] + after[:, None, 0], t[:, :, 1] + after[:, None, 1])
        b[i] = np.where(mask[:, i + 1, None], new, 0.0)
    z = _lse(f[-1][:, 0], f[-1][:, 1])
    one = np.exp(np.clip(f + b - z[None, :, None], -50, 0))[:, :, 1].T * mask
    two = np.zeros_like(pairs)
    for i in range(1, n):
        p = np.exp(np.clip(f[i - 1][:, :, None] + step[:, i] + (score[:, i] + b[i])[:, None, :] - z[:, None, None], -50, 0)) * mask[:, i, None, None]
        for k in range(len(pairs)):
            two[k] += p[same[:, i] == k].sum(axis=0)
    return one, two, z


def fit(pages: list[tuple[list[Block], list[int]]], steps: int = 300, rate: float = 0.15, penalty: float = 2e-5, least: int = 3) -> Model:
    """Adam on the penalised conditional log-likelihood; features of fewer than ``least`` pages are left out."""
    pages = [p for p in pages if p[0]]
    seen: dict[str, int] = {}
    rows = []
    for blocks, _ in pages:
        mine = [[*b.inside, *text_features(b, i / max(1, len(blocks) - 1))] for i, b in enumerate(blocks)]
        rows.append(mine)
        for f in {f for x in mine for f in x}:
            seen[f] = seen.get(f, 0) + 1
    names = sorted(f for f, n in seen.items() if n >= least)
    index = {f: i for i, f in enumerate(names)}
    n, width = len(pages), max(len(b) for b, _ in pages)
    mask, gold, same = np.zeros((n, width), dtype=bool), np.zeros((n, width)), np.zeros((n, width), dtype=np.int64)
    where, what = [], []
    for p, ((blocks, labels), mine) in enumerate(zip(pages, rows)):
        mask[p, :len(blocks)], gold[p, :len(blocks)], same[p, 1:len(blocks)] = True, labels, relations(blocks)
        for i, x in enumerate(mine):
            ids = [index[f] for f in x if f in index]
            where += [p * width + i] * len(ids)
            what += ids
    where, what = np.array(where), np.array(what)
    g = gold.astype(np.int64)
    true_pairs = np.zeros((3, 2, 2))
    np.add.at(true_pairs, (same[:, 1:][mask[:, 1:]], g[:, :-1][mask[:, 1:]], g[:, 1:][mask[:, 1:]]), 1)
    true_one = np.bincount(what, weights=gold.ravel()[where], minlength=len(names))
    total = mask.sum()
    x = np.zeros(len(names) + true_pairs.size)
    m1, m2 = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, steps + 1):
        w, pairs = x[:len(names)], x[len(names):].reshape(true_pairs.shape)
        e = np.bincount(where, weights=w[what], minlength=n * width).reshape(n, width)
        one, two, _ = _expectations(e, same, mask, pairs)
        grad = np.concatenate([np.bincount(what, weights=one.ravel()[where], minlength=len(names)) - true_one, (two - true_pairs).ravel()]) / total + penalty * x
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad * grad
        x = x - rate * min(1.0, 2 * (1 - step / (steps + 1))) * (m1 / (1 - 0.9 ** step)) / (np.sqrt(m2 / (1 - 0.99 ** step)) + 1e-8)
    return Model(dict(zip(names, x.tolist())), x[len(names):].reshape(true_pairs.shape).copy())


# ------------------------------------------------------------------ labelled pages

# Words that sites use in class and id attributes, and short phrases around articles.
_ARTICLE = "article post entry story content post-content entry-content article-body story-body main-content text body page-content".split()
_MENU = "nav menu navbar navigation main-menu topnav breadcrumbs breadcrumb tabs".split()
_HEADER = "header masthead site-header top banner-top logo branding".split()
_SIDE = "sidebar aside widget related recommended teaser rail trending popular side-column".split()
_NOTICE = "cookie cookie-notice notice alert gdpr consent banner message privacy-notice".split()
_AD = "ad ads advert advertisement sponsored promo promotion ad-slot adbox".split()
_FORM = "form newsletter subscribe signup search login search-form contact".split()
_COMMENTS = "comments comment-list responses replies discussion comment reply disqus thread".split()
_FOOTER = "footer site-footer bottom copyright legal colophon".split()
_SHARE = "share social sharing share-bar social-links follow tags".split()
_PHRASES = {
    "notice": ["We use cookies to improve your experience.", "This site uses cookies.", "Accept all", "Wir verwenden Cookies.", "Nous utilisons des cookies.", "Usamos cookies."],
    "form": ["Search", "Subscribe", "Your email", "Sign up for our newsletter", "Log in", "Send", "Name", "Suche", "Anmelden", "Rechercher", "Buscar"],
    "comments": ["Comments", "Leave a reply", "3 comments", "Reply", "Kommentare", "Commentaires", "Comentarios", "Posted by"],
    "share": ["Share", "Tweet", "Share this", "Print", "Email", "Teilen", "Partager", "Compartir"],
    "side": ["Related", "Most read", "Read also", "Popular", "Trending", "Mehr", "Plus", "Más"],
    "ad": ["Advertisement", "Sponsored", "Anzeige", "Publicité", "Publicidad"],
    "footer": ["All rights reserved.", "Privacy policy", "Terms of use", "Contact", "Impressum", "Mentions légales", "Aviso legal"]}


class _Pages:
    """Draws pages; every text of the article carries ``MARK``."""

    def __init__(self, seed: int):
        self.rng = random.Random(seed)
        letters = ["bcdfghklmnprstvwz", "aeiouäéèôñü"]
        self.words = ["".join(self.rng.choice(letters[k % 2]) for k in range(self.rng.randint(1, 9))) for _ in range(4_000)]

    def chance(self, p: float) -> bool:
        return self.rng.random() < p

    def phrase(self, least: int, most: int) -> str:
        return " ".join(self.rng.choice(self.words) for _ in range(self.rng.randint(least, most)))

    def prose(self, most: int = 8) -> str:
        out = []
        for _ in range(self.rng.randint(1, most)):
            s = self.phrase(1, 22)
            if self.chance(0.3):
                s = s.replace(" ", ", ", 1)
            out.append(s.capitalize() + self.rng.choice("....!?"))
        text = " ".join(out)
        if self.chance(0.06):                        # lists, tables and noise that pages hold as plain text
            text = text.replace(" ", self.rng.choice([" | ", "*** ", "&amp;&amp;&amp; ", " - "])) + self.rng.choice(["", " |", "%%%", " ###"])
        elif self.chance(0.03):
            text = " ".join([self.phrase(1, 1)] * self.rng.randint(2, 60))
        return text.replace(" ", self.rng.choice(["&amp; ", " &#8211; ", "%% ", "*** "]), 2) if self.chance(0.15) else text

    def box(self, words, inner: str, tag: str | None = None, semantic: float = 0.5) -> str:
        if tag and self.chance(semantic):
            attr = f' class="{self.rng.choice(words)}"' if self.chance(0.4) else ""
            return f"<{tag}{attr}>{inner}</{tag}>"
        name = self.rng.choice(["class", "class", "id"])
        extra = " " + self.phrase(1, 1) if self.chance(0.3) else ""
        box = self.rng.choice(["div", "div", "section", "td" if self.chance(0.2) else "div"])
        return f'<{box} {name}="{self.rng.choice(words)}{extra}">{inner}</{box}>'

    def link(self, least: int = 1, most: int = 3) -> str:
        return f'<a href="/{self.rng.choice(self.words)}">{self.phrase(least, most)}</a>'

    def links(self, most: int = 9, words: int = 3) -> str:
        many = [self.link(1, words) for _ in range(self.rng.randint(2, most))]
        if self.chance(0.7):
            tag = self.rng.choice(["ul", "ul", "ol"])
            return f"<{tag}>" + "".join(f"<li>{x}" + "</li>" * self.chance(0.9) for x in many) + f"</{tag}>"
        return self.rng.choice([" | ", " ", " &raquo; "]).join(many)

    def aside(self) -> str:
        head = f"<h3>{self.rng.choice(_PHRASES['side']) if self.chance(0.6) else self.phrase(1, 3)}</h3>" if self.chance(0.7) else ""
        return self.box(_SIDE, head + (self.links(8, 9) if self.chance(0.7) else f"<p>{self.prose(2)}</p>"), "aside")

    def advert(self) -> str:
        return self.box(_AD, self.rng.choice([self.prose(2), f"<p>{self.prose(3)}</p>", self.rng.choice(_PHRASES["ad"]), self.link(3, 9)]))

    def notice(self) -> str:
        text = self.rng.choice([self.rng.choice(_PHRASES["notice"]), self.prose(3)])
        return self.box(_NOTICE, self.rng.choice([text, f"<p>{text}</p>"]) + ("<button>OK</button>" if self.chance(0.4) else ""))

    def form(self) -> str:
        parts = [f"<label>{self.rng.choice(_PHRASES['form'])}</label><input name=x>", f"<p>{self.prose(2)}</p>", f"<button>{self.rng.choice(_PHRASES['form'])}</button>",
                 "<select><option>" + self.phrase(1, 2) + "<option>" + self.phrase(1, 2) + "</select>"]
        inner = "".join(self.rng.sample(parts, self.rng.randint(1, 4)))
        return f"<form>{inner}</form>" if self.chance(0.6) else self.box(_FORM, f"<form>{inner}</form>" if self.chance(0.5) else inner)

    def comments(self) -> str:
        one = lambda: self.box(_COMMENTS, f"<b>{self.phrase(1, 2)}</b> {self.rng.randint(1, 28)}.{self.rng.randint(1, 12)}.2020 <p>{self.prose(5)}</p>", "article" if self.chance(0.2) else "li")
        head = f"<h2>{self.rng.choice(_PHRASES['comments'])}</h2>" if self.chance(0.7) else ""
        return self.box(_COMMENTS, head + "".join(one() for _ in range(self.rng.randint(1, 5))))

    def share(self) -> str:
        return self.box(_SHARE, self.rng.choice([" ".join(self.rng.sample(_PHRASES["share"], 3)), self.links(4, 1)]))

    def paragraphs(self) -> str:
        """The article's own blocks; some pages leave paragraphs or bold text unclosed."""
        out = []
        loose, plain = self.chance(0.25), self.chance(0.1)
        for _ in range(self.rng.choice([1, 2, 4, 7, 12, 20])):
            text, kind = self.prose(9), self.rng.random()
            if plain:
                out.append(f"{MARK}{text}<br><br>" if self.chance(0.3) else f"<div>{MARK}{text}</div>")
            elif kind < 0.7:
                if self.chance(0.2):
                    text = text.replace(" ", f" {self.link()} ", 1)
                out.append(f"<p>{MARK}{text}" + ("" if loose else "</p>"))
            elif kind < 0.78:
                out.append(f"<p><b>{MARK}{text}<br>" if loose else f"<p><b>{MARK}{text}</b></p>")
            elif kind < 0.86:
                out.append(f"<h{(level := self.rng.choice('234'))}>{MARK}{self.phrase(1, 7)}</h{level}>")
            elif kind < 0.9:
                out.append(f"<blockquote>{MARK}{text}</blockquote>")
            elif kind < 0.95:
                out.append("<ul>" + "".join(f"<li>{MARK}{self.prose(2)}</li>" for _ in range(self.rng.randint(1, 5))) + "</ul>")
            elif kind < 0.975:
                out.append(f"<figure><img src=x><figcaption>{MARK}{self.phrase(3, 9)}</figcaption></figure>")
            else:
                out.append("<table>" + "".join(f"<tr><td>{MARK}{self.phrase(1, 3)}</td><td>{MARK}{self.rng.randint(1, 999)}</td></tr>" for _ in range(3)) + "</table>")
            if self.chance(0.06):
                out.append(self.rng.choice([self.advert, self.aside, self.form, self.share])())
        return "".join(out)

    def page(self) -> str:
        title = f"<h1>{MARK}{self.phrase(2, 9)}</h1>" if self.chance(0.85) else ""
        inner = title + (self.share() if self.chance(0.2) else "") + self.paragraphs() + (self.share() if self.chance(0.2) else "")
        if self.chance(0.15):
            inner += self.comments()
        body = self.box(_ARTICLE, inner, self.rng.choice(["article", "article", "main"]), 0.6)
        if self.chance(0.3):
            body = self.box(_ARTICLE, body, "main")
        before = [f for f, p in ((self.notice, 0.3), (self.advert, 0.5), (self.form, 0.2), (self.aside, 0.2)) if self.chance(p)]
        after = [f for f, p in ((self.comments, 0.35), (self.aside, 0.35), (self.advert, 0.3), (self.form, 0.2), (self.notice, 0.15)) if self.chance(p)]
        head = self.box(_HEADER, self.rng.choice([self.phrase(1, 3), f"<h2>{self.phrase(1, 4)}</h2>{self.links(5)}"]), "header") if self.chance(0.4) else ""
        menu = self.box(_MENU, self.links(), "nav") if self.chance(0.85) else ""
        foot = self.box(_FOOTER, self.rng.choice([f"&copy; {self.phrase(1, 3)} &middot; {self.prose(1)}", f"<p>&copy; 2020 {self.phrase(1, 3)}. {self.rng.choice(_PHRASES['footer'])}</p>",
                                                  self.links(6) + f"<p>{self.rng.choice(_PHRASES['footer'])}</p>", f"<p>{self.prose(2)}</p>"]), "footer") if self.chance(0.85) else ""
        order = [head, menu] if self.chance(0.7) else [menu, head]
        cut = "" if self.chance(0.2) else "</body></html>"
        return (f"<!DOCTYPE html><html><head><title>{self.phrase(2, 6)}</title><style>p{{margin:0}}</style></head><body>" + "".join(order)
                + "<!-- " + self.phrase(1, 2) + " -->" + "".join(f() for f in before) + body + "".join(f() for f in after) + foot + cut)


def labelled_pages(n: int, seed: int = 11) -> list[str]:
    """``n`` invented pages; the blocks of their articles start with ``MARK``."""
    draw = _Pages(seed)
    return [draw.page() for _ in range(n)]


def labelled_blocks(html: str) -> tuple[list[Block], list[int]]:
    """The blocks of a labelled page without the marks, and their labels."""
    blocks = leaf_blocks(html)
    labels = [int(MARK in b.text) for b in blocks]
    for b in blocks:
        b.text = " ".join(b.text.replace(MARK, "").split()) or "-"
    return blocks, labels


def train(n_pages: int = 1_000, seed: int = 11) -> Model:
    return fit([labelled_blocks(h) for h in labelled_pages(n_pages, seed)])


# ------------------------------------------------------------------ pages

def main_blocks(html: str, model: Model, scorer: Scorer | None = None) -> list[Block]:
    blocks = leaf_blocks(html)
    label = viterbi((scorer or Scorer(model.weights)).scores(blocks), relations(blocks), model.pairs)
    return [b for b, y in zip(blocks, label) if y]


def extract(pages: DataFrame, model: Model, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """(page_id, *keep, text, n_chars) of every row: the main text, blocks joined by two line ends."""
    kind = {f.name: f.dataType.simpleString() for f in pages.schema}
    kept = [F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]

    def run(batches):
        scorer = Scorer(model.weights)
        for batch in batches:
            texts = ["\n\n".join(b.text for b in main_blocks(h, model, scorer)) if h else "" for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), *[batch.column(f"k{i}") for i in range(len(keep))], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", *keep, "text", "n_chars"])

    schema = ", ".join([f"page_id {kind[id_col]}", *[f"`{c}` {kind[c]}" for c in keep], "text string", "n_chars bigint"])
    return bounded(pages).select(F.col(id_col).alias("page_id"), F.col(html_col).alias("html"), *kept).mapInArrow(released(run), schema)
