"""Main text of HTML pages by a linear-chain conditional random field over the leaf blocks of the document tree.

A page is read once, tag by tag, with the usual repairs (void elements, implied ends of p, li, td and the like, stray ends
ignored, elements left open at the end). A leaf block is the text between two block-level tags; text of scripts, styles and
other content that is not shown is no block. Each block has features: tags and class, id and role words of all elements
around it, its own element, its length, links and signs, and how much text and how many links its container holds. The field
labels the blocks of a page as main text or not: weights for each feature and label, and moves between labels that depend on
whether two blocks lie in the same container. Viterbi finds the best labels of a whole page; ties go to "not main".

The field is trained by maximum likelihood on labelled pages, pairs of HTML and main text (its blocks, a line each).
`example_pages` makes such pages of invented words in many layouts, for tables without labels; PAGES bounds the sample.

Defined results: null, empty and tagless pages (a page without tags is one block) are treated alike, no main block gives an
empty text; `br` is white space; repeated rows are pages of their own. Pages are handled one at a time; memory grows with the
longest page. Nothing is left out by length or number.
"""

from __future__ import annotations

import functools
import html as entities
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import text_slices

#: Labelled pages that are made for the fit, their seed, and steps of the fit.
PAGES, SEED, STEPS = 500, 11, 80
BATCH_BYTES = 4 << 20
OTHER, MAIN = 0, 1

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"'=]|=\s*"[^"]*"|=\s*'[^']*'|[="'])*+)>|<[a-zA-Z/][^>]*\Z|</[^a-zA-Z][^>]*>""", re.S)
_NAMED = re.compile(r"""(?<![\w-])(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?<![\w-])hidden(?![\w-])|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Elements by the HTML standard (fixed values): within a line, without content, and those whose content is not shown as text.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title".split())
UNSEEN = frozenset("noscript svg math template canvas audio video object applet".split())
PLAIN = frozenset("html head body".split())
#: What a start tag ends, and what shields it.
ENDS = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select",)), "tr": (("tr",), ("table",)), "td": (("td", "th"), ("table", "tr")), "th": (("td", "th"), ("table", "tr")), "thead": (("thead", "tbody", "tfoot"), ("table",)), "tbody": (("thead", "tbody", "tfoot"), ("table",)), "tfoot": (("thead", "tbody", "tfoot"), ("table",))}


@functools.lru_cache(4096)
def _close_of(name: str) -> re.Pattern:
    return re.compile(f"</{re.escape(name)}(?=[\\s/>]|\\Z)", re.I)


@functools.lru_cache(65536)
def _element_features(name: str, attributes: str) -> tuple[str, ...]:
    """Tag, and words of class, id, role and itemprop, whole and by their first four letters."""
    out = {f"t:{name}"}
    for m in _NAMED.finditer(attributes):
        for w in _WORD.findall(m.group(2) or m.group(3) or m.group(4) or ""):
            out |= {f"c:{w.lower()}", f"c4:{w[:4].lower()}"}
    if "-" in name:
        out |= {f"c:{w.lower()}" for w in _WORD.findall(name)}
    if _HIDDEN.search(attributes):
        out.add("hidden")
    return tuple(sorted(out))


class Block:
    __slots__ = ("text", "path", "own", "links", "container", "element", "after_heading")

    def __init__(self, text, path, own, links, container, element, after_heading):
        self.text, self.path, self.own, self.links, self.container, self.element, self.after_heading = text, path, own, links, container, element, after_heading


def blocks(page: str, known=None) -> list[Block]:
    """The leaf blocks of a page. known: the features that count (others of the path are passed over); None: all."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...], int]] = []  # name, features, number
    opened, active, serial = Counter(), Counter(), 0
    pieces: list[str] = []
    chars = links = 0
    link_at = None  # depth of the open link
    heading = False

    def flush():
        nonlocal chars, links
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                name, own, number = stack[-1] if stack else ("", (), 0)
                inner = name in _LEAF and len(stack) > 1
                out.append(Block(text, frozenset(active), (name, own), links / max(1, chars), stack[-2][2] if inner else number, number, heading))
            pieces.clear()
            chars = links = 0

    def pop():
        nonlocal link_at, heading
        name, own, _ = stack.pop()
        opened[name] -= 1
        heading = heading or name == "h1"
        for f in own:
            active[f] -= 1
            if not active[f]:
                del active[f]
        if link_at is not None and len(stack) < link_at:
            link_at = None

    def close(names: tuple[str, ...], shields: tuple[str, ...]):
        if not any(opened[n] for n in names):
            return
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in names:
                while len(stack) > i:
                    pop()
                return
            if stack[i][0] in shields:
                return

    at, end = 0, len(page)
    while at < end:
        m = _TAG.search(page, at)
        stop = m.start() if m else end
        if stop > at:
            piece = entities.unescape(page[at:stop])
            pieces.append(piece)
            chars += len(piece)
            links += len(piece) if link_at is not None else 0
        if not m:
            break
        at = m.end()
        name = m.group(2)
        if name is None:
            continue
        name = name.lower()
        if m.group(1):
            if name == "a":
                link_at = None
            elif name == "p" or (name not in INLINE and name not in VOID):
                flush()
                if opened[name]:
                    close((name,), ())
            elif name == "br":
                pieces.append(" ")
            continue
        if name in RAW or name in UNSEEN:
            if m.group(3).endswith("/"):
                continue
            found = _close_of(name).search(page, at)
            if found:
                at = page.find(">", found.end())
                at = end if at < 0 else at + 1
            elif name in RAW:
                at = end
            if name not in ("textarea",):
                pieces.append(" ")
            continue
        if name == "a":
            link_at = len(stack)
            continue
        if name in INLINE or (name in VOID and name != "hr"):
            if name == "br":
                pieces.append(" ")
            continue
        flush()
        if name in VOID or name in PLAIN:
            continue
        close(("p",), ())
        if name in ENDS:
            close(*ENDS[name])
        own = _element_features(name, m.group(3))
        if known is not None:
            own = tuple(f for f in own if f in known)
        serial += 1
        stack.append((name, own, serial))
        opened[name] += 1
        for f in own:
            active[f] += 1
    flush()
    return out


_LEAF = frozenset("p li dt dd td th h1 h2 h3 h4 h5 h6 blockquote pre figcaption caption option button label".split())
_END = re.compile(r"[.!?…。！？][\"'”»)\]]*$")


def _bucket(x: float) -> int:
    return min(12, int(x).bit_length())


@functools.lru_cache(65536)
def _own_features(name: str, own: tuple[str, ...]) -> tuple[str, ...]:
    return (f"p:{name}", *(f"o{f}" for f in own if f[0] == "c"))


def features(found: list[Block]) -> list[tuple[frozenset, tuple[str, ...]]]:
    """For each block the features of its path, and all others."""
    size, linked, number = Counter(), Counter(), Counter()
    for b in found:
        size[b.container] += len(b.text)
        linked[b.container] += len(b.text) * b.links
        number[b.container] += 1
    out, headings = [], any(b.own[0] == "h1" for b in found)
    for i, b in enumerate(found):
        n, all_ = len(b.text), size[b.container]
        words = b.text.count(" ") + 1
        share = sum(map(b.text.count, ",.;:")) / words
        out.append((b.path, (
            "1", f"n:{_bucket(n)}", f"w:{_bucket(words)}", f"l:{int(b.links * 3.99)}", f"e:{bool(_END.search(b.text))}", f"s:{min(4, int(share * 10))}", f"c:{'©' in b.text}", f"ct:{_bucket(all_)}",
            f"cl:{int(linked[b.container] / all_ * 3.99)}", f"cn:{_bucket(number[b.container])}", f"h:{headings}{b.after_heading or b.own[0] == 'h1'}", f"f:{i == 0}", f"z:{i == len(found) - 1}", *_own_features(*b.own),
        )))
    return out


class Field:
    """weights: feature -> (score of OTHER, score of MAIN); moves[same container][from][to]."""

    def __init__(self, weights: dict[str, tuple[float, float]], moves: np.ndarray):
        self.weights, self.moves = weights, moves
        self._paths: dict[frozenset, float] = {}

    def scores(self, found: list[Block]) -> list[float]:
        """Of each block: the score of MAIN above that of OTHER."""
        w, out = self.weights, []
        for path, rest in features(found):
            base = self._paths.get(path)
            if base is None:
                if len(self._paths) > 50_000:
                    self._paths.clear()
                base = self._paths[path] = sum(w[f][1] - w[f][0] for f in sorted(path) if f in w)
            out.append(base + sum(w[f][1] - w[f][0] for f in rest if f in w))
        return out

    def decode(self, scores: list[float], same: list[bool]) -> list[int]:
        """Viterbi; ties go to OTHER. same[i]: block i lies in the container of block i - 1."""
        if not scores:
            return []
        moves, back, s = self.moves.tolist(), [], [0.0, scores[0]]
        for x, k in zip(scores[1:], same[1:]):
            m = moves[bool(k)]
            new, came = [], []
            for to in (OTHER, MAIN):
                a, b = s[0] + m[0][to], s[1] + m[1][to]
                new.append(max(a, b) + (x if to else 0.0))
                came.append(int(b > a))
            s = new
            back.append(came)
        k = int(s[1] > s[0])
        out = [k]
        for came in reversed(back):
            k = came[k]
            out.append(k)
        return out[::-1]

    def text(self, page: str | None) -> str:
        """The page's main text: its main blocks, a line each."""
        found = blocks(page or "", self.weights)
        labels = self.decode(self.scores(found), _same(found))
        return "\n".join(b.text for b, k in zip(found, labels) if k == MAIN)


def _same(found: list[Block]) -> list[bool]:
    return [i > 0 and b.container == found[i - 1].container for i, b in enumerate(found)]


def label(found: list[Block], text: str) -> list[int]:
    """Labels of blocks from the page's main text, whose lines are met in order."""
    lines, out = iter(text.split("\n") if text else []), []
    want = next(lines, None)
    for b in found:
        hit = want is not None and b.text == want
        out.append(MAIN if hit else OTHER)
        if hit:
            want = next(lines, None)
    return out


def train(pages: list[tuple[str, str]], steps: int = STEPS, penalty: float = 0.3) -> Field:
    """Maximum likelihood with a quadratic penalty on labelled pages (HTML, main text). Features of a single page are left out."""
    parsed = [(f, label(f, t)) for f, t in ((blocks(h), t) for h, t in pages) if f]
    held = [[[*sorted(path), *rest] for path, rest in features(f)] for f, _ in parsed]
    seen = Counter(x for page in held for x in {x for row in page for x in row})
    names = {x: i for i, x in enumerate(sorted(x for x, n in seen.items() if n > 1))}
    n, longest = len(held), max(map(len, held), default=1)
    real, y, same = np.zeros((n, longest), bool), np.zeros((n, longest), int), np.zeros((n, longest), int)
    row, col = [], []
    for i, (page, (f, labels)) in enumerate(zip(held, parsed)):
        real[i, : len(page)], y[i, : len(page)], same[i, : len(page)] = True, labels, _same(f)
        for j, xs in enumerate(page):
            hit = [names[x] for x in xs if x in names]
            row += [i * longest + j] * len(hit)
            col += hit
    row, col = np.array(row, int), np.array(col, int)
    w, moves = np.zeros((len(names), 2)), np.zeros((2, 2, 2))
    target = np.stack([np.bincount(col, (y.ravel() == k)[row], len(names)) for k in (0, 1)], axis=1)
    pairs = real[:, 1:] & real[:, :-1]
    target_moves = np.zeros((2, 2, 2))
    np.add.at(target_moves, (same[:, 1:][pairs], y[:, :-1][pairs], y[:, 1:][pairs]), 1)
    sums_w, sums_m = np.zeros_like(w), np.zeros_like(moves)
    for _ in range(steps):
        e = np.stack([np.bincount(row, w[col, k], n * longest) for k in (0, 1)], axis=1).reshape(n, longest, 2)
        fwd, bwd = np.zeros_like(e), np.zeros_like(e)
        fwd[:, 0] = e[:, 0]
        for j in range(1, longest):  # padding repeats the last true place
            step = e[:, j] + np.logaddexp.reduce(fwd[:, j - 1, :, None] + moves[same[:, j]], axis=1)
            fwd[:, j] = np.where(real[:, j, None], step, fwd[:, j - 1])
        for j in range(longest - 2, -1, -1):
            step = np.logaddexp.reduce(moves[same[:, j + 1]] + (e[:, j + 1] + bwd[:, j + 1])[:, None, :], axis=2)
            bwd[:, j] = np.where(real[:, j + 1, None], step, 0)
        z = np.logaddexp.reduce(fwd[:, -1], axis=1)
        p = np.exp(fwd + bwd - z[:, None, None]) * real[:, :, None]
        both = np.exp(fwd[:, :-1, :, None] + moves[same[:, 1:]] + (e[:, 1:] + bwd[:, 1:])[:, :, None, :] - z[:, None, None, None])
        got_moves = np.stack([both[pairs & (same[:, 1:] == k)].sum(axis=0) for k in (0, 1)])
        flat = p.reshape(-1, 2)
        got = np.stack([np.bincount(col, flat[row, k], len(names)) for k in (0, 1)], axis=1)
        for x, g, h in ((w, target - got - penalty * w, sums_w), (moves, target_moves - got_moves - penalty * moves, sums_m)):  # Adagrad
            h += g * g
            x += 0.3 * g / np.sqrt(h + 1e-6)
    return Field({x: (float(w[i, 0]), float(w[i, 1])) for x, i in names.items()}, moves)


# -- labelled pages of invented words

_SOUNDS = ("ba de ki lo mu ra sen tor vin el ar ost und che qua".split(), "ée çon où ñar ü ö ßen lä cié ment tion".split(), "ва ро ни ко ста пре ли мо дой ка".split())
#: Names that pages give to their parts (fixed values): what holds the article, and what does not belong to it.
_NAMES = {
    "main": "content main article post entry story body text page-content article-body post-content entry-content main-content story-body articleText prose blog-post single".split(),
    "nav": "nav navbar menu navigation main-nav topnav mainMenu breadcrumb breadcrumbs site-nav links".split(),
    "header": "header masthead site-header top page-header topbar branding logo".split(),
    "footer": "footer site-footer bottom colophon page-footer foot copyright legal".split(),
    "aside": "sidebar aside widget side rightcol left-column secondary related trending popular recommended more-stories teaser widget-area most-read".split(),
    "ad": "ad ads advert advertisement sponsored banner promo adsbox ad-slot advertorial sponsor".split(),
    "notice": "cookie cookie-banner consent gdpr notice alert popup modal overlay message cookie-notice warning".split(),
    "form": "form search search-form newsletter subscribe signup login contact-form subscription".split(),
    "comments": "comments comment comment-list reader-comments discussion responses disqus replies user-comments respond feedback".split(),
    "share": "share social share-buttons sharing social-links tags toolbar pagination".split(),
}
_WRAPS = "wrap wrapper container row col inner clearfix section outer grid box block col-md-8 layout panel".split()


class _Maker:
    """One page in a random layout: its HTML and its main text's blocks."""

    def __init__(self, rng: random.Random):
        self.rng, self.lines = rng, []
        self.sounds = rng.choice(_SOUNDS)
        self.sign = rng.choice(["", "", "", "", "!!", "***", "%%%", "&&"])
        self.upper = rng.random() < 0.08

    def words(self, n: int) -> str:
        rng, out = self.rng, []
        for i in range(n):
            w = "".join(rng.choices(self.sounds, k=rng.randrange(1, 4)))
            out.append((w.capitalize() if not i else w) + self.sign)
        s = " ".join(out)
        return s.upper() if self.upper else s

    def prose(self, sentences: int) -> str:
        return " ".join(self.words(self.rng.randrange(3, 18)) + self.rng.choice(["."] * 6 + ["?", "!", ".", ","]) for _ in range(sentences))

    def coded(self, text: str) -> str:
        out = text.replace("&", "&amp;").replace("<", "&lt;")
        return out.replace(" ", self.rng.choice([" ", "\n  ", "&nbsp;"]), 1) if self.rng.random() < 0.2 else out

    def main(self, text: str, tag: str) -> str:
        self.lines.append(" ".join(text.split()))
        rng, t = self.rng, self.coded(text)
        if rng.random() < 0.25 and " " in t:
            a, b = t.split(" ", 1)
            mark = rng.choice(["b", "em", "a href='/x'", "span", "strong"])
            t = f"<{mark}>{a}</{mark.split()[0]}> {b}"
        close = "" if tag in ("p", "li") and rng.random() < 0.1 else f"</{tag}>"
        return f"<{tag}{rng.choice(['', '', '', ' class=x1'])}>{t}{close}" if tag else t

    def named(self, kind: str, inner: str, tag: str | None = None) -> str:
        rng = self.rng
        tag = tag or rng.choice(["div", "div", "section"])
        attr = f' {rng.choice(["class", "class", "id"])}="{rng.choice(_NAMES[kind])}{rng.choice(["", "", f" {rng.choice(_WRAPS)}"])}"' if not self.bare or rng.random() < 0.1 else ""
        return f"<{tag}{attr}>{inner}</{tag}>"

    def links(self, n: int) -> str:
        rng = self.rng
        items = [f'<a href="/{i}">{self.coded(self.words(rng.randrange(1, 4)))}</a>' for i in range(n)]
        return rng.choice([lambda: "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>", lambda: " | ".join(items), lambda: "".join(f"<div>{x}</div>" for x in items)])()

    def article(self) -> str:
        rng, out = self.rng, []
        if rng.random() < 0.85:
            out.append(self.main(self.words(rng.randrange(2, 12)), "h1"))
        for _ in range(rng.choice([1, 1, 2, 3, 5, 8, 12, 20])):
            kind = rng.random()
            if kind < 0.68:
                out.append(self.main(self.prose(rng.choice([1, 1, 2, 3, 5, 9])) if rng.random() < 0.93 else self.words(rng.randrange(1, 6)), "p"))
            elif kind < 0.78:
                out.append(self.main(self.words(rng.randrange(1, 7)), rng.choice(["h2", "h3", "h4"])))
            elif kind < 0.84:
                out.append("<ul>" + "".join(self.main(self.words(rng.randrange(1, 12)), "li") for _ in range(rng.randrange(2, 6))) + "</ul>")
            elif kind < 0.88:
                out.append(rng.choice(["<blockquote>{}</blockquote>", "<figure><img src=x.png><figcaption>{}</figcaption></figure>", "<div>{}</div>"]).format(self.main(self.prose(1), "")))
            elif kind < 0.91:
                out.append("<table>" + "".join("<tr>" + "".join(self.main(self.words(rng.randrange(1, 3)), "td") for _ in range(2)) + "</tr>" for _ in range(2)) + "</table>")
            elif kind < 0.94:  # text before an open paragraph
                out.append("<p><b>" + self.main(self.prose(2), "") + "<br>" + self.main(self.prose(3), "p"))
            else:
                out.append(rng.choice([self.ad, self.share, self.related, self.form])())
        return "".join(out)

    def ad(self) -> str:
        return "<!-- ad 3 -->" * self.rng.randrange(2) + self.named("ad", self.coded(self.prose(self.rng.randrange(1, 4))), self.rng.choice(["div", "div", "aside", "p"])) if not self.bare else self.named("ad", self.links(2), "aside")

    def share(self) -> str:
        return self.named("share", self.links(self.rng.randrange(2, 5)))

    def related(self) -> str:
        teasers = "".join(f"<li><a href=/t>{self.words(6)}</a> {self.coded(self.prose(1))}</li>" for _ in range(3))
        return self.named("aside", f"<h3>{self.words(2)}</h3>" + self.rng.choice([self.links(4), f"<ul>{teasers}</ul>", f"<p>{self.coded(self.prose(2))}</p><p><a href=/m>{self.words(2)}</a></p>"]), self.rng.choice(["aside", "aside", "div"]) if not self.bare else "aside")

    def form(self) -> str:
        return self.named("form", f"<form action=/s><label>{self.words(2)}</label><input name=q><select><option>{self.words(1)}<option>{self.words(1)}</select><p>{self.coded(self.prose(1))}</p><button>{self.words(1)}</button></form>")

    def notice(self) -> str:
        return self.named("notice", f"<p>{self.coded(self.prose(2))}</p><button>{self.words(1)}</button>" if self.rng.random() < 0.5 or self.bare else self.coded(self.prose(self.rng.randrange(1, 3))))

    def comments(self) -> str:
        rng = self.rng
        item = lambda: self.rng.choice(['<div class="comment"><h4>{0}</h4><p>{1}</p></div>', "<li class=comment><b>{0}</b><p>{1}</p></li>", '<div class="comment-body"><p>{1}</p></div>', "<p>{1}</p>", "<article class=comment><header>{0}</header><p>{1}</p></article>"]).format(self.words(2), self.coded(self.prose(rng.randrange(1, 5))))
        tag = rng.choice(["section", "div", "ol"])
        return f'<{tag} {rng.choice(["class", "id"])}="{rng.choice(_NAMES["comments"])}">' + f"<h3>{self.words(2)}</h3>" * rng.randrange(2) + "".join(item() for _ in range(rng.randrange(1, 6))) + f"</{tag}>"

    def header(self) -> str:
        return self.named("header", rng_join(self.rng, [f"<a href=/>{self.words(2)}</a>", f"<p>{self.words(4)}</p>", self.links(3), self.words(3)]), self.rng.choice(["header", "div"]) if not self.bare else "header")

    def nav(self) -> str:
        return self.named("nav", self.links(self.rng.randrange(2, 9)), self.rng.choice(["nav", "nav", "div", "ul"]) if not self.bare else "nav")

    def footer(self) -> str:
        rng = self.rng
        inner = rng.choice(["&copy; ", "&#169; ", "© ", ""]) + f"{rng.choice(['www.', ''])}{self.words(1).lower()}.example.com " + rng.choice(["&middot; ", "| ", ""]) + self.coded(self.prose(rng.randrange(0, 3)))
        inner += rng.choice(["", self.links(4), f"<p>{self.coded(self.prose(2))}</p>"])
        return self.named("footer", inner, rng.choice(["footer", "footer", "div"]) if not self.bare else "footer")

    def page(self) -> tuple[str, str]:
        rng = self.rng
        self.bare = rng.random() < 0.2  # parts have their tags alone
        holder = rng.choice(["article", "article", "main", "div", "div", "section", "td"])
        top = [f() for f, p in ((self.notice, 0.2), (self.header, 0.5), (self.nav, 0.8), (self.form, 0.15), (self.nav, 0.15), (self.ad, 0.5), (self.related, 0.2)) if rng.random() < p]
        if rng.random() < 0.5:
            rng.shuffle(top)
        inside = self.article()
        if rng.random() < 0.25:
            inside += rng.choice([self.comments, self.related, self.share, self.form])()
        if holder == "td":
            body = f"<table><tr><td>{self.links(5)}</td><td{'' if self.bare else ' class=' + rng.choice(_NAMES['main'])}>{inside}</td></tr></table>"
        elif holder in ("article", "main") and rng.random() < 0.5:
            body = f"<{holder}>{inside}</{holder}>"
        else:
            body = self.named("main", inside, holder)
        under = [f() for f, p in ((self.share, 0.2), (self.comments, 0.4), (self.related, 0.35), (self.ad, 0.2), (self.form, 0.15), (self.footer, 0.85), (self.notice, 0.15)) if rng.random() < p]
        out = "".join(top) + body + "".join(under)
        for _ in range(rng.randrange(3)):
            out = f'<div class="{rng.choice(_WRAPS)}">{out}</div>'
        head = f"<head><meta charset=utf-8><title>{self.words(4)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head>"
        end = "</body></html>" if rng.random() < 0.9 else ""
        return f"<!DOCTYPE html><html lang=x>{head}<body>{out}{end}", "\n".join(self.lines)


def rng_join(rng: random.Random, parts: list[str]) -> str:
    return "".join(rng.sample(parts, rng.randrange(1, len(parts) + 1)))


def example_pages(n: int = PAGES, seed: int = SEED) -> list[tuple[str, str]]:
    """n labelled pages (HTML, main text) of invented words: articles with menus, headers, footers, side columns, notices, adverts, forms and readers' comments around and inside them."""
    return [_Maker(random.Random(f"{seed}:{i}")).page() for i in range(n)]


def extract(df: DataFrame, field: Field, html_col: str = "html") -> DataFrame:
    """The rows without their HTML, with text (the page's main text) and n_chars (its code points); columns of these names are replaced."""
    kept = [c for c in df.columns if c.lower() not in (html_col.lower(), "text", "n_chars")]
    held = df.sparkSession.sparkContext.broadcast((field.weights, field.moves))
    schema = df.select(*(df[f"`{c}`"] for c in kept)).schema.add("text", "string").add("n_chars", "long")

    def run(batches):
        f = Field(*held.value)
        for batch in batches:
            for part, pages in text_slices(batch, len(kept), BATCH_BYTES):
                texts = [f.text(p) for p in pages]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=schema.names)

    return df.select(*(df[f"`{c}`"] for c in kept), df[f"`{html_col}`"].cast("string")).mapInArrow(run, schema)
