"""Main text of web pages by a recurrent block labeller.

A page is a sequence of blocks: the text between the starts and ends of block-level elements. A bidirectional LSTM
reads for each block a vector of its tag path (tags, classes and ids of its ancestors, hashed), a vector of its
hashed words and a few measures, and so labels every block with the whole page in view. The text is the labelled blocks.

The weights are trained here, from a seed, on pages composed of labelled parts in many layouts; no table is read.
"""

from __future__ import annotations

import html as entities
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of HTML.
UNSEEN = "script style noscript template svg math title iframe object canvas audio video textarea select datalist"
BLOCKS = "html body div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr section article main header footer nav aside form fieldset legend figure figcaption blockquote pre hr address details summary dialog menu center hgroup search button option"
VOID = "area base br col embed hr img input link meta param source track wbr"
UNSEEN_TAGS, BLOCK_TAGS, VOID_TAGS = (frozenset(x.split()) for x in (UNSEEN, BLOCKS, VOID))
#: What opens inside one of these ends it first.
CLOSED_BY = {"p": BLOCK_TAGS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "option": {"option"}}

#: Attributes as browsers read them: a quote quotes right after `=` only, elsewhere it is a sign as any other; `=` before a name is one too.
ATTRIBUTES = r"(?:[\s/]*+[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|(?=>)|[^\s\"'>][^\s>]*+))?+)*+"
INSIDE = ATTRIBUTES + r"[\s/]*+"
#: Comments, of which `<!-->` and `<!--->` end at once, and script and style, whose insides are not markup; all run to the page's end if need be.
OPAQUE = rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<(?P<raw>script|style)(?=[\s/>]){INSIDE}>.*?(?:</(?P=raw)(?=[\s/>])[^>]*>|\Z)"
#: An element that closes itself; a slash in an unquoted value closes nothing.
CLOSED = rf"<(?:svg|math)(?=[\s/]){ATTRIBUTES}(?:\s*+/)++>"
MARKUP = re.compile(OPAQUE + "|" + CLOSED + rf"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<rest>{INSIDE})>|</?[a-zA-Z][^>]*+>|<[!?/][^>]*+>", re.S | re.I)
CLOSE = re.compile(r"</(?:script|style)(?=[\s/>])[^>]*>\Z", re.I)
NESTED = re.compile(OPAQUE + "|" + CLOSED + rf"|<(?P<end>/?)(?P<tag>{'|'.join(t for t in UNSEEN.split() if t not in ('script', 'style'))})(?=[\s/>]){INSIDE}>", re.S | re.I)
NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
PATH, WORDS, MEASURES = 256, 32, 10
KEPT_PATHS = 20_000
STRETCH = 4096  # blocks of a page whose features are held at once


@dataclass(slots=True)
class Block:
    path: int  # a bit for each hashed part of the tag path
    tag: int  # the hash of the innermost tag
    text: str
    linked: int


def hashed(part: str) -> int:
    return zlib.crc32(part.encode("utf-8", "replace")) % PATH


def unseen_ends(html: str) -> dict[int, int]:
    """Where each element whose content isn't shown ends, by where it begins; those that nothing closes are left out."""
    opened: dict[str, list[int]] = {}
    ends: dict[int, int] = {}
    for m in NESTED.finditer(html):
        if m["tag"]:
            if not m["end"]:
                opened.setdefault(m["tag"].lower(), []).append(m.start())
            elif opened.get(m["tag"].lower()):
                ends[opened[m["tag"].lower()].pop()] = m.end()
    return ends


def blocks(html: str | None) -> list[Block]:
    """The blocks of a whole page in order: character references decoded, white space inside a block made one space."""
    html = html or ""
    out: list[Block] = []
    stack: list[tuple[str, int, int]] = []  # tag, path, hash of the tag
    ends = unseen_ends(html)
    names = Counter()
    pieces: list[str] = []
    links = linked = at = skip = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join(entities.unescape("".join(pieces)).split())
        if text:
            out.append(Block(*(stack[-1][1:] if stack else (0, -1)), text, linked))
        pieces.clear()
        linked = 0

    def say(text: str) -> None:
        nonlocal linked
        if text:
            pieces.append(text)
            if links:
                linked += len(text)

    # no tag ends after the last `>`: what follows it is text, up to a comment that nothing closes
    rest = html[html.rfind(">") + 1 :]
    html = html[: len(html) - len(rest)]
    rest = rest.partition("<!--")[0]
    for m in MARKUP.finditer(html):
        if m.start() < skip:
            continue
        if m.end() == len(html) and (m["raw"] and not CLOSE.search(m[0]) or m[0].startswith("<!--") and not m[0].endswith("-->")):
            rest = ""
        say(html[at : m.start()])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if tag in UNSEEN_TAGS and not m["end"]:
            at = skip = ends.get(m.start(), at)
            continue
        if tag == "br":
            pieces.append("\n")
        elif tag == "a":
            links = 0 if m["end"] else 1
        elif tag in BLOCK_TAGS:
            flush()
            if m["end"]:
                if names[tag]:
                    while stack:
                        last = stack.pop()[0]
                        names[last] -= 1
                        if last == tag:
                            break
                if tag not in ("p", "li"):
                    links = 0
                continue
            if stack and tag in CLOSED_BY.get(stack[-1][0], ()):
                names[stack.pop()[0]] -= 1
            if tag not in VOID_TAGS:
                path = (stack[-1][1] if stack else 0) | 1 << hashed(tag)
                if "=" in m["rest"]:
                    for kind, *value in NAMED.findall(m["rest"]):
                        for part in PARTS.findall("".join(value)):
                            path |= 1 << hashed(f"{tag}.{part.lower()}") | 1 << hashed(f".{part.lower()}")
                stack.append((tag, path, hashed(f"={tag}")))
                names[tag] += 1
    say(html[at:])
    say(rest)
    flush()
    return out


_paths: dict[tuple[int, int], np.ndarray] = {}


def path_vector(path: int, tag: int) -> np.ndarray:
    """Which hashed parts the path holds; the innermost tag counts besides."""
    if (path, tag) not in _paths:
        if len(_paths) > KEPT_PATHS:
            _paths.clear()
        v = np.unpackbits(np.frombuffer(path.to_bytes(PATH // 8, "little"), np.uint8), bitorder="little").astype(np.float32)
        if tag >= 0:
            v[tag] += 1
        _paths[path, tag] = v
    return _paths[path, tag]


def features(page: list[Block], first: int = 0, of: int | None = None) -> np.ndarray:
    """A row for each block: tag path, hashed words, measures. The blocks are those from `first` of a page of `of`."""
    out = np.zeros((len(page), PATH + WORDS + MEASURES), np.float32)
    crc, of = zlib.crc32, of or len(page)
    for i, b in enumerate(page):
        words = b.text.split(" ")
        n, chars = len(words), len(b.text)
        out[i, :PATH] = path_vector(b.path, b.tag)
        out[i, PATH : PATH + WORDS] = np.bincount([crc(w.lower().encode("utf-8", "replace")) & WORDS - 1 for w in words], minlength=WORDS) / n
        end = b.text[-1]
        out[i, PATH + WORDS :] = (np.log1p(n) / 5, np.log1p(chars) / 7, min(1.0, b.linked / chars), end in ".!?", end == ":", chars / n > 7, n < 4, n > 15, (first + i + 0.5) / of, np.log1p(of) / 5)
    return out


@dataclass
class Labeller:
    """A bidirectional LSTM and a logistic unit over both directions' states."""

    wx: np.ndarray  # direction, inputs, 4 * hidden
    wh: np.ndarray  # direction, hidden, 4 * hidden
    b: np.ndarray  # direction, 4 * hidden
    out: np.ndarray  # 2 * hidden
    bias: np.ndarray  # 1

    def params(self) -> list[np.ndarray]:
        return [self.wx, self.wh, self.b, self.out, self.bias]

    def states(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        """States of both directions for padded pages `x` (page, block, input); with `keep` what a step back needs."""
        pages, steps, _ = x.shape
        n = self.wh.shape[1]
        both, tape = np.zeros((pages, steps, 2 * n), np.float32), []
        for d in range(2):
            drive = x @ self.wx[d] + self.b[d]
            h = np.zeros((pages, n), np.float32)
            c = np.zeros((pages, n), np.float32)
            for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
                z = drive[:, t] + h @ self.wh[d]
                gates = 1 / (1 + np.exp(-z[:, : 3 * n]))
                i, f, o = gates[:, :n], gates[:, n : 2 * n], gates[:, 2 * n :]
                g = np.tanh(z[:, 3 * n :])
                m = mask[:, t, None]
                new = f * c + i * g
                squeezed = np.tanh(new)
                if keep:
                    tape.append((d, t, h, c, i, f, o, g, squeezed, m))
                c = np.where(m, new, c)
                h = np.where(m, o * squeezed, h)
                both[:, t, d * n : (d + 1) * n] = h
        return both, tape

    def label(self, pages: list[np.ndarray], at_once: int = 1 << 16) -> list[np.ndarray]:
        """The probability of each block of each page; pages of like length are read together."""
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        at = 0
        while at < len(order):
            some = [order[at]]
            while at + len(some) < len(order) and len(pages[order[at + len(some)]]) * (len(some) + 1) * 2 <= at_once and len(some) < 256:
                some.append(order[at + len(some)])
            at += len(some)
            x, mask = padded([pages[i] for i in some])
            z = self.states(x, mask)[0] @ self.out + self.bias
            for i, row in zip(some, z, strict=True):
                out[i] = 1 / (1 + np.exp(-row[: len(pages[i])]))
        return out


    def label_blocks(self, page: list[Block], stretch: int = STRETCH) -> np.ndarray:
        """The probability of each block of one page of any length: only a stretch of blocks has its features held."""
        n, z, w = self.wh.shape[1], np.full(len(page), self.bias[0], np.float32), self.out
        starts = range(0, len(page), stretch)
        for d in range(2):
            h, c = np.zeros(n, np.float32), np.zeros(n, np.float32)
            for at in starts if d == 0 else reversed(starts):
                drive = features(page[at : at + stretch], at, len(page)) @ self.wx[d] + self.b[d]
                for t in range(len(drive)) if d == 0 else range(len(drive) - 1, -1, -1):
                    x = drive[t] + h @ self.wh[d]
                    i, f, o = np.split(1 / (1 + np.exp(-x[: 3 * n])), 3)
                    c = f * c + i * np.tanh(x[3 * n :])
                    h = o * np.tanh(c)
                    z[at + t] += h @ w[d * n : (d + 1) * n]
        return 1 / (1 + np.exp(-z))


def grouped(pages: list[str | None], most: int = 64, chars: int = 4 << 20) -> Iterator[list[str | None]]:
    """Pages some at a time: at most `most`, and no more after `chars` characters of them."""
    some, size = [], 0
    for p in pages:
        some.append(p)
        size += len(p or "")
        if len(some) >= most or size >= chars:
            yield some
            some, size = [], 0
    if some:
        yield some


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, pages))
    x = np.zeros((len(pages), steps, pages[0].shape[1]), np.float32)
    mask = np.zeros((len(pages), steps), bool)
    for k, p in enumerate(pages):
        x[k, : len(p)] = p
        mask[k, : len(p)] = True
    return x, mask


def train(pages: list[tuple[np.ndarray, np.ndarray]], hidden: int = 16, passes: int = 4, batch: int = 32, rate: float = 0.01, seed: int = 42) -> Labeller:
    """Fit on `(features, labels)` pages by Adam on the mean logistic loss, back through every step."""
    rng = np.random.default_rng(seed)
    d = pages[0][0].shape[1]
    draw = lambda *s, by: (rng.standard_normal(s) / by**0.5).astype(np.float32)
    m = Labeller(draw(2, d, 4 * hidden, by=40), draw(2, hidden, 4 * hidden, by=hidden), np.zeros((2, 4 * hidden), np.float32), draw(2 * hidden, by=2 * hidden), np.zeros(1, np.float32))
    m.b[:, hidden : 2 * hidden] = 1  # remember at first
    first, second, count = [np.zeros_like(p) for p in m.params()], [np.zeros_like(p) for p in m.params()], 0
    for _ in range(passes):
        order = rng.permutation(len(pages))
        # pages of like length share a batch, so little is padding
        chunks = [sorted(order[i : i + 8 * batch], key=lambda k: len(pages[k][0])) for i in range(0, len(order), 8 * batch)]
        for some in (c[i : i + batch] for c in chunks for i in range(0, len(c), batch)):
            x, mask = padded([pages[k][0] for k in some])
            y = padded([pages[k][1][:, None] for k in some])[0][:, :, 0]
            both, tape = m.states(x, mask, keep=True)
            miss = np.where(mask, 1 / (1 + np.exp(-(both @ m.out + m.bias))) - y, 0).astype(np.float32) / mask.sum()
            grads = [np.zeros_like(p) for p in m.params()]
            grads[3] = np.einsum("ps,psk->k", miss, both)
            grads[4][:] = miss.sum()
            down = miss[:, :, None] * m.out
            dz_all = np.zeros((2, *x.shape[:2], 4 * hidden), np.float32)
            dh = dc = None
            for direction, t, h, c, i, f, o, g, squeezed, alive in reversed(tape):
                if dh is None or direction != last:
                    dh, dc, last = np.zeros_like(h), np.zeros_like(c), direction
                total = dh + down[:, t, direction * hidden : (direction + 1) * hidden]
                new_c = np.where(alive, dc + total * o * (1 - squeezed**2), 0)
                dz = np.concatenate([new_c * g * i * (1 - i), new_c * c * f * (1 - f), np.where(alive, total * squeezed * o * (1 - o), 0), new_c * i * (1 - g**2)], axis=1)
                dz_all[direction, :, t] = dz
                grads[1][direction] += h.T @ dz
                dh = dz @ m.wh[direction].T + np.where(alive, 0, total)
                dc = np.where(alive, new_c * f, dc)
            for direction in range(2):
                grads[0][direction] = np.tensordot(x, dz_all[direction], ([0, 1], [0, 1]))
                grads[2][direction] = dz_all[direction].sum((0, 1))
            count += 1
            size = sum(float((g * g).sum()) for g in grads) ** 0.5
            for p, g, a, b in zip(m.params(), grads, first, second, strict=True):
                g *= min(1.0, 1 / (size + 1e-9))
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= rate * (a / (1 - 0.9**count)) / (np.sqrt(b / (1 - 0.999**count)) + 1e-8)
    return m


# How pages name their parts, for the training pages. Tag, then class or id words; "" is no name.
MAIN = ["article", "article post", "main", "main content", "div content", "div main-content", "div post-body", "div entry-content", "div articleBody", "div story", "section article-text", "div text", "div page-body", "div "]
ASIDE = {
    "nav": ["nav", "nav menu", "div menu", "div navbar", "ul nav", "div navigation", "div breadcrumb", "div topnav", "div toc"],
    "header": ["header", "div header", "div masthead", "header site-header", "div banner", "div logo", "div topbar"],
    "footer": ["footer", "div footer", "footer site-footer", "div copyright", "div bottom", "div legal"],
    "side": ["aside", "aside sidebar", "div sidebar", "div widget", "div related", "div recommended", "div trending", "div popular-posts", "section more-stories", "div rail"],
    "notice": ["div cookie", "div cookie-notice", "div notice", "div consent", "div alert", "div gdpr-banner", "div popup", "div modal", "section newsletter", "div paywall", "dialog", "div disclaimer", "div message"],
    "advert": ["div ad", "div ads", "div advert", "div advertisement", "div sponsored", "aside ad-slot", "div promo", "section promotion", "div banner-ad", "div adsbox"],
    "form": ["form", "form search", "form login", "div subscribe", "form signup", "div contact-form", "div search-box", "fieldset"],
    "comments": ["div comments", "section comments", "div comment-list", "ol commentlist", "div disqus_thread", "div discussion", "ul comments", "div user-comments", "section responses", "div reader-comments", "div replies", "div comment"],
    "share": ["div share", "div social", "ul social-links", "div tags", "div author-bio", "div meta", "div byline-share", "div pagination"],
}
NOISE = ["wrapper", "container", "row", "col", "inner", "box", "block", "section", "clearfix", "grid", "left", "panel", "module", "item"]
SAID = {
    "nav": "home about contact news blog menu products services accueil startseite inicio",
    "header": "welcome search login the official site menu",
    "footer": "copyright privacy terms all rights reserved contact imprint impressum mentions",
    "side": "related popular recent more read also latest top",
    "notice": "we use cookies accept agree continue policy consent settings subscribe newsletter",
    "advert": "advertisement sponsored buy now sale offer click shop free deal",
    "form": "email password name submit send search sign login",
    "comments": "reply says posted comment wrote agree ago like",
    "share": "share tweet facebook tags posted by follow print next previous",
}


def training_page(rng: random.Random) -> tuple[str, list[str]]:
    """A page of random words in a random layout, and the texts of its main blocks in order."""
    letters = rng.choice(["etaoinshrdlu", "aeiounrtsldcm", "abcdefghijklmnopqrstuvwxyzäöüß", "eaisnrtoluéèç"])
    word = lambda: "".join(rng.choices(letters, k=rng.randint(2, 9)))
    main: list[str] = []

    def sentence(low: int, high: int) -> str:
        return " ".join(word() for _ in range(rng.randint(low, high))).capitalize() + rng.choice([".", ".", ".", "", "!", "?", ":"])

    def text(kind: str, low: int, high: int) -> str:
        known = SAID.get(kind, "").split()
        return " ".join(rng.choice(known) if known and rng.random() < 0.25 else word() for _ in range(rng.randint(low, high)))

    def wrap(spec: str, body: str, noise: float = 0.3) -> str:
        tag, _, name = spec.partition(" ")
        said = [name] * bool(name) + rng.sample(NOISE, rng.randint(1, 2)) * (rng.random() < noise)
        attr = f' {"id" if name and rng.random() < 0.25 else "class"}="{" ".join(said)}"' if said else ""
        body = f"<{tag}{attr}>{body}</{tag}>"
        return f'<div class="{rng.choice(NOISE)}">{body}</div>' if rng.random() < 0.15 else body

    def link(kind: str) -> str:
        return f'<a href="/{word()}">{text(kind, 1, 4)}</a>'

    def items(kind: str) -> str:
        rows = [link(kind) if rng.random() < 0.85 else text(kind, 1, 6) for _ in range(rng.randint(2, 8))]
        return f"<ul>{''.join(f'<li>{r}</li>' for r in rows)}</ul>" if rng.random() < 0.7 else rng.choice([" | ", " "]).join(rows)

    def paragraphs(kind: str, low: int, high: int) -> str:
        return "".join(f"<p>{text(kind, low, high)}{rng.choice(['.', '', '!'])}</p>" for _ in range(rng.randint(1, 3)))

    def boiler(kind: str) -> str:
        bare = text(kind, 2, 25) + rng.choice([".", "", "."])
        if kind == "form":
            body = "".join(f"<label>{text(kind, 1, 3)}</label><input name=x>" for _ in range(rng.randint(1, 3))) + f"<button>{text(kind, 1, 2)}</button>" + (paragraphs(kind, 3, 15) if rng.random() < 0.4 else "")
        elif kind == "comments":
            body = (f"<h3>{text(kind, 1, 3)}</h3>" if rng.random() < 0.6 else "") + "".join(rng.choice(["<li>{}</li>", "<div class=\"comment\">{}</div>", "{}"]).format(f"<p>{text(kind, 3, 60)}{rng.choice(['.', '!', '?'])}</p>") for _ in range(rng.randint(1, 6)))
        elif kind in ("nav", "side", "share"):
            body = (f"<h3>{text(kind, 1, 4)}</h3>" if kind == "side" and rng.random() < 0.6 else "") + (items(kind) if rng.random() < 0.8 else paragraphs(kind, 4, 30))
        else:
            body = rng.choice([bare, bare, f"<p>{bare}</p>", paragraphs(kind, 3, 40), items(kind) if kind != "advert" else f"<h4>{text(kind, 1, 4)}</h4>{bare}"])
            body = "&copy; " * (kind == "footer" and rng.random() < 0.5) + body
        return wrap(rng.choice(ASIDE[kind]), body)

    def kept(said: str, form: str) -> str:
        main.append(" ".join(said.split()))
        return form.format(said)

    body = [kept(sentence(2, 12), "<h1>{}</h1>")] if rng.random() < 0.85 else []
    for _ in range(rng.randint(1, 14)):
        draw = rng.random()
        if draw < 0.08:
            body.append(kept(sentence(1, 8), rng.choice(["<h2>{}</h2>", "<h3>{}</h3>", "<p><b>{}<br>"])))
        elif draw < 0.14:
            body.append(f"<ul>{''.join(kept(text('', 1, 15), rng.choice(['<li>{}</li>', '<li>{}'])) for _ in range(rng.randint(2, 5)))}</ul>")
        elif draw < 0.17:
            body.append(kept(sentence(4, 30), "<blockquote>{}</blockquote>"))
        elif draw < 0.19:
            body.append("<table>" + "".join(kept(text("", 3, 8), "<tr><td>{}</td></tr>") for _ in range(rng.randint(1, 4))) + "</table>")
        elif draw < 0.22:
            body.append(boiler(rng.choice(["advert", "side", "share", "notice", "form"])))
        else:
            said = " ".join(sentence(1, 18) for _ in range(rng.choice([1, 1, 2, 4, 8])))
            body.append(kept(said, "<p>{}" if rng.random() < 0.1 else "<p>{}</p>"))
    middle = wrap(rng.choice(MAIN), "".join(body))
    kinds = list(ASIDE)
    before = [boiler(k) for k in rng.sample(kinds[:7], rng.randint(0, 4))]
    after = [boiler(k) for k in rng.sample(kinds[1:], rng.randint(0, 5))]
    page = "".join(before) + middle + "".join(after)
    if rng.random() < 0.2:
        page = wrap(rng.choice(["div page", "div site", "div wrapper", "main"]), page, 0)
    return f"<!DOCTYPE html><html><head><title>{sentence(2, 8)}</title></head><body>{page}" + "</body></html>" * (rng.random() < 0.9), main


def labelled(page: str, main: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features of a page's blocks, and 1 for those that are the main texts in their order."""
    found, k = blocks(page), 0
    y = np.zeros(len(found), np.float32)
    for i, b in enumerate(found):
        if k < len(main) and b.text == main[k]:
            y[i], k = 1, k + 1
    return features(found), y


def fitted(pages: int = 1000, seed: int = 42, **settings) -> Labeller:
    """A labeller trained on `pages` composed pages; the same seed gives the same weights."""
    rng = random.Random(seed)
    return train([p for p in (labelled(*training_page(rng)) for _ in range(pages)) if len(p[1])], seed=seed, **settings)


def extract(pages: DataFrame, model: Labeller, page_id: str = "page_id", url: str = "url", html: str = "html", cut: float = 0.5) -> DataFrame:
    """`(page_id, url, text, n_chars)` of every row: the blocks that the model takes for main text, a line each.

    Null and empty pages have an empty text; repeated rows are read each; other columns are left aside; nothing of a
    long page is dropped. An empty table gives an empty result.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)  # a fixed number of weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for some in grouped(batch.column(2).to_pylist()):
                found = [blocks(h) for h in some]
                short = [k for k, page in enumerate(found) if len(page) <= STRETCH]
                said = dict(zip(short, shared.value.label([features(found[k]) for k in short]), strict=True))
                texts = ["\n".join(b.text for b, p in zip(page, said[k] if k in said else shared.value.label_blocks(page), strict=True) if p >= cut) for k, page in enumerate(found)]
                part = batch.slice(at, len(some))
                at += len(some)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    own = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    return own.mapInArrow(run, "page_id long, url string, text string, n_chars long")
