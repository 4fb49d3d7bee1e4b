"""Main text of web pages by a recurrent block labeller.

A page becomes its sequence of leaf blocks: runs of text between block-level tags, each with
the path of open tags and their class and id words. A bidirectional LSTM in numpy reads, for
every block, hashed vectors of the path's tags, of its names and of the block's words, and a
few shares (of links, of the page's text that is in the same element), and labels each block
with the whole page as context; blocks labelled main are joined in page order.

The weights are trained here (``train``), on generated pages of many layouts: with the usual
tags and names, with meaningless or no names, with tables for columns, and bare pages; their
articles hold data tables, lists, terms, code and figures beside paragraphs. Of a block's path
the nearest ``NEAREST`` elements are named, and the shares are those of three elements.
"""

from __future__ import annotations

import html as _html
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TAGS, NAMES, WORDS, SHARES = 32, 64, 64, 11
PATH = TAGS + NAMES
INPUT = PATH + WORDS + SHARES
#: open elements around a block that its path names, the nearest
NEAREST = 32
HIDDEN = 16
#: elements whose content is never shown as text: those of raw text run to their end tag or to
#: the end of the page, the others are hidden only if they are closed
RAW = frozenset("script style textarea title".split())
UNSHOWN = frozenset("noscript template svg math iframe object select".split())
#: hidden elements that "/>" closes, and the tags that end an unclosed one
FOREIGN = frozenset("svg math".split())
BREAKOUT = frozenset("address article aside b big blockquote body br center code dd div dl dt em embed figure footer form h1 h2 h3 h4 h5 h6 head header hr i img li main menu meta nav nobr ol p pre ruby s section small span strike strong sub sup table tt u ul var".split())
#: tags that do not end the head; any other and any text does
HEAD_TAGS = frozenset("html base basefont bgsound link meta".split()) | RAW | {"noscript", "template"}
#: elements that do not end a block
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: elements without content
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: start tags that close an open element of their own kind (the p is closed by any block)
REPEAT = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: comments, tags (quotes count after "=" only), declarations, text; what else starts like markup
#: has no end, so as in a browser the rest of the page is part of it
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+|[\"'])*+)>|<[!?/][^>]*+>|[^<]+|<(?![a-zA-Z!?/])", re.S)
_RAW_END = {x: re.compile(rf"</{x}(?=[\s/>])", re.I) for x in RAW}
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[a-z]+")


def _tokens(page: str) -> tuple[list[tuple[re.Match, str | None]], dict[int, int]]:
    """Tags, texts and comments with their tag names, raw text left out; and for each start
    tag of a closed hidden element the place of its end tag."""
    out: list[tuple[re.Match, str | None]] = []
    open_: dict[str, list[int]] = {x: [] for x in UNSHOWN}
    ends: dict[int, int] = {}
    at = 0
    while m := _TOKEN.match(page, at):
        at = m.end()
        tag = m[2] and m[2].lower()
        if tag in RAW:
            if not m[1] and not (m[3].endswith("/") and (open_["svg"] or open_["math"])):
                end = _RAW_END[tag].search(page, at)
                at = page.find(">", end.end()) + 1 if end else 0
                at = at or len(page)
        elif tag in UNSHOWN:
            if not m[1]:
                if not (tag in FOREIGN and m[3].endswith("/")):
                    open_[tag].append(len(out))
            elif open_[tag]:
                ends[open_[tag].pop()] = len(out)
        out.append((m, tag))
    return out, ends


Block = tuple[str, tuple[str, ...], float, tuple[int, int, int]]


def blocks(page: str) -> list[tuple[str, tuple[str, ...], float]]:
    """The page's blocks: text (references decoded, white space made single spaces), path
    and the share of its characters in links."""
    return [b[:3] for b in leaf_blocks(page)]


def leaf_blocks(page: str) -> list[Block]:
    """``blocks``, and numbers of the three elements that a block is in, the nearest first."""
    out: list[Block] = []
    open_: list[tuple[str, tuple[str, ...], int]] = []
    count: dict[str, int] = {}
    text: list[str] = []
    links = number = in_link = 0

    def close() -> None:
        nonlocal links
        if text:
            s = " ".join(_html.unescape("".join(text)).split())
            if s:
                near = [x[2] for x in open_[-3:]]
                out.append((s, tuple(x for _, own, _ in open_[-NEAREST:] for x in own), min(1.0, links / len(s)), tuple(([0, 0, 0] + near)[: -4 if len(near) else None : -1][:3])))
            text.clear()
            links = 0

    def drop(k: int) -> None:
        """Closes the open elements from the k-th on."""
        for x in open_[k:]:
            count[x[0]] -= 1
        del open_[k:]

    tokens, ends = _tokens(page)
    past = 0
    in_head = in_foreign = False
    for at, (m, tag) in enumerate(tokens):
        if at < past:
            continue
        if in_foreign:  # unclosed: up to a tag that cannot be in it, or that ends what it is in
            in_foreign = tag is None or not (tag in BREAKOUT or (m[1] and count.get(tag, 0)))
            if in_foreign:
                continue
        if tag is None:
            if (s := m[0])[0] != "<" or s == "<":
                if in_head and not s.strip():
                    continue
                in_head = False
                text.append(s)
                if in_link:
                    links += len(s)
            continue
        if tag in RAW:
            close()
            continue
        if tag in UNSHOWN:
            past = ends.get(at, at) + 1
            if tag not in FOREIGN:
                close()
            elif not m[1]:
                in_foreign = at not in ends and not m[3].endswith("/")
            continue
        if tag == "head":
            close()
            in_head = not m[1]
            continue
        if in_head:
            if tag in HEAD_TAGS:
                continue
            in_head = False
        if tag in INLINE:
            if tag == "br":
                text.append(" ")
            elif tag == "a":
                in_link = 0 if m[1] else 1
            continue
        close()
        if m[1]:
            if count.get(tag, 0):
                drop(next(k for k in range(len(open_) - 1, -1, -1) if open_[k][0] == tag))
            continue
        in_link = 0
        if open_ and open_[-1][0] == "p":
            drop(len(open_) - 1)
        if any(count.get(x, 0) for x in REPEAT.get(tag, ())):
            for k in range(len(open_) - 1, -1, -1):
                if open_[k][0] in REPEAT[tag]:
                    drop(k)
                    break
                if open_[k][0] in ("ul", "ol", "dl", "table"):
                    break
        if tag not in VOID:
            names = [w for x in _NAMES.findall(m[3]) for w in _WORD.findall("".join(x).lower())] if m[3] else []
            number += 1
            open_.append((tag, (tag, *[f".{w}" for w in names]), number))
            count[tag] = count.get(tag, 0) + 1
    close()
    return out


def _hash(x: str, n: int) -> int:
    return zlib.crc32(x.encode()) % n


@lru_cache(maxsize=20_000)
def _path_vector(path: tuple[str, ...]) -> np.ndarray:
    v = np.zeros(PATH, np.float32)
    for x in path:
        v[TAGS + _hash(x, NAMES) if x[0] == "." else _hash(x, TAGS)] = 1
    return v


def _masses(own: list[Block]) -> np.ndarray:
    """For each block and each of the elements it is in, the share of the page's characters
    that are in the element, and the element's blocks as a share of 30."""
    size = np.array([len(b[0]) for b in own], float)
    near = np.array([b[3] for b in own])
    out = np.empty((len(own), 4), np.float32)
    for i in (1, 2):
        _, of = np.unique(near[:, i], return_inverse=True)
        out[:, 2 * i - 2] = (np.bincount(of, size) / size.sum())[of]
        out[:, 2 * i - 1] = np.minimum(1, np.bincount(of)[of] / 30)
    return out


def features(own: list[Block]) -> np.ndarray:
    """Blocks x INPUT. Words are those of the whole block."""
    x = np.zeros((len(own), INPUT), np.float32)
    for i, (text, path, links, _) in enumerate(own):
        words = text.lower().split()
        x[i, :PATH] = _path_vector(path)
        x[i, PATH : PATH + WORDS] = np.bincount([zlib.crc32(w.encode()) & (WORDS - 1) for w in words], minlength=WORDS) / len(words)
        n = len(text)
        x[i, PATH + WORDS : PATH + WORDS + 7] = (min(1.5, np.log1p(n) / 6), links, text.count(".") * 10 / (n + 20), min(1.0, len(words) / 60), text[-1] in ".!?:", (i + 1) / len(own), min(1.0, len(own) / 60))
    x[:, PATH + WORDS + 7 :] = _masses(own)
    return x


class Labeller:
    """One bidirectional LSTM layer and a logistic output over both directions."""

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        size = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.w = {f"{d}{k}": v for d in "fb" for k, v in (("x", size(INPUT, 4 * HIDDEN)), ("h", size(HIDDEN, 4 * HIDDEN)), ("c", np.repeat(np.float32([0, 1, 0, 0]), HIDDEN)))}
        self.w |= {"o": size(2 * HIDDEN, 1)[:, 0], "oc": np.zeros(1, np.float32), "s": np.zeros(INPUT, np.float32)}

    def _pass(self, d: str, x: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        """x: pages x steps x INPUT. A masked step keeps the state."""
        n, steps, _ = x.shape
        gx = x @ self.w[f"{d}x"] + self.w[f"{d}c"]
        h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        out = np.zeros((n, steps, HIDDEN), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            g = gx[:, t] + h @ self.w[f"{d}h"]
            s = 1 / (1 + np.exp(-np.clip(g[:, : 3 * HIDDEN], -30, 30)))
            i, f, o, u = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :], np.tanh(g[:, 3 * HIDDEN :])
            m = mask[:, t, None]
            c1 = f * c + i * u
            tc = np.tanh(c1)
            if keep is not None:
                keep.append((t, h, c, i, f, o, u, tc, m))
            h, c = np.where(m, o * tc, h), np.where(m, c1, c)
            out[:, t] = h
        return out

    def logits(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        h = np.concatenate((self._pass("f", x, mask), self._pass("b", x, mask)), 2)
        return h @ self.w["o"] + x @ self.w["s"] + self.w["oc"]

    def gradient(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        kept: dict[str, list] = {"f": [], "b": []}
        h = np.concatenate([self._pass(d, x, mask, kept[d]) for d in "fb"], 2)
        z = h @ self.w["o"] + x @ self.w["s"] + self.w["oc"]
        e = np.where(mask, 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y, 0).astype(np.float32) / mask.sum()
        g = {"o": np.einsum("nt,nth->h", e, h), "oc": e.sum(keepdims=True)[0], "s": np.einsum("nt,nti->i", e, x)}
        for k, d in enumerate("fb"):
            wo = self.w["o"][k * HIDDEN : (k + 1) * HIDDEN]
            dgx = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
            gh = np.zeros_like(self.w[f"{d}h"])
            dh, dc = np.zeros((len(x), HIDDEN), np.float32), np.zeros((len(x), HIDDEN), np.float32)
            for t, h0, c0, i, f, o, u, tc, m in reversed(kept[d]):
                dh = dh + e[:, t, None] * wo
                d1 = np.where(m, dh, 0)
                dc1 = np.where(m, dc, 0) + d1 * o * (1 - tc**2)
                dg = np.concatenate((dc1 * u * i * (1 - i), dc1 * c0 * f * (1 - f), d1 * tc * o * (1 - o), dc1 * i * (1 - u**2)), 1)
                dgx[:, t] = dg
                gh += h0.T @ dg
                dh = np.where(m, dg @ self.w[f"{d}h"].T, dh)
                dc = np.where(m, dc1 * f, dc)
            g |= {f"{d}x": np.einsum("nti,ntg->ig", x, dgx, optimize=True), f"{d}h": gh, f"{d}c": dgx.sum((0, 1))}
        return g


def padded(xs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, xs))
    x, mask = np.zeros((len(xs), steps, INPUT), np.float32), np.zeros((len(xs), steps), bool)
    for i, own in enumerate(xs):
        x[i, : len(own)], mask[i, : len(own)] = own, True
    return x, mask


#: names that page makers give to parts; the generated pages draw from them
MAIN = ["article", "main", "div.content", "div.post", "div.entry", "div.article-body", "section.story", "div#main-content", "div.text", "div.post-content"]
WRAP = ["div.wrap", "div.container", "div.row", "div", "section", "div#page", "div.col"]
NOISE = {
    "menu": ["nav", "div.menu", "ul.nav", "div#navigation", "div.breadcrumb", "header"],
    "footer": ["footer", "div.footer", "div#footer", "div.copyright"],
    "aside": ["aside", "div.sidebar", "div#sidebar", "div.related", "div.widget"],
    "advert": ["div.ad", "div.ads", "div.advert", "div.banner", "div.promo", "div.sponsored", "ins.adsbygoogle"],
    "notice": ["div.cookie", "div.notice", "div.consent", "div#cookie-banner", "div.newsletter", "div.alert"],
    "form": ["form", "div.search", "form.subscribe"],
    "comments": ["div.comments", "section.comments", "div#comments", "ol.commentlist", "div.comment", "section.discussion"],
    "share": ["div.share", "ul.social", "div.tags", "div.meta"],
}
#: words that such parts often hold, in the languages of the generated pages
SAID = {
    "menu": "home about contact news products login accueil actualités kontakt startseite über inicio noticias",
    "footer": "© copyright all rights reserved privacy terms imprint impressum mentions légales aviso legal",
    "aside": "related popular latest read more posts lire aussi mehr zum thema más leídos",
    "advert": "sponsored advertisement buy now sale offer anzeige publicité publicidad oferta",
    "notice": "cookies we use accept settings consent subscribe newsletter accepter akzeptieren aceptar suscribirse",
    "form": "name email search submit send password username suche envoyer enviar buscar",
    "comments": "reply says ago comment comments antworten répondre responder thanks agree",
    "share": "share tweet tags posted by print teilen partager compartir",
}
#: how a page is laid out: usual names, names without meaning, no names, tables, nothing but paragraphs
STYLES = {"named": 0.45, "opaque": 0.2, "bare": 0.15, "table": 0.12, "flat": 0.08}


#: chance of a structure in place of a paragraph, and of links in a table in place of a list
STRUCTURES, TABLED = 0.05, 0.4


def generated_page(rng: np.random.Generator, style: str | None = None) -> tuple[str, list[tuple[str, bool]]]:
    """A page and its blocks with their labels."""
    pick = lambda xs: xs[rng.integers(len(xs))]
    style = style or str(rng.choice(list(STYLES), p=list(STYLES.values())))
    syllables = ["the", "an", "er", "on", "re", "ch", "de", "la", "que", "ung", "ier", "os", "st", "mi", "ra", "é", "ß", "ñ", "tion"]
    word = lambda: "".join(pick(syllables) for _ in range(rng.integers(1, 4))) + pick(["", "", "", "", ",", "%%%", "!!"] if junk else ["", "", "", "", ","])
    junk = rng.random() < 0.15
    parts: list[str] = []
    own: list[tuple[str, bool]] = []
    opaque: dict[str, str] = {}
    keeps_tags = style == "named" or (style == "opaque" and rng.random() < 0.4)

    def sentence(lo: int, hi: int, kind: str = "") -> str:
        said = SAID[kind].split() if kind and rng.random() < 0.5 else []
        return " ".join(pick(said) if said and rng.random() < 0.4 else word() for _ in range(rng.integers(lo, hi))) + pick([".", ".", ".", ""])

    def start(name: str) -> tuple[str, str]:
        tag, kind, rest = re.match(r"(\w+)([.#]?)(.*)", name).groups()
        tag = "div" if tag == "ins" or (not keeps_tags and tag not in ("ul", "ol", "form")) else tag
        if style == "opaque":
            rest = opaque.setdefault(name, "".join(pick("bcdfghjklmnpqrstvwxz") + pick("aeiou") for _ in range(rng.integers(1, 4))) + pick(["", "-a", "__x", "-col"]))
            kind = kind or pick([".", ".", ""])
        if style in ("bare", "table", "flat") and rng.random() < 0.9:
            kind = ""
        return f"<{tag}" + (f' {"class" if kind == "." else "id"}="{rest}"' if kind else "") + (' data-x="1"' if rng.random() < 0.2 else "") + ">", f"</{tag}>"

    def block(tag: str, text: str, main: bool, closed: bool = True) -> None:
        inner = f"<b>{text}<br>" if tag == "p" and rng.random() < 0.05 else text
        parts.append(f"<{tag}>{inner}" + (f"</{tag}>" if closed else ""))
        own.append((" ".join(text.split()), main))

    def linked(tag: str, text: str) -> None:
        parts.append(f'<{tag}><a href="/{word()}">{text}</a></{tag}>')
        own.append((" ".join(text.split()), False))

    def comment() -> None:
        a, z = start(pick(["li", "div.comment", "div.reply", "div"]))
        parts.append(a)
        if rng.random() < 0.8:
            block(pick(["div", "span", "p", "h4"]) if rng.random() < 0.7 else "div", f"{word()} {word()} {pick(['', '', 'says', '12:30', '2 h ago', '03.04.2021'])}", False)
        for _ in range(rng.integers(1, 3)):
            block(pick(["p", "p", "div"]), sentence(3, 50, "comments" if rng.random() < 0.3 else ""), False)
        if rng.random() < 0.5:
            linked("div", pick(["Reply", "Antworten", "Répondre", "Responder", "Like"]))
        parts.append(z)

    def noise(kind: str) -> None:
        a, z = start(pick(NOISE[kind]))
        parts.append(a)
        if kind in ("menu", "share", "aside") and rng.random() < 0.8:
            if kind == "aside" and rng.random() < 0.5:
                block(pick(["h3", "h4", "div"]), sentence(1, 4, kind), False)
            roll = rng.random()
            tags = ("<ul>", "li", "</ul>") if roll < 0.7 - TABLED else ("<table>", "td", "</table>") if roll < 0.7 else ("", "div", "")
            parts.append(tags[0])
            for _ in range(rng.integers(2, 9)):
                if tags[1] == "td" and rng.random() < 0.7:
                    parts.append("<tr>")
                linked(tags[1], sentence(1, 9 if kind == "aside" else 4, kind))
            parts.append(tags[2])
        elif kind == "comments":
            if rng.random() < 0.6:
                block(pick(["h2", "h3", "div"]), f"{rng.integers(1, 90)} {pick(['comments', 'responses', 'Kommentare', 'commentaires', 'comentarios', word()])}", False)
            for _ in range(rng.integers(1, 6)):
                comment()
        elif kind == "form":
            t = sentence(1, 6, kind)
            parts.append(f'<label>{t}</label><input type="text"><button>{t}</button>')
            own.append((" ".join(t.split()), False))
            own.append((" ".join(t.split()), False))
        elif rng.random() < 0.5:
            t = sentence(1, 25, kind)
            parts.append(pick(["", "&copy; "]) + t)
            own.append((" ".join(_html.unescape(parts[-1]).split()), False))
        else:
            block("p", sentence(2, 30, kind), False)
        parts.append(z)

    def structure() -> None:
        """What an article holds beside paragraphs: a data table, a list, terms, code, a figure."""
        kind = pick(["list", "terms", "code", "figure"] + ["table"] * (0 if style == "table" else 4))
        if kind == "table":
            columns, heads = int(rng.integers(2, 5)), rng.random() < 0.7
            parts.append(pick(["<table>", "<table>", '<table class="' + word().strip(",%!") + '">', "<div><table>"]))
            nested = parts[-1].startswith("<div>")
            if rng.random() < 0.25:
                block("caption", sentence(2, 8), True)
            for row in range(rng.integers(2, 6)):
                parts.append("<tr>")
                for _ in range(columns):
                    number = f"{rng.integers(0, 10 ** rng.integers(1, 6))}{pick(['', '', '.5', ' %', ' km'])}"
                    block("th" if heads and row == 0 else "td", sentence(1, 4) if row == 0 or rng.random() < 0.4 else number, True, rng.random() < 0.95)
                parts.append("</tr>")
            parts.append("</table></div>" if nested else "</table>")
        elif kind == "list":
            tag = pick(["ul", "ol"])
            parts.append(f"<{tag}>")
            for _ in range(rng.integers(2, 8)):
                block("li", sentence(1, 25), True)
            parts.append(f"</{tag}>")
        elif kind == "terms":
            parts.append("<dl>")
            for _ in range(rng.integers(1, 5)):
                block("dt", sentence(1, 4), True)
                block("dd", sentence(2, 25), True)
            parts.append("</dl>")
        elif kind == "code":
            block("pre", "\n".join(f"{word()}({word()}) = {rng.integers(100)};" for _ in range(rng.integers(1, 8))), True)
        else:
            parts.append('<figure><img src="x.png">')
            block("figcaption", sentence(2, 20), True)
            parts.append("</figure>")

    def main_part() -> None:
        if rng.random() < 0.8:
            block(pick(["h1", "h1", "h2"]), sentence(3, 16), True)
        leaf = "p" if style == "named" or rng.random() < 0.8 else pick(["div", "section"])
        for _ in range(rng.integers(1, 16)):
            roll = rng.random()
            if roll < 0.08 and style != "flat":
                noise(pick(["advert", "share", "aside"]))
            elif roll < 0.16:
                block(pick(["h2", "h3", "li", "blockquote"]), sentence(1, 12), True)
            elif roll < 0.16 + STRUCTURES:
                structure()
            else:
                block(leaf, sentence(1, 8) if rng.random() < 0.3 else sentence(8, 120), True, leaf != "p" or rng.random() < 0.95)

    depth = [start(pick(WRAP)) for _ in range(rng.integers(0, 3))] if style != "flat" else []
    parts += [a for a, _ in depth]
    for kind in ("menu", "advert", "notice", "form"):
        if rng.random() < (0.8 if kind == "menu" else 0.35):
            noise(kind)
    left = rng.random() < (0.5 if style == "table" else 0.2)
    if style == "table":
        parts.append("<table><tr><td>")
    if left:
        noise("aside" if rng.random() < 0.6 else "menu")
    a, z = ("<td>", "</td>") if style == "table" else ("", "") if style == "flat" else start(pick(MAIN[:2]) if rng.random() < 0.5 else pick(MAIN))
    parts.append(a)
    main_part()
    parts.append(z)
    if style == "table":
        if not left:
            parts.append("<td>")
            noise("aside")
        parts.append("</table>")
    for kind in ("comments", "share", "aside", "advert", "notice", "form", "footer"):
        if rng.random() < {"comments": 0.45, "footer": 0.85, "aside": 0.0 if left or style == "table" else 0.4}.get(kind, 0.2):
            noise(kind)
    parts += [z for _, z in reversed(depth)]
    return "<html><head><title>x</title></head><body>" + "".join(parts) + ("</body></html>" if rng.random() < 0.9 else ""), own


@lru_cache(maxsize=2)
def train(seed: int = 7, pages: int = 1900, epochs: int = 7, batch: int = 64, styles: tuple[str, ...] = ()) -> Labeller:
    """Adam over generated pages; the same seed gives the same weights. On some pages names are
    left out once more, so that they are a hint and not a need. ``styles``: only these."""
    rng = np.random.default_rng(seed)
    xs, ys = [], []
    for _ in range(pages):
        page, own = generated_page(rng, str(rng.choice(styles)) if styles else None)
        got = leaf_blocks(page)
        if [b[0] for b in got] == [t for t, _ in own]:
            xs.append(features(got))
            ys.append(np.array([y for _, y in own], np.float32))
    model = Labeller(seed)
    m = {k: np.zeros_like(v) for k, v in model.w.items()}
    v = {k: np.zeros_like(x) for k, x in model.w.items()}
    step = 0
    for epoch in range(epochs):
        order = sorted(rng.permutation(len(xs)), key=lambda i: len(xs[i]) // 8)
        runs = [order[i : i + batch] for i in range(0, len(order), batch)]
        for r in rng.permutation(len(runs)):
            x, mask = padded([xs[i] for i in runs[r]])
            x[:, :, :PATH] *= rng.random((len(x), 1, PATH)) > 0.05
            x[:, :, TAGS:PATH] *= rng.random((len(x), 1, 1)) > 0.1
            y = np.zeros(mask.shape, np.float32)
            for k, i in enumerate(runs[r]):
                y[k, : len(ys[i])] = ys[i]
            step += 1
            rate = 0.012 * (1 - epoch / epochs) + 0.001
            for k, g in model.gradient(x, mask, y).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                model.w[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return model


def label(pages: list[str], model: Labeller, most: int = 40_000) -> list[tuple[list[str], np.ndarray]]:
    """Each page's block texts and the probability that each is main text. Pages of similar
    length share a batch of at most ``most`` blocks, unless one page alone has more."""
    own = [leaf_blocks(p) for p in pages]
    out: list[tuple[list[str], np.ndarray]] = [([x[0] for x in b], np.zeros(len(b))) for b in own]
    order = sorted((i for i in range(len(own)) if own[i]), key=lambda i: len(own[i]))
    at = 0
    while at < len(order):
        to = at + 1
        while to < len(order) and len(own[order[to]]) * (to - at + 1) <= most:
            to += 1
        x, mask = padded([features(own[i]) for i in order[at:to]])
        p = 1 / (1 + np.exp(-np.clip(model.logits(x, mask), -30, 30)))
        for k, i in enumerate(order[at:to]):
            out[i] = out[i][0], p[k, : len(own[i])]
        at = to
    return out


def extract(pages: DataFrame, model: Labeller | None = None, cutoff: float = 0.5) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages`` (``page_id, url, html``).

    Null or empty html, and pages without a main block, give an empty text. Repeated rows
    come back as often; other columns are ignored.
    """
    model = model or train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, len(b), 512):
                part = b.slice(lo, 512)
                texts = ["\n".join(t for t, q in zip(own, p, strict=True) if q >= cutoff) for own, p in label([x or "" for x in part.column("html").to_pylist()], model)]
                yield pa.record_batch([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
