"""Main text of web pages by a recurrent block labeller.

A page is cut into its leaf blocks: text between block-level tags, with inline tags left out. Each block becomes a vector
of its tag path (the tags, classes and ids above it, hashed), its words (hashed), and a few sizes. A bidirectional LSTM, in
numpy, reads a page's whole sequence of blocks in both directions, so that each is classified with the whole document
as context; blocks it takes for article text are joined in page order.

The labeller is trained here, on pages that a generator makes in many layouts (with menus, headers, footers, sidebars,
notices, adverts, forms, link lists and reader comments around the article), so that no labelled pages are needed and the
result is the same each time. Training takes some seconds, once a process, on the driver; the weights go with the tasks.

The page is gone over once: what closes a tag, quote, comment or script is looked for from where the last search ended, and open
elements are known by their depths. A page of very many blocks runs through the network in pieces that hand on the state.

Defined results: a null html counts as empty and has no text. Markup that is broken, cut off or never closed is read
as far as it goes: an unbalanced quote ends with its tag. Comments, scripts, styles, templates and the head are no blocks; a head
ends at its end tag, or at the first text or tag that can't stand in it. Repeated rows are read each; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import functools
import html
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices

#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr label".split())
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
CONTAINERS = ("ul", "ol", "table", "dl", "select", "div", "article", "section")
#: Elements whose content is no markup, or not shown; the first four reach to the end of the page if they are never closed.
RAW = "script style textarea iframe noscript template svg title".split()
TO_THE_END = frozenset(RAW[:4])
#: What may stand in a head; any other tag, or text, ends it.
IN_HEAD = frozenset("script style noscript template title meta link base basefont bgsound".split())
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I) for tag in (*RAW, "head")}
TAG_NAME = re.compile(r"(/?)([A-Za-z][A-Za-z0-9-]*)")
QUOTE_OR_END = re.compile(r"[>\"']")
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
PATH_DIMS, WORD_DIMS, SIZES = 96, 32, 6
DIMS, HIDDEN = PATH_DIMS + WORD_DIMS + SIZES, 16


class Element:
    """An open element: its tag, the one it stands in, its depth, and the slots of all tags, classes and ids down to it, as bits."""

    __slots__ = ("depth", "own", "slots", "tag")

    def __init__(self, tag: str, names: str, above: Element | None):
        self.tag, self.own = tag, _path_slots(f"{tag} {names}".lower() if names else tag)
        self.depth, self.slots = (above.depth + 1, above.slots) if above else (1, 0)
        for slot in self.own:
            self.slots |= 1 << slot


class Scanner:
    """Finds where things end in a page. What was found, or found missing, is remembered, so that nothing is gone over twice."""

    def __init__(self, page: str):
        self.page, self.next, self.raw_next = page, {}, {}

    def find(self, what: str, start: int) -> int:
        """The first place of `what` from `start` on, -1 if there is none; starts don't go back far."""
        if (at := self.next.get(what)) is None or -1 < at < start:
            at = self.next[what] = self.page.find(what, start)
        return at

    def raw_end(self, tag: str, start: int) -> int:
        """Where the end tag of a raw element begins, -1 if it has none."""
        if (at := self.raw_next.get(tag)) is None or -1 < at < start:
            m = RAW_END[tag].search(self.page, start)
            at = self.raw_next[tag] = m.start() if m else -1
        return at

    def tag_end(self, start: int) -> int:
        """The place of the bracket that closes a tag, -1 if there is none. Quoted values are skipped; a quote that is never
        closed, or whose end no new attribute or bracket follows, is an unbalanced one, and the tag ends at the next bracket."""
        page, at = self.page, start
        while m := QUOTE_OR_END.search(page, at):
            at = m.start()
            if page[at] == ">":
                return at
            stop = self.find(page[at], at + 1)
            if stop < 0 or not (page[stop + 1 : stop + 2] or " ")[0] in " \t\r\n\f/>":
                return self.find(">", at + 1)
            at = stop + 1
        return -1


def blocks_of(page: str) -> list[tuple[Element | None, str, int]]:
    """(element, text, characters inside links) of the leaf blocks in page order, in time that grows with the page's length alone."""
    stack: list[Element] = []
    opened: dict[str, list[int]] = {}  # depths of the open elements of each tag
    scan, out = Scanner(page), []
    parts: list[str] = []
    linked, holder = 0, None

    def cut() -> None:
        nonlocal linked
        if parts:
            if text := " ".join(html.unescape("".join(parts)).split()):
                out.append((holder, text, linked))
            parts.clear()
            linked = 0

    def say(text: str) -> None:
        nonlocal holder, linked
        if not parts:
            holder = stack[-1] if stack else None
        parts.append(text)
        if opened.get("a"):
            linked += len(text)

    def close(depth: int) -> None:
        """Closes all elements from `depth` (1 for the outermost) inwards."""
        while len(stack) >= depth:
            opened[stack.pop().tag].pop()

    at, end, in_head = 0, len(page), False
    while at < end:
        start = page.find("<", at)
        start = end if start < 0 else start
        if start > at:
            if in_head and not page[at:start].isspace():
                in_head = False
            if not in_head:
                say(page[at:start])
        if start == end:
            break
        if page.startswith("<!--", start):
            stop = scan.find("-->", start + 4)
            at = end if stop < 0 else stop + 3
            continue
        if page[start + 1 : start + 2] in ("!", "?"):
            stop = scan.find(">", start + 2)
            at = end if stop < 0 else stop + 1
            continue
        m = TAG_NAME.match(page, start + 1)
        if not m:
            say("<")
            in_head, at = False, start + 1
            continue
        shuts, tag = m[1], m[2].lower()
        stop = scan.tag_end(m.end())
        names_at, at = m.end(), end if stop < 0 else stop + 1
        if tag in RAW_END and not shuts:
            if tag == "head":
                in_head = True
                continue
            if in_head and tag not in IN_HEAD:
                in_head = False
            raw = scan.raw_end(tag, at)
            if raw < 0 and in_head and tag != "title":
                raw = scan.raw_end("head", at)
            if raw < 0 and in_head and tag not in TO_THE_END:
                raw = page.find("<", at)  # the head goes on with the next tag
            if raw >= 0:
                at = raw
            elif in_head or tag in TO_THE_END:
                at = end
            continue
        if in_head:
            if tag in IN_HEAD:
                continue
            in_head = False
            if shuts and tag == "head":
                continue
        if shuts:
            if opened.get(tag):
                if tag not in INLINE:
                    cut()
                close(opened[tag][-1])
            elif tag not in INLINE:
                cut()
            continue
        if tag == "br":
            say(" ")
            continue
        if tag not in INLINE:
            cut()
            shut = CLOSES.get(tag, ()) if tag not in ENDS_P else ("p",)
            if shut and (deepest := max(opened[t][-1] if opened.get(t) else 0 for t in shut)):
                if tag not in CLOSES or deepest > max(opened[t][-1] if opened.get(t) else 0 for t in CONTAINERS):
                    close(deepest)
        if tag not in VOID:
            attributes = page[names_at : max(names_at, stop)]
            names = " ".join(a or b or c for a, b, c in NAMED.findall(attributes)) if "=" in attributes else ""
            stack.append(Element(tag, names, stack[-1] if stack else None))
            opened.setdefault(tag, []).append(len(stack))
    cut()
    return out


@functools.lru_cache(1 << 14)
def _path_slots(entry: str) -> tuple[int, ...]:
    tag, *names = re.findall(r"[a-z0-9]+", entry) or [""]
    return (zlib.crc32(f"t:{tag}".encode()) % PATH_DIMS, *(zlib.crc32(f"n:{n}".encode()) % PATH_DIMS for n in names))


def features(blocks: list[tuple[Element | None, str, int]], first: int = 0, total: int | None = None) -> np.ndarray:
    """The vectors of some blocks, of which `first` is the place of the first one among the page's `total`."""
    total = len(blocks) if total is None else total
    x = np.zeros((len(blocks), DIMS), np.float32)
    crc = zlib.crc32
    for i, (row, (element, text, linked)) in enumerate(zip(x, blocks, strict=True), first):
        depth = 0
        if element:
            depth = element.depth
            row[:PATH_DIMS] = np.unpackbits(np.frombuffer(element.slots.to_bytes(PATH_DIMS // 8, "little"), np.uint8), bitorder="little")
            row[list(element.own)] = 2
        words = text.split()
        seen = np.bincount(np.fromiter((crc(w.encode("utf-8", "surrogatepass")) % WORD_DIMS for w in words), np.int64, len(words)), minlength=WORD_DIMS)
        row[PATH_DIMS : PATH_DIMS + WORD_DIMS] = seen / max(1, len(words))
        row[PATH_DIMS + WORD_DIMS :] = (np.log1p(len(words)) / 4, min(1.0, linked / len(text)), i / total, 1 - i / total, text[-1] in ".!?", depth / 8)
    return x


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class BlockLabeller:
    """A bidirectional LSTM with one logistic output per block. Parameters: for each direction w, u and b, then out and its bias."""

    def __init__(self, params: dict[str, np.ndarray]):
        self.params = params

    @classmethod
    def fresh(cls, seed: int = 3) -> BlockLabeller:
        draw = np.random.default_rng(seed)
        p = {}
        for side in "fb":
            p["w" + side] = draw.normal(0, 0.15, (DIMS, 4 * HIDDEN))
            p["u" + side] = draw.normal(0, 0.2, (HIDDEN, 4 * HIDDEN))
            p["c" + side] = np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN)  # in, forget, out, new
        p["out"], p["bias"] = draw.normal(0, 0.2, 2 * HIDDEN), np.zeros(1)
        return cls({k: v.astype(np.float32) for k, v in p.items()})

    def _run(self, x: np.ndarray, mask: np.ndarray, side: str, keep: list | None = None, state: list | None = None) -> np.ndarray:
        """Hidden states (n, t, h) of one direction; where mask is 0 the state stays. `state` is what it begins with, and is left with."""
        n, t, _ = x.shape
        u = self.params["u" + side]
        fed = x @ self.params["w" + side] + self.params["c" + side]
        h, c = state or (np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32))
        out = np.zeros((n, t, HIDDEN), np.float32)
        for k in range(t) if side == "f" else range(t - 1, -1, -1):
            z = fed[:, k] + h @ u
            gates, new = _sigmoid(z[:, : 3 * HIDDEN]), np.tanh(z[:, 3 * HIDDEN :])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            c2 = f * c + i * new
            tc, m = np.tanh(c2), mask[:, k, None]
            if keep is not None:
                keep.append((k, h, c, i, f, o, new, tc, m))
            h, c = m * (o * tc) + (1 - m) * h, m * c2 + (1 - m) * c
            out[:, k] = h
        if state is not None:
            state[:] = h, c
        return out

    def scores(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._run(x, mask, "f"), self._run(x, mask, "b")], axis=2)
        return both @ self.params["out"] + self.params["bias"]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        kept: dict[str, list] = {"f": [], "b": []}
        both = np.concatenate([self._run(x, mask, s, kept[s]) for s in "fb"], axis=2)
        p = _sigmoid(both @ self.params["out"] + self.params["bias"])
        total = mask.sum()
        loss = float(-(mask * (y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9))).sum() / total)
        dz = mask * (p - y) / total
        g = {"out": np.einsum("nt,nth->h", dz, both), "bias": np.array([dz.sum()], np.float32)}
        dboth = dz[:, :, None] * self.params["out"]
        for side, part in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, None))):
            u, dh_out = self.params["u" + side], dboth[:, :, part]
            du, dfed = np.zeros_like(u), np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
            dh, dc = np.zeros((len(x), HIDDEN), np.float32), np.zeros((len(x), HIDDEN), np.float32)
            for k, h, c, i, f, o, new, tc, m in reversed(kept[side]):
                dh = dh + dh_out[:, k]
                own_h, own_c = dh * m, dc * m + dh * m * o * (1 - tc**2)
                d = np.concatenate([own_c * new * i * (1 - i), own_c * c * f * (1 - f), own_h * tc * o * (1 - o), own_c * i * (1 - new**2)], axis=1)
                dfed[:, k] = d
                du += h.T @ d
                dh, dc = d @ u.T + dh * (1 - m), own_c * f + dc * (1 - m)
            g["u" + side], g["c" + side] = du, dfed.sum(axis=(0, 1))
            g["w" + side] = np.einsum("ntd,ntg->dg", x, dfed, optimize=True)
        return loss, g

    def labels(self, pages: list[list], most: int = 1 << 14) -> list[np.ndarray]:
        """For each page's blocks which are article text. Pages of like length are run together, `most` blocks at a time."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order, at = sorted(range(len(pages)), key=lambda i: len(pages[i])), 0
        while at < len(order):
            end = at + 1
            while end < len(order) and (end + 1 - at) * len(pages[order[end]]) <= most:
                end += 1
            some = order[at:end]
            if (t := len(pages[some[-1]])) > most:
                out[some[0]] = self.long_page(pages[some[0]], most)
            elif t:
                x, mask = padded([features(pages[i]) for i in some], t)
                s = self.scores(x, mask)
                for row, i in zip(s, some, strict=True):
                    out[i] = row[: len(pages[i])] > 0
            at = end
        return out

    def long_page(self, blocks: list, most: int) -> np.ndarray:
        """The same for a page of very many blocks, in pieces that hand on the state, once in each direction."""
        total, scores = len(blocks), np.full(len(blocks), self.params["bias"][0], np.float32)
        for side, out in (("f", self.params["out"][:HIDDEN]), ("b", self.params["out"][HIDDEN:])):
            state = [np.zeros((1, HIDDEN), np.float32), np.zeros((1, HIDDEN), np.float32)]
            starts = range(0, total, most)
            for a in starts if side == "f" else reversed(starts):
                x = features(blocks[a : a + most], a, total)
                scores[a : a + most] += (self._run(x[None], np.ones((1, len(x)), np.float32), side, state=state) @ out)[0]
        return scores > 0


def padded(pages: list[np.ndarray], t: int) -> tuple[np.ndarray, np.ndarray]:
    x, mask = np.zeros((len(pages), t, DIMS), np.float32), np.zeros((len(pages), t), np.float32)
    for k, p in enumerate(pages):
        x[k, : len(p)], mask[k, : len(p)] = p, 1
    return x, mask


class PageMaker:
    """Makes pages of many layouts; article text is wrapped in \x01 and \x02, so that its blocks are known."""

    NOISE = {
        "nav": (("nav", ("", "menu", "main-nav", "navbar")), ("div", ("menu", "navigation", "topnav", "breadcrumb")), ("ul", ("menu", "nav"))),
        "header": (("header", ("", "site-header", "masthead")), ("div", ("header", "banner", "logo"))),
        "footer": (("footer", ("", "site-footer")), ("div", ("footer", "copyright", "bottom"))),
        "aside": (("aside", ("", "sidebar")), ("div", ("sidebar", "related", "widget", "recommended", "share", "social", "tags", "author-bio"))),
        "notice": (("div", ("cookie", "cookie-notice", "notice", "alert", "banner", "gdpr", "newsletter", "popup")), ("section", ("notice",))),
        "ad": (("div", ("ad", "ads", "advert", "sponsored", "promo", "ad-slot")), ("aside", ("ad",)), ("section", ("ads",))),
        "form": (("form", ("", "search", "subscribe", "login", "contact")),),
        "comments": (("section", ("comments", "comment-list", "discussion")), ("div", ("comments", "replies", "reader-comments", "comment")), ("ol", ("comments",))),
    }

    def __init__(self, seed: int):
        self.draw = np.random.default_rng(seed)

    def pick(self, options):
        return options[int(self.draw.integers(len(options)))]

    def chance(self, p: float) -> bool:
        return self.draw.random() < p

    def words(self, low: int, high: int) -> str:
        n = int(self.draw.integers(low, high + 1))
        syllables = self.draw.integers(1, 5, n)
        word = lambda k: "".join(self.pick(("ta", "re", "in", "ou", "é", "sch", "tion", "la", "en", "ö", "mi", "der", "st", "a", "los", "ñ")) for _ in range(k))
        text = " ".join(word(k) + ("," if self.chance(0.08) else "***" if self.junk else "") for k in syllables)
        return text[:1].upper() + text[1:]

    def sentence(self, low: int, high: int) -> str:
        return self.words(low, high) + self.pick((".", ".", ".", "!", "?", "", " &amp;"))

    def links(self, n: int) -> str:
        return "".join(f'<li><a href="/{k}">{self.words(1, 3)}</a></li>' for k in range(n))

    def noise(self, kind: str) -> str:
        tag, names = self.pick(self.NOISE[kind])
        name = self.pick(names)
        attr = f' {self.pick(("class", "class", "id"))}="{name}"' if name else ""
        if kind == "nav":
            own = self.links(int(self.draw.integers(2, 9)))
            own = own if tag == "ul" else f"<ul>{own}</ul>" if self.chance(0.7) else re.sub("</?li>", " ", own)
        elif kind == "form":
            own = f"<label>{self.words(1, 3)}</label><input name=q><select><option>{self.words(1, 2)}<option>{self.words(1, 2)}</select><button>{self.words(1, 2)}</button>"
        elif kind == "comments":
            inner = self.pick(("li", "div", "article", "p"))
            own = f"<h3>{self.words(1, 3)}</h3>" + "".join(f'<{inner}{self.pick(("", " class=comment"))}><b>{self.words(1, 2)}</b> <p>{self.sentence(4, 50)}</p></{inner}>' for _ in range(int(self.draw.integers(1, 6))))
        elif kind == "footer":
            own = self.pick((f"&copy; {self.words(1, 3)} &middot; {self.sentence(3, 20)}", f"<p>&copy; {self.words(2, 8)}</p><ul>{self.links(3)}</ul>", f"<p>{self.sentence(5, 30)}</p>"))
        elif kind == "header":
            own = self.pick((f"<h1>{self.words(1, 4)}</h1>", f"<a href=/>{self.words(1, 3)}</a><p>{self.words(2, 6)}</p>", f"<div>{self.words(1, 3)}</div>"))
        elif kind == "aside":
            own = self.pick((f"<h3>{self.words(1, 3)}</h3><ul>{self.links(4)}</ul>", f"<p>{self.sentence(5, 40)}</p>", f"<h2>{self.words(1, 3)}</h2><p>{self.sentence(3, 20)}</p><a href=x>{self.words(1, 3)}</a>"))
        else:
            own = self.pick((self.sentence(3, 25), f"<p>{self.sentence(3, 30)}</p>", f"<a href=x>{self.words(2, 6)}</a>", f"<p>{self.sentence(3, 25)}</p><button>{self.words(1, 2)}</button>"))
        return f"<{tag}{attr}>{own}</{tag}>"

    def article(self) -> str:
        mark = lambda s: f"\x01{s}\x02"
        title, parts = mark(self.words(3, 14)), []
        for _ in range(int(self.draw.integers(1, 14))):
            parts.append(self.pick((
                lambda: f"<p>{mark(self.sentence(3, 120))}</p>", lambda: f"<p>{mark(self.sentence(10, 160))}</p>", lambda: f"<p>{mark(self.sentence(1, 12))}</p>", lambda: f"<p>{mark(self.sentence(20, 90))}</p>",
                lambda: f"<p><b>{mark(self.sentence(2, 20))}<br>", lambda: f"<{(h := self.pick(('h2', 'h3')))}>{mark(self.words(1, 8))}</{h}>", lambda: f"<p>{mark(self.sentence(10, 60) + ' <a href=x>' + self.words(1, 3) + '</a> ' + self.sentence(3, 30))}</p>",
                lambda: "<ul>" + "".join(f"<li>{mark(self.sentence(2, 20))}</li>" for _ in range(3)) + "</ul>", lambda: f"<blockquote>{mark(self.sentence(5, 40))}</blockquote>",
                lambda: "<table>" + "".join(f"<tr><td>{mark(self.words(1, 4))}</td><td>{mark(self.words(1, 4))}</td></tr>" for _ in range(2)) + "</table>",
                lambda: self.noise("ad") if self.chance(0.4) else f"<p>{mark(self.sentence(5, 50))}</p>",
            ))())
        tag, name = self.pick((("article", ""), ("article", ""), ("article", "post"), ("main", ""), ("div", "content"), ("div", "article-body"), ("div", "post"), ("div", "entry-content"), ("section", "article"), ("td", "main")))
        attr = f' {self.pick(("class", "id"))}="{name}"' if name else ""
        return f"<{tag}{attr}>" + (f"<h1>{title}</h1>" if self.chance(0.9) else "") + "".join(parts) + f"</{tag}>"

    def page(self) -> str:
        self.junk = self.chance(0.08)
        some = lambda kinds, p: "".join(self.noise(k) for k in kinds if self.chance(p))
        above = some(("header", "nav", "notice", "ad", "form"), 0.5)
        if self.chance(0.3):
            above = self.noise("nav") + self.noise("ad")
        below = some(("aside", "comments", "ad", "form", "aside", "notice"), 0.4) + some(("footer",), 0.85)
        body = above + (self.noise("aside") if self.chance(0.25) else "") + self.article() + below
        if self.chance(0.2):
            body = f"<div id=wrapper><div class=container>{body}</div></div>"
        whole = f"<!DOCTYPE html><html><head><title>{self.words(2, 6)}</title></head><body>{body}</body></html>"
        return whole[: int(len(whole) * self.draw.uniform(0.5, 1))] if self.chance(0.1) else whole


def labelled_page(page: str) -> tuple[list, np.ndarray]:
    """Blocks and labels of a page of PageMaker."""
    marked = blocks_of(page)
    y = np.array(["\x01" in t for _, t, _ in marked], np.float32)
    return [(p, " ".join(t.replace("\x01", "").replace("\x02", "").split()) or ".", n) for p, t, n in marked], y


@functools.lru_cache(1)
def trained(pages: int = 900, rounds: int = 9, batch: int = 30, seed: int = 17) -> BlockLabeller:
    """The labeller, trained by Adam on generated pages."""
    maker = PageMaker(seed)
    data = [(features(blocks), y) for blocks, y in (labelled_page(maker.page()) for _ in range(pages)) if len(y)]
    model, draw = BlockLabeller.fresh(), np.random.default_rng(seed)
    mean = {k: np.zeros_like(v) for k, v in model.params.items()}
    square = {k: np.zeros_like(v) for k, v in model.params.items()}
    step = 0
    for r in range(rounds):
        order = draw.permutation(len(data))
        order = order[np.argsort([len(data[i][1]) // 12 for i in order], kind="stable")]  # of like length, in random order
        for a in draw.permutation(np.arange(0, len(order), batch)):
            some = [data[i] for i in order[a : a + batch]]
            t = max(len(y) for _, y in some)
            x, mask = padded([f for f, _ in some], t)
            y = np.zeros(mask.shape, np.float32)
            for k, (_, own) in enumerate(some):
                y[k, : len(own)] = own
            _, g = model.gradients(x, mask, y)
            step += 1
            rate = 0.01 * (1 - 0.8 * r / rounds)
            for k, v in model.params.items():
                d = np.clip(g[k], -1, 1)
                mean[k] = 0.9 * mean[k] + 0.1 * d
                square[k] = 0.99 * square[k] + 0.01 * d**2
                v -= (rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model


def main_text(blocks: list[tuple[Element | None, str, int]], taken: np.ndarray) -> str:
    return " ".join(b[1] for b, t in zip(blocks, taken, strict=True) if t)


def extract_main_text(pages: DataFrame, html_col: str = "html", out_col: str = "text", model: BlockLabeller | None = None) -> DataFrame:
    """page_id, url and the main text of each row."""
    params = (model or trained()).params

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = BlockLabeller(params)
        for batch in batches:
            sources = batch.column(2).to_pylist()
            for a, b in text_slices(sources, 2 << 20):
                cut = [blocks_of(x) for x in sources[a:b]]
                taken = labeller.labels(cut)
                texts = [main_text(x, t) for x, t in zip(cut, taken, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(texts, pa.string())], ["page_id", "url", out_col])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(html_col, F.lit("")).alias("html"))
    return rows.mapInArrow(run, f"page_id long, url string, {out_col} string")
