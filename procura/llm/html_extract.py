"""Main text of web pages by a recurrent labeller of blocks.

A page becomes its sequence of leaf blocks. Each block is a vector: hashed tag
path with class and id words, hashed words of its text, and a few numbers such
as length, share of links and how much of the path the blocks beside it have in common. A bidirectional LSTM in numpy reads the sequence
both ways, so that every block is judged in the context of the whole page.

The network is trained on the driver from ``N_PAGES`` pages that a seeded
generator writes in many layouts with known main text.

Defined results: null and empty html give an empty text; so does a page in
which no block is main text; character references are decoded, white space
inside a block becomes one space, blocks join by one space; a page is read
whole, whatever its length, its vectors in stretches of ``STRETCH`` blocks whose
states go on from one to the next, forwards and then backwards; repeated rows give equal results; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procura.workspace import broadcast_object

# --- blocks ---------------------------------------------------------------

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|title|textarea|xmp|iframe|noembed|noframes)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<[!?][^>]*>"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*\"|'[^']*'|[\"'])*+)>",
    re.S | re.I,
)
ATTR = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never shown as text.
HIDDEN = frozenset("head template noscript svg math object canvas audio video datalist".split())
#: An opening tag closes an open element of these names, up to the given parents.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}


def blocks(page: str) -> list[tuple[tuple[str, ...], str, int]]:
    """(path, text, characters in links) of each leaf block with text, in page order."""
    out: list[tuple[tuple[str, ...], str, int]] = []
    stack: list[tuple[str, str]] = []
    parts: list[str] = []
    same: dict[tuple[str, ...], tuple[str, ...]] = {}  # blocks of one path share it
    hidden = links = linked = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                path = tuple(label for _, label in stack)
                out.append((same.setdefault(path, path), text, min(linked, len(text))))
            parts.clear()
        linked = 0

    def pop_to(name: str) -> None:
        nonlocal hidden
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] == name:
                hidden -= sum(n in HIDDEN for n, _ in stack[k:])
                del stack[k:]
                return

    at = 0
    for m in TAG.finditer(page):
        if m.start() > at and not hidden:
            text = page[at : m.start()]
            text = html.unescape(text) if "&" in text else text
            parts.append(text)
            if links:
                linked += len(text.strip())
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if name in INLINE:
            if name == "a":
                links = max(0, links + (-1 if m["close"] else 1))
            continue
        flush()
        if m["close"]:
            links = 0
            pop_to(name)
            continue
        if name in VOID:
            continue
        if stack and stack[-1][0] == "p":
            stack.pop()
        if name in CLOSES:
            ends, until = CLOSES[name]
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in until:
                    break
                if stack[k][0] in ends:
                    hidden -= sum(n in HIDDEN for n, _ in stack[k:])
                    del stack[k:]
                    break
        if name == "body" and hidden:
            pop_to("head")
        label, attrs = name, m["attrs"]
        if attrs:
            for kind, *values in ATTR.findall(attrs):
                label += f" {kind.lower()[0]}." + " ".join(values).strip().lower()
        if m["attrs"].endswith("/") and name not in ("p", "div"):
            continue
        stack.append((name, label))
        hidden += name in HIDDEN
    if at < len(page) and not hidden:
        text = page[at:]
        parts.append(html.unescape(text) if "&" in text else text)
    flush()
    return out


# --- vectors --------------------------------------------------------------

PATH_DIM, WORD_DIM, NUMBERS = 160, 24, 10
DIM = PATH_DIM + WORD_DIM + NUMBERS
SPLIT, VOWEL = re.compile(r"[^a-z0-9]+"), re.compile("[a-z][aeiou]|[aeiou][a-z]")


def _path_vector(path: tuple[str, ...]) -> np.ndarray:
    v = np.zeros(PATH_DIM, dtype=np.float32)
    for depth, label in enumerate(path):
        last = depth == len(path) - 1
        name, _, rest = label.partition(" ")
        words = [f"<{name}>"] + [f".{w}" for w in SPLIT.split(rest) if VOWEL.search(w) and w.isalpha()]  # made-up names have digits, or no vowel
        for word in words + ([f"leaf <{name}>"] if last else []):
            code = zlib.crc32(word.encode())
            for k in range(2):
                v[(code >> (8 * k)) % PATH_DIM] += 1.0 if code >> (30 + k) & 1 else -1.0
    return v


def _shared(path: tuple[str, ...], other: tuple[str, ...]) -> float:
    """The share of a path that another has in common, from the top."""
    if path == other:
        return 1.0
    depth = 0
    for a, b in zip(path, other):  # noqa: B905
        if a != b:
            break
        depth += 1
    return depth / max(len(path), len(other))


def _word_index(word: str) -> int:
    return zlib.crc32(word.lower().strip(".,;:!?()[]\"'").encode()) % WORD_DIM


def vectors(found: list[tuple[tuple[str, ...], str, int]], paths: dict, words: dict, start: int = 0, end: int | None = None) -> np.ndarray:
    """Blocks x DIM, of all blocks of a page or a stretch of them. paths and words remember hashes between pages."""
    end = len(found) if end is None else end
    out = np.zeros((end - start, DIM), dtype=np.float32)
    if len(paths) > 20_000:
        paths.clear()
    if len(words) > 200_000:
        words.clear()
    for i in range(start, end):
        path, text, linked = found[i]
        known = paths.get(path)
        if known is None:
            known = paths[path] = _path_vector(path)
        row = out[i - start]
        row[:PATH_DIM] = known
        said = text.split(" ")
        places = []
        for w in said:
            k = words.get(w)
            if k is None:
                k = words[w] = _word_index(w)
            places.append(k)
        n = len(said)
        row[PATH_DIM : PATH_DIM + WORD_DIM] = np.bincount(places, minlength=WORD_DIM) / n
        ends = text.count(".") + text.count("!") + text.count("?")
        row[PATH_DIM + WORD_DIM :] = (
            np.log1p(len(text)) / 8, np.log1p(n) / 6, linked / len(text), ends / n, float(text[-1] in ".!?"), i / len(found),
            (len(found) - i) / len(found), np.log1p(len(found)) / 8,
            _shared(path, found[i - 1][0]) if i else 0.0, _shared(path, found[i + 1][0]) if i + 1 < len(found) else 0.0,
        )
    return out


# --- network --------------------------------------------------------------

HIDDEN_UNITS = 20


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1.0)


class BlockLabeller:
    """A bidirectional LSTM with one logit a block."""

    def __init__(self, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        h = HIDDEN_UNITS

        def init(rows: int, cols: int) -> np.ndarray:
            return (rng.standard_normal((rows, cols)) / np.sqrt(rows)).astype(np.float32)

        self.p = {"out": init(2 * h, 1), "skip": init(DIM, 1), "bias": np.zeros(1, np.float32)}
        for way in "fb":
            gate = np.zeros(4 * h, np.float32)
            gate[h : 2 * h] = 1.0  # remember at first
            self.p |= {f"x{way}": init(DIM, 4 * h), f"h{way}": init(h, 4 * h), f"b{way}": gate}

    def _run(self, x: np.ndarray, mask: np.ndarray, way: str, keep: list | None = None, carry: list | None = None) -> np.ndarray:
        """x: steps x pages x DIM. Padding comes last; it leaves the state as it was. carry holds state and cell of the stretch before."""
        h = HIDDEN_UNITS
        steps, pages, _ = x.shape
        pre = x @ self.p[f"x{way}"] + self.p[f"b{way}"]
        state, cell = carry or (np.zeros((pages, h), np.float32), np.zeros((pages, h), np.float32))
        out = np.zeros((steps, pages, h), np.float32)
        rec = self.p[f"h{way}"]
        for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
            z = pre[t] + state @ rec
            gates = _sigmoid(z[:, : 3 * h])
            i, f, o = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :]
            g = np.tanh(z[:, 3 * h :])
            new_cell = f * cell + i * g
            shown = np.tanh(new_cell)
            on = mask[t][:, None]
            new_state = on * (o * shown) + (1 - on) * state
            new_cell = on * new_cell + (1 - on) * cell
            if keep is not None:
                keep.append((t, state, cell, i, f, o, g, shown, on))
            state, cell = new_state, new_cell
            out[t] = state
        if carry is not None:
            carry[:] = state, cell
        return out

    def logits(self, x: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        both = [self._run(x, mask, way, None if keep is None else keep.setdefault(way, [])) for way in "fb"]
        joined = np.concatenate(both, axis=2)
        if keep is not None:
            keep["joined"] = joined
        return (joined @ self.p["out"] + x @ self.p["skip"])[:, :, 0] + self.p["bias"]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[dict, float]:
        h, keep = HIDDEN_UNITS, {}
        logit = self.logits(x, mask, keep)
        prob = _sigmoid(logit)
        total = mask.sum()
        loss = float((mask * (np.logaddexp(0, logit) - y * logit)).sum() / total)
        d = (mask * (prob - y) / total).astype(np.float32)
        grad = {"out": np.einsum("tph,tp->h", keep["joined"], d)[:, None], "skip": np.einsum("tpd,tp->d", x, d)[:, None], "bias": np.array([d.sum()])}
        for k, way in enumerate("fb"):
            from_out = d[:, :, None] * self.p["out"][k * h : (k + 1) * h, 0]
            d_state, d_cell = np.zeros_like(from_out[0]), np.zeros_like(from_out[0])
            gh, d_pre = np.zeros_like(self.p[f"h{way}"]), np.zeros((*x.shape[:2], 4 * h), np.float32)
            for t, state, cell, i, f, o, g, shown, on in reversed(keep[way]):
                d_state = d_state + from_out[t]
                live = d_state * on
                d_new = live * o * (1 - shown * shown) + d_cell * on
                dz = np.concatenate(
                    [d_new * g * i * (1 - i), d_new * cell * f * (1 - f), live * shown * o * (1 - o), d_new * i * (1 - g * g)], axis=1
                )
                d_pre[t] = dz
                gh += state.T @ dz
                d_state = dz @ self.p[f"h{way}"].T + d_state * (1 - on)
                d_cell = d_new * f + d_cell * (1 - on)
            grad |= {f"h{way}": gh, f"x{way}": np.einsum("tpd,tpg->dg", x, d_pre), f"b{way}": d_pre.sum(axis=(0, 1))}
        return grad, loss

    def label_long(self, found: list[tuple[tuple[str, ...], str, int]], paths: dict, words: dict, stretch: int) -> np.ndarray:
        """True for the blocks of main text of one page, read in stretches forwards, then backwards; each takes over the state of the one before."""
        h, n = HIDDEN_UNITS, len(found)
        logit = np.zeros(n, np.float32)
        starts = range(0, n, stretch)
        for k, way in enumerate("fb"):
            carry: list = []
            for start in starts if way == "f" else reversed(starts):
                x = vectors(found, paths, words, start, min(n, start + stretch))[:, None]
                shown = self._run(x, np.ones(x.shape[:2], np.float32), way, carry=carry)
                logit[start : start + stretch] += (shown @ self.p["out"][k * h : (k + 1) * h])[:, 0, 0]
                if way == "f":
                    logit[start : start + stretch] += (x @ self.p["skip"])[:, 0, 0] + self.p["bias"]
        return logit > 0

    def label(self, pages: list[np.ndarray], limit: int = 20_000) -> list[np.ndarray]:
        """True for the blocks of main text; pages of like length run together."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        at = 0
        while at < len(order):
            end = at + 1
            while end < len(order) and end - at < 256 and (end - at + 1) * len(pages[order[end]]) <= limit:
                end += 1
            mine = order[at:end]
            x, mask = _padded([pages[i] for i in mine])
            found = self.logits(x, mask) > 0
            for k, i in enumerate(mine):
                out[i] = found[: len(pages[i]), k]
            at = end
        return out


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(p) for p in pages)
    x = np.zeros((steps, len(pages), DIM), np.float32)
    mask = np.zeros((steps, len(pages)), np.float32)
    for k, p in enumerate(pages):
        x[: len(p), k] = p
        mask[: len(p), k] = 1.0
    return x, mask


# --- training pages -------------------------------------------------------

N_PAGES = 2200
#: Class and id words that pages use for what isn't main text, by kind.
FRAME_WORDS = {
    "menu": "menu nav navbar navigation breadcrumb topbar tabs toolbar site-nav links",
    "side": "sidebar side widget related rail aside more trending recommended",
    "ad": "ad ads advert advertisement banner sponsor promo sponsored adbox",
    "notice": "cookie cookies notice consent gdpr alert popup modal privacy",
    "form": "form search newsletter subscribe login signup contact",
    "talk": "comments comment reply discussion disqus responses feedback",
    "foot": "footer foot copyright bottom legal credits",
    "share": "share social sharing tags meta byline author pagination pager",
}
FRAME_ROLES = {"menu": "navigation", "side": "complementary", "ad": "complementary", "notice": "alert", "form": "search", "foot": "contentinfo"}
BODY_WORDS = (
    "content post entry story article-body main-content post-content text page-body entry-content article prose main primary "
    "main-column single detail post-body the-content"
)
#: Words that say nothing about what is inside.
NEUTRAL_WORDS = (
    "wrap wrapper container row col col-8 inner outer box block panel grid page site layout left center right clearfix section "
    "app root view shell frame"
)


def training_page(rng: np.random.Generator) -> tuple[str, dict[str, int]]:
    """A page and the label of each of its block texts."""
    labels: dict[str, int] = {}
    syllables = ("ba", "ke", "li", "mon", "tur", "es", "er", "an", "ti", "on", "é", "ü", "sch", "ci", "ar", "do")

    def pick(options):
        return options[int(rng.integers(len(options)))]

    def chance(p: float) -> bool:
        return bool(rng.random() < p)

    brief, verse, root = chance(0.25), chance(0.12), chance(0.2)

    def text(low: int, high: int, stop: float = 0.9) -> str:
        n = int(rng.integers(low, high + 1))
        said = ["".join(pick(syllables) for _ in range(int(rng.integers(1, 5)))) for _ in range(n)]
        out = " ".join(w + pick(("", "", "", "", "", "", ",", ".")) for w in said)
        return out.capitalize() + ("." if chance(stop) else "")

    def mark(said: str, label: int) -> str:
        labels[" ".join(said.split())] = label
        shown = html.escape(said, quote=False)
        if label and chance(0.15):
            words = shown.split(" ")
            k = int(rng.integers(len(words)))
            words[k] = f'<a href="/{k}">{words[k]}</a>' if chance(0.5) else f"<b>{words[k]}</b>"
            shown = " ".join(words)
        return shown

    def named(kind: str, tags: tuple[str, ...], always: bool = False) -> tuple[str, str]:
        tag = pick(tags)
        word = pick(FRAME_WORDS[kind].split())
        if kind in FRAME_ROLES and chance(0.12):
            return f'<{tag} role="{FRAME_ROLES[kind]}">', f"</{tag}>"
        if tag in ("div", "section", "ul", "p") or always or chance(0.5):
            return f'<{tag} {pick(("class", "class", "id"))}="{word}{pick(("", "", "-1", " box"))}">', f"</{tag}>"
        if chance(0.4):
            return f'<{tag} class="{neutral()}">', f"</{tag}>"
        return f"<{tag}>", f"</{tag}>"

    def link_list(n: int) -> str:
        items = [f'<li><a href="/{i}">{mark(text(1, 3, 0.1), 0)}</a>' + pick(("</li>", "</li>", "</li>", "")) for i in range(n)]
        return pick(("<ul>", '<ul class="list">')) + "".join(items) + "</ul>"

    def link_lines(n: int) -> str:
        return "".join(f'<a href="/{i}">{mark(text(1, 3, 0), 0)}</a>{pick(("<br>", "<br>", "<br><br>"))}' for i in range(n))

    def neutral() -> str:
        """A class that is a common word or what a build tool made up."""
        made_up = "css-" + "".join(pick("0123456789abcdefghijklmnopqrstuvwxyz") for _ in range(6))
        letters = "".join(pick("abcdefghijklmnopqrstuvwxyz") for _ in range(int(rng.integers(2, 8))))
        return pick((pick(NEUTRAL_WORDS.split()), pick(NEUTRAL_WORDS.split()), made_up, pick(("", "", "sc-", "styles_", "x-")) + letters))

    def wrapped(inner: str, p: float) -> str:
        while chance(p):
            name = pick((f' class="{neutral()}"', f' id="{neutral()}"', ""))
            inner = f"<div{name}>{inner}</div>"
            p *= 0.6
        return inner

    def menu() -> str:
        a, b = named("menu", ("nav", "nav", "div", "header"))
        if chance(0.15):  # links alone say what it is
            a, b = f'<div class="{neutral()}">', "</div>"
            return a + pick((link_list, link_lines))(int(rng.integers(3, 9))) + b
        return a + (link_list(int(rng.integers(2, 9))) if chance(0.8) else "".join(f'<a href="#">{mark(text(1, 2, 0), 0)}</a><br>' for _ in range(4))) + b

    def banner() -> str:
        """The name of the site, in a header or in a block that says so."""
        tag = pick(("header", "header", "div"))
        name = pick(("", "", f' class="{neutral()}"')) if tag == "header" else f' {pick(("id", "class"))}="{pick(("header", "head", "masthead", "logo", "site-title"))}"'
        shown = mark(text(1, 4, 0), 0)
        return f"<{tag}{name}>{pick((shown, f'<a href=/>{shown}</a>', f'<p>{shown}</p>', f'<h2><a href=/>{shown}</a></h2>'))}</{tag}>"

    def heading(low: int, high: int, p: float) -> str:
        tag = pick(("h2", "h3", "h3", "h4", "h5", "strong"))
        return f"<{tag}>{mark(text(low, high, 0), 0)}</{tag}>" if chance(p) else ""

    def ad() -> str:
        a, b = named("ad", ("div", "div", "aside", "section"), always=True)
        return a + pick(("", "<p>")) + mark(text(2, 30), 0) + b

    def notice() -> str:
        a, b = named("notice", ("div", "section"), always=True)
        return f"{a}<p>{mark(text(5, 30), 0)}</p><button>{mark(text(1, 2, 0), 0)}</button>{b}"

    def form() -> str:
        a, b = ("<form>", "</form>") if chance(0.6) else ('<form class="' + pick(FRAME_WORDS["form"].split()) + '">', "</form>")
        return f"{a}<label>{mark(text(1, 4, 0), 0)}</label><input name=q><button>{mark(text(1, 2, 0), 0)}</button>{b}"

    def side() -> str:
        a, b = named("side", ("aside", "aside", "div", "section"))
        inner = heading(1, 4, 0.7)
        inner += link_list(int(rng.integers(1, 6))) if chance(0.6) else "".join(f"<p>{mark(text(4, 50), 0)}</p>" for _ in range(int(rng.integers(1, 4))))
        return a + inner + b

    def talk() -> str:
        a, b = named("talk", ("section", "div", "ol"), always=True)
        each = [f'<{pick(("div", "article", "li"))} {pick(("class", "class", "id"))}="{pick(("comment", "comment", "reply", "comment-body"))}"><p>{mark(text(3, 60), 0)}</p>' for _ in range(int(rng.integers(1, 5)))]
        ends = [f"</{e[1:].split(' ')[0]}>" for e in each]
        return a + heading(1, 3, 0.7) + "".join(x + y for x, y in zip(each, ends, strict=True)) + b

    def foot() -> str:
        a, b = named("foot", ("footer", "footer", "footer", "div"), always=False)
        inner = mark("© " + text(2, 20), 0) if chance(0.7) else f"<p>{mark(text(3, 25), 0)}</p>"
        return a + inner + (link_list(int(rng.integers(1, 5))) if chance(0.4) else "") + b

    def share() -> str:
        a, b = named("share", ("div", "p"), always=True)
        return a + mark(text(1, 6, 0.2), 0) + b

    def paragraph() -> str:
        if verse and chance(0.85):
            lines = [mark(text(1, 7, 0.15), 1) for _ in range(int(rng.integers(2, 9)))]
            return pick(("<p>{}</p>", "<p>{}<br></p>", "{}<br><br>", "<div>{}</div>")).format(pick(("<br>", "<br>", "<br/>\n")).join(lines))
        long = chance(0.15 if brief else 0.75)
        said = mark(text(12, 140) if long else text(1, 10), 1)
        form_ = int(rng.integers(0, 19))
        if form_ == 0:
            return f"<h{int(rng.integers(2, 4))}>{mark(text(1, 6, 0), 1)}</h{2}><p>{said}</p>"
        if form_ == 1:
            return "<ul>" + "".join(f"<li>{mark(text(2, 20), 1)}</li>" for _ in range(3)) + "</ul>"
        if form_ == 2:
            return f"<blockquote><p>{said}</p></blockquote>"
        if form_ == 3:
            return f"<p><b>{said}<br>"
        if form_ == 4:
            return f"<p>{said}<br>{mark(text(3, 30), 1)}</p>"
        if form_ == 5:
            return "<table><tr>" + "".join(f"<td>{mark(text(1, 8, 0.2), 1)}</td>" for _ in range(3)) + "</tr></table>"
        if form_ == 6:
            return f"<pre>{said}</pre>"
        if form_ == 7:
            return f"<p>{said}"
        if form_ == 8:
            return f"<p>{said}<ul>" + "".join(f"<li>{mark(text(2, 25), 1)}" for _ in range(int(rng.integers(2, 6)))) + "</ul>"
        if form_ == 9:
            return f"<div{pick(('', f' class={chr(34)}{neutral()}{chr(34)}'))}>{said}</div>"
        if form_ == 10:
            return f"{said}<br><br>"
        if form_ == 11:
            return f"<dl><dt>{mark(text(1, 4, 0), 1)}</dt><dd>{said}</dd></dl>"
        if form_ == 12:
            return f"<figure><img src=x><figcaption>{mark(text(3, 20), 1)}</figcaption></figure><p>{said}</p>"
        return f"<p>{said}</p>"

    def body() -> str:
        way = int(rng.integers(0, 19))
        word = pick(BODY_WORDS.split())
        a, b = [
            ("<article>", "</article>"), ("<article>", "</article>"), ("<main>", "</main>"), ("<main><article>", "</article></main>"),
            (f'<div class="{word}">', "</div>"), (f'<div id="{word}">', "</div>"), (f'<section class="{word}">', "</section>"),
            (f'<article class="{word}">', "</article>"), (f'<div class="{neutral()}"><div class="{word}">', "</div></div>"), ("", ""),
            ('<div role="main">', "</div>"), (f'<{pick(("main", "section", "div"))} role="main" class="{neutral()}">', "</div>"),
            (f'<div class="{neutral()}">', "</div>"), (f'<div class="{neutral()}">', "</div>"), (f'<div class="{word} {neutral()}">', "</div>"),
            (f'<div class="{neutral()}"><div class="{neutral()}">', "</div></div>"), (f'<section class="{neutral()}">', "</section>"),
            (f'<div id="{neutral()}">', "</div>"), ("<div>", "</div>"),
        ][way]
        title = mark(text(2, 12, 0.3), 1)
        head = pick((f"<h1>{title}</h1>", f"<h1>{title}</h1>", f"<header><h1>{title}</h1></header>" if a.endswith("article>") else f"<h1>{title}</h1>"))
        inner = [paragraph() for _ in range(int(rng.integers(2, 7) if brief or verse else rng.integers(0, 14)))]
        for extra, p in ((ad, 0.3), (share, 0.2), (side, 0.12), (form, 0.1), (talk, 0.08)):
            if a and chance(p):
                inner.insert(int(rng.integers(0, len(inner) + 1)), extra())
        if inner and chance(0.3):
            inner.append(f"<p>{mark(text(1, 6), 1)}</p>")
        return a + head * (chance(0.95) or not inner) + "".join(inner) + b

    before = [f() for f, p in ((notice, 0.25), (banner, 0.25), (menu, 0.85), (form, 0.2), (ad, 0.5), (side, 0.2), (menu, 0.15)) if chance(p)]
    after = [f() for f, p in ((share, 0.2), (talk, 0.35), (side, 0.35), (ad, 0.25), (foot, 0.85), (notice, 0.1)) if chance(p)]
    top = f"<header{pick(('', f' class={chr(34)}{neutral()}{chr(34)}'))}>" + before.pop(0) + "</header>" if before and chance(0.3) else ""
    page = "<!DOCTYPE html><html><head><title>x</title><style>p{}</style><script>var a='<p>';</script></head><body>"
    if chance(0.12):  # a table as the frame of the page
        links = pick((link_list, link_lines))(int(rng.integers(3, 9)))
        named_cells = chance(0.3)
        plain = lambda: pick(("", " valign=top", f" class={neutral()}", " width=150"))
        cells = [f"<td{' class=' + pick(FRAME_WORDS['menu'].split()) if named_cells else plain()}>" + links]
        cells.append(f"<td{' class=' + pick(('body', *BODY_WORDS.split())) if named_cells else plain()}>" + body())
        cells += ["<td>" + link_list(int(rng.integers(2, 6)))] * chance(0.3)
        inner = top + "<table" + pick(("", ' width="100%"')) + "><tr>" + "</td>".join(cells) + "</td></tr></table>" + "".join(after)
    else:
        inner = top + wrapped("".join(before), 0.2) + "<!-- x -->" + wrapped(body(), 0.4) + wrapped("".join(after), 0.15)
    if root:
        inner = f'<div {pick(("id", "class"))}="{neutral()}">{inner}</div>'
    page += wrapped(inner, 0.2) + pick(("</body></html>", ""))
    return page, labels


_trained: dict[tuple[int, int], BlockLabeller] = {}


def trained_labeller(seed: int = 3, n_pages: int = N_PAGES, max_epochs: int = 28) -> BlockLabeller:
    """Fit by Adam until 99.9 % of the blocks are right or the epochs are used up; the weights are a running mean over the last steps."""
    if (seed, n_pages) in _trained:
        return _trained[seed, n_pages]
    rng = np.random.default_rng(seed)
    paths: dict = {}
    words: dict = {}
    data = []
    for _ in range(n_pages):
        page, labels = training_page(rng)
        found = blocks(page)
        if found:
            data.append((vectors(found, paths, words), np.array([labels.get(text, 0) for _, text, _ in found], np.float32)))
    net = BlockLabeller(seed)
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    mean = BlockLabeller(seed)
    data.sort(key=lambda d: len(d[1]))
    batches = [data[i : i + 32] for i in range(0, len(data), 32)]
    step = 0
    for epoch in range(max_epochs):
        for k in rng.permutation(len(batches)):
            x, mask = _padded([d[0] for d in batches[k]])
            y = np.zeros(mask.shape, np.float32)
            for i, d in enumerate(batches[k]):
                y[: len(d[1]), i] = d[1]
            grad, _ = net.gradients(x, mask, y)
            norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            step += 1
            rate = 0.02 * min(1.0, 8 / (epoch + 1))
            for name, g in grad.items():
                g = g * min(1.0, 1.0 / (norm + 1e-9))
                m, v = moment[name]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                net.p[name] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
                mean.p[name] += np.float32(max(0.01, 1 / step)) * (net.p[name] - mean.p[name])
        if epoch % 4 == 3:
            right = sum(int((a == (d[1] > 0)).sum()) for a, d in zip(mean.label([d[0] for d in data]), data, strict=True))
            if right >= 0.999 * sum(len(d[1]) for d in data):
                break
    _trained[seed, n_pages] = mean
    return mean


# --- extraction -----------------------------------------------------------


#: Pages are labelled together up to so many blocks; a page with more is read in stretches of so many.
STRETCH = 8192


def extracted(pages: Iterable[str | None], net: BlockLabeller, paths: dict, words: dict, stretch: int = STRETCH) -> Iterator[str]:
    """The main text of each page. No more than twice ``stretch`` blocks are vectors at a time, however long a page is."""
    held: list[list] = []

    def said(found: list, kept: np.ndarray) -> str:
        return " ".join(text for (_, text, _), ok in zip(found, kept, strict=True) if ok)

    def rest() -> Iterator[str]:
        kept = net.label([vectors(f, paths, words) if f else np.zeros((0, DIM), np.float32) for f in held])
        yield from map(said, held, kept)
        held.clear()

    size = 0
    for page in pages:
        found = blocks(page) if page else []
        if len(found) > stretch:
            yield from rest()
            size = 0
            yield said(found, net.label_long(found, paths, words, stretch))
            continue
        held.append(found)
        size += len(found)
        if size > stretch or len(held) == 512:
            yield from rest()
            size = 0
    yield from rest()


def extract(pages: list[str | None], net: BlockLabeller, paths: dict, words: dict, stretch: int = STRETCH) -> list[str]:
    return list(extracted(pages, net, paths, words, stretch))


def main_text(page: Column, net: BlockLabeller, spark) -> Column:
    """The main text of an html column."""
    shared = broadcast_object(spark, net.p)

    def batches(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = BlockLabeller()
        own.p = shared()
        paths: dict = {}
        words: dict = {}
        for part in parts:
            yield pd.Series(list(extracted(part, own, paths, words)), dtype="object")

    return F.pandas_udf(batches, "string")(page)


def op6_html_extract(spark, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    text = main_text(F.col("html"), trained_labeller(), spark)
    return pages.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))
