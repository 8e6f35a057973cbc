"""Text and tables of PDF files: the placed words of a page and the lines drawn around them.

A page's words go into the cells that its drawn lines form; where none are drawn, gaps between words
part cells. Fonts are read by their table to Unicode, else by the Western code page. Encrypted files,
other filters than the deflate one and codes without a letter raise an error; scans have no words.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

Ref = tuple[str, int]
TOKEN = re.compile(
    rb"[\x00\t\n\x0c\r ]+|%[^\r\n]*|(?P<ref>\d+[\s]+\d+[\s]+R(?![A-Za-z]))|(?P<number>[+-]?(?:\d+\.?\d*|\.\d+))|/(?P<name>[^\x00\t\n\x0c\r ()<>\[\]{}/%]*)"
    rb"|(?P<open><<|\[)|(?P<close>>>|\])|<(?P<hex>[0-9A-Fa-f\s]*)>|(?P<text>\()|(?P<word>[A-Za-z'\"*][A-Za-z0-9'\"*]*)"
)
ESCAPES = {ord("n"): 10, ord("r"): 13, ord("t"): 9, ord("b"): 8, ord("f"): 12}


# --- objects ----------------------------------------------------------------


def _literal(data: bytes, at: int) -> tuple[bytes, int]:
    """The text after an opening bracket and the place behind its closing one."""
    out, depth = bytearray(), 1
    while at < len(data):
        c = data[at]
        at += 1
        if c == 92:
            octal = re.compile(rb"[0-7]{1,3}").match(data, at)
            if octal:
                out.append(int(octal[0], 8) & 255)
                at = octal.end()
            elif data[at : at + 1] in (b"\r", b"\n"):
                at += 2 if data[at : at + 2] == b"\r\n" else 1
            elif at < len(data):
                out.append(ESCAPES.get(data[at], data[at]))
                at += 1
            continue
        depth += (c == 40) - (c == 41)
        if not depth:
            return bytes(out), at
        out.append(c)
    raise ValueError("a text without an end")


def tokens(data: bytes, at: int = 0) -> Iterator[tuple[str, object, int]]:
    """(kind, value, place behind): ref, number, name, text, word, and whole lists and dictionaries as value."""
    held: list[list] = []
    while at < len(data):
        found = TOKEN.match(data, at)
        if found is None:
            at += 1
            continue
        at, kind = found.end(), found.lastgroup
        if kind is None:
            continue
        raw = found[kind]
        if kind == "open":
            held.append([raw])
            continue
        if kind == "close":
            if not held:
                continue
            first, *values = held.pop()
            value = values if first == b"[" else dict(zip(values[::2], values[1::2], strict=False))
            kind = "value"
        elif kind == "ref":
            value = ("ref", int(raw.split()[0]))
        elif kind == "number":
            value = float(raw)
        elif kind == "name":
            value = "/" + re.sub(rb"#([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), raw).decode("latin-1")
        elif kind == "hex":
            digits = re.sub(rb"\s", b"", raw)
            kind, value = "text", bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        elif kind == "text":
            value, at = _literal(data, at)
        else:
            value = raw.decode()
            if held:
                value = {"true": True, "false": False}.get(value)
        if held:
            held[-1].append(value)
        else:
            yield kind, value, at


class Pdf:
    """The objects of a file by number; of several with one number the last counts."""

    def __init__(self, data: bytes):
        if b"%PDF" not in data[:1024]:
            raise ValueError("not a PDF file")
        self.data, self.objects, self.trailer = data, {}, {}
        for found in re.finditer(rb"(?<![0-9])(\d+)\s+\d+\s+obj\b", data):
            self.objects[int(found[1])] = found.end()
        for found in re.finditer(rb"\btrailer\b", data):
            self.trailer |= next((v for _, v, _ in tokens(data, found.end())), None) or {}
        for number in [n for n, at in self.objects.items() if isinstance(at, int)]:
            value = self.get(("ref", number))
            if not isinstance(value, dict):
                continue
            if value.get("/Type") == "/XRef":
                self.trailer = {k: v for k, v in value.items() if k in ("/Root", "/Encrypt")} | self.trailer
            elif value.get("/Type") == "/ObjStm" and "/Encrypt" not in self.trailer:
                packed, first = self.stream(("ref", number)), int(value["/First"])
                head = [int(v) for _, v, _ in tokens(packed[:first])]
                for inner, offset in zip(head[::2], head[1::2], strict=True):
                    held = self.objects.get(inner)
                    if not isinstance(held, int) or held < self.objects[number]:
                        self.objects[inner] = (next(v for _, v, _ in tokens(packed, first + offset)),)
        if "/Encrypt" in self.trailer:
            raise ValueError("an encrypted file")

    def get(self, value: object) -> object:
        """The value, or the object that it refers to."""
        for _ in range(32):
            if not (isinstance(value, tuple) and value[0] == "ref"):
                return value
            at = self.objects.get(value[1])
            value = at[0] if isinstance(at, tuple) else None if at is None else next((v for _, v, _ in tokens(self.data, at)), None)
        raise ValueError("references in a ring")

    def stream(self, ref: Ref) -> bytes:
        """The unpacked bytes of a stream."""
        at = self.objects[ref[1]]
        _, head, at = next(tokens(self.data, at))
        begin = re.compile(rb"\s*stream\r?\n").match(self.data, at)
        if begin is None:
            raise ValueError("no stream")
        length = self.get(head.get("/Length"))
        end = begin.end() + int(length) if isinstance(length, float) else -1
        if end < 0 or not re.match(rb"\s*endstream", self.data[end : end + 20]):
            end = self.data.index(b"endstream", begin.end())
        raw, filters = self.data[begin.end() : end], self.get(head.get("/Filter")) or []
        for name in filters if isinstance(filters, list) else [filters]:
            if name not in ("/FlateDecode", "/Fl"):
                raise ValueError(f"filter {name} is not read")
            raw = zlib.decompressobj().decompress(raw)
        return raw

    def pages(self) -> Iterator[dict]:
        """The pages in order, each with the resources it has or inherits."""
        seen: set = set()

        def below(ref: object, resources: object) -> Iterator[dict]:
            node = self.get(ref)
            if not isinstance(node, dict) or ref in seen:
                return
            seen.add(ref)
            resources = node.get("/Resources", resources)
            if "/Kids" in node:
                for kid in self.get(node["/Kids"]):
                    yield from below(kid, resources)
            else:
                yield node | {"/Resources": resources}

        root = self.get(self.trailer.get("/Root"))
        if not isinstance(root, dict):
            raise ValueError("no page tree")
        yield from below(root.get("/Pages"), {})


# --- fonts ------------------------------------------------------------------


class Font:
    """Letters and widths (in thousandths of the size) of the codes of a font."""

    def __init__(self, pdf: Pdf, ref: object):
        font = pdf.get(ref) or {}
        self.wide = font.get("/Subtype") == "/Type0"
        self.letters: dict[int, str] = {}
        encoding = pdf.get(font.get("/Encoding"))
        if "/ToUnicode" in font:
            self.letters = _letters(pdf.stream(font["/ToUnicode"]))
        elif not self.wide and isinstance(encoding, dict):
            self.letters = _named(pdf.get(encoding.get("/Differences")) or [])
        self.widths: dict[int, float] = {}
        if self.wide:
            inner = pdf.get(pdf.get(font["/DescendantFonts"])[0])
            self.default = float(pdf.get(inner.get("/DW")) or 1000)
            held = list(pdf.get(inner.get("/W")) or [])
            while held:
                first, then = int(held.pop(0)), pdf.get(held.pop(0))
                if isinstance(then, list):
                    self.widths |= {first + i: float(w) for i, w in enumerate(then)}
                else:
                    self.widths |= dict.fromkeys(range(first, int(then) + 1), float(held.pop(0)))
        else:
            first = int(pdf.get(font.get("/FirstChar")) or 0)
            self.default = 500.0
            self.widths = {first + i: float(pdf.get(w)) for i, w in enumerate(pdf.get(font.get("/Widths")) or [])}

    def said(self, raw: bytes) -> list[tuple[str, float]]:
        """(letters, width) of each code."""
        codes = [int.from_bytes(raw[i : i + 2], "big") for i in range(0, len(raw) - 1, 2)] if self.wide else list(raw)
        return [(self._letter(code), self.widths.get(code, self.default)) for code in codes]

    def _letter(self, code: int) -> str:
        if code in self.letters:
            return self.letters[code]
        if self.wide:
            raise ValueError(f"code {code} has no letter")
        return bytes([code]).decode("cp1252")


def _named(differences: list) -> dict[int, str]:
    """Code -> letter from names that state it (uni0416, one letter); another name can't be read."""
    out, code = {}, 0
    for value in differences:
        if isinstance(value, float):
            code = int(value)
            continue
        stated = re.fullmatch(r"/(?:uni|u)([0-9A-F]{4,6})|/(.)|/(space)", value)
        if stated:
            out[code] = chr(int(stated[1], 16)) if stated[1] else stated[2] or " "
        elif code > 126:
            raise ValueError(f"letter name {value} is not read")
        code += 1
    return out


def _letters(table: bytes) -> dict[int, str]:
    """Code -> letters from a font's table to Unicode."""
    out: dict[int, str] = {}
    for kind, body in re.findall(rb"beginbf(char|range)(.*?)endbf", table, re.S):
        values = [v for _, v, _ in tokens(body)]
        step = 2 if kind == b"char" else 3
        for held in (values[i : i + step] for i in range(0, len(values) - step + 1, step)):
            low, target = int.from_bytes(held[0], "big"), held[-1]
            for i in range(int.from_bytes(held[1], "big") - low + 1 if step == 3 else 1):
                if isinstance(target, list):
                    out[low + i] = target[i].decode("utf-16-be")
                else:
                    whole = int.from_bytes(target, "big") + i
                    out[low + i] = whole.to_bytes(len(target), "big").decode("utf-16-be")
    return out


# --- pages ------------------------------------------------------------------

Matrix = tuple[float, float, float, float, float, float]
ONE: Matrix = (1, 0, 0, 1, 0, 0)


def _times(a: Matrix, b: Matrix) -> Matrix:
    return (
        a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2],
        a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5],
    )


def _at(m: Matrix, x: float, y: float) -> tuple[float, float]:
    return x * m[0] + y * m[2] + m[4], x * m[1] + y * m[3] + m[5]


def placed(pdf: Pdf, page: dict) -> tuple[list[tuple], list[tuple]]:
    """((x0, x1, y, size, letters) of each code, (x0, y0, x1, y1) of each drawn edge) of a page."""
    contents = page.get("/Contents")
    listed = contents if isinstance(contents, list) else pdf.get(contents)
    data = b"\n".join(pdf.stream(r) for r in (listed if isinstance(listed, list) else [contents] if contents else []))
    return _drawn(pdf, data, page.get("/Resources"), ONE, 0)


def _drawn(pdf: Pdf, data: bytes, resources: object, view: Matrix, depth: int) -> tuple[list[tuple], list[tuple]]:
    """What a content stream draws; forms that it uses are drawn in their place."""
    data = re.sub(rb"(?<=\s)BI\s.*?\sEI(?=\s)", b" ", data, flags=re.S)
    resources = pdf.get(resources) or {}
    refs, forms, fonts = pdf.get(resources.get("/Font")) or {}, pdf.get(resources.get("/XObject")) or {}, {}
    start = last = (0.0, 0.0)
    letters, edges, path, args, saved = [], [], [], [], []
    text, line, font = ONE, ONE, None
    size = lead = gap = word_gap = 0.0

    def show(raw: bytes) -> None:
        nonlocal text
        if font is None:
            raise ValueError("text without a font")
        for letter, width in font.said(raw):
            x, y = _at(_times(text, view), 0, 0)
            text = _times((1, 0, 0, 1, width / 1000 * size, 0), text)
            end = _at(_times(text, view), 0, 0)[0]
            scale = _times(text, view)
            letters.append((x, end, y, size * (scale[2] ** 2 + scale[3] ** 2) ** 0.5, letter))
            text = _times((1, 0, 0, 1, gap + (word_gap if letter == " " else 0), 0), text)

    for kind, value, _ in tokens(data):
        if kind != "word":
            args.append(value)
            continue
        if value == "q":
            saved.append((view, font, size, lead, gap, word_gap))
        elif value == "Q" and saved:
            view, font, size, lead, gap, word_gap = saved.pop()
        elif value == "cm":
            view = _times(tuple(args[-6:]), view)
        elif value == "BT":
            text = line = ONE
        elif value == "Tf":
            name, size = args[-2:]
            font = fonts[name] = fonts.get(name) or Font(pdf, refs.get(name))
        elif value == "Tm":
            text = line = tuple(args[-6:])
        elif value in ("Td", "TD", "T*", "'", '"'):
            if value == "TD":
                lead = -args[-1]
            x, y = args[-2:] if value in ("Td", "TD") else (0, -lead)
            if value == '"':
                word_gap, gap = args[-3:-1]
            text = line = _times((1, 0, 0, 1, x, y), line)
            if value in ("'", '"'):
                show(args[-1])
        elif value == "TL":
            lead = args[-1]
        elif value == "Tc":
            gap = args[-1]
        elif value == "Tw":
            word_gap = args[-1]
        elif value == "Tj":
            show(args[-1])
        elif value == "TJ":
            for part in args[-1]:
                if isinstance(part, bytes):
                    show(part)
                else:
                    text = _times((1, 0, 0, 1, -part / 1000 * size, 0), text)
        elif value == "Do":
            form = pdf.get(forms.get(args[-1]))
            if isinstance(form, dict) and form.get("/Subtype") == "/Form":
                if depth > 8:
                    raise ValueError("forms in a ring")
                inner = _times(tuple(pdf.get(form.get("/Matrix")) or ONE), view)
                more = _drawn(pdf, pdf.stream(forms[args[-1]]), form.get("/Resources", resources), inner, depth + 1)
                letters += more[0]
                edges += more[1]
        elif value in ("c", "v", "y"):
            last = _at(view, *args[-2:])
        elif value == "m":
            start = last = _at(view, *args[-2:])
        elif value == "l":
            here = _at(view, *args[-2:])
            path.append((*last, *here))
            last = here
        elif value == "h" and path:
            path.append((*last, *start))
        elif value == "re":
            x, y, w, h = args[-4:]
            corners = [_at(view, *p) for p in ((x, y), (x + w, y), (x + w, y + h), (x, y + h))]
            path += [(*a, *b) for a, b in zip(corners, corners[1:] + corners[:1], strict=True)]
        elif value in ("S", "s", "f", "F", "f*", "B", "B*", "b", "b*"):
            edges += path
            path = []
        elif value == "n":
            path = []
        args = []
    return letters, edges


def words_of(letters: list[tuple]) -> list[tuple]:
    """(x0, x1, y, size, word), parted at spaces and at gaps of a fifth of the size, by lines from the top."""
    lines: list[list[tuple]] = []
    for letter in sorted(letters, key=lambda w: -w[2]):
        if lines and lines[-1][0][2] - letter[2] < 0.4 * max(letter[3], 1):
            lines[-1].append(letter)
        else:
            lines.append([letter])
    out: list[tuple] = []
    for line in lines:
        open_ = False
        for x0, x1, y, size, text in sorted(line, key=lambda w: w[0]):
            if not text.strip():
                open_ = False
            elif open_ and x0 - out[-1][1] < 0.2 * size:
                out[-1] = (out[-1][0], x1, out[-1][2], size, out[-1][4] + text)
            else:
                out.append((x0, x1, line[0][2], size, text))
                open_ = True
    return out


def _levels(values: list[float], near: float = 2.0) -> list[float]:
    """Values that differ, those within ``near`` of the one before left out."""
    out: list[float] = []
    for v in sorted(values):
        if not out or v - out[-1] > near:
            out.append(v)
    return out


def ruled_tables(words: list[tuple], edges: list[tuple]) -> list[list[list[str]]]:
    """Tables whose cells are drawn: edges that touch make one table, words go by their middle."""
    upright = [(a, min(b, d), max(b, d)) for a, b, c, d in edges if abs(a - c) < 1 < abs(b - d)]
    level = [(b, min(a, c), max(a, c)) for a, b, c, d in edges if abs(b - d) < 1 < abs(a - c)]
    bands: list[list[float]] = []
    for _, low, high in sorted(upright, key=lambda e: e[1]):
        if bands and low <= bands[-1][1] + 2:
            bands[-1][1] = max(bands[-1][1], high)
        else:
            bands.append([low, high])
    out = []
    for low, high in reversed(bands):
        xs = _levels([x for x, b, t in upright if b >= low - 1 and t <= high + 1])
        ys = _levels([y for y, _, _ in level if low - 2 <= y <= high + 2])[::-1]
        if len(xs) < 3 or len(ys) < 3:
            continue
        cells: list[list[list[str]]] = [[[] for _ in xs[1:]] for _ in ys[1:]]
        for x0, x1, y, size, text in words:
            x, middle = (x0 + x1) / 2, y + size * 0.3
            row = next((i for i in range(len(ys) - 1) if ys[i] >= middle > ys[i + 1]), None)
            column = next((i for i in range(len(xs) - 1) if xs[i] <= x < xs[i + 1]), None)
            if row is not None and column is not None:
                cells[row][column].append(text)
        out.append([[" ".join(c) for c in row] for row in cells])
    return out


def spaced_table(words: list[tuple]) -> list[list[str]]:
    """One table of the lines with two or more cells; cells end at gaps of the letters' size, and cells above each other are a column."""
    lines: dict[float, list[list]] = {}
    for x0, x1, y, size, text in words:
        cells = lines.setdefault(y, [])
        if cells and x0 - cells[-1][1] < size:
            cells[-1][1:] = [x1, f"{cells[-1][2]} {text}"]
        else:
            cells.append([x0, x1, text])
    rows = [cells for _, cells in sorted(lines.items(), reverse=True) if len(cells) > 1]
    spans: list[list[float]] = []
    for x0, x1, _ in sorted(c for cells in rows for c in cells):
        if spans and x0 < spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], x1)
        else:
            spans.append([x0, x1])
    out = []
    for cells in rows:
        row = [""] * len(spans)
        for x0, _, text in cells:
            at = next(i for i, (low, high) in enumerate(spans) if low <= x0 <= high)
            row[at] = f"{row[at]} {text}".strip()
        out.append(row)
    return out


def read_pdf(content: bytes) -> tuple[list[str], list[list[list[str | None]]]]:
    """The text of each page and the tables of all pages."""
    pdf, texts, tables = Pdf(content), [], []
    for page in pdf.pages():
        letters, edges = placed(pdf, page)
        words = words_of(letters)
        lines: dict[float, list[str]] = {}
        for _, _, y, _, text in words:
            lines.setdefault(y, []).append(text)
        texts.append("\n".join(" ".join(line) for line in lines.values()))
        found = ruled_tables(words, edges) or [spaced_table(words)]
        tables += [[[cell or None for cell in row] for row in t] for t in found if len(t) > 1]
    return texts, tables
