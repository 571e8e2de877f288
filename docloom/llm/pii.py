"""Personal data, also in disguise, at the places of the source text.

Plain forms are searched in the text as it stands. A transducer then rewrites the
text symbol by symbol: homoglyphs and full-width forms become ASCII, runs of spelled
digits become digits, and ``at``/``dot`` disguises become ``@`` and ``.``. It keeps,
for each symbol of its output, the span of source characters that it came from, so
that what is found in its output is reported in source offsets. Found spans that lie
within a plain span of the same kind aren't added; plain spans always stay.

Each search reads a text once: all quantified runs are taken whole, and no start is
tried twice, so that long runs of digits or letters don't cost their square.

Defined results: null and empty texts have no spans; equal rows give equal rows; an
empty table gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("email", "ip", "card", "phone")

LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
PARTS = re.compile(r"[0-9]+(?:\.[0-9]+){3,}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """As the pattern local@domain finds them from left to right."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL_CHARS:
            start -= 1
        nxt = at + 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            done = nxt = m.end()
        else:
            # What precedes this sign can't belong to a later address.
            done = at + 1
        at = text.find("@", nxt)
    return out


def addresses(text: str) -> list[tuple[int, int]]:
    """Groups of four parts from the left of each chain of dotted numbers."""
    out = []
    if "." not in text:
        return out
    for m in PARTS.finditer(text):
        parts = m.group().split(".")
        at = m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                out.append((at, end))
            at = end + 1
    return out


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    """The last sign of a match is the last digit of its run; one sign at least stands between."""
    out = []
    if "+" not in text:
        return out
    for m in PHONE.finditer(text):
        body = m.group().rstrip(" ().-")
        if len(body) >= 4 and 9 <= sum(c.isdigit() for c in body) <= 15:
            out.append((m.start(), m.start() + len(body)))
    return out


SEARCH = {"email": emails, "ip": addresses, "card": cards, "phone": phones}


def plain(text: str) -> dict[str, list[tuple[int, int]]]:
    return {k: f(text) for k, f in SEARCH.items()}


# Letters of other scripts that look like ASCII ones.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ӏ": "l", "ԛ": "q", "ԝ": "w",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S",
    "α": "a", "ο": "o", "ρ": "p", "ν": "v", "ι": "i", "κ": "k", "υ": "u", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M",
    "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ı": "i", "ɑ": "a", "ɡ": "g", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "․": ".", "。": ".", " ": " ",
}
# Signs that are not seen.
INVISIBLE = frozenset("​‌‍⁠﻿­")
# Names of digits in the languages of the corpus.
DIGITS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
    "plus": "+",
}
SPELLED = "|".join(sorted(DIGITS, key=len, reverse=True))
#: A run of at least four spelled digits, or of a spelled sign among digits.
RUN = re.compile(rf"(?<![^\W_])(?:{SPELLED})(?:(?:[\s,.-]{{1,3}}|\s*[()]\s*)(?:{SPELLED}|[0-9]+)){{3,}}(?![^\W_])", re.I)
NUMBER = re.compile(rf"(?:{SPELLED}|[0-9])(?![^\W_0-9])", re.I)
WORD = r"[A-Za-z0-9_%+-]++"
#: A bracketed sign is enough; bare words at and dot must stand between words of an address.
AT = re.compile(r"\s*[\[({<]\s*(?:at|@)\s*[\])}>]\s*", re.I)
DOT = re.compile(r"\s*[\[({<]\s*(?:dot|\.)\s*[\])}>]\s*", re.I)
SPOKEN = re.compile(rf"(?<![\w.@%+-]){WORD}(?:(?:\s+dot\s+|\.){WORD}){{0,4}}(?:\s+at\s+|@)(?P<domain>{WORD}(?:(?:\s+dot\s+|\.){WORD}){{1,4}})(?![\w@])", re.I)
BETWEEN = re.compile(r"\s+(at|dot)\s+", re.I)
#: After a bare at, a domain without a spoken dot must be one by its looks and no start of a URL.
DOMAIN_ONLY = re.compile(r"(?!www\.)[A-Za-z0-9.-]*\.[A-Za-z]{2,}", re.I)
#: What bare words need before SPOKEN can change a text.
BARE = re.compile(r"\sdot\s|\sat\s+[a-z0-9_%+-]++\.[a-z0-9]")
BRACKET = re.compile(r"[\[({<]\s*(?:at|@|dot|\.)\s*[\])}>]", re.I)
#: Signs beyond Latin letters, among them all that fold() changes.
FOREIGN = re.compile(r"[^\x00-\x9f\xa1-\xac\xae-\xb1\xb4-\xb8\xba-\u0130\u0132-ɏ]")
TOKEN = re.compile(r"[^\W_]+")


def spelled(low: str) -> bool:
    """Whether four spelled digits or numbers follow each other, one of them spelled."""
    tokens = TOKEN.findall(low)
    if DIGITS.keys().isdisjoint(tokens):
        return False
    run = names = 0
    for t in tokens:
        if t in DIGITS:
            run, names = run + 1, names + 1
        elif t.isdigit():
            run += 1
        else:
            run = names = 0
        if run >= 4 and names:
            return True
    return False


def disguised(text: str) -> bool:
    """Whether the transducer might find more than the plain searches."""
    if not text.isascii() and FOREIGN.search(text):
        return True
    low = text.lower()
    return BRACKET.search(low) is not None or BARE.search(low) is not None or spelled(low)


def fold(text: str) -> tuple[str, list[int], list[int]]:
    """Homoglyphs, full-width forms and unseen signs; source start and stop of each sign."""
    out, a, b = [], [], []
    for i, c in enumerate(text):
        if c in INVISIBLE:
            continue
        if c > "\x7f":
            c = HOMOGLYPHS.get(c) or (unicodedata.normalize("NFKC", c) if "！" <= c <= "～" or unicodedata.category(c) == "Nd" or "\U0001d400" <= c <= "\U0001d7ff" else c)
            if c.isdigit() and not c.isascii():
                c = str(unicodedata.digit(c)) if len(c) == 1 else c
        for x in c:
            out.append(x)
            a.append(i)
            b.append(i + 1)
    return "".join(out), a, b


def rewrite(text: str, a: list[int], b: list[int], edits: list[tuple[int, int, str]]) -> tuple[str, list[int], list[int]]:
    """Replace spans of text; a replacement's signs all come from the whole of its span."""
    out, x, y, at = [], [], [], 0
    for i, j, new in sorted(edits):
        if i < at:
            continue
        out.append(text[at:i])
        x += a[at:i] + [a[i]] * len(new)
        y += b[at:i] + [b[j - 1]] * len(new)
        out.append(new)
        at = j
    return "".join(out) + text[at:], x + a[at:], y + b[at:]


def normalise(text: str) -> tuple[str, list[int], list[int]]:
    text, a, b = fold(text)
    edits = []
    for m in RUN.finditer(text) if spelled(text.lower()) else ():
        i = m.start()
        for n in NUMBER.finditer(text, m.start(), m.end()):
            if n.start() > i:
                edits.append((i, n.start(), ""))
            if not n.group().isdigit():
                edits.append((n.start(), n.end(), DIGITS[n.group().lower()]))
            i = n.end()
    edits = [e for e in edits if e[1] > e[0]]
    text, a, b = rewrite(text, a, b, edits)
    edits = [(m.start(), m.end(), "@") for m in AT.finditer(text)] + [(m.start(), m.end(), ".") for m in DOT.finditer(text)]
    for m in SPOKEN.finditer(text):
        domain = m["domain"]
        if "@" not in m.group() and not BETWEEN.search(domain) and (not DOMAIN_ONLY.fullmatch(domain) or text[m.end() : m.end() + 1] in ("/", ":")):
            continue
        edits += [(n.start(), n.end(), "@" if n.group(1).lower() == "at" else ".") for n in BETWEEN.finditer(text, m.start(), m.end())]
    return rewrite(text, a, b, edits)


def uncovered(more: list[tuple[int, int]], spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Those of more that lie within none of spans, which don't cross each other."""
    out, at = [], 0
    for i, j in more:
        while at < len(spans) and spans[at][1] < j:
            at += 1
        if at == len(spans) or spans[at][0] > i:
            out.append((i, j))
    return out


def find(text: str | None) -> tuple[dict[str, list[tuple[int, int]]], dict[str, list[tuple[int, int]]]]:
    """Plain spans by kind, and those with what only the normalised text shows."""
    if not text:
        return {k: [] for k in KINDS}, {k: [] for k in KINDS}
    base = plain(text)
    if not disguised(text):
        return base, base
    new, a, b = normalise(text)
    every = {}
    for kind, spans in base.items():
        more = {(a[i], b[j - 1]) for i, j in SEARCH[kind](new)} - set(spans)
        every[kind] = sorted(spans + uncovered(sorted(more), spans))
    return base, every


def joined(spans: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{i}:{j}" for k in KINDS for i, j in spans[k])


SCHEMA = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1)
        counts, sums, spans = [], [], []
        for i in range(len(texts)):
            base, every = find(texts[i].as_py())
            counts.append([len(base[k]) for k in KINDS])
            sums.append(hashlib.sha256(joined(base).encode()).hexdigest())
            spans.append(joined(every))
        cols = [pa.array([c[k] for c in counts], pa.int64()) for k in range(len(KINDS))]
        yield pa.RecordBatch.from_arrays([batch.column(0), *cols, pa.array(sums, pa.string()), pa.array(spans, pa.string())], ["doc_id", *[x.split()[0] for x in SCHEMA.split(", ")]])


def scan(docs: DataFrame) -> DataFrame:
    """One row for each row of docs, in one pass without a shuffle."""
    return docs.select("doc_id", "text").mapInArrow(scan_batches, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {SCHEMA}")
