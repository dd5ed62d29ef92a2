"""Personal data, also in disguise: offset-preserving deobfuscation.

Transducers rewrite a text one after the other: homoglyphs and full-width forms to ASCII, digits
spelled in four languages to digits, "at", "dot" and "plus" disguises to @, full stops and +. Each keeps, for every character it
puts out, the span of source characters that it came from, so a span found in the rewritten text
maps back to the source exactly. Detectors run on the source (the base findings) and on the
rewritten text; a finding of the latter counts when a transducer changed something inside it and
it does not meet a base finding of its kind.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def emails(text: str) -> list[Span]:
    """Leftmost, non-overlapping; linear, as only the run before each @ is looked at."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            end = m.end()
        floor = max(at + 1, end)
        if not m:
            end = max(end, at + 1 if start < at else end)  # no later match starts before this @
        at = text.find("@", floor)
    return out


def _part(digits: str) -> bool:
    digits = digits.lstrip("0")
    return len(digits) <= 3 and int(digits or 0) <= 255


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(2 * int(d) - 9 * (d > "4") for d in digits[-2::-2])
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def detect(text: str) -> list[tuple[str, int, int]]:
    """Base findings (kind, start, end), in order of start, then kind."""
    out = [("email", *s) for s in emails(text)] if "@" in text else []
    if _HAS_DIGIT.search(text):
        out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(map(_part, m[0].split(".")))]
        for m in _CARD.finditer(text):
            d = _digits(m[0]) if m.end() - m.start() <= 40 else ""
            if 12 <= len(d) <= 19 and luhn(d):
                out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


_HAS_DIGIT = re.compile("[0-9]")

# Letters of other scripts that look like Latin ones, and names of digits.
_LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S",
    "α": "a", "ο": "o", "ν": "v", "ι": "i", "ρ": "p", "κ": "k", "Α": "A", "Β": "B", "Ε": "E", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Χ": "X",
    "ı": "i", "․": ".", "。": ".", "‐": "-", "‑": "-", "–": "-", "⁺": "+",
}
# The digits' names in English, German, Spanish and French, and how @, full stops and + are spelled out.
_DIGIT_NAMES = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
}
_AT_NAMES = ("at", "arroba", "arobase", "klammeraffe")
_DOT_NAMES = ("dot", "punkt", "punto", "point")
_PLUS_NAMES = ("plus", "más")
#: Words that stand before a plain "at" and an address of a site in ordinary sentences.
_BEFORE_AT = ("a", "about", "all", "and", "are", "available", "be", "buy", "check", "found", "here", "is", "it", "look", "looked", "looking", "me", "meet", "met", "more", "now", "online", "only", "or", "order", "out", "page", "read", "see", "shop", "site", "that", "the", "them", "there", "this", "us", "visit", "was", "website", "were", "work", "working", "works", "you")
#: Ends of domains that a plain "at" is believed before.
_TOP = ("at", "biz", "ca", "ch", "co", "com", "de", "edu", "es", "eu", "fr", "gov", "info", "io", "it", "me", "net", "nl", "org", "uk", "us")


def _homoglyph(c: str) -> str | None:
    """What a character is a disguise of, or None. Compatibility forms (full width, mathematical
    letters, circled digits) by Unicode's own rule, if they are one ASCII character."""
    if c in _LOOKALIKES:
        return _LOOKALIKES[c]
    if c in "​‌‍⁠﻿­":
        return ""
    plain = unicodedata.normalize("NFKC", c)
    return plain if plain != c and len(plain) == 1 and plain.isascii() and not plain.isspace() else None


class Traced:
    """A rewritten text; for each of its characters the source span and whether it was changed."""

    def __init__(self, text: str):
        self.text, self.start, self.end, self.changed = text, list(range(len(text))), list(range(1, len(text) + 1)), [False] * len(text)

    def replace(self, edits: list[tuple[int, int, str]]) -> None:
        """edits: (start, end, new text), in order and apart; new text stands for the whole span."""
        if not edits:
            return
        text, start, end, changed, at = [], [], [], [], 0
        for lo, hi, new in [*edits, (len(self.text), len(self.text), "")]:
            text.append(self.text[at:lo])
            start += self.start[at:lo]
            end += self.end[at:lo]
            changed += self.changed[at:lo]
            if lo < hi:
                text.append(new)
                start += [self.start[lo]] * len(new)
                end += [self.end[hi - 1]] * len(new)
                changed += [True] * len(new)
            at = hi
        self.text, self.start, self.end, self.changed = "".join(text), start, end, changed


# All patterns take time in proportion to the text: no run of characters is tried from each of its places.
_B, _E = r"(?<![^\W_])", r"(?![^\W_])"
_NAME = "|".join(sorted(_DIGIT_NAMES, key=len, reverse=True))
_ITEM = rf"(?:(?:{_NAME}){_E}|[0-9]++{_E})"
_SPELLED = re.compile(rf"{_B}{_ITEM}(?:[\s,.-]{{1,3}}{_ITEM})*+", re.I)
_SPELLED_ITEM = re.compile(_ITEM, re.I)
_PLUS = re.compile(rf"{_B}(?:{'|'.join(_PLUS_NAMES)})(?:\s++|-)(?=[0-9])", re.I)
_OPEN, _CLOSE = r"[(\[{<]\s*+", r"\s*+[)\]}>]"
_AT = rf"(?:(?<!\s)\s*+{_OPEN}(?:{'|'.join(_AT_NAMES)}|@){_CLOSE}\s*+|(?<!\s)\s++(?:{'|'.join(_AT_NAMES)})\s++|(?<!\s)\s++@\s*+|@\s*+)"
_DOT = rf"(?:(?<!\s)\s*+{_OPEN}(?:{'|'.join(_DOT_NAMES)}|\.){_CLOSE}\s*+|(?<!\s)\s++(?:{'|'.join(_DOT_NAMES)})\s++|\.)"
_W = r"[A-Za-z0-9_%+-]++"
_AT_SIGN = re.compile(_AT, re.I)
_LOCAL_PART = re.compile(rf"{_W}(?:{_DOT}{_W}){{0,4}}+\Z", re.I)
_HOST = re.compile(rf"[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++){{1,5}}+", re.I)
_DOT_SIGN = re.compile(_DOT, re.I)
_LOCAL_MOST = 320
_DOTTED_IP = re.compile(rf"(?<![0-9])[0-9]{{1,3}}(?:{_DOT}[0-9]{{1,3}}){{3}}(?![0-9])", re.I)
_BRACKETED = re.compile(rf"{_OPEN}(?:{'|'.join((*_AT_NAMES, *_DOT_NAMES))}|@|\.){_CLOSE}", re.I)
_LOOSE_AT = re.compile(r"\s@|@\s")
_NAME_SET, _AT_SET, _DOT_SET, _PLUS_SET = map(frozenset, (_DIGIT_NAMES, _AT_NAMES, _DOT_NAMES, _PLUS_NAMES))
_ODD = re.compile(r"[­ıͰ-ϿЀ-ԯ‐-–․​-‍⁠⁰-₎①-⓿。﻿﹒！-～\U0001d400-\U0001d7ff]")


def _signs(text: str) -> tuple[bool, bool, bool, bool]:
    """What a text may need: digits, plus, addresses, dotted numbers. Only rules out texts in which
    nothing of the kind can be rewritten to a finding; the transducers decide on each match."""
    low = text.lower()
    words = low.split()
    bare = low.replace(",", " ").replace("-", " ").replace(".", " ").split()
    digits = not _NAME_SET.isdisjoint(bare) and any((a in _NAME_SET and (b in _NAME_SET or b in _DOT_SET or b[0].isdigit())) or (b in _NAME_SET and a[-1].isdigit()) for a, b in zip(bare, bare[1:], strict=False))
    plus = not _PLUS_SET.isdisjoint(bare)
    dots = not _DOT_SET.isdisjoint(bare)
    bracketed = _BRACKETED.search(text) is not None
    address = bracketed or "@" in text and (dots or _LOOSE_AT.search(text) is not None)
    if not address and not _AT_SET.isdisjoint(words):
        address = any(a in _AT_SET and ("." in b[:-1] or c in _DOT_SET) for a, b, c in zip(words, words[1:], [*words[2:], ""], strict=False))
    return digits, plus, address, bracketed or dots


def _digits_spelled(t: Traced) -> None:
    """Runs of digits and their names, at least one of them a name, become runs of digits."""
    edits = []
    for m in _SPELLED.finditer(t.text):
        items = list(_SPELLED_ITEM.finditer(t.text, m.start(), m.end()))
        if all("0" <= x[0][0] <= "9" for x in items):
            continue
        for k, x in enumerate(items):
            hi = items[k + 1].start() if k + 1 < len(items) else x.end()
            edits.append((x.start(), hi, _DIGIT_NAMES.get(x[0].lower(), x[0])))
    t.replace(edits)


def _addresses(text: str) -> list[tuple[int, int, str]]:
    """Edits that make @ and full stops of the disguises in what looks like an address otherwise."""
    edits = []
    for at in _AT_SIGN.finditer(text):
        host = _HOST.match(text, at.end())
        if not host:
            continue
        before = text[max(0, at.start() - _LOCAL_MOST) : at.start()]
        local = None
        for m in re.finditer(rf"(?<![A-Za-z0-9_%+.-]){_W}", before):  # the first word from which all up to the sign is one
            if local := _LOCAL_PART.match(before, m.start()):
                break
        if not local:
            continue
        lo = at.start() - len(before) + local.start()
        dots = [(x.start(), x.end()) for a, b in ((lo, at.start()), (at.end(), host.end())) for x in _DOT_SIGN.finditer(text, a, b)]
        if at[0].strip().lower() in _AT_NAMES and (local[0].lower() in _BEFORE_AT or text[dots[-1][1] : host.end()].lower() not in _TOP):
            continue
        edits += [(a, b, new) for a, b, new in ((at.start(), at.end(), "@"), *[(a, b, ".") for a, b in dots]) if text[a:b] != new]
    return edits


def deobfuscate(text: str) -> Traced | None:
    """The text through all transducers, or None where none of them has anything to do."""
    odd = _ODD.search(text)
    if not odd and not any(_signs(text)):
        return None
    t = Traced(text)
    if odd:
        t.replace([(m.start(), m.end(), new) for m in _ODD.finditer(t.text) if (new := _homoglyph(m[0])) is not None])
    digits, plus, address, dotted = _signs(t.text)
    if digits:
        _digits_spelled(t)
    if plus:
        t.replace([(m.start(), m.end(), "+") for m in _PLUS.finditer(t.text)])
    edits = _addresses(t.text) if address else []
    if dotted:
        edits += [(x.start(), x.end(), ".") for m in _DOTTED_IP.finditer(t.text) for x in _DOT_SIGN.finditer(t.text, m.start(), m.end()) if x[0] != "."]
    kept: list = []
    for e in sorted(set(edits)):
        if not kept or e[0] >= kept[-1][1]:
            kept.append(e)
    t.replace(kept)
    return t if any(t.changed) or len(t.text) != len(text) else None


def findings(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base findings, all findings) as (kind, start, end) in code points of the source."""
    base = detect(text)
    t = deobfuscate(text)
    if t is None:
        return base, base
    taken: dict[str, list[Span]] = {}
    for kind, a, b in base:
        taken.setdefault(kind, []).append((a, b))
    more = []
    for kind, a, b in detect(t.text):
        lo, hi = t.start[a], t.end[b - 1]
        if (any(t.changed[a:b]) or hi - lo != b - a) and all(hi <= x or y <= lo for x, y in taken.get(kind, [])):
            more.append((kind, lo, hi))
    return base, sorted({*base, *more}, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


_SPANS = "doc_id long, base string, spans array<struct<kind:string,start:int,end:int,value:string>>"
_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())]))


def personal_data(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, base (the plain findings as kind:start:end, comma-joined) and
    spans (all findings: kind, start, end, value as written in the source).

    Offsets are code points, ends exclusive. Null texts count as empty and have no findings; texts
    of any length are read whole; repeated rows are reported alike. Empty table: no rows.
    """

    def run(batches):
        for batch in batches:
            base, spans = [], []
            for text in batch.column(1).to_pylist():
                own, every = findings(text)
                base.append(_joined(own))
                spans.append([{"kind": k, "start": a, "end": b, "value": text[a:b]} for k, a, b in every])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, pa.string()), pa.array(spans, _SPAN)], names=["doc_id", "base", "spans"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, _SPANS)


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each finding replaced by its kind in angle brackets; of overlapping ones the
    first counts."""
    out, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
            at = b
    return "".join(out) + text[at:]


def digest(found: DataFrame) -> DataFrame:
    """Counts by kind, the digest of the plain findings and all spans as text."""

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")

    text = F.concat_ws(",", F.transform("spans", lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))))
    return found.select("doc_id", *map(count, KINDS), F.sha2("base", 256).alias("base_sha256"), text.alias("spans"))


