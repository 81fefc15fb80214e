"""Personal data in plain sight and in disguise, as spans of the text as it is.

Patterns find identifiers in the text itself.  Then a chain of transducers
rewrites a copy: look-alike characters become ASCII, invisible ones go, ways to
write "at" and "dot" become signs, spelled digits become digits, and letters
that stand for digits too.  Each keeps the segments that it replaced, so that a
span found behind the chain maps back, step by step, to the characters of the
source that it came from.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from . import words as W

KINDS = ("email", "ip", "card", "phone")

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    """The check sum of payment cards."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost addresses in time linear in the text: a local part is the run before an @, from the last address on."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        else:
            done = at + 1
        at = text.find("@", done)


def ips(text: str) -> Iterator[tuple[int, int]]:
    for m in IP.finditer(text):
        parts = [x.lstrip("0") for x in m.group().split(".")]
        if all(len(x) < 4 and int(x or "0") < 256 for x in parts):
            yield m.span()


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in PHONE.finditer(text):
        if 9 <= sum(c.isdecimal() for c in m.group()) <= 15:
            yield m.span()


FINDERS: dict[str, Callable[[str], Iterator[tuple[int, int]]]] = {"email": emails, "ip": ips, "card": cards, "phone": phones}
#: What a text must hold for a kind to be there.
SIGNS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
DIGIT = re.compile("[0-9]")


def detect(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of everything that the patterns find, by kind and start."""
    digits = DIGIT.search(text) is not None
    return [(kind, *span) for kind in KINDS if SIGNS[kind] in text and (digits or kind == "email") for span in FINDERS[kind](text)]


# Characters that look like the ASCII ones below them.
LOOK_ALIKE = [
    ("АВЕЅІЈКМНОРСТХУԌԚԜ", "ABESIJKMHOPCTXYGQW"),  # Cyrillic
    ("авеѕіјкмнорстхуԁԛԝһӏց", "abesijkmhopctxydqwhlg"),
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ABEZHIKMNOPTYX"),  # Greek
    ("αικνορτυχ", "aikvoptux"),
    ("ıɑɡɩʋſ", "iagivs"),  # Latin
    ("‐‑‒–—―−﹣", "--------"),
    ("․。｡。﹒•·", "......."),
    ("﹫", "@"),
    ("﹢", "+"),
]
#: Characters that are not seen.
INVISIBLE = re.compile("[­͏؜᠎​-‏‪-‮⁠-⁤︀-️﻿]+")


def folding() -> dict[int, str]:
    """One character for one: compatibility forms and digits of all scripts by the rules of Unicode, look-alikes by the list."""
    table = {}
    for lo, hi in ((0xA0, 0xA1), (0x2000, 0x2050), (0x2070, 0x20A0), (0x2100, 0x2190), (0x2460, 0x2500), (0x3000, 0x3001), (0xFE50, 0xFE70), (0xFF00, 0xFF5F), (0x1D400, 0x1D800)):
        for code in range(lo, hi):
            plain = unicodedata.normalize("NFKC", chr(code))
            if len(plain) == 1 and " " <= plain <= "~":
                table[code] = plain
    for code in range(0x80, 0x1FBFA):
        value = unicodedata.decimal(chr(code), None)
        if value is not None:
            table[code] = str(value)
    for alike, plain in LOOK_ALIKE:
        table |= dict(zip(map(ord, alike), plain))
    return table


FOLD = folding()

# Digits, signs and dots as words of four languages.
DIGIT_WORDS = {
    "0": "zero oh null zéro cero nought",
    "1": "one eins un une uno",
    "2": "two zwei zwo deux dos",
    "3": "three drei trois tres",
    "4": "four vier quatre cuatro",
    "5": "five fünf cinq cinco",
    "6": "six sechs seis",
    "7": "seven sieben sept siete",
    "8": "eight acht huit ocho",
    "9": "nine neun neuf nueve",
}
TIMES = {"double": 2, "triple": 3}
AT_WORDS, DOT_WORDS, PLUS_WORDS, DASH_WORDS = "at|arobase|arroba|ät", "dot|point|punkt|punto", "plus|más|mas", "dash|hyphen|tiret|strich|guion"
AT_CODES, DOT_CODES = r"&#64;|&#x40;|&commat;|%40", r"&#46;|&#x2e;|&period;|%2e"
#: Ends of domains that make an address of plain words.
ENDINGS = frozenset("com org net edu gov mil info biz io co uk de fr es eu ch nl dev app example test invalid local".split())

VALUE = {word: digit for digit, some in DIGIT_WORDS.items() for word in some.split()}
ONE = "|".join(sorted(VALUE, key=len, reverse=True))
SPELLED = rf"(?:(?:{'|'.join(TIMES)})[\x20-]{{1,2}})?(?:{ONE})"
BETWEEN = rf"(?:[\x20,()-]{{1,3}}|\x20?\.\x20?|\x20(?:{DASH_WORDS})\x20)"
NUMBER = re.compile(rf"(?<![^\W_])(?:(?:{PLUS_WORDS})\x20{{1,2}}|\+\x20{{0,2}})?\(?(?:{SPELLED}|[0-9]++)(?:{BETWEEN}(?:{SPELLED}|[0-9]++))+(?![^\W_])", re.I)
PIECE = re.compile(rf"(?<![^\W_])({SPELLED})(?![^\W_])|(\b(?:{PLUS_WORDS})\x20*|\+\x20+)|(?<=[^\W_])(\x20?\.\x20?)(?=[^\W_])|(\x20(?:{DASH_WORDS})\x20|[\x20,()-]+)", re.I)
DOT = re.compile(rf"\x20{{0,2}}[\[({{<]\x20?(?:{DOT_WORDS}|\.)\x20?[\])}}>]\x20{{0,2}}|{DOT_CODES}|(?<=[A-Za-z0-9])[\x20_]{{1,2}}(?:{DOT_WORDS})[\x20_]{{1,2}}(?=[A-Za-z0-9])|(?<=[0-9])\x20{{1,2}}\.\x20{{1,2}}(?=[0-9])|(?<=[a-z0-9])\x20\.\x20(?=(?:{'|'.join(sorted(ENDINGS))})\b)", re.I)
AT = re.compile(rf"\x20{{0,2}}[\[({{<]\x20?(?:{AT_WORDS}|a|@)\x20?[\])}}>]\x20{{0,2}}|{AT_CODES}|(?<=[A-Za-z0-9])[\x20_-]{{1,2}}(?:{AT_WORDS})[\x20_-]{{1,2}}(?={DOMAIN.pattern})|(?<=[A-Za-z0-9])\x20{{0,2}}@\x20{{0,2}}(?={DOMAIN.pattern})", re.I)
BARE_AT = re.compile(rf"[\x20_-](?:{AT_WORDS})[\x20_-]", re.I)
BARE_DOT = re.compile(rf"[\x20_](?:{DOT_WORDS})[\x20_]|[\[({{<]", re.I)
MIXED = re.compile(r"(?<=[0-9OoIl]\.)[OoIl](?=\.[0-9OoIl])|(?<![^\W_])[0-9OoIl|]++(?![^\W_])")
FIGURES = str.maketrans("OoIl|", "00111")
#: Bytes, lower case, one of which a text needs for a transducer to change it.
NEEDS_DOT = [x.encode() for x in (*DOT_WORDS.split("|"), "[.]", "(.)", "{.}", "<.>", " . ", *DOT_CODES.split("|"))]
NEEDS_AT = [x.encode() for x in ("at", "arobase", "arroba", "ät", "@", "(a)", "[a]", *AT_CODES.split("|"))]
NEEDS_WORDS = [x.encode() for x in ("plus", *(w for w in VALUE if w not in ("un", "une", "oh")))]


class Rewritten:
    """A text and the segments of the source that its parts stand for, through any number of rewritings."""

    def __init__(self, text: str):
        self.text = text
        self.steps: list[tuple[list[int], list[int], list[int], list[int]]] = []

    def replace(self, edits: list[tuple[int, int, str]]) -> None:
        """Put strings in the places of disjoint, rising segments."""
        edits = [e for e in edits if self.text[e[0] : e[1]] != e[2]]
        if not edits:
            return
        parts, done, shift = [], 0, 0
        starts, ends, sources, source_ends = [], [], [], []
        for lo, hi, new in edits:
            parts += [self.text[done:lo], new]
            starts.append(lo + shift)
            ends.append(lo + shift + len(new))
            sources.append(lo)
            source_ends.append(hi)
            shift += len(new) - (hi - lo)
            done = hi
        self.text = "".join([*parts, self.text[done:]])
        self.steps.append((starts, ends, sources, source_ends))

    def source(self, start: int, end: int) -> tuple[int, int]:
        """The span of the source under ``text[start:end]``; part of a replaced segment takes all of it."""
        for starts, ends, sources, source_ends in reversed(self.steps):
            first = bisect.bisect_right(ends, start)  # the first segment that ends behind the start
            if first < len(starts) and starts[first] <= start:
                lo = sources[first]
            else:
                lo = start + (source_ends[first - 1] - ends[first - 1] if first else 0)
            last = bisect.bisect_left(starts, end) - 1  # the last segment that begins before the end
            if last >= 0 and ends[last] >= end:
                hi = source_ends[last]
            else:
                hi = end + (source_ends[last] - ends[last] if last >= 0 else 0)
            start, end = lo, hi
        return start, end


def spelled(text: str) -> Iterator[tuple[int, int, str]]:
    """Edits that turn runs with spelled digits into figures: those close up, dots stay, and so does what parts them from figures.

    A single word beside figures is as likely an article or a count and stays.
    """
    for run in NUMBER.finditer(text):
        pieces = list(PIECE.finditer(text, *run.span()))
        if sum(p.group(1) is not None for p in pieces) < 2:
            continue
        for p in pieces:
            if p.group(1):
                *times, word = re.split(r"[\x20-]+", p.group(1).lower())
                yield *p.span(), VALUE[word] * (TIMES[times[0]] if times else 1)
            elif p.group(2):
                yield *p.span(), "+"
            elif p.group(3):
                yield *p.span(), "."
            elif p.end() < run.end():
                literal = text[p.start() - 1].isdecimal() or text[p.end()].isdecimal()
                yield *p.span(), p.group() if literal else ""


def rewritten(text: str, lowered: bytes) -> Rewritten:
    """The text behind all transducers; ``lowered``: its bytes with A-Z lowered."""
    has = lambda needs: any(x in lowered for x in needs)
    folded = text if text.isascii() else text.translate(FOLD)
    out = Rewritten(folded)
    if not text.isascii():
        out.replace([(*m.span(), "") for m in INVISIBLE.finditer(folded)])
    if folded != text or out.steps:
        lowered = out.text.lower().encode()
    if has(NEEDS_DOT):
        out.replace([(*m.span(), ".") for m in DOT.finditer(out.text)])
    if has(NEEDS_AT):
        out.replace([(*m.span(), "@") for m in AT.finditer(out.text)])
    if has(NEEDS_WORDS):
        out.replace(list(spelled(out.text)))
    if DIGIT.search(out.text):
        out.replace([(*m.span(), m.group().translate(FIGURES)) for m in MIXED.finditer(out.text) if len(m.group()) == 1 < m.start() and out.text[m.start() - 1] == "." or DIGIT.search(m.group())])
    return out


def plausible(kind: str, source: str, plain: str) -> bool:
    """Whether a disguise is one: addresses need an ending of letters, and those of bare words a known one."""
    if kind != "email":
        return True
    local, domain = plain.split("@", 1)
    ending = domain.rsplit(".", 1)[1]
    if len(ending) < 2 or not ending.isalpha():
        return False
    bare = BARE_AT.search(source)
    if not bare or "@" in source:
        return True
    account = any(c.isalpha() for c in local) and not local.isalpha()
    return ending.lower() in ENDINGS and (account or BARE_DOT.search(source, bare.end() - 1) is not None)


def spans_of(text: str, lowered: bytes | None = None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(spans of the patterns, all spans) of a text, each (kind, start, end) by kind and start."""
    base = detect(text)
    out = rewritten(text, text.lower().encode() if lowered is None else lowered)
    if out.text == text:
        return base, base
    more = set(base)
    held: dict[str, list[tuple[int, int]]] = {k: [s[1:] for s in base if s[0] == k] for k in KINDS}
    for kind, start, end in detect(out.text):
        lo, hi = out.source(start, end)
        source, plain = text[lo:hi], out.text[start:end]
        if source == plain or not plausible(kind, source, plain):
            continue
        at = bisect.bisect_right(held[kind], (lo, len(text) + 1)) - 1
        if at >= 0 and held[kind][at][1] >= hi:
            continue  # the patterns had it
        more.add((kind, lo, hi))
    return base, sorted(more, key=lambda s: (KINDS.index(s[0]), *s[1:]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join([f"{kind}:{start}:{end}" for kind, start, end in spans])


def find_personal(documents: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: the ``keep`` columns, doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    The numbers and the digest are of what the patterns find in the text as it
    is; ``spans`` lists those and the disguised ones as kind:start:end, by kind
    and start, in code points, the end outside.  A disguised span inside one of
    its kind in plain sight is left out; one that reaches beyond stays beside it.

    A null text is empty and has no spans.  Repeated rows, null doc_id and other
    columns pass as they are; a text of any length is read whole, in time linear
    in it.  An empty table gives an empty result.
    """
    keep = tuple(c for c in keep if c not in ("doc_id", "text"))
    kept = documents.select(*keep, "doc_id", "text")

    def find(batches):
        for batch in batches:
            for part in W.slices(batch):
                rows = []
                for raw in part.column("text").cast(pa.binary()).to_pylist():
                    raw = raw or b""
                    base, every = spans_of(raw.decode(), raw.lower())
                    kinds = [s[0] for s in base]
                    rows.append([*(kinds.count(k) for k in KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)])
                columns = [pa.array([r[i] for r in rows], pa.int64() if i < len(KINDS) else pa.string()) for i in range(len(KINDS) + 2)]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in (*keep, "doc_id")] + columns, [*keep, "doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields if f.name != "text")
    return kept.mapInArrow(find, fields + "".join(f", n_{k} long" for k in KINDS) + ", base_sha256 string, spans string")
