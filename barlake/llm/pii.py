"""Personal data with offset-preserving deobfuscation.

Base spans come from the plain text.  A chain of transducers then rewrites the
text and keeps, for every rewritten piece, the source characters it came from:
zero-width characters vanish, look-alikes become ASCII, spelled digits become
digits, and disguised "at", "dot", "plus" and "dash" become their signs.  The
same detectors run on the result; a span found there maps back to the source
characters of its first and last piece and is added if it overlaps no span of
its kind in the plain text.

Detection takes the leftmost non-overlapping candidates of each kind and drops
those that fail the kind's check, without retrying shorter ones.  Every scan is
linear in the text: runs are entered at their start and never re-entered.

Null or empty text has no spans.  Offsets count code points, end exclusive.
Each row is judged by its own text: equal rows alike, rows without id too.
Further columns are not read.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_CHAIN = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
_LUHN = [2 * d - 9 * (2 * d > 9) for d in range(10)]


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            done = m.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    """Each four parts in turn of a chain of numbers and points, if none is above 255."""
    for m in _CHAIN.finditer(text):
        if m[0].count(".") < 3:
            continue
        at, parts = m.start(), m[0].split(".")
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in four)):
                yield at, end
            at = end + 1


def luhn(digits: str) -> bool:
    """Whether the digits pass the check-sum of payment cards."""
    even = sum(map(int, digits[-1::-2]))
    return (even + sum(_LUHN[int(d)] for d in digits[-2::-2])) % 10 == 0


def detect(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all identifiers, ordered by start and then kind as listed."""
    found = []
    if "@" in text:
        found += [(a, b, 0) for a, b in _emails(text)]
    if _DIGITS.search(text):
        found += [(a, b, 1) for a, b in _addresses(text)]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    found.append((m.start(), m.end(), 2))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_DIGITS.findall(m[0])) <= 15:
                    found.append((m.start(), m.end(), 3))
    return [(a, b, KINDS[k]) for a, b, k in sorted(found, key=lambda x: (x[0], x[2]))]


# --- transducers -------------------------------------------------------------

# Letters of other scripts that look like ASCII ones.
LOOK_ALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԝ": "w",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y", "З": "3",
    "α": "a", "ο": "o", "ν": "v", "ρ": "p", "ι": "i", "κ": "k", "υ": "u", "χ": "x", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ո": "n", "օ": "o", "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", "․": ".", "。": ".", "·": ".", "\u00a0": " ", "\u202f": " ", "\u2009": " ",
}
# Characters without width.
ZERO_WIDTH = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
# Spelled digits.
SPELLED = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
# Words that stand for signs.
SIGNS = {"at": "@", "arroba": "@", "dot": ".", "punkt": ".", "point": ".", "punto": ".", "period": ".", "plus": "+", "dash": "-", "hyphen": "-", "minus": "-"}


@lru_cache(1)
def _odd_characters() -> dict[str, str]:
    """Look-alikes, compatibility forms with one ASCII character, and zero-width ones (to nothing)."""
    table = dict(LOOK_ALIKES)
    for c in map(chr, (*range(0x80, 0xD800), *range(0xE000, 0x20000))):
        if c not in table:
            plain = unicodedata.normalize("NFKC", c)
            if len(plain) == 1 and "!" <= plain <= "~":
                table[c] = plain
    return table | dict.fromkeys(ZERO_WIDTH, "")


_WORDS = "|".join(sorted(SPELLED, key=len, reverse=True))
_SIGN_WORDS = "|".join(sorted(SIGNS, key=len, reverse=True))
_JOINING = "|".join(sorted(SIGNS.keys() - {"plus"}, key=len, reverse=True))
# a spelled digit next to another one, to a digit or to a sign; single words of prose stay
_SPELLED_RUN = re.compile(rf"(?<![^\W_])(?:{_WORDS})(?![^\W_])", re.I)
_GAP = rf"(?:[ .,-]{{1,2}}|\s?[\[(]?\s?(?:dot|punkt|point|punto|dash|hyphen)\s?[\])]?\s?)"
_BETWEEN = re.compile(_GAP, re.I)
_DIGIT_BEFORE, _DIGIT_AFTER = re.compile(rf"[0-9]{_GAP}$", re.I), re.compile(rf"{_GAP}[0-9]", re.I)
_SIGN = re.compile(
    rf"(?<![^\W_])(?P<plus>plus)\s{{1,3}}(?=[0-9])|\s{{0,3}}[\[({{<]\s{{0,2}}(?P<bracketed>{_SIGN_WORDS}|@|\.)\s{{0,2}}[\])}}>]\s{{0,3}}|[\x20_]{{1,3}}(?P<spaced>{_JOINING}|@|\.)[\x20_]{{1,3}}(?=[A-Za-z0-9])", re.I
)


class Rewritten:
    """A text and, for each of its pieces, the source characters it came from."""

    def __init__(self, text: str):
        self.text = text
        self.starts: list[int] = [0]
        self.source: list[tuple[int, int, bool]] = [(0, len(text), True)]  # copied pieces map by offset

    def apply(self, edits: list[tuple[int, int, str]]) -> None:
        """Replaces disjoint ascending ranges; a replaced range stands for all its source characters."""
        if not edits:
            return
        out, starts, source, at, done = [], [], [], 0, 0

        def copy(a: int, b: int) -> None:
            nonlocal at
            i = bisect_right(self.starts, a) - 1
            while a < b:
                end = self.starts[i + 1] if i + 1 < len(self.starts) else len(self.text)
                stop = min(b, end)
                s, e, plain = self.source[i]
                starts.append(at)
                source.append((s + a - self.starts[i], s + stop - self.starts[i], True) if plain else (s, e, False))
                out.append(self.text[a:stop])
                at += stop - a
                a, i = stop, i + 1

        for a, b, new in edits:
            if a < done:
                continue
            copy(done, a)
            if new:
                starts.append(at)
                source.append((self.first(a), self.last(b - 1), False))
                out.append(new)
                at += len(new)
            done = b
        copy(done, len(self.text))
        self.text, self.starts, self.source = "".join(out), starts or [0], source or [(0, 0, True)]

    def first(self, i: int) -> int:
        """First source character of character ``i``."""
        k = bisect_right(self.starts, i) - 1
        s, _, plain = self.source[k]
        return s + i - self.starts[k] if plain else s

    def last(self, i: int) -> int:
        """End of the source characters of character ``i``."""
        k = bisect_right(self.starts, i) - 1
        s, e, plain = self.source[k]
        return s + i - self.starts[k] + 1 if plain else e


def normalise(text: str) -> Rewritten:
    """The text after all transducers."""
    r = Rewritten(text)
    if not text.isascii():
        odd = _odd_characters()
        r.apply([(i, i + 1, odd[c]) for i, c in enumerate(text) if c in odd])
    r.apply(_spelled_edits(r.text))
    edits = []
    for m in _SIGN.finditer(r.text):
        word = m["bracketed"] or m["spaced"] or m["plus"]
        edits.append((m.start(), m.end(), SIGNS.get(word.lower(), word)))
    r.apply(edits)
    return r


def _spelled_edits(text: str) -> list[tuple[int, int, str]]:
    """Spelled digits that stand in a row with two or more further digits."""
    words = [(m.start(), m.end()) for m in _SPELLED_RUN.finditer(text)]
    edits = []
    for i, (a, b) in enumerate(words):
        beside_before = (i > 0 and _BETWEEN.fullmatch(text, words[i - 1][1], a)) or _DIGIT_BEFORE.search(text, max(0, a - 14), a)
        beside_after = (i + 1 < len(words) and _BETWEEN.fullmatch(text, b, words[i + 1][0])) or _DIGIT_AFTER.match(text, b)
        if beside_before or beside_after:
            # a dotted capital I matches too and lowers to i and a combining dot
            edits.append((a, b, SPELLED[text[a:b].lower().replace("i\u0307", "i")]))
    # numbers read out one digit at a time are written without the spaces between them
    joined: list[tuple[int, int, str]] = []
    for a, b, d in edits:
        if joined and a - joined[-1][1] == 1 and text[joined[-1][1]] == " ":
            joined[-1] = (joined[-1][0], b, joined[-1][2] + d)
        else:
            joined.append((a, b, d))
    return joined


def spans(text: str | None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, and the spans added by deobfuscation."""
    if not text:
        return [], []
    base = detect(text)
    r = normalise(text)
    if r.text == text:
        return base, []
    taken = {k: [(a, b) for a, b, kind in base if kind == k] for k in KINDS}
    added = []
    for a, b, kind in detect(r.text):
        s, e = r.first(a), r.last(b - 1)
        i = bisect_right(taken[kind], (s, len(text) + 1))
        near = taken[kind][max(0, i - 1) : i + 1]
        # a span that only grows over a plain one is added, one inside or across it is not
        if all(y <= s or e <= x or (s <= x and y <= e and (s, e) != (x, y)) for x, y in near):
            added.append((s, e, kind))
    return base, added


SPAN = "array<struct<kind:string,start:int,end:int>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        for at in range(0, batch.num_rows, 512):
            both = [spans(t) for t in batch.column(1).slice(at, 512).to_pylist()]
            columns = [[[{"kind": k, "start": a, "end": b} for a, b, k in x[i]] for x in both] for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([ids.slice(at, len(both)), *(pa.array(c, _SPANS) for c in columns)], ["doc_id", "base", "added"])


def identifiers(docs: DataFrame) -> DataFrame:
    """(doc_id, base, added): spans of the plain text and further ones, for every row of ``docs`` (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_scan, f"doc_id long, base {SPAN}, added {SPAN}")
