"""Personal data in plain and disguised spelling, at its place in the source text (operator 4).

Base detectors run on the text itself.  Two transducers then rewrite it: the first exchanges characters (homoglyphs, digits of
other scripts, full-width forms; invisible ones go), the second spelled digits, letters inside numbers and disguised
at-signs and dots.  Both keep for each character they write the source characters it stands for, so what the same
detectors find in the rewritten text maps back to offsets of the source.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rankeval.llm.arrow_rows import rewrite

KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# a number's first digit follows no digit, unless a match has just ended there, which always ends a run of digits
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

Span = tuple[int, int, int]  # start, place in KINDS, end


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(2 * int(d) - 9 * (d > "4") for d in digits[-2::-2])
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    done = 0
    at = text.find("@")
    while at >= 0:
        start, upto = at, at + 1
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, 0, m.end()
            done = upto = m.end()
        at = text.find("@", upto)


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def find(text: str) -> list[Span]:
    """Spans of the plain kinds, each kind leftmost and not overlapping, by start and then kind."""
    found = list(_emails(text)) if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p := g.lstrip("0")) <= 3 and int(p or "0") <= 255 for g in m.groups()):
                found.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if 12 <= m.end() - m.start() and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                found.append((m.start(), 2, m.end()))
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


# --- fixed values: letters that look like another, and words for digits, signs and points ---
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ѕ": "S", "Ј": "J",
    "α": "a", "ο": "o", "ρ": "p", "ν": "v", "ι": "i", "κ": "k", "υ": "u", "χ": "x", "τ": "t", "ϲ": "c", "ϳ": "j",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ı": "i", "ɡ": "g", "ɑ": "a", "ℓ": "l", "。": ".", "․": ".", "‧": ".", "∙": ".", "•": ".", "·": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-",
}
NUMBER_WORDS = (
    "zero one two three four five six seven eight nine", "zéro un deux trois quatre cinq sept huit neuf", "null eins zwei drei vier fünf sechs sieben acht neun",
    "cero uno dos tres cuatro cinco seis siete ocho nueve",
)
NUMBER_VALUES = ("0 1 2 3 4 5 6 7 8 9", "0 1 2 3 4 5 7 8 9", "0 1 2 3 4 5 6 7 8 9", "0 1 2 3 4 5 6 7 8 9")
AT_WORDS, DOT_WORDS, PLUS_WORDS = "at|arroba|klammeraffe|arobase", "dot|punkt|punto|point", "plus"
# --- end of fixed values ---

DIGITS = {w: v for ws, vs in zip(NUMBER_WORDS, NUMBER_VALUES) for w, v in zip(ws.split(), vs.split())}
_WORD = "|".join(sorted(DIGITS, key=len, reverse=True))
# white space before a bracket is taken from its beginning only, and never given back: a long run is read once
_AT_BOX, _DOT_BOX = (rf"(?:(?<!\s)\s++)?[(\[{{<]\s*+(?:{w})\s*+[)\]}}>]\s*+" for w in (rf"{AT_WORDS}|@", rf"{DOT_WORDS}|\."))
_DOT_BARE = rf"[ _-](?:{DOT_WORDS})[ _-](?!(?:{DOT_WORDS})(?![^\W_]))"  # not one of a row of them
_DOT_ANY = rf"(?:{_DOT_BOX}|{_DOT_BARE})"
_DOT_SPOKEN = rf"(?<=\w){_DOT_BARE}(?=\w)"
# a bare "at" counts only where a disguised dot follows within the same words
_AT_SPOKEN = rf"(?<=\w)[ _-](?:{AT_WORDS})[ _-](?=[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*{_DOT_ANY}[A-Za-z0-9])"
REWRITES = re.compile(
    rf"(?P<at>{_AT_BOX}|{_AT_SPOKEN})|(?P<dot>{_DOT_BOX}|{_DOT_SPOKEN})|(?<![^\W_])(?P<words>(?:{_WORD})(?:[ -](?:{_WORD}))*)(?![^\W_])"
    rf"|(?<![^\W_])(?P<plus>{PLUS_WORDS}) ?(?=(?:[0-9]|{_WORD}))|(?<![^\W_])(?P<mixed>(?=[OoIl]*[0-9])(?=[0-9]*[OoIl])[0-9OoIl]+)(?![^\W_])",
    re.IGNORECASE,
)
_ONE_WORD = re.compile(_WORD, re.IGNORECASE)
_BOX = re.compile(rf"[(\[{{<]\s*+(?:{AT_WORDS}|{DOT_WORDS}|@|\.)\s*[)\]}}>]")
_SPOKEN = re.compile(rf"[ _-](?:{DOT_WORDS})[ _-]")
_PLUS = re.compile(rf"(?<![^\W_])(?:{PLUS_WORDS}) ?(?:[0-9]|{_WORD})")
_MIXED = re.compile(r"[0-9](?:(?<=[oil][0-9])|(?=[oil]))")
_TOKEN = re.compile(r"[^\W_]+")
_LETTERS = str.maketrans("OoIl", "0011")


@cache
def characters() -> dict[int, str]:
    """The first transducer: by look, and by Unicode's own decimal values and compatibility forms.  "" removes."""
    table = {ord(k): v for k, v in LOOKALIKES.items()}
    for c in range(128, 0x20000):
        ch = chr(c)
        if c in table or 0xD800 <= c < 0xE000:
            continue
        if (d := unicodedata.decimal(ch, None)) is not None:
            table[c] = str(d)
        elif unicodedata.category(ch) == "Cf":
            table[c] = ""
        elif unicodedata.category(ch) == "Zs":
            table[c] = " "
        elif len(n := unicodedata.normalize("NFKC", ch)) == 1 and n.isascii() and n.isprintable():
            table[c] = n
    return table


@cache
def _changed() -> re.Pattern:
    """Finds a character that the table changes, or any beyond the basic plane."""
    return re.compile("[" + "".join(re.escape(chr(c)) for c in characters() if c < 0x10000) + "\U00010000-\U0010ffff]")


def _lower(text: str) -> str:
    """In small letters, of the same length: ``REWRITES`` takes the dotted capital for an i as well."""
    return text.replace("İ", "i").lower()


def _hint(text: str) -> bool:
    """Whether ``REWRITES`` may match: a sign or point in brackets or as a word, a plus before a number, letters among digits, a
    number word anywhere.  True wherever it matches, as each of its alternatives is tested by what it cannot do without."""
    low = _lower(text)
    return bool(
        _BOX.search(low) or (any(w in low for w in DOT_WORDS.split("|")) and _SPOKEN.search(low))
        or (any(w in low for w in PLUS_WORDS.split("|")) and _PLUS.search(low)) or _MIXED.search(low) or not DIGITS.keys().isdisjoint(_TOKEN.findall(low))
    )


def normalise(text: str) -> tuple[str, np.ndarray, np.ndarray] | None:
    """The rewritten text, and for each of its characters the start and end of what it stands for; None where nothing
    changes."""
    plain, starts = text, None
    if not text.isascii() and _changed().search(text):
        table = characters()
        plain = text.translate(table)
        gone = [i for i, c in enumerate(text) if table.get(ord(c)) == ""]
        starts = np.delete(np.arange(len(text)), gone)
    if not _hint(plain):
        return None if starts is None else (plain, starts, starts + 1)
    if starts is None:
        starts = np.arange(len(text))
    out, lo, hi, at = [], [], [], 0

    def copy(a: int, b: int) -> None:
        out.append(plain[a:b])
        lo.append(starts[a:b])
        hi.append(starts[a:b] + 1)

    def put(chars: str, a: int, b: int) -> None:
        out.append(chars)
        lo.append(np.full(len(chars), starts[a]))
        hi.append(np.full(len(chars), starts[b - 1] + 1))

    for m in REWRITES.finditer(plain):
        copy(at, m.start())
        at = m.end()
        kind = m.lastgroup
        if kind == "words":
            for w in _ONE_WORD.finditer(plain, m.start(), m.end()):
                put(DIGITS[_lower(w[0])], w.start(), w.end())
        elif kind == "mixed":
            for i, c in enumerate(m[0].translate(_LETTERS), m.start()):
                put(c, i, i + 1)
        else:
            put({"at": "@", "dot": ".", "plus": "+"}[kind], m.start(), m.end())
    copy(at, len(plain))
    return "".join(out), np.concatenate(lo), np.concatenate(hi)


def disguised(text: str, base: list[Span]) -> list[Span]:
    """Spans that only the rewritten text shows: their source reads otherwise and lies within no base span.  One that goes beyond
    a base span stands beside it, as the base span may be only a part of it.  ``base`` is sorted, as ``find`` gives it."""
    rewritten = normalise(text)
    if rewritten is None:
        return []
    plain, lo, hi = rewritten
    begins, reach = [s for s, _, _ in base], list(accumulate((e for _, _, e in base), max))
    found = []
    for start, kind, end in find(plain):
        a, b = int(lo[start]), int(hi[end - 1])
        before = bisect_right(begins, a)  # base spans that begin no later
        if text[a:b] != plain[start:end] and not (before and reach[before - 1] >= b):
            found.append((a, kind, b))
    return found


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span, or run of overlapping ones, replaced by ``<KIND>`` of the first."""
    out, at = [], 0
    for a, k, b in spans:
        if a >= at:
            out += [text[at:a], f"<{KINDS[k].upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


ROWS = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row its id, the counts of all spans by kind, the hash of the base spans and all spans as ``kind:start:end`` by start
    and kind.

    Offsets are code points, ends exclusive.  A null or empty text has no spans; repeated rows are treated alike.  All
    steps take time in proportion to a text's length, however long its runs are.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, hashes, spans = [], [], []
            for text in batch.column(1).to_pylist():
                base = find(text) if text else []
                every = sorted(base + disguised(text, base)) if text else []
                counts.append([sum(k == i for _, k, _ in every) for i in range(len(KINDS))])
                hashes.append(hashlib.sha256(written(base).encode()).hexdigest())
                spans.append(written(every))
            columns = [batch.column(0), *(pa.array(c, pa.int64()) for c in (zip(*counts) if counts else [[]] * 4))]
            columns += [pa.array(x, pa.string()) for x in (hashes, spans)]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in ROWS.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(task, ROWS)


def mask_text(text: str | None) -> str | None:
    """The text with every span replaced by its kind in angle brackets; null stays null."""
    if not text:
        return text
    base = find(text)
    return masked(text, sorted(base + disguised(text, base)))


def mask(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows with their texts masked."""
    return rewrite(docs, text_col, mask_text)
