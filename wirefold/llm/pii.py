"""Personal data, plain and disguised, with spans in the characters of the source text."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirefold.llm.common import query, table, text_batches

#: Kinds in their order.
KINDS = ["email", "ip", "card", "phone"]

_local = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Possessive runs behind a look-behind start where the leftmost match starts, and keep long runs of
# digits linear: a later start in the same run fails where the first one did.
_ip = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_card = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_not_digit = re.compile(r"[^0-9]")
_digit = re.compile(r"[0-9]")


def _emails(text: str):
    """Leftmost non-overlapping ``local@domain``: around each ``@`` the longest local part that
    starts after the previous match."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _local:
            start -= 1
        m = _domain.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            free = m.end()
        at = text.find("@", max(at + 1, free))


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def find(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the plain identifiers, sorted; matches that fail their test are
    dropped without another try inside them."""
    spans = [(s, 0, e) for s, e in _emails(text)] if "@" in text else []
    if _digit.search(text):
        for m in _ip.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.groups()):
                spans.append((m.start(), 1, m.end()))
        for m in _card.finditer(text):
            if m.end() - m.start() >= 14:
                digits = _not_digit.sub("", m[0])
                if 14 <= len(digits) <= 19 and luhn(digits):
                    spans.append((m.start(), 2, m.end()))
        for m in _phone.finditer(text) if "+" in text else ():
            if 10 <= len(_not_digit.sub("", m[0])) <= 15:
                spans.append((m.start(), 3, m.end()))
    return sorted(spans)


# --- normalising transducers -------------------------------------------------------------------
#: Fixed look-alikes of Latin letters, of digits and of marks.
LETTERS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d",
    "һ": "h", "ӏ": "l", "ո": "n", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ᴍ": "m", "ɡ": "g", "ı": "i", "ℓ": "l",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X",
    "У": "Y", "І": "I", "Ј": "J", "Ѕ": "S",
    "α": "a", "ο": "o", "ρ": "p", "ν": "v", "ι": "i", "κ": "k", "υ": "u", "χ": "x", "γ": "y", "τ": "t",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X",
}
MARKS = {"﹫": "@", "․": ".", "。": ".", "．": ".", "｡": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-",
         "−": "-", "﹣": "-", "﹢": "+", " ": " ", " ": " ", " ": " ", "　": " "}
#: Invisible characters, dropped.
INVISIBLE = "­​‌‍⁠﻿"
#: First code points of further runs of ten digits.
DIGIT_RUNS = [0x0660, 0x06F0, 0x0966, 0x09E6, 0x2080, 0xFF10, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6]


def _compatible() -> dict[str, str]:
    """Characters whose Unicode compatibility form is one ASCII letter, digit or mark of an identifier:
    mathematical, circled, full-width and raised ones, and kinds of blanks."""
    table = {}
    for c in [*range(0x80, 0xD800), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800)]:
        form = unicodedata.normalize("NFKC", chr(c))
        if len(form) == 1 and form.isascii() and (form.isalnum() or form in "@.+-_% ()"):
            table[chr(c)] = form
    return table


def _look_alikes() -> dict[str, str]:
    table = _compatible() | LETTERS | MARKS | dict.fromkeys(INVISIBLE, "")
    for first in DIGIT_RUNS:
        table |= {chr(first + d): str(d) for d in range(10)}
    table |= {c: str(d) for d, c in enumerate("⁰¹²³⁴⁵⁶⁷⁸⁹")}
    table |= {chr(c + 0xFEE0): chr(c) for c in range(0x21, 0x7F)}  # full-width forms
    return table


LOOK_ALIKE = _look_alikes()

#: Spelled digits (English, Spanish, French, German).
DIGIT_WORDS = {
    "zero": 0, "oh": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9,
    "cero": 0, "uno": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9,
    "zéro": 0, "un": 1, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "sept": 7, "huit": 8, "neuf": 9,
    "null": 0, "eins": 1, "zwei": 2, "drei": 3, "vier": 4, "fünf": 5, "sechs": 6, "sieben": 7, "acht": 8, "neun": 9,
}
#: Of these, words that also stand beside a plain number by chance: alone at its edge they are no digit.
ALSO_WORDS = ["oh", "one", "uno", "un", "neuf", "null"]
#: What re.IGNORECASE takes for s and i beside their upper case.
_SAME_CASE = str.maketrans("ſıİ", "sii")
AT_WORDS = ["at", "arroba", "arobase", "chez"]
DOT_WORDS = ["dot", "punto", "point", "punkt"]
_digit_word = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_dot_word = "|".join(DOT_WORDS)
#: At words, and dot words before or behind them, that mean nothing else in running text.
_AROUND = " \t\n\v\f\r_-"
SURE_AT, SURE_DOT, LOCAL_DOT = ["@", "arroba", "arobase"], ["dot"], ["dot", "punto", "punkt"]
#: Last labels that bare words ("at", "dot", without brackets) have to end in, or two letters.
LAST_LABELS = ["com", "org", "net", "edu", "gov", "mil", "int", "info", "biz", "app", "dev", "name"]
_gap = r"[\s,;()-]{1,3}"
_unit = rf"(?:{_digit_word}|[0-9]+)"
# four or more numbers in a row, at least one of them or three dots spelled; "plus" before them, dots between them
_spelled = re.compile(rf"(?<![^\W_])(?:(?:plus|más|\+)\s{{0,2}})?{_unit}(?:{_gap}(?:(?:{_dot_word}){_gap})?{_unit}){{3,}}(?![^\W_])", re.I)
_spelled_part = re.compile(rf"(?P<plus>plus|más|\+)|(?P<dot>{_dot_word})|(?P<word>{_digit_word})|(?P<num>[0-9]+)|(?P<gap>[\s,;()-]+)", re.I)
_open, _close = r"[\[({<]", r"[\])}>]"
_bracketed = re.compile(
    rf"\s{{0,3}}{_open}\s{{0,2}}(?:(?P<at>{'|'.join(AT_WORDS)}|@)|(?P<dot>{_dot_word}|\.))\s{{0,2}}{_close}\s{{0,3}}", re.I)
_gap_at, _gap_dot = r"(?:\s{1,3}|[_-])", r"(?:\s{1,3}|[_-])"
_worded = re.compile(
    rf"(?<=[A-Za-z0-9])(?:{_gap_at}(?:{'|'.join(AT_WORDS)}){_gap_at}|\s{{0,3}}@\s{{0,3}})[A-Za-z0-9]++"
    rf"(?:-[A-Za-z0-9]++)*+(?:(?:{_gap_dot}(?:{_dot_word}){_gap_dot}|\s{{0,3}}\.\s{{0,3}})[A-Za-z0-9]++)+", re.I)
_worded_dot = re.compile(rf"{_gap_dot}(?:{_dot_word}){_gap_dot}|\s{{0,3}}\.\s{{0,3}}", re.I)
_worded_at = re.compile(rf"(?:{_gap_at}(?:{'|'.join(AT_WORDS)}){_gap_at}|\s{{0,3}}@\s{{0,3}})", re.I)


class Mapped:
    """Normalised text as pieces ``(text, source start, source end, changed)``. An unchanged piece
    maps character by character; a changed one as a whole."""

    def __init__(self, pieces):
        self.pieces = [p for p in pieces if p[0] or p[3]]
        self.text = "".join(p[0] for p in self.pieces)
        self.at, n = [], 0
        for p in self.pieces:
            self.at.append(n)
            n += len(p[0])

    def rewrite(self, edits) -> Mapped:
        """Apply ``(start, end, new text)`` edits, in order and apart, to the normalised text."""
        out, done = [], 0
        for start, end, new in edits:
            out += self.between(done, start)
            s, e, _ = self.source(start, end)
            out.append((new, s, e, True))
            done = end
        return Mapped(out + self.between(done, len(self.text)))

    def _overlapping(self, start, end):
        k = max(0, bisect_right(self.at, start) - 1)
        while k < len(self.pieces) and (self.at[k] < end):
            piece, at = self.pieces[k], self.at[k]
            if at + len(piece[0]) > start or (not piece[0] and start < at < end):
                yield piece, max(start, at) - at, min(end, at + len(piece[0])) - at
            k += 1

    def between(self, start, end):
        return [p if p[3] else (p[0][a:b], p[1] + a, p[1] + b, False)
                for p, a, b in (self._overlapping(start, end) if start < end else ())]

    def source(self, start, end):
        """(start, end, changed) in the source of the normalised span."""
        parts = list(self._overlapping(start, end))
        (first, a, _), (last, _, b) = parts[0], parts[-1]
        return (first[1] if first[3] else first[1] + a, last[2] if last[3] else last[1] + b,
                any(p[3] for p, _, _ in parts))


def _look_alike_edits(text):
    if not text.isascii():
        there = LOOK_ALIKE.keys() & set(text)
        for m in re.finditer("[" + "".join(map(re.escape, sorted(there))) + "]", text) if there else ():
            yield m.start(), m.end(), LOOK_ALIKE[m[0]]


#: Names of references to marks in HTML.
REFERENCES = {"commat": "@", "period": ".", "plus": "+", "hyphen": "-", "lowbar": "_", "percnt": "%"}
_reference = re.compile(rf"&(?:#(?P<ten>[0-9]{{1,7}})|#x(?P<hex>[0-9a-f]{{1,6}})|(?P<name>{'|'.join(REFERENCES)}));", re.I)


def _reference_edits(text):
    """Character references in HTML to ASCII letters, digits and marks."""
    for m in _reference.finditer(text) if "&" in text else ():
        code = int(m["ten"]) if m["ten"] else int(m["hex"], 16) if m["hex"] else ord(REFERENCES[m["name"].lower()])
        if 0x20 <= code < 0x7F:
            yield m.start(), m.end(), chr(code)


def _bracketed_edits(text):
    for m in _bracketed.finditer(text):
        yield m.start(), m.end(), "@" if m["at"] else "."


def _spelled_edits(text):
    for m in _spelled.finditer(text):
        parts = list(_spelled_part.finditer(m[0]))
        if not any(p["word"] for p in parts) and sum(p["dot"] is not None for p in parts) < 3:
            continue
        words = [i for i, p in enumerate(parts) if p["word"]]
        if len(words) == 1 and words[0] in (0, len(parts) - 1) and parts[words[0]][0].lower() in ALSO_WORDS:
            continue
        new = "".join("+" if p["plus"] else "." if p["dot"] else str(DIGIT_WORDS[p["word"].translate(_SAME_CASE).lower()]) if p["word"]
                      else p["num"] or "" for p in parts)
        yield m.start(), m.end(), new


def _top(label: str) -> bool:
    return label.lower() in LAST_LABELS


def _account(text: str, end: int) -> bool:
    """Does the run of local-part characters before ``end`` look like an account's name: a mark behind a
    letter, digit, % or +, or a digit behind a letter? Read backwards up to the first such pair."""
    for k in range(end - 1, 0, -1):
        here, before = text[k], text[k - 1]
        if here not in _local or before not in _local:
            return False
        if here in "._%+-" and before not in "._-" or here.isdigit() and before.isalpha():
            return True
    return False


def _last_label(text: str, start: int, end: int) -> str:
    k = end
    while k > start and text[k - 1] not in "._-" and not text[k - 1].isspace():
        k -= 1
    return text[k:end]


def _local_dots(text: str, end: int, free: int) -> list[tuple[int, int, str]]:
    """Edits for dot words inside the local part that ends at ``end``, not before ``free``."""
    def blanks(k):
        j = k
        while j > free and k - j < 3 and text[j - 1].isspace():
            j -= 1
        return j

    edits, k = [], end
    while True:
        while k > free and text[k - 1] in _local:
            k -= 1
        j = blanks(k)
        word = next((w for w in LOCAL_DOT if j < k and j - len(w) >= free and text[j - len(w):j].lower() == w), None)
        i = j - len(word) if word else 0
        h = blanks(i) if word else 0
        if not word or h == i or h <= free or text[h - 1] not in _local:
            return edits[::-1]
        edits.append((h, k, "."))
        k = h


def _worded_edits(text):
    """Bare at and dot words, and blanks around the marks. Without a disguised dot the part before
    "at" has to look like a name of an account, with a digit or mark in it.

    A dot with blanks only behind it may be the end of a sentence. It is taken as one before a
    capitalised word, after a dot without blanks, and where what comes next can be no last label;
    and it is a disguised dot for an "at" only if one of ``LAST_LABELS`` ends the match.

    Behind a dot word any label of letters may be the last, if the at word is one of ``SURE_AT``, or the
    dot word one of ``SURE_DOT`` and the local part looks like an account's or has dot words of its
    own, and no full stop with blanks stands between. Dot words in front of a taken "at" belong to the local part."""
    free = 0
    for m in _worded.finditer(text):
        at, end = _worded_at.match(text, m.start()), m.end()
        dots = list(_worded_dot.finditer(text, at.end(), end))
        stops = [d[0][0] == "." and len(d[0]) > 1 for d in dots]
        labels = [text[d.end():e] for d, e in zip(dots, [*(d.start() for d in dots[1:]), end])]
        plain = False
        for i, stop in enumerate(stops):
            if stop and (plain or labels[i].istitle() and not _top(labels[i])):
                end, dots = dots[i].start(), dots[:i]
                break
            plain = plain or dots[i][0] == "."
        last = _last_label(text, m.start(), end)
        while dots and stops[len(dots) - 1] and not _top(last) and len(last) != 2:
            end = dots.pop().start()
            last = _last_label(text, m.start(), end)
        inner = _local_dots(text, at.start(), free)
        by_at = at[0].strip(_AROUND).lower() in SURE_AT and "." not in dots[-1][0] if dots else False
        by_dot = bool(dots) and dots[-1][0].strip(_AROUND).lower() in SURE_DOT and (bool(inner) or _account(text, at.start()))
        sure = (by_at or by_dot) and not any(stops[:len(dots)]) and last.isalpha() and len(last) >= 2
        if not dots or not _top(last) and len(last) != 2 and not sure:
            continue
        disguised = any(d[0] != "." and (not stop or _top(last)) for d, stop in zip(dots, stops))
        if not disguised and "@" not in at[0] and not _account(text, at.start()):
            continue
        yield from inner
        free = end
        for mark, m in [("@", at), *((".", d) for d in dots)]:
            if m[0] != mark:
                yield m.start(), m.end(), mark


def normalise(text: str) -> Mapped | None:
    """References and look-alikes, then bracketed and spelled at/dot, then spelled digits, each sought in every
    text; None if nothing of the sort is there."""
    out = Mapped([(text, 0, len(text), False)])
    for edits_of in (_reference_edits, _look_alike_edits, _bracketed_edits, _worded_edits, _spelled_edits):
        edits = list(edits_of(out.text))
        out = out.rewrite(edits) if edits else out
    return out if any(p[3] for p in out.pieces) else None


def detect(text: str | None) -> tuple[list, list]:
    """(base spans, added spans) as ``(start, kind, end)``. An added span comes from normalised
    text, holds a changed piece, and lies in no base span or added one of its kind; it may overlap
    others, as where a plain identifier is the tail of a disguised one."""
    text = text or ""
    base, added = find(text), []
    mapped = normalise(text)
    if mapped:
        plain = [[(a, b) for a, k, b in base if k == kind] for kind in range(len(KINDS))]
        last = [0] * len(KINDS)  # spans of a kind come by ascending start
        for start, kind, end in find(mapped.text):
            s, e, changed = mapped.source(start, end)
            while e > s and text[e - 1].isspace():
                e -= 1
            while s < e and text[s].isspace():
                s += 1
            i = bisect_right(plain[kind], s, key=itemgetter(0)) - 1
            if changed and s < e and e > last[kind] and (i < 0 or e > plain[kind][i][1]):
                added.append((s, kind, e))
                last[kind] = e
    return base, added


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def _row(text):
    base, added = detect(text)
    counts = [sum(k == i for _, k, _ in base) for i in range(4)]
    return (*counts, _joined(base), _joined(base + added), len(added))


PII = "n_email long, n_ip long, n_card long, n_phone long, base_spans string, spans string, n_added long"


def personal_data(docs: DataFrame) -> DataFrame:
    """Add the columns of ``PII`` to rows with a ``text`` column (null: empty).

    The four counts and ``base_spans`` are of plain identifiers; ``spans`` has the disguised ones
    too. Spans read ``kind:start:end`` in code points, end exclusive, by start and then kind.
    Repeated rows and other columns stay; columns named like an output are replaced.
    """
    names = [c.split()[0] for c in PII.split(", ")]

    @F.pandas_udf(PII)
    def found(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_row(t) for t in texts], columns=names)

    return text_batches(docs).drop(*names).withColumn("_pii", found("text")).select("*", "_pii.*").drop("_pii")


def base_digest(spans: str) -> str:
    return hashlib.sha256(spans.encode()).hexdigest()


@query("op3_pii")
def op3_pii(spark, sf_dir):
    return (personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
            .select("doc_id", "n_email", "n_ip", "n_card", "n_phone",
                    F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"), "spans", "n_added"))
