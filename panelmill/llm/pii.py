"""Personal data, also in disguise: transducers rewrite homoglyphs, spelled digits and at/dot disguises while they
keep, for each character they write, the span of source characters it came from; identifiers are detected in the
plain and in the rewritten text, and spans of the latter are mapped back to the source.

Row-wise: no shuffle.  Work and memory are linear in a text's length.

Nulls and edge cases: null and empty texts have no spans; spans count code points, end exclusive; ties between a plain
and a disguised span are settled for the plain one; repeated rows are treated each for itself; an empty table gives
an empty result; only the named key and text columns are read, so other columns may clash or be null.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmill.llm.common import by_value, map_rows

by_value(__name__)

KINDS = ("email", "ip", "card", "phone")

# Letters of other scripts that look like a Latin letter or digit.
LOOKALIKES = dict(zip("аеорсухіјѕԁԛԝһАВЕКМНОРСТУХІЈЅοανιρτκΑΒΕΖΗΙΚΜΝΟΡΤΥΧ",
                      "aeopcyxijsdqwhABEKMHOPCTYXIJSoavipTkABEZHIKMNOPTYX"))
LOOKALIKES |= dict.fromkeys("\u3002\uff61\u2024", ".") | dict.fromkeys("\ufe6b", "@") | dict.fromkeys("\ufe62", "+")
LOOKALIKES |= dict.fromkeys("\u2010\u2011\u2012\u2013\u2212", "-") | dict.fromkeys("\u00a0\u2007\u2009\u202f\u3000", " ")
INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
# Digits as words.
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7",
    "eight": "8", "nine": "9", "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5",
    "sechs": "6", "sieben": "7", "acht": "8", "neun": "9", "zéro": "0", "un": "1", "deux": "2", "trois": "3",
    "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9", "cero": "0", "uno": "1", "dos": "2", "tres": "3",
    "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9"}

CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

_AT = r"(?:\s{0,3}[\[({<]\s{0,3}(?:at|@|arroba|arobase)\s{0,3}[\])}>]\s{0,3})"
_DOT = r"(?:\s{0,3}[\[({<]\s{0,3}(?:dot|\.|punkt|point|punto)\s{0,3}[\])}>]\s{0,3}|[ \t]{1,3}(?:dot|punkt)[ \t]{1,3})"
AT = re.compile(_AT + r"|[ \t]{1,3}at[ \t]{1,3}|[ \t]{0,3}@[ \t]{0,3}", re.I)
DOT = re.compile(_DOT, re.I)
DOT_BEFORE = re.compile(_DOT + r"\Z", re.I)
LABEL = re.compile(r"[A-Za-z0-9-]+")
DIGIT_DOT = re.compile(r"(?<=[0-9])" + _DOT + r"(?=[0-9])", re.I)
# Numerals and digit words in a row, with one line end at most between two of them.
NUMBER_RUN = re.compile(r"(?i)\b(?:(?:{0}|[0-9]++)\b(?:[ \t,.-]{{0,2}}\r?\n[ \t]{{0,8}}|[ \t,.-]{{1,2}}))+(?:{0}|[0-9]++)\b".format("|".join(DIGIT_WORDS)))
NUMBER = re.compile(r"(?i)\b(?:{}|[0-9]++)\b".format("|".join(DIGIT_WORDS)))
PLUS = re.compile(r"(?i)\bplus[ \t]{1,2}(?=[0-9])")
BRACKETED = re.compile(r"(?i)[\[({<]\s{0,3}(?:at|@|dot|\.|punkt|point|punto|arroba|arobase)\s{0,3}[\])}>]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if k % 2:
            n = 2 * n - 9 if n > 4 else 2 * n
        total += n
    return total % 10 == 0


def _emails(t: str) -> Iterator[tuple[int, int]]:
    """From every @ to the left as far as its local part goes and to the right as far as a domain does."""
    done, at = 0, t.find("@")
    while at >= 0:
        start = at
        while start > done and t[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(t, at + 1) if start < at else None
        if m:
            done = m.end()
            yield start, done
        at = t.find("@", max(at + 1, done))


def find(t: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of each kind, leftmost and non-overlapping; matches that fail their check are dropped."""
    return {
        "email": list(_emails(t)),
        "ip": [m.span() for m in IP.finditer(t) if all(len(d := p.lstrip("0")) < 4 and int(d or 0) < 256 for p in m[0].split("."))],
        "card": [m.span() for m in CARD.finditer(t)
                 if m.end() - m.start() >= 13 and 13 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d)],
        "phone": [m.span() for m in PHONE.finditer(t) if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15] if "+" in t else [],
    }


class Aligned:
    """A rewritten text with the source span of each of its characters."""

    def __init__(self, text: str):
        self.text = text
        self.start = np.arange(len(text), dtype=np.int64)
        self.end = self.start + 1

    def rewrite(self, edits: list[tuple[int, int, str]]) -> "Aligned":
        """Replace disjoint ascending spans; a replacement's characters all stand for the whole span."""
        if not edits:
            return self
        out = Aligned.__new__(Aligned)
        parts, starts, ends, at = [], [], [], 0
        for a, b, new in edits:
            parts += [self.text[at:a], new]
            starts += [self.start[at:a], np.full(len(new), self.start[a])]
            ends += [self.end[at:a], np.full(len(new), self.end[b - 1])]
            at = b
        out.text = "".join([*parts, self.text[at:]])
        out.start = np.concatenate([*starts, self.start[at:]])
        out.end = np.concatenate([*ends, self.end[at:]])
        return out

    def source(self, a: int, b: int) -> tuple[int, int]:
        return int(self.start[a:b].min()), int(self.end[a:b].max())


def plain_char(c: str) -> str | None:
    """The ASCII character that ``c`` imitates, "" if it is invisible, None if it stands for itself."""
    if c < "\x80":
        return None
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    if c in INVISIBLE:
        return ""
    d = unicodedata.decimal(c, None)
    if d is not None:
        return str(d)
    wide = unicodedata.normalize("NFKC", c) if unicodedata.decomposition(c).startswith(("<wide>", "<font>", "<circle>")) else ""
    return wide if len(wide) == 1 and "!" <= wide <= "~" else None


def imitations(t: str) -> dict[str, str]:
    """The characters of a text that imitate ASCII, and what they imitate."""
    return {c: p for c in set(t) if c > "\x7f" and (p := plain_char(c)) is not None}


def unmask_characters(x: Aligned) -> Aligned:
    """Homoglyphs, digits of other scripts, wide and styled letters; invisible characters go."""
    plain = imitations(x.text)
    if not plain:
        return x
    seen = re.compile("[" + re.escape("".join(plain)) + "]")
    return x.rewrite([(m.start(), m.end(), plain[m[0]]) for m in seen.finditer(x.text)])


def unmask_digits(x: Aligned) -> Aligned:
    """Digits written as words next to another or to a numeral; blanks and a line end between two words go, between a
    word and a numeral they become one blank, other separators stay."""
    edits = []
    for run in NUMBER_RUN.finditer(x.text):
        at, before = None, False
        for m in NUMBER.finditer(x.text, run.start(), run.end()):
            word = not m[0].isdecimal()
            if at is not None and (word or before):
                gap = x.text[at:m.start()]
                new = "" if word and before else " "
                new = gap if gap.strip() and "\n" not in gap else gap.strip() or new
                if new != gap:
                    edits.append((at, m.start(), new))
            if word:
                edits.append((m.start(), m.end(), DIGIT_WORDS[m[0].lower()]))
            at, before = m.end(), word
    return x.rewrite(edits)


def unmask_signs(x: Aligned) -> Aligned:
    """Words and brackets that stand for @, for dots between digits or domain labels, and for a leading plus."""
    t = x.text
    edits = {m.start(): (m.start(), m.end(), ".") for m in DIGIT_DOT.finditer(t)}
    edits |= {m.start(): (m.start(), m.end(), "+") for m in PLUS.finditer(t)}
    at = AT.search(t)
    while at:
        bare = at[0].strip().lower() == "at"
        here, found, plain_dots = at.end(), [], 0
        label = LABEL.match(t, here)
        while label:
            here = label.end()
            dot = DOT.match(t, here)
            if dot and LABEL.match(t, dot.end()):
                found.append((dot.start(), dot.end(), "."))
                label = LABEL.match(t, dot.end())
            elif t[here:here + 1] == "." and LABEL.match(t, here + 1):
                plain_dots += 1
                label = LABEL.match(t, here + 1)
            else:
                label = None
        left = at.start()
        if left and t[left - 1] in LOCAL and (found or plain_dots and not bare):
            while True:
                while left and t[left - 1] in LOCAL:
                    left -= 1
                dot = DOT_BEFORE.search(t, max(0, left - 16), left)
                if not dot or not dot.start() or t[dot.start() - 1] not in LOCAL:
                    break
                found.append((dot.start(), dot.end(), "."))
                left = dot.start()
            if at[0] != "@":
                found.append((at.start(), at.end(), "@"))
            edits |= {e[0]: e for e in found}
        at = AT.search(t, at.end())
    out, end = [], 0
    for e in sorted(edits.values()):
        if e[0] >= end:
            out.append(e)
            end = e[1]
    return x.rewrite(out)


def spans(text: str | None) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, disguised) of all personal data in a text, by kind and start."""
    t = text or ""
    base = find(t)
    x = None if t.isascii() or not imitations(t) else unmask_characters(Aligned(t))
    seen = x.text if x else t
    # The rewriting rules are tried where one of their words occurs at all.
    used = set(seen.lower().replace("-", " ").replace(",", " ").replace(".", " ").split())
    if not used.isdisjoint(DIGIT_WORDS) and NUMBER_RUN.search(seen):
        x = unmask_digits(x or Aligned(t))
        seen = x.text
    if not used.isdisjoint(("dot", "punkt", "plus")) or " @" in seen or "@ " in seen or BRACKETED.search(seen):
        x = unmask_signs(x or Aligned(t))
    extra: dict[str, list[tuple[int, int]]] = {}
    if x is not None and x.text != t:
        extra = {k: [x.source(*s) for s in v] for k, v in find(x.text).items()}
    out = []
    for kind in KINDS:
        own, i = base[kind], 0
        rows = [(kind, a, b, False) for a, b in own]
        for a, b in sorted(extra.get(kind, ())):
            while i < len(own) and own[i][1] <= a:
                i += 1
            if i == len(own) or own[i][0] >= b:
                rows.append((kind, a, b, True))
        out += sorted(rows, key=lambda r: (r[1], r[2]))
    return out


def find_pii(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document with ``pii``: array of (kind, start, end, disguised, value)."""
    def rows(c):
        for i, t in zip(c["k"], c["t"]):
            yield i, [dict(kind=k, start=a, end=b, disguised=d, value=t[a:b]) for k, a, b, d in spans(t)]

    kind = docs.schema[key].dataType.simpleString()
    return map_rows(docs.select(F.col(key).alias("k"), F.col(text).alias("t")), rows,
                    f"{key} {kind}, pii array<struct<kind:string,start:bigint,end:bigint,disguised:boolean,value:string>>")


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts of the plain spans, their checksum, and all spans, from ``find_pii``."""
    text = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter("pii", lambda x: ~x["disguised"])

    def plain(kind: str):
        return F.size(F.filter("pii", lambda x: (x["kind"] == kind) & ~x["disguised"])).cast("long").alias(f"n_{kind}")

    return found.select(
        key, *[plain(k) for k in KINDS],
        F.sha2(text(base), 256).alias("base_sha256"), text(F.col("pii")).alias("spans"),
        F.size(F.filter("pii", lambda x: x["disguised"])).cast("long").alias("n_disguised"))
