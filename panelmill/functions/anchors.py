"""Many words looked for in a text in one pass, as a row expression.

A word is named by one of its windows of WINDOW characters (a shorter word by itself): the one that the fewest other words
have.  A text gives its distinct windows of the lengths in use; those that name words are found in a table of buckets by
their checksum, and only the few words they name are then looked for themselves.  The table is one constant of the plan,
so the work per text grows with the text and not with the number of words.
"""

import json
import zlib
from collections import Counter
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

WINDOW = 4


def constant(value, kind: str) -> Column:
    """A large constant as one literal, which the optimizer evaluates once."""
    return F.from_json(F.lit(json.dumps({"v": value}, ensure_ascii=False)), f"v {kind}")["v"]


def table(rows: Mapping[str, Sequence[dict]], kind: str) -> Callable[[Column], Column]:
    """A lookup of the rows (fields ``kind``) of a key, in time that does not depend on how many there are."""
    size = 1 << max(4, (2 * len(rows)).bit_length())
    buckets: list[list] = [[] for _ in range(size)]
    for key, found in rows.items():
        buckets[zlib.crc32(key.encode()) % size] += [{"key": key, **r} for r in found]
    held = constant(buckets, f"array<array<struct<key:string,{kind}>>>")
    # A null key finds nothing.
    return lambda key: F.filter(F.get(held, (F.crc32(key.cast("binary")) % size).cast("int")), lambda e: e["key"] == key)


def rarest_windows(words: Sequence[str]) -> dict[str, str]:
    """The window that names each word."""
    of = {w: [w[i:i + WINDOW] for i in range(len(w) - WINDOW + 1)] or [w] for w in words}
    have = Counter(x for windows in of.values() for x in set(windows))
    return {w: min(windows, key=lambda x: have[x]) for w, windows in of.items()}


def words_in(text: Column, entries: Sequence[tuple[str, int, float]]) -> Column:
    """The entries (word, number, weight) whose word is in ``text``, as array of (w, no, weight); an empty word is in every
    text."""
    kind = "w:string,no:int,weight:double"
    name = rarest_windows(list(dict.fromkeys(w for w, _, _ in entries if w)))
    groups: dict[int, dict[str, list]] = {}
    always = []
    for w, no, weight in entries:
        row = {"w": w, "no": no, "weight": weight}
        if w:
            groups.setdefault(len(name[w]), {}).setdefault(name[w], []).append(row)
        else:
            always.append(row)
    found = []
    for n, rows in sorted(groups.items()):
        # The look-ahead captures the window, the dot moves on by one character.
        windows = F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))."), F.lit(1)))
        found.append(F.flatten(F.transform(windows, table(rows, kind))))
    out = None
    if found:
        held = F.filter(F.concat(*found), lambda e: F.contains(text, e["w"]))
        out = F.transform(held, lambda e: F.struct(e["w"].alias("w"), e["no"].alias("no"), e["weight"].alias("weight")))
    if always:
        rest = F.when(text.isNotNull(), constant(always, f"array<struct<{kind}>>"))
        out = rest if out is None else F.concat(rest, out)
    return F.array().cast(f"array<struct<{kind}>>") if out is None else out


def edges_of(text: Column, rules: Sequence[tuple[str, str, int]]) -> Column:
    """Rules (match type, keyword, number) that hold at the edges of ``text``, or for the whole of it, as array of (no, n): how
    often each is given.  A text is looked up once per match type and length of keyword."""
    times = Counter(rules)
    rows: dict[str, list] = {}
    lengths: dict[str, set] = {"absolutely": set(), "start": set(), "end": set()}
    for (kind, word, no), n in times.items():
        rows.setdefault(f"{kind} {word}", []).append({"no": no, "n": n})
        lengths[kind].add(len(word))
    probes = [F.concat(F.lit("absolutely "), text)] if lengths["absolutely"] else []
    for kind, cut in (("start", F.left), ("end", F.right)):
        probes += [F.when(F.length(text) >= n, F.concat(F.lit(f"{kind} "), cut(text, F.lit(n)))) for n in sorted(lengths[kind])]
    if not probes:
        return F.array().cast("array<struct<key:string,no:int,n:int>>")
    return F.flatten(F.transform(F.filter(F.array(*probes), lambda p: p.isNotNull()), table(rows, "no:int,n:int")))
