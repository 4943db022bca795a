"""Main text of web pages as the maximum-scoring subsequence of their tokens: words score positive and tags negative,
by weights learned from labelled pages, and one linear scan finds the best contiguous region.

Labelled pages are those that mark their main text themselves (one ``article`` or ``main`` element): tokens inside
against tokens outside give the log-odds of each tag and of words by the most telling element around them.  At most
``sample`` pages are used for the fit (a documented bound, chosen by a hash); pseudo-counts of well-known element names
stand in where labelled pages are few.  Names known to tell of asides count before anything is learned about them, but
never against an element that holds most of the page's main text.  Extraction is row-wise, needs no mark, and takes time in
proportion to the page.

Nulls and edge cases: null and empty pages give an empty text; unclosed tags, comments and scripts end with the page;
among regions of equal score the first is taken; repeated rows are treated each for itself; an empty table gives an
empty result; a ``<`` that opens no tag is text; only key, url and html are read, so other columns may clash or be null.
"""

from __future__ import annotations

import html as entities
import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmill.llm.common import by_value, map_rows

by_value(__name__)

SAMPLE, FEATURES = 2_000, 5_000

# Elements by their role in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "select")
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form "
                  "h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
ASIDE_TAGS = frozenset("nav header footer aside form button dialog menu head fieldset label".split())
#: Tags whose presence around words says something; other tags only hold what names tell.
TELLING_TAGS = ASIDE_TAGS | {"article", "main"}
ASIDE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement adbox banner sponsor sponsored promo promotion nav navbar navigation menu topnav "
    "breadcrumb breadcrumbs header masthead footer bottom sidebar side aside widget related recommended share social comment comments "
    "commentlist reply replies discussion disqus reader cookie cookies consent notice notices gdpr popup modal newsletter subscribe "
    "signup login search form copyright legal pagination pager toolbar".split())
#: Words that turn a name around, as in ``no-sidebar`` or ``ad-free``.
TURNS = frozenset("no not non without with has free is".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^<>]*>"
    r"|<(?P<raw>{raw})\b(?:[^\"'<>]|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/)?(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attr>(?:[^\"'<>]|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<close2>/)?(?P<tag2>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attr2>[^<>]*)(?:>|\Z)"
    r"|(?P<text>[^<]+|<)".format(raw="|".join(RAW)), re.S | re.I)
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
SPACE = re.compile(r"\s+")


def features(tag: str, attr: str) -> list[str]:
    """Names of an element that weights attach to: its tag, and each name of its class, id and role as a whole."""
    out = [tag] if tag in TELLING_TAGS else []
    for m in NAMES.finditer(attr) if attr else ():
        out += ["." + w for w in (m[1] or m[2] or m[3] or "").lower().split()]
    return out


def _known(name: str) -> bool:
    """Whether a feature is the tag of an element known not to be main text, or a name with such a word in it and none that
    turns it around."""
    if name[0] != ".":
        return name in ASIDE_TAGS
    parts = [w for w in re.split(r"[^a-z0-9]+", name) if w]
    return not TURNS.intersection(parts) and not ASIDE_NAMES.isdisjoint(parts)


class Parsed:
    """Tokens (kind, value, element) of a page, kind one of text, open and close, and its elements by number: parent, tag, names,
    words in all, words in article or main elements, and those of them that lie in such an element below.  Element 0 is the page.

    A closing tag ends the innermost open element of its name and all within; a block ends an open paragraph."""

    def __init__(self, page: str):
        self.tokens: list[tuple[str, str, int]] = []
        self.parent, self.tag, self.names = [0], [""], [[]]
        own, stack, blocks, count = [0], [0], [0], {}  # blocks: places in the stack of open blocks

        def cut(at: int) -> None:
            while len(stack) > at:
                count[self.tag[stack.pop()]] -= 1
            while blocks[-1] >= at:
                blocks.pop()

        for m in TOKEN.finditer(page):
            text = m["text"]
            if text is not None:
                own[stack[-1]] += len(text.split())
                self.tokens.append(("text", text, stack[-1]))
                continue
            tag = m["tag"] or m["tag2"]
            if not tag:
                continue  # comments, declarations, scripts and the like
            tag = tag.lower()
            if m["close"] or m["close2"]:
                if count.get(tag):
                    at = len(stack) - 1
                    while self.tag[stack[at]] != tag:
                        at -= 1
                    cut(at)
                self.tokens.append(("close", tag, stack[-1]))
                continue
            attr = m["attr"] if m["tag"] else m["attr2"]
            if tag in BLOCK and self.tag[stack[blocks[-1]]] == "p":
                cut(blocks[-1])
            if tag not in VOID and not attr.endswith("/"):
                self.parent.append(stack[-1])
                self.tag.append(tag)
                self.names.append(features(tag, attr))
                own.append(0)
                stack.append(len(own) - 1)
                count[tag] = count.get(tag, 0) + 1
                if tag in BLOCK:
                    blocks.append(len(stack) - 1)
            self.tokens.append(("open", tag, stack[-1]))
        n = len(own)
        marked = [False] * n
        for i in range(1, n):
            marked[i] = marked[self.parent[i]] or self.tag[i] in ("article", "main")
        self.words = own
        self.in_mark = [w if f else 0 for w, f in zip(own, marked)]
        self.mark_below = [0] * n
        self.marked = marked
        for i in range(n - 1, 0, -1):
            up = self.parent[i]
            self.words[up] += self.words[i]
            self.in_mark[up] += self.in_mark[i]
            self.mark_below[up] += self.in_mark[i] if self.tag[i] in ("article", "main") else self.mark_below[i]

    def holds_marks(self, i: int) -> bool:
        """Whether an element is a frame of the page: one of those that always are, or around most of what articles hold."""
        return self.tag[i] in ("", "html", "body", "main", "article") or 2 * self.mark_below[i] > max(1, self.in_mark[0])

    def holds_most(self, i: int) -> bool:
        """Whether an element has most of the main text by its mark, or else of all text."""
        return 2 * self.in_mark[i] > self.in_mark[0] if self.in_mark[0] else 2 * self.words[i] > self.words[0]


def evidence(page: str) -> dict[str, list[int]] | None:
    """Feature -> [tokens inside, outside] of a labelled page; None if it is none.

    Features: ``tag:x`` per tag, and ``in:x`` per name of an element around words, counted by words.  Words of comments,
    adverts and the like count as outside also where they lie in the article."""
    low = page.lower()
    if low.count("<article") + low.count("<main") != 1:
        return None
    d = Parsed(page)
    main, around = [False] * len(d.parent), [frozenset()] * len(d.parent)
    for i in range(1, len(d.parent)):
        up = d.parent[i]
        around[i] = around[up].union(d.names[i]) if d.names[i] else around[up]
        aside = d.marked[up] and not d.holds_most(i) and any(_known(n) for n in d.names[i] if n not in ("header", ".header"))
        main[i] = d.marked[i] and (main[up] or not d.marked[up]) and not aside
    out: dict[str, list[int]] = {}
    for kind, value, i in d.tokens:
        if kind == "text":
            n = len(value.split())
            if n:
                for f in around[i]:
                    out.setdefault("in:" + f, [0, 0])[not main[i]] += n
                out.setdefault("word", [0, 0])[not main[i]] += n
        else:
            out.setdefault("tag:" + value, [0, 0])[not d.marked[i]] += 1
    return out


def train(pages: DataFrame, html: str = "html", pick=None, sample: int = SAMPLE) -> dict[str, float]:
    """Weights from at most about ``sample`` pages; the ``FEATURES`` most frequent names are kept."""
    total = pages.count()
    chance = F.pmod(pick if pick is not None else F.xxhash64(html), F.lit(1_000_000))
    chosen = pages.where(F.col(html).isNotNull() & (chance < math.ceil(1e6 * sample / max(1, total))))

    def count(c):
        for p in c["h"]:
            for k, (a, b) in (evidence(p) or {}).items():
                yield k, a, b

    sums = (map_rows(chosen.select(F.col(html).alias("h")), count, "f string, a bigint, b bigint").groupBy("f")
            .agg(F.sum("a").alias("a"), F.sum("b").alias("b")).orderBy(F.desc(F.col("a") + F.col("b")), "f").limit(FEATURES))
    return weights({r["f"]: (r["a"], r["b"]) for r in sums.collect()})


def weights(counts: dict[str, tuple[int, int]]) -> dict[str, float]:
    """Log-odds of lying inside, with pseudo-counts for known names."""
    inside, outside = counts.get("word", (0, 0))
    odds = (inside + 1) / (outside + 1)
    out = {}
    for k, (a, b) in counts.items():
        if k.startswith("in:"):
            name = k[3:]
            pa, pb = (0.5, 50) if _known(name) else (5, 5 / odds)
            out[k] = math.log((a + pa) / (b + pb) / odds)
        elif k.startswith("tag:"):
            out[k] = -0.05 - 0.25 * b / (a + b + 1)
    return out


class Extractor:
    def __init__(self, model: dict[str, float]):
        self.model = model

    def learned(self, names: list[str]) -> float:
        """The lowest weight learned for a name of one element."""
        return min((self.model.get("in:" + n, 0.0) for n in names), default=0.0)

    def region(self, page: str) -> list[tuple[str, str, bool]]:
        """The tokens of the best region: (kind, value, whether it lies in an element that is not main text)."""
        d = Parsed(page)
        n = len(d.parent)
        off, within = [False] * n, [False] * n  # not main text; in an article, by its mark or by a name learned to tell so
        for i in range(1, n):
            up, names = d.parent[i], d.names[i]
            within[i] = within[up] or d.tag[i] in ("article", "main") or any(self.model.get("in:" + x, 0.0) > 1.0 for x in names)
            if d.marked[up]:  # the heading part of an article belongs to it
                names = [x for x in names if x not in ("header", ".header")]
            told = self.learned(names) < -1.5 and not d.holds_marks(i)
            guess = any("in:" + x not in self.model and _known(x) for x in names) and not d.holds_marks(i) and not d.holds_most(i)
            off[i] = off[up] or told or guess
        seen, best, top, run, begin = [], (0, 0), 0.0, 0.0, 0
        for kind, value, i in d.tokens:
            if off[i] and within[i]:
                score = 0.0  # left out of the text anyway, and the article goes on after it
            elif kind == "text":
                words = len(value.split())
                score = -0.2 * words if off[i] else 1.0 * words
            else:
                score = self.model.get("tag:" + value, -0.2)
            seen.append((kind, value, off[i]))
            if run <= 0:
                run, begin = 0.0, len(seen) - 1
            run += score
            if run > top:
                top, best = run, (begin, len(seen))
        return seen[best[0]:best[1]]

    def text(self, page: str | None) -> str:
        blocks: list[str] = []
        held: list[str] = []

        def end():
            t = SPACE.sub(" ", entities.unescape("".join(held))).strip()
            held.clear()
            if t:
                blocks.append(t)

        for kind, value, off in self.region(page) if page else ():
            if kind == "text":
                if not off:
                    held.append(value)
            elif value in BLOCK:
                end()
            elif value == "br":
                held.append(" ")
        end()
        return "\n\n".join(blocks)


def extract(pages: DataFrame, model: dict[str, float], keys: list[str], html: str = "html") -> DataFrame:
    """``keys`` with ``text`` and ``n_chars`` for every page."""
    def rows(c):
        x = Extractor(model)
        for *k, h in zip(*[c[f"k{i}"] for i in range(len(keys))], c["h"]):
            t = x.text(h)
            yield (*k, t, len(t))

    kinds = ", ".join(f"`{k}` {pages.schema[k].dataType.simpleString()}" for k in keys)
    return map_rows(pages.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.col(html).alias("h")), rows,
                    f"{kinds}, text string, n_chars bigint")
