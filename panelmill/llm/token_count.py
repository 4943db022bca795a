"""Exact token counts of texts of any length: huge documents are encoded in overlapping chunks with offsets, and
neighbouring chunks are spliced at a boundary that both have and that is proven stable; where there is none the
overlap is widened.

A boundary before a single blank, between two characters that are not white space, is stable if no entry of the
vocabulary reaches over it.  The loader proves that for the vocabulary at hand (no entry has a word mark after
another character); otherwise texts are encoded whole.

Row-wise: no shuffle; a task holds one batch of texts and the tokens of one chunk.

Nulls and edge cases: a null text counts as empty (0 bytes, 0 tokens); other columns may be null or clash, as only key
and text are read; repeated rows are counted each for itself; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmill.llm.common import by_value, map_rows, once

by_value(__name__)

CHUNK, OVERLAP = 1 << 17, 1 << 10
SEAM = re.compile(r"(?<=\S) (?=\w)")


class PieceModel:
    """A sentencepiece model; blanks inside a text become the word mark, one more stands before the text."""

    def __init__(self, path: str):
        import sentencepiece
        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        self.stable = not any("▁" in p.lstrip("▁") for p in pieces) and self._plain()

    def _plain(self) -> bool:
        """Whether blanks are kept as they are and a text gets one mark in front."""
        return self.sp.normalize("a  b") == "▁a▁▁b" and self.sp.normalize(" a") == "▁▁a"

    def count(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.sp.encode(texts, num_threads=1)]

    def ends(self, chunk: str) -> tuple[list[int], list[int]]:
        """Starts and ends of the tokens, in UTF-8 bytes."""
        pieces = self.sp.encode(chunk, return_type="proto").pieces
        return [p.begin for p in pieces], [p.end for p in pieces]

    #: A chunk may not contain the mark itself, which would look like a blank.
    def splits(self, text: str) -> bool:
        return self.stable and "▁" not in text

    def unit(self, text: str) -> int:
        return len(text.encode())


class ByteModel:
    """A byte-level BPE of the tokenizers library, cut into words by its pattern before the merges."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.t = Tokenizer.from_file(path)
        self.t.no_truncation()
        self.t.no_padding()
        spec = json.load(open(path))
        kind = spec.get("pre_tokenizer") or {}
        self.stable = (kind.get("type") == "ByteLevel" and kind.get("use_regex") and not kind.get("add_prefix_space")
                       and spec.get("normalizer") is None)
        self.special = [a["content"] for a in spec.get("added_tokens", [])]

    def count(self, texts: list[str]) -> list[int]:
        return [len(x.ids) for x in self.t.encode_batch_fast(texts, add_special_tokens=False)]

    def ends(self, chunk: str) -> tuple[list[int], list[int]]:
        offsets = self.t.encode(chunk, add_special_tokens=False).offsets
        return [a for a, _ in offsets], [b for _, b in offsets]

    def splits(self, text: str) -> bool:
        return self.stable and not any(s in text for s in self.special)

    def unit(self, text: str) -> int:
        return len(text)


def load(path: str):
    """The tokenizer of a file, once per worker."""
    return once(("tokenizer", path), lambda: PieceModel(path) if path.endswith(".model") else ByteModel(path))


def count_huge(model, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of ``text`` from overlapping chunks of about ``chunk`` characters."""
    if len(text) <= chunk or not model.splits(text):
        return model.count([text])[0]
    total, at = 0, 0  # the text before ``at`` is counted
    while len(text) - at > chunk:
        wide = overlap
        while True:
            cut = at + chunk
            end = min(len(text), cut + wide)
            seam = _seam(model, text, at, cut, end)
            if seam:
                n, at = seam
                total += n
                break
            if end == len(text):
                return total + model.count([text[at:]])[0]
            wide *= 2
    return total + model.count([text[at:]])[0]


def _seam(model, text: str, at: int, cut: int, end: int) -> tuple[int, int] | None:
    """Tokens of text[at:seam], and the seam, for a stable boundary in (cut, end) that the chunk up to ``end`` and
    the next chunk, begun at ``cut``, both have."""
    _, ends = model.ends(text[at:end])
    starts, _ = model.ends(text[cut:min(len(text), end + (end - cut))])
    first, second = set(ends), set(starts)
    for m in SEAM.finditer(text, cut + 1, end - 1):
        a, b = model.unit(text[at:m.start()]), model.unit(text[cut:m.start()])
        if a in first and (b in second or b + 1 in second):
            # A piece model puts its own mark before a chunk, so the next one starts behind the blank.
            return sum(1 for e in ends if e <= a), m.start() + isinstance(model, PieceModel)
    return None


def count_tokens(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = 4096,
                 chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Per document: bytes, tokens, and whether it has more than ``limit`` tokens."""
    def rows(c):
        model, ids, held, size = load(path), [], [], 0

        def out():
            for i, t, n in zip(ids, held, model.count(held)):
                yield i, len(t.encode()), n, n > limit

        for i, t in zip(c["k"], c["t"]):
            t = t or ""
            if len(t) > chunk:
                n = count_huge(model, t, chunk, overlap)
                yield i, len(t.encode()), n, n > limit
                continue
            ids.append(i)
            held.append(t)
            size += len(t)
            if size > 1 << 20:
                yield from out()
                ids, held, size = [], [], 0
        if ids:
            yield from out()

    kind = docs.schema[key].dataType.simpleString()
    return map_rows(docs.select(F.col(key).alias("k"), F.col(text).alias("t")), rows,
                    f"{key} {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
