"""Packing of documents into training sequences by best-fit decreasing: overlong documents are first cut into full
windows; of the remainders, longest first, each goes into the open window with the least room that still holds it,
found in a segment tree indexed by remaining capacity.

Every task packs its own input split, so there is no shuffle.  A task holds the remainders of at most ``buffer``
tokens and one document; windows that stay far from full are opened again for the next remainders, so only a few
windows of a task are padded.  A task that runs again gives the same rows.

Nulls and edge cases: a null or empty text is one separator token; null keys are kept; equal lengths keep the order of
the input; repeated rows are packed each for itself; an empty table gives an empty result; only key and text are read,
so other columns may clash or be null.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmill.llm.common import arrow_schema, by_value, once, to_batches

by_value(__name__)

WINDOW, BUFFER, SEPARATOR = 1024, 1 << 22, 0
SCHEMA = ("start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint")


class Capacities:
    """Open windows by remaining capacity, in a segment tree whose nodes say whether anything is below."""

    def __init__(self, size: int):
        self.leaves = 1 << (size - 1).bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, capacity: int, window: int) -> None:
        if capacity <= 0:
            return
        self.open[capacity].append(window)
        i = self.leaves + capacity - 1
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(capacity, window) with the least capacity of at least ``need``; it is taken out."""
        i = self.leaves + need - 1
        if not self.count[i]:
            while i > 1 and (i & 1 or not self.count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        capacity = i - self.leaves + 1
        while i:
            self.count[i] -= 1
            i >>= 1
        return capacity, self.open[capacity].pop()


def best_fit(lengths: list[int], size: int = WINDOW) -> list[list[int]]:
    """Indices of the pieces of each window, by best-fit decreasing; pieces are at most ``size`` long."""
    rooms, windows = Capacities(size), []
    for i in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        n = lengths[i]
        found = rooms.take(n)
        if found is None:
            windows.append([i])
            rooms.add(size - n, len(windows) - 1)
        else:
            windows[found[1]].append(i)
            rooms.add(found[0] - n, found[1])
    return windows


UNUSUAL = re.compile("[^\x00-\u024f]")


def encoder(path: str):
    """text -> token ids as the tokenizers library gives them for a byte-level BPE file, special tokens included.

    Text of ASCII and Latin letters without special tokens is encoded by tiktoken from the same file, which gives the
    same ids in a third of the time, if the file's merges are in the order of its ids; all else by the library itself.
    """
    import tiktoken
    from tokenizers import Tokenizer
    exact = Tokenizer.from_file(path)
    exact.no_truncation()
    exact.no_padding()
    whole = lambda t: np.array(exact.encode(t, add_special_tokens=False).ids, np.uint32)
    spec = json.load(open(path))
    byte, kind = _byte_of_letter(), spec.get("pre_tokenizer") or {}
    special = [a["content"] for a in spec.get("added_tokens", [])]
    vocab = {k: v for k, v in spec["model"]["vocab"].items() if k not in special}
    merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    made = [vocab.get(a + b, -1) for a, b in merges]
    if (made != sorted(made) or -1 in made or spec.get("normalizer") or kind.get("type") != "ByteLevel" or kind.get("add_prefix_space")
            or not kind.get("use_regex") or not all(c in byte for k in vocab for c in k)):
        return whole
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    fast = tiktoken.Encoding("file", pat_str=pattern, special_tokens={},
                             mergeable_ranks={bytes(byte[c] for c in k): v for k, v in vocab.items()})

    def encode(text: str) -> np.ndarray:
        if UNUSUAL.search(text) or any(s in text for s in special):
            return whole(text)
        return np.array(fast.encode_ordinary(text), np.uint32)

    return encode


def _byte_of_letter() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 characters for themselves,
    the rest in order from U+0100."""
    out, spare = {}, 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out[chr(b)] = b
        else:
            out[chr(spare)] = b
            spare += 1
    return out


def _pack(rows: Iterator[tuple], encode, task: int, window: int, buffer: int, separator: int) -> Iterator[tuple]:
    held: list[tuple] = []  # (key, start, ids, tokens of the document)
    size = 0
    serial = task << 40

    def place(pieces: list[tuple]) -> Iterator[tuple]:
        nonlocal serial
        at = 0
        for key, start, ids, total in pieces:
            yield key, start, len(ids), ids.astype("<u4").tobytes(), total, serial, at
            at += len(ids)
        serial += 1

    def flush(last: bool) -> Iterator[tuple]:
        nonlocal held, size
        again = []
        for w in best_fit([len(p[2]) for p in held], window):
            pieces = [held[i] for i in w]
            if not last and 10 * sum(len(p[2]) for p in pieces) < 9 * window:
                again += pieces
            else:
                yield from place(pieces)
        # What is opened again may not fill the buffer by itself.
        held, size = again, sum(len(p[2]) for p in again)
        if 2 * size > buffer:
            for w in best_fit([len(p[2]) for p in held], window):
                yield from place([held[i] for i in w])
            held, size = [], 0

    for key, text in rows:
        ids = np.append(encode(text or ""), np.uint32(separator)).astype(np.uint32)
        full = len(ids) // window * window
        for at in range(0, full, window):
            yield from place([(key, at, ids[at:at + window], len(ids))])
        if full < len(ids):
            held.append((key, full, ids[full:].copy(), len(ids)))
            size += len(ids) - full
        if size >= buffer:
            yield from flush(False)
    yield from flush(True)


def pack(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", window: int = WINDOW,
         buffer: int = BUFFER, separator: int = SEPARATOR) -> DataFrame:
    """One row per piece: its document, start and length there, token ids (little-endian unsigned 32-bit), the
    document's tokens, its sequence and its place there."""
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, {SCHEMA}"
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]):
        rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns)))
        task = TaskContext.get().partitionId()
        yield from to_batches(_pack(rows, once(("encoder", path), lambda: encoder(path)), task, window, buffer, separator), arrow, 5_000)

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, schema)
