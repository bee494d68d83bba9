"""Token counts of texts by byte-pair merging with a heap and a linked list.

The symbols of a piece of text (its characters) form a doubly linked list; every
adjacent pair whose joined string is in the vocabulary waits in a heap ordered by
rank, then place.  The lowest pair is popped again and again and merged unless one
of its ends has changed since; a merge offers its two new neighbours.  The count is
the number of initial symbols minus the merges (a character without a piece counts
as its UTF-8 bytes when the model falls back to bytes).  No identifiers are made.

The model is a SentencePiece BPE file, whose ranks and rules are read from it.  In
such a vocabulary no piece holds the space mark after another character, so no
merge crosses the start of a word: words are counted apart and each distinct one
only once, up to ``REMEMBERED`` of them.

One streaming pass, no shuffle.  Defined cases: null text counts as empty (0
tokens); strings like ``<s>`` inside texts are ordinary text; repeated rows each
get a row; null ids stay null; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import ship_package

LIMIT = 4096
REMEMBERED, LONGEST = 700_000, 48
MARK = "▁"

_counters: dict[str, TokenCounter] = {}


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def protobuf_fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of the fields of one protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            yield tag >> 3, struct.unpack_from("<d" if kind == 1 else "<f", data, at)[0]
            at += size
        elif kind == 2:
            size = varint()
            yield tag >> 3, data[at : at + size]
            at += size
        else:
            raise ValueError("not a model file")


class TokenCounter:
    """Counts tokens as the SentencePiece library would for one BPE model."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            fields = list(protobuf_fields(f.read()))
        pieces = [dict(protobuf_fields(v)) for k, v in fields if k == 1]
        trainer = dict(next((protobuf_fields(v) for k, v in fields if k == 2), ()))
        normal = dict(next((protobuf_fields(v) for k, v in fields if k == 3), ()))
        # Fixed values of the format: model type 2 is BPE; piece types 1 normal, 4 user-defined, 5 unused.
        if trainer.get(3) != 2 or normal.get(1) != b"identity" or normal.get(2) or normal.get(4, 1) or any(p.get(3, 1) in (4, 5) for p in pieces):
            raise ValueError("only BPE models with identity normalization and normal pieces are supported")
        self.rank = {p[1].decode(): -p.get(2, 0.0) for p in pieces if p.get(3, 1) == 1}
        self.bytes_for_unknown = bool(trainer.get(35, 0))
        self.prefix = bool(normal.get(3, 1))
        used = set("".join(self.rank))
        if any(MARK in p.lstrip(MARK) for p in self.rank) or not self.prefix:
            raise ValueError("pieces that hold a space after a character are not supported")
        self.line_breaks_apart = "\n" not in used
        self.known: dict[str, int] = {}

    def merges(self, text: str) -> tuple[int, list[int]]:
        """(number of merges, starts of the symbols that remain) for one piece of text."""
        n = len(text)
        rank = self.rank
        after = list(range(1, n + 1))  # start of the next symbol; also the end of this one
        before = list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            r = rank.get(text[i : i + 2])
            if r is not None:
                heap.append((r, i, i + 1, i + 2))
        heapify(heap)
        done = 0
        while heap:
            _, i, j, end = heappop(heap)
            # Stale unless symbol i still ends at j and symbol j still ends at ``end``.
            if after[i] != j or after[j] != end:
                continue
            done += 1
            after[i] = end
            after[j] = -1
            if end < n:
                before[end] = i
                last = after[end]
                r = rank.get(text[i:last])
                if r is not None:
                    heappush(heap, (r, i, end, last))
            b = before[i]
            if b >= 0:
                r = rank.get(text[b:end])
                if r is not None:
                    heappush(heap, (r, b, i, end))
        starts, i = [], 0
        while i < n:
            starts.append(i)
            i = after[i]
        return done, starts

    def count_piece(self, text: str) -> int:
        if text in self.rank and len(text) == 1:
            return 1
        done, starts = self.merges(text)
        total = len(text) - done
        if self.bytes_for_unknown:
            ends = starts[1:] + [len(text)]
            total += sum(len(text[s:e].encode()) - 1 for s, e in zip(starts, ends) if text[s:e] not in self.rank)
        return total

    def _word(self, word: str) -> int:
        """Tokens of a word; one that begins a line holds its line break and has no space mark."""
        n = self.count_piece(word if word[:1] == "\n" and self.line_breaks_apart else MARK + word)
        if len(word) <= LONGEST:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[word] = n
        return n

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        if MARK in text:
            text = text.replace(MARK, " ")
        if text[0] == " " or "  " in text:
            marked = MARK + text.replace(" ", MARK)
            return sum(self.count_piece(s) for s in re.findall(f"{MARK}*[^{MARK}]+|{MARK}+", marked))
        if self.line_breaks_apart:
            if text[0] == "\n":  # the mark before it stands alone
                text = " " + text
                return sum(map(self._get, text.replace("\n", " \n").split(" ")[1:]))
            text = text.replace("\n", " \n")
        return sum(map(self._get, text.split(" ")))

    def _get(self, word: str) -> int:
        n = self.known.get(word)
        return self._word(word) if n is None else n


def counter(path: str) -> TokenCounter:
    if path not in _counters:
        _counters[path] = TokenCounter(path)
    return _counters[path]


def _count(model: str | None, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(model or default_model())
        for batch in batches:
            n = [count(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_bytes"), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["id", "n_bytes", "n_tokens", "over_limit"])

    return run


def count_tokens(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, limit: int = LIMIT) -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_tokens, over_limit (n_tokens > limit)."""
    ship_package(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    return rows.mapInArrow(_count(model, limit), "id long, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)
