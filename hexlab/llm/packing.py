"""Vector bin packing of token sequences: tokens, segments and loss-bearing tokens are limited at once.

Each task packs the documents of its own partition, so packing needs no shuffle and no global state. A bounded
pool of pieces is kept; into the open sequence goes the piece with the largest dot product of its needs and
the room left (both as shares of the limits) among those that fit. If none fits, the best one is cut to the
room that is left. What cannot fill a sequence at the end of a partition is cut into sequences whose lengths
are powers of two, which need no padding.

Defined cases: a null text counts as empty and holds the end id alone; repeated rows are packed each; a text
of any length is cut over as many sequences as it takes; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import os
import re
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_letters
from .common import small_batches, spread
from .memo import Memo

#: Pieces that a task holds to choose from.
POOL = 384
#: Marks that may stand behind a word as one piece; white space for Python's split that the pattern of this tokenizer keeps; and all other white space of Unicode.
MARKS = ".,;:!?#$%&*|-"
KEPT = "\x1c\x1d\x1e\x1f"
BLANK = re.compile("[\t-\r \x85\xa0  -     　]+")

Piece = tuple[object, int, int, int, int]  # document, start, length, sequence, offset


class Packer:
    """Packs documents given one after the other; ``add`` and ``finish`` return finished pieces."""

    def __init__(self, tokens: int = 4096, segments: int = 256, loss: int = 4096, first: int = 0):
        self.most = np.array([tokens, segments, loss], dtype=float)
        self.tokens, self.sequence = tokens, first
        self.keys: list = [None] * POOL
        self.start, self.end, self.masked = (np.zeros(POOL, dtype=np.int64) for _ in range(3))
        self.full = 0

    def add(self, key, n: int, masked: int = 0) -> list[Piece]:
        """A document of n tokens, of which the first ``masked`` bear no loss."""
        out, at = [], 0
        while n - at >= self.tokens and self._loss(at, at + self.tokens, masked) <= self.most[2]:
            out.append((key, at, self.tokens, self.sequence, 0))
            self.sequence += 1
            at += self.tokens
        if at == n:
            return out
        while self.full == POOL:
            out += self._fill()
        k = self.full
        self.keys[k], self.start[k], self.end[k], self.masked[k] = key, at, n, masked
        self.full += 1
        return out

    def finish(self) -> list[Piece]:
        out = []
        while self.full:
            out += self._fill()
        return out

    @staticmethod
    def _loss(start, end, masked):
        return np.maximum(0, end - np.maximum(start, masked))

    def _fill(self) -> list[Piece]:
        """One sequence from the pool."""
        room, placed = self.most.copy(), []
        while self.full and room[0] >= 1 and room[1] >= 1:
            s, e, m = self.start[: self.full], self.end[: self.full], self.masked[: self.full]
            need = e - s
            loss = self._loss(s, e, m)
            weight = room / self.most**2
            worth = need * weight[0] + weight[1] + loss * weight[2]
            fits = (need <= room[0]) & (loss <= room[2])
            if room[1] < 2:
                fits &= need == room[0]  # the last segment has to fill what is left
            if fits.any():
                k = int(np.argmax(np.where(fits, worth, -1.0)))
                take = int(need[k])
            else:
                reach = np.minimum(need, np.minimum(room[0], np.maximum(0, m - s) + room[2])).astype(np.int64)
                k = int(np.argmax(reach))
                take = int(reach[k])
                if take < 1:
                    break
            placed.append((self.keys[k], int(s[k]), take))
            room -= (take, 1, self._loss(s[k], s[k] + take, m[k]))
            self.start[k] += take
            if self.start[k] == self.end[k]:
                self._drop(k)
        return self._emit(placed)

    def _drop(self, k: int) -> None:
        self.full -= 1
        z = self.full
        self.keys[k], self.start[k], self.end[k], self.masked[k] = self.keys[z], self.start[z], self.end[z], self.masked[z]
        self.keys[z] = None

    def _emit(self, placed: list) -> list[Piece]:
        """The pieces as one sequence if it is full, else as sequences of the powers of two that add up to it."""
        total = sum(p[2] for p in placed)
        sizes = [self.tokens] if total == self.tokens else [1 << b for b in range(total.bit_length() - 1, -1, -1) if total >> b & 1]
        out, room, offset = [], 0, 0
        left = iter(sizes)
        for key, start, length in placed:
            while length:
                if not room:
                    room, offset = next(left), 0
                    self.sequence += 1
                take = min(room, length)
                out.append((key, start, take, self.sequence - 1, offset))
                start, length, room, offset = start + take, length - take, room - take, offset + take
        return out


@functools.lru_cache(maxsize=2)
def tokenizer(spec: str, end: int) -> Callable[[str], bytes]:
    """Ids of a text and the end id. What lies between white space is encoded once and kept, for this tokenizer
    drops white space and never looks across it; texts with special tokens go through it whole. Latin words
    (with marks behind) go straight to its model, for their normal form and their split are known."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(spec)
    t.no_truncation()
    t.no_padding()
    special = [a.content for a in t.get_added_tokens_decoder().values()]
    model, letters = t.model, byte_letters()
    packed = lambda ids: struct.pack(f"<{len(ids)}I", *ids)

    def whole(text: str) -> bytes:
        return packed(t.encode(text, add_special_tokens=False).ids)

    tails: dict[str, list[int]] = {"": []}

    def word(text: str) -> bytes:
        run = text.rstrip(MARKS)
        if run and not (run.isalpha() and (run.isascii() or max(run) <= "ÿ")):
            return whole(text)
        tail = text[len(run) :]
        if tail not in tails:
            if len(tail) > 3:
                return whole(text)
            tails[tail] = [x.id for x in model.tokenize(tail)]
        if not run:
            return packed(tails[tail])
        low = run.lower()
        if not low.isascii():
            low = "".join(map(letters.__getitem__, low.encode()))
        ids = [x.id for x in model.tokenize(low)]
        return packed(ids + tails[tail])

    memo = Memo(word, limit=500_000)
    last = packed([end])

    def ids(text: str) -> bytes:
        if any(s in text for s in special):
            return whole(text) + last
        memo.trim()
        apart = filter(None, BLANK.split(text)) if any(c in text for c in KEPT) else text.split()
        return b"".join(map(memo.__getitem__, apart)) + last

    ids.forget = memo.clear
    return ids


def pack(docs: DataFrame, vocabulary: str, end: int = 2, tokens: int = 4096, segments: int = 256, loss: int = 4096, masked: str | None = None, prompt: str | None = None) -> DataFrame:
    """Pieces (doc_id, start, length, ids, doc_tokens, sequence_id, offset) of all documents.

    ``vocabulary`` is the path of the tokenizer on the driver, broadcast as text (bounded, whatever the data).
    ``masked`` names a column with the number of leading tokens that bear no loss (instructions); by default
    all tokens bear loss. ``prompt`` names a column with a text that goes before the document's own, apart from it by a
    line feed; its tokens bear no loss either. ``sequence_id`` is the number of the partition times 2**33 plus a count.
    """
    with open(vocabulary, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = tokenizer(spec.value, end)
        packer = Packer(tokens, segments, loss, TaskContext.get().partitionId() << 33)
        held: dict[int, list] = {}  # documents with pieces in the pool: doc_id, ids, tokens yet to come out

        def rows(pieces: list[Piece]) -> pd.DataFrame:
            out = []
            for key, start, length, sequence, offset in pieces:
                doc_id, ids, n, left = held[key]
                held[key][3] = left - length
                if left == length:
                    del held[key]
                out.append((doc_id, start, length, ids[4 * start : 4 * (start + length)], n, sequence, offset))
            return pd.DataFrame(out, columns=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]).astype({"doc_id": "Int64"})

        count = 0
        for x in batches:
            pieces = []
            for doc_id, head, text, skip in zip(x["doc_id"].astype("Int64"), x["prompt"], x["text"], x["masked"], strict=True):
                ids = encode(text or "")
                if head:
                    before = encode(head)[:-4]  # without the end
                    ids, skip = before + ids, len(before) // 4
                n = len(ids) // 4
                held[count] = [doc_id, ids, n, n]
                pieces += packer.add(count, n, int(skip))
                count += 1
            yield rows(pieces)
        yield rows(packer.finish())
        encode.forget()  # the worker lives on, and other stages need its memory

    small_batches(docs.sparkSession)
    skip = F.coalesce(F.col(masked).cast("long"), F.lit(0)) if masked else F.lit(0).cast("long")
    head = F.col(prompt) if prompt else F.lit(None).cast("string")
    return spread(docs.select(F.col("doc_id").cast("long"), head.alias("prompt"), "text", skip.alias("masked"))).mapInPandas(
        run, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    )
