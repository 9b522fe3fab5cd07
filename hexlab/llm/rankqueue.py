"""Byte-level BPE encoding by ranks through a queue of merges, and decoding.

The parts of the pieces form a linked list. Every pair of neighbours that is a token waits in the bucket of the
token's rank; a two-level bitmap tells which buckets hold something, so the next rank is found by two
find-first-set steps, and the positions of its bucket are merged from the left. A merge changes two pairs at most; should
one of them be of a lower rank, that one comes next. Old entries stay in the buckets and are skipped when they come
up, as the pair at that position is no longer of that rank. n bytes take at most 3 n entries, so a pre-token of a
megabyte is no special case; and as pieces do not touch each other, one list and one queue serve many of them at once.

Defined cases: a null text counts as empty and has no ids; a piece that is a token as a whole is that token
without any merge, as the ranks' library does; texts of any length are encoded whole; rows repeated or with null
ids are rows of their own.
"""

from __future__ import annotations

import base64
import functools
import itertools
import struct
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import PARTS, PIECES
from .common import small_batches, spread

#: Bits of a word of the bitmaps: 512 x 512 ranks are more than any vocabulary here has.
WORD = 9
LOW = (1 << WORD) - 1
#: Characters whose parts are looked at together, and different parts that a worker remembers.
AT_ONCE, KNOWN = 2_000_000, 1_000_000
#: Parts pieces from each other in the list: UTF-8 has no such byte, and no token but its own holds it.
EDGE = b"\xff"


class RankBpe:
    def __init__(self, ranks: dict[bytes, int]):
        if any(EDGE in t for t in ranks if len(t) > 1):
            raise ValueError("tokens with the byte 0xFF have no place here")
        self.ranks, self.table = ranks, {i: t for t, i in ranks.items()}
        self.pairs = np.full(1 << 16, -1, dtype=np.int64)  # ranks of all tokens of two bytes
        for t, i in ranks.items():
            if len(t) == 2:
                self.pairs[t[0] << 8 | t[1]] = i
        most = max(self.table) + 1
        if most > 1 << 2 * WORD:
            raise ValueError(f"{most} ranks are more than {1 << 2 * WORD}")
        self.buckets: list[list[int] | None] = [None] * most
        self.words = [0] * ((most >> WORD) + 1)
        self.known: dict[str, bytes] = {}

    def merged(self, pieces: Sequence[bytes]) -> list[list[int]]:
        """Ids of each piece: merge the pair of lowest rank, the leftmost such, until none is left.

        ``top`` and ``words`` are the bitmap: a bit of ``top`` for each word that is not zero, a bit of a word for each
        bucket that holds something. All are empty again at the end.
        """
        raw = EDGE + EDGE.join(pieces) + EDGE
        n, find, words, buckets, top = len(raw), self.ranks.get, self.words, self.buckets, 0
        after, before = list(range(1, n + 2)), list(range(-1, n))
        b = np.frombuffer(raw, dtype=np.uint8).astype(np.int64)
        ranks = np.append(self.pairs[b[:-1] << 8 | b[1:]], -1)
        pair = ranks.tolist()  # rank of the part that begins here together with the next one
        order = np.argsort(ranks, kind="stable")
        order = order[np.searchsorted(ranks[order], 0) :]
        found, starts = np.unique(ranks[order], return_index=True)
        for rank, positions in zip(found.tolist(), np.split(order, starts[1:]) if len(order) else [], strict=True):
            buckets[rank] = positions.tolist()
            words[rank >> WORD] |= 1 << (rank & LOW)
            top |= 1 << (rank >> WORD)
        while top:
            w = (top & -top).bit_length() - 1
            word = words[w]
            rank = w << WORD | (word & -word).bit_length() - 1
            words[w] = word & (word - 1)
            if not words[w]:
                top &= top - 1
            bucket, buckets[rank] = buckets[rank], None
            bucket.sort()  # from the left
            for done, at in enumerate(bucket, 1):
                if pair[at] != rank:
                    continue  # stale
                gone = after[at]
                end = after[at] = after[gone]
                left = before[at]
                before[end], pair[gone], lower = at, -1, False
                for k, r in ((left, find(raw[left:end], -1)), (at, find(raw[at : after[end]], -1))):  # the two pairs of the new part
                    pair[k] = r
                    if r >= 0:
                        lower |= r < rank
                        if buckets[r]:
                            buckets[r].append(k)
                        else:
                            buckets[r] = [k]
                            words[r >> WORD] |= 1 << (r & LOW)
                            top |= 1 << (r >> WORD)
                if lower and done < len(bucket):  # the rest waits
                    buckets[rank] = bucket[done:]
                    words[rank >> WORD] |= 1 << (rank & LOW)
                    top |= 1 << (rank >> WORD)
                    break
        out, at = [], 0
        for p in pieces:
            at, ids = at + 1, []
            stop = at + len(p)
            while at < stop:
                ids.append(find(raw[at : after[at]]))
                at = after[at]
            out.append(ids)
        return out

    def _learn(self, parts: Iterable[str]) -> dict[str, bytes]:
        """Ids of the parts, as bytes."""
        split, waits = {}, {}
        for part in parts:
            if part.removeprefix(" ").isalpha() and not part.startswith("  "):  # one run of letters is one piece
                split[part] = (part.encode(),)
            else:
                split[part] = [p.encode("utf-8", "surrogatepass") for p in PIECES.findall(part)]
            for p in split[part]:
                if p not in self.ranks:  # a whole token needs no merge
                    waits[p] = None
        for p, ids in zip(waits, self.merged(list(waits)), strict=True):
            waits[p] = struct.pack(f"<{len(ids)}I", *ids)
        return {part: b"".join([waits[p] if p in waits else struct.pack("<I", self.ranks[p]) for p in pieces]) for part, pieces in split.items()}

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit numbers."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: Sequence[str]) -> list[bytes]:
        """The same for many: parts that are not known yet go through the queue together, AT_ONCE characters at a time."""
        out, at = [], 0
        while at < len(texts):
            end, chars = at + 1, len(texts[at])
            while end < len(texts) and chars + len(texts[end]) <= AT_ONCE:
                chars += len(texts[end])
                end += 1
            if chars <= AT_ONCE:
                parts = [PARTS.findall(t) for t in texts[at:end]]
                self._know(itertools.chain.from_iterable(parts))
                out += [b"".join(map(self.known.__getitem__, p)) for p in parts]
            else:  # one long text, some parts at a time
                found, ids = (m.group() for m in PARTS.finditer(texts[at])), []
                while some := list(itertools.islice(found, AT_ONCE // 8)):
                    self._know(some)
                    ids.append(b"".join(map(self.known.__getitem__, some)))
                out.append(b"".join(ids))
            at = end
        return out

    def _know(self, parts: Iterable[str]) -> None:
        if len(self.known) > KNOWN:
            self.known.clear()
        new = set(parts).difference(self.known)
        if new:
            self.known |= self._learn(new)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.table.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


@functools.lru_cache(maxsize=2)
def load(lines: bytes) -> RankBpe:
    """From lines of a token in base 64 and its rank."""
    return RankBpe({base64.b64decode(t): int(i) for t, i in map(bytes.split, lines.splitlines())})


def encode_decode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, ids, decoded) of every row: ids as little-endian unsigned 32-bit numbers in one binary value,
    decoded as bytes.

    ``vocabulary`` is the path of a file of ranks on the driver; its text is broadcast, a bounded size that
    does not depend on the data.
    """
    with open(vocabulary, "rb") as f:
        lines = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = load(lines.value)
        for x in batches:
            ids = bpe.encode_all([t or "" for t in x["text"]])
            yield pd.DataFrame({"doc_id": x["doc_id"], "ids": ids, "decoded": [bpe.decode(i) for i in ids]})

    small_batches(docs.sparkSession)
    return spread(docs.select(F.col("doc_id").cast("long"), "text")).mapInPandas(run, "doc_id long, ids binary, decoded binary")
