"""Byte-level BPE encoding by dynamic programming over prefixes, and decoding.

The encoding of a piece has a unique last token for every prefix of the piece. A token that is a suffix of
the prefix (an Aho-Corasick automaton over the vocabulary lists them) is that last token if the token before
it, the last one of the shorter prefix, keeps its border with it: the pair, merged on its own, must give the
pair again. Following the last tokens back from the end gives exactly the ids that merging by rank gives.

Defined cases: a null text counts as empty and has no ids; special tokens in the text are found before
anything else, as the library does; very long texts are encoded whole, piece by piece.
"""

from __future__ import annotations

import functools
import json
import re
import struct
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, spread
from .memo import Memo

# The white space of Unicode, and the pattern that byte-level BPE splits a text by.
SPACE = "\t-\r \x85\xa0  -     　"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"

#: Cuts a text at white space just where PATTERN does, so that each part can be split and stored on its own.
PARTS = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
PIECES = regex.compile(PATTERN)


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: its own where Latin-1 prints it, else from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class Bpe:
    def __init__(self, spec: dict):
        letters = byte_letters()
        code = {c: b for b, c in enumerate(letters)}
        self.table = {i: bytes(code[c] for c in t) for t, i in spec["model"]["vocab"].items()}
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.table |= {i: t.encode() for t, i in self.special.items()}
        vocab = spec["model"]["vocab"]
        self.of_byte = [vocab[c] for c in letters]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        special = sorted(self.special, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.automaton = ahocorasick.Automaton()
        for i in vocab.values():
            raw = self.table[i]
            if self.merged(raw) == [i]:  # others never stand in an encoding
                self.automaton.add_word(raw.decode("latin-1"), (len(raw), i))
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.parts = Memo(self._part, limit=600_000)

    def merged(self, raw: bytes) -> list[int]:
        """By the definition: merge the pair of lowest rank, the first such, until none is left."""
        ids = [self.of_byte[b] for b in raw]
        while len(ids) > 1:
            found = [(*self.merges[p], k) for k, p in enumerate(zip(ids, ids[1:], strict=False)) if p in self.merges]
            if not found:
                break
            _, i, k = min(found, key=lambda f: (f[0], f[2]))
            ids[k : k + 2] = [i]
        return ids

    def compatible(self, a: int, b: int) -> bool:
        return self.merged(self.table[a] + self.table[b]) == [a, b]

    def piece(self, raw: bytes) -> list[int]:
        """Ids of one piece: the last token of every prefix, then back from the end.

        The automaton lists the matches by their ends, and those of one end from the longest on.
        """
        pairs, last, size, done = self.pairs, [0] * len(raw), [0] * len(raw), -1
        for end, (n, i) in self.automaton.iter(raw.decode("latin-1")):
            if end == done:
                continue
            before = end - n
            if before >= 0:
                key = last[before] << 32 | i
                fits = pairs.get(key)
                if fits is None:
                    fits = pairs[key] = self.compatible(last[before], i)
                if not fits:
                    continue
            last[end], size[end], done = i, n, end
        ids, at = [], len(raw) - 1
        while at >= 0:
            ids.append(last[at])
            at -= size[at]
        ids.reverse()
        return ids

    def _part(self, part: str) -> bytes:
        if part.removeprefix(" ").isalpha() and not part.startswith("  "):  # one run of letters is one piece
            ids = self.piece(part.encode())
        else:
            ids = [i for p in PIECES.findall(part) for i in self.piece(p.encode("utf-8", "surrogatepass"))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit numbers."""
        if not self.cut or not any(t in text for t in self.special):
            return b"".join(map(self.parts.__getitem__, PARTS.findall(text)))
        out = []
        for k, x in enumerate(self.cut.split(text)):
            out.append(np.array([self.special[x]], dtype="<u4").tobytes() if k % 2 else b"".join(map(self.parts.__getitem__, PARTS.findall(x))))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.table.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())).decode("utf-8", "replace")

    def trim(self) -> None:
        self.parts.trim()
        if len(self.pairs) > 1_000_000:
            self.pairs.clear()


@functools.lru_cache(maxsize=2)
def load(spec: str) -> Bpe:
    return Bpe(json.loads(spec))


def encode_decode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, ids, decoded) of every row: ids as little-endian unsigned 32-bit numbers in one binary value.

    ``vocabulary`` is the path of a byte-level BPE description on the driver; its text is broadcast, a
    bounded size that does not depend on the data.
    """
    with open(vocabulary, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = load(spec.value)
        for x in batches:
            ids = [bpe.encode(t or "") for t in x["text"]]
            yield pd.DataFrame({"doc_id": x["doc_id"], "ids": ids, "decoded": [bpe.decode(i) for i in ids]})
            bpe.trim()

    small_batches(docs.sparkSession)
    return spread(docs.select(F.col("doc_id").cast("long"), "text")).mapInPandas(run, "doc_id long, ids binary, decoded string")
