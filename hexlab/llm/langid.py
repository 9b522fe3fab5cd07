"""Language identification: a bidirectional gated recurrent network over bytes, trained in numpy.

The network reads the bytes of a document in both directions, across words, and gives every position a distribution
over the languages; a document's is the mean over its positions. So that documents of any length are read side
by side, a text is cut into windows of ``CORE`` bytes; each is read with the ``WARM`` bytes before and
behind it, whose positions only bring the states up to date and do not count.

It is trained by backpropagation through time on the driver, on windows of ``TRAIN_BYTES`` bytes: at most
``TRAIN_WINDOWS``, from all over the text, of each of at most ``TRAIN_ROWS`` labelled rows (a bounded sample, the rows
of the smallest hashes of doc_id); prediction covers every whole text.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; repeated rows are predicted
each; without any labelled row everything is ``und``; an empty table gives an empty result; other columns
are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, spread

#: Labelled rows that training takes at most, windows of each of them, and the bytes of such a window.
TRAIN_ROWS, TRAIN_WINDOWS, TRAIN_BYTES = 2000, 8, 64
#: Bytes of a window that count, and those that are read before and behind them.
CORE, WARM = 480, 32
#: Windows that are read side by side.
TOGETHER = 2048
UNKNOWN = "und"
#: Standard deviations by which the bytes of a text may be less usual than its language's.
FAR = 5.0
#: Bytes of a text that are held to one language where the whole is not in its own.
STRETCH = 512
#: ASCII letters in lower case, other ASCII bytes as spaces: numbers, keys and addresses say nothing of a language.
WORDS_ONLY = bytes(b if b >= 128 else b | 32 if chr(b).isalpha() else 32 for b in range(256))


def windows(raw: bytes) -> list[tuple[bytes, int, int]]:
    """The windows of a text: what is read, and from where to where its positions count."""
    out = []
    for at in range(0, len(raw), CORE):
        low, end = max(0, at - WARM), min(len(raw), at + CORE)
        out.append((raw[low : end + WARM], at - low, end - low))
    return out


def as_matrix(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the texts, zeros behind; and their lengths."""
    length = np.array([len(w) for w in texts])
    x = np.zeros((len(texts), int(length.max(initial=1))), dtype=np.uint8)
    x[np.arange(x.shape[1])[None, :] < length[:, None]] = np.frombuffer(b"".join(texts), dtype=np.uint8)
    return x, length


def _sigmoid(v: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * v)


class Gru:
    """Byte embedding folded into the gates' input table, one layer each way, softmax over both states."""

    def __init__(self, languages: list[str], hidden: int = 8, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages, self.hidden = languages, hidden
        h, k = hidden, len(languages)
        self.p = {}
        for way in "fb":
            self.p["in" + way] = rng.normal(0, 0.3, (256, 3 * h)).astype(np.float32)
            self.p["zr" + way] = rng.normal(0, 1 / np.sqrt(h), (h, 2 * h)).astype(np.float32)
            self.p["c" + way] = rng.normal(0, 1 / np.sqrt(h), (h, h)).astype(np.float32)
        self.p["out"] = rng.normal(0, 0.3, (2 * h, k)).astype(np.float32)
        self.p["bias"] = np.zeros(k, dtype=np.float32)

    def _read(self, way: str, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States after every column of x (rows are segments)."""
        h = self.hidden
        table, zr, c = self.p["in" + way], self.p["zr" + way], self.p["c" + way]
        s = np.zeros((len(x), h), dtype=np.float32)
        states = np.empty((x.shape[1], len(x), h), dtype=np.float32)
        for t in range(x.shape[1]):
            a = table[x[:, t]]
            gates = _sigmoid(a[:, : 2 * h] + s @ zr)
            z, r = gates[:, :h], gates[:, h:]
            n = np.tanh(a[:, 2 * h :] + (r * s) @ c)
            if keep is not None:
                keep.append((x[:, t], s, z, r, n))
            s = n + z * (s - n)
            states[t] = s
        return states

    @staticmethod
    def _turned(x: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Each row back to front within its length."""
        at = length[:, None] - 1 - np.arange(x.shape[1])[None, :]
        return np.where(at >= 0, np.take_along_axis(x, np.maximum(at, 0), axis=1), 0)

    def _both(self, x: np.ndarray, length: np.ndarray, keep: tuple | None = None) -> np.ndarray:
        """Both states at every position: columns, rows, 2 * hidden."""
        there = self._read("f", x, keep[0] if keep else None)
        back = self._read("b", self._turned(x, length), keep[1] if keep else None)
        at = np.maximum(length[None, :] - 1 - np.arange(x.shape[1])[:, None], 0)
        return np.concatenate([there, np.take_along_axis(back, at[:, :, None], axis=0)], axis=2)

    def _steps(self, way: str, x: np.ndarray) -> Iterator[np.ndarray]:
        """The states after each column of x, one at a time; states are columns here, which numpy runs through faster."""
        h = self.hidden
        half = np.concatenate([np.full(2 * h, 0.5, np.float32), np.ones(h, np.float32)])  # a sigmoid is a tanh of half the argument
        table = np.ascontiguousarray((self.p["in" + way] * half).T)
        zr, c = np.ascontiguousarray(self.p["zr" + way].T) * np.float32(0.5), np.ascontiguousarray(self.p["c" + way].T)
        s, a, gates = np.zeros((h, len(x)), dtype=np.float32), np.empty((3 * h, len(x)), dtype=np.float32), np.empty((2 * h, len(x)), dtype=np.float32)
        for column in np.ascontiguousarray(x.T).astype(np.intp):
            np.take(table, column, axis=1, out=a, mode="clip")
            np.matmul(zr, s, out=gates)
            gates += a[: 2 * h]
            np.tanh(gates, out=gates)
            gates *= 0.5
            gates += 0.5
            n = c @ (gates[h:] * s)
            n += a[2 * h :]
            np.tanh(n, out=n)
            s -= n
            s *= gates[:h]
            s += n
            yield s

    def pooled(self, parts: list[tuple[bytes, int, int]]) -> np.ndarray:
        """Sums of the probabilities at the positions that count, of each window; by length, so little padding is read."""
        h, k = self.hidden, len(self.languages)
        out = np.zeros((len(parts), k), dtype=np.float32)
        head, tail = np.ascontiguousarray(self.p["out"][:h].T), np.ascontiguousarray(self.p["out"][h:].T)
        order = np.argsort([len(p[0]) for p in parts], kind="stable")
        for i in range(0, len(order), TOGETHER):
            part = order[i : i + TOGETHER]
            x, length = as_matrix([parts[j][0] for j in part])
            low, high = (np.array([parts[j][m] for j in part]) for m in (1, 2))
            there = np.empty((x.shape[1], k, len(part)), dtype=np.float32)
            for t, s in enumerate(self._steps("f", x)):
                np.matmul(head, s, out=there[t])
            rows, sums = np.arange(len(part)), np.zeros((k, len(part)), dtype=np.float32)
            even = bool((length == length[0]).all())
            for t, s in enumerate(self._steps("b", self._turned(x, length))):
                at = length - 1 - t
                v = tail @ s
                v += there[at[0]] if even else there[np.maximum(at, 0), :, rows].T
                v += self.p["bias"][:, None]
                v -= v.max(axis=0)
                np.exp(v, out=v)
                v *= ((low <= at) & (at < high)) / v.sum(axis=0)
                sums += v
            out[part] = sums.T
        return out

    def gradients(self, x: np.ndarray, length: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, dict]:
        """Mean loss over positions and its gradients, by backpropagation through time."""
        keep: tuple = ([], [])
        state = self._both(x, length, keep)
        v = state @ self.p["out"] + self.p["bias"]
        e = np.exp(v - v.max(axis=2, keepdims=True))
        p = e / e.sum(axis=2, keepdims=True)
        inside = (np.arange(x.shape[1])[:, None] < length[None, :]) * weight[None, :]
        total = inside.sum()
        truth = np.eye(len(self.languages), dtype=np.float32)[label]
        loss = float(-(np.log(np.maximum((p * truth[None]).sum(axis=2), 1e-9)) * inside).sum() / total)
        d = ((p - truth[None]) * inside[:, :, None] / total).astype(np.float32)
        g = {"out": np.tensordot(state, d, axes=([0, 1], [0, 1])), "bias": d.sum(axis=(0, 1))}
        ds = d @ self.p["out"].T
        h = self.hidden
        back = np.zeros_like(ds[:, :, h:])
        at = length[None, :] - 1 - np.arange(x.shape[1])[:, None]
        ok = at >= 0
        rows = np.broadcast_to(np.arange(len(x))[None, :], at.shape)
        back[at[ok], rows[ok]] = ds[:, :, h:][ok]
        for way, d_states, steps in (("f", ds[:, :, :h], keep[0]), ("b", back, keep[1])):
            zr, c = self.p["zr" + way], self.p["c" + way]
            g_in, g_zr, g_c = np.zeros_like(self.p["in" + way]), np.zeros_like(zr), np.zeros_like(c)
            carry = np.zeros((len(x), h), dtype=np.float32)
            for t in range(x.shape[1] - 1, -1, -1):
                letters, s, z, r, n = steps[t]
                after = carry + d_states[t]
                d_n = after * (1 - z) * (1 - n * n)
                d_z = after * (s - n) * z * (1 - z)
                d_rs = d_n @ c.T
                d_r = d_rs * s * r * (1 - r)
                d_gates = np.concatenate([d_z, d_r], axis=1)
                carry = after * z + d_rs * r + d_gates @ zr.T
                g_c += (r * s).T @ d_n
                g_zr += s.T @ d_gates
                np.add.at(g_in, letters, np.concatenate([d_gates, d_n], axis=1))
            g |= {"in" + way: g_in, "zr" + way: g_zr, "c" + way: g_c}
        return loss, g

    def fit(self, words: list[bytes], label: np.ndarray, weight: np.ndarray, steps: int = 250, batch: int = 256, rate: float = 0.01, seed: int = 11) -> Gru:
        """Adam on random batches of windows, drawn in proportion to their weight."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        share = weight / weight.sum()
        for step in range(1, steps + 1):
            pick = rng.choice(len(words), size=min(batch, len(words)), p=share)
            x, length = as_matrix([words[k] for k in pick])
            _, g = self.gradients(x, length, label[pick], np.ones(len(pick), dtype=np.float32))
            now = rate * min(1.0, 2 * (1 - (step - 1) / steps))
            for k, v in g.items():
                first[k] = 0.9 * first[k] + 0.1 * v
                second[k] = 0.99 * second[k] + 0.01 * v * v
                self.p[k] -= now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
        return self


def held_out() -> F.Column:
    """Documents that training never sees: crc32(doc_id as text) mod 4 is 2; false for a null doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sampled(docs: DataFrame, rows: int = TRAIN_ROWS) -> list[tuple[str, list[bytes]]]:
    """(lang, windows) of the rows that training takes."""
    open_ = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    # the numbers first: a sort with a limit sends as many rows from every task to the driver
    picked = [r[0] for r in open_.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).collect()]

    def pieces(texts: pd.Series) -> pd.Series:
        """Windows at even distances over the whole text."""
        out = []
        for t in texts:
            raw = t.encode("utf-8", "surrogatepass")
            n = min(TRAIN_WINDOWS, -(-len(raw) // TRAIN_BYTES))
            last = max(0, len(raw) - TRAIN_BYTES)
            out.append([raw[at : at + TRAIN_BYTES] for at in (last * k // max(1, n - 1) for k in range(n))])
        return pd.Series(out)

    sample = open_.where(F.col("doc_id").isin(picked)).select("doc_id", "lang", F.pandas_udf(pieces, "array<binary>")("text").alias("pieces")).distinct().collect()
    return [(r["lang"], [bytes(w) for w in r["pieces"] if len(w)]) for r in sorted(sample, key=lambda r: (r["doc_id"], r["lang"], r["pieces"]))]


def train(docs: DataFrame, rows: int = TRAIN_ROWS, **fit) -> Gru | None:
    """A network for the languages of ``docs``; None if no row may be learned from."""
    return learned(sampled(docs, rows), **fit)


def learned(sample: list[tuple[str, list[bytes]]], **fit) -> Gru | None:
    found = [(w, lang, 1 / len(pieces)) for lang, pieces in sample for w in pieces]
    if not found:
        return None
    languages = sorted({lang for _, lang, _ in found})
    label = np.array([languages.index(lang) for _, lang, _ in found])
    weight = np.array([w for _, _, w in found])  # every document weighs the same
    weight /= np.bincount(label, weights=weight)[label]  # and every language
    return Gru(languages).fit([w for w, _, _ in found], label, weight, **fit)


class Habits:
    """How usual the bytes of a text are in each language, which the network, sure of one of its languages whatever it
    reads, cannot say: the mean log-probability of a byte after the two before it, as a distance from that of the
    sample's documents of the language.

    Counts of half of the documents are held against the other half to find that mean, its spread over documents and
    that over bytes, so the distance allows for short texts.
    """

    BITS = 18
    #: Weight of the shorter context where the longer one was seen little.
    BACK = 2.0

    def __init__(self, sample: list[tuple[str, list[bytes]]]):
        self.tables, self.usual = {}, {}
        for lang in sorted({lang for lang, _ in sample}):
            texts = [pieces for g, pieces in sample if g == lang and pieces]
            halves = [self._table(texts[k::2]) for k in (0, 1)]
            found = [np.concatenate([self._logs(halves[1 - k], w) for w in pieces]) for k in (0, 1) for pieces in texts[k::2]]
            found = [f for f in found if len(f)]
            if len(found) < 10:  # too few to say what is usual
                continue
            means = np.array([f.mean() for f in found])
            byte = float(np.mean([f.var() for f in found]))
            spread_ = max(float(means.var() - byte * np.mean([1 / len(f) for f in found])), 1e-4)
            self.tables[lang], self.usual[lang] = self._table(texts), (float(means.mean()), spread_, byte)

    @classmethod
    def _slots(cls, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        b = np.frombuffer(b" ".join(raw.translate(WORDS_ONLY).split()), dtype=np.uint8).astype(np.int64)
        two = b[:-1] << 8 | b[1:]
        three = ((two[:-1] << 8 | b[2:]) * 2654435761 & 0xFFFFFFFF) >> (32 - cls.BITS)
        return b, two, three

    @classmethod
    def _table(cls, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Logarithms: of a byte after two (0 where it was not seen), of falling back from two, of a byte after one."""
        one, two, three = np.zeros(256), np.zeros(1 << 16), np.zeros(1 << cls.BITS)
        seen = {}
        for pieces in texts:
            for w in pieces:
                b, t, h = cls._slots(w)
                np.add.at(one, b, 1)
                np.add.at(two, t, 1)
                np.add.at(three, h, 1)
                seen |= dict(zip(h.tolist(), zip(t[:-1].tolist(), t[1:].tolist(), strict=True), strict=True))
        after = np.log((two + cls.BACK / 256) / (np.repeat(one, 256) + cls.BACK))
        back = np.log(cls.BACK / (two + cls.BACK))
        logs = np.zeros(1 << cls.BITS)
        if seen:
            h = np.fromiter(seen, np.int64)
            ab, bc = np.array(list(seen.values())).T
            logs[h] = np.log((three[h] + cls.BACK * np.exp(after[bc])) / (np.maximum(two[ab], three[h]) + cls.BACK))
        return logs.astype(np.float32), back.astype(np.float32), after.astype(np.float32)

    @classmethod
    def _logs(cls, table: tuple[np.ndarray, np.ndarray, np.ndarray], raw: bytes) -> np.ndarray:
        logs, back, after = table
        _, two, three = cls._slots(raw)
        p = logs[three]
        return np.where(p != 0, p, back[two[:-1]] + after[two[1:]])

    def distance(self, lang: str, text: str) -> float:
        """Standard deviations below (less than 0) or above what is usual; 0 for a language without a habit."""
        if lang not in self.usual:
            return 0.0
        raw, total, n = text.encode("utf-8", "surrogatepass"), 0.0, 0
        for at in range(0, len(raw), 1 << 20):  # in pieces, so that memory stays bounded
            p = self._logs(self.tables[lang], raw[max(0, at - 2) : at + (1 << 20)])
            total, n = total + float(p.sum()), n + len(p)
        mean, over_documents, over_bytes = self.usual[lang]
        return (total / n - mean) / (over_documents + over_bytes / n) ** 0.5 if n else 0.0

    def strange(self, lang: str, text: str, far: float) -> bool:
        """Whether the text is ``far`` below what is usual in its language, and in the best language of each of its
        stretches of ``STRETCH`` bytes: a document may quote another known language."""
        if self.distance(lang, text) >= -far:
            return False
        raw, below, variance, n = text.encode("utf-8", "surrogatepass"), 0.0, 0.0, 0
        for at in range(0, len(raw), STRETCH):
            found = []
            for name, (mean, over_documents, over_bytes) in self.usual.items():
                p = self._logs(self.tables[name], raw[max(0, at - 2) : at + STRETCH])
                if len(p):
                    found.append((float(p.mean() - mean) / (over_documents + over_bytes / len(p)) ** 0.5, float(p.sum() - mean * len(p)), over_documents, over_bytes, len(p)))
            if found:
                _, off, over_documents, over_bytes, k = max(found)
                below, variance, n = below + off, variance + over_documents * k + over_bytes, n + k
        return n > 0 and below / n < -far * (variance / n) ** 0.5


class Labeller:
    """Labels whole texts."""

    def __init__(self, net: Gru | None):
        self.net = net

    def __call__(self, texts: list) -> tuple[list[str], list[float]]:
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if self.net is None:
            return names, scores
        known = [i for i, t in enumerate(texts) if t is not None and any(map(str.isalpha, t))]
        step: list[int] = []
        for at, i in enumerate(known):
            step.append(i)
            if sum(len(texts[k]) for k in step) > CORE * TOGETHER or at == len(known) - 1:  # about one round of windows
                parts, of = [], []
                for k in step:
                    mine = windows(texts[k].encode("utf-8", "surrogatepass"))
                    parts += mine
                    of += [k] * len(mine)
                pooled = pd.DataFrame(self.net.pooled(parts).astype(np.float64)).groupby(np.array(of)).sum()
                for k, p in zip(pooled.index, pooled.to_numpy(), strict=True):
                    names[k], scores[k] = self.net.languages[int(p.argmax())], float(min(1.0, p.max() / p.sum()))
                step = []
        return names, scores


def predict(docs: DataFrame, model: Gru | None) -> DataFrame:
    """(doc_id, lang_pred, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some 30 thousand numbers, whatever the data

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        label = Labeller(shared.value)
        for x in batches:
            names, scores = label(x["text"].tolist())
            yield pd.DataFrame({"doc_id": x["doc_id"].astype("Int64"), "lang_pred": names, "score": scores})

    small_batches(docs.sparkSession)
    return spread(docs.select(F.col("doc_id").cast("long"), "text")).mapInPandas(run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document."""
    return predict(docs, train(docs, rows)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, least: float = 1.2, far: float = FAR) -> DataFrame:
    """The documents whose language is found: texts that are null or have no letter go, those whose best
    language has a score under ``least`` times chance (one over the number of languages), and those whose bytes are
    ``far`` standard deviations less usual in that language than those of its documents (``Habits``): other
    languages and random letters. Without a labelled row every text with a letter stays. The column ``lang`` is left
    as it is."""
    sample = sampled(docs)
    shared = docs.sparkSession.sparkContext.broadcast((learned(sample), Habits(sample)))

    def found(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        net, habits = shared.value
        label = Labeller(net)
        for t in texts:
            if net is None:
                yield t.map(lambda x: x is not None and any(map(str.isalpha, x))).astype(bool)
            else:
                bar = min(1.0, least / len(net.languages))
                names, scores = label(t.tolist())
                yield pd.Series([n != UNKNOWN and s >= bar and not habits.strange(n, x, far) for n, s, x in zip(names, scores, t, strict=True)], dtype=bool)

    small_batches(docs.sparkSession)
    return spread(docs).where(F.pandas_udf(found, "boolean")("text"))
