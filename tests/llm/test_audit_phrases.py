"""The rank queue, the filter audit and phrase collocations against plain computation."""

from __future__ import annotations

import itertools
import os
import random
import re
import subprocess
import sys
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

def test_queries_are_listed_without_a_session():
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) < set(q) and {f'op{n}_' for n in range(1, 14)} <= {k.split('_')[0] + '_' for k in q}"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), timeout=120)


DOCS = "doc_id long, text string, lang string, source string"


def test_rank_queue_gives_the_ids_of_the_library(spark, monkeypatch):
    import public_tokenizers as P
    import tiktoken

    from hexlab.llm import rankqueue

    path = P.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        bpe = rankqueue.load(f.read())
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    rng = random.Random(5)
    letters = "aaabbcdeé \n\t'sS.,0 1２あ한ß’\x1c\x85\xa0<|endoftext|>"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(300)]
    texts += ["", "x" * 30_001, "".join(rng.choice("abcdefgh") for _ in range(60_000)), "  \n\n  word", texts[3], None]
    rows = [(None if k == 7 else k, t, "id text", 1.5) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded double")
    monkeypatch.setattr(rankqueue, "AT_ONCE", 50)  # in this process; every text is then a long one
    assert bpe.encode_all([t or "" for t in texts]) == [np.array(enc.encode_ordinary(t or ""), dtype="<u4").tobytes() for t in texts]
    got = rankqueue.encode_decode(docs, path).collect()
    want = Counter((r[0], np.array(enc.encode_ordinary(r[1] or ""), dtype="<u4").tobytes(), (r[1] or "").encode()) for r in rows)
    assert Counter((r["doc_id"], bytes(r["ids"]), bytes(r["decoded"])) for r in got) == want
    assert rankqueue.encode_decode(docs.where("false"), path).count() == 0


def test_rank_queue_takes_the_lowest_rank_even_where_a_merge_opens_a_lower_one():
    from hexlab.llm.rankqueue import RankBpe

    ranks = {bytes([b]): 100 + b for b in range(256)}
    ranks |= {b"ab": 9, b"abc": 2, b"cd": 5, b"aa": 7, b"bca": 1, b"abca": 3}
    bpe = RankBpe(ranks)

    def plain(raw: bytes) -> list[int]:
        parts = [raw[k : k + 1] for k in range(len(raw))]
        while True:
            found = [(ranks[a + b], k) for k, (a, b) in enumerate(itertools.pairwise(parts)) if a + b in ranks]
            if not found:
                return [ranks[p] for p in parts]
            k = min(found)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    for n in range(1, 9):
        for raw in map(bytes, itertools.product(b"abcd", repeat=n) if n < 6 else (random.Random(n).choices(b"abcd", k=3 * n) for _ in range(300))):
            assert bpe.merged([raw]) == [plain(raw)]
    many = [bytes(random.Random(n).choices(b"abcd", k=n % 40)) for n in range(300)]
    assert bpe.merged(many) == [plain(raw) for raw in many] and bpe.merged([]) == []
    assert not any(bpe.words) and not any(bpe.buckets), "the queue is empty again"
    assert bpe.encode("abca") == np.array([3], "<u4").tobytes(), "a whole token needs no merge"


def _audit(docs: list[tuple], labels: list[tuple]) -> dict:
    first: dict[str, int] = {}
    for i, t, *_ in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    good, toxic = ({i for i, *v in labels if i is not None and v[k] == 1} for k in (0, 1))
    rows = []
    for i, t, lang, _ in docs:
        t = t or ""
        ws = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(ws) < 200, "B": 100 * len(set(ws)) < 50 * len(ws), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t))}
        fails["E"] = i is not None and i > first[t]
        rows.append((lang or "", {f for f, x in fails.items() if x}, i in good, i in toxic))
    out, shares = {}, Counter()
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                shares[part, f] += len(gone)
                all_ = [r for r in own if f in r[1]]
                out[part, "".join(order), step] = (len(left), len(gone), len(all_) - len(gone), sum(r[1] == {f} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone))
    return {k: (*v, shares[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_filter_audit_is_what_every_order_does(spark):
    from hexlab.llm.filters import filter_audit

    rng = random.Random(3)
    words = ["ab", "Cd", "EF", "gh#", "élan", "x|y", "n", " q"]
    docs = []
    for k in range(120):
        n = rng.choice([0, 3, 150, 250])
        pool = words[: rng.randint(2, 8)] if rng.random() < 0.5 else [f"w{j}" for j in range(300)]
        docs.append((k, rng.choice([" ", "\n", "\t ", "\x0b"]).join(rng.choice(pool) for _ in range(n)), rng.choice(["en", "de", None]), "s"))
    docs += [(200 + k, docs[k % 5][1], "en", "s") for k in range(40)]  # copies of few
    docs += [(None, docs[0][1], "en", "s"), (None, None, "fr", None), (3, docs[3][1], "en", "s"), (500, None, None, None), (501, "", "de", "s"), (7, "A" * 50_000, "de", "s")]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1])) for k in range(0, 250, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    frame = spark.createDataFrame(docs, DOCS).withColumns({c: F.lit(c) for c in ("rid", "part", "words", "before", "filter")})
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = filter_audit(frame, marks).collect()
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in rows}
    want = _audit(docs, labels)
    assert len(rows) == len(got) == len(want) == 600 * len({d[2] or "" for d in docs})
    assert got == want
    assert filter_audit(frame.where("false"), marks).count() == 0
    none = filter_audit(frame.where("doc_id = 60"), marks.where("false")).collect()
    assert len(none) == 600


def test_audit_takes_other_filters(spark):
    from hexlab.llm.filters import audit

    rows = spark.createDataFrame([(k, "p", k % 2 == 0, k % 3 == 0, k % 5 == 0) for k in range(60)], "rid long, part string, x boolean, y boolean, mine boolean")
    got = {(r["filter_order"], r["step"]): (r["kept"], r["removed"], r["odd_lost"]) for r in audit(rows.withColumnsRenamed({"x": "X", "y": "Y"}).withColumn("odd", F.col("mine").cast("int")), ["X", "Y"], {"odd": "odd_lost"}).collect()}
    assert got == {("XY", 1): (30, 30, 6), ("XY", 2): (20, 10, 2), ("YX", 1): (40, 20, 4), ("YX", 2): (20, 20, 4)}
    with pytest.raises(ValueError):
        audit(rows, list("ABCDEFGH"), {})


def _collocations(docs: list[tuple], order: int, least: int, percent: int, most: int) -> list[tuple]:
    f, n = Counter(), Counter()
    for _, t, lang, _ in docs:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for k in range(1, order + 1):
                for i in range(len(ws) - k + 1):
                    f[lang, tuple(ws[i : i + k])] += 1
    found = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    dropped = set()
    for (lang, p), a in found.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                if 100 * a >= percent * found[lang, p[i : i + k]]:
                    dropped.add((lang, p[i : i + k]))
    out = []
    for lang in n:
        rows = []
        for (g, p), a in found.items():
            if g == lang and (g, p) not in dropped:
                score, k = min((10**6 * a * a // (f[g, p[:k]] * f[g, p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), f[g, p[:k]], f[g, p[k:]]))
        out += [(lang, k, p.decode(), -a, x, y, n[lang], -s) for k, (s, a, p, x, y) in enumerate(sorted(rows)[:most], 1)]
    return sorted(out)


@pytest.mark.parametrize(("order", "least", "most"), [(3, 10, 2000), (4, 3, 25), (2, 4, 40)])
def test_collocations_are_those_of_plain_counts(spark, order, least, most):
    from hexlab.llm.phrases import collocations

    rng = random.Random(order)
    words = ["the", "The", "of", "été", "\x00", "É", "a b", "rare", *(f"v{k}" for k in range(25))]
    docs = [(k, "".join(rng.choice(words[: rng.choice([4, 9, 33])]) + rng.choice([" ", "  ", "\t", ". ", "\n", " ", " ", ",", "\x0b"]) for _ in range(rng.randint(0, 120))), rng.choice(["en", "en", "en", "de", None, ""]), "s") for k in range(60)]
    docs += [(1, None, "en", None), (None, "", None, None), (900, "the of " * 5000, "en", "s"), (902, "of the, été of. " * 200_000, "de", "s"), (901, "...,,\n", "fr", "s")]
    frame = spark.createDataFrame(docs, DOCS).withColumns({c: F.lit(c) for c in ("words", "w1", "f", "phrase", "window", "rank")})
    got = sorted(tuple(r) for r in collocations(frame, order, least, 50, most).collect())
    assert got == _collocations(docs, order, least, 50, most) and got
    assert collocations(frame.where("false"), order, least).count() == 0


def test_scores_stay_exact_beyond_64_bits(spark):
    from hexlab.llm.phrases import scored

    a, left, right = 3 * 10**12 + 7, 7 * 10**13 + 11, 9 * 10**13 + 1
    counts = spark.createDataFrame([("en", "x y", 2, a), ("en", "x", 1, left), ("en", "y", 1, right)], "lang string, phrase string, words int, f long")
    assert scored(counts, 3).first()["score"] == 10**6 * a * a // (left * right)
