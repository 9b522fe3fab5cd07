"""Each operator against brute force on small tables with nulls, empty and long texts, copies and odd columns."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from hexlab.llm import bpe, common, fingerprints, jaccard, langid, licenses, lines, maxscore, packing, queries, repeats, simhash, toxicity

RNG = random.Random(5)
WORDS = ["".join(RNG.choice("abcdeé") for _ in range(RNG.randint(1, 7))) for _ in range(120)]


def prose(n, rng=RNG):
    return " ".join(rng.choice(WORDS) for _ in range(n))


LONG = "\n".join(prose(40) for _ in range(60))
SHARED = prose(120)
TEXTS = [None, "", "   \n ", "One", "one", "ONE  ", LONG, LONG, LONG[:5000] + " x " + LONG[5000:], prose(30) + SHARED + prose(30), SHARED + prose(20), "a\nb\nc\nd", "x\nb\nc\ny", "b\nc", "12 34 !!", "zz\nzz\nzz\nzz", "ﬁn É", "fin é", prose(3)]
#: Extra columns whose names the operators use themselves.
ODD = ["row", "new", "doc", "text_key", "fp", "fp2", "node", "bucket", "k", "starts", "spans", "kept", "n_bytes", "fingerprint", "digest", "gone_id", "component_id", "line_count", "masked", "ids"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, *["odd"] * len(ODD)) for i, t in enumerate(TEXTS)] + [(3, "One", *["odd"] * len(ODD)), (None, "stray text here", *["odd"] * len(ODD))]
    return spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} string" for c in ODD)).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, n_chars long")


def collected(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


def test_fingerprints(docs, nothing):
    got = fingerprints.fingerprint_report(docs).collect()
    rows = sorted(collected(docs), key=lambda r: r[1] or "")
    rows.sort(key=lambda r: -(r[0] if r[0] is not None else -(2**63)))
    assert len(got) == len(rows)
    want = Counter()
    for i, (doc, text) in enumerate(rows):
        a, b = text or "", rows[(i + 1) % len(rows)][1] or ""
        k = len(a) // 3
        edited = a[: len(a) - k] + b[:k]
        same = fingerprints.canonical(a)
        want[doc, len(a), hashlib.sha256(edited.encode()).hexdigest(), fingerprints.digest(same), float(same == fingerprints.canonical(edited)), float(same == fingerprints.canonical(b))] += 1
    assert want == Counter((r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"], r["near_edited"], r["near_next"]) for r in got)
    by = {r["doc_id"]: r for r in got}
    assert by[3]["fingerprint"] == by[4]["fingerprint"] == by[5]["fingerprint"] and by[16]["fingerprint"] == by[17]["fingerprint"]
    assert by[4]["class_id"] == 3 and by[4]["copies"] == 4 and by[0]["fingerprint"] == by[2]["fingerprint"]
    assert fingerprints.fingerprint_report(nothing).count() == 0


def reachable(fp, limit):
    ids, root = sorted(fp), {i: i for i in fp}
    for a in ids:
        for b in ids:
            if bin(fp[a] ^ fp[b]).count("1") <= limit:
                x, y = root[a], root[b]
                for k in ids:
                    if root[k] == max(x, y):
                        root[k] = min(x, y)
    return root


def test_simhash(docs, nothing):
    texts = {d: t for d, t in collected(docs) if d is not None}
    want = reachable({d: simhash.simhash(t) for d, t in texts.items()}, 3)
    got = simhash.near_duplicates(docs).collect()
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == want
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [None] and len(got) == len(TEXTS) + 2
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert 6 in ids and 7 not in ids and 8 not in ids and {9, 10, 14} <= ids
    assert simhash.near_duplicates(nothing).count() == 0


def changed(words, at):
    return " ".join(f"new{at}x{i}" if i in at else w for i, w in enumerate(words))


def test_near_duplicates_are_decided_on_their_shingles(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SMALL", 6)
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    rng, texts = random.Random(3), []
    passage = [rng.choice(WORDS) + str(rng.random()) for _ in range(90)]
    for g in range(25):
        words = [f"g{g}w{rng.random()}" for _ in range(rng.choice([40, 100, 200]))]
        for n in range(8):
            texts.append(changed(words, {rng.randrange(len(words)) for _ in range(rng.choice([1, len(words) // 50, len(words) // 40, len(words) // 30]))} if n else ()))
    texts += [" ".join([*passage, *(f"own{i}x{k}" for k in range(25))]) for i in range(30)] + [" ".join(passage + ["end"])] * 2
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {r["doc_id"]: r["component_id"] for r in jaccard.similar(docs).collect()} == dict(enumerate(root))
    assert sorted(r["doc_id"] for r in simhash.keep_one(docs).collect()) == sorted(set(root))
    assert 30 < len(set(root)) < len(texts) - 30


@pytest.mark.parametrize("threshold", [0, 1, 3, 5, 11])
def test_simhash_anchors_find_all_links(threshold):
    rng = np.random.default_rng(threshold)
    fp = []
    for base in rng.integers(0, 2**63, 25).tolist():
        for _ in range(12):
            x = base
            for k in rng.choice(64, rng.integers(0, threshold + 3), replace=False).tolist():
                x ^= 1 << k
            fp.append(x)
    fp = np.unique(np.array(fp, dtype=np.uint64))
    row, key, home = simhash.anchors_of(fp, threshold)
    o = np.argsort(key, kind="stable")
    a, b = simhash.linked(fp[row][o], np.zeros(len(o), np.uint64), row[o], key[o], home[o], threshold, 128)
    d = np.argwhere(np.triu(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= threshold, 1))
    assert (simhash.forest(a, b, len(fp)) == simhash.forest(d[:, 0], d[:, 1], len(fp))).all()


def test_simhash_by_definition():
    import xxhash

    text = "The the\tquick  brown\x0bfox Jumps"
    words = ["the", "the", "quick", "brown", "fox", "jumps"]
    hs = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), 42) for i in range(4)]
    assert simhash.simhash(text) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > 4)


def test_hot_anchor_is_dealt_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 8)
    rng = np.random.default_rng(1)
    fp = sorted({int(x) for x in np.int64(5) ^ (np.int64(1) << rng.integers(0, 62, 40)) ^ (np.int64(1) << rng.integers(0, 62, 40))})
    rows = spark.createDataFrame([(i, f, 0) for i, f in enumerate(fp)], "node long, fp long, fp2 long")
    found = common.components(simhash.near_links(rows, 3)).collect()
    got = {i: i for i in range(len(fp))} | {r["node"]: r["root"] for r in found}
    assert got == reachable(dict(enumerate(fp)), 3)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(300, 299), (5, 5)]
    got = {r["node"]: r["root"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100 + i: 100 for i in range(40)} | {299: 299, 300: 299}


def repeated_bytes(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(raw[i : i + length] for raw in raws for i in range(len(raw) - length + 1))
    out = []
    for raw in raws:
        gone = np.zeros(len(raw), dtype=bool)
        for i in range(len(raw) - length + 1):
            if seen[raw[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append((len(raw), int(gone.sum()), bytes(np.frombuffer(raw, np.uint8)[~gone])))
    return out


@pytest.mark.parametrize("large", [50_000, 2])
def test_repeats(spark, docs, nothing, monkeypatch, large):
    monkeypatch.setattr(repeats, "LARGE", large)
    rows = collected(docs) + [(100 + i, t) for i, t in enumerate(["ab" * 500, "a" * 399, "a" * 400, "é" * 450, "q" + "é" * 300])]
    given = docs.select("doc_id", "text").unionAll(spark.createDataFrame(rows[len(TEXTS) + 2 :], "doc_id long, text string"))
    want = Counter((d, *b) for (d, _), b in zip(rows, repeated_bytes([t for _, t in rows], 400), strict=True))
    got = repeats.remove_repeats(given, 400).collect()
    assert want == Counter((r["doc_id"], r["n_bytes"], sum(s["high"] - s["low"] for s in r["spans"]), bytes(r["kept"])) for r in got)
    assert all(a["high"] < b["low"] for r in got for a, b in zip(r["spans"], r["spans"][1:], strict=False))
    if large > 2:
        left = repeats.drop_repeats(docs)
        assert left.columns == docs.columns and left.count() == docs.count() and repeats.remove_repeats(nothing).count() == 0


@pytest.mark.parametrize("large", [50_000, 2])
def test_repeats_of_words(spark, docs, nothing, monkeypatch, large):
    monkeypatch.setattr(repeats, "LARGE", large)
    rng = random.Random(7)
    passage = prose(80, rng).split()
    texts = [t for _, t in collected(docs)]
    for n in (49, 50, 51, 70, 80):  # of other white space, in the middle and at the ends
        texts += [prose(60, rng) + "\n" + "\t ".join(passage[:n]) + " " + prose(60, rng), "\n".join(passage[-n:])]
    given = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    seen = Counter(tuple(w[i : i + 50]) for t in texts for w in [(t or "").split()] for i in range(len(w) - 49))
    got = {r["doc_id"]: r["text"] for r in repeats.drop_repeats(given, 50, "word").collect()}
    changed_ = 0
    for d, t in enumerate(texts):
        w = (t or "").split()
        gone = {j for i in range(len(w) - 49) if seen[tuple(w[i : i + 50])] > 1 for j in range(i, i + 50)}
        assert got[d] == t if not gone else got[d].split() == [x for i, x in enumerate(w) if i not in gone]
        changed_ += bool(gone)
    assert 8 < changed_ < len(texts) - 5
    if large > 2:
        left = repeats.drop_repeats(docs, 50, "word")
        assert left.columns == docs.columns and left.count() == docs.count() and repeats.drop_repeats(nothing, 50, "word").count() == 0


def test_repeats_report_passages_shorter_than_400_bytes(spark, docs, tmp_path):
    rng = random.Random(11)
    passage = [WORDS[i % len(WORDS)][:3] for i in rng.sample(range(1000), 55)]
    own = [prose(70, rng) for _ in range(4)]
    texts = [own[0] + " " + " ".join(passage) + " " + own[1], " ".join(passage) + "\n" + own[2], own[3] + "\n" + "\t ".join(passage), own[3][::-1], None, "", LONG, LONG]
    assert len(" ".join(passage).encode()) < 400
    texts += [t for _, t in collected(docs)]
    path = str(tmp_path)
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(f"{path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op4_repeats(spark, path).collect()}
    assert len(got) == len(texts)
    split = [(t or "").split() for t in texts]
    seen = Counter(tuple(w[i : i + 50]) for w in split for i in range(len(w) - 49))
    for d, ((n, gone, kept), w) in enumerate(zip(repeated_bytes(texts, 400), split, strict=True)):
        inside = {j for i in range(len(w) - 49) if seen[tuple(w[i : i + 50])] > 1 for j in range(i, i + 50)}
        r = got[d]
        assert (r["n_passage_words"], r["n_passages"]) == (len(inside), sum(j - 1 not in inside for j in inside))
        assert (r["n_bytes"], r["n_removed"], r["kept_sha256"]) == (n, gone, hashlib.sha256(kept).hexdigest())
    assert [(got[d]["n_removed"], got[d]["n_passage_words"], got[d]["n_passages"]) for d in range(4)] == [(0, 55, 1)] * 3 + [(0, 0, 0)]


def test_anchors_by_definition():
    rng = np.random.default_rng(3)
    for unit, length in (("byte", 33), ("byte", 400), ("word", 9), ("word", 50)):
        raw = rng.integers(0, 3, 1500).astype(repeats.SYMBOL[unit]).tobytes()
        h = repeats.grams(raw, unit) >> np.uint64(32)
        key, place, first, last = repeats.anchors(raw, length, unit)
        assert first[0] == 0 and last[-1] == 1500 - length and (first[1:] == last[:-1] + 1).all()
        for p, a, b in zip(place, first, last, strict=True):
            for i in range(a, b + 1):
                window = h[i : i + length - repeats.GRAM[unit] + 1]
                assert p == i + np.flatnonzero(window == window.min())[-1]
        strings = {}
        for k, p in zip(key.tolist(), place.tolist(), strict=True):
            assert strings.setdefault(k, raw[repeats.SIZE[unit] * p :][: repeats.SIZE[unit] * repeats.GRAM[unit]]) == raw[repeats.SIZE[unit] * p :][: repeats.SIZE[unit] * repeats.GRAM[unit]]


def test_columns_round_by_round():
    rng = random.Random(2)
    for _ in range(20):
        core = "".join(rng.choice("ab") for _ in range(repeats.GRAM["byte"])).encode()
        ctx, before = [], []
        for _ in range(rng.randint(2, 12)):
            left, right = ("".join(rng.choice("ab") for _ in range(rng.randint(0, 8))).encode() for _ in range(2))
            if left + core + right not in ctx:
                ctx.append(left + core + right)
                before.append(len(left))
        length = repeats.GRAM["byte"] + 6
        keep = [k for k in range(len(ctx)) if len(ctx[k]) >= length and before[k] <= 6 and len(ctx[k]) - before[k] <= length]
        ctx, before = [ctx[k] for k in keep], np.array([before[k] for k in keep], dtype=int)
        if not ctx:
            continue
        want = set()
        for k, c in enumerate(ctx):
            for p in range(len(c) - length + 1):
                at = [j for j, o in enumerate(ctx) if j != k and 0 <= p - before[k] + before[j] and o[p - before[k] + before[j] :][:length] == c[p : p + length]]
                want |= {(k, p)} if at else set()
        got = {(k, p) for k, a, b in repeats.repeated(ctx, before, length) for p in range(a, b - length + 1)}
        assert got == want


@pytest.mark.parametrize("window", [1, 2, 3])
def test_lines(docs, nothing, window):
    rows = sorted({(d if d is not None else 2**63 - 1, t) for d, t in collected(docs) if t is not None})
    key = {}
    for d, t in rows:
        body = [x.strip(lines.BLANKS) for x in t.split("\n") if x.strip(lines.BLANKS)]
        for s in range(len(body) - window + 1):
            key.setdefault(tuple(body[s : s + window]), []).append((d, s, t))
    # equal doc_ids with other texts are ordered by a hash of the text: none here share a run
    gone = {}
    for found in key.values():
        for d, s, t in sorted(found)[1:]:
            gone.setdefault((d, t), set()).update(range(s, s + window))
    for r in lines.line_report(docs, window).collect():
        d = r["doc_id"] if r["doc_id"] is not None else 2**63 - 1
        text = next(t for k, t in collected(docs) if (k if k is not None else 2**63 - 1) == d)
        assert r["lines_gone"] == len(gone.get((d, text), ())), (d, window)
        assert (r["text"] is None) == (text is None)
    out = lines.drop_repeated_lines(docs, window)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert lines.line_report(nothing).count() == 0


def test_winnow_has_a_place_in_every_window():
    rng = random.Random(1)
    for _ in range(50):
        h = [rng.randint(0, 5) for _ in range(rng.randint(0, 30))]
        for w in (1, 2, 4):
            places = set(lines.winnow(h, w))
            assert all(places & set(range(s, s + w)) for s in range(len(h) - w + 1))


def brute_top(vectors, k, every=50):
    ok = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in ok:
        if q % every == 0:
            scored = sorted(((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in ok if i != q and len(a) == len(b)))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("shard", [30, 4096])
def test_maxscore(spark, monkeypatch, shard):
    monkeypatch.setattr(maxscore, "SHARD", shard)
    monkeypatch.setattr(maxscore, "AROUND", shard)
    rng = np.random.default_rng(3)
    vectors = [(i, rng.normal(0, 0.2, 6).astype(np.float32).tolist()) for i in range(160)]
    vectors += [(200, [0.0] * 6), (250, [1.0] * 6), (251, [1.0] * 6), (252, [1.0] * 6), (300, None), (301, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (350, [float("nan")] * 6), (351, [float("inf")] + [0.0] * 5), (None, [1.0] * 6), (400, [0.5, 0.5])]
    df = spark.createDataFrame([(i, v, 1) for i, v in vectors], "vec_id long, embedding array<float>, label int")
    whole = maxscore.whole_numbers(df)
    got = maxscore.top_k(whole, whole.where("vec_id % 50 = 0"), 5).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == brute_top(vectors, 5)
    empty = maxscore.whole_numbers(df.where("vec_id < 0"))
    assert maxscore.top_k(empty, empty).count() == 0
    odd = df.withColumns({c: F.lit("odd") for c in ("shard", "size", "block", "v", "pivot", "query_id", "score")})
    again = maxscore.whole_numbers(odd)
    assert sorted(map(tuple, maxscore.top_k(again, again.where("vec_id % 50 = 0"), 5).collect())) == sorted(map(tuple, got))


def test_maxscore_bounds_bite(spark, monkeypatch):
    """Clustered vectors: exact, and most of them are never scored; components of any size."""
    monkeypatch.setattr(maxscore, "SHARD", 64)
    monkeypatch.setattr(maxscore, "AROUND", 50)
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 1, (12, 16))
    x = (centres[rng.integers(0, 12, 1500)] + rng.normal(0, 0.05, (1500, 16))).astype(np.float32)
    vectors = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    v = maxscore.whole_numbers(df)
    q = v.where("vec_id % 50 = 0")
    assert sorted(map(tuple, maxscore.top_k(v, q, 5).collect())) == brute_top(vectors, 5)
    share = maxscore.scored_share(v, q, 5)
    assert 0 < share < 0.5, share
    large = [(i, (np.float32(s) * np.array(v[:4], dtype=np.float32)).tolist()) for (i, v), s in zip(vectors[:200], [1e6, 3e3, 1.0, 2e7] * 50, strict=True)]
    v = maxscore.whole_numbers(spark.createDataFrame(large, "vec_id long, embedding array<float>"))
    assert sorted(map(tuple, maxscore.top_k(v, v.where("vec_id % 50 = 0"), 5).collect())) == brute_top(large, 5)


def test_bpe(docs, nothing):
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    for r in bpe.encode_decode(docs, path).collect():
        text = next(x for d, x in collected(docs) if d == r["doc_id"]) or ""
        want = t.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(bytes(r["ids"]), "<u4").tolist() == want and r["decoded"] == t.decode(want, skip_special_tokens=False) == text
    assert bpe.encode_decode(nothing, path).count() == 0
    assert [bytes(r["ids"]) for r in bpe.encode_decode(docs, path).where("doc_id is null").collect()] == [np.array(t.encode("stray text here", add_special_tokens=False).ids, dtype="<u4").tobytes()]
    b = bpe.load(open(path, encoding="utf-8").read())
    rng = random.Random(9)
    letters = "ab 's\n\t \x85 éÉ12.!|<>日本'll don't \x1c\U0001d538́"
    for text in ["<|endoftext|>", "a<|endoftext|> b", "aaaa" * 40, "  \n\n x", *["".join(rng.choice(letters) for _ in range(40)) for _ in range(400)]]:
        assert np.frombuffer(b.encode(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)


def test_packing(docs, nothing):
    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    pieces = packing.pack(docs.coalesce(1), path, tokens=256).collect()
    texts = Counter()
    for d, text in collected(docs):
        texts[d, tuple(t.encode(text or "", add_special_tokens=False).ids + [2])] += 1
    by, seq = {}, {}
    for p in pieces:
        by.setdefault((p["doc_id"], p["doc_tokens"]), []).append(p)
        seq.setdefault(p["sequence_id"], []).append(p)
        assert len(p["ids"]) == 4 * p["length"]
    assert sum(p["length"] for p in pieces) == sum(len(ids) * n for (_, ids), n in texts.items())
    for (d, ids), n in texts.items():
        mine = sorted((p for p in by[d, len(ids)]), key=lambda p: p["start"])
        assert sum(p["length"] for p in mine) % len(ids) == 0
        for p in mine:
            assert any(np.frombuffer(bytes(p["ids"]), "<u4").tolist() == list(other[p["start"] : p["start"] + p["length"]]) for (e, other) in texts if e == d)
    for parts in seq.values():
        at = 0
        for p in sorted(parts, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at == 256 or at & (at - 1) == 0
    assert packing.pack(nothing, path).count() == 0


def test_packing_of_instructions(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    rng = random.Random(12)
    rows = [(i, prose(rng.randint(0, 90), rng) or None, prose(rng.randint(0, 400), rng)) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, question string, text string").coalesce(2)
    pieces = packing.pack(df, path, tokens=512, segments=6, loss=200, prompt="question").collect()
    ids = {i: (t.encode(q or "", add_special_tokens=False).ids, t.encode(a, add_special_tokens=False).ids + [2]) for i, q, a in rows}
    seq, seen = {}, {}
    for p in pieces:
        head, tail = ids[p["doc_id"]]
        assert np.frombuffer(bytes(p["ids"]), "<u4").tolist() == (head + tail)[p["start"] : p["start"] + p["length"]] and p["doc_tokens"] == len(head + tail)
        seen[p["doc_id"]] = seen.get(p["doc_id"], 0) + p["length"]
        seq.setdefault(p["sequence_id"], []).append((p["length"], max(0, p["start"] + p["length"] - max(p["start"], len(head)))))
    assert seen == {i: len(a) + len(b) for i, (a, b) in ids.items()}
    loss = [sum(x for _, x in s) for s in seq.values()]
    assert all(len(s) <= 6 and sum(n for n, _ in s) <= 512 for s in seq.values()) and max(loss) <= 200
    assert sum(x > 180 for x in loss) > 20  # the limit on loss-bearing tokens is what closes sequences


@pytest.mark.parametrize(("segments", "loss"), [(256, 4096), (3, 4096), (256, 900), (1, 4096)])
def test_packer_keeps_all_limits(segments, loss):
    rng = random.Random(segments * loss)
    p, sizes, out = packing.Packer(4096, segments, loss), [], []
    for k in range(1500):
        n = rng.choice([1, 5, 40, 300, 2000, 9000])
        masked = rng.randint(0, n) if loss < 4096 else 0
        sizes.append((n, masked))
        out += p.add(k, n, masked)
    out += p.finish()
    parts, seq = {}, {}
    for k, start, length, s, offset in out:
        parts.setdefault(k, []).append((start, length))
        seq.setdefault(s, []).append((offset, length, k, start))
    for k, (n, _) in enumerate(sizes):
        at = 0
        for start, length in sorted(parts[k]):
            assert start == at
            at += length
        assert at == n
    for v in seq.values():
        total = sum(x[1] for x in v)
        assert total <= 4096 and len(v) <= segments and (total == 4096 or total & (total - 1) == 0)
        assert sum(max(0, st + n - max(st, sizes[k][1])) for _, n, k, st in v) <= loss


def test_word_tokenizer_by_parts():
    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    encode = packing.tokenizer(open(path, encoding="utf-8").read(), 2)
    rng = random.Random(4)
    letters = "abÉéßµªº 's\n İσΣ12²½.!?,;:|<>日'll \x1c\x85́\U0001d538_"
    for text in ["<|endoftext|> a", "É,", "ΣΑΣ", *["".join(rng.choice(letters) for _ in range(30)) for _ in range(800)]]:
        assert np.frombuffer(encode(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids + [2], repr(text)


def test_language_gradients():
    net = langid.Gru(["a", "b"], hidden=3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, n = langid.as_matrix([b"hello", b"y", b"zz"])
    y, w = np.array([0, 1, 1]), np.ones(3)
    _, g = net.gradients(x, n, y, w)
    rng = np.random.default_rng(0)
    for k, v in net.p.items():
        for _ in range(5):
            at = tuple(int(rng.integers(0, s)) for s in v.shape)
            at = (int(rng.choice(list(b"heloyz "))), at[1]) if k.startswith("in") else at
            old, e = v[at], 1e-4
            v[at] = old + e
            up = net.gradients(x, n, y, w)[0]
            v[at] = old - e
            down = net.gradients(x, n, y, w)[0]
            v[at] = old
            assert abs((up - down) / (2 * e) - g[k][at]) < 1e-5


def plain_reading(net, raw):
    """Position by position, without batches: the mean of the distributions, and the states that go on across words."""
    h, p = net.hidden, {k: v.astype(np.float64) for k, v in net.p.items()}

    def read(way, letters):
        s, out = np.zeros(h), []
        for b in letters:
            a = p["in" + way][b]
            z, r = np.split(1 / (1 + np.exp(-(a[: 2 * h] + s @ p["zr" + way]))), 2)
            n = np.tanh(a[2 * h :] + (r * s) @ p["c" + way])
            s = (1 - z) * n + z * s
            out.append(s)
        return out

    total = np.zeros(len(net.languages))
    for at in range(0, len(raw), langid.CORE):
        low, end = max(0, at - langid.WARM), min(len(raw), at + langid.CORE)
        part = raw[low : end + langid.WARM]
        for i, (f, b) in enumerate(zip(read("f", part), read("b", part[::-1])[::-1], strict=True)):
            if at <= low + i < end:
                e = np.exp(np.concatenate([f, b]) @ p["out"] + p["bias"])
                total += e / e.sum()
    return total / total.sum()


def test_language_against_a_plain_reading():
    net = langid.Gru(["a", "b", "c"], hidden=4)
    rng = random.Random(3)
    texts = [prose(n, rng) for n in (1, 3, 40, 90, 260)] + ["日本語" * 200, "x" * langid.CORE, "y" * (langid.CORE + 1), None, "12"]
    names, scores = langid.Labeller(net)(texts)
    for t, name, score in zip(texts[:-2], names, scores, strict=False):
        want = plain_reading(net, t.encode())
        assert name == net.languages[int(want.argmax())] and abs(score - want.max()) < 1e-4
    assert names[-2:] == ["und", "und"] and scores[-2:] == [0.0, 0.0]


def test_language_stage_rejects_what_is_no_language_it_knows(spark):
    rng = random.Random(8)
    syllables = {"aa": ["ba", "lo", "mi", "tu", "re", "sa"], "bb": ["schu", "kno", "per", "dul", "ing", "ost"], "cc": ["xir", "qua", "zho", "wyn", "vek", "juf"]}

    def text(lang, n):
        return " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))

    rows = [(k, text(lang, rng.randint(5, 200)), lang) for k in range(600) for lang in (("aa", "bb")[k % 2],)]
    mixed = [(1000 + k, text("aa", 60) + ". " + text("bb", 60) + " 4711 8fa0", "aa") for k in range(20)]
    other = [(2000 + k, text("cc", rng.randint(8, 100)), None) for k in range(60)]
    noise = [(3000 + k, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz  ") for _ in range(rng.randint(60, 500))), None) for k in range(60)]
    rest = [(4000, None, "aa"), (4001, "12 34", "bb"), (4002, text("bb", 20_000), None)]
    kept = {r["doc_id"] for r in langid.keep_identified(spark.createDataFrame([*rows, *mixed, *other, *noise, *rest], "doc_id long, text string, lang string")).collect()}
    assert sum(k < 1000 for k in kept) >= 0.99 * len(rows) and sum(1000 <= k < 2000 for k in kept) >= 19
    assert sum(2000 <= k < 3000 for k in kept) <= 0.1 * len(other) and sum(3000 <= k < 4000 for k in kept) <= 0.1 * len(noise)
    assert 4002 in kept and not kept & {4000, 4001}


def test_language(spark, nothing):
    rng = random.Random(8)
    vocab = {"aa": ["der", "und", "die", "schön", "nicht"], "bb": ["el", "que", "año", "pero", "los"]}
    rows = [(i, " ".join(rng.choice(vocab[lang]) for _ in range(20)), lang) for i in range(200) for lang in [rng.choice(["aa", "bb"])]]
    rows += [(1000, None, "aa"), (1001, "", "bb"), (1002, "123 !!", "aa"), (None, "und die", "bb"), (1003, "und die nicht " * 4000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.identify(df).collect()
    truth = {i: lang for i, _, lang in rows}
    for r in got:
        if r["doc_id"] is not None:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1
        if r["doc_id"] in (1000, 1001, 1002):
            assert r["lang_pred"] == "und"
        elif r["doc_id"] == 1003 or r["doc_id"] is None:
            assert r["lang_pred"] == "aa"
        else:
            assert r["lang_pred"] == truth[r["doc_id"]]
    kept = langid.keep_identified(df)
    assert kept.columns == df.columns and kept.count() == len(rows) - 3
    assert langid.identify(nothing).count() == 0
    unlabelled = df.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in langid.identify(unlabelled).collect()} == {"und"}
    assert langid.keep_identified(unlabelled).count() == len(rows) - 3
    odd = df.withColumns({c: F.lit("odd") for c in ("score", "lang_pred", "held_out", "pieces", "window")})
    assert {(r["doc_id"], r["lang_pred"]) for r in langid.identify(odd).collect()} == {(r["doc_id"], r["lang_pred"]) for r in got}


def test_toxicity_scores_by_a_plain_sum():
    """Each category: bias, weights of the distinct words' letter runs, weights of the earlier probabilities."""
    rng = random.Random(16)
    texts = [prose(25, rng) + (" badterm" if i % 3 == 0 else "") + (" spamterm" if i % 4 == 0 else "") for i in range(240)]
    labels = np.array([[int(i % 4 == 0), int(i % 3 == 0)] for i in range(240)])
    chain = toxicity.Chain.train(texts, labels, list(range(240)), ["junk", "toxic"])
    assert all(link.weights for link in chain.links) and [len(link.earlier) for link in chain.links] == [0, 1]
    score = chain.scorer()
    known = {f for t in texts for w in toxicity.words(t) for f in toxicity.runs(w)}
    for t in [*texts[:30], "badterm spamterm", "", None, "BADTERM badterm", "x" * 5000]:
        out = []
        for link in chain.links:
            total = link.bias + sum(a * b for a, b in zip(link.earlier, out, strict=True))
            for w in {x for x in re.findall(r"[^\W\d_]+", (t or "").casefold())}:
                marked = f"^{w}$"
                for f in {marked} | {marked[i : i + n] for n in (4, 5) for i in range(len(marked) - n + 1)}:
                    total += link.weights.get(zlib.crc32(f.encode()), 0.0) if f in known else 0.0
            out.append(1 / (1 + np.exp(-np.clip(total, -40, 40))))
        assert np.allclose(score(t), out, atol=1e-9)
    assert np.mean([(score(t)[1] >= 0.5) == bool(y[1]) for t, y in zip(texts, labels, strict=True)]) > 0.95


def test_toxicity(spark, nothing):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(400):
        bad, junk = rng.random() < 0.3, rng.random() < 0.2
        words = [rng.choice(WORDS) for _ in range(30)] + (["vileword" + rng.choice("abc")] if bad else []) + (["junkmark"] * 3 if junk else [])
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, None if i % 50 == 0 else int(not junk), int(bad)))
    rows += [(900, None), (901, ""), (902, "clean words only " * 3000), (0, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels[:300], "doc_id long, quality int, toxic int")
    chain = toxicity.train(docs, marks)
    got = toxicity.classify(docs, chain).collect()
    assert len(got) == len(rows) and chain.names == ["junk", "toxic"] and len(chain.links[1].earlier) == 1
    truth = {i: t for i, _, t in labels}
    held = [r for r in got if r["doc_id"] is not None and 300 <= r["doc_id"] < 400]
    assert np.mean([(r["toxic"] >= 0.5) == truth[r["doc_id"]] for r in held]) > 0.95
    assert next(r for r in got if r["doc_id"] == 900)["toxic"] < 0.5
    odd = docs.withColumns({c: F.lit("odd") for c in ("junk", "toxic", "quality", "label")}).unionByName(spark.createDataFrame([(None, "vileworda words", *["odd"] * 4)], "doc_id long, text string, junk string, toxic string, quality string, label string"))
    again = toxicity.classify(odd, chain).collect()
    assert {r["doc_id"]: r["toxic"] for r in again if r["doc_id"] is not None} == {r["doc_id"]: r["toxic"] for r in got} and len(again) == len(rows) + 1
    none = toxicity.train(docs, marks.where("doc_id < 0"))
    assert toxicity.classify(nothing, none).count() == 0 and toxicity.classify(docs, none).count() == len(rows)


WRAPPED = """MIT License

Copyright (c) 2020 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""


def test_licenses(spark, docs, nothing, tmp_path):
    mit = next(t for name, t in licenses.KNOWN if name == "MIT")
    rows = [(1, "Copyright (c) 2001 Someone\n\n" + mit.upper().replace(" NOTICE", "\n  NOTICE").replace("COPYRIGHT", "\nCOPYRIGHT")), (2, "Text.\nReleased under the MIT LICENCE!\nMore.\nAll rights reserved."), (3, None), (4, ""), (2, "Text."), (None, "All Rights Reserved"), (5, mit + " and more")]
    rows += [(6, WRAPPED), (7, "A story.\n\n" + WRAPPED.split("\n\n", 2)[2] + "\n\nIts end.\n" * 3000), (8, WRAPPED.replace("hereby", "not"))]
    got = {(r["doc_id"], r["n_notices"], r["license"], r["notices"], r["contained"]) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {g for g in got if g[0] not in (6, 7)} == {(1, 0, "MIT", "", "MIT"), (2, 2, None, "MIT,reserved", ""), (3, 0, None, "", ""), (4, 0, None, "", ""), (2, 0, None, "", ""), (None, 1, "reserved", "reserved", "reserved"), (5, 0, None, "", ""), (8, 0, None, "", "")}
    assert {g for g in got if g[0] in (6, 7)} == {(6, 0, "MIT", "", "MIT"), (7, 0, None, "", "MIT")}
    assert licenses.scan(docs).count() == docs.count() and licenses.scan(nothing).count() == 0


def test_every_known_licence_is_found_whole_and_inside(spark):
    rows = [(i, name, "© 1999 A. N. Other\n" + text.replace(", ", ",\n").upper()) for i, (name, text) in enumerate(licenses.KNOWN)]
    df = spark.createDataFrame(rows, "doc_id long, name string, text string")
    inside = df.withColumn("text", F.concat(F.lit("Before it.\n\n"), "text", F.lit("\n \nAnd after it.")))
    names = {i: {n for n, t in licenses.KNOWN if t.rstrip(".") == licenses.KNOWN[i][1].rstrip(".")} for i, *_ in rows}
    assert all(r["license"] in names[r["doc_id"]] for r in licenses.scan(df).collect())
    assert all(r["license"] is None and set(r["contained"].split(",")) <= names[r["doc_id"]] and r["contained"] for r in licenses.scan(inside).collect())


def test_long_licences_inside_documents(spark):
    """However many paragraphs they have, and wherever they stand."""
    folder, found = "/usr/share/common-licenses", {}
    for file, name in (("GPL-3", "GPL-3.0"), ("Apache-2.0", "Apache-2.0"), ("CC0-1.0", "CC0-1.0"), ("GPL-2", "GPL-2.0"), ("MPL-1.1", "MPL-1.1"), ("GFDL-1.3", "GFDL-1.3")):
        if os.path.exists(f"{folder}/{file}"):
            with open(f"{folder}/{file}", encoding="utf-8") as f:
                found[name] = f.read()
    many = "\n\n".join(f"part {k} of a long text" for k in range(40))
    rows = [(k, f"{prose(30)}\n\n\n{text}\n\n{prose(9)}") for k, text in enumerate(found.values())]
    rows += [(90, f"before\n\n{many}\n \n\nafter"), (91, many), (92, many.replace("part 7", "part x")), (93, f"{many}\n\n{many}")]
    known = [("mine", many.replace("\n\n", " "))]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), [*licenses.KNOWN, *known]).collect()}
    for k, name in enumerate(found):
        assert name in got[k]["contained"].split(",") and got[k]["license"] is None
    assert [got[k]["contained"] for k in (90, 91, 92, 93)] == ["mine", "mine", "", "mine"] and got[91]["license"] == "mine"


@pytest.mark.skipif(not os.path.isdir("/usr/share/common-licenses"), reason="the long texts are not on this machine")
def test_long_licences(spark):
    files = {"GPL-3.0": "GPL-3", "GPL-2.0": "GPL-2", "LGPL-2.1": "LGPL-2.1", "Apache-2.0": "Apache-2.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    rows = [(i, name, open(f"/usr/share/common-licenses/{f}", encoding="utf-8").read().replace("\n", "\r\n")) for i, (name, f) in enumerate(files.items())]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, name string, text string")).collect()
    assert {r["doc_id"]: r["license"] for r in got} == {i: name for i, name, _ in rows}
