"""Whitening, collocations and packing against brute force, and on nulls, empty and long texts, ties, repeats and clashing columns."""

import collections
import math
import random
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from sessionloom.llm import collocations, packing, whitening
from tests.llm.test_operators import DOCS, frame, mixed

rng = random.Random(5)
JSON = public_tokenizers.path("byte_bpe_50k.json")


# --- whitening


def test_digits_and_products_are_exact():
    gen = np.random.default_rng(1)
    for most in (1, 1 << 17, 1 << 40, 1 << 61):
        x = gen.integers(-most, most, (300, 5), endpoint=True)
        x[0, :2] = most, -most
        parts = whitening.digits(x)
        assert all(np.abs(p).max() <= 1 << (whitening.DIGIT - 1) for p in parts)
        assert (whitening.recombined([p.astype(np.int64) for p in parts]) == x.astype(object)).all()
        gram = whitening.Gram(5)
        for at in range(0, 300, 7):
            gram.add(x[at : at + 7])
        before = whitening.recombined(gram.levels)
        gram.carry()
        want = x.astype(object).T @ x.astype(object)
        assert (before == want).all() and (whitening.recombined(gram.levels) == want).all()
        assert all(np.abs(level).max() <= 1 << (whitening.DIGIT - 1) for level in gram.levels)


def test_largest_digits_fill_a_product():
    y = np.full((whitening.ROWS, 1), -(1 << (whitening.DIGIT - 1)), dtype=np.int64)
    gram = whitening.Gram(1)
    gram.add(y)
    assert whitening.recombined(gram.levels)[0, 0] == whitening.ROWS << (2 * whitening.DIGIT - 2)


def brute_covariance(vectors):
    """n, sums and the covariance as fractions."""
    x = [[math.floor(1024 * c) + 100_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    sums = [sum(r[i] for r in x) for i in range(d)]
    centred = [[Fraction(n * r[i] - sums[i], n) for i in range(d)] for r in x]
    return x, n, sums, [[sum(r[i] * r[j] for r in centred) / n for j in range(d)] for i in range(d)]


@pytest.mark.parametrize("big", [1.0, 3e30])
def test_whitening(spark, big):
    gen = np.random.default_rng(3)
    mixing = gen.normal(size=(10, 10))
    vectors = [[float(np.float32(c)) for c in v] for v in gen.normal(size=(60, 10)) @ mixing]
    vectors[7] = vectors[3]
    if big > 1:  # beyond what a long can hold: rows count with their entries held
        vectors = [[c * 1e12 for c in v] for v in vectors]
    odd = [(900, None), (901, []), (902, [1.0] * 9), (903, [None] + [1.0] * 9), (904, [float("nan")] * 10), (905, [float("inf")] + [0.0] * 9)]
    rows = [(None if i == 5 else i // 2, v) for i, v in enumerate(vectors)] + odd
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5).selectExpr("*", "1 AS n", "2 AS i", "3 AS level", "'x' AS component", "4 AS vector")
    got = whitening.whitening(df).collect()
    x, n, sums, cov = brute_covariance(vectors)
    values, axes = np.linalg.eigh(np.array([[float(c) for c in row] for row in cov]))
    values, axes = values[::-1], axes[:, ::-1]
    trace = float(sum(cov[i][i] for i in range(10)))
    assert len(got) == 60 * 8 and {r["n"] for r in got} == {60} and {r["component"] for r in got} == set(range(1, 9))
    deviation = collections.Counter((i, sum((n * c - s) ** 2 for c, s in zip(r, sums))) for (i, _), r in zip(rows, x))
    assert collections.Counter((r["vec_id"], int(r["deviation"])) for r in got if r["component"] == 1) == deviation
    for k in range(8):
        mine = [r for r in got if r["component"] == k + 1]
        assert mine[0]["explained"] == pytest.approx(values[k] / trace, rel=1e-9) and mine[0]["identity_error"] < 1e-9
        want = [float(sum((c - Fraction(s, n)) * Fraction(float(a)) for c, s, a in zip(r, sums, axes[:, k]))) / math.sqrt(values[k]) for r in x]
        have = sorted(r["whitened"] for r in mine)
        assert np.allclose(have, sorted(want), atol=1e-7) or np.allclose(have, sorted(-w for w in want), atol=1e-7)


def test_whitening_without_variance(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 4.0]), (2, [1.0, 4.0])], "vec_id long, embedding array<float>")
    got = whitening.whitening(df).collect()
    assert {(r["component"], r["whitened"] is None) for r in got} == {(1, False), (2, True)} and len(got) == 6
    assert {round(r["explained"], 9) for r in got} == {1.0, 0.0} and got[0]["identity_error"] < 1e-9
    same = whitening.whitening(df.where("vec_id = 2")).collect()
    assert len(same) == 4 and all(r["whitened"] is None and r["explained"] == 0 and r["identity_error"] is None and r["deviation"] == 0 for r in same)
    assert whitening.whitening(df.where("vec_id > 5")).count() == 0 and whitening.fit(df.where("vec_id > 5")) is None


# --- collocations


def brute_collocations(rows, min_count=10, top=2000, longest=3):
    n, f = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for c in ".,;:!?\n\x0b\x0c\r":
            folded = folded.replace(c, "\n")
        for piece in folded.split("\n"):
            words = [w for w in piece.replace("\t", " ").split(" ") if w]
            n[lang] += len(words)
            for m in range(1, longest + 1):
                for s in range(len(words) - m + 1):
                    f[lang, tuple(words[s : s + m])] += 1
    out = []
    for (lang, p), a in f.items():
        if len(p) < 2 or a < min_count:
            continue
        longer = [b for (other, q), b in f.items() if other == lang and len(q) > len(p) and b >= min_count and any(q[i : i + len(p)] == p for i in range(len(q)))]
        if any(100 * b >= 50 * a for b in longer):
            continue
        score, _, l, r = min((10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))  # noqa: E741
        out.append((lang, " ".join(p), a, l, r, n[lang], score))
    ranked = []
    for lang in {r[0] for r in out}:
        best = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:top]
        ranked += [(lang, i + 1, *r[1:]) for i, r in enumerate(best)]
    return sorted(ranked)


def phrases(n=120):
    words = ["The", "cat", "sat", "on", "a", "mat", "É", "日本", "x\x1cy", "\x00"]
    rows = [("".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", ". ", "\n", " cat sat on a mat "]) for _ in range(rng.randrange(40))), rng.choice(["en", "de", None, "und"])) for _ in range(n)]
    return [*rows, (None, "en"), ("", None), ("a b " * 5000, "en"), ("one two three four five " * 12, "xx"), ("q", "lone"), ("z z z z z z z z z z z", "zz")]


@pytest.mark.parametrize("words,longest", [(1 << 20, 3), (50, 3), (50, 4)])
def test_collocations(spark, words, longest):
    rows = phrases()
    df = spark.createDataFrame(rows, "text string, lang string").repartition(4).selectExpr("*", "1 AS shard", "2 AS n", "3 AS `left`", "4 AS name", "5 AS word")
    got = collocations.collocations(df, max_words=longest, shard_words=words)
    assert sorted(map(tuple, got.collect())) == brute_collocations(rows, longest=longest)
    assert [t for _, t in got.dtypes] == ["string", "bigint", "string", *["bigint"] * 5]


def test_collocations_first_by_rank(spark):
    rows = phrases()
    df = spark.createDataFrame(rows, "text string, lang string")
    assert sorted(map(tuple, collocations.collocations(df, top=3).collect())) == brute_collocations(rows, top=3)
    assert collocations.collocations(df.limit(0)).count() == 0


def test_scores_beyond_64_bits(spark):
    big = [(10**14, 3 * 10**14, 7 * 10**14 + 1), (999_999_999_999_989, 10**15 - 1, 10**15 - 3), (10, 10, 10)]
    level = spark.createDataFrame([(i, "en", "p", a, [l], [r]) for i, (a, l, r) in enumerate(big)], "name long, lang string, phrase string, f long, first_f array<long>, last_f array<long>")
    got = {r["name"]: r["score"] for r in collocations._scored(level, 2).collect()}
    assert got == {i: 10**6 * a * a // (l * r) for i, (a, l, r) in enumerate(big)}


# --- packing


def check_packing(rows, out, capacity, ids_of):
    """Every document's pieces, and sequences without gaps."""
    want = collections.Counter()
    for doc, text in rows:
        ids = [*ids_of(text or ""), 2]
        first = (len(ids) - 1) % capacity + 1
        cuts = [0, *range(first, len(ids), capacity), len(ids)]
        for k, (x, y) in enumerate(zip(cuts, cuts[1:])):
            want[doc, k, x, y - x, zlib.crc32(np.array(ids[x:y], dtype="<u4").tobytes())] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == want
    sequences = collections.defaultdict(list)
    for r in out:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_packing_every_document(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(JSON)
    rows = mixed() + [(950, "a <|endoftext|> b"), (951, "x" * 200_000), (952, "word " * 64)]
    df = frame(spark, rows)
    out = packing.best_fit_packing(df, JSON, capacity=64)
    n = check_packing(rows, out.collect(), 64, lambda t: whole.encode(t, add_special_tokens=False).ids)
    found = packing.certificate(out, 64)
    assert found["sequences"] == n and found["bound"] <= n <= found["bound"] * 1.02 + 1
    assert packing.best_fit_packing(df.limit(0), JSON).count() == 0


def test_encoder_is_the_tokenizer_for_every_character():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(JSON)
    mine = packing.Encoder(open(JSON, encoding="utf-8").read(), packing.SUPPORTED)
    texts = [f"a{chr(c)}1{chr(c)} {chr(c)}{chr(c)}!{chr(c)}  {chr(c)}b" for c in [*range(0x3400), *range(0xA000, 0xAC00), *range(0xF900, 0x10000, 3), *range(0x10000, 0x110000, 101)]]
    for text, want in zip(texts, whole.encode_batch(texts, add_special_tokens=False)):
        assert mine.encode(text).tolist() == want.ids


def fewest(sizes, capacity):
    """The fewest sequences, by trying everything."""
    best = len(sizes)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for room in set(rooms):
            if room >= sizes[i]:
                rest = list(rooms)
                rest.remove(room)
                place(i + 1, [*rest, room - sizes[i]])
        place(i + 1, [*rooms, capacity - sizes[i]])

    place(0, [])
    return best


def plain_best_fit(sizes, capacity):
    rooms = []
    for s in sorted(sizes, reverse=True):
        fit = [r for r in rooms if r >= s]
        if fit:
            rooms.remove(min(fit))
        rooms.append((min(fit) if fit else capacity) - s)
    return len(rooms)


def test_bounds_and_best_fit():
    for case in range(60):
        gen = random.Random(case)
        capacity = gen.choice([10, 13, 20])
        sizes = sorted((gen.randrange(1, capacity + 1) for _ in range(gen.randrange(1, 9))), reverse=True)
        counts = np.bincount(sizes, minlength=capacity + 1)
        optimum, bound = fewest(sizes, capacity), packing.lower_bound(counts, capacity)
        assert bound <= optimum
        by_document = packing.by_document(counts, capacity)
        assert sum(n for n, _ in by_document) == plain_best_fit(sizes, capacity)
        for patterns in (by_document, packing.by_sequence(counts, capacity)):
            used = collections.Counter()
            for n, inside in patterns:
                assert sum(s * t for s, t in inside) <= capacity
                for s, t in inside:
                    used[s] += n * t
            assert used == collections.Counter(sizes) and sum(n for n, _ in patterns) >= optimum
    assert packing.lower_bound(np.bincount([6] * 5 + [3] * 4, minlength=11), 10) == 5  # two of 6 never fit together
    assert packing.lower_bound(np.bincount([4] * 6, minlength=11), 10) == 3
    many = np.bincount([4] * 3, minlength=11) * 2**41
    assert packing.lower_bound(many, 10) == 3 * 2**40


def test_partitions_with_gaps_exchange(spark):
    gen = random.Random(2)
    lengths = [gen.choice([600, 512, 423, 341, 300, 83, 1024]) for _ in range(4000)]
    rows = spark.createDataFrame([(i, i, 0, 0, n, 0) for i, n in enumerate(lengths)], packing._PIECE)
    out = packing.best_fit(rows, 1024)
    counts = np.bincount(lengths, minlength=1025)
    found = packing.certificate(out, 1024)
    assert found["bound"] == packing.lower_bound(counts, 1024) <= found["sequences"]
    alone = min(sum(n for n, _ in f(counts, 1024)) for f in (packing.by_document, packing.by_sequence))
    assert found["sequences"] <= alone + 4 and out.count() == 4000  # four partitions, as good as one
