"""The corpus operators against brute force, and on nulls, empty and long texts, ties, repeats and clashing columns."""

import collections
import hashlib
import html
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionloom.llm import bpe, common, decontam, language, quality, repeats, secrets, simhash, url_rules, wrappers

DOCS = "doc_id long, text string"
rng = random.Random(11)
VOCABULARY = ["a", "b", "cc", "d é", "\n", "日本", "  x", "TOKEN=abcd1234", "😀"]


def mixed(n=150):
    """Short texts of few words, so that passages repeat, and the odd cases."""
    rows = [(i, "".join(rng.choice(VOCABULARY) + rng.choice([" ", ""]) for _ in range(rng.randrange(60)))) for i in range(n)]
    odd = [(900, None), (901, ""), (902, " \n\t"), (None, "a b " * 40), (None, "a b " * 40), (3, "a b " * 30), (903, "a" * 3000), (904, "b" + "a" * 500), (905, "x y z " * 3000)]
    return rows + odd


def frame(spark, rows, parts=3):
    """Rows with further columns, some named as the operators name theirs."""
    df = spark.createDataFrame(rows, DOCS).repartition(parts)
    return df.selectExpr("doc_id", "text", "1 AS shard", "'x' AS fp", "2 AS n_words", "3 AS n", "4 AS bin", "'k' AS blob", "5 AS rep", "6 AS `root`", "7 AS kept", "'z' AS spans", "8 AS held_out")


def by_id(rows):
    out = collections.defaultdict(list)
    for key, *rest in rows:
        out[key].append(tuple(rest))
    return {k: sorted(v, key=str) for k, v in out.items()}


def sha(b):
    return hashlib.sha256(b).hexdigest()


# --- repeated passages


def brute_words(rows, window):
    seen, out = set(), []
    for doc, words in [(i, (t or "").encode().split()) for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))]:
        gone = [False] * len(words)
        for p in range(len(words) - window + 1):
            key = tuple(words[p : p + window])
            if key in seen:
                gone[p : p + window] = [True] * window
            seen.add(key)
        out.append((doc, len(words), sum(gone), sha(b" ".join(w for w, g in zip(words, gone) if not g))))
    return out


def brute_bytes(rows, window):
    count, out = collections.Counter(), []
    texts = [(i, (t or "").encode()) for i, t in rows]
    for _, b in texts:
        count.update(b[p : p + window] for p in range(len(b) - window + 1))
    for doc, b in texts:
        gone = bytearray(len(b))
        for p in range(len(b) - window + 1):
            if count[b[p : p + window]] > 1:
                gone[p : p + window] = b"\1" * window
        runs = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out.append((doc, len(b), sum(gone), runs, sha(bytes(x for x, g in zip(b, gone) if not g))))
    return out


def bounds(monkeypatch, variants, unsplit, chunk):
    monkeypatch.setattr(repeats, "VARIANTS", variants)
    monkeypatch.setattr(repeats, "UNSPLIT", unsplit)
    monkeypatch.setattr(repeats, "CHUNK_BYTES", chunk)


def as_read(df):
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize(("window", "phrase", "variants", "unsplit", "chunk"), [(4, 2, 4, 2048, 500), (6, 6, 0, 1, 1 << 19), (1, 1, 1, 2, 100), (9, 2, 1, 1, 300), (8, 1, 2, 0.01, 1000)])
def test_substring_dedup(spark, monkeypatch, window, phrase, variants, unsplit, chunk):
    bounds(monkeypatch, variants, unsplit, chunk)
    df = frame(spark, mixed())
    got = repeats.substring_dedup(df, window=window, phrase=phrase, shard_bytes=2000)
    assert by_id(got.select("doc_id", "n", "n_removed", "kept_sha256").collect()) == by_id(brute_words(as_read(df), window))


@pytest.mark.parametrize(("window", "gram", "variants", "unsplit", "chunk"), [(12, 5, 4, 2048, 500), (9, 9, 0, 1, 1 << 19), (1, 1, 1, 2, 100), (20, 4, 1, 1, 300), (16, 1, 2, 0.01, 1000)])
def test_suffix_array_dedup(spark, monkeypatch, window, gram, variants, unsplit, chunk):
    bounds(monkeypatch, variants, unsplit, chunk)
    df = frame(spark, mixed(80))
    got = repeats.suffix_array_dedup(df, window=window, gram=gram, shard_bytes=2000)
    assert by_id(got.select("doc_id", "n", "n_removed", "n_spans", "kept_sha256").collect()) == by_id(brute_bytes(as_read(df), window))


def thue_morse(n):
    """Two texts over a and b, equal in no place, whose polynomial hashes modulo 2**64 agree from 1,024 on."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_words_whose_hashes_collide_are_told_apart(spark):
    same = " ".join(f"w{i}" for i in range(19))
    one, other = thue_morse(1024)
    got = repeats.substring_dedup(frame(spark, [(1, f"{same} {one}"), (2, f"{same} {other}"), (3, f"{same} {one}")])).collect()
    assert {r["doc_id"]: r["n_removed"] for r in got} == {1: 0, 2: 0, 3: 20}


def test_bytes_whose_hashes_collide_are_told_apart(spark):
    one, other = thue_morse(2048)
    rows = [(1, f"1{one}"), (2, f"2{other}"), (3, f"3{one}"), (4, f"4{other[:1500]}"), (5, "x" * 30)]
    got = repeats.suffix_array_dedup(frame(spark, rows), window=1400, gram=1100)
    assert by_id(got.select("doc_id", "n", "n_removed", "n_spans", "kept_sha256").collect()) == by_id(brute_bytes(rows, 1400))


def test_factors_rebuild_the_text():
    from sessionloom.llm.factors import Reference

    block = Reference(3)
    texts = [[rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randrange(40))] for _ in range(30)]
    seen: set[tuple] = set()
    for words in texts:
        parsed = block.parse(words)
        assert block.rebuild(parsed) == words and all(n >= 3 for _, n in (x for x in parsed if not isinstance(x, bytes)))
        hit = {i for s, e in block.spans(words) for i in range(s, e)}
        assert hit == {i for p in range(len(words) - 2) if tuple(words[p : p + 3]) in seen for i in range(p, p + 3)}
        block.add(words)
        seen.update(tuple(words[p : p + 3]) for p in range(len(words) - 2))


def test_factors_are_the_longest():
    from sessionloom.llm.factors import Reference

    block = Reference(3)
    block.add(list(map(bytes, [b"a", b"b", b"c", b"x"])))
    block.add([b"a", b"b", b"c", b"d", b"e", b"f"])
    assert block.parse([b"a", b"b", b"c", b"d", b"e", b"f"]) == [(5, 6)]
    for case in range(40):
        gen = random.Random(case)
        block, texts = Reference(2), [[gen.choice([b"a", b"b"]) for _ in range(gen.randrange(14))] for _ in range(6)]
        for words in texts:
            i = 0
            for x in block.parse(words):
                n = 1 if isinstance(x, bytes) else x[1]
                best = max((k for k in range(2, len(words) - i + 1) if any(block.words[p : p + k] == words[i : i + k] for p in range(len(block.words)))), default=1)
                assert n == best
                i += n
            block.add(words)


def test_suffix_order():
    from sessionloom.llm.rolling import BYTE_VALUES, Prefix, suffix_order, verified_order

    text = bytes(rng.choice(b"ab") for _ in range(600)) + b"c" * 40
    buf = np.frombuffer(text, dtype=np.uint8)
    start = np.arange(len(text) - 20)
    group = start % 2
    expected = sorted(start.tolist(), key=lambda i: (i % 2, text[i : i + 20], i))
    for by in (suffix_order, verified_order):
        for values in (BYTE_VALUES[buf], np.zeros(len(buf), dtype=np.uint64)):  # the second: all hashes collide
            if by is suffix_order and not values.any():
                continue
            order, lcp = by(Prefix(values), buf, start, group, 20)
            assert order.tolist() == expected
            for k in range(1, len(expected)):
                a, b = text[expected[k - 1] :][:20], text[expected[k] :][:20]
                same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), 20)
                assert lcp[k] == (same if expected[k - 1] % 2 == expected[k] % 2 else 0)


def test_spans_rebuild_the_text(spark):
    rows = [(1, "x" * 50 + "é" * 30), (2, "y" + "é" * 30)]
    for r in repeats.suffix_array_dedup(frame(spark, rows), window=20, gram=10).collect():
        text = dict(rows)[r["doc_id"]].encode()
        assert sha(repeats.apply_spans(text, r["starts"], r["ends"])) == r["kept_sha256"] and r["n_removed"] > 0


# --- near duplicates


def brute_components(rows):
    prints = [simhash.fingerprint(t) for _, t in rows]
    root = {f: f for f in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    distinct = sorted(root)
    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= 4:
                root[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for (doc, _), f in zip(rows, prints):
        if doc is not None:
            least[find(f)] = min(least.get(find(f), doc), doc)
    return [(doc, f"{f:016x}", least.get(find(f))) for (doc, _), f in zip(rows, prints)]


def near_rows():
    rows = []
    for k in range(120):
        words = [rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(60)]
        for _ in range(rng.randrange(4)):
            copy = list(words)
            copy[rng.randrange(60)] = "z"
            rows.append((1000 - len(rows), " ".join(copy)))
    return rows + [(5, None), (None, ""), (None, "q r s t u"), (None, "q r s t u"), (7, "ONE two"), (8, "one\tTWO"), (8, "one TWO")]


@pytest.mark.parametrize(("group", "hot"), [(4096, 1000), (10, 1)])
def test_simhash(spark, monkeypatch, group, hot):
    monkeypatch.setattr(simhash, "GROUP", group)
    monkeypatch.setattr(common, "HOT_ROWS", hot)
    rows = near_rows()
    got = simhash.simhash_dedup(frame(spark, rows)).collect()
    assert by_id(got) == by_id(brute_components(rows))


def test_fingerprint_of_words():
    import xxhash

    words = "the quick brown fox jumps".split()
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(2)]
    assert simhash.fingerprint("The  quick\nBROWN fox jumps") == hashes[0] & hashes[1]
    assert simhash.fingerprint("a b") == xxhash.xxh64_intdigest(b"a b", 42) and simhash.fingerprint(None) == 0


def test_trie_join_of_a_dense_group():
    gen = np.random.default_rng(0)
    fp = np.unique(np.array([0x123456789ABCDEF0 ^ sum(1 << int(b) for b in gen.choice(64, gen.integers(0, 6), replace=False)) for _ in range(400)], dtype=np.uint64))
    a, b = simhash.trie_join(fp, np.zeros(len(fp), dtype=np.int64))
    root = dict(zip(a.tolist(), b.tolist()))
    expected = {f: r for f, r in zip(fp.tolist(), brute_roots(fp.tolist()))}
    got = {f: root.get(f, f) for f in fp.tolist()}
    assert len({(got[f], expected[f]) for f in got}) == len(set(expected.values())) == len(set(got.values()))


def brute_roots(values):
    root = {f: f for f in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if (a ^ b).bit_count() <= 4:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(f) for f in values]


# --- benchmark passages


def brute_hits(docs, items):
    windows = collections.defaultdict(set)
    for item, text in items:
        w = decontam.words(text)
        for s in [tuple(w[i : i + 10]) for i in range(len(w) - 9)] if len(w) >= 10 else [tuple(w)] if w else []:
            windows[s].add(item)
    out = []
    for doc, text in docs:
        w, found = decontam.words(text), set()
        hit = [False] * len(w)
        for n in {len(k) for k in windows}:
            for p in range(len(w) - n + 1):
                key = tuple(w[p : p + n])
                if key in windows:
                    hit[p : p + n] = [True] * n
                    found |= windows[key] - {None}
        out.append((doc, len(w), sum(hit), len(found), sha(",".join(sorted(map(str, found))).encode()), any(hit)))
    return out


def brute_near(docs, items, slop=2):
    out = []
    for doc, text in docs:
        w = decontam.words(text)
        at = collections.defaultdict(set)
        for p, x in enumerate(w):
            at[x].add(p)
        near, exact = set(), set()
        for item, t in items:
            v = decontam.words(t)
            for s in [v[i : i + 10] for i in range(len(v) - 9)] if len(v) >= 10 else [v] if v else []:
                if any(w[p : p + len(s)] == s for p in range(len(w) - len(s) + 1)):
                    exact.add(item)
                if any(all(any(q in at[x] for q in range(p + k - slop, p + k + slop + 1)) for k, x in enumerate(s)) for p in range(-slop, len(w))):
                    near.add(item)
        out.append((doc, sorted(map(str, near - exact - {None}))))
    return out


@pytest.mark.parametrize(("block_bytes", "broadcast_bytes"), [(1 << 20, 1 << 20), (60, 1 << 20), (60, 1500)])
def test_decontaminate(spark, monkeypatch, block_bytes, broadcast_bytes):
    monkeypatch.setattr(decontam, "BROADCAST_BYTES", broadcast_bytes)
    some = ["a", "b", "C", "é", "--", "ß1"]
    docs = [(i, " ".join(rng.choice(some) for _ in range(rng.randrange(50)))) for i in range(150)] + [(3, "a b " * 6), (None, None), (7, ""), (8, "a b " * 4000)]
    docs += [(None, "a b c x y"), (None, "b c a x y"), (None, "x y a b c")]  # one id, equally many words
    items = [(i, " ".join(rng.choice(some) for _ in range(rng.choice([0, 3, 8, 11, 14])))) for i in range(25)] + [(None, "a b"), (90, None), (91, "a b c")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.decontaminate(frame(spark, docs), bench, block_bytes=block_bytes)
    assert by_id(got.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()) == by_id(brute_hits(docs, items))


def test_proximity(spark):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id long, text string")
    docs = [(1, "one two three four x five six seven eight nine ten"), (2, "ten nine eight seven six five four three two one"), (3, "ONE two, three four five six seven eight nine TEN!")]
    index = decontam.build_index(frame(spark, docs))
    got = {r["doc_id"]: (r["items"], r["near_items"]) for r in decontam.search_index(index, bench).collect()}
    assert got == {1: ([], ["1"]), 2: ([], []), 3: (["1"], [])}
    # the same index serves another test table
    other = spark.createDataFrame([(5, "four x five"), (6, "not there")], "item_id long, text string")
    assert {r["doc_id"]: r["items"] for r in decontam.search_index(index, other).collect()} == {1: ["5"], 2: [], 3: []}


def test_proximity_against_brute_force(spark):
    some = [f"w{i}" for i in range(14)]
    docs = [(i, " ".join(rng.sample(some, rng.randrange(1, 14)))) for i in range(120)]
    items = [(i, " ".join(rng.sample(some, rng.choice([2, 4, 11, 13])))) for i in range(30)]
    got = decontam.decontaminate(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    expected = brute_near(docs, items)
    assert by_id(got.selectExpr("doc_id", "near_items").collect()) == by_id(expected) and sum(len(x) for _, x in expected) > 50


# --- secrets

BRUTE = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 32),
]


def brute_secrets(rows):
    out = []
    for doc, text in rows:
        found = sorted((m.start(), k, m.end(), name) for k, (name, p, g, least) in enumerate(BRUTE) for m in p.finditer(text or "") if len(m[g]) >= least)
        joined = ",".join(f"{n}:{a}:{b}" for a, _, b, n in found)
        out.append((doc, *(sum(x[1] == k for x in found) for k in range(3)), sha(joined.encode())))
    return out


def secret_rows():
    some = ["token", "ToKen ", "paſſword=", "api_key", "=", ":", " ", '"', "'", "abcd1234", "AKIA", "ABCDEFGH1", "0123456789abcdef", "é", "😀", "\n"]
    rows = [(i % 50 if i < 60 else None, "".join(rng.choice(some) for _ in range(rng.randrange(30)))) for i in range(200)]
    return rows + [(900, None), (901, ""), (None, None), (902, "token=abcdefgh"), (903, "token=abcdefgh"), (904, "f" * 100_000)]


@pytest.mark.parametrize(("few", "hot"), [(500_000, 1000), (0, 2)])
def test_secrets_and_their_ledger(spark, tmp_path, monkeypatch, few, hot):
    monkeypatch.setattr(secrets, "BROADCAST_BLOBS", few)
    monkeypatch.setattr(common, "HOT_ROWS", hot)
    rows, ledger = secret_rows(), str(tmp_path / "ledger")
    blobs = {sha((t or "").encode()) for _, t in rows}
    df = frame(spark, rows)
    for _ in range(2):
        got = secrets.digest(secrets.scan_secrets(df, ledger)).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256").collect()
        assert by_id(got) == by_id(brute_secrets(rows))
        # a second run scans nothing
        assert sorted(r["blob"] for r in spark.read.parquet(f"{ledger}/findings").collect()) == sorted(blobs)
    # a later version of some documents: only its blobs are scanned
    later = [(i, (t or "") + " token=abcdefgh" if i == 7 else t) for i, t in rows]
    got = secrets.digest(secrets.scan_secrets(frame(spark, later), ledger)).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256").collect()
    assert by_id(got) == by_id(brute_secrets(later))
    new = {sha((t or "").encode()) for _, t in later} - blobs
    assert spark.read.parquet(f"{ledger}/findings").count() == len(blobs) + len(new)
    paths = secrets.read_paths(spark, ledger).collect()
    assert {(r["doc_id"], r["blob"]) for r in paths} == {(i, sha((t or "").encode())) for i, t in rows + later}
    assert {r["doc_id"] for r in paths if r["version"] == 2} == {7}
    other = secrets.RULES[:1]
    secrets.scan_secrets(df.limit(5), ledger, other).count()
    assert secrets.read_findings(spark, ledger).where(F.col("rule_version") == secrets.rule_version(other)).count() <= 5
    # what is appended twice counts once
    spark.read.parquet(f"{ledger}/findings").coalesce(1).write.mode("append").parquet(f"{ledger}/findings")
    assert secrets.scan_secrets(df, ledger).count() == len(rows)


@pytest.mark.parametrize("few", [100_000, 0])
def test_new_rules_scan_old_versions(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(secrets, "BROADCAST_BLOBS", few)
    ledger, key = str(tmp_path / "ledger"), "ghp_" + "z" * 36
    texts = [[(1, f"old {key}"), (2, "clean"), (None, None), (3, "clean")], [(1, "new text"), (2, "clean"), (4, f"other {key}")], [(1, "third"), (2, "now token=abcdefgh")]]
    old = secrets.RULES[:1]
    for rows in texts:
        secrets.update_ledger(frame(spark, rows), ledger, old)
    blobs = {sha((t or "").encode()) for rows in texts for _, t in rows}
    assert {r["blob"] for r in secrets.read_blobs(spark, ledger).collect()} == blobs
    assert few == 0 or secrets.read_blobs(spark, ledger).count() == len(blobs)
    paths = {(r["doc_id"], r["version"], r["blob"]) for r in secrets.read_paths(spark, ledger).collect()}
    told = [(1, 1, f"old {key}"), (1, 2, "new text"), (1, 3, "third"), (2, 1, "clean"), (2, 2, "now token=abcdefgh"), (3, 1, "clean"), (4, 1, f"other {key}"), (None, 1, "")]
    assert paths == {(i, v, sha(t.encode())) for i, v, t in told}
    # a new version of the rules needs no document: what is stored is scanned, once
    assert [secrets.rescan(spark, ledger), secrets.rescan(spark, ledger)] == [len(blobs), 0]
    found = {(r["doc_id"], r["version"]): [s["kind"] for s in r["spans"]] for r in secrets.findings_of_paths(spark, ledger).collect()}
    assert found == {(i, v): ["github"] * (key in t) + ["assign"] * ("token=" in t) for i, v, t in told}
    assert secrets.findings_of_paths(spark, ledger, old).count() == len(told)


def test_added_rules_and_redaction(spark, tmp_path):
    text = "é key ghp_" + "z" * 36 + " and token: zzzzzzzzzz; -----BEGIN PRIVATE KEY-----\nab\n-----END PRIVATE KEY----- end"
    df = spark.createDataFrame([(1, text), (2, None), (3, "clean")], DOCS)
    found = secrets.scan_secrets(df, str(tmp_path / "l"))
    got = {r["doc_id"]: r["t"] for r in df.join(found, "doc_id").select("doc_id", secrets.redact(F.col("text"), F.col("spans")).alias("t")).collect()}
    assert got == {1: "é key [SECRET] and [SECRET]; [SECRET] end", 2: None, 3: "clean"}
    assert secrets.digest(found).where("doc_id = 1").first()["spans"].startswith("github:6:46,assign:51:")


# --- quality


def brute_statistics(text):
    text = text or ""
    words = [w for w in re.split(r"[ \t\n\v\f\r]+", text) if w]
    windows = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^ \t\v\f\r]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_statistics(spark):
    rows = mixed() + [(1, "a\u00a0b #|\na\u00a0b #|\n \n \n"), (2, "w " * 9), (3, "a b c d e f g h " * 2 + "z")]
    got = quality.text_statistics(frame(spark, rows)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
    assert by_id(got) == by_id([(i, *brute_statistics(t)) for i, t in rows])


def test_block_distinct_reads_every_word():
    words = [b"%d" % i for i in range(50)]
    assert quality.block_distinct(words) == 1.0 and quality.block_distinct(words + [b"x"] * 49) == (1.0 + 2 / 50) / 2
    assert quality.block_distinct(words + words) == 1.0 and quality.block_distinct([]) == 0.0 and quality.block_distinct([b"a", b"a"]) == 0.5


def test_decision_list(spark):
    good = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "of", "to", "in"]) + str(rng.randrange(99)) for _ in range(60))) for i in range(120)]
    bad = [(1000 + i, " ".join(f"w{rng.randrange(99)}$$$" for _ in range(60))) for i in range(60)]
    labels = spark.createDataFrame([(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad] + [(None, 0), (5000, None)], "doc_id long, quality int")
    df = frame(spark, good + bad + [(1, None)])
    rules = quality.fit(df, labels)
    assert rules and all(len(r.tests) <= 4 for r in rules)
    got = {r["doc_id"]: r["kept"] for r in quality.quality_rules(frame(spark, good + bad), rules).collect()}
    assert all(got[i] for i, _ in good) and not any(got[i] for i, _ in bad)
    same = quality.with_verdict(spark.createDataFrame(good + bad, DOCS), rules).collect()
    assert {r["doc_id"]: r["__kept"] for r in same} == got
    assert quality.fit(df, labels.limit(0)) == [] and quality.quality_rules(frame(spark, [(1, None)]), []).first()["base_failed"]


# --- tokens


def test_byte_bpe(spark):
    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    assert public_tokenizers.PATTERN == bpe.SUPPORTED
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    some = list("abcdeABC'stllrevmd  \n\t\r\x0b\x1c\x1d\x85\u00a0\u2003\u3000012é日本😀\u0301#$%*½²")
    rows = [(i, "".join(rng.choice(some) for _ in range(rng.randrange(40)))) for i in range(1500)]
    rows += [(None, None), (1, ""), (2, "a" * 20000), (3, "don't  stop\n\nnow 12 <|endoftext|>"), (3, "don't")]
    got = bpe.byte_bpe(frame(spark, rows), path, public_tokenizers.PATTERN).collect()
    expected = []
    for i, t in rows:
        ids = other.encode_ordinary(t or "")
        expected.append((i, len(ids), sha(np.array(ids, dtype="<u4").tobytes()), sha((t or "").encode())))
    assert by_id(got) == by_id(expected)
    assert bpe.byte_bpe(frame(spark, [(1, "hello world")]), path, with_ids=True).first()["ids"] == other.encode_ordinary("hello world")


# --- languages


def test_language(spark):
    parts = {"en": "the thing and with ing er tion of", "de": "der die und sch ein heit lich ung", "fr": "les eau que ment oi eux été ç", "es": "los ción que mente ado ñ ería ll"}
    rows = [(i, " ".join(rng.choice(parts[lang].split()) for _ in range(rng.randrange(5, 40))), lang) for i, lang in enumerate(list(parts) * 60)]
    odd = [(1000, None, "en"), (1001, "", None), (1002, "123 !!", "en"), (None, "the thing", "de")]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").withColumn("score", F.lit(1)).withColumn("x", F.lit(1))
    model = language.fit(df)
    assert model.top.names == ["germanic", "romance"] and [v.names for v in model.within] == [["de", "en"], ["es", "fr"]]
    got = language.language_id(df, model)
    assert {r["doc_id"]: r["lang_pred"] for r in got.where("doc_id BETWEEN 1000 AND 1002").collect()} == {1000: "und", 1001: "und", 1002: "und"}
    held = got.where("held_out").join(df.select("doc_id", "lang"), "doc_id").where("doc_id < 1000").collect()
    assert len(held) > 20 and sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got.collect())
    assert language.fit(df.limit(0)) is None
    assert language.language_id(df.limit(1), None).first()["lang_pred"] == "und"
    import zlib

    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got.collect())


def test_language_sample_of_rows_without_an_id(spark):
    words = {"en": "the house and the tree", "de": "das haus und der baum"}
    rows = spark.range(10_000).selectExpr("cast(null AS long) AS doc_id", "if(id % 2 = 0, 'en', 'de') AS lang", f"concat(if(id % 2 = 0, '{words['en']}', '{words['de']}'), if(id < 9000, '', cast(id AS string))) AS text")
    model = language.fit(rows, max_sample=100)
    assert 10 <= model.n_rows <= 100
    same = rows.where("length(text) < 24").where("lang = 'en'")
    assert language.fit(same, max_sample=100).n_rows <= 100
    assert [r["lang_pred"] for r in language.language_id(spark.createDataFrame([(1, words["de"]), (2, words["en"])], DOCS), model).orderBy("doc_id").collect()] == ["de", "en"]


# --- urls


def brute_rule(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(r, v) for r, v in url_rules.RULES if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return host, path, max(fits, key=lambda f: len(f[0]), default=(None, None))


URLS = [None, "", "no scheme", "HTTP://EXAMPLE.COM/en/x?q=1", "http://WWW.Example.com/en/", "a://b://net/es/", "x://foo.net/es", "x://foo.net/es/?a#b", "x://com", "x://com/", "x://com?/", "x://é.ÀB.net/fr/\nq", "x://notnet/es/", "x:///en/", "x://foo.org/" + "a/" * 3000]


def test_url_rules(spark):
    rows = list(enumerate(URLS)) + [(1, ""), (1, ""), (None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'h' AS html", "1 AS host", "2 AS path", "3 AS token", "4 AS copies", "5 AS rule")
    labelled = spark.createDataFrame([(i, f"http://spam{i % 2}.org/buy/{i}", True) for i in range(40)] + [(50 + i, f"http://good.org/read/{i}", False) for i in range(40)] + [(99, None, None)], "page_id long, url string, bad boolean")
    got = url_rules.filter_urls(pages, labelled).select("page_id", "host", "path", "rule", "verdict").collect()
    expected = []
    for i, u in rows:
        host, path, (rule, verdict) = brute_rule(u)
        expected.append((i, host, path, rule, verdict or "allow"))
    assert by_id(got) == by_id(expected)
    new = spark.createDataFrame([(1, "https://other.org/buy/7?x=1"), (2, "https://other.org/read/7"), (3, "https://spam1.org/x"), (4, "http://shop.com/buy/1")], "page_id long, url string")
    assert {r["page_id"]: r["verdict"] for r in url_rules.filter_urls(new, labelled).collect()} == {1: "block", 2: "allow", 3: "block", 4: "allow"}
    assert url_rules.filter_urls(new, labelled.limit(0)).where("verdict = 'block'").count() == 0
    rules = url_rules.mine(labelled).collect()
    assert all(r["confidence"] == 1.0 for r in rules) and ["w:buy"] in [r["antecedent"] for r in rules]
    assert not any("w:buy" in r["antecedent"] and len(r["antecedent"]) > 1 for r in rules)  # no better than its part
    plan = url_rules.filter_urls(pages, labelled)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_url_rules_of_rarer_templates(spark, monkeypatch):
    words = {k: "/".join(k + c for c in "abcdefghij") for k in "xy"}
    urls = [(f"http://{k}.net/{words[k]}", True) for k in "xy" for _ in range(20)] + [("http://c.net/late", True)] * 15 + [("http://good.net/fine", False)] * 60 + [("http://good.net/even/odd", True)] * 18 + [("http://good.net/even", False)] * 10 + [("http://good.net/odd", False)] * 10 + [("http://c.net/few", True)] * 5
    labelled = spark.createDataFrame([(i, u, b) for i, (u, b) in enumerate(urls)], "page_id long, url string, bad boolean")
    new = spark.createDataFrame([(1, "http://z.org/late"), (2, "http://z.org/xj"), (3, "http://z.org/fine"), (4, "http://z.org/even"), (5, "http://z.org/odd/even"), (6, "http://z.org/few")], "page_id long, url string")
    for bound in (5000, 0):
        monkeypatch.setattr(url_rules, "BROADCAST_RULES", bound, raising=False)
        assert {r["page_id"]: r["verdict"] for r in url_rules.filter_urls(new, labelled).collect()} == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "block", 6: "allow"}


def test_noise_gives_no_url_rule(spark):
    noise = random.Random(5)
    urls = [f"http://h{noise.randrange(30)}.{noise.choice(['com', 'org'])}/{noise.choice('abcdefgh')}/{noise.choice('ijklmn')}?{noise.choice('opq')}=1" for _ in range(1500)]
    labelled = spark.createDataFrame([(i, u, noise.random() < 0.3) for i, u in enumerate(urls)], "page_id long, url string, bad boolean")
    assert url_rules.mine(labelled, min_confidence=0.4).count() == 0
    planted = labelled.unionByName(labelled.limit(200).selectExpr("page_id + 5000 AS page_id", "concat(url, '&spam=1') AS url", "true AS bad"))
    assert [r["antecedent"] for r in url_rules.mine(planted).collect()] == [["q:spam"]]


def brute_rules(rows, min_support, min_confidence):
    """The rules, by trying every combination. rows: (tokens, bad)."""
    import itertools
    import math

    total, n_bad = len(rows), sum(bad for _, bad in rows)
    least, base = max(math.ceil(min_support * total), url_rules.MIN_ROWS), n_bad / total
    places = collections.defaultdict(set)
    for i, (tokens, _) in enumerate(rows):
        for t in tokens:
            places[t].add(i)
    bad = {i for i, (_, b) in enumerate(rows) if b}
    alike = collections.defaultdict(list)
    for t, where in places.items():
        if len(where & bad) >= least:
            alike[frozenset(where)].append(t)
    items = {min(ts): where for where, ts in alike.items() if not where <= bad}
    names = {min(ts): sorted(ts) for ts in alike.values()}
    tried, found = len(alike), {}
    for size in range(1, len(items) + 1):
        for combo in itertools.combinations(sorted(items), size):
            where = frozenset.intersection(*(items[t] for t in combo))
            if len(where) >= least:
                tried += 1
                hits = len(where & bad)
                if hits >= least and hits / len(where) >= min_confidence:
                    found[combo] = (hits / len(where), hits)

    def beyond(confidence, hits):
        good = 1 - confidence
        apart = confidence * math.log(confidence / base) + (good * math.log(good / (1 - base)) if good else 0)
        return confidence > base and hits / confidence * apart >= math.log(tried / url_rules.CHANCE)

    found = {c: r for c, r in found.items() if beyond(*r)}
    kept = {c: r for c, r in found.items() if not any(set(p) < set(c) and found[p][0] >= r[0] for p in found)}
    out = {(tuple(tuple(names[t]) for t in c), round(r[0], 9)) for c, r in kept.items()}
    sure = {t: len(where) for where, ts in alike.items() if where <= bad for t in ts}
    return out | {(((t,),), 1.0) for t, n in sure.items() if beyond(1.0, n)}


@pytest.mark.parametrize("case", range(3))
def test_mined_rules_are_all_rules(spark, case):
    gen = random.Random(case)
    rows = []
    for i in range(400):
        keys = [k for k in "abcdef" if gen.random() < (0.9 if case == 0 else 0.5)]
        bad = gen.random() < (0.9 if {"a", "c"} <= set(keys) or "f" in keys and case == 1 else 0.15)
        twin = "t1&t2" if "b" in keys else "z"
        rows.append((i, f"http://h{i % 3}.org/p{'/x/y' if bad and i % 5 == 0 else ''}?{'&'.join(keys)}&{twin}", bad))
    labelled = spark.createDataFrame(rows, "page_id long, url string, bad boolean")
    tokens = {r["page_id"]: r["t"] for r in url_rules.split_url(labelled).select("page_id", url_rules.url_tokens().alias("t")).collect()}
    got = url_rules.mine(labelled, 0.02, 0.6).collect()
    have = {(tuple(sorted(tuple(sorted(x)) for x in r["lists"])), round(r["confidence"], 9)) for r in got}
    want = {(tuple(sorted(lists)), c) for lists, c in brute_rules([(tokens[i], bad) for i, _, bad in rows], 0.02, 0.6)}
    assert have == want and want


def test_correlated_tokens_do_not_explode(spark):
    import time

    gen = random.Random(1)
    keys = [f"k{j}" for j in range(14)]
    rows = [(i, "http://x.net/b?" + "&".join(k for k in keys if gen.random() > 0.03), gen.random() < 0.9) for i in range(300)] + [(300 + i, f"http://y.org/c{i}", False) for i in range(300)]
    began = time.time()
    assert url_rules.mine(spark.createDataFrame(rows, "page_id long, url string, bad boolean")).count() > 0
    assert time.time() - began < 120


def test_many_rows_of_one_url(spark):
    pages = spark.range(10_000).selectExpr("cast(null AS long) AS page_id", "'http://example.com/en/1' AS url")
    got = url_rules.filter_urls(pages, spark.createDataFrame([], "page_id long, url string, bad boolean"))
    assert [tuple(r) for r in got.groupBy("rule", "verdict").count().collect()] == [("example.com/en/", "block", 10_000)]


def test_url_rules_of_late_tokens(spark):
    long = "/".join("abcdefghijklmnop")
    urls = [(f"http://s.net/{long}/buy?k=1", True)] * 20 + [(f"http://s.net/{long}/read?ok=1", False)] * 20 + [("http://t.net/gift", True)] * 8 + [(f"http://s.net/{long}/gift", False)] * 8
    labelled = spark.createDataFrame([(i, u, b) for i, (u, b) in enumerate(urls)], "page_id long, url string, bad boolean")
    new = spark.createDataFrame([(1, "http://z.org/buy"), (2, "http://z.org/?k=2"), (3, "http://z.org/read"), (4, "http://z.org/gift")], "page_id long, url string")
    assert {r["page_id"]: r["verdict"] for r in url_rules.filter_urls(new, labelled).collect()} == {1: "block", 2: "block", 3: "allow", 4: "allow"}


# --- pages


def page(body, n=0):
    return f'<!DOCTYPE html><html><head><title>t{n}</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><ul><li><a>Home</a></li><li><a>Go</a></li></ul></nav><div class="ad">Buy {n}</div>{body}<footer>&copy; x</footer></body></html>'


def test_extraction_of_one_page():
    text = page("""<div class="sidebar">side</div><article><h1>A &amp; B</h1><p>one\n two<br>three <b>b</b>old<p>&lt;four&nbsp;&#233;<!-- no --><form><p>form</form>
<section class="comments"><p>reader</p></section><aside>x</aside></article><div id="cookie-notice">c</div>""")
    assert wrappers.extract(text) == "A & B\none two three bold\n<four é"
    assert [wrappers.extract(t) for t in (None, "", "<p>", "plain <i>t", "a < b & c > d <p")] == ["", "", "", "plain t", "a < b & c > d"]
    assert wrappers.extract("<main><p>m</p></main><p>rest</p>") == "m"
    assert wrappers.extract("<table><tr><td>a<td>b<tr><td>c</table><ul><li>d<li>e</ul>") == "a\nb\nc\nd\ne"


def test_wrapper_inference():
    bodies = ["<div id=c><h1>T1</h1><p>a</p><p>b</p></div>", "<div id=c><h1>T2</h1><p>c</p><table><tr><td>x</table></div>", "<div id=c><h1>T3</h1></div>"]
    wrapper = wrappers.infer([page(b, i) for i, b in enumerate(bodies)])
    pattern = wrapper.pattern()
    assert "(<table>" in pattern and "((<p>#TEXT</p>)+)?" in pattern and "<h1>#TEXT</h1>" in pattern and "(<li>" in pattern
    mixed = wrappers.infer(["<div><h2>a</h2><p>b</p><h2>c</h2><p>d</p><ul><li>e</ul></div>", "<div><h2>x</h2><ul><li>e</ul></div>"]).pattern()
    assert mixed == "<div>(((<h2>#TEXT</h2>)+)?((<p>#TEXT</p>)+)?)+(<ul><li>e</li></ul>)?</div>" or "<h2>#TEXT</h2>" in mixed


def plain_page(i, n=4):
    """A page without a telling tag or class; menu, notice and teasers are known by the other pages alone."""
    menu = "".join(f"<li><a href=/{w}>{w}</a></li>" for w in ("Start", "Topics", "About us"))
    teasers = "".join(f"<div class=k><a href=/{i}/{j}>Another story {i} {j}</a></div>" for j in range(3))
    body = f"<h1>Title {i}</h1><div class=lead>Lead {i}</div>" + "".join(f"<p>Paragraph {i} {j} of the text" for j in range(i % n + 1))
    return f"<html><body><div class=x1><ul>{menu}</ul></div><div class=x2>We keep small files on your machine</div><div class=x3>{body}</div><div class=x4>{teasers}</div><div class=x5>All rights kept</div></body></html>"


def plain_text(i, n=4):
    return "\n".join([f"Title {i}", f"Lead {i}", *(f"Paragraph {i} {j} of the text" for j in range(i % n + 1))])


def test_a_wrapper_tells_what_no_mark_tells():
    pages = [plain_page(i) for i in range(8)]
    wrapper = wrappers.Wrapper(wrappers.infer(pages))
    for i, p in enumerate(pages):
        assert wrappers.extract(p, wrapper) == plain_text(i)
        assert "small files" in wrappers.extract(p) and "Another story" in wrappers.extract(p)
    # nothing inside an article goes because pages share it
    inside = [f"<article><h1>T{i}</h1><h2>Method</h2><p>Body {i} says more than all that the pages share, and says it otherwise</p><div>By our own writer</div></article>" for i in range(9)]
    assert wrappers.extract(inside[0], wrappers.Wrapper(wrappers.infer(inside))) == "T0\nMethod\nBody 0 says more than all that the pages share, and says it otherwise\nBy our own writer"


def test_copies_of_an_article_keep_its_lede():
    pages = [f"<article><h1>T{i}</h1><p>Body {i} of a story</p></article>" for i in range(100)] + ["<article><h1>Copied</h1><p class=lede>The lede</p><p>Its body</p></article>"] * 6
    wrapper = wrappers.Wrapper(wrappers.infer(pages))
    assert wrappers.extract(pages[-1], wrapper) == "Copied\nThe lede\nIts body"
    # the same without an article element: what only copies share is no template text
    pages = [f"<div class=c><h1>T{i}</h1><p>Body {i} of a story</p></div>" for i in range(100)] + ["<div class=c><h1>Copied</h1><p class=lede>The lede</p><p>Its body</p></div>"] * 6
    spread = [wrappers.extract(p, wrappers.Wrapper(wrappers.infer(list(dict.fromkeys(pages))))) for p in pages]
    assert spread[-1] == "Copied\nThe lede\nIts body" and spread[3] == "T3\nBody 3 of a story"


def test_a_teaser_is_no_article():
    assert wrappers.extract("<main><h1>Main</h1><p>text</p><article class='teaser'>x</article></main>") == "Main\ntext"
    assert wrappers.extract("<main><h1>Main</h1><p>a long enough text</p><article>x</article></main>") == "Main\na long enough text\nx"
    assert wrappers.extract("<main><p>Home</p><article><h1>T</h1><p>The long text</p></article></main>") == "T\nThe long text"
    pages = [f"<div class=c><h1>T{i}</h1><p>One {i}</p><p>Two {i}</p></div><article class=teaser>More {i}</article>" for i in range(20)]
    wrapper = wrappers.Wrapper(wrappers.infer(pages))
    assert [wrappers.extract(p, wrapper) for p in pages] == [f"T{i}\nOne {i}\nTwo {i}" for i in range(20)]


def test_references_are_no_menu():
    body = lambda i: f"<div class=c><h1>T{i}</h1><p>Text {i}</p><ul class=refs>" + "".join(f"<li><a href=/{i}{k}>Source {i} {k}</a></li>" for k in range(4)) + "</ul></div>"
    pages = [body(i) for i in range(12)]
    wrapper = wrappers.Wrapper(wrappers.infer(pages))
    assert wrappers.extract(pages[2], wrapper) == "T2\nText 2\nSource 2 0\nSource 2 1\nSource 2 2\nSource 2 3"


def test_a_class_counts_as_a_whole():
    kept = ("form-of-government", "social-history", "related-work", "share-prices", "header-files", "search-theory", "comment-on-law")
    gone = ("ad", "ad-slot", "cookie-notice", "related-posts", "site-header", "share-buttons", "x newsletter", "comments", "nav_main", "widget-2", "search-form")
    for name in kept:
        assert wrappers.extract(f"<article><p>a</p><div class='{name}'>b</div><section id='{name}'>c</section></article>") == "a\nb\nc", name
    for name in gone:
        assert wrappers.extract(f"<article><p>a</p><div class='{name}'>b</div></article>") == "a", name


def test_a_wrapper_does_not_grow_with_the_pages():
    import time

    took, size = {}, {}
    for n in (1000, 4000):
        pages = [f"<div class='post-{i * 7919 % 99991:x}z'><h1>T{i}</h1><p>Body {i} which says a good deal more</p></div><div class=f>Fixed words of the host</div>" for i in range(n)]
        began = time.time()
        root = wrappers.infer(pages)
        took[n], size[n] = time.time() - began, len(root.pattern())
        assert wrappers.extract(pages[5], wrappers.Wrapper(root)) == "T5\nBody 5 which says a good deal more"
    assert took[4000] < 12 * took[1000] and size[4000] < 2 * size[1000]


def test_copies_tell_nothing():
    pages = [f"<div class=a>Story told on every page of this host</div><div class=b>{i}</div>" for i in range(6)]
    assert wrappers.extract(pages[0], wrappers.Wrapper(wrappers.infer(pages))) == "Story told on every page of this host\n0"


def test_no_text_is_left_behind():
    long = "".join(f"<p>Paragraph {i} of a long body</p>" for i in range(30))
    for body in ("<main><h1>H%d</h1><div class=content>" + long + "</div></main>", "<div class=post><h1>H%d</h1><div class=lead>Lead %d</div><div class=body>" + long + "</div></div>", "<h1>H%d</h1><article>" + long + "</article>"):
        pages = [page(body.replace("%d", str(i)), i) for i in range(3)]
        got = wrappers.extract(pages[0], wrappers.Wrapper(wrappers.infer(pages))).split("\n")
        assert got[0] == ("Paragraph 0 of a long body" if "<article>" in body else "H0") and got[-1] == "Paragraph 29 of a long body" and ("Lead 0" in got) == ("Lead" in body)


def test_deep_text_counts():
    deep = "<div class=intro>Intro</div>" + "<div>" * 300 + "<aside>side</aside><p>The article</p>" + "</div>" * 300
    assert wrappers.extract(page(deep), wrappers.Wrapper(wrappers.infer([page(deep)]))) == "Intro\nThe article"


@pytest.mark.parametrize("bound", [1 << 24, -1])
def test_templates_of_a_host(spark, monkeypatch, bound):
    monkeypatch.setattr(wrappers, "BROADCAST_BYTES", bound)
    common = [(i, f"http://h.org/{i}", page(f"<div class=content><h2>T{i}</h2><p>Body {i}</p></div>", i)) for i in range(60)]
    rare = [(100 + i, f"http://h.org/r{i}", page(f"<div class=content><p>Intro {i}</p></div><div class=story><p>Story {i}</p></div>", i)) for i in range(2)]
    plain = [(200 + i, f"http://p.org/{i}", plain_page(i)) for i in range(30)]
    got = {r["page_id"]: r["text"] for r in wrappers.extract_pages(spark.createDataFrame(common + rare + plain, "page_id long, url string, html string").repartition(3)).collect()}
    expected = {i: f"T{i}\nBody {i}" for i in range(60)} | {100 + i: f"Intro {i}\nStory {i}" for i in range(2)}
    assert got == expected | {200 + i: plain_text(i) for i in range(30)}


def test_pages(spark):
    texts = [[f"Title {i}"] + [f"Para {i} {j} &amp; more" for j in range(rng.randrange(1, 5))] for i in range(40)]
    rows = [(i, f"http://h{i % 3}.example.org/{i}", page("<article><h1>%s</h1>%s</article>" % (t[0], "".join(f"<p>{p}</p>" for p in t[1:])), i)) for i, t in enumerate(texts)]
    odd = [(100, "http://h0.example.org/n", None), (101, None, "<p>alone</p>"), (102, "", ""), (None, "http://h0.example.org/q", rows[0][2]), (0, rows[0][1], rows[0][2]), (103, "http://h1.example.org/z", "<div>" * 3000 + "deep")]
    df = spark.createDataFrame(rows + odd, "page_id long, url string, html string").selectExpr("*", "1 AS host", "2 AS path", "3 AS text", "4 AS n", "5 AS h")
    got = wrappers.extract_pages(df).collect()
    whole = {i: "\n".join(html.unescape(p) for p in t) for i, t in enumerate(texts)}
    expected = [(i, u, whole[i], len(whole[i])) for i, u, _ in rows]
    expected += [(100, odd[0][1], "", 0), (101, None, "alone", 5), (102, "", "", 0), (None, odd[3][1], whole[0], len(whole[0])), (0, rows[0][1], whole[0], len(whole[0])), (103, odd[5][1], "deep", 4)]
    assert by_id(got) == by_id(expected)


# --- empty tables


def test_empty_tables(spark, tmp_path):
    import public_tokenizers

    docs = frame(spark, [(1, "x")]).limit(0)
    bench = spark.createDataFrame([], "item_id long, text string")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    labelled = spark.createDataFrame([], "page_id long, url string, bad boolean")
    for out in (
        repeats.substring_dedup(docs),
        repeats.suffix_array_dedup(docs),
        simhash.simhash_dedup(docs),
        decontam.decontaminate(docs, bench),
        secrets.scan_secrets(docs, str(tmp_path / "l")),
        quality.quality_rules(docs, []),
        bpe.byte_bpe(docs, public_tokenizers.path("byte_bpe_50k.tiktoken")),
        language.language_id(docs, None),
        url_rules.filter_urls(pages, labelled),
        wrappers.extract_pages(pages),
    ):
        assert out.count() == 0
