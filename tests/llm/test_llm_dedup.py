"""Exact, near, line and suffix dedup against brute force."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_fixtures import dicts, frame, odd_texts, words
from pyspark.sql import functions as F

from ledgerloom.llm import exact_dedup as exact
from ledgerloom.llm import line_dedup as line_dedup_module
from ledgerloom.llm.common import components
from ledgerloom.llm.jaccard import jaccard_join, prefix_length
from ledgerloom.llm.line_dedup import close, line_dedup, masks, simhashes, sketch
from ledgerloom.llm.shingles import shingles
from ledgerloom.llm.suffix_dedup import suffix_dedup


def sha(text) -> str:
    return hashlib.sha256((text or "").encode()).hexdigest()


# ---------------------------------------------------------------- exact
@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=300), st.binary(max_size=300))
def test_fingerprints_combine(a, b):
    powers = exact._powers(64)

    def of(data):
        return exact.fingerprint(np.frombuffer(data, dtype=np.uint8), powers, chunk=64)

    assert exact.combine(of(a), of(b)) == of(a + b)


def test_exact_dedup(spark):
    long = "x" * 200_000
    texts = [None, "", "a", "a", "b", (2, "a"), (9, "b"), (None, "b"), (None, "c"), long, long[:-1], (20, long), (3, "a")]
    got = dicts(exact.exact_dedup(frame(spark, texts)))
    rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    assert len(got) == len(rows)
    for text, ids in groups.items():
        own = [g for g in got if g["text_sha256"] == sha(text)]
        keep = max((i for i in ids if i is not None), default=None)
        assert sorted(str(g["doc_id"]) for g in own) == sorted(map(str, ids))
        assert {g["keep_id"] for g in own} == {keep} and {g["group_size"] for g in own} == {len(ids)}
        assert [g["doc_id"] for g in own if g["kept"]] == [keep]


def test_equal_fingerprints_of_different_texts_are_split(spark, monkeypatch):
    real = type(spark.range(0)).mapInArrow

    def collide(self, fn, schema):
        out = real(self, fn, schema)
        # Fingerprints that tell texts apart by their length only.
        return out.withColumn("h1", out["n"]).withColumn("h2", out["n"]) if "h1" in out.columns else out

    monkeypatch.setattr(exact, "_bitmap", lambda groups: b"\xff" * (exact.FILTER_BITS // 8))
    monkeypatch.setattr(type(spark.range(0)), "mapInArrow", collide)
    got = {g["doc_id"]: g["keep_id"] for g in dicts(exact.exact_dedup(frame(spark, ["ab", "cd", "ab", "efg"])))}
    assert got == {0: 2, 1: 1, 2: 2, 3: 3}


# ---------------------------------------------------------------- components
def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(110)] + [(300, k) for k in range(301, 340)]
    parent = list(range(400))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r["id"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---------------------------------------------------------------- near copies
def plain_shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_shingles_are_the_word_runs():
    for text in ("", "a", "A b\tc  d", "a b c d e", "a b c d e f a b c d e", words(random.Random(2), 300)):
        assert len(shingles(text)) == len(plain_shingles(text))


def test_prefix_is_shortened_until_the_recall_is_met():
    assert prefix_length(16, 10, 0.8, 0.995) == 5
    assert 1 - (1 - 0.8**5) ** 16 >= 0.995 > 1 - (1 - 0.8**6) ** 16


def test_jaccard_join(spark):
    rng = random.Random(3)
    texts = odd_texts()
    for _ in range(12):
        base = words(rng, 150).split()
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = "changed" + str(rng.randrange(99))
            texts.append(" ".join(copy))
    rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
    sets = [plain_shingles(t) for _, t in rows]
    group, links = list(range(len(rows))), Counter()

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
            links[i] += 1
            links[j] += 1
            group[find(j)] = find(i)
    members = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        members[find(i)].append(doc_id)
    want = Counter(
        (d, min((m for m in members[find(i)] if m is not None), default=None) if sets[i] else d, links[i])
        for i, (d, _) in enumerate(rows)
    )
    assert Counter((g["doc_id"], g["class_id"], g["n_links"]) for g in dicts(jaccard_join(frame(spark, texts)))) == want


def test_large_near_group_is_tiled(spark):
    rng = random.Random(4)
    base = words(rng, 120).split()
    texts = []
    for k in range(600):
        copy = list(base)
        copy[k % 120] = f"own{k}"
        texts.append(" ".join(copy))
    got = dicts(jaccard_join(frame(spark, texts)))
    sets = [plain_shingles(t) for t in texts]
    want = [sum(len(a & b) >= 0.8 * len(a | b) for b in sets) - 1 for a in sets[:5]]
    assert {g["class_id"] for g in got} == {0}
    assert [g["n_links"] for g in sorted(got, key=lambda g: g["doc_id"])[:5]] == want


# ---------------------------------------------------------------- lines
def test_masks_cover_every_three_bits():
    rng = random.Random(6)
    for _ in range(300):
        gone = sum(1 << b for b in rng.sample(range(64), 3))
        assert any(not (m & gone) for m in masks())
    assert len(masks()) == 20


def test_simhash_bits(spark):
    norm = "one two three two"
    lines = spark.createDataFrame([(0, 1, 2, norm), (5000, 1, 2, norm), (0, 3, 4, "")], "row long, k1 long, k2 long, norm string")
    (row,) = simhashes(lines).collect()
    hashes = [r[0] for r in spark.createDataFrame([(w,) for w in norm.split()], "w string").selectExpr("xxhash64(w)").collect()]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert row["sim"] & (2**64 - 1) == want


def _edit(a: list, b: list) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_line_dedup(spark):
    rng = random.Random(7)
    base = [words(rng, 40) for _ in range(6)]
    texts = ["\n".join(rng.sample(base, 3)) for _ in range(6)] + odd_texts()[:8] + [(50, "A  b\nc"), (50, "A  b\nc"), (None, "a B")]
    for line in base:  # a word replaced: near in words, mostly near in bits
        w = line.split()
        w[7] = "changed"
        texts.append((60, " ".join(w)))
    df = frame(spark, texts)
    got = dicts(line_dedup(df))
    rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
    assert len(got) == len(rows)
    norms = [[" ".join(x.lower().split()) for x in (t or "").split("\n")] for _, t in rows]
    distinct = sorted({x for n in norms for x in n if x})
    hashes = {
        r["norm"]: r["sim"] for r in simhashes(
            spark.createDataFrame([(0, i, i, x) for i, x in enumerate(distinct)], "row long, k1 long, k2 long, norm string")
        ).join(spark.createDataFrame(list(enumerate(distinct)), "k1 long, norm string"), "k1").collect()
    }
    root = {x: x for x in distinct}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in combinations(distinct, 2):
        if any(hashes[x] & m == hashes[y] & m for m in masks()):
            a, b = x.split(), y.split()
            if _edit(a, b) <= int(max(len(a), len(b)) * 0.2 + 1e-9):
                root[find(y)] = find(x)
    groups = {find(x) for x in distinct}
    kept = sum(len(g["kept_lines"]) for g in got)
    blanks = sum(not x for n in norms for x in n)
    assert kept == len(groups) + blanks
    assert sum(g["n_dropped"] + len(g["kept_lines"]) for g in got) == sum(g["n_lines"] for g in got) == sum(map(len, norms))
    assert len(groups) < len(distinct)
    first = [g for g in got if g["doc_id"] == 0 and g["n_lines"] == 3]
    assert first and first[0]["n_dropped"] == 0


def pairs_kept_apart(spark, pairs) -> int:
    """Of pairs of lines, each pair's own words, those whose second line stays."""
    got = dicts(line_dedup(frame(spark, [line for pair in pairs for line in pair]), runs=True))
    return sum(len(g["kept_lines"]) for g in got if g["doc_id"] % 2)


@pytest.mark.parametrize("n, changed", [(5, 1), (10, 1), (10, 2), (20, 4), (40, 8), (60, 1)])
def test_lines_at_the_similarity_are_found(spark, n, changed):
    """All pairs are linked by brute force: none is filtered by keys."""
    rng = random.Random(n)
    pairs = []
    for k in range(150):
        one = [f"w{rng.randrange(10**9)}" for _ in range(n)]
        two = list(one)
        for at in rng.sample(range(n), changed):
            two[at] = f"x{rng.randrange(10**9)}"
        assert _edit(one, two) <= n * 0.2
        pairs.append((" ".join(one), " ".join(two)))
    assert pairs_kept_apart(spark, pairs) <= 0.05 * len(pairs)


def test_short_lines_and_typos_are_found(spark):
    pairs = [
        ("copyright acme 2019", "copyright acme 2020"), ("page header one", "page header two"), ("chapter", "chaptar"),
        ("all rights reserved", "all rights reservde"), ("confidential", "confidentia1"),
        ("international telecommunication regulations", "internationel telecomunication regulation"),
    ]
    for x, y in pairs:
        assert _edit(list(x), list(y)) <= int(max(len(x), len(y)) * 0.2 + 1e-9)
    assert pairs_kept_apart(spark, pairs) == 0


def test_very_alike_lines_need_no_pair_each(spark):
    base = words(random.Random(8), 60).split()
    texts = []
    for k in range(300):
        own = list(base)
        own[k % 60] = f"v{k}"
        texts.append(" ".join(own))
    got = dicts(line_dedup(frame(spark, texts)))
    assert sum(len(g["kept_lines"]) for g in got) < 300


def test_a_common_phrase_is_no_reason_to_compare(spark, monkeypatch):
    """Lines that share one run of words only are not all compared; those that are alike beside it are found."""
    rng, compared = random.Random(11), []
    real = line_dedup_module._sized
    monkeypatch.setattr(line_dedup_module, "_sized", lambda *given: compared.append(real(*given)) or compared[-1])
    texts = []
    for _ in range(800):
        own = [f"w{rng.randrange(10**9)}" for _ in range(14)]
        at = rng.randrange(15)
        texts.append(" ".join([*own[:at], *"allrightsreserved bythecompanynamed here".split(), *own[at:]]))
    for k in range(0, 800, 80):
        near = texts[k].split()
        near[k % 3], near[-1 - k % 3] = "other", "another"
        texts.append(" ".join(near))
    got = dicts(line_dedup(frame(spark, texts), runs=True))
    assert sorted(g["doc_id"] for g in got if g["n_dropped"]) == list(range(800, 810))
    assert sum(pairs.count() for pairs in compared) < 20_000


def test_crowded_keys_are_made_up_for(spark, monkeypatch):
    """With hardly any line to a key the same lines are linked: brute force over words."""
    monkeypatch.setattr(line_dedup_module, "CROWD", 2)
    rng = random.Random(12)
    stock = [words(rng, 5) for _ in range(12)]
    lines = []
    for _ in range(60):
        one = " ".join([rng.choice(stock), words(rng, 4), rng.choice(stock)]).split()
        two = list(one)
        two[rng.randrange(len(two))] = "changed"
        lines += [" ".join(one), " ".join(two)]
    root = list(range(len(lines)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    def near(x, y):
        return _edit(x, y) <= int(max(len(x), len(y)) * 0.2 + 1e-9)

    for i, j in combinations(range(len(lines)), 2):
        if near(lines[i].split(), lines[j].split()) or near(list(lines[i]), list(lines[j])):
            root[max(find(i), find(j))] = min(find(i), find(j))
    got = {g["doc_id"] for g in dicts(line_dedup(frame(spark, lines), runs=True)) if g["kept_lines"]}
    assert got == {find(i) for i in range(len(lines))}


def test_hot_simhash_is_not_compared_by_pairs(spark, monkeypatch):
    """Lines in which one word prevails have one SimHash."""
    compared = []
    real = line_dedup_module._sized
    monkeypatch.setattr(line_dedup_module, "_sized", lambda *given: compared.append(real(*given)) or compared[-1])
    rng = random.Random(13)
    texts = ["| " * 9 + " | ".join(f"x{rng.randrange(10**9)}y{rng.randrange(10**9)}z" for _ in range(8)) for _ in range(500)]
    got = dicts(line_dedup(frame(spark, [*texts, texts[3] + "a"]), runs=True))
    assert [g["doc_id"] for g in got if g["n_dropped"]][-1:] == [500]
    assert sum(pairs.count() for pairs in compared) < 20_000


def test_only_lines_that_can_be_alike_are_measured(spark, monkeypatch):
    """Lines of few keys that share a phrase were all measured, as lengths alone were compared."""
    rng, compared = random.Random(17), []
    real = line_dedup_module._sized
    monkeypatch.setattr(line_dedup_module, "_sized", lambda *given: compared.append(real(*given)) or compared[-1])
    texts = ["fgjkmpqv bcfgjkmp " + words(rng, 14, rng.sample("etaoilnsrhdu", 4)) for _ in range(50)]
    got = dicts(line_dedup(frame(spark, [*texts, texts[7][:-1] + "."]), runs=True))
    assert [g["doc_id"] for g in got if g["n_dropped"]] == [50]
    assert sum(pairs.count() for pairs in compared) < 300


def test_close_denies_no_lines_within_the_similarity(spark):
    rng, rows = random.Random(18), []
    for k in range(600):
        one = list(words(rng, rng.randint(1, 45), "eaotinsrlhduö, x"[: rng.randint(2, 16)].replace(" ", "")))
        two = list(one)
        for _ in range(rng.randint(0, max(1, int(len(one) * 0.22)))):
            at = rng.randrange(len(two))
            two[at:at + rng.randint(0, 1)] = rng.choice(["", "e", "z", " ", "ö"])
            two = two or ["e"]
        rows.append((k, " ".join("".join(one).split()) or "e", " ".join("".join(two).split()) or "e"))
    df = spark.createDataFrame(rows, "k long, one string, two string")
    for name in ("one", "two"):
        df = df.withColumn(name, F.struct(F.size(F.split(name, " ")).alias("n"), F.length(name).alias("m"), *[c.alias(x) for x, c in sketch(F.col(name)).items()]))
    in_words, in_chars = close(lambda c: F.col(f"one.{c}"), lambda c: F.col(f"two.{c}"), 0.8)
    got = {r.k: (r.w, r.c) for r in df.select("k", in_words.alias("w"), in_chars.alias("c")).collect()}
    held = [0, 0]
    for k, one, two in rows:
        for kind, (x, y) in enumerate(((one.split(" "), two.split(" ")), (list(one), list(two)))):
            if _edit(x, y) <= int(max(len(x), len(y)) * 0.2 + 1e-9):
                held[kind] += 1
                assert got[k][kind], (one, two)
    assert min(held) > 50


# ---------------------------------------------------------------- suffix
def brute_spans(texts: list[bytes], n: int):
    seen = Counter(t[i:i + n] for t in texts for i in range(len(t) - n + 1))
    for t in texts:
        depth = np.zeros(len(t) + 1, dtype=int)
        for i in range(len(t) - n + 1):
            if seen[t[i:i + n]] > 1:
                depth[i] += 1
                depth[i + n] -= 1
        yield np.cumsum(depth[:-1]) > 0


def check_suffix(spark, texts):
    got = Counter(map(lambda g: tuple(g.values()), dicts(suffix_dedup(frame(spark, texts)))))
    rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
    raw = [(t or "").encode() for _, t in rows]
    want = Counter()
    for (doc_id, _), data, gone in zip(rows, raw, brute_spans(raw, 200)):
        left = np.frombuffer(data, dtype=np.uint8)[~gone].tobytes()
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        want[doc_id, len(data), int(gone.sum()), spans, hashlib.sha256(left).hexdigest()] += 1
    assert got == want


def test_suffix_dedup(spark):
    rng = random.Random(9)
    passages = [words(rng, 60) for _ in range(4)]
    texts = [t for t in odd_texts() if not (isinstance(t, str) and len(t) > 10_000)] + ["a" * 1000, "ab" * 130, "z" * 200, "z" * 201, "y" * 200]
    for _ in range(30):
        body = words(rng, rng.randint(20, 200))
        for p in rng.sample(passages, rng.randint(0, 2)):
            at = rng.randrange(len(body))
            lo, hi = rng.randrange(40), len(p) - rng.randrange(40)
            body = body[:at] + p[lo:hi] + body[at:]
        texts.append(body)
    near = words(rng, 300)
    for k in range(5):
        texts.append(near[:500 + k * 7] + "#" + near[500 + k * 7:])
    check_suffix(spark, texts)


def test_suffix_dedup_across_slices(spark):
    """A passage over the place where a long text is cut for hashing."""
    rng = random.Random(10)
    long = words(rng, 240_000, "abcdefghijklmnopqrstuvwxyz")
    assert len(long) > (1 << 20) + 1000
    cut = long[(1 << 20) - 300:(1 << 20) + 300]
    got = {r["doc_id"]: r["n_removed"] for r in dicts(suffix_dedup(frame(spark, [long, "#" + cut + "#", words(rng, 50)])))}
    assert got == {0: 600, 1: 600, 2: 0}


@pytest.mark.parametrize("run", [exact.exact_dedup, jaccard_join, line_dedup, suffix_dedup])
def test_empty_table(spark, run):
    assert run(frame(spark, [])).count() == 0
