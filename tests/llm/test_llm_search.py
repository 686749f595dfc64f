"""Phrase mining, lexical search and nearest neighbours against brute force."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from compare import connect, differences
from llm_fixtures import dicts, frame, odd_texts, words

from ledgerloom.llm import collisions, lexical, phrases, queries, wordscan


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", ["op11_collocations", "op12_lexical_search"])
def test_sql_counterpart(name, spark, sf_dir, con):
    assert not differences(queries.QUERIES[name](spark, sf_dir), con, queries.ORACLES[name])


def lower(text) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# ------------------------------------------------------------ words of texts
def test_scan():
    texts = [None, "", "A  b\tÇ.d", "x", "..", "é"]
    got, row, run = wordscan.scan(pa.array(texts), phrases._KIND)
    assert got.to_pylist() == ["a", "b", "Ç", "d", "x", "é"]
    assert row.tolist() == [2, 2, 2, 2, 3, 5]
    assert [run[i] == run[i + 1] for i in range(5)] == [True, True, False, False, False]


def test_word_hashes_do_not_depend_on_the_batch():
    own = pa.array(["", "a", "ab", "ba", "b" * 5000, "é"])
    alone = np.concatenate([wordscan.word_hashes(own.slice(i, 1)) for i in range(len(own))])
    assert (wordscan.word_hashes(own) == alone).all() and len(set(alone.tolist())) == len(own)


def test_slices_keep_all_rows(monkeypatch):
    monkeypatch.setattr(wordscan, "SLICE", 10)
    batch = pa.RecordBatch.from_arrays([pa.array(["abc", None, "x" * 40, "", "abcdef", "abcdefg"])], ["text"])
    parts = list(wordscan.slices(batch))
    assert len(parts) == 2 and [t for p in parts for t in p.column("text").to_pylist()] == batch.column("text").to_pylist()


# -------------------------------------------------------------------- phrases
def collocations(rows, support=30, covered=80, best=2000):
    """Brute force over (lang, text)."""
    f, n, out = defaultdict(Counter), Counter(), []
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                f[lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    for lang, count in f.items():
        own = {p: a for p, a in count.items() if len(p) > 1 and a >= support}
        held = {p[i:i + s] for p, a in own.items() for s in range(2, len(p)) for i in range(len(p) - s + 1) if 100 * a >= covered * count[p[i:i + s]]}
        ranked = []
        for p, a in own.items():
            if p not in held:
                score, cut = min((2000000 * a // (count[p[:k]] + count[p[k:]]), k) for k in range(1, len(p)))
                ranked.append((-score, -a, " ".join(p).encode(), count[p[:cut]], count[p[cut:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(ranked)[:best], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return Counter(out)


def noisy(rng: random.Random) -> str:
    out = []
    for _ in range(rng.randint(0, 40)):
        out.append(rng.choice(["the Big red FOX jumps", "in  spite\tof", " "]) if rng.random() < 0.2 else f"w{int(rng.paretovariate(0.7))}")
        if rng.random() < 0.1:
            out.append(rng.choice(".,;:!?\n\r\x0b\x0c "))
    return " ".join(out)


def mined(spark, texts, langs, **options):
    docs = frame(spark, texts, lang=lambda i: langs[i])
    plain = [t[1] if isinstance(t, tuple) else t for t in texts]
    got = Counter(tuple(r) for r in phrases.collocations(docs, **options).collect())
    return got, collocations(list(zip(langs, plain)), options.get("support", 30))


@pytest.mark.parametrize("sample", [8, 400])
def test_collocations(spark, sample):
    """A sample of a few documents proposes too little; the expansion pass makes up for it."""
    rng = random.Random(1)
    texts = [noisy(rng) for _ in range(1500)] + odd_texts() * 3
    langs = [rng.choice(["en", "fr", None, "und"]) for _ in texts]
    got, want = mined(spark, texts, langs, sample=sample)
    assert got == want and len(want) > 100


def test_expansion_pass_counts_what_failed(spark, monkeypatch):
    """Nothing is proposed at all: words are the whole border, and all longer phrases come from the expansion."""
    rules = []
    real = phrases._count
    monkeypatch.setattr(phrases, "_count", lambda maps, rule, only=0: rules.append(rule) or real(maps, rule, only))
    monkeypatch.setattr(phrases, "LOWERED", 1e9)
    rng = random.Random(2)
    texts = [noisy(rng) for _ in range(400)]
    got, want = mined(spark, texts, ["en"] * 400)
    assert got == want and want and rules == ["propose"] * 3 + ["full", "expand"]


def test_no_expansion_where_all_was_proposed(spark, monkeypatch):
    rules = []
    real = phrases._count
    monkeypatch.setattr(phrases, "_count", lambda maps, rule, only=0: rules.append(rule) or real(maps, rule, only))
    rng = random.Random(3)
    texts = [noisy(rng) for _ in range(300)]
    got, want = mined(spark, texts, ["en"] * 300, sample=1)
    assert got == want and want and "expand" not in rules


def test_collocations_of_small_support_ties_and_none(spark):
    texts = ["a b c d e", "a b c d e", "A b, c d", "", None, "x" * 10_000 + " y"]
    got, want = mined(spark, texts, ["en", "en", "fr", None, None, "en"], support=1, sample=2)
    assert got == want and want
    assert phrases.collocations(frame(spark, [])).count() == 0


def test_score_is_exact_beyond_64_bits(spark):
    big = 10**16 + 7
    row = spark.range(1).select(phrases._score(*(phrases.F.lit(v) for v in (big, 3 * big + 1)))).first()
    assert row[0] == 2000000 * big // (3 * big + 1)


# ------------------------------------------------------------- lexical search
def searched(docs, items, best=50):
    """Brute force over (doc_id, text) and (item_id, text)."""
    def terms(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(text))

    known = [(i, Counter(t)) for i, t in ((i, terms(t)) for i, t in docs) if t]
    total, df = sum(c.total() for _, c in known), Counter(t for _, c in known for t in c)
    asked = defaultdict(set)
    for item, text in items:
        if item is not None:
            asked[item] |= set(terms(text))
    out = []
    for item, own in asked.items():
        hits = []
        for doc, c in known:
            m = 50 + (50 * c.total() * len(known)) // total
            score = sum(
                math.floor(1000 * math.log((2 * len(known) + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in own if t in c
            )
            if score > 0:
                hits.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank, h[3], -h[0]) for rank, h in enumerate(sorted(hits)[:best], 1)]
    return Counter(out)


ITEMS = "item_id long, text string, score long, item int, term string, m long"


def asked_for(spark, items):
    return spark.createDataFrame([(*i, 1, 1, "x", 1) for i in items], ITEMS)


@pytest.mark.parametrize("options", [{}, {"pairs": 40}])
def test_lexical_search(spark, monkeypatch, options):
    """In one set of queries and in several, with blocks smaller than a stratum."""
    monkeypatch.setattr(lexical, "BLOCK", 16)
    rng = random.Random(4)
    texts = [words(rng, rng.choice([3, 3, 20, 200]), "aBc") for _ in range(400)] + odd_texts() + ["same words Here"] * 120
    items = [(k, words(rng, rng.randint(1, 12), "abC")) for k in range(30)] + [(40, "same same here"), (41, ""), (42, None), (None, "same"), (3, "other words")]
    got = Counter(tuple(r) for r in lexical.lexical_search(frame(spark, texts), asked_for(spark, items), **options).collect())
    rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
    assert got == searched(rows, items) and len(got) > 500


def test_lexical_search_of_none(spark):
    assert lexical.lexical_search(frame(spark, []), asked_for(spark, [(1, "a")])).count() == 0
    assert lexical.lexical_search(frame(spark, ["a b"]), asked_for(spark, [])).count() == 0
    assert lexical.lexical_search(frame(spark, [None, "..."]), asked_for(spark, [(1, "a")])).count() == 0


def test_blocks_below_the_floor_are_not_visited(spark, monkeypatch):
    """A rare term held by short documents only: blocks of common words alone cannot reach the floor."""
    monkeypatch.setattr(lexical, "BLOCK", 8)
    rng = random.Random(5)
    texts = ["rare find here"] * 60 + [" ".join(rng.choice("abcdefgh") for _ in range(60)) for _ in range(300)]
    visited = []
    real = type(spark.range(0)).mapInArrow

    def watch(self, fn, schema):
        if schema == lexical._HITS:
            visited.append(self)
        return real(self, fn, schema)

    monkeypatch.setattr(type(spark.range(0)), "mapInArrow", watch)
    items = [(1, "rare find a")]
    got = Counter(tuple(r) for r in lexical.lexical_search(frame(spark, texts), asked_for(spark, items)).collect())
    assert got == searched(list(enumerate(texts)), items)
    index = visited[-1]
    floor = min(s for _, _, _, s in got)
    bounds = [r["bounds"][0] for r in index.select("bounds").collect()]
    assert sum(b >= floor for b in bounds) < len(bounds) / 2


# --------------------------------------------------------- nearest neighbours
def neighbours(rows, k=10, every=100):
    """Brute force over (id, vector)."""
    clean = [(i, np.array(v, dtype=np.float64)) for i, v in rows if i is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    out = {}
    for q, x in clean:
        if q % every == 0:
            for i, y in clean:
                if i != q and len(x) == len(y):
                    gap = float(np.sqrt(((x - y) ** 2).sum()))
                    out.setdefault(q, {})
                    out[q][i] = min(gap, out[q].get(i, math.inf))
    return {q: sorted((g, i) for i, g in near.items())[:k] for q, near in out.items()}


DDL = "vec_id long, embedding array<double>, label int, dim int, block long, x string, bound double, score double"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, 3, "x", 1.5, 2.5) for i, v in rows], DDL)


def found(spark, rows, **options):
    got = defaultdict(list)
    for r in sorted(dicts(collisions.nearest(vectors(spark, rows), **options)), key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append((r["score"], r["vec_id"]))
        assert r["rank"] == len(got[r["query_id"]])
    return dict(got)


def share(got, want) -> float:
    pairs = [(q, i) for q, near in want.items() for _, i in near]
    return sum(i in {j for _, j in got.get(q, [])} for q, i in pairs) / len(pairs)


def test_recall_on_clusters_and_scattered_vectors(spark, monkeypatch):
    monkeypatch.setattr(collisions, "BLOCK", 32 * 1024)
    monkeypatch.setattr(collisions, "QUERIES", 32 * 10)
    rng = np.random.default_rng(1)
    x = rng.standard_normal((4000, 32))
    x[1000:3000] = x[rng.integers(0, 50, 2000)] + 0.1 * rng.standard_normal((2000, 32))
    rows = list(enumerate(x.tolist()))
    got, want = found(spark, rows), neighbours(rows)
    assert set(got) == set(want) and all(len(v) == 10 for v in got.values())
    assert share(got, want) >= 0.95
    for q, near in got.items():  # every distance is exact
        assert near == sorted(near)
        for gap, i in near:
            assert gap == pytest.approx(float(np.sqrt(((x[q] - x[i]) ** 2).sum())), rel=1e-14)


def test_registered_recall(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    got = defaultdict(list)
    for r in queries.QUERIES["op13_nearest"](spark, "/root/testdata/sf0.01").collect():
        got[r["query_id"]].append((r["score"], r["vec_id"]))
    assert share(got, neighbours(rows)) >= 0.9


def test_one_common_vector_ties_and_repeated_rows(spark):
    """Copies are at distance 0 of each other: the smallest ids win, and a repeated row counts once."""
    rows = [(i, [0.3, -0.7, 0.1]) for i in range(1, 1500)] + [(0, [0.3, -0.7, 0.1])] * 3 + [(2000, [9.0, 9.0, 9.0]), (3000, [9.0, 9.0, 9.5])] * 2
    got, want = found(spark, rows), neighbours(list({(i, tuple(v)) for i, v in rows}))
    assert got[0] == [(0.0, i) for i in range(1, 11)]
    assert got[2000][0] == (0.5, 3000) and set(got) == set(want)
    assert [i for _, i in got[100]] == [0, *range(1, 10)]


def test_few_odd_and_no_vectors(spark):
    odd = [None, [], [0.0, 0.0], [1.0, None], [1.0, math.nan], [math.inf, 1.0], [1.0, 2.0, 3.0]]
    rows = [(0, [1.0, 2.0]), (100, [1.0, 2.5]), (None, [1.0, 2.0]), (7, [5.0, 5.0]), (7, [1.0, 2.1]), (200, [0.0, 0.0]), *[(300 + k, v) for k, v in enumerate(odd)]]
    got, want = found(spark, rows), neighbours(rows)
    assert got == want and set(want) == {0, 100} and len(want[0]) == 2
    assert collisions.nearest(vectors(spark, [])).count() == 0
    assert found(spark, [(0, [1.0])]) == {}
    few = [(i, [math.sin(i), math.cos(i), i / 50]) for i in range(60)]
    assert share(found(spark, few), neighbours(few)) == 1.0


def test_windows_only_grow_and_cover_all_without_a_bound():
    rng = np.random.default_rng(3)
    block = collisions.Arrays.of(np.arange(300), rng.standard_normal((300, 8)))
    q = rng.standard_normal(8)
    rows, gaps = collisions.search(block, -1, q, 300, math.inf)
    assert sorted(rows.tolist()) == list(range(300)) and (np.diff(gaps) >= 0).all()
