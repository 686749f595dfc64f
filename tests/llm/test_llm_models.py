"""Tokeniser, mixing, search, classifiers and pipeline against brute force, round trips and held-out rows."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import struct
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_fixtures import dicts, frame, odd_texts, words

from ledgerloom.llm import bpe, langid, mixing, quality, topk, toxicity

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def reference():
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def own():
    return bpe.Codec(bpe.load_ranks(PATH), PATTERN)


# ---------------------------------------------------------------- byte-level BPE
@settings(max_examples=150, deadline=None)
@given(st.text(max_size=120))
def test_bpe_equals_the_library(own, reference, text):
    ids = np.frombuffer(own.encode(text), dtype="<u4").tolist()
    assert ids == reference.encode_ordinary(text)
    assert own.decode(ids) == text.encode()


def test_bpe_of_very_long_pre_tokens(own, reference):
    rng = random.Random(1)
    for text in ("a" * 30_000, "".join(rng.choice("abcé中") for _ in range(20_000)), "ab" * 10_000 + "!" * 5000):
        assert np.frombuffer(own.encode(text), dtype="<u4").tolist() == reference.encode_ordinary(text)


def test_bpe_piecewise(own, reference, monkeypatch):
    text = words(random.Random(2), 3000)
    monkeypatch.setattr(bpe, "PIECE", 1000)
    assert np.frombuffer(own.encode(text), dtype="<u4").tolist() == reference.encode_ordinary(text)


def naive_merge(ranks: dict[bytes, int], piece: bytes) -> list[bytes]:
    part = [piece[i:i + 1] for i in range(len(piece))]
    while True:
        pairs = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(part, part[1:])) if a + b in ranks]
        if piece in ranks or not pairs:
            return [piece] if piece in ranks else part
        i = min(pairs)[1]
        part[i:i + 2] = [part[i] + part[i + 1]]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("abc", min_size=2, max_size=5), unique=True, max_size=40), st.text("abc", max_size=60), st.integers(1, 3000), st.randoms())
def test_rank_queue_in_any_rank_table(tokens, piece, spread, rng):
    """Also in tables whose longer tokens rank before their parts; ranks lie in many words of the bitmap."""
    rng.shuffle(tokens)
    ranks = {t.encode(): spread * k for k, t in enumerate(["a", "b", "c", *tokens])}
    codec = bpe.Codec(ranks, PATTERN)
    assert [codec.tokens[i] for i in codec.merge(piece.encode())] == (naive_merge(ranks, piece.encode()) if piece else [])


def test_bpe_remembers_two_generations(reference, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 5)
    own, rng = bpe.Codec(bpe.load_ranks(PATH), PATTERN), random.Random(9)
    for _ in range(40):
        text = words(rng, 6, "abxyz")
        assert np.frombuffer(own.encode(text), dtype="<u4").tolist() == reference.encode_ordinary(text)
    assert own.older and len(own.packed) < 20


@pytest.mark.parametrize("ddl", ["doc_id long, text string"])
def test_bpe_and_mix_of_empty_tables(spark, ddl):
    assert bpe.digest(bpe.bpe_round_trip(spark.createDataFrame([], ddl), PATH, PATTERN)).count() == 0
    assert mixing.mix(frame(spark, [])).count() == 0


def test_bpe_query(spark, reference):
    texts = odd_texts()
    got = Counter(tuple(g.values()) for g in dicts(bpe.digest(bpe.bpe_decode(bpe.bpe_encode(frame(spark, texts), PATH, PATTERN), PATH, PATTERN))))
    want = Counter()
    for i, item in enumerate(texts):
        doc_id, text = item if isinstance(item, tuple) else (i, item)
        ids = reference.encode_ordinary(text or "")
        packed = struct.pack(f"<{len(ids)}I", *ids)
        want[doc_id, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()] += 1
    assert got == want


# ---------------------------------------------------------------- mixing
def plain_targets(sizes: dict, weights=(5.0, 2.0, 1.0), epochs=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    goal, full = {}, set()
    while True:
        rest = sum(sizes.values()) - sum(epochs * sizes[s] for s in full)
        open_ = [s for s in names if s not in full]
        total = sum(weight[s] for s in open_)
        goal = {s: float(epochs * sizes[s]) if s in full else rest * weight[s] / total for s in names}
        over = {s for s in open_ if goal[s] > epochs * sizes[s]}
        if not over:
            return goal
        full |= over


def test_mix(spark):
    rng = random.Random(4)
    texts = odd_texts() + [words(rng, rng.randint(0, 60)) for _ in range(150)]
    names = ["big", "a", "b", "Z", None, "tiny", "é"]
    df = frame(spark, texts, source=lambda i: names[0] if i % 3 else names[i % len(names)])
    got = dicts(mixing.mix(df))
    again = dicts(mixing.mix(df.repartition(5)))
    key = lambda g: (str(g["doc_id"]), str(g["source"]), g["size"], g["taken"], tuple(g["positions"]))
    assert sorted(map(key, got)) == sorted(map(key, again))
    rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
    sizes = Counter(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t in rows)
    assert Counter(g["size"] for g in got) == sizes
    total = defaultdict(int)
    taken = defaultdict(int)
    for g in got:
        total[g["source"]] += g["size"]
        taken[g["source"]] += g["taken"]
        assert 0 <= g["taken"] <= 3 * g["size"] and len(g["positions"]) <= 3
        assert g["positions"] == sorted(g["positions"]) and all(0 <= p <= 1 for p in g["positions"])
    goal = plain_targets(dict(total))
    for g in got:
        assert g["target"] == pytest.approx(goal[g["source"]]) and g["source_size"] == total[g["source"]]
    for s in total:
        assert abs(taken[s] - goal[s]) < 1.001
    placed = [g["positions"][0] for g in got if g["positions"]]
    assert placed == sorted(placed) and not any(g["positions"] for g in got[len(placed):])


def test_mix_fills_small_sources(spark):
    df = frame(spark, ["w " * 1000, "w " * 2, "w " * 3], source=lambda i: ["c", "a", "b"][i])
    got = {g["source"]: (g["target"], g["taken"]) for g in dicts(mixing.mix(df))}
    assert got["a"] == (6.0, 6) and got["b"] == (9.0, 9) and got["c"] == (990.0, 990)


def test_curriculum_inverts_the_integral(spark):
    df = frame(spark, [words(random.Random(i), 20) for i in range(400)], source=lambda i: "abc"[i % 3])
    got = dicts(mixing.mix(df))
    for source, (start, end) in zip("abc", mixing.RAMPS):
        own = [p for g in got if g["source"] == source for p in g["positions"]]
        share = np.mean([p <= 0.5 for p in own])
        assert share == pytest.approx(start * 0.5 + (end - start) * 0.125, abs=0.03)


# ---------------------------------------------------------------- search
def test_top_k(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(0, 0.2, 16).tolist()) for i in range(400)]
    rows += [(400 + i, rows[0][1]) for i in range(30)]  # one common vector
    rows += [(500, None), (550, []), (600, [float("nan")] * 16), (650, [None] + [0.1] * 15), (700, [float("inf")] * 16), (None, [0.1] * 16)]
    rows += [(100, rows[100][1]), (750, [1e30] * 16), (800, [3e5] * 16), (801, [-3e5] + [0.0] * 15), (802, [1e8] * 16)]
    df = spark.createDataFrame([(a, b, 1, 2, 3) for a, b in rows], "vec_id long, embedding array<double>, label int, cell int, block int")
    got = Counter(tuple(g.values()) for g in dicts(topk.top_k(df)))
    fine = [
        (i, [int(np.floor(256 * x)) for x in v]) for i, v in rows
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v)
    ]
    want = Counter()
    for q in {i for i, _ in fine if i % 50 == 0}:
        best: dict[int, int] = {}
        for x in (v for i, v in fine if i == q):
            for i, y in fine:
                if i != q:
                    score = max(-topk.LARGEST_SCORE, min(topk.LARGEST_SCORE, sum(a * b for a, b in zip(x, y))))
                    best[i] = max(best.get(i, -10**30), score)
        found = sorted((-score, i) for i, score in best.items())[:5]
        for rank, (minus, i) in enumerate(found, 1):
            want[q, rank, i, -minus] += 1
    assert got == want


def test_top_k_of_few_and_none(spark):
    ddl = "vec_id long, embedding array<float>"
    assert topk.top_k(spark.createDataFrame([], ddl)).count() == 0
    assert topk.top_k(spark.createDataFrame([(0, [1.0, 2.0])], ddl)).count() == 0
    got = dicts(topk.top_k(spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 0.0]), (50, [1.0, 1.0, 1.0])], ddl)))
    assert got == [{"query_id": 0, "rank": 1, "vec_id": 1, "score": 65536}]


def test_top_k_takes_large_components_and_ties(spark):
    ddl = "vec_id long, embedding array<double>"
    rows = [(0, [1.0, 2.0]), (1, [3.0, 1.0]), (2, [300000.0, 1.0]), (50, [1.0, 1.0]), (3, [3.0, 1.0])]
    got = {(g["query_id"], g["rank"]): (g["vec_id"], g["score"]) for g in dicts(topk.top_k(spark.createDataFrame(rows, ddl), k=3))}
    assert [got[0, r] for r in (1, 2, 3)] == [(2, 65536 * 300002), (1, 65536 * 5), (3, 65536 * 5)]
    assert [got[50, r] for r in (1, 2, 3)] == [(2, 65536 * 300001), (1, 65536 * 4), (3, 65536 * 4)]


def test_cover_is_a_partition_with_covering_radii():
    x = np.random.default_rng(6).normal(size=(3000, 8)) * 100
    order, sizes = topk.cover(x)
    assert sorted(order) == list(range(3000)) and sizes.sum() == 3000
    nodes = topk.Nodes.of(order, x[order], sizes)
    q = topk.Nodes.of(order[:0], x[:5], np.ones(5, dtype=int))
    top = topk.bounds(q.center, q.radius, nodes.center, nodes.radius)
    best = np.maximum.reduceat(x[:5] @ x[order].T, nodes.starts, axis=1)
    assert (top >= best).all()


# ---------------------------------------------------------------- classifiers
STEMS = {"xx": "abcdef", "yy": "ghijkl", "zz": "mnopqr"}


def speech(spark):
    rng = random.Random(7)
    langs = [rng.choice(list(STEMS)) for _ in range(300)]
    return frame(spark, [words(rng, rng.randint(3, 80), STEMS[x]) for x in langs], lang=lambda i: langs[i]), langs


def test_language_of_held_out_rows(spark):
    df, langs = speech(spark)
    model = langid.train(df.filter(~langid.held_out()))
    got = dicts(langid.identify(df, model))
    out = [g for g in got if crc32(str(g["doc_id"]).encode()) % 5 == 0]
    assert len(out) > 30 and all(g["lang_pred"] == langs[g["doc_id"]] for g in out)
    assert all(0 <= g["score"] <= 1 for g in got)


def test_language_of_odd_texts(spark):
    df, _ = speech(spark)
    model = langid.train(df)
    odd = frame(spark, odd_texts())
    got = dicts(langid.identify(odd, model))
    want = Counter("und" if not any(c.isalpha() for c in (t[1] if isinstance(t, tuple) else t) or "") else "ok" for t in odd_texts())
    assert Counter("und" if g["lang_pred"] == "und" else "ok" for g in got) == want
    assert {g["lang_pred"] for g in dicts(langid.identify(odd, langid.train(odd)))} == {"und"}
    assert langid.identify(frame(spark, []), model).count() == 0 and langid.train(frame(spark, [])) is None
    one = langid.train(df.filter("lang = 'xx'"))
    assert {g["lang_pred"] for g in dicts(langid.identify(df, one))} == {"xx"}
    assert all(g["lang_pred"] != "und" for g in dicts(langid.identify(langid.keep_recognised(odd, model), model)))


@pytest.mark.parametrize("n", [1, 2, 3, 5, 6, 12])
def test_codewords_are_apart(n):
    code = langid.codewords(n)
    assert set(np.unique(code)) <= {-1, 1}
    apart = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
    assert not apart or min(apart) >= (1 if n == 2 else 2)


def rude(spark, n=900):
    rng = random.Random(8)
    texts, labels = [], []
    for i in range(n):
        w = words(rng, rng.randint(20, 120)).split()
        toxic = i % 5 == 0
        for _ in range(3 if toxic else 0):
            w.insert(rng.randrange(len(w)), rng.choice(["vexwort", "zornling", "quarkig"]))
        texts.append(" ".join(w))
        labels.append((i, int(toxic), int(toxic)))
    return texts, labels


def test_toxicity_of_held_out_rows(spark):
    texts, labels = rude(spark)
    out = langid.held_out(folds=4, fold=2)
    got = dicts(toxicity.toxicity(frame(spark, texts), spark.createDataFrame(labels, "doc_id long, toxic int, label int"), ~out))
    held = [g for g in got if crc32(str(g["doc_id"]).encode()) % 4 == 2]
    right = sum((g["score"] >= 0.3) == (g["doc_id"] % 5 == 0) for g in held)
    assert len(got) == len(texts) and right >= 0.97 * len(held)
    assert all(0 <= g["score"] <= 1 for g in got)


def test_toxicity_does_not_see_held_out_labels(spark):
    texts, labels = rude(spark, 200)
    out = langid.held_out(folds=4, fold=2)
    flipped = [(i, 1 - t if crc32(str(i).encode()) % 4 == 2 else t, 0) for i, t, _ in labels]
    one, two = (
        sorted((g["doc_id"], g["score"]) for g in dicts(
            toxicity.toxicity(frame(spark, texts), spark.createDataFrame(rows, "doc_id long, toxic int, label int"), ~out)
        )) for rows in (labels, flipped)
    )
    assert [a for a, _ in one] == [a for a, _ in two] and np.allclose([s for _, s in one], [s for _, s in two])


def test_all_labels_but_the_fit_sample_are_counted(spark, monkeypatch):
    from pyspark.sql import functions as F

    texts, labels = rude(spark, 300)
    counted = []
    monkeypatch.setattr(toxicity, "SAMPLE", 10)
    monkeypatch.setattr(toxicity, "train", lambda rows: counted.append(rows.filter("label >= 0").count()))
    toxicity.toxicity(frame(spark, texts), spark.createDataFrame(labels, "doc_id long, toxic int, label int"), F.lit(True))
    assert counted == [290]


def test_toxicity_of_odd_texts(spark):
    texts, labels = rude(spark, 100)
    df = frame(spark, [(1000 + i, t[1] if isinstance(t, tuple) else t) for i, t in enumerate(odd_texts())] + [(i, t) for i, t in enumerate(texts)])
    rated = spark.createDataFrame([*labels, (1, None, 0), (None, 1, 0), (0, 1, 1)], "doc_id long, toxic int, label int")
    from pyspark.sql import functions as F

    got = dicts(toxicity.toxicity(df, rated, F.lit(True)))
    assert len(got) == len(odd_texts()) + 100 and all(0 <= g["score"] <= 1 for g in got)
    none = dicts(toxicity.toxicity(df, rated.filter("toxic = 0"), F.lit(True)))
    assert {g["score"] for g in none} == {0.0}
    assert toxicity.toxicity(frame(spark, []), rated, F.lit(True)).count() == 0


def test_shared_backoff_sums_to_one(spark):
    rng = random.Random(9)
    grams = {g for _ in range(20) for g in toxicity.grams(np.frombuffer(words(rng, 40).encode(), dtype=np.uint8)).tolist()}
    found = spark.createDataFrame([(g,) for g in grams], "gram long")
    mass = defaultdict(float)
    for r in toxicity.shared_backoff(found).collect():
        mass[r["tail"] >> 8] += r["shared"]
    assert mass and all(0 < m <= 1 + 1e-9 for m in mass.values())  # bytes that never follow have the rest


def graded(spark):
    rng = random.Random(10)
    texts, grades = [], []
    for i in range(300):
        g = i % 3
        w = words(rng, 60, STEMS["xx"]).split()
        for k in range(len(w)):
            if rng.random() < (0.9, 0.45, 0.0)[g]:
                w[k] = w[k].upper() + "!!"
        texts.append(" ".join(w))
        grades.append((i, g))
    return frame(spark, texts), spark.createDataFrame(grades, "doc_id long, grade int")


def test_quality_orders_held_out_rows(spark):
    df, ratings = graded(spark)
    out = langid.held_out()
    got = dicts(quality.rate(df, quality.train(df, ratings.filter(~out))))
    held = [g for g in got if crc32(str(g["doc_id"]).encode()) % 5 == 0]
    assert np.mean([abs(g["expected_grade"] - g["doc_id"] % 3) < 0.5 for g in held]) > 0.9
    assert all(0 <= g["tails"][1] <= g["tails"][0] <= 1 for g in got)


def test_quality_of_odd_texts(spark):
    df, ratings = graded(spark)
    model = quality.train(df, ratings)
    assert len(dicts(quality.rate(frame(spark, odd_texts()), model))) == len(odd_texts())
    assert quality.train(df, ratings.filter("grade = 1")) is None
    assert dicts(quality.rate(frame(spark, ["a"]), None)) == [{"doc_id": 0, "expected_grade": None, "tails": None}]
    assert quality.rate(frame(spark, []), model).count() == 0


def test_cuts_stay_ordered_and_the_gradient_is_right():
    rng = np.random.default_rng(11)
    rows = [(np.array([0, 1]), np.array([x, 1.0])) for x in rng.normal(size=600)]
    place = np.array([0 if r[1][0] < -0.5 else 1 if r[1][0] < 0.5 else 2 for r in rows])
    model = quality.fit(rows, place, [0, 1, 2])
    assert model.cuts[0] < model.cuts[1]
    score = np.array([model.weights[s] @ v for s, v in rows])
    assert np.mean((score[:, None] > model.cuts).sum(axis=1) == place) > 0.95


# ---------------------------------------------------------------- pipeline
def test_pipeline_on_odd_rows(spark):
    import corpus_pipeline

    rng = random.Random(12)
    base = [words(rng, 120, STEMS["xx"]) for _ in range(25)]
    texts = base + base[:5] + [b.replace(b.split()[60], "zz", 1) for b in base[5:10]] + odd_texts()
    docs = frame(spark, texts, lang=lambda i: "xx", source=lambda i: "s" if i % 2 else None)
    columns = docs.columns
    seen = []
    for name, step in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stage(step(spark, docs, ""), name)
        seen.append(docs)
        if name != "byte_bpe":
            assert docs.columns == columns
    known, exact, near, mixed, coded = seen
    assert known.filter("text is null or trim(text) = '' or text = '0123456789'").count() == 0
    assert exact.count() == exact.select("doc_id", "text").distinct().count()
    # Of an exact copy the largest id stays, of a near copy the smallest.
    ids = {r["doc_id"] for r in near.collect()}
    assert (ids - {0}) & set(range(35)) == set(range(5, 30))  # the odd rows have an id 0 of their own
    assert {r["doc_id"] for r in mixed.collect()} <= ids
    assert coded.count() == mixed.count()


def test_pipeline_without_labels_keeps_every_text_with_a_letter(spark):
    import corpus_pipeline

    rng = random.Random(13)
    texts = [words(rng, 30, STEMS["xx"]) for _ in range(10)] + ["x", None, "12", " "]
    kept = corpus_pipeline.keep_known_languages(spark, frame(spark, texts), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(11))


def test_pipeline_of_an_empty_table(spark):
    import corpus_pipeline

    docs = frame(spark, [])
    for name, step in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stage(step(spark, docs, ""), name)
    assert docs.count() == 0
