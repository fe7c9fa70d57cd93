"""Vector codes, hard negatives and quality rules against brute force, and their edges."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwright.llm import codes, hardneg, quality

VECTORS = "vec_id bigint, embedding array<float>, label bigint, code string, anchor bigint, block int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], label, "c", 1, 2) for i, v, label in rows], VECTORS)


def random_rows(n, dims, labels, seed=3, spread=0.4):
    rng = np.random.default_rng(seed)
    return [(i, rng.normal(0, spread, dims).tolist(), int(rng.integers(labels))) for i in range(n)]


def whole(v):
    return np.floor(np.asarray(v, np.float32).astype(float) * 256).astype(np.int64)


def test_masks_hold_the_nearest_entry_and_few_others():
    rng = np.random.default_rng(1)
    entries, points = rng.integers(-40, 40, (64, 4)), rng.integers(-60, 60, (3000, 4))
    entries[7] = entries[50]  # equally near: the first
    book = codes.Codebook(entries)
    d = ((points[:, None] - entries[None]) ** 2).sum(axis=2)
    entry, error = book.nearest(points)
    assert (entry == d.argmin(axis=1)).all() and (error == d.min(axis=1)).all()
    masks = book.candidates(points)
    held = ((masks[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(bool)
    assert held[np.arange(len(points)), d.argmin(axis=1)].all() and held.mean() < 0.3


def brute_codes(rows):
    kept = sorted((i, whole(v).tolist(), label) for i, v, label in rows)
    x = np.array([v for _, v, _ in kept])
    width = x.shape[1] // 16
    books = [x[:64, p * width : (p + 1) * width].copy() for p in range(16)]
    near = lambda p: ((x[:, None, p * width : (p + 1) * width] - books[p][None]) ** 2).sum(axis=2)
    for _ in range(2):
        new = [b.copy() for b in books]
        for p in range(16):
            e = near(p).argmin(axis=1)
            for k in set(e.tolist()):
                own = x[e == k, p * width : (p + 1) * width]
                new[p][k] = own.sum(axis=0) // len(own)
        books = new
    d = [near(p) for p in range(16)]
    code = ["".join(f"{a:02x}" for a in row) for row in np.stack([m.argmin(axis=1) for m in d], axis=1).tolist()]
    error = sum(m.min(axis=1) for m in d)
    by = Counter()
    for (_, _, label), e in zip(kept, error):
        by[label] += int(e)
    return [(i, c, int(e), by[label]) for (i, _, label), c, e in zip(kept, code, error)], codes.digest(books)


def test_codes_equal_brute_force(spark):
    rows = random_rows(400, 32, 5) + [(1000, [0.0] * 32, None), (1001, [0.25] * 32, None)]
    want, digest = brute_codes(rows)
    bad = [(2000, None, 1), (2001, [float("nan")] * 32, 1), (2002, [float("inf")] + [0] * 31, 1), (2003, [None] * 32, 1), (2004, [], 1), (2005, [1.0] * 16, 1)]
    got = codes.encoded(vectors(spark, rows + bad).repartition(5)).collect()
    assert sorted((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in got) == sorted(want)
    assert {r["codebooks_sha256"] for r in got} == {digest}


def test_codes_edges(spark):
    assert codes.encoded(vectors(spark, random_rows(3, 16, 2)).where("false")).collect() == []
    assert codes.encoded(vectors(spark, [(1, None, 1)])).collect() == []
    same = [(5, [1.0] * 16, None)] * 3 + [(None, [0.5] * 16, None)]
    got = codes.encoded(vectors(spark, same)).collect()
    assert sorted((r["vec_id"] or 0, r["error"], r["label_error"]) for r in got) == [(0, 0, 0), (5, 0, 0), (5, 0, 0), (5, 0, 0)]
    with pytest.raises(ValueError, match="equal parts"):
        codes.encoded(vectors(spark, [(1, [1.0] * 5, 1)]))


@pytest.mark.parametrize("dims,low,high", [(8, -3, 4), (13, -200, 200), (64, -40_000, 40_000), (5, 0, 1), (16, -(1 << 20), 1 << 20)])
def test_subset_sums_give_exact_scores(dims, low, high):
    rng = np.random.default_rng(dims)
    rows, anchors = rng.integers(low, high, (300, dims)), rng.integers(low, high, (40, dims))
    assert (hardneg.scores(rows, anchors) == rows @ anchors.T).all()


def brute_negatives(rows):
    out = []
    x = {i: whole(v) for i, v, _ in rows}
    for a, _, own in rows:
        if a % 50:
            continue
        ranked = sorted((-int(x[a] @ x[i]), i, label) for i, _, label in rows if i != a)
        for p, positive, _ in [r for r in ranked if r[2] == own][:5]:
            found = [(s, i) for s, i, label in ranked if label != own and 50 * -p <= 100 * -s <= 95 * -p][:3]
            out += [(a, positive, k + 1, i, -p, -s) for k, (s, i) in enumerate(found)]
    return sorted(out)


def test_negatives_equal_brute_force_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(hardneg, "CHUNK_ROWS", 90)
    monkeypatch.setattr(hardneg, "BLOCK_ANCHORS", 4)
    rows = random_rows(600, 12, 4, spread=0.02)  # few whole numbers, many ties
    rows += [(600 + i, v, (label + 1) % 4) for i, v, label in rows[:60]]
    want = brute_negatives(rows)
    bad = [(5000, None, 1), (5050, [float("nan")] * 12, 1), (5100, [1.0] * 12, None), (None, [1.0] * 12, 1), (5150, [], 1)]
    given = vectors(spark, rows + rows[:40] + bad)  # repeated rows count once
    got = hardneg.mined(given, F.col("vec_id") % 50 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert len(want) > 60 and sorted(map(tuple, got.collect())) == want


def test_negatives_edges(spark):
    anchor = F.col("vec_id") % 50 == 0
    assert hardneg.mined(vectors(spark, random_rows(3, 16, 2)).where("false"), anchor).collect() == []
    assert hardneg.mined(vectors(spark, [(1, [1.0] * 8, 1), (2, [1.0] * 8, 1)]), anchor).collect() == []  # no anchor
    assert hardneg.mined(vectors(spark, [(0, [1.0] * 8, 1), (2, [0.8] * 8, 2)]), anchor).collect() == []  # no positive
    # a positive below zero has no negatives; one id under two labels is never its own negative
    assert hardneg.mined(vectors(spark, [(0, [1.0] * 8, 1), (1, [-1.0] * 8, 1), (2, [-0.7] * 8, 2)]), anchor).collect() == []
    two = hardneg.mined(vectors(spark, [(0, [1.0] * 8, 1), (0, [0.7] * 8, 2), (1, [1.0] * 8, 1), (3, [0.7] * 8, 2)]), anchor).collect()
    assert {(r["positive_id"], r["negative_id"]) for r in two} == {(1, 3)}


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_rules(text):
    text = text or ""
    found = WORD.findall(text)
    windows = list(zip(found, found[1:], found[2:]))
    many = Counter(windows)
    again = {i + k for i, w in enumerate(windows) if many[w] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(found) < 50 or 100 * len(again) > 50 * len(found)
    return len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(again), failed


RULES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_rules_equal_brute_force(spark, sf_dir):
    edges = [None, "", " \t\n", "a b c a b c", "a b  c\x0bd\x0ce\x1cf", "x\nx\r\nx\n \nx", "a b c d a b c e b c d", "ш щ 中 文 😀 # é|", "w " * 300, "\n".join(["same line here"] * 40)]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(-1 - i, t) for i, t in enumerate(edges)], "doc_id bigint, text string")).withColumns({"kept": F.lit(1), "probability": F.lit("x")})
    want = {r["doc_id"]: brute_rules(r["text"]) for r in docs.collect()}
    got = quality.judged(docs, None).collect()
    assert {r["doc_id"]: tuple(r[c] for c in RULES) for r in got} == want
    assert all(r["probability"] is None and r["kept"] == (not r["base_failed"]) for r in got)


def test_hashed_margins_of_profile_and_pieces_agree(monkeypatch):
    rng = np.random.default_rng(2)
    model = quality.Model(rng.normal(size=quality.BUCKETS).astype(np.float32), 0.5)
    raw = ("Ünd the *** quick " * 40).encode()
    ids, distinct = quality.word_ids(raw.split())
    some, shares = quality.profile(raw, ids, distinct)
    whole_ = model.margin(raw, ids, distinct)
    assert abs(whole_ - (0.5 + (model.weights[some] * shares).sum())) < 1e-3
    monkeypatch.setattr(quality, "PIECE", 17)
    assert abs(whole_ - model.margin(raw, ids, distinct)) < 1e-6


def test_quality_on_documents_that_nothing_was_learned_from(spark):
    """Held-out accuracy over the labelled documents of the larger table; labels of one kind, or none, leave the rules."""
    at = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    learn = F.pmod(F.xxhash64("doc_id", F.lit(99)), F.lit(3)) != 0
    model = quality.learned(docs, labels.where(learn).union(labels.limit(1).selectExpr("cast(null as bigint)", "1", "0")))
    got = quality.judged(docs, model).join(labels.where(~learn), "doc_id").where(~F.col("base_failed")).collect()
    right = [(r["quality"] == 1) == r["kept"] for r in got]
    assert len(right) > 100 and np.mean(right) >= 0.98
    assert model.slope > 0
    assert quality.learned(docs, labels.where("quality = 1")) is None
    assert quality.learned(docs, labels.where("false")) is None
    assert quality.judged(docs.where("false"), model).count() == 0


def test_gradients_that_meet_the_driver_do_not_follow_the_splits(spark, monkeypatch):
    rows = spark.createDataFrame(
        [(float(i % 2), i % 5 == 0, np.array([i % 2, 2 + i % 14], np.int32).tobytes(), np.array([1, 0.5], np.float32).tobytes()) for i in range(60)],
        "good double, calibrates boolean, buckets binary, shares binary",
    )
    sent, collect = [], type(rows).collect
    monkeypatch.setattr(type(rows), "collect", lambda self: sent.append(collect(self)) or sent[-1])
    monkeypatch.setattr(quality, "STEPS", 2)
    models = []
    for splits in (1, 40, 90):  # of the last, some have no row
        sent.clear()
        models.append(quality.trained(rows.repartition(splits)))
        gradients = [x for x in sent if x and "total" in x[0]]
        assert len(gradients) == 2 and all(len(x) <= min(splits, quality.TASKS) for x in gradients)
    assert models[0].weights[1] > 0 > models[0].weights[0]
    for model in models[1:]:
        assert np.allclose(model.weights, models[0].weights, atol=1e-4) and abs(model.bias - models[0].bias) < 1e-6
