"""The near-duplicate stage against all pairs by plain sets of five words."""

from __future__ import annotations

import numpy as np
import pytest

import corpus_pipeline
from sieveline.llm import near_copies, simhash
from tests.llm.test_operators import plain_fingerprint


def plain_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def plain_groups(rows):
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    s = [plain_set(t) for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            if s[i] == s[j] or 9 * len(s[i] & s[j]) >= 4 * (len(s[i]) + len(s[j])):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(rows))]


def corpus():
    rng = np.random.default_rng(3)
    rows = [(0, None), (1, ""), (2, "one two"), (3, "ONE two"), (4, "two one")]
    line = " ".join(f"license{i}" for i in range(30))
    for family, (n, copies) in enumerate(((100, 6), (100, 60), (20, 3), (400, 4), (60, 25))):
        base = [f"f{family}w{x}" for x in rng.integers(0, 500, n)]
        for c in range(copies):
            w = list(base)
            for at in rng.choice(n, rng.integers(0, max(n // 30, 2)), replace=False):
                w[at] = f"new{c}x{at}"
            rows.append((len(rows), " ".join(w) + (" " + line if family == 3 else "")))
    chain = [f"chain{x}" for x in range(120)]
    for k in range(8):  # each is similar to the next, the first not to the last
        rows.append((len(rows), " ".join(chain[k * 6 : k * 6 + 72])))
    for k in range(20):
        rows.append((len(rows), " ".join(f"own{k}w{x}" for x in range(60)) + " " + line))
    return rows


@pytest.mark.parametrize("few", [16, 1])
def test_all_pairs_are_found(spark, monkeypatch, few):
    monkeypatch.setattr(near_copies, "FEW", few)
    rows = corpus()
    got = {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == {d: rows[k][0] for (d, _), k in zip(rows, plain_groups(rows), strict=True)}


def test_bitmaps_rule_out_no_similar_pair():
    rng = np.random.default_rng(8)
    ruled_out = 0
    for n in (0, 1, 15, 17, 100, 130, 1000):
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        for share in (0.0, 0.3, 0.8, 0.95, 1.0):
            for m in (0, 1, n // 3, n):
                b = np.unique(np.concatenate([a[: int(share * len(a))], rng.integers(0, 1 << 63, m - int(share * m)).astype(np.uint64)]))
                shared = len(np.intersect1d(a, b))
                most = near_copies.most_shared(near_copies.bitmap(a), len(a), near_copies.bitmap(b), len(b))
                assert shared <= most <= min(len(a), len(b))
                ruled_out += n >= 100 and share == 0.3 and m == n and most * 9 < (len(a) + len(b)) * 4
    assert ruled_out == 3


def test_the_stage_asks_for_five_words_and_similarity(spark):
    words = [f"w{x}" for x in range(60)]
    far = next(t for t in (" ".join([*words[:at], "other", *words[at + 1 :]]) for at in (2, 3, 56, 57, 1, 58)) if (plain_fingerprint(t) ^ plain_fingerprint(" ".join(words))).bit_count() > 3)
    kept = corpus_pipeline.near_duplicate_stage(spark, spark.createDataFrame([(1, " ".join(words)), (2, far)], "doc_id long, text string"), "").collect()
    assert [r["doc_id"] for r in kept] == [1]


def test_keep_one_by_row(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(40)) for x in "ab")
    rows = [(1, a, "x"), (1, b, "y"), (1, b, "y"), (2, b, "z"), (None, a, "n")]
    d = spark.createDataFrame(rows, "doc_id long, text string, score string")
    kept = near_copies.keep_one(d)
    assert kept.columns == d.columns and sorted(map(tuple, kept.collect()), key=repr) == sorted([rows[0], rows[1], rows[4]], key=repr)
    assert near_copies.keep_one(d.filter("false")).count() == 0


def test_digest_keeps_a_row_of_each_component_under_one_id(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(40)) for x in "ab")
    rows = [(1, a), (1, b), (2, b), (None, a)]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, kept), key=repr) == sorted([rows[0], rows[1], rows[3]], key=repr)
