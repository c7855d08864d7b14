from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlspike.llm import components, exact_dedup, ngram_join

SCHEMA = "doc_id long, text string, sig int, doc int, digest string, n int, old int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, 1, "x", 1, 1) for i, t in rows], SCHEMA)


def family(seed, n, words, edits):
    rnd = random.Random(seed)
    base = [f"w{rnd.randint(0, 4000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(rnd.randint(0, edits)):
            own[rnd.randrange(len(own))] = f"e{rnd.randint(0, 10**6)}"
        out.append(" ".join(own))
    return out


def brute(rows, n, percent):
    sets, links = {}, []
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                links.append((a, b))
                a2, b2 = root(a), root(b)
                up[max(a2, b2)] = min(a2, b2)
    return {i: (len(sets[i]), root(i)) for i in sets}, links


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80), (1, 50)])
@pytest.mark.parametrize("most", [ngram_join.MOST, 7])
def test_join_equals_brute_force(spark, n, percent, most):
    morse = ["".join("ab"[(k.bit_count() + flip) % 2] for k in range(2048)) for flip in (0, 1)]
    texts = [*morse, None, "", " \n", "One two", "one  TWO", "a b c d", "a b c d e", "x " * 5000]
    for seed, (size, words, edits) in enumerate([(25, 120, 8), (25, 40, 3), (10, 14, 1), (8, 700, 30), (12, 7, 1), (6, 3000, 90)]):
        texts += family(seed, size, words, edits)
    passage = " ".join(f"p{k}" for k in range(60))
    texts += [f"{passage} q{k} r{k} s{k}" for k in range(20)] + [f"h{k} {passage} {passage}" for k in range(10)]
    rows = [(3 * k + 5, t) for k, t in enumerate(texts)]
    random.Random(9).shuffle(rows)
    want, links = brute(rows, n, percent)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.similar_classes(frame(spark, rows), n, percent, most=most).collect()}
    assert got == want and len(links) > 50


def test_sets_that_share_a_passage_make_few_pairs(spark, monkeypatch):
    """Long documents with one passage in common share signatures, but next to no pair of them is verified."""
    rnd, passage = random.Random(3), " ".join(f"p{k}" for k in range(120))
    rows = [(k, " ".join(f"w{rnd.randint(0, 10**6)}" for _ in range(700)) + f" {passage} " + " ".join(f"w{rnd.randint(0, 10**6)}" for _ in range(700))) for k in range(150)]
    rows += [(1000 + k, rows[5][1] + " more" * k) for k in range(1, 40)]
    pairs, verified = [], ngram_join._verified

    def counted(got, *rest):
        got = got.cache()
        pairs.append(got.count())
        return verified(got, *rest)

    monkeypatch.setattr(ngram_join, "_verified", counted)
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.similar_classes(frame(spark, rows)).collect()}
    assert got == {k: 5 if k > 1000 else k for k, _ in rows} and sum(pairs) < 200


def test_signatures_are_shared_by_all_similar_sets():
    rnd = np.random.default_rng(4)
    for percent in (80, 85):
        own = ngram_join.schemes(percent)
        for size in [*range(1, 60), 100, 333, 1500]:
            for _ in range(6):
                a = rnd.integers(0, 2**63, size).astype(np.uint64)
                gone = rnd.integers(0, max(1, size // 6) + 1)
                b = np.unique(np.concatenate([a[gone:], rnd.integers(0, 2**63, rnd.integers(0, max(1, size // 6) + 1)).astype(np.uint64)]))
                a = np.unique(a)
                both = len(np.intersect1d(a, b))
                if both and 100 * both >= percent * (len(a) + len(b) - both) and len(a) + len(b) > 2 * both:
                    assert len(np.intersect1d(own.signatures(a), own.signatures(b)))


def test_sketch_never_exceeds_the_difference():
    rnd = np.random.default_rng(5)
    for _ in range(50):
        a, b = (rnd.integers(0, 2**63, rnd.integers(0, 900)).astype(np.uint64) for _ in "ab")
        own = ngram_join.Sketches([ngram_join.sketch(x) for x in (a, np.concatenate([a, b]))])
        assert own.distances(np.array([0, 1]), np.array([1, 0])).tolist() == 2 * [own.distances(np.array([0]), np.array([1]))[0]]
        assert own.distances(np.array([0]), np.array([1]))[0] <= len(b)


def test_null_ids_and_repeats(spark):
    rows = [(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (9, "a b c d e f"), (9, "other words of this id here")]
    got = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"]) for r in ngram_join.similar_classes(frame(spark, rows), 4, 85).collect())
    assert got[0] == (-1, 3, None) and {x[2] for x in got[1:]} == {7}
    assert ngram_join.one_of_each(frame(spark, rows[:4]), 4, 85).count() == 3
    assert ngram_join.similar_classes(frame(spark, []), 4, 85).count() == 0


def test_components(spark):
    rnd = random.Random(2)
    pairs = [(k, k + 1) for k in range(100, 160)] + [(1000, k) for k in range(300, 340)] + [(rnd.randint(500, 600), rnd.randint(500, 600)) for _ in range(60)] + [(5, 5), (None, 3)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    up = {}
    for a, b in pairs:
        if a is not None and a != b:
            for x in (a, b):
                up.setdefault(x, x)
            while up[a] != a:
                a = up[a]
            while up[b] != b:
                b = up[b]
            up[max(a, b)] = min(a, b)

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    assert got == {x: root(x) for x in up}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 5, 100, 20_000])
def test_fuse_filter(n):
    rnd = np.random.default_rng(n)
    keys = rnd.integers(0, 2**63, n).astype(np.uint64)
    made = exact_dedup.BinaryFuse.build(np.concatenate([keys, keys[: n // 2]]))
    assert made.has(keys).all()
    assert made.has(rnd.integers(0, 2**63, 50_000).astype(np.uint64)).mean() < 0.01


ROWS = [(1, "a b"), (2, "ab "), (3, "a\n\tb  "), (4, None), (5, ""), (6, " "), (7, "x"), (8, "A b"), (9, "x" * 20_000), (10, "x" * 20_000), (11, "a\xa0b"), (7, "x"), (None, "ab"), (None, "y"), *[(100 + k, "hot text") for k in range(300)]]


def expected(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i or 0, i))
    return {k: (min(g)[3], len(g)) for k, g in groups.items()}


@pytest.mark.parametrize("bits", [256, 4])
@pytest.mark.parametrize("snapshot", [None, "true", "false", "doc_id < 5"])
def test_exact_classes(spark, bits, snapshot):
    got = exact_dedup.classes(frame(spark, ROWS), snapshot and F.expr(snapshot), digest_bits=bits).collect()
    want = expected(ROWS)
    assert len(got) == len(ROWS)
    by_sha = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in want.items()}
    for r in got:
        assert (r["keep_id"], r["group_size"]) == by_sha[r["text_sha256"]]
    kept = [r["text_sha256"] for r in got if r["kept"]]
    assert sorted(kept) == sorted(by_sha)


def test_kept_rows(spark):
    rows = exact_dedup.kept_rows(frame(spark, ROWS))
    assert rows.columns == frame(spark, ROWS).columns
    assert sorted(re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "") for r in rows.collect()) == sorted(expected(ROWS))
    assert exact_dedup.kept_rows(frame(spark, [])).count() == 0
