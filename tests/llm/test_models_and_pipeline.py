from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from marlspike.llm import chat, classifiers, kdtree, mixing

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed, n, toxic_words=("vile", "rotten"), junk=False):
    """Documents of invented words; a fifth holds a toxic word, and if asked a fifth is shouted."""
    rnd = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    rows, labels = [], []
    for i in range(n):
        w = [rnd.choice(words) for _ in range(rnd.randint(5, 60))]
        toxic = i % 5 == 1
        bad = junk and i % 5 == 3
        if toxic:
            for _ in range(3):
                w[rnd.randrange(len(w))] = rnd.choice(toxic_words)
        if bad:
            w = [x.upper() + "!!" for x in w]
        rows.append((i, " ".join(w), "en", f"s{i % 3}", 1))
        labels.append((i, 0 if bad else 1, int(toxic)))
    return rows, labels


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_toxicity(spark):
    rows, labels = corpus(1, 600)
    rows += [(9000, None, "en", "s", 0), (9001, "", "en", "s", 0), (None, "vile vile", "en", "s", 0), (9002, "clean " * 30_000 + " Vile, rotten!", "en", "s", 0)]
    docs, marks = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels + [(1, None, None), (77_777, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in classifiers.toxicity(docs.withColumn("z", F.lit(1)).withColumn("y", F.lit(0)), marks).collect()}
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    test = [(i, t) for i, _, t in labels if held(i)]
    assert all(got[i]["held_out"] for i, _ in test) and sum(got[i]["predicted"] == t for i, t in test) >= 0.97 * len(test)
    assert got[9000]["predicted"] == 0 and got[9000]["score"] == got[9001]["score"] and got[9002]["predicted"] == 1
    kept = {r["doc_id"] for r in classifiers.without_toxic(docs, marks).collect()}
    assert kept == {i for i, r in got.items() if not r["predicted"]}


def test_toxicity_learns_nothing_from_held_out_rows(spark):
    rows, labels = corpus(2, 400)
    docs = spark.createDataFrame(rows, DOCS)
    flipped = [(i, q, 1 - t if held(i) else t) for i, q, t in labels]
    a, b = (classifiers.toxicity(docs, spark.createDataFrame(x, "doc_id long, quality int, toxic int")).orderBy("doc_id").toPandas() for x in (labels, flipped))
    assert np.allclose(a.score, b.score)


def test_classifiers_without_labels(spark):
    docs, none = spark.createDataFrame([(1, "a", "en", "s", 1)], DOCS), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [tuple(r) for r in classifiers.toxicity(docs, none).collect()] == [(1, False, 0.0, 0)]
    assert classifiers.quality(docs, none).first()["kept"]
    assert classifiers.toxicity(docs.limit(0), none).count() == 0 and classifiers.without_toxic(docs, none).count() == 1


def test_quality(spark):
    rows, labels = corpus(3, 700, junk=True)
    got = {r["doc_id"]: r for r in classifiers.quality(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    test = [(i, q) for i, q, _ in labels if held(i)]
    assert sum(got[i]["kept"] == bool(q) for i, q in test) >= 0.97 * len(test)
    grade = {k: np.mean([got[i]["expected_grade"] for i, q, t in labels if held(i) and (q, t) == k]) for k in ((0, 0), (1, 1), (1, 0))}
    assert grade[0, 0] < grade[1, 1] < grade[1, 0] and all(0 <= r["expected_grade"] <= 2 for r in got.values())


def test_toxicity_uses_no_label_of_clean_documents(spark):
    rows, labels = corpus(2, 400)
    docs, schema = spark.createDataFrame(rows, DOCS), "doc_id long, quality int, toxic int"
    a, b = (classifiers.toxicity(docs, spark.createDataFrame(x, schema)).orderBy("doc_id").toPandas() for x in (labels, [x for x in labels if x[2]]))
    assert np.allclose(a.score, b.score)
    given = classifiers.toxicity(docs, spark.createDataFrame(labels, schema), prior=0.2).toPandas()
    assert 0.1 < given.predicted.mean() < 0.3


def test_a_repeated_id_is_learnt_from_once(spark):
    rows, labels = corpus(6, 200)
    docs = spark.createDataFrame(rows + [rows[1]] * 300, DOCS)
    known = classifiers._labelled(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), "doc_id", F.col("toxic"))
    codes, y = classifiers._sampled(docs, known, 50, False, "doc_id", "text")
    assert len(codes) == len(y) == 50


def slopes(f, x, e=1e-6):
    return np.array([(f(x + e * d) - f(x - e * d)) / (2 * e) for d in np.eye(len(x))])


def test_nnpu_risk_against_sums_and_differences():
    rnd = np.random.default_rng(3)
    z, positive, prior = rnd.normal(size=30) * 2, np.arange(30) < 9, 0.3
    as_1, rest, up, down = classifiers.nnpu_risk(z, positive, prior)
    loss = lambda x, y: np.log1p(np.exp(-x if y else x))
    assert as_1 == pytest.approx(prior * np.mean([loss(x, 1) for x in z[positive]]))
    assert rest == pytest.approx(np.mean([loss(x, 0) for x in z[~positive]]) - prior * np.mean([loss(x, 0) for x in z[positive]]))
    assert np.allclose(up, slopes(lambda x: classifiers.nnpu_risk(x, positive, prior)[0], z), atol=1e-6)
    assert np.allclose(down, slopes(lambda x: classifiers.nnpu_risk(x, positive, prior)[1], z), atol=1e-6)


def test_nnpu_steps_back_where_the_negative_part_is_below_zero(monkeypatch):
    rnd, seen, risk = np.random.default_rng(4), [], classifiers.nnpu_risk
    codes = [np.unique(rnd.integers(0, 40, 6)).astype("<i4").tobytes() for _ in range(60)]
    sample = classifiers.Sample(codes, [1] * 30 + [0] * 30, least=1, clear=0, rare=0)

    def watched(*x):
        seen.append(risk(*x))
        return seen[-1]

    monkeypatch.setattr(classifiers, "nnpu_risk", watched)
    classifiers.fit_nnpu(sample, 0.9, decay=0)  # a prior that high overfits at once
    rest = np.array([x[1] for x in seen])
    assert (rest < 0).any() and rest[-100:].mean() > -0.1  # and is taken back


def test_prior_is_estimated():
    rnd = np.random.default_rng(5)
    for prior in (0.05, 0.3):
        scores = np.concatenate([rnd.normal(4, 1, 2000), rnd.normal(0, 1, int(8000 * (1 - prior))), rnd.normal(4, 1, int(8000 * prior))])
        assert abs(classifiers.estimated_prior(scores, np.arange(len(scores)) < 2000) - prior) < 0.03


def test_ordinal_loss_against_products_and_differences():
    rnd = np.random.default_rng(6)
    z, cuts, y = rnd.normal(size=25), np.array([-0.5, 0.1, 1.2]), rnd.integers(0, 4, 25)
    loss, by_row, by_cut = classifiers.ordinal_loss(z, cuts, y)

    def brute(z, cuts):
        above = lambda x, k: 1.0 if k < 0 else 0.0 if k >= len(cuts) else 1 / (1 + np.exp(cuts[k] - x))
        return -np.mean([np.log(above(x, g - 1) - above(x, g)) for x, g in zip(z, y, strict=True)])

    assert loss == pytest.approx(brute(z, cuts))
    assert np.allclose(by_row, slopes(lambda x: brute(x, cuts), z), atol=1e-6) and np.allclose(by_cut, slopes(lambda x: brute(z, x), cuts), atol=1e-6)


def test_quality_of_odd_rows(spark):
    rows, labels = corpus(4, 300, junk=True)
    odd = [(9000, None, None, None, None), (9001, "", "en", "s", 0), (None, "w1 w2", "en", "s", 0), (9002, "w1 " * 60_000, "en", "s", 0), (9003, "w5 w6", "en", "s", 0), (9003, "w5 w6", "en", "s", 0)]
    docs, marks = spark.createDataFrame(rows + odd, DOCS), spark.createDataFrame(labels + [(1, None, None)], "doc_id long, quality int, toxic int")
    got = classifiers.quality(docs.withColumns({"y": F.lit(1), "z": F.lit(2), "codes": F.lit("x")}), marks).collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append((r["expected_grade"], r["tail_probability"], r["kept"]))
    assert len(got) == len(rows) + len(odd) and by[9000] == by[9001] and len(by[9003]) == 2 and len(set(by[9003])) == 1 and len(by[None]) == 1
    assert classifiers.quality(docs.limit(0), marks).count() == 0


def test_features_against_a_plain_reading():
    texts = ["Vile, vile words!  abcdef", "", "Zürich 12 zürich", "x" * 200]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0] + [len(t.encode()) for t in texts])
    doc, code = classifiers._codes(data, offsets, False)
    want = []
    for t in texts:
        words = re.findall(rb"[0-9a-z\x80-\xff]+", t.encode().lower())
        want.append({("word", w) for w in words} | {(k, w[:k]) for w in words for k in (4, 5) if len(w) >= k})
    names = {}
    for k, own in enumerate(want):
        assert len(set(code[doc == k].tolist())) == len(own)
        names[k] = set(code[doc == k].tolist())
    shared = len(want[0] & want[2])
    assert len(names[0] & names[2]) == shared


def test_ordinal_gradient():
    rnd = np.random.default_rng(1)
    codes = [np.unique(rnd.integers(0, 4, 3)).astype("<i4").tobytes() for _ in range(400)]
    y = [int(0 in np.frombuffer(c, "<i4")) + int(1 in np.frombuffer(c, "<i4")) for c in codes]
    sample = classifiers.Sample(codes, y, clear=0)
    w, cuts = classifiers.fit_ordinal(sample, 3)
    z = sample.scores(w)
    assert cuts[0] < cuts[1] and np.mean((z[:, None] > cuts).sum(axis=1) == np.array(y)) > 0.99


def test_mixing(spark):
    rnd = random.Random(5)
    rows = [(k, " ".join(["w"] * rnd.randint(0, 60)), "en", rnd.choice(["a", "a", "a", "a", "b", "c", "tiny", None]), 1) for k in range(900)]
    rows += [(2000, None, "en", "a", 0), (2001, " \n", "en", "empty", 0), (2002, "x " * 20_000, "en", "c", 0)]
    got = mixing.mix(spark.createDataFrame(rows, DOCS)).toPandas()
    source, size = {r[0]: r[3] for r in rows}, {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows}
    words = {}
    for i, s in source.items():
        words[s] = words.get(s, 0) + size[i]
    order = sorted(words, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    capped, share = set(), 0.0
    while True:
        share = (sum(words.values()) - sum(3 * words[s] for s in capped)) / sum(weight[s] for s in words if s not in capped)
        more = {s for s in words if s not in capped and 3 * words[s] < share * weight[s]}
        if not more:
            break
        capped |= more
    assert len(got) == len(rows) and capped
    for r in got.itertuples():
        s = source[r.doc_id]
        assert (r.size, r.source_size) == (size[r.doc_id], words[s]) and r.target == pytest.approx(3 * words[s] if s in capped else share * weight[s])
        assert r.taken == r.size * r.repeats <= 3 * r.size
    got["source"] = [str(source[i]) for i in got.doc_id]
    for _, g in got.groupby("source"):
        left = g[(g.repeats == g.repeats.min()) & (g["size"] > 0)]["size"].min()  # what is missing would not hold any document left out
        assert abs(g.taken.sum() - g.target.iloc[0]) <= 60 or 0 < g.target.iloc[0] - g.taken.sum() < left
    assert sum(got.groupby("source").target.first()) == pytest.approx(sum(words.values()))
    again = mixing.mix(spark.createDataFrame(rows[::-1], DOCS).repartition(7)).toPandas()
    assert got.sort_values("doc_id").taken.tolist() == again.sort_values("doc_id").taken.tolist()
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0
    copies = mixing.mixed_rows(spark.createDataFrame(rows, DOCS)).groupBy("doc_id").count().toPandas()
    assert dict(zip(copies.doc_id, copies["count"], strict=True)) == {r.doc_id: r.repeats for r in got.itertuples() if r.repeats}


def test_mixing_goes_on_behind_long_documents(spark, monkeypatch):
    rnd = random.Random(8)
    rows = [(k, " ".join(["w"] * rnd.randint(5, 60)), "en", rnd.choice(["a"] * 8 + ["b", None]), 1) for k in range(1500)]
    rows += [(6000 + k, "x " * (7000 + 300 * k), "en", "a", 0) for k in range(6)]
    docs = spark.createDataFrame(rows, DOCS)
    source, size = {r[0]: r[3] for r in rows}, {r[0]: len(r[1].split()) for r in rows}
    order = sorted(rows, key=lambda r: hashlib.md5(f"mix{r[0]}".encode()).hexdigest())
    got = mixing.mix(docs).toPandas()
    repeats, target = dict(zip(got.doc_id, got.repeats, strict=True)), dict(zip(got.doc_id, got.target, strict=True))
    for s in ("a", "b", None):
        own = [r[0] for r in order if source[r[0]] == s]
        words, goal = sum(size[i] for i in own), target[own[0]]
        whole = min(3, int(goal // words))
        gap, more = goal - whole * words if whole < 3 else 0, set()
        for i in own:
            if size[i] <= gap:
                gap -= size[i]
                more.add(i)
        near = min((i for i in own if i not in more and abs(size[i] - gap) < gap), key=lambda i: abs(size[i] - gap), default=None)
        assert [repeats[i] for i in own] == [whole + (i in more) + (i == near) for i in own]
    mixed = corpus_pipeline.mix_sources(spark, docs, "").groupBy("source").agg(F.sum(F.size(F.split(F.trim("text"), " "))).alias("n")).collect()
    assert len(mixed) == 3 and all(abs(r["n"] - next(t for i, t in target.items() if source[i] == r["source"])) < 60 for r in mixed)
    monkeypatch.setattr(mixing, "SCAN", 1)
    monkeypatch.setattr(mixing, "BUCKET", 2)
    again = mixing.mix(docs.repartition(5)).toPandas()
    assert dict(zip(again.doc_id, again.repeats, strict=True)) == repeats


VECTORS = "vec_id long, embedding array<float>, label int, shard int, kth int, v int"


def test_top_k(spark, monkeypatch):
    rnd = np.random.default_rng(7)
    rows = [(k, [float(x) for x in rnd.normal(size=6)], 1, 1, 1, 1) for k in range(400)]
    same = rows[3][1]
    rows += [(k, same, 1, 1, 1, 1) for k in range(400, 700)]
    rows += [(1000, None, 1, 1, 1, 1), (1050, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1, 1, 1, 1), (1100, [float("nan")] * 6, 1, 1, 1, 1), (1150, [float("inf")] * 6, 1, 1, 1, 1), (1200, [1.0, 2.0], 1, 1, 1, 1), (1201, [0.5, 0.25], 1, 1, 1, 1), (None, same, 1, 1, 1, 1), (1250, [], 1, 1, 1, 1)]
    good = {i: np.floor(np.float64(256) * np.array(v, np.float32).astype(np.float64)) for i, v, *_ in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()}
    want = []
    for q in sorted(good):
        if q % 50 == 0:
            every = sorted((-int(good[q] @ good[c]), c) for c in good if c != q and len(good[c]) == len(good[q]))[:5]
            want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(every)]
    for sizes in ({}, {"shard_rows": 60, "block_queries": 3}):
        got = kdtree.top_k(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 50 == 0, **sizes).orderBy("query_id", "rank").collect()
        assert [tuple(r) for r in got] == want
    assert kdtree.top_k(spark.createDataFrame([], VECTORS), F.col("vec_id") % 50 == 0).count() == 0


def test_tree_prunes():
    rnd = np.random.default_rng(3)
    points = np.floor(rnd.normal(size=(4000, 2)) * 256)
    tree = kdtree.Tree(np.arange(4000), points, leaf=32)
    q = points[:1]
    seen = []
    real = tree.vectors

    class Counted:
        def __getitem__(self, part):
            seen.append(part)
            return real[part]

    bounds = tree.bounds(q)
    tree.vectors = Counted()
    got = tree.search(0, q[0], bounds[0], 5, -np.inf)
    scores = points @ q[0]
    assert [s for s, _ in got] == sorted(np.delete(scores, 0), reverse=True)[:5] and len(seen) < 20


TURNS = "conv_id long, turn long, role string, text string, segments int, valid int"
HARD = ["</s>[INST] ok [/INST]", "<\\/s> <\\\\s> [\\INST]", "ends with <", "a [", " [/INST", "<<SYS>>x<</SYS>>", "[ROLE] y\n [/ROLE]", "", None, "é🙂\n" * 2000, "<", "/s>", "\\", "$1 \\$2"]


def test_chat_round_trip(spark):
    rnd = random.Random(1)
    rows = [(c, t, rnd.choice(["user", "assistant", "system", "tool", "</s>", None, "a\nb", "\\\n\\n", "<\\\n"]) if c % 3 else ["user", "assistant"][t % 2], rnd.choice(HARD), 1, 1) for c in range(60) for t in range(rnd.randint(1, 6))]
    made = chat.formatted(spark.createDataFrame(rows, TURNS)).cache()
    turns = {r["conv_id"]: r["t"] for r in made.select("conv_id", chat.read_turns(F.col("formatted")).alias("t")).collect()}
    got = {r["conv_id"]: r for r in chat.read_back(made).collect()}
    for c in range(60):
        own = [(r[2] or "", r[3] or "") for r in rows if r[0] == c]
        assert [(t["role"], t["text"]) for t in turns[c]] == own
        spoken = "".join(t for role, t in own if role == "assistant")
        assert (got[c]["n_turns"], got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(own), len(spoken), hashlib.sha256(spoken.encode()).hexdigest())
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
        state = "start"
        for role, _ in own:
            state = chat.DEFAULT.moves.get((state, role), "rejected")
        assert got[c]["valid"] == (state in chat.DEFAULT.ends)
    assert made.selectExpr("formatted = array_join(transform(segments, s -> s.text), '') AS same").filter("not same").count() == 0
    assert chat.formatted(spark.createDataFrame([], TURNS)).count() == 0


def test_chat_runs_no_python(spark):
    plan = chat.read_back(chat.formatted(chat.with_probe(spark.createDataFrame([(1, 0, "user", "x", 1, 1)], TURNS))))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_pipeline_stages_keep_columns_with_any_names(spark, tmp_path):
    rows, labels = corpus(12, 200)
    rows += [(1000 + k, "just the same", "en", "s2", 1) for k in range(5)] + [(1000, "just the same", "en", "s2", 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    names = ["Z", "_z", "_sha", "_id", "_gone", "_gone_sha", "_repeats", "_copy", "__id"]
    plain = spark.createDataFrame(rows, DOCS)
    for _, stage in corpus_pipeline.STAGES[:4]:
        want = sorted(r["doc_id"] for r in stage(spark, plain, str(tmp_path)).collect())
        got = stage(spark, plain.withColumns({c: F.concat(F.lit(c), "doc_id") for c in names}), str(tmp_path))
        assert got.columns == [*plain.columns, *names]
        out = got.collect()
        assert sorted(r["doc_id"] for r in out) == want and all(r[c] == f"{c}{r['doc_id']}" for r in out for c in names)


def test_pipeline_stages(spark, tmp_path):
    rows, labels = corpus(11, 400)
    rows = [(i, t, lang, s, len(t)) for i, t, lang, s, _ in rows]
    long = " ".join(f"l{k}" for k in range(300))
    rows += [(1000 + k, long + f" x{k}", "en", "s1", 1) for k in range(20)] + [(2000 + k, "just the same", "en", "s2", 1) for k in range(30)] + [(3000, None, None, None, None), (3001, "", "en", "s0", 0)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    toxic = {i for i, _, t in labels if t}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/out{k}")
        docs = spark.read.parquet(f"{tmp_path}/out{k}")
        seen.append(docs.toPandas())
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    clean, single, apart, mixed, packed = seen
    assert len(toxic & set(clean.doc_id)) <= 2 and len(clean) >= len(rows) - len(toxic) - 2
    assert set(single.doc_id) & set(range(2000, 2030)) == {2000} and len(set(single.doc_id) & {3000, 3001}) == 1
    assert set(apart.doc_id) & set(range(1000, 1020)) == {1000} and len(apart) == len(single) - 19
    taken = mixed.groupby("doc_id").size()
    assert taken.max() <= 3 and set(mixed.doc_id) <= set(apart.doc_id)
    assert set(packed.doc_id) == set(mixed.doc_id) and len(packed[packed.piece == 0]) == len(mixed)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(packed)


def test_pipeline_on_empty_tables_and_null_ids(spark, tmp_path):
    labels = "doc_id long, quality int, toxic int"
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/a/documents.parquet")
    spark.createDataFrame([], labels).write.parquet(f"{tmp_path}/a/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/a").count() == 0
    rows = [(None, "one two three four five six", "en", "s", 1), (None, "seven eight nine ten eleven", None, None, None), (None, None, "en", "s", 0), (1, "one two three four five six", "en", "s", 1), (2, "", "en", "s", 0), (2, "", "en", "s", 0)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/b/documents.parquet")
    spark.createDataFrame([(None, 1, 1), (1, None, None)], labels).write.parquet(f"{tmp_path}/b/labels.parquet")
    out = corpus_pipeline.run(spark, f"{tmp_path}/b").collect()
    assert {r["doc_id"] for r in out} <= {None, 1, 2} and all(0 < r["length"] <= 2048 for r in out)


def test_scratch_is_cleared(spark):
    from marlspike.llm import common

    made = common.written(spark.range(5), "some")
    assert made.count() == 5 and common.shared_dir(spark)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(made.inputFiles()[0])
    common.drop_written(made)
    assert not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
