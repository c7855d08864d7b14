from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from marlspike.config import Settings
from marlspike.operators import catalog as C
from marlspike.operators import extraction, layout, linkage
from marlspike.sources import providers as P

EMPTY = ", ".join(f"{c} {t}" for c, t in C.SCHEMA.items())
NAMES = ["Amoxicillin", "Paracetamol", "Dolo", "Dolo 650", "Omez", "Aspirin", "Metformin", "Amlodipine", "Folic Acid", "Pyridoxine", "Clarithromycin", "dolo", " "]


@pytest.fixture(scope="module")
def full(spark):
    """The names, then the curated brands over them."""
    lines = spark.createDataFrame([(n,) for n in NAMES], "value string")
    first = C.upsert(spark.createDataFrame([], EMPTY), P.names_from(lines).withColumn("o", F.monotonically_increasing_id()), P.NAME_COLUMNS, order="o")
    catalog, n = P.sync(P.CuratedBrands(), first)
    assert n == 17
    catalog.write.mode("overwrite").saveAsTable("full_catalog")
    return spark.table("full_catalog")


def only(spark, full, *names):
    return full.filter(F.coalesce("brand_name", "generic_name").isin(*names))


def resolved(spark, catalog, *texts, **settings):
    q = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, input_text string")
    return linkage.resolve(q, catalog, Settings(**settings)).orderBy("k").collect()


def name_of(full, key):
    r = full.filter(F.col("id") == key).first()
    return r["brand_name"] or r["generic_name"]


def test_import_merges_shared_slugs(full):
    assert full.count() == 11 - 1 + 17
    assert full.select("id").distinct().count() == full.count()
    dolo = full.filter("external_id = 'legacy:dolo-650'").first()
    assert (dolo["brand_name"], dolo["generic_name"], dolo["aliases"], float(dolo["strength_value"])) == ("Dolo 650", "Paracetamol", ["dolo", "dolo 650"], 650.0)
    assert dolo["source_version"] != "unclassified_name" and dolo["search_text"] == "paracetamol dolo 650 dolo dolo 650"
    assert full.filter("external_id = 'legacy:meftal-p'").first()["strength_value"] is None


def test_upsert_keeps_what_is_not_supplied(spark, full):
    again = C.upsert(full, P.names_from(spark.createDataFrame([("Dolo 650",)], "value string")), P.NAME_COLUMNS)
    assert again.count() == full.count()
    row, old = (c.filter("external_id = 'legacy:dolo-650'").first() for c in (again, full))
    assert row["brand_name"] is None and row["generic_name"] == "Dolo 650" and row["aliases"] == []
    assert row["strength"] == "650mg" and row["id"] == old["id"]
    nulls = spark.createDataFrame([(None, "x", "legacy_manual"), (None, "x", "legacy_manual")], "external_id string, generic_name string, source string")
    assert C.upsert(full, nulls, ("generic_name",)).count() == full.count() + 2


def test_ingredients(spark):
    rows = P.ingredients_from(spark.createDataFrame([("1", "5-hydroxy acid", "IN"), (None, "x", "IN"), ("2", "", "IN")], "rxcui string, name string, tty string")).collect()
    assert [(r["external_id"], r["generic_name"], r["codes"]) for r in rows] == [("rxnorm:1", "5-Hydroxy Acid", {"rxnorm_tty": "IN"})]
    with pytest.raises(NotImplementedError):
        P.LicensedDataset().records(spark)


def test_golden_resolutions(spark, full):
    dolo = only(spark, full, "Dolo 650")
    rows = resolved(spark, dolo, "DOLO-650", "Dolo650", "D0LO 650", "Dolo 680mg", "Xyzcompletelyfakemedicinename", "", "  ", None)
    assert [r["status"] for r in rows] == ["EXACT", "EXACT", "HIGH_CONFIDENCE", "REVIEW_REQUIRED", "NO_MATCH", "NO_MATCH", "NO_MATCH", "NO_MATCH"]
    assert {name_of(full, r["matched_id"]) for r in rows[:3]} == {"Dolo 650"}
    assert rows[3]["matched_id"] is None and rows[4]["candidates"] == []


def test_every_confusable_place_of_a_long_name_is_read(spark, monkeypatch):
    real = linkage.scored_terms
    monkeypatch.setattr(linkage, "scored_terms", lambda terms, *rest: real(terms.limit(0), *rest))  # exact hits alone
    name = "l" * 5100  # two readings a place, so the last is variant 10,200
    catalog = C.derived(spark.createDataFrame([("1", name[:-1] + "i", "legacy_manual")], "external_id string, generic_name string, source string"))
    (row,) = resolved(spark, catalog, name)
    assert (row["status"], row["match_type"], row["confidence"]) == ("HIGH_CONFIDENCE", "OCR_NORMALIZED_GENERIC", 100.0) and row["matched_id"]


def test_strengths_and_forms_decide(spark, full):
    some = only(spark, full, "Dolo 650", "Crocin 650", "Calpol 500", "Calpol Syrup")
    rows = resolved(spark, some, "Paracetamol 500mg tablet", "Paracetamol 500mg syrup", "Paracetamol", "Crocln 650", "Calpol Syrup")
    assert [r["status"] for r in rows] == ["EXACT", "REVIEW_REQUIRED", "REVIEW_REQUIRED", "HIGH_CONFIDENCE", "EXACT"]
    assert name_of(full, rows[0]["matched_id"]) == "Calpol 500" and len(rows[2]["candidates"]) >= 2
    assert name_of(full, rows[4]["matched_id"]) == "Calpol Syrup"


def test_safety(spark, full):
    rows = resolved(spark, full, "Asthalin", "Asthalin 100mcg", "Omez", "Amlodipine", "Amoxicillin")
    assert rows[0]["matched_id"] is None and rows[1]["matched_id"] is None
    assert rows[2]["match_type"] == "EXACT_CATALOG_NAME"
    assert rows[3]["status"] in ("EXACT", "REVIEW_REQUIRED") and rows[4]["status"] in ("EXACT", "REVIEW_REQUIRED")


def test_strict_strength(spark, full):
    dolo = only(spark, full, "Dolo 650")
    assert resolved(spark, dolo, "Dolo 650 syrup")[0]["status"] == "EXACT"
    assert resolved(spark, dolo, "Dolo 650 syrup", strict_strength=True)[0]["status"] == "REVIEW_REQUIRED"


def test_source_priority_and_insert_order(spark):
    rows = [("1", "Amoxicillin", "rxnorm"), ("2", "Amoxicillin", "legacy_manual"), ("3", "Metoprolol", "rxnorm")]
    for order in (rows, rows[::-1]):
        catalog = C.derived(spark.createDataFrame(order, "external_id string, generic_name string, source string"))
        got = resolved(spark, catalog, "Amoxicillin", "Metoprolol")
        ids = {r["external_id"]: r["id"] for r in catalog.collect()}
        assert [r["status"] for r in got] == ["EXACT", "EXACT"] and got[0]["matched_id"] == ids["2"] and got[1]["match_type"] == "EXACT_GENERIC_RXNORM"


def test_plain_matcher_and_search(spark, full):
    got = {r["token"]: r["match_type"] for r in linkage.match_tokens(spark.createDataFrame([("arnoxycillin",), ("dolo",), ("omez",), ("zzz",)], "token string"), full).collect()}
    assert got == {"arnoxycillin": "ocr_corrected", "dolo": "alias", "omez": "exact", "zzz": "unresolved"}
    top = linkage.search_many(spark.createDataFrame([("dolo",)], "term string"), full, limit=3).orderBy("place").collect()
    assert top[0]["match_type"] == "alias" and [r["place"] for r in top] == list(range(1, len(top) + 1)) and len({r["id"] for r in top}) == len(top)


def test_plans_join_by_keys(spark, full):
    plan = C.search(spark.createDataFrame([("dolo",)], "term string"), full)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


WORDS = "doc_id int, text string, confidence double, x int, y int, width int, height int"


def test_row_banding(spark):
    words = [(1, "a", 0.9, 10, 100, 30, 20), (1, "b", 0.9, 60, 102, 30, 20), (1, "c", 0.9, 90, 101, 30, 20), (1, "d", 0.9, 10, 115, 30, 20), (1, "e", 0.9, 60, 116, 30, 20), (2, "p", 0.95, 10, 100, 40, 20), (2, "q", 0.40, 60, 105, 30, 15)]
    for scale in (1, 4):
        rows = spark.createDataFrame([(d, t, c, *(scale * v for v in box)) for d, t, c, *box in words], WORDS)
        lines = layout.lines_of_words(rows).orderBy("doc_id", "line_no").collect()
        assert [r["text"] for r in lines] == ["a b c", "d e", "p q"]
    one = layout.lines_of_words(spark.createDataFrame([w for w in words if w[0] == 2], WORDS)).first()
    assert (one["x"], one["y"], one["width"], one["height"]) == (10, 100, 80, 20)
    assert (round(one["confidence"], 3), one["min_confidence"]) == (0.675, 0.4)
    assert layout.lines_of_words(spark.createDataFrame([], WORDS)).count() == 0


def test_sections(spark):
    rows = [(1, 0, "Mr X"), (1, 1, "Shop now"), (1, 2, "Tab. Dolo"), (1, 3, "rest"), (2, 0, "hello"), (2, 1, "order now")]
    got = {(r["doc_id"], r["line_no"]): r["section"] for r in layout.sections(spark.createDataFrame(rows, "doc_id int, line_no int, text string")).collect()}
    assert got == {(1, 0): "patient", (1, 1): "ad", (1, 2): "medicine", (1, 3): "medicine", (2, 0): "medicine", (2, 1): "medicine"}


def test_golden_documents(spark, full):
    docs = ["Dolo 650 1-0-1 5 days Pan 40 1-0-0 7 days", "Dolo 650\n1-0-1\n5 days", "Dolo 650\n1-0-1\n5 days\nPan 40\n1-0-0\n7 days", "Zzq 99 OD 5 days", "", "Dolo 650\nCAP. ZOCLAR 500 1 Morning 3 Days"]
    lines = layout.text_lines(spark.createDataFrame(list(enumerate(docs)), "doc_id int, text string"))
    got = [(r["doc_id"], r["name"], r["frequency"], r["duration"]) for r in extraction.extract(lines, full).orderBy("doc_id", "place").collect()]
    dolo, pan = ("Dolo 650", "1-0-1 (M-A-N)", "5 days"), ("Pan 40", "1-0-0 (M-A-N)", "7 days")
    assert got == [(0, *dolo), (0, *pan), (1, *dolo), (2, *dolo), (2, *pan), (5, "Dolo 650", "N/A", "N/A")]


def test_search_in_steps_finds_what_brute_force_finds(spark):
    rng = random.Random(3)
    parts = ["amo", "xi", "cil", "lin", "para", "mol", "𝒜x", "é", "5"]
    names = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 6))) + rng.choice(["", " tablet", " Tablet forte"]) for _ in range(300)] + ["-", None]
    catalog = spark.createDataFrame([(str(k), f"x{k:03}", n) for k, n in enumerate(names)], "id string, external_id string, search_text string")
    asked = [*dict.fromkeys(n.lower() for n in names[:40]), "amo tablt", "zzz", "++", ""]
    terms = spark.createDataFrame([(t,) for t in asked * 2], "term string")

    def grams(x):
        return {f"  {w} "[i : i + 3] for w in re.findall(r"[^\W_]+", (x or "").lower()) for i in range(len(w) + 1)}

    expected = set()
    for t in asked:
        alike = [(-len(grams(t) & grams(n)) / len(grams(t) | grams(n)), f"x{k:03}", str(k)) for k, n in enumerate(names) if grams(t) & grams(n)]
        near = sorted(s for s in alike if -s[0] >= 0.2)[:8]
        expected |= {(t, key, round(-s, 9), place) for place, (s, _, key) in enumerate(near, 1)}
    for small in (0, 10_000):
        got = C.search(terms, catalog, small=small).collect()
        assert {(r["term"], r["id"], round(r["similarity"], 9), r["place"]) for r in got} == expected and len(got) == len(expected)
    assert any(s < 0.35 for _, _, s, _ in expected) and any(p == 8 and s >= 0.5 for _, _, s, p in expected)
    assert C.search(terms, catalog.limit(0)).count() == C.search(terms.limit(0), catalog, small=0).count() == 0
