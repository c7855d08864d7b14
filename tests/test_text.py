from __future__ import annotations

from decimal import Decimal

import pytest

from marlspike.functions import similarity as S
from marlspike.functions import text as T


def values(spark, f, *texts):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, x string").select("k", f("x").alias("v")).collect()
    return [r["v"] for r in sorted(rows, key=lambda r: r["k"])]


def test_normalize(spark):
    assert values(spark, T.normalize, "Dolo-650", "DOLO650", "Dolo 650", "D0LO 650", "Dolo, 650!", None, "", "pan40", "d0lo", "d0lo650", "amlopres5", "a + b/c", "Café_1") == ["dolo 650", "dolo 650", "dolo 650", "d0lo 650", "dolo 650", "", "", "pan 40", "d0lo", "d0lo650", "amlopres5", "a + b/c", "café_1"]


def test_slug_and_title(spark):
    assert values(spark, T.slug, "Dolo 650", "--", " A+B ") == ["dolo-650", "unknown", "a-b"]
    assert values(spark, T.title, "5-hydroxy o'neil acid", "ABC") == ["5-Hydroxy O'Neil Acid", "Abc"]


def test_strength(spark):
    got = values(spark, T.strength, "500mg", "650 MG", "100 mg/5 ml", "250 mg + 125 mg", "Dolo 650", "5%", "5%x", None, "a + 5 ml", "2.5 gm")
    plain = [([(c["value"], c["unit"]) for c in s["components"]], s["per_value"], s["per_unit"]) for s in got]
    D = Decimal
    assert plain == [([(D(500), "mg")], None, None), ([(D(650), "mg")], None, None), ([(D(100), "mg")], D(5), "ml"), ([(D(250), "mg"), (D(125), "mg")], None, None), ([], None, None), ([], None, None), ([(D(5), "%")], None, None), ([], None, None), ([(D(5), "ml")], None, None), ([(D("2.5"), "g")], None, None)]
    assert values(spark, T.strip_strength, "paracetamol 500 mg tablet", "dolo 650", "x 100mg/5ml y") == ["paracetamol tablet", "dolo 650", "x y"]


def test_forms(spark):
    assert values(spark, T.dosage_form, "tabs", "x syr", "susp", "none", None, "tablet syrup") == ["tablet", "syrup", "suspension", None, None, "tablet"]
    assert values(spark, T.strip_form, "calpol Syrup", "tabx caps") == ["calpol", "tabx"]
    rows = spark.createDataFrame([("a", "a"), ("tablet", "syrup"), (None, "a"), ("a", "")], "a string, b string").select(T.forms_compatible("a", "b").alias("v")).collect()
    assert [r["v"] for r in rows] == [True, False, True, True]


def test_variants(spark):
    optical, character = values(spark, T.optical_variants, "d0lo", "mm", "")[:3], values(spark, T.character_variants, "cr0cln", "")
    assert optical[0][0] == "d0lo" and "dolo" in optical[0]
    assert optical[1] == ["mm", "nm", "mn"] and optical[2] == [""]
    assert character[0][0] == "cr0cln" and {"crocln", "cr0cin"} <= set(character[0]) and character[1] == [""]


@pytest.mark.parametrize(
    ("text", "expected"),
    [("x OD", "Once Daily"), ("BD", "Twice Daily"), ("BID", "Twice Daily"), ("TDS", "Thrice Daily"), ("tid", "Thrice Daily"), ("QID", "Four Times Daily"), ("HS", "At Bedtime"), ("SOS", "When Required"), ("STAT", "Immediately"), ("1/2-0-1", "1/2-0-1 (M-A-N)"), ("1 Morning, 1 Night (After Food) 8 Days", "Twice Daily (Morning, Night)"), ("1 Morning (After Food)", "Morning"), ("After Food", "After Meals"), ("t-0-0", "1-0-0 (M-A-N)"), ("at 9 pm", "9 PM"), ("1 - 0", "1-0"), ("none", "N/A")],
)
def test_frequency(spark, text, expected):
    assert values(spark, T.frequency, text) == [expected]


def test_fields(spark):
    assert values(spark, T.dosage, "1 tablet BD", "(Tot:8 Tab)", "(Tot:8 Tab) 1 tablet", "half tsp") == ["1 tablet", "N/A", "1 tablet", "half tsp"]
    assert values(spark, T.duration, "5 days", "x 1 week", "10 days", "(5)") == ["5 days", "1 week", "10 days", "N/A"]
    assert values(spark, T.strength_text, "500 mg", "(250)", "1/2", "Pan SR", "x") == ["500 mg", "250mg", "1/2", "SR", "N/A"]
    assert values(spark, T.is_noise, "Tab", "650", "1-0-1", "OD", "the", "!", "Dolo", "12-0-1") == [True, True, True, True, True, True, False, False]


def test_fuse_confidence(spark):
    rows = spark.createDataFrame([(80.0, 1.0), (80.0, 0.2), (80.0, None), (None, 0.5), (80.0, 7.0)], "m double, o double").select(T.fuse_confidence("m", "o").alias("v")).collect()
    assert [r["v"] for r in rows] == [80.0, 48.0, 80.0, None, 80.0]


def test_ratios():
    assert S.ratio("d0lo 650", "paracetamol") == pytest.approx(10.526, abs=1e-3)
    assert S.ratio("d0lo 650", "dolo 650") == 87.5
    assert S.ratio("asthalin", "aspirin") == pytest.approx(53.333, abs=1e-3)
    assert S.token_set_ratio("dolo 650", "650 dolo tablet") == 100.0
    assert S.partial_ratio("dolo", "xx dolo 650") == 100.0
    assert S.weighted_ratio("", "a") == 0.0
    assert S.name_score("dolo", "dolo") == 100.0


def test_common_length_against_table():
    import random

    rnd = random.Random(3)
    for _ in range(300):
        a, b = ("".join(rnd.choice("abcd ") for _ in range(rnd.randint(0, 12))) for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert S.common_length(a, b) == best[-1][-1]
