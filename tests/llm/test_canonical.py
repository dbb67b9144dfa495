import random

import pytest

from tradeloom.llm.canonical import NONE, THRESHOLD, brand_names, brand_readings, canonical, errors, map_fields, origin_readings, tokens
from tradeloom.llm.similarity import similarity_join

BRANDS = [("B1", "Belomo Outdoor"), ("B2", "Ulmuko"), ("B3", "Ulmuka"), ("B4", "Kelelmönt"), ("B5", "Straenalund-Hal")]
COUNTRIES = [("CN", "China"), ("DE", "Germany"), ("NE", "Niger"), ("NG", "Nigeria"), ("TR", "Türkiye"), ("US", "United States"), ("PE", "Peru")]


@pytest.mark.parametrize("threshold", [0.4, 0.7, 1.0])
def test_join_matches_brute_force(spark, threshold):
    rng = random.Random(3)
    sets = lambda p, n: [(f"{p}{k}", rng.choices("abcdefghij", k=rng.randrange(0, 9))) for k in range(n)] + [(f"{p}null", None)]
    a, b = sets("a", 60), sets("b", 40)
    schema = "id string, tokens array<string>"
    got = {(r.left_id, r.right_id): round(r.jaccard, 9) for r in similarity_join(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), threshold).collect()}
    want = {}
    for i, x in a:
        for j, y in b:
            if x and y and (s := len(set(x) & set(y)) / len(set(x) | set(y))) >= threshold - 1e-9:
                want[i, j] = round(s, 9)
    assert got == want


def test_fields(spark):
    rows = [("1", "BELOMO OUTDOOR", "DEU"), ("2", "Outdoor Belomo", "Made in China"), ("3", "Belomo O.", "CN/China"), ("4", "by Ulmuk0 Ltd.", "Nigerr"), ("5", "U L M U K A", "Turkey"), ("6", "Kelelmoent™", "Asia"), ("7", "none", "XX"), ("8", None, " "), ("9", "Ulmuko", "CN"), ("10", "Straenalnud-Hal", "U.S.A."), ("11", "Zanotherbrand", "tÜRKIYE"), ("12", "Belommo Ouadoor", "Germany, DE"), ("1", "BELOMO OUTDOOR", "DEU"), ("13", "x" * 5000, "C H I N A"), ("14", None, "Pru"), ("15", None, "TBD")]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "id string, brand string, origin_country string, value string, ref_id string")
    refs = [spark.createDataFrame(x, "ref_id string, name string") for x in (BRANDS, COUNTRIES)]
    got = {(r.product_id, r.field): r.ref_id for r in map_fields(df, *refs).collect()}
    brand = {k: v for (k, f), v in got.items() if f == "brand"}
    origin = {k: v for (k, f), v in got.items() if f == "origin_country"}
    assert brand == {"1": "B1", "2": "B1", "3": "B1", "4": "B2", "5": "B3", "6": "B4", "7": NONE, "10": "B5", "11": NONE, "12": "B1", "13": NONE}
    assert origin == {"1": "DE", "2": "CN", "3": "CN", "4": "NE", "5": "TR", "6": NONE, "7": NONE, "10": "US", "11": "TR", "12": "DE", "13": "CN", "14": "PE", "15": NONE}
    assert map_fields(df, *refs).count() == 13 + 13  # repeated rows repeat
    assert map_fields(df.limit(0), *refs).count() == 0
    assert {r.ref_id for r in canonical(df.selectExpr("brand as value"), refs[0].limit(0), brand_readings, brand_names).collect()} == {NONE}


def test_pieces():
    assert errors("india", "idnia") == 1 and errors("abc", "abd") == 1 and errors("", "ab") == 2
    assert "china" in origin_readings("CN - China") and tokens("de") == ["=de"] and tokens("") == []


def test_errors_in_the_first_letter(spark):
    refs = spark.createDataFrame(COUNTRIES + [("LU", "Ulmuko"), ("X", "Xiger")], "ref_id string, name string")
    values = spark.createDataFrame([("Lumuko",), ("ermany",), ("Wermany",), ("Nigxr",), ("Qzzzny",)], "value string")
    got = {r.value: r.ref_id for r in canonical(values, refs, brand_readings, brand_names).collect()}
    assert got == {"Lumuko": "LU", "ermany": "DE", "Wermany": "DE", "Nigxr": "NE", "Qzzzny": NONE}


def test_the_threshold_loses_no_value_within_the_errors_allowed():
    # every error, and for long names pairs of errors, of made-up names: the token sets keep the threshold, so the join offers the entry
    rng = random.Random(8)
    for n in range(4, 13):
        for _ in range(150):
            name = "".join(rng.choice("abcdeiklmnorstuvz") for _ in range(n))
            typed = name
            for _ in range(1 if n <= 6 else 2):
                k = rng.randrange(len(typed))
                typed = rng.choice([typed[:k] + typed[k + 1 :], typed[:k] + rng.choice("abcxyz") + typed[k:], typed[:k] + rng.choice("abcxyz") + typed[k + 1 :], typed[:k] + typed[k : k + 2][::-1] + typed[k + 2 :]])
            allowed = 0 if min(len(typed), n) <= 3 else 1 if min(len(typed), n) <= 6 else 2
            if errors(typed, name) <= allowed:
                a, b = set(tokens(typed)), set(tokens(name))
                assert len(a & b) / len(a | b) >= THRESHOLD, (typed, name)
