import random

from tradeloom.llm.listings import codes_of, features, pack_of, pairs, resolve, same_article, sizes_of
from tradeloom.session import stored

P = "id string, canonical_name string, brand string, description string, current_version_id string, attributes string"
V = "id string, product_id string, version_number int, attributes string"


def test_reading():
    assert codes_of("HCT2S2S, ghr-04782 and JMU 17 08, CT6-6342; RED 1500 ml; BRN-3041", [(3, 4)]) == ["HCT2525", "GHR4782", "JMU1708", "CTG6342", "BRN3041"]
    assert sizes_of("16.9 fl. oz. 17.7\" 1,5 kW 500 g", False) == {"volume": 16.9 * 29.5735, "length": 17.7 * 25.4, "power": 1500.0, "weight": 500.0}
    assert [pack_of(t) for t in ("pack of 6", "4-pack", "x3", "2x mug", "6 pcs", "mug")] == [6, 4, 3, 2, 6, None]
    row = features("1", None, None, None, "not json", [(3, 4)])
    assert row[0] == "1" and row[6] == [] and row[8] is None and row[10] == 1


def test_variants():
    s = lambda e="", c=None, p=1, v=None, n=1: (e, c, p, v, None, None, None, n)
    got = resolve([s(c="red", v=500.0, n=3), s(c="blue", v=500.2, n=1), s(c="red"), s(v=750.0, c="red"), s("plus", "red", 1, 500.0), s(c="red", v=500.0, p=6), s()])
    assert got[0] != got[1] and got[3] not in got[:2] and got[4] not in got[:4] and got[5] not in got[:5]
    assert resolve([s(c="red"), s(c="blue"), s()])[2] is None and resolve([]) == []


def test_groups(spark):
    rows = [
        ("a", "Acmelia ABC-1234 desk lamp red 45 cm", "Acmelia", "Acmelia desk lamp ABC-1234.", "va", None),
        ("b", "SALE red desk lamp ABC 12 34 17.7 in", "acmelia", None, None, None),
        ("c", "Acmelia ABC1234-EU desk lamp 450 mm", "", None, "vc", None),
        ("d", "Acmelia ABC-1234 desk lamp blue 45 cm", "Acmelia", None, None, None),
        ("e", "Acmelia ABC-1234 Plus desk lamp red 45 cm", "Acmelia", None, None, None),
        ("f", "Acmelia ABC-1234 desk lamp red 45 cm pack of 6", "Acmelia", None, None, None),
        ("g", "carry case fits desk lamp Acmelia ABC-1234 45 cm red", "Acmelia", None, None, None),
        ("h", None, None, None, None, None), ("i", "", " ", "", "gone", None), (None, "Acmelia ABC-1234 desk lamp red 45 cm", "Acmelia", None, None, None),
        ("j", "Zonobix ABC-1234 desk lamp red 45 cm " + "long " * 3000, "Zonobix", None, None, None),
    ]
    versions = [("v0", "c", 1, '{"colour": "blue"}'), ("vc", "c", 2, '{"colour": "rot"}'), ("v3", "c", 3, '{"colour": "blau"}'), ("va", "a", 1, None)]
    refs = spark.createDataFrame([("B1", "Acmelia"), ("B2", "Zonobix")], "ref_id string, name string")
    p = spark.createDataFrame(rows, P)
    found = same_article(p, spark.createDataFrame(versions, V), refs)
    assert sorted(map(tuple, pairs(found).collect())) == [("a", "b"), ("a", "c"), ("b", "c")]
    assert same_article(p.limit(0), spark.createDataFrame([], V), refs).count() == 0


def generated(seed, brands=14, models=8, sellers=5):
    """Listings of made-up articles, written differently by each seller, and the article of each."""
    rng = random.Random(seed)
    syllables = "ka lo mi ru te zan vor bel dos fin gra hul".split()
    word = lambda n: "".join(rng.choice(syllables) for _ in range(n))
    colours = {"red": ["red", "rot", "rouge"], "blue": ["blue", "blau", "bleu"], "black": ["black", "schwarz", "noir"]}
    rows, truth, k = [], {}, 0
    used = set()
    for _ in range(brands):
        brand = word(3).capitalize()
        for _ in range(models):
            code = "".join(rng.choice("ACDEFHKLMNPRTUVWXY") for _ in range(3)) + "".join(rng.choice("3479") for _ in range(4))
            if code in used:
                continue
            used.add(code)
            goods = rng.choice(["desk lamp", "garden hose", "storage box"])
            for colour, cm in rng.sample([(c, n) for c in colours for n in (45, 80)], 2):
                for _ in range(sellers):
                    printed = rng.choice([code, f"{code[:3]}-{code[3:]}", f"{code[:3]} {code[3:5]} {code[5:]}", f"{code[:3]}.{code[3:]}", code.lower(), f"{code[:3]}0{code[3:]}"])
                    size = rng.choice([f"{cm} cm", f"{cm * 10}mm", f"{cm / 100} m", f"{cm / 2.54:.1f} in"])
                    parts = [printed, goods, rng.choice(colours[colour]), size]
                    rng.shuffle(parts)
                    typed = rng.choice([brand, brand.upper(), f"{brand} GmbH", f"{brand}®", None if rng.random() < 0.3 else brand])
                    title = f"{rng.choice(['', 'SALE ', 'NEW! '])}{brand} {' '.join(parts)} {rng.choice(['', 'ideal gift', '2026 model'])}"
                    rows.append((str(k), title, typed, rng.choice([None, f"<p>{brand} {goods}.</p> Built for daily use."]), None, None))
                    truth[str(k)] = (code, colour, cm)
                    k += 1
    return rows, truth


def test_recall_on_generated_listings(spark):
    rows, truth = generated(11)
    names = sorted({t.split()[0] if t.split()[0] not in ("SALE", "NEW!") else t.split()[1] for _, t, *_ in rows})
    refs = spark.createDataFrame([(f"B{k}", n) for k, n in enumerate(names)], "ref_id string, name string")
    found = {r.product_id: r.article for r in same_article(spark.createDataFrame(rows, P), spark.createDataFrame([], V), refs).collect()}
    want = {(a, b) for a in truth for b in truth if a < b and truth[a] == truth[b]}
    got = {(a, b) for a in found for b in found if a < b and found[a] == found[b]}
    recall, precision = len(want & got) / len(want), len(want & got) / len(got)
    assert len(want) > 1500 and recall > 0.98 and precision > 0.99, (recall, precision)


def test_splitting_a_brand_changes_nothing(spark):
    from tradeloom.llm.listings import assign_models, listing_features, mined_phrases, routed, with_brand

    rows, _ = generated(5, brands=3, models=5)
    rows += [("x1", "Zonobix Lumaretto desk lamp", "Zonobix International Official Store", None, None, None), ("x2", "Zonobix lumaretto hose", "Zonobix", None, None, None), ("x3", "lumareto lamp", "Zonobix", None, None, None), ("x4", "umaretto lamp", "Zonobix", None, None, None)]
    refs = spark.createDataFrame([("B", "Zonobix"), ("C", "Other")], "ref_id string, name string")
    listings = stored(with_brand(stored(listing_features(spark.createDataFrame(rows, P), spark.createDataFrame([], V)), "f"), refs), "b")
    phrases = stored(mined_phrases(listings), "p")
    listings = stored(routed(listings, phrases), "r")
    whole, split = (sorted(map(tuple, assign_models(listings, phrases, n).collect())) for n in (20_000, 3))
    assert whole == split and {m[2] for m in whole if m[0].startswith("x")} == {"lumaretto"} and len([m for m in whole if m[0].startswith("x")]) == 4


def test_series_words_of_many_listings(spark):
    from tradeloom.llm.listings import mined_phrases

    told = [("ref:A", ["solanix", "speaken"])] * 90 + [(f"own:{k}", ["solanix"]) for k in range(12)]  # a hot model with stray mentions
    told += [(f"ref:{k % 20}", ["lautsprecher", "speaker"]) for k in range(60)] + [("ref:B", ["lautspecher"])] * 2 + [("ref:C", ["tandorel"])] * 2
    found = mined_phrases(spark.createDataFrame([(b, w, []) for b, w in told], "brand string, words array<string>, codes array<string>")).collect()
    assert sorted((r.brand, r.phrase, r.n) for r in found) == [("ref:A", "solanix", 90), ("ref:A", "speaken", 90), ("ref:C", "tandorel", 2)]
