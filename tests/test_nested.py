import json
import sys

from pyspark.sql import functions as F

from tradeloom.operators.nested import CATALOGUE, emit_tagged, flatten, parse_payload, visit


sys.set_int_max_str_digits(0)


def brute_prices(text):
    """Positions of prices, by plain recursion."""
    def loads(t):
        return json.loads(t, parse_constant=lambda c: 1 / 0)
    try:
        v = loads(text)
        v = loads(v) if isinstance(v, str) else v
    except Exception:
        return []
    def root(o):
        if "title" in o:
            return o
        return next((r for x in o.values() if isinstance(x, dict) and (r := root(x)) is not None), None)
    def kids(o, names):
        found = next((o[n] for n in names if isinstance(o.get(n), list | dict)), [])
        return [(k, x) for k, x in enumerate([found] if isinstance(found, dict) else found) if isinstance(x, dict)]
    r = root(v) if isinstance(v, dict) else None
    if r is None:
        return []
    return [(a, b, c) for a, x in kids(r, CATALOGUE.levels[0].names) for b, y in kids(x, CATALOGUE.levels[1].names) for c, _ in kids(y, CATALOGUE.levels[2].names)]


CASES = [
    None, "", "  ", "null", "[]", "3", '{"title":1}', '{"a":1}', '{"title":"x","variants":null}', '{"title":"x"}{}', '{"title":NaN}', '{"title":"x",}',
    '{"title":"x","variants":[{"packs":[{"prices":[{"amount":1},0,{"amount":2.50}]},"p",{"prices":{}}]},null,{"packs":{"prices":[{}]}}]}',
    '{"meta":{"page":1},"payload":{"entry":{"title":"y","skus":{"packagings":[{"offers":[{"currency":"EUR"}]}]}}}}',
    json.dumps('{"title":"z","items":[{"units":[{"price_list":[{}]}]}],"related":[{"prices":[{}]}]}'),
    json.dumps(json.dumps('{"title":"z"}')), '[{"title":"x","items":[{"units":[{"price_list":[{}]}]}]}]', '{"title":"\\ud800","items":[{"units":{"price_list":{"amount":' + "9" * 6000 + "}}}]}",
    '{"title":"x","body":"' + "long " * 50000 + '","items":[]}', "{" + '"a":{' * 100 + '"title":1' + "}" * 101,
]


def test_prices_match_brute_force(spark):
    rows = [(str(k), c, "clash") for k, c in enumerate(CASES)] + [("6", CASES[12], "again"), (None, CASES[12], "null id")]
    df = spark.createDataFrame(rows, "id string, payload string, positions string")
    flat = flatten(df)
    got = sorted((r.record_id or "", *r.positions) for r in flat.get("prices").select("record_id", "positions").collect())
    assert got == sorted((i or "", *p) for i, c, _ in rows for p in brute_prices(c))
    # every row's parent is a row of the table above
    for child, parent in (("variants", "products"), ("packs", "variants"), ("prices", "packs")):
        keys = flat.get(parent).select(F.col("pk").alias("known"))
        assert flat.get(child).join(keys, F.col("parent_pk") == F.col("known"), "left_anti").count() == 0
    assert {r.reason for r in flat.get("rejects").select("reason").collect()} == {"null", "not JSON", "no object", "no title"}


def test_fractions_keep_their_text(spark):
    df = spark.createDataFrame([("a", CASES[12])], "id string, payload string")
    assert sorted(r.amount for r in flatten(df).get("prices").select("amount").dropna().collect()) == ["1", "2.50"]


def test_empty_table(spark):
    flat = flatten(spark.createDataFrame([], "id string, payload string"))
    assert flat.tagged().count() == 0 and flat.get("prices").count() == 0
    assert emit_tagged(spark.createDataFrame([(1, None)], "id long, payload string")).count() == 1
    deep = "{" + '"a":{' * 100_000 + '"title":1' + "}" * 100_001
    assert parse_payload(deep) == "too deep" and [t[0] for t in visit("r", deep, CATALOGUE)] == ["rejects"]
    assert [t[0] for t in visit("r", '{"title":"t"}', CATALOGUE)] == ["products"]
