import datetime as dt
import random

from tradeloom.operators.known_at import attribute_names, change_history, known_rows, last_known, pivot_back, tariffs_known
from tradeloom.session import stored

T0 = dt.datetime(2026, 1, 1)


def day(n):
    return T0 + dt.timedelta(days=n)


def test_history_matches_brute_force(spark):
    rng = random.Random(4)
    facts = [(rng.choice("xy"), rng.choice(["m", "n", None]), f"v{k}", day(s := rng.randrange(20)), None if rng.random() < 0.3 else day(s + rng.randrange(-1, 8))) for k in range(60)]
    facts += facts[:5] + [(None, "m", "v", day(0), None), ("x", "m", None, day(0), None), ("x", "m", "v", None, None)]
    events = [(k, rng.choice(["x", "y", "z", None]), day(rng.randrange(25)) if rng.random() < 0.9 else None) for k in range(80)]
    f = spark.createDataFrame(facts, "k string, attr string, v string, s timestamp_ntz, e timestamp_ntz")
    e = spark.createDataFrame(events, "id int, k string, at timestamp_ntz")
    h = stored(change_history(f, ["k"], "attr", "v", "s", "e"), "h")
    want = sorted((i, a, tuple(sorted({v for fk, fa, v, s, en in facts if fk == k and fa == a and v and s and t and s <= t and (en is None or t < en) and (en is None or s < en)}))) for i, k, t in events for a in "mn" if k)
    want = [w for w in want if w[2]]
    for limit in (100, 0):  # broadcast and shuffled
        got = sorted((r.id, r.attr, tuple(r.known_values)) for r in last_known(e, h, ["k"], "at", limit).collect())
        assert got == want
    wide = pivot_back(last_known(e, h, ["k"], "at"), ["id"], "attr", "known_values", ["m", "n"])
    got = sorted((r.id, a, tuple(r[a])) for r in wide.collect() for a in "mn" if r[a])
    assert got == want and wide.columns == ["id", "m", "n"]


RATE = "id string, dataset_id string, hs_code string, origin_country string, measure_type string, measure_code string, effective_from date, effective_to date"
SET = "id string, jurisdiction string, activated_at timestamp_ntz, superseded_at timestamp_ntz"
QUERY = "query_id long, jurisdiction string, origin string, hs_code string, transaction_at timestamp_ntz, rate_id string"


def test_tariffs_on_their_edges(spark):
    sets = spark.createDataFrame([("d1", "EU", day(0), day(10)), ("d2", "EU", day(10), None), ("d3", "EU", None, None)], SET)
    rates = [("r1", "d1", "85", "*", "MFN", None, day(-9).date(), day(5).date()), ("r2", "d1", "8516", "CN", "MFN", None, day(5).date(), None), ("r3", "d2", "85", "*", "MFN", None, day(-9).date(), None), ("r4", "d3", "85", "*", "MFN", None, day(-9).date(), None)]
    rates = spark.createDataFrame(rates, RATE)
    qs = [(1, "EU", " cn ", "8516.10", day(0)), (2, "EU", "CN", "85 16", day(5)), (3, "EU", "CN", "8516", day(10)), (4, "EU", "CN", "851", day(1)), (5, "EU", " ", "8516", day(1)), (6, "EU", "CN", None, day(1)), (7, "EU", "CN", "8516", None), (8, "US", "CN", "8516", day(1)), (9, "EU", "*", "8516", day(1)), (10, None, "CN", "8516", day(1)), (1, "EU", " cn ", "8516.10", day(0))]
    q = spark.createDataFrame([(*x, "clash") for x in qs], QUERY)

    def found(q, rates, sets):
        wide, names = tariffs_known(q, rates, sets)
        return sorted(map(tuple, known_rows(wide, ["query_id"], names, "rate_id").collect()))

    assert found(q, rates, sets) == [(1, "r1"), (2, "r2"), (3, "r3"), (9, "r1")]
    assert found(q.limit(0), rates, sets) == [] == found(q, rates.limit(0), sets.limit(0))


def test_measures_come_from_the_data(spark):
    sets = spark.createDataFrame([("d1", "EU", day(0), None)], SET)
    rates = spark.createDataFrame([(f"r{k}", "d1", "85", "*", "LEVY", f"c{k}", day(0).date(), None) for k in range(9)] + [("m", "d1", "85", "*", "MFN", None, day(0).date(), None)], RATE)
    q = spark.createDataFrame([(1, "EU", "CN", "8516", day(1), "")], QUERY)
    wide, names = tariffs_known(q, rates, sets)
    assert names == [*[f"LEVY:c{k}" for k in range(9)], "MFN"] and [r[n] for r in wide.collect() for n in names] == [[f"r{k}"] for k in range(9)] + [["m"]]


def test_hot_key_with_a_long_history(spark):
    # a row of facts for each hour of 200 days under one key, joined by time buckets
    f = spark.range(4800).selectExpr("'hot' k", "'a' attr", "cast(id as string) v", "timestamp_ntz'2026-01-01' + make_dt_interval(0, cast(id as int)) s", "timestamp_ntz'2026-01-01' + make_dt_interval(0, cast(id as int) + 1) e")
    e = spark.range(9600).selectExpr("id", "'hot' k", "timestamp_ntz'2026-01-01' + make_dt_interval(0, 0, cast(id * 30 as int)) at")
    h = stored(change_history(f, ["k"], "attr", "v", "s", "e"), "h")
    got = last_known(e, h, ["k"], "at", 0).selectExpr("count(*) n", "count_if(known_values = array(cast(id div 2 as string))) as good").first()
    assert tuple(got) == (9600, 9600) and attribute_names(h, "attr") == ["a"]
