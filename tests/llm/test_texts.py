import random

import numpy as np
import pytest

from tradeloom.llm.mixing import mix
from tradeloom.llm.packing import Index, pack, pack_shard
from tradeloom.llm.splitting import _Sized, merge, split, split_documents
from tradeloom.llm.tokens import VOCABULARY, encode, encoding

DOC = "doc_id long, source string, text string, n_tokens int, cut string, shard string"
RNG = random.Random(5)
WORDS = [w * 2 for w in "lamp kettle rope duty permit ruling notice carton pallet broker".split()]


def prose(n):
    return " ".join(RNG.choice(WORDS) + RNG.choice(["", ",", ".", ".\n", "\n\n"]) for _ in range(n))


TEXTS = ["", " ", "short", prose(900), "单词，" * 900, "汉" * 2000, "x9" * 4000, "é" * 3000, prose(300) + "q" * 6000 + prose(300), "|a|b|\n" * 700, "\U0001f600" * 800, " " * 5000]


@pytest.mark.parametrize("text", TEXTS)
@pytest.mark.parametrize(("limit", "overlap"), [(512, 64), (128, 16)])
def test_pieces_cover_the_text(text, limit, overlap):
    pieces = split(text, limit, overlap)
    at = 0
    for piece, n, shared in pieces:
        assert n <= limit and n == len(encode(piece))
        start = text.rfind(piece, max(0, at - len(piece)), at + len(piece))
        start = at if start < 0 else min(start, at)
        assert text[: start + len(piece)].endswith(piece) or piece in text
        at = max(at, start + len(piece))
    assert "".join(p for p, _, _ in pieces[:1]) == text[: len(pieces[0][0])] and text.endswith(pieces[-1][0])
    assert all(overlap <= s <= overlap + 3 for _, _, s in pieces[1:])


def test_weak_boundaries_merge_first():
    low, high = [0, 3, 6, 9], [2, 5, 8, 11]
    assert merge([6, 2, 5, 1], low, high, 6, 6) == [(0, 1), (2, 3)]
    assert merge([6, 5, 1], low[:3], high[:3], 6, 6) == [(0, 0), (1, 2)]


@pytest.mark.parametrize("seed", range(4))
def test_a_piece_counts_like_a_text_of_its_own(seed):
    rng = random.Random(seed)
    text = "".join(rng.choice([" word", "Zahl 12", "漢字", "\n\n", "  ", "!!", " é", " l'eau", "\U0001f600", ". A"]) for _ in range(600))
    sized = _Sized(text, encode(text), VOCABULARY)
    for _ in range(200):
        a, b = sorted(rng.sample(range(len(text) + 1), 2))
        assert sized.alone(a, b) == len(encode(text[a:b]))


def test_token_counts_are_exact_at_any_length():
    enc = encoding()
    for text in (prose(40_000), "汉" * 200_000, "q" * 200_000, prose(50) + " \n" * 30_000 + "end", "a" + " " * 40_000):
        assert encode(text) == enc.encode_ordinary(text)
    assert len(encode("x" + " " * 2_000_000 + "y")) > 2


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "clash", "clash") for r in rows], DOC)


def test_split_documents(spark):
    rows = [(k, "s", t) for k, t in enumerate(TEXTS)] + [(99, "s", None), (0, "s", "")]
    got = split_documents(frame(spark, rows))
    cuts = {r.doc_id: r.cut for r in got.filter("piece_no = 0").collect()}
    assert cuts[3] == cuts[4] == "boundary" and cuts[5] == cuts[6] == cuts[8] == "forced" and cuts[2] == "whole" and 99 not in cuts
    assert got.filter("doc_id = 0").count() == 2 and split_documents(frame(spark, [])).count() == 0


def test_packing_is_whole(spark):
    rows = [(k, RNG.choice(["a", "b", None]), prose(RNG.randrange(1, 200))) for k in range(300)] + [(1000, "a", None), (1001, "a", ""), (1002, None, prose(3000)), (None, "a", "no id"), (5, "a", "again")]
    got = pack(frame(spark, rows), 512, shard_tokens=20_000).collect()
    held = {}
    for r in got:
        held[r.container] = held.get(r.container, 0) + r.n_tokens
    assert max(held.values()) <= 512
    want = sorted((d if d is not None else -1, len(encode(t))) for d, _, t in rows)
    whole = {}
    for r in got:
        key = (r.doc_id if r.doc_id is not None else -1, r.first_token == 0)
        whole.setdefault(r.doc_id if r.doc_id is not None else -1, []).append(r.n_tokens)
    assert {k: sum(v) for k, v in whole.items()} == {d: sum(n for e, n in want if e == d) for d, _ in want}
    assert sum(held.values()) / (512 * len(held)) > 0.95
    assert pack(frame(spark, [])).count() == 0


def test_neighbours_share_terms():
    terms = [np.array(t, dtype="int32") for t in ([1, 2, 3], [7, 8, 9], [1, 2, 4], [7, 8])]
    counts = [np.ones(len(t), dtype="uint16") for t in terms]
    sizes = np.array([60, 59, 40, 41])
    df = np.bincount(np.concatenate(terms), minlength=20)
    groups = pack_shard(sizes, Index(terms, counts, sizes, df, 4, 50.0), 100)
    assert sorted(map(sorted, groups)) == [[0, 2], [1, 3]]


def test_mix(spark):
    rows = [(k, s, f"{s} {prose(RNG.randrange(5, 60))} {k}") for k, s in enumerate(RNG.choices(["a", "b", "c", "z"], [60, 30, 10, 5], k=400))]
    copies = [(1000 + k, rows[k][1], rows[k][2]) for k in range(20)] + [(2000, "a", None), (2001, "a", ""), (2002, None, "x"), (2003, "b", next(t for _, s, t in rows if s == "a"))]
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 3), ("none", 0.0, 1)], "source string, target_weight double, max_repeats int")
    chosen, shares = mix(frame(spark, rows + copies), targets)
    chosen, shares = chosen.collect(), {r.source: r for r in shares.collect()}
    text = {d: t for d, _, t in rows + copies}
    used = {}
    for r in chosen:
        used[text[r.doc_id]] = used.get(text[r.doc_id], 0) + r.times_used
        assert r.n_tokens == len(encode(text[r.doc_id]))
    caps = {"a": 1, "b": 2, "c": 3}
    assert all(used[text[r.doc_id]] <= caps[r.source] for r in chosen) and len({text[r.doc_id] for r in chosen}) == len(chosen)
    for s, w in (("a", 0.5), ("b", 0.3), ("c", 0.2)):
        assert abs(shares[s].share - w) < 0.02 and shares[s].used_tokens <= shares[s].budget
    assert shares["none"].share == 0 and shares["none"].available == 0
    again = mix(frame(spark, rows + copies), targets)[0].collect()
    assert sorted(again) == sorted(chosen)
    assert mix(frame(spark, []), targets)[0].count() == 0


def test_shards_hold_neighbours(spark):
    from tradeloom.llm.packing import items, term_statistics, with_shards
    from tradeloom.llm.tokens import encoding

    rng = random.Random(9)
    topics = [rng.sample(sorted({w for w in "harbour copper violin glacier saffron turbine mosaic lantern orchard velvet granite compass tundra ribbon falcon marble walnut cedar bronze meadow canyon pepper anchor silver".split()}), 6) for _ in range(12)]
    # one large source: its shards used to be a hash of it
    rows = [(k, "a", " ".join(rng.choices(topics[k % 12], k=40))) for k in range(1200)] + [(5000, "a", "pallet " * 3000)]
    parts = items(frame(spark, rows), 512)
    df, n, mean = term_statistics(parts, encoding().n_vocab)
    pieces = parts.filter("doc_id = 5000").count()
    assert pieces > 5 and n == 1200 + pieces and df.max() >= pieces and df[encode(" pallet pallet")[-1]] == pieces
    got = with_shards(parts, 8_000, 512, spark.sparkContext.broadcast((df, n, mean))).filter("doc_id < 5000").select("doc_id", "shard", "n_tokens").collect()
    shard, tokens = {r.doc_id: r.shard for r in got}, {}
    for r in got:
        tokens[r.shard] = tokens.get(r.shard, 0) + r.n_tokens
    assert len(tokens) > 4 and max(tokens.values()) < 16_000
    # of two texts of a topic, far more are in one shard than the hash's 1 in the number of shards
    pairs = [(a, b) for a in range(0, 1200, 7) for b in range(a % 12, 1200, 12) if a != b]
    assert sum(shard[a] == shard[b] for a, b in pairs) / len(pairs) > 3 / len(tokens)


def test_copies_spread(spark):
    held = pack(frame(spark, [(k, "a", "one text for all of them") for k in range(2000)]), 512, shard_tokens=2_000).groupBy("doc_id").count().collect()
    assert len(held) == 2000 and {r["count"] for r in held} == {1}
