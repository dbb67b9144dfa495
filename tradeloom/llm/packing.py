"""Packing texts into containers of a fixed number of tokens, by lexical retrieval.

Texts are routed to shards by content, by one rule at every size: a tree, fitted to a sample, splits them by the direction in which their
hashed term vectors differ most, into shards of about equal tokens. Each shard has an inverted BM25 index of its texts; term statistics
are those of all texts. In a shard the largest unused text seeds a container, the index returns its unused neighbours, and they fill the window greedily;
what they leave is closed with the largest unused text that fits.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .tokens import VOCABULARY, encode, encoding, spread

#: Tokens of a shard: some 1,000 containers, a few MB in the memory of a task.
SHARD_TOKENS = 2_000_000
#: Length of a text's hashed term vector; texts of the sample for each shard, and at least.
PARTS, SAMPLE_A_SHARD, SAMPLE = 256, 16, 4_000
#: BM25's usual constants. A term that more than one in DENSE items of a shard hold is common.
K1, B, DENSE = 1.2, 0.75, 20

#: Stands for a null doc_id on the way through pandas, which has no null for integers.
NO_ID = -(2**63)

PACKED = "container string, position int, doc_id long, piece_no int, first_token int, n_tokens int"
_ITEMS = "doc_id long, source string, piece_no int, first_token int, n_tokens int, terms binary, counts binary"
_ITEM_ARROW = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("piece_no", pa.int32()), ("first_token", pa.int32()), ("n_tokens", pa.int32()), ("terms", pa.binary()), ("counts", pa.binary())])


def items(docs: DataFrame, capacity: int, path: str = VOCABULARY) -> DataFrame:
    """The items to pack: a text within the capacity is one; a larger one is cut into full containers and a rest.
    Null and empty texts are items of size 0. terms and counts hold an item's token ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, source, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                ids = np.asarray(encode(text, path), dtype="int32")
                for k, at in enumerate(range(0, max(len(ids), 1), capacity)):
                    part = ids[at : at + capacity]
                    terms, counts = np.unique(part, return_counts=True)
                    rows.append((doc, source, k, at, len(part), terms.astype("int32").tobytes(), counts.astype("uint16").tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ITEM_ARROW, strict=True)], schema=_ITEM_ARROW)

    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col("source").cast("string"), F.col("text").cast("string"))
    return spread(own).mapInArrow(run, _ITEMS)


def term_statistics(parts: DataFrame, vocabulary: int) -> tuple[np.ndarray, int, float]:
    """(document frequency by token id, number of items, mean size) over all items with text, full ones included. The vector has the vocabulary's size, whatever the data's."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(vocabulary, dtype="int64")
        for batch in batches:
            for terms in batch.column(0).to_pylist():
                df[np.frombuffer(terms, dtype="int32")] += 1
        at = np.nonzero(df)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(df[at], pa.int64())], names=["term", "n"])

    df = np.zeros(vocabulary, dtype="int64")
    for term, n in parts.select("terms").mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        df[term] = n
    n, mean = parts.filter(F.length("terms") > 0).agg(F.count("*"), F.avg("n_tokens")).first()
    return df, n, mean or 1.0


def vectors(terms: Iterable[bytes], counts: Iterable[bytes], df: np.ndarray, n: int) -> np.ndarray:
    """A row for each item: its terms by rarity and count, hashed into PARTS places with a sign, of length 1 (0 without terms)."""
    rows = []
    for t, c in zip(terms, counts, strict=True):
        ids = np.frombuffer(t, dtype="int32")
        hashed = (ids.astype("uint64") * np.uint64(2654435761)) % np.uint64(2**32)
        weight = np.log1p(n / np.maximum(df[ids], 1)) * np.log1p(np.frombuffer(c, dtype="uint16"))
        row = np.bincount((hashed >> np.uint64(8)).astype("int64") % PARTS, weight * np.where(hashed >> np.uint64(31), 1.0, -1.0), PARTS)
        rows.append(row / (np.sqrt(row @ row) or 1.0))
    return np.array(rows, dtype="float32").reshape(-1, PARTS)


class Routing:
    """A binary tree over vectors whose leaves are the shards. Vectors that lie on a node's border (copies of one text, say) go to either side by a hash."""

    BORDER = 1e-4

    def __init__(self, sample: np.ndarray, sizes: np.ndarray, shards: int) -> None:
        self.direction, self.middle, self.children = [], [], []
        self.root = self._grow(sample.astype("float32"), sizes.astype("float64"), 0, shards)
        self.direction = np.array(self.direction, dtype="float32").reshape(-1, PARTS)
        self.middle, self.children = np.array(self.middle), np.array(self.children, dtype="int64").reshape(-1, 2)

    def _grow(self, x: np.ndarray, sizes: np.ndarray, first: int, shards: int) -> int:
        """The number of a node; -1 - k stands for leaf k."""
        if shards == 1:
            return -1 - first
        node, share = len(self.middle), shards // 2
        self.direction.append(np.zeros(PARTS, "float32"))
        self.middle.append(0.0)
        self.children.append((0, 0))
        left = np.zeros(len(x), dtype=bool)
        if len(x):
            centred = x - np.average(x, axis=0, weights=sizes)
            # what tells texts by their size is left out, so that both sides get large and small ones and containers can be filled
            classes = np.searchsorted(np.quantile(sizes, [0.25, 0.5, 0.75]), sizes)
            means = np.array([centred[classes == c].mean(0) for c in np.unique(classes)])
            _, weight, by_size = np.linalg.svd(means, full_matrices=False)
            by_size = by_size[weight > 1e-6].astype("float32")
            centred = centred - centred @ by_size.T @ by_size
            v = centred[np.argmax((centred**2).sum(1))]
            for _ in range(20):  # towards the principal direction
                v = centred.T @ (centred @ v)
                v = v / (np.sqrt(v @ v) or 1.0)
            at = x @ v
            order = np.argsort(at, kind="stable")
            held = np.cumsum(sizes[order])
            k = min(int(np.searchsorted(held, held[-1] * share / shards)), len(x) - 1)
            self.direction[node] = v
            self.middle[node] = float(at[order[k]] + at[order[min(k + 1, len(x) - 1)]]) / 2
            left[order[: k + 1]] = True
        self.children[node] = (self._grow(x[left], sizes[left], first, share), self._grow(x[~left], sizes[~left], first + share, shards - share))
        return node

    def leaves(self, x: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        at, level = np.full(len(x), self.root, dtype="int64"), 0
        while len(inner := np.nonzero(at >= 0)[0]):
            off = (x[inner] * self.direction[at[inner]]).sum(1) - self.middle[at[inner]]
            right = np.where(np.abs(off) <= self.BORDER, hashes[inner] >> level & 1, off > 0)
            at[inner] = self.children[at[inner], right.astype("int64")]
            level += 1
        return (-1 - at).astype("int32")


def with_shards(parts: DataFrame, shard_tokens: int, capacity: int, statistics: Broadcast) -> DataFrame:
    """parts with a shard, as many as the tokens of the items that have to find their place ask for, whatever their sources."""
    spark = parts.sparkSession
    _, n, _ = statistics.value
    loose = parts.filter((F.col("n_tokens") > 0) & (F.col("n_tokens") < capacity))
    shards = max(1, -(-int(loose.agg(F.sum("n_tokens")).first()[0] or 0) // shard_tokens))
    hashes = F.xxhash64("doc_id", "piece_no", "terms")

    @F.pandas_udf("binary")
    def vector(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for terms, counts in batches:
            yield pd.Series([r.astype("float16").tobytes() for r in vectors(terms, counts, *statistics.value[:2])])

    # sorted, so that the tree does not depend on the order in which rows arrive
    share = min(1.0, max(SAMPLE, SAMPLE_A_SHARD * shards) / max(n, 1))
    sample = sorted(map(tuple, loose.filter(F.pmod(hashes, F.lit(1 << 20)) < share * (1 << 20)).select(vector("terms", "counts"), "n_tokens").collect())) if shards > 1 else []
    flat = np.frombuffer(b"".join(bytes(v) for v, _ in sample), dtype="float16").reshape(-1, PARTS)
    routing = spark.sparkContext.broadcast(Routing(flat, np.array([k for _, k in sample]), shards))

    @F.pandas_udf("int")
    def leaf(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for terms, counts, keys in batches:
            yield pd.Series(routing.value.leaves(vectors(terms, counts, *statistics.value[:2]), keys.to_numpy("int64") >> 20))

    return parts.withColumn("shard", leaf("terms", "counts", hashes))


class Index:
    """An inverted index of a shard's items with BM25 weights. A query is a whole item, all of its terms: the common ones, which most items hold, are kept as a
    dense matrix, the others as postings, so that exact scores of all items cost one product and some short additions."""

    def __init__(self, terms: list[np.ndarray], counts: list[np.ndarray], sizes: np.ndarray, df: np.ndarray, n: int, mean: float) -> None:
        self.size = len(terms)
        flat = np.concatenate(terms) if terms else np.zeros(0, "int32")
        tf = np.concatenate(counts).astype("float32") if counts else np.zeros(0, "float32")
        item = np.repeat(np.arange(len(terms), dtype="int32"), [len(t) for t in terms])
        idf = np.log1p((n - df[flat] + 0.5) / (df[flat] + 0.5)).astype("float32")
        weight = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[item] / mean)).astype("float32")
        # terms are numbered from the most common in this shard
        ids, place, held = np.unique(flat, return_inverse=True, return_counts=True)
        rank = np.empty(len(ids), dtype="int64")
        rank[np.argsort(-held, kind="stable")] = np.arange(len(ids))
        common = int(np.count_nonzero(held * DENSE > self.size))
        place = rank[place]
        dense = place < common
        self.matrix = np.zeros((common, self.size), dtype="float32")
        self.matrix[place[dense], item[dense]] = weight[dense]
        order = np.argsort(place, kind="stable")
        self.item, self.weight = item[order], weight[order]
        self.starts = np.searchsorted(place[order], np.arange(len(ids) + 1))
        ends = np.cumsum([len(t) for t in terms]) if terms else np.zeros(0, "int64")
        self.queries = np.split(place, ends[:-1]) if terms else []

    def scores(self, k: int) -> np.ndarray:
        """The BM25 score of every item for the terms of item k."""
        query = self.queries[k]
        common = query[query < len(self.matrix)]
        wanted = np.zeros(len(self.matrix), dtype="float32")
        wanted[common] = 1.0
        out = wanted @ self.matrix
        spans = [(self.starts[t], self.starts[t + 1]) for t in query[query >= len(self.matrix)].tolist()]
        if spans:
            at = np.concatenate([self.item[a:b] for a, b in spans])
            out += np.bincount(at, np.concatenate([self.weight[a:b] for a, b in spans]), self.size).astype("float32")
        return out


def pack_shard(sizes: np.ndarray, index: Index, capacity: int) -> list[list[int]]:
    """Containers of item numbers. Items come sorted by identity; ties go to the first. Items of size 0 go into the first container."""
    empty = [k for k in range(len(sizes)) if sizes[k] == 0]
    queue = sorted((k for k in range(len(sizes)) if sizes[k] > 0), key=lambda k: (-sizes[k], k))
    unused = np.zeros(len(sizes), dtype=bool)
    unused[queue] = True
    by_size = sorted((int(sizes[k]), -k) for k in queue)  # what is unused, small first
    containers: list[list[int]] = []

    def take(k: int) -> None:
        unused[k] = False
        by_size.pop(bisect.bisect_left(by_size, (int(sizes[k]), -k)))

    for seed in queue:
        if not unused[seed]:
            continue
        take(seed)
        held, room = [seed], capacity - int(sizes[seed])
        if room and by_size and by_size[0][0] <= room:
            score = index.scores(seed)
            near = np.nonzero(unused & (score > 0) & (sizes <= room))[0]
            for k in near[np.argsort(-score[near], kind="stable")].tolist():
                # a neighbour is taken while it leaves room that something unused can still close, or closes it itself
                left = room - int(sizes[k])
                if left < 0 or not unused[k]:
                    continue
                if left and left < by_size[0][0] and left > capacity // 100:
                    continue
                take(k)
                held.append(k)
                room = left
                if not by_size or room < by_size[0][0]:
                    break
            while room and by_size and by_size[0][0] <= room:
                k = -by_size[bisect.bisect_right(by_size, (room, 1)) - 1][1]
                take(k)
                held.append(k)
                room -= int(sizes[k])
        containers.append(held)
    if empty:
        containers = [[*containers[0], *empty], *containers[1:]] if containers else [empty]
    return containers


def pack(docs: DataFrame, capacity: int = 2048, shard_tokens: int = SHARD_TOKENS, path: str = VOCABULARY) -> DataFrame:
    """container, position, doc_id, piece_no, first_token, n_tokens: every text in one container, or, if it is larger than a container, in
    several: full ones of its own and one that holds its rest. Repeated rows are packed each; a null doc_id is a document like any."""
    spark = docs.sparkSession
    parts = stored(items(docs, capacity, path), "items")
    df, n, mean = term_statistics(parts, encoding(path).n_vocab)
    statistics = spark.sparkContext.broadcast((df, n, mean))

    def shard(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "piece_no"], kind="stable").reset_index(drop=True)
        sizes = pdf["n_tokens"].to_numpy("int64")
        full = sizes == capacity
        rest = np.nonzero(~full)[0]
        terms = [np.frombuffer(pdf["terms"][k], dtype="int32") for k in rest]
        counts = [np.frombuffer(pdf["counts"][k], dtype="uint16") for k in rest]
        held = pack_shard(sizes[rest], Index(terms, counts, sizes[rest], *statistics.value), capacity)
        groups = [[int(rest[k]) for k in g] for g in held] + [[int(k)] for k in np.nonzero(full)[0]]
        order = [k for g in groups for k in g]
        out = pdf.loc[order, ["doc_id", "piece_no", "first_token", "n_tokens"]]
        out.insert(0, "container", [f"{pdf['shard'][0]}-{c}" for c, g in enumerate(groups) for _ in g])
        out.insert(1, "position", [p for g in groups for p in range(len(g))])
        return out

    # full items have their container, and need no terms from here on
    loose = F.col("n_tokens") < capacity
    sharded = with_shards(parts, shard_tokens, capacity, statistics).drop("source").withColumns({c: F.when(loose, F.col(c)) for c in ("terms", "counts")})
    packed = sharded.groupBy("shard").applyInPandas(shard, PACKED)
    return packed.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))
