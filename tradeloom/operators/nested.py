"""Deeply nested records into flat tables, by single-pass tagged emission.

One depth-first visit of each payload emits rows (table_tag, pk, parent_pk, record_id, positions, payload); the
rows are written partitioned by tag, without a shuffle, and each tag is read back under its own schema.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch

TAGGED = "table_tag string, pk string, parent_pk string, record_id string, positions array<int>, payload string"
ARROW = pa.schema([("table_tag", pa.string()), ("pk", pa.string()), ("parent_pk", pa.string()), ("record_id", pa.string()), ("positions", pa.list_(pa.int32())), ("payload", pa.string())])
FLUSH_ROWS = 20_000


@dataclass(frozen=True)
class Level:
    """One table: its tag, the letter of its keys, the names its list may have in the parent, its schema."""

    tag: str
    letter: str
    names: tuple[str, ...]
    schema: str


@dataclass(frozen=True)
class Layout:
    """The root object is the first, depth first through objects only, that has the key `marker`."""

    marker: str
    root: Level
    levels: tuple[Level, ...] = field(default_factory=tuple)


CATALOGUE = Layout(
    "title",
    Level("products", "", (), "title string, body string, vendor string, country_code string, details map<string,string>"),
    (
        Level("variants", "v", ("variants", "skus", "items"), "sku string, options array<struct<name:string,value:string>>"),
        Level("packs", "p", ("packs", "packagings", "units"), "code string, qty string, gross struct<weight:struct<value:string,unit:string>>"),
        Level("prices", "r", ("prices", "offers", "price_list"), "currency string, amount string, min_qty string, valid struct<`from`:string,`to`:string>"),
    ),
)


def _reject_constant(name: str) -> None:
    raise ValueError(f"{name} is no JSON")


#: Fractions keep their source text.
_DECODER = json.JSONDecoder(parse_constant=_reject_constant, parse_float=str)


def parse_payload(text: str | None) -> dict | str:
    """The payload's object, or why it has none. A JSON string is opened once."""
    if text is None:
        return "null"
    try:
        value = _DECODER.decode(text)
        if isinstance(value, str):
            value = _DECODER.decode(value)
    except RecursionError:
        return "too deep"
    except ValueError:
        return "not JSON"
    return value if isinstance(value, dict) else "no object"


def find_root(value: dict, marker: str) -> dict | None:
    """Depth first, in the order of keys, objects only; without recursion."""
    stack = [value]
    while stack:
        node = stack.pop()
        if marker in node:
            return node
        stack.extend(v for v in reversed(node.values()) if isinstance(v, dict))
    return None


def children(node: dict, names: Iterable[str]) -> tuple[str | None, list]:
    """The list under the first of the names that holds a list or an object."""
    for name in names:
        value = node.get(name)
        if isinstance(value, list):
            return name, value
        if isinstance(value, dict):
            return name, [value]
    return None, []


def visit(record_id: str | None, text: str | None, layout: Layout) -> Iterator[tuple]:
    """The tagged rows of one payload, parents before children."""
    value = parse_payload(text)
    root = find_root(value, layout.marker) if isinstance(value, dict) else None
    if root is None:
        yield "rejects", record_id, None, record_id, [], json.dumps({"reason": value if isinstance(value, str) else f"no {layout.marker}"})
        return
    key = "" if record_id is None else record_id

    def emit(node: dict, level: Level, depth: int, pk: str, parent: str | None, positions: list[int]) -> Iterator[tuple]:
        below = layout.levels[depth] if depth < len(layout.levels) else None
        name, elements = children(node, below.names) if below else (None, [])
        yield level.tag, pk, parent, record_id, positions, json.dumps({k: v for k, v in node.items() if k != name})
        for n, element in enumerate(elements):
            if isinstance(element, dict):
                yield from emit(element, below, depth + 1, f"{pk}/{below.letter}{n}", pk, [*positions, n])

    yield from emit(root, layout.root, 0, key, None, [])


def emit_tagged(records: DataFrame, key: str = "id", payload: str = "payload", layout: Layout = CATALOGUE) -> DataFrame:
    """The tagged rows of all records; no shuffle.

    Payloads that are null, blank, no complete JSON object, nested too deeply for the parser or without the marker
    give one row tagged `rejects` with the reason. A null record id is kept as null, its keys start with `/`. A
    repeated record repeats its rows. Other columns of the input don't matter, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sys.set_int_max_str_digits(0)
        rows: list[tuple] = []
        for batch in batches:
            for record_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows.extend(list(visit(record_id, text, layout)))
                except RecursionError:
                    rows.append(("rejects", record_id, None, record_id, [], '{"reason": "too deep"}'))
                if len(rows) >= FLUSH_ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)

    return records.select(F.col(key).cast("string").alias("k"), F.col(payload).cast("string").alias("p")).mapInArrow(run, TAGGED)


class FlatTables:
    """The written tables of one flattening; each tag is a directory, so a table reads its own files only."""

    def __init__(self, path: str, layout: Layout, spark) -> None:
        self.path, self.layout, self.spark = path, layout, spark

    def tagged(self) -> DataFrame:
        return self.spark.read.schema(TAGGED).parquet(self.path)

    def get(self, tag: str) -> DataFrame:
        """pk, parent_pk, record_id, positions and the fields of the table's schema; values of another type are null."""
        level = next(x for x in (self.layout.root, *self.layout.levels, Level("rejects", "", (), "reason string")) if x.tag == tag)
        rows = self.tagged().filter(F.col("table_tag") == tag)
        return rows.withColumn("row", F.from_json("payload", level.schema)).select("pk", "parent_pk", "record_id", "positions", "row.*")


def flatten(records: DataFrame, key: str = "id", payload: str = "payload", layout: Layout = CATALOGUE, path: str | None = None) -> FlatTables:
    """Flatten records into tables at path (by default in the shared scratch folder)."""
    path = path or scratch(records.sparkSession, "flat")
    emit_tagged(records, key, payload, layout).write.partitionBy("table_tag").parquet(path)
    return FlatTables(path, layout, records.sparkSession)
