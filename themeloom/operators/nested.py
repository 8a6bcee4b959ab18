"""Deeply nested JSON records as related flat tables, linked by Dewey labels.

Every node of a record's document gets the path of ordinals that leads to it as its label. A label names its node within the record, the
label without its last ordinal names the parent, and the nodes that share a schema path (the same keys, list positions left out) form one
flat table. No key has to be known in advance and no depth is assumed.

Labelling needs the order of a list and walks values whose shape differs from record to record, so it runs over Arrow batches in Python,
as one narrow stage: no shuffle, no state beyond one record, nothing that depends on how the records are distributed.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread

NODES = "rec bigint, field string, label array<int>, keys array<string>, schema_path string, kind string, text string"
_ARROW = pa.schema([("rec", pa.int64()), ("field", pa.string()), ("label", pa.list_(pa.int32())), ("keys", pa.list_(pa.string())), ("schema_path", pa.string()), ("kind", pa.string()), ("text", pa.string())])


def _constant(name: str) -> None:
    raise ValueError(f"{name} is no JSON")


def parse_object(text: str | None) -> dict | None:
    """The object that the whole of `text` is, or None: for null, empty or damaged text, other values, and nesting beyond the parser's bound."""
    if not text:
        return None
    try:
        value = json.loads(text, parse_constant=_constant)
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def _scalar(value: object) -> str | None:
    return value if isinstance(value, str) else None if value is None else json.dumps(value)


def _kind(value: object) -> str:
    return {dict: "object", list: "list", str: "string", bool: "boolean", type(None): "null"}.get(type(value), "number")


def label_nodes(document: dict, leaves_only: bool = False, only: dict[str, int] | None = None) -> Iterator[tuple[list[int], list[str | None], str, str, str | None]]:
    """``(label, keys, schema_path, kind, text)`` of the nodes below the document's root, parents before children, by an explicit stack.

    `keys` holds the key at each level, null for a list's element. In a schema path the outermost key, a value in this data (a language, a
    property), is written ``*``; an element is ``[]``. With `only` the nodes below these outermost keys alone come out. A value of an outermost key that isn't a list counts as a list of one, so every item
    has the same label depth.
    """
    stack: list[tuple[list[int], list[str | None], str, object]] = []
    for i, (key, value) in reversed(list(enumerate(document.items()))):
        if only is not None and key not in only:
            continue
        stack.append(([i], [key], "*", value if isinstance(value, list) else [value]))
    while stack:
        label, keys, path, value = stack.pop()
        if isinstance(value, dict):
            children = [([*label, i], [*keys, k], f"{path}.{k}", v) for i, (k, v) in enumerate(value.items())]
        elif isinstance(value, list):
            children = [([*label, i], [*keys, None], f"{path}[]", v) for i, v in enumerate(value)]
        else:
            children = []
        if not (leaves_only and isinstance(value, (dict, list))):
            yield label, keys, path, _kind(value), _scalar(value) if not isinstance(value, (dict, list)) else None
        stack.extend(reversed(children))


class _Nodes:
    """Columns of `NODES` as they grow; the lists of a column lie one behind the other, with their lengths beside."""

    def __init__(self) -> None:
        self.rec: list[int | None] = []
        self.field: list[str] = []
        self.path: list[str] = []
        self.kind: list[str] = []
        self.text: list[str | None] = []
        self.label: list[int] = []
        self.keys: list[str | None] = []
        self.depth: list[int] = []

    def add(self, rec: int | None, field: str, document: dict, leaves_only: bool) -> None:
        before = len(self.path)
        if leaves_only:
            odd = {}
            for i, (key, value) in enumerate(document.items()):  # texts and lists of texts, as most are
                if all(type(x) is str for x in value) if type(value) is list else type(value) is str:
                    texts = value if type(value) is list else [value]
                    self.text.extend(texts)
                    for j in range(len(texts)):
                        self.label += (i, j)
                        self.keys += (key, None)
                    self.depth.extend([2] * len(texts))
                    self.path.extend(["*[]"] * len(texts))
                    self.kind.extend(["string"] * len(texts))
                else:
                    odd[key] = i
        else:
            odd = None
        if odd is None or odd:
            for label, keys, path, kind, text in label_nodes(document, leaves_only, odd):
                self.label += label
                self.keys += keys
                self.depth.append(len(label))
                self.path.append(path)
                self.kind.append(kind)
                self.text.append(text)
        n = len(self.path) - before
        self.rec.extend([rec] * n)
        self.field.extend([field] * n)

    def batch(self) -> pa.RecordBatch:
        offsets = pa.array(np.concatenate([[0], np.cumsum(self.depth)]).astype(np.int32))
        label, keys = (pa.ListArray.from_arrays(offsets, pa.array(x, t)) for x, t in ((self.label, pa.int32()), (self.keys, pa.string())))
        columns = [pa.array(self.rec, pa.int64()), pa.array(self.field, pa.string()), label, keys, *(pa.array(x, pa.string()) for x in (self.path, self.kind, self.text))]
        return pa.RecordBatch.from_arrays(columns, schema=_ARROW)


def shred(records: DataFrame, rec: str, fields: list[str], leaves_only: bool = False) -> DataFrame:
    """The nodes (see `NODES`) of the JSON objects in the columns `fields` of every row; `rec` is the row's number.

    A field that is null, empty, damaged or not one whole JSON object has no nodes. Repeated rows keep their own nodes under their own
    `rec`; rows with a null `rec` are kept with a null link. Of repeated keys within one object the last counts. Other columns don't matter.
    """
    picked = spread(records).select(F.col(rec).cast("bigint").alias("rec"), *[F.col(f).cast("string").alias(f"field_{i}") for i, f in enumerate(fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = _Nodes()
            numbers = batch.column(0).to_pylist()
            for i, field in enumerate(fields):
                for number, text in zip(numbers, batch.column(i + 1).to_pylist(), strict=True):
                    document = parse_object(text)
                    if document:
                        out.add(number, field, document, leaves_only)
                    if len(out.rec) >= 20_000:
                        yield out.batch()
                        out = _Nodes()
            yield out.batch()

    return picked.mapInArrow(run, NODES)


def with_parents(nodes: DataFrame) -> DataFrame:
    """Adds ``parent``, the label without its last ordinal (empty for a child of the root)."""
    return nodes.withColumn("parent", F.slice("label", F.lit(1), F.size("label") - 1))


def table_of(nodes: DataFrame, field: str, schema_path: str) -> DataFrame:
    """The flat table of one schema path: ``(rec, label, parent, item_key, pos, text)``, pos being the place among the siblings."""
    return with_parents(nodes.where((F.col("field") == field) & (F.col("schema_path") == schema_path))).select("rec", "label", "parent", F.col("keys")[0].alias("item_key"), F.element_at("label", -1).alias("pos"), "text")


def schema_paths(nodes: DataFrame) -> DataFrame:
    """The tables there are: ``(field, schema_path, kind, nodes)``."""
    return nodes.groupBy("field", "schema_path", "kind").agg(F.count(F.lit(1)).alias("nodes"))


def items(nodes: DataFrame, text_keys: tuple[str, ...] = ("value", "id")) -> DataFrame:
    """The texts of the items below each outermost key: ``(rec, field, item_key, item_pos, item)``.

    An item is an element of the list under an outermost key; truncating a leaf's label to two ordinals gives the item it belongs to. A text
    element is its own item; of an object, texts count whose nearest key is one of `text_keys`, at any depth. Blank texts count for nothing.
    """
    depth = F.size("label")
    # within a list the elements have no key of their own: the nearest key above them counts
    nearest = F.element_at(F.filter("keys", lambda k: k.isNotNull()), -1)
    inside_object = F.exists(F.slice("keys", F.lit(3), F.greatest(depth - 2, F.lit(0))), lambda k: k.isNotNull())
    text = F.regexp_replace("text", r"(?U)^\s+|\s+$", "")
    return (
        nodes.where((F.col("kind") == "string") & ((depth == 2) | (inside_object & nearest.isin(*text_keys))))
        .select("rec", "field", F.col("keys")[0].alias("item_key"), F.col("label")[1].cast("bigint").alias("item_pos"), text.alias("item"))
        .where(F.col("item") != "")
    )
