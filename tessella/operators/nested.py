"""Nested semi-structured records as related flat tables.

One pass over each record: a depth-first visitor emits a tagged row for every
object found in an array, with its own position path, its parent's, and its
scalar fields as payload. Tags are then given schemas, or written partitioned.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from json.decoder import scanstring

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fields that hold lists of objects (fixed values, from the record layout).
LIST_FIELDS = (
    "legislation_cited", "jurisprudence_cited", "doctrine_cited", "parties", "amounts_involved", "timeline_events",
    "injuries", "representatives", "mandates", "exhibits", "treatments",
)
#: Fields that describe how a record was made and are no data.
SKIPPED = ("model_notes",)


def _constant(name: str) -> None:
    raise ValueError(name)


def parse(text: str | None) -> object:
    """The value of a JSON text, however deep it is nested; None where it is not valid as a whole."""
    if not text:
        return None
    try:
        return json.loads(text, parse_constant=_constant)
    except RecursionError:
        return parse_deep(text)
    except ValueError:
        return None


NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?", re.ASCII)
BLANK = re.compile(r"[ \t\n\r]*")
WORDS = {"t": ("true", True), "f": ("false", False), "n": ("null", None)}


def parse_deep(text: str) -> object:
    """As ``parse``, with the open lists and objects on a stack of its own, for nesting that the built-in parser refuses."""
    held: list[tuple[list | dict, str | None]] = []  # open containers, each with the key that it stands under
    at = BLANK.match(text).end()  # type: ignore[union-attr]
    key: str | None = None
    try:
        while True:
            c = text[at]
            if c in "{[":
                inner: object = {} if c == "{" else []
                after = BLANK.match(text, at + 1).end()  # type: ignore[union-attr]
                if text[after] != ("}" if c == "{" else "]"):
                    held.append((inner, key))
                    key, at = _key(text, after) if c == "{" else (None, after)
                    continue
                value, at = inner, after + 1
            elif c == '"':
                value, at = scanstring(text, at + 1)
            elif c in WORDS:
                word, value = WORDS[c]
                if not text.startswith(word, at):
                    return None
                at += len(word)
            else:
                m = NUMBER.match(text, at)
                if not m:
                    return None
                value, at = json.loads(m.group()), m.end()
            while held:  # the value is complete: put it into what is open, and close what ends here
                into, outer = held[-1]
                if isinstance(into, dict):
                    into[key] = value
                else:
                    into.append(value)
                at = BLANK.match(text, at).end()  # type: ignore[union-attr]
                if text[at] == ",":
                    at = BLANK.match(text, at + 1).end()  # type: ignore[union-attr]
                    if isinstance(into, dict):
                        key, at = _key(text, at)
                    break
                if text[at] != ("}" if isinstance(into, dict) else "]"):
                    return None
                held.pop()
                value, key, at = into, outer, at + 1
            else:
                return value if BLANK.match(text, at).end() == len(text) else None  # type: ignore[union-attr]
    except (ValueError, IndexError):
        return None


def _key(text: str, at: int) -> tuple[str, int]:
    """The key of an object's next field, and the place of its value."""
    if text[at] != '"':
        raise ValueError("a key must be a text")
    key, at = scanstring(text, at + 1)
    at = BLANK.match(text, at).end()  # type: ignore[union-attr]
    if text[at] != ":":
        raise ValueError("no colon")
    return key, BLANK.match(text, at + 1).end()  # type: ignore[union-attr]


def unwrap(value: object) -> object:
    """JSON kept as text counts as the JSON it holds, however often it was wrapped: the one rule for every place."""
    while isinstance(value, str) and value.lstrip(" \t\n\r")[:1] in ("{", "[", '"'):
        inner = parse(value)
        if not isinstance(inner, (dict, list, str)):
            break
        value = inner
    return value


def visit(value: object, lists: frozenset[str] = frozenset(LIST_FIELDS), skip: frozenset[str] = frozenset(SKIPPED)) -> Iterator[tuple[str, str, str, str, dict]]:
    """(path, pos, parent path, parent pos, object) of every object in a list, depth first, at any depth.

    What is still to visit is held on a stack of its own: objects to look into, and lists to go through.
    """
    todo: list[tuple[object, str, str, str, str, bool]] = [(value, "", "", "", "", False)]
    while todo:
        now, path, pos, parent, parent_pos, counted = todo.pop()
        if isinstance(now, list):
            # the elements of a list stand under the list's path and extend its position
            for i in range(len(now), 0, -1):
                item = unwrap(now[i - 1])
                if isinstance(item, (dict, list)):
                    todo.append((item, path, f"{pos}.{i}" if pos else str(i), parent, parent_pos, True))
        elif isinstance(now, dict):
            if counted:
                if any(v is not None for v in now.values()):
                    yield path, pos, parent, parent_pos, now
                parent, parent_pos = path, pos
            held = [(name, _child(v, name, lists)) for name, v in now.items() if name not in skip]
            for name, v in reversed(held):
                if isinstance(v, list):
                    todo.append((v, f"{path}.{name}" if path else name, pos, parent, parent_pos, False))
                elif isinstance(v, dict):
                    todo.append((v, path, pos, parent, parent_pos, False))


def _child(value: object, name: str, lists: frozenset[str]) -> object:
    """A field's value as a list or object to visit, else None."""
    value = unwrap(value)
    if isinstance(value, dict):
        return [value] if name in lists else value
    return value if isinstance(value, list) else None


TAGGED = T.StructType([T.StructField(n, T.StringType()) for n in ("rec_table", "rec_key", "child_path", "child_pos", "parent_path", "parent_pos", "payload")])


def flatten(records: DataFrame, rec_table: str, key: Column, content: Column, *, lists: Iterable[str] = LIST_FIELDS, skip: Iterable[str] = SKIPPED) -> DataFrame:
    """One tagged row for each object in a list, at any depth, that has a field which is not null.

    content: a JSON text. An object where one of ``lists`` belongs is a list of one;
    plain objects add nothing to the path; JSON kept as text is read; positions count
    empty elements. The row has the object's table tag (its path) and position, those of
    its parent, and its own scalar fields as JSON. Null, empty or invalid content yields
    nothing: see ``invalid``. Rows of a repeated record repeat: see ``distinct_children``.
    """
    names, left_out = frozenset(lists), frozenset(skip)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[str]] = [[] for _ in TAGGED]
            for rec, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for path, pos, parent, parent_pos, item in visit(unwrap(parse(text)), lists=names, skip=left_out):
                    flat = {k: v for k, v in item.items() if not isinstance(v, (dict, list))}
                    for column, cell in zip(out, (rec_table, rec, path, pos, parent, parent_pos, json.dumps(flat, ensure_ascii=False)), strict=True):
                        column.append(cell)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in out], names=TAGGED.names)

    source = records.select(key.cast("string").alias("k"), content.alias("c")).where("k is not null and c is not null")
    return source.mapInArrow(run, TAGGED)


def invalid(records: DataFrame, rec_table: str, content: Column) -> DataFrame:
    """(rec_table, records, empty, refused): how many records there are, without content, and with content that is no JSON as a whole and so yields no rows."""

    @F.pandas_udf("boolean")
    def refused(x: pd.Series) -> pd.Series:
        return x.map(lambda t: t is not None and parse(t) is None and t.strip(" \t\n\r") != "null").astype(bool)

    return records.agg(F.count("*").alias("records"), F.count_if(content.isNull()).alias("empty"), F.count_if(refused(content)).alias("refused")).select(F.lit(rec_table).alias("rec_table"), "records", "empty", "refused")


def _may_hold(kind: T.DataType) -> bool:
    """Whether values of this type may be or hold JSON with objects: all but numbers, truth values, times and bytes, alone or in lists."""
    if isinstance(kind, T.ArrayType):
        return _may_hold(kind.elementType)
    return not isinstance(kind, T.AtomicType) or isinstance(kind, (T.StringType, T.CharType, T.VarcharType, T.VariantType))


def struct_as_json(record: str, kind: T.StructType) -> Column:
    """A struct as JSON text with every field that may hold children: texts as they are, as only ``unwrap`` knows what they hold; children keep their null fields."""
    parts = [F.col(record)[f.name].alias(f.name) for f in kind.fields if _may_hold(f.dataType)]
    return F.when(F.col(record).isNotNull(), F.to_json(F.struct(*parts), {"ignoreNullFields": "false"})) if parts else F.lit(None).cast("string")


def distinct_children(tagged: DataFrame) -> DataFrame:
    """Each child once, however often its record was delivered (copies are equal)."""
    keys = ["rec_table", "rec_key", "child_path", "child_pos"]
    rest = [c for c in tagged.columns if c not in keys]
    return tagged.groupBy(*keys).agg(*[F.min(c).alias(c) for c in rest]) if rest else tagged.distinct()


def with_schema(tagged: DataFrame, child_path: str, schema: T.StructType | str) -> DataFrame:
    """The rows of one tag as a typed table that keeps its keys."""
    keys = [c for c in tagged.columns if c != "payload"]
    return tagged.where(F.col("child_path") == child_path).select(*keys, F.from_json("payload", schema).alias("x")).select(*keys, "x.*")


def write_children(tagged: DataFrame, path: str) -> None:
    """All child tables in one write, a directory for each tag."""
    tagged.write.partitionBy("rec_table", "child_path").parquet(path)


def read_children(spark: SparkSession, path: str, rec_table: str, child_path: str, schema: T.StructType | str) -> DataFrame:
    """One child table of ``write_children`` with its fields typed; only its own directory is read."""
    tagged = spark.read.schema("rec_key string, child_pos string, parent_path string, parent_pos string, payload string, rec_table string, child_path string").parquet(path)
    return with_schema(tagged.where((F.col("rec_table") == rec_table) & (F.col("child_path") == child_path)), child_path, schema)
