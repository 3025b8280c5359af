"""JSON and event-stream bodies: their texts out, and new texts back in."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

TextMap = Callable[[str], str]
STRINGS = T.ArrayType(T.StringType())


def _dump(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def _parse(text: str):
    """The JSON value, or None if there is none to change."""
    try:
        return json.loads(text, parse_constant=lambda c: (_ for _ in ()).throw(ValueError(c)))
    except ValueError:
        return None


def _strings(value) -> Iterator[str]:
    """String values, not keys, at any depth in the order of writing."""
    todo = [value]
    while todo:
        v = todo.pop()
        if isinstance(v, str):
            yield v
        elif isinstance(v, list):
            todo.extend(reversed(v))
        elif isinstance(v, dict):
            todo.extend(v[k] for k in sorted(v, reverse=True))


def _replaced(value, texts: Iterator[str]):
    if isinstance(value, str):
        return next(texts)
    if isinstance(value, list):
        return [_replaced(v, texts) for v in value]
    if isinstance(value, dict):
        return {k: _replaced(value[k], texts) for k in sorted(value)}
    return value


def _parts(body: str) -> list[tuple[str, str, object]]:
    """(line, line end, JSON value or None): one part for a JSON body, else one a line."""
    if (whole := _parse(body)) is not None:
        return [(body, "", whole)]
    out = []
    for segment in body.split("\n"):
        out.append([segment, "\n"])
    out[-1][1] = ""
    parts = []
    for line, end in out:
        if line.endswith("\r") and end:
            line, end = line[:-1], "\r\n"
        parts.append((line, end, _parse(line) if line.strip() else None))
    return parts


def json_strings(body: str | None) -> list[str]:
    return [s for _, _, v in _parts(body or "") if v is not None for s in _strings(v)]


def with_json_strings(body: str | None, texts: list[str]) -> str | None:
    """``body`` with its string values replaced in order; None if nothing changes. Unchanged lines keep their spelling."""
    given, changed, out = iter(texts), False, []
    for line, end, value in _parts(body or ""):
        if value is not None:
            old = list(_strings(value))
            new = [next(given) for _ in old]
            if new != old:
                changed = True
                line = _dump(_replaced(value, iter(new)))
        out.append(line + end)
    return "".join(out) if changed else None


def map_json(body: str, f: TextMap) -> str | None:
    return with_json_strings(body, [f(s) for s in json_strings(body)])


# Event streams

#: Where providers put the text of a delta, in the order of trial (fixed values); * is any index.
DELTA_PATHS = (("delta", "text"), ("delta",), ("choices", "*", "delta", "content"), ("completion",), ("text",), ("content", "*", "text"), ("message", "content", "*", "text"))


def _find(value, path: tuple[str, ...]) -> tuple | None:
    """The concrete path of the first string under ``path``."""
    if not path:
        return () if isinstance(value, str) else None
    if path[0] == "*":
        for i, v in enumerate(value if isinstance(value, list) else []):
            if (rest := _find(v, path[1:])) is not None:
                return (i, *rest)
        return None
    if isinstance(value, dict) and path[0] in value and (rest := _find(value[path[0]], path[1:])) is not None:
        return (path[0], *rest)
    return None


def delta_path(value) -> tuple | None:
    return next((p for path in DELTA_PATHS if (p := _find(value, path)) is not None), None)


def _get(value, path: tuple):
    for step in path:
        value = value[step]
    return value


def _set(value, path: tuple, text: str) -> None:
    for step in path[:-1]:
        value = value[step]
    value[path[-1]] = text


def parse_events(text: str) -> list[list[tuple[bool, str]]]:
    """Events as lines (is data, content) of a stream with normalised line ends."""
    events = []
    for block in text.split("\n\n"):
        if block:
            lines = block.split("\n")
            if lines[-1] == "":
                lines.pop()
            events.append([(True, x[5:].removeprefix(" ")) if x.startswith("data:") else (False, x) for x in lines])
    return events


def _data(event: list[tuple[bool, str]]) -> str | None:
    lines = [x for is_data, x in event if is_data]
    return "\n".join(lines) if lines else None


def _lines(event: list[tuple[bool, str]], new: str | None) -> list[str]:
    out, written = [], False
    for is_data, x in event:
        if not is_data:
            out.append(x)
        elif new is None:
            out.append(f"data: {x}")
        elif not written:
            out.append(f"data: {new}")
            written = True
    return out


class EventStream:
    """The events of a stream body and the texts in them."""

    def __init__(self, body: str):
        text = body.replace("\r\n", "\n").replace("\r", "\n")
        self.events, self.tail = parse_events(text), "\n\n" if text.endswith("\n\n") else ""
        self.values = [None if (d := _data(e)) is None else _parse(d) for e in self.events]
        self.paths = [(k, p) for k, v in enumerate(self.values) if v is not None and (p := delta_path(v))]

    def joined(self) -> str:
        """The texts of all deltas as one, so that a value split over deltas is seen whole."""
        return "".join(_get(self.values[k], p) for k, p in self.paths)

    def set_joined(self, text: str) -> set[int]:
        """A changed text goes whole into the first delta; the events that changed."""
        for n, (k, p) in enumerate(self.paths):
            _set(self.values[k], p, text if n == 0 else "")
        return {k for k, _ in self.paths}

    def strings(self) -> list[str]:
        return [s for v in self.values if v is not None for s in _strings(v)]

    def set_strings(self, texts: list[str]) -> set[int]:
        given, changed = iter(texts), set()
        for k, value in enumerate(self.values):
            if value is not None:
                old = list(_strings(value))
                new = [next(given) for _ in old]
                if new != old:
                    self.values[k] = _replaced(value, iter(new))
                    changed.add(k)
        return changed

    def with_rest(self, f: TextMap) -> str | None:
        """The body with all lines but the data of events that hold strings mapped as text; None if nothing changes."""
        lines = [(False, "")]
        for event, value in zip(self.events, self.values, strict=True):
            held = value is not None and next(_strings(value), None) is not None
            lines += [*[(is_data and held, line) for is_data, line in zip((d for d, _ in event), _lines(event, None), strict=True)], (False, "")]
        runs = [(held, "\n".join(line for _, line in run)) for held, run in groupby(lines[1:-1], lambda x: x[0])]
        new = [text if held or not text.strip() else f(text) for held, text in runs]
        return "\n".join(new) + self.tail if new != [text for _, text in runs] else None

    def render(self, changed: set[int]) -> str:
        return "\n\n".join("\n".join(_lines(e, _dump(v) if k in changed else None)) for k, (e, v) in enumerate(zip(self.events, self.values, strict=True))) + self.tail


def map_event_stream(body: str, f: TextMap) -> str:
    """A stream of events with its texts mapped: first the joined deltas, then the string values of every event.

    A body without any is mapped as text. Where none changes, what is not the
    data of an event with such values is mapped as text; keys are no texts.
    """
    stream, changed = EventStream(body), set()
    if stream.paths and (mapped := f(old := stream.joined())) != old:
        changed |= stream.set_joined(mapped)
    strings = stream.strings()
    changed |= stream.set_strings([f(s) for s in strings])
    if changed:
        return stream.render(changed)
    if not strings:
        return f(body)
    return body if (rest := stream.with_rest(f)) is None else rest


def map_body(body: str, content_type: str | None, f: TextMap) -> str:
    """Event streams, JSON (whole or by line), or plain text, by content type and content."""
    kind = [p.strip().lower() for p in (content_type or "").split(";")]
    if "text/event-stream" in kind:
        return map_event_stream(body, f)
    changed = map_json(body, f)
    return changed if changed is not None else body if json_strings(body) else f(body)


def delta_text(data: Column) -> Column:
    """The text of a delta event's JSON, without leaving the JVM; null where there is none."""
    get = lambda p: F.get_json_object(data, p)
    indexed = lambda p, inner: F.get(F.filter(F.transform(F.from_json(get(p), "array<string>"), lambda x: F.get_json_object(x, inner)), lambda x: x.isNotNull()), F.lit(0))
    plain = F.when(~F.coalesce(get("$.delta"), F.lit("{")).rlike(r"^\s*[\[{]"), get("$.delta"))
    return F.coalesce(get("$.delta.text"), plain, indexed("$.choices", "$.delta.content"), get("$.completion"), get("$.text"), indexed("$.content", "$.text"), indexed("$.message.content", "$.text"))


@F.pandas_udf(STRINGS)
def body_strings(body: pd.Series) -> pd.Series:
    """The string values of JSON bodies, in the order in which `with_body_strings` takes them."""
    return body.map(json_strings)


def _rewritten(df: DataFrame, body_col: str, given: str, one: Callable[[str, object], str | None]) -> DataFrame:
    """``df`` without column ``given`` and with ``one(body, given)`` as body where that is not null."""
    schema = T.StructType([f for f in df.schema if f.name != given])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, new = batch.schema.get_field_index(body_col), batch.schema.get_field_index(given)
            bodies = [b if b is None or g is None or (n := one(b, g)) is None else n for b, g in zip(batch.column(at).to_pylist(), batch.column(new).to_pylist(), strict=True)]
            columns = [pa.array(bodies, arrow.field(body_col).type) if k == at else batch.column(k) for k in range(batch.num_columns) if k != new]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return df.mapInArrow(run, schema)


def map_bodies(df: DataFrame, f: Callable[[Column], Column], body_col: str = "body") -> DataFrame:
    """``df`` with the string values of its JSON bodies mapped by a column expression; a null result leaves its value as it is.

    Every body is rewritten in its own row.
    """
    new = F.transform(body_strings(body_col), lambda t: F.coalesce(f(t), t))
    return _rewritten(df.withColumn("__texts", new), body_col, "__texts", with_json_strings)


@F.pandas_udf(T.StringType())
def stream_text(body: pd.Series) -> pd.Series:
    """The joined delta text of event-stream bodies; null where no event has one."""
    streams = [None if b is None else EventStream(b) for b in body]
    return pd.Series([s.joined() if s is not None and s.paths else None for s in streams], dtype=object)


def with_stream_text(body: str, text: str) -> str | None:
    stream = EventStream(body)
    return None if stream.joined() == text else stream.render(stream.set_joined(text))


@F.pandas_udf(STRINGS)
def stream_strings(body: pd.Series) -> pd.Series:
    return pd.Series([None if b is None else EventStream(b).strings() for b in body], dtype=object)


def with_stream_strings(body: str, texts: list[str]) -> str | None:
    stream = EventStream(body)
    changed = stream.set_strings(texts)
    return stream.render(changed) if changed else None


def map_streams(df: DataFrame, f: Callable[[Column], Column], body_col: str = "body") -> DataFrame:
    """`map_event_stream` with a column expression, so that detection and policy stay in the JVM; every body in its own row."""
    new = lambda t: F.coalesce(f(t), t)
    joined = df.withColumn("__text", stream_text(body_col)).withColumn("__text", new(F.col("__text")))
    rows = _rewritten(joined, body_col, "__text", with_stream_text)
    return _rewritten(rows.withColumn("__texts", F.transform(stream_strings(body_col), new)), body_col, "__texts", with_stream_strings)


def transform_bodies(df: DataFrame, transform: Callable[[DataFrame], DataFrame], id_col: str = "id", body_col: str = "body") -> DataFrame:
    """(id, body): JSON bodies whose string values went through ``transform``, a plan from (id, text) to (id, output).

    For plans that must ask a store. Each distinct value is transformed once
    under a hash of its content, so that ids may be null or repeated; a null
    output leaves its value as it is. Bodies meet their changed values by a
    hash of the body.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(body_col).alias("body"), F.sha2(body_col, 256).alias("content"))
    single = rows.select("content", F.explode(body_strings("body")).alias("text")).distinct().withColumn("key", F.sha2("text", 256))
    mapped = transform(single.select(F.col("key").alias("id"), "text").distinct()).select(F.col("id").alias("key"), "output")
    changed = single.join(mapped, "key").where("output <> text")
    lists = changed.groupBy("content").agg(F.map_from_entries(F.collect_list(F.struct("text", "output"))).alias("new"))
    met = rows.join(lists, "content", "left").select("id", "body", "new")
    given = F.transform(body_strings("body"), lambda t: F.coalesce(F.col("new")[t], t))
    return _rewritten(met.withColumn("__texts", F.when(F.col("new").isNotNull(), given)).drop("new"), "body", "__texts", with_json_strings)


def map_typed(df: DataFrame, f: TextMap, body_col: str = "body", type_col: str = "content_type") -> DataFrame:
    """``df`` with each body mapped as its content type says, in its own row; null bodies stay null."""

    @F.pandas_udf(T.StringType())
    def mapped(bodies: pd.Series, types: pd.Series) -> pd.Series:
        return pd.Series([None if b is None else map_body(b, t, f) for b, t in zip(bodies, types, strict=True)], dtype=object)

    return df.withColumn(body_col, mapped(body_col, type_col))
