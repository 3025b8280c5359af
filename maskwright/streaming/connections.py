"""Connections with two directions: what one side names is looked for in the other, and a block in either ends both.

One set of functions serves tables and live streams of frames. In a table the
state of a connection is reduced to narrow rows that meet its frames by key; in
a stream it is kept by `transformWithState` (the session needs the RocksDB state
store) under the connection, with a timeout for silent ones.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from ..functions import scalars as fn
from ..functions.detect import CHAIN_DOT, detections
from ..plans import pipeline
from ..sources.shared import kept

#: Opcode of a closing frame (fixed value).
CLOSE = 8
#: Says cheaply whether a text may mention a domain.
DOTTED = "(?iu)[a-z0-9-]" + CHAIN_DOT + "[a-z0-9-]"


def named_domains(text: Column) -> Column:
    """The distinct domains of a text's addresses, as related domains of other texts."""
    emails = F.filter(F.when(text.contains("@"), detections(text)), lambda d: d["kind"] == "email")
    names = F.transform(emails, lambda e: fn.canonical(F.lit("domain"), F.substring_index(fn.squeeze(e["value"]), "@", -1)))
    return F.coalesce(F.array_distinct(F.filter(names, lambda d: d.contains("."))), F.array().cast("array<string>"))


def frame_action(fin: Column, opcode: Column, compressed: Column) -> Column:
    """What happens to a frame: only whole, plain text frames are transformed; other data frames close the connection."""
    return F.when(compressed, "close").when((opcode == 1) & fin, "transform").when(opcode.isin(8, 9, 10), "pass").otherwise("close")


def in_order(rows: Iterable[Row], order: str) -> list[Row]:
    return sorted(rows, key=lambda r: (r[order] is not None, r[order] or 0))


class _Idle(StatefulProcessor):
    """A processor whose state goes when its connection has been silent for ``idle_ms``."""

    def __init__(self, idle_ms: int | None):
        self.idle_ms = idle_ms

    def init(self, handle: Any) -> None:
        self.handle = handle

    def touch(self, timers: Any) -> None:
        if self.idle_ms is not None:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self.idle_ms)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        self.clear()
        yield from ()

    def close(self) -> None:
        pass

    def clear(self) -> None:
        raise NotImplementedError


class _Related(_Idle):
    """Gives each frame the domains that frames of earlier places named; the state maps a domain to its first place."""

    def __init__(self, columns: list[str], order: str, idle_ms: int | None):
        super().__init__(idle_ms)
        self.columns, self.order = columns, order

    def init(self, handle: Any) -> None:
        super().init(handle)
        self.first = handle.getMapState("first", "domain string", "at long")

    def clear(self) -> None:
        self.first.clear()

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        frames = in_order(rows, self.order)
        alone = key[0] is None
        seen = {} if alone else {k[0]: v[0] for k, v in self.first.iterator()}
        for row in frames:
            at = row[self.order]
            if not alone and at is not None:
                for domain in row["__named"]:
                    if at < seen.get(domain, at + 1):
                        seen[domain] = at
                        self.first.updateValue((domain,), (at,))
        for row in frames:
            at = row[self.order]
            related = sorted(d for d, s in seen.items() if at is not None and s < at and row["__hears"])
            yield Row(**{c: row[c] for c in self.columns}, related=related)
        if not alone:
            self.touch(timerValues)


class _Gate(_Idle):
    """Lets frames through up to the one that ends the connection; the state is that one's place."""

    def __init__(self, columns: list[str], order: str, idle_ms: int | None):
        super().__init__(idle_ms)
        self.columns, self.order = columns, order

    def init(self, handle: Any) -> None:
        super().init(handle)
        self.end = handle.getValueState("end", "at long")

    def clear(self) -> None:
        self.end.clear()

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        frames = list(rows)
        ends = [r[self.order] for r in frames if r["__ends"] and r[self.order] is not None]
        if key[0] is not None:
            ends += [self.end.get()[0]] if self.end.exists() else []
            if ends:
                self.end.update((min(ends),))
            self.touch(timerValues)
        for row in in_order(frames, self.order):
            if key[0] is None or row[self.order] is None or not ends or row[self.order] <= min(ends):
                yield Row(**{c: row[c] for c in self.columns})


def _live(frames: DataFrame, key: str, processor: StatefulProcessor, schema: T.StructType, idle_ms: int | None) -> DataFrame:
    return frames.groupBy(key).transformWithState(processor, schema, "Append", "None" if idle_ms is None else "ProcessingTime")


def related_domains(messages: DataFrame, conversation: str = "conv_id", turn: str = "turn", text: str = "text", names: Column | None = None, hears: Column | None = None, idle_ms: int | None = None) -> DataFrame:
    """Adds ``related``: the sorted domains of addresses in earlier turns of the conversation.

    ``names`` and ``hears`` say which messages give domains and which are given
    them; all by default. Messages without a conversation or a turn stand alone.

    In a table a conversation is reduced to its distinct domains with the turn
    that first names each; turns meet only these, by key, and a long
    conversation is split like any frequent key of a join. Of a stream, the
    state keeps the same two columns; ``idle_ms`` removes what was silent so
    long (Spark then runs batches all the time, to look at the clock).
    """
    gives, takes = F.coalesce(F.lit(True) if names is None else names, F.lit(False)), F.coalesce(F.lit(True) if hears is None else hears, F.lit(False))
    if messages.isStreaming:
        found = F.when(gives, named_domains(F.col(text))).otherwise(F.array().cast("array<string>"))
        schema = T.StructType([*messages.schema.fields, T.StructField("related", T.ArrayType(T.StringType()))])
        marked = messages.withColumn("__named", F.coalesce(found, F.array().cast("array<string>"))).withColumn("__hears", takes)
        return _live(marked, conversation, _Related(messages.columns, turn, idle_ms), schema, idle_ms)
    first = _first_named(messages, conversation, turn, text, gives)
    return messages.join(first, conversation, "left").withColumn("related", _earlier(turn, takes)).select(*messages.columns, "related")


def _first_named(messages: DataFrame, conversation: str, turn: str, text: str, gives: Column) -> DataFrame:
    named = messages.where(F.col(text).contains("@") & gives).select(conversation, turn, F.explode(named_domains(F.col(text))).alias("__d"))
    firsts = named.where(F.col(conversation).isNotNull() & F.col(turn).isNotNull()).groupBy(conversation, "__d").agg(F.min(turn).alias("__t"))
    return firsts.groupBy(conversation).agg(F.collect_list(F.struct("__t", "__d")).alias("__first"))


def _earlier(turn: str, takes: Column) -> Column:
    seen = F.filter("__first", lambda x: x["__t"] < F.col(turn))
    none = F.array().cast("array<string>")
    return F.when(takes, F.coalesce(F.array_sort(F.transform(seen, lambda x: x["__d"])), none)).otherwise(none)


def _ended(done: DataFrame, conversation: str, turn: str, ends: Column, idle_ms: int | None) -> DataFrame:
    """The rows up to the first that ends its connection."""
    if done.isStreaming:
        return _live(done.withColumn("__ends", ends), conversation, _Gate(done.columns, turn, idle_ms), done.schema, idle_ms)
    last = done.where(ends & F.col(conversation).isNotNull()).groupBy(conversation).agg(F.min(turn).alias("__end"))
    return done.join(last, conversation, "left").where(F.col("__end").isNull() | (F.col(turn) <= F.col("__end")) | F.col(turn).isNull()).select(*done.columns)


def _known(messages: DataFrame, conversation: str, turn: str, text: str, names: Column | None, hears: Column | None, idle_ms: int | None) -> DataFrame:
    """`related_domains` for protecting: in a table only texts that may mention a domain meet those of their conversation."""
    if messages.isStreaming:
        return related_domains(messages, conversation, turn, text, names, hears, idle_ms)
    gives, takes = F.coalesce(F.lit(True) if names is None else names, F.lit(False)), F.coalesce(F.lit(True) if hears is None else hears, F.lit(False))
    some = F.coalesce(F.col(text).rlike(DOTTED), F.lit(False)) & takes
    met = messages.where(some).join(_first_named(messages, conversation, turn, text, gives), conversation, "left").withColumn("related", _earlier(turn, F.lit(True)))
    rest = messages.where(~some).withColumn("related", F.array().cast("array<string>"))
    return met.select(*messages.columns, "related").unionByName(rest)


def protect_conversations(messages: DataFrame, policy, conversation: str = "conv_id", turn: str = "turn", text: str = "text", idle_ms: int | None = None, **options) -> DataFrame:
    """conv_id, turn, status, output: each message protected with the domains seen before; a block ends its conversation."""
    known = _known(messages, conversation, turn, text, None, None, idle_ms)
    done = pipeline.shielded(known, policy, related=F.col("related"), text_col=text, id_col=conversation, **options).select(conversation, turn, "__protected.status", "__protected.output")
    return _ended(kept(done), conversation, turn, F.col("status") == "blocked", idle_ms)


def protect_connections(frames: DataFrame, policy, connection: str = "conn_id", seq: str = "seq", text: str = "text", idle_ms: int | None = None, **options) -> DataFrame:
    """conn_id, seq, direction, status, output of the frames that pass, and of the one that ends each connection.

    Frames have direction (client or server), fin, opcode and compressed besides
    connection, place and text. Whole text frames are protected, those of
    the server with the domains that the client's frames named before. A blocked
    frame ends both directions (status blocked), so do data frames of other
    shapes (closed) and the closing frame itself (passed); later frames of
    either direction are dropped. Frames without a connection stand alone, and
    so do those without a place. A stream forgets a connection, and that it is
    closed, after ``idle_ms`` of silence; without it, never.
    """
    acts = frames.withColumn("__act", frame_action(F.col("fin"), F.col("opcode"), F.coalesce("compressed", F.lit(False))))
    plain = F.col("__act") == "transform"
    known = _known(acts, connection, seq, text, plain & (F.col("direction") == "client"), plain & (F.col("direction") == "server"), idle_ms)
    done = pipeline.shielded(known.withColumn("__read", F.when(plain, F.col(text))), policy, related=F.col("related"), text_col="__read", id_col=connection, **options)
    status = F.when(F.col("__act") == "close", "closed").when(F.col("__act") == "pass", "passed").otherwise(F.col("__protected.status"))
    output = F.when(plain, F.col("__protected.output")).when(F.col("__act") == "pass", F.col(text))
    out = done.select(connection, seq, "direction", "opcode", status.alias("status"), output.alias("output"))
    ends = F.col("status").isin("blocked", "closed") | (F.coalesce("opcode", F.lit(0)) == CLOSE)
    return _ended(kept(out), connection, seq, ends, idle_ms).drop("opcode")
