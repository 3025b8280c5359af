"""Byte streams and event streams, in batch and as Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.structured import map_event_stream

#: Bytes and events held back so that a value cut by a chunk's end is seen whole (fixed values).
TAIL_BYTES, TAIL_EVENTS = 64, 4
OUTPUT = "stream_id string, seq long, chunk binary"


def _mapped(data: bytes, f: Callable[[str], str]) -> bytes:
    """Invalid UTF-8 passes as it is."""
    try:
        return f(data.decode()).encode()
    except UnicodeDecodeError:
        return data


def step_bytes(pending: bytes, chunk: bytes, last: bool, f: Callable[[str], str]) -> tuple[bytes, bytes]:
    """(emitted, still pending) after a chunk of a plain byte stream."""
    data = pending + chunk
    cut = len(data) if last else max(0, len(data) - TAIL_BYTES)
    while 0 < cut < len(data) and data[cut] & 0xC0 == 0x80:  # not inside a character
        cut -= 1
    return (_mapped(data[:cut], f) if cut else b""), data[cut:]


def step_events(pending: bytes, chunk: bytes, last: bool, f: Callable[[str], str]) -> tuple[bytes, bytes]:
    """The same for an event stream: whole events are rewritten, the newest four and an open one are held."""
    data = (pending + chunk).replace(b"\r\n", b"\n")
    if last:
        return (_mapped(data, lambda t: map_event_stream(t, f)) if data else b""), b""
    held_return = data.endswith(b"\r")  # may be half of a line end
    body, rest = (data[:-1], b"\r") if held_return else (data, b"")
    body = body.replace(b"\r", b"\n")
    *whole, open_ = body.split(b"\n\n")
    if len(whole) <= TAIL_EVENTS:
        return b"", body + rest
    done = _mapped(b"\n\n".join(whole) + b"\n\n", lambda t: map_event_stream(t, f))
    events = done.split(b"\n\n")[:-1]
    emit = b"".join(e + b"\n\n" for e in events[:-TAIL_EVENTS])
    return emit, b"".join(e + b"\n\n" for e in events[-TAIL_EVENTS:]) + open_ + rest


STEPS = {"bytes": step_bytes, "events": step_events}


def transform_stream(chunks: DataFrame, f: Callable[[str], str], kind: str = "bytes", idle_ms: int | None = None) -> DataFrame:
    """A streaming plan over (stream_id, seq, chunk, last): rewritten chunks with a bounded state per stream.

    ``kind`` is bytes or events. The state of a stream is its held tail; the
    row flagged ``last`` flushes and removes it. Where streams may break off,
    give ``idle_ms``: a stream silent for so long is flushed and removed, too
    (Spark then runs batches all the time, to look at the clock). A chunk
    without a stream id is a stream of its own.
    """
    step = STEPS[kind]

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if key[0] is None:
            alone = [(None, row.seq, step(b"", row.chunk or b"", True, f)[0]) for batch in batches for row in batch.itertuples(index=False)]
            yield pd.DataFrame([r for r in alone if r[2]], columns=["stream_id", "seq", "chunk"])
            return
        pending, at = state.get if state.exists else (b"", -1)
        rows, ended = [], state.hasTimedOut
        if ended:
            out, _ = step(pending, b"", True, f)
            rows = [(key[0], at + 1, out)] if out else []
        else:
            for row in pd.concat(list(batches)).sort_values("seq").itertuples(index=False):
                out, pending = step(pending, row.chunk or b"", bool(row.last), f)
                ended, at = ended or bool(row.last), row.seq
                if out:
                    rows.append((key[0], row.seq, out))
        if ended:
            state.remove()
        else:
            state.update((pending, at))
            if idle_ms is not None:
                state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(rows, columns=["stream_id", "seq", "chunk"])

    return chunks.groupBy("stream_id").applyInPandasWithState(run, OUTPUT, "pending binary, at long", "append", GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def transform_chunks(chunks: DataFrame, f: Callable[[str], str], kind: str = "bytes") -> DataFrame:
    """The batch twin over (stream_id, seq, chunk): (stream_id, seq, chunk) rewritten.

    Chunks are dealt by stream and pass in order; a task holds one stream's
    tail at a time, however long the stream is. A chunk without a stream id is
    a stream of its own.
    """
    step = STEPS[kind]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stream, at, pending = None, None, b""
        for batch in batches:
            rows = []
            for row in batch.itertuples(index=False):
                if row.stream_id != stream or row.stream_id is None:
                    if pending and (out := step(pending, b"", True, f)[0]):
                        rows.append((stream, at + 1, out))
                    stream, pending = row.stream_id, b""
                at = row.seq
                out, pending = step(pending, row.chunk or b"", False, f)
                if out:
                    rows.append((stream, at, out))
            yield pd.DataFrame(rows, columns=["stream_id", "seq", "chunk"])
        if pending and (out := step(pending, b"", True, f)[0]):
            yield pd.DataFrame([(stream, at + 1, out)], columns=["stream_id", "seq", "chunk"])

    spread = F.when(F.col("stream_id").isNull(), F.xxhash64("seq", "chunk"))  # chunks of no stream gather nowhere
    dealt = chunks.repartition(F.col("stream_id"), spread).sortWithinPartitions("stream_id", "seq")
    return dealt.select(F.col("stream_id").cast("string"), F.col("seq").cast("long"), "chunk").mapInPandas(run, OUTPUT)
