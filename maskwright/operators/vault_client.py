"""Vaults behind a client: batches of distinct values and keys, a client for each partition, and failures value by value."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame

from ..sources.shared import kept


class VaultClient(Protocol):
    """What a store must offer. Both calls take a batch and answer in its order; a task may repeat them."""

    def put(self, rows: list[tuple[str, str, str]]) -> list[str | None]:
        """Store (kind, value, id) rows; the id that stands for each value (an older one, if it is known), None where storing failed."""

    def get(self, keys: list[str]) -> list[str | None | Exception]:
        """The values of keys (``kind:id``); None where a key is unknown, an exception where it cannot be read."""


Connect = Callable[[], VaultClient]
#: Rows of a call.
BATCH = 512


def _called(rows: DataFrame, connect: Connect, ask: Callable[[VaultClient, list[tuple]], list[tuple]], schema: str, arrow: pa.Schema, batch: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = None
        for part in batches:
            for at in range(0, part.num_rows, batch):
                asked = list(zip(*(c.to_pylist() for c in part.slice(at, batch).columns), strict=True))
                if client is None:
                    client = connect()  # only where there is something to ask
                yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, a, strict=True)) for a in ask(client, asked)], schema=arrow)

    return kept(rows.mapInArrow(run, schema))  # asked once, whoever reads the answers


def put_values(values: DataFrame, connect: Connect, batch: int = BATCH) -> DataFrame:
    """(kind, value, stored_id) for the distinct (kind, value, ref_id) of ``values``; stored_id is null where storing failed.

    A call that raises counts as failed for its whole batch, as the store may
    have taken none of it.
    """

    def ask(client: VaultClient, rows: list[tuple]) -> list[tuple]:
        try:
            ids = client.put(rows)
        except Exception:
            ids = [None] * len(rows)
        return [(kind, value, id_) for (kind, value, _), id_ in zip(rows, ids, strict=True)]

    arrow = pa.schema([(c, pa.string()) for c in ("kind", "value", "stored_id")])
    return _called(values.select("kind", "value", "ref_id").distinct(), connect, ask, "kind string, value string, stored_id string", arrow, batch)


def get_values(keys: DataFrame, connect: Connect, batch: int = BATCH) -> tuple[DataFrame, DataFrame]:
    """(key, value) of the keys (column key) that are known, and the keys that cannot be read; each distinct key is asked once."""

    def ask(client: VaultClient, rows: list[tuple]) -> list[tuple]:
        try:
            found = client.get([k for (k,) in rows])
        except Exception as e:
            found = [e] * len(rows)
        return [(k, None if isinstance(v, Exception) else v, isinstance(v, Exception)) for (k,), v in zip(rows, found, strict=True)]

    arrow = pa.schema([("key", pa.string()), ("value", pa.string()), ("failed", pa.bool_())])
    answers = _called(keys.select("key").where("key IS NOT NULL").distinct(), connect, ask, "key string, value string, failed boolean", arrow, batch)
    return answers.where("value IS NOT NULL").select("key", "value"), answers.where("failed").select("key")
