"""Operator 4, best-fit packing: exact complements by hashed length sums, then best fit."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _shared as S
from .encoding import encoder


def _pair(free: np.ndarray, gap: int) -> tuple[int, int] | None:
    """Lengths a >= b with a + b == gap, the largest a; ``free`` holds the counts left."""
    a = np.arange(gap - 1, (gap - 1) // 2, -1)
    b = gap - a
    fits = (free[a] > 0) & (free[b] > 0) & ((a != b) | (free[a] > 1))
    return (int(a[k]), int(b[k])) if fits.any() and (k := int(fits.argmax())) >= 0 else None


def _complement(free: np.ndarray, gap: int) -> list[int] | None:
    """One, two or three lengths that fill ``gap`` exactly."""
    if free[gap] > 0:
        return [gap]
    if gap > 1 and (pair := _pair(free, gap)):
        return list(pair)
    lengths = (np.flatnonzero(free[1:gap]) + 1).tolist()
    singles = sum(1 << n for n in lengths)
    pairs = 0  # bit n: two lengths sum to n
    for n in lengths:
        pairs |= singles << n
    for c in reversed(lengths):
        if not pairs >> (gap - c) & 1:
            continue
        free[c] -= 1
        pair = _pair(free, gap - c)
        free[c] += 1
        if pair:
            return [c, *pair]
    return None


def pack_lengths(counts: np.ndarray) -> list[tuple[int, list[int]]]:
    """Pack ``counts[n]`` pieces of each length n into bins of ``len(counts) - 1``.

    Returns (times, lengths of one bin) in order. A bin starts from the longest
    length left; its gap is filled by an exact complement of one to three
    lengths whose counts allow it, else by the longest length that fits, until
    nothing does. A pattern is used as often as its scarcest length allows, so
    every step uses up a length and the list is bounded by the lengths, not by
    the pieces.
    """
    free, cap, out = counts.astype(np.int64).copy(), len(counts) - 1, []
    for longest in range(cap, 0, -1):
        while free[longest] > 0:
            bin_, gap = [longest], cap - longest
            free[longest] -= 1
            while gap > 0:
                found = _complement(free, gap)
                if not found:
                    under = np.flatnonzero(free[1 : gap + 1])
                    found = [int(under[-1]) + 1] if len(under) else None
                if not found:
                    break
                for n in found:
                    free[n] -= 1
                bin_ += found
                gap -= sum(found)
            mult = {n: bin_.count(n) for n in bin_}
            more = min(int(free[n]) // m for n, m in mult.items())
            for n, m in mult.items():
                free[n] -= more * m
            out.append((1 + more, bin_))
    return out


def _intervals(groups: list[tuple[int, list[int]]], cap: int) -> dict[str, np.ndarray]:
    """Where the pieces of each length go: ranks from ``rank`` on to bins from ``bin`` on, at ``offset``."""
    used, rows, first = np.zeros(cap + 1, dtype=np.int64), [], 0
    for times, bin_ in groups:
        offset = 0
        for n in bin_:
            rows.append((n, used[n], first, offset))
            used[n] += times
            offset += n
        first += times
    rows.sort()
    table = np.array(rows, dtype=np.int64).reshape(-1, 4)
    return {"key": (table[:, 0] << 48) | table[:, 1], "rank": table[:, 1], "bin": table[:, 2], "offset": table[:, 3]}


def assign_bins(pieces: DataFrame, id_cols: list[str], length_col: str = "length", cap: int = 2048, blocks: int = 4096) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to every piece; the table is read twice, so pass a saved one.

    Lengths must lie in 1..cap. Only the counts by length, ``cap`` numbers at
    most, come to the driver, and the plan made of them goes back: its size is
    bounded by ``cap``, too. The pieces of a length are numbered without gaps
    over the cluster (`_shared.gapless`), and the number picks the place.
    """
    counts = np.zeros(cap + 1, dtype=np.int64)
    for row in pieces.groupBy(F.col(length_col).alias("n")).agg(F.count("*").alias("c")).collect():
        counts[row["n"]] = row["c"]
    plan = _intervals(pack_lengths(counts), cap)
    sent = pieces.sparkSession.sparkContext.broadcast(plan)
    schema = pieces.schema.simpleString()[7:-1]

    def place(batch: pa.RecordBatch) -> dict:
        plan = sent.value
        n, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (length_col, "__rank"))
        at = np.searchsorted(plan["key"], (n << 48) | rank, side="right") - 1
        out = {c: batch.column(c) for c in batch.schema.names if c != "__rank"}
        return out | {"sequence_id": plan["bin"][at] + rank - plan["rank"][at], "offset": plan["offset"][at]}

    ranked = S.gapless(pieces, [length_col], F.struct(*id_cols), id_cols, "__rank", blocks)
    return S.map_batches(ranked.select(*pieces.columns, "__rank"), place, f"{schema}, sequence_id long, offset long")


def token_pieces(docs: DataFrame, tokenizer: str, cap: int = 2048, end_id: int = 0, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids): each text with its end id, cut after every ``cap`` ids."""

    def cut(batch: pa.RecordBatch) -> dict:
        encode, end, rows = encoder(tokenizer), struct.pack("<I", end_id), []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids = encode(text) + end
            for k in range(0, len(ids), 4 * cap):
                part = ids[k : k + 4 * cap]
                rows.append((doc_id, k // (4 * cap), k // 4, len(part) // 4, zlib.crc32(part)) + ((part,) if with_ids else ()))
        names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
        return dict(zip(names, zip(*rows, strict=True), strict=True))

    return S.map_batches(S.texts(docs, id_col, text_col), cut, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def pack(docs: DataFrame, tokenizer: str, cap: int = 2048, end_id: int = 0) -> DataFrame:
    """Pack all documents: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one piece, their end id; documents are cut only
    where longer than ``cap``. Repeated rows (equal ids, too) are pieces of
    their own. An empty table gives no rows. Only id and text are read.
    """
    pieces = S.save(token_pieces(docs, tokenizer, cap, end_id), "pieces")
    return assign_bins(pieces, ["doc_id", "piece", "ids_crc32"], "length", cap)


def sequences(placed: DataFrame, cap: int = 2048) -> DataFrame:
    """Join the ids of placed pieces (column ``ids``): sequence_id, n_tokens, ids. A group holds at most ``cap`` ids."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return (
        placed.groupBy("sequence_id")
        .agg(F.sum("length").alias("n_tokens"), parts.alias("parts"))
        .select("sequence_id", "n_tokens", F.aggregate("parts", F.lit(b""), lambda s, x: F.concat(s, x["ids"])).alias("ids"))
    )
