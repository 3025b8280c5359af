"""Operator 3, token ids as length-delimited binary records with an offset index.

A record file is a sequence of frames ``length u64 | masked crc of length u32 |
payload | masked crc of payload u32`` (little endian); a payload is ``has_id
u8 | id i64 | width u8 | tokens u32 | ids``, with 2 bytes an id where the
vocabulary allows it, else 4. Its index file holds one ``(id i64, offset u64,
tokens u32)`` row per record, so that a reader can take records in any order.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import _shared as S
from .encoding import encoder

#: Layouts of a frame's head, a payload's head and an index row (fixed by the format).
HEAD, PAYLOAD, INDEX = "<QI", "<BqBI", "<qQI"
MANIFEST = "part int, file int, path string, records long, tokens long, bytes long"


def masked(data: bytes) -> int:
    """Rotated and shifted crc32: a checksum of data that hold checksums stays sound."""
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return size + struct.pack("<I", masked(size)) + payload + struct.pack("<I", masked(payload))


def pack_ids(doc_id: int | None, ids: bytes, narrow: bool) -> bytes:
    """``ids``: little-endian 32-bit."""
    head = struct.pack(PAYLOAD, doc_id is not None, doc_id or 0, 2 if narrow else 4, len(ids) // 4)
    return head + (np.frombuffer(ids, "<u4").astype("<u2").tobytes() if narrow else ids)


def unpack_ids(payload: bytes) -> tuple[int | None, bytes]:
    """Id, and token ids as little-endian 32-bit."""
    has_id, doc_id, width, _ = struct.unpack_from(PAYLOAD, payload)
    ids = payload[struct.calcsize(PAYLOAD) :]
    return doc_id if has_id else None, np.frombuffer(ids, "<u2").astype("<u4").tobytes() if width == 2 else ids


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def read_frame(source) -> bytes | None:
    """The next payload of an open file, None at its end; raises on damage."""
    head = source.read(struct.calcsize(HEAD))
    if not head:
        return None
    size, check = struct.unpack(HEAD, head)
    if masked(head[:8]) != check:
        raise ValueError("damaged record length")
    payload = source.read(size)
    if len(payload) != size or masked(payload) != struct.unpack("<I", source.read(4))[0]:
        raise ValueError("damaged record")
    return payload


def write_records(docs: DataFrame, root: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", file_bytes: int = 64 << 20) -> DataFrame:
    """Encode all texts and write them in ascending id order below ``root``; return the manifest.

    Files hold at most about ``file_bytes`` and carry a name of their own for
    each attempt of a task; the manifest, saved as a table, lists those of the
    tasks that ended well, so that a task run twice adds no record twice. Null
    texts are empty (the end id alone); a null id comes first; equal ids are
    ordered by a hash of their text and may be split over files; an empty
    table gives an empty manifest. The range partitioner also splits by that
    hash, so rows with one id need not meet in one task.
    """
    schema = T.StructType.fromDDL(MANIFEST)
    arrow = to_arrow_schema(schema)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, attempt = encoder(tokenizer), TaskContext.get().partitionId(), uuid.uuid4().hex[:12]
        narrow = max(encode.size, end_id + 1) <= 1 << 16
        end, done, out, index = struct.pack("<I", end_id), [], None, bytearray()
        store, base = _open(root)

        def close() -> None:
            out.close()
            with store.open_output_stream(f"{base}/{name}.idx") as side:
                side.write(bytes(index))

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if out is None or done[-1][5] >= file_bytes:
                    if out is not None:
                        close()
                    name = f"part-{part:06d}-{len(done):05d}-{attempt}"
                    out, index = store.open_output_stream(f"{base}/{name}.rec"), bytearray()
                    done.append([part, len(done), f"{root}/{name}", 0, 0, 0])
                ids = encode(text) + end
                record = frame(pack_ids(doc_id, ids, narrow))
                index += struct.pack(INDEX, doc_id or 0, done[-1][5], len(ids) // 4)
                out.write(record)
                done[-1][3] += 1
                done[-1][4] += len(ids) // 4
                done[-1][5] += len(record)
        if out is not None:
            close()
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*done, strict=True), arrow, strict=True)], schema=arrow)

    store, base = _open(root)
    store.create_dir(base, recursive=True)
    rows = S.texts(docs, id_col, text_col).withColumn("__tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "__tie").sortWithinPartitions("doc_id", "__tie").drop("__tie")
    return S.save(ordered.mapInArrow(write, schema), "token-manifest")


def read_records(manifest: DataFrame) -> DataFrame:
    """Read all files back in one pass: doc_id, start, n_tokens, ids (little-endian 32-bit).

    ``start`` counts the ids of all records before; it is carried from file to
    file through the manifest, which has one row per file. A file that holds
    other numbers of records or ids than its row says is damaged and raises.
    """
    before = Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    schema = T.StructType.fromDDL("doc_id long, start long, n_tokens long, ids binary")
    arrow = to_arrow_schema(schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, records, tokens in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store, name = _open(path)
                seen, end = 0, start + tokens
                with store.open_input_stream(f"{name}.rec", buffer_size=1 << 20) as source:
                    rows, held = [], 0
                    while (payload := read_frame(source)) is not None:
                        doc_id, ids = unpack_ids(payload)
                        rows.append((doc_id, start, len(ids) // 4, ids))
                        start, seen = start + len(ids) // 4, seen + 1
                        held += len(ids)
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)
                            rows, held = [], 0
                    if (seen, start) != (records, end):
                        raise ValueError(f"{path} holds {seen} of {records} records")
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    spread = manifest.sparkSession.sparkContext.defaultParallelism * 4
    return files.select("path", "start", "records", "tokens").repartition(spread, "path").mapInArrow(read, schema)


def read_record(path: str, row: int) -> tuple[int | None, bytes]:
    """One record by its place in the index: what a shuffled reader does."""
    store, name = _open(path)
    with store.open_input_file(f"{name}.idx") as index:
        size = struct.calcsize(INDEX)
        index.seek(row * size)
        _, offset, _ = struct.unpack(INDEX, index.read(size))
    with store.open_input_file(f"{name}.rec") as source:
        source.seek(offset)
        return unpack_ids(read_frame(source))


def records(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int, root: str | None = None) -> DataFrame:
    """Write and read back; per document doc_id, start, n_tokens, ids_crc32."""
    manifest = write_records(docs, root or S.fresh_path(spark, "token-records"), tokenizer, end_id)
    return read_records(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
