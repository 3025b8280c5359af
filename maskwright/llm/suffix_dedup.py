"""Operator 2, repeated byte strings: prefix doubling, adapted to blocks of positions.

Plain prefix doubling ranks every position of the corpus by its first 1, 2, 4,
... bytes: seven rounds over all positions, some forty times the text through
the shuffle. Here a row stands for a block of neighbouring positions, and its
rank is a name of the bytes that all strings of the block share:

* round 0: of the positions of each 100-byte string, the one with the smallest
  name of 32 bytes is its anchor. Equal strings have equal anchors at equal
  offsets, so the strings with one anchor form a block, ranked by the anchor;
* later rounds halve the distance to the threshold (69, 93 and 100 bytes; the
  blocks shrink to 32, 8 and 1 positions) and name each block anew by all the
  bytes its strings share.

In each round Spark brings equal ranks together (sorted in round 0, grouped by
hash later); blocks whose rank is unique hold no repeat and drop out, blocks
that equal an earlier one in all bytes of all their strings are copies, and
only the rest goes on. What is kept of prefix doubling is the rounds of growing
length and that unique ranks drop out; a rank is a 64-bit name of bytes, not a
place in a sorted list, and not made of two earlier ranks. Texts move once, into
a table bucketed by document, where later rounds read them in place.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import _shared as S

#: Bytes of an anchor's name; its strings' anchors are the least names of THRESHOLD - GRAM + 1 positions.
GRAM = 32
#: Positions of a block in the rounds after the first; the bytes a block shares are THRESHOLD - width + 1.
WIDTHS = (32, 8, 1)
#: Bytes of a text handled at once; bounds memory for very long texts.
PIECE = 1 << 20
#: Bytes of text that one call of a visit holds, and that one partition of the bucketed table aims at.
VISIT, PARTITION = 8 << 20, 128 << 20
NO_ID = -(1 << 63)

U = np.uint64
MULTIPLIER = U(0x9E3779B97F4A7C15)


@functools.lru_cache(maxsize=1)
def _bytes() -> np.ndarray:
    return np.random.default_rng(20240229).integers(0, 1 << 64, 256, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(29))) * U(0xA24BAED4963EE407)
    return x ^ (x >> U(32))


def _names(raw: np.ndarray) -> np.ndarray:
    """Name of the GRAM bytes from every position on, by doubling the length."""
    name, power, length = _bytes()[raw], MULTIPLIER, 1
    while length < GRAM:
        name = name[:-length] * power + name[length:]
        power, length = U(int(power) ** 2 % (1 << 64)), 2 * length
    return _mix(name)


def _least(x: np.ndarray, window: int) -> np.ndarray:
    """Minimum over every window, by doubling."""
    span = 1
    while 2 * span <= window:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (window - span)], x[window - span :]) if window > span else x


def blocks(text: bytes, threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(rank, anchor, low, high) of the first blocks of a text: the strings that start low .. high bytes before the anchor.

    Texts are taken in pieces, so that each string starts in one of them.
    """
    raw = np.frombuffer(text, np.uint8)
    for k in range(0, len(raw) - threshold + 1, PIECE - threshold):
        names = _names(raw[k : k + PIECE - 1])
        place = np.arange(len(names), dtype=np.uint64)
        least = _least((names & ~U(0xFFFFFF)) | place, threshold - GRAM + 1)
        at = (least & U(0xFFFFFF)).astype(np.int64)
        first = np.concatenate(([0], np.flatnonzero(at[1:] != at[:-1]) + 1))
        last = np.concatenate((first[1:], [len(at)])) - 1
        anchor = at[first]
        yield names[anchor].view(np.int64), anchor + k, anchor - last, anchor - first


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


class _Texts:
    """The rows of one bucket of the text table in a fixed order, with the requests for them."""

    def __init__(self, left: pa.Table, right: pa.Table):
        ids, shas, texts = (left.column(c).to_pylist() for c in ("doc_id", "sha", "text"))
        self.rows = sorted(zip(ids, shas, texts, strict=True))
        self.bucket = left.column("bucket")[0].as_py() if len(ids) else None
        self.right = right
        kind = right.column("kind").to_numpy()
        leads = right.filter(pa.array(kind == LEADER))
        self.leaders = set(zip(leads.column("doc_id").to_pylist(), leads.column("sha").to_pylist(), strict=True))

    def leading(self) -> Iterator[tuple[int, int, bytes]]:
        """(place in the bucket, id, text) of the rows whose text no smaller id has; a repeated row comes once."""
        for k, row in enumerate(self.rows):
            if row[:2] in self.leaders and (not k or self.rows[k - 1][:2] != row[:2]):
                yield k, row[0], row[2]

    def of(self, kind: int, *columns: str) -> list[np.ndarray]:
        mine = self.right.filter(pa.array(self.right.column("kind").to_numpy() == kind))
        return [mine.column(c).to_numpy() for c in columns]


#: Requests of a visit: leading rows, tied ranks, first blocks to read, spans to cut.
LEADER, RANK, BLOCK, CUT = 0, 1, 2, 3
REQUEST = "bucket long, kind int, doc_id long, sha binary, rank long, pos int, anchor int, low int, high int"


def _request(rows: DataFrame, kind: int, **columns: Column) -> DataFrame:
    given = {"bucket": F.col("bucket"), "kind": F.lit(kind)} | columns
    return rows.select(*[given.get(c, F.lit(None)).cast(t).alias(c) for c, t in (x.split() for x in REQUEST.split(", "))])


def _visit(texts: DataFrame, requests: DataFrame, func: Callable[[_Texts], dict[str, list]], schema: str) -> DataFrame:
    """``func`` over each bucket of texts with its requests: texts stay where they are, only requests move."""
    struct = T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(struct)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return pa.Table.from_pydict(func(_Texts(left, right)), schema=arrow) if left.num_rows else arrow.empty_table()

    return texts.groupBy("bucket").cogroup(requests.groupBy("bucket")).applyInArrow(run, struct)


def _flat(lists: list[np.ndarray], kind=np.int64) -> np.ndarray:
    return np.concatenate(lists) if lists else np.zeros(0, kind)


def text_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """bucket, doc_id, sha, text: all rows, bucketed. Equal rows of several input partitions go to several buckets."""
    rows = docs.select(F.coalesce(F.col(id_col), F.lit(NO_ID)).cast("long").alias("doc_id"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("text"))
    size = docs.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = min(50_000, max(least, -(-size // PARTITION)))
    many = max(8 * n, -(-size // VISIT))
    bucket = F.pmod(F.xxhash64("doc_id", "sha", F.spark_partition_id()), F.lit(many))
    held = rows.withColumn("sha", F.unhex(F.sha2("text", 256))).withColumn("bucket", bucket)
    return S.save_bucketed(held.select("bucket", "doc_id", "sha", "text"), "bucket", n, "texts")


def _tied(found: DataFrame) -> DataFrame:
    """(bucket, rank) of ranks that occur more than once; each bucket has a rank in one row, so no group exceeds the number of buckets."""
    n = F.sum("n").over(Window.partitionBy("rank"))
    return found.withColumn("all", n).where("all > 1").select("bucket", "rank")


def first_round(texts: DataFrame, leaders: DataFrame, threshold: int) -> DataFrame:
    """All blocks of round 0 with a tied rank: bucket, pos, doc_id, anchor, low, high, name, copy.

    ``copy``: the block's strings equal those of an earlier block. Such blocks
    of the bucket itself have no name.
    """

    def ranks(t: _Texts) -> dict:
        found = _flat([b[0] for _, _, text in t.leading() for b in blocks(text, threshold)])
        rank, n = np.unique(found, return_counts=True)
        return {"bucket": np.full(len(rank), t.bucket), "rank": rank, "n": np.minimum(n, 2).astype(np.int8)}

    tied = _tied(_visit(texts, leaders, ranks, "bucket long, rank long, n byte"))

    def names(t: _Texts) -> dict:
        known = np.sort(t.of(RANK, "rank")[0])
        out: dict[str, list] = {k: [] for k in ("bucket", "pos", "doc_id", "anchor", "low", "high", "name")}
        first: dict[bytes, tuple[int, int]] = {}
        for pos, doc_id, text in t.leading():
            for rank, *block in blocks(text, threshold) if len(known) else ():
                at = np.minimum(np.searchsorted(known, rank), len(known) - 1)
                for anchor, low, high in zip(*(x[known[at] == rank].tolist() for x in block), strict=True):
                    name = _digest(b"%d %d " % (low, high) + text[anchor - high : anchor - low + threshold])
                    start = (doc_id, anchor - high)
                    earlier = first.setdefault(name, start) < start
                    for column, value in zip(out.values(), (t.bucket, pos, doc_id, anchor, low, high, None if earlier else name), strict=True):
                        column.append(value)
        return out

    requests = leaders.unionByName(_request(tied, RANK, rank=F.col("rank")))
    schema = "bucket long, pos int, doc_id long, anchor int, low int, high int, name binary"
    named = S.save(_visit(texts, requests, names, schema), "blocks")
    earliest = Window.partitionBy("name").orderBy("doc_id", F.col("anchor") - F.col("high"))
    across = named.where("name IS NOT NULL").withColumn("copy", F.rank().over(earliest) > 1).drop("name")
    ranked = S.save(across.unionByName(named.where("name IS NULL").drop("name").withColumn("copy", F.lit(True))), "ranked")
    S.discard(named)
    return ranked


def read_blocks(texts: DataFrame, leaders: DataFrame, firsts: DataFrame, threshold: int) -> DataFrame:
    """The blocks with the bytes of all their strings (``held``)."""

    def read(t: _Texts) -> dict:
        columns = t.of(BLOCK, "pos", "anchor", "low", "high")
        rows = sorted(zip(*(c.tolist() for c in columns), strict=True))
        held = [t.rows[pos][2][anchor - high : anchor - low + threshold] for pos, anchor, low, high in rows]
        pos, anchor, low, high = zip(*rows, strict=True) if rows else ((),) * 4
        return {"bucket": [t.bucket] * len(rows), "pos": pos, "doc_id": [t.rows[p][0] for p in pos], "anchor": anchor, "low": low, "high": high, "held": held}

    asked = _request(firsts, BLOCK, **{c: F.col(c) for c in ("pos", "anchor", "low", "high")})
    return _visit(texts, asked, read, "bucket long, pos int, doc_id long, anchor int, low int, high int, held binary")


def next_round(rows: DataFrame, width: int, threshold: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(copies, blocks that go on, the saved table that both read) after ranking blocks of ``width`` positions by the bytes their strings share.

    Ranks and whole blocks are counted by partial sums, and a frequent one
    meets its rows only in joins, which adaptive execution splits.
    """
    bases = F.sequence(F.col("low") - F.col("low") % width, F.col("high"), F.lit(width))
    cut = rows.withColumn("base", F.explode(bases))
    low, high = F.greatest("low", "base"), F.least("high", F.col("base") + width - 1)
    rank = F.xxhash64("base", F.substring("held", F.col("high") - F.col("base") + 1, F.lit(threshold - width + 1)))
    whole = F.substring("held", F.col("high") - high + 1, high - low + threshold)
    ranked = cut.select("bucket", "pos", "doc_id", "anchor", low.alias("low"), high.alias("high"), rank.alias("rank"), whole.alias("held"))
    shared = ranked.groupBy("rank").agg(F.count("*").alias("n")).where("n > 1").select("rank")
    name = F.substring(F.unhex(F.sha2(F.concat(F.encode(F.concat_ws(" ", "low", "high", F.lit("")), "UTF-8"), "held"), 256)), 1, 16)
    tied = S.save(ranked.join(shared, "rank", "left_semi").withColumn("name", name).withColumn("start", F.col("anchor") - F.col("high")), f"round-{width}")
    earliest = tied.groupBy("name").agg(F.min(F.struct("doc_id", "start")).alias("e"), F.min("rank").alias("rank"))
    partly = earliest.groupBy("rank").agg(F.count("*").alias("n")).where("n > 1").select("rank")
    placed = tied.join(earliest.select("name", "e"), "name").withColumn("copy", (F.col("doc_id") != F.col("e.doc_id")) | (F.col("start") != F.col("e.start")))
    copies = placed.where("copy").select("bucket", "pos", "start", (F.col("anchor") - F.col("low") + threshold).alias("end"))
    onward = placed.where("NOT copy").join(partly, "rank", "left_semi").select("bucket", "pos", "doc_id", "anchor", "low", "high", "held")
    return copies, onward, tied


def _merged(spans: Iterator[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def repeated_spans(docs: DataFrame, threshold: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document the bytes covered by strings of ``threshold`` bytes that start earlier, too.

    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256, and spans
    (start, end in bytes). Null texts are empty; texts below the threshold
    lose nothing. A null id comes before all others. Rows with equal ids share
    their positions: a string counts as earlier only if it starts at a smaller
    id or, within that id, at an earlier byte, so repeated rows lose nothing to
    each other. An empty table gives no rows; other columns are left out.

    Whole copies of a text with a smaller id are settled at once by SHA-256.
    Blocks are equal if 128 bits of a cryptographic digest of their bytes and
    offsets are; ranks only decide what is compared. No key gathers its rows
    in one task: a bucket sends each rank and name once, so a group has at most
    one row a bucket, and the later rounds count by partial sums.
    """
    if not max(GRAM, max(WIDTHS)) < threshold:
        raise ValueError(f"threshold must be over {GRAM}")
    texts = text_table(docs, id_col, text_col)
    known = texts.select("bucket", "doc_id", "sha")
    first = known.groupBy("sha").agg(F.min("doc_id").alias("doc_id"))
    lead = S.save(known.join(first, ["sha", "doc_id"], "left_semi").distinct(), "leaders")
    leaders = _request(lead, LEADER, doc_id=F.col("doc_id"), sha=F.col("sha"))

    ranked = first_round(texts, leaders, threshold)
    span = ("bucket", "pos", (F.col("anchor") - F.col("high")).alias("start"), (F.col("anchor") - F.col("low") + threshold).alias("end"))
    cuts = [S.save(ranked.where("copy").select(*span), "cuts")]
    rows = read = S.save(read_blocks(texts, leaders, ranked.where("NOT copy"), threshold), "held")
    S.discard(ranked)
    for width in WIDTHS:
        copies, rows, tied = next_round(rows, width, threshold)
        cuts.append(S.save(copies, "cuts"))
        S.discard(read)  # the round's own table holds all that goes on
        read = tied
    S.discard(read)
    cut = functools.reduce(DataFrame.unionByName, cuts)

    def finish(t: _Texts) -> dict:
        pos, start, end = (c.tolist() for c in t.of(CUT, "pos", "anchor", "low"))
        of: dict[int, list[tuple[int, int]]] = {}
        for p, a, b in zip(pos, start, end, strict=True):
            of.setdefault(p, []).append((a, b))
        rows, place = [], 0
        for k, (doc_id, sha, text) in enumerate(t.rows):
            if not k or t.rows[k - 1][:2] != (doc_id, sha):
                place = k  # a repeated row loses what the first of its kind loses
            if (doc_id, sha) in t.leaders:
                spans = _merged(of.get(place, ()))
            else:
                spans = [[0, len(text)]] if len(text) >= threshold else []
            edges = [0, *(x for s in spans for x in s), len(text)]
            kept = hashlib.sha256(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))) if spans else None
            removed = sum(b - a for a, b in spans)
            rows.append((None if doc_id == NO_ID else doc_id, len(text), removed, len(spans), kept.hexdigest() if kept else sha.hex(), [{"start": a, "end": b} for a, b in spans]))
        names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")
        return dict(zip(names, zip(*rows, strict=True), strict=True))

    asked = _request(cut, CUT, pos=F.col("pos"), anchor=F.col("start"), low=F.col("end"))
    output = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:int,end:int>>"
    return _visit(texts, leaders.unionByName(asked), finish, output)


def deduplicate(docs: DataFrame, threshold: int = 100) -> DataFrame:
    """The digest columns of `repeated_spans`."""
    return repeated_spans(docs, threshold).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
