"""Operator 1, sharding: jump consistent hashing in DataFrame expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _shared as S

#: Jumps taken before the rare longer walk; the chance of more is below 1e-9 up to 10,000 shards.
SHORT_WALK = 48


def _walk(key: Column, n_shards: int, steps: int) -> Column:
    """State after the walk: ``b`` the shard, ``j`` the first bucket at or past ``n_shards``.

    Each jump draws 31 fresh bits of xxhash64(key, jump number): any generator
    seeded by the key alone gives the guarantees of the published walk.
    """

    def step(state: Column, i: Column) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(key, i), 33).cast("double") + 1.0
        leap = F.floor((state["j"] + 1).cast("double") * (F.lit(2147483648.0) / bits)).cast("long")
        return F.when(state["j"] < n_shards, F.struct(state["j"].alias("b"), leap.alias("j"))).otherwise(state)

    start = F.struct(F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)


def jump(key: Column, n_shards: int) -> Column:
    """Struct of ``shard`` among ``n_shards`` and ``grown_shard`` among one more.

    A row's shard changes only to the appended one: the walk goes on from
    where it stood, and only a jump that lands on ``n_shards`` itself moves it.
    """
    state = _walk(key, n_shards, min(n_shards, SHORT_WALK))
    if n_shards > SHORT_WALK:
        state = F.when(state["j"] < n_shards, _walk(key, n_shards, n_shards)).otherwise(state)
    return F.transform(
        F.array(state),
        lambda s: F.struct(
            s["b"].cast("int").alias("shard"),
            F.when(s["j"] == n_shards, F.lit(n_shards)).otherwise(s["b"]).cast("int").alias("grown_shard"),
        ),
    )[0]


def shard(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text", blocks: int = 1024) -> DataFrame:
    """Deal all rows to ``n_shards`` shards by their id and number each shard's rows.

    Law ``key``: id and shard count decide. Null texts have size 1 and the
    checksum of no bytes; a null id is a key like any other. Repeated rows go
    to one shard with slots of their own. Rows are numbered in blocks by id and
    checksum, so rows that share an id, or lack one, spread by their texts.
    An empty table gives no rows. Only id and text are read; the text is
    reduced to size and checksum before anything is shuffled.
    """
    raw = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        jump(F.col(id_col), n_shards).alias("at"),
    ).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "at.shard", "at.grown_shard")
    numbered = S.gapless(rows, ["shard"], F.struct("doc_id", "text_crc32"), ["doc_id", "size", "text_crc32"], "slot", blocks)
    return numbered.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
