"""Operator 5, SimHash near-duplicates: a binary trie joined with itself."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import _shared as S

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
#: Shingles whose bits are counted at once; bounds memory for very long texts.
BLOCK = 1 << 16


def fingerprint(text: str, shingle: int = 3) -> int:
    """The 64 majority bits over XXH64 (seed 42) of all word shingles; 0 without words."""
    words = WORDS.findall(text.encode().translate(LOWER))
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    starts, ends = starts[:n].tolist(), ends[min(shingle, len(words)) - 1 :].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for k in range(0, n, BLOCK):
        h = np.array([digest(joined[a:b], 42) for a, b in zip(starts[k : k + BLOCK], ends[k : k + BLOCK], strict=True)], dtype=">u8")
        ones += np.unpackbits(h.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long)."""

    def run(batch: pa.RecordBatch) -> dict:
        fps = [fingerprint(t, shingle) for t in batch.column(1).to_pylist()]
        return {"doc_id": batch.column(0), "fp": np.array(fps, dtype=np.uint64).view(np.int64)}

    return S.map_batches(S.texts(docs, id_col, text_col), run, "doc_id long, fp long")


def trie_pairs(v: np.ndarray, depth: int, budget: int, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of sorted distinct ``v`` (uint64) that share their first ``depth`` bits and differ in at most ``budget``.

    A node of the binary trie is a run of ``v`` with a common prefix. Pairs of
    nodes go down together, the differing bits so far are carried along, and a
    pair over the budget is dropped. Small pairs of nodes are compared leaf by
    leaf. ``most`` pairs of nodes are held at a time.
    """
    if len(v) < 2:
        return
    cut = np.flatnonzero(np.diff(v >> np.uint64(64 - depth))) + 1
    lo, hi = np.concatenate(([0], cut)), np.concatenate((cut, [len(v)]))
    many = hi - lo > 1
    stack = [(depth, lo[many], hi[many], lo[many], hi[many], np.zeros(int(many.sum()), dtype=np.int64))]
    while stack:
        d, la, ha, lb, hb, used = stack.pop()
        if len(la) > most:
            half = len(la) // 2
            stack += [(d, *(x[:half] for x in (la, ha, lb, hb, used))), (d, *(x[half:] for x in (la, ha, lb, hb, used)))]
            continue
        work = (ha - la) * (hb - lb)
        leaf = (work <= 16) | (d == 64)
        if leaf.any():
            na, nb, w = (hb - lb)[leaf], la[leaf], work[leaf]
            item = np.repeat(np.arange(len(w)), w)
            k = np.arange(len(item)) - np.repeat(np.cumsum(w) - w, w)
            i, j = nb[item] + k // na[item], lb[leaf][item] + k % na[item]
            near = (i < j) & (np.bitwise_count(v[i] ^ v[j]) <= budget)
            if near.any():
                yield i[near], j[near]
        la, ha, lb, hb, used = (x[~leaf] for x in (la, ha, lb, hb, used))
        if not len(la):
            continue
        bit = np.uint64(63 - d)
        split = lambda a: np.searchsorted(v, ((v[a] >> bit) | np.uint64(1)) << bit)
        ma, mb = np.clip(split(la), la, ha), np.clip(split(lb), lb, hb)
        same = la == lb
        children = [
            (la, ma, lb, mb, used),
            (ma, ha, mb, hb, used),
            (la, ma, mb, hb, used + 1),
            tuple(x[~same] for x in (ma, ha, lb, mb, used + 1)),
        ]
        la, ha, lb, hb, used = (np.concatenate(x) for x in zip(*children, strict=True))
        keep = (ha > la) & (hb > lb) & (used <= budget) & ((la != lb) | (ha - la > 1))
        stack.append((d + 1, *(x[keep] for x in (la, ha, lb, hb, used))))


def _roots(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest index connected to each of 0..n-1; pairs are taken as they come and not kept."""
    root = np.arange(n)
    for i, j in pairs:
        while True:
            a, b = root[i], root[j]
            low = np.minimum(a, b)
            if (a == b).all():
                break
            np.minimum.at(root, a, low)
            np.minimum.at(root, b, low)
            while ((up := root[root]) != root).any():
                root = up
    return root


def _rotated(bits: Column, depth: int, by: int) -> Column:
    """``bits`` with those below the leading ``depth`` rotated to the left."""
    if not by:
        return bits
    rest = 64 - depth
    turned = F.shiftleft(bits, by).bitwiseOR(F.shiftrightunsigned(bits.bitwiseAND(F.lit((1 << rest) - 1 if depth else -1)), rest - by))
    if not depth:
        return turned
    mask = F.lit((1 << rest) - 1)
    return bits.bitwiseAND(F.lit(-1 << rest)).bitwiseOR(turned.bitwiseAND(mask))


def _turned(rows: DataFrame, depth: int, step: int, times: int) -> DataFrame:
    """Each row in ``times`` rotations of its bits below ``depth``, with the block of ``depth + step`` leading bits."""
    each = F.explode(F.array(*[F.struct((F.col("turn") * times + k).alias("turn"), _rotated(F.col("bits"), depth, k * step).alias("bits")) for k in range(times)]))
    return rows.select("rep", each.alias("t")).select("t.turn", "t.bits", "rep").withColumn("block", F.shiftrightunsigned("bits", 64 - depth - step))


def near_links(distinct: DataFrame, budget: int = 3, chunk: int = 1 << 20, most: int = 1 << 20, levels: int = 3) -> DataFrame:
    """Spanning links (a, b) between the representatives of fingerprints within ``budget`` bits.

    ``distinct`` has one row (fp, rep) per fingerprint. Of ``budget + 1`` equal
    blocks of the 64 bits at least one is the same in both fingerprints, so the
    bits are rotated that many times and the tries below each leading block are
    joined with themselves: all links are found and a task holds whole blocks
    only. A block of over ``most`` fingerprints is split the same way once
    more: its other bits are rotated by a part of themselves, so that the
    linked ones meet below a longer prefix; up to ``levels`` times in all.
    Links inside a task are reduced to those that connect its components.
    """
    times = budget + 1
    if 64 % times:
        raise ValueError("budget + 1 must divide 64")
    rows, depth, found = distinct.select("rep", F.lit(0).alias("turn"), F.col("fp").alias("bits")), 0, []
    for level in range(levels):
        step = (64 - depth) // times
        rows = _turned(rows, depth, step, times)
        depth += step
        if level == levels - 1:
            found.append(_joined(rows, depth, budget, chunk))
            break
        hot = rows.groupBy("turn", "block").agg(F.count("*").alias("n")).where(F.col("n") > most).select("turn", "block")
        found.append(_joined(rows.join(hot, ["turn", "block"], "left_anti"), depth, budget, chunk))
        rows = rows.join(hot, ["turn", "block"], "left_semi")
    return functools.reduce(DataFrame.unionByName, found)


def _joined(rows: DataFrame, width: int, budget: int, chunk: int) -> DataFrame:
    """The tries of all blocks (equal turn and ``width`` leading bits) joined with themselves, a task at a time."""
    schema = T.StructType.fromDDL("a long, b long")
    arrow = to_arrow_schema(schema)

    def join(turn: np.ndarray, bits: np.ndarray, rep: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        out = []
        for t in np.unique(turn):
            v, r = bits[turn == t], rep[turn == t]
            order = np.argsort(v)
            v, r = v[order], r[order]
            root = _roots(len(v), trie_pairs(v, width, budget))
            linked = np.flatnonzero(root != np.arange(len(v)))
            if len(linked):
                out.append((r[linked], r[root[linked]]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size, limit = 0, chunk

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, size, limit
            turn, bits, rep = (np.concatenate(x) for x in zip(*held, strict=True))
            key = (turn.astype(np.uint64) << np.uint64(width)) | (bits >> np.uint64(64 - width))
            cut = len(key) if last else int(np.flatnonzero(key != key[-1])[-1]) + 1 if (key != key[-1]).any() else 0
            for a, b in join(turn[:cut], bits[:cut], rep[:cut]):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=arrow)
            held, size = ([(turn[cut:], bits[cut:], rep[cut:])], len(key) - cut) if cut < len(key) else ([], 0)
            limit = max(chunk, 2 * size)  # a block that goes on is not copied at every batch

        for batch in batches:
            if batch.num_rows:
                turn, bits, rep = (batch.column(k).to_numpy() for k in range(3))
                held.append((turn, bits.view(np.uint64), rep))
                size += len(turn)
                if size >= limit:
                    yield from flush(False)
        if held:
            yield from flush(True)

    dealt = rows.repartition("turn", "block").sortWithinPartitions("turn", "block")
    return dealt.select("turn", "bits", "rep").mapInArrow(run, schema)


def components(links: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(node, component): the smallest node reachable over links (a, b), for every node with a link.

    Large-star and small-star steps alternate until nothing changes; each round
    is written to the shared folder. Stars around a hub meet only as partial
    minima and as the large side of a join, which adaptive execution splits.
    """
    links = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    links, state = S.save(links, "links"), None
    for _ in range(most_rounds):
        now = links.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if now == state:
            return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(links.select("v", "v").distinct())
        state = now
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        old, links = links, S.save(small.select("e.u", "e.v").where("u <> v").distinct(), "links")
        S.discard(old)
    raise RuntimeError("components did not settle")


def near_duplicates(docs: DataFrame, shingle: int = 3, budget: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest id reachable).

    Null and empty texts have fingerprint zero and are linked like any other.
    Rows with one fingerprint are one class, represented by the smallest id, so
    copies are never expanded into pairs. Ids are expected to be unique; equal
    ids share one component row each. A null id stays in the result, but a
    class of null ids only has a null component. An empty table gives no rows.
    """
    fps = S.save(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    classes = fps.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    found = components(near_links(classes.where("rep IS NOT NULL"), budget))
    named = classes.join(found, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    hex16 = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return fps.join(named, "fp").select("doc_id", hex16.alias("fingerprint"), "component_id")
