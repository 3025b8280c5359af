"""Operator 8, benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit distance."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _shared as S

WORDS = re.compile(r"\w+")
#: Share of an item's words that may be inserted, deleted or replaced.
EDITS = 0.2
#: Repetitions of the embedding, samples of positions drawn from each, and positions a sample compares.
WALKS, SAMPLES, BITS = 9, 8, 2
#: Words of embedded windows held at once (8 bytes each); bounds memory for long texts full of benchmark words.
WINDOW_WORDS = 1 << 21
#: Bytes of item texts held by a task at once; more items are taken block by block.
BLOCK_BYTES = 8 << 20


def words(text: str) -> list[str]:
    return WORDS.findall(text.lower())


def most_edits(n: int) -> int:
    return int(EDITS * n)


def gram_rule(n: int) -> tuple[int, int]:
    """(q, least): a window within `most_edits(n)` of an item of n words shares ``least`` of the item's q-word grams.

    Each edit destroys q grams at most (q-gram lemma); the longest q that
    leaves a gram to share is taken, and single words always do.
    """
    k = most_edits(n)
    return next((q, n - q + 1 - q * k) for q in (3, 2, 1) if n - q + 1 - q * k >= 1)


def walk_codes(words: list[str]) -> np.ndarray:
    """The codes that the walk sees: a hash of each word, in a benchmark or not; 0 is the end only."""
    return np.fromiter((xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) or 1 for w in words), np.uint64, len(words)).view(np.int64)


@functools.lru_cache(maxsize=64)
def _coins(steps: int) -> np.ndarray:
    """Random odd words (step, walk) that, with a word's code, toss the coin of each step."""
    return np.random.default_rng((11, steps)).integers(0, 1 << 63, (steps, WALKS), dtype=np.uint64) | np.uint64(1)


def embed(codes: np.ndarray) -> np.ndarray:
    """CGK embeddings of equally long rows of word codes: (3 n positions, rows, WALKS).

    A pointer walks over the row; every step writes the word under it and moves
    on if the coin that step and word toss says so. Rows a few edits apart fall
    into step again, so their embeddings differ in few positions. Past the end
    zeros are written. All walks are taken at once.
    """
    rows, n = codes.shape
    padded = np.concatenate([codes, np.zeros((rows, 1), dtype=np.int64)], axis=1).ravel()
    at = np.repeat(np.arange(rows)[:, None] * (n + 1), WALKS, axis=1)
    last, coins = at + n, _coins(3 * n)
    out = np.empty((3 * n, rows, WALKS), dtype=np.uint64)
    for step in range(3 * n):
        word = padded[at].view(np.uint64)
        out[step] = word
        at = np.minimum(at + ((word * coins[step]) >> np.uint64(63)).view(np.int64), last)
    return out


@functools.lru_cache(maxsize=256)
def _sampled(n: int) -> np.ndarray:
    """Positions (WALKS, SAMPLES, BITS) compared, from the first two thirds, where walks have not ended."""
    return np.random.default_rng((12, n)).integers(0, max(1, 2 * n), (WALKS, SAMPLES, BITS))


def sketches(codes: np.ndarray) -> np.ndarray:
    """(rows, WALKS * SAMPLES) keys; rows that agree in the sampled positions of one sample share its key."""
    image, positions = embed(codes), _sampled(codes.shape[1])
    key = np.broadcast_to(np.arange(1, WALKS * SAMPLES + 1, dtype=np.uint64), (len(codes), WALKS * SAMPLES)).copy()
    walk = np.repeat(np.arange(WALKS), SAMPLES)
    for bit in range(BITS):
        seen = image[positions[:, :, bit].ravel(), :, walk].T
        key = (key ^ seen) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key


def edit_distance(a: list, b: list, most: int) -> int:
    """Word edit distance of ``a`` to the best prefix of ``b``; over ``most`` it may stop early."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        lo, hi = max(1, i - most), min(len(b), i + most)
        new = [most + 1] * (len(b) + 1)
        new[0] = i
        for j in range(lo, hi + 1):
            new[j] = min(row[j - 1] + (x != b[j - 1]), row[j] + 1, new[j - 1] + 1)
        row = new
        if min(row) > most:
            return most + 1
    return min(row)


@dataclass
class Items:
    """A block of benchmark items, indexed by words, grams and LSH keys."""

    ids: list[int | None]
    texts: list[list[str]]
    codes: dict[str, int]
    grams: dict[int, tuple[np.ndarray, np.ndarray]]
    sizes: dict[int, dict]

    @staticmethod
    def of(rows: list[tuple[int, str]]) -> Items:
        kept = [(i, w) for i, t in rows if (w := words(t or ""))]
        ids, texts = [i for i, _ in kept], [w for _, w in kept]
        codes: dict[str, int] = {}
        coded = [np.array([codes.setdefault(w, len(codes) + 1) for w in t], dtype=np.int64) for t in texts]
        grams: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        by_size: dict[int, list[int]] = {}
        for k, t in enumerate(coded):
            q, _ = gram_rule(len(t))
            mine = np.unique(gram_codes(t, q))
            grams.setdefault(q, []).append((mine, np.full(len(mine), k)))
            by_size.setdefault(len(t), []).append(k)
        sizes = {}
        for n, members in by_size.items():
            keys, table = sketches(np.stack([walk_codes(texts[k]) for k in members])), {}
            for k, row in zip(members, keys.tolist(), strict=True):
                for s, key in enumerate(row):
                    table.setdefault((s, key), []).append(k)
            sizes[n] = table
        joined = {}
        for q, parts in grams.items():
            gram, item = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(gram, kind="stable")
            joined[q] = (gram[order], item[order])
        return Items(ids, texts, codes, joined, sizes)

    def plausible(self, ids: np.ndarray) -> tuple[dict[int, np.ndarray], set[int]]:
        """Running counts of grams that any item has, by q, and the items whose own grams are numerous enough."""
        hits, items = {}, set()
        for q, (known, item) in self.grams.items():
            gram = gram_codes(ids, q)
            lo, hi = np.searchsorted(known, gram), np.searchsorted(known, gram, side="right")
            hits[q] = np.concatenate(([0], np.cumsum(hi > lo)))
            if hits[q][-1]:
                n = (hi - lo)[hi > lo]
                at = np.repeat(lo[hi > lo] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                which, count = np.unique(item[at], return_counts=True)
                items |= {k for k, c in zip(which.tolist(), count.tolist(), strict=True) if c >= gram_rule(len(self.texts[k]))[1]}
        return hits, items

    def matches(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item id, first word, words, edits) of the best window for every item found in the text."""
        doc = words(text)
        ids = np.fromiter((self.codes.get(w, 0) for w in doc), np.int64, len(doc))
        if not ids.any():
            return []
        hits, items = self.plausible(ids)
        best: dict[int, tuple[int, int]] = {}
        walked = walk_codes(doc) if items else ids
        for n in sorted({len(self.texts[k]) for k in items}):
            table = self.sizes[n]
            q, least = gram_rule(n)
            k, seen = most_edits(n), hits[q]
            size = n + 2 * k
            # windows of the item's size and the edits it may have gained hold enough shared grams; start at every word
            first = np.arange(len(doc) - max(1, n - k) + 1)
            last = np.minimum(first + size - q + 1, len(seen) - 1)
            first = first[seen[np.maximum(last, first)] - seen[first] >= least] if len(first) else first
            if not len(first):
                continue
            padded = np.concatenate([walked, np.zeros(n, dtype=np.int64)])
            chunk = max(1, WINDOW_WORDS // (3 * n * WALKS))
            for begin in range(0, len(first), chunk):
                part = first[begin : begin + chunk]
                windows = padded[part[:, None] + np.arange(n)]
                for start, keys in zip(part.tolist(), sketches(windows).tolist(), strict=True):
                    found = {x for s, key in enumerate(keys) for x in table.get((s, key), ())} & items
                    for x in found:
                        if x in best and best[x][0] == 0:
                            continue
                        edits = edit_distance(self.texts[x], doc[start : start + n + k], k)
                        if edits <= k and (x not in best or edits < best[x][0]):
                            best[x] = (edits, start)
        return [(self.ids[x], start, len(self.texts[x]), edits) for x, (edits, start) in sorted(best.items())]


def gram_codes(ids: np.ndarray, q: int) -> np.ndarray:
    """One number for each q words in a row; 0 where a word is unknown."""
    if len(ids) < q:
        return np.zeros(0, dtype=np.int64)
    out, known = np.zeros(len(ids) - q + 1, dtype=np.uint64), np.ones(len(ids) - q + 1, dtype=bool)
    for j in range(q):
        part = ids[j : len(ids) - q + 1 + j]
        out = (out + part.astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(31)
        known &= part > 0
    return np.where(known, out.view(np.int64) | 1, 0)


def item_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES):
    """The items as lists of bounded size, read one block at a time; an item needs a text, not an id."""
    sized = benchmark.where("text IS NOT NULL").select("item_id", "text", F.octet_length("text").cast("long").alias("n"))
    total = sized.agg(F.sum("n")).first()[0] or 0
    blocks = -(-total // block_bytes)
    sized = sized.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, blocks))))
    for b in range(blocks):
        yield [(r["item_id"], r["text"]) for r in sized.where(F.col("block") == b).select("item_id", "text").collect()]


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and benchmark item found in it: doc_id, item_id, first_word, n_words, edits.

    Texts are compared as lower-cased words. An item is found where a window
    is within a fifth of its words in edits. Windows of each item's size start
    at every word of every whole text; those that cannot qualify by the q-gram
    lemma are passed over, which loses none. For the others LSH on the CGK
    embedding proposes items, and the exact edit distance decides.

    Null and empty texts or items match nothing; repeated rows are found alike,
    and an item without an id with a null item_id; empty tables give no rows. Documents are read where they lie and never
    shuffled; items go out in blocks of bounded size, one pass over the
    documents for each.
    """
    whole, found = S.texts(docs, id_col, text_col), None
    for rows in item_blocks(benchmark):
        sent = docs.sparkSession.sparkContext.broadcast(Items.of(rows))

        def run(batch: pa.RecordBatch, sent=sent) -> dict:
            out = [(d, *m) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for m in sent.value.matches(t)]
            return dict(zip(("doc_id", "item_id", "first_word", "n_words", "edits"), zip(*out, strict=True) if out else [[]] * 5, strict=True))

        part = S.map_batches(whole, run, "doc_id long, item_id long, first_word int, n_words int, edits int")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, first_word int, n_words int, edits int")
    return found


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """`leaks` with the rows of each pair numbered down to the closest match; rows that lack an id cannot be told apart and all stay."""
    best = Window.partitionBy("doc_id", "item_id").orderBy("edits", "first_word")
    return leaks(docs, benchmark).withColumn("__n", F.row_number().over(best)).where("__n = 1 OR doc_id IS NULL OR item_id IS NULL").drop("__n")


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents without a leak; columns, null texts and null or repeated ids unchanged.

    Documents are judged where they lie, so nothing is joined or shuffled.
    """
    for rows in item_blocks(benchmark):
        sent = docs.sparkSession.sparkContext.broadcast(Items.of(rows))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
                yield batch.filter(pa.array([not sent.value.matches(t or "") for t in texts], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
