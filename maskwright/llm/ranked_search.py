"""Operator 12, ranked lexical search: a bit-sliced impact index, summed by carry arithmetic, read from its top slice down."""

from __future__ import annotations

import heapq
import math
from collections import Counter, OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _shared as S
from .decontamination import item_blocks

#: Bytes that stand for themselves in a term (letters, digits and all of UTF-8 beyond ASCII), A-Z lower-cased; others part terms.
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
#: Rows and postings of an index block, and bytes of slices that it keeps ready.
BLOCK_ROWS, BLOCK_POSTINGS, BLOCK_BYTES = 1 << 14, 1 << 22, 256 << 20
#: Terms added at once.
TOGETHER = 32
#: Length of a document that counts as it is: B of the ranking, in hundredths.
B = 75


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(TERM_BYTES).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def length_norm(n: int, n_docs: int, n_terms: int) -> int:
    return 100 - B + (B * n * n_docs) // n_terms


def add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of two stacks of bit-sliced numbers (..., slice, word), lowest slice first, by ripple carry; they must fit."""
    out, carry = np.empty_like(a), None
    for i in range(a.shape[-2]):
        x, y = a[..., i, :], b[..., i, :]
        half = x ^ y
        if carry is None:
            out[..., i, :], carry = half, x & y
        else:
            out[..., i, :] = half ^ carry
            carry = (x & y) | (carry & half)
    return out


def top(slices: np.ndarray, k: int) -> np.ndarray:
    """Slots of the ``k`` largest sums above 0, equal sums by ascending slot; not in order.

    From the most significant slice down: rows with the bit set join the sure
    ones while they fit, and are the only ones left in the running when they
    would be too many.
    """
    sure, running = np.zeros_like(slices[0]), np.bitwise_or.reduce(slices, axis=0)
    for plane in slices[::-1]:
        ahead = running & plane
        both = sure | ahead
        n = int(np.bitwise_count(both).sum())
        if n > k:
            running = ahead
        else:
            sure, running = both, running & ~plane
            if n == k:
                break
    slots = slots_of(sure)
    return np.concatenate([slots, slots_of(running)[: k - len(slots)]]) if len(slots) < k else slots


def slots_of(words: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little"))


def sums_at(slices: np.ndarray, slots: np.ndarray) -> list[int]:
    bits = (slices[:, slots >> 6] >> (slots & 63).astype(np.uint64)) & np.uint64(1)
    return (bits.astype(np.int64) << np.arange(len(slices), dtype=np.int64)[:, None]).sum(axis=0).tolist()


@dataclass
class Queries:
    """A bounded block of queries: each one's terms with their repeats, and, once counted, all that scoring needs."""

    ids: list[int | None]
    vocabulary: dict[bytes, int]
    wanted: list[list[tuple[int, int]]]
    weights: np.ndarray | None = None
    n_docs: int = 0
    n_terms: int = 0

    @classmethod
    def of(cls, rows: list[tuple[int | None, str]]) -> Queries:
        vocabulary: dict[bytes, int] = {}
        wanted = [[(vocabulary.setdefault(t, len(vocabulary)), r) for t, r in Counter(terms(text)).items()] for _, text in rows]
        return cls([i for i, _ in rows], vocabulary, wanted)


@dataclass
class Block:
    """The index of some documents: for each term, bitmaps of the bits of its impacts over the documents' slots.

    Bitmaps hold only the words that the term touches. They are made from the
    postings when a query first asks for the term; the latest are kept.
    """

    n_words: int
    starts: np.ndarray
    slots: np.ndarray
    impacts: np.ndarray
    made: OrderedDict = field(default_factory=OrderedDict)
    held: int = 0

    def slices(self, term: int) -> tuple[np.ndarray, np.ndarray] | None:
        """(words touched, their bits by slice), or None where no document holds the term."""
        if term in self.made:
            self.made.move_to_end(term)
            return self.made[term]
        a, b = self.starts[term], self.starts[term + 1]
        found = None
        if a < b:
            slots, impacts = self.slots[a:b], self.impacts[a:b].view(np.uint64)
            words, first = np.unique(slots >> 6, return_index=True)
            each = np.arange(int(impacts.max()).bit_length(), dtype=np.uint64)[:, None]
            bits = ((impacts >> each) & np.uint64(1)) << (slots & 63).astype(np.uint64)
            found = words, np.bitwise_or.reduceat(bits, first, axis=1)
            self.held += found[1].nbytes
        self.made[term] = found
        while self.held > BLOCK_BYTES and len(self.made) > 1:
            _, old = self.made.popitem(last=False)
            self.held -= old[1].nbytes if old else 0
        return found

    def scores(self, wanted: list[tuple[int, int]]) -> np.ndarray | None:
        """The bit-sliced sums of a query's impacts, (slice, word); None where no document holds a term."""
        parts = [(p, s) for t, r in wanted if (p := self.slices(t)) for s in range(r.bit_length()) if r >> s & 1]
        if not parts:
            return None
        most = sum(((1 << len(bits)) - 1) << s for (_, bits), s in parts)
        total = np.zeros((most.bit_length(), self.n_words), np.uint64)
        for at in range(0, len(parts), TOGETHER):
            stack = np.zeros((min(TOGETHER, len(parts) - at) + 1, *total.shape), np.uint64)
            stack[0] = total
            for row, ((words, bits), s) in zip(stack[1:], parts[at : at + TOGETHER], strict=True):
                row[s : s + len(bits), words] = bits
            while len(stack) > 1:
                odd = stack[-1:] if len(stack) % 2 else stack[:0]
                stack = np.concatenate([add(stack[: len(stack) - len(odd) : 2], stack[1::2]), odd])
            total = stack[0]
        return total


def block_of(queries: Queries, n: list[int], owner: np.ndarray, term: np.ndarray, tf: np.ndarray) -> Block:
    """Index documents of ``n`` terms each from their postings; ``owner`` is a posting's slot, ascending."""
    norms = np.array([length_norm(x, queries.n_docs, queries.n_terms) for x in n], np.int64)
    impacts = queries.weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * norms[owner]))
    some = impacts > 0
    owner, term, impacts = owner[some], term[some], impacts[some]
    by_term = np.argsort(term, kind="stable")
    starts = np.searchsorted(term[by_term], np.arange(len(queries.vocabulary) + 1))
    return Block(-(-len(n) // 64), starts, owner[by_term], impacts[by_term])


COUNTED = "doc_id long, n long, term array<int>, tf array<int>"
FOUND = "query int, item_id long, doc_id long, score long"
FOUND_ARROW = pa.schema([("query", pa.int32()), *((c, pa.int64()) for c in ("item_id", "doc_id", "score"))])


def counted(docs: DataFrame, queries: Queries, id_col: str, text_col: str) -> DataFrame:
    """Documents with at least one term: their number of terms, and the queries' terms in them with their counts."""
    sent = docs.sparkSession.sparkContext.broadcast(queries.vocabulary)

    def run(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"doc_id": [], "n": [], "term": [], "tf": []}
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if found := terms(text):
                counts = Counter(map(sent.value.get, found))
                counts.pop(None, None)
                for name, x in zip(out, (doc, len(found), list(counts), list(counts.values())), strict=True):
                    out[name].append(x)
        return out

    return S.map_batches(S.texts(docs, id_col, text_col), run, COUNTED)


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows in tables of at most BLOCK_ROWS rows and, but for a single row, BLOCK_POSTINGS postings."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= BLOCK_ROWS:
            table = pa.Table.from_batches(held)
            yield from parts(table)
            held, rows = [], 0
    if rows:
        yield from parts(pa.Table.from_batches(held))


def parts(table: pa.Table) -> Iterator[pa.Table]:
    lengths = np.cumsum(pc.list_value_length(table["term"]).to_numpy())
    at = 0
    while at < table.num_rows:
        before = lengths[at - 1] if at else 0
        end = min(at + BLOCK_ROWS, max(at + 1, int(np.searchsorted(lengths, before + BLOCK_POSTINGS, "right"))))
        yield table.slice(at, end - at)
        at = end


def search_block(queries: Queries, table: pa.Table, best: list[list], k: int) -> None:
    """Bring each query's ``k`` best so far, as (score, -order of the id) heaps, up to date with the rows of a block."""
    table = table.sort_by([("doc_id", "ascending")]).combine_chunks()  # nulls last
    ids, n = table["doc_id"].to_pylist(), table["n"].to_pylist()
    owner = np.repeat(np.arange(len(n)), pc.list_value_length(table["term"]).to_numpy())
    flat = [pc.list_flatten(table[c]).to_numpy().astype(np.int64) for c in ("term", "tf")]
    block = block_of(queries, n, owner, *flat)
    for q, wanted in enumerate(queries.wanted):
        if (slices := block.scores(wanted)) is not None:
            slots = top(slices, k)
            for slot, score in zip(slots.tolist(), sums_at(slices, slots), strict=True):
                entry = (score, -math.inf if ids[slot] is None else -ids[slot])
                if len(best[q]) < k:
                    heapq.heappush(best[q], entry)
                elif entry > best[q][0]:
                    heapq.heapreplace(best[q], entry)


def rank(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ``k`` documents of highest score above 0 for each row of ``items`` (item_id, text): item_id, rank, doc_id, score.

    Terms are runs of ASCII letters and digits and of anything beyond ASCII, A-Z
    lower-cased. A document's impact for a term is an integer made of the term's
    weight and its saturated, length-normalised count; a score is the sum over
    the query's terms, repeats included. Nothing is sampled, cut or estimated.

    Null and empty texts hold no term: such documents are neither counted nor
    found, such items get no rows. Equal scores go by ascending doc_id, a null
    id last; repeated rows are ranked each; items are ranked row by row, those
    that share or lack an id too. Empty tables give no rows. Only ids and texts
    are read, whole.

    Items go out in blocks of bounded bytes. For each block the documents are
    read once, where they lie: only counts of the block's terms are kept. Each
    task then cuts its documents into index blocks of bounded rows and
    postings, asks each all queries, and passes on its own ``k`` best a query;
    these few rows are all that is shuffled. The driver gets document counts of
    the block's terms, as many as the block has terms.
    """
    spark, out = docs.sparkSession, None
    for rows in item_blocks(items):
        queries = Queries.of(rows)
        held = S.save(counted(docs, queries, id_col, text_col), "terms")
        n_docs, n_terms = held.agg(F.count("*"), F.sum("n")).first()
        df = dict(held.select(F.explode("term").alias("t")).groupBy("t").count().collect())
        queries.n_docs, queries.n_terms = n_docs, n_terms or 0
        queries.weights = np.array([weight(n_docs, df.get(t, 0)) for t in range(len(queries.vocabulary))], np.int64)
        sent = spark.sparkContext.broadcast(queries)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            best: list[list] = [[] for _ in sent.value.wanted]
            for table in cut(batches):
                search_block(sent.value, table, best, k)
            found = [(q, sent.value.ids[q], None if i == -math.inf else -i, s) for q, heap in enumerate(best) for s, i in heap]
            if found:
                yield pa.RecordBatch.from_pydict(dict(zip(FOUND_ARROW.names, zip(*found, strict=True), strict=True)), schema=FOUND_ARROW)

        order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        part = held.mapInArrow(run, FOUND).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        part = part.select("item_id", "rank", "doc_id", "score")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")


#: The same in DuckDB.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
s AS (SELECT count(*) AS n_docs, CAST(sum(len(t)) AS BIGINT) AS n_terms FROM d WHERE len(t) > 0),
p AS (SELECT row, doc_id, len(t) AS n, unnest(t) AS term FROM d),
f AS (SELECT row, doc_id, n, term, count(*) AS tf FROM p GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, s GROUP BY term),
i AS (SELECT row_number() OVER () AS item, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM benchmark),
q AS (SELECT item, item_id, term, count(*) AS r FROM (SELECT item, item_id, unnest(t) AS term FROM i) GROUP BY ALL),
x AS (SELECT item, item_id, row, doc_id, CAST(sum(r * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN f USING (term), s GROUP BY item, item_id, row, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
FROM x WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) <= 10
"""
