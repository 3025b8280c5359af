"""Operator 11, spelling variant grouping: two-dimensional range reporting on wavelet trees, one rectangle an edit position."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _shared as S

#: In Latin-1, the letters of words (A-Z, a-z and all from C0 on) with A-Z lower-cased; others part words.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))
#: Distinct words that a task counts before it passes them on.
HELD_WORDS = 1 << 18
#: Words that one set of trees holds.
AT_ONCE = 1 << 15
#: Words that may share a window's key before the window is halved.
MOST_SHARING = 1 << 15
#: Cells (words x positions, or reported points) worked on at once.
CELLS = 1 << 20


def planted(doc_id: int | None, word: str) -> str:
    """The run as it is read: where 97 divides the checksum of id and run, without one of its characters."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
    if h % 97:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def runs(text: str) -> list[bytes]:
    """The runs of letters in Latin-1; characters beyond it part them."""
    return text.encode("latin-1", "replace").translate(LETTERS).split()


def vocabulary(docs: DataFrame, min_chars: int = 5, min_count: int = 3, read_as: Callable[[int | None, str], str] = planted, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): words of at least ``min_chars`` code points with ``min_count`` occurrences over all texts.

    ``read_as`` may change a run but not lengthen it. Each task counts before anything is shuffled, in tables of bounded size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"word": list(held), "n": list(held.values())}, schema=pa.schema([("word", pa.string()), ("n", pa.int64())]))

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for raw, n in Counter(runs(text)).items():
                    if len(raw) >= min_chars and len(read := read_as(doc, raw.decode("latin-1"))) >= min_chars:
                        held[read] += n
                if len(held) >= HELD_WORDS:
                    yield out()
                    held.clear()
        if held:
            yield out()

    counts = S.texts(docs, id_col, text_col).mapInArrow(run, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


class WaveletTree:
    """Points (place, value) of a permutation, reported by rectangles; one bit vector a level, the values' top bit first."""

    def __init__(self, values: np.ndarray):
        self.n, self.levels = len(values), max(1, int(len(values) - 1).bit_length()) if len(values) else 1
        self.ones: list[np.ndarray] = []  # ones before each place, by level
        for level in range(self.levels - 1, -1, -1):
            bits = (values >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bits)]))
            values = np.concatenate([values[bits == 0], values[bits == 1]])  # all zeros before all ones

    def report(self, start: np.ndarray, end: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rectangle, value) of every point with start <= place < end and low <= value < high."""
        query, base = np.arange(len(start)), np.zeros(len(start), np.int64)
        for depth, ones in enumerate(self.ones):
            width, zeros = 1 << (self.levels - 1 - depth), self.n - ones[-1]
            one_start, one_end = ones[start], ones[end]
            at = [(start - one_start, end - one_end, base), (zeros + one_start, zeros + one_end, base + width)]
            start, end, base = (np.concatenate(x) for x in zip(*at, strict=True))
            query = np.concatenate([query, query])
            some = (end > start) & (base < high[query]) & (base + width > low[query])
            start, end, base, query = start[some], end[some], base[some], query[some]
        return query, base


def codes(words: list[str], width: int) -> np.ndarray:
    """Code points by word, 0 after the last."""
    raw = np.frombuffer("".join(w.ljust(width, "\0") for w in words).encode("utf-32-le", "surrogatepass"), np.uint32)
    return raw.reshape(len(words), width)


def sorted_by(group: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of rows by group and row of ``table``; for each place, how many leading columns it shares with the place before, -1 for another group)."""
    order = np.lexsort([*table.T[::-1], group])
    t, g = table[order], group[order]
    differ = t[1:] != t[:-1]
    shared = np.where(differ.any(axis=1), differ.argmax(axis=1), table.shape[1])
    return order, np.concatenate([[-1], np.where(g[1:] != g[:-1], -1, shared)])


def intervals(shared: np.ndarray, length: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the word at each place ``at``: the places that share its first ``length`` columns, as [start, end)."""
    start, end = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
    for n in np.unique(length):
        some, borders = length == n, np.append(np.flatnonzero(shared < n), len(shared))
        k = np.searchsorted(borders, at[some], "right")
        start[some], end[some] = borders[k - 1], borders[k]
    return start, end


def near_pairs(group: np.ndarray, words: list[str], short: np.ndarray, first: np.ndarray, last: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of words of one group, one edit apart, in both orders, each where its window [first, last) holds the edit.

    A group has words of a length and (``short`` false) of one more; its words
    share what lies before the window and after it. Every short word asks, for
    each position of its window, for the words that begin as it does up to the
    position (an interval of the words in order) and end as it does from there
    on (an interval of the reversed words in order): with the character left
    out it finds replacements among its equals, with none left out insertions
    among the longer ones. Points are (place in order, place in reverse order).
    An insertion into a run of equal characters has several positions; the last
    one counts. The end of a word is one more position for insertions only.
    """
    lengths = np.array([len(w) for w in words])
    width = int(lengths.max())
    table = codes(words, width)
    forward, prefix = sorted_by(group, table)
    mirrored = np.take_along_axis(table, (lengths[:, None] - 1 - np.arange(width)) % width, axis=1)
    mirrored = np.where(np.arange(width) < lengths[:, None], mirrored, 0)
    backward, suffix = sorted_by(group, mirrored)
    place, mirror = np.argsort(forward), np.argsort(backward)
    ends = last == np.where(short, lengths, 0)
    for wanted, gap in ((short, 0), (~short, 1)):
        if not wanted.any():
            continue
        # places among the wanted words only, in either order
        before_f, before_b = np.concatenate([[0], np.cumsum(wanted[forward])]), np.concatenate([[0], np.cumsum(wanted[backward])])
        holders = backward[wanted[backward]]
        tree = WaveletTree(before_b[mirror[forward[wanted[forward]]]])
        asking = np.flatnonzero(short)
        spans = last[asking] - first[asking] + (ends[asking] if gap else 0)
        step = max(1, CELLS // max(1, int(spans.max(initial=1))))
        for at in range(0, len(asking), step):
            who = np.repeat(asking[at : at + step], spans[at : at + step])
            position = first[who] + np.arange(len(who)) - np.repeat(np.cumsum(spans[at : at + step]) - spans[at : at + step], spans[at : at + step])
            fs, fe = intervals(prefix, position, place[who])
            bs, be = intervals(suffix, lengths[who] - position - (1 - gap), mirror[who])
            query, value = tree.report(before_f[fs], before_f[fe], before_b[bs], before_b[be])
            one, other = who[query], holders[value]
            if gap:
                p = position[query]
                some = (p == lengths[one]) | (table[one, np.minimum(p, width - 1)] != table[other, p])
            else:
                some = one != other
            one, other = one[some], other[some]
            yield one, other
            if gap:
                yield other, one


KEYED = "length int, first int, last int, head string, tail string"


def windows(words: DataFrame, min_chars: int) -> DataFrame:
    """Each word once for each half of the positions, with words of its length and one more, and again with one less."""
    as_short = words.select("word", "n", F.length("word").alias("length"), F.lit(True).alias("short"))
    as_long = words.select("word", "n", (F.length("word") - 1).alias("length"), F.lit(False).alias("short")).where(F.col("length") >= min_chars)
    both = as_short.unionByName(as_long)
    half = F.floor(F.col("length") / 2).cast("int")
    spans = F.explode(F.array(F.struct(F.lit(0).alias("first"), half.alias("last")), F.struct(half.alias("first"), F.col("length").alias("last"))))
    return _keyed(both.select("word", "n", "length", "short", spans.alias("span")).select("word", "n", "length", "short", "span.first", "span.last"))


def _keyed(rows: DataFrame) -> DataFrame:
    """With what all words of a window share: the characters before it and those after it."""
    after = F.col("length") - F.col("last")
    tail = F.when(after > 0, F.expr("right(word, length - last)")).otherwise("")
    return rows.withColumn("head", F.expr("left(word, first)")).withColumn("tail", tail)


def _halved(rows: DataFrame) -> DataFrame:
    mid = F.floor((F.col("first") + F.col("last")) / 2).cast("int")
    spans = F.explode(F.array(F.struct(F.col("first"), mid.alias("last")), F.struct(mid.alias("first"), F.col("last"))))
    return _keyed(rows.select("word", "n", "length", "short", spans.alias("span")).select("word", "n", "length", "short", "span.first", "span.last"))


KEY = ["length", "first", "last", "head", "tail"]


def neighbours(words: DataFrame, min_chars: int, most_sharing: int = MOST_SHARING, at_once: int = AT_ONCE) -> DataFrame:
    """For each word with a near one: (word, n_near, form_n, form), the near word of largest count, ties to the smallest.

    Words meet in windows of positions: those of a key share all that lies
    outside. Keys of one word or without a shorter one have no pair and go; a
    window with more than ``most_sharing`` words is halved until it fits or is
    one position, where only as many words as there are characters share a key.
    Each pair has one position and so is found in one window.
    """
    todo, ready = windows(words, min_chars), None
    while True:
        sizes = todo.groupBy(*KEY).agg(F.count("*").alias("__size"), F.max("short").alias("__asks")).where("__size > 1 AND __asks")
        sized = S.save(todo.join(sizes.select(*KEY, "__size"), KEY), "windows")
        large = (F.col("__size") > most_sharing) & (F.col("last") - F.col("first") > 1)
        fit = sized.where(~large).drop("__size")
        ready = fit if ready is None else ready.unionByName(fit)
        if sized.where(large).isEmpty():
            break
        todo = _halved(sized.where(large).drop("__size"))

    schema = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("form_n", pa.int64()), ("form", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, at_once):
            for part in bounded(table):
                yield pa.RecordBatch.from_pydict(best_near(part), schema=schema)

    moved = ready.repartition(*[F.col(c) for c in KEY]).sortWithinPartitions(*KEY)
    found = moved.select(*KEY, "word", "n", "short").mapInArrow(run, "word string, n_near long, form_n long, form string")
    first = F.min(F.struct((-F.col("form_n")).alias("m"), F.col("form").alias("form")))
    best = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), first.alias("best"))
    return best.select("word", "n_near", (-F.col("best.m")).alias("form_n"), F.col("best.form").alias("form"))


def _group_ends(table: pa.Table) -> np.ndarray:
    """Places where another key begins, and the end."""
    new = np.zeros(table.num_rows, bool)
    for name in KEY:
        column = table[name].combine_chunks()
        if table.num_rows > 1:
            new[1:] |= np.asarray(pc.not_equal(column[1:], column[:-1]))
    return np.append(np.flatnonzero(new), table.num_rows)


def whole_groups(batches: Iterator[pa.RecordBatch], at_once: int) -> Iterator[pa.Table]:
    """Tables of about ``at_once`` sorted rows that never part the rows of a key."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= at_once:
            table = pa.Table.from_batches(held)
            cuts = _group_ends(table)
            if len(cuts) > 1:
                yield table.slice(0, cuts[-2])
                table = table.slice(cuts[-2])
            held, rows = table.to_batches(), table.num_rows
    if rows:
        yield pa.Table.from_batches(held)


def bounded(table: pa.Table) -> Iterator[pa.Table]:
    """Whole keys together while rows times longest word stay in bounds."""
    lengths, begin = table["length"].to_numpy() + 1, 0
    ends = _group_ends(table)
    for last, end in zip([0, *ends], ends, strict=False):
        width = int(lengths[last:end].max())  # rows come by length
        if (end - begin) * width > CELLS and last > begin:
            yield table.slice(begin, last - begin)
            begin = last
    if begin < table.num_rows:
        yield table.slice(begin)


def best_near(table: pa.Table) -> dict[str, list]:
    ends = _group_ends(table)
    group = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    words, n = table["word"].to_pylist(), table["n"].to_numpy()
    short, first, last = (table[c].to_numpy() for c in ("short", "first", "last"))
    rank = np.empty(len(words), np.int64)  # of largest count, then of the smallest word
    rank[sorted(range(len(words)), key=lambda i: (-n[i], words[i]))] = np.arange(len(words))
    near, best = np.zeros(len(words), np.int64), np.full(len(words), len(words), np.int64)
    for one, other in near_pairs(group, words, short, first.astype(np.int64), last.astype(np.int64)):
        near += np.bincount(one, minlength=len(words))
        np.minimum.at(best, one, rank[other])
    at = np.empty(len(words), np.int64)
    at[rank] = np.arange(len(words))
    rows = np.flatnonzero(near)
    forms = at[best[rows]]
    return {"word": [words[i] for i in rows], "n_near": near[rows], "form_n": n[forms], "form": [words[i] for i in forms]}


def rooted(words: DataFrame) -> DataFrame:
    """With ``root``, the last word along the forms; pointers double each round, so a path of m forms takes log2(m) rounds.

    Counts at least double along a form, so a path has at most 63 of them.
    """
    points = S.save(words.select("word", "form", F.coalesce("form", "word").alias("root")), "roots")
    while True:
        onward = points.select(F.col("word").alias("root"), F.col("root").alias("next")).where("root != next")
        moved = S.save(points.join(onward, "root", "left").select("word", "form", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        points = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return words.join(points.select("word", "root"), "word")


def variants(docs: DataFrame, min_chars: int = 5, min_count: int = 3, ratio: int = 2, read_as: Callable[[int | None, str], str] = planted, id_col: str = "doc_id", text_col: str = "text", most_sharing: int = MOST_SHARING, at_once: int = AT_ONCE) -> DataFrame:
    """Words of a corpus with their spelling variants: word, form, root, n, n_near, form_n.

    Words are the runs of Latin letters of whole texts, A-Z lower-cased, as
    ``read_as`` gives them. Near are words one inserted, deleted or replaced
    code point apart. A word's form is its near word of largest count, ties to
    the smallest, if that count is at least ``ratio`` times its own; its root is
    the last word along forms.

    Null and empty texts have no words; a null id is read as an empty one; rows
    that repeat, or share an id, count each; very long runs are words like
    others; an empty table gives no rows; only id and text are read.

    Texts are read once, where they lie. What is shuffled is counts and the
    vocabulary, each word at most four times; the trees hold bounded sets of it.
    """
    words = S.save(vocabulary(docs, min_chars, min_count, read_as, id_col, text_col), "vocabulary")
    near = words.join(neighbours(words, min_chars, most_sharing, at_once), "word", "left")
    takes = F.col("form_n") >= ratio * F.col("n")
    formed = S.save(near.select("word", F.when(takes, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(takes, F.col("form_n")).alias("form_n")), "forms")
    return rooted(formed).select("word", "form", "root", "n", "n_near", "form_n")


#: The same in DuckDB, with the checksum spelled out.
ORACLE = r"""
WITH RECURSIVE bits AS (SELECT i, 0 AS k, i AS c FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
runs AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents),
low AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n FROM runs GROUP BY ALL),
raw AS (SELECT *, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''),
  lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [CAST(192 + (unicode(c) >> 6) AS BIGINT), CAST(128 + (unicode(c) & 63) AS BIGINT)] END)) AS bytes FROM low WHERE length(run) >= 5),
h AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM raw, crc),
v AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word, CAST(sum(n) AS BIGINT) AS n FROM h GROUP BY 1 HAVING sum(n) >= 3 AND length(word) >= 5),
e AS (SELECT word, n, unnest(range(length(word))) AS i FROM v),
x AS (SELECT word, n, i, length(word) AS l, substr(word, 1, i) || substr(word, i + 2) AS rest FROM e),
pairs AS (SELECT a.word, b.word AS other, b.n AS m FROM x a JOIN x b ON a.rest = b.rest AND a.i = b.i AND a.l = b.l AND a.word <> b.word
  UNION SELECT x.word, v.word, v.n FROM x JOIN v ON x.rest = v.word UNION SELECT v.word, x.word, x.n FROM x JOIN v ON x.rest = v.word),
best AS (SELECT word, count(*) AS n_near, arg_min(other, (-m, other)) AS other, max(m) AS m FROM pairs GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * n THEN other END AS form, CASE WHEN m >= 2 * n THEN m END AS form_n FROM v LEFT JOIN best USING (word)),
r AS (SELECT word, word AS root, form FROM f UNION ALL SELECT r.word, r.form, f.form FROM r JOIN f ON f.word = r.form WHERE r.form IS NOT NULL)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM f JOIN r ON r.word = f.word AND r.form IS NULL
"""
