"""Operators 11 to 13 against brute force, their DuckDB twins and awkward tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from maskwright.llm import _shared, line_dedup, queries, ranked_search, spelling

SCHEMA = "doc_id long, text string, lang string, word string, n long, h1 long, t1 long, pos int, line string, gone int, term string, tf int, score long, rank int, last int, rest string"
LONG = " ".join(f"w{k % 977}x{k}" for k in range(60_000))
LINE = "A line that is long enough to be a key of its own"


def frame(spark, given):
    return spark.createDataFrame([(i, t, "en", "w", 1, 2, 3, 4, "l", 5, "t", 6, 7, 8, 9, "r") for i, t in given], SCHEMA)


AWKWARD = [
    (0, LINE + "\nshort\n" + LINE), (1, None), (2, ""), (3, LONG), (4, "\n\n" + LINE.upper() + " \x0b"), (4, "\n\n" + LINE.upper() + " \x0b"), (None, "no id\n" + LINE), (None, "no id\n" + LINE),
    (5, " \n\t " + LINE), (6, "x" * 70_000 + "\n" + LINE), (7, "É" * 25), (8, "é" * 25 + "\r\n" + "É" * 25), (9, "É" * 25 + "\n" + "y" * 70_000), (10, "É" * 25 + "\nLAST\n" + "É" * 25), (11, "😀" * 20), (12, "x" * 70_000 + " y"), (13, "x" * 70_000),
]
ASCII_LOW = {k: k + 32 for k in range(65, 91)}


# 11


def words_of(docs, min_count=3):
    counts: Counter = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(ASCII_LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += len(run) >= 5
    return {w: n for w, n in counts.items() if n >= min_count}


def variants_by_hand(words):
    """By all deletions of all words."""
    near, same = defaultdict(set), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            rest = w[:i] + w[i + 1 :]
            same[i, rest, len(w)].add(w)
            if rest in words:
                near[w].add(rest)
                near[rest].add(w)
    for group in same.values():
        for w in group:
            near[w] |= group - {w}
    best = {w: min(near[w], key=lambda v: (-words[v], v), default=None) for w in words}
    form = {w: b if b is not None and words[b] >= 2 * words[w] else None for w, b in best.items()}
    out = {}
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), words.get(form[w]))
    return out


def test_trees_report_the_points_of_rectangles():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 7, 8, 9, 100):
        values = rng.permutation(n)
        a, b, c, d = rng.integers(0, n + 1, (4, 60))
        query, value = spelling.WaveletTree(values).report(a, b, c, d)
        want = sorted((q, int(v)) for q in range(60) for v in values[a[q] : b[q]] if c[q] <= v < d[q])
        assert sorted(zip(query.tolist(), value.tolist(), strict=True)) == want


@pytest.mark.parametrize(("most_sharing", "at_once"), [(1 << 15, 1 << 15), (4, 50), (30, 7)])
def test_variants_are_those_of_brute_force(spark, most_sharing, at_once):
    """Dense words over three letters, with windows halved down to one position and trees of a few words."""
    rng = random.Random(3)
    pool = ["".join(rng.choice("abé") for _ in range(rng.randint(4, 8))) for _ in range(700)] + ["aaaaa", "aaaaaa", "aaaaaaa", "baaaaa", "aaaaab"]
    docs = [(i, " ".join(rng.choices(pool, weights=[1 / (k + 1) for k in range(len(pool))], k=60))) for i in range(150)] + [(900, " ".join(pool[-5:] * 3))]
    got = {r["word"]: tuple(r)[1:] for r in spelling.variants(frame(spark, docs), most_sharing=most_sharing, at_once=at_once).collect()}
    want = variants_by_hand(words_of(docs))
    assert got == want and sum(v[0] is not None for v in want.values()) > 50 and any(v[0] and v[0] != v[1] for v in want.values())


def test_variants_of_all_documents(spark, data):
    docs = _shared.table(spark, data, "documents")
    got = {r["word"]: tuple(r)[1:] for r in queries.op11_spelling(spark, data).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    assert got == variants_by_hand(words_of([(r["doc_id"], r["text"]) for r in docs.collect()]))


def test_variants_awkward(spark):
    given = AWKWARD * 2
    got = {r["word"]: tuple(r)[1:] for r in spelling.variants(frame(spark, given)).collect()}
    assert got == variants_by_hand(words_of(given)) and "x" * 70_000 in got
    assert spelling.variants(frame(spark, [])).count() == 0


def test_roots_follow_long_paths(spark):
    rows = [(f"w{k}", f"w{k + 1}" if k < 40 else None) for k in range(41)] + [("alone", None)]
    got = {r["word"]: r["root"] for r in spelling.rooted(spark.createDataFrame(rows, "word string, form string")).collect()}
    assert got == {w: "alone" if w == "alone" else "w40" for w, _ in rows}


# 12


def ranked_by_hand(docs, items, k=10):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(ASCII_LOW))
    held = [(i, t) for i, text in docs if (t := cut(text))]
    n_docs, n_terms = len(held), sum(len(t) for _, t in held)
    df = Counter(x for _, t in held for x in set(t))
    counts = [(i, len(t), Counter(t)) for i, t in held]
    out = []
    for item, text in items:
        scores = []
        for i, n, c in counts:
            m = 100 - 75 + (75 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * ((1000000000 * c[x]) // (1000 * c[x] + 8 * m)) for x in cut(text) if x in c)
            if score > 0:
                scores.append((-score, i is None, i or 0))
        out += [(item, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def test_slices_add_and_give_the_top():
    rng = np.random.default_rng(2)
    numbers = rng.integers(0, 1 << 20, (2, 3, 256)) * rng.integers(0, 2, (2, 3, 256))
    sliced = np.stack([np.packbits((numbers >> b) & 1, axis=-1, bitorder="little").view(np.uint64) for b in range(22)], axis=2)
    total = ranked_search.add(sliced[0], sliced[1])
    for row, both in zip(total, numbers.sum(axis=0), strict=True):
        assert ranked_search.sums_at(row, np.arange(256)) == both.tolist()
        for k in (1, 5, 300):
            want = sorted(range(256), key=lambda s, both=both: (-both[s], s))[:k]
            assert sorted(ranked_search.top(row, k).tolist()) == sorted(s for s in want if both[s] > 0)
    ties = np.zeros((3, 4), np.uint64)
    ties[1] = np.uint64((1 << 64) - 1)
    assert ranked_search.top(ties, 10).tolist() == list(range(10))


@pytest.mark.parametrize("bounds", [(1 << 14, 1 << 22, 256 << 20), (7, 40, 2000)])
def test_ranks_are_those_of_brute_force(spark, bounds, monkeypatch):
    """Ties, repeated words of items, items that share or lack an id, one block of items each, blocks of a few rows."""
    for name, value in zip(("BLOCK_ROWS", "BLOCK_POSTINGS", "BLOCK_BYTES"), bounds, strict=True):
        monkeypatch.setattr(ranked_search, name, value)
    rng = random.Random(5)
    pool = [f"t{k}" for k in range(40)] + ["É", "ab", "AB", "a-b", "x_y", "日本"]
    docs = [(i, " ".join(rng.choices(pool, weights=[1 / (k + 1) for k in range(len(pool))], k=rng.randint(0, 30)))) for i in range(200)] + [(500, "t1"), (501, "t1"), (None, "t1"), (502, None), (500, "t1")]
    items = [(k, " ".join(rng.choices(pool, k=12))) for k in range(20)] + [(3, "t1 t1 t1 ab AB"), (None, "t1"), (21, ""), (22, None), (23, "absent"), (24, "t1 " * 70 + "t2 " * 33)]
    got = ranked_search.rank(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((tuple(r[c] for c in ("item_id", "rank", "doc_id", "score")) for r in got), key=str) == ranked_by_hand(docs, items)


def test_ranks_in_several_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(ranked_search, "item_blocks", lambda items: [[(r[0], r[1])] for r in items.collect()])
    docs = [(i, f"a{i % 3} b{i % 5}") for i in range(30)]
    items = [(1, "a1 b2"), (2, "b4")]
    got = ranked_search.rank(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((tuple(r) for r in got), key=str) == ranked_by_hand(docs, items)


def test_ranks_awkward(spark):
    items = [(1, LINE), (2, "É" * 25), (3, "w5x5 " + "x" * 70_000)]
    marks = spark.createDataFrame(items, "item_id long, text string")
    got = ranked_search.rank(frame(spark, AWKWARD), marks).collect()
    assert sorted((tuple(r) for r in got), key=str) == ranked_by_hand(AWKWARD, items)
    assert ranked_search.rank(frame(spark, []), marks).count() == 0 and ranked_search.rank(frame(spark, AWKWARD), marks.where("false")).count() == 0


# 13


def lines_by_hand(docs, min_chars=20, min_docs=3):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(ASCII_LOW)
    holders = defaultdict(set)
    for i, text in docs:
        for line in (text or "").split("\n"):
            holders[key(line)].add(i)
    last = {k: max(i for i in ids if i is not None) for k, ids in holders.items() if len(k) >= min_chars and len(ids) >= min_docs}
    out = []
    for i, text in docs:
        lines = (text or "").split("\n")
        stay = [x for x in lines if key(x) not in last or i == last[key(x)]]
        out.append((i, len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return sorted(out, key=str)


def digest(df):
    return sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], hashlib.sha256(r["text"].encode()).hexdigest()) for r in df.collect()), key=str)


def test_lines_awkward(spark):
    got = digest(line_dedup.drop_lines(frame(spark, AWKWARD)))
    assert got == lines_by_hand(AWKWARD) and sum(r[2] for r in got) > 5
    assert line_dedup.drop_lines(frame(spark, [])).count() == 0


def test_lines_are_those_of_brute_force(spark):
    rng = random.Random(7)
    pool = [f"{LINE} {k}" for k in range(6)] + [f"  {LINE.upper()} {k}\t" for k in range(6)] + ["", "short", "É" * 19, "É" * 20, "é" * 20]
    docs = [(rng.randint(0, 60), "\n".join(rng.choices(pool, k=rng.randint(1, 6)))) for _ in range(90)]
    for chars, least in ((20, 3), (1, 2), (45, 9)):
        assert digest(line_dedup.drop_lines(frame(spark, docs), min_chars=chars, min_docs=least)) == lines_by_hand(docs, chars, least)


def test_lines_run_no_python(spark, data):
    plan = queries.op13_line_dedup(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# DuckDB


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_twin(spark, data, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    df = queries.queries()[name](spark, data)
    columns = sorted(df.columns)
    cursor = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str) == sorted((tuple(r[names.index(c)] for c in columns) for r in cursor.fetchall()), key=str)
