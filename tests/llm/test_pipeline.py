from __future__ import annotations

from collections import Counter
from pathlib import Path

import corpus_pipeline
import pytest
from maskwright.llm import _shared, decontamination, pii, quality_classifier, queries, simhash


def test_stages_take_effect_and_keep_columns(spark, data):
    docs = _shared.table(spark, data, "documents")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = _shared.save(stage(spark, docs, data), name)
        assert docs.columns == columns
    rows = docs.collect()
    assert 0 < len(rows) < before and len({r["doc_id"] for r in rows}) == len(rows)
    assert not any(pii.base_spans(r["text"] or "") for r in rows)
    assert decontamination.report(docs, _shared.table(spark, data, "benchmark")).count() == 0
    name, pack = corpus_pipeline.STAGES[-1]
    placed = pack(spark, docs, data).collect()
    assert {r["doc_id"] for r in placed} == {r["doc_id"] for r in rows}


def test_results_of_one_stage_are_read_side_by_side(spark, data):
    docs = _shared.table(spark, data, "documents")
    for name, stage in corpus_pipeline.STAGES:
        a, b = stage(spark, docs, data), stage(spark, docs.limit(50), data)
        assert a.count() >= b.count() > 0, name


def test_run_and_names(spark, data):
    root = Path(_shared.shared_root(spark).removeprefix("file://"))
    before, tables = set(root.iterdir()), len(spark.catalog.listTables())
    out = corpus_pipeline.run(spark, data)
    assert out.count() > 0 and len(spark.catalog.listTables()) == tables
    assert [p.name.split("-")[0] for p in set(root.iterdir()) - before] == ["packing"]
    assert [n.split("_")[0] for n in queries.queries()] == [f"op{k}" for k in range(1, 14)]
    assert simhash.fingerprint("") == 0


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row int, rid int, s int, features string, base int, __row int"
PROSE = "The river ran past the old mill, and the children of the village went down to it in the evening. They brought bread and sat on the wall. "
ROWS = [(1, PROSE * 3), (1, " ".join(reversed(PROSE.split()))), (1, PROSE * 3), (None, "Another text of no id, which is as long as it must be to be read by anyone. " * 2), (None, None), (3, ""), (4, None), (5, " ".join(f"long{k % 991}" for k in range(120_000))), (6, "Ann wrote from ann@site.com to the mill, where they read it. " * 2)]


def rows(spark, given):
    return spark.createDataFrame([(i, t, "en", "x", len(t or ""), 1, 2, 3, "f", 4, 5) for i, t in given], SCHEMA)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_awkward_tables(spark, data, name):
    """Nulls, empty and long texts, repeated rows, shared and missing ids, clashing names, an empty table."""
    stage = dict(corpus_pipeline.STAGES)[name]
    given = rows(spark, ROWS)
    out = stage(spark, given, data)
    got = out.collect()
    assert stage(spark, rows(spark, []), data).count() == 0
    if name == "packing":
        assert len({r["sequence_id"] for r in got}) >= 1 and Counter(r["doc_id"] for r in got if r["piece"] == 0) == Counter(i for i, _ in ROWS)
        return
    assert out.columns == given.columns and all((r["row"], r["rid"], r["s"], r["features"], r["base"], r["__row"]) == (1, 2, 3, "f", 4, 5) for r in got)
    pairs = Counter((r["doc_id"], r["text"]) for r in got)
    if name == "simhash_dedup":
        assert pairs == Counter([ROWS[0], ROWS[1], ROWS[3], (3, ""), ROWS[7], ROWS[8]])
    elif name == "decontamination":
        assert pairs == Counter(ROWS)
    elif name == "pii":
        assert pairs == Counter((i, t and t.replace("ann@site.com", "[EMAIL]")) for i, t in ROWS)
        assert all(r["n_chars"] is None if r["text"] is None else r["n_chars"] == len(r["text"]) for r in got)
    else:
        assert not pairs - Counter(ROWS) and pairs[ROWS[0]] in (0, 2)


def test_quality_stage_keeps_what_the_scores_say(spark, data):
    """The stage and the scores of op10 learn alike and agree row by row."""
    docs, labels = _shared.table(spark, data, "documents"), _shared.table(spark, data, "labels")
    want = {r["doc_id"] for r in quality_classifier.score_documents(docs, labels).where("predicted = 1").collect()}
    assert {r["doc_id"] for r in corpus_pipeline.keep_good(spark, docs, data).collect()} == want
