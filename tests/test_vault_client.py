"""Protecting and resolving through a store of one's own."""

from __future__ import annotations

import collections
import json
from pathlib import Path

from maskwright.operators import vault_client
from maskwright.plans import pipeline

TEXTS = [(1, "ann@site.org and bob@site.org"), (2, "ann@Site.org again ann@site.org"), (3, "bad@site.org"), (4, "bad@site.org, bad@SITE.org or ann@site.org"), (5, "down@site.org"), (None, None), (6, "nothing"), (7, "ssn 123-45-6789 of ann@site.org")]


def connecting(folder: str):
    """A store of files, which logs its calls; values with bad in them fail, and so does every batch with down in it."""

    def connect():
        class Files:
            def put(self, rows):
                with open(f"{folder}/calls-{hash(str(rows))}", "w") as f:
                    json.dump([v for _, v, _ in rows], f)
                if any("down" in v for _, v, _ in rows):
                    raise OSError("down")
                out = []
                for kind, value, id_ in rows:
                    if "bad" in value:
                        out.append(None)
                    else:
                        (Path(folder) / f"{kind}:{id_}").write_text(value)
                        out.append(id_)
                return out

            def get(self, keys):
                return [OSError("no") if k.endswith("z") else (Path(folder) / k).read_text() if (Path(folder) / k).exists() else None for k in keys]

        return Files()

    return connect


def test_failures_fall_back_value_by_value(spark, tmp_path):
    df = spark.createDataFrame(TEXTS, "id long, text string")
    rows = pipeline.protect_through(df, {"ssn": "block"}, connecting(str(tmp_path)), batch=1, salt="s").collect()
    assert len(rows) == len(TEXTS)
    by = {r["id"]: r for r in rows}
    modes = {i: [x["mode"] for x in r["plan"]["replacements"]] for i, r in by.items()}
    assert modes == {1: ["tokenized"] * 2, 2: ["tokenized"] * 2, 3: ["redact_only_fallback"], 4: ["redact_only_fallback"] * 2 + ["tokenized"], 5: ["redact_only_fallback"], None: [], 6: [], 7: []}
    assert [len(by[i]["plan"]["vault_failures"]) for i in (1, 3, 4, 5)] == [0, 1, 1, 1]
    assert by[4]["output"].startswith("[email], [email] or [email:") and by[7]["status"] == "blocked"
    asked = collections.Counter(v for p in tmp_path.glob("calls-*") for v in json.loads(p.read_text()))
    assert asked == {"ann@site.org": 1, "bob@site.org": 1, "bad@site.org": 1, "down@site.org": 1}

    back = pipeline.resolve_through(spark.createDataFrame([(r["id"], r["output"]) for r in rows], "id long, text string"), connecting(str(tmp_path)))
    got = {r["id"]: r["output"] for r in back.collect()}
    assert got[1] == "ann@site.org and bob@site.org" and got[2] == "ann@site.org again ann@site.org" and got[3] is None


def test_a_failing_batch_fails_whole(spark, tmp_path):
    df = spark.createDataFrame([(1, "ann@site.org"), (2, "down@site.org")], "id long, text string").coalesce(1)
    conf = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        rows = pipeline.protect_through(df, {}, connecting(str(tmp_path)), salt="s").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", conf)
    assert [r["output"] for r in rows] == ["[email]", "[email]"]


def test_known_ids_and_unreadable_keys(spark, tmp_path):
    class Known:
        def put(self, rows):
            return ["1" * 22 for _ in rows]

        def get(self, keys):
            return [ValueError() if k.endswith("2") else "v" for k in keys]

    out = pipeline.protect_through(spark.createDataFrame([(1, "ann@site.org")], "id long, text string"), {}, lambda: Known(), salt="s").first()["output"]
    assert out == f"[email:{'1' * 22}]"
    keys = spark.createDataFrame([("email:1",), ("email:2",), ("email:1",), (None,)], "key string")
    values, failed = vault_client.get_values(keys, lambda: Known())
    assert [tuple(r) for r in values.collect()] == [("email:1", "v")] and [r["key"] for r in failed.collect()] == ["email:2"]
