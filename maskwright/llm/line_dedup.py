"""Operator 13, line dedup: lines that many documents hold go, in DataFrame expressions only."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _shared as S

#: What a key is stripped of at both ends.
BLANK = " \t\n\x0b\x0c\r"


def key_of(line: Column) -> Column:
    """The line without white space at its ends, A-Z lower-cased (other letters stay)."""
    bare = F.btrim(line, F.lit(BLANK))
    ascii_only = F.octet_length(bare) == F.length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, string.ascii_uppercase, string.ascii_lowercase))


def hashes(value: Column, one: str, two: str) -> list[Column]:
    """128 bits that stand for a string: two 64-bit hashes under different seeds."""
    return [F.xxhash64(value).alias(one), F.xxhash64(F.lit("second"), value).alias(two)]


def drop_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The texts without lines that at least ``min_docs`` documents hold; the document of the largest id keeps its own.

    Lines are compared by `key_of`; shorter keys than ``min_chars`` code points
    never go. Gives doc_id, n_lines (before), n_dropped and text (the lines
    that stay, joined).

    Null and empty texts are one empty line, which stays. Rows of one id are
    one document when documents are counted, and each loses lines by its own
    text; a null id counts as one document and is never the largest. Repeated
    lines of the document that keeps a key all stay. An empty table gives no
    rows; only id and text are read.

    Only hashes of lines are moved: distinct (key, document) pairs, then one
    count a key with partial sums, so a line that every document holds gathers
    nowhere. Texts move once, by their id and content, to meet the positions
    that go; where few lines go Spark broadcasts those instead.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("*", *hashes(F.col("text"), "t1", "t2"))
    lines = rows.select("doc_id", "t1", "t2", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    lines = lines.select("doc_id", "t1", "t2", "pos", key_of(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    lines = lines.select("doc_id", "t1", "t2", "pos", *hashes(F.col("key"), "h1", "h2"))

    held = lines.select("h1", "h2", "doc_id").distinct().groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("doc_id").alias("last"))
    common = S.save(held.where(F.col("n") >= min_docs).select("h1", "h2", "last"), "common-lines")  # read again, so that the join below may split a hot key
    gone = lines.join(common, ["h1", "h2"]).where("doc_id IS NULL OR doc_id < last").groupBy("doc_id", "t1", "t2").agg(F.collect_set("pos").alias("gone"))

    gone = gone.select(F.col("doc_id").alias("g_id"), F.col("t1").alias("g1"), F.col("t2").alias("g2"), "gone")
    met = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("g_id")) & (F.col("t1") == F.col("g1")) & (F.col("t2") == F.col("g2")), "left")

    def kept(parts: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("gone"))
        return F.struct(F.size(parts).cast("long").alias("n"), F.array_join(F.transform(stay, lambda i: F.get(parts, i)), "\n").alias("text"))

    whole = F.struct((F.length("text") - F.length(F.translate("text", "\n", "")) + 1).cast("long").alias("n"), F.col("text").alias("text"))
    rest = F.when(F.col("gone").isNull(), whole).otherwise(F.transform(F.array(F.split("text", "\n", -1)), kept)[0])
    out = met.select("doc_id", F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_dropped"), rest.alias("rest"))
    return out.select("doc_id", F.col("rest.n").alias("n_lines"), "n_dropped", F.col("rest.text").alias("text"))


#: The digest of op13 in DuckDB.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
l AS (SELECT row, doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.*, c.key IS NOT NULL AND k.doc_id < c.last AS gone FROM k LEFT JOIN c USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY row
"""
