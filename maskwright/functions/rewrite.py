"""Text rewriting as column expressions: splicing by byte spans, and references in texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import scalars as fn

#: A reference in brackets, brackets possibly escaped for Markdown (fixed pattern).
REFERENCE = r"\\?\[((?i:email|domain|phone|ssn|cc|credit_card|credit-card)):([1-9A-HJ-NP-Za-km-z]{22})\\?\]"


def splice(text: Column, replacements: Column) -> Column:
    """``text`` with byte spans (start, end, text) replaced; spans must not overlap, those out of range are ignored.

    The pieces between the spans and the new texts are joined once, so many
    spans cost no more than the text is long.
    """

    def spliced(held: Column) -> Column:
        raw, ordered = held["raw"], held["ordered"]
        starts, ends = F.transform(ordered, lambda r: r["start"]), F.transform(ordered, lambda r: r["end"])
        froms = F.concat(F.array(F.lit(0)), ends)
        upto = F.concat(starts, F.array(F.octet_length(raw)))
        gaps = F.zip_with(froms, upto, lambda a, b: F.decode(F.substring(raw, a + 1, b - a), "UTF-8"))
        news = F.concat(F.transform(ordered, lambda r: r["text"]), F.array(F.lit("")))
        return F.array_join(F.zip_with(gaps, news, lambda g, n: F.concat(g, n)), "")

    inside = F.filter(replacements, lambda r: (r["start"] >= 0) & (r["start"] <= r["end"]) & (r["end"] <= F.octet_length(text)))
    ordered = F.array_sort(F.transform(inside, lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"), F.coalesce(r["text"], F.lit("")).alias("text"))))
    return F.when(F.size(replacements) == 0, text).otherwise(fn.let(F.struct(F.encode(text, "UTF-8").alias("raw"), ordered.alias("ordered")), spliced))


def find_references(text: Column) -> Column:
    """array<struct<start,end,kind,id,key>> of the valid references in a text, in order."""
    from .detect import located

    spans = located(text, REFERENCE, F.lit(REFERENCE))

    def parsed(s: Column) -> Column:
        kind, id_ = fn.kind_tag(F.regexp_extract(s["value"], REFERENCE, 1)), F.regexp_extract(s["value"], REFERENCE, 2)
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), kind.alias("kind"), id_.alias("id"), fn.reference_key(kind, id_).alias("key"))

    shaped = F.filter(F.transform(spans, parsed), lambda r: fn.valid_reference_id(r["id"]))
    return F.when(text.contains("["), shaped).otherwise(F.array().cast("array<struct<start:int,end:int,kind:string,id:string,key:string>>"))
