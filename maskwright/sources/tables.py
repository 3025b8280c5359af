"""Reading and writing: whole text files, stores, profiles and settings."""

from __future__ import annotations

import json
import os
import tomllib
from dataclasses import dataclass, field, fields, replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import consent, events, traffic

VAULT = "key string, value string, created_at long, updated_at long"
SCHEMAS = {"vault": VAULT, "consents": consent.SCHEMA, "log": events.SCHEMA}


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """id (the path) and text of whole files; files that are not UTF-8 are left out by `valid_only`."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.col("path").alias("id"), F.col("content"))


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """(path, pos, event) of event-stream captures of any size: events without the blank line that ends them.

    Spark cuts files at byte ranges and reads whole lines (of any line end), so
    a capture is read by many tasks. A line's event is numbered by the blank
    lines before it: those of its own range, and those of earlier ranges, of
    which only counts are moved. Lines then meet by event, so no row is larger
    than an event. ``pos`` rises with the file, with gaps where blank lines repeat.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("row"), "value")
    blank = F.when(F.col("value") == "", 1).otherwise(0)
    own = F.sum(blank).over(Window.partitionBy("path", "at").orderBy("row").rowsBetween(Window.unboundedPreceding, 0))
    before = F.sum("n").over(Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))  # one row a range
    starts = lines.groupBy("path", "at").agg(F.sum(blank).alias("n")).select("path", "at", F.coalesce(before, F.lit(0)).alias("start"))
    placed = lines.withColumn("own", own).where("value <> ''").join(starts, ["path", "at"]).withColumn("pos", F.col("start") + F.col("own"))
    held = placed.groupBy("path", "pos").agg(F.array_sort(F.collect_list(F.struct("at", "row", "value"))).alias("lines"))
    return held.select("path", "pos", F.array_join(F.transform("lines", lambda x: x["value"]), "\n").alias("event"))


def valid_only(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, text) of the valid files, and the ids of the others."""
    text = files.withColumn("text", F.try_validate_utf8(F.col("content").cast("string")))
    return text.where("text IS NOT NULL").select("id", "text"), text.where("text IS NULL").select("id")


def write_texts(outputs: DataFrame, path: str) -> None:
    outputs.select(F.col("output").alias("value")).where("value IS NOT NULL").write.mode("overwrite").text(path)


def read_store(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[kind]).parquet(path)


def write_snapshot(df: DataFrame, path: str) -> None:
    """A store never overwrites what it is computed from: write to a new path, then publish that."""
    df.write.mode("errorifexists").parquet(path)


def read_profile(spark: SparkSession, path: str) -> DataFrame:
    """One row per app of a traffic profile's JSON, with the profile's default action."""
    profile = spark.read.schema(traffic.PROFILE).json(path, multiLine=True)
    return profile.select("name", "default_action", F.posexplode("apps").alias("ordinal", "app")).select("name", "default_action", "ordinal", "app.*")


def load_rules(text: str) -> tuple[list[dict], str]:
    """Rules and default action of a profile's JSON; raises on invalid ones."""
    profile = json.loads(text)
    if found := traffic.check_rules(profile["apps"]):
        raise ValueError("; ".join(found))
    return profile["apps"], profile["default_action"]


def read_profiles(spark: SparkSession, directory: str) -> DataFrame:
    """Integration profiles (id, name, traffic_app_ids) of a folder of JSON files."""
    return spark.read.schema("id string, name string, traffic_app_ids array<string>").json(directory, multiLine=True)


@dataclass(frozen=True)
class Settings:
    """Settings of a protecting job, later layers over earlier ones: defaults, file, environment, arguments."""

    default_action: str = "tokenize"
    policy: dict[str, str] = field(default_factory=dict)
    consent_ttl: int = 86_400
    deduplicate: bool = True
    resolve_inbound: bool = True
    strict: bool = False
    salt: str = ""
    related_domains: tuple[str, ...] = ()

    @staticmethod
    def load(path: str | Path | None = None, env: dict[str, str] | None = None, **arguments) -> Settings:
        found: dict = tomllib.loads(Path(path).read_text()) if path else {}
        known = {f.name for f in fields(Settings)}
        if unknown := set(found) - known:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        for name in known - {"policy"}:
            raw = (os.environ if env is None else env).get(f"MASKWRIGHT_{name.upper()}")
            if raw is not None:
                found[name] = parse(raw, Settings.__dataclass_fields__[name].type)
        found |= {k: v for k, v in arguments.items() if v is not None}
        if "related_domains" in found:
            found["related_domains"] = tuple(found["related_domains"])
        return replace(Settings(), **found)


def parse(raw: str, type_: str):
    """Words for booleans, whole numbers, comma lists, else text."""
    if type_ == "bool":
        if raw.strip().lower() in ("true", "1", "yes", "on"):
            return True
        if raw.strip().lower() in ("false", "0", "no", "off"):
            return False
        raise ValueError(f"not a boolean: {raw}")
    if type_ == "int":
        return int(raw)
    if type_.startswith("tuple"):
        return tuple(dict.fromkeys(x.strip() for x in raw.split(",") if x.strip()))
    return raw
