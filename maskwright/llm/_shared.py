"""Helpers shared by the corpus operators: tables, shared storage, Arrow maps."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Words of the corpus contracts: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own_roots: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, named by spark.checkpoint.dir.

    Only on one machine (a local master, as in tests) may the session name
    none; then a temporary folder is made and kept for the application.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _own_roots:
            _own_roots[app] = "file://" + tempfile.mkdtemp(prefix="maskwright-")
        root = _own_roots[app]
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(root)  # a path without a scheme is of the cluster's own file system
    whole = path.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub("^file:/(?!/)", "file:///", whole).rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


#: For each `made` block that is open: paths and catalog tables made inside it.
_open: list[tuple[list[str], list[str]]] = []


def _made(spark: SparkSession, label: str, table_name: str | None = None) -> str:
    path = fresh_path(spark, label)
    for paths, names in _open:
        paths.append(path)
        if table_name:
            names.append(table_name)
    return path


def save(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage: executors lost later cost no recomputation of what
    lies before, and several readers share one computation.
    """
    spark = df.sparkSession
    path = _made(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder made by `save`."""
    context = spark.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def discard(saved: DataFrame) -> None:
    """Delete a table made by `save`, once nothing reads it any more."""
    for path in {f.rsplit("/", 1)[0] for f in saved.inputFiles()}:
        delete(saved.sparkSession, path)


@contextlib.contextmanager
def made(spark: SparkSession) -> Iterator[list[str]]:
    """Deletes, at its end, every table that was saved inside, so results must have been written elsewhere by then.

    Gives the list of paths; one taken from the list stays. Nothing else
    deletes what an open result reads.
    """
    paths: list[str] = []
    names: list[str] = []
    _open.append((paths, names))
    try:
        yield paths
    finally:
        _open.remove((paths, names))
        for name in names:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        for path in paths:
            delete(spark, path)


def save_bucketed(df: DataFrame, key: str, n: int, label: str) -> DataFrame:
    """Write ``df`` into the shared folder in ``n`` buckets of ``key``: what groups or joins by it later does not move its rows."""
    spark, name = df.sparkSession, f"{label}_{uuid.uuid4().hex}"
    df.repartition(n, key).write.bucketBy(n, key).option("path", _made(spark, label, name)).option("compression", "zstd").saveAsTable(name)
    return spark.table(name)


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id and whole text (null: empty); other columns, clashing names too, are left out."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def map_batches(df: DataFrame, func: Callable[[pa.RecordBatch], dict], schema: str) -> DataFrame:
    """``func`` turns each Arrow batch into columns of equal lengths."""
    struct = T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict(func(batch), schema=arrow)

    return df.mapInArrow(run, struct)


def gapless(df: DataFrame, groups: list[str], block_key: Column, order: list[str], out: str, blocks: int = 4096) -> DataFrame:
    """Number the rows of each group 0, 1, 2, ... in column ``out``, however large a group is.

    Rows of a group are dealt to ``blocks`` blocks by a hash, numbered within
    their block, and moved on by the rows of the blocks before: no task sees a
    whole group. The block table has at most ``blocks`` rows a group.
    """
    held = df.withColumn("__block", F.pmod(F.xxhash64(block_key, F.lit("block")), F.lit(blocks)))
    before = Window.partitionBy(*groups).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        held.groupBy(*groups, "__block")
        .agg(F.count("*").alias("__n"))
        .select(*groups, "__block", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    )
    within = Window.partitionBy(*groups, "__block").orderBy(*order)
    return (
        held.withColumn("__row", F.row_number().over(within))
        .join(starts, [*groups, "__block"])
        .withColumn(out, (F.col("__start") + F.col("__row") - 1).cast("long"))
        .drop("__block", "__row", "__start")
    )
